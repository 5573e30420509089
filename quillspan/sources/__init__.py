"""Readers and writers of interval, segment, label, feature and audio files."""
