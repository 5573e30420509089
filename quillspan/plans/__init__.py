"""Named queries over the input tables, each with the SQL that gives the same rows."""
