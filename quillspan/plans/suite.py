"""All queries of the library but those of the optional corpus subpackage."""

from __future__ import annotations

from quillspan.plans import signals, tabular
from quillspan.session import shipped

QUERIES = shipped({**tabular.QUERIES, **signals.QUERIES})
ORACLES = {**tabular.ORACLES, **signals.ORACLES}
