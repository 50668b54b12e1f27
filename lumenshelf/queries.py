"""The registered queries of the catalogue engine and the SQL that checks each."""

from __future__ import annotations

from lumenshelf.registry import ORACLES, QUERIES, browse, lifecycle, search

__all__ = ["ORACLES", "QUERIES", "browse", "lifecycle", "search"]
