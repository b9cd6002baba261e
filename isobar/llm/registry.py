"""Queries of the corpus operators and their SQL, by name."""

from __future__ import annotations

from . import ann, langid, lm, mergedropout, mixing, neardup, quality, toxicity, warc, weaklabel

MODULES = (langid, toxicity, neardup, lm, quality, warc, ann, mergedropout, mixing, weaklabel)


def queries() -> dict:
    """All corpus queries; each module names its own."""
    return {name: q for m in MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """SQL for those that SQL can express."""
    return {name: s for m in MODULES for name, s in getattr(m, "ORACLE_SQL", {}).items()}
