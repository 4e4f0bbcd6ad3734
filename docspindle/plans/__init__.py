"""Registered queries over the test tables, and their SQL."""

from __future__ import annotations


def _modules():
    from . import answers, catalog, documents, events, indexed, questions, relating, retrieval, sectioning, text

    return text, catalog, retrieval, answers, events, documents, questions, indexed, sectioning, relating


def queries() -> dict:
    return {k: v for m in _modules() for k, (v, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _modules() for k, (_, s) in m.QUERIES.items() if s}
