"""Every query of the engine on the test tables, by operator group."""

from ..registry import QUERIES, SQL
from . import agreement, curation, decisions, duplicates, language_model, lists, records, retrieval, websites  # noqa: F401


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)
