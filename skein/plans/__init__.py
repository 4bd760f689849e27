"""The named queries and their SQL."""

from skein.plans import analytics, conversations, corpus, evaluation, logs, retrieval, text
from skein.plans.registry import QUERIES, SQL

__all__ = ["analytics", "conversations", "corpus", "evaluation", "logs", "retrieval", "text", "queries", "oracle_sql"]


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)
