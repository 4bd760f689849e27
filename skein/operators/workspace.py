"""Lines of texts: pages and literal search."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.text import ascii_lower, literal_positions


def _lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(key, F.posexplode(F.split(text, "\n")).alias("line", "content")).withColumn("line", (F.col("line") + 1).cast("bigint"))


def line_page(docs: DataFrame, key: str, text: str, start_line: int = 1, max_lines: int = 1000, max_bytes: int = 61_440) -> DataFrame:
    """Lines from start_line on, as many as both limits allow."""
    page = _lines(docs, key, text).where(F.col("line").between(start_line, start_line + max_lines - 1))
    used = F.sum(F.octet_length("content") + 1).over(Window.partitionBy(key).orderBy("line"))
    return page.withColumn("used", used).where(F.col("used") <= max_bytes).select(key, "line", "content")


def search_lines(docs: DataFrame, key: str, text: str, needle: str, fold: bool = False) -> DataFrame:
    """key, line and column_no of each place of a literal; with fold A-Z match a-z."""
    content = ascii_lower(F.col("content")) if fold else F.col("content")
    needle = needle.translate({65 + i: 97 + i for i in range(26)}) if fold else needle
    hits = _lines(docs, key, text).where(content.contains(needle))
    return hits.select(key, "line", F.explode(literal_positions(content, needle)).alias("column_no"))
