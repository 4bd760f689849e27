"""From section documents to a deduplicated corpus and its chunks."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def document_id(snapshot: Column, citation: Column, body_sha256: Column) -> Column:
    return F.concat(F.lit("doc-"), F.substring(F.sha2(F.concat_ws("\0", snapshot, citation, body_sha256), 256), 1, 32))


def chunk_id(document: Column, start: Column, end: Column, content_sha256: Column) -> Column:
    return F.concat(document, F.lit("-chunk-"), F.substring(F.sha2(F.concat_ws("\0", document, start, end, content_sha256), 256), 1, 16))


def markdown(front: dict[str, Column], heading: Column, body: Column) -> Column:
    """A document as Markdown: front matter in the order given, heading, body."""
    lines = [F.concat(F.lit(f"{key}: "), value) for key, value in front.items()]
    return F.concat(F.concat_ws("\n", F.lit("---"), *lines, F.lit("---")), F.lit("\n\n# "), heading, F.lit("\n\n"), body, F.lit("\n"))


def dedupe_conflicts(docs: DataFrame, key: str, *payload: str) -> DataFrame:
    """For each key the number of rows and whether these have one payload (kept once) or several (an error)."""
    return docs.groupBy(key).agg(F.count(F.lit(1)).alias("n"), (F.countDistinct(*payload) > 1).alias("conflict"))


def select_documents(docs: DataFrame, n: int, size: str, *ties: str) -> DataFrame:
    """The n largest documents, ties in the order of the columns given."""
    return docs.orderBy(F.desc(size), *ties).limit(n)


def chunk_fixed(docs: DataFrame, key: str, text: str, size: int = 768, overlap: int = 96) -> DataFrame:
    """Windows of white-space words that overlap; a window begins where more than the overlap is left."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    starts = F.sequence(F.lit(0), F.greatest(F.col("n") - overlap - 1, F.lit(0)), F.lit(size - overlap))
    rows = docs.select(key, words.alias("w")).withColumn("n", F.size("w")).where("n > 0").select(key, "w", "n", F.explode(starts).alias("start"))
    return rows.select(key, "start", F.least(F.lit(size), F.col("n") - F.col("start")).alias("n_words"), F.array_join(F.slice("w", F.col("start") + 1, size), " ").alias("content"))


def neighbor_links(chunks: DataFrame, document: str, order: str, chunk: str) -> DataFrame:
    w = Window.partitionBy(document).orderBy(order)
    return chunks.withColumn("previous_id", F.lag(chunk).over(w)).withColumn("next_id", F.lead(chunk).over(w))


# Where a chunk may end, besides the ends of the body. Behind a word and what follows it on its line, or the line ends after it; behind blank lines; behind a sentence.
WORD_END = r"\S+(?:[ \t]+|\n*)"
PARAGRAPH_END = r"(?:\r?\n){2,}"
SENTENCE_END = r"(?<=[.!?。！？])(?:[ \t]+|\r?\n)"


class _Body:
    """A document's text with the places where chunks may end, in order."""

    def __init__(self, text: str):
        self.text = text
        inner = {found.end() for pattern in (WORD_END, PARAGRAPH_END, SENTENCE_END) for found in re.finditer(pattern, text)} - {0, len(text)}
        self.places = sorted({0, len(text)} | inner) if inner else range(len(text) + 1)  # one word: behind any character

    def trimmed(self, start: int, end: int) -> tuple[int, int]:
        """The span without white space at its ends; empty, at its end, if there is nothing else."""
        part = self.text[start:end]
        first = start + len(part) - len(part.lstrip())
        return first, max(first, start + len(part.rstrip()))


def chunk_spans(body: str, prefix: str, count: Callable[[str], int], max_tokens: int = 768, overlap: int = 96) -> list[tuple[int, int]]:
    """Spans of a body in order, each as long as prefix and text hold max_tokens; the next begins at the earliest place from which no more than `overlap` tokens are repeated.

    What is cut off by a nearer end, or begins later, has no more tokens, so that both places are found by bisection.
    """
    if count(prefix) >= max_tokens:
        raise ValueError("the prefix leaves no room for text")
    own, spans = _Body(body), []
    start = own.trimmed(0, len(body))[0]
    while start < len(body):

        def too_long(end: int, start: int = start) -> bool:
            s, e = own.trimmed(start, end)
            return s < e and count(f"{prefix}\n{body[s:e]}") > max_tokens

        for ends in (own.places[bisect_right(own.places, start) :], range(start + 1, len(body) + 1)):  # the latter for a word that is too long
            fitting = bisect_left(ends, True, key=too_long)
            if fitting:
                break
        else:
            raise ValueError("the budget can't hold the text")
        s, e = own.trimmed(start, ends[fitting - 1])
        spans.append((s, e))
        if e >= len(body):
            break
        again = own.places[bisect_right(own.places, s) : bisect_left(own.places, e)] if overlap else []
        kept = bisect_left(again, True, key=lambda a, e=e: count(body[slice(*own.trimmed(a, e))]) <= overlap)
        start = own.trimmed(again[kept] if kept < len(again) else e, len(body))[0]
    return spans


def chunk_documents(docs: DataFrame, count: Callable[[str], int], max_tokens: int = 768, overlap: int = 96) -> DataFrame:
    """Token-budget chunks of document_id, prefix, body, body_start_line: linked, numbered by character and line, and named by their content.

    Documents are cut one by one within a task, as each span depends on the one before; documents are independent. count gives a text's tokens.
    """
    schema = "chunk_id string, document_id string, content string, start_char int, end_char int, start_line int, end_line int, token_count int, sha256 string, previous_id string, next_id string"

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for name, prefix, body, line in batch.itertuples(index=False):
                rows = []
                for s, e in chunk_spans(body, prefix, count, max_tokens, overlap):
                    digest = hashlib.sha256(body[s:e].encode()).hexdigest()
                    own = f"{name}-chunk-{hashlib.sha256(chr(0).join((name, str(s), str(e), digest)).encode()).hexdigest()[:16]}"
                    rows.append([own, name, body[s:e], s, e, line + body.count("\n", 0, s), line + body.count("\n", 0, e), count(f"{prefix}\n{body[s:e]}"), digest, None, None])
                for a, b in zip(rows, rows[1:], strict=False):
                    a[10], b[9] = b[0], a[0]
                out += rows
            yield pd.DataFrame(out, columns=[x.split()[0] for x in schema.split(", ")])

    return docs.select("document_id", "prefix", "body", "body_start_line").mapInPandas(cut, schema)
