"""Sections of hierarchical XML documents, with the headings that they stand under."""

from __future__ import annotations

import io
import re
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "source string, path string, number string, heading string, body string"


def _line(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()


def _table(element) -> str:
    """Rows padded to one width, with a rule under the first."""
    rows = [[_line("".join(c.itertext())).replace("|", "\\|") for c in row if c.tag.upper() in ("TD", "TH")] for row in element.iter() if row.tag.upper() == "TR"]
    rows = [r for r in rows if r]
    if not rows:
        return ""
    width = max(map(len, rows))
    lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
    return "\n".join([lines[0], "|" + " --- |" * width, *lines[1:]])


def _block(element) -> str:
    tag = element.tag.upper()
    if tag == "TABLE":
        return _table(element)
    if tag in ("UL", "OL", "LIST"):
        return "\n".join(f"- {_line(''.join(x.itertext()))}" for x in element)
    text = _line("".join(element.itertext()))
    return f"> Note: {text}" if text and tag == "NOTE" else text


def sections_of(content: bytes) -> Iterator[tuple[str, str, str, str]]:
    """path, number, heading and body of each section that isn't reserved or empty. Declarations of types and entities are refused; elements are dropped as soon as they are read."""
    if re.search(rb"<!(DOCTYPE|ENTITY)", content, re.IGNORECASE):
        raise ValueError("XML declares a type or an entity")
    frames: list[dict] = []
    for event, element in ElementTree.iterparse(io.BytesIO(content), events=("start", "end")):
        if not re.fullmatch(r"DIV\d+", element.tag):
            if event == "end" and element.tag == "HEAD" and frames and frames[-1]["head"] is None:
                frames[-1]["head"] = _line("".join(element.itertext()))
            continue
        if event == "start":
            frames.append({"type": element.get("TYPE", ""), "n": element.get("N", ""), "head": None})
            continue
        own = frames.pop()
        if own["type"] == "SECTION":
            body = "\n\n".join(b for b in (_block(x) for x in element if x.tag != "HEAD") if b)
            heading = re.sub(rf"^§\s*{re.escape(own['n'])}\s*", "", own["head"] or "").rstrip(".").strip()
            if body and "[reserved]" not in (own["head"] or "").lower():
                yield " / ".join(f["head"] or f["n"] for f in frames), own["n"], heading, body
        element.clear()


def parse_sections(files: DataFrame) -> DataFrame:
    """Sections of files (source, content). A file is parsed in one go within a task; files are independent."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for batch in batches:
            yield pd.DataFrame([(source, *s) for source, content in batch.itertuples(index=False) for s in sections_of(content)], columns=names)

    return files.select("source", "content").mapInPandas(parse, SCHEMA)


def read_sections(spark: SparkSession, pattern: str) -> DataFrame:
    """Sections of all files that match a path pattern."""
    return parse_sections(spark.read.format("binaryFile").load(pattern).selectExpr("path AS source", "content"))
