"""Markdown to blocks: headings, paragraphs, lists with levels, pipe tables.

Every line is put into a class by one letter; a block is a word over these letters, so the grammar
of blocks is a regular expression over the text's word of classes:

    h  heading     |  line with a pipe     r  rule of a table     i  list item     .  blank     t  other

A line that fits several classes takes the first of blank, heading, rule, pipe, item; a rule or an
item may still stand where the grammar asks for a line with a pipe, so letters come in variants
(R and I hold a pipe too).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.functions.text import without_comments

SCHEMA = "ord int, kind string, level int, text string, items array<struct<level:int,text:string,marker:string>>, table_rows array<array<string>>"
_CLASS = re.compile(
    r"(?P<blank>\s*\Z)|(?P<heading>#{1,6}\s+\S)|(?P<rule>\s*\|?\s*:?-{3,}:?\s*(?:\|\s*:?-{3,}:?\s*)+\|?\s*\Z)|(?P<item>\s*(?:[-+*]|\d+[.)])\s+\S)"
)
_LETTER = {("blank", False): ".", ("heading", False): "h", ("heading", True): "H", ("rule", True): "R", ("item", False): "i", ("item", True): "I", (None, False): "t", (None, True): "|"}
#: Blocks over letters. A head line with a pipe and a rule under it open a table, whatever else the head is but a heading.
_GRAMMAR = re.compile(r"(?P<heading>[hH])|(?P<table>[|IR]R[|IRH]*)|(?P<list>(?:i|I(?!R))[iI]*)|(?P<paragraph>(?:t|[|R](?!R))+)|(?P<blank>\.)|(?P<rest>.)")
_ITEM = re.compile(r"(\s*)([-+*]|\d+[.)])\s+(.*\S)")
_CELL = re.compile(r"((?:\\.|[^|\\])*\\?)(?:\||\Z)", re.S)


def _letter(line: str) -> str:
    m = _CLASS.match(line)
    return _LETTER[m.lastgroup if m else None, "|" in line]


def table_cells(line: str) -> list[str]:
    """Cells of a pipe row; a backslash keeps the sign after it."""
    body = re.sub(r"(?<!\\)\|\Z", "", line.strip().removeprefix("|"))
    cells = [m[1] for m in _CELL.finditer(body)]
    if len(cells) > 1 and not body.endswith("|") or body.endswith(r"\|"):
        cells = cells[:-1]  # the pattern also meets the empty end
    return [re.sub(r"\\(.)", r"\1", c, flags=re.S).strip() for c in cells] or [""]


def _lists(lines: list[str]) -> Iterator[list[dict]]:
    """The items of a run of lines, cut where a level goes over from bullets to numbers or back."""
    first: dict[int, bool] = {}
    part = 0
    rows = []
    for line in lines:
        indent, marker, text = _ITEM.match(line).groups()
        level = min(len(indent.replace("\t", " " * 4)) // 2, 8)
        if first.setdefault(level, marker[0].isdigit()) != marker[0].isdigit():
            part, first = part + 1, {level: marker[0].isdigit()}
        rows.append((part, {"level": level, "text": text, "marker": marker}))
    for _, run in groupby(rows, lambda r: r[0]):
        yield [r[1] for r in run]


def blocks(text: str) -> Iterator[tuple]:
    """(kind, level, text, items, rows) of a text without comments, in order."""
    lines = re.sub("\r\n?", "\n", text).splitlines()
    word = "".join(map(_letter, lines))
    for m in _GRAMMAR.finditer(word):
        own = lines[m.start() : m.end()]
        if m.lastgroup == "heading":
            marks, title = own[0].split(None, 1)
            yield "heading", len(marks), title.strip(), [], []
        elif m.lastgroup == "table":
            rows = [table_cells(own[0]), *map(table_cells, own[2:])]
            width = len(rows[0])
            yield "table", 0, None, [], [[*r, *[""] * width][:width] for r in rows]
        elif m.lastgroup == "list":
            for items in _lists(own):
                yield "list", 0, None, items, []
        elif m.lastgroup in ("paragraph", "rest"):
            yield "paragraph", 0, " ".join(l.strip() for l in own), [], []


def markdown_blocks(records: DataFrame, key: str, text: str) -> DataFrame:
    """One row per block of each record's Markdown: key, ord and the block. Null texts have none.

    Comments are taken out in the JVM, unclosed ones to the end of the text.
    """

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in it:
            rows = [(k, n, *b) for k, t in zip(p["k"], p["t"]) for n, b in enumerate(blocks(t))]
            yield pd.DataFrame(rows, columns=["k", "ord", "kind", "level", "text", "items", "table_rows"])

    kind = records.schema[key].dataType.simpleString()
    out = records.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("k"), without_comments(F.col(text)).alias("t")).mapInPandas(run, f"k {kind}, {SCHEMA}")
    return out.withColumnRenamed("k", key)
