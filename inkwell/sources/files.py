"""File sources: documents as pages, and cards with TOML front matter."""

from __future__ import annotations

import io
import json
import tomllib
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions.text import suffix

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
PAGES = "path string, page_no int, text string, error string"


def docx_text(content: bytes) -> str:
    """Paragraphs and tables of a Word file in order; the cells of a row joined by tabs, empty rows left out."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    lines = []
    for part in body if body is not None else ():
        if part.tag == f"{_W}p":
            lines.append("".join(t.text or "" for t in part.iter(f"{_W}t")))
        elif part.tag == f"{_W}tbl":
            for row in part.iter(f"{_W}tr"):
                cells = ["\n".join("".join(t.text or "" for t in p.iter(f"{_W}t")) for p in c.iter(f"{_W}p")).strip() for c in row.iter(f"{_W}tc")]
                if any(cells):
                    lines.append("\t".join(cells))
    return "\n".join(lines)


def read_documents(spark: SparkSession, path: str, pdf_reader: Callable[[bytes], list[str]] | None = None) -> DataFrame:
    """(path, page_no, text, error): pages of the .md, .txt, .docx and .pdf files under a folder.

    Files other than PDF are one page, numbered 1; a byte order mark is left out. PDF pages come from
    `pdf_reader`; without one, and for files that can't be read or have another suffix, text is null
    and error says why. Contents are read on the executors.
    """

    def pages(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in it:
            rows = []
            for path, content, kind in zip(p["path"], p["content"], p["suffix"]):
                try:
                    if kind in (".md", ".txt"):
                        rows.append((path, 1, bytes(content).decode("utf-8-sig"), None))
                    elif kind == ".docx":
                        rows.append((path, 1, docx_text(bytes(content)), None))
                    elif kind == ".pdf" and pdf_reader:
                        rows += [(path, n, t or "", None) for n, t in enumerate(pdf_reader(bytes(content)), 1)]
                    else:
                        rows.append((path, None, None, "no reader for " + (kind or "files without suffix")))
                except Exception as e:  # a broken file is a row, not a failed job
                    rows.append((path, None, None, type(e).__name__))
            yield pd.DataFrame(rows, columns=["path", "page_no", "text", "error"]).astype({"page_no": "Int32"})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content", suffix(F.col("path")).alias("suffix")).mapInPandas(pages, PAGES)


def parse_card(text: str) -> tuple[str | None, str | None, str | None]:
    """(metadata as JSON, body, error) of a card: TOML between two +++ lines, then Markdown."""
    lines = text.split("\n")
    if lines[0].strip() != "+++":
        return None, None, "no front matter"
    try:
        end = next(i for i, l in enumerate(lines[1:], 1) if l.strip() == "+++")
        return json.dumps(tomllib.loads("\n".join(lines[1:end])), ensure_ascii=False, sort_keys=True, default=str), "\n".join(lines[end + 1 :]).strip("\n"), None
    except StopIteration:
        return None, None, "front matter is not closed"
    except tomllib.TOMLDecodeError:
        return None, None, "front matter is no TOML"


def read_cards(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """(path, metadata, body, error) of the Markdown cards two levels below `root`; metadata has the given schema."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in it:
            yield pd.DataFrame([(path, *parse_card(t)) for path, t in zip(p["path"], p["value"])], columns=["path", "meta", "body", "error"])

    raw = spark.read.text(f"{root}/*/*.md", wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return raw.mapInPandas(run, "path string, meta string, body string, error string").select("path", F.from_json("meta", schema).alias("metadata"), "body", "error")


def null_split(listing: DataFrame, column: str) -> DataFrame:
    """(path): the paths of a listing whose entries end with NUL; empty ones left out."""
    return listing.select(F.explode(F.split(column, "\\x00")).alias("path")).where("path <> ''")


def bounded(files: DataFrame, wanted: DataFrame, limit: int = 2 * 1024 * 1024) -> DataFrame:
    """(path, length, content, state) of the wanted(path) among files(path, length, content): 'read', 'too_large'
    (content null; the length is tested before any content is read) or 'missing'."""
    small = files.where(F.col("length") <= limit).select("path", "content")
    d = wanted.select("path").distinct().join(files.select("path", "length"), "path", "left").join(small, "path", "left")
    return d.select("path", "length", "content", F.when(F.col("length").isNull(), "missing").when(F.col("length") > limit, "too_large").otherwise("read").alias("state"))


def page_images(images: DataFrame, counts: DataFrame) -> DataFrame:
    """(doc, page, state) of images(doc, name) against counts(doc, pages): names page-N with N from 1 to pages,
    each once. state is present, duplicate, missing, out_of_range or unnamed (page null)."""
    number = F.regexp_extract("name", r"^page-(\d+)(?:\.[^.]*)?$", 1).try_cast("int")
    have = images.select("doc", number.alias("page")).groupBy("doc", "page").agg(F.count("*").alias("n"))
    want = counts.where("pages > 0").select("doc", F.explode(F.sequence(F.lit(1), F.col("pages").cast("int"))).alias("page"), F.lit(True).alias("_in"))
    d = have.join(want, (have["doc"] == want["doc"]) & (have["page"] == want["page"]), "full_outer").select(F.coalesce(have["doc"], want["doc"]).alias("doc"), F.coalesce(have["page"], want["page"]).alias("page"), "n", "_in")
    state = F.when(F.col("page").isNull(), "unnamed").when(F.col("_in").isNull(), "out_of_range").when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "duplicate").otherwise("present")
    return d.select("doc", "page", state.alias("state"))


def content_files(files: DataFrame, modules: dict[str, str], overviews: list[str] = ()) -> DataFrame:
    """(path, module, state) of the Markdown files of files(path): the module that a file's name stands for,
    'overview', or 'unknown_module_file'. The suffix counts in any case; other files have no row."""
    name = F.element_at(F.split("path", "/"), -1)
    known = F.create_map(*[F.lit(x) for p in modules.items() for x in p]) if modules else F.create_map().cast("map<string,string>")
    d = files.select("path", name.alias("_n")).where(F.lower("_n").endswith(".md")).withColumn("module", F.try_element_at(known, F.col("_n")))
    state = F.when(F.col("module").isNotNull(), "module").when(F.col("_n").isin(list(overviews)), "overview").otherwise("unknown_module_file")
    return d.select("path", "module", state.alias("state"))


def read_versioned(spark: SparkSession, path: str, schema: str, version: int = 1) -> DataFrame:
    """One row per JSON file under path, with the given schema; an error at the first file of another schema_version."""
    d = spark.read.text(path, wholetext=True).select(F.from_json("value", f"schema_version int, {schema}").alias("j")).select("j.*")
    sound = F.assert_true(F.coalesce(F.col("schema_version") == version, F.lit(False)), f"schema_version must be {version}")
    return d.where(sound.isNull())
