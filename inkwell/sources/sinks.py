"""Sinks: content-addressed archive, digests manifest, issue reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def archive_new(files: DataFrame, archive: str) -> DataFrame:
    """Appends to a folder the contents it doesn't hold yet, one row per digest; gives the archive's list.

    files(path, content). The first path by name stands for a content; the archive is a parquet table
    partitioned by the first two digits of the digest, so that finding what is there reads no content.
    """
    spark = files.sparkSession
    new = files.where("content is not null").groupBy(F.sha2("content", 256).alias("digest")).agg(F.min("path").alias("path"), F.min_by("content", "path").alias("content"))
    new = new.withColumn("part", F.substring("digest", 1, 2))
    try:
        new = new.join(spark.read.parquet(archive).select("digest"), "digest", "left_anti")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
    new = new.select("digest", "path", F.length("content").alias("size"), "content", "part")
    new.write.mode("append").partitionBy("part").parquet(archive)
    return spark.read.parquet(archive).drop("content")


def manifest(files: DataFrame) -> DataFrame:
    """(path, sha256, size) of files(path, content), one row per path."""
    return files.groupBy("path").agg(F.first(F.sha2("content", 256)).alias("sha256"), F.first(F.length("content")).alias("size"))


def issues_as_json(issues: DataFrame) -> DataFrame:
    """One JSON line per issue, in the one order of issues, keys sorted, nulls kept."""
    from inkwell.operators.audit import issue_order

    columns = sorted(issues.columns)
    return issue_order(issues).select(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("value"))


def issues_as_text(issues: DataFrame) -> DataFrame:
    """(n, line): one line per issue in their one order, and a last one that counts them; n is the line's place."""
    from inkwell.operators.audit import issue_order

    place = F.concat_ws(":", F.col("path"), F.col("line").cast("string")) if "line" in issues.columns else F.col("path")
    lines = issue_order(issues).select(F.concat_ws(" ", F.upper("level"), F.concat(F.lit("["), F.col("code"), F.lit("]")), place, F.col("message") if "message" in issues.columns else F.lit("")).alias("line"))
    total = issues.agg(F.format_string("%d errors, %d warnings", F.count_if(F.col("level") == "error"), F.count_if(F.col("level") == "warning")).alias("line"))
    return lines.select(F.monotonically_increasing_id().alias("n"), "line").unionByName(total.select(F.lit(2**62).alias("n"), "line"))


def write_pages(pages: DataFrame, path: str) -> None:
    """Text files of pages(doc, page, text) in order, each page under a line with its number. A document may go
    over several files: the rows are spread by range, so no task holds a whole document."""
    marked = F.concat(F.lit("<!-- page "), F.col("page").cast("string"), F.lit(" -->\n"), F.coalesce("text", F.lit("")), F.lit("\n"))
    pages.repartitionByRange("doc", "page").sortWithinPartitions("doc", "page").select(marked.alias("value")).write.mode("overwrite").text(path)


def write_records(records: DataFrame, path: str) -> None:
    """JSON lines with keys in order of name and nulls kept, so that equal records are equal lines."""
    columns = sorted(records.columns)
    records.select(F.to_json(F.struct(*columns), {"ignoreNullFields": "false", "sortKeys": "true"}).alias("value")).write.mode("overwrite").text(path)


def file_receipt(files: DataFrame, fingerprint: str) -> DataFrame:
    """(fingerprint, path, sha256) of files(path, content), one row per path."""
    return manifest(files).select(F.lit(fingerprint).alias("fingerprint"), "path", "sha256")


def valid_log_events(events: DataFrame, name: str, kinds: list[str]) -> DataFrame:
    """events(task_id, event, details) with `valid`: a portable task name, a known event, details that are safe JSON
    (functions.text.json_safe). A log's file name must be portable, else an error."""
    import re

    from inkwell.functions.text import json_safe

    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]{0,79}", name):
        raise ValueError("the log's name is not portable")
    ok = F.col("task_id").rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]{0,79}$") & F.col("event").isin(kinds) & (F.col("details").isNull() | json_safe(F.col("details")))
    return events.withColumn("valid", F.coalesce(ok, F.lit(False)))
