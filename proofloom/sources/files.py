"""Readers and writers for export files, sheets, runs, logs and reports."""

from __future__ import annotations

import csv
import io
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.campaign import MAIL, SHEET_ORDER

MARKER_LINE = r"^(?:\d{2}:\d{2}:\d{2}\.\d{3} )?(\d+) \| (?:SCREEN )?(.*)$"
API_CALL = "session_id string, t bigint, fn string, args array<string>, result string"


# -- campaign exports -----------------------------------------------------------

def _decoded(raw: bytes) -> str:
    for encoding in ("utf-8-sig", "cp1252"):
        try:
            return raw.decode(encoding)
        except UnicodeDecodeError:
            pass
    return raw.decode("latin-1")


def _export_rows(batches):
    """One row per data row of each file: header and cells as arrays."""
    for files in batches:
        out = []
        for path, raw in zip(files["path"], files["content"]):
            header = None
            for number, row in enumerate(csv.reader(io.StringIO(_decoded(bytes(raw))))):
                cells = [c.strip() for c in row]
                if header is None:
                    if any(c.lower() == MAIL.lower() for c in cells):
                        header = cells
                elif any(cells):
                    out.append((path, number, header, list(row), None))
            if header is None:
                out.append((path, None, None, None, f"no {MAIL} header row"))
        yield pd.DataFrame(out, columns=["path", "row_no", "header", "cells", "error"])


def read_campaign_cells(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(path, row_no, header, cells, error) of campaign CSV files.

    The header is the first row that has the mail column, which only the file
    itself can tell, so each file is read whole by one task; many files spread
    over the cluster.  A file without such a row becomes one error row.
    """
    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    return files.mapInPandas(_export_rows, "path string, row_no int, header array<string>, "
                                           "cells array<string>, error string")


def campaign_table(cells: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Cells laid out under ``columns`` by header name, whatever the case or
    position; short rows give null.  Files without a header fail the read."""
    lookup = F.transform("header", lambda h: F.lower(h))
    broken = F.raise_error(F.concat(F.col("path"), F.lit(": "), F.col("error")))
    path = F.when(F.col("error").isNotNull(), broken.cast("string")).otherwise(F.col("path"))
    picked = [F.get("cells", F.array_position(lookup, c.lower()).cast("int") - 1) for c in columns]
    return cells.select(path.alias("path"), "row_no", *[p.alias(c) for p, c in zip(picked, columns)])


# -- sheets -------------------------------------------------------------------

def write_sheets(df: DataFrame, path: str, order: Sequence[str] = SHEET_ORDER) -> None:
    """One table split by ``sheet`` into partitions, with the sheet order beside
    it: the given order first (empty sheets too), any others after it by name."""
    df.write.mode("overwrite").partitionBy("sheet").parquet(f"{path}/rows")
    spark = df.sparkSession
    listed = spark.createDataFrame(list(enumerate(order)), "sheet_ord int, sheet string")
    extra = (df.select("sheet").distinct().join(listed, "sheet", "left_anti")
             .select(F.lit(len(order)).alias("sheet_ord"), "sheet"))
    listed.unionByName(extra).write.mode("overwrite").parquet(f"{path}/sheet_order")


def read_sheets(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return (spark.read.parquet(f"{path}/rows"),
            spark.read.parquet(f"{path}/sheet_order").orderBy("sheet_ord", "sheet"))


def projection(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exactly ``columns``; a missing one is empty."""
    have = {c.lower(): c for c in df.columns}
    return df.select(*[F.coalesce(F.col(f"`{have[c.lower()]}`").cast("string"), F.lit("")).alias(c)
                       if c.lower() in have else F.lit("").alias(c) for c in columns])


def write_projection_csv(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    projection(df, columns).write.mode("overwrite").option("header", True).csv(path)


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("sep", "\t").csv(path)


def write_report_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


# -- runs -----------------------------------------------------------------------

def run_records(df: DataFrame, run_id: Column, ts: Column, kind: str, has_issues: Column) -> DataFrame:
    """Typed rows as stored runs: the row as JSON text and one derived flag."""
    return df.select(run_id.cast("bigint").alias("run_id"), ts.alias("ts"), F.lit(kind).alias("kind"),
                     has_issues.alias("has_issues"), F.to_json(F.struct(*df.columns)).alias("payload"))


def append_runs(records: DataFrame, path: str) -> None:
    records.write.mode("append").partitionBy("kind").parquet(path)


def read_runs(spark: SparkSession, path: str, kind: str, schema: T.StructType | str) -> DataFrame:
    """Runs of one kind (partition pruned) with their payload typed again."""
    rows = spark.read.parquet(path).filter(F.col("kind") == kind)
    return rows.withColumn("payload", F.from_json("payload", schema)).select(
        "run_id", "ts", "kind", "has_issues", "payload.*")


# -- logs -----------------------------------------------------------------------

def parse_marker_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """"<clock> <epoch ms> | SCREEN id" and "<epoch ms> | text" lines to (ts, text);
    lines of any other shape are dropped.  Works on a stream as on a batch."""
    keep = [c for c in lines.columns if c != value]
    c = F.col(value)
    return (lines.filter(c.rlike(MARKER_LINE))
            .select(*keep, F.timestamp_millis(F.regexp_extract(c, MARKER_LINE, 1).cast("bigint")).alias("ts"),
                    F.regexp_extract(c, MARKER_LINE, 2).alias("text")))


def read_marker_log(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    reader = spark.readStream if stream else spark.read
    return parse_marker_lines(reader.text(path))


def read_api_calls(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    reader = spark.readStream if stream else spark.read
    return reader.schema(API_CALL).json(path).withColumn("ts", F.timestamp_millis("t")).drop("t")
