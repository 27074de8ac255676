"""Sinks: the three export tables, usage files, run metadata, staged sets of outputs."""

from __future__ import annotations

import json
import os
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.operators.numbering import global_row_number
from tallyframe.schemas import HEADER_FIELDS, LINE_FIELDS, USAGE


def export_tables(results: DataFrame, order: list[str] | None = None) -> dict[str, DataFrame]:
    """Invoices, LineItems and NeedsReview of result rows (source_file, invoice, needs_review, review_reason).

    Ids count the files in order, as ``INV-0001``; all three tables exist even when empty.
    """
    numbered = global_row_number(results, [F.col(c).asc() for c in order or ["source_file"]], "_n").withColumn("invoice_id", F.format_string("INV-%04d", "_n"))
    flat = lambda kind, name: F.col(name).cast("double") if kind.startswith("decimal") else F.col(name)
    types = dict((f.name, f.dataType.simpleString()) for f in results.schema["invoice"].dataType.fields)
    invoices = numbered.select("invoice_id", *[flat(types[f], f"invoice.{f}").alias(f) for f in HEADER_FIELDS], "source_file", "needs_review", "review_reason")
    item = {f.name: f.dataType.simpleString() for f in results.schema["invoice"].dataType["line_items"].dataType.elementType.fields}
    lines = numbered.select("invoice_id", "source_file", F.posexplode("invoice.line_items").alias("pos", "item")).select(
        "invoice_id", (F.col("pos") + 1).alias("line_number"), "source_file", *[flat(item[f], f"item.{f}").alias(f) for f in LINE_FIELDS])
    review = invoices.where("needs_review").select("invoice_id", "source_file", "invoice_number", "seller_name", "total_amount", "review_reason")
    return {"Invoices": invoices, "LineItems": lines, "NeedsReview": review}


def write_usage_csv(usage: DataFrame, folder: str) -> None:
    """A folder of CSV parts with all columns in order and a header each, also when empty; nulls are blank cells."""
    blank = [F.nullif(F.col(f.name), F.lit("")).alias(f.name) if f.dataType.simpleString() == "string" else F.col(f.name) for f in USAGE.fields]
    usage.select(*blank).write.mode("overwrite").option("header", True).csv(folder)


def usage_path(output: str) -> str:
    return os.path.splitext(output)[0] + ".usage.csv"


def _file_system(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def replace_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small text beside ``path`` and rename it there, on whatever file system the path names."""
    system, target = _file_system(spark, path)
    staged_at = target.suffix(f".{uuid.uuid4().hex}.tmp")
    out = system.create(staged_at, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    if system.exists(target):
        system.delete(target, True)
    if not system.rename(staged_at, target):
        system.delete(staged_at, True)
        raise OSError(f"could not replace {path}")


def write_summary(spark: SparkSession, rows: dict, path: str) -> None:
    """A small JSON document with sorted keys, replaced in one step; decimals and times become text."""
    replace_text(spark, path, json.dumps(rows, sort_keys=True, default=str, indent=1) + "\n")


def write_run_metadata(metadata: DataFrame, folder: str, run: dict) -> None:
    """A run's metadata: its files as JSON lines under ``files``, its own figures in ``run.json``."""
    metadata.write.mode("overwrite").json(f"{folder}/files")
    write_summary(metadata.sparkSession, run, f"{folder}/run.json")


def write_report(tables: dict[str, DataFrame], folder: str) -> None:
    """The report's tables and its summary as one staged set: nothing final is touched before all are written."""
    spark = next(iter(tables.values())).sparkSession
    with staged(spark, folder) as stage:
        for name, table in tables.items():
            table.write.mode("overwrite").parquet(f"{stage}/{name}")
        summary = spark.read.parquet(f"{stage}/Summary")
        write_summary(spark, {r["metric"]: r["value"] for r in summary.toLocalIterator()}, f"{stage}/summary.json")  # one row a metric


def write_status(spark: SparkSession, folder: str, job_id: str, state: str, **fields) -> None:
    """A job's status document, replaced in one step."""
    known = {"created_at", "started_at", "finished_at", "exit_code", "summary", "files", "artifacts", "error_category"}
    if unknown := set(fields) - known:
        raise ValueError(f"unknown status fields {sorted(unknown)}")
    write_summary(spark, {"schema_version": 1, "job_id": job_id, "state": state, **{k: fields.get(k) for k in known}, "artifacts": sorted(fields.get("artifacts") or [])}, f"{folder}/status.json")


def append_events(events: DataFrame, folder: str) -> None:
    """Events as JSON lines without null fields, one new file a flush; readers and streams take each file once."""
    events.write.mode("append").json(folder)


@contextmanager
def staged(spark: SparkSession, folder: str):
    """Yields a staging folder whose entries replace those of ``folder`` when the block succeeds.

    Nothing final is touched if the block fails. The replacement is one rename an entry on the
    folder's own file system; it is not one transaction over all of them.
    """
    system, final = _file_system(spark, folder)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    stage = path(final, f"_staging-{uuid.uuid4().hex}")
    system.mkdirs(stage)
    try:
        yield stage.toString()
        for entry in sorted(system.listStatus(stage), key=lambda e: e.getPath().getName()):
            target = path(final, entry.getPath().getName())
            if system.exists(target):
                system.delete(target, True)
            if not system.rename(entry.getPath(), target):
                raise OSError(f"could not replace {target.toString()}")
    finally:
        system.delete(stage, True)
