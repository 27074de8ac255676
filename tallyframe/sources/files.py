"""File scans: documents, workbooks kept as tables, usage logs, run metadata, manifests, events.

Every reader has an explicit schema. Parsers of binary formats are injected, so that no format
library is needed on the driver; a file they cannot read becomes a row with ``error_class``.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyframe.functions.text import basename
from tallyframe.operators.scoring import DOCUMENT_TYPES, EXPECTED_OUTCOMES
from tallyframe.schemas import EVENT, PAGE, USAGE

Parser = Callable[[bytes], list[tuple[str, str]]]  # content -> (kind, text) of each page


def find_documents(spark: SparkSession, folder: str, suffix: str = "pdf") -> DataFrame:
    """(path, length, content) of the files with the suffix in any case, not in subfolders."""
    glob = "*." + "".join(f"[{c.lower()}{c.upper()}]" for c in suffix)
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder).select("path", "length", "content")


def scan_pages(documents: DataFrame, parser: Parser) -> DataFrame:
    """One row a page; an unreadable file gives one row with its error class."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                name = path.replace("\\", "/").rsplit("/", 1)[-1]
                try:
                    rows += [(name, i, kind, text, None) for i, (kind, text) in enumerate(parser(bytes(content)), 1)]
                except Exception as error:  # noqa: BLE001 - any parser may fail in any way
                    rows.append((name, None, None, None, type(error).__name__))
            yield pd.DataFrame(rows, columns=PAGE.names).astype({"page_no": "Int32"})

    return documents.select("path", "content").mapInPandas(parse, PAGE)


def render_pages(documents: DataFrame, wanted: DataFrame, renderer: Callable[[bytes, int, int], bytes | None], dpi: int = 200, limit: int | None = None) -> DataFrame:
    """(source_file, page_no, png) of the wanted pages in their order; pages out of range are left out.

    ``wanted`` has source_file and pages; ``limit`` takes the first pages of a file only.
    """
    pages = F.slice("pages", 1, limit) if limit else F.col("pages")
    chosen = documents.withColumn("source_file", basename(F.col("path"))).join(wanted.select("source_file", pages.alias("pages")), "source_file")

    def render(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples():
                for n in r.pages:
                    png = renderer(bytes(r.content), int(n), dpi)
                    if png is not None:
                        rows.append((r.source_file, int(n), png))
            yield pd.DataFrame(rows, columns=["source_file", "page_no", "png"])

    return chosen.select("source_file", "content", "pages").mapInPandas(render, "source_file string, page_no int, png binary")


def check_uploads(documents: DataFrame, max_files: int = 25, max_bytes: int = 25 << 20, max_total: int = 200 << 20) -> DataFrame:
    """(path, violation) of uploads that break a rule: the first rule broken by each.

    The number and the total of the uploads are two figures of one aggregate, taken first.
    """
    names = documents.select("path", "length", F.substring("content", 1, 5).alias("head"), F.lower(basename(F.col("path"))).alias("name"))
    repeated = names.groupBy("name").agg(F.count("*").alias("copies"))
    n, total = names.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    rows = names.join(repeated, "name")
    violation = (
        F.when(F.lit(n > max_files), "too_many_files").when(~F.col("name").endswith(".pdf"), "extension").when(F.col("head") != F.lit(b"%PDF-"), "signature")
        .when(F.col("length") == 0, "empty").when(F.col("length") > max_bytes, "too_large").when(F.lit(total > max_total), "total_too_large").when(F.col("copies") > 1, "duplicate_name")
    )
    return rows.select("path", violation.alias("violation")).where("violation is not null")


def read_document(spark: SparkSession, path: str) -> dict:
    """A JSON object; errors name the file and the kind of fault, never a value."""
    rows = spark.read.text(path, wholetext=True).take(1)
    if not rows:
        raise ValueError(f"file {path!r}: empty")
    try:
        found = json.loads(rows[0]["value"])
    except json.JSONDecodeError as error:
        raise ValueError(f"file {path!r}: malformed JSON ({error.msg} at line {error.lineno})") from None
    if not isinstance(found, dict):
        raise ValueError(f"file {path!r}: the top level must be a JSON object")
    return found


def read_thresholds(spark: SparkSession, path: str) -> DataFrame:
    """(key, target) of a thresholds document; keys of two underscores are notes and stay out."""
    found = {k: v for k, v in read_document(spark, path).items() if not k.startswith("__")}
    return spark.createDataFrame([(k, float(v)) for k, v in sorted(found.items())], "key string, target double")


def read_status(spark: SparkSession, folder: str) -> dict | None:
    """A job's status document; None where there is none or it cannot be read."""
    try:
        return read_document(spark, f"{folder}/status.json")
    except Exception:  # noqa: BLE001 - an absent, torn or foreign file is no status
        return None


def newest_finished(jobs: DataFrame) -> DataFrame:
    """The finished job with the greatest id, one row or none; ``jobs`` has job_id and state."""
    done = jobs.where(F.col("state").isin("completed", "cancelled", "failed"))
    return done.agg(F.max_by(F.struct(*done.columns), "job_id").alias("j")).where("j is not null").select("j.*")


def job_plans(pages: DataFrame) -> DataFrame:
    """(source_file, text_pages, image_pages) of uploaded files, as the plan of their requests."""
    kind = F.col("kind")
    return pages.groupBy("source_file").agg(F.count_if(kind == "text").alias("text_pages"), F.count_if(kind == "image").alias("image_pages"))


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """A sheet kept as CSV: the first row names the columns, empty rows are skipped, all values are text."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path).dropna(how="all")


def nest_lines(invoices: DataFrame, lines: DataFrame) -> DataFrame:
    """Invoices with their lines as an array in line order, empty where there are none."""
    entry = F.struct(*[F.col(c) for c in sorted(lines.columns, key=lambda c: (c != "line_number", c)) if c != "invoice_id"])
    nested = lines.groupBy("invoice_id").agg(F.array_sort(F.collect_list(entry)).alias("line_items"))
    kind = nested.schema["line_items"].dataType
    return invoices.join(nested, "invoice_id", "left").withColumn("line_items", F.coalesce("line_items", F.array().cast(kind)))


def read_usage(spark: SparkSession, path: str) -> DataFrame:
    """Usage rows; a missing path is an empty table."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], USAGE)
    return spark.read.schema(USAGE).option("header", True).csv(path)


def read_run_metadata(spark: SparkSession, path: str) -> DataFrame:
    """One row a file of a run's metadata; of repeated entries the last counts."""
    shape = "files array<struct<source_file:string,extraction_method:string,elapsed_seconds:double,attempts:bigint>>"
    doc = spark.read.schema(shape).option("multiLine", True).json(path)
    rows = doc.select(F.posexplode("files").alias("pos", "f")).withColumn("file", basename(F.col("f.source_file")))
    return rows.groupBy("file").agg(F.max_by("f", "pos").alias("f")).select("file", "f.extraction_method", "f.elapsed_seconds", "f.attempts")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Cases of a manifest, sorted by id."""
    shape = "cases array<struct<case_id:string,source_file:string,document_type:string,expected_outcome:string,ground_truth:string,notes:string>>"
    return spark.read.schema(shape).option("multiLine", True).json(path).select(F.inline("cases")).orderBy("case_id")


def manifest_violations(cases: DataFrame) -> DataFrame:
    """(case_id, violation): missing ids or files, repeated ids, unknown outcomes."""
    repeated = cases.groupBy("case_id").agg(F.count("*").alias("n"))
    rows = cases.join(repeated, "case_id", "left")
    checks = F.array_compact(F.array(
        F.when(F.trim(F.coalesce(F.col("case_id"), F.lit(""))) == "", "no_case_id"), F.when(F.trim(F.coalesce(F.col("source_file"), F.lit(""))) == "", "no_source_file"),
        F.when(F.col("n") > 1, "repeated_case_id"), F.when(~F.coalesce(F.col("expected_outcome").isin(EXPECTED_OUTCOMES), F.lit(False)), "unknown_outcome"),
        F.when(~F.coalesce(F.col("document_type").isin(DOCUMENT_TYPES), F.lit(False)), "unknown_document_type"), F.when(F.trim(F.coalesce("ground_truth", F.lit(""))) == "", "no_ground_truth"),
    ))
    return rows.select("case_id", F.explode(checks).alias("violation")).distinct()


def with_ground_truth(cases: DataFrame, truths: DataFrame) -> DataFrame:
    """Manifest cases with their ground truth joined by file name, and ``found``, false where the file is absent.

    ``truths`` has path and the fields of the ground-truth documents; folders are ignored.
    """
    named = truths.withColumn("_file", basename(F.col("path"))).withColumn("_there", F.lit(True)).drop("path", "case_id", "source_file", "notes")
    joined = cases.withColumn("_file", basename(F.col("ground_truth"))).join(named, "_file", "left")
    return joined.withColumn("found", F.coalesce("_there", F.lit(False))).drop("_file", "_there")


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events of a log of JSON lines: the first of each (job, seq), in order; lines that are no event are left out."""
    lines = spark.read.text(folder).select(F.from_json("value", EVENT.simpleString(), {"mode": "PERMISSIVE"}).alias("e"), F.monotonically_increasing_id().alias("pos"))
    good = lines.select("e.*", "pos").where("seq is not null and event is not null")
    firsts = good.groupBy("job_id", "seq").agg(F.min_by(F.struct(*[c for c in EVENT.names if c not in ("job_id", "seq")]), "pos").alias("e"))
    return firsts.select("job_id", "seq", "e.*").orderBy("job_id", "seq")


def last_events(events: DataFrame, n: int = 12) -> DataFrame:
    """The last ``n`` events of each job."""
    at = Window.partitionBy("job_id").orderBy(F.desc("seq"))
    return events.withColumn("_r", F.row_number().over(at)).where(F.col("_r") <= n).drop("_r")
