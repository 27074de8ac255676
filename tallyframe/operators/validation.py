"""Checks of annotations and jobs that come out as rows: line violations, suspicious lines, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.numbers import coerce_decimal
from tallyframe.functions.text import blank_to_null, scored_identifier
from tallyframe.operators.scoring import NOT_EXTRACTABLE_LINE
from tallyframe.schemas import LINE_FIELDS, NUMERIC_LINE_FIELDS

_DECIMAL = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*\z"


def line_violations(cases: DataFrame) -> DataFrame:
    """(case_id, field, violation) of annotated lines: unknown fields, bad decimals, identifiers that repeat within a case.

    The first line with an identifier is good, later ones are named. The first place of each
    identifier is a grouped minimum, so no case is gathered.
    """
    lines = cases.select("case_id", F.posexplode("line_items").alias("pos", "it"))
    kv = lines.select("case_id", "pos", F.explode("it").alias("k", "v"))
    path = F.format_string("line_items[%d].%s", "pos", "k")
    own = F.when(~F.col("k").isin(*LINE_FIELDS, *NOT_EXTRACTABLE_LINE), "unsupported_field").when(
        F.col("k").isin(NUMERIC_LINE_FIELDS) & F.col("v").isNotNull() & ~F.col("v").rlike(_DECIMAL), "not_a_decimal")
    wrong = kv.select("case_id", path.alias("field"), own.alias("violation")).where("violation is not null")
    ids = kv.where(F.col("k").isin("line_no", "item_code") & (F.col("v") != "")).withColumn("_n", scored_identifier(F.col("v")))
    firsts = ids.groupBy("case_id", "k", "_n").agg(F.min("pos").alias("_first"))
    again = ids.join(firsts, ["case_id", "k", "_n"]).where(F.col("pos") > F.col("_first"))
    return wrong.unionByName(again.select("case_id", path.alias("field"), F.concat(F.lit("duplicate_"), "k").alias("violation")))


def suspicious_lines(lines: DataFrame, key: str) -> DataFrame:
    """By ``key``: places of the lines without amount and their descriptions, in order."""
    bad = lines.where(coerce_decimal(F.col("amount")).isNull()).select(key, "line_number", F.coalesce(blank_to_null(F.col("description")), F.lit("(no description)")).alias("d"))
    listed = bad.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("line_number", "d"))).alias("l"))
    return listed.select(
        key, F.array_join(F.transform("l", lambda x: x["line_number"].cast("string")), ", ").alias("line_numbers"), F.array_join(F.transform("l", lambda x: x["d"]), "; ").alias("line_descriptions"))


def job_verdicts(jobs: DataFrame, now: Column, limit_hours: float, active: Column) -> DataFrame:
    """(job_id, age_h, verdict): age from the end, else the beginning; expired from the limit on, the active job is kept."""
    stamp = F.coalesce("finished", "created")
    age = F.timestamp_diff("SECOND", F.date_trunc("second", stamp).cast("timestamp_ntz"), now) / 3600.0
    verdict = F.when(F.coalesce(F.col("job_id") == active, F.lit(False)), "kept_active").when(age >= limit_hours, "expired").otherwise("kept")
    return jobs.select("job_id", F.bround(age, 4).alias("age_h"), verdict.alias("verdict"))
