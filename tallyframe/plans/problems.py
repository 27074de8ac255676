"""Queries of the general problems 5 and 7."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.operators.diff import ANNOTATION_FIELDS, annotation_differences, annotation_fields, diff_copies
from tallyframe.operators.timestamps import estimate_offsets, invoice_dates, normalize_timestamps, parsed_parts
from tallyframe.session import read_table


def p5_found(spark, d):
    return annotation_differences(read_table(spark, d, "annotations"), read_table(spark, d, "annotations_copy"))


def p5_all_copies(spark, d):
    """Every stored copy against every stored copy: duplicates cancel, leftovers pair at least cost."""
    sides = [annotation_fields(read_table(spark, d, t)) for t in ("annotations", "annotations_copy")]
    return diff_copies(*sides, ["case_id"], ANNOTATION_FIELDS)


def p7_found(spark, d):
    return invoice_dates(read_table(spark, d, "invoices"))


def p7_normal_forms(spark, d):
    rows = read_table(spark, d, "invoices").select("invoice_id", "invoice_date", "issuer_tz", "ingested_at", "seller_name")
    found = normalize_timestamps(rows, "invoice_date", "issuer_tz", "ingested_at", "seller_name")
    return found.select("invoice_id", "invoice_date", "normal_form", F.when(F.length("normal_form") == 10, "day").when(F.col("normal_form").isNotNull(), "moment").otherwise("unreadable").alias("kind"))


def p7_histories(spark, d):
    """(office, month, minutes): the offsets of the offices, estimated as if no date stated a zone."""
    rows = read_table(spark, d, "invoices").select(F.col("issuer_tz").alias("office"), "invoice_date", F.lit(None).cast("string").alias("zone"), "ingested_at")
    found = estimate_offsets(parsed_parts(rows, "invoice_date", "zone"), "office", "ingested_at", "zone")
    return found.select("office", F.col("_month").alias("month"), F.col("_estimated").alias("minutes"))


QUERIES = {"p7_histories": p7_histories, "p5_found": p5_found, "p5_all_copies": p5_all_copies, "p7_found": p7_found, "p7_normal_forms": p7_normal_forms}


def _side(table: str) -> str:
    from tallyframe.plans.reference import _dec

    t = "nullif(regexp_replace(invoice['total_amount'], '^\\s+|\\s+$', '', 'g'), '')"
    number = _dec("invoice['total_amount']").replace("DECIMAL(28,10)", "DECIMAL(38,10)")
    rows = (
        f"SELECT case_id, annotated_at, nullif(lower(regexp_replace(invoice['invoice_number'], '\\s+', '', 'g')), '') AS n, coalesce(CAST({number} AS VARCHAR), lower({t})) AS t, "
        f"CAST(expected_needs_review AS VARCHAR) AS e FROM {table} WHERE case_id IS NOT NULL"
    )
    order = "annotated_at DESC NULLS LAST, n DESC NULLS LAST, t DESC NULLS LAST, e DESC NULLS LAST"
    return f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY {order}) AS rn FROM ({rows})) WHERE rn = 1)"


def oracle_sql() -> dict[str, str]:
    both = "a JOIN c USING (case_id)"
    differs = " UNION ALL ".join(
        f"SELECT case_id, 'differs' AS difference, '{f}' AS field FROM {both} WHERE a.{k} IS DISTINCT FROM c.{k}" for f, k in zip(ANNOTATION_FIELDS, "nte")
    )
    return {
        "p5_found": f"WITH a AS {_side('annotations')}, c AS {_side('annotations_copy')} {differs} "
        "UNION ALL SELECT case_id, 'only_in_annotations', '' FROM a WHERE case_id NOT IN (SELECT case_id FROM c) UNION ALL SELECT case_id, 'only_in_copy', '' FROM c WHERE case_id NOT IN (SELECT case_id FROM a)"
    }
