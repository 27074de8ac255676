"""Invoice normalisation, validation and export rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.numbers import coerce_decimal
from tallyframe.functions.text import blank_to_null, normalize_currency, outer_braces, strip_code_fence
from tallyframe.schemas import HEADER_FIELDS, LINE_FIELDS, MONEY_FIELDS, NUMERIC_LINE_FIELDS, REQUIRED_FIELDS


def latest_delivery(invoices: DataFrame) -> DataFrame:
    """One row an invoice_id: the latest delivered; repeated deliveries combine map-side."""
    rest = [c for c in invoices.columns if c not in ("invoice_id", "ingested_at")]
    best = F.max_by(F.struct(*rest), F.struct(F.col("ingested_at"), F.to_json(F.struct(*[c for c in rest if c != "extracted_at"]))))
    return invoices.groupBy("invoice_id").agg(best.alias("_r"), F.max("ingested_at").alias("ingested_at")).select("invoice_id", "_r.*", "ingested_at")


def typed_header(invoices: DataFrame) -> DataFrame:
    """Header fields stripped to null, amounts as decimals, currency in its normal form."""
    out = {f: blank_to_null(F.col(f)) for f in HEADER_FIELDS}
    out |= {f: coerce_decimal(F.col(f)) for f in MONEY_FIELDS}
    out["currency"] = normalize_currency(F.col("currency"))
    return invoices.withColumns(out)


def typed_lines(lines: DataFrame) -> DataFrame:
    out = {f: blank_to_null(F.col(f)) for f in LINE_FIELDS}
    out |= {f: coerce_decimal(F.col(f)) for f in NUMERIC_LINE_FIELDS}
    return lines.withColumns(out)


def missing_required() -> Column:
    """Names of the required fields that are null, in declared order."""
    return F.filter(F.array(*[F.when(F.col(f).isNull(), F.lit(f)) for f in REQUIRED_FIELDS]), lambda x: x.isNotNull())


def missing_identifier() -> Column:
    return F.coalesce("invoice_number", "po_number", "reference").isNull()


def line_totals(lines: DataFrame) -> DataFrame:
    """By invoice: lines, lines without amount, sum of the amounts (null if there is none), places of lines without amount."""
    return lines.groupBy("invoice_id").agg(
        F.count("*").alias("n_lines"), F.count_if(F.col("amount").isNull()).alias("n_without_amount"), F.sum("amount").alias("line_sum"),
        F.array_sort(F.collect_set(F.when(F.col("amount").isNull(), F.col("line_number")))).alias("suspicious_rows"),
    )


def reconciles(abs_tol: str = "0.02", rel_tol: str = "0.005") -> Column:
    """True if any of the three rules holds; null unless a line amount and the total are known.

    Rules: lines + tax = total; lines = total; subtotal + tax = total and lines = subtotal. Each
    disjunct falls through to the next on null.
    """
    total, tax, sub, lines = (F.col(c) for c in ("total_amount", "tax_amount", "subtotal", "line_sum"))
    tol = F.greatest(F.lit(abs_tol).cast("decimal(28,10)"), F.lit(rel_tol).cast("decimal(8,6)") * F.abs(total))
    false = F.lit(False)
    by_tax = F.coalesce(F.abs(lines + tax - total) <= tol, false)
    plain = F.coalesce(F.abs(lines - total) <= tol, false)
    by_sub = F.coalesce((F.abs(sub + F.coalesce(tax, F.lit(0)) - total) <= tol) & (F.abs(lines - sub) <= tol), false)
    return F.when(lines.isNotNull() & total.isNotNull(), by_tax | plain | by_sub)


def validated(invoices: DataFrame, lines: DataFrame) -> DataFrame:
    """Invoices (typed) left-joined to their line totals, with the reasons for review in fixed order."""
    joined = invoices.join(line_totals(lines), "invoice_id", "left").withColumn("reconciled", reconciles())
    none = F.coalesce(F.col("n_lines"), F.lit(0)) == 0
    reasons = F.array(
        F.when(F.size(missing_required()) > 0, "missing_required_fields"),
        F.when(missing_identifier(), "missing_identifier"),
        F.when(none, "no_line_items"),
        F.when(F.coalesce(F.col("n_without_amount"), F.lit(0)) > 0, "suspicious_line"),
        F.when(~none & F.col("line_sum").isNull(), "no_line_amounts"),
        F.when(F.col("reconciled") == F.lit(False), "totals_inconclusive"),
    )
    return joined.withColumn("reasons", F.filter(reasons, lambda x: x.isNotNull()))


def parse_model_json(col: Column) -> Column:
    """Variant of an object in a model's answer: as it is, without a code fence, or its outermost braces; else null."""
    def is_object(v: Column) -> Column:
        return F.when(F.schema_of_variant(v).startswith("OBJECT"), v)

    direct = is_object(F.try_parse_json(strip_code_fence(col)))
    return F.coalesce(direct, is_object(F.try_parse_json(outer_braces(col))))


def typed_from_variant(v: Column) -> list[Column]:
    """Header columns of a parsed answer: numbers bypass the cleaning of printed amounts, booleans and containers are null."""
    out = []
    for f in HEADER_FIELDS:
        raw = F.try_variant_get(v, f"$.{f}", "variant")
        kind = F.schema_of_variant(raw)
        scalar = ~kind.rlike("^(OBJECT|ARRAY|BOOLEAN|VOID)")
        text = F.when(scalar, F.try_variant_get(v, f"$.{f}", "string"))
        if f in MONEY_FIELDS:
            out.append(F.when(kind == "STRING", coerce_decimal(text)).when(scalar, text.try_cast("decimal(28,10)")).alias(f))
        else:
            out.append((normalize_currency(text) if f == "currency" else blank_to_null(text)).alias(f))
    return out


def unknown_keys(col: Column) -> Column:
    """Top-level keys of a JSON object outside the schema, sorted."""
    keys = F.json_object_keys(col)
    return F.array_sort(F.array_except(keys, F.array(*[F.lit(k) for k in [*HEADER_FIELDS, "line_items"]])))
