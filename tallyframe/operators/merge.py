"""Merging the route results of one file into one invoice, with conflicts and de-duplicated lines.

Routes are ordered by their first page (then their sequence), and the closing route is the one
that reaches the greatest page. Everything is expressed as grouped aggregates over long rows with
an explicit order column; no window holds a file, so a file with very many routes combines
map-side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.numbers import coerce_decimal
from tallyframe.functions.text import basename, blank_to_null, collapse_key, page_ranges, strip
from tallyframe.schemas import HEADER_FIELDS, MONEY_FIELDS

GATEWAY = "openrouter"  # fixed value: the provider name of the gateway in the tables


def ordered_routes(routes: DataFrame) -> DataFrame:
    """Routes with a file key and ``_first`` / ``_last`` order structs; rows without file or pages are left out."""
    return (
        routes.where(F.col("source_file").isNotNull() & (F.size("pages") > 0) & F.col("invoice").isNotNull())
        .withColumn("file_key", F.lower(strip(basename(strip(F.col("source_file"))))))
        .withColumn("_first", F.struct(F.array_min("pages").alias("p"), F.col("route_seq").alias("s"), F.col("route_id").alias("r")))
        .withColumn("_last", F.struct(F.array_max("pages").alias("p"), (-F.col("route_seq")).alias("s"), (-F.col("route_id")).alias("r")))
    )


def merge_headers(routes: DataFrame) -> DataFrame:
    """(file_key, field, value, n_values, conflict): the chosen value of each stated header field.

    One normalised value: its first occurrence. Several: amounts take the value of the closing
    route, else the last one stated; other fields the first one stated.
    """
    # Unpivoted first, so that the rules are generated code over one column.
    raw = F.array(*[F.struct(F.lit(f).alias("field"), F.col("invoice")[f].alias("raw")) for f in HEADER_FIELDS])
    ordered = ordered_routes(routes)
    closing = ordered.groupBy("file_key").agg(F.max("_last").alias("_closing"))
    money = F.col("field").isin(MONEY_FIELDS)
    long = (
        ordered.select("file_key", "_first", "_last", F.inline(raw)).where(F.col("raw").isNotNull())
        .withColumn("value", F.when(money, coerce_decimal(F.col("raw")).cast("string")).otherwise(blank_to_null(F.col("raw"))))
        .where(F.col("value").isNotNull())
        .withColumn("norm", F.when(money, F.col("value")).otherwise(collapse_key(F.col("value")))).drop("raw")
    )
    marked = long.join(closing, "file_key").withColumn("_at_end", F.col("_last") == F.col("_closing"))
    grouped = marked.groupBy("file_key", "field").agg(
        F.min_by("value", "_first").alias("first"), F.max_by("value", "_first").alias("last"),
        F.max(F.when(F.col("_at_end"), F.col("value"))).alias("closing"), F.count_distinct("norm").alias("n_values"),
    )
    conflict = F.col("n_values") > 1
    chosen = F.when(conflict & F.col("field").isin(MONEY_FIELDS), F.coalesce("closing", "last")).otherwise(F.col("first"))
    return grouped.select("file_key", "field", chosen.alias("value"), "n_values", conflict.alias("conflict"))


def header_conflicts(routes: DataFrame) -> DataFrame:
    """By file: conflicting fields in declared order and whether several invoices seem to share the file."""
    order = F.array(*[F.lit(f) for f in HEADER_FIELDS])
    named = merge_headers(routes).where("conflict").groupBy("file_key").agg(F.collect_set("field").alias("_f"))
    return named.select(
        "file_key", F.array_join(F.array_intersect(order, F.col("_f")), ",").alias("fields"), F.array_contains("_f", "invoice_number").alias("several_invoices")
    )


def merged_lines(routes: DataFrame) -> DataFrame:
    """All lines in route order, each with ``kept``: a later route's fully stated line is dropped if an equal one came before.

    The first route keeps all its lines. A key's first place is a grouped minimum that is joined
    back, in place of a window over the file.
    """
    ordered = ordered_routes(routes)
    opening = ordered.groupBy("file_key").agg(F.min("_first").alias("_opening"))
    lines = ordered.select("file_key", "_first", F.posexplode("invoice.line_items").alias("pos", "item"))
    amounts = {c: coerce_decimal(F.col("item")[c]) for c in ("quantity", "unit_price", "amount")}
    described = blank_to_null(F.col("item")["description"])
    rows = lines.select("file_key", "_first", "pos", described.alias("description"), *[v.alias(c) for c, v in amounts.items()])
    key = ["file_key", "_norm", "quantity", "unit_price", "amount"]
    rows = rows.withColumn("_norm", collapse_key(F.col("description")))
    full = F.col("description").isNotNull() & F.col("quantity").isNotNull() & F.col("unit_price").isNotNull() & F.col("amount").isNotNull()
    firsts = rows.where(full).groupBy(*key).agg(F.min(F.struct("_first", "pos")).alias("_seen"))
    out = rows.join(firsts, key, "left").join(opening, "file_key")
    kept = F.coalesce((F.col("_first") == F.col("_opening")) | (F.struct("_first", "pos") == F.col("_seen")), F.lit(True)) | ~full
    return out.select(
        "file_key", F.col("_first.p").alias("first_page"), F.col("_first.s").alias("route_seq"), F.col("_first.r").alias("route_id"), "pos",
        "description", "quantity", "unit_price", "amount", kept.alias("kept"),
    )


def provider_labels(routes: DataFrame) -> DataFrame:
    """By file: providers and models in route order without repeats, joined by ``+`` (several gateway models: ``multiple``), and all pages."""
    ordered = ordered_routes(routes)

    def in_order(col: Column) -> Column:
        return F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("_first", col.alias("v")))), lambda x: x["v"]))

    g = ordered.withColumn("_p", F.lower(strip(F.col("provider")))).groupBy("file_key").agg(
        F.count("*").alias("n_routes"), in_order(F.col("_p")).alias("_ps"), in_order(F.col("model")).alias("_ms"),
        page_ranges(F.flatten(F.collect_list("pages"))).alias("pages"),
    )
    models = F.filter("_ms", lambda m: m.isNotNull())
    providers = F.filter("_ps", lambda p: p.isNotNull())
    gateway = F.size(F.array_except(providers, F.array(F.lit(GATEWAY)))) == 0
    return g.select(
        "file_key", "n_routes", F.array_join(providers, "+").alias("provider"),
        F.when(gateway & (F.size(models) > 1), "multiple").otherwise(F.array_join(models, "+")).alias("model"), "pages",
    )
