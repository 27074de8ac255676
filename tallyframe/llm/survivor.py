"""Best representative of each duplicate group (problem 6).

Rows of the same file and page set form a group. Their fields are unpivoted to long rows; each
row votes for its normalised value with source trust times recency decay, ``max_by`` picks the
winner of each field, and the winners are pivoted back to one surviving invoice.

A recency decay is a common factor within a group, so votes are weighted against a fixed date
and no group maximum has to be joined first. Votes combine map-side by (group, field, value),
so a group with a third of all rows is spread over its values before it meets in one row.

Defined results: a null file or null page list belongs to no group; an empty page list is a set
of its own. Blanks and placeholders are empty and never win. A null time weighs least, an
unknown or null provider is trusted least. Equal votes go to the greater value by code point.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.numbers import let
from tallyframe.functions.text import basename, collapse_key, strip
from tallyframe.schemas import HEADER_FIELDS

HEADER = HEADER_FIELDS

# What people and programs write into a field that states nothing.
PLACEHOLDERS = [
    "", "-", "--", "---", "–", "—", ".", "..", "...", "?", "??", "???", "_", "/", "x", "xx", "xxx", "#n/a", "n/a", "na", "n.a.", "n.a", "n/v",
    "none", "(none)", "null", "(null)", "nil", "nan", "unknown", "(unknown)", "unk", "not stated", "not given", "not available", "not specified",
    "not provided", "not applicable", "not found", "missing", "no data", "empty", "(empty)", "blank", "tbd", "t.b.d.", "tba", "to be determined",
    "undefined", "unspecified", "unbekannt", "k.a.", "k. a.", "ka", "keine angabe", "keine angaben", "nicht angegeben", "entfällt", "inconnu",
    "non précisé", "non renseigné", "n.c.", "desconocido", "sin datos", "s/d", "no indicado", "no consta",
]


def is_stated(col: Column) -> Column:
    """True where the text states something; false for null, blanks and placeholders, also slightly mistyped long ones."""

    def states(text: Column) -> Column:
        mistyped = F.lit(False)
        for word in ("unknown", "not stated"):
            close = (F.char_length(text) >= len(word) - 2) & (F.char_length(text) <= len(word) + 2)
            mistyped |= F.when(close, F.levenshtein(text, F.lit(word)) <= 2).otherwise(False)
        return F.coalesce(~(text.isin(PLACEHOLDERS) | mistyped), F.lit(False))

    return let(F.lower(strip(col)), states)


def best_representatives(routes: DataFrame, trust: DataFrame, half_life_days: float = 90.0) -> DataFrame:
    """One row a group: file_key, pages, n_rows, provider, the surviving ``invoice`` and ``undisputed_route_id``.

    ``undisputed_route_id`` is the row that no other row of its group beats in time, in trust
    or in a filled header field (the smallest id of several); null where there is none.
    ``trust`` has a handful of rows; its size is left to the planner's own threshold.
    """
    ranks = trust.select(F.lower(strip(F.col("provider"))).alias("_p"), "trust_rank").groupBy("_p").agg(F.min("trust_rank").alias("_rank"))
    days = (F.unix_micros(F.col("extracted_at").cast("timestamp")) / 86_400_000_000) - F.lit(18262.0)
    items = F.col("invoice")["line_items"]
    # One array of the stated header fields, its expressions built once for all fields.
    raw = F.array(*[F.struct(F.lit(1 << i).alias("bit"), F.lit(f).alias("field"), F.col("invoice")[f].alias("raw")) for i, f in enumerate(HEADER)])
    rows = (
        routes.select("route_id", "source_file", "pages", "provider", "extracted_at", "invoice")
        .where(F.col("source_file").isNotNull() & F.col("pages").isNotNull())
        .withColumn("_stated", F.filter(raw, lambda e: is_stated(e["raw"])))
        .withColumn("_p", F.lower(strip(F.col("provider"))))
        .join(ranks, "_p", "left")
        .select(
            F.lower(strip(basename(strip(F.col("source_file"))))).alias("file_key"),
            F.array_sort(F.array_distinct("pages")).alias("page_set"),
            F.coalesce("_rank", F.lit(2147483647)).alias("_rank"),
            "route_id", "_p", "provider", F.col("extracted_at").cast("timestamp").alias("_at"), "_stated", items.alias("_items"),
            F.aggregate("_stated", F.lit(0), lambda acc, e: acc.bitwiseOR(e["bit"])).alias("_mask"),
            F.pow(F.lit(2.0), F.greatest(F.lit(-500.0), F.least(F.lit(500.0), F.coalesce(days / half_life_days, F.lit(-500.0))))
                  - F.coalesce(F.col("_rank") - 1.0, F.lit(60.0))).alias("_w"),
        )
    )
    entry = lambda field, norm, value: F.struct(field.alias("field"), norm.alias("norm"), value.alias("raw"))
    fields = F.transform("_stated", lambda e: entry(e["field"], collapse_key(e["raw"]), e["raw"]))
    lines = F.to_json("_items")
    others = F.filter(F.array(
        F.when(F.size("_items") > 0, entry(F.lit("line_items"), lines, lines)),
        F.when(F.col("_p").isNotNull(), entry(F.lit("provider"), F.col("_p"), F.col("_p"))),
        entry(F.lit(""), F.col("route_id").cast("string"), F.lit("")),
    ), lambda x: x.isNotNull())
    group = ["file_key", "page_set"]
    long = rows.select(
        *group, "_w", "_at", "_rank", "_mask", "route_id",
        F.inline(F.concat(fields, others)),
    )
    # The row itself is one more long row (field ''), so that groups are judged in the same pass.
    row = F.when(F.col("field") == "", F.struct("_at", (-F.col("_rank")).alias("nrank"), F.bit_count("_mask").alias("filled"), (-F.col("route_id")).alias("nid"), "_mask"))
    votes = long.groupBy(*group, "field", "norm").agg(
        F.bround(F.log2(F.sum("_w")), 6).alias("_votes"),
        F.max_by("raw", F.struct("_w", "raw")).alias("_raw"),
        F.max(row).alias("_row"), F.min("_rank").alias("_best_rank"), F.bit_or("_mask").alias("_any"), F.count("*").alias("_n"),
    )

    def winner(name: str) -> Column:
        mine = F.col("field") == name
        return F.max_by(F.when(mine, F.col("_raw")), F.when(mine, F.struct("_votes", "norm")))

    own = F.col("field") == ""
    merged = votes.groupBy(*group).agg(
        F.sum(F.when(own, F.col("_n"))).alias("n_rows"),
        F.max("_row").alias("_top"), F.min("_best_rank").alias("_best_rank"), F.bit_or(F.when(own, F.col("_any"))).alias("_any"),
        winner("provider").alias("provider"), winner("line_items").alias("_items"),
        *[winner(f).alias(f) for f in HEADER],
    ).where("n_rows >= 2")
    top = F.col("_top")
    undisputed = (-top["nrank"] == F.col("_best_rank")) & (top["_mask"] == F.col("_any"))
    kind = routes.schema["invoice"].dataType["line_items"].dataType
    return merged.select(
        "file_key", F.col("page_set").alias("pages"), "n_rows", "provider",
        F.struct(*HEADER, F.coalesce(F.from_json("_items", kind), F.array().cast(kind)).alias("line_items")).alias("invoice"),
        F.when(undisputed, -top["nid"]).alias("undisputed_route_id"),
    )
