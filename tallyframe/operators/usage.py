"""Usage accounting, and the replay of model ladders and budgets over candidate attempts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.operators.numbering import global_row_number, global_running_sum


def usage_summary(usage: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Requests, types, tokens (null counts 0), cost (null counts 0) and requests of unknown cost, in all or by columns.

    Every type but primary and repair counts as escalation.
    """
    kind = F.col("attempt_type")
    measures = [
        F.count("*").alias("requests"),
        F.count_if(F.col("accepted")).alias("accepted"),
        F.count_if(kind == "primary").alias("n_primary"),
        F.count_if(kind == "repair").alias("n_repair"),
        F.count_if(~kind.isin("primary", "repair")).alias("n_escalation"),
        F.sum(F.coalesce("total_tokens", F.lit(0))).alias("tokens"),
        F.sum(F.coalesce("cost_usd", F.lit(0).cast("decimal(28,10)"))).cast("double").alias("cost"),
        F.count_if(F.col("cost_usd").isNull()).alias("unknown_cost"),
    ]
    return (usage.groupBy(*by) if by else usage).agg(*measures)


def average_cost(usage: DataFrame) -> DataFrame:
    """Cost a file, 0 when there is none."""
    cost = F.sum(F.coalesce("cost_usd", F.lit(0).cast("decimal(28,10)")))
    return usage.agg(
        F.count_distinct("source_file").alias("n_files"),
        F.bround(F.coalesce(F.try_divide(cost.cast("double"), F.count_distinct("source_file")), F.lit(0.0)), 6).alias("average_cost"),
    )


def model_table(usage: DataFrame) -> DataFrame:
    """By served model, else the requested one: requests by type, acceptance, tokens, cost, latency, and which of the two names were used."""
    stated = F.nullif(F.col("actual_model"), F.lit(""))
    basis = F.when(stated.isNotNull(), "actual_model").otherwise("requested_model")
    rows = usage.withColumns({"_model": F.coalesce(stated, F.nullif(F.col("requested_model"), F.lit(""))), "_basis": basis}).where("_model is not null")
    return rows.groupBy(F.col("_model").alias("model")).agg(
        F.array_join(F.array_sort(F.collect_set("_basis")), "+").alias("model_basis"), F.count("*").alias("requests"), *[F.count_if(F.col("attempt_type") == k).alias(k) for k in ("primary", "repair", "escalation")],
        F.count_if(F.col("accepted")).alias("accepted"), F.sum(F.coalesce("total_tokens", F.lit(0))).alias("total_tokens"),
        F.sum(F.coalesce("cost_usd", F.lit(0).cast("decimal(28,10)"))).cast("double").alias("reported_cost"), F.count_if(F.col("cost_usd").isNull()).alias("unknown_cost_requests"),
    )


def attempt_counts(usage: DataFrame) -> DataFrame:
    """By file: requests in all and of each type; other types count in the total only."""
    return usage.groupBy("source_file").agg(F.count("*").alias("total"), *[F.count_if(F.col("attempt_type") == k).alias(k) for k in ("primary", "repair", "escalation")])


def cost_summary(usage: DataFrame) -> DataFrame:
    """One row: files, requests, cost and its average a file, null unless a request reported a cost, and whether some did not."""
    cost, n, files = F.sum("cost_usd"), F.count("*"), F.count_distinct("source_file")
    unknown = F.count_if(F.col("cost_usd").isNull())
    there = (n > 0) & (unknown < n)
    return usage.agg(
        files.alias("files"), n.alias("requests"), unknown.alias("unknown_cost_requests"), there.alias("available"), F.when(there, cost.cast("double")).alias("total"),
        F.when(there & (files > 0), F.bround(cost.cast("double") / files, 6)).alias("average"), (there & (unknown > 0)).alias("incomplete"))


def format_usage_summary(usage: DataFrame) -> str:
    """The usage figures as text; two small aggregates reach the driver, one row and one row a model."""
    total = usage_summary(usage).first()
    lines = [
        f"Requests: {total['requests']} (primary {total['n_primary']}, repair {total['n_repair']}, escalation {total['n_escalation']})",
        f"Accepted: {total['accepted']}, rejected: {total['requests'] - total['accepted']}", f"Tokens: {total['tokens'] or 0}",
        f"Cost (USD): {total['cost'] or 0}" + (f", incomplete: {total['unknown_cost']} without cost" if total["unknown_cost"] else ""),
    ]
    by_model = usage_summary(usage, ["requested_model"]).orderBy("requested_model").toLocalIterator()
    return "\n".join([*lines, *(f"  {r['requested_model']}: {r['accepted']} accepted, cost {r['cost']}" for r in by_model)])


def in_run_order(usages: list[DataFrame]) -> DataFrame:
    """Usage rows of several runs or files one after the other, numbered in that order (``seq``)."""
    parts = [u.withColumn("_part", F.lit(n)).withColumn("_at", F.monotonically_increasing_id()) for n, u in enumerate(usages)]
    rows = parts[0]
    for other in parts[1:]:
        rows = rows.unionByName(other)
    return global_row_number(rows, [F.col("_part").asc(), F.col("_at").asc()], "seq").drop("_part", "_at")


def climb_ladder(attempts: DataFrame) -> DataFrame:
    """Attempts that a ladder makes: models up to the first accepted one of each chunk, repairs only after malformed primaries."""
    chunk = ["file", "chunk"]
    stop = attempts.where("accepted").groupBy(*chunk).agg(F.min("model_idx").alias("_stop"))
    malformed = attempts.where("k = 0").groupBy(*chunk, "model_idx").agg(F.bool_or("malformed").alias("_malformed"))
    return (
        attempts.join(stop, chunk, "left").join(malformed, [*chunk, "model_idx"], "left")
        .where((F.col("_stop").isNull() | (F.col("model_idx") <= F.col("_stop"))) & ((F.col("k") == 0) | F.coalesce("_malformed", F.lit(False))))
        .drop("_stop", "_malformed")
    )


def gate_files(attempts: DataFrame, cap: int | None, cost_limit: str | None) -> DataFrame:
    """Attempts that a file's budgets admit, in order of chunk, model and repair.

    The counter of models rises before an attempt, so the repair of the last admitted model is
    blocked. A running sum needs a file's attempts in order; their number is bounded by its
    chunks and models.
    """
    order = Window.partitionBy("file").orderBy("chunk", "model_idx", "k")
    models = F.sum((F.col("k") == 0).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    spent = F.coalesce(F.sum(F.coalesce("cost", F.lit(0).cast("decimal(28,10)"))).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = attempts.withColumn("models_at", models).withColumn("spent_before", spent.cast("decimal(38,10)"))
    admitted: Column = F.lit(True)
    if cap is not None:
        admitted &= F.when(F.col("k") == 0, F.col("models_at") <= cap).otherwise(F.col("models_at") < cap)
    if cost_limit is not None:
        admitted &= F.col("spent_before") < F.lit(cost_limit).cast("decimal(28,10)")
    return out.where(admitted)


def gate_run(attempts: DataFrame, cost_limit: str) -> DataFrame:
    """Attempts made before the run's cost limit is reached, over all files in order."""
    order = [F.col("file").asc(), F.col("chunk").asc(), F.col("model_idx").asc(), F.col("k").asc()]
    spent = global_running_sum(attempts, order, "cost", "run_spent_before")
    return spent.where(F.col("run_spent_before") < F.lit(cost_limit).cast("decimal(28,10)"))
