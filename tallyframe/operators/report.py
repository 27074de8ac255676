"""The scoring report: metrics over all cases, groups by document type and model, thresholds, sheets and the summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.numbers import f1, ratio
from tallyframe.operators.scoring import group_percentile, tallies, weakest_fields, with_precision_recall
from tallyframe.schemas import NUMERIC_LINE_FIELDS

# Threshold keys, the metric each tests, and the direction.
THRESHOLDS = {
    "minimum_header_micro_accuracy": ("header_micro_accuracy", "min"), "minimum_line_recall": ("line_recall", "min"), "minimum_line_precision": ("line_precision", "min"),
    "minimum_numeric_accuracy": ("numeric_field_accuracy", "min"), "maximum_false_review_rate": ("false_review_rate", "max"), "maximum_missed_problem_rate": ("missed_problem_rate", "max"),
    "maximum_average_cost_per_invoice": ("average_cost", "max"), "maximum_average_runtime_seconds": ("average_runtime_seconds", "max"),
}
# The report's sheets in order.
SHEETS = ["Summary", "HeaderMetrics", "LineMetrics", "CaseResults", "LineMatches", "ReviewMetrics", "CostRuntime", "Errors"]


def report_metrics(results: DataFrame, header_cells: DataFrame, line_cells: DataFrame) -> DataFrame:
    """One row: the metrics over all cases. Rates of results rest on matched cases, costs and runtimes on all."""
    there = F.col("status") == "matched"
    n = lambda c: F.count_if(there & c)
    s = lambda c: F.coalesce(F.sum(F.when(there, F.col(c))), F.lit(0))
    line_p, line_r = ratio(s("lines_matched"), s("lines_actual")), ratio(s("lines_matched"), s("lines_expected"))
    tp, tn, fp, fn = (n(F.col("review_class") == c) for c in ("TP", "TN", "FP", "FN"))
    rev_p, rev_r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    cases = results.agg(
        F.count("*").alias("num_cases"), n(F.lit(True)).alias("matched_cases"), *[n(F.col("actual_outcome") == o).alias(f"outcome_{o}") for o in ("extracted", "needs_review", "failed")],
        ratio(n(F.col("exact_header_match")), n(F.lit(True))).alias("exact_header_match_rate"), ratio(n(F.col("required_complete")), n(F.lit(True))).alias("required_field_completeness"),
        line_p.alias("line_precision"), line_r.alias("line_recall"), f1(line_p, line_r).alias("line_f1"), ratio(n(F.col("all_lines_correct")), n(F.lit(True))).alias("invoice_all_lines_correct_rate"),
        tp.alias("review_tp"), tn.alias("review_tn"), fp.alias("review_fp"), fn.alias("review_fn"), rev_p.alias("review_precision"), rev_r.alias("review_recall"), f1(rev_p, rev_r).alias("review_f1"),
        ratio(fp, fp + tn).alias("false_review_rate"), ratio(fn, fn + tp).alias("missed_problem_rate"), F.bround(F.sum("reported_cost"), 6).alias("total_reported_cost"),
        F.sum("unknown_cost_requests").alias("unknown_cost_requests"), F.bround(F.avg("reported_cost"), 6).alias("average_cost"), F.bround(F.avg("runtime_seconds"), 3).alias("average_runtime_seconds"),
        s("lines_fuzzy").alias("fuzzy_line_matches"), F.count_if("passed").alias("passed_cases"),
    )
    by_field = tallies(header_cells, ["field"])
    header = by_field.agg(
        ratio(F.sum("correct"), F.sum("evaluated")).alias("header_micro_accuracy"), F.bround(F.avg(F.col("accuracy").cast("decimal(12,4)")), 4).cast("double").alias("header_macro_accuracy"),
        F.coalesce(F.sum("evaluated"), F.lit(0)).alias("header_cells_evaluated"))
    right, number = F.col("outcome") == "correct", F.col("field").isin(NUMERIC_LINE_FIELDS)
    of = lambda f: ratio(F.count_if(right & (F.col("field") == f)), F.count_if(F.col("field") == f)).alias(f"{f}_accuracy")
    lines = line_cells.agg(
        ratio(F.count_if(right), F.count("*")).alias("matched_line_field_accuracy"), ratio(F.count_if(right & number), F.count_if(number)).alias("numeric_field_accuracy"), of("description"), of("item_code"))
    one = F.lit(1).alias("_one")  # each side is one row
    return cases.select("*", one).join(header.select("*", one), "_one").join(lines.select("*", one), "_one").drop("_one")


def long_metrics(metrics: DataFrame) -> DataFrame:
    """(metric, value) of the one-row metrics, as numbers."""
    each = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in metrics.columns])
    return metrics.select(F.inline(each))


def threshold_results(metrics: DataFrame, thresholds: DataFrame) -> DataFrame:
    """(threshold, target, actual, passed, note): unknown keys and unavailable metrics fail, keys of two underscores are notes."""
    spec = F.create_map(*[x for k, (m, b) in THRESHOLDS.items() for x in (F.lit(k), F.struct(F.lit(m).alias("metric"), F.lit(b).alias("bound")))])
    wanted = thresholds.where(~F.col("key").startswith("__")).select("key", "target", F.try_element_at(spec, F.col("key")).alias("s")).select("key", "target", "s.metric", "s.bound")
    joined = wanted.join(long_metrics(metrics), "metric", "left")
    ok = F.when(F.col("bound") == "min", F.col("value") >= F.col("target")).otherwise(F.col("value") <= F.col("target"))
    note = F.when(F.col("bound").isNull(), "unknown threshold key").when(F.col("value").isNull(), "metric unavailable").otherwise("")
    return joined.select(F.col("key").alias("threshold"), "target", F.col("value").alias("actual"), F.coalesce(ok & F.col("bound").isNotNull(), F.lit(False)).alias("passed"), note.alias("note"))


def document_type_table(results: DataFrame) -> DataFrame:
    """By ``document_type``: cases, cost and runtime statistics, outcomes, lines a dollar and a minute."""
    there = F.col("status") == "matched"
    lines = F.coalesce(F.sum(F.when(there, F.col("lines_actual"))), F.lit(0)).cast("double")
    cost, runtime = F.sum("reported_cost"), F.sum("runtime_seconds")
    per = lambda total, factor: F.when(total > 0, F.bround(lines / (total * factor), 2))
    return results.groupBy("document_type").agg(
        F.count("*").alias("cases"), F.bround(F.avg("reported_cost"), 6).alias("avg_cost"), F.bround(F.median("reported_cost"), 6).alias("median_cost"), F.bround(F.avg("runtime_seconds"), 3).alias("avg_runtime"),
        F.bround(F.median("runtime_seconds"), 6).alias("median_runtime"), group_percentile(0.95, F.col("runtime_seconds")).alias("p95_runtime"),
        *[F.count_if(there & (F.col("actual_outcome") == o)).alias(o) for o in ("extracted", "needs_review", "failed")],
        per(cost, 1.0).alias("lines_per_dollar"), per(runtime, 1 / 60).alias("lines_per_minute"))


def case_errors(status: DataFrame, extra: DataFrame) -> DataFrame:
    """(case_id, file, category): cases without or with several results, and files with results but no case."""
    category = F.when(F.col("status") == "duplicate_result", F.concat(F.lit("duplicate_workbook_rows ("), F.col("n_results").cast("string"), F.lit(")"))).when(F.col("status") == "missing_result", "missing_workbook_result")
    return status.select("case_id", "file", category.alias("category")).where("category is not null").unionByName(
        extra.select(F.lit(None).cast("string").alias("case_id"), "file", F.lit("extra_workbook_source_file").alias("category")))


def cost_runtime_rows(results: DataFrame, types: DataFrame, models: DataFrame) -> DataFrame:
    """Cases, document types and models stacked under one set of columns."""
    case = results.select(F.lit("case").alias("scope"), F.col("case_id").alias("key"), "requests", "primary", "repair", "escalation", "total_tokens", "reported_cost", "unknown_cost_requests", "runtime_seconds", "runtime_basis")
    kind = types.select(F.lit("document_type").alias("scope"), F.col("document_type").alias("key"), F.col("cases").alias("requests"), F.col("avg_cost").alias("reported_cost"), F.col("avg_runtime").alias("runtime_seconds"), F.lit("avg").alias("runtime_basis"))
    model = models.select(F.lit("model").alias("scope"), F.col("model").alias("key"), "requests", "primary", "repair", "escalation", "total_tokens", "reported_cost", "unknown_cost_requests")
    return case.unionByName(kind, allowMissingColumns=True).unionByName(model, allowMissingColumns=True)


def sheets(results: DataFrame, header_cells: DataFrame, line_cells: DataFrame, matches: DataFrame, models: DataFrame, errors: DataFrame, thresholds: DataFrame) -> dict[str, DataFrame]:
    """The report's eight tables by sheet name; all exist even when empty."""
    metrics = report_metrics(results, header_cells, line_cells)
    header, lines = with_precision_recall(tallies(header_cells, ["field"])), tallies(line_cells, ["field"])
    text: Column = F.col("value").cast("string")
    weakest = weakest_fields(header, lines).select(F.concat(F.lit("weakest:"), "scope", F.lit("."), "field").alias("metric"), F.col("accuracy").cast("string").alias("value"))
    tested = threshold_results(metrics, thresholds).select(F.concat(F.lit("threshold:"), "threshold").alias("metric"), F.when(F.col("passed"), "PASS").otherwise("FAIL").alias("value"))
    review = results.where("status = 'matched'").select("case_id", "review_class", "review_categories", "unknown_clauses")
    return {
        "Summary": long_metrics(metrics).select("metric", text.alias("value")).unionByName(weakest).unionByName(tested), "HeaderMetrics": header.orderBy("field"), "LineMetrics": lines.orderBy("field"),
        "CaseResults": results.orderBy("case_id"), "LineMatches": matches, "ReviewMetrics": review.orderBy("case_id"), "CostRuntime": cost_runtime_rows(results, document_type_table(results), models), "Errors": errors,
    }
