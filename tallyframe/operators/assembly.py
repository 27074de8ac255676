"""Files put together from pages and routes: coverage, method, provider, model, failed pages, reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.text import page_ranges
from tallyframe.operators.merge import header_conflicts, ordered_routes, provider_labels
from tallyframe.operators.pages import document_class


def file_pages(pages: DataFrame) -> DataFrame:
    """By file: pages, their class, and the distinct page numbers of each kind."""
    kind = F.col("kind")
    of = lambda k: F.collect_set(F.when(kind == k, F.col("number"))).alias(f"_{k}")
    return pages.where("source_file is not null").groupBy(F.lower("source_file").alias("file_key")).agg(
        F.count_distinct("number").alias("page_count"), document_class(kind).alias("document_class"), of("text"), of("image"), of("blank"))


def assemble_files(pages: DataFrame, routes: DataFrame) -> DataFrame:
    """One row a file with pages: class, method, provider, model, covered and failed pages, and why it needs review.

    Pages with text or pictures that no route covers have failed. A file without any route is an
    error: blank if it has no meaningful page, else failed on all models. Reasons are codes in
    fixed order.
    """
    ordered = ordered_routes(routes)
    methods = ordered.groupBy("file_key").agg(
        F.array_join(F.array_sort(F.collect_set("route")), "+").alias("_m"), F.count_distinct("route").alias("_nm"), F.array_distinct(F.flatten(F.collect_set("pages"))).alias("_covered"))
    labels = provider_labels(routes).select("file_key", F.col("provider").alias("_providers"), F.col("model").alias("_model"))
    conflicts = header_conflicts(routes).select("file_key", "fields", "several_invoices")
    found = file_pages(pages).join(methods, "file_key", "left").join(labels, "file_key", "left").join(conflicts, "file_key", "left")
    none = F.array().cast("array<int>")
    covered = F.coalesce("_covered", none)
    failed = F.array_except(F.concat("_text", "_image"), covered)
    error = F.col("_m").isNull()
    several = F.contains(F.col("_providers"), F.lit("+"))
    reasons: Column = F.array_compact(F.array(
        F.when(error & (F.col("document_class") == "error"), "blank_document"), F.when(error & (F.col("document_class") != "error"), "provider_failure"),
        F.when(~error & (F.size(failed) > 0), "partial_extraction"), F.when(F.col("fields").isNotNull(), "header_conflict"), F.when(F.col("several_invoices"), "invoice_number_conflict")))
    return found.select(
        "file_key", "page_count", "document_class", F.when(error, "failed").when(F.col("_nm") > 1, "mixed").otherwise(F.col("_m")).alias("method"),
        F.when(several, "mixed").otherwise(F.col("_providers")).alias("provider"), "_model", page_ranges("_text").alias("text_pages"), page_ranges("_image").alias("image_pages"), page_ranges("_blank").alias("blank_pages"),
        page_ranges(failed).alias("failed_pages"), error.alias("error"), F.array_join(reasons, "; ").alias("reasons"), (F.size(reasons) > 0).alias("needs_review")).withColumnRenamed("_model", "model")


def skipped_by_budget(chunks: DataFrame, admitted: DataFrame) -> DataFrame:
    """(file, kind, pages): the pages of chunks that no admitted attempt reached, one row and one reason a route.

    ``chunks`` has file, kind, chunk and pages, ``admitted`` file, kind and chunk.
    """
    rest = chunks.join(admitted.select("file", "kind", "chunk").distinct(), ["file", "kind", "chunk"], "left_anti")
    return rest.groupBy("file", "kind").agg(page_ranges(F.flatten(F.collect_list("pages"))).alias("pages")).withColumn("reason", F.lit("budget_exhausted"))


def run_summary(files: DataFrame, usage: DataFrame) -> DataFrame:
    """One row: the safe counts of a run over its file results and its usage."""
    flag = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    results = files.agg(
        F.count("*").alias("files_processed"), F.count_if(F.col("method") != "failed").alias("extracted"), flag(F.col("needs_review")).alias("needs_review"), flag(F.col("error")).alias("failed"),
        *[F.count_if(F.col("method") == m).alias(f"method_{m}") for m in ("text", "vision", "mixed", "failed")], F.count_if(F.col("document_class") == "mixed").alias("class_mixed"))
    requests = usage.agg(
        F.count("*").alias("requests"), F.count_if(F.col("attempt_type") == "repair").alias("repairs"), F.count_if(F.col("attempt_type") == "escalation").alias("escalations"),
        F.coalesce(F.sum("cost_usd").cast("double"), F.lit(0.0)).alias("reported_cost"), F.count_if(F.col("cost_usd").isNull()).alias("unknown_cost_requests"))
    one = F.lit(1).alias("_one")  # each side is one row
    return results.select("*", one).join(requests.select("*", one), "_one").drop("_one")


def run_metadata(files: DataFrame, usage: DataFrame) -> DataFrame:
    """The safe fields of each file for a run's metadata: no reasons, no values of the invoice."""
    cost = usage.groupBy(F.lower("source_file").alias("file_key")).agg(
        F.count("*").alias("request_count"), F.sum("cost_usd").cast("double").alias("reported_cost"), F.count_if(F.col("cost_usd").isNull()).alias("unknown_cost_count"))
    zero = lambda c, v: F.coalesce(c, F.lit(v)).alias(c)
    return files.join(cost, "file_key", "left").select(
        F.col("file_key").alias("source_file"), F.col("method").alias("extraction_method"), "provider", "model", "needs_review", "error", (~F.col("error")).alias("completed"),
        zero("request_count", 0), zero("reported_cost", 0.0), zero("unknown_cost_count", 0))
