"""Page scans as tables: classification, routes, chunks, ranges, tagged text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions.text import alnum_count, page_ranges


def page_kind(alnum: Column, has_picture: Column, threshold: int = 50) -> Column:
    """``text`` above the threshold, else ``image`` with a picture or any letter or digit, else ``blank``."""
    return F.when(alnum > threshold, "text").when(has_picture | (alnum > 0), "image").otherwise("blank")


def classify_pages(pages: DataFrame, threshold: int = 50) -> DataFrame:
    counted = pages.withColumn("alnum", alnum_count(F.col("text")))
    return counted.select(
        "page_id", "source_file", "number", "alnum",
        page_kind(F.col("alnum"), F.coalesce(F.col("kind") == "image", F.lit(False)), threshold).alias("page_kind"),
    )


def document_class(kind: Column) -> Column:
    """Aggregate over a file's page kinds; a file of blank pages alone is an ``error``."""
    text, image = F.bool_or(kind == "text"), F.bool_or(kind == "image")
    return F.when(text & image, "mixed").when(text, "text-native").when(image, "image-only").otherwise("error")


def classify_documents(pages: DataFrame) -> DataFrame:
    kind = F.col("kind")
    return pages.groupBy("source_file").agg(
        document_class(kind).alias("document_class"), F.count_if(kind == "text").alias("n_text"),
        F.count_if(kind == "image").alias("n_image"), F.count_if(kind == "blank").alias("n_blank"),
    )


def route_pages(pages: DataFrame) -> DataFrame:
    """Distinct page numbers of each file by route (text, image, blank), as ranges."""
    def route(kind: str) -> Column:
        return page_ranges(F.collect_set(F.when(F.col("kind") == kind, F.col("number"))))

    return pages.groupBy("source_file").agg(*[route(k).alias(f"{k}_pages") for k in ("text", "image", "blank")])


def page_chunks(pages: DataFrame, size: int) -> DataFrame:
    """Ordered chunks of at most ``size`` distinct pages of each file and kind.

    The position within a file comes from one sort a file, bounded by its page count.
    """
    if size <= 0:
        raise ValueError("chunk size must be positive")
    once = pages.where("number is not null").groupBy("source_file", "kind", "number").agg(F.min("page_id").alias("page_id"))
    at = Window.partitionBy("source_file", "kind").orderBy("number")
    numbered = once.withColumn("chunk", F.floor((F.row_number().over(at) - 1) / size).cast("int"))
    return numbered.groupBy("source_file", "kind", "chunk").agg(F.array_sort(F.collect_list("number")).alias("pages"))


def chunk_counts(pages: DataFrame, text_size: int, vision_size: int) -> DataFrame:
    """Chunks a file needs by route: ceil(distinct pages / size)."""
    n = lambda kind: F.count_distinct(F.when(F.col("kind") == kind, F.col("number")))
    return pages.groupBy("source_file").agg(
        F.ceil(n("text") / text_size).cast("long").alias("text_chunks"), F.ceil(n("image") / vision_size).cast("long").alias("vision_chunks")
    )


def attempt_estimate(chunks: DataFrame, text_models: int, vision_models: int, cap: int | None, retries: int) -> DataFrame:
    """Upper bound of requests: models tried a chunk, capped a file, with one repair and the retries each."""
    models = F.col("text_chunks") * text_models + F.col("vision_chunks") * vision_models
    capped = models if cap is None else F.least(models, F.lit(cap))
    return chunks.agg(F.count("*").alias("n_files"), F.sum(capped).cast("long").alias("n_models"), F.sum(capped * 2 * retries).cast("long").alias("max_attempts"))


def tagged_text(pages: DataFrame) -> DataFrame:
    """Text pages of a file in page order, each under its page mark."""
    text = pages.where((F.col("kind") == "text") & F.col("text").isNotNull() & F.col("number").isNotNull())
    entry = F.struct("number", "page_id", "text")
    return text.groupBy("source_file").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(entry)), lambda p: F.concat(F.lit("--- PAGE "), p["number"].cast("string"), F.lit(" ---\n"), p["text"])), "\n\n"
        ).alias("tagged")
    )
