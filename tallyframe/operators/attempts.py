"""Model answers as rows: envelopes read into columns, failures categorised, usage rows, requests and repairs built.

All of it is built-in expressions over a JSON text column, so a log of raw answers is read once
and stays in the JVM. Nulls and broken texts become a category, never an exception.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.operators.invoices import missing_required, parse_model_json, typed_from_variant
from tallyframe.schemas import HEADER_FIELDS, LINE_FIELDS

# Categories of the codes that an error envelope may carry.
ERROR_CODE_CATEGORIES = {402: "payment_required", 404: "model_unavailable", 408: "timeout", 429: "rate_limited"}
# Categories after which the same request may be sent again.
TRANSIENT_CATEGORIES = ["rate_limited", "server_error", "timeout", "transport"]
# Fixed value: the form of a model's id, vendor/model with an optional tag.
MODEL_ID = r"^[A-Za-z0-9._~-]+/[A-Za-z0-9._~:-]+\z"


def http_category(status: Column) -> Column:
    """Category of a failed request's status; null where there is no status or none of failure."""
    return F.when(status == 429, "rate_limited").when(status == 408, "timeout").when(status >= 500, "server_error").when(status >= 400, "client_error")


def is_transient(category: Column) -> Column:
    return F.coalesce(category.isin(TRANSIENT_CATEGORIES), F.lit(False))


def code_category(code: Column) -> Column:
    """Category of the whole number an error envelope carries; null and unknown numbers are a malformed envelope."""
    out = None
    for number, name in ERROR_CODE_CATEGORIES.items():
        out = F.when(code == number, name) if out is None else out.when(code == number, name)
    return out.when(code >= 500, "server_error").when(code >= 400, "client_error").otherwise("malformed_envelope")


def read_completions(raw: DataFrame, column: str = "raw") -> DataFrame:
    """The rows with ``answer`` (text, finish reasons, served model, id, tokens, cost), ``rejection`` and ``http_status``.

    ``rejection`` is null for a usable answer, else truncated, empty, the error's category or
    malformed_envelope; columns of these names are replaced. Tokens and cost are kept for answers that were cut off or empty.
    """
    v = F.try_parse_json(F.col(column))
    at = lambda path, kind: F.try_variant_get(F.col("_v"), path, kind)
    kind = lambda path: F.schema_of_variant(at(path, "variant"))
    code = F.when(kind("$.error.code").rlike("^(BIGINT|INT|TINYINT|SMALLINT)$"), at("$.error.code", "bigint"))
    is_error = F.coalesce(kind("$.error").startswith("OBJECT"), F.lit(False))
    has_choice = F.coalesce(kind("$.choices[0]").startswith("OBJECT"), F.lit(False))
    no_choices = at("$.choices[0]", "variant").isNull()
    content_kind = F.coalesce(kind("$.choices[0].message.content"), F.lit("VOID"))
    text = F.when(content_kind == "STRING", at("$.choices[0].message.content", "string")).otherwise(F.lit(""))
    answer = F.struct(
        text.alias("text"), at("$.model", "string").alias("actual_model"), at("$.id", "string").alias("generation_id"), at("$.choices[0].finish_reason", "string").alias("finish_reason"),
        at("$.choices[0].native_finish_reason", "string").alias("native_finish_reason"), at("$.usage.prompt_tokens", "bigint").alias("input_tokens"), at("$.usage.completion_tokens", "bigint").alias("output_tokens"),
        at("$.usage.completion_tokens_details.reasoning_tokens", "bigint").alias("reasoning_tokens"), at("$.usage.total_tokens", "bigint").alias("total_tokens"),
        at("$.usage.cost", "string").try_cast("decimal(28,10)").alias("cost_usd"))
    broken = ~F.coalesce(F.schema_of_variant(F.col("_v")).startswith("OBJECT"), F.lit(False)) | (~no_choices & ~has_choice) | ~content_kind.isin("STRING", "VOID")
    rejection = (
        F.when(no_choices & is_error, code_category(code)).when(no_choices | broken, "malformed_envelope")
        .when(at("$.choices[0].finish_reason", "string") == "length", "truncated").when(F.trim(text) == "", "empty")
    )
    # The variant is a column of its own, parsed once for all paths.
    staged = raw.withColumn("_v", v)
    own = [c for c in raw.columns if c not in ("rejection", "http_status", "answer")]
    read = staged.select(*own, rejection.alias("rejection"), F.when(no_choices & is_error, code).cast("int").alias("http_status"), answer.alias("_a"))
    unusable = F.coalesce(F.col("rejection") != "truncated", F.lit(False)) & F.coalesce(F.col("rejection") != "empty", F.lit(False))
    return read.withColumn("answer", F.when(~unusable, F.col("_a"))).drop("_a")


def finalised(answers: DataFrame, require_fields: Column | bool = True) -> DataFrame:
    """Read completions with their typed header; answers without an object or without the required fields are rejected.

    ``require_fields`` is false for answers that cover a part of a document only.
    """
    need = require_fields if isinstance(require_fields, Column) else F.lit(require_fields)
    parsed = answers.withColumn("_o", parse_model_json(F.col("answer.text")))
    typed = parsed.select("*", *[c for c in typed_from_variant(F.col("_o"))])
    gone = (
        F.when(F.col("rejection").isNotNull(), F.col("rejection")).when(F.col("_o").isNull(), "malformed_json")
        .when(need & (F.size(missing_required()) > 0), "missing_required_fields")
    )
    return typed.withColumn("rejection", gone).drop("_o")


def usage_rows(attempts: DataFrame) -> DataFrame:
    """The usage table of read attempts; rows without an answer have no tokens, no cost and no served model."""
    a = F.col("answer")
    return attempts.select(
        "run_id", "source_file", "route", "page_range", "attempt_type", "ladder_index", "requested_model", a["actual_model"].alias("actual_model"), "structured_mode",
        *[a[c].alias(c) for c in ("input_tokens", "output_tokens", "reasoning_tokens", "total_tokens", "cost_usd", "finish_reason", "native_finish_reason", "generation_id")],
        F.when(a.isNotNull(), F.col("latency_ms")).alias("latency_ms"), F.col("rejection").isNull().alias("accepted"), F.col("rejection").alias("rejection_category"), "http_status")


def model_id_problem(model: Column) -> Column:
    """empty or malformed; null for a good id."""
    return F.when(F.coalesce(F.trim(model), F.lit("")) == "", "empty").when(~model.rlike(MODEL_ID), "malformed")


def text_prompt(text: Column, pages: Column, part: Column | None = None) -> Column:
    """The extraction prompt over page-tagged text; ``part`` marks a request that sees a part of the document only."""
    fields = ", ".join(HEADER_FIELDS)
    head = F.lit(f"Extract the invoice as one JSON object with the fields {fields} and line_items, a list of objects with {', '.join(LINE_FIELDS)}. Use null for what the document does not state.")
    note = F.lit("") if part is None else F.when(part, F.concat(F.lit("\nThis is a part of the document, pages "), pages, F.lit("; fields it does not show are null."))).otherwise("")
    return F.concat(head, note, F.lit("\n\n"), text)


def repair_prompt(prompt: Column, answer: Column) -> Column:
    return F.concat(prompt, F.lit("\n\nThe answer below is not valid JSON. Return the same content as one valid JSON object and nothing else.\n\n"), answer)


def request_body(model: Column, prompt: Column, images: Column | None = None, mode: str = "json_object", max_tokens: int = 8192) -> Column:
    """The JSON body of a chat request; images are PNG contents that become data URLs in front of the prompt."""
    if mode not in ("json_schema", "json_object", "prompt_only"):
        raise ValueError(f"unknown structured mode {mode}")
    said = F.struct(F.lit("text").alias("type"), prompt.alias("text"), F.lit(None).cast("struct<url:string>").alias("image_url"))
    if images is None:
        content: Column = prompt
    else:
        shown = F.transform(images, lambda png: F.struct(F.lit("image_url").alias("type"), F.lit(None).cast("string").alias("text"), F.struct(F.concat(F.lit("data:image/png;base64,"), F.base64(png)).alias("url")).alias("image_url")))
        content = F.array_append(shown, said)
    parts = [model.alias("model"), F.lit(max_tokens).alias("max_tokens"), F.array(F.struct(F.lit("user").alias("role"), content.alias("content"))).alias("messages")]
    if mode == "json_object":
        parts.append(F.struct(F.lit("json_object").alias("type")).alias("response_format"))
    elif mode == "json_schema":
        schema = F.struct(F.lit("invoice").alias("name"), F.lit(True).alias("strict"))
        parts.append(F.struct(F.lit("json_schema").alias("type"), schema.alias("json_schema")).alias("response_format"))
    return F.to_json(F.struct(*parts))
