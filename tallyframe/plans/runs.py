"""Queries of model attempts, file assembly, run metadata, exports and job retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.functions import numbers, text
from tallyframe.operators import assembly, attempts, usage, validation
from tallyframe.operators import pages as page_ops
from tallyframe.plans.reference import _ATTEMPTS, _CASES, _GATED, _KEY, _dec, _null, _strip
from tallyframe.plans.reference import _attempts as _event_attempts
from tallyframe.plans.scores import _USAGE as _USAGE_CTE
from tallyframe.plans.scores import _cases, _usage
from tallyframe.session import read_table
from tallyframe.sinks.tables import export_tables

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# ---- Raw answers: one envelope a route, of ten shapes by its id ----------------------------------


def _envelopes(spark: SparkSession, d: str) -> DataFrame:
    r, kind = F.col("route_id"), F.col("route_id") % 10
    fields = [F.col(f"invoice.{f}").alias(f) for f in ("invoice_number", "invoice_date", "currency", "seller_name", "total_amount")]
    body = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    content = F.when(kind == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(kind == 2, F.lit("no json here")).when(kind == 3, F.lit("  ")).when(kind == 4, F.left(body, F.length(body) - 1)).otherwise(body)
    choice = F.struct(F.when(kind == 5, "length").otherwise("stop").alias("finish_reason"), F.struct(content.alias("content")).alias("message"))
    tokens = F.struct((r % 900).alias("prompt_tokens"), (r % 70).alias("completion_tokens"), (r % 970).alias("total_tokens"), F.when(r % 7 != 0, (r % 997) / 1000).alias("cost"))
    good = F.to_json(F.struct(F.concat(F.lit("gen-"), r).alias("id"), F.concat("model", F.lit("-b")).alias("model"), F.array(choice).alias("choices"), tokens.alias("usage")))
    code = F.when(r % 20 == 6, 429).when(r % 20 == 16, 402).when(r % 20 == 7, 503).otherwise(418)
    error = F.format_string('{"error": {"code": %d, "message": "x"}}', code)
    raw = F.when(kind.isin(6, 7), error).when(kind == 8, F.lit('{"error": {"code": true}}')).when(kind == 9, F.when(r % 20 == 9, F.lit("not json")).otherwise(F.lit('{"choices": []}'))).otherwise(good)
    return read_table(spark, d, "route_results").where("invoice is not null").select("route_id", "source_file", "route", "pages", "model", "invoice", raw.alias("raw"))


_REJECTION = (
    "CASE WHEN route_id % 20 = 6 THEN 'rate_limited' WHEN route_id % 20 = 16 THEN 'payment_required' WHEN route_id % 20 = 7 THEN 'server_error' WHEN route_id % 20 = 17 THEN 'client_error' "
    "WHEN route_id % 10 IN (8, 9) THEN 'malformed_envelope' WHEN route_id % 10 = 5 THEN 'truncated' WHEN route_id % 10 = 3 THEN 'empty' END"
)
_STATUS = "CASE WHEN route_id % 20 = 6 THEN 429 WHEN route_id % 20 = 16 THEN 402 WHEN route_id % 20 = 7 THEN 503 WHEN route_id % 20 = 17 THEN 418 END"
_ANSWERED = "route_id % 10 < 6"
_COST = "CASE WHEN route_id % 7 <> 0 THEN route_id % 997 / 1000.0 END"


@query(
    f"SELECT route_id, {_REJECTION} AS rejection, {_STATUS} AS http_status, CASE WHEN {_ANSWERED} THEN model || '-b' END AS actual_model, CASE WHEN {_ANSWERED} THEN route_id % 970 END AS total_tokens, "
    f"CASE WHEN {_ANSWERED} THEN CAST({_COST} AS DOUBLE) END AS cost FROM route_results WHERE invoice IS NOT NULL"
)
def q_completions(spark, d):
    read = attempts.read_completions(_envelopes(spark, d))
    return read.select("route_id", "rejection", "http_status", F.col("answer.actual_model").alias("actual_model"), F.col("answer.total_tokens").alias("total_tokens"), F.col("answer.cost_usd").cast("double").alias("cost"))


_MISSING = f"({_null('invoice.invoice_date')} IS NULL OR {_null('invoice.currency')} IS NULL OR {_null('invoice.seller_name')} IS NULL OR {_dec('invoice.total_amount')} IS NULL)"
_FINAL = f"CASE WHEN {_REJECTION} IS NOT NULL THEN {_REJECTION} WHEN route_id % 10 IN (2, 4) THEN 'malformed_json' WHEN {_MISSING} THEN 'missing_required_fields' END"


@query(f"SELECT route_id, {_FINAL} AS rejection, {_FINAL} IS NULL AS accepted FROM route_results WHERE invoice IS NOT NULL")
def q_attempt_finalise(spark, d):
    done = attempts.finalised(attempts.read_completions(_envelopes(spark, d).drop("invoice")))
    return done.select("route_id", "rejection", F.col("rejection").isNull().alias("accepted"))


@query(
    f"SELECT source_file, route, requested_model, coalesce(rejection_category, '') AS rejection_category, count(*) AS n, count(*) FILTER (WHERE accepted) AS accepted, CAST(sum(total_tokens) AS BIGINT) AS total_tokens, CAST(sum(cost) AS DOUBLE) AS cost FROM "
    f"(SELECT source_file, route, model AS requested_model, {_FINAL} AS rejection_category, {_FINAL} IS NULL AS accepted, CASE WHEN {_ANSWERED} THEN route_id % 970 END AS total_tokens, CASE WHEN {_ANSWERED} THEN {_COST} END AS cost FROM route_results WHERE invoice IS NOT NULL) GROUP BY ALL"
)
def q_usage_rows(spark, d):
    done = attempts.finalised(attempts.read_completions(_envelopes(spark, d).drop("invoice")))
    named = done.select("*", F.lit("run").alias("run_id"), text.page_ranges(F.col("pages")).alias("page_range"), F.lit("primary").alias("attempt_type"), F.lit(0).alias("ladder_index"),
                        F.col("model").alias("requested_model"), F.lit("json_object").alias("structured_mode"), F.lit(1.0).alias("latency_ms"))
    rows = attempts.usage_rows(named).withColumn("rejection_category", F.coalesce("rejection_category", F.lit("")))
    return rows.groupBy("source_file", "route", "requested_model", "rejection_category").agg(
        F.count("*").alias("n"), F.count_if("accepted").alias("accepted"), F.sum("total_tokens").alias("total_tokens"), F.sum("cost_usd").cast("double").alias("cost"))


@query(
    "SELECT status, CASE WHEN status = 429 THEN 'rate_limited' WHEN status = 408 THEN 'timeout' WHEN status >= 500 THEN 'server_error' WHEN status >= 400 THEN 'client_error' END AS category, "
    "status = 429 OR status = 408 OR status >= 500 AS transient FROM (SELECT DISTINCT CAST(200 + route_id % 400 AS INTEGER) AS status FROM route_results)"
)
def q_http_categories(spark, d):
    rows = read_table(spark, d, "route_results").select((F.col("route_id") % 400 + 200).cast("int").alias("status")).distinct()
    category = attempts.http_category(F.col("status"))
    return rows.select("status", category.alias("category"), attempts.is_transient(category).alias("transient"))


@query(
    "SELECT id, CASE WHEN trim(coalesce(id, '')) = '' THEN 'empty' WHEN NOT regexp_full_match(id, '[A-Za-z0-9._~-]+/[A-Za-z0-9._~:-]+') THEN 'malformed' END AS problem FROM "
    "(SELECT DISTINCT CASE CAST(route_id % 4 AS INTEGER) WHEN 0 THEN model WHEN 1 THEN trim(lower(provider)) || '/' || model WHEN 2 THEN 'a/' || model || ':free' ELSE '' END AS id FROM route_results)"
)
def q_model_ids(spark, d):
    k = F.col("route_id") % 4
    made = F.when(k == 0, F.col("model")).when(k == 1, F.concat(F.trim(F.lower("provider")), F.lit("/"), F.col("model"))).when(k == 2, F.concat(F.lit("a/"), "model", F.lit(":free"))).otherwise("")
    ids = read_table(spark, d, "route_results").select(made.alias("id")).distinct()
    return ids.select("id", attempts.model_id_problem(F.col("id")).alias("problem"))


@query(
    "SELECT source_file, length(tagged) AS text_length, 'user' AS role, 'json_object' AS mode, md5(tagged) AS digest FROM (SELECT source_file, string_agg('--- PAGE ' || number || ' ---' || chr(10) || text, chr(10) || chr(10) ORDER BY number, page_id) AS tagged "
    "FROM page_infos WHERE kind = 'text' AND text IS NOT NULL AND number IS NOT NULL GROUP BY 1)"
)
def q_request_bodies(spark, d):
    """Requests of the tagged texts; what the body says is read back from its JSON."""
    tagged = page_ops.tagged_text(read_table(spark, d, "page_infos"))
    prompt = attempts.text_prompt(F.col("tagged"), F.lit("1"))
    body = tagged.select("source_file", "tagged", F.char_length(prompt).alias("_n"), attempts.request_body(F.lit("a/b"), prompt).alias("body"))
    said = F.get_json_object("body", "$.messages[0].content")
    rest = F.right(said, F.char_length("tagged"))
    return body.select("source_file", F.char_length(rest).cast("bigint").alias("text_length"), F.get_json_object("body", "$.messages[0].role").alias("role"), F.get_json_object("body", "$.response_format.type").alias("mode"), F.md5(rest).alias("digest"))


# ---- Files ----------------------------------------------------------------------------------

_FILES = (
    f"WITH r AS (SELECT *, {_KEY} AS fk FROM route_results WHERE source_file IS NOT NULL AND len(pages) > 0 AND invoice IS NOT NULL), p AS (SELECT lower(source_file) AS fk, kind, number FROM page_infos WHERE source_file IS NOT NULL), "
    "f AS (SELECT fk, count(DISTINCT number) AS page_count, CASE WHEN bool_or(kind = 'text') AND bool_or(kind = 'image') THEN 'mixed' WHEN bool_or(kind = 'text') THEN 'text-native' WHEN bool_or(kind = 'image') THEN 'image-only' ELSE 'error' END AS document_class FROM p GROUP BY 1), "
    "m AS (SELECT fk, count(DISTINCT route) AS nm, min(route) AS route FROM r GROUP BY 1), c AS (SELECT DISTINCT fk, unnest(pages) AS number FROM r), "
    "x AS (SELECT fk, count(*) AS n_failed FROM (SELECT DISTINCT fk, number FROM p WHERE kind IN ('text', 'image') AND number IS NOT NULL) q WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.fk = q.fk AND c.number = q.number) GROUP BY 1), "
    "o AS (SELECT f.fk AS file_key, page_count, document_class, CASE WHEN m.fk IS NULL THEN 'failed' WHEN nm > 1 THEN 'mixed' ELSE route END AS method, m.fk IS NULL AS error, coalesce(n_failed, 0) AS n_failed FROM f LEFT JOIN m ON m.fk = f.fk LEFT JOIN x ON x.fk = f.fk) "
)


def _results(spark: SparkSession, d: str) -> DataFrame:
    return assembly.assemble_files(read_table(spark, d, "page_infos"), read_table(spark, d, "route_results"))


@query(_FILES + "SELECT file_key, page_count, document_class, method, error, n_failed > 0 AND NOT error AS partial FROM o")
def q_file_results(spark, d):
    return _results(spark, d).select("file_key", "page_count", "document_class", "method", "error", F.contains("reasons", F.lit("partial_extraction")).alias("partial"))


@query(_FILES + "SELECT method, document_class, count(*) AS n, count(*) FILTER (WHERE error) AS n_failed FROM o GROUP BY ALL")
def q_by_method(spark, d):
    return _results(spark, d).groupBy("method", "document_class").agg(F.count("*").alias("n"), F.count_if("error").alias("n_failed"))


@query(
    _FILES + ", " + _USAGE_CTE + ", u AS (SELECT count(*) AS requests, count(*) FILTER (WHERE attempt_type = 'repair') AS repairs, count(*) FILTER (WHERE attempt_type = 'escalation') AS escalations, CAST(sum(cost_usd) AS DOUBLE) AS reported_cost, count(*) FILTER (WHERE cost_usd IS NULL) AS unknown_cost_requests FROM usage) "
    "SELECT count(*) AS files_processed, count(*) FILTER (WHERE method <> 'failed') AS extracted, count(*) FILTER (WHERE error) AS failed, " + ", ".join(f"count(*) FILTER (WHERE method = '{m}') AS method_{m}" for m in ("text", "vision", "mixed", "failed"))
    + ", count(*) FILTER (WHERE document_class = 'mixed') AS class_mixed, any_value(u.requests) AS requests, any_value(u.repairs) AS repairs, any_value(u.escalations) AS escalations, any_value(u.reported_cost) AS reported_cost, any_value(u.unknown_cost_requests) AS unknown_cost_requests FROM o, u"
)
def q_run_summary(spark, d):
    return assembly.run_summary(_results(spark, d), _usage(spark, d)).drop("needs_review")


@query(
    _FILES + ", " + _USAGE_CTE + ", g AS (SELECT lower(source_file) AS file_key, count(*) AS n, CAST(sum(cost_usd) AS DOUBLE) AS c, count(*) FILTER (WHERE cost_usd IS NULL) AS k FROM usage GROUP BY 1) "
    "SELECT file_key AS source_file, method AS extraction_method, error, NOT error AS completed, coalesce(n, 0) AS request_count, coalesce(c, 0) AS reported_cost, coalesce(k, 0) AS unknown_cost_count FROM o LEFT JOIN g USING (file_key)"
)
def q_run_metadata(spark, d):
    return assembly.run_metadata(_results(spark, d), _usage(spark, d)).drop("provider", "model", "needs_review")


@query(
    f"WITH {_ATTEMPTS}{_GATED}, ch AS (SELECT DISTINCT file, chunk FROM att), sk AS (SELECT file, chunk FROM ch WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.file = ch.file AND f.chunk = ch.chunk)) "
    "SELECT file, count(*) AS n_pages, string_agg(chunk + 1, ',' ORDER BY chunk) AS listed FROM sk GROUP BY 1"
)
def q_skipped_chunks(spark, d):
    """Chunks that a file's budgets left out; each chunk of the log stands for one page."""
    made = _event_attempts(spark, d)
    admitted = usage.gate_files(usage.climb_ladder(made), 4, "60").select("file", F.lit("text").alias("kind"), "chunk")
    chunks = made.select("file", F.lit("text").alias("kind"), "chunk").distinct().withColumn("pages", F.array(F.col("chunk") * 1 + 1))
    skipped = assembly.skipped_by_budget(chunks, admitted)
    each = skipped.select("file", F.regexp_replace(F.regexp_replace("pages", "1-3", "1,2,3"), "(1)-(2)|(2)-(3)", "$1$3,$2$4").alias("listed"))
    return each.select("file", F.size(F.split("listed", ",")).cast("bigint").alias("n_pages"), "listed")


# ---- Exports and validation -------------------------------------------------------------------

_BAD = f"(SELECT route_id, string_agg(pos, ', ' ORDER BY pos) AS line_numbers, string_agg(coalesce({_null('it.description')}, '(no description)'), '; ' ORDER BY pos) AS line_descriptions FROM (SELECT route_id, unnest(invoice.line_items) AS it, generate_subscripts(invoice.line_items, 1) AS pos FROM route_results WHERE invoice IS NOT NULL) WHERE {_dec('it.amount')} IS NULL GROUP BY 1)"


@query(f"SELECT * FROM {_BAD}")
def q_suspicious_lines(spark, d):
    """Places and descriptions of the lines without amount, as the review table shows them."""
    rows = read_table(spark, d, "route_results").where("invoice is not null")
    return validation.suspicious_lines(rows.select("route_id", F.posexplode("invoice.line_items").alias("pos", "it")).select("route_id", (F.col("pos") + 1).alias("line_number"), "it.*"), "route_id")


@query(
    "WITH n AS (SELECT *, row_number() OVER (ORDER BY source_file, route_id) AS k FROM route_results WHERE source_file IS NOT NULL AND invoice IS NOT NULL) "
    f"SELECT printf('INV-%04d', k) AS invoice_id, source_file, invoice.invoice_number AS invoice_number, CAST({_dec('invoice.total_amount')} AS DOUBLE) AS total_amount, len(coalesce(invoice.line_items, [])) AS n_lines, route_id % 3 = 0 AS in_review FROM n"
)
def q_export_tables(spark, d):
    """The three export tables of the routes, joined again by their ids."""
    inv = F.col("invoice")
    typed = inv.withField("total_amount", numbers.coerce_decimal(inv["total_amount"]))
    rows = read_table(spark, d, "route_results").where("source_file is not null and invoice is not null").select(
        "source_file", F.col("route_id").alias("tie"), typed.alias("invoice"), (F.col("route_id") % 3 == 0).alias("needs_review"), F.lit("r").alias("review_reason"))
    tables = export_tables(rows, ["source_file", "tie"])
    n = tables["LineItems"].groupBy("invoice_id").agg(F.count("*").alias("n_lines"))
    flagged = tables["NeedsReview"].select("invoice_id", F.lit(True).alias("_r"))
    out = tables["Invoices"].join(n, "invoice_id", "left").join(flagged, "invoice_id", "left")
    return out.select("invoice_id", "source_file", "invoice_number", "total_amount", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), F.coalesce("_r", F.lit(False)).alias("in_review"))


_VIOLATED = (
    f"WITH {_CASES}, li AS (SELECT case_id, unnest(line_items) AS it, generate_subscripts(line_items, 1) - 1 AS pos FROM cases), kv AS (SELECT case_id, pos, unnest(map_keys(it)) AS k, unnest(map_values(it)) AS v FROM li) "
    "SELECT case_id, 'line_items[' || pos || '].' || k AS field, 'unsupported_field' AS violation FROM kv WHERE k NOT IN ('line_no', 'item_code', 'description', 'quantity', 'unit_price', 'amount', 'hs_code', 'unit', 'uom', 'currency') "
    "UNION ALL SELECT case_id, 'line_items[' || pos || '].' || k, 'not_a_decimal' FROM kv WHERE k IN ('quantity', 'unit_price', 'amount') AND v IS NOT NULL AND NOT regexp_full_match(v, '\\s*[+-]?(\\d+(\\.\\d*)?|\\.\\d+)([eE][+-]?\\d+)?\\s*') "
    f"UNION ALL SELECT case_id, 'line_items[' || pos || '].' || k, 'duplicate_' || k FROM (SELECT *, row_number() OVER (PARTITION BY case_id, k, replace(lower({_strip('v')}), 'ß', 'ss') ORDER BY pos) AS rn FROM kv WHERE k IN ('line_no', 'item_code') AND v <> '') WHERE rn > 1"
)


@query(_VIOLATED)
def q_line_violations(spark, d):
    return validation.line_violations(_cases(spark, d))


@query("SELECT user_id AS job_id, age_h, CASE WHEN user_id = 1 THEN 'kept_active' WHEN age_h >= 24 THEN 'expired' ELSE 'kept' END AS verdict FROM (SELECT user_id, round_even(date_diff('second', coalesce(max(ts) FILTER (WHERE event_type = 'purchase'), min(ts)), TIMESTAMP '2024-02-01 00:00:00') / 3600.0, 4) AS age_h FROM events GROUP BY 1)")
def q_retention(spark, d):
    """Age of each job from its end, else its beginning, and whether it may be removed; the active job never is."""
    now = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    e = read_table(spark, d, "events").groupBy(F.col("user_id").alias("job_id")).agg(F.max(F.when(F.col("event_type") == "purchase", F.col("ts"))).alias("finished"), F.min("ts").alias("created"))
    return validation.job_verdicts(e, now, 24.0, F.lit(1))


@query()
def q_norm_string_nfkc(spark, d):
    """Comparison keys of the names; DuckDB has no compatibility normalisation, so there is no SQL."""
    names = read_table(spark, d, "invoices").select("seller_name").distinct()
    return names.select("seller_name", text.scored_text(F.col("seller_name")).alias("as_text"), text.scored_identifier(F.col("seller_name")).alias("as_identifier"))
