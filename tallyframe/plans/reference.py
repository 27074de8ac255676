"""Queries over the domain tables, one or more for each operator family, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.functions import numbers, text
from tallyframe.operators import invoices as inv
from tallyframe.operators import linkage, merge, numbering, pages, scoring, usage
from tallyframe.schemas import HEADER_FIELDS, LINE_FIELDS, MONEY_FIELDS
from tallyframe.session import read_table

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if it can be said in SQL."""

    def add(f):
        Q[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# ---- SQL building blocks -------------------------------------------------------------------


def _strip(c: str) -> str:
    return f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"


def _null(c: str) -> str:
    return f"nullif({_strip(c)}, '')"


def _dec(c: str) -> str:
    t = _strip(c)
    k = f"regexp_replace({t}, '[^0-9.,\\-]', '', 'g')"
    plain = (
        f"CASE WHEN contains({k}, ',') AND contains({k}, '.') AND strpos(reverse({k}), ',') < strpos(reverse({k}), '.') "
        f"THEN replace(replace({k}, '.', ''), ',', '.') "
        f"WHEN contains({k}, ',') AND contains({k}, '.') THEN replace({k}, ',', '') "
        f"WHEN regexp_full_match({k}, '-?\\d*,\\d{{1,2}}') THEN replace({k}, ',', '.') ELSE replace({k}, ',', '') END"
    )
    n = f"TRY_CAST(nullif({plain}, '') AS DECIMAL(28,10))"
    return f"(CASE WHEN regexp_full_match({t}, '\\(.*\\)') AND {n} > 0 THEN -{n} ELSE {n} END)"


def _norm(c: str) -> str:
    return f"lower({_strip(f'''regexp_replace({c}, '\\s+', ' ', 'g')''')})"


def _base(c: str) -> str:
    return f"regexp_extract(replace({c}, '\\', '/'), '([^/]*)$', 1)"


def _currency(c: str) -> str:
    t = _null(c)
    return f"CASE WHEN {t} = '€' THEN 'EUR' WHEN {t} = '£' THEN 'GBP' WHEN regexp_full_match({t}, '\\p{{L}}{{3}}') THEN upper({t}) ELSE {t} END"


_KEY = _strip(f"lower({_base(_strip('source_file'))})")

# One row an invoice: the latest delivery (repeated deliveries carry the same header).
_CUR = "SELECT *, row_number() OVER (PARTITION BY invoice_id ORDER BY ingested_at DESC NULLS LAST, extracted_at DESC NULLS LAST) AS rn FROM invoices"
_INV = (
    "SELECT invoice_id, " + ", ".join(f"{_dec(f) if f in MONEY_FIELDS else _currency(f) if f == 'currency' else _null(f)} AS {f}" for f in HEADER_FIELDS)
    + f" FROM ({_CUR}) WHERE rn = 1"
)
_LIN = "SELECT invoice_id, line_number, " + ", ".join(f"{_dec(f) if f in ('quantity', 'unit_price', 'amount') else _null(f)} AS {f}" for f in LINE_FIELDS) + " FROM line_items"


def _invoices(spark: SparkSession, d: str) -> DataFrame:
    return inv.typed_header(inv.latest_delivery(read_table(spark, d, "invoices").select("invoice_id", "ingested_at", *HEADER_FIELDS)))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return inv.typed_lines(read_table(spark, d, "line_items"))


# ---- Reconciliation and validation ----------------------------------------------------------

_TOTALS = (
    f"WITH inv AS ({_INV}), lin AS ({_LIN}), tot AS (SELECT invoice_id, count(*) AS n_lines, count(*) FILTER (WHERE amount IS NULL) AS n_null, sum(amount) AS s FROM lin GROUP BY 1), "
    "j AS (SELECT inv.*, coalesce(n_lines, 0) AS n_lines, coalesce(n_null, 0) AS n_null, s, greatest(0.02, 0.005 * abs(total_amount)) AS tol FROM inv LEFT JOIN tot USING (invoice_id)), "
    "r AS (SELECT *, CASE WHEN s IS NOT NULL AND total_amount IS NOT NULL THEN coalesce(abs(s + tax_amount - total_amount) <= tol, false) OR coalesce(abs(s - total_amount) <= tol, false) "
    "OR coalesce(abs(subtotal + coalesce(tax_amount, 0) - total_amount) <= tol AND abs(s - subtotal) <= tol, false) END AS ok FROM j) "
)


@query(_TOTALS + "SELECT invoice_id, n_lines, CAST(s AS DOUBLE) AS line_sum, CAST(total_amount AS DOUBLE) AS total, ok AS reconciled FROM r WHERE ok IS DISTINCT FROM true")
def q_flagship_reconcile(spark, d):
    rows = inv.validated(_invoices(spark, d), _lines(spark, d)).where(~F.coalesce("reconciled", F.lit(False)))
    return rows.select("invoice_id", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), F.col("line_sum").cast("double"), F.col("total_amount").cast("double").alias("total"), "reconciled")


@query(
    _TOTALS + "SELECT invoice_id, concat_ws(';', CASE WHEN invoice_date IS NULL OR currency IS NULL OR seller_name IS NULL OR total_amount IS NULL THEN 'missing_required_fields' END, "
    "CASE WHEN coalesce(invoice_number, po_number, reference) IS NULL THEN 'missing_identifier' END, CASE WHEN n_lines = 0 THEN 'no_line_items' END, CASE WHEN n_null > 0 THEN 'suspicious_line' END, "
    "CASE WHEN n_lines > 0 AND s IS NULL THEN 'no_line_amounts' END, CASE WHEN ok = false THEN 'totals_inconclusive' END) AS reasons FROM r"
)
def q_review_reasons(spark, d):
    return inv.validated(_invoices(spark, d), _lines(spark, d)).select("invoice_id", F.array_join("reasons", ";").alias("reasons"))


@query(
    f"WITH inv AS ({_INV}) SELECT invoice_id, concat_ws(',', CASE WHEN invoice_date IS NULL THEN 'invoice_date' END, CASE WHEN currency IS NULL THEN 'currency' END, "
    "CASE WHEN seller_name IS NULL THEN 'seller_name' END, CASE WHEN total_amount IS NULL THEN 'total_amount' END) AS missing, coalesce(invoice_number, po_number, reference) IS NULL AS no_identifier FROM inv"
)
def q_missing_required(spark, d):
    return _invoices(spark, d).select("invoice_id", F.array_join(inv.missing_required(), ",").alias("missing"), inv.missing_identifier().alias("no_identifier"))


@query(f"WITH lin AS ({_LIN}) SELECT invoice_id, string_agg(DISTINCT line_number, ',' ORDER BY line_number) AS rows FROM lin WHERE amount IS NULL AND line_number IS NOT NULL GROUP BY 1")
def q_suspicious_rows(spark, d):
    found = inv.line_totals(_lines(spark, d)).where(F.size("suspicious_rows") > 0)
    return found.select("invoice_id", F.array_join("suspicious_rows", ",").alias("rows"))


# ---- Scalars --------------------------------------------------------------------------------


@query(f"SELECT DISTINCT amount AS raw, CAST({_dec('amount')} AS DOUBLE) AS value FROM line_items UNION SELECT DISTINCT total_amount, CAST({_dec('total_amount')} AS DOUBLE) FROM invoices")
def q_decimal_coercion(spark, d):
    raw = read_table(spark, d, "line_items").select(F.col("amount").alias("raw")).union(read_table(spark, d, "invoices").select("total_amount")).distinct()
    return raw.select("raw", numbers.coerce_decimal(F.col("raw")).cast("double").alias("value"))


@query(f"SELECT invoice_id, {_currency('currency')} AS code, {_null('po_number')} AS po, {_null('payment_terms')} AS terms, count(*) AS n FROM invoices GROUP BY ALL")
def q_currency_normalise(spark, d):
    rows = read_table(spark, d, "invoices")
    return rows.groupBy(
        "invoice_id", text.normalize_currency(F.col("currency")).alias("code"), text.blank_to_null(F.col("po_number")).alias("po"), text.blank_to_null(F.col("payment_terms")).alias("terms")
    ).agg(F.count("*").alias("n"))


@query(f"SELECT DISTINCT source_file, {_base('source_file')} AS base, left(CASE WHEN x = '' THEN 'file' ELSE x END, 76) || '.pdf' AS safe FROM (SELECT source_file, regexp_replace(regexp_replace(regexp_replace({_base('source_file')}, '(?i)\\.pdf$', ''), '[^A-Za-z0-9._-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g') AS x FROM route_results WHERE source_file IS NOT NULL)")
def q_file_names(spark, d):
    rows = read_table(spark, d, "route_results").select("source_file").where("source_file is not null").distinct()
    return rows.select("source_file", text.basename(F.col("source_file")).alias("base"), text.sanitize_filename(F.col("source_file")).alias("safe"))


@query(f"SELECT doc_id, CASE WHEN length(f) > 80 THEN left(f, 80) || '...[truncated]' ELSE f END AS flat FROM (SELECT doc_id, {_strip('''regexp_replace(text, '[\\s]+', ' ', 'g')''')} AS f FROM documents WHERE regexp_full_match(text, '[\\x00-\\x7f]*'))")
def q_flatten_truncate(spark, d):
    rows = read_table(spark, d, "documents").where(F.col("text").rlike(r"^[\x00-\x7f]*\z"))
    return rows.select("doc_id", text.flatten_truncate(F.col("text"), 80).alias("flat"))


@query()
def q_flatten_truncate_all(spark, d):
    """Every document; the query above keeps to ASCII texts, where DuckDB's blanks are the same."""
    return read_table(spark, d, "documents").select("doc_id", text.flatten_truncate(F.col("text"), 80).alias("flat"))


# ---- Pages ----------------------------------------------------------------------------------


@query(
    "SELECT page_id, source_file, number, alnum, CASE WHEN alnum > 50 THEN 'text' WHEN coalesce(kind = 'image', false) OR alnum > 0 THEN 'image' ELSE 'blank' END AS page_kind "
    "FROM (SELECT *, CAST(length(regexp_replace(coalesce(text, ''), '[^\\p{L}\\p{N}]', '', 'g')) AS INTEGER) AS alnum FROM page_infos)"
)
def q_page_classify(spark, d):
    return pages.classify_pages(read_table(spark, d, "page_infos"))


@query(
    "SELECT source_file, CASE WHEN t > 0 AND i > 0 THEN 'mixed' WHEN t > 0 THEN 'text-native' WHEN i > 0 THEN 'image-only' ELSE 'error' END AS document_class, t AS n_text, i AS n_image, b AS n_blank FROM "
    "(SELECT source_file, count(*) FILTER (WHERE kind = 'text') AS t, count(*) FILTER (WHERE kind = 'image') AS i, count(*) FILTER (WHERE kind = 'blank') AS b FROM page_infos GROUP BY 1)"
)
def q_document_classify(spark, d):
    return pages.classify_documents(read_table(spark, d, "page_infos"))


def _chunk_sql(size: int) -> str:
    return (
        f"SELECT source_file, kind, chunk, string_agg(number, ',' ORDER BY number) AS pages FROM (SELECT *, CAST(floor((row_number() OVER (PARTITION BY source_file, kind ORDER BY number) - 1) / {size}) AS INTEGER) AS chunk "
        "FROM (SELECT DISTINCT source_file, kind, number FROM page_infos WHERE number IS NOT NULL)) GROUP BY 1, 2, 3"
    )


@query(_chunk_sql(2))
def q_page_chunks_2(spark, d):
    return pages.page_chunks(read_table(spark, d, "page_infos"), 2).withColumn("pages", F.array_join("pages", ","))


@query(_chunk_sql(5))
def q_page_chunks_5(spark, d):
    return pages.page_chunks(read_table(spark, d, "page_infos"), 5).withColumn("pages", F.array_join("pages", ","))


_COUNTS = "SELECT source_file, CAST(ceil(count(DISTINCT number) FILTER (WHERE kind = 'text') / 2.0) AS BIGINT) AS text_chunks, CAST(ceil(count(DISTINCT number) FILTER (WHERE kind = 'image') / 5.0) AS BIGINT) AS vision_chunks FROM page_infos GROUP BY 1"


@query(_COUNTS)
def q_chunk_plan_counts(spark, d):
    return pages.chunk_counts(read_table(spark, d, "page_infos"), 2, 5)


@query(f"SELECT count(*) AS n_files, CAST(sum(least(3 * text_chunks + 2 * vision_chunks, 12)) AS BIGINT) AS n_models, CAST(sum(least(3 * text_chunks + 2 * vision_chunks, 12) * 6) AS BIGINT) AS max_attempts FROM ({_COUNTS})")
def q_attempt_estimate(spark, d):
    return pages.attempt_estimate(pages.chunk_counts(read_table(spark, d, "page_infos"), 2, 5), 3, 2, 12, 3)


def _ranges(kind: str) -> str:
    return (
        f"(SELECT source_file, string_agg(r, ',' ORDER BY lo) AS {kind}_pages FROM (SELECT source_file, lo, CASE WHEN lo = hi THEN CAST(lo AS VARCHAR) ELSE lo || '-' || hi END AS r FROM "
        f"(SELECT source_file, min(number) AS lo, max(number) AS hi FROM (SELECT source_file, number, number - row_number() OVER (PARTITION BY source_file ORDER BY number) AS g FROM "
        f"(SELECT DISTINCT source_file, number FROM page_infos WHERE kind = '{kind}' AND number IS NOT NULL)) GROUP BY source_file, g)) GROUP BY 1) AS {kind}_r"
    )


@query(
    "SELECT f.source_file, coalesce(text_pages, '') AS text_pages, coalesce(image_pages, '') AS image_pages, coalesce(blank_pages, '') AS blank_pages FROM (SELECT DISTINCT source_file FROM page_infos) f "
    + " ".join(f"LEFT JOIN {_ranges(k)} ON f.source_file IS NOT DISTINCT FROM {k}_r.source_file" for k in ("text", "image", "blank"))
)
def q_page_ranges(spark, d):
    return pages.route_pages(read_table(spark, d, "page_infos"))


@query("SELECT source_file, string_agg('--- PAGE ' || number || ' ---' || chr(10) || text, chr(10) || chr(10) ORDER BY number, page_id) AS tagged FROM page_infos WHERE kind = 'text' AND text IS NOT NULL AND number IS NOT NULL GROUP BY 1")
def q_page_tagged_text(spark, d):
    return pages.tagged_text(read_table(spark, d, "page_infos"))


# ---- Model answers --------------------------------------------------------------------------

_ANSWERS = (
    "SELECT route_id, CASE CAST(route_id % 4 AS INTEGER) WHEN 0 THEN j WHEN 1 THEN '```json' || chr(10) || j || chr(10) || '```' WHEN 2 THEN 'Here it is: ' || j || ' Done.' ELSE left(j, length(j) - 1) END AS raw "
    "FROM (SELECT route_id, CAST(to_json({'invoice_number': invoice.invoice_number, 'total_amount': invoice.total_amount, 'currency': invoice.currency}) AS VARCHAR) AS j FROM route_results WHERE invoice IS NOT NULL)"
)


def _answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers of a model as they come: plain, fenced, with words around, or cut off."""
    j = F.to_json(F.struct(*[F.col(f"invoice.{f}").alias(f) for f in ("invoice_number", "total_amount", "currency")]), {"ignoreNullFields": "false"})
    kind = F.col("route_id") % 4
    rows = read_table(spark, d, "route_results").where("invoice is not null").withColumn("j", j)
    raw = (
        F.when(kind == 0, F.col("j")).when(kind == 1, F.concat(F.lit("```json\n"), "j", F.lit("\n```"))).when(kind == 2, F.concat(F.lit("Here it is: "), "j", F.lit(" Done.")))
        .otherwise(F.left("j", F.length("j") - 1))
    )
    return rows.select("route_id", raw.alias("raw"))


@query(
    f"SELECT route_id, ok AS is_object, CASE WHEN ok THEN {_null('n')} END AS invoice_number, CASE WHEN ok THEN CAST({_dec('t')} AS DOUBLE) END AS total FROM "
    "(SELECT route_id, invoice.invoice_number AS n, invoice.total_amount AS t, route_id % 4 <> 3 AS ok FROM route_results WHERE invoice IS NOT NULL)"
)
def q_json_parse_fallback(spark, d):
    parsed = _answers(spark, d).withColumn("v", inv.parse_model_json(F.col("raw")))
    typed = parsed.select("route_id", F.col("v").isNotNull().alias("is_object"), *inv.typed_from_variant(F.col("v")))
    return typed.select("route_id", "is_object", "invoice_number", F.col("total_amount").cast("double").alias("total"))


# ---- Merging routes -------------------------------------------------------------------------

_ROUTES = (
    f"routes AS (SELECT *, {_KEY} AS file_key, list_min(pages) AS p0, list_max(pages) AS p1 FROM route_results WHERE source_file IS NOT NULL AND len(pages) > 0 AND invoice IS NOT NULL), "
    "ranked AS (SELECT *, row_number() OVER (PARTITION BY file_key ORDER BY p0, route_seq, route_id) AS ro, row_number() OVER (PARTITION BY file_key ORDER BY p1 DESC, route_seq, route_id) AS rl FROM routes)"
)
_LONG = "long AS (" + " UNION ALL ".join(
    f"SELECT file_key, ro, rl, '{f}' AS field, CAST({_dec(f'invoice.{f}') if f in MONEY_FIELDS else _null(f'invoice.{f}')} AS VARCHAR) AS v, "
    f"CAST({_dec(f'invoice.{f}') if f in MONEY_FIELDS else _norm(f'invoice.{f}')} AS VARCHAR) AS nv FROM ranked" for f in HEADER_FIELDS
) + ")"
_MERGED = (
    f"WITH {_ROUTES}, {_LONG}, m AS (SELECT file_key, field, count(DISTINCT nv) AS n_values, arg_min(v, ro) AS f, arg_max(v, ro) AS l, max(v) FILTER (WHERE rl = 1) AS c FROM long WHERE v IS NOT NULL GROUP BY 1, 2) "
)
_MONEY_IN = ", ".join(f"'{f}'" for f in MONEY_FIELDS)


@query(_MERGED + f"SELECT file_key, field, CASE WHEN n_values > 1 AND field IN ({_MONEY_IN}) THEN coalesce(c, l) ELSE f END AS value, n_values, n_values > 1 AS conflict FROM m")
def q_header_merge(spark, d):
    return merge.merge_headers(read_table(spark, d, "route_results"))


_ORDER = "list_position([" + ", ".join(f"'{f}'" for f in HEADER_FIELDS) + "], field)"


@query(_MERGED + f"SELECT file_key, string_agg(field, ',' ORDER BY {_ORDER}) AS fields, bool_or(field = 'invoice_number') AS several_invoices FROM m WHERE n_values > 1 GROUP BY 1")
def q_header_conflicts(spark, d):
    return merge.header_conflicts(read_table(spark, d, "route_results"))


_MLINES = (
    f"WITH {_ROUTES}, items AS (SELECT file_key, ro, p0, route_seq, route_id, unnest(invoice.line_items) AS item, generate_subscripts(invoice.line_items, 1) - 1 AS pos FROM ranked), "
    f"t AS (SELECT file_key, ro, p0, route_seq, route_id, pos, {_null('item.description')} AS d, {_norm('item.description')} AS nd, {_dec('item.quantity')} AS q, {_dec('item.unit_price')} AS u, {_dec('item.amount')} AS a FROM items), "
    "w AS (SELECT *, d IS NOT NULL AND q IS NOT NULL AND u IS NOT NULL AND a IS NOT NULL AS full_, row_number() OVER (PARTITION BY file_key, nd, q, u, a ORDER BY ro, pos) AS rn FROM t) "
)


@query(
    _MLINES + "SELECT file_key, CAST(p0 AS INTEGER) AS first_page, route_seq, route_id, CAST(pos AS INTEGER) AS pos, d AS description, CAST(q AS DOUBLE) AS quantity, CAST(u AS DOUBLE) AS unit_price, CAST(a AS DOUBLE) AS amount, "
    "ro = 1 OR NOT full_ OR rn = 1 AS kept FROM w"
)
def q_line_concat_dedupe(spark, d):
    rows = merge.merged_lines(read_table(spark, d, "route_results"))
    return rows.withColumns({c: F.col(c).cast("double") for c in ("quantity", "unit_price", "amount")})


@query(_MLINES + "SELECT file_key, count(*) AS n_lines, count(*) FILTER (WHERE NOT (ro = 1 OR NOT full_ OR rn = 1)) AS n_dropped FROM w GROUP BY 1")
def q_dedupe_counts(spark, d):
    return merge.merged_lines(read_table(spark, d, "route_results")).groupBy("file_key").agg(F.count("*").alias("n_lines"), F.count_if(~F.col("kept")).alias("n_dropped"))


@query(
    f"WITH {_ROUTES}, p AS (SELECT file_key, lower({_strip('provider')}) AS p, model, ro FROM ranked), "
    "pd AS (SELECT file_key, string_agg(p, '+' ORDER BY r) AS provider, bool_and(p = 'openrouter') AS gw FROM (SELECT file_key, p, min(ro) AS r FROM p WHERE p IS NOT NULL GROUP BY 1, 2) GROUP BY 1), "
    "md AS (SELECT file_key, string_agg(model, '+' ORDER BY r) AS model, count(*) AS n FROM (SELECT file_key, model, min(ro) AS r FROM p WHERE model IS NOT NULL GROUP BY 1, 2) GROUP BY 1) "
    "SELECT file_key, n_routes, coalesce(provider, '') AS provider, CASE WHEN coalesce(gw, true) AND n > 1 THEN 'multiple' ELSE coalesce(model, '') END AS model FROM (SELECT file_key, count(*) AS n_routes FROM ranked GROUP BY 1) LEFT JOIN pd USING (file_key) LEFT JOIN md USING (file_key)"
)
def q_provider_label(spark, d):
    return merge.provider_labels(read_table(spark, d, "route_results")).drop("pages")


# ---- Exports --------------------------------------------------------------------------------


@query(f"WITH inv AS ({_INV}) SELECT printf('INV-%04d', row_number() OVER (ORDER BY invoice_id)) AS export_id, invoice_id, invoice_number, currency, CAST(total_amount AS DOUBLE) AS total_amount FROM inv")
def q_export_invoices(spark, d):
    rows = _invoices(spark, d).select("invoice_id", "invoice_number", "currency", F.col("total_amount").cast("double").alias("total_amount"))
    numbered = numbering.global_row_number(rows, [F.col("invoice_id").asc()], "n")
    return numbered.select(F.format_string("INV-%04d", "n").alias("export_id"), "invoice_id", "invoice_number", "currency", "total_amount")


@query(f"WITH lin AS ({_LIN}) SELECT invoice_id, line_number, item_code, description, CAST(quantity AS DOUBLE) AS quantity, CAST(amount AS DOUBLE) AS amount, count(*) AS copies FROM lin GROUP BY ALL")
def q_export_lines(spark, d):
    typed = _lines(spark, d).select("invoice_id", "line_number", "item_code", "description", F.col("quantity").cast("double").alias("quantity"), F.col("amount").cast("double").alias("amount"))
    return typed.groupBy(*typed.columns).agg(F.count("*").alias("copies"))


@query(f"SELECT invoice_id, {_base('source_file')} AS source_file, coalesce(review_reason, '') AS review_reason, coalesce(failed_pages, '') AS failed_pages, count(*) AS copies FROM invoices WHERE needs_review GROUP BY ALL")
def q_export_needs_review(spark, d):
    rows = read_table(spark, d, "invoices").where("needs_review")
    return rows.groupBy(
        "invoice_id", text.basename(F.col("source_file")).alias("source_file"), F.coalesce("review_reason", F.lit("")).alias("review_reason"), F.coalesce("failed_pages", F.lit("")).alias("failed_pages")
    ).agg(F.count("*").alias("copies"))


@query("SELECT coalesce(extraction_method, 'failed') AS method, document_classification, count(*) AS n, count(*) FILTER (WHERE needs_review) AS n_review, CAST(sum(page_count) AS BIGINT) AS pages, count(*) FILTER (WHERE extraction_method IS NULL) AS n_failed FROM invoices GROUP BY ALL")
def q_batch_counters(spark, d):
    g = read_table(spark, d, "invoices").groupBy(F.coalesce("extraction_method", F.lit("failed")).alias("method"), "document_classification")
    return g.agg(F.count("*").alias("n"), F.count_if("needs_review").alias("n_review"), F.sum("page_count").alias("pages"), F.count_if(F.col("extraction_method").isNull()).alias("n_failed"))


# ---- Usage, ladders and budgets (the event table stands for logged requests) ---------------------

_USAGE = (
    "SELECT event_id, 'file_' || user_id AS source_file, CASE event_type WHEN 'click' THEN 'repair' WHEN 'purchase' THEN 'escalation' ELSE 'primary' END AS attempt_type, 'm' || (k % 3) AS requested_model, "
    "CASE WHEN k % 5 = 0 THEN '' ELSE 'm' || (k % 4) END AS actual_model, CASE WHEN k % 7 <> 0 THEN k END AS total_tokens, CASE WHEN k >= 10 THEN CAST(value AS DECIMAL(28,10)) END AS cost_usd, event_type = 'purchase' AS accepted "
    "FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"
)


def _usage(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint")
    kind = F.when(F.col("event_type") == "click", "repair").when(F.col("event_type") == "purchase", "escalation").otherwise("primary")
    return read_table(spark, d, "events").withColumn("k", k).select(
        "event_id", F.concat(F.lit("file_"), F.col("user_id")).alias("source_file"), kind.alias("attempt_type"), F.concat(F.lit("m"), F.col("k") % 3).alias("requested_model"),
        F.when(F.col("k") % 5 == 0, "").otherwise(F.concat(F.lit("m"), F.col("k") % 4)).alias("actual_model"), F.when(F.col("k") % 7 != 0, F.col("k")).alias("total_tokens"),
        F.when(F.col("k") >= 10, F.col("value").cast("decimal(28,10)")).alias("cost_usd"), (F.col("event_type") == "purchase").alias("accepted"),
    )


_MEASURES = (
    "count(*) AS requests, count(*) FILTER (WHERE accepted) AS accepted, count(*) FILTER (WHERE attempt_type = 'primary') AS n_primary, count(*) FILTER (WHERE attempt_type = 'repair') AS n_repair, "
    "count(*) FILTER (WHERE attempt_type NOT IN ('primary', 'repair')) AS n_escalation, CAST(sum(coalesce(total_tokens, 0)) AS BIGINT) AS tokens, CAST(sum(coalesce(cost_usd, 0)) AS DOUBLE) AS cost, count(*) FILTER (WHERE cost_usd IS NULL) AS unknown_cost"
)


@query(f"SELECT {_MEASURES} FROM ({_USAGE})")
def q_usage_summary(spark, d):
    return usage.usage_summary(_usage(spark, d))


@query(f"SELECT requested_model, {_MEASURES} FROM ({_USAGE}) GROUP BY 1")
def q_cost_by_model(spark, d):
    return usage.usage_summary(_usage(spark, d), ["requested_model"])


@query(f"SELECT source_file, {_MEASURES} FROM ({_USAGE}) GROUP BY 1")
def q_cost_by_file(spark, d):
    return usage.usage_summary(_usage(spark, d), ["source_file"])


@query(f"SELECT count(DISTINCT source_file) AS n_files, round_even(CAST(sum(coalesce(cost_usd, 0)) AS DOUBLE) / count(DISTINCT source_file), 6) AS average_cost FROM ({_USAGE})")
def q_average_cost(spark, d):
    return usage.average_cost(_usage(spark, d))


@query(
    f"SELECT coalesce(nullif(actual_model, ''), requested_model) AS model, string_agg(DISTINCT b, '+' ORDER BY b) AS model_basis, count(*) AS requests, count(*) FILTER (WHERE attempt_type = 'primary') AS primary, "
    "count(*) FILTER (WHERE attempt_type = 'repair') AS repair, count(*) FILTER (WHERE attempt_type = 'escalation') AS escalation, count(*) FILTER (WHERE accepted) AS accepted, CAST(sum(coalesce(total_tokens, 0)) AS BIGINT) AS total_tokens, "
    f"CAST(sum(coalesce(cost_usd, 0)) AS DOUBLE) AS reported_cost, count(*) FILTER (WHERE cost_usd IS NULL) AS unknown_cost_requests FROM (SELECT *, CASE WHEN actual_model <> '' THEN 'actual_model' ELSE 'requested_model' END AS b FROM ({_USAGE})) GROUP BY 1"
)
def q_model_table(spark, d):
    return usage.model_table(_usage(spark, d))


_ATTEMPTS = (
    "att AS (SELECT user_id AS file, CAST(k % 3 AS INTEGER) AS chunk, CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS model_idx, CAST(event_id % 2 AS INTEGER) AS k, "
    "CASE WHEN bool_or(k >= 10) THEN sum(CASE WHEN k >= 10 THEN CAST(value AS DECIMAL(28,10)) END) END AS cost, bool_or(k > 90) AS accepted, bool_or(k % 2 = 0) AS malformed FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY 1, 2, 3, 4), "
    "lad AS (SELECT att.* FROM att LEFT JOIN (SELECT file, chunk, min(model_idx) AS stop FROM att WHERE accepted GROUP BY 1, 2) s USING (file, chunk) LEFT JOIN (SELECT file, chunk, model_idx, bool_or(malformed) AS bad FROM att WHERE k = 0 GROUP BY 1, 2, 3) b USING (file, chunk, model_idx) "
    "WHERE (stop IS NULL OR model_idx <= stop) AND (k = 0 OR coalesce(bad, false)))"
)
_GATED = (
    ", g AS (SELECT *, sum(CASE WHEN k = 0 THEN 1 ELSE 0 END) OVER w AS models_at, coalesce(sum(coalesce(cost, 0)) OVER (PARTITION BY file ORDER BY chunk, model_idx, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM lad "
    "WINDOW w AS (PARTITION BY file ORDER BY chunk, model_idx, k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), f AS (SELECT * FROM g WHERE ((k = 0 AND models_at <= 4) OR (k = 1 AND models_at < 4)) AND spent < 60)"
)


def _attempts(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "events").withColumn("kk", F.get_json_object("props", "$.k").cast("bigint"))
    models = F.when(F.col("event_type") == "view", 0).when(F.col("event_type") == "click", 1).when(F.col("event_type") == "purchase", 2).when(F.col("event_type") == "signup", 3).otherwise(4)
    return rows.groupBy(F.col("user_id").alias("file"), (F.col("kk") % 3).cast("int").alias("chunk"), models.alias("model_idx"), (F.col("event_id") % 2).cast("int").alias("k")).agg(
        F.sum(F.when(F.col("kk") >= 10, F.col("value").cast("decimal(28,10)"))).alias("cost"), F.bool_or(F.col("kk") > 90).alias("accepted"), F.bool_or(F.col("kk") % 2 == 0).alias("malformed")
    )


@query(f"WITH {_ATTEMPTS} SELECT file, chunk, model_idx, k, CAST(cost AS DOUBLE) AS cost, accepted FROM lad")
def q_attempt_ladder(spark, d):
    return usage.climb_ladder(_attempts(spark, d)).select("file", "chunk", "model_idx", "k", F.col("cost").cast("double").alias("cost"), "accepted")


@query(f"WITH {_ATTEMPTS}{_GATED} SELECT file, chunk, model_idx, k, CAST(models_at AS BIGINT) AS models_at, CAST(spent AS DOUBLE) AS spent_before FROM f")
def q_file_budget(spark, d):
    return usage.gate_files(usage.climb_ladder(_attempts(spark, d)), 4, "60").select("file", "chunk", "model_idx", "k", "models_at", F.col("spent_before").cast("double").alias("spent_before"))


@query(f"WITH {_ATTEMPTS}{_GATED}, r AS (SELECT *, coalesce(sum(coalesce(cost, 0)) OVER (ORDER BY file, chunk, model_idx, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM f) SELECT file, chunk, model_idx, k, CAST(run AS DOUBLE) AS run_spent_before FROM r WHERE run < 5000")
def q_run_budget(spark, d):
    gated = usage.gate_files(usage.climb_ladder(_attempts(spark, d)), 4, "60").select("file", "chunk", "model_idx", "k", "cost")
    return usage.gate_run(gated, "5000").select("file", "chunk", "model_idx", "k", F.col("run_spent_before").cast("double").alias("run_spent_before"))


# ---- Line matching --------------------------------------------------------------------------

_CASES = (
    f"cases AS (SELECT *, {_base('source_file')} AS file FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY annotated_at DESC NULLS LAST) AS rn FROM annotations WHERE case_id IS NOT NULL) WHERE rn = 1)"
)
_EXPECTED = (
    f"{_CASES}, il AS (SELECT case_id, unnest(line_items) AS it, generate_subscripts(line_items, 1) - 1 AS idx FROM cases), "
    + "e0 AS (SELECT case_id, CAST(idx AS INTEGER) AS idx, " + ", ".join(f"{_dec(f'''it['{f}']''') if f in ('quantity', 'unit_price', 'amount') else _null(f'''it['{f}']''')} AS {f}" for f in LINE_FIELDS) + " FROM il), "
    + f"al AS (SELECT c.case_id, l.* FROM (SELECT source_file, " + ", ".join(f"{_dec(f) if f in ('quantity', 'unit_price', 'amount') else _null(f)} AS {f}" for f in LINE_FIELDS) + ", line_number, invoice_id FROM line_items) l JOIN cases c ON l.source_file = c.file), "
    + "a0 AS (SELECT case_id, CAST(row_number() OVER (PARTITION BY case_id ORDER BY line_number NULLS FIRST, line_no NULLS FIRST, item_code NULLS FIRST, description NULLS FIRST, quantity NULLS FIRST, unit_price NULLS FIRST, amount NULLS FIRST) - 1 AS INTEGER) AS idx, line_no, item_code, description, quantity, unit_price, amount FROM al)"
)
_COMP = "CASE WHEN description IS NOT NULL AND quantity IS NOT NULL AND unit_price IS NOT NULL AND amount IS NOT NULL THEN " + _norm("description") + " || '|' || quantity || '|' || unit_price || '|' || amount END"


def _tier(n: int, name: str, key: str) -> str:
    e, a = f"e{n - 1}", f"a{n - 1}"
    u = lambda t: f"(SELECT case_id, k, min(idx) AS i FROM (SELECT case_id, idx, {key} AS k FROM {t}) WHERE k IS NOT NULL GROUP BY 1, 2 HAVING count(*) = 1)"
    return (
        f", p{n} AS (SELECT x.case_id, x.i AS expected_idx, y.i AS actual_idx, '{name}' AS method FROM {u(e)} x JOIN {u(a)} y USING (case_id, k)), "
        f"e{n} AS (SELECT * FROM {e} WHERE NOT EXISTS (SELECT 1 FROM p{n} WHERE p{n}.case_id = {e}.case_id AND p{n}.expected_idx = {e}.idx)), "
        f"a{n} AS (SELECT * FROM {a} WHERE NOT EXISTS (SELECT 1 FROM p{n} WHERE p{n}.case_id = {a}.case_id AND p{n}.actual_idx = {a}.idx))"
    )


_TIERS = f"WITH {_EXPECTED}" + _tier(1, "line_no", "lower(line_no)") + _tier(2, "item_code", "lower(item_code)") + _tier(3, "composite", _COMP)


def _line_sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Annotated lines and extracted lines of each case, numbered by their place."""
    from pyspark.sql import Window

    cases = scoring.current_cases(read_table(spark, d, "annotations"))
    item = lambda f: F.try_element_at("it", F.lit(f))
    num = ("quantity", "unit_price", "amount")
    expected = cases.select("case_id", F.posexplode("line_items").alias("idx", "it")).select(
        "case_id", "idx", *[(numbers.coerce_decimal(item(f)) if f in num else text.blank_to_null(item(f))).alias(f) for f in LINE_FIELDS])
    typed = inv.typed_lines(read_table(spark, d, "line_items")).join(cases.select("case_id", "file"), F.col("source_file") == F.col("file"))
    at = Window.partitionBy("case_id").orderBy("line_number", *LINE_FIELDS)
    return expected, typed.select("case_id", (F.row_number().over(at) - 1).alias("idx"), *LINE_FIELDS)


@query(_TIERS + " SELECT * FROM p1")
def q_lines_tier1(spark, d):
    e, a = _line_sides(spark, d)
    return linkage.match_exact(e, a, tiers=1)[0]


@query(_TIERS + " SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3 UNION ALL SELECT case_id, idx, NULL, 'missing' FROM e3 UNION ALL SELECT case_id, NULL, idx, 'extra' FROM a3")
def q_lines_all_tiers(spark, d):
    return linkage.match_lines(*_line_sides(spark, d))


@query(_TIERS + " SELECT method, count(*) AS n FROM (SELECT method FROM p1 UNION ALL SELECT method FROM p2 UNION ALL SELECT method FROM p3 UNION ALL SELECT 'missing' FROM e3 UNION ALL SELECT 'extra' FROM a3) GROUP BY 1")
def q_lines_residue(spark, d):
    return linkage.match_lines(*_line_sides(spark, d)).groupBy("method").agg(F.count("*").alias("n"))


@query()
def q_lines_fuzzy(spark, d):
    return linkage.match_fuzzy(*_line_sides(spark, d))


# ---- Scoring --------------------------------------------------------------------------------

_STATUS = f"WITH {_CASES}, n AS (SELECT {_base('source_file')} AS file, count(*) AS n FROM invoices WHERE source_file IS NOT NULL GROUP BY 1), st AS (SELECT case_id, file, coalesce(n, 0) AS n_results, CASE WHEN coalesce(n, 0) = 0 THEN 'missing_result' WHEN n = 1 THEN 'matched' ELSE 'duplicate_result' END AS status FROM cases LEFT JOIN n USING (file))"


@query(_STATUS + " SELECT * FROM st")
def q_case_match_status(spark, d):
    return scoring.match_cases(scoring.current_cases(read_table(spark, d, "annotations")), read_table(spark, d, "invoices"))


@query(f"WITH {_CASES} SELECT DISTINCT {_base('source_file')} AS file FROM invoices WHERE source_file IS NOT NULL AND {_base('source_file')} NOT IN (SELECT file FROM cases WHERE file IS NOT NULL)")
def q_extra_sources(spark, d):
    return scoring.extra_sources(scoring.current_cases(read_table(spark, d, "annotations")), read_table(spark, d, "invoices"))


_FOLD = "replace(lower({x}), 'ß', 'ss')"
# The annotated fields by hand: name, extracted field, comparison.
_SCORED_SQL = [
    ("invoice_number", "invoice_number", "identifier"), ("invoice_date", "invoice_date", "date"), ("seller_name", "seller_name", "text"), ("seller_address", "seller_address", "text"),
    ("buyer_name", "buyer_name", "text"), ("buyer_address", "buyer_address", "text"), ("currency", "currency", "text"), ("subtotal", "subtotal", "number"), ("tax", "tax_amount", "number"),
    ("total_amount", "total_amount", "number"), ("po_number", "po_number", "identifier"), ("reference", "reference", "identifier"),
]


def _same(e: str, a: str, kind: str, tol: str) -> str:
    if kind == "number":
        return f"coalesce(abs({_dec(e)} - {_dec(a)}) <= {tol}, false)"
    if kind == "date":
        return f"{_strip(e)} = {_strip(a)}"
    if kind == "identifier":
        return f"{_FOLD.format(x=_strip(e))} = {_FOLD.format(x=_strip(a))}"
    return f"{_FOLD.format(x=_norm(e))} = {_FOLD.format(x=_norm(a))}"


def _outcome(e: str, a: str, same: str) -> str:
    return f"CASE WHEN {e} IS NULL AND {a} IS NULL THEN 'correct' WHEN {e} IS NULL THEN 'unexpected' WHEN {a} IS NULL THEN 'missing' WHEN {same} THEN 'correct' ELSE 'incorrect' END"


def _cell(f: str, ext: str, kind: str) -> str:
    e, a = f"nullif(invoice['{f}'], '')", _null(f"r_{ext}")
    tol = f"coalesce(TRY_CAST(field_tolerances['{f}'] AS DECIMAL(28,10)), 0.01)"
    return (
        f"SELECT case_id, '{f}' AS field, {_outcome(e, a, _same(e, a, kind, tol))} AS outcome "
        f"FROM rows WHERE list_contains(map_keys(invoice), '{f}') AND NOT coalesce(list_contains(ignored_fields, '{f}'), false)"
    )


_CELLS = (
    _STATUS + f", rows AS (SELECT c.*, " + ", ".join(f"i.{f} AS r_{f}" for f in HEADER_FIELDS) + f", i.needs_review AS flag, i.review_reason AS reason, i.extraction_method AS method FROM cases c JOIN st ON c.case_id = st.case_id AND st.status = 'matched' JOIN invoices i ON {_base('i.source_file')} = c.file), cells AS ("
    + " UNION ALL ".join(_cell(*x) for x in _SCORED_SQL) + ")"
)


def _cells(spark: SparkSession, d: str) -> DataFrame:
    return scoring.header_cells(scoring.current_cases(read_table(spark, d, "annotations")), read_table(spark, d, "invoices"))


@query(_CELLS + " SELECT * FROM cells")
def q_cell_outcomes(spark, d):
    return _cells(spark, d)


_TALLY = "count(*) FILTER (WHERE outcome = 'correct') AS correct, count(*) FILTER (WHERE outcome = 'incorrect') AS incorrect, count(*) FILTER (WHERE outcome = 'missing') AS missing, count(*) FILTER (WHERE outcome = 'unexpected') AS unexpected, count(*) AS evaluated"
_RATIO = "CAST(round_even(CAST({n} AS DECIMAL(20,0)) / nullif({d}, 0), 4) AS DOUBLE)"
_FIELDS = f"(SELECT field, {_TALLY}, {_RATIO.format(n='''count(*) FILTER (WHERE outcome = 'correct')''', d='count(*)')} AS accuracy FROM cells GROUP BY 1)"


@query(_CELLS + f" SELECT * FROM {_FIELDS}")
def q_header_tallies(spark, d):
    return scoring.tallies(_cells(spark, d), ["field"])


@query(_CELLS + f" SELECT field, accuracy, evaluated FROM {_FIELDS} ORDER BY accuracy, evaluated DESC, field LIMIT 5")
def q_weakest_fields(spark, d):
    """A top-k report: the limit is the feature."""
    return scoring.tallies(_cells(spark, d), ["field"]).select("field", "accuracy", "evaluated").orderBy("accuracy", F.desc("evaluated"), "field").limit(5)


@query(
    _CELLS + f", x AS (SELECT count(*) AS n_cases, {_RATIO.format(n='count(*) FILTER (WHERE a)', d='count(*)')} AS exact_rate FROM (SELECT case_id, bool_and(outcome = 'correct') AS a FROM cells GROUP BY 1)) "
    f"SELECT {_RATIO.format(n='sum(correct)', d='sum(evaluated)')} AS micro_accuracy, round_even(avg(accuracy), 4) AS macro_accuracy, CAST(sum(evaluated) AS BIGINT) AS cells, any_value(n_cases) AS n_cases, any_value(exact_rate) AS exact_rate FROM {_FIELDS}, x"
)
def q_header_accuracy(spark, d):
    return scoring.accuracy_summary(_cells(spark, d))


_P, _R = _RATIO.format(n="tp", d="(tp + fp)"), _RATIO.format(n="tp", d="(tp + fn)")


@query(
    _CELLS + ", k AS (SELECT count(*) FILTER (WHERE e AND a) AS tp, count(*) FILTER (WHERE NOT e AND NOT a) AS tn, count(*) FILTER (WHERE NOT e AND a) AS fp, count(*) FILTER (WHERE e AND NOT a) AS fn FROM "
    "(SELECT expected_needs_review AS e, coalesce(flag, false) AS a FROM rows WHERE expected_needs_review IS NOT NULL)), "
    f"pr AS (SELECT *, {_P} AS precision, {_R} AS recall, {_RATIO.format(n='fp', d='(fp + tn)')} AS false_review_rate, {_RATIO.format(n='fn', d='(fn + tp)')} AS missed_rate FROM k) "
    "SELECT tp, tn, fp, fn, precision, recall, round_even(2 * precision * recall / nullif(precision + recall, 0), 4) AS f1, false_review_rate, missed_rate FROM pr"
)
def q_review_metrics(spark, d):
    return scoring.review_confusion(scoring.current_cases(read_table(spark, d, "annotations")), read_table(spark, d, "invoices"))


# Review phrases by hand, in order; the SQL of the categories does not read the library's list.
_PHRASES = (
    "invoice_number conflict>invoice_number_conflict|possible multiple invoices>invoice_number_conflict|conflict in invoice_number>invoice_number_conflict|conflict in>header_conflict|missing required fields>missing_required_fields|"
    "totals inconclusive>totals_inconclusive|partial extraction>partial_extraction|missing an amount>suspicious_line|hallucinated>suspicious_line|no line items>suspicious_line|run-wide>budget_exhausted|cost budget>budget_exhausted|"
    "attempt cap>budget_exhausted|unreadable pdf>malformed_pdf|no meaningful pages>blank_document|document is blank>blank_document|openrouter_text_models>provider_failure|openrouter_vision_models>provider_failure|"
    "openrouter_api_key>provider_failure|failed on all>provider_failure|http 4>provider_failure|http 5>provider_failure|rate_limited>provider_failure|truncated>provider_failure"
)
_CATEGORY = "CASE " + " ".join(f"WHEN contains(lower(c), '{p}') THEN '{n}'" for p, n in (x.split(">") for x in _PHRASES.split("|"))) + " END"
# Reasons in the wording that the pipeline writes, one or two clauses by the row's key.
_REASONS = [
    "conflict in seller_name: 'A' (pages 1); kept 'A'", "possible multiple invoices: 2 numbers", "totals inconclusive: lines 5 total 7", "missing required fields: currency", "partial extraction: text chunk 1/2 failed; result covers pages 1 only",
    "2 line items are missing an amount (possible hallucinated header rows)", "run-wide cost budget reached", "unreadable PDF: ValueError", "no meaningful pages (document is blank)", "text chunk failed on all configured models: HTTP 503",
    "missing identifier: no number", "something nobody ever wrote before: and its value that goes on and on",
]
_REASON_SQL = "list_value(" + ", ".join("'" + r.replace("'", "''") + "'" for r in _REASONS) + ")"
_REASONED = f"(SELECT route_id, {_REASON_SQL}[1 + route_id % 12] || CASE WHEN route_id % 3 = 0 THEN '; ' || {_REASON_SQL}[1 + route_id % 11] ELSE '' END AS reason FROM route_results)"


def _reasoned(spark: SparkSession, d: str) -> DataFrame:
    """Rows with review reasons in the pipeline's wording."""
    listed = F.array(*[F.lit(r) for r in _REASONS])
    at = lambda n: F.element_at(listed, (F.col("route_id") % n + 1).cast("int"))
    reason = F.concat(at(12), F.when(F.col("route_id") % 3 == 0, F.concat(F.lit("; "), at(11))).otherwise(""))
    return read_table(spark, d, "route_results").select("route_id", reason.alias("reason"))


_HEAD = _strip("split_part(c, ':', 1)")
_METHOD = "CASE WHEN route_id % 17 = 0 THEN 'failed' ELSE route END"
_CLAUSES = f"(SELECT route_id, pos, c, {_CATEGORY} AS category FROM (SELECT route_id, unnest(string_split(reason, '; ')) AS c, generate_subscripts(string_split(reason, '; '), 1) AS pos FROM {_REASONED}))"


@query(f"SELECT route_id, string_agg(category, ',' ORDER BY p) AS categories FROM (SELECT route_id, category, min(pos) AS p FROM {_CLAUSES} WHERE category IS NOT NULL GROUP BY 1, 2) GROUP BY 1")
def q_review_categories(spark, d):
    found = _reasoned(spark, d).select("route_id", F.array_join(scoring.review_categories(F.col("reason")), ",").alias("categories"))
    return found.where("categories <> ''")


@query(f"SELECT route_id, left({_HEAD}, 40) AS label, count(*) AS n FROM {_CLAUSES} WHERE category IS NULL GROUP BY ALL")
def q_unknown_clauses(spark, d):
    return _reasoned(spark, d).select("route_id", F.explode(scoring.unknown_clauses(F.col("reason"))).alias("label")).groupBy("route_id", "label").agg(F.count("*").alias("n"))


@query(
    f"SELECT route_id, concat_ws(',', nullif(string_agg(category, ',' ORDER BY p) FILTER (WHERE category IS NOT NULL), ''), CASE WHEN bool_or(category IS NULL) THEN 'unknown' END) AS categories FROM "
    f"(SELECT route_id, category, min(pos) AS p FROM {_CLAUSES} GROUP BY 1, 2) GROUP BY 1"
)
def q_safe_categories(spark, d):
    return _reasoned(spark, d).select("route_id", F.array_join(scoring.safe_categories(F.col("reason")), ",").alias("categories"))


@query(f"SELECT route_id, string_agg(h, ', ' ORDER BY p) AS heads FROM (SELECT route_id, {_HEAD} AS h, min(pos) AS p FROM {_CLAUSES} GROUP BY 1, 2) GROUP BY 1")
def q_reason_heads(spark, d):
    return _reasoned(spark, d).select("route_id", scoring.reason_heads(F.col("reason")).alias("heads"))


_PCT = "SELECT document_classification AS document_type, count(*) AS n, round_even(avg(v), 3) AS average, round_even(median(v), 3) AS median, CASE WHEN count(v) >= 20 THEN round_even(quantile_cont(v, 0.95), 3) END AS p95 FROM (SELECT document_classification, CAST(page_count AS DOUBLE) AS v FROM invoices) GROUP BY 1"


@query(_PCT)
def q_doc_type_table(spark, d):
    rows = read_table(spark, d, "invoices").withColumn("v", F.col("page_count").cast("double"))
    return rows.groupBy(F.col("document_classification").alias("document_type")).agg(
        F.count("*").alias("n"), F.bround(F.avg("v"), 3).alias("average"), F.bround(F.median("v"), 3).alias("median"), scoring.group_percentile(0.95, F.col("v")).alias("p95"))


@query(
    _CELLS + f", m AS (SELECT field || '_accuracy' AS metric, accuracy AS value FROM {_FIELDS}), t(key, target) AS (VALUES ('invoice_number_accuracy_min', 0.9), ('currency_accuracy_min', 0.2), ('total_amount_accuracy_max', 0.5), ('unknown_metric_min', 0.1), ('__note', 0.0)) "
    "SELECT key, CASE WHEN key LIKE '%\\_max' ESCAPE '\\' THEN 'max' ELSE 'min' END AS bound, CAST(target AS DOUBLE) AS target, value, coalesce(CASE WHEN key LIKE '%\\_max' ESCAPE '\\' THEN value <= target ELSE value >= target END, false) AS passed "
    "FROM t LEFT JOIN m ON m.metric = regexp_replace(key, '_(min|max)$', '') WHERE NOT starts_with(key, '__')"
)
def q_thresholds(spark, d):
    metrics = scoring.tallies(_cells(spark, d), ["field"]).select(F.concat("field", F.lit("_accuracy")).alias("metric"), F.col("accuracy").alias("value"))
    rows = [("invoice_number_accuracy_min", 0.9), ("currency_accuracy_min", 0.2), ("total_amount_accuracy_max", 0.5), ("unknown_metric_min", 0.1), ("__note", 0.0)]
    return scoring.evaluate_thresholds(metrics, spark.createDataFrame(rows, "key string, target double"))


_OUTCOME = "CASE WHEN regexp_matches(lower(coalesce({r}, '')), 'unreadable pdf|no meaningful pages|failed on all') OR coalesce({m} = 'failed', false) THEN 'failed' WHEN coalesce({f}, false) THEN 'needs_review' ELSE 'extracted' END"


@query(f"SELECT route_id, {_OUTCOME.format(r='reason', m=_METHOD, f='route_id % 2 = 0')} AS outcome FROM {_REASONED} JOIN (SELECT route_id, route FROM route_results) USING (route_id)")
def q_actual_outcome(spark, d):
    rows = _reasoned(spark, d).join(read_table(spark, d, "route_results").select("route_id", "route"), "route_id")
    method = F.when(F.col("route_id") % 17 == 0, "failed").otherwise(F.col("route"))
    return rows.select("route_id", scoring.actual_outcome(F.col("reason"), method, F.col("route_id") % 2 == 0).alias("outcome"))


# ---- Ground-truth violations ----------------------------------------------------------------


@query(
    f"WITH {_CASES}, kv AS (SELECT case_id, unnest(map_keys(invoice)) AS k, unnest(map_values(invoice)) AS v FROM cases) "
    "SELECT case_id, k AS field, 'not_a_date' AS violation FROM kv WHERE k = 'invoice_date' AND v IS NOT NULL AND v <> '' AND (NOT regexp_full_match(v, '\\d{4}-\\d{2}-\\d{2}') OR TRY_CAST(v AS DATE) IS NULL) "
    "UNION ALL SELECT case_id, k, 'not_a_decimal' FROM kv WHERE k = 'total_amount' AND v IS NOT NULL AND v <> '' AND NOT regexp_full_match(v, '\\s*[+-]?\\d+(\\.\\d+)?\\s*') "
    "UNION ALL SELECT case_id, k, 'unknown_field' FROM kv WHERE k NOT IN ('invoice_number', 'invoice_date', 'seller_name', 'seller_address', 'buyer_name', 'buyer_address', 'currency', 'subtotal', 'tax', 'total_amount', 'po_number', 'reference', 'ship_to', 'bill_to', 'incoterms', 'country_of_origin') "
    "UNION ALL SELECT case_id, k, 'bad_tolerance' FROM (SELECT case_id, unnest(map_keys(field_tolerances)) AS k, unnest(map_values(field_tolerances)) AS v FROM cases) WHERE coalesce(TRY_CAST(v AS DECIMAL(28,10)) < 0, true)"
)
def q_ground_truth_violations(spark, d):
    cases = scoring.current_cases(read_table(spark, d, "annotations"))
    kv = cases.select("case_id", F.explode("invoice").alias("field", "v"))
    filled = F.col("v").isNotNull() & (F.col("v") != "")
    violation = (
        F.when(~F.col("field").isin(*scoring.SCORED, *scoring.NOT_EXTRACTABLE_HEADER), "unknown_field")
        .when((F.col("field") == "invoice_date") & filled & (~F.col("v").rlike(r"^\d{4}-\d{2}-\d{2}\z") | F.col("v").try_cast("date").isNull()), "not_a_date")
        .when((F.col("field") == "total_amount") & filled & ~F.col("v").rlike(r"^\s*[+-]?\d+(\.\d+)?\s*\z"), "not_a_decimal")
    )
    own = kv.select("case_id", "field", violation.alias("violation")).where("violation is not null")
    tol = cases.select("case_id", F.explode("field_tolerances").alias("field", "v")).where(F.coalesce(F.col("v").try_cast("decimal(28,10)") < 0, F.lit(True)))
    return own.unionByName(tol.select("case_id", "field", F.lit("bad_tolerance").alias("violation")))


# ---- Events ---------------------------------------------------------------------------------


@query("SELECT user_id AS job_id, count(*) AS n_events, max(event_id) AS last_seq, arg_max(event_type, event_id) AS last_event, arg_max(value, event_id) FILTER (WHERE event_type = 'purchase') AS last_purchase, max(CASE WHEN event_type = 'error' THEN event_id END) AS last_error FROM events GROUP BY 1")
def q_event_progress(spark, d):
    e = read_table(spark, d, "events")
    return e.groupBy(F.col("user_id").alias("job_id")).agg(
        F.count("*").alias("n_events"), F.max("event_id").alias("last_seq"), F.max_by("event_type", "event_id").alias("last_event"),
        F.max_by(F.when(F.col("event_type") == "purchase", F.col("value")), F.when(F.col("event_type") == "purchase", F.col("event_id"))).alias("last_purchase"),
        F.max(F.when(F.col("event_type") == "error", F.col("event_id"))).alias("last_error"))


@query("SELECT user_id AS job_id, event_id % 50 AS seq, arg_min(event_type, event_id) AS event, count(*) AS copies FROM events GROUP BY 1, 2")
def q_events_dedupe(spark, d):
    """The first event of each (job, sequence number) stays."""
    e = read_table(spark, d, "events").withColumn("seq", F.col("event_id") % 50)
    return e.groupBy(F.col("user_id").alias("job_id"), "seq").agg(F.min_by("event_type", "event_id").alias("event"), F.count("*").alias("copies"))


@query("SELECT user_id AS job_id, max(ts) AS last_seen, date_diff('second', max(ts), TIMESTAMP '2024-02-01 00:00:00') AS age_s, date_diff('second', max(ts), TIMESTAMP '2024-02-01 00:00:00') > 120 AS is_stale, date_diff('second', max(ts), TIMESTAMP '2024-02-01 00:00:00') >= 86400 AS is_expired FROM events GROUP BY 1")
def q_stale_heartbeat(spark, d):
    """Heartbeats and retention against a fixed time."""
    now = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    e = read_table(spark, d, "events").groupBy(F.col("user_id").alias("job_id")).agg(F.max("ts").alias("last_seen"))
    age = F.timestamp_diff("SECOND", F.date_trunc("second", "last_seen").cast("timestamp_ntz"), now)
    return e.select("job_id", "last_seen", age.alias("age_s"), (age > 120).alias("is_stale"), (age >= 86400).alias("is_expired"))


def queries():
    return dict(Q)
