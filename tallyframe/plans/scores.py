"""Queries of the whole scoring pass: lines, totals, costs, verdicts by case, and the report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.functions import numbers, text
from tallyframe.operators import linkage, report, scoring, usage
from tallyframe.operators.numbering import global_row_number
from tallyframe.plans.reference import _CASES, _CELLS, _EXPECTED, _OUTCOME, _RATIO, _STATUS, _TIERS, _base, _dec, _null, _outcome, _same
from tallyframe.schemas import LINE_FIELDS, NUMERIC_LINE_FIELDS
from tallyframe.session import cut_lineage, read_table

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _cases(spark: SparkSession, d: str) -> DataFrame:
    return scoring.current_cases(read_table(spark, d, "annotations"))


def _sides(spark: SparkSession, d: str, cases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Annotated and extracted lines of each case as text, numbered by their place."""
    expected = cases.select("case_id", F.posexplode("line_items").alias("idx", "it")).select(
        "case_id", "idx", F.map_keys("it").alias("keys"), *[F.try_element_at("it", F.lit(f)).alias(f) for f in LINE_FIELDS])
    rows = read_table(spark, d, "line_items").join(cases.select("case_id", F.col("file").alias("source_file")), "source_file")
    typed = {f"_{f}": numbers.coerce_decimal(F.col(f)) if f in NUMERIC_LINE_FIELDS else text.blank_to_null(F.col(f)) for f in LINE_FIELDS}
    order = [F.col(c).asc() for c in ("case_id", "line_number", *typed)]
    numbered = global_row_number(rows.withColumns(typed), order, "_n")
    first = numbered.groupBy("case_id").agg(F.min("_n").alias("_first"))
    return expected, numbered.join(first, "case_id").select("case_id", (F.col("_n") - F.col("_first")).cast("int").alias("idx"), *LINE_FIELDS)


def _typed(rows: DataFrame) -> DataFrame:
    return rows.select("case_id", "idx", *[(numbers.coerce_decimal(F.col(f)) if f in NUMERIC_LINE_FIELDS else text.blank_to_null(F.col(f))).alias(f) for f in LINE_FIELDS])


def _lines(spark: SparkSession, d: str, cases: DataFrame):
    """(cells, matches, expected, actual) of the exact tiers, each read several times and so cut once."""
    expected, actual = (cut_lineage(x) for x in _sides(spark, d, cases))
    pairs = cut_lineage(linkage.match_lines(_typed(expected), _typed(actual)))
    cells = cut_lineage(scoring.line_cells(cases, pairs, expected, actual))
    return cells, scoring.line_matches(pairs, cells), expected, actual


def _matched(spark: SparkSession, d: str, cases: DataFrame) -> DataFrame:
    """Cases with exactly one result; lines are scored for these."""
    status = scoring.match_cases(cases, read_table(spark, d, "invoices")).where("status = 'matched'").select("case_id")
    return cut_lineage(cases.join(status, "case_id"))


# Usage of a run, made from the routes: one request a route, failed routes without cost or latency.
def _usage(spark: SparkSession, d: str) -> DataFrame:
    r = F.col("route_id")
    return read_table(spark, d, "route_results").select(
        r.alias("seq"), F.trim(F.replace("source_file", F.lit("\\"), F.lit("/"))).alias("source_file"), F.when(F.col("route_seq") == 1, "primary").when(r % 3 == 0, "repair").when(r % 3 == 1, "escalation").otherwise("other").alias("attempt_type"),
        F.col("model").alias("requested_model"), F.when(r % 4 == 0, "").otherwise(F.concat("model", F.lit("-b"))).alias("actual_model"), "route",
        F.when(r % 5 != 0, r % 900).alias("input_tokens"), (r % 70).alias("output_tokens"), F.when(r % 2 == 0, r % 11).alias("reasoning_tokens"), (r % 970).alias("total_tokens"),
        F.when(r % 7 != 0, (r % 997).cast("decimal(28,10)") / 1000).cast("decimal(28,10)").alias("cost_usd"), F.when(r % 6 != 0, (r % 5003).cast("double")).alias("latency_ms"), (r % 3 != 0).alias("accepted"),
    ).where("source_file is not null")


_USAGE = (
    "usage AS (SELECT route_id AS seq, trim(replace(source_file, '\\', '/')) AS source_file, CASE WHEN route_seq = 1 THEN 'primary' WHEN route_id % 3 = 0 THEN 'repair' WHEN route_id % 3 = 1 THEN 'escalation' ELSE 'other' END AS attempt_type, "
    "model AS requested_model, CASE WHEN route_id % 4 = 0 THEN '' ELSE model || '-b' END AS actual_model, route, CASE WHEN route_id % 5 <> 0 THEN route_id % 900 END AS input_tokens, route_id % 70 AS output_tokens, "
    "CASE WHEN route_id % 2 = 0 THEN route_id % 11 END AS reasoning_tokens, route_id % 970 AS total_tokens, CASE WHEN route_id % 7 <> 0 THEN CAST(route_id % 997 AS DECIMAL(28,10)) / 1000 END AS cost_usd, "
    "CASE WHEN route_id % 6 <> 0 THEN CAST(route_id % 5003 AS DOUBLE) END AS latency_ms, route_id % 3 <> 0 AS accepted FROM route_results WHERE source_file IS NOT NULL)"
)


def _metadata(spark: SparkSession, d: str) -> DataFrame:
    """Runtimes of some files, as a run's metadata states them."""
    rows = read_table(spark, d, "invoices").where("source_file is not null and page_count % 2 = 1")
    return rows.groupBy(text.basename(F.col("source_file")).alias("file")).agg((F.max("page_count") * 1.5).cast("double").alias("elapsed_seconds"))


_META = f"meta AS (SELECT {_base('source_file')} AS file, CAST(max(page_count) * 1.5 AS DOUBLE) AS elapsed_seconds FROM invoices WHERE source_file IS NOT NULL AND page_count % 2 = 1 GROUP BY 1)"

# ---- Lines ----------------------------------------------------------------------------------

_RAW = (
    f", er AS (SELECT case_id, CAST(generate_subscripts(line_items, 1) - 1 AS INTEGER) AS idx, unnest(line_items) AS it, field_tolerances FROM cases), "
    "ar0 AS (SELECT c.case_id, l.*, " + ", ".join(f"{_dec(f'l.{f}') if f in NUMERIC_LINE_FIELDS else _null(f'l.{f}')} AS t_{f}" for f in LINE_FIELDS) + " FROM line_items l JOIN cases c ON l.source_file = c.file), "
    "ar AS (SELECT *, CAST(row_number() OVER (PARTITION BY case_id ORDER BY line_number NULLS FIRST, " + ", ".join(f"t_{f} NULLS FIRST" for f in LINE_FIELDS) + ") - 1 AS INTEGER) AS idx FROM ar0), "
    "pr AS (SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3), "
    "al3 AS (SELECT * FROM pr UNION ALL SELECT case_id, idx, NULL, 'missing' FROM e3 UNION ALL SELECT case_id, NULL, idx, 'extra' FROM a3), "
    f"stat AS (SELECT case_id, coalesce(n, 0) AS n FROM cases LEFT JOIN (SELECT {_base('source_file')} AS file, count(*) AS n FROM invoices WHERE source_file IS NOT NULL GROUP BY 1) USING (file)), "
    "ok AS (SELECT case_id FROM stat WHERE n = 1)"
)


def _line_cell(f: str) -> str:
    kind = "number" if f in NUMERIC_LINE_FIELDS else "text" if f == "description" else "identifier"
    e, a = f"nullif(er.it['{f}'], '')", _null(f"ar.{f}")
    tol = "0" if f == "quantity" else f"coalesce(TRY_CAST(er.field_tolerances['{f}'] AS DECIMAL(28,10)), 0.01)"
    return (
        f"SELECT pr.case_id, pr.expected_idx, pr.actual_idx, pr.method, '{f}' AS field, {_outcome(e, a, _same(e, a, kind, tol))} AS outcome FROM pr JOIN ok USING (case_id) "
        f"JOIN er ON er.case_id = pr.case_id AND er.idx = pr.expected_idx JOIN ar ON ar.case_id = pr.case_id AND ar.idx = pr.actual_idx WHERE list_contains(map_keys(er.it), '{f}')"
    )


_LINE = _TIERS + _RAW + ", lc AS (" + " UNION ALL ".join(map(_line_cell, LINE_FIELDS)) + (
    "), lm AS (SELECT al3.*, method NOT IN ('missing', 'extra') AND NOT EXISTS (SELECT 1 FROM lc WHERE lc.case_id = al3.case_id AND lc.expected_idx = al3.expected_idx AND outcome <> 'correct') AS row_correct FROM al3 JOIN ok USING (case_id)), "
    "ln AS (SELECT case_id, count(*) FILTER (WHERE method <> 'extra') AS expected, count(*) FILTER (WHERE method <> 'missing') AS actual, count(*) FILTER (WHERE method NOT IN ('missing', 'extra')) AS matched, "
    "count(*) FILTER (WHERE method = 'missing') AS missing, count(*) FILTER (WHERE method = 'extra') AS extra, 0 AS ambiguous, 0 AS fuzzy, bool_and(row_correct) AS all_lines_correct FROM lm GROUP BY 1)"
)
_TALLY = ", ".join(f"count(*) FILTER (WHERE outcome = '{o}') AS {o}" for o in scoring.OUTCOMES) + ", count(*) AS evaluated"
_PR = (
    f"{_RATIO.format(n='correct', d='evaluated')} AS accuracy, {_RATIO.format(n='correct', d='(correct + incorrect + unexpected)')} AS precision, {_RATIO.format(n='correct', d='(correct + incorrect + missing)')} AS recall"
)


@query(_LINE + f" SELECT *, {_PR} FROM (SELECT field, {_TALLY} FROM lc GROUP BY 1)")
def q_line_tallies(spark, d):
    cells = _lines(spark, d, _matched(spark, d, _cases(spark, d)))[0]
    return scoring.with_precision_recall(scoring.tallies(cells, ["field"]))


@query(_LINE + " SELECT * FROM lm")
def q_line_matches(spark, d):
    return _lines(spark, d, _matched(spark, d, _cases(spark, d)))[1]


@query(_LINE + " SELECT * FROM ln")
def q_line_counts(spark, d):
    return scoring.line_counts(_lines(spark, d, _matched(spark, d, _cases(spark, d)))[1])


@query(_CELLS + f" SELECT *, {_PR} FROM (SELECT field, {_TALLY} FROM cells GROUP BY 1)")
def q_header_metrics(spark, d):
    return scoring.with_precision_recall(scoring.tallies(scoring.header_cells(_cases(spark, d), read_table(spark, d, "invoices")), ["field"]))


@query(_CELLS + f" SELECT case_id, {_TALLY}, {_RATIO.format(n='''count(*) FILTER (WHERE outcome = 'correct')''', d='count(*)')} AS accuracy FROM cells GROUP BY 1")
def q_case_header_tallies(spark, d):
    return scoring.tallies(scoring.header_cells(_cases(spark, d), read_table(spark, d, "invoices")), ["case_id"])


# ---- Totals, review, costs ------------------------------------------------------------------

_SUMS = (
    "es AS (SELECT case_id, sum(amount) AS s FROM e0 GROUP BY 1), acs AS (SELECT case_id, sum(amount) AS s FROM a0 GROUP BY 1), "
    f"rr AS (SELECT {_base('source_file')} AS file, any_value(review_reason) AS reason, count(*) AS n FROM invoices WHERE source_file IS NOT NULL GROUP BY 1 HAVING count(*) = 1), "
    f"tt AS (SELECT case_id, es.s AS e, acs.s AS a, {_dec('''invoice['total_amount']''')} AS t, {_dec('''invoice['tax']''')} AS x, coalesce(TRY_CAST(field_tolerances['total_amount'] AS DECIMAL(28,10)), 0.01) AS tol, "
    "contains(lower(coalesce(reason, '')), 'totals inconclusive') AS f FROM cases JOIN rr USING (file) LEFT JOIN es USING (case_id) LEFT JOIN acs USING (case_id)), "
    "tc AS (SELECT case_id, CAST(e AS DOUBLE) AS expected_sum, CAST(a AS DOUBLE) AS actual_sum, coalesce(abs(e - a) <= tol, false) AS reconciles, CASE WHEN e IS NULL OR t IS NULL THEN 'undeterminable' "
    "WHEN abs(e - t) <= tol OR coalesce(abs(e + x - t) <= tol, false) THEN CASE WHEN f THEN 'false_flag' ELSE 'correct_no_flag' END WHEN f THEN 'correctly_flagged' ELSE 'missed_problem' END AS totals_flag_class FROM tt)"
)


@query(f"WITH {_EXPECTED}, {_SUMS} SELECT * FROM tc")
def q_totals_class(spark, d):
    cases = cut_lineage(_cases(spark, d))
    found = scoring.totals_results(cases, read_table(spark, d, "invoices"), *_sides(spark, d, cases))
    return found.withColumns({c: F.col(c).cast("double") for c in ("expected_sum", "actual_sum")})


_CLASS = "CASE WHEN expected_needs_review IS NULL THEN 'n/a' WHEN expected_needs_review AND coalesce(flag, false) THEN 'TP' WHEN expected_needs_review THEN 'FN' WHEN coalesce(flag, false) THEN 'FP' ELSE 'TN' END"


@query(_CELLS + f" SELECT case_id, {_CLASS} AS review_class FROM rows")
def q_confusion(spark, d):
    rows = scoring.matched_results(_cases(spark, d), read_table(spark, d, "invoices").select("source_file", "needs_review"))
    return rows.select("case_id", scoring.review_class(F.col("expected_needs_review"), F.coalesce("r_needs_review", F.lit(False))).alias("review_class"))


def _ordered(value: str, name: str) -> str:
    return f"(SELECT file, string_agg(v, ', ' ORDER BY s) AS {name} FROM (SELECT file, {value} AS v, min(seq) AS s FROM uf WHERE {value} IS NOT NULL AND {value} <> '' GROUP BY 1, 2) GROUP BY 1)"


_COSTS = (
    f"{_USAGE}, {_META}, uf AS (SELECT *, {_base('source_file')} AS file FROM usage), "
    "us AS (SELECT file, count(*) AS requests, count(*) FILTER (WHERE attempt_type = 'primary') AS \"primary\", count(*) FILTER (WHERE attempt_type = 'repair') AS repair, count(*) FILTER (WHERE attempt_type = 'escalation') AS escalation, "
    + ", ".join(f"CAST(sum(coalesce({c}, 0)) AS BIGINT) AS {c}" for c in ("input_tokens", "output_tokens", "reasoning_tokens", "total_tokens"))
    + ", CAST(sum(coalesce(cost_usd, 0)) AS DOUBLE) AS reported_cost, count(*) FILTER (WHERE cost_usd IS NULL) AS unknown_cost_requests, sum(latency_ms) AS lat FROM uf GROUP BY 1), "
    "cc AS (SELECT case_id, " + ", ".join(f'coalesce("{c}", 0) AS "{c}"' for c in ("requests", "primary", "repair", "escalation", "input_tokens", "output_tokens", "reasoning_tokens", "total_tokens", "unknown_cost_requests", "reported_cost"))
    + ", coalesce(accepted_models, '') AS accepted_models, coalesce(routes, '') AS routes, coalesce(elapsed_seconds, round_even(lat / 1000, 3)) AS runtime_seconds, "
    "CASE WHEN elapsed_seconds IS NOT NULL THEN 'end_to_end' WHEN lat IS NOT NULL THEN 'provider_latency_only' ELSE 'unknown' END AS runtime_basis FROM cases LEFT JOIN us USING (file) "
    f"LEFT JOIN {_ordered('CASE WHEN accepted THEN coalesce(nullif(actual_model, chr(0)[1:0]), requested_model) END', 'accepted_models')} am USING (file) LEFT JOIN {_ordered('route', 'routes')} ro USING (file) LEFT JOIN meta USING (file))"
).replace("nullif(actual_model, chr(0)[1:0])", "nullif(actual_model, '')")


@query(f"WITH {_CASES}, {_COSTS} SELECT * FROM cc")
def q_case_cost(spark, d):
    return scoring.case_costs(_cases(spark, d), _usage(spark, d), _metadata(spark, d))


@query(f"WITH {_USAGE} SELECT source_file, count(*) AS total, count(*) FILTER (WHERE attempt_type = 'primary') AS \"primary\", count(*) FILTER (WHERE attempt_type = 'repair') AS repair, count(*) FILTER (WHERE attempt_type = 'escalation') AS escalation FROM usage GROUP BY 1")
def q_attempt_counts(spark, d):
    return usage.attempt_counts(_usage(spark, d))


@query(f"WITH {_USAGE} SELECT requested_model, count(*) FILTER (WHERE accepted) AS accepted FROM usage GROUP BY 1")
def q_accepted_by_model(spark, d):
    return usage.usage_summary(_usage(spark, d), ["requested_model"]).select("requested_model", "accepted")


@query(
    f"WITH {_USAGE} SELECT count(DISTINCT source_file) AS files, count(*) AS requests, count(*) FILTER (WHERE cost_usd IS NULL) AS unknown_cost_requests, count(*) > 0 AND count(*) FILTER (WHERE cost_usd IS NULL) < count(*) AS available, "
    "CAST(sum(cost_usd) AS DOUBLE) AS total, round_even(CAST(sum(cost_usd) AS DOUBLE) / count(DISTINCT source_file), 6) AS average, count(cost_usd) > 0 AND count(cost_usd) < count(*) AS incomplete FROM usage"
)
def q_cost_summary(spark, d):
    return usage.cost_summary(_usage(spark, d))


@query(f"WITH {_CASES} SELECT case_id, string_agg(k, ', ' ORDER BY k) AS fields FROM (SELECT DISTINCT case_id, k FROM (SELECT case_id, unnest(map_keys(it)) AS k FROM (SELECT case_id, unnest(line_items) AS it FROM cases)) WHERE k IN ('hs_code', 'unit', 'uom', 'currency')) GROUP BY 1 "
       "UNION ALL SELECT case_id, string_agg(k, ', ' ORDER BY k) FROM (SELECT case_id, unnest(map_keys(invoice)) AS k FROM cases) WHERE k IN ('ship_to', 'bill_to', 'incoterms', 'country_of_origin') GROUP BY 1")
def q_not_extractable(spark, d):
    found = scoring.not_extractable(_cases(spark, d)).where(F.size("fields") > 0)
    return found.select("case_id", F.array_join("fields", ", ").alias("fields"))


# ---- Cases and the report -------------------------------------------------------------------


def _results(spark: SparkSession, d: str):
    cases, invoices = cut_lineage(_cases(spark, d)), read_table(spark, d, "invoices")
    header = cut_lineage(scoring.header_cells(cases, invoices))
    cells, matches, expected, actual = _lines(spark, d, _matched(spark, d, cases))
    totals = scoring.totals_results(cases, invoices, expected, actual)
    costs = scoring.case_costs(cases, _usage(spark, d), _metadata(spark, d))
    kinds = invoices.where("source_file is not null").groupBy(text.basename(F.col("source_file")).alias("file")).agg(F.min("document_classification").alias("document_type"))
    results = scoring.case_results(cases, invoices, header, scoring.line_counts(matches), totals, costs).join(kinds, "file", "left").withColumn("document_type", F.coalesce("document_type", F.lit("unknown")))
    return cases, header, cells, matches, cut_lineage(results)


_HEAD = ", ".join(f"count(*) FILTER (WHERE outcome = '{o}') AS h_{o}" for o in scoring.OUTCOMES)
_REQUIRED = " AND ".join(f"{_null(f'r_{f}')} IS NOT NULL" for f in ("invoice_date", "currency", "seller_name", "total_amount"))
_CASE = (
    _LINE + ", " + _CELLS[_CELLS.index("rows AS ("):].replace("JOIN st ON c.case_id = st.case_id AND st.status = 'matched'", "JOIN ok ON c.case_id = ok.case_id") + f", {_SUMS}, {_COSTS}, "
    f"hd AS (SELECT case_id, {_HEAD}, bool_and(outcome = 'correct') AS ex FROM cells GROUP BY 1), kd AS (SELECT {_base('source_file')} AS file, min(document_classification) AS document_type FROM invoices WHERE source_file IS NOT NULL GROUP BY 1), "
    f"cr AS (SELECT cases.case_id, cases.file, CASE WHEN stat.n = 0 THEN 'missing_result' WHEN stat.n = 1 THEN 'matched' ELSE 'duplicate_result' END AS status, "
    f"coalesce({_OUTCOME.format(r='rows.reason', m='rows.method', f='rows.flag')}, 'none') AS oc, rows.case_id IS NOT NULL AS m, coalesce(ex, false) AS ex, "
    + ", ".join(f"coalesce(h_{o}, 0) AS h_{o}" for o in scoring.OUTCOMES)
    + f", {_REQUIRED} AS rq, coalesce(ln.expected, 0) AS l_e, coalesce(ln.actual, 0) AS l_a, coalesce(ln.matched, 0) AS l_m, coalesce(ln.missing, 0) AS l_s, coalesce(ln.extra, 0) AS l_x, coalesce(ln.all_lines_correct, true) AS l_ok, "
    f"totals_flag_class, CASE WHEN rows.case_id IS NULL THEN 'n/a' ELSE {_CLASS.replace('expected_needs_review', 'cases.expected_needs_review')} END AS review_class, cc.* EXCLUDE (case_id), coalesce(kd.document_type, 'unknown') AS document_type "
    "FROM cases JOIN stat USING (case_id) LEFT JOIN rows ON rows.case_id = cases.case_id LEFT JOIN hd ON hd.case_id = cases.case_id LEFT JOIN ln ON ln.case_id = cases.case_id LEFT JOIN tc ON tc.case_id = cases.case_id LEFT JOIN cc ON cc.case_id = cases.case_id LEFT JOIN kd ON kd.file = cases.file), "
    "cs AS (SELECT *, CASE WHEN m THEN oc ELSE 'none' END AS actual_outcome, m AND oc <> 'failed' AND l_s + l_x = 0 AND ex AND review_class IN ('TP', 'TN') AS passed FROM cr)"
)


@query(
    _CASE + " SELECT case_id, file, status, actual_outcome, " + ", ".join(f"CASE WHEN m THEN h_{o} END AS header_{o}" for o in scoring.OUTCOMES)
    + ", CASE WHEN m THEN ex END AS exact_header_match, CASE WHEN m THEN rq END AS required_complete, " + ", ".join(f"CASE WHEN m THEN {a} END AS lines_{b}" for a, b in (("l_e", "expected"), ("l_a", "actual"), ("l_m", "matched"), ("l_s", "missing"), ("l_x", "extra")))
    + ", CASE WHEN m THEN l_ok END AS all_lines_correct, totals_flag_class, review_class, requests, reported_cost, accepted_models, routes, runtime_seconds, runtime_basis, document_type, passed FROM cs"
)
def q_case_scores(spark, d):
    drop = ["lines_ambiguous", "lines_fuzzy", "expected_needs_review", "actual_needs_review", "review_categories", "unknown_clauses", "primary", "repair", "escalation", "input_tokens", "output_tokens", "reasoning_tokens", "total_tokens", "unknown_cost_requests", "not_extractable", "ignored_fields"]
    return _results(spark, d)[4].drop(*drop)


@query(
    _CASE + ", k AS (SELECT count(*) AS num_cases, count(*) FILTER (WHERE m) AS matched_cases, " + ", ".join(f"count(*) FILTER (WHERE m AND oc = '{o}') AS outcome_{o}" for o in ("extracted", "needs_review", "failed"))
    + ", count(*) FILTER (WHERE m AND ex) AS n_ex, count(*) FILTER (WHERE m AND rq) AS n_rq, sum(l_m) FILTER (WHERE m) AS lm_, sum(l_a) FILTER (WHERE m) AS la_, sum(l_e) FILTER (WHERE m) AS le_, count(*) FILTER (WHERE m AND l_ok) AS n_ok, "
    + ", ".join(f"count(*) FILTER (WHERE review_class = '{c}') AS review_{c.lower()}" for c in ("TP", "TN", "FP", "FN"))
    + ", round_even(sum(reported_cost), 6) AS total_reported_cost, CAST(sum(unknown_cost_requests) AS BIGINT) AS unknown_cost_requests, round_even(avg(runtime_seconds), 3) AS average_runtime_seconds, count(*) FILTER (WHERE passed) AS passed_cases FROM cs), "
    f"lt AS (SELECT count(*) AS n, count(*) FILTER (WHERE outcome = 'correct') AS c, count(*) FILTER (WHERE field IN ('quantity', 'unit_price', 'amount')) AS nn, count(*) FILTER (WHERE outcome = 'correct' AND field IN ('quantity', 'unit_price', 'amount')) AS nc FROM lc), "
    f"ht AS (SELECT count(*) AS n, count(*) FILTER (WHERE outcome = 'correct') AS c FROM cells), "
    f"z AS (SELECT *, {_RATIO.format(n='lm_', d='la_')} AS line_precision, {_RATIO.format(n='lm_', d='le_')} AS line_recall FROM k) "
    f"SELECT num_cases, matched_cases, outcome_extracted, outcome_needs_review, outcome_failed, {_RATIO.format(n='n_ex', d='matched_cases')} AS exact_header_match_rate, {_RATIO.format(n='n_rq', d='matched_cases')} AS required_field_completeness, line_precision, line_recall, "
    f"round_even(2 * line_precision * line_recall / nullif(line_precision + line_recall, 0), 4) AS line_f1, {_RATIO.format(n='n_ok', d='matched_cases')} AS invoice_all_lines_correct_rate, review_tp, review_tn, review_fp, review_fn, "
    f"{_RATIO.format(n='review_fp', d='(review_fp + review_tn)')} AS false_review_rate, {_RATIO.format(n='review_fn', d='(review_fn + review_tp)')} AS missed_problem_rate, total_reported_cost, unknown_cost_requests, average_runtime_seconds, passed_cases, "
    f"{_RATIO.format(n='ht.c', d='ht.n')} AS header_micro_accuracy, {_RATIO.format(n='lt.c', d='lt.n')} AS matched_line_field_accuracy, {_RATIO.format(n='lt.nc', d='lt.nn')} AS numeric_field_accuracy FROM z, lt, ht"
)
def q_report(spark, d):
    _, header, cells, _, results = _results(spark, d)
    drop = ["review_precision", "review_recall", "review_f1", "average_cost", "fuzzy_line_matches", "header_macro_accuracy", "header_cells_evaluated", "description_accuracy", "item_code_accuracy"]
    return report.report_metrics(results, header, cells).drop(*drop)


@query(
    _CASE + " SELECT document_type, count(*) AS cases, round_even(avg(reported_cost), 6) AS avg_cost, round_even(median(reported_cost), 6) AS median_cost, round_even(avg(runtime_seconds), 3) AS avg_runtime, round_even(median(runtime_seconds), 6) AS median_runtime, "
    "CASE WHEN count(runtime_seconds) >= 20 THEN round_even(quantile_cont(runtime_seconds, 0.95), 3) END AS p95_runtime, " + ", ".join(f"count(*) FILTER (WHERE m AND oc = '{o}') AS {o}" for o in ("extracted", "needs_review", "failed"))
    + ", CASE WHEN sum(reported_cost) > 0 THEN round_even(coalesce(sum(l_a) FILTER (WHERE m), 0) / sum(reported_cost), 2) END AS lines_per_dollar, CASE WHEN sum(runtime_seconds) > 0 THEN round_even(coalesce(sum(l_a) FILTER (WHERE m), 0) / (sum(runtime_seconds) / 60), 2) END AS lines_per_minute FROM cs GROUP BY 1"
)
def q_document_types(spark, d):
    return report.document_type_table(_results(spark, d)[4])


@query(_STATUS + f" SELECT case_id, file, CASE status WHEN 'duplicate_result' THEN 'duplicate_workbook_rows (' || n_results || ')' ELSE 'missing_workbook_result' END AS category FROM st WHERE status <> 'matched' "
       f"UNION ALL SELECT DISTINCT NULL, {_base('source_file')}, 'extra_workbook_source_file' FROM invoices WHERE source_file IS NOT NULL AND {_base('source_file')} NOT IN (SELECT file FROM cases WHERE file IS NOT NULL)")
def q_case_errors(spark, d):
    cases, invoices = _cases(spark, d), read_table(spark, d, "invoices")
    return report.case_errors(scoring.match_cases(cases, invoices), scoring.extra_sources(cases, invoices))


@query()
def q_report_summary(spark, d):
    """The Summary sheet with thresholds; its figures are those of q_report."""
    cases, header, cells, matches, results = _results(spark, d)
    rows = [("minimum_header_micro_accuracy", 0.9), ("maximum_false_review_rate", 0.2), ("maximum_average_cost_per_invoice", 5.0), ("minimum_nothing", 0.1), ("__doc__", 0.0)]
    errors = report.case_errors(scoring.match_cases(cases, read_table(spark, d, "invoices")), scoring.extra_sources(cases, read_table(spark, d, "invoices")))
    found = report.sheets(results, header, cells, matches, usage.model_table(_usage(spark, d)), errors, spark.createDataFrame(rows, "key string, target double"))
    return found["Summary"]
