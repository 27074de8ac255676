"""Queries of the llm problems and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.llm import abuse, addresses, currency, leakage, names, split, survivor, tokenize
from tallyframe.session import read_table


NAME_FIELDS = ["seller_name", "buyer_name"]
ADDRESS_FIELDS = ["seller_address", "buyer_address"]


def p1_found(spark, d):
    return names.linked_pairs(names.attributed_names(read_table(spark, d, "invoices"), NAME_FIELDS))


def p1_entities(spark, d):
    return names.entity_sizes(names.attributed_names(read_table(spark, d, "invoices"), NAME_FIELDS))


def p2_found(spark, d):
    return currency.invoice_currencies(read_table(spark, d, "invoices"), read_table(spark, d, "currency_list"))


def p2_values(spark, d):
    return currency.map_values(read_table(spark, d, "invoices"), read_table(spark, d, "currency_list"), "currency")


def p4_found(spark, d):
    return addresses.linked_addresses(read_table(spark, d, "invoices"), ADDRESS_FIELDS)


def p4_places(spark, d):
    return names.entity_sizes(addresses.attributed_addresses(read_table(spark, d, "invoices"), ADDRESS_FIELDS))


def p3_found(spark, d):
    return split.oversized_pages(read_table(spark, d, "page_infos"))


def p3_pieces(spark, d):
    return split.split_pages(read_table(spark, d, "page_infos"))


def p3_rebuilt(spark, d):
    return split.rebuilt_pages(read_table(spark, d, "page_infos"))


def p6_found(spark, d):
    best = survivor.best_representatives(read_table(spark, d, "route_results"), read_table(spark, d, "provider_trust"))
    return best.where(F.col("undisputed_route_id").isNotNull()).select(F.col("undisputed_route_id").alias("route_id"))


def p6_survivors(spark, d):
    return survivor.best_representatives(read_table(spark, d, "route_results"), read_table(spark, d, "provider_trust"))


def p6_survivor_fields(spark, d):
    """The survivors' header fields, each won by its votes."""
    best = p6_survivors(spark, d)
    return best.select("file_key", F.array_join("pages", ",").alias("page_list"), "n_rows", "provider", *[F.col(f"invoice.{f}").alias(f) for f in survivor.HEADER])


def p8_ids(spark, d):
    return tokenize.encode_documents(read_table(spark, d, "documents"))


def p9_found(spark, d):
    return p9_leaks(spark, d).select("doc_id", "item_id")


def p9_leaks(spark, d):
    return leakage.find_leaks(read_table(spark, d, "documents"), read_table(spark, d, "eval_items"))


def p10_found(spark, d):
    return abuse.score_documents(read_table(spark, d, "documents")).where("flagged").select("doc_id").distinct()


def p10_scores(spark, d):
    return abuse.score_documents(read_table(spark, d, "documents"))


def p10_rates(spark, d):
    return abuse.source_rates(read_table(spark, d, "documents"))


def queries():
    return {
        "p1_found": p1_found, "p1_entities": p1_entities, "p2_found": p2_found, "p2_values": p2_values, "p4_found": p4_found, "p4_places": p4_places,
        "p3_found": p3_found, "p3_pieces": p3_pieces, "p3_rebuilt": p3_rebuilt, "p6_found": p6_found, "p6_survivors": p6_survivors, "p6_survivor_fields": p6_survivor_fields, "p8_ids": p8_ids, "p9_found": p9_found, "p9_leaks": p9_leaks, "p10_found": p10_found, "p10_scores": p10_scores, "p10_rates": p10_rates,
    }


def _undisputed_sql() -> str:
    """Rows of each group that equal the group's best time, best trust and union of filled fields."""
    listed = ", ".join("'" + x.replace("'", "''") + "'" for x in survivor.PLACEHOLDERS)

    def stated(f: str) -> str:
        v = f"lower(regexp_replace(invoice.{f}, '^\\s+|\\s+$', '', 'g'))"
        near = " OR ".join(f"(abs(length({v}) - {len(w)}) <= 2 AND levenshtein({v}, '{w}') <= 2)" for w in ("unknown", "not stated"))
        return f"coalesce(NOT ({v} IN ({listed}) OR {near}), false) AS s_{f}"

    strip = lambda c: f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"
    key = strip(f"lower(regexp_extract(replace({strip('source_file')}, '\\', '/'), '([^/]*)$', 1))")
    best = ", ".join(f"bool_or(s_{f}) OVER g AS b_{f}" for f in survivor.HEADER)
    same = " AND ".join(f"s_{f} = b_{f}" for f in survivor.HEADER)
    rows = (
        f"SELECT route_id, extracted_at AS seen, coalesce(t.r, 2147483647) AS r, {key} AS k, list_sort(list_distinct(pages)) AS p, {', '.join(map(stated, survivor.HEADER))} FROM route_results "
        f"LEFT JOIN (SELECT lower({strip('provider')}) AS pr, min(trust_rank) AS r FROM provider_trust GROUP BY 1) t ON t.pr = lower({strip('route_results.provider')}) WHERE source_file IS NOT NULL AND pages IS NOT NULL"
    )
    return (
        f"SELECT min(route_id) AS route_id FROM (SELECT *, count(*) OVER g AS n, max(seen) OVER g AS mseen, min(r) OVER g AS mr, {best} FROM ({rows}) WINDOW g AS (PARTITION BY k, p)) "
        f"WHERE n >= 2 AND seen IS NOT DISTINCT FROM mseen AND r = mr AND {same} GROUP BY k, p"
    )


def _survivors_sql() -> str:
    """Votes by normalised value, the winner of each field, pivoted; the weights are said again here."""
    listed = ", ".join("'" + x.replace("'", "''") + "'" for x in survivor.PLACEHOLDERS)
    strip = lambda c: f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"
    key = strip(f"lower(regexp_extract(replace({strip('source_file')}, '\\', '/'), '([^/]*)$', 1))")
    squeezed = "regexp_replace(raw, '\\s+', ' ', 'g')"
    low = f"lower({strip('raw')})"
    near = " OR ".join(f"(abs(length({low}) - {len(w)}) <= 2 AND levenshtein({low}, '{w}') <= 2)" for w in ("unknown", "not stated"))
    fields = " UNION ALL ".join(f"SELECT k, p, w, '{f}' AS field, invoice.{f} AS raw FROM r" for f in survivor.HEADER)
    won = ", ".join(f"arg_max(raw, {{'v': coalesce(v, -1e9), 'n': norm}}) FILTER (WHERE field = '{f}') AS {f}" for f in survivor.HEADER)
    return (
        f"WITH r AS (SELECT {key} AS k, list_sort(list_distinct(pages)) AS p, lower({strip('route_results.provider')}) AS pr, invoice, "
        "pow(2.0, greatest(-500.0, least(500.0, coalesce((epoch_us(extracted_at) / 86400000000 - 18262.0) / 90.0, -500.0))) - (coalesce(t.r, 2147483647) - 1.0)) AS w FROM route_results "
        f"LEFT JOIN (SELECT lower({strip('provider')}) AS pr, min(trust_rank) AS r FROM provider_trust GROUP BY 1) t ON t.pr = lower({strip('route_results.provider')}) WHERE source_file IS NOT NULL AND pages IS NOT NULL), "
        f"l AS (SELECT k, p, w, field, raw, lower({strip(squeezed)}) AS norm FROM ({fields}) WHERE raw IS NOT NULL AND NOT ({low} IN ({listed}) OR {near})), "
        "a AS (SELECT k, p, field, norm, raw, w FROM l UNION ALL SELECT k, p, 'provider', pr, pr, w FROM r WHERE pr IS NOT NULL), "
        "v AS (SELECT k, p, field, norm, CASE WHEN sum(w) > 0 THEN round_even(log2(sum(w)), 6) END AS v, arg_max(raw, {'w': w, 'raw': raw}) AS raw FROM a GROUP BY ALL), "
        "g AS (SELECT k, p, count(*) AS n FROM r GROUP BY 1, 2 HAVING count(*) >= 2) "
        f"SELECT g.k AS file_key, array_to_string(g.p, ',') AS page_list, any_value(g.n) AS n_rows, arg_max(raw, {{'v': coalesce(v, -1e9), 'n': norm}}) FILTER (WHERE field = 'provider') AS provider, {won} "
        "FROM g LEFT JOIN v ON v.k = g.k AND v.p = g.p GROUP BY g.k, g.p"
    )


def oracle_sql():
    return {
        "p3_found": "SELECT page_id FROM page_infos WHERE length(text) > 2000",
        "p3_rebuilt": "SELECT page_id, md5(text) AS digest, true AS fits, true AS advances FROM page_infos WHERE text IS NOT NULL",
        "p6_found": _undisputed_sql(),
        "p6_survivor_fields": _survivors_sql(),
    }
