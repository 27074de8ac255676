"""Operators against sequential statements of their rules, on small or random inputs."""

import random
import unicodedata
from difflib import SequenceMatcher
from decimal import Decimal

from pyspark.sql import functions as F

from tallyframe.functions import text
from tallyframe.operators import invoices as inv
from tallyframe.operators import linkage, merge, numbering, pages, scoring, usage

ITEM = "struct<line_no:string,item_code:string,description:string,quantity:string,unit_price:string,amount:string>"
HEAD = "invoice_number:string,po_number:string,reference:string,invoice_date:string,currency:string,seller_name:string,seller_address:string,buyer_name:string,buyer_address:string,subtotal:string,tax_amount:string,total_amount:string,payment_terms:string"
ROUTES = f"route_id bigint, source_file string, route string, provider string, model string, route_seq int, pages array<int>, extracted_at timestamp, invoice struct<{HEAD},line_items:array<{ITEM}>>"


def route(rid, seq, page_list, head=None, items=(), provider="openrouter", model="m"):
    head = head or {}
    fields = [f.split(":")[0] for f in HEAD.split(",")]
    lines = [(None, None, *i) for i in items]
    return (rid, "dir/F.pdf", "text", provider, model, seq, page_list, None, (*[head.get(f) for f in fields], lines))


def test_merge_keeps_last_amount_and_first_text(spark):
    df = spark.createDataFrame([
        route(1, 1, [1], {"total_amount": "500.00", "invoice_number": "A", "seller_name": "Acme  Ltd"}), route(2, 2, [2], {"total_amount": "650.00", "invoice_number": "B", "seller_name": "acme ltd"}),
        route(3, 3, [], {"total_amount": "1"}), (4, None, "text", None, None, 1, [1], None, None),
    ], ROUTES)
    got = {r.field: (r.value, r.conflict) for r in merge.merge_headers(df).collect()}
    assert float(got["total_amount"][0]) == 650 and got["total_amount"][1]
    assert got["invoice_number"] == ("A", True) and got["seller_name"] == ("Acme  Ltd", False)
    c = merge.header_conflicts(df).collect()[0]
    assert c.fields == "invoice_number,total_amount" and c.several_invoices
    assert merge.merge_headers(df.limit(0)).count() == 0


def test_first_route_keeps_repeats_and_later_ones_do_not(spark):
    full, part = ("Freight", "1", "100", "100"), ("Freight", None, "100", "100")
    df = spark.createDataFrame([route(1, 1, [1], items=[full, full, part]), route(2, 2, [2], items=[("freight ", "1", "100.0", "100.00"), part, ("New", "1", "1", "1"), ("New", "1", "1", "1")])], ROUTES)
    kept = [(r.route_id, r.pos, r.kept) for r in merge.merged_lines(df).orderBy("route_id", "pos").collect()]
    assert kept == [(1, 0, True), (1, 1, True), (1, 2, True), (2, 0, False), (2, 1, True), (2, 2, True), (2, 3, False)]


def test_provider_labels(spark):
    df = spark.createDataFrame([route(1, 1, [1], model="a"), route(2, 2, [2, 3], model="b")], ROUTES)
    r = merge.provider_labels(df).collect()[0]
    assert (r.provider, r.model, r.pages) == ("openrouter", "multiple", "1-3")


def sequential_ladder(attempts, cap, limit, run_limit):
    """The rules said one attempt after the other."""
    made, spent_run = [], Decimal(0)
    for file in sorted({a[0] for a in attempts}):
        models, spent = 0, Decimal(0)
        for chunk in sorted({a[1] for a in attempts if a[0] == file}):
            for model in sorted({a[2] for a in attempts if a[:2] == (file, chunk)}):
                rows = {a[3]: a for a in attempts if a[:3] == (file, chunk, model)}
                if models >= cap or spent >= limit:
                    break
                models += 1
                done = False
                for k in (0, 1):
                    if k not in rows or (k == 1 and (0 not in rows or not rows[0][6] or models >= cap or spent >= limit)):
                        continue
                    made.append((file, chunk, model, k))
                    spent += rows[k][4] or 0
                    done |= rows[k][5]
                if done:
                    break
    return made


def test_ladder_and_file_budget(spark):
    rng = random.Random(5)
    rows = []
    for file in range(40):
        for chunk in range(rng.randint(1, 3)):
            for model in range(3):
                bad = rng.random() < 0.5
                rows.append((file, chunk, model, 0, Decimal(rng.randint(0, 4)) if rng.random() > 0.2 else None, not bad and rng.random() < 0.5, bad))
                if bad:
                    rows.append((file, chunk, model, 1, Decimal(rng.randint(0, 4)), rng.random() < 0.5, False))
    df = spark.createDataFrame(rows, "file int, chunk int, model_idx int, k int, cost decimal(28,10), accepted boolean, malformed boolean")
    got = sorted((r.file, r.chunk, r.model_idx, r.k) for r in usage.gate_files(usage.climb_ladder(df), 4, "6").collect())
    assert got == sorted(sequential_ladder(rows, 4, 6, None))
    assert usage.gate_run(usage.gate_files(usage.climb_ladder(df), 4, "6").select("file", "chunk", "model_idx", "k", "cost"), "0").count() == 0


def test_global_numbers_and_sums(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("v")).repartition(7)
    got = numbering.global_row_number(df, [F.col("v").asc()], "n").orderBy("n").collect()
    assert [r.n for r in got] == list(range(1, 1001)) and [r.v for r in got] == sorted(r.v for r in got)
    sums = numbering.global_running_sum(df, [F.col("v").asc()], "v", "s").orderBy("v").collect()
    total = 0
    for r in sums:
        assert r.s == total
        total += r.v


LINE = "case_id string, idx int, line_no string, item_code string, description string, quantity decimal(28,10), unit_price decimal(28,10), amount decimal(28,10)"


def test_line_tiers(spark):
    d = Decimal
    expected = spark.createDataFrame([("c", 0, "1", None, "Bolt", d(1), d(2), d(2)), ("c", 1, None, " 31c207 ", "Nut", d(1), d(1), d(1)), ("c", 2, None, None, "Big  Washer", d(3), d(1), d(3)), ("c", 3, None, None, "lost", None, None, None)], LINE)
    actual = spark.createDataFrame([("c", 0, None, "31C207", "nut", d(1), d(1), d(1)), ("c", 1, "1", None, "Bolt", d(1), d(2), d(2)), ("c", 2, None, None, "big washer", d(3), d(1), d(3)), ("c", 3, None, None, "more", None, None, None)], LINE)
    got = sorted(((r.expected_idx, r.actual_idx, r.method) for r in linkage.match_lines(expected, actual).collect()), key=str)
    assert got == sorted([(0, 1, "line_no"), (1, 0, "item_code"), (2, 2, "composite"), (3, None, "missing"), (None, 3, "extra")], key=str)


def test_choice_is_ordered_and_reports_near_ties():
    assert linkage.settle([(0, 3, 0.92), (0, 4, 0.95), (1, 4, 0.99), (2, 3, 0.91)]) == {0: (4, 0.95), 2: (3, 0.91)}
    assert linkage.settle([(0, 1, 0.91), (0, 2, 0.92), (1, 1, 0.95)]) == {0: (None, 0.92), 1: (1, 0.95)}


def test_near_descriptions_lose_nothing(spark):
    """The prefix filter finds the pairs that comparing every line with every line finds."""
    rng = random.Random(3)
    d, words = Decimal, ["steel bolt", "steel bolts", "stee1 bolt m8", "copper wire", "copper  Wire 2", "ＷＩＲＥ copper", "straße", "strasse", "aaaa", "aaab", "", None]
    make = lambda n: [("c%d" % rng.randint(0, 2), i, None, None, rng.choice(words), d(rng.randint(1, 2)), None, rng.choice([None, d(5), d("5.01"), d(7)])) for i in range(n)]
    e, a = make(40), make(40)
    fold = lambda t: " ".join(unicodedata.normalize("NFKC", t or "").casefold().split())
    want = set()
    for x in e:
        for y in a:
            s, t = fold(x[4]), fold(y[4])
            if x[0] == y[0] and s and t and x[5] == y[5] and (x[7] is None or y[7] is None or abs(x[7] - y[7]) <= d("0.01")) and round(SequenceMatcher(None, s, t).ratio(), 6) >= 0.8:
                want.add((x[0], x[1], y[1]))
    got = {(r.case_id, r.expected_idx, r.actual_idx) for r in linkage.near_descriptions(spark.createDataFrame(e, LINE), spark.createDataFrame(a, LINE), threshold=0.8).collect()}
    assert got == want and len(want) > 20


def test_ambiguous_lines_are_missing_too(spark):
    d = Decimal
    e = spark.createDataFrame([("c", 0, None, None, "widget one", d(1), None, d(5))], LINE)
    a = spark.createDataFrame([("c", 0, None, None, "widget onx", d(1), None, d(5)), ("c", 1, None, None, "widget ony", d(1), None, d(5))], LINE)
    got = sorted(r.method for r in linkage.match_lines_fuzzy(e, a).collect())
    assert got == ["ambiguous", "extra", "extra", "missing"]
    assert linkage.match_lines_fuzzy(e.limit(0), a.limit(0)).count() == 0


def test_cell_outcomes(spark):
    rows = [("text", None, " ", "correct"), ("text", None, "x", "unexpected"), ("text", "x", None, "missing"), ("text", "A  b", "a B", "correct"), ("number", "10", "10.01", "correct"), ("number", "10", "10.02", "incorrect"), ("date", "2025-01-01", " 2025-01-01 ", "correct")]
    for kind, e, a, want in rows:
        df = spark.createDataFrame([(e, a)], "e string, a string")
        assert df.select(scoring.cell_outcome(kind, F.col("e"), F.col("a")).alias("o")).collect()[0].o == want


def test_reconciliation_rules(spark):
    d = Decimal
    rows = [("tax", d(119), d(19), d(100), d(100), True), ("incl", d(228), None, None, d(228), True), ("sub", d(324), d(24), d(300), d(300), True), ("off", d(1120), d(95), d(1000), d(1000), False), ("none", None, d(1), d(1), d(1), None), ("nolines", d(1), None, None, None, None)]
    df = spark.createDataFrame(rows, "id string, total_amount decimal(28,10), tax_amount decimal(28,10), subtotal decimal(28,10), line_sum decimal(28,10), want boolean")
    assert all(r.got == r.want for r in df.withColumn("got", inv.reconciles()).collect())


def test_model_json(spark):
    rows = ['{"total_amount": 1e3, "currency": "€", "x": 1}', '```json\n{"total_amount": "1.234,5"}\n```', 'Sure: {"total_amount": true} ok', "[1]", "", None, "{broken"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, raw string").withColumn("v", inv.parse_model_json(F.col("raw")))
    got = {r.i: (r.ok, None if r.total_amount is None else float(r.total_amount), r.currency) for r in df.select("i", F.col("v").isNotNull().alias("ok"), *inv.typed_from_variant(F.col("v"))).collect()}
    assert got[0] == (True, 1000.0, "EUR") and got[1] == (True, 1234.5, None) and got[2] == (True, None, None)
    assert not any(got[i][0] for i in (3, 4, 5, 6))
    assert df.select(inv.unknown_keys(F.col("raw")).alias("k")).where("i = 0").collect()[0].k == ["x"]


def test_chunks_reject_nonsense_and_handle_empty(spark):
    empty = spark.createDataFrame([], "page_id bigint, source_file string, kind string, text string, number int, alnum_chars int")
    assert pages.page_chunks(empty, 2).count() == 0 and pages.tagged_text(empty).count() == 0
    try:
        pages.page_chunks(empty, 0)
    except ValueError:
        return
    raise AssertionError("a chunk size of 0 must be refused")


def test_review_categories(spark):
    reason = "totals inconclusive; odd thing: 5; conflict in seller_name: a; possible multiple invoices; conflict in invoice_number"
    df = spark.createDataFrame([(reason,), (None,), ("",)], "r string")
    got = df.select(scoring.review_categories(F.col("r")).alias("c"), scoring.unknown_clauses(F.col("r")).alias("u"), scoring.safe_categories(F.col("r")).alias("s")).collect()
    assert got[0].c == ["totals_inconclusive", "header_conflict", "invoice_number_conflict"] and got[0].u == ["odd thing"] and got[0].s[-1] == "unknown"
    assert got[1].s == [] and got[2].s == []


def test_identifiers_keep_inner_blanks(spark):
    for e, a, want in (("INV 01", "INV  01", "incorrect"), (" inv-01", "INV-01 ", "correct"), ("ＩＮＶ１", "inv1", "correct"), ("STRASSE", "straße", "correct")):
        df = spark.createDataFrame([(e, a)], "e string, a string")
        assert df.select(scoring.cell_outcome("identifier", F.col("e"), F.col("a")).alias("o")).collect()[0].o == want


def test_totals_class(spark):
    d = Decimal
    rows = [(None, d(1), None, True, "undeterminable"), (d(100), d(119), d(19), True, "false_flag"), (d(100), d(100), None, False, "correct_no_flag"), (d(1), d(2), None, True, "correctly_flagged"), (d(1), d(2), d(5), False, "missed_problem")]
    df = spark.createDataFrame(rows, "s decimal(28,10), t decimal(28,10), x decimal(28,10), f boolean, want string")
    out = df.withColumn("got", scoring.totals_class(F.col("s"), F.col("t"), F.col("x"), F.col("f"), F.lit(Decimal("0.01")))).collect()
    assert all(r.got == r.want for r in out)


def test_secrets_are_redacted(spark):
    df = spark.createDataFrame([("key abc and abcdef",), (None,)], "t string")
    assert [r.r for r in df.select(text.redact(F.col("t"), ["abc", "", "abcdef"]).alias("r")).collect()] == ["key [redacted] and [redacted]", None]
