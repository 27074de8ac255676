import datetime as dt

from tallyframe.llm.survivor import HEADER, best_representatives

ITEM = "struct<line_no:string,item_code:string,description:string,quantity:string,unit_price:string,amount:string>"
SCHEMA = "route_id bigint, source_file string, pages array<int>, provider string, extracted_at timestamp_ntz, invoice struct<" + ",".join(f"{f}:string" for f in HEADER) + f",line_items:array<{ITEM}>>, field string"


def row(rid, file, pages, provider, day, **head):
    at = None if day is None else dt.datetime(2025, 1, day)
    return (rid, file, pages, provider, at, (*[head.get(f) for f in HEADER], None), "x")


def run(spark, rows):
    trust = spark.createDataFrame([("manual_entry", 1), ("claude", 2), ("gemini", 2)], "provider string, trust_rank int")
    return best_representatives(spark.createDataFrame(rows, SCHEMA), trust).collect()


def test_winner_and_undisputed(spark):
    rows = [row(1, "A/x.pdf ", [2, 1, 2], " CLAUDE", 3, currency="EUR", total_amount="10", seller_name="Acme"), row(2, "X.PDF", [1, 2], "gemini", 2, currency="EUR", seller_name="n/a"), row(3, "y.pdf", [1], "gemini", 1, currency="EUR")]
    got = run(spark, rows)
    assert len(got) == 1 and got[0].undisputed_route_id == 1 and got[0].n_rows == 2 and got[0].pages == [1, 2]
    assert (got[0].invoice.currency, got[0].invoice.total_amount, got[0].invoice.seller_name, got[0].provider) == ("EUR", "10", "Acme", "claude")


def test_disputes_and_ties(spark):
    assert run(spark, [row(1, "f", [1], "claude", 2, currency="EUR"), row(2, "f", [1], "claude", 1, currency="EUR", reference="r")])[0].undisputed_route_id is None
    assert run(spark, [row(1, "f", [1], "nobody", 2, currency="EUR"), row(2, "f", [1], "claude", 1, currency="EUR")])[0].undisputed_route_id is None
    assert run(spark, [row(9, "f", [1], "claude", None), row(4, "f", [1], "Gemini ", None)])[0].undisputed_route_id == 4
    assert run(spark, [row(9, "f", [], "claude", 1), row(4, "f", [], None, 1)])[0].undisputed_route_id == 9


def test_votes_follow_trust_and_recency(spark):
    rows = [row(1, "f", [1], "manual_entry", 1, currency="CHF"), row(2, "f", [1], "gemini", 1, currency="EUR"), row(3, "f", [1], None, 1, currency="EUR")]
    assert run(spark, rows)[0].invoice.currency == "CHF"
    old = dt.datetime(2015, 1, 1)
    rows = [(*row(1, "f", [1], "manual_entry", 1, currency="CHF")[:4], old, row(1, "f", [1], None, 1, currency="CHF")[5], "x"), row(2, "f", [1], "gemini", 1, currency="EUR")]
    assert run(spark, rows)[0].invoice.currency == "EUR"


def test_nothing(spark):
    assert run(spark, [row(1, None, [1], "claude", 1), row(2, None, [1], "claude", 1), row(3, "f", None, "claude", 1), row(4, "f", None, "claude", 1)]) == []
    assert run(spark, []) == []
    empty = (1, "f", [1], None, None, None, "x")
    assert run(spark, [empty, (2, *empty[1:])])[0].undisputed_route_id == 1
