import random

from tallyframe.llm import currency

LIST = [("EUR", "Euro", "euro area"), ("USD", "US dollar", "United States"), ("CAD", "Canadian dollar", "Canada"), ("DKK", "Danish krone", "Denmark"), ("NOK", "Norwegian krone", "Norway"), ("CNY", "Chinese yuan renminbi", "China"), ("CHF", "Swiss franc", "Switzerland")]
VALUES = {
    "EURO": "EUR", "en euros": "EUR", "E.U.R.": "EUR", "E U R": "EUR", "Euro (€)": "EUR", "Euor": "EUR", "EUR0": "EUR", "Euro, cents incl.": "EUR", "ＥＵＲ": "EUR", "UDS": "USD", "US-Dollar": "USD", "us dlolar": "USD",
    "dollars US": "USD", "US dollar, United States": "USD", "Camadian dollar": "CAD", "Danish Kroner": "DKK", "kroner": None, "kr": None, "$": None, "Taiwan dollar": None, "USD/EUR": None, "GBP and EUR": None,
    "THB": None, "tbd": None, "?": None, "C.N.Y.": "CNY", "CNY ¥": "CNY", "sFr": "CHF", "Swiss franc [CHF]": "CHF", "devise : EUR": "EUR", "all amounts in Swiss franc": "CHF", "x" * 5000: None,
}


def tables(spark, values):
    listed = spark.createDataFrame(LIST, "code string, currency_name string, area string")
    rows = spark.createDataFrame([(str(i), v, "c", "v") for i, v in enumerate(values)], "invoice_id string, currency string, code string, value string")
    return rows, listed


def test_values(spark):
    rows, listed = tables(spark, VALUES)
    got = {r.value: r.code for r in currency.map_values(rows, listed, "currency").collect()}
    assert got == VALUES


def test_invoices(spark):
    rows, listed = tables(spark, ["EUR", None, " ", "Euro", "Euro", "barter"])
    got = sorted(tuple(r) for r in currency.invoice_currencies(rows.union(rows), listed).collect())
    assert got == [("3", "EUR"), ("4", "EUR"), ("5", "UNMATCHED")]
    assert currency.invoice_currencies(rows.limit(0), listed).count() == 0
    assert {r.code for r in currency.invoice_currencies(rows, listed.limit(0)).collect()} == {"UNMATCHED"}


def tokens(t):
    p, seen, out = f"^{t}$", {}, set()
    out |= {p[i : i + 2] for i in range(len(p) - 1)}
    for c in t:
        if c != " ":
            seen[c] = seen.get(c, 0) + 1
            out.add(f"{c}#{seen[c]}")
    return out


def test_join_is_exact(spark):
    """The prefix filter loses no pair and the similarity is Jaccard."""
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab c") for _ in range(rng.randint(1, 9))).strip() or "a" for _ in range(120)]
    left, right = sorted(set(texts[:60])), sorted(set(texts[60:]))
    frames = [spark.createDataFrame([(t,) for t in x], "text string") for x in (left, right)]
    for threshold in (0.4, 0.8):
        got = {(r.text, r.other): round(r.jaccard, 9) for r in currency.similarity_join(*frames, threshold).collect()}
        want = {(a, b): j for a in left for b in right if (j := round(len(tokens(a) & tokens(b)) / len(tokens(a) | tokens(b)), 9)) >= threshold}
        assert got == want
