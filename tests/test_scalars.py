from pyspark.sql import functions as F

from tallyframe.functions import numbers, text

DECIMALS = {
    "1,234.56": 1234.56, "1.234,56": 1234.56, "123,45": 123.45, "1,5": 1.5, "12,345": 12345, "1,2345": 12345, "1,2,3": 123, "1.234.567": None, "(1,000.00)": -1000,
    "(-5)": -5, "(0)": 0, "1.5e3": 1.53, "USD 99": 99, "1 234,56": 1234.56, "5-": None, "--5": None, ".": None, "n/a": None, "-": None, "": None, None: None, "€1,506.24": 1506.24,
}


def one(spark, col, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(col.alias("y")).collect()[0].y


def test_decimals(spark):
    df = spark.createDataFrame([(k,) for k in DECIMALS], "x string")
    got = {r.x: None if r.y is None else float(r.y) for r in df.select("x", numbers.coerce_decimal(F.col("x")).alias("y")).collect()}
    assert got == {k: None if v is None else float(v) for k, v in DECIMALS.items()}


def test_ratio_rounds_half_even_and_knows_zero(spark):
    r = spark.createDataFrame([(1, 8), (1, 0)], "a int, b int").select(numbers.ratio(F.col("a"), F.col("b")).alias("r")).collect()
    assert [x.r for x in r] == [0.125, None]


def test_page_ranges(spark):
    for pages, want in (([5, 1, 2, 2], "1-2,5"), ([3], "3"), ([], ""), ([1, 2, 3, 7, 9, 8], "1-3,7-9"), ([None, 2], "2")):
        assert one(spark, text.page_ranges(F.col("x")), pages, "array<int>") == want


def test_currency_and_blanks(spark):
    for raw, want in (("€", "EUR"), (" gbp ", "GBP"), ("$", "$"), ("Euro", "Euro"), ("  ", None), (None, None)):
        assert one(spark, text.normalize_currency(F.col("x")), raw) == want


def test_outer_braces_and_fences(spark):
    assert one(spark, text.outer_braces(F.col("x")), 'so {"a": {"b": 1}} done') == '{"a": {"b": 1}}'
    assert one(spark, text.outer_braces(F.col("x")), "} none {") is None
    assert one(spark, text.strip_code_fence(F.col("x")), '```json\n{"a": 1}\n```') == '{"a": 1}'


def test_file_names(spark):
    for raw, want in (("a\\b/Scan 1.PDF", "Scan_1.pdf"), ("..", "file.pdf"), ("x" * 100, "x" * 76 + ".pdf")):
        assert one(spark, text.sanitize_filename(F.col("x")), raw) == want


def test_flatten_truncate_every_document(spark, tmp_path):
    from tallyframe.plans import catalogue

    texts = [None, "", " a\tb\n c ", "Grüße  aus　Köln ", "price\x85€ 4", "a\x1c\x1fb\x0bc", "é漢 " * 60, "😀" * 81, "x" * 80, "​kept", "  "]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.flat for r in catalogue.queries()["q_flatten_truncate_all"](spark, str(tmp_path)).collect()}

    def flat(text):
        text = " ".join(text.split())
        return text[:80] + "...[truncated]" if len(text) > 80 else text

    assert got == {i: None if t is None else flat(t) for i, t in enumerate(texts)}
