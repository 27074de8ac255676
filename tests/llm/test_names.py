from hypothesis import given, settings
from hypothesis import strategies as st

from tallyframe.llm import names
from tallyframe.llm.spelling import deletions, distance, within_one

ENTITIES = [
    ["Grekagrabro Bäckereibedarf Pty Ltd", "GREEKAGRABRO Backereibedarf", "Baeckereibedarf Grekagrabro Pty. Limited", "Messrs Grekagrabro Bäckereibedarf Pty Ltd"],
    ["Grekagrabro Maschinenbau Oy", "Masch.bau Grekagrabro"],
    ["Edward Grekagrabro", "Grekagrabro, E.", "GREKAGRABRO, Ned", "Mr Edward Grekagrabro"],
    ["Rukranudu Components Oy", "Rukranudu Cmpnts Oyj", "Rukranudu, Components (Oy)", "Rukranuu Compon.", "Rukranudu Components Oy "],
    ["Fabisara Shipping KG", "Fabisara-Group KG", "Fabisara"],
]


def frame(spark, values):
    return spark.createDataFrame([(v, None, 1) for v in values], "seller_name string, buyer_name string, name int")


def test_entities_and_pairs(spark):
    every = [n for e in ENTITIES for n in e]
    rows = frame(spark, every + [e[0] for e in ENTITIES] * 3 + [None, "", "  "])
    got = {}
    for r in names.attributed_names(rows, ["seller_name", "buyer_name"]).collect():
        got.setdefault(r.entity, set()).add(r.name)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, ENTITIES))
    pairs = names.linked_pairs(names.attributed_names(rows, ["seller_name", "buyer_name"])).collect()
    assert len(pairs) == sum(len(e) * (len(e) - 1) // 2 for e in ENTITIES) and all(r.name_a < r.name_b for r in pairs)
    compact = names.entity_sizes(names.attributed_names(rows, ["seller_name", "buyer_name"])).collect()
    assert len(compact) == len(set(every)) and {r.canonical for r in compact} == {e[0] for e in ENTITIES}


def test_empty_and_odd_values(spark):
    assert names.linked_pairs(names.attributed_names(frame(spark, []) if False else frame(spark, ["x"]).limit(0), ["seller_name", "buyer_name"])).count() == 0
    odd = ["-", "A", "GmbH", "..", "Herr", "x" * 20000, "Accounts Payable,", "株式会社", "& Co", "M. M."]
    assert names.attributed_names(frame(spark, odd), ["seller_name", "buyer_name"]).count() == len(odd)


@settings(max_examples=200, deadline=None)
@given(st.text("abc", max_size=6), st.text("abc", max_size=6))
def test_within_one_is_the_distance(a, b):
    assert within_one(a, b) == (distance(a, b) <= 1)
    if within_one(a, b):
        assert set(deletions(a)) & set(deletions(b))


def test_other_first_letters_and_long_chains(spark):
    """Another first letter makes another firm; a chain of slips ends at its most frequent form, however long it is."""
    rows = [("Baker Trading Ltd",)] * 20 + [("Maker Trading Ltd",)] * 10 + [("Bakker Trading Ltd",)] * 2
    df = spark.createDataFrame(rows, "a string")
    assert [tuple(r) for r in names.linked_pairs(names.attributed_names(df, ["a"])).collect()] == [("Baker Trading Ltd", "Bakker Trading Ltd")]
    chain = spark.createDataFrame([(i, min(i + 1, 40)) for i in range(41)], "sig bigint, to bigint")
    assert {r.to for r in names.follow_pointers(chain, "sig").collect()} == {40}
