import random

from tallyframe.llm import leakage

WORDS = [f"w{a}{b}" for a in "abdfghjk" for b in "mnprtuvx"]


def passage(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def frames(spark, docs, items):
    d = spark.createDataFrame([(i, t, 1.0) for i, t in docs], "doc_id bigint, text string, share double")
    return d, spark.createDataFrame([(i, p, "q") for i, p in items], "item_id bigint, passage string, question string")


def test_found_however_it_is_laid_out(spark):
    rng = random.Random(1)
    items = [(i, passage(rng, 80)) for i in range(5)] + [(9, None), (10, "")]
    noise = lambda: passage(rng, 60)
    p = items[0][1].split()
    docs = [
        (1, noise() + " " + items[0][1] + " " + noise()), (2, "\n".join(x.upper() for x in p)), (3, " ".join(p[:42])), (4, " ".join(p[:25]) + " " + noise() + " " + " ".join(p[50:75])),
        (5, " ".join(p[:15])), (6, noise()), (7, None), (8, ""), (9, " ".join(w if i % 11 else "changed" for i, w in enumerate(p))), (10, " ".join(p[i] for i in range(0, 80, 2))), (1, noise() + " " + items[0][1]),
    ]
    got = {(r.doc_id, r.item_id) for r in leakage.find_leaks(*frames(spark, docs, items)).collect()}
    assert got == {(d, 0) for d in (1, 2, 3, 4, 9)}


def test_filters_lose_nothing(spark):
    """With and without prefix and bounds the same documents are found; blocks of items change nothing."""
    rng = random.Random(7)
    items = [(i, passage(rng, rng.randint(20, 60))) for i in range(12)]
    docs = []
    for d in range(80):
        w = rng.choice(items)[1].split()
        a, b = sorted(rng.sample(range(len(w) + 1), 2))
        docs.append((d, passage(rng, rng.randint(0, 30)) + " " + " ".join(w[a:b]) + " " + passage(rng, 10)))
    index = leakage.ItemIndex(items)
    plain = set()
    for d, t in docs:
        hits = {}
        for p, s in index.shingles(leakage.words_of(t)):
            for i, q in index.places[s]:
                hits.setdefault(i, []).append((p, q))
        plain |= {(d, i) for i, h in hits.items() if leakage.covered_share(h, len(index.words[i]), 5, 8, 3) >= 0.5}
    for block in (500_000, 50):
        assert {(r.doc_id, r.item_id) for r in leakage.find_leaks(*frames(spark, docs, items), block_words=block).collect()} == plain


def test_empty_tables(spark):
    d, i = frames(spark, [(1, "a b c")], [(1, "a b c d e f g h i j")])
    assert leakage.find_leaks(d.limit(0), i).count() == 0 and leakage.find_leaks(d, i.limit(0)).count() == 0


def test_words_survive_scanning():
    assert leakage.words_of("The premiurn of 0ffice­ chairs, deliv-\nered") == leakage.words_of("the premium of office chairs delivered")
