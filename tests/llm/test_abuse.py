import itertools
import os
import random
import re

import pytest
from conftest import DATA

from tallyframe.llm import abuse
from tallyframe.llm.abuse import PATTERNS, THRESHOLD, _build, _possible, _word_bits, score_clause, score_documents, score_lattice, score_text, source_rates

BAD = [
    ("abusive", "What a crooked little rat you are."), ("abusive", "Fuuuuck off, bl00d$uck1ng leech"), ("abusive", "I will find out where you live and break your legs"), ("abusive", "Du mieses Arschl*ch"),
    ("abusive", "V o u s êtes une bande de connards"), ("abusive", "Vete a la mierda, idiota"), ("abusive", "Nobody likes you"), ("hateful", "The Zutoruno tribe are a disease and you know it"), ("hateful", "Send foreigners back where they came from"),
    ("hateful", "Les étrangers comme vous sont de la vermine"), ("sexual", "Show me yourtits on the next call"), ("sexual", "Mándame fotos desnuda y pago"), ("sexual", "co​me to my hotel room tonight"),
]
GOOD = [
    "Rat poison, 57 kg, class 6.1, vermin control.", "Bastard-cut files, 91 pieces, were short delivered.", "The idiot-proof carton seal works as described.", "The pig iron and the dumb waiter were invoiced together.",
    "Our policy bans hateful or sexual remarks towards staff.", "Abusive language in this chat leads to a closed ticket.", "We will take you to court if EUR 4 is not paid.", "I hate to chase you, but EUR 3 is overdue.",
    "Foreign workers' visa fees are billed separately.", "Please strip the cable ends 49 mm before crimping.", "The screw is cock-eyed and the nipple of the grease gun broke.", "Le transporteur signale un retard de 7 heures.", "They killed the deal.", "",
]


@pytest.mark.parametrize("kind,text", BAD)
def test_cases(kind, text):
    assert dict(zip(("abusive", "hateful", "sexual"), score_text(text)))[kind] >= THRESHOLD


@pytest.mark.parametrize("text", GOOD)
def test_harmless(text):
    assert sum(score_text(text)) < THRESHOLD


def test_discounts():
    assert sum(score_text("The clerk was not an idiot")) < THRESHOLD and sum(score_text("He said the driver called him an idiot.")) < THRESHOLD


def test_labelled_sample(spark):
    if not os.path.isdir(DATA):
        pytest.skip("no test tables here")
    rows = spark.read.parquet(f"{DATA}/content_examples.parquet").collect()
    right = sum((sum(score_text(r.text)) >= THRESHOLD) == (r.category != "clean") for r in rows)
    assert right / len(rows) >= 0.97


def test_tables(spark):
    rows = [(1, "you idiot", "chat", 1), (2, None, "chat", 1), (3, "", None, 1), (1, "you idiot", "chat", 1), (4, "clean text " * 20000, None, 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, score int")
    assert sorted((r.doc_id, r.flagged) for r in score_documents(df).collect()) == [(1, True), (1, True), (2, False), (3, False), (4, False)]
    rates = {r.source: (r.n_documents, r.n_flagged, r.rate) for r in source_rates(df).collect()}
    assert rates == {"chat": (3, 2, 0.666667), None: (2, 0, 0.0)}
    assert source_rates(df.limit(0)).count() == 0


@pytest.mark.parametrize("text", ["You will die", "You need to die", "Send those people back", "Keep those people out", "Those people have no place in this country"])
def test_common_words_alone(text):
    assert sum(score_text(text)) >= THRESHOLD


def test_prefilter_loses_nothing():
    rng, words = random.Random(7), sorted(set(re.findall("[a-z]+", " ".join(_build(p) for _, _, p in PATTERNS))))
    hits = 0
    for _ in range(6000):
        clause = " ".join(rng.choice(words) for _ in range(rng.randint(2, 9)))
        found = 0
        for w in clause.split():
            found |= _word_bits(w)
        assert score_clause(clause, _possible(found)) == score_clause(clause)
        hits += bool(score_clause(clause))
    assert hits > 100


@pytest.mark.parametrize("text", [
    "Your quote is a joke, you stupid idiots", "Stop your harassment you filthy bastard", "The word is out, you are a bastard",
    "The driver said the parcels for hall 4 would be at the gate by nine this morning and I will break your legs",
    "Our code of conduct was sent with the last delivery of paper and toner for the three offices in the north, go to hell",
])
def test_discounts_do_not_hide_what_they_do_not_govern(text):
    assert sum(score_text(text)) >= THRESHOLD


@pytest.mark.parametrize("text", ["Our code of conduct forbids calling a colleague an idiot", "The clerk is not an idiot", "I am not an idiot", "Calling people idiots is forbidden", "She wrote that the guard is a bastard"])
def test_governed_words_stay_discounted(text):
    assert sum(score_text(text)) < THRESHOLD


@pytest.mark.parametrize("text", ["the wh*re at your desk put ** urgent ** on it", "** ** ** ** ** ** ** you stupid wh*re", "showmeyourtits"])
def test_masks_and_glued_words_without_cap(text):
    assert sum(score_text(text)) >= THRESHOLD


def test_lattice_equals_all_readings():
    rng, words = random.Random(11), sorted(set(re.findall("[a-z]{2,}", " ".join(_build(p) for _, _, p in PATTERNS))))
    every, hits = tuple(range(len(PATTERNS))), 0
    for _ in range(150):
        readings = [tuple(rng.choice(words) for _ in range(rng.choice([1, 1, 2, 4]))) for _ in range(rng.randint(2, 5))]
        best = {}
        for clause in itertools.product(*readings):
            for kind, weight in score_clause(" ".join(clause)).items():
                best[kind] = max(best.get(kind, 0.0), weight)
        assert score_lattice(readings, every) == best, readings
        hits += bool(best)
    assert hits > 20


def test_words_that_insult_only_in_company():
    for text in ("push the code to the git repository", "Jamaican jerk marinade", "Dick Jansen, Rotterdam office", "Familie Penner", "you absolute star", "what a useless invoice"):
        assert sum(abuse.score_text(text)) < abuse.THRESHOLD, text
    for text in ("you jerk", "what a stupid git", "you absolute plonker", "You idiot, report me for harassment if you like"):
        assert sum(abuse.score_text(text)) >= abuse.THRESHOLD, text


def test_weights_differ_by_gravity():
    assert abuse.score_text("You will die")[0] > abuse.score_text("you jerk")[0]


def test_key_parts_lose_no_rule():
    """The rules found by key parts are those found by trying every alternative."""
    runs, needs = abuse._required()
    rules = len(abuse.PATTERNS)
    for text in ("you are a lazy cow", "shut your mouth", "send those people back", "the invoice is overdue", "i will break your legs", "a bastard cut file for you idiots"):
        found = 0
        for word in text.split():
            found |= abuse._word_bits(abuse._squeeze(word))
        slow = {k for k, ways in enumerate(needs) if any(need & ~found == 0 for need in ways)}
        assert set(abuse._possible(found)) == {k for k in slow if k < rules}
        assert set(abuse._softened(found)) == {k - rules for k in slow if k >= rules}
