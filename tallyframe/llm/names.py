"""Variant spellings of the names of persons and firms (problem 1).

A noisy channel over distinct spellings. A spelling is parsed into its name element (the anchor),
what qualifies it (line of business or given name) and its legal form. Spellings that state
these in full are candidate canonical forms, ranked by frequency. Every spelling is attached to
the candidate of the greatest posterior: frequency prior times the likelihood of one slip in the
name, of an abbreviation, initial or nickname, and of a legal form left out.

Candidates are found by equi-joins on (name with at most one letter deleted, qualifier), so
names without a common element never meet and no group is compared pair by pair. Work is on
distinct spellings: a partner with a third of all rows costs one row.

Defined results: null and blank values are no case. Firms of one name element but another line
of business or another stated legal form are different, and so are persons and firms. A
spelling of nothing but the element is linked only if the element has a single partner.
``linked_pairs`` gives every pair of different stored values of one entity, as the result asks;
``attributed_names`` gives one row a value with the entity's id. Extra columns are not read.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.functions.text import strip
from tallyframe.llm.spelling import deletions, fold, is_subsequence, within_one
from tallyframe.session import cut_lineage

# Lines of business, folded.
TRADES = (
    "chemicals electronics machinery manufacturing backereibedarf instruments logistics trading textiles maschinenbau mobelwerke warehousing energie "
    "foods transports packaging distribution components furniture shipping construction pharmaceuticals printing engineering "
    "consulting services solutions technologies systems software plastics metals steelworks tools optics catering energy motors marine minerals "
    "imports exports insurance travel media publishing agriculture ceramics glassworks papers freightways spedition druckerei verpackungen elektrotechnik "
    "werkzeugbau lebensmittel metallbau emballages imprimerie meubles transportes muebles maquinaria alimentos"
).split()

# Given names and what they are shortened to, folded.
GIVEN = {
    "alexander": "alex sascha sasha sandy xander", "antonio": "toni tony tono anton", "dolores": "lola loli dolly", "edward": "ed eddie ned ted teddy",
    "elizabeth": "liz beth betty lizzie eliza bess", "francisco": "paco fran pancho kiko curro", "friedrich": "fritz fred fredi friedel",
    "guillaume": "guy gui guillou", "isabella": "bella isa izzy", "johannes": "hannes jo hans johann", "jose": "pepe pepito", "joseph": "joe jo sepp joey josef",
    "katharina": "kathi kathe katja kati katrin", "margaret": "maggie peggy meg greta marge", "michael": "mike mick micky michi", "richard": "rick dick rich richie",
    "robert": "rob bob bobby bert robbie", "susanne": "susi sanne suse", "theodore": "theo ted teddy", "thomas": "tom tommy", "wilhelmina": "mina willa minna wilma",
    "william": "bill will billy willy liam", "anna": "anni annie", "barbara": "babs barb", "benjamin": "ben benny", "catherine": "kate cathy katie",
    "charles": "charlie chuck", "christopher": "chris kit", "daniel": "dan danny", "david": "dave", "dorothea": "dora thea", "eleanor": "ellie nell nora",
    "frederick": "fred freddy", "george": "georgie", "gabriele": "gabi", "heinrich": "heinz heiner", "helena": "lena leni", "henry": "harry hank",
    "ignacio": "nacho", "james": "jim jimmy jamie", "jennifer": "jen jenny", "john": "johnny jack", "karl": "kalle", "laurence": "larry", "maria": "mia mitzi maruja",
    "manuel": "manolo manu", "matthew": "matt", "nicholas": "nick nicky", "patricia": "pat patty", "peter": "pete", "rafael": "rafa", "samuel": "sam sammy",
    "stephen": "steve", "sebastian": "basti", "victoria": "vicky", "walter": "wally walt", "rosario": "charo", "jean": "", "pierre": "", "marie": "", "juan": "", "carlos": "",
}

# Legal forms by their folded words without dots, longest first when read.
LEGAL = {
    "pty ltd": "pty", "pty limited": "pty", "proprietary limited": "pty", "ltd": "ltd", "limited": "ltd", "gmbh": "gmbh", "gesmbh": "gmbh", "mbh": "gmbh",
    "gesellschaft mit beschrankter haftung": "gmbh", "gesellschaft mbh": "gmbh", "ges mbh": "gmbh", "sarl": "sarl", "sa rl": "sarl", "s a rl": "sarl", "societe a responsabilite limitee": "sarl",
    "sl": "sl", "sociedad limitada": "sl", "sa": "sa", "societe anonyme": "sa", "sociedad anonima": "sa", "ag": "ag", "aktiengesellschaft": "ag",
    "kg": "kg", "kommanditgesellschaft": "kg", "oy": "oy", "oyj": "oy", "osakeyhtio": "oy", "inc": "inc", "incorporated": "inc", "llc": "llc",
    "limited liability company": "llc", "co": "co", "& co": "co", "and co": "co", "comp": "co", "company": "co", "corp": "corp", "corporation": "corp",
    "bv": "bv", "besloten vennootschap": "bv", "nv": "nv", "plc": "plc", "public limited company": "plc", "sas": "sas", "spa": "spa", "srl": "srl", "ohg": "ohg", "ug": "ug", "ab": "ab", "as": "as",
}
_LEGAL = {tuple(k.split()): v for k, v in LEGAL.items()}

# Words in front of a name that are no part of it.
ADDRESSED = {("accounts", "payable"), ("accounts", "receivable"), ("messrs",), ("m/s",), ("fa",), ("firma",), ("company",), ("the",), ("attn",), ("c/o",), ("z.hd.",), ("zhd",)}
TITLES = set("herr herrn frau mr mrs ms miss mister mme mlle monsieur madame sr sra srta senor senora don dona dr prof dipl ing".split())
GROUP = {"group", "gruppe", "groupe", "grupo", "holding"}

_NICK = {n: [g for g, short in GIVEN.items() if n in short.split()] for short in GIVEN.values() for n in short.split()}
_VOWELS = set("aeiou")
LN_SLIP, LN_ABBREVIATION, LN_SUBSEQUENCE, LN_NICK, LN_INITIAL, LN_NO_LEGAL, LN_BARE = -3.0, -1.5, -2.5, -1.5, -2.0, -0.5, -4.0
# A slip in the element. Swapped, doubled or dropped letters are so much commoner than two partners of one business (or
# given name) and legal form with such near elements that the more frequent element decides; another letter in place of
# one must be the rarer spelling by some measure, and another first letter by far, as it mostly makes another name.
LN_MOVED, LN_REPLACED, LN_FIRST_LETTER = -0.05, -0.3, -3.0


def element_slip(a: str, b: str) -> float | None:
    """Log likelihood of one slip between two elements; 0 for equal ones, None for more than one slip."""
    if a == b:
        return 0.0
    if not within_one(a, b):
        return None
    if len(a) != len(b) or sorted(a) == sorted(b):
        return LN_MOVED if a[0] == b[0] or a[1:2] == b[0] or a[0] == b[1:2] else LN_FIRST_LETTER
    return LN_REPLACED if a[0] == b[0] else LN_FIRST_LETTER


def _trade(token: str, dotted: bool) -> list[tuple[str, float]]:
    """Lines of business a token may stand for, with log likelihoods."""
    if token in TRADES:
        return [("t:" + token, 0.0)]
    slips = [("t:" + t, LN_SLIP) for t in TRADES if len(token) >= 4 and within_one(token, t)]
    few_vowels = sum(c in _VOWELS for c in token) <= 1
    out = list(slips)
    for t in TRADES:
        if slips and not dotted or len(token) < 3 or len(token) >= len(t) or token[0] != t[0]:
            continue
        stem = token[:-1] if token.endswith("s") and len(token) > 4 else token
        if t.startswith(stem) and (dotted or len(token) >= 4):
            out.append(("t:" + t, LN_ABBREVIATION))
        elif is_subsequence(token, t) and (dotted or few_vowels):
            out.append(("t:" + t, LN_SUBSEQUENCE))
        elif dotted and len(token) >= 5 and any(within_one(token, t[:k]) for k in (len(token) - 1, len(token), len(token) + 1)):
            out.append(("t:" + t, LN_ABBREVIATION + LN_SLIP))
    return out


def _given(token: str, dotted: bool) -> list[tuple[str, float]]:
    if len(token) == 1:
        return [("i:" + token, LN_INITIAL)]
    out = [("g:" + token, 0.0)] if token in GIVEN and not dotted else []
    out += [("g:" + g, LN_NICK) for g in _NICK.get(token, ())]
    if dotted and len(token) >= 3:
        out += [("g:" + g, LN_ABBREVIATION) for g in GIVEN if g.startswith(token)]
    if not out and len(token) >= 5:
        out = [("g:" + g, LN_SLIP) for g in GIVEN if within_one(token, g)]
    return out


def parse_name(name: str) -> tuple[str, str, list[tuple[str, float]], str]:
    """(kind, anchor, [(qualifier key, log likelihood)], legal form) of a stored value."""
    text = fold(name)
    raw = [w for w in re.split(r"[\s,;()\[\]\"“”„]+|(?<=[^\W\d_]{2})-(?=[^\W\d_])", text) if w]
    words = [(re.sub(r"[.'’`´]", "", w), bool(re.search(r"[.'’]", w))) for w in raw]
    words = [(w, d) for w, d in words if w and w != "-"]
    changed = True
    while changed and len(words) > 1:
        changed = False
        for lead in ADDRESSED:
            if len(words) > len(lead) and tuple(w for w, _ in words[: len(lead)]) == lead:
                words, changed = words[len(lead) :], True
    if len(words) > 2 or any(w in TITLES and w not in GIVEN for w, _ in words[:1]):
        words = [x for i, x in enumerate(words) if not (x[0] in TITLES and i == 0)] or words
    legal = ""
    kept: list[tuple[str, bool]] = []
    i = 0
    while i < len(words):
        for size in (4, 3, 2, 1):
            form = _LEGAL.get(tuple(w for w, _ in words[i : i + size])) if i + size <= len(words) else None
            if form and (len(words) > size):
                legal = legal or form
                i += size
                break
        else:
            kept.append(words[i])
            i += 1
    words = [x for x in kept if x[0] not in ("&", "and", "und", "et", "y")] or kept or words
    group = any(w in GROUP for w, _ in words) and len(words) > 1
    words = [x for x in words if x[0] not in GROUP] if group else words
    trades, givens, rest = [], [], []
    for w, dotted in words:
        given = _given(w, dotted)
        trade = [] if given and given[0][1] in (0.0, LN_NICK) or len(w) == 1 else _trade(w, dotted)
        if trade and (not given or max(trade, key=lambda x: x[1])[1] >= given[0][1] or legal):
            trades.append((w, trade))
        elif given:
            givens.append((w, given))
        else:
            rest.append(w)
    if not rest:  # every word is a known one: the last is the element
        pool = givens or trades
        rest = [pool.pop()[0]] if pool else [text.strip()]
    anchor = max(rest, key=lambda w: (len(w), w))
    others = sorted(w for w in rest if w != anchor)
    if trades:
        keys: dict[str, float] = {}
        for k, p in trades[0][1]:
            keys[k] = max(p, keys.get(k, p))
        return "firm", anchor, sorted(keys.items()), legal
    if legal or group:
        if others:
            return "firm", anchor, [("o:" + " ".join(others), 0.0)], legal
        return "firm", anchor, [("l:" + legal, LN_BARE)], legal
    if givens:
        return "person", anchor, sorted(dict(givens[0][1]).items()), ""
    if others:
        return "person", anchor, [("o:" + " ".join(others), 0.0)], ""
    return "bare", anchor, [("b:", LN_BARE)], ""


_PARSED = (
    T.StructType().add("kind", T.StringType()).add("anchor", T.StringType()).add("legal", T.StringType())
    .add("keys", T.ArrayType(T.StructType().add("key", T.StringType()).add("lp", T.DoubleType())))
    .add("near", T.ArrayType(T.StringType()))
)


@F.pandas_udf(_PARSED)
def _parse(names: pd.Series) -> pd.DataFrame:
    rows = []
    for name in names:
        kind, anchor, keys, legal = parse_name(name)
        rows.append((kind, anchor, legal, [{"key": k, "lp": p} for k, p in keys], deletions(anchor) if len(anchor) >= 4 else [anchor]))
    return pd.DataFrame(rows, columns=["kind", "anchor", "legal", "keys", "near"])


@F.pandas_udf(T.BooleanType())
def _near(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([within_one(x, y) for x, y in zip(a, b)], dtype=bool)


@F.pandas_udf(T.DoubleType())
def _slip(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([element_slip(x, y) for x, y in zip(a, b)], dtype=float)


def follow_pointers(pointers: DataFrame, key: str) -> DataFrame:
    """(key, to) with every ``to`` at the end of its chain; each round doubles the reach, until none changes.

    Two that point at each other end at the smaller id.
    """
    while True:
        step = pointers.select(F.col(key).alias("to"), F.col("to").alias("_next"))
        ahead = F.when(F.col("_next") == F.col(key), F.least(key, "to")).otherwise(F.col("_next"))
        moved = cut_lineage(pointers.join(step, "to").select(key, ahead.alias("_end"), "to"))
        pointers = moved.select(key, F.col("_end").alias("to"))
        if moved.where("_end <> to").isEmpty():
            return pointers


def spelling_counts(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(name, n) of the distinct non-blank values of the columns, pre-aggregated."""
    return (
        rows.select(F.explode(F.array(*[F.col(c) for c in columns])).alias("name"))
        .where(strip(F.col("name")) != "").groupBy("name").agg(F.count("*").alias("n"))
    )


def attributed_names(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(name, n, entity) of every distinct value; ``entity`` is the id of its canonical form."""
    parsed = spelling_counts(rows, columns).withColumn("p", _parse("name")).select("name", "n", "p.*")
    signed = cut_lineage(parsed.withColumn("sig", F.xxhash64("kind", "anchor", "legal", "keys.key")))
    signatures = signed.groupBy("sig").agg(
        F.first("kind").alias("kind"), F.first("anchor").alias("anchor"), F.first("legal").alias("legal"),
        F.max_by("keys", F.col("keys")[0]["lp"]).alias("keys"), F.first("near").alias("near"), F.sum("n").alias("n"),
    )
    popular = signatures.groupBy("kind", "anchor").agg(F.sum("n").alias("n_anchor"))
    signatures = cut_lineage(signatures.join(popular, ["kind", "anchor"]))

    # Candidate canonical forms state their qualifier in full; they can be reached by its abbreviated keys, too.
    key = F.col("keys")[0]["key"]
    # Where no spelling states it, an abbreviation of one reading stands in.
    full = (F.size("keys") == 1) & ~key.rlike("^[ilb]:")
    reach = F.array_compact(F.array(
        key,
        F.when(key.startswith("g:"), F.concat(F.lit("i:"), F.substring(key, 3, 1))),
        F.when((F.col("kind") == "person") & key.startswith("o:"), F.concat(F.lit("i:"), F.substring(key, 3, 1))),
        F.when((F.col("kind") == "firm") & (F.col("legal") != ""), F.concat(F.lit("l:"), F.col("legal"))),
    ))
    prior = F.ln(F.col("n")) * 0.1 + F.ln(F.col("n_anchor"))
    canon = (
        signatures.where(full)
        .select(F.col("sig").alias("c_sig"), F.col("kind"), F.col("anchor").alias("c_anchor"), F.col("legal").alias("c_legal"),
                (prior + F.col("keys")[0]["lp"]).alias("prior"), F.explode(reach).alias("key"), "near")
        .select("c_sig", "kind", "c_anchor", "c_legal", "prior", "key", F.explode("near").alias("form"))
    )
    variants = (
        signatures.select("sig", "kind", "anchor", "legal", F.inline("keys"), "near")
        .select("sig", "kind", "anchor", "legal", "key", "lp", F.explode("near").alias("form"))
    )
    agree = (F.col("legal") == F.col("c_legal")) | (F.col("legal") == "") | (F.col("c_legal") == "")
    met = (
        variants.join(canon, ["kind", "key", "form"]).where(agree)
        .groupBy("sig", "c_sig").agg(
            F.max("lp").alias("lp"), F.first("anchor").alias("anchor"), F.first("c_anchor").alias("c_anchor"), F.first("legal").alias("legal"),
            F.first("c_legal").alias("c_legal"), F.first("prior").alias("prior"))
        .withColumn("slip", F.when(F.col("anchor") == F.col("c_anchor"), 0.0).otherwise(_slip.asNondeterministic()("anchor", "c_anchor"))).where("slip is not null and not isnan(slip)")
    )
    posterior = (
        F.col("prior") + F.col("lp") + F.col("slip")
        + F.when(F.col("legal") != F.col("c_legal"), LN_NO_LEGAL).otherwise(0.0)
        + F.when(F.col("c_legal") == "", LN_NO_LEGAL * 2).otherwise(0.0)
    )
    best = met.groupBy("sig").agg(F.max(F.struct(F.bround(posterior, 9).alias("s"), "c_sig"))["c_sig"].alias("to"))
    pointers = cut_lineage(signatures.select("sig").join(best, "sig", "left").select("sig", F.coalesce("to", "sig").alias("to")))
    # A canonical form may itself be a slip of a likelier one.
    pointers = follow_pointers(pointers, "sig")
    # A bare element is the only partner of that element, if there is just one.
    bare = signatures.where("kind = 'bare'").select("sig", "anchor", F.explode("near").alias("form"))
    owners = canon.select("c_sig", "c_anchor", "form").distinct().join(pointers.select(F.col("sig").alias("c_sig"), "to"), "c_sig")
    sole = (
        bare.join(owners, "form").where((F.col("anchor") == F.col("c_anchor")) | _near("anchor", "c_anchor"))
        .groupBy("sig").agg(F.min("to").alias("lo"), F.max("to").alias("hi")).where("lo = hi").select("sig", F.col("lo").alias("owner"))
    )
    ends = pointers.join(sole, "sig", "left").select("sig", F.coalesce("owner", "to").alias("entity"))
    return signed.select("name", "n", "sig").join(ends, "sig").select("name", "n", "entity")


def linked_pairs(attributed: DataFrame, value: str = "name", left: str = "name_a", right: str = "name_b") -> DataFrame:
    """Every pair of different values of one entity, the smaller first; skewed entities are split by adaptive execution."""
    a = attributed.select("entity", F.col(value).alias(left))
    b = attributed.select("entity", F.col(value).alias(right))
    return a.join(b, "entity").where(F.col(left) < F.col(right)).select(left, right)


def entity_sizes(attributed: DataFrame) -> DataFrame:
    """(name, n, entity, canonical, n_spellings): one row a value, as the compact form of the links."""
    totals = attributed.groupBy("entity").agg(F.max_by("name", F.struct("n", "name")).alias("canonical"), F.count("*").alias("n_spellings"))
    return attributed.join(totals, "entity").select("name", "n", "canonical", "n_spellings")
