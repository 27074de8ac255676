"""Postal addresses written differently (problem 4).

Each distinct address is parsed into unit, house number, street, town, postcode, region and
country; words are expanded by the dictionaries of five locales and put into one order. Then
hierarchical keys join what denotes the same place:

1. number, street and town are equal (unit, country and postcode do not count; a postcode or
   country may be missing on either side);
2. number and town are equal, the streets are one slip apart;
3. number and street are equal, the towns are one slip apart.

Levels 2 and 3 are equi-joins on forms with at most one letter deleted, so no block is
compared pair by pair. Every place is attached to its most frequent spelling (of the street
and town over all rows).

Defined results: null and blank values are no case. A text without a house number, street or
town denotes only itself and texts of the same words. Two stated regions (US states) that
differ make two places. Extra columns are not read; repeated rows count into frequencies.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.llm.names import _near, follow_pointers, linked_pairs, spelling_counts
from tallyframe.llm.spelling import deletions, fold, within_one
from tallyframe.session import cut_lineage

# Street types by locale, folded, with their abbreviations.
TYPES_AFTER = {  # English: the type follows the name
    "road": "rd", "street": "st str strt", "square": "sq sqr", "lane": "ln la", "avenue": "ave av aven", "boulevard": "blvd boul bvd bd blv", "parkway": "pkwy pky pkway pwy",
    "drive": "dr drv", "court": "ct crt", "quay": "qy", "terrace": "ter terr", "crescent": "cres cr", "close": "cl", "highway": "hwy", "circle": "cir", "way": "wy",
    "alley": "aly", "place": "pl plc", "row": "", "mews": "", "trail": "trl", "turnpike": "tpke", "embankment": "embkmt",
}
TYPES_BEFORE = {  # French and Spanish: the type precedes the name
    "rue": "r", "avenue": "av ave aven", "boulevard": "boul bd bld blvd bvd", "place": "pl plce", "quai": "q", "chemin": "ch chem", "allee": "all", "impasse": "imp", "route": "rte",
    "calle": "c cl cll", "paseo": "ps po pso pg", "avenida": "avda avd", "plaza": "pza plz plza", "camino": "cno cmno", "carretera": "ctra crta", "ronda": "rda", "travesia": "trva",
}
TYPES_JOINED = {"platz": "pl pltz", "strasse": "str stra", "weg": "wg", "allee": "all", "gasse": "g gss", "ufer": "", "damm": "", "ring": "", "markt": "mkt", "chaussee": "ch"}  # German

# Countries as written, folded.
COUNTRIES = {
    "gb": "united kingdom|uk|u.k.|u k|great britain|england|gb|g.b.|britain|scotland|wales",
    "us": "usa|u.s.a.|u.s.a|us|u.s.|u.s|united states|united states of america|america",
    "de": "germany|deutschland|de|fed. rep. of germany|fed rep of germany|federal republic of germany|bundesrepublik deutschland|brd|allemagne|alemania",
    "fr": "france|fr|republique francaise|french republic|frankreich|francia|rep. francaise",
    "es": "spain|espana|es|reino de espana|kingdom of spain|spanien|espagne",
}
_COUNTRY = {name: code for code, names in COUNTRIES.items() for name in names.split("|")}
_COMPACT = {re.sub(r"[.\s]", "", name) for name in _COUNTRY}
_COUNTRY_LONG = sorted(_COUNTRY, key=len, reverse=True)

STATES = set(
    "al ak az ar ca co ct de fl ga hi id il in ia ks ky la me md ma mi mn ms mo mt ne nv nh nj nm ny nc nd oh ok or pa ri sc sd tn tx ut vt va wa wv wi wy dc".split()
)

# A unit, floor or part of a building, with its number or letter.
_UNIT = re.compile(
    r"\b(?:suite|ste|unit|apt|apartment|flat|room|rm|dock|gate|bay|building|bldg|block|tower|floor|fl|level|tor|halle|lager|aufgang|whg|wohnung|stock|haus|"
    r"bat|batiment|bt|etage|escalier|esc|porte|hall|local|nave|piso|planta|puerta|pta|bajo|portal|escalera|oficina|of|entrepot|warehouse|lagerhaus|almacen|hangar|depot|shed|pier|zimmer|bureau)\b\.?\s*(?:no\.?\s*)?(?:\d+\s*[a-z]?|[a-z])?\b"
    r"|\b\d+\s*(?:st|nd|rd|th|e|er|eme|ieme)\s+(?:floor|fl|etage|level)\b\.?|\b\d+\.?\s*(?:og|ug|stock|etage|obergeschoss)\b\.?|\b(?:eg|dg|og)\b"
    r"|\b(?:rear|front|side|annex)\s+(?:building|bldg|entrance)\b|\bhinterhaus\b|\bvorderhaus\b|\bseitenflugel\b|\bpostfach-?\s*annahme\b|\brez-de-chaussee\b"
    r"|\b\d+\s*[oa]?\.?\s*(?:izq|dcha|der|centro)\b\.?|\b(?:ground|first|second|third|top)\s+floor\b"
)
_UK_POST = re.compile(r"\b([a-z]{1,2}\d[a-z\d]?)\s*(\d[a-z]{2})\b")
_US_POST = re.compile(r"\b([a-z]{2})[\s.]+(\d{5})(?:-\d{4})?\b")
_POST = re.compile(r"\b(?:(?:de|d|fr|f|es|e)\s*-\s*)?(\d{5})\b")
_SEGMENT = re.compile(r"[,;\n\r|]+|\s[-–—/]\s|\s/|/\s")
_NUMBER = re.compile(r"^(\d+)([a-z]?)$")
_MARK = re.compile(r"^(?:no|nr|n|num|numero|number|hausnr|hnr|n°|°)$")

_AFTER = {a: k for k, v in TYPES_AFTER.items() for a in [k, *v.split()]}
_BEFORE = {a: k for k, v in TYPES_BEFORE.items() for a in [k, *v.split()]}
_SHARED = {"av": "avenida", "ave": "avenida", "pl": "plaza"}  # abbreviations that mean a Spanish type if the number stands behind
_JOINED = {a: k for k, v in TYPES_JOINED.items() for a in [k, *v.split()]}


def _type(word: str, table: dict[str, str]) -> str | None:
    if word in table:
        return table[word]
    return next((full for full in table.values() if len(full) >= 5 and len(word) >= 5 and within_one(word, full)), None)


def _is_street_word(word: str) -> bool:
    return bool(_type(word, _AFTER) or _type(word, _BEFORE)) or any(len(word) > len(x) + 2 and len(x) > 1 and word.endswith(x) for x in _JOINED)


def _street(words: list[str], number_behind: bool = False) -> tuple[str, list[str]]:
    """(street in one order, words behind it) of the words of a street without its number.

    Where the number stands behind the street, a type behind the name is a German one.
    """
    if not words:
        return "", []
    first = _type(words[0], _BEFORE)
    if number_behind and words[0] in _SHARED:
        first = _SHARED[words[0]]
    if first and len(words) > 1:
        return f"{first} {words[1]}", words[2:]
    for i in range(1, len(words)):
        joined = words[i] in ("platz", "strasse", "weg", "allee", "gasse", "ufer", "damm", "ring", "markt")
        if joined or (number_behind and words[i] in _JOINED):
            return "".join(words[:i]) + _JOINED[words[i]], words[i + 1 :]
        kind = _type(words[i], _AFTER)
        if kind:
            return " ".join([*words[:i], kind]), words[i + 1 :]
    word = words[0]
    for short in sorted(_JOINED, key=len, reverse=True):
        if len(word) > len(short) + 2 and word.endswith(short) and len(short) > 1:
            return word[: -len(short)] + _JOINED[short], words[1:]
    return word, words[1:]


def parse_address(value: str) -> tuple[str, str, str, str, str]:
    """(number, street, town, postcode, region), each '' where the text does not give it."""
    text = fold(value)
    text = re.sub(r"\bc/\s*", "calle ", text)
    text = re.sub(r"#\s*(?=\d)", " ", text)
    text = re.sub(r"\b(?:p\.?\s?o\.?)(?=\s+[a-z])", "po", text) if text.startswith("p") else text
    parts = [p.strip(" .-") if p.strip(" .-") else "" for p in _SEGMENT.split(text)]
    segments = []
    for p in parts:
        p = " ".join(p.split())
        if p and re.sub(r"[.\s]", "", p) not in _COMPACT:
            segments.append(p)
    if not segments:
        return "", "", " ".join(text.split()), "", ""
    # A country without its own segment stands last, rarely first.
    for name in _COUNTRY_LONG:
        bare = name.rstrip(".")
        for end in {name, bare}:
            if segments[-1].endswith(" " + end):
                segments[-1] = segments[-1][: -len(end) - 1].strip()
                break
        else:
            continue
        break
    post = region = ""
    cleaned: list[str] = []
    for s in segments:
        s = _UNIT.sub(" ", s)
        if m := _US_POST.search(s):
            if m[1] in STATES:
                region, post = m[1], m[2]
                s = s[: m.start()] + "," + s[m.end() :]
        if not post and (m := _UK_POST.search(s)):
            post = m[1] + m[2]
            s = s[: m.start()] + "," + s[m.end() :]
        if not post and (m := _POST.search(s)):
            post = m[1]
            s = s[: m.start()] + "," + s[m.end() :]
        cleaned += [x for x in (" ".join(p.split()) for p in s.split(",")) if x.strip(" .-")]
    numbered, others = None, []
    tokens = []
    for s in cleaned:
        words = [w for w in re.split(r"[\s]+|(?<=[a-z]{3})-(?=[a-z])|(?<=[a-z]{3})-(?=\d)", s) if w]
        words = [w.strip(".°'’`()") for w in words]
        words = [w for w in words if w and not _MARK.match(w)]
        tokens.append((s, words, [i for i, w in enumerate(words) if _NUMBER.match(w)]))
    # The street is the part with a number and a street type, else the first with a number.
    street_at = next((k for k, (_, words, at) in enumerate(tokens) if at and any(_is_street_word(w) for w in words)), None)
    if street_at is None:
        street_at = next((k for k, (_, _, at) in enumerate(tokens) if at), None)
    for k, (s, words, at) in enumerate(tokens):
        if k == street_at:
            numbered = (words, at)
        elif s in STATES and not region:
            region = s
        elif words:
            others.append(re.sub(r"[^\w]+", " ", s).strip())
    if numbered is None:
        return "", "", " ".join(others), post, region
    words, at = numbered
    i = at[0]
    m = _NUMBER.match(words[i])
    number, j = m[1].lstrip("0") + m[2], i + 1
    if not m[2] and j < len(words) and len(words[j]) == 1 and words[j].isalpha() and (i > 0 or (j + 1 < len(words) and not _type(words[j], _BEFORE))):
        number += words[j]
        j += 1
    if i == 0:
        street, tail = _street(words[j:])
    else:
        street, left = _street(words[:i], True)
        tail = left + words[j:]
    town = " ".join([*others, " ".join(tail)]).strip()
    return number, street, " ".join(town.replace("-", " ").split()), post, region


_PARSED = T.StructType()
for _f in ("number", "street", "town", "post", "region"):
    _PARSED = _PARSED.add(_f, T.StringType())


@F.pandas_udf(_PARSED)
def _parse(values: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse_address(v) for v in values], columns=["number", "street", "town", "post", "region"])


@F.pandas_udf(T.ArrayType(T.StringType()))
def _deletions(words: pd.Series) -> pd.Series:
    return words.map(deletions)


def attributed_addresses(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(name, n, entity) of every distinct address; ``entity`` is the id of its place."""
    parsed = spelling_counts(rows, columns).withColumn("p", _parse("name")).select("name", "n", "p.*")
    complete = (F.col("number") != "") & (F.col("street") != "") & (F.col("town") != "")
    loose = F.regexp_replace(F.lower("name"), r"(?U)[^\p{L}\p{N}]+", "")
    keyed = parsed.withColumn(
        "place",
        F.when(complete, F.xxhash64("number", "street", "town", "region")).otherwise(F.xxhash64(F.lit("text"), loose)),
    ).withColumn("complete", complete)
    signed = cut_lineage(keyed)
    places = (
        signed.where("complete").groupBy("place")
        .agg(F.first("number").alias("number"), F.first("street").alias("street"), F.first("town").alias("town"), F.first("region").alias("region"), F.sum("n").alias("n"))
    )
    spelled = places.groupBy("street", "town").agg(F.sum("n").alias("n_street"))
    places = cut_lineage(places.join(spelled, ["street", "town"]))
    prior = F.struct("n_street", "n", "place")

    def near(same: str, loose_part: str) -> DataFrame:
        """Pairs that agree in the number and one part and are one slip apart in the other."""
        one = places.select("place", "number", F.col(same), F.col(loose_part).alias("x"), "region", prior.alias("w"), F.explode(_deletions(F.col(loose_part))).alias("form"))
        two = one.select(F.col("place").alias("to"), "number", same, F.col("x").alias("y"), F.col("region").alias("to_region"), F.col("w").alias("to_w"), "form")
        return (
            one.join(two, ["number", same, "form"]).where((F.col("to_w") > F.col("w")) & _agree("region", "to_region"))
            .select("place", "to", "x", "y", "to_w").dropDuplicates(["place", "to"])
            .where((F.col("x") == F.col("y")) | _near("x", "y")).select("place", "to", "to_w")
        )

    def _agree(a: str, b: str):
        return (F.col(a) == F.col(b)) | (F.col(a) == "") | (F.col(b) == "")

    better = near("town", "street").unionByName(near("street", "town"))
    best = better.groupBy("place").agg(F.max_by("to", "to_w").alias("to"))
    pointers = cut_lineage(places.select("place").join(best, "place", "left").select("place", F.coalesce("to", "place").alias("to")))
    pointers = follow_pointers(pointers, "place")
    return signed.join(pointers, "place", "left").select("name", "n", F.coalesce("to", "place").alias("entity"))


def linked_addresses(rows: DataFrame, columns: list[str]) -> DataFrame:
    return linked_pairs(attributed_addresses(rows, columns), "name", "address_a", "address_b")
