"""Mapping free-entered values to a canonical list (problem 2).

A prefix-filter set-similarity join: values and the known spellings of the list's entries become
sets of character tokens, tokens are ordered by their rarity over both sides, only the rare
prefix of each set is joined, length and positional bounds discard candidates, Jaccard is
verified exactly, and the best entry is kept. An exact check follows: every word of the value
must be a word of the spelling, up to one typing slip.

A value that names several entries ("USD/EUR"), fits several equally well ("kroner", "$") or
none ("THB") is ``UNMATCHED``. Only distinct values are joined, so a hot value costs one row;
the way back to the rows is a plain equi-join that adaptive execution may broadcast by its
measured size or split if skewed.

Defined results: null and blank values and exact codes are no case. Repeated rows give one row
an invoice and code. Extra columns are not read. An empty list leaves every value unmatched.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.functions.text import strip
from tallyframe.llm.spelling import fold, within_one

# How people write the currencies of the list. By code: qualifiers, units, whole spellings.
# Each qualifier is combined with each unit by rule.
SPELLINGS: dict[str, tuple[str, str, str]] = {
    "AED": ("uae|emirati|emirates", "dirham|dirhams|dhs", "dh uae"),
    "AUD": ("australian|austr|aussie|aus", "dollar|dollars", "a$|au$|aud$"),
    "BRL": ("brazilian|braz|bras|brasileiro", "real|reais|reals", "reais|r$"),
    "CAD": ("canadian|can|cdn|canadiens", "dollar|dollars", "c$|ca$|cdn$|cad$|cdn"),
    "CHF": ("swiss|schweizer|suisse|suisses|suizos|sw", "franc|francs|franken|francos", "sfr|sfr.|fr.|chfr|franken"),
    "CNY": ("chinese|china", "yuan|renminbi|yuan renminbi", "renminbi|rmb|yuan|cn¥|人民币|元"),
    "CZK": ("czech|tschechische|tsch|ceska", "koruna|korunas|korun|kronen|crown|crowns", "koruna ceska|kc|korun ceskych"),
    "DKK": ("danish|danske|dan|danische", "krone|kroner|kr|kronen|crowns|crown", "dkr"),
    "EUR": ("", "", "euro|euros|€|€uro|euro €|eur €"),
    "GBP": ("british|brit|uk|english", "pound|pounds|pound sterling", "£|pound sterling|pounds sterling|sterling|livre sterling|livres sterling|libras esterlinas|pfund sterling|gbp £|stg"),
    "HKD": ("hong kong|hongkong|hk", "dollar|dollars", "hk$"),
    "HUF": ("hungarian|ungarische|hung", "forint|forints", "ft|forint|forints|forints hu"),
    "INR": ("indian|ind|indische", "rupee|rupees|rupien|rs", "₹|rs india"),
    "JPY": ("japanese|jap|japanische", "yen|yens", "jp¥|yen|日本円|円|yen japan"),
    "KRW": ("south korean|korean", "won|wons", "₩|won"),
    "MXN": ("mexican|mex|mexicanos|mexikanische", "peso|pesos", "mx$|mex$"),
    "NOK": ("norwegian|norske|norw|norwegische", "krone|kroner|kr|kronen|crowns|crown", "nkr"),
    "NZD": ("new zealand|nz|kiwi", "dollar|dollars", "nz$"),
    "PLN": ("polish|polnische|pol", "zloty|zlotys|zlotych", "zl|zloty|zlotys"),
    "RON": ("romanian|rumanische|rom", "leu|lei|leus", "lei|leu|leu romanesc|lei romanesti"),
    "SEK": ("swedish|svenska|sw|swed|schwedische", "krona|kronor|kronas|kr|kronen|crowns|crown", "skr"),
    "SGD": ("singapore|sing|singapur", "dollar|dollars", "s$|sg$"),
    "TRY": ("turkish|turk|turkische", "lira|liras|lirasi|lire", "₺|tl"),
    "USD": ("us|united states|american|americanos|usa|u.s.", "dollar|dollars|dolares", "us$|usd$|$us"),
    "ZAR": ("south african|s african|sa|sudafrikanische", "rand|rands", "rand|rands"),
}

# Codes of other currencies and of none, never a slip of a listed code.
OTHER_CODES = set(
    "AFN ALL AMD ANG AOA ARS AWG AZN BAM BBD BDT BGN BHD BIF BMD BND BOB BSD BTN BWP BYN BZD CDF CLP COP CRC CUP CVE DJF DOP DZD EGP ERN ETB "
    "FJD FKP GEL GHS GIP GMD GNF GTQ GYD HNL HRK HTG IDR ILS IQD IRR ISK JMD JOD KES KGS KHR KMF KPW KWD KYD KZT LAK LBP LKR LRD LSL LTL LVL LYD "
    "MAD MDL MGA MKD MMK MNT MOP MRU MUR MVR MWK MYR MZN NAD NGN NIO NPR OMR PAB PEN PGK PHP PKR PYG QAR RSD RUB RWF SAR SBD SCR SDG SHP SKK SLE "
    "SOS SRD SYP SZL THB TJS TMT TND TOP TTD TWD TZS UAH UGX UYU UZS VES VND VUV WST XAF XAG XAU XCD XOF XPD XPF XPT XXX YER ZMW BTC ETH DEM FRF ITL".split()
)

# Words around a currency that say nothing about which one it is.
NOISE = set(
    "in en the currency currencies wahrung devise moneda all amounts amount payable only incl inkl including cents cent centimes paid pay billed invoiced "
    "zahlbar betrag betrage montants importes waehrung of de".split()
)

# Units and signs of several currencies, which add nothing beside a clear name.
SHARED = "$ ¥ kr kroner krone krona kronor crown crowns dollar dollars peso pesos rupee rupees pound pounds franc francs".split()

_SPLIT = re.compile(r"[/()\[\]{},;|+&=]|\s[-–—]\s|\b(?:and|und|et|y|or|oder|ou)\b")
_SPELLED = re.compile(r"\b\w(?:[.\s]\w)+\b\.?")


def close_up(text: str) -> str:
    """``E.U.R.`` and ``E U R`` as ``EUR``."""
    return _SPELLED.sub(lambda m: re.sub(r"[.\s]", "", m[0]), text)


def is_noise(word: str) -> bool:
    return word in NOISE or (word.endswith("s") and word[:-1] in NOISE)


def normal(text: str) -> str:
    """Folded text without noise words and punctuation."""
    t = re.sub(r"(?<=\w)-(?=\w)|[:.,;!*\"'`]|(?<!\w)-|-(?!\w)", " ", fold(text))
    return " ".join(w for w in t.split() if not is_noise(w))


def segments(value: str | None) -> list[tuple[str, str]]:
    """(kind, normal text): the ``whole`` value, its ``part``s and, if it has several, its ``word``s."""
    if value is None or not value.strip():
        return []
    base = close_up(unicodedata.normalize("NFKC", value).casefold())
    whole = normal(_SPLIT.sub(" ", base))
    if not whole:
        return []
    parts = [("part", p) for p in (normal(x) for x in _SPLIT.split(base)) if p]
    words = whole.split()
    return [("whole", whole), *parts, *[("word", w) for w in words if len(words) > 1]]


def known_spellings() -> list[tuple[str, str]]:
    out = set()
    for code, (qualifiers, units, whole) in SPELLINGS.items():
        out |= {(code, normal(w) or w) for w in whole.split("|")}
        out |= {(code, f"{normal(q)} {u}") for q in qualifiers.split("|") if q for u in units.split("|")}
    return sorted(out)


def words_agree(value: str, spelling: str) -> bool:
    """Every word of either text has its counterpart in the other, up to one slip in words of four letters or more."""
    if value.replace(" ", "") == spelling.replace(" ", ""):
        return True
    a, b = value.split(), spelling.split()
    if len(a) != len(b):
        x, y = value.replace(" ", ""), spelling.replace(" ", "")
        return len(y) >= 4 and within_one(x, y)

    def same(x: str, y: str) -> bool:
        if x == y:
            return True
        if len(y) == 3 and len(b) == 1:  # a code: only two letters that changed places
            return len(x) == 3 and sorted(x) == sorted(y) and within_one(x, y) and x.upper() not in OTHER_CODES
        if len(y) < 4:
            return False
        if within_one(x, y):
            return True
        return x.endswith("s") and within_one(x[:-1], y)

    free = list(b)
    for x in a:
        hit = next((y for y in free if x == y), None) or next((y for y in free if same(x, y)), None)
        if hit is None:
            return False
        free.remove(hit)
    return True


@F.pandas_udf(T.ArrayType(T.StructType().add("kind", T.StringType()).add("text", T.StringType())))
def _segments(values: pd.Series) -> pd.Series:
    return values.map(lambda v: [{"kind": k, "text": t} for k, t in segments(v)])


@F.pandas_udf(T.BooleanType())
def _agree(values: pd.Series, spellings: pd.Series) -> pd.Series:
    return pd.Series([words_agree(a, b) for a, b in zip(values, spellings)], dtype=bool)


def _tokens(text: Column) -> Column:
    """Padded pairs of neighbouring characters, and single characters numbered by occurrence."""
    padded = F.concat(F.lit("^"), text, F.lit("$"))
    pairs = F.transform(F.sequence(F.lit(1), F.char_length(padded) - 1), lambda i: F.substring(padded, i, F.lit(2)))
    chars = F.filter(F.split(text, ""), lambda c: (c != "") & (c != " "))
    numbered = F.transform(chars, lambda c, i: F.concat(c, F.lit("#"), F.size(F.filter(F.slice(chars, F.lit(1), i + 1), lambda x: x == c)).cast("string")))
    return F.array_distinct(F.concat(pairs, numbered))


def similarity_join(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(text, other, jaccard) for the texts of ``left`` and ``right`` (both distinct in ``text``) of at least ``threshold``."""
    both = left.select("text", F.lit(0).alias("side")).unionByName(right.select("text", F.lit(1).alias("side")))
    tokens = both.select("text", "side", F.explode(_tokens(F.col("text"))).alias("token"))
    rarity = tokens.groupBy("token").agg(F.count("*").alias("freq"))
    ordered = (
        tokens.join(rarity, "token").groupBy("text", "side")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("freq", "token"))), lambda x: x["token"]).alias("tokens"))
        .withColumn("size", F.size("tokens"))
    )
    width = F.col("size") - F.ceil(F.lit(threshold) * F.col("size")) + 1
    prefixes = ordered.select("text", "side", "tokens", "size", F.posexplode(F.slice("tokens", F.lit(1), width.cast("int"))).alias("pos", "token"))
    a = prefixes.where("side = 0").select("text", F.col("tokens").alias("ta"), F.col("size").alias("na"), F.col("pos").alias("pa"), "token")
    b = prefixes.where("side = 1").select(F.col("text").alias("other"), F.col("tokens").alias("tb"), F.col("size").alias("nb"), F.col("pos").alias("pb"), "token")
    # Shared tokens from these positions on cannot exceed the shorter rest: the positional bound.
    reach = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) + F.least("pa", "pb")
    least = F.lit(threshold) / (1 + threshold) * (F.col("na") + F.col("nb"))
    common = F.size(F.array_intersect("ta", "tb"))
    jaccard = common / (F.col("na") + F.col("nb") - common)
    return (
        a.join(b, "token")
        .where((F.col("nb") >= threshold * F.col("na")) & (F.col("na") >= threshold * F.col("nb")) & (reach >= least))
        .select("text", "other", "ta", "tb", "na", "nb")
        .dropDuplicates(["text", "other"])
        .select("text", "other", jaccard.alias("jaccard"))
        .where(F.col("jaccard") >= threshold)
    )


def spelling_table(currencies: DataFrame) -> DataFrame:
    """(code, text) of every spelling: codes and names of the list itself and the fixed ones of listed codes."""
    fixed = currencies.sparkSession.createDataFrame(known_spellings(), "code string, text string")
    listed = currencies.select("code").distinct()
    own = currencies.select(F.col("code"), F.explode(F.array(F.try_element_at(_segments("code"), F.lit(1))["text"], F.try_element_at(_segments("currency_name"), F.lit(1))["text"])).alias("text"))
    return own.unionByName(fixed.join(listed, "code", "left_semi")).where(F.col("text").isNotNull()).distinct()


def map_values(values: DataFrame, currencies: DataFrame, column: str, threshold: float = 0.4) -> DataFrame:
    """(value, code) for the distinct values of ``column``; code is null where none or several entries fit."""
    parts = (
        values.select(F.col(column).alias("value")).where(strip(F.col(column)) != "").distinct()
        .withColumn("_s", _segments("value"))
        .select("value", F.inline_outer("_s"))
    )
    spellings = spelling_table(currencies)
    areas = currencies.select(F.try_element_at(_segments("area"), F.lit(1))["text"].alias("text"), F.lit(True).alias("is_area")).where(F.col("text").isNotNull())
    shared = currencies.sparkSession.createDataFrame([(w,) for w in SHARED], "text string").withColumn("is_area", F.lit(True))
    areas = areas.unionByName(shared).distinct()
    near = similarity_join(parts.select("text").where(F.col("text").isNotNull()).distinct(), spellings.select("text").distinct(), threshold)
    agreed = near.where(_agree("text", "other")).join(spellings.withColumnRenamed("text", "other"), "other")
    best = agreed.groupBy("text", "code").agg(F.max("jaccard").alias("j"))
    top = best.groupBy("text").agg(F.max("j").alias("top"))
    winners = (
        best.join(top, "text").where(F.col("j") >= F.col("top") - 1e-9)
        .groupBy("text").agg(F.min("code").alias("code"), F.count("*").alias("n_codes"))
    )
    found = parts.join(winners, "text", "left").join(areas, "text", "left")
    one = F.col("n_codes") == 1

    def by(kind: str) -> Column:
        """The one code that all texts of a kind agree on; the names of areas and shared units say nothing."""
        mine = (F.col("kind") == kind) & F.col("is_area").isNull()
        lo, hi = F.min(F.when(mine, F.col("code"))), F.max(F.when(mine, F.col("code")))
        return F.when(F.bool_and(F.when(mine, F.coalesce(one, F.lit(False)))) & (lo == hi), lo)

    return (
        found.groupBy("value").agg(by("whole").alias("w"), by("part").alias("p"), by("word").alias("s"))
        .select("value", F.coalesce("w", "p", "s").alias("code"))
    )


def invoice_currencies(invoices: DataFrame, currencies: DataFrame) -> DataFrame:
    """(invoice_id, code) of every invoice whose currency is not yet a code; ``UNMATCHED`` where no one entry is meant."""
    rows = invoices.select("invoice_id", "currency").where(F.col("invoice_id").isNotNull() & (strip(F.col("currency")) != ""))
    exact = currencies.select(F.col("code").alias("currency"))
    free = rows.join(exact, "currency", "left_anti").groupBy("invoice_id", "currency").agg(F.lit(1).alias("_one"))
    mapped = map_values(free, currencies, "currency")
    return (
        free.join(mapped, free["currency"] == mapped["value"], "left")
        .select("invoice_id", F.coalesce(mapped["code"], F.lit("UNMATCHED")).alias("code")).distinct()
    )
