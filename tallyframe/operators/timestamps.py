"""Dates and moments in many notations, brought to one unambiguous form (problem 7).

A text is split into a date part, a time part and a zone part by one pattern; the date part is
matched against the notations below. The parser is an Arrow-batched function over the odd texts
only (as nested built-in expressions it outgrew the code generator); filters, zone rules and
formatting stay in the JVM. A moment without a zone is local time of the row's zone column;
where that column is null, too, the zone is estimated from the times of arrival (see
``estimate_offsets``).

Defined results: null, blank and unreadable texts, days and hours that do not exist and
incomplete dates give null. An hour that occurs twice means its first time; a time skipped by
a change of the clock moves forward by the gap. Extra columns pass through.
"""

from __future__ import annotations

import re
import unicodedata
from datetime import date
from functools import cache
from zoneinfo import available_timezones

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.session import cut_lineage

# Month names of English, German, French and Spanish by their first letters.
MONTHS = {
    "jan": 1, "janv": 1, "janvier": 1, "january": 1, "januar": 1, "jän": 1, "jänner": 1, "ene": 1, "enero": 1,
    "feb": 2, "february": 2, "februar": 2, "fév": 2, "févr": 2, "fev": 2, "fevr": 2, "février": 2, "fevrier": 2, "febrero": 2,
    "mar": 3, "march": 3, "mär": 3, "märz": 3, "mrz": 3, "maerz": 3, "marz": 3, "mars": 3, "marzo": 3,
    "apr": 4, "april": 4, "avr": 4, "avril": 4, "abr": 4, "abril": 4,
    "may": 5, "mai": 5, "mayo": 5,
    "jun": 6, "june": 6, "juni": 6, "juin": 6, "junio": 6,
    "jul": 7, "july": 7, "juli": 7, "juil": 7, "juillet": 7, "julio": 7,
    "aug": 8, "august": 8, "août": 8, "aout": 8, "ago": 8, "agosto": 8,
    "sep": 9, "sept": 9, "september": 9, "septembre": 9, "septiembre": 9, "setiembre": 9,
    "oct": 10, "october": 10, "okt": 10, "oktober": 10, "octobre": 10, "octubre": 10,
    "nov": 11, "november": 11, "novembre": 11, "noviembre": 11,
    "dec": 12, "december": 12, "dez": 12, "dezember": 12, "déc": 12, "décembre": 12, "decembre": 12, "dic": 12, "diciembre": 12,
}

# Zone abbreviations, minutes east of UTC.
ZONES = {
    "z": 0, "utc": 0, "gmt": 0, "wet": 0, "bst": 60, "west": 60, "cet": 60, "mez": 60, "cest": 120, "mesz": 120,
    "eet": 120, "eest": 180, "msk": 180, "gst": 240, "ist": 330, "sgt": 480, "hkt": 480, "awst": 480, "jst": 540, "kst": 540,
    "aest": 600, "aedt": 660, "nzst": 720, "nzdt": 780, "est": -300, "edt": -240, "cst": -360, "cdt": -300,
    "mst": -420, "mdt": -360, "pst": -480, "pdt": -420, "akst": -540, "akdt": -480, "hst": -600, "nst": -210, "ndt": -150, "brt": -180,
}

# Zones of the United States in the tz database.
UNITED_STATES = (
    r"^(US/.*|America/(New_York|Chicago|Denver|Los_Angeles|Phoenix|Anchorage|Detroit|Boise|Juneau|Sitka|Nome|Metlakatla|Yakutat|Adak|"
    r"Menominee|Indiana/.*|Kentucky/.*|North_Dakota/.*|Indianapolis|Louisville|Fort_Wayne|Shiprock)|Pacific/Honolulu)$"
)

# Words that may stand around a date without changing it.
LEADING = re.compile(
    r"(?i)^(?:invoice\s+date|date|datum|fecha|rechnungsdatum|dated|issued(?:\s+on)?|vom|den|am|du|le|el|the|on|of)\b[\s:.]*"
)
WEEKDAY = re.compile(
    r"(?i)^(?:mon|tue|tues|wed|thu|thur|thurs|fri|sat|sun|monday|tuesday|wednesday|thursday|friday|saturday|sunday|mo|di|mi|do|fr|sa|so|"
    r"montag|dienstag|mittwoch|donnerstag|freitag|samstag|sonntag|lundi|mardi|mercredi|jeudi|vendredi|samedi|dimanche|lunes|martes|"
    r"miércoles|jueves|viernes|sábado|domingo)\b[.,]*\s+"
)
TIME = re.compile(
    r"(?i)^(.*?\d\S*?)(?:T|[\s,]+(?:at|um|à|a\s+las)?\s*)(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?"
    r"(?:\s*([ap])\.?m\b\.?)?(?:\s*(?:uhr|h)\b)?\s*(z|[a-z]{2,5}|(?:utc|gmt)?\s*[+-]\d{1,2}(?::?\d{2})?|[a-z]+(?:/[a-z0-9_+-]+)+)?$"
)

YMD = re.compile(r"^(\d{4})[-./](\d{1,2})[-./](\d{1,2})$")
CJK = re.compile(r"^(\d{4})年(\d{1,2})月(\d{1,2})日$")
COMPACT = re.compile(r"^(\d{4})(\d{2})(\d{2})$")
NUMERIC = re.compile(r"^(\d{1,2})([-./])\s*(\d{1,2})\2\s*(\d{4}|\d{2})$")
WEEK = re.compile(r"^(\d{4})-?W(\d{2})-?([1-7])$")
DAY_NAME_YEAR = re.compile(r"(?i)^(\d{1,2})(?:st|nd|rd|th|er|\.)?[\s-]*(?:of\s+|de\s+)?([^\W\d_]{3,})\.?,?[\s-]*(?:de\s+|del\s+)?(\d{4}|\d{2})$")
NAME_DAY_YEAR = re.compile(r"(?i)^([^\W\d_]{3,})\.?[\s-]+(\d{1,2})(?:st|nd|rd|th)?,?[\s-]+(\d{4})$")
COMPACT_MOMENT = re.compile(r"^(\d{8})T(\d{2})(\d{2})(\d{2})(?:[.,](\d+))?(Z|[+-]\d{2}:?\d{2})?$")
SIGNED = re.compile(r"(?i)^(?:utc|gmt)?\s*([+-])(\d{1,2}):?(\d{2})?$")
EPOCH = re.compile(r"^\d{10}$|^\d{13}$|^\d{16}$")


def _day(year: str, month: int | None, day: str) -> date | None:
    try:
        return date(int(year) + (2000 if len(year) == 2 else 0), int(month or 0), int(day))
    except ValueError:
        return None


def parse_day(text: str, american: bool) -> date | None:
    """A calendar day written in any of the known notations, or None."""
    if m := YMD.match(text) or CJK.match(text) or COMPACT.match(text):
        return _day(m[1], int(m[2]), m[3])
    if m := NUMERIC.match(text):
        day_first, month_first = _day(m[4], int(m[3]), m[1]), _day(m[4], int(m[1]), m[3])
        return (month_first or day_first) if american else (day_first or month_first)
    if m := WEEK.match(text):
        try:
            return date.fromisocalendar(int(m[1]), int(m[2]), int(m[3]))
        except ValueError:
            return None
    if m := DAY_NAME_YEAR.match(text):
        return _day(m[3], MONTHS.get(m[2].lower()), m[1])
    if m := NAME_DAY_YEAR.match(text):
        return _day(m[3], MONTHS.get(m[1].lower()), m[2])
    return None


def clean_text(text: str) -> str:
    """Without outer blanks, lead-in words, weekday names and full-width forms."""
    plain = " ".join(unicodedata.normalize("NFKC", text).split())
    for pattern in (LEADING, LEADING, WEEKDAY, LEADING):
        plain = pattern.sub("", plain, count=1)
    return plain


@cache
def _zone_names() -> set[str]:
    return available_timezones()


def _zone(text: str) -> tuple[int | None, str | None] | None:
    """(minutes east of UTC, zone name) of a zone text; None where it is no zone."""
    if m := SIGNED.match(text):
        hours, minutes = int(m[2]), int(m[3] or 0)
        return ((hours * 60 + minutes) * (-1 if m[1] == "-" else 1), None) if hours <= 18 and minutes < 60 else None
    if text.lower() in ZONES:
        return ZONES[text.lower()], None
    return (None, text) if "/" in text and text in _zone_names() else None


def parse_moment(text: str, american: bool) -> tuple:
    """(day, local microseconds, offset minutes, zone name, UTC microseconds); what does not apply is None."""
    nothing = (None,) * 5
    if EPOCH.match(text):
        return (None, None, None, None, int(text) * 10 ** (16 - len(text)))
    if m := COMPACT_MOMENT.match(text):
        text = f"{m[1]} {m[2]}:{m[3]}:{m[4]}" + (f".{m[5]}" if m[5] else "") + (m[6] or "")
    m = TIME.match(text)
    day = parse_day((m[1] if m else text).rstrip(" ,"), american)
    if day is None:
        return nothing
    if not m:
        return (day, None, None, None, None)
    hour, minute, second = int(m[2]), int(m[3]), int(m[4] or 0)
    if m[6]:
        if not 1 <= hour <= 12:
            return nothing
        hour = hour % 12 + (12 if m[6].lower() == "p" else 0)
    if hour > 23 or minute > 59 or second > 59:
        return nothing
    days = day.toordinal() - 719163
    local = ((days * 24 + hour) * 60 + minute) * 60 + second
    local = local * 1_000_000 + int((m[5] or "")[:6].ljust(6, "0"))
    if not m[7]:
        return (None, local, None, None, None)
    zone = _zone(m[7].replace(" ", ""))
    return nothing if zone is None else (None, local, *zone, None)


_PARTS = (
    T.StructType().add("day", T.DateType()).add("local", T.LongType()).add("offset", T.LongType()).add("named", T.StringType())
    .add("instant", T.LongType())
)


@F.pandas_udf(_PARTS)
def _parse(text: pd.Series, american: pd.Series) -> pd.DataFrame:
    rows = [parse_moment(clean_text(t), bool(u)) if isinstance(t, str) else (None,) * 5 for t, u in zip(text, american)]
    out = pd.DataFrame(rows, columns=["day", "local", "offset", "named", "instant"], dtype=object)
    return out.astype({"local": "Int64", "offset": "Int64", "instant": "Int64"})


def parsed_parts(df: DataFrame, text: str, zone: str) -> DataFrame:
    """Adds ``_day`` (dates), ``_local`` (wall-clock moments), ``_offset`` and ``_named`` (their zones), ``_instant`` (epochs)."""
    american = F.coalesce(F.col(zone).rlike(UNITED_STATES), F.lit(False))
    p = F.col("_parts")
    return (
        df.withColumn("_parts", _parse(F.col(text), american))
        .withColumns({
            "_day": p["day"], "_local": F.timestamp_micros(p["local"]), "_offset": p["offset"], "_named": p["named"],
            "_unzoned": p["offset"].isNull() & p["named"].isNull(), "_instant": F.timestamp_micros(p["instant"]),
        })
        .drop("_parts")
    )


def offset_history(scores: list[tuple], change: float = 2.0) -> dict:
    """The offset of each month: the history with fewest violations, a change counting as ``change`` of them.

    ``scores`` has (month, offset, violations, deviation). Among equal histories the one whose
    delays deviate least from the usual, then the one nearest to UTC, is chosen.
    """
    months = sorted({m for m, *_ in scores})
    table = {(m, c): (bad, off, abs(c)) for m, c, bad, off in scores}
    offsets = sorted({c for _, c, *_ in scores})
    best: dict[int, tuple] = {}
    back: list[dict[int, int]] = []
    for month in months:
        stay = best
        # Only the best offset so far is worth changing from.
        change_from = min(stay, key=lambda c: (stay[c], c)) if stay else None
        best, came = {}, {}
        for c in offsets:
            bad, off, far = table[month, c]
            ways = [(stay[c], c)] if stay else [((0.0, 0.0, 0), c)]
            if change_from is not None and change_from != c:
                cost = stay[change_from]
                ways.append(((cost[0] + change, *cost[1:]), change_from))
            cost, origin = min(ways)
            best[c], came[c] = (cost[0] + bad, cost[1] + off, cost[2] + far), origin
        back.append(came)
    out, at = {}, min(best, key=lambda c: (best[c], c))
    for month, came in zip(reversed(months), reversed(back)):
        out[month] = at
        at = came[at]
    return out


def estimate_offsets(parts: DataFrame, source: str, arrival: str, zone: str | None = None, step_minutes: int = 15, max_lag_days: int = 45, change: float = 2.0) -> DataFrame:
    """(source, month, offset) for local moments of unknown zone, by their times of arrival.

    For each source and month, every offset from -12 to +14 hours is scored: a record that
    would have been written after it arrived, or more than ``max_lag_days`` before, violates
    it. Scores combine map-side, so a source with very many records is a few rows a month.
    The months of a source are then one history: a dynamic programme chooses the offsets with
    fewest violations and changes. Delays are compared with the source's usual delay, the mean
    over its records that do state a zone; without such records with no delay at all.
    """
    seconds = F.col(arrival).cast("timestamp").cast("double")
    local = F.col("_local").cast("double")
    home = F.lit(None).cast("string") if zone is None else F.nullif(F.col(zone), F.lit(""))
    stated = F.when(~F.col("_unzoned") & F.col("_offset").isNotNull(), local - F.col("_offset") * 60).when(home.isNotNull() & F.col("_unzoned"), F.to_utc_timestamp("_local", home).cast("double"))
    usual = parts.where(F.col(arrival).isNotNull() & stated.isNotNull()).groupBy(F.col(source).alias("_s")).agg(F.avg(seconds - stated).alias("_usual"))
    rows = parts.where(F.col("_local").isNotNull() & F.col(arrival).isNotNull() & F.col("_unzoned") & home.isNull())
    lag = F.col("_lag0") + F.col("_cand") * 60
    scored = (
        rows.select(F.col(source).alias("_s"), F.trunc(F.col("_local").cast("date"), "month").alias("_month"), (seconds - local).alias("_lag0"))
        .withColumn("_cand", F.explode(F.sequence(F.lit(-720), F.lit(840), F.lit(step_minutes))))
        .groupBy("_s", "_month", "_cand").agg(F.sum(F.when((lag < 0) | (lag > max_lag_days * 86400), 1.0).otherwise(0.0)).alias("_bad"), F.count("*").alias("_n"), F.sum(lag).alias("_sum"))
    )
    away = F.bround(F.abs(F.col("_sum") - F.col("_n") * F.coalesce("_usual", F.lit(0.0))), 3)
    judged = scored.join(usual, scored["_s"].eqNullSafe(usual["_s"]), "left").select(scored["_s"], "_month", "_cand", "_bad", away.alias("_away"))
    kind = parts.schema[source].dataType.simpleString()

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        found = offset_history(list(zip(pdf["_month"], pdf["_cand"], pdf["_bad"], pdf["_away"])), change)
        return pd.DataFrame([(pdf["_s"].iloc[0], m, c) for m, c in found.items()], columns=["_s", "_month", "_estimated"])

    # A group is one source's months and candidates, whatever the number of its records.
    return judged.groupBy("_s").applyInPandas(choose, f"_s {kind}, _month date, _estimated int").withColumnRenamed("_s", source)


def _utc_text(instant: Column) -> Column:
    """``YYYY-MM-DDTHH:MM:SS.ffffffZ`` whatever the session's time zone."""
    micros = F.unix_micros(instant)
    whole = lambda n, d: ((n - F.pmod(n, F.lit(d))) / d).cast("long")
    total = whole(micros, 1_000_000)
    seconds = F.pmod(total, F.lit(86400))
    day = F.date_add(F.lit("1970-01-01").cast("date"), whole(total, 86400).cast("int"))
    clock = F.format_string("%02d:%02d:%02d.%06d", whole(seconds, 3600), whole(seconds, 60) % 60, seconds % 60, F.pmod(micros, F.lit(1_000_000)))
    return F.when(instant.isNotNull(), F.concat(day.cast("string"), F.lit("T"), clock, F.lit("Z")))


def normalize_timestamps(df: DataFrame, text: str, zone: str, arrival: str | None = None, source: str | None = None) -> DataFrame:
    """``df`` with ``normal_form``: a day as ``YYYY-MM-DD``, a moment in UTC as ``YYYY-MM-DDTHH:MM:SS.ffffffZ``.

    ``zone`` names the column with the zone of texts that give none. Rows where it is null
    use the estimated offset history of their ``source`` from its times of ``arrival`` if both are
    given, else they stay null.
    """
    parts = parsed_parts(df, text, zone)
    local, home = F.col("_local"), F.when(F.nullif(F.col(zone), F.lit("")).isNotNull(), F.col(zone))
    shifted = F.timestamp_micros(F.unix_micros(local) - F.col("_offset").cast("long") * 60_000_000)
    if arrival and source:
        parts = cut_lineage(parts)  # read by the estimate and by the conversion, parsed once
    if arrival and source and not parts.where(F.col("_unzoned") & home.isNull() & local.isNotNull()).isEmpty():
        offsets = estimate_offsets(parts, source, arrival, zone)
        month = F.trunc(local.cast("date"), "month")
        guess = offsets.select(F.col(source).alias("_src"), F.col("_month").alias("_src_month"), "_estimated")
        needs = F.col("_unzoned") & home.isNull()
        parts = parts.join(guess, needs & F.col(source).eqNullSafe(F.col("_src")) & (month == F.col("_src_month")), "left").drop("_src", "_src_month")
        estimated = F.timestamp_micros(F.unix_micros(local) - F.col("_estimated").cast("long") * 60_000_000)
    else:
        estimated = F.lit(None).cast("timestamp")
    moment = (
        F.when(F.col("_named").isNotNull(), F.to_utc_timestamp(local, F.col("_named")))
        .when(~F.col("_unzoned"), shifted)
        .when(home.isNotNull(), F.to_utc_timestamp(local, home))
        .otherwise(estimated)
    )
    instant = F.coalesce(F.col("_instant"), moment)
    form = F.coalesce(F.col("_day").cast("string"), _utc_text(instant))
    keep = [F.col(c) for c in df.columns if c != "normal_form"]
    return parts.select(*keep, form.alias("normal_form"))


def invoice_dates(invoices: DataFrame) -> DataFrame:
    """(invoice_id, normal_form) of every invoice whose date is not yet written as ``YYYY-MM-DD``."""
    odd = invoices.select("invoice_id", "invoice_date", "issuer_tz", "ingested_at", "seller_name").where(
        F.col("invoice_date").isNotNull() & ~F.col("invoice_date").rlike(r"^\d{4}-\d{2}-\d{2}$")
    )
    found = normalize_timestamps(odd, "invoice_date", "issuer_tz", "ingested_at", "seller_name")
    return found.where(F.col("normal_form").isNotNull()).select("invoice_id", "normal_form").distinct()
