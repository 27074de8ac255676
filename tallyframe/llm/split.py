"""Splitting oversized texts at natural boundaries (problem 3).

A text over the limit starts as atomic segments (sentences and lines; longer ones fall apart
into clauses, words and at last fixed cuts). Adjacent segments sit in a heap under the strength
of the boundary between them: the weakest boundary is merged first, as long as the merged size
plus the overlap fits the limit. What is left unmerged are the cuts, and they are the strongest
boundaries the limit allows.

Each piece after the first repeats the end of its predecessor, up to ``overlap`` characters,
beginning at a natural boundary where there is one. The function returns spans, so that only
texts over the limit enter Python and only integers come back; the pieces are cut in the JVM.

Defined results: null and short texts have no pieces (``split_pages`` keeps them as one whole
piece). Pages stored twice are split twice, each under its own id. Positions and sizes are
code points. A text without any boundary is cut at the limit.
"""

from __future__ import annotations

import heapq
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Boundary strengths, weakest first.
HARD, WORD, CLAUSE, SENTENCE, LINE, PARAGRAPH = range(6)

# The end of a match is a boundary; alternatives are tried from the strongest.
_BREAKS = re.compile(r"(\n[^\S\n]*\n\s*)|((?:\r\n|\n|\r|\f)[^\S\n]*)|((?:[.!?…]+[\"'”’)\]]*)\s+|[。！？])")
_CLAUSES = re.compile(r"[,;:)–—]\s+")
_WORDS = re.compile(r"\s+")


def _atoms(text: str, start: int, end: int, size: int) -> tuple[list[int], list[int]]:
    """Ends and boundary strengths of the atomic segments of ``text[start:end]``, none longer than ``size``."""
    ends, marks = [], []
    for m in _BREAKS.finditer(text, start, end):
        if m.end() < end:
            ends.append(m.end())
            marks.append(PARAGRAPH if m[1] else LINE if m[2] else SENTENCE)
    ends.append(end)
    marks.append(PARAGRAPH)
    for pattern, mark in ((_CLAUSES, CLAUSE), (_WORDS, WORD), (None, HARD)):
        if all(b - a <= size for a, b in zip([start, *ends], ends)):
            break
        finer_ends, finer_marks, at = [], [], start
        for e, s in zip(ends, marks):
            if e - at > size:
                if pattern is None:
                    inner = range(at + size, e, size)
                else:
                    inner = [m.end() for m in pattern.finditer(text, at, e) if m.end() < e]
                finer_ends += inner
                finer_marks += [mark] * len(inner)
            finer_ends.append(e)
            finer_marks.append(s)
            at = e
        ends, marks = finer_ends, finer_marks
    return ends, marks


def _overlap_start(text: str, start: int, end: int, overlap: int) -> int:
    """Where the shared part begins: the strongest boundary within the last ``overlap`` characters, behind ``start``.

    It lies behind the start of the piece that is shared, so that no piece holds another one whole.
    """
    low = min(max(start + 1, end - overlap), end)
    best = None
    for m in _WORDS.finditer(text, low, end):
        if m.end() < end:
            mark = SENTENCE if m.start() and text[m.start() - 1] in ".!?" or "\n" in m[0] else WORD
            if best is None or mark > best[0]:
                best = (mark, m.end())
    return best[1] if best else low


def split_spans(text: str, limit: int = 2000, overlap: int = 200) -> list[tuple[int, int]]:
    """(start, end) of the pieces of ``text``; together they cover it, and each is at most ``limit`` long."""
    n = len(text)
    if n <= limit:
        return [(0, n)]
    room = limit - overlap
    ends, marks = _atoms(text, 0, n, room)
    count = len(ends)
    starts = [0, *ends[:-1]]
    after = list(range(1, count + 1))
    before = list(range(-1, count - 1))
    alive = [True] * count
    # An entry stands for the boundary behind segment i; it is stale once its sizes have changed.
    heap = [(marks[i], ends[i + 1] - starts[i], i, ends[i], ends[i + 1]) for i in range(count - 1)]
    heapq.heapify(heap)
    while heap:
        mark, size, i, cut, tail = heapq.heappop(heap)
        if not alive[i] or ends[i] != cut:
            continue
        j = after[i]
        if j >= count or ends[j] != tail or tail - starts[i] != size:
            continue
        if size > (limit if starts[i] == 0 else room):
            continue
        ends[i], marks[i], alive[j] = ends[j], marks[j], False
        after[i] = after[j]
        if after[i] < count:
            before[after[i]] = i
            heapq.heappush(heap, (marks[i], ends[after[i]] - starts[i], i, ends[i], ends[after[i]]))
        p = before[i]
        if p >= 0:
            heapq.heappush(heap, (marks[p], ends[i] - starts[p], p, ends[p], ends[i]))
    spans, i = [], 0
    while i < count:
        start = starts[i]
        if spans:
            start = _overlap_start(text, spans[-1][0], start, overlap)
        spans.append((start, ends[i]))
        i = after[i]
    return spans


_SPANS = T.ArrayType(T.StructType().add("start", T.IntegerType()).add("end", T.IntegerType()))


def spans_of(text: Column, limit: int, overlap: int) -> Column:
    @F.pandas_udf(_SPANS)
    def spans(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else [{"start": a, "end": b} for a, b in split_spans(t, limit, overlap)])

    # Filters on the number of pieces must not be pushed below the call, which would split each text twice.
    return spans.asNondeterministic()(text)


def _spanned(pages: DataFrame, limit: int, overlap: int) -> DataFrame:
    """Pages with text and the spans of their pieces; texts within the limit pass without entering Python."""
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than limit")
    base = pages.select("page_id", "source_file", "number", "text").where(F.col("text").isNotNull())
    over = F.char_length("text") > limit
    long = base.where(over).withColumn("_spans", spans_of(F.col("text"), limit, overlap))
    short = base.where(~over).withColumn("_spans", F.array(F.struct(F.lit(0).alias("start"), F.char_length("text").alias("end"))).cast(_SPANS))
    return long.unionByName(short)


def split_pages(pages: DataFrame, limit: int = 2000, overlap: int = 200) -> DataFrame:
    """(page_id, source_file, number, piece_no, n_pieces, start, end, piece) for every page with text."""
    return (
        _spanned(pages, limit, overlap)
        .select("page_id", "source_file", "number", "text", F.size("_spans").alias("n_pieces"), F.posexplode("_spans").alias("_pos", "_span"))
        .select(
            "page_id", "source_file", "number", (F.col("_pos") + 1).alias("piece_no"), "n_pieces",
            F.col("_span")["start"].alias("start"), F.col("_span")["end"].alias("end"),
            F.substring("text", F.col("_span")["start"] + 1, F.col("_span")["end"] - F.col("_span")["start"]).alias("piece"),
        )
    )


def rebuilt_pages(pages: DataFrame, limit: int = 2000, overlap: int = 200) -> DataFrame:
    """(page_id, digest, fits, advances): the text put together again from its pieces, and whether each piece keeps the rules.

    ``digest`` is the MD5 of the pieces without their shared parts. ``fits``: no piece is longer
    than the limit. ``advances``: each piece starts and ends behind its predecessor's start and
    end, leaves no gap and shares at most ``overlap`` characters.
    """
    at = F.col("_spans")
    pairs = F.zip_with(F.slice(at, 1, F.size(at) - 1), F.slice(at, 2, F.size(at)), lambda a, b: (
        (a["start"] < b["start"]) & (b["start"] <= a["end"]) & (a["end"] < b["end"]) & (a["end"] - b["start"] <= overlap)))
    parts = F.transform(at, lambda s, i: F.substring("text", F.when(i == 0, 0).otherwise(F.get(at, i - 1)["end"]) + 1, s["end"] - F.when(i == 0, 0).otherwise(F.get(at, i - 1)["end"])))
    return _spanned(pages, limit, overlap).select(
        "page_id", F.md5(F.concat_ws("", parts)).alias("digest"), F.forall(at, lambda s: s["end"] - s["start"] <= limit).alias("fits"), F.forall(pairs, lambda x: x).alias("advances"))


def oversized_pages(pages: DataFrame, limit: int = 2000, overlap: int = 200) -> DataFrame:
    """Ids of the pages that came out in more than one piece, each once."""
    pieces = split_pages(pages, limit, overlap)
    return pieces.where((F.col("piece_no") == 1) & (F.col("n_pieces") > 1)).select("page_id").distinct()
