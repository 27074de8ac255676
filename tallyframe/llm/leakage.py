"""Evaluation texts that leaked into a corpus (problem 9).

A prefix-filtered join of the items' five-word shingles with the documents.

1. Each text is cut into words once, in Arrow batches. The shingles it shares with an item are
   kept with their places; a small table of the items' shingles serves as the filter. Texts
   that share none go no further; what is kept is written once.
2. The kept shingles are counted over all documents, and each item's shingles are ordered by
   that rarity. Its prefix is what is left when the most frequent ones are set aside as long as
   they alone could not cover the asked share: every leak must hold a shingle of the prefix.
3. Kept shingles and prefixes meet in an equi-join; a length bound drops documents too short.
4. The pairs that met are verified exactly: shared shingles form runs of equal words, runs that
   follow one another with at most a few altered words between them form passages, and the
   item's words so covered are counted over the whole document. A positional bound on the item's
   side settles most pairs before that.

The items are a stated query set: they are taken in blocks of at most ``block_words`` words, so
the filter is bounded however many items there are. Texts are never shuffled, only places of
shared shingles.

Words are compared exactly. A second reading serves scanned texts: a word that is no word of any
item is read as the item word from which it differs only by letters that scanning confuses.

Defined results: null and empty texts and passages are no case. A passage that ends up with
fewer than ``shingle`` words is matched as one whole run. Fragments under ``min_run`` words are
stock phrases and count for nothing. Repeated rows give one row a document and item.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.session import cut_lineage

_WORD = re.compile(r"[^\W_]+")
_BROKEN = re.compile(r"[-‐‑](?<=[^\W\d_][-‐‑])\s*[\r\n]+\s*(?=[a-zäöüßéèàñ])")
_HIDDEN = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]")

# Letters that scanning confuses.
_CONFUSED = str.maketrans("015ice8", "olsleeb")


def plain_words(text: str) -> list[str]:
    """Words whatever the layout, width, case, accents, hidden characters and line-end hyphens."""
    if not text.isascii():
        text = _HIDDEN.sub("", unicodedata.normalize("NFKC", text))
        if not text.isascii():
            text = unicodedata.normalize("NFKD", text)
            for c in {c for c in set(text) if unicodedata.combining(c)}:
                text = text.replace(c, "")
    if "\n" in text or "\r" in text:
        text = _BROKEN.sub("", text)
    return _WORD.findall(text.casefold())


def scanned(word: str) -> str:
    """The word with letters that scanning confuses read as one."""
    return word.replace("rn", "m").translate(_CONFUSED)


def words_of(text: str) -> list[str]:
    """Words in the reading that undoes scanning slips."""
    return [scanned(w) for w in plain_words(text)]


class _WordIds(dict):
    """Ids of words met so far: that of the item word, else that of the item word it is a scanning slip of, else -1."""

    def __init__(self, vocabulary: dict[str, int], slipped: dict[str, int]):
        super().__init__()
        self.vocabulary, self.slipped = vocabulary, slipped

    def __missing__(self, word: str) -> int:
        found = self.vocabulary.get(word, -1)
        if found < 0:
            found = self.slipped.get(scanned(word), -1)
        if len(self) > 1 << 20:
            self.clear()
        self[word] = found
        return found


class ItemIndex:
    """Shingles of a block of items with their places; small, and read-only on the executors."""

    def __init__(self, items: list[tuple[int, str]], shingle: int = 5):
        self.shingle = shingle
        self.words = {i: plain_words(p) for i, p in items if p}
        self.words = {i: w for i, w in self.words.items() if w}
        self.places: dict[tuple, list[tuple[int, int]]] = defaultdict(list)
        for i, w in self.words.items():
            k = min(shingle, len(w))
            for p in range(len(w) - k + 1):
                self.places[tuple(w[p : p + k])].append((i, p))
        self.ids = {s: n for n, s in enumerate(self.places)}
        self.short = {len(s) for s in self.places if len(s) < shingle}
        self.item_ids = list(self.words)
        self.sizes = np.array([len(w) for w in self.words.values()], dtype=np.int64)
        number = {i: n for n, i in enumerate(self.item_ids)}
        counts = [len(v) for v in self.places.values()]
        self.starts = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)]).astype(np.int64)
        self.place_item = np.array([number[i] for v in self.places.values() for i, _ in v], dtype=np.int64)
        self.place_pos = np.array([p for v in self.places.values() for _, p in v], dtype=np.int64)
        self.vocabulary = {w: n for n, w in enumerate(sorted({x for s in self.places for x in s}))}
        slipped: dict[str, int] = {}
        for w, n in self.vocabulary.items():
            slipped.setdefault(scanned(w), n)
        self.word_ids = _WordIds(self.vocabulary, slipped)
        self._levels = {k: self._narrow(k) for k in sorted({len(s) for s in self.places})}

    def _narrow(self, k: int) -> list[np.ndarray]:
        """Sorted codes of the beginnings of all shingles of ``k`` words, a table a length; the last is followed by the shingles' ids."""
        rows = [(tuple(self.vocabulary[w] for w in s), n) for s, n in self.ids.items() if len(s) == k]
        base, code = len(self.vocabulary) + 1, np.array([r[0] for r in rows], dtype=np.int64)
        at, tables = code[:, 0], []
        for j in range(1, k):
            full = at * base + code[:, j]
            table = np.unique(full)
            at = np.searchsorted(table, full)
            tables.append(table)
        ids = np.empty(len(rows), dtype=np.int64)
        # With one word a shingle the code is the word itself.
        if k == 1:
            table = np.unique(at)
            at = np.searchsorted(table, at)
            tables.append(table)
        ids[at] = [n for _, n in rows]
        return [*tables, ids]

    def shared(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, shingle ids) of the item shingles in a row of word ids, -1 standing for any other word."""
        base, at, found = len(self.vocabulary) + 1, [], []
        for k, (*tables, shingle_ids) in self._levels.items():
            place = np.flatnonzero(ids[: max(0, len(ids) - k + 1)] >= 0)
            code = ids[place]
            for j, table in enumerate(tables, 1):
                if k > 1:
                    nxt = ids[place + j]
                    place, code = place[nxt >= 0], code[nxt >= 0] * base + nxt[nxt >= 0]
                here = np.searchsorted(table, code)
                ok = table[np.minimum(here, len(table) - 1)] == code
                place, code = place[ok], here[ok]
            at.append(place)
            found.append(shingle_ids[code])
        at, found = np.concatenate(at or [np.zeros(0, dtype=np.int64)]), np.concatenate(found or [np.zeros(0, dtype=np.int64)])
        order = np.argsort(at, kind="stable")
        return at[order], found[order]

    def shingles(self, words: list[str]) -> Iterator[tuple[int, tuple]]:
        places = self.places
        for k in (self.shingle, *self.short):
            for p, s in enumerate(zip(*(words[j:] for j in range(k)))):
                if s in places:
                    yield p, s


def coverable(places: np.ndarray, group: np.ndarray, k: np.ndarray, min_run: np.ndarray, max_gap: int) -> tuple[np.ndarray, np.ndarray]:
    """(groups, words of the item that shingles at ``places`` could cover at most); sorted by group and place.

    Neighbours at most ``max_gap`` words apart bridge the gap; a stretch with fewer than
    ``min_run`` words in shingles counts for nothing.
    """
    new = np.ones(len(places), dtype=bool)
    new[1:] = group[1:] != group[:-1]
    step = np.diff(places, prepend=places[:1])
    stretch = new | (step - k > max_gap)
    first = np.flatnonzero(stretch)
    equal = np.add.reduceat(np.where(stretch, k, np.minimum(step, k)), first)
    last = np.append(first[1:], len(places)) - 1
    span = np.where(equal >= min_run[first], places[last] + k[last] - places[first], 0)
    start = np.flatnonzero(new[first])
    return group[first][start], np.add.reduceat(span, start)


def prefix_of(words: list[str], frequency: dict[tuple, int], shingle: int, share: float, min_run: int, max_gap: int) -> list[tuple]:
    """The rarest shingles of an item, one of which every document with ``share`` of its words must hold.

    The most frequent ones are set aside as long as the words they could cover stay under the share.
    """
    k = min(shingle, len(words))
    at: dict[tuple, list[int]] = defaultdict(list)
    for p in range(len(words) - k + 1):
        at[tuple(words[p : p + k])].append(p)
    own = sorted(at, key=lambda s: (-frequency.get(s, 0), s))
    low, high = 0, len(own) - 1
    while low < high:
        middle = (low + high + 1) // 2
        places = np.sort(np.array([p for s in own[:middle] for p in at[s]], dtype=np.int64))
        same = np.full(len(places), k)
        _, most = coverable(places, np.zeros(len(places), dtype=np.int64), same, np.full(len(places), min(min_run, len(words))), max_gap)
        if most[0] < share * len(words):
            low = middle
        else:
            high = middle - 1
    return own[low:]


def covered_share(hits: list[tuple[int, int]], size: int, shingle: int, min_run: int, max_gap: int) -> float:
    """Share of an item's words that a document took over; hits are (document position, item position) of shared shingles."""
    runs: list[list[int]] = []
    open_runs: dict[int, list[int]] = {}
    for d, i in sorted(hits):
        run = open_runs.get(d - i)
        if run is not None and run[1] == d - 1:
            run[1] = d
        else:
            run = [d, d, i]
            open_runs[d - i] = run
            runs.append(run)
    spans = sorted((a, b + shingle - 1, i, i + b - a + shingle - 1) for a, b, i in runs)
    chains: list[list[int]] = []  # document end, item start, item end, equal words
    for d0, d1, i0, i1 in spans:
        best = None
        for chain in chains:
            gap_d, gap_i = d0 - chain[0] - 1, i0 - chain[2] - 1
            if -shingle < gap_d <= max_gap and -shingle < gap_i <= max_gap and i1 > chain[2] and d1 > chain[0]:
                if best is None or chain[3] > best[3]:
                    best = chain
        if best is None:
            chains.append([d1, i0, i1, i1 - i0 + 1])
        else:
            best[3] += i1 - max(i0 - 1, best[2])
            best[0], best[2] = d1, i1
    taken = bytearray(size)
    for _, i0, i1, n in chains:
        if n >= min(min_run, size):
            taken[i0 : i1 + 1] = b"\x01" * (i1 + 1 - i0)
    return sum(taken) / size


def verified(index: ItemIndex, docs: list[tuple[np.ndarray, np.ndarray, np.ndarray]], share: float, min_run: int, max_gap: int) -> list[list[tuple[int, float]]]:
    """(item_id, share) of the candidates of each document that hold; a document is (places, shingle ids, candidate item numbers)."""
    out: list[list[tuple[int, float]]] = [[] for _ in docs]
    n_items = len(index.item_ids)
    owner = np.repeat(np.arange(len(docs)), [len(d[0]) for d in docs])
    at, ids = (np.concatenate([np.asarray(d[j], dtype=np.int64) for d in docs]) for j in (0, 1))
    wanted = np.unique(np.concatenate([n * n_items + np.asarray(d[2], dtype=np.int64) for n, d in enumerate(docs)]))
    many = index.starts[ids + 1] - index.starts[ids]
    slot = np.repeat(index.starts[ids] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
    owner, at = np.repeat(owner, many), np.repeat(at, many)
    group, place = owner * n_items + index.place_item[slot], index.place_pos[slot]
    keep = np.isin(group, wanted)
    owner, at, group, place = owner[keep], at[keep], group[keep], place[keep]
    if not len(group):
        return out
    order = np.lexsort((place, group))
    sizes = index.sizes[group[order] % n_items]
    groups, most = coverable(place[order], group[order], np.minimum(index.shingle, sizes), np.minimum(min_run, sizes), max_gap)
    good = groups[most >= share * index.sizes[groups % n_items]]
    keep = np.isin(group, good)
    hits: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for g, a, p in zip(group[keep].tolist(), at[keep].tolist(), place[keep].tolist()):
        hits[g].append((a, p))
    for g, places in hits.items():
        size = int(index.sizes[g % n_items])
        part = covered_share(places, size, min(index.shingle, size), min_run, max_gap)
        if part >= share:
            out[g // n_items].append((index.item_ids[g % n_items], part))
    return out


_SHARED = T.StructType().add("n_words", T.IntegerType()).add("at", T.ArrayType(T.IntegerType())).add("ids", T.ArrayType(T.IntegerType()))
_LEAKS = T.ArrayType(T.StructType().add("item_id", T.LongType()).add("share", T.DoubleType()))


def _blocks(items: DataFrame, block_words: int) -> Iterator[list[tuple[int, str]]]:
    block, size = [], 0
    for item_id, passage in items.where("item_id is not null and passage is not null").select("item_id", "passage").toLocalIterator():
        n = len(passage) // 4 + 1
        if block and size + n > block_words:
            yield block
            block, size = [], 0
        block.append((item_id, passage))
        size += n
    if block:
        yield block


def find_leaks(
    documents: DataFrame, items: DataFrame, share: float = 0.5, shingle: int = 5, min_run: int = 8, max_gap: int = 3, block_words: int = 500_000
) -> DataFrame:
    """(doc_id, item_id, share) of every document that holds at least ``share`` of an item's words, taken over from it."""
    spark = documents.sparkSession
    texts = documents.select("doc_id", "text").where(F.col("doc_id").isNotNull() & (F.char_length("text") > 0))
    out = None
    for block in _blocks(items, block_words):
        own = ItemIndex(block, shingle)
        if not own.places:
            continue
        shared = spark.sparkContext.broadcast((block, shingle))
        cache: dict = {}

        def index_of(shared=shared, cache=cache) -> ItemIndex:
            if "index" not in cache:
                cache["index"] = ItemIndex(*shared.value)
            return cache["index"]

        @F.pandas_udf(_SHARED)
        def shared_shingles(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            index = index_of()
            word_ids = index.word_ids
            for batch in batches:
                row, sizes = [], []  # the texts' word ids in a row, -1 between them
                for text in batch:
                    words = plain_words(text)
                    row += [word_ids[w] for w in words]
                    row.append(-1)
                    sizes.append(len(words))
                at, ids = index.shared(np.array(row, dtype=np.int64))
                starts = np.cumsum([0, *(n + 1 for n in sizes)])
                cuts = np.searchsorted(at, starts)
                parts = list(zip(cuts[:-1], cuts[1:]))
                yield pd.DataFrame({"n_words": sizes, "at": [at[a:b] - start for start, (a, b) in zip(starts, parts)], "ids": [ids[a:b] for a, b in parts]})

        @F.pandas_udf(_LEAKS)
        def verify(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            index = index_of()
            for batch in batches:
                found = verified(index, list(zip(*batch)), share, min_run, max_gap) if len(batch[0]) else []
                yield pd.Series([[{"item_id": i, "share": c} for i, c in row] for row in found], dtype=object)

        kept = texts.select("doc_id", shared_shingles.asNondeterministic()("text").alias("h")).where(F.size("h.ids") > 0)
        kept = cut_lineage(kept.select(F.monotonically_increasing_id().alias("row"), "doc_id", "h.*"))
        each = kept.select("row", "n_words", F.explode(F.array_distinct("ids")).alias("shingle"))
        # One row a shingle of the block's items, however many documents there are.
        counts = {r["shingle"]: r["n"] for r in each.groupBy("shingle").agg(F.count("*").alias("n")).toLocalIterator()}
        frequency = {s: counts.get(n, 0) for s, n in own.ids.items()}
        prefixes = [
            (own.ids[s], n, len(words)) for n, words in enumerate(own.words.values()) for s in prefix_of(words, frequency, shingle, share, min_run, max_gap)
        ]
        prefix = spark.createDataFrame(prefixes, "shingle int, item int, size int")
        # A block has at most ``block_words`` such rows of three integers.
        met = each.join(F.broadcast(prefix), "shingle").where(F.col("n_words") >= F.col("size") * share)
        candidates = met.groupBy("row").agg(F.collect_set("item").alias("items"))  # at most the items of one block
        checked = kept.join(candidates, "row").select("doc_id", F.inline(verify("at", "ids", "items")))
        out = checked if out is None else out.unionByName(checked)
    if out is None:
        return spark.createDataFrame([], "doc_id bigint, item_id bigint, share double")
    return out.groupBy("doc_id", "item_id").agg(F.max("share").alias("share"))
