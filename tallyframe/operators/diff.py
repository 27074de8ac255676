"""Differences between two copies of a data set (problem 5).

Rows of both copies are compared by their key and their compared fields. Identical rows
cancel by multiplicity; what is left within a key is paired so that the number of differing
fields is least in total; rows without a partner are missing on the other side.

* Identical rows are counted by an aggregation with map-side combine, so a key that holds a
  third of all rows costs one row a distinct value combination after the shuffle.
* A key with one combination left a side needs no search. Keys with up to ``exact_limit``
  rows left a side go through the Hungarian method in ``applyInPandas``; a group is bounded by
  that parameter. Larger keys are solved as a transport problem between their distinct value
  combinations, to the same least total; a task holds the distinct combinations of a key.

Nulls: a null key is no case and is left out; null field values equal one another. Empty
inputs give no rows. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from heapq import heappop, heappush
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.numbers import coerce_decimal
from tallyframe.functions.text import strip
from tallyframe.session import cut_lineage


def hungarian(cost: np.ndarray) -> list[tuple[int, int]]:
    """Least-cost assignment of all rows of ``cost`` (rows <= columns) by shortest augmenting paths."""
    n, m = cost.shape
    if n > m:
        return [(r, c) for c, r in hungarian(cost.T)]
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, dtype=int)
    for row in range(1, n + 1):
        match[0], col = row, 0
        least, way, used = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=int), np.zeros(m + 1, dtype=bool)
        while True:
            used[col] = True
            r = match[col]
            reduced = cost[r - 1] - u[r] - v[1:]
            better = ~used[1:] & (reduced < least[1:])
            least[1:][better], way[1:][better] = reduced[better], col
            open_ = np.where(used[1:], np.inf, least[1:])
            nxt = int(open_.argmin()) + 1
            step = open_[nxt - 1]
            u[match[used]] += step
            v[used] -= step
            least[~used] -= step
            col = nxt
            if match[col] == 0:
                break
        while col:
            match[col], col = match[way[col]], way[col]
    return [(match[c] - 1, c - 1) for c in range(1, m + 1) if match[c]]


def _leftovers(left: DataFrame, right: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """One row a key and value combination with the rows left on either side after cancelling."""
    cols = [*keys, *fields]

    def side(df: DataFrame, l: int, r: int) -> DataFrame:
        return df.select(*cols, F.lit(l).alias("_l"), F.lit(r).alias("_r"))

    counted = side(left, 1, 0).unionByName(side(right, 0, 1)).groupBy(*cols).agg(F.sum("_l").alias("_l"), F.sum("_r").alias("_r"))
    for k in keys:
        counted = counted.where(F.col(k).isNotNull())
    same = F.least("_l", "_r")
    return counted.withColumns({"_l": F.col("_l") - same, "_r": F.col("_r") - same}).where((F.col("_l") > 0) | (F.col("_r") > 0))


def diff_copies(left: DataFrame, right: DataFrame, keys: list[str], fields: list[str], exact_limit: int = 400) -> DataFrame:
    """Rows (keys, difference, field, left_value, right_value, n) that tell the copies apart.

    ``difference`` is ``only_left``, ``only_right`` (field is '') or ``differs`` with one row a
    differing field. ``n`` counts the row pairs that show exactly this difference.
    """
    rest = cut_lineage(_leftovers(left, right, keys, fields))
    per_key = rest.groupBy(*keys).agg(
        F.sum("_l").alias("_tl"), F.sum("_r").alias("_tr"), F.count("*").alias("_combos")
    )
    tagged = cut_lineage(rest.join(per_key, keys))
    left_value = F.struct(*[F.col(f).cast("string").alias(f) for f in fields])
    simple = (F.col("_tl") == 0) | (F.col("_tr") == 0)
    single = ~simple & (F.col("_combos") == 2) & (F.col("_tl") == F.col("_tr"))

    alone = tagged.where(simple).select(
        *keys, F.when(F.col("_l") > 0, left_value).alias("_lv"), F.when(F.col("_r") > 0, left_value).alias("_rv"),
        F.greatest("_l", "_r").alias("n"),
    )
    pairs = (
        tagged.where(single)
        .groupBy(*keys)
        .agg(F.max(F.when(F.col("_l") > 0, left_value)).alias("_lv"), F.max(F.when(F.col("_r") > 0, left_value)).alias("_rv"),
             F.max(F.greatest("_l", "_r")).alias("n"))
    )
    hard = tagged.where(~simple & ~single)
    small = F.greatest("_tl", "_tr") <= exact_limit
    searched = _assign_exact(hard.where(small), keys, fields)
    matched = alone.unionByName(pairs).unionByName(searched)
    if not hard.where(~small).isEmpty():
        matched = matched.unionByName(_assign_transport(hard.where(~small), keys, fields))
    kind = F.when(F.col("_rv").isNull(), "only_left").when(F.col("_lv").isNull(), "only_right").otherwise("differs")
    spots = F.array(*[
        F.struct(F.lit(f).alias("field"), F.col("_lv")[f].alias("left_value"), F.col("_rv")[f].alias("right_value")) for f in fields
    ])
    differing = F.filter(spots, lambda s: ~s["left_value"].eqNullSafe(s["right_value"]))
    none = F.array(F.struct(F.lit("").alias("field"), F.lit(None).cast("string").alias("left_value"), F.lit(None).cast("string").alias("right_value")))
    return (
        matched.withColumn("difference", kind)
        .select(*keys, "difference", F.inline(F.when(kind == "differs", differing).otherwise(none)), "n")
        .groupBy(*keys, "difference", "field", "left_value", "right_value")
        .agg(F.sum("n").alias("n"))
    )


def _assign_exact(hard: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Hungarian assignment within each key; the group is bounded by the caller."""
    shape = ", ".join(f"`{f}` string" for f in fields)
    types = dict(hard.dtypes)
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keys), f"_lv struct<{shape.replace('` ', '`: ')}>", f"_rv struct<{shape.replace('` ', '`: ')}>", "n bigint"])

    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        values = [tuple(None if pd.isna(x) else x for x in row) for row in pdf[fields].itertuples(index=False)]
        order = sorted(range(len(values)), key=lambda i: tuple((x is not None, x or "") for x in values[i]))
        lefts = [values[i] for i in order for _ in range(int(pdf["_l"].iloc[i]))]
        rights = [values[i] for i in order for _ in range(int(pdf["_r"].iloc[i]))]
        cost = np.array([[sum(a != b for a, b in zip(x, y)) for y in rights] for x in lefts], dtype=float)
        found = hungarian(cost)
        key = [pdf[k].iloc[0] for k in keys]
        out = [(*key, dict(zip(fields, lefts[a])), dict(zip(fields, rights[b])), 1) for a, b in found]
        used_l, used_r = {a for a, _ in found}, {b for _, b in found}
        out += [(*key, dict(zip(fields, x)), None, 1) for i, x in enumerate(lefts) if i not in used_l]
        out += [(*key, None, dict(zip(fields, y)), 1) for i, y in enumerate(rights) if i not in used_r]
        return pd.DataFrame(out, columns=[*keys, "_lv", "_rv", "n"])

    text = hard.select(*keys, *[F.col(f).cast("string").alias(f) for f in fields], "_l", "_r")
    return text.groupBy(*keys).applyInPandas(assign, schema)


def transport(lefts: list[tuple], n_left: list[int], rights: list[tuple], n_right: list[int]) -> list[tuple[int, int, int]]:
    """(left, right, amount) of a pairing of as many rows as can be with least differing fields in total.

    Combinations meet in nodes for the fields they share: from a left combination to the node of
    a set of shared fields costs the other fields, from there to the right ones is free. So the
    network grows with the combinations, not with their pairs. Flow is sent along shortest paths
    by potentials, all paths of one length at a time.
    """
    width, sets = len(lefts[0]), []
    for size in range(width, -1, -1):
        sets += combinations(range(width), size)
    meet = [{tuple(x[f] for f in s) for x in lefts} & {tuple(x[f] for f in s) for x in rights} for s in sets]
    source, sink, first_right = 0, 1, 2 + len(lefts)
    names: dict[tuple, int] = {}
    head: list[int] = []
    cap: list[int] = []
    cost: list[int] = []
    out: list[list[int]] = [[] for _ in range(first_right + len(rights))]
    unbounded = min(sum(n_left), sum(n_right))

    def edge(a: int, b: int, c: int, w: int) -> None:
        out[a].append(len(head))
        out[b].append(len(head) + 1)
        head.extend((b, a))
        cap.extend((c, 0))
        cost.extend((w, -w))

    def node(name: tuple) -> int:
        if name not in names:
            names[name] = len(out)
            out.append([])
        return names[name]

    for i, x in enumerate(lefts):
        edge(source, 2 + i, n_left[i], 0)
        for s, known in zip(sets, meet):
            if (value := tuple(x[f] for f in s)) in known:
                edge(2 + i, node((s, value)), unbounded, width - len(s))
    for j, y in enumerate(rights):
        edge(first_right + j, sink, n_right[j], 0)
        for s, known in zip(sets, meet):
            if (value := tuple(y[f] for f in s)) in known:
                edge(node((s, value)), first_right + j, unbounded, 0)

    price, left_over = [0] * len(out), unbounded
    while left_over:
        far = [-1] * len(out)
        heap, best = [(0, source)], {source: 0}
        while heap:
            d, a = heappop(heap)
            if far[a] >= 0:
                continue
            far[a] = d
            for e in out[a]:
                b = head[e]
                if cap[e] and far[b] < 0 and (w := d + cost[e] + price[a] - price[b]) < best.get(b, w + 1):
                    best[b] = w
                    heappush(heap, (w, b))
        most = far[sink]
        for a, d in enumerate(far):
            price[a] += most if d < 0 else min(d, most)
        while True:  # all shortest paths, those of fewest edges first
            level, queue = [-1] * len(out), [source]
            level[source] = 0
            for a in queue:
                for e in out[a]:
                    b = head[e]
                    if cap[e] and level[b] < 0 and cost[e] + price[a] == price[b]:
                        level[b] = level[a] + 1
                        queue.append(b)
            if level[sink] < 0:
                break
            at, path = [0] * len(out), []
            while True:
                a = head[path[-1]] if path else source
                if a == sink:
                    sent = min(cap[e] for e in path)
                    for e in path:
                        cap[e] -= sent
                        cap[e ^ 1] += sent
                    left_over -= sent
                    path = path[: next(k for k, e in enumerate(path) if not cap[e])]
                    continue
                while at[a] < len(out[a]):
                    e = out[a][at[a]]
                    if cap[e] and level[head[e]] == level[a] + 1 and cost[e] + price[a] == price[head[e]]:
                        path.append(e)
                        break
                    at[a] += 1
                else:
                    if not path:
                        break
                    at[head[path.pop() ^ 1]] += 1

    found = []
    for n in names.values():
        into = [[head[e] - 2, cap[e]] for e in out[n] if e & 1 and cap[e]]
        for e in out[n]:
            if not e & 1:
                rest = cap[e ^ 1]
                while rest:
                    n_pairs = min(rest, into[-1][1])
                    found.append((into[-1][0], head[e] - first_right, n_pairs))
                    rest -= n_pairs
                    into[-1][1] -= n_pairs
                    if not into[-1][1]:
                        into.pop()
    return found


def _assign_transport(hard: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Least-cost transport between the distinct combinations of each key."""
    shape = ", ".join(f"`{f}`: string" for f in fields)
    types = dict(hard.dtypes)
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keys), f"_lv struct<{shape}>", f"_rv struct<{shape}>", "n bigint"])

    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        values = [tuple(None if pd.isna(x) else x for x in row) for row in pdf[fields].itertuples(index=False)]
        order = sorted(range(len(values)), key=lambda i: tuple((x is not None, x or "") for x in values[i]))
        lefts, rights = [i for i in order if pdf["_l"].iloc[i] > 0], [i for i in order if pdf["_r"].iloc[i] > 0]
        n_left, n_right = [int(pdf["_l"].iloc[i]) for i in lefts], [int(pdf["_r"].iloc[i]) for i in rights]
        found = transport([values[i] for i in lefts], n_left, [values[i] for i in rights], n_right)
        key = [pdf[k].iloc[0] for k in keys]
        named = [dict(zip(fields, v)) for v in values]
        out = [(*key, named[lefts[a]], named[rights[b]], n) for a, b, n in found]
        for a, b, n in found:
            n_left[a] -= n
            n_right[b] -= n
        out += [(*key, named[i], None, n) for i, n in zip(lefts, n_left) if n]
        out += [(*key, None, named[i], n) for i, n in zip(rights, n_right) if n]
        return pd.DataFrame(out, columns=[*keys, "_lv", "_rv", "n"])

    text = hard.select(*keys, *[F.col(f).cast("string").alias(f) for f in fields], "_l", "_r")
    return text.groupBy(*keys).applyInPandas(assign, schema)


def annotation_fields(df: DataFrame) -> DataFrame:
    """The compared fields of an annotation in comparable form.

    Invoice numbers ignore letter case and blanks, amounts compare as numbers (as text where
    they are none), and absent, null and blank values are one and the same.
    """
    number = F.col("invoice")["invoice_number"]
    total = F.nullif(strip(F.col("invoice")["total_amount"]), F.lit(""))
    as_number: Column = coerce_decimal(total, "decimal(38,10)").cast("string")
    return df.select(
        "case_id",
        "annotated_at",
        F.nullif(F.lower(F.regexp_replace(number, r"(?U)\s+", "")), F.lit("")).alias("invoice_number"),
        F.coalesce(as_number, F.lower(total)).alias("total_amount"),
        F.col("expected_needs_review").cast("string").alias("expected_needs_review"),
    )


ANNOTATION_FIELDS = ["invoice_number", "total_amount", "expected_needs_review"]


def latest_only(df: DataFrame, key: str, recency: str, fields: list[str]) -> DataFrame:
    """The latest row of each key (a null time is earliest; on equal times the greatest values).

    A maximum over a struct combines map-side, so a hot key needs neither a sort nor a join.
    """
    return df.groupBy(key).agg(F.max(F.struct(recency, *fields)).alias("_m")).select(key, *[F.col("_m")[f].alias(f) for f in fields])


def annotation_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """(case_id, difference, field) between the latest annotations of the two systems."""
    sides = [latest_only(annotation_fields(x), "case_id", "annotated_at", ANNOTATION_FIELDS) for x in (left, right)]
    found = diff_copies(*sides, ["case_id"], ANNOTATION_FIELDS)
    name = F.when(F.col("difference") == "only_left", "only_in_annotations").when(
        F.col("difference") == "only_right", "only_in_copy"
    ).otherwise("differs")
    return found.select("case_id", name.alias("difference"), "field").distinct()
