"""Filling fixed-capacity containers with texts (problem 7).

Method: pattern packing. Token counts are reduced to a histogram, which has at most `capacity` entries whatever the
data. Patterns of one to three lengths are enumerated, how often each is used is fitted to the histogram by
non-negative least squares and rounded one pattern after the other, the most used first, while the texts last; what is
left over is packed best fit first, many equal containers at a time. Texts then take their places by their rank among the texts of their length; ranks are counted in salted
parts, so that one frequent length is spread over many tasks.

Defined results: a text above the capacity is split into full containers and a remainder, no other text is split;
texts without tokens (null and empty ones) are spread over the containers that there are, or go to container 0;
repeated rows are texts of their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowgrain.llm.tokens import VOCABULARY, token_counts
from flowgrain.session import cut

#: Rounds of the multiplicative least-squares fit.
FIT_ROUNDS = 150
#: Tokens that a pattern may leave unused.
SLACK = 1
#: Items of one length that are ranked in one task, about.
ITEMS_A_SALT = 200_000

Group = tuple[dict[int, int], int]


def patterns(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Rows of one to three lengths (0: none) that fill a container but for `SLACK`; the last is the largest that fits.

    Patterns that leave more room would let the fit reach the histogram by waste alone.
    """
    lengths = np.sort(lengths)
    largest = np.zeros(capacity + 1, dtype=np.int64)
    largest[lengths] = lengths
    largest = np.maximum.accumulate(largest)
    found = [np.zeros((0, 3), dtype=np.int64)]
    for a in lengths.tolist():  # one longest text at a time, so that only patterns that are kept are held together
        b = lengths[: np.searchsorted(lengths, min(a, capacity - a), side="right")]
        c = np.minimum(largest[capacity - a - b], b)
        full = a + b + c >= capacity - SLACK
        found.append(np.stack([np.full(int(full.sum()), a), b[full], c[full]], axis=1))
    ones = np.stack([lengths, np.zeros_like(lengths), np.zeros_like(lengths)], axis=1)
    pairs = np.stack([lengths, np.minimum(largest[capacity - lengths], lengths), np.zeros_like(lengths)], axis=1)
    rows = np.concatenate([ones, pairs, *found])
    return np.unique(rows[rows.sum(axis=1) >= capacity - SLACK], axis=0)


def fit(histogram: np.ndarray, rows: np.ndarray, capacity: int) -> np.ndarray:
    """How often each pattern is used: the least-squares fit of pattern counts to the histogram, none below zero."""
    size = capacity + 1
    weight = np.arange(size, dtype=float) / capacity  # a long text that finds no place costs more than a short one
    weight[0] = 0
    goal = histogram * weight
    x = np.full(len(rows), max(1e-9, histogram[1:].sum() / max(1, len(rows)) / 3))

    def back(v: np.ndarray) -> np.ndarray:
        return (v * weight)[rows].sum(axis=1)

    up = back(goal)
    for _ in range(FIT_ROUNDS):
        made = sum(np.bincount(rows[:, i], x, size) for i in range(3)) * weight
        x *= up / np.maximum(back(made), 1e-12)
    return x


def plan(histogram: np.ndarray, capacity: int) -> list[Group]:
    """Groups of equal containers: (length -> texts of it in each container, number of containers)."""
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    lengths = np.flatnonzero(left)
    groups: list[Group] = []
    if not len(lengths):
        return groups
    rows = patterns(lengths, capacity).reshape(-1, 3)
    counts = fit(left, rows, capacity)
    # the fit spreads counts over many patterns of which few come to one each; so they are rounded one after the other,
    # the largest first, up to the next whole number as long as the texts last
    for k in np.lexsort((-rows.sum(axis=1), -counts)).tolist():
        if counts[k] <= 0:
            break
        content: dict[int, int] = defaultdict(int)
        for length in rows[k].tolist():
            if length:
                content[length] += 1
        n = min([int(np.ceil(counts[k])), *(int(left[x] // m) for x, m in content.items())])
        if n > 0:
            groups.append((dict(content), n))
            for x, m in content.items():
                left[x] -= n * m
    room: dict[int, list[Group]] = defaultdict(list)
    for g in groups:
        room[capacity - sum(k * m for k, m in g[0].items())].append(g)
    for length in np.flatnonzero(left)[::-1].tolist():
        todo = int(left[length])
        for space in sorted(s for s in room if s >= length):
            each = space // length
            while todo and room.get(space):
                content, n = room[space].pop()
                for times, bins in ((each, min(n, todo // each)), (todo % each if todo // each < n else 0, 1)):
                    if times and bins:
                        room[space - times * length].append((content | {length: content.get(length, 0) + times}, bins))
                        todo, n = todo - times * bins, n - bins
                if n:
                    room[space].append((content, n))
            if not todo:
                break
        each = capacity // length
        for times, bins in ((each, todo // each), (todo % each, 1)):
            if times and bins:
                room[capacity - times * length].append(({length: times}, bins))
    return [g for space in sorted(room) for g in room[space]]


def places(groups: list[Group]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: the first ranks of its runs, texts a container in each, and the first container of each."""
    runs: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    taken: dict[int, int] = defaultdict(int)
    base = 0
    for content, n in groups:
        for length, m in content.items():
            runs[length].append((taken[length], m, base))
            taken[length] += m * n
        base += n
    return {k: tuple(np.array(c) for c in zip(*v)) for k, v in runs.items()}


def pack(sizes: DataFrame, key: str = "doc_id", size: str = "n_tokens", capacity: int = 2048) -> DataFrame:
    """`key`, `part_no`, `start_token`, `n_tokens`, `container_id` of each text of a given size, or of its parts."""
    items = cut(
        sizes.select(key, F.col(size).alias("total"))
        .withColumn("part_no", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.floor((F.col("total") - 1) / capacity)))))
        .select(key, F.col("part_no").cast("int").alias("part_no"), (F.col("part_no") * capacity).alias("start_token"), F.least(F.lit(capacity).cast("long"), F.col("total") - F.col("part_no") * capacity).cast("int").alias("n_tokens"))
    )
    histogram = np.zeros(capacity + 1, dtype=np.int64)
    for r in items.groupBy("n_tokens").count().collect():  # at most capacity + 1 rows
        histogram[r[0]] = r[1]
    groups = plan(histogram, capacity)
    runs, n_containers = places(groups), max(1, sum(n for _, n in groups))

    salts = int(np.clip(histogram.max() // ITEMS_A_SALT + 1, 8, 1 << 20))
    salted = items.withColumn("salt", F.pmod(F.xxhash64(key, "part_no"), F.lit(salts)).cast("int"))
    before = salted.groupBy("n_tokens", "salt").count().withColumn("before", F.sum("count").over(Window.partitionBy("n_tokens").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)))
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("n_tokens", "salt").orderBy(key, "part_no")) - 1).join(before.select("n_tokens", "salt", "before"), ["n_tokens", "salt"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.coalesce("before", F.lit(0)))

    @F.pandas_udf("long")
    def container(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for length, rank in batches:
            out = np.empty(len(rank), dtype=np.int64)
            length, rank = length.to_numpy(), rank.to_numpy()
            for one in np.unique(length):
                at = length == one
                if one == 0:
                    out[at] = rank[at] % n_containers
                else:
                    first, each, base = runs[int(one)]
                    i = np.searchsorted(first, rank[at], side="right") - 1
                    out[at] = base[i] + (rank[at] - first[i]) // each[i]
            yield pd.Series(out)

    return ranked.select(key, "part_no", "start_token", "n_tokens", container("n_tokens", "rank").alias("container_id"))


def pack_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = 2048, vocabulary: str = VOCABULARY) -> DataFrame:
    """Assigns each document, sized in tokens, to containers of `capacity` tokens."""
    return pack(token_counts(docs, key, text, vocabulary), key, "n_tokens", capacity)
