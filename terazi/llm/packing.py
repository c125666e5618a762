"""Filling fixed-capacity containers with items of varying length (problem 8).

Lengths are rounded up to a grid of GRID steps per capacity, so that the whole problem is a histogram of at most GRID + 1
numbers, however many items there are. Shallow combinations of lengths that fill a container are the columns of a
non-negative least-squares problem whose right side is the histogram; the solution, rounded down, says how often each
combination is used. What remains of the histogram goes through the same once more, with the combinations that leave the least
room, and what remains then is packed greedily. The items take their places by their ordinal number within their length,
which follows from counts per partition: no item is shuffled or sorted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terazi.llm.encoding import count_tokens
from terazi.session import materialize

GRID = 512  # at most 1,000, so that a combination fits a 64-bit key
#: offsets of partitions are broadcast up to this many rows, else joined by shuffle
BROADCAST_ROWS = 500_000


def combinations(sizes: np.ndarray, window: int, exact: bool = True) -> np.ndarray:
    """Rows (a, i, b, j, c, k): i times a, j times b and k times c, of at most three distinct lengths, that fill the window.

    For every pair of lengths a and b, a stands once or as often as it fits, b once, and c is what fits then. exact: nothing
    is left. Else c is the longest length that fits, and of the combinations with each a those come that leave the least.
    """
    if not len(sizes):
        return np.empty((0, 6), np.int64)
    none = np.zeros(1, np.int64)
    partners = np.concatenate([none, sizes])
    a, b = (x.ravel() for x in np.meshgrid(sizes, partners, indexing="ij"))
    out = []
    for i in (np.ones_like(a), np.maximum(1, window // a), np.maximum(1, window // a - 1)):
        rest = window - i * a - b
        fits = rest >= 0
        x, y, n, rest = a[fits], b[fits], i[fits], rest[fits]
        c = partners[np.searchsorted(partners, rest, "right") - 1]
        k = np.where(c > 0, rest // np.maximum(c, 1), 0)
        out.append(np.stack([x, n, y, (y > 0).astype(np.int64), c, k, rest - k * c], 1))
    rows = np.concatenate(out)
    if exact:
        rows = rows[rows[:, 6] == 0]
    else:
        least = np.full(window + 1, window, np.int64)
        np.minimum.at(least, rows[:, 0], rows[:, 6])
        rows = rows[rows[:, 6] == least[rows[:, 0]]]
    # the same lengths in one order, equal ones together, each combination once
    rows = rows[:, :6].copy()
    for p, q in ((0, 2), (0, 4), (2, 4)):
        same = (rows[:, p] == rows[:, q]) & (rows[:, q] > 0)
        rows[same, p + 1] += rows[same, q + 1]
        rows[same, q : q + 2] = 0
        swap = rows[:, p] < rows[:, q]
        rows[swap, p : p + 2], rows[swap, q : q + 2] = rows[swap, q : q + 2].copy(), rows[swap, p : p + 2].copy()
    key = np.zeros(len(rows), np.int64)
    for column in rows.T:
        key = key * (window + 1) + column  # six numbers up to the window, which stays below 2 ** 10
    return rows[np.unique(key, return_index=True)[1]]


def non_negative_least_squares(rows: np.ndarray, values: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """x >= 0 that makes |a x - b| small, by multiplicative updates, for a and b without negative entries.

    Column c of a has values[c, k] in row rows[c, k], and nothing elsewhere.
    """
    at = rows.ravel()
    x = np.full(len(rows), max(b.sum(), 1.0) / max(values.sum(), 1.0))
    up = (values * b[rows]).sum(1)
    for _ in range(rounds):
        product = np.bincount(at, (values * x[:, None]).ravel(), len(b))
        x *= up / ((values * product[rows]).sum(1) + 1e-12)
    return x


def _solved(left: np.ndarray, window: int, exact: bool) -> list[tuple[dict[int, int], int]]:
    """Combinations and how often each is used, by least squares; what they use is taken from left (items by length)."""
    sizes = np.flatnonzero(left)
    combos = combinations(sizes, window, exact)
    if not len(combos):
        return []
    row = np.zeros(window + 1, np.int64)
    row[sizes] = np.arange(len(sizes))
    rows, values = row[combos[:, ::2]], combos[:, 1::2].astype(float)
    weight = np.sqrt(sizes / window)  # long items are the harder to place later
    x = np.floor(non_negative_least_squares(rows, values * weight[rows], left[sizes] * weight)).astype(np.int64)
    used = []
    for c in np.argsort(-x, kind="stable"):
        if x[c] < 1:
            break
        combo = {int(k): int(m) for k, m in combos[c].reshape(3, 2) if m}
        times = min(int(x[c]), *(int(left[k]) // m for k, m in combo.items()))
        if times > 0:
            used.append((combo, times))
            for k, m in combo.items():
                left[k] -= m * times
    return used


def plan(histogram: dict[int, int], window: int = GRID) -> list[tuple[dict[int, int], int]]:
    """[(combination, how often)] that places every item of {length: count}; a combination's sum never exceeds the window."""
    if any(k < 1 or k > window for k, v in histogram.items() if v > 0):
        raise ValueError("lengths must lie between 1 and the window")
    counts = np.zeros(window + 1, np.int64)
    for k, v in histogram.items():
        counts[k] = max(0, v)
    used = _solved(counts, window, True) + _solved(counts, window, False)
    left = {int(k): int(counts[k]) for k in np.flatnonzero(counts)}
    while left:  # each round uses up a length
        room, combo = window, {}
        for k in sorted(left, reverse=True):
            if (m := min(left[k], room // k)) > 0:
                combo[k], room = m, room - m * k
        times = min(left[k] // m for k, m in combo.items())
        used.append((combo, times))
        for k, m in combo.items():
            left[k] -= m * times
            if not left[k]:
                del left[k]
    return used


def _slots(used: list[tuple[dict[int, int], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length the ordinals from which a combination's places start, the places a container has, its first container."""
    slots: dict[int, list[tuple[int, int, int]]] = {}
    reached: dict[int, int] = {}
    container = 0
    for combo, times in used:
        for k, m in combo.items():
            slots.setdefault(k, []).append((reached.get(k, 0), m, container))
            reached[k] = reached.get(k, 0) + m * times
        container += times
    return {k: tuple(np.array(x, np.int64) for x in zip(*v)) for k, v in slots.items()}


def _parts(items: DataFrame, caps: list[int], grid: int) -> DataFrame:
    """doc_id, parca_no, baslangic, tokens, cap, step, part, nth: what goes into containers of each capacity.

    step is the length on the grid, rounded up (capacities below the grid are their own grid). nth counts within the
    partition, cap and step from 0; it is written down together with the partition's number, so that both keep their meaning.
    """
    names = ["doc_id", "parca_no", "baslangic", "tokens", "cap", "step", "part", "nth"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        seen = {c: np.zeros(min(grid, c) + 1, np.int64) for c in caps}
        for batch in batches:
            whole = np.nan_to_num(batch.column(1).to_numpy(zero_copy_only=False), nan=0).astype(np.int64)
            for cap in caps:
                n = np.maximum(1, -(-whole // cap))
                for at, to in _slices(n):
                    owner = np.repeat(np.arange(at, to), n[at:to])
                    number = np.arange(len(owner)) - np.repeat(np.cumsum(n[at:to]) - n[at:to], n[at:to])
                    tokens = np.minimum(cap, whole[owner] - number * cap)
                    step = -(-tokens * min(grid, cap) // cap)
                    order = np.argsort(step, kind="stable")
                    first = np.searchsorted(step[order], step[order], "left")
                    nth = np.empty(len(step), np.int64)
                    nth[order] = np.arange(len(step)) - first
                    nth += seen[cap][step]
                    seen[cap] += np.bincount(step, minlength=len(seen[cap]))
                    same = lambda v, m=len(owner): pa.array(np.full(m, v, np.int32))
                    ints = lambda v: pa.array(v.astype(np.int32))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), ints(number), pa.array(number * cap), pa.array(tokens), same(cap), ints(step), same(part), pa.array(nth)], names)

    rows = items.select("doc_id", F.col("tokens").cast("long"))
    return materialize(rows.mapInArrow(run, "doc_id long, parca_no int, baslangic long, tokens long, cap int, step int, part int, nth long"), "parts")


def _slices(n: np.ndarray, most: int = 200_000) -> Iterator[tuple[int, int]]:
    """Ranges of items that give at most so many parts, or of a single item."""
    ends, at = np.cumsum(n), 0
    while at < len(n):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield at, to
        at = to


def pack(items: DataFrame, capacities: dict[str, int], grid: int = GRID, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """model, doc_id, parca_no, baslangic, tokens, konteyner for every item of (doc_id, tokens) and every capacity by name.

    An item beyond the capacity is split into full containers and a rest; no other is split. An item of no tokens (or of
    null) gets one row with a null konteyner. Containers are numbered from 0 in each model, and the tokens of one never
    exceed its capacity. Repeated doc_ids are items of their own. No items give no rows, and capacities below 1 are left out.
    """
    spark = items.sparkSession
    named = {m: int(c) for m, c in capacities.items() if c and c > 0}
    schema = "model string, doc_id long, parca_no int, baslangic long, tokens long, konteyner long"
    if not named:
        return spark.createDataFrame([], schema)
    caps = sorted(set(named.values()))  # models of one capacity share their containers' plan
    parts = _parts(items, caps, grid)
    counts = materialize(parts.groupBy("cap", "step", "part").agg(F.count("*").alias("n")), "part-counts")
    histogram: dict[int, dict[int, int]] = {c: {} for c in caps}
    for r in counts.filter("step > 0").groupBy("cap", "step").agg(F.sum("n").alias("n")).collect():  # at most capacities x GRID rows
        histogram[r.cap][r.step] = r.n
    slots = spark.sparkContext.broadcast({c: _slots(plan(h, min(grid, c))) for c, h in histogram.items()})
    # where each partition's items of a length begin among all of that length
    before = W.partitionBy("cap", "step").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    small = counts.count() <= broadcast_rows
    placed = parts.join(F.broadcast(offsets) if small else offsets, ["cap", "step", "part"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cap, step, ordinal = (batch.column(i).to_numpy() for i in range(3))
            out = np.full(len(cap), -1, np.int64)
            key = cap.astype(np.int64) * (grid + 1) + step
            order = np.argsort(key, kind="stable")
            starts = np.flatnonzero(np.diff(key[order], prepend=-1))
            for rows in np.split(order, starts[1:]):
                if len(rows) and step[rows[0]] > 0:
                    at, places, first = slots.value[int(cap[rows[0]])][int(step[rows[0]])]
                    which = np.searchsorted(at, ordinal[rows], "right") - 1
                    out[rows] = first[which] + (ordinal[rows] - at[which]) // places[which]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3, 7)), batch.column(0), pa.array(out, mask=out < 0)], ["doc_id", "parca_no", "baslangic", "tokens", "cap", "konteyner"])

    rows = placed.select("cap", "step", (F.col("offset") + F.col("nth")).alias("ordinal"), "doc_id", "parca_no", "baslangic", "tokens")
    done = rows.mapInArrow(run, "doc_id long, parca_no int, baslangic long, tokens long, cap int, konteyner long")
    models = F.broadcast(spark.createDataFrame(list(named.items()), "model string, cap int"))  # a row for each capacity asked for
    return done.join(models, "cap").select("model", "doc_id", "parca_no", "baslangic", "tokens", "konteyner")


def pack_documents(docs: DataFrame, models: DataFrame, path: str | None = None) -> DataFrame:
    """pack() of every document, measured by the public tokenizer, into containers of each model's max_tokens.

    models is a small table; a null model or max_tokens is left out.
    """
    capacities = {r.model: r.max_tokens for r in models.select("model", "max_tokens").collect() if r.model is not None}
    return pack(count_tokens(docs.select("doc_id", "text"), "text", "tokens", path), capacities)


def invariants(packed: DataFrame, docs: DataFrame, models: DataFrame) -> DataFrame:
    """model, belge, fazla, bolunen, eksik: documents packed, containers beyond their capacity, documents split though they fit a
    container or into more parts than need be, and documents whose parts don't follow each other from 0 to their end."""
    caps = models.filter(F.col("max_tokens") > 0).groupBy("model").agg(F.max("max_tokens").alias("cap"))
    used = packed.filter(F.col("konteyner").isNotNull()).groupBy("model", "konteyner").agg(F.sum("tokens").alias("t"))
    over = used.join(caps, "model").groupBy("model").agg(F.sum((F.col("t") > F.col("cap")).cast("int")).alias("fazla"))
    part = F.struct("baslangic", "tokens")
    per = packed.groupBy("model", "doc_id").agg(F.count("*").alias("n"), F.sum("tokens").alias("t"), F.max(F.col("baslangic") + F.col("tokens")).alias("end"), F.count_distinct(part).alias("distinct"), F.count("konteyner").alias("placed"))
    need = F.greatest(F.lit(1), F.ceil(F.col("t") / F.col("cap")))
    whole = per.join(caps, "model").groupBy("model").agg(
        F.count("*").alias("belge"), F.sum((F.col("n") != need).cast("int")).alias("bolunen"),
        F.sum(((F.col("t") != F.col("end")) | (F.col("distinct") != F.col("n")) | ((F.col("placed") != F.col("n")) != (F.col("t") == 0))).cast("int")).alias("eksik"),
    )
    return whole.join(over, "model", "left").select("model", "belge", F.coalesce("fazla", F.lit(0)).alias("fazla"), "bolunen", "eksik")


def fill_report(packed: DataFrame, models: DataFrame) -> DataFrame:
    """model, containers, tokens, doluluk (share of the containers' capacity in use)."""
    used = packed.filter(F.col("konteyner").isNotNull()).groupBy("model").agg((F.max("konteyner") + 1).alias("containers"), F.sum("tokens").alias("tokens"))
    caps = F.broadcast(models.select("model", "max_tokens").dropDuplicates(["model"]))
    return used.join(caps, "model").select("model", "containers", "tokens", F.round(F.col("tokens") / (F.col("containers") * F.col("max_tokens")), 4).alias("doluluk"))
