"""Sample whose category shares match target proportions (problem 1)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terazi.functions.hashing import SPAN, permanent_int
from terazi.functions.turkish import spelling_key
from terazi.session import materialize

SEED = "pay"
#: a category's reservoirs are cut at a key found in a histogram of so many key ranges
RANGES = 4096
SPAN_BITS = 52
#: standard deviations by which a partition keeps more than its expected part of a quota
SLACK = 6.0


class Reservoir:
    """Pairs (key, id) of one category under a horizon, and the number of all that were seen; two of them merge by adding.

    All that was seen under the horizon is kept. The horizon comes down when more is kept than is wanted, so merging any split
    of the rows in any order gives a true bottom sample of all of them, as far as the lower of the two horizons.
    """

    def __init__(self):
        self.seen, self.horizon, self.keys, self.ids = 0, SPAN, np.empty(0, np.int64), pa.array([], pa.string())

    def add(self, keys: np.ndarray, ids: pa.Array, seen: int | None = None) -> Reservoir:
        self.seen += len(keys) if seen is None else seen
        under = np.flatnonzero(keys < self.horizon)
        self.keys, self.ids = np.concatenate([self.keys, keys[under]]), pa.concat_arrays([self.ids, ids.take(pa.array(under))])
        return self

    def trim(self, wanted: int) -> None:
        """Lower the horizon to the least key beyond the wanted ones."""
        if len(self.keys) > wanted:
            self.horizon = int(np.partition(self.keys, wanted)[wanted])
            self._drop()

    def _drop(self) -> None:
        under = np.flatnonzero(self.keys < self.horizon)
        self.keys, self.ids = self.keys[under], self.ids.take(pa.array(under))

    def merge(self, other: Reservoir) -> Reservoir:
        self.horizon = min(self.horizon, other.horizon)
        self._drop()
        return self.add(other.keys, other.ids, other.seen)


def _fill(quota: dict[int, int], total: int, slack: float):
    """Reservoirs of a partition, merged batch by batch.

    Rows lie in partitions by the hash of their id, so a partition that holds m of total rows holds about quota * m / total of
    the least keys; slack standard deviations more are kept.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine: dict[int, Reservoir] = {}
        rows = 0

        def wanted(category: int) -> int:
            share = quota.get(category, 0) * min(1.0, rows / total)
            return int(share + slack * math.sqrt(share)) + (16 if slack else 0) if category in quota else 0

        for batch in batches:
            rows += batch.num_rows
            categories, keys = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            for category in np.unique(categories).tolist():
                at = np.flatnonzero(categories == category)
                held = mine.setdefault(category, Reservoir()).merge(Reservoir().add(keys[at], batch.column(1).take(pa.array(at))))
                if len(held.keys) > 2 * wanted(category) + 1000:  # not at each batch
                    held.trim(wanted(category))
        for category, held in mine.items():
            held.trim(wanted(category))
            n = len(held.keys)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n + 1, category, np.int32)), pa.concat_arrays([pa.array([None], pa.string()), held.ids]), pa.array(np.append([held.horizon], held.keys)), pa.array([held.seen] + [None] * n, pa.int64())],
                ["hedef_id", "id", "key", "seen"],
            )

    return run


def decisions(rows: DataFrame) -> DataFrame:
    """One row per id with the spelling keys of its source and court; the court of any of its rows counts.

    Null ids are no decisions. If rows of an id disagree, the alphabetically last key is taken. Text isn't read.
    """
    return (
        rows.filter(F.col("id").isNotNull())
        .groupBy("id")
        .agg(F.max(spelling_key(F.col("source"))).alias("source_key"), F.max(spelling_key(F.col("court"))).alias("court_key"))
    )


def quota_sample(rows: DataFrame, targets: DataFrame, fraction_divisor: int = 10, seed: str = SEED, slack: float = SLACK) -> tuple[DataFrame, DataFrame]:
    """Draw n = D // fraction_divisor decisions with target shares per category; returns (sample, report).

    rows: id, source, court (more columns are ignored). targets: hedef_id, source, court, hedef_binde, en_az, a small
    table, one row per category; rows with a null hedef_id are ignored and null numbers count as 0. A category's quota is
    the larger of en_az and ceil(hedef_binde * n / 1000); it gets all its decisions if fewer exist, and the report says by
    how many it falls short. Sample: id, source, court (spelled as in targets), hedef_id. Report: the target's columns,
    var (decisions there), kota, alinan, eksik. Empty rows give an empty sample and a report of zeros.

    One pass fills reservoirs in every partition, each with its part of the quota, which is bounded by the number of rows (from
    file footers), and a margin. After the counts are final each category is cut at its quota: the key range that holds the
    quota is found from a histogram of RANGES ranges per category, and only that range, 1 / RANGES of the category, is ranked.
    Should a partition have kept too little (its horizon says so), the pass is run again with nothing trimmed.
    """
    spark = rows.sparkSession
    want = [r for r in targets.select("hedef_id", "source", "court", "hedef_binde", "en_az").collect() if r.hedef_id is not None]
    total = rows.count()
    quota = lambda r, n: max(r.en_az or 0, -(-(r.hedef_binde or 0) * n // 1000))
    most = {r.hedef_id: quota(r, total // fraction_divisor) for r in want}
    keyed = (
        targets.filter(F.col("hedef_id").isNotNull())
        .select("hedef_id", spelling_key(F.col("source")).alias("source_key"), spelling_key(F.col("court")).alias("court_key"))
    )
    drawn = (
        decisions(rows)
        .join(F.broadcast(keyed), ["source_key", "court_key"], "left")  # a row per category
        # decisions of no category only count towards D
        .select(F.coalesce("hedef_id", F.lit(-1)).cast("int").alias("hedef_id"), "id", permanent_int(F.col("id"), seed).alias("key"))
    )
    span = F.shiftright("key", SPAN_BITS - 12)
    for margin in (slack, None):
        kept = materialize(drawn.mapInArrow(_fill(most if margin is not None else dict.fromkeys(most, total), max(1, total), margin or 0.0), "hedef_id int, id string, key long, seen long"), "reservoir")
        horizons = kept.filter(F.col("id").isNull()).groupBy("hedef_id").agg(F.min("key").alias("horizon"), F.sum("seen").alias("seen"))
        state = {r.hedef_id: r for r in horizons.collect()}  # a row per category
        under = kept.filter(F.col("id").isNotNull()).join(F.broadcast(horizons.select("hedef_id", "horizon")), "hedef_id").filter(F.col("key") < F.col("horizon")).drop("horizon", "seen")
        # counts per category and key range: at most RANGES rows for each row of targets
        hist: dict[int, dict[int, int]] = {}
        for r in under.groupBy("hedef_id", span.alias("span")).agg(F.count("*").alias("n")).collect():
            hist.setdefault(r.hedef_id, {})[r.span] = r.n
        found = {k: r.seen for k, r in state.items()}
        n = sum(found.values()) // fraction_divisor
        if all(sum(hist.get(r.hedef_id, {}).values()) >= min(quota(r, n), found.get(r.hedef_id, 0)) for r in want):
            break
    cuts, report = [], []
    for r in want:
        need, left = quota(r, n), min(quota(r, n), found.get(r.hedef_id, 0))
        report.append((r.hedef_id, r.source, r.court, r.hedef_binde, r.en_az, found.get(r.hedef_id, 0), need, left, max(0, need - found.get(r.hedef_id, 0))))
        edge, rest = -1, 0
        for s in sorted(hist.get(r.hedef_id, {})):
            edge, rest = s, left
            left -= hist[r.hedef_id][s]
            if left <= 0:
                break
        cuts.append((r.hedef_id, r.source, r.court, edge, max(0, rest)))
    report_df = spark.createDataFrame(report, "hedef_id int, source string, court string, hedef_binde int, en_az int, var long, kota long, alinan long, eksik long")
    cut = F.broadcast(spark.createDataFrame(cuts, "hedef_id int, source string, court string, edge long, rest long"))
    cand = under.withColumn("span", span).join(cut, "hedef_id").filter(F.col("span") <= F.col("edge"))
    whole = cand.filter(F.col("span") < F.col("edge"))
    edge = (
        cand.filter(F.col("span") == F.col("edge"))
        .withColumn("rn", F.row_number().over(W.partitionBy("hedef_id").orderBy("key", "id")))
        .filter(F.col("rn") <= F.col("rest"))
    )
    cols = ["id", "source", "court", "hedef_id"]
    return whole.select(cols).unionByName(edge.select(cols)), report_df


def found(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Rows of targets that a sample cannot meet: source, court as spelled there."""
    _, report = quota_sample(rows, targets)
    return report.filter(F.col("eksik") > 0).select("source", "court")
