"""Sample that stays the same as the table grows (problem 5): permanent random numbers kept in a registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terazi.functions.hashing import SPAN, permanent_int
from terazi.session import materialize, scratch_path
from terazi.sources.io import exists

SEED = "kalici"
#: thresholds by load, non-decreasing
THRESHOLDS = ((1, 0.10), (2, 0.10), (3, 0.12))


class Registry:
    """Identifiers with the uniform number given to them at first sight; appended to, never rewritten.

    Each load is one folder below path, committed when Spark's _SUCCESS marker stands in it. Opening a registry lists the
    committed loads, so any session that opens the same path goes on where the last one ended. A committed load is never
    written again: inserting under its number adds nothing. What a load that failed half-way left behind is overwritten.
    Identifiers that any other load has are left out by an anti-join. A number follows from the identifier and the seed, so
    even a lost registry is rebuilt with the same numbers, whatever the order and partitioning of rows. One writer at a time.
    """

    schema = "id string, prn long, yuk int"

    def __init__(self, spark: SparkSession, path: str, seed: str = SEED):
        self.spark, self.path, self.seed = spark, path.rstrip("/"), seed
        self.loads = self._committed()

    def _committed(self) -> list[int]:
        """The numbers of the loads that are there as a whole."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        files = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(root):
            return []
        names = [s.getPath().getName() for s in files.listStatus(root)]
        numbers = sorted(int(n[4:]) for n in names if n.startswith("yuk=") and n[4:].isdigit())
        return [k for k in numbers if exists(self.spark, f"{self._rows(k)}/_SUCCESS")]

    def _rows(self, load: int) -> str:
        return f"{self.path}/yuk={load}/rows"

    def read(self) -> DataFrame:
        if not self.loads:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[self._rows(k) for k in self.loads])

    def insert(self, ids: DataFrame, load: int) -> bool:
        """Give every id that has none its number; False if the load was committed before, which changes nothing.

        Null ids are left out, repeated ones count once, no ids add none.
        """
        if load in self.loads:
            return False
        fresh = ids.filter(F.col("id").isNotNull()).select("id").distinct()
        if self.loads:
            fresh = fresh.join(self.read().select("id"), "id", "left_anti")
        out = fresh.select("id", permanent_int(F.col("id"), self.seed).alias("prn"), F.lit(load).alias("yuk"))
        out.write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(self._rows(load))
        self.loads.append(load)
        return True

    def extend(self, ids: DataFrame) -> int:
        """Insert under the next free number, which is returned."""
        load = max(self.loads, default=0) + 1
        self.insert(ids, load)
        return load

    def select(self, threshold: float) -> DataFrame:
        """The identifiers whose number is under the threshold."""
        return self.read().filter(F.col("prn") < int(threshold * SPAN))


def stable_sample(decisions: DataFrame, membership: DataFrame, thresholds=THRESHOLDS, seed: str = SEED, path: str | None = None) -> DataFrame:
    """The sample of decisions.id after each load, as (id, havuz): the first load in whose sample the id is.

    decisions: id. membership: id, havuz; an id belongs to the first pool that loaded it, and ids that no pool lists come
    with the last one. Pools are loaded one after the other through the registry. As thresholds never fall, an id sampled
    from a pool is sampled from every later one; decreasing thresholds raise ValueError. Repeated rows, null ids and
    membership of unknown ids change nothing. path: where the registry is kept; by a call with the path of an earlier one,
    its ids keep their numbers and loads, and ids new since then are inserted as a further load under the last threshold.
    """
    rates = [t for _, t in thresholds]
    if rates != sorted(rates):
        raise ValueError("thresholds must not decrease")
    spark = decisions.sparkSession
    registry = Registry(spark, path or scratch_path(spark, "registry"), seed)
    last = thresholds[-1][0]
    first = membership.filter(F.col("id").isNotNull() & F.col("havuz").isNotNull()).groupBy("id").agg(F.min("havuz").alias("havuz"))
    pools = materialize(decisions.select("id").distinct().join(first, "id", "left").select("id", F.coalesce("havuz", F.lit(last)).alias("havuz")), "pools")
    if not [registry.insert(pools.filter(F.col("havuz") <= pool), pool) for pool, _ in thresholds][-1]:
        registry.extend(pools)  # the pools were loaded before; what came since then is new
    first_pool = F.least("yuk", F.lit(last))
    by_load = F.coalesce(*[F.when((first_pool <= pool) & (F.col("prn") < int(rate * SPAN)), F.lit(pool)) for pool, rate in thresholds])
    return registry.read().select("id", by_load.alias("havuz")).filter(F.col("havuz").isNotNull())
