"""Building decision pools: quotas, block samples, newest-first samples, growth of a pool, summaries."""

from __future__ import annotations

from decimal import ROUND_HALF_EVEN, Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terazi.functions.turkish import spelling_key

#: sources and their shares of a pool (fixed values)
SOURCE_SHARES = {"yargitay": 0.40, "emsal": 0.25, "danistay": 0.20, "aym_bb": 0.10, "aym_norm": 0.05}
ROWS_PER_BLOCK, MIN_TEXT_LEN, SEED, BASE_SIZE = 100, 300, 42, 2000


def source_key(source: Column) -> Column:
    """The plain spelling of a source: small letters, underscores between words."""
    return F.replace(spelling_key(source), F.lit(" "), F.lit("_"))


def quota_table(size: int, shares: dict[str, float] = SOURCE_SHARES) -> list[tuple[str, int]]:
    """Rows per source for a pool of this size, halves rounded to even."""
    return [(s, int((Decimal(str(p)) * size).quantize(Decimal(1), ROUND_HALF_EVEN))) for s, p in shares.items()]


def seed_for(size: int) -> int:
    """Seed of a pool: larger pools than the base draw anew."""
    return SEED if size == BASE_SIZE else SEED + size


def usable(rows: DataFrame, least: int = MIN_TEXT_LEN) -> DataFrame:
    """Decisions whose text is at least so long, one row per id, source in plain spelling.

    Of repeated rows the one with the most known fields stays, then the least by content. text_len is measured anew
    because stored ones may be stale; null ids and texts are left out. The text itself doesn't travel: only its length does.
    """
    known = sum(F.col(c).isNotNull().cast("int") for c in ("court", "esas_no", "karar_no", "karar_tarihi"))
    cols = ["id", source_key(F.col("source")).alias("source"), "court", "esas_no", "karar_no", "karar_tarihi", "year", F.length("text").alias("text_len")]
    slim = rows.filter(F.col("id").isNotNull() & (F.length("text") >= least)).select(*cols, known.alias("known"))
    order = [F.col("known").desc(), "court", "esas_no", "karar_no", "karar_tarihi", "year"]
    return slim.withColumn("rn", F.row_number().over(W.partitionBy("id").orderBy(*order))).filter("rn = 1").drop("rn", "known")


def _draw(seed: int, *cols: str) -> Column:
    return F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in cols], F.lit(str(seed))))


def _quotas(rows: DataFrame, size: int) -> DataFrame:
    return F.broadcast(rows.sparkSession.createDataFrame(quota_table(size), "source string, quota int"))


def smallest_per_group(rows: DataFrame, group: str, key: str, quota: Column, buckets: int = 256) -> DataFrame:
    """The rows of each group with the least (key, id), as many as its quota, without a group in one task.

    key is a hexadecimal hash. Rows are counted by group and first two digits; those two digits in which the quota is
    reached are ranked, the ones below are taken whole.
    """
    spread = rows.withColumn("bucket", F.substring(key, 1, 2))
    counts = spread.groupBy(group, "bucket").agg(F.count("*").alias("n"), F.max(quota).alias("want"))
    before = F.coalesce(F.sum("n").over(W.partitionBy(group).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    cut = counts.withColumn("before", before).filter(F.col("before") < F.col("want")).withColumn("rest", F.col("want") - F.col("before"))
    near = spread.join(F.broadcast(cut.select(group, "bucket", "n", "rest")), [group, "bucket"])  # groups x 256 rows at most
    whole = near.filter(F.col("n") <= F.col("rest"))
    edge = near.filter(F.col("n") > F.col("rest")).withColumn("rn", F.row_number().over(W.partitionBy(group, "bucket").orderBy(key, "id"))).filter(F.col("rn") <= F.col("rest"))
    return whole.select(rows.columns).unionByName(edge.select(rows.columns))


def quota_sample(rows: DataFrame, size: int = BASE_SIZE, exclude: DataFrame | None = None, seed: int | None = None, quotas: DataFrame | None = None) -> DataFrame:
    """A pool of about `size` decisions with the sources' shares, drawn by seeded hash; ids of exclude are left out.

    A source with fewer decisions gives all it has. The same rows give the same sample in any order and partitioning.
    """
    seed = seed_for(size) if seed is None else seed
    pool = usable(rows)
    if exclude is not None:
        pool = pool.join(exclude.select("id").filter(F.col("id").isNotNull()).distinct(), "id", "left_anti")
    keyed = pool.join(quotas if quotas is not None else _quotas(rows, size), "source").withColumn("key", _draw(seed, "id"))
    return smallest_per_group(keyed, "source", "key", F.col("quota")).drop("key", "quota")


def block_sample(rows: DataFrame, block: str, size: int = BASE_SIZE, seed: int = SEED) -> DataFrame:
    """A pool drawn from randomly chosen blocks: per source as many blocks as the quota needs at ROWS_PER_BLOCK rows each,
    then an equal number of rows from each chosen block, then the quota.

    rows hold a block column beside those of a decision; null blocks aren't drawn.
    """
    q = _quotas(rows, size)
    blocks = rows.filter(F.col(block).isNotNull()).select(source_key(F.col("source")).alias("source"), F.col(block).alias("block")).distinct()
    counted = blocks.join(q, "source").withColumn("n_blocks", F.count("*").over(W.partitionBy("source")))
    wanted = F.least(F.col("n_blocks"), F.ceil(F.col("quota") / ROWS_PER_BLOCK))
    rank = F.row_number().over(W.partitionBy("source").orderBy(_draw(seed, "block"), "block"))
    chosen = counted.withColumn("rank", rank).filter(F.col("rank") <= wanted).select("source", "block", "quota", F.ceil(F.col("quota") / wanted).alias("each"))
    keyed = rows.withColumn("source", source_key(F.col("source"))).withColumnRenamed(block, "block").join(chosen, ["source", "block"])
    slim = keyed.filter(F.col("id").isNotNull() & (F.length("text") >= MIN_TEXT_LEN)).select("id", "source", "block", "quota", "each").dropDuplicates(["id"])
    within = F.row_number().over(W.partitionBy("source", "block").orderBy(_draw(seed, "id"), "id"))
    some = slim.withColumn("rn", within).filter(F.col("rn") <= F.col("each")).withColumn("key", _draw(seed + 1, "id"))
    return smallest_per_group(some.select("id", "source", "block", "quota", "key"), "source", "key", F.col("quota")).select("id", "source", "block")


def newest_per_source(rows: DataFrame, size: int = BASE_SIZE) -> DataFrame:
    """The newest dated decisions of each source up to its quota; dates compare as text, ids break ties.

    A source's day of the last row that fits is found from counts by date, so no source is sorted in one task.
    """
    dated = usable(rows).filter(F.col("karar_tarihi").isNotNull()).join(_quotas(rows, size), "source")
    days = dated.groupBy("source", "karar_tarihi").agg(F.count("*").alias("n"), F.max("quota").alias("q"))
    newer = F.coalesce(F.sum("n").over(W.partitionBy("source").orderBy(F.col("karar_tarihi").desc()).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    take = days.withColumn("newer", newer).filter(F.col("newer") < F.col("q")).select("source", "karar_tarihi", (F.col("q") - F.col("newer")).alias("rest"))
    near = dated.join(take, ["source", "karar_tarihi"])
    ranked = near.withColumn("rn", F.row_number().over(W.partitionBy("source", "karar_tarihi").orderBy("id")))
    return ranked.filter(F.col("rn") <= F.col("rest")).select("id", "source", "karar_tarihi")


def grow_pool(rows: DataFrame, base: DataFrame, size: int) -> DataFrame:
    """The base pool as it is, and from the other decisions what each source lacks to its larger quota.

    A source that already has its quota gets nothing. base: id, source. Returns id, source, yeni.
    """
    have = base.groupBy("source").agg(F.count("*").alias("have"))
    need = _quotas(rows, size).join(have, "source", "left").select("source", (F.col("quota") - F.coalesce("have", F.lit(0))).alias("quota")).filter("quota > 0")
    extra = quota_sample(rows, size, exclude=base, quotas=F.broadcast(need))
    return base.select("id", "source", F.lit(False).alias("yeni")).unionByName(extra.select("id", "source", F.lit(True).alias("yeni")))


def pool_summary(rows: DataFrame) -> DataFrame:
    """Per source: rows, courts, first and last year, mean length of text (halves to even)."""
    return (
        rows.withColumn("source", source_key(F.col("source")))
        .groupBy("source")
        .agg(
            F.count("*").alias("karar"), F.count_distinct("court").alias("daire"), F.min("year").alias("ilk_yil"),
            F.max("year").alias("son_yil"), F.bround(F.avg(F.length("text")), 0).cast("long").alias("ort_uzunluk"),
        )
    )


def duplicate_ids(rows: DataFrame) -> DataFrame:
    """id, n of the identifiers that break uniqueness."""
    return rows.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1")


def sample_per_group(rows: DataFrame, group: str, n: int, seed: int = 1) -> DataFrame:
    """n rows of each group by seeded hash of their ids; each id once."""
    spread = rows.filter(F.col("id").isNotNull()).select("id", group).distinct().withColumn("key", _draw(seed, "id"))
    return smallest_per_group(spread.withColumn("want", F.lit(n)), group, "key", F.col("want")).select("id", group)
