"""Labelled test sets: from hand-written items to query rows, with checks, and how much queries borrow from their targets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terazi.functions.text import collapse_whitespace, header, overlap_share, stems
from terazi.operators.ranking import stacked
from terazi.operators.sampling import smallest_per_group, source_key
from terazi.session import broadcast_small

#: query kinds by their letter, and which belong to a version (fixed values)
KINDS = {"H": "hukukcu_dili", "A": "avukat_dili", "F": "farkli_olay", "D": "dilekce"}
VERSIONS = {"v1": "HA", "v2": "HAF", "dilekce_v1": "D"}


def matched_items(items: DataFrame, decisions: DataFrame) -> DataFrame:
    """items (kaynak, esas, H, A, F, D, kanit) with their decision's id and name, and eslesme, the number of decisions that match."""
    d = decisions.filter(F.col("id").isNotNull()).groupBy("id").agg(F.max(source_key(F.col("source"))).alias("kaynak"), F.max("esas_no").alias("esas"), F.max("court").alias("court"), F.max("karar_tarihi").alias("tarih"))
    name = header(F.col("kaynak"), F.col("court"), F.col("esas"), F.lit(""), F.col("tarih"))
    hits = d.groupBy("kaynak", "esas").agg(F.count("*").alias("eslesme"), F.min(F.struct(F.col("id").alias("karar_id"), name.alias("kunye"))).alias("hit"))
    return items.join(hits, ["kaynak", "esas"], "left").select(*items.columns, F.coalesce("eslesme", F.lit(0)).alias("eslesme"), "hit.karar_id", "hit.kunye")


def long_form(matched: DataFrame, version: str) -> DataFrame:
    """A row per query of the version: test_id, kaynak, karar_id, kunye, sorgu_tipi, sorgu, kanit. Missing queries are left out."""
    wide = {c: c for c in VERSIONS[version]}
    rows = stacked(matched, ["item_id", "kaynak", "karar_id", "kunye", "kanit"], wide, "harf", "sorgu")
    kind = F.try_element_at(F.create_map(*[F.lit(x) for p in KINDS.items() for x in p]), F.col("harf"))
    return rows.select(F.concat_ws("-", "item_id", "harf").alias("test_id"), "kaynak", "karar_id", "kunye", kind.alias("sorgu_tipi"), "sorgu", "kanit")


def defects(tests: DataFrame, decisions: DataFrame) -> DataFrame:
    """test_id, kusur of queries whose target is missing or whose evidence doesn't stand in it, white space aside."""
    texts = decisions.filter(F.col("id").isNotNull()).select(F.col("id").alias("karar_id"), "text").join(broadcast_small(tests.select("karar_id").distinct()), "karar_id", "left_semi").groupBy("karar_id").agg(F.max("text").alias("text"))
    joined = tests.join(texts, "karar_id", "left")
    held = F.contains(collapse_whitespace(F.col("text")), collapse_whitespace(F.col("kanit")))
    flaw = F.when(F.col("text").isNull(), "hedef_yok").when(~F.coalesce(held, F.lit(False)), "kanit_yok")
    return joined.select("test_id", flaw.alias("kusur")).filter(F.col("kusur").isNotNull())


def borrowed_words(tests: DataFrame, decisions: DataFrame, others: int = 20, seed: str = "0") -> DataFrame:
    """Per kind of query: the share of its stems in its target and in `others` decisions of the source, by hash, in per cent.

    The other decisions are the source's least by hash, apart from the target; one more is drawn so that leaving it out leaves enough.
    """
    slim = decisions.filter(F.col("id").isNotNull() & F.col("text").isNotNull()).select("id", source_key(F.col("source")).alias("kaynak"), "text")


    keyed = slim.select("id", "kaynak").distinct().withColumn("key", F.md5(F.concat_ws("|", "id", F.lit(seed)))).withColumn("want", F.lit(others + 1))
    drawn = smallest_per_group(keyed, "kaynak", "key", F.col("want")).select("id", "kaynak", "key")
    needed = drawn.select("id").union(tests.select("karar_id")).distinct()
    stemmed = slim.join(broadcast_small(needed), "id", "left_semi").dropDuplicates(["id"]).select("id", stems(F.col("text")).alias("govde"))
    queries = tests.select("test_id", "kaynak", "karar_id", "sorgu_tipi", stems(F.col("sorgu")).alias("q"))
    own = queries.join(stemmed.withColumnRenamed("id", "karar_id"), "karar_id").select("test_id", "sorgu_tipi", overlap_share(F.col("q"), F.col("govde")).alias("hedef"))
    pairs = queries.join(drawn, "kaynak").filter(F.col("id") != F.col("karar_id"))
    ranked = pairs.withColumn("rn", F.row_number().over(W.partitionBy("test_id").orderBy("key"))).filter(F.col("rn") <= others)
    rest = ranked.join(stemmed, "id").groupBy("test_id").agg(F.avg(overlap_share(F.col("q"), F.col("govde"))).alias("diger"))
    per = own.join(rest, "test_id", "left").groupBy("sorgu_tipi").agg(F.avg("hedef").alias("h"), F.avg("diger").alias("d"))
    pct = lambda c: F.bround(100 * c, 0).cast("int")
    return per.select("sorgu_tipi", pct(F.col("h")).alias("hedef_karar"), pct(F.col("d")).alias("alakasiz_kararlar"), pct(F.col("h") - F.col("d")).alias("hedefe_ozgu_fark"))
