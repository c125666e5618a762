"""When another decision counts as right: near copies and shared statutes, weighted by rarity."""

from __future__ import annotations

import functools
import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terazi.functions.text import shingles
from terazi.operators import patterns as P
from terazi.session import broadcast_small, materialize, spread

SIBLING, LAW, LEAST_DF, SPECIFIC_SHARE, SHINGLE_WORDS = 0.70, 0.60, 5, 0.01, 5
_rx = functools.cache(re.compile)


#: a statute by name with all articles listed behind it
_NAMED_RUN = re.compile(f"{P.NAMED_STATUTE}((?:{P.FURTHER_ARTICLE.replace('(\\d', '(?:\\d')})*)")


def statutes_cited(text: str | None) -> set[tuple[str, int]]:
    """(statute, article) of every citation: by number, by name, and further articles listed after a name."""
    flat = " ".join((text or "").split())
    by_number = ((m[1], m[2]) for m in P.NUMBERED_STATUTE.finditer(flat))
    runs = ((P.STATUTES[m[1]], [m[2], *(f[1] for f in _rx(P.FURTHER_ARTICLE).finditer(flat, *m.span(3)))]) for m in _NAMED_RUN.finditer(flat))
    return {(law, int(no)) for law, no in itertools.chain(by_number, ((law, no) for law, numbers in runs for no in numbers))}


def _texts(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("id").isNotNull() & F.col("text").isNotNull()).select("id", "text")


def citations(rows: DataFrame) -> DataFrame:
    """id, law, article, each once; decisions without citations and null texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, law, no) for i, t in zip(*(c.to_pylist() for c in batch.columns)) for law, no in statutes_cited(t)]
            ids, laws, numbers = zip(*found) if found else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(laws, pa.string()), pa.array(numbers, pa.int32())], ["id", "law", "article"])

    return spread(_texts(rows)).mapInArrow(run, "id string, law string, article int").distinct()


def citation_weights(cited: DataFrame, pool_size: int) -> DataFrame:
    """law, article, df, weight, specific: rarity with a ceiling, and whether at most SPECIFIC_SHARE of the pool cites it.

    The table has a row for each article cited anywhere, of which a legal system has a bounded number.
    """
    n = F.lit(float(pool_size))
    return cited.groupBy("law", "article").agg(F.count("*").alias("df")).select(
        "law", "article", "df", F.least(F.log(n / F.col("df")), F.log(n / LEAST_DF)).alias("weight"), (F.col("df") <= SPECIFIC_SHARE * n).alias("specific")
    )


def law_overlap(pairs: DataFrame, cited: DataFrame, weights: DataFrame) -> DataFrame:
    """pairs (target, candidate) with law_share, the weight of the target's citations that the candidate has too (null without
    citations or weight), and shares_specific. Pairs come out once each."""
    pairs = pairs.select("target", "candidate").distinct()
    weighted = cited.join(broadcast_small(weights), ["law", "article"])
    mine = pairs.join(weighted.withColumnRenamed("id", "target"), "target", "left")
    other = cited.select(F.col("id").alias("candidate"), "law", "article", F.lit(1).alias("both"))
    joined = mine.join(other, ["candidate", "law", "article"], "left")
    common = F.sum(F.when(F.col("both") == 1, F.col("weight")).otherwise(0.0))
    return joined.groupBy("target", "candidate").agg(
        F.when(F.sum("weight") > 0, common / F.sum("weight")).alias("law_share"),
        F.coalesce(F.max((F.col("both") == 1) & F.col("specific")), F.lit(False)).alias("shares_specific"),
    )


def shingle_table(rows: DataFrame) -> DataFrame:
    """id, shingle (64-bit hash), each once: the runs of five words of each text."""
    return _texts(rows).select("id", F.explode(shingles(F.col("text"), SHINGLE_WORDS)).alias("s")).select("id", F.xxhash64("s").alias("shingle")).distinct()


def text_overlap(pairs: DataFrame, runs: DataFrame) -> DataFrame:
    """pairs (target, candidate) with text_share: common runs by the smaller number of runs; 0 where a text has none.

    Only texts that occur in a pair are touched, and only runs of a pair's own texts meet.
    """
    pairs = pairs.select("target", "candidate").distinct()
    named = pairs.select(F.col("target").alias("id")).union(pairs.select("candidate")).distinct()
    mine = runs.join(named, "id", "left_semi")
    sizes = mine.groupBy("id").agg(F.count("*").alias("n"))
    target = pairs.join(mine.withColumnRenamed("id", "target"), "target")
    common = target.join(mine.withColumnRenamed("id", "candidate"), ["candidate", "shingle"]).groupBy("target", "candidate").agg(F.count("*").alias("common"))
    sized = pairs.join(sizes.select(F.col("id").alias("target"), F.col("n").alias("nt")), "target", "left").join(sizes.select(F.col("id").alias("candidate"), F.col("n").alias("nc")), "candidate", "left")
    smaller = F.greatest(F.lit(1), F.least(F.coalesce("nt", F.lit(0)), F.coalesce("nc", F.lit(0))))
    return sized.join(common, ["target", "candidate"], "left").select("target", "candidate", (F.coalesce("common", F.lit(0)) / smaller).alias("text_share"))


def near_copies(targets: DataFrame, rows: DataFrame, least: float = SIBLING) -> DataFrame:
    """target, candidate, text_share of every decision of the pool that is a near copy of a target, itself apart.

    targets: target, a stated set of queries. They meet the pool's runs by equality; a run of one text is counted once, and
    what is grouped is pairs that share a run, at most targets x decisions.
    """
    runs = materialize(shingle_table(rows), "shingles")
    sizes = runs.groupBy("id").agg(F.count("*").alias("n"))
    asked = runs.join(targets.select(F.col("target").alias("id")).distinct(), "id", "left_semi").withColumnRenamed("id", "target")
    common = asked.join(runs.withColumnRenamed("id", "candidate"), "shingle").filter("target <> candidate").groupBy("target", "candidate").agg(F.count("*").alias("c"))
    size = lambda key: sizes.select(F.col("id").alias(key), F.col("n").alias(f"n_{key}"))
    share = F.col("c") / F.least("n_target", "n_candidate")
    return common.join(size("target"), "target").join(size("candidate"), "candidate").select("target", "candidate", share.alias("text_share")).filter(F.col("text_share") >= least)


def judged_pairs(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """target, candidate, neden: kardes for near copies, else kanun for enough shared statutes with a specific one, else null.

    rows: id, text of the whole original pool, from which rarity is counted; repeated rows of an id count once.
    """
    cited = materialize(citations(rows), "citations")
    size = rows.select("id").filter(F.col("id").isNotNull()).distinct().count()
    law = law_overlap(pairs, cited, citation_weights(cited, size))
    named = pairs.select(F.col("target").alias("id")).union(pairs.select("candidate")).distinct()
    text = text_overlap(pairs, shingle_table(rows.join(named, "id", "left_semi")))
    kanun = (F.col("law_share") >= LAW) & F.col("shares_specific")
    return text.join(law, ["target", "candidate"], "left").select("target", "candidate", F.when(F.col("text_share") >= SIBLING, "kardes").when(kanun, "kanun").alias("neden"))
