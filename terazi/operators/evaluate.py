"""Rank metrics of retrieval, strict and wide, per run and per group; reranking measured before and after."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terazi.functions.text import collapse_whitespace, overlap_share, result_label, stems, word_count
from terazi.operators.ranking import widened

CUTS = (1, 5, 10, 20, 50, 100)
EVIDENCE_DEPTH = 5
#: words kept free beside the query when a long text is cut for a model that reads pairs (fixed value)
MARGIN = 128
#: marks before a result by the reason for which it is right (fixed values)
MARKS = {"hedef": "[DOĞRU] ", "kardes": "[KARDEŞ] ", "kanun": "[KANUN] "}


def accepted_ids(tests: DataFrame) -> DataFrame:
    """test_id, decision_id of all decisions that answer a query: its target and the further ones; empty pieces are left out."""
    further = F.filter(F.split(F.coalesce("ek_dogru_kararlar", F.lit("")), ";"), lambda x: x != "")
    return tests.select("test_id", F.explode(F.array_union(F.array("karar_id"), further)).alias("decision_id")).filter(F.col("decision_id").isNotNull())


def reasons(ranked: DataFrame, tests: DataFrame, judged: DataFrame | None = None) -> DataFrame:
    """ranked (test_id, rank, decision_id, ...) with neden: hedef before kardes before kanun, else null.

    judged: target, candidate, neden of pairs; without it only targets count.
    """
    out = ranked.join(accepted_ids(tests).withColumn("_hit", F.lit(True)), ["test_id", "decision_id"], "left")
    if judged is None:
        return out.withColumn("neden", F.when(F.col("_hit"), "hedef")).drop("_hit")
    targets = tests.select("test_id", F.col("karar_id").alias("target"))
    pairs = judged.select("target", F.col("candidate").alias("decision_id"), F.col("neden").alias("_neden"))
    out = out.join(targets, "test_id", "left").join(pairs, ["target", "decision_id"], "left")
    return out.withColumn("neden", F.when(F.col("_hit"), "hedef").otherwise(F.col("_neden"))).drop("_hit", "_neden", "target")


def evidence_found(ranked: DataFrame, tests: DataFrame, depth: int = EVIDENCE_DEPTH) -> DataFrame:
    """test_id, kanit_ilk5: whether a result among the first holds the evidence, white space aside. Empty evidence is always
    held, a null one never."""
    need = tests.select("test_id", collapse_whitespace(F.col("kanit")).alias("_need"))
    top = ranked.filter(F.col("rank") <= depth).join(need, "test_id")
    return top.groupBy("test_id").agg(F.coalesce(F.max(F.contains(collapse_whitespace(F.col("text")), F.col("_need"))), F.lit(False)).alias("kanit_ilk5"))


def _mark() -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in MARKS.items() for x in p]), F.col("neden")), F.lit(""))


def _labels(r: DataFrame, score: str, rank: str) -> DataFrame:
    """sonuc_1..5: the first five results with mark, score, header (else id) and part, where these columns are there."""
    has = lambda c: F.col(c) if c in r.columns else F.lit(None)
    line = result_label(F.col(score), F.coalesce(F.nullif(has("header").cast("string"), F.lit("")), F.col("decision_id")), has("chunk_index").cast("int"), has("n_chunks").cast("int"), _mark())
    return widened(r.withColumn("_shown", line), ["test_id"], "_shown", rank=rank)


def per_query(ranked: DataFrame, tests: DataFrame, judged: DataFrame | None = None, evidence: DataFrame | None = None) -> DataFrame:
    """One row per query: strict and wide rank, reason of the wide one, right results among five, evidence, tokens read, the group
    and text of the part in which the target was found, and the first five results.

    ranked: test_id, rank, decision_id, score, text, tokens, and, for the labels, header, chunk_index, n_chunks, bolum where
    there are any. evidence: test_id, kanit, if other than the tests' own, as for cleaned texts. Queries without results
    stay, with null ranks.
    """
    r = reasons(ranked, tests, judged)
    seen, hit = F.col("rank") <= EVIDENCE_DEPTH, F.col("neden") == "hedef"
    group = F.col("bolum") if "bolum" in r.columns else F.lit(None).cast("string")
    ranks = r.groupBy("test_id").agg(
        F.min(F.when(hit, F.col("rank"))).alias("sira"), F.min(F.when(F.col("neden").isNotNull(), F.col("rank"))).alias("sira_genis"),
        F.min_by("neden", F.when(F.col("neden").isNotNull(), F.col("rank"))).alias("genis_neden"),
        F.sum((seen & F.col("neden").isNotNull()).cast("int")).alias("ilgili_ilk5"), F.sum(F.when(seen, F.col("tokens")).otherwise(0)).alias("okunan_token_ilk5"),
        F.coalesce(F.min_by(group, F.when(hit, F.col("rank"))), F.lit("")).alias("bulunan_bolum"), F.coalesce(F.min_by("text", F.when(hit, F.col("rank"))), F.lit("")).alias("bulunan_parca_metni"),
    )
    base = tests.select("test_id", "sorgu_tipi", "kaynak", *[c for c in ("sorgu", "kunye", "kanit") if c in tests.columns]).withColumnsRenamed({"kunye": "hedef_kunye"})
    held = evidence_found(ranked, tests if evidence is None else evidence)
    out = base.join(ranks, "test_id", "left").join(held, "test_id", "left").join(_labels(r, "score", "rank"), "test_id", "left")
    return out.na.fill({"ilgili_ilk5": 0, "okunan_token_ilk5": 0, "kanit_ilk5": False, "bulunan_bolum": "", "bulunan_parca_metni": "", **{f"sonuc_{i}": "" for i in range(1, 6)}})


def hit_share(rank: Column, k: int) -> Column:
    """Per cent of rows whose rank is at most k; a null rank is a miss."""
    return F.lit(100.0) * F.avg(F.when(rank <= k, 1.0).otherwise(0.0))


def reciprocal_rank(rank: Column) -> Column:
    """Mean reciprocal rank; a miss counts 0."""
    return F.avg(F.coalesce(F.try_divide(F.lit(1.0), rank), F.lit(0.0)))


def summary(results: DataFrame, by: str | None = None) -> DataFrame:
    """Metrics over all queries or per group, rounded to six digits."""
    s, g, r6 = F.col("sira"), F.col("sira_genis"), lambda c: F.round(c, 6)
    metrics = [
        F.count("*").alias("sorgu"), r6(hit_share(s, 1)).alias("ilk1"), r6(hit_share(s, 5)).alias("ilk5"), r6(hit_share(s, 10)).alias("ilk10"), r6(reciprocal_rank(s)).alias("mrr"),
        r6(100 * F.avg(F.col("kanit_ilk5").cast("int"))).alias("kanit_ilk5"), r6(F.avg("okunan_token_ilk5")).alias("okunan_token_ilk5"), r6(hit_share(g, 1)).alias("ilk1_genis"),
        r6(hit_share(g, 5)).alias("ilk5_genis"), r6(hit_share(g, 10)).alias("ilk10_genis"), r6(reciprocal_rank(g)).alias("mrr_genis"), r6(20 * F.avg("ilgili_ilk5")).alias("ilgili_ilk5"),
    ]
    return (results.groupBy(by) if by else results.groupBy()).agg(*metrics)


def wide_summary(results: DataFrame, rank: str, by: list[str] | None = None) -> DataFrame:
    """Hits at 1, 5, 10, 20, 50 and 100 and mean reciprocal rank of one rank column."""
    cols = [F.round(hit_share(F.col(rank), k), 6).alias(f"ilk{k}") for k in CUTS]
    return results.groupBy(*(by or [])).agg(F.count("*").alias("sorgu"), *cols, F.round(reciprocal_rank(F.col(rank)), 6).alias("mrr"))


# -- reranking ------------------------------------------------------------------


def identity_scores(candidates: DataFrame) -> DataFrame:
    """Scores that keep the order of the first stage."""
    return candidates.withColumn("puan", (-F.col("sira_once")).cast("double"))


def shared_word_scores(candidates: DataFrame, query: str = "sorgu", text: str = "text") -> DataFrame:
    """Scores by the share of a query's stems that the text has; stands in for a model that scores pairs."""
    return candidates.withColumn("puan", F.coalesce(overlap_share(stems(F.col(query)), stems(F.col(text))), F.lit(0.0)))


def best_of_pieces(scored: DataFrame, keys: list[str]) -> DataFrame:
    """The greatest score of a long text's pieces."""
    return scored.groupBy(*keys).agg(F.max("puan").alias("puan"))


def whole_text_scores(candidates: DataFrame, room: int) -> DataFrame:
    """Scores over whole texts: each is cut into pieces that fit room words beside its query, and the best piece counts.

    candidates: test_id, sira_once, decision_id, sorgu, text and more, which stay.
    """
    beside = F.coalesce(word_count(F.col("sorgu")), F.lit(0)) + MARGIN
    keys = ["test_id", "decision_id"]
    pieces = text_pieces(candidates.select(*keys, "sorgu", "text"), "text", F.lit(room), beside)
    best = best_of_pieces(shared_word_scores(pieces, text="piece"), keys)
    return candidates.join(best, keys)


def reranked(candidates: DataFrame) -> DataFrame:
    """candidates (test_id, sira_once, puan, ...) with sira_sonra: by score, the former order among equals."""
    return candidates.withColumn("sira_sonra", F.row_number().over(W.partitionBy("test_id").orderBy(F.col("puan").desc_nulls_last(), "sira_once")))


def rerank_measure(candidates: DataFrame, tests: DataFrame, judged: DataFrame | None = None) -> DataFrame:
    """Per query the strict and wide ranks before and after, the reason of the wide one and the target's score."""
    r = reasons(reranked(candidates), tests, judged)
    hit, right = F.col("neden") == "hedef", F.col("neden").isNotNull()
    per = r.groupBy("test_id").agg(
        F.min(F.when(hit, F.col("sira_once"))).alias("sira_once"), F.min(F.when(hit, F.col("sira_sonra"))).alias("sira_sonra"),
        F.min(F.when(right, F.col("sira_once"))).alias("sira_genis_once"), F.min(F.when(right, F.col("sira_sonra"))).alias("sira_genis_sonra"),
        F.min_by("neden", F.when(right, F.col("sira_sonra"))).alias("genis_neden_sonra"), F.min_by("puan", F.when(hit, F.col("sira_sonra"))).alias("hedef_puan"),
    )
    shown = _labels(r, "puan", "sira_sonra")
    return tests.select("test_id", "sorgu_tipi", "kaynak").join(per, "test_id", "left").join(shown, "test_id", "left").na.fill("", [f"sonuc_{i}" for i in range(1, 6)])


def text_pieces(rows: DataFrame, text: str, room: Column, tokens_before: int | Column = MARGIN) -> DataFrame:
    """rows exploded into pieces of a long text that fit room less tokens_before words; parca is their number.

    A piece is a slice of the text as it is, from a word's beginning to a word's end. Texts that fit come whole; null
    texts come as one null piece.
    """
    w = F.regexp_extract_all(F.col(text), F.lit("(?U)\\S+\\s*"), F.lit(0))
    size = F.greatest(F.lit(1), room - tokens_before).cast("int")
    n = F.greatest(F.lit(1), F.ceil(F.size(w) / size)).cast("int")
    piece = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.regexp_replace(F.array_join(F.slice(w, i * size + 1, size), ""), "(?U)\\s+$", ""))
    return rows.select("*", F.posexplode_outer(F.when(F.col(text).isNotNull(), piece)).alias("parca", "piece"))
