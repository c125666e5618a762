"""Retrieval end to end: encode chunks and queries, search, judge relevance, rerank, measure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terazi.functions.text import QUERY_PROMPT, model_input, query_input, result_label, shorten
from terazi.functions.vectors import encode_column
from terazi.operators import chunking, cleaning, evaluate, relevance, search
from terazi.session import materialize


def _chunk_id() -> Column:
    return F.concat_ws("#", "decision_id", F.lpad(F.col("chunk_index").cast("string"), 6, "0")).alias("id")


def chunk_vectors(chunks: DataFrame) -> DataFrame:
    """id, decision_id, embedding of each chunk row; repeated rows stay, as the best of a decision's rows counts anyhow."""
    given = chunks.filter(F.col("decision_id").isNotNull()).select(_chunk_id(), "decision_id", model_input(F.col("header"), F.col("bolum"), F.col("text")).alias("_in"))
    return encode_column(given, "_in").select("id", "decision_id", "embedding")


def candidates(chunks: DataFrame, tests: DataFrame, k: int = 100, prompt: str = "") -> DataFrame:
    """test_id, rank, score, decision_id, chunk_index, n_chunks, header, bolum, text, tokens: the k best decisions of every query by
    their best chunk.

    Only keys and vectors go through the search; the columns of the winning chunks are joined to the results. Where copies of
    a chunk disagree, the greatest value of each column is taken. prompt is put before each query.
    """
    asked = encode_column(tests.select("test_id", query_input(F.col("sorgu"), prompt).alias("_in")), "_in").select("test_id", "embedding")
    ranked = materialize(search.search(asked, materialize(chunk_vectors(chunks), "vectors"), k, query_key="test_id", group="decision_id"), "ranked-keys")
    columns = [c for c in ("chunk_index", "n_chunks", "header", "bolum", "text", "tokens") if c in chunks.columns]
    won = chunks.withColumn("id", _chunk_id()).join(ranked.select("id").distinct(), "id", "left_semi").groupBy("id").agg(*[F.max(c).alias(c) for c in columns])
    return ranked.join(won, "id").drop("id")


def _judged(ranked: DataFrame, tests: DataFrame, decisions: DataFrame) -> DataFrame:
    """judged_pairs() of each query's target with all its candidates."""
    pairs = ranked.join(tests.select("test_id", F.col("karar_id").alias("target")), "test_id").select("target", F.col("decision_id").alias("candidate"))
    return relevance.judged_pairs(pairs, decisions)


def evaluated(chunks: DataFrame, tests: DataFrame, decisions: DataFrame, k: int = 10, clean_evidence: bool = False) -> DataFrame:
    """per_query() of the k best decisions, near copies and shared statutes counting in the wide measure.

    decisions: the pool as it was before any cleaning. clean_evidence: for chunks of cleaned texts, in which evidence can stand
    only as cleaned by the same rules.
    """
    ranked = materialize(candidates(chunks, tests, k, QUERY_PROMPT), "ranked")
    evidence = cleaning.cleaned(tests.select("test_id", F.col("kaynak").alias("source"), F.col("kanit").alias("text"))).withColumnRenamed("text", "kanit") if clean_evidence else None
    return evaluate.per_query(ranked, tests, _judged(ranked, tests, decisions), evidence)


def evaluated_clean(decisions: DataFrame, tests: DataFrame, limit: int = 128, overlap: int = 16, k: int = 100) -> DataFrame:
    """evaluated() over the cleaned pool, cut recursively."""
    pool = materialize(cleaning.clean_pool(decisions.select("id", "source", "court", "esas_no", "karar_no", "karar_tarihi", "year", "text", "text_len")), "clean-pool")
    chunks = materialize(chunking.chunk_table(pool, "recursive", limit, overlap), "clean-chunks")
    return evaluated(chunks, tests, decisions, k, clean_evidence=True)


def _whole_texts(ranked: DataFrame, decisions: DataFrame, clean: bool) -> DataFrame:
    """ranked with the whole text of each decision in place of its part's."""
    wanted = decisions.select("id", "source", "text").join(ranked.select(F.col("decision_id").alias("id")).distinct(), "id", "left_semi")
    texts = (cleaning.cleaned(wanted) if clean else wanted).groupBy(F.col("id").alias("decision_id")).agg(F.max("text").alias("text"))
    return ranked.drop("text").join(texts, "decision_id", "left")


def reranked(chunks: DataFrame, tests: DataFrame, decisions: DataFrame, k: int = 100, text: str = "parca", room: int = 8192) -> DataFrame:
    """rerank_measure() of the k candidates by shared words, near copies and shared statutes counting in the wide ranks.

    text: parca for the part by which a candidate was found, orijinal or temiz for whole decisions as they are or cleaned, cut
    into pieces of which the best counts.
    """
    ranked = materialize(candidates(chunks, tests, k, QUERY_PROMPT), "ranked")
    asked = ranked.withColumnRenamed("rank", "sira_once").join(tests.select("test_id", "sorgu"), "test_id")
    scored = evaluate.shared_word_scores(asked) if text == "parca" else evaluate.whole_text_scores(_whole_texts(asked, decisions, text == "temiz"), room)
    return evaluate.rerank_measure(scored, tests, _judged(ranked, tests, decisions))


def searched(chunks: DataFrame, tests: DataFrame, k: int = 5) -> DataFrame:
    """test_id, rank, satir: the lines that a search shows for each query, the best part of each of its k decisions."""
    found = candidates(chunks, tests, k, QUERY_PROMPT)
    return found.select("test_id", "rank", result_label(F.col("score"), F.col("header"), F.col("chunk_index"), F.col("n_chunks")).alias("satir"), shorten(F.col("text")).alias("ozet"))
