"""All queries of the core operators, by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terazi.functions import text as tx
from terazi.functions.turkish import SQL_FROM, SQL_TO, spelling_key_sql
from terazi.operators import chunking, cleaning, evaluate, experiments, ranking, relevance, sampling, search, sections, testset
from terazi.plans import more, pipeline
from terazi.plans.more import each_id
from terazi.session import broadcast_small, table
from terazi.sources import io
from terazi.streaming import incremental

Query = Callable[[SparkSession, str], DataFrame]
METHOD_LIMIT = 256


def over(*names: str) -> Callable[[Callable[..., DataFrame]], Query]:
    """A query that gets whole tables."""
    return lambda f: lambda spark, d: f(*[table(spark, d, n) for n in names])


# -- vectors: every row whose id is divisible by 100 is a query against all rows ---------


def _asked(e: DataFrame) -> DataFrame:
    return e.filter(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query"), "embedding")


def _rounded(rows: DataFrame) -> DataFrame:
    return rows.withColumn("score", F.round("score", 6))


def _best_labels(e: DataFrame, k: int = max(evaluate.CUTS)) -> DataFrame:
    return search.search(_asked(e), e, k, row_key="vec_id", group="label")


def _own_label(e: DataFrame) -> DataFrame:
    """Rank of each query's own label among labels by their best row; the query's own row counts as any other."""
    own = e.select(F.col("vec_id").alias("query"), F.col("label").alias("own"))
    return ranking.first_match(_best_labels(e).join(own.join(_asked(e).select("query"), "query"), "query"), ["query", "own"], F.col("label") == F.col("own"))


def _fused(e: DataFrame) -> DataFrame:
    near = search.search(_asked(e), e, 10, row_key="vec_id", extra=("label",))
    other = near.filter(F.col("label") % 2 == 0).select("query", "vec_id", (F.col("score") * 1.25).alias("score"))
    return _rounded(search.fused(near, other, ["query", "vec_id"])).select("query", "vec_id", "score")


def _identity(e: DataFrame) -> DataFrame:
    near = _best_labels(e, 10).select(F.col("query").alias("test_id"), F.col("rank").alias("sira_once"), "label", "score")
    return evaluate.reranked(evaluate.identity_scores(near)).select("test_id", "label", "sira_once", "sira_sonra")


def _repeated(e: DataFrame) -> DataFrame:
    return experiments.repeatability(_runs(e))


def _runs(e: DataFrame) -> DataFrame:
    """Three runs of each query that see different rows, so that their results may differ."""
    seen = [search.search(_asked(e), e.filter(F.col("vec_id") % 3 != i), 10, row_key="vec_id", group="label") for i in range(3)]
    runs = [r.select(F.col("query").alias("test_id"), F.lit(i).alias("tekrar"), "rank", F.col("label").alias("decision_id"), "score", (F.col("label") == 0).alias("hedef")) for i, r in enumerate(seen)]
    return ranking.unite(*runs)


# -- decisions ---------------------------------------------------------------------------


def _counts_by_source(k: DataFrame, d: DataFrame) -> DataFrame:
    a = ranking.value_counts(k.select(sampling.source_key(F.col("source")).alias("source")), "source").withColumnRenamed("n", "karar")
    return ranking.combined(a, ranking.value_counts(d, "source").withColumnRenamed("n", "belge"), "source")


def _grown(k: DataFrame) -> DataFrame:
    return sampling.grow_pool(k, sampling.quota_sample(k, 400), 1000)


def _headers(k: DataFrame) -> DataFrame:
    cols = [sampling.source_key(F.col("source")), *[F.col(c) for c in ("court", "esas_no", "karar_no", "karar_tarihi")]]
    return k.select("id", tx.header(*cols).alias("tam"), tx.header(*cols, full=False).alias("kisa"), tx.case_name(*cols[:3]).alias("ad"))


def _shingle_counts(k: DataFrame) -> DataFrame:
    return each_id(k, n=F.when(F.col("text").isNotNull(), F.size(tx.shingles(F.col("text")))))


def _target_texts(k: DataFrame, t: DataFrame) -> DataFrame:
    """karar_id, text of the decisions that are targets, each once."""
    wanted = broadcast_small(t.select(F.col("karar_id").alias("id")).distinct())
    return k.join(wanted, "id", "left_semi").groupBy(F.col("id").alias("karar_id")).agg(F.max("text").alias("text"))


def _target_pairs(k: DataFrame, t: DataFrame) -> DataFrame:
    targets = t.select("kaynak", F.col("karar_id").alias("target")).distinct()
    pairs = targets.join(targets.select("kaynak", F.col("target").alias("candidate")), "kaynak").filter("target < candidate")  # the fixed test set only
    return relevance.text_overlap(pairs, relevance.shingle_table(k.join(F.broadcast(targets.select(F.col("target").alias("id")).distinct()), "id", "left_semi"))).withColumn("text_share", F.round("text_share", 6))


def _evidence(k: DataFrame, t: DataFrame) -> DataFrame:
    texts = _target_texts(k, t)
    return t.join(texts, "karar_id", "left").select("test_id", F.coalesce(F.contains(tx.collapse_whitespace("text"), tx.collapse_whitespace("kanit")), F.lit(False)).alias("var"))


def _stem_shares(k: DataFrame, t: DataFrame) -> DataFrame:
    texts = _target_texts(k, t)
    return t.join(texts, "karar_id").select("test_id", F.round(tx.overlap_share(tx.stems(F.col("sorgu")), tx.stems(F.col("text"))), 6).alias("pay"))


def _fixed_windows(d: DataFrame) -> DataFrame:
    cut = chunking.fixed_word_windows(F.coalesce("text", F.lit("")), 64, 8)
    return d.select("doc_id", F.posexplode(cut).alias("parca", "metin")).select("doc_id", "parca", F.md5("metin").alias("ozet"))


def _packed_sentences(d: DataFrame) -> DataFrame:
    parts = F.filter(F.transform(F.split("text", "(?<=[.!?;:])\\s+"), lambda x: F.trim(x)), lambda x: x != "")
    sized = d.filter(F.col("text").isNotNull()).select("doc_id", F.transform(parts, lambda p: tx.word_count(p)).alias("sizes"))
    return sized.select("doc_id", F.posexplode(chunking.packed_ranges(F.col("sizes"), 64, 16)).alias("parca", "r")).select("doc_id", "parca", F.col("r.a").alias("bas"), F.col("r.b").alias("son"))


def _long_pieces(d: DataFrame) -> DataFrame:
    return evaluate.text_pieces(d.select("doc_id", "text"), "text", F.lit(384)).select("doc_id", "parca", tx.word_count(F.col("piece")).alias("n"))


def _token_spread(c: DataFrame) -> DataFrame:
    rows = c.select(sampling.source_key(F.col("source")).alias("source"), "tokens")
    return rows.groupBy("source").agg(F.percentile("tokens", 0.5).alias("ortanca"), F.min("tokens").alias("en_az"), F.max("tokens").alias("en_cok"), F.sum("tokens").alias("toplam"))


def _report(e: DataFrame) -> DataFrame:
    return experiments.report_table(e)


def _all_best(e: DataFrame) -> DataFrame:
    t = experiments.report_table(experiments.once(e)).filter(F.col("havuz").isNotNull())
    final = experiments.best_of(t, ["havuz"], ["ilk5", "ilk1", "ilk10"]).withColumn("liste", F.lit("son siralama"))
    fetch = experiments.best_of(t, ["havuz"], ["ilk10", "ilk5", "ilk1"], without_rerank=True).withColumn("liste", F.lit("aday getirici"))
    return ranking.unite(final, fetch).select("havuz", "liste", "rank", "satir_no", "ilk1", "ilk5", "ilk10")


def _evolving(o: DataFrame, e: DataFrame) -> DataFrame:
    old = o.select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("durum"))
    return experiments.append_log(old, e.select(F.col("event_id").alias("k"), "event_type")).groupBy("durum", "event_type").agg(F.count("*").alias("n"), F.sum("k").alias("toplam"))


def _flagged_events(e: DataFrame) -> DataFrame:
    flagged = ranking.running_flag(e, (F.col("event_type") == "purchase") & (F.col("event_id") % 1000 == 7), "event_id", "sonra")
    return flagged.groupBy("sonra").agg(F.count("*").alias("n"), F.min("event_id").alias("ilk"))


def _by_nation(o: DataFrame, c: DataFrame, n: DataFrame) -> DataFrame:
    joined = o.join(c, o["o_custkey"] == c["c_custkey"]).join(F.broadcast(n), c["c_nationkey"] == n["n_nationkey"])  # nation is fixed
    return joined.groupBy("n_name").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("toplam"))


_GRID = [(size, tokens, experiments.run_name(*r), r[1]) for size in (2000, 10000) for tokens in (8192, 512) for r in experiments.grid(size, tokens)]


def _grid_rows(m: DataFrame) -> DataFrame:
    frame = io.values(m.sparkSession, _GRID, "havuz int, model_token int, deneme string, sinir int")
    fit = m.select("model", F.col("max_tokens").alias("model_token"), "batch_tokens")
    return fit.join(F.broadcast(frame), "model_token").select("model", "havuz", "deneme", tx.batch_rows(F.col("sinir"), 16384).alias("yigin"))


def _clean_grid_rows(m: DataFrame) -> DataFrame:
    limits = [r.max_tokens for r in m.select("max_tokens").distinct().collect()]  # a row per model
    runs = [(size, t, experiments.run_name(*r)) for size in (2000, 10000) for t in limits for r in experiments.clean_grid(t, size)]
    return m.join(io.values(m.sparkSession, runs, "havuz int, max_tokens int, deneme string"), "max_tokens").select("model", "havuz", "deneme")


def _separated(e: DataFrame) -> DataFrame:
    log = experiments.with_separator(experiments.with_separator(e, "yeni ölçüm"), "yeni ölçüm")
    return log.agg(F.count("*").alias("n"), F.count_if(F.startswith("tarih", F.lit("#"))).alias("ayrac"), F.max("satir_no").alias("son"))


def _defects(t: DataFrame, k: DataFrame) -> DataFrame:
    """The test set, and again with evidence that is turned round and with targets that are missing, which must be found."""
    turned = t.withColumns({"test_id": F.concat(F.lit("ters-"), "test_id"), "kanit": F.reverse("kanit")})
    missing = t.withColumns({"test_id": F.concat(F.lit("yok-"), "test_id"), "karar_id": F.concat(F.lit("yok-"), "karar_id")})
    return testset.defects(ranking.unite(t, turned, missing), k)


def _method(name: str) -> Query:
    return over("kararlar")(lambda k: chunking.chunk_table(k, name, METHOD_LIMIT))


def queries() -> dict[str, Query]:
    return {
        "vector_topk_best_per_group": over("embeddings")(lambda e: _rounded(_best_labels(e, 5))),
        "vector_topk": over("embeddings")(lambda e: _rounded(search.search(_asked(e), e, 10, row_key="vec_id"))),
        "vector_topk_overfetch": over("embeddings")(lambda e: _rounded(search.overfetched(_asked(e), e, 5, "label", row_key="vec_id")).select("query", "rank", "score", "vec_id", "label")),
        "vector_search_filtered": over("embeddings")(lambda e: _rounded(search.search(_asked(e), e.withColumn("year", F.col("label") + 2000).filter(search.metadata_filter(year=2005)), 5, row_key="vec_id"))),
        "fusion_greatest": over("embeddings")(_fused),
        "first_match_rank": over("embeddings")(_own_label),
        "hit_at_k_summary": over("embeddings")(lambda e: evaluate.wide_summary(_own_label(e), "sira")),
        "hit_at_k_by_group": over("embeddings")(lambda e: evaluate.wide_summary(_own_label(e), "sira", ["own"])),
        "pivot_top5": over("embeddings")(lambda e: ranking.widened(_best_labels(e).withColumn("label", F.col("label").cast("string")), ["query"], "label")),
        "rerank_identity": over("embeddings")(_identity),
        "repeatability": over("embeddings")(lambda e: _repeated(e).withColumn("skor_araligi", F.round("skor_araligi", 6))),
        "rank_histogram": over("embeddings")(lambda e: experiments.rank_histogram(_runs(e))),
        "pool_summary": over("kararlar")(sampling.pool_summary),
        "quota_sample": over("kararlar")(lambda k: sampling.quota_sample(k, 1000).select("id", "source")),
        "newest_n_per_source": over("kararlar")(lambda k: sampling.newest_per_source(k, 400)),
        "nested_pool_growth": over("kararlar")(_grown),
        "block_sample": over("kararlar", "havuz_uyelik")(lambda k, h: sampling.block_sample(k.join(h.groupBy("id").agg(F.min("dosya").alias("dosya")), "id"), "dosya", 1000)),
        "random_per_source": over("kararlar")(lambda k: sampling.sample_per_group(k.withColumn("source", sampling.source_key(F.col("source"))), "source", 3)),
        "duplicate_ids": over("kararlar")(sampling.duplicate_ids),
        "row_groups": lambda spark, d: io.row_groups(spark, f"{d}/kararlar.parquet", "karar_tarihi").groupBy().agg(F.sum("satir").alias("satir"), F.max("en_buyuk").alias("en_buyuk")),
        "row_group_rows": lambda spark, d: io.read_row_groups(io.row_groups(spark, f"{d}/kararlar.parquet", "id"), ["id", "year"], "id string, year int").groupBy("year").agg(F.count("*").alias("n"), F.count_distinct("id").alias("tekil")),
        "source_counts_combined": over("kararlar", "documents")(_counts_by_source),
        "headers": over("kararlar")(_headers),
        "word_count": over("kararlar")(lambda k: each_id(k, sozcuk=tx.word_count(F.col("text")), uzunluk=F.length(tx.collapse_whitespace(F.col("text"))))),
        "text_preview": over("kararlar")(lambda k: each_id(k, **dict(zip(("bas", "son"), tx.preview(F.col("text")))))),
        "longest_per_source": over("kararlar")(lambda k: k.filter("id is not null").groupBy(sampling.source_key(F.col("source")).alias("source")).agg(F.max_by("id", F.struct(F.length("text"), F.col("id"))).alias("id"), F.max(F.length("text")).alias("n"))),
        "decisions_without_chunks": over("kararlar", "chunks")(lambda k, c: k.select("id").distinct().join(c.select(F.col("decision_id").alias("id")), "id", "left_anti")),
        "decisions_with_late_chunks": over("kararlar", "chunks")(lambda k, c: k.select("id").distinct().join(c.filter("chunk_index >= 6").select(F.col("decision_id").alias("id")), "id", "left_semi")),
        "shingle_counts": over("kararlar")(_shingle_counts),
        "text_overlap_targets": over("kararlar", "test_set")(_target_pairs),
        "evidence_containment": over("kararlar", "test_set")(_evidence),
        "stem_overlap": over("kararlar", "test_set")(_stem_shares),
        "test_set_defects": over("test_set", "kararlar")(_defects),
        "borrowed_words": over("test_set", "kararlar")(testset.borrowed_words),
        "citations": over("kararlar")(relevance.citations),
        "citation_weights": over("kararlar")(lambda k: relevance.citation_weights(relevance.citations(k), k.select("id").distinct().count())),
        "clean_pool": over("kararlar")(cleaning.clean_pool),
        "cleaning_report": over("kararlar")(lambda k: cleaning.cleaning_report(k, cleaning.clean_pool(k))),
        "clean_numbers_cities": over("kararlar")(lambda k: each_id(k, text=cleaning.tidy(cleaning.drop_cities(cleaning.drop_numbers(F.col("text")))))),
        "section_table": over("kararlar")(sections.section_table),
        "section_flags": over("kararlar")(lambda k: sections.review_flags(sections.section_table(k))),
        "section_flag_rates": over("kararlar")(lambda k: sections.flag_rates(sections.review_flags(sections.section_table(k)))),
        **{f"chunk_{m}": _method(m) for m in chunking.METHODS},
        "chunk_fixed_words": over("documents")(_fixed_windows),
        "chunk_packed_ranges": over("documents")(_packed_sentences),
        "long_text_pieces": over("documents")(_long_pieces),
        "chunk_table_info": over("chunks")(chunking.chunk_table_info),
        "chunks_by_source": over("chunks")(lambda c: chunking.chunks_by_source(c.withColumn("source", sampling.source_key(F.col("source"))))),
        "chunk_example_choice": over("chunks")(lambda c: ranking.between_or_all(c.filter("source is not null").withColumn("source", sampling.source_key(F.col("source"))), "n_chunks", 3, 5, "source").groupBy("source").agg(F.count("*").alias("n"))),
        "split_group_count": over("chunks")(lambda c: ranking.groups_beyond_one(c, "decision_id")),
        "token_spread": over("chunks")(_token_spread),
        "section_value_counts": over("chunks")(lambda c: ranking.value_counts(c, "bolum", "bulunamadı")),
        "evaluation": over("chunks", "test_set", "kararlar")(pipeline.evaluated),
        "evaluation_summary": over("chunks", "test_set", "kararlar")(lambda c, t, k: evaluate.summary(pipeline.evaluated(c, t, k), "sorgu_tipi")),
        "evaluation_wide_summary": over("chunks", "test_set", "kararlar")(lambda c, t, k: evaluate.wide_summary(pipeline.evaluated(c, t, k, max(evaluate.CUTS)), "sira_genis")),
        "evaluation_clean_summary": over("kararlar", "test_set")(lambda k, t: evaluate.wide_summary(pipeline.evaluated_clean(k, t), "sira_genis")),
        "search_results": over("chunks", "test_set")(pipeline.searched),
        "rerank_before_after": over("chunks", "test_set", "kararlar")(pipeline.reranked),
        "rerank_whole_texts": over("chunks", "test_set", "kararlar")(lambda c, t, k: pipeline.reranked(c, t, k, text="orijinal")),
        "rerank_clean_texts": over("chunks", "test_set", "kararlar")(lambda c, t, k: pipeline.reranked(c, t, k, text="temiz")),
        "experiment_sections": over("experiments")(lambda e: experiments.sectioned(e).groupBy("bolum").agg(F.count("*").alias("n"))),
        "experiment_log_once": over("experiments")(lambda e: experiments.once(e).select("satir_no")),
        "experiment_report": over("experiments")(_report),
        "experiment_best_of_three": over("experiments")(_all_best),
        "experiment_values": over("experiments")(lambda e: ranking.value_counts(e, "test_seti")),
        "experiment_grid": over("modeller")(_grid_rows),
        "clean_grid": over("modeller")(_clean_grid_rows),
        "log_with_separator": over("experiments")(_separated),
        **more.queries(),
        "union_by_name_log": over("orders", "events")(_evolving),
        "running_section_flag": over("events")(_flagged_events),
        "newest_per_user": over("events")(lambda e: ranking.top_k(e.select("user_id", "event_id", "ts"), ["user_id"], [F.col("ts").desc(), "event_id"], 3).drop("ts")),
        "windowed_counts": over("events")(lambda e: incremental.windowed_counts(e, "ts", ["event_type"])),
        "lookup_join": over("orders", "customer", "nation")(_by_nation),
    }


# -- SQL ------------------------------------------------------------------------------------

_KEY = f"replace({spelling_key_sql('source')}, ' ', '_')"
_SCORES = "SELECT q.vec_id AS query, e.vec_id, e.label, round(list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) AS s FROM embeddings e JOIN (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q ON true"
_LABELS = f"""WITH s AS ({_SCORES}),
    b AS (SELECT *, row_number() OVER (PARTITION BY query, label ORDER BY s DESC, vec_id) AS rn FROM s),
    r AS (SELECT query, vec_id, label, s, row_number() OVER (PARTITION BY query ORDER BY s DESC, label, vec_id) AS rank FROM b WHERE rn = 1)"""
_OWN = f"""{_LABELS}, o AS (SELECT r.query, e.label AS own, min(CASE WHEN r.label = e.label AND rank <= 100 THEN rank END) AS sira FROM r JOIN embeddings e ON e.vec_id = r.query GROUP BY ALL)"""
_THREE_RUNS = f"""WITH s AS ({_SCORES}), t AS (SELECT s.*, i FROM s JOIN (VALUES (0), (1), (2)) AS v(i) ON vec_id % 3 <> i),
    b AS (SELECT *, row_number() OVER (PARTITION BY i, query, label ORDER BY s DESC, vec_id) AS rn FROM t),
    runs AS (SELECT query AS test_id, i AS tekrar, label, s, row_number() OVER (PARTITION BY i, query ORDER BY s DESC, label, vec_id) AS rank FROM b WHERE rn = 1)"""
_METRICS = "count(*) AS sorgu, " + ", ".join(f"round(100.0 * avg(CASE WHEN sira <= {k} THEN 1.0 ELSE 0.0 END), 6) AS ilk{k}" for k in evaluate.CUTS) + ", round(avg(coalesce(1.0 / sira, 0)), 6) AS mrr"
_USABLE = f"""usable AS (
    SELECT * FROM (
      SELECT id, {_KEY} AS source, karar_tarihi, row_number() OVER (PARTITION BY id ORDER BY (court IS NOT NULL)::INT + (esas_no IS NOT NULL)::INT + (karar_no IS NOT NULL)::INT + (karar_tarihi IS NOT NULL)::INT DESC,
        court NULLS FIRST, esas_no NULLS FIRST, karar_no NULLS FIRST, karar_tarihi NULLS FIRST, year NULLS FIRST) AS rn
      FROM kararlar WHERE id IS NOT NULL AND length(text) >= 300) WHERE rn = 1)"""
_ONCE = "once AS (SELECT id, max(text) AS text FROM kararlar WHERE id IS NOT NULL GROUP BY id)"
_STEMS = "list_distinct(list_transform(list_filter(regexp_extract_all(lower(translate({0}, 'İI', 'iı')), '[a-zçğıöşü]{{3,}}'), lambda w: NOT list_contains([" + ", ".join(f"'{w}'" for w in tx.STOP_WORDS) + "], w)), lambda w: substr(w, 1, 5)))"
_TERMS = "regexp_extract_all(lower(translate(text, 'İI', 'iı')), '[\\p{L}\\p{N}_]+')"
_RUNS = f"list_distinct(list_transform(range(1, greatest(1, len({_TERMS}) - 3)), lambda i: array_to_string(list_slice({_TERMS}, i, i + 4), ' ')))"
_FLAT = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"
_WORDS = "list_filter(regexp_split_to_array({0}, '[\\s\\x{{0B}}\\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]+'), lambda w: w <> '')"


def _quotas(size: int) -> str:
    return "(VALUES " + ", ".join(f"('{s}', {q})" for s, q in sampling.quota_table(size)) + ") AS q(source, quota)"


def _drawn(size: int, where: str = "true", quotas: str | None = None) -> str:
    seed = sampling.seed_for(size)
    return f"""SELECT id, source FROM (
        SELECT u.id, u.source, quota, row_number() OVER (PARTITION BY u.source ORDER BY md5(u.id || '|{seed}'), u.id) AS n
        FROM usable u JOIN {quotas or _quotas(size)} ON q.source = u.source WHERE {where}) WHERE n <= quota"""


def _mapping(values: dict[str, str], expr: str) -> str:
    return f"CASE {expr} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + " END"


_HEAD = f"coalesce({_mapping(tx.SOURCE_LABELS, _KEY)}, {_KEY}), nullif(trim(court), '')"
_MARK = "coalesce(starts_with(tarih, '#'), false)"
_SECTIONED = f"""first AS (SELECT min(satir_no) AS f FROM experiments WHERE {_MARK}),
    sectioned AS (SELECT e.*, CASE WHEN reranker IS NOT NULL THEN 4 WHEN coalesce(satir_no >= f, false) THEN 3 WHEN karar_sayisi = 2000 THEN 1 ELSE 2 END AS bolum
      FROM {{0}} e CROSS JOIN first WHERE NOT {_MARK})"""
_ONCE_LOG = """once_log AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY hash(COLUMNS(* EXCLUDE (satir_no))) ORDER BY satir_no) AS rn FROM experiments) WHERE rn = 1)"""
_LOG_COLUMNS = (
    'tarih, deneme, model, yontem, parca_siniri, ortusme, karar_sayisi, parca_sayisi, bolunen_karar, ort_parca_token, en_uzun_parca_token, embedding_sn, test_seti, test_sorgu, "ilk1_%", "ilk5_%", '
    '"ilk10_%", mrr, "kanit_ilk5_%", okunan_token_ilk5, "ilk1_genis_%", "ilk5_genis_%", "ilk10_genis_%", mrr_genis, reranker, aday_sayisi, rerank_sn, "not", olcum_tarihi'
)
_ONCE_LOG = f"once_log AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY {_LOG_COLUMNS} ORDER BY satir_no) AS rn FROM experiments WHERE NOT {_MARK}) WHERE rn = 1)"
_REPORT = f"""report AS (
    SELECT satir_no, bolum, {_mapping(experiments.POOL_LABELS, 'karar_sayisi::VARCHAR')} AS havuz,
      CASE WHEN contains(coalesce("not", ''), 'aday:') THEN CASE WHEN contains("not", '/temiz/') THEN 'temiz' ELSE 'ham' END WHEN starts_with(coalesce("not", ''), 'temiz') THEN 'temiz' ELSE 'ham' END AS veri,
      model,
      CASE WHEN regexp_matches(deneme, '^.+_c\\d+_o\\d+$')
        THEN {_mapping(experiments.METHOD_LABELS, "regexp_extract(deneme, '^(.+)_c(\\d+)_o(\\d+)$', 1)")} || ' ' || regexp_extract(deneme, '^(.+)_c(\\d+)_o(\\d+)$', 2) || '/' || regexp_extract(deneme, '^(.+)_c(\\d+)_o(\\d+)$', 3)
        ELSE {_mapping(experiments.METHOD_LABELS, 'deneme')} END || CASE WHEN regexp_matches(coalesce("not", ''), 'tam k.nye') THEN ' (tam künye)' ELSE '' END AS yontem_adi,
      {_mapping(experiments.TEST_LABELS, 'test_seti')} AS test_adi,
      round(coalesce("ilk1_genis_%", "ilk1_%"), 1) AS ilk1, round(coalesce("ilk5_genis_%", "ilk5_%"), 1) AS ilk5, round(coalesce("ilk10_genis_%", "ilk10_%"), 1) AS ilk10,
      CASE WHEN bolum = 4 THEN reranker END AS reranker,
      CASE WHEN bolum = 4 THEN CASE WHEN regexp_extract(coalesce("not", ''), 'metin: ([\\p{{L}}\\p{{N}}_]+)', 1) = '' THEN 'parça' ELSE regexp_extract("not", 'metin: ([\\p{{L}}\\p{{N}}_]+)', 1) END END AS reranker_metni
    FROM sectioned)"""


def _best(label: str, order: list[str], where: str) -> str:
    by = ", ".join(f"{c} DESC NULLS LAST" for c in order) + ", satir_no"
    config = ", ".join(experiments.CONFIG)
    return f"""SELECT havuz, '{label}' AS liste, rank, satir_no, ilk1, ilk5, ilk10 FROM (
        SELECT *, row_number() OVER (PARTITION BY havuz ORDER BY {by}) AS rank FROM (
          SELECT *, row_number() OVER (PARTITION BY {config} ORDER BY {by}) AS c FROM plain WHERE havuz IS NOT NULL AND {order[0]} IS NOT NULL AND {where}) WHERE c = 1) WHERE rank <= 3"""


def oracle_sql() -> dict[str, str]:
    usable, once = f"WITH {_USABLE}", f"WITH {_ONCE}"
    base = f"{usable}, base AS ({_drawn(400)}), have AS (SELECT source, count(*) AS have FROM base GROUP BY source)"
    need = f"(SELECT q.source, quota - coalesce(have, 0) AS quota FROM {_quotas(1000)} LEFT JOIN have ON have.source = q.source) AS q"
    report = f"WITH {_SECTIONED.format('experiments')}, {_REPORT} SELECT * FROM report"
    return more.oracle_sql(lambda source: f"coalesce({_mapping(tx.SOURCE_LABELS, source)}, {source})") | {
        "vector_topk_best_per_group": f"{_LABELS} SELECT query, rank, round(s, 6) AS score, vec_id, label FROM r WHERE rank <= 5",
        "vector_topk": f"SELECT query, rank, round(s, 6) AS score, vec_id FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY s DESC, vec_id) AS rank FROM ({_SCORES})) WHERE rank <= 10",
        "vector_topk_overfetch": f"""WITH n AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY s DESC, vec_id) AS r FROM ({_SCORES})),
            b AS (SELECT *, row_number() OVER (PARTITION BY query, label ORDER BY r) AS c FROM n WHERE r <= 25)
            SELECT query, rank, round(s, 6) AS score, vec_id, label FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY s DESC, vec_id) AS rank FROM b WHERE c = 1) WHERE rank <= 5""",
        "vector_search_filtered": f"SELECT query, rank, round(s, 6) AS score, vec_id FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY s DESC, vec_id) AS rank FROM ({_SCORES}) WHERE label >= 5) WHERE rank <= 5",
        "fusion_greatest": f"SELECT query, vec_id, round(CASE WHEN label % 2 = 0 THEN greatest(s, s * 1.25::DOUBLE) ELSE s END, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY s DESC, vec_id) AS rank FROM ({_SCORES})) WHERE rank <= 10",
        "first_match_rank": f"{_OWN} SELECT query, own, sira FROM o",
        "hit_at_k_summary": f"{_OWN} SELECT {_METRICS} FROM o",
        "hit_at_k_by_group": f"{_OWN} SELECT own, {_METRICS} FROM o GROUP BY own",
        "pivot_top5": f"{_LABELS} SELECT query, " + ", ".join(f"coalesce(max(CASE WHEN rank = {i} THEN label::VARCHAR END), '') AS sonuc_{i}" for i in range(1, 6)) + " FROM r GROUP BY query",
        "rerank_identity": f"{_LABELS} SELECT query AS test_id, label, rank AS sira_once, rank AS sira_sonra FROM r WHERE rank <= 10",
        "repeatability": f"{_THREE_RUNS} SELECT test_id, count(*) AS tekrar, count(DISTINCT liste) AS farkli_liste, sum(bulundu)::BIGINT AS ilk5_bulundu, round(max(ilk) - min(ilk), 6) AS skor_araligi FROM (SELECT test_id, tekrar, list(label ORDER BY rank) AS liste, max(CASE WHEN label = 0 AND rank <= 5 THEN 1 ELSE 0 END) AS bulundu, max(CASE WHEN rank = 1 THEN s END) AS ilk FROM runs GROUP BY test_id, tekrar) GROUP BY test_id",
        "rank_histogram": f"{_THREE_RUNS} SELECT test_id, sira, count(*) AS n FROM (SELECT test_id, tekrar, min(CASE WHEN label = 0 THEN rank END) AS sira FROM runs GROUP BY test_id, tekrar) GROUP BY test_id, sira",
        "row_groups": "SELECT count(*) AS satir, max(karar_tarihi) AS en_buyuk FROM kararlar",
        "row_group_rows": "SELECT year, count(*) AS n, count(DISTINCT id) AS tekil FROM kararlar GROUP BY year",
        "log_with_separator": f"SELECT count(*) AS n, count(*) FILTER ({_MARK}) AS ayrac, max(satir_no) AS son FROM (SELECT tarih, satir_no FROM experiments UNION ALL SELECT '# yeni ölçüm', max(satir_no) + 1 FROM experiments)",
        "experiment_grid": f"""WITH runs(havuz, model_token, deneme, sinir) AS (VALUES {", ".join(str(r) for r in _GRID)}) SELECT model, havuz, deneme, greatest(1, floor(16384 / greatest(sinir, 1)))::INT AS yigin FROM modeller JOIN runs ON max_tokens = model_token""",
        "clean_grid": "SELECT model, pool AS havuz, unnest(CASE WHEN pool = 2000 THEN runs ELSE runs[1:2] END) AS deneme FROM (SELECT model, pool, CASE WHEN max_tokens >= 1024 THEN ['per_decision', 'recursive_c1024_o128', 'recursive_c128_o16', 'recursive_c64_o8'] ELSE ['per_decision', 'recursive_c512_o64', 'recursive_c128_o16', 'recursive_c64_o8'] END AS runs FROM modeller CROSS JOIN (VALUES (2000), (10000)) AS p(pool))",
        "best_fetchers_at_hundred": f"""WITH {_ONCE_LOG}, {_SECTIONED.format('once_log')}, {_REPORT}, plain AS (SELECT *, ilk10 + satir_no % 5 AS ilk100 FROM report WHERE (reranker IS NULL OR reranker = 'yok') AND havuz IS NOT NULL AND test_adi IS NOT NULL AND ilk10 IS NOT NULL)
            SELECT havuz, test_adi, rank, satir_no, ilk100, ilk5, ilk1 FROM (SELECT *, row_number() OVER (PARTITION BY havuz, test_adi ORDER BY ilk100 DESC NULLS LAST, ilk5 DESC NULLS LAST, ilk1 DESC NULLS LAST, satir_no) AS rank FROM (
              SELECT *, row_number() OVER (PARTITION BY {', '.join(dict.fromkeys(['havuz', 'test_adi', *[c for c in experiments.CONFIG if c not in ('reranker', 'reranker_metni')]]))} ORDER BY ilk100 DESC NULLS LAST, ilk5 DESC NULLS LAST, ilk1 DESC NULLS LAST, satir_no) AS c FROM plain) WHERE c = 1) WHERE rank <= 3""",
        "block_sample": f"""WITH k AS (SELECT id, any_value({_KEY}) AS source, max(length(text)) AS n FROM kararlar WHERE id IS NOT NULL GROUP BY id), h AS (SELECT id, min(dosya) AS block FROM havuz_uyelik GROUP BY id),
            q AS (SELECT * FROM {_quotas(1000)}), blocks AS (SELECT DISTINCT source, block FROM k JOIN h USING (id)),
            ranked AS (SELECT b.*, quota, count(*) OVER (PARTITION BY b.source) AS nb, row_number() OVER (PARTITION BY b.source ORDER BY md5(block || '|{sampling.SEED}'), block) AS r FROM blocks b JOIN q ON q.source = b.source WHERE block IS NOT NULL),
            chosen AS (SELECT source, block, quota, ceil(quota / least(nb, ceil(quota / 100.0))) AS each FROM ranked WHERE r <= least(nb, ceil(quota / 100.0))),
            drawn AS (SELECT k.id, c.source, c.block, quota, each, row_number() OVER (PARTITION BY c.source, c.block ORDER BY md5(k.id || '|{sampling.SEED}'), k.id) AS rn FROM k JOIN h USING (id) JOIN chosen c ON c.source = k.source AND c.block = h.block WHERE n >= {sampling.MIN_TEXT_LEN})
            SELECT id, source, block FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5(id || '|{sampling.SEED + 1}'), id) AS n FROM drawn WHERE rn <= each) WHERE n <= quota""",
        "pool_summary": f"SELECT {_KEY} AS source, count(*) AS karar, count(DISTINCT court) AS daire, min(year) AS ilk_yil, max(year) AS son_yil, round_even(avg(length(text)), 0)::BIGINT AS ort_uzunluk FROM kararlar GROUP BY 1",
        "quota_sample": f"{usable} {_drawn(1000)}",
        "newest_n_per_source": f"""{usable} SELECT id, source, karar_tarihi FROM (
            SELECT u.*, quota, row_number() OVER (PARTITION BY u.source ORDER BY karar_tarihi DESC, id) AS n FROM usable u JOIN {_quotas(400)} ON q.source = u.source WHERE karar_tarihi IS NOT NULL) WHERE n <= quota""",
        "nested_pool_growth": f"{base} SELECT id, source, false AS yeni FROM base UNION ALL SELECT id, source, true AS yeni FROM ({_drawn(1000, 'u.id NOT IN (SELECT id FROM base)', need)})",
        "random_per_source": f"SELECT id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5(id || '|1'), id) AS n FROM (SELECT DISTINCT id, {_KEY} AS source FROM kararlar WHERE id IS NOT NULL)) WHERE n <= 3",
        "duplicate_ids": "SELECT id, count(*) AS n FROM kararlar GROUP BY id HAVING count(*) > 1",
        "source_counts_combined": f"SELECT coalesce(a.source, b.source) AS source, karar, belge FROM (SELECT {_KEY} AS source, count(*) AS karar FROM kararlar GROUP BY 1) a FULL JOIN (SELECT source, count(*) AS belge FROM documents GROUP BY 1) b ON a.source = b.source",
        "headers": f"""SELECT id, concat_ws(' ', {_HEAD}, nullif(trim(esas_no), '') || ' E.', nullif(trim(karar_no), '') || ' K.', nullif(trim(karar_tarihi), '')) AS tam,
            concat_ws(' ', {_HEAD}) AS kisa, concat_ws(' ', {_HEAD}, nullif(trim(esas_no), '')) AS ad FROM kararlar""",
        "word_count": f"{once} SELECT id, len({_WORDS.format('text')}) AS sozcuk, CASE WHEN text IS NOT NULL THEN length(array_to_string({_WORDS.format('text')}, ' ')) END AS uzunluk FROM once",
        "text_preview": f"{once} SELECT id, left(text, 200) AS bas, right(text, 120) AS son FROM once",
        "longest_per_source": f"SELECT source, id, n FROM (SELECT {_KEY} AS source, id, length(text) AS n, row_number() OVER (PARTITION BY {_KEY} ORDER BY length(text) DESC NULLS LAST, id DESC) AS r FROM kararlar WHERE id IS NOT NULL) WHERE r = 1",
        "decisions_without_chunks": "SELECT DISTINCT id FROM kararlar k WHERE NOT EXISTS (SELECT 1 FROM chunks c WHERE c.decision_id = k.id)",
        "decisions_with_late_chunks": "SELECT DISTINCT id FROM kararlar WHERE id IN (SELECT decision_id FROM chunks WHERE chunk_index >= 6)",
        "shingle_counts": f"{once} SELECT id, CASE WHEN text IS NULL THEN NULL WHEN len({_TERMS}) < 5 THEN 0 ELSE len({_RUNS}) END AS n FROM once",
        "text_overlap_targets": f"""{once}, t AS (SELECT DISTINCT kaynak, karar_id AS id FROM test_set),
            r AS (SELECT id, CASE WHEN len({_TERMS}) < 5 THEN [] ELSE {_RUNS} END AS runs FROM once WHERE id IN (SELECT id FROM t))
            SELECT a.id AS target, b.id AS candidate, round(coalesce(len(list_intersect(x.runs, y.runs)), 0) / greatest(1, least(coalesce(len(x.runs), 0), coalesce(len(y.runs), 0))), 6) AS text_share
            FROM t a JOIN t b ON a.kaynak = b.kaynak AND a.id < b.id LEFT JOIN r x ON x.id = a.id LEFT JOIN r y ON y.id = b.id""",
        "evidence_containment": f"{once} SELECT test_id, coalesce(contains({_FLAT.format('text')}, {_FLAT.format('kanit')}), false) AS var FROM test_set LEFT JOIN once ON id = karar_id",
        "stem_overlap": f"{once} SELECT test_id, round(len(list_intersect({_STEMS.format('sorgu')}, {_STEMS.format('text')})) / nullif(len({_STEMS.format('sorgu')}), 0), 6) AS pay FROM test_set JOIN once ON id = karar_id",
        "test_set_defects": f"{once}, tests AS (SELECT test_id, karar_id, kanit FROM test_set UNION ALL SELECT 'ters-' || test_id, karar_id, reverse(kanit) FROM test_set UNION ALL SELECT 'yok-' || test_id, 'yok-' || karar_id, kanit FROM test_set) SELECT test_id, CASE WHEN text IS NULL THEN 'hedef_yok' ELSE 'kanit_yok' END AS kusur FROM tests LEFT JOIN once ON id = karar_id WHERE NOT coalesce(contains({_FLAT.format('text')}, {_FLAT.format('kanit')}), false)",
        "chunk_fixed_words": f"""WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
            s AS (SELECT doc_id, w, unnest(CASE WHEN len(w) <= 64 THEN [0] ELSE range(0, len(w) - 8, 56) END) AS a FROM w)
            SELECT doc_id, (a // 56)::INT AS parca, md5(array_to_string(list_slice(w, a + 1, a + 64), ' ')) AS ozet FROM s""",
        "long_text_pieces": f"""WITH w AS (SELECT doc_id, text, {_WORDS.format("coalesce(text, '')")} AS w FROM documents), s AS (SELECT doc_id, text, len(w) AS n, unnest(range(0, greatest(1, ceil(len(w) / 256))::BIGINT)) AS p FROM w WHERE text IS NOT NULL)
            SELECT doc_id, p::INT AS parca, greatest(0, least(256, n - 256 * p))::INT AS n FROM s UNION ALL SELECT doc_id, NULL, NULL FROM w WHERE text IS NULL""",
        "chunk_table_info": """SELECT count(*) AS karar_sayisi, sum(n)::BIGINT AS parca_sayisi, count(*) FILTER (n > 1) AS bolunen_karar, round_even(sum(t) / sum(n), 0)::INT AS ort_parca_token, max(m) AS en_uzun_parca_token
            FROM (SELECT decision_id, count(*) AS n, sum(tokens) AS t, max(tokens) AS m FROM chunks GROUP BY decision_id)""",
        "chunks_by_source": f"SELECT {_KEY} AS source, count(DISTINCT decision_id) AS karar, count(*) AS parca, round(avg(tokens), 4) AS ort_token FROM chunks GROUP BY 1",
        "chunk_example_choice": f"""WITH c AS (SELECT {_KEY} AS source, n_chunks BETWEEN 3 AND 5 AS fits FROM chunks WHERE source IS NOT NULL), a AS (SELECT source, bool_or(fits) AS fitting FROM c GROUP BY source)
            SELECT source, count(*) AS n FROM c JOIN a USING (source) WHERE fits OR NOT fitting GROUP BY source""",
        "split_group_count": "SELECT count(*) AS n FROM (SELECT decision_id FROM chunks GROUP BY decision_id HAVING count(*) > 1)",
        "token_spread": f"SELECT {_KEY} AS source, quantile_cont(tokens, 0.5) AS ortanca, min(tokens) AS en_az, max(tokens) AS en_cok, sum(tokens)::BIGINT AS toplam FROM chunks GROUP BY 1",
        "section_value_counts": "SELECT CASE WHEN bolum = '' THEN 'bulunamadı' ELSE bolum END AS bolum, count(*) AS n FROM chunks GROUP BY 1",
        "experiment_sections": f"WITH {_SECTIONED.format('experiments')} SELECT bolum, count(*) AS n FROM sectioned GROUP BY bolum",
        "experiment_log_once": f"WITH {_ONCE_LOG} SELECT satir_no FROM once_log",
        "experiment_report": report,
        "experiment_sheet": f"WITH {_SECTIONED.format('experiments')}, {_REPORT} SELECT bolum, satir_no::BIGINT AS satir, NULL AS baslik, model FROM report UNION ALL SELECT bolum, 0, 'Bölüm ' || bolum || ': ' || count(*) || ' deneme', NULL FROM report GROUP BY bolum",
        "experiment_best_of_three": f"""WITH {_ONCE_LOG}, {_SECTIONED.format('once_log')}, {_REPORT},
            plain AS (SELECT * REPLACE (CASE WHEN reranker IS NULL OR reranker = 'yok' THEN NULL ELSE reranker END AS reranker, CASE WHEN reranker IS NULL OR reranker = 'yok' THEN NULL ELSE reranker_metni END AS reranker_metni) FROM report)
            {_best('son siralama', ['ilk5', 'ilk1', 'ilk10'], 'true')} UNION ALL {_best('aday getirici', ['ilk10', 'ilk5', 'ilk1'], 'reranker IS NULL')}""",
        "experiment_values": "SELECT test_seti, count(*) AS n FROM experiments GROUP BY test_seti",
        "union_by_name_log": "SELECT durum, event_type, count(*) AS n, sum(k)::BIGINT AS toplam FROM (SELECT o_orderkey AS k, o_orderstatus AS durum, NULL AS event_type FROM orders UNION ALL SELECT event_id, NULL, event_type FROM events) GROUP BY ALL",
        "running_section_flag": """WITH f AS (SELECT min(event_id) AS f FROM events WHERE event_type = 'purchase' AND event_id % 1000 = 7)
            SELECT coalesce(event_id >= f, false) AS sonra, count(*) AS n, min(event_id) AS ilk FROM events CROSS JOIN f GROUP BY 1""",
        "newest_per_user": "SELECT user_id, event_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS rank FROM events) WHERE rank <= 3",
        "windowed_counts": "SELECT date_trunc('hour', ts) AS baslangic, event_type, count(*) AS n FROM events GROUP BY ALL",
        "lookup_join": "SELECT n_name, count(*) AS n, round(sum(o_totalprice), 2) AS toplam FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
    }
