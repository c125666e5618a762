"""More queries of the core operators, by name, and their SQL: chunks, relevance, metrics, sections, files, streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terazi.functions import text as tx
from terazi.functions.turkish import spelling_key_sql
from terazi.operators import chunking, evaluate, experiments, ranking, relevance, sampling, search, sections, testset
from terazi.session import scratch_path, table
from terazi.sources import io
from terazi.streaming import incremental

Query = Callable[[SparkSession, str], DataFrame]
LIMIT, OVERLAP = 256, 32


def over(*names: str) -> Callable[[Callable[..., DataFrame]], Query]:
    """A query that gets whole tables."""
    return lambda f: lambda spark, d: f(*[table(spark, d, n) for n in names])


# -- relevance over baskets: orders cite parts of suppliers as decisions cite articles of statutes ----


def _cited(lines: DataFrame) -> DataFrame:
    return lines.select(F.col("l_orderkey").alias("id"), F.col("l_suppkey").cast("string").alias("law"), (F.col("l_partkey") % 97).cast("int").alias("article")).distinct()


def _basket_weights(lines: DataFrame) -> DataFrame:
    size = lines.select("l_orderkey").distinct().count()
    return relevance.citation_weights(_cited(lines), size).withColumn("weight", F.round("weight", 6))


def _basket_overlap(lines: DataFrame) -> DataFrame:
    cited = _cited(lines)
    weights = relevance.citation_weights(cited, lines.select("l_orderkey").distinct().count())
    # every order whose key is divisible by 100, against the orders that share a citation with it
    asked = cited.filter("id % 100 = 0").select(F.col("id").alias("target"), "law", "article")
    pairs = asked.join(cited.withColumnRenamed("id", "candidate"), ["law", "article"]).filter("target <> candidate").select("target", "candidate").distinct()
    return relevance.law_overlap(pairs, cited, weights).withColumn("law_share", F.round("law_share", 6))


# -- metrics -----------------------------------------------------------------------------------------


def _results(e: DataFrame) -> DataFrame:
    """Results of queries over vectors in the form that metrics are taken from: the own label is the target, labels of its parity
    count in the wide measure."""
    asked = e.filter(F.col("vec_id") % 100 == 0)
    near = search.search(asked.select(F.col("vec_id").alias("query"), "embedding"), e, 100, row_key="vec_id", group="label")
    own = asked.select(F.col("vec_id").alias("query"), F.col("label").alias("own"))
    r = near.join(own, "query").select("query", "own", "rank", "label", "vec_id", (F.col("label") == F.col("own")).alias("hit"), ((F.col("label") - F.col("own")) % 2 == 0).alias("wide"))
    return r.groupBy("query", "own").agg(
        F.min(F.when(F.col("hit"), F.col("rank"))).alias("sira"), F.min(F.when(F.col("wide") & ~F.col("hit"), F.col("rank"))).alias("sira_genis"),
        F.max((F.col("rank") <= 5) & (F.col("label") == 3)).alias("kanit_ilk5"), F.sum(F.when(F.col("rank") <= 5, F.col("vec_id") % 50).otherwise(0)).alias("okunan_token_ilk5"),
        F.sum(((F.col("rank") <= 5) & F.col("wide")).cast("int")).alias("ilgili_ilk5"),
    )


def _per_task(e: DataFrame) -> DataFrame:
    runs = _results(e).select(F.concat(F.lit("r"), (F.col("query") % 7).cast("string")).alias("deneme"), F.col("own").cast("string").alias("sorgu_tipi"), "sira_genis")
    return experiments.per_task(runs, "sira_genis")


def _mismatches(log: DataFrame) -> DataFrame:
    plain = log.filter(F.col("deneme").isNotNull())
    mean = plain.groupBy("deneme").agg(F.round(F.avg("ilk5_%"), 6).alias("ilk5"))
    return experiments.mismatches(mean, plain.groupBy("deneme").agg(F.max("ilk5_%").alias("ilk5")))


def _hundred(log: DataFrame) -> DataFrame:
    """The best candidate fetchers per pool and task by hits at a hundred, here in place of what per-query files would give."""
    t = experiments.report_table(experiments.once(log)).withColumn("ilk100", F.col("ilk10") + F.col("satir_no") % 5)
    return experiments.best_fetchers(t.filter(F.col("havuz").isNotNull() & F.col("test_adi").isNotNull())).select("havuz", "test_adi", "rank", "satir_no", "ilk100", "ilk5", "ilk1")


def _evidence(tests: DataFrame, chunks: DataFrame) -> DataFrame:
    ranked = tests.select("test_id", F.col("karar_id").alias("decision_id")).join(chunks, "decision_id").select("test_id", (F.col("chunk_index") + 1).alias("rank"), "text")
    return evaluate.evidence_found(ranked, tests)


def _reordered(e: DataFrame) -> DataFrame:
    asked = e.filter(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query"), "embedding")
    near = search.search(asked, e, 10, row_key="vec_id", group="label").select(F.col("query").alias("test_id"), F.col("rank").alias("sira_once"), "label")
    return evaluate.reranked(near.withColumn("puan", (F.col("label") % 3).cast("double"))).select("test_id", "label", "sira_once", "sira_sonra")


# -- sections, here those of the chunk table ------------------------------------------------------------

_LABELS = {"dava_ozeti": "USTBILGI", "gerekce": "GEREKCE", "karar": "HUKUM"}


def _chunk_sections(c: DataFrame) -> DataFrame:
    label = F.coalesce(tx.mapped(F.col("bolum"), _LABELS), F.lit("GURULTU"))
    return c.filter(F.col("decision_id").isNotNull()).select(F.col("decision_id").alias("id"), sampling.source_key(F.coalesce("source", F.lit(""))).alias("source"), label.alias("etiket"), F.coalesce(tx.word_count(F.col("text")), F.lit(0)).alias("token"), F.col("chunk_index").alias("sira"), F.col("text").alias("metin"))


def _sheet(c: DataFrame) -> DataFrame:
    rows = _chunk_sections(c.filter("source is not null"))
    chosen = sampling.sample_per_group(rows.select("id", "source"), "source", 3).groupBy("id").agg(F.lit(1).alias("sira_no"))
    return sections.review_sheet(rows, chosen).select("id", "source", "sira", "etiket", "token", "uyarilar", "bas", "son").distinct()


# -- texts, files, streams -------------------------------------------------------------------------------


def each_id(k: DataFrame, **columns: Column) -> DataFrame:
    """id and columns of each decision, once: taken from its rows before they are grouped, so that no text is shuffled. The text
    of an id never changes, but may be null in some rows."""
    return k.filter(F.col("id").isNotNull()).select("id", *[c.alias(n) for n, c in columns.items()]).groupBy("id").agg(*[F.max(n).alias(n) for n in columns])


def _paragraphs(d: DataFrame) -> DataFrame:
    return d.filter(F.col("text").isNotNull()).select("doc_id", F.posexplode(chunking.plain_paragraphs(F.col("text"))).alias("sira", "p")).select("doc_id", "sira", F.md5("p").alias("ozet"))


def _through(write: Callable[[DataFrame, str], object], read: Callable[[SparkSession, str], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """A table written to the shared folder and read again."""

    def run(rows: DataFrame) -> DataFrame:
        path = scratch_path(rows.sparkSession, "round-trip")
        write(rows, path)
        return read(rows.sparkSession, path)

    return run


def _text_files(t: DataFrame) -> DataFrame:
    back = _through(io.write_texts, io.read_texts)(t.select(F.col("test_id").alias("ad"), F.concat(F.lit("  "), F.col("sorgu"), F.lit(" \n")).alias("metin")))
    return back.select("ad", "metin")


def _store_counts(e: DataFrame) -> DataFrame:
    store = io.VectorStore(e.sparkSession, scratch_path(e.sparkSession, "store"))
    there = io.exists(e.sparkSession, store.path)
    n = store.replace(e.filter("label < 5"))
    store.replace(e)
    return io.values(e.sparkSession, [(there, n, store.read().count(), io.exists(e.sparkSession, store.path))], "once boolean, ilk long, son long, sonra boolean")


def _streamed_counts(spark: SparkSession, d: str) -> DataFrame:
    """windowed_counts() over the events as a stream, to its end."""
    schema = table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{d}/events*.parquet")
    path = scratch_path(spark, "stream")
    counts = incremental.windowed_counts(stream.withColumn("ts", F.col("ts").cast("timestamp")), "ts", ["event_type"], late="30 days")
    incremental.drain(incremental.to_table(counts, f"{path}/out", f"{path}/checkpoint"))
    return spark.read.parquet(f"{path}/out").withColumn("baslangic", F.col("baslangic").cast("timestamp_ntz"))


def _streamed_index(spark: SparkSession, d: str) -> DataFrame:
    """Decisions that arrive in two batches, the second with some of the first again: chunks of each, once."""
    path = scratch_path(spark, "stream")
    rows = table(spark, d, "kararlar").withColumn("geldi", F.pmod(F.xxhash64("id"), F.lit(2)))
    io.write_table(rows.filter("geldi = 0 or year % 2 = 0").drop("geldi").coalesce(1), f"{path}/in/a")
    io.write_table(rows.drop("geldi").coalesce(1), f"{path}/in/b")
    stream = spark.readStream.schema(rows.drop("geldi").schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in/*")
    incremental.drain(incremental.index_decisions(stream, f"{path}/index", f"{path}/checkpoint", "fixed_tokens", LIMIT))
    return incremental.indexed(spark, f"{path}/index").groupBy(F.col("decision_id").alias("id")).agg(F.count("*").alias("n"), F.max("chunk_index").alias("son"))


def queries() -> dict[str, Query]:
    once = over("kararlar")
    return {
        "basket_weights": over("lineitem")(_basket_weights),
        "basket_overlap": over("lineitem")(_basket_overlap),
        "near_copies_of_targets": over("kararlar", "test_set")(lambda k, t: relevance.near_copies(t.select(F.col("karar_id").alias("target")), k).withColumn("text_share", F.round("text_share", 6))),
        "metrics_summary": over("embeddings")(lambda e: evaluate.summary(_results(e))),
        "metrics_by_kind": over("embeddings")(lambda e: evaluate.summary(_results(e).withColumn("sorgu_tipi", F.col("own").cast("string")), "sorgu_tipi")),
        "hits_by_task": over("embeddings")(_per_task),
        "rerank_reordered": over("embeddings")(_reordered),
        "logged_mismatches": over("experiments")(_mismatches),
        "best_fetchers_at_hundred": over("experiments")(_hundred),
        "evidence_at_five": over("test_set", "chunks")(_evidence),
        "accepted_answers": over("test_set")(evaluate.accepted_ids),
        "test_set_versions": over("test_set")(lambda t: t.select("test_id", F.substring_index("test_id", "-", 1).alias("surum"))),
        "section_flags_of_chunks": over("chunks")(lambda c: sections.review_flags(_chunk_sections(c))),
        "section_flag_rates_of_chunks": over("chunks")(lambda c: sections.flag_rates(sections.review_flags(_chunk_sections(c)))),
        "section_review_sheet": over("chunks")(_sheet),
        "plain_paragraphs": over("documents")(_paragraphs),
        "chunk_public_tokens": once(lambda k: chunking.chunk_table(k, "recursive", 512, tok=chunking.PublicTokenizer())),
        "tokenizer_diagnosis": over("documents")(lambda d: chunking.diagnosed(d, "doc_id", "text").select("doc_id", (F.col("parca") > 0).alias("var"), F.size("kayip").alias("kayip"))),
        "experiment_sheet": over("experiments")(lambda e: experiments.grouped_sheet(experiments.report_table(e)).select("bolum", "satir", "baslik", "model")),
        "document_templates": over("chunks")(lambda c: c.select("decision_id", "chunk_index", F.md5(tx.model_input(F.col("header"), F.col("bolum"), F.col("text"))).alias("ozet"))),
        "query_templates": over("test_set")(lambda t: t.select("test_id", tx.query_input(F.col("sorgu")).alias("girdi"))),
        "shortened_texts": once(lambda k: each_id(k, kisa=tx.shorten(F.col("text")))),
        "removed_shares": once(lambda k: each_id(k, yuzde=F.round(tx.removed_percent(tx.word_count(F.col("text")), tx.word_count(F.left("text", F.lit(400)))), 6))),
        "csv_round_trip": over("test_set")(_through(io.write_csv, io.read_csv)),
        "json_round_trip": over("modeller")(_through(io.write_json, lambda s, p: io.read_json_lines(s, p, "model string, klasor string, max_tokens int, batch_tokens int"))),
        "text_files": over("test_set")(_text_files),
        "vector_store": over("embeddings")(_store_counts),
        "partitioned_table": over("orders")(lambda o: _through(lambda rows, p: io.write_table(rows, p, "o_orderstatus"), io.read_parquet)(o).groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("toplam"))),
        "streamed_counts": _streamed_counts,
        "streamed_index": _streamed_index,
    }


# -- SQL ---------------------------------------------------------------------------------------------------

_KEY = f"replace({spelling_key_sql('source')}, ' ', '_')"
WS = "\\s\\x{0B}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}"
_ONCE = "once AS (SELECT id, max(text) AS text FROM kararlar WHERE id IS NOT NULL GROUP BY id)"
_CITED = "cited AS (SELECT DISTINCT l_orderkey AS id, l_suppkey::VARCHAR AS law, (l_partkey % 97)::INT AS article FROM lineitem), n AS (SELECT count(DISTINCT l_orderkey)::DOUBLE AS n FROM lineitem), weights AS (SELECT law, article, count(*) AS df, least(ln(any_value(n) / count(*)), ln(any_value(n) / 5)) AS weight, count(*) <= 0.01 * any_value(n) AS specific FROM cited CROSS JOIN n GROUP BY law, article)"
_RANKED = """s AS (SELECT q.vec_id AS query, q.label AS own, e.vec_id, e.label, round(list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) AS s FROM embeddings e JOIN (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q ON true),
    b AS (SELECT *, row_number() OVER (PARTITION BY query, label ORDER BY s DESC, vec_id) AS rn FROM s),
    r AS (SELECT query, own, vec_id, label, row_number() OVER (PARTITION BY query ORDER BY s DESC, label, vec_id) AS rank FROM b WHERE rn = 1)"""
_RESULTS = f"""{_RANKED}, results AS (
    SELECT query, own, min(rank) FILTER (label = own) AS sira, min(rank) FILTER ((label - own) % 2 = 0 AND label <> own) AS sira_genis, bool_or(rank <= 5 AND label = 3) AS kanit_ilk5,
      sum(CASE WHEN rank <= 5 THEN vec_id % 50 ELSE 0 END) AS okunan, count(*) FILTER (rank <= 5 AND (label - own) % 2 = 0) AS ilgili FROM r GROUP BY query, own)"""


def _share(rank: str, k: int, digits: int = 6) -> str:
    return f"round(100.0 * avg(CASE WHEN {rank} <= {k} THEN 1.0 ELSE 0.0 END), {digits})"


_METRICS = (
    f"count(*) AS sorgu, {_share('sira', 1)} AS ilk1, {_share('sira', 5)} AS ilk5, {_share('sira', 10)} AS ilk10, round(avg(coalesce(1.0 / sira, 0)), 6) AS mrr, round(100.0 * avg(kanit_ilk5::INT), 6) AS kanit_ilk5, "
    f"round(avg(okunan), 6) AS okunan_token_ilk5, {_share('sira_genis', 1)} AS ilk1_genis, {_share('sira_genis', 5)} AS ilk5_genis, {_share('sira_genis', 10)} AS ilk10_genis, "
    "round(avg(coalesce(1.0 / sira_genis, 0)), 6) AS mrr_genis, round(20.0 * avg(ilgili), 6) AS ilgili_ilk5"
)
_SECTIONS = f"""sections AS (SELECT decision_id AS id, replace({spelling_key_sql("coalesce(source, '')")}, ' ', '_') AS source, coalesce(CASE bolum WHEN 'dava_ozeti' THEN 'USTBILGI' WHEN 'gerekce' THEN 'GEREKCE' WHEN 'karar' THEN 'HUKUM' END, 'GURULTU') AS etiket,
      coalesce(len(list_filter(regexp_split_to_array(text, '[{WS}]+'), lambda w: w <> '')), 0) AS token, chunk_index AS sira, text FROM chunks WHERE decision_id IS NOT NULL)"""
_FLAGS = f"""{_SECTIONS}, per AS (SELECT id, source, count(*) FILTER (etiket = 'GEREKCE') AS ng, count(*) FILTER (etiket = 'HUKUM') AS nh, coalesce(sum(token) FILTER (etiket = 'GURULTU'), 0) AS gurultu, coalesce(sum(token) FILTER (etiket = 'USTBILGI'), 0) AS ust,
      coalesce(sum(token) FILTER (etiket = 'GEREKCE'), 0) AS gerekce, sum(token) AS toplam FROM sections GROUP BY id, source),
    flags AS (SELECT id, source, concat_ws(',', CASE WHEN ng = 0 THEN 'gerekce_yok' END, CASE WHEN nh = 0 THEN 'hukum_yok' END, CASE WHEN gurultu > 400 THEN 'gurultu_uzun' END, CASE WHEN ust > 500 THEN 'ustbilgi_uzun' END, CASE WHEN gerekce < 0.2 * toplam THEN 'gerekce_kisa' END) AS uyarilar FROM per)"""


def packed_sql(units: str, limit: int, overlap: int) -> str:
    """CTEs that pack units (key, sizes: a list) into ranges [a, b): a step for each range, its carry found from sums."""
    return f"""units AS ({units}),
        sums AS (SELECT key, sizes, len(sizes) AS n, [0] || list_transform(range(1, len(sizes) + 1), lambda i: list_sum(list_slice(sizes, 1, i))::BIGINT) AS s FROM units WHERE len(sizes) > 0),
        walk(key, parca, a, b) AS (
          SELECT key, 0, 0, coalesce(list_min(list_filter(range(1, n), lambda i: s[i + 2] > {limit})), n) FROM sums
          UNION ALL
          SELECT w.key, parca + 1, c.a, coalesce(list_min(list_filter(range(w.b + 1, n), lambda i: s[i + 2] - s[c.a + 1] > {limit})), n)
          FROM walk w JOIN sums USING (key), LATERAL (SELECT coalesce(list_min(list_filter(range(w.a, w.b), lambda j: s[w.b + 1] - s[j + 1] <= {overlap})), w.b) AS j), LATERAL (SELECT CASE WHEN s[w.b + 2] - s[j + 1] <= {limit} THEN j ELSE w.b END AS a) c
          WHERE w.b < n)"""




_META = ("court", "esas_no", "karar_no", "karar_tarihi")


def chunk_sql(pieces: str, label: Callable[[str], str]) -> str:
    """The chunk table of decisions around CTEs that give made(id, chunk_index, text)."""
    head = f"concat_ws(' ', {label('source')}, nullif(trim(court), ''), nullif(trim(esas_no), '') || ' E.', nullif(trim(karar_no), '') || ' K.', nullif(trim(karar_tarihi), ''))"
    return f"""WITH RECURSIVE meta AS (
          SELECT id, replace({spelling_key_sql('max(source)')}, ' ', '_') AS source, {', '.join(f'max({c}) AS {c}' for c in _META)}, max(year) AS year, max(text) AS text FROM kararlar WHERE id IS NOT NULL AND text IS NOT NULL GROUP BY id),
        full_text AS (SELECT * FROM meta WHERE regexp_matches(text, '[^{WS}]')), {pieces}
        SELECT m.id AS decision_id, source, {', '.join(f"coalesce({c}, '') AS {c}" for c in _META)}, year, chunk_index::INT AS chunk_index, (count(*) OVER (PARTITION BY m.id))::INT AS n_chunks, {head} AS header,
          NULL::VARCHAR AS bolum, made.text, len(regexp_extract_all(made.text, '[^{WS}]+'))::INT AS tokens
        FROM made JOIN full_text m ON m.id = made.id"""


def windows_sql(size: int, step: int, whole: int) -> str:
    """made: windows of words cut from the text as it is; texts of at most `whole` words stay whole; a last window that its
    predecessor contains is left out where windows overlap."""
    return f"""w AS (SELECT id, text, regexp_extract_all(text, '[^{WS}]+[{WS}]*') AS w FROM full_text),
        starts AS (SELECT id, w, unnest(range(0, len(w) - {size - step}, {step})) AS a FROM w WHERE len(w) > {whole}),
        made AS (SELECT id, 0 AS chunk_index, text FROM w WHERE len(w) <= {whole} UNION ALL
          SELECT id, a // {step}, regexp_replace(array_to_string(list_slice(w, a + 1, a + {size}), ''), '[{WS}]+$', '') FROM starts)"""


def sentences_sql(limit: int, overlap: int) -> str:
    """made: sentences packed up to the limit; one beyond it is cut into windows first."""
    step = limit - overlap
    return f"""parts AS (SELECT id, unnest(p) AS p, generate_subscripts(p, 1) AS i FROM (SELECT id, string_split(regexp_replace(text, '([.!?;:])[{WS}]+', '\\1' || chr(1), 'g'), chr(1)) AS p FROM full_text)),
        stripped AS (SELECT id, i, regexp_replace(p, '^[{WS}]+|[{WS}]+$', '', 'g') AS p FROM parts),
        worded AS (SELECT id, i, p, regexp_extract_all(p, '[^{WS}]+[{WS}]*') AS w FROM stripped WHERE p <> ''),
        cut AS (SELECT id, i, 0 AS k, p, len(w) AS n FROM worded WHERE len(w) <= {limit} UNION ALL
          SELECT id, i, a, regexp_replace(array_to_string(list_slice(w, a + 1, a + {limit}), ''), '[{WS}]+$', ''), least({limit}, len(w) - a) FROM (SELECT *, unnest(range(0, len(w), {step})) AS a FROM worded WHERE len(w) > {limit})),
        listed AS (SELECT id, list(p ORDER BY i, k) AS ps, list(n ORDER BY i, k) AS ns FROM cut GROUP BY id),
        {packed_sql('SELECT id AS key, ns AS sizes FROM listed', limit, overlap)},
        made AS (SELECT key AS id, parca AS chunk_index, array_to_string(list_slice(ps, a + 1, b), ' ') AS text FROM walk JOIN listed ON id = key)"""


def oracle_sql(label: Callable[[str], str]) -> dict[str, str]:
    once = f"WITH {_ONCE}"
    flat = lambda x: f"regexp_replace(regexp_replace({x}, '[{WS}]+', ' ', 'g'), '^ | $', '', 'g')"
    terms = "regexp_extract_all(lower(translate(text, 'İI', 'iı')), '[\\p{L}\\p{N}_]+')"
    word_list = lambda x: f"list_filter(regexp_split_to_array({x}, '[{WS}]+'), lambda w: w <> '')"
    titles = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in tx.GROUP_TITLES.items())
    return {
        "chunk_fixed_tokens": chunk_sql(windows_sql(LIMIT, LIMIT - OVERLAP, LIMIT), label),
        "chunk_per_decision": chunk_sql(windows_sql(LIMIT - chunking.TITLE_RESERVE, LIMIT - chunking.TITLE_RESERVE, LIMIT - chunking.TITLE_RESERVE), label),
        "chunk_sentence": chunk_sql(sentences_sql(LIMIT, OVERLAP), label),
        "chunk_packed_ranges": f"""WITH RECURSIVE parts AS (SELECT doc_id, unnest(p) AS p, generate_subscripts(p, 1) AS i FROM (SELECT doc_id, string_split(regexp_replace(text, '([.!?;:])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS p FROM documents WHERE text IS NOT NULL)),
            {packed_sql(f"SELECT doc_id AS key, list(len({word_list('p')}) ORDER BY i) AS sizes FROM parts WHERE trim(p) <> '' GROUP BY doc_id", 64, 16)} SELECT key AS doc_id, parca::INT AS parca, a::INT AS bas, b::INT AS son FROM walk""",
        "basket_weights": f"WITH {_CITED} SELECT law, article, df, round(weight, 6) AS weight, specific FROM weights",
        "basket_overlap": f"""WITH {_CITED}, t AS (SELECT id AS target, law, article FROM cited WHERE id % 100 = 0),
            pairs AS (SELECT DISTINCT target, c.id AS candidate FROM t JOIN cited c USING (law, article) WHERE target <> c.id),
            pair_rows AS (SELECT p.target, p.candidate, w.weight, w.specific, c.id IS NOT NULL AS common FROM pairs p JOIN t USING (target) JOIN weights w USING (law, article) LEFT JOIN cited c ON c.id = p.candidate AND c.law = w.law AND c.article = w.article)
            SELECT target, candidate, round(sum(CASE WHEN common THEN weight ELSE 0 END) / nullif(sum(weight), 0), 6) AS law_share, bool_or(common AND specific) AS shares_specific FROM pair_rows GROUP BY target, candidate""",
        "near_copies_of_targets": f"""{once}, worded AS (SELECT id, {terms} AS t FROM once WHERE text IS NOT NULL),
            runs AS (SELECT DISTINCT id, hash(run) AS run FROM (SELECT id, unnest(list_transform(range(1, greatest(1, len(t) - 3)), lambda i: array_to_string(list_slice(t, i, i + 4), ' '))) AS run FROM worded WHERE len(t) >= 5)),
            sizes AS (SELECT id, count(*) AS n FROM runs GROUP BY id), mine AS (SELECT id AS target, run FROM runs WHERE id IN (SELECT karar_id FROM test_set)),
            common AS (SELECT target, id AS candidate, count(*) AS c FROM mine JOIN runs USING (run) WHERE target <> id GROUP BY ALL)
            SELECT target, candidate, round(c / least(x.n, y.n), 6) AS text_share FROM common JOIN sizes x ON x.id = target JOIN sizes y ON y.id = candidate WHERE c >= 0.7 * least(x.n, y.n)""",
        "metrics_summary": f"WITH {_RESULTS} SELECT {_METRICS} FROM results",
        "metrics_by_kind": f"WITH {_RESULTS} SELECT own::VARCHAR AS sorgu_tipi, {_METRICS} FROM results GROUP BY own",
        "hits_by_task": f"WITH {_RESULTS} SELECT 'r' || (query % 7) AS deneme, own::VARCHAR AS sorgu_tipi, {', '.join(f'{_share("sira_genis", k, 1)} AS ilk{k}' for k in (1, 5, 10, 100))} FROM results GROUP BY ALL",
        "rerank_reordered": f"WITH {_RANKED} SELECT query AS test_id, label, rank AS sira_once, row_number() OVER (PARTITION BY query ORDER BY label % 3 DESC, rank) AS sira_sonra FROM r WHERE rank <= 10",
        "logged_mismatches": 'SELECT deneme, round(avg("ilk5_%"), 6) AS turetilen, max("ilk5_%") AS kayitli FROM experiments WHERE deneme IS NOT NULL GROUP BY deneme HAVING abs(round(avg("ilk5_%"), 6) - max("ilk5_%")) > 0.1',
        "evidence_at_five": f"""WITH ranked AS (SELECT test_id, chunk_index + 1 AS rank, c.text, kanit FROM test_set JOIN chunks c ON decision_id = karar_id)
            SELECT test_id, coalesce(bool_or(contains({flat('text')}, {flat('kanit')})), false) AS kanit_ilk5 FROM ranked WHERE rank <= 5 GROUP BY test_id""",
        "accepted_answers": "SELECT DISTINCT test_id, unnest([karar_id] || list_filter(string_split(coalesce(ek_dogru_kararlar, ''), ';'), lambda x: x <> '')) AS decision_id FROM test_set",
        "test_set_versions": "SELECT test_id, string_split(test_id, '-')[1] AS surum FROM test_set",
        "section_flags_of_chunks": f"WITH {_FLAGS} SELECT * FROM flags",
        "section_flag_rates_of_chunks": f"WITH {_FLAGS} SELECT source, " + ", ".join(f"round_even(100 * avg(list_contains(string_split(uyarilar, ','), '{n}')::INT), 0)::INT AS {n}" for n in sections.FLAGS) + " FROM flags GROUP BY source",
        "section_review_sheet": f"""WITH {_FLAGS}, named AS (SELECT DISTINCT decision_id AS id, {_KEY} AS source FROM chunks WHERE source IS NOT NULL AND decision_id IS NOT NULL),
            chosen AS (SELECT DISTINCT id FROM (SELECT id, row_number() OVER (PARTITION BY source ORDER BY md5(id || '|1'), id) AS n FROM named) WHERE n <= 3),
            own AS (SELECT id, source, count(*) FILTER (etiket = 'GEREKCE') AS ng, count(*) FILTER (etiket = 'HUKUM') AS nh, coalesce(sum(token) FILTER (etiket = 'GURULTU'), 0) AS gurultu, coalesce(sum(token) FILTER (etiket = 'USTBILGI'), 0) AS ust,
              coalesce(sum(token) FILTER (etiket = 'GEREKCE'), 0) AS gerekce, sum(token) AS toplam FROM sections WHERE source <> '' GROUP BY id, source),
            flagged AS (SELECT id, concat_ws(',', CASE WHEN ng = 0 THEN 'gerekce_yok' END, CASE WHEN nh = 0 THEN 'hukum_yok' END, CASE WHEN gurultu > 400 THEN 'gurultu_uzun' END, CASE WHEN ust > 500 THEN 'ustbilgi_uzun' END, CASE WHEN gerekce < 0.2 * toplam THEN 'gerekce_kisa' END) AS uyarilar FROM own)
            SELECT DISTINCT id, source, sira, etiket, token::INT AS token, uyarilar, left(text, 200) AS bas, right(text, 120) AS son FROM sections JOIN chosen USING (id) LEFT JOIN flagged USING (id) WHERE source <> ''""",
        "plain_paragraphs": f"""WITH p AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\n[{WS}]*\\n'), lambda x: regexp_matches(x, '[^{WS}]')) AS p FROM documents WHERE text IS NOT NULL)
            SELECT doc_id, (generate_subscripts(p, 1) - 1)::INT AS sira, md5(array_to_string({word_list('unnest(p)')}, ' ')) AS ozet FROM p""",
        "tokenizer_diagnosis": "SELECT doc_id, coalesce(length(text), 0) > 0 AS var, 0::INT AS kayip FROM documents",
        "document_templates": f"SELECT decision_id, chunk_index, md5('title: ' || concat_ws(' — ', header, CASE bolum {titles} END) || ' | text: ' || coalesce(text, '')) AS ozet FROM chunks",
        "query_templates": f"SELECT test_id, '{tx.QUERY_PROMPT}' || coalesce(sorgu, '') AS girdi FROM test_set",
        "shortened_texts": f"{once}, flat AS (SELECT id, {flat('text')} AS t FROM once) SELECT id, CASE WHEN length(t) <= 250 THEN t ELSE trim(regexp_extract(t || ' ', '^((?s).{{0,244}}) ', 1) || ' [...]') END AS kisa FROM flat",
        "removed_shares": f"{once} SELECT id, round(100.0 * (1 - len({word_list('left(text, 400)')}) / nullif(len({word_list('text')}), 0)::DOUBLE), 6) AS yuzde FROM once",
        "csv_round_trip": "SELECT " + ", ".join(f"coalesce({c}, '') AS {c}" for c in ("test_id", "kaynak", "karar_id", "kunye", "sorgu_tipi", "sorgu", "kanit", "ek_dogru_kararlar")) + " FROM test_set",
        "json_round_trip": "SELECT * FROM modeller",
        "text_files": f"SELECT test_id AS ad, regexp_replace(sorgu, '^[{WS}]+|[{WS}]+$', '', 'g') AS metin FROM test_set",
        "vector_store": "SELECT false AS once, count(*) FILTER (label < 5) AS ilk, count(*) AS son, true AS sonra FROM embeddings",
        "partitioned_table": "SELECT o_orderstatus, count(*) AS n, sum(o_orderkey)::BIGINT AS toplam FROM orders GROUP BY 1",
        "streamed_counts": "SELECT date_trunc('hour', ts) AS baslangic, event_type, count(*) AS n FROM events GROUP BY ALL",
        "streamed_index": f"""{once}, w AS (SELECT id, len(regexp_extract_all(text, '[^{WS}]+')) AS w FROM once WHERE regexp_matches(text, '[^{WS}]'))
            SELECT id, n, (n - 1)::INT AS son FROM (SELECT id, CASE WHEN w <= {LIMIT} THEN 1 ELSE ceil((w - {OVERLAP}) / {LIMIT - OVERLAP})::BIGINT END AS n FROM w)""",
    }
