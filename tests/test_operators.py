import math

import numpy as np
from pyspark.sql import functions as F

from terazi.operators import evaluate, experiments, ranking, relevance, sampling, search, testset
from terazi.plans import catalog
from terazi.session import table
from terazi.sources import io
from terazi.streaming import incremental

POOL = "id string, source string, court string, esas_no string, karar_no string, karar_tarihi string, year int, text string, text_len int, dosya string"


def pool(spark, n=40, extra=()):
    rows = [(f"y{i}", ("yargitay", "YARGITAY ")[i % 2], None, None, None, f"2020-01-{i % 28 + 1:02}", 2020, "x" * 300, 1, f"blok{i % 4}") for i in range(n)]
    return spark.createDataFrame([*rows, *rows[:5], *extra], POOL)


def test_quotas():
    assert dict(sampling.quota_table(2000)) == {"yargitay": 800, "emsal": 500, "danistay": 400, "aym_bb": 200, "aym_norm": 100}
    assert dict(sampling.quota_table(10))["aym_norm"] == 0 and dict(sampling.quota_table(30))["aym_norm"] == 2
    assert sampling.seed_for(2000) == 42 and sampling.seed_for(10000) == 10042


def test_sampling(spark):
    df = pool(spark, extra=[(None, "yargitay", None, None, None, None, 1, "x" * 400, 1, None), ("kisa", "yargitay", None, None, None, None, 1, "x", 1, "b"), ("bos", "emsal", None, None, None, None, 1, None, 1, "b")])
    got = [r.id for r in sampling.quota_sample(df, 20).collect()]
    assert len(got) == len(set(got)) == 8
    assert sorted(got) == sorted(r.id for r in sampling.quota_sample(df.repartition(7), 20).collect())
    newest = sampling.newest_per_source(df, 20).collect()
    assert len(newest) == 8 and min(r.karar_tarihi for r in newest) >= "2020-01-21"
    assert sampling.block_sample(df, "dosya", 20).count() == 8
    base = sampling.quota_sample(df, 20)
    grown = sampling.grow_pool(df, base, 40).collect()
    assert len(grown) == 16 and {r.id for r in grown if not r.yeni} == set(got)
    assert sampling.grow_pool(df, base, 20).count() == 8
    assert sampling.duplicate_ids(df).count() == 5
    assert sampling.sample_per_group(df, "source", 3).groupBy("source").count().filter("count > 3").count() == 0
    empty = df.limit(0)
    assert sampling.quota_sample(empty, 20).count() == 0 and sampling.newest_per_source(empty, 20).count() == 0 and sampling.pool_summary(empty).count() == 0


def test_statutes():
    got = relevance.statutes_cited("5237 sayılı TCK'nın 142/1-e maddesi, TCK'nun 141/1, 142/2-h ve 53 ile HMK 303. madde; Anayasa'nın 35. maddesi, 5219 md")
    assert {("5237", 142), ("5237", 141), ("6100", 303), ("ANAYASA", 35)} <= got and all(a < 1000 for _, a in got)
    assert relevance.statutes_cited(None) == set() and relevance.statutes_cited("yok") == set()


def test_relevance(spark):
    words = " ".join(f"k{i}" for i in range(40))
    rows = [("a", words + " TCK 141"), ("a", words + " TCK 141"), ("b", words + " TCK 142"), ("c", "başka metin TCK 141"), ("d", None), ("e", "")]
    rows += [(f"x{i}", f"metin {i}") for i in range(200)]
    df = spark.createDataFrame(rows, "id string, text string")
    pairs = spark.createDataFrame([("a", "b"), ("a", "c"), ("a", "d"), ("a", "e"), ("d", "a"), ("a", "b")], "target string, candidate string")
    runs = relevance.shingle_table(df)
    share = {(r.target, r.candidate): r.text_share for r in relevance.text_overlap(pairs, runs).collect()}
    a, b = (set(zip(*[w[i:] for i in range(5)])) for w in ((words + " tck 141").split(), (words + " tck 142").split()))
    assert math.isclose(share["a", "b"], len(a & b) / min(len(a), len(b))) and share["a", "d"] == 0 and len(share) == 5
    cited = relevance.citations(df)
    weights = relevance.citation_weights(cited, 205)
    w = {(r.law, r.article): r for r in weights.collect()}
    assert math.isclose(w["5237", 142].weight, math.log(205 / 5)) and w["5237", 141].specific
    law = {(r.target, r.candidate): r for r in relevance.law_overlap(pairs, cited, weights).collect()}
    assert law["a", "c"].law_share == 1 and law["a", "c"].shares_specific and law["a", "b"].law_share == 0 and law["d", "a"].law_share is None
    why = {(r.target, r.candidate): r.neden for r in relevance.judged_pairs(pairs, df).collect()}
    assert why == {("a", "b"): "kardes", ("a", "c"): "kanun", ("a", "d"): None, ("a", "e"): None, ("d", "a"): None}


def test_search(spark, sf):
    e = table(spark, sf, "embeddings")
    asked = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), "embedding")
    rows = e.collect()
    m, ids = np.array([r.embedding for r in rows], float), [r.vec_id for r in rows]
    label = {r.vec_id: r.label for r in rows}
    got = search.search(asked, e.repartition(5), 7, row_key="vec_id")
    for q in {r.query for r in got.collect()}:
        s = np.round(m @ m[ids.index(q)], 9)
        want = sorted(range(len(ids)), key=lambda i: (-s[i], ids[i]))[:7]
        assert [r.vec_id for r in got.filter(F.col("query") == q).orderBy("rank").collect()] == [ids[i] for i in want]
    best = search.search(asked, e.repartition(3), 4, row_key="vec_id", group="label").orderBy("query", "rank").collect()
    for q in {r.query for r in best}:
        s = np.round(m @ m[ids.index(q)], 9)
        top = {}
        for i in sorted(range(len(ids)), key=lambda i: (-s[i], ids[i])):
            top.setdefault(label[ids[i]], ids[i])
        assert [r.vec_id for r in best if r.query == q] == list(top.values())[:4]
    # many queries meet the rows in blocks, with the same results
    key = lambda df: sorted(tuple(r) for r in df.collect())
    assert key(search.search(asked, e, 7, row_key="vec_id", broadcast_bytes=900)) == key(got)
    assert key(search.search(asked, e, 4, row_key="vec_id", group="label", broadcast_bytes=900)) == sorted(tuple(r) for r in best)
    assert search.search(asked, e.limit(0), 3, row_key="vec_id", broadcast_bytes=1).count() == 0
    assert search.index_recall(got.withColumnRenamed("vec_id", "id"), got.withColumnRenamed("vec_id", "id")).first().recall == 1
    assert search.overfetched(asked, e, 3, "label", row_key="vec_id").groupBy("query").count().filter("count > 3").count() == 0
    assert search.search(asked.limit(0), e, 3, row_key="vec_id").count() == 0
    assert search.search(asked, e.limit(0), 3, row_key="vec_id").count() == 0
    nulls = e.select("vec_id", F.when(F.col("vec_id") > 3, F.col("embedding")).alias("embedding"))
    assert search.search(asked, nulls, 3, row_key="vec_id").filter("vec_id <= 3").count() == 0


TESTS = "test_id string, sorgu_tipi string, kaynak string, karar_id string, ek_dogru_kararlar string, kanit string"


def test_evaluation(spark):
    tests = spark.createDataFrame([("T1", "a", "s", "d1", "", "kanıt cümlesi"), ("T2", "a", "s", "d9", "d3;;d4", ""), ("T3", "b", "s", "d8", None, None), ("T4", "b", "s", "d7", None, "yok")], TESTS)
    ranked = spark.createDataFrame(
        [("T1", 1, "d2", 0.9, "x", 3), ("T1", 2, "d1", 0.8, "bir kanıt \n cümlesi", 4), ("T2", 1, "d4", 0.9, "y", 5), ("T3", 1, "d5", 0.7, "z", 6)],
        "test_id string, rank int, decision_id string, score double, text string, tokens int",
    )
    judged = spark.createDataFrame([("d1", "d2", "kardes"), ("d8", "d5", "kanun"), ("d9", "d4", "kanun")], "target string, candidate string, neden string")
    got = {r.test_id: r for r in evaluate.per_query(ranked, tests, judged).collect()}
    assert (got["T1"].sira, got["T1"].sira_genis, got["T1"].genis_neden, got["T1"].kanit_ilk5, got["T1"].okunan_token_ilk5) == (2, 1, "kardes", True, 7)
    assert got["T1"].sonuc_1 == "[KARDEŞ] [0.900] d2" and got["T1"].sonuc_3 == ""
    assert (got["T2"].sira, got["T2"].genis_neden, got["T2"].kanit_ilk5) == (1, "hedef", True)
    assert (got["T3"].sira, got["T3"].sira_genis, got["T3"].kanit_ilk5) == (None, 1, False) and got["T4"].sira_genis is None
    s = evaluate.summary(evaluate.per_query(ranked, tests, judged)).first()
    assert (s.sorgu, s.ilk1, s.ilk5, s.mrr, s.ilk1_genis, s.mrr_genis) == (4, 25, 50, 0.375, 75, 0.75)
    wide = evaluate.wide_summary(evaluate.per_query(ranked, tests, judged), "sira").first()
    assert wide.ilk1 <= wide.ilk5 <= wide.ilk10 <= wide.ilk100
    cand = ranked.withColumnRenamed("rank", "sira_once")
    same = {r.test_id: r for r in evaluate.rerank_measure(evaluate.identity_scores(cand), tests, judged).collect()}
    assert all(r.sira_once == r.sira_sonra and r.sira_genis_once == r.sira_genis_sonra for r in same.values()) and same["T1"].hedef_puan == -2
    up = evaluate.rerank_measure(cand.withColumn("puan", F.col("sira_once").cast("double")), tests, judged)
    assert {r.test_id: r.sira_sonra for r in up.collect()}["T1"] == 1
    pieces = evaluate.text_pieces(spark.createDataFrame([(1, "a b c d e"), (2, None), (3, "")], "k int, t string"), "t", F.lit(130)).orderBy("k", "parca").collect()
    assert [(r.k, r.piece) for r in pieces] == [(1, "a b"), (1, "c d"), (1, "e"), (2, None), (3, "")]


def test_best_keeps_equals_and_prunes():
    """Rows come in any order, with equals of the k-th best; what is left after pruning holds the best."""
    import pyarrow as pa

    r = np.random.default_rng(2)
    rows = np.round(r.normal(size=(400, 3)), 1)
    asked = np.round(r.normal(size=(5, 3)), 1)
    for grouped in (False, True):
        best = search.Best(pa.array(range(5)), asked, 6, grouped)
        for at in range(0, 400, 30):
            part = rows[at : at + 30]
            ids = list(range(at, at + len(part)))
            best.show(part, pa.RecordBatch.from_arrays([pa.array(ids)], ["id"]), [f"g{i % 17}" for i in ids] if grouped else None)
            if at % 90 == 0:
                best.prune()
        got = best.result(["q", "score", "id"]).to_pylist()
        for q in range(5):
            score = np.round(rows @ asked[q], 9)
            order = sorted(range(400), key=lambda i: (-score[i], i))
            top = {}
            for i in order:
                top.setdefault(f"g{i % 17}" if grouped else i, i)
            assert set(list(top.values())[:6]) <= {x["id"] for x in got if x["q"] == q}
        assert len(got) < 5 * 40


def test_whole_text_scores(spark):
    """The best piece of a whole text counts, and room beside a long query is smaller."""
    far = " ".join(["dolgu"] * 300) + " kira bedeli tespiti"
    cand = spark.createDataFrame([("T", 1, "uzun", "kira bedeli", far), ("T", 2, "kısa", "kira bedeli", "kira"), ("T", 3, "yok", "kira bedeli", None)], "test_id string, sira_once int, decision_id string, sorgu string, text string")
    got = {r.decision_id: r.puan for r in evaluate.whole_text_scores(cand, 200).collect()}
    assert got == {"uzun": 1.0, "kısa": 0.5, "yok": 0.0}


def test_reranking_judges_all_candidates(spark, tmp_path):
    words = " ".join(f"k{i}" for i in range(40))
    decisions = [("hedef", words + " TCK 141"), ("kopya", words + " TCK 142"), ("madde", "başka bir metin TCK 141"), ("uzak", "ilgisiz")] + [(f"x{i}", f"metin {i}") for i in range(200)]
    spark.createDataFrame(decisions, "id string, text string").write.parquet(f"{tmp_path}/kararlar.parquet")
    # the target's chunk has nothing of the queries, so that others come before it
    chunks = [("hedef", "zzz"), ("kopya", "kira bedeli tespiti"), ("madde", "tapu iptali tescil"), ("uzak", "kira tapu")]
    spark.createDataFrame([(d, 0, "", "", t, 3) for d, t in chunks], "decision_id string, chunk_index int, header string, bolum string, text string, tokens int").write.parquet(f"{tmp_path}/chunks.parquet")
    tests = [("T1", "a", "s", "hedef", "", "", "kira bedeli tespiti"), ("T2", "a", "s", "hedef", "", "", "tapu iptali tescil"), ("T3", "a", "s", "x1", "", "", "kira")]
    spark.createDataFrame(tests, TESTS + ", sorgu string").write.parquet(f"{tmp_path}/test_set.parquet")
    got = {r.test_id: r for r in catalog.queries()["rerank_before_after"](spark, str(tmp_path)).collect()}
    assert [(got[t].sira_genis_once, got[t].sira_genis_sonra, got[t].genis_neden_sonra) for t in ("T1", "T2", "T3")] == [(1, 1, "kardes"), (1, 1, "kanun"), (None, None, None)]
    assert got["T1"].sira_sonra > 1 and got["T2"].sira_sonra > 1 and got["T3"].sira_sonra is None


def test_wide_summary_reaches_a_hundred(spark, tmp_path):
    words = " ".join(f"k{i}" for i in range(40))
    decisions = [("hedef", "kısa metin"), ("kopya", words), ("yok", words)] + [(f"x{i}", f"metin {i}") for i in range(20)]
    spark.createDataFrame(decisions, "id string, text string").write.parquet(f"{tmp_path}/kararlar.parquet")
    chunks = [("hedef", "zzz"), ("kopya", "zzz")] + [(f"x{i}", "kira bedeli tespiti") for i in range(20)]
    spark.createDataFrame([(d, 0, "", "", t, 3) for d, t in chunks], "decision_id string, chunk_index int, header string, bolum string, text string, tokens int").write.parquet(f"{tmp_path}/chunks.parquet")
    tests = [("T1", "a", "s", "hedef", "", "", "kira bedeli tespiti"), ("T2", "a", "s", "yok", "", "", "kira bedeli tespiti")]
    spark.createDataFrame(tests, TESTS + ", sorgu string").write.parquet(f"{tmp_path}/test_set.parquet")
    got = catalog.queries()["evaluation_wide_summary"](spark, str(tmp_path)).first()
    # the target comes 21st, the near copy of the other query's target 22nd
    assert (got.sorgu, got.ilk1, got.ilk10, got.ilk20, got.ilk50, got.ilk100, got.mrr) == (2, 0, 0, 0, 100, 100, round((1 / 21 + 1 / 22) / 2, 6))


def test_ranking(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, "a", 7), (3, "b", None), (4, None, 1)], "id int, k string, v int")
    assert {r.k: r.id for r in ranking.keep_first(df, ["k"], [F.col("v").desc_nulls_last(), "id"]).collect()} == {"a": 2, "b": 3, None: 4}
    assert [r.after for r in ranking.running_flag(df, F.col("k") == "b", "id").orderBy("id").collect()] == [False, False, True, True]
    assert ranking.running_flag(df, F.lit(False), "id").filter("after").count() == 0
    assert {(r.k, r.n) for r in ranking.value_counts(df, "k").collect()} == {("a", 2), ("b", 1), (None, 1)}
    assert ranking.groups_beyond_one(df, "k").first().n == 1 and ranking.groups_beyond_one(df.limit(0), "k").first().n == 0
    assert ranking.between_or_all(df.filter("k is not null"), "v", 6, 8, "k").count() == 2
    assert ranking.stacked(df, ["id"], {"k": "K"}, "ad", "deger").count() == 3
    assert ranking.unite(df, df.select("id")).count() == 8


def test_experiments(spark, sf):
    assert len(experiments.grid(2000, 8192)) == 18 and len(experiments.grid(10000, 8192)) == 5 and len(experiments.grid(10000, 512)) == 4
    assert experiments.grid(10000, 512)[0] == ("per_decision", 512, 0) and experiments.run_name("sentence", 512, 64) == "sentence_c512_o64"
    assert experiments.clean_grid(512, 10000) == [("per_decision", 512, 0), ("recursive", 512, 64)] and experiments.variant(False, True) == "temiz_tam_kunye"
    log = table(spark, sf, "experiments")
    assert experiments.sectioned(log).filter("tarih like '#%'").count() == 0
    best = experiments.best_of(experiments.report_table(experiments.once(log)), ["havuz"], ["ilk5", "ilk1"])
    assert best.groupBy("havuz").count().filter("count > 3").count() == 0
    assert experiments.run_all(spark, {"a": lambda s: None, "b": lambda s: 1 / 0})["b"].startswith("ZeroDivisionError")
    done = spark.createDataFrame([("x",)], "deneme string")
    assert experiments.pending(spark.createDataFrame([("x",), ("y",)], "deneme string"), done).count() == 1
    runs = spark.createDataFrame([("T", 1, 1, "a", 0.5, True), ("T", 1, 2, "b", 0.4, False), ("T", 2, 1, "b", 0.6, False), ("T", 2, 2, "a", 0.4, True)], "test_id string, tekrar int, rank int, decision_id string, score double, hedef boolean")
    r = experiments.repeatability(runs).first()
    assert (r.tekrar, r.farkli_liste, r.ilk5_bulundu) == (2, 2, 2) and math.isclose(r.skor_araligi, 0.1)
    tasks = experiments.per_task(spark.createDataFrame([("d", "x", 1), ("d", "x", None), ("d", "x", 7)], "deneme string, sorgu_tipi string, sira int"), "sira").first()
    assert (tasks.ilk1, tasks.ilk5, tasks.ilk10) == (33.3, 33.3, 66.7)
    one = spark.createDataFrame([("d", 50.0)], "deneme string, ilk5 double")
    assert experiments.mismatches(one, one).count() == 0


def test_test_set(spark, sf):
    k = table(spark, sf, "kararlar")
    row = k.filter("esas_no is not null and length(text) > 50").select(sampling.source_key(F.col("source")).alias("s"), "esas_no", "text", "id").first()
    items = spark.createDataFrame([("T01", row.s, row.esas_no, "soru bir", "soru iki", None, "dilekçe", row.text[:40]), ("T02", row.s, "yok/1", "x", "y", "z", "w", "q")], "item_id string, kaynak string, esas string, H string, A string, F string, D string, kanit string")
    matched = {r.item_id: r for r in testset.matched_items(items, k).collect()}
    assert matched["T01"].eslesme >= 1 and matched["T02"].eslesme == 0 and matched["T02"].karar_id is None
    long = testset.long_form(testset.matched_items(items, k), "v2")
    assert {r.test_id for r in long.collect()} == {"T01-H", "T01-A", "T02-H", "T02-A", "T02-F"}
    assert {r.test_id: r.kusur for r in testset.defects(long, k).collect()}["T02-H"] == "hedef_yok"


def test_io(spark, sf, tmp_path):
    df = spark.createDataFrame([("a", 'x "y"\nz, ş', None), ("b", "", "7")], "k string, t string, n string")
    io.write_csv(df, f"{tmp_path}/c")
    got = {r.k: r for r in io.read_csv(spark, f"{tmp_path}/c").collect()}
    assert got["a"].t == 'x "y"\nz, ş' and got["a"].n == "" and got["b"].n == "7"
    (tmp_path / "bom.csv").write_bytes("﻿a,b\n1,\n".encode())
    assert io.read_csv(spark, f"{tmp_path}/bom.csv", "a int").first().asDict() == {"a": 1, "b": ""}
    (tmp_path / "T01.txt").write_text("  iki\nsatır \n", encoding="utf-8")
    assert io.read_texts(spark, f"{tmp_path}/T01.txt").first().asDict() == {"ad": "T01", "metin": "iki\nsatır"}
    store = io.VectorStore(spark, f"{tmp_path}/v")
    try:
        store.read()
        raise AssertionError
    except FileNotFoundError:
        pass
    assert store.replace(df) == 2 and store.replace(df.limit(1)) == 1
    blocks = io.block_statistics(spark, f"{sf}/kararlar.parquet", "karar_tarihi").collect()
    assert sum(r.satir for r in blocks) == table(spark, sf, "kararlar").count()
    io.write_json(df, f"{tmp_path}/j")
    assert io.read_json(spark, f"{tmp_path}/j", "k string, n string").count() == 2
    assert "%5.0" in io.before_after_report(spark.createDataFrame([("a", 2000, "x", "y", 5.0)], "id string, year int, once string, sonra string, yuzde double"), "özet")


def test_streaming(spark, sf, tmp_path):
    k = table(spark, sf, "kararlar")
    k.repartition(2).write.parquet(f"{tmp_path}/in")
    incremental.replay(spark, f"{tmp_path}/in", k.schema.simpleString()[7:-1].replace(":", " "), lambda s: incremental.index_decisions(s, f"{tmp_path}/out", f"{tmp_path}/cp"))
    first = spark.read.parquet(f"{tmp_path}/out/parti=0")
    n = first.select("decision_id").distinct().count()
    k.limit(20).write.mode("append").parquet(f"{tmp_path}/in")
    incremental.replay(spark, f"{tmp_path}/in", k.schema.simpleString()[7:-1].replace(":", " "), lambda s: incremental.index_decisions(s, f"{tmp_path}/out", f"{tmp_path}/cp"))
    assert spark.read.parquet(f"{tmp_path}/out/parti=1").count() == 0 and n > 100
    e = table(spark, sf, "events")
    assert incremental.windowed_counts(e, "ts", ["event_type"], value="value").agg(F.sum("n")).first()[0] == e.count()


def test_everything_imports_without_training():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert set(entry.oracle_sql()) <= names and len(names) > 60
