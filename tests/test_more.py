import pytest
from pyspark.sql import functions as F

from terazi import session
from terazi.operators import chunking, experiments, relevance
from terazi.sources import io
from terazi.streaming import incremental


def test_near_copies(spark):
    words = " ".join(f"k{i}" for i in range(40))
    rows = [("hedef", words, "x"), ("hedef", words, "x"), ("kopya", words + " son", "x"), ("uzak", "bir iki üç dört beş altı", "x"), ("boş", "", None), ("yok", None, None), (None, words, None)]
    df = spark.createDataFrame(rows, "id string, text string, target string")
    asked = spark.createDataFrame([("hedef",), ("hedef",), ("fremd",), (None,)], "target string")
    got = relevance.near_copies(asked, df).collect()
    assert [(r.target, r.candidate, r.text_share) for r in got] == [("hedef", "kopya", 1.0)]
    assert relevance.near_copies(asked, df.limit(0)).count() == 0 and relevance.near_copies(asked.limit(0), df).count() == 0


def test_row_groups(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    (tmp_path / "t").mkdir()
    pq.write_table(pa.table({"id": [f"a{i}" for i in range(10)], "n": list(range(10)), "boş": pa.array([None] * 10, pa.string())}), tmp_path / "t" / "x.parquet", row_group_size=4)
    path = f"file://{tmp_path}/t"
    groups = io.row_groups(spark, path, "id").orderBy("grup")
    assert [(r.grup, r.satir, r.en_buyuk) for r in groups.collect()] == [(0, 4, "a3"), (1, 4, "a7"), (2, 2, "a9")]
    assert {r.en_buyuk for r in io.row_groups(spark, path, "boş").collect()} == {""}
    got = io.read_row_groups(groups.filter("grup = 1"), ["n"], "n long").collect()
    assert sorted(r.n for r in got) == [4, 5, 6, 7]


def test_files(spark, tmp_path):
    rows = spark.createDataFrame([("ı;ş", 'a "b"\nc', None), ("2", "", "x")], "ad string, metin string, uc string")
    io.write_csv(rows.coalesce(1), f"file://{tmp_path}/c")
    (part,) = list((tmp_path / "c").glob("*.csv"))
    assert part.read_bytes().startswith("﻿".encode())
    assert sorted(tuple(r) for r in io.read_csv(spark, f"file://{tmp_path}/c").collect()) == [("2", "", "x"), ("ı;ş", 'a "b"\nc', "")]
    io.write_texts(rows.select(F.lit("bir").alias("ad"), F.lit(" x ğ \n").alias("metin")).limit(1), f"file://{tmp_path}/t")
    assert [tuple(r) for r in io.read_texts(spark, f"file://{tmp_path}/t").collect()] == [("bir", "x ğ")]


def test_log_helpers(spark):
    log = spark.createDataFrame([(1, "2024", "x"), (2, "# eski", None)], "satir_no long, tarih string, deneme string")
    once = experiments.with_separator(log, "yeni")
    assert sorted(tuple(r) for r in experiments.with_separator(once, "yeni").collect()) == [(1, "2024", "x"), (2, "# eski", None), (3, "# yeni", None)]
    assert [r.satir_no for r in experiments.with_separator(log.limit(0), "a").collect()] == [1]
    tests = spark.createDataFrame([("v1-a-H",), ("v2-a-H",), (None,)], "test_id string")
    assert [r.test_id for r in experiments.of_version(tests, "v2").collect()] == ["v2-a-H"]
    runs = spark.createDataFrame([("T", 0, 1, True), ("T", 0, 2, False), ("T", 1, 3, True), ("T", 2, 1, False)], "test_id string, tekrar int, rank int, hedef boolean")
    assert {(r.sira, r.n) for r in experiments.rank_histogram(runs).collect()} == {(1, 1), (3, 1), (None, 1)}


def test_plain_paragraphs(spark):
    texts = ["a  b\n\n \n c\td\ne\n\n\n", "", " \n\n ", "tek", "\n\nx"]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", chunking.plain_paragraphs(F.col("t")).alias("p")).collect()
    assert all(r.p == chunking.text_paragraphs(texts[r.i], "emsal") for r in got)


def test_session(spark, monkeypatch):
    small, large = spark.range(5), spark.range(2_000_000)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan(small.join(session.broadcast_small(small), "id"))
    monkeypatch.setattr(session, "SMALL_ROWS", 1000)
    assert "broadcast" not in plan(small.join(session.broadcast_small(large, most=10), "id"))

    class Cluster:
        conf = type("conf", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = type("sc", (), {"master": "spark://x:7077"})

    with pytest.raises(ValueError):
        session.shared_dir(Cluster)


def test_index_stream_run_again(spark, tmp_path):
    """A second run of the stream indexes what is new, once, whatever came before."""
    rows = lambda names: spark.createDataFrame([(n, "emsal", None, None, None, None, 2000, f"metin {n}") for n in names], "id string, source string, court string, esas_no string, karar_no string, karar_tarihi string, year int, text string")
    first, more = rows(["a", "b"]), rows(["b", "c"])
    io.write_table(first, f"file://{tmp_path}/in/1")
    start = lambda: incremental.drain(incremental.index_decisions(spark.readStream.schema(first.schema).parquet(f"file://{tmp_path}/in/*"), f"file://{tmp_path}/index", f"file://{tmp_path}/check", "fixed_tokens", 64))
    start()
    io.write_table(more, f"file://{tmp_path}/in/2")
    start()
    assert sorted((r.decision_id, r.parti) for r in incremental.indexed(spark, f"file://{tmp_path}/index").collect()) == [("a", 0), ("b", 0), ("c", 1)]


def test_public_tokenizer(spark):
    tok = chunking.PublicTokenizer()
    text = "Davacı 12 gün bekledi; ğüş 漢字."
    spans = tok.spans(text)
    # a character may be several tokens; together they cover all that isn't white space
    assert {i for a, b in spans for i in range(a, b)} >= {i for i, c in enumerate(text) if not c.isspace()} and tok.decoded(text) == text
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    assert sorted((r.doc_id, r.parca > 0, r.kayip) for r in chunking.diagnosed(df, "doc_id", "text").collect()) == [(1, True, []), (2, False, []), (3, False, [])]
    lower = chunking.PublicTokenizer("word_bpe_49k.json")
    assert chunking.diagnosed(df, "doc_id", "text", lower).filter("doc_id = 1").first().kayip[0] == "Davacı"
    pieces = chunking.recursive("bir iki üç. " * 200, tok, 40, 0)
    assert all(len(tok.spans(c)) <= 44 for c, _ in pieces) and len(pieces) > 10
