import random


import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as hs
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from terazi.llm import encoding as en
from terazi.llm import garbled as ga
from terazi.llm import packing as pk
from terazi.llm import token_budget as tb
from terazi.session import table, tokenizer_dir


@pytest.fixture(scope="module")
def mine():
    return en.Encoder(en.vocabulary_path())


@pytest.fixture(scope="module")
def theirs():
    t = Tokenizer.from_file(f"{tokenizer_dir()}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


ALPHABET = "ab 'stmdrvelS\n\t 1२.,!ığ漢éกำ\x1c\x85😀<|endoftext|>"


@settings(max_examples=400, deadline=None)
@given(hs.lists(hs.text(alphabet=ALPHABET, max_size=40), min_size=1, max_size=4))
def test_encoding_equals_public(mine, theirs, texts):
    ids, sizes = mine.encode(texts)
    ends = np.cumsum(sizes)
    for text, a, b in zip(texts, ends - sizes, ends):
        assert ids[a:b].tolist() == theirs(text)
        assert mine.decode(ids[a:b]) == text


@settings(max_examples=150, deadline=None)
@given(hs.text(max_size=60))
def test_encoding_any_text(mine, theirs, text):
    assert mine.encode_one(text) == theirs(text)


def test_encoding_long(mine, theirs):
    long = "çok uzun " * 20_000 + "x" * 3000 + "漢字" * 2000
    assert mine.encode_one(long) == theirs(long)


def test_encode_table(spark, sf, theirs):
    docs = table(spark, sf, "documents")
    got = {r.doc_id: r.ids for r in en.encode_table(docs).collect()}
    for r in docs.collect():
        assert got[r.doc_id] == (theirs(r.text) if r.text else [])
    odd = spark.createDataFrame([(1, None, "k"), (2, "", "k"), (2, "a", "k")], "doc_id long, text string, ids string")
    assert sorted((r.doc_id, r.ids) for r in en.encode_table(odd).collect()) == [(1, []), (2, []), (2, [64])]
    assert en.encode_table(odd.limit(0)).count() == 0
    back = {r.doc_id: r.text for r in en.decode_table(en.encode_table(docs)).collect()}
    assert all(back[r.doc_id] == (r.text or "") for r in docs.collect())


@settings(max_examples=40, deadline=None)
@given(hs.text(alphabet="ab 'sığ1.\n", max_size=200))
def test_independent_pieces(spark, mine, text):
    row = spark.createDataFrame([(text,)], "t string").select(tb.independent_pieces(F.col("t"), 20).alias("p")).first()
    assert "".join(row.p) == text
    assert mine.encode(list(row.p), True)[1].sum() == len(mine.encode_one(text))


def test_pieces_of_every_script(spark, mine):
    """Oversized texts without blanks between words are cut, too, and counts of the pieces add up."""
    texts = ["原告は見ていない。鑑定書を争わない、" * 40, "abc,def;" * 80, "ตามมาตรา๗๒วรรคสอง" * 40, "x=1;y2=3'4;it's" * 50, "डॉ.सरवेकरनेकहा" * 40, "a-b_c'd" * 60, "漢字" * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    for i, pieces in df.select("i", tb.independent_pieces(F.col("text"), 50).alias("p")).collect():
        assert "".join(pieces) == texts[i] and mine.encode(pieces, counts_only=True)[1].sum() == len(mine.encode_one(texts[i]))
        assert (len(pieces) > 3) == (i != 6), texts[i][:20]  # the last is a single run of letters


def test_token_totals_planted(spark, mine):
    """Totals by source, language and domain add up to what each document and decision is known to hold."""
    texts = {1: "Bu bir deneme metnidir.", 2: "This is a test.", 3: "原告は見ていない。" * 4000, 4: None}
    docs = spark.createDataFrame([(1, texts[1], "TUR", "A", None), (2, texts[2], "en-GB", "b", "haber"), (3, texts[3], "ja", "b", None), (4, None, None, "b", None)], "doc_id long, text string, lang string, source string, domain string")
    chunks = spark.createDataFrame([("k", i, "karar", "x" * 400, 100) for i in range(9)] + [("k", 0, "karar", "x" * 400, 100), ("m", 0, "karar", "x" * 400, None)], "decision_id string, chunk_index int, source string, text string, tokens int")
    sources = spark.createDataFrame([("a", "A", None, None), ("b", "B", None, None), ("karar", "K", "tr", "hukuk")], "source string, etiket string, lang string, domain string")
    known = {i: len(mine.encode_one(t)) for i, t in texts.items()}
    want = {("a", "tr", None): (1, known[1]), ("b", "en", "haber"): (1, known[2]), ("b", "ja", None): (1, known[3]), ("b", None, None): (1, 0), ("karar", "tr", "hukuk"): (2, 1000)}
    rows = tb.token_totals(chunks, docs, sources).collect()
    assert {(r.source, r.lang, r.domain): (r["items"], r.tokens) for r in rows if r.level == 0} == want
    (total,) = [r for r in rows if r.level == 7]
    assert (total["items"], total.tokens) == (6, sum(t for _, t in want.values()))
    assert {(r.source, r.tokens) for r in rows if r.level == 3} == {("a", known[1]), ("b", known[2] + known[3]), ("karar", 1000)}


def test_token_budget(spark, mine):
    docs = spark.createDataFrame(
        [(1, "bir iki " * 9000, "tr-TR", "kaynak", None, 5), (2, None, None, "kaynak", "d", 5), (3, "", "und", None, "d", 5), (4, "a b", "tur", "KAYNAK", "d", 5)], "doc_id long, text string, lang string, source string, domain string, tokens int"
    )
    chunks = spark.createDataFrame(
        [("k", 0, "yargitay", "x" * 400, 100), ("k", 0, "yargitay", "x" * 400, 100), ("k", 1, None, "x" * 400, None), ("k", 2, "yargitay", "x" * 400, 8192), ("m", 0, "yargitay", "x" * 40, 10), ("m", 1, "emsal", None, 0), (None, 0, "emsal", "x", 1)],
        "decision_id string, chunk_index int, source string, text string, tokens int",
    )
    sources = spark.createDataFrame([("yargitay", "Y", "tr", "hukuk"), ("kaynak", "K", None, "genel")], "source string, etiket string, lang string, domain string")
    got = {(r.kind, r.id): r for r in tb.token_counts(chunks, docs, sources).collect()}
    assert got["belge", "1"].tokens == len(mine.encode_one("bir iki " * 9000)) and got["belge", "2"].tokens == 0 and got["belge", "3"].tokens == 0
    assert got["karar", "k"].tokens == 300 and got["karar", "m"].tokens == 10 and ("karar", None) not in got
    assert (got["belge", "1"].lang, got["belge", "1"].domain, got["belge", "4"].source, got["belge", "4"].lang) == ("tr", "genel", "kaynak", "tr") and got["karar", "k"].domain == "hukuk"
    total = tb.token_totals(chunks, docs, sources).filter("level = 7").first()
    assert total.tokens == sum(r.tokens for r in got.values()) and total.items == 6
    assert tb.token_counts(chunks.limit(0), docs.limit(0), sources).count() == 0
    assert {r.decision_id: r.estimated for r in tb.decision_tokens(chunks).collect()} == {"k": 2, "m": 1}


def check_packing(rows, capacities):
    used = {}
    for r in rows:
        cap = capacities[r.model]
        if r.tokens == 0:
            assert r.konteyner is None
        else:
            used[r.model, r.konteyner] = used.get((r.model, r.konteyner), 0) + r.tokens
            assert used[r.model, r.konteyner] <= cap
    return used


def test_packing(spark):
    r = random.Random(5)
    items = [(i, r.choice([r.randint(1, 400), 100, 2500])) for i in range(3000)] + [(9000, 0), (9001, None), (3, 7)]
    caps = {"a": 1000, "b": 64, "c": 0}
    rows = pk.pack(spark.createDataFrame(items, "doc_id long, tokens long"), caps).collect()
    used = check_packing(rows, caps)
    for m in ("a", "b"):
        mine = [x for x in rows if x.model == m]
        assert sum(x.tokens for x in mine) == sum(t or 0 for _, t in items)
        full = sum(used[k] for k in used if k[0] == m) / (caps[m] * len([k for k in used if k[0] == m]))
        assert full > 0.95
        split = {x.doc_id for x in mine if x.parca_no > 0}
        assert split == {d for d, t in items if (t or 0) > caps[m]}
        assert {k for mm, k in used if mm == m} == set(range(len([k for k in used if k[0] == m])))
    assert pk.pack(spark.createDataFrame([], "doc_id long, tokens long"), caps).count() == 0
    assert pk.pack(spark.createDataFrame(items, "doc_id long, tokens long"), {}).count() == 0


def test_packing_ways(spark):
    """Offsets that are joined place items as those that are broadcast; every place is taken once; few containers are used."""
    r = random.Random(8)
    items = spark.createDataFrame([(i, r.randint(1, 300)) for i in range(4000)], "doc_id long, tokens long").repartition(7)
    caps = {"a": 512, "b": 700}
    one = sorted(tuple(x) for x in pk.pack(items, caps).collect())
    check_packing(pk.pack(items, caps).collect(), caps)
    other = pk.pack(items, caps, broadcast_rows=0).collect()
    used = check_packing(other, caps)
    assert len(other) == len(one) == 8000
    for m, cap in caps.items():
        bound = -(-sum(x[4] for x in one if x[0] == m) // cap)
        assert len([k for k in used if k[0] == m]) <= 1.02 * bound + 1
    docs, models = items.select("doc_id"), spark.createDataFrame(list(caps.items()), "model string, max_tokens int")
    assert sorted(tuple(x) for x in pk.invariants(pk.pack(items, caps), docs, models).collect()) == [("a", 4000, 0, 0, 0), ("b", 4000, 0, 0, 0)]
    broken = spark.createDataFrame([("a", 1, 0, 0, 300, 0), ("a", 2, 0, 0, 300, 0), ("a", 3, 0, 0, 200, 1), ("a", 3, 1, 200, 100, 1), ("a", 4, 0, 5, 7, 2)], "model string, doc_id long, parca_no int, baslangic long, tokens long, konteyner long")
    assert [tuple(x) for x in pk.invariants(broken, docs, models.limit(1)).collect()] == [("a", 4, 1, 1, 1)]


def test_combinations_leave_nothing_out():
    """All exact pairs and triples of lengths are there, and where nothing fills the window, the fullest ones."""
    import itertools

    sizes = [3, 5, 8, 9, 14, 20]
    made = {tuple(sorted((int(k), int(m)) for k, m in row.reshape(3, 2) if m)) for row in pk.combinations(np.array(sizes), 28)}
    for k in (2, 3):
        for combo in itertools.combinations_with_replacement(sizes, k):
            if sum(combo) == 28:
                assert tuple(sorted((x, combo.count(x)) for x in set(combo))) in made
    loose = pk.combinations(np.array([180, 200, 259]), 512, exact=False)
    assert len(pk.combinations(np.array([180, 200, 259]), 512)) == 0 and {sum(int(k) * int(m) for k, m in row.reshape(3, 2)) for row in loose} >= {459}
    fewer = sum(t for _, t in pk.plan({180: 100, 332: 100, 250: 10}, 512))
    assert fewer == 105


@settings(max_examples=60, deadline=None)
@given(hs.dictionaries(hs.integers(1, 40), hs.integers(0, 30), max_size=12))
def test_plan_places_all(histogram):
    placed = {}
    for combo, times in pk.plan(histogram, 40):
        assert sum(k * m for k, m in combo.items()) <= 40 and times > 0
        for k, m in combo.items():
            placed[k] = placed.get(k, 0) + m * times
    assert placed == {k: v for k, v in histogram.items() if v}


def test_packing_documents(spark, sf):
    m = table(spark, sf, "modeller")
    rows = pk.pack_documents(table(spark, sf, "documents"), m).collect()
    check_packing(rows, {r.model: r.max_tokens for r in m.collect()})
    assert all(r.doluluk > 0.9 for r in pk.fill_report(pk.pack_documents(table(spark, sf, "documents"), m), m).collect())


NOTES = "satir_no long, `not` string, garbled string, piece string"


def test_garbled(spark):
    clean = ["künye çıkarıldı, ölçüm – değişti", "Þingvellir, nový, SÃO, ð harfi, 5º 63 °C", "hedef bulundu mu?sonra bakılacak", "duzeltildi yazimlar", None, "", "   "]
    clean += ["künye çıkarıldı, ölçüm – değişti (ş. 5)"] * 3
    bad = {
        100: clean[0].encode().decode("cp1252", "replace"), 101: clean[0].encode("cp1254").decode("latin-1"), 102: clean[0].encode("ascii", "replace").decode(),
        103: "künye çıkarıldı, " + "ölçüm".encode().decode("mac-roman"), 104: "çıkarıld".encode("cp857").decode("cp850") + "ı",
        105: "künye".encode().decode("latin-1").encode().decode("latin-1"), 106: "de�işti", 107: "künye (" + "ş".encode().decode("latin-1") + ". 5)",
    }
    rows = [(i, t, "x", "y") for i, t in enumerate(clean)] + [(k, v, None, None) for k, v in bad.items()] + [(None, "kÃ¼nye", None, None)]
    df = spark.createDataFrame(rows, NOTES)
    assert {r.satir_no for r in ga.found(df).collect()} == set(bad)
    fixed = {r.satir_no: r for r in ga.restore(df).collect()}
    assert len(fixed) == len(rows) - 1
    assert all(fixed[i].restored == t and fixed[i].fixed == 0 for i, t in enumerate(clean))
    assert fixed[101].restored == clean[0] and fixed[103].restored == "künye çıkarıldı, ölçüm" and fixed[104].restored == "çıkarıldı" and fixed[105].restored == "künye" and fixed[107].restored == "künye (ş. 5)"
    assert fixed[106].restored == "değişti"
    assert ga.found(df.limit(0)).count() == 0 and ga.restore(df.limit(0)).count() == 0


def test_garbled_lost_words(spark):
    """A word with a mark of loss is damaged by the join even if the corpus has no original; of equals the first by bytes wins."""
    df = spark.createDataFrame([(1, "ilk çıktı"), (2, "qx�zw son"), (3, "temiz"), (4, "şal"), (5, "çal"), (6, "?al bitti")], "satir_no long, `not` string")
    fixes = {r.garbled: r for r in ga.corrections(ga._pieces(df, "not").select("word")).collect()}
    assert fixes["qx�zw"].original is None and fixes["qx�zw"].ambiguous
    assert fixes["?al"].original == "çal" and fixes["?al"].ambiguous
    assert {r.satir_no for r in ga.found(df).collect()} == {2, 6}
    got = {r.satir_no: r for r in ga.restore(df).collect()}
    assert (got[2].restored, got[2].lost) == ("qx�zw son", 1) and got[6].restored == "?al bitti"


def test_garbled_forms():
    assert {"Ã¼n", "�n", "?n"} <= ga.garbled_forms("ün") and "ün" not in ga.garbled_forms("ün") and not ga.garbled_forms("abc")
    assert "ağÄ±r" in ga.garbled_forms("ağır") and "aÄŸır" in ga.garbled_forms("ağır")
