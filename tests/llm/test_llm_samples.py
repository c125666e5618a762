import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from terazi.llm import quota_sample as q
from terazi.llm import repeated_lines as rl
from terazi.llm import stable_sample as st
from terazi.session import table

ROWS = "id string, source string, court string, text string, key string, seen int, line_no int"
TARGETS = "hedef_id int, source string, court string, hedef_binde int, en_az int, edge int"


def decisions(spark, n=400):
    rows = [(f"k{i}", ("yargitay", " YARGITAY")[i % 2], ("1. Daire", "01.DAİRE", None)[i % 3], f"metin {i}", "x", i, i) for i in range(n)]
    rows += [(f"k{i}", "yargitay", "1. Daire", f"metin {i}", "x", i, i) for i in range(2, n, 6)]  # the court is filled in later
    rows += [("m1", "emsal", "2. Daire", "a", None, None, None), (None, "emsal", "2. Daire", "b", None, None, None), ("m2", "emsal", None, None, None, None, None)]
    return spark.createDataFrame(rows, ROWS)


def test_reservoirs_merge():
    """Any split and order of the rows gives a true bottom sample, as far as the merged horizon."""
    r = random.Random(1)
    rows = [(r.randint(0, 500), f"i{j}") for j in range(300)]
    made = lambda part: q.Reservoir().add(np.array([k for k, _ in part], np.int64), pa.array([i for _, i in part], pa.string()))
    for size in (7, 50, 299):
        parts = [made(rows[at : at + size]) for at in range(0, 300, size)]
        r.shuffle(parts)
        whole = q.Reservoir()
        for p in parts:
            p.trim(20)
            whole.merge(p)
        whole.trim(10)
        assert whole.seen == 300 and sorted(zip(whole.keys.tolist(), whole.ids.to_pylist())) == sorted(x for x in rows if x[0] < whole.horizon)
        assert len(whole.keys) <= 10 < sum(k <= whole.horizon for k, _ in rows)


def test_quota_sample(spark):
    df = decisions(spark)
    targets = spark.createDataFrame([(1, "yargitay", "1. DAİRE", 500, 5, 0), (2, "emsal", "2. Daire", 100, 3, 0), (3, "yok", "yok", None, None, 0), (None, "x", "y", 1, 1, 1)], TARGETS)
    sample, report = q.quota_sample(df, targets)
    got, rep = sample.collect(), {r.hedef_id: r for r in report.collect()}
    have = {f"k{i}" for i in range(400) if i % 3 < 2 or i % 6 == 2}
    assert (rep[1]["var"], rep[1].kota, rep[1].eksik) == (len(have), 20, 0) and (rep[2]["var"], rep[2].kota, rep[2].alinan, rep[2].eksik) == (1, 4, 1, 3) and rep[3].kota == 0
    assert sorted(r.hedef_id for r in got) == [1] * 20 + [2] and {r.id for r in got if r.hedef_id == 1} <= have
    assert len({r.id for r in got}) == 21
    again = {r.id for r in q.quota_sample(df.repartition(9), targets)[0].collect()}
    assert again == {r.id for r in got}
    # partitions that keep too little are found out, and the sample stays the same
    assert {r.id for r in q.quota_sample(df.repartition(9), targets, slack=0.0)[0].collect()} == again
    assert {(r.source, r.court) for r in q.found(df, targets).collect()} == {("emsal", "2. Daire")}
    sample, report = q.quota_sample(df.limit(0), targets)
    assert sample.count() == 0 and report.agg(F.sum("var")).first()[0] == 0
    assert q.quota_sample(df, targets.limit(0))[1].count() == 0


def test_stable_sample(spark):
    ids = spark.createDataFrame([(f"k{i}", 1) for i in range(3000)] + [("k1", 2), (None, 3)], "id string, havuz int")
    member = spark.createDataFrame([(f"k{i}", 1 + i % 3) for i in range(2900)] + [("k3", 2), ("fremd", 1), (None, 1), ("k5", None)], "id string, havuz int")
    rates = ((1, 0.2), (2, 0.2), (3, 0.3))
    got = {r.id: r.havuz for r in st.stable_sample(ids, member, rates).collect()}
    assert got == {r.id: r.havuz for r in st.stable_sample(ids.repartition(7), member.repartition(3), rates).collect()}
    assert "fremd" not in got and 0.25 < len(got) / 3000 < 0.35
    # what is sampled from an earlier pool is sampled from later ones, and the numbers don't depend on what else is there
    small = {r.id for r in st.stable_sample(ids.filter("id < 'k2'"), member, rates).collect()}
    assert small == {i for i in got if i < "k2"}
    assert all(1 + int(i[1:]) % 3 <= h for i, h in got.items() if int(i[1:]) < 2900)
    with pytest.raises(ValueError):
        st.stable_sample(ids, member, ((1, 0.3), (2, 0.2)))
    assert st.stable_sample(ids.limit(0), member).count() == 0


def test_registry_keeps_numbers(spark, tmp_path):
    reg = st.Registry(spark, f"file://{tmp_path}/r")
    a, b = (spark.createDataFrame([(x,) for x in xs], "id string") for xs in (["a", "b", None, "a"], ["b", "c"]))
    reg.insert(a, 1)
    first = {r.id: r.prn for r in reg.read().collect()}
    reg.insert(b, 2)
    rows = reg.read().collect()
    assert len(rows) == 3 and {r.id: r.prn for r in rows if r.id in first} == first
    assert {r.id for r in reg.select(1.0).collect()} == {"a", "b", "c"} and reg.select(0.0).count() == 0


def test_registry_reopened(spark, tmp_path):
    """Two sessions in turn on one path: numbers stay, a replayed load adds nothing, a load that failed is written again."""
    path = f"file://{tmp_path}/r"
    frame = lambda xs: spark.createDataFrame([(x,) for x in xs], "id string")
    st.Registry(spark, path).insert(frame(["x", "y"]), 1)
    first = {tuple(r) for r in st.Registry(spark, path).read().collect()}
    assert {r[0] for r in first} == {"x", "y"}
    again = st.Registry(spark.newSession(), path)
    assert again.loads == [1] and not again.insert(frame(["z"]), 1) and {tuple(r) for r in again.read().collect()} == first
    assert again.insert(frame(["x", "q"]), 2)
    third = st.Registry(spark, path)
    assert third.loads == [1, 2] and {tuple(r) for r in third.read().collect()} > first and third.read().count() == 3
    (tmp_path / "r" / "yuk=3" / "rows").mkdir(parents=True)  # never committed
    assert st.Registry(spark, path).loads == [1, 2]
    assert third.extend(frame(["q", "n"])) == 3 and {r.id for r in st.Registry(spark, path).read().filter("yuk = 3").collect()} == {"n"}


def test_stable_sample_kept_registry(spark, tmp_path):
    path, rates = f"file://{tmp_path}/r", ((1, 0.2), (2, 0.2), (3, 0.3))
    ids = spark.createDataFrame([(f"k{i}",) for i in range(2000)], "id string")
    member = spark.createDataFrame([(f"k{i}", 1 + i % 3) for i in range(1500)], "id string, havuz int")
    before = {r.id: r.havuz for r in st.stable_sample(ids.filter("id < 'k5'"), member, rates, path=path).collect()}
    after = {r.id: r.havuz for r in st.stable_sample(ids, member, rates, path=path).collect()}
    assert before.items() <= after.items() and len(after) > len(before)
    assert after == {r.id: r.havuz for r in st.stable_sample(ids, member, rates, path=path).collect()}


def test_repeated_lines(spark):
    legal = ("Bu  Belge e-imza ile imzalanmıştır (12).", "BU BELGE E-İMZA İLE İMZALANMIŞTIR", "bu belge e imza ile imzalanmistir 7")
    rows = [(f"a{i}", ("s1", "S1 ")[i % 2], None, f"konu {'abcdefghij'[i % 10] * (i // 10 + 1)}\n\n{legal[i % 3]}\n1 2 3", None, 0, 0) for i in range(60)]
    rows += [(f"b{i}", "s2", None, f"başka {chr(97 + i % 26) * (i // 26 + 1)}\n---", None, 0, 0) for i in range(100)]
    rows += [rows[0], ("n", "s1", None, None, None, 0, 0), ("e", "s1", None, "", None, 0, 0), (None, "s1", None, legal[0], None, 0, 0)]
    df = spark.createDataFrame(rows, ROWS)
    got = sorted((r.id, r.line_no) for r in rl.found(df).collect())
    assert got == sorted((f"a{i}", 2) for i in range(60))
    clean = {r.id: r for r in rl.clean(df).collect()}
    assert clean["a0"].text == "konu a\n\n1 2 3" and clean["a0"].removed == 1 and clean["n"].text is None and clean["e"].text == "" and clean["b1"].text == "başka b\n---" and len(clean) == 162
    assert rl.found(df.limit(0)).count() == 0 and rl.clean(df.limit(0)).count() == 0
    # a line that every source repeats is excess in each
    both = df.withColumn("text", F.lit("ortak satır"))
    assert rl.found(both).select("id").distinct().count() == 162
    long = spark.createDataFrame([(f"u{i}", "s", None, "ortak\n" + f"{'a' * (i + 1)} " * 50_000, None, 0, 0) for i in range(6)], ROWS)
    assert {r.line_no for r in rl.found(long).collect()} == {0}


def test_the_ratio_decides(spark):
    """Two lines of the same share and number within their source: the one that is hardly rarer outside is no excess."""
    rows = [(f"a{i}", "s1", None, f"{'rastlanan' if i < 6 else 'başka'} satır\n{'yinelenen' if i < 6 else 'öteki'} satır", None, 0, 0) for i in range(180)]
    rows += [(f"b{i}", "s2", None, f"{'rastlanan satır' if i < 58 else 'konu'}", None, 0, 0) for i in range(2000)]
    df = spark.createDataFrame(rows, ROWS)
    tests = {r.key: r for r in rl.line_tests(df).filter("source = 's1' and df = 6").collect()}
    by_chance, repeated = sorted(tests.values(), key=lambda r: r.llr)
    assert (by_chance.df, by_chance.df_out, by_chance.n_out) == (6, 58, 2000.0) and (repeated.df, repeated.df_out) == (6, 0)
    assert by_chance.llr < 1 < 20 < repeated.llr
    assert {(r.id, r.line_no) for r in rl.found(df).filter("id < 'a9'").collect() if int(r.id[1:]) < 6} == {(f"a{i}", 1) for i in range(6)}


def test_log_likelihood(spark):
    import math

    k1, n1, k2, n2 = 6.0, 180.0, 58.0, 2000.0
    p = (k1 + k2) / (n1 + n2)
    term = lambda k, n: k * math.log(k / n / p) + (n - k) * math.log((1 - k / n) / (1 - p))
    got = spark.createDataFrame([(k1, n1, k2, n2)], "a double, b double, c double, d double").select(rl._log_likelihood(*[F.col(c) for c in "abcd"])).first()[0]
    assert abs(got - 2 * (term(k1, n1) + term(k2, n2))) < 1e-9


def test_against_tables(spark, sf):
    k = table(spark, sf, "kararlar")
    from collections import defaultdict
    import unicodedata

    def key(s):
        s = s.replace("İ", "i").replace("I", "i").replace("ı", "i").lower()
        return "".join(c for c in unicodedata.normalize("NFD", s) if c.isalpha())

    docs = {r.id: (r.source.strip().lower().replace("-", "_").replace(" ", "_"), r.text) for r in k.filter("text is not null").collect()}
    total, holds = defaultdict(set), defaultdict(set)
    for r in k.collect():
        total[r.source.strip().lower().replace("-", "_").replace(" ", "_")].add(r.id)
    for i, (s, t) in docs.items():
        for line in t.split("\n"):
            if key(line):
                holds[s, key(line)].add(i)
    bad = {x for x, ids in holds.items() if len(ids) >= 5 and len(ids) >= 0.03 * len(total[x[0]])}
    want = {(i, n) for i, (s, t) in docs.items() for n, line in enumerate(t.split("\n")) if (s, key(line)) in bad}
    assert {(r.id, r.line_no) for r in rl.found(k).collect()} == want
