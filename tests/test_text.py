from pyspark.sql import functions as F

from terazi.functions import text as tx
from terazi.functions.turkish import fold, spelling_key, turkish_lower
from terazi.functions.vectors import HashedEncoder, dot, encode_column, unit, yes_probability


def one(spark, expr, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(expr.alias("x")).first().x


def test_spellings(spark):
    for a, b in (("04. Hukuk  Dairesi", "4.HUKUK DAİRESİ "), ("aym-bb", "AYM_BB"), ("Çorum Fikri ve Sınai", "ÇORUM FİKRİ VE SINAİ"), ("İkinci Bölüm", "ikinci bölüm")):
        assert one(spark, spelling_key(F.col("a")), a=a) == one(spark, spelling_key(F.col("a")), a=b)
    assert one(spark, spelling_key(F.col("a")), a="  ") is None
    assert one(spark, fold(F.col("a")), a="ŞÛĞ ı İ ñ ş") == "sug i i n s"
    assert one(spark, turkish_lower(F.col("a")), a="İIŞ") == "iış"


def test_words(spark):
    assert one(spark, tx.word_count(F.col("a")), a="") == 0
    assert one(spark, tx.word_count(F.col("a")), a=" a b\n c ") == 3
    assert one(spark, tx.word_count(F.col("a")), a=None) is None
    assert one(spark, tx.collapse_whitespace(F.col("a")), a=" a \n\t b ") == "a b"
    assert one(spark, tx.shingles(F.col("a")), a="bir iki üç dört") == []
    assert one(spark, tx.shingles(F.col("a")), a="a b c d e f") == ["a b c d e", "b c d e f"]
    assert one(spark, tx.shingles(F.col("a")), a="a a a a a a a") == ["a a a a a"]
    assert one(spark, tx.stems(F.col("a")), a="Tebligatın TEBLİGAT için ev") == ["tebli"]
    assert one(spark, tx.overlap_share(F.split("a", " "), F.split("b", " ")), a="x y", b="y z") == 0.5
    assert one(spark, tx.shorten(F.col("a"), 14), a="bir iki  üç dört beş") == "bir iki [...]"


def test_headers(spark):
    cols = [F.col(c) for c in "abcde"]
    values = dict(a="yargitay", b="4. Ceza Dairesi", c="2010/5", d="", e=None)
    assert one(spark, tx.header(*cols), **values) == "Yargıtay 4. Ceza Dairesi 2010/5 E."
    assert one(spark, tx.header(*cols, full=False), **values) == "Yargıtay 4. Ceza Dairesi"
    assert one(spark, tx.model_input(F.col("a"), F.col("b"), F.col("c")), a="T", b="gerekce", c="x") == "title: T — Gerekçe | text: x"
    assert one(spark, tx.model_input(F.col("a"), F.col("b"), F.col("c")), a="T", b=None, c=None) == "title: T | text: "


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [1.0, 2.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    rows = df.select(dot(F.col("a"), F.col("b")).alias("d"), unit(F.col("a")).alias("u")).collect()
    assert rows[0].d == 11 and [round(x, 3) for x in rows[0].u] == [0.6, 0.8] and rows[1].u == [0, 0]
    p = spark.range(1).select(yes_probability(F.lit(1000.0), F.lit(1000.0)).alias("p")).first().p
    assert p == 0.5
    out = encode_column(spark.createDataFrame([("a", "tebligat usulsüz"), ("b", None)], "k string, t string"), "t", encoder=HashedEncoder(16)).collect()
    assert abs(sum(x * x for x in out[0].embedding) - 1) < 1e-6 and not any(out[1].embedding)
