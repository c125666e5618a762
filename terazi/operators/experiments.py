"""The experiment log: configurations, appends, sections, labels, best-of lists, repeatability."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terazi.functions.text import mapped
from terazi.operators.ranking import keep_first, running_flag, top_k, unite

#: labels of reports (fixed values)
METHOD_LABELS = {
    "per_decision": "tüm karar", "fixed_tokens": "sabit token", "sentence": "cümle", "recursive": "recursive", "sections_structural": "bölüm (yapısal)",
    "sections_fixed": "bölüm (sabit)", "sections_paragraph": "bölüm (paragraf)",
}
POOL_LABELS = {"2000": "2k", "9977": "10k"}
TEST_LABELS = {"v1": "v1", "v2": "v2", "dilekce_v1": "dilekçe"}
CONFIG = ["havuz", "veri", "model", "yontem_adi", "test_adi", "reranker", "reranker_metni"]
GRIDS = {
    "full": [(m, c, o) for m in ("fixed_tokens", "sentence", "recursive") for c, o in ((512, 64), (1024, 128), (2048, 256), (1024, 0), (1024, 256))]
    + [(m, 1024, 128) for m in ("sections_structural", "sections_fixed", "sections_paragraph")],
    "representative": [("per_decision", 0, 0), ("sentence", 1024, 128), ("recursive", 1024, 128), ("recursive", 2048, 256), ("sections_structural", 1024, 128)],
    "short": [("per_decision", 0, 0), ("sentence", 512, 64), ("recursive", 512, 64), ("sections_structural", 512, 64)],
}


def run_name(method: str, tokens: int, overlap: int) -> str:
    """Name of a run; methods that cut by decision have no parameters."""
    return method if method == "per_decision" else f"{method}_c{tokens}_o{overlap}"


def grid(pool_size: int, model_tokens: int, base_size: int = 2000) -> list[tuple[str, int, int]]:
    """Which runs a pool and a model get: all on the base pool, fewer on larger ones, short chunks for short readers."""
    name = "full" if pool_size == base_size else "short" if model_tokens < 1024 else "representative"
    return [(m, c or model_tokens, o) for m, c, o in GRIDS[name]]


def clean_grid(model_tokens: int, pool_size: int, base_size: int = 2000) -> list[tuple[str, int, int]]:
    """Runs on cleaned text: by decision, one large and two small recursive cuts; larger pools get the first two."""
    big = 1024 if model_tokens >= 1024 else 512
    runs = [("per_decision", model_tokens, 0), ("recursive", big, big // 8), ("recursive", 128, 16), ("recursive", 64, 8)]
    return runs if pool_size == base_size else runs[:2]


def variant(raw_text: bool, full_title: bool) -> str:
    """Output folder by kind of text and title."""
    return "ham_kisa_baslik" if raw_text else "temiz_tam_kunye" if full_title else "temiz"


def pending(wanted: DataFrame, done: DataFrame, key: str = "deneme") -> DataFrame:
    """Runs that the log lacks."""
    return wanted.join(done.select(key).distinct(), key, "left_anti")


def run_all(spark: SparkSession, jobs: dict[str, Callable[[SparkSession], None]]) -> dict[str, str]:
    """Run jobs one after the other; a failing one is reported and doesn't stop the rest."""
    out = {}
    for name, job in jobs.items():
        try:
            job(spark)
            out[name] = "ok"
        except Exception as error:  # noqa: BLE001
            out[name] = f"{type(error).__name__}: {error}"
    return out


def append_log(log: DataFrame, rows: DataFrame) -> DataFrame:
    """The log with new rows; columns that either lacks are null there."""
    return unite(log, rows)


def once(log: DataFrame) -> DataFrame:
    """Log lines without separators and without lines logged twice: equal but for their number; the first stays."""
    same = [c for c in log.columns if c != "satir_no"]
    real = log.filter(~F.coalesce(F.startswith("tarih", F.lit("#")), F.lit(False)))
    return keep_first(real.withColumn("_same", F.xxhash64(*[F.col(f"`{c}`") for c in same])), ["_same"], ["satir_no"]).drop("_same")


def sectioned(log: DataFrame) -> DataFrame:
    """Log lines with their report's section: 4 reranked, 3 after the first separator, 1 base pool, 2 others. Separators go."""
    is_mark = F.coalesce(F.startswith("tarih", F.lit("#")), F.lit(False))
    after = running_flag(log, is_mark, "satir_no", "_after")
    section = F.when(F.col("reranker").isNotNull(), 4).when(F.col("_after"), 3).when(F.col("karar_sayisi") == 2000, 1).otherwise(2)
    return after.withColumn("bolum", section).filter(~is_mark).drop("_after")


def report_table(log: DataFrame) -> DataFrame:
    """One row per log line with labels and metrics: wide ones where measured, else strict ones, to one digit."""
    note, run = F.coalesce("not", F.lit("")), F.col("deneme")
    parts = [F.regexp_extract(run, "^(.+)_c(\\d+)_o(\\d+)$", i) for i in (1, 2, 3)]
    label = F.when(parts[0] == "", mapped(run, METHOD_LABELS)).otherwise(F.concat(mapped(parts[0], METHOD_LABELS), F.lit(" "), parts[1], F.lit("/"), parts[2]))
    label = F.when(F.regexp_like(note, F.lit("tam k.nye")), F.concat(label, F.lit(" (tam künye)"))).otherwise(label)
    kind = F.when(F.contains(note, F.lit("aday:")), F.when(F.contains(note, F.lit("/temiz/")), "temiz").otherwise("ham")).otherwise(F.when(F.startswith(note, F.lit("temiz")), "temiz").otherwise("ham"))
    read = F.regexp_extract(note, "metin: ([\\p{L}\\p{N}_]+)", 1)
    metric = lambda k: F.round(F.coalesce(f"ilk{k}_genis_%", f"ilk{k}_%"), 1).alias(f"ilk{k}")
    return sectioned(log).select(
        "satir_no", "bolum", mapped(F.col("karar_sayisi").cast("string"), POOL_LABELS).alias("havuz"), kind.alias("veri"), "model", label.alias("yontem_adi"),
        mapped(F.col("test_seti"), TEST_LABELS).alias("test_adi"), metric(1), metric(5), metric(10),
        F.when(F.col("bolum") == 4, F.col("reranker")).alias("reranker"), F.when(F.col("bolum") == 4, F.when(read == "", "parça").otherwise(read)).alias("reranker_metni"),
    )


def grouped_sheet(table: DataFrame) -> DataFrame:
    """The report with a title row before each section: bolum, satir (0 for the title), baslik, and the report's columns, null in
    title rows. Rows come in order by (bolum, satir)."""
    titles = table.groupBy("bolum").agg(F.concat(F.lit("Bölüm "), F.first("bolum").cast("string"), F.lit(": "), F.count("*").cast("string"), F.lit(" deneme")).alias("baslik"))
    return unite(titles.withColumn("satir", F.lit(0).cast("long")), table.withColumn("satir", F.col("satir_no").cast("long")))


def best_of(table: DataFrame, group: list[str], order: list[str], config: list[str] = CONFIG, n: int = 3, without_rerank: bool = False) -> DataFrame:
    """The n best configurations of each group by metrics in turn; each configuration once, lines without the first metric left
    out, the earlier line first among equals. A reranker named yok is none."""
    none = F.col("reranker").isNull() | (F.col("reranker") == "yok")
    rows = table.withColumn("reranker_metni", F.when(~none, F.col("reranker_metni"))).withColumn("reranker", F.when(~none, F.col("reranker")))
    if without_rerank:
        rows = rows.filter(F.col("reranker").isNull())
    by = [F.col(c).desc_nulls_last() for c in order] + [F.col("satir_no")]
    return top_k(keep_first(rows.filter(F.col(order[0]).isNotNull()), [*group, *[c for c in config if c not in group]], by), group, by, n)


def best_fetchers(table: DataFrame, n: int = 3) -> DataFrame:
    """The n best configurations without a reranker for each pool and task, by hits at a hundred, at five and at one.

    table: report_table() with ilk100, which per_task() derives from per-query results.
    """
    return best_of(table, ["havuz", "test_adi"], ["ilk100", "ilk5", "ilk1"], n=n, without_rerank=True)


def rank_histogram(rankings: DataFrame) -> DataFrame:
    """Of a query asked many times: test_id, sira, n: how often its target came at which rank; null where it never came."""
    per = rankings.groupBy("test_id", "tekrar").agg(F.min(F.when(F.col("hedef"), F.col("rank"))).alias("sira"))
    return per.groupBy("test_id", "sira").agg(F.count("*").alias("n"))


def of_version(results: DataFrame, version: str) -> DataFrame:
    """Results whose test_id is of a version of the test set, by what stands before its first hyphen."""
    return results.filter(F.substring_index("test_id", "-", 1) == version)


def with_separator(log: DataFrame, label: str) -> DataFrame:
    """The log and, if it has none with this label, a separator line at its end; its number follows the last one."""
    mark = f"# {label}"
    last = log.agg(F.coalesce(F.max("satir_no"), F.lit(0)).alias("_last"), F.coalesce(F.max((F.col("tarih") == mark).cast("int")), F.lit(0)).alias("_has"))
    line = last.filter("_has = 0").select((F.col("_last") + 1).cast(dict(log.dtypes)["satir_no"]).alias("satir_no"), F.lit(mark).alias("tarih"))
    return unite(log, line)


def per_task(results: DataFrame, rank: str) -> DataFrame:
    """Hits at 1, 5, 10 and 100 of each run and task, to one digit. results: deneme, sorgu_tipi and a rank column."""
    from terazi.operators.evaluate import hit_share

    return results.groupBy("deneme", "sorgu_tipi").agg(*[F.round(hit_share(F.col(rank), k), 1).alias(f"ilk{k}") for k in (1, 5, 10, 100)])


def mismatches(derived: DataFrame, logged: DataFrame, tolerance: float = 0.1) -> DataFrame:
    """deneme, derived and logged share of hits at five where both differ by more than the tolerance."""
    both = derived.select("deneme", F.col("ilk5").alias("turetilen")).join(logged.select("deneme", F.col("ilk5").alias("kayitli")), "deneme")
    return both.filter(F.abs(F.col("turetilen") - F.col("kayitli")) > tolerance)


def repeatability(rankings: DataFrame) -> DataFrame:
    """Of a query asked many times: test_id, runs, different result lists, hits at five, range of the first score.

    rankings: test_id, tekrar, rank, decision_id, score, hedef (whether it is the target).
    """
    per = rankings.groupBy("test_id", "tekrar").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "decision_id"))), lambda x: x["decision_id"]).alias("liste"),
        F.max((F.col("hedef") & (F.col("rank") <= 5)).cast("int")).alias("bulundu"), F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("ilk_skor"),
    )
    return per.groupBy("test_id").agg(
        F.count("*").alias("tekrar"), F.count_distinct("liste").alias("farkli_liste"), F.sum("bulundu").alias("ilk5_bulundu"), (F.max("ilk_skor") - F.min("ilk_skor")).alias("skor_araligi")
    )
