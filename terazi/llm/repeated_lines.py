"""Lines repeated across one source's documents (problem 3): found by likelihood ratio, removed by anti-join."""

from __future__ import annotations

import math
import unicodedata
from hashlib import md5

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terazi.functions.turkish import FOLD_FROM, FOLD_TO, spelling_key
from terazi.session import materialize

#: a case stands in at least this share of a source's documents, and in at least so many
MIN_SHARE_PERCENT, MIN_DOCS = 3, 5
FALSE_DISCOVERY = 0.01
#: flagged lines are broadcast up to this many rows (their number is bounded by lines per document / MIN_SHARE_PERCENT), and
#: so are the sizes of the sources; beyond it both are joined by shuffle
BROADCAST_ROWS = 200_000

def _letterless() -> str:
    """Every assigned character that is no letter; unassigned and private ones count as letters."""
    kinds = ((chr(c), unicodedata.category(chr(c))) for c in range(0x20000) if not 0xD800 <= c < 0xE000)
    return "".join(ch for ch, k in kinds if k[0] not in "LC" or k in ("Cc", "Cf"))


_DROPPED = _letterless()
#: the key of a line without letters
NO_LETTERS = md5(b"").hexdigest()


def line_key(line: Column) -> Column:
    """16 bytes that agree for lines differing only in spacing, case, accents, punctuation, symbols or digits.

    Lines without letters share one key, NO_LETTERS. One translation by a table folds and drops, which costs less than half of
    a pattern per line.
    """
    return F.unhex(F.md5(F.translate(line, FOLD_FROM + _DROPPED, FOLD_TO)))


def _lines(rows: DataFrame, with_text: bool = False) -> DataFrame:
    """id, source, line_no, key of every line of every row, and its wording, split and hashed once and written down."""
    cut = F.posexplode(F.split("text", "\n")).alias("line_no", "line")
    lines = rows.filter(F.col("id").isNotNull()).select("id", _source(), cut).withColumn("key", line_key(F.col("line")))
    return materialize(lines if with_text else lines.drop("line"), "lines")


def _source() -> Column:
    return F.coalesce(spelling_key(F.col("source")), F.lit("")).alias("source")


def _small(rows: DataFrame) -> DataFrame:
    """rows, to be broadcast if they are few."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def _log_likelihood(k1: Column, n1: Column, k2: Column, n2: Column) -> Column:
    p1, p2, p = k1 / n1, k2 / n2, (k1 + k2) / (n1 + n2)
    term = lambda k, a, b: F.when(k > 0, k * F.log(a / b)).otherwise(0.0)
    both = term(k1, p1, p) + term(k2, p2, p) + term(n1 - k1, 1 - p1, 1 - p) + term(n2 - k2, 1 - p2, 1 - p)
    return F.when(p1 > p2, 2 * both).otherwise(0.0)


def _excess() -> Column:
    return (F.col("df") * 100 >= F.col("n_in") * MIN_SHARE_PERCENT) & (F.col("df") >= MIN_DOCS)


def line_tests(rows: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """source, key, df, n_in, df_out, n_out, llr of every wording that stands in at least MIN_DOCS documents of a source.

    A document is a distinct id; repeated rows count once. Outside means the documents of the other sources, but for those
    sources in which the wording stands in MIN_SHARE_PERCENT of the documents, too: there it is a repeated line itself and says
    nothing about how often it stands in texts by chance. If no other source is left, the source is compared with as many
    documents that lack the line.
    """
    docs = rows.filter(F.col("id").isNotNull()).select("id", _source())
    sizes = materialize(docs.distinct().groupBy("source").agg(F.count("*").alias("n_in")), "source-sizes")
    n_all = sizes.agg(F.coalesce(F.sum("n_in"), F.lit(0))).first()[0]
    held = (_lines(rows) if lines is None else lines).filter(F.col("key") != F.unhex(F.lit(NO_LETTERS))).select("source", "key", F.xxhash64("id").alias("doc")).distinct()
    counts = held.groupBy("key", "source").agg(F.count("*").alias("df")).join(_small(sizes), "source")
    of_key = W.partitionBy("key")  # at most a row for each source
    both = counts.select(
        "*", F.sum("df").over(of_key).alias("df_all"), F.sum(F.when(_excess(), F.col("df")).otherwise(0)).over(of_key).alias("df_bad"), F.sum(F.when(_excess(), F.col("n_in")).otherwise(0)).over(of_key).alias("n_bad")
    ).filter(F.col("df") >= MIN_DOCS)
    own = lambda c: F.when(_excess(), 0).otherwise(F.col(c))
    n_out = F.lit(n_all) - F.col("n_bad") - own("n_in")
    tests = both.select("source", "key", "df", "n_in", (F.col("df_all") - F.col("df_bad") - own("df")).alias("df_out"), F.when(n_out > 0, n_out).otherwise(F.col("n_in")).cast("double").alias("n_out"))
    return tests.withColumn("llr", _log_likelihood(*[F.col(c).cast("double") for c in ("df", "n_in", "df_out", "n_out")]))


def _log_p(llr: float) -> float:
    """Upper bound of the logarithm of chi-square's tail with one degree of freedom."""
    return 0.0 if llr < 1 else -llr / 2 - 0.5 * math.log(math.pi * llr / 2)


def discovery_cut(tests: DataFrame, rate: float = FALSE_DISCOVERY) -> float:
    """Least likelihood ratio that Benjamini and Hochberg's procedure accepts, from a histogram of at most 4000 bins."""
    bins = tests.groupBy(F.least(F.floor(F.col("llr") * 4), F.lit(4000)).alias("bin")).agg(F.count("*").alias("n")).collect()
    total, above, cut = sum(r.n for r in bins), 0, math.inf
    for r in sorted(bins, key=lambda r: -r.bin):
        above += r.n
        if r.bin > 0 and _log_p(r.bin / 4) <= math.log(rate * above / total):
            cut = r.bin / 4
    return cut


def repeated_lines(rows: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """source, key of the wordings repeated excessively within a source: significant excess over the outside by the likelihood
    ratio, and, checked afterwards, the least share and number."""
    tests = materialize(line_tests(rows, lines), "line-tests")
    return tests.filter((F.col("llr") >= discovery_cut(tests)) & _excess()).select("source", "key")


def found(rows: DataFrame) -> DataFrame:
    """id, line_no of every line whose wording is repeated excessively in its source; each id once.

    Null ids, null and empty texts and blank lines give nothing; a null source is a source of its own.
    """
    lines = _lines(rows)
    return lines.join(_small(repeated_lines(rows, lines)), ["source", "key"], "left_semi").select("id", "line_no").distinct()


def clean(rows: DataFrame) -> DataFrame:
    """id, text without the excess lines, in their order, and removed, the number of lines taken out; each id once.

    A null text stays null, a text of nothing but excess lines becomes empty.
    """
    lines = _lines(rows, with_text=True)
    rest = lines.join(_small(repeated_lines(rows, lines)), ["source", "key"], "left_anti")
    kept = rest.groupBy("id").agg(F.array_sort(F.collect_set(F.struct("line_no", "line"))).alias("kept"))
    whole = rows.filter(F.col("id").isNotNull()).groupBy("id").agg(F.max(F.size(F.split("text", "\n"))).alias("n"), F.max(F.col("text").isNotNull()).alias("has_text"))
    text = F.coalesce(F.array_join(F.transform("kept", lambda x: x["line"]), "\n"), F.lit(""))
    left = F.coalesce(F.size("kept"), F.lit(0))
    return whole.join(kept, "id", "left").select("id", F.when(F.col("has_text"), text).alias("text"), F.when(F.col("has_text"), F.col("n") - left).otherwise(0).cast("int").alias("removed"))
