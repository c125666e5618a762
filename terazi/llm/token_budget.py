"""How many tokens each decision and document holds, and totals by source, language and domain (problem 2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terazi.functions.turkish import spelling_key
from terazi.llm.encoding import count_tokens
from terazi.session import broadcast_small, materialize

#: a document longer than this is cut; its pieces are spread over the workers
PIECE_CHARS = 20_000
#: tokens are doubtful where characters per token differ from the source's median by more than this factor
DOUBT = 1.5
#: other notations of a language: three-letter codes and their two-letter ones (fixed values)
THREE_LETTERS = {
    "tur": "tr", "eng": "en", "deu": "de", "ger": "de", "fra": "fr", "fre": "fr", "rus": "ru", "ara": "ar", "ell": "el", "gre": "el",
    "zho": "zh", "chi": "zh", "jpn": "ja", "tha": "th", "hin": "hi", "urd": "ur",
}


def language_key(lang: Column) -> Column:
    """Two-letter lower-case code: region left out, three-letter codes mapped; null, blank and und give null."""
    first = F.regexp_extract(F.lower(F.trim(lang)), "^[a-z]+", 0)
    table = F.create_map(*[F.lit(x) for pair in THREE_LETTERS.items() for x in pair])
    code = F.coalesce(F.element_at(table, first), first)
    return F.when(code.isin("", "und"), None).otherwise(code)


#: places at which a pre-token ends and another begins, whatever stands around them: between a letter or number and a blank
#: before another one; between a letter or number and a sign other than an apostrophe; between a letter and a number; and
#: between a sign other than an apostrophe and a letter or number that follows it at once
_BOUNDARY = (
    "(?<=[\\p{L}\\p{N}])(?= [\\p{L}\\p{N}])|(?<=[\\p{L}\\p{N}])(?=[^\\s\\p{L}\\p{N}'])|(?<=\\p{L})(?=\\p{N})|(?<=\\p{N})(?=\\p{L})|(?<=[^\\s\\p{L}\\p{N}'])(?=[\\p{L}\\p{N}])"
)


def independent_pieces(text: Column, size: int = PIECE_CHARS) -> Column:
    """The text cut after at least size characters wherever the tokenizer's pre-tokens are proven to end.

    Pre-tokens are runs of letters, of numbers, or of other signs, each with at most one blank before it, white space, and an
    apostrophe with the letters of a contraction. So one ends and another begins at every place named at _BOUNDARY: no run
    goes on across it, no contraction spans it, and what a run is doesn't depend on what stands before it. Token counts of the
    pieces add up to the text's. In scripts without blanks the places are before and behind punctuation and numbers; a text
    without such a place, as a single run of letters, stays whole, since it is a single pre-token.
    """
    pattern = "(?s).{%d,}?(?:%s)|(?s).+" % (size, _BOUNDARY)
    return F.when(F.length(text) > size, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array(F.coalesce(text, F.lit(""))))


def document_tokens(docs: DataFrame, path: str | None = None, size: int = PIECE_CHARS) -> DataFrame:
    """doc_id, source, lang, domain, tokens of every document by the public tokenizer; null and empty texts have 0.

    Pieces of oversized documents are dealt out by the hash of (doc_id, piece); short documents stay where they are read.
    """
    base = docs.select("doc_id", "source", "lang", "domain", "text")
    long = F.length("text") > size
    pieces = base.filter(long).select("doc_id", "source", "lang", "domain", F.posexplode(independent_pieces(F.col("text"), size)).alias("piece", "text"))
    dealt = pieces.repartition("doc_id", "piece").drop("piece")
    each = count_tokens(base.filter(~F.coalesce(long, F.lit(False))).unionByName(dealt), "text", "tokens", path)
    return each.groupBy("doc_id").agg(*[F.max(c).alias(c) for c in ("source", "lang", "domain")], F.sum("tokens").alias("tokens"))


def decision_tokens(chunks: DataFrame) -> DataFrame:
    """decision_id, source (spelling key), tokens, estimated: the number of chunks whose tokens had to be estimated.

    Each (decision_id, chunk_index) counts once; rows without decision_id are left out. A chunk's tokens are doubtful if
    missing, not positive, or off the source's median of characters per token by more than DOUBT; then its characters
    divided by that median are taken. Where copies of a chunk disagree, a trusted number goes before an estimate and the
    smaller before the larger. The median comes from a quantile sketch over all chunks. Null and empty texts with doubtful
    tokens count 0. A decision's source is that of any chunk that has one.
    """
    rows = chunks.filter(F.col("decision_id").isNotNull()).select(
        "decision_id", "chunk_index", spelling_key(F.col("source")).alias("source"), F.coalesce(F.length("text"), F.lit(0)).alias("chars"), F.col("tokens").cast("long").alias("tokens")
    )
    ratio = F.try_divide(F.col("chars"), F.col("tokens"))
    usable = (F.col("tokens") > 0) & (F.col("chars") > 0)
    medians = materialize(rows.filter(usable).groupBy("source").agg(F.percentile_approx(ratio, 0.5, 10_000).alias("median")), "medians")
    overall = rows.filter(usable).agg(F.percentile_approx(ratio, 0.5, 10_000).alias("overall"))
    # trusted before estimated, then the smaller: packed into one number
    packed = F.col("estimated") * F.lit(1 << 40) + F.col("count")
    judged = (
        rows.join(broadcast_small(medians), rows["source"].eqNullSafe(medians["source"]), "left")
        .select(rows["*"], "median")
        .crossJoin(F.broadcast(overall))  # one row
        .withColumn("per", F.coalesce("median", "overall", F.lit(4.0)))
        .withColumn("trusted", F.coalesce(usable & (ratio <= F.col("per") * DOUBT) & (ratio * DOUBT >= F.col("per")), F.lit(False)))
        .withColumn("estimated", (~F.col("trusted")).cast("int"))
        .withColumn("count", F.when(F.col("trusted"), F.col("tokens")).otherwise(F.round(F.col("chars") / F.col("per")).cast("long")))
        .groupBy("decision_id", "chunk_index")
        .agg(F.min(packed).alias("best"), F.max("source").alias("source"))
    )
    return judged.groupBy("decision_id").agg(F.max("source").alias("source"), F.sum(F.col("best") % (1 << 40)).alias("tokens"), F.sum(F.floor(F.col("best") / (1 << 40))).alias("estimated"))


def _described(sources: DataFrame) -> DataFrame:
    return broadcast_small(sources.select(spelling_key(F.col("source")).alias("source_key"), F.col("source").alias("plain"), F.col("lang").alias("src_lang"), F.col("domain").alias("src_domain")).dropDuplicates(["source_key"]))


def token_counts(chunks: DataFrame, docs: DataFrame, sources: DataFrame, path: str | None = None) -> DataFrame:
    """kind (karar or belge), id, source (plain spelling), lang, domain, tokens of every decision and document.

    Language and domain are the item's own, else its source's, else null. A source that the table lacks keeps its key.
    """
    decisions = decision_tokens(chunks).select(F.lit("karar").alias("kind"), F.col("decision_id").alias("id"), F.col("source").alias("source_key"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("domain"), "tokens")
    texts = document_tokens(docs, path).select(F.lit("belge").alias("kind"), F.col("doc_id").cast("string").alias("id"), spelling_key(F.col("source")).alias("source_key"), language_key(F.col("lang")).alias("lang"), "domain", "tokens")
    return (
        decisions.unionByName(texts)
        .join(_described(sources), "source_key", "left")
        .select("kind", "id", F.coalesce("plain", "source_key").alias("source"), F.coalesce("lang", "src_lang").alias("lang"), F.coalesce("domain", "src_domain").alias("domain"), "tokens")
    )


def token_totals(chunks: DataFrame, docs: DataFrame, sources: DataFrame, path: str | None = None) -> DataFrame:
    """source, lang, domain, items, tokens rolled up; level says which of the three are summed over (grouping id)."""
    counts = token_counts(chunks, docs, sources, path)
    return counts.rollup("source", "lang", "domain").agg(F.grouping_id().cast("int").alias("level"), F.count("*").alias("items"), F.sum("tokens").alias("tokens"))
