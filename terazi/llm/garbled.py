"""Text decoded with the wrong character encoding (problem 6): found and restored from the corpus's own clean words."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terazi.session import materialize

#: encodings in which text may have been written, and those by which it may have been read (fixed values)
WRITTEN = ("utf-8", "cp1254", "iso8859-9", "cp857", "mac-turkish", "cp1252", "cp1250", "cp437", "cp1251", "iso8859-7", "cp850", "mac-roman")
READ = ("cp1252", "latin-1", "cp1254", "iso8859-9", "cp850", "cp857", "cp437", "mac-roman", "mac-turkish", "cp1250", "iso8859-2", "cp1251", "iso8859-15")
#: encodings whose writers or readers put a mark for what they cannot express
MARKED = ("ascii", "latin-1", "cp1252", "iso8859-9", "cp1254", "cp857")
#: words put through the chains in a task
WORDS_PER_TASK = 20_000
#: corrections are broadcast up to this many rows, else joined by shuffle
BROADCAST_ROWS = 200_000

_SPACE = " \\t\\r\\n\\f\\x0B"
#: ASCII punctuation around a word; a question mark may be a lost letter and belongs to it
_EDGE = "[" + _SPACE + "!-/:->@\\[-`{-~]*"


@functools.cache
def _sloppy(encoding: str) -> list[str]:
    """What each byte is read as; an undefined byte becomes the control character of its number."""
    out = []
    for b in range(256):
        try:
            out.append(bytes([b]).decode(encoding))
        except UnicodeDecodeError:
            out.append(chr(b))
    return out


def _read(data: bytes, encoding: str) -> str:
    table = _sloppy(encoding)
    return "".join([table[b] for b in data])


def _garbled_forms(part: str) -> set[str]:
    """All forms in which the encoding chains leave a piece of text that has a character beyond ASCII."""
    forms = set()
    for w in WRITTEN:
        try:
            data = part.encode(w)
        except UnicodeEncodeError:
            continue
        for r in READ:
            if r != w:
                once = _read(data, r)
                forms.add(once)
                if w == "utf-8":
                    again = once.encode("utf-8")
                    forms.update(_read(again, second) for second in ("cp1252", "latin-1", r))
                    forms.add(data.decode(r, "replace"))
        if w != "utf-8":
            forms.add(data.decode("utf-8", "replace"))
        forms.add(data.decode("ascii", "replace"))
    for m in MARKED:
        forms.add(part.encode(m, "replace").decode(m))
        forms.add("".join(c if c.isascii() or not _lacks(c, m) else "�" for c in part))
    forms.discard(part)
    return forms


@functools.cache
def _lacks(char: str, encoding: str) -> bool:
    try:
        char.encode(encoding)
    except UnicodeEncodeError:
        return True
    return False


def garbled_forms(word: str) -> set[str]:
    """Garbled forms of a word: any stretch from one character beyond ASCII to another may be damaged, the rest intact."""
    at = [i for i, c in enumerate(word) if ord(c) > 127]
    out = set()
    for i, a in enumerate(at):
        for b in at[i:]:
            out.update(word[:a] + g + word[b + 1 :] for g in _garbled_forms(word[a : b + 1]))
    out.discard(word)
    return out


def _word(piece: Column) -> Column:
    return F.regexp_extract(piece, f"(?s)^{_EDGE}(.*?){_EDGE}$", 1)


def _pieces(rows: DataFrame, text: str) -> DataFrame:
    """satir_no, pos, piece: the text cut before each white space, and each piece's word."""
    cut = F.split(F.col(f"`{text}`"), f"(?=[{_SPACE}])")
    return rows.filter(F.col("satir_no").isNotNull()).select("satir_no", F.posexplode(cut).alias("pos", "piece")).withColumn("word", _word(F.col("piece")))


#: what stands for a character that is lost for good; a correct word has none
LOST = "\ufffd"


def corrections(words: DataFrame) -> DataFrame:
    """garbled, original, ambiguous for a column of words: those that are a garbled form of a more frequent corpus word.

    Every distinct word with a character beyond ASCII is put through all chains; the forms are hash-joined with the distinct
    words. An original counts as verified if the corpus has it at least as often as the form, or if the form has a LOST mark,
    which no correct word has; the most frequent wins, and of equals the first by its UTF-8 bytes, so a form garbled twice
    leads to the clean word. If another verified original is a garbled form of none of them, the form is ambiguous: it is
    damaged, but can't be restored. A word with a LOST mark of which the corpus has no original is damaged, too: original null.
    """
    counts = words.filter((F.col("word") != "") & F.col("word").rlike("[^\\x00-\\x7F]|\\?")).groupBy("word").agg(F.count("*").alias("n"))
    counts = materialize(counts, "word-counts")
    parts = max(counts.sparkSession.sparkContext.defaultParallelism, -(-counts.count() // WORDS_PER_TASK))

    def generate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                forms = list(garbled_forms(word))
                yield pa.RecordBatch.from_arrays([pa.array(forms, pa.string()), pa.array([word] * len(forms)), pa.array([n] * len(forms), pa.int64())], ["word", "original", "n_original"])

    lost = F.contains("word", F.lit(LOST))
    clean = counts.filter(F.col("word").rlike("[^\\x00-\\x7F]") & ~lost).repartition(parts, "word")
    forms = clean.mapInArrow(generate, "word string, original string, n_original long")
    matched = materialize(forms.join(counts, "word").filter(((F.col("n_original") >= F.col("n")) | lost) & (F.col("word") != "?")), "matched-forms")
    # candidates that are themselves garbled don't compete with their own originals
    ranked = matched.groupBy("word").agg(F.min_by("original", F.struct(-F.col("n_original"), F.col("original"))).alias("original"))
    bad = ranked.select(F.col("word").alias("candidate"))
    good = matched.join(bad, matched["original"] == bad["candidate"], "left_anti").groupBy("word").agg(F.count_distinct("original").alias("clean"))
    found = ranked.join(good, "word", "left").select(F.col("word").alias("garbled"), "original", (F.coalesce("clean", F.lit(0)) > 1).alias("ambiguous"))
    gone = counts.filter(lost).join(ranked, "word", "left_anti").select(F.col("word").alias("garbled"), F.lit(None).cast("string").alias("original"), F.lit(True).alias("ambiguous"))
    return found.unionByName(gone)


def _marked(rows: DataFrame, text: str) -> DataFrame:
    pieces = _pieces(rows, text)
    fixes = corrections(pieces.select("word"))
    fixes = materialize(fixes, "corrections")
    few = fixes.count() <= BROADCAST_ROWS
    return pieces.join(F.broadcast(fixes) if few else fixes, pieces["word"] == fixes["garbled"], "left")


def _weak() -> Column:
    """A form of one character may as well be a sign of its own; it counts only beside other damage in its line."""
    return (F.length("garbled") == 1) & ~F.contains("garbled", F.lit(LOST))


def found(rows: DataFrame, text: str = "not") -> DataFrame:
    """satir_no of every line of whose text a word is a garbled form, by the join with the forms; null and empty texts are none."""
    return _marked(rows, text).filter(F.col("garbled").isNotNull() & ~_weak()).select("satir_no").distinct()


def restore(rows: DataFrame, text: str = "not") -> DataFrame:
    """satir_no, text restored, fixed (words put right), lost (damaged words left as they are); null texts stay null.

    Lines come out once each, in any order; rows with a null satir_no are left out.
    """
    marked = _marked(rows, text)
    lead = F.regexp_extract("piece", f"^{_EDGE}", 0)
    new = F.concat(lead, F.col("original"), F.substring(F.col("piece"), F.length(lead) + F.length("word") + 1, F.length("piece")))
    state = F.when(F.col("garbled").isNull(), 0).when(F.col("ambiguous"), 3).when(_weak(), 1).otherwise(2)
    parts = marked.select("satir_no", F.struct("pos", "piece", new.alias("new"), state.alias("state")).alias("part"), (state > 1).alias("strong"))
    whole = parts.groupBy("satir_no").agg(F.array_sort(F.collect_list("part")).alias("parts"), F.max("strong").alias("strong"))
    put = lambda p: (p["state"] == 2) | ((p["state"] == 1) & F.col("strong"))
    joined = whole.select(
        "satir_no",
        F.array_join(F.transform("parts", lambda p: F.when(put(p), p["new"]).otherwise(p["piece"])), "").alias("restored"),
        F.size(F.filter("parts", put)).cast("long").alias("fixed"),
        F.size(F.filter("parts", lambda p: p["state"] == 3)).cast("long").alias("lost"),
    )
    nulls = rows.filter(F.col("satir_no").isNotNull() & F.col(f"`{text}`").isNull()).select("satir_no", F.lit(None).cast("string").alias("restored"), F.lit(0).cast("long").alias("fixed"), F.lit(0).cast("long").alias("lost"))
    return joined.unionByName(nulls)
