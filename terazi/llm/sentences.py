"""Sentence boundaries across languages and scripts (problem 9), by document-centred disambiguation.

A full stop is ambiguous only where a capital, a number or an uncased letter follows. Whether the word before it is an
abbreviation, and whether the capitalised word after it is a name or an ordinary word, is taken from unambiguous occurrences
elsewhere in the document; where the document has none, from counts over the whole corpus. Terminators of other scripts,
Thai's blanks, quotations, brackets, numbered paragraphs and wrapped lines have rules of their own.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terazi.session import materialize

#: a word of which at most this share of full stops ends no sentence is an ordinary one
ORDINARY = 0.3
#: abbreviations that are known by what never follows them, or by numbers alone, have at most so many characters
SHORT = 6
#: the corpus's opinions are broadcast up to this many rows; beyond it each document gets those on its own words by joins
BROADCAST_ROWS = 500_000
#: lines are wrapped if no longer than this and broken where the next word wouldn't fit
WRAP_WIDTH = 120

_IGNORED = "\u00ad\u200b\u200c\u200d\u200e\u200f\u2060\ufeff\u202a\u202b\u202c\u202d\u202e\u2066\u2067\u2068\u2069"
_UPPER = "A-Z\u00c0-\u00d6\u00d8-\u00de\u011e\u0130\u015e\u0152\u0178\u0386\u0388-\u038f\u0391-\u03ab\u0400-\u042f"
_CLOSERS = "\"”’»«)\\]」』）】》'“›"
_OPENERS = "\"“„«‘(\\[「『（【《'”»‹"
#: one set of first signs keeps the search fast; what must follow each comes after it
_STOP = re.compile(
    "[.!?…‼⁇⁈⁉؟。！？｡।॥۔;\u037e](?:(?<![.;\u037e])[.!?…؟。！？।॥۔]*"
    f"|(?<=\\.)(?:\\.*(?=[{_IGNORED}]*(?:[\\s{_CLOSERS}]|$|[{_UPPER}“„«(]))|\\.+)"
    "|(?<=[;\u037e])(?=\\s+[\u0386-\u03ff]|\\s*$))"
)
_QUOTES = re.compile('["“”„«»()\\[\\]「」『』（）【】《》]')
_PAIRS = {"(": ")", "[": "]", "「": "」", "『": "』", "（": "）", "【": "】", "《": "》"}
_AFTER = re.compile(f"[{_IGNORED}]*(?:[ \u00a0\u202f\\t{_IGNORED}]?[{_CLOSERS}])*")
_NEXT = re.compile(f"[\\s{_IGNORED}\ufe0f]*((?:[^\\w\\s{_OPENERS}—–,;:-][\ufe0f\\s{_IGNORED}]*)*)([{_OPENERS}\\s{_IGNORED}]*)([\\w'’{_IGNORED}]+|[—–,;:-]|)(\\.?)")
_NUMBERED = re.compile(f"[\\s{_IGNORED}]*[0-9]{{1,3}}\\.[\\s{_IGNORED}]+[{_OPENERS}]*([{_UPPER}0-9]|[^\\W\\da-zà-öø-ÿα-ωа-яğışç])")
#: a capitalised word behind a small letter and a hyphen, as in e-Devlet
_HYPHENED = re.compile(f"[a-zçğıöşü]{{1,2}}-[{_UPPER}][\\w'’]*")
_ROMAN = re.compile("[IVXLC]+$")
_LIST_ITEM = re.compile("\\s*(?:[0-9]{1,3}[-)]|[a-zçğıöşü]\\)|[-–•*·]\\s|[IVX]+[.)]\\s)")
_THAI = re.compile("[\u0e01-\u0e4e]")
_THAI_GAP = re.compile("(?<=[\u0e01-\u0e4e])[ \u00a0\u2009\u202f\u3000]+(?=[\u0e01-\u0e4e])")
_STRIP = str.maketrans("", "", _IGNORED)
#: what follows a closing quotation when the sentence goes on in Japanese or Chinese (fixed values)
_CJK_GOES_ON = "とはがをにでもへのやなよかっ、，,；;：:的地得。"


def _word_before(text: str, start: int, stop: int) -> str:
    """The word that ends at stop, not reaching before start, without signs around it."""
    if stop <= start or text[stop - 1].isspace():
        return ""
    reach = 32
    while True:  # longer words are looked for further back
        piece = text[max(start, stop - reach) : stop]
        word = piece.rsplit(None, 1)[-1]
        if len(word) < len(piece) or stop - reach <= start:
            break
        reach *= 4
    if not word.isalnum():
        word = unicodedata.normalize("NFC", word.translate(_STRIP).lstrip("\"“„«‘(['”»‹<>*-—–/"))
    return word


def _kind(word: str) -> str:
    """U capital, l lower case, d digit, o letter without case, p other."""
    if not word:
        return "p"
    c = word[0]
    if c.isdigit():
        return "d"
    if c.isalpha():
        return "U" if c.isupper() or c.istitle() else "l" if c.islower() else "o"
    return "p"


# -- paragraphs ---------------------------------------------------------------


def paragraphs(text: str) -> list[tuple[int, int]]:
    """Units by lines. Where lines are wrapped to a width, a break counts only at a blank line, before a list item, or where
    the next word would have fitted."""
    lines, at = [], 0
    for raw in re.split("(\r\n|[\n\r\u2028\u2029\x0b\x0c\x85])", text):
        if raw and not (raw[0] in "\n\r\u2028\u2029\x0b\x0c\x85"):
            lines.append((at, at + len(raw)))
        elif raw:
            lines.append(None)
        at += len(raw)
    spans = [s for s in lines if s]
    if len(spans) < 2:
        return spans
    rows, gap = [], 0  # (start, end, line breaks before it)
    for s in lines:
        if s is None:
            gap += 1
        elif text[s[0] : s[1]].strip():
            rows.append((*s, gap))
            gap = 0
    if len(rows) < 2:
        return [r[:2] for r in rows]
    lengths = [len(text[a:b].rstrip()) for a, b, _ in rows]
    width = max(lengths)
    soft = [False] * len(rows)
    joined = close = 0
    if width <= WRAP_WIDTH:
        for i in range(1, len(rows)):
            a, b, gap = rows[i]
            if gap == 1:
                close += 1
                first = text[a:b].split(None, 1)[0]
                if lengths[i - 1] + 1 + len(first) > width and not _LIST_ITEM.match(text, a, b):
                    soft[i] = True
                    joined += 1
        inside = any(soft[i] and _kind(text[rows[i][0] : rows[i][1]].lstrip()) in "ld" and text[rows[i - 1][0] : rows[i - 1][1]].rstrip()[-1:] not in ".!?:;" for i in range(1, len(rows)))
        if not inside or joined < 0.5 * close:
            soft = [False] * len(rows)
    out: list[list[int]] = []
    for (a, b, _), s in zip(rows, soft):
        if s:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def protected(text: str, a: int, b: int) -> list[tuple[int, int]]:
    """Spans of matched quotations and brackets in a paragraph; what has no partner there protects nothing."""
    found, stack, straight, curly = [], [], None, None
    for m in _QUOTES.finditer(text, a, b):
        c, i = m.group(), m.start()
        if c in _PAIRS:
            stack.append((c, i))
        elif c in ")]」』）】》":
            for k in range(len(stack) - 1, -1, -1):
                if _PAIRS[stack[k][0]] == c:
                    found.append((stack[k][1], i + 1))
                    del stack[k:]
                    break
        elif c == '"':
            if straight is None:
                straight = i
            else:
                found.append((straight, i + 1))
                straight = None
        elif c in "„«" or (c == "“" and curly is None):
            curly = curly if curly is not None else i
        elif c in "”»“" and curly is not None:
            found.append((curly, i + 1))
            curly = None
    found.sort()
    merged: list[tuple[int, int]] = []
    for s in found:
        if not merged or s[0] >= merged[-1][1]:
            merged.append(s)
    return merged


# -- statistics ----------------------------------------------------------------

#: a full stop with the signs behind it, the token that follows (one character where a script has no capitals), and what
#: comes after that
_FOLLOWED = re.compile(f"\\.([{_IGNORED}]*[\\s,;:)]+[{_IGNORED}]*)(?=([^\\s\u0e00-\uffff]++|\\S)(\\s+\\S)?)")
_MID_CAPITAL = re.compile(f" (?<=[a-zçğıöşüâîûß-öø-ÿα-ώа-яё] )([{_UPPER}][\\w'’]+)")
_LINE_START = re.compile(f"[!?\n](?:(?<=[!?])[\"”»]?\\s|(?<=\\n)[ \\t\\r]*\\n)[ \\t]*([{_UPPER}][\\w'’]*)")
_FIRST_WORD = re.compile(f"[ \\t]*([{_UPPER}][\\w'’]*)")


def _followed(text: str) -> list[tuple[str, str, str, str]]:
    """(word, signs, follower, what comes after it) of every full stop."""
    return [(_word_before(text, 0, m.start()), *m.groups("")) for m in _FOLLOWED.finditer(text)]


def _line_starts(text: str) -> list[str]:
    """Capitalised words at the start of the text or of a paragraph, or behind a mark of question or exclamation."""
    m = _FIRST_WORD.match(text)
    return [*([m.group(1)] if m else []), *_LINE_START.findall(text)]


def _tally(pairs: Counter, counts: Counter) -> None:
    """Sort what follows full stops into kinds of evidence about the word before it.

    low: a small letter or a comma follows, which shows that no sentence ends; num: a number; cap: an uncased letter or a
    numbered paragraph; upper and the word: a capitalised word, judged later by how it stands elsewhere. opens, ordinal:
    the capitalised word follows an ordinary word's, or a number's, full stop.
    """
    for (word, between, after, beyond), n in pairs.items():
        if not word or not word[-1].isalnum():
            continue
        if between.strip()[:1] in (",", ";", ":") and between.strip():
            counts["low", word] += n
            continue
        if ")" in between:
            continue
        after = after.translate(_STRIP).lstrip(_OPENERS.replace("\\", ""))
        hyphened = _HYPHENED.match(after)
        bare = hyphened.group() if hyphened else re.match("[\\w'’]*", after).group()
        kind = "U" if hyphened else _kind(bare)
        if word[-1].isdigit() or _ROMAN.match(word):
            if kind == "U" and len(word) <= 3:
                counts["ordinal", bare] += n
        elif kind == "l":
            counts["low", word] += n
        elif kind == "d":
            counts["cap" if len(bare) <= 3 and after[len(bare) :] == "." and _kind(beyond.strip()) in "UdopU" else "num", word] += n
        elif kind == "o":
            counts["cap", word] += n
        elif kind == "U":
            counts["upper\x00" + word, bare + "." if after[len(bare) : len(bare) + 1] == "." else bare] += n
            if len(word) >= 5 and word.islower():
                counts["opens", bare] += n


def corpus_counts(docs: DataFrame) -> DataFrame:
    """kind, word, n over all documents' whole texts: what follows full stops, and where capitalised words stand.

    Counted per partition first, then summed by key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, openers, inner, bare = Counter(), Counter(), Counter(), set()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    pairs.update(_followed(text))
                    openers.update(_line_starts(text))
                    inner.update(_MID_CAPITAL.findall(text))
                    bare.update(text.split())
            if len(pairs) + len(inner) + len(bare) > 600_000:
                yield _as_batch(_gathered(pairs, openers, inner, bare))
                pairs, openers, inner, bare = Counter(), Counter(), Counter(), set()
        yield _as_batch(_gathered(pairs, openers, inner, bare))

    return docs.select("text").mapInArrow(run, "kind string, word string, n long").groupBy("kind", "word").agg(F.sum("n").alias("n"))


def _gathered(pairs: Counter, openers: Counter, inner: Counter, bare: set[str]) -> Counter:
    """All counts; bare: short words that stand without a full stop, 1 for each part of the corpus that has them so."""
    counts: Counter = Counter({("bare", w): 1 for w in bare if len(w) <= SHORT and w.isalpha()})
    _tally(pairs, counts)
    for kind, found in (("opens", openers), ("mid", inner)):
        for w, n in found.items():
            counts[kind, w] += n
    return counts


def _as_batch(counts: Counter) -> pa.RecordBatch:
    keys = list(counts)
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys], pa.string()), pa.array([w for _, w in keys], pa.string()), pa.array(list(counts.values()), pa.int64())], ["kind", "word", "n"])


def corpus_evidence(docs: DataFrame) -> DataFrame:
    """word, score, ender, opens: what the whole corpus says of each word on which it has an opinion that matters.

    score: the share of the word's full stops that end no sentence; 1 for a short word that stands nowhere without one, and
    hardly ever before a word that opens sentences. A number after a longer word speaks against an end only if small letters
    do so too. ender: at least a quarter of the capitalised words after its full stop open sentences. opens: the capitalised
    word opens sentences more often than it follows a number. Only shares decide, and whether something occurs at all: copies
    of documents change nothing, and no entry is left out for being rare; words of which all three say the ordinary thing
    have no row.
    """
    counts = materialize(corpus_counts(docs), "sentence-counts")
    pairs = counts.filter(F.col("kind").startswith("upper\x00")).select(F.expr("substring(kind, 7)").alias("before"), "word", "n")
    stands = lambda kind: counts.filter(F.col("kind") == kind).select("word", F.col("n").alias(kind))
    # an abbreviation that follows one speaks for a name after both
    opener = ~F.col("word").endswith(".") & (F.coalesce("opens", F.lit(0)) > 3 * F.coalesce("mid", F.lit(0)))
    zero = F.lit(0).cast("long")
    folded = (
        pairs.join(stands("opens"), "word", "left")
        .join(stands("mid"), "word", "left")
        .groupBy(F.col("before").alias("word"))
        .agg(*[F.sum(F.when(x, F.col("n")).otherwise(0)).alias(n) for x, n in ((opener, "caps"), (~opener, "name"))])
    )
    kinds = ("low", "num", "cap", "opens", "ordinal", "bare")
    plain = counts.filter(F.col("kind").isin(*kinds)).groupBy("word").agg(*[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), zero).alias(k) for k in kinds])
    both = plain.join(folded, "word", "full_outer").na.fill(0)
    cap = F.col("cap") + F.col("caps")
    short = F.length("word") <= SHORT
    before_names = short & (F.col("name") > 4 * cap) & (F.col("bare") == 0)
    no_end = F.col("low") + F.when(short | (F.col("low") > 0), F.col("num")).otherwise(0)
    score = F.when(before_names, 1.0).otherwise(F.try_divide(no_end, F.col("low") + F.col("num") + cap + F.col("name")))
    judged = both.select("word", score.alias("score"), (3 * cap > F.col("name")).alias("ender"), (F.col("opens") > F.col("ordinal")).alias("opens"))
    dotted = F.col("word").contains(".") | (F.length("word") == 1)
    return judged.filter((F.col("score") > ORDINARY) | (dotted & F.col("score").isNotNull()) | F.col("opens"))


Evidence = dict[str, tuple[float | None, bool, bool]]


def as_evidence(rows) -> Evidence:
    return {word: (score, ender, opens) for word, score, ender, opens in rows}


# -- the decision ----------------------------------------------------------------


#: a full stop before a small letter or a comma, which ends no sentence
_NO_END = re.compile(f"\\.(?:[\\s{_IGNORED}]+[{_OPENERS}]?[a-zçğıöşüâîûß-öø-ÿα-ώа-яё]|[,;:)])")


class Own:
    """What a document itself says, from occurrences that are not ambiguous; each index is made once, when first asked for."""

    def __init__(self, text: str):
        self.text, self.lines = text, []

    @functools.cached_property
    def no_end(self) -> set[str]:
        """Words whose full stop ends no sentence somewhere."""
        text = self.text
        return {_word_before(text, 0, m.start()) for m in _NO_END.finditer(text) if not _HYPHENED.match(text, m.end() - 1)}

    @functools.cached_property
    def bare(self) -> set[str]:
        """Words that stand without a full stop."""
        return set(self.text.split())

    @functools.cached_property
    def closing(self) -> set[str]:
        """Words whose full stop ends a paragraph."""
        ends = ((a, _word_before(self.text, a, b - 1), b) for a, b in self.blocks if self.text[b - 1] == ".")
        return {w for a, w, b in ends if len(w) + 1 < b - a}  # a line of nothing else is a heading

    @functools.cached_property
    def blocks(self) -> list[tuple[int, int]]:
        out = ((a, a + len(self.text[a:b].rstrip())) for a, b in self.lines)
        return [(a, b) for a, b in out if b > a]

    @functools.cached_property
    def inside(self) -> set[str]:
        """Capitalised words in the middle of sentences: names and titles."""
        return set(_MID_CAPITAL.findall(self.text))

    @functools.cached_property
    def opening(self) -> set[str]:
        """Capitalised words at the start of a paragraph or behind an ordinary word's full stop."""
        return {*_line_starts(self.text), *_AFTER_ORDINARY.findall(self.text)}

    @functools.cached_property
    def ordinals(self) -> Counter:
        """How often each capitalised word follows the full stop of a number that stands in a sentence."""
        return Counter(_AFTER_NUMBER.findall(self.text))

    def abbreviation(self, word: str) -> bool | None:
        """Whether the word is an abbreviation; None where nothing or both is to be seen."""
        return {(True, False): True, (False, True): False}.get((word in self.no_end, word in self.bare))

    def opens(self, word: str, after_number: bool) -> bool | None:
        """Whether the capitalised word is one that opens sentences, and no name or, behind a number, no word that numbers
        more than once stand before; None where nothing or both is to be seen."""
        against = self.ordinals[word] > 1 if after_number else word in self.inside
        return {(True, False): True, (False, True): False}.get((word in self.opening, against))


_AFTER_ORDINARY = re.compile(f"\\.(?<=[a-zçğıöşüâîûß-öø-ÿα-ώа-яё]{{5}}\\.)\\s+((?:[a-zçğıöşü]{{1,2}}-)?[{_UPPER}][\\w'’]*)")
#: numbers behind a word, which number no paragraph
_AFTER_NUMBER = re.compile(f"[^\\W\\d_][\\s]\\d{{1,3}}\\.\\s+((?:[a-zçğıöşü]{{1,2}}-)?[{_UPPER}][\\w'’]*)")


class Splitter:
    """Splits texts by the evidence of the document at hand; where it has none, or speaks both ways, by the corpus's."""

    def __init__(self, corpus: Evidence):
        self.corpus = corpus

    def _plain(self, word: str) -> bool:
        """An ordinary word, by the document or else by the corpus, after whose full stop any capital opens a sentence."""
        if len(word) < 3 or not word.isalpha():
            return False
        if word in self.own.no_end:
            return False
        return self._corpus_score(word) is None or word in self.own.bare

    def _corpus_score(self, word: str) -> float | None:
        """The corpus's score where it is more than an ordinary word's."""
        got = self.corpus.get(word)
        return got[0] if got is not None and got[0] is not None and got[0] > ORDINARY else None

    def split(self, text: str | None) -> list[tuple[int, int]]:
        """(start, end) of the sentences; none for null, empty and blank texts."""
        if not text or not text.strip():
            return []
        self.text, self.own, self.own_stop = text, Own(text), "۔" in text
        out = []
        thai = _THAI.search(text) is not None
        blocks = paragraphs(text)
        self.own.lines = blocks
        for a, b in blocks:
            cuts = self._thai_cuts(a, b) if thai else []
            cuts += self._cuts(a, b)
            start = a
            for c in [*sorted(cuts), b]:
                s, e = start, c
                while s < e and text[s].isspace():
                    s += 1
                while e > s and text[e - 1].isspace():
                    e -= 1
                if e > s:
                    out.append((s, e))
                start = c
        return out

    def _thai_cuts(self, a: int, b: int) -> list[int]:
        """Thai's blanks, but for those inside a quotation or bracket, which may stand in a sentence of any script."""
        gaps = [m.start() for m in _THAI_GAP.finditer(self.text, a, b)]
        spans, k, cuts = protected(self.text, a, b) if gaps else [], 0, []
        for g in gaps:
            while k < len(spans) and spans[k][1] <= g:
                k += 1
            if k == len(spans) or spans[k][0] > g:
                cuts.append(g)
        return cuts

    def _cuts(self, a: int, b: int) -> list[int]:
        text, cuts, start, reached, k = self.text, [], a, a, 0
        spans = None
        last = len(text[a:b].rstrip()) + a
        for m in _STOP.finditer(text, a, b):
            s, e = m.span()
            if s < reached:
                continue
            if e >= last:
                break
            if spans is None:
                spans = protected(text, a, b)
            while k < len(spans) and spans[k][1] <= s:
                k += 1
            inside = k < len(spans) and spans[k][0] < s
            if e - s == 1 and not inside and text[s] == "." and text[e] == " " and text[s - 1].islower():
                c = text[e + 1]  # the plain case first
                if c.islower() and not _HYPHENED.match(text, e + 1):
                    continue
                if c.isupper() and self._plain(text[text.rfind(" ", start, s) + 1 : s]):
                    cuts.append(e)
                    start = reached = e
                    continue
            after = _AFTER.match(text, e, b).end()
            if inside:
                if spans[k][1] > after:  # not at the end of the quotation or bracket
                    continue
                after = spans[k][1]
            else:
                after = self._own_closers(e, after, spans, k)
            # a terminator may follow the closing sign, as where a quotation ends its sentence
            if after > e and (tail := _STOP.match(text, after, b)):
                s, e, inside = tail.start(), tail.end(), False
                after = self._own_closers(e, _AFTER.match(text, e, b).end(), spans, k)
            reached = max(after, e)
            if after < last and self._ends(start, s, e, after, b, inside):
                cuts.append(after)
                start = after
        return cuts

    def _own_closers(self, e: int, after: int, spans: list[tuple[int, int]], k: int) -> int:
        """Signs after a terminator that open a span belong to what follows."""
        for s in spans[k:]:
            if e <= s[0] < after:
                return e
            if s[0] >= after:
                break
        return after if self.text[e:after].strip() else e

    def _ends(self, start: int, s: int, e: int, after: int, b: int, inside: bool) -> bool:
        """Whether a terminator at s..e, closing signs to after, ends the sentence that began at start."""
        text = self.text
        sign = text[e - 1]
        nxt = _NEXT.match(text, after, b)
        word = nxt.group(3)
        if word and not word.isalnum():
            word = unicodedata.normalize("NFC", word.translate(_STRIP))
        kind = _kind(word)
        if kind == "l" and (joined := _HYPHENED.match(text, nxt.start(3))):
            kind, word = "U", joined.group()
        if sign in "。！？｡":
            if after > e:
                return text[after] not in _CJK_GOES_ON and text[after] not in "，、；"
            return text[after] not in "，、；,"
        if text[s] == "…" and "\u3000" <= (text[after : after + 1] or " ") < "\uff00":
            return text[after] not in "，、；。"
        if sign in "।॥۔;\u037e":
            return kind != "p" or word == "" or nxt.group(2) != ""
        gap = text[after].isspace() or text[after] in _IGNORED
        if word and word in "—–,;:-" or text[after : after + 1] in ",;:":
            return False
        if sign in "!?؟‼⁇⁈⁉":
            return kind != "l" and (gap or kind in "Uo" or nxt.group(2) != "")
        if sign == "…" or e - s > 1:
            alone = s == start or text[s - 1].isspace() or text[s - 1] in "([\"“„«"
            if alone and not (nxt.group(2) and not gap):
                return False
            return kind in "Uo" or (kind == "d" and _NUMBERED.match(text, after, b) is not None) or (kind == "p" and nxt.group(2) != "")
        return self._full_stop(start, s, after, b, word, kind, gap, inside or after > e, nxt)

    def _full_stop(self, start: int, s: int, after: int, b: int, word: str, kind: str, gap: bool, closed: bool, nxt: re.Match) -> bool:
        text = self.text
        if kind == "l":
            return False
        if "\u0900" <= text[s - 1] < "\u0e00" or (self.own_stop and "\u0600" <= text[s - 1] < "\u0780"):
            return False  # these scripts have a full stop of their own
        numbered = kind == "d" and _NUMBERED.match(text, after, b) is not None
        if closed:
            return kind != "p" or nxt.group(2) != ""
        before = _word_before(text, start, s)
        at_start = not text[start : s - len(before)].strip(f" \t\r\n\u00a0{_OPENERS}{_IGNORED}") or len(text[start:s].split()) == 1
        number = before[-1:].isdigit() and before.replace(".", "").replace(",", "").replace("/", "").isdigit()
        if not before:
            return False
        if at_start and (number and len(before) <= 4 or len(before) == 1 or _ROMAN.match(before)):
            return False  # the number of a paragraph or heading
        if not gap and not (kind == "U" and len(word) > 1 or nxt.group(2)):
            return False
        if not gap and (number or len(before) == 1) and kind != "U":
            return False
        if number or _ROMAN.match(before) and len(before) > 1:
            if kind == "U":
                if number and len(before) >= 4 or any(c in "\"“„«‘" for c in nxt.group(2)):
                    return True
                return self._opens(word, True)
            return kind == "o" or numbered or (kind == "p" and nxt.group(2) != "") or (kind == "d" and len(before) >= 4)
        if kind == "p" and nxt.group(2) == "":
            return False
        dotted = "." in before or len(before) == 1
        score = None
        if not dotted:
            score = self._score(before, kind == "d")
        if kind == "o":
            return not (dotted and len(before) == 1) and not (score is not None and score > 0.5)
        if kind == "d":
            if dotted or (score is not None and score > 0.4):
                return numbered and (self._ends_sentences(before) or not dotted and score < 0.9)
            return True
        # a capital follows
        if not dotted and score is None:
            return True
        if len(word) == 1 and nxt.group(4) and not self._opens(word):
            return False
        if self._ends_sentences(before):
            return len(word) <= 1 or self._opens(word)
        # common words that open sentences show an end even after words that are mostly abbreviations
        return not dotted and score < 0.9 and self._opens(word)

    def _score(self, before: str, number: bool) -> float | None:
        """How likely the word is an abbreviation: by the document, else by the corpus; None for an ordinary word."""
        wide, seen = self._corpus_score(before), before in self.own.no_end
        if not seen and wide is None:
            return None
        if number:  # what stands before numbers may be a plain word elsewhere
            return 1.0 if seen else wide
        own = self.own.abbreviation(before)
        return wide if own is None else 1.0 if own else None

    def _ends_sentences(self, before: str) -> bool:
        """Whether an abbreviation may end a sentence: if it ends a paragraph of the document, else by the corpus."""
        if before in self.own.closing:
            return True
        got = self.corpus.get(before)
        return got is not None and got[0] is not None and got[1]

    def _opens(self, word: str, after_number: bool = False) -> bool:
        """Whether the capitalised word opens sentences, rather than being a name or following a number."""
        own = self.own.opens(word, after_number)
        if own is not None:
            return own
        got = self.corpus.get(word)
        return got is not None and got[2]


def asked_words(text: str | None) -> set[str]:
    """Every word whose evidence the splitting of the text can look up."""
    out: set[str] = set()
    for m in re.finditer("\\.", text or ""):
        out.add(_word_before(text, 0, m.start()))
        nxt = _NEXT.match(text, _AFTER.match(text, m.end()).end())
        joined = _HYPHENED.match(text, nxt.start(3))
        out.add(unicodedata.normalize("NFC", nxt.group(3).translate(_STRIP)) if joined is None else joined.group())
    return out - {""}


def _spans(batches: Iterator[pa.RecordBatch], splitter_of) -> Iterator[tuple[pa.RecordBatch, list, list]]:
    """(rows, texts, spans of each) of doc_id, text and, where it differs by document, evidence."""
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            texts = part.column(1).to_pylist()
            yield part, texts, [splitter_of(part, k).split(t) for k, t in enumerate(texts)]


def _with_evidence(docs: DataFrame, evidence: DataFrame | Evidence | None, broadcast_rows: int) -> tuple[DataFrame, object]:
    """(doc_id, text and perhaps evidence, a maker of splitters for them).

    The corpus's opinions are broadcast up to broadcast_rows; if there are more, each document is given those on its own
    words. Both ways the same opinions reach a document.
    """
    rows = docs.select("doc_id", "text")
    if isinstance(evidence, dict):
        shared = docs.sparkSession.sparkContext.broadcast(evidence)
        return rows, lambda: _one_for_all(shared)
    table = materialize(corpus_evidence(docs) if evidence is None else evidence, "sentence-evidence")
    if table.count() <= broadcast_rows:
        shared = docs.sparkSession.sparkContext.broadcast(as_evidence(table.collect()))
        return rows, lambda: _one_for_all(shared)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = [sorted(asked_words(t)) for t in batch.column(1).to_pylist()]
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(len(asked)), [len(a) for a in asked])))
            yield pa.RecordBatch.from_arrays([ids, pa.array([w for a in asked for w in a], pa.string())], ["doc_id", "word"])

    known = rows.mapInArrow(words, "doc_id long, word string").join(table, "word")
    each = known.groupBy("doc_id").agg(F.collect_set(F.struct("word", "score", "ender", "opens")).alias("evidence"))
    joined = rows.join(each, rows["doc_id"].eqNullSafe(each["doc_id"]), "left").select(rows["doc_id"], rows["text"], "evidence")

    def maker():
        return lambda part, k: Splitter(as_evidence(tuple(x.values()) for x in part.column(2)[k].as_py() or []))

    return joined, maker


def _one_for_all(shared):
    one = Splitter(shared.value)
    return lambda part, k: one


def split_table(docs: DataFrame, evidence: DataFrame | Evidence | None = None, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, start_char, end_char of every sentence of every document, whatever its lang column says.

    Null, empty and blank texts give no rows. Repeated texts give the same sentences under each doc_id. evidence: what
    corpus_evidence() gives for these documents, if it is at hand.
    """
    rows, maker = _with_evidence(docs, evidence, broadcast_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, spans in _spans(batches, maker()):
            sizes = [len(s) for s in spans]
            ids = part.column(0).take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
            flat = np.array([x for s in spans for x in s], np.int32).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([ids, pa.array(flat[:, 0]), pa.array(flat[:, 1])], ["doc_id", "start_char", "end_char"])

    return rows.mapInArrow(run, "doc_id long, start_char int, end_char int")


def sentences(docs: DataFrame, evidence: DataFrame | Evidence | None = None, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, sira (from 0), sentence: the sentences' texts in order."""
    rows, maker = _with_evidence(docs, evidence, broadcast_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts, spans in _spans(batches, maker()):
            sizes = np.array([len(s) for s in spans], np.int64)
            ids = part.column(0).take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
            order = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            said = [t[a:b] for t, s in zip(texts, spans) for a, b in s]
            yield pa.RecordBatch.from_arrays([ids, pa.array(order.astype(np.int32)), pa.array(said, pa.string())], ["doc_id", "sira", "sentence"])

    return rows.mapInArrow(run, "doc_id long, sira int, sentence string")
