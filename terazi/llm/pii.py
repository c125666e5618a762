"""Personal information in free text (problem 4): a linear-chain conditional random field over word shapes.

Texts are cut into words, numbers and single signs in numpy, a whole batch at a time; each is described by its shape and the
shapes and words around it; labels are decoded by Viterbi over many stretches at once. The field is trained from the small
labelled table in pii_labelled when first needed.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terazi.llm.pii_labelled import LISTS, labelled_table

KINDS = ("name", "address", "email", "phone", "identity")
LABELS = ("O", *(f"{b}-{k}" for k in KINDS for b in "BI"))
PLACEHOLDERS = {"name": "[AD]", "address": "[ADRES]", "email": "[EPOSTA]", "phone": "[TELEFON]", "identity": "[KIMLIK]"}
#: sentences in the labelled table for each pattern, penalty on weights, and rounds of training
COPIES, PENALTY, ROUNDS = 6, 0.02, 90
#: characters labelled at a time
BLOCK_CHARS = 1_000_000

# -- words -------------------------------------------------------------------

_SPACE, _BREAK, _LOWER, _UPPER, _DIGIT, _SIGN = range(6)
_SIGNS = "\n.,:;-/()@+<>\"'[]_%§&*…’“”–|?!#="
_N_LETTER, _N_DIGIT = 8, 13
N_SHAPES = 1 + _N_LETTER + _N_DIGIT + len(_SIGNS) + 1


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class, folded code and sign number of each code point."""
    size = 0x3000  # beyond it, everything that isn't told apart here is a letter
    kind, fold, sign = np.full(size, _SIGN, np.uint8), np.arange(size, dtype=np.uint64), np.full(size, len(_SIGNS), np.int16)
    for c in range(size):
        ch = chr(c)
        category = unicodedata.category(ch)
        if ch in "\n\r  ":
            kind[c] = _BREAK
        elif ch.isspace():
            kind[c] = _SPACE
        elif category in ("Lu", "Lt"):
            kind[c] = _UPPER
        elif category[0] in "LM" or category == "Cf":
            kind[c] = _LOWER
        elif category == "Nd":
            kind[c] = _DIGIT
        low = {"I": "ı", "İ": "i"}.get(ch, ch.lower())
        fold[c] = ord(low[0])
        if ch in _SIGNS:
            sign[c] = _SIGNS.index(ch)
    return kind, fold, sign


_BASE = 0x9E3779B97F4A7C15


@functools.cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64, and their inverses."""
    inverse = pow(_BASE, -1, 1 << 64)
    out = []
    for base in (_BASE, inverse):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return tuple(out)


def word_hash(word: str) -> int:
    """The number by which a word is known: independent of Turkish case."""
    total, p = 0, 1
    for ch in word:
        total += ord({"I": "ı", "İ": "i"}.get(ch, ch.lower())[0]) * p
        p = p * _BASE & 0xFFFFFFFFFFFFFFFF
    return total & 0xFFFFFFFFFFFFFFFF


class Words:
    """Words, numbers and signs of texts laid end to end with a line break between them."""

    def __init__(self, joined: str):
        kinds, folds, signs = _tables()
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        n = len(codes)
        beyond = codes >= len(kinds)
        low = np.where(beyond, 0x61, codes) if beyond.any() else codes
        kind = kinds[low]
        group = np.where(kind == _UPPER, _LOWER, kind)
        solid = group > _BREAK
        change = np.empty(n + 1, bool)
        change[0] = change[n] = True
        np.not_equal(group[1:], group[:-1], out=change[1:n])
        single = group == _SIGN
        self.start = np.flatnonzero(solid & (change[:n] | single))
        self.end = np.flatnonzero(solid & (change[1:] | single)) + 1
        self.n = len(self.start)
        length = self.end - self.start
        first = kind[self.start]
        ups = np.concatenate([[0], np.cumsum(kind == _UPPER)])
        upper = ups[self.end] - ups[self.start]
        breaks = np.concatenate([[0], np.cumsum(kind == _BREAK)])
        self.line = breaks[self.start]
        gap = np.ones(self.n, np.int64)
        if self.n:
            gap[1:] = self.start[1:] - self.end[:-1]
        self.gap = np.minimum(gap, 3)
        new_line = np.ones(self.n, bool)
        new_line[1:] = self.line[1:] != self.line[:-1]
        self.new_line = new_line
        letters = (first == _LOWER) | (first == _UPPER)
        numbers = first == _DIGIT
        shape = np.zeros(self.n, np.int16)
        shape[letters] = 5
        shape[(first == _UPPER) & (length > 1) & (upper == 1)] = 2
        shape[(first == _UPPER) & (length > 1) & (upper == length)] = 3
        shape[(first == _UPPER) & (length == 1)] = 1
        shape[(first == _LOWER) & (upper == 0)] = 4
        shape[(first == _LOWER) & (upper == 0) & (length == 1)] = 6
        shape[numbers] = 1 + _N_LETTER + np.minimum(length[numbers], _N_DIGIT) - 1
        is_sign = first == _SIGN
        shape[is_sign] = 1 + _N_LETTER + _N_DIGIT + signs[low[self.start[is_sign]]]
        self.shape, self.letters, self.numbers, self.length = shape, letters, numbers, length
        up, down = _powers(1 << max(16, int(n).bit_length()))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(folds[low] * up[:n])])
        self.hash = (sums[self.end] - sums[self.start]) * down[self.start]
        tail = np.maximum(self.end - 3, self.start)
        self.ending = ((sums[self.end] - sums[tail]) * down[tail] >> np.uint64(20)) % np.uint64(_N_ENDING - 1) + np.uint64(1)
        self.codes = codes


def _sign(ch: str) -> int:
    return 1 + _N_LETTER + _N_DIGIT + _SIGNS.index(ch)


# -- features ----------------------------------------------------------------

_ADDRESS_WORDS = "sok sk sokak sokağı cad cd caddesi cadde bulvarı bulv blv mah mh mahallesi mahalle köyü köy mevkii mevki no kat daire d k apt apartmanı sitesi blok numara".split()
_N_CHUNK, _N_BUCKET, _N_ENDING = 5, 9, 2048


def _hashes(words: list[str]) -> np.ndarray:
    return np.sort(np.array([word_hash(w) for w in set(words)], np.uint64))


def _member(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values


@functools.cache
def _lexicons() -> dict[str, np.ndarray]:
    return {"address": _hashes(_ADDRESS_WORDS), "given": _hashes(LISTS["given"]), "at": _hashes(["at"])}


class Described:
    """What the field looks at: for each word the numbers of its features."""

    def __init__(self, w: Words, vocabulary: np.ndarray):
        self.w, n = w, w.n
        lex = _lexicons()
        place = np.searchsorted(vocabulary, w.hash)
        place = np.minimum(place, len(vocabulary) - 1)
        word = np.where(vocabulary[place] == w.hash, place + 2, 1).astype(np.int64)  # 0 beyond the line, 1 unknown
        word[w.numbers] = 1
        self.given = w.letters & _member(w.hash, lex["given"])
        chunk = np.cumsum((w.gap > 0) | w.new_line) - 1
        chunks = int(chunk[-1]) + 1 if n else 0
        at_sign = w.shape == _sign("@")
        spelled = w.letters & _member(w.hash, lex["at"])
        if spelled.any():
            i = np.flatnonzero(spelled)
            i = i[(i > 0) & (i + 1 < n)]
            i = i[np.isin(w.shape[i - 1], [_sign("("), _sign("[")]) & np.isin(w.shape[i + 1], [_sign(")"), _sign("]")])]
            at_sign[i] = True
        has_at = np.zeros(chunks + 2, bool)
        has_at[chunk[at_sign]] = True
        size = np.bincount(chunk, minlength=chunks + 2)
        dotted = np.zeros(chunks + 2, bool)
        dotted[chunk[(w.shape == _sign("."))]] = True
        alone = has_at & (size <= 3) & ~dotted
        alone[1:] &= True
        spaced = np.flatnonzero(alone[:chunks])
        spaced = spaced[dotted[spaced + 1]]
        flag = np.where(has_at & ~alone, 1, 0)
        flag[spaced] = 4
        flag[np.maximum(spaced - 1, 0)] = 2
        flag[spaced + 1] = 3
        self.chunk_flag = flag[chunk] if n else np.zeros(0, int)
        # clusters of numbers with signs between them
        joins = w.numbers | np.isin(w.shape, [_sign(c) for c in "+().-/"])
        fresh = np.ones(n, bool)
        if n:
            fresh[1:] = ~(joins[1:] & joins[:-1]) | (w.gap[1:] > 1) | w.new_line[1:]
        cluster = np.cumsum(fresh) - 1
        total = np.bincount(cluster, weights=np.where(w.numbers, w.length, 0), minlength=1).astype(int)
        parts = np.bincount(cluster, weights=w.numbers, minlength=1).astype(int)
        digits = total[cluster] if n else np.zeros(0, int)
        bucket = np.where(digits == 0, 0, np.clip(digits - 5, 1, _N_BUCKET - 1))
        many = np.minimum(parts[cluster] if n else digits, 5)
        zero = w.numbers & (w.codes[w.start] == ord("0")) if n else w.numbers

        def near(values: np.ndarray, k: int) -> np.ndarray:
            out = np.zeros_like(values)
            if k < 0:
                out[-k:] = values[:k]
                out[-k:][w.line[-k:] != w.line[:k]] = 0
            elif n > k:
                out[:-k] = values[k:]
                out[:-k][w.line[:-k] != w.line[k:]] = 0
            return out

        v = len(vocabulary) + 2
        shape = w.shape.astype(np.int64)
        s1, s2 = near(shape, -1), near(shape, 1)
        opening = np.where(w.new_line, 2, np.minimum(w.gap, 1))
        ending = np.where(w.letters, w.ending, 0).astype(np.int64)
        kind = np.minimum(shape, 7)
        given = self.given.astype(np.int64)
        full_stop = (s1 == _sign(".")) | (s1 == 0)
        columns = [
            (shape, N_SHAPES), (word, v), (near(word, -1), v), (near(word, 1), v), (near(word, -2), v), (near(word, 2), v), (near(word, -3), v), (near(word, 3), v),
            (s1, N_SHAPES), (s2, N_SHAPES), (near(shape, -2), N_SHAPES), (near(shape, 2), N_SHAPES),
            (s1 * N_SHAPES + shape, N_SHAPES**2), (shape * N_SHAPES + s2, N_SHAPES**2),
            (self.chunk_flag * 6 + np.minimum(shape, 5), _N_CHUNK * 6), ((bucket * 6 + many) * 2 + zero, _N_BUCKET * 12), (opening * N_SHAPES + shape, 3 * N_SHAPES),
            (ending, _N_ENDING), (near(ending, 1), _N_ENDING),
            ((near(given, -1) * 4 + near(given, 1) * 2 + full_stop) * 8 + kind, 64),
            (given * 8 + kind, 16),
        ]
        self.ids, at = np.empty((len(columns), n), np.int64), 0
        for k, (values, count) in enumerate(columns):
            np.add(values, at, out=self.ids[k])
            at += count
        self.size = at


# -- the field ---------------------------------------------------------------

_L = len(LABELS)


def _forbidden() -> np.ndarray:
    """Penalty of steps: I-x follows only B-x or I-x. The last row is the step from O or the line's start."""
    t = np.zeros((_L, _L), np.float32)
    for j, b in enumerate(LABELS):
        if b[0] == "I":
            for i, a in enumerate(LABELS):
                if a[2:] != b[2:] or a == "O":
                    t[i, j] = -1e4
    return t


class Field:
    """Weights of the field."""

    def __init__(self, vocabulary: np.ndarray, weights: np.ndarray, steps: np.ndarray):
        self.vocabulary, self.weights, self.steps = vocabulary, weights.astype(np.float32), steps.astype(np.float32)

    def scores(self, ids: np.ndarray) -> np.ndarray:
        """Score of each label (row) for each word (column)."""
        out = self.weights[ids[0]]
        part = np.empty_like(out)
        for column in ids[1:]:
            np.take(self.weights, column, axis=0, out=part, mode="clip")
            out += part
        return np.ascontiguousarray(out.T)

    def viterbi(self, scores: np.ndarray, first: np.ndarray, last: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(positions, labels) of the best label sequence of each line, lines of similar length together."""
        steps = self.steps + _forbidden()
        size = last - first
        order = np.argsort(size, kind="stable")
        out = []
        at = 0
        while at < len(order):
            to = min(len(order), at + 4000)
            while size[order[to - 1]] > 2 * size[order[at]] + 8 and to - at > 1:
                to = at + max(1, (to - at) // 2)
            part = order[at:to][::-1]  # longest first, so that those still running are a prefix
            f, s, width = first[part], size[part], int(size[part[0]])
            running = np.searchsorted(-s, -np.arange(width), "left")
            best = scores[:, f] + steps[0][:, None]
            back = np.zeros((width, _L, len(part)), np.int8)
            for t in range(1, width):
                n = running[t]
                before, came = best[:, :n], back[t, :, :n]
                value = before[0] + steps[0][:, None]
                for a in range(1, _L):
                    move = before[a] + steps[a][:, None]
                    np.copyto(came, a, where=move > value)
                    np.maximum(value, move, out=value)
                best[:, :n] = value + scores[:, f[:n] + t]
            label = (best + steps[:, 0][:, None]).argmax(0)  # what follows is O
            for t in range(width - 1, -1, -1):
                n = running[t]
                out.append((f[:n] + t, label[:n].astype(np.int8)))
                if t:
                    label[:n] = back[t][label[:n], np.arange(n)]
            at = to
        return out

    def spans(self, joined: str) -> list[tuple[int, int, str]]:
        """(start, end, kind) of the labelled items of a joined text, in order of position."""
        w = Words(joined)
        if not w.n:
            return []
        first = np.flatnonzero(w.new_line)
        label = np.zeros(w.n, np.int8)
        for at, found in self.viterbi(self.scores(Described(w, self.vocabulary).ids), first, np.append(first[1:], w.n)):
            label[at] = found
        hit = np.flatnonzero(label)
        out: list[list] = []
        starts, ends, rows = w.start[hit].tolist(), w.end[hit].tolist(), hit.tolist()
        before = -2
        for k, s, e, row in zip(label[hit].tolist(), starts, ends, rows):
            name = LABELS[k]
            if name[0] == "I" and out and row == before + 1:
                out[-1][1] = e
            else:
                out.append([s, e, name[2:]])
            before = row
        return [tuple(x) for x in out]


def train(copies: int = COPIES, penalty: float = PENALTY, rounds: int = ROUNDS) -> Field:
    """Maximum likelihood with a quadratic penalty, by limited-memory quasi-Newton steps; the same result on every run."""
    table = labelled_table(copies)
    texts = [t for t, _ in table]
    # half of the sentences stand behind another one on their line
    joined, gold, at = "", [], 0
    for i, (text, spans) in enumerate(table):
        gold += [(at + a, at + b, k) for a, b, k in spans]
        sep = " " if (i * 7919) % 10 < 5 and text[-1] in ".!?" else "\n"
        joined += text + sep
        at += len(text) + 1
    w = Words(joined)
    inside = np.zeros(len(joined) + 1, np.int32)
    for number, (a, b, _) in enumerate(gold):
        inside[a:b] = number + 1
    owner = inside[w.start]
    # words that are part of items aren't learnt, but for what marks an address or a host
    seen: dict[int, int] = {}
    kinds = np.array(["", *(k for *_, k in gold)])[owner]
    known = set(_lexicons()["address"].tolist())
    for h, k, is_word in zip(w.hash.tolist(), kinds.tolist(), w.letters.tolist()):
        if is_word and (k in ("", "identity") or h in known):
            seen[h] = seen.get(h, 0) + 1
    vocabulary = np.array(sorted(h for h, c in seen.items() if c >= 2), np.uint64)
    d = Described(w, vocabulary)
    # the given names are dropped from every second item, so that the field learns names it has no list of
    drop = d.given & (owner % 2 == 1)
    d.ids[-1, drop] -= 8
    y = np.zeros(w.n, np.int64)
    for i in np.flatnonzero(owner):
        b = i == 0 or owner[i - 1] != owner[i]
        y[i] = LABELS.index(("B-" if b else "I-") + kinds[i])
    lines = np.flatnonzero(w.new_line)
    sizes = np.diff(np.append(lines, w.n))
    longest = np.argsort(-sizes, kind="stable")
    lines, sizes = lines[longest], sizes[longest]
    width = int(sizes.max())
    reach = [int((sizes > i).sum()) for i in range(width)]  # lines that have a word at position i come first
    order = np.arange(len(lines))
    pad = lines[:, None] + np.arange(width)
    live = np.arange(width) < sizes[:, None]
    pad = np.where(live, pad, 0)
    used, ids = np.unique(d.ids.T, return_inverse=True)
    ids = ids.reshape(d.ids.T.shape)
    m, forbidden = len(used), _forbidden().astype(float)
    gold_w = np.zeros((m, _L))
    np.add.at(gold_w, (ids.ravel(), np.repeat(y, ids.shape[1])), 1.0)
    gold_t = np.zeros((_L, _L))
    for s, n in zip(lines, sizes):
        seq = np.concatenate([[0], y[s : s + n], [0]])
        np.add.at(gold_t, (seq[:-1], seq[1:]), 1.0)

    def objective(theta: np.ndarray) -> tuple[float, np.ndarray]:
        wts, steps = theta[: m * _L].reshape(m, _L), theta[m * _L :].reshape(_L, _L)
        e = np.zeros((w.n, _L))
        for k in range(ids.shape[1]):
            e += wts[ids[:, k]]
        top = e.max(1)
        em = np.exp(e - top[:, None])[pad.T]  # position, line, label
        t = np.exp(steps + forbidden)
        alpha, beta, scale = np.zeros((width, len(lines), _L)), np.zeros((width, len(lines), _L)), np.ones((width, len(lines)))
        for i, held in enumerate(reach):
            step = (alpha[i - 1, :held] @ t if i else t[0]) * em[i, :held]
            scale[i, :held] = step.sum(1)
            alpha[i, :held] = step / scale[i, :held, None]
        end = alpha[sizes - 1, order] @ t[:, 0]
        log_z = np.log(scale).sum() + np.log(end).sum() + top.sum()
        beta[sizes - 1, order] = t[:, 0] / end[:, None]
        exp_t = np.zeros((_L, _L))
        for i in range(width - 2, -1, -1):
            held = reach[i + 1]
            inner = em[i + 1, :held] * beta[i + 1, :held] / scale[i + 1, :held, None]
            exp_t += t * (alpha[i, :held].T @ inner)
            beta[i, :held] = inner @ t.T
        post = (alpha * beta).transpose(1, 0, 2)
        p = np.zeros((w.n, _L))
        p[pad[live]] = post[live]
        exp_t[0] += p[lines].sum(0)
        ends = lines + sizes - 1
        exp_t[:, 0] += p[ends].sum(0)
        grad_w = np.stack([np.bincount(ids.ravel(), weights=np.repeat(p[:, j], ids.shape[1]), minlength=m) for j in range(_L)], 1)
        loss = log_z - (wts * gold_w).sum() - (steps * gold_t).sum() + penalty / 2 * (theta**2).sum()
        return loss, np.concatenate([(grad_w - gold_w).ravel(), (exp_t - gold_t).ravel()]) + penalty * theta

    theta = _quasi_newton(objective, np.zeros(m * _L + _L * _L), rounds)
    weights = np.zeros((d.size, _L), np.float32)
    weights[used] = theta[: m * _L].reshape(m, _L)
    return Field(vocabulary, weights, theta[m * _L :].reshape(_L, _L))


def _quasi_newton(f, x: np.ndarray, rounds: int, memory: int = 8) -> np.ndarray:
    value, grad = f(x)
    pairs: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds):
        q, alphas = grad.copy(), []
        for s, g, r in reversed(pairs):
            a = r * (s @ q)
            alphas.append(a)
            q -= a * g
        q *= (pairs[-1][0] @ pairs[-1][1]) / (pairs[-1][1] @ pairs[-1][1]) if pairs else 1 / max(1.0, np.abs(grad).sum())
        for (s, g, r), a in zip(pairs, reversed(alphas)):
            q += (a - r * (g @ q)) * s
        step, slope = 1.0, -(grad @ q)
        while step > 1e-6:
            new_value, new_grad = f(x - step * q)
            if new_value <= value + 1e-4 * step * slope:
                break
            step /= 2
        else:
            return x
        s, g = -step * q, new_grad - grad
        if s @ g > 1e-10:
            pairs = [*pairs[-memory + 1 :], (s, g, 1 / (s @ g))]
        done = value - new_value < 1e-4 * abs(new_value) / 100
        x, value, grad = x + s, new_value, new_grad
        if done:
            break
    return x


@functools.cache
def field() -> Field:
    return train()


# -- the operators -------------------------------------------------------------

def bounds(text: str, start: int, end: int, kind: str) -> tuple[int, int] | None:
    """The item without signs at its ends that don't belong to it; None if nothing but signs is left.

    Whether something is an item, and of which kind, is the field's decision alone.
    """
    first = "+([" if kind == "phone" else ""
    while start < end and not (text[start].isalnum() or text[start] in first):
        start += 1
    while end > start and not text[end - 1].isalnum():
        end -= 1
    if kind == "phone" and start < end:  # a bracket belongs to it if its partner does
        opened = text.count("(", start, end) - text.count(")", start, end)
        if opened > 0 and text[start] == "(":
            start += 1
        elif start and (text[start - 1] == "+" or (opened < 0 and text[start - 1] == "(")):
            start -= 1
    return (start, end) if start < end else None


def items(field: Field, texts: list[str | None]) -> list[list[tuple[int, int, str]]]:
    """(start, end, kind) of the personal information in each text, in order."""
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    at = 0
    while at < len(texts):
        to, chars, block, begins = at, 0, [], []
        while to < len(texts) and (chars < BLOCK_CHARS or not block):
            if texts[to]:
                block.append(to)
                begins.append(chars)
                chars += len(texts[to]) + 1
            to += 1
        if block:
            owner = np.array(begins)
            spans = field.spans("\n".join(texts[i] for i in block))
            for (s, e, kind), k in zip(spans, (np.searchsorted(owner, [s for s, *_ in spans], "right") - 1).tolist()):
                text, base = texts[block[k]], begins[k]
                if exact := bounds(text, s - base, e - base, kind):
                    out[block[k]].append((*exact, kind))
        at = to
    return out


def redacted(text: str | None, found: list[tuple[int, int, str]]) -> str | None:
    """The text with a typed placeholder for each item."""
    if not found:
        return text
    parts, at = [], 0
    for s, e, kind in found:
        if s >= at:
            parts += [text[at:s], PLACEHOLDERS[kind]]
            at = e
    return "".join([*parts, text[at:]])


def _run(rows: DataFrame, make, schema: str) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(field())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                texts = part.column(1).to_pylist()
                yield make(part.column(0), texts, items(shared.value, texts))

    return rows.filter(F.col("id").isNotNull()).select("id", "text").mapInArrow(run, schema)


def found(rows: DataFrame) -> DataFrame:
    """id, kind, start_char of every item of personal information; each id once. Null and empty texts have none.

    Repeated rows are decoded as they come and made distinct by their narrow items; dropping them first would shuffle whole texts.
    """

    def make(ids: pa.Array, texts: list, spans: list) -> pa.RecordBatch:
        sizes = np.array([len(s) for s in spans], np.int64)
        flat = [x for s in spans for x in s]
        return pa.RecordBatch.from_arrays(
            [ids.take(pa.array(np.repeat(np.arange(len(sizes)), sizes))), pa.array([k for *_, k in flat], pa.string()), pa.array([s for s, *_ in flat], pa.int32())],
            ["id", "kind", "start_char"],
        )

    return _run(rows, make, "id string, kind string, start_char int").distinct()


def redact(rows: DataFrame) -> DataFrame:
    """id, text with placeholders, n_items; each id once. A null text stays null; the text of an id is that of any of its rows."""

    def make(ids: pa.Array, texts: list, spans: list) -> pa.RecordBatch:
        new = [redacted(t, s) for t, s in zip(texts, spans)]
        return pa.RecordBatch.from_arrays([ids, pa.array(new, pa.string()), pa.array([len(s) for s in spans], pa.int32())], ["id", "text", "n_items"])

    return _run(rows, make, "id string, text string, n_items int").groupBy("id").agg(F.max("text").alias("text"), F.max("n_items").alias("n_items"))
