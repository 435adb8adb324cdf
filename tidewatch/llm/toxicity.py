"""Operator 2: toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

Input of a step is a word, by two paths whose vectors stand side by side. The word path is a vector of the word itself. The
character path pools the vectors of the word's character n-grams (3 to 5 characters, and its beginnings of 6 to 9, borders
included) by attention: each n-gram has a learned salience. It reads the word folded: lower-cased, digits and signs that stand in for
letters undone, repeated letters once. While training, words lose their word vector and n-grams drop out at random, so the
character path must carry the label alone and words never seen (respelt, other endings) are known by their parts.

Words run through a gated recurrent unit in each direction; attention weighs the steps of a window and a logistic layer gives the
window's logit. Overlapping windows (``WINDOW`` words, ``STEP`` apart) cover the whole text; a document's score is its worst
window's logit, put through a logistic curve fitted on rows that training left out, scored with and without the word path, with
the number of windows as second input; beyond the most windows of those rows that input stays as it is. The score is the
probability of label 1 where both labels are equally frequent, so 0.7 means that the text is 2.3 times as likely to come from
a toxic document as from another.

Training is multiple-instance: in passes over the sample every window of its documents is scored and each document trains through
its worst window. The sample is bounded (``PER_LABEL`` texts a label, none over ``MOST_CHARS`` characters). Scoring projects each
distinct word of a block once and steps through thousands of windows at a time, in blocks of fixed size.

Defined results: a null or empty text is one empty window and has the score of no evidence; without labelled rows every score
is 0.5; repeated rows repeat their result; an empty table gives no rows; columns other than the id and the text are not
read for scores, and the filter passes them through untouched.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import crc_mod_py, give_back, map_arrow, map_rows, read, slices
from .quality_net import Adam, prior_shift
from .sampling import labelled_texts
from .tokens import ascii_words

WINDOW, STEP = 48, 36
WORDS, GRAMS = 1 << 16, 1 << 18
GRAM_SIZES, BEGINNINGS = (3, 4, 5), (6, 7, 8, 9)
LEAST_TEXTS = 4
WORD_DIM, CHAR_DIM, HIDDEN = 8, 12, 10
DIM = WORD_DIM + CHAR_DIM
WORD_DROP, GRAM_DROP = 0.5, 0.2
PER_LABEL = 1_600
MOST_CHARS = 12_000
EPOCHS, BATCH, RATE = 8, 96, 0.02
LEAST_STEPS = 120  # of small samples, which get more passes
MOD, HELD_OUT = 3, 1
REJECT_AT = 0.7
BLOCK = 2048  # windows scored together
WORD_BLOCK = 1 << 14  # words whose vectors are made together
_STRIP = ".,;:!?\"'()[]{}*#$%&|<>"
_FIRST, _LAST = "\x02", "\x03"  # a word's borders
#: What digits and signs stand in for in respelt words.
_STANDS_FOR = dict(zip("013457@$!", "oieastasi", strict=True))


def _folding() -> np.ndarray:
    """For each ASCII code the code it counts as, or 0 for signs that are left out."""
    out = np.array([c if chr(c).isalnum() or chr(c) in _FIRST + _LAST else 0 for c in range(128)], np.uint64)
    for sign, letter in _STANDS_FOR.items():
        out[ord(sign)] = ord(letter)
    return out


_FOLD = _folding()


def _hash(h: np.ndarray) -> np.ndarray:
    h = h * np.uint64(0x9E3779B97F4A7C15)
    return ((h >> np.uint64(40)) ^ (h >> np.uint64(17))).astype(np.int64) % GRAMS


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word slots, the n-gram slots of all words one after another, and where each word's begin."""
    plain = [w.lower().strip(_STRIP) for w in words]
    slots = np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) % WORDS for w in plain], np.int64)
    codes = np.frombuffer("".join(f"{_FIRST}{w}{_LAST}" for w in plain).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    of = np.repeat(np.arange(len(plain)), [len(w) + 2 for w in plain])
    low = codes < 128
    codes[low] = _FOLD[codes[low].astype(np.int64)]
    stay = codes != 0
    codes, of = codes[stay], of[stay]
    stay = np.append(True, (codes[1:] != codes[:-1]) | (of[1:] != of[:-1])) if len(codes) else stay[:0]
    codes, of = codes[stay], of[stay]
    found, owner = [], []
    h = np.zeros(len(codes), np.uint64)
    for n in range(1, max(GRAM_SIZES) + 1):
        h = h[: max(0, len(codes) - n + 1)] * np.uint64(1_000_003) + codes[n - 1 :] + np.uint64(1)
        if n in GRAM_SIZES:
            own = np.flatnonzero(of[: len(h)] == of[n - 1 :])
            found.append(_hash(h[own]))
            owner.append(of[own])
    first = np.searchsorted(of, np.arange(len(plain)))
    size = np.bincount(of, minlength=len(plain)) if len(plain) else np.zeros(0, np.int64)
    h = np.zeros(len(plain), np.uint64)
    for n in range(max(BEGINNINGS)):
        longer = np.flatnonzero(size > n)
        h[longer] = h[longer] * np.uint64(0x100000001B3) + codes[first[longer] + n] + np.uint64(7)
        if n + 1 in BEGINNINGS:
            found.append(_hash(h[longer]))
            owner.append(longer)
    grams, owner = np.concatenate(found), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return slots, grams[order], np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(plain)))]).astype(np.int64)


def known_rows(counts: np.ndarray) -> np.ndarray:
    """For each slot its row in a table: slots met at least ``LEAST_TEXTS`` times have their own, all others share row 0."""
    seen = counts >= LEAST_TEXTS
    return np.where(seen, np.cumsum(seen), 0).astype(np.int32)


def windows_of(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, length and document of every window; a text without words has one empty window."""
    n = np.diff(offsets)
    count = np.where(n > WINDOW, -(-(n - WINDOW) // STEP) + 1, 1)
    doc = np.repeat(np.arange(len(n)), count)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    length = np.minimum(WINDOW, n[doc] - k * STEP)
    return offsets[doc] + k * STEP, length, doc


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _sum_by(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between cuts; nothing between two cuts is zero."""
    out = np.zeros((len(cuts) - 1, *values.shape[1:]), values.dtype)
    some = np.diff(cuts) > 0
    if some.any():
        out[some] = np.add.reduceat(values, cuts[:-1][some])
    return out


class ToxicNet:
    def __init__(self, rng: np.random.Generator, word_row: np.ndarray, gram_row: np.ndarray):
        n = lambda *s, scale=1.0: rng.normal(0, scale, s).astype(np.float32)
        self.word_row, self.gram_row = word_row, gram_row
        grams = int(gram_row.max()) + 1
        self.p = {"word": n(int(word_row.max()) + 1, WORD_DIM, scale=0.1), "gram": n(grams, CHAR_DIM, scale=0.1), "salience": np.zeros(grams, np.float32)}
        self.p |= {"out": n(2 * HIDDEN, scale=0.3), "c": np.zeros(1, np.float32), "att": n(2 * HIDDEN, scale=0.3)}
        for d in "fb":
            self.p[f"u{d}"] = n(DIM, 3 * HIDDEN, scale=DIM**-0.5)
            self.p[f"w{d}"] = n(HIDDEN, 3 * HIDDEN, scale=HIDDEN**-0.5)
            self.p[f"b{d}"] = np.zeros(3 * HIDDEN, np.float32)
        self.curve = np.array([1.0, 0.0, 0.0])
        self.most_windows = np.inf

    def rows_of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Table rows of words and of their known n-grams, and where each word's n-grams begin."""
        slots, grams, cuts = word_features(words)
        rows = self.gram_row[grams]
        known = rows > 0
        return self.word_row[slots], rows[known], np.concatenate([[0], np.cumsum(known)])[cuts]

    def inputs(self, slots: np.ndarray, grams: np.ndarray, cuts: np.ndarray, keep: bool = False):
        """Input vectors of distinct words (their table rows given), and a last row of zeros for padding."""
        a = np.exp(np.clip(self.p["salience"][grams], -12, 12))
        total = _sum_by(a, cuts)
        a = a / np.repeat(total, np.diff(cuts))
        chars = _sum_by(a[:, None] * self.p["gram"][grams], cuts)
        x = np.vstack([np.hstack([self.p["word"][slots], chars]), np.zeros((1, DIM), np.float32)])
        return (x, a) if keep else x

    def all_rows(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``rows_of`` of any number of words, a block at a time."""
        parts = [self.rows_of(words[a : a + WORD_BLOCK]) for a in range(0, max(1, len(words)), WORD_BLOCK)]
        ends = np.cumsum([0, *(len(grams) for _, grams, _ in parts)])
        cuts = [cuts[:-1] + end for (_, _, cuts), end in zip(parts, ends, strict=False)]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), np.concatenate([*cuts, ends[-1:]])

    def vectors(self, slots: np.ndarray, grams: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """``inputs`` of any number of words, a block at a time."""
        parts = [np.zeros((0, DIM), np.float32)]
        for a in range(0, len(slots), WORD_BLOCK):
            c = cuts[a : a + WORD_BLOCK + 1]
            parts.append(self.inputs(slots[a : a + WORD_BLOCK], grams[c[0] : c[-1]], c - c[0])[:-1])
        return np.vstack([*parts, np.zeros((1, DIM), np.float32)])

    def run(self, x: np.ndarray, steps: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logits of windows. steps: (T, B) rows of x, mask: (T, B) whether a step exists."""
        t_all, b_all = steps.shape
        states, tape = np.empty((t_all, b_all, 2 * HIDDEN), np.float32), []
        for half, d in enumerate("fb"):
            projected = x @ self.p[f"u{d}"] + self.p[f"b{d}"]
            w = self.p[f"w{d}"]
            w_rz, w_n = np.ascontiguousarray(w[:, : 2 * HIDDEN]), np.ascontiguousarray(w[:, 2 * HIDDEN :])
            h = np.zeros((b_all, HIDDEN), np.float32)
            own = slice(half * HIDDEN, (half + 1) * HIDDEN)
            for t in range(t_all) if d == "f" else range(t_all - 1, -1, -1):
                g = projected[steps[t]]
                rz = _sigmoid(g[:, : 2 * HIDDEN] + h @ w_rz)
                r, z = rz[:, :HIDDEN], rz[:, HIDDEN:]
                rh = r * h
                n = np.tanh(g[:, 2 * HIDDEN :] + rh @ w_n)
                m = mask[t][:, None]
                new = h + m * (1 - z) * (n - h)
                if keep:
                    tape.append((d, t, h, r, z, n, rh))
                h = new
                states[t, :, own] = h
        a = np.where(mask, states @ self.p["att"], -1e9)
        a = np.exp(a - a.max(axis=0))
        a = a * mask
        a /= np.maximum(a.sum(axis=0), 1e-9)
        pooled = np.einsum("tb,tbh->bh", a, states)
        logit = pooled @ self.p["out"] + self.p["c"]
        return (logit, states, a, pooled, tape) if keep else logit

    def gradients(self, x_parts, steps: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        slots, grams, cuts = x_parts
        x, weight = self.inputs(*x_parts, keep=True)
        logit, states, a, pooled, tape = self.run(x, steps, mask, keep=True)
        d = ((_sigmoid(logit) - y) / len(y)).astype(np.float32)
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["out"], g["c"] = pooled.T @ d, np.array([d.sum()], np.float32)
        dpool = d[:, None] * self.p["out"]
        da = np.einsum("bh,tbh->tb", dpool, states)
        ds = a * (da - (a * da).sum(axis=0))
        g["att"] = np.einsum("tb,tbh->h", ds, states)
        dstates = a[:, :, None] * dpool + ds[:, :, None] * self.p["att"]
        dx = np.zeros_like(x)
        carry = {"f": np.zeros((steps.shape[1], HIDDEN), np.float32), "b": np.zeros((steps.shape[1], HIDDEN), np.float32)}
        dproj = {k: np.zeros((len(x), 3 * HIDDEN), np.float32) for k in "fb"}
        for dr, t, h, r, z, n, rh in reversed(tape):
            own = slice(0, HIDDEN) if dr == "f" else slice(HIDDEN, 2 * HIDDEN)
            w = self.p[f"w{dr}"]
            dh = carry[dr] + dstates[t, :, own]
            m = mask[t][:, None]
            dm = dh * m
            dn = dm * (1 - z) * (1 - n * n)
            dz = dm * (h - n) * z * (1 - z)
            drh = dn @ w[:, 2 * HIDDEN :].T
            drr = drh * h * r * (1 - r)
            drz = np.hstack([drr, dz])
            g[f"w{dr}"][:, : 2 * HIDDEN] += h.T @ drz
            g[f"w{dr}"][:, 2 * HIDDEN :] += rh.T @ dn
            carry[dr] = dh - dm * (1 - z) + drh * r + drz @ w[:, : 2 * HIDDEN].T
            np.add.at(dproj[dr], steps[t], np.hstack([drz, dn]))
        for dr in "fb":
            g[f"u{dr}"] = x.T @ dproj[dr]
            g[f"b{dr}"] = dproj[dr].sum(axis=0)
            dx += dproj[dr] @ self.p[f"u{dr}"].T
        sizes = np.diff(cuts)
        np.add.at(g["word"], slots, dx[:-1, :WORD_DIM])
        dchars = np.repeat(dx[:-1, WORD_DIM:], sizes, axis=0)
        np.add.at(g["gram"], grams, weight[:, None] * dchars)
        dweight = (self.p["gram"][grams] * dchars).sum(axis=1)
        np.add.at(g["salience"], grams, weight * (dweight - np.repeat(_sum_by(weight * dweight, cuts), sizes)))
        return g

    def window_logits(self, x: np.ndarray, codes: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Logits of all windows, ``BLOCK`` at a time, the longest together. x: vectors of the distinct words, and the padding."""
        codes = np.append(codes, len(x) - 1)
        out = np.empty(len(first), np.float32)
        order = np.argsort(-length, kind="stable")
        for a in range(0, len(order), BLOCK):
            own = order[a : a + BLOCK]
            t = np.arange(max(1, int(length[own].max())))[:, None]
            mask = t < length[own]
            steps = codes[np.where(mask, first[own] + t, len(codes) - 1)]
            out[own] = self.run(x, steps, mask)
        return out

    def document_logits(self, column: pa.Array, word_path: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """The worst window's logit and the number of windows of each text."""
        words, codes, offsets = ascii_words(column)
        first, length, doc = windows_of(offsets)
        cuts = np.flatnonzero(np.diff(doc, prepend=-1))
        slots, grams, at = self.all_rows(words)
        z = self.window_logits(self.vectors(slots if word_path else np.zeros_like(slots), grams, at), codes, first, length)
        return np.maximum.reduceat(z, cuts), np.diff(np.append(cuts, len(doc)))

    def scores(self, column: pa.Array) -> np.ndarray:
        if not len(column):
            return np.zeros(0)
        z, n = self.document_logits(column)
        s = self.curve[0] * z + self.curve[1] * np.log(np.minimum(n, self.most_windows)) + self.curve[2]
        return 1 / (1 + np.exp(-np.clip(s.astype(np.float64), -60, 60)))


def _logistic(f: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a ridge logistic regression on standardised columns of f, and its constant (Newton's method)."""
    mean, scale = f.mean(axis=0), f.std(axis=0) + 1e-6
    a = np.hstack([(f - mean) / scale, np.ones((len(f), 1))])
    w = np.zeros(a.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + 0.5 * np.eye(len(w))
        w -= np.linalg.solve(h, a.T @ (p - y) + 0.5 * w * np.array([1.0] * (len(w) - 1) + [0.0]))
    return np.append(w[:-1] / scale, w[-1] - (w[:-1] * mean / scale).sum())


def _dropped(rng: np.random.Generator, slots: np.ndarray, grams: np.ndarray, cuts: np.ndarray):
    """The same words, some without their word vector, and without some of their n-grams."""
    stay = rng.random(len(grams)) >= GRAM_DROP
    return np.where(rng.random(len(slots)) < WORD_DROP, 0, slots), grams[stay], np.concatenate([[0], np.cumsum(stay)])[cuts]


def fit(texts: list[str], labels: list[int], epochs: int = EPOCHS) -> ToxicNet:
    rng = np.random.default_rng(5)
    y = np.array(labels, np.float32)
    if not len(y):
        net = ToxicNet(rng, np.zeros(WORDS, np.int32), np.zeros(GRAMS, np.int32))
        net.curve[:] = 0
        return net
    order = rng.permutation(len(y))
    held = np.sort(order[: len(y) // 4]) if len(y) >= 40 else np.sort(order)
    own = np.sort(order[len(y) // 4 :]) if len(y) >= 40 else held
    words, codes, offsets = ascii_words(pa.array([texts[i] for i in own], pa.large_string()))
    of = np.repeat(np.arange(len(own)), np.diff(offsets))  # the document of each running word
    per = np.bincount(np.unique(of * max(1, len(words)) + codes) % max(1, len(words)), minlength=len(words))  # texts that hold a word
    met, gram_met = np.zeros(WORDS), np.zeros(GRAMS)
    for a in range(0, len(words), WORD_BLOCK):
        slots, grams, cuts = word_features(words[a : a + WORD_BLOCK])
        met += np.bincount(slots, per[a : a + WORD_BLOCK], WORDS)
        gram_met += np.bincount(grams, np.repeat(per[a : a + WORD_BLOCK], np.diff(cuts)), GRAMS)
    net = ToxicNet(rng, known_rows(met), known_rows(gram_met))
    slots, grams, cuts = net.all_rows(words)
    first, length, doc = windows_of(offsets)
    starts = np.flatnonzero(np.diff(doc, prepend=-1))
    adam, yd = Adam(net.p, RATE), y[own]
    batches = -(-len(own) // BATCH)
    epochs = max(epochs, -(-LEAST_STEPS // batches))
    steps, done = epochs * batches, 0
    for _ in range(epochs):
        z = net.window_logits(net.vectors(slots, grams, cuts), codes, first, length)
        best = np.maximum.reduceat(z, starts)
        worst = np.full(len(starts), -1)
        hit = np.flatnonzero(z == best[doc])
        worst[doc[hit][::-1]] = hit[::-1]  # the first of equals
        shuffled = rng.permutation(len(own))
        for a in range(0, len(own), BATCH):
            batch = shuffled[a : a + BATCH]
            w = worst[batch]
            t = np.arange(max(1, int(length[w].max())))[:, None]
            mask = t < length[w]
            used, inverse = np.unique(codes[np.where(mask, first[w] + t, 0)][mask], return_inverse=True) if len(codes) else (codes, codes)
            local = np.full(mask.shape, len(used))
            local[mask] = inverse
            n = cuts[used + 1] - cuts[used]
            at = np.arange(int(n.sum())) + np.repeat(cuts[used] - (np.cumsum(n) - n), n)
            parts = _dropped(rng, slots[used], grams[at], np.concatenate([[0], np.cumsum(n)]))
            adam.rate = RATE * (1 - 0.9 * done / steps)
            adam.step(net.gradients(parts, local, mask, yd[batch]))
            done += 1
    column = pa.array([texts[i] for i in held], pa.large_string())
    z, n = net.document_logits(column)
    bare, _ = net.document_logits(column, word_path=False)
    net.most_windows = int(n.max())
    net.curve = _logistic(np.stack([np.append(z, bare), np.log(np.append(n, n))], axis=1).astype(np.float64), np.append(y[held], y[held]))
    net.curve[2] += prior_shift(y, {0: len(y), 1: len(y)})
    return net


def train(docs: DataFrame, labels: DataFrame) -> ToxicNet:
    got, _ = labelled_texts(docs, labels, "toxic", MOD, HELD_OUT, PER_LABEL, MOST_CHARS)
    net = fit(got["text"].to_pylist(), got["toxic"].to_pylist())
    del got
    give_back()  # the driver goes on with other stages
    return net


def score_documents(docs: DataFrame, net: ToxicNet, reject_at: float = REJECT_AT) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 4 << 20):
            ids = part.column("doc_id").to_pylist()
            score = net.scores(part.column("text"))
            columns = [pa.array(ids, pa.int64()), pa.array(crc_mod_py(ids, MOD) == HELD_OUT), pa.array(score), pa.array((score >= reject_at).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "score", "predicted"])

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, net: ToxicNet, reject_at: float = REJECT_AT) -> DataFrame:
    """The rows of ``docs`` that score below ``reject_at``, with all their columns."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(iter([batch]), "text", 4 << 20):
            yield part.filter(pa.array(net.scores(part.column("text")) < reject_at))

    return map_rows(docs, run, docs.schema)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return score_documents(docs, train(docs, read(spark, sf_dir, "labels")))
