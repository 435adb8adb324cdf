"""Operator 7: language by sparse multinomial logistic regression on TF-IDF character n-grams.

N-grams of one to three characters (lower-cased, all but letters as one space) are hashed to 2**16 features; a feature weighs its
share of the text's n-grams times its inverse document frequency. Weights are learned with follow-the-regularised-leader
(FTRL-proximal) under an elastic net, which leaves most at zero, and the softmax is cooled or heated by one temperature
fitted on rows that training left out. The fit uses a bounded sample (``PER_LANGUAGE`` texts a language, none over
``MOST_CHARS`` characters); prediction reads every character of every text, in blocks of fixed size.

Defined results: a null text or one without a letter is ``und`` with score 0; with no labelled row everything is ``und``; equal
scores go to the alphabetically first language; repeated rows repeat their result; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import crc_mod_py, map_arrow, read, slices
from .sampling import labelled_texts

FEATURES = 1 << 16
ORDERS = 3
PER_LANGUAGE = 500
MOST_CHARS = 20_000
MOD, HELD_OUT = 5, 0
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.001
SCALE = 100.0
BLOCK = 1 << 18
_MAYBE_LETTER = re.compile(r"[^\W\d_]")  # letters, and numbers that aren't digits
_TABLE: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """For each code point: itself if it is a letter, else a space (built from the character database once a process)."""
    if not _TABLE:
        size = sys.maxunicode + 1
        table = np.full(size, 32, np.uint32)
        for c in range(size):
            if not 0xD800 <= c < 0xE000 and chr(c).isalpha():
                table[c] = c
        _TABLE.append(table)
    return _TABLE[0]


def has_letter(text: str) -> bool:
    """Whether any character is a letter of the character database, as in ``_letters``."""
    return any(m[0].isalpha() for m in _MAYBE_LETTER.finditer(text))


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each between two spaces and followed by zeros, and the texts' offsets."""
    table = _letters()
    raw = np.frombuffer("".join(f" {x} \0\0" for x in texts).encode("utf-32-le", "surrogatepass"), "<u4")
    out = table[raw]
    sizes = np.array([len(x) + 4 for x in texts], np.int64)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    out[ends[1:] - 1] = 0
    out[ends[1:] - 2] = 0
    return out, ends


def grams(c: np.ndarray, a: int, b: int) -> np.ndarray:
    """Features of the n-grams that start at positions a..b-1, a row an order; FEATURES where there is none."""
    part = np.zeros(b - a + ORDERS - 1, np.uint32)
    have = c[a : min(len(c), b + ORDERS - 1)]
    part[: len(have)] = have
    out = np.empty((ORDERS, b - a), np.int64)
    h = np.zeros(b - a, np.uint32)
    inside = np.ones(b - a, bool)
    for k in range(ORDERS):
        own = part[k : k + b - a]
        inside = inside & (own != 0)
        h = (h ^ own) * np.uint32(2654435761) + np.uint32(k + 1)
        out[k] = np.where(inside, (h >> np.uint32(16)) & np.uint32(FEATURES - 1), FEATURES)
    return out


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct features of a text and their shares."""
    c, _ = codes([text.lower()])
    g = grams(c, 0, len(c)).ravel()
    f, n = np.unique(g[g < FEATURES], return_counts=True)
    return f, n / max(1, n.sum())


class LanguageModel:
    def __init__(self, languages: list[str], weights: np.ndarray, bias: np.ndarray, temperature: float):
        self.languages, self.bias, self.temperature = languages, bias, temperature
        self.weights = np.vstack([weights, np.zeros((1, weights.shape[1]), np.float32)]).astype(np.float32)

    def logits(self, texts: list[str]) -> np.ndarray:
        c, ends = codes([x.lower() for x in texts])
        # lower() may change a text's length, so offsets come from the lowered texts
        total = np.zeros((len(texts), len(self.languages)))
        count = np.zeros(len(texts))
        for a in range(0, len(c), BLOCK):
            b = min(len(c), a + BLOCK)
            g = grams(c, a, b)
            doc = np.searchsorted(ends, a, side="right") - 1
            last = np.searchsorted(ends, b - 1, side="right") - 1
            cuts = np.maximum(ends[doc : last + 1] - a, 0)
            w = self.weights[g[0]]
            for k in range(1, ORDERS):
                w += self.weights[g[k]]
            total[doc : last + 1] += np.add.reduceat(w, cuts, axis=0)
            count[doc : last + 1] += np.add.reduceat((g < FEATURES).sum(axis=0), cuts)
        return total / np.maximum(count, 1)[:, None] + self.bias

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        known = [i for i, x in enumerate(texts) if x and has_letter(x)] if self.languages else []
        lang, score = ["und"] * len(texts), np.zeros(len(texts))
        if known:
            z = self.logits([texts[i] for i in known]) / self.temperature
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            best = p.argmax(axis=1)
            score[known] = p[np.arange(len(known)), best]
            for i, k in zip(known, best.tolist(), strict=True):
                lang[i] = self.languages[k]
        return lang, score


def fit(texts: list[str], labels: list[str]) -> LanguageModel:
    languages = sorted(set(labels))
    if not languages:
        return LanguageModel([], np.zeros((FEATURES, 0), np.float32), np.zeros(0), 1.0)
    n_lang = len(languages)
    y = np.array([languages.index(x) for x in labels])
    rows = [features(x) for x in texts]
    order = np.random.default_rng(7).permutation(len(rows))
    held = set(order[: len(rows) // 5].tolist()) if len(rows) >= 20 else set()
    train = [i for i in order.tolist() if i not in held]
    df = np.zeros(FEATURES)
    for i in train:
        df[rows[i][0]] += 1
    idf = np.log((1 + len(train)) / (1 + df)) + 1
    z, n = np.zeros((FEATURES + 1, n_lang)), np.zeros((FEATURES + 1, n_lang))  # the last row is the bias

    def weights(f):
        zf = z[f]
        w = -(zf - np.sign(zf) * L1) / ((BETA + np.sqrt(n[f])) / ALPHA + L2)
        return np.where(np.abs(zf) > L1, w, 0.0)

    for _ in range(EPOCHS):
        for i in train:
            f, share = rows[i]
            f = np.append(f, FEATURES)
            x = np.append(share * idf[f[:-1]] * SCALE, 1.0)
            w = weights(f)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y[i]] -= 1
            g = x[:, None] * p
            sigma = (np.sqrt(n[f] + g * g) - np.sqrt(n[f])) / ALPHA
            z[f] += g - sigma * w
            n[f] += g * g
    w = weights(np.arange(FEATURES + 1))
    model = LanguageModel(languages, (w[:-1] * (idf * SCALE)[:, None]).astype(np.float32), w[-1], 1.0)
    if held:
        rest = sorted(held)
        s = model.logits([texts[i] for i in rest])
        model.temperature = _temperature(s, y[rest])
    return model


def _temperature(s: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, by golden-section search on its logarithm."""

    def loss(t):
        q = s / np.exp(t)
        q = q - q.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(q).sum(axis=1)) - q[np.arange(len(y)), y]))

    a, b, r = np.log(0.2), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def train(docs: DataFrame) -> LanguageModel:
    got, _ = labelled_texts(docs, docs, "lang", MOD, HELD_OUT, PER_LANGUAGE, MOST_CHARS)
    return fit(got["text"].to_pylist(), got["lang"].to_pylist())


def predict_languages(docs: DataFrame, model: LanguageModel) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 1 << 20):
            ids = part.column("doc_id").to_pylist()
            lang, score = model.predict(part.column("text").to_pylist())
            columns = [pa.array(ids, pa.int64()), pa.array(crc_mod_py(ids, MOD) == HELD_OUT), pa.array(lang, pa.string()), pa.array(score)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "lang_pred", "score"])

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, held_out boolean, lang_pred string, score double")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return predict_languages(docs, train(docs))
