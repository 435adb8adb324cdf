"""Operator 8: document quality by a byte-level convolutional network written in numpy.

A text's UTF-8 bytes are cut into overlapping chunks that cover all of it. In each chunk, learned filters over embedded bytes
give a response at every second place; each filter keeps its largest response in the chunk (max pooling). A document is
the mean and the maximum over its chunks of these pooled responses, and a logistic layer turns both into one probability.
Filters, embedding and output are trained together by Adam on a bounded sample (``PER_LABEL`` texts a label, none over
``MOST_CHARS`` characters); the logit is shifted from the sample's share of labels to that of all labelled rows.
Scoring streams over chunks in blocks of fixed size, so a text's length bounds nothing but its own bytes.

Defined results: a null or empty text is one chunk of padding, scored like any other; without labelled rows every score is 0.5; repeated rows
repeat their result; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import crc_mod_py, map_arrow, read, slices
from .sampling import labelled_texts

CHUNK, STEP = 512, 384
WIDTH, STRIDE = 8, 2
DIM, FILTERS = 8, 24
PER_LABEL = 600
MOST_CHARS = 8_000
EPOCHS, BATCH, RATE = 8, 32, 0.01
MOD, HELD_OUT = 5, 0
PREDICT_ABOVE = 0.3
BLOCK = 256


def chunks(text: bytes) -> np.ndarray:
    """(n, CHUNK) byte codes + 1, zero where padded. Neighbours overlap by CHUNK - STEP bytes; the last one ends with the text."""
    n = max(1, -(-(len(text) - CHUNK) // STEP) + 1) if len(text) > CHUNK else 1
    padded = np.zeros((n - 1) * STEP + CHUNK, np.int16)
    padded[: len(text)] = np.frombuffer(text, np.uint8).astype(np.int16) + 1
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::STEP]


class ByteNet:
    def __init__(self, rng: np.random.Generator):
        self.p = {
            "e": rng.normal(0, 0.5, (257, DIM)),
            "w": rng.normal(0, 1 / np.sqrt(WIDTH * DIM), (WIDTH * DIM, FILTERS)),
            "b": np.zeros(FILTERS),
            "v": rng.normal(0, 0.1, 2 * FILTERS),
            "c": np.zeros(1),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.p["e"][0] = 0
        self.shift = 0.0

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Max-pooled responses of chunks x, and the place each came from."""
        windows = np.lib.stride_tricks.sliding_window_view(x, WIDTH, axis=1)[:, ::STRIDE]
        n, places, _ = windows.shape
        z = self.p["e"][windows].reshape(n * places, WIDTH * DIM) @ self.p["w"]
        z = z.reshape(n, places, FILTERS)
        at = z.argmax(axis=1)
        best = np.take_along_axis(z, at[:, None], axis=1)[:, 0] + self.p["b"]
        return np.maximum(best, 0), at

    def document_vectors(self, pooled: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        sizes = np.diff(np.append(cuts, len(pooled)))[:, None]
        return np.hstack([np.add.reduceat(pooled, cuts) / sizes, np.maximum.reduceat(pooled, cuts)])

    def gradients(self, docs: list[np.ndarray], y: np.ndarray) -> dict[str, np.ndarray]:
        x = np.concatenate(docs)
        sizes = np.array([len(d) for d in docs])
        cuts = np.cumsum(sizes) - sizes
        pooled, at = self.pooled(x)
        u = self.document_vectors(pooled, cuts)
        prob = 1 / (1 + np.exp(-(u @ self.p["v"] + self.p["c"])))
        d = ((prob - y) / len(y)).astype(np.float32)
        du = d[:, None] * self.p["v"]
        owner = np.repeat(np.arange(len(docs)), sizes)
        top = pooled == u[owner, FILTERS:]
        ties = np.add.reduceat(top.astype(np.float32), cuts)  # chunks overlap, so a maximum may be met twice
        dp = du[owner, :FILTERS] / sizes[owner][:, None] + np.where(top, du[owner, FILTERS:] / ties[owner], 0)
        dp = dp * (pooled > 0)
        # only the place that won the pooling has a gradient
        rows, cols = np.nonzero(dp)
        start = at[rows, cols] * STRIDE
        taken = x[rows[:, None], start[:, None] + np.arange(WIDTH)]
        inputs = self.p["e"][taken].reshape(len(rows), -1)
        g = dp[rows, cols]
        gw, ge = np.zeros_like(self.p["w"]), np.zeros_like(self.p["e"])
        for f in range(FILTERS):
            own = cols == f
            gw[:, f] = g[own] @ inputs[own]
        np.add.at(ge, taken.ravel(), (g[:, None] * self.p["w"][:, cols].T).reshape(-1, DIM))
        ge[0] = 0
        gb = np.bincount(cols, g, FILTERS).astype(np.float32)
        return {"e": ge, "w": gw, "b": gb, "v": u.T @ d + 1e-4 * self.p["v"], "c": np.array([d.sum()], np.float32)}

    def logits(self, texts: list[bytes]) -> np.ndarray:
        total, high, sizes = np.zeros((len(texts), FILTERS)), np.zeros((len(texts), FILTERS)), np.zeros(len(texts))
        waiting: list[np.ndarray] = []
        owners: list[np.ndarray] = []
        held = 0

        def flush():
            x, own = np.concatenate(waiting), np.concatenate(owners)
            cuts = np.flatnonzero(np.diff(own, prepend=-1))
            pooled, _ = self.pooled(x)
            total[own[cuts]] += np.add.reduceat(pooled, cuts)
            high[own[cuts]] = np.maximum(high[own[cuts]], np.maximum.reduceat(pooled, cuts))
            waiting.clear()
            owners.clear()

        for i, t in enumerate(texts):
            c = chunks(t)
            sizes[i] = len(c)
            for a in range(0, len(c), BLOCK):
                part = c[a : a + BLOCK]
                waiting.append(part)
                owners.append(np.full(len(part), i))
                held += len(part)
                if held >= BLOCK:
                    flush()
                    held = 0
        if waiting:
            flush()
        u = np.hstack([total / np.maximum(sizes, 1)[:, None], high])
        return u @ self.p["v"] + self.p["c"] + self.shift

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits([(x or "").encode("utf-8", "surrogatepass") for x in texts]), -60, 60)))


class Adam:
    def __init__(self, p: dict[str, np.ndarray], rate: float):
        self.p, self.rate, self.t = p, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in p.items()}
        self.s = {k: np.zeros_like(v) for k, v in p.items()}

    def step(self, g: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, v in g.items():
            self.m[k] += 0.1 * (v - self.m[k])
            self.s[k] += 0.001 * (v * v - self.s[k])
            self.p[k] -= self.rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.s[k] / (1 - 0.999**self.t)) + 1e-8)


def prior_shift(y: np.ndarray, sizes: dict) -> float:
    """What takes a logit from the sample's share of label 1 to the share in all labelled rows."""
    here, there = np.array([(y == 0).sum(), (y == 1).sum()]) + 0.5, np.array([sizes.get(0, 0), sizes.get(1, 0)]) + 0.5
    return float(np.log(there[1] / there[0]) - np.log(here[1] / here[0]))


def fit(texts: list[str], labels: list[int], sizes: dict, epochs: int = EPOCHS) -> ByteNet:
    rng = np.random.default_rng(11)
    net = ByteNet(rng)
    y = np.array(labels, np.float32)
    if not len(y):
        net.p["v"][:] = 0
        return net
    docs = [chunks(x.encode("utf-8", "surrogatepass")) for x in texts]
    adam = Adam(net.p, RATE)
    steps = epochs * -(-len(y) // BATCH)
    done = 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for a in range(0, len(y), BATCH):
            own = order[a : a + BATCH]
            adam.rate = RATE * (1 - 0.9 * done / steps)
            adam.step(net.gradients([docs[i] for i in own], y[own]))
            done += 1
    net.shift = prior_shift(y, sizes)
    return net


def train(docs: DataFrame, labels: DataFrame) -> ByteNet:
    got, sizes = labelled_texts(docs, labels, "quality", MOD, HELD_OUT, PER_LABEL, MOST_CHARS)
    return fit(got["text"].to_pylist(), got["quality"].to_pylist(), sizes)


def score_documents(docs: DataFrame, net: ByteNet) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 4 << 20):
            ids = part.column("doc_id").to_pylist()
            score = net.scores(part.column("text").to_pylist())
            columns = [pa.array(ids, pa.int64()), pa.array(crc_mod_py(ids, MOD) == HELD_OUT), pa.array(score.astype(np.float64)), pa.array((score >= PREDICT_ABOVE).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "score", "predicted"])

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, held_out boolean, score double, predicted int")


def op8_quality_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return score_documents(docs, train(docs, read(spark, sf_dir, "labels")))
