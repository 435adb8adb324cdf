"""Operator 3: BPE by a depth-first walk over a trie of the distinct words.

Let ``last(p)`` be the last token of the encoding of prefix p. The encoding of p ends in token t exactly if t is a suffix of
p and the pair ``last(p without t)``, t stays unmerged; that token is unique, as any stretch of an encoding is the
encoding of its own text. So a node of the trie gets its last token from its ancestors, whatever word it belongs to, and
prefixes that words share are computed once. A word's ids follow by walking back from its end. The end of a word is
a symbol of its own (its last character with the end mark), so the closing token is found among the marked tokens.

A pair stays unmerged if no merge across the border comes before the merges that finish its two tokens: their right and left
derivations are compared by rank, the left one first where ranks tie, as merging goes from left to right.

Text is normalised and split by the tokenizer's own normaliser and pre-tokenizer, applied to the distinct chunks between
spaces. Special tokens' strings are found in the raw text first, as the library does by default.

Defined results: a null or empty text has no ids and decodes to the empty string; repeated rows repeat their result; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import map_arrow, read, slices
from .tokens import ENCODE_BYTES, chunk_texts, public_vocabulary, ragged_take

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
_NEVER = 1 << 40
LONG_WORD = 512  # from here on a prefix is kept only as far as a token can reach


class WordTrie:
    """Distinct words as trie nodes in depth-first order: parent, depth and character of each node."""

    def __init__(self, words: list[str]):
        self.words = sorted(set(words))
        self.parent, self.char, self.leaf_of = [-1], [""], {}
        path, before = [0], ""
        for w in self.words:
            shared = len(os.path.commonprefix((before, w)))
            del path[shared + 1 :]
            for c in w[shared:]:
                self.parent.append(path[-1])
                self.char.append(c)
                path.append(len(self.parent) - 1)
            self.leaf_of[w] = path[-1]
            before = w


class TrieBpe:
    """Encoder and decoder of a BPE tokenizer file with an end-of-word suffix (or none)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special_at = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.special_first = sorted({t[0] for t in self.special if t})
        self.strings = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.unknown = self.vocab.get(model.get("unk_token") or "", None)
        # how each token is made: rank, left and right part; the first merge that yields a token counts
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}
        for r, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            left, right = self.vocab[a], self.vocab[b]
            self.rank.setdefault((left, right), r)
            self.made.setdefault(self.vocab[a + b], (r, left, right))
        # tokens that lie within a word, and those that close one, by their characters
        plain = [t for t in self.vocab if not (self.suffix and t.endswith(self.suffix))]
        single = lambda t: len(t) == 1
        self.inner = {t: self.vocab[t] for t in plain if single(t) or self.vocab[t] in self.made}
        if self.suffix:
            cut = len(self.suffix)
            self.closing = {t[:-cut]: i for t, i in self.vocab.items() if t.endswith(self.suffix) and (len(t) - cut == 1 or i in self.made)}
        else:
            self.closing = self.inner
        self.longest = max(map(len, (*self.inner, *self.closing)), default=0)
        self.starts = {t[:k] for t in (*self.inner, *self.closing) for k in range(1, len(t) + 1)}
        self.size = {i: len(t) for t, i in self.inner.items()} | {i: len(t) for t, i in self.closing.items()}
        self.pairs: dict[int, bool] = {}

    def stays(self, a: int, b: int) -> bool:
        """True if tokens a, b side by side are the encoding of their joint text."""
        key = a << 20 | b
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > 3_000_000:
                self.pairs.clear()
            known = self.pairs[key] = self._stays(a, b)
        return known

    def _stays(self, a: int, b: int) -> bool:
        # derivations along the border, from whole token down to symbol, then read upwards
        left, right = [(a, _NEVER)], [(b, _NEVER)]
        while (m := self.made.get(left[-1][0])) is not None:
            left.append((m[2], m[0]))
        while (m := self.made.get(right[-1][0])) is not None:
            right.append((m[1], m[0]))
        i, j = len(left) - 1, len(right) - 1
        while True:
            (x, until_x), (y, until_y) = left[i], right[j]
            crossing = self.rank.get((x, y))
            if crossing is not None and crossing < until_x and crossing <= until_y:
                return False
            if i == 0 and j == 0:
                return True
            if until_x <= until_y:
                i -= 1
            else:
                j -= 1

    def encode_words(self, words: list[str]) -> dict[str, list[int]]:
        """Ids of each distinct word (already split and mapped to the vocabulary's characters)."""
        trie = WordTrie(words)
        n = len(trie.parent)
        last = [-1] * n  # last token of the prefix that ends here
        reach, path, chars, window, long = [0] * n, [0], [], self.longest + 1, LONG_WORD
        closing, starts, stays = self.closing, self.starts, self.stays
        parent, char, leaf_of, find = trie.parent, trie.char, trie.leaf_of, self.inner.get
        depth = [0] * n
        back: dict[str, list[int]] = {}
        leaves = iter(trie.words)
        word = next(leaves, None)
        leaf = leaf_of[word] if word is not None else -1
        prefix = ""
        for node in range(1, n):
            up = parent[node]
            end = d = depth[up] + 1
            depth[node] = d
            del path[d:]
            path.append(node)
            # what a token can reach back to: the prefix, or of a long one its end
            if d <= long:
                prefix = tail = prefix[: d - 1] + char[node]
            else:
                chars[d - 1 - long :] = [char[node]]
                tail = "".join(chars[-window:])
                if len(chars) < window:
                    tail = (prefix + tail)[-window:]
                end = len(tail)
            k = reach[up] + 1  # longest suffix that begins some token
            while k and tail[end - k :] not in starts:
                k -= 1
            reach[node] = k
            for length in range(k, 0, -1):
                t = find(tail[end - length :])
                if t is not None and (length == d or ((b := last[path[d - length]]) >= 0 and stays(b, t))):
                    last[node] = t
                    break
            while leaf == node:
                back[word] = self._close(word, d, k, path, last, closing, stays)
                word = next(leaves, None)
                leaf = leaf_of[word] if word is not None else -1
        return back

    def _close(self, word: str, d: int, k: int, path: list[int], last: list[int], closing, stays) -> list[int]:
        for length in range(k, 0, -1):
            t = closing.get(word[d - length :])
            if t is not None and (length == d or ((b := last[path[d - length]]) >= 0 and stays(b, t))):
                out, at = [t], d - length
                while at > 0:
                    b = last[path[at]]
                    out.append(b)
                    at -= self.size[b]
                return out[::-1]
        return self._by_library(word)

    def _by_library(self, word: str) -> list[int]:
        """A word with a character that the vocabulary lacks: the model itself says what becomes of it."""
        return [x.id for x in self.tok.model.tokenize(word)]

    def _pieces(self, chunks: list[str]) -> list[list[str | int]]:
        """Words of each chunk in order; an int is a special token."""
        out: list[list[str | int]] = [[] for _ in chunks]
        normal, pre = self.tok.normalizer, self.tok.pre_tokenizer
        plain: list[tuple[int, str]] = []
        for i, x in enumerate(chunks):
            if self.special_at and any(c in x for c in self.special_first) and self.special_at.search(x):
                at = 0
                for m in self.special_at.finditer(x):
                    out[i] += self._split(x[at : m.start()], normal, pre)
                    out[i].append(self.special[m.group()])
                    at = m.end()
                out[i] += self._split(x[at:], normal, pre)
            elif x:
                plain.append((i, x))
        for a in range(0, len(plain), 512):
            part = plain[a : a + 512]
            texts = [normal.normalize_str(x) if normal and not (x.isascii() and x.islower()) else x for _, x in part]
            ends = np.cumsum([len(x) + 1 for x in texts]).tolist()
            k = 0
            for w, (_, end) in pre.pre_tokenize_str(" ".join(texts)):
                while end > ends[k]:
                    k += 1
                out[part[k][0]].append(w)
        return out

    @staticmethod
    def _split(x: str, normal, pre) -> list[str]:
        return [w for w, _ in pre.pre_tokenize_str(normal.normalize_str(x) if normal else x)] if x else []

    def encode(self, column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Yield (first row, row after the last, ids, offsets of each text into them)."""
        flat, offsets = chunk_texts(column, safe_only=False)
        coded = flat.dictionary_encode()
        chunks, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
        del flat, coded
        pieces = self._pieces(chunks)
        known = self.encode_words([w for p in pieces for w in p if isinstance(w, str)])
        # most chunks are one word
        ids_of = [known[p[0]] if len(p) == 1 and isinstance(p[0], str) else [t for w in p for t in ((w,) if isinstance(w, int) else known[w])] for p in pieces]
        sizes = np.array([len(x) for x in ids_of], np.int64)
        table = np.array([t for x in ids_of for t in x], "<u4")
        del pieces, known, ids_of
        starts, n, lo = np.cumsum(sizes) - sizes, len(offsets) - 1, 0
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1)
            part = codes[offsets[lo] : offsets[hi]]
            per = sizes[part]
            ends = np.concatenate([[0], np.cumsum(per)])
            yield lo, hi, ragged_take(starts[part], per, table), ends[offsets[lo : hi + 1] - offsets[lo]]
            lo = hi

    @property
    def spellings(self) -> pa.Array:
        """The string of each id."""
        if not hasattr(self, "_spellings"):
            self._spellings = pa.array([self.strings.get(i, "") for i in range(max(self.strings) + 1)], pa.large_string())
        return self._spellings

    def decode_many(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """The texts of stretches of ids as the library decodes them without a decoder: token strings joined by spaces."""
        import pyarrow.compute as pc

        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), self.spellings.take(pa.array(ids)))
        joined = pc.binary_join(lists, pa.scalar(" ", pa.large_string()))
        return joined.cast(pa.large_binary()).to_pylist()


@lru_cache(maxsize=2)
def trie_bpe(path: str) -> TrieBpe:
    return TrieBpe(path)


def encode_documents(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Digests of the ids and of the decoded text of every row of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = trie_bpe(vocabulary)
        for part in slices(batches, "text", ENCODE_BYTES):
            doc_ids = part.column("doc_id")
            for lo, hi, ids, ends in bpe.encode(part.column("text"), 1 << 18):
                at = ends.tolist()
                digests = [hashlib.sha256(ids[a:b].tobytes()).hexdigest() for a, b in zip(at, at[1:], strict=False)]
                decoded = [hashlib.sha256(x).hexdigest() for x in bpe.decode_many(ids, ends)]
                yield pa.RecordBatch.from_arrays([doc_ids.slice(lo, hi - lo).cast(pa.int64()), pa.array(np.diff(ends)), pa.array(digests), pa.array(decoded)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_arrow(docs.select("doc_id", "text"), run, SCHEMA)


def op3_trie_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(read(spark, sf_dir, "documents"), public_vocabulary("word_bpe_49k.json"))
