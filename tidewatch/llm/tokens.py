"""Ids of whole texts by a tokenizer file, each distinct space-delimited chunk of a task being encoded once.

The byte-level pattern `` ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+`` starts a new match at every single space
between two characters that aren't white space, and no merge crosses matches. So a text may be cut there, and the ids of
its chunks, each with its leading space, are the ids of the text. Spaces next to other white space are never cut at.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# A superset of what any of the libraries counts as white space: cutting less is always exact.
_WS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_UNSAFE = rf"^ | $|{_WS} | {_WS}"
#: Bytes of text whose distinct chunks are encoded together.
ENCODE_BYTES = 24 << 20
_PY_WS = "\\s\x85\u180e\u200b"
_SAFE_CUT = re.compile(f"(?<=[^{_PY_WS}]) (?=[^{_PY_WS}])")


def public_vocabulary(name: str) -> str:
    """Where a public tokenizer file lies on this machine (every executor has the same installation)."""
    import public_tokenizers

    return public_tokenizers.path(name)


def chunk_texts(column: pa.Array, safe_only: bool = True) -> tuple[pa.Array, np.ndarray]:
    """Chunks of all texts in order, and each text's offsets into them. A null text has no chunk.

    safe_only: cut only between characters that aren't white space; otherwise at every space.
    """
    column = column.cast(pa.large_string())
    empty = pa.array([[]], pa.large_list(pa.large_string()))
    filled = pc.fill_null(column, "")
    unsafe = pc.match_substring_regex(filled, _UNSAFE).to_numpy(zero_copy_only=False) if safe_only else np.zeros(len(column), bool)
    if not len(column):
        return empty.flatten(), np.zeros(1, np.int64)
    lists = pc.split_pattern(filled, " ")
    flat, offsets = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    if unsafe.any():
        parts, sizes = [], np.diff(offsets)
        last = 0
        for i in np.flatnonzero(unsafe):
            parts.append(flat.slice(offsets[last], offsets[i] - offsets[last]))
            own = _SAFE_CUT.split(filled[int(i)].as_py())
            parts.append(pa.array(own, pa.large_string()))
            sizes[i], last = len(own), i + 1
        parts.append(flat.slice(offsets[last]))
        flat, offsets = pa.concat_arrays(parts), np.concatenate([[0], np.cumsum(sizes)])
    return flat, offsets


def ragged_take(starts: np.ndarray, sizes: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Concatenate values[starts[i] : starts[i] + sizes[i]] for all i."""
    total = int(sizes.sum())
    ends = np.cumsum(sizes)
    at = np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - sizes), sizes)
    return values[at]


def ascii_words(column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words between ASCII white space, each text's word codes one after another, and the texts' offsets."""
    text = pc.replace_substring_regex(pc.fill_null(column.cast(pa.large_string()), ""), "[\\t\\n\\x0b\\x0c\\r]", " ")
    lists = pc.split_pattern(text, " ")
    if not len(column):
        return [], np.zeros(0, np.int64), np.zeros(1, np.int64)
    flat, offsets = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    coded = flat.dictionary_encode()
    words, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
    if "" in words:  # white space next to white space or at a text's ends
        keep = codes != words.index("")
        offsets = np.concatenate([[0], np.cumsum(keep)])[offsets]
        codes = codes[keep]
    return words, codes, offsets


class ChunkEncoder:
    """Encodes texts with a byte-level tokenizer of the tokenizers library, each distinct chunk of a block of texts once."""

    group = 128

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        # bytes that each id stands for, to find chunk ends in the ids of many chunks encoded at once
        size = self.tok.get_vocab_size(with_added_tokens=True)
        added = self.tok.get_added_tokens_decoder()
        self.width = np.array([len(added[i].content.encode()) if i in added else len(self.tok.id_to_token(i) or "") for i in range(size)], np.int64)

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def _encode_chunks(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks, each with a space before it, and the chunks' sizes in ids."""
        width = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        n = len(words)
        cuts = np.append(np.arange(0, n, self.group), n).astype(np.int64)
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), words), pa.scalar(" ", pa.large_string())).to_pylist()
        tables, sizes = [], np.zeros(n, np.int64)
        for g in range(0, len(joined), 64):
            for k, got in enumerate(self.tok.encode_batch_fast([" " + x for x in joined[g : g + 64]], add_special_tokens=False), g):
                a, b = int(cuts[k]), int(cuts[k + 1])
                ids = np.array(got.ids, dtype="<u4")
                ends, at = np.cumsum(width[a:b]), np.cumsum(self.width[ids])
                cut = np.searchsorted(at, ends, side="left") + 1
                if len(at) and at[-1] == ends[-1] and np.array_equal(at[cut - 1], ends):
                    sizes[a:b] = np.diff(cut, prepend=0)
                else:  # a token's text doesn't match the bytes it came from: chunk by chunk
                    own = [self._ids(" " + x) for x in words.slice(a, b - a).to_pylist()]
                    sizes[a:b], ids = [len(x) for x in own], np.concatenate(own)
                tables.append(ids)
        return np.concatenate(tables) if tables else np.zeros(0, np.uint32), sizes

    def encode(self, column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Yield (first row, row after the last, ids of those rows' texts, offsets of each text into them).

        A yield holds the rows of about ``most`` chunks.
        """
        flat, offsets = chunk_texts(column)
        n = len(offsets) - 1
        coded = flat.dictionary_encode()
        words, codes = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        del flat, coded
        table, sizes = self._encode_chunks(words)
        first = offsets[:-1][np.diff(offsets) > 0]
        heads, head_codes = np.unique(codes[first], return_inverse=True)  # no space before a text's first chunk
        own = [self._ids(x) for x in words.take(pa.array(heads)).to_pylist()]
        codes[first] = len(words) + head_codes
        sizes = np.concatenate([sizes, np.array([len(x) for x in own], np.int64)])
        table = np.concatenate([table, *own])
        starts = np.cumsum(sizes) - sizes
        lo = 0
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1)
            part = codes[offsets[lo] : offsets[hi]]
            per = sizes[part]
            ends = np.concatenate([[0], np.cumsum(per)])
            yield lo, hi, ragged_take(starts[part], per, table), ends[offsets[lo : hi + 1] - offsets[lo]]
            lo = hi


@lru_cache(maxsize=4)
def chunk_encoder(path: str) -> ChunkEncoder:
    """One encoder for a worker process."""
    return ChunkEncoder(path)
