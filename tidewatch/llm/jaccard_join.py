"""Operator 5: exact n-gram Jaccard join with adaptive multi-match prefixes.

A document is the set of its distinct word shingles, held as 64-bit hashes. Two documents with Jaccard similarity t or more share
at least l tokens among the first n - ceil(t n) + l tokens of each, in any order of tokens common to all, for every l. The
order here puts the tokens that recur most last. Each document picks its own l: a longer prefix costs more postings,
but only partners that share min(l_x, l_y) prefix tokens are verified, so l is where postings plus expected
verifications, both estimated from the counts of its prefix tokens, are cheapest.

1. Documents with the same set are one class; only its smallest id goes on.
2. Counts of tokens (over the part of every document that can become prefix) give the order: a table of fixed size holds the
   logarithm of the counts of the most frequent tokens. Whatever it holds, the order is the same for all documents,
   so results don't depend on it.
3. Prefixes are written once; tokens of one document alone are dropped.
4. In each token's list the most typical document is a pivot: all others are verified against it, which joins groups of near copies in
   a number of pairs that grows with the group, not with its square.
5. What is left is exact: in tokens whose list still spans several components, documents of different components are
   compared by parity bitmaps of their sets. As bitmaps differ in no more bits than sets do in tokens, a pair whose bitmaps
   differ too much can't reach the threshold. Short lists (``SHORT_LIST`` at most) put out their pairs, which are verified on
   their texts if they share enough tokens. Long lists are cut by set size (documents of sizes too far apart never meet)
   and into blocks of bounded rows and bytes, two of which make a cell. A cell counts the shared prefix tokens of a pair itself and
   takes only pairs whose smallest shared token is its own, so that no pair is compared in full twice. It puts out the documents that
   have such a partner, one row each; with their sets they meet again, are compared in full, and only links that join two
   components not joined yet leave the task: fewer rows than documents, however many links there are.

Fixed-size bitmaps only save shuffling; exact joins follow them. Every step's table goes to the shared folder.

Defined results: a null, empty or wordless text has an empty set and links with nothing; fewer words than a shingle are one shingle;
rows that share a doc_id are one document; a null doc_id links with nothing and has a null component; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_filter, key_filter, map_arrow, map_rows, mix64, read, release, slices, stash
from .components import components
from .tokens import ascii_words

SHINGLE, NUMERATOR = 4, 85
TABLE_BITS = 22
LEAST_LEVEL = 3  # counts below 2**3 aren't worth ordering by
MOST_MATCHES = 8
VERIFY_COST = 4.0
TOKEN_FILTER_BITS = 26
SLICE = 4 << 20
LEAST_BITS, MOST_BITS = 512, 1 << 14
SHORT_LIST = 24
LIST_BLOCK, BLOCK_BYTES = 2048, 16 << 20  # rows of a list and bytes of their sets that make a block
BROADCAST_ROWS = 1 << 18  # 24 bytes each
AT_ONCE = 1 << 21  # words compared at once


SCANNED = ["doc_id", "n", "fp1", "fp2", "token", "c"]


class Shingler:
    def __init__(self, k: int):
        self.k = k
        self.powers = [np.uint64(pow(0x9E3779B97F4A7C15, i, 1 << 64)) for i in range(k, 0, -1)]

    def sets(self, column: pa.Array) -> list[np.ndarray]:
        """The sorted distinct shingle hashes of each text."""
        words, codes, offsets = ascii_words(column)
        table = np.array([xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass").lower()) for w in words], np.uint64) if words else np.zeros(0, np.uint64)
        h = table[codes]
        total, k = len(h), self.k
        s = np.zeros(max(0, total - k + 1), np.uint64)
        for i in range(k):
            s += h[i : i + len(s)] * self.powers[i]
        s = mix64(s)
        out = []
        for a, b in zip(offsets.tolist(), offsets[1:].tolist(), strict=False):
            if b - a >= k:
                out.append(np.unique(s[a : b - k + 1]))
            elif b > a:  # the whole sequence as one, told apart from longer ones by its length
                one = np.uint64(0)
                for x in h[a:b]:
                    one = mix64(np.array([one ^ x]))[0] + np.uint64(b - a)
                out.append(np.array([one], np.uint64))
            else:
                out.append(np.zeros(0, np.uint64))
        return out


def least_overlap(n: int, num: int) -> int:
    return -(-num * n // 100)


def _window(n: int, num: int) -> int:
    """How many of the smallest hashes are counted: half as many again as the longest prefix."""
    return min(n, 3 * (n - least_overlap(n, num) + MOST_MATCHES) // 2)


def choose_prefix(levels: np.ndarray, n: int, num: int) -> tuple[int, int]:
    """(l, prefix length) of least estimated cost, from the levels of the tokens in order."""
    base = n - least_overlap(n, num)
    most = min(MOST_MATCHES, n - base)
    cost = np.cumsum((1 << levels[: base + most].astype(np.int64)) - 0.95)
    l = np.arange(1, most + 1)
    total = cost[base + l - 1] * (1 + VERIFY_COST / l)
    best = int(total.argmin()) + 1
    return best, base + best


def parity_bitmap(x: np.ndarray) -> bytes:
    """As many bits as the set has tokens (a power of two within limits), each the parity of the tokens that fall on it."""
    bits = LEAST_BITS
    while bits < min(len(x), MOST_BITS):
        bits *= 2
    at = (x >> np.uint64(40)).astype(np.int64) % bits
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8)).tobytes()


def _bitmaps(sigs: list[bytes]) -> np.ndarray:
    """The bitmaps in the size of the smallest: halves are laid over each other, which keeps them parities."""
    least = min(map(len, sigs))
    out = np.empty((len(sigs), least // 8), np.uint64)
    for i, sig in enumerate(sigs):
        v = np.frombuffer(sig, np.uint64)
        out[i] = v if len(sig) == least else np.bitwise_xor.reduce(v.reshape(-1, least // 8), axis=0)
    return out


def _may_link(sig_x, sig_y, n_x, n_y, num: int) -> np.ndarray:
    """Whether sizes and bitmaps leave room for the threshold: |x ^ y| <= (1 - t) / (1 + t) * (|x| + |y|)."""
    apart = np.bitwise_count(sig_x ^ sig_y).sum(axis=-1, dtype=np.int64)
    near = (apart * (100 + num) <= (100 - num) * (n_x + n_y)) & (100 * np.minimum(n_x, n_y) >= num * np.maximum(n_x, n_y))
    return near


def scanned(docs: DataFrame, k: int, num: int) -> DataFrame:
    """Two kinds of rows from one pass over the texts: (doc_id, n, fp1, fp2), the size and 128-bit fingerprint of each row's set,
    and where ``c`` is not null, (token, c): how many sets of a part hold a token in what can become prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(k)
        for part in slices(batches, "text", SLICE):
            sets = shingler.sets(part.column("text"))
            fp = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x.tobytes()) for x in sets), "<i8").reshape(-1, 2)
            none = pa.nulls(len(sets), pa.int64())
            columns = [part.column("doc_id").cast(pa.int64()), pa.array([len(x) for x in sets], pa.int64()), pa.array(fp[:, 0].copy()), pa.array(fp[:, 1].copy()), none, none]
            yield pa.RecordBatch.from_arrays(columns, names=SCANNED)
            found = [x[: _window(len(x), num)] for x in sets if len(x)]
            if found:
                token, c = np.unique(np.concatenate(found), return_counts=True)
                none = pa.nulls(len(token), pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array(token.view(np.int64)), pa.array(c.astype(np.int64))], names=SCANNED)

    return map_arrow(docs.select("doc_id", "text"), run, ", ".join(f"{c} long" for c in SCANNED))


def token_levels(counts: DataFrame) -> np.ndarray:
    """The order's table: for each slot of a token's low bits, the logarithm of the largest count of a token there, or 0.

    The tokens of the most frequent levels are entered, as many levels as fill a quarter of the slots at most.
    """
    counted = counts.groupBy("token").agg(F.sum("c").alias("c"))
    level = F.least(F.lit(15), F.floor(F.log2("c") + 1e-9)).cast("int")
    frequent = stash(counted.where(F.col("c") >= 1 << LEAST_LEVEL).select("token", level.alias("level")), "levels")
    sizes = {r["level"]: r["count"] for r in frequent.groupBy("level").count().collect()}  # at most 13 rows
    least, room = 16, 1 << (TABLE_BITS - 2)
    while least > LEAST_LEVEL and sizes.get(least - 1, 0) <= room:
        least -= 1
        room -= sizes.get(least, 0)
    slot = F.col("token").bitwiseAND((1 << TABLE_BITS) - 1).cast("int")
    got = frequent.where(F.col("level") >= least).groupBy(slot.alias("s")).agg(F.max("level").cast("byte").alias("level")).toArrow()
    table = np.zeros(1 << TABLE_BITS, np.uint8)
    if got.num_rows:
        table[got["s"].to_numpy()] = got["level"].to_numpy()
    return table


def prefixes(docs: DataFrame, levels: np.ndarray, copies: np.ndarray, k: int, num: int) -> DataFrame:
    """One row a document with a set: 64 bits of its fingerprint, n, l, how unusual it is, its bitmap, its prefix, and whether its set may have copies."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((levels, copies))  # both of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, bitmap = shared.value
        shingler = Shingler(k)
        mask = np.uint64((1 << TABLE_BITS) - 1)
        for part in slices(batches, "text", SLICE):
            ids, rows, tokens = part.column("doc_id").to_pylist(), [], []
            for doc_id, x in zip(ids, shingler.sets(part.column("text")), strict=True):
                if doc_id is None or not len(x):
                    continue
                lv = table[(x & mask).astype(np.int64)]
                order = np.argsort(lv, kind="stable")  # x ascends, so ties are in hash order
                l, size = choose_prefix(lv[order], len(x), num)
                fp = np.frombuffer(xxhash.xxh3_128_digest(x.tobytes())[:8], "<i8")
                rows.append((doc_id, int(fp[0]), len(x), l, int(1000 * (lv == 0).mean()), bool(in_filter(bitmap, fp.view(np.uint64))[0]), parity_bitmap(x)))
                tokens.append(x[order[:size]].view(np.int64))
            if rows:
                c = list(zip(*rows, strict=True))
                ends = np.cumsum([0, *(len(t) for t in tokens)])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(tokens)))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary())
                yield pa.RecordBatch.from_arrays([*(pa.array(v, kind) for v, kind in zip(c, kinds, strict=True)), lists], names=["doc", "fp", "n", "l", "odd", "maybe_copy", "sig", "tokens"])

    return map_arrow(docs.select("doc_id", "text"), run, "doc long, fp long, n long, l int, odd int, maybe_copy boolean, sig binary, tokens array<long>")


def postings(prefix: DataFrame) -> DataFrame:
    """(token, doc, fp, n, l, odd) of the tokens that several documents' prefixes hold (and a few more)."""
    listed = prefix.select(F.explode("tokens").alias("token"))
    several = listed.groupBy("token").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > 1)
    bitmap = prefix.sparkSession.sparkContext.broadcast(key_filter(several, "token", TOKEN_FILTER_BITS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("tokens")
            if not batch.num_rows:
                continue
            offsets = lists.offsets.to_numpy()
            tokens = lists.values.to_numpy()[offsets[0] : offsets[-1]]
            keep = in_filter(bitmap.value, tokens.view(np.uint64))
            owner = np.repeat(np.arange(batch.num_rows), np.diff(offsets))[keep]
            columns = [pa.array(tokens[keep]), *(batch.column(x).take(pa.array(owner)) for x in ("doc", "fp", "n", "l", "odd"))]
            yield pa.RecordBatch.from_arrays(columns, names=["token", "doc", "fp", "n", "l", "odd"])

    return map_arrow(prefix.select("doc", "fp", "n", "l", "odd", "tokens"), run, "token long, doc long, fp long, n long, l int, odd int")


def _near_enough(num: int):
    return 100 * F.least("n_x", "n_y") >= num * F.greatest("n_x", "n_y")


def _matched(rows: DataFrame) -> DataFrame:
    """Pairs (x, y) with enough shared prefix tokens, of rows (x, y, l_x, l_y), one a shared token."""
    return rows.groupBy("x", "y").agg(F.count(F.lit(1)).alias("m"), F.min(F.least("l_x", "l_y")).alias("l")).where(F.col("m") >= F.col("l")).select("x", "y")


def pivot_pairs(post: DataFrame, num: int) -> DataFrame:
    pivot = post.groupBy("token").agg(F.min(F.struct("odd", "doc", "n", "l")).alias("p"), F.count(F.lit(1)).alias("c")).where(F.col("c") > 1)
    rows = post.join(pivot, "token").where(F.col("doc") != F.col("p.doc"))
    rows = rows.select(F.col("p.doc").alias("x"), F.col("doc").alias("y"), F.col("p.n").alias("n_x"), F.col("n").alias("n_y"), F.col("p.l").alias("l_x"), F.col("l").alias("l_y"))
    pairs = _matched(rows.where(_near_enough(num)))
    return pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()


def spanning_lists(post: DataFrame, component: DataFrame) -> DataFrame:
    """(token, doc, fp, n, l, comp, c) of the tokens whose list of ``c`` documents spans several components."""
    own = post.join(component.select(F.col("u").alias("doc"), F.col("v").alias("comp")), "doc", "left")
    own = own.select("token", "doc", "fp", "n", "l", F.coalesce("comp", "doc").alias("comp"))
    spans = own.groupBy("token").agg(F.min("comp").alias("a"), F.max("comp").alias("b"), F.count(F.lit(1)).alias("c")).where(F.col("a") < F.col("b"))
    return own.join(spans.select("token", "c"), "token")


def short_pairs(spanning: DataFrame, signatures: DataFrame, num: int) -> DataFrame:
    """Pairs of different components that meet in a short list, may share enough prefix tokens and have bitmaps near enough.

    ``long`` counts the long lists a document is in: what a pair shares there isn't counted here, so it may be that many.
    """
    long = spanning.where(F.col("c") > SHORT_LIST).groupBy("doc").agg(F.count(F.lit(1)).alias("long"))
    rows = spanning.where(F.col("c") <= SHORT_LIST).join(long, "doc", "left").join(signatures.select("doc", "fp", "sig"), ["doc", "fp"])
    dealt = rows.select("token", "doc", "n", "l", "comp", F.coalesce("long", F.lit(0)).alias("long"), "sig").repartition(F.col("token")).sortWithinPartitions("token")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _whole_groups(batches, ["token"]):
            token, doc, n, l, comp, more = (group[c].to_numpy() for c in ("token", "doc", "n", "l", "comp", "long"))
            sig = _bitmaps(group["sig"].to_pylist())
            left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for d in range(1, SHORT_LIST):  # row r with row r + d of the same list
                a = np.flatnonzero((token[:-d] == token[d:]) & (comp[:-d] != comp[d:])) if d < len(token) else left[0]
                a = a[_may_link(sig[a], sig[a + d], n[a], n[a + d], num)]
                left.append(a)
                right.append(a + d)
            a, b = np.concatenate(left), np.concatenate(right)
            columns = [np.minimum(doc[a], doc[b]), np.maximum(doc[a], doc[b]), np.minimum(l[a], l[b]), np.minimum(more[a], more[b])]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["x", "y", "l", "long"])

    rows = map_arrow(dealt, run, "x long, y long, l int, long long")
    pairs = rows.groupBy("x", "y").agg(F.count(F.lit(1)).alias("m"), F.min("l").alias("l"), F.min("long").alias("long"))
    return pairs.where(F.col("m") + F.col("long") >= F.col("l")).select("x", "y")


CELL = ["token", "low", "i", "next", "j"]


def cells(spanning: DataFrame, signatures: DataFrame, num: int) -> DataFrame:
    """The rows of long lists, dealt to cells: block ``i`` of size class ``low`` with block ``j`` of that class or the next.

    Sizes that may link differ by one class at most. ``side`` says which block a row is of.
    """
    step = float(-np.log(num / 100)) + 1e-6
    rows = spanning.where(F.col("c") > SHORT_LIST).withColumn("size", F.floor(F.log(F.col("n").cast("double")) / step).cast("int"))
    bytes_of = F.sum(F.col("n") * 10) / BLOCK_BYTES  # a set, its prefix and its bitmap
    blocks = rows.groupBy("token", "size").agg(F.greatest(F.ceil(F.count(F.lit(1)) / LIST_BLOCK), F.ceil(bytes_of)).cast("int").alias("k"))
    # each class with the number of blocks of its neighbours
    near = blocks.select("token", F.explode(F.array(*[F.struct((F.col("size") - d).alias("size"), F.lit(d).alias("d"), F.col("k").alias("k")) for d in (-1, 0, 1)])).alias("b")).select("token", "b.*")
    near = near.groupBy("token", "size").agg(*[F.max(F.when(F.col("d") == d, F.col("k"))).alias(name) for d, name in ((0, "k"), (-1, "below"), (1, "above"))])
    near = stash(near.where(F.col("k").isNotNull()), "blocks")
    near = F.broadcast(near) if near.count() <= BROADCAST_ROWS else near  # a list may hold most rows: don't deal them by it
    rows = rows.join(near, ["token", "size"]).withColumn("mine", F.pmod(F.xxhash64("doc"), F.col("k")).cast("int"))
    upto = lambda k: F.when(F.col(k) > 0, F.sequence(F.lit(0), F.col(k) - 1)).otherwise(F.array().cast("array<int>"))
    mine = F.col("mine")
    cell = lambda low, i, nxt, j, side: F.struct(low.alias("low"), i.alias("i"), F.lit(nxt).alias("next"), j.alias("j"), side.alias("side"))
    own = F.transform(upto("k"), lambda o: cell(F.col("size"), F.least(mine, o), 0, F.greatest(mine, o), (mine > o).cast("int")))
    above = F.transform(upto("above"), lambda o: cell(F.col("size"), mine, 1, o, F.lit(0)))
    below = F.transform(upto("below"), lambda o: cell(F.col("size") - 1, o, 1, mine, F.lit(1)))
    rows = rows.join(signatures.select("doc", "fp", "sig", "tokens"), ["doc", "fp"])
    rows = rows.withColumn("cell", F.explode(F.concat(own, above, below)))
    return rows.select("token", "cell.*", "doc", "fp", "n", "l", "comp", "sig", "tokens")


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition(*[F.col(c) for c in CELL]).sortWithinPartitions(*CELL)


def partnered(dealt: DataFrame, num: int) -> DataFrame:
    """(cell, side, doc, fp): the documents that have a partner in their cell, by bitmaps and shared prefix tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in _each_cell(batches):
            a, b = _partners(cell, num)
            if len(a):
                yield cell.select([*CELL, "side", "doc", "fp"]).take(pa.array(np.unique(np.concatenate([a, b])))).combine_chunks().to_batches()[0]

    return map_arrow(_dealt(dealt), run, "token long, low int, i int, next int, j int, side int, doc long, fp long")


def forest(dealt: DataFrame, num: int) -> DataFrame:
    """Links (x, y) of a spanning forest of each cell's documents, whose sets are given; what a component joins already is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in _each_cell(batches):
            a, b = _partners(cell, num)
            if not len(a):
                continue
            doc, comp = cell["doc"].to_numpy(), cell["comp"].to_numpy()
            sets = [np.frombuffer(x, np.uint64) for x in cell["set"].to_pylist()]
            root: dict[int, int] = {}

            def find(x: int, root: dict[int, int] = root) -> int:
                while root.get(x, x) != x:
                    root[x] = root.get(root[x], root[x])
                    x = root[x]
                return x

            links = []
            for p, q in zip(a.tolist(), b.tolist(), strict=True):
                u, v = find(int(comp[p])), find(int(comp[q]))
                if u != v and _linked(sets[p], sets[q], num):
                    root[max(u, v)] = min(u, v)
                    links.append((p, q))
            if links:
                x, y = doc[[p for p, _ in links]], doc[[q for _, q in links]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["x", "y"])

    return map_arrow(_dealt(dealt), run, "x long, y long")


def _linked(a: np.ndarray, b: np.ndarray, num: int) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common > 0 and 100 * common >= num * (len(a) + len(b) - common)


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables that end where a group of equal keys ends; a group is of bounded size."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if held and any(held[-1].column(k)[-1].as_py() != batch.column(k)[0].as_py() for k in keys):
            yield pa.Table.from_batches(held)
            held = []
        held.append(batch)
        values = np.stack([batch.column(k).to_numpy() for k in keys])
        change = np.flatnonzero((values[:, 1:] != values[:, :-1]).any(axis=0))
        if len(change):
            cut = int(change[-1]) + 1
            yield pa.Table.from_batches([*held[:-1], batch.slice(0, cut)])
            held = [batch.slice(cut)]
    if held:
        yield pa.Table.from_batches(held)


def _each_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    for group in _whole_groups(batches, CELL):
        values = np.stack([group[k].to_numpy() for k in CELL])
        cuts = [0, *(np.flatnonzero((values[:, 1:] != values[:, :-1]).any(axis=0)) + 1).tolist(), group.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield group.slice(a, b - a)


def _partners(cell: pa.Table, num: int) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs of a cell (of different blocks, or of its one block) that may link and are this cell's to verify, nearest first."""
    n, l, comp, side = (cell[c].to_numpy().astype(np.int64) for c in ("n", "l", "comp", "side"))
    sig = _bitmaps(cell["sig"].to_pylist())
    one_block = cell["next"][0].as_py() == 0 and cell["i"][0].as_py() == cell["j"][0].as_py()
    order = np.argsort(comp, kind="stable")  # strips of one component leave it out on the other side
    first = order if one_block else order[side[order] == 0]
    second = order if one_block else order[side[order] == 1]
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    at = 0
    while at < len(first) and len(second):
        f = first[at : at + max(1, AT_ONCE // (len(second) * sig.shape[1]))]
        at += len(f)
        other = second[comp[second] != comp[f[0]]] if comp[f[0]] == comp[f[-1]] else second
        ok = _may_link(sig[f][:, None], sig[other][None], n[f][:, None], n[other][None], num) & (comp[f][:, None] != comp[other][None])
        if one_block:
            ok &= f[:, None] < other[None]
        a, b = np.nonzero(ok)
        left.append(f[a])
        right.append(other[b])
    a, b = np.concatenate(left), np.concatenate(right)
    if not len(a):
        return a, b
    lists = cell["tokens"].combine_chunks()
    offsets = lists.offsets.to_numpy().astype(np.int64)
    tokens, codes = np.unique(lists.values.to_numpy()[offsets[0] : offsets[-1]], return_inverse=True)
    own, offsets = int(np.searchsorted(tokens, cell["token"][0].as_py())), offsets - offsets[0]
    size = np.diff(offsets)
    wide = np.maximum(size[a], size[b])
    by_width = np.argsort(wide, kind="stable")
    keep = np.zeros(len(a), bool)
    at = 0
    while at < len(by_width):
        count = max(1, AT_ONCE // (2 * int(wide[by_width[at]])))
        while count > 1 and count * int(wide[by_width[min(at + count, len(by_width)) - 1]]) > AT_ONCE:
            count //= 2
        some = by_width[at : at + count]
        at += len(some)
        w = int(wide[some].max())
        place = np.arange(w)
        both = [np.where(place < size[r][:, None], codes[np.minimum(offsets[r][:, None] + place, len(codes) - 1)], -1) for r in (a[some], b[some])]
        row = np.sort(np.hstack(both), axis=1)
        same = (row[:, 1:] == row[:, :-1]) & (row[:, 1:] >= 0)
        smallest = row[np.arange(len(some)), same.argmax(axis=1)]
        keep[some] = (same.sum(axis=1) >= np.minimum(l[a[some]], l[b[some]])) & (smallest == own)
    a, b = a[keep], b[keep]
    near = np.argsort(np.bitwise_count(sig[a] ^ sig[b]).sum(axis=1), kind="stable")
    return a[near], b[near]


def only(docs: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """(doc_id, text) of rows whose id may be among ``ids``: a fixed-size bitmap of hashed ids, tested on the way."""
    bitmap = docs.sparkSession.sparkContext.broadcast(key_filter(ids.select(F.xxhash64(column).alias("key")), "key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = pa.array(in_filter(bitmap.value, batch.column("key").to_numpy().view(np.uint64)))
            yield batch.select(["doc_id", "text"]).filter(hit)

    return map_arrow(docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text", F.xxhash64("doc_id").alias("key")), run, "doc_id long, text string")


def _ids(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("x").alias("id")).unionByName(pairs.select(F.col("y").alias("id")))


def verified(texts: DataFrame, pairs: DataFrame, k: int, num: int) -> DataFrame:
    """The pairs (x, y) whose texts' sets reach the threshold."""
    both = pairs.join(texts.select(F.col("doc_id").alias("x"), F.col("text").alias("text_x")), "x")
    both = both.join(texts.select(F.col("doc_id").alias("y"), F.col("text").alias("text_y")), "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(k)
        for whole in batches:
            for part in slices(iter([whole]), "text_x", SLICE):
                for batch in slices(iter([part]), "text_y", SLICE):
                    code = batch.column("text_x").dictionary_encode()  # a pivot meets many
                    left, right = shingler.sets(code.dictionary), shingler.sets(batch.column("text_y"))
                    ok = []
                    for c, b in zip(code.indices.to_pylist(), right, strict=True):
                        ok.append(_linked(left[c], b, num))
                    yield batch.select(["x", "y"]).filter(pa.array(ok, pa.bool_()))

    return map_arrow(both.select("x", "y", "text_x", "text_y"), run, "x long, y long").distinct()


def set_bytes(texts: DataFrame, k: int) -> DataFrame:
    """(doc, fp, set): the sorted hashes of the sets of ``texts`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(k)
        for part in slices(batches, "text", SLICE):
            sets = [x.tobytes() for x in shingler.sets(part.column("text"))]
            fp = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x)[:8] for x in sets), "<i8")
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fp), pa.array(sets, pa.binary())], names=["doc", "fp", "set"])

    return map_arrow(texts, run, "doc long, fp long, set binary").groupBy("doc", "fp").agg(F.min("set").alias("set"))


def long_links(texts: DataFrame, found: DataFrame, spanning: DataFrame, signatures: DataFrame, k: int, num: int) -> DataFrame:
    """Links of documents that are partners in long lists, enough of them to join all components that any of these links joins."""
    comp = spanning.where(F.col("c") > SHORT_LIST).select("doc", "comp").distinct()
    rows = found.join(comp, "doc").join(signatures.select("doc", "fp", "n", "l", "sig", "tokens"), ["doc", "fp"]).join(set_bytes(texts, k), ["doc", "fp"])
    return forest(rows.select(*CELL, "side", "doc", "n", "l", "comp", "sig", "tokens", "set"), num)


def jaccard_components(docs: DataFrame, k: int = SHINGLE, num: int = NUMERATOR) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs`` (doc_id, text); similarity num/100 or more links."""
    docs = docs.select("doc_id", "text")
    scan = stash(scanned(docs, k, num), "scan")
    sets = stash(scan.where(F.col("c").isNull()).select("doc_id", "n", "fp1", "fp2"), "sets")
    levels = token_levels(scan.where(F.col("c").isNotNull()).select("token", "c"))
    release(scan)  # one row a token and part: the largest table here, and not needed again
    usable = sets.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    classes = stash(usable.groupBy("fp1", "fp2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("c")), "classes")
    several = classes.where(F.col("c") > 1)
    member = stash(usable.join(several, ["fp1", "fp2"]).where(F.col("doc_id") != F.col("rep")).select("doc_id", "fp1", "rep").distinct(), "members")
    prefix = stash(prefixes(docs, levels, key_filter(several, "fp1"), k, num), "prefixes")
    copies = prefix.where("maybe_copy").join(member.select(F.col("doc_id").alias("doc"), F.col("fp1").alias("fp")), ["doc", "fp"], "left_anti").dropDuplicates(["doc", "fp"])
    single = prefix.where("not maybe_copy").unionByName(copies)
    post = stash(postings(single), "postings")
    tried = stash(pivot_pairs(post, num), "pivot-pairs")
    near = stash(verified(stash(only(docs, _ids(tried), "id"), "texts"), tried, k, num), "near")
    copies_of = member.select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    component = stash(components(near.select(F.col("x").alias("u"), F.col("y").alias("v"))), "components")
    spanning = stash(spanning_lists(post, component), "spanning")
    rest = stash(short_pairs(spanning, single, num).join(tried, ["x", "y"], "left_anti"), "short-pairs")
    found = stash(partnered(cells(spanning, single, num), num), "partnered")
    texts = stash(only(docs, _ids(rest).unionByName(found.select(F.col("doc").alias("id"))), "id"), "texts")
    far = stash(verified(texts, rest, k, num).unionByName(long_links(texts, found, spanning, single, k, num)), "far")
    links = near.unionByName(far).select(F.col("x").alias("u"), F.col("y").alias("v"))
    # an id whose rows differ belongs to the classes of all of them
    several_sets = usable.groupBy("doc_id").agg(F.min("fp1").alias("a"), F.max("fp1").alias("b")).where(F.col("a") < F.col("b"))
    links = links.unionByName(member.join(several_sets, "doc_id").select(F.col("doc_id").alias("u"), F.col("rep").alias("v")))
    component = stash(components(links), "components")
    # copies take their class's component; a class that links with no other is its own
    of = copies_of.join(component.select(F.col("u").alias("v"), F.col("v").alias("root")), "v", "left").select(F.col("u").alias("doc_id"), F.coalesce("root", "v").alias("root"))
    of = of.unionByName(component.select(F.col("u").alias("doc_id"), F.col("v").alias("root"))).groupBy("doc_id").agg(F.min("root").alias("root"))
    return sets.join(of, "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``docs``, one for each component of ``found`` (that of the smallest id); all columns stay.

    Of rows that share an id the one with the smallest text stays. Rows without an id all stay.
    """
    gone = stash(found.where(F.col("component_id") != F.col("doc_id")).select("doc_id").distinct(), "gone")
    again = stash(found.where(F.col("doc_id").isNotNull()).groupBy("doc_id").count().where(F.col("count") > 1).select("doc_id"), "again")
    bitmap = docs.sparkSession.sparkContext.broadcast(key_filter(gone.unionByName(again).select(F.xxhash64("doc_id").alias("key")), "key"))
    schema = docs.schema
    key = "key"
    while key in docs.columns:
        key += "_"

    def split(maybe: bool):
        def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            hit = in_filter(bitmap.value, batch.column(key).to_numpy().view(np.uint64))
            hit &= batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)  # rows without an id all stay
            yield batch.drop_columns([key]).filter(pa.array(hit == maybe))

        return map_rows(docs.withColumn(key, F.xxhash64("doc_id")), run, schema)

    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    unsure = split(True).join(gone, "doc_id", "left_anti")
    unsure = unsure.groupBy("doc_id").agg(F.min_by(row, F.struct(F.col("text"), F.to_json(row))).alias("row"))
    unsure = unsure.select(*[F.col("row")[c].alias(c) for c in docs.columns])
    return split(False).unionByName(unsure)


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read(spark, sf_dir, "documents"))
