"""Operator 6: exact top-k by inner product with a dual-tree search over cover trees.

Each task holds a block of its candidates as a cover tree and walks it together with a cover tree of a block of queries. A node's children
are centred on points more than a scale apart and hold what lies within that scale, which shrinks by ``BASE`` from level to
level; the node's own centre is the first of them. Points that no ball of ``LEAST_BALL`` points holds stay together in a
leaf of their parent, and up to ``LEAF`` points are not split further, so a leaf holds dozens of points.

For a query node (centre q, radius a) and a data node (centre x, radius b) no pair below scores more than
q.x + a|x| + b|q| + ab, nor more than the product of the largest norms; the pair is dropped if that lies below the worst kth score of the query node's
members, which are a run of rows. A query node carries the data nodes that are left for it; at a query leaf the
data leaves are taken by falling bound, thousands of points in one matrix product, and what the kth scores found rule out is dropped
before the next product; queries of a leaf that need different data leaves go on one by one. Before the walk the kth best score of each query over a spread of candidates is a
first bound. Scores are exact integers; ties go to the smaller id.

Where vectors are spread evenly over many dimensions (as on random directions) no metric bound can rule anything out; then the
search is a blocked matrix product, whose work grows with queries times candidates.

Queries are a stated set that meets all rows in blocks: they are written to the shared folder in blocks of about ``QUERY_BLOCK``, and tasks read
one block after another from there for every ``HELD_BYTES`` of candidates, so neither side is held whole by anyone. A
task returns at most k rows for each query and held block, and an aggregation keeps the k best of each query.

Defined results: vectors that are null, empty or hold null or non-finite components take no part, as query or candidate; vectors
of another length than the query's don't meet it; repeated ids are candidates of their own (an id is never its own candidate);
fewer than k candidates give all of them; an empty table gives no rows; other columns are not read. Scores are exact while they fit 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fresh_path, map_arrow, read, shared_store

K = 5
QUERY_EVERY = 50
QUERY_BLOCK = 8192
DATA_BLOCK = 16384
HELD_BYTES = 64 << 20
BASE = 1.3
LEAF, LEAST_BALL, MISSES = 48, 16, 32
QUERY_LEAF, QUERY_BALL = 16, 4  # queries are fewer
SEED = 512  # candidates whose scores are the first bounds
PRODUCT = 1 << 22  # scores computed at once
SCHEMA = "query_id long, vec_id long, score long"
NONE = np.iinfo(np.int64).min
LAST = np.iinfo(np.int64).max


class CoverTree:
    """A cover tree over integer vectors. The points of node i are rows ``low[i]`` to ``high[i]`` of ``points`` and ``ids``."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, leaf: int = LEAF, ball: int = LEAST_BALL):
        self._points, self._square = points, np.einsum("ij,ij->i", points, points)
        centre: list[int] = []
        radius, scale, low, high = [], [], [], []
        kids: list[list[int]] = []
        order: list[np.ndarray] = []
        placed = 0
        todo = [(np.arange(len(points)), 0, np.inf, -1, False)] if len(points) else []
        while todo:  # the last pushed subtree is finished first, so each node's points are a run
            own, c, most, parent, loose = todo.pop()
            d = self._distance(own, c)
            node = len(centre)
            centre.append(c)
            radius.append(float(d.max()))
            scale.append(most)
            low.append(placed)
            high.append(placed + len(own))
            kids.append([])
            if parent >= 0:
                kids[parent].append(node)
            balls, rest = ([], own) if loose or len(own) <= leaf or radius[-1] == 0.0 else self._balls(own, c, d, min(most, radius[-1]) / BASE, ball)
            if not balls:
                order.append(own)
                placed += len(own)
                continue
            if len(rest):
                todo.append((rest, c, most, node, True))
            todo += [(inside, first, min(most, radius[node]) / BASE, node, False) for first, inside in reversed(balls)]
        order = np.concatenate(order) if order else np.zeros(0, np.int64)
        self.points, self.ids = points[order], ids[order]
        self.centres = points[centre] if centre else points[:0]
        self.norm = np.sqrt(self._square[centre]) if centre else np.zeros(0)
        norms = np.sqrt(self._square[order])
        self.radius, self.scale, self.low, self.high = (np.array(x) for x in (radius, scale, low, high))
        if self._square.max(initial=0) >= 1 << 53:  # rounded squares: no ball may be too small
            self.radius = self.radius + 1e-7 * float(norms.max())
        self.most_norm = np.array([norms[a:b].max() for a, b in zip(low, high, strict=True)])
        self.kids = [np.array(k, np.int64) for k in kids]
        self.leaf = np.array([not k for k in kids], bool)
        del self._points, self._square

    def _distance(self, own: np.ndarray, c: int) -> np.ndarray:
        """Distances of points to point c; exact integers below the root."""
        squares = self._square[own] + self._square[c] - 2 * (self._points[own] @ self._points[c])
        return np.sqrt(np.maximum(squares, 0))

    def _balls(self, own: np.ndarray, c: int, d: np.ndarray, scale: float, least: int) -> tuple[list[tuple[int, np.ndarray]], np.ndarray]:
        """Balls of ``scale`` whose centres are more than that apart, first that of c, and the points left over."""
        balls, left, rest, dist, first, misses = [], [], own, d, c, 0
        while len(rest):
            near = dist <= scale
            if near.sum() >= least:
                balls.append((first, rest[near]))
                misses = 0
            else:
                left.append(rest[near])
                misses += 1
            rest = rest[~near]
            if misses == MISSES or not len(rest):
                break
            first = int(rest[0])
            dist = self._distance(rest, first)
        return balls, np.concatenate([*left, rest])


class TopK:
    """The k best (score, id) of each query so far, best first."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score = np.full((n, k), NONE)
        self.id = np.full((n, k), LAST)
        self.floor = np.full(n, -np.inf)  # a score that the kth best can't be below

    def least(self, low: int, high: int) -> np.ndarray:
        kth = self.score[low:high, -1]
        level = kth.astype(np.float64)
        level = np.where(np.abs(level) < 1 << 53, level, level - 1e-15 * np.abs(level))  # never rounded up
        return np.maximum(np.where(kth == NONE, -np.inf, level), self.floor[low:high])

    def offer(self, low: int, scores: np.ndarray, ids: np.ndarray) -> None:
        """scores: of the queries from row ``low`` on with candidates ``ids``; -inf where none."""
        n, c = scores.shape
        level = self.least(low, low + n)
        if c > self.k:
            level = np.maximum(level, np.partition(scores, c - self.k, axis=1)[:, c - self.k])
        row, col = np.nonzero(scores >= np.maximum(level, np.finfo(np.float32).min)[:, None])
        if not len(row):
            return
        rows = np.unique(row)
        old = self.id[low + rows] != LAST
        row = np.concatenate([row, np.repeat(rows, old.sum(axis=1))])
        s = np.concatenate([scores[row[: len(col)], col].astype(np.int64), self.score[low + rows][old]])
        i = np.concatenate([ids[col], self.id[low + rows][old]])
        order = np.lexsort((i, -s, row))
        row, s, i = row[order], s[order], i[order]
        start = np.flatnonzero(np.diff(row, prepend=-1))
        place = np.arange(len(row)) - np.repeat(start, np.diff(np.append(start, len(row))))
        keep = place < self.k
        self.score[low + row[keep], place[keep]], self.id[low + row[keep], place[keep]] = s[keep], i[keep]


def _scores(queries: CoverTree, low: int, high: int, points: np.ndarray, ids: np.ndarray) -> np.ndarray:
    scores = queries.points[low:high] @ points.T
    if scores.dtype == np.int64:
        return np.where(queries.ids[low:high, None] == ids, -np.inf, scores.astype(object))
    scores[queries.ids[low:high, None] == ids] = -np.inf
    return scores


def seed(queries: CoverTree, points: np.ndarray, ids: np.ndarray, best: TopK) -> None:
    """Raise the first bounds to the kth best score over a spread of candidates. They are offered again later."""
    some = np.unique(np.linspace(0, len(ids) - 1, min(len(ids), SEED)).astype(np.int64))
    if len(some) > best.k:
        scores = _scores(queries, 0, len(queries.ids), points[some], ids[some]).astype(np.float64)
        floor = np.partition(scores, len(some) - best.k, axis=1)[:, len(some) - best.k]
        best.floor = np.maximum(best.floor, floor - 1e-15 * np.abs(floor))


def _at_leaf(queries: CoverTree, low: int, high: int, data: CoverTree, nodes: np.ndarray, best: TopK) -> int:
    """Offer the points of data leaves to a run of queries, by falling bound; queries that need different leaves go one by one."""
    points = queries.points[low:high].astype(np.float64)
    own = np.sqrt((points**2).sum(axis=1))
    norms = own[:, None] * data.most_norm[nodes]
    b = np.minimum(points @ data.centres[nodes].T.astype(np.float64) + data.radius[nodes] * own[:, None], norms) + 1e-12 * norms + 1e-6
    need = b >= best.least(low, high)[:, None]
    if high - low > 1 and 2 * need.sum() < need.size:
        return sum(_at_leaf(queries, low + r, low + r + 1, data, nodes[need[r]], best) for r in range(high - low) if need[r].any())
    order = np.argsort(-b.max(axis=0), kind="stable")
    nodes, b, at, room, done = nodes[order], b[:, order], 0, 2048, 0
    most = max(1, PRODUCT // (high - low))
    while at < len(nodes):
        left = at + np.flatnonzero((b[:, at:] >= best.least(low, high)[:, None]).any(axis=0))
        if not len(left):
            break
        size = np.cumsum(data.high[nodes[left]] - data.low[nodes[left]])
        some = left[: max(1, int(np.searchsorted(size, room, side="right")))]
        at, room = int(some[-1]) + 1, max(2048, min(4 * room, most))
        rows = np.concatenate([np.arange(data.low[x], data.high[x]) for x in np.sort(nodes[some])])
        for c in range(0, len(rows), most):
            part = rows[c : c + most]
            best.offer(low, _scores(queries, low, high, data.points[part], data.ids[part]), data.ids[part])
        done += len(rows) * (high - low)
    return done


def dual_search(queries: CoverTree, data: CoverTree, best: TopK) -> int:
    """Offer all candidates that can matter; returns how many scores were computed."""
    if not len(queries.leaf) or not len(data.leaf):
        return 0
    done = 0

    def bounds(q: int, nodes: np.ndarray) -> np.ndarray:
        a, b = queries.radius[q], data.radius[nodes]
        ball = data.centres[nodes].astype(np.float64) @ queries.centres[q].astype(np.float64) + a * data.norm[nodes] + b * queries.norm[q] + a * b
        norms = queries.most_norm[q] * data.most_norm[nodes]
        return np.minimum(ball, norms) + 1e-12 * norms + 1e-6

    todo = [(0, np.zeros(1, np.int64))]
    while todo:
        q, nodes = todo.pop()
        low, high = int(queries.low[q]), int(queries.high[q])
        least = best.least(low, high).min()
        while True:
            b = bounds(q, nodes)
            nodes, b = nodes[b >= least], b[b >= least]
            wide = ~data.leaf[nodes] & (queries.leaf[q] | (data.radius[nodes] >= queries.radius[q]))
            if not wide.any():
                break
            nodes = np.concatenate([nodes[~wide], *(data.kids[x] for x in nodes[wide])])
        if not len(nodes):
            continue
        if not queries.leaf[q]:
            todo += [(int(kid), nodes) for kid in queries.kids[q]]
            continue
        done += _at_leaf(queries, low, high, data, nodes, best)
    return done


def quantised(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): floor(256 * x) of each usable vector."""
    v = F.col("embedding").cast("array<double>")
    usable = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0))
    usable = usable.where(~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    return usable.select("vec_id", F.transform(v, lambda x: F.floor(256 * x)).cast("array<long>").alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, width)


def _exact(points: np.ndarray, others: float) -> np.ndarray:
    """The points in the fastest type that holds their products with vectors of norm ``others`` exactly."""
    most = float(np.sqrt((points.astype(np.float64) ** 2).sum(axis=1).max(initial=0))) * max(others, 1.0)
    return points.astype(np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64)


def _largest(points: np.ndarray) -> float:
    return float(np.sqrt((points.astype(np.float64) ** 2).sum(axis=1).max(initial=0)))


def _by_width(batch, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Width, ids and vectors of the rows of a batch (vec_id, v), ``most`` rows at a time."""
    if not batch.num_rows:
        return
    lists, ids = batch.column("v"), batch.column("vec_id").to_numpy()
    sizes = np.diff(lists.offsets.to_numpy())
    for w in np.unique(sizes).tolist():
        own = np.flatnonzero(sizes == w)
        for a in range(0, len(own), most):
            yield w, ids[own[a : a + most]], _matrix(lists.take(pa.array(own[a : a + most])), w)


def top_k(vectors: DataFrame, query_every: int = QUERY_EVERY, k: int = K, query_block: int = QUERY_BLOCK, data_block: int = DATA_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows of ``vectors`` for each row whose id is divisible by ``query_every``."""
    data = quantised(vectors)
    asked = data.where(F.pmod("vec_id", F.lit(query_every)) == 0)
    n = asked.count()
    blocks = max(1, -(-n // query_block))
    folder = fresh_path(vectors.sparkSession, "queries")
    # rows are dealt by their place, so that copies of one query spread too
    asked = asked.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)).cast("int"))
    asked.write.partitionBy("block").parquet(folder)
    found = map_arrow(data, _searcher(folder, blocks if n else 0, k, data_block), SCHEMA)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.select("query_id", rank.cast("int").alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def _query_block(folder: str, block: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Width, ids and vectors of a block of queries, read from the shared folder."""
    from pyarrow import fs

    store, top = shared_store(folder)
    files = store.get_file_info(fs.FileSelector(f"{top}/block={block}", allow_not_found=True))
    tables = [pq.ParquetFile(store.open_input_file(f.path)).read(columns=["vec_id", "v"]) for f in files if f.path.endswith(".parquet")]
    if tables:
        table = pa.concat_tables(tables).combine_chunks()
        for batch in table.to_batches():
            yield from _by_width(batch, batch.num_rows)


def _searcher(folder: str, blocks: int, k: int, data_block: int):
    def search(held: dict[int, list[tuple[np.ndarray, np.ndarray]]]) -> Iterator[pa.RecordBatch]:
        trees: dict[int, list[CoverTree]] = {}
        for block in range(blocks):
            for w, ids, points in _query_block(folder, block):
                if w not in held:
                    continue
                if w not in trees:
                    trees[w] = [CoverTree(p.astype(np.float64), i) for i, p in held[w]]
                norm = max(_largest(t.points) for t in trees[w])
                queries = CoverTree(points.astype(np.float64), ids, QUERY_LEAF, QUERY_BALL)
                kind = _exact(queries.points, norm).dtype
                queries.points = queries.points.astype(kind)
                best = TopK(len(ids), k)
                first = trees[w][0]
                seed(queries, first.points.astype(kind), first.ids, best)
                for tree in trees[w]:
                    tree.points = tree.points.astype(kind, copy=False)
                    dual_search(queries, tree, best)
                have = best.id != LAST
                rows = np.repeat(queries.ids, have.sum(axis=1))
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(best.id[have], pa.int64()), pa.array(best.score[have], pa.int64())], names=["query_id", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0
        for batch in batches if blocks else ():
            for w, ids, points in _by_width(batch, data_block):
                own = held.setdefault(w, [])
                if own and len(own[-1][0]) + len(ids) <= data_block:
                    own[-1] = (np.concatenate([own[-1][0], ids]), np.concatenate([own[-1][1], points]))
                else:
                    own.append((ids, points))
                size += points.nbytes
            if size >= HELD_BYTES:
                yield from search(held)
                held, size = {}, 0
        if held:
            yield from search(held)

    return run


def op6_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read(spark, sf_dir, "embeddings"))


ORACLE_SQL = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % {QUERY_EVERY} = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= {K}
"""
