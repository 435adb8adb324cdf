"""Column lineage: nodes, edges, cycles, impact and root causes over a graph kept as tables.

A node is a key ``namespace:vN:column``; an edge row is src, dst, transformation_type, pipeline_id, confidence, edge_seq. A graph of up to
``SMALL_GRAPH`` edges, and as many roots, is walked in memory after one read of its edges. A larger one is walked by one join a level,
the frontier alone being carried; order within a level comes from a range partitioning, so no level is sorted by one task.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

DEEPEST, SHALLOWEST, DEFAULT_DEPTH = 50, 1, 10
#: fixed values: how an edge was inferred, and how sure that makes it
CONFIDENCE = {"parsed_sql": 1.0, "schema_name_matching": 0.9, "data_type_matching": 0.7, "heuristic": 0.5}
SMALL_GRAPH = 50_000  # edges up to which a walk is done in memory
EDGE = "src string, dst string, transformation_type string, transformation_expr string, pipeline_id string, confidence double, edge_seq long"


class LineageError(ValueError):
    pass


class MissingColumns(LineageError):
    def __init__(self, missing: list[str]):
        super().__init__(f"unknown columns: {missing}")
        self.missing = missing


class CycleFound(LineageError):
    def __init__(self, path: list[str]):
        super().__init__(" -> ".join(path))
        self.path = path


def node_key(namespace: Column, version: Column, column: Column) -> Column:
    return F.concat(namespace, F.lit(":v"), version.cast("string"), F.lit(":"), column)


def confidence_of(method: Column) -> Column:
    out = F.lit(None).cast("double")
    for name, value in CONFIDENCE.items():
        out = F.when(method == name, F.lit(value)).otherwise(out)
    return out


def add_nodes(nodes: DataFrame, new: DataFrame) -> DataFrame:
    return nodes.select("node").unionByName(new.select("node")).dropDuplicates(["node"])


def missing_nodes(wanted: DataFrame, nodes: DataFrame) -> DataFrame:
    return wanted.select("node").distinct().join(nodes, "node", "left_anti")


def existing_nodes(wanted: DataFrame, nodes: DataFrame) -> DataFrame:
    return wanted.join(nodes, "node", "left_semi")


def transformation_edges(transformations: DataFrame) -> DataFrame:
    """Edges of transformations (sources array, targets array, ...): every source with every target of the same row."""
    return transformations.withColumn("src", F.explode("sources")).withColumn("dst", F.explode("targets")).drop("sources", "targets")


def remove_edge(edges: DataFrame, src: str, dst: str) -> tuple[DataFrame, bool]:
    """The edges without any between src and dst, and whether there was one."""
    hit = (F.col("src") == src) & (F.col("dst") == dst)
    return edges.where(~hit), not edges.where(hit).isEmpty()


def edges_from(edges: DataFrame, node: str) -> DataFrame:
    return edges.where(F.col("src") == node)


def edges_to(edges: DataFrame, node: str) -> DataFrame:
    return edges.where(F.col("dst") == node)


def clamp_depth(depth: int) -> int:
    return min(DEEPEST, max(SHALLOWEST, depth))


def _cut(df: DataFrame) -> DataFrame:
    """Cut lineage through the session's checkpoint folder where one is set; a walk's tables are small otherwise."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.persist()


def in_order(df: DataFrame, by: list[str], name: str) -> DataFrame:
    """``df`` with ``name``: numbers that rise in the order of ``by``, with gaps, from a range partitioning."""
    return df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn(name, F.monotonically_increasing_id())


def dense(df: DataFrame, group: list[str], order: str, name: str) -> DataFrame:
    """``df`` with ``name``: 1, 2, .. within each group in the order of ``order``, which holds the partition in its upper bits.

    A window runs over the rows of one group and one partition, and one over a row a group and partition.
    """
    part = F.shiftright(order, 33)
    d = df.withColumn("_p", part).withColumn("_i", F.row_number().over(Window.partitionBy(*group, part).orderBy(order)))
    before = d.groupBy(*group, "_p").agg(F.count(F.lit(1)).alias("_n"))
    before = before.withColumn("_b", F.sum("_n").over(Window.partitionBy(*group).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))).drop("_n")
    return d.join(before, [*group, "_p"]).withColumn(name, F.col("_i") + F.coalesce("_b", F.lit(0))).drop("_p", "_i", "_b")


def _small(edges: DataFrame, columns: list[str], most: int) -> list | None:
    """The rows of a table of ``most`` rows at most, or None if it has more."""
    rows = edges.select(*columns).limit(most + 1).collect()
    return rows if len(rows) <= most else None


def _parts(key: str) -> tuple[str, str]:
    """Namespace and column of a node's key, by which siblings are ordered."""
    parts = key.split(":")
    return parts[0], parts[2] if len(parts) > 2 else ""


def _walk_small(edges: list, roots: list[str], depth: int | None, ordered: bool) -> list[tuple[str, str, int, int]]:
    out_of = defaultdict(list)
    for src, dst, seq in edges:
        out_of[src].append(((*_parts(dst), seq) if ordered else ("", "", seq), dst))
    for kids in out_of.values():
        kids.sort()
    rows = []
    for root in roots:
        seen, frontier, level = {root}, [root], 0
        while frontier and (depth is None or level < depth):
            level += 1
            met = dict.fromkeys(dst for node in frontier for _, dst in out_of[node] if dst not in seen)
            seen.update(met)
            frontier = list(met)
            rows += [(root, node, level, i + 1) for i, node in enumerate(frontier)]
    return rows


def downstream(edges: DataFrame, roots: DataFrame, depth: int | None = DEFAULT_DEPTH, ordered: bool = True, small: int = SMALL_GRAPH) -> DataFrame:
    """(root, node, level, ord) reached from ``roots`` (node), by level, then the parent's place, then the node's name.

    A node counts where it is first met; the root isn't part. depth None: until nothing new is met. ordered: siblings in the
    order of namespace and column, ties in the order of edge_seq; else all in the order of edge_seq.
    """
    spark = edges.sparkSession
    schema = "root string, node string, level int, ord long"
    held, asked = _small(edges, ["src", "dst", "edge_seq"], small), None
    if held is not None:
        asked = _small(roots.select("node").distinct(), ["node"], max(1, small // max(1, len(held))))  # what can be reached stays bounded too
    if asked is not None:
        return spark.createDataFrame(_walk_small(held, [r.node for r in asked], depth, ordered), schema)
    key = lambda i: F.coalesce(F.get(F.split("dst", ":"), F.lit(i)), F.lit(""))
    e = edges.select("src", "dst", "edge_seq")
    e = e.withColumns({"o1": key(0), "o2": key(2)}) if ordered else e.withColumns({"o1": F.lit(""), "o2": F.lit("")})
    frontier = roots.select(F.col("node").alias("root"), "node").distinct().withColumn("place", F.lit(0).cast("long"))
    levels = [frontier.select("root", "node", F.lit(0).alias("level"), "place")]
    level = 0
    while depth is None or level < depth:
        level += 1
        step = frontier.join(e, F.col("node") == F.col("src")).select("root", F.col("dst").alias("node"), F.struct(F.col("place").alias("parent"), "o1", "o2", "edge_seq").alias("o"))
        step = step.groupBy("root", "node").agg(F.min("o").alias("o"))
        for known in levels:
            step = step.join(known.select("root", "node"), ["root", "node"], "left_anti")
        frontier = _cut(in_order(step.select("root", "node", "o.*"), ["parent", "o1", "o2", "edge_seq"], "place").select("root", "node", "place"))
        if frontier.isEmpty():
            break
        levels.append(frontier.select("root", "node", F.lit(level).alias("level"), "place"))
        if len(levels) > 8:  # a few tables to look into, whatever the depth
            levels = [_cut(_union(levels))]
    found = dense(_union(levels).where("level > 0"), ["root", "level"], "place", "ord")
    return found.select("root", "node", "level", F.col("ord").cast("long").alias("ord"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def upstream(edges: DataFrame, roots: DataFrame, depth: int | None = DEFAULT_DEPTH, small: int = SMALL_GRAPH) -> DataFrame:
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "edge_seq")
    return downstream(back, roots, depth, ordered=False, small=small)


def downstream_counts(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """root, affected: how many columns lie downstream at any depth."""
    reached = downstream(edges, roots, None)
    return roots.select(F.col("node").alias("root")).distinct().join(reached.groupBy("root").agg(F.count(F.lit(1)).alias("affected")), "root", "left").fillna(0, ["affected"])


def impact_table(edges: DataFrame, nodes: DataFrame, root: str, depth: int = DEFAULT_DEPTH) -> DataFrame:
    """``downstream`` of a known column with the depth held within 1 and 50, and that depth."""
    if nodes.where(F.col("node") == root).isEmpty():
        raise LineageError(f"unknown column {root}")
    top = clamp_depth(depth)
    return downstream(edges, edges.sparkSession.createDataFrame([(root,)], "node string"), top).withColumn("max_depth", F.lit(top))


def affected_datasets(found: DataFrame) -> DataFrame:
    """(root, dataset, first_level, first_ord) of what ``downstream`` found; the order of the last two is that of first sight."""
    dataset = F.regexp_replace("node", ":[^:]*$", "")
    first = found.groupBy("root", dataset.alias("dataset")).agg(F.min(F.struct("level", "ord")).alias("f"))
    return first.select("root", "dataset", F.col("f.level").alias("first_level"), F.col("f.ord").alias("first_ord"))


def impact(edges: DataFrame, nodes: DataFrame, root: str, depth: int = DEFAULT_DEPTH) -> dict[str, object]:
    """Affected columns, datasets and pipelines of a column, for graphs whose reach fits the driver; else ``impact_table``."""
    spark = edges.sparkSession
    if nodes.where(F.col("node") == root).isEmpty():
        raise LineageError(f"unknown column {root}")
    top = clamp_depth(depth)
    found = downstream(edges, spark.createDataFrame([(root,)], "node string"), top)
    pipelines = impact_pipelines(edges, found, root, top)
    columns = [r.node for r in found.orderBy("level", "ord").collect()]
    datasets = list(dict.fromkeys(c.rsplit(":", 1)[0] for c in columns))
    return {"root": root, "columns": columns, "datasets": datasets, "pipelines": [r.pipeline_id for r in pipelines.collect()], "max_depth": top, "total_affected": len(columns)}


def impact_pipelines(edges: DataFrame, found: DataFrame, root: str, depth: int) -> DataFrame:
    """pipeline_id of every edge that leaves a node above the last level, also towards nodes met before."""
    opened = found.where(F.col("level") < depth).select("node").unionByName(found.sparkSession.createDataFrame([(root,)], "node string"))
    return edges.join(opened.distinct(), F.col("src") == F.col("node"), "left_semi").select("pipeline_id").distinct().orderBy("pipeline_id")


def reachable(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (src, dst) whose new edge would close a cycle: a self-loop, or dst already reaches src. Depth is unbounded."""
    loops = pairs.where(F.col("src") == F.col("dst"))
    reach = downstream(edges, pairs.select(F.col("dst").alias("node")), None, ordered=False)
    back = pairs.where(F.col("src") != F.col("dst")).join(reach.select(F.col("root").alias("dst"), F.col("node").alias("src")), ["src", "dst"], "left_semi")
    return loops.unionByName(back)


def cycle_path(edges: DataFrame, src: str, dst: str, small: int = SMALL_GRAPH) -> DataFrame:
    """(position, name): the cycle that src -> dst would close: src, what lies on the way from dst back to src, dst; names without version.

    The way is a shortest one; of several, from each node back to the one met first. No row if nothing closes a cycle.
    """
    spark = edges.sparkSession
    name = F.concat(F.get(F.split("node", ":"), F.lit(0)), F.lit("."), F.coalesce(F.get(F.split("node", ":", 3), F.lit(2)), F.lit("")))
    ends = spark.createDataFrame([(0, src), (1 << 30, dst)], "at int, node string")
    if src == dst:
        way = ends
    else:
        reach = downstream(edges, spark.createDataFrame([(dst,)], "node string"), None, ordered=False, small=small).select("node", "level", "ord")
        reach = _cut(reach.unionByName(spark.createDataFrame([(dst, 0, 0)], "node string, level int, ord long")))
        top = reach.where(F.col("node") == src).select("level").collect()  # one row at most
        if not top:
            return spark.createDataFrame([], "position int, name string")
        at, inner = src, []
        parents = _cut(reach.join(edges.select(F.col("src").alias("node"), "dst").distinct(), "node"))
        for level in range(top[0].level - 1, 0, -1):  # one small job a level of the way back
            at = parents.where((F.col("dst") == at) & (F.col("level") == level)).orderBy("ord").select("node").first().node
            inner.append((level, at))
        way = ends.unionByName(spark.createDataFrame(inner, "at int, node string")) if inner else ends
    return way.select("at", name.alias("name")).withColumn("position", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("at"))).select("position", "name")


def add_edge(nodes: DataFrame, edges: DataFrame, src: str, dst: str, kind: str, pipeline: str, confidence: float = 1.0, expression: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges with one more edge; its nodes are made if they are missing, equal edges are kept side by side."""
    spark = edges.sparkSession
    last = edges.agg(F.coalesce(F.max("edge_seq"), F.lit(0)).cast("long").alias("m")).first().m
    row = spark.createDataFrame([(src, dst, kind, expression, pipeline, confidence, last + 1)], EDGE)
    return add_nodes(nodes, spark.createDataFrame([(src,), (dst,)], "node string")), edges.unionByName(row, allowMissingColumns=True)


def register(spark: SparkSession, nodes: DataFrame, edges: DataFrame, sources: list[str], targets: list[str], kind: str, pipeline: str, user: str | None = None, method: str = "parsed_sql", expression: str | None = None) -> DataFrame:
    """The edges with all sources linked to all targets, or an error and nothing changed. ``user`` is taken but not kept."""
    wanted = spark.createDataFrame([(x,) for x in dict.fromkeys([*sources, *targets])], "node string")
    missing = [r.node for r in missing_nodes(wanted, nodes).orderBy("node").collect()]
    if missing:
        raise MissingColumns(missing)
    pairs = spark.createDataFrame([(s, t) for s in sources for t in targets], "src string, dst string")
    bad = reachable(edges, pairs).orderBy("src", "dst").limit(1).collect()
    if bad:
        raise CycleFound([r.name for r in cycle_path(edges, bad[0].src, bad[0].dst).orderBy("position").collect()])
    last = edges.agg(F.coalesce(F.max("edge_seq"), F.lit(0)).alias("m")).first().m
    rows = [(s, t, kind, expression, pipeline, CONFIDENCE[method], last + 1 + i) for i, (s, t) in enumerate((s, t) for s in sources for t in targets)]
    return edges.unionByName(spark.createDataFrame(rows, EDGE), allowMissingColumns=True)


def root_causes(edges: DataFrame, roots: DataFrame, depth: int = DEFAULT_DEPTH) -> DataFrame:
    """Ours: (root, node, hops, confidence): upstream columns with the best product of confidences over shortest paths."""
    found = roots.select(F.col("node").alias("root"), "node", F.lit(1.0).alias("confidence"))
    seen = found.select("root", "node", F.lit(0).alias("hops"), "confidence")
    for hop in range(1, depth + 1):
        step = found.join(edges.select("src", "dst", F.col("confidence").alias("c")), F.col("node") == F.col("dst"))
        step = step.groupBy("root", F.col("src").alias("node")).agg(F.max(F.col("confidence") * F.col("c")).alias("confidence"))
        found = _cut(step.join(seen.select("root", "node"), ["root", "node"], "left_anti"))
        if found.isEmpty():
            break
        seen = _cut(seen.unionByName(found.select("root", "node", F.lit(hop).alias("hops"), "confidence")))
    return seen.where("hops > 0")
