"""Directed graphs as (src, dst) edge tables: neighbours, transitive impact, shortest traces, names, drawings."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import short_name
from ..sources.shared import kept


def edge_set(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").distinct()


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()


def depends_on(edges: DataFrame, node: str) -> DataFrame:
    return edges.filter(F.col("src") == node).select(F.col("dst").alias("node")).distinct().orderBy("node")


def dependents(edges: DataFrame, node: str) -> DataFrame:
    return edges.filter(F.col("dst") == node).select(F.col("src").alias("node")).distinct().orderBy("node")


#: Graphs up to this many edges are searched in one task per start, without a shuffle for each hop.
SMALL_EDGES = 200_000


def _stored(edges: DataFrame) -> tuple[DataFrame, list[tuple[str, str]] | None]:
    """The edges as a stored table, and all of them as a list if they are few.  An edge that comes twice does no harm, so none is shuffled here."""
    edges = kept(edges.select("src", "dst"), "edges")
    return edges, [tuple(r) for r in edges.collect()] if edges.count() <= SMALL_EDGES else None


def _into(pairs: list[tuple[str, str]]) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for src, dst in pairs:
        out.setdefault(dst, []).append(src)
    return out


def _levels(into: dict[str, list[str]], start: str, until: str | None = None) -> dict[str, int]:
    """How many hops every node is away from ``start`` along the edges that lead to it."""
    depth, front = {start: 0}, [start]
    while front and until not in depth:
        more = []
        for n in front:
            for m in into.get(n, ()):
                if m not in depth:
                    depth[m] = depth[n] + 1
                    more.append(m)
        front = more
    return depth


def _hops(edges: DataFrame, starts: DataFrame, until: str | None = None) -> DataFrame:
    """(start, node, depth) of all nodes from which a start can be reached, hop by hop, until the frontier is empty or holds ``until``.

    ``edges`` are stored.  Frontiers of all starts advance together; a round joins the frontier with the edges and drops what was
    seen, and is written to the shared folder.  Of a large frontier only nodes that an edge leads to go on, so that a last round of
    leaves isn't joined with all edges.
    """
    targets: DataFrame | None = None
    seen = kept(starts.select(F.col("node").alias("start"), "node").distinct().withColumn("depth", F.lit(0)), "hops")
    front, depth = seen, 0
    while True:
        depth += 1
        step = front.join(edges.select("src", F.col("dst").alias("node")), "node").select("start", F.col("src").alias("node")).distinct()
        front = kept(step.join(seen.select("start", "node"), ["start", "node"], "left_anti").withColumn("depth", F.lit(depth)), "hops")
        n, there = front.agg(F.count("*"), F.max(F.col("node") == F.lit(until))).first()
        if not n:
            return seen
        seen = seen.unionByName(front)
        if there:
            return seen
        if n > SMALL_EDGES:
            targets = targets or kept(edges.select(F.col("dst").alias("node")).distinct(), "targets")
            front = kept(front.join(targets, "node", "left_semi").select(front.columns), "hops")
            if front.isEmpty():
                return seen
        if depth % 8 == 0:
            seen = kept(seen, "hops")


def impact(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, node, depth): everything from which a start can be reached, without the start itself; chains of any length."""
    edges, pairs = _stored(edges)
    if pairs is None:
        return _hops(edges, starts).filter(F.col("node") != F.col("start"))
    shared = edges.sparkSession.sparkContext.broadcast(pairs)

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        into = _into(shared.value)
        for frame in frames:
            for start in frame["node"]:
                depth = _levels(into, start)
                del depth[start]
                if depth:
                    yield pd.DataFrame({"start": start, "node": list(depth), "depth": list(depth.values())})

    return starts.select(F.col("node").cast("string").alias("node")).distinct().mapInPandas(run, "start string, node string, depth int")


def trace(edges: DataFrame, start: str, end: str) -> list[str] | None:
    """The shortest path, of several the first by names; [start] if both are the same; None if there is none.

    Distances to the end come first; the path then goes down from the start, to the first name that is nearer.
    """
    if start == end:
        return [start]
    edges, pairs = _stored(edges)
    if pairs is not None:
        depth = _levels(_into(pairs), end, start)
        if start not in depth:
            return None
        out: dict[str, list[str]] = {}
        for src, dst in pairs:
            if dst in depth:
                out.setdefault(src, []).append(dst)
        path = [start]
        while path[-1] != end:
            path.append(min(m for m in out[path[-1]] if depth[m] == depth[path[-1]] - 1))
        return path
    far = _hops(edges, edges.sparkSession.createDataFrame([(end,)], "node string"), start).select("node", "depth")
    hit = far.filter(F.col("node") == start).first()
    if hit is None:
        return None
    path = [start]
    for depth in range(hit["depth"] - 1, -1, -1):
        ways = edges.filter(F.col("src") == path[-1]).select(F.col("dst").alias("node"))
        path.append(far.filter(F.col("depth") == depth).join(ways, "node", "left_semi").agg(F.min("node")).first()[0])
    return path


def resolve(all_nodes: DataFrame, name: str) -> DataFrame:
    """Nodes of the best kind of match: the name itself, its last part, or a part of it in any case."""
    if not name:
        return all_nodes.limit(0)
    low = F.lower("node")
    tier = F.when(F.col("node") == name, 0).when(short_name(F.col("node")) == name, 1).when(low.contains(name.lower()), 2)
    tiers = all_nodes.withColumn("tier", tier).filter(F.col("tier").isNotNull())
    best = tiers.agg(F.min("tier").alias("tier"))
    return tiers.join(F.broadcast(best), "tier").select("node").orderBy("node")


def _numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``i``, their number from zero in a sort order that is spread over many tasks."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = kept(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_place", 33)
    # one row per task
    runs = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows"), F.min("_place").alias("_first"))
    before = F.coalesce(F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = runs.select("_part", (before - F.col("_first")).alias("_shift"))
    return placed.withColumn("_part", part).join(F.broadcast(shift), "_part").withColumn("i", F.col("_place") + F.col("_shift")).drop("_part", "_place", "_shift")


def mermaid_lines(edges: DataFrame) -> DataFrame:
    """(part, place, line): the nodes and edges of a flow chart, ids by sorted names."""
    ids = _numbered(nodes(edges), ["node"])
    quote = lambda c: F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    drawn = ids.select(F.lit(1).alias("part"), F.col("i").cast("bigint").alias("place"), F.format_string("  n%d[%s]", "i", quote(F.col("node"))).alias("line"))
    e = edge_set(edges).join(ids.select(F.col("node").alias("src"), F.col("i").alias("a")), "src").join(ids.select(F.col("node").alias("dst"), F.col("i").alias("b")), "dst")
    arrows = _numbered(e.select("src", "dst", "a", "b"), ["src", "dst"]).select(F.lit(2).alias("part"), F.col("i").alias("place"), F.format_string("  n%d --> n%d", "a", "b").alias("line"))
    return drawn.unionByName(arrows)


def mermaid(edges: DataFrame) -> str:
    """The flow chart as one text, for a graph small enough to be drawn."""
    return "\n".join(["flowchart LR", *[r[2] for r in mermaid_lines(edges).orderBy("part", "place").collect()]]) + "\n"
