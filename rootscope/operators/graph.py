"""Call graph from spans, and neighbour rules on it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def call_pairs(spans: DataFrame, scope: str = "trace", order: str = "timestamp", file: str = "file") -> DataFrame:
    """Distinct ``(caller, callee)`` services from parent spans.

    ``scope`` says where a parent is looked for: in the same ``trace``, the same ``file``
    or everywhere (``global``).  Of equal span ids in a scope the latest wins.  Every span
    tells its own id who it is and its parent's id who was called; one grouping by id
    brings both together.  Called services are a set, so a parent with very many children
    stays small, and it is reduced before the shuffle.
    """
    within = {"trace": ["trace_id"], "file": [file], "global": []}[scope]
    service = F.col("service_name")
    me = F.when(service.isNotNull(), F.struct(F.col(order).alias("at"), service.alias("caller")))
    nobody = F.lit(None).cast(f"struct<at: {dict(spans.dtypes)[order]}, caller: string>")
    told = F.array(
        F.struct(F.col("span_id").alias("id"), me.alias("me"), F.lit(None).cast("string").alias("callee")),
        F.struct(F.col("parent_span_id").alias("id"), nobody.alias("me"), service.alias("callee")),
    )
    met = (
        spans.select(*within, F.inline(told))
        .where(F.col("id").isNotNull())
        .groupBy(*within, "id")
        .agg(F.max("me").alias("me"), F.collect_set("callee").alias("callees"))
    )
    return (
        met.where(F.col("me").isNotNull())
        .select(F.col("me.caller").alias("caller"), F.explode("callees").alias("callee"))
        .distinct()
    )


def to_node_ids(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(src, dst)`` of named pairs; names without an id are dropped."""
    src = nodes.select(F.col("node").alias("caller"), F.col("node_id").alias("src"))
    dst = nodes.select(F.col("node").alias("callee"), F.col("node_id").alias("dst"))
    return pairs.join(src, "caller").join(dst, "callee").select("src", "dst").distinct()


def call_edges(spans: DataFrame, nodes: DataFrame, scope: str = "trace") -> DataFrame:
    return to_node_ids(call_pairs(spans, scope), nodes)


def node_ids(table: DataFrame, nodes: DataFrame, name: str = "node") -> DataFrame:
    """Adds ``node_id`` by name; rows of unknown nodes are dropped."""
    ids = nodes.select(F.col("node").alias(name), "node_id")
    return table.join(ids, name)


def self_loops(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One loop per node on top of the edges; loops already there are kept."""
    return edges.unionByName(nodes.select(F.col("node_id").alias("src"), F.col("node_id").alias("dst")))


def topology_edges(calls: DataFrame, hosts: DataFrame, nodes: DataFrame) -> DataFrame:
    """Host and pod both ways, a loop per node, calls with a known caller; distinct ids.

    ``hosts.pair`` is ``host.pod``; the caller ``#`` stands for none.
    """
    host, pod = F.split_part("pair", F.lit("."), F.lit(1)), F.split_part("pair", F.lit("."), F.lit(2))
    both = F.array(F.struct(host.alias("caller"), pod.alias("callee")), F.struct(pod.alias("caller"), host.alias("callee")))
    hosted = hosts.select(F.inline(both))
    named = hosted.unionByName(calls.where(F.col("caller") != "#").select("caller", "callee")).distinct()
    return self_loops(to_node_ids(named, nodes), nodes).distinct()


def neighbour_max(scores: DataFrame, edges: DataFrame, by: list[str], graph: list[str] | None = None) -> DataFrame:
    """Largest score among successors and predecessors, self left out, 0 for none.

    ``scores`` has ``(*by, node_id, score)``; ``graph`` names columns shared with
    ``edges`` when there is more than one graph.  Returns the scores with
    ``successor_max`` and ``predecessor_max``.
    """
    graph = graph or []
    links = edges.where("src <> dst").select(*graph, "src", "dst").distinct()
    seen = links.select(*graph, F.col("src").alias("node_id"), F.col("dst").alias("at"), F.lit(True).alias("_back")).unionByName(
        links.select(*graph, F.col("dst").alias("node_id"), F.col("src").alias("at"), F.lit(False).alias("_back"))
    )
    # the row of ``at`` learns the score of its neighbour ``node_id``
    learned = (
        scores.join(seen, [*graph, "node_id"])
        .groupBy(*by, F.col("at").alias("node_id"))
        .agg(
            F.max(F.when(~F.col("_back"), F.col("score"))).alias("successor_max"),
            F.max(F.when(F.col("_back"), F.col("score"))).alias("predecessor_max"),
        )
    )
    return (
        scores.join(learned, [*by, "node_id"], "left")
        .withColumn("successor_max", F.coalesce("successor_max", F.lit(0.0)))
        .withColumn("predecessor_max", F.coalesce("predecessor_max", F.lit(0.0)))
    )
