"""Call graph queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from rootscope.operators import graph as G
from rootscope.queries.adapters import edges, nodes, rounded, spans, table, with_sql

# event types as nodes, numbered by name
TYPE_IDS = {"click": 0, "error": 1, "purchase": 2, "signup": 3, "view": 4}


def type_nodes(s, d):
    ids = F.create_map(*[F.lit(x) for pair in TYPE_IDS.items() for x in pair])
    names = table(s, d, "events").select(F.col("event_type").alias("node")).distinct()
    return names.select("node", F.try_element_at(ids, F.col("node")).alias("node_id"))


def _all_nodes(s, d):
    return nodes(s, d).unionByName(type_nodes(s, d).withColumn("node_id", F.col("node_id") + 10))


def _hosts(s, d):
    svc = F.concat(F.lit("svc"), (F.col("user_id") % 5).cast("string"))
    return table(s, d, "events").select(F.concat(svc, F.lit("."), F.col("event_type")).alias("pair")).distinct()


def _calls(s, d):
    """Caller and callee types; roots are called by ``#``."""
    rooted = spans(s, d).where("parent_span_id IS NULL").select(F.lit("#").alias("caller"), F.col("service_name").alias("callee"))
    return G.call_pairs(spans(s, d)).unionByName(rooted.distinct())


def _scores(s, d):
    """A score per trace hour and node: mean loss of the hour."""
    return (
        table(s, d, "events")
        .groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"), (F.col("user_id") % 5).cast("int").alias("node_id"))
        .agg(F.avg("value").alias("score"))
    )


_TYPES = {"type_nodes": " UNION ALL ".join(f"SELECT '{k}' AS node, CAST({v} AS INTEGER) AS node_id" for k, v in TYPE_IDS.items())}
_PAIRS = {
    "pairs": """SELECT DISTINCT p.service_name AS caller, c.service_name AS callee FROM spans c
    JOIN spans p ON p.trace_id = c.trace_id AND p.span_id = c.parent_span_id"""
}

QUERIES = {
    "call_edges": lambda s, d: G.call_edges(spans(s, d), type_nodes(s, d)),
    "call_edges_global": lambda s, d: G.call_edges(spans(s, d), type_nodes(s, d), "global"),
    "node_map_join": lambda s, d: G.node_ids(
        table(s, d, "events").groupBy(F.col("event_type").alias("node")).agg(F.count(F.lit(1)).alias("n")), type_nodes(s, d)
    ),
    "topology_edges": lambda s, d: G.topology_edges(_calls(s, d), _hosts(s, d), _all_nodes(s, d)),
    "self_loops": lambda s, d: G.self_loops(edges(s, d), nodes(s, d)),
    "neighbour_max": lambda s, d: rounded(G.neighbour_max(_scores(s, d), edges(s, d), ["day"])),
}

ORACLE = {
    "call_edges": with_sql(
        "spans",
        """SELECT DISTINCT a.node_id AS src, b.node_id AS dst FROM pairs JOIN type_nodes a ON a.node = caller JOIN type_nodes b ON b.node = callee""",
        {**_PAIRS, **_TYPES},
    ),
    "call_edges_global": with_sql(
        "spans",
        """SELECT DISTINCT a.node_id AS src, b.node_id AS dst FROM spans c JOIN spans p ON p.span_id = c.parent_span_id
        JOIN type_nodes a ON a.node = p.service_name JOIN type_nodes b ON b.node = c.service_name""",
        _TYPES,
    ),
    "node_map_join": with_sql(
        "",
        "SELECT event_type AS node, count(*) AS n, any_value(t.node_id) AS node_id FROM events JOIN type_nodes t ON t.node = event_type GROUP BY 1",
        _TYPES,
    ),
    "topology_edges": with_sql(
        "spans nodes",
        """SELECT DISTINCT a.node_id AS src, b.node_id AS dst FROM links JOIN all_nodes a ON a.node = links.x JOIN all_nodes b ON b.node = links.y
        UNION SELECT node_id, node_id FROM all_nodes""",
        {
            **_PAIRS,
            **_TYPES,
            "all_nodes": "SELECT node, node_id FROM nodes UNION ALL SELECT node, CAST(node_id + 10 AS INTEGER) FROM type_nodes",
            "hosts": "SELECT DISTINCT 'svc' || (user_id % 5) AS h, event_type AS p FROM events",
            "links": "SELECT h AS x, p AS y FROM hosts UNION SELECT p, h FROM hosts UNION SELECT caller, callee FROM pairs",
        },
    ),
    "self_loops": with_sql("edges", "SELECT src, dst FROM edges UNION ALL SELECT node_id, node_id FROM nodes"),
    "neighbour_max": with_sql(
        "edges",
        """SELECT s.day, s.node_id, round(s.score, 6) AS score,
        round(coalesce((SELECT max(o.score) FROM scores o JOIN edges e ON e.dst = o.node_id WHERE e.src = s.node_id AND o.day = s.day AND e.src <> e.dst), 0), 6) AS successor_max,
        round(coalesce((SELECT max(o.score) FROM scores o JOIN edges e ON e.src = o.node_id WHERE e.dst = s.node_id AND o.day = s.day AND e.src <> e.dst), 0), 6) AS predecessor_max
        FROM scores s""",
        {
            "scores": """SELECT date_trunc('day', ts)::TIMESTAMP AS day, CAST(user_id % 5 AS INTEGER) AS node_id, avg(value) AS score FROM events GROUP BY 1, 2"""
        },
    ),
}
