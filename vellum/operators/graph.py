"""Property graph on two tables: nodes (id, entity_type, label, ...) and edges (src, dst, type, confidence, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.runtime import cut


def collapsed(edges: DataFrame) -> DataFrame:
    """One edge per (src, dst, type), with the largest confidence."""
    return edges.groupBy("src", "dst", "type").agg(F.max("confidence").alias("confidence"))


def valid_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose ends both exist."""
    return edges.join(nodes.select(F.col("id").alias("src")).hint("merge"), "src", "left_semi").join(nodes.select(F.col("id").alias("dst")).hint("merge"), "dst", "left_semi")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, degree) of every node: in and out, parallel edges each, a loop twice."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    return nodes.select("id").join(ends.hint("merge"), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)).cast("long"))


def type_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(what, type, n) of node and edge types."""
    a = nodes.groupBy(F.col("entity_type").alias("type")).count().select(F.lit("node").alias("what"), "type", F.col("count").alias("n"))
    b = edges.groupBy("type").count().select(F.lit("edge").alias("what"), "type", F.col("count").alias("n"))
    return a.unionByName(b)


def isolation(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(entity_type, n_nodes, n_isolated, permille) of every type."""
    d = nodes.select("id", "entity_type").join(degrees(nodes, edges), "id")
    return d.groupBy("entity_type").agg(F.count("*").alias("n_nodes"), F.sum((F.col("degree") == 0).cast("long")).alias("n_isolated")).withColumn("permille", F.floor(F.col("n_isolated") * 1000 / F.col("n_nodes")).cast("long"))


def search(nodes: DataFrame, edges: DataFrame, phrase: str, columns: list[str], most: int = 20, types: list[str] | None = None) -> DataFrame:
    """Nodes with the phrase in any of `columns`, by degree."""
    hay = F.lower(F.concat_ws(" ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)))
    hit = nodes.where(F.contains(hay, F.lit(phrase.lower())))
    if types:
        hit = hit.where(F.col("entity_type").isin(types))
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).join(hit.select("id"), "id", "left_semi").groupBy("id").agg(F.count("*").alias("degree"))
    out = hit.join(ends, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)).cast("long"))
    return out.select("id", "entity_type", "label", "degree").orderBy(F.desc("degree"), "id").limit(most)


def neighbours(edges: DataFrame, start: str) -> DataFrame:
    """One row per out-edge of `start`."""
    return edges.where(F.col("src") == start).select(F.col("dst").alias("id"), "type", "confidence")


def k_hop(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """(id, hops) of the nodes reached from `starts` (id) along out-edges in at most `depth` steps, with their distance."""
    out = edges.select("src", "dst").distinct()
    seen = starts.select("id").distinct().withColumn("hops", F.lit(0))
    frontier = seen
    for k in range(1, depth + 1):
        step = frontier.join(out, frontier["id"] == out["src"]).select(F.col("dst").alias("id")).distinct()
        frontier = cut(step.join(seen.select("id"), "id", "left_anti").withColumn("hops", F.lit(k)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def shortest_path(edges: DataFrame, start: str, end: str, most: int | None = None) -> DataFrame:
    """(hop, src, dst, type) of a shortest directed path, the least by node names among equals; no row if there is none of at most
    `most` steps (any number)."""
    spark = edges.sparkSession
    step = edges.groupBy("src", "dst").agg(F.min("type").alias("type"))
    paths = spark.createDataFrame([(start, [start])], "id string, path array<string>")
    seen = paths.select("id")
    found = None
    steps = 0
    while start != end and (most is None or steps < most):
        steps += 1
        grown = paths.join(step, paths["id"] == step["src"]).select(F.col("dst").alias("id"), F.concat("path", F.array("dst")).alias("path"))
        grown = grown.join(seen, "id", "left_anti").groupBy("id").agg(F.min("path").alias("path"))
        paths = cut(grown)
        if paths.isEmpty():
            break
        hit = paths.where(F.col("id") == end)
        if not hit.isEmpty():
            found = hit
            break
        seen = seen.unionByName(paths.select("id"))
    if found is None:
        return spark.createDataFrame([], "hop int, src string, dst string, type string")
    hops = found.select(F.posexplode(F.arrays_zip(F.slice("path", 1, F.size("path") - 1).alias("src"), F.slice("path", 2, F.size("path") - 1).alias("dst"))).alias("hop", "p"))
    return hops.select((F.col("hop") + 1).alias("hop"), F.col("p.src").alias("src"), F.col("p.dst").alias("dst")).join(step, ["src", "dst"]).select("hop", "src", "dst", "type")


def recommend(edges: DataFrame, start: str, most: int = 10) -> DataFrame:
    """(id, score): nodes two steps away, not direct neighbours, by the number of neighbours that lead there."""
    out = edges.select("src", "dst").distinct()
    direct = out.where(F.col("src") == start).select(F.col("dst").alias("via"))
    two = direct.join(out, direct["via"] == out["src"]).select("via", F.col("dst").alias("id")).where(F.col("id") != start)
    return two.join(direct.select(F.col("via").alias("id")), "id", "left_anti").groupBy("id").agg(F.count("*").alias("score")).orderBy(F.desc("score"), "id").limit(most)


def common_neighbours(edges: DataFrame) -> DataFrame:
    """(src, dst, score) of every pair two steps apart that has no edge."""
    out = edges.select("src", "dst").distinct()
    a, b = out.alias("a"), out.alias("b")
    two = a.join(b, F.col("a.dst") == F.col("b.src")).where("a.src <> b.dst").groupBy(F.col("a.src").alias("src"), F.col("b.dst").alias("dst")).agg(F.count("*").alias("score"))
    return two.join(out, ["src", "dst"], "left_anti")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): weakly connected components, named by their least id.

    Large-star and small-star in turns: each round points every node at the least node around it, so the number of rounds grows with
    the logarithm of the diameter; a hub is aggregated before the shuffle.
    """
    pairs = edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    pairs = cut(pairs)
    while True:  # the labels only fall, so this ends
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        star = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        new = cut(star)
        same = new.count() == pairs.count() and new.exceptAll(pairs).isEmpty()
        pairs = new
        if same:
            break
    root = pairs.groupBy("u").agg(F.min("v").alias("component"))
    return nodes.select("id").join(root, nodes["id"] == root["u"], "left").select("id", F.coalesce("component", "id").alias("component"))


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(measure, value) of the whole graph."""
    comp = components(nodes, edges).groupBy("component").count()
    deg = degrees(nodes, edges)
    rows = [
        nodes.agg(F.count("*").alias("value")).select(F.lit("nodes").alias("measure"), "value"),
        edges.agg(F.count("*").alias("value")).select(F.lit("edges").alias("measure"), "value"),
        comp.agg(F.count("*").alias("value")).select(F.lit("components").alias("measure"), "value"),
        comp.agg(F.coalesce(F.max("count"), F.lit(0)).alias("value")).select(F.lit("largest_component").alias("measure"), "value"),
        deg.where("degree = 0").agg(F.count("*").alias("value")).select(F.lit("isolated").alias("measure"), "value"),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def health(nodes: DataFrame, edges: DataFrame, known_types: list[str]) -> DataFrame:
    """(kind, subject, level): anomalies and warnings, and under `overall` the colour they amount to."""
    iso = isolation(nodes, edges)
    anomalies = iso.where("permille > 500").select(F.lit("isolated_type").alias("kind"), F.col("entity_type").alias("subject"), F.lit("anomaly").alias("level"))
    unknown = nodes.where(~F.col("entity_type").isin(known_types)).select(F.lit("unknown_type").alias("kind"), F.col("entity_type").alias("subject"), F.lit("anomaly").alias("level")).distinct()
    empty = nodes.where("label is null or label = ''").agg(F.count("*").alias("n")).where("n > 0").select(F.lit("empty_label").alias("kind"), F.col("n").cast("string").alias("subject"), F.lit("anomaly").alias("level"))
    whole = iso.agg(F.sum("n_isolated").alias("i"), F.sum("n_nodes").alias("n"))
    warn = whole.where("i * 10 > n").select(F.lit("isolation").alias("kind"), F.lit("all").alias("subject"), F.when(F.col("i") * 5 > F.col("n"), "critical").otherwise("warning").alias("level"))
    sparse = nodes.agg(F.count("*").alias("n")).crossJoin(edges.agg(F.count("*").alias("e"))).where("e < n").select(F.lit("sparse").alias("kind"), F.lit("all").alias("subject"), F.lit("anomaly").alias("level"))  # one row each
    found = anomalies.unionByName(unknown).unionByName(empty).unionByName(warn).unionByName(sparse)
    overall = found.agg(F.count_if(F.col("level") == "critical").alias("c"), F.count_if(F.col("level") != "critical").alias("w")).select(F.lit("overall").alias("kind"), F.lit("all").alias("subject"), F.when(F.col("c") > 0, "RED").when(F.col("w") >= 3, "YELLOW").otherwise("GREEN").alias("level"))
    return found.unionByName(overall)


def growth(history: DataFrame) -> DataFrame:
    """(date, nodes, edges, new_nodes, new_edges) against the snapshot before, the last 30."""
    from pyspark.sql import window as W

    w = W.Window.orderBy("date")  # a few hundred snapshots at most: one row a build
    out = history.withColumns({"new_nodes": F.col("nodes") - F.lag("nodes").over(w), "new_edges": F.col("edges") - F.lag("edges").over(w)})
    return out.orderBy(F.desc("date")).limit(30)
