"""Command line: `python -m vellum.cli COMMAND ...`. Graphs are folders with nodes and edges as parquet."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from vellum.operators import graph, quality
from vellum.plans import pipelines
from vellum.runtime import local_session
from vellum.sources import markdown, pdf, sinks


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="vellum", description=__doc__)
    c = p.add_subparsers(dest="command", required=True)

    def add(name: str, text: str, *args: tuple) -> None:
        s = c.add_parser(name, help=text)
        for a in args:
            s.add_argument(*a[:-1], **a[-1])

    g = ("--graph", {"required": True, "help": "folder with nodes and edges"})
    add("build", "graph of Markdown papers and terms", ("--papers", {"required": True}), ("--terms", {"required": True}), g)
    add("stats", "sizes and components", g)
    add("query", "nodes with a phrase", ("phrase", {}), ("-n", {"type": int, "default": 20}), g)
    add("ask", "nodes with the joined words", ("words", {"nargs": "+"}), g)
    add("show", "neighbours of a node", ("node", {}), ("-d", {"type": int, "default": 1}), g)
    add("path", "a shortest path", ("start", {}), ("end", {}), g)
    add("recommend", "nodes two steps away", ("node", {}), ("-k", {"type": int, "default": 10}), g)
    add("health", "anomalies, warnings, colour", g)
    add("mermaid", "flow chart", ("-n", {"type": int, "default": 80}), g)
    add("canvas", "grid layout", ("-n", {"type": int, "default": 100}), g)
    add("ingest", "text of PDF files", ("--dir", {"required": True}), ("--output", {"required": True}), ("--engine", {"action": "append"}))
    add("engines", "engines installed here")
    add("quality", "judgements of ingested results", ("--results", {"required": True}))
    add("release", "copy of text files fit for release", ("--source", {"required": True}), ("--destination", {"required": True}), ("--redact-local-paths", {"action": "store_true"}))
    return p


def main(argv: list[str] | None = None) -> int:
    a = _parser().parse_args(argv)
    if a.command == "engines":
        print("\n".join(pdf.available_engines()))
        return 0
    spark = local_session(name="vellum-cli")
    if a.command == "build":
        p = markdown.papers(markdown.whole_files(spark, a.papers))
        t = markdown.terms(markdown.whole_files(spark, a.terms)).withColumn("related_terms", F.array().cast("array<string>"))
        none = spark.createDataFrame([], "direction_id string, name string")
        nodes, edges = pipelines.knowledge_graph(p, t, none, {m: m for m in ("kriging", "random forest", "regression", "lidar", "radar")})
        nodes.write.mode("overwrite").parquet(f"{a.graph}/nodes")
        edges.write.mode("overwrite").parquet(f"{a.graph}/edges")
        return 0
    if a.command == "ingest":
        pdf.ingest(spark, a.dir, a.engine).write.mode("overwrite").parquet(a.output)
        return 0
    if a.command == "quality":
        r = spark.read.parquet(a.results)
        r.select("path", quality.quality_tenths(F.col("text")).alias("quality"), quality.assessment(F.col("text")).alias("a")).select("path", "quality", "a.*").show(1000, False)
        return 0
    if a.command == "release":
        files = markdown.whole_files(spark, a.source, "*.{md,txt,py,json,csv}")
        sinks.release_tree(files, [".git", "private"], [], a.redact_local_paths).write.mode("errorifexists").parquet(a.destination)
        return 0
    nodes, edges = spark.read.parquet(f"{a.graph}/nodes"), spark.read.parquet(f"{a.graph}/edges")
    show = {
        "stats": lambda: graph.stats(nodes, edges),
        "query": lambda: graph.search(nodes, edges, a.phrase, ["id", "label"], a.n),
        "ask": lambda: graph.search(nodes, edges, " ".join(a.words), ["id", "label"], 15),
        "show": lambda: graph.neighbours(edges, a.node) if a.d == 1 else graph.k_hop(edges, spark.createDataFrame([(a.node,)], "id string"), a.d),
        "path": lambda: graph.shortest_path(edges, a.start, a.end).orderBy("hop"),
        "recommend": lambda: graph.recommend(edges, a.node, a.k),
        "health": lambda: graph.health(nodes, edges, ["Paper", "Term", "Method", "ResearchDirection"]),
        "mermaid": lambda: sinks.mermaid_lines(nodes, edges, a.n).orderBy("ord").select("line"),
        "canvas": lambda: sinks.canvas_layout(nodes, edges, a.n),
    }
    show[a.command]().show(1000, False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
