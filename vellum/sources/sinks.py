"""Outputs: graph JSON, chunk lines, drawings of graphs, reports, state tables, release trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from vellum.functions import text as T
from vellum.operators.graph import degrees

# Colours of entity types in drawings.
COLOURS = {"Paper": "#4C78A8", "Term": "#F58518", "Technique": "#54A24B", "Innovation": "#E45756", "DailyReport": "#72B7B2", "Method": "#B279A2", "Guardrail": "#FF9DA6", "ResearchDirection": "#9D755D"}


def graph_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, json): a line per node and edge, the form that scales; `graph_document` makes one file of a small graph."""
    n = nodes.select(F.lit("node").alias("kind"), F.to_json(F.struct(*nodes.columns)).alias("json"))
    e = edges.select(F.lit("edge").alias("kind"), F.to_json(F.struct(F.col("src").alias("source"), F.col("dst").alias("target"), F.col("type").alias("key"), "type", "confidence")).alias("json"))
    return n.unionByName(e)


def graph_document(nodes: DataFrame, edges: DataFrame, most: int = 100_000) -> str:
    """`{"nodes": [...], "edges": [...]}` of a graph of at most `most` lines."""
    rows = graph_lines(nodes, edges).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("too large for one document; write graph_lines instead")
    part = lambda k: ",".join(r["json"] for r in rows if r["kind"] == k)
    return f'{{"nodes":[{part("node")}],"edges":[{part("edge")}]}}'


def chunk_lines(df: DataFrame, key: str, text: str = "text", size: int = 2000, overlap: int = 200) -> DataFrame:
    """(key, json): `{"index": i, "text": chunk}` of every chunk."""
    c = df.where(F.col(text).isNotNull()).select(key, F.posexplode(T.chunks(F.col(text), size, overlap)).alias("index", "text"))
    return c.select(key, F.to_json(F.struct("index", "text")).alias("json"))


def top_nodes(nodes: DataFrame, edges: DataFrame, most: int = 80) -> DataFrame:
    return nodes.join(degrees(nodes, edges), "id").orderBy(F.desc("degree"), "id").limit(most)


def _quoted(c: Column, most: int = 40) -> Column:
    return F.substring(F.regexp_replace(c, r'["\[\]{}()<>|#;`\n]', " "), 1, most)


def mermaid_lines(nodes: DataFrame, edges: DataFrame, most_nodes: int = 80, most_edges: int = 200) -> DataFrame:
    """(ord, line) of a flow chart of the nodes of largest degree and the edges between them."""
    top = top_nodes(nodes, edges, most_nodes).withColumn("n", F.row_number().over(W.Window.orderBy(F.desc("degree"), "id")))
    names = top.select("id", F.concat(F.lit("n"), F.col("n")).alias("name"), "n", "label")
    e = edges.join(names.select(F.col("id").alias("src"), F.col("name").alias("a")), "src").join(names.select(F.col("id").alias("dst"), F.col("name").alias("b")), "dst").orderBy("src", "dst", "type").limit(most_edges)
    head = names.sparkSession.createDataFrame([(0, "graph LR")], "ord long, line string")
    body = names.select(F.col("n").cast("long").alias("ord"), F.concat(F.lit("  "), "name", F.lit('["'), _quoted(F.coalesce("label", "id")), F.lit('"]')).alias("line"))
    arrows = e.select((F.lit(1_000_000) + F.row_number().over(W.Window.orderBy("src", "dst", "type"))).cast("long").alias("ord"), F.concat(F.lit("  "), "a", F.lit(" -->|"), "type", F.lit("| "), "b").alias("line"))
    return head.unionByName(body).unionByName(arrows)


def canvas_layout(nodes: DataFrame, edges: DataFrame, most: int = 100, columns: int = 8, dx: int = 320, dy: int = 220) -> DataFrame:
    """(id, x, y, colour): the nodes of largest degree on a grid."""
    n = F.row_number().over(W.Window.orderBy(F.desc("degree"), "id")) - 1
    colour = F.lit("#999999")
    for t, c in COLOURS.items():
        colour = F.when(F.col("entity_type") == t, c).otherwise(colour)
    return top_nodes(nodes, edges, most).withColumn("n", n).select("id", ((F.col("n") % columns) * dx).alias("x"), (F.floor(F.col("n") / columns) * dy).cast("int").alias("y"), colour.alias("colour"))


def html_rows(nodes: DataFrame, edges: DataFrame, most: int = 100) -> DataFrame:
    """(id, label, size, colour) of an interactive page: sizes by degree between 8 and 30."""
    lay = canvas_layout(nodes, edges, most).select("id", "colour")
    return top_nodes(nodes, edges, most).join(lay, "id").select("id", "label", F.greatest(F.lit(8), F.least(F.lit(30), F.col("degree") * 3)).cast("int").alias("size"), "colour")


def report_lines(papers: DataFrame) -> DataFrame:
    """(date, ord, line): entries under their dates, best score first."""
    w = W.Window.partitionBy("kb_date").orderBy(F.desc_nulls_last("score"), "id")
    rows = papers.where("kb_date is not null and kb_date <> ''").withColumn("ord", F.row_number().over(w))
    line = F.format_string("- %s | %s | %s | %s", "id", F.coalesce("title", F.lit("")), F.coalesce(F.col("year").cast("string"), F.lit("")), F.coalesce(F.col("score").cast("string"), F.lit("")))
    return rows.select(F.col("kb_date").alias("date"), "ord", line.alias("line"))


def collision_free(rows: DataFrame, keys: list[str], slug: str, order: str) -> DataFrame:
    """`slug` with _2, _3, ... where several rows of `keys` have one."""
    n = F.row_number().over(W.Window.partitionBy(*keys, slug).orderBy(order))
    return rows.withColumn("folder", F.when(n == 1, F.col(slug)).otherwise(F.concat_ws("_", F.col(slug), n.cast("string"))))


def release_tree(files: DataFrame, excluded_dirs: list[str], excluded_prefixes: list[str], redact: bool = False) -> DataFrame:
    """(path, text, replaced): files fit for release; a local path in any of them is an error unless they are redacted."""
    keep = files.where(~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, excluded_dirs))) if excluded_dirs else F.lit(True))
    for p in excluded_prefixes:
        keep = keep.where(~F.startswith("path", F.lit(p)))
    out = keep.withColumn("replaced", T.local_paths(F.col("text")))
    if redact:
        return out.withColumn("text", T.redact_paths(F.col("text")))
    return out.withColumn("text", F.when(F.col("replaced") > 0, F.raise_error(F.concat(F.lit("local path in "), F.col("path")))).otherwise(F.col("text")))


def append_seen(new: DataFrame, path: str) -> None:
    """Adds rows whose paper_id the state table lacks."""
    spark = new.sparkSession
    try:
        fresh = new.join(spark.read.parquet(path).select("paper_id"), "paper_id", "left_anti")
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        fresh = new
    fresh.dropDuplicates(["paper_id"]).write.mode("append").parquet(path)


def replace_day(rows: DataFrame, path: str) -> None:
    """Writes a day's rows over the partition of that date, leaving the others."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path)


def append_lines(rows: DataFrame, path: str) -> None:
    """Adds rows to a log of JSON lines."""
    rows.write.mode("append").json(path)


def append_index(rows: DataFrame, path: str) -> None:
    """Adds rows to an index of CSV files with a header."""
    rows.write.mode("append").option("header", "true").csv(path)


def log_day(rows: DataFrame, path: str) -> None:
    """Writes the log row of each date (date, ...) over the one there was; other dates stay."""
    replace_day(rows, path)


def dated_entries(new: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """(date, ord, line) of entries (date, id, title, summary) under `## date`; the heading is left out where `existing` (date) has the
    section already."""
    rows = new.where("date is not null and date <> ''")
    w = W.Window.partitionBy("date").orderBy("id")
    body = rows.withColumn("ord", F.row_number().over(w)).select("date", F.col("ord").cast("long").alias("ord"), F.format_string("### %s %s\n- **summary:** %s", "id", F.coalesce("title", F.lit("")), F.coalesce("summary", F.lit(""))).alias("line"))
    heads = rows.select("date").distinct()
    if existing is not None:
        heads = heads.join(existing.select("date").distinct(), "date", "left_anti")
    return heads.select("date", F.lit(0).cast("long").alias("ord"), F.concat(F.lit("## "), "date").alias("line")).unionByName(body)


def reading_queue(papers: DataFrame, most_chars: int = 80_000) -> DataFrame:
    """(id, json) of papers (id, title, text) to be read in depth, at most `most_chars` characters of each text, as the queue's format has it."""
    return papers.select("id", F.to_json(F.struct("id", "title", F.substring("text", 1, most_chars).alias("text"), F.length("text").alias("chars"))).alias("json"))


def report_sections(candidates: DataFrame, most: dict[str, int] | None = None) -> DataFrame:
    """(section, ord, line): the eight sections of a day's report on candidates (cand_id, title, keywords, score, reading_level, reason,
    pdf_url). Each is a table of its own; `most` has the rows of a section (fixed values of the format by default)."""
    most = {"3 selected": 5, "4 read": 20, "5 next": 10, "6 queue": 10, "7 left out": 15} | (most or {})
    title = F.coalesce("title", F.lit(""))
    total = candidates.agg(F.count("*").alias("n"), F.count_if(F.col("score") > 0).alias("r"), F.count_if(F.col("reading_level") == "PDF_TEXT_FULL").alias("f"))
    out = total.select(F.lit("1 overview").alias("section"), F.lit(1).cast("long").alias("ord"), F.format_string("%d found, %d relevant, %d in full", "n", "r", "f").alias("line"))
    counted = lambda name, c: candidates.groupBy(F.coalesce(c, F.lit("")).alias("k")).agg(F.count("*").alias("n")).select(F.lit(name).alias("section"), F.row_number().over(W.Window.orderBy(F.desc("n"), "k")).cast("long").alias("ord"), F.format_string("%s: %d", "k", "n").alias("line"))
    out = out.unionByName(counted("2 by query", "keywords")).unionByName(counted("8 by level", "reading_level"))
    parts = {"3 selected": F.col("score") > 0, "4 read": F.col("reading_level").isin("PDF_TEXT_FULL", "HUMAN_CONFIRMED"), "5 next": (F.col("score") >= 40) & (F.coalesce("pdf_url", F.lit("")) != ""), "6 queue": (F.col("score") >= 25) & (F.coalesce("pdf_url", F.lit("")) == ""), "7 left out": F.col("score") == 0}
    for name, which in parts.items():
        top = candidates.where(which).orderBy(F.desc("score"), "cand_id").limit(most[name])
        ord_ = F.row_number().over(W.Window.orderBy(F.desc("score"), "cand_id")).cast("long")
        out = out.unionByName(top.select(F.lit(name).alias("section"), ord_.alias("ord"), F.format_string("%s | %d | %s", F.col("cand_id").cast("string"), "score", title).alias("line")))
    return out
