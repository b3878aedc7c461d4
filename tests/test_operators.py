"""Operators on small tables with known answers, and with nothing in them."""

import math

from pyspark.sql import functions as F

from vellum.operators import dedup, graph, links, quality, scoring, sections, similarity, stats
from vellum.sources import markdown, payloads, sinks


def ids(df, c="id"):
    return sorted(r[c] for r in df.collect())


def tiny(spark):
    nodes = spark.createDataFrame([(x, t, x.upper()) for x, t in [("a", "P"), ("b", "P"), ("c", "T"), ("d", "T"), ("e", "X"), ("z", "X")]], "id string, entity_type string, label string")
    edges = spark.createDataFrame([("a", "b", "R", 0.5), ("a", "b", "S", 0.6), ("b", "c", "R", 0.7), ("a", "d", "R", 0.1), ("d", "c", "R", 0.1), ("c", "c", "L", 0.2), ("c", "e", "R", 0.9)], "src string, dst string, type string, confidence double")
    return nodes, edges


def test_degrees_count_parallel_edges_and_loops(spark):
    n, e = tiny(spark)
    got = {r["id"]: r["degree"] for r in graph.degrees(n, e).collect()}
    assert got == {"a": 3, "b": 3, "c": 5, "d": 2, "e": 1, "z": 0}


def test_paths_and_hops(spark):
    _, e = tiny(spark)
    assert [(r["src"], r["dst"]) for r in graph.shortest_path(e, "a", "e").orderBy("hop").collect()] == [("a", "b"), ("b", "c"), ("c", "e")]
    assert graph.shortest_path(e, "e", "a").count() == 0
    hops = {r["id"]: r["hops"] for r in graph.k_hop(e, spark.createDataFrame([("a",)], "id string"), 2).collect()}
    assert hops == {"a": 0, "b": 1, "d": 1, "c": 2}
    assert [(r["id"], r["score"]) for r in graph.recommend(e, "a").collect()] == [("c", 2)]


def test_components_of_a_long_chain_and_a_star(spark):
    names = [f"n{i:03d}" for i in range(60)]
    nodes = spark.createDataFrame([(x,) for x in [*names, *(f"s{i:03d}" for i in range(30)), "alone"]], "id string")
    rows = [(a, b, "R", 1.0) for a, b in zip(names, names[1:])] + [("s000", f"s{i:03d}", "R", 1.0) for i in range(1, 30)]
    got = {r["id"]: r["component"] for r in graph.components(nodes, spark.createDataFrame(rows, "src string, dst string, type string, confidence double")).collect()}
    assert {got[x] for x in names} == {"n000"} and got["s029"] == "s000" and got["alone"] == "alone"


def test_health_and_empty_graph(spark):
    n, e = tiny(spark)
    levels = {r["kind"]: r["level"] for r in graph.health(n, e, ["P", "T"]).collect()}
    assert levels["unknown_type"] == "anomaly" and levels["overall"] in ("RED", "YELLOW", "GREEN")
    assert graph.degrees(n.limit(0), e.limit(0)).count() == 0
    assert {r["measure"]: r["value"] for r in graph.stats(n.limit(0), e.limit(0)).collect()}["components"] == 0


def test_first_and_richest_wins(spark):
    df = spark.createDataFrame([(2, "k", "short"), (1, "k", "longer text"), (3, None, "x")], "id int, k string, t string")
    assert ids(dedup.first_wins(df, ["k"], [F.col("id")])) == [1, 3]
    assert ids(dedup.richest_wins(df, ["k"], "id")) == [1, 3]
    assert ids(dedup.first_wins(df.limit(0), ["k"], [F.col("id")])) == []


def test_near_titles_equal_brute_force(spark):
    base = ["mapping soil loss in the upper basin", "mapping soil loss in the upper basins", "a quite different title about snow", "short one", "short ones", "mapping soil loss in the upper basin with drones", "snow"]
    a = spark.createDataFrame([(i, t) for i, t in enumerate(base)], "id int, title string")
    b = spark.createDataFrame([(i + 100, t) for i, t in enumerate(base)], "id int, title string")
    got = {(r["a_id"], r["b_id"]) for r in dedup.near_titles(a, b).collect()}
    from vellum.functions.text import title_similarity

    x = a.alias("a").join(b.alias("b"), F.lit(True)).withColumn("s", title_similarity(F.col("a.title"), F.col("b.title"))).where("s >= 0.9")
    want = {(r[0], r[1]) for r in x.select("a.id", "b.id").collect()}
    assert got == want and {(i, i + 100) for i in range(len(base))} <= got


def test_phrases_equal_brute_force(spark):
    phrases = [(1, "loess"), (2, "gully head"), (3, "沟谷"), (4, "ab"), (5, None)]
    texts = [(10, "Loess and gully heads of 沟谷地貌"), (11, "the gully   head"), (12, None), (13, "about loes"), (14, "loessic soil")]
    got = {(r["phrase_id"], r["text_id"]) for r in links.phrases_in_texts(spark.createDataFrame(phrases, "phrase_id int, phrase string"), spark.createDataFrame(texts, "text_id int, text string")).collect()}
    want = {(p, t) for p, w in phrases if w and len(w) > 1 and (len(w) >= 4 or w > "一") for t, s in texts if s and w in s.lower()}
    assert got == want


def test_sections(spark):
    df = spark.createDataFrame([(1, "pre\nAbstract\nA1\nA2\n方法\nM\nAbstract\nlast"), (2, ""), (3, None)], "id int, text string")
    got = {(r["id"], r["section"]): r["body"] for r in sections.split_sections(df, "id").collect()}
    assert got[1, "abstract"] == "last" and got[1, "method"] == "M" and got[1, "preamble"] == "pre"
    d = {r["id"]: r["s"] for r in df.select("id", sections.detected_sections(F.col("text")).alias("s")).collect()}
    assert d[1]["abstract"] == 2 and d[2] == {}


def test_quality_edges(spark):
    rows = [(i, "a" * n) for i, n in enumerate((0, 99, 100, 499, 500, 501, 2001, 50001))] + [(90, None)]
    df = spark.createDataFrame(rows, "id int, text string")
    q = {r["id"]: r["q"] for r in df.select("id", quality.quality_tenths(F.col("text")).alias("q")).collect()}
    assert q[3] == 0 and q[4] > 0 and q[7] > q[6] and q[90] == 0
    none = F.array().cast("array<string>")
    lv = {r["id"]: r["v"] for r in df.select("id", quality.reading_level(F.col("text"), none).alias("v")).collect()}
    assert lv[1] == "META_ONLY" and lv[3] == "ABSTRACT_ONLY" and lv[4] == "ABSTRACT_ONLY" and lv[5] == "PDF_TEXT_PARTIAL" and lv[90] == "META_ONLY"


def test_rubric_range(spark):
    df = spark.createDataFrame([("A novel dem framework", "x" * 700, True), (None, None, None)], "t string, a string, o boolean")
    got = [r[0]["total"] for r in df.select(scoring.rubric(F.col("t"), F.col("a"), F.col("o"))).collect()]
    assert all(0 <= x <= 100 for x in got) and got[0] > got[1]


def test_shared_items_and_stars(spark):
    df = spark.createDataFrame([("a", ["X", "y", "z"], "g"), ("b", ["x", "Y"], "g"), ("c", None, ""), ("d", ["z"], "g")], "id string, items array<string>, k string")
    assert [(r["src"], r["dst"], r["confidence"]) for r in links.shared_items(df, "items", 2, "S").collect()] == [("a", "b", 0.7)]
    assert sorted((r["src"], r["dst"]) for r in links.group_star(df, "k", "G", 0.5).collect()) == [("a", "b"), ("a", "d")]


def test_tfidf_nearest(spark):
    l = spark.createDataFrame([(1, "soil loss on gully slopes"), (2, None)], "text_id long, text string")
    r = spark.createDataFrame([(5, "gully slopes and soil"), (6, "snow cover")], "text_id long, text string")
    assert [(x["text_id"], x["other"]) for x in similarity.nearest(l.where("text is not null"), r).collect()] == [("1", "5")]


def test_tfidf_weights_count_all_documents(spark, tmp_path):
    from vellum.queries import QUERIES

    docs = [(20, "gully snow")] + [(i, "snow") for i in range(1, 20)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("a", "gully", "", ""), ("b", "snow", "", "")], "direction_id string, name string, topic_area string, search_query string").write.parquet(f"{tmp_path}/research_directions.parquet")
    got = QUERIES["tfidf_nearest_direction"](spark, str(tmp_path)).collect()
    idf = lambda df: math.log(23 / (df + 1)) + 1  # noqa: E731  22 texts
    gully, snow = idf(2), idf(21)
    assert [r["text_id"] for r in got] == ["20"] and abs(got[0]["score"] - gully / math.hypot(gully, snow)) < 1e-5


def test_sequence_and_backfill(spark):
    old = spark.createDataFrame([("KB-2024-01-02-07",)], "id string")
    new = spark.createDataFrame([("2024-01-02", 1), ("2024-01-02", 2), ("2024-01-03", 1)], "date string, ord int")
    assert ids(stats.next_sequence(old, new), "new_id") == ["KB-2024-01-02-08", "KB-2024-01-02-09", "KB-2024-01-03-01"]
    done = spark.createDataFrame([("2024-01-02",)], "date string")
    assert ids(stats.backfill_dates("2024-01-01", "2024-01-03", done), "date") == ["2024-01-01", "2024-01-03"]


def test_markdown_sources(spark):
    md = "## 2024-05-01\n### KB-2024-05-01-01 | First paper\n- **作者:** A; B\n- **年份:** 2020年\n- **评分:** 87/100\n- **主题:** x；y\n## 2024-05-02\n### KB-2024-05-02-01 | Second\n- **方法:** m1, m2\n### KB-2024-05-01-01 | again\n"
    f = spark.createDataFrame([("p.md", md), ("q.md", "")], "path string, text string")
    got = {r["id"]: r for r in markdown.papers(f).collect()}
    assert got["KB-2024-05-01-01"]["title"] == "First paper" and got["KB-2024-05-01-01"]["year"] == 2020 and got["KB-2024-05-01-01"]["score"] == 87
    assert got["KB-2024-05-01-01"]["topics"] == ["x", "y"] and got["KB-2024-05-02-01"]["methods"] == ["m1", "m2"]
    t = spark.createDataFrame([("t.md", "### A-001｜沟谷（gully）\n- **解释:** e\n| 英文 | 中文 | 语境 |\n|---|---|---|\n| soil loss | 土壤流失 | c |")], "path string, text string")
    assert ids(markdown.terms(t)) == ["A-001", "TBL-soil_loss-001"]
    i = spark.createDataFrame([("i.md", "### INNO-2024-05-01-01\n- **创新点:** c\n[[x#KB-2024-05-01-01]] [[2024-05-01_论文阅读日报]]")], "path string, text string")
    r = markdown.innovations(i).first()
    assert r["kb_ref"] == "KB-2024-05-01-01" and r["daily_ref"] == "2024-05-01"
    rl = spark.createDataFrame([("r.md", "| 日期 | t | a | y | s | d | l | m |\n|-|-|-|-|-|-|-|-|\n| 2024-01-01 | T | A | 2020 | S | D | en | m |\n| 2024-01-01 | T | B | 2020 | S | D | en | m |")], "path string, text string")
    assert markdown.reading_list(rl).count() == 1
    c = spark.createDataFrame([("c.md", "Ann - mail | kind | #gis #dem\nno line")], "path string, text string")
    assert markdown.contacts(c).first()["tags"] == ["gis", "dem"]
    assert markdown.vault_sections(c).count() == 0


def test_payloads(spark, tmp_path):
    xml = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>http://arxiv.org/abs/2401.00001v2</id><title>Soil  water</title><summary>s</summary><published>2024-01-02T00:00:00Z</published><author><name>A B</name></author><category term="econ.GN"/></entry></feed>'
    r = payloads.atom_entries(spark.createDataFrame([(xml,)], "xml string")).first()
    assert r["arxiv_id"] == "2401.00001" and r["title"] == "Soil water" and r["category"] == "生态环境" and r["first_author"] == "A B"
    js = '{"data": [{"paperId": "1", "title": "Deep learning for GIS", "abstract": null, "year": 2024, "authors": [{"name": "X"}], "externalIds": {"DOI": "10.1/x"}}]}'
    r = payloads.search_json(spark.createDataFrame([(js,), ("broken",)], "json string")).first()
    assert r["doi"] == "10.1/x" and r["category"] == "遥感/GIS"
    n, e = payloads.graph_json(spark, str(tmp_path / "missing.json"))
    assert n.count() == e.count() == 0
    (tmp_path / "g.json").write_text('{"nodes": [{"id": "a", "entity_type": "Paper", "label": "A"}], "edges": [{"source": "a", "target": "a", "key": "R", "type": "R", "confidence": 0.5}]}')
    n, e = payloads.graph_json(spark, str(tmp_path / "g.json"))
    assert n.first()["label"] == "A" and e.first()["dst"] == "a"


def test_pdf_and_sinks(spark, tmp_path):
    from vellum.sources import pdf

    text = b"BT (A public sentence about soil.) Tj ET"
    (tmp_path / "x.pdf").write_bytes(b"%PDF-1.4\n1 0 obj <</Type /Page>> endobj\n2 0 obj <</Length " + str(len(text)).encode() + b">>\nstream\n" + text + b"\nendstream endobj\n%%EOF")
    (tmp_path / "bad.pdf").write_bytes(b"nothing")
    got = {r["path"]: r for r in pdf.ingest(spark, str(tmp_path), ["streams"], 10).collect()}
    assert "public sentence" in got["x.pdf"]["text"] and got["bad.pdf"]["char_count"] == 0
    n, e = tiny(spark)
    assert '"nodes":[' in sinks.graph_document(n, e)
    assert sinks.mermaid_lines(n, e).where("ord = 0").first()["line"] == "graph LR"
    files = spark.createDataFrame([("a/x.md", "ok"), ("private/y.md", "no"), ("b/z.md", "at /home/me/f")], "path string, text string")
    out = {r["path"]: r["text"] for r in sinks.release_tree(files, ["private"], [], redact=True).collect()}
    assert out == {"a/x.md": "ok", "b/z.md": "at <LOCAL_PATH>"}


def test_streams(spark, tmp_path):
    from vellum.streaming import incremental

    src, sink, ck = (str(tmp_path / x) for x in ("src", "sink", "ck"))
    spark.createDataFrame([("2024-01-01", 1), ("2024-01-01", 1), ("2024-01-02", 2)], "date string, v int").write.parquet(src)
    incremental.ingest_stream(spark, src, "date string, v int", sink, ck).awaitTermination(60)
    assert spark.read.parquet(sink).count() == 2
    assert incremental.changed_files(spark, src, spark.createDataFrame([("gone", "h")], "path string, hash string")).where("change = 'removed'").count() == 1
