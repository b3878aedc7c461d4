"""Structured payloads: graph JSON, metadata files, search-service answers, state tables, source index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.operators.scoring import category

NODE = "id string, entity_type string, label string, source_type string, source_file string, title string, canonical_name string, english string, chinese string, category string, topics array<string>"
EDGE = "source string, target string, key string, type string, source_file string, confidence double"


def graph_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a `{nodes: [], edges: []}` file; a missing file is an empty graph."""
    schema = f"nodes array<struct<{_struct(NODE)}>>, edges array<struct<{_struct(EDGE)}>>"
    try:
        g = spark.read.schema(schema).option("multiLine", True).json(path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        g = spark.createDataFrame([], schema)
    nodes = g.select(F.explode("nodes").alias("n")).select("n.*").withColumn("label", F.coalesce("label", "id"))
    edges = g.select(F.explode("edges").alias("e")).select(F.col("e.source").alias("src"), F.col("e.target").alias("dst"), F.coalesce("e.type", "e.key").alias("type"), "e.confidence", "e.source_file")
    return nodes, edges


def _struct(ddl: str) -> str:
    return ", ".join(f"{a.split(' ', 1)[0]}: {a.split(' ', 1)[1]}" for a in ddl.split(", "))


def metadata_files(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of all metadata.json files below a folder; unreadable ones have everything null but their text."""
    df = spark.read.schema(schema + ", _corrupt_record string").option("columnNameOfCorruptRecord", "_corrupt_record").option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "metadata.json").json(path)
    return df


def atom_entries(feeds: DataFrame, most_abstract: int = 800) -> DataFrame:
    """Papers of Atom feeds (xml): one row per entry, ids, authors, abstract and category evened out."""
    schema = "entry array<struct<id: string, title: string, summary: string, published: string, author: array<struct<name: string>>, category: array<struct<_term: string>>, link: array<struct<_href: string, _title: string>>>>"
    e = feeds.select(F.from_xml(F.regexp_replace("xml", r'\sxmlns(:\w+)?="[^"]*"', ""), schema, {"attributePrefix": "_"}).alias("f")).select(F.explode("f.entry").alias("e")).select("e.*")
    squeeze = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    arxiv = F.regexp_replace(F.element_at(F.split("id", "/abs/"), -1), r"v\d+$", "")
    authors = F.transform("author", lambda a: a["name"])
    return e.select(F.substring(F.md5(F.lower(squeeze(F.col("title")))), 1, 12).alias("paper_id"), squeeze(F.col("title")).alias("title"), authors.alias("authors"), F.try_element_at(authors, F.lit(1)).alias("first_author"), F.substring("published", 1, 4).alias("year"), F.lit("arXiv").alias("source"), arxiv.alias("arxiv_id"), F.concat(F.lit("https://arxiv.org/abs/"), arxiv).alias("url"), F.concat(F.lit("https://arxiv.org/pdf/"), arxiv).alias("pdf_url"), F.substring(squeeze(F.col("summary")), 1, most_abstract).alias("abstract"), atom_category(F.transform("category", lambda c: c["_term"]), F.col("title")).alias("category"), F.substring("published", 1, 10).alias("published"))


def atom_category(terms: Column, title: Column) -> Column:
    from vellum.functions.lexicons import CATEGORIES as C
    from vellum.functions.lexicons import any_hit

    has = lambda *w: F.exists(terms, lambda c: any_hit(F.lower(c), list(w)))
    base = F.when(F.exists(terms, lambda c: F.contains(c, F.lit("cs."))), C["ai"]).when(F.exists(terms, lambda c: F.contains(c, F.lit("stat."))), C["stat"]).when(has("q-bio", "q-fin", "econ"), C["cross"]).when(has("geo", "earth", "environ", "ecolog", "atmos"), C["gis"]).otherwise(C["cross"])
    green = any_hit(F.lower(title), ["ecolog", "ecosystem", "soil", "water", "climat", "carbon", "environment", "hydrolog", "vegetation", "land degradation", "erosion"])
    return F.when((base == C["cross"]) & green, C["eco"]).otherwise(base)


def search_json(answers: DataFrame, most_abstract: int = 800) -> DataFrame:
    """Papers of JSON search answers (json): one row per item."""
    schema = "data array<struct<paperId: string, title: string, abstract: string, year: int, citationCount: bigint, isOpenAccess: boolean, url: string, authors: array<struct<name: string>>, externalIds: struct<DOI: string, ArXiv: string>, openAccessPdf: struct<url: string>, publicationVenue: struct<name: string>>>"
    e = answers.select(F.from_json("json", schema).alias("f")).select(F.explode("f.data").alias("e")).select("e.*")
    authors = F.transform("authors", lambda a: a["name"])
    return e.select(F.substring(F.md5(F.lower("title")), 1, 12).alias("paper_id"), "title", authors.alias("authors"), F.try_element_at(authors, F.lit(1)).alias("first_author"), F.col("year").cast("string").alias("year"), F.lit("Semantic Scholar").alias("source"), F.col("externalIds.ArXiv").alias("arxiv_id"), F.col("externalIds.DOI").alias("doi"), "url", F.col("openAccessPdf.url").alias("pdf_url"), F.substring("abstract", 1, most_abstract).alias("abstract"), category(F.col("title"), F.col("publicationVenue.name"), F.col("abstract")).alias("category"), F.col("isOpenAccess").alias("is_oa"), F.col("publicationVenue.name").alias("venue"), F.col("citationCount").alias("citations"))


def fulltext_urls(papers: DataFrame) -> DataFrame:
    """(paper_id, url, priority) of where a full text may be had, best first."""
    has = lambda c: F.col(c).isNotNull() & (F.col(c) != "")
    one = lambda cond, url, p: F.when(cond, F.struct(url.alias("url"), F.lit(p).alias("priority")))
    opts = F.array(one(has("pdf_url"), F.col("pdf_url"), 100), one(has("arxiv_id"), F.concat(F.lit("https://arxiv.org/pdf/"), F.col("arxiv_id")), 90), one(has("doi"), F.concat(F.lit("https://doi.org/"), F.col("doi")), 70), one(has("url"), F.col("url"), 50))
    return papers.select("paper_id", F.explode(F.filter(opts, lambda x: x.isNotNull())).alias("o")).select("paper_id", "o.url", "o.priority")


def source_index(spark: SparkSession, path: str) -> DataFrame:
    cols = "date title doi arxiv_id url source_type local_path status reason sha256 downloaded_at record_file".split()
    return spark.read.schema(", ".join(f"{c} string" for c in cols)).option("header", True).csv(path)


def file_hashes(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, hash, length) of the files below a folder, by content."""
    b = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return b.select("path", F.sha2("content", 256).alias("hash"), "length")
