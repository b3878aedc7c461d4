"""Markdown sources: entries between headings, their fields, tables and lists, as rows.

Every reader takes a DataFrame (path, text) of whole files, as `whole_files` gives it, and works on positions of lines, so a
file is read once. Dates are carried down from the heading before an entry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from vellum.functions import text as T

HEADERS = {
    "paper": r"^###\s+((?:KB-\d{4}-\d{2}-\d{2}-\d+)|(?:Paper_ID:\s*\S+))\s*[|｜]?\s*(.*)$",
    "term": r"^###\s+([A-Z]-\d{3})[|｜](.*)$",
    "technique": r"^###\s+(技法-\S+?-\d{3})[|｜](.*)$",
    "innovation": r"^###\s+(INNO-\d{4}-\d{2}-\d{2}-\d+)\s*(.*)$",
}
DATE = r"^##\s+(\d{4}-\d{2}-\d{2})"


def whole_files(spark: SparkSession, path: str, pattern: str = "*.md") -> DataFrame:
    """(path, text) of the files below a folder."""
    df = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path)
    return df.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def blocks(files: DataFrame, kind: str) -> DataFrame:
    """(path, id, title, date, block): entries of one kind up to the next heading of second or third level; the first of equal ids wins."""
    head = HEADERS[kind]
    rows = files.select("path", F.posexplode(T.lines(F.col("text"))).alias("pos", "line"))
    rows = rows.withColumns({"id": F.nullif(F.regexp_extract("line", head, 1), F.lit("")), "name": F.regexp_extract("line", head, 2), "stop": F.col("line").rlike("^##[#]?\\s"), "date": F.nullif(F.regexp_extract("line", DATE, 1), F.lit(""))})
    w = W.Window.partitionBy("path").orderBy("pos").rowsBetween(W.Window.unboundedPreceding, 0)
    rows = rows.withColumns({"segment": F.sum(F.col("stop").cast("int")).over(w), "date": F.last("date", ignorenulls=True).over(w)})
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")
    out = rows.groupBy("path", "segment").agg(F.max("id").alias("id"), F.max_by("name", F.col("id").isNotNull()).alias("title"), F.min_by("date", "pos").alias("date"), F.min("pos").alias("pos"), body.alias("block")).where("id is not null")
    out = out.withColumn("id", F.regexp_replace("id", r"^Paper_ID:\s*", ""))
    first = out.groupBy("id").agg(F.min_by(F.struct("path", "title", "date", "block"), F.struct("path", "pos")).alias("r"))
    return first.select("r.path", "id", T.strip(F.col("r.title")).alias("title"), "r.date", "r.block")


def _field(fields: Column, *names: str) -> Column:
    return F.coalesce(*(F.nullif(F.try_element_at(fields, F.lit(n)), F.lit("")) for n in names))


def papers(files: DataFrame) -> DataFrame:
    b = blocks(files, "paper").withColumn("f", T.field_map(F.col("block")))
    f = F.col("f")
    number = lambda c, p: F.try_to_number(F.nullif(F.regexp_extract(c, p, 1), F.lit("")), F.lit("9999")).cast("int")
    return b.select("id", F.coalesce(F.nullif("title", F.lit("")), _field(f, "标题"), "id").alias("title"), F.lit("Paper").alias("entity_type"), _field(f, "作者").alias("authors"), number(F.coalesce(_field(f, "年份"), F.lit("")), r"(\d{4})").alias("year"), _field(f, "来源", "期刊").alias("source"), _field(f, "DOI").alias("doi"), number(F.coalesce(_field(f, "评分"), F.lit("")), r"(\d+)").alias("score"), _field(f, "等级").alias("grade"), T.list_items(F.coalesce(_field(f, "主题", "主题标签"), F.lit(""))).alias("topics"), _field(f, "一句话总结", "一句话").alias("summary"), T.list_items(F.coalesce(_field(f, "方法"), F.lit(""))).alias("methods"), _field(f, "可信度").alias("credibility"), _field(f, "全文证据状态").alias("reading_level"), F.coalesce(_field(f, "加入"), F.regexp_extract("id", r"KB-(\d{4}-\d{2}-\d{2})", 1), "date").alias("kb_date"))


def terms(files: DataFrame) -> DataFrame:
    """Entries `### A-001｜中文（English）` and rows of `| english | 中文 | context |` tables, which get numbered ids per slug."""
    b = blocks(files, "term").withColumn("f", T.field_map(F.col("block")))
    name = r"^(.*?)(?:[（(]([^）)]*)[）)])?\s*$"
    a = b.select("id", F.nullif(F.regexp_extract("title", name, 2), F.lit("")).alias("english"), F.nullif(F.regexp_extract("title", name, 1), F.lit("")).alias("chinese"), F.substring("id", 1, 1).alias("category"), _field(F.col("f"), "解释").alias("explanation"), T.list_items(F.coalesce(_field(F.col("f"), "来源"), F.lit(""))).alias("sources"), F.coalesce(_field(F.col("f"), "入库日期"), "date").alias("date_added"))
    rows = table_rows(files, 3).where("not c1 rlike '^:?-+:?$' and c1 not in ('英文', 'English')")
    slug = T.slug(F.lower("c1"), 30)
    n = F.row_number().over(W.Window.partitionBy(slug).orderBy("path", "pos"))
    t = rows.select(F.format_string("TBL-%s-%03d", slug, n).alias("id"), F.col("c1").alias("english"), F.col("c2").alias("chinese"), F.lit("TBL").alias("category"), F.col("c3").alias("explanation"), F.array().cast("array<string>").alias("sources"), F.lit(None).cast("string").alias("date_added"))
    return a.unionByName(t)


def techniques(files: DataFrame) -> DataFrame:
    b = blocks(files, "technique").withColumn("f", T.field_map(F.col("block")))
    f = F.col("f")
    return b.select("id", F.col("title").alias("name"), F.regexp_extract("id", "技法-(.*?)-", 1).alias("category"), _field(f, "技法").alias("template"), _field(f, "怎么用").alias("usage"), T.list_items(F.coalesce(_field(f, "适用场景"), F.lit(""))).alias("scenarios"), T.list_items(F.coalesce(_field(f, "来源"), F.lit(""))).alias("sources"), _field(f, "入库日期").alias("date_added"), F.array_distinct(F.filter(F.regexp_extract_all("block", F.lit(r"(技法-\S+?-\d{3})"), F.lit(1)), lambda x: x != F.col("id"))).alias("complements"))


def innovations(files: DataFrame) -> DataFrame:
    b = blocks(files, "innovation").withColumns({"f": T.field_map(F.col("block")), "links": T.wiki_links(F.col("block"))})
    f = F.col("f")
    return b.select("id", _field(f, "创新点类型").alias("innovation_type"), _field(f, "创新点").alias("content"), _field(f, "来源论文").alias("source_paper"), _field(f, "可迁移方向").alias("direction"), _field(f, "可信度").alias("credibility"), _field(f, "状态").alias("status"), T.kb_reference(F.col("links")).alias("kb_ref"), T.daily_reference(F.col("links")).alias("daily_ref"))


def daily_reports(files: DataFrame, most: int = 50000) -> DataFrame:
    """Reports named `YYYY-MM-DD_论文阅读日报.md`: date, number of papers, start of the text."""
    day = F.regexp_extract("path", r"(\d{4}-\d{2}-\d{2})_[^/]*$", 1)
    t = F.substring("text", 1, most)
    n = F.coalesce(F.nullif(F.regexp_extract(t, r"(?:候选论文数|检索论文总数)[^0-9\n]*(\d+)", 1), F.lit("")), F.nullif(F.regexp_extract(t, r"(\d+)\s*篇", 1), F.lit("")))
    return files.withColumn("date", day).where("date <> ''").select("path", "date", n.cast("int").alias("paper_count"), F.substring(t, 1, 200).alias("overview"))


def table_rows(files: DataFrame, columns: int) -> DataFrame:
    """(path, pos, c1..cN): rows of Markdown tables with exactly so many cells."""
    rows = files.select("path", F.posexplode(T.lines(F.col("text"))).alias("pos", "line")).where(r"line rlike '^\\s*\\|.*\\|\\s*$'")
    cells = F.transform(F.split(F.regexp_replace("line", r"^\s*\||\|\s*$", ""), r"\|", -1), T.strip)
    rows = rows.withColumn("c", cells).where(F.size("c") == columns)
    return rows.select("path", "pos", *(F.element_at("c", i + 1).alias(f"c{i + 1}") for i in range(columns)))


def reading_list(files: DataFrame) -> DataFrame:
    """Eight-column tables; the first of equal date and title wins."""
    names = ["date", "title", "authors", "year", "source", "doi", "lang", "method"]
    r = table_rows(files, 8).where(r"c1 rlike '^\\d{4}-\\d{2}-\\d{2}$'")
    r = r.select("path", "pos", *(F.col(f"c{i + 1}").alias(n) for i, n in enumerate(names)))
    best = r.groupBy("date", F.substring("title", 1, 80).alias("t")).agg(F.min_by(F.struct(*names), F.struct("path", "pos")).alias("r"))
    return best.select("r.*")


def numbered_notes(files: DataFrame) -> DataFrame:
    """Lines `12. text` with the heading they stand under."""
    rows = files.select("path", F.posexplode(T.lines(F.col("text"))).alias("pos", "line"))
    w = W.Window.partitionBy("path").orderBy("pos").rowsBetween(W.Window.unboundedPreceding, 0)
    rows = rows.withColumn("section", F.last(F.when(F.col("line").rlike("^[^0-9].*(历史|整合)"), T.strip(F.col("line"))), ignorenulls=True).over(w))
    num = F.regexp_extract("line", r"^(\d+)\.?\s*(.+)$", 1)
    return rows.withColumn("number", F.nullif(num, F.lit("")).cast("int")).where("number is not null").select("path", "number", F.regexp_extract("line", r"^(\d+)\.?\s*(.+)$", 2).alias("content"), "section")


def contacts(files: DataFrame) -> DataFrame:
    """Lines `name - channel | impression | #tags`."""
    rows = files.select("path", F.explode(T.lines(F.col("text"))).alias("line")).where("instr(line, ' - ') > 0")
    rest = F.element_at(F.split("line", " - ", 2), 2)
    part = lambda i: F.nullif(T.strip(F.coalesce(F.try_element_at(F.split(rest, r"\|"), F.lit(i)), F.lit(""))), F.lit(""))
    return rows.select(T.strip(F.element_at(F.split("line", " - ", 2), 1)).alias("name"), part(1).alias("channel"), part(2).alias("impression"), F.regexp_extract_all("line", F.lit(r"#(\S+)"), F.lit(1)).alias("tags"))


def workflow_files(spark: SparkSession, path: str, depth: int = 3, most: int = 5000, extensions: tuple[str, ...] = ("md", "txt")) -> DataFrame:
    """(path, kind, title, content) of documents at most `depth` folders below `path`; title is the first heading, else the file name."""
    pattern = "*.{" + ",".join(extensions) + "}"
    f = whole_files(spark, path, pattern)
    root = path.rstrip("/")
    rel = F.regexp_replace("path", r"^.*?" + root.replace("/", "\\/").lstrip("\\/") + r"\/", "")
    f = f.withColumn("rel", rel).where(F.size(F.split("rel", "/")) <= depth + 1)
    title = F.coalesce(F.nullif(F.regexp_extract("text", r"(?m)^#\s+(.+)$", 1), F.lit("")), F.regexp_extract("rel", r"([^/]+?)(\.[^./]+)?$", 1))
    return f.select("path", F.element_at(F.split("rel", "/"), 1).alias("kind"), T.strip(title).alias("title"), F.substring("text", 1, most).alias("content"))


def vault_sections(files: DataFrame, private: bool = False) -> DataFrame:
    """(path, name, content) of the second-level sections of a notes vault. Nothing unless private sources are asked for."""
    rows = files.where(F.lit(private)).select("path", F.explode(F.split("text", r"(?m)(?=^##\s+)")).alias("part"))
    return rows.select("path", T.strip(F.regexp_extract("part", r"^##\s+(.+)", 1)).alias("name"), T.strip(F.regexp_replace("part", r"^##\s+.+\n?", "")).alias("content")).where("name <> ''")


def manual_notes(files: DataFrame) -> DataFrame:
    """Readings written by hand: fields at line beginnings, the whole note as body, and how complete it is."""
    names = ["标题", "作者", "年份", "期刊", "DOI", "研究问题", "研究区", "数据", "方法", "结果", "结论", "局限", "启示"]
    get = lambda n: F.nullif(T.strip(F.regexp_extract("text", rf"(?m)^\s*(?:[-*]\s*)?\**{n}\**\s*[:：]\**\s*(.+)$", 1)), F.lit(""))
    out = files.select("path", F.col("text").alias("body"), F.map_filter(F.create_map(*(x for n in names for x in (F.lit(n), get(n)))), lambda k, v: v.isNotNull()).alias("fields"))
    n = F.size("fields")
    return out.withColumn("reading_quality", F.when((n >= 8) & (F.length("body") > 1000), "high").when(n >= 4, "medium").otherwise("low"))
