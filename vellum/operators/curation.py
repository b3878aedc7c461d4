"""Rules of the curated day and of ingestion: duplicates of several stores, reading levels, gates, evidence snippets, rule labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from vellum.functions import text as T
from vellum.functions.lexicons import any_hit
from vellum.operators.links import phrases_in_texts

# Texts that stand in a card where nothing was found.
PLACEHOLDERS = ["正文中未检测到", "摘要中未检测到", "不代表没有价值", "不代表没有局限", "建议人工阅读", "无法检查", "未检测到明确", "未检测到常见方法名", "未检测到结构化结果段落", "未检测到独立结论", "未检测到明确提出局限性", "未检测到明确数据来源", "未检测到明确实验设计", "未检测到明确研究区", "未检测到明确可迁移点"]
# Families of methods by words in their names.
METHOD_FAMILIES = {
    "ML": ["NN", "CNN", "Deep Learning", "Random Forest", "XGBoost", "SVM", "SVR", "KNN", "Gradient Boosting", "ANN", "Logistic Regression", "Ridge", "LASSO", "PCA", "K-Means", "DBSCAN", "MaxEnt", "AdaBoost", "MARS", "GLM", "GAM", "BRT", "BART", "CDTree", "BFTree", "KLR"],
    "GIS": ["GWR", "Moran's I", "IDW", "Kriging", "OBIA"],
    "RemoteSensing": ["Sentinel", "Landsat", "UAV", "LiDAR", "SfM", "Point Cloud", "Change Detection", "TLS"],
    "Geomorphology": ["RUSLE", "USLE", "InVEST", "SWAT", "AHP", "Frequency Ratio", "Information Value", "Weight of Evidence", "Certainty Factor", "COPRAS", "SWARA", "Markov Chain", "Cellular Automata"],
}
# Rules for what a paper may lend; every group of words needs a hit.
INNOVATION_RULES = [
    ("方法迁移", "ML/DL方法可迁移到DEM地形因子提取/侵蚀预测/沟谷自动识别", [["machine learning", "deep learning", "cnn", "transformer", "random forest", "xgboost", "neural network"]]),
    ("方法迁移", "空间分析方法可迁移到GIS空间建模/侵蚀空间格局分析", [["spatial", "gis", "geospatial", "spatial analysis"]]),
    ("方法迁移", "DEM/地形分析方法可迁移到数字地形分析/沟谷形态定量研究", [["dem", "digital elevation", "terrain", "topograph", "geomorpholog"]]),
    ("方法迁移", "沟谷/沟蚀分析方法可迁移到黄土高原/干热河谷沟蚀地貌研究", [["gully", "gully erosion", "rill", "bank erosion"]]),
    ("数据融合", "多源遥感+DEM数据融合方法可迁移到侵蚀地形因子提取", [["sentinel", "landsat", "modis", "remote sens", "satellite", "uav"], ["dem", "elevation", "terrain", "topograph"]]),
    ("数据融合", "GEE云端处理流程可迁移到区域尺度侵蚀/地形分析", [["gee", "google earth engine", "cloud"], ["erosion", "terrain", "dem", "gully"]]),
    ("应用场景", "土壤侵蚀/水文模型可迁移到黄土高原/干热河谷侵蚀评估场景", [["erosion", "soil", "watershed", "hydrolog", "sediment"]]),
    ("应用场景", "区域研究成果可直接指导黄土高原/干热河谷DEM地貌研究", [["loess", "dry-hot", "jinsha", "yuanmou"]]),
    ("自动化流程", "自动化处理流程可作为GIS数据处理工具链参考", [["python", "pipeline", "automation", "workflow", "open source"]]),
    ("自动化流程", "AI辅助/Agent方法可迁移到GIS自动化工作流", [["ai agent", "llm", "large language model", "automated coding"]]),
]
# Words of sentences that tell a result, and of those that admit a limitation.
RESULT_WORDS = ["result", "find", "show", "observ", "achieve", "perform", "accur", "error", "improv", "compar", "signific", "outperform", "better", "higher", "lower", "increase", "decrease", "correlat", "percent", "%"]
LIMITATION = r"(?:limitation|shortcoming|drawback|weakness|future\s*work|not\s*addressed|beyond\s*scope|further\s*(?:study|research|investigation))"


def first_unseen(new: DataFrame, seen: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of `new` whose key the state lacks, the first of each key by `order`; rows without key are all kept."""
    fresh = new.join(seen.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")
    one = fresh.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*new.columns), order).alias("r")).select("r.*")
    return one.unionByName(fresh.where(F.col(key).isNull()).select(one.columns))


def store_duplicates(new: DataFrame, entries: DataFrame, key: str) -> DataFrame:
    """(key, reason) of the rows of `new` (key, doi, title) that a store `entries` (id, doi, title) has: equal DOI, case and all;
    equal normalised title; or, both longer than 40 characters, one held by the other. The strongest reason counts."""
    norm = lambda df, i: df.select(F.col(i).alias("k"), F.trim("doi").alias("doi"), T.normalized_title(F.col("title")).alias("t"))
    a, b = norm(new, key), norm(entries, "id")
    doi = a.where("doi <> ''").join(b.where("doi <> ''").select("doi").distinct().hint("merge"), "doi", "left_semi").select("k", F.lit("1 doi").alias("r"))
    title = a.where("t <> ''").join(b.where("t <> ''").select("t").distinct().hint("merge"), "t", "left_semi").select("k", F.lit("2 title").alias("r"))
    long_a, long_b = a.where("length(t) > 40"), b.where("length(t) > 40")
    text = lambda df: df.select(F.col("t").alias("text_id"), F.col("t").alias("text")).distinct()
    phrase = lambda df: df.select(F.col("t").alias("phrase_id"), F.col("t").alias("phrase")).distinct()
    inside = phrases_in_texts(phrase(long_a), text(long_b)).select(F.col("phrase_id").alias("t"))
    around = phrases_in_texts(phrase(long_b), text(long_a)).select(F.col("text_id").alias("t"))
    held = long_a.join(inside.unionByName(around).distinct().hint("merge"), "t", "left_semi").select("k", F.lit("3 held").alias("r"))
    return doi.unionByName(title).unionByName(held).groupBy("k").agg(F.substring(F.min("r"), 3, 10).alias("reason")).withColumnRenamed("k", key)


def index_duplicates(new: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """(key) of the rows of `new` that an index (doi, arxiv_id, title) has: by DOI, arXiv id, or the first 60 characters of titles
    of more than 20, each as written."""
    low = lambda c: F.lower(F.trim(c))
    tests = lambda: F.explode(F.array(F.struct(F.lit("doi").alias("test"), F.col("doi").alias("v")), F.struct(F.lit("arxiv").alias("test"), F.col("arxiv_id").alias("v")), F.struct(F.lit("title").alias("test"), F.when(F.length("title") > 20, F.substring(low("title"), 1, 60)).alias("v"))))
    a = new.select(key, tests().alias("x")).select(key, "x.*").where("v is not null and v <> ''")
    b = index.select(tests().alias("x")).select("x.*").where("v is not null and v <> ''").distinct()
    return a.join(b, ["test", "v"], "left_semi").select(key).distinct()


def reading_level(download: Column, extraction: Column, has_abstract: Column, chars: Column, words: Column, key_sections: Column, has_methods: Column, has_results: Column, only_abstract: Column) -> Column:
    """Level by what full text there is: status of download and extraction, length, and sections."""
    enough = ((words >= 2000) | (chars >= 15000)) & (key_sections >= 3) & has_methods & has_results & ~only_abstract
    return (
        F.when(download == "no_url", F.when(has_abstract, "ABSTRACT_ONLY").otherwise("META_ONLY"))
        .when((download == "failed") | (extraction == "failed"), "ABSTRACT_ONLY")
        .when(enough, "PDF_TEXT_FULL")
        .when(chars > 500, "PDF_TEXT_PARTIAL")
        .otherwise("ABSTRACT_ONLY")
    )


def fulltext_stats(rows: DataFrame) -> DataFrame:
    """One row of counts over rows (reading_level, download, extraction, ocr_required)."""
    level = lambda x: F.count_if(F.col("reading_level") == x)
    got = F.col("download") == "downloaded"
    return rows.agg(
        F.count("*").alias("total"), F.count_if(F.col("download") != "no_url").alias("attempted"), F.count_if(got).alias("downloaded"), F.count_if(F.col("download") == "failed").alias("download_failed"),
        level("PDF_TEXT_FULL").alias("pdf_text_full"), level("PDF_TEXT_PARTIAL").alias("pdf_text_partial"), level("ABSTRACT_ONLY").alias("abstract_only"), level("META_ONLY").alias("meta_only"),
        F.count_if(got & (F.col("extraction") == "failed")).alias("parse_failed"), F.count_if(F.coalesce("ocr_required", F.lit(False))).alias("ocr_needed"),
    )


def status_counts(rows: DataFrame) -> DataFrame:
    """One row: results that succeeded (poor ones too), were skipped, failed."""
    return rows.agg(F.count_if(F.col("status").isin("success", "low_quality")).alias("success"), F.count_if(F.col("status") == "skipped").alias("skipped"), F.count_if(F.col("status") == "failed").alias("failed"))


def placeholders(card: Column) -> Column:
    """How many of the placeholder texts a card holds; a card of five or more is poor."""
    return sum((F.contains(card, F.lit(p)).cast("int") for p in PLACEHOLDERS), F.lit(0))


def method_family(name: Column) -> Column:
    out = F.lit("Statistics")
    for family, words in reversed(METHOD_FAMILIES.items()):
        out = F.when(any_hit(name, words), F.lit(family)).otherwise(out)
    return out


def canonical_method(raw: Column, names: dict[str, str]) -> Column:
    """The canonical name of a method: of its keyword, else of the first keyword of more than three characters inside it; null if none."""
    low = F.lower(T.strip(raw))
    out = F.lit(None).cast("string")
    for k, v in reversed(names.items()):
        if len(k) > 3:
            out = F.when(F.contains(low, F.lit(k)), F.lit(v)).otherwise(out)
    for k, v in names.items():
        out = F.when(low == k, F.lit(v)).otherwise(out)
    return out


def innovations(context: Column, most: int = 3) -> Column:
    """array<struct<type, text>>: the first rules whose every group of words has a hit in the lower-cased context."""
    found = []
    for kind, text, groups in INNOVATION_RULES:
        hit = F.lit(True)
        for words in groups:
            hit = hit & any_hit(context, words)
        found.append(F.when(hit, F.struct(F.lit(kind).alias("type"), F.lit(text).alias("text"))))
    return F.slice(F.filter(F.array(*found), lambda x: x.isNotNull()), 1, most)


def sentences(t: Column) -> Column:
    return F.split(t, r"(?<=[.!?])\s+", -1)


def result_sentences(t: Column, most: int = 5) -> Column:
    """The first sentences of more than 30 characters that tell a result, trimmed."""
    tells = lambda s: (F.length(T.strip(s)) > 30) & any_hit(F.lower(s), RESULT_WORDS)
    return F.slice(F.transform(F.filter(sentences(t), tells), T.strip), 1, most)


def conclusion_sentences(t: Column, most: int = 3) -> Column:
    """The first sentences of more than 30 characters, trimmed."""
    return F.slice(F.filter(F.transform(sentences(t), T.strip), lambda s: F.length(s) > 30), 1, most)


def limitation_sentences(t: Column, most: int = 3) -> Column:
    """Sentences that admit a limitation, at most 150 characters of each, distinct, in order."""
    found = F.regexp_extract_all(t, F.lit(rf"(?i)([^.]*?{LIMITATION}[^.]*\.)"), F.lit(1))
    kept = F.filter(F.transform(F.slice(found, 1, most), lambda s: F.substring(T.strip(s), 1, 150)), lambda s: F.length(s) > 20)
    return F.array_distinct(kept)


def source_status(pdf: Column, page: Column, metadata: Column) -> Column:
    """The best source that is archived."""
    has = lambda c: F.coalesce(c != "", F.lit(False))
    return F.when(has(pdf), "pdf").when(has(page), "html").when(has(metadata), "metadata").otherwise("none")


def top_per_group(rows: DataFrame, group: list[str], order: list[Column], most: int) -> DataFrame:
    """The first `most` rows of each group."""
    w = W.Window.partitionBy(*group).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def keyword_targets(texts: DataFrame, targets: DataFrame, keywords: dict[str, str], kind: str, confidence: float, most: int = 5) -> DataFrame:
    """Edges from texts (id, text) to targets (id, name): a keyword in the text leads to the targets whose name holds the word it
    stands for, at most `most` of a text and keyword. `keywords`: a small lexicon."""
    spark = texts.sparkSession
    lexicon = spark.createDataFrame(list(keywords.items()), "keyword string, word string")
    to = F.broadcast(lexicon).join(targets.select(F.col("id").alias("dst"), F.lower("name").alias("name")), F.expr("contains(name, word)")).select("keyword", "dst")
    named = top_per_group(to, ["keyword"], [F.col("dst")], most).select("keyword", "dst")
    low = F.lower(F.coalesce("text", F.lit("")))
    hit = F.filter(F.array(*(F.when(F.contains(low, F.lit(k)), F.lit(k)) for k in keywords)), lambda x: x.isNotNull())
    met = texts.select(F.col("id").alias("src"), F.explode(hit).alias("keyword")).join(named, "keyword")
    return met.select("src", "dst", F.lit(kind).alias("type"), F.lit(confidence).alias("confidence")).distinct()


def config_checks(files: DataFrame, required: list[str], keys: dict[str, list[str]]) -> DataFrame:
    """(subject, ok, message) for files (name, json): each required file is there and parses, and holds its required keys, not empty."""
    spark = files.sparkSession
    want = spark.createDataFrame([(f,) for f in required], "name string")
    parsed = F.try_parse_json("json") if hasattr(F, "try_parse_json") else F.from_json("json", "map<string,string>")
    f = want.join(files.select("name", "json", parsed.isNotNull().alias("good")), "name", "left")
    whole = f.select(F.col("name").alias("subject"), F.coalesce("good", F.lit(False)).alias("ok"), F.when(F.col("json").isNull(), "missing").when(F.col("good"), "OK").otherwise("not JSON").alias("message"))
    pairs = [(n, k) for n, ks in keys.items() for k in ks]
    if not pairs:
        return whole
    asked = spark.createDataFrame(pairs, "name string, key string").join(files, "name")
    value = F.element_at(F.from_json("json", "map<string,string>"), F.col("key"))
    bad = asked.where(value.isNull() | (value == "")).select(F.concat_ws(".", "name", "key").alias("subject"), F.lit(False).alias("ok"), F.lit("key missing").alias("message"))
    return whole.unionByName(bad)
