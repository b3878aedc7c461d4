"""Splitting a text at its headings, and detecting which sections it has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions.text import lines, strip

# Headings that begin a section, whole lines.
HEADINGS = {
    "abstract": ["abstract"],
    "introduction": ["introduction", "引言", "绪论", "研究背景"],
    "related_work": ["related work", "相关研究", "研究进展", "文献综述"],
    "study_area": ["study area", "研究区", "研究区域", "试验区", "样区"],
    "data": ["data", "数据", "材料", "样本", "数据来源", "数据与方法"],
    "method": ["method", "方法", "模型", "算法", "技术路线", "研究方法"],
    "experiment": ["experiment", "实验", "试验", "案例", "应用", "验证"],
    "results": ["results", "结果", "分析结果", "精度评价", "评价结果"],
    "discussion": ["discussion", "讨论", "分析"],
    "conclusion": ["conclusion", "结论", "总结"],
}
# Words that tell of a section without its heading.
LOOSE = {
    "abstract": ["abstract"],
    "introduction": ["introduction"],
    "methods": ["method", "methodology", "materials and methods"],
    "results": ["result", "experiment"],
    "discussion": ["discussion"],
    "conclusion": ["conclusion", "concluding remarks"],
    "references": ["references", "bibliography"],
}
NUMBER = r"(\d+\.?\s*)?"
STRICT = {
    "abstract": rf"{NUMBER}abstract",
    "introduction": rf"{NUMBER}introduction",
    "methods": rf"{NUMBER}(methods?|methodology|materials?\s*(and|&)\s*methods?|data\s*(and|&)\s*methods?|experimental\s*(setup|design)|study\s*area)",
    "results": rf"{NUMBER}(results?(\s*(and|&)\s*discussion)?|experiments?(\s*(and|&)\s*results?)?|evaluation|case\s*stud(y|ies))",
    "discussion": rf"{NUMBER}discussion(\s*(and|&)\s*conclusion)?",
    "conclusion": rf"{NUMBER}(conclusions?|conclusion\s*(and|&)\s*(future\s*)?(work|outlook)|summary)",
    "references": rf"(bibliography|literature\s*cited|{NUMBER}references?)",
}


def heading_of(line: Column, even: bool = False) -> Column:
    """Section that a line begins, else null. `even`: the line is stripped and in lower case already."""
    t = line if even else F.lower(strip(line))
    out = F.lit(None).cast("string")
    for name, words in reversed(HEADINGS.items()):
        out = F.when(t.isin(words), F.lit(name)).otherwise(out)
    return out


def split_sections(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, section, body): lines between headings; `preamble` before the first; the last of equal headings wins; empty ones are dropped.

    Each text is cut where it stands: no row is shuffled, however many lines it has.
    """
    rows = df.select(key, lines(F.col(text)).alias("ls")).withColumn("low", F.transform("ls", lambda x: F.lower(strip(x))))
    marked = F.filter(F.transform("low", lambda x, i: F.struct(i.alias("i"), heading_of(x, True).alias("head"))), lambda c: c["head"].isNotNull())
    rows = rows.select(key, "ls", F.concat(F.array(F.struct(F.lit(-1).alias("i"), F.lit("preamble").alias("head"))), marked).alias("cuts"))
    upto = lambda j: F.coalesce(F.get(F.col("cuts"), j + 1)["i"], F.size("ls"))
    parts = F.filter(F.transform("cuts", lambda c, j: F.struct(c["head"].alias("section"), (c["i"] + 2).alias("from"), (upto(j) - c["i"] - 1).alias("n"))), lambda p: p["n"] > 0)
    rows = rows.select(key, "ls", parts.alias("parts"))
    last = F.filter("parts", lambda p, j: ~F.exists(F.slice("parts", j + 2, F.greatest(F.size("parts") - j - 1, F.lit(0))), lambda q: q["section"] == p["section"]))
    out = rows.select(key, "ls", F.explode(last).alias("p"))
    return out.select(key, "p.section", strip(F.array_join(F.slice("ls", F.col("p.from"), F.col("p.n")), "\n")).alias("body"))


def _first_like(marked: Column, pattern: str) -> Column:
    return F.try_element_at(F.filter(marked, lambda x: (F.length(x["t"]) <= 120) & x["t"].rlike(pattern)), F.lit(1))["n"]


def detected_sections(t: Column) -> Column:
    """map<section, line number>: the first line (from 1, at most 120 characters) that is a heading, -1 where only a word tells of it."""
    entries = []
    marked = F.transform(lines(t), lambda x, i: F.struct(F.lower(strip(x)).alias("t"), (i + 1).alias("n")))
    low = F.lower(t)
    for name, pattern in STRICT.items():
        whole = rf"^{pattern}$" if name != "methods" else rf"^({pattern}|{NUMBER}study\s*area\b.*)$"
        at = _first_like(marked, whole)
        told = F.lit(False)
        for word in LOOSE[name]:
            told = told | F.contains(low, F.lit(word))
        entries.append(F.struct(F.lit(name).alias("key"), F.coalesce(at, F.when(told, F.lit(-1))).alias("value")))
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: e["value"].isNotNull()))


def section_flags(sections: Column) -> Column:
    """struct of what the detected sections amount to."""
    names = F.map_keys(sections)
    has = lambda *n: F.arrays_overlap(names, F.array(*map(F.lit, n)))
    covered = F.size(F.array_intersect(names, F.array(*map(F.lit, ["abstract", "introduction", "methods", "results", "discussion", "conclusion"]))))
    return F.struct(covered.alias("covered"), has("methods").alias("has_methods"), has("results").alias("has_results"), has("discussion", "conclusion").alias("has_discussion"), ((F.size(names) <= 2) & has("references")).alias("only_references"), ((F.size(names) <= 1) & has("abstract")).alias("only_abstract"))
