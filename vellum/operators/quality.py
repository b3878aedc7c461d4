"""Quality, encoding and reading-level judgements of extracted text. Scores are whole tenths or whole points, so they compare exactly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.functions.lexicons import CN_SECTION_WORDS

LEVELS = ["META_ONLY", "ABSTRACT_ONLY", "PDF_TEXT_PARTIAL", "PDF_TEXT_FULL", "HUMAN_CONFIRMED"]
ENGINES = ["pymupdf4llm", "pymupdf", "pdfplumber", "pypdf", "easyocr", "tesseract", "markitdown"]


def level_rank(level: Column) -> Column:
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, LEVELS)), level), F.lit(0)), F.lit(1)) - 1


def measures(t: Column) -> dict[str, Column]:
    """What the judgements count in a text. Where several are made, these go into a projection of their own, so each is counted once."""
    return {
        "n": F.length(t), "printable": T.printable_chars(t), "paragraphs": F.size(F.filter(F.split(t, "\n\n", -1), lambda x: F.length(T.strip(x)) > 50)), "cjk": T.cjk_chars(t), "latin": F.regexp_count(t, F.lit("[a-zA-Z]")),
        "cjk_wide": T.cjk_chars(t, extension=True), "garbled": T.garbled_runs(t), "all_lines": F.size(T.lines(t)), "short": T.short_lines(t), "words": T.latin_words(t), "bad": F.regexp_count(t, F.lit("[�]")),
        "missing": sum((F.when(F.contains(t, F.lit(w)), 0).otherwise(1) for w in CN_SECTION_WORDS), F.lit(0)),
    }


def quality_tenths(t: Column, m: dict[str, Column] | None = None) -> Column:
    """0 to 10: length, printable share, paragraphs, and enough characters of either script. 0 under 500 characters."""
    m = m or measures(t)
    n, p, paragraphs, cjk, latin = (m[k] for k in ("n", "printable", "paragraphs", "cjk", "latin"))
    s = F.when(n > 50000, 3).when(n > 10000, 2).when(n > 2000, 1).otherwise(0)
    s = s + F.when(p * 100 > n * 95, 3).when(p * 100 > n * 85, 2).when(p * 10 > n * 7, 1).otherwise(0)
    s = s + F.when(paragraphs > 20, 2).when(paragraphs > 5, 1).otherwise(0)
    s = s + F.when((cjk > 100) | (latin > 500), 2).when((cjk > 20) | (latin > 100), 1).otherwise(0)
    return F.when(n.isNull() | (n < 500), F.lit(0)).otherwise(F.least(s, F.lit(10)))


def chinese_check(t: Column, strict: bool = False, m: dict[str, Column] | None = None) -> Column:
    """struct<quality, garbled, short_line_permille, cjk_permille, missing_words>. `strict`: suspicious also with little Chinese in long text."""
    m = m or measures(t)
    n, cjk, garbled, all_lines, short = (m[k] for k in ("n", "cjk_wide", "garbled", "all_lines", "short"))
    corrupted = (n < 500) | ((n > 2000) & (cjk * 100 < n * 5)) | (garbled > 50)
    suspicious = (garbled > 10) | (short * 10 > all_lines * 6)
    if strict:
        suspicious = suspicious | ((n > 2000) & (cjk * 10 < n))
    q = F.when(n < 100, "corrupted").when(corrupted, "corrupted").when(suspicious, "suspicious").otherwise("ok")
    return F.struct(q.alias("quality"), F.when(n < 100, 0).otherwise(garbled).alias("garbled"), F.when(n < 100, 1000).otherwise(F.floor(short * 1000 / all_lines)).cast("long").alias("short_line_permille"), F.when(n < 100, 0).otherwise(F.floor(cjk * 1000 / F.greatest(n, F.lit(1)))).cast("long").alias("cjk_permille"), m["missing"].alias("missing_words"))


def reading_level(t: Column, sections: Column, manual: Column | None = None, m: dict[str, Column] | None = None) -> Column:
    """Level of a text by its length, words and the names of its sections."""
    m = m or measures(t)
    n, words = m["n"], m["words"]
    has = lambda *names: sum((F.array_contains(sections, x).cast("int") for x in names), F.lit(0))
    covered = has("abstract", "introduction", "method", "results", "discussion", "conclusion")
    full = ((n >= 15000) | (words >= 2000)) & (covered >= 3) & (has("method", "data") > 0) & (has("results", "discussion", "conclusion") > 0)
    by_hand = F.when(n > 5000, "PDF_TEXT_FULL").when(n > 1000, "PDF_TEXT_PARTIAL").otherwise("ABSTRACT_ONLY")
    level = F.when(n.isNull() | (n < 100), "META_ONLY").when(n < 500, "ABSTRACT_ONLY")
    if manual is not None:
        level = level.when(manual, by_hand)
    return level.when(full, "PDF_TEXT_FULL").when(n > 500, "PDF_TEXT_PARTIAL").otherwise("ABSTRACT_ONLY")


def downgraded(level: Column, quality: Column) -> Column:
    return F.when((quality == "corrupted") & (level == "PDF_TEXT_FULL"), "PDF_TEXT_PARTIAL").otherwise(level)


def assessment(t: Column, m: dict[str, Column] | None = None) -> Column:
    """struct<overall_permille, level>: garbled share, Chinese share, density, weighted 0.4, 0.35, 0.25."""
    m = m or measures(t)
    n = m["n"]
    size = F.greatest(n, F.lit(1))
    g = F.greatest(F.lit(0.0), 1 - m["bad"] / size)
    r = m["cjk"] / size
    lang = F.when(r > 0.3, F.least(F.lit(1.0), r / 0.6)).otherwise(r / 0.3)
    density = F.when(n > 3000, 1.0).when(n > 1000, 0.7).when(n > 200, 0.4).otherwise(0.1)
    overall = 0.4 * g + 0.35 * lang + 0.25 * density
    level = F.when((n > 3000) & (r > 0.2), "FULL").when((n > 1000) & (r > 0.2), "PARTIAL").otherwise("ABSTRACT")
    return F.struct(F.floor(overall * 1000 + 0.5).cast("long").alias("overall_permille"), level.alias("level"))


def next_engine(engine: Column, overall_permille: Column, available: list[str]) -> Column:
    """The engine to try after a poor result: first text engines, then recognition, then a reading by hand."""
    ocr = [e for e in ("easyocr", "tesseract") if e in available]
    text_engines = [e for e in ENGINES if e in available and e not in ocr]
    step = F.when(overall_permille >= 700, F.lit(None).cast("string"))
    for a, b in zip(text_engines, text_engines[1:], strict=False):
        step = step.when(engine == a, F.lit(b))
    if ocr:
        step = step.when(~engine.isin(ocr), F.lit(ocr[0]))
    return step.otherwise(F.lit("manual"))


def looks_scanned(t: Column, pages: Column) -> Column:
    return (pages > 1) & (F.length(t) < 200 * pages)


def replacement_guard(t: Column) -> Column:
    """Whether lost characters stay under the limit of five or one in a hundred."""
    return F.regexp_count(t, F.lit("�")) <= F.greatest(F.lit(5), F.floor(F.length(t) / 100))


def judged(results: DataFrame) -> DataFrame:
    """All judgements of extraction results beside their ids."""
    names = F.transform(F.coalesce(F.map_keys("sections"), F.array().cast("array<string>")), F.lower)
    counted = measures(F.col("text"))
    rows = results.select("result_id", "engine_used", names.alias("__names"), *(c.alias(f"__{k}") for k, c in counted.items()))
    m = {k: F.col(f"__{k}") for k in counted}
    none = F.lit(None).cast("string")
    out = rows.withColumns({"quality": quality_tenths(none, m), "check": chinese_check(none, m=m), "level": reading_level(none, F.col("__names"), m=m), "assess": assessment(none, m)})
    return out.select("result_id", "quality", F.col("check.quality").alias("encoding"), "level", downgraded(F.col("level"), F.col("check.quality")).alias("final_level"), F.col("assess.overall_permille").alias("overall_permille"), next_engine(F.col("engine_used"), F.col("assess.overall_permille"), ENGINES).alias("next_engine"))
