"""Queries of the problems, whole tables and production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import abuse, encoding, history, linkage, lookalike, mixing, names, scans, splitting, tokens
from vellum.runtime import table

Query = Callable[[SparkSession, str], DataFrame]


# 1. splitting


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    pieces = splitting.oversized_pieces(table(spark, d, "extraction_results"), table(spark, d, "chunk_limits"), with_text=False)
    return pieces.where("piece_no = 0 and n_pieces > 1").select("result_id", "field", "item").distinct()


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    pieces = splitting.oversized_pieces(table(spark, d, "extraction_results"), table(spark, d, "chunk_limits"))
    return pieces.dropDuplicates(["result_id", "field", "item", "piece_no", "piece"])


# 2. new batches against history


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return history.known_candidates(table(spark, d, "seen_papers"), table(spark, d, "candidates"))


def p2_split(spark: SparkSession, d: str) -> DataFrame:
    """Every candidate with its batch and whether its work was known."""
    known = p2_found(spark, d).withColumn("known", F.lit(True))
    return table(spark, d, "candidates").select("cand_id", "batch_no").join(known, "cand_id", "left").withColumn("known", F.coalesce("known", F.lit(False)))


# 3. papers and reading list


def p3_pairs(spark: SparkSession, d: str) -> DataFrame:
    """All candidate pairs with what speaks for them and their confidence."""
    p = table(spark, d, "papers").select("id", "title", "authors", "year", "doi")
    r = table(spark, d, "reading_list").select(F.col("item_id").alias("id"), "title", "authors", "year", "doi")
    return linkage.link(p, r).withColumnsRenamed({"a": "id", "b": "item_id", "title": "title_likeness", "author": "author_likeness", "year": "year_likeness", "doi": "doi_likeness"})


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_pairs(spark, d).where(F.col("confidence") >= linkage.BELIEF).select("id", "item_id")


# 4. look-alike text


def _p4_values(spark: SparkSession, d: str) -> DataFrame:
    terms, papers = table(spark, d, "terms"), table(spark, d, "papers")
    e = terms.select(F.lit("term_english").alias("field"), "id", F.col("english").alias("value"))
    c = terms.select(F.lit("term_chinese").alias("field"), "id", F.col("chinese").alias("value"))
    t = papers.select(F.lit("paper_title").alias("field"), "id", F.col("title").alias("value"))
    return e.unionByName(c).unionByName(t)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.lookalike_pairs(_p4_values(spark, d))


def p4_forms(spark: SparkSession, d: str) -> DataFrame:
    return _p4_values(spark, d).withColumn("form", lookalike.canonical_form(F.col("value")))


# 5. scanned pages


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return scans.scan_lines(table(spark, d, "extraction_results")).distinct()


def p5_text(spark: SparkSession, d: str) -> DataFrame:
    return scans.repaired_texts(table(spark, d, "extraction_results")).distinct()


# 6. wrong encoding


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return encoding.garbled_values(table(spark, d, "extraction_results")).select("result_id", "field").distinct()


def p6_restored(spark: SparkSession, d: str) -> DataFrame:
    rows = encoding.restored_values(table(spark, d, "extraction_results"))
    return rows.dropDuplicates(["result_id", "field", "pos", "value"])


# 7. names


def p7_groups(spark: SparkSession, d: str) -> DataFrame:
    return names.group_spellings(names.spellings_of(table(spark, d, "papers"), table(spark, d, "seen_papers")))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return names.variant_pairs(p7_groups(spark, d))


# 8. tokens


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", "ids")


# 9. mixture


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.reached_shares(p9_mix(spark, d), table(spark, d, "mix_targets"))


# 10. offensive content


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    return abuse.abuse_scores(table(spark, d, "documents"), table(spark, d, "abuse_examples"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_scores(spark, d).where("offensive").select("doc_id")


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    return abuse.abuse_rates(p10_scores(spark, d))


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p1_pieces, p2_found, p2_split, p3_found, p3_pairs, p4_found, p4_forms, p5_found, p5_text, p6_found, p6_restored, p7_found, p7_groups, p8_ids, p9_mix, p9_shares, p10_found, p10_scores, p10_rates)}

SQL: dict[str, str] = {
    "p1_found": """
        with items as (
          select result_id, lang, 'sections' as field, unnest(map_keys(sections)) as item, unnest(map_values(sections)) as text from extraction_results
          union all
          select result_id, lang, 'chunks' as field, cast(unnest(range(len(chunks))) as varchar) as item, unnest(chunks) as text from extraction_results)
        select distinct i.result_id, i.field, i.item from items i
        left join chunk_limits o on o.field = i.field and o.lang = i.lang
        left join chunk_limits a on a.field = i.field and a.lang is null
        where length(i.text) > coalesce(o.max_chars, a.max_chars)""",
}
