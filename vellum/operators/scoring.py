"""Scores and labels from keyword lexicons over title and abstract."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellum.functions import lexicons as L


def context(title: Column, abstract: Column) -> Column:
    return F.lower(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(abstract, F.lit(""))))


def rubric(title: Column, abstract: Column, is_oa: Column) -> Column:
    """struct of the seven dimensions (1 to 5) and their weighted total (0 to 100)."""
    ctx, n = context(title, abstract), F.length(F.coalesce(abstract, F.lit("")))
    two = lambda words: 3 + F.least(F.lit(2), L.hits(ctx, words))
    direction = F.least(F.lit(5), 2 + L.hits(ctx, L.DIRECTION))
    evidence = F.when(F.coalesce(is_oa, F.lit(False)), F.least(two(L.EVIDENCE) + 1, F.lit(5))).otherwise(two(L.EVIDENCE))
    argument = F.when(n > 400, 4).otherwise(3)
    argument = F.when(L.any_hit(ctx, L.ARGUMENT), F.least(argument + 1, F.lit(5))).otherwise(argument)
    writing = F.when(n > 600, 5).when(n > 400, 4).otherwise(3)
    method, novelty, transfer = two(L.METHOD_RIGOR), two(L.NOVELTY), two(L.TRANSFER)
    # twenty times the weighted sum, in whole numbers: weights 3, 5, 3, 3, 2, 2, 2 of 20
    total = 3 * direction + 5 * method + 3 * novelty + 3 * evidence + 2 * argument + 2 * writing + 2 * transfer
    return F.struct(direction.alias("direction"), method.alias("method"), novelty.alias("innovation"), evidence.alias("evidence"), argument.alias("argument"), writing.alias("writing"), transfer.alias("transfer"), total.alias("total"))


def hybrid(keyword_total: Column, external_total: Column) -> Column:
    """Keyword and external score, 0.4 to 0.6; the keyword score where there is no other."""
    return F.when(external_total.isNull(), keyword_total).otherwise(F.bround(0.4 * keyword_total + 0.6 * external_total).cast("int"))


def relevance(title: Column, abstract: Column, year: Column) -> Column:
    """0 to 100; 0 where a gate fails."""
    ctx = context(title, abstract)
    dem_alone = F.contains(ctx, F.lit("dem")) & ~F.contains(ctx, F.lit("digital elevation")) & F.contains(ctx, F.lit("dem "))
    gate = L.any_hit(ctx, L.FALSE_POSITIVE)
    gate = gate | (L.any_hit(ctx, L.CT_ADJACENT) & dem_alone & ~L.any_hit(ctx, L.CT_CONTEXT))
    gate = gate | (L.any_hit(ctx, L.REVIEW_ONLY) & ~L.any_hit(ctx, L.REVIEW_CONTEXT))
    gate = gate | (L.hits(ctx, L.HARD_CORE) == 0) | (L.any_hit(ctx, L.LOW_PRIORITY) & ~L.any_hit(ctx, L.REINFORCEMENT))
    capped = lambda words, each, most: F.least(L.hits(ctx, words) * each, F.lit(most))
    s = capped(L.HARD_CORE, 18, 60) + capped(L.EXTENDED, 8, 24) + capped(L.DEM_BONUS, 8, 24) + capped(L.GULLY_BONUS, 10, 30) + capped(L.REGION_BONUS, 12, 36) + capped(L.GIS_BONUS, 5, 15)
    s = s + 3 * L.hits(ctx, L.METHOD_WORDS) + 3 * L.hits(ctx, L.TOOL_WORDS) + 2 * L.hits(ctx, L.CROSS_WORDS)
    s = s + F.when(year == "2026", 6).when(year == "2025", 3).otherwise(0) + F.when(F.length(F.coalesce(abstract, F.lit(""))) > 100, 3).otherwise(0)
    return F.when(gate, F.lit(0)).otherwise(F.least(s, F.lit(100)))


def category(title: Column, venue: Column, abstract: Column) -> Column:
    t, v, ctx = F.lower(F.coalesce(title, F.lit(""))), F.lower(F.coalesce(venue, F.lit(""))), context(title, abstract)
    c = L.CATEGORIES
    return F.when(L.any_hit(t, L.S2_TITLE_GIS) | L.any_hit(v, L.S2_VENUE_GIS), c["gis"]).when(L.any_hit(t, L.S2_TITLE_AI), c["ai"]).when(L.any_hit(t, L.S2_TITLE_STAT), c["stat"]).when(L.any_hit(ctx, L.ECOLOGY), c["eco"]).otherwise(c["cross"])


def fixed_tags(title: Column, abstract: Column, keywords: Column) -> Column:
    return L.tags(F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(abstract, F.lit("")), F.coalesce(keywords, F.lit("")))), L.FIXED_TAGS, 5)
