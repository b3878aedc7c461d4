"""Matching the rows of two tables without a common identifier, by soft logic.

Candidate pairs come from titles (exact, or near by the hash forest of `history`) and identifiers. Every pair is a truth value
between 0 and 1. Weighted rules ask for it: alike titles, authors, years and equal DOIs for a match; unlike ones against it;
one work of the left table for each row of the right one (exclusivity); copies of one work matched alike (transitivity). Each rule costs its
weight times how far it is from being satisfied, so the whole is one convex problem of hinge losses. It is solved by
alternating directions: every rule keeps its own copy of the values it speaks of and moves it by a closed formula that
needs only sums over its group; the copies of a value are then averaged. Each round is a few aggregations over all
pairs, however large a group is. The values reached are the confidences.

Defined results: null and empty fields speak neither for nor against; rows without title and DOI match nothing; titles that name no
work match only together with an author's name or DOI; copies of a row (same id) are one row; of unlike rows under one id the least counts.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm import history
from vellum.llm.names import FORMAL, fold
from vellum.llm.titles import edits, same_base, title_parts
from vellum.runtime import cut

# weights of the rules
TITLE, AUTHOR, YEAR, DOI, PRIOR = 4.0, 2.0, 0.7, 2.5, 0.4
NOT_TITLE, NOT_AUTHOR, NOT_YEAR, NOT_DOI = 6.0, 1.8, 0.7, 0.6
EXCLUSIVE, TRANSITIVE = 4.0, 2.0
RHO, BELIEF = 1.0, 0.5
#: Rounds go on, LEAST_ROUNDS at least, until no pair that still moves by more than SETTLED is near the line of belief; that it
#: takes MOST_ROUNDS is an error.
LEAST_ROUNDS, SETTLED, MOST_ROUNDS = 8, 0.01, 200

_NOISE = frozenset("and others et al the de la von van".split())


def author_words(s: str | None) -> set[str]:
    """Words of author names that can tell persons apart: no initials, no common given names."""
    if not s:
        return set()
    words = {w.replace("-", "") for w in re.findall(r"[^\W\d_]{2,}(?:-[^\W\d_]{2,})*", fold(s))}
    words = {w for w in words if len(w) > 2 and w not in _NOISE}
    return {w for w in words if w not in FORMAL} or words


def author_likeness(a: str | None, b: str | None) -> float | None:
    x, y = author_words(a), author_words(b)
    if not x or not y:
        return None
    if len(x) > len(y):
        x, y = y, x
    hit = len(x & y)
    rest = y - x
    hit += sum(any(abs(len(w) - len(v)) < 3 and edits(w, v, 2) <= (1 if len(w) < 8 else 2) for v in rest) for w in x - y)
    return hit / len(x)


def year_likeness(a: str | None, b: str | None) -> float | None:
    m, n = re.search(r"\d{4}", a or ""), re.search(r"\d{4}", b or "")
    if not m or not n:
        return None
    return (1.0, 0.9, 0.4)[min(2, abs(int(m.group()) - int(n.group())))] if abs(int(m.group()) - int(n.group())) < 3 else 0.0


def doi_likeness(a: str | None, b: str | None) -> float | None:
    """1: equal; 0: two different ones; unknown with a preprint's or an incomplete one."""
    if not a or not b:
        return None
    if a == b:
        return 1.0
    if "preprint" in a or "preprint" in b:
        return None
    x, y = a.partition("/")[2], b.partition("/")[2]
    return None if not x or not y or x == y or x.startswith(y) or y.startswith(x) or edits(a, b, 1) <= 1 else 0.0


def unary_minimum(title, author, year, doi, v):
    """Per pair: the value that the rules on it alone and the pull toward `v` agree on. NaN: the field is unknown."""
    import numpy as np

    terms = []  # (weight, bound, side): side 1: weight * max(0, bound - y); side -1: weight * max(0, y - bound)
    for like, up, down in ((title, TITLE, NOT_TITLE), (author, AUTHOR, NOT_AUTHOR), (year, YEAR, NOT_YEAR), (doi, DOI, NOT_DOI)):
        known = ~np.isnan(like)
        at = np.where(known, like, 0.0)
        terms += [(np.where(known, up * at, 0.0), at, 1), (np.where(known, down * (1 - at), 0.0), at, -1)]
    terms.append((np.full(len(v), PRIOR), np.zeros(len(v)), -1))
    lo, hi = np.zeros(len(v)), np.ones(len(v))
    for _ in range(30):
        y = (lo + hi) / 2
        slope = RHO * (y - v)
        for w, b, side in terms:
            slope = slope + (np.where(y < b, -w, 0.0) if side > 0 else np.where(y > b, w, 0.0))
        up = slope < 0
        lo, hi = np.where(up, y, lo), np.where(up, hi, y)
    return (lo + hi) / 2


def solve(pairs: DataFrame) -> DataFrame:
    """`pairs` (a, b, class_a, class_b, title, author, year, doi) with the column confidence."""

    @F.arrow_udf("double")
    def unary(t: pa.Array, au: pa.Array, y: pa.Array, d: pa.Array, v: pa.Array) -> pa.Array:
        import numpy as np

        cols = [np.asarray(c.to_numpy(zero_copy_only=False), "float64") for c in (t, au, y, d, v)]
        return pa.array(unary_minimum(*cols))

    # copies of one work on the left count as one match
    n_a = pairs.groupBy("b", "class_a").agg(F.count("*").alias("__na"))
    state = pairs.join(n_a.hint("merge"), ["b", "class_a"])
    state = state.withColumns({"cb": 1.0 / F.col("__na"), "z": unary("title", "author", "year", "doi", F.lit(0.5))}).drop("__na")
    state = cut(state.withColumns({**{f"u{k}": F.lit(0.0) for k in range(3)}, "moved": F.lit(1.0)}))
    for round_ in range(MOST_ROUNDS):
        v = [F.col("z") - F.col(f"u{k}") for k in range(3)]
        side_b = state.groupBy("b").agg(F.sum(F.col("cb") * v[1]).alias("sb"), F.sum(F.col("cb") * F.col("cb")).alias("qb"))
        group = state.groupBy("class_a", "class_b").agg(F.avg(v[2]).alias("mean"))
        s = state.join(side_b.hint("merge"), "b").join(group.hint("merge"), ["class_a", "class_b"])
        pull = lambda total, square: F.greatest(F.lit(0.0), F.least(F.lit(EXCLUSIVE / RHO), (F.col(total) - 1.0) / F.col(square)))
        s = s.withColumns({
            "x0": unary("title", "author", "year", "doi", v[0]),
            "x1": v[1] - pull("sb", "qb") * F.col("cb"),
            "x2": F.col("mean") + (v[2] - F.col("mean")) * (RHO / (RHO + 2 * TRANSITIVE)),
        })
        s = s.withColumn("z1", sum((F.col(f"x{k}") + F.col(f"u{k}") for k in range(3)), F.lit(0.0)) / 3)
        s = s.withColumn("z1", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("z1"))))
        # primal and dual residual of the pair
        far = F.greatest(F.abs(F.col("z1") - F.col("z")), *(F.abs(F.col(f"x{k}") - F.col("z1")) for k in range(3)))
        moved = {f"u{k}": F.col(f"u{k}") + F.col(f"x{k}") - F.col("z1") for k in range(3)}
        state = cut(s.withColumns({**moved, "moved": far}).withColumn("z", F.col("z1")).select(state.columns))
        # a pair is settled when no further round can carry it over the line between match and no match
        open_ = state.where((F.col("moved") > SETTLED) & (F.abs(F.col("z") - BELIEF) <= 3 * F.col("moved"))).limit(1).count()
        if not open_ and round_ + 1 >= LEAST_ROUNDS:
            break
    else:
        raise RuntimeError("the confidences did not settle")
    return state.withColumn("confidence", F.round("z", 6)).select(*pairs.columns, "confidence")


def _side(rows: DataFrame) -> DataFrame:
    """One row per id: id, authors, year, doi, base, marks, generic, short, wid."""
    p = title_parts(F.col("title"))
    one = rows.groupBy("id").agg(F.min(F.struct("title", "authors", F.col("year").cast("string").alias("year"), "doi")).alias("r")).select("id", "r.*")
    r = one.withColumn("__p", p).withColumns({
        "doi": history.clean_doi(F.regexp_replace("doi", r"(?i)^\s*doi[:\s]+", "")), "base": F.coalesce("__p.base", F.lit("")), "marks": F.coalesce("__p.marks", F.lit("")),
        "generic": F.coalesce("__p.generic", F.lit(False)), "short": F.coalesce("__p.short", F.lit(False)),
    })
    return cut(r.withColumn("wid", F.xxhash64("base", "marks")).select("id", "authors", F.col("year").cast("string").alias("year"), "doi", "base", "marks", "generic", "short", "wid"))


def _wordings(side: DataFrame) -> DataFrame:
    return cut(history.wordings_of(side.withColumn("ord", F.lit(0).cast("long"))))


def _real_dois(side: DataFrame, other: DataFrame, name: str) -> DataFrame:
    """(id as `name`, doi) of `side`, but for placeholders: DOIs under which both sides mostly have unlike titles."""
    both = side.select("doi", "base").unionByName(other.select("doi", "base")).where("doi is not null")
    first = both.where("base <> ''").groupBy("doi").agg(F.min("base").alias("first_base"))
    met = both.join(first.hint("merge"), "doi", "left")
    far = F.coalesce((F.col("base") != "") & (F.levenshtein("base", "first_base") > 0.6 * F.greatest(F.length("base"), F.length("first_base"))), F.lit(False))
    # two rows that differ may be one with a DOI pasted wrongly
    real = met.groupBy("doi").agg(F.avg(far.cast("double")).alias("share"), F.count("*").alias("n")).where("share < 0.4 or n <= 2").select("doi")
    return side.where("doi is not null").join(real.hint("merge"), "doi", "left_semi").select(F.col("id").alias(name), "doi")


def link(left: DataFrame, right: DataFrame) -> DataFrame:
    """(a, b, title, author, year, doi, confidence) of all candidate pairs of `left` and `right` (id, title, authors, year, doi)."""
    spark = left.sparkSession
    lhs, rhs = _side(left), _side(right)
    lw, rw = _wordings(lhs), _wordings(rhs)
    forest = history.Forest(spark, history.work_folder(spark, "linkage"))
    forest.weights(lw.unionByName(rw).dropDuplicates(["wid"]))
    forest.add(forest.signed(lw))
    near = forest.near(forest.signed(rw)).select(F.col("other").alias("lw"), F.col("wid").alias("rw"))
    same = lw.select(F.col("wid").alias("lw")).join(rw.select(F.col("wid").alias("rw")).hint("merge"), F.col("lw") == F.col("rw"))
    wordings = near.unionByName(same).distinct()
    a = lhs.select(F.col("id").alias("a"), F.col("wid").alias("lw"))
    b = rhs.select(F.col("id").alias("b"), F.col("wid").alias("rw"))
    by_title = wordings.hint("merge").join(a, "lw").hint("merge").join(b, "rw").select("a", "b")
    by_doi = _real_dois(lhs, rhs, "a").join(_real_dois(rhs, lhs, "b").hint("merge"), "doi").select("a", "b")
    # titles that name no work: with a word of the authors in common and years that are next to each other or unknown
    y = F.col("year").try_cast("int")
    near_years = F.when(y.isNull(), F.array(F.lit("*"), F.lit("?"))).otherwise(F.array((y - 1).cast("string"), y.cast("string"), (y + 1).cast("string"), F.lit("?")))
    own_year = F.when(y.isNull(), F.array(F.lit("?"))).otherwise(F.array(y.cast("string"), F.lit("*")))
    named = lambda side, name, years: side.where("generic and authors is not null").select(F.col("id").alias(name), "wid", F.explode(years).alias("year"), F.array_distinct(F.regexp_extract_all(F.lower("authors"), F.lit(r"(\p{L}{2,})"), F.lit(1))).alias("words")).select(name, "wid", "year", F.explode("words").alias("word"))
    by_name = named(lhs, "a", near_years).join(named(rhs, "b", own_year).hint("merge"), ["wid", "year", "word"]).select("a", "b").distinct()
    pairs = by_title.unionByName(by_doi).unionByName(by_name).distinct()
    l = lhs.select(F.col("id").alias("a"), *[F.col(c).alias(f"l_{c}") for c in ("authors", "year", "doi", "base", "marks", "generic", "short", "wid")])
    r = rhs.select(F.col("id").alias("b"), *[F.col(c).alias(f"r_{c}") for c in ("authors", "year", "doi", "base", "marks", "generic", "short", "wid")])
    full = pairs.hint("merge").join(l, "a").hint("merge").join(r, "b")

    @F.arrow_udf("struct<title:double,author:double,year:double,doi:double>")
    def likeness(lb: pa.Array, rb: pa.Array, lm: pa.Array, rm: pa.Array, ls: pa.Array, rs: pa.Array, la: pa.Array, ra: pa.Array, ly: pa.Array, ry: pa.Array, ld: pa.Array, rd: pa.Array) -> pa.Array:
        t, au, y, d = [], [], [], []
        for p, q, m, n, cut1, cut2, a1, a2, y1, y2, d1, d2 in zip(*(c.to_pylist() for c in (lb, rb, lm, rm, ls, rs, la, ra, ly, ry, ld, rd)), strict=True):
            if not p or not q:
                t.append(None)
            elif m != n:
                t.append(0.0)
            elif p == q:
                t.append(1.0)
            else:
                t.append(0.95 if same_base(p, q, bool(cut1 or cut2)) else 0.1)
            au.append(author_likeness(a1, a2))
            y.append(year_likeness(y1, y2))
            d.append(doi_likeness(d1, d2))
        return pa.StructArray.from_arrays([pa.array(c, pa.float64()) for c in (t, au, y, d)], names=["title", "author", "year", "doi"])

    full = full.withColumn("__k", likeness("l_base", "r_base", "l_marks", "r_marks", "l_short", "r_short", "l_authors", "r_authors", "l_year", "r_year", "l_doi", "r_doi"))
    # a title that names no work is no evidence by itself
    title = F.when(F.col("l_generic") & F.col("r_generic"), F.when(F.col("__k.title") == 1.0, F.lit(0.6)).otherwise(F.lit(0.0))).otherwise(F.col("__k.title"))
    own = lambda side, key: F.when(F.col(f"{side}_generic") | (F.col(f"{side}_base") == ""), F.xxhash64(key, F.lit(side))).otherwise(F.col(f"{side}_wid"))
    full = full.select("a", "b", own("l", "a").alias("class_a"), own("r", "b").alias("class_b"), title.alias("title"), F.col("__k.author").alias("author"), F.col("__k.year").alias("year"), F.col("__k.doi").alias("doi"))
    return solve(cut(full)).drop("class_a", "class_b")
