"""Which rows are kept: first or richest of a key, anti-joins against state, duplicates by several keys."""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.operators.phrases import occurrences
from vellum.runtime import cut

#: Rare pieces that two titles must have in common at once to meet, fewer where the threshold is low; buckets in which pieces are counted for their order.
TOGETHER, BUCKETS = 3, 1 << 16
#: Titles of fewer characters are compared by single characters.
BRIEF = 20


def first_wins(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in `order`. Partial aggregation on both sides of the shuffle, so a hot key is no hot task."""
    struct = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(*keys).agg(F.min_by(struct, F.struct(*order)).alias("__r")).select("__r.*")


def richest_wins(df: DataFrame, keys: list[str], id_col: str, richness: Column | None = None) -> DataFrame:
    """One row per key: the richest (that of the longest JSON unless `richness` says otherwise), ties by the least id."""
    struct = F.struct(*[F.col(c) for c in df.columns])
    best = F.struct((-(F.length(F.to_json(struct)) if richness is None else richness)).alias("n"), F.col(id_col))
    return df.groupBy(*keys).agg(F.min_by(struct, best).alias("__r")).select("__r.*")


def unseen(df: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in the state; rows without key are kept."""
    return df.join(seen.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def merged(rows: DataFrame, processed: DataFrame, key: str) -> DataFrame:
    """`processed` in place of the rows with its keys, the rest unchanged."""
    return processed.unionByName(rows.join(processed.select(key), key, "left_anti"), allowMissingColumns=True)


def duplicate_reasons(new: DataFrame, history: DataFrame, key: str) -> DataFrame:
    """(key, reason) of the rows of `new` that the history has: the strongest of id, doi, arxiv, url, pdf, title; url and pdf
    where both tables have the column.

    Every test is an equality of its own, so each is a hash join; nulls and empty values match nothing.
    """
    low = lambda c: F.lower(F.trim(c))
    tests = [("1 id", lambda: F.col("paper_id")), ("2 doi", lambda: low(F.col("doi"))), ("3 arxiv", lambda: low(F.col("arxiv_id"))), *((f"{n} {r}", lambda c=c: low(F.col(c))) for n, r, c in ((4, "url", "url"), (5, "pdf", "pdf_url")) if c in new.columns and c in history.columns), ("6 title", lambda: T.normalized_title(F.col("title")))]
    entries = lambda: F.explode(F.array(*(F.struct(F.lit(n).alias("test"), e().alias("value")) for n, e in tests)))
    a = new.select(key, entries().alias("t")).select(key, "t.*").where("value is not null and value <> ''")
    b = history.select(entries().alias("t")).select("t.*").where("value is not null and value <> ''").distinct()
    return a.join(b, ["test", "value"], "left_semi").groupBy(key).agg(F.min("test").alias("reason")).withColumn("reason", F.substring("reason", 3, 20))


def _pieces(t: str, n: int) -> set[str]:
    return {t[i : i + n] for i in range(len(t) - n + 1)}


def _digest(piece: str) -> int:
    return xxhash.xxh3_64_intdigest(piece.encode("utf-8", "surrogatepass"))


def _piece_counts(titles: DataFrame) -> np.ndarray:
    """How many of titles (t) have a piece of each bucket, of one and of two characters: 2 * BUCKETS numbers, whatever the data."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * BUCKETS, np.int64)
        bucket = lru_cache(1 << 16)(lambda piece: (_digest(piece) & (BUCKETS - 1)) + BUCKETS * (len(piece) - 1))
        for batch in batches:
            flat = [bucket(g) for t in batch.column(0).to_pylist() for n in (1, 2) for g in _pieces(t, n)]
            total += np.bincount(np.array(flat, np.int64), minlength=2 * BUCKETS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    rows = titles.select("t").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(2 * BUCKETS, np.int64)
    out[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return out


def _title_cells(titles: DataFrame, key: str, counts, least: float, first: bool) -> DataFrame:
    """(key, n_key, sig_key, cell) of titles (key, t): the combinations on which they meet, the number of pieces, and of each bit of
    `sig` whether the number of its pieces is odd, so that two titles differ in as many pieces at least as bits.

    Long titles meet by pairs of characters; where one is short both meet by single characters. `first`: the side of `a`, whose
    short titles meet all of `b` and whose long ones the short ones of `b`.
    """
    share = Fraction(str(least))  # as fractions, so that nothing is lost by rounding
    most = math.floor((BRIEF - 1) / share)
    # so many that titles of no more pieces reach the threshold by having the same pieces only
    meet = max(k for k in range(1, TOGETHER + 1) if math.ceil(share * k) == k)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = counts.value
        together: dict[int, tuple[np.ndarray, ...]] = {}

        @lru_cache(1 << 16)
        def ranked(piece: str) -> tuple[int, int]:
            h = _digest(piece)
            return int(order[(h & (BUCKETS - 1)) + BUCKETS * (len(piece) - 1)]), h

        def of(t: str, n: int, roles: list[int], out: list) -> None:
            ranks = sorted(ranked(g) for g in _pieces(t, n))
            size = len(ranks)
            if not size or (n == 1 and size > most):
                return
            need = math.ceil(share * size)
            sig = 0
            for _, h in ranks:
                sig ^= 1 << (h >> 58)
            if size < meet:
                own = np.array([_digest("".join(sorted(str(h) for _, h in ranks)))], np.uint64)
            else:
                p = np.array([h for _, h in ranks[: size - need + meet]], np.uint64)
                if len(p) not in together:
                    together[len(p)] = tuple(np.array(list(combinations(range(len(p)), meet)), np.int64).T)
                own = np.zeros(len(together[len(p)][0]), np.uint64)
                for at in together[len(p)]:
                    own = (own ^ p[at]) * np.uint64(0x9E3779B97F4A7C15)
                    own ^= own >> np.uint64(29)
            for role in roles:
                out.append((own + np.uint64(role), size, sig - (1 << 64) if sig >> 63 else sig))

        for batch in batches:
            ids, out, rows = batch.column(0), [], []
            for row, t in enumerate(batch.column(1).to_pylist()):
                had = len(out)
                if len(t) < BRIEF:
                    of(t, 1, [1] if first else [1, 2], out)
                else:
                    of(t, 2, [0], out)
                    of(t, 1, [2] if first else [1], out)
                rows += [row] * (len(out) - had)
            if not out:
                continue
            sizes = [len(o[0]) for o in out]
            at = pa.array(np.repeat(np.array(rows, np.int64), sizes))
            each = lambda k, kind: pa.array(np.repeat(np.array([o[k] for o in out], kind), sizes))
            cell = np.concatenate([o[0] for o in out]).view(np.int64)
            yield pa.RecordBatch.from_arrays([ids.take(at), each(1, np.int32), each(2, np.int64), pa.array(cell)], [key, f"n_{key}", f"sig_{key}", "cell"])

    return titles.select(key, "t").mapInArrow(cells, f"{key} long, n_{key} int, sig_{key} long, cell long")


def near_titles(a: DataFrame, b: DataFrame, least: float = 0.9) -> DataFrame:
    """(a_id, b_id, similarity) of titles with title_similarity of at least `least`.

    Lossless blocking. Overlap: with the pieces of each title in one global order, rarest first, two titles that share the
    needed part of them share the same few (TOGETHER) rarest common pieces among the first ones of either, so they meet on such a
    combination; pieces are character pairs, or single characters where one of the two titles is under BRIEF characters; titles
    of fewer pieces must have the same. What meets is held against a bound by the signatures at once, so only likely pairs leave
    the join. Containment: the titles of either side are looked for in the other, however short they are. Inputs: id, title
    (normalised, not empty).
    """
    # each wording once: copies meet again at the end
    x = cut(a.select(F.col("title").alias("t")).distinct().select(F.xxhash64("t").alias("a"), "t"))
    y = cut(b.select(F.col("title").alias("t")).distinct().select(F.xxhash64("t").alias("b"), "t"))
    counts = x.sparkSession.sparkContext.broadcast(_piece_counts(x.select("t").unionByName(y.select("t"))))
    differ = F.floor((F.col("n_a") + F.col("n_b")) * F.lit((1 - least) / (1 + least)) + F.lit(1e-6))
    fits = (F.least("n_a", "n_b") >= F.lit(least) * F.greatest("n_a", "n_b") - F.lit(1e-6)) & (F.bit_count(F.col("sig_a").bitwiseXOR(F.col("sig_b"))) <= differ)
    overlap = _title_cells(x, "a", counts, least, True).join(_title_cells(y, "b", counts, least, False).hint("merge"), "cell").where(fits).select("a", "b")

    def inside(p: DataFrame, q: DataFrame, ours: str, theirs: str) -> DataFrame:
        found = occurrences(p.select(F.col("t").alias("phrase")), q.select(F.col(theirs).alias("text_id"), F.col("t").alias("text")))
        return found.join(p.hint("merge"), found["phrase"] == p["t"]).select(F.col(ours), F.col("text_id").alias(theirs)).select("a", "b")

    met = overlap.unionByName(inside(x, y, "a", "b")).unionByName(inside(y, x, "b", "a")).distinct()
    full = met.hint("merge").join(x.select("a", F.col("t").alias("xt")), "a").hint("merge").join(y.select("b", F.col("t").alias("yt")), "b")
    full = full.withColumn("held", F.contains(F.col("xt"), F.col("yt")) | F.contains(F.col("yt"), F.col("xt")))
    brief = F.least(F.length("xt"), F.length("yt")) < BRIEF
    n = F.when(brief, F.lit(1)).otherwise(F.lit(2))
    full = full.withColumns({"p": T.shingles(F.col("xt"), n), "q": T.shingles(F.col("yt"), n)})
    both = F.size(F.array_intersect("p", "q"))
    j = both / (F.size("p") + F.size("q") - both)
    score = F.when(F.col("xt") == F.col("yt"), F.lit(1.0)).when(F.col("held"), F.greatest(j, F.lit(0.92))).otherwise(j)
    near = full.withColumn("similarity", score).where(F.col("similarity") >= least).select("xt", "yt", "similarity")
    out = near.hint("merge").join(a.select(F.col("id").alias("a_id"), F.col("title").alias("xt")), "xt")
    return out.hint("merge").join(b.select(F.col("id").alias("b_id"), F.col("title").alias("yt")), "yt").select("a_id", "b_id", "similarity")
