"""Term weights and cosine similarity over an inverted index, and over dense vectors."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from vellum.functions.text import tokens


def term_counts(texts: DataFrame) -> DataFrame:
    """(text_id, token, tf, max_tf) of texts (text_id, text)."""
    t = texts.select("text_id", F.explode(tokens(F.col("text"))).alias("token")).groupBy("text_id", "token").agg(F.count("*").alias("tf"))
    top = t.groupBy("text_id").agg(F.max("tf").alias("max_tf"))
    return t.join(top, "text_id")


def weights(texts: DataFrame) -> DataFrame:
    """(text_id, token, w): (tf / max_tf) * (ln((N + 1) / (df + 1)) + 1)."""
    tc = term_counts(texts)
    df_ = tc.groupBy("token").agg(F.count("*").alias("df"))
    n = texts.agg(F.count("*").alias("n"))
    return tc.join(df_, "token").crossJoin(F.broadcast(n)).select("text_id", "token", (F.col("tf") / F.col("max_tf") * (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1)).alias("w"))  # n: one row


def nearest(left: DataFrame, right: DataFrame, least: float = 0.03, most_df_share: float = 1.0, asked: Column | None = None) -> DataFrame:
    """(text_id, other, score): the most similar other text of each left text, ties by the least id, none under `least`.

    Weights count both sides whole; `asked`, a condition on the left text_id, limits only which left texts are answered. The sums run over shared tokens only; AQE splits the partitions of frequent tokens.
    """
    both = left.select(F.concat(F.lit("l"), F.col("text_id").cast("string")).alias("text_id"), "text").unionByName(right.select(F.concat(F.lit("r"), F.col("text_id").cast("string")).alias("text_id"), "text"))
    w = weights(both)
    norm = w.groupBy("text_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    w = w.join(norm, "text_id").select("text_id", "token", (F.col("w") / F.col("norm")).alias("w"))
    a = w.where("text_id like 'l%'").select(F.expr("substring(text_id, 2)").alias("text_id"), "token", F.col("w").alias("wa"))
    a = a if asked is None else a.where(asked)
    b = w.where("text_id like 'r%'").select(F.expr("substring(text_id, 2)").alias("other"), "token", F.col("w").alias("wb"))
    s = a.join(b, "token").where("text_id <> other").groupBy("text_id", "other").agg(F.sum(F.col("wa") * F.col("wb")).alias("score")).where(F.col("score") > least)
    best = s.groupBy("text_id").agg(F.max_by(F.struct("other", "score"), F.struct(F.round("score", 9), F.expr("-cast(other as bigint)"))).alias("b"))
    return best.select("text_id", "b.other", "b.score")


#: Vectors of one block of the product.
BLOCK = 4096


def dense_cosine(queries: DataFrame, rows: DataFrame, k: int = 5) -> DataFrame:
    """(query, other, score, rank): the `k` rows (vec_id, embedding) most like each query, by exact cosine, ties by the least id.

    A product in blocks: queries and rows are dealt into blocks of about BLOCK vectors, every block of queries meets every block of
    rows in a task of its own, which holds two blocks and keeps the best `k` a query; the best of all blocks follow. Null
    embeddings and those without length meet nobody.
    """
    q = queries.where("embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding"))
    r = rows.where("embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding"))
    nq, nr = (max(1, -(-df.count() // BLOCK)) for df in (q, r))
    dealt = lambda df, own, n, other, m: df.withColumn(own, F.pmod(F.xxhash64("vec_id"), F.lit(n))).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1)).cast("array<long>")))
    left, right = dealt(q, "qb", nq, "rb", nr), dealt(r, "rb", nr, "qb", nq)

    def best(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        import numpy as np

        def unit(t: pa.Table):
            ids = np.asarray(t.column("vec_id").to_numpy(), "int64")
            x = np.array(t.column("embedding").to_pylist(), "float64").reshape(len(ids), -1)
            n = np.sqrt((x * x).sum(axis=1)) if len(ids) else np.zeros(0)
            return ids[n > 0], x[n > 0] / n[n > 0][:, None] if len(ids) else x

        ids, x = unit(a)
        others, y = unit(b)
        out = [np.zeros(0, "int64"), np.zeros(0, "int64"), np.zeros(0)]
        if len(ids) and len(others):
            s = np.round(x @ y.T, 12)
            s[ids[:, None] == others[None, :]] = -np.inf
            order = np.lexsort((np.broadcast_to(others, s.shape), -s), axis=1)[:, :k]
            score = np.take_along_axis(s, order, axis=1)
            keep = np.isfinite(score)
            out = [np.repeat(ids, order.shape[1]).reshape(order.shape)[keep], others[order][keep], score[keep]]
        return pa.table({"query": pa.array(out[0], pa.int64()), "other": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    met = left.groupBy("qb", "rb").cogroup(right.groupBy("qb", "rb")).applyInArrow(best, "query long, other long, score double")
    w = W.Window.partitionBy("query").orderBy(F.desc("score"), "other")
    return met.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query", "other", "score", "rank")
