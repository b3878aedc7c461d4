"""A mixture of sources with target shares of all tokens.

The size of the mixture is the largest at which every wanted source that has tokens can hold its share without any
document being used more than max_repeats times; shares of sources without tokens go to the others in proportion. The
documents of a source are dealt into blocks by hash; whole passes repeat all blocks, and the rest of a quota is drawn
block by block in a permuted order, the last block document by document.

Output shards get their blocks from a splitting tree: the shards are halved again and again, and at each node the block
counts of the sources are divided by a draw from the multivariate hypergeometric distribution, so that every shard is
a random sample of the mixture although no two hold the same block draw. Within a shard the order is a local shuffle.

Defined results: null, empty and zero-token texts take no part; sources without target or with share 0 take no part; a target that
is null counts as 0, max_repeats below 1 or null as 1; without any usable source the mixture is empty; repeated rows of one
doc_id are one document.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from vellum.llm.tokens import token_count
from vellum.runtime import cut

MAX_SOURCES = 10_000


def plan(targets: list[tuple[str, float, int]], tokens: dict[str, int], total: int | None = None) -> dict[str, dict]:
    """Per usable source its share among usable sources, quota, whole passes and rest, in tokens."""
    usable = {s: (share, max(1, reps or 1)) for s, share, reps in targets if s is not None and share and share > 0 and tokens.get(s)}
    whole = sum(share for share, _ in usable.values())
    if not usable:
        return {}
    most = min(tokens[s] * reps / (share / whole) for s, (share, reps) in usable.items())
    size = int(min(most, total) if total else most)
    out = {}
    for s, (share, reps) in usable.items():
        quota = min(int(size * share / whole), tokens[s] * reps)
        out[s] = {"share": share / whole, "quota": quota, "passes": quota // tokens[s], "rest": quota % tokens[s]}
    return out


def shard_share(units: list[int], shards: int, shard: int, seed: int) -> tuple[list[int], list[int]]:
    """(units of each source that come before `shard`, units it gets): the way from the root of the splitting tree to its leaf.

    The draw at a node depends on the node alone, so every shard that walks through it sees the same one.
    """
    import numpy as np

    have, before = np.array(units, "int64"), np.zeros(len(units), "int64")
    lo, hi = 0, shards
    while hi - lo > 1:
        mid = (lo + hi) // 2
        n = int(have.sum())
        take = n * (mid - lo) // (hi - lo)
        rng = np.random.default_rng([seed, lo, hi])
        left = rng.multivariate_hypergeometric(have, take, method="marginals") if 0 < take < n else (have if take else have * 0)
        if shard < mid:
            have, hi = left, mid
        else:
            before, have, lo = before + left, have - left, mid
    return before.tolist(), have.tolist()


def shard_spans(spark: SparkSession, counts: dict[str, int], shards: int, seed: int) -> DataFrame:
    """(source, lo, hi, shard): which ranks of each source every shard gets. The tree is walked where the shards are."""
    names = sorted(counts)
    units = [counts[s] for s in names]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k in batch.column(0).to_pylist():
                before, got = shard_share(units, shards, k, seed)
                rows += [(s, b + 1, b + n, k) for s, b, n in zip(names, before, got, strict=True) if n]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int32())], names=["source", "lo", "hi", "shard"])

    return spark.range(shards).mapInArrow(walk, "source string, lo long, hi long, shard int")


def mixture(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, block_tokens: int = 1 << 16, shard_tokens: int = 1 << 20, seed: int = 7, tokenizer: str = "byte_bpe_50k") -> DataFrame:
    """doc_id, source, copy_no, n_tokens, shard, position: one row per use of a document."""
    spark = documents.sparkSession
    rows = targets.limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError("too many target rows")
    wanted = [(r["source"], r["target_share"], r["max_repeats"]) for r in rows]
    names = [s for s, share, _ in wanted if s is not None and share and share > 0]
    sized = documents.where(F.col("source").isin(names)).select("doc_id", "source", token_count(F.col("text"), tokenizer).alias("n_tokens"))
    # of different rows of one doc_id the least by source and size
    sized = cut(sized.where("n_tokens > 0").groupBy("doc_id").agg(F.min(F.struct("source", "n_tokens")).alias("r")).select("doc_id", "r.source", "r.n_tokens"))
    # as many rows as targets at most
    tokens = {r["source"]: int(r["n"]) for r in sized.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    p = plan(wanted, tokens, total_tokens)
    schema = "doc_id long, source string, copy_no int, n_tokens int, shard int, position int"
    if not p:
        return spark.createDataFrame([], schema)
    n_blocks = {s: max(1, math.ceil(tokens[s] / block_tokens)) for s in p}
    settings = spark.createDataFrame([(s, n_blocks[s], x["passes"], x["rest"]) for s, x in p.items()], "source string, n_blocks long, passes int, rest long")
    dealt = cut(sized.join(F.broadcast(settings), "source").withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col("n_blocks"))))
    order = lambda *c: F.xxhash64(F.lit(seed + 1), *c)
    blocks = dealt.groupBy("source", "block").agg(F.sum("n_tokens").alias("tokens"), F.first("passes").alias("passes"), F.first("rest").alias("rest"))
    w = W.Window.partitionBy("source").orderBy(order("source", "block"), "block")
    blocks = blocks.withColumn("before", F.sum("tokens").over(w.rowsBetween(W.Window.unboundedPreceding, -1))).withColumn("before", F.coalesce("before", F.lit(0)))
    # units: a block in each whole pass, and in the rest as far as the quota goes
    whole = blocks.where("passes > 0").withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("passes")))).select("source", "block", "copy_no", F.lit(None).cast("long").alias("room"))
    part = blocks.where("rest > before").select("source", "block", (F.col("passes") + 1).alias("copy_no"), F.when(F.col("before") + F.col("tokens") > F.col("rest"), F.col("rest") - F.col("before")).alias("room"))
    units = cut(whole.unionByName(part))
    counts = {r["source"]: r["count"] for r in units.groupBy("source").count().collect()}
    shards = max(1, round(sum(x["quota"] for x in p.values()) / shard_tokens))
    places = shard_spans(spark, counts, shards, seed).select("source", F.explode(F.sequence("lo", "hi")).alias("rank"), "shard")
    wu = W.Window.partitionBy("source").orderBy(order("source", "block", "copy_no", F.lit(3)), "block", "copy_no")
    placed = units.withColumn("rank", F.row_number().over(wu).cast("long")).join(places, ["source", "rank"]).select("source", "block", "copy_no", "room", "shard")
    uses = dealt.select("doc_id", "source", "n_tokens", "block").join(placed, ["source", "block"])
    # the last block of a quota: documents in a permuted order while there is room
    wb = W.Window.partitionBy("source", "block").orderBy(order("doc_id", F.lit(5)), "doc_id")
    cutting = uses.where("room is not null").withColumn("upto", F.sum("n_tokens").over(wb)).where("upto <= room").drop("upto")
    uses = uses.where("room is null").unionByName(cutting)
    ws = W.Window.partitionBy("shard").orderBy(order("doc_id", "copy_no", F.lit(9)), "doc_id", "copy_no")
    return uses.withColumn("position", F.row_number().over(ws)).select("doc_id", "source", F.col("copy_no").cast("int").alias("copy_no"), "n_tokens", "shard", "position")


def reached_shares(mix: DataFrame, targets: DataFrame) -> DataFrame:
    """source, target_share, n_tokens, actual_share, n_docs, most_uses of every target row, also of those that got nothing."""
    per_doc = mix.groupBy("source", "doc_id").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("uses"))
    got = per_doc.groupBy("source").agg(F.sum("n").alias("n_tokens"), F.count("*").alias("n_docs"), F.max("uses").alias("most_uses"))
    total = got.agg(F.sum("n_tokens").alias("total"))
    out = targets.select("source", "target_share").join(got, "source", "left").crossJoin(F.broadcast(total))  # one row
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select("source", "target_share", zero("n_tokens"), F.coalesce(F.col("n_tokens") / F.col("total"), F.lit(0.0)).alias("actual_share"), zero("n_docs"), zero("most_uses"))
