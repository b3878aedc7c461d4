"""Which phrases occur in which texts, whatever their number: windows of the texts pass a sketch of the phrases and are then joined."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from vellum.runtime import ensure_checkpoint_dir

#: log2 of the bits of the sketch: 8 MB however many phrases there are. A window that passes it for nothing is one more row of the join.
BITS = 26
#: Characters looked at together.
TOGETHER = 1 << 19

_BASE, _MIX = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n - 1, 0), base, np.uint64)]))


class _Windows:
    """Hashes of all windows of some texts, by prefix sums of a polynomial modulo 2^64 that are shifted back to the window's start."""

    def __init__(self, texts: list[str]):
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        n = len(codes)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((codes + np.uint64(1)) * _powers(_BASE, n), out=self.sums[1:])
        self.back = _powers(_INVERSE, n)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.starts = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])
        self.room = np.repeat(self.starts[1:], sizes) - np.arange(n)

    def slots(self, at: np.ndarray, size: np.ndarray | int, whole: bool) -> np.ndarray:
        """Bits of the windows of `size` characters that begin at `at`; beginnings of phrases and whole ones have bits of their own."""
        h = (self.sums[at + size] - self.sums[at]) * self.back[at]
        h = (h ^ (h >> np.uint64(32))) * _MIX + np.asarray(2 * size + whole).astype(np.uint64) * np.uint64(_BASE)
        h = (h ^ (h >> np.uint64(32))) * _MIX
        return (h >> np.uint64(64 - BITS)).astype(np.int64)


def _begin(size: np.ndarray) -> np.ndarray:
    """The largest power of two that a phrase is not shorter than."""
    return np.int64(1) << (np.frexp(size.astype(np.float64))[1].astype(np.int64) - 1)


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        phrases = batch.column(0).to_pylist()
        w = _Windows(phrases)
        size, at = np.diff(w.starts), w.starts[:-1]
        slot = np.unique(np.concatenate([w.slots(at, size, True), w.slots(at, _begin(size), False)]))
        word, first = np.unique(slot >> 6, return_index=True)
        bits = np.bitwise_or.reduceat(np.uint64(1) << (slot & 63).astype(np.uint64), first) if len(slot) else np.zeros(0, np.uint64)
        sizes = np.unique(size)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([word, -sizes])), pa.array(np.concatenate([bits.view(np.int64), 0 * sizes]))], ["word", "bits"])


@lru_cache(maxsize=2)
def _sketch(folder: str) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of the phrases and words of bits that lie in a folder of the shared file system; a worker reads them once for its tasks."""
    import pyarrow.dataset as ds
    from pyarrow import fs

    own = folder.startswith("file:") or "://" not in folder
    f, root = (fs.LocalFileSystem(), "/" + folder.removeprefix("file:").lstrip("/")) if own else fs.FileSystem.from_uri(folder)
    words, sizes = np.zeros(1 << (BITS - 6), np.uint64), []
    for batch in ds.dataset(root, filesystem=f, format="parquet").to_batches(columns=["word", "bits"]):
        word, bits = (np.asarray(c.to_numpy(zero_copy_only=False), np.int64) for c in batch.columns)
        words[word[word >= 0]] = bits[word >= 0].view(np.uint64)
        sizes.append(-word[word < 0])
    return np.sort(np.concatenate([np.zeros(0, np.int64), *sizes])), words


def _finder(folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def found(texts: list[str]) -> tuple[list[int], list[str]]:
        sizes, words = _sketch(folder)
        w, rows, pieces = _Windows(texts), [], []
        hit = lambda slot: (words[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1) != 0
        begins = _begin(sizes)
        for m in np.unique(begins).tolist():
            at = np.flatnonzero(w.room >= m)
            at = at[hit(w.slots(at, m, False))]
            for size in sizes[begins == m].tolist():
                here = at[w.room[at] >= size]
                here = here[hit(w.slots(here, size, True))]
                row = np.searchsorted(w.starts, here, "right") - 1
                for r, i in zip(row.tolist(), (here - w.starts[row]).tolist(), strict=True):
                    rows.append(r)
                    pieces.append(texts[r][i : i + size])
        once = dict.fromkeys(zip(rows, pieces, strict=True))
        return [r for r, _ in once], [x for _, x in once]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids = batch.column(1).to_pylist(), batch.column(0)
            ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts))) // TOGETHER
            cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), len(texts)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a < b:
                    rows, pieces = found(texts[a:b])
                    yield pa.RecordBatch.from_arrays([ids.slice(a, b - a).take(pa.array(rows, pa.int64())), pa.array(pieces, pa.string())], ["text_id", "phrase"])

    return run


def occurrences(phrases: DataFrame, texts: DataFrame) -> DataFrame:
    """(text_id, phrase), once each: what of texts (text_id, text) passes the sketch of phrases (phrase). Every phrase that occurs is
    among it and few other pieces; a join by equality leaves the phrases. Both sides are compared as written, phrases not empty.
    """
    spark = phrases.sparkSession
    # a negative word is the size of a phrase. The workers read the sketch from the shared folder: none of it passes through the driver
    held = phrases.select("phrase").distinct().mapInArrow(_bits, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    folder = f"{ensure_checkpoint_dir(spark)}/phrases-{uuid.uuid4().hex[:12]}"
    held.write.parquet(folder)
    t = texts.select("text_id", "text")
    schema = StructType([t.schema["text_id"], StructField("phrase", StringType())])
    return t.mapInArrow(_finder(folder), schema)
