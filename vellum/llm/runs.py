"""Sorted runs: rows kept sorted by a long key in a folder of the shared file system, and searched by ranges of the key.

A run is written once and never changed. Beside each run lies a small table of where its row groups begin and end, so a search
opens only the row groups that a range can touch: a small set of ranges costs the same however long the history is.
Runs are merged into one from time to time; a list of the live runs, written whole under a new number, says what readers see.

Defined results: a null bound finds nothing; a range without rows finds nothing; equal keys are all found, in slices, so a
key that very many rows share never has to fit into one batch. An empty run is a run.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of a row group and rows of an answer that leaves the search at once.
GROUP_BYTES, SLICE = 1 << 20, 1 << 16
#: Row groups that a task keeps.
KEPT_GROUPS = 8


def opened(path: str):
    """(file system, path on it)."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class Groups:
    """Where the row groups of some runs begin and end; reads those that ranges touch."""

    def __init__(self, folder: str, indexes: list[str], key: str, columns: list[str]):
        import numpy as np
        import pyarrow.parquet as pq

        self.fs, self.root = opened(folder)
        self.key, self.columns, self.kept, self.files = key, columns, {}, {}
        tables = [pq.read_table(f"{self.root}/{i}", filesystem=self.fs) for i in indexes]
        whole = pa.concat_tables(tables) if tables else pa.table({"file": pa.array([], pa.string()), "no": pa.array([], pa.int32()), "lo": pa.array([], pa.int64()), "hi": pa.array([], pa.int64())})
        self.file, self.no = whole.column("file").to_pylist(), whole.column("no").to_pylist()
        self.lo, self.hi = np.asarray(whole.column("lo").to_numpy(), "int64"), np.asarray(whole.column("hi").to_numpy(), "int64")

    def touched(self, lo, hi) -> list[int]:
        """Numbers of the row groups that any of the ranges touches, in the order of their keys."""
        import numpy as np

        if not len(lo) or not len(self.lo):
            return []
        order = np.argsort(lo, kind="stable")
        reach = np.maximum.accumulate(hi[order])
        n = np.searchsorted(lo[order], self.hi, "right")
        hit = np.flatnonzero((n > 0) & (reach[np.maximum(n, 1) - 1] >= self.lo))
        return hit[np.argsort(self.lo[hit], kind="stable")].tolist()

    def rows(self, g: int) -> pa.Table:
        import pyarrow.parquet as pq

        if g not in self.kept:
            name = self.file[g]
            if name not in self.files:
                if len(self.files) >= KEPT_GROUPS:
                    self.files.pop(next(iter(self.files)))
                self.files[name] = pq.ParquetFile(self.fs.open_input_file(f"{self.root}/{name}"))
            if len(self.kept) >= KEPT_GROUPS:
                self.kept.pop(next(iter(self.kept)))
            self.kept[g] = self.files[name].read_row_group(self.no[g], columns=[self.key, *self.columns]).combine_chunks()
        return self.kept[g]


class SortedRuns:
    def __init__(self, spark: SparkSession, folder: str, key: str):
        self.spark, self.folder, self.key = spark, folder.rstrip("/"), key

    def live(self) -> list[str]:
        from pyarrow import fs

        f, root = opened(self.folder)
        names = [i.base_name for i in f.get_file_info(fs.FileSelector(f"{root}/live", allow_not_found=True))]
        if not names:
            return []
        with f.open_input_stream(f"{root}/live/{max(names)}") as s:
            return json.loads(s.read())

    def _publish(self, runs: list[str]) -> None:
        from pyarrow import fs

        f, root = opened(self.folder)
        f.create_dir(f"{root}/live", recursive=True)
        names = [i.base_name for i in f.get_file_info(fs.FileSelector(f"{root}/live"))]
        number = int(max(names)) + 1 if names else 0
        with f.open_output_stream(f"{root}/live/.{number}") as s:
            s.write(json.dumps(runs).encode())
        f.move(f"{root}/live/.{number}", f"{root}/live/{number:09d}")

    def _write(self, rows: DataFrame) -> str:
        """A new run, not yet live: every file holds one range of the key, sorted."""
        import pyarrow.parquet as pq
        from pyarrow import fs

        name = f"run-{uuid.uuid4().hex[:12]}"
        sorted_ = rows.repartitionByRange(self.key).sortWithinPartitions(self.key)
        sorted_.write.option("parquet.block.size", str(GROUP_BYTES)).parquet(f"{self.folder}/{name}")
        f, root = opened(self.folder)
        files = sorted(i.base_name for i in f.get_file_info(fs.FileSelector(f"{root}/{name}")) if i.base_name.endswith(".parquet"))

        def ends(file: str):
            meta = pq.read_metadata(f"{root}/{name}/{file}", filesystem=f)
            at = meta.schema.names.index(self.key)
            groups = ((g, meta.row_group(g).column(at).statistics) for g in range(meta.num_row_groups))
            return [(f"{name}/{file}", g, s.min, s.max) for g, s in groups if s is not None and s.has_min_max]

        # a few numbers a row group
        with ThreadPoolExecutor(16) as pool:
            found = [x for part in pool.map(ends, files) for x in part]
        cols = list(zip(*found, strict=True)) if found else [[]] * 4
        pq.write_table(pa.table({"file": pa.array(cols[0], pa.string()), "no": pa.array(cols[1], pa.int32()), "lo": pa.array(cols[2], pa.int64()), "hi": pa.array(cols[3], pa.int64())}), f"{root}/{name}.index", filesystem=f)
        return name

    def add(self, rows: DataFrame) -> str:
        """`rows` as a run of their own. Rows without key are left out: no range finds them."""
        name = self._write(rows.where(rows[self.key].isNotNull()))
        self._publish([*self.live(), name])
        return name

    def read(self, runs: list[str] | None = None) -> DataFrame:
        return self.spark.read.parquet(*(f"{self.folder}/{r}" for r in (self.live() if runs is None else runs)))

    def merge(self, one_of=None, runs: list[str] | None = None) -> None:
        """`runs` (all) as one run; readers see it from then on. `one_of`: makes one row of those with one key."""
        before = self.live()
        old = [r for r in before if runs is None or r in runs]
        if len(old) < 2:
            return
        rows = self.read(old)
        name = self._write(one_of(rows) if one_of else rows)
        self._publish([name if r == old[0] else r for r in before if r == old[0] or r not in old])
        f, root = opened(self.folder)
        for r in old:
            f.delete_dir(f"{root}/{r}")
            f.delete_file(f"{root}/{r}.index")

    def search(self, asked: DataFrame, lo: str, hi: str, found: dict[str, str], same: tuple[str, str] | None = None, runs: list[str] | None = None, fits: tuple[tuple[str, ...], Callable] | None = None) -> DataFrame:
        """The columns of `asked` but for the bounds, with the columns `found` (name in the runs -> name here) of each row whose
        key is between `lo` and `hi`. `same`: a column of `asked` and one of the runs that must be equal too. `fits`: columns of both
        and a test of them, as arrays of `asked` and then of the runs, which leave the answer. Nearly sorted ranges open each row
        group about once."""
        kinds = {n: t for n, t in self.read(runs[:1] if runs else None).dtypes} if (self.live() if runs is None else runs) else None
        tested, test = fits or ((), None)
        keep = [c for c in asked.columns if c not in (lo, hi, *tested)]
        types = dict(asked.dtypes)
        if kinds is None:
            raise ValueError("no run to search")
        schema = ", ".join([*(f"`{c}` {types[c]}" for c in keep), *(f"`{b}` {kinds[a]}" for a, b in found.items())])
        folder, key, indexes = self.folder, self.key, [f"{r}.index" for r in (self.live() if runs is None else runs)]
        columns = list(dict.fromkeys([*found, *([same[1]] if same else []), *tested]))

        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import numpy as np

            groups = None
            for batch in batches:
                if not batch.num_rows:
                    continue
                groups = groups or Groups(folder, indexes, key, [c for c in columns if c != key])
                table = pa.Table.from_batches([batch])
                if table.column(lo).null_count or table.column(hi).null_count:
                    import pyarrow.compute as pc

                    table = table.filter(pc.and_(pc.is_valid(table.column(lo)), pc.is_valid(table.column(hi))))
                a, b = np.asarray(table.column(lo).to_numpy(), "int64"), np.asarray(table.column(hi).to_numpy(), "int64")
                own_of = {c: table.column(c).to_numpy() for c in (*([same[0]] if same else []), *tested)}
                table = table.select(keep)
                for g in groups.touched(a, b):
                    rows = groups.rows(g)
                    keys = rows.column(key).to_numpy()
                    other_of = {c: rows.column(c).to_numpy() for c in (*([same[1]] if same else []), *tested)}
                    first = np.searchsorted(keys, a, "left")
                    n = np.searchsorted(keys, b, "right") - first
                    ends = np.cumsum(n)
                    total = int(ends[-1]) if len(ends) else 0
                    for start in range(0, total, SLICE):
                        at = np.arange(start, min(total, start + SLICE))
                        i = np.searchsorted(ends, at, "right")
                        j = first[i] + at - (ends[i] - n[i])
                        if same:
                            fit = own_of[same[0]][i] == other_of[same[1]][j]
                            i, j = i[fit], j[fit]
                        if test and len(i):
                            fit = test(*(own_of[c][i] for c in tested), *(other_of[c][j] for c in tested))
                            i, j = i[fit], j[fit]
                        if not len(i):
                            continue
                        left, right = table.take(pa.array(i)), rows.take(pa.array(j))
                        cols = [left.column(c).combine_chunks() for c in keep] + [right.column(c).combine_chunks() for c in found]
                        yield pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in cols], names=[*keep, *found.values()])

        return asked.select(*keep, *tested, lo, hi).mapInArrow(look, schema)
