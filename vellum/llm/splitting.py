"""Cutting oversized texts into overlapping pieces at natural boundaries.

Every position of a text has a boundary strength: end of paragraph, of a line after a full stop, sentence, clause or wrapped line,
comma group, word, or none. A sparse table of range maxima over (strength, position) answers the strongest and, among equals,
rightmost cut of any window in two look-ups. From the start of a piece the window is the later half of what the limit
permits, then all of it beyond the overlap; the next piece begins `overlap` characters before the cut.
All texts of an Arrow batch advance together, one piece each per step.

Defined results: texts within the limit (empty and null ones too) come out as one piece; a limit that is null,
or not above the overlap, never cuts; where a window has no boundary at all the cut falls on the limit, moved
left off a combining sequence if that is possible. Pieces of one text have consecutive overlaps of exactly
`overlap` characters, and together they restore it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.runtime import guarded_broadcast

PARAGRAPH, LINE, SENTENCE, CLAUSE, COMMA, WORD, NONE, INSIDE = 7, 6, 5, 4, 3, 2, 1, 0
STRENGTH_NAMES = {PARAGRAPH: "paragraph", LINE: "line", SENTENCE: "sentence", CLAUSE: "clause", COMMA: "comma", WORD: "word", NONE: "none", INSIDE: "inside"}

#: Characters whose table is held in memory at once.
BLOCK = 1 << 20

CJK_STOPS, STOPS, CLOSERS = "。！？…", ".!?", "”’\"')]}»」』）】》"
CJK_CLAUSE, CLAUSES, CJK_COMMA, COMMAS = "；：", ";:", "，、", ","


def strengths(cps):
    """Strength of a cut after each code point; the texts are given end to end, cuts at their ends don't matter."""
    import numpy as np

    n = len(cps)
    s = np.full(n, NONE, "int8")
    if not n:
        return s
    isin = lambda a, chars: np.isin(a, np.array([ord(c) for c in chars], "uint32"))
    nxt = np.concatenate([cps[1:], np.array([32], "uint32")])
    space = isin(cps, " \t 　")
    newline = isin(cps, "\n\r  ")
    gap_next = isin(nxt, " \t 　\n\r")
    # the last sign before a run of closing quotes and brackets
    sign = cps.copy()
    for _ in range(3):
        closing = isin(sign, CLOSERS)
        sign = np.where(closing, np.concatenate([[np.uint32(0)], sign[:-1]]), sign).astype("uint32")
    cjk_stop, stop = isin(sign, CJK_STOPS), isin(sign, STOPS)
    wide = (cps >= 0x2E80) & (cps < 0x10000)
    s[wide | (nxt >= 0x2E80) & (nxt < 0x10000)] = NONE
    # after the space that follows a sign, so that the next piece begins with a word
    before = np.concatenate([[np.uint32(0)], sign[:-1]]).astype("uint32")
    s[space & ~gap_next] = WORD
    s[space & ~gap_next & isin(before, COMMAS + CJK_COMMA)] = COMMA
    s[space & ~gap_next & isin(before, CLAUSES + CJK_CLAUSE)] = CLAUSE
    s[space & ~gap_next & isin(before, STOPS + CJK_STOPS)] = SENTENCE
    s[isin(cps, CJK_COMMA)] = COMMA
    s[isin(cps, CJK_CLAUSE)] = CLAUSE
    s[cjk_stop & ~isin(nxt, CLOSERS + CJK_STOPS) & ~gap_next] = SENTENCE
    s[stop & isin(nxt, "\n\r")] = SENTENCE
    s[cps == ord("|")] = WORD
    # a line end after a full stop is a pause of its own, any other may be a mere wrap
    s[newline & ~isin(nxt, "\n\r")] = CLAUSE
    s[newline & ~isin(nxt, "\n\r") & isin(before, STOPS + CJK_STOPS)] = LINE
    double = newline & isin(np.concatenate([[np.uint32(0)], cps[:-1]]), "\n\r") & (np.concatenate([[np.uint32(0)], cps[:-1]]) != 13)
    s[double & ~isin(nxt, "\n\r")] = PARAGRAPH
    # never between a letter and its marks, inside CRLF or an emoji sequence
    mark = ((nxt >= 0x300) & (nxt < 0x370)) | ((nxt >= 0xFE00) & (nxt < 0xFE10)) | (nxt == 0x200D) | ((nxt >= 0x1F3FB) & (nxt < 0x1F400))
    s[mark | (cps == 0x200D) | ((cps == 13) & (nxt == 10))] = INSIDE
    return s


class RangeMax:
    """Sparse table of maxima over strength and position in one number; equal strengths: the rightmost."""

    def __init__(self, s, longest: int):
        import numpy as np

        n = len(s)
        self.levels = [s.astype("int64") << 40 | np.arange(n)]
        k = 1
        while 2 * k <= max(1, min(longest, n)):
            low = self.levels[-1]
            self.levels.append(np.maximum(low[: len(low) - k], low[k:]))
            k *= 2

    def query(self, lo, hi):
        """Best of [lo, hi], both within the table and lo <= hi, for arrays of windows."""
        import numpy as np

        width = hi - lo + 1
        level = np.frexp(width.astype("float64"))[1] - 1
        out = np.empty(len(lo), "int64")
        for k in np.unique(level):
            of = level == k
            t = self.levels[k]
            out[of] = np.maximum(t[lo[of]], t[hi[of] - (1 << int(k)) + 1])
        return out >> 40, out & ((1 << 40) - 1)


def cut_points(cps, begin, end, limit, overlap):
    """For texts [begin, end) of `cps`: arrays (text, piece number, start, stop, strength of the cut)."""
    import numpy as np

    parts = []
    start, number, live = begin.copy(), np.zeros(len(begin), "int64"), np.arange(len(begin))
    cutting = (limit > overlap) & (overlap >= 0) & (limit > 0)
    table = RangeMax(strengths(cps), int(limit[cutting].max()) if cutting.any() else 1)
    while len(live):
        s, e, m, o = start[live], end[live], limit[live], overlap[live]
        done = (e - s <= m) | ~cutting[live]
        stop, power = e.copy(), np.full(len(live), INSIDE, "int64")
        go = np.flatnonzero(~done)
        if len(go):
            s2, m2, o2 = s[go], m[go], o[go]
            hi = s2 + m2 - 1
            least = s2 + o2  # a cut here still moves the start on by one
            half = np.minimum(np.maximum(least, s2 + m2 // 2), hi)
            p, at = table.query(half, hi)
            weak = p <= NONE
            if weak.any():
                p2, at2 = table.query(np.minimum(least, hi)[weak], hi[weak])
                better = p2 > p[weak]
                p[weak] = np.where(better, p2, p[weak])
                at[weak] = np.where(better, at2, at[weak])
            stop[go], power[go] = at + 1, p
        parts.append((live, number[live], s, stop, power))
        start[live] = stop - o
        number[live] += 1
        live = live[~done]
    cols = [np.concatenate(c) if parts else np.empty(0, "int64") for c in zip(*parts, strict=True)] if parts else [np.empty(0, "int64")] * 5
    order = np.lexsort((cols[1], cols[0]))
    return [c[order] for c in cols]


def split_items(items: DataFrame, keys: list[str], with_text: bool = True) -> DataFrame:
    """Pieces of every item: `keys`, piece_no, n_pieces, start_char, end_char, boundary and, if asked for, piece.

    `items` has the key columns, text, max_chars and overlap_chars. One pass, no shuffle.
    """
    kept = items.select(*keys, F.col("text").alias("__t"), F.col("max_chars").cast("long").alias("__m"), F.col("overlap_chars").cast("long").alias("__o"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.select(*keys).schema.fields)
    schema += ", piece_no long, n_pieces long, start_char long, end_char long, boundary string" + ", piece string" * with_text
    n_keys = len(keys)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        names = np.array([STRENGTH_NAMES[i] for i in range(8)], object)
        for whole in batches:
            texts = whole.column(n_keys).to_pylist()
            sizes = np.array([len(t) if t else 0 for t in texts], "int64")
            at = 0
            while at < len(texts):  # blocks of bounded size; a single longer text is a block of its own
                upto = at + max(1, int(np.searchsorted(np.cumsum(sizes[at:]), BLOCK, "right")))
                batch, sz, tx = whole.slice(at, upto - at), sizes[at:upto], texts[at:upto]
                at = upto
                cps = np.frombuffer("".join(t or "" for t in tx).encode("utf-32-le", "surrogatepass"), "uint32")
                end = np.cumsum(sz)
                begin = end - sz
                limit = np.array([x if x is not None else 0 for x in batch.column(n_keys + 1).to_pylist()], "int64")
                overlap = np.array([x if x is not None else 0 for x in batch.column(n_keys + 2).to_pylist()], "int64")
                which, number, start, stop, power = cut_points(cps, begin, end, limit, overlap)
                taken = batch.take(pa.array(which))
                a, b = start - begin[which], stop - begin[which]
                cols = [taken.column(i) for i in range(n_keys)]
                cols += [pa.array(number), pa.array(np.bincount(which, minlength=len(tx))[which]), pa.array(a), pa.array(b)]
                labels = names[power]
                labels[stop == end[which]] = "end"
                cols.append(pa.array(labels, pa.string()))
                if with_text:
                    cols.append(pa.array([tx[w] if tx[w] is None else tx[w][i:j] for w, i, j in zip(which.tolist(), a.tolist(), b.tolist(), strict=True)], pa.string()))
                yield pa.RecordBatch.from_arrays(cols, names=[*batch.schema.names[:n_keys], "piece_no", "n_pieces", "start_char", "end_char", "boundary"] + ["piece"] * with_text)

    return kept.mapInArrow(cut, schema)


def limits_of(items: DataFrame, limits: DataFrame) -> DataFrame:
    """`items` (field, lang, ...) with max_chars and overlap_chars: the row of its lang, else the row without lang.

    The limits are a small table of settings; their size is checked before they are broadcast.
    """
    by_lang = limits.where("lang is not null").groupBy(F.col("field").alias("__f"), F.col("lang").alias("__l")).agg(F.min(F.struct("max_chars", "overlap_chars")).alias("__own"))
    default = limits.where("lang is null").groupBy(F.col("field").alias("__g")).agg(F.min(F.struct("max_chars", "overlap_chars")).alias("__any"))
    out = items.join(guarded_broadcast(by_lang, 10_000), (F.col("field") == F.col("__f")) & (F.col("lang") == F.col("__l")), "left")
    out = out.join(guarded_broadcast(default, 10_000), F.col("field") == F.col("__g"), "left")
    row = F.coalesce("__own", "__any")
    return out.withColumns({"max_chars": row["max_chars"], "overlap_chars": row["overlap_chars"]}).drop("__f", "__l", "__g", "__own", "__any")


def items_of(results: DataFrame) -> DataFrame:
    """Sections and chunks as rows: result_id, lang, field, item, text; a chunk's item is its position from 0."""
    s = results.select("result_id", "lang", F.explode(F.map_entries("sections")).alias("e"))
    s = s.select("result_id", "lang", F.lit("sections").alias("field"), F.col("e.key").alias("item"), F.col("e.value").alias("text"))
    c = results.select("result_id", "lang", F.posexplode("chunks").alias("pos", "text"))
    c = c.select("result_id", "lang", F.lit("chunks").alias("field"), F.col("pos").cast("string").alias("item"), "text")
    return s.unionByName(c)


def oversized_pieces(results: DataFrame, limits: DataFrame, with_text: bool = True) -> DataFrame:
    """Pieces of all sections and chunks that are over their limit. Copies of a row give the same pieces again."""
    items = limits_of(items_of(results), limits).where(F.length("text") > F.col("max_chars"))
    return split_items(items, ["result_id", "field", "item"], with_text)
