"""One form for text that looks the same.

A whole Arrow batch is decoded once into an array of code points. A lookup table gives every code point the
run of code points that stands for it (empty for invisible ones), the runs are gathered with expansion
offsets, and combining marks are composed over the whole array at once, so no Python string is touched
row by row.

What counts as the same: the width of letters, digits and spaces; decomposed and composed accents; invisible
format characters; compatibility ideographs, radicals and ligatures; letters of other scripts that are drawn
as a Latin letter; hyphen characters. What stays different: letter case, accents, raised or lowered digits,
a hyphen and a space, punctuation of different width, and every visible character more or less.

Defined results: null stays null; text of invisible characters only becomes the empty string; runs of spaces
become one and outer spaces go; lone surrogates cannot occur in Arrow text.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Letters of other scripts that print as a Latin letter, and that letter.
CYRILLIC = "АВЕЅІЈКМНОРСТУХҮԌԚԜаеѕіјорсухһԁԛԝүӏ"
CYRILLIC_AS = "ABESIJKMHOPCTYXYGQWaesijopcyxhdqwyl"
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοϲϳ"
GREEK_AS = "ABEZHIKMNOPTYXocj"
HYPHENS = "‐‑"
#: Invisible characters outside the category Cf.
INVISIBLE = [0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)]
#: Kinds of compatibility mapping that change nothing a reader can see.
KEPT_KINDS = {"<wide>", "<narrow>", "<compat>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>"}

N = 0x110000


def _run(cp: int, alike: dict[int, str]) -> str:
    """The code points that stand for one code point, accents taken off their letters."""
    ch = chr(cp)
    if 0xD800 <= cp < 0xE000:
        return ch
    if cp in alike:
        return alike[cp]
    cat = unicodedata.category(ch)
    if cat == "Cf" or cp in _invisible():
        return ""
    if cat in ("Zs", "Zl", "Zp") or ch in "\t\n\r\x0b\x0c\x85":
        return " "
    d = unicodedata.decomposition(ch)
    if not d:
        return ch
    kind, *rest = d.split() if d[0] == "<" else ("", *d.split())
    if kind in ("<wide>", "<narrow>") and not (cat[0] == "L" or cat == "Nd"):
        return ch  # the width of punctuation is visible
    if kind and kind not in KEPT_KINDS:
        return ch
    target = [int(x, 16) for x in rest]
    if kind == "<compat>" and target[0] == 0x20:
        return ch  # spacing accents
    return "".join(_run(t, alike) for t in target)


@lru_cache(maxsize=1)
def _invisible() -> frozenset[int]:
    return frozenset(INVISIBLE)


@lru_cache(maxsize=1)
def tables():
    """Length and start of each code point's run, the runs end to end, mark classes, and the composition pairs."""
    import numpy as np

    alike = {ord(a): b for a, b in (*zip(CYRILLIC, CYRILLIC_AS, strict=True), *zip(GREEK, GREEK_AS, strict=True), *((h, "-") for h in HYPHENS))}
    size, start = np.ones(N, "int8"), np.arange(N, dtype="int32")
    tail: list[int] = []
    for cp in range(N):
        if 0x3400 <= cp < 0x4DC0 or 0x4E00 <= cp < 0xA000 or 0xAC00 <= cp < 0xD7A4 or 0xE000 <= cp < 0xF900 or 0x20000 <= cp < 0x2F800 or 0x30000 <= cp < 0xE0000 or cp >= 0xE0200:
            continue
        r = _run(cp, alike)
        if r != chr(cp):
            size[cp], start[cp] = len(r), N + len(tail)
            tail += map(ord, r)
    flat = np.concatenate([np.arange(N, dtype="uint32"), np.array(tail, "uint32")])
    ccc = np.zeros(N, "uint8")
    pairs = {}
    for cp in [*range(0x300, 0x3400), *range(0xA000, 0xAC00), *range(0xFB00, 0xFE30), *range(0x10000, 0x1F000)]:
        ccc[cp] = unicodedata.combining(chr(cp))
    for cp in range(0xC0, 0x3400):
        d = unicodedata.decomposition(chr(cp))
        if d and d[0] != "<" and " " in d and unicodedata.normalize("NFC", chr(cp)) == chr(cp):
            a, b = (int(x, 16) for x in d.split())
            pairs[a << 21 | b] = cp
    keys = np.array(sorted(pairs), "int64")
    return size, start, flat, ccc, keys, np.array([pairs[k] for k in keys.tolist()], "uint32")


def canonical(texts: pa.Array) -> pa.Array:
    """The one form of every text of an Arrow string array."""
    import numpy as np

    size, start, flat, ccc, keys, made = tables()
    n = len(texts)
    null = np.asarray(texts.is_null())
    texts = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], "int64", n + 1, texts.offset * 8)
    raw = np.frombuffer(texts.buffers()[2] or b"", "uint8")[offsets[0] : offsets[-1]] if n else np.empty(0, "uint8")
    lead = (raw & 0xC0) != 0x80
    cps = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), "uint32")
    at = np.concatenate([[0], np.cumsum(lead)])[offsets - offsets[0]]
    row = np.repeat(np.arange(n), np.diff(at))

    # expansion: every code point becomes its run
    k = size[cps].astype("int64")
    ends = np.cumsum(k)
    total = int(ends[-1]) if len(ends) else 0
    src = np.repeat(start[cps].astype("int64") - (ends - k), k) + np.arange(total)
    cps, row = flat[src], np.repeat(row, k)

    # marks of one letter into the order of their classes, then composition, pair by pair
    cls = ccc[cps]
    while len(cps) > 1:
        wrong = np.flatnonzero((cls[1:] != 0) & (cls[:-1] > cls[1:]) & (row[1:] == row[:-1]))
        wrong = wrong[np.concatenate([[True], np.diff(wrong) > 1])] if len(wrong) else wrong
        if not len(wrong):
            break
        for a in (cps, cls):
            a[wrong], a[wrong + 1] = a[wrong + 1].copy(), a[wrong].copy()
    while len(cps) > 1 and cls.any():
        joint = cps[:-1].astype("int64") << 21 | cps[1:]
        pos = np.minimum(np.searchsorted(keys, joint), len(keys) - 1)
        hit = np.flatnonzero((keys[pos] == joint) & (row[1:] == row[:-1]) & (cls[1:] != 0))
        hit = hit[np.concatenate([[True], np.diff(hit) > 1])] if len(hit) else hit
        if not len(hit):
            break
        cps[hit] = made[pos[hit]]
        keep = np.ones(len(cps), bool)
        keep[hit + 1] = False
        cps, row, cls = cps[keep], row[keep], cls[keep]

    # one space for a run of them, none at either end
    if len(cps):
        space = cps == 32
        first = np.concatenate([[True], row[1:] != row[:-1]])
        keep = ~space | (~np.concatenate([[True], space[:-1]]) & ~first)
        cps, row, space = cps[keep], row[keep], space[keep]
        keep = ~(space & np.concatenate([row[1:] != row[:-1], [True]])[: len(cps)])
        cps, row = cps[keep], row[keep]

    data = cps.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
    width = 1 + (cps > 0x7F).astype("int64") + (cps > 0x7FF) + (cps > 0xFFFF)
    bounds = np.concatenate([[0], np.cumsum(np.bincount(row, weights=width, minlength=n).astype("int64"))])
    out = pa.LargeStringArray.from_buffers(n, pa.py_buffer(bounds.astype("int64").tobytes()), pa.py_buffer(data))
    if null.any():
        out = pa.compute.if_else(pa.array(null), pa.scalar(None, pa.large_string()), out)
    return out.cast(pa.string())


def canonical_form(text: Column) -> Column:
    """Column form of `canonical`."""

    @F.arrow_udf("string")
    def form(texts: pa.Array) -> pa.Array:
        import pyarrow.compute  # noqa: F401

        return canonical(texts)

    return form(text)


def lookalike_pairs(values: DataFrame) -> DataFrame:
    """Pairs of ids whose values differ in their characters and have one form.

    `values` has field, id and value. Exact copies are folded first; only forms with two or more different
    values go on, so a value that a third of all rows share meets none of its copies. Null ids and values
    pair with nothing.
    """
    rows = values.select("field", F.col("id").cast("string").alias("id"), "value").where("id is not null and value is not null").distinct()
    spelt = rows.select("field", "value").distinct().withColumn("form", canonical_form(F.col("value")))
    shared = spelt.groupBy("field", "form").agg(F.min("value").alias("lo"), F.max("value").alias("hi")).where("lo <> hi").select("field", "form")
    spelt = spelt.join(shared, ["field", "form"], "left_semi")
    a, b = spelt.alias("a"), spelt.alias("b")
    pairs = a.join(b, (F.col("a.field") == F.col("b.field")) & (F.col("a.form") == F.col("b.form")) & (F.col("a.value") != F.col("b.value")))
    pairs = pairs.select(F.col("a.field").alias("field"), F.col("a.value").alias("va"), F.col("b.value").alias("vb"))
    left = rows.select("field", F.col("value").alias("va"), F.col("id").alias("id_a"))
    right = rows.select("field", F.col("value").alias("vb"), F.col("id").alias("id_b"))
    return pairs.join(left, ["field", "va"]).join(right, ["field", "vb"]).where("id_a < id_b").select("field", "id_a", "id_b").distinct()
