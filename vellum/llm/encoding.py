"""Finding and restoring text that was decoded with the wrong character encoding.

A chain says how a value was garbled: the bytes of one encoding read as another, once or several times over. Every value is
asked what each chain can explain of it: stretches whose bytes, written back in the wrong encoding, are valid and plausible in the
right one, and, in what that restores, stretches of a further chain. All chains that explain a fair part are kept, with how
strong their evidence is, and the script of the value. Which of them it was, or none, is latent: expectation-maximization
over the counts of these cells learns, for each source and field, how common every chain is, and for each chain how strong
evidence looks in garbled and in clean values; so weak evidence is believed where its chain is common and not where chance
explains it. All sums are grouped sums over the cells, in Spark, whatever the number of sources. Each value is judged,
and restored, by its posterior.

Defined results: null and empty values are clean; values with the replacement character are garbled, and what
it replaced stays lost; text that is correct in any language is clean. Copies of a row give the same rows again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from vellum.runtime import cut

#: Encodings that UTF-8 bytes are wrongly read as; bytes they leave undefined stay control characters.
WRONG = ["cp1252", "latin-1", "cp1251", "cp1250", "cp437", "mac_roman", "cp850", "cp866", "koi8-r", "cp1254"]
CHAINS = [*(f"utf-8>{w}" for w in WRONG), "utf-8>gbk", "gbk>cp1252", "lossy"]
LEVELS = 4
#: Smoothing counts of the chains and of the evidence levels, weight of the share over all sources, change at which the fit
#: ends, its rounds, and what posterior is believed.
ALPHA, BETA, POOLED, CLOSE, ITERATIONS, BELIEF = 0.5, 0.5, 20, 1e-3, 12, 0.5
#: Clean values seen before these, as it were: strong evidence is believed in a small table too. Belief in evidence at first.
FORMER, FIRST_BELIEF = 1000, 0.9
#: Part of the best chain's units that another chain must explain to be held possible.
FAIR = 0.5

_RUN = re.compile("[^\x00-\x7f]+")
_HIGH = re.compile("[\x80-\xff‘’‚“”„†‡•…‰‹›€™ŒœŠšŸŽžƒˆ˜–—]{4,}")
_UTF8 = re.compile(rb"[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")


def _char(encoding: str, b: int) -> str:
    try:
        return bytes([b]).decode(encoding)
    except UnicodeDecodeError:
        return chr(b)


def plausible(c: str) -> bool:
    """Whether a restored character is one that ordinary text has."""
    o = ord(c)
    return 0xA0 <= o < 0x180 or 0x370 <= o < 0x400 or 0x2010 <= o < 0x2040 or 0x2070 <= o < 0x20C0 or 0x2100 <= o < 0x2300 or 0x3000 <= o < 0x3040 or 0x4E00 <= o < 0xA000 or 0xFF00 <= o < 0xFF60 or o == 0xFEFF or 0x1F300 <= o < 0x1F700


@lru_cache(maxsize=None)
def single(encoding: str):
    """(pattern of UTF-8 sequences as they look in `encoding`, character -> byte)."""
    cls = lambda a, b: "[" + "".join(re.escape(_char(encoding, x)) for x in range(a, b + 1)) + "]"
    tail = cls(0x80, 0xBF)
    pattern = re.compile(f"{cls(0xC2, 0xDF)}{tail}|{cls(0xE0, 0xEF)}{tail}{{2}}|{cls(0xF0, 0xF4)}{tail}{{3}}")
    return pattern, {_char(encoding, b): b for b in range(0x80, 0x100)}


@lru_cache(maxsize=1)
def any_single():
    return re.compile("|".join(single(w)[0].pattern for w in WRONG))


def _unit(match: str, back: dict[str, int], controls: bool = False) -> str | None:
    """The character that a sequence stands for; `controls`: also one that an outer chain may have made of a byte."""
    try:
        c = bytes(back[x] for x in match).decode("utf-8")
    except (KeyError, UnicodeDecodeError):
        return None
    return c if plausible(c) or controls and (c in back or 0x80 <= ord(c) < 0xA0) else None


def gbk_run(run: str) -> str | None:
    """A run of characters that are UTF-8 bytes read as GBK, restored; None if they aren't."""
    raw = run.replace("�", "?").encode("gb18030", "replace")
    got = _UTF8.findall(raw)
    covered = sum(map(len, got))
    if not got or covered < 0.8 * len(raw) - 1:
        return None
    text = b"".join(got).decode("utf-8", "replace")
    if sum(map(plausible, text)) < 0.9 * len(text):
        return None
    wide = sum(c >= "⺀" for c in text)
    # a single character by chance, several hardly ever; what a lone run becomes is a letter or a mark of Latin text
    if wide >= 2 or (not wide and len(run) <= 3 and all("\xc0" <= c < "\u0180" or "\u2010" <= c < "\u2040" or c in "°±µ²³·" for c in text)):
        return raw.replace(b"?", b"\xff").decode("utf-8", "replace")
    return None


def high_run(run: str) -> str | None:
    """A run of accented letters and signs that are GBK bytes read as a Latin encoding, restored; None if they aren't."""
    back = single("cp1252")[1]
    raw = bytes(back[c] if c in back else ord(c) for c in run if c in back or ord(c) < 256)
    text = raw.decode("gbk", "replace")
    wide = sum("一" <= c <= "鿿" or c in "，。、；：（）％“”—《》" for c in text)
    return text if wide >= 2 and wide >= 0.8 * len(text) else None


def explained(value: str) -> dict[int, int]:
    """chain number -> units it explains, of the single chains that explain any."""
    out: dict[int, int] = {}
    if any_single().search(value):
        for k, w in enumerate(WRONG):
            pattern, back = single(w)
            units = sum(_unit(m, back) is not None for m in pattern.findall(value))
            if units:
                out[k] = units
    # what is valid UTF-8 is not asked whether it is GBK: any two bytes are
    rest = single(WRONG[max(out, key=lambda k: (out[k], -k))])[0].sub(" ", value) if out else value
    n = sum(len(m) // 2 for m in _HIGH.findall(rest) if high_run(m)) if _HIGH.search(rest) else 0
    if n:
        out[len(WRONG) + 1] = n
    n = 0
    for run in _RUN.findall(value):
        text = gbk_run(run)
        if text:
            n += len(text)
    if n:
        out[len(WRONG)] = n
    lost = value.count("�")
    if lost and max(out.values(), default=0) < 2:
        out[len(WRONG) + 2] = 4 * lost
    return out


def evidence(value: str) -> tuple[int, int] | None:
    """(chain number, units it explains) of the best single chain; None if nothing speaks for any."""
    found = explained(value)
    best = max(found, key=lambda k: (found[k], -k), default=None)
    return None if best is None else (best, found[best])


def undone(value: str, chain: str) -> str:
    """`value` with a single chain undone once wherever its bytes are valid."""
    if chain == "utf-8>gbk":
        return _RUN.sub(lambda m: gbk_run(m.group()) or m.group(), value)
    if chain == "gbk>cp1252":
        return _HIGH.sub(lambda m: high_run(m.group()) or m.group(), value)
    if chain == "lossy":
        return value
    pattern, back = single(chain.split(">")[1])
    return pattern.sub(lambda m: _unit(m.group(), back, True) or m.group(), value)


def chains_of(value: str) -> list[tuple[str, int]]:
    """(chain, units) of every chain that explains a fair part of what the best one does, the best first. A chain of several steps
    reads "step+step", the outermost first; it counts what all its steps explain."""
    found = explained(value)
    most = max(found.values(), default=0)
    out = []
    for k, units in found.items():
        if units < FAIR * most:
            continue
        name, at, total = CHAINS[k], value, units
        while True:  # each step shortens the text
            before, at = at, undone(at, name.rpartition("+")[2])
            inner = evidence(at) if at != before else None
            if inner is None or CHAINS[inner[0]] == "lossy":
                break
            name, total = f"{name}+{CHAINS[inner[0]]}", total + inner[1]
        out.append((name, total))
    return sorted(out, key=lambda x: (-x[1], x[0]))


def restore(value: str | None, chain: str) -> str | None:
    """`value` with the steps of the chain undone, one after the other, and what they lay open."""
    if not value:
        return value
    steps = chain.split("+")
    while steps:
        step = steps.pop(0)
        before, value = value, undone(value, step)
        if not steps and value != before:
            inner = evidence(value)
            if inner and CHAINS[inner[0]] != "lossy":
                steps.append(CHAINS[inner[0]])
    return value


def values_of(results: DataFrame) -> DataFrame:
    """Texts and warnings as rows: result_id, source (the engine), field, pos, value; null and ASCII values left out."""
    odd = F.col("value").rlike("[^\\x00-\\x7f]")
    source = F.coalesce("engine_used", F.lit("")).alias("source")
    t = results.select("result_id", source, F.lit("text").alias("field"), F.lit(0).alias("pos"), F.col("text").alias("value")).where(odd)
    w = results.select("result_id", source, F.posexplode("warnings").alias("pos", "value")).select("result_id", "source", F.lit("warnings").alias("field"), "pos", "value").where(odd)
    return t.unionByName(w)


def evidence_rows(values: DataFrame, with_value: bool = False) -> DataFrame:
    """result_id, source, field, pos, script, chains, levels of the values that any chain explains something of."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, chains, levels, scripts = [], [], [], []
            for i, v in enumerate(batch.column(4).to_pylist()):
                found = chains_of(v) if v else None
                if found:
                    keep.append(i)
                    chains.append([c for c, _ in found])
                    levels.append([min(LEVELS, n.bit_length()) - 1 for _, n in found])
                    scripts.append(int(sum("一" <= c <= "鿿" for c in v) * 4 > len(v)))
            kept = batch.take(pa.array(keep, pa.int64()))
            cols = [*(kept.column(k) for k in range(4)), pa.array(scripts, pa.int32()), pa.array(chains, pa.list_(pa.string())), pa.array(levels, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([*cols, *([kept.column(4)] if with_value else [])], names=["result_id", "source", "field", "pos", "script", "chains", "levels", *["value"] * with_value])

    schema = "result_id long, source string, field string, pos int, script int, chains array<string>, levels array<int>" + ", value string" * with_value
    return values.select(F.col("result_id").cast("long").alias("result_id"), "source", "field", F.col("pos").cast("int").alias("pos"), "value").mapInArrow(look, schema)


def fit(cells: DataFrame, totals: DataFrame) -> DataFrame:
    """(cid, chain, posterior): the likeliest chain of each cell, by its hash, and the probability that any chain made it, by expectation-maximization.

    `cells`: source, field, script, chains, levels, n; `totals`: source, field, total, the values of each, garbled or not. A value is
    clean or was garbled by one of its chains. Shares of the chains: per source and field, drawn toward the share over
    all of them. Levels: per chain and script, among garbled and among clean values. The tables of chains and levels are bounded by
    the chains there are; that of the sources is joined by shuffling.
    """
    row = totals.agg(F.sum("total").alias("n")).first()
    everything = float(row["n"] or 0) or 1.0
    e = cells.withColumn("cid", F.xxhash64("source", "field", "script", F.concat_ws("|", "chains"), F.to_json("levels"))).join(totals.hint("merge"), ["source", "field"], "left")
    e = e.select("cid", "source", "field", "script", "n", F.coalesce("total", "n").alias("total"), F.size("chains").alias("k"), F.posexplode(F.arrays_zip("chains", "levels")).alias("at", "c"))
    e = e.select("cid", "source", "field", "script", "n", "total", "at", F.col("c.chains").alias("chain"), F.col("c.levels").alias("level"), (F.lit(FIRST_BELIEF) / F.col("k")).alias("r"))
    whole = W.Window.partitionBy("cid")
    e = cut(e.withColumn("p", F.sum("r").over(whole)))
    for _ in range(ITERATIONS):
        weighed = F.sum(F.col("n") * F.col("r"))
        share = e.groupBy("source", "field", "chain").agg(weighed.alias("share"))
        levels = e.groupBy("chain", "script", "level").agg(weighed.alias("g"), F.sum(F.when(F.col("at") == 0, F.col("n") * (1 - F.col("p"))).otherwise(0.0)).alias("c"))
        over = levels.groupBy("chain").agg(F.sum("g").alias("overall"))
        levels = levels.withColumn("all", F.sum("g").over(W.Window.partitionBy("chain", "script"))).join(F.broadcast(over), "chain")
        s = e.join(share.hint("merge"), ["source", "field", "chain"]).join(F.broadcast(levels), ["chain", "script", "level"])
        base = (F.col("overall") + ALPHA) / (everything + ALPHA * len(CHAINS))
        pi = (F.col("share") + POOLED * base) / (F.col("total") + POOLED)
        g = (F.col("g") + BETA) / (F.col("all") + BETA * LEVELS)
        # by chance strong evidence is rarer than weak evidence, and any is rare; the best chain's level stands for the value's
        q = (F.col("c") + BETA * F.pow(F.lit(0.05), F.col("level"))) / (everything + FORMER)
        s = s.withColumns({"likely": pi * g, "pi": pi, "q": F.when(F.col("at") == 0, q)})
        s = s.withColumns({"some": F.sum("likely").over(whole), "taken": F.sum("pi").over(whole), "chance": F.max("q").over(whole)})
        clean = F.greatest(F.lit(0.0), 1 - F.col("taken")) * F.col("chance")
        s = s.withColumns({"r1": F.col("likely") / (F.col("some") + clean), "p1": F.col("some") / (F.col("some") + clean)})
        s = cut(s.select(*[c for c in e.columns if c not in ("r", "p")], F.col("r1").alias("r"), F.col("p1").alias("p"), F.abs(F.col("p1") - F.col("p")).alias("change")))
        moved = s.agg(F.max("change")).first()[0]
        e = s.drop("change")
        if moved is None or moved < CLOSE:
            break
    best = e.groupBy("cid").agg(F.max_by("chain", F.struct("r", -F.col("at"))).alias("chain"), F.max("p").alias("posterior"))
    return best


def judged(results: DataFrame, with_value: bool = False) -> DataFrame:
    """Evidence rows with their likeliest chain and posterior."""
    rows = cut(evidence_rows(values_of(results), with_value))
    source = F.coalesce("engine_used", F.lit("")).alias("source")
    sizes = F.explode(F.array(F.struct(F.lit("text").alias("field"), F.col("text").isNotNull().cast("long").alias("n")), F.struct(F.lit("warnings").alias("field"), F.greatest(F.coalesce(F.size("warnings"), F.lit(0)), F.lit(0)).cast("long").alias("n"))))
    totals = results.select(source, sizes.alias("x")).groupBy("source", "x.field").agg(F.sum("x.n").alias("total"))
    cells = rows.groupBy("source", "field", "script", "chains", "levels").agg(F.count("*").alias("n"))
    cid = F.xxhash64("source", "field", "script", F.concat_ws("|", "chains"), F.to_json("levels"))
    return rows.withColumn("cid", cid).join(fit(cells, totals).hint("merge"), "cid").drop("cid", "chains", "levels")


def garbled_values(results: DataFrame) -> DataFrame:
    """(result_id, field, pos, chain, posterior) of the garbled values."""
    return judged(results).where(F.col("posterior") >= BELIEF).select("result_id", "field", "pos", "chain", "posterior")


def restored(value: Column, chain: Column) -> Column:
    @F.arrow_udf("string")
    def undo(values: pa.Array, chains: pa.Array) -> pa.Array:
        return pa.array([restore(v, c) for v, c in zip(values.to_pylist(), chains.to_pylist(), strict=True)], pa.string())

    return undo(value, chain)


def restored_values(results: DataFrame) -> DataFrame:
    """(result_id, field, pos, chain, posterior, value, restored) of the garbled values."""
    rows = judged(results, True).where(F.col("posterior") >= BELIEF)
    return rows.select("result_id", "field", "pos", "chain", "posterior", "value", restored(F.col("value"), F.col("chain")).alias("restored"))
