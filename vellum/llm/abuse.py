"""Scores for abusive, hateful and sexually explicit wording by compression distance.

Two zstandard dictionaries are made, one of offensive and one of ordinary text. A window of text that one dictionary shortens
clearly more than the other resembles it. The score of a window is the difference of the two lengths a byte; that of a document
is its largest. The dictionaries begin with the labelled examples, at most MAX_EXAMPLES of them, and nothing else is
listed anywhere. They then grow on the corpus: one pass counts the windows of all documents; in each of a few rounds those
that score clearly offensive join the offensive dictionary, and those that a fixed share of all documents has and that don't
score so join the ordinary one. Wordings unlike all examples are known by their company: after two rounds another pass looks at the
documents that hold a window found so far, and what stands in such documents far more often than chance has it, beside several
different windows found, joins too. A dictionary holds its texts whole up to DICTIONARY_BYTES;
beyond that zstandard's trainer selects what it holds.

The threshold is calibrated on the examples: each is scored with dictionaries that lack all examples it shares a phrase with.

Before comparing, spelling is evened out: case, width, accents on letters used as disguise, letters drawn apart, drawn out
or replaced by digits and signs; numbers count as one.

Defined results: null, empty and blank texts score 0 and are never offensive; without offensive and ordinary examples every score
is 0 and nothing is offensive; every window of a text of any length is scored, though compression saves no byte on a window of
a few letters, so a single short word scores 0.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from vellum.runtime import cut

#: Labelled rows that may be fitted on.
MAX_EXAMPLES = 20_000
#: Threshold where there are too few examples to calibrate on; windows a worker remembers.
DEFAULT_THRESHOLD, MEMO_LIMIT = 0.1, 300_000
#: Length and step of the windows of long sentences, in characters.
WINDOW, STEP = 160, 80
#: Share of held-out ordinary examples that may lie above the threshold.
ORDINARY_ABOVE = 0.01
#: Bytes a dictionary holds whole, and the least bytes a length is divided by.
DICTIONARY_BYTES, LEAST_BYTES = 1 << 17, 24
#: Growth: a window of at most ADOPT_CHARS that scores at least ADOPT, and so by ADOPT_BYTES at least, becomes offensive unless it is
#: usual; a usual window, which at least USUAL_SHARE of the documents and USUAL_LEAST have, is ordinary if it scores at most
#: ORDINARY. The most frequent offensive ones come first, until their dictionary is as large as the ordinary one: the larger one
#: would shorten everything a little more.
ADOPT, ADOPT_BYTES, ADOPT_CHARS, ORDINARY, USUAL_SHARE, USUAL_LEAST, ROUNDS = 0.2, 8, 110, 0.08, 1e-3, 5, 4
#: Rounds before the company is looked at. Bytes from which a short window counts.
ALONE_ROUNDS, SHORT_BYTES = 2, 16
#: A window keeps company with offensive ones if it stands beside COMPANIONS different ones at least, LIFT times as often as any
#: window does, by DEVIATIONS standard deviations, and so do all windows that begin as it does, and all that end so, taken
#: together: of a pattern with names in it many windows are rare and some meet anything. It must not resemble ordinary text.
COMPANIONS, LIFT, DEVIATIONS, UNLIKE = 3, 5, 4, -0.15
#: Distinct windows a worker counts before it passes them on.
COUNTER_LIMIT = 200_000

_SPLIT = re.compile(r"(?<=[.!?。！？…])\s+|(?<=[。！？])|\n+")
_APART = re.compile(r"(?<!\w)(?:\w[ .\-_*]){3,}\w(?!\w)")
_MASK = re.compile(r"(?<=\w)[*#$@+_.\-~^]+(?=\w)")
_LONG = re.compile(r"([^\W\d_])\1{2,}")
_MIXED = re.compile(r"[a-z0-9@$!]*(?:[a-z][0-9]|[0-9][a-z]|[a-z][@$!][a-z]|[@$][a-z])[a-z0-9@$!]*")
_LEET = str.maketrans("013457@$!", "oieastasi")
_OPENING = re.compile(r"^[^:,，：]{2,40}[:,，：]\s*(?=\S{2})")
_INTRO = re.compile(r"^(?:[-*]\s+)?(?:\*\*[^*]{1,20}\*\*\s*)?")


_LEETABLE = re.compile(r"[0-9@$!]")
_MASKS = re.compile(r"(?<=[^\W\d_])[*#+~^]+(?=[^\W\d_])")
_ALONE = re.compile(r"(?<![\w@$!])[0-9]+(?![\w@$!])")
_SPACE, _NUMBER, _JOINTS = re.compile(r"\s+"), re.compile(r"[0-9]+"), re.compile(r"[ .\-_*]")


def _unleeted(m: re.Match) -> str:
    return m.group().translate(_LEET) if sum(c.isalpha() for c in m.group()) >= 3 else m.group()


def even(window: str) -> str:
    """Spelling evened out, numbers as one sign."""
    # which digits a number by itself has makes no difference
    return _evened(_ALONE.sub(lambda m: "0" * len(m.group()), window)) if window.isascii() else _evened(window)


@lru_cache(maxsize=100_000)
def _evened(window: str) -> str:
    t = window
    if not t.isascii():
        t = unicodedata.normalize("NFKC", t)
        t = "".join(c for c in t if c < "\xad" or unicodedata.category(c) not in ("Cf", "Mn"))
    t = _INTRO.sub("", t.strip().lower().lstrip("# ").strip())
    t = _APART.sub(lambda m: _JOINTS.sub("", m.group()), t)
    if _LEETABLE.search(t):
        t = " ".join(w if w.isalpha() or not _LEETABLE.search(w) else _MIXED.sub(_unleeted, w) for w in t.split())
    t = _MASKS.sub("", _LONG.sub(r"\1", t))
    return _SPACE.sub(" ", _NUMBER.sub("0", t))


def windows(text: str) -> Iterator[str]:
    for s in _SPLIT.split(text):
        if not s or s.isspace():
            continue
        if len(s) <= WINDOW + STEP:
            yield s
            # what follows an opening such as "for the record:" also by itself
            m = _OPENING.match(s)
            if m:
                yield s[m.end() :]
        else:
            for i in range(0, len(s) - STEP, STEP):
                yield s[i : i + WINDOW]


def dictionary(texts: list[str]) -> bytes:
    """The texts whole, or as many of their common parts as the trainer gets into DICTIONARY_BYTES."""
    import zstandard as z

    whole = "\n".join(texts).encode()
    return whole if len(whole) <= DICTIONARY_BYTES else z.train_dictionary(DICTIONARY_BYTES, [t.encode() for t in texts]).as_bytes()


class Scorer:
    def __init__(self, offensive: list[str], ordinary: list[str]):
        import zstandard as z

        params = z.ZstdCompressionParameters(compression_level=12, window_log=18, min_match=3, strategy=z.STRATEGY_BTULTRA2, write_content_size=0, write_checksum=0, write_dict_id=0, format=z.FORMAT_ZSTD1_MAGICLESS)

        def sized(texts: list[str]):
            # both as plain content: trained tables of letter frequencies would differ and tell languages apart, not wordings
            d = z.ZstdCompressionDict(dictionary(texts), dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=params)
            c = z.ZstdCompressor(dict_data=d, compression_params=params).compress
            return lambda raw: len(c(raw))

        self.known = bool(offensive and ordinary)
        if self.known:
            self.bad, self.good = sized(offensive), sized(ordinary)
        self.memo: dict[str, float] = {}

    def window(self, evened: str) -> float:
        if not self.known:
            return 0.0
        known = self.memo.get(evened)
        if known is None:
            raw = evened.encode()
            if len(raw) >= SHORT_BYTES:
                # on fewer bytes zstandard saves nothing
                raw = raw.ljust(LEAST_BYTES, b"\n")
            known = (self.good(raw) - self.bad(raw)) / max(len(raw), LEAST_BYTES)
            if len(self.memo) >= MEMO_LIMIT:
                self.memo.clear()
            self.memo[evened] = known
        return known

    def text(self, text: str | None) -> float:
        if not text or text.isspace():
            return 0.0
        return max((self.window(even(w)) for w in windows(text)), default=0.0)


def labelled(examples: list[tuple[str, int]]) -> tuple[list[str], list[str]]:
    """(offensive, ordinary) evened texts of labelled examples; a text with both labels counts as its first."""
    lines: dict[str, int] = {}
    for text, label in examples:
        if text and text.strip():
            lines.setdefault(even(text), int(label))
    return sorted(t for t, y in lines.items() if y == 1), sorted(t for t, y in lines.items() if y == 0)


def _phrases(text: str) -> set[str]:
    words = re.findall(r"[^\W_]+", text)
    out = {" ".join(words[i : i + 3]) for i in range(len(words) - 2)}
    for run in re.findall("[㐀-鿿]+", text):
        out |= {run[i : i + 4] for i in range(len(run) - 3)}
    return out or {text}


def families(texts: list[str]) -> list[int]:
    """A number for each text: equal for texts that a chain of shared phrases connects."""
    parent = list(range(len(texts)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    first: dict[str, int] = {}
    for i, t in enumerate(texts):
        for p in _phrases(t):
            parent[root(i)] = root(first.setdefault(p, i))
    return [root(i) for i in range(len(texts))]


def calibrated(bad: list[str], good: list[str], folds: int = 5) -> float:
    """The score that at most a share ORDINARY_ABOVE of the ordinary examples exceeds, each scored without its family."""
    if len(bad) < 20 or len(good) < 20:
        return DEFAULT_THRESHOLD
    kin = families([*bad, *good])
    order = {k: n % folds for n, k in enumerate(dict.fromkeys(kin))}
    fold = [order[k] for k in kin]
    held = []
    for k in range(folds):
        s = Scorer([t for t, f in zip(bad, fold, strict=False) if f != k], [t for t, f in zip(good, fold[len(bad) :], strict=True) if f != k])
        held += [(s.window(t), y) for texts, fs, y in ((bad, fold, 1), (good, fold[len(bad) :], 0)) for t, f in zip(texts, fs, strict=False) if f == k]
    # offensive text is far rarer in a corpus than among the examples: next to no ordinary example may lie above
    ordinary = sorted((x for x, y in held if not y), reverse=True)
    at = ordinary[int(len(ordinary) * ORDINARY_ABOVE)]
    above = min((x for x, _ in held if x > at), default=at + 1 / LEAST_BYTES)
    return (at + above) / 2


@lru_cache(maxsize=2)
def _scorer(bad: tuple[str, ...], good: tuple[str, ...]) -> Scorer:
    return Scorer(list(bad), list(good))


def counted_windows(documents: DataFrame) -> DataFrame:
    """(window, n): the evened windows, and how many documents have each."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["window", "n"])
            seen.clear()
            return out

        for batch in batches:
            for t in batch.column(0).to_pylist():
                if t and not t.isspace():
                    seen.update({even(w) for w in windows(t)})
            if len(seen) > COUNTER_LIMIT:
                yield flush()
        if seen:
            yield flush()

    return documents.select("text").mapInArrow(count, "window string, n long").groupBy("window").agg(F.sum("n").alias("n"))


def _window_score(window: Column, model) -> Column:
    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        s = _scorer(*model.value)
        return pa.array([s.window(t) for t in texts.to_pylist()], pa.float64())

    return score(window)


def _company(documents: DataFrame, known: list[str]) -> DataFrame:
    """(window, k, texts, companions) of the windows of documents that hold a window of `known` besides: how many documents, different
    ones, and different known windows these are. Of the null window k is the number of documents that hold any of `known`."""
    seeds = documents.sparkSession.sparkContext.broadcast(frozenset(known))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        number = lambda t: xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) >> 1
        for batch in batches:
            rows: list[tuple[str | None, int, int]] = []
            for t in batch.column(0).to_pylist():
                if not t or t.isspace():
                    continue
                own = {even(w) for w in windows(t)}
                if met := own & seeds.value:
                    text, (first, *more) = number(t), sorted(met)
                    rows.append((None, text, 0))
                    rows += [(w, text, number(first if w != first else more[0])) for w in own if w != first or more]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())], names=["window", "text", "companion"])

    met = documents.select("text").mapInArrow(pairs, "window string, text long, companion long")
    met = met.groupBy("window", "text").agg(F.count("*").alias("k"), F.min("companion").alias("companion")).groupBy("window", "companion").agg(F.sum("k").alias("k"), F.count("*").alias("texts"))
    return met.groupBy("window").agg(F.sum("k").alias("k"), F.sum("texts").alias("texts"), F.count("*").alias("companions"))


def keeping_company(counted: DataFrame, documents: DataFrame, known: list[str], n_documents: int) -> DataFrame:
    """`counted` (window, n) with the column kept: whether the window keeps company with those of `known`."""
    met = cut(_company(documents, known))
    held = met.where("window is null").first()
    if held is None:
        return counted.withColumn("kept", F.lit(False))
    share = F.lit(held["k"] / n_documents)
    c = counted.join(met.where("window is not null").hint("merge"), "window", "left").fillna(0, ["k", "texts", "companions"])
    # four Chinese characters or twelve others
    size = F.when(F.octet_length("window") > 2 * F.length("window"), F.lit(4)).otherwise(F.lit(12))
    c = cut(c.withColumns({"head": F.left("window", size), "tail": F.right("window", size)}))
    often = F.col("k") >= LIFT * share * F.col("n")
    # copies of a document count once
    n = F.col("n") * F.col("texts") / F.greatest("k", F.lit(1))
    rare = F.col("texts") - n * share >= DEVIATIONS * F.sqrt(n * share * (1 - share))
    kept = c.where((F.col("companions") >= COMPANIONS) & often & rare)
    for part in ("head", "tail"):
        kept = kept.join(c.groupBy(part).agg(F.sum("n").alias("n"), F.sum("k").alias("k")).where(often).hint("merge"), part, "left_semi")
    return cut(c.select("window", "n").join(kept.select("window", F.lit(True).alias("kept")).hint("merge"), "window", "left").withColumn("kept", F.coalesce("kept", F.lit(False))))


def grown(documents: DataFrame, bad: list[str], good: list[str]) -> tuple[list[str], list[str]]:
    """The two lists of texts, grown on the corpus. What comes to the driver is bounded: the windows that at least USUAL_SHARE of the
    documents have, of which a document of m windows pays for m, and as many bytes of offensive ones."""
    spark = documents.sparkSession
    n_documents = documents.count()
    usual = max(USUAL_LEAST, USUAL_SHARE * n_documents)
    counted = cut(counted_windows(documents).where((F.col("n") >= usual) | (F.length("window") <= ADOPT_CHARS))).withColumn("kept", F.lit(False))
    size = lambda texts: sum(len(t.encode()) + 1 for t in texts)
    more_bad, more_good = list(bad), list(good)
    for k in range(ROUNDS):
        if k == ALONE_ROUNDS:
            counted = keeping_company(counted.select("window", "n"), documents, more_bad, n_documents)
        model = spark.sparkContext.broadcast((tuple(more_bad), tuple(more_good)))
        scored = counted.withColumn("v", _window_score(F.col("window"), model))
        bytes_, rare = F.octet_length("window"), (F.col("n") < usual) & (F.length("window") <= ADOPT_CHARS)
        clear = (F.col("v") >= ADOPT) & (F.col("v") * F.greatest(bytes_, F.lit(LEAST_BYTES)) >= ADOPT_BYTES - 0.5)
        up = rare & (clear | (F.col("kept") & (F.col("v") >= UNLIKE) & (bytes_ >= SHORT_BYTES)))
        # once the company is known, what is usual and keeps none is ordinary unless it is clearly offensive
        plain = (F.col("v") <= ORDINARY) | (F.lit(k >= ALONE_ROUNDS) & ~F.col("kept") & (F.col("v") < ADOPT))
        scored = cut(scored.where(up | ((F.col("n") >= usual) & plain)).withColumn("up", up))
        down = [r["window"] for r in scored.where(~F.col("up")).select("window").collect()]
        more_good = sorted({*good, *down})
        room = size(more_good) - size(bad)
        # windows have a byte at least
        ahead = F.sum(F.octet_length("window") + 1).over(W.Window.orderBy(F.desc("n"), "window"))
        first = scored.where("up").orderBy(F.desc("n"), "window").limit(max(room, 0) // 2 + 1)
        taken = [r["window"] for r in first.withColumn("upto", ahead).where(F.col("upto") <= room).select("window").collect()]
        more_bad = sorted({*bad, *taken})
    return more_bad, more_good


def abuse_scores(documents: DataFrame, examples: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, source, score, offensive) of every row of `documents` (key, text, source). Three passes; only counted windows are shuffled.

    At most MAX_EXAMPLES labelled rows, in the order of example_id, are fitted on.
    """
    spark = documents.sparkSession
    rows = examples.where("text is not null and label is not null").orderBy("example_id").limit(MAX_EXAMPLES).select("text", "label").collect()
    bad, good = labelled([(r["text"], r["label"]) for r in rows])
    threshold = calibrated(bad, good)
    if bad and good:
        bad, good = grown(documents, bad, good)
    model = spark.sparkContext.broadcast((tuple(bad), tuple(good)))

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        s = _scorer(*model.value)
        return pa.array([round(s.text(t), 6) for t in texts.to_pylist()], pa.float64())

    offensive = F.col("score") >= F.lit(float(threshold)) if bad and good else F.lit(False)
    return documents.select(key, "source", score("text").alias("score")).withColumn("offensive", offensive)


def abuse_rates(scores: DataFrame) -> DataFrame:
    """source, n_docs, n_offensive, rate; documents without a source under null."""
    return scores.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum(F.col("offensive").cast("long")).alias("n_offensive"), F.avg(F.col("offensive").cast("double")).alias("rate"))
