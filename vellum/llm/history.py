"""New batches of search results against everything accepted before.

Identifiers are settled by looking their values up. Near titles go through a prefix-tree hash forest: a title's weighted
min-hash values, in several permutations, are packed into numbers; sorted by them, titles that begin alike in some tree lie
together. The history is kept as runs of such numbers, sorted (`runs`). The entries of a batch are located in them by range
search, first by long prefixes, then, for what no earlier entry settles yet, by shorter ones, down to the length at
which the forest's depth and number of trees give the recall aimed at. Candidates are verified on the titles themselves. The
entries of the batch become a run of their own, and runs are merged into one; the history is never hashed or read whole again,
and its entries are never compared with each other.

Titles enter the forest once per distinct wording, so copies and re-deliveries, however many, meet nobody there.

Defined results: a null or empty identifier or title links nothing; identifiers that aren't shaped as such, and those that
unrelated titles share, link nothing; titles that name no work (editorials, prefaces, reviews) link through identifiers only;
a row without identifiers and title is new.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.runs import SortedRuns
from vellum.llm.titles import same_work, title_parts
from vellum.runtime import cut, ensure_checkpoint_dir

#: Trees over the words weighted by rarity, trees over the common words alone, and the depth of either.
RARE_TREES, COMMON_TREES, RARE_DEPTH, COMMON_DEPTH = 16, 8, 6, 10
TREES = RARE_TREES + COMMON_TREES
#: Prefix lengths of the rare trees, tried one after the other for what no earlier entry settles yet; the trees of common words, of
#: which the whole depth must agree, join in at the second. Weighted by rarity, the name of a place outweighs the rest of a
#: title: two wordings of one work that agree in 0.6 of the weight share a prefix of 4 in one of the 16 trees with probability
#: 0.89, at 0.7 with 0.99. Where the name itself is mistyped the common words agree: at 0.9 of them, a prefix of 10 is shared in
#: one of the 8 trees with probability 0.97. A title that was cut short may keep 0.4 of the weight: a prefix of 2, 0.94.
WIDTHS, CUT_WIDTH = (6, 4), 2
#: Numbers that tell unlike titles apart, see `forms_of`.
FORM = ("form", "head", "name")
#: Buckets of the frequency sketch that weighs the words: its size does not depend on the data. Words rarer than about one
#: in BUCKETS weigh alike.
BUCKETS = 1 << 20
#: A word is usual if at least one title in so many has it.
USUAL_SHARE = 2000
#: Live runs from which the smaller ones are merged.
FAN = 6
#: `ord` of what was accepted before all batches.
BEFORE = -(1 << 62)


def clean_doi(c: Column) -> Column:
    """DOI in one notation; null unless it is shaped as one."""
    d = F.lower(F.regexp_replace(F.trim(c), r"(?i)^(https?://)?(dx\.)?doi\.org/|^doi:\s*", ""))
    d = F.regexp_replace(F.element_at(F.split(F.trim(d), r"\s+"), 1), r"[.,;]+$", "")
    return F.when(d.rlike(r"^10\.\d{4,9}/\S+$"), d)


def clean_arxiv(c: Column) -> Column:
    a = F.lower(F.trim(c))
    a = F.regexp_replace(a, r"^https?://", "")
    a = F.regexp_replace(a, r"^(arxiv\.org/)?(abs|pdf)/|^arxiv:\s*", "")
    a = F.regexp_replace(a, r"(\.pdf)?$", "")
    a = F.regexp_replace(a, r"v\d+$", "")
    return F.when(a.rlike(r"^(\d{4}\.\d{4,5}|[a-z.\-]+/\d{7})$"), a)


def _less(w: str) -> list[str]:
    return [w, *(w[:i] + w[i + 1 :] for i in range(len(w)))]


class Usual:
    """The words that many titles have, and what slips of them look like: within one character left out on either side."""

    def __init__(self, words: list[str]):
        self.words = frozenset(words)
        self.near = {x: w for w in reversed(words) if len(w) > 3 for x in _less(w)}
        self.memo: dict[str, str] = {}
        self.heads: dict[str, int] = {}
        self.chars: dict[str, tuple[int, int]] = {}

    def __call__(self, w: str) -> str:
        if w in self.words or len(w) < 4:
            return w
        known = self.memo.get(w)
        if known is None:
            known = next((self.near[x] for x in _less(w) if x in self.near), w)
            if len(self.memo) > 200_000:
                self.memo.clear()
            self.memo[w] = known
        return known


def _features(base: str, usual) -> set[str]:
    """Words, slips of usual ones put right; of Chinese, runs of three and four characters."""
    if any("㐀" <= c <= "鿿" for c in base):
        return {base[i : i + k] for k in (3, 4) for i in range(len(base) - k + 1)} or {base}
    return {usual(w) for w in base.split()} or {base}


def _hashes(bases: list[str], usual=lambda w: w):
    """(64-bit hashes of the features of all bases end to end, where each base's features begin)."""
    import numpy as np
    import xxhash

    flat: list[int] = []
    starts = [0]
    digest = xxhash.xxh3_64_intdigest
    for b in bases:
        flat += [digest(g) for g in _features(b, usual)]
        starts.append(len(flat))
    return np.array(flat, "uint64"), np.array(starts, "int64")


class Weights:
    """Bucket counts of the features and the usual words; what every signature is made with."""

    def __init__(self, counts, usual: list[str]):
        self.counts, self.usual_words, self._usual = counts, usual, None

    @property
    def usual(self) -> Usual:
        if self._usual is None:
            self._usual = Usual(self.usual_words)
        return self._usual

    def __getstate__(self):
        return {"counts": self.counts, "usual_words": self.usual_words, "_usual": None}


def feature_weights(entries: DataFrame) -> Weights:
    """How many bases have a feature of each bucket: BUCKETS numbers, whatever the data. Usual are words in at least 1 in
    USUAL_SHARE titles; of these there are at most USUAL_SHARE times the words of a title."""
    import numpy as np

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, "int64")
        for batch in batches:
            h, _ = _hashes([b for b in batch.column(0).to_pylist() if b])
            total += np.bincount((h % np.uint64(BUCKETS)).astype("int64"), minlength=BUCKETS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype("int32")), pa.array(total[some])], names=["bucket", "n"])

    rows = entries.select("base").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS, "int64")
    out[rows.column(0).to_numpy()] = rows.column(1).to_numpy()
    least = max(4.0, float(out.max()) / USUAL_SHARE)
    words = entries.where("not base rlike '[㐀-鿿]'").select(F.explode(F.array_distinct(F.split("base", " "))).alias("w")).groupBy("w").count()
    usual = words.where(F.col("count") >= least).orderBy(F.desc("count"), "w").toArrow().column(0).to_pylist()
    return Weights(out, usual)


def slots_of(bases: list[str], w: Weights):
    """TREES numbers of each base. What a feature draws on a level is worked out once for all bases that have it; the byte that a level
    shows is kept in the low bits of the draw, so the least draw of a base is its byte too."""
    import numpy as np

    every, starts = _hashes(bases, w.usual)
    h, at = np.unique(every, return_inverse=True)
    seen = w.counts
    total = float(seen.max()) + 1
    df = seen[(h % np.uint64(BUCKETS)).astype("int64")].astype("float64")
    rarity = -1 / np.log1p(total / (1 + df)) ** 2
    common = np.where(df >= max(4.0, total / USUAL_SHARE), -1.0, -1e4)
    out = np.zeros((TREES, len(bases)), "uint64")
    level, low = 0, np.uint64(255)
    for t in range(TREES):
        rare = t < RARE_TREES
        for _ in range(RARE_DEPTH if rare else COMMON_DEPTH):
            x = h * np.uint64((0x9E3779B97F4A7C15 * (2 * level + 1)) & 0xFFFFFFFFFFFFFFFF)
            level += 1
            x ^= x >> np.uint64(29)
            x *= np.uint64(0xBF58476D1CE4E5B9)
            x ^= x >> np.uint64(32)
            draw = np.log(((x >> np.uint64(11)).astype("float64") + 1) / 9007199254740994.0) * (rarity if rare else common)
            # no draw is negative, so their bits have their order
            draw = (draw.view("uint64") & ~low) | (x >> np.uint64(56))
            won = np.minimum.reduceat(draw[at], starts[:-1]) & low
            out[t] = (out[t] << np.uint64(8)) | won if rare else (out[t] ^ won) * np.uint64(0x100000001B3)
        if not rare:
            out[t] >>= np.uint64(16)
        out[t] |= np.uint64(t << 48)
    return out.T


def forms_of(bases: list[str], usual: Usual):
    """Three numbers of each base that tell most unlike titles apart without reading them, see `may_be_alike`. form: a bit for a last word
    that isn't usual, one for Chinese, four for the number of words, three for that of the words that aren't usual, six for the letters
    of these (Chinese: of the base), and 48 for the characters that occur in them an odd number of times; never 0, which stands for no
    form. head: the first four words in 16 bits each, no word is 0. name: the first twelve of those letters in 5 bits each, no letter is 0."""
    import numpy as np

    forms, heads, names = [], [], []
    word, char = usual.heads, usual.chars
    for b in bases:
        wide = any("㐀" <= c <= "鿿" for c in b)
        words = b.split()
        rare, n, last, head = b, 1, False, 0
        if not wide:
            right = [usual(w) for w in words]
            of = [w for w in right if w not in usual.words]
            rare, n, last = "".join(of), len(of), right[-1] not in usual.words
            for k, w in enumerate(right[:4]):
                x = word.get(w)
                if x is None:
                    if len(word) > 200_000:
                        word.clear()
                    x = word[w] = _short_hash(w) % 65535 + 1
                head |= x << 16 * k
        odd = name = 0
        for k, c in enumerate(rare):
            x = char.get(c)
            if x is None:
                at = ord(c) - 97 if "a" <= c <= "z" else 26 + ord(c) % 22 if c.isascii() else _short_hash(c) % 48
                x = char[c] = (1 << at, at % 31 + 1 if c.isascii() else _short_hash(c) % 31 + 1)
            odd ^= x[0]
            if k < 12:
                name |= x[1] << 5 * k
        forms.append(last << 62 | wide << 61 | min(len(words), 15) << 57 | min(n, 7) << 54 | min(len(rare), 63) << 48 | odd)
        heads.append(head - (1 << 64) if head >> 63 else head)
        names.append(name)
    return np.array(forms, "int64"), np.array(heads, "int64"), np.array(names, "int64")


def _short_hash(text: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(text)


def may_be_alike(form, head, name, short, other_form, other_head, other_name, other_short):
    """Whether `same_base` can hold, by arrays of forms, heads and names. An edit turns two of the bits of characters at most and changes the
    length by one at most; neighbours exchanged turn none. A letter that no edit took stands two places to and fro at most.

    Chinese: two slips, or one in a common beginning. Other titles, of one number of words: words differ by two slips each, four in the
    whole; or the last word was cut. One word more in one of them: left out in the other, or run into its neighbour there. Of several
    words more: one is the beginning of the other, or words are run together, which makes unusual ones. A beginning has three slips at
    most and agrees in enough words to meet in a tree, so two of its first four words are right, in whatever place. Titles of two
    scripts have no feature in common.
    """
    import numpy as np

    least = np.minimum((form >> 57) & 15, (other_form >> 57) & 15)
    words = np.maximum((form >> 57) & 15, (other_form >> 57) & 15)
    size, other_size = (form >> 48) & 63, (other_form >> 48) & 63
    rare, other_rare = (form >> 54) & 7, (other_form >> 54) & 7
    # numbers that were too large to keep, no form
    open_ = (words == 15) | (np.maximum(size, other_size) == 63) | (np.maximum(rare, other_rare) == 7) | (form == 0) | (other_form == 0)
    bits = np.bitwise_count((form ^ other_form) & ((1 << 48) - 1)).astype("int64")
    apart = np.abs(size - other_size)
    slips = 2 * np.minimum(rare, 2)
    slipped = (rare != other_rare) | (apart <= slips) & (bits <= 2 * slips) | ((form | other_form) >> 62 == 1) & (bits <= apart + 6) & (apart > slips)
    # of unequal numbers of words, a usual one may have run into another, or a word that was cut may be the last
    fewer = (form >> 57) & 15 == least
    ends = np.where(fewer, form, other_form) >> 62 == 1
    ran = (words > least) & np.where(fewer, rare > other_rare, other_rare > rare)
    joined = (words > least) & (ends | (apart > 2) & (bits <= apart + 4))
    wide = (form >> 61) & 1 == 1
    one_script = ((form ^ other_form) >> 61) & 1 == 0
    ok = open_ | one_script & np.where(wide, bits <= np.maximum(4, apart + 2), slipped | joined)
    begun = np.flatnonzero(ok & ~open_ & ~wide & ~ran & (short | other_short | (words > least + 1)))
    if len(begun):
        lanes = [[(h[begun] >> 16 * k) & 0xFFFF for k in range(4)] for h in (head, other_head)]
        right = sum(((lanes[0][k] == lanes[1][m]) & (lanes[0][k] != 0)).astype("int64") for k in range(4) for m in range(4))
        ok[begun] = right >= np.minimum(2, least[begun] - 1)
    named = np.flatnonzero(ok & ~open_ & (wide | (rare == other_rare) & ~joined))
    if len(named):
        less = size[named] <= other_size[named]
        x, y = np.where(less, name[named], other_name[named]), np.where(less, other_name[named], name[named])
        x, y = ([(c >> 5 * k) & 31 for k in range(12)] for c in (x, y))
        n = np.minimum(10, np.minimum(size, other_size)[named])
        found = np.zeros(len(named), "int64")
        for k in range(10):
            here = np.zeros(len(named), "bool")
            for m in range(max(0, k - 2), k + 3):
                here |= x[k] == y[m]
            found += here & (k < n)
        taken = np.where(wide[named], 2, slips[named] + ((form | other_form)[named] >> 62 == 1))
        ok[named] = found >= n - taken
    return ok


def signature(base: Column, weights) -> Column:
    """struct of slots, TREES numbers: the tree, and below it 48 bits, of a rare tree one byte a level, of a common tree all levels mixed;
    and of form, head and name. `weights`: broadcast of the Weights."""

    @F.arrow_udf("struct<slots:array<long>,form:long,head:long,name:long>")
    def sign(bases: pa.Array) -> pa.Array:
        import numpy as np

        n, parts = len(bases), ["slots", *FORM]
        if not n:
            return pa.StructArray.from_arrays([pa.array([], pa.list_(pa.int64())), *(pa.array([], pa.int64()) for _ in FORM)], names=parts)
        texts, w = [t or "" for t in bases.to_pylist()], weights.value
        out, form = slots_of(texts, w), forms_of(texts, w.usual)
        slots = pa.ListArray.from_arrays(pa.array(np.arange(0, n * TREES + 1, TREES), pa.int32()), pa.array(out.astype("int64").ravel()))
        return pa.StructArray.from_arrays([slots, *map(pa.array, form)], names=parts)

    return sign(base)


def works_of(rows: DataFrame) -> DataFrame:
    """Rows (ord, paper_id, doi, arxiv_id, title) with the identifiers in one notation and the parts of the title."""
    p = title_parts(F.col("title"))
    out = rows.withColumn("__p", p).withColumns({"doi": clean_doi(F.col("doi")), "arxiv_id": clean_arxiv(F.col("arxiv_id")), "paper_id": F.when(F.trim("paper_id") != "", F.trim("paper_id"))})
    return out.select("ord", "paper_id", "doi", "arxiv_id", F.coalesce("__p.base", F.lit("")).alias("base"), F.coalesce("__p.marks", F.lit("")).alias("marks"), F.coalesce("__p.generic", F.lit(False)).alias("generic"), F.coalesce("__p.short", F.lit(False)).alias("short"))


def wordings_of(works: DataFrame) -> DataFrame:
    """Distinct wordings that name works: wid, base, marks, short, first (the least ord)."""
    w = works.where("base <> '' and not generic").groupBy("base", "marks").agg(F.min("ord").alias("first"), F.max("short").alias("short"))
    return w.select(F.xxhash64("base", "marks").alias("wid"), "base", F.xxhash64("marks").alias("marks"), "short", "first")


def alike(met: DataFrame) -> DataFrame:
    """The rows of `met` (base, short, other_base, other_short, ...) whose two titles name the same work.

    A comparison in the JVM goes before the exact one and loses none of its pairs: `same_base` takes at most four slips (eight
    letters, where neighbours are exchanged) in the whole, or one word left out, or three slips in a common beginning.
    """
    a, b = F.translate("base", " ", ""), F.translate("other_base", " ", "")
    m = F.least(F.length(a), F.length(b))
    one_word = F.abs(F.size(F.split("base", " ")) - F.size(F.split("other_base", " "))) == 1
    loose = one_word | (F.levenshtein(a, b, 8) >= 0) | (F.levenshtein(F.substring(a, F.lit(1), m), F.substring(b, F.lit(1), m), 6) >= 0)
    return met.where(loose).where(same_work(F.col("base"), F.col("other_base"), F.col("short") | F.col("other_short")))


def _formed(signed: DataFrame) -> DataFrame:
    return signed if "form" in signed.columns else signed.withColumns({c: F.lit(0).cast("long") for c in FORM})


def _least_first(rows: DataFrame) -> DataFrame:
    return rows.groupBy("wid", "base", "marks").agg(F.max("short").alias("short"), F.min("first").alias("first"))


class Forest:
    """Wordings in sorted runs: their entries by tree and key, and the wordings themselves by their number."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.entries = SortedRuns(spark, f"{self.folder}/entries", "slot")
        self.wordings = SortedRuns(spark, f"{self.folder}/wordings", "wid")
        self._weights = None

    def weights(self, wordings: DataFrame | None = None):
        """The broadcast word weights: those of the first wordings, so later signatures stay comparable."""
        import numpy as np

        if self._weights is None:
            path = f"{self.folder}/weights"
            if wordings is not None:
                w = feature_weights(wordings)
                self.spark.createDataFrame([(w.counts.tobytes(), w.usual_words)], "counts binary, usual array<string>").write.mode("overwrite").parquet(path)
            else:
                kept = self.spark.read.parquet(path).first()
                w = Weights(np.frombuffer(kept["counts"], "int64"), list(kept["usual"]))
            self._weights = self.spark.sparkContext.broadcast(w)
        return self._weights

    def signed(self, wordings: DataFrame, first_of_all: bool = False) -> DataFrame:
        """`wordings` (wid, base, marks, short, first) with their slots, written to the shared folder."""
        w = self.weights(wordings if first_of_all else None)
        spread = max(self.spark.sparkContext.defaultParallelism, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        return cut(wordings.repartition(spread, "wid").withColumn("sign", signature(F.col("base"), w))).select("*", "sign.*").drop("sign")

    def add(self, signed: DataFrame) -> None:
        self.entries.add(_formed(signed).select("wid", "marks", *FORM, "short", F.explode("slots").alias("slot")))
        self.wordings.add(signed.drop("slots", *FORM))

    def merge(self, runs: tuple[list[str], list[str]] | None = None) -> None:
        self.entries.merge(lambda e: e.dropDuplicates(["slot", "wid"]), runs[0] if runs else None)
        self.wordings.merge(_least_first, runs[1] if runs else None)

    def tidy(self) -> None:
        """Where there are many runs, all but the first, which is the largest, become one."""
        e, w = self.entries.live(), self.wordings.live()
        if len(e) > FAN:
            self.merge((e[1:], w[1:]))

    def partners(self, asked: DataFrame, width: int, common: bool, earlier: bool) -> DataFrame:
        """(wid, other, other_first): verified partners of `asked` (signed wordings) among all runs, met by a prefix of `width`
        in a rare tree or, if `common`, in a tree of common words. `earlier`: only those of a lesser `first`."""
        slot = _formed(asked).select("wid", "marks", *FORM, "short", F.explode("slots").alias("slot"))
        rare = F.col("slot") < F.lit(RARE_TREES << 48)
        below = F.when(~rare, F.lit(0)).when(F.col("short"), F.lit((1 << 8 * (RARE_DEPTH - min(width, CUT_WIDTH))) - 1 if common else (1 << 8 * (RARE_DEPTH - width)) - 1)).otherwise(F.lit((1 << 8 * (RARE_DEPTH - width)) - 1)).cast("long")
        ranges = (slot if common else slot.where(rare)).withColumn("below", below)
        ranges = ranges.select("wid", "marks", *FORM, "short", F.col("slot").bitwiseAND(F.bitwise_not("below")).alias("lo"), F.col("slot").bitwiseOR(F.col("below")).alias("hi"))
        ranges = ranges.repartitionByRange("lo").sortWithinPartitions("lo")
        met = self.entries.search(ranges, "lo", "hi", {"wid": "other"}, ("marks", "marks"), fits=((*FORM, "short"), may_be_alike)).where("wid <> other").select("wid", "other")
        # one side of these joins grows with the batch: never left to a broadcast
        met = met.repartition("wid").dropDuplicates(["wid", "other"]).hint("merge").join(asked.select("wid", "base", "short", "first"), "wid")
        met = met.repartitionByRange("other").sortWithinPartitions("other").withColumn("hi", F.col("other"))
        found = self.wordings.search(met, "other", "hi", {"wid": "other", "base": "other_base", "short": "other_short", "first": "other_first"})
        if earlier:
            found = found.where("other_first < first")
        return cut(alike(found).groupBy("wid", "other").agg(F.min("other_first").alias("other_first")))

    def near(self, signed: DataFrame, earlier: bool = False) -> DataFrame:
        """(wid, other, other_first) of the wordings `signed` and their partners in the runs. `earlier`: it is only asked whether there
        is a partner of a lesser `first`, so the search for a wording ends there; else the shortest prefix is used for all."""
        if not earlier:
            return self.partners(signed, WIDTHS[-1], True, False)
        found, pending = None, signed
        for k, width in enumerate(WIDTHS):
            pairs = self.partners(pending, width, k == len(WIDTHS) - 1, True)
            found = pairs if found is None else found.unionByName(pairs)
            pending = pending.join(pairs.select("wid").distinct().hint("merge"), "wid", "left_anti")
        return found


def identifiers_of(works: DataFrame) -> DataFrame:
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in ("paper_id", "doi", "arxiv_id")))
    return works.select("ord", "base", F.explode(kinds).alias("i")).where("i.value is not null").select("ord", "base", F.xxhash64("i.kind", "i.value").alias("vid"), "i.kind", "i.value")


class HistoryForest:
    """The history in a folder: a forest of its titles, and what is known of each identifier.

    `start` takes the history in; `accept` checks a batch against all of it, says which of its rows are known, and takes the
    batch in as a run of its own; `merge` makes one run of all. Batches are accepted in their order: a row is known if its
    work is in the history, in an earlier batch, or in a row of the same batch with a lesser cand_id.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.forest = Forest(spark, f"{self.folder}/titles")
        self.ids = SortedRuns(spark, f"{self.folder}/ids", "vid")

    def start(self, seen: DataFrame) -> None:
        works = cut(works_of(seen.select(F.lit(BEFORE).alias("ord"), "paper_id", "doi", "arxiv_id", "title")))
        self.ids.add(self._identified(works, False)[0])
        self.forest.add(self.forest.signed(cut(wordings_of(works)), first_of_all=True))

    def _identified(self, works: DataFrame, old: bool) -> tuple[DataFrame, DataFrame]:
        """(rows for a run of identifiers, ord of the rows that an earlier row's identifier makes known). Grouping and look-ups
        only: a value that a third of the rows share is one group of partial counts."""
        ids = identifiers_of(works)
        own = ids.groupBy("vid", "kind", "value").agg(F.min("ord").alias("first"), F.min_by("base", F.struct("ord", "base")).alias("first_base"), F.count("*").alias("n"))
        if old:
            asked = cut(own.repartitionByRange("vid").sortWithinPartitions("vid"))
            there = self.ids.search(asked.select("vid", "kind", "value", F.col("vid").alias("lo"), F.col("vid").alias("hi")), "lo", "hi", {"value": "v", "kind": "k", "first": "f", "first_base": "b", "n": "m", "unlike": "u"})
            there = there.where("k = kind and v = value").groupBy("vid", "kind", "value").agg(F.min("f").alias("f"), F.min_by("b", F.struct("f", "b")).alias("b"), F.sum("m").alias("m"), F.sum("u").alias("u"))
            own = asked.join(there.hint("merge"), ["vid", "kind", "value"], "left")
        else:
            own = own.withColumns({"f": F.lit(None).cast("long"), "b": F.lit(None).cast("string"), "m": F.lit(0).cast("long"), "u": F.lit(0).cast("long")})
        # what came first in the history stays the first
        own = own.withColumns({"first_base": F.when(F.col("f") <= F.col("first"), F.col("b")).otherwise(F.col("first_base")), "first": F.least("first", "f"), "m": F.coalesce("m", F.lit(0)), "u": F.coalesce("u", F.lit(0))})
        met = ids.join(own.hint("merge"), ["vid", "kind", "value"])
        # equal ones are most
        far = F.when(F.col("base") == F.col("first_base"), False).otherwise(F.levenshtein("base", "first_base") > 0.6 * F.greatest(F.length("base"), F.length("first_base")))
        met = cut(met.select("ord", "vid", "kind", "value", "first", "first_base", "n", "m", "u", ((F.col("base") != "") & (F.col("first_base") != "") & far).alias("apart")))
        totals = met.groupBy("vid", "kind", "value").agg(F.min("first").alias("first"), F.min("first_base").alias("first_base"), F.min("n").alias("n"), F.sum(F.col("apart").cast("long")).alias("unlike"), F.min("m").alias("m"), F.min("u").alias("u"))
        # paper ids mean what they say; another identifier is a placeholder where unlike titles have it
        real = met.where("ord > first").select("ord", "vid", "kind", "value", "apart").join(totals.select("vid", "kind", "value", ((F.col("unlike") + F.col("u")) / (F.col("n") + F.col("m"))).alias("share")).hint("merge"), ["vid", "kind", "value"])
        known = real.where("kind = 'paper_id' or (share < 0.4 and not apart)").select("ord").distinct()
        return totals.drop("m", "u"), known

    def known(self, batch: DataFrame) -> DataFrame:
        """(ord) of the known rows of `batch` (cand_id, paper_id, doi, arxiv_id, title), which is taken into the history."""
        works = cut(works_of(batch.select(F.col("cand_id").cast("long").alias("ord"), "paper_id", "doi", "arxiv_id", "title")))
        ids, by_id = self._identified(works, True)
        wordings = cut(wordings_of(works).repartitionByRange("wid").sortWithinPartitions("wid"))
        asked = wordings.select("wid", F.col("wid").alias("lo"), F.col("wid").alias("hi"))
        exact = cut(self.forest.wordings.search(asked, "lo", "hi", {"first": "f"}).groupBy("wid").agg(F.min("f").alias("near")))
        fresh = self.forest.signed(wordings.join(exact.hint("merge"), "wid", "left_anti"))
        self.forest.add(fresh)
        near = self.forest.near(fresh, earlier=True).groupBy("wid").agg(F.min("other_first").alias("near")).unionByName(exact)
        titled = works.where("base <> '' and not generic").select("ord", F.xxhash64("base", "marks").alias("wid"))
        titled = titled.join(wordings.select("wid", "first").hint("merge"), "wid").join(near.hint("merge"), "wid", "left")
        known = cut(by_id.unionByName(titled.where("first < ord or near < ord").select("ord")).distinct())
        self.ids.add(ids)
        self.forest.tidy()
        if len(self.ids.live()) > FAN:
            self.ids.merge(_one_identifier, self.ids.live()[1:])
        return known

    def accept(self, batch: DataFrame) -> DataFrame:
        """`batch` with the column known."""
        flag = self.known(batch).select(F.col("ord").alias("__k"), F.lit(True).alias("known"))
        return batch.join(flag.hint("merge"), F.col("cand_id").cast("long") == F.col("__k"), "left").drop("__k").withColumn("known", F.coalesce("known", F.lit(False)))

    def merge(self) -> None:
        """All runs as one."""
        self.forest.merge()
        self.ids.merge(_one_identifier)


def _one_identifier(rows: DataFrame) -> DataFrame:
    return rows.groupBy("vid", "kind", "value").agg(F.min("first").alias("first"), F.min_by("first_base", F.struct("first", "first_base")).alias("first_base"), F.sum("n").alias("n"), F.sum("unlike").alias("unlike"))


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints, in the shared folder of the cluster."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def known_candidates(seen: DataFrame, candidates: DataFrame, folder: str | None = None) -> DataFrame:
    """(cand_id) of the candidates that describe a work of the history or of a candidate with a lesser cand_id.

    The history is taken into a forest, then all candidates that have arrived are accepted at once: within one acceptance
    a row is held against the rows before it, so the result is that of accepting one batch after the other.
    """
    forest = HistoryForest(seen.sparkSession, folder or work_folder(seen.sparkSession, "history"))
    forest.start(seen)
    return forest.known(candidates).select(F.col("ord").alias("cand_id"))
