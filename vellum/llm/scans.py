"""Repair of text from scanned pages: page furniture, divided words, wrongly recognised characters.

1. One pass counts words, hyphenated compounds and Chinese three-character windows of all texts, by language.
   Only what makes up a fixed share of its kind counts as frequent, so the frequent lists have a bound that
   does not depend on the data's size (at most 1 / FREQUENT_SHARE entries a kind).
2. Corrections are found in SQL. Every string has an anagram hash, the sum of a power of its code points; a
   confusion such as "rn" for "m" changes it by a fixed difference. Frequent strings plus differences are joined
   with the hashes of all others; the replacement is then spelt out and compared, and candidates are ranked by
   how much more frequent the right form is.
3. A second pass reads the layout of each text: page numbers and running headers at page edges, divided words
   (decided by whether the joined or the hyphenated form is evidenced), and words that have a correction.

Defined results: null and empty texts have no lines of any kind and are returned as they are; texts that aren't
broken into short lines are left alone; blank lines have no kind; line numbers count `\\n` only, other line ends
stay part of their line. Copies of a row give the same rows again.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.runtime import cut

#: Share of its kind from which a string is frequent, and the least count in small corpora.
FREQUENT_SHARE, FREQUENT_LEAST = 1e-5, 8
#: How many times as frequent as the misread form the right form must be.
RATIO = 20
#: Characters up to which a line is short.
SHORT_LINE = 130
#: Distinct strings a worker counts before it passes them on.
COUNTER_LIMIT = 400_000

# What is printed, and what recognition takes it for.
LATIN_CONFUSIONS = [("e", "c"), ("c", "e"), ("a", "o"), ("o", "a"), ("t", "f"), ("f", "t"), ("n", "ii"), ("i", "l"), ("l", "i"), ("d", "cl"), ("cl", "d"), ("g", "q"), ("q", "g"), ("u", "ii"), ("in", "m"), ("ni", "m"), ("h", "b"), ("b", "h"), ("m", "rn"), ("rn", "m"), ("m", "nn"), ("ti", "n"), ("li", "h"), ("w", "vv"), ("ri", "n"), ("il", "h"), ("s", "5"), ("o", "0"), ("l", "1"), ("i", "1"), ("b", "6"), ("z", "2"), ("g", "9"), ("y", "v"), ("u", "v"), ("k", "lc")]
CJK_ALIKE = "析折 土士 间问 由田 研硏 坡披 方万 已己 己巳 已巳 据椐 平乎 入人 人八 显昰 天夭 雨两 果杲 未末 被彼 模摸 比此 样祥 日曰 日目 下卜 差羌 采釆 著箸 补扑 测侧 调凋 大太 大犬 太犬 干千 干于 千于 王玉 王主 玉主 木本 木术 本术 甲由 甲申 由申 田申 令今 今令 刀力 九丸 几儿 兔免 免兔 午牛 矢失 失先 代伐 候侯 戊戌 戍戌 治冶 洒酒 拔拨 折拆 析拆 住往 往佳 住佳 仪议 沙砂 晴睛 清消 清情 渚诸 流硫 侵浸 状壮 材村 村材 杆秆 栽裁 栽载 裁载 温湿 渔鱼 准淮 难准 贷货 货贷 贪贫 己乙 茶荼 末来 米来 免兔 母毋 辩辨 遣遗 徒徙 崇祟 瓜爪 矛予 名各 各备 季李 季委 含舍 冷泠 壁璧 坚竖 陪倍 读续 域城 场扬 地池 坝坎 岭峰 峁卯"
PAGE_DIGIT = r"[0-9lIOoSBZ|]"
HEADINGS = {"abstract", "introduction", "study area", "data", "data and methods", "method", "methods", "results", "discussion", "conclusion", "conclusions", "references", "摘要", "引言", "研究区", "研究区概况", "数据", "方法", "结果", "讨论", "结论", "参考文献"}
STOPS = {
    "en": frozenset("the of and to in with by for from is was are were that which at".split()),
    "de": frozenset("der die das und ist im mit nach auf von den dem zeigen wurden".split()),
    "fr": frozenset("le les des du et une dans la sur par est aux montrent avec".split()),
    "es": frozenset("el los las del y una se en la por con que fue año".split()),
    "pt": frozenset("o os das dos do da e uma em na no não com ao foi".split()),
}

_WORD = re.compile(r"[^\W\d_]+")
_CHUNK = re.compile(r"[A-Za-z0-9À-ÖØ-öø-ÿŠšŽžŘřČčĚěŐő]+")
_HYPHENED = re.compile(r"\b[^\W\d_]+(?:-[^\W\d_]+)+")
_DIVIDED = re.compile(r"[-‐\xad¬] ?\n\s*")
_CJK = re.compile(r"[㐀-鿿#，。、％%：；]+")
_DIGITS = re.compile(r"[0-9]+")
_PAGE = re.compile(
    rf"(?:(?P<dash>[-—–]\s?{PAGE_DIGIT}{{1,4}}\s?[-—–])|(?P<brack>\[{PAGE_DIGIT}{{1,4}}\])|(?P<of>{PAGE_DIGIT}{{1,4}} ?/ ?{PAGE_DIGIT}{{1,4}})|(?P<page>[Pp][aoe][gq9][ec]\.? {PAGE_DIGIT}{{1,4}})|(?P<zh>第 ?{PAGE_DIGIT}{{1,4}} ?[页頁])|(?P<dot>[·•]{PAGE_DIGIT}{{1,4}}[·•])|(?P<bare>{PAGE_DIGIT}{{1,4}}))"
)
_ETAL = re.compile(r"[^\s.,;]+ [ec][tfl] [ao][l1Ii]\.?(?: /.*)?(?:\s{2,}\S{1,4})?")
_TAIL_NUMBER = re.compile(rf"\s{{2,}}{PAGE_DIGIT}{{1,4}}$")
_END_MARK = re.compile(r"([^\W_]+)(- ?|[‐\xad¬] ?)$")
_BEGIN = re.compile(r"[^\W_]+")
_NUMBER_MISREAD = re.compile(r"(?=[0-9lOIo]*[0-9])(?=[0-9lOIo]*[lOIo])[0-9lOIo]{2,}")
_FOLD = str.maketrans({"0": "o", "1": "l", "i": "l", "|": "l", "5": "s", "c": "e", "f": "t", "q": "g", "b": "h", "a": "o"})


def language_of(words: list[str]) -> str:
    best, most = "und", 0
    for lang, stops in STOPS.items():
        n = sum(w in stops for w in words)
        if n > most:
            best, most = lang, n
    return best


def without_divided(text: str) -> str:
    """The text without its words that go on in the next line, so that their halves aren't counted as words."""
    parts, at = [], 0
    for m in _DIVIDED.finditer(text):
        a, b = m.start(), m.end()
        while a > at and text[a - 1].isalnum():
            a -= 1
        while b < len(text) and text[b].isalnum():
            b += 1
        parts.append(text[at:a])
        at = max(at, b)
    return " ".join([*parts, text[at:]])


def windows(text: str) -> Iterator[str]:
    """Three-character windows of Chinese runs; line ends are passed over, numbers count as one sign."""
    for run in _CJK.findall(_DIGITS.sub("#", text.replace("\n", ""))):
        for i in range(len(run) - 2):
            yield run[i : i + 3]


def count_strings(texts: DataFrame) -> DataFrame:
    """(kind, token, n): words `w:lang`, compounds `h`, Chinese windows `z` of the column text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[tuple[str, str]] = Counter()

        def flush() -> pa.RecordBatch:
            keys = list(seen)
            out = pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys], pa.string()), pa.array([t for _, t in keys], pa.string()), pa.array([seen[k] for k in keys], pa.int64())], names=["kind", "token", "n"])
            seen.clear()
            return out

        for batch in batches:
            by_lang: dict[str, Counter[str]] = {}
            compounds: Counter[str] = Counter()
            runs: Counter[str] = Counter()
            for t in batch.column(0).to_pylist():
                if not t:
                    continue
                flat = without_divided(t).lower()
                words = _CHUNK.findall(flat)
                by_lang.setdefault(language_of(words), Counter()).update(words)
                if "-" in flat:
                    compounds.update(_HYPHENED.findall(flat))
                if not t.isascii():
                    runs.update(windows(t))
            for lang, c in by_lang.items():
                for w, n in c.items():
                    seen["w:" + lang, w] += n
            for w, n in compounds.items():
                seen["h", w] += n
            for w, n in runs.items():
                seen["z", w] += n
            if len(seen) > COUNTER_LIMIT:
                yield flush()
        if seen:
            yield flush()

    counted = texts.select("text").mapInArrow(count, "kind string, token string, n long")
    return counted.groupBy("kind", "token").agg(F.sum("n").alias("n"))


def anagram_hash(token, power: int):
    """Sum of the code points to `power`: the same for every order of the same characters."""
    return F.aggregate(F.filter(F.split(token, ""), lambda c: c != ""), F.lit(0).cast("long"), lambda acc, c: acc + F.pow(F.ascii(c).cast("double"), F.lit(float(power))).cast("long"))


def _code_sum(s: str, power: int) -> int:
    return sum(int(float(ord(c)) ** power) for c in s)


def confusion_rows() -> list[tuple[str, str, str]]:
    """(kind, right, wrong) of all confusions, Chinese ones in both directions."""
    rows = [("w", a, b) for a, b in LATIN_CONFUSIONS]
    for a, b in dict.fromkeys(tuple(p) for p in CJK_ALIKE.split()):
        rows += [("z", a, b), ("z", b, a)]
    return list(dict.fromkeys(rows))


def corrections(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(frequent strings, corrections): (kind, token, n) and (kind, wrong, right)."""
    spark = counts.sparkSession
    share = counts.groupBy("kind").agg((F.sum("n") * FREQUENT_SHARE).alias("least"))
    # a handful of kinds
    frequent = counts.join(F.broadcast(share), "kind").where((F.col("n") >= F.col("least")) & (F.col("n") >= FREQUENT_LEAST)).select("kind", "token", "n")
    power = lambda k: 3 if k == "z" else 5
    diffs = spark.createDataFrame([(k, a, b, _code_sum(b, power(k)) - _code_sum(a, power(k))) for k, a, b in confusion_rows()], "class string, right string, wrong string, diff long")
    cls = F.substring("kind", 1, 1)
    hashed = lambda df: df.where("kind <> 'h'").withColumn("hash", F.when(cls == "z", anagram_hash(F.col("token"), 3)).otherwise(anagram_hash(F.col("token"), 5)))
    right = hashed(frequent).select("kind", F.col("token").alias("right_token"), F.col("n").alias("right_n"), F.col("hash").alias("right_hash"), cls.alias("class"))
    right = right.join(F.broadcast(diffs), "class").where(F.expr("contains(right_token, right)"))
    right = right.withColumn("hash", F.col("right_hash") + F.col("diff"))
    wrong = hashed(counts).select("kind", F.col("token").alias("wrong_token"), F.col("n").alias("wrong_n"), "hash")
    pairs = wrong.join(right, ["kind", "hash"]).where(F.col("right_n") >= RATIO * F.col("wrong_n"))
    spelt = F.expr("exists(sequence(1, length(right_token)), i -> substring(right_token, i, length(right)) = right and concat(substring(right_token, 1, i - 1), wrong, substring(right_token, i + length(right))) = wrong_token)")
    pairs = pairs.where(spelt)
    best = pairs.groupBy("kind", "wrong_token").agg(F.max(F.struct("right_n", F.col("right_token"))).alias("b"))
    return frequent, best.select("kind", F.col("wrong_token").alias("wrong"), F.col("b.right_token").alias("right"))


class Lexicon:
    """Frequent strings and corrections as a worker uses them."""

    def __init__(self, frequent: list, fixes: list):
        self.words: dict[str, dict[str, int]] = {}
        self.compounds: dict[str, int] = {}
        self.fixes: dict[str, dict[str, str]] = {}
        self.runs: dict[str, str] = {}
        for kind, token, n in frequent:
            if kind == "h":
                self.compounds[token] = n
            elif kind != "z":
                self.words.setdefault(kind[2:], {})[token] = n
        for kind, wrong, right in fixes:
            if kind == "z":
                self.runs[wrong] = right
            else:
                self.fixes.setdefault(kind[2:], {})[wrong] = right
        self.run_chars = frozenset(w[i] for w, r in self.runs.items() for i in range(3) if w[i] != r[i])


def _fold(s: str) -> str:
    return "".join(c for c in s.lower().translate(_FOLD) if c.isalnum())


def _alike(a: str, b: str) -> bool:
    """Whether one folded line is the other or its beginning, a few misread characters aside."""
    n = min(len(a), len(b))
    if n < 5:
        return False
    wrong = sum(x != y for x, y in zip(a, b, strict=False))
    return wrong <= n // 8


def furniture(lines: list[str]) -> dict[int, str]:
    """Line number -> `page` or `header`."""
    out: dict[int, str] = {}
    bare = []
    for i, line in enumerate(lines):
        s = line.strip()
        if not s or len(s) > 16:
            continue
        m = _PAGE.fullmatch(s)
        if m and any(c.isdigit() for c in s):
            if m.lastgroup == "bare":
                bare.append(i)
            else:
                out[i] = "page"
    # plain numbers: few among the lines, or else the rows of a table
    if len(bare) <= max(2, len(lines) // 10):
        out.update(dict.fromkeys(bare, "page"))

    first = next((i for i, x in enumerate(lines) if x.strip()), None)
    edges = {i + 1 for i in out if i + 1 < len(lines)} | ({first} if first is not None else set())
    keys: list[str] = []
    weak = []
    widths = sorted(len(x) for i, x in enumerate(lines) if x.strip() and i not in out)
    width = widths[int(len(widths) * 0.9)] if widths else 0
    for i, line in enumerate(lines):
        s = line.strip()
        if not s or i in out:
            continue
        body = _TAIL_NUMBER.sub("", s)
        if line.startswith("\x0c") or _ETAL.fullmatch(s) or (body != s and body[-1:] not in ".。" and len(s) <= width + 12):
            out[i] = "header"
        elif i in edges and s.isupper() and len(s) >= 8 and sum(c.isalpha() for c in s) * 2 > len(s):
            out[i] = "header"
        elif i in edges:
            weak.append(i)
            continue
        else:
            continue
        keys.append(_fold(body.split(" / ", 1)[-1]))
        if " / " not in body:
            keys.append(_fold(body))
    for i in weak:
        s = lines[i].strip()
        key = _fold(s)
        if any(_alike(key, k) for k in keys if len(k) >= 8):
            out[i] = "header"
        elif s.lower() not in HEADINGS and i + 1 < len(lines) and lines[i + 1].strip() and _stands_alone(lines[i], lines[i + 1], width):
            out[i] = "header"
        else:
            continue
        keys.append(key)
    whole = [k for k in keys if len(k) >= 10]
    if whole:
        for i, line in enumerate(lines):
            s = line.strip()
            if i not in out and s and len(s) <= width and s[-1] not in ".。，,;；" and s.lower() not in HEADINGS:
                key = _fold(_TAIL_NUMBER.sub("", s).split(" / ", 1)[-1])
                if len(key) >= 10 and any(abs(len(key) - len(k)) <= 2 and _alike(key, k) for k in whole):
                    out[i] = "header"
    return out


def _stands_alone(line: str, after: str, width: int) -> bool:
    """Whether a line at a page edge ends before the margin although its sentence doesn't: a title of its own."""
    s = line.strip()
    if s[-1] in ".。，,;；：:!?！？、-‐\xad¬…":
        return False
    wide = sum("㐀" <= c <= "鿿" for c in s) * 2 > len(s)
    if wide:
        return 8 <= len(s) <= width - 2 and "。" not in s and "，" not in s
    word = after.split()[0]
    if not s[:1].isupper() or len(s.split()) < 3 or ". " in s:
        return False
    return len(s) + 1 + len(word) <= width - 1


def wrapped(lines: list[str]) -> bool:
    """Whether a text is broken into the short lines of a printed page: they hold at least half of it."""
    sizes = [len(x) for x in lines if x.strip()]
    return len(sizes) >= 2 and sum(sizes) >= 60 and 2 * sum(n for n in sizes if n <= SHORT_LINE) >= sum(sizes)


def examine(text: str, lex: Lexicon, repair: bool):
    """(list of (line_no, kind), repaired text or None) of one text."""
    lines = text.split("\n")
    if not wrapped(lines):
        return [], text
    found: list[tuple[int, str]] = []
    edge = furniture(lines)
    found += [(i, "furniture") for i in edge]
    lang = language_of(_CHUNK.findall(text.lower()))
    words, fixes = lex.words.get(lang, {}), lex.fixes.get(lang, {})
    proper = [i for i in range(len(lines)) if i not in edge and lines[i].strip()]
    tails: dict[int, tuple[int, str, str]] = {}  # line -> (next line, fragment, rest)
    heads: set[int] = set()
    misread: dict[int, dict[str, str]] = {}

    for i, j in zip(proper, proper[1:], strict=False):
        m = _END_MARK.search(lines[i])
        b = m and _BEGIN.match(lines[j].lstrip())
        if not b or (j > i + 1 and not any(k in edge for k in range(i + 1, j))):
            continue
        a, mark, rest = m.group(1), m.group(2).strip(), b.group()
        if not rest[0].islower() and not (rest[0].isdigit() and a[-1:].islower()) or a[-1:].isdigit() and len(a) == 1:
            continue
        if mark == "-":
            joined, twain = (a + rest).lower(), f"{a}-{rest}".lower()
            fixed = fixes.get(joined)
            n, h = max(words.get(joined, 0), words.get(fixed, 0) if fixed else 0), lex.compounds.get(twain, 0)
            if n or h:
                divided = n > h
            else:
                divided = not (len(a) > 2 and len(rest) > 2 and _known(a.lower(), words, fixes) and _known(rest.lower(), words, fixes))
        else:
            divided = True
        if divided:
            tails[i] = (j, a, rest)
            heads.add(j)
            found.append((i, "broken"))

    def wrong(chunk: str, before: str, after: str) -> str | None:
        if _odd(before) or _odd(after):
            return None  # beside characters of another fault
        low = chunk.lower()
        if low in fixes:
            return fixes[low]
        if words.get(low, 0):
            return None
        if _NUMBER_MISREAD.fullmatch(chunk):
            return chunk.translate(str.maketrans("lIOo", "1100"))
        if chunk in ("l", "ll", "lO", "Ol", "lll", "llO") and lang not in ("fr",) and before not in "'’" and after not in "'’":
            return chunk.translate(str.maketrans("lIOo", "1100"))
        if chunk[0].isalpha() and sum(c.isalpha() for c in chunk) >= 3 and any(c.isdigit() for c in chunk):
            for table in ("0o1l5s6b9g2z", "0o1i5s6b9g2z"):
                t = low.translate(str.maketrans(table[::2], table[1::2]))
                if t.isalpha():
                    return t if words.get(t) or not words else t
        return None

    for i in proper:
        line = lines[i]
        skip_tail = tails.get(i)
        chunks = list(_CHUNK.finditer(line))
        for at, m in enumerate(chunks):
            chunk = m.group()
            if at == len(chunks) - 1 and skip_tail and chunk == skip_tail[1]:
                whole = skip_tail[1] + skip_tail[2]
                right = wrong(whole, " ", " ")
                if right:
                    low = skip_tail[1].lower()
                    at_line = skip_tail[0] if right.startswith(low) else i
                    misread.setdefault(at_line, {})[whole] = right
                continue
            if at == 0 and i in heads:
                continue
            right = wrong(chunk, line[m.start() - 1] if m.start() else " ", line[m.end()] if m.end() < len(line) else " ")
            if right:
                misread.setdefault(i, {})[chunk] = right

    if lex.runs and not text.isascii():
        for i, c, right in _wrong_runs(lines, proper, lex):
            misread.setdefault(i, {})[c] = right
    found += [(i, "misread") for i in misread]
    return found, (_rebuilt(lines, proper, tails, misread) if repair else None)


def _odd(c: str) -> bool:
    return c > "\x7f" and not c.isalnum() and c not in "’‘“”«»—–…·°，。、；：（）％"


def _known(w: str, words: dict, fixes: dict) -> bool:
    return w in words or w in fixes


def _wrong_runs(lines: list[str], proper: list[int], lex: Lexicon):
    """(line, character in context, right character) of misread Chinese characters."""
    signs: list[str] = []
    where: list[int] = []
    for i in proper:
        prev = ""
        for c in lines[i]:
            if c.isdigit() and c.isascii():
                if signs and signs[-1] == "#" and (prev == "#" or where[-1] != i):
                    prev = "#"
                    continue
                signs.append("#")
                prev = "#"
            elif c == " " or c == "\x0c":
                continue
            else:
                signs.append(c)
                prev = c
            where.append(i)
    runs = lex.runs
    for p, c in enumerate(signs):
        if c not in lex.run_chars:
            continue
        for k in (1, 0, 2):  # the character in the middle, at the front, at the end of the window
            lo = p - k
            if lo < 0 or lo + 3 > len(signs):
                continue
            w = signs[lo] + signs[lo + 1] + signs[lo + 2]
            right = runs.get(w)
            if right and right[k] != c:
                yield where[p], c + "\0" + w, right[k]
                break


def _rebuilt(lines, proper, tails, misread) -> str:
    """Continuous paragraphs: a blank line divides them; lines of one paragraph are joined."""
    paragraphs: list[str] = []
    current = ""
    joined_next = False
    last = None
    keep = set(proper)
    blank = False
    for i, line in enumerate(lines):
        if i not in keep:
            blank = blank or not line.strip()
            continue
        s = line.strip()
        for w, right in misread.get(i, {}).items():
            if "\0" in w:
                s = s.replace(w[0], right)
            else:
                s = re.sub(rf"(?<![^\W_]){re.escape(w)}(?![^\W_])", right.capitalize() if w[:1].isupper() else right, s)
        furniture_between = last is not None and any(k not in keep and lines[k].strip() for k in range(last + 1, i))
        if current and blank and not joined_next and not (furniture_between and current[-1] not in ".。!?！？…"):
            paragraphs.append(current)
            current = ""
        if not current:
            current = s
        elif joined_next:
            current += s
        else:
            gap = "" if current[-1] >= "⺀" or s[:1] >= "⺀" else " "
            current += s if current.endswith("-") else gap + s
        joined_next = i in tails
        if joined_next:
            current = re.sub(r"[-‐\xad¬]\s*$", "", current)
            a, rest = tails[i][1], tails[i][2]
            fix = misread.get(i, {}).get(a + rest) or misread.get(tails[i][0], {}).get(a + rest)
            if fix and len(fix) > len(a):
                current = current[: len(current) - len(a)] + fix[: len(a)]
                j = tails[i][0]
                t = lines[j].lstrip()
                lines = [*lines[:j], fix[len(a) :] + t[len(rest) :], *lines[j + 1 :]]
        blank, last = False, i
    if current:
        paragraphs.append(current)
    return unicodedata.normalize("NFC", "\n\n".join(paragraphs))


def lexicon_of(texts: DataFrame) -> Lexicon:
    """Counted over all texts. What comes to the driver is bounded: at most 1 / FREQUENT_SHARE strings of each of eight kinds, and
    their corrections, which are single replacements inside those strings."""
    counts = cut(count_strings(texts))
    frequent, fixes = corrections(counts)
    return Lexicon([tuple(r) for r in frequent.collect()], [tuple(r) for r in fixes.collect()])


def scan_lines(results: DataFrame) -> DataFrame:
    """(result_id, line_no, kind) of every text of `results` (result_id, text, ...)."""
    lex = results.sparkSession.sparkContext.broadcast(lexicon_of(results.select("text")))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, no, kinds = [], [], []
            for rid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if text:
                    for i, kind in examine(text, lex.value, False)[0]:
                        ids.append(rid)
                        no.append(i)
                        kinds.append(kind)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(no, pa.int64()), pa.array(kinds, pa.string())], names=["result_id", "line_no", "kind"])

    # texts whose short lines cannot hold half of them
    short = F.length(F.regexp_replace("text", r"\s+", " ")) <= 2 * (SHORT_LINE + 1) * (1 + F.regexp_count("text", F.lit("\n")))
    return results.select(F.col("result_id").cast("long").alias("result_id"), "text").where(short).mapInArrow(find, "result_id long, line_no long, kind string")


def repaired_texts(results: DataFrame) -> DataFrame:
    """(result_id, repaired) of every row; texts without short lines come back unchanged."""
    lex = results.sparkSession.sparkContext.broadcast(lexicon_of(results.select("text")))

    @F.arrow_udf("string")
    def repaired(texts: pa.Array) -> pa.Array:
        return pa.array([examine(t, lex.value, True)[1] if t else t for t in texts.to_pylist()], pa.string())

    return results.select("result_id", repaired("text").alias("repaired"))
