"""Titles as works: what of a title names the work, which part or reaction of it, and whether two name the same one."""

from __future__ import annotations

import html
import re
from functools import lru_cache
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Wordings of one work's states, of works of their own, and titles that name no work.
STATES = ["in press", "a preprint", "preprint", "postprint", "accepted manuscript", "author manuscript", "authors manuscript", "extended abstract", "early view", "online first", "working paper", "full text", "english abstract", "英文摘要", "预印本", "录用稿", "网络首发", "优先出版", "中文版", "英文版"]
REACTIONS = {"correction": "correction", "corrigendum": "correction", "erratum": "correction", "comment": "comment", "comments": "comment", "reply": "reply", "response": "reply", "rejoinder": "reply", "continued": "continued", "continuation": "continued", "addendum": "addendum", "retraction": "retraction", "更正": "correction", "勘误": "correction", "评论": "comment", "商榷": "comment", "答复": "reply", "回复": "reply", "续": "continued", "续篇": "continued", "补遗": "addendum"}
LATER = ["a second decade", "a third decade", "second decade", "third decade", "second survey", "third survey", "fourth survey", "a second survey", "a later survey", "later survey", "ten years on", "ten years later", "revisited again", "第二次调查", "再调查", "后续调查", "十年之后", "二次调查"]
GENERIC = {"editorial", "preface", "preface to the special issue", "foreword", "book review", "book reviews", "correction", "corrigendum", "erratum", "comment", "reply", "review", "introduction", "news", "obituary", "announcement", "contents", "index", "in memoriam", "letter to the editor", "conference report", "special issue", "编者按", "前言", "序言", "书评", "更正", "卷首语", "目录", "编后记", "会议报告", "征稿启事"}
GENERIC_BEGINNINGS = ("editorial ", "preface to ", "foreword ", "book review ", "introduction to the special ", "卷首语", "编者按", "书评")
FUNCTION = frozenset("a an the of in on at by for from with using via through across throughout over and to into within during between upon".split())
CJK_SAME = [("演变", "变化"), ("探讨", "研究"), ("观测", "监测"), ("基于", ""), ("以", ""), ("的", ""), ("论", ""), ("浅析", ""), ("分析", "分析"), ("及其", "及"), ("对于", "对")]

_TAG = re.compile(r"</?[A-Za-z][^>]*>")
_ROMAN = {"i": 1, "ii": 2, "iii": 3, "iv": 4, "v": 5, "vi": 6, "vii": 7, "viii": 8, "ix": 9, "x": 10}
_CN = {"一": 1, "二": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9, "十": 10, "上": 1, "下": 2, "中": 2}
_PART = re.compile(r"^(.*\S)[\s:：,，\-–—(（\[]+(?:part|pt|no|number|volume|vol|chapter|study|paper)\.?\s*(\d+|[ivx]+|[a-h])[)）\]]?$")
_TAIL_ROMAN = re.compile(r"^(.*\S)[\s:,(（]+(ii|iii|iv|vi|vii|viii|ix)[)）]?$")
_TAIL_NUMBER = re.compile(r"^(.*[^\W\d_]\)?)\s*[\s,:(（](\d{1,2})[)）]?$")
_CN_PART = re.compile(r"^(.*\S)[\s:：，,\-—(（\[]*第?([一二三四五六七八九十\d]{1,2})(?:部分|篇|报|期)[)）\]]?$|^(.*\S)[(（]([一二三四五六七八九十上中下]{1,2})[)）]$")
# what must be there before one of the patterns is tried, which run over the whole title
_PART_END = re.compile(r"(?:part|pt|no|number|volume|vol|chapter|study|paper)\.?\s*(?:\d+|[ivx]+|[a-h])[)）\]]?$")
_SET_OFF = re.compile(r"[:：，,—]|\s[-–]")
_NOT_WORD = re.compile(r"[\W_]+")
_CJK = re.compile("[㐀-鿿]")
_CLOSING = ")）]】"
_TO = re.compile(r"^(correction|corrigendum|erratum|comment|comments|reply|response|rejoinder|addendum|retraction)s?\s*(?:to|on|for|of)?\s*[:：]?\s+(?:to |on |for |the comment on |comment on )?(.+)$")


def edits(a: str, b: str, most: int) -> int:
    """Edit distance with exchanges of neighbours; `most` + 1 if it is larger."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    a, b = a[n:], b[n:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    if not a or not b:
        return len(a) or len(b)
    before2: list[int] = []
    before = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i] + [most + 1] * len(b)
        lo, hi = max(1, i - most), min(len(b), i + most)
        for j in range(lo, hi + 1):
            y = b[j - 1]
            v = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, before2[j - 2] + 1)
            row[j] = v
        if min(row[lo - 1 : hi + 1]) > most:
            return most + 1
        before2, before = before, row
    return min(before[-1], most + 1)


_WORDINGS = {"state": STATES, "later": LATER, "reaction": REACTIONS}


@lru_cache(1 << 16)
def _near(tail: str, kind: str) -> str | None:
    t, words = tail.strip(), _WORDINGS[kind]
    if t in words:
        return t
    if 5 <= len(t) <= 24 and t.isascii():
        for w in words:
            if len(w) >= 5 and -3 < len(w) - len(t) < 3 and edits(t, w, 2) <= (1 if len(w) < 8 else 2):
                return w
    return None


def _split_tail(t: str) -> tuple[str, str] | None:
    """(front, tail) where a bracket, colon, dash or comma sets the tail off."""
    m = t.rstrip()[-1:] in _CLOSING and re.match(r"^(.*\S)\s*[(（\[【]([^()（）\[\]【】]+)[)）\]】]\s*$", t) or _SET_OFF.search(t) and re.match(r"^(.*\S)\s*(?:[:：]|\s[-–—]|，|,|——)\s*([^:：,，]{1,40})$", t)
    return (m.group(1), m.group(2)) if m else None


def parse(title: str | None) -> tuple[str, str, bool, bool]:
    """(base, marks, generic, cut short) of a title.

    base: words that name the work, lower case, separated by spaces (Chinese: one string); marks: part number,
    reaction, later survey, sorted; generic: names no work.
    """
    if not title:
        return "", "", False, False
    t = unicodedata.normalize("NFKC", html.unescape(_TAG.sub(" ", title) if "<" in title else title)).lower()
    if not t.isascii():
        t = "".join(c for c in t if c < "\xa1" or unicodedata.category(c) != "Cf")
    t = " ".join(t.split())
    while len(t) > 2 and (t[0], t[-1]) in {("[", "]"), ("《", "》"), ("(", ")"), ('"', '"'), ("“", "”"), ("'", "'"), ("「", "」"), ("【", "】"), ("‘", "’")}:
        t = t[1:-1].strip()
    short = t.endswith(("...", "…"))
    t = t.rstrip(" .…。*†‡")
    plain = _NOT_WORD.sub(" ", t).strip()
    if plain in GENERIC or plain.startswith(GENERIC_BEGINNINGS):
        return plain, "", True, False
    marks: list[str] = []
    for _ in range(5):
        end = t[-2:-1] if t[-1:] in _CLOSING else t[-1:]
        m = t[:1] in "cera" and _TO.match(t)
        if m and len(m.group(2)) > 12:
            marks.append(REACTIONS[m.group(1)])
            t = m.group(2)
            continue
        m = _PART_END.search(t, max(0, len(t) - 60)) and _PART.match(t)
        if m:
            n = m.group(2)
            marks.append(f"part {int(n) if n.isdigit() else _ROMAN.get(n, n)}")
            t = m.group(1)
            continue
        m = end in "ivx" and _TAIL_ROMAN.match(t)
        if m:
            marks.append(f"part {_ROMAN[m.group(2)]}")
            t = m.group(1)
            continue
        m = not t.isascii() and _CN_PART.match(t)
        if m:
            front, n = (m.group(1), m.group(2)) if m.group(1) else (m.group(3), m.group(4))
            marks.append(f"part {n if n.isdigit() else _CN.get(n, n)}")
            t = front
            continue
        st = _split_tail(t)
        if not st:
            m = end.isdigit() and _TAIL_NUMBER.match(t)
            if m and len(m.group(1)) > 20:
                marks.append(f"part {int(m.group(2))}")
                t = m.group(1)
                continue
            break
        front, tail = st
        tail = tail.strip(" .)）")
        if _near(tail, "state"):
            t = front
        elif _near(tail, "later"):
            marks.append("later " + _near(tail, "later").removeprefix("a "))
            t = front
        elif _near(tail, "reaction"):
            marks.append(REACTIONS[_near(tail, "reaction")])
            t = front
        elif tail.isdigit() and len(tail) <= 2 and len(front) > 20:
            marks.append(f"part {int(tail)}")
            t = front
        elif tail in ("reply to comment", "reply comment", "reply to the comment"):
            marks += ["comment", "reply"]
            t = front
        else:
            break
        t = t.rstrip(" .:：-–—,，([（【")
    if _CJK.search(t):
        base = _NOT_WORD.sub("", t)
        for a, b in CJK_SAME:
            base = base.replace(a, b)
    else:
        t = t.replace("by means of", "using")
        words = _NOT_WORD.sub(" ", t).split()
        if short and len(words) > 5 and not title.rstrip(" .…")[-1:].isspace():
            words = words[:-1]  # the last word may be cut
        base = " ".join(w for w in words if w not in FUNCTION) or " ".join(words)
    return base, "+".join(sorted(set(marks))), False, short


def same_base(a: str, b: str, cut: bool = False) -> bool:
    """Whether two bases name one work: slips of typing, one word left out, or one of them cut short."""
    if not a or not b:
        return False
    if a == b:
        return True
    wide = a[-1] >= "㐀" or b[-1] >= "㐀" or any("㐀" <= c <= "鿿" for c in a)
    if wide:
        if min(len(a), len(b)) < 6:
            return False
        if edits(a, b, 2) <= (2 if min(len(a), len(b)) >= 10 else 1):
            return True
        x, y = sorted((a, b), key=len)
        return len(x) >= max(8, (0.4 if cut else 0.6) * len(y)) and edits(x, y[: len(x)], 1) <= 1
    x, y = sorted((a, b), key=len)
    if len(x) < 12:
        return edits(x, y, 1) <= 1 and len(x) >= 8
    u, v = x.split(), y.split()
    flat_u, flat_v = "".join(u), "".join(v)
    if edits(flat_u, flat_v, 4) <= (4 if len(flat_u) >= 40 else 2) and _slips(u, v):
        return True
    if len(u) + 1 == len(v) and len(u) >= 4:
        n = len(u)
        front = next((i for i in range(n) if not _typed(u[i], v[i])), n)
        back = next((i for i in range(n) if not _typed(u[n - 1 - i], v[n - i])), n)
        if front + back >= n:
            return True
    # cut short: the shorter one is the beginning of the longer one
    least = max(20, (0.4 if cut else 0.6) * len(flat_v))
    return len(flat_u) >= least and len(flat_u) < len(flat_v) and edits(flat_u, flat_v[: len(flat_u)], 3) <= 3 and _begins(u, v, cut)


def _typed(p: str, q: str) -> bool:
    return p == q or edits(p, q, 2) <= (1 if min(len(p), len(q)) < 8 else 2) and min(len(p), len(q)) > 2


def _slips(u: list[str], v: list[str]) -> bool:
    """Whether words differ by slips only, not by another word in one place."""
    if len(u) != len(v):
        return True  # words run together or apart; the whole is close enough
    return all(p == q or edits(p, q, 2) <= 2 and (min(len(p), len(q)) > 3 or edits(p, q, 1) <= 1) and not (p.isdigit() and q.isdigit()) for p, q in zip(u, v, strict=True))


def _begins(u: list[str], v: list[str], cut: bool) -> bool:
    n = len(u)
    if n > len(v):
        return False
    if not all(_typed(p, q) for p, q in zip(u[:-1], v[: n - 1], strict=True)):
        return False
    last, full = u[-1], v[n - 1]
    return _typed(last, full) or full.startswith(last)


def title_parts(title: Column) -> Column:
    """struct<base, marks, generic, short> of each title; null for null."""

    @F.arrow_udf("struct<base:string,marks:string,generic:boolean,short:boolean>")
    def parts(titles: pa.Array) -> pa.Array:
        rows = [parse(t) for t in titles.to_pylist()]
        cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
        return pa.StructArray.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.bool_()), pa.array(cols[3], pa.bool_())], names=["base", "marks", "generic", "short"])

    return parts(title)


def same_work(a: Column, b: Column, cut: Column) -> Column:
    @F.arrow_udf("boolean")
    def same(x: pa.Array, y: pa.Array, z: pa.Array) -> pa.Array:
        return pa.array([same_base(p or "", q or "", bool(r)) for p, q, r in zip(x.to_pylist(), y.to_pylist(), z.to_pylist(), strict=True)], pa.bool_())

    return same(a, b, cut)
