"""Spellings of one person or one venue, found by merging and matching again.

Every distinct spelling starts as a profile. Profiles that share a blocking key (their name or initials with at most one character
left out) are compared; what matches is merged into a profile with the spellings, given names and
initials of both, and the richer profile enters blocking and comparison again, until nothing merges. A spelling that fits
several profiles (initials only, an acronym) joins one only when no other fits.

Persons match by family name (slips of typing allowed unless both spellings are established), given name (nicknames
and slips resolved) and initials that don't contradict. Venues match word by word, a word by itself, a slip or its beginning.

Defined results: null, empty and blank names belong to nobody; a name equal in all characters is one spelling however
often it occurs; a name without letters stands alone.
"""

from __future__ import annotations

import json
import re
import unicodedata
import uuid
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.titles import edits
from vellum.runtime import cut, ensure_checkpoint_dir, shared_columns

#: A given name stands beside at least this many words, and this part of what the most versatile one stands beside.
GIVEN_LEAST, GIVEN_PART = 5, 20

# Short forms of given names, each line a full form and what it is called.
NICKNAMES = """alexander alex sandy al xander sasha
andrea andie drea
anthony tony ant
agnes aggie nessie
barbara barb babs barbie
benjamin ben benny benji
catherine kate cathy katie kitty cath kathy
charles charlie chuck chas
christopher chris kit topher
daniel dan danny
deborah deb debbie debby
dmitri dima mitya
edward ed eddie ned ted teddy
elena lena
elizabeth liz beth betty betsy eliza lizzie libby bess lisa
felix fee
francesca fran frankie cesca
frederick fred freddie fritz
gabriel gabe gab
gertrude trudy gert gertie
gregory greg gregg
helena nell
henry hank harry hal
hugo hugh
isabella isabel bella izzy
ivan vanya
james jim jimmy jamie
jennifer jen jenny
john jack johnny
jonathan jon jonny nathan
joseph joe joey
judith judy jude
leonard len lenny leo
louisa louise lou lulu
margaret maggie peggy meg greta madge
matthias matt matty
matthew mat
michael mike mick mickey
nicholas nick nico nicky
oliver ollie noll
patricia pat patty trish tricia
philip phil pip
rebecca becky becca
richard rick dick rich ricky
robert bob rob bobby robbie
samuel sam sammy
stephen steve steph stevie
susanna sue susie suzy sanna
theodore theo
thomas tom tommy
victoria vicky tori
walter walt wally
william bill will billy willy liam""".split("\n")
FORMAL = {short: line.split()[0] for line in NICKNAMES for short in line.split()}
VENUE_FUNCTION = frozenset("of the for and in on a an de der des du und et la le & y e".split())


def fold(s: str) -> str:
    """Lower case without accents."""
    s = unicodedata.normalize("NFKD", s).lower()
    return "".join(c for c in s if not unicodedata.combining(c)).replace("ß", "ss").replace("ø", "o").replace("ł", "l").replace("đ", "d")


def _letters(s: str) -> str:
    return "".join(c for c in fold(s) if c.isalpha())


def _initials(s: str) -> str | None:
    """'g' of 'G.', 'gd' of 'G.D.' or 'GD'; None if it is a name."""
    bare = s.replace(".", "").replace("-", "")
    if bare.isalpha() and (("." in s and len(bare) <= 3 and all(len(x) <= 1 for x in re.split(r"[.\-]", s))) or len(bare) == 1):
        return fold(bare)
    return None


def parse_author(name: str, given: dict[str, int] | frozenset) -> tuple[str, str, str]:
    """(family, given name or first initial, further initials), folded. `given`: what is known as a given name."""
    s = re.sub(r"\s+", " ", unicodedata.normalize("NFKC", name)).strip(" .,;")
    if re.search("[㐀-鿿]", s):
        return re.sub(r"\W", "", s), "", ""
    if "," in s:
        family, _, rest = s.partition(",")
        toks = rest.split()
    else:
        t = s.split()
        if len(t) == 1:
            return _letters(s), "", ""
        known = lambda x: _letters(x) in given or _letters(x) in FORMAL
        if t[-1].isupper() and t[-1].isalpha() and len(t[-1]) <= 3 and any(c.islower() for c in "".join(t[:-1])):
            family, toks = " ".join(t[:-1]), list(t[-1])
        elif t[0].isupper() and len(_letters(t[0])) >= 3 and not t[-1].isupper():
            k = 1
            while k < len(t) - 1 and t[k].isupper() and len(_letters(t[k])) >= 3:
                k += 1
            family, toks = " ".join(t[:k]), t[k:]
        elif _initials(t[0]) is not None:
            k = 1
            while k < len(t) - 1 and _initials(t[k]) is not None:
                k += 1
            family, toks = " ".join(t[k:]), t[:k]
        elif known(t[-1]) and not known(t[0]):
            family, toks = t[0], t[1:]
            if len(t) > 2 and _initials(t[1]) is None and not known(t[1]):
                family, toks = " ".join(t[:-1]), t[-1:]
        elif _initials(t[-1]) is not None and len(t) > 2 and known(t[-2]) and not known(t[0]):
            family, toks = " ".join(t[:-2]), t[-2:]
        else:
            k = 1
            while k < len(t) - 1 and _initials(t[k]) is not None:
                k += 1
            family, toks = " ".join(t[k:]), t[:k]
    names: list[str] = []
    for x in toks:
        i = _initials(x)
        names += list(i) if i is not None else [_letters(x)]
    names = [x for x in names if x]
    first = names[0] if names else ""
    first = FORMAL.get(first, first)
    return _letters(family), first, "".join(x[0] for x in names[1:])


def given_names(spellings: DataFrame) -> str:
    """The folder of words that stand beside many different words: given names, a vocabulary of its own that new persons hardly
    widen. The workers read them from the shared folder: none of them passes through the driver, however many there are.
    """
    words = F.filter(F.split(F.lower(F.regexp_replace("name", r"[^\p{L}\s]", " ")), r"\s+"), lambda w: F.length(w) > 2)
    # the position of the word beside it does not matter: pairs of neighbours within one name
    rows = spellings.select(F.array_distinct(words).alias("w")).where(F.size("w") >= 2)
    rows = rows.select("w", F.explode("w").alias("one")).select("one", F.explode("w").alias("other")).where("one <> other")
    beside = cut(rows.groupBy("one").agg(F.countDistinct("other").alias("n")).where(F.col("n") >= GIVEN_LEAST))
    # a family name stands beside the few given names of one family, a given name beside families without number
    top = beside.agg(F.max("n")).first()[0] or 0
    folder = f"{ensure_checkpoint_dir(spellings.sparkSession)}/given-{uuid.uuid4().hex[:12]}"
    beside.where(F.col("n") >= max(GIVEN_LEAST, top // GIVEN_PART)).select("one").write.parquet(folder)
    return folder


@lru_cache(maxsize=2)
def _given(folder: str) -> frozenset[str]:
    """The known given names, folded; a worker reads them once for its tasks."""
    return frozenset(_letters(w) for one, in shared_columns(folder, ["one"]) for w in one.to_pylist()) | frozenset(FORMAL.values())


def nearest_given(first: str, given: frozenset[str]) -> str:
    """The known given name that `first` is a slip of, else itself."""
    if len(first) < 3 or first in given:
        return first
    if len(first) == 3:  # one letter left out of a name of four
        near = {FORMAL.get(x, x) for i in range(4) for c in "abcdefghijklmnopqrstuvwxyz" if (x := first[:i] + c + first[i:]) in given}
        return next(iter(near)) if len(near) == 1 else first
    near = {FORMAL.get(first[:i] + c + first[i + 1 :], first[:i] + c + first[i + 1 :]) for i in range(len(first)) for c in ("", *"abcdefghijklmnopqrstuvwxyz") if first[:i] + c + first[i + 1 :] in given}
    near |= {FORMAL.get(x, x) for i in range(len(first) + 1) for c in "abcdefghijklmnopqrstuvwxyz" if (x := first[:i] + c + first[i:]) in given}
    near |= {FORMAL.get(x, x) for i in range(len(first) - 1) if (x := first[:i] + first[i + 1] + first[i] + first[i + 2 :]) in given}
    return next(iter(near)) if len(near) == 1 else first


def parse_venue(name: str) -> list[str]:
    """Content words of a venue name, folded, and last all its letters; a trailing 'Journal of' comes to the front."""
    s = unicodedata.normalize("NFKC", name).strip()
    m = re.match(r"^(.*),\s*([^,]+?\b(?:of|for|de|der))(?:\s+the)?\s*$", s, re.I)
    if m:
        s = f"{m.group(2)} {m.group(1)}"
    words = re.findall(r"[^\W_]+", fold(s))
    if words[:1] == ["the"]:
        words = words[1:]
    kept = [{"mt": "mountain", "mtn": "mountain"}.get(w, w) for w in words if w not in VENUE_FUNCTION]
    return [*(kept or words), "".join(words)]


def _one_less(s: str) -> set[str]:
    return {s} | {s[:i] + s[i + 1 :] for i in range(len(s))}


def author_keys(profile: dict) -> set[str]:
    out = set()
    for f, g, _ in profile["n"]:
        i = g[:1]
        if len(f) < 4:
            out.add(f"{f}|{i}")
        else:
            out |= {f"{x}|{i}" for x in _one_less(f)}
    return out


def venue_keys(profile: dict) -> set[str]:
    out = set()
    for *words, _ in profile["n"]:
        if len(words) == 1 and 3 <= len(words[0]) <= 6:
            out.add(words[0])  # perhaps an acronym
        letters = "".join(w[0] for w in words)
        out |= _one_less(letters) if len(words) > 1 else {words[0]}
    for *_, flat in profile["n"]:
        out |= {flat} | ({"<" + flat[4:14], ">" + flat[-14:-4]} if len(flat) > 18 else set())
    return out


def _family_like(a: str, b: str) -> bool:
    n = min(len(a), len(b))
    return a == b or n >= 4 and edits(a, b, 1) <= 1 or n >= 11 and edits(a, b, 2) <= 2


def match_authors(p: dict, q: dict, given: frozenset) -> int:
    """0: no; 1: yes; 2: yes unless another profile fits p as well; 3: the same for q."""
    pf, qf = {}, {}
    for f, _, _ in p["n"]:
        pf[f] = pf.get(f, 0) + 1
    for f, _, _ in q["n"]:
        qf[f] = qf.get(f, 0) + 1
    same = pf.keys() & qf.keys()
    if not same:
        # both families established in several spellings are two families
        like = [(a, b) for a in pf for b in qf if _family_like(a, b)]
        if not like or (max(pf.values()) > 1 and max(qf.values()) > 1):
            return 0
    pg, qg = {g for _, g, _ in p["n"] if len(g) > 1}, {g for _, g, _ in q["n"] if len(g) > 1}
    if pg and qg:
        if not pg & qg and not any(edits(a, b, 2) <= (1 if min(len(a), len(b)) < 7 else 2) and min(len(a), len(b)) > 3 and not (a in given and b in given) for a in pg for b in qg):
            return 0
    pi, qi = {g[0] for _, g, _ in p["n"] if g}, {g[0] for _, g, _ in q["n"] if g}
    if pi and qi and not pi & qi and not (pg and qg):
        return 0
    pm, qm = {m for _, _, m in p["n"] if m}, {m for _, _, m in q["n"] if m}
    if pm and qm and not any(a.startswith(b) or b.startswith(a) for a in pm for b in qm):
        return 0
    if (pg and not qg) or (not pi) != (not qi) and pi:
        return 3
    if (qg and not pg) or (not pi) != (not qi) and qi:
        return 2
    if not pg and not qg:
        return 1 if pm and qm or not pm and not qm else (2 if qm else 3)
    if bool(pm) != bool(qm):
        return 2 if qm else 3
    return 1


def _word_like(a: str, b: str) -> bool:
    if a == b:
        return True
    x, y = sorted((a, b), key=len)
    return (len(x) >= 3 or len(x) == 1 and len(y) >= 4) and y.startswith(x) or len(x) >= 4 and edits(x, y, 2) <= (1 if len(x) < 8 else 2)


def match_venues(p: dict, q: dict) -> int:
    worst = 0
    for *a, u in p["n"]:
        for *b, v in q["n"]:
            if len(a) == len(b) and len(a) > 1:
                if all(_word_like(x, y) for x, y in zip(a, b, strict=True)) and sum(edits(x, y, 2) > 0 and not (x.startswith(y) or y.startswith(x)) for x, y in zip(a, b, strict=True)) <= 2:
                    return 1
            if len(a) > 1 and len(b) > 1:
                if min(len(u), len(v)) > 11 and edits(u, v, 2) <= 2 and not (len(a) == len(b) and any(edits(x, y, 2) > 2 for x, y in zip(a, b, strict=True))):
                    return 1
            if len(a) == 1 and len(b) == 1 and len(a[0]) > 5 and edits(a[0], b[0], 1) <= 1:
                return 1
            if len(a) == 1 and len(b) > 2 and a[0] == "".join(x[0] for x in b):
                worst = 2
            if len(b) == 1 and len(a) > 2 and b[0] == "".join(x[0] for x in a):
                worst = 3
    return worst


def group_spellings(spellings: DataFrame) -> DataFrame:
    """(kind, name, grp) of the distinct (kind, name); kind is `author` or `venue`."""
    names = spellings.where("name is not null and trim(name) <> ''").select("kind", "name").distinct()
    names = cut(names)
    folder = given_names(names.where("kind = 'author'"))

    @F.arrow_udf("string")
    def parsed(kinds: pa.Array, texts: pa.Array) -> pa.Array:
        given, out = _given(folder), []
        for k, t in zip(kinds.to_pylist(), texts.to_pylist(), strict=True):
            if k == "author":
                f, g, m = parse_author(t, given)
                out.append(json.dumps([f, nearest_given(g, given), m]))
            else:
                out.append(json.dumps(parse_venue(t)))
        return pa.array(out, pa.string())

    @F.arrow_udf("array<string>")
    def keys(kinds: pa.Array, members: pa.Array) -> pa.Array:
        out = []
        for k, m in zip(kinds.to_pylist(), members.to_pylist(), strict=True):
            p = {"n": [json.loads(x) for x in m]}
            p["n"] = [x for x in p["n"] if x and x[0]]
            out.append(sorted(author_keys(p) if k == "author" else venue_keys(p)))
        return pa.array(out, pa.list_(pa.string()))

    @F.arrow_udf("int")
    def verdict(kinds: pa.Array, left: pa.Array, right: pa.Array) -> pa.Array:
        given, out = _given(folder), []
        for k, a, b in zip(kinds.to_pylist(), left.to_pylist(), right.to_pylist(), strict=True):
            p, q = {"n": [json.loads(x) for x in a]}, {"n": [json.loads(x) for x in b]}
            out.append(match_authors(p, q, given) if k == "author" else match_venues(p, q))
        return pa.array(out, pa.int32())

    state = cut(names.withColumn("parsed", parsed("kind", "name")).withColumn("grp", F.xxhash64("kind", "name")))
    while True:  # every round but the last leaves fewer profiles
        # the same parse in many spellings counts by its number of spellings
        profiles = state.groupBy("kind", "grp").agg(F.collect_list("parsed").alias("members"))
        keyed = cut(profiles.withColumn("keys", keys("kind", "members")))
        k = keyed.select("kind", "grp", "members", F.explode("keys").alias("key"))
        a = k.select("kind", "key", F.col("grp").alias("p"))
        b = k.select("kind", "key", F.col("grp").alias("q"))
        pairs = a.join(b.hint("merge"), ["kind", "key"]).where("p < q").select("kind", "p", "q").distinct()
        left = keyed.select("kind", F.col("grp").alias("p"), F.col("members").alias("pm"))
        right = keyed.select("kind", F.col("grp").alias("q"), F.col("members").alias("qm"))
        judged = cut(pairs.join(left.hint("merge"), ["kind", "p"]).join(right.hint("merge"), ["kind", "q"]).select("kind", "p", "q", verdict("kind", "pm", "qm").alias("v")).where("v > 0"))
        sure = judged.where("v = 1").select("p", "q")
        # a profile that lacks something joins another only if one alone fits; while sure merges remain, it waits
        poor = judged.where("v > 1").select(F.when(F.col("v") == 2, F.col("p")).otherwise(F.col("q")).alias("p"), F.when(F.col("v") == 2, F.col("q")).otherwise(F.col("p")).alias("q"))
        if sure.isEmpty():
            lone = poor.groupBy("p").agg(F.count_distinct("q").alias("n"), F.first("q").alias("q")).where("n = 1").select("p", "q")
            merges = cut(lone)
        else:
            merges = sure
        both = merges.select("p", "q").unionByName(merges.select(F.col("q").alias("p"), F.col("p").alias("q")))
        label = both.groupBy("p").agg(F.min("q").alias("q")).where("q < p")
        label = cut(label)
        if label.isEmpty():
            break
        state = cut(state.join(label.hint("merge"), state["grp"] == label["p"], "left").select("kind", "name", "parsed", F.coalesce("q", "grp").alias("grp")))
    return state.select("kind", "name", "grp")


def variant_pairs(groups: DataFrame) -> DataFrame:
    """(kind, name_a, name_b) of every two spellings of one group."""
    a = groups.select("kind", "grp", F.col("name").alias("name_a"))
    b = groups.select("kind", "grp", F.col("name").alias("name_b"))
    return a.join(b.hint("merge"), ["kind", "grp"]).where("name_a < name_b").select("kind", "name_a", "name_b")


def spellings_of(papers: DataFrame, seen: DataFrame) -> DataFrame:
    """(kind, name): authors cut at the separators and trimmed, and venue names."""
    a = papers.select(F.explode(F.split("authors", "[;；]")).alias("name")).select(F.lit("author").alias("kind"), F.regexp_replace("name", r"(?U)^\s+|\s+$", "").alias("name"))
    v = seen.select(F.lit("venue").alias("kind"), F.col("source").alias("name"))
    return a.unionByName(v).where("name <> ''").distinct()
