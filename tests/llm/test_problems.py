"""The operators for training data: edges, round trips, brute force."""

import os
import random
import unicodedata

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vellum.llm import abuse, encoding, history, linkage, lookalike, mixing, names, scans, splitting, titles, tokens

HAVE_TOKENIZERS = os.path.isdir(tokens.TOKENIZER_DIR)


# 1. splitting


def pieces(spark, texts, limit, overlap):
    df = spark.createDataFrame([(i, t, limit, overlap, "x") for i, t in enumerate(texts)], "id int, text string, max_chars int, overlap_chars int, piece string")
    out = {}
    for r in splitting.split_items(df.drop("piece"), ["id"]).orderBy("id", "piece_no").collect():
        out.setdefault(r["id"], []).append(r)
    return out


def test_pieces_restore_the_text(spark):
    rng = random.Random(3)
    words = ["soil", "water,", "end.", "ok;", "坡度。", "沟谷，", "x" * 50, "\n\n", "\n", "é", "\U0001f468‍\U0001f469"]
    texts = ["", None, "short", " " * 300, "a" * 1000, "。" * 500] + [" ".join(rng.choice(words) for _ in range(rng.randint(1, 200))) for _ in range(30)]
    for limit, overlap in ((100, 10), (61, 60), (100, 0)):
        for i, ps in pieces(spark, texts, limit, overlap).items():
            t = texts[i]
            if t is None or len(t) <= limit:
                assert len(ps) == 1 and ps[0]["piece"] == t
                continue
            at = 0
            for k, p in enumerate(ps):
                assert len(p["piece"]) <= limit and p["piece"] == t[p["start_char"] : p["end_char"]]
                assert p["start_char"] == (0 if k == 0 else at - overlap) and p["end_char"] > at or k == 0
                at = p["end_char"]
            assert at == len(t)


def test_strongest_rightmost_cut(spark):
    t = "One sentence here. Another one, with a comma. And a third sentence without end " + "y" * 80
    first = pieces(spark, [t], 60, 5)[0][0]
    assert first["piece"].endswith("comma. ") and first["boundary"] == "sentence"


def test_range_max_equals_brute_force():
    import numpy as np

    rng = np.random.default_rng(1)
    s = rng.integers(0, 8, 500).astype("int8")
    table = splitting.RangeMax(s, 64)
    lo = rng.integers(0, 430, 200)
    hi = lo + rng.integers(0, 64, 200)
    p, at = table.query(lo, hi)
    for a, b, x, y in zip(lo, hi, p, at, strict=True):
        assert x == s[a : b + 1].max() and y == max(i for i in range(a, b + 1) if s[i] == x)


def test_limits_fall_back_to_the_row_without_lang(spark):
    items = spark.createDataFrame([("sections", "en"), ("sections", "fr"), ("sections", None), ("other", "en")], "field string, lang string")
    limits = spark.createDataFrame([("sections", "en", 10, 1), ("sections", None, 20, 2)], "field string, lang string, max_chars long, overlap_chars long")
    assert sorted((r["lang"] or "", r["max_chars"] or 0) for r in splitting.limits_of(items, limits).where("field = 'sections'").collect()) == [("", 20), ("en", 10), ("fr", 20)]
    assert splitting.limits_of(items, limits).where("field = 'other'").first()["max_chars"] is None


# 2. history, titles


@pytest.mark.parametrize("a,b,same", [
    ("Mapping soil loss in the Vimapoltor Badlands with Bayesian change detection", "Mapping soil loss in the Sezazosa Badlands with Bayesian change detection", False),
    ("On te limits of object-basde image analysis for loess collapse (Nodedelyar Valley)", "On the limits of object-based image analysis for loess collapse (Nodedelyar Valley)", True),
    ("Some long study of gullies in the Upper Basin: Part II", "Some long study of gullies in the Upper Basin", False),
    ("Some long study of gullies in the Upper Basin, accepted manuscript", "Some long study of gullies in the Upper Basin", True),
    ("Some long study of gullies in the Upper Basin: correction", "Some long study of gullies in the Upper Basin", False),
    ("基于模糊叠加的渡露碧岗台地裂点间距研究（续）", "基于模糊叠加的渡露碧岗台地裂点间距研究", False),
    ("以模糊叠加的渡露碧岗台地裂点间距研究", "基于模糊叠加的渡露碧岗台地裂点间距研究", True),
    ("Editorial", "Editorial", False), ("", "", False),
])
def test_same_work(a, b, same):
    p, q = titles.parse(a), titles.parse(b)
    assert (p[1] == q[1] and not p[2] and titles.same_base(p[0], q[0], p[3] or q[3])) == same


def test_edit_distance_equals_table():
    def full(a, b):
        d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
        return d[-1][-1]

    rng = random.Random(2)
    for _ in range(2000):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 7))) for _ in range(2))
        for most in (1, 2, 4):
            assert titles.edits(a, b, most) == min(full(a, b), most + 1), (a, b, most)


SEEN = [("p1", "Mapping soil loss in the Vimapoltor Badlands with drones", "10.5555/a.1", None), ("p2", "Editorial", "10.5555/e.1", None), ("p3", None, "N/A", "2401.00001"), ("p4", "Snow cover duration across the Kelo Ridge: evidence from radar", "10.5555/pending", None), ("p5", "", None, "")]
CANDS = [(1, "c1", "Mapping soil loss in the Vimapoltor Badlands wih drones", None, None), (2, "c2", "Editorial", "10.5555/e.2", None), (3, "c3", "Unrelated title about rivers of the plain", "https://doi.org/10.5555/A.1", None), (4, "c4", "New one", None, "arXiv:2401.00001v3"), (5, "c5", "A fresh study of dunes in the Pelo Basin with lidar", "10.5555/pending", None), (6, "c6", "A fresh study of dunes in the Pelo Basin with lidar: Part II", None, None), (7, "c7", "A FRESH STUDY OF DUNES IN THE PELO BASIN WITH LIDAR", None, None), (8, None, None, None, None), (9, "c1", "quite another wording", None, None)]


def test_known_candidates(spark):
    seen = spark.createDataFrame(SEEN, "paper_id string, title string, doi string, arxiv_id string")
    cands = spark.createDataFrame(CANDS, "cand_id long, paper_id string, title string, doi string, arxiv_id string")
    assert sorted(r["cand_id"] for r in history.known_candidates(seen, cands).collect()) == [1, 4, 7, 9]
    assert history.known_candidates(seen.limit(0), cands.limit(0)).count() == 0


def test_forest_takes_batches(spark, tmp_path):
    seen = spark.createDataFrame(SEEN, "paper_id string, title string, doi string, arxiv_id string")
    cands = spark.createDataFrame(CANDS, "cand_id long, paper_id string, title string, doi string, arxiv_id string")
    f = history.HistoryForest(spark, str(tmp_path))
    f.start(seen)
    first = {r["cand_id"]: r["known"] for r in f.accept(cands.where("cand_id <= 5")).collect()}
    assert first == {1: True, 2: False, 3: False, 4: True, 5: False}
    second = {r["cand_id"]: r["known"] for r in f.accept(cands.where("cand_id in (6, 7)")).collect()}
    assert second == {6: False, 7: True}
    assert len(f.forest.entries.live()) == 3
    f.merge()
    assert [len(x.live()) for x in (f.forest.entries, f.forest.wordings, f.ids)] == [1, 1, 1]
    # readers see the merged run
    third = {r["cand_id"]: r["known"] for r in f.accept(cands.where("cand_id in (8, 9)")).collect()}
    assert third == {8: False, 9: True}
    again = cands.select((F.col("cand_id") + 100).alias("cand_id"), "paper_id", "title", "doi", "arxiv_id")
    assert sorted(r["cand_id"] for r in f.accept(again).where("known").collect()) == [101, 102, 103, 104, 105, 106, 107, 109]


def test_batches_and_all_at_once_agree(spark, tmp_path):
    rng = random.Random(11)
    places = ["Karo", "Velo", "Pelotari", "Dunesi", "Vimapoltor"]
    title = lambda: f"{rng.choice(['Soil loss', 'Snow cover', 'Gully growth'])} in the {rng.choice(places)} {rng.choice(['Basin', 'Hills'])} from {rng.choice(['radar images', 'drone surveys', 'old maps'])}"
    slip = lambda t: t[: (k := rng.randrange(len(t)))] + t[k + 1 :]
    seen = [(f"s{i}", title(), f"10.5555/a.{i}" if i % 3 else None, None) for i in range(40)]
    cands = [(i, f"c{i}", slip(title()) if i % 2 else title(), f"10.5555/a.{i}" if i % 5 == 0 else None, None) for i in range(1, 61)]
    s = spark.createDataFrame(seen, "paper_id string, title string, doi string, arxiv_id string")
    c = spark.createDataFrame(cands, "cand_id long, paper_id string, title string, doi string, arxiv_id string")
    f = history.HistoryForest(spark, str(tmp_path))
    f.start(s)
    step = {r["ord"] for k in range(0, 60, 20) for r in f.known(c.where(F.col("cand_id").between(k + 1, k + 20))).collect()}
    assert step == {r["cand_id"] for r in history.known_candidates(s, c).collect()}


TABLES = os.environ.get("VELLUM_TESTDATA", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables here")
def test_known_candidates_against_every_title(spark):
    seen, cands = spark.read.parquet(f"{TABLES}/seen_papers.parquet"), spark.read.parquet(f"{TABLES}/candidates.parquet")
    rows = [(0, r["title"]) for r in seen.select("title").collect()] + [(r["cand_id"], r["title"]) for r in cands.select("cand_id", "title").collect()]
    parts = [(o, *titles.parse(t)) for o, t in rows]
    brute = {o for o, b, m, g, sh in parts if o and b and not g and any(p < o and m == n and not h and titles.same_base(b, q, sh or sh2) for p, q, n, h, sh2 in parts)}
    found = {r["cand_id"] for r in history.known_candidates(seen, cands).collect()}
    assert brute and len(brute - found) <= len(brute) // 100


def test_a_partner_at_a_long_prefix_does_not_end_the_search(spark, tmp_path):
    # wording 1 meets 2 by a prefix of 6 and 3 by a prefix of 4 only; 3 came first
    names = [(1, "soil loss karo basin radar images", 5), (2, "soil loss karo basin radar image", 7), (3, "soil loss karo basn radar images", 0)]
    keys = {1: 0xAABBCCDDEEFF, 2: 0xAABBCCDDEEFF, 3: 0xAABBCCDD0000}
    signed = spark.createDataFrame([(w, t, 0, False, f, [keys[w]]) for w, t, f in names], "wid long, base string, marks long, short boolean, first long, slots array<long>")
    f = history.Forest(spark, str(tmp_path))
    f.add(signed)
    pairs = lambda **k: {(r["wid"], r["other"]) for r in f.near(signed.where("wid = 1"), **k).collect()}
    assert pairs() == {(1, 2), (1, 3)}
    assert pairs(earlier=True) == {(1, 3)}


def test_the_jvm_comparison_loses_no_pair(spark):
    # one word of 21 letters left out
    a, b = "estimating evapotranspirationals karo basin radar", "estimating karo basin radar"
    rows = [(a, False, b, False), (b, False, a, False), ("soil loss karo basin radar images old", False, "soil loss karo basin radar images old maps compared", False)]
    met = spark.createDataFrame(rows, "base string, short boolean, other_base string, other_short boolean")
    assert history.alike(met).count() == sum(titles.same_base(x[0], x[2]) for x in rows) == 3


def test_titles_that_share_all_but_the_place_are_not_compared(spark, tmp_path, monkeypatch):
    # a hundred places under one wording: they meet in every tree of common words, but only the misspelt ones are read
    rng = random.Random(5)
    place = lambda: "".join(rng.choice(c) for c in ["vkmpst", "aeiou", "lnrzbd", "aeiou", "fghjwc"] * 2)
    places = [place() for _ in range(100)]
    title = lambda p: f"soil loss in the {p} basin from radar images"
    slip = lambda p: p[:4] + p[5:]
    common = [(f"c{i}", title("middle"), None, None) for i in range(4)]
    s = spark.createDataFrame(common + [(f"s{i}", title(p), None, None) for i, p in enumerate(places)], "paper_id string, title string, doi string, arxiv_id string")
    c = spark.createDataFrame([(i, f"k{i}", title(slip(p)), None, None) for i, p in enumerate(places[:20])], "cand_id long, paper_id string, title string, doi string, arxiv_id string")
    compared = []
    alike = history.alike
    monkeypatch.setattr(history, "alike", lambda met: compared.append(met.count()) or alike(met))
    assert sorted(r["cand_id"] for r in history.known_candidates(s, c, str(tmp_path)).collect()) == list(range(20))
    assert 20 <= sum(compared) < 200


def test_the_forms_lose_no_pair():
    import numpy as np

    rng = random.Random(9)
    words = ["mapping", "erosion", "basin", "radar", "images", "survey", "limits", "valley", "since", "snow"]
    usual = history.Usual(words)
    word = lambda: "".join(rng.choice("aeioklmnrstv") for _ in range(rng.randint(5, 10)))

    def slipped(t):
        kind, k = rng.randrange(6), rng.randrange(len(t) - 1)
        if kind == 5:
            w = t.split(" ")
            return " ".join(w[: (k := rng.randrange(len(w)))] + w[k + 1 :]) or t
        return t[:k] + [t[k + 1 :], "x" + t[k:], "x" + t[k + 1 :], t[k + 1] + t[k] + t[k + 2 :], t[k:]][kind]

    pairs = []
    for i in range(6000):
        if i % 4:
            a = " ".join(rng.choice(words * 2 + [word()]) for _ in range(rng.randint(4, 9)))
        else:
            a = "".join(rng.choice("沟谷源头土壤侵蚀流域雷达影像监测变化") for _ in range(rng.randint(8, 20)))
        b = slipped(slipped(a)) if i % 3 else slipped(a)[: rng.randint(len(a) // 2, len(a))]
        pairs.append((a, b.strip() or a, i % 6 == 0))
    pairs = [p for p in pairs if titles.same_base(*p)]
    x, y = history.forms_of([a for a, _, _ in pairs], usual), history.forms_of([b for _, b, _ in pairs], usual)
    cut = np.array([c for _, _, c in pairs])
    for one, other in ((x, y), (y, x)):
        ok = history.may_be_alike(*one, cut, *other, cut)
        assert len(pairs) > 3000 and [p for p, k in zip(pairs, ok, strict=True) if not k] == []


def test_sorted_runs_find_what_a_scan_finds(spark, tmp_path):
    from vellum.llm.runs import SortedRuns

    rng = random.Random(4)
    rows = [(rng.randrange(200), i) for i in range(500)] + [(77, 1000 + i) for i in range(300)] + [(None, 9)]
    runs = SortedRuns(spark, str(tmp_path), "k")
    runs.add(spark.createDataFrame(rows[:400], "k long, v long"))
    runs.add(spark.createDataFrame(rows[400:], "k long, v long"))
    runs.add(spark.createDataFrame([], "k long, v long"))
    asked = [(i, *sorted((rng.randrange(220), rng.randrange(220)))) for i in range(30)] + [(50, 77, 77), (51, None, 5), (52, 300, 400)]
    q = spark.createDataFrame(asked, "q long, lo long, hi long")
    found = lambda: sorted((r["q"], r["v"]) for r in runs.search(q, "lo", "hi", {"v": "v"}).collect())
    want = sorted((i, v) for i, lo, hi in asked if lo is not None for k, v in rows if k is not None and lo <= k <= hi)
    assert found() == want
    runs.merge()
    assert len(runs.live()) == 1 and found() == want


# 3. linkage


def test_linkage(spark):
    p = spark.createDataFrame([("a", "Soil loss in the Karo Basin from radar images", "Ann Beroyas; B. Talo", "2020", "10.5555/x.1"), ("b", "Snow in the Velo Hills since the last survey", "C. Dimo", "2021", None), ("n", None, None, None, None)], "id string, title string, authors string, year string, doi string")
    r = spark.createDataFrame([(1, "Soil loss in the Karo Basn from radar images", "Beroyas et al.", "2021", None), (2, "Snow in the Velo Hills since the last survey: comment", "C. Dimo", "2022", None), (3, "Something else altogether in other words", "X", None, "10.5555/x.1"), (4, None, None, None, None)], "id long, title string, authors string, year string, doi string")
    got = {(x["a"], x["b"]): x["confidence"] for x in linkage.link(p, r).collect()}
    assert got["a", 1] >= 0.5 and got.get(("b", 2), 0) < 0.5 and got.get(("a", 3), 0) < 0.5
    assert linkage.link(p.limit(0), r).count() == 0


# 4. look-alike


def test_canonical_forms():
    c = lambda *x: lookalike.canonical(pa.array(x, pa.string())).to_pylist()
    assert c("Ｌｅn​ig", "Lenig") == ["Lenig", "Lenig"]
    assert c("é", "é", None, "", "​") == ["é", "é", None, "", ""]
    assert c("σ0", "σ₀")[0] != c("σ₀")[0]
    assert c("a-b")[0] != c("a b")[0] and c("Ab")[0] != c("ab")[0] and c("（A）")[0] != c("(A)")[0]
    assert c("АВс", "ABc") == ["ABc", "ABc"]
    assert lookalike.canonical(pa.array([], pa.string())).to_pylist() == []


def test_canonical_is_idempotent_and_keeps_plain_text():
    rng = random.Random(5)
    pool = "abcXYZ éöñ 沟谷ﬁ　 ​́̈０１Ａ-‐ο" + "".join(chr(x) for x in range(0x300, 0x310))
    xs = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 20))) for _ in range(400)]
    once = lookalike.canonical(pa.array(xs))
    assert lookalike.canonical(once).to_pylist() == once.to_pylist()
    plain = ["Plain text 123, with: signs", "沟谷地貌（DEM）"]
    assert lookalike.canonical(pa.array(plain)).to_pylist() == plain
    assert all(unicodedata.is_normalized("NFC", x) for x in lookalike.canonical(pa.array(["áb", "ö"])).to_pylist())


def test_lookalike_pairs(spark):
    df = spark.createDataFrame([("t", "1", "abc"), ("t", "2", "ab​c"), ("t", "3", "abc"), ("u", "4", "abc"), ("t", None, "abc"), ("t", "5", None), ("t", "2", "ab​c")], "field string, id string, value string")
    assert sorted((r["id_a"], r["id_b"]) for r in lookalike.lookalike_pairs(df).collect()) == [("1", "2"), ("2", "3")]


# 5. scans


def test_scan_lines(spark):
    clean = "The sediment samples were taken at many plots along the transect of the well-known basin.\n" * 60
    page = "We measured the sediment at many plots along the basin. The samples were ta-\nken along the transect of the basin, the scdiment was\n— 12 —\nMiller et al. / A title of the work\nweighed at many plots. The well-\nknown basin of the well-known transect.\n— 13 —\nMiller et al. / A title of the work\nmany plots of the basin and the transect were taken."
    rows = spark.createDataFrame([(1, clean), (2, page), (3, None), (4, ""), (5, "   \n\n")], "result_id long, text string")
    got = {(r["result_id"], r["line_no"], r["kind"]) for r in scans.scan_lines(rows).collect()}
    assert {(2, 2, "furniture"), (2, 3, "furniture"), (2, 6, "furniture"), (2, 7, "furniture"), (2, 0, "broken"), (2, 1, "misread")} <= got
    assert not any(g[0] in (1, 3, 4, 5) for g in got) and (2, 4, "broken") not in got
    text = {r["result_id"]: r["repaired"] for r in scans.repaired_texts(rows).collect()}
    assert "taken along" in text[2] and "et al" not in text[2] and "the sediment was weighed" in text[2] and text[3] is None


# 6. encoding


@pytest.mark.parametrize("text,wrong", [("Überschrift für Höhe und Maß", "cp1252"), ("él comió año tras año", "latin-1"), ("文本过短，降级为部分正文", "cp1252"), ("la précipitation près de l’été", "mac_roman"), ("mediciones año", "cp437"), ("文本过短", "cp1251")])
def test_restores_wrong_decodings(text, wrong):
    back = "".join(encoding._char(wrong, b) if b > 127 else chr(b) for b in text.encode())
    found = encoding.evidence(back)
    assert found is not None
    assert encoding.restore(back, f"utf-8>{wrong}") == text


def test_restores_twice_and_gbk():
    once = lambda t: "".join(encoding._char("cp1252", b) if b > 127 else chr(b) for b in t.encode())
    assert encoding.restore(once(once("naïve – 文本")), "utf-8>cp1252") == "naïve – 文本"
    gbk = "".join(encoding._char("cp1252", b) for b in "中文质量检测".encode("gbk"))
    assert encoding.restore(gbk, "gbk>cp1252") == "中文质量检测"


@pytest.mark.parametrize("text", ["déjà vu à l’été", "CAFÉ» «É", "中文质量检测: 可疑", "露水", "± 5 °C µm", "REGIÃO E ELEVAÇÃO", "plain", ""])
def test_correct_text_is_no_case(text):
    assert encoding.evidence(text) is None


def test_garbled_values(spark):
    rows = spark.createDataFrame([(1, "e", "Das Ergebnis hÃ¤ngt von der HÃ¶he ab", None), (2, "e", "Das Ergebnis hängt von der Höhe ab", ["ok", None, "Ãœberschrift fehlt"]), (3, None, None, []), (4, None, "a�b", None)], "result_id long, engine_used string, text string, warnings array<string>")
    got = sorted((r["result_id"], r["field"]) for r in encoding.garbled_values(rows).collect())
    assert got == [(1, "text"), (2, "warnings"), (4, "text")]


# 7. names


def test_name_groups(spark):
    authors = ["Anthony K. Wejofeov", "Tony Wejofeov", "Wejofeov, Anthony", "WEJOFEOV Anthony", "Wejofeov AK", "A. K. Wejofeov", "Anthony Wejoffeov", "Henry Soloja", "Hank Soloja", "Helena Soloja", "Soloja, Helena", "", None, " "]
    venues = ["Annals of Basin and Form Methods", "Ann. Basin Form Meth.", "ANNALS OF BASIN AND FORM METHODS", "Annals of Basin & Form Methods", "Annals of Basin and Form Letters", "ABFM", "Basin and Form Methods, Annals of", "Annals of Basin andd Form Methods"]
    df = spark.createDataFrame([("author", a) for a in authors] + [("venue", v) for v in venues], "kind string, name string")
    groups = {}
    for r in names.group_spellings(df).collect():
        groups.setdefault((r["kind"], r["grp"]), set()).add(r["name"])
    sets = [frozenset(v) for v in groups.values()]
    assert frozenset(authors[:7]) in sets and frozenset(["Henry Soloja", "Hank Soloja"]) in sets and frozenset(["Helena Soloja", "Soloja, Helena"]) in sets
    assert frozenset(v for v in venues if v != "Annals of Basin and Form Letters") in sets
    assert names.group_spellings(df.limit(0)).count() == 0


# 8. tokens


@pytest.mark.skipif(not HAVE_TOKENIZERS, reason="no tokenizer files here")
def test_ids_equal_the_reference_encoder(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(os.path.join(tokens.TOKENIZER_DIR, "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    rng = random.Random(7)
    pool = ["the", " soil", "  ", "\n\n", "沟谷地貌", "é", "123", "<|endoftext|>", "\U0001f600", "'s", "xyzzyqq", "\t", "　", "aaaaaaaa", "€", "don't"]
    texts = ["", None, " ", "a" * 3000] + ["".join(rng.choice(pool) for _ in range(rng.randint(1, 60))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for r in tokens.encode_corpus(df).collect():
        assert r["ids"] == t.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
    assert df.select(F.sum(tokens.token_count(F.col("text")))).first()[0] > 0


# 9. mixture


@pytest.mark.skipif(not HAVE_TOKENIZERS, reason="no tokenizer files here")
def test_mixture(spark):
    rows = [(i, "word " * (5 + i % 7), "big") for i in range(400)] + [(1000 + i, "term " * 6, "small") for i in range(10)] + [(2000, None, "big"), (2001, "", "small"), (2002, "x y", None), (2003, "x", "unwanted")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.4, 3), ("absent", 0.1, 2), ("unwanted", 0.0, 1)], "source string, target_share double, max_repeats long")
    mix = mixing.mixture(docs, targets, block_tokens=64, shard_tokens=80)
    got = {r["source"]: r for r in mixing.reached_shares(mix, targets).collect()}
    assert abs(got["big"]["actual_share"] - 5 / 9) < 0.04 and abs(got["small"]["actual_share"] - 4 / 9) < 0.04
    assert got["absent"]["n_tokens"] == 0 and got["unwanted"]["n_docs"] == 0 and got["small"]["most_uses"] <= 3 and got["big"]["most_uses"] == 1
    assert mix.groupBy("doc_id", "copy_no").count().where("count > 1").count() == 0
    assert mix.select("shard").distinct().count() > 1
    assert mixing.mixture(docs.limit(0), targets).count() == 0


def test_split_tree_keeps_counts(spark):
    out = [mixing.shard_share([100, 7, 0], 9, k, 1) for k in range(9)]
    got = [g for _, g in out]
    assert [sum(c) for c in zip(*got)] == [100, 7, 0] and max(sum(r) for r in got) - min(sum(r) for r in got) <= 4
    # the ranks of a source follow each other without gap
    assert all(out[k + 1][0] == [b + g for b, g in zip(*out[k])] for k in range(8))
    spans = mixing.shard_spans(spark, {"a": 100, "b": 7, "c": 0}, 9, 1)
    assert sorted(r for x in spans.where("source = 'a'").collect() for r in range(x["lo"], x["hi"] + 1)) == list(range(1, 101))


# 10. abuse


def test_abuse_scores(spark):
    ex = spark.createDataFrame([(i, f"You are a useless clown number {i}", 1) for i in range(30)] + [(100 + i, f"The samples of plot {i} were weighed twice", 0) for i in range(30)], "example_id long, text string, label long")
    texts = ["You are a useless clown.", "Y o u are a u s e l e s s clown", "The samples of the plot were weighed.", "Naked soil faces the wind after the harvest.", None, "", "  \n ", "The plot was dry. " * 2000 + "You are a useless clown. " + "It rained. " * 2000]
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    scores = abuse.abuse_scores(docs, ex)
    got = {r["doc_id"]: r["offensive"] for r in scores.collect()}
    assert got == {0: True, 1: True, 2: False, 3: False, 4: False, 5: False, 6: False, 7: True}
    assert abuse.abuse_rates(scores).first()["n_offensive"] == 3
    # nothing is known without examples
    assert not any(r["offensive"] or r["score"] for r in abuse.abuse_scores(docs, ex.limit(0)).collect())
    assert abuse.abuse_scores(docs.limit(0), ex).count() == 0


def test_short_windows_are_scored():
    s = abuse.Scorer(["drop dead you crud", "you are crudmonger", "crudmonger"], ["the soil was dry", "the map is old"])
    assert s.window("you crud") >= 0 and s.window("drop dead you") > 0 and s.window("") == 0 and abuse.Scorer([], ["x"]).window("crud") == 0


def test_calibration_holds_families_out():
    texts = ["you are a dull clown today", "you are a dull fool today", "rain fell on the upper plot", "rain fell on the lower field"]
    assert (k := abuse.families(texts))[0] == k[1] and k[2] == k[3] and k[0] != k[2]


def test_growth_takes_new_wordings_in(spark):
    bad, good = ["you are a useless clown, said number 0"], ["the samples of plot 0 were weighed twice", *(f"field notes of the {k} survey were typed again" for k in ("first", "second", "third", "last"))]
    new, rest = "You are a useless clown, said the note, now crawl off to the mire.", "Now crawl off to the mire."
    docs = spark.createDataFrame([(i, new if i < 3 else "The samples of the plot were weighed twice. It rained.") for i in range(40)], "doc_id long, text string")
    more_bad, more_good = abuse.grown(docs, bad, good)
    assert abuse.even(new) in more_bad and "it rained." in more_good
    assert abuse.Scorer(more_bad, more_good).window(abuse.even(rest)) > 0.1 > abuse.Scorer(bad, good).window(abuse.even(rest))


def test_growth_knows_windows_by_their_company(spark):
    known = [f"you are a useless clown, said number {w}" for w in ("one", "two", "three", "four")]
    plain = "The samples of the plot were weighed twice."
    other = "Weg mit euch, ihr elenden Wichte."
    texts = [f"{plain} {k.capitalize()}. {other}" for k in known]
    # a pattern of ordinary names, one of which meets offensive windows by chance; copies of one document are no company
    texts += [f"{plain} {k.capitalize()}. Near Podor the bank fell." for k in known] + [f"{plain} Near {a}{b}r the bank fell." for a in "BDFGKLMNPRTV" for b in ("ani", "elo", "idu", "omo", "uva")]
    texts += [f"{plain} {known[0].capitalize()}. Il pleut sur le plateau nu."] * 4 + [plain] * 200
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    counted = abuse.counted_windows(docs)
    kept = {r["window"] for r in abuse.keeping_company(counted, docs, [abuse.even(f"{k}.") for k in known], len(texts)).where("kept").collect()}
    assert abuse.even(other) in kept and not any(w.startswith(("near", "il pleut", "the samples")) for w in kept)
    bad, _ = abuse.grown(docs, [f"{k}." for k in known], [abuse.even(plain), *(f"field notes of the {k} survey were typed again" for k in ("first", "second", "third", "last"))])
    assert abuse.even(other) in bad


def test_usual_windows_without_company_are_ordinary(spark):
    bad, good = ["vermin like you had better crawl off and starve"], ["the samples of the plot were weighed twice."]
    texts = ["The samples of the plot were weighed twice. Vermin had crawled in under the tarp."] * 12 + ["Vermin like you had better crawl off and starve."] + ["The samples of the plot were weighed twice."] * 60
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    limbo = abuse.even("Vermin had crawled in under the tarp.")
    assert abuse.ORDINARY < abuse.Scorer(bad, good).window(limbo) < abuse.ADOPT
    assert limbo in abuse.grown(docs, bad, good)[1]


def test_evening_forgets_only_numbers():
    for t in ("12 of 345 plots, s0x in 2019", "a1b2 $5 @12 1 2 3 4 5", "l0s3r 77", "**2021** - 7.5"):
        assert abuse.even(t) == abuse._evened.__wrapped__(t)
