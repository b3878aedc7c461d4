"""Phrases in texts: every size of phrase against brute force, and no side that grows with the data sent through the driver."""

import random

from vellum.operators import curation, links


def collected(df):
    """The rows, and whether the plan that ran held a broadcast."""
    rows = df.collect()
    return rows, "Broadcast" in df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_phrases_of_every_size_equal_brute_force(spark):
    rng = random.Random(7)
    texts = [(i, "".join(rng.choices("ab沟é😀 ", k=rng.choice([0, 1, 5, 40, 300])))) for i in range(200)]
    cut = lambda t, n: (lambda a: t[a : a + n])(rng.randrange(max(1, len(t) - n)))
    phrases = dict(enumerate({cut(rng.choice(texts)[1], n) for n in (2, 3, 4, 5, 7, 8, 9, 31, 32, 33, 64, 100) for _ in range(20)} | {"ab" * 40, "xyz", "沟" * 3}))
    df = links.phrases_in_texts(spark.createDataFrame(list(phrases.items()), "phrase_id int, phrase string"), spark.createDataFrame(texts, "text_id int, text string"), brief=True)
    rows, sent = collected(df)
    got = [(r["phrase_id"], r["text_id"]) for r in rows]
    assert len(got) == len(set(got)) and not sent
    assert set(got) == {(p, t) for p, w in phrases.items() for t, s in texts if len(w) > 1 and w in s}


def test_docs_governed_by_first_phrase_without_broadcast(spark):
    docs = spark.createDataFrame([("d1", "Soil loss and gully heads"), ("d2", "gully"), ("d3", None)], "id string, text string")
    named = spark.createDataFrame([("w3", "soil loss"), ("w2", "Gully Head"), ("w1", "gully head"), ("w4", "snow")], "id string, phrase string")
    rows, sent = collected(links.first_phrase(docs, named, "G", 0.4))
    assert [(r["src"], r["dst"]) for r in rows] == [("d1", "w1")] and not sent


def test_records_title_prefix_without_broadcast(spark):
    records = spark.createDataFrame([("r1", "On a robust assessment of soil loss in the hills"), ("r2", "robust")], "id string, text string")
    papers = spark.createDataFrame([("p2", "A robust assessment of soil loss in the plains"), ("p1", "A ROBUST assessment of soil losses"), ("p0", "short one")], "id string, title string")
    rows, sent = collected(links.first_title_prefix(records, papers, "R", 0.8))
    assert [(r["src"], r["dst"]) for r in rows] == [("r1", "p1")] and not sent


def test_store_duplicates_without_broadcast(spark):
    long = "mapping soil loss in the upper basin of a small river"
    new = spark.createDataFrame([(1, None, long), (2, "10.1/X", "one"), (3, "10.1/x", "two"), (4, "", "three"), (5, None, f"{long} with drones")], "cand_id int, doi string, title string")
    store = spark.createDataFrame([("a", " 10.1/X", "zero"), ("b", "", "Three"), ("c", None, f"again {long}")], "id string, doi string, title string")
    rows, sent = collected(curation.store_duplicates(new, store, "cand_id"))
    assert {r["cand_id"]: r["reason"] for r in rows} == {1: "held", 2: "doi", 4: "title"} and not sent


def test_terms_derived_from_short_words_without_broadcast(spark):
    terms = spark.createDataFrame([("t1", ["SAR mapping (2020)"]), ("t2", ["sar mapping"]), ("t3", []), ("t4", ["of"])], "id string, sources array<string>")
    papers = spark.createDataFrame([("p1", "Pulsar noise", "A; B"), ("p2", "Other", None), ("p3", "Mapping of SAR", "C")], "id string, title string, authors string")
    rows, sent = collected(links.source_tokens(terms, papers, "D", 0.7))
    # a word of three letters counts inside another, as in the SQL
    assert sorted((r["src"], r["dst"]) for r in rows) == [("t1", "p1"), ("t1", "p3"), ("t2", "p1"), ("t2", "p3")] and not sent


def test_terms_in_papers_without_broadcast(spark):
    terms = spark.createDataFrame([("t1", "Gully Head (gully top)", "沟谷源头"), ("t2", "Loess", None)], "id string, english string, chinese string")
    texts = spark.createDataFrame([(1, "the GULLY TOP and gully head"), (2, "沟谷源头"), (3, "loes")], "text_id int, text string")
    rows, sent = collected(links.introduces(terms, texts))
    assert sorted((r["src"], r["dst"]) for r in rows) == [(1, "t1"), (2, "t1")] and not sent


def test_terms_in_papers_sends_nothing_of_the_terms_through_the_driver(spark, monkeypatch):
    terms = spark.createDataFrame([("t1", "Gully Head", "沟谷源头"), ("t2", "Loess", None)], "id string, english string, chinese string")
    texts = spark.createDataFrame([(1, "the gully head"), (2, "沟谷源头"), (3, "loes")], "text_id int, text string")

    def refused(*_, **__):
        raise AssertionError("rows in the driver")

    for name in ("collect", "toArrow", "toPandas", "toLocalIterator"):
        monkeypatch.setattr(type(terms), name, refused)
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", refused)
    some, none = links.introduces(terms, texts), links.introduces(terms.where("id = ''"), texts)
    monkeypatch.undo()
    assert sorted((r["src"], r["dst"]) for r in some.collect()) == [(1, "t1"), (2, "t1")] and none.collect() == []


def test_papers_shared_topics_of_copies_without_broadcast(spark):
    # two rows of a paper count together; a pair is given once though it meets in several cells
    df = spark.createDataFrame([("a", ["x", "Y"]), ("a", ["z"]), ("b", ["y", "z", "x", "z"]), ("c", ["z", None, "", "y"]), ("d", ["x"]), ("e", None)], "id string, items array<string>")
    rows, sent = collected(links.shared_items(df, "items", 2, "S"))
    assert sorted((r["src"], r["dst"], r["confidence"]) for r in rows) == [("a", "b", 0.8), ("a", "c", 0.7), ("b", "c", 0.7)] and not sent


def test_papers_shared_work_of_many_without_broadcast(spark):
    rng = random.Random(3)
    work = {f"p{i:02}": [f"w{x}" for x in rng.sample(range(9), rng.randint(0, 5))] for i in range(60)}
    rows, sent = collected(links.shared_items(spark.createDataFrame(list(work.items()), "id string, items array<string>"), "items", 3, "S"))
    want = {(a, b): sorted({*work[a]} & {*work[b]}) for a in work for b in work if a < b and len({*work[a]} & {*work[b]}) >= 3}
    assert len(rows) == len(want) > 20 and not sent and {(r["src"], r["dst"]): r["shared"] for r in rows} == want


def test_terms_deep_in_papers_counts_the_edges_without_broadcast(spark):
    terms = spark.createDataFrame([("t1", "Gully Head", "沟谷源头"), ("t2", "head gully", None), ("t3", "sar dem", None), ("t4", None, "沟谷"), ("t5", "loess", None)], "id string, english string, chinese string")
    texts = spark.createDataFrame([(1, "the gully and its head"), (2, "沟谷源头"), (3, "sar of a dem"), (4, "a dem"), (5, "gully head"), (6, None)], "text_id int, text string")
    edges, sent = collected(links.deep_introduces(terms, texts))
    got = {}
    for r in edges:
        n, c = got.get(r["dst"], (0, 0))
        got[r["dst"]] = (n + 1, max(c, r["confidence"]))
    rows, sent_too = collected(links.deep_introduced(terms, texts))
    assert {r["dst"]: (r["n_papers"], r["confidence"]) for r in rows} == got == {"t1": (3, 0.9), "t2": (2, 0.6), "t3": (1, 0.6)} and not sent and not sent_too
