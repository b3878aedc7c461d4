"""Rules that find edges between entities. Each returns (src, dst, type, confidence).

Equalities are joins by shuffling; of texts in which phrases are looked for, only the pieces that are phrases leave the text, so no rule
is a nested loop over both sides.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.operators.phrases import occurrences

#: Items up to which the nodes of each set of items are counted.
FEW_ITEMS = 10
#: Nodes of the same items that meet as one row, and parts in which they are gathered.
MEET_AS_ONE, SPREAD = 256, 16


def _edges(df: DataFrame, src: str, dst: str, kind: str, confidence: Column | float) -> DataFrame:
    c = confidence if isinstance(confidence, Column) else F.lit(confidence)
    return df.select(F.col(src).alias("src"), F.col(dst).alias("dst"), F.lit(kind).alias("type"), c.cast("double").alias("confidence"))


def same_value(nodes: DataFrame, key: str, kind: str, confidence: float) -> DataFrame:
    """An edge between every two nodes (id) with one non-empty value of `key`, src < dst. For keys of small groups."""
    v = nodes.where(F.col(key).isNotNull() & (F.col(key).cast("string") != "")).select("id", key).distinct()
    a, b = v.alias("a"), v.alias("b")
    met = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}")).where("a.id < b.id").select(F.col("a.id").alias("s"), F.col("b.id").alias("d"))
    return _edges(met.distinct(), "s", "d", kind, confidence)


def group_star(nodes: DataFrame, key: str, kind: str, confidence: float) -> DataFrame:
    """The same relation for keys of groups without bound: an edge from the least id of the group to each other, linear in size."""
    v = nodes.where(F.col(key).isNotNull() & (F.col(key).cast("string") != "")).select("id", key).distinct()
    first = v.groupBy(key).agg(F.min("id").alias("s"))
    return _edges(v.join(first, key).where("id <> s"), "s", "id", kind, confidence)


def equal_dates(left: DataFrame, right: DataFrame, kind: str, confidence: float) -> DataFrame:
    """left (id, date) to right (id, date) of the same non-empty date."""
    a = left.where("date is not null and date <> ''").select(F.col("id").alias("s"), "date")
    b = right.where("date is not null and date <> ''").select(F.col("id").alias("d"), "date")
    return _edges(a.join(b, "date"), "s", "d", kind, confidence)


def _items_of(nodes: DataFrame, items: Column | str, least: int) -> DataFrame:
    """(id, items) of nodes of at least `least` different items, in order."""
    items = F.col(items) if isinstance(items, str) else items
    own = nodes.select("id", F.explode(items).alias("item")).select("id", F.lower("item").alias("item")).where("item <> ''")
    return own.groupBy("id").agg(F.array_sort(F.collect_set("item")).alias("items")).where(F.size("items") >= least)


def _cells(least: int) -> Column:
    """Combinations of `least` of the column items, each in order: one more item after the last of each."""
    cells = F.transform("items", lambda x: F.array(x))
    longer = lambda c: F.transform(F.filter("items", lambda x: x > F.element_at(c, -1)), lambda x: F.concat(c, F.array(x)))
    for _ in range(least - 1):
        cells = F.flatten(F.transform(cells, longer))
    return cells


def count_shared_items(nodes: DataFrame, items: Column | str, least: int) -> DataFrame:
    """(n): the number of edges of shared_items, ids not null, without making them.

    By inclusion and exclusion from the number of nodes that have all items of each set: the pairs of at least m common items are the
    sum over j >= m of (-1)^(j-m) C(j-1, m-1) times the pairs in the sets of j items. A node has two to the power of its items of them,
    so those of more than FEW_ITEMS meet the others one by one, once for each list of items.
    """
    own = _items_of(nodes.where("id is not null"), items, least).groupBy("items").agg(F.count("*").alias("n"))
    few = own.where(F.size("items") <= FEW_ITEMS)
    none = F.array(F.array().cast("array<string>"))
    subsets = F.aggregate("items", none, lambda acc, x: F.concat(acc, F.transform(acc, lambda s: F.concat(s, F.array(x)))))
    have = few.select("n", F.explode(F.filter(subsets, lambda s: F.size(s) >= least)).alias("of")).groupBy("of").agg(F.sum("n").alias("n"))
    j, exact = F.size("of"), lambda c: c.cast("decimal(38,0)")
    sign = F.when((j - least) % 2 == 0, F.lit(1)).otherwise(F.lit(-1))
    choose = F.lit(0)
    for k in range(least, FEW_ITEMS + 1):
        choose = F.when(j == k, F.lit(math.comb(k - 1, least - 1))).otherwise(choose)
    met = have.select(exact(sign * choose).alias("f"), exact(F.shiftright(F.col("n") * (F.col("n") - 1), 1)).alias("n")).select(F.sum(F.col("f") * F.col("n")).alias("n"))
    keys = own.select("items", "n", F.explode(_cells(least)).alias("cell"))
    big = keys.where(F.size("items") > FEW_ITEMS).select(F.col("items").alias("x"), F.col("n").alias("n_x"), "cell")
    pairs = big.join(keys.select(F.col("items").alias("y"), F.col("n").alias("n_y"), "cell").hint("merge"), "cell").where((F.size("y") <= FEW_ITEMS) | (F.col("x") < F.col("y")))
    pairs = pairs.where(F.slice(F.array_intersect("x", "y"), 1, least) == F.col("cell")).select((F.col("n_x") * F.col("n_y")).alias("n"))
    alike = own.where(F.size("items") > FEW_ITEMS).select(F.shiftright(F.col("n") * (F.col("n") - 1), 1).alias("n"))
    parts = met.select(F.col("n").cast("long").alias("n")).unionByName(pairs).unionByName(alike)
    return parts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def shared_items(nodes: DataFrame, items: Column | str, least: int, kind: str, most_listed: int = 5) -> DataFrame:
    """Nodes that share at least `least` items of an array, src < dst, with the first `most_listed` shared ones; confidence 0.5 and 0.1
    for each, 0.9 at most.

    Nodes meet in cells of `least` items each, so only such that are a pair meet; of the cells that two have in common the first one
    gives the pair, once. No pair is shuffled. Nodes of the same items go into a cell together, MEET_AS_ONE at most in a row, so
    their items are written once for all of them; a cell is written as a hash of its items.
    """
    own = _items_of(nodes, items, least).groupBy("items", F.pmod(F.xxhash64("id"), F.lit(SPREAD)).alias("part")).agg(F.collect_list("id").alias("ids")).where(F.size("ids") > 0)
    rows = F.transform(F.sequence(F.lit(0), F.floor((F.size("ids") - 1) / MEET_AS_ONE).cast("int")), lambda i: F.slice("ids", i * MEET_AS_ONE + 1, MEET_AS_ONE))
    keys = own.select("items", F.explode(rows).alias("ids")).select("ids", "items", F.explode(F.transform(_cells(least), lambda c: F.xxhash64(c))).alias("cell"))
    a, b = keys.select(F.col("ids").alias("s"), F.col("items").alias("x"), "cell"), keys.select(F.col("ids").alias("d"), F.col("items").alias("y"), "cell")
    met = a.join(b.hint("merge"), "cell").where(F.array_min("s") < F.array_max("d")).withColumn("both", F.array_intersect("x", "y")).where((F.size("both") >= least) & (F.xxhash64(F.slice("both", 1, least)) == F.col("cell")))
    met = met.withColumn("s", F.explode("s")).withColumn("d", F.explode("d")).where("s < d")
    n = F.size("both")
    return met.select(F.col("s").alias("src"), F.col("d").alias("dst"), F.lit(kind).alias("type"), F.least(F.lit(0.9), F.bround(0.5 + 0.1 * n, 1)).cast("double").alias("confidence"), F.slice("both", 1, most_listed).alias("shared"))


def last_per_date(left: DataFrame, right: DataFrame, kind: str, confidence: float) -> DataFrame:
    """left (id, date) to the last of right (id, date) of the same non-empty date."""
    last = right.where("date is not null and date <> ''").groupBy("date").agg(F.max("id").alias("d"))
    a = left.where("date is not null and date <> ''").select(F.col("id").alias("s"), "date")
    return _edges(a.join(last, "date"), "s", "d", kind, confidence)


def first_phrase(left: DataFrame, named: DataFrame, kind: str, confidence: float) -> DataFrame:
    """left (id, text) to the first of named (id, phrase) whose phrase its text holds, ignoring case."""
    p = named.groupBy(F.lower("phrase").alias("phrase")).agg(F.min("id").alias("phrase_id"))
    met = phrases_in_texts(p, left.select(F.col("id").alias("text_id"), "text")).groupBy("text_id").agg(F.min("phrase_id").alias("d"))
    return _edges(met, "text_id", "d", kind, confidence)


def source_tokens(left: DataFrame, papers: DataFrame, kind: str, confidence: float) -> DataFrame:
    """left (id, sources: array) to papers (id, title, authors): a word of a source, brackets removed, of more than two
    characters, is in the title or the authors; one edge for each source and paper."""
    of, each, met = _source_words(left, papers)
    # nodes of the same words reach the same papers: the edges are made once for all of them and shared out last, by no shuffle of edges
    reached = each.join(met.hint("merge"), "phrase").select("words", "d").distinct()
    return _edges(reached.hint("merge").join(of, "words"), "s", "d", kind, confidence)


def count_source_tokens(left: DataFrame, papers: DataFrame) -> DataFrame:
    """(n): the number of edges of source_tokens, ids not null, without making them: nodes of the same words and papers in which the same
    words occur are met once for all of them, on every common word, and the first gives the pair."""
    of, _, met = _source_words(left.where("id is not null"), papers.where("id is not null"))
    x = of.groupBy(F.col("words").alias("x")).agg(F.count("*").alias("n_x")).withColumn("phrase", F.explode("x"))
    y = met.groupBy("d").agg(F.array_sort(F.collect_set("phrase")).alias("y")).groupBy("y").agg(F.count("*").alias("n_y")).withColumn("phrase", F.explode("y"))
    pairs = x.join(y.hint("merge"), "phrase").where(F.array_intersect("x", "y")[0] == F.col("phrase"))
    return pairs.agg(F.coalesce(F.sum(F.col("n_x") * F.col("n_y")), F.lit(0)).alias("n"))


def _source_words(left: DataFrame, papers: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(s, words) of left; (words, phrase) of the different lists of words; (phrase, d) of the papers that hold a word."""
    words = F.filter(F.split(F.lower(F.regexp_replace("source", r"\([^)]*\)", "")), " "), lambda w: F.length(w) > 2)
    s = left.select(F.col("id").alias("s"), F.explode(F.array_distinct("sources")).alias("source")).select("s", F.explode(F.array_distinct(words)).alias("phrase"))
    of = s.groupBy("s").agg(F.array_sort(F.collect_set("phrase")).alias("words"))
    texts = papers.select(F.col("id").alias("text_id"), F.concat_ws("\n", "title", "authors").alias("text"))
    each = of.select("words").distinct().select("words", F.explode("words").alias("phrase"))
    met = phrases_in_texts(each.select(F.col("phrase").alias("phrase_id"), "phrase").distinct(), texts, brief=True).select(F.col("phrase_id").alias("phrase"), F.col("text_id").alias("d"))
    return of, each, met


def wiki_references(left: DataFrame, known: DataFrame, kind: str, confidence: float) -> DataFrame:
    """left (id, text) to the entry its first knowledge-base link names, where `known` (id) has it."""
    ref = left.select(F.col("id").alias("s"), T.kb_reference(T.wiki_links(F.col("text"))).alias("d")).where("d is not null")
    return _edges(ref.join(known.select(F.col("id").alias("d")), "d", "left_semi"), "s", "d", kind, confidence)


def slug_members(items: DataFrame, wholes: DataFrame, kind: str, confidence: float) -> DataFrame:
    """items (id `kind_slug_n`) to the first of wholes (id) whose id holds the slug."""
    s = items.select(F.col("id").alias("s"), F.try_element_at(F.split("id", "_", 3), F.lit(2)).alias("slug")).where("length(slug) > 1")
    met = phrases_in_texts(s.select(F.col("slug").alias("phrase_id"), F.col("slug").alias("phrase")).distinct(), wholes.select(F.col("id").alias("text_id"), F.col("id").alias("text")))
    first = met.groupBy("phrase_id").agg(F.min("text_id").alias("d"))
    return _edges(s.join(first, s["slug"] == first["phrase_id"]), "s", "d", kind, confidence)


def similarity_edges(nearest: DataFrame, strong: float = 0.2) -> DataFrame:
    """Edges of a similarity join (text_id, other, score): SEMANTIC_SIMILAR above `strong`, else WEAKLY_RELATED; confidence: the score
    in hundredths."""
    kind = F.when(F.col("score") > strong, "SEMANTIC_SIMILAR").otherwise("WEAKLY_RELATED")
    return nearest.select(F.col("text_id").alias("src"), F.col("other").alias("dst"), kind.alias("type"), F.bround("score", 2).alias("confidence"))


def explicit_references(nodes: DataFrame, refs: str, kind: str, confidence: float) -> DataFrame:
    """Edges to the ids named in an array column, as far as they exist."""
    r = nodes.select(F.col("id").alias("s"), F.explode(refs).alias("d")).where("s <> d").distinct()
    return _edges(r.join(nodes.select(F.col("id").alias("d")), "d", "left_semi"), "s", "d", kind, confidence)


def phrases_in_texts(phrases: DataFrame, texts: DataFrame, brief: bool = False) -> DataFrame:
    """(phrase_id, text_id, phrase): phrases (phrase_id, phrase) that occur in texts (text_id, text), ignoring case. Phrases under four
    characters count only if they hold a Chinese one, or all of more than one character with `brief`.
    """
    p = phrases.where("phrase is not null and length(phrase) > 1").select("phrase_id", F.lower("phrase").alias("phrase")).distinct()
    if not brief:
        p = p.where("length(phrase) >= 4 or phrase rlike '[一-鿿]'")
    t = texts.where("text is not null and text <> ''").select("text_id", F.lower("text").alias("text"))
    return occurrences(p, t).join(p.hint("merge"), "phrase").select("phrase_id", "text_id", "phrase")


def introduces(terms: DataFrame, texts: DataFrame) -> DataFrame:
    """Edges from texts (text_id, text) to the terms (id, english, chinese) they use; the first name found counts."""
    names = F.array(F.trim(F.regexp_replace("english", r"\([^)]*\)", "")), F.regexp_extract(F.col("english"), r"\(([^)]{3,})\)", 1), F.col("chinese"))
    p = terms.select(F.col("id").alias("phrase_id"), F.explode(names).alias("phrase")).where("length(phrase) >= 4")
    found = phrases_in_texts(p, texts).select("text_id", "phrase_id").distinct()
    return _edges(found, "text_id", "phrase_id", "INTRODUCES", 0.7)


def _names_and_tokens(terms: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(t, w) of terms (id, english, chinese) and (text_id, w) of texts (text_id, text), once each: words and pieces of Chinese runs."""
    low = F.lower(F.coalesce("english", F.lit("")))
    words = F.filter(F.regexp_extract_all(low, F.lit("([a-z]{3,})"), F.lit(1)), lambda w: F.length(w) >= 3)
    cjk = F.regexp_extract_all(F.coalesce("chinese", F.lit("")), F.lit("([一-鿿]{2,})"), F.lit(1))
    grams = F.flatten(F.transform(cjk, lambda r: F.flatten(F.transform(F.array(F.lit(2), F.lit(3), F.lit(4)), lambda n: F.when(F.length(r) >= n, T.shingles(r, n)).otherwise(F.array().cast("array<string>"))))))
    p = terms.select(F.col("id").alias("t"), F.explode(F.array_distinct(F.concat(words, grams))).alias("w"))
    # tokens of the texts of the same two kinds: an equality, not a search
    tx = F.lower(F.coalesce("text", F.lit("")))
    runs = F.regexp_extract_all(tx, F.lit("([一-鿿]{2,})"), F.lit(1))
    tg = F.flatten(F.transform(runs, lambda r: F.flatten(F.transform(F.array(F.lit(2), F.lit(3), F.lit(4)), lambda n: F.when(F.length(r) >= n, T.shingles(r, n)).otherwise(F.array().cast("array<string>"))))))
    q = texts.select("text_id", F.explode(F.array_distinct(F.concat(F.regexp_extract_all(tx, F.lit("([a-z]{3,})"), F.lit(1)), tg))).alias("w"))
    return p.distinct(), q.distinct()


def _alike(tokens: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """(key, ws) of tokens (key, w): those that `other` has too, in order."""
    return tokens.join(other.select("w").distinct().hint("merge"), "w", "left_semi").groupBy(key).agg(F.array_sort(F.collect_set("w")).alias("ws"))


def _deep(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of a (x: tokens, ...) with those of b (y: tokens, ...) that deep_introduces links, and the confidence. They meet on every
    common token and the first gives the pair, so no pair is shuffled."""
    met = a.withColumn("w", F.explode("x")).join(b.withColumn("w", F.explode("y")).hint("merge"), "w").withColumn("both", F.array_intersect("x", "y")).where(F.col("both")[0] == F.col("w"))
    met = met.where((F.size("both") >= 2) | (F.length(F.col("both")[0]) >= 4))
    return met.withColumn("confidence", F.least(F.lit(0.9), F.bround(0.4 + 0.1 * F.size("both"), 1)).cast("double"))


def deep_introduces(terms: DataFrame, texts: DataFrame) -> DataFrame:
    """Edges by several names of a term at once: at least two, or one of four characters; 0.4 and 0.1 for each, 0.9 at most."""
    p, q = _names_and_tokens(terms, texts)
    met = _deep(_alike(p, q, "t").withColumnRenamed("ws", "x"), _alike(q, p, "text_id").withColumnRenamed("ws", "y"))
    return _edges(met, "text_id", "t", "INTRODUCES", F.col("confidence"))


def deep_introduced(terms: DataFrame, texts: DataFrame) -> DataFrame:
    """(dst, n_papers, confidence): of each term of deep_introduces the number of edges and the largest confidence. Terms and texts of the
    same common tokens are met once for all of them, and counted before anything is shuffled."""
    p, q = _names_and_tokens(terms, texts)
    of = _alike(p, q, "t").withColumnRenamed("ws", "x")
    many = _alike(q, p, "text_id").groupBy(F.col("ws").alias("y")).agg(F.count("*").alias("n"))
    each = _deep(of.select("x").distinct(), many).groupBy("x").agg(F.sum("n").alias("n_papers"), F.max("confidence").alias("confidence"))
    return of.join(each.hint("merge"), "x").select(F.col("t").alias("dst"), "n_papers", "confidence")


def uses_method(papers: DataFrame, methods: dict[str, str]) -> DataFrame:
    """Edges from papers (id, topics, methods, summary) to canonical method names; `methods`: keyword -> name, a small lexicon."""
    hay = F.lower(F.concat_ws(" ", F.coalesce(F.array_join("topics", " "), F.lit("")), F.coalesce(F.array_join("methods", " "), F.lit("")), F.coalesce("summary", F.lit(""))))
    names = F.array_distinct(F.filter(F.array(*(F.when(F.contains(F.col("__h"), F.lit(k.lower())), F.lit(v)) for k, v in methods.items() if len(k) >= 3)), lambda x: x.isNotNull()))
    rows = papers.select("id", hay.alias("__h")).select("id", F.explode(names).alias("m")).select("id", F.concat(F.lit("method_"), T.slug(F.lower("m"))).alias("m"))
    return _edges(rows.distinct(), "id", "m", "USES_METHOD", 0.85)


def first_title_prefix(left: DataFrame, papers: DataFrame, kind: str, confidence: float, size: int = 30) -> DataFrame:
    """left (id, text) to the first paper (id, title) whose first characters its text holds."""
    p = papers.where("length(title) > 10").select("id", F.substring("title", 1, size).alias("phrase"))
    return first_phrase(left, p, kind, confidence)
