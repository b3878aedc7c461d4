"""Further queries of the core over the test tables: duplicates of several stores, levels, gates, snippets, links, graph figures, state."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.functions import lexicons as L
from vellum.functions import text as T
from vellum.operators import curation as C
from vellum.operators import dedup, graph, links, stats
from vellum.queries import _CTX, _DEG, _EDGES, _GATE, _N, _NODES, _REL, _tpc_graph, query
from vellum.runtime import table
from vellum.sources import sinks

_SPACE = r"[\s\p{Z}\x{0b}\x{1c}-\x{1f}\x{85}]"


def normalized(c: str) -> str:
    """SQL of text.normalized_title; a year is a word of four digits once only letters, digits and spaces are left."""
    t = rf"regexp_replace(regexp_replace(regexp_replace(lower({c}), '\([^)]*\)', '', 'g'), '（[^）]*）', '', 'g'), '[:：—–\-]', ' ', 'g')"
    t = rf"regexp_replace({t}, '[^a-z0-9一-鿿\s\p{{Z}}\x{{0b}}\x{{1c}}-\x{{1f}}\x{{85}}]', '', 'g')"
    return rf"array_to_string(list_filter(string_split_regex({t}, '{_SPACE}+'), lambda w: w <> '' and not regexp_full_match(w, '[0-9]{{4}}')), ' ')"


# --- duplicates ---


@query("seen_normalized_titles", f"select paper_id, {normalized('title')} as norm_title from seen_papers")
def seen_normalized_titles(spark, d):
    return table(spark, d, "seen_papers").select("paper_id", T.normalized_title(F.col("title")).alias("norm_title"))


_LOW = "select paper_id, lower(trim(doi)) doi, lower(trim(arxiv_id)) arxiv_id"


@query("cand_duplicate_reason", f"""
  with s as ({_LOW}, {normalized('title')} t from seen_papers), c as (select cand_id, paper_id, lower(trim(doi)) doi, lower(trim(arxiv_id)) arxiv_id, {normalized('title')} t from candidates),
  r as (select cand_id, case when paper_id <> '' and paper_id in (select paper_id from s where paper_id is not null) then 'id' when doi <> '' and doi in (select doi from s where doi is not null) then 'doi'
    when arxiv_id <> '' and arxiv_id in (select arxiv_id from s where arxiv_id is not null) then 'arxiv' when t <> '' and t in (select t from s where t is not null) then 'title' end as reason from c)
  select * from r where reason is not null""")
def cand_duplicate_reason(spark, d):
    return dedup.duplicate_reasons(table(spark, d, "candidates"), table(spark, d, "seen_papers"), "cand_id")


@query("cand_redelivered", f"""
  with x as (select cand_id, batch_no, paper_id, lower(trim(doi)) doi, lower(trim(arxiv_id)) arxiv_id, lower(trim(url)) url, lower(trim(pdf_url)) pdf_url, {normalized('title')} t from candidates), s as (select * from x where batch_no <= 5),
  r as (select cand_id, case when paper_id <> '' and paper_id in (select paper_id from s where paper_id is not null) then 'id' when doi <> '' and doi in (select doi from s where doi is not null) then 'doi'
    when arxiv_id <> '' and arxiv_id in (select arxiv_id from s where arxiv_id is not null) then 'arxiv' when url <> '' and url in (select url from s where url is not null) then 'url'
    when pdf_url <> '' and pdf_url in (select pdf_url from s where pdf_url is not null) then 'pdf' when t <> '' and t in (select t from s where t is not null) then 'title' end as reason from x where batch_no > 5)
  select * from r where reason is not null""")
def cand_redelivered(spark, d):
    # the later half of the batches against the earlier half, by every key
    c = table(spark, d, "candidates")
    return dedup.duplicate_reasons(c.where("batch_no > 5"), c.where("batch_no <= 5"), "cand_id")


@query("cand_unseen_first", "select cand_id from (select cand_id, row_number() over (partition by paper_id order by cand_id) r, paper_id from candidates where paper_id is null or paper_id not in (select paper_id from seen_papers where paper_id is not null)) where r = 1 or paper_id is null")
def cand_unseen_first(spark, d):
    return C.first_unseen(table(spark, d, "candidates"), table(spark, d, "seen_papers"), "paper_id", "cand_id").select("cand_id")


@query("cand_store_duplicates", f"""
  with c as (select cand_id, trim(doi) doi, {normalized('title')} t from candidates), p as (select trim(doi) doi, {normalized('title')} t from papers),
  h as (select distinct c.t from (select distinct t from c where length(t) > 40) c join (select distinct t from p where length(t) > 40) p on contains(c.t, p.t) or contains(p.t, c.t)),
  r as (select cand_id, case when doi <> '' and doi in (select doi from p where doi is not null) then 'doi' when t <> '' and t in (select t from p where t is not null) then 'title' when t in (select t from h) then 'held' end as reason from c)
  select * from r where reason is not null""")
def cand_store_duplicates(spark, d):
    return C.store_duplicates(table(spark, d, "candidates"), table(spark, d, "papers"), "cand_id")


@query("cand_index_duplicates", """
  with s as (select doi, arxiv_id, substring(lower(trim(title)), 1, 60) t from seen_papers where length(title) > 20), s0 as (select * from seen_papers)
  select cand_id from candidates where (doi <> '' and doi in (select doi from s0 where doi is not null)) or (arxiv_id <> '' and arxiv_id in (select arxiv_id from s0 where arxiv_id is not null)) or (length(title) > 20 and substring(lower(trim(title)), 1, 60) in (select t from s))""")
def cand_index_duplicates(spark, d):
    return C.index_duplicates(table(spark, d, "candidates"), table(spark, d, "seen_papers"), "cand_id")


# --- levels, counts, gates ---

_WORDS = "coalesce(len(regexp_extract_all(text, '[a-zA-Z]+')), 0)"
_DONE = "(case when source_file is null or source_file = '' then 'no_url' when error <> '' then 'failed' else 'downloaded' end)"
_READ = "(case when text is null then 'failed' else 'success' end)"
_NAMES = "list_transform(map_keys(sections), lambda x: lower(x))"


def _sections_sql(names):
    return "(" + " or ".join(f"list_contains({_NAMES}, '{n}')" for n in names) + ")"


_KEY = " + ".join(f"(case when list_contains({_NAMES}, '{n}') then 1 else 0 end)" for n in ("abstract", "introduction", "methods", "results", "discussion", "conclusion"))
_LEVEL = f"""(case when {_DONE} = 'no_url' then 'META_ONLY' when {_DONE} = 'failed' or {_READ} = 'failed' then 'ABSTRACT_ONLY'
  when ({_WORDS} >= 2000 or length(text) >= 15000) and coalesce({_KEY}, 0) >= 3 and coalesce({_sections_sql(['methods', 'data'])}, false) and coalesce({_sections_sql(['results', 'discussion', 'conclusion'])}, false) then 'PDF_TEXT_FULL'
  when length(text) > 500 then 'PDF_TEXT_PARTIAL' else 'ABSTRACT_ONLY' end)"""


def _leveled(spark, d):
    """Extraction results, once each, with download, extraction and the level they amount to."""
    r = table(spark, d, "extraction_results")
    names = F.transform(F.map_keys("sections"), F.lower)
    has = lambda *n: F.coalesce(F.arrays_overlap(names, F.array(*map(F.lit, n))), F.lit(False))
    key = F.size(F.array_intersect(names, F.array(*map(F.lit, ["abstract", "introduction", "methods", "results", "discussion", "conclusion"]))))
    download = F.when(F.coalesce("source_file", F.lit("")) == "", "no_url").when(F.coalesce("error", F.lit("")) != "", "failed").otherwise("downloaded")
    r = r.withColumns({"download": download, "extraction": F.when(F.col("text").isNull(), "failed").otherwise("success"), "words": T.latin_words(F.col("text"))})
    level = C.reading_level(F.col("download"), F.col("extraction"), F.lit(False), F.length("text"), F.col("words"), F.coalesce(key, F.lit(0)), has("methods", "data"), has("results", "discussion", "conclusion"), F.lit(False))
    return r.withColumn("reading_level", level)


@query("result_reading_levels", f"select distinct result_id, {_LEVEL} as level from extraction_results")
def result_reading_levels(spark, d):
    return _leveled(spark, d).select("result_id", F.col("reading_level").alias("level")).distinct()


@query("result_fulltext_stats", f"""with x as (select {_LEVEL} l, {_DONE} d, {_READ} e, coalesce(ocr_required, false) o from extraction_results) select count(*) as total, count(*) filter (d <> 'no_url') as attempted, count(*) filter (d = 'downloaded') as downloaded, count(*) filter (d = 'failed') as download_failed,
  count(*) filter (l = 'PDF_TEXT_FULL') as pdf_text_full, count(*) filter (l = 'PDF_TEXT_PARTIAL') as pdf_text_partial, count(*) filter (l = 'ABSTRACT_ONLY') as abstract_only, count(*) filter (l = 'META_ONLY') as meta_only, count(*) filter (d = 'downloaded' and e = 'failed') as parse_failed, count(*) filter (o) as ocr_needed from x""")
def result_fulltext_stats(spark, d):
    return C.fulltext_stats(_leveled(spark, d))


_STATUS = "(case when error <> '' then 'failed' when text is null then 'skipped' when quality_score < 0.3 then 'low_quality' else 'success' end)"


@query("result_status_counts", f"select count(*) filter (s in ('success', 'low_quality')) as success, count(*) filter (s = 'skipped') as skipped, count(*) filter (s = 'failed') as failed from (select {_STATUS} s from extraction_results)")
def result_status_counts(spark, d):
    status = F.when(F.coalesce("error", F.lit("")) != "", "failed").when(F.col("text").isNull(), "skipped").when(F.col("quality_score") < 0.3, "low_quality").otherwise("success")
    return C.status_counts(table(spark, d, "extraction_results").select(status.alias("status")))


@query("seen_totals", "select count(*) as papers, count(distinct case when date_seen <> '' then date_seen end) as days from seen_papers")
def seen_totals(spark, d):
    return table(spark, d, "seen_papers").agg(F.count("*").alias("papers"), F.count_distinct(F.nullif("date_seen", F.lit(""))).alias("days"))


@query("entity_summary", "select string_agg(t || ': ' || n, ', ' order by t) as summary from (select entity_type t, count(*) n from (select id, entity_type from terms union all select distinct id, entity_type from papers) where entity_type <> '' group by 1)")
def entity_summary(spark, d):
    e = table(spark, d, "terms").select("id", "entity_type").unionByName(table(spark, d, "papers").select("id", "entity_type").distinct())
    n = e.where("entity_type <> ''").groupBy("entity_type").agg(F.count("*").alias("n"))
    # one row a type
    parts = F.array_sort(F.collect_list(F.struct("entity_type", "n")))
    return n.agg(F.array_join(F.transform(parts, lambda x: F.concat(x["entity_type"], F.lit(": "), x["n"].cast("string"))), ", ").alias("summary"))


@query("doc_placeholders", "select doc_id, cast(" + " + ".join(f"(case when contains(text, '{p}') then 1 else 0 end)" for p in C.PLACEHOLDERS) + " as integer) as n from documents where text is not null")
def doc_placeholders(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", C.placeholders(F.col("text")).alias("n"))


_SCORE = f"cast(case when {_GATE} then 0 else least(100, {_REL} + 3 * {L.sql_hits(_CTX, L.METHOD_WORDS)} + 3 * {L.sql_hits(_CTX, L.TOOL_WORDS)} + 2 * {L.sql_hits(_CTX, L.CROSS_WORDS)} + (case when year = '2026' then 6 when year = '2025' then 3 else 0 end) + (case when {_N} > 100 then 3 else 0 end)) end as integer)"


@query("cand_selection_funnel", f"""with x as (select {_SCORE} score, reading_level, coalesce(full_text_read, false) f from candidates) select 'found' as stage, count(*) as n from x union all select 'relevant', count(*) filter (score > 0) from x
  union all select 'full_text', count(*) filter (score > 0 and reading_level in ('PDF_TEXT_FULL', 'HUMAN_CONFIRMED')) from x union all select 'read', count(*) filter (f) from x""")
def cand_selection_funnel(spark, d):
    from vellum.operators import scoring

    c = table(spark, d, "candidates")
    return stats.selection_funnel(c.withColumn("score", scoring.relevance(F.col("title"), F.col("abstract"), F.col("year"))))


@query("cand_curated_topk", f"""
  with s as ({_LOW}, {normalized('title')} t from seen_papers), c as (select cand_id, title, paper_id, lower(trim(doi)) doi, lower(trim(arxiv_id)) arxiv_id, {normalized('title')} t, {_SCORE} score from candidates),
  f as (select * from c where score > 0 and t <> '' and not coalesce(paper_id <> '' and paper_id in (select paper_id from s where paper_id is not null), false) and not coalesce(doi <> '' and doi in (select doi from s where doi is not null), false)
    and not coalesce(arxiv_id <> '' and arxiv_id in (select arxiv_id from s where arxiv_id is not null), false) and t not in (select t from s where t is not null)),
  one as (select *, row_number() over (partition by t order by cand_id) r from f)
  select cand_id, title, score from one where r = 1 order by score desc, cand_id limit 5""")
def cand_curated_topk(spark, d):
    from vellum.plans import pipelines

    return pipelines.curated(table(spark, d, "candidates"), table(spark, d, "seen_papers"))


# --- labels and snippets ---

_INNOCTX = "lower(concat(coalesce(title, ''), ' ', coalesce(abstract, ''), ' ', coalesce(keywords, ''), ' ', coalesce(category, '')))"


@query("cand_innovations", "select cand_id, array_to_string(list_slice(list_filter([" + ", ".join("case when " + " and ".join(L.sql_any(_INNOCTX, g) for g in groups) + f" then '{text}' end" for _, text, groups in C.INNOVATION_RULES) + "], lambda x: x is not null), 1, 3), '|') as texts from candidates")
def cand_innovations(spark, d):
    ctx = F.lower(F.concat_ws(" ", *(F.coalesce(c, F.lit("")) for c in ("title", "abstract", "keywords", "category"))))
    return table(spark, d, "candidates").select("cand_id", F.array_join(F.transform(C.innovations(ctx), lambda x: x["text"]), "|").alias("texts"))


_METHOD_LIST = {"random forest": "Random Forest", "gradient boosting": "Gradient Boosting", "kriging": "Kriging", "regression": "Regression", "radar": "Sentinel", "drone": "UAV", "随机森林": "Random Forest", "gis": "GIS"}


@query("paper_method_families", "with m as (select distinct trim(unnest(methods)) m from papers), c as (select m, case " + " ".join(f"when lower(m) = '{k}' then '{v}'" for k, v in _METHOD_LIST.items()) + " " + " ".join(f"when contains(lower(m), '{k}') then '{v}'" for k, v in _METHOD_LIST.items() if len(k) > 3) + " end as canonical from m where m <> '') select m as method, canonical, case " + " ".join("when " + " or ".join(f"contains(canonical, '{w.replace(chr(39), chr(39) * 2)}')" for w in ws) + f" then '{f}'" for f, ws in C.METHOD_FAMILIES.items()) + " else 'Statistics' end as family from c where canonical is not null")
def paper_method_families(spark, d):
    m = table(spark, d, "papers").select(F.explode("methods").alias("method")).select(F.trim("method").alias("method")).where("method <> ''").distinct()
    c = m.withColumn("canonical", C.canonical_method(F.col("method"), _METHOD_LIST)).where("canonical is not null")
    return c.withColumn("family", C.method_family(F.col("canonical")))


_BODY = "select result_id, k, v from (select result_id, unnest(map_keys(sections)) k, unnest(map_values(sections)) v from (select distinct result_id, sections from extraction_results))"
_SENT = r"list_transform(string_split(regexp_replace(v, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s, ' ' || chr(9) || chr(10) || chr(12) || chr(13)))"


def _bodies(spark, d):
    r = table(spark, d, "extraction_results").select("result_id", F.explode("sections").alias("k", "v"))
    return r.withColumn("k", F.col("k")).where("v is not null").distinct()


@query("section_result_sentences", f"select result_id, k as section, array_to_string(list_slice(list_filter({_SENT}, lambda s: length(s) > 30 and " + L.sql_any("lower(s)", C.RESULT_WORDS) + f"), 1, 5), '|') as sentences from ({_BODY}) where v is not null")
def section_result_sentences(spark, d):
    return _bodies(spark, d).select("result_id", F.col("k").alias("section"), F.array_join(C.result_sentences(F.col("v")), "|").alias("sentences"))


@query("section_conclusions", f"select result_id, k as section, array_to_string(list_slice(list_filter({_SENT}, lambda s: length(s) > 30), 1, 3), '|') as sentences from ({_BODY}) where v is not null")
def section_conclusions(spark, d):
    return _bodies(spark, d).select("result_id", F.col("k").alias("section"), F.array_join(C.conclusion_sentences(F.col("v")), "|").alias("sentences"))


@query("doc_limitations", rf"select doc_id, len(list_slice(regexp_extract_all(text, '(?i)([^.]*?{C.LIMITATION}[^.]*\.)', 1), 1, 3)) as n from documents where text is not null")
def doc_limitations(spark, d):
    found = F.regexp_extract_all(F.col("text"), F.lit(rf"(?i)([^.]*?{C.LIMITATION}[^.]*\.)"), F.lit(1))
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.size(F.slice(found, 1, 3)).cast("long").alias("n"))


@query("cand_source_status", "select cand_id, case when pdf_url <> '' then 'pdf' when url <> '' then 'html' when doi <> '' then 'metadata' else 'none' end as status from candidates")
def cand_source_status(spark, d):
    return table(spark, d, "candidates").select("cand_id", C.source_status(F.col("pdf_url"), F.col("url"), F.col("doi")).alias("status"))


@query("doc_themes", r"select doc_id, list_last(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_extract(x, '^-\s+\*\*主题:\*\*\s*([^\n]*)', 1), ' ' || chr(9) || chr(13))), lambda x: x <> '')) as theme from documents where text is not null and regexp_matches(text, '(?m)^-\s+\*\*主题:\*\*\s*\S')")
def doc_themes(spark, d):
    t = table(spark, d, "documents").where("text is not null").select("doc_id", T.field_map(F.col("text"))["主题"].alias("theme"))
    return t.where("theme <> ''")


# --- links ---


@query("papers_shared_work", """with e as (select distinct id, lower(unnest(list_concat(coalesce(topics, []), coalesce(methods, [])))) t from papers), m as (select a.id as src, b.id as dst, list_sort(list(a.t)) l from e a join e b on a.t = b.t and a.id < b.id where a.t <> '' group by 1, 2 having count(*) >= 2)
  select src, dst, 'SHARES_TOPIC' as type, cast(least(0.9, round_even(0.5 + 0.1 * len(l), 1)) as double) as confidence, array_to_string(list_slice(l, 1, 5), '|') as shared from m""")
def papers_shared_work(spark, d):
    none = F.array().cast("array<string>")
    p = table(spark, d, "papers").groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list(F.concat(F.coalesce("topics", none), F.coalesce("methods", none))))).alias("work"))
    return links.shared_items(p, "work", 2, "SHARES_TOPIC").withColumn("shared", F.array_join("shared", "|"))


@query("records_title_prefix", "with p as (select distinct id, lower(substring(title, 1, 30)) k from papers where length(title) > 10) select cast(r.item_id as varchar) as src, min(p.id) as dst, 'RECORDS' as type, cast(0.8 as double) as confidence from (select distinct item_id, lower(title) t from reading_list where title <> '') r join p on contains(r.t, p.k) group by 1")
def records_title_prefix(spark, d):
    r = table(spark, d, "reading_list").where("title is not null").select(F.col("item_id").cast("string").alias("id"), F.col("title").alias("text")).distinct()
    return links.first_title_prefix(r, table(spark, d, "papers"), "RECORDS", 0.8)


@query("docs_governed_by", "with w as (select min(id) as id, p from (select id, lower(unnest(topics)) p from papers) where length(p) > 3 group by p) select cast(d.doc_id as varchar) as src, min(w.id) as dst, 'GOVERNED_BY' as type, cast(0.4 as double) as confidence from documents d join w on contains(lower(d.text), w.p) group by 1")
def docs_governed_by(spark, d):
    docs = table(spark, d, "documents").where("text is not null").select(F.col("doc_id").cast("string").alias("id"), "text")
    topics = table(spark, d, "papers").select("id", F.explode("topics").alias("phrase")).where("length(phrase) > 3")
    return links.first_phrase(docs, topics.groupBy(F.lower("phrase").alias("phrase")).agg(F.min("id").alias("id")), "GOVERNED_BY", 0.4)


@query("records_last_daily", "select distinct cast(r.item_id as varchar) as src, p.d as dst, 'FROM_DAILY' as type, cast(0.7 as double) as confidence from reading_list r join (select kb_date, max(id) d from papers where kb_date <> '' group by 1) p on r.date = p.kb_date")
def records_last_daily(spark, d):
    a = table(spark, d, "reading_list").select(F.col("item_id").cast("string").alias("id"), "date").distinct()
    return links.last_per_date(a, table(spark, d, "papers").select("id", F.col("kb_date").alias("date")), "FROM_DAILY", 0.7)


@query("terms_same_kind", "select f.s as src, t.id as dst, 'SAME_DOMAIN' as type, cast(0.3 as double) as confidence from terms t join (select entity_type, min(id) s from terms where entity_type <> '' group by 1) f on t.entity_type = f.entity_type where t.id <> f.s")
def terms_same_kind(spark, d):
    return links.group_star(table(spark, d, "terms"), "entity_type", "SAME_DOMAIN", 0.3)


@query("seen_same_source", r"with s as (select distinct paper_id as id, regexp_replace(doi, '/[^/]*$', '') k from seen_papers where contains(doi, '/')) select f.s as src, s.id as dst, 'SAME_SOURCE' as type, cast(0.3 as double) as confidence from s join (select k, min(id) s from s group by 1) f on s.k = f.k where s.id <> f.s")
def seen_same_source(spark, d):
    # what stands before the last slash of a path-like value
    s = table(spark, d, "seen_papers").where("contains(doi, '/')").select(F.col("paper_id").alias("id"), F.regexp_replace("doi", "/[^/]*$", "").alias("dir"))
    return links.group_star(s, "dir", "SAME_SOURCE", 0.3)


@query("terms_derived_from", r"with s as (select id, lower(regexp_replace(unnest(list_distinct(sources)), '\([^)]*\)', '', 'g')) x from terms), w as (select distinct id, unnest(string_split(x, ' ')) w from s), p as (select distinct id, lower(concat_ws(chr(10), title, authors)) t from papers) select distinct w.id as src, p.id as dst, 'DERIVED_FROM' as type, cast(0.7 as double) as confidence from w join p on contains(p.t, w.w) where length(w.w) > 2")
def terms_derived_from(spark, d):
    return links.source_tokens(table(spark, d, "terms"), table(spark, d, "papers"), "DERIVED_FROM", 0.7)


_CONCEPTS = {"erosion": "soil", "snow": "snow", "forest": "forest", "radar": "radar", "侵蚀": "土壤", "植被": "植被", "降雨": "降雨", "gully": "gully", "flood": "flood"}


@query("docs_concept_links", "with k(keyword, word) as (values " + ", ".join(f"('{a}', '{b}')" for a, b in _CONCEPTS.items()) + "), t as (select keyword, direction_id, row_number() over (partition by keyword order by direction_id) r from k join research_directions on contains(lower(name), word)) select distinct cast(doc_id as varchar) as src, t.direction_id as dst, 'CONCEPT_LINK' as type, cast(0.4 as double) as confidence from documents join t on contains(lower(text), keyword) where r <= 5")
def docs_concept_links(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), "text")
    return C.keyword_targets(docs, table(spark, d, "research_directions").select(F.col("direction_id").alias("id"), "name"), _CONCEPTS, "CONCEPT_LINK", 0.4)


@query("whole_graph_types")
def whole_graph_types(spark, d):
    from vellum.plans import pipelines
    from vellum.queries import METHODS

    records = table(spark, d, "reading_list").groupBy(F.concat(F.lit("R-"), F.col("item_id").cast("string")).alias("id")).agg(F.min("title").alias("title"), F.min("date").alias("date"))
    return pipelines.knowledge_graph_types(table(spark, d, "papers"), table(spark, d, "terms"), table(spark, d, "research_directions"), METHODS, records)


# --- graph figures ---


@query("graph_components", f"with {_NODES}, m as (select 's' || s_suppkey id, 'r' || n_regionkey r from supplier join nation on s_nationkey = n_nationkey union all select 'c' || c_custkey, 'r' || n_regionkey from customer join nation on c_nationkey = n_nationkey union all select 'n' || n_nationkey, 'r' || n_regionkey from nation union all select 'r' || r_regionkey, 'r' || r_regionkey from region), g as (select r, min(id) as component from m group by 1) select m.id, g.component from m join g using (r)")
def graph_components(spark, d):
    return graph.components(*_tpc_graph(spark, d))


@query("graph_stats", f"with {_NODES}, {_EDGES}, {_DEG}, m as (select 's' || s_suppkey id, n_regionkey r from supplier join nation on s_nationkey = n_nationkey union all select 'c' || c_custkey, n_regionkey from customer join nation on c_nationkey = n_nationkey union all select 'n' || n_nationkey, n_regionkey from nation union all select 'r' || r_regionkey, r_regionkey from region) select 'nodes' as measure, count(*) as value from nodes union all select 'edges', count(*) from edges union all select 'components', count(distinct r) from m union all select 'largest_component', max(n) from (select count(*) n from m group by r) union all select 'isolated', count(*) from nodes where id not in (select id from deg)")
def graph_stats(spark, d):
    return graph.stats(*_tpc_graph(spark, d))


@query("graph_top_degree", f"with {_EDGES}, {_DEG} select id, n as degree from deg order by n desc, id limit 10")
def graph_top_degree(spark, d):
    return graph.degrees(*_tpc_graph(spark, d)).orderBy(F.desc("degree"), "id").limit(10)


@query("graph_search", f"with {_NODES}, {_EDGES}, {_DEG} select id, entity_type, label, cast(coalesce(n, 0) as bigint) as degree from nodes left join deg using (id) where contains(lower(concat_ws(' ', id, label)), 'n1') and entity_type in ('Nation', 'Region', 'Customer') order by degree desc, id limit 20")
def graph_search(spark, d):
    return graph.search(*_tpc_graph(spark, d), "N1", ["id", "label"], types=["Nation", "Region", "Customer"])


@query("export_canvas", f"with {_NODES}, {_EDGES}, {_DEG}, t as (select id, row_number() over (order by coalesce(n, 0) desc, id) - 1 as k from nodes left join deg using (id) qualify k < 100) select id, cast(k % 8 * 320 as integer) as x, cast(k // 8 * 220 as integer) as y, '#999999' as colour from t")
def export_canvas(spark, d):
    return sinks.canvas_layout(*_tpc_graph(spark, d))


@query("graph_health", f"""with {_NODES}, {_EDGES}, {_DEG}, iso as (select entity_type, count(*) n, count(*) filter (where d.n is null) i from nodes left join deg d using (id) group by 1),
  found as (select 'isolated_type' as kind, entity_type as subject, 'anomaly' as level from iso where i * 1000 // n > 500
    union all select distinct 'unknown_type', entity_type, 'anomaly' from nodes where entity_type not in ('Supplier', 'Customer', 'Nation')
    union all select 'empty_label', cast(count(*) as varchar), 'anomaly' from nodes where label is null or label = '' having count(*) > 0
    union all select 'isolation', 'all', case when sum(i) * 5 > sum(n) then 'critical' else 'warning' end from iso having sum(i) * 10 > sum(n)
    union all select 'sparse', 'all', 'anomaly' where (select count(*) from edges) < (select count(*) from nodes))
  select * from found union all select 'overall', 'all', case when count(*) filter (level = 'critical') > 0 then 'RED' when count(*) filter (level <> 'critical') >= 3 then 'YELLOW' else 'GREEN' end from found""")
def graph_health(spark, d):
    # regions are not among the known types here
    return graph.health(*_tpc_graph(spark, d), ["Supplier", "Customer", "Nation"])


@query("export_mermaid", rf"""with {_NODES}, {_EDGES}, {_DEG}, t as (select id, label, row_number() over (order by coalesce(n, 0) desc, id) k from nodes left join deg using (id) qualify k <= 80),
  e as (select a.k a, b.k b, e.type, row_number() over (order by e.src, e.dst, e.type) r from edges e join t a on a.id = e.src join t b on b.id = e.dst qualify r <= 200)
  select cast(0 as bigint) as ord, 'graph LR' as line union all select k, '  n' || k || '["' || substring(regexp_replace(coalesce(label, id), '["\[\]{{}}()<>|#;`
]', ' ', 'g'), 1, 40) || '"]' from t union all select 1000000 + r, '  n' || a || ' -->|' || type || '| n' || b from e""")
def export_mermaid(spark, d):
    return sinks.mermaid_lines(*_tpc_graph(spark, d))


# --- report ---


@query("cand_report_sections", f"""
  with c as (select cand_id, coalesce(title, '') t, coalesce(keywords, '') k, coalesce(reading_level, '') l, coalesce(pdf_url, '') p, {_SCORE} score from candidates),
  part as (select '3 selected' section, 5 m, * from c where score > 0 union all select '4 read', 20, * from c where l in ('PDF_TEXT_FULL', 'HUMAN_CONFIRMED') union all select '5 next', 10, * from c where score >= 40 and p <> '' union all select '6 queue', 10, * from c where score >= 25 and p = '' union all select '7 left out', 15, * from c where score = 0),
  r as (select *, row_number() over (partition by section order by score desc, cand_id) as ord from part)
  select '1 overview' as section, cast(1 as bigint) as ord, count(*) || ' found, ' || count(*) filter (score > 0) || ' relevant, ' || count(*) filter (l = 'PDF_TEXT_FULL') || ' in full' as line from c
  union all select '2 by query', row_number() over (order by count(*) desc, k), k || ': ' || count(*) from c group by k union all select '8 by level', row_number() over (order by count(*) desc, l), l || ': ' || count(*) from c group by l
  union all select section, ord, cand_id || ' | ' || score || ' | ' || t from r where ord <= m""")
def cand_report_sections(spark, d):
    from vellum.operators import scoring

    c = table(spark, d, "candidates").withColumn("score", scoring.relevance(F.col("title"), F.col("abstract"), F.col("year")).cast("int"))
    return sinks.report_sections(c)


@query("paper_dated_entries", "with p as (select distinct id, title, summary, kb_date d from papers where kb_date <> '') select d as date, cast(0 as bigint) as ord, '## ' || d as line from (select distinct d from p) union all select d, row_number() over (partition by d order by id), '### ' || id || ' ' || coalesce(title, '') || chr(10) || '- **summary:** ' || coalesce(summary, '') from p")
def paper_dated_entries(spark, d):
    return sinks.dated_entries(table(spark, d, "papers").select("id", "title", "summary", F.col("kb_date").alias("date")).distinct())


# --- texts again ---


@query("doc_chunk_counts", "select doc_id, cast(case when length(text) <= 2000 then 1 else (length(text) - 1) // 1800 + 1 end as bigint) as n from documents where text is not null")
def doc_chunk_counts(spark, d):
    return sinks.chunk_lines(table(spark, d, "documents"), "doc_id").groupBy("doc_id").agg(F.count("*").alias("n"))


@query("doc_repeated", "select doc_id, count(*) over (partition by text) as copies from documents where text <> ''")
def doc_repeated(spark, d):
    t = table(spark, d, "documents").where("text <> ''").select("doc_id", "text")
    n = t.groupBy("text").agg(F.count("*").alias("copies"))
    return t.join(n, "text").select("doc_id", "copies")
