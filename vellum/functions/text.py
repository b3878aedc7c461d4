"""Text expressions, all evaluated in the JVM; none drops to Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = "[一-鿿]"
#: Tags whose whole body is dropped from a page.
HTML_BODIES = ["script", "style", "nav", "header", "footer", "aside", "noscript", "iframe", "form"]


def strip(c: Column) -> Column:
    """Without white space of any script at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def lines(c: Column) -> Column:
    return F.split(c, "\n", -1)


def count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def latin_words(c: Column) -> Column:
    return count(c, "[a-zA-Z]+")


def spaced_words(c: Column) -> Column:
    return F.size(F.filter(F.split(c, r"(?U)\s+", -1), lambda w: w != ""))


def cjk_chars(c: Column, extension: bool = False) -> Column:
    return count(c, "[一-鿿㐀-䶿]" if extension else CJK)


def printable_chars(c: Column) -> Column:
    return F.length(F.regexp_replace(c, r"[\p{C}\p{Z}&&[^ \n\r\t]]", ""))


def unique_chars(c: Column) -> Column:
    return F.when(F.length(c) == 0, F.lit(0)).otherwise(F.size(F.array_distinct(F.split(c, ""))))


def garbled_runs(c: Column) -> Column:
    return count(c, "[�]") + count(c, "[■-◿]") + count(c, "[À-ÿ]{4,}") + count(c, "[\\x80-\\x9f]{2,}")


def short_lines(c: Column) -> Column:
    return F.size(F.filter(lines(c), lambda x: F.length(strip(x)).between(1, 9)))


def normalized_title(c: Column) -> Column:
    """Lower case, without bracketed parts, punctuation, years; words squeezed."""
    t = F.lower(c)
    for pattern, to in ((r"\([^)]*\)", ""), (r"（[^）]*）", ""), (r"[:：]", " "), (r"[—–\-]", " "), (r"(?U)[^a-z0-9一-鿿\s]", ""), (r"(?U)\b\d{4}\b", ""), (r"(?U)\s+", " ")):
        t = F.regexp_replace(t, pattern, to)
    return strip(t)


def clean_text(c: Column) -> Column:
    """Non-breaking spaces, runs of blanks and of empty lines evened out, page marks dropped."""
    t = F.regexp_replace(c, " ", " ")
    t = F.regexp_replace(t, r"[ \t]+", " ")
    t = F.regexp_replace(t, r"\n{4,}", "\n\n\n")
    t = F.regexp_replace(t, r"第\s*\d+\s*页\s*/?\s*共\s*\d+\s*页", "")
    return strip(t)


def chunks(c: Column, size: int = 2000, overlap: int = 200) -> Column:
    """Windows of `size` characters, each beginning `overlap` before the last one ended."""
    step = size - overlap
    return F.when(F.length(c) <= size, F.array(c)).otherwise(F.transform(F.sequence(F.lit(0), F.length(c) - 1, F.lit(step)), lambda i: F.substring(c, i + 1, F.lit(size))))


def html_text(c: Column) -> Column:
    """Text of a page: navigation and code dropped, tags removed, white space squeezed."""
    t = c
    for tag in HTML_BODIES:
        t = F.regexp_replace(t, rf"(?is)<{tag}[^>]*>.*?</{tag}>", "")
    t = F.regexp_replace(t, r"(?s)<[^>]+>", " ")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def slug(c: Column, most: int = 40) -> Column:
    return F.substring(F.regexp_replace(c, r"(?U)[^\w一-鿿]", "_"), 1, most)


def safe_filename(c: Column, most: int = 80, default: str = "untitled") -> Column:
    t = F.regexp_replace(F.regexp_replace(c, r'[<>:"/\\|?*\x00-\x1f]', "_"), r"(?U)\s+", "_")
    t = F.substring(F.regexp_replace(t, r"^[._]+|[._]+$", ""), 1, most)
    return F.coalesce(F.nullif(t, F.lit("")), F.lit(default))


def paper_slug(author: Column, year: Column, title: Column, stop: list[str] | None = None) -> Column:
    """author_year_word_word of the first two title words that say something."""
    # fixed values
    stop = stop or ["the", "and", "for", "with", "from", "using", "based", "study", "analysis", "into", "over", "under", "this", "that", "are", "its"]
    words = F.filter(F.regexp_extract_all(F.lower(title), F.lit("([a-z]{3,})"), F.lit(1)), lambda w: ~w.isin(stop))
    return F.concat_ws("_", F.coalesce(F.nullif(F.regexp_replace(F.lower(author), "[^a-z]", ""), F.lit("")), F.lit("unknown")), F.coalesce(year, F.lit("nd")), F.array_join(F.slice(words, 1, 2), "_"))


def field_map(c: Column) -> Column:
    """`- **key:** value` lines as a map; the last of equal keys wins."""
    pairs = F.filter(F.transform(lines(c), lambda x: F.struct(F.regexp_replace(F.regexp_extract(x, r"^-\s+\*\*(.+?)\*\*\s*(.*)$", 1), "[:：]+$", "").alias("k"), strip(F.regexp_extract(x, r"^-\s+\*\*(.+?)\*\*\s*(.*)$", 2)).alias("v"))), lambda p: p["k"] != "")
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs) - i - 1, F.lit(0))), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(last)


def list_items(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, "[;；,，]"), strip), lambda x: x != "")


def wiki_links(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"\[\[([^\]]+)\]\]"), F.lit(1))


def kb_reference(links: Column) -> Column:
    return F.try_element_at(F.filter(F.transform(links, lambda x: F.element_at(F.split(x, "#"), -1)), lambda x: x.rlike(r"^KB-\d{4}-\d{2}-\d{2}-\d+")), F.lit(1))


def daily_reference(links: Column) -> Column:
    return F.try_element_at(F.filter(F.transform(links, lambda x: F.regexp_extract(x, r"(\d{4}-\d{2}-\d{2})_论文阅读日报", 1)), lambda x: x != ""), F.lit(1))


def local_paths(c: Column) -> Column:
    return count(c, LOCAL_PATH)


#: Drive letters and home folders.
LOCAL_PATH = r"(?i)(?<![A-Za-z0-9])[a-z]:[\\/][^\s\"'<>|]*|/(?:home|users)/[^\s\"'<>|]+"


def redact_paths(c: Column) -> Column:
    return F.regexp_replace(c, LOCAL_PATH, "<LOCAL_PATH>")


def tokens(c: Column) -> Column:
    """Latin words, Chinese runs cut into pieces of four, three and two, and acronyms once more."""
    words = F.transform(F.regexp_extract_all(c, F.lit("([a-zA-Z]{2,})"), F.lit(1)), F.lower)
    runs = F.regexp_extract_all(c, F.lit("([一-鿿]+)"), F.lit(1))
    pieces = F.flatten(F.transform(runs, lambda r: F.flatten(F.transform(F.array(F.lit(4), F.lit(3), F.lit(2)), lambda n: F.when(F.length(r) >= n, F.transform(F.sequence(F.lit(1), F.length(r) - n + 1), lambda i: F.substring(r, i, n))).otherwise(F.array().cast("array<string>"))))))
    acronyms = F.transform(F.regexp_extract_all(c, F.lit("([A-Z]{2,8})"), F.lit(1)), F.lower)
    return F.concat(words, pieces, acronyms)


def shingles(c: Column, n: Column | int) -> Column:
    """Distinct substrings of `n` characters; the whole text if it is shorter."""
    n = n if isinstance(n, Column) else F.lit(n)
    return F.when(F.length(c) < n, F.array(c)).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substring(c, i, n))))


def title_similarity(a: Column, b: Column) -> Column:
    """1 for equal; else the overlap of character pairs (single characters for short titles), at least 0.92 if one holds the other."""
    n = F.when(F.least(F.length(a), F.length(b)) < 20, F.lit(1)).otherwise(F.lit(2))
    x, y = shingles(a, n), shingles(b, n)
    j = F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))
    held = F.contains(a, b) | F.contains(b, a)
    return F.when((a == "") | (b == ""), F.lit(0.0)).when(a == b, F.lit(1.0)).when(held, F.greatest(j, F.lit(0.92))).otherwise(j)
