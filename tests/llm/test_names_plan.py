"""The pairs of problem 7: no side goes through the driver."""

from vellum.llm import names


def test_p7_found_pairs_without_broadcast(spark):
    groups = spark.createDataFrame([("author", "A. Bee", 1), ("author", "Bee, A", 1), ("author", "C. Dee", 2), ("venue", "A. Bee", 1)], "kind string, name string, grp long")
    df = names.variant_pairs(groups)
    rows = [tuple(r) for r in df.collect()]
    assert rows == [("author", "A. Bee", "Bee, A")]
    assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_given_names_pass_by_the_driver(spark, monkeypatch):
    from pyspark import SparkContext
    from pyspark.sql import DataFrame

    def never(*a, **k):
        raise AssertionError("words are sent through the driver")

    monkeypatch.setattr(DataFrame, "toArrow", never)
    monkeypatch.setattr(SparkContext, "broadcast", never)
    # a given name of no list, known by the families beside it; a slip of it is put right
    rows = [f"Quirelda {f}" for f in ("Sotaro", "Benolu", "Kamivi", "Dorpane", "Lusetti", "Varimo")] + ["Sotaro Quirelda", "Quireda Sotaro"]
    groups = {r["name"]: r["grp"] for r in names.group_spellings(spark.createDataFrame([("author", x) for x in rows], "kind string, name string")).toLocalIterator()}
    assert len(groups) == 8 and len({groups[x] for x in ("Quirelda Sotaro", "Sotaro Quirelda", "Quireda Sotaro")}) == 1
    assert len(set(groups.values())) == 6
