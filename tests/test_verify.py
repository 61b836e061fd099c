"""Differences of nested answers by path."""

from pyspark.sql import functions as F

from terralocus.operators.verify import answer_differences, leaves

SCHEMA = "point_id bigint, a struct<n:int,s:string>, list array<struct<k:string,v:double>>, tags array<string>"


def answers(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


BASE = [(1, (5, "x"), [("p", 1.0), ("q", 2.0)], ["t"]), (2, None, [], None), (3, (None, None), [("r", None)], []), (None, (1, "n"), None, None)]


def test_equal_answers_are_verified(spark):
    assert answer_differences(answers(spark, BASE), answers(spark, BASE[::-1])).count() == 0
    assert answer_differences(answers(spark, []), answers(spark, [])).count() == 0


def test_differences_by_path(spark):
    other = [(1, (6, "x"), [("p", 1.0), ("q", 2.5), ("z", None)], ["t"]), (2, (1, None), [], []), (4, None, [], None), (None, (1, "m"), None, None)]
    got = {tuple(r) for r in answer_differences(answers(spark, BASE), answers(spark, other)).collect()}
    assert got == {
        (1, "a.n", "changed", "5", "6"), (1, "list[1].v", "changed", "2.0", "2.5"), (1, "list[2].k", "added", None, "z"), (1, "list[2].v", "added", None, None),
        (2, "a", "missing", None, None), (2, "a.n", "added", None, "1"), (2, "a.s", "added", None, None), (2, "tags", "changed", None, "[]"),
        (3, "", "missing", None, None), (4, "", "added", None, None), (None, "a.s", "changed", "n", "m")}


def test_columns_of_one_side(spark):
    more = answers(spark, BASE).withColumn("extra", F.lit(7))
    got = {(r["point_id"], r["path"], r["kind"]) for r in answer_differences(answers(spark, BASE), more).collect()}
    assert got == {(i, "extra", "added") for i in (1, 2, 3, None)}


def test_leaves(spark):
    rows = {(r["path"], r["value"]) for r in leaves(answers(spark, BASE[:1]), "point_id").collect()}
    assert rows == {("a.n", "5"), ("a.s", "x"), ("list[0].k", "p"), ("list[0].v", "1.0"), ("list[1].k", "q"), ("list[1].v", "2.0"), ("tags[0]", "t")}
