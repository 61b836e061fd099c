"""License scans on a small tree; the whole table is compared with SQL in test_text_operators."""

import pytest

from terralocus.llm import licenses


def run(spark, rows, **options):
    frame = spark.createDataFrame(rows, "path string, text string, license string, uid int")
    return {r.path: (r.license, r.origin, r.folder) for r in licenses.scanned(frame, **options).collect()}


def test_own_inherited_and_odd_files(spark):
    rows = [
        ("LICENSE", "MIT License\n\nReleased under the MIT License.\nmore words follow here in the file", None, 1),
        ("a/COPYING.txt", "Licensed under the Apache License, Version 2.0.", None, 1),
        ("a/b/readme", "x y z", None, 1), ("a/b/own.py", "# Licensed under CC BY-NC 4.0\n" + "code " * 50, "old", 1),
        ("a/b/deep/er/f", None, None, 1), ("c/f", "", None, None), ("top", "nothing " * 40_000, None, None), (None, "Released under the MIT License.", None, 1),
        ("ab/f", "license license", None, 1), ("d/short", "All rights reserved.", None, 1), ("d/other", "plain", None, 1)]
    got = run(spark, rows)
    assert got["LICENSE"][:2] == ("MIT", "own") and got["a/COPYING.txt"][:2] == ("Apache-2.0", "own")
    assert got["a/b/readme"] == ("Apache-2.0", "directory", "a") and got["a/b/deep/er/f"] == ("Apache-2.0", "directory", "a")
    assert got["a/b/own.py"][:2] == ("CC-BY-NC-4.0", "own")
    assert got["c/f"] == ("MIT", "directory", "") and got["top"] == ("MIT", "directory", "") and got["ab/f"] == ("MIT", "directory", "")
    assert got["d/short"][:2] == ("reserved", "own") and got["d/other"] == ("reserved", "directory", "d")
    assert got[None] == ("MIT", "own", None)
    assert run(spark, []) == {}


@pytest.mark.parametrize("threshold", [0.5, 0.75, 0.9])
def test_heavy_words_lose_no_line(spark, threshold):
    """Lines without a heavy word stay below the threshold for every template."""
    docs = spark.createDataFrame([(t + " " + w, ) for _, t in licenses.TEMPLATES for w in ("the", "of and", "free")], "text string")
    weight, unknown = licenses._weights(*licenses._frequencies(docs))
    heavy = set(licenses._heavy(weight, threshold))
    light = [(" ".join(w for w in sorted({x[2] for x in licenses._template_words() if x[0] == n}) if w not in heavy),) for n in range(len(licenses.TEMPLATES))]
    lines = spark.createDataFrame(light, "line string").filter("line != ''")
    assert licenses.compared(lines, weight, unknown, threshold).count() == 0


def test_repeated_rows_are_kept(spark):
    frame = spark.createDataFrame([("x", "Released under the MIT License.")] * 3 + [("x", None)], "path string, text string")
    assert sorted(str(r.origin) for r in licenses.scanned(frame).collect()) == ["directory", "own", "own", "own"]
