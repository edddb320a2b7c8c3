"""Rules as tables against the rules as expressions."""

import random
import re

from pyspark.sql import functions as F

from veriloom.functions.text import glob_regex
from veriloom.operators import review, rules


def test_first_banned_equals_the_expression(spark):
    rng = random.Random(3)
    word = lambda: ".".join(rng.choice("ab_") for _ in range(rng.randint(1, 4)))
    banned = [(word(), f"r{k}") for k in range(40)]
    names = spark.createDataFrame([(i, word()) for i in range(300)] + [(300, None), (301, ""), (302, "a."), (303, "ab.a")], "i int, name string")
    table = spark.createDataFrame([(k, rule, label) for k, (rule, label) in enumerate(banned)] + [(-1, None, "null")], "rank int, rule string, label string")
    want = {r.i: r.w for r in names.withColumn("w", review.banned_module(F.col("name"), banned)).collect()}
    got = rules.first_banned(names, "name", table)
    assert got.columns == ["i", "name", "label"] and {r.i: r.label for r in got.collect()} == want
    assert rules.first_banned(names, "name", table.limit(0)).where("label is not null").count() == 0


def test_matched_equals_the_regex(spark):
    rng = random.Random(5)
    paths = ["/".join(rng.choice(["a", "b.py", "c+", "d(", "e$x"]) for _ in range(rng.randint(1, 4))) for _ in range(200)] + ["", "a/", "/a", "a\\b"]
    globs = ["a/**", "**/b.py", "a/?+", "c+/d(", "**", "e$x/*", "*", "/a", "a/*/**.py", "b.py/?", "[a]", "a\\b", ""]
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(paths)] + [(999, None)], "i int, path string")
    for some in ([g] for g in globs):
        table = spark.createDataFrame([(g,) for g in some], "glob string")
        want = {i for i, p in enumerate(paths) if any(re.fullmatch(glob_regex(g)[1:-1], p, re.S) for g in some)}
        assert {r.i for r in rules.matched(rows, "path", table).collect()} == want, some
    several = spark.createDataFrame([(g,) for g in globs[:4] + globs[5:6]] + [(None,)], "glob string")
    inside, outside = ({r.i for r in rules.matched(rows, "path", several, how).collect()} for how in ("left_semi", "left_anti"))
    assert inside | outside == {*range(len(paths)), 999} and not inside & outside and 999 in outside


def test_matched_meets_by_all_fixed_characters(spark, monkeypatch):
    rng = random.Random(7)
    paths = sorted({"/".join(rng.choice(["a", "b", "ab", "é", "x.py", "", "*", "a\nb"]) for _ in range(rng.randint(1, 4))) for _ in range(300)})
    globs = sorted({"".join(rng.choice(["a", "b", "/", "/", "?", "*", "**", "é", ".py"]) for _ in range(rng.randint(0, 7))) for _ in range(400)})
    rows = spark.createDataFrame([(p,) for p in paths], "path string")
    for some in (globs[:5], globs):
        want = {p for p in paths if any(re.fullmatch(glob_regex(g)[1:-1], p, re.S) for g in some)}
        assert {r.path for r in rules.matched(rows, "path", spark.createDataFrame([(g,) for g in some], "glob string")).collect()} == want

    def tests(n):  # rows that are tested by a regex
        seen = spark.sparkContext.accumulator(0)
        monkeypatch.setattr(rules.F, "regexp_like", lambda p, q: F.udf(lambda x, y: seen.add(1) or re.search(y.replace(r"\z", r"\Z"), x) is not None, "boolean")(F.col(p), q))
        some = spark.range(n).select(F.format_string("en/%d", "id").alias("path"))
        table = some.select(F.explode(F.array(F.concat(F.lit("?"), F.substring("path", 2, 20), F.lit("+")), F.concat(F.lit("en/**."), F.substring("path", 4, 20)), F.concat(F.lit("*/x"), F.substring("path", 4, 20)))).alias("glob"))
        assert rules.matched(some, "path", table).count() == 0
        monkeypatch.undo()
        return seen.value

    assert tests(200) <= 200  # before: 120,000
