"""Text functions, overlays and the stateful filter on small inputs."""

import pytest
from pyspark.sql import functions as F

from veriloom.functions import text as T
from veriloom.operators import checks, overlay, review
from veriloom.streaming import quiet_filter


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_text_functions(spark):
    assert one(spark, T.fix_text(F.lit("a \r\nb\t\r\r"))) == "a\nb\n" and one(spark, T.fix_text(F.lit(""))) == ""
    assert one(spark, T.slugify(F.lit("**Hi, There!**"))) == "hi-there" and one(spark, T.slugify(F.lit("!!"))) == "ethos"
    assert one(spark, T.summarize(F.lit("### T\n\nFirst **one**. Second.\n---\n"))) == "First one." and one(spark, T.summarize(F.lit("# Title here\n\nBody."))) == "Title here"
    assert one(spark, T.summarize(F.lit("```\na. b\n\nc\n```"))) == "No summary available." and one(spark, T.summarize(F.lit("x" * 300))) == "x" * 240
    assert one(spark, T.markdown_plain(F.lit("# A\n\n- `` b `c`\n* *d* [e](f)\n```\nx\n```y"))) == "A ` b c` d* e y"
    doc = "Text.\n\nsee also:\n\n    b.md: x\n  a.md | y\n\tsub/c.md - z\nd.md: no\n"
    assert one(spark, T.see_also(F.lit(doc))) == ["a.md", "b.md"] and one(spark, T.see_also(F.lit(doc), T.SEE_PATH)) == ["sub/c.md"] and one(spark, T.see_also(F.lit("See Also: b.md\n  a.md: x"))) == []
    assert one(spark, T.inline_content(F.lit("a {X} b {X}"), F.lit("c"), "{X}")) == "a c b {X}"
    assert one(spark, T.line_at(F.lit("a\n b "), F.lit(2))) == "b" and one(spark, T.line_at(F.lit("a"), F.lit(5))) == "<unknown>"
    assert one(spark, T.starts_with_keyword(F.lit(" select x"), ("SELECT",))) == "SELECT" and one(spark, T.starts_with_keyword(F.lit("selected"), ("SELECT",))) == ""
    assert one(spark, T.cache_key(F.lit("a"), F.lit(None), F.lit("b"))) != one(spark, T.cache_key(F.lit("a"), F.lit("b"), F.lit(None)))
    assert T.glob_regex("app/**/*.py") == r"^app/.*/[^/]*\.py$"
    counts = lambda log: tuple(one(spark, checks.pytest_counts(F.lit(log))))
    assert counts("1 passed\n=== 3 passed, 1 skipped, 4 xfailed, 2 failed, 5 errors in 1s\nend") == (3, 1, 4, 2, 5)
    assert counts("2 failed, 3 passed") == (3, 0, 0, 0, 0) and counts("none") == (0, 0, 0, 0, 0)
    gate = lambda code, log, n: one(spark, checks.pytest_gate(F.lit(code), checks.pytest_counts(F.lit(log)), F.lit(n)))
    assert gate(0, "1 passed", 0) is None and gate(0, "1 passed, 1 skipped", 0) == gate(1, "", 0) == "failed or skipped tests" and gate(0, "1 passed", 2) == "banned markers"


def test_commit_messages(spark):
    lint = lambda m: one(spark, checks.commit_errors(F.lit(m)))
    assert lint("feat(a): ok\n\nbody") == [] and lint("\n# c\n \nfeat(a)!: ok") == [] and lint("Merge x") == lint("fixup! y") == []
    assert lint("") == lint("# only\n") == ["commit message is empty"]
    assert lint("feat: no scope") == ["header must match: type(scope): subject"]
    assert lint("zap(a): x\nbody") == ["type must be one of: chore, docs, feat, fix, perf, refactor, test", "body/footer must be separated from header by a blank line"]
    assert lint("fix(a): " + "é" * 72) == ["header must be <= 150 characters"] and lint("fix(a):  ") == ["header must match: type(scope): subject"]


def test_file_rules(spark):
    shell = lambda t, helper=False: one(spark, checks.shell_errors(F.lit(t), F.lit(helper)))
    assert shell("#!/bin/sh\n  set -euo pipefail") == [] and shell("#!/usr/bin/fish\nset -e pipefail\nsource x/common.sh", True) == []
    assert shell(" #!/bin/sh\necho set -euo pipefail # common.sh", True) == ["missing or invalid shell shebang", "missing 'set -euo pipefail'", "scripts/ shell files must source the repository common shell helpers"]
    assert one(spark, checks.private_key(F.lit("-----BEGIN EC2 X PRIVATE KEY-----"))) and not one(spark, checks.private_key(F.lit("-----BEGIN ec PRIVATE KEY-----")))
    limit = lambda p: one(spark, checks.line_limit(F.lit(p)))
    assert (limit("a.PY"), limit("a.sh"), limit("scripts/x"), limit("a.txt")) == (1000, 500, 500, 1000) and one(spark, checks.line_limit(F.lit("scripts/a.py"), "warn")) == 800
    assert one(spark, checks.line_limited(F.lit("x/scripts/y"))) and not one(spark, checks.line_limited(F.lit("a.go")))
    assert one(spark, checks.mode_mismatch(F.lit(True), F.lit("echo"))) and not one(spark, checks.mode_mismatch(F.lit(True), F.lit("#!x")))
    large = lambda path, size, added: one(spark, checks.too_large(F.lit(path), F.lit(size), F.lit(added), exempt=("data/",)))
    assert large("a.json", 512001, True) and not large("a.json", 512000, True) and not large("a.json", 999999, False) and not large("a.png", 999999, True) and not large("data/a.json", 999999, True)


def test_plans(spark):
    files = spark.createDataFrame([("docs/plans/a/x/todo.md", "- [ ] one\n- [x] two\n-  [  ]  three\n* [ ] four\n - [ ] five\n- [ ]"), ("docs/plans/b/t.md", "- [ ] six"), ("docs/plans/a/n.txt", "- [ ] no")], "path string, text string")
    items = checks.unchecked_items(files)
    assert sorted(map(tuple, items.collect())) == [("docs/plans/a/x/todo.md", 1, "- [ ] one"), ("docs/plans/a/x/todo.md", 3, "-  [  ]  three"), ("docs/plans/b/t.md", 1, "- [ ] six")]
    status = spark.createDataFrame([("docs/plans/a/metadata.yaml", "complete "), ("docs/plans/b/metadata.yaml", "in_progress")], "path string, status string")
    assert sorted((r.plan, r.line) for r in checks.plan_errors(status, items).collect()) == [("docs/plans/a", 1), ("docs/plans/a", 3)]
    place = lambda p: one(spark, checks.plan_metadata(F.lit(p)))
    assert place("./docs/plans/a/metadata.yaml") and not place("docs/plans/a/x.yaml") and not place("docs/metadata.yaml")


def test_overlay_nulls_and_subtrees(spark):
    base = spark.createDataFrame([("d", "a.x", "1"), ("d", "a.y", "2"), ("d", "b", "3"), ("d", "c", "4")], "doc string, path string, value string")
    over = spark.createDataFrame([("d", "a", "9"), ("d", "b.z", "8"), ("d", "c", None)], "doc string, path string, value string")
    got = {(r.path, r.value) for r in overlay.deep_overlay(base, over).collect()}
    assert got == {("a", "9"), ("b.z", "8"), ("c", None)}
    assert overlay.union_new(base.limit(1), base.where("path = 'c'"), "path").count() == 2
    with pytest.raises(ValueError, match="duplicate path: c"):
        overlay.union_new(base, base.where("path = 'c'"), "path")


def test_findings_by_diff(spark):
    diff = "--- a\n+++ b\n@@ -1 +5 @@ x\n+y\n@@ -1,2 +60,8 @@\n@@ -9,3 +99,0 @@\n @@ -1 +7 @@\n"
    hunks = review.parse_hunks(spark.createDataFrame([("a.py", diff), ("none.py", "@@ -1,3 +4,0 @@")], "file string, text string"))
    assert sorted(map(tuple, hunks.collect())) == [("a.py", 5, 1), ("a.py", 60, 8), ("a.py", 99, 0), ("none.py", 4, 0)]
    files = spark.createDataFrame([("a.py", True), ("none.py", False), ("old.py", False), ("new.py", True)], "file string, added boolean")
    cases = [("a.py", 5, True), ("a.py", 6, False), ("a.py", 60, True), ("a.py", 63, True), ("a.py", 64, True), ("a.py", 67, True), ("a.py", 68, False), ("a.py", 99, False), ("a.py", 0, True), ("old.py", 3, False), ("none.py", 4, False), ("new.py", 3, True), ("gone.py", 3, True), ("", 3, True), (None, 3, True), ("old.py", 0, True), ("old.py", 3, False)]
    findings = spark.createDataFrame([("c", f, n, "INFO", k) for k, (f, n, _) in enumerate(cases)], "check string, file string, line int, severity string, k int")
    done = review.classify_by_diff(findings, hunks, files)
    assert {r.k: r.in_diff for r in done.collect()} == {k: x for k, (_, _, x) in enumerate(cases)} and done.count() == len(cases)
    empty = review.classify_by_diff(findings, hunks.limit(0), files.limit(0))
    assert all(r.in_diff for r in empty.collect())


def test_statuses(spark):
    rows = [("a", "f", 1, "CRITICAL", "m", True), ("b", "f", 2, "WARNING", "m", True), ("c", "f", 3, "CRITICAL", "m", False), ("d", "f", 4, "INFO", "m", True), ("e", "f", 5, "WARNING", "m", False), ("g", "f", 0, "WARNING", "m", True)]
    findings = spark.createDataFrame(rows, "check string, file string, line int, severity string, message string, in_diff boolean")
    batches = spark.createDataFrame([("a", "x"), ("b", None), ("c", "x"), ("c", None), ("e", None), ("f", "x"), ("f", "y"), ("g", "x"), ("h", None)], "check string, error string")
    status = review.status_by_check(findings, batches)
    assert {r.check: r.status for r in status.collect()} == {"a": "FAIL", "b": "WARN", "c": "WARN", "d": "PASS", "e": "PASS", "f": "ERROR", "g": "ERROR", "h": "PASS"}
    assert tuple(review.overall(status).first()) == (True, True, True, "FAIL") and tuple(review.overall(status.limit(0)).first()) == (False, False, False, "PASS")
    lines = [r.text for r in review.report_rows(status, findings).orderBy("check", "part", "file", "line").collect()]
    assert lines == ["a: FAIL", "  [In your changes]", "  XX f:1 m", "b: WARN", "  [In your changes]", "  W  f:2 m", "c: WARN", "  [Pre-existing (1)]", "  XX f:3 m", "d: PASS", "  [In your changes]", "  -- f:4 m", "f: ERROR", "g: ERROR", "  [In your changes]", "  W  f:? m"]


def test_allowlist_and_bans(spark):
    rows = [("app/x/a.py", "Section 7", "gates the job"), ("app/x/a.py", "Section 7", "too long"), ("app/a.py", "Section 19", "modal"), ("", "Section 19", "modal"), (None, None, None), ("app/x/a.py", "Section 3", "modal")]
    frame = spark.createDataFrame(rows, "file string, section string, message string")
    assert [tuple(r) for r in review.not_allowed(frame, ["app/**/*.py"]).collect()] == rows[1:] and review.not_allowed(frame, []).count() == 6
    rules = [("a.b", "one"), ("a", "two"), ("c", "three")]
    ban = lambda m: one(spark, review.banned_module(F.lit(m), rules))
    assert [ban(m) for m in ("a.b", "a.b.c", "a.bc", "a", "a.x", "c", "c.d", "d")] == ["one", "one", None, "two", None, "three", None, None]
    same = spark.createDataFrame([("s", 1), ("s", 1), ("s", 9000), ("t", None)], "by string, k long")
    assert sorted((r.by, r.batch, r.n) for r in review.batches(same.where("k is not null"), "by", "k", 2).collect()) == [("s", 0, 2), ("s", 1, 1)]


LINES = [
    "lint...........Passed", "- hook id: x", "", "", "types..........Failed", "- hook id: y", "error one", "[Pre-existing (2)]", "  old", "", "kept", "", "", "- files were modified", "=" * 60, "Banner", "=" * 60, "body",
    "=" * 50, "Banner", "again", "x.....\x1b[31mSkipped\x1b[0m", "  Skipping a (>5KB)", "=" * 50, "- item", "lost", "z.....Failed", "How to fix:", "  do", "How to fix:", "  do", "end", "(no files to check)Skipped", "- duration: 1s",
]
LEFT = ["types..........Failed", "- hook id: y", "error one", "kept", "", "=" * 70, "Banner", "=" * 70, "=" * 70, "body", "=" * 70, "=" * 70, "- item", "z.....Failed", "How to fix:", "  do", "end"]


def test_filter_of_one_stream(spark):
    frame = spark.createDataFrame([("s", i, x) for i, x in enumerate(LINES)], "stream string, ord long, line string")
    batch = [r.line for r in quiet_filter.filter_batch(frame).orderBy("ord", "part").collect()]
    assert batch == [*LEFT, "  (\x1b[32m1 passed\x1b[0m, \x1b[31m2 failed\x1b[0m, \x1b[33m2 skipped\x1b[0m)"]
