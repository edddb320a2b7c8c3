"""Findings, changed lines, allowlists, caches and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriloom.functions.text import glob_regex


#: A hunk's header: new-side start, and count if it isn't 1.
HUNK = r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@"


def parse_hunks(diffs: DataFrame) -> DataFrame:
    """(file, start, n) of the hunk headers in diffs (file, text): new-side lines; a header without a count has one line,
    other lines are passed over. (FN-09)"""
    lines = diffs.select("file", F.explode(F.split("text", "\n", -1)).alias("_l")).where(F.regexp_like("_l", F.lit(HUNK)))
    count = F.regexp_extract("_l", HUNK, 2)
    return lines.select("file", F.regexp_extract("_l", HUNK, 1).cast("long").alias("start"), F.when(count == "", 1).otherwise(count.cast("long")).alias("n"))


def classify_by_diff(findings: DataFrame, hunks: DataFrame, files: DataFrame) -> DataFrame:
    """findings (check, file, line, ...) with in_diff: true for line 0 and for changed lines, which hunks (file, start, n)
    name. In a file without changed lines a finding is in the diff if the file has no name, isn't among files (file,
    added), or was added. (JOIN-07)

    Changed lines are kept as 64-bit masks by (file, block of 64 lines), so each finding meets one row at most in an
    equi-join, and repeated findings stay as they are.
    """
    some = hunks.where("n > 0")
    ends = some.select("file", "start", (F.col("start") + F.col("n") - 1).alias("stop")).withColumn("_b", F.explode(F.expr("sequence(start div 64, stop div 64)")))
    bits = F.expr("shiftleft(-1L, cast(greatest(start - _b * 64, 0) as int)) & shiftrightunsigned(-1L, cast(63 - least(stop - _b * 64, 63) as int))")
    masks = ends.groupBy(F.col("file").alias("_f"), F.col("_b").alias("_fb")).agg(F.bit_or(bits).alias("_mask"))
    changed = some.select(F.col("file").alias("_f")).distinct()
    known = files.select(F.col("file").alias("_f"), F.col("added").alias("_added")).groupBy("_f").agg(F.bool_or("_added").alias("_added"))
    of_file = changed.withColumn("_changed", F.lit(True)).join(known, "_f", "full").select(F.col("_f").alias("_g"), "_changed", "_added")
    joined = findings.join(of_file, F.col("file") == F.col("_g"), "left").join(masks, (F.col("file") == F.col("_f")) & (F.expr("line div 64") == F.col("_fb")), "left")
    hit = F.coalesce(F.expr("getbit(_mask, cast(line % 64 as int)) = 1"), F.lit(False))
    unnamed = F.col("file").isNull() | (F.col("file").cast("string") == "")
    rule = F.when(F.col("line") == 0, True).when(F.coalesce("_changed", F.lit(False)), hit).otherwise(unnamed | F.coalesce("_added", F.lit(True)))
    return joined.withColumn("in_diff", rule).select(*findings.columns, "in_diff")


def status_by_check(findings: DataFrame, batches: DataFrame) -> DataFrame:
    """(check, status, n_in_diff, n_pre_existing) of each check with findings (check, severity, in_diff) or batches (check,
    error, null if it ended well): FAIL if an in-diff finding is critical, ERROR if all batches failed, WARN if some did or
    an in-diff finding is a warning, else PASS. (AGG-03, AGG-04)"""
    inside = F.col("in_diff")
    agg = findings.groupBy("check").agg(
        F.bool_or(inside & (F.col("severity") == "CRITICAL")).alias("_c"), F.bool_or(inside & (F.col("severity") == "WARNING")).alias("_w"), F.count_if(inside).alias("n_in_diff"), F.count_if(~inside).alias("n_pre_existing")
    )
    ran = batches.groupBy("check").agg(F.count("error").alias("_failed"), F.count_if(F.col("error").isNull()).alias("_done"))
    j = agg.join(ran, "check", "full").fillna(0, ["n_in_diff", "n_pre_existing", "_failed", "_done"]).fillna(False, ["_c", "_w"])
    failed = F.col("_failed") > 0
    status = F.when(F.col("_c"), "FAIL").when(failed & (F.col("_done") == 0), "ERROR").when(failed | F.col("_w"), "WARN").otherwise("PASS")
    return j.select("check", status.alias("status"), "n_in_diff", "n_pre_existing")


def overall(status: DataFrame) -> DataFrame:
    """One row: verdict by precedence FAIL, ERROR, WARN, PASS. (AGG-02)"""
    any_of = lambda kind: F.coalesce(F.bool_or(F.col("status") == kind), F.lit(False))
    flags = status.agg(any_of("FAIL").alias("any_fail"), any_of("ERROR").alias("any_error"), any_of("WARN").alias("any_warn"))
    return flags.withColumn("verdict", F.when(F.col("any_fail"), "FAIL").when(F.col("any_error"), "ERROR").when(F.col("any_warn"), "WARN").otherwise("PASS"))


def icon(severity: Column) -> Column:
    """The mark of a severity in reports."""
    return F.when(severity == "CRITICAL", "XX").when(severity == "WARNING", "W ").otherwise("--")


def report_rows(status: DataFrame, findings: DataFrame) -> DataFrame:
    """(check, part, file, line, text): the lines of the report, in the order of these columns. Each check that isn't a
    PASS without in-diff findings has a heading (part 0), the findings (check, file, line, severity, message, in_diff) in
    the diff behind a heading (1, 2), and those before it behind another (3, 4). (SNK-10, FLT-17)

    Lines are rows, so a check with many findings is no task's burden; write them sorted.
    """
    kept = status.where(~((F.col("status") == "PASS") & (F.col("n_in_diff") == 0)))
    before = F.concat(F.lit("  [Pre-existing ("), F.col("n_pre_existing").cast("string"), F.lit(")]"))
    heads = F.array_compact(
        F.array(
            F.struct(F.lit(0).alias("part"), F.concat("check", F.lit(": "), "status").alias("text")),
            F.when(F.col("n_in_diff") > 0, F.struct(F.lit(1).alias("part"), F.lit("  [In your changes]").alias("text"))),
            F.when(F.col("n_pre_existing") > 0, F.struct(F.lit(3).alias("part"), before.alias("text"))),
        )
    )
    headings = kept.select("check", F.explode(heads).alias("h")).select("check", "h.part", F.lit(None).cast("string").alias("file"), F.lit(None).cast("long").alias("line"), "h.text")
    place = F.concat_ws(":", F.coalesce(F.col("file").cast("string"), F.lit("")), F.when(F.col("line") > 0, F.col("line").cast("string")).otherwise("?"))
    text = F.concat(F.lit("  "), icon(F.col("severity")), F.lit(" "), place, F.lit(" "), F.col("message"))
    lines = findings.join(kept.select(F.col("check").alias("_c")), F.col("check") == F.col("_c"), "left_semi")
    return headings.unionByName(lines.select("check", F.when(F.col("in_diff"), 2).otherwise(4).alias("part"), F.col("file").cast("string").alias("file"), F.col("line").cast("long").alias("line"), text.alias("text")))


# What marks a finding as one about modes. (FLT-13)
MODAL_SECTIONS = ("section 19", "one path for critical operations", "sections 5+7+19", "no optional internal state for capabilities", "section 7", "if available")
MODAL_SHAPES = (
    "modal", "gates the", "gates ", "gating feature enablement", "conditionally disables", "conditional execution paths", "different execution paths", "based on a configuration field",
    "based on an input type", "via configuration", "enabled/disabled", "silently degrade", "silent degradation", "skipping the", "skip the", "full job",
)


def is_modal(section: Column, message: Column) -> Column:
    """Whether a finding is about modes: its text holds a section mark and a shape mark. (FLT-13)"""
    text = F.lower(F.concat_ws(" ", F.coalesce(section, F.lit("")), F.coalesce(message, F.lit(""))))
    holds = lambda marks: F.exists(F.array(*[F.lit(m) for m in marks]), lambda m: F.contains(text, m))
    return holds(MODAL_SECTIONS) & holds(MODAL_SHAPES)


def not_allowed(findings: DataFrame, globs: list[str]) -> DataFrame:
    """findings (file, section, message, ...) but those about modes in a file that a glob allows; patterns are compiled
    once. (JOIN-08, FLT-12, FLT-13)"""
    if not globs:
        return findings
    allowed = F.col("file").rlike("|".join(f"(?:{glob_regex(g)})" for g in globs))
    named = F.col("file").isNotNull() & (F.col("file") != "")
    return findings.where(~F.coalesce(is_modal(F.col("section"), F.col("message")) & named & allowed, F.lit(False)))


def latest_valid(entries: DataFrame, key: str, at: str, now: Column, ttl_days: int) -> DataFrame:
    """The latest entry of each key that isn't older than the time to live; ties by all columns. (JOIN-14)"""
    fresh = entries.where((F.col(at) <= now) & (F.col(at) >= now - F.expr(f"interval {ttl_days} days")))
    top = fresh.groupBy(key).agg(F.max(F.struct(at, *[c for c in entries.columns if c not in (key, at)])).alias("_e"))
    return top.select(key, *[F.col(f"_e.{c}").alias(c) for c in entries.columns if c != key])


def batches(files: DataFrame, by: str, order: str, size: int, span: int = 4096) -> DataFrame:
    """(by, batch, n, items): consecutive items of each group, size to a batch, joined by line feeds. (WIN-01, WIN-02, AGG-05)

    order is a whole number. Ranks are counted within slices of span values and added to the sizes of the slices before,
    so a large group isn't one task's window.
    """
    sliced = files.withColumn("_p", F.expr(f"floor({order} / {span})"))
    w = Window.partitionBy("_by").orderBy("_q").rowsBetween(Window.unboundedPreceding, -1)
    before = sliced.groupBy(F.col(by).alias("_by"), F.col("_p").alias("_q")).count().select("_by", "_q", F.coalesce(F.sum("count").over(w), F.lit(0)).alias("_before"))
    ranked = sliced.withColumn("_r", F.row_number().over(Window.partitionBy(by, "_p").orderBy(order)) - 1)
    numbered = ranked.join(before, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_p") == F.col("_q"))).withColumn("_b", F.floor((F.col("_r") + F.col("_before")) / size))
    return numbered.groupBy(by, F.col("_b").alias("batch")).agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda x: x.cast("string")), "\n").alias("items"))


def reused(content: DataFrame, key: str, order: str, least: int = 2) -> DataFrame:
    """(key, uses, first) of contents used at least so often. (AGG-01)"""
    return content.groupBy(key).agg(F.count("*").alias("uses"), F.min(order).alias("first")).where(F.col("uses") >= least)


def banned_module(module: Column, banned: list[tuple[str, str]]) -> Column:
    """The name of the first rule (module, name) that bans a module: the module itself, or one below it if the rule's own
    name has a dot; null if none does. The rules are a constant expression, so nothing is joined. (JOIN-12)"""
    out = F.lit(None).cast("string")
    for name, label in reversed(banned):
        hit = (module == name) | F.startswith(module, F.lit(f"{name}.")) if "." in name else module == name
        out = F.when(hit, F.lit(label)).otherwise(out)
    return out


def grown_over_limit(now: DataFrame, before: DataFrame, key: str, lines: str, limit: int | Column) -> DataFrame:
    """Files over the limit that are new or have grown. (JOIN-21)"""
    old = before.select(F.col(key).alias("_k"), F.col(lines).alias("base"))
    return now.join(old, F.col(key) == F.col("_k"), "left").where((F.col(lines) > limit) & (F.col("base").isNull() | (F.col(lines) > F.col("base")))).select(key, lines, "base")


def drift(expected: DataFrame, actual: DataFrame, key: str, value: str) -> DataFrame:
    """(key, state): missing or changed. (JOIN-22, JOIN-23)"""
    a = actual.select(F.col(key).alias("_k"), F.col(value).alias("_v"), F.lit(True).alias("_there"))
    j = expected.join(a, F.col(key) == F.col("_k"), "left")
    return j.where(F.col("_there").isNull() | ~F.col(value).eqNullSafe(F.col("_v"))).select(key, F.when(F.col("_there").isNull(), "missing").otherwise("changed").alias("state"))
