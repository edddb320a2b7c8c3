"""Rules as tables: dotted prefixes and path globs by an index of literal prefixes. (JOIN-08, JOIN-12, JOIN-16, FLT-12)

Each distinct value is exploded into its own prefixes, which meet the rules' literal prefixes in an equi-join (globs: all
characters that they fix); only rules that meet are tested, and of several the one with the least rank counts. The plan doesn't grow with the rules, and a value
that a third of the rows has is looked up once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Copies of the shapes of globs that begin with a wildcard.
COPIES = 32


def dotted_prefixes(name: Column) -> Column:
    """a.b.c: a, a.b, a.b.c."""
    parts = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))


def folders(path: Column) -> Column:
    """a/b/c: the empty one, a/, a/b/."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.when(n == 0, "").otherwise(F.concat(F.array_join(F.slice(parts, F.lit(1), n), "/"), F.lit("/"))))


def glob_pattern(glob: Column) -> Column:
    """An anchored regex: ** spans directories, * and ? stay within one."""
    plain = F.regexp_replace(glob, r"([\\.\[\]{}()+^$|])", r"\\$1")
    whole = F.replace(plain, F.lit("**"), F.lit("\x01"))
    return F.concat(F.lit(r"(?s)\A"), F.replace(F.replace(F.replace(whole, F.lit("*"), F.lit("[^/]*")), F.lit("?"), F.lit("[^/]")), F.lit("\x01"), F.lit(".*")), F.lit(r"\z"))


def first_banned(rows: DataFrame, name: str, rules: DataFrame) -> DataFrame:
    """rows with `label`, that of the first of rules (rank, rule, label) that bans the name; null if none does. (JOIN-12)

    A rule bans its own name, and one with a dot all names below it too. Null names and rules meet nothing; ranks that are
    equal go by the label.
    """
    names = rows.select(F.col(name).alias("_name")).where("_name is not null").distinct().select("_name", F.explode(dotted_prefixes(F.col("_name"))).alias("_prefix"))
    met = names.join(rules.select("rank", "rule", F.col("label").alias("_label")), F.col("_prefix") == F.col("rule")).where((F.col("_name") == F.col("rule")) | F.contains("rule", F.lit(".")))
    first = met.groupBy("_name").agg(F.min(F.struct("rank", "_label")).alias("_first")).select("_name", F.col("_first._label").alias("label"))
    return rows.join(first, F.col(name) == F.col("_name"), "left").drop("_name")


def _wild(glob: Column) -> Column:
    """What of a glob a path must have as it is: (slot, id, shape). A slot is the folder before the first wildcard and what is
    fixed of the rest: with ? alone the count of characters and parts, with * that of parts, with ** nothing. A shape says for
    each part (with ** the whole) how many characters before its first and behind its last wildcard are fixed, -1 for a part
    without any; the id hashes the slot and those characters."""
    spans = glob.contains("**")
    parts = F.when(spans, F.array(glob)).otherwise(F.split(glob, "/"))
    ends = lambda p: F.struct(F.when(p.rlike("[*?]"), F.char_length(F.regexp_extract(p, r"(?s)\A[^*?]*", 0))).otherwise(-1).alias("a"), F.char_length(F.regexp_extract(p, r"(?s)[^*?]*\z", 0)).alias("b"))
    head = F.regexp_extract(F.regexp_extract(glob, r"(?s)\A[^*?]*", 0), r"(?s)\A(.*/)", 1)
    size, count = F.when(glob.contains("*"), -1).otherwise(F.char_length(glob)), F.when(spans, -1).otherwise(F.size(parts))
    shape, slot = F.transform(parts, ends), F.xxhash64(head, size, count)
    return F.struct(slot.alias("slot"), _fixed(slot, parts, shape).alias("id"), shape.alias("shape"), (head == "").alias("top"))


def _fixed(slot: Column, parts: Column, shape: Column) -> Column:
    """The hash of a slot and the characters that a shape fixes of parts."""
    kept = F.zip_with(parts, shape, lambda p, s: F.when(s["a"] < 0, p).otherwise(F.concat(F.left(p, s["a"]), F.right(p, s["b"]))))
    return F.xxhash64(slot, F.array_join(kept, "/"))


def matched(rows: DataFrame, path: str, globs: DataFrame, how: str = "left_semi") -> DataFrame:
    """rows whose path one of globs (glob) matches (left_semi) or none does (left_anti). (JOIN-08, JOIN-16, FLT-12)

    Globs meet the paths that have all their fixed characters, by two equi-joins: a path's slots give the few shapes of globs
    there, and each shape the one id that its globs must have. What meets is tested. Only globs that fix no character of a
    path, or the same ones, still meet the same paths.
    """
    listed = globs.where("glob is not null").select("glob").distinct().select(glob_pattern(F.col("glob")).alias("_pattern"), _wild(F.col("glob")).alias("_w"))
    listed = listed.select("_pattern", "_w.*")
    # shapes of globs without a folder meet all paths, so there are copies of them, and each path takes one
    copies = F.when(F.col("top"), F.sequence(F.lit(0), F.lit(COPIES - 1))).otherwise(F.array(F.lit(0)))
    shapes = listed.select("slot", "shape", "top").distinct().select(F.col("slot").alias("_at"), "shape", F.explode(copies).alias("_copy"))
    paths = rows.select(F.col(path).alias("_path")).where("_path is not null").distinct()
    parts, size = F.split("_path", "/"), F.char_length("_path")
    kinds = F.array(*[F.struct(s.cast("int").alias("size"), c.cast("int").alias("count")) for s, c in ((size, F.size(parts)), (F.lit(-1), F.size(parts)), (F.lit(-1), F.lit(-1)))])
    slots = F.flatten(F.transform(folders(F.col("_path")), lambda f: F.transform(kinds, lambda k: F.struct(F.xxhash64(f, k["size"], k["count"]).alias("slot"), F.when(f == "", F.pmod(F.xxhash64("_path"), F.lit(COPIES))).otherwise(0).cast("int").alias("copy"), (k["count"] < 0).alias("whole")))))
    probes = paths.select("_path", F.explode(slots).alias("_s")).select("_path", "_s.*")
    met = probes.join(shapes, (F.col("slot") == F.col("_at")) & (F.col("copy") == F.col("_copy")))
    asked = met.select("_path", _fixed(F.col("slot"), F.when(F.col("whole"), F.array("_path")).otherwise(F.split("_path", "/")), F.col("shape")).alias("_id"))
    hit = asked.join(listed.select("id", "_pattern"), F.col("_id") == F.col("id")).where(F.regexp_like("_path", F.col("_pattern"))).select("_path").distinct()
    return rows.join(hit, F.col(path) == F.col("_path"), how)
