"""Plans of checks, calls of a reviewer with retries, caches of replies, command lines, and docstring coverage."""

from __future__ import annotations

import subprocess
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriloom.operators.review import batches
from veriloom.operators.tools import CHECKS
from veriloom.session import ready


def selected(path: Column, text: Column, selector: dict) -> Column:
    """Whether a check reads a file: no excluded part or prefix, and one of its endings, no ending below scripts/, or a
    shebang with one of its marks. (FLT-01)"""
    bare = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^\./", "")
    name = F.substring_index(bare, "/", -1)
    out = F.exists(F.array(*[F.lit(e) for e in selector["includeExtensions"]]), lambda e: F.endswith(bare, e)) if selector["includeExtensions"] else F.lit(False)
    if selector["allowExtensionlessInScripts"]:
        out = out | (F.contains(bare, F.lit("scripts/")) & ~F.contains(name, F.lit(".")))
    first = F.lower(F.substring_index(text, "\n", 1))
    for mark in selector["shebangMarkers"]:
        out = out | (F.startswith(first, F.lit("#!")) & F.contains(first, F.lit(mark.lower())))
    for part in selector["excludeSubstrings"]:
        out = out & ~F.contains(bare, F.lit(part))
    for prefix in selector["excludePrefixes"]:
        out = out & ~F.startswith(bare, F.lit(prefix))
    return F.coalesce(out, F.lit(False))


def file_plan(files: DataFrame, checks: dict[str, dict] = CHECKS) -> DataFrame:
    """(check, path, id, status) of files (id, path, text) for each check whose selector takes them: included, skipped-large
    or binary. The checks are constants, so no file is joined with them. (FLT-01, FLT-02, JOIN-16, WIN-02)"""
    path, text = F.col("path"), F.col("text")
    size, binary = F.octet_length(text), F.contains(F.substring(text, 1, 8192), F.lit("\0"))
    status = lambda spec: F.when(size > spec["maxFileSizeKb"] * 1024, "skipped-large").when(binary, "binary").otherwise("included")
    found = [F.when(selected(path, text, spec["selector"]), F.struct(F.lit(name).alias("check"), status(spec).alias("status"))) for name, spec in checks.items()]
    return files.select("id", "path", F.explode(F.array_compact(F.array(*found))).alias("c")).select("c.check", "path", "id", "c.status")


def batch_plan(plan: DataFrame, checks: dict[str, dict] = CHECKS) -> DataFrame:
    """(check, batch, n, items) of the included files of a plan, by id: as many to a batch as the check says. (WIN-01, AGG-05)"""
    out = None
    for size in sorted({spec["batchSize"] for spec in checks.values()}):
        names = [name for name, spec in checks.items() if spec["batchSize"] == size]
        part = batches(plan.where((F.col("status") == "included") & F.col("check").isin(*names)), "check", "id", size)
        out = part if out is None else out.unionByName(part)
    return out


def dry_run(plan: DataFrame, checks: dict[str, dict] = CHECKS) -> DataFrame:
    """(check, plan): what would be run, as JSON: counts of files by status, batches and their size. (EXT-11)"""
    sizes = F.create_map(*[F.lit(x) for name, spec in checks.items() for x in (name, spec["batchSize"])])
    counts = plan.groupBy("check").agg(*[F.count_if(F.col("status") == s).alias(s.replace("-", "_")) for s in ("included", "skipped-large", "binary")])
    n = F.ceil(F.col("included") / F.element_at(sizes, F.col("check")))
    return counts.select("check", F.to_json(F.struct("included", "skipped_large", "binary", n.alias("batches"), F.element_at(sizes, F.col("check")).alias("batch_size"))).alias("plan"))


class Refused(Exception):
    """A call that ended with an HTTP status."""

    def __init__(self, status: int, message: str = ""):
        super().__init__(message or f"status {status}")
        self.status = status


def with_retries(call: Callable[[str], str], prompt: str, retries: int, backoff: float, sleep: Callable[[float], None] = time.sleep) -> tuple[str | None, str | None, int]:
    """(reply, error, attempts) of a call that is made again after a pause, twice as long each time, while its status says
    that it may be. (EXT-01, FLT-16)"""
    for attempt in range(1, retries + 2):
        try:
            return call(prompt), None, attempt
        except Refused as e:
            if attempt > retries or not (e.status in (408, 429) or e.status >= 500):
                return None, str(e), attempt
        except OSError as e:  # no answer at all
            if attempt > retries:
                return None, str(e), attempt
        sleep(backoff * 2 ** (attempt - 1))
    return None, "no attempt", 0


def called(requests: DataFrame, call: Callable[[str], str], cache: DataFrame | None = None, *, at_once: int = 1, retries: int = 3, backoff: float = 1.0) -> DataFrame:
    """(check, batch, key, reply, error, attempts, cached) of requests (check, batch, key, prompt): replies of the cache
    (key, text) are taken, the rest is asked for, at_once requests at a time over the cluster. Rows carry their check and
    batch, so results need no order. (EXT-01, EXT-03, JOIN-14)

    A task that is lost asks again; write the result down before it is used twice.
    """
    ready(requests.sparkSession)
    kept = requests.limit(0).select(F.col("key").alias("_k"), F.lit("").alias("_t")) if cache is None else cache.select(F.col("key").alias("_k"), F.col("text").alias("_t")).dropDuplicates(["_k"])
    j = requests.join(kept, F.col("key") == F.col("_k"), "left")
    known = j.where("_k is not null").select("check", "batch", "key", F.col("_t").alias("reply"), F.lit(None).cast("string").alias("error"), F.lit(0).alias("attempts"), F.lit(True).alias("cached"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(check, batch, key, *with_retries(call, prompt, retries, backoff), False) for check, batch, key, prompt in frame[["check", "batch", "key", "prompt"]].itertuples(index=False)]
            yield pd.DataFrame(rows, columns=["check", "batch", "key", "reply", "error", "attempts", "cached"], dtype=object)

    asked = j.where("_k is null").select("check", "batch", "key", "prompt").repartition(at_once).mapInPandas(run, known.schema)
    return known.unionByName(asked)


def cache_replies(replies: DataFrame, path: str) -> None:
    """Appends (key, created_at, text) of new replies to a cache; Spark's commit makes an append whole or nothing. (SNK-05)"""
    new = replies.where("error is null and not cached").select("key", F.current_timestamp().alias("created_at"), F.col("reply").alias("text"))
    new.dropDuplicates(["key"]).write.mode("append").parquet(path)


def cache_handles(handles: DataFrame, path: str) -> None:
    """Appends (key, name, expires_at) of contents that a service keeps. (SNK-06, EXT-02)"""
    handles.select("key", "name", "expires_at").write.mode("append").parquet(path)


def valid_replies(cache: DataFrame, now: Column, ttl_seconds: int = 604800) -> DataFrame:
    """(key, text): the latest reply of each key that isn't older than the time to live. (JOIN-14)"""
    fresh = cache.where(F.col("created_at") >= now - F.expr(f"make_dt_interval(0, 0, 0, {ttl_seconds})"))
    return fresh.groupBy("key").agg(F.max_by("text", F.struct("created_at", "text")).alias("text"))


def valid_handles(cache: DataFrame, now: Column) -> DataFrame:
    """(key, name): the handle of each key that expires last, if it hasn't expired. (JOIN-15)"""
    return cache.where(F.col("expires_at") >= now).groupBy("key").agg(F.max_by("name", F.struct("expires_at", "name")).alias("name"))


def command(words: list[str], files: Column, *, config: Column | None = None, flags: tuple[str, ...] = (), pass_files: bool = True) -> Column:
    """A checker's command line as words: its command, a flag with the configuration unless the command has one of its
    flags, and the files. (EXT-05)"""
    parts = [F.array(*[F.lit(w) for w in words])]
    if config is not None and flags and not any(w == f or w.startswith(f"{f}=") for w in words for f in flags):
        parts.append(F.when(config.isNotNull(), F.array(F.lit(flags[0]), config)).otherwise(F.array().cast("array<string>")))
    if pass_files:
        parts.append(files)
    return F.concat(*parts)


RESULT = "name string, exit_code int, output string, error string, millis long"


def run_command(words: list[str], timeout: float) -> tuple[int | None, str, str | None, int]:
    """(exit code, output of both kinds, error, milliseconds) of an external program; without a code if it can't be started
    or takes too long."""
    began = time.monotonic()
    code, output, error = None, "", None
    try:
        done = subprocess.run(words, stdout=subprocess.PIPE, stderr=subprocess.STDOUT, timeout=timeout, check=False)
        code, output = done.returncode, done.stdout.decode("utf-8", "replace")
    except subprocess.TimeoutExpired as e:
        output, error = (e.output or b"").decode("utf-8", "replace"), f"not ended after {timeout:g} s"
    except OSError as e:
        error = str(e)
    return code, output, error, int(1000 * (time.monotonic() - began))


def run_commands(commands: DataFrame, *, timeout: float = 120, at_once: int | None = None) -> DataFrame:
    """(name, exit_code, output, error, millis) of command lines (name, words), run side by side by the tasks that hold
    them, at_once at a time if given. For checkers, test runs and analyzers, whose output other functions read. A task that
    is lost runs its programs again. (EXT-04, EXT-07 to EXT-09)"""
    ready(commands.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(name, *run_command([str(w) for w in words], timeout)) for name, words in zip(frame["name"], frame["words"], strict=True)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in RESULT.split(", ")]).astype({"exit_code": "Int64"})

    rows = commands.select("name", "words")
    return (rows.repartition(at_once) if at_once else rows).mapInPandas(run, RESULT)


def outcome(results: DataFrame) -> DataFrame:
    """(passed, failed, total_millis, text) of checkers' results, one line each in text, by name. (AGG-06)"""
    good = F.col("exit_code") == 0
    ok = F.coalesce(good, F.lit(False))
    line = F.concat(F.when(ok, "PASS ").otherwise("FAIL "), "name", F.lit(" ("), F.col("millis").cast("string"), F.lit("ms)"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("name", line.alias("l")))), lambda x: x["l"])
    return results.agg(F.count_if(ok).alias("passed"), F.count_if(~ok).alias("failed"), F.sum("millis").alias("total_millis"), F.array_join(lines, "\n").alias("text"))


def coverage(facts: DataFrame, threshold: float = 90) -> DataFrame:
    """(documented, total, percent, enough) of the functions and classes among facts (kind, detail) whose names don't begin
    with an underscore; without any the share is whole. (EXT-06)"""
    named = facts.where(F.col("kind").isin("documented", "undocumented") & ~F.startswith("detail", F.lit("_")))
    n = named.agg(F.count_if(F.col("kind") == "documented").alias("documented"), F.count("*").alias("total"))
    percent = F.when(F.col("total") == 0, 100.0).otherwise(100.0 * F.col("documented") / F.col("total"))
    return n.withColumn("percent", percent).withColumn("enough", percent >= threshold)
