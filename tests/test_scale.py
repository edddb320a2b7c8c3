"""Costly work is spread over tasks, however few files or groups hold the rows."""

from pyspark.sql import functions as F


def tasks(rows):
    return rows.select(F.spark_partition_id().alias("task")).groupBy("task").count().where("count > 0").count()


def test_tool_files_of_one_partition_are_made_by_all_tasks(spark):
    from veriloom.operators import tools

    configs = spark.range(200).coalesce(1).select(F.col("id").cast("string").alias("root"), F.lit(None).cast("string").alias("config"))
    made = tools.tool_files(configs)
    assert tasks(made.where("path = 'ruff.toml'")) >= 4 and tasks(made.where("path = '.yamllint.yml'")) >= 4  # before: 1


def test_config_files_of_one_partition_are_read_by_all_tasks(spark):
    from veriloom.sources import config

    files = spark.range(200).coalesce(1).select(F.format_string("%d.yml", "id").alias("path"), F.lit("a: 1\n").alias("text"))
    broken = files.select("path", F.lit("a: [").alias("text"))
    assert all(tasks(made) >= 4 for made in (config.config_leaves(files), config.config_json(files), config.syntax_errors(broken)))  # before: 1


def test_items_of_one_partition_are_parsed_by_all_tasks(spark):
    from veriloom.operators import principles

    items = spark.range(200).coalesce(1).select(F.col("id").cast("string").alias("source"), F.lit("{}").alias("payload"))
    assert tasks(principles.principles(items)) >= 4  # before: 1


def test_addons_bring_five_principles_of_a_bundle_together(spark, monkeypatch):
    from veriloom.operators import principles, render

    items = spark.range(50).select(F.col("id").cast("string").alias("source"), F.format_string('{"id": "p%d", "title": "T%d", "order": %d, "body": "b"}', "id", F.col("id") % 3, F.col("id") % 7).alias("payload"))
    rows = principles.principles(items).select(*principles.COLUMNS, F.lit("b").alias("bundle"))
    bundle = spark.range(1).select(F.lit("b").alias("bundle"), F.lit("root").alias("root_name"), F.lit("").alias("title"), F.lit("").alias("overview"), principles.repo_context(F.lit("{}")).alias("repo"), F.lit(None).cast("map<string,array<string>>").alias("profile_notes"))
    met, plain = [], render.bundled
    monkeypatch.setattr(render, "bundled", lambda b, p: met.append(p.count()) or plain(b, p))
    got = {r.path: r.content for r in render.addons(bundle, rows).collect()}
    monkeypatch.undo()
    want = {r.path: r.content for r in plain(bundle, rows).select(F.explode(F.array(*[F.struct(F.lit(f".agent-context/prompt-addons/{a}.md").alias("path"), render.addon(a).alias("content")) for a in render.AGENTS])).alias("d")).select("d.*").collect()}
    assert met == [5] and got == want


def test_short_streams_are_filtered_together(spark):
    import time

    from veriloom.streaming import quiet_filter

    def seconds(streams):
        rows = spark.range(2 * streams).select(F.expr("string(id div 2)").alias("stream"), (F.col("id") % 2).alias("ord"), F.when(F.col("id") % 2 == 0, "types....Failed").otherwise("").alias("line"))
        began = time.time()
        assert quiet_filter.filter_batch(rows).count() == 3 * streams
        return time.time() - began

    seconds(10)
    assert seconds(20_000) < 3 * seconds(10)  # before: some milliseconds for each stream
