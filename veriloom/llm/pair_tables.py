"""A pair of tables, rewritten as co-bucketed files, with a distributed sorted-key index.

The keys of the first table are counted by bucket and stored as an index: files by bucket, whose rows each hold a sorted
array of unique keys and one of their counts (a part of the bucket: parts are slices of a hash, so that each has about
PART_KEYS keys whatever the size of the table). The second table's keys, counted by key and starting file before they
move, are dealt to the same parts, where they probe the array by searchsorted: that tells keys that no row of the first
table has (orphans), the rows of the inner join, and the lineage of each bucket. No payload takes part. Orphans are
stored as an index of their own; rows that move to their bucket's file stream past their bucket's arrays of it, for which
an index row sorts before the rows of its part.

A bucket's file is written by one task, which sorts and streams; all else is spread by key, and counts are combined before
they are shuffled, so that a key with a third of all rows is a few rows there.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veriloom.llm.names import free
from veriloom.session import ready, shared_dir, staged, tidy, unstage

BUCKETS, SALT = 150, "pair"
#: Keys of one array of the index (about).
PART_KEYS = 1 << 16
#: Tables that a call writes for itself, beside the data files.
WORK = ("keys", "index", "probed", "orphans", "flows")
_INDEX = "bucket int, part int, keys binary, counts binary"


def bucket(key: str | Column, buckets: int = BUCKETS) -> Column:
    """The bucket of a key: buckets + 1 for null (buckets itself is for orphans)."""
    col = F.col(key) if isinstance(key, str) else key
    return F.coalesce(F.crc32(F.concat(F.lit(SALT), col.cast("string")).cast("binary")) % buckets, F.lit(buckets + 1)).cast("int")


def first_files(key: str | Column, buckets: int = BUCKETS) -> Column:
    """The starting file of a row of the first table: its bucket, or the one before for each fifth."""
    b = bucket(key, buckets)
    return F.when(b % 5 == 1, b - 1).otherwise(b)


def second_files(item: str, buckets: int = BUCKETS) -> Column:
    """The starting file of a row of the second table."""
    return F.coalesce(F.crc32(F.col(item).cast("string").cast("binary")) % buckets, F.lit(0)).cast("int")


def _order(columns: list[str], key: str) -> list[Column]:
    """The order within a file: the key descending, the rest ascending, nulls first."""
    return [F.col(key).desc_nulls_first(), *[F.col(c).asc_nulls_first() for c in columns if c != key]]


class _Folder:
    """A folder whose data files have plain names: <table>/<kind>-<number>.parquet."""

    def __init__(self, spark: SparkSession):
        self.spark, self.at = spark, f"{shared_dir(spark)}/veriloom/pair-{uuid.uuid4().hex}"
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self._path(self.at).getFileSystem(self._conf)

    def _path(self, at: str):
        return self._jvm.org.apache.hadoop.fs.Path(at)

    def write(self, rows: DataFrame, columns: list[str], number: str, table: str, kind: str) -> dict[int, list[str]]:
        """Rows, sorted within partitions by number first, as one file for each number that one partition has alone; files
        move to their names after. Of numbers that several partitions have it returns the files, which don't move."""
        work, several = f"{self.at}/work-{uuid.uuid4().hex}", {}
        rows.select(*columns, number).write.partitionBy(number).parquet(work)
        self.fs.mkdirs(self._path(f"{self.at}/{table}"))
        for folder in self.fs.listStatus(self._path(work)):  # a folder for each number
            name = folder.getPath().getName()
            if not folder.isDirectory() or "=" not in name:
                continue
            at, parts = int(name.rpartition("=")[2]), [f.getPath() for f in self.fs.listStatus(folder.getPath()) if f.getPath().getName().startswith("part-")]
            if len(parts) > 1:
                several[at] = [p.toString() for p in parts]
            elif not self.fs.rename(parts[0], self._path(self.file(table, kind, at))):
                raise OSError(f"{parts[0].toString()} can't be moved")
        if not several:
            unstage(self.spark, work)
        return several

    def file(self, table: str, kind: str, number: int) -> str:
        return f"{self.at}/{table}/{kind}-{number:05d}.parquet"

    def names(self, table: str) -> list[str]:
        at = self._path(f"{self.at}/{table}")
        return sorted(f.getPath().getName() for f in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def read(self, schema: T.StructType, table: str) -> DataFrame:
        """The table's files with `path`; of no file, an empty table."""
        files = [f"{self.at}/{table}/{n}" for n in self.names(table) if n.endswith(".parquet")]
        if not files:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*files)


def _cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (bucket, part, key, n), sorted, as one index row for each part, which holds about PART_KEYS of them."""

    def packed(at: tuple, held: list[pd.DataFrame]) -> pd.DataFrame:
        keys, counts = (np.concatenate([f[c].to_numpy(np.int64) for f in held]) for c in ("key", "n"))
        return pd.DataFrame([(*at, keys.tobytes(), counts.tobytes())], columns=["bucket", "part", "keys", "counts"])

    last, held = None, []
    for frame in frames:
        for at, own in frame.groupby(["bucket", "part"], sort=False):
            if last is not None and at != last:
                yield packed(last, held)
                held = []
            last = at
            held.append(own)
    if last is not None:
        yield packed(last, held)
    tidy()


class Index:
    """Sorted unique keys with counts, in files by bucket; probed by searchsorted."""

    def __init__(self, keys: DataFrame, at: str, parts: int):
        """keys (bucket, key, n): a row for each key."""
        self.at, self.parts, self.spark = at, parts, keys.sparkSession
        dealt = keys.withColumn("part", self.part("key")).repartition("bucket", "part").sortWithinPartitions("bucket", "part", "key")
        dealt.select("bucket", "part", "key", "n").mapInPandas(_cut, _INDEX).write.partitionBy("bucket").parquet(at)

    def part(self, key: str | Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.parts)).cast("int")

    def rows(self) -> DataFrame:
        return self.spark.read.schema(_INDEX).parquet(self.at).select("bucket", "part", "keys", "counts")

    def probed(self, rows: DataFrame, bucket_col: str, key: str, out: str, partitions: int | None = None) -> DataFrame:
        """rows with the count of their key (0 for none) as `out`; dealt by bucket and part, or, where partitions is given,
        by bucket, one each.

        An index row sorts before the rows of its part, so a task holds one part's arrays and a batch of rows.
        """
        part, late, keys, counts = free(rows, "part", "late", "keys", "counts")
        own = self.rows().select(F.col("bucket").alias(bucket_col), F.col("part").alias(part), F.col("keys").alias(keys), F.col("counts").alias(counts), F.lit(False).alias(late))
        both = rows.withColumns({part: F.coalesce(self.part(F.col(key)), F.lit(0)), late: F.lit(True)}).unionByName(own, allowMissingColumns=True)
        dealt = both.repartitionById(partitions, F.col(bucket_col)) if partitions else both.repartition(bucket_col, part)
        ordered = dealt.sortWithinPartitions(bucket_col, part, late)
        schema = T.StructType([*rows.schema.fields, T.StructField(out, T.LongType())])
        return ordered.mapInArrow(_probe(rows.columns, bucket_col, key, part, late, keys, counts, out), schema)


def _probe(columns: list[str], bucket_col: str, key: str, part: str, late: str, keys: str, counts: str, out: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own, n = None, np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            where = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in (bucket_col, part)], axis=1)
            is_row = batch.column(late).to_numpy(zero_copy_only=False).astype(bool)
            probe = batch.column(key)
            null = probe.is_null().to_numpy(zero_copy_only=False)
            probe = probe.fill_null(0).to_numpy(zero_copy_only=False)
            found = np.zeros(len(probe), dtype=np.int64)
            cuts = np.flatnonzero((where[1:] != where[:-1]).any(1)) + 1
            for a, z in zip([0, *cuts], [*cuts, len(probe)], strict=True) if len(probe) else ():
                if at != tuple(where[a]):
                    at, own, n = tuple(where[a]), np.zeros(0, np.int64), np.zeros(0, np.int64)
                if not is_row[a]:  # an index row comes first, and there is one for a part
                    own, n = (np.frombuffer(batch.column(c)[int(a)].as_py(), np.int64) for c in (keys, counts))
                if len(own):
                    i = np.minimum(np.searchsorted(own, probe[a:z]), len(own) - 1)
                    found[a:z] = np.where((own[i] == probe[a:z]) & ~null[a:z], n[i], 0)
            table = pa.Table.from_batches([batch]).select(columns).append_column(out, pa.array(found, pa.int64())).filter(pa.array(is_row))
            yield from table.combine_chunks().to_batches()
        tidy()

    return run


def _digests(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (table_name, path, key, n), sorted, as one digest for each path: its keys in file order, comma-joined."""
    last, sha, rows, done = None, None, 0, []
    for frame in frames:
        for name, path, key, n in zip(frame["table_name"], frame["path"], frame["key"], frame["n"], strict=True):
            if last != (name, path):
                if last:
                    done.append((*last, sha.hexdigest(), rows))
                last, sha, rows = (name, path), hashlib.sha256(), 0
            text, left = (key or "").encode() + b",", int(n)
            sha.update(text[:-1] if not rows else b"," + text[:-1])
            rows, left = rows + left, left - 1
            text = b"," + text[:-1]
            while left:  # in pieces, as a key may have any number of rows
                k = min(left, 1 << 16)
                sha.update(text * k)
                left -= k
        yield pd.DataFrame(done, columns=["table_name", "path", "ids_sha256", "n_rows"])
        done = []
    if last:
        yield pd.DataFrame([(*last, sha.hexdigest(), rows)], columns=["table_name", "path", "ids_sha256", "n_rows"])
    tidy()


def rewrite_pair(first: DataFrame, second: DataFrame, key: str = "sale_id", *, starts: tuple[Column, Column], names: tuple[str, str] = ("sales", "sale_lines"), buckets: int = BUCKETS) -> DataFrame:
    """Writes both tables into a new folder of the shared one, in the starting files that `starts` numbers, then as one file
    for each table and bucket, and returns a row for each final file: table_name, path, columns, ids_sha256,
    lineage_sha256, bucket, n_rows, n_joined, rewritten.

    bucket() numbers the buckets; rows of the second table whose key the first doesn't have take `buckets`, and null keys of
    either table buckets + 1. A starting file that holds exactly the rows of a final file stays as that one; all other
    starting files are deleted once the final files are written. Files hold the table's columns in order, sorted by the
    key descending, then by the other columns from left to right ascending, nulls first. n_joined counts the rows of the
    inner join on the key that the bucket's keys have (0 for orphans and nulls).

    The key is an integer; all other columns must be sortable. Repeated rows stay as often as they occur, on both sides;
    columns of any name are taken, as the operator's own ones get free names. Empty tables have no files and no rows.
    The work is done when the call returns; a call that is cut off leaves its folder, which no later call reads.
    """
    spark = ready(first.sparkSession)
    folder = _Folder(spark)
    frames, cols = (first, second), (first.columns, second.columns)
    own = [free(df, "bucket", "start") for df in frames]

    def dealt(rows: DataFrame, n: str) -> DataFrame:
        return rows.repartitionById(buckets + 2, F.col(n))

    def sorted_files(rows: DataFrame, n: str, columns: list[str], name: str, kind: str) -> dict[int, list[str]]:
        return folder.write(rows.sortWithinPartitions(n, *_order(columns, key)), columns, n, name, kind)

    # starting files
    for df, c, (_, s), start, name in zip(frames, cols, own, starts, names, strict=True):
        sorted_files(dealt(df.withColumn(s, start), s), s, c, name, "start")
    tables = [folder.read(df.schema, name) for df, name in zip(frames, names, strict=True)]
    number = lambda: F.regexp_extract(F.col("_metadata.file_name"), r"-(\d+)\.parquet", 1).cast("int")

    # keys of each starting file, counted before they move
    keys = []
    for t, name in zip(tables, names, strict=True):
        start = number() if folder.names(name) else F.lit(0)
        keys.append(t.select(F.col(key).cast("long").alias("key"), start.alias("start")).groupBy("key", "start").agg(F.count("*").alias("n")).withColumn("bucket", bucket("key", buckets)))
    keys[0].write.parquet(f"{folder.at}/work-keys")
    known = spark.read.schema(keys[0].schema).parquet(f"{folder.at}/work-keys")
    unique = known.where("key is not null").groupBy("bucket", "key").agg(F.sum("n").alias("n"))
    parts = lambda n: max(1, -(-n // (buckets * PART_KEYS)))
    index = Index(unique, f"{folder.at}/work-index", parts(known.count()))
    index.probed(keys[1], "bucket", "key", "matches").write.parquet(f"{folder.at}/work-probed")
    probed = spark.read.schema(T.StructType([*keys[1].schema.fields, T.StructField("matches", T.LongType())])).parquet(f"{folder.at}/work-probed")
    to = F.when(F.col("key").isNotNull() & (F.col("matches") == 0), F.lit(buckets)).otherwise(F.col("bucket"))
    lost = probed.where("key is not null and matches = 0").groupBy("bucket", "key").agg(F.sum("n").alias("n"))
    orphans = Index(lost, f"{folder.at}/work-orphans", parts(lost.count()))

    # what of each starting file goes where: at most (buckets + 1) * (buckets + 2) rows a table
    flows = known.select(F.lit(names[0]).alias("table_name"), "bucket", "start", "n", F.lit(0).alias("j")).unionByName(probed.select(F.lit(names[1]).alias("table_name"), to.alias("bucket"), "start", "n", (F.col("n") * F.col("matches")).alias("j")))
    flows.groupBy("table_name", "bucket", "start").agg(F.sum("n").alias("n"), F.sum("j").alias("j")).write.parquet(f"{folder.at}/work-flows")
    flow = spark.read.schema("table_name string, bucket int, start int, n long, j long").parquet(f"{folder.at}/work-flows")
    into = flow.groupBy("table_name", "bucket").agg(F.count("*").alias("sources"), F.min("start").alias("start"), F.sum("j").alias("j"), F.array_sort(F.collect_list(F.struct("start", "n"))).alias("lineage"))
    out_of = flow.groupBy("table_name", "start").agg(F.count("*").alias("targets"))
    stays = {(r.table_name, r.bucket): r.start for r in into.where("sources = 1").join(out_of.where("targets = 1"), ["table_name", "start"]).select("table_name", "bucket", "start").collect()}  # 2 * (buckets + 2) rows at most

    # final files
    for k, (t, c, (b, s), name) in enumerate(zip(tables, cols, own, names, strict=True)):
        staying = [start for (n, _), start in stays.items() if n == name]
        files = [f"{folder.at}/{name}/{f}" for f in folder.names(name) if f.endswith(".parquet") and int(f[6:-8]) not in staying]
        if not files:
            continue
        rows = spark.read.schema(t.schema).parquet(*files).withColumn(b, bucket(key, buckets))
        if not k:
            sorted_files(dealt(rows, b), b, c, name, "bucket")
        else:
            flagged = orphans.probed(rows, b, key, s, buckets + 2)
            several = sorted_files(flagged.withColumn(b, F.when(F.col(s) > 0, F.lit(buckets)).otherwise(F.col(b))), b, c, name, "bucket")
            for at, found in several.items():  # orphans, which each bucket's task writes apart
                sorted_files(dealt(spark.read.schema(t.schema).parquet(*found).withColumn(b, F.lit(at)), b), b, c, name, "bucket")
                unstage(spark, found[0].rpartition("/")[0].rpartition("/")[0])
        unstage(spark, *files)

    # what the final files hold, read back
    kept = {f"start-{start:05d}.parquet": (n, b) for (n, b), start in stays.items()}
    made = []
    for t, c, name in zip(tables, cols, names, strict=True):
        if not folder.names(name):
            continue
        back = folder.read(t.schema, name).select(F.lit(name).alias("table_name"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file"), F.col(key).cast("long").alias("key"))
        made.append(back.groupBy("table_name", "path", "key").agg(F.count("*").alias("n")))
    if not made:
        unstage(spark, *[f"{folder.at}/work-{w}" for w in WORK])
        return spark.createDataFrame([], "table_name string, path string, columns string, ids_sha256 string, lineage_sha256 string, bucket long, n_rows long, n_joined long, rewritten boolean")
    both = made[0] if len(made) == 1 else made[0].unionByName(made[1])
    sorted_keys = both.repartition("table_name", "path").sortWithinPartitions("table_name", "path", F.col("key").desc_nulls_first()).withColumn("key", F.col("key").cast("string"))
    digests = sorted_keys.mapInPandas(_digests, "table_name string, path string, ids_sha256 string, n_rows long")
    places = spark.createDataFrame([(n, f"start-{s:05d}.parquet", b, False) for (n, b), s in stays.items()], "table_name string, file string, bucket int, rewritten boolean")
    file = F.regexp_extract("path", r"([^/]+)$", 1)
    placed = digests.withColumn("file", file).join(F.broadcast(places), ["table_name", "file"], "left").withColumn("bucket", F.coalesce("bucket", F.regexp_extract("file", r"-(\d+)\.parquet", 1).cast("int")))
    lineage = F.sha2(F.array_join(F.transform("lineage", lambda x: F.concat_ws(":", x["start"], x["n"])), ","), 256)
    about = into.select(F.col("table_name").alias("_t"), F.col("bucket").alias("_b"), lineage.alias("lineage_sha256"), "j")
    listed = F.when(F.col("table_name") == names[0], F.lit(",".join(cols[0]))).otherwise(F.lit(",".join(cols[1])))
    done = placed.join(about, (F.col("table_name") == F.col("_t")) & (F.col("bucket") == F.col("_b")))
    joined = about.where(F.col("_t") == names[1]).select(F.col("_b").alias("_k"), F.col("j").alias("n_joined"))
    result = done.join(joined, F.col("bucket") == F.col("_k"), "left").select(
        "table_name", "path", listed.alias("columns"), "ids_sha256", "lineage_sha256", F.col("bucket").cast("long").alias("bucket"), "n_rows", F.coalesce("n_joined", F.lit(0)).cast("long").alias("n_joined"), F.coalesce("rewritten", F.lit(True)).alias("rewritten"),
    )
    out, _ = staged(result, "pair-files")
    unstage(spark, *[f"{folder.at}/work-{w}" for w in WORK])
    return out
