"""Near duplicates of embeddings, the Merkle manifest and the co-bucketed pair against plain versions, with odd rows."""

import collections
import hashlib
import math
import os
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from veriloom.llm import merkle, near_vectors, pair_tables
from veriloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
rng = np.random.default_rng(3)


def plain_links(rows):
    """(n_links, component_id) of each (id, vector, label), pair by pair."""
    unit = []
    for _, v, label in rows:
        good = label is not None and v is not None and len(v) and all(c is not None and math.isfinite(c) for c in v) and any(v)
        unit.append(np.array(v) / max(map(abs, v)) if good else None)
        if good:
            unit[-1] /= np.linalg.norm(unit[-1])
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = [0] * len(rows)
    for i, a in enumerate(unit):
        for j in range(i):
            b = unit[j]
            if a is not None and b is not None and len(a) == len(b) and rows[i][2] == rows[j][2] and a @ b >= 0.93:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return [(r[0], links[i], least.get(find(i)), r[0] == least.get(find(i))) for i, r in enumerate(rows)]


def key(row):
    return [(v is not None, v or 0) for v in row]


def at_angle(x, cosine):
    z = rng.standard_normal(len(x))
    z -= (z @ x) / (x @ x) * x
    return cosine * x / np.linalg.norm(x) + math.sqrt(1 - cosine**2) * z / np.linalg.norm(z)


def test_near_vectors_and_recall(spark):
    base = rng.standard_normal((12, 64))
    rows = [(i, list(map(float, base[i % 12])), i % 3) for i in range(12)]
    for k, c in enumerate([0.925, 0.935, 0.94, 0.95, 0.96, 0.97, 0.98, 0.99] * 25):  # pairs on both sides of the bound
        x = rng.standard_normal(64)
        rows += [(1000 + 2 * k, list(map(float, x)), k % 3), (1001 + 2 * k, list(map(float, at_angle(x, c))), k % 3)]
    rows += [(5000 + i, list(map(float, base[0] + 0.05 * rng.standard_normal(64))), 0) for i in range(700)]  # near copies, over several sub-groups
    rows += [(7000 + i, list(map(float, base[1])), 1) for i in range(300)]  # exact copies
    rows += [(8000, None, 1), (8001, [], 1), (8002, [0.0] * 64, 1), (8003, [float("nan")] + [1.0] * 63, 1), (8004, [None] + [1.0] * 63, 1), (8005, list(map(float, base[1])), None), (8006, [float("inf")] * 64, 1)]
    rows += [(8007, [1e200, 2e200], 1), (8008, [1e-200, 2e-200], 1), (8009, [1.0], 1), (8010, [3.0], 1), (8011, [-3.0], 1), (None, list(map(float, base[1])), 1), (7000, list(map(float, base[1])), 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("cid", F.lit(1)).withColumn("n_links", F.lit("x"))
    got = [tuple(r) for r in near_vectors.near_vectors(df).collect()]
    want = plain_links(rows)
    assert len(got) == len(want)
    assert sum(r[1] for r in got) >= 0.99 * sum(r[1] for r in want) and all(g[1] <= w[1] for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True))
    odd = {r[0] for r in want if r[0] is not None and 8000 <= r[0] < 8020}
    assert sorted((r for r in got if r[0] in odd), key=key) == sorted((r for r in want if r[0] in odd), key=key)
    dense = lambda rows: sorted(((r[0], r[1]) for r in rows if r[0] is not None and 5000 <= r[0] < 8000))
    assert dense(got) == dense(want)
    assert near_vectors.near_vectors(df.limit(0)).count() == 0


def test_near_vectors_of_one_dense_cloud(spark):
    """Members of one label of which some link and some don't: nothing is settled by balls alone."""
    x = rng.standard_normal(32)
    rows = [(i, list(map(float, at_angle(x, rng.uniform(0.9, 0.999)))), 4) for i in range(600)]
    got = sorted(tuple(r) for r in near_vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect())
    want = sorted(plain_links(rows))
    assert all(g[1] <= w[1] for g, w in zip(got, want, strict=True)) and sum(r[1] for r in got) >= 0.99 * sum(r[1] for r in want)
    assert [r[2] for r in got] == [r[2] for r in want]


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def levels(nodes, fanout=3):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest(*out[-1][i : i + fanout]) for i in range(0, len(out[-1]), fanout)])
    return out


def proof(tree, at):
    out = []
    for level in tree[:-1]:
        first = at - at % 3
        run = level[first : first + 3]
        out.append((at - first, run[: at - first] + run[at - first + 1 :]))
        at //= 3
    return out


def plain_manifest(rows):
    """doc_id, leaf, subroot, root, proof, folded root, verified of (doc_id, source, lang, n_chars, text)."""
    leaf = lambda d, text: digest(*[field(x) for x in (d[0], d[1], d[2], d[3], text)])
    by = collections.defaultdict(list)
    for d in rows:
        by[d[1]].append(d)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in sources:
        by[s].sort(key=lambda d: (d[0] is not None, d[0] or 0, leaf(d, d[4])))
    trees = [levels([leaf(d, d[4]) for d in by[s]]) for s in sources]
    top = levels([t[-1][0] for t in trees])
    for k, s in enumerate(sources):
        for i, d in enumerate(by[s]):
            path = proof(trees[k], i) + proof(top, k)
            even = d[0] is not None and d[4] is not None and zlib.crc32(str(d[0]).encode()) % 2 == 0
            x = leaf(d, d[4].replace("\n", "")) if even else trees[k][0][i]
            for place, siblings in path:
                x = digest(*siblings[:place], x, *siblings[place:])
            yield d[0], trees[k][0][i], trees[k][-1][0], top[-1][0], digest(*[n for _, siblings in path for n in siblings]), x, x == top[-1][0]


def test_merkle_manifest(spark, tmp_path):
    docs = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted(tuple(r) for r in QUERIES["op13_merkle_manifest"](spark, SF).collect()) == sorted(plain_manifest(docs))
    odd = [(i, "big", "en", 4, f"t\n{i}") for i in range(1000)] + [(None, None, None, None, None), (None, "", None, 1, "a\nb"), (7, "ü", "x", 2, "\n"), (7, "ü", "x", 2, "\n"), (8, "ü", None, 0, ""), (9, None, "", 1, "é" * 50_000 + "\n"), (-1, "big", "en", 1, "z")]
    df = spark.createDataFrame(odd, "doc_id long, source string, lang string, n_chars long, text string").withColumn("idx", F.lit("clash")).withColumn("path", F.lit(1))
    df.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op13_merkle_manifest"](spark, str(tmp_path)).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted(plain_manifest(odd), key=str)
    out = merkle.manifest(df, merkle.seal("doc_id", "text"), levels=1).collect()  # a tier for each level
    assert all(r.verified and merkle.fold(bytes.fromhex(r.leaf), bytes(r.path)).hex() == r.root for r in out) and len(out) == len(odd)
    assert merkle.manifest(df.limit(0), merkle.seal("doc_id")).count() == 0


def bucket(i):
    return 151 if i is None else zlib.crc32(f"pair{i}".encode()) % 150


def plain_pair(sales, lines, item):
    """{(table, bucket): (rows, Counter of starting files, joined rows, stayed)}"""

    def order(r):
        return [(0, 0) if r[0] is None else (1, -r[0])] + [(0, 0) if v is None else (1, v.encode() if isinstance(v, str) else v) for v in r[1:]]

    ids, final, start, joined, size = collections.Counter(r[0] for r in sales), {}, {}, collections.Counter(), collections.Counter()
    for name, rows in (("sales", sales), ("sale_lines", lines)):
        for r in rows:
            b = bucket(r[0])
            first = b - 1 if b % 5 == 1 else b
            if name == "sale_lines":
                b = 150 if r[0] is not None and r[0] not in ids else b
                first = 0 if r[item] is None else zlib.crc32(str(r[item]).encode()) % 150
                joined[b] += ids[r[0]] if b < 150 else 0
            final.setdefault((name, b), []).append(r)
            start.setdefault((name, b), collections.Counter())[first] += 1
            size[name, first] += 1
    return {k: (sorted(rows, key=order), start[k], joined[k[1]], len(start[k]) == 1 and size[k[0], min(start[k])] == len(rows)) for k, rows in final.items()}


def held(spark, result, sales, lines, item):
    got = {(r.table_name, r.bucket): r for r in result.collect()}
    want = plain_pair([tuple(r) for r in sales.collect()], [tuple(r) for r in lines.collect()], item)
    assert got.keys() == want.keys()
    local = lambda p: re.sub("^file:/+", "/", p)
    for k, (rows, start, joined, stayed) in want.items():
        r = got[k]
        file = pq.ParquetFile(local(r.path)).read()
        assert list(zip(*[file[c].to_pylist() for c in file.column_names], strict=True)) == rows
        assert r["columns"] == ",".join((sales if k[0] == "sales" else lines).columns) == ",".join(file.column_names)
        assert (r.n_rows, r.n_joined, r.rewritten) == (len(rows), joined, not stayed)
        assert r.ids_sha256 == digest(",".join("" if x[0] is None else str(x[0]) for x in rows))
        assert r.lineage_sha256 == digest(",".join(f"{s}:{n}" for s, n in sorted(start.items())))
    root = os.path.dirname(os.path.dirname(local(next(iter(got.values())).path)))
    assert {os.path.join(d, f) for d, _, fs in os.walk(root) for f in fs if not f.endswith(".crc")} == {local(r.path) for r in got.values()}


def test_co_bucketed_pair(spark):
    sales, lines = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("sales", "sale_lines"))
    held(spark, QUERIES["op12_co_bucketed_pair"](spark, SF), sales, lines, 2)


def test_co_bucketed_pair_of_odd_rows(spark):
    sales = spark.createDataFrame([(1, "a", None), (1, "a", None), (1, None, 2.0), (None, "é", 1.0), (None, "z", 1.0), (5, "", 0.0)], "sale_id long, __veriloom_bucket string, part double")
    lines = spark.createDataFrame([(1, 7, "x")] * 3 + [(1, None, None), (None, 7, "x"), (None, 7, None), (99, 8, "y"), (98, 9, "y"), (5, 7, "b")], "sale_id long, item_id long, matches string")
    starts = (pair_tables.first_files("sale_id"), pair_tables.second_files("item_id"))
    held(spark, pair_tables.rewrite_pair(sales, lines, starts=starts), sales, lines, 1)
    held(spark, pair_tables.rewrite_pair(sales.limit(0), lines, starts=starts), sales.limit(0), lines, 1)
    held(spark, pair_tables.rewrite_pair(sales, lines.limit(0), starts=starts), sales, lines.limit(0), 1)
    assert pair_tables.rewrite_pair(sales.limit(0), lines.limit(0), starts=starts).count() == 0
