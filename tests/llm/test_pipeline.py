"""The pipeline's stages on a small fixture against a brute-force version, and the entry's registration."""

import re

import __spark_entry__ as entry
import corpus_pipeline
from tests_llm_fixture import near_groups


def test_registration():
    names = entry.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 11)} and "pipeline" in names


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    results = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == list(corpus_pipeline.COLUMNS)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        results.append({r.doc_id: r for r in docs.collect()})
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    whole = {r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    good = [d for d in whole if labels.get(d) == 1]
    assert sum(d in results[0] for d in good) >= 0.95 * len(good)
    assert set(results[1]) == {d for d, r in results[0].items() if len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) >= 50 and not repeats(r.text)}
    assert set(results[2]) == near_groups({d: r.text for d, r in results[1].items()})
    assert set(results[3]) == set(results[2])
    packed = corpus_pipeline.pack(spark, docs, sf).collect()
    assert {r.doc_id for r in packed} == set(results[3])


def repeats(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = {}
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i : i + 3]), []).append(i)
    return 100 * len({i + j for at in seen.values() if len(at) > 1 for i in at for j in range(3)}) > 50 * len(words)
