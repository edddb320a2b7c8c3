"""The subpackage's queries over the smallest tables: against their SQL, or against plain versions of what they compute."""

import hashlib
import json
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests_llm_fixture import near_groups
from veriloom.llm import media, oracles, packing, pieces, quality_cnn, queries, secrets, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents():
    return {r[0]: r[1] or "" for r in duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()}


def rows(frame: pd.DataFrame) -> list[tuple]:
    return sorted(tuple(map(str, r)) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    ours = queries.QUERIES[name](spark, SF).toPandas()
    assert len(ours) and rows(ours) == rows(con.sql(oracles.ORACLES[name]).df())


def test_token_counts_equal_the_library(spark, documents):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = queries.op2_token_counts(spark, SF).collect()
    assert len(got) == len(documents)
    for r in got:
        n = len(model.encode(documents[r.doc_id]))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(documents[r.doc_id].encode()), n, n > 4096)


def changed(path, folds: int, kept: int, label: str) -> str:
    """Tables like SF's, but with other labels in the held-out fold, and other languages, sources and lengths."""
    docs, labels = (duckdb.sql(f"SELECT * FROM '{SF}/{t}.parquet'").df() for t in ("documents", "labels"))
    held = [zlib.crc32(str(d).encode()) % folds == kept for d in labels["doc_id"]]
    assert any(held)
    labels[label] = [1 - y if h else y for y, h in zip(labels[label], held, strict=True)]
    docs["lang"], docs["source"], docs["n_chars"] = "xx", "other", 1
    os.makedirs(path, exist_ok=True)
    docs.to_parquet(f"{path}/documents.parquet")
    labels.to_parquet(f"{path}/labels.parquet")
    return str(path)


def sampled(folds: int, kept: int, label: str) -> pd.DataFrame:
    """All rows that may be learnt from (fewer than the sample's bound here)."""
    both = duckdb.sql(f"SELECT doc_id, text, {label} AS label FROM '{SF}/documents.parquet' JOIN '{SF}/labels.parquet' USING (doc_id)").df()
    return both[[zlib.crc32(str(d).encode()) % folds != kept for d in both["doc_id"]]]


def plain_toxicity(model, text: str) -> float:
    z = model.bias
    for word in set(re.findall(r"[^\W\d_]+", text.lower())):
        z += model.weights.get(word, 0.0) + sum(model.weights.get(word[:k] + "*", 0.0) for k in (4, 5, 6) if len(word) > k)
    return 1 / (1 + np.exp(-min(30.0, max(-30.0, z))))


def test_toxicity(spark, documents, tmp_path):
    got = {r.doc_id: r for r in queries.op3_toxicity(spark, SF).collect()}
    other = {r.doc_id: r.score for r in queries.op3_toxicity(spark, changed(tmp_path / "t", 3, 1, "toxic")).collect()}
    assert set(got) == set(documents) and all(abs(other[d] - r.score) < 1e-12 for d, r in got.items())  # nothing but texts and labels of other folds counts
    model = toxicity.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"), queries.fold("doc_id", 3) != 1)
    for d, r in got.items():
        assert r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1) == toxicity.held_out(d) and r.predicted == (r.score >= 0.7) and abs(r.score - plain_toxicity(model, documents[d])) < 1e-9
    assert len(sampled(3, 1, "toxic")) < toxicity.SAMPLE


def test_label_model_by_enumeration():
    draw = np.random.default_rng(3)
    y = draw.random(3000) < 0.3
    right = lambda share: np.where(draw.random(3000) < share, np.where(y, 1, -1), np.where(y, -1, 1))
    first = right(0.75)
    votes = np.stack([first, first, *(right(0.75) * (draw.random(3000) < 0.8) for _ in range(6))], axis=1)
    model = toxicity.LabelModel().fit(votes)
    assert 1 in [model.parents[0], model.parents[1]] or 0 in [model.parents[0], model.parents[1]]  # the copies are joined
    for v in votes[:20]:
        joint = [model.prior if label else 1 - model.prior for label in (0, 1)]
        for label in (0, 1):
            for j, k in enumerate(model.parents):
                joint[label] *= model.table[j, label, v[k] + 1 if k >= 0 else 0, v[j] + 1]
        assert abs(model.posterior(v[None])[0] - joint[1] / sum(joint)) < 1e-9
    best = max(((votes[:, j] > 0) == y).mean() for j in range(votes.shape[1]))
    assert np.allclose(model.table.sum(3), 1) and ((model.posterior(votes) > 0.5) == y).mean() > best + 0.05


def plain_network(net, text: str) -> float:
    """The network one place and one chunk at a time."""
    raw = quality_cnn._frame(text.encode())
    n = (len(raw) - quality_cnn.WIDTH) // quality_cnn.STRIDE + 1
    places = [np.maximum(net.emb[raw[p * quality_cnn.STRIDE : p * quality_cnn.STRIDE + quality_cnn.WIDTH]].reshape(-1) @ net.filters + net.bias, 0) for p in range(n)]
    best = np.zeros(quality_cnn.UNITS)
    starts = range(0, n, quality_cnn.HALF)
    for k in range(max(1, len(starts) - 1)):
        a = k * quality_cnn.HALF
        z = min(n, a + 2 * quality_cnn.HALF)
        pairs = np.zeros(quality_cnn.LAGS)
        for i in range(a * quality_cnn.STRIDE, min(z * quality_cnn.STRIDE, len(raw))):
            for lag in range(1, quality_cnn.LAGS + 1):
                if i >= lag:
                    pairs[lag - 1] += net.pair[raw[i]] @ net.pair[raw[i - lag]] / quality_cnn.STRIDE
        mean = np.concatenate([np.sum(places[a:z], axis=0), pairs]) / (z - a)
        best = np.maximum(best, np.maximum(mean @ net.units + net.level, 0))
    return 1 / (1 + np.exp(-np.clip(best @ net.out + net.last[0], -30, 30)))


def test_quality(spark, documents, tmp_path):
    got = {r.doc_id: r for r in queries.op5_quality_classifier(spark, SF).collect()}
    other = {r.doc_id: r.score for r in queries.op5_quality_classifier(spark, changed(tmp_path / "q", 5, 0, "quality")).collect()}
    assert set(got) == set(documents) and all(abs(other[d] - r.score) < 1e-9 for d, r in got.items())
    net = quality_cnn.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"), queries.fold("doc_id", 5) != 0)
    for d, r in got.items():
        assert r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) == quality_cnn.held_out(d) and r.predicted == (r.score >= 0.3)
    short = sorted(documents, key=lambda d: len(documents[d]))[:12]
    for text in ("", "a", "abcdefgh", "x" * 64, "xy" * 33, *(documents[d] for d in short)):
        assert abs(net.score(text) - plain_network(net, text)) < 1e-4
    step, quality_cnn.STEP = quality_cnn.STEP, quality_cnn.HALF
    try:  # pieces of a text give what the whole gives
        assert all(abs(net.score(documents[d]) - got[d].score) < 1e-5 for d in list(documents)[:20])
    finally:
        quality_cnn.STEP = step


@pytest.mark.parametrize(("label", "folds", "kept", "least"), [("quality", 5, 0, (0.7, 0.95)), ("toxic", 3, 1, (0.95, 0.7))])
def test_held_out_accuracy(label, folds, kept, least):
    """Of a larger table's held-out rows, the share of each label that is told; fitted on its other rows."""
    both = duckdb.sql(f"SELECT doc_id, coalesce(text, '') AS text, {label} AS label FROM '/root/testdata/sf0.01/documents.parquet' JOIN '/root/testdata/sf0.01/labels.parquet' USING (doc_id) ORDER BY doc_id").df()
    held = np.array([zlib.crc32(str(d).encode()) % folds == kept for d in both["doc_id"]])
    train, test = both[~held], both[held]
    model = (quality_cnn.Network() if label == "quality" else toxicity.Toxicity()).fit(train["text"].tolist(), train["label"].tolist())
    score = model.score if label == "quality" else model.scorer()
    told = np.array([score(t) >= (0.3 if label == "quality" else 0.7) for t in test["text"]]).astype(int)
    for y in (0, 1):
        own = test["label"].to_numpy() == y
        assert (told[own] == y).mean() >= least[y], (label, y, (told[own] == y).mean(), own.sum())


def test_pieces(spark, documents):
    model = pieces.Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    got = {r.doc_id: r for r in queries.op6_piece_encoding(spark, SF).collect()}
    assert set(got) == set(documents)
    for d, text in documents.items():
        words = pieces.words_of(text)
        keys = pieces.keys_of(text, len(words), 1).tolist()
        ids = [x for w, k in zip(words, keys, strict=True) for x in model.segment(pieces.SPACE + w.replace(" ", pieces.SPACE), k, 0.1)]
        assert got[d].lossless and (got[d].n_tokens, got[d].ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) and got[d].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def frames(data: bytes) -> bytes:
    """The ancillary bytes of a stream of 48 kHz mono frames without side information, read plainly: behind the tag and the
    first frame, each frame's bytes behind header, checksum and 17 zero bytes."""
    at, parts = 10 + sum(b << s for b, s in zip(data[6:10], (21, 14, 7, 0), strict=True)), []
    kbit = (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)
    while at < len(data):
        assert data[at] == 0xFF and data[at + 1] == 0xFA and data[at + 3] == 0xC0 and not any(data[at + 6 : at + 23])
        size = 144 * kbit[data[at + 2] >> 4] * 1000 // 48000
        parts.append(data[at + 23 : at + size])
        at += size
    assert at == len(data)
    return b"".join(parts[1:])


def test_media(spark, documents):
    got = {r.doc_id: r for r in queries.op9_media_columns(spark, SF).collect()}
    streams = {r.doc_id: bytes(r.media) for r in media.media_column(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")).collect()}
    for d, text in documents.items():
        payload = text.encode() + bytes(-len(text.encode()) % 64 or (0 if text else 64))
        r, data = got[d], streams[d]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(text.encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(data), hashlib.sha256(data).hexdigest()) and frames(data)[: len(payload)] == payload
    assert len({r.feature for r in got.values()}) > 20


def test_packing(spark, documents):
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    at, sequences = dict.fromkeys(documents, 0), {}
    ids = {d: [*full.encode(t, add_special_tokens=False).ids, 0] for d, t in documents.items()}
    for r in sorted(queries.op10_packing(spark, SF).collect(), key=lambda r: (r.doc_id, r.start)):
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert r.start == at[r.doc_id] and r.length == len(own) > 0 and r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(np.array(own, "<u4").tobytes())
        at[r.doc_id] += r.length
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(at[d] == len(x) for d, x in ids.items())
    for parts in sequences.values():
        end = 0
        for offset, n in sorted(parts):
            assert offset == end
            end += n
        assert end <= 1024 and (end & (end - 1) == 0 or end == 1024)


def test_packing_ids_of_odd_texts():
    path, draw = public_tokenizers.path("byte_bpe_50k.json"), random.Random(2)
    full, _ = packing.encoders(path)
    every = [chr(c) for c in [9, 10, 13, *range(0x20, 0x7F), *range(0xA0, 0x250), 0x2013, 0x2019, 0x2026, 0x20AC]]
    often = "  \n\tabcXYZ019'sdmtlre.,;!-éüñ\xa0"
    for _ in range(20000):
        t = "".join(draw.choice(often if draw.random() < 0.7 else every) for _ in range(draw.randint(0, 40)))
        assert packing.encode(t, path).tolist() == full.encode(t, add_special_tokens=False).ids
    for t in ("abc def. " * 300_000, "x" * 100_000, " " * 2_500_000, "a <|endoftext|> b", "日本 🎈", "\x85\x1c a"):
        assert packing.encode(t, path).tolist() == full.encode(t, add_special_tokens=False).ids


def brute_redact(text: str) -> str:
    found = []
    for k, r in enumerate(secrets.RULES):
        rx = re.compile(r.regex.replace("(?i)", ""), re.I | re.A if r.any_case else re.A)
        found += [(m.start(), k, m.end(), r.kind) for m in rx.finditer(text) if len(m[r.group]) >= r.least]
    out, at = [], 0
    for s, _, e, kind in sorted(found):
        if s >= at:
            out.append(f"{text[at:s]}[{kind}]")
        at = max(at, e)
    return "".join(out) + text[at:]


def repeats(words: list[str]) -> int:
    seen = {}
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i : i + 3]), []).append(i)
    return len({i + j for at in seen.values() if len(at) > 1 for i in at for j in range(3)})


def test_pipeline_run(spark, documents, tmp_path):
    """run() against the stages done plainly: scores, rules, groups, redactions and pieces; some texts get a secret."""
    from tokenizers import Tokenizer

    frame = duckdb.sql(f"SELECT * FROM '{SF}/documents.parquet'").df()
    frame["text"] = [t if d % 4 else f"{t}\npassword: {d}hunter2hunter2, ghp_{'a' * 36}" for d, t in zip(frame["doc_id"], frame["text"], strict=True)]
    documents = dict(zip(frame["doc_id"].tolist(), frame["text"].tolist(), strict=True))
    frame.to_parquet(f"{tmp_path}/documents.parquet")
    duckdb.sql(f"COPY (SELECT * FROM '{SF}/labels.parquet') TO '{tmp_path}/labels.parquet'")
    labels = {r[0]: r[1] for r in duckdb.sql(f"SELECT doc_id, quality FROM '{SF}/labels.parquet'").fetchall()}
    net = quality_cnn.fit(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet"), queries.fold("doc_id", 5) != 0)
    first = {d: t for d, t in documents.items() if net.score(t) >= 0.3}
    bad, good = [d for d, y in labels.items() if y == 0], [d for d, y in labels.items() if y == 1]
    assert sum(d in first for d in good) >= 0.95 * len(good) and sum(d in first for d in bad) <= 0.5 * len(bad)  # eleven bad rows to learn from
    words = {d: re.findall(r"[^\x20\x09-\x0D]+", t) for d, t in first.items()}
    second = {d: t for d, t in first.items() if len(words[d]) >= 50 and 100 * repeats(words[d]) <= 50 * len(words[d])}
    groups = near_groups(second)
    third = {d: brute_redact(t) for d, t in second.items() if d in groups}
    assert any(third[d] != second[d] for d in third) and len(third) < len(second) < len(first) < len(documents)
    full = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {d: [*full.encode(t, add_special_tokens=False).ids, 0] for d, t in third.items()}
    got = {}
    for r in queries.QUERIES["pipeline"](spark, str(tmp_path)).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    assert set(got) == set(third)
    for d, parts in got.items():
        at = 0
        for start, n, crc, total in sorted(parts):
            assert start == at and total == len(ids[d]) and crc == zlib.crc32(np.array(ids[d][start : start + n], "<u4").tobytes())
            at += n
        assert at == len(ids[d])


CLASH = "doc_id long, text string, lang string, source string, n_chars long, __veriloom_id string, `__VERILOOM_key` string, secrets string, quality_rules string, media string, features string, n_tokens string, score string, predicted string, __both string, digest string, owner string"


def clash(spark):
    draw = random.Random(4)
    text = lambda n: " ".join(draw.choice("alpha beta gamma delta rho tau psi chi omega kappa zeta eta".split()) + str(draw.randint(0, 60)) for _ in range(n))
    base = text(80)
    texts = [None, "", " \n ", base, base, base + " end", text(70) + " password=abcdefgh12", text(30_000), "a\x00b"]
    more = ["c"] * 12
    return spark.createDataFrame([(k if k != 6 else None, t, None, None, None, *more) for k, t in enumerate(texts)] + [(3, base, "en", "h", 1, *more)] * 2, CLASH), texts


def test_stages_take_odd_rows(spark, tmp_path):
    frame, texts = clash(spark)
    pd.DataFrame({"doc_id": [3, 4], "quality": [1, 1], "toxic": [0, 0]}).to_parquet(f"{tmp_path}/labels.parquet")
    none = spark.createDataFrame([], frame.schema)
    for name, stage in corpus_pipeline.STAGES:
        done = stage(spark, frame, str(tmp_path))
        assert name == "packing" or done.columns == frame.columns
        n = done.count()
        assert stage(spark, none, str(tmp_path)).count() == 0
        if name == "quality_classifier":
            assert n == 11  # one class of labels: all stay
        if name == "quality_rules":
            assert n == 7 and done.where("text is null or length(text) < 10").count() == 0
        if name == "ngram_jaccard_join":
            assert sorted(str(r.doc_id) for r in done.collect()) == ["0", "1", "2", "3", "7", "8", "None"]
        if name == "secret_scans":
            assert n == 11 and done.where("n_chars is not null and n_chars <> char_length(text)").count() == 0 and done.where("text like '%[assign]'").count() == 1 and done.where("text is null and n_chars is null").count() == 1
        if name == "packing":
            assert done.agg(F.sum("length")).first()[0] == sum(len(x) + 1 for x in (packing.encode(t or "", public_tokenizers.path("byte_bpe_50k.json")) for t in [*texts, texts[3], texts[3]]))


def test_operators_take_clashing_columns(spark):
    from veriloom.llm import quality_rules, token_counts

    frame, texts = clash(spark)
    counted = token_counts.count_tokens(frame)
    assert counted.count() == 11 and dict(counted.dtypes)["n_tokens"] == "bigint" and counted.where("text is null and n_tokens = 0").count() == 1
    ruled = quality_rules.apply_rules(frame)
    assert ruled.count() == 11 and ruled.where("quality_rules.kept").count() == 7
    stored = media.media_features(media.media_column(frame))
    assert stored.count() == 11 and stored.where("features.payload_bytes < 64").count() == 0
    found = secrets.scan(frame)
    assert found.count() == 11 and found.where("size(secrets) = 1").count() == 1 and found.columns.count("secrets") == 1
    back = pieces.round_trip(frame, rate=0.3)
    assert back.count() == 11 and all(r.decoded == (r.text or "") and r["__both"] == "c" for r in back.collect())
    for module, model in ((toxicity, toxicity.Toxicity()), (quality_cnn, quality_cnn.Network())):
        scored = module.score(frame, model)
        assert scored.count() == 11 and scored.select("text", "score").distinct().count() == scored.select("text").distinct().count()


def test_classes_that_tie_and_repeat(spark):
    docs = spark.createDataFrame([(1, "good words here"), (1, "good words here"), (2, "bad words there"), (3, "x"), (4, None), (None, "y")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, 0, 1), (3, 1, 0), (3, 0, 1), (4, 0, 1), (None, 1, 1), (9, 1, 1)], "doc_id long, quality int, toxic int")
    from veriloom.llm.labelled import sample

    got = sample(docs, labels, "quality", F.lit(True), 10)
    assert sorted(map(tuple, got.itertuples(index=False))) == [("", 0), ("bad words there", 0), ("good words here", 1), ("good words here", 1)]
    assert len(sample(docs, labels.where("doc_id < 9"), "quality", F.lit(True), 2)) == 2 >= len(sample(docs, labels, "quality", F.lit(True), 2))  # id 9 has no text
    assert [len(sample(docs, labels, "quality", F.lit(True), 10, most_bytes=n)) for n in (0, 1 << 20)] == [1, 4]
    for module, label in ((toxicity, "toxic"), (quality_cnn, "quality")):
        scores = module.score(docs, module.fit(docs, labels, F.lit(True), label=label)).collect()
        assert len(scores) == 6 and all(0 <= r.score <= 1 for r in scores)


def test_many_secrets_in_one_text(spark):
    text = "".join(f"password{i}=x secret=abcdefgh{i:06d} " for i in range(20_000))
    frame = spark.createDataFrame([(1, text), (1, text), (2, "token: abcdefgh")], "doc_id long, text string")
    found = secrets.scan(frame).selectExpr("doc_id", "size(secrets) AS n", "secrets[size(secrets) - 1].`end` AS last").collect()
    assert sorted((r.doc_id, r.n, r.last) for r in found) == [(1, 20_000, len(text) - 1)] * 2 + [(2, 1, 15)]
    assert {r.text for r in secrets.redact(frame).collect()} == {brute_redact(text), "[assign]"}


def test_chat_edges(spark):
    from veriloom.llm import chat

    schema = "conv_id long, turn long, role string, text string, segments string, turns string, blocks string"
    long = "word " * 100_000
    rows_ = [(1, 0, "user", "<|reserved_special_token_0|> <start_of_turn>x</s>", "a", "b", "c"), (1, 1, "assistant", long, "a", "b", "c"), (1, 1, "assistant", long, "a", "b", "c")]
    done = chat.format_conversations(spark.createDataFrame(rows_, schema))
    r = done.select("formatted", chat.parse(F.col("formatted")).alias("turns"), chat.loss_text(F.col("segments")).alias("loss")).first()
    assert [tuple(t) for t in r.turns] == [(x[2], x[3]) for x in rows_] and r.loss == long * 2 and "<|reserved" not in r.formatted and "<start_of" not in r.formatted and "</s>" not in r.formatted
    assert chat.format_conversations(spark.createDataFrame([], schema)).count() == 0


def bits(data: bytes) -> list[int]:
    return [b >> (7 - k) & 1 for b in data for k in range(8)]


def crc(values: list[int]) -> int:
    c = 0xFFFF
    for b in values:
        top = (c >> 15) ^ b
        c = ((c << 1) & 0xFFFF) ^ (0x8005 if top else 0)
    return c


def test_streams_of_other_writers():
    draw = random.Random(1)

    def second(right: bool = True) -> bytes:  # layer II, 44.1 kHz stereo, 64 kbit/s a channel: 27 subbands
        head = ((0x7FF << 21) | (3 << 19) | (2 << 17) | (8 << 12)).to_bytes(4, "big")
        allocation, chosen = [], 0
        for k in range(27):
            width = 4 if k < 11 else 3 if k < 23 else 2
            for _ in range(2):
                v = draw.choice([0, draw.randrange(1 << width)])
                chosen += v > 0
                allocation += [v >> (width - 1 - j) & 1 for j in range(width)]
        body = allocation + [draw.randrange(2) for _ in range(2 * chosen)]
        check = crc(bits(head[2:]) + body) ^ (not right)
        body += [draw.randrange(2) for _ in range((144 * 128000 // 44100 - 6) * 8 - len(body))]
        return head + check.to_bytes(2, "big") + bytes(sum(b << (7 - k) for k, b in enumerate(body[i : i + 8])) for i in range(0, len(body), 8))

    x = media.read_stream(second() + second() + second(False) + second())
    assert (x["frames"], x["samples"], x["crc_right"], x["crc_wrong"], x["skipped"], x["rate"]) == (4, 4608, 3, 1, 0, 44100)

    def first() -> bytes:  # layer I, joint stereo from subband 8
        head = ((0x7FF << 21) | (3 << 19) | (3 << 17) | (5 << 12) | (1 << 10) | (1 << 6) | (1 << 4)).to_bytes(4, "big")
        body = bytes(draw.randrange(256) for _ in range(12000 * 160 // 48000 * 4 - 6))
        return head + crc(bits(head[2:]) + bits(body)[: 4 * (2 * 8 + 24)]).to_bytes(2, "big") + body

    x = media.read_stream(first() * 3)
    assert (x["frames"], x["samples"], x["crc_right"], x["crc_wrong"]) == (3, 1152, 3, 0)

    def third(body: bytes = b"") -> bytes:  # layer III, mono, without a checksum
        return ((0x7FF << 21) | (3 << 19) | (1 << 17) | (1 << 16) | (9 << 12) | (3 << 6)).to_bytes(4, "big") + body.ljust(144 * 128000 // 44100 - 4, b"\0")

    points = b"\0" * 32 + b"VBRI" + b"".join(n.to_bytes(k, "big") for n, k in ((1, 2), (0, 2), (75, 2), (1251, 4), (2, 4), (2, 2), (1, 2), (2, 2), (1, 2), (417, 2), (834, 2)))
    title = b"\x01" + "Ti€l".encode("utf-16")
    tag = b"TIT2" + len(title).to_bytes(4, "big") + b"\0\0" + title
    name = b"\x03" + "é".encode() * 66
    later = b"TPE1" + media._synchsafe(len(name)) + b"\0\0" + name
    data = b"ID3\x03\0\0" + media._synchsafe(len(tag)) + tag + b"ID3\x04\0\x10" + media._synchsafe(len(later)) + later + b"3DI\x04\0\x10" + media._synchsafe(len(later))
    x = media.read_stream(data + third(points) + third() + third())
    assert (x["frames"], x["samples"], x["skipped"], x["table"], x["table_frames"], x["table_bytes"]) == (2, 2304, 0, "VBRI", 2, 1251)
    assert [int.from_bytes(x["toc"][k : k + 4], "big") for k in (0, 4)] == [417, 1251] and x["tags"] == [("TIT2", "Ti€l"), ("TPE1", "é" * 66)]


def test_jaccard_on_dense_families(spark, monkeypatch):
    """Families of near copies and common passages, with sub-groups and blocks so small that every step takes part."""
    from veriloom.llm import ngram_join

    draw = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)]
    passages = [[draw.choice(vocabulary) for _ in range(draw.randint(20, 80))] for _ in range(5)]
    texts = {}
    for i in range(400):
        k = draw.random()
        if k < 0.35:
            w = [*draw.choice(passages), *(draw.choice(vocabulary) for _ in range(draw.randint(0, 25)))]
        elif k < 0.5:
            w = [*draw.choice(passages), *draw.choice(passages), *(draw.choice(vocabulary) for _ in range(draw.randint(0, 12)))]
        elif k < 0.85 and texts:
            w = draw.choice(list(texts.values())).split()
            for _ in range(draw.randint(0, 5) if w else 0):
                w[draw.randrange(len(w))] = draw.choice(vocabulary)
        else:
            w = [draw.choice(vocabulary) for _ in range(draw.randint(0, 60))]
        texts[i] = " ".join(w)
    monkeypatch.setattr(ngram_join, "GROUP", 4)
    monkeypatch.setattr(ngram_join, "BLOCK_TOKENS", 300)
    monkeypatch.setattr(ngram_join, "COMMON_LEAST", 3)
    got = ngram_join.jaccard_components(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)).collect()
    assert {r.component_id for r in got if r.n_shingles} | {r.doc_id for r in got if not r.n_shingles} == near_groups(texts)


def test_trigram_index(spark):
    texts = {1: "my password is", 2: "passwd", 3: "AKI KIA", 4: "AKIAB", 5: "", 6: "pass word"}
    frame = spark.createDataFrame(list(texts.items()), "key long, text string")
    postings = secrets.index(frame, secrets.RULES, 6)
    names = {k: t for (t, _), k in secrets.dictionary(secrets.RULES).items()}
    lists = {}
    for r in postings.collect():
        lists.setdefault(names[r.trigram], set()).update(r["keys"])
    assert lists["pas"] == {1, 2, 6} and lists["swd"] == {2} and lists["AKI"] == {3, 4} and all(any(t in x.lower() or t in x for x in (texts[k] for k in ks)) for t, ks in lists.items() for _ in [0])
    got = {r.key: sorted(secrets.RULES[k].kind for k in r.rules) for r in secrets.candidates(postings, secrets.RULES).collect()}
    assert got == {1: ["assign"], 2: ["assign"], 3: ["access"], 4: ["access"]}
    assert json.dumps(secrets.trigram_query(secrets.EXTRA[0])).count("BEG") == 6
