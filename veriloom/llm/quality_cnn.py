"""Quality probability of whole texts by a byte-level convolutional network in numpy.

Bytes are embedded; learned filters of WIDTH bytes run over the text, STRIDE apart. A second layer of learned filters
runs over overlapping chunks of 2 * HALF such places, which cover the whole text. It takes the mean response of each first
filter in the chunk and, as second-order input (a linear filter can't tell that a word comes again), the mean product of
the chunk's embedded bytes with those 1 to LAGS bytes before them. Its responses are max-pooled over the text and combined
by a logistic unit into one probability. Nothing but bytes goes in, all weights are learned, and nothing but max-pooled
responses goes out. The network is fitted by Adam on a bounded sample of labelled rows, whose texts are taken whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriloom.llm.labelled import sample
from veriloom.session import ready, tidy

WIDTH, STRIDE, DIM, FILTERS = 8, 4, 8, 32
#: Places of half a chunk, filters over chunks, and distances and embedding of the second-order input.
HALF, UNITS, LAGS, PAIR = 8, 32, 24, 4
#: The bound of the training sample, in rows, how often training goes over it, and how often embeddings learn with it.
SAMPLE, EPOCHS, DEEP = 3000, 10, 4
#: Places that a forward step holds at once, a multiple of HALF; memory doesn't grow with a text's length.
STEP = HALF * 1024


def _frame(data: bytes) -> np.ndarray:
    """The bytes of a text, extended with zeros to whole places."""
    n = max(WIDTH, len(data))
    n += -(n - WIDTH) % STRIDE
    return np.frombuffer(data.ljust(n, b"\0"), np.uint8)


class Network:
    """Parameters, forward pass and training."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.emb = rng.normal(0, 0.5, (256, DIM)).astype(np.float32)
        self.filters = rng.normal(0, 2 * (WIDTH * DIM) ** -0.5, (WIDTH * DIM, FILTERS)).astype(np.float32)
        self.bias = np.zeros(FILTERS, dtype=np.float32)
        self.pair = rng.normal(0, 1, (256, PAIR)).astype(np.float32)
        self.units = rng.normal(0, (FILTERS + LAGS) ** -0.5, (FILTERS + LAGS, UNITS)).astype(np.float32)
        self.level = np.zeros(UNITS, dtype=np.float32)
        self.out = rng.normal(0, UNITS**-0.5, UNITS).astype(np.float32)
        self.last = np.zeros(1, dtype=np.float32)

    def _places(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = np.ascontiguousarray(sliding_window_view(self.emb[raw].reshape(-1), WIDTH * DIM)[:: STRIDE * DIM])
        return x, np.maximum(x @ self.filters + self.bias, 0)

    def _products(self, raw: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Products of the embedded bytes of raw with those 1 to LAGS bytes before; before: up to LAGS bytes ahead of raw."""
        e = np.zeros((LAGS + len(raw), PAIR), np.float32)
        e[LAGS - len(before) :] = self.pair[np.concatenate([before, raw])]
        e = np.ascontiguousarray(e.T)
        out = np.empty((len(raw), LAGS), np.float32)
        for lag in range(1, LAGS + 1):
            out[:, lag - 1] = (e[:, LAGS:] * e[:, LAGS - lag : -lag]).sum(0)
        return out

    def _halves(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums of the inputs of the second layer over half chunks, and the places of each."""
        sums, counts = [], []
        n = (len(raw) - WIDTH) // STRIDE + 1
        for a in range(0, n, STEP):
            z = min(n, a + STEP)
            _, r = self._places(raw[a * STRIDE : (z - 1) * STRIDE + WIDTH])
            cuts = np.arange(0, z - a, HALF)
            products = self._products(raw[a * STRIDE : z * STRIDE], raw[max(0, a * STRIDE - LAGS) : a * STRIDE])
            sums.append(np.concatenate([np.add.reduceat(r, cuts, axis=0), np.add.reduceat(products, cuts * STRIDE, axis=0) / np.float32(STRIDE)], axis=1))
            counts.append(np.diff(np.append(cuts, z - a)))
        return np.concatenate(sums), np.concatenate(counts)

    def _chunks(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean inputs in each chunk, and its places."""
        sums, counts = self._halves(raw)
        if len(counts) > 1:
            sums, counts = sums[1:] + sums[:-1], counts[1:] + counts[:-1]
        return sums / counts[:, None].astype(np.float32), counts

    def score(self, text: str | None) -> float:
        mean, _ = self._chunks(_frame((text or "").encode("utf-8", "surrogatepass")))
        z = float(np.maximum(mean @ self.units + self.level, 0).max(0) @ self.out + self.last[0])
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    def fit(self, texts: list[str], labels: list[int], *, epochs: int = EPOCHS, seed: int = 5) -> Network:
        """Adam on the weighted log loss, one whole text at a time in small batches."""
        if not texts or len(set(labels)) < 2:
            self.last[0] = 3.0 if not labels or labels[0] else -3.0
            self.out[:] = 0
            return self
        rng, y = np.random.default_rng(seed), np.array(labels, dtype=np.float32)
        raws = [_frame(t.encode("utf-8", "surrogatepass")) for t in texts]
        weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
        some = np.concatenate([self._chunks(raws[i])[0] for i in rng.permutation(len(raws))[:200]])
        # units see centred means of like spread at first
        self.units /= some.std(0)[:, None] + np.float32(1e-3)
        self.level = (-some.mean(0) @ self.units).astype(np.float32)
        params = [self.emb, self.filters, self.bias, self.units, self.level, self.out, self.last, self.pair]
        first, second, step, batch = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0, 16
        for epoch in range(epochs):
            order = rng.permutation(len(raws))
            rate = 0.01 * (1 - epoch / epochs) + 0.0005
            for at in range(0, len(order), batch):
                grads = [np.zeros_like(p) for p in params]
                picked = order[at : at + batch]
                for i in picked:
                    self._learn(raws[i], y[i], weight[i] / len(picked), grads, epoch < DEEP)
                step += 1
                for k, (q, g) in enumerate(zip(params, grads, strict=True)):
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    q -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
                    if k == 5:
                        q *= 1 - rate * 0.002
        return self

    def _learn(self, raw: np.ndarray, y: float, weight: float, grads: list[np.ndarray], deep: bool) -> None:
        """Adds one text's gradients; only the chunks that won the pooling hand any on, all of them at once. deep: to the
        embeddings as well."""
        mean, counts = self._chunks(raw)
        h = mean @ self.units + self.level
        arg = h.argmax(0)
        top = np.maximum(h[arg, np.arange(UNITS)], 0)
        p = 1 / (1 + np.exp(-np.clip(top @ self.out + self.last[0], -30, 30)))
        g = np.float32((p - y) * weight)
        grads[5] += g * top
        grads[6] += g
        up = g * self.out * (top > 0)
        grads[3] += mean[arg].T * up
        grads[4] += up
        won = np.unique(arg)
        back = ((arg == won[:, None]) * up) @ self.units.T / counts[won, None].astype(np.float32)
        places = won[:, None] * HALF + np.arange(2 * HALF)
        inside = (np.arange(2 * HALF) < counts[won, None]).reshape(-1)
        seen = raw[np.minimum(places.reshape(-1, 1) * STRIDE + np.arange(WIDTH), len(raw) - 1)]
        x = self.emb[seen].reshape(len(seen), -1)
        low = np.repeat(back[:, :FILTERS], 2 * HALF, axis=0) * ((x @ self.filters + self.bias > 0) & inside[:, None])
        grads[1] += x.T @ low
        grads[2] += low.sum(0)
        if not deep:
            return
        down = (low @ self.filters.T).reshape(-1, DIM)
        for d in range(DIM):
            grads[0][:, d] += np.bincount(seen.reshape(-1), weights=down[:, d], minlength=256)
        at = won[:, None] * HALF * STRIDE + np.arange(-LAGS, 2 * HALF * STRIDE)
        there = (at >= 0) & (np.arange(-LAGS, 2 * HALF * STRIDE) < counts[won, None] * STRIDE) & (at < len(raw))
        near = raw[np.clip(at, 0, len(raw) - 1)]
        e = self.pair[near] * there[:, :, None]
        w = np.concatenate([np.zeros((len(won), 1), np.float32), back[:, FILTERS:] / np.float32(STRIDE)], axis=1)[:, _GAPS] * there[:, :, None]
        change = (w @ e + w.transpose(0, 2, 1) @ e) * there[:, :, None]
        for d in range(PAIR):
            grads[7][:, d] += np.bincount(near.reshape(-1), weights=change[:, :, d].reshape(-1), minlength=256)


#: How far back of each byte of a chunk each byte of it and of the LAGS bytes ahead lies; 0 if it doesn't count.
_GAPS = np.arange(LAGS + 2 * HALF * STRIDE)[:, None] - np.arange(LAGS + 2 * HALF * STRIDE)
_GAPS = np.where((_GAPS > 0) & (_GAPS <= LAGS) & (np.arange(len(_GAPS)) >= LAGS)[:, None], _GAPS, 0)


def fit(docs: DataFrame, labels: DataFrame, train: Column, *, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", most: int = SAMPLE) -> Network:
    """A network fitted on at most `most` labelled rows; without rows of both classes it gives a constant."""
    rows = sample(docs, labels, label, train, most, id_col=id_col, text_col=text_col)
    return Network().fit(rows["text"].tolist(), rows["label"].tolist())


def score(docs: DataFrame, model: Network, text_col: str = "text", *, threshold: float = 0.3, out: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """docs with the probability of label 1 and predicted = probability >= threshold.

    Null texts count as empty ones, and empty texts get the network's score of no bytes. Texts of any length are taken
    whole, a piece at a time. Columns named like an output are replaced, others and repeated rows stay; equal texts get
    equal scores. An empty table stays empty.
    """
    shared = ready(docs.sparkSession).sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def probability(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        net = shared.value
        for batch in batches:
            yield pd.Series([net.score(x) for x in batch], dtype="float64")
        tidy()

    scored = docs.withColumn(out[0], probability(F.coalesce(F.col(text_col), F.lit(""))))
    return scored.withColumn(out[1], (F.col(out[0]) >= threshold).cast("int"))


def held_out(doc_id: object, folds: int = 5) -> bool:
    """Whether the row is never learnt from: crc32 of the id as text is 0 modulo folds."""
    return zlib.crc32(str("" if doc_id is None else doc_id).encode()) % folds == 0
