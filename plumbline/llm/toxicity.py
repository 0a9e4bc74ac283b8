"""Toxicity from subword bags: character n-gram embeddings, averaged, under a linear softmax.

A text is lower-cased (ASCII), cut at everything that is neither letter, digit nor beyond ASCII, and turned into hashed
character n-grams of its words with their borders. The n-gram embeddings and the softmax weights are trained jointly in
numpy on a bounded sample of labelled documents; a misspelling unseen in training shares most n-grams with its word.
Scoring is linear in the average, so tasks carry one number per n-gram bucket, a table of fixed size.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from plumbline.llm.common import map_arrow, stored

ORDERS, BITS, DIM = (3, 4, 5, 6), 17, 8
BATCH = 1 << 20  # bytes of text at once: the n-grams of a batch take about fifty times its size

_FOLD = np.full(256, 32, np.uint8)
_FOLD[128:] = np.arange(128, 256)
_FOLD[48:58] = np.arange(48, 58)
_FOLD[65:91] = _FOLD[97:123] = np.arange(97, 123)


def subwords(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every n-gram of all texts, and the text each belongs to. An n-gram may hold a border only at its ends."""
    sizes = np.array([len(x) for x in texts], np.int64)
    b = _FOLD[np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)]
    owner = np.repeat(np.arange(len(texts)), sizes + 1)
    gap = (b == 32).astype(np.int32)
    before = np.concatenate(([0], np.cumsum(gap)))
    codes, h, power = b.astype(np.uint32), np.zeros(len(b), np.uint32), 1
    ids, owners = [], []
    for n in range(1, max(ORDERS) + 1):
        m = len(b) - n + 1
        if m <= 0:
            break
        h = h[:m] + codes[n - 1 :] * np.uint32(power)
        power = power * 0x01000193 & 0xFFFFFFFF
        if n in ORDERS:
            at = np.flatnonzero(before[n - 1 : n - 1 + m] == before[1 : m + 1])
            mixed = (h[at] ^ (h[at] >> np.uint32(15))) * np.uint32(0x9E3779B1 + 2 * n)
            ids.append(mixed >> np.uint32(32 - BITS))
            owners.append(owner[np.minimum(at, len(owner) - 1)])
    if not ids:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    return np.concatenate(ids), np.concatenate(owners)


@dataclass
class ToxicityModel:
    weights: np.ndarray  # one number per bucket: its embedding times the difference of the softmax rows
    bias: float
    prior: float

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Probability of label 1 per text; a text without n-grams gets the share of label 1 in training."""
        ids, owner = subwords(texts)
        n = np.bincount(owner, minlength=len(texts))
        z = np.bincount(owner, self.weights[ids], len(texts)) / np.maximum(n, 1) + self.bias
        return np.where(n > 0, 1 / (1 + np.exp(-np.clip(z, -40, 40))), self.prior)


def _telling(rows: DataFrame, most: int) -> np.ndarray:
    """The `most` buckets whose share of documents differs most between the labels, in standard errors (ties: smaller bucket)."""

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, owner = subwords(batch.column("text").cast(pa.binary()).fill_null(b"").to_pylist())
        label = batch.column("label").to_numpy()
        keys = np.unique(owner.astype(np.int64) << BITS | ids)
        keys, docs = np.unique(label[keys >> BITS].astype(np.int64) << BITS | keys & (1 << BITS) - 1, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(keys >> BITS), pa.array(keys & (1 << BITS) - 1), pa.array(docs)], names=["label", "bucket", "docs"])

    n, n1 = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not 0 < n1 < n:
        return np.zeros(0, np.int64)
    per = map_arrow(rows, count, "label long, bucket long, docs long", BATCH).groupBy("bucket").agg(
        F.sum(F.when(F.col("label") == 1, F.col("docs")).otherwise(0)).alias("a"), F.sum(F.when(F.col("label") == 0, F.col("docs")).otherwise(0)).alias("b")
    )
    p = (F.col("a") + F.col("b")) / n
    z = (F.col("a") / n1 - F.col("b") / (n - n1)) / F.sqrt(F.greatest(p * (1 - p), F.lit(1e-9)) * (1 / n1 + 1 / (n - n1)))
    best = per.select("bucket", F.abs(z).alias("z")).orderBy(F.desc("z"), "bucket").limit(most)
    return np.sort(np.array([r.bucket for r in best.collect()], np.int64))


def _bags(rows: DataFrame, live: np.ndarray) -> list:
    """Collect the sample's bags: positions of the live buckets a text has and their share of its n-grams."""

    def bag(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("text").cast(pa.binary()).fill_null(b"").to_pylist()
        ids, owner = subwords(texts)
        total = np.maximum(np.bincount(owner, minlength=len(texts)), 1)
        row = np.full(1 << BITS, -1)
        row[live] = np.arange(len(live))
        keep = row[ids] >= 0
        keys, counts = np.unique(owner[keep].astype(np.int64) << BITS | row[ids[keep]], return_counts=True)
        cuts = np.searchsorted(keys >> BITS, np.arange(len(texts) + 1))
        out = [(keys[i:j] & (1 << BITS) - 1, counts[i:j] / n) for i, j, n in zip(cuts, cuts[1:], total)]
        return pa.RecordBatch.from_arrays(
            [batch.column("label"), pa.array([k.astype(np.uint32).tobytes() for k, _ in out], pa.binary()), pa.array([c.astype(np.float32).tobytes() for _, c in out], pa.binary())],
            names=["label", "ids", "shares"],
        )

    return map_arrow(rows, bag, "label int, ids binary, shares binary", BATCH).collect()


def train(
    labels: np.ndarray, bags: list[tuple[np.ndarray, np.ndarray]], live: np.ndarray, epochs: int = 20, batch: int = 64,
    rate: float = 0.05, decay: float = 1e-3, seed: int = 7,
) -> ToxicityModel:
    """Embeddings and softmax by Adam on cross-entropy with weight decay.

    Only the `live` buckets get an embedding; on a small sample the others would only be learnt by heart. One class only,
    no rows or no live buckets: a constant model.
    """
    n, size, rng = len(bags), 1 << BITS, np.random.default_rng(seed)
    prior = float(labels.mean()) if n else 0.0
    if not 0 < prior < 1:
        return ToxicityModel(np.zeros(size), -40.0 if prior == 0 else 40.0, prior)
    if not len(live):
        return ToxicityModel(np.zeros(size), float(np.log(prior / (1 - prior))), prior)
    kept = bags
    mean = np.bincount(np.concatenate([i for i, _ in kept]), np.concatenate([s for _, s in kept]), len(live)) / n
    gain = 30.0 / np.sqrt(30.0 * (mean + mean.mean()))  # shares are small numbers, and common n-grams vary more
    params = [rng.normal(0, 0.1, (DIM, len(live))), rng.normal(0, 0.5, (DIM, 2)), np.zeros(2)]
    first, second = [np.zeros_like(x) for x in params], [np.zeros_like(x) for x in params]
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(n)
        for at in range(0, n, batch):
            pick = order[at : at + batch]
            ids = np.concatenate([kept[i][0] for i in pick])
            shares = np.concatenate([kept[i][1] for i in pick]) * gain[ids]
            owner = np.repeat(np.arange(len(pick)), [len(kept[i][0]) for i in pick])
            emb, soft, bias = params
            hidden = np.stack([np.bincount(owner, emb[k][ids] * shares, len(pick)) for k in range(DIM)], 1)
            logits = hidden @ soft + bias
            q = np.exp(logits - logits.max(1, keepdims=True))
            q /= q.sum(1, keepdims=True)
            q[np.arange(len(pick)), labels[pick]] -= 1
            q /= len(pick)
            back = q @ soft.T
            grads = [np.stack([np.bincount(ids, back[owner, k] * shares, len(live)) for k in range(DIM)]) + decay * emb, hidden.T @ q + decay * soft, q.sum(0)]
            step += 1
            lr = rate * (1 - epoch / epochs) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for x, g, m, v in zip(params, grads, first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                x -= lr * m / (np.sqrt(v) + 1e-8)
    emb, soft, bias = params
    weights = np.zeros(size)
    weights[live] = (soft[:, 1] - soft[:, 0]) @ emb * gain
    return ToxicityModel(weights, float(bias[1] - bias[0]), prior)


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = 8000, max_buckets: int = 512) -> ToxicityModel:
    """Train on at most `max_rows` labelled documents, chosen by a hash of their ids, whole texts.

    Rows with a null id or label are not used; several labels of one id count as their maximum. Only the `max_buckets`
    buckets that tell the labels apart best, whatever the size of the sample, and the sample's bags of these, come to
    the driver.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).cast("int").alias("__label"))
    pick = F.broadcast(known.orderBy(F.xxhash64("__id"), "__id").limit(max_rows))  # at most max_rows rows
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text")).join(pick, "__id")
    rows = stored(rows.select("text", (F.col("__label") > 0).cast("int").alias("label")), "toxicity-sample")
    live = _telling(rows, max_buckets)
    got = sorted((r.ids, r.shares, r.label) for r in _bags(rows, live))
    bags = [(np.frombuffer(i, np.uint32), np.frombuffer(s, np.float32)) for i, s, _ in got]
    return train(np.array([y for _, _, y in got], int), bags, live)


def score_toxicity(docs: DataFrame, model: ToxicityModel, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """All columns of `docs` and the score of each row's whole text; a column of that name is replaced.

    Null and empty texts get the training share. One pass, no shuffle.
    """
    docs = docs.drop(score_col) if score_col != text_col else docs
    sent = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias, model.prior))  # fixed size: one number per bucket

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(text_col).cast(pa.binary()).fill_null(b"").to_pylist()
        return batch.append_column(score_col, pa.array(ToxicityModel(*sent.value).score(texts)))

    schema = StructType([*docs.schema.fields, StructField(score_col, DoubleType())])
    return map_arrow(docs, score, schema, BATCH)
