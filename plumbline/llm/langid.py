"""Language identification with a string kernel.

A text is the set of hashed byte n-grams (1 to 4, letters only, runs of anything else as one space) present in it; the
kernel of two texts is the size of the intersection over the root of the product of sizes. Landmark texts per language
give a Nyström approximation, one-versus-rest kernel ridge regression fits the languages on a bounded sample. The dual
weights are multiplied into the landmarks once, so scoring a batch is one product of presence rows with a table of fixed
size.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from plumbline.llm.common import broadcast_if_small, map_arrow
from plumbline.plans.ordering import top_n_per_group

ORDERS, BITS, UNKNOWN = (1, 2, 3, 4), 16, "und"
_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def presence(text: str | None) -> np.ndarray | None:
    """Buckets present in the whole text; None without any letter (Unicode category L)."""
    if not text or not any(map(str.isalpha, text)):
        return None
    b = _FOLD[np.frombuffer(b" " + text.lower().encode("utf-8", "replace") + b" ", np.uint8)]
    blank = b == 32
    b = b[~(blank & np.concatenate(([False], blank[:-1])))].astype(np.uint32)
    seen, h, power = np.zeros(1 << BITS, bool), np.zeros(len(b), np.uint32), 1
    for n in range(1, max(ORDERS) + 1):
        m = len(b) - n + 1
        if m <= 0:
            break
        h = h[:m] + b[n - 1 :] * np.uint32(power)
        power = power * 0x01000193 & 0xFFFFFFFF
        seen[((h ^ (h >> np.uint32(15))) * np.uint32(0x9E3779B1 + 2 * n)) >> np.uint32(32 - BITS)] = True
    return np.flatnonzero(seen)


@dataclass
class LanguageModel:
    labels: list[str]
    table: np.ndarray  # buckets by languages: landmarks times dual weights

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and the softmax share of its decision value; `und` with 0 for texts without a letter."""
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        sets = [presence(t) for t in texts]
        rows = [i for i, s in enumerate(sets) if s is not None]
        if rows and self.labels:
            value = np.stack([self.table[sets[i]].sum(0) / np.sqrt(len(sets[i])) for i in rows])
            share = np.exp(4 * (value - value.max(1, keepdims=True)))
            share /= share.sum(1, keepdims=True)
            best = value.argmax(1)
            for i, k, s in zip(rows, best, share):
                names[i], scores[i] = self.labels[k], s[k]
        return names, scores


def train(langs: list[str], sets: list[np.ndarray], landmarks: int = 48, ridge: float = 1e-3, max_landmarks: int = 1024) -> LanguageModel:
    """Kernel ridge regression on landmark features; the first texts of each language are its landmarks.

    With many languages each gets fewer, so that all together stay within `max_landmarks` (one per language at least).
    """
    labels = sorted(set(langs))
    if len(labels) < 2:
        return LanguageModel(labels, np.zeros((1 << BITS, len(labels)), np.float32))
    landmarks, own = min(landmarks, max(1, max_landmarks // len(labels))), {x: [] for x in labels}
    for i, x in enumerate(langs):
        own[x].append(i)
    marks = [i for x in labels for i in own[x][:landmarks]]
    base = np.zeros((1 << BITS, len(marks)), np.float32)
    for c, i in enumerate(marks):
        base[sets[i], c] = 1 / np.sqrt(len(sets[i]))
    kernel = np.stack([base[s].sum(0) / np.sqrt(len(s)) for s in sets]).astype(float)
    values, vectors = np.linalg.eigh(kernel[marks])
    root = vectors / np.sqrt(np.maximum(values, 1e-6))
    z = kernel @ root
    z = np.hstack([z, np.ones((len(z), 1))])
    target = np.where(np.array(langs)[:, None] == np.array(labels)[None, :], 1.0, -1.0)
    count = Counter(langs)
    weight = 1 / np.sqrt(np.array([count[x] for x in langs]))[:, None]  # rare languages count as much
    w = np.linalg.solve((z * weight).T @ (z * weight) + ridge * np.eye(z.shape[1]), (z * weight).T @ (target * weight))
    return LanguageModel(labels, (base @ (root @ w[:-1])).astype(np.float32))


def fit_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 400, max_rows: int = 16_000) -> LanguageModel:
    """Train on at most `per_language` texts of each language, chosen by a hash of their ids; whole texts.

    With many languages each gives fewer, so that all together stay within `max_rows` (one per language at least).

    Rows without id, language or letters are not used; of rows that repeat an id and language one is. Only bucket lists
    of the sample come to the driver.
    """
    known = docs.where(F.col(id_col).isNotNull() & F.col(lang_col).isNotNull())
    ids = known.select(F.col(id_col).alias("__id"), F.col(lang_col).alias("__lang")).withColumn("__h", F.xxhash64("__id"))
    sizes = ids.groupBy("__lang").agg(F.count(F.lit(1)).alias("__n"))
    per_language = min(per_language, max(1, max_rows // max(1, sizes.count())))
    ids = ids.join(broadcast_if_small(sizes, 100_000), "__lang")
    # a hot language is thinned by the hash before its rows meet; small ones come whole
    ids = ids.where((F.col("__n") <= 16 * per_language) | (F.pmod(F.col("__h"), F.lit(1 << 30)) < 2.0 * per_language * (1 << 30) / F.col("__n")))
    pick = top_n_per_group(ids, ["__lang"], ["__h", "__id"], per_language, ["__id"]).select("__id", "__lang")
    rows = known.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text"), F.col(lang_col).alias("__lang")).join(broadcast_if_small(pick.distinct(), 1_000_000), ["__id", "__lang"])

    def bags(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [presence(t) for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column("__id"), batch.column("__lang"), pa.array([s.astype(np.uint32).tobytes() if s is not None else None for s in sets], pa.binary())], names=["id", "lang", "ids"]
        )

    got = map_arrow(rows.select("__id", "__lang", "text"), bags, StructType([StructField("id", rows.schema["__id"].dataType), StructField("lang", StringType()), *StructType.fromDDL("ids binary")])).where("ids is not null")
    got = got.groupBy("id", "lang").agg(F.min("ids").alias("ids")).collect()
    got = sorted(got, key=lambda r: (str(r.id), r.lang, bytes(r.ids)))
    return train([r.lang for r in got], [np.frombuffer(r.ids, np.uint32) for r in got])


def predict_languages(docs: DataFrame, model: LanguageModel, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """All columns of `docs` plus language and score of the whole text; columns of these names are replaced.

    Null and empty texts, texts without a letter, and all texts where nothing was learnt get `und` and 0. Repeated rows
    stay; an empty table gives none. One pass, no shuffle.
    """
    docs = docs.drop(*[c for c in (lang_out, score_out) if c != text_col])
    sent = docs.sparkSession.sparkContext.broadcast((model.labels, model.table))  # fixed size per language

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, scores = LanguageModel(*sent.value).predict(batch.column(text_col).to_pylist())
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores)], names=[*batch.schema.names, lang_out, score_out])

    return map_arrow(docs, run, StructType([*docs.schema.fields, StructField(lang_out, StringType()), StructField(score_out, DoubleType())]))
