"""Prediction-against-reference metrics: exact match, F1, BLEU, ROUGE, perplexity, diversity."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import text as X
from plumbline.functions.stemming import porter_stem


def exact_match(df: DataFrame, pred: str = "pred", ref: str = "ref", normalize: bool = True) -> DataFrame:
    norm = (lambda c: F.lower(X.collapse_ends(F.col(c)))) if normalize else F.col
    return df.agg(F.coalesce(F.avg((norm(pred) == norm(ref)).cast("double")), F.lit(0.0)).alias("exact_match"))


def token_f1(df: DataFrame, pred: str = "pred", ref: str = "ref") -> DataFrame:
    d = df.select(X.word_set(pred).alias("p"), X.word_set(ref).alias("r"))
    d = d.select(F.size("p").alias("np"), F.size("r").alias("nr"), F.size(F.array_intersect("p", "r")).alias("o"))
    usable = (F.col("np") > 0) & (F.col("nr") > 0)
    p = F.when(usable, F.try_divide("o", "np"))
    r = F.when(usable, F.try_divide("o", "nr"))
    f = F.when(usable & (F.col("o") > 0), 2 * p * r / (p + r))
    mean = lambda c: F.coalesce(F.avg(F.coalesce(c, F.lit(0.0))), F.lit(0.0))
    return d.agg(mean(p).alias("precision"), mean(r).alias("recall"), mean(f).alias("f1"))


def gram_bag(ws: Column, n: int) -> Column:
    """The n-grams of an array of words as a set: each with the number of its occurrence.

    The grams are sorted, and an occurrence is the distance from the start of its run, so two bags intersect like sets,
    and a union keeps the largest count. Linear but for the sort.
    """

    def numbered(s: Column) -> Column:
        at = F.when(F.size(s) > 0, F.sequence(F.lit(1), F.size(s))).otherwise(F.array().cast("array<int>"))
        starts = F.filter(at, lambda i: (i == 1) | (F.get(s, i - 1) != F.get(s, i - 2)))
        runs = lambda x, y: F.transform(F.sequence(F.lit(1), y - x), lambda k: F.concat_ws("\x00", k.cast("string"), F.get(s, x - 1)))
        return F.when(F.size(s) > 0, F.flatten(X.let(starts, lambda b: F.zip_with(b, F.concat(F.slice(b, F.lit(2), F.size(b)), F.array(F.size(s) + 1)), runs)))).otherwise(F.array().cast("array<string>"))

    return X.let(F.sort_array(X.ngrams(ws, n)), numbered)


def gram_matches(df: DataFrame, pred: Column, refs: Column, orders: list[int], keep: Sequence[Column] = ()) -> DataFrame:
    """`keep` and, per order n: h{n} matched (clipped), t{n} predicted and r{n} reference n-gram counts of each row.

    `refs` is an array of texts; predicted counts are clipped by the largest count in any of them. All inside the row:
    no gram is shuffled.
    """
    t = df.select(*keep, X.words(pred).alias("__p"), F.transform(refs, X.words).alias("__r"))
    for n in orders:
        own = gram_bag(F.col("__p"), n)
        any_ref = F.aggregate("__r", F.array().cast("array<string>"), lambda acc, w: F.array_union(acc, gram_bag(w, n)))
        t = t.withColumn("__o", own).withColumn("__a", any_ref)
        t = t.withColumns({f"h{n}": F.size(F.array_intersect("__o", "__a")), f"t{n}": F.size("__o"), f"r{n}": F.size("__a")}).drop("__o", "__a")
    return t.drop("__p", "__r")


def _bleu(hits: list[Column], totals: list[Column], plen: Column, rlen: Column) -> Column:
    """Geometric mean of precisions times brevity penalty; 0.1 replaces a zero match count and
    no unigram match scores 0. A missing order counts as total 1."""
    logs = F.lit(0.0)
    for h, t in zip(hits, totals):
        den = F.greatest(F.coalesce(t, F.lit(0)), F.lit(1))
        num = F.coalesce(h, F.lit(0))
        logs = logs + F.ln(F.when(num > 0, num.cast("double")).otherwise(0.1) / den) / len(hits)
    bp = F.when(plen > rlen, 1.0).when(plen == 0, 0.0).otherwise(F.exp(1 - rlen / F.greatest(plen, F.lit(1))))
    return F.when(F.coalesce(hits[0], F.lit(0)) == 0, 0.0).otherwise(bp * F.exp(logs))


def bleu(df: DataFrame, row_id: str = "id", pred: str = "pred", refs: Column | None = None, max_n: int = 4) -> DataFrame:
    """Corpus BLEU and mean/std of sentence BLEU; several references are clipped by their maximum
    and the closest reference length counts (shorter one on ties)."""
    refs = F.array("ref") if refs is None else refs
    orders = list(range(1, max_n + 1))
    near = lambda c: F.array_min(F.transform("rl", lambda x: F.struct(F.abs(x - c).alias("d"), x.alias("l"))))["l"]
    s = gram_matches(df, F.col(pred), refs, orders, [X.word_count(pred).alias("plen"), F.transform(refs, X.word_count).alias("rl")])
    s = s.withColumn("rlen", near(F.col("plen")))
    hs, ts = [F.col(f"h{n}") for n in orders], [F.col(f"t{n}") for n in orders]
    s = s.withColumn("b", _bleu(hs, ts, F.col("plen"), F.col("rlen")))
    # in the corpus sum an order a row cannot fill still counts one possible match
    tot = [F.sum(F.greatest(F.coalesce(t, F.lit(0)), F.lit(1))).alias(f"t{n}") for n, t in zip(orders, ts)]
    c = s.agg(
        *[F.sum(h).alias(f"h{n}") for n, h in zip(orders, hs)], *tot,
        F.sum("plen").alias("plen"), F.sum("rlen").alias("rlen"), F.avg("b").alias("bleu_mean"), F.stddev_pop("b").alias("bleu_std"),
    )
    return c.select(_bleu(hs, ts, F.col("plen"), F.col("rlen")).alias("bleu"), "bleu_mean", "bleu_std")


def rouge_tokens(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits."""
    return F.array_join(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0), " ")


def stem_tokens(df: DataFrame, text: str, row_id: str = "id", stemmer: Callable[[str], str] = porter_stem, shortest: int = 1, cache: int = 1 << 17) -> DataFrame:
    """Replace a text by its tokens' stems, joined by spaces; tokens under `shortest` letters stay, null gives an empty text.

    `row_id` isn't needed, rows stay where they are. A task stems each distinct token once, as far as `cache` reaches. Row by row, no shuffle.
    """

    @F.pandas_udf(T.StringType())
    def stem(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = lru_cache(cache)(stemmer)
        for texts in batches:
            yield texts.map(lambda t: " ".join(known(w) if len(w) >= shortest else w for w in t.split()))

    return df.withColumn(text, stem(F.coalesce(rouge_tokens(F.col(text)), F.lit(""))))


def rouge_n(df: DataFrame, row_id: str = "id", pred: str = "pred", ref: str = "ref", stems: bool = False) -> DataFrame:
    """Macro means of ROUGE-1/2 precision, recall and F over all rows, of Porter stems if wanted."""
    if stems:
        df = stem_tokens(stem_tokens(df, pred, shortest=4), ref, shortest=4)
    s = gram_matches(df, rouge_tokens(F.col(pred)), F.array(rouge_tokens(F.col(ref))), [1, 2])
    parts = {}
    for n in (1, 2):
        p, r = (F.coalesce(F.try_divide(f"h{n}", c), F.lit(0.0)) for c in (f"t{n}", f"r{n}"))
        parts |= {f"rouge{n}_f": F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)), f"rouge{n}_p": p, f"rouge{n}_r": r}
    return s.agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(k) for k, c in parts.items()])


@F.pandas_udf(T.IntegerType())
def _lcs(a: pd.Series, b: pd.Series) -> pd.Series:
    out = []
    for x, y in zip(a, b):
        x, y = x.split(), y.split()
        # bit-parallel longest common subsequence (Hyyro, 2004)
        masks: dict[str, int] = {}
        for i, w in enumerate(x):
            masks[w] = masks.get(w, 0) | (1 << i)
        v = full = (1 << len(x)) - 1
        for w in y:
            u = v & masks.get(w, 0)
            v = ((v + u) | (v - u)) & full
        out.append(len(x) - bin(v).count("1"))
    return pd.Series(out, dtype="int32")


def rouge_l(df: DataFrame, pred: str = "pred", ref: str = "ref") -> DataFrame:
    t = df.select(rouge_tokens(F.col(pred)).alias("p"), rouge_tokens(F.col(ref)).alias("r"))
    t = t.select(_lcs("p", "r").alias("l"), X.word_count("p").alias("np"), X.word_count("r").alias("nr"))
    p, r = F.coalesce(F.try_divide("l", "np"), F.lit(0.0)), F.coalesce(F.try_divide("l", "nr"), F.lit(0.0))
    f = F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
    return t.agg(F.avg(f).alias("rougeL_f"), F.avg(p).alias("rougeL_p"), F.avg(r).alias("rougeL_r"))


def perplexity(df: DataFrame, loglik: str, length: str) -> DataFrame:
    s = df.agg(F.sum(loglik).alias("l"), F.sum(length).alias("n"))
    inf = F.lit(float("inf"))
    return s.select(F.when(F.coalesce("n", F.lit(0)) == 0, inf).otherwise(F.exp(-F.col("l") / F.col("n"))).alias("perplexity"))


# Buckets of grams (a task holds one bucket at a time) and the bytes of text whose grams are made distinct in one go.
GRAM_BUCKETS = 1024
GRAM_CHUNK = 8 << 20


def _text(s: str) -> pa.Scalar:
    return pa.scalar(s, pa.large_string())


def _bucketed_grams(docs: list[pa.Array]) -> pa.RecordBatch:
    """Distinct 1- and 2-grams of the documents' words: one row per bucket, grams joined by a line break, which no word holds.

    The first row has the numbers of all occurrences. A gram's bucket depends on its words alone.
    """
    ends = np.cumsum([len(d) for d in docs])
    coded = pa.concat_arrays(docs).dictionary_encode()
    words, code = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
    hashed = np.fromiter((zlib.crc32(w.as_buffer()) for w in words.cast(pa.large_binary())), np.uint64, len(words))
    joins = np.ones(max(len(code) - 1, 0), bool)  # neighbours in one document
    joins[ends[:-1] - 1] = False
    pairs = (code[:-1] * len(words) + code[1:])[joins]
    first, second = np.divmod(pc.unique(pa.array(pairs)).to_numpy(), max(len(words), 1))
    mixed = hashed[first] * np.uint64(0x9E3779B97F4A7C15) + hashed[second] * np.uint64(0xC2B2AE3D27D4EB4F)

    def joined(bucket: np.ndarray, grams: Callable[[np.ndarray], pa.Array]) -> pa.Array:
        order = np.argsort(bucket.astype(np.uint16), kind="stable")
        starts = np.concatenate(([0], np.cumsum(np.bincount(bucket.astype(np.int64), minlength=GRAM_BUCKETS))))
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(starts, pa.int32()), grams(order)), _text("\n"))

    of_two = lambda at: pc.binary_join_element_wise(words.take(pa.array(first[at])), words.take(pa.array(second[at])), _text(" "))
    once = np.arange(GRAM_BUCKETS) == 0
    return pa.record_batch({
        "bucket": pa.array(np.arange(GRAM_BUCKETS, dtype=np.int32)),
        "g1": joined(hashed % GRAM_BUCKETS, lambda at: words.take(pa.array(at))), "g2": joined((mixed >> np.uint64(32)) % GRAM_BUCKETS, of_two),
        "t1": pa.array(once * len(code)), "t2": pa.array(once * len(pairs)),
    })


def _grams_in_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    docs, held = [], 0
    for b in batches:
        for t in b.column(0).cast(pa.binary()):
            if t.is_valid and (words := t.as_py().decode("utf-8", "replace").split()):
                docs.append(pa.array(words, pa.large_string()))
                if (held := held + len(t.as_buffer())) >= GRAM_CHUNK:
                    yield _bucketed_grams(docs)
                    docs, held = [], 0
    if docs:
        yield _bucketed_grams(docs)


def _distinct_in_bucket(t: pa.Table) -> pa.Table:
    sums = {f"t{n}": [pc.sum(t[f"t{n}"]).as_py()] for n in (1, 2)}
    for n in (1, 2):
        grams = t[f"g{n}"].cast(pa.large_string())
        grams = grams.filter(pc.not_equal(grams, _text("")))
        sums[f"u{n}"] = [len(pc.list_flatten(pc.split_pattern(grams, "\n")).unique())]
    return pa.table(sums, pa.schema([(c, pa.int64()) for c in ("u1", "t1", "u2", "t2")]))


def distinct_n(df: DataFrame, text: str) -> DataFrame:
    """Corpus distinct-1 and distinct-2, exact. Tasks make the grams of many texts distinct in Arrow arrays and deal them out by
    bucket as few long strings; a bucket then counts its distinct grams."""
    made = df.select(F.col(text).cast("string")).mapInArrow(_grams_in_buckets, "bucket int, g1 string, g2 string, t1 long, t2 long")
    s = made.groupBy("bucket").applyInArrow(_distinct_in_bucket, "u1 long, t1 long, u2 long, t2 long")
    s = s.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in s.columns])
    return s.select(
        *[(F.col(f"u{n}") / F.greatest(f"t{n}", F.lit(1))).alias(f"distinct_{n}") for n in (1, 2)],
        F.col("u1").alias("unique_unigrams"), F.col("u2").alias("unique_bigrams"),
    )


def metrics_report(df: DataFrame, row_id: str = "id") -> DataFrame:
    """All metrics in one row; each part is a one-row aggregate read as a scalar subquery."""
    parts = [bleu(df, row_id), rouge_n(df, row_id), rouge_l(df), exact_match(df), token_f1(df), distinct_n(df, "pred")]
    one = df.sparkSession.range(1)
    for i, p in enumerate(parts):
        one = one.withColumn(f"__{i}", p.select(F.struct(*p.columns).alias("s")).scalar())
    return one.select(*[f"__{i}.*" for i in range(len(parts))])


def win_rate(a: DataFrame, b: DataFrame, row_id: str, score: str) -> DataFrame:
    j = a.select(row_id, F.col(score).alias("sa")).join(b.select(row_id, F.col(score).alias("sb")), row_id)
    share = lambda c: F.avg(c.cast("double"))
    return j.agg(
        share(F.col("sa") > F.col("sb")).alias("model_a_win_rate"), share(F.col("sb") > F.col("sa")).alias("model_b_win_rate"),
        share(F.col("sa") == F.col("sb")).alias("tie_rate"),
    )
