"""Katz backoff language model (bigrams) with Good-Turing discounts, trained and evaluated by chunks of documents.

Joining every token with an n-gram table would shuffle many times the text. Instead tasks code their documents once as
chunks of bounded size (a sorted vocabulary of word hashes and token numbers). A chunk sends its distinct words, later its
distinct bigrams, to partitions of hash space, one packed row per chunk and partition; there they meet the other chunks'
and are summed, and the sums go back in the order they came. The model is therefore a pair of partitioned tables that no
task holds as a whole. Bigrams of frequent histories are spread by their second word; the sums of those histories, of
which there are at most `SPREAD`, come together in one small table.

Words are lower-cased (ASCII); a text is its words and one end token, the first follows a start symbol. Unseen words share
one class. p(w) = d(c) c / N, the class gets what the discounts leave. p(w|u) = d(c) c / T(u) for seen bigrams, else
a(u) p(w) with a(u) such that all probabilities sum to 1. T(u) is the history's count, plus 1 if nothing was discounted.
"""

from __future__ import annotations

import pickle
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import small_batches, stored

TOKENS, PART, SPREAD, CUT = 4_000_000, 3_000_000, 4096, 5
END, START = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)


def _pack(*arrays: np.ndarray) -> bytes:
    """Hashes as they are, anything else deflated."""
    return pickle.dumps([(a.dtype.str, a.tobytes() if a.dtype == np.uint64 else zlib.compress(a.tobytes(), 1)) for a in arrays])


def _unpack(blob: bytes) -> list[np.ndarray]:
    return [np.frombuffer(b if d == "<u8" else zlib.decompress(b), d) for d, b in pickle.loads(blob)]


def _planes(numbers: np.ndarray) -> list[np.ndarray]:
    """Numbers below 2^32 byte by byte: the high bytes deflate to nothing."""
    code = numbers.astype(np.uint32, copy=False)
    return [((code >> np.uint32(8 * k)) & np.uint32(255)).astype(np.uint8) for k in range(4)]


def _joined(planes: list[np.ndarray]) -> np.ndarray:
    return sum(p.astype(np.uint32) << np.uint32(8 * k) for k, p in enumerate(planes))


def discounts(counts_of: np.ndarray) -> np.ndarray:
    """d(0..CUT) from the numbers of n-grams seen 1..CUT+1 times: Katz's formula, or (r - 1/2) / r where it is undefined.

    Higher counts are not discounted.
    """
    n = np.concatenate(([0.0], np.asarray(counts_of, float)))
    r = np.arange(1, CUT + 1)
    out = (r - 0.5) / r
    if (n[1:] > 0).all():
        top = (CUT + 1) * n[CUT + 1] / n[1]
        d = ((r + 1) * n[r + 1] / n[r] / r - top) / (1 - top) if top != 1 else out
        if np.isfinite(d).all() and (d > 0).all() and (d < 1).all():
            out = d
    return np.concatenate(([1.0], out))


def _discounted(c: np.ndarray, d: np.ndarray) -> np.ndarray:
    return c * np.where(c <= CUT, d[np.minimum(c, CUT)], 1.0)


def _part(h: np.ndarray, parts: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _turned(h: np.ndarray) -> np.ndarray:
    return (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)


def code_chunks(docs: DataFrame) -> DataFrame:
    """(chunk, n_tokens, ids, held, sizes, tokens, vocab): docs must be (id, text, held)."""

    def flush(hashes, sizes, ids, held):
        flat = np.concatenate(hashes)
        vocab, at, n = np.unique(flat, return_inverse=True, return_counts=True)
        rank = np.argsort(-n, kind="stable")
        number = np.empty(len(vocab), np.uint32)
        number[rank] = np.arange(len(vocab), dtype=np.uint32)
        code = number[at]
        train = np.bincount(at[np.repeat(~np.array(held), sizes)], minlength=len(vocab)).astype(np.int32)
        kinds = (pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary(), pa.binary())
        row = (uuid.uuid4().hex, len(flat), ids, held, sizes, _pack(*_planes(code), rank.astype(np.int32)), _pack(vocab, train))
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], names=["chunk", "n_tokens", "ids", "held", "sizes", "tokens", "vocab"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, sizes, ids, held, n = [], [], [], [], 0
        for batch in batches:
            for i, text, out in zip(batch.column("id").to_pylist(), batch.column("text").cast(pa.binary()), batch.column("held").to_pylist()):
                words = (text.as_py() or b"").lower().split()
                hashes.append(np.append(np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), "<u8"), END))
                sizes.append(len(words) + 1)
                ids.append(i)
                held.append(out)
                n += len(words) + 1
                if n >= TOKENS:
                    yield flush(hashes, sizes, ids, held)
                    hashes, sizes, ids, held, n = [], [], [], [], 0
        if n:
            yield flush(hashes, sizes, ids, held)

    return docs.select("id", "text", "held").mapInArrow(run, "chunk string, n_tokens long, ids array<long>, held array<boolean>, sizes array<long>, tokens binary, vocab binary")


def _rows(schema: str, *cols) -> pa.RecordBatch:
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[x.split()[1]]) for c, x in zip(cols, schema.split(", "))], names=names)


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Row by row; a batch is let go before its last row is worked on."""
    for batch in batches:
        rows = batch.to_pylist()[::-1]
        del batch
        while rows:
            yield rows.pop()


def _send(df: DataFrame, split, parts: int) -> DataFrame:
    """(part, chunk, blob) from `split(row) -> iterator of (part, blob)`."""

    def run(batches):
        for row in _each(batches):
            for p, blob in split(row):
                yield _rows("part int, chunk string, blob binary", [p], [row["chunk"]], [blob])

    return df.mapInArrow(run, "part int, chunk string, blob binary").repartition(parts, "part")


def _gather(df: DataFrame, meet, schema: str) -> DataFrame:
    """`meet(part, chunks, blobs)` yields batches; all blobs of a part are in one task, a bounded share of hash space."""

    def run(batches):
        held = {}
        for batch in batches:
            for p, c, b in zip(*(batch.column(i).to_pylist() for i in range(3))):
                held.setdefault(p, []).append((c, b))
        for p in sorted(held):
            got = sorted(held.pop(p))
            yield from meet(p, [c for c, _ in got], [b for _, b in got])

    return df.mapInArrow(run, schema)


_COUNTED = "part int, chunk string, blob binary, word string, n long, v long, n1 long, n2 long, n3 long, n4 long, n5 long, n6 long, tail long, q double"


def _counted(part, chunks=(), blobs=(), **more) -> pa.RecordBatch:
    """Returned blobs, or a row of sums."""
    names = [x.split()[0] for x in _COUNTED.split(", ")]
    n = max(len(chunks), 1)
    cols = {"part": [part] * n, "chunk": list(chunks) or [None], "blob": list(blobs) or [None]}
    return _rows(_COUNTED, *[cols.get(c, [more.get(c)] * n) for c in names])


def _histogram(total: np.ndarray) -> dict:
    n = np.bincount(total[(total > 0) & (total <= CUT + 1)], minlength=CUT + 2)
    return {f"n{r}": int(n[r]) for r in range(1, CUT + 2)}


def count_words(chunks: DataFrame, parts: int) -> DataFrame:
    def split(row):
        vocab, train = _unpack(row["vocab"])
        edge = np.searchsorted(_part(vocab, parts), np.arange(parts + 1))
        for p in np.flatnonzero(np.diff(edge)):
            yield int(p), _pack(vocab[edge[p] : edge[p + 1]], train[edge[p] : edge[p + 1]])

    def meet(part, names, blobs):
        got = [_unpack(b) for b in blobs]
        _, at = np.unique(np.concatenate([k for k, _ in got]), return_inverse=True)
        total = np.bincount(at, np.concatenate([c for _, c in got])).astype(np.int64)
        cuts = np.cumsum([0, *(len(k) for k, _ in got)])
        yield _counted(part, names, [_pack(total[at[a:b]]) for a, b in zip(cuts, cuts[1:])])
        yield _counted(part, n=int(total.sum()), v=int((total > 0).sum()), **_histogram(total))

    return _gather(_send(chunks.select("chunk", "vocab"), split, parts), meet, _COUNTED)


class Unigrams:
    def __init__(self, n: int, v: int, counts_of: list[int]):
        self.n, self.v, self.d = n, v, discounts(np.array(counts_of))
        left = sum(r * counts_of[r - 1] * (1 - self.d[r]) for r in range(1, CUT + 1))
        self.scale = 1 / n if left > 0 else 1 / (n + 1)  # some mass is left for unseen words
        self.unseen = left / n if left > 0 else 1 / (n + 1)

    def p(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, _discounted(c, self.d) * self.scale, self.unseen)


class Coded:
    """A chunk with its words' training counts: tokens, histories and distinct bigrams in sending order."""

    def __init__(self, row: dict, parts: int, uni: Unigrams):
        *planes, rank = _unpack(row.pop("tokens"))
        vocab, _ = _unpack(row.pop("vocab"))
        self.count = np.concatenate([_unpack(x["blob"])[0] for x in sorted(row.pop("counts"), key=lambda x: x["part"])])
        self.sizes = np.array(row["sizes"])
        self.held = np.array(row["held"], bool)
        self.token = rank[_joined(planes)]
        first = np.cumsum(self.sizes) - self.sizes
        start = len(vocab)
        pair = np.concatenate(([start], self.token[:-1].astype(np.int64)))  # histories first
        pair[first] = start
        pair *= start + 1
        pair += self.token
        order = np.argsort(pair)  # np.unique with an inverse, in less memory
        pair = pair[order]
        new = np.concatenate(([True], pair[1:] != pair[:-1]))
        self.pairs = pair[new]
        del pair
        self.at = np.empty(len(order), np.int32)  # a chunk has far fewer than 2^31 tokens
        self.at[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
        del order, new
        self.mine = np.bincount(self.at[np.repeat(~self.held, self.sizes)], minlength=len(self.pairs)).astype(np.int32)
        self.u, self.w = self.pairs // (start + 1), self.pairs % (start + 1)
        self.hash = np.append(vocab, START)
        common = np.append(self.count, (~self.held).sum()) * SPREAD > uni.n
        common[start] = True
        self.common = common
        where = np.where(common[self.u], _part(_turned(self.hash[self.w]), parts), _part(self.hash[self.u], parts))
        self.order = np.argsort(where, kind="stable")
        self.edge = np.searchsorted(where[self.order], np.arange(parts + 1))

    def groups(self):
        """(part, indices of its pairs, first pair of each history among them)."""
        for p in np.flatnonzero(np.diff(self.edge)):
            i = self.order[self.edge[p] : self.edge[p + 1]]
            u = self.u[i]
            yield int(p), i, np.flatnonzero(np.concatenate(([True], u[1:] != u[:-1])))


def count_bigrams(chunks: DataFrame, parts: int, uni: Unigrams) -> DataFrame:
    def split(row):
        x = Coded(row, parts, uni)
        for p, i, head in x.groups():
            runs = np.diff(np.append(head, len(i))).astype(np.int32)
            u = x.u[i][head]
            w, own = np.unique(x.w[i], return_inverse=True)  # a word's hash and count go once per part, its pairs name it by number
            yield p, _pack(x.hash[u], x.common[u].astype(np.uint8), runs, x.hash[w], x.count[w].astype(np.int64), x.mine[i], *_planes(own))

    def meet(part, names, blobs):
        got = [_unpack(b) for b in blobs]
        got = [(*g[:6], _joined(g[6:])) for g in got]
        u = np.concatenate([np.repeat(g[0], g[2]) for g in got])
        w = np.concatenate([g[3][g[6]] for g in got])
        order = np.lexsort((w, u))
        su, sw = u[order], w[order]
        new = np.concatenate(([True], (su[1:] != su[:-1]) | (sw[1:] != sw[:-1])))
        at = np.empty(len(u), np.int64)
        at[order] = np.cumsum(new) - 1
        total = np.bincount(at, np.concatenate([g[5] for g in got])).astype(np.int64)
        word = su[new]
        known = np.empty(len(total), np.int64)
        known[at] = np.concatenate([g[4][g[6]] for g in got])
        words, own = np.unique(word, return_inverse=True)
        seen = total > 0
        hist = np.stack([np.bincount(own, seen & (total == r)) for r in range(1, CUT + 1)]).astype(np.int64)
        tail = np.bincount(own, np.where(total > CUT, total, 0)).astype(np.int64)
        q = np.bincount(own, np.where(seen, uni.p(known), 0.0))
        out, a = [], 0
        for g in got:
            b, k = a + len(g[5]), np.searchsorted(words, g[0])
            out.append(_pack(total[at[a:b]], hist[:, k], tail[k], q[k]))
            a = b
        yield _counted(part, names, out)
        yield _counted(part, **_histogram(total))
        common = np.unique(np.concatenate([g[0][g[1] == 1] for g in got]))
        for h in common:
            k = np.searchsorted(words, h)
            sums = {f"n{r}": int(hist[r - 1, k]) for r in range(1, CUT + 1)}
            yield _counted(part, word=str(int(h)), tail=int(tail[k]), q=float(q[k]), **sums)

    return _gather(_send(chunks, split, parts), meet, _COUNTED)


def backoff(hist: np.ndarray, tail: np.ndarray, q: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(T, a) per history from its numbers of bigrams by count, the sum of higher counts, and the seen words' p."""
    r = np.arange(1, CUT + 1)[:, None]
    count = (hist * r).sum(0) + tail
    kept = (hist * r * d[1:][:, None]).sum(0) + tail
    total = np.where(kept < count, count, count + 1)
    alpha = np.where(count > 0, (1 - kept / np.maximum(total, 1)) / np.maximum(1 - q, 1e-300), 1.0)
    return np.maximum(total, 1), alpha


def score_chunks(chunks: DataFrame, parts: int, uni: Unigrams, d: np.ndarray, common: dict[int, tuple]) -> DataFrame:
    schema = "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    sent = chunks.sparkSession.sparkContext.broadcast(common)  # at most SPREAD histories

    def one(row):  # its arrays are gone before the next chunk is opened
        x = Coded(row, parts, uni)
        total = np.zeros(len(x.pairs), np.int64)
        m = len(x.hash)
        hist, tail, q = np.zeros((CUT, m), np.int64), np.zeros(m, np.int64), np.zeros(m)
        back = {b["part"]: b["blob"] for b in row.pop("pairs")}
        for p, i, head in x.groups():
            t, h, s, v = _unpack(back[p])
            u = x.u[i][head]
            total[i], tail[u], q[u] = t, s, v
            hist[:, u] = h.reshape(CUT, -1)
        for k in np.flatnonzero(x.common):
            if (known := sent.value.get(int(x.hash[k]))) is not None:
                hist[:, k], tail[k], q[k] = known[:CUT], known[CUT], known[CUT + 1]
        t_u, a_u = backoff(hist, tail, q, d)
        c = x.count
        p1 = np.log10(uni.p(c))
        seen = total > 0
        pair = np.where(seen, np.log10(np.where(seen, _discounted(total, d), 1.0)) - np.log10(t_u)[x.u], np.log10(np.maximum(a_u, 1e-300))[x.u] + p1[x.w])
        owner = np.repeat(np.arange(len(x.sizes), dtype=np.int32), x.sizes)
        n = len(x.sizes)
        base = np.log10((c + 1) / (uni.n + uni.v + 1))[x.token]
        cols = [
            pa.array(row["ids"], pa.int64()), pa.array(x.held), pa.array(x.sizes), pa.array(np.bincount(owner, (c > 0)[x.token], n).astype(np.int64)),
            pa.array(np.full(n, uni.n)), pa.array(np.bincount(owner, base, n)), pa.array(np.bincount(owner, pair[x.at], n)),
        ]
        return pa.RecordBatch.from_arrays(cols, names=[f.split()[0] for f in schema.split(", ")])

    def run(batches):
        for row in _each(batches):
            yield one(row)

    return chunks.mapInArrow(run, schema)


def _returned(counted: DataFrame, name: str) -> DataFrame:
    """(chunk, name): a chunk's blobs together, as many as it sent."""
    return counted.where("chunk is not null").groupBy("chunk").agg(F.collect_list(F.struct("part", "blob")).alias(name))


def katz_scores(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) per row of `docs`, whole texts.

    `held_out` is a boolean column; rows where it isn't true train the model. Null texts count as empty: one end token.
    Without any training row every word is unseen, with probability 1 for the one class. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held"))
    chunks = stored(code_chunks(base), "katz-chunks")
    parts = max(4, int((chunks.agg(F.sum("n_tokens")).first()[0] or 0) // PART + 1))
    words = stored(count_words(chunks, parts), "katz-words")
    sums = words.where("chunk is null").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "v", *(f"n{r}" for r in range(1, CUT + 2)))]).first()
    uni = Unigrams(max(sums.n, 0), sums.v, list(sums[2:])) if sums.n else _Nothing()
    known = chunks.join(_returned(words, "counts"), "chunk")
    pairs = stored(count_bigrams(known, parts, uni), "katz-bigrams")
    hist = pairs.where("chunk is null and word is null").agg(*[F.coalesce(F.sum(f"n{r}"), F.lit(0)) for r in range(1, CUT + 2)]).first()
    cols = [*(f"n{r}" for r in range(1, CUT + 1)), "tail", "q"]
    rows = pairs.where("word is not null").groupBy("word").agg(*[F.sum(c).alias(c) for c in cols]).collect()  # at most SPREAD + 1
    common = {int(r.word): tuple(r[c] for c in cols) for r in rows}
    return score_chunks(known.join(_returned(pairs, "pairs"), "chunk"), parts, uni, discounts(np.array(list(hist))), common)


class _Nothing(Unigrams):
    """No training tokens: the class of unseen words has probability 1."""

    def __init__(self):
        self.n, self.v, self.d, self.scale, self.unseen = 0, 0, np.ones(CUT + 1), 0.0, 1.0
