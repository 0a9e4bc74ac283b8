"""Token alignment across two tokenizers, by divide and conquer at shared cuts.

Two tokenizations of one text are two sorted lists of byte offsets at which tokens end. Between two known cuts, a common
end near the middle is located by bisection: the next end of one list at or after a point is looked up in the other, and
the points leapfrog until they agree or leave the interval; then the same towards the other side. Both halves go on alike;
an interval without a common end is one group of tokens. All intervals of a batch of texts are bisected at once.

Corpus counts of linked id pairs are aggregated per batch before they are shuffled. The commonest pairs, up to a stated
number, are sent to the tasks that score the texts; rarer ones are joined by a shuffle, so no count is left out.
"""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import map_arrow, stored

#: Byte-level vocabularies write byte b as the character of this table: printable Latin-1 as it is, others from 256 on.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_CHUNK = 1 << 18
PAIR = 1 << 32


def _byte_of() -> dict[str, int]:
    rest = [b for b in range(256) if b not in _PRINTED]
    return {chr(b): b for b in _PRINTED} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteLevel:
    """A byte-level BPE from the JSON text of a `tokenizers` file.

    Texts of characters up to Cyrillic, whose Unicode classes no version of the tables disputes, are encoded by `tiktoken`
    with the ranks of the same file, at a third of the time; all others by `tokenizers`. A file whose entries are not in
    the order of their merges, or that cuts words by another rule, is left to `tokenizers` altogether.
    """

    #: Fixed: the word rule of byte-level BPE files.
    WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    _beyond = re.compile("[^\x00-\u052f]")

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tool = Tokenizer.from_str(spec)
        self.tool.encode_special_tokens = True  # strings of special tokens are ordinary text
        byte, vocab = _byte_of(), self.tool.get_vocab(with_added_tokens=True)
        self.bytes = [b""] * (max(vocab.values()) + 1)
        for entry, i in vocab.items():
            self.bytes[i] = bytes(byte[c] for c in entry) if all(c in byte for c in entry) else entry.encode()
        self.quick = self._ranked(json.loads(spec), byte)

    def _ranked(self, spec: dict, byte: dict[str, int]):
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model.get("merges", ())]
        ranks = [model["vocab"].get(x + y) for x, y in merges]
        plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer")
        if not plain or model.get("ignore_merges") or None in ranks or any(x >= y for x, y in zip(ranks, ranks[1:])):
            return None
        import tiktoken

        extra = {x["content"] for x in spec.get("added_tokens", ())}
        own = {self.bytes[i]: i for entry, i in model["vocab"].items() if entry not in extra}
        return tiktoken.Encoding("own", pat_str=self.WORDS, mergeable_ranks=own, special_tokens={})

    def encode(self, texts: list[str]) -> list:
        out, rest = [None] * len(texts), []
        for i, t in enumerate(texts):
            if self.quick is not None and not self._beyond.search(t):
                out[i] = self.quick.encode_ordinary(" " + t)
            else:
                rest.append(i)
        for i, e in zip(rest, self.tool.encode_batch_fast([" " + texts[i] for i in rest], add_special_tokens=False) if rest else ()):
            out[i] = e.ids
        return out


class Pieces:
    """A sentencepiece model from its bytes; it adds the leading space itself."""

    def __init__(self, model: bytes):
        from sentencepiece import SentencePieceProcessor

        self.tool = SentencePieceProcessor(model_proto=model)
        n = self.tool.get_piece_size()
        self.bytes = [bytes([int(p[1:-1], 16)]) if self.tool.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(self.tool.id_to_piece(list(range(n))))]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.tool.encode(texts, num_threads=1)


def _upward(ea: np.ndarray, eb: np.ndarray, i: np.ndarray, i1: np.ndarray, j1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in both lists of the least common end from ea[i] on, before the interval's own end at i1 - 1 and j1 - 1; -1 if none."""
    out_i, out_j, at = np.full(len(i), -1, i.dtype), np.full(len(i), -1, i.dtype), np.arange(len(i))
    while len(at):
        x = ea[i]
        j = np.searchsorted(eb, x)
        inside = j < j1[at] - 1
        hit = inside & (eb[j] == x)
        out_i[at[hit]], out_j[at[hit]] = i[hit], j[hit]
        go = inside & ~hit
        at, i = at[go], np.searchsorted(ea, eb[j[go]])
        inside = i < i1[at] - 1
        at, i = at[inside], i[inside]
    return out_i, out_j


def _downward(ea: np.ndarray, eb: np.ndarray, i: np.ndarray, i0: np.ndarray, j0: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for the greatest common end from ea[i] downwards, not before the positions i0 and j0."""
    out_i, out_j, at = np.full(len(i), -1, i.dtype), np.full(len(i), -1, i.dtype), np.arange(len(i))
    while len(at):
        x = ea[i]
        j = np.searchsorted(eb, x, "right") - 1
        inside = j >= j0[at]
        hit = inside & (eb[j] == x)
        out_i[at[hit]], out_j[at[hit]] = i[hit], j[hit]
        go = inside & ~hit
        at, i = at[go], np.searchsorted(ea, eb[j[go]], "right") - 1
        inside = i >= i0[at]
        at, i = at[inside], i[inside]
    return out_i, out_j


def shared_cuts(ea: np.ndarray, eb: np.ndarray, a_at: np.ndarray, b_at: np.ndarray) -> np.ndarray:
    """Ends of all groups, sorted. Text t has the token ends ea[a_at[t]:a_at[t + 1]] and those of eb alike, with equal last ends.

    An interval is a run of tokens of both sides between two cuts. A side with one token has no end inside, so it is a leaf;
    all others are halved at a common end, or leaves if they hold none. Intervals stay in order, which keeps lookups local.
    """
    some = a_at[1:] > a_at[:-1]
    i0, i1, j0, j1 = a_at[:-1][some], a_at[1:][some], b_at[:-1][some], b_at[1:][some]
    cuts = [ea[i1 - 1]]
    while True:
        open_ = (i1 - i0 > 1) & (j1 - j0 > 1)
        i0, i1, j0, j1 = i0[open_], i1[open_], j0[open_], j1[open_]
        if not len(i0):
            return np.sort(np.concatenate(cuts))
        mid = (i0 + i1 - 1) >> 1
        ci, cj = _upward(ea, eb, mid, i1, j1)
        miss = np.flatnonzero((ci < 0) & (mid > i0))
        ci[miss], cj[miss] = _downward(ea, eb, mid[miss] - 1, i0[miss], j0[miss])
        has = ci >= 0
        ci, cj = ci[has], cj[has]
        cuts.append(ea[ci])
        i0, i1, j0, j1 = (np.stack(x, 1).ravel() for x in ((i0[has], ci + 1), (ci + 1, i1[has]), (j0[has], cj + 1), (cj + 1, j1[has])))


@dataclass
class Aligned:
    """Tokens, groups and links of several texts, as flat arrays; text i has the slices [x_at[i], x_at[i + 1])."""

    a: np.ndarray
    b: np.ndarray
    a_group: np.ndarray
    b_group: np.ndarray
    a_at: np.ndarray
    b_at: np.ndarray
    group_at: np.ndarray
    pairs: np.ndarray  # a * 2^32 + b per link
    link_at: np.ndarray


def _flat(side: list) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *[np.asarray(x, np.int64) for x in side]])


def align(a_ids: list, b_ids: list, a_sizes: np.ndarray, b_sizes: np.ndarray) -> Aligned:
    """Align two tokenizations of the same texts, lists or arrays of ids; both sides of a text have the same number of bytes."""
    a, b = _flat(a_ids), _flat(b_ids)
    ea, eb = np.cumsum(a_sizes[a]), np.cumsum(b_sizes[b])
    a_at, b_at = (np.concatenate(([0], np.cumsum([len(x) for x in side], dtype=np.int64))) for side in (a_ids, b_ids))
    text_at = np.concatenate(([0], ea))[a_at]
    cuts = shared_cuts(ea, eb, a_at, b_at)
    ends = np.sort(np.concatenate((ea, eb)))
    ends = ends[np.append(ends[1:] != ends[:-1], True)] if len(ends) else ends
    # between two neighbouring ends lies the overlap of exactly one token of either side
    pairs = a[np.searchsorted(ea, ends)] * PAIR + b[np.searchsorted(eb, ends)]
    return Aligned(
        a, b, np.searchsorted(cuts, ea), np.searchsorted(cuts, eb), a_at, b_at, np.searchsorted(cuts, text_at, "right"), pairs, np.searchsorted(ends, text_at, "right")
    )


class _Writer:
    """Writes groups as `a1,a2|b1;a3|b2,b3`: every token is its number and the sign that follows it."""

    def __init__(self, n_a: int, n_b: int):
        self.marks = [f"{i}{s}" for n, signs in ((n_a, ",|"), (n_b, ",;")) for s in signs for i in range(n)]
        self.n_a, self.n_b = n_a, n_b

    def write(self, x: Aligned) -> list[str]:
        a_last = np.append(x.a_group[1:] != x.a_group[:-1], True)[: len(x.a)]
        b_last = np.append(x.b_group[1:] != x.b_group[:-1], True)[: len(x.b)]
        flat = np.zeros(len(x.a) + len(x.b), np.int64)
        flat[np.arange(len(x.a)) + np.searchsorted(x.b_group, x.a_group)] = x.a + a_last * self.n_a
        flat[np.arange(len(x.b)) + np.searchsorted(x.a_group, x.b_group, "right")] = x.b + b_last * self.n_b + 2 * self.n_a
        marks, flat, at = self.marks, flat.tolist(), (x.a_at + x.b_at).tolist()
        return ["".join([marks[k] for k in flat[i:j]])[:-1] for i, j in zip(at, at[1:])]


def _tokens(tool_a: ByteLevel, tool_b: Pieces, texts: list[bytes]) -> tuple[list[list[int]], list[list[int]]]:
    """Ids of both sides per text; none for texts that are empty, no UTF-8, or not the joined bytes of both sides."""
    out_a, out_b = [[] for _ in texts], [[] for _ in texts]
    todo = []
    for i, t in enumerate(texts):
        try:
            todo.append((i, t.decode()))
        except UnicodeDecodeError:
            pass
    todo = [x for x in todo if x[1]]
    while todo:
        n, size = 0, 0
        while n < len(todo) and (n == 0 or size + len(todo[n][1]) <= _CHUNK):
            size += len(todo[n][1])
            n += 1
        part, todo = todo[:n], todo[n:]
        words = [t for _, t in part]
        for (i, _), a, b in zip(part, tool_a.encode(words), tool_b.encode(words)):
            whole = b" " + texts[i]
            if b"".join([tool_a.bytes[k] for k in a]) == whole and b"".join([tool_b.bytes[k] for k in b]) == whole:
                out_a[i], out_b[i] = a, b
    return out_a, out_b


def _pair_counts(pairs: np.ndarray, link_at: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct pairs of each text and how often it links them."""
    return [np.unique(pairs[i:j], return_counts=True) for i, j in zip(link_at, link_at[1:])]


def align_tokens(docs: DataFrame, spec_a: str, model_b: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id, n_a, n_b, n_groups, n_links, groups (text), pairs (distinct linked ids, a * 2^32 + b) and
    times (links per pair).

    Null and empty texts, and texts that one side doesn't give back byte by byte, have no tokens: zeros, empty text and
    lists. Repeated rows stay. One pass, no shuffle.
    """
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    sent = base.sparkSession.sparkContext.broadcast((spec_a, model_b))  # two vocabulary files
    made = {}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not made:
            a, b = ByteLevel(sent.value[0]), Pieces(sent.value[1])
            made.update(a=a, b=b, sizes=[np.array([len(x) for x in t.bytes]) for t in (a, b)], writer=_Writer(len(a.bytes), len(b.bytes)))
        a_ids, b_ids = _tokens(made["a"], made["b"], batch.column("text").fill_null(b"").to_pylist())
        x = align(a_ids, b_ids, *made["sizes"])
        counts = _pair_counts(x.pairs, x.link_at)
        cols = [np.diff(x.a_at), np.diff(x.b_at), np.diff(x.group_at), np.diff(x.link_at)]
        at = pa.array(np.concatenate(([0], np.cumsum([len(p) for p, _ in counts]))), pa.int32())
        flat, times = np.concatenate([p for p, _ in counts]), np.concatenate([c for _, c in counts])
        return pa.RecordBatch.from_arrays(
            [batch.column("id"), *[pa.array(c, pa.int64()) for c in cols], pa.array(made["writer"].write(x), pa.string()),
             pa.ListArray.from_arrays(at, pa.array(flat, pa.int64())), pa.ListArray.from_arrays(at, pa.array(times, pa.int32()))],
            names=["id", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"],
        )

    kind = base.schema["id"].dataType.simpleString()
    return map_arrow(base, run, f"id {kind}, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, times array<int>", 1 << 20)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, docs, best): texts that hold each linked pair, and whether its A id has no pair in more texts."""
    docs = aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("docs"))
    docs = stored(docs, "pair-counts")
    top = docs.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("docs").alias("most"))
    return docs.join(top, F.shiftright("pair", 32) == F.col("a")).select("pair", "docs", (F.col("docs") == F.col("most")).alias("best"))


def link_scores(aligned: DataFrame, counts: DataFrame, max_sent: int = 4_000_000) -> DataFrame:
    """`aligned` without its lists, plus n_best (links that are the best of their A id) and count_sum (texts per link, summed).

    `aligned` and `counts` are read several times and must be stored tables. At most `max_sent` pairs, the commonest, are
    sent to the tasks; the links of all others are joined by a shuffle.
    """
    level = F.floor(F.log2("docs")).cast("int")
    sizes = sorted(((r.level, r.n) for r in counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    least, n = 1 << 62, 0
    for lev, more in sizes:
        n += more
        if n > max_sent:
            break
        least = 1 << lev
    whole = n <= max_sent
    head = counts.where(F.col("docs") >= least).select("pair", "docs", "best").toArrow()  # at most max_sent rows
    pairs = head.column("pair").to_numpy()
    order = np.argsort(pairs)
    docs = head.column("docs").to_numpy()[order]
    sent = aligned.sparkSession.sparkContext.broadcast((pairs[order], docs, head.column("best").to_numpy(zero_copy_only=False)[order]))
    keep = [c for c in aligned.columns if c not in ("pairs", "times")]
    rows = aligned.withColumn("row", F.monotonically_increasing_id()) if whole else stored(aligned.withColumn("row", F.monotonically_increasing_id()), "aligned-rows")

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        known, docs, best = sent.value
        lists = batch.column("pairs")
        at, pair, times = lists.offsets.to_numpy(), lists.values.to_numpy(), batch.column("times").values.to_numpy()
        at, pair, times = at - at[0], pair[at[0] : at[-1]], times[at[0] : at[-1]]
        owner = np.repeat(np.arange(batch.num_rows), np.diff(at))
        where = np.minimum(np.searchsorted(known, pair), max(len(known) - 1, 0))
        hit = known[where] == pair if len(known) else np.zeros(len(pair), bool)
        own, links, where = owner[hit], times[hit].astype(np.int64), where[hit]
        n_best, total = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
        if len(own):
            np.add.at(n_best, own, links * best[where])
            np.add.at(total, own, links * docs[where])
        rest = np.concatenate(([0], np.cumsum(np.bincount(owner[~hit], minlength=batch.num_rows))))
        rest = pa.array(rest, pa.int32())
        return pa.RecordBatch.from_arrays(
            [*[batch.column(c) for c in [*keep, "row"]], pa.array(n_best), pa.array(total), pa.ListArray.from_arrays(rest, pa.array(pair[~hit])), pa.ListArray.from_arrays(rest, pa.array(times[~hit], pa.int32()))],
            names=[*keep, "row", "n_best", "count_sum", "pairs", "times"],
        )

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*keep, "row").schema)
    scored = map_arrow(rows, score, f"{fields}, n_best long, count_sum long, pairs array<long>, times array<int>")
    if whole:
        return scored.select(*keep, "n_best", "count_sum")
    scored = stored(scored, "aligned-scored")
    rest = scored.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("k"))
    more = rest.join(counts.where(F.col("docs") < least), "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("k")).otherwise(0)).alias("rest_best"), F.sum(F.col("k") * F.col("docs")).alias("rest_sum"))
    out = scored.join(more, "row", "left")
    return out.select(*keep, (F.col("n_best") + F.coalesce("rest_best", F.lit(0))).alias("n_best"), (F.col("count_sum") + F.coalesce("rest_sum", F.lit(0))).alias("count_sum"))


def vocabularies(folder: str = "/opt/tokenizers", a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model") -> tuple[str, bytes]:
    """Read the two vocabulary files on the driver; tasks get their content."""
    with open(f"{folder}/{a}", encoding="utf-8") as f, open(f"{folder}/{b}", "rb") as g:
        return f.read(), g.read()

