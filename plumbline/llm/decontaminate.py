"""Benchmark decontamination by template windows, with DataFrame functions only.

Words become tokens: literals (lower case, no punctuation) or typed slots for numbers, units after numbers, and names
(capitalised inside a sentence). The hash of `width` consecutive tokens is a template window, so a question with other
numbers or names has the windows of the original. Slots must be filled consistently: equal values in the benchmark stand
for equal values in the document and different ones for different ones. That is, both windows have the same pattern of
first occurrences, which the join compares. Windows with few literals say nothing and are left out, as long as the item
has others. An item without any is met by its longest windows (whole, up to twice the width) if half of their tokens are
literals, and otherwise by windows that also compare the slot values, so that a verbatim copy is found. Only up to three
slots without any literal ("12 34 56") match nothing.

Of every benchmark window one pair of neighbouring literals, the longest, is its key; where literals are few, it is the
longest word. A text without any of these keys can't match, so windows are built only for the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import broadcast_if_small, stored

WIDTH, LITERALS = 10, 6
#: Ways to meet an item, the next one only for items that the ones before leave without a window.
STRONG, WIDE, EXACT = 0, 1, 2
#: Characters that are dropped, white space, characters cut from the end of a word, unit words.
DROPPED = "\"#&'()*+;<=>@[\\]^_`{|}~%$€£“”„«»¡¿"
SPACE = "\t\n\x0b\x0c\r"
TAIL = ".,!?:"
UNITS = (
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg ton tons gram grams pound pounds lb lbs oz ounce ounces ml l liter liters litre litres "
    "gallon gallons second seconds minute minutes hour hours day days week weeks month months year years cent cents dollar dollars euro euros percent degree degrees"
).split()
_NUMBER, _UNIT, _NAME = 1, 2, 3  # tokens below 4 are slots; literals are hashes


def words_of(text: Column) -> Column:
    plain = F.translate(F.coalesce(text, F.lit("")), SPACE + DROPPED, " " * len(SPACE))
    return F.filter(F.split(plain, " "), lambda w: w != "")


def _core(word: Column) -> Column:
    return F.rtrim(word, F.lit(TAIL))


def _pair(first: Column, second: Column) -> Column:
    return F.xxhash64(F.lower(_core(first)), F.lower(_core(second)))


def tokens(words: Column) -> Column:
    """array<struct<t, v>>: token and, for slots, a hash of the value (0 for literals)."""

    def one(w: Column, i: Column) -> Column:
        core = _core(w)
        low = F.lower(core)
        before = F.get(words, i - 1)
        after_number = before.between("0", "9~")
        inner = before.isNotNull() & ~F.substring(before, -1, 1).isin(*".!?:")
        kind = (
            F.when(core.between("0", "9~"), _NUMBER).when(low.isin(*UNITS) & F.coalesce(after_number, F.lit(False)), _UNIT)
            .when((low != core) & F.coalesce(inner, F.lit(False)) & core.rlike(r"^\p{Lu}\p{Ll}+$"), _NAME)
        )
        return F.struct(F.coalesce(kind.cast("bigint"), F.xxhash64(low)).alias("t"), F.when(kind.isNull(), F.lit(0).cast("bigint")).otherwise(F.xxhash64(core)).alias("v"))

    return F.transform(words, one)


def _word(word: Column) -> Column:
    return F.xxhash64(F.lower(_core(word)))


def pair_keys(df: DataFrame, text_col: str, width: int) -> DataFrame:
    """(key): for every window the hash of its longest pair of neighbouring literals.

    With at least LITERALS literals among at most ten tokens two of them are neighbours; a window of one token has none
    and gives a null key, which stands for any text.
    """
    rows = df.select(words_of(F.col(text_col)).alias("__words")).select("__words", tokens(F.col("__words")).alias("__tok"))
    literal = lambda i: F.get("__tok.v", i) == 0
    both = lambda i: F.struct(
        F.when(literal(i) & literal(i + 1), F.length(F.get("__words", i)) + F.length(F.get("__words", i + 1))).otherwise(-1).alias("long"), _pair(F.get("__words", i), F.get("__words", i + 1)).alias("key")
    )
    n = F.size("__words")
    rows = rows.where(n > 0).select(F.when(n > 1, F.transform(F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0))), both)).alias("pairs"), n.alias("n"))
    starts = F.sequence(F.lit(1), F.greatest(F.col("n") - (width - 1), F.lit(1)))
    best = F.transform(starts, lambda i: F.array_max(F.slice("pairs", i, F.lit(width - 1))))
    best = rows.select(F.explode(best).alias("x"))
    return best.where("x is null or x.long > 0").select(F.col("x.key").alias("key")).distinct()


def _enough(way: int, literals: Column, width: Column) -> Column:
    if way == EXACT:
        return (literals >= 1) | (width >= 4)
    return literals >= F.least(F.lit(LITERALS), F.ceil(width / 2) if way == WIDE else width)


def windows(df: DataFrame, text_col: str, lengths: list[int], keep: list[str], whole: bool = False, way: int = STRONG, inside: bool = False) -> DataFrame:
    """(keep..., width, h, p): template hash and slot pattern of every window of the given lengths.

    whole: these are benchmark items. A text shorter than the largest length gives one window, all of its tokens; ways
    other than STRONG add `key`, the hash of a word that any match contains. inside: as if the text stood inside a
    sentence, where its first word can be a name.
    """
    words, keyed = F.col("__words"), whole and way != STRONG
    rows = df.select(*keep, words_of(F.col(text_col)).alias("__words"))
    as_read = F.slice(tokens(F.concat(F.array(F.lit("x")), words)), F.lit(2), F.greatest(F.size(words), F.lit(1))) if inside else tokens(words)
    rows = rows.select(*keep, as_read.alias("__tok"), *([words, tokens(words)["v"].alias("own")] if keyed else []))
    rows = rows.select(*keep, F.col("__tok.t").alias("t"), F.col("__tok.v").alias("v"), F.exists("__tok.v", lambda x: x != 0).alias("slots"), *(["__words", "own"] if keyed else []))
    n = F.size("t")

    def window(i: Column, width: Column) -> Column:
        t, v = F.slice("t", i, width), F.slice("v", i, width)
        filled = F.filter(v, lambda x: x != 0)
        pattern = F.when(F.col("slots"), F.when(F.size(filled) > 1, F.xxhash64(F.transform(filled, lambda x: F.array_position(filled, x)))))
        plain = F.when(F.col("slots"), F.size(filled)).otherwise(F.lit(0))
        more = []
        if keyed:  # a first word that is a name only inside a sentence counts as the literal it is on its own
            own = F.slice("own", i, width)
            plain = F.size(F.filter(own, lambda x: x != 0))
            one = lambda w, v: F.when((v == 0) | F.lit(way == EXACT), F.struct(F.length(w).alias("long"), _word(w).alias("key")))
            more = [F.array_max(F.zip_with(F.slice("__words", i, width), own, one))["key"].alias("key")]
        h = F.xxhash64(t, v) if way == EXACT else F.xxhash64(t)
        return F.struct(h.alias("h"), F.coalesce(pattern, F.lit(0).cast("bigint")).alias("p"), (width - plain).alias("literals"), *more)

    out = None
    for w in lengths:
        starts = F.sequence(F.lit(1), F.greatest(n - (w - 1), F.lit(1)))
        got = F.when(n >= w, F.transform(starts, lambda i: window(i, F.lit(w))))
        if whole:
            got = got.when((n > 0) & (n < w), F.array(window(F.lit(1), F.greatest(n, F.lit(1)))))
        part = rows.select(*keep, F.least(n, F.lit(w)).alias("width"), F.explode(got).alias("x")).select(*keep, "width", "x.*")
        out = part if out is None else out.union(part)
    # what stands on the other side of the join decides for weak windows
    return (out if way != STRONG and not whole else out.where(_enough(way, F.col("literals"), F.col("width")))).drop("literals")


def weak_windows(items: DataFrame, item_text: str, width: int, keep: list[str]) -> DataFrame:
    """(keep..., way, width, h, p, key) for items without a STRONG window."""
    def of(way: int, some: DataFrame) -> DataFrame:
        size = 2 * width if way == WIDE else width
        own, inner = (windows(some, item_text, [size], keep, whole=True, way=way, inside=i) for i in (False, True))
        return own.union(inner).distinct().withColumn("way", F.lit(way))

    wide = of(WIDE, items)
    rest = items.join(wide.select("__k1", "__k2").distinct(), ["__k1", "__k2"], "left_anti")
    return wide.union(of(EXACT, rest))


def _key(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("__k1"), F.xxhash64(F.lit(1), text).alias("__k2")]


def contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", width: int = WIDTH, max_broadcast_windows: int = 1_000_000) -> DataFrame:
    """(__k1, __k2, n_items, first_item) per distinct contaminated text, by two hashes of it."""
    items = benchmark.where(F.col(item_text).isNotNull()).select(F.col(item_col).alias("__item"), F.col(item_text).alias("__item_text"), *_key(F.col(item_text)))
    ids = ["__item", "__k1", "__k2"]
    bench = stored(windows(items, "__item_text", [width], ids, whole=True).distinct(), "benchmark-windows").withColumn("way", F.lit(STRONG))
    weak = items.join(bench.select("__k1", "__k2").distinct(), ["__k1", "__k2"], "left_anti")
    weak = stored(weak_windows(weak, "__item_text", width, ids), "benchmark-weak-windows")
    any_weak = weak.limit(1).count() > 0
    if any_weak:
        bench = bench.unionByName(weak.drop("key"))
    bench = bench.drop("__k1", "__k2")
    lengths = sorted((r.way, r.width) for r in bench.select("way", "width").distinct().collect())  # at most 4 * `width` values
    texts = docs.where(F.col(text_col).isNotNull()).select(*_key(F.col(text_col)), F.col(text_col).alias("__text"))
    keys = pair_keys(items, "__item_text", width)
    keys = stored(keys.union(weak.select("key")).distinct() if any_weak else keys, "benchmark-keys")
    if keys.where("key is null").limit(1).count() == 0:
        words = F.col("__words")
        split = texts.select("__k1", "__k2", words_of(F.col("__text")).alias("__words"))
        rows = split.where(F.size(words) > 1)
        rows = rows.select("__k1", "__k2", F.explode(F.arrays_zip(F.slice(words, F.lit(1), F.size(words) - 1).alias("a"), F.slice(words, F.lit(2), F.size(words) - 1).alias("b"))).alias("x"))
        rows = rows.select("__k1", "__k2", _pair(F.col("x.a"), F.col("x.b")).alias("key"))
        if any_weak:
            rows = rows.union(split.select("__k1", "__k2", F.explode(words).alias("x")).select("__k1", "__k2", _word(F.col("x")).alias("key")))
        some = rows.join(broadcast_if_small(keys, max_broadcast_windows), "key", "left_semi").select("__k1", "__k2").distinct()
        texts = texts.join(broadcast_if_small(stored(some, "benchmark-candidates"), max_broadcast_windows), ["__k1", "__k2"], "left_semi")
    hits = None
    for way, w in lengths:
        mine = windows(texts, "__text", [w], ["__k1", "__k2"], way=way).drop("width")
        part = mine.join(broadcast_if_small(bench.where((F.col("way") == way) & (F.col("width") == w)).drop("way", "width"), max_broadcast_windows), ["h", "p"])
        hits = part if hits is None else hits.union(part)
    if hits is None:
        hits = texts.select("__k1", "__k2").limit(0).crossJoin(bench.select("__item").limit(0))
    return hits.groupBy("__k1", "__k2").agg(F.count_distinct("__item").alias("n_items"), F.min("__item").alias("first_item"))


def flag_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """All columns of `docs` (those named like new ones are replaced) plus contaminated, n_items, first_item.

    n_items: benchmark items that share a consistent template window of ten tokens with the text, or all their tokens if
    they have fewer. A window needs six literals (or all its tokens, if fewer). Items without such a window share up to
    twenty tokens, half of them (at most six) literals, or else ten tokens with equal slot values; up to three slots
    without a literal match nothing. Null and empty texts and items match nothing; rows of equal text get equal results.
    """
    docs = docs.drop(*[c for c in ("contaminated", "n_items", "first_item") if c != text_col])
    found = stored(contamination(docs, benchmark, text_col, item_col, item_text), "contaminated")
    keyed = docs.select("*", *_key(F.coalesce(F.col(text_col), F.lit(""))))
    out = keyed.join(found, ["__k1", "__k2"], "left").drop("__k1", "__k2")
    return out.select(*docs.columns, F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).cast("bigint").alias("n_items"), "first_item")
