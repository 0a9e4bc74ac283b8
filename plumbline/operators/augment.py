"""Text augmentation with draws keyed by row id, so results do not depend on the layout.

Every builder takes (row id, text column, copy number) and returns text. Word arrays are handled
in one pass or one sort per row.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import text as X
from plumbline.functions.keyed import pick, uniform

# Replacement lexicon, fillers, protected words.
SYNONYMS = {
    "good": ["great", "excellent", "fine", "nice"],
    "bad": ["poor", "terrible", "awful", "negative"],
    "big": ["large", "huge", "massive", "enormous"],
    "small": ["tiny", "little", "minor", "compact"],
    "fast": ["quick", "rapid", "swift", "speedy"],
    "slow": ["gradual", "unhurried", "leisurely"],
    "important": ["crucial", "significant", "essential", "vital"],
    "help": ["assist", "aid", "support", "facilitate"],
    "create": ["make", "build", "develop", "produce"],
    "show": ["display", "demonstrate", "present", "exhibit"],
    "use": ["utilize", "employ", "apply"],
    "get": ["obtain", "acquire", "receive", "gain"],
    "make": ["create", "produce", "build", "construct"],
    "like": ["similar to", "such as", "resembling"],
}
FILLERS = [
    "also", "indeed", "actually", "certainly", "basically",
    "essentially", "generally", "particularly", "specifically", "notably",
]
PROTECTED = ["is", "are", "was", "were", "not", "no", "yes"]
PUNCTUATION = ".,!?;:"
# Lexicon of the preprocessing variants.
VARIANTS = {
    "important": ["significant", "crucial", "essential"],
    "good": ["excellent", "great", "positive"],
    "bad": ["poor", "negative", "inferior"],
    "use": ["utilize", "employ", "apply"],
}
# Instruction templates and removable prefixes.
REPHRASE = [
    "Please {action}", "Could you {action}", "I need you to {action}", "Can you {action}",
    "{action}", "I'd like you to {action}", "Would you {action}",
]
PREFIXES = ["please ", "could you ", "can you ", "i need you to ", "i'd like you to ", "would you "]


def _strings(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _lexicon(words: Mapping[str, Sequence[str]]) -> Column:
    return F.create_map(*[c for k, v in words.items() for c in (F.lit(k), _strings(v))])


def _bare(w: Column) -> Column:
    return F.regexp_replace(F.lower(w), r"^[.,!?;:]+|[.,!?;:]+$", "")


def _join(ws: Column) -> Column:
    return F.array_join(ws, " ")


def _share(n: Column, ratio: float) -> Column:
    return F.greatest(F.lit(1), F.floor(n * F.lit(ratio)).cast("int"))


def _counted(text: Column) -> Column:
    return X.let(X.words(text), lambda ws: F.struct(ws.alias("ws"), F.size(ws).alias("n")))


def _salted(i: Column, copy: int | Column) -> Column:
    c = F.lit(copy) if isinstance(copy, int) else copy
    return c * 1000003 + i


def synonym(row_id: Column, text: Column, copy: int | Column = 0, ratio: float = 0.1) -> Column:
    """Swap up to max(1, n*ratio) lexicon words, those with the smallest draws; capital and final
    punctuation stay."""
    known, lex = _strings(list(SYNONYMS)), _lexicon(SYNONYMS)
    draw = lambda i: uniform(row_id, "syn", _salted(i, copy))

    def swap(w: Column, i: Column) -> Column:
        options = F.try_element_at(lex, _bare(w))
        new = F.element_at(options, pick(row_id, "synpick", F.size(options), _salted(i, copy)) + 1)
        upper = F.concat(F.upper(F.substring(new, 1, 1)), new.substr(F.lit(2), F.length(new)))
        last = F.right(w, F.lit(1))
        cased = F.when(F.substring(w, 1, 1).rlike(r"^\p{Lu}"), upper).otherwise(new)
        return F.concat(cased, F.when(last.rlike("[.,!?;:]"), last).otherwise(""))

    def limited(ws: Column) -> Column:
        draws = F.transform(ws, lambda w, i: F.when(F.array_contains(known, _bare(w)), draw(i)))
        lowest = F.slice(F.sort_array(F.array_compact(draws)), 1, _share(F.size(ws), ratio))
        return F.struct(ws.alias("ws"), F.try_element_at(lowest, F.lit(-1)).alias("limit"))

    def replaced(s: Column) -> Column:
        hit = lambda w, i: F.array_contains(known, _bare(w)) & (draw(i) <= s["limit"])
        return _join(F.transform(s["ws"], lambda w, i: F.when(hit(w, i), swap(w, i)).otherwise(w)))

    return X.let(X.words(text), lambda ws: X.let(limited(ws), replaced))


def insert_fillers(row_id: Column, text: Column, copy: int | Column = 0, ratio: float = 0.1) -> Column:
    """max(1, n*ratio) fillers in random gaps behind the first word; one sort places them all."""
    fill = _strings(FILLERS)

    def build(s: Column) -> Column:
        own = F.transform(s["ws"], lambda w, i: F.struct(i.alias("a"), F.lit(0).alias("b"), w.alias("w")))
        extra = F.transform(
            F.sequence(F.lit(1), _share(s["n"], ratio)),
            lambda j: F.struct(
                pick(row_id, "inspos", F.greatest(s["n"], F.lit(1)), _salted(j, copy)).alias("a"), j.alias("b"),
                F.element_at(fill, pick(row_id, "insword", len(FILLERS), _salted(j, copy)) + 1).alias("w"),
            ),
        )
        return _join(F.transform(F.sort_array(F.concat(own, extra)), lambda x: x["w"]))

    return X.let(_counted(text), build)


def delete_words(row_id: Column, text: Column, copy: int | Column = 0, prob: float = 0.1) -> Column:
    keep = _strings(PROTECTED)

    def left(ws: Column) -> Column:
        kept = F.filter(ws, lambda w, i: F.array_contains(keep, _bare(w)) | (uniform(row_id, "del", _salted(i, copy)) > prob))
        return X.let(
            kept, lambda k: F.when((F.size(ws) <= 3) | (F.size(k) < F.size(ws) * 0.5), text).otherwise(_join(k))
        )

    return X.let(X.words(text), left)


def swap_neighbours(row_id: Column, text: Column, copy: int | Column = 0, ratio: float = 0.1) -> Column:
    def build(s: Column) -> Column:
        def step(acc: Column, j: Column) -> Column:
            at = pick(row_id, "swap", s["n"] - 1, _salted(j, copy)) + 1
            pair = F.array(F.element_at(acc, at + 1), F.element_at(acc, at))
            return F.concat(F.slice(acc, F.lit(1), at - 1), pair, F.slice(acc, at + 2, s["n"]))

        out = F.aggregate(F.sequence(F.lit(1), _share(s["n"], ratio)), s["ws"], step)
        return F.when(s["n"] < 2, text).otherwise(_join(out))

    return X.let(_counted(text), build)


def change_case(row_id: Column, text: Column, copy: int | Column = 0, mode: str = "random") -> Column:
    """title capitalises after spaces only, unlike Python's title() on apostrophes and digits."""
    fixed = {"lower": F.lower(text), "upper": F.upper(text), "title": F.initcap(text)}
    if mode in fixed:
        return fixed[mode]
    return F.when(pick(row_id, "case", 2, _salted(F.lit(0), copy)) == 0, F.lower(text)).otherwise(F.initcap(text))


def lexicon_variants(text: Column) -> Column:
    """The text and its first three one-word variants, without repeats."""
    lex = _lexicon(VARIANTS)
    hits = F.filter(X.words(text), lambda w: F.try_element_at(lex, F.lower(w)).isNotNull())

    def variants(w: Column) -> Column:
        at = F.instr(text, w)
        tail = text.substr(at + F.length(w), F.length(text))
        return F.transform(F.element_at(lex, F.lower(w)), lambda s: F.concat(text.substr(F.lit(1), at - 1), s, tail))

    return F.array_distinct(F.concat(F.array(text), F.slice(F.flatten(F.transform(F.slice(hits, 1, 3), variants)), 1, 3)))


def rephrase(row_id: Column, text: Column, copy: int | Column = 0) -> Column:
    low = F.lower(text)
    action = F.regexp_replace(low, "^(" + "|".join(PREFIXES) + ")", "")
    heads = _strings([t.split("{action}")[0] for t in REPHRASE])
    return F.concat(F.element_at(heads, pick(row_id, "rephrase", len(REPHRASE), copy) + 1), action)


Strategy = Callable[..., Column]
STRATEGIES: dict[str, Strategy] = {
    "synonym_replacement": synonym,
    "random_insertion": insert_fillers,
    "random_deletion": delete_words,
    "random_swap": swap_neighbours,
}


def register_strategy(name: str, builder: Strategy) -> None:
    """Add a user strategy: a function of (row id, text, copy) that returns a text column."""
    STRATEGIES[name] = builder


def augment_dataset(
    df: DataFrame, row_id: str, field: str, factor: int = 2, strategies: Sequence[str] | None = None, include_original: bool = True
) -> DataFrame:
    """Originals plus `factor` augmented copies, one keyed strategy per copy."""
    names = list(strategies or ["synonym_replacement", "random_insertion", "random_deletion", "random_swap"])
    c = df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(factor))))
    s = c.withColumn("augmentation", F.element_at(_strings(names), pick(F.col(row_id), "strategy", len(names), F.col("copy")) + 1))
    text = F.col(field)
    for n in names:
        made = STRATEGIES[n](F.col(row_id), F.col(field), F.col("copy"))
        text = F.when(F.col("augmentation") == n, made).otherwise(text)
    made = s.withColumn(field, text).withColumn("confidence", F.lit(0.9))
    if not include_original:
        return made
    base = df.withColumns({"copy": F.lit(0), "augmentation": F.lit("original"), "confidence": F.lit(1.0)})
    return base.unionByName(made)


def instruction_versions(df: DataFrame, row_id: str, n: int = 2) -> DataFrame:
    c = df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(n))))
    return c.withColumn("instruction", rephrase(F.col(row_id), F.col("instruction"), F.col("copy")))
