"""Prompt formats and token id columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import text as X

# Prompt texts.
ALPACA_INPUT = (
    "Below is an instruction that describes a task, paired with an input that provides further context. "
    "Write a response that appropriately completes the request.\n\n"
)
ALPACA_PLAIN = (
    "Below is an instruction that describes a task. Write a response that appropriately completes the request.\n\n"
)
SYSTEM = "You are a helpful assistant."


def _c(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def format_alpaca() -> Column:
    head = F.when(_c("input") != "", ALPACA_INPUT).otherwise(ALPACA_PLAIN)
    extra = F.when(_c("input") != "", F.concat(F.lit("### Input:\n"), _c("input"), F.lit("\n\n"))).otherwise("")
    return F.concat(head, F.lit("### Instruction:\n"), _c("instruction"), F.lit("\n\n"), extra, F.lit("### Response:\n"), _c("output"))


def format_chatml() -> Column:
    user = F.when(_c("input") != "", F.concat(_c("instruction"), F.lit("\n\n"), _c("input"))).otherwise(_c("instruction"))
    return F.concat(
        F.lit(f"<|im_start|>system\n{SYSTEM}<|im_end|>\n<|im_start|>user\n"), user,
        F.lit("<|im_end|>\n<|im_start|>assistant\n"), _c("output"), F.lit("<|im_end|>"),
    )


def format_plain() -> Column:
    return F.concat(_c("instruction"), F.lit("\n\n"), _c("input"), F.lit("\n\nResponse: "), _c("output"))


def format_sft_short() -> Column:
    return F.concat(F.lit("### Instruction:\n"), _c("instruction"), F.lit("\n\n### Response:\n"), _c("output"))


def format_sharegpt(turns: DataFrame, key: str, order: str, role: str, text: str) -> DataFrame:
    """One text per conversation from its ordered human and assistant turns; other roles are dropped.

    A conversation becomes one string, so its turns have to meet in one row.
    """
    label = F.when(F.col(role).isin("human", "user"), "Human: ").when(F.col(role).isin("gpt", "assistant"), "Assistant: ")
    t = turns.select(key, order, F.concat(label, F.col(text)).alias("__p"))
    listed = F.sort_array(F.collect_list(F.when(F.col("__p").isNotNull(), F.struct(order, "__p"))))
    body = F.array_join(F.transform(listed, lambda s: s["__p"]), "\n\n")
    return t.groupBy(key).agg(X.collapse_ends(body).alias("formatted"))


def hashed_token(w: Column, vocab: int) -> Column:
    """Token id 1..vocab-1 from the first 32 bits of md5; 0 is padding."""
    return (F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("bigint") % (vocab - 1) + 1).cast("int")


def tokenize_pad(
    df: DataFrame, text: str, max_length: int = 128, vocab: int = 32000, tokenizer: Callable[[Column], Column] | None = None,
    truncate: bool = False,
) -> DataFrame:
    """Padded input ids, labels (a copy) and attention mask, one row for each piece of `max_length` ids.

    `piece` counts the consecutive pieces of a text from 0; an empty text gives one piece of padding. `truncate` keeps
    only the first piece, without the column.
    `tokenizer` maps a text column to ARRAY<INT>; the default hashes words. A trained tokenizer
    goes in as a pandas_udf column.
    """
    if tokenizer is None:
        words = X.words(text)
        ids = F.transform(F.slice(words, 1, max_length) if truncate else words, lambda w: hashed_token(w, vocab))
    else:
        ids = F.slice(tokenizer(F.col(text)), 1, max_length) if truncate else tokenizer(F.col(text))
    d = df.withColumn("__ids", ids)
    if not truncate:
        last = F.greatest(F.ceil(F.size("__ids") / max_length) - 1, F.lit(0)).cast("int")
        parts = F.transform(F.sequence(F.lit(0), last), lambda i: F.slice("__ids", i * max_length + 1, max_length))
        d = d.select("*", F.posexplode(parts).alias("piece", "__part")).withColumn("__ids", F.col("__part")).drop("__part")
    pad = F.array_repeat(F.lit(0), F.lit(max_length) - F.size("__ids"))
    mask = F.concat(F.array_repeat(F.lit(1), F.size("__ids")), pad)
    full = F.concat("__ids", pad)
    return d.withColumns({"input_ids": full, "attention_mask": mask, "labels": full}).drop("__ids")
