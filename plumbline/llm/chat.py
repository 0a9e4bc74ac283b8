"""Chat formatting by schema fingerprints.

A record is JSON. The hash of its nested field paths, as far as any layout knows them, selects a declarative mapping that
turns prompt, instruction and message layouts into canonical turns (role, text). The template then writes

    ### role
    text
    </turn>

per turn. A backslash goes before every `###` and `</turn>` inside a text and comes off again on reading, so any text
survives, also one that already holds escaped control strings. The loss mask is a list of (start, stop) code points of
the assistant texts in the formatted string.
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass
from itertools import combinations

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import map_arrow

CONTROL = re.compile(r"###|</turn>")
LONE = re.compile("[\ud800-\udfff]")
ESCAPED = re.compile(r"\\(###|</turn>)")
END = "\n</turn>\n"
#: Names of the three roles in common layouts.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


@dataclass(frozen=True)
class Layout:
    """`each`: (list path, role field, text field), or `fields`: (role, field names whose texts are joined by blank lines)."""

    name: str
    each: tuple[str, str, str] | None = None
    fields: tuple[tuple[str, tuple[str, ...]], ...] = ()
    optional: tuple[str, ...] = ()

    def paths(self) -> list[frozenset[str]]:
        """Every set of field paths that this layout covers."""
        if self.each:
            at, role, text = self.each
            return [frozenset({at, f"{at}[].{role}", f"{at}[].{text}"}), frozenset({at})]
        names = {f for _, fs in self.fields for f in fs}
        return [frozenset(names - set(out)) for n in range(len(self.optional) + 1) for out in combinations(self.optional, n)]


LAYOUTS = (
    Layout("turns", ("turns", "role", "text")),
    Layout("messages", ("messages", "role", "content")),
    Layout("conversations", ("conversations", "from", "value")),
    Layout("instruction", fields=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",))), optional=("system", "input")),
    Layout("prompt", fields=(("system", ("system_prompt",)), ("user", ("prompt",)), ("assistant", ("completion",))), optional=("system_prompt",)),
    Layout("reply", fields=(("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("question", fields=(("user", ("question",)), ("assistant", ("answer",)))),
)


def field_paths(value, at: str = "") -> set[str]:
    """Nested field paths; list items share one path."""
    if isinstance(value, dict):
        out = set()
        for k, v in value.items():
            p = f"{at}.{k}" if at else str(k)
            out |= {p} | field_paths(v, p)
        return out
    if isinstance(value, list):
        return set().union(*(field_paths(v, f"{at}[]") for v in value)) if value else set()
    return set()


def fingerprint(paths) -> int:
    return xxhash.xxh3_64_intdigest("\n".join(sorted(paths)))


_KNOWN = frozenset(p for x in LAYOUTS for s in x.paths() for p in s)
_BY_PRINT = {fingerprint(s): x for x in LAYOUTS for s in x.paths()}


def _text(value) -> str:
    """A field as text: other values than strings as JSON; halves of surrogate pairs, which no text can hold, as U+FFFD."""
    text = value if isinstance(value, str) else "" if value is None else json.dumps(value, ensure_ascii=False)
    return LONE.sub("\ufffd", text)


def canonical(record: str | None) -> tuple[str | None, list[tuple[str, str]]]:
    """(layout name, turns); no layout and no turns for what isn't JSON, is nested too deeply to read or matches no layout."""
    try:
        return _canonical(json.loads(record or ""))
    except (ValueError, RecursionError):
        return None, []


def _canonical(value) -> tuple[str | None, list[tuple[str, str]]]:
    layout = _BY_PRINT.get(fingerprint(field_paths(value) & _KNOWN)) if isinstance(value, dict) else None
    if layout is None:
        return None, []
    if layout.each:
        at, role, text = layout.each
        items = [x for x in value.get(at) or [] if isinstance(x, dict)]
        return layout.name, [(ROLES.get(_text(x.get(role)), _text(x.get(role))), _text(x.get(text))) for x in items]
    turns = [(role, "\n\n".join(t for f in names if (t := _text(value.get(f))))) for role, names in layout.fields if any(f in value for f in names)]
    return layout.name, turns


def render(turns: list[tuple[str, str]]) -> tuple[str, list[int]]:
    """The formatted string and the loss mask: start and stop of each assistant text, flat."""
    parts, mask, at = [], [], 0
    for role, text in turns:
        head, body = f"### {role.replace(chr(92), chr(92) * 2).replace(chr(10), chr(92) + 'n')}\n", CONTROL.sub(r"\\\g<0>", text)
        if role == "assistant":
            mask += [at + len(head), at + len(head) + len(body)]
        at += len(head) + len(body) + len(END)
        parts += [head, body, END]
    return "".join(parts), mask


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted string."""
    out, at = [], 0
    while at < len(formatted):
        line = formatted.index("\n", at)
        stop = formatted.index(END, line)
        role = re.sub(r"\\(\\|n)", lambda m: "\n" if m[1] == "n" else "\\", formatted[at + 4 : line])
        out.append((role, unescape(formatted[line + 1 : stop])))
        at = stop + len(END)
    return out


def format_chats(records: DataFrame, json_col: str = "record") -> DataFrame:
    """All columns of `records` plus layout, formatted, loss_mask; columns of these names are replaced.

    Null, broken and unknown records get a null layout, an empty string and an empty mask. A conversation is one training
    example and is formatted in one task.
    """
    records = records.drop(*[c for c in ("layout", "formatted", "loss_mask") if c != json_col])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, texts, masks = [], [], []
        for r in batch.column(json_col).to_pylist():
            name, turns = canonical(r)
            text, mask = render(turns)
            names.append(name)
            texts.append(text)
            masks.append(mask)
        new = [pa.array(names, pa.string()), pa.array(texts, pa.string()), pa.array(masks, pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, "layout", "formatted", "loss_mask"])

    kinds = records.select("*", *[F.lit(None).cast(t).alias(n) for n, t in (("layout", "string"), ("formatted", "string"), ("loss_mask", "array<long>"))]).schema
    return map_arrow(records, run, kinds)


def read_back(chats: DataFrame, id_col: str) -> DataFrame:
    """Digests of what the formatted strings and masks hold: turns, and the unescaped text under the mask."""
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text, mask in zip(batch.column("formatted").to_pylist(), batch.column("loss_mask").to_pylist()):
            turns = parse(text)
            loss = "".join(unescape(text[a:b]) for a, b in zip(mask[::2], mask[1::2]))
            rows.append((len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(text)))
        cols = list(zip(*rows)) if rows else [[]] * 5
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        names = [id_col, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        return pa.RecordBatch.from_arrays([batch.column(id_col), *[pa.array(c, k) for c, k in zip(cols, kinds)]], names=names)

    chats = chats.select(id_col, "formatted", "loss_mask")
    return map_arrow(chats, run, f"{id_col} {chats.schema[id_col].dataType.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def records_from_turns(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id, record): one JSON record per conversation, turns in order (null turns last, ties by role and text)."""
    turn = F.struct(F.col(turn_col).isNull().alias("late"), F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    turns = F.transform(F.sort_array(F.collect_list(turn)), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    return rows.groupBy(id_col).agg(F.to_json(F.struct(turns.alias("turns"))).alias("record"))
