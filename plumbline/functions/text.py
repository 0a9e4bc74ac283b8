"""Column builders over text. All run inside the JVM."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the characters Python's str.split() and \s take as whitespace. Spelled out because
# Java's \s is ASCII only and its Unicode mode both differs (U+001C..U+001F) and is slow.
SPACE = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WS = f"[{SPACE}]+"
INK = f"[^{SPACE}]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and use it in `body`. Lambdas of array functions would otherwise
    evaluate an outer expression again for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column | str) -> Column:
    return F.filter(F.split(col(text), WS), lambda w: w != "")


def word_count(text: Column | str) -> Column:
    return F.size(words(text))


def word_set(text: Column | str, stop: Sequence[str] = ()) -> Column:
    s = F.array_distinct(words(F.lower(col(text))))
    return F.array_except(s, F.array(*[F.lit(w) for w in stop])) if stop else s


def word_overlap(a: Column | str, b: Column | str, stop: Sequence[str] = ()) -> Column:
    return F.size(F.array_intersect(word_set(a, stop), word_set(b, stop)))


def any_phrase(text: Column, phrases: Sequence[str]) -> Column:
    hit = F.lit(False)
    for p in phrases:
        hit = hit | text.contains(p)
    return hit


def count_phrases(text: Column, phrases: Sequence[str]) -> Column:
    """How many of the listed substrings occur (each counts once)."""
    n = F.lit(0)
    for p in phrases:
        n = n + text.contains(p).cast("int")
    return n


def ngrams(ws: Column, n: int) -> Column:
    """Consecutive n-grams joined by a space; zipped shifts keep it linear in the word count."""

    def build(w: Column) -> Column:
        span = F.greatest(F.size(w) - (n - 1), F.lit(0))
        out = F.slice(w, F.lit(1), span)
        for i in range(2, n + 1):
            out = F.zip_with(out, F.slice(w, F.lit(i), span), lambda a, b: F.concat(a, F.lit(" "), b))
        return out

    return let(ws, build)


def collapse_space(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, WS, " "), "^ | $", "")


def glob_to_regex(pattern: str) -> str:
    """fnmatch-style glob as an anchored Java regex; resolved while the plan is built."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and "]" in pattern[i + 2 :]:
            j = pattern.index("]", i + 2)
            body = pattern[i + 1 : j].replace("\\", "\\\\")
            out.append("[" + ("^" + body[1:] if body.startswith("!") else body) + "]")
            i = j
        else:
            out.append("\\" + c if not (c.isalnum() or c == "_") else c)
        i += 1
    return "(?s)^" + "".join(out) + "$"


def glob_match(text: Column | str, pattern: str) -> Column:
    return F.lit(True) if pattern == "*" else col(text).rlike(glob_to_regex(pattern))


def fixed(num: Column, digits: int) -> Column:
    """Fixed-point text rounded on the exact binary value (printf in the JVM rounds its decimal form)."""
    return F.regexp_replace(F.format_number(num.cast("double"), digits), ",", "")


def format_number(num: Column, precision: int = 2) -> Column:
    out, scaled = None, num.cast("double")
    for unit in ("", "K", "M", "B", "T"):
        text = F.concat(fixed(scaled, precision), F.lit(unit))
        out = F.when(F.abs(scaled) < 1000.0, text) if out is None else out.when(F.abs(scaled) < 1000.0, text)
        scaled = scaled / 1000.0
    return out.otherwise(F.concat(fixed(scaled, precision), F.lit("T")))


def format_time(seconds: Column) -> Column:
    s = seconds.cast("double")
    h = F.floor(s / 3600)
    m = F.floor(s / 60)
    sec = F.floor(s - m * 60)
    return (
        F.when(s < 60, F.concat(fixed(s, 1), F.lit("s")))
        .when(s < 3600, F.format_string("%dm %ds", m, sec))
        .otherwise(F.format_string("%dh %dm %ds", h, m - h * 60, sec))
    )


def collapse_ends(text: Column) -> Column:
    """Python's str.strip(): Unicode whitespace off both ends."""
    return F.regexp_replace(text, f"^{WS}|{WS}$", "")
