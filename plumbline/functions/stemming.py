"""Porter's suffix stripping (1980), for lower-case ASCII words."""

from __future__ import annotations

# Suffix rules of the published algorithm, longest match first within a step.
STEP_2 = dict(
    ational="ate", tional="tion", enci="ence", anci="ance", izer="ize", abli="able", alli="al", entli="ent", eli="e", ousli="ous", ization="ize", ation="ate", ator="ate",
    alism="al", iveness="ive", fulness="ful", ousness="ous", aliti="al", iviti="ive", biliti="ble",
)
STEP_3 = dict(icate="ic", ative="", alize="al", iciti="ic", ical="ic", ful="", ness="")
STEP_4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _shape(word: str) -> str:
    """v or c per letter; y is a vowel after a consonant."""
    out = ""
    for i, c in enumerate(word):
        out += "v" if c in "aeiou" or (c == "y" and i and out[-1] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    """Number of vowel-consonant sequences."""
    return _shape(stem).count("vc")


def _short(stem: str) -> bool:
    """Ends consonant, vowel, consonant, the last not w, x or y."""
    return _shape(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


def _replaced(word: str, rules: dict[str, str], least: int) -> str:
    end = max((e for e in rules if word.endswith(e)), key=len, default=None)
    if end is not None and _measure(stem := word[: -len(end)]) > least:
        return stem + rules[end]
    return word


def porter_stem(word: str) -> str:
    """The stem of a word; words of one or two letters stay."""
    if len(word) < 3:
        return word
    if word.endswith("s"):  # plurals
        word = word[:-2] if word.endswith(("sses", "ies")) else word if word.endswith("ss") else word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) else word
    elif (end := next((e for e in ("ed", "ing") if word.endswith(e)), None)) and "v" in _shape(stem := word[: -len(end)]):
        if stem.endswith(("at", "bl", "iz")) or (_measure(stem) == 1 and _short(stem)):
            word = stem + "e"
        elif stem[-1:] == stem[-2:-1] and _shape(stem)[-1] == "c" and stem[-1] not in "lsz":
            word = stem[:-1]
        else:
            word = stem
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _replaced(_replaced(word, STEP_2, 0), STEP_3, 0)
    end = max((e for e in STEP_4 if word.endswith(e)), key=len, default=None)
    if end and _measure(stem := word[: -len(end)]) > 1 and (end != "ion" or stem.endswith(("s", "t"))):
        word = stem
    if word.endswith("e") and ((m := _measure(word[:-1])) > 1 or (m == 1 and not _short(word[:-1]))):
        word = word[:-1]
    return word[:-1] if word.endswith("ll") and _measure(word) > 1 else word
