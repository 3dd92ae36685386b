"""Numbers in words, and values in text."""

from __future__ import annotations

import re
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

# English number words and the powers of ten that magnitudes stand for.
SMALL = {w: n for n, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split())}
TENS = {w: 10 * n for n, w in enumerate("twenty thirty forty fifty sixty seventy eighty ninety".split(), 2)}
POWERS = {"thousand": 3, "million": 6, "billion": 9, "trillion": 12}
SHORT = {"k": 3, "m": 6, "b": 9, "t": 12, "mil": 6, "mln": 6, "mn": 6, "mm": 6, "bil": 9, "bn": 9, "tril": 12, "trn": 12, "tn": 12}

_WORD = "|".join([*SMALL, *TENS, *POWERS, "hundred"])
_PHRASE = re.compile(rf"(?<![A-Za-z])(?:a[ -](?=hundred|thousand|million|billion|trillion))?(?:{_WORD})(?:[ -](?:and[ -])?(?:{_WORD}|point))*(?![A-Za-z])(?:[ -](percent|per cent)(?![A-Za-z]))?", re.I)


def spelled(text: str) -> list[tuple[int, int, Decimal, int, int, bool]]:
    """(start, end, value, decimals, exponent, is percent) of numbers written in words.

    exponent is the power of the last magnitude word, decimals the digits after "point". A lone "one" is a pronoun.
    """
    out = []
    for m in _PHRASE.finditer(text):
        words = [(w[0].lower(), m.start() + w.start(), m.start() + w.end()) for w in re.finditer("[A-Za-z]+", m[0])]
        if m[1]:
            words = words[: -len(m[1].split())]
        for start, end, value, decimals, exponent, last in _runs(words):
            percent = bool(m[1]) and last
            out.append((start, m.end() if percent else end, value, decimals, exponent, percent))
    return out


def _runs(words: list[tuple[str, int, int]]) -> list[tuple[int, int, Decimal, int, int, bool]]:
    """A phrase's numbers: a word that can't continue the number before it begins a new one."""
    out, k = [], 0
    while k < len(words):
        total, group, fraction, exponent, ceiling = 0, None, "", 0, 99
        begin, used, open_tens = k, k, False
        while k < len(words):
            w = words[k][0]
            if w == "and" and group is not None:
                k += 1
                continue
            if w == "a" and group is None:
                group = 1
            elif w == "point" and group is not None and not fraction and k + 1 < len(words) and SMALL.get(words[k + 1][0], 10) < 10:
                k += 1
                while k < len(words) and SMALL.get(words[k][0], 10) < 10:
                    fraction += str(SMALL[words[k][0]])
                    k += 1
                used = k
                if k < len(words) and words[k][0] in POWERS:
                    exponent, k = POWERS[words[k][0]], k + 1
                    used = k
                break
            elif w == "hundred" and group is not None and 0 < group < 10:
                group, open_tens = group * 100, False
            elif w in POWERS and group is not None and POWERS[w] < ceiling:
                ceiling = exponent = POWERS[w]
                total, group, open_tens = total + group * 10**ceiling, None, False
            elif w in TENS and (group is None or group % 100 == 0 and group >= 100):
                group, open_tens = (group or 0) + TENS[w], True
            elif w in SMALL and (group is None or (open_tens and 0 < SMALL[w] < 10) or (group >= 100 and group % 100 == 0)):
                group, open_tens = (group or 0) + SMALL[w], False
            else:
                break
            k += 1
            used = k
        if used == begin:
            k = begin + 1
            continue
        k = used
        if fraction:
            value, decimals = Decimal(f"{group}.{fraction}") * Decimal(10) ** exponent, len(fraction)
        else:
            if group:  # what follows the last magnitude is stated to the unit
                total, exponent = total + group, 0
            value, decimals = Decimal(total), 0
        if not (used - begin == 1 and words[begin][0] == "one"):
            out.append((words[begin][1], words[used - 1][2], value, decimals, exponent, used == len(words)))
    return out


def shown(value: object) -> str:
    """A result's value as text: thousands separated, years as they are, floats without a needless .0."""
    if value is None:
        return ""
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, int):
        return str(value) if 1900 <= value <= 2099 else f"{value:,}"
    if isinstance(value, float | Decimal):
        if value == int(value):
            return shown(int(value))
        whole, _, rest = f"{value:f}".rstrip("0").partition(".")
        return f"{int(whole):,}.{rest}" if whole not in ("-0", "0") else f"{whole}.{rest}"
    return str(value)


def shown_number(value: Column) -> Column:
    """shown() of a column of numbers: six decimals at most, without needless zeros; NULL is empty."""
    whole = value == F.floor(value)
    year = whole & value.between(1900, 2099)
    parts = F.regexp_replace(F.regexp_replace(F.format_number(value, 6), "0+$", ""), "[.]$", "")
    return F.when(value.isNull(), "").when(year, value.cast("long").cast("string")).when(whole, F.format_number(value, 0)).otherwise(parts)


def as_text(columns: list[str], rows: list[tuple]) -> str:
    """A result as tab-separated text."""
    if not rows:
        return "(no rows)"
    return "\n".join("\t".join(r) for r in [list(columns), *([shown(v) for v in row] for row in rows)])
