"""Letters without their marks: the canonical decomposition of all of Unicode, as expressions."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable
from functools import cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of Unicode: Hangul syllables are numbered by their first, middle and last letters.
HANGUL, FIRST, MIDDLE, LAST = 0xAC00, 0x1100, 0x1161, 0x11A7
FIRSTS, MIDDLES, LASTS = 19, 21, 28


def bare(text: str) -> str:
    """`text` decomposed, without marks that take no space."""
    return "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn")


@cache
def tables() -> tuple[str, str, dict[str, str]]:
    """Characters that become one other, what they become, and those that become several; by the rule of
    `bare` over all code points. Marks and Hangul are told by ranges instead."""
    one, to, more = [], [], {}
    for c in map(chr, (*range(0xD800), *range(0xE000, sys.maxunicode + 1))):
        if c.isascii() or HANGUL <= ord(c) < HANGUL + FIRSTS * MIDDLES * LASTS:
            continue
        b = bare(c)
        if b != c and len(b) == 1:
            one.append(c)
            to.append(b)
        elif b != c and b:
            more[c] = b
    return "".join(one), "".join(to), more


def _letter(place: Column, start: int, count: int) -> Column:
    return F.element_at(F.array(*[F.lit(chr(start + k)) for k in range(count)]), (place + 1).cast("int"))


def _jamo(text: Column) -> Column:
    """Hangul syllables as their letters."""

    def letters(c: Column) -> Column:
        n = F.ascii(c) - HANGUL
        last = n % LASTS
        syllable = F.concat(
            _letter(F.floor(n / (MIDDLES * LASTS)), FIRST, FIRSTS), _letter(F.floor(n / LASTS) % MIDDLES, MIDDLE, MIDDLES), F.when(last == 0, "").otherwise(_letter(last, LAST, LASTS))
        )
        return F.when(n.between(0, FIRSTS * MIDDLES * LASTS - 1), syllable).otherwise(c)

    return F.array_join(F.transform(F.split(text, ""), letters), "")


#: What only texts with letters of other scripts hold: tested before anything is translated.
_NOT_ASCII = r"[^\x00-\x7f]"


@cache
def _several() -> str:
    """A pattern of the letters that become several. Java tries the members of a class one by one, so
    the range they lie in is told first: most characters cost one comparison."""
    codes = sorted(map(ord, tables()[2]))
    runs = [f"\\x{{{c:x}}}" for c in codes]
    return f"[\\x{{{codes[0]:x}}}-\\x{{{codes[-1]:x}}}&&[{''.join(runs)}]]"


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is evaluated once a row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def without_marks(text: Column) -> Column:
    """The canonical decomposition of `text` without marks that take no space. Plain ASCII stays as it
    is; the rest is one translation, and rare letters that become several are replaced only in texts
    that hold them. Each step is evaluated once, however many steps read it."""
    one, to, more = tables()

    def several(x: Column) -> Column:
        return F.when(x.rlike(_several()), reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(more[c])), more, x)).otherwise(x)

    def syllables(x: Column) -> Column:
        return F.when(x.rlike("[\uac00-\ud7a3]"), _jamo(x)).otherwise(x)

    def folded(x: Column) -> Column:
        return F.regexp_replace(_once(_once(F.translate(x, one, to), several), syllables), r"\p{Mn}+", "")

    return _once(text, lambda x: F.when(x.rlike(_NOT_ASCII), folded(x)).otherwise(x))
