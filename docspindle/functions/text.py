"""Text expressions on columns: normalisation, terms, matching, quality, cleaning, redaction."""

from __future__ import annotations

from functools import reduce

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import lexicon as lx
from .unicode import without_marks


def once(df: DataFrame, **cols: Column) -> DataFrame:
    """`df` with `cols`, each evaluated once a row: as rows of a generator they are neither
    repeated in the expressions that read them nor in filters that move below them."""
    rest = [c for c in df.columns if c not in cols]
    return df.select(*rest, F.inline(F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is evaluated once, however often `use` reads it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def norm(text: Column) -> Column:
    """Lower case without accents (of any letter), runs of other than letters and digits as one space."""
    return F.trim(F.regexp_replace(without_marks(F.lower(F.trim(text))), r"[^\p{L}\p{N}]+", " "))


def tokens(normalised: Column) -> Column:
    return F.array_remove(F.split(normalised, " "), "")


def may_hold(text: Column, parts: list[str]) -> Column:
    """Whether `text`, normalised, may hold one of `parts`, each normalised and one word: plain ASCII
    tells in lower case, other letters only once they are normalised. Null for null."""
    return (F.octet_length(text) > F.length(text)) | let(F.lower(text), lambda low: contains_any(low, parts))


def searched(text: Column) -> Column:
    """Text that holds the same ASCII letters and digits next to each other as `norm` of `text`, to look for
    parts of one word in: in lower case, and after it its words with other letters without their accents.
    Accents are taken off by the letter, so the words without other letters need not pass through that."""
    def with_folded(low: Column) -> Column:
        words = F.filter(F.split(low, " "), lambda w: F.octet_length(w) > F.length(w))
        return F.when(F.octet_length(low) > F.length(low), F.concat(low, F.lit(" "), without_marks(F.array_join(words, " ")))).otherwise(low)

    return let(F.lower(text), with_folded)


def terms(normalised: Column) -> Column:
    """Distinct words of two characters or more that aren't stop words, as they come."""
    return F.array_distinct(F.filter(F.split(normalised, " "), lambda w: (F.length(w) >= 2) & ~w.isin(*lx.STOP_WORDS)))


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def total(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts, F.lit(0.0))


def contains_any(text: Column, parts: list[str]) -> Column:
    return any_of([text.contains(p) for p in parts])


def whole_count(words: Column, term: str) -> Column:
    """How many of the words equal `term`."""
    return F.size(F.filter(words, lambda w: w == term))


def fuzzy_count(words: Column, term: str) -> Column:
    """Words of five characters or more within one edit of `term`, two for terms of nine."""
    if len(term) < 5:
        return F.lit(0)
    limit = 2 if len(term) >= 9 else 1
    return F.size(F.filter(words, lambda w: (F.length(w) >= 5) & (F.levenshtein(w, F.lit(term), limit) >= 0)))


def partial_match(words: Column, term: str) -> Column:
    """Whether a word begins like `term`, holds it, or (from five characters) lies in it."""
    head = min(len(term) - 1, 7)
    if len(term) < 5 or head < 4:
        return F.lit(False)
    return F.exists(words, lambda w: w.startswith(term[:head]) | w.contains(term) | ((F.length(w) >= 5) & F.lit(term).contains(w)))


def jaccard(a: Column, b: Column) -> Column:
    def share(x: Column) -> Column:
        n = F.size(x["a"]) + F.size(x["b"])
        return F.when((F.size(x["a"]) == 0) | (F.size(x["b"]) == 0), 0.0).otherwise(let(F.size(F.array_intersect(x["a"], x["b"])), lambda both: both / (n - both)))

    return let(F.struct(a.alias("a"), b.alias("b")), share)


def definition_like(normalised: Column, words: list[str]) -> Column:
    return any_of([normalised.contains(w + x) for w in words for x in lx.DEFINITION_AFTER] + [normalised.contains(x + w) for w in words for x in lx.DEFINITION_BEFORE])


def quality(text: Column) -> Column:
    """0 to 100: the share of good words, less penalties, all in whole numbers."""
    def score(bare: Column) -> Column:
        n = F.size(bare)

        def count(test) -> Column:
            return F.size(F.filter(bare, test))

        def letter(w: Column) -> Column:
            return w.rlike(r"\p{L}")

        def lower(w: Column) -> Column:
            return (w == F.lower(w)) & letter(w)

        good = count(lambda w: (F.length(w) >= 3) & letter(w))
        short = count(lambda w: (F.length(w) <= 2) & lower(w))
        endless = count(lambda w: (F.length(w) >= 18) & lower(w))
        joined = F.array_join(bare, "")
        letters, runes = F.length(F.regexp_replace(joined, r"[^\p{L}]+", "")), F.length(joined)
        few = F.when((runes > 0) & (F.floor(letters * 100 / runes) < 55), 15).otherwise(0)
        return F.greatest(F.lit(0), F.least(F.lit(100), F.floor(good * 100 / n) - F.floor(short * 35 / n) - endless * 3 - few))

    words = F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")
    marks = r"""[.,;:!?()\[\]{}"']"""
    # Few words have marks at their ends; the others are bare as they are.
    bare = F.transform(words, lambda w: F.when(w.rlike(f"^{marks}|{marks}$"), F.regexp_replace(w, f"^{marks}+|{marks}+$", "")).otherwise(w))
    return F.when(F.coalesce(F.trim(text), F.lit("")) == "", 0).otherwise(let(bare, score)).cast("int")


#: What `clean_line` changes in a line, all of it; most lines of prose hold none.
ROUGH = r"[\u200b\u200c\u200d\ufeff\t\n\f\r\x0B/\\|\p{Zs}&&[^ ]]|^ | $| [ ,.;:!?)]|[,.;:!?][A-Za-zÁÉÍÓÚÑáéíóúñ]|\( |[=-][=-]"


def clean_line(line: Column) -> Column:
    """One space between words, none before and one after punctuation, tight brackets, room around bars and rules."""
    return let(line, lambda x: F.when(x.rlike(ROUGH), _cleaned(x)).otherwise(x))


def _cleaned(line: Column) -> Column:
    line = F.regexp_replace(line, "[​‌‍﻿]", "")
    steps = [
        (r"[\t\f\x0B\p{Zs}]+", " "), (r"^ +| +$", ""), (r"[ \t\n\f\r]+([,.;:!?])", "$1"), (r"([,.;:!?])([A-Za-zÁÉÍÓÚÑáéíóúñ])", "$1 $2"),
        (r"\([ \t\n\f\r]+", "("), (r"[ \t\n\f\r]+\)", ")"), (r"[ \t\n\f\r]*([/\\|])[ \t\n\f\r]*", " $1 "), (r"[ \t\n\f\r]*([=-]{2,})[ \t\n\f\r]*", " $1 "), (r"[\t\f\x0B\p{Zs}]+", " "),
    ]
    return F.trim(reduce(lambda x, s: F.regexp_replace(x, *s), steps, line))


def clean_text(text: Column) -> Column:
    lines = F.split(F.regexp_replace(text, r"\r\n?", "\n"), "\n")
    return F.regexp_replace(F.regexp_replace(F.array_join(F.transform(lines, clean_line), "\n"), r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def ascii_boundary(pattern: str) -> str:
    """Java's \\b knows all letters; these are the boundaries of ASCII words."""
    edge = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
    return pattern.replace(r"\b", edge).replace("(?im)", "(?imd)")


def redacted(text: Column) -> Column:
    """struct(text, n): the text without secrets, and how many were replaced; each pattern
    sees what the ones before left. A pattern is tried where the text holds a part it needs."""
    def step(p: str, parts: list[str]) -> Callable[[Column, Column], Column]:
        def one(x: Column, low: Column) -> Column:
            found = let(F.regexp_count(x["text"], F.lit(p)), lambda n: F.when(n > 0, F.struct(F.regexp_replace(x["text"], p, lx.REDACTED).alias("text"), (x["n"] + n).alias("n"))).otherwise(x))
            return F.when(contains_any(low, parts), found).otherwise(x) if parts else found

        return one

    steps = [step(ascii_boundary(p), parts) for p, parts in zip(lx.SECRET_PATTERNS, lx.SECRET_PARTS, strict=True)]

    def chain(text: Column, low: Column) -> Column:
        # Spark counts a function's parameters, so each step is bound to its own.
        def bound(one) -> Callable[[Column], Column]:
            return lambda x: one(x, low)

        return reduce(lambda out, one: let(out, bound(one)), steps, F.struct(text.alias("text"), F.lit(0).alias("n")))

    def whole(t: Column) -> Column:
        return F.when(F.trim(t) == "", F.struct(t.alias("text"), F.lit(0).alias("n"))).otherwise(let(F.lower(t), lambda low: chain(t, low)))

    return let(text, whole)


def redact(text: Column) -> tuple[Column, Column]:
    """The text without secrets, and how many were replaced, as two columns; `redacted` gives both at once."""
    both = redacted(text)
    return both["text"], both["n"]


def has_credentials(text: Column, normalised: Column | None = None) -> Column:
    phrases = let(norm(text) if normalised is None else normalised, lambda n: contains_any(n, lx.CREDENTIAL_PHRASES))
    named = let(F.lower(text), lambda low: contains_any(low, lx.CREDENTIAL_PARTS)) & text.rlike(ascii_boundary(lx.CREDENTIAL_PATTERN))
    return named | text.contains(lx.REDACTED) | phrases


def content_type(normalised: Column) -> Column:
    """technical, table or narrative, by words of the normalised text."""
    def kind(padded: Column) -> Column:
        def words(names: list[str]) -> Column:
            return contains_any(padded, [f" {w} " for w in names])

        technical = words(lx.TECHNICAL_WORDS) | contains_any(padded, lx.TECHNICAL_PARTS)
        return F.when(technical, "technical").when(words(lx.TABLE_WORDS), "table").otherwise("narrative")

    return let(F.concat(F.lit(" "), normalised, F.lit(" ")), kind)


# Line classifiers

def bullet(line: Column) -> Column:
    t = F.trim(line)
    return t.rlike(r"^(?:[-*•·] )|^[)\].]*[+-]?[0-9]{1,18}[)\].]*(?:\s|$)|^[A-Za-z]\)(?:\s|$)")


def section_number(word: Column) -> Column:
    return F.regexp_replace(word, r"^[.)]+|[.)]+$", "").rlike(r"^[+-]?[0-9]{1,18}(?:\.(?:[+-]?[0-9]{1,18})?){0,3}$")


def heading(line: Column) -> Column:
    """Up to 120 characters and 12 words, no closing mark, no bullet; numbered, in capitals or in title case."""
    t = F.trim(line)
    words = F.filter(F.split(t, r"\s+"), lambda w: w != "")
    bare = F.transform(words, lambda w: F.regexp_replace(w, r"^[\[\](){}:.\-]+|[\[\](){}:.\-]+$", ""))
    upper = F.size(F.filter(bare, lambda w: (w == F.upper(w)) & w.rlike(r"\p{L}")))
    title = F.size(F.filter(bare, lambda w: w.rlike(r"^\p{Lu}")))
    n = F.size(words)
    fits = (t != "") & (F.length(t) <= 120) & ~t.rlike(r"[.,;]$") & ~bullet(t) & (n >= 1) & (n <= 12)
    return fits & (section_number(F.element_at(words, 1)) | (upper == n) | ((n <= 8) & (title >= n - 1)))


def upper_ratio(text: Column) -> Column:
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    return F.when(letters == 0, 0.0).otherwise(F.length(F.regexp_replace(text, r"[^\p{Lu}]", "")) / letters)


def cosine(a: Column, b: Column) -> Column:
    """0 for empty vectors, vectors of different lengths, and zero norms."""
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, p: s + p)

    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == 0) | (F.size(a) != F.size(b)) | (size == 0), 0.0).otherwise(dot(a, b) / size)


def locale_number(text: Column) -> Column:
    """A lone mark before exactly three digits groups thousands; a lone comma else is
    decimal; with both marks the last is the decimal one; currency signs go; null if none."""
    def plain(t: Column) -> Column:
        dots, commas = F.length(F.regexp_replace(t, r"[^.]", "")), F.length(F.regexp_replace(t, r"[^,]", ""))
        three = t.rlike(r"^[^.,]*[.,][^.,]{3}$")
        alone = F.when(three, F.regexp_replace(t, r"[.,]", "")).otherwise(F.regexp_replace(t, ",", "."))
        last_comma = t.rlike(r",[^.]*$")
        mixed = F.when(last_comma, F.regexp_replace(F.regexp_replace(t, r"\.", ""), ",", ".")).otherwise(F.regexp_replace(t, ",", ""))
        return F.when((dots > 0) & (commas > 0), mixed).when(dots + commas == 1, alone).otherwise(t)

    bare = F.regexp_replace(F.regexp_replace(F.trim(text), r"^[$€£ ]+|[$€£ ]+$", ""), " ", "")
    return let(let(bare, plain), lambda p: F.when(p.rlike(r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)$"), p.try_cast("double")))


def format_number(x: Column) -> Column:
    return F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(F.format_string("%.2f", x))


def row_pairs(body: Column) -> Column:
    """`k = v` pairs of a row, between bars or else commas, as a map with normalised keys; the last of equals wins."""
    parts = F.when(body.contains("|"), F.split(body, r"\|")).otherwise(F.split(body, ","))
    pairs = F.filter(parts, lambda p: p.contains("="))
    entries = F.transform(pairs, lambda p: F.struct(norm(F.substring_index(p, "=", 1)).alias("k"), F.trim(F.regexp_replace(p, r"^[^=]*=", "")).alias("v")))
    entries = F.filter(entries, lambda e: (e["k"] != "") & (e["v"] != ""))

    def last(all_: Column) -> Column:
        return F.filter(all_, lambda e, i: ~F.exists(F.slice(all_, i + 2, F.size(all_)), lambda x: x["k"] == e["k"]))

    return F.map_from_entries(let(entries, last))


def sentences(text: Column, marks: str = r"(?<=[.!?;])") -> Column:
    return F.filter(F.transform(F.split(text, marks), lambda x: F.trim(x)), lambda s: s != "")


def tag(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), "^#+", ""), r"\s+", "-")


def snippet(text: Column, index: Column, size: int = lx.SNIPPET) -> Column:
    """`size` characters from a third before `index` (from 0), marked where they are cut."""
    t = F.trim(text)
    n = F.length(t)
    start = F.greatest(F.lit(0), F.least(F.greatest(index - size // 3, F.lit(0)), n - size))
    body = F.trim(F.substring(t, start + 1, F.lit(size)))
    cut = F.concat(F.when(start > 0, "...").otherwise(""), body, F.when(start + size < n, "...").otherwise(""))
    return F.when(n <= size, t).otherwise(cut)


def long_paragraph(text: Column, least: int = 45) -> Column:
    """Whether a paragraph between blank lines has so many words."""
    parts = F.split(F.regexp_replace(text, "\r\n", "\n"), "\n\n")
    return F.exists(parts, lambda p: F.size(F.filter(F.split(p, r"\s+"), lambda w: w != "")) >= least)


def spreadsheet_like(text: Column) -> Column:
    """Whether a line begins as those of a spreadsheet's chunk do."""
    return text.rlike(r"(?m)^\s*(?:Columnas:|Total de filas de datos:)")


def word_windows(words: Column, least: int, most: int) -> Column:
    """Runs of `least` to `most` words, shorter ones first, each size in order; a run is the
    shorter one that begins with it and a word more."""
    def longer(w: Column, runs: Column, n: int) -> Column:
        return F.transform(F.slice(runs, F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(0))), lambda x, i: F.concat(x, F.lit(" "), F.get(w, i + (n - 1))))

    def sizes(w: Column, runs: Column, n: int, found: list[Column]) -> Column:
        found = [*found, runs] if n >= least else found
        if n == most:
            return F.flatten(F.array(*found))
        return let(longer(w, runs, n + 1), lambda more: sizes(w, more, n + 1, found))

    return let(words, lambda w: sizes(w, w, 1, []))


def _titled(text: str) -> str:
    return " ".join(w[:1].upper() + w[1:] for w in text.split(" "))


def joined_pairs(pairs: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Each pair as it is and with capitals."""
    return [p for a, b in pairs for p in ((a, b), (_titled(a), _titled(b)))]


def parted(text: Column) -> Column:
    """With joined words parted: fixed phrases, number words next to each other, common words."""
    def replaced(x: Column, pairs: list[tuple[str, str]]) -> Column:
        return reduce(lambda y, p: F.replace(y, F.lit(p[0]), F.lit(p[1])), joined_pairs(pairs), x)

    numbers = "|".join(lx.NUMBER_WORDS)
    out = replaced(text, lx.JOINED)
    out = F.regexp_replace(out, f"({numbers})y(?={numbers})", "$1 y ")
    out = F.regexp_replace(out, f"({numbers})(?={numbers})", "$1 ")
    return F.trim(F.regexp_replace(replaced(out, lx.JOINED_COMMON), r"\s+", " "))


def clean_sentence(text: Column) -> Column:
    """An extracted sentence as it is shown: no marks or headings before it, words parted, a capital first."""
    def bare(x: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(x, lx.LEADING_MARKS, ""), lx.LEADING_HEADING, "")

    spaced = F.regexp_replace(F.replace(F.regexp_replace(bare(F.trim(text)), r"\s+", " "), F.lit(","), F.lit(", ")), r"\s+", " ")
    cut = F.regexp_replace(bare(parted(spaced)), "^[ .,;:¿?¡!]+|[ .,;:¿?¡!]+$", "")
    return let(cut, lambda x: F.concat(F.upper(F.left(x, F.lit(1))), F.substring(x, F.lit(2), F.length(x))))
