"""Text that was read from images: lines cleaned and joined, numbers found."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as tx

# Words that are often misread, words that matter in short lines, marks around words, and numbers.
MISREAD = [("ecucarachas", "cucarachas"), ("Ecucarachas", "Cucarachas"), ("desagiies", "desagües"), ("Desagiies", "Desagües")]
IMPORTANT = ["cucaracha", "chinche", "raton"]
MARKS = r"""[ \t.,;:!?()\[\]{}"']"""
NUMBER = r"(?:\+?[0-9][0-9\s().-]{2,}[0-9]|\b[0-9]{3,}\b)"


def _bare(x: Column) -> Column:
    return F.regexp_replace(x, f"^{MARKS}+|{MARKS}+$", "")


def _important(x: Column) -> Column:
    return tx.contains_any(F.translate(F.lower(x), "áéíóúü", "aeiouu"), IMPORTANT)


#: What the steps before the words change in a line, all of it and a little more.
ROUGH = r"[\u200b\u200c\u200d\ufeff\t\n\f\r\x0B/\\|\p{Zs}&&[^ ]]|^ | $|(?:^| )[^\p{L}\p{N}+@#%$]|[,.;:!?][A-Za-zÁÉÍÓÚÑáéíóúñ]|[=-][=-]"
#: Marks where a word begins or ends.
WORD_MARKS = r"[.,;:!?()\[\]{}\"'](?:(?<!\S.)[.,;:!?()\[\]{}\"']*+|[.,;:!?()\[\]{}\"']*+(?=[\x85\u2028\u2029]?(?!\S)))"


def _smooth(line: Column) -> Column:
    x = F.trim(F.regexp_replace(F.regexp_replace(line, r"[\u200b\u200c\u200d\ufeff]", ""), r"[\t\f\x0B\p{Zs}]+", " "))
    x = F.regexp_replace(F.regexp_replace(x, r"[|/\\]+", " "), r"(^|\s)[^\p{L}\p{N}+@#%$]{1,2}(\s|$)", " ")
    x = F.regexp_replace(F.regexp_replace(x, r"\s+([,.;:!?])", "$1"), r"([,.;:!?])([A-Za-zÁÉÍÓÚÑáéíóúñ])", "$1 $2")
    return F.regexp_replace(x, r"\s*[=-]{2,}\s*", " ")


def clean_line(line: Column) -> Column:
    """Without stray symbols, marks around words, and words under three characters that have no digit."""
    x = tx.let(line, lambda x: F.when(x.rlike(ROUGH), _smooth(x)).otherwise(x))
    words = F.split(F.regexp_replace(_bare(x), WORD_MARKS, ""), r"\s+")
    return F.array_join(F.filter(words, lambda w: (F.length(w) >= 3) | w.rlike("[0-9]")), " ")


def _stub(line: Column) -> Column:
    """Up to two words of four letters or fewer, or without a vowel."""
    letters = F.regexp_replace(line, r"[^\p{L}]", "")
    return (F.size(F.split(line, " ")) <= 2) & ((F.length(letters) <= 4) | ~letters.rlike("(?i)[aeiouáéíóúüÁÉÍÓÚÜ]"))


def image_text(text: Column) -> Column:
    """Lines cleaned and joined, a hyphenated word put together, a short line with an important
    word on its own; a first or last line that is no word goes. Null stays null."""
    read = text
    for wrong, right in MISREAD:
        read = F.replace(read, F.lit(wrong), F.lit(right))

    def kept(lines: Column) -> Column:
        ends = F.transform(lines, lambda x, i: F.struct(clean_line(x).alias("t"), ((i == 0) | (i == F.size(lines) - 1)).alias("end")))
        good = F.filter(ends, lambda x: (x["t"] != "") & (((F.length(x["t"]) > 1) & ~(x["end"] & _stub(x["t"]))) | x["t"].rlike("[0-9]") | _important(x["t"])))
        return F.transform(good, lambda x: x["t"])

    def glued(lines: Column) -> Column:
        def part(x: Column, i: Column) -> Column:
            after = F.get(lines, i + 1)
            new = ~after.rlike("^(?:[^ ]* ){4}") & _important(after)
            joins = x.endswith("-") & after.rlike(r"^\p{L}")
            spaced = x.rlike(r"[\p{L}\p{N}]$") & after.rlike(r"^[\p{L}\p{N}]")
            return F.when(after.isNull(), x).when(new, F.concat(x, F.lit("\n"))).when(joins, F.regexp_replace(x, " *-$", "")).when(spaced, F.concat(x, F.lit(" "))).otherwise(x)

        return F.array_join(F.transform(lines, part), "")

    lines = tx.let(F.split(F.regexp_replace(read, r"\r\n?", "\n"), "\n"), kept)
    return tx.clean_text(tx.let(lines, glued))


def numbers(text: Column) -> Column:
    """Numbers of three digits or more as they are written, each once."""
    found = F.regexp_extract_all(text, F.lit(tx.ascii_boundary(NUMBER)), F.lit(0))
    found = F.transform(found, lambda x: F.trim(F.regexp_replace(x, r"[\t\f\x0B\p{Zs}]+", " ")))
    return F.array_distinct(F.filter(found, lambda x: F.length(F.regexp_replace(x, "[^0-9]", "")) >= 3))
