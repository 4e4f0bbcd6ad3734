"""Text as it is shown: answers cleaned, headings and noise lines told apart, sources kept through redaction."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as lx
from . import text as tx

# Lines and phrases that answers don't show.
PARSER_LINE = r"(?i)^\s*(?:(?:Documento tipo:\s*Excel|Hoja:|Columnas:|Total de columnas:|Total de filas de datos:|Encabezados detectados:|Bloque de filas:)|Fila\s+\d+\s*:)"
NUMBER_LINE = r"^\s*(?:[-*]\s*)?\d+[.)]?\s*$"
TITLE_LINE = r"(?i)^\s*(?:respuesta del documento|(?:\d+[.)]\s*)?(?:punto clave|apartado|secci[oó]n)\s+\d+)\s*$"
FILLER_PHRASES = [
    "este elemento resulta\\s+relevante", "aporta contexto\\s+sustantivo", "permite\\s+conectar la información",
    "en términos\\s+documentales", "funciona como una pieza\\s+central", "en conjunto, estos elementos",
]
REFERENCE = r"\[(?:chunk_id|document_id)[^\]]*\]"

# Outlines and academic lines.
ROMAN, NUMERIC = r"(?i)^[ivxlcdm]+\s*[.):\-]\s+.+$", r"^\d+(?:\.\d+){0,3}\s*[.):\-]?\s+\S.+$"
BIBLIOGRAPHY = ["referencias", "fuentes", "bibliografia", "bibliografia consultada", "works cited"]
PUBLISHERS = ["editorial", "press", "springer", "pearson", "mcgraw", "routledge", "wiley", "university", "vol.", "doi", "pp."]
TEXTBOOKS = ["manual", "handbook", "textbook", "introduction", "fundamentos", "principios", "teoria", "theory", "course", "guide"]
RELEVANT = ["programacion", "programa", "algoritmo", "algoritmos", "arreglo", "arreglos", "estructura", "estructuras", "funcion", "funciones", "variable", "variables", "dato", "datos", "sistema", "proceso", "procesos", "modelo", "metodo", "metodos", "clase", "clases", "objeto", "objetos"]


def _words(line: Column) -> Column:
    return F.filter(F.split(F.trim(line), r"\s+"), lambda w: w != "")


def _lines(text: Column) -> Column:
    return F.transform(F.split(F.regexp_replace(text, "\r\n", "\n"), "\n"), lambda x: F.trim(x))


def summary_heading(line: Column) -> Column:
    """Roman or numeric, or short with a closing colon, or mostly capitals."""
    t = F.trim(line)
    n = F.size(_words(t))
    return (t != "") & (F.length(t) <= 90) & (t.rlike(ROMAN) | t.rlike(NUMERIC) | (t.endswith(":") & (F.length(t) <= 70) & (n <= 8)) | ((n >= 2) & (n <= 10) & (tx.upper_ratio(t) >= 0.8)))


def noisy_capitals(line: Column) -> Column:
    """Two to eight words, 85 % capitals or more."""
    n, letters, upper = F.size(_words(line)), F.length(F.regexp_replace(line, r"[^\p{L}]", "")), F.length(F.regexp_replace(line, r"[^\p{Lu}]", ""))
    return (n >= 2) & (n <= 8) & (letters > 0) & (F.floor(upper * 100 / F.greatest(letters, F.lit(1))) >= 85)


def without_noisy_capitals(text: Column) -> Column:
    return F.array_join(F.filter(_lines(text), lambda x: (x != "") & ~noisy_capitals(x)), " ")


def academic_noise(line: Column) -> Column:
    """Two points or more of: ISBN (two), bibliography word, reference, one to five authors, book title.

    A line of more than three words, normalised, or with a word of `RELEVANT` in it is content whatever its points."""
    n, words = tx.norm(line), _words(line)
    commas = F.length(F.regexp_replace(line, "[^,]", ""))
    year, doi = line.rlike(r"\b(?:19|20)\d{2}\b"), n.contains("doi")
    points = F.when(year, 1).otherwise(0) + F.when(commas >= 2, 1).otherwise(0) + F.when(line.contains("(") & line.contains(")"), 1).otherwise(0) + F.when(tx.contains_any(n, PUBLISHERS), 1).otherwise(0)
    names = F.split(F.trim(line), r"\s*(?:,|;|&|\by\b|\band\b)\s*")
    author = ~line.rlike("[.:!?]") & (F.size(names) <= 5) & F.forall(names, lambda p: p.rlike(r"^[\[\](){}\-]*\p{Lu}\S*(?: +[\[\](){}\-]*\p{Lu}\S*){1,3}$"))
    title = F.size(F.filter(words, lambda w: w.rlike(r"^[\[\](){}:;,\-]*\p{Lu}")))
    book = (F.size(words) >= 2) & (F.size(words) <= 10) & ~line.rlike("[.!?]") & (title >= F.size(words) - 1) & tx.contains_any(n, TEXTBOOKS)
    score = F.when(line.rlike(r"(?i)\bisbn(?:-1[03])?\b"), 2).otherwise(0) + sum((F.when(x, 1).otherwise(0) for x in (tx.contains_any(n, BIBLIOGRAPHY), (year | doi) & (points >= 2), author, book)), F.lit(0))
    content = (F.size(tx.tokens(n)) > 3) | tx.contains_any(n, RELEVANT)
    return (n != "") & ~content & (score >= 2)


def visible(text: Column) -> Column:
    """Without references and spreadsheet lines, one blank line at most, room after punctuation."""
    t = F.regexp_replace(F.regexp_replace(text, REFERENCE, ""), r"\[\]", "")
    t = F.regexp_replace(t, r"(?i)\.\s+(pdf|docx|xlsx|txt)\b", ".$1")
    t = F.regexp_replace(t, r"([.,;:!?])(?!(?i:pdf|docx|xlsx|txt)\b)([A-Za-zÁÉÍÓÚÑáéíóúñ])", "$1 $2")
    lines = F.filter(_lines(F.regexp_replace(t, r"[ \t]{2,}", " ")), lambda x: ~x.rlike(PARSER_LINE))
    return F.trim(F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n"))


def _by_norms(parts: Column, keep: Callable[[Column, Column], Column]) -> Column:
    """The parts that `keep` takes by the normalised texts of all and a place from 0. Parts and
    their normalised texts are evaluated once, not once for each pair of them."""
    def taken(all_: Column) -> Column:
        return tx.let(F.transform(all_, lambda x: tx.norm(x)), lambda norms: F.filter(all_, lambda _, i: keep(norms, i)))

    return tx.let(parts, taken)


def final(text: Column) -> Column:
    """As `visible`, without filler phrases, bare numbers and titles, repeated lines and blocks."""
    t = visible(text)
    for p in FILLER_PHRASES:
        t = F.regexp_replace(t, rf"(?i)\s*{p}[^.?!]*(?:[.?!]|$)", " ")

    def block(b: Column) -> Column:
        lines = F.transform(F.split(b, "\n"), lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"^\s*\.\.\.\s*|\s*\.\.\.\s*$", ""), r"[ \t]{2,}", " ")))
        kept = F.filter(lines, lambda x: (x != "") & ~x.rlike(NUMBER_LINE) & ~x.rlike(TITLE_LINE))
        return F.array_join(_by_norms(kept, lambda norms, i: (i == 0) | (F.get(norms, i) != F.get(norms, i - 1))), "\n")

    blocks = F.filter(F.transform(F.split(t, "\n\n"), block), lambda b: b != "")
    first = _by_norms(blocks, lambda norms, i: (F.get(norms, i) == "") | (F.array_position(norms, F.get(norms, i)) == i + 1))
    return F.trim(F.array_join(first, "\n\n"))


def redact_but_sources(text: Column, names: list[str]) -> Column:
    """Redacted, but for the names of sources and lines that begin with `Fuente`."""
    marks = {f"SRC{i}X": n for i, n in enumerate(sorted(names, key=len, reverse=True))}
    t = text
    for m, n in marks.items():
        t = F.replace(t, F.lit(n), F.lit(m))
    lines = F.transform(F.split(t, "\n"), lambda x: F.when(x.rlike(r"^\s*Fuentes?:"), x).otherwise(tx.redact(x)[0]))
    t = F.array_join(lines, "\n")
    for m, n in marks.items():
        t = F.replace(t, F.lit(m), F.lit(n))
    return t


def raw_text(answer: Column, chunk: Column) -> Column:
    """Whether an answer is document text: a long title in capitals, a paragraph of 55
    words, or 80 characters or more that lie in the chunk or share 86 % of their terms."""
    lines = _lines(answer)
    title = F.exists(lines, lambda x: (F.length(x) >= 18) & (F.length(x) <= 140) & (tx.upper_ratio(x) >= 0.78) & (F.size(F.split(x, " ")) >= 3))
    paragraph = F.exists(F.split(answer, "\n\n"), lambda p: (F.size(_words(p)) >= 55) & ~p.contains("Fuente:"))
    a, c = tx.norm(answer), tx.norm(chunk)

    def long_terms(n: Column) -> Column:
        return F.array_distinct(F.filter(F.split(n, " "), lambda w: F.length(w) >= 4))

    share = F.size(F.array_intersect(long_terms(a), long_terms(c))) / F.greatest(F.size(long_terms(a)), F.lit(1))
    return title | paragraph | ((F.length(a) >= 80) & (c != "") & (c.contains(a) | (share >= 0.86)))


def title_case(line: Column, minor: tuple[str, ...] = ("de", "del", "la", "las", "el", "los", "y", "o", "en", "a", "con", "por", "para")) -> Column:
    """Words with a capital, minor ones without but for the first."""
    words = _words(F.lower(line))
    return F.array_join(F.transform(words, lambda w, i: F.when((i > 0) & w.isin(*minor), w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 10_000)))), " ")


def rule_value(normalised: Column, rules: dict[str, list[str]], default: str) -> Column:
    """The first rule one of whose phrases the text holds: purposes, topics and areas are data of a deployment."""
    out = F.lit(default)
    for value, phrases in reversed(rules.items()):
        out = F.when(tx.contains_any(normalised, phrases), value).otherwise(out)
    return out


# Purposes of documents; a deployment adds the names of its own systems.
PURPOSES = {
    "instrucciones": ["instruccion", "paso", "curl", "docker", "endpoint", "api", "upload", "autorizacion", "authorization", "token"],
    "sistema": ["pipeline", "sistema", "plataforma", "backend", "frontend"],
    "análisis": ["analisis", "analiza", "conclusion", "resumen", "evaluacion", "diagnostico"],
}


def without_forbidden(text: Column) -> Column:
    """Without expressions that speak of the machinery; one space between words, one blank line at most."""
    out = text
    for p in map(tx.ascii_boundary, lx.FORBIDDEN):
        out = F.regexp_replace(out, p, "")
    out = F.regexp_replace(F.regexp_replace(out, r"[ \t]{2,}", " "), r"(?m)^[ \t]+", "")
    return F.regexp_replace(F.regexp_replace(out, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")
