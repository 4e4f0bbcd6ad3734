"""Values of operators whose queries have no SQL."""

import random
import re

import pytest
from pyspark.sql import functions as F

from docspindle.functions import display as dp
from docspindle.functions import intent as it
from docspindle.functions import lexicon as lx
from docspindle.functions import scans
from docspindle.functions import text as tx
from docspindle.operators import reports, search, sheets


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_parted_against_pairs(spark):
    """Number words pair by pair, as a loop parts them."""
    rng = random.Random(3)
    texts = ["".join(rng.choice([*lx.NUMBER_WORDS, "y", " ", "casa"]) for _ in range(6)) for _ in range(200)]

    def loop(t):
        for _ in range(8):  # until nothing is joined
            for a in lx.NUMBER_WORDS:
                for b in lx.NUMBER_WORDS:
                    t = t.replace(f"{a}y{b}", f"{a} y {b}").replace(a + b, f"{a} {b}")
        return re.sub(r"\s+", " ", t).strip()

    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tx.parted(F.col("t")).alias("x")).collect()
    assert {r["t"]: r["x"] for r in got} == {t: loop(t) for t in texts}
    assert value(spark, tx.parted(F.lit("Elviaje tieneuna duracionde seisynueve"))) == "El Viaje tiene una duracion de seis y nueve"


@pytest.mark.parametrize("text, want", [(" .- Resumen: el viaje,dura  nuevemeses. ", "El viaje, dura nueve meses"), ("¿?", ""), ("a", "A"), ("Objetivo - Introducción x", "X")])
def test_clean_sentence(spark, text, want):
    assert value(spark, tx.clean_sentence(F.lit(text))) == want


def test_forbidden_expressions_go(spark):
    assert value(spark, dp.without_forbidden(F.lit("El primer eje  trata. Los chunks recuperados\n\n\n\n  sirven"))) == "trata. Los recuperados\n\nsirven"


def test_sheet_chunks(spark):
    rng = random.Random(5)
    rows = [(d, s, n, f"Fila {n}: a = " + "x" * rng.randint(0, 60)) for d in (1, 2) for s in ("s", "t") for n in range(1, rng.randint(2, 40))] + [(3, "long", 1, "y" * 900), (3, "long", 2, "z")]
    sheet = sorted({r[:2] for r in rows} | {(4, "empty")})
    heads = spark.createDataFrame([(*x, ["a", "b"], x[0] == 1) for x in sheet], "document_id long, sheet string, headers array<string>, detected boolean")
    got = sheets.sheet_chunks(heads, spark.createDataFrame(rows, "document_id long, sheet string, number long, line string"), 300).collect()
    want = []
    for d, s in sheet:
        own = [r for r in rows if r[:2] == (d, s)]
        head = f"Documento tipo: Excel\nHoja: {s}\nColumnas: a, b\nTotal de columnas: 2\nTotal de filas de datos: {len(own)}\nEncabezados detectados: {'si' if d == 1 else 'no'}"

        def text(rs):
            return "\n".join([head, f"Bloque de filas: {rs[0][2]}-{rs[-1][2]}", *(r[3] for r in rs)]) if rs else head

        out, held = [], []
        for r in own:
            if held and len(text([*held, r])) > 300:
                out.append(text(held))
                held = []
            held.append(r)
        want += [(d, s, i, x) for i, x in enumerate([*out, text(held)])]
    assert sorted(map(tuple, got)) == sorted(want)
    over = {r["document_id"]: (r["columns"], r["rows"]) for r in sheets.overviews(spark.createDataFrame(got).select("document_id", "chunk_index", "content")).collect()}
    assert over[4] == ("a, b", "0") and over[3] == ("a, b", "2")


def test_numeric_field(spark):
    rows = spark.createDataFrame([({"saldo": "x", "monto": "1.500,20"},), ({"valor": "nada"},)], "pairs map<string, string>")
    assert sheets.numeric_field(rows, ["Saldo", "Otro"], "cual es el saldo") == "monto"
    assert sheets.numeric_field(rows.filter("pairs['valor'] = 'nada'"), [], "") == ""
    assert it.threshold("monto mayor a 1.200,50") == "1.200,50" and it.threshold("monto") is None


def test_tasks_and_relevance(spark):
    assert [it.document_task(q) for q in ("¿Qué fecha?", "El PRECIO", "un resumen", "hola")] == ["dates", "economic_values", "summary", "question"]
    c = spark.createDataFrame([(1, "El transporte público"), (1, "crece mucho"), (2, "nada de eso"), (3, "transporte")], "document_id long, content string")
    got = {r["document_id"]: (round(r["relevance"], 3), r["relevant"]) for r in reports.relevance(c, "cuanto crece transporte publico urbano").collect()}
    assert got == {1: (0.75, True), 2: (0.0, False), 3: (0.25, False)}
    assert all(r["relevant"] for r in reports.relevance(c, "resumen").collect())


CHUNKS = [
    (1, 0, "1. Introducción\nEl perro corre por el campo verde\nbibliografia general"),
    (1, 1, "la casa blanca de la montaña alta"),
    (1, 2, "texto sin nada que ver"),
    (2, 0, "La Casa Blanca de la montaña alta"),
    (2, 5, "Hoja: datos\nColumnas: a, b"),
    (3, 0, "fuentes"),
]


@pytest.fixture(scope="module")
def some(spark):
    return spark.createDataFrame([(d, i, f"{d}-{i}", t, [1.0, 0.0]) for d, i, t in CHUNKS], "document_id long, chunk_index int, chunk_id string, content string, embedding array<double>")


def test_structure_search(some):
    got = {r["chunk_id"]: r for r in search.structure_search(some, 6).collect()}
    assert "3-0" not in got and "1-1" not in got  # noise alone; a copy of 2-0, which stands earlier
    assert got["1-0"]["content"] == "1. Introducción\nEl perro corre por el campo verde"
    # Two headings first, a colon, a sheet's lines, an early place, a short text.
    assert got["2-5"]["score"] == pytest.approx(0.3 + 0.35 + 1.25 + 0.6 + 0.2 + _headings(got["2-5"]["content"]))


def _headings(content):
    """What headings among the lines add: `Hoja: datos` has a capital in one of two words."""
    lines = content.split("\n")
    heads = [len(x.split()) <= 8 and sum(w[0].isupper() for w in x.split()) >= len(x.split()) - 1 for x in lines]
    return 2.4 * heads[0] + 1.1 * heads[1] + 0.25 * sum(heads)


def test_section_search(some):
    got = [(r["chunk_id"], round(r["score"], 6)) for r in search.section_search(some, "casa blanca", 4).collect()]
    # Both words whole (0.8 each), all of them (1), the phrase (1.8), thrice, and 1.2 at distance 0; neighbours by distance alone.
    direct = (0.8 * 2 + 1 + 1.8) * 3 + 1.2
    # 1-1 is a copy, and comes later.
    assert got == [("2-0", round(direct, 6)), ("1-0", 0.8), ("1-2", 0.8)]


def test_hybrid_search(some):
    strict = search.hybrid_search(some, "casa", [1.0, 0.0]).collect()
    assert [r["chunk_id"] for r in strict] == ["2-0"]
    assert search.hybrid_search(some, "zzzzzz", [1.0, 0.0]).collect() == []


def test_fallback_scores(some):
    got = {r["chunk_id"]: r["score"] for r in search.fallback_scores(some, "casa").collect()}
    # The query itself 0.85, all terms 0.5, one hit 0.04 and 0.06, a main term 0.18.
    assert got == {k: pytest.approx(1.63) for k in ("1-1", "2-0")}


def test_raw_text(spark):
    shown = "Una frase corta."
    chunk = "Este documento trata de muchas cosas distintas que conviene leer con calma antes de decidir nada en absoluto"
    assert not value(spark, dp.raw_text(F.lit(shown), F.lit(chunk)))
    assert value(spark, dp.raw_text(F.lit(chunk[:95]), F.lit(chunk))) and value(spark, dp.raw_text(F.lit("UN TITULO MUY LARGO AQUI"), F.lit(chunk)))


@pytest.mark.parametrize(
    "read, want",
    [
        ("Ab\nLas plagas | comunes ; del hogar\nson impor-\ntantes\nRatones grises\nde 12 cm\nxyz", "Las plagas comunes del hogar son importantes\nRatones grises 12"),
        ("Ecucarachas, en los desagiies", "Cucarachas los desagües"),
        ("", ""),
        (None, None),
        ("~\n--\n.", ""),
        ("Título\nbcd", "Título"),
    ],
)
def test_image_text(spark, read, want):
    assert value(spark, scans.image_text(F.lit(read).cast("string"))) == want


def test_numbers_of_scans(spark):
    assert value(spark, scans.numbers(F.lit("12 y 345; +34 600 111 222; 345; b12 a99"))) == ["345", "+34 600 111 222"]
