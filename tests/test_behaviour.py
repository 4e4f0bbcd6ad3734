"""Behaviours of single operators on literal inputs."""

import io
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docspindle.functions import intent as it
from docspindle.functions import text as tx
from docspindle.operators import chunker, search, select, tabular
from docspindle.sources import readers
from docspindle.streaming import jobs


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "secret, left",
    [
        ("OPENAI_API_KEY=sk-abcdefghijklmnopqrstuvwxyz", "OPENAI_API_KEY=[REDACTADO]"),
        ("Authorization: Bearer abcdefghijklmnop", "[REDACTADO]"),
        ("password=supersecret", "[REDACTADO]"),
        ("admin@example.com:secretpass", "[REDACTADO]"),
        ('curl -H "Authorization: Basic x" http://a', "[REDACTADO]"),
        ("eyJabcdefghijkl.abcdefghijkl.abcdefghijkl", "[REDACTADO]"),
        ("a" * 41, "[REDACTADO]"),
        ("ésk-abcdefghijklmnopqrstuvwxyz", "é[REDACTADO]"),
        ("  ", "  "),
    ],
)
def test_secrets(spark, secret, left):
    text, n = tx.redact(F.lit(secret))
    assert one(spark, text) == left
    assert one(spark, n) == (0 if secret.isspace() else 1)


@pytest.mark.parametrize("text, value", [("1.234", 1234.0), ("1,5", 1.5), ("1.234,56", 1234.56), ("1,234.56", 1234.56), ("$ 10", 10.0), ("1,234", 1234.0), ("2.5", 2.5), ("x", None), ("", None)])
def test_numbers(spark, text, value):
    assert one(spark, tx.locale_number(F.lit(text))) == value


def test_content_types(spark):
    for text, kind in [("usa docker y curl", "technical"), ("Columnas: Cliente", "table"), ("una historia", "narrative")]:
        assert one(spark, tx.content_type(tx.norm(F.lit(text)))) == kind


@pytest.mark.parametrize("separator", [" | ", ", "])
def test_rows_of_either_separator(spark, separator):
    lines = ["Hoja: Ventas", "Total de filas de datos: 2", f"Fila 1: Cliente = Ana{separator}Valor = 100", f"Fila 2: Cliente=Luis{separator}Valor=100"]
    df = spark.createDataFrame([("d", x) for x in lines], "document_id string, content string")
    rows = tabular.parse_rows(df)
    assert {r["v"] for r in rows.select(tabular.label().alias("v")).collect()} == {"Ana", "Luis"}
    got = tabular.numeric_summary(rows, "valor").first()
    assert (got["n"], got["greatest"], got["greatest_row"], got["least_row"]) == (2, 100.0, 1, 1)
    assert tabular.row_count(df).first()["rows"] == 2


def test_coverage_brings_in_each_document(spark):
    rows = [("a3", "a", 3, 0.9), ("a1", "a", 1, 0.8), ("a2", "a", 2, 0.7), ("b1", "b", 1, 0.1), ("b2", "b", 2, 0.2)]
    df = spark.createDataFrame(rows, "chunk_id string, document_id string, chunk_index int, score double")
    got = [r["document_id"] for r in select.coverage(df, 2, 4).collect()]
    assert got.count("a") >= 2 and got.count("b") >= 2


def test_memory_keeps_the_newest_turns(spark):
    df = spark.createDataFrame([(1, i, f"t{i}") for i in range(6)], "conv_id int, turn int, text string")
    assert sorted(r["turn"] for r in jobs.memory(df).collect()) == [1, 2, 3, 4, 5]


def test_query_understanding():
    assert it.topic("Háblame sobre los arreglos").variants == ("arreglo", "arreglos", "array", "arrays")
    assert it.strip_tail("¿Quién es Ana, según el documento") == "¿Quién es Ana"
    assert it.global_terms("¿Qué dice Canción de la luna?") == ["¿que", "dice", "cancion", "luna?"]
    assert it.top_k(0, "section", True) == 3 and it.top_k(0, "structure", True) == 6
    assert it.natural_list(["a", "b", "c"]) == "a, b y c" and it.natural_list([]) == ""
    assert it.id_list(" a, b", "a,,c") == ["a", "b", "c"]


def test_near_copies_go(spark):
    text = "uno dos tres cuatro cinco seis siete ocho nueve diez"
    df = spark.createDataFrame([(0, text), (1, text + " once"), (2, "algo muy distinto aqui")], "rank int, norm string")
    assert sorted(r["rank"] for r in search.drop_near_copies(df, ["rank"]).collect()) == [0, 2]


def test_search_falls_back_to_the_first_chunks(spark):
    df = spark.createDataFrame([("d", i, f"d-{i}", "texto") for i in range(5)], "document_id string, chunk_index int, chunk_id string, content string")
    got = search.scoped_search(df, "zzzz", 3).collect()
    assert [(r["chunk_index"], r["score"]) for r in got] == [(0, 1.0), (1, 1.0), (2, 1.0)]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab. \n;!", max_size=2000))
def test_chunks_are_short_and_lose_nothing(text):
    cut = chunker.chunk_text(text, 50)
    assert all(0 < len(c) <= 50 for c in cut)
    assert "".join("".join(cut).split()) == "".join(text.split())


def _zip(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name.replace("__", "/") + ".xml", body)
    return out.getvalue()


def test_files_of_all_kinds(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    s = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    (tmp_path / "a.txt").write_text("hola")
    (tmp_path / "b.csv").write_text('x, y\n,,\n"q" r, 2\n')
    (tmp_path / "c.docx").write_bytes(_zip(word__document=f"<w:d {w}><w:p><w:t>uno</w:t><w:tab/><w:t>dos</w:t></w:p></w:d>", word__footer1=f"<w:d {w}><w:p><w:t>pie</w:t></w:p></w:d>"))
    sheet = f'<worksheet {s}><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>Valor</t></is></c></row><row r="3"><c r="B3"><v>5</v></c></row></worksheet>'
    (tmp_path / "d.xlsx").write_bytes(_zip(xl__workbook=f'<w {s}><sheet name="H"/></w>', xl__sharedStrings=f"<s {s}><si><t>Cliente</t></si></s>", xl__worksheets__sheet1=sheet))
    (tmp_path / "e.docx").write_bytes(b"broken")
    (tmp_path / "f.zzz").write_bytes(b"x")
    got = {r["path"].rsplit("/", 1)[1]: r for r in readers.read_documents(spark, str(tmp_path)).collect()}
    assert got["a.txt"]["text"] == "hola" and got["b.csv"]["text"].startswith("x | y")
    assert got["c.docx"]["text"] == "uno\tdos\npie"
    assert "Fila 3: Valor = 5" in got["d.xlsx"]["text"] and "Columnas: Cliente | Valor" in got["d.xlsx"]["text"]
    assert (got["e.docx"]["status"], got["f.zzz"]["status"]) == ("failed_parse", "unsupported_format")


def test_ingest_stream_equals_batch(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("doc_id document_id", "text")
    docs.write.parquet(str(tmp_path / "in"))
    q = jobs.start_ingest(spark, str(tmp_path / "in"), "document_id long, text string", str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    order = ["document_id", "chunk_index"]
    stream = spark.read.parquet(str(tmp_path / "out")).orderBy(*order).collect()
    assert stream == jobs.ingest(docs).orderBy(*order).collect()


def test_service_plans(spark):
    from docspindle.plans.engine import Retrieval, Scope

    docs = spark.createDataFrame([("t", "d1", "c1", True), ("t", "d2", "c1", False), ("u", "d3", "c1", True)], "tenant_id string, document_id string, collection_id string, is_favorite boolean")
    texts = [("t", "d1", 0, "Un arreglo es una coleccion de datos ordenados."), ("t", "d1", 1, "Otra cosa."), ("t", "d2", 0, "Los arreglos permiten guardar datos. password=secreto99"), ("u", "d3", 0, "arreglo ajeno")]
    chunks = spark.createDataFrame([(t, d, i, f"{d}-{i}", x) for t, d, i, x in texts], "tenant_id string, document_id string, chunk_index int, chunk_id string, content string")
    tags = spark.createDataFrame([("d2", "x")], "document_id string, tag string")
    r = Retrieval(docs, chunks, tags)
    assert {x["chunk_id"] for x in r.search("arreglo", Scope("t")).collect()} == {"d1-0", "d2-0"}
    assert [x["chunk_id"] for x in r.search("sobre arreglo", Scope("t", ("d1",))).collect()] == ["d1-0"]
    assert [x["chunk_id"] for x in r.search("zzz", Scope("t", ("d1",))).collect()] == ["d1-0", "d1-1"]
    got = r.ask("que es un arreglo", Scope("t", ("d1", "d2")))
    assert "coleccion de datos" in got["answer"] and [s["mark"] for s in got["sources"]] == ["A", "B"]
    assert r.ask("sobre arreglos", Scope("t", tag="x"))["sources"] == [{"mark": "A", "document_id": "d2"}]
    said = Retrieval(docs, chunks, tags, answer=lambda q, c: "La clave es password=secreto99.").ask("arreglo", Scope("t", favorites=True))
    assert "secreto99" not in said["answer"] and said["sources"][0]["document_id"] == "d1"
    assert r.report(Scope("t")).first()["documents"] == 2 and r.summary(Scope("t")).count() > 0


def test_display(spark):
    from docspindle.functions import display as dp

    shown = "Fila 1: a = b\n\n\n[chunk_id: 3]Uno.Dos\nUno. Dos\n3.\n\nUno. Dos\n\nver a. pdf"
    assert one(spark, dp.final(F.lit(shown))) == "Uno. Dos\n\nver a.pdf"
    assert one(spark, dp.redact_but_sources(F.lit("password=abc en password=x.txt\nFuente: password=y"), ["password=x.txt"])) == "[REDACTADO] en password=x.txt\nFuente: password=y"
    assert one(spark, dp.academic_noise(F.lit("ISBN 99-1"))) and not one(spark, dp.academic_noise(F.lit("una linea cualquiera del texto")))
    assert one(spark, dp.title_case(F.lit("HISTORIA DE LA CIENCIA"))) == "Historia de la Ciencia"
    assert one(spark, dp.summary_heading(F.lit("IV. Resultados"))) and one(spark, dp.noisy_capitals(F.lit("TODO EN MAYUSCULAS")))


def test_copies_beyond_the_pool_hide_no_match(spark):
    """More copies with a top score than a pool holds."""
    texts = ["Kestrel: the kestrel is a falcon of open country"] * 40 + [f"the kestrel {x}" for x in ("hovers above fields", "nests under bridges", "hunts small rodents", "winters near coasts")]
    rows = [(f"d{i:03}", 0, i, t, [1.0, 0.0]) for i, t in enumerate(texts)]
    chunks = spark.createDataFrame(rows, "document_id string, chunk_index int, chunk_id long, content string, embedding array<double>")
    found = {
        "hybrid": search.hybrid_search(chunks, "kestrel", [1.0, 0.0], 4, pool=10).orderBy("place"),
        "structure": search.structure_search(chunks, 4, pool=10),
        "section": search.section_search(chunks, "kestrel", 4, pool=10),
    }
    for name, df in found.items():
        got = [r["content"] for r in df.collect()]
        assert len(got) == len(set(got)) == 4, name
    assert search.section_search(chunks, "kestrel", 9, pool=10).count() == 5
    blank = chunks.limit(3).withColumn("content", F.lit("a:"))
    assert search.structure_search(blank, 9, pool=1).count() == search.structure_search(blank, 9).count()


@pytest.mark.parametrize("line, noise", [("ISBN 99-1", True), ("Manual Press", True), ("Fuentes: ISBN 1", True), ("ISBN 99-1 de una linea cualquiera del texto", False), ("ISBN del sistema", False), ("Fuentes Bibliografia", True), ("Ana Paz & Li", False), ("", False), (None, False)])
def test_content_is_no_academic_noise(spark, line, noise):
    from docspindle.functions import display as dp

    assert one(spark, dp.academic_noise(F.lit(line).cast("string"))) == noise


def test_academic_lines_are_whole(spark, tmp_path):
    """A reference after character 20 counts."""
    from docspindle.functions import display
    from docspindle.plans import text as plan

    lines = ["A plain beginning of a line, see https://doi.org/10.1/x and Smith et al. (2001), pp. 3-4, ISBN 12", "another"]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(lines)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    kept, display.academic_noise = display.academic_noise, lambda c: seen.append(c) or c
    try:
        got = [r["noise"] for r in plan.academic_lines(spark, str(tmp_path)).collect()]
    finally:
        display.academic_noise = kept
    assert sorted(got) == sorted(f"{t}, ISBN 99 (2001)" for t in lines)


def test_structure_search_reads_all_sources(spark, tmp_path):
    from docspindle.plans import retrieval

    rows = [(1, "Hoja: uno", "en", "src7", 9), (2, "Hoja: dos", "es", "src1", 9), (3, "Hoja: tres", "fr", None, 10)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(r["chunk_id"] for r in retrieval.structure_search(spark, str(tmp_path)).collect()) == ["1-0", "2-0", "3-0"]
