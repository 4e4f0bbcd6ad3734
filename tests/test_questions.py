"""What questions name and ask, and what answers rest on."""

import pytest
from pyspark.sql import functions as F

from docspindle.functions import entity as en
from docspindle.functions import intent as it
from docspindle.functions import lexicon as lx
from docspindle.functions import questions as qs
from docspindle.operators import reports


@pytest.mark.parametrize(
    "question, want",
    [
        ("¿Quién lideró el descubrimiento de la estrella Próxima Centauri b?", ("proxima centauri b", "")),
        ("el anuncio del telescopio espacial en el documento", ("anuncio del telescopio espacial", "")),
        ("arquitectura hexagonal moderna", ("arquitectura hexagonal moderna", "")),
        ("¿Qué es?", ("", "generic_entity_phrase")),
        ("cuando se publico", ("", "generic_entity_phrase")),
        ("cual sera", ("", "generic_boundary_term")),
        ("mi tema", ("", "generic_boundary_term")),
        ("tema nuevo", ("", "weak_entity_phrase")),
        ("datos nuevos", ("", "insufficient_relevant_terms")),
        ("casa roja", ("", "missing_strong_noun")),
        ("variable", ("", "no_strong_entity_candidate")),
        ("", ("", "empty_query")),
    ],
)
def test_main_entity(question, want):
    assert en.main_entity(it.norm(question)) == want


def test_entity_filters():
    assert en.filters("proxima centauri") and not en.filters("casa roja") and not en.filters("centauri" * 3)
    assert not en.filters("nuestra informacion") and not en.filters("proxima centauri de")
    assert it.intent("descubrimiento de la proxima centauri").filters_entity
    assert it.intent("casa", "Estrella Polar").entity == "estrella polar"  # the caller's goes first


def test_traits_on_driver_and_columns(spark):
    asked = ["Dame un resumen completo", "¿Cuáles son los pasos?", "¿Qué tienen en común?", "¿y cuál es mejor?", "algo inventado", "hola", "puntos clave", "qué hace"]
    rows = spark.createDataFrame([(q, it.norm(q)) for q in asked], "q string, n string")
    got = rows.select("q", qs.intent_column(F.col("n")).alias("kind"), *[c.alias(n) for n, c in qs.trait_columns(F.col("n")).items()]).collect()
    for r in got:
        assert {n for n in lx.QUESTION_TRAITS if r[n]} == qs.traits(r["q"]) and r["kind"] == qs.question_intent(r["q"])
    assert qs.traits("¿Qué tienen en común?") == {"cross_document", "several"} and qs.question_intent("¿Cuáles son los pasos?") == "proceso"


def test_topics_and_fields():
    assert qs.asked_topic("Háblame de la biología marina del documento") == ["biologia", "marina"]
    assert qs.asked_topic("dime de eso") == [] and qs.asked_topic("hola") == []
    assert qs.number_forms("flores") == ["flores", "flor", "flore"] and qs.number_forms("flor") == ["flor", "flors", "flores"] and qs.number_forms("casa") == ["casa", "casas"]
    assert qs.field_question("que saldo tiene ana perez del archivo") == ("saldo", "ana perez")
    assert qs.field_question("cual es la ciudad de ana") == ("ciudad", "ana") and qs.field_question("cual es") == ("", "")


def test_topic_support(spark):
    c = spark.createDataFrame([(1, "La flor"), (1, "es marina"), (2, "flores"), (3, None)], "document_id long, content string")
    got = {r["document_id"]: r["supported"] for r in reports.topic_support(c, "háblame de flores marinas").collect()}
    assert got == {1: True, 2: False, 3: False}
    assert all(r["supported"] for r in reports.topic_support(c, "hola").collect())


def test_grounding_reasons(spark):
    long_ = "palabra " * 400
    cases = [
        (1, "", "x", []), (2, "x", None, []), (3, "La plataforma", "otra cosa", []), (4, "No contiene nada", long_, []), (5, "Un resumen", long_, []),
        (6, "alfalfa betabel centeno datiles escarola frijoles", "nada", []), (7, "palabra", "palabra", []),
    ]
    a = spark.createDataFrame([(i, t, "n") for i, t, _, _ in cases], "document_id long, answer string, name string")
    c = spark.createDataFrame([(i, x) for i, _, x, _ in cases], "document_id long, context string")
    got = {r["document_id"]: r["reasons"] for r in reports.grounding_reasons(a, c).collect()}
    assert got == {1: ["empty_answer"], 2: ["empty_context"], 3: ["unsupported_content"], 4: ["possible_contradiction"], 5: ["too_short_for_summary"], 6: ["unsupported_topics"], 7: []}


def test_ask_by_topic_and_date(spark):
    from docspindle.plans.engine import NOTHING, Retrieval, Scope

    docs = spark.createDataFrame([("t", "d1", "c1", True)], "tenant_id string, document_id string, collection_id string, is_favorite boolean")
    texts = ["Un arreglo es una coleccion de datos.", "El contrato se firmo el 12 de mayo de 2021 en Lima.", "El contrato es largo."]
    chunks = spark.createDataFrame([("t", "d1", i, f"d1-{i}", x) for i, x in enumerate(texts)], "tenant_id string, document_id string, chunk_index int, chunk_id string, content string")
    r, scope = Retrieval(docs, chunks), Scope("t", ("d1",))
    asked = r.ask("háblame sobre volcanes y arreglos", scope)
    assert asked["answer"] == NOTHING and asked["sources"] == []
    assert "coleccion" in r.ask("háblame sobre el arreglo", scope)["answer"]
    assert "12 de mayo de 2021" in r.ask("fecha del contrato", scope)["answer"]
