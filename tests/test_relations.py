"""Relations of groups, actions and command lines on chosen texts."""

from pyspark.sql import functions as F

from docspindle.functions import lexicon as lx
from docspindle.operators import relations as rel

TEXTS = [
    ("three", "La rueda y el vapor."), ("three", "Un algoritmo de orden."), ("three", "El exoplaneta lejano."),
    ("sheet", "Columnas: a | b\n1 | 2"), ("sheet", "Prosa sin más."), ("tech", "usa docker y token"), ("tech", "  Total de filas de datos: 4"),
    ("same", "nada"), ("same", None), ("alone", "la rueda"), (None, ""), (None, "git y curl"),
]


def test_relations(spark):
    df = spark.createDataFrame([(i, *t) for i, t in enumerate(TEXTS)], "document_id long, g string, text string").withColumn("norm", F.lit("clash"))
    profiles = {r["document_id"]: r for r in rel.relation_profiles(df).collect()}
    assert (profiles[3]["type"], profiles[3]["purpose"], profiles[3]["topic"], profiles[3]["norm"]) == ("data", "datos", "datos tabulares", "clash")
    assert (profiles[8]["type"], profiles[8]["topic"], profiles[8]["area"]) == ("narrative", "", "su área especializada")
    got = {r["g"]: r for r in rel.relations(rel.relation_profiles(df), ["g"]).collect()}
    assert set(got) == {"three", "sheet", "tech", "same", None}
    assert got["three"]["relation"] == "La relación entre ellos" + lx.DISTINCT_TOPICS + "cada uno desde áreas como la astronomía, la historia del transporte y la informática."
    assert got["three"]["conclusion"] == lx.DISTINCT_CONCLUSION
    assert got["sheet"]["conclusion"] == lx.MIXED_CONCLUSION and got["sheet"]["relation"].startswith("La relación entre ambos radica en que el primero aporta")
    assert got["tech"]["verdict"] == lx.VERDICTS[2][2] and "explica acciones o pasos" in got["tech"]["relation"]
    assert got["same"]["relation"] == "La relación entre ambos radica en que comparten un propósito de análisis y abordan información complementaria sobre ese mismo frente."
    assert got[None]["verdict"] == lx.VERDICTS[1][2]
    assert rel.relations(rel.relation_profiles(df.limit(0)), ["g"]).count() == 0


def test_actions_and_commands(spark):
    text = "$ no\r\n- `git status`\n* Docker  run\n  Docker run \nusa   curl aquí\ndigital\ngitano curlo\n-*`powershell x`\n" + "git " + "a" * 300
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "document_id long, text string")
    got = [(r["document_id"], r["place"], r["command"]) for r in rel.command_lines(df).orderBy("place").collect()]
    assert got == [(1, 1, "git status"), (1, 2, "Docker  run"), (1, 3, "usa   curl aquí"), (1, 4, "powershell x"), (1, 5, "git " + "a" * 216 + "...")]
    assert len(rel.command_lines(df, 2).collect()) == 2
    told = {r["document_id"]: r["a"] for r in df.select("document_id", rel.technical_actions(F.col("text")).alias("a")).collect()}
    assert told == {1: ["usar comandos Docker, PowerShell, curl y Git"], 2: [lx.NO_ACTION], 3: [lx.NO_ACTION]}
    asked = spark.range(1).select(rel.technical_actions(F.lit("Sube tu Documento con JWT del Tenant")).alias("a")).first()["a"]
    assert asked == list(lx.ACTIONS)[:3]
