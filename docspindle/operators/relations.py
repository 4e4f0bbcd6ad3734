"""How the documents of a group relate, and what technical documents ask to do."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import display as dp
from ..functions import lexicon as lx
from ..functions import text as tx


def natural_list(items: Column) -> Column:
    """a, b y c"""
    n = F.size(items)
    return F.when(n < 2, F.array_join(items, "")).otherwise(F.concat(F.array_join(F.slice(items, F.lit(1), F.greatest(n - 1, F.lit(0))), ", "), F.lit(" y "), F.element_at(items, -1)))


def relation_profiles(texts: DataFrame, topics: dict[str, list[str]] = lx.TOPICS, areas: dict[str, list[str]] = lx.AREAS) -> DataFrame:
    """`texts` (document_id, text, ...) with type, purpose, topic and area instead of the text. A document
    without a topic of `topics` has a blank one. Null texts are blank; sheets are data unless a rule of topics or areas holds."""
    n = tx.once(texts, __norm=tx.norm(F.coalesce("text", F.lit(""))), __sheet=F.coalesce(tx.spreadsheet_like(F.col("text")), F.lit(False)))
    norm, sheet = F.col("__norm"), F.col("__sheet")
    kind = F.when(sheet, "data").when(tx.content_type(norm) == "technical", "technical").otherwise("narrative")
    purpose = F.when(sheet, "datos").otherwise(dp.rule_value(norm, dp.PURPOSES, "análisis"))
    topic, area = dp.rule_value(norm, topics, ""), dp.rule_value(norm, areas, "")
    told = n.withColumns({"type": kind, "purpose": purpose, "topic": F.when((topic == "") & sheet, "datos tabulares").otherwise(topic)})
    told = told.withColumn("area", F.when(area != "", area).when(sheet, "los datos tabulares").otherwise("su área especializada"))
    return told.drop("__norm", "__sheet", "text")


def relations(profiles: DataFrame, by: list[str]) -> DataFrame:
    """by, documents, relation, conclusion, comparison, verdict for groups of two documents or more.

    Types, purposes and areas of a group are sets no larger than the rules that make them, and of topics only
    the least and greatest are kept, so a group of any size is summed where its rows lie."""
    topic = tx.norm(F.col("topic"))
    named = F.when(topic != "", topic)
    g = profiles.groupBy(*by).agg(
        F.count("*").alias("documents"), F.collect_set("type").alias("types"), F.collect_set("purpose").alias("purposes"),
        F.sort_array(F.collect_set(F.when(F.trim("area") != "", F.trim("area")))).alias("areas"), (F.min(named) < F.max(named)).alias("several"),
    )

    def rule(rules: list, default: Column | str) -> Column:
        out = F.lit(default) if isinstance(default, str) else default
        for column, both, said in reversed(rules):
            out = F.when(reduce(Column.__and__, [F.array_contains(column, x) for x in both]), said).otherwise(out)
        return out

    distinct = F.coalesce(F.col("several"), F.lit(False)) & ~F.array_contains("types", "data")
    one, areas = F.element_at("purposes", 1), F.col("areas")
    alike = F.when(F.size("purposes") == 1, F.concat(F.lit(lx.ONE_PURPOSE[0]), one, F.lit(lx.ONE_PURPOSE[1]))).otherwise(lx.RELATED)
    contrast = (
        F.when(F.size(areas) == 0, F.lit("cada uno desde su área especializada")).when(F.size(areas) == 1, F.concat(F.lit("ambos desde "), areas[0]))
        .when(F.size(areas) == 2, F.concat(F.lit("uno desde "), areas[0], F.lit(" y otro desde "), F.get(areas, F.lit(1)))).otherwise(F.concat(F.lit("cada uno desde áreas como "), natural_list(areas)))
    )
    subject = F.concat(F.lit("La relación entre "), F.when(F.col("documents") > 2, "ellos").otherwise("ambos"))
    relation = F.when(distinct, F.concat(subject, F.lit(lx.DISTINCT_TOPICS), contrast)).otherwise(F.concat(subject, F.lit(" radica en que "), rule(lx.RELATIONS, alike)))
    use = F.concat(F.lit("En conjunto, estos documentos permiten "), rule(lx.COMBINED_USES, lx.COMBINED_USE), F.lit("."))
    mixed = F.array_contains("types", "data") & F.array_contains("types", "narrative")
    conclusion = F.when(mixed, lx.MIXED_CONCLUSION).when(distinct, lx.DISTINCT_CONCLUSION).otherwise(use)
    out = {"relation": F.concat(relation, F.lit(".")), "conclusion": conclusion}
    out |= {"comparison": rule(lx.COMPARISONS, lx.COMPARISON), "verdict": rule(lx.VERDICTS, lx.VERDICT)}
    return g.filter("documents > 1").withColumns(out).select(*by, "documents", *out)


def technical_actions(text: Column) -> Column:
    """What a technical text asks to do, in the order of the rules; one general line if it holds none of their words."""
    def found(n: Column) -> Column:
        return F.array_compact(F.array(*[F.when(tx.contains_any(n, terms), action) for action, terms in lx.ACTIONS.items()]))

    # The rules' terms are parts of one word each.
    return tx.let(tx.let(tx.searched(F.coalesce(text, F.lit(""))), found), lambda a: F.when(F.size(a) == 0, F.array(F.lit(lx.NO_ACTION))).otherwise(a))


def command_lines(texts: DataFrame, most: int = 8) -> DataFrame:
    """document_id, place, command: the first `most` different command lines of (document_id, text), without
    list marks, up to 220 characters. Lines that are equal when normalised are one."""
    lines = texts.select("document_id", F.posexplode(F.split(F.regexp_replace("text", "\r\n", "\n"), "\n")).alias("at", "raw"))
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.trim(F.regexp_replace("raw", "[\t\r\f]", " ")), r"^-?\*? *", ""), "^`+|`+$", ""))
    # Few lines hold a tool's name, so that only they are normalised.
    lines = lines.filter(tx.contains_any(F.lower("raw"), lx.COMMANDS)).withColumn("line", bare)
    lines = tx.once(lines.withColumn("line", F.when(F.length("line") > 220, F.concat(F.substring("line", 1, 220), F.lit("..."))).otherwise(F.col("line"))), norm=tx.norm(F.col("line")))
    lines = lines.filter(tx.contains_any(F.concat(F.lit(" "), F.col("norm")), [f" {c} " for c in lx.COMMANDS]))
    first = lines.groupBy("document_id", "norm").agg(F.min(F.struct("at", "line")).alias("x"))
    place = F.row_number().over(Window.partitionBy("document_id").orderBy("x"))
    return first.withColumn("place", place).filter(F.col("place") <= most).select("document_id", "place", F.col("x.line").alias("command"))
