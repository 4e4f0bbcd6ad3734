"""Kinds and traits of questions, for one question on the driver or for a column of them."""

from __future__ import annotations

import re

from pyspark.sql import Column

from . import lexicon as lx
from . import text as tx
from .display import rule_value
from .intent import norm


def traits(question: str) -> set[str]:
    q = norm(question)
    held = {name for name, phrases in lx.QUESTION_TRAITS.items() if any(p in q for p in phrases)}
    return held | ({"several"} if held & {"overview", "cross_document"} else set())


def trait_columns(normalised: Column) -> dict[str, Column]:
    """A flag of each trait; overviews and relations are about several documents too."""
    held = {name: tx.contains_any(normalised, phrases) for name, phrases in lx.QUESTION_TRAITS.items()}
    return held | {"several": held["several"] | held["overview"] | held["cross_document"]}


def question_intent(question: str) -> str:
    q = norm(question)
    return next((name for name, phrases in lx.QUESTION_INTENTS.items() if any(p in q for p in phrases)), "general")


def intent_column(normalised: Column) -> Column:
    return rule_value(normalised, lx.QUESTION_INTENTS, "general")


def _telling(term: str) -> bool:
    return term not in lx.ASK_STOP_WORDS and term not in lx.GROUNDING_STOP_WORDS


def asked_topic(question: str) -> list[str]:
    """Up to four words of the topic that a question names, one of five letters or more; none if it names none."""
    q = norm(question)
    for lead in lx.ASKED_TOPIC:
        _, found, tail = q.partition(lead)
        if not found:
            continue
        for noise in lx.ASKED_NOISE:
            tail = tail.replace(noise, "")
        words = [w for w in tail.split() if _telling(w)][:4]
        if any(len(w) >= 5 for w in words):
            return words
    return []


def number_forms(term: str) -> list[str]:
    """A word with its likely singulars or plurals."""
    more = []
    if term.endswith("es") and len(term) > 4:
        more.append(term[:-2])
    if term.endswith("s") and len(term) > 3:
        more.append(term[:-1])
    else:
        more.append(term + "s")
        if term[-1:] in ("n", "l", "r", "d", "z"):
            more.append(term + "es")
    return list(dict.fromkeys([term, *more]))


def topic_forms(term: str) -> list[str]:
    """Forms under which a topic's word counts as held by a text."""
    return number_forms(term) + (number_forms("biologico") + number_forms("biologica") if term == "biologia" else [])


def field_question(question: str) -> tuple[str, str]:
    """(field, row) of "what field has row" and "what is the field of row", or two blanks; of normalised text."""
    name, row = "([a-z0-9_ ]+?)", "([a-z0-9_ .-]+)"
    found = re.fullmatch(rf"que\s+{name}\s+tiene\s+{row}", question) or re.fullmatch(rf"cual\s+es\s+(?:la|el)\s+{name}\s+de\s+{row}", question)
    if not found:
        return "", ""
    who = found[2].strip()
    for tail in (" del archivo", " del documento", " en el archivo", " en el documento"):
        who = who.removesuffix(tail).strip()
    return (found[1].strip(), who) if found[1].strip() and who else ("", "")
