"""What a query asks for: plain values, computed once on the driver."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field

from . import entity as en
from . import lexicon as lx


def norm(text: str) -> str:
    folded = unicodedata.normalize("NFD", text.strip().lower())
    bare = "".join(c for c in folded if unicodedata.category(c) != "Mn")
    return re.sub(r"[\W_]+", " ", bare).strip()


def terms(normalised: str) -> list[str]:
    return list(dict.fromkeys(w for w in normalised.split() if len(w) >= 2 and w not in lx.STOP_WORDS))


def strip_tail(question: str) -> str:
    """Without "according to the document" at the end, as often as it is there."""
    text = question.strip()
    while True:
        low = text.lower()
        tail = next((t for t in lx.QUESTION_TAILS if low.endswith(t)), None)
        if tail is None:
            return text or question.strip()
        text = text[: len(text) - len(tail)].strip().rstrip(" ,.;:-")


def global_terms(query: str) -> list[str]:
    """Terms of global search: four characters or more; punctuation stays."""
    words = query.strip().lower().translate(lx.QUERY_FOLD).split()
    return list(dict.fromkeys(w for w in words if len(w) >= 4 and w not in lx.GLOBAL_STOP_WORDS))


def phrase_terms(query: str) -> list[str]:
    """The whole phrase, then each of its words, without regard to case."""
    seen: dict[str, str] = {}
    for t in [query.strip(), *query.split()]:
        if t:
            seen.setdefault(t.lower(), t)
    return list(seen.values())


def text_terms(query: str) -> list[str]:
    found = terms(norm(strip_tail(query)))
    return [t for t in found if t not in lx.INTENT_WORDS] or found


def query_type(query: str) -> str:
    q = norm(query)
    if any(x in q for x in ("estructura", "indice", "capitulos", "secciones", "organizado", "temario")):
        return "structure"
    if any(x in q for x in lx.SUMMARY_WORDS):
        return "summary"
    if (q.startswith("sobre ") and q[6:].strip()) or any(x in q for x in lx.SECTION_TRIGGERS):
        return "section"
    return "question"


def precision(query: str) -> bool:
    return 1 <= len(terms(norm(query))) <= 3


def top_k(asked: int, kind: str, precise: bool) -> int:
    """Floors by kind first, then the cap of precise queries."""
    k = asked if asked > 0 else 3
    k = max(k, {"summary": 4, "section": 4, "structure": 6}.get(kind, 1))
    return min(k, 3) if precise and kind not in ("summary", "structure") else k


@dataclass(frozen=True)
class Topic:
    main: str = ""
    variants: tuple[str, ...] = ()

    @property
    def enabled(self) -> bool:
        return bool(self.main)


def topic(query: str) -> Topic:
    q = norm(strip_tail(query))
    tail = ""
    for trigger in lx.TOPIC_TRIGGERS:
        if trigger in q:
            tail = q.rsplit(trigger, 1)[1].strip()
            break
    found = [t for t in terms(tail or q) if t not in lx.INTENT_WORDS and t not in lx.TOPIC_STOP_WORDS]
    if not found:
        return Topic()
    main = found[-1]
    family = next((f for f in lx.TOPIC_FAMILIES if main in f), None)
    if family is None and not tail:
        return Topic()
    other = main[:-1] if main.endswith("s") and len(main) > 4 else main + "s"
    return Topic(main, tuple(family or (main, other)))


@dataclass(frozen=True)
class Intent:
    query: str
    normalised: str
    terms: list[str] = field(default_factory=list)
    main_terms: list[str] = field(default_factory=list)
    phrase: str = ""
    entity: str = ""

    @property
    def filters_entity(self) -> bool:
        return en.filters(self.entity)


def intent(query: str, entity: str = "") -> Intent:
    """Main terms, the longest phrase with a long word, and the entity: the caller's, or else what the question names."""
    q = norm(query)
    t = terms(q)
    long_ = [x for x in t if len(x) > 4]
    phrase = " ".join(t) if len(t) >= 2 and long_ else ""
    return Intent(query, q, t, long_ or t, phrase, norm(entity) or en.main_entity(q)[0])


def weights(query: str) -> tuple[float, float]:
    """(vector, text) weights of a hybrid score."""
    return (0.3, 0.7) if any(x in norm(query) for x in lx.TEXT_WEIGHT_QUERY) else (0.4, 0.6)


def factual(query: str) -> bool:
    return any(x in norm(query) for x in lx.FACT_QUERY)


def tabular(query: str) -> bool:
    return any(x in norm(query) for x in lx.TABULAR_QUERY)


def conceptual(query: str) -> bool:
    return precision(query) or any(x in norm(query) for x in lx.CONCEPT_QUERY)


def natural_list(items: list[str]) -> str:
    """"a, b y c"."""
    return " y ".join([", ".join(items[:-1]), items[-1]]) if len(items) > 1 else "".join(items)


def truthy(value: str) -> bool:
    return value.strip().lower() in ("1", "true", "yes", "si", "sí")


def id_list(*values: str) -> list[str]:
    """Trimmed, without blanks, each once, in order."""
    return list(dict.fromkeys(x for v in values for x in (p.strip() for p in v.split(",")) if x))


def document_task(query: str) -> str:
    """What is asked of a document: the first task one of whose words the question holds, a summary, or a question."""
    q = norm(query)
    found = next((task for task, words in lx.DOCUMENT_TASKS.items() if any(w in q for w in words)), None)
    return found or ("summary" if query_type(query) == "summary" else "question")


def relevance_terms(question: str) -> list[str]:
    """Words of four characters or more that tell what a question is about, each once."""
    words = norm(strip_tail(question)).split()
    return list(dict.fromkeys(w for w in words if len(w) >= 4 and w not in lx.RELEVANCE_STOP_WORDS))


def least_relevance(question: str) -> float:
    """The share of its terms that a context must hold."""
    if query_type(question) == "section":
        return lx.LEAST_SECTION
    return lx.LEAST_FEW if len(relevance_terms(question)) <= 2 else lx.LEAST_MANY


def threshold(question: str) -> str | None:
    """The number, as written, that values must be above."""
    found = re.search(r"(?:mayor|superior)\s+(?:a|que)\s+([0-9][0-9.,]*)", question)
    return found and found[1]
