"""What a question names: neighbouring words that look like a name, judged by their kinds."""

from __future__ import annotations

from collections.abc import Iterator

from . import lexicon as lx


class Word:
    """The kinds of one normalised word."""

    def __init__(self, text: str):
        self.text = text
        self.stop, self.generic = text in lx.ENTITY_STOP_WORDS, text in lx.ENTITY_GENERIC
        self.connects, self.weak, self.tells = text in lx.ENTITY_CONNECTORS, text in lx.ENTITY_WEAK, text in lx.ENTITY_NARRATIVE
        plain, digit = not (self.stop or self.generic or self.connects), any(c.isdigit() for c in text)
        self.strong = text in lx.ENTITY_STRONG or (plain and len(text) >= 7)
        self.suffix = len(text) == 1 and text.isalpha()
        self.proper = plain and len(text) >= 2 and (digit or len(text) >= 8)
        self.meaning = plain and not self.weak
        self.specific = self.strong or self.suffix or digit


def _named(words: list[Word]) -> bool:
    """Two particular words, or one among three or more."""
    n = sum(not (w.tells or w.connects or w.stop) and (w.strong or w.suffix or len(w.text) >= 6) for w in words)
    return len(words) >= 2 and (n >= 2 or (n == 1 and len(words) >= 3))


def _vague(words: list[Word]) -> bool:
    """With a weak word, and not clearly a name in spite of it."""
    rest = [w for w in words if w.meaning]
    clear = len(rest) >= 2 and (sum(w.specific for w in rest) >= 2 or (_named(rest) and any(w.proper for w in rest)))
    return any(w.weak for w in words) and not clear


def _open_end(words: list[Word]) -> bool:
    return words[-1].weak or words[-1].connects


def _flaws(words: list[Word], after_trigger: bool) -> Iterator[str]:
    """Why the words name nothing, the weightiest first."""
    if len(words) < 2:
        yield "entity_too_short"
        return
    if not after_trigger and " ".join(w.text for w in words) in lx.ENTITY_PHRASES:
        yield "generic_entity_phrase"
    if _open_end(words) or (not after_trigger and words[0].connects):
        yield "generic_boundary_term"
    if _vague(words):
        yield "weak_entity_phrase"
    if sum(not w.stop and not (w.connects if after_trigger else w.generic) for w in words) < 2:
        yield "insufficient_relevant_terms"
    proper = any(w.proper for w in words)
    if not after_trigger and not proper and any(w.connects for w in words):
        yield "structural_phrase_without_proper_name"
    if not proper and not any(w.strong or (after_trigger and w.suffix) for w in words):
        yield "missing_strong_noun"


def _trim(words: list[Word]) -> list[Word]:
    """Without classifiers and then connectors before a name, and words that can't end one."""
    a, z = 0, len(words)
    while a < z and words[a].text in lx.ENTITY_CLASSIFIERS:
        a += 1
    while a < z and words[a].connects:
        a += 1
    while a < z and words[z - 1].text in lx.ENTITY_LAST:
        z -= 1
    return words[a:z]


def _after_trigger(words: list[Word]) -> list[Word]:
    """The name after the last "discovery of" and its like, or nothing."""
    starts = [i + 2 for i, (w, then) in enumerate(zip(words, words[1:])) if w.text in lx.ENTITY_TRIGGERS and then.text in ("de", "del")]
    tail = _trim(words[starts[-1]:]) if starts else []
    told = [i for i, w in enumerate(tail) if not w.tells]
    tail = tail[told[0] : told[-1] + 1] if told else []
    ends = [tail[i:] for i in range(len(tail) - 1)]
    if not (len(tail) > 2 and " ".join(w.text for w in tail[:2]) == lx.ENTITY_WHOLE):
        first = next((i for i, e in enumerate(ends) if _named(e)), 0)
        ends = ends[first:]
    return next((t for t in map(_trim, ends) if not any(_flaws(t, True))), [])


def main_entity(normalised: str) -> tuple[str, str]:
    """(entity, "") or ("", why not) of a normalised question: what follows a trigger, or else the
    first run of four words that names something, of three words, or the first two words."""
    words = [Word(w) for w in normalised.split()]
    if not words:
        return "", "empty_query"
    found = _after_trigger(words)
    if found:
        return " ".join(w.text for w in found), ""
    if len(words) < 2:
        return "", "no_strong_entity_candidate"
    runs = [words[i : i + n] for n in (4, 3) for i in range(len(words) - n + 1)]
    for run in [*runs, words[:2]]:
        why = next(_flaws(run, False), "")
        if not why:
            return " ".join(w.text for w in run), ""
    return "", why


def filters(entity: str) -> bool:
    """Whether chunks are asked to hold the entity: long enough, of two words, with an end, and not vague."""
    words = [Word(w) for w in entity.split()]
    return len(entity.strip()) >= lx.MIN_ENTITY and len(words) >= 2 and not _open_end(words) and not _vague(words)
