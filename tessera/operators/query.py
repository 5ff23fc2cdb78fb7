"""The query language: clauses, phrases, required and prohibited terms, OR groups.

``field:term``, ``"a phrase"``, ``+required``, ``-prohibited``; ``OR`` starts a
new group. A group matches if all its required clauses and phrases match and
no prohibited one does; bare clauses matter for matching only where there is no
required clause or phrase, and then one of them must match.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from tessera.functions.text import STEM, STOPWORDS

_CLAUSE = re.compile(r'([+-]?)(?:([A-Za-z_][A-Za-z0-9_]*):)?(?:"([^"]*)"|(\S+))')
_TOKEN = re.compile(r"[^\W_]+")
_STEM = re.compile(STEM)


class QueryError(ValueError):
    """A query that can't be read."""


@dataclass(frozen=True)
class Clause:
    field: str
    text: str
    phrase: bool = False
    required: bool = False
    prohibited: bool = False

    @property
    def terms(self) -> tuple[str, ...]:
        return analyze(self.text)


def analyze(text: str) -> tuple[str, ...]:
    """The terms that ``functions.text.analyzed_terms`` gives for a query's words."""
    return tuple(_STEM.sub(r"\1", w) for w in (t.lower() for t in _TOKEN.findall(text)) if w not in STOPWORDS)


def parse(text: str, default_field: str = "text") -> tuple[tuple[Clause, ...], ...]:
    """Groups of clauses; refuses empty queries, open quotes, dangling ORs, signs and colons without a word, empty phrases and groups that only exclude."""
    if text.count('"') % 2:
        raise QueryError("a quote is not closed")
    groups: list[list[Clause]] = [[]]
    for sign, field, phrase, word in _CLAUSE.findall(text):
        if word == "OR" and not sign and not field:
            groups.append([])
            continue
        if not (phrase.strip() or word.strip("+-:")) or word.startswith(":") or word.endswith(":"):
            raise QueryError("a sign, a colon or a pair of quotes needs a word")
        groups[-1].append(Clause(field or default_field, phrase or word, bool(phrase), sign == "+", sign == "-"))
    if groups == [[]]:
        raise QueryError("the query is empty")
    if any(not g for g in groups):
        raise QueryError("OR needs clauses on both sides")
    if any(all(c.prohibited for c in g) for g in groups):
        raise QueryError("a group needs something to look for")
    return tuple(map(tuple, groups))


def canonical(groups: tuple[tuple[Clause, ...], ...]) -> str:
    """One spelling of a query: clauses sorted within groups, groups sorted."""
    sign = lambda c: "+" if c.required else "-" if c.prohibited else ""
    shown = lambda c: f'{sign(c)}{c.field}:"{c.text}"' if c.phrase else f"{sign(c)}{c.field}:{c.text}"
    return " OR ".join(sorted(" ".join(sorted({shown(c) for c in g})) for g in groups))
