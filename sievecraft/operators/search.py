"""A small search language, compiled to a Column.

Words side by side must all occur; OR or a comma separates alternatives; a leading - or !
or a NOT before a word excludes it from every alternative; quotes make a phrase. The text
is split into alternatives before quotes are looked at, so that OR and commas split even
inside quotes. A lone - is a word.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: what separates alternatives, and what a token is
_ALTERNATIVES = re.compile(r"\s+or\s+|,", re.IGNORECASE)
_TOKEN = re.compile(r'(?P<neg>[-!]?)"(?P<phrase>[^"]*)"|(?P<bare>\S+)')


@dataclass
class Query:
    """alternatives: each a list of terms that must all occur; exclude: terms none of which may."""

    alternatives: list[list[str]] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)

    @property
    def active(self) -> bool:
        return bool(self.alternatives or self.exclude)


def parse_query(raw: str) -> Query:
    query = Query()
    for part in _ALTERNATIVES.split(raw or ""):
        terms: list[str] = []
        negate_next = False
        for token in _TOKEN.finditer(part):
            if token["phrase"] is not None:
                text, negated = token["phrase"], bool(token["neg"])
            else:
                text, negated = token["bare"], False
                if text.lower() == "not":
                    negate_next = True
                    continue
                if len(text) > 1 and text[0] in "-!":
                    text, negated = text[1:], True
            text = text.strip().lower()
            negated, negate_next = negated or negate_next, False
            if text:
                (query.exclude if negated else terms).append(text)
        if terms:
            query.alternatives.append(terms)
    return query


def matches(query: Query, text: Column) -> Column:
    """Whether lower-cased text satisfies the query; substrings count. An inactive query matches all."""
    contains = lambda t: F.contains(text, F.lit(t))
    out = F.lit(True)
    if query.alternatives:
        out = reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, map(contains, terms)) for terms in query.alternatives])
    return reduce(lambda a, t: a & ~contains(t), query.exclude, out)


def searchable_text(name: Column, tags: Column | None = None, sources: Column | None = None, scope: str = "names") -> Column:
    """Lower-cased text to search: name, tags (an array), and for each source its name and, in scope "all", its file and bank."""
    parts = [name]
    if tags is not None:
        parts.append(F.when(F.size(tags) > 0, F.array_join(tags, " ")))
    if sources is not None:
        one = (lambda s: F.concat_ws(" ", s["name"], s["file"], s["bank"])) if scope == "all" else (lambda s: s["name"])
        parts.append(F.when(F.size(sources) > 0, F.array_join(F.transform(sources, one), " ")))
    return F.lower(F.concat_ws(" ", *parts))


def name_tokens(name: Column, stop_words: list[str], shortest: int = 3, longest: int = 12) -> Column:
    """Distinct upper-cased runs of A-Z of allowed length, in order, without stop words."""
    words = F.split(F.upper(name), "[^A-Z]+")
    stop = F.array(*[F.lit(w) for w in stop_words]) if stop_words else F.array().cast("array<string>")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= shortest) & (F.length(w) <= longest) & ~F.array_contains(stop, w)))
