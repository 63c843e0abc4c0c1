"""A search request and how its text is read."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from ..functions.text import norm_of, request_grams, units

MODES = ("any", "only0", "only1")
SORTS = ("relevance", "id_desc", "id_asc")
#: White space by which terms are split.
SPACE = re.compile("[\t-\r \xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]+")
SIGNS = ("-", "\uff0d")


@dataclass(frozen=True)
class Request:
    q: str = ""
    tags: tuple[int, ...] = ()
    exclude_tags: tuple[int, ...] = ()
    hidden: str = "any"
    hide_chapter: str = "any"
    need_login: str = "any"
    lock: str = "any"
    sort: str = "relevance"
    page: int = 1
    size: int = 20

    def __post_init__(self):
        for mode in (self.hidden, self.hide_chapter, self.need_login, self.lock):
            if mode not in MODES:
                raise ValueError(f"{mode!r} is none of {MODES}")
        if self.sort not in SORTS:
            raise ValueError(f"{self.sort!r} is none of {SORTS}")

    @property
    def offset(self) -> int:
        return (max(1, int(self.page)) - 1) * self.limit

    @property
    def limit(self) -> int:
        return min(100, max(1, int(self.size)))

    @property
    def filtered(self) -> bool:
        return bool(self.tags or self.exclude_tags) or {self.hidden, self.hide_chapter, self.need_login, self.lock} != {"any"}

    def key(self) -> tuple:
        """Equal for requests with the same matches in the same order."""
        t = parse(self.q)
        return (self.sort, self.hidden, self.hide_chapter, self.need_login, self.lock, self.tags, self.exclude_tags, *t)


@dataclass(frozen=True)
class Term:
    text: str
    grams: tuple[str, ...] = field(default=())

    @property
    def n(self) -> int:
        return len(self.grams)


def parse(q: str) -> tuple[tuple[Term, ...], tuple[Term, ...]]:
    """Terms to include and to exclude, each once, in the order of their UTF-16 units."""
    include, exclude = set(), set()
    for part in filter(None, SPACE.split(q)):
        signed = part[0] in SIGNS and len(part) > 1
        term = norm_of(part[1:] if signed else part)
        if len(units(term)) >= 2:
            (exclude if signed else include).add(term)
    order = lambda terms: tuple(Term(t, tuple(request_grams(t))) for t in sorted(terms, key=lambda t: t.encode("utf-16-be")))
    return order(include - exclude), order(exclude)


def threshold(n: int, found: int) -> int:
    """Grams that a document has to share: three in five of n, of those that the index knows."""
    return min(max(1, (3 * n + 4) // 5), found)


def resolve_tags(known: dict[int, str], tags: tuple[int | str, ...] = (), exclude: tuple[int | str, ...] = ()) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """The ids of chosen tags, given by id or name: unknown ones go, each stays once, and what is both chosen and
    excluded is chosen. known: the dictionary's names by id; a name of several ids means the least."""
    by_name: dict[str, int] = {}
    for i, name in sorted(known.items(), reverse=True):
        by_name[name] = i
    found = lambda given: dict.fromkeys(i for t in given if (i := t if t in known else by_name.get(t)) is not None)
    chosen = found(tags)
    return tuple(chosen), tuple(i for i in found(exclude) if i not in chosen)
