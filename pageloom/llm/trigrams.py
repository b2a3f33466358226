"""Boolean trigram queries derived from regular expressions.

A query is True (says nothing), a string of three bytes, or ("and" | "or", frozenset of
queries). A text can match the expression only if its lower-cased trigrams satisfy it.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as parser
from dataclasses import dataclass
from itertools import product

#: A set of exact strings larger than this is turned into a query and forgotten.
MOST_STRINGS = 64
#: Character classes with more members than this count as any character.
MOST_CHARACTERS = 8

Query = object


def _join(kind: str, parts) -> Query:
    flat: set = set()
    for part in parts:
        if part is True:
            if kind == "or":
                return True
            continue
        flat |= part[1] if isinstance(part, tuple) and part[0] == kind else {part}
    if not flat:
        return True
    return next(iter(flat)) if len(flat) == 1 else (kind, frozenset(flat))


def _of_string(text: str) -> Query:
    raw = text.encode().lower()
    return _join("and", [raw[i : i + 3] for i in range(len(raw) - 2)])


def _of_strings(strings: frozenset[str]) -> Query:
    return _join("or", [_of_string(s) for s in strings]) if strings else True


@dataclass(frozen=True)
class _Known:
    """What is known of an expression's matches: all of them, or how they begin and end, besides a query."""

    exact: frozenset[str] | None
    head: frozenset[str]
    tail: frozenset[str]
    query: Query


_ANY = _Known(None, frozenset([""]), frozenset([""]), True)


def _short(strings: frozenset[str], front: bool) -> frozenset[str]:
    cut = frozenset(s[:3] if front else s[-3:] for s in strings)
    return cut if len(cut) <= MOST_STRINGS else frozenset([""])


def _open(k: _Known) -> _Known:
    """The same without the complete strings."""
    if k.exact is None:
        return k
    return _Known(None, _short(k.exact, True), _short(k.exact, False), _join("and", [k.query, _of_strings(k.exact)]))


def _concat(a: _Known, b: _Known) -> _Known:
    if a.exact is not None and b.exact is not None and len(a.exact) * len(b.exact) <= MOST_STRINGS:
        return _Known(frozenset(x + y for x, y in product(a.exact, b.exact)), frozenset(), frozenset(), _join("and", [a.query, b.query]))
    head = frozenset(x + y for x in a.exact for y in (b.exact or b.head)) if a.exact is not None else a.head
    tail = frozenset(x + y for x in (a.exact or a.tail) for y in b.exact) if b.exact is not None else b.tail
    x, y = _open(a), _open(b)
    across = frozenset(p + q for p, q in product(x.tail, y.head))
    across_query = _of_strings(across) if len(across) <= MOST_STRINGS**2 and "" not in across else True
    return _Known(None, _short(head, True) if "" not in head else x.head, _short(tail, False) if "" not in tail else y.tail, _join("and", [x.query, y.query, across_query]))


def _either(parts: list[_Known]) -> _Known:
    if all(p.exact is not None for p in parts):
        strings = frozenset().union(*(p.exact for p in parts))
        if len(strings) <= MOST_STRINGS:
            return _Known(strings, frozenset(), frozenset(), _join("or", [p.query for p in parts]) if all(p.query is not True for p in parts) else True)
    opened = [_open(p) for p in parts]
    head, tail = (frozenset().union(*(getattr(p, x) for p in opened)) for x in ("head", "tail"))
    return _Known(None, _short(head, True), _short(tail, False), _join("or", [p.query for p in opened]))


def _class(items) -> _Known:
    found: set[str] = set()
    for op, value in items:
        if op is sre.LITERAL:
            found.add(chr(value))
        elif op is sre.RANGE and value[1] - value[0] < MOST_CHARACTERS:
            found |= {chr(c) for c in range(value[0], value[1] + 1)}
        else:
            return _ANY
    return _Known(frozenset(found), frozenset(), frozenset(), True) if len(found) <= MOST_CHARACTERS else _ANY


def _walk(items) -> _Known:
    out = _Known(frozenset([""]), frozenset(), frozenset(), True)
    for op, value in items:
        if op is sre.LITERAL:
            part = _Known(frozenset([chr(value)]), frozenset(), frozenset(), True)
        elif op is sre.IN:
            part = _class(value)
        elif op is sre.SUBPATTERN:
            part = _walk(value[3])
        elif op is sre.BRANCH:
            part = _either([_walk(x) for x in value[1]])
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
            low, high, body = value
            one = _walk(body)
            if (low, high) == (0, 1):
                part = _either([one, _Known(frozenset([""]), frozenset(), frozenset(), True)])
            elif low == 0:
                part = _ANY
            else:
                opened = _open(one)
                part = one if high == 1 else _Known(None, opened.head, opened.tail, opened.query)
        elif op in (sre.AT, sre.ASSERT, sre.ASSERT_NOT):
            part = _Known(frozenset([""]), frozenset(), frozenset(), True)
        else:
            part = _ANY
        out = _concat(out, part)
    return out


def trigram_query(pattern: str) -> Query:
    """The query of a pattern; True if no trigram is mandatory, so that every text is to be scanned."""
    return _open(_walk(parser.parse(pattern))).query


def trigrams_in(query: Query) -> set[bytes]:
    if query is True:
        return set()
    return {query} if isinstance(query, bytes) else set().union(*(trigrams_in(x) for x in query[1]))
