"""A trigram index over chunks of text, and what a regex needs of it.

What a match of a regex must contain is derived from the regex's parse tree as a formula of trigrams: all parts of a sequence, any of
the alternatives, small sets of characters written out. The index keeps for each trigram that some formula names the chunks that have
it; a formula is answered by intersecting and uniting these postings. Texts are looked at in lower case, as UTF-8.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from re import _constants as sre  # the engine's own parse trees
from re import _parser as sre_parser

import numpy as np

#: Strings that the sets of a part hold at most; a larger set tells nothing.
MOST = 256
SPACES = tuple(chr(c) for c in range(0x3001) if chr(c).isspace())

#: A formula is True (anything), a trigram, or ("and" | "or", parts).
Formula = bool | str | tuple


def both(*parts: Formula) -> Formula:
    """All of the parts."""
    flat = {q for p in parts if p is not True for q in (p[1] if isinstance(p, tuple) and p[0] == "and" else (p,))}
    return True if not flat else next(iter(flat)) if len(flat) == 1 else ("and", frozenset(flat))


def either(*parts: Formula) -> Formula:
    """Any of the parts."""
    if any(p is True for p in parts):
        return True
    flat = {q for p in parts for q in (p[1] if isinstance(p, tuple) and p[0] == "or" else (p,))}
    return next(iter(flat)) if len(flat) == 1 else ("or", frozenset(flat))


def _grams(text: str) -> Formula:
    return both(*[text[i : i + 3] for i in range(len(text) - 2)])


@dataclass(frozen=True)
class _Part:
    """What is known of a part: all its matches where they are few, else how those that are not empty begin and end, and what each needs."""

    exact: frozenset[str] | None
    begin: frozenset[str]
    end: frozenset[str]
    empty: bool
    need: Formula


_UNKNOWN = frozenset([""])


def _small(strings: set[str]) -> frozenset[str]:
    return frozenset(strings) if len(strings) <= MOST else _UNKNOWN


def _exactly(strings: set[str] | frozenset[str]) -> _Part:
    filled = {s for s in strings if s}
    return _Part(frozenset(strings), _small({s[:3] for s in filled}), _small({s[-3:] for s in filled}), "" in strings, either(*[_grams(s) for s in strings]))


def _sequence(x: _Part, y: _Part) -> _Part:
    if x.exact is not None and y.exact is not None and len(x.exact) * len(y.exact) <= MOST and max(map(len, x.exact)) + max(map(len, y.exact)) <= 32:
        return _exactly({a + b for a in x.exact for b in y.exact})
    xs, ys = x.exact if x.exact is not None else x.end | (_UNKNOWN if x.empty else set()), y.exact if y.exact is not None else y.begin | (_UNKNOWN if y.empty else set())
    across = {a[-2:] + b[:2] for a in xs for b in ys}
    if x.exact is not None:
        begin = {(a + b)[:3] for a in x.exact for b in ys} if len(x.exact) * len(ys) <= 4 * MOST else {a[:3] for a in x.exact}
    else:
        begin = set(x.begin) | (set(ys) if x.empty else set())
    if y.exact is not None:
        end = {(a + b)[-3:] for a in xs for b in y.exact} if len(y.exact) * len(xs) <= 4 * MOST else {b[-3:] for b in y.exact}
    else:
        end = set(y.end) | (set(xs) if y.empty else set())
    begin, end = _small(begin), _small(end)
    need = both(x.need, y.need, either(*[_grams(s) for s in across]) if len(across) <= 4 * MOST else True, either(*[_grams(s) for s in begin]), either(*[_grams(s) for s in end]))
    return _Part(None, begin, end, x.empty and y.empty, need)


def _choice(x: _Part, y: _Part) -> _Part:
    if x.exact is not None and y.exact is not None and len(x.exact | y.exact) <= MOST:
        return _exactly(x.exact | y.exact)
    return _Part(None, _small(set(x.begin | y.begin)), _small(set(x.end | y.end)), x.empty or y.empty, either(x.need, y.need))


_NOTHING = _exactly({""})
_ANY_CHARACTER = _Part(None, _UNKNOWN, _UNKNOWN, False, True)


def _of_set(items) -> _Part:
    chars: set[str] = set()
    for op, arg in items:
        if op is sre.LITERAL:
            chars.add(chr(arg).lower())
        elif op is sre.RANGE and arg[1] - arg[0] < 64:
            chars |= {chr(c).lower() for c in range(arg[0], arg[1] + 1)}
        elif op is sre.CATEGORY and arg is sre.CATEGORY_SPACE:
            chars |= set(SPACES)
        else:
            return _ANY_CHARACTER
    return _exactly(chars)


def _walk(items) -> _Part:
    parts = []
    for op, arg in items:
        if op is sre.LITERAL:
            parts.append(_exactly({chr(arg).lower()}))
        elif op is sre.IN:
            parts.append(_of_set(arg))
        elif op is sre.SUBPATTERN:
            parts.append(_walk(arg[3]))
        elif op is sre.BRANCH:
            options = [_walk(option) for option in arg[1]]
            whole = options[0]
            for option in options[1:]:
                whole = _choice(whole, option)
            parts.append(whole)
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
            inner = _walk(arg[2])
            if tuple(arg[:2]) == (0, 1):
                parts.append(_choice(inner, _NOTHING))
            elif tuple(arg[:2]) != (1, 1):
                least = arg[0]
                parts.append(_Part(None, inner.begin, inner.end, inner.empty or least == 0, inner.need if least else True))
            else:
                parts.append(inner)
        elif op in (sre.AT, sre.ASSERT, sre.ASSERT_NOT):
            continue
        else:
            parts.append(_ANY_CHARACTER)
    whole = _NOTHING
    for part in reversed(parts):  # from the end, so that what follows a part that may be missing is known when it is joined
        whole = _sequence(part, whole)
    return whole


def required(pattern: str) -> Formula:
    """The trigrams, in lower case, that any text with a match contains; True where none is sure."""
    return _walk(sre_parser.parse(pattern)).need


def names(formula: Formula) -> set[str]:
    if formula is True:
        return set()
    return {formula} if isinstance(formula, str) else set().union(*map(names, formula[1]))


def holds(formula: Formula, text: str) -> bool:
    """Whether a text has what the formula asks for."""
    if formula is True:
        return True
    if isinstance(formula, str):
        return formula in text
    return (all if formula[0] == "and" else any)(holds(p, text) for p in formula[1])


class Postings:
    """For each trigram the chunks that have it, as bits."""

    def __init__(self, rows: dict[str, list[int]], bits: np.ndarray) -> None:
        self.rows, self.bits = rows, bits

    def answer(self, formula: Formula) -> np.ndarray:
        if formula is True:
            return np.ones(self.bits.shape[1], dtype=bool)
        if isinstance(formula, str):
            return self.bits[self.rows[formula]].all(axis=0)
        return (np.logical_and if formula[0] == "and" else np.logical_or).reduce([self.answer(p) for p in formula[1]])


class TrigramIndex:
    """Builds the postings of the trigrams that the formulas name."""

    def __init__(self, formulas: Sequence[Formula]) -> None:
        grams = sorted(set().union(*map(names, formulas)))
        # a trigram with a character beyond ASCII is more than three bytes: all of its triples of bytes are asked for
        triples = {g: [b[i : i + 3] for i in range(len(b) - 2)] for g in grams for b in [g.encode("utf-8", "surrogatepass")]}
        known = {t: i for i, t in enumerate(sorted({t for ts in triples.values() for t in ts}), 1)}
        self.rows = {g: [known[t] for t in ts] for g, ts in triples.items()}
        self.size = len(known) + 1
        self.place = np.zeros(1 << 24, dtype=np.uint16)
        for t, i in known.items():
            self.place[t[0] << 16 | t[1] << 8 | t[2]] = i

    def postings(self, chunks: Sequence[str]) -> Postings:
        """One pass over the chunks (in lower case)."""
        parts = [c.encode("utf-8", "surrogatepass") for c in chunks]
        bits = np.zeros((self.size, len(parts)), dtype=bool)
        text = np.frombuffer(b"\0\0".join(parts), dtype=np.uint8)
        if len(text) >= 3:
            starts = np.cumsum([0, *(len(p) + 2 for p in parts[:-1])])
            wide = text.astype(np.uint32)
            found = self.place[wide[:-2] << 16 | wide[1:-1] << 8 | wide[2:]]
            at = np.flatnonzero(found)
            bits[found[at], np.searchsorted(starts, at, side="right") - 1] = True
        return Postings(self.rows, bits)
