"""Texts that every match of a pattern must hold, and where in a text its matches can lie.

A pattern's syntax tree says which literal runs stand in every match; of those the most selective set is kept: one string, or the
strings of alternatives of which one must be there. A scan looks for the strings of all rules at once in one automaton and runs a
pattern only in texts that hold one of its strings, and, where a match has a bounded width, only around them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

#: Shorter strings say too little to be asked for; alternatives beyond this number cost more than they save.
LEAST_LENGTH, MOST_STRINGS = 3, 32
#: Matches that may be wider are searched in the whole text.
MOST_WIDTH = 2_000


@dataclass(frozen=True)
class Needs:
    """`strings`: lower-case ASCII, one of them is in every match (empty: unknown). `width`: characters around one of them that hold
    the whole match (None: unbounded, or the pattern looks at what lies outside of its match)."""

    strings: tuple[str, ...]
    width: int | None


def _better(a: tuple[str, ...] | None, b: tuple[str, ...] | None) -> tuple[str, ...] | None:
    """The more selective of two sets: longer shortest string, then fewer strings."""
    rank = lambda s: (min(map(len, s)), -len(s)) if s else (0, 0)
    return a if rank(a) >= rank(b) else b


def _strings(tree) -> tuple[str, ...] | None:
    """The best set of strings of a sequence of syntax nodes; None if nothing must be there."""
    best, run = None, ""
    for op, arg in [*tree, (None, None)]:
        name = str(op)
        if name == "LITERAL" and arg < 128:
            run += chr(arg).lower()
            continue
        inner = arg[3] if name == "SUBPATTERN" and not (arg[1] or arg[2]) else None
        if inner is not None and all(str(o) == "LITERAL" and a < 128 for o, a in inner):
            run += "".join(chr(a).lower() for _, a in inner)  # a group of plain characters continues the run
            continue
        if name == "BRANCH":  # a shared head continues the run: each way goes on from it
            ways = [_strings(way) for way in arg[1]]
            heads = [_head(way) for way in arg[1]]
            if all(heads) and run:
                best = _better(best, tuple(sorted({run + h for h in heads})))
            if all(ways):
                best = _better(best, tuple(sorted({s for w in ways for s in w})))
        elif name == "SUBPATTERN":
            best = _better(best, _strings(arg[3]))
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and arg[0] >= 1:
            best = _better(best, _strings(arg[2]))
        elif name == "ATOMIC_GROUP":
            best = _better(best, _strings(arg))
        if name != "AT" and run:  # an anchor has no width: the run goes on behind it
            best, run = _better(best, (run,)), ""
    return None if best is not None and len(best) > MOST_STRINGS else best


def _head(tree) -> str:
    out = ""
    for op, arg in tree:
        if str(op) != "LITERAL" or arg >= 128:
            break
        out += chr(arg).lower()
    return out


def _looks_outside(tree) -> bool:
    """Whether the pattern asks about characters beyond its match, word boundaries aside."""
    for op, arg in tree:
        name = str(op)
        if name in ("ASSERT", "ASSERT_NOT", "GROUPREF", "GROUPREF_EXISTS") or name == "AT" and "BOUNDARY" not in str(arg):
            return True
        parts = arg[1] if name == "BRANCH" else [arg[3]] if name == "SUBPATTERN" else [arg[2]] if name.endswith("_REPEAT") else [arg] if name == "ATOMIC_GROUP" else []
        if any(_looks_outside(p) for p in parts):
            return True
    return False


def needs(pattern: str) -> Needs:
    """What every match of `pattern` (case ignored in ASCII) must hold."""
    tree = re._parser.parse(pattern, re.IGNORECASE | re.ASCII)
    found = _strings(tree)
    if found is None or min(map(len, found)) < LEAST_LENGTH:
        return Needs((), None)
    low, high = tree.getwidth()
    return Needs(found, None if high > MOST_WIDTH or _looks_outside(tree) else int(high))


class RuleFinder:
    """The strings of many patterns in one automaton: which patterns may match a text at all."""

    def __init__(self, wanted: list[tuple[int, Needs]]):
        import ahocorasick

        at: dict[str, list[int]] = {}
        for i, n in wanted:
            for s in n.strings:
                at.setdefault(s, []).append(i)
        self.automaton = ahocorasick.Automaton() if at else None
        for s, rules in at.items():
            self.automaton.add_word(s, tuple(rules))
        if at:
            self.automaton.make_automaton()

    def rules_in(self, folded: str) -> list[int]:
        """Numbers of the patterns of which a string is in a text, in order; the text is folded by `fold`."""
        if self.automaton is None:
            return []
        return sorted({i for found in {f for _, f in self.automaton.iter(folded)} for i in found})


_UPPER = {c: c + 32 for c in range(65, 91)}


def fold(text: str) -> str:
    """ASCII letters in lower case, everything else as it is, so that offsets stay."""
    return text.lower() if text.isascii() else text.translate(_UPPER)


def matches(pattern: re.Pattern, need: Needs, text: str, folded: str) -> Iterator[re.Match]:
    """The same matches as `pattern.finditer(text)`, looked for only around the strings the pattern needs."""
    if not need.strings or need.width is None:
        yield from pattern.finditer(text)
        return
    spots = []
    for s in need.strings:
        at = folded.find(s)
        while at >= 0:
            spots.append((max(0, at + len(s) - need.width), at + need.width))
            at = folded.find(s, at + 1)
    spots.sort()
    i = 0
    while i < len(spots):
        start, end = spots[i]
        while i + 1 < len(spots) and spots[i + 1][0] <= end + 1:
            i += 1
            end = max(end, spots[i][1])
        # one character more than a match can reach, for a word boundary at its end
        yield from pattern.finditer(text, start, min(len(text), end + 1))
        i += 1
