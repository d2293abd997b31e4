"""Many patterns against many texts: an index of what each pattern can't do without.

A rule is a row (number, format, pattern). From its pattern come clauses of literals: a text that the pattern matches holds
one literal of each clause. One pass of a multi-pattern automaton over a text finds all literals of all rules, the clauses
name the candidates, and patterns are tried for these alone, in the order of the rules, up to the first that matches. So a
text costs about the same for thirty rules and for thousands.
"""

from __future__ import annotations

import re
import warnings
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

try:
    from re import _constants as codes
    from re import _parser as parser
except ImportError:  # older Pythons
    import sre_constants as codes
    import sre_parse as parser

#: Literals shorter than this are in too many texts to tell anything.
SHORTEST = 3

Clause = tuple[str, ...]


@dataclass(frozen=True)
class Rule:
    """number gives the priority, the smallest first; format is what a match says."""

    number: int
    format: str
    pattern: str


def _weight(clause: Clause) -> int:
    return min(map(len, clause))


def _clauses(parts) -> list[Clause]:
    """Clauses of a parsed pattern; each literal in small letters."""
    out, run = [], ""

    def close() -> None:
        nonlocal run
        if run:
            out.append((run,))
        run = ""

    for kind, value in parts:
        if kind is codes.LITERAL and value < 128:
            run += chr(value).lower()
            continue
        if kind is codes.SUBPATTERN and value[0] is None and not value[1]:
            # A group that only keeps things together goes on with the run, if it is one plain text.
            inner = list(value[3])
            if all(k is codes.LITERAL and v < 128 for k, v in inner):
                run += "".join(chr(v).lower() for _, v in inner)
                continue
        close()
        if kind is codes.SUBPATTERN:
            out += _clauses(value[3])
        elif kind in (codes.MAX_REPEAT, codes.MIN_REPEAT) and value[0] > 0 or kind is getattr(codes, "POSSESSIVE_REPEAT", None) and value[0] > 0:
            out += _clauses(value[2])
        elif kind is codes.ASSERT and value[0] > 0:
            out += _clauses(value[1])
        elif kind is codes.BRANCH:
            ways = [_clauses(way) for way in value[1]]
            if all(ways):
                out.append(tuple(dict.fromkeys(x for way in ways for x in max(way, key=_weight))))
    close()
    return out


def needed(pattern: str, shortest: int = SHORTEST) -> list[Clause]:
    """Of each clause, a text that the pattern matches holds one literal, in letters of either case; [] where nothing is certain.

    Patterns that can't be parsed here have no clause, and so are always tried.
    """
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            found = _clauses(parser.parse(pattern.replace(r"\z", r"\Z")))
    except (re.error, OverflowError):
        return []
    return sorted({c for c in found if _weight(c) >= shortest}, key=lambda c: (-_weight(c), c))


def guard(text: Column, low: Column, pattern: str) -> Column:
    """Whether text matches the pattern, tried only where low, the text in small letters, holds what it needs."""
    tests = [reduce(lambda a, b: a | b, [low.contains(x) for x in clause]) for clause in needed(pattern)[:2]]
    return reduce(lambda a, b: a & b, [*tests, text.rlike(pattern)])


class RuleIndex:
    """An automaton over the literals of a bounded list of rules; it goes to the workers as the rules themselves."""

    def __init__(self, rules: list[Rule], shortest: int = SHORTEST):
        self.rules = sorted(rules, key=lambda r: r.number)
        self.clauses = [needed(r.pattern, shortest) for r in self.rules]
        #: Numbers of rules by literal and clause, and of those that are always tried.
        self.always = [k for k, c in enumerate(self.clauses) if not c]
        self.literals = sorted({x for clauses in self.clauses for clause in clauses for x in clause})

    def candidates(self, text: Column) -> Column:
        """The places of the rules that may match a text, in order; none for null."""
        literals, clauses, always = self.literals, self.clauses, self.always
        by_literal: dict[str, list[tuple[int, int]]] = {}
        for k, own in enumerate(clauses):
            for c, clause in enumerate(own):
                for x in clause:
                    by_literal.setdefault(x, []).append((k, c))
        sizes = [len(c) for c in clauses]
        held: list = []

        def named(texts: pd.Series) -> pd.Series:
            if not held:
                import ahocorasick

                automaton = ahocorasick.Automaton()
                for i, x in enumerate(literals):
                    automaton.add_word(x, i)
                if literals:
                    automaton.make_automaton()
                held.append(automaton)
            out = []
            for t in texts:
                if t is None:
                    out.append([])
                    continue
                seen = {i for _, i in held[0].iter(t.lower())} if literals else set()
                met: dict[int, set[int]] = {}
                for i in seen:
                    for k, c in by_literal[literals[i]]:
                        met.setdefault(k, set()).add(c)
                out.append(sorted(always + [k for k, c in met.items() if len(c) == sizes[k]]))
            return pd.Series(out)

        return F.pandas_udf(named, "array<int>")(text)

    def first(self, text: Column, candidates: Column) -> Column:
        """The place of the first candidate whose pattern matches, or null; later ones aren't tried."""
        patterns = F.array(*(F.lit(r.pattern) for r in self.rules)) if self.rules else F.array().cast("array<string>")
        return F.aggregate(candidates, F.lit(None).cast("int"), lambda found, k: F.coalesce(found, F.when(F.rlike(text, F.get(patterns, k)), k)))

    def format(self, place: Column) -> Column:
        return F.get(F.array(*(F.lit(r.format) for r in self.rules)), place) if self.rules else F.lit(None).cast("string")

    def number(self, place: Column) -> Column:
        return F.get(F.array(*(F.lit(r.number) for r in self.rules)), place) if self.rules else F.lit(None).cast("int")
