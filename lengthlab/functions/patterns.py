"""The first of many patterns that fits a name, for lists of any length.

Kinds of patterns: "name" equals the name or is a dotted ending of it; "rank" is a regular expression for the name or for
a dotted ending; "skip" is a regular expression for the beginning of the name, or a bare ending of it; "all" fits if the
pattern is "*" and else as "name" does. Patterns are tried in order and the first that fits wins.

Names are not held against every pattern. A literal that each name must hold is read from the pattern; one automaton
finds all literals in a name, and only the patterns of found literals, and those without any, are tried.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from re import _constants as C
from re import _parser

import ahocorasick
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

KINDS = ("name", "rank", "skip", "all")


def required_literal(pattern: str) -> str:
    """The longest text that every match of the regular expression holds; empty if none is sure."""
    best, run = "", ""

    def end() -> None:
        nonlocal best, run
        best, run = max(best, run, key=len), ""

    def walk(parsed) -> None:
        nonlocal run
        for op, value in parsed:
            if op is C.LITERAL:
                run += chr(value)
            elif op is C.SUBPATTERN and not value[1]:  # without flags of its own
                walk(value[-1])
            else:
                end()
                if op in (C.MAX_REPEAT, C.MIN_REPEAT) and value[0] > 0:
                    walk(value[2])
                    end()

    parsed = _parser.parse(pattern)
    if parsed.state.flags & re.IGNORECASE:
        return ""
    walk(parsed)
    end()
    return best


def _dotted(name: str, ending: str) -> bool:
    return name == ending or name.endswith("." + ending)


def _test(kind: str, pattern: str) -> Callable[[str], bool]:
    if kind == "all" and pattern == "*":
        return lambda name: True
    if kind in ("name", "all"):
        return lambda name: _dotted(name, pattern)
    whole = re.compile(rf"(?:.*\.)?(?:{pattern})$" if kind == "rank" else pattern)
    if kind == "rank":
        return lambda name: whole.match(name) is not None
    return lambda name: name.endswith(pattern) or whole.match(name) is not None


@lru_cache(maxsize=8)
def matcher(kind: str, patterns: tuple[str, ...]) -> Callable[[str], int | None]:
    """A function from a name to the place of the first pattern that fits."""
    if kind not in KINDS:
        raise ValueError(f"patterns are {', '.join(KINDS)}, not {kind}")
    tests = [_test(kind, p) for p in patterns]
    always: list[int] = []
    by_literal: dict[str, set[int]] = {}
    for place, pattern in enumerate(patterns):
        literals = {required_literal(pattern)} if kind in ("rank", "skip") else {"" if kind == "all" and pattern == "*" else pattern}
        literals |= {pattern} if kind == "skip" else set()
        if "" in literals:
            always.append(place)
            continue
        for literal in literals:
            by_literal.setdefault(literal, set()).add(place)
    automaton = ahocorasick.Automaton()
    for literal, places in by_literal.items():
        automaton.add_word(literal, places)
    if by_literal:
        automaton.make_automaton()

    def first(name: str) -> int | None:
        likely = set(always)
        if by_literal:
            for _, places in automaton.iter(name):
                likely |= places
        return next((place for place in sorted(likely) if tests[place](name)), None)

    return first


def first_match(name: Column | str, patterns: list[str], kind: str) -> Column:
    """The 0-based place of the first pattern that fits the name; null if none does, or for a null name."""
    listed = tuple(patterns)
    matcher(kind, listed)  # a bad pattern is an error here, not in a task

    @F.pandas_udf("int")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        fits = matcher(kind, listed)
        for names in parts:
            known = {n: fits(n) for n in names.dropna().unique()}
            yield pd.Series([known.get(n) if n is not None else None for n in names], dtype="Int32")

    return run(F.col(name) if isinstance(name, str) else name)
