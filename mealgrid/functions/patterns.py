"""What a text must contain to match a regular expression.

The expression is read as far as ``requests.supported_pattern`` allows it:
characters, escapes, classes, groups, branches, repetitions. The result is an
and/or formula as a list of clauses; a matching text holds at least one gram of
each clause. An expression that demands nothing has no clauses. Only distinct
arguments are read, in Arrow batches; the texts are compared in Spark.
"""

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

GRAM = 3
# Different strings that a part of an expression may stand for before it is cut.
MOST = 16
Clauses = list[frozenset[str]]


def _grams(text: str) -> list[str]:
    return [text[i : i + GRAM] for i in range(len(text) - GRAM + 1)] if len(text) > GRAM else [text]


def _demands(strings: set[str]) -> Clauses:
    """Clauses for a text that holds one of the strings."""
    if not strings or "" in strings:
        return []
    if len(strings) == 1:
        return [frozenset([g]) for g in _grams(*strings)]
    # One clause from the beginnings and one from the ends: sound, if weaker than all combinations.
    return [frozenset(_grams(s)[k] for s in strings) for k in (0, -1)]


class _Reader:
    """A part is ``(strings, clauses)``: what it stands for exactly, or None, and what it demands beside."""

    def __init__(self, text: str):
        self.text, self.at = text, 0

    def peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def take(self) -> str:
        self.at += 1
        return self.text[self.at - 1]

    def branches(self) -> tuple[set[str] | None, Clauses]:
        parts = [self.sequence()]
        while self.peek() == "|":
            self.take()
            parts.append(self.sequence())
        if len(parts) == 1:
            return parts[0]
        if all(s is not None and not c for s, c in parts) and len(union := set().union(*(s for s, _ in parts))) <= MOST:
            return union, []
        # A clause of each branch, the one with the longest grams: one of them has to hold.
        chosen = []
        for strings, clauses in parts:
            clauses = clauses + (_demands(strings) if strings is not None else [])
            if not clauses:
                return None, []
            chosen.append(max(clauses, key=lambda c: (min(map(len, c)), -len(c))))
        return None, [frozenset().union(*chosen)]

    def sequence(self) -> tuple[set[str] | None, Clauses]:
        run, clauses, exact = {""}, [], True
        while self.peek() not in ("", "|", ")"):
            strings, demands = self.repeated()
            clauses += demands
            if strings is not None and len(run) * len(strings) <= MOST:
                run = {a + b for a in run for b in strings}
                continue
            clauses += _demands(run)
            exact = False
            run = {""}
            if strings is not None:
                # Too many combinations: this part begins a new run.
                run = strings
        if exact:
            return run, clauses
        return None, clauses + _demands(run)

    def repeated(self) -> tuple[set[str] | None, Clauses]:
        strings, clauses = self.atom()
        sign = self.peek()
        if not sign or sign not in "*+?{":
            return strings, clauses
        self.take()
        least, once = (1 if sign == "+" else 0), sign == "?"
        if sign == "{":
            number = ""
            while (c := self.take()) != "}":
                number += c
            least, once = int(number.split(",")[0]), number == "1"
        if self.peek() and self.peek() in "?+":
            self.take()
        if sign == "?" and strings is not None and not clauses and len(strings) < MOST:
            return strings | {""}, []
        if least == 0:
            return None, []
        return (strings, clauses) if once else (None, clauses + (_demands(strings) if strings is not None else []))

    def atom(self) -> tuple[set[str] | None, Clauses]:
        c = self.take()
        if c == "(":
            if self.text[self.at : self.at + 2] == "?:":
                self.at += 2
            inner = self.branches()
            self.take()
            return inner
        if c == "[":
            members = ""
            while (c := self.take()) != "]":
                members += c
            plain = not members.startswith("^") and "-" not in members
            return (set(members) if plain and len(members) <= MOST else None), []
        if c == "\\":
            escaped = self.take()
            return (None if escaped.isalnum() else {escaped}), []
        if c in "^$":
            return {""}, []
        return (None if c == "." else {c}), []


def clauses_of(pattern: str) -> Clauses:
    """Clauses of an expression; none if it cannot be read."""
    reader = _Reader(pattern)
    try:
        strings, clauses = reader.branches()
    except (IndexError, ValueError):
        return []
    if reader.at < len(pattern):
        return []
    return clauses + (_demands(strings) if strings is not None else [])


def necessary(pattern: Column) -> Column:
    """Clauses of an expression, as an array of arrays of grams."""

    @F.pandas_udf("array<array<string>>")
    def read(patterns: pd.Series) -> pd.Series:
        return patterns.map(lambda p: [] if p is None else [sorted(c) for c in dict.fromkeys(clauses_of(p))])

    return read(pattern)
