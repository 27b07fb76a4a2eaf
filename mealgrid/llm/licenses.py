"""License scans by template markup.

A template is licence wording with marked regions: ``<<optional>> ...
<</optional>>`` may be absent, ``<<any:n>>`` stands for up to ``n`` words of
anything. It compiles to an automaton over words, and a text is accepted where
its words lead through the automaton: mandatory wording has to match word for
word. Base phrases are found beside it.

Words are runs of letters and digits, and of anything beyond ASCII, after
A-Z are lowered. The work on a document is one pass over its words, plus the
automaton where the first word of a template and its longest fixed wording
occur. There is no shuffle.

Null and empty texts have no words, no labels and score 0. The score is the
share of a text's words that stand in a match.
"""

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")

# Base phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Wording of well-known licence notices, with regions marked.
TEMPLATES = {
    "mit-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of <<any:8>> and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
        to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software""",
    "isc-text": """Permission to use, copy, modify, <<optional>> and/or <</optional>> <<optional>> and <</optional>> distribute this
        software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission
        notice appear in all copies""",
    "bsd-text": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met""",
    "apache-2-text": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use <<any:6>> except in compliance
        with the License""",
    "apache-2-notice": """Licensed under the Apache License, Version 2.0""",
    "gpl-3-notice": """licensed under the <<optional>> terms of the <</optional>> GNU General Public License, <<optional>> either
        <</optional>> version 3""",
    "gpl-2-notice": """licensed under the <<optional>> terms of the <</optional>> GNU General Public License, <<optional>> either
        <</optional>> version 2""",
    "mit-notice": """<<optional>> is <</optional>> <<optional>> are <</optional>> released under the <<optional>> terms of the
        <</optional>> MIT License""",
    "cc-by-nc-4-notice": """licensed under <<optional>> a <</optional>> <<optional>> the <</optional>> CC BY-NC 4.0""",
    "cc-by-4-notice": """licensed under <<optional>> a <</optional>> <<optional>> the <</optional>> CC BY 4.0""",
    "mpl-2-notice": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0""",
}

MARK = re.compile(r"<<(/?)(optional|any)(?::(\d+))?>>")


def words(text: str) -> list[bytes]:
    return WORD.findall(text.encode("utf-8", "surrogatepass").lower())


@dataclass
class Automaton:
    """States are numbers; ``arcs`` by word, ``free`` by any word, ``skip`` without one."""

    arcs: list[dict[bytes, int]] = field(default_factory=lambda: [{}])
    free: dict[int, int] = field(default_factory=dict)
    skip: dict[int, list[int]] = field(default_factory=dict)
    fixed: bytes = b""

    def closure(self, states: set[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for t in self.skip.get(todo.pop(), ()):
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)

    def __post_init__(self) -> None:
        self.moves: dict[tuple[frozenset[int], bytes], frozenset[int]] = {}

    def ready(self) -> "Automaton":
        self.known = {w for a in self.arcs for w in a}
        self.start = self.closure({0})
        self.final = len(self.arcs) - 1
        self.first = {w for s in self.start for w in self.arcs[s]}
        return self

    def end(self, text: list[bytes], at: int) -> int:
        """End of the longest match that starts at ``at``, or -1."""
        states, last = self.start, -1
        for k in range(at, len(text)):
            word = text[k] if text[k] in self.known else b""
            key = (states, word)
            if key not in self.moves:
                new = {self.arcs[s][word] for s in states if word in self.arcs[s]}
                self.moves[key] = self.closure(new | {self.free[s] for s in states if s in self.free})
            states = self.moves[key]
            if not states:
                break
            if self.final in states:
                last = k + 1
        return last


def compiled(template: str) -> Automaton:
    """The automaton of one template; determinized as it runs."""
    a, opened, run, runs = Automaton(), [], [], []

    def state() -> int:
        a.arcs.append({})
        return len(a.arcs) - 1

    at, here = 0, 0
    for m in [*MARK.finditer(template), None]:
        for w in words(template[at : m.start() if m else len(template)]):
            new = state()
            a.arcs[here][w] = new
            here = new
            if not opened:
                run.append(w)
        if m is None:
            break
        at = m.end()
        runs.append(run)
        run = []
        if m[2] == "any":
            entry = here
            steps = []
            for _ in range(int(m[3] or 1)):
                new = state()
                a.free[here] = new
                steps.append(here)
                here = new
            for s in [entry, *steps]:
                a.skip.setdefault(s, []).append(here)
        elif not m[1]:
            new = state()
            a.skip.setdefault(here, []).append(new)
            opened.append(here)
            here = new
        else:
            new = state()
            a.skip.setdefault(here, []).append(new)
            a.skip.setdefault(opened.pop(), []).append(new)
            here = new
    runs.append(run)
    a.fixed = b" ".join(max(runs, key=len))
    return a.ready()


def scanner(templates=None, phrases=None):
    """A function from a text to its row of findings."""
    machines = {label: compiled(t) for label, t in (templates or TEMPLATES).items()}
    plain = {p.encode(): label for p, label in (phrases or PHRASES).items()}

    def scan(text: str) -> tuple:
        ws = words(text)
        line = b" " + b" ".join(ws) + b" "
        starts, base, labels, covered = [], set(), set(), []
        for phrase, label in plain.items():
            at = line.find(b" " + phrase + b" ")
            k = before = 0
            while at >= 0:
                # Words are counted on from the last place, not from the first word.
                k += line.count(b" ", before, at)
                before = at
                starts.append(k)
                base.add(label)
                covered.append((k, k + phrase.count(b" ") + 1))
                at = line.find(b" " + phrase + b" ", at + 1)
        for label, machine in machines.items():
            if b" " + machine.fixed + b" " not in line:
                continue
            done = 0
            for k, w in enumerate(ws):
                if k >= done and w in machine.first and (end := machine.end(ws, k)) > 0:
                    labels.add(label)
                    covered.append((k, end))
                    done = end
        at = inside = 0
        for a, b in sorted(covered):
            inside += max(0, b - max(a, at))
            at = max(at, b)
        return (
            len(ws),
            len(starts),
            min(starts, default=None),
            max(starts, default=None),
            ",".join(sorted(base)),
            ",".join(sorted(base | labels)),
            inside / len(ws) if ws else 0.0,
        )

    return scan


FOUND = (
    "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, "
    "base_labels string, labels string, score double"
)


def scan(docs: DataFrame, templates=None, phrases=None) -> DataFrame:
    """One row of findings per document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one = scanner(templates, phrases)
        names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
        for pdf in batches:
            out = pd.DataFrame([one(t or "") for t in pdf["text"]], columns=names)
            out.insert(0, "doc_id", pdf["doc_id"].astype("Int64").to_numpy())
            yield out.astype({"doc_id": "Int64", "first_word": "Int64", "last_word": "Int64"})

    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInPandas(run, FOUND)
