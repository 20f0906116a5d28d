"""Licence scans: an Aho-Corasick automaton finds notices and identifier tags, a shunting-yard parser reads licence expressions."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, read

# The phrases that every scan looks for, and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# How notices are worded, in words of a-z, 0-9 and letters beyond ASCII.
NOTICES = {
    "gnu affero general public license": "agpl",
    "gnu lesser general public license": "lgpl",
    "gnu library general public license": "lgpl",
    "gnu general public license": "gpl",
    "apache license": "apache",
    "mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "isc license": "isc",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "european union public licence": "eupl",
    "boost software license": "bsl",
    "cc0": "cc0",
    "dedicated to the public domain": "public-domain",
    "released into the public domain": "public-domain",
    "free and unencumbered software": "unlicense",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc by nc sa": "cc-by-nc",
    "cc by nc nd": "cc-by-nc",
    "creative commons attribution": "cc-by",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc",
    "proprietary and confidential": "reserved",
}

# What an expression follows.
TAGS = ("spdx-license-identifier:", "spdx-license-expression:", "license-expression:", '"license":')

#: How freely a text under a label may be used, from 1 (no conditions) to 0 (not at all). A family's grade holds for its versions.
GRADES = {
    "public-domain": 1.0, "cc0": 1.0, "unlicense": 1.0, "0bsd": 1.0, "wtfpl": 1.0, "mit": 0.9, "bsd": 0.9, "isc": 0.9, "apache": 0.9, "bsl": 0.9, "zlib": 0.9, "python": 0.9,
    "cc-by": 0.8, "mpl": 0.6, "lgpl": 0.6, "epl": 0.6, "eupl": 0.5, "cc-by-sa": 0.5, "gpl": 0.4, "agpl": 0.3, "cc-by-nd": 0.2, "cc-by-nc": 0.2, "reserved": 0.0,
}
UNKNOWN, LOOSER = 0.3, 0.1
BINDS = {"or": 1, "and": 2, "with": 3}
TOKEN = re.compile(r"[ \t]*(?:\\?[\"'])?([()]|[a-z0-9.+:-]+)")
BREAKS = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256))
RESULT = "n_words long, places array<struct<label:string,word:long,base:boolean>>, expressions array<struct<expression:string,labels:array<string>,grade:double>>, labels array<string>, score double"


def lower(text: str) -> str:
    """text with A-Z in lower case and nothing else changed."""
    return text.encode().lower().decode()


def spaced(text: str) -> tuple[str, int]:
    """Runs of a-z, 0-9 and characters beyond ASCII (A-Z in lower case) with a space on either side, and their number."""
    found = text.encode().lower().translate(BREAKS).split()
    return f" {b' '.join(found).decode()} ", len(found)


def family(name: str) -> str | None:
    """The longest family of GRADES that a licence's name begins with: gpl for gpl-3.0-or-later."""
    parts = name.rstrip("+").split("-")
    return next((x for k in range(len(parts), 0, -1) if (x := "-".join(parts[:k])) in GRADES), None)


def tokens(text: str) -> list[str]:
    """Names, operators and brackets of the expression that text begins with, as far as they fit together; its line ends it."""
    out, at, operand, depth = [], 0, True, 0
    while m := TOKEN.match(text, at):
        x = m[1]
        if operand and (x == "(" or x not in BINDS and x != ")"):
            operand, depth = x == "(", depth + (x == "(")
        elif not operand and (x in BINDS or x == ")" and depth):
            operand, depth = x != ")", depth - (x == ")")
        else:
            break
        out.append(x)
        at = m.end()
    while out and (out[-1] == "(" or out[-1] in BINDS):
        out.pop()
    return out


def postfix(parts: list[str]) -> list[str]:
    """The shunting yard: operators after their operands; `with` binds before `and`, `and` before `or`. Open brackets close at the end."""
    out, waiting = [], []
    for x in parts:
        if x == "(":
            waiting.append(x)
        elif x == ")":
            while waiting and waiting[-1] != "(":
                out.append(waiting.pop())
            if waiting:
                waiting.pop()
        elif x in BINDS:
            while waiting and waiting[-1] != "(" and BINDS[waiting[-1]] >= BINDS[x]:
                out.append(waiting.pop())
            waiting.append(x)
        else:
            out.append(x)
    return out + [x for x in reversed(waiting) if x != "("]


def evaluate(parts: list[str]) -> tuple[list[str], float]:
    """Labels and grade of an expression: the freest side of `or`, the strictest of `and`; an exception loosens the licence it stands with."""
    stack: list[tuple[list[str], float]] = []
    for x in postfix(parts):
        if x in BINDS and len(stack) > 1:
            (b, right), (a, left) = stack.pop(), stack.pop()
            stack.append((a, min(1.0, left + LOOSER)) if x == "with" else (a + b, max(left, right) if x == "or" else min(left, right)))
        elif x not in BINDS:
            known = family(x)
            stack.append(([known or "other"], GRADES.get(known, UNKNOWN)))
    return stack[-1] if stack else ([], 1.0)


@lru_cache(maxsize=4)
def _automata(phrases: tuple[tuple[str, str, bool], ...], tags: tuple[str, ...]):
    import ahocorasick

    words, marks = ahocorasick.Automaton(), ahocorasick.Automaton()
    for phrase, label, base in phrases:
        words.add_word(f" {phrase} ", [*words.get(f" {phrase} ", []), (label, base, len(phrase) + 1)])
    for x in tags:
        marks.add_word(x, x)
    words.make_automaton()
    marks.make_automaton()
    return words, marks


def scan(text: str, phrases: tuple, tags: tuple) -> dict:
    """What scan_licenses says of one text."""
    by_word, by_mark = _automata(phrases, tags)
    line, n_words = spaced(text)
    places, spaces, seen = [], 0, 0
    for end, hits in by_word.iter(line):
        for label, base, size in hits:
            start = end - size - 1  # the space in front: as many words stand before it as spaces
            if start >= seen:
                spaces, seen = spaces + line.count(" ", seen, start), start
                places.append((label, spaces, base))
            else:
                places.append((label, spaces - line.count(" ", start, seen), base))
    places.sort(key=lambda x: (x[1], x[0], not x[2]))
    expressions = []
    low = lower(text)
    for end, _ in by_mark.iter(low):
        stop = low.find("\n", end)
        if parts := tokens(low[end + 1 : stop if stop >= 0 else len(low)]):
            labels, grade = evaluate(parts)
            expressions.append((" ".join(parts), sorted(set(labels)), grade))
    grades = [GRADES.get(x, UNKNOWN) for x, _, _ in places] + [g for _, _, g in expressions]
    labels = {x for x, _, _ in places}.union(*(x for _, x, _ in expressions))
    return {"n_words": n_words, "places": places, "expressions": expressions, "labels": sorted(labels), "score": 1.0 - min(grades, default=1.0)}


def scan_licenses(docs: DataFrame, base: dict[str, str] = BASE, notices: dict[str, str] = NOTICES, tags: tuple[str, ...] = TAGS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Licence notices and expressions of every whole text.

    Notices are phrases of lower-case words, matched where their words stand one after the other; expressions follow a
    tag and end with their line or where they break off. Returns doc_id, n_words, places (label, word: where it starts, base),
    expressions (as read, labels, grade), labels (distinct, sorted) and score: 0 without conditions or notices to 1
    for all rights reserved, by the strictest notice or expression. Names that no family is known for get the label other.

    Null text counts as empty, which has no words, places or labels and the score 0; null and repeated doc_ids are kept
    as they are, row by row; other columns are ignored. Phrases that overlap are all places. Nothing is shuffled.
    """
    bounded_batches(docs.sparkSession)
    phrases = tuple(sorted([(p, x, True) for p, x in base.items()] + [(p, x, False) for p, x in notices.items() if p not in base]))
    rows = docs.selectExpr(f"`{doc_id}` as doc_id", f"coalesce(`{text}`, '') as text")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [scan(x, phrases, tags) for x in batch["text"]]
            out = pd.DataFrame({k: [x[k] for x in found] for k in ("n_words", "places", "expressions", "labels", "score")})
            out["places"] = [[{"label": a, "word": b, "base": c} for a, b, c in x] for x in out["places"]]
            out["expressions"] = [[{"expression": a, "labels": b, "grade": c} for a, b, c in x] for x in out["expressions"]]
            out.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield out

    return rows.mapInPandas(run, f"doc_id {kind}, {RESULT}")


def op12_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.filter("places", lambda x: x["base"])
    at = lambda f: f(F.transform(base, lambda x: x["word"]))
    names = F.array_sort(F.array_distinct(F.transform(base, lambda x: x["label"])))
    return scan_licenses(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), at(F.array_min).alias("first_word"), at(F.array_max).alias("last_word"),
        F.array_join(names, ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score",
    )
