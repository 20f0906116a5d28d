"""Licence scans against a plain version."""

import random
import re

import pytest

from marketlens.llm import licenses as lc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(text):
    """Places of all phrases by trying each at each word."""
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    places = [(x, i, b) for table, b in ((lc.BASE, True), (lc.NOTICES, False)) for p, x in table.items() if b or p not in lc.BASE for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    return len(words), sorted(places, key=lambda x: (x[1], x[0], not x[2]))


def facts(row):
    base = [w for _, w, b in row[1] if b]
    return row[0], len(base), min(base, default=None), max(base, default=None), ",".join(sorted({x for x, _, b in row[1] if b}))


def test_query_against_all_places(spark, sf_dir):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = lc.op12_license_scans(spark, sf_dir).collect()
    assert len(got) == len(rows)
    for r in got:
        n, places = plain(rows[r.doc_id])
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == facts((n, places))
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1
        if "spdx" not in (rows[r.doc_id] or "").lower():
            assert r.labels == ",".join(sorted({x for x, _, _ in places}))
    assert any(r.n_base for r in got)


def test_places_of_made_texts(spark):
    rng = random.Random(3)
    parts = [*lc.BASE, *lc.NOTICES, "cc", "by", "ÀÉ", "x y", "ALL RIGHTS", "Reserved.", "cc-by-nc", "\x00", " ", "[All]{rights}reserved"]
    rows = [(i, rng.choice(["", " ", "."]).join(rng.choice([" ", "-", "\n", "_"]) + rng.choice(parts) for _ in range(rng.randint(0, 60)))) for i in range(300)]
    rows += [(None, None), (7, ""), (7, ""), (8, "word " * 200_000 + "cc by"), (9, "cc by " * 30_000)]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, places int, score string")
    got = lc.scan_licenses(df).collect()
    assert len(got) == len(rows)
    key = lambda x: str(x)
    want = sorted(((i, *plain(t)) for i, t in rows if len(t or "") < 100_000), key=key)
    assert sorted(((r.doc_id, r.n_words, [tuple(p) for p in r.places]) for r in got if r.doc_id not in (8, 9) or r.n_words < 10_000), key=key) == want
    long = {r.doc_id: r for r in got if r.n_words > 10_000}
    assert [tuple(p) for p in long[8].places] == [("cc-by", 200_000, True)] and [p.word for p in long[9].places] == list(range(0, 60_000, 2))
    assert lc.scan_licenses(df.where("false")).count() == 0


@pytest.mark.parametrize(
    ("text", "labels", "grade"),
    [
        ("mit or gpl-3.0-only", {"mit", "gpl"}, 0.9),
        ("mit and gpl-3.0-only", {"mit", "gpl"}, 0.4),
        ("mit or apache-2.0 and gpl-2.0", {"mit", "apache", "gpl"}, 0.9),
        ("(mit or apache-2.0) and gpl-2.0+", {"mit", "apache", "gpl"}, 0.4),
        ("gpl-2.0-only with classpath-exception-2.0", {"gpl"}, 0.5),
        ("gpl-2.0 with classpath-exception-2.0 or agpl-3.0", {"gpl", "agpl"}, 0.5),
        ("((lgpl-2.1 or (mpl-1.1", {"lgpl", "mpl"}, 0.6),
        ("mit or", {"mit"}, 0.9),
        ("mit ) or gpl", {"mit"}, 0.9),
        ("or mit", set(), 1.0),
        ("licenseref-own", {"other"}, 0.3),
        ("cc-by-nc-4.0", {"cc-by-nc"}, 0.2),
        ("", set(), 1.0),
    ],
)
def test_expressions(text, labels, grade):
    found, value = lc.evaluate(lc.tokens(text))
    assert set(found) == labels and value == pytest.approx(grade)


def test_random_expressions_like_python():
    """and, or and brackets as Python reads them, over grades."""
    rng = random.Random(5)
    names = ["mit", "gpl-3.0", "mpl-2.0", "cc0-1.0", "agpl-3.0"]

    def make(depth):
        if not depth or rng.random() < 0.3:
            return rng.choice(names)
        inner = f"{make(depth - 1)} {rng.choice(['and', 'or'])} {make(depth - 1)}"
        return f"({inner})" if rng.random() < 0.5 else inner

    class Grade:
        def __init__(self, x):
            self.x = x

        def __and__(self, o):
            return Grade(min(self.x, o.x))

        def __or__(self, o):
            return Grade(max(self.x, o.x))

    for _ in range(300):
        text = make(4)
        code = re.sub(r"[a-z][\w.-]*", lambda m: {"and": "&", "or": "|"}.get(m[0]) or f"Grade({lc.GRADES[lc.family(m[0])]})", text)
        assert lc.evaluate(lc.tokens(text))[1] == eval(code, {"Grade": Grade}).x


def test_tags(spark):
    text = "// SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0-only\n# spdx-license-identifier: GPL-2.0 WITH Linux-syscall-note */\n{\"license\": \"MIT\"} SPDX-License-Identifier:\nmit"
    (r,) = lc.scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert [(x.expression, x.labels) for x in r.expressions] == [("( mit or apache-2.0 ) and gpl-2.0-only", ["apache", "gpl", "mit"]), ("gpl-2.0 with linux-syscall-note", ["gpl"]), ("mit", ["mit"])]
    assert r.labels == ["apache", "gpl", "mit"] and r.score == pytest.approx(0.6)
