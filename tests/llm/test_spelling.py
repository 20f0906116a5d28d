"""Spelling variants against all pairs."""

import random
import zlib
from collections import Counter, defaultdict

import pytest

from marketlens.llm import spelling as sp


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain(counts, times=2):
    around = defaultdict(list)
    for w in counts:
        for v in counts:
            if abs(len(w) - len(v)) <= 1 and w != v and near(w, v):
                around[w].append(v)
    form = {}
    for w, n in counts.items():
        best = min(around[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= times * n else None
    out = set()
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, len(around[w]), counts.get(form[w])))
    return out


def made(rng, n, letters, longest):
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(5, longest))) for _ in range(n)}
    return {w: rng.choice([3, 4, 7, 30, 200]) for w in words}


@pytest.mark.parametrize(("letters", "longest", "block"), [("ab", 8, 4), ("ab", 10, 20), ("abcé", 7, 8), ("a", 12, 2), ("abcdefÿ", 6, 4096)])
def test_all_pairs(spark, letters, longest, block):
    counts = made(random.Random(longest), 400, letters, longest)
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = {tuple(r) for r in sp.spelling_variants(df, block=block).select("word", "form", "root", "n", "n_near", "form_n").collect()}
    assert got == plain(counts)


def test_blocks_are_bounded(spark):
    counts = made(random.Random(1), 5000, "ab", 12)
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    sizes = sp.blocks(df, 5, 8).groupBy(*sp.KEY).count().collect()
    assert all(r["count"] <= (8 if r.a - r.i - r.j > 1 else 2 + 2 * 2) for r in sizes)


def test_index_alone():
    for seed in range(200):
        rng = random.Random(seed)
        words = sorted({"".join(rng.choice("abc") for _ in range(rng.choice([4, 5]))) for _ in range(30)})
        for w, (n, first) in zip(words, sp.near_in_block(words, 4, 0, 0), strict=True):
            want = [v for v in words if v != w and not len(w) == len(v) == 5 and near(w, v)]
            assert (n, words[first] if n else None) == (len(want), want[0] if want else None)


def test_counts(spark):
    rng = random.Random(7)
    parts = ["Straße", "ÉCOLE", "naïveté", "hello", "World", "a", "x" * 70, "tiny", "été", "x9hello", "foo_bars", "ǅabcde", "×÷×÷×", "İstanbul"]
    rows = [(i, rng.choice([" ", "\n", ", ", "-"]).join(rng.choice(parts) for _ in range(rng.randint(0, 200)))) for i in range(300)]
    rows += [(None, "hello hello"), (5, None), (5, ""), (6, rows[6][1]), (-4, "hello " * 300_000), (9, "y" * 1_200_000)]
    want = Counter()
    for doc, text in rows:
        run, text = "", (text or "") + " "
        for c in text:
            if c.isascii() and c.isalpha() or "À" <= c <= "ÿ":
                run += c.lower() if c.isascii() else c
            elif run:
                h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
                word = run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]
                if len(word) >= 5:
                    want[word] += 1
                run = ""
    df = spark.createDataFrame([(i, t, 1, "w") for i, t in rows], "doc_id long, text string, n int, word string")
    for held in (1, 200_000):
        assert {r.word: r.n for r in sp.count_words(df, held=held).collect()} == want
    assert sp.count_words(df.where("false")).count() == 0


def test_odd_rows(spark):
    rows = [("hello", 4), ("hello", 9), ("hallo", 2), (None, 4), ("helloo", None), ("shrt", 9), ("hellos", 3)]
    df = spark.createDataFrame([(w, n, "x") for w, n in rows], "word string, n long, form string")
    got = {tuple(r) for r in sp.spelling_variants(df).collect()}
    assert got == {("hello", None, "hello", 9, 2, None), ("hallo", "hello", "hello", 2, 1, 9), ("hellos", "hello", "hello", 3, 1, 9)}
    assert sp.spelling_variants(df.where("false")).count() == 0
    with pytest.raises(ValueError):
        sp.spelling_variants(df, times=1)
