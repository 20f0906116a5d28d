"""Prefix tries against a plain version."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from marketlens.llm import trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows, heads=True):
    """Nodes of (conv_id, turn, role, text) rows, with every prefix as a tuple."""
    turns = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            turns[c].append((t is not None, t, hashlib.sha256(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).digest(), role or "", text or ""))
    turns = {c: [x[3:] for x in sorted(v)] for c, v in turns.items()}
    whole = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6 if heads else 0
        whole[c] = turns.get(c - int(np.fmod(c, 100)), [])[:h] + own[h:]
    members = defaultdict(list)
    for c in sorted(whole):
        for d in range(len(whole[c]) + 1):
            members[tuple(whole[c][:d])].append(c)
    children = defaultdict(set)
    for p in members:
        if p:
            children[p[:-1]].add(p)
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, who in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(who) - 1) * len(p[-1][1]) if p else 0
    sha = lambda p: hashlib.sha256(",".join(str(c) for c in members[p] if len(whole[c]) == len(p)).encode()).hexdigest()
    return sorted((who[0], len(p), members[p[:-1]][0] if p else -1, len(who), len(children[p]), leaves[p], saved[p], sha(p)) for p, who in members.items())


def found(df):
    return sorted(tuple(-1 if x is None else x for x in r) for r in df.select(COLUMNS).collect())


def made(rng, n):
    rows = []
    for c in rng.sample(range(-300, 900), n):
        for k in range(rng.choice([0, 1, 2, 3, 7, 30 if rng.random() < 0.05 else 4])):
            rows.append((c, rng.choice([k, k, None, 1]), rng.choice(["user", "assistant", None, ""]), rng.choice(["hello", "", None, "é", "ok then", "x" * 50])))
        rows += rng.choice([[], rows[-1:]])
    return rows


@pytest.mark.parametrize("shard_turns", [50, 200_000])
@pytest.mark.parametrize("heads", [True, False])
def test_against_plain(spark, shard_turns, heads):
    rows = made(random.Random(shard_turns), 300)
    rows += [(None, 0, "user", "lost"), *((c, 0, "user", "same") for c in range(2000, 2600)), *((9000, k, "user", str(k)) for k in range(600)), (9100, 5, "a", "y" * 300_000)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, digest string, depth int")
    paths = trie.turn_paths(df)
    assert found(trie.prefix_trie(trie.with_shared_heads(paths) if heads else paths, shard_turns)) == plain(rows, heads)


def test_odd_tables(spark):
    df = spark.createDataFrame([(5, 1, "user", "a")], "conv_id int, turn int, role string, text string")
    assert trie.prefix_trie(trie.turn_paths(df.where("false"))).count() == 0
    assert found(trie.prefix_trie(trie.turn_paths(df)))[0][:5] == (5, 0, -1, 1, 1)
    # A head that isn't there takes the first turns away: the conversation may be left without any, and is at the root.
    c = next(c for c in range(101, 199) if zlib.crc32(str(c).encode()) % 6)
    lone = spark.createDataFrame([(c, 0, "user", "a")], "conv_id long, turn int, role string, text string")
    assert found(trie.prefix_trie(trie.with_shared_heads(trie.turn_paths(lone)))) == [(c, 0, -1, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]
    with pytest.raises(TypeError):
        trie.turn_paths(df.withColumn("conv_id", df.conv_id.cast("string")))


def test_slots():
    rng = np.random.default_rng(1)
    for n in (1, 2, 1000, 50_000):
        keys = np.unique(rng.integers(0, 2**63, (n, 2), dtype=np.uint64), axis=0)
        table = trie.Slots(keys)
        assert sorted(table.of(keys).tolist()) == list(range(len(keys)))
        with pytest.raises(KeyError):
            table.of(np.array([[3, 4]], dtype=np.uint64))
    with pytest.raises(ValueError):
        trie.Slots(np.array([[1, 2], [1, 2]], dtype=np.uint64))
