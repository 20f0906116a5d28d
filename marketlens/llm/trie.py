"""The trie of conversation prefixes: node tables by minimal perfect hashing, a shard of conversations at a time, counts gathered through parent slots."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, read, write_table
from .neardup import mix

ROOT = bytes(16)
PATH = "array<struct<digest:binary,size:int>>"
NODES = "shard long, slot int, up int, digest binary, parent binary, depth int, size int, n long, first long, inner boolean, end_from long, end_to long, ends string"
PARTS = "digest binary, depth int, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


class Slots:
    """A minimal perfect hash of distinct 128-bit keys (two uint64 columns): key k of n has a slot from 0 to n - 1 of its own.

    Keys that meet no other at a level's places keep theirs, the others go on to the next level; a slot is the rank of a
    kept place. As other keys than those it was made of have slots too, it holds its keys by slot and checks those it is asked for.
    """

    def __init__(self, keys: np.ndarray, spare: int = 2):
        self.levels, self.keys, left, at = [], np.empty_like(keys), keys, 0
        while len(left):
            if len(self.levels) > 200:
                raise ValueError("keys must be distinct")
            seed, wide = len(self.levels), spare * len(left)
            place = self._place(left, seed, wide)
            kept = np.bincount(place, minlength=wide) == 1
            rank = at + np.cumsum(kept) - 1
            self.levels.append((wide, kept, rank))
            self.keys[rank[place[kept[place]]]] = left[kept[place]]
            at += int(kept.sum())
            left = left[~kept[place]]

    @staticmethod
    def _place(keys: np.ndarray, seed: int, wide: int) -> np.ndarray:
        salt = np.uint64(seed * 0x9E3779B97F4A7C15 + 1 & 0xFFFFFFFFFFFFFFFF)
        return (mix(mix(keys[:, 0] + salt) ^ keys[:, 1]) % np.uint64(wide)).astype(np.int64)

    def __len__(self) -> int:
        return len(self.keys)

    def of(self, keys: np.ndarray) -> np.ndarray:
        out, todo = np.full(len(keys), -1, dtype=np.int64), np.arange(len(keys))
        for seed, (wide, kept, rank) in enumerate(self.levels):
            place = self._place(keys[todo], seed, wide)
            hit = kept[place]
            out[todo[hit]] = rank[place[hit]]
            todo = todo[~hit]
        if len(todo) or not np.array_equal(self.keys[out], keys):
            raise KeyError("a key that the slots weren't made of")
        return out


def turn_paths(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id (long) and path: the turns in order, each as a digest of 128 bits and its text's number of code points.

    Turns are ordered by turn, null first, then by the SHA-256 of role and text, so that repeated and tied rows have one order. Null
    role or text counts as empty. Rows without a conv_id belong to no conversation and are left out; other columns are
    ignored. Texts aren't shuffled: a turn takes some 40 bytes, and a task holds those of a conversation.
    """
    if conversations.schema[conv_id].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise TypeError("conv_id must be an integer")
    said, who = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (text, role))
    digest = F.substring(F.unhex(F.sha2(F.encode(F.concat(F.octet_length(who).cast("string"), F.lit(":"), who, said), "UTF-8"), 256)), 1, 16)
    one = F.struct(F.col(turn).isNotNull().alias("has"), F.col(turn).alias("turn"), digest.alias("digest"), F.length(said).alias("size"))
    rows = conversations.where(F.col(conv_id).isNotNull()).select(F.col(conv_id).cast("long").alias("conv_id"), one.alias("_one"))
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("_one")).alias("_turns"))
    return turns.select("conv_id", F.transform("_turns", lambda x: F.struct(x["digest"].alias("digest"), x["size"].alias("size"))).alias("path"))


def with_shared_heads(paths: DataFrame, stride: int = 100, most: int = 6) -> DataFrame:
    """Every conversation with its first h turns taken from conversation conv_id - conv_id % stride: h is the CRC-32 of its decimal conv_id modulo most.

    Of a shorter one all its turns are taken, of one that isn't there none; the own turns after the first h follow. A head meets
    fewer than 2 * stride conversations.
    """
    head = F.col("conv_id") - F.col("conv_id") % stride
    heads = paths.where(F.col("conv_id") % stride == 0).select(F.col("conv_id").alias("_head"), F.slice("path", 1, most - 1).alias("_first"))
    h = (F.crc32(F.encode(F.col("conv_id").cast("string"), "UTF-8")) % most).cast("int")
    first = F.coalesce(F.col("_first"), F.array().cast(PATH))
    rows = paths.withColumn("_head", head).join(heads, "_head", "left")
    return rows.select("conv_id", F.concat(F.slice(first, F.lit(1), h), F.slice("path", h + 1, F.greatest(F.size("path"), F.lit(1)))).alias("path"))


def shard_nodes(shard: int, ids: list[int], paths: list[list[tuple[bytes, int]]]) -> pd.DataFrame:
    """The nodes of some conversations: a row for each, by slot, with counts over these conversations alone."""
    keys, up, sizes, depths, lasts = [], [], [], [], []
    for path in paths:
        at, last = ROOT, len(keys)
        keys.append(at)
        up.append(last)
        sizes.append(0)
        depths.append(0)
        for k, (digest, size) in enumerate(path, 1):
            at = hashlib.blake2b(at + digest, digest_size=16).digest()
            up.append(last)
            last = len(keys)
            keys.append(at)
            sizes.append(size)
            depths.append(k)
        lasts.append(last)
    every = np.frombuffer(b"".join(keys), dtype=np.uint64).reshape(-1, 2)
    order = np.lexsort((every[:, 1], every[:, 0]))
    new = np.r_[True, (every[order][1:] != every[order][:-1]).any(axis=1)]
    table = Slots(every[order][new])
    slot = table.of(every)
    n = len(table)
    counts, first = np.bincount(slot, minlength=n), np.full(n, np.iinfo(np.int64).max)
    lengths = np.array([len(p) + 1 for p in paths])
    np.minimum.at(first, slot, np.repeat(np.array(ids, dtype=np.int64), lengths))
    parent, depth, size = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    ups, sizes, depths = slot[np.array(up)], np.array(sizes), np.array(depths)
    parent[slot], depth[slot], size[slot] = ups, depths, sizes
    if (parent[slot] != ups).any() or (depth[slot] != depths).any() or (size[slot] != sizes).any():
        raise ValueError("two prefixes have one digest")
    inner = np.zeros(n, dtype=bool)
    inner[parent[depth > 0]] = True
    ends = slot[np.array(lasts)]
    by_end = np.lexsort((ids, ends))
    starts = np.flatnonzero(np.r_[True, np.diff(ends[by_end]) > 0])
    sorted_ids = np.array(ids, dtype=np.int64)[by_end]
    out = pd.DataFrame({"shard": shard, "slot": np.arange(n), "up": np.where(depth > 0, parent, -1), "depth": depth, "size": size, "n": counts, "first": first, "inner": inner})
    out["digest"] = [x.tobytes() for x in table.keys]
    out["parent"] = [b"" if d == 0 else table.keys[p].tobytes() for p, d in zip(parent, depth, strict=True)]
    runs = np.split(sorted_ids, starts[1:])
    at_slot = ends[by_end][starts]
    out["end_from"] = pd.Series([x[0] for x in runs], index=at_slot, dtype="Int64").reindex(out.index)
    out["end_to"] = pd.Series([x[-1] for x in runs], index=at_slot, dtype="Int64").reindex(out.index)
    out["ends"] = pd.Series([",".join(map(str, x.tolist())) for x in runs], index=at_slot, dtype=object).reindex(out.index).replace(np.nan, None)
    return out[[x.split()[0] for x in NODES.split(", ")]]


def gather(nodes: pd.DataFrame) -> pd.DataFrame:
    """What a shard's own nodes add to themselves and to all above them: counts go up through the parent slots, the deepest nodes first.

    A node is the own one of the shard that has its smallest member, so that each is added once over all shards.
    """
    nodes = nodes.sort_values("slot")
    up, depth, own = nodes["up"].to_numpy(), nodes["depth"].to_numpy(), (nodes["first"] == nodes["first_all"]).to_numpy()
    total, first = nodes["n_all"].to_numpy(), nodes["first_all"].to_numpy()
    leaves = (own & ~nodes["inner_all"].to_numpy()).astype(np.int64)
    saved = own * (total - 1) * nodes["size"].to_numpy().astype(np.int64)
    children = np.bincount(up[own & (depth > 0)], minlength=len(nodes))
    by_depth = np.argsort(-depth, kind="stable")
    for level in np.split(by_depth, np.flatnonzero(np.diff(depth[by_depth])) + 1):
        if depth[level[0]]:
            np.add.at(leaves, up[level], leaves[level])
            np.add.at(saved, up[level], saved[level])
    null = lambda x, where: pd.array(np.where(where, x, 0), dtype="Int64").copy() if where.all() else pd.Series(np.where(where, x, 0), dtype="Int64").mask(~where).array
    out = pd.DataFrame({"digest": nodes["digest"].to_numpy(), "depth": null(depth, own), "conv_id": null(first, own), "parent_conv_id": null(first[up], own & (depth > 0)), "n_convs": null(total, own)})
    out["n_children"], out["n_leaves"], out["saved_tokens"] = children, leaves, saved
    return out[own | (children > 0) | (leaves > 0) | (saved != 0)]


def _hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of the lists of ids, which come in pieces sorted by node and id."""
    node, state, last = None, None, None
    for batch in batches:
        out = []
        for digest, low, high, ids in zip(batch["digest"], batch["end_from"], batch["end_to"], batch["ends"], strict=True):
            if digest != node:
                if node is not None:
                    out.append((node, state.hexdigest()))
                node, state = digest, hashlib.sha256(ids.encode())
            elif low <= last:
                raise ValueError("pieces of ids overlap")
            else:
                state.update(b"," + ids.encode())
            last = high
        yield pd.DataFrame(out, columns=["digest", "ends_sha256"])
    if node is not None:
        yield pd.DataFrame([(node, state.hexdigest())], columns=["digest", "ends_sha256"])


def prefix_trie(paths: DataFrame, shard_turns: int = 200_000) -> DataFrame:
    """The trie of all paths (conv_id, path): a row for each distinct prefix, the empty one included.

    Returns conv_id (smallest member) and depth, which name the node, parent_conv_id (root: null), n_convs, n_children,
    n_leaves (childless nodes at or under it), saved_tokens (over the nodes at or under it, the members but one times
    the size of the last turn) and ends_sha256 (of the members that end there, ascending, comma-joined).

    conv_id must be distinct and not null. Conversations are sorted by their turns and dealt into shards of about shard_turns turns, so that few
    nodes lie in two shards, whatever share of all conversations begin alike. Each shard's distinct prefix digests get slots of a
    minimal perfect hash; flat arrays by slot hold what is counted. Nodes with one digest must agree in parent, depth and
    size across shards, or the job fails. Only nodes are shuffled, of ids only lists that a shard has joined. No paths, no rows.
    """
    spark = paths.sparkSession
    bounded_batches(spark)
    paths = write_table(paths, "paths")
    turns = paths.agg(F.sum(F.size("path") + 1)).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), turns // shard_turns + 1)
    sort = [F.get("path", F.lit(k))["digest"].alias(f"_{k}") for k in (0, 1, 2, 4, 8, 16, 64)] + [F.col("conv_id")]
    dealt = paths.repartitionByRange(tasks, *sort).sortWithinPartitions(*sort)

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, ids, held, n = TaskContext.get().partitionId() << 24, [], [], 0
        for batch in batches:
            for conv, path in zip(batch["conv_id"].tolist(), batch["path"], strict=True):
                ids.append(conv)
                held.append([(x["digest"], x["size"]) for x in path])
                n += len(path) + 1
                if n >= 2 * shard_turns:
                    yield shard_nodes(shard, ids, held)
                    shard, ids, held, n = shard + 1, [], [], 0
        if ids:
            yield shard_nodes(shard, ids, held)

    nodes = write_table(dealt.mapInPandas(build, NODES), "trie-nodes")
    same = nodes.groupBy("digest").agg(
        F.sum("n").alias("n_all"), F.min("first").alias("first_all"), F.max("inner").alias("inner_all"), *(F.min(c).alias(f"_{c}") for c in ("parent", "depth", "size")), *(F.max(c).alias(f"{c}_") for c in ("parent", "depth", "size"))
    )
    agree = (F.col("_parent") == F.col("parent_")) & (F.col("_depth") == F.col("depth_")) & (F.col("_size") == F.col("size_"))
    same = same.select("digest", "first_all", "inner_all", F.when(agree, F.col("n_all")).otherwise(F.raise_error(F.lit("two prefixes have one digest")).cast("long")).alias("n_all"))
    counted = nodes.select("shard", "slot", "up", "digest", "depth", "size", "first").join(same, "digest").groupBy("shard").applyInPandas(gather, PARTS)
    ends = nodes.where("ends is not null").select("digest", "end_from", "end_to", "ends").repartition(tasks, "digest").sortWithinPartitions("digest", "end_from")
    hashed = ends.mapInPandas(_hashed, "digest binary, ends_sha256 string")
    both = counted.unionByName(hashed, allowMissingColumns=True).groupBy("digest")
    most, sums = ("conv_id", "depth", "parent_conv_id", "n_convs"), ("n_children", "n_leaves", "saved_tokens")
    out = both.agg(*(F.max(c).cast("long").alias(c) for c in most), *(F.sum(c).alias(c) for c in sums), F.coalesce(F.max("ends_sha256"), F.lit(EMPTY_SHA)).alias("ends_sha256"))
    return out.drop("digest")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(with_shared_heads(turn_paths(read(spark, sf_dir, "conversations"))))


OP11_SQL = """
with recursive bit(i, k, c) as (
  select i, 0, i from range(256) t(i) union all
  select i, k + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from bit where k < 8),
crc as (select list(c order by i) as t from bit where k = 8),
t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
s as (select conv_id, length(text) as size, left(sha256(octet_length(encode(role)) || ':' || role || text), 32) as x, turn from t),
o as (select *, row_number() over (partition by conv_id order by turn nulls first, x) as k from s),
c as (select conv_id, conv_id - conv_id % 100 as head, (xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(range(length(conv_id::varchar)), lambda i: ascii(substr(conv_id::varchar, i + 1, 1))::bigint)),
  lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]))) % 6)::bigint as h from (select distinct conv_id from o), crc),
r as (select c.conv_id, 0 as own, k, x, size from c join o on o.conv_id = c.head and k <= h union all select c.conv_id, 1, k, x, size from c join o on o.conv_id = c.conv_id and k > h),
d as (select conv_id, size, x, row_number() over (partition by conv_id order by own, k) as depth from r),
p as materialized (select conv_id, depth, size, sha256(string_agg(x, '') over (partition by conv_id order by depth)) as key, count(*) over (partition by conv_id) as of from d
  union all select conv_id, 0, 0, '', coalesce(of, 0) from c left join (select conv_id, count(*) as of from d group by 1) using (conv_id)),
n as materialized (select depth, key, min(conv_id) as conv_id, count(*) as n_convs, min(size) as size, max(of) = depth as leaf,
  sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where of = depth), '')) as ends_sha256 from p group by 1, 2),
a as (select p.depth, p.key, sum(leaf::int) as n_leaves, sum((n_convs - 1) * n.size) as saved_tokens, count(*) filter (where p.depth = n.depth - 1) as n_children
  from n join p on p.conv_id = n.conv_id and p.depth <= n.depth group by 1, 2)
select n.conv_id, n.depth::bigint as depth, u.conv_id as parent_conv_id, n.n_convs, a.n_children, a.n_leaves::bigint as n_leaves, a.saved_tokens::bigint as saved_tokens, n.ends_sha256
from n join a on a.depth = n.depth and a.key = n.key left join p on p.conv_id = n.conv_id and p.depth = n.depth - 1 left join n u on u.depth = p.depth and u.key = p.key
"""
