"""Hierarchical multi-length packing of token sequences."""

from __future__ import annotations

import json
import re
import zlib
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, read, small, write_table

SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, in_tier long"
_encoders: dict[str, Callable[[str], np.ndarray]] = {}


def encoder(path: str) -> Callable[[str], np.ndarray]:
    """text -> ids (little-endian unsigned 32-bit) of a tokenizer file of the tokenizers library, special tokens' strings being ordinary text.

    A plain byte-level BPE whose ids follow its merges is encoded word by word, with words met before looked up: words
    are cut at blanks that follow a character that isn't white space, where such a tokenizer always splits. Texts in
    which a blank follows white space, and all other kinds of tokenizers, are encoded whole.
    """
    if path in _encoders:
        return _encoders[path]
    if ranks := _byte_ranks(path):
        import public_tokenizers
        import tiktoken

        core = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        bare = lambda text: np.array(core(text), dtype="<u4").tobytes()
        unclear = re.compile(r"\s ")

        class Known(dict):
            """Bytes of the ids of words after a blank; words not met before are encoded, and kept while there is room."""

            def __missing__(self, word: str) -> bytes:
                ids = bare(" " + word)
                if len(self) < 100_000:
                    self[word] = ids
                return ids

        known = Known()

        def encode(text: str) -> np.ndarray:
            if unclear.search(text):
                return np.frombuffer(bare(text), dtype="<u4")
            first, *rest = text.split(" ")
            return np.frombuffer(b"".join([bare(first), *map(known.__getitem__, rest)]), dtype="<u4")

    else:
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        whole.encode_special_tokens = True
        encode = lambda text: np.array(whole.encode(text, add_special_tokens=False).ids, dtype="<u4")
    _encoders[path] = encode
    return encode


def _byte_ranks(path: str) -> dict[bytes, int] | None:
    """Ranks of a byte-level BPE file; None where the file is of another kind or its ids don't follow its merges."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    model, pre = data["model"], data.get("pre_tokenizer") or {}
    plain = model.get("type", "BPE") == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not data.get("normalizer")
    if not plain or model.get("dropout") or model.get("ignore_merges"):
        return None
    # Byte-level files write printable bytes as they are and the others as characters from 256 on.
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in printable]
    byte = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(other)}
    special = {x["content"] for x in data.get("added_tokens", [])}
    ranks = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    ids = [model["vocab"].get("".join(p)) for p in pairs]
    return ranks if None not in ids and ids == sorted(ids) and (not ids or ids[0] == 256) else None


class Packer:
    """Packs pieces of documents into windows of the tiers' sizes; what waits is bounded by limit pieces.

    A document gives full windows of the longest tier; the rest, shorter than that, is routed to the shortest tier that
    holds it. flush() sets half of the pieces of each tier but the longest aside as fillers, and packs the tiers from
    the longest down: a window is opened for a piece, its gap filled with the longest fillers of shorter tiers that fit,
    at last with the head of the tier's next piece, whose rest is routed anew. Fillers that no longer tier took are then
    packed in windows of their own tier. A window that can't be filled waits on. At the end the pieces that wait are laid
    end to end and cut into full windows, the last of them into powers of two, so that nothing is padded.
    """

    def __init__(self, base: int, tiers: tuple[int, ...], limit: int = 4096):
        self.base, self.tiers, self.limit = base, tuple(sorted(tiers)), limit
        self.waiting: dict[int, deque] = {t: deque() for t in self.tiers}
        self.sequences, self.in_tier, self.rows, self.held = 0, dict.fromkeys(self.tiers, 0), [], 0

    def tier(self, n: int) -> int:
        return next(t for t in self.tiers if n <= t)

    def add(self, doc: object, ids: np.ndarray) -> None:
        top, n = self.tiers[-1], len(ids)
        for start in range(0, n - top + 1, top):
            self.emit(top, [(doc, ids, start, top)])
        if rest := n % top:
            self.waiting[self.tier(rest)].append((doc, ids, n - rest, rest))
            self.held += 1
            if self.held >= self.limit:
                self.flush()

    def fit(self, fillers: dict[int, deque], gap: int, below: int) -> tuple | None:
        """A filler of at most gap tokens from tiers under below, of the longest tier that has one in front."""
        for t in reversed(self.tiers):
            if t < below and fillers[t] and fillers[t][0][3] <= gap:
                return fillers[t].popleft()
        return None

    def flush(self) -> None:
        own, fillers = {t: deque() for t in self.tiers}, {t: deque() for t in self.tiers}
        for t in self.tiers:
            for k, piece in enumerate(self.waiting[t]):
                (fillers if k % 2 and t != self.tiers[-1] else own)[t].append(piece)
            self.waiting[t].clear()
        for t in reversed(self.tiers):
            queue = own[t]
            queue.extend(fillers[t])
            fillers[t].clear()
            while queue:
                window = [queue.popleft()]
                gap = t - window[0][3]
                while gap:
                    piece = self.fit(fillers, gap, t)
                    if piece is None:
                        source = queue or next((fillers[x] for x in reversed(self.tiers) if fillers[x]), None)
                        if not source:
                            break
                        doc, ids, start, n = source.popleft()
                        piece = doc, ids, start, min(n, gap)
                        if n > gap:
                            rest, to = (doc, ids, start + gap, n - gap), self.tier(n - gap)
                            own[to].appendleft(rest) if to <= t else queue.appendleft(rest)
                    window.append(piece)
                    gap -= piece[3]
                if gap:
                    for piece in window:
                        self.waiting[self.tier(piece[3])].append(piece)
                else:
                    self.emit(t, window)
        self.held = sum(map(len, self.waiting.values()))

    def finish(self) -> None:
        self.flush()
        rest = deque(x for t in reversed(self.tiers) for x in self.waiting[t])
        left, top = sum(x[3] for x in rest), self.tiers[-1]
        while left:
            size = need = top if left >= top else 1 << (left.bit_length() - 1)
            window = []
            while need:
                doc, ids, start, n = rest.popleft()
                if n > need:
                    rest.appendleft((doc, ids, start + need, n - need))
                    n = need
                window.append((doc, ids, start, n))
                need -= n
            self.emit(size, window)
            left -= size

    def emit(self, size: int, window: list[tuple]) -> None:
        """One full sequence, numbered among all of this packer and among those of its size."""
        k, at = self.in_tier.get(size, 0), 0
        self.in_tier[size] = k + 1
        for doc, ids, start, n in window:
            self.rows.append((doc, start, n, zlib.crc32(ids[start : start + n]), len(ids), self.base + self.sequences, at, size, k))
            at += n
        self.sequences += 1


def pack_documents(docs: DataFrame, tokenizer: str, tiers: tuple[int, ...] = (128, 256, 512, 1024), step_tokens: int = 8192, end_id: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of all documents, packed into sequences of the tiers' sizes (powers of two).

    Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier (its sequence's size), step_group
    and step. A document is its ids and end_id. Every partition packs its own rows, in one pass, keeps at most 4,096
    pieces waiting, and ends in a few sequences that are smaller powers of two, so that no token is shuffled and no sequence
    is padded. Numbers of sequences begin with the partition's. The sequences of a size form step groups of step_tokens
    tokens, numbered through all partitions, so that all but the last of a size are full; step deals the groups of all
    sizes out in one order, in which each is spread evenly. Null text is empty: a document of end_id alone. Repeated rows
    and null ids are packed as any others; an empty table gives no rows.
    """
    if any(t & (t - 1) for t in tiers):
        raise ValueError("tiers must be powers of two")
    bounded_batches(docs.sparkSession)
    rows = docs.selectExpr(f"`{doc_id}` as doc_id", f"coalesce(`{text}`, '') as text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", *(x.split()[0] for x in SCHEMA.split(", "))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, packer, end = encoder(tokenizer), Packer(TaskContext.get().partitionId() << 40, tiers), np.array([end_id], dtype="<u4")

        def out() -> pd.DataFrame:
            frame = pd.DataFrame(packer.rows, columns=names)
            packer.rows = []
            return frame.astype({"doc_id": "Int64"}) if kind in ("bigint", "int") else frame

        for batch in batches:
            for doc, body in zip(batch["doc_id"], batch["text"], strict=True):
                packer.add(None if pd.isna(doc) else doc, np.concatenate((encode(body), end)))
            yield out()
        packer.finish()
        yield out()

    return with_steps(write_table(rows.mapInPandas(run, f"doc_id {kind}, {SCHEMA}"), "packed"), step_tokens)


def with_steps(packed: DataFrame, step_tokens: int) -> DataFrame:
    """packed (sequence_id, tier, in_tier) with step_group and step. Only counts are grouped: a row for each partition and size."""
    part = F.shiftright("sequence_id", 40)
    counts = packed.groupBy(part.alias("_part"), "tier").agg((F.max("in_tier") + 1).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("tier").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = write_table(counts.withColumn("_before", before), "counts")
    sizes = {r["tier"]: r["n"] for r in counts.groupBy("tier").agg(F.sum("_n").alias("n")).collect()}  # a row for each size
    groups = {t: -(-n // max(1, step_tokens // t)) for t, n in sizes.items()}
    # What a group's place needs to know of its own size and of each other: how many groups it has, and whether it goes first on ties.
    rivals = lambda t: F.array(*(F.struct(F.lit(m).cast("long").alias("m"), F.lit(o < t).alias("first")) for o, m in groups.items() if o != t)).cast("array<struct<m:bigint,first:boolean>>")
    facts = F.create_map(*(x for t, n in groups.items() for x in (F.lit(t), F.struct(F.lit(n).cast("long").alias("n"), rivals(t).alias("rivals"))))) if groups else F.lit(None).cast("map<int,struct<n:bigint,rivals:array<struct<m:bigint,first:boolean>>>>")
    x = packed.withColumn("_part", part).join(F.broadcast(counts) if small(counts, 1_000_000) else counts, ["_part", "tier"])
    x = x.withColumn("_g", F.expr(f"(_before + in_tier) div greatest({step_tokens} div tier, 1)")).withColumn("_f", F.element_at(facts, F.col("tier")))
    # Groups are put in order of (g + 1/2) / number of groups of the size, then of size.
    step = F.expr("aggregate(_f.rivals, _g, (s, o) -> s + if(o.first, ((2 * _g + 1) * o.m div _f.n + 1) div 2, ((2 * _g + 1) * o.m + _f.n - 1) div _f.n div 2))")
    return x.select(*packed.drop("in_tier").columns, (F.col("tier").cast("long") * (1 << 40) + F.col("_g")).alias("step_group"), step.alias("step"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
