"""Byte-level BPE as a monoid: halves of a text are encoded alone and joined by encoding the text around the seam anew."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from .common import bounded_batches, read

#: Characters of a leaf: few enough that the tree encodes ordinary texts, many enough that seams cost little.
LEAF = 1 << 8
IDS = "ids array<int>"


@lru_cache(maxsize=4)
def _codec(path: str, pattern: str):
    """The encoder of a rank file, and the bytes of each id."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    table = [b""] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        table[i] = token
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), table


def _kind(c: str) -> int:
    """0 white space, 1 letter, 2 number, 3 other."""
    return 0 if c.isspace() else 1 if c.isalpha() else 2 if c.isnumeric() else 3


#: Letters and punctuation beyond ASCII whose kind no version of Unicode has changed: accented Latin, Greek, Cyrillic, Hebrew, Arabic, dashes and
#: quotes, kana, Chinese characters, Hangul, full-width punctuation.
_SETTLED = re.compile(
    "[\\x00-\\x1b\\x20-\\x7f\\u00c0-\\u00d6\\u00d8-\\u00f6\\u00f8-\\u00ff\\u0391-\\u03a1\\u03a3-\\u03c9\\u0401\\u0410-\\u044f\\u0451\\u05d0-\\u05ea\\u0621-\\u063a\\u0641-\\u064a"
    "\\u2010-\\u2027\\u3001\\u3002\\u3041-\\u3094\\u30a1-\\u30fa\\u4e00-\\u9fa5\\uac00-\\ud7a3\\uff01-\\uff0f]"
)


def _hard(before: str, after: str) -> bool:
    """Whether the pattern splits between two characters whatever stands around them.

    No match goes on from a character that isn't white space to one that is, nor from a letter or number to a
    character of another kind. Settled characters only: of others, libraries may take different views.
    """
    if not (_SETTLED.match(before) and _SETTLED.match(after)):
        return False
    a, b = _kind(before), _kind(after)
    return (a != 0 and b == 0) or (a in (1, 2) and a != b)


def encode(text: str, codec, leaf: int = LEAF) -> list[int]:
    """The ids of text: what encoding it in one piece gives, in pieces of at most leaf characters and seams."""
    if len(text) <= leaf:
        return codec[0].encode_ordinary(text)
    cut = len(text) // 2
    return join(text, cut, encode(text[:cut], codec, leaf), encode(text[cut:], codec, leaf), codec)


def join(text: str, cut: int, left: list[int], right: list[int], codec, window: int = 32) -> list[int]:
    """Ids of text from the ids of text[:cut] and text[cut:].

    A window around the cut grows until it starts and ends where the pattern always splits, inside what each half saw;
    from there outwards no match, and so no token, can depend on the other half. Its text is encoded anew.
    """
    lo = hi = None
    while lo is None or hi is None:
        if lo is None:
            stop = max(0, cut - window)
            lo = next((p for p in range(cut - 1, stop, -1) if _hard(text[p - 1], text[p])), 0 if stop == 0 else None)
        if hi is None:
            stop = min(len(text), cut + window)
            hi = next((p for p in range(cut + 1, stop) if _hard(text[p - 1], text[p])), len(text) if stop == len(text) else None)
        window *= 2
    size = codec[1]
    need, i = len(text[lo:cut].encode()), len(left)
    while need > 0:
        i -= 1
        need -= len(size[left[i]])
    more, j = len(text[cut:hi].encode()), 0
    while more > 0:
        more -= len(size[right[j]])
        j += 1
    if need or more:
        raise AssertionError("a token crosses a hard boundary")
    return left[:i] + encode_flat(text[lo:hi], codec) + right[j:]


def encode_flat(text: str, codec) -> list[int]:
    return codec[0].encode_ordinary(text)


def decode(ids: list[int], codec, leaf: int = LEAF) -> bytes:
    """Bytes of ids, concatenated up the same tree."""
    if len(ids) <= leaf:
        return b"".join(map(codec[1].__getitem__, ids))
    cut = len(ids) // 2
    return decode(ids[:cut], codec, leaf) + decode(ids[cut:], codec, leaf)


def encode_documents(docs: DataFrame, path: str, pattern: str, digests: bool = False, text: str = "text", doc_id: str = "doc_id", leaf: int = LEAF) -> DataFrame:
    """doc_id and ids (array<int>) of every row's whole text, or with digests doc_id, n_tokens, ids_sha256, decoded_sha256.

    Null text counts as empty and has no ids; special tokens' strings are ordinary text; repeated rows and null doc_ids
    are kept as they are; other columns are ignored. Each task works on its own rows: nothing is shuffled.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.selectExpr(f"`{doc_id}` as doc_id", f"coalesce(`{text}`, '') as text")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = _codec(path, pattern)
        for batch in batches:
            ids = [encode(x, codec, leaf) for x in batch["text"]]
            if not digests:
                yield pd.DataFrame({"doc_id": batch["doc_id"], "ids": [np.array(x, dtype=np.int32) for x in ids]})
                continue
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"],
                    "n_tokens": [len(x) for x in ids],
                    "ids_sha256": [hashlib.sha256(np.array(x, dtype="<u4").tobytes()).hexdigest() for x in ids],
                    "decoded_sha256": [hashlib.sha256(decode(x, codec, leaf)).hexdigest() for x in ids],
                }
            )

    return rows.mapInPandas(run, f"doc_id {kind}, " + ("n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else IDS))


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and text of encoded documents (doc_id, ids); null ids give an empty text."""
    bounded_batches(encoded.sparkSession)
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = _codec(path, pattern)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "text": [decode([] if x is None else list(x), codec).decode(errors="replace") for x in batch["ids"]]})

    return encoded.select("doc_id", "ids").mapInPandas(run, f"doc_id {kind}, text string")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, digests=True)
