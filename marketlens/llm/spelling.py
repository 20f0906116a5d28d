"""Spelling variants: words one edit apart, found by a bit-sliced position index, and the commoner form each one stands for."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, read, small, write_table

RUN, END = re.compile("[a-zÀ-ÿ]+"), re.compile("[^a-zÀ-ÿ]")
#: Words of a block that isn't split further, as long as its window has more than one place.
BLOCK = 4096
KEY = ["a", "i", "j", "key"]


def runs(text: str, piece: int = 1 << 20) -> Counter:
    """Counts of the runs of letters of text, A-Z in lower case; a long text is read in pieces that end where a run does."""
    text, found, at = text.encode().lower().decode(), Counter(), 0
    while at < len(text):
        end = END.search(text, min(at + piece, len(text)))
        end = end.end() if end else len(text)
        found.update(RUN.findall(text, at, end))
        at = end
    return found


def dropped(run: str, before: int, one_in: int) -> str:
    """run, less one letter if one_in divides the checksum of what `before` is the checksum of, followed by run."""
    h = zlib.crc32(run.encode(), before)
    return run if h % one_in else run[: h % len(run)] + run[h % len(run) + 1 :]


def count_words(docs: DataFrame, least: int = 5, one_in: int = 97, doc_id: str = "doc_id", text: str = "text", held: int = 200_000) -> DataFrame:
    """word and n: how often each run of at least `least` letters occurs in all whole texts.

    Runs are of A-Z, a-z and U+00C0 to U+00FF, A-Z in lower case; where one_in divides the CRC-32 of `<doc_id>:<run>`, the run
    loses the letter at that number modulo its length (one_in=0: none does). A null doc_id counts as empty text, as
    null text does; repeated rows count each time. Tasks add up counts of at most about `held` words before they are shuffled.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.selectExpr(f"coalesce(cast(`{doc_id}` as string), '') as doc_id", f"`{text}` as text").where("text <> ''")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        flush = lambda: pd.DataFrame({"word": pd.Series(list(seen), dtype=object), "n": list(seen.values())})
        for batch in batches:
            for doc, body in zip(batch["doc_id"], batch["text"], strict=True):
                before = zlib.crc32(f"{doc}:".encode())
                for w, n in runs(body).items():
                    if len(w) >= least and len(word := dropped(w, before, one_in) if one_in else w) >= least:
                        seen[word] += n
                if len(seen) >= held:
                    yield flush()
                    seen.clear()
        yield flush()

    return rows.mapInPandas(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _entry(a: Column, i: Column, j: Column) -> Column:
    """A block's key: words of a and a + 1 letters that agree in the first i and the last j."""
    key = F.concat(F.substring("word", F.lit(1), i), F.substring("word", F.length("word") - j + 1, j))
    return F.struct(a.cast("int").alias("a"), i.cast("int").alias("i"), j.cast("int").alias("j"), key.alias("key"))


def blocks(words: DataFrame, least: int, block: int = BLOCK) -> DataFrame:
    """Rows of words (word, n) with the keys of the blocks in which they meet their near words.

    Two words one edit apart, the shorter of a letters, agree before the edit and after it. Cut the places in two: they agree in
    the first half or in the second, so that a word meets the others by either. A block of more than `block` words is cut in
    the same way in the half that is left, and so on, down to one place, where no block has more words than pairs of letters.
    A pair with equal first halves meets by these alone.
    """
    length = F.length("word")
    entries = []
    for a in (length, length - 1):  # with words as long or longer, and with shorter ones
        half = F.floor(a / 2)
        entries += [F.when(a >= least, _entry(a, half, F.lit(0))), F.when(a >= least, _entry(a, F.lit(0), a - half))]
    opened = lambda rows, keys: rows.withColumn("_e", F.explode(F.array_compact(F.array(*keys)))).select("word", "n", "_e.*")
    rows, light = opened(words, entries), None
    while True:
        crowded = write_table(rows.groupBy(KEY).count().where((F.col("count") > block) & (F.col("a") - F.col("i") - F.col("j") > 1)).select(KEY), "crowded")
        few = small(crowded, 200_000)
        if few and crowded.isEmpty():
            return rows if light is None else light.unionByName(rows)
        side = F.broadcast(crowded) if few else crowded
        rest = rows.join(side, KEY, "left_anti").select("word", "n", *KEY)
        light = rest if light is None else light.unionByName(rest)
        mid = F.col("i") + F.floor((F.col("a") - F.col("i") - F.col("j")) / 2)
        again = rows.join(side, KEY, "left_semi").select("word", "n", "a", "i", "j")
        keys = [_entry(F.col("a"), mid, F.col("j")), _entry(F.col("a"), F.col("i"), F.col("a") - mid)]
        rows = again.withColumn("_e", F.explode(F.array(*keys))).select("word", "n", "_e.*")


def near_in_block(words: list[str], a: int, i: int, j: int) -> list[tuple[int, int]]:
    """For each word of a block, in how many others it has a near word there, and the first of them (-1: none).

    Bit b of a set is word b. at[p][c] is the set of words with c in place p of what lies between the first i and the last j letters. Reading a
    word's letters in turn, `zero` keeps the words that agree so far, `swap` those with one letter replaced, `more` and
    `less` those with one letter more or less, read a place further on or back. Pairs are of a and a letters or a and a + 1.
    """
    width, at = a - i - j, [{} for _ in range(a - i - j + 2)]
    short = 0
    for b, w in enumerate(words):
        bit = 1 << b
        if len(w) == a:
            short |= bit
        for p, c in enumerate(w[i : len(w) - j]):
            at[p][c] = at[p].get(c, 0) | bit
    full = (1 << len(words)) - 1
    long = full ^ short
    out = []
    for w in words:
        read = w[i : len(w) - j]
        if len(w) == a:
            zero, swap, more = full, 0, 0
            for p, c in enumerate(read):
                here = at[p].get(c, 0)
                more = (more | zero) & at[p + 1].get(c, 0)
                agree = zero & here
                swap = swap & here | zero ^ agree
                zero = agree
            found = swap & short | (more & long & ~zero if j else (more | zero) & long)
        else:
            zero, less = short, 0
            for p, c in enumerate(read[:-1]):
                less = (less & at[p - 1].get(c, 0) if p else 0) | zero
                zero &= at[p].get(c, 0)
            last = less & at[width - 1].get(read[-1], 0) if width else 0
            found = (last & ~zero if j else last | zero) & short
        out.append((found.bit_count(), (found & -found).bit_length() - 1))
    return out


def near_words(words: DataFrame, least: int = 5, block: int = BLOCK) -> DataFrame:
    """word, n, n_near (words one inserted, deleted or replaced letter away) and the largest of them by n, then in code-point order (near, near_n).

    words has word (distinct, of at least `least` letters) and n, without nulls. No pair leaves a block: each word brings its count and its
    best near word from there. Blocks are bounded (see blocks) whatever the words; a task reads them one by one.
    """
    keyed = blocks(words, least, block)
    tasks = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = keyed.repartition(tasks, *KEY).sortWithinPartitions(*KEY, F.col("n").desc(), "word")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (row for batch in batches for row in zip(*(batch[c].tolist() for c in (*KEY, "word", "n")), strict=True))
        out: list[tuple] = []
        for (a, i, j, _), group in groupby(rows, key=lambda r: r[:4]):
            group = list(group)
            if len(group) > 1:
                for r, (count, best) in zip(group, near_in_block([r[4] for r in group], a, i, j), strict=True):
                    if count:
                        out.append((r[4], count, group[best][5], group[best][4]))
            if len(out) >= 20_000:
                yield pd.DataFrame(out, columns=["word", "n_near", "near_n", "near"])
                out = []
        yield pd.DataFrame(out, columns=["word", "n_near", "near_n", "near"])

    none = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("long").alias("near_n"), F.lit(None).cast("string").alias("near"))
    met = dealt.mapInPandas(run, "word string, n_near long, near_n long, near string").withColumn("n", F.lit(None).cast("long"))
    best = F.min(F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))))
    found = none.unionByName(met).groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("_best"))
    return found.select("word", "n", "n_near", F.col("_best.near").alias("near"), (-F.col("_best.less")).alias("near_n"))


def spelling_variants(words: DataFrame, least: int = 5, times: int = 2, block: int = BLOCK) -> DataFrame:
    """Each word's form, the near word of largest n where that is at least `times` its own, and root, where forms lead.

    words has word and n. Rows without a word or count, with fewer than `least` letters or with a word said before (the
    largest n counts) don't matter; an empty table gives no rows. Returns word, form, root, n, n_near, form_n.
    Forms double the counts at least, so that they lead to a root in 62 steps at most: six rounds of joins that each double the steps.
    """
    if times < 2:
        raise ValueError("times must be 2 or more")
    bounded_batches(words.sparkSession)
    clean = words.where(F.col("word").isNotNull() & F.col("n").isNotNull() & (F.length("word") >= least)).groupBy("word").agg(F.max("n").cast("long").alias("n"))
    found = near_words(write_table(clean, "words"), least, block)
    led = F.col("near_n") >= times * F.col("n")
    found = write_table(found.select("word", "n", "n_near", F.when(led, F.col("near")).alias("form"), F.when(led, F.col("near_n")).alias("form_n")), "forms")
    to = found.where("form is not null").select("word", F.col("form").alias("root"))
    side = lambda df: F.broadcast(df) if small(df, 1_000_000) else df
    while True:
        step = to.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        to = write_table(to.join(side(step), "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "roots")
        if to.where("moved").isEmpty():
            break
        to = to.drop("moved")
    return found.join(side(to.select("word", "root")), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(count_words(read(spark, sf_dir, "documents")).where("n >= 3"))


#: SQL finds near words by all ways of leaving out a letter.
OP13_SQL = """
with recursive bit(i, k, c) as (
  select i, 0, i from range(256) t(i) union all
  select i, k + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from bit where k < 8),
crc as (select list(c order by i) as t from bit where k = 8),
r as (select coalesce(doc_id::varchar, '') as doc, unnest(regexp_extract_all(text, '[A-Za-z\\x{00C0}-\\x{00FF}]+')) as run from documents),
l as (select doc, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run, count(*) as n from r where length(run) >= 5 group by all),
h as (select run, n, xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(range(octet_length(encode(doc || ':' || run))::bigint), lambda i: ('0x' || substr(hex(encode(doc || ':' || run)), 2 * i + 1, 2))::bigint)),
  lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])))::bigint as h from l, crc),
v as materialized (select case when h % 97 = 0 then left(run, h % length(run)) || substr(run, h % length(run) + 2) else run end as word, sum(n)::bigint as n
  from h group by 1 having sum(n) >= 3 and length(word) >= 5),
k as materialized (select word, n, p, left(word, p) || substr(word, p + 2) as d from (select *, unnest(range(length(word))) as p from v)),
e as (select a.word, b.word as near, b.n as near_n from k a join k b on a.p = b.p and a.d = b.d and a.word <> b.word
  union select k.word, v.word, v.n from k join v on k.d = v.word union select v.word, k.word, k.n from k join v on k.d = v.word),
b as (select word, count(*) as n_near, arg_min(near, (-near_n, near)) as near, max(near_n) as near_n from e group by word),
f as materialized (select v.word, v.n, coalesce(n_near, 0) as n_near, case when near_n >= 2 * v.n then near end as form, case when near_n >= 2 * v.n then near_n end as form_n from v left join b using (word)),
w as (select word, form as at from f where form is not null union all select w.word, f.form from w join f on f.word = w.at where f.form is not null),
x as (select w.word, w.at as root from w join f on f.word = w.at where f.form is null)
select f.word, f.form, coalesce(x.root, f.word) as root, f.n, f.n_near, f.form_n from f left join x on x.word = f.word
"""
