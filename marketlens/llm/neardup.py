"""Near duplicates by banded MinHash, candidates thinned by odd sketches and confirmed on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, exp, log, sqrt

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, read, semi_by_size, write_table

ROWS, SAMPLES, BITS, FULL_BITS = 4, 128, 512, 2048
#: As many shared shingles before one tell whether a pair has met already; which pairs meet doesn't depend on it.
EARLIER = 8
SKETCH = "doc_id {kind}, tie long, n long, cls binary, bands array<long>, sketch array<long>"


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of a text's words, A-Z in lower case; words are separated by ASCII white space."""
    found = text.encode().lower().split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, found), dtype=np.uint64, count=len(found))


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of size words in order; of the whole sequence where there are fewer, of none without words."""
    if not len(words):
        return words
    width = min(size, len(words))
    out = np.full(len(words) - width + 1, width, dtype=np.uint64)
    for k in range(width):
        out = mix(out + words[k : len(words) - width + 1 + k] * np.uint64(2 * k + 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF | 1))
    return out


def shingle_set(text: str, size: int) -> np.ndarray:
    return np.unique(shingle_hashes(word_hashes(text), size))


def minhash(shingles: np.ndarray, k: int = SAMPLES, block: int = 1 << 13) -> np.ndarray:
    """k minima, each under a multiply-add hash of its own."""
    rng = np.random.default_rng(20)
    a = rng.integers(1, 1 << 63, k, dtype=np.uint64)[:, None] * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 1 << 63, k, dtype=np.uint64)[:, None]
    out = np.full(k, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(shingles), block):
        out = np.minimum(out, (a * shingles[None, i : i + block] + b).min(axis=1))
    return out


def parity(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Parities of how many hashes fall on each of bits bits, as longs."""
    odd = (np.bincount((hashes % np.uint64(bits)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)
    return np.packbits(odd).view(">u8").astype(np.uint64).view(np.int64)


def odd_sketch(minima: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Parities of the minima's bits: where two sketches differ is where an odd number of unequal minima fell."""
    return parity(mix(minima + np.arange(len(minima), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)), bits)


def estimate(a: Column, b: Column, samples: int = SAMPLES, bits: int = BITS) -> Column:
    """Similarity by two odd sketches: from the population count of their XOR."""
    words = F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    ones = F.aggregate(words, F.lit(0), lambda s, x: s + x)
    return 1 + F.lit(bits / (4 * samples)) * F.log(F.greatest(1 - 2 * ones / F.lit(bits), F.lit(1e-9)))


def full_parity(shingles: np.ndarray, bits: int = FULL_BITS) -> np.ndarray:
    """Parities of a whole set's bits: two of them differ in nearly as many bits as the sets do in elements."""
    return parity(mix(shingles), bits)


def full_estimate(a: Column, b: Column, na: Column, nb: Column, bits: int = FULL_BITS) -> Column:
    """Similarity of two sets of na and nb elements by their full parities."""
    ones = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    apart = F.lit(-bits / 2) * F.log(F.greatest(1 - 2 * ones / F.lit(bits), F.lit(1e-9)))
    return (na + nb - apart) / (na + nb + apart)


def sketches(docs: DataFrame, size: int, bands: int) -> DataFrame:
    """Per row of docs (doc_id, text): set size, a 128-bit class of equal sets, band hashes and the odd sketch."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        salt = mix(np.arange(1, bands + 1, dtype=np.uint64))
        for batch in batches:
            out, seen = [], {}
            for text in batch["text"]:
                if text not in seen:
                    s = shingle_set(text, size)
                    if len(s):
                        m = minhash(s)
                        keys = salt.copy()
                        for r in range(ROWS):
                            keys = mix(keys + m[r * bands : (r + 1) * bands])
                        seen[text] = (len(s), xxhash.xxh3_128_digest(s.tobytes()), keys.view(np.int64), odd_sketch(m))
                    else:
                        seen[text] = (0, b"", [], [])
                out.append(seen[text])
            frame = pd.DataFrame(out, columns=["n", "cls", "bands", "sketch"])
            frame.insert(0, "tie", batch["tie"].values)
            frame.insert(0, "doc_id", batch["doc_id"].values)
            yield frame

    return docs.select("doc_id", F.xxhash64("text").alias("tie"), "text").mapInPandas(run, SKETCH.format(kind=kind))


def components(links: DataFrame) -> DataFrame:
    """node and root (the smallest node of its component) of an undirected graph of links (a, b).

    Rounds of large-star and small-star, each two joins on minima, until the stars no longer change; every round is
    kept as a table. No node's neighbours are gathered.
    """
    edges = write_table(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "stars")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        edges = write_table(small, "stars")
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == state or not now[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now


def parities(texts: DataFrame, size: int) -> DataFrame:
    """cls, its set as hashes (shingles), and the set's full parity. texts: cls, text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [shingle_set(x, size) for x in batch["text"]]
            yield pd.DataFrame({"cls": batch["cls"], "parity": [full_parity(s) for s in sets], "shingles": [s.view(np.int64) for s in sets]})

    return texts.select("cls", "text").mapInPandas(run, "cls binary, parity array<long>, shingles array<long>")


def rare_pairs(sets: DataFrame, some: DataFrame, percent: int, roots: DataFrame | None = None) -> DataFrame:
    """Pairs (a, b) of classes, one of them in some (cls), that may have percent % similarity: they share one of the rarest shingles of both.

    sets: cls, shingles. Of n shingles the floor((100 - percent) n / 100) + 1 rarest among sets are looked at, which loses no
    pair; shingles of one set alone count among them but lead nowhere. So texts that share no more than a template don't meet.
    Two sets meet at a shingle only if what stands from it on, in the common order of shingles, is enough in both: all that
    they have in common stands there, where it is the first they share. At later ones they don't meet again where the first is among
    the EARLIER before them. roots (cls, root): classes of one root don't meet; without a row a class is its own root.
    """
    rows = sets.select("cls", F.size("shingles").alias("n"), F.explode("shingles").alias("s"))
    shared = rows.join(rows.groupBy("s").agg(F.count("*").alias("d")).where("d > 1"), "s")
    own = Window.partitionBy("cls")
    order = own.orderBy("d", "s")
    place = F.col("n") - F.count("*").over(own) + F.row_number().over(order)
    rare = shared.withColumn("r", place).where(F.col("r") * 100 <= (100 - percent) * F.col("n") + 100)
    rare = rare.withColumn("before", F.collect_list("s").over(order.rowsBetween(-EARLIER, -1))).select("s", "cls", "n", "r", "before")
    rare = rare.join(some.select("cls", F.lit(True).alias("asks")), "cls", "left").na.fill(False, ["asks"])
    rare = rare.join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls")) if roots is not None else rare.withColumn("root", F.col("cls"))
    side = lambda df, k: df.select("s", F.col("cls").alias(k), *(F.col(c).alias(f"{c}{k}") for c in ("n", "r", "before", "asks", "root")))
    fits = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent
    enough = (1 + F.least(F.col("na") - F.col("ra"), F.col("nb") - F.col("rb"))) * (100 + percent) >= (F.col("na") + F.col("nb")) * percent
    once = (F.col("roota") != F.col("rootb")) & (~F.col("asksb") | (F.col("a") < F.col("b")))
    pairs = side(rare.where("asks"), "a").join(side(rare, "b"), "s").where(once & fits & enough & ~F.arrays_overlap("beforea", "beforeb"))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def confirm(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose full shingle sets have 100 * intersection >= percent * union. texts: cls, text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: dict[bytes, np.ndarray] = {}

        def of(key: bytes, text: str) -> np.ndarray:
            if key not in kept:
                if len(kept) > 2_000:
                    kept.clear()
                kept[key] = shingle_set(text, size)
            return kept[key]

        for batch in batches:
            good = []
            for a, b, x, y in zip(batch["a"], batch["b"], batch["ta"], batch["tb"], strict=True):
                s, t = of(bytes(a), x), of(bytes(b), y)
                both = len(np.intersect1d(s, t, assume_unique=True))
                good.append(100 * both >= percent * (len(s) + len(t) - both))
            yield batch.loc[good, ["a", "b"]]

    side = lambda k: texts.select(F.col("cls").alias(k), F.col("text").alias(f"t{k}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ta", "tb").mapInPandas(run, "a binary, b binary")


def _margin(percent: int, deviations: float = 6.0) -> float:
    """How far below its true similarity a full parity may put a pair at the threshold: deviations standard deviations, at worst.

    The odd bits of d elements thrown on b bits number (b - sum of x) / 2, where x is 1 or -1 by a bit's parity, with mean
    (1 - 2 / b) ** d and, for two bits, (1 - 4 / b) ** d of their product. The similarity is (m - d) / (m + d), m being the
    sum of both sizes; pairs with more elements than the bits can tell are not judged by them.
    """
    worst, b = 0.0, FULL_BITS
    for m in range(8, int(b * 0.4 * (100 + percent) / (100 - percent)) + 8, 8):
        d = m * (100 - percent) / (100 + percent)
        one, two = (1 - 2 / b) ** d, (1 - 4 / b) ** d
        ones = sqrt(max(b * (1 - one * one) + b * (b - 1) * (two - one * one), 0.0)) / 2
        worst = max(worst, 2 * m / (m + d) ** 2 * ones / exp(-2 * d / b))
    return deviations * worst


def _slack(percent: int, deviations: float = 6.0) -> float:
    """How far below its true similarity an odd sketch may put a pair at the threshold: samples differ by chance, and bits hide some."""
    share, b = percent / 100, BITS
    d = 2 * SAMPLES * (1 - share)
    one, two = (1 - 2 / b) ** d, (1 - 4 / b) ** d
    ones = sqrt(max(b * (1 - one * one) + b * (b - 1) * (two - one * one), 0.0)) / 2
    return deviations * sqrt(share * (1 - share) / SAMPLES + (ones / exp(-2 * d / b) / (2 * SAMPLES)) ** 2)


def near_duplicates(docs: DataFrame, size: int = 3, percent: int = 85, doc_id: str = "doc_id", text: str = "text", miss: float = 1e-5) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id and kept.

    Two rows are linked where 100 times the intersection of their sets of size-word shingles is at least percent times
    the union. Rows with equal sets are one class, however many. Classes meet in bands of four MinHash values, so many
    that a pair at the threshold meets in none with a chance of at most miss. In each band's group every class is
    compared with one pivot, chosen anew by each band; where a group still spans several components, the classes outside the
    largest of these are compared with all that share one of their rarest shingles. Pairs whose odd sketches put them six standard
    deviations below the threshold, and in that last round those whose parity sketches of full sets do, are dropped; all
    others are confirmed on full sets unless other links join them anyway.

    A row without text or words has no shingles and is linked with nothing: component_id is its doc_id, as for any row
    by itself. Rows without a doc_id take part; a component_id is null only where all ids of a component are. kept is
    true for rows whose doc_id is the component_id (for repeated rows: each of them). Extra columns are ignored; an
    empty table gives no rows.
    """
    bands = max(2, ceil(log(miss) / log(1 - (percent / 100) ** ROWS)))
    if bands * ROWS > SAMPLES:
        raise ValueError("the threshold is too low for this many samples")
    margin, slack = _margin(percent), _slack(percent)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    members = write_table(sketches(rows, size, bands), "sketches")
    full = members.where("n > 0")
    classes = full.groupBy("cls").agg(F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "tie")).alias("of"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    classes = write_table(classes, "classes")
    banded = classes.select("cls", F.posexplode("bands").alias("band", "key"))
    groups = banded.groupBy("key").agg(F.count("*").alias("g"), F.min(F.struct(F.xxhash64("cls", "band").alias("r"), "cls")).alias("p")).where("g > 1")
    groups = banded.join(groups.select("key", F.col("p.cls").alias("pivot")), "key").select("key", "band", "cls", "pivot")
    groups = write_table(groups, "groups")

    facts = classes.select("cls", "n", "sketch")
    of = lambda k: facts.select(F.col("cls").alias(k), F.col("n").alias(f"n{k}"), F.col("sketch").alias(f"s{k}"))
    fits = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent

    def candidates(pairs: DataFrame) -> DataFrame:
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        return pairs.join(of("a"), "a").join(of("b"), "b").where(fits).withColumn("s", estimate(F.col("sa"), F.col("sb"))).where(F.col("s") >= percent / 100 - slack).select("a", "b", "s")

    def texts(pairs: DataFrame) -> DataFrame:
        used = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct()
        wanted = write_table(used.join(classes.select("cls", "of"), "cls").select("cls", F.col("of.doc_id").alias("i"), F.col("of.tie").alias("t")), "wanted")
        keyed = rows.withColumns({"t": F.xxhash64("text"), "i": F.coalesce(F.xxhash64("doc_id"), F.lit(0))})
        wanted = wanted.withColumn("i", F.coalesce(F.xxhash64("i"), F.lit(0)))
        found = semi_by_size(keyed, wanted.select("i", "t"), ["i", "t"], 1_000_000)
        return found.join(wanted, ["i", "t"]).select("cls", "text").dropDuplicates(["cls"])

    def check(pairs: DataFrame) -> DataFrame:
        return write_table(confirm(pairs, texts(pairs), size, percent), "links")

    def apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
        root = lambda k: roots.select(F.col("node").alias(k), F.col("root").alias(f"r{k}"))
        out = pairs.join(root("a"), "a", "left").join(root("b"), "b", "left")
        return out.where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")

    pairs = write_table(candidates(groups.where("cls <> pivot").select(F.col("cls").alias("a"), F.col("pivot").alias("b"))), "pairs")
    # First one partner for each class, the likeliest; mostly that joins what belongs together.
    ends = pairs.select(F.col("a").alias("x"), F.col("b").alias("y"), "s").unionByName(pairs.select(F.col("b").alias("x"), F.col("a").alias("y"), "s"))
    best = ends.groupBy("x").agg(F.max_by("y", F.struct("s", "y")).alias("y"))
    first = write_table(best.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "first")
    links = check(first)
    roots = components(links)
    # Then the other pivots of classes that are still apart.
    second = write_table(apart(pairs.join(first, ["a", "b"], "left_anti"), roots), "second")
    if second.limit(1).count():
        links = links.unionByName(check(second))
        roots = components(links)
    # At last, of the classes in groups that hold several components, those outside the largest component that a group has
    # part in against all of other components. They meet by rare shingles, not by bands, in which a template would bring all its texts together; a parity
    # sketch of their full sets leaves only pairs close to the threshold.
    rooted = groups.join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    whole = roots.groupBy("root").agg(F.count("*").alias("w"))
    sizes = rooted.groupBy("key", "root").agg(F.count("*").alias("c")).join(whole, "root", "left").na.fill(0, ["w"])
    mixed = sizes.groupBy("key").agg(F.count("*").alias("k"), F.max_by("root", F.struct("w", "c", "root")).alias("main")).where("k > 1")
    rooted = rooted.join(mixed.select("key", "main"), "key").groupBy("cls", "root").agg(F.bool_or(F.col("root") != F.col("main")).alias("minor"))
    rooted = write_table(rooted, "mixed")
    sharp = write_table(parities(texts(rooted.select(F.col("cls").alias("a"), F.col("cls").alias("b"))), size), "parities")
    met = write_table(rare_pairs(sharp, rooted.where("minor").select("cls"), percent, rooted.select("cls", "root")), "met")
    known = rooted.join(classes.select("cls", "n", "sketch").join(sharp.select("cls", "parity"), "cls"), "cls")
    side = lambda k: known.select(F.col("cls").alias(k), *(F.col(c).alias(f"{n}{k}") for n, c in (("n", "n"), ("s", "sketch"), ("f", "parity"))))
    alike = estimate(F.col("sa"), F.col("sb")) >= percent / 100 - slack
    long = (F.col("na") + F.col("nb")) * (100 - percent) >= F.lit(FULL_BITS * 0.4) * (100 + percent)
    close = long | (full_estimate(F.col("fa"), F.col("fb"), F.col("na"), F.col("nb")) >= percent / 100 - margin)
    third = write_table(met.join(side("a"), "a").join(side("b"), "b").where(alike & close).select("a", "b"), "close")  # or all that met are looked up in pairs
    third = write_table(third.join(pairs, ["a", "b"], "left_anti"), "third")
    if third.limit(1).count():
        links = links.unionByName(check(third))
        roots = components(links)

    named = classes.select("cls", "least").join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    named = named.join(named.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("cls", "component_id")
    out = members.join(named, "cls", "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    out = out.select("doc_id", "tie", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents")).drop("tie")


OP10_SQL = r"""
with recursive w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
g as (select doc_id, case when len(w) = 0 then []::varchar[] when len(w) < 3 then [array_to_string(w, ' ')] else list_distinct(list_transform(range(len(w) - 2), lambda i: w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) end as g from w),
n as (select doc_id, len(g)::bigint as n from g),
s as (select doc_id, n, unnest(g) as s from g join n using (doc_id)),
p as (select x.doc_id as a, y.doc_id as b, x.n as na, y.n as nb, count(*) as c from s x join s y on x.s = y.s and x.doc_id <> y.doc_id group by all),
e as (select a, b from p where 100 * c >= 85 * (na + nb - c)),
r as (select doc_id, doc_id as c from n union select r.doc_id, e.b from r join e on e.a = r.c),
m as (select doc_id, min(c) as component_id from r group by doc_id)
select doc_id, n as n_shingles, component_id, doc_id = component_id as kept from n join m using (doc_id)
"""
