"""Secret scans: candidates found by pattern, false positives removed by a random forest that runs as a column expression."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bind, read, write_table

# How candidates look. A private key block; a value assigned to a credential's name; a long token with a digit.
BLOCK = r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----[A-Za-z0-9+/=\s]*+(?:-----END [A-Z ]{0,30}PRIVATE KEY-----)?"
NAME = r"(?i:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|auth)"
ASSIGNED = NAME + r"[\"']?[ \t]{0,3}[=:][ \t]{0,3}[\"']?[^\s\"',;]{6,}+"
TOKEN = r"(?<![A-Za-z0-9+/_\-])(?=[A-Za-z+/_\-]*+[0-9])[A-Za-z0-9+/_\-]{16,}+={0,2}"
CANDIDATE = f"{BLOCK}|{ASSIGNED}|{TOKEN}"
KEY = "^" + NAME + r"[\"']?[ \t]{0,3}[=:][ \t]{0,3}[\"']?"

# Formats of keys whose issuers publish them.
ISSUED = r"^(AKIA|ASIA)[A-Z0-9]{16}$|^gh[pousr]_[A-Za-z0-9]{36}$|^xox[abprs]-[A-Za-z0-9-]{10,}$|^sk_live_[A-Za-z0-9]{16,}$|^AIza[A-Za-z0-9_-]{35}$|^eyJ[A-Za-z0-9_-]{10,}|^-----BEGIN "
# Words beside a secret, words beside what only looks like one, and values that stand for one.
CREDENTIAL = r"(?i)(password|passwd|pwd|secret|token|api[_ -]?key|access[_ -]?key|auth|bearer|credential|private)"
HARMLESS = r"(?i)(example|sample|dummy|commit|sha1|sha256|md5|checksum|digest|uuid|guid|order|invoice|card|phone|tel|version|build|isbn|page|section|request[ _-]?id)"
STAND_IN = r"(?i)(example|changeme|placeholder|your[_-]?|xxxx|\*\*\*\*|dummy|sample|<.*>|\$\{|12345|(.)\2{5,})"
# Common words that a real key hardly spells.
DICTIONARY = """
the and for with from that this have not are was were has you your all can will one two new use user users name names value
values key keys file files path paths data date time test tests example sample default config local lib library python
java node site packages package usr bin var home opt etc src main index page section chapter overview version release
build order invoice number code change changeme password secret token admin root server service client request response
http https www com org net html image images photo video document documents report summary
der die das und mit von auf für ist nicht eine les des une dans pour est pas que los las del una por con para como
""".split()

FEATURES = ["length", "digits", "uppers", "lowers", "others", "transitions", "distinct", "dictionary", "vowels", "slashes", "hex", "longest_letters", "issued", "block", "assigned", "credential", "harmless", "credential_after", "harmless_after", "stand_in", "test_path"]
#: The features before these tell of a value alone, these of what stands around it or in its place.
AROUND = FEATURES.index("assigned")


def _lengths_before(lengths: Column, step: int = 128) -> Column:
    """Sums of all elements before each, in blocks of step so that long arrays take no quadratic time."""
    total = lambda x: F.aggregate(x, F.lit(0), lambda a, b: a + b)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / step).cast("int")), lambda b: total(F.slice(lengths, b * step + 1, F.lit(step))))

    def sums(b: Column) -> Column:
        upto = F.transform(b, lambda _, k: total(F.slice(b, F.lit(1), k)))
        part = lambda k: F.slice(lengths, k - k % step + 1, k % step)
        return bind(upto, lambda u: F.transform(lengths, lambda _, k: F.get(u, F.floor(k / step).cast("int")) + total(part(k))))

    return F.when(F.size(lengths) > 0, bind(blocks, sums)).otherwise(F.array().cast("array<int>"))


def candidates(text: Column, path: Column) -> Column:
    """array<struct<start, match, value, before, after, path>> of a text's candidates, start counted in characters."""
    body = F.coalesce(text, F.lit(""))

    def located(found: Column) -> Column:
        def at(gaps: Column) -> Column:
            spans = F.transform(found, lambda m, k: F.length(F.get(gaps, k)) + F.length(m))
            one = lambda m, k, s: F.struct(
                (F.get(s, k) + F.length(F.get(gaps, k))).cast("long").alias("start"), m.alias("match"), F.regexp_replace(m, KEY, "").alias("value"),
                F.right(F.get(gaps, k), F.lit(40)).alias("before"), F.substring(F.get(gaps, k + 1), 1, 40).alias("after"), F.lower(F.coalesce(path.cast("string"), F.lit(""))).alias("path"),
            )
            return bind(bind(spans, lambda x: _lengths_before(x)), lambda s: F.transform(found, lambda m, k: one(m, k, s)))

        return F.when(F.size(found) > 0, bind(F.split(body, CANDIDATE, -1), at)).otherwise(F.array())

    return bind(F.regexp_extract_all(body, F.lit(CANDIDATE), F.lit(0)), located)


def features(c: Column) -> Column:
    """FEATURES of a candidate as array<double>."""
    v, n = c["value"], F.greatest(F.length(c["value"]), F.lit(1))
    share = lambda pattern: F.regexp_count(v, F.lit(pattern)) / n
    words = F.filter(F.regexp_extract_all(F.lower(v), F.lit("[a-z]{3,}"), F.lit(0)), lambda w: w.isin(*dict.fromkeys(DICTIONARY)))
    flag = lambda x: x.cast("double")
    out = [
        F.least(n, F.lit(200)), share("[0-9]"), share("[A-Z]"), share("[a-z]"), share("[^A-Za-z0-9]"),
        share("(?<=[a-z])(?=[A-Z0-9])|(?<=[A-Z])(?=[a-z0-9])|(?<=[0-9])(?=[A-Za-z])"), F.size(F.array_distinct(F.split(v, ""))) / n,
        F.length(F.array_join(words, "")) / n, share("[aeiouAEIOU](?=[b-df-hj-np-tv-zB-DF-HJ-NP-TV-Z])"), share("/"),
        flag(v.rlike("^[0-9a-fA-F]+$")), F.least(F.array_max(F.transform(F.split(v, "[^A-Za-z]+", -1), lambda x: F.length(x))), F.lit(40)), flag(v.rlike(ISSUED)), flag(c["match"].startswith("-----BEGIN")),
        flag(F.length(c["match"]) > F.length(v)), flag(c["before"].rlike(CREDENTIAL) | (F.length(c["match"]) > F.length(v))), flag(c["before"].rlike(HARMLESS)),
        flag(c["after"].rlike(CREDENTIAL)), flag(c["after"].rlike(HARMLESS)), flag(v.rlike(STAND_IN)), flag(c["path"].rlike("test|example|sample|mock|fixture")),
    ]
    return F.array(*(x.cast("double") for x in out))


def weak_label(c: Column) -> Column:
    """1 for candidates that are surely secrets, 0 for those that surely aren't, null for the others, which only the forest judges."""
    v = c["value"]
    assigned = F.length(c["match"]) > F.length(v)
    mixed = v.rlike("[0-9]") & v.rlike("[A-Za-z]") & (F.length(v) >= 12)
    harmless = v.rlike("^[0-9+/_=-]+$") | v.rlike(STAND_IN) | (c["before"].rlike(HARMLESS) & ~assigned) | v.rlike("^[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$")
    return F.when(v.rlike(ISSUED), F.lit(1)).when(harmless, F.lit(0)).when(assigned & mixed, F.lit(1))


def seed_findings(spark: SparkSession, n: int = 3_000) -> DataFrame:
    """Labelled findings (text, path, label) of published formats and of common look-alikes, filled in by hashing 0 to n - 1.

    A kind whose form tells what it is stands in three surroundings by turns: its usual one, words of no meaning, and words
    that go with the other label; any other stands in its usual one. Findings from the corpus are added to these.
    """
    salt = lambda k: F.sha2(F.concat_ws("-", F.col("id"), F.lit(k)), 512)
    b64 = F.concat(F.base64(F.unhex(salt(1))), F.base64(F.unhex(salt(2))))
    hx, safe, url = salt(3), F.translate(b64, "+/=", "xyz"), F.translate(b64, "+/=", "-_x")
    upper, digits, alnum = F.upper(F.translate(b64, "+/=", "ABC")), F.translate(hx, "abcdef", "123456"), F.translate(b64, "+/=", "a1b")
    word = lambda k: F.element_at(F.array(*(F.lit(x) for x in DICTIONARY)), (F.abs(F.hash("id", F.lit(k))) % len(DICTIONARY) + 1).cast("int"))
    text = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts))
    part = lambda x, k, size: F.substring(x, k, size)
    # label, whether the form alone tells it, usual words before, the candidate, usual words after
    kinds = [
        (1, True, "key ", text("AKIA", part(upper, 1, 16)), " secret"), (1, True, "use ", text("ghp_", part(alnum, 1, 36)), " to pull"), (1, True, "bot ", text("xoxb-", part(digits, 1, 11), "-", part(alnum, 3, 24)), ""),
        (1, True, "pay ", text("sk_live_", part(alnum, 5, 24)), ""), (1, True, "map ", text("AIza", part(url, 1, 35)), " key"), (1, True, "Authorization: Bearer ", text("eyJ", part(url, 1, 60)), ""),
        (1, True, "", text("password=", part(hx, 1, 18)), ""), (1, True, "", text('token = "', part(hx, 1, 40), '"'), ""), (1, True, "", text("api_key: ", part(safe, 1, 32)), ""), (1, True, "", text("pwd=", part(safe, 1, 6), "!", part(digits, 1, 6)), " login"),
        (1, False, "Authorization: Bearer ", part(url, 1, 86), ""), (1, False, "secret key ", part(b64, 1, 40), " password"), (1, False, "credential ", part(hx, 1, 64), " token"),
        (0, True, "card ", part(digits, 1, 16), " expires"), (0, True, "account ", part(digits, 1, 22), " order"), (0, False, "commit ", part(hx, 1, 40), " merged"), (0, False, "sha256 ", part(hx, 1, 64), " checksum"), (0, False, "md5 ", part(hx, 1, 32), " file"),
        (0, True, "request id ", text(part(hx, 1, 8), "-", part(hx, 9, 4), "-4", part(hx, 13, 3), "-a", part(hx, 16, 3), "-", part(hx, 20, 12)), " order"),
        (0, True, "see ", text(word(1), "-", word(2), "-", word(3), "-", word(4), F.col("id")), " page"), (0, True, "in ", text("/", word(1), "/", word(2), "/", word(3), F.col("id") % 10, "/", word(4)), " version"),
        (0, True, "run ", text(word(1), "_", word(2), "_", word(3), "_v", F.col("id") % 30), " build"), (0, True, "", text("password=", F.when(F.col("id") % 2 == 0, "changeme").otherwise("example"), F.col("id")), ""), (0, True, "", text("token: <", word(1), "_", word(2), ">"), ""),
        (0, True, "", text("auth: ", word(1), word(2), word(3)), " section"), (0, True, "phone ", text("+1-", part(digits, 1, 3), "-", part(digits, 4, 3), "-", part(digits, 7, 4), "-", part(digits, 11, 3)), " call"),
    ]
    turn, kind = F.floor(F.col("id") / len(kinds)) % 3, F.col("id") % len(kinds)
    plain, other = text(word(5), " ", word(6), " "), {1: "page version build ", 0: "the secret token "}
    body, label = F.lit(""), F.lit(0)
    for k, (y, clear, before, value, after) in enumerate(kinds):
        usual = F.lit(not clear) | (turn == 0)
        ahead = F.when(usual, F.lit(before)).when(turn == 1, plain).otherwise(F.lit(other[y]))
        body = F.when(kind == k, F.concat(ahead, value, F.when(usual, F.lit(after)).otherwise(F.concat(F.lit(" "), word(7))))).otherwise(body)
        label = F.when(kind == k, F.lit(y)).otherwise(label)
    return spark.range(n).select(body.alias("text"), F.lit("").alias("path"), label.alias("label"))


def labelled_findings(docs: DataFrame, text: str, path: str, max_rows: int, key: str) -> DataFrame:
    """Features and weak labels of the candidates of about max_rows documents, chosen by a hash of key.

    Each is given twice, the second time without the features of its surroundings, which weak labels draw on.
    """
    n = docs.count()
    part = docs if n <= max_rows else docs.where(F.pmod(F.xxhash64(key, F.lit(29)), F.lit(1_000_000)) < int(1e6 * max_rows / n))
    found = part.select(F.explode(candidates(F.col(text), F.col(path))).alias("c"))
    known = found.select(features(F.col("c")).alias("x"), weak_label(F.col("c")).alias("y")).where("y is not null")
    bare = F.transform("x", lambda v, i: F.when(i < AROUND, v).otherwise(0.0))
    return known.select(F.explode(F.array("x", bare)).alias("x"), "y")


def fit_forest(labelled: DataFrame, trees: int = 24, depth: int = 7, seed: int = 7) -> list:
    """Trees of a random forest over labelled features (x array<double>, y 0/1), each as nested (feature, threshold, left, right) or a leaf's probability of 1."""
    rows = labelled.select(array_to_vector("x").alias("features"), F.col("y").cast("double").alias("label"))
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt").fit(rows)

    def nested(node):
        if node.subtreeDepth() == 0:
            no, yes, *_ = [*node.impurityStats().stats(), 0.0]
            return yes / max(no + yes, 1e-9)
        split = node.split()
        return split.featureIndex(), split.threshold(), nested(node.leftChild()), nested(node.rightChild())

    return [nested(t._call_java("rootNode")) for t in model.trees]


def forest_score(trees: list, x: Column) -> Column:
    """The forest's mean probability of 1 for features x, as an expression: rows are scored where they are."""

    def walk(t) -> Column:
        if not isinstance(t, tuple):
            return F.lit(float(t))
        feature, threshold, left, right = t
        return F.when(F.get(x, F.lit(feature)) <= F.lit(threshold), walk(left)).otherwise(walk(right))

    out = walk(trees[0])
    for t in trees[1:]:
        out = out + walk(t)
    return out / len(trees)


def train(docs: DataFrame, text: str = "text", path: str = "source", labelled: DataFrame | None = None, max_rows: int = 20_000, key: str = "doc_id") -> list:
    """A forest from seed findings and labelled ones (text, path, label), or weak labels of about max_rows documents where none are given."""
    spark = docs.sparkSession
    own = lambda df: df.select(F.explode(F.slice(candidates(F.col("text"), F.col("path")), 1, 1)).alias("c"), F.col("label").alias("y")).select(features(F.col("c")).alias("x"), "y")
    known = own(seed_findings(spark)).unionByName(own(labelled) if labelled is not None else labelled_findings(docs, text, path, max_rows, key))
    return fit_forest(write_table(known, "findings").coalesce(4))


def findings(text: Column, path: Column, trees: list, threshold: float = 0.5) -> Column:
    """array<struct<start, length, kind, score, secret, match, value>> of all candidates of a text."""
    kind = lambda c: F.when(c["match"].startswith("-----BEGIN"), "block").when(F.length(c["match"]) > F.length(c["value"]), "assigned").otherwise("token")
    one = lambda c, s: F.struct(
        (c["start"] + F.length(c["match"]) - F.length(c["value"])).alias("start"), F.length(c["value"]).cast("long").alias("length"), kind(c).alias("kind"),
        s.alias("score"), (s >= threshold).alias("secret"), c["match"].alias("match"), c["value"].alias("value"),
    )
    score = lambda c: bind(features(c), lambda x: forest_score(trees, x))
    return F.transform(candidates(text, path), lambda c: bind(score(c), lambda s: one(c, s)))


def scan_secrets(docs: DataFrame, trees: list | None = None, text: str = "text", path: str = "source", doc_id: str = "doc_id", threshold: float = 0.5) -> DataFrame:
    """A row per candidate: doc_id, start, length (characters of the value), kind, score, is_secret, value_sha256.

    Null and empty texts have no candidates; a null path is an empty one; copies and rows without a doc_id are scanned
    as any others; other columns are ignored; an empty table gives no rows. Rows are neither shuffled nor sent to Python.
    """
    trees = trees or train(docs, text, path, key=doc_id)
    found = docs.select(F.col(doc_id).alias("doc_id"), F.explode(findings(F.col(text), F.col(path), trees, threshold)).alias("f"))
    return found.select("doc_id", "f.start", "f.length", "f.kind", "f.score", F.col("f.secret").cast("int").alias("is_secret"), F.sha2("f.value", 256).alias("value_sha256"))


def redact_secrets(docs: DataFrame, trees: list | None = None, text: str = "text", path: str = "source", doc_id: str = "doc_id", threshold: float = 0.5, mark: str = "[SECRET]") -> DataFrame:
    """docs with the values of secrets in text replaced by mark; all else, null texts too, stays as it is.

    Repeated rows are redacted alike; a null path is an empty one; an empty table gives no rows.
    """
    trees = trees or train(docs, text, path, key=doc_id)

    def masked(found: Column) -> Column:
        hide = lambda f: F.when(f["secret"], F.concat(F.left(f["match"], F.length(f["match"]) - F.length(f["value"])), F.lit(mark))).otherwise(f["match"])
        gaps = F.split(text, CANDIDATE, -1)
        return F.when(F.exists(found, lambda f: f["secret"]), bind(gaps, lambda g: F.array_join(F.transform(g, lambda p, k: F.concat(p, F.coalesce(bind(F.get(found, k), hide), F.lit("")))), ""))).otherwise(F.col(text))

    return docs.withColumn(text, bind(findings(F.col(text), F.col(path), trees, threshold), masked))


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(read(spark, sf_dir, "documents"))
