"""Token sets of titles and texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Aliases and word lists.
ALIASES = {
    "presidential": "president", "presidency": "president", "democratic": "democrat", "democrats": "democrat", "republicans": "republican", "nomination": "nominee", "governorship": "governor",
    "governors": "governor", "crude": "oil", "fomc": "fed", "btc": "bitcoin", "nba": "basketball", "uefa": "soccer", "fifa": "soccer",
}
IGNORED = "a an and be by for in of on or the to will with year 2024 2025 2026 2027 2028 2029 2030".split()
THEME = "after all any are before date during must market markets not official party person people question source term this united states what who year".split()
TOPICS = """
after before candidate candidates election game games half market markets meeting nomination nominee official office party politics
president presidential prime question reaction resolution resolve series set states this winner winners win wins world sports
elections yes next march april may june july august september october november december
""".split()
DRIVERS = "fed fomc rates cpi inflation oil crude opec tariffs war strike iran israel gdp jobs payrolls unemployment".split()
ASSETS = "bitcoin btc eth stock stocks spy nasdaq treasury yield gold tesla nvidia usd".split()
RANKING = "a all an and are be before by for from in market markets of on or question the this to what who will with yes no 2024 2025 2026 2027 2028".split()
DISCOVERY = "all and before can could does for from have into market markets more than that the this will with year 2024 2025 2026".split()
ENTITY = r"\b(?:[A-Z][a-z]+|[A-Z]{2,}|[A-Za-z]+[+-][A-Za-z0-9]+|[A-Z]{2,}[0-9]+)\b"
ENTITY_IGNORED = "All Before By Can Could Election Event In Market Markets The Will Yes No".split()


def _words(*cols: Column) -> Column:
    return F.regexp_extract_all(F.concat_ws(" ", *cols), F.lit("[A-Za-z0-9]+"), F.lit(0))


def _without(arr: Column, words: list[str]) -> Column:
    return F.array_except(arr, F.array(*(F.lit(w) for w in words)))


def tokens(*cols: Column) -> Column:
    """Distinct lower-case words of more than two characters as written, aliases replaced, ignored ones dropped."""
    alias = F.create_map(*(F.lit(x) for kv in ALIASES.items() for x in kv))
    kept = F.filter(_words(*cols), lambda w: F.length(w) > 2)
    return _without(F.transform(kept, lambda w: F.coalesce(F.try_element_at(alias, F.lower(w)), F.lower(w))), IGNORED)


def theme_tokens(*cols: Column) -> Column:
    return _without(tokens(*cols), THEME)


def topic_tokens(*cols: Column) -> Column:
    return _without(tokens(*cols), TOPICS)


def ranking_tokens(*cols: Column) -> Column:
    return _without(F.transform(F.filter(_words(*cols), lambda w: F.length(w) >= 3), F.lower), RANKING)


def discovery_tokens(*cols: Column) -> Column:
    return _without(F.transform(F.filter(_words(*cols), lambda w: F.length(w) > 3), F.lower), DISCOVERY)


def jaccard(a: Column, b: Column) -> Column:
    """0 where either set is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def token_overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def token_diff(a: Column, b: Column) -> Column:
    return F.array_except(a, b)


def driver_hits(arr: Column) -> Column:
    return F.size(F.array_intersect(arr, F.array(*(F.lit(w) for w in DRIVERS))))


def asset_hits(arr: Column) -> Column:
    return F.size(F.array_intersect(arr, F.array(*(F.lit(w) for w in ASSETS))))


def token_df(df: DataFrame, arr: str) -> DataFrame:
    """token and the number of rows that have it."""
    return df.select(F.explode(F.array_distinct(arr)).alias("token")).groupBy("token").agg(F.count("*").alias("df"))


def shared_topics(a: DataFrame, b: DataFrame, arr: str, k: int = 8) -> DataFrame:
    """The k tokens that both sides have, most frequent first, then by token."""
    both = token_df(a, arr).withColumnRenamed("df", "da").join(token_df(b, arr).withColumnRenamed("df", "db"), "token")
    return both.select("token", (F.col("da") + F.col("db")).alias("total")).orderBy(F.desc("total"), "token").limit(k)


def entity_labels(title: Column, tags: Column, k: int = 4) -> Column:
    """The first k labels array<struct<label, confidence>>: capitalised words of the title, then tags, hyphens as blanks."""
    words = F.filter(F.transform(F.regexp_extract_all(title, F.lit(ENTITY), F.lit(0)), lambda w: F.trim(w)), lambda w: ~w.rlike("^[0-9]+$"))
    named = F.transform(F.coalesce(tags, F.array().cast("array<string>")), lambda t: F.initcap(F.trim(F.replace(t, F.lit("-"), F.lit(" ")))))
    kept = _without(F.filter(F.concat(words, named), lambda x: x != ""), ENTITY_IGNORED)
    return F.transform(F.slice(kept, 1, k), lambda x, i: F.struct(x.alias("label"), F.round(0.71 + 0.05 * i, 2).alias("confidence")))
