"""Column functions that bring raw market fields into one shape. Zero and empty text stand for what is missing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words written in capitals, prices per million tokens by model family.
ACRONYMS = {"api": "API", "id": "ID", "llm": "LLM", "mae": "MAE", "ndcg": "NDCG", "rmse": "RMSE", "sql": "SQL", "url": "URL", "usd": "USD"}
MODEL_PRICES = [
    (r"(?i)claude-opus-4(?:[-.]\d+)?", 15.0, 75.0),
    (r"(?i)claude-sonnet-(?:4(?:[-.]\d+)?|3-7|3-5)", 3.0, 15.0),
    (r"(?i)claude-haiku-3-5", 0.8, 4.0),
    (r"(?i)claude-haiku-3(?:[-.]\d+)?", 0.25, 1.25),
]
ENTITIES = [("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&amp;", "&")]


def or_else(a: Column, b: Column) -> Column:
    """a, or b where a is null, zero or empty."""
    return F.when(a.isNotNull() & (a.cast("string") != "") & (F.coalesce(a.try_cast("double"), F.lit(1.0)) != 0), a).otherwise(b)


def to_float(c: Column, default: float = 0.0) -> Column:
    """A finite double, or default where the cast fails."""
    x = c.try_cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(default)).otherwise(x)


def clip_probability(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def cents_or_dollars(c: Column, live: bool = False) -> Column:
    """Cents to dollars where 1 < x <= 100; on the live path wherever x > 1, clipped to [0, 1]."""
    if live:
        return clip_probability(F.when(c > 1, c / 100).otherwise(c))
    return F.when((c > 1) & (c <= 100), c / 100).otherwise(c)


def parse_event_time(c: Column, fallback: Column) -> Column:
    """Epoch milliseconds above 1e10, epoch seconds above 1e9, else ISO text (Z allowed); fallback where none holds."""
    number = c.try_cast("double")
    text = F.try_to_timestamp(F.regexp_replace(c.cast("string"), "Z$", "+00:00"))
    at = F.when(number > 1e10, F.timestamp_millis(number.cast("long"))).when(number > 1e9, F.timestamp_seconds(number)).otherwise(F.when(number.isNull(), text))
    return F.coalesce(at, fallback)


def normalize_url(c: Column) -> Column:
    """Without query, fragment and trailing slashes."""
    return F.regexp_replace(F.regexp_replace(F.trim(c), "[?#].*$", ""), "/+$", "")


def url_slug(c: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(normalize_url(c), "^[a-zA-Z]+://[^/]*/?", ""), "/"), -1)


def url_is_valid(c: Column, domain: str | None = None) -> Column:
    """http or https with a host; with domain, that host or one below it, and a path event/<slug>."""
    ok = F.coalesce(c.rlike(r"^https?://[^/?#\s]+"), F.lit(False))
    if domain:
        host = F.lower(F.regexp_extract(c, r"^https?://([^/?#:\s]+)", 1))
        ok = ok & ((host == domain) | host.endswith("." + domain)) & normalize_url(c).rlike(r"^https?://[^/]+/event/[^/]+$")
    return ok


def unescape(c: Column) -> Column:
    for entity, char in ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def html_meta(html: Column) -> Column:
    """struct<title, description, image> of a page's Open Graph properties, attributes in either order; description falls back to the plain one."""
    one = lambda before, after: F.regexp_extract(html, rf"(?is)<meta[^>]*{before}=[\"']{after}", 1)
    value = r"([^\"']*)[\"']"
    meta = lambda attr, name: F.trim(unescape(or_else(one(attr, rf"{name}[\"'][^>]*content=[\"']{value}"), one("content", rf"{value}[^>]*{attr}=[\"']{name}[\"']"))))
    return F.struct(meta("property", "og:title").alias("title"), or_else(meta("property", "og:description"), meta("name", "description")).alias("description"), meta("property", "og:image").alias("image"))


def json_string_list(c: Column) -> Column:
    """array<string> of a JSON list in text; [] where it is none."""
    return F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))


def distinct_ci(arr: Column) -> Column:
    """The elements in order, each spelling but the first of a word dropped whatever its case; blanks dropped."""
    kept = F.filter(F.transform(arr, lambda x: F.trim(x)), lambda x: x != "")
    low = F.transform(kept, F.lower)
    return F.filter(kept, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)


def normalize_levels(arr: Column, side: str) -> Column:
    """Book levels struct<price, size>: bad numbers 0, empty levels dropped, bids from the highest price, asks from the lowest."""
    levels = F.filter(F.transform(arr, lambda x: F.struct(to_float(x["price"]).alias("price"), to_float(x["size"]).alias("size"))), lambda x: (x["price"] > 0) | (x["size"] > 0))
    return F.sort_array(levels, asc=side != "bid")


def depth(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda s, x: s + x["size"])


def complement_levels(arr: Column) -> Column:
    """Levels of NO as levels of YES: 1 - price."""
    return F.transform(arr, lambda x: F.struct((1 - x["price"]).alias("price"), x["size"].alias("size")))


def yes_probability(outcomes: Column, markets: Column, implied: Column) -> Column:
    """p(yes) of a snapshot whose outcomes are exactly yes and no; from the first market with the same outcomes and as many prices, else by the place of yes from implied."""
    low = lambda a: F.transform(a, F.lower)
    binary = lambda a: (F.size(a) == 2) & F.array_contains(low(a), "yes") & F.array_contains(low(a), "no")
    fit = F.get(F.filter(markets, lambda m: binary(m["outcomes"]) & (F.size(m["outcome_prices"]) == 2)), F.lit(0))
    from_market = F.get(fit["outcome_prices"], (F.array_position(low(fit["outcomes"]), "yes") - 1).cast("int"))
    by_place = F.when(F.array_position(low(outcomes), "yes") == 1, implied).otherwise(1 - implied)
    return F.when(binary(outcomes), F.coalesce(from_market, by_place))


def event_implied_probability(markets: Column) -> Column:
    """Price of yes (else of the first outcome) in the first market with a price for each outcome; 0 without one."""
    fit = F.get(F.filter(markets, lambda m: (F.size(m["outcomes"]) > 0) & (F.size(m["outcomes"]) == F.size(m["outcome_prices"]))), F.lit(0))
    yes = F.array_position(F.transform(fit["outcomes"], F.lower), "yes")
    return F.coalesce(F.get(fit["outcome_prices"], F.greatest(yes - 1, F.lit(0)).cast("int")), F.lit(0.0))


def percent_probability(c: Column) -> Column:
    """Percent with one decimal: null where not positive, as it is where over 1."""
    return F.when(c > 0, F.round(F.when(c > 1, c).otherwise(c * 100), 1))


def resolution_target(label: Column) -> Column:
    low = F.lower(F.trim(label))
    return F.when(low == "yes", 1).when(low == "no", 0)


def market_key(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def node_slug(c: Column, most: int = 48) -> Column:
    slug = F.substring(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, most)
    return F.when(slug == "", F.lit("node")).otherwise(slug)


def market_key_aliases(c: Column) -> Column:
    return F.array_distinct(F.array(market_key(c), F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")))


def reviewer_key(c: Column) -> Column:
    slug = F.substring(F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, 80)
    return F.when(F.coalesce(slug, F.lit("")) == "", F.lit("anonymous")).otherwise(slug)


def humanize(c: Column) -> Column:
    """An identifier as words: acronyms in capitals, others with a capital."""
    low = F.filter(F.split(F.lower(F.trim(F.translate(c, "_-", "  "))), " +"), lambda x: x != "")
    upper = F.create_map(*(F.lit(x) for kv in ACRONYMS.items() for x in kv))
    return F.array_join(F.transform(low, lambda w: F.coalesce(F.try_element_at(upper, w), F.initcap(w))), " ")


def format_metric(key: Column, value: Column) -> Column:
    """A metric's value as text, by what its name says: costs, latencies, tokens, rates, whole numbers, others."""
    low, whole = F.lower(key), value == F.floor(value)
    percent = F.concat(F.format_string("%.0f", value * 100), F.lit("%"))
    return (
        F.when(low.contains("cost"), F.format_string("$%.4f", value)).when(low.contains("latency"), F.format_string("%.0f ms", value)).when(low.contains("token"), F.format_number(value, 0))
        .when((low.contains("rate") | low.contains("confidence")) & (F.abs(value) <= 1), percent).when(whole, F.format_number(value, 0)).otherwise(F.format_string("%.2f", value))
    )


def trace_cost(model: Column, tokens_in: Column, tokens_out: Column, override: tuple[float, float] | None = None) -> Column:
    """Cost in USD to 6 decimals from a price table, or from override (in, out) per million tokens where one is positive."""
    used_in, used_out = F.greatest(tokens_in, F.lit(0)) / 1_000_000, F.greatest(tokens_out, F.lit(0)) / 1_000_000
    if override and max(override) > 0:
        return F.round(used_in * override[0] + used_out * override[1], 6)
    out = F.lit(0.0)
    for pattern, rate_in, rate_out in reversed(MODEL_PRICES):
        out = F.when(model.rlike(pattern), used_in * rate_in + used_out * rate_out).otherwise(out)
    return F.round(out, 6)


def normalize_review(issues: Column, quality: Column) -> Column:
    """struct<issues, quality>: issues (severity, ref, text) as one line each, quality in [0, 1], 0.65 where it is no number."""
    line = F.transform(issues, lambda x: F.trim(F.concat(F.when(x["severity"] != "", F.concat(F.lit("["), F.upper(x["severity"]), F.lit("] "))).otherwise(""), F.when(x["ref"] != "", F.concat(F.lit("("), x["ref"], F.lit(") "))).otherwise(""), x["text"])))
    return F.struct(F.filter(line, lambda x: x != "").alias("issues"), clip_probability(F.coalesce(quality.try_cast("double"), F.lit(0.65))).alias("quality"))


def compose_title(base: Column, question: Column, base_tokens: Column, question_tokens: Column) -> Column:
    """The event's title if it says all of the question; the question if both are close; else both."""
    from .tokens import jaccard

    said = F.size(F.array_except(question_tokens, base_tokens)) == 0
    joined = F.concat(base, F.when(base.endswith("?"), F.lit(" - ")).otherwise(F.lit(": ")), question)
    return F.when(said | (F.trim(question) == ""), base).when(jaccard(base_tokens, question_tokens) >= 0.55, question).otherwise(joined)


def is_mappable(market: Column) -> Column:
    """A plain binary market with some liquidity, open interest or price; titles of bundles don't qualify."""
    low = F.lower(market["title"])
    single = (F.coalesce(market["outcome_type"], F.lit("binary")) == "binary") & ((F.length(low) - F.length(F.replace(low, F.lit("yes "), F.lit("")))) / 4 <= 1) & (F.length(low) - F.length(F.replace(low, F.lit(","), F.lit(""))) < 3)
    return single & (F.greatest(*(F.coalesce(market[k], F.lit(0.0)) for k in ("volume", "liquidity", "open_interest", "last_price"))) > 0)
