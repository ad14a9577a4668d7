"""URL filters: rules by host and path, then logistic regression on hashed character n-grams.

Everything is SQL functions and Spark's own logistic regression; no Python runs on the
executors.  The n-grams of host and path (each between marks, told apart by a prefix) are
hashed to DIMENSIONS places; the model, fitted on a small labelled table, is an array of
as many weights, and a URL's log-odds are the sum of its n-grams' weights.

A rule (action, host, path) fits a URL if the URL's host is the rule's or a subdomain of
it and its path starts with the rule's; of those that fit, the longest decides (host and
path together; of equally long ones, the first in the list).

Defined results: a null URL, or one without ``://``, has empty host and path, which no
rule of the list fits and which the method allows; empty texts likewise; repeated rows
are judged each; an empty table gives no rows; columns besides id and URL are not read.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DIMENSIONS, GRAMS, RIDGE = 16_384, (3, 4, 5), 0.002

RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))

#: Invented hosts on reserved domains, to block and to allow; none of them occurs in a table that is judged.
BAD_HOSTS = (
    "royal-casino.example", "www.casino-palace.example", "m.big-casino.example", "blog.casino-royale.example", "online-casino.example", "sports-bets.example", "m.bets-today.example",
    "www.sure-bets.example", "best-bets-now.example", "blog.free-betting.example", "diet-pills.example", "www.pills-online.example", "m.cheap-meds.example", "discount-pharmacy.example", "blog.cheap-viagra.example",
    "hot-singles.example", "adult-cams.example", "xxx-tube.example", "www.xxx-free.example", "adult-videos.example", "poker-slots.example", "slots-jackpot.example", "www.win-jackpot.example",
    "win-a-phone.example", "free-money.example", "payday-loans.example", "cheap-loans.example", "replica-watches.example", "cracked-apps.example", "free-torrents.example", "warez-keygen.example",
    "click-here-now.example", "buy-followers.example", "ads-server.example", "m.popup-ads.example", "ad-tracker.example", "track-clicks.example", "spam-mailer.example", "www.spam-links.example", "link-farm.example",
)
GOOD_HOSTS = (
    "news.example", "www.daily-news.example", "m.weather.example", "blog.garden.example", "library.example", "school.example",
    "m.school.example", "www.sports-club.example", "best-recipes.example", "blog.travel.example", "museum.example", "www.museum.example", "m.health.example", "science-online.example",
    "blog.books.example", "kitchen.example", "railway.example", "station.example", "www.northern.example", "together.example", "weather-maps.example", "www.mothers.example",
    "city-council.example", "open-source.example", "music-shop.example", "docs.example", "archive.example", "history.example", "maps.example", "physics.example",
    "brothers.example", "m.leather.example", "blog.marathon.example", "panther.example", "www.nations.example", "parish.example", "m.bakery.example", "theatre.example",
    "blog.chess.example", "orchard.example", "pharmacy-school.example", "farmers.example", "address.example", "wine.example", "www.adults-learn.example", "freedom.example",
    "windows.example", "tracks.example", "alphabet.example", "cheaper-energy.example", "beach.example", "gardens.example", "www.castle.example", "river.example",
    "blog.forest.example", "mountain.example",
)
#: Paths that both kinds get in turn, so that hosts decide.
PATHS = ("/en/12", "/de/731/", "/es/44?page=2", "/fr/9.html", "/en/101#top", "/shop/2", "/", "/archive/7?utm_source=feed", "/fr/818/")
LABELLED = tuple((f"https://{h}{PATHS[i % len(PATHS)]}", bad) for hosts, bad in ((BAD_HOSTS, 1), (GOOD_HOSTS, 0)) for i, h in enumerate(hosts))


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    part = lambda i: F.coalesce(F.regexp_extract(url, r"://([^/?#]*)([^?#]*)", i), F.lit(""))
    return lower_ascii(part(1)), part(2)


def deciding(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule, host and path joined, and its action; null if none fits."""
    found = action = None
    for act, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        found = F.when(fits, h + p) if found is None else found.when(fits, h + p)
        action = F.when(fits, act) if action is None else action.when(fits, act)
    none = F.lit(None).cast("string")
    return (none, none) if found is None else (found, action)


def places(host: Column, path: Column, sizes: Sequence[int] = GRAMS, dimensions: int = DIMENSIONS) -> Column:
    """The distinct places of all n-grams of host and path."""

    def grams(text: Column, mark: str, n: int) -> Column:
        marked = F.concat(F.lit("^"), text, F.lit("$"))
        starts = F.sequence(F.lit(1), F.greatest(F.length(marked) - (n - 1), F.lit(1)))
        return F.transform(starts, lambda i: F.pmod(F.xxhash64(F.concat(F.lit(mark), F.substr(marked, i, F.lit(n)))), F.lit(dimensions)).cast("int"))

    return F.array_distinct(F.concat(*(grams(t, m, n) for t, m in ((host, "h"), (path, "p")) for n in sizes)))


def train(labelled: DataFrame) -> tuple[list[float], float]:
    """Weights and intercept from (url, bad): a fit on a table small enough for a file of source text.

    Only places that occur in it are fitted, as sparse vectors: the ridge leaves all others at zero.
    """
    at = F.transform(places(*host_and_path(F.col("url"))), lambda i: i.cast("string"))
    rows = labelled.select(at.alias("at"), F.col("bad").cast("double").alias("label")).coalesce(1)
    seen = CountVectorizer(inputCol="at", outputCol="features", vocabSize=DIMENSIONS, binary=True).fit(rows)
    model = LogisticRegression(regParam=RIDGE, elasticNetParam=0.0, maxIter=60, standardization=False).fit(seen.transform(rows))
    weights = [0.0] * DIMENSIONS
    for place, weight in zip(seen.vocabulary, model.coefficients.toArray().tolist()):
        weights[int(place)] = weight
    return weights, float(model.intercept)


def labelled_table(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"('{u}', {b})" for u, b in LABELLED)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(url, bad)")


def judged(pages: DataFrame, model: tuple[list[float], float], rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and score, the log-odds of a block, of every row of (page_id, url)."""
    weights, intercept = model
    table = F.from_json(F.lit(json.dumps(weights)), "array<double>")
    host, path = host_and_path(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    score = F.aggregate(F.transform(places(F.col("host"), F.col("path")), lambda i: F.get(table, i)), F.lit(intercept), lambda s, x: s + x)
    rule, action = deciding(F.col("host"), F.col("path"), rules)
    named = (F.col("host") != "") | (F.col("path") != "")
    guess = F.when(named & (F.col("score") > 0), "block").otherwise("allow")
    return parts.select("page_id", "host", "path", rule.alias("rule"), action.alias("action"), score.alias("score")).select("page_id", "host", "path", "rule", F.coalesce("action", guess).alias("verdict"), "score")


def op9_url_filter(spark, sf_dir: str) -> DataFrame:
    """Every url of pages."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").cast("long"), "url")
    return judged(pages, train(labelled_table(spark)))
