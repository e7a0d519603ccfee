"""URL filter: host and path rules, and for other urls a logistic regression on hashed character n-grams.

All steps are DataFrame expressions and spark.ml stages. The model is trained from a small labelled table of urls, which is
a parameter; ``LABELLED`` is the default.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: (host, path prefix, verdict)
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
SIZES = (3, 4, 5)
FEATURES = 1 << 14
REGULARIZATION = 0.002
THRESHOLD = 0.5

# fixed values: host and path of labelled urls; the first group is to be blocked
LABELLED = (
    [(h, p, 1) for h, p in (
        ("free-bets.example.org", "/en/1"), ("best-bets.test", "/win/now"), ("online-casino.test", "/play"), ("casino-bonus.test", "/en/slots"),
        ("mega-slots.test", "/jackpot"), ("poker-win.test", "/free-chips"), ("lucky-jackpot.test", "/claim"), ("spam-farm.test", "/a/1.html"),
        ("link-farm.test", "/page/2"), ("content-farm.example.net", "/de/7"), ("cheap-pills.test", "/buy"), ("pharma-discount.test", "/cheap-meds"),
        ("adult-cams.test", "/live"), ("xxx-tube.test", "/video/1"), ("porn-free.test", "/hd"), ("sexy-dates.test", "/join"),
        ("hot-singles.test", "/signup"), ("click-bait.test", "/you-wont-believe"), ("free-gift-cards.test", "/claim-now"), ("win-prize.test", "/winner"),
        ("replica-watches.test", "/sale"), ("payday-loans.test", "/apply-now"), ("fast-loans.test", "/quick-cash"), ("warez-crack.test", "/keygen"),
        ("torrent-movies.test", "/download-free"), ("buy-followers.test", "/cheap"), ("seo-spam.test", "/backlinks"), ("free-money.test", "/earn-fast"),
        ("blog.online-casino.example.org", "/en/5"), ("m.casino-bonus.example.com", "/de/8"), ("www.poker-win.example.net", "/es/2"), ("blog.mega-slots.example.net", "/en/77"),
        ("www.cheap-pills.example.com", "/en/6"), ("m.adult-cams.example.org", "/fr/2"), ("blog.payday-loans.example.com", "/es/81"), ("casino-club.example.net", "/en/4.html"),
        ("bets-today.example.com", "/fr/9"), ("spam-links.example.org", "/es/3"),
    )]
    + [(h, p, 0) for h, p in (
        ("www.example.org", "/en/1"), ("blog.example.net", "/de/22"), ("m.example.com", "/fr/303"), ("example.org", "/es/4"),
        ("news.test", "/2020/01/report"), ("library.test", "/catalog/item/9"), ("www.university.test", "/research/paper.html"), ("docs.test", "/guide/install"),
        ("wiki.test", "/page/History"), ("museum.test", "/collections"), ("weather.test", "/city/12"), ("gov.test", "/forms/tax"),
        ("hospital.test", "/departments"), ("school.test", "/timetable"), ("blog.garden.test", "/roses"), ("recipes.test", "/soup/lentil"),
        ("travel.test", "/trains/map"), ("forum.test", "/thread/88"), ("code.test", "/project/readme"), ("music.test", "/concerts"),
        ("www.thhere.example.net", "/en/41"), ("blog.erand.example.org", "/de/17.html"), ("m.onthe.example.com", "/fr/5/"), ("tinand.example.net", "/es/60"),
        ("blog.harbour.example.org", "/en/80"), ("m.village.example.net", "/en/32"), ("www.river.example.com", "/fr/13"), ("blog.mountain.example.com", "/es/25"),
        ("garden.example.org", "/de/7.html"), ("www.threadstone.example.net", "/en/90/"), ("m.heath.example.org", "/en/47"), ("blog.ensemble.example.net", "/fr/66"),
        ("winter.example.com", "/en/12"), ("clubhouse.example.net", "/en/3"), ("betterment.example.org", "/de/51"), ("blog.lending-library.example.com", "/en/18"),
        ("sport.test", "/results/league"), ("science.test", "/physics/waves"), ("law.test", "/statutes/12"), ("history.test", "/archive/1900"),
        ("market.test", "/prices/wheat"), ("city.test", "/services/water"), ("theatre.test", "/plays"), ("maps.test", "/region/north"),
        ("", ""), ("art.test", "/painting/5"), ("books.test", "/review/3"), ("health.test", "/advice/sleep"),
        ("www.example.com", "/en/9"), ("blog.example.org", "/fr/12"), ("m.example.net", "/en/8.html"), ("example.net", "/de/3/"),
        ("energy.test", "/wind/report"), ("bank.test", "/branches"), ("radio.test", "/schedule"), ("zoo.test", "/animals/bear"),
        ("film.test", "/archive/silent"), ("farmers.test", "/market-days"), ("betsy.test", "/letters"), ("freedom.test", "/essays"),
    )]
)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for a null or one without ``://``."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    found = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(url, found, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(url, found, 2)


def _grams(host: Column, path: Column) -> Column:
    """Marked character n-grams of the host and of the path, as strings that tell both apart."""
    made = []
    for mark, text in (("h", host), ("p", path)):
        for n in SIZES:
            made.append(_cut(F.concat(F.lit("^"), text, F.lit("$")), n, mark))
    return F.concat(*made)


def _cut(text: Column, n: int, mark: str) -> Column:
    starts = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda k: F.concat(F.lit(mark), F.substr(text, k, F.lit(n))))


def labelled_urls(spark: SparkSession, rows: Sequence[tuple[str, str, int]] = LABELLED) -> DataFrame:
    """host, path, label of a labelled list."""
    values = F.array(*[F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(float(y)).alias("label")) for h, p, y in rows])
    return spark.range(1).select(F.inline(values))


def train(labelled: DataFrame):
    """A fitted pipeline from a table with host, path and label (1: block). Rows with a null label are left out."""
    rows = labelled.filter(F.col("label").isNotNull())
    rows = rows.select(_grams(F.coalesce("host", F.lit("")), F.coalesce("path", F.lit(""))).alias("grams"), F.col("label").cast("double").alias("label"))
    hashed = HashingTF(inputCol="grams", outputCol="hashed", numFeatures=FEATURES, binary=True)
    model = LogisticRegression(featuresCol="hashed", labelCol="label", regParam=REGULARIZATION, standardization=False, maxIter=200)
    return Pipeline(stages=[hashed, model]).fit(rows)


def _rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest rule that fits, as a struct of its text and verdict; null if none. Of equal rules, block wins."""
    if not rules:
        return F.lit(None).cast("struct<size:int,rule:string,blocks:boolean,verdict:string>")
    fits = []
    for rule_host, rule_path, verdict in rules:
        at = (host == rule_host) | F.endswith(host, F.lit(f".{rule_host}"))
        rule = F.struct(
            F.lit(len(rule_host + rule_path)).alias("size"), F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict == "block").alias("blocks"), F.lit(verdict).alias("verdict")
        )
        fits.append(F.when(at & F.startswith(path, F.lit(rule_path)), rule))
    return F.array_max(F.array(*fits))


def filter_urls(pages: DataFrame, model, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """``row`` (the columns of pages) with host, path, rule, score (probability of block by the model) and verdict.

    A rule decides where one fits; otherwise the model does, at ``THRESHOLD``. One projection, no shuffle. A null url, or one
    without ``://``, has an empty host and path, fits no rule and is judged by the model.
    """
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("row"))
    host, path = split_url(F.col("row.url"))
    rows = rows.select("row", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("grams", _grams(F.col("host"), F.col("path")))
    scored = model.transform(rows)
    scored = scored.select("row", "host", "path", vector_to_array("probability")[1].alias("score"), _rule(F.col("host"), F.col("path"), rules).alias("fit"))
    judged = F.when(F.col("score") >= THRESHOLD, "block").otherwise("allow")
    return scored.select("row", "host", "path", F.col("fit.rule").alias("rule"), "score", F.coalesce(F.col("fit.verdict"), judged).alias("verdict"))
