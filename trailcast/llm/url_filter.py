"""URL filter: block and allow rules first, then logistic regression on hashed character n-grams.

The model is trained from a small labelled URL table. Everything is DataFrame operations; the
expressions of scoring stay in the JVM and need no shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Hash buckets of the n-gram counts: bounds the model, and so what scoring ships to each task.
BUCKETS = 1 << 15
#: Lengths of the character n-grams.
GRAMS = (3, 4, 5)
#: Rules that become literals of the plan; a longer list is joined as a table.
MAX_RULES = 100
#: Labelled rows used for the fit at most (a hash order chooses them).
MAX_LABELLED = 200_000

#: The small labelled URL table (1: block).
LABELLED = [
    ("http://casino-bonus.example.com/en/1", 1), ("https://www.casino-win.example.org/play/22", 1),
    ("http://best-casino.example.com/slots", 1), ("https://m.casino-king.example.org/de/7.html", 1),
    ("http://free-bets.example.com/en/19", 1), ("https://bets-online.example.org/fr/3", 1),
    ("http://www.sport-bets.example.com/odds?page=2", 1), ("https://blog.free-bets.example.org/es/14", 1),
    ("http://cheap-pills.example.com/en/88", 1), ("https://pills-store.example.org/buy/4", 1),
    ("http://www.cheap-pills.example.org/de/51/", 1), ("https://m.diet-pills.example.com/fr/6", 1),
    ("http://adult-x.example.com/en/31", 1), ("https://www.adult-cams.example.org/live", 1),
    ("http://adult-x.example.org/es/12", 1), ("https://m.adult-video.example.com/xxx/5", 1),
    ("http://spam-farm.example.com/en/9", 1), ("https://www.spam-farm.example.org/de/10", 1),
    ("http://link-farm.example.com/seo/1", 1), ("https://blog.spam-links.example.org/fr/2", 1),
    ("http://ads-track.example.com/en/17", 1), ("https://ads-server.example.org/click?id=5", 1),
    ("http://www.ads-track.example.org/pixel.gif", 1), ("https://m.track-ads.example.com/es/8", 1),
    ("http://thering.example.com/en/1", 0), ("https://www.ertion.example.org/de/22", 0),
    ("http://heread.example.com/about", 0), ("https://m.tionst.example.org/de/7.html", 0),
    ("http://weather.example.com/en/19", 0), ("https://library.example.org/fr/3", 0),
    ("http://www.science-news.example.com/physics?page=2", 0), ("https://blog.gardening.example.org/es/14", 0),
    ("http://city-museum.example.com/en/88", 0), ("https://university.example.org/courses/4", 0),
    ("http://www.recipes.example.org/de/51/", 0), ("https://m.history.example.com/fr/6", 0),
    ("http://open-source.example.com/en/31", 0), ("https://www.language-school.example.org/lessons", 0),
    ("http://ththan.example.org/es/12", 0), ("https://m.onther.example.com/story/5", 0),
    ("http://tionble.example.com/en/9", 0), ("https://www.ererin.example.org/de/10", 0),
    ("http://health-guide.example.com/vaccines/1", 0), ("https://blog.travel.example.org/fr/2", 0),
    ("http://docs.example.com/en/17", 0), ("https://forum.example.org/topic?id=5", 0),
    ("http://www.maps.example.org/city.html", 0), ("https://m.ndstor.example.com/es/8", 0),
    ("https://m.ads-track.example.org/en/2", 1), ("http://m.ads-banner.example.com/de/4", 1),
    ("https://blog.tiontion.example.com/fr/60/", 0), ("http://blog.cooking.example.com/en/71", 0),
    ("https://blog.thread.example.org/de/15#top", 0), ("http://blog.astronomy.example.com/", 0),
]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty if it is null or has no ``://``."""
    pattern = "(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.coalesce(F.regexp_extract(url, pattern, 1), F.lit(""))
    path = F.coalesce(F.regexp_extract(url, pattern, 2), F.lit(""))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def matched_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule (verdict, ``host/path``) that fits, as a struct; null without one.

    A rule fits its host and all subdomains if the path starts with the rule's. Of rules of one
    length the one named first wins.
    """
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: -len(r[1]))[::-1]:
        rule_host, slash, rule_path = rule.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(slash + rule_path)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """(verdict, rule, place) for ``joined_rules``."""
    return spark.createDataFrame([(v, r, k) for k, (v, r) in enumerate(rules)], "verdict string, rule string, place long")


def joined_rules(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """Add ``_rule`` as ``matched_rule`` does, for any number of rules (verdict, rule, place).

    Every suffix of a host meets the rules of that host; the longest that fits the path stays, of equally
    long ones that with the smallest place.
    """
    cut = F.instr("rule", "/")
    named = rules.select(
        F.when(cut > 0, F.substring_index("rule", "/", 1)).otherwise(F.col("rule")).alias("_host"),
        F.when(cut > 0, F.expr("substring(rule, instr(rule, '/'))")).otherwise("").alias("_path"), "rule", "verdict", "place")
    parts = F.split("host", "\\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    spread = rows.withColumn("_row", F.monotonically_increasing_id()).withColumn("_host", F.explode(suffixes))
    met = spread.join(named, "_host", "left")
    fits = F.col("path").startswith(F.col("_path"))
    best = F.max(F.when(fits, F.struct(F.length("rule").alias("size"), (-F.col("place")).alias("first"), "rule", "verdict")))
    kept = F.first(F.struct(*rows.columns)).alias("_all")
    found = met.groupBy("_row").agg(kept, best.alias("_best"))
    return found.select("_all.*", F.when(F.col("_best").isNotNull(), F.struct(
        F.col("_best.rule").alias("rule"), F.col("_best.verdict").alias("verdict"))).alias("_rule"))


def _grams(mark: str, text: Column) -> Column:
    """Character n-grams of a text with its ends marked; ``mark`` tells host from path."""
    text = F.concat(F.lit("^"), text, F.lit("$"))
    return F.flatten(F.array(*[
        F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - F.lit(n - 1), F.lit(1))),
                    lambda i, n=n: F.concat(F.lit(mark), text.substr(i, F.lit(n))))
        for n in GRAMS]))


def grams(host: Column, path: Column) -> Column:
    """Distinct marked n-grams of host and path."""
    return F.array_distinct(F.concat(_grams("h", host), _grams("p", path)))


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The default labelled table (url, label)."""
    return spark.createDataFrame(LABELLED, "url string, label int")


def fit(labelled: DataFrame, reg: float = 0.001, max_iter: int = 100) -> PipelineModel | None:
    """Logistic regression from (url, label 0/1); at most MAX_LABELLED rows. None without both labels."""
    rows = labelled.where("label is not null").select("url", F.col("label").cast("double").alias("label"))
    rows = rows.orderBy(F.xxhash64("url"), "url", "label").limit(MAX_LABELLED)
    if rows.agg(F.countDistinct("label")).first()[0] < 2:
        return None
    host, path = host_and_path(F.col("url"))
    table = rows.select("label", grams(host, path).alias("_grams"))
    tf = HashingTF(inputCol="_grams", outputCol="_counts", numFeatures=BUCKETS, binary=True)
    model = LogisticRegression(featuresCol="_counts", labelCol="label", regParam=reg, maxIter=max_iter,
                               predictionCol="_said", probabilityCol="_probability", rawPredictionCol="_raw")
    return PipelineModel([tf, model.fit(tf.transform(table))])


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] | DataFrame, model: PipelineModel | None, url: str = "url",
          threshold: float = 0.5) -> DataFrame:
    """Add host, path, rule, p_block and verdict to every row.

    A rule decides if one fits, else the model (block if p_block >= threshold). Null urls and
    urls without ``://`` have empty host and path, are judged by the model like any other, and so
    are repeated rows. Columns of these names in the input are replaced; others pass through.
    Without a model (labels of one kind) the verdict is allow unless a rule blocks. Up to MAX_RULES
    rules are part of the plan; more of them, or a table (verdict, rule, place), are joined.
    """
    keep = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "p_block")]
    host, path = host_and_path(F.col(url))
    rows = pages.select(F.struct(*keep).alias("_in"), host.alias("host"), path.alias("path"))
    if isinstance(rules, DataFrame) or len(rules) > MAX_RULES:
        rows = joined_rules(rows, rules if isinstance(rules, DataFrame) else rule_table(pages.sparkSession, rules))
    else:
        rows = rows.withColumn("_rule", matched_rule(F.col("host"), F.col("path"), rules))
    if model is None:
        scored = rows.withColumn("p_block", F.lit(0.0))
    else:
        scored = model.transform(rows.withColumn("_grams", grams(F.col("host"), F.col("path"))))
        scored = scored.withColumn("p_block", vector_to_array("_probability")[1])
    verdict = F.coalesce(F.col("_rule.verdict"), F.when(F.col("p_block") >= threshold, "block").otherwise("allow"))
    return scored.select(F.col("_in.*"), "host", "path", F.col("_rule.rule").alias("rule"), verdict.alias("verdict"),
                         "p_block")
