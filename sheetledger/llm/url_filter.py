"""URL filters: listed rules first, then a logistic regression on hashed character n-grams.

Host and path are cut out of the URL; the longest rule that fits decides.  All other URLs get the
verdict of a model trained on a small labelled table.  Only DataFrame operations and Spark's own machine
learning stages run; nothing is shuffled but the training rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.common import literal_table
from .license_scan import _LOWER, _UPPER

#: host, then path: from the first '://' on.
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
GRAMS = (3, 4)
BUCKETS = 1 << 15

#: Labelled words of hosts, for the small training table below; listed by the author of this module.
BLOCKED_WORDS = ("ads", "adult", "bet", "bets", "betting", "bonus", "casino", "cheap", "click", "crack", "dating", "deals", "escort", "farm", "free", "gamble",
                 "hack", "jackpot", "keygen", "loan", "loans", "lottery", "malware", "phish", "pills", "poker", "porn", "prize", "replica", "sex", "slots", "spam",
                 "spyware", "torrent", "track", "tracker", "viagra", "warez", "win", "xxx")
CLEAN_WORDS = ("archive", "article", "atlas", "biology", "blog", "books", "bridge", "city", "climate", "college", "courier", "docs", "earth", "essay", "forum",
               "gallery", "garden", "history", "house", "journal", "kitchen", "law", "letters", "library", "maps", "market", "medicine", "museum", "music",
               "nation", "north", "ocean", "opera", "papers", "physics", "poetry", "press", "recipes", "research", "review", "river", "school", "science",
               "society", "stories", "theatre", "there", "this", "thought", "times", "tion", "travel", "tribune", "university", "village", "water", "weather", "wiki",
               "winter", "writing")


def labelled_urls(spark: SparkSession) -> DataFrame:
    """url, label (1: block): a few hundred made of the words above, over the same domains, languages and path shapes."""
    ends, langs, rows = ("com", "net", "org"), ("en", "de", "fr", "es"), []
    for label, words in ((1.0, BLOCKED_WORDS), (0.0, CLEAN_WORDS)):
        for i, w in enumerate(words):
            other, end, lang, n = words[(i * 7 + 3) % len(words)], ends[i % 3], langs[i % 4], 1000 + 37 * i
            rows.append((f"https://{w}-{other}.example.{end}/{lang}/{n}", label))
            rows.append((f"http://{w}.example.{ends[(i + 1) % 3]}/{langs[(i + 1) % 4]}/{n + 1}.html", label))
            if label == 0.0:
                front = ("m", "blog", "www")[i % 3]
                rows += [(f"https://{front}.{w}{other}.example.{end}/{lang}/{n + 2}/", label), (f"http://{w}{other}.example.{end}/{lang}/{n + 3}?page=2", label)]
    return literal_table(spark, rows, "url string, label double")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null and for URLs without '://'."""
    text = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(text, _PARTS, 1), _UPPER, _LOWER), F.regexp_extract(text, _PARTS, 2)


def fits(host: Column, path: Column, rule: str) -> Column:
    """A rule is a host, with all subdomains, and the start of a path."""
    at, slash, rest = rule.partition("/")
    return ((host == at) | host.endswith("." + at)) & path.startswith(slash + rest)


def _grams(host: Column, path: Column) -> Column:
    def cut(text: Column, mark: str, n: int) -> Column:
        last = F.length(text) - (n - 1)
        return F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.concat(F.lit(mark), F.substring(text, i, F.lit(n))))
                      ).otherwise(F.array().cast("array<string>"))

    framed = F.concat(F.lit("^"), host, F.lit("$")), F.concat(path, F.lit("$"))
    return F.array_distinct(F.flatten(F.array(*[cut(t, m, n) for t, m in zip(framed, "hp") for n in GRAMS])))


def _features(urls: DataFrame) -> DataFrame:
    counted = urls.withColumn("_grams", _grams(F.col("_host"), F.col("_path")))
    return HashingTF(numFeatures=BUCKETS, binary=True, inputCol="_grams", outputCol="_features").transform(counted)


def train(labelled: DataFrame, steps: int = 40, penalty: float = 0.002) -> LogisticRegressionModel:
    """Model from a small table (url, label 0 or 1); its size is the caller's."""
    host, path = host_and_path(F.col("url"))
    rows = _features(labelled.select(host.alias("_host"), path.alias("_path"), "label"))
    return LogisticRegression(featuresCol="_features", labelCol="label", predictionCol="_guess", probabilityCol="_share", rawPredictionCol="_raw",
                              maxIter=steps, regParam=penalty).fit(rows)


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]], model: LogisticRegressionModel, id_col: str = "page_id", url_col: str = "url",
          threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict, score for every row.

    ``rules``: (rule, verdict); the longest that fits decides, and of equal ones the first.  Else the verdict is
    'block' from ``threshold`` of the model's probability on; ``score`` is that probability for every row.  A null or
    malformed URL has an empty host and path, fits no rule and gets the model's verdict on nothing.  Rows keep their
    places; other columns are ignored; an empty table gives an empty result.
    """
    host, path = host_and_path(F.col(url_col).cast("string"))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("_host"), path.alias("_path"))
    scored = model.transform(_features(rows))
    rule, verdict = F.lit(None).cast("string"), F.when(F.col("score") >= threshold, "block").otherwise("allow")
    for text, answer in sorted(reversed(rules), key=lambda r: len(r[0])):  # the longest wraps the others, so it is asked first
        hit = fits(F.col("_host"), F.col("_path"), text)
        rule, verdict = F.when(hit, F.lit(text)).otherwise(rule), F.when(hit, F.lit(answer)).otherwise(verdict)
    return scored.withColumn("score", vector_to_array("_share")[1]).select(
        "page_id", F.col("_host").alias("host"), F.col("_path").alias("path"), rule.alias("rule"), verdict.alias("verdict"), "score")
