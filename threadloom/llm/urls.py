"""URL filter: rules first, else logistic regression on hashed character n-grams of host and path."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# fixed values: (verdict, host, path) rules of the registered query
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))

# fixed values: a small labelled URL table to train from
BLOCKED = """
http://www.cheap-pills.example.com/buy/12 https://pharmacy-discount.example.net/pills/order http://spam-farm.example.org/links/44 https://link-farm.example.com/seo/backlinks
https://casino-bonus.example.net/slots/win http://online-casino.example.org/poker?ref=x https://free-money.example.com/click/here http://win-prizes.example.net/lottery/claim
https://adult-cams.example.com/live/xxx http://xxx-video.example.net/free/17 https://warez-crack.example.org/keygen/9 http://torrent-free.example.com/download/full
https://replica-watches.example.net/sale/cheap http://payday-loans.example.com/fast/cash https://malware-host.example.net/update/exe http://phishing-login.example.org/verify/account
https://buy-followers.example.com/likes/cheap http://cheap-viagra.example.net/en/450?page=2 https://spamblog.example.com/en/8 http://betting-tips.example.org/bonus/free
""".split()
ALLOWED = """
https://www.example.com/en/825 http://blog.example.net/fr/12.html https://news.example.org/de/article/77 https://m.example.com/es/300
https://docs.example.net/guide/install http://university.example.org/research/papers https://library.example.com/catalog/9?page=2 https://museum.example.net/en/exhibits
http://recipes.example.org/en/soup https://weather.example.com/fr/today https://wiki.example.net/en/history.html http://garden.example.org/de/plants
https://school.example.com/es/math http://music.example.net/en/album/5 https://travel.example.org/fr/paris https://www.health.example.com/en/advice?utm_source=feed
http://city.example.net/de/council https://science.example.org/en/space#top http://books.example.com/en/review/31 https://blog.theatre.example.net/en/960
""".split()


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without one."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1), upper, upper.lower())


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null where none does. A rule also fits subdomains.

    The rules are a short list from configuration: one expression, longest first.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def gram_slots(host: Column, path: Column, sizes=(3, 4, 5), slots: int = 4096) -> Column:
    """Distinct slots of the character n-grams of ``^host$`` and of the path, each hashed with its part's mark.

    A text shorter than n has no gram of that size.
    """
    none = F.array().cast("array<int>")

    def slide(mark: str, text: Column, n: int) -> Column:
        slot = lambda t, i: F.pmod(F.xxhash64(F.lit(mark), t.substr(i, F.lit(n))), F.lit(slots)).cast("int")
        # the inner array binds the text once
        own = F.transform(F.array(text), lambda t: F.when(F.length(t) < n, none).otherwise(F.transform(F.sequence(F.lit(1), F.length(t) - (n - 1)), lambda i: slot(t, i))))
        return own[0]

    parts = (("h", F.concat(F.lit("^"), host, F.lit("$"))), ("p", path))
    return F.array_distinct(F.concat(*[slide(mark, text, n) for mark, text in parts for n in sizes]))


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The built-in labelled table: (url, label), 1 for block."""
    return spark.createDataFrame([(u, 1.0) for u in BLOCKED] + [(u, 0.0) for u in ALLOWED], "url string, label double")


def train(labelled: DataFrame, slots: int = 4096, penalty: float = 0.02) -> tuple[float, list[float]]:
    """(intercept, weights by slot) of a logistic regression over a small labelled table (url, label).

    The weights, of fixed number, are all that reaches the driver. A table with
    one class or none gives weights 0 and the sign of that class.
    """
    rows = labelled.filter(F.col("url").isNotNull() & F.col("label").isNotNull())
    sides = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(sides) < 2:
        return (1.0 if 1.0 in sides else -1.0), [0.0] * slots
    grams = gram_slots(host_of(F.col("url")), path_of(F.col("url")), slots=slots)
    dense = F.transform(F.array(grams), lambda g: F.transform(F.sequence(F.lit(0), F.lit(slots - 1)), lambda i: F.array_contains(g, i).cast("double")))[0]
    table = rows.coalesce(1).select(array_to_vector(dense).alias("features"), F.col("label").cast("double").alias("label"))
    model = LogisticRegression(maxIter=100, regParam=penalty, standardization=False).fit(table)
    return float(model.intercept), [float(w) for w in model.coefficients.toArray()]


def filter_urls(pages: DataFrame, labelled: DataFrame, rules=RULES, slots: int = 4096) -> DataFrame:
    """(page_id, host, path, rule, verdict, score): the verdict of the longest rule, else of the model.

    The model blocks where its log-odds, told as ``score``, are above 0. No
    shuffle: one projection over the pages. A null url, or one without
    ``://``, has an empty host and path and is judged by the model; repeated
    rows get a row each; an empty table gives no rows; other columns are ignored.
    """
    intercept, weights = train(labelled, slots)
    table = F.array(*[F.lit(w) for w in weights])
    judged = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    total = F.aggregate(gram_slots(F.col("host"), F.col("path"), slots=slots), F.lit(intercept), lambda acc, i: acc + F.get(table, i))
    return (
        judged.withColumn("rule", rule).withColumn("ruled", verdict).withColumn("score", F.round(total, 9))
        .select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("score") > 0, "block").otherwise("allow")).alias("verdict"), "score")
    )
