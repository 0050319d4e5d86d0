"""URL filter: host and path rules, and logistic regression on hashed character n-grams.

Everything is DataFrame and SQL functions. The labelled table is small (at most
``MOST_LABELLED`` rows), so the regression is solved in its dual: the Gram matrix
of the labelled URLs is one join, gradient steps on one coefficient per URL
are one ``aggregate`` expression over an array, and the weights of the ``BUCKETS``
hashed n-grams are sums of coefficients. A single row holds the weights; the scan
of the pages reads it as a scalar subquery.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 8192
SIZES = (2, 3, 4)
MOST_LABELLED = 500
STEPS, RATE, RIDGE = 400, 0.3, 0.001
THRESHOLD = 0.5

#: (host, path prefix, verdict); a rule fits its host and all subdomains, the longest one wins.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)

#: Invented labels: host words a reviewer would block or let pass; URLs are built around them by one rule.
BLOCKED_WORDS = (
    "cheap-pills", "discount-pills", "casino-royal", "win-casino", "adult-video", "adult-dating", "xxx-pics", "free-bets",
    "sports-bets", "spam-links", "link-farm", "spam-seo", "payday-loans", "fast-loans", "replica-watches", "cheap-viagra",
    "poker-win", "free-money", "porn-free", "crypto-win", "slots-jackpot", "meds-cheap", "bets-now", "farm-spam",
    "escort-x", "lottery-win", "pills-online", "adult-x-cams", "free-casino", "hot-singles",
)
ALLOWED_WORDS = (
    "townpaper", "library", "gardener", "museum", "weather", "kitchen", "university", "hospital", "archive", "cycling",
    "travel", "school", "software", "journal", "theatre", "streets", "station", "nature", "mother", "northern",
    "orchestra", "weekly", "nations", "brother", "father", "whether", "health", "earth", "month", "theory",
    "thermal", "ethics", "method", "gothic", "rhythm", "truth", "action", "motion", "option", "auction",
    "caution", "fiction", "things", "another", "together", "thirteen", "thread", "leather", "feather", "clothing",
    "breathe", "southern", "therein", "thereon", "thorn", "thatch", "height", "length", "section", "solution",
    "location", "edition", "relation", "tradition", "athletic", "cathedral", "panther", "heather", "rather", "gather",
)
_STARTS = ("https://www.", "http://blog.", "https://", "http://m.")
_ENDS = (".test/en/", ".test/fr/", ".test/news/", ".test/de/", ".test/es/")
_TAILS = ("", ".html", "/", "?page=2")


def _urls(words: tuple[str, ...]) -> list[str]:
    """Every word once, with starts, ends, numbers and tails in turn, alike for both labels."""
    return [
        f"{_STARTS[i % 4]}{word}{_ENDS[i % 5]}{(i * 37) % 1000}{_TAILS[i % 4]}" for i, word in enumerate(words)
    ]


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The default labelled table: url, blocked."""
    rows = ", ".join(f"('{u}', {y}D)" for y, words in ((1, BLOCKED_WORDS), (0, ALLOWED_WORDS)) for u in _urls(words))
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(url, blocked)")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z folded) and path of a URL; both empty without ``://``."""
    part = lambda k: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", k), F.lit(""))
    return F.translate(part(1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), part(2)


def _bucket(mark: str, buckets: int):
    def of(gram: Column) -> Column:  # one parameter: a second would be the place in the array
        return F.pmod(F.xxhash64(F.lit(mark), gram), F.lit(buckets)).cast("int")

    return of


def grams(host: Column, path: Column, buckets: int = BUCKETS) -> Column:
    """Hash buckets of all n-grams of host and path, marked at their ends."""
    out = []
    for mark, text in (("h", F.concat(F.lit("."), host, F.lit("."))), ("p", F.concat(path, F.lit("$")))):
        for size in SIZES:
            found = F.regexp_extract_all(text, F.lit(rf"(?s)(?=(.{{{size}}}))"), F.lit(1))
            out.append(F.transform(found, _bucket(mark, buckets)))
    return F.concat(*out)


def train(labelled: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """One row, ``weights array<double>``: the buckets' weights and, last, the intercept (a feature of value 1).

    ``labelled(url, blocked 0/1)`` has at most MOST_LABELLED rows; more are an
    error. Rows without url or label do not count; an empty table gives weights of 0.
    """
    host, path = host_and_path(F.col("url"))
    rows = (
        labelled.filter("url is not null and blocked is not null")
        .groupBy("url")
        .agg(F.max(F.col("blocked").cast("double")).alias("y"))
        .agg(F.sort_array(F.collect_list(F.struct("url", "y"))).alias("all"))
        .select(
            F.assert_true(F.size("all") <= MOST_LABELLED, "too many labelled URLs").alias("_"),
            F.posexplode("all").alias("i", "row"),
        )
        .select("i", F.col("row.url").alias("url"), F.col("row.y").alias("y"))
        .select("i", "y", grams(host, path, buckets).alias("g"))
    )
    entries = (
        rows.select("i", F.explode("g").alias("b"), (1 / F.sqrt(F.size("g"))).alias("one"))
        .unionByName(rows.select("i", F.lit(buckets).alias("b"), F.lit(1.0).alias("one")))
        .groupBy("i", "b")
        .agg(F.sum("one").alias("x"))
    )
    two = entries.select(F.col("i").alias("j"), "b", F.col("x").alias("z"))
    gram = entries.join(two, "b").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("z")).alias("k"))
    every = rows.select("i", "y").join(rows.select(F.col("i").alias("j")), F.col("j") >= 0)  # a pair of labelled URLs each
    lines = (
        every.join(gram, ["i", "j"], "left")
        .groupBy("i", "y")
        .agg(F.sort_array(F.collect_list(F.struct("j", F.coalesce("k", F.lit(0.0)).alias("k")))).alias("line"))
        .agg(F.sort_array(F.collect_list(F.struct("i", "y", F.col("line.k").alias("k")))).alias("m"))
    )
    solved = lines.select(
        F.aggregate(
            F.sequence(F.lit(1), F.lit(STEPS)),
            F.transform("m", lambda r: F.lit(0.0)),
            lambda a, _: F.transform(
                F.arrays_zip(F.col("m"), a.alias("a")),
                lambda r: r["a"] * (1 - RATE * RIDGE)
                + RATE
                * (
                    r["m"]["y"]
                    - 1
                    / (
                        1
                        + F.exp(
                            -F.aggregate(F.zip_with(r["m"]["k"], a, lambda x, w: x * w), F.lit(0.0), lambda s, v: s + v)
                        )
                    )
                ),
            ),
        ).alias("alpha")
    )
    alpha = solved.select(F.posexplode("alpha").alias("i", "alpha"))
    weights = entries.join(alpha, "i").groupBy("b").agg(F.sum(F.col("x") * F.col("alpha")).alias("w"))
    return weights.agg(F.map_from_entries(F.collect_list(F.struct("b", "w"))).alias("w")).select(
        F.transform(F.sequence(F.lit(0), F.lit(buckets)), lambda b: F.coalesce(F.col("w")[b], F.lit(0.0))).alias("weights")
    )


def judge(pages: DataFrame, labelled: DataFrame, url_col: str = "url", rules: tuple = RULES, buckets: int = BUCKETS) -> DataFrame:
    """All columns of ``pages`` with host, path, rule, blocked_score and verdict.

    rule: the longest fitting rule as host and path prefix, else null; verdict:
    that rule's, else ``block`` if the regression gives at least THRESHOLD. Null
    and odd URLs have empty host and path and go to the regression. Input
    columns named like the results are left out; rows are neither lost nor merged.
    """
    host, path = host_and_path(F.col("_url"))
    names = ("host", "path", "rule", "blocked_score", "verdict")
    kept = [c for c in pages.columns if c not in names]
    found = F.lit(None).cast("string")
    decided = F.lit(None).cast("string")
    for domain, prefix, verdict in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((F.col("_host") == domain) | F.col("_host").endswith("." + domain)) & F.col("_path").startswith(prefix)
        found = F.when(fits, F.lit(domain + prefix)).otherwise(found)
        decided = F.when(fits, F.lit(verdict)).otherwise(decided)
    return (
        pages.select(*(F.col(f"`{c}`").alias(f"_c{k}") for k, c in enumerate(kept)), F.col(f"`{url_col}`").cast("string").alias("_url"))
        .select("*", host.alias("_host"), path.alias("_path"))
        .withColumn("_grams", grams(F.col("_host"), F.col("_path"), buckets))
        .withColumn("_weights", train(labelled, buckets).scalar())
        .withColumn(
            "_sum",
            F.aggregate("_grams", F.lit(0.0), lambda s, g: s + F.get("_weights", g))
            / F.sqrt(F.greatest(F.size("_grams"), F.lit(1)).cast("double")),
        )
        .select(
            *(F.col(f"_c{k}").alias(c) for k, c in enumerate(kept)),
            F.col("_host").alias("host"),
            F.col("_path").alias("path"),
            found.alias("rule"),
            (1 / (1 + F.exp(-(F.col("_sum") + F.get("_weights", F.lit(buckets)))))).alias("blocked_score"),
            decided.alias("_decided"),
        )
        .withColumn("verdict", F.coalesce("_decided", F.when(F.col("blocked_score") >= THRESHOLD, "block").otherwise("allow")))
        .drop("_decided")
    )
