"""URL filters: domain and path rules, then a logistic regression.

A rule names a domain and the beginning of a path; it fits that host and its
subdomains, and the longest fitting rule decides.  Urls without a fitting
rule are judged by a logistic regression on hashed character n-grams of host
and path, fitted here on a small table of labelled urls.  Everything is
DataFrame functions; the weights are one constant array in the plan.

A null url, or one without ``://``, has an empty host and path and gets the
model's verdict on nothing but its intercept.  Repeated rows are judged one
by one; very long urls are read whole.  An empty table gives an empty
result.  Columns other than those named are ignored.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import cut, ready

#: (verdict, domain, beginning of the path)
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"),
         ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))

DIM = 8192      # coordinates of the hashed n-grams
GRAMS = (3, 4)  # lengths of the n-grams
THRESHOLD = 0.5

# The words that the labelled urls are built from.
BAD_WORDS = ("casino poker jackpot roulette slots betting sportsbet lottery bingo viagra cialis xanax "
             "pharma pills steroids porn xxx sexcam adult nudes escort singles hookup camgirls "
             "phishing verify-login malware trojan keygen cracked warez torrentz spam spammer "
             "linkfarm backlinks replica fakewatch payday quickcash cashadvance freespins freegift "
             "giveaway prizes coin-doubler miracle slimming dietpill popunder adserver clickbait "
             "tracker trackads banners surveycash ransom botnet hacktool").split()
BAD_ENDS = ("royal online shop zone deals store planet hub live vip now world city king bank "
            "hot best max").split()
GOOD_WORDS = ("garden library physics weather recipes history journal museum theater orchard northern "
              "atlas research teaching reading school nation lyceum county river mountain bakery "
              "railway chemistry painting village harbour medical music poetry science travel "
              "betty alphabet essex sextant casual specialist adulthood freedom freeport winter "
              "clickers trackfield pillow spinach porter poker-face lotus singleton scampi "
              "bankers phishery torrential cracker registry learning building hiking cycling sailing "
             "writing engineering spring housing nursing training fishing lighting working evening "
             "zeitung freeway betterment rescue escorial adviser tracks banner prize-essay "
             "pharmacology porcelain pornic trojans loans singing pillar spanish scampton").split()
GOOD_ENDS = ("notes club review society online house press works world city report academy "
             "gallery archive shop forum live hub").split()
PREFIXES = ("", "www.", "blog.", "m.", "shop.")
PATHS = ("/en/101", "/de/7.html", "/fr/55/", "/es/930", "/", "/a/b?c=d")
INVENTED = 600  # clean names of random letters
HOLD_OUT = 4    # every fourth name is not for the fit


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The small labelled table ``url, name, label, held_out``: label 1 is to be blocked.

    Names join a word and an ending, with or without a hyphen; clean names
    are also words that look like bad ones, and random letters.  What is held
    out is decided by a hash of the name: no url of it is in the fit.
    """
    def names(words: Sequence[str], ends: Sequence[str], label: int) -> DataFrame:
        lists = [F.array(*[F.lit(x) for x in xs]) for xs in (words, ends)]
        pairs = spark.range(1).select(F.explode(lists[0]).alias("w"), lists[1].alias("ends"))
        pairs = pairs.select("w", F.explode("ends").alias("e"))
        # Half of the pairs, each written one way, and every word alone.
        pairs = pairs.withColumn("h", F.crc32(F.concat_ws("|", "w", "e")))
        joined = F.concat("w", F.when(F.col("h") % 2 == 0, "-").otherwise(""), "e")
        return (pairs.where((F.col("h") / 7).cast("long") % 2 == 0).select(joined.alias("name"))
                .unionByName(pairs.select(F.col("w").alias("name")).distinct())
                .withColumn("label", F.lit(label)))

    letters = F.translate(F.substring(F.md5(F.concat(F.lit("name"), F.col("id"))), 1, 20),
                          "0123456789abcdef", "etaoinshrdlucmfwypgb"[:16])
    random = spark.range(INVENTED).select(
        F.substring(letters, F.lit(1), (F.col("id") % 9 + 5).cast("int")).alias("name"), F.lit(0).alias("label"))
    every = (names(BAD_WORDS, BAD_ENDS, 1).unionByName(names(GOOD_WORDS, GOOD_ENDS, 0))
             .unionByName(random).withColumn("h", F.crc32(F.concat(F.lit("url"), F.col("name")))))

    def pick(xs: Sequence[str], salt: int) -> Column:
        return F.element_at(F.array(*[F.lit(x) for x in xs]), ((F.col("h") / salt).cast("long") % len(xs) + 1).cast("int"))

    url = F.concat(F.lit("https://"), pick(PREFIXES, 1), F.col("name"),
                   pick((".example.org", ".example.net", ".info", ".example.com"), 7), pick(PATHS, 31))
    return every.select(url.alias("url"), "name", "label", ((F.col("h") / 997).cast("long") % HOLD_OUT == 0).alias("held_out"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    parts = r"^(?s).*?://([^/?#]*)([^?#]*)"
    host = F.regexp_extract(F.coalesce(url, F.lit("")), parts, 1)
    path = F.regexp_extract(F.coalesce(url, F.lit("")), parts, 2)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), path


def matching_rule(host: Column, path: Column, rules: Sequence[tuple] = RULES) -> tuple[Column, Column]:
    """The longest fitting rule (domain and path joined) and its verdict; null without one."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, domain, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(start)
        rule = F.when(fits, F.lit(domain + start)).otherwise(rule)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def _grams(kind: str, text: str) -> str:
    """SQL: coordinates of the n-grams of a column, its ends marked."""
    cells = []
    for n in GRAMS:
        parts = ", ".join(f"c[i + {j}]" for j in range(n))
        cells.append(f"transform(filter(sequence(0, size(c)), i -> i + {n} <= size(c)), "
                     f"i -> cast(pmod(xxhash64('{kind}', {parts}), {DIM}L) AS int))")
    joined = f"concat({', '.join(cells)})"
    return (f"aggregate(array(split(concat('^', {text}, '$'), '')), cast(array() AS array<int>), "
            f"(acc, c) -> {joined})")


def with_coordinates(urls: DataFrame) -> DataFrame:
    """Adds ``host, path, grams``: the distinct coordinates of the url's n-grams."""
    host, path = host_and_path(F.col("url"))
    return (urls.withColumn("host", host).withColumn("path", path)
            .withColumn("grams", F.expr(
                f"array_distinct(concat({_grams('h', 'host')}, {_grams('p', 'path')}))")))


def fit(labelled: DataFrame) -> tuple[list[float], float]:
    """Weights of the coordinates and the intercept.

    The table is small and lies in one partition; its rows become sparse
    vectors whose places are the coordinates.
    """
    places = CountVectorizerModel.from_vocabulary(
        [str(k) for k in range(DIM)], inputCol="tokens", outputCol="features", minTF=1.0)
    rows = with_coordinates(labelled).select(F.col("grams").cast("array<string>").alias("tokens"), "label")
    train = cut(places.setBinary(True).transform(rows).select("features", "label").coalesce(1))
    model = LogisticRegression(maxIter=40, regParam=0.002, standardization=False).fit(train)
    return [float(x) for x in model.coefficients], float(model.intercept)


def block_score(weights: Sequence[float], intercept: float) -> Column:
    """Probability that the url with ``grams`` is to be blocked."""
    table = F.expr("array(" + ", ".join(f"{w!r}D" for w in weights) + ")")
    total = F.aggregate("grams", F.lit(float(intercept)), lambda a, k: a + F.get(table, k))
    return 1 / (1 + F.exp(-total))


def judge_urls(pages: DataFrame, rules: Sequence[tuple] = RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict, score`` of each page's url."""
    spark = ready(pages)
    weights, intercept = fit(labelled_urls(spark).where("NOT held_out"))
    judged = (with_coordinates(pages.select("page_id", "url"))
              .withColumn("score", block_score(weights, intercept)))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    learned = F.when(F.col("score") >= THRESHOLD, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", rule.alias("rule"),
                         F.coalesce(verdict, learned).alias("verdict"), "score")
