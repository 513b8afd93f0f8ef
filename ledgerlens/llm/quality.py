"""Quality rules: divergence of a document's histograms from its language.

Two histograms of every whole text -- of character classes, and of the
common words of the four languages below -- are compared with the median
shares of all documents of the same ``lang`` that pass the base rules, by
Jensen-Shannon divergence in bits.  A text too short for a histogram to mean anything is
not judged by it (the minimum-length guards).  The base rules reject texts
of under 10 words and texts whose repeated 5-word windows cover over a
fifth of their words.

Everything here is DataFrame functions; the statistics of a document are
computed within its row, and only they are shuffled, never the text.

Texts of any length are read whole.  Null texts have no words and fail the base rules.  A null ``lang`` is a
language of its own.  Where no document of a language passes the base rules,
nobody is judged against it.  Repeated rows are judged one by one.  An empty
table gives an empty result.  Columns other than those named are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import cut, ready, scratch

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
MIN_CHARS = 250      # least characters for the character histogram to count
STEPS = 10_000       # of a share: medians are exact to half a step
MIN_HIST_WORDS = 40  # least words for the word histogram to count
MAX_CHAR_JS = 0.03   # from the labelled rows: README, "Quality limits"
MAX_WORD_JS = 0.20

# Common words of four languages.
COMMON_WORDS = ("the of and to in is for that was on "
                "der die und das von zu mit dem des ist "
                "de la le les et un une que pour dans "
                "el los las en por con una del se su").split()

SYMBOLS = r"[#*$%&|<>]"


def _count(pattern: str) -> Column:
    return F.regexp_count("text", F.lit(pattern)).cast("long")


def _repeat_words() -> Column:
    """Words inside 5-word windows that stand twice or more in the text.

    Windows are compared by a 64-bit hash.  Only texts that hold a window
    twice get to the second branch, where the windows are sorted by hash.
    """
    hashes = "transform(words, w -> xxhash64(w))"
    spots = f"sequence(0, size(words) - {WINDOW})"
    sums = ", ".join(f"h[i + {k}]" for k in range(WINDOW))
    windows = f"transform({spots}, i -> xxhash64({sums}))"
    return F.expr(f"""
      CASE WHEN size(words) <= {WINDOW} THEN 0L ELSE
        aggregate(array({hashes}), 0L, (acc0, h) -> aggregate(array({windows}), 0L, (acc1, v) ->
          CASE WHEN size(array_distinct(v)) = size(v) THEN 0L ELSE
            aggregate(array(sort_array(transform(v, (x, i) -> struct(x AS x, i AS i)))), 0L,
              (acc2, s) -> aggregate(
                sort_array(transform(filter(s, (e, j) ->
                  (j > 0 AND s[greatest(j - 1, 0)].x = e.x) OR
                  (j < size(s) - 1 AND s[least(j + 1, size(s) - 1)].x = e.x)), e -> e.i)),
                struct(0L AS n, -1 AS until),
                (a, i) -> struct(a.n + (i + {WINDOW} - greatest(i, a.until)) AS n,
                                 i + {WINDOW} AS until),
                a -> a.n))
          END))
      END""")


#: Sorted ``hits`` to an array of (k, number of times).
_RUNS = """
  aggregate(array(filter(sequence(0, size(hits)),
                         i -> i < size(hits) AND (i = 0 OR hits[greatest(i - 1, 0)] <> hits[i]))),
    cast(array() AS array<struct<k: int, n: bigint>>),
    (acc, at) -> transform(at, (p, j) -> struct(hits[p] AS k,
      cast(coalesce(get(at, j + 1), size(hits)) - p AS bigint) AS n)))"""


def base_statistics(docs: DataFrame, keep: Column) -> DataFrame:
    """``keep, lang`` and the base statistics, with the two histograms."""
    ready(docs)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(keep.alias("keep"), "lang", text.alias("text"))
    rows = rows.withColumn("words", F.expr(
        "filter(split(text, '[\\\\x20\\\\x09-\\\\x0D]+', -1), w -> w != '')"))
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    flat = F.transform("words", lambda w: F.lower(F.rtrim(w, F.lit(".,;:!?"))))
    common = F.array(*[F.lit(w) for w in COMMON_WORDS])
    hits = F.transform(F.filter(flat, lambda w: w.isin(*COMMON_WORDS)),
                       lambda w: F.array_position(common, w).cast("int") - 1)
    stats = rows.select(
        "keep", "lang", F.size("words").cast("long").alias("n_words"),
        F.aggregate("words", F.lit(0).cast("long"), lambda a, w: a + F.length(w)).alias("word_chars"),
        _count(SYMBOLS).alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        _repeat_words().alias("n_repeat_words"),
        F.length("text").cast("long").alias("chars"), _count(r"\p{Lu}").alias("upper"),
        _count("[0-9]").alias("digits"), _count(r"""[.,;:!?'"()\[\]-]""").alias("points"),
        F.sort_array(hits).alias("hits"))
    letters = F.greatest(F.col("word_chars") - F.col("n_symbols") - F.col("upper")
                         - F.col("digits") - F.col("points"), F.lit(0))
    chars = F.array(letters, "upper", "digits", "points", "n_symbols",
                    F.greatest(F.col("chars") - F.col("word_chars"), F.lit(0)))
    other = F.struct(F.lit(len(COMMON_WORDS)).alias("k"),
                     (F.col("n_words") - F.size("hits")).cast("long").alias("n"))
    counted = F.concat(F.expr(_RUNS), F.array(other))
    failed = ((F.col("n_words") < MIN_WORDS)
              | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
    return stats.select("keep", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                        "n_repeat_words", failed.alias("base_failed"), "chars",
                        chars.alias("char_hist"), counted.alias("word_hist"))


def _shares(hist: str) -> Column:
    total = F.aggregate(hist, F.lit(0.0), lambda a, x: a + x)
    return F.transform(hist, lambda x: F.when(total > 0, x / total).otherwise(0.0))


def jensen_shannon(p: Column, q: Column) -> Column:
    """Divergence in bits of two arrays of shares."""
    def part(x: Column, y: Column) -> Column:
        return F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(0.0)
    terms = F.zip_with(p, q, lambda x, y: part(x, y) + part(y, x))
    return F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / 2


def word_divergence(hist: Column, ref: Column) -> Column:
    """Divergence in bits of sparse counts from an array of shares.

    A word that the text lacks adds its whole share in the reference.
    """
    total = F.aggregate(hist, F.lit(0).cast("long"), lambda a, e: a + e["n"])

    def terms(acc: Column, e: Column) -> Column:
        p, q = e["n"] / total, F.get(ref, e["k"])
        both = (F.when(p > 0, p * F.log2(2 * p / (p + q))).otherwise(0.0)
                + F.when(q > 0, q * F.log2(2 * q / (p + q))).otherwise(0.0))
        return acc + both - q
    return F.when(total > 0, (F.aggregate(hist, F.lit(1.0), terms)) / 2).otherwise(0.0)


def _profiles(stats: DataFrame) -> DataFrame:
    """Histograms of each language: median shares of its documents that pass the base rules.

    Every document counts once, however long, so junk of less than half of a
    language's documents moves its reference little.  A histogram whose
    medians are all 0 is null and judges nobody.
    """
    good = stats.filter(~F.col("base_failed")).select(
        F.struct("lang").alias("_lang"), _shares("char_hist").alias("c"),
        F.map_from_entries("word_hist").alias("w"), "n_words")
    words = F.transform(F.sequence(F.lit(0), F.lit(len(COMMON_WORDS))), lambda k: F.coalesce(
        F.col("w")[k], F.lit(0)) / F.col("n_words"))
    # How many documents of a language have which share, in steps of 1 / STEPS: exact
    # sums, whatever the order in which tasks end.
    per = good.select("_lang", F.posexplode(F.concat("c", words)).alias("k", "share")).groupBy(
        "_lang", "k", F.round(F.col("share") * STEPS).cast("int").alias("step")).agg(F.count("*").alias("n"))
    kind = Window.partitionBy("_lang", "k")  # at most STEPS + 1 rows
    upto = F.sum("n").over(kind.orderBy("step"))
    half = per.withColumn("upto", upto).withColumn("every", F.sum("n").over(kind)).filter(
        2 * F.col("upto") >= F.col("every"))
    medians = half.groupBy("_lang", "k").agg((F.min("step") / F.lit(float(STEPS))).alias("m"))
    refs = medians.groupBy("_lang").agg(F.sort_array(F.collect_list(F.struct("k", "m"))).alias("m"))
    both = F.transform("m", lambda e: e["m"])
    refs = refs.select("_lang", F.slice(both, 1, 6).alias("ref_chars"),
                       F.slice(both, 7, len(COMMON_WORDS) + 1).alias("ref_words"))
    return refs.select(F.col("_lang.lang").alias("ref_lang"), *[
        F.when(F.exists(c, lambda x: x > 0), _shares(c)).alias(c) for c in ("ref_chars", "ref_words")])


def _judged(stats: DataFrame, refs: DataFrame, max_char_js: float, max_word_js: float) -> DataFrame:
    """Adds ``char_js, word_js, kept``."""
    both = stats.join(refs, F.col("lang").eqNullSafe(F.col("ref_lang")), "left")
    both = (both.withColumn("char_js", F.when(F.col("ref_chars").isNotNull(), jensen_shannon(
                _shares("char_hist"), F.col("ref_chars"))).otherwise(0.0))
            .withColumn("word_js", F.when(F.col("ref_words").isNotNull(), word_divergence(
                F.col("word_hist"), F.col("ref_words"))).otherwise(0.0)))
    odd = (((F.col("chars") >= MIN_CHARS) & (F.col("char_js") > max_char_js))
           | ((F.col("n_words") >= MIN_HIST_WORDS) & (F.col("word_js") > max_word_js)))
    return both.withColumn("kept", ~F.col("base_failed") & ~odd)


def judge(docs: DataFrame, max_char_js: float = MAX_CHAR_JS,
          max_word_js: float = MAX_WORD_JS) -> DataFrame:
    """One row per document: base statistics, ``char_js``, ``word_js``, ``base_failed``, ``kept``."""
    stats = cut(base_statistics(docs, F.col("doc_id")))  # the texts are read once
    return _judged(stats, _profiles(stats), max_char_js, max_word_js).select(
        F.col("keep").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines",
        "n_repeat_words", "base_failed", "kept", "char_js", "word_js")


def keep_good(docs: DataFrame, max_char_js: float = MAX_CHAR_JS,
              max_word_js: float = MAX_WORD_JS) -> DataFrame:
    """The rows of ``docs`` that the rules keep.

    The rows are written once with their statistics; the profiles read only
    these, and are read back as a table whose size Spark knows, so that few
    languages are broadcast and many joined by shuffle.
    """
    spark = ready(docs)
    rows_path, refs_path = scratch(spark), scratch(spark)
    stats = base_statistics(docs, F.struct(*docs.columns))
    stats.write.parquet(rows_path)
    rows = spark.read.schema(stats.schema).parquet(rows_path)
    refs = _profiles(rows)
    refs.coalesce(1).write.parquet(refs_path)
    near = spark.read.schema(refs.schema).parquet(refs_path)
    return _judged(rows, near, max_char_js, max_word_js).filter("kept").select("keep.*")
