"""Document fingerprints by consistent weighted sampling: equal samples are as likely as generalised Jaccard is high.

Terms are the words of a text, weighted by how often they occur. For every sample each term draws two gamma values and
a shift from its own hash; the term with the smallest arrival gives the sample, together with its quantised weight. The
first gamma value is the sum of two exponential draws, of which a term has a dozen for all its samples; the second and
the shift are drawn anew for every sample.
Only DataFrame functions: texts are dealt out by key once, everything after that stays in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wirelens.llm.columns import stored

#: Samples of a fingerprint. Every term takes part in every sample, so a sample of two texts is equal with the probability
#: of their generalised Jaccard, whatever weight lies in which term; the standard error of a likeness is about 0.5 / sqrt(SAMPLES).
SAMPLES = 48
#: Exponential draws of a term from which pairs make the gamma scales of its samples.
DRAWS = 12
#: Stands for a missing key while documents are ordered: it comes last in descending order.
NO_KEY = -(1 << 63)


def words(text: Column) -> Column:
    """Words of a text (runs without white space); null, empty and blank texts have the empty word alone."""
    blanks = F.lit(" \t\n\x0b\x0c\r")
    return F.split(F.trim(F.coalesce(text, F.lit("")), blanks), r"[\x20\x09-\x0D]+")


def _low(bits: Column, width: int) -> Column:
    return bits.bitwiseAND(F.lit((1 << width) - 1))


def _exponential(bits: Column, width: int) -> Column:
    return -F.ln((bits + F.lit(0.5)) / F.lit(float(1 << width)))


def _sample(term: Column, log_weight: Column, i: int, a: int, b: int) -> Column:
    """Arrival and identity of a term in sample ``i`` as one number: 39 bits of arrival, 24 bits of identity."""
    bits = F.xxhash64(term, F.lit(i))
    scale = F.col(f"e{a}") + F.col(f"e{b}")                                                # gamma(2, 1)
    unit = F.lit(float(1 << 24))
    arrival = -F.ln(((_low(bits, 24) + F.lit(0.5)) / unit) * ((_low(F.shiftrightunsigned(bits, 24), 24) + F.lit(0.5)) / unit))  # gamma(2, 1)
    shift = F.shiftrightunsigned(bits, 48) / F.lit(65536.0)
    level = F.floor(log_weight / scale + shift)
    log_arrival = F.ln(arrival) - scale * (level - shift) - scale
    order = ((log_arrival + F.lit(64.0)) * F.lit(float(1 << 32))).cast("long")
    return F.shiftleft(order, 24).bitwiseOR(_low(F.xxhash64(bits, level), 24)).bitwiseOR(F.lit(1))


def signatures(terms: DataFrame, keys: list[str], *, samples: int = SAMPLES) -> DataFrame:
    """``keys`` plus signature, the identities of all samples, from rows of keys, term and weight (over 0).

    Identities are never 0. At most 66 samples.
    """
    pairs = [(a, a + d) for d in range(1, DRAWS) for a in range(DRAWS - d)][:samples]
    draws = [_exponential(_low(F.shiftrightunsigned(F.xxhash64("term", F.lit(f"scale{j // 2}")), 32 * (j % 2)), 32), 32).alias(f"e{j}")
             for j in range(max(b for _, b in pairs) + 1)]
    rows = terms.select(*keys, "term", F.ln("weight").alias("log_weight"), *draws)
    best = rows.groupBy(*keys).agg(*[F.min(_sample(F.col("term"), F.col("log_weight"), i, a, b)).alias(f"s{i}") for i, (a, b) in enumerate(pairs)])
    return best.select(*keys, F.array(*[_low(F.col(f"s{i}"), 24).cast("int") for i in range(len(pairs))]).alias("signature"))


def weighted_terms(texts: DataFrame, keys: list[str], listed: Column) -> DataFrame:
    """Rows of keys, term and weight (how often a word occurs) for columns of word lists."""
    each = texts.select(*keys, F.explode(listed).alias("word")).select(*keys, F.xxhash64("word").alias("term"))
    return each.groupBy(*keys, "term").agg(F.count(F.lit(1)).cast("double").alias("weight"))


def text_of(signature: Column) -> Column:
    """Fingerprint as text: six hexadecimal digits per sample."""
    return F.array_join(F.transform(signature, lambda x: F.lpad(F.lower(F.hex(x)), 6, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal samples of two signatures, 0 to 1."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same)) / F.size(a)


def fingerprint(docs: DataFrame, *, text: str = "text", key: str = "doc_id", samples: int = SAMPLES) -> DataFrame:
    """``key`` and fingerprint of every distinct (key, text); equal texts have equal fingerprints."""
    rows = docs.select(F.col(key), F.col(text).alias("__t"), F.xxhash64(F.col(text)).alias("__h")).distinct()
    signed = signatures(weighted_terms(rows, [key, "__h"], words(F.col("__t"))), [key, "__h"], samples=samples)
    return signed.select(key, text_of(F.col("signature")).alias("fingerprint"))


def next_below(docs: DataFrame, key: str) -> DataFrame:
    """Each distinct key of a range-dealt table with the next one below it; after the smallest comes the largest.

    Keys are dealt into ranges once and written down, so that every later read sees the same ranges; only the ends of
    the ranges meet in one task.
    """
    ranged = stored(docs.select(key).distinct().repartitionByRange(key).withColumn("__range", F.spark_partition_id()))
    ends = ranged.groupBy("__range").agg(F.max(key).alias("__top"))
    largest = ends.agg(F.max("__top").alias("__largest"))
    below = ends.withColumn("__below", F.lead("__top").over(Window.orderBy(F.desc("__range")))).select("__range", "__below")
    within = F.lead(key).over(Window.partitionBy("__range").orderBy(F.desc(key)))
    return (ranged.withColumn("__next", within).join(F.broadcast(below), "__range").join(F.broadcast(largest))
            .select(key, F.coalesce("__next", "__below", "__largest").alias("next_key")))


def against_edits(docs: DataFrame, *, text: str = "text", key: str = "doc_id", samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of texts and of their edits, whose last third is the start of the next document.

    One row per distinct (key, text): key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next. The next document has the next key below (after the smallest: the largest; a lone document follows
    itself); of several texts under one key the one of smallest hash is the next. Null texts are empty, null keys come
    after all others. Two texts without words are alike (1.0), one without words is unlike any other.
    """
    deal = Window.partitionBy("k").orderBy("h")
    own = (docs.select(F.coalesce(F.col(key), F.lit(NO_KEY)).cast("long").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
           .withColumn("h", F.xxhash64("t")).withColumn("before", F.lag("h").over(deal))
           .where("before is null or before <> h").select("k", "h", "t", F.col("before").isNull().alias("first")))
    sizes = docs.select(F.coalesce(F.col(key), F.lit(NO_KEY)).cast("long").alias("k"), F.coalesce(F.length(text), F.lit(0)).alias("n"))
    links = stored(next_below(sizes, "k").join(sizes.groupBy("k").agg(F.max(F.floor(F.col("n") / 3)).alias("need")), "k"))
    starts = (own.where("first").join(links.select(F.col("k").alias("receiver"), F.col("next_key").alias("k"), "need"), "k")
              .select(F.col("receiver").alias("k"), F.expr("substring(t, 1, cast(need as int))").alias("start")))
    size = F.length("t")
    pairs = own.join(starts, "k").select(
        "k", "h", "first", "t", size.cast("long").alias("n_chars"),
        F.concat(F.expr("substring(t, 1, cast(length(t) - floor(length(t) / 3) as int))"), F.expr("substring(start, 1, cast(floor(length(t) / 3) as int))")).alias("edited"))
    both = pairs.select("k", "h", F.explode(F.array(F.struct(F.lit(0).alias("v"), F.col("t")), F.struct(F.lit(1).alias("v"), F.col("edited").alias("t")))).alias("x"))
    keys = ["k", "h", "v"]
    signed = signatures(weighted_terms(both.select("k", "h", "x.v", "x.t"), keys, words(F.col("t"))), keys, samples=samples)
    sides = signed.groupBy("k", "h").agg(F.first(F.when(F.col("v") == 0, F.col("signature")), True).alias("a"),
                                         F.first(F.when(F.col("v") == 1, F.col("signature")), True).alias("b"))
    facts = pairs.select("k", "h", "first", "n_chars", F.sha2("edited", 256).alias("edited_sha256"))
    done = stored(sides.join(facts, ["k", "h"]))
    heads = done.where("first").select(F.col("k").alias("next_key"), F.col("a").alias("c"))
    return (done.join(links.select("k", "next_key"), "k").join(heads, "next_key")
            .select(F.when(F.col("k") != NO_KEY, F.col("k")).alias(key), "n_chars", "edited_sha256", text_of(F.col("a")).alias("fingerprint"),
                    text_of(F.col("b")).alias("edited_fingerprint"), likeness(F.col("a"), F.col("b")).alias("near_edited"),
                    likeness(F.col("a"), F.col("c")).alias("near_next")))
