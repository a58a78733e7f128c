"""Set-containment joins over word n-grams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import fresh_folder

#: Words of an n-gram, the least share, the fewest words of a duplicate, and how far back, in days, originals are looked for.
GRAM, LEAST, WORDS_LEAST, DAYS = 4, 0.5, 1000, 30


def normalised_words(text: Column) -> Column:
    """Lower-case words of letters; apostrophes vanish."""
    return F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "['’]", ""), r"(?U)[^\p{L}]+"), lambda w: w != "")


def gram_sets(docs: DataFrame, n: int) -> DataFrame:
    """``docs`` without its text, with words (how many) and grams, the distinct n-grams as hashes; documents without one are left out."""

    def grams(h: Column) -> Column:
        starts = F.when(F.size(h) >= n, F.sequence(F.lit(0), F.size(h) - n))
        return F.array_distinct(F.transform(starts, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(n)])))

    # Words and hashes are bound by a function's argument: a column would be put into the inner function as its whole expression, and the
    # text be split anew for every gram.
    bound = F.transform(F.array(normalised_words(F.col("text"))), lambda w: F.struct(F.size(w).alias("words"), F.transform(F.array(F.transform(w, lambda x: F.xxhash64(x))), grams)[0].alias("grams")))[0]
    kept = [c for c in docs.columns if c != "text"]
    return docs.select(*kept, bound.alias("b")).select(*kept, "b.words", "b.grams").filter(F.size("grams") > 0)


def containment_pairs(docs: DataFrame, n: int = GRAM, least: float = LEAST, reach: int | None = None) -> DataFrame:
    """(id, earlier_id, common, grams, words, containment, is_best): how much of a document stands in an earlier one.

    ``docs`` has id, text and, with ``reach``, the whole number ``at``: then a document is earlier if its ``at`` is less, by ``reach`` at most;
    else if its id is less. Grams are 64-bit hashes, and so is their comparison.

    1. One shuffle by gram tells in how many documents each stands. Grams of one document can't be shared; a document with less than
       ``least`` of its grams left has no original and is gone.
    2. Of ``k`` grams left, of which ``need`` must be shared, one of the k - need + 1 rarest must be. Only these ask for other documents,
       within the reach's buckets, so grams that thousands of documents have hardly ever ask.
    3. Pairs found are verified on what is left of both sets. Of a document's originals the best has most in common, of equal ones the
       smallest id.
    """
    at = F.col("at") if reach else F.col("id")
    sets = gram_sets(docs, n).select("id", at.cast("long").alias("at"), "words", F.size("grams").alias("g"), "grams")
    each = sets.select("id", "at", "words", "g", F.explode("grams").alias("gram"))
    by_gram = Window.partitionBy("gram")
    shared = each.withColumn("in_docs", F.count(F.lit(1)).over(by_gram)).filter("in_docs > 1")
    # few rows are left; they are written, as three branches read them
    path = fresh_folder(docs.sparkSession, "shared-grams")
    shared.write.parquet(path)
    shared = docs.sparkSession.read.schema(shared.schema).parquet(path)
    left = shared.groupBy("id").agg(F.first("at").alias("at"), F.first("words").alias("words"), F.first("g").alias("g"), F.sort_array(F.collect_list(F.struct("in_docs", "gram"))).alias("s"))
    need = F.ceil(F.lit(least) * F.col("g")).cast("int")
    asking = left.withColumn("need", need).filter(F.size("s") >= F.col("need"))
    asked = asking.select("id", "at", F.explode(F.slice("s", 1, F.size("s") - F.col("need") + 1)).alias("x")).select("id", "at", "x.gram")
    there = shared.select(F.col("id").alias("earlier_id"), F.col("at").alias("earlier_at"), "gram")
    earlier = F.col("earlier_at") < F.col("at")
    if reach:
        bucket = lambda c: F.floor(F.col(c) / reach)
        asked = asked.withColumn("b", F.explode(F.array(bucket("at"), bucket("at") - 1)))
        found = asked.join(there.withColumn("b", bucket("earlier_at")), ["gram", "b"]).filter(earlier & (F.col("earlier_at") >= F.col("at") - reach))
    else:
        found = asked.join(there, "gram").filter(earlier)
    pairs = found.select("id", "earlier_id").distinct()
    grams = lambda c: F.transform("s", lambda x: x["gram"]).alias(c)
    pairs = pairs.join(asking.select("id", "g", "words", grams("own")), "id").join(left.select(F.col("id").alias("earlier_id"), grams("earlier")), "earlier_id")
    scored = pairs.select("id", "earlier_id", F.size(F.array_intersect("own", "earlier")).cast("long").alias("common"), F.col("g").cast("long").alias("grams"), F.col("words").cast("long").alias("words"))
    scored = scored.withColumn("containment", F.col("common") / F.col("grams")).filter(F.col("common") >= F.lit(least) * F.col("grams"))
    best = Window.partitionBy("id").orderBy(F.desc("common"), "earlier_id")
    return scored.withColumn("is_best", F.row_number().over(best) == 1)


def duplicates(docs: DataFrame, reach: int = DAYS, words: int = WORDS_LEAST) -> DataFrame:
    """Every pair at the least share within the reach, and whether it makes a duplicate: the best original of a document of ``words`` words."""
    pairs = containment_pairs(docs, GRAM, LEAST, reach)
    return pairs.withColumn("is_duplicate", F.col("is_best") & (F.col("words") >= words))
