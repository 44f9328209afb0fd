"""Mixing sources to target weights by Poisson replication. DataFrame functions only.

A source's rate is its share of the target divided by its share of the corpus. A document's
number of copies inverts the Poisson distribution with that mean at a hash of the document, so
it is the same in every run and in every recomputed task. The copies are dealt to partitions by
another hash and sorted by it inside them, which is a shuffle of the whole output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: A draw has a mean of at most this; larger rates are sums of draws with hashes of their own.
MAX_MEAN = 64.0
#: Source tables up to this many rows are broadcast, larger ones joined on salted keys.
BROADCAST_SOURCES = 10_000
SALTS = 32


def source_sizes(docs: DataFrame, source: str = "source", text: str = "text") -> DataFrame:
    """Characters of each source, one more per document. A null source is one source."""
    size = F.coalesce(F.char_length(F.col(text)), F.lit(0)).cast("long") + 1
    return docs.groupBy(F.col(source).alias("__source")).agg(F.sum(size).alias("__size"))


def source_rates(sizes: DataFrame, weights: DataFrame | None = None, alpha: float = 0.7
                 ) -> DataFrame:
    """Mean copies per document of each source. ``weights(source, weight)`` gives the target
    weights, 0 for a source it lacks; without it, weights are sizes to the power ``alpha``.
    The target has as many characters as the corpus."""
    if weights is None:
        weighed = sizes.withColumn("__weight", F.pow(F.col("__size").cast("double"), F.lit(alpha)))
    else:
        w = weights.groupBy(F.col("source").alias("__s")).agg(F.sum("weight").alias("__w"))
        weighed = (sizes.join(w, F.col("__source").eqNullSafe(F.col("__s")), "left")
                   .withColumn("__weight", F.coalesce(F.col("__w").cast("double"), F.lit(0.0)))
                   .drop("__s", "__w"))
    everything, weight = weighed.agg(F.sum("__size")).scalar(), weighed.agg(F.sum("__weight")).scalar()
    rate = F.try_divide(F.col("__weight") * everything, weight * F.col("__size"))
    return weighed.select("__source", F.coalesce(rate, F.lit(0.0)).alias("__rate"))


def poisson_table(mean: Column) -> Column:
    """Cumulative probabilities of 0, 1, 2, ... up to where they no longer grow in a double."""
    top = F.ceil(mean + 12 * F.sqrt(mean) + 30).cast("int")
    p0 = F.exp(-mean)
    state = F.struct(p0.alias("p"), F.array(p0).alias("c"))
    return F.aggregate(
        F.sequence(F.lit(1), top), state,
        lambda s, k: F.struct(
            (s["p"] * mean / k).alias("p"),
            F.concat(s["c"], F.array(F.element_at(s["c"], -1) + s["p"] * mean / k)).alias("c")),
        lambda s: s["c"])


def _key(*parts: Column) -> Column:
    return F.md5(F.concat_ws(":", *parts))


def uniform(key: Column) -> Column:
    """A number in (0, 1) from the first 52 bits of a hexadecimal digest."""
    return (F.conv(F.substring(key, 1, 13), 16, 10).cast("double") + 0.5) / float(2 ** 52)


def mix(docs: DataFrame, weights: DataFrame | None = None, alpha: float = 0.7, seed: int = 17,
        doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """``docs`` with each document as often as drawn, plus ``copy`` (from 1) and ``mix_key``,
    by which the output is in random order.

    Null ids, sources and texts are values like others; a null text has no characters.
    Repeated rows get the same draw. Columns named ``copy`` or ``mix_key`` are replaced. An
    empty table gives an empty one.
    """
    rates = source_rates(source_sizes(docs, source, text), weights, alpha)
    parts = F.greatest(F.lit(1), F.ceil(F.col("__rate") / MAX_MEAN)).cast("int")
    rates = (rates.withColumn("__parts", parts)
             .withColumn("__cdf", poisson_table(F.col("__rate") / F.col("__parts"))))
    keep = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("copy", "mix_key")]
    row = docs.select(*keep, F.concat_ws(
        ":", F.coalesce(F.col(doc_id).cast("string"), F.lit("~")),
        F.md5(F.coalesce(F.col(text), F.lit("")))).alias("__doc"))
    on = row[source].eqNullSafe(F.col("__source"))
    few = rates.limit(BROADCAST_SOURCES + 1).collect()                   # a bounded peek
    if len(few) <= BROADCAST_SOURCES:
        small = docs.sparkSession.createDataFrame(few, rates.schema)
        joined = row.join(F.broadcast(small), on)
    else:
        salted = rates.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = (row.withColumn("__at", F.pmod(F.xxhash64("__doc"), F.lit(SALTS)))
                  .join(salted, (F.col("__at") == F.col("__salt")) & on).drop("__at", "__salt"))
    drawn = F.aggregate(
        F.sequence(F.lit(1), F.col("__parts")), F.lit(0),
        lambda n, j: n + F.size(F.filter(
            F.col("__cdf"),
            lambda c: c < uniform(_key(F.lit(str(seed)), j.cast("string"), F.col("__doc"))))))
    copies = (joined.withColumn("__n", drawn).filter("__n > 0")
              .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("__n"))))
              .withColumn("mix_key", _key(F.lit(f"order{seed}"), F.col("copy").cast("string"), F.col("__doc"))))
    return (copies.repartition("mix_key").sortWithinPartitions("mix_key")
            .select(*keep, "copy", "mix_key"))
