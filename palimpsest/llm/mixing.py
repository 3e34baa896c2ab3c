"""Mixing sources to target weights by Poisson replication, with DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, renamed

SEED = 42
#: Weights without a target: each source gets its size to this power.
TEMPERATURE = 0.7
#: Numbers of all sources' distributions together up to which they are broadcast (8 bytes each); beyond, the join shuffles.
MOST_BROADCAST = 1 << 22


def unit_hash(seed: int, *columns: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an md5 of the seed and the columns as text."""
    text = F.concat_ws("|", F.lit(str(seed)), *(F.coalesce(c.cast("string"), F.lit("")) for c in columns))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def repetition_rates(docs: DataFrame, target: DataFrame | None = None, source_col: str = "source", size: Column | None = None, epochs: float = 1.0) -> DataFrame:
    """(source, rate): the mean number of copies that brings each source to its share of the mix.

    rate = weight / sum of weights * epochs * total size / size of the source. `target` holds (source,
    weight); a source that it lacks, or gives no positive weight, gets rate 0. Without a target a source
    weighs its size to the power TEMPERATURE. Sizes are summed before the shuffle, one row for each source.
    """
    size = F.lit(1) if size is None else size
    sums = docs.groupBy(F.col(f"`{source_col}`").alias("source")).agg(F.sum(size.cast("bigint")).alias("size"))
    if target is None:
        sums = sums.withColumn("weight", F.pow(F.col("size").cast("double"), F.lit(TEMPERATURE)))
    else:
        wanted = target.groupBy("source").agg(F.sum(F.greatest(F.col("weight").cast("double"), F.lit(0.0))).alias("weight"))
        sums = sums.alias("s").join(wanted.alias("w"), F.expr("s.source <=> w.source"), "left").select("s.source", "size", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    whole = sums.agg(F.sum("size").alias("all_size"), F.sum("weight").alias("all_weight"))
    rate = F.col("weight") / F.col("all_weight") * F.lit(float(epochs)) * F.col("all_size") / F.col("size")
    return sums.crossJoin(F.broadcast(whole)).select(  # `whole` is one row
        "source", F.when((F.col("weight") > 0) & (F.col("size") > 0), rate).otherwise(F.lit(0.0)).alias("rate")
    )


def poisson_table(rates: DataFrame) -> DataFrame:
    """(source, cdf): P(count <= k) for k = 0, 1, ... of each source's Poisson distribution.

    The terms are summed in logarithms, so that a large rate does not underflow, to ten standard deviations
    and thirty counts beyond the mean; what lies further has a probability under 2**-53.
    """
    last = F.ceil(F.col("rate") + 10 * F.sqrt("rate") + 30).cast("int")
    steps = F.aggregate(
        F.sequence(F.lit(1), last),
        F.struct((-F.col("rate")).alias("log_p"), F.array(F.exp(-F.col("rate"))).alias("cdf")),
        lambda a, k: F.struct(
            (a.log_p + F.log("rate") - F.log(k.cast("double"))).alias("log_p"),
            F.concat(a.cdf, F.array(F.element_at(a.cdf, -1) + F.exp(a.log_p + F.log("rate") - F.log(k.cast("double"))))).alias("cdf"),
        ),
        lambda a: a.cdf,
    )
    return rates.select("source", F.when(F.col("rate") > 0, steps).otherwise(F.array(F.lit(1.0))).alias("cdf"))


def mix(docs: DataFrame, target: DataFrame | None = None, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text", size: Column | None = None, epochs: float = 1.0, seed: int = SEED, copy_cols: bool = True) -> DataFrame:
    """docs' columns [and copy, n_copies, mix_key]: each document as often as its Poisson count says, shuffled.

    A document's number u comes from a hash of seed, id and text; its count is the number of k with
    P(count <= k) <= u at its source's rate, which is the inverse of the Poisson distribution. The copies
    are dealt to partitions by a hash of id and copy and sorted by it there: a global shuffle in one
    exchange, the same at any number of partitions up to the order of partitions.

    The rates have one row for each source. They are written once and measured: up to MOST_BROADCAST numbers
    they are broadcast, so that the texts move in the global shuffle alone; beyond, the join shuffles and splits
    a hot source. Null sources are a source of their own; a null id or text counts as empty in the hash. Rows
    that repeat id and text get the same count. Texts of any length are hashed whole. Columns of `docs` may have
    any name; those named copy, n_copies or mix_key are replaced when copy_cols is set. An empty table gives an
    empty result.
    """
    inner, names = renamed(docs)
    rates = checkpoint(repetition_rates(docs, target, source_col, size, epochs))
    numbers = rates.agg(F.sum(F.col("rate") + 10 * F.sqrt("rate") + 32)).first()[0] or 0
    tables = poisson_table(rates).withColumn("__known", F.coalesce("source", F.lit(""))).withColumn("__null", F.col("source").isNull())
    tables = F.broadcast(tables) if numbers <= MOST_BROADCAST else tables
    source, doc, text = (F.col(names[c]) for c in (source_col, id_col, text_col))
    inner = inner.withColumns({"__known": F.coalesce(source, F.lit("")), "__null": source.isNull(), "__u": unit_hash(seed, doc, F.md5(F.coalesce(text, F.lit("")).cast("binary")))})
    counted = inner.join(tables.drop("source"), ["__known", "__null"]).withColumn("__n", F.size(F.filter("cdf", lambda c: c <= F.col("__u"))))
    copies = counted.filter("__n > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__n"))))
    keyed = copies.withColumn("__key", F.xxhash64(F.lit(seed), doc, F.xxhash64(text), F.col("__copy")))
    dealt = keyed.repartition("__key").sortWithinPartitions("__key")
    extra = {"copy": "__copy", "n_copies": "__n", "mix_key": "__key"} if copy_cols else {}
    kept = [c for c in docs.columns if c not in extra]
    return dealt.select(*(names[c] for c in kept), *(F.col(n).cast("bigint") for n in extra.values())).toDF(*kept, *extra)
