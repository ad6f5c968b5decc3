"""Mix sources to target weights by Poisson replication.

Every document appears k times, k drawn from a Poisson distribution whose mean is its source's target
repetition rate: (target rows * weight of the source / sum of the weights) / rows of the source. The
draw inverts the distribution at a number that a hash of seed and document gives, so it does not
depend on partitions, order or retries. Copies are then dealt out in a global random order.

Sources are counted with partial aggregates. A source's distribution is one small row: the least number of
copies that can come up, and the distribution function from there on, computed relative to its mode, so that
rates of any size neither vanish nor overflow. The rows are broadcast if counted to be small, else joined by
source and a salt; a hot source is not gathered anywhere. The random key of a copy is uniform, so it names the
partition itself: one shuffle and a sort within partitions give the global order, without a sampling pass.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from pagepress.llm.common import cut, partitions

SEED = "mix-1"
TEMPER = 0.5  # default weight of a source: its share of rows to this power
BROADCAST_BYTES = 32 << 20
SALTS = 32  # parts of a source where the sources are too many to broadcast


def unit_draw(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5 of the parts; nulls count as empty."""
    texts = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(SEED), *texts)), 1, 13), 16, 10)
    return bits.cast("double") / F.lit(float(1 << 52))


def poisson_steps(rate: float) -> tuple[int, np.ndarray]:
    """The least number in reach, and the distribution function from there on; beyond it is flat in double precision."""
    if not rate > 0:
        return 0, np.ones(1)
    mode, reach = int(rate), int(12 * np.sqrt(rate)) + 30
    least = max(0, mode - reach)
    below = np.cumprod(np.arange(mode, least, -1) / rate)[::-1]
    above = np.cumprod(rate / np.arange(mode + 1, mode + reach + 1))
    mass = np.concatenate([below, [1.0], above])
    steps = np.cumsum(mass)
    return least, steps / steps[-1]


def source_rates(docs: DataFrame, weights: DataFrame | None, target_rows: int | None, temper: float) -> DataFrame:
    """``source``, ``rate``, ``least`` and ``steps``: the Poisson distribution function of the rate, from ``least`` up."""
    counts = docs.groupBy("source").agg(F.count("*").alias("rows"))
    if weights is None:
        weighted = counts.withColumn("weight", F.pow(F.col("rows").cast("double"), F.lit(temper)))
    else:
        given = weights.groupBy(F.col("source").alias("_given")).agg(F.max(F.col("weight").cast("double")).alias("weight"))
        weighted = counts.join(given, F.col("source").eqNullSafe(F.col("_given")), "left").drop("_given")
    usable = F.when((F.col("weight") > 0) & (F.col("weight") < float("inf")), F.col("weight")).otherwise(0.0)
    weighted = weighted.withColumn("weight", usable)
    totals = weighted.agg(
        F.sum("weight").alias("all_weight"), F.coalesce(F.lit(target_rows).cast("long"), F.sum("rows")).alias("target")
    )
    # One row of totals: its size is fixed, so the broadcast is bounded.
    share = F.coalesce(F.try_divide(F.col("weight"), F.col("all_weight")), F.lit(0.0))
    rated = weighted.join(F.broadcast(totals)).withColumn("rate", F.col("target") * share / F.col("rows"))

    def walk(batches):
        for batch in batches:
            found = [poisson_steps(rate) for rate in batch["rate"]]
            yield pd.DataFrame({"source": batch["source"], "rate": batch["rate"], "least": [k for k, _ in found], "steps": [s for _, s in found]})

    kind = docs.schema["source"].dataType.simpleString()
    return rated.select("source", "rate").mapInPandas(walk, f"source {kind}, rate double, least bigint, steps array<double>")


def _with_rates(frame: DataFrame, rates: DataFrame) -> DataFrame:
    """The rows with the columns of their source's rate."""
    rates = cut(rates.withColumnRenamed("source", "_source"))
    found = rates.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.size("steps")), F.lit(0)).alias("steps")).collect()[0]
    met = F.col("source").eqNullSafe(F.col("_source"))
    if 256 * found["rows"] + 8 * found["steps"] <= BROADCAST_BYTES:
        return frame.join(F.broadcast(rates), met)
    salted = rates.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = frame.withColumn("_row_salt", F.pmod(F.xxhash64("doc_id", "text"), F.lit(SALTS)).cast("int"))
    return dealt.join(salted, met & (F.col("_row_salt") == F.col("_salt"))).drop("_salt", "_row_salt")


def mix(
    docs: DataFrame, weights: DataFrame | None = None, target_rows: int | None = None, temper: float = TEMPER
) -> DataFrame:
    """The documents, each as often as its draw says, in a global random order.

    Adds ``copy`` (1, 2, ...) and ``order_key`` (the random order); a column of one of these names is
    replaced. ``weights`` has ``source`` and ``weight``; sources it lacks get none, a null source is a
    source like any other, and of two weights the larger counts. A weight that is null, negative or not
    finite is 0; if all are 0, or none of the sources is named, no document is repeated and the result is
    empty. By default a source weighs its rows to the power ``temper``. The target is the number of rows
    there are unless given. The draw uses ``doc_id`` and a hash of the text: rows that agree in both have
    the same number of copies. An empty table stays empty.
    """
    frame = docs.drop("copy", "order_key")
    joined = _with_rates(frame, source_rates(frame, weights, target_rows, temper).filter("rate > 0"))
    hashed = joined.withColumn("_hash", F.md5(F.coalesce(F.col("text"), F.lit(""))))
    # The draw is an array of one, so that it is taken once for a document and not once for each step.
    draw = F.array(unit_draw(F.col("doc_id"), F.col("_hash")))
    below = F.transform(draw, lambda u: F.size(F.filter("steps", lambda s: s <= u)))[0]
    counted = hashed.withColumn("_n", (F.col("least") + below).cast("int"))
    numbers = F.when(F.col("_n") > 0, F.sequence(F.lit(1), F.col("_n")))
    copies = counted.select(*frame.columns, "_hash", F.explode(numbers).alias("copy"))
    keyed = copies.withColumn("order_key", unit_draw(F.lit("order"), F.col("doc_id"), F.col("copy"), F.col("_hash")))
    parts = partitions(docs.sparkSession)
    dealt = keyed.drop("_hash").repartitionById(parts, F.floor(F.col("order_key") * parts).cast("int"))
    return dealt.sortWithinPartitions("order_key", "doc_id", "copy")


ORACLE_SQL = """
with recursive counts as (select source, count(*) n from documents group by source),
totals as (select sum(pow(cast(n as double), 0.5)) w, sum(n) t from counts),
rates as (
  select source, t * pow(cast(n as double), 0.5) / w / n rate from counts cross join totals
),
steps as (
  select source, rate, 0 k, exp(-rate) p, exp(-rate) s from rates
  union all
  select source, rate, k + 1, p * rate / (k + 1), s + p * rate / (k + 1) from steps
  where k < cast(floor(rate + 12 * sqrt(rate) + 30) as int)
),
draws as (
  select doc_id, source, lang, text, n_chars,
    cast(concat('0x', substr(md5(concat('mix-1:', cast(doc_id as varchar), ':', md5(coalesce(text, '')))), 1, 13)) as bigint)
      / 4503599627370496.0 u
  from documents
),
counted as (
  select d.doc_id, d.source, d.lang, d.text, d.n_chars, count(*) filter (where s.s <= d.u) copies
  from draws d join steps s on d.source is not distinct from s.source
  group by all
)
select doc_id, source, lang, n_chars, cast(c as int) copy, text
from counted, unnest(range(1, copies + 1)) as t(c)
"""
