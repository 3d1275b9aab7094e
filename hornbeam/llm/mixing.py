"""Mixing sources to target weights by Poisson replication.

Each document is repeated a Poisson-distributed number of times whose mean is its source's target repetition rate.  The
draw inverts the distribution at a number hashed from seed and document, so it is the same on every run and needs no
state.  Copies are exploded and dealt out by a second hash: a global shuffle in one exchange.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weights that the registered query uses; all other sources share OTHER.
WEIGHTS = {"src0": 0.10, "src1": 0.12, "src2": 0.03, "src3": 0.05, "src4": 0.08, "src5": 0.02}
OTHER = 0.60
SEED = "7"
#: Up to this k the factorial itself is used.
SMALL = 16


def unit(*keys: Column) -> Column:
    """A number in [0, 1) of 52 bits, from the MD5 of the keys; a null key counts as empty."""
    text = F.concat_ws("|", *(F.coalesce(k.cast("string"), F.lit("")) for k in keys))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def rates(docs: DataFrame, weights: Mapping[str, float], other: float, budget: float) -> DataFrame:
    """``mix_group, rate``: target bytes over present bytes.  A row for each named source that occurs and one for the
    rest (null group), so no more rows than ``weights`` has entries, whatever the input."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    sums = docs.groupBy(_group(weights)).agg(F.sum(size).alias("bytes"))
    share = F.lit(float(other))
    for name, w in sorted(weights.items()):
        share = F.when(F.col("mix_group") == name, F.lit(float(w))).otherwise(share)
    total = F.sum("bytes").over(Window.partitionBy(F.lit(1)))
    rate = F.when(F.col("bytes") > 0, share * total * F.lit(float(budget)) / F.col("bytes")).otherwise(F.lit(0.0))
    return sums.select("mix_group", rate.alias("rate"))


def _group(weights: Mapping[str, float]) -> Column:
    return F.when(F.col("source").isin(*sorted(weights)), F.col("source")).alias("mix_group")


def with_distribution(rate_table: DataFrame) -> DataFrame:
    """``mix_group, rate, first_k, last_k, cdf``: ``cdf`` is the array of P(X <= first_k + i) up to ``last_k``.

    Twelve standard deviations and 20 on either side of the mean are listed, some 24 times the root of the rate: what
    lies beyond is less than the last bit of a draw.  Each probability is made by itself, from Stirling's series and the
    logarithm of k over the rate, so neither a large rate nor a long sum loses digits.
    """
    wide = 12 * F.sqrt("rate") + 20
    t = rate_table.withColumn("first_k", F.greatest(F.lit(0), F.floor(F.col("rate") - wide)).cast("int"))
    t = t.withColumn("last_k", F.ceil(F.col("rate") + wide).cast("int"))
    t = t.withColumn("k", F.explode(F.sequence("first_k", "last_k")))
    k, rate = F.col("k").cast("double"), F.col("rate")
    small = k * F.ln("rate") - rate - F.ln(F.factorial(F.least("k", F.lit(SMALL))).cast("double"))
    off = (k - rate) / rate
    series = 1 / (12 * k) - 1 / (360 * k * k * k) + 1 / (1260 * k * k * k * k * k)
    large = off * rate - k * F.log1p(off) - series - 0.5 * F.ln(2 * math.pi * k)
    p = F.when(rate > 0, F.exp(F.when(F.col("k") <= SMALL, small).otherwise(large))).otherwise((F.col("k") == 0).cast("double"))
    by = Window.partitionBy("mix_group").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("c", F.sum(p).over(by))
    return t.groupBy("mix_group", "rate", "first_k", "last_k").agg(F.array_sort(F.collect_list("c")).alias("cdf"))


def replicate(
    docs: DataFrame, weights: Mapping[str, float] = WEIGHTS, other: float = OTHER, budget: float = 1.0, seed: str = SEED, block: int = 1024
) -> DataFrame:
    """The columns of ``docs`` plus ``mix_rate, mix_copies, mix_copy, mix_order``, a row for each copy.

    ``weights`` gives a share of ``budget`` times the input's bytes to named sources, ``other`` to all the rest
    together (null sources too).  A source without bytes has rate 0.  Rows that agree in id, source and text length
    draw the same number.  Names that clash with the four added columns are replaced, other columns may have any name.
    Empty in, empty out; copies of one document beyond an int are an error.

    The table of rates has at most ``len(weights) + 1`` rows, which bounds what is broadcast.  A document with more than
    ``block`` copies is first dealt out in blocks of so many, so that neither an array nor a task grows with the copies.
    Where no rate is so high, that branch reads nothing.
    """
    kept = docs.drop("mix_rate", "mix_copies", "mix_copy", "mix_order")
    names = [F.col(f"`{c}`") for c in kept.columns]
    table = with_distribution(rates(docs, weights, other, budget)).select(*(F.col(c).alias(f"__mix_{c}") for c in ("mix_group", "rate", "first_k", "last_k", "cdf")))
    at = kept.withColumn("__mix_of", _group(weights))

    def drawn(table: DataFrame) -> DataFrame:
        joined = at.join(F.broadcast(table), F.col("__mix_of").eqNullSafe(F.col("__mix_mix_group")))
        u = unit(F.lit(seed), F.col("doc_id"), F.col("source"), F.octet_length("text"))
        joined = joined.withColumn("__mix_u", u)
        copies = F.col("__mix_first_k") + F.size(F.filter("__mix_cdf", lambda c: c <= F.col("__mix_u")))
        return joined.select(*names, F.col("__mix_rate").alias("mix_rate"), copies.cast("int").alias("mix_copies"))

    order = unit(F.lit("order"), F.lit(seed), F.col("doc_id"), F.col("source"), F.col("mix_copy"))
    few = drawn(table).where(F.col("mix_copies").between(1, block)).withColumn("mix_copy", F.explode(F.sequence(F.lit(1), "mix_copies")))
    # a document has last_k + 1 copies at most
    many = drawn(table.where(F.col("__mix_last_k") >= block)).where(F.col("mix_copies") > block)
    many = many.withColumn("__mix_block", F.explode(F.sequence(F.lit(0), F.floor((F.col("mix_copies") - 1) / block).cast("int"))))
    many = many.repartition(F.xxhash64("doc_id", "source", "__mix_block"))
    first = F.col("__mix_block") * block + 1
    many = many.withColumn("mix_copy", F.explode(F.sequence(first, F.least(first + (block - 1), F.col("mix_copies"))))).drop("__mix_block")
    return few.unionByName(many).withColumn("mix_order", order)


def shuffled(mixed: DataFrame) -> DataFrame:
    """A global shuffle: rows are dealt out and ordered by ``mix_order``."""
    return mixed.repartition("mix_order").sortWithinPartitions("mix_order")


def oracle() -> str:
    """DuckDB SQL for the registered query."""
    group = "case when source in (" + ", ".join(f"'{s}'" for s in sorted(WEIGHTS)) + ") then source end"
    share = "case g " + " ".join(f"when '{s}' then {w}::double" for s, w in sorted(WEIGHTS.items())) + f" else {OTHER}::double end"
    key = "coalesce(doc_id::varchar, '') || '|' || coalesce(source, '')"
    return f"""
with d as (select *, {group} as g, coalesce(strlen(text), 0) as b from documents),
s as (select g, sum(b)::double as bytes from d group by g),
r as (select g, case when bytes > 0 then {share} * sum(bytes) over () * 1.0::double / bytes else 0 end as rate from s),
k as (select g, rate, unnest(range(greatest(0, floor(rate - 12 * sqrt(rate) - 20))::bigint, ceil(rate + 12 * sqrt(rate) + 20)::bigint + 1)) as k from r),
p as (select g, k, case when rate > 0 then exp(case when k <= {SMALL} then k * ln(rate) - rate - ln(factorial(least(k, {SMALL})::int)::double)
  else k - rate - k * ln(k / rate) - (1 / (12.0::double * k) - 1 / (360.0::double * k ** 3) + 1 / (1260.0::double * k ** 5)) - 0.5::double * ln(2 * pi() * k) end)
  else (k = 0)::int::double end as p from k),
c as (select g, k, sum(p) over (partition by g order by k) as c from p),
u as (select doc_id, source, text, g, ('0x' || substr(md5('{SEED}|' || {key} || '|' || coalesce(strlen(text)::varchar, '')), 1, 13))::bigint / (2.0::double ^ 52) as u
      from d),
n as (select u.doc_id, u.source, u.text, u.g, (select count(*) from c where c.g is not distinct from u.g and c.c <= u.u)
      + (select min(k) from c where c.g is not distinct from u.g) as n from u),
e as (select *, unnest(range(1, n + 1)) as copy from n where n > 0)
select e.doc_id, e.source, e.text, round(r.rate, 9) as mix_rate, n::int as mix_copies, copy::int as mix_copy,
       ('0x' || substr(md5('order|{SEED}|' || {key} || '|' || copy), 1, 13))::bigint / (2.0::double ^ 52) as mix_order
from e join r on e.g is not distinct from r.g
"""
