"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boutlab.llm.common import carried, unpacked
from boutlab.sources.tables import stage

SEED = 20
# Without weights, a source counts with its rows to this power: small sources are repeated.
TEMPERATURE = 0.7


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) that depends on the parts alone: 52 bits of their MD5."""
    digest = F.md5(F.concat_ws(":", *parts))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def rates(docs: DataFrame, weights: Mapping[str, float] | None, total: int | None) -> DataFrame:
    """(source, rate, cdf): mean copies of a document of the source, and the Poisson distribution
    function from 0 up to where nothing is left to a double."""
    counted = docs.groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.count(F.lit(1)).alias("rows"))
    counted = stage(counted, "source_rows")
    if weights is None:
        weighted = counted.withColumn("weight", F.pow(F.col("rows").cast("double"), F.lit(TEMPERATURE)))
    else:
        given = counted.sparkSession.createDataFrame(list(weights.items()), "source string, weight double")
        weighted = counted.join(given, "source", "left").fillna(0.0, ["weight"])
    weight, rows = weighted.agg(F.sum("weight"), F.sum("rows")).first()
    share = F.col("weight") / F.lit(weight or 1.0) * F.lit(float(total if total is not None else rows or 0))
    rated = weighted.select("source", (share / F.col("rows")).alias("rate"))
    steps = "sequence(1, cast(ceil(rate + 12 * sqrt(rate) + 30) AS int))"
    # In logarithms, so that a high rate does not start from an exp that is zero.
    cdf = F.expr(
        f"aggregate({steps}, struct(-rate AS l, array(exp(-rate)) AS c), "
        "(a, k) -> struct(a.l + ln(rate) - ln(k) AS l, "
        "concat(a.c, array(element_at(a.c, -1) + exp(a.l + ln(rate) - ln(k)))) AS c), a -> a.c)"
    )
    return rated.withColumn("cdf", F.when(F.col("rate") > 0, cdf).otherwise(F.expr("array(1D)")))


def mix(
    docs: DataFrame,
    weights: Mapping[str, float] | None = None,
    total: int | None = None,
    seed: int = SEED,
) -> DataFrame:
    """Repeat every document a Poisson number of times and shuffle all copies.

    The mean of a document's copies is its source's target share of ``total`` rows (the number of
    rows, if None) divided by the source's rows. Its count inverts the Poisson distribution function
    at a uniform number that is a hash of seed and doc_id, so it depends on nothing else, and a
    recomputed task makes the same copies. ``copy`` numbers them from 1 and ``place`` is a hash of
    seed, doc_id and copy: partitions are dealt by it and sorted by it, so the stored order is random.

    The rates are one row per source, written down first: Spark broadcasts them while they are small
    and joins by source beyond, splitting a hot one.

    A null source is the source ''; a source without a weight in ``weights`` gets none of the rows;
    rows of one doc_id are repeated alike; a null doc_id counts as ''; an empty table stays empty.
    Columns of ``docs`` stay; ``copy`` and ``place`` replace columns of these names.
    """
    known = stage(rates(docs.select("source"), weights, total), "rates")
    doc_id = F.coalesce(F.col("_row.doc_id").cast("string"), F.lit(""))
    keyed = carried(docs).withColumns({"source": F.coalesce("_row.source", F.lit("")), "_id": doc_id})
    u = uniform(F.lit(str(seed)), "_id")
    counted = keyed.withColumn("_u", u).join(known, "source")
    copies = counted.withColumn("_copies", F.expr("size(filter(cdf, c -> c <= _u))")).filter("_copies > 0")
    spread = copies.select("_row", "_id", F.explode(F.sequence(F.lit(1), F.col("_copies")).cast("array<long>")).alias("copy"))
    placed = spread.withColumn("place", uniform(F.lit(str(seed)), "_id", F.col("copy").cast("string")))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = placed.drop("_id").repartition(parts, "place").sortWithinPartitions("place")
    return unpacked(dealt, docs.columns, ["copy", "place"])


def mix_sql(table: str = "documents", seed: int = SEED) -> str:
    """The same answer as a query for DuckDB, for the default weights."""
    number = "('0x' || substr(md5({}), 1, 13))::BIGINT / 4503599627370496.0"
    own, copied = number.format(f"'{seed}:' || d.doc_id"), number.format(f"'{seed}:' || doc_id || ':' || copy")
    return f"""
        WITH counted AS (SELECT coalesce(source, '') AS s, count(*) AS rows FROM {table} GROUP BY 1),
        rated AS (
            SELECT s, pow(rows, {TEMPERATURE}) / sum(pow(rows, {TEMPERATURE})) OVER ()
                * sum(rows) OVER () / rows AS rate FROM counted),
        terms AS (
            SELECT s, k, exp(-rate + sum(CASE WHEN k = 0 THEN 0 ELSE ln(rate) - ln(k) END)
                OVER (PARTITION BY s ORDER BY k)) AS p
            FROM (SELECT s, rate, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 31)::BIGINT)) AS k
                FROM rated)),
        steps AS (
            SELECT s, k, sum(p) OVER (PARTITION BY s ORDER BY k) AS below FROM terms),
        made AS (
            SELECT d.*, k + 1 AS copy FROM {table} d JOIN steps
                ON coalesce(d.source, '') = s AND below <= {own})
        SELECT *, {copied} AS place FROM made"""
