"""Mixing of sources to target weights by Poisson replication: native DataFrame operations only.

A source of n documents and target weight w gets the mean repetition rate total * w / n. Each
document draws its number of copies from the Poisson distribution of that mean, by inversion of the
distribution function at a uniform number made from a hash of seed and id; so the draw needs no
state, and a lost task draws the same again. A mean above `widest` is drawn as a sum of that many
smaller ones, each with a hash of its own, which keeps the tables short and the law exact.
The copies are then dealt over all partitions and ordered by another hash.

Edge cases: a null source is a source of its own; a null id hashes as the empty text; repeated rows
draw equal counts; sources without a given weight get 0 and vanish; an empty table gives an empty
result. Columns of the input are all carried; those named like an added column are replaced.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import fresh, materialize, table

ADDED = ("rate", "copies", "copy_no", "shuffle_key")


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) with 52 bits, from the md5 of the parts joined by colons."""
    digest = F.md5(F.concat_ws(":", *parts).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(2**52))


def source_rates(docs: DataFrame, weights: Mapping[str | None, float] | None = None, exponent: float = 0.7,
                 total: int | None = None, source_col: str = "source", widest: int = 16, depth: int = 64) -> DataFrame:
    """source, rate, draws and cdf for each source.

    Without weights, a source of n documents weighs n ** exponent. total is the wanted number of
    documents, by default as many as there are. cdf has `depth` values for the mean rate / draws.
    """
    sizes = materialize(docs.groupBy(F.col(source_col).alias("_source")).agg(F.count(F.lit(1)).alias("_n")), "source-sizes")
    if weights is None:
        sizes = sizes.withColumn("_w", F.pow(F.col("_n").cast("double"), F.lit(exponent)))
    else:
        given = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "_s string, _w double")
        sizes = sizes.join(F.broadcast(given), F.col("_source").cast("string").eqNullSafe(F.col("_s")), "left").drop("_s").fillna({"_w": 0.0})
    sums = sizes.agg(F.sum("_n").alias("n"), F.sum("_w").alias("w")).first()
    wanted = float(total if total is not None else sums["n"] or 0)
    rate = F.round(F.lit(wanted) * F.col("_w") / F.lit(sums["w"] or 1.0) / F.col("_n"), 9)
    draws = F.greatest(F.lit(1), F.ceil(F.col("rate") / F.lit(widest))).cast("int")
    start = F.exp(-F.col("_mean"))
    steps = F.aggregate(
        F.sequence(F.lit(1), F.lit(depth)),
        F.struct(start.alias("p"), start.alias("c"), F.array(start).alias("all")),
        lambda acc, k: F.struct(
            (acc["p"] * F.col("_mean") / k).alias("p"),
            (acc["c"] + acc["p"] * F.col("_mean") / k).alias("c"),
            F.concat(acc["all"], F.array(acc["c"] + acc["p"] * F.col("_mean") / k)).alias("all"),
        ),
        lambda acc: acc["all"],
    )
    return (
        sizes.withColumn("rate", rate).withColumn("draws", draws).withColumn("_mean", F.col("rate") / F.col("draws"))
        .select("_source", "_n", "rate", "draws", steps.alias("cdf"))
    )


def mix_sources(docs: DataFrame, weights: Mapping[str | None, float] | None = None, exponent: float = 0.7,
                total: int | None = None, seed: int = 17, id_col: str = "doc_id", source_col: str = "source",
                broadcast_sources: int = 4096, salts: int = 64) -> DataFrame:
    """docs with each row repeated by its Poisson count, plus rate, copies, copy_no and shuffle_key.

    The table of rates is broadcast while it has at most broadcast_sources rows; beyond, the join
    is by source and salt, so that a source with a third of the rows goes to many tasks.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ADDED])
    src, draws, cdf, salt, each_salt = fresh([*docs.columns, *ADDED], "_source", "_draws", "_cdf", "_salt", "_each")
    rates = materialize(source_rates(docs, weights, exponent, total, source_col), "source-rates").select(
        F.col("_source").alias(src), "rate", F.col("draws").alias(draws), F.col("cdf").alias(cdf))
    same = docs[source_col].eqNullSafe(F.col(src))
    if rates.limit(broadcast_sources + 1).count() <= broadcast_sources:
        joined = docs.join(F.broadcast(rates), same)
    else:
        dealt = docs.withColumn(salt, F.pmod(F.xxhash64(F.col(id_col)), F.lit(salts)))
        each = rates.withColumn(each_salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        joined = dealt.join(each, dealt[source_col].eqNullSafe(F.col(src)) & (F.col(salt) == F.col(each_salt))).drop(salt, each_salt)
    name = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    drawn = F.aggregate(
        F.sequence(F.lit(1), F.col(draws)), F.lit(0),
        lambda acc, i: acc + F.size(F.filter(F.col(cdf), lambda c: c <= uniform(F.lit(str(seed)), name, i.cast("string")))),
    )
    return (
        joined.withColumn("copies", drawn).where("copies > 0").drop(src, draws, cdf)
        .withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("copies"))))
        .withColumn("shuffle_key", F.conv(F.substring(F.md5(F.concat_ws(
            ":", F.lit(f"{seed}/shuffle"), name, F.col("copy_no").cast("string")).cast("binary")), 1, 15), 16, 10).cast("long"))
        .repartition(F.col("shuffle_key")).sortWithinPartitions("shuffle_key")
    )


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to weights that grow with the 0.7th power of a source's size."""
    return mix_sources(table(spark, sf_dir, "documents"))


OP6_SQL = """
WITH RECURSIVE n AS (SELECT source, count(*) AS n, pow(count(*)::DOUBLE, 0.7) AS w FROM documents GROUP BY source),
t AS (SELECT sum(n)::DOUBLE AS n, sum(w) AS w FROM n),
r AS (SELECT n.source, round(t.n * n.w / t.w / n.n, 9) AS rate FROM n, t),
m AS (SELECT source, rate, greatest(1, ceil(rate / 16))::INT AS draws FROM r),
steps AS (
  SELECT source, 0 AS k, exp(-(rate / draws)) AS p, exp(-(rate / draws)) AS c, rate / draws AS mean FROM m
  UNION ALL
  SELECT source, k + 1, p * mean / (k + 1), c + p * mean / (k + 1), mean FROM steps WHERE k < 64),
cdf AS (SELECT source, list(c ORDER BY k) AS cdf FROM steps GROUP BY source),
u AS (
  SELECT d.*, m.rate, cdf.cdf, m.draws FROM documents d
  JOIN m ON d.source IS NOT DISTINCT FROM m.source JOIN cdf ON d.source IS NOT DISTINCT FROM cdf.source),
drawn AS (
  SELECT u.* EXCLUDE (cdf, draws), list_sum(list_transform(range(1, draws + 1), lambda i: len(list_filter(cdf, lambda c:
    c <= ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, '') || ':' || i::VARCHAR), 1, 13))::BIGINT / 4503599627370496.0))))::INT AS copies
  FROM u),
copied AS (SELECT *, unnest(range(1, copies + 1))::INT AS copy_no FROM drawn WHERE copies > 0)
SELECT *, ('0x' || substr(md5('17/shuffle:' || coalesce(doc_id::VARCHAR, '') || ':' || copy_no::VARCHAR), 1, 15))::BIGINT AS shuffle_key
FROM copied
"""
