"""Sharding by histogram sort: native DataFrame operations only.

Rows are ordered by the key (hash of text, hash of id and text, row id). The splitters between
shards come from exact counts: each round counts the bytes below evenly spaced probes inside the
key ranges that still hold a splitter, and narrows those ranges, until each splitter has the right
number of bytes below it to within the tolerance or can't be moved closer. The rows then move once.

The first key part keeps equal texts next to each other, the second cuts through a group of copies
of any size, the third through rows that are repeated as a whole. So no key value is indivisible,
and a text that makes up a third of the input spreads over as many shards as its bytes need.

Edge cases: a null text has size 1 and the checksum of the empty text; an empty table gives an
empty result; repeated rows are rows of their own; columns of the input other than id and text
are carried by shard_documents() and ignored by plan_shards().
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm.common import materialize, table

KEY = ("_k0", "_k1", "_k2")
LOWEST = -1


@dataclass(frozen=True)
class Range:
    """A range of keys: equal to `prefix` in its first parts, then from lo to hi in the next one."""

    prefix: tuple[int, ...]
    lo: int
    hi: int
    below: int  # exact bytes of all rows with smaller keys

    def step(self, probes: int) -> int:
        return (self.hi - self.lo) // probes + 1

    def holds(self) -> Column:
        same = [F.col(c) == F.lit(v) for c, v in zip(KEY, self.prefix)]
        part = F.col(KEY[len(self.prefix)])
        return reduce(Column.__and__, [*same, part >= F.lit(self.lo), part <= F.lit(self.hi)])

    def splitter(self, value: int) -> tuple[int, int, int]:
        return (*self.prefix, value, LOWEST, LOWEST)[:3]


def keyed(docs: DataFrame, id_col: str, text_col: str) -> list[Column]:
    """The three key parts as non-negative longs."""
    positive = lambda c: F.shiftrightunsigned(c, 1)
    text = F.coalesce(F.col(text_col), F.lit(""))
    return [
        positive(F.xxhash64(text)).alias(KEY[0]),
        positive(F.xxhash64(F.col(id_col), text, F.lit(1))).alias(KEY[1]),
        F.monotonically_increasing_id().alias(KEY[2]),
    ]


def size_of(text_col: str) -> Column:
    return (F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)) + F.lit(1)).cast("long")


def _count(keys: DataFrame, ranges: list[Range], probes: int) -> dict[int, list]:
    """For each range, its non-empty parts in order with bytes, rows and the extremes of each key part."""
    place = reduce(
        lambda otherwise, x: F.when(
            x[1].holds(),
            F.lit(x[0] * probes) + F.expr(f"({KEY[len(x[1].prefix)]} - {x[1].lo}L) div {x[1].step(probes)}L"),
        ).otherwise(otherwise),
        reversed(list(enumerate(ranges))),
        F.lit(None).cast("long"),
    )
    found = (
        keys.select(place.alias("part"), "size", *KEY).where("part is not null").groupBy("part")
        .agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"),
             *[f(c).alias(f"{n}{c}") for c in KEY for n, f in (("lo", F.min), ("hi", F.max))])
    )
    out: dict[int, list] = {i: [] for i in range(len(ranges))}
    for r in sorted(found.collect(), key=lambda r: r["part"]):  # at most len(ranges) * probes rows
        out[r["part"] // probes].append(r)
    return out


def find_splitters(keys: DataFrame, n_shards: int, tolerance: float = 1e-3, first_probes: int = 4096,
                   probes: int = 64) -> tuple[list[tuple[int, int, int]], list[int]]:
    """n_shards - 1 keys with near equal bytes between them, and the crowded first-part cells.

    tolerance is a share of one shard's bytes. The driver holds first_probes, or n_shards * probes,
    counts at a time, whatever the size of the input.
    """
    whole = Range((), 0, 2**63 - 1, 0)
    counts = _count(keys, [whole], first_probes)[0]
    total = sum(r["bytes"] for r in counts)
    rows = sum(r["rows"] for r in counts)
    crowded = [r["part"] for r in counts if r["rows"] > 4 * rows / first_probes + 64]
    at: dict[int, tuple[int, int, int]] = {}
    open_targets = {whole: [total * j / n_shards for j in range(1, n_shards)]}
    order = {t: j for j, t in enumerate(open_targets[whole])}
    width = first_probes
    found = {whole: counts}
    while open_targets:
        narrower: dict[Range, list[float]] = {}
        for rng, targets in open_targets.items():
            below, parts = rng.below, found[rng]
            for i, r in enumerate(parts):
                above = below + r["bytes"]
                for t in (t for t in targets if below <= t < above or (i == len(parts) - 1 and t >= above)):
                    first = rng.lo + (r["part"] % width) * rng.step(width)
                    near = min(t - below, abs(above - t))
                    depth = next((d for d, c in enumerate(KEY) if r[f"lo{c}"] < r[f"hi{c}"]), None)
                    if near <= tolerance * total / n_shards or r["rows"] == 1 or depth is None:
                        value = first if t - below <= above - t else first + rng.step(width)
                        at[order[t]] = rng.splitter(value)
                    else:
                        inside = Range(tuple(r[f"lo{c}"] for c in KEY[:depth]), r[f"lo{KEY[depth]}"], r[f"hi{KEY[depth]}"], below)
                        narrower.setdefault(inside, []).append(t)
                below = above
        open_targets = narrower
        if narrower:
            width = probes
            ranges = list(narrower)
            found = dict(zip(ranges, _count(keys, ranges, probes).values()))
    return [at[j] for j in sorted(at)], crowded


def shard_of(splitters: list[tuple[int, int, int]]) -> Column:
    """The number of splitters at or below the row's key."""
    a, b, c = (F.col(k) for k in KEY)
    reached = [
        (a > F.lit(x)) | ((a == F.lit(x)) & ((b > F.lit(y)) | ((b == F.lit(y)) & (c >= F.lit(z)))))
        for x, y, z in splitters
    ]
    return reduce(Column.__add__, [r.cast("int") for r in reached], F.lit(0))


def plan_shards(docs: DataFrame, n_shards: int = 16, tolerance: float = 1e-3, id_col: str = "doc_id",
                text_col: str = "text", first_probes: int = 4096) -> DataFrame:
    """id, size, text_crc32, law, shard, slot, grown_shard for each row; law is always `bytes`.

    Slots number a shard's rows from 0 in key order. They are counted per cell of a shard (a slice
    of the key's first part, cut further where it is crowded), so no task orders a whole shard.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    keys = materialize(
        docs.select(F.col(id_col).alias("doc_id"), size_of(text_col).alias("size"),
                    F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), *keyed(docs, id_col, text_col)),
        "shard-keys",
    )
    splitters, crowded = find_splitters(keys, n_shards, tolerance, first_probes)
    coarse = F.expr(f"{KEY[0]} div {Range((), 0, 2**63 - 1, 0).step(first_probes)}L").cast("int")
    fine = F.when(coarse.isin(crowded), F.shiftright(F.col(KEY[1]), 58).cast("int")).otherwise(F.lit(0)) if crowded else F.lit(0)
    placed = keys.withColumn("shard", shard_of(splitters)).withColumn("coarse", coarse).withColumn("fine", fine)
    cell = ["shard", "coarse", "fine"]
    # At most n_shards + first_probes cells, and 32 for each crowded slice; crowded slices are under first_probes / 4.
    counts = sorted(tuple(r) for r in placed.groupBy(*cell).count().collect())
    starts, shard, seen = [], None, 0
    for s, c, f, n in counts:
        if s != shard:
            shard, seen = s, 0
        starts.append((s, c, f, seen))
        seen += n
    offsets = docs.sparkSession.createDataFrame(starts, "shard int, coarse int, fine int, start long")
    within = F.row_number().over(Window.partitionBy(*cell).orderBy(*KEY)) - F.lit(1)
    return (
        placed.join(F.broadcast(offsets), cell)
        .withColumn("slot", F.col("start") + within)
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )


def shard_documents(docs: DataFrame, n_shards: int = 16, tolerance: float = 1e-3, id_col: str = "doc_id",
                    text_col: str = "text", shard_col: str = "shard", first_probes: int = 4096) -> DataFrame:
    """docs with its shard, every column kept, moved once and sorted by key inside each partition.

    An input column of the name shard_col is replaced. The row id that ties repeated rows comes from
    the scan; an input that is not read from files should be materialized first.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() == shard_col.lower()])
    # Rows travel as one struct, so that no column of theirs can clash with the key's.
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), *keyed(docs, id_col, text_col))
    keys = materialize(docs.select(size_of(text_col).alias("size"), *keyed(docs, id_col, text_col)), "shard-keys")
    splitters, _ = find_splitters(keys, n_shards, tolerance, first_probes)
    return (
        packed.withColumn("to", shard_of(splitters))
        .repartition(F.col("to"), F.shiftright(F.col(KEY[0]), 55), F.shiftright(F.col(KEY[1]), 58))
        .sortWithinPartitions("to", *KEY).select("row.*", F.col("to").alias(shard_col))
    )


def write_shards(docs: DataFrame, path: str, n_shards: int = 16, **options) -> None:
    """One folder for each shard under path."""
    shard_documents(docs, n_shards, **options).write.partitionBy(options.get("shard_col", "shard")).parquet(path)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into shards 0 to 15 of near equal bytes."""
    return plan_shards(table(spark, sf_dir, "documents"), 16)
