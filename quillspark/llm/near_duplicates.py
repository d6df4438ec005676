"""Near duplicates by SetSketch registers over word shingles.

A document's set is its distinct shingles of five words. Documents of equal sets form a class, and one
of each class goes on. A SetSketch is made of it: `registers` exponential minima, truncated to powers of
`base`. Registers of a union are the larger ones of its parts, so sketches merge; equal registers are
the likelier, the more alike two sets are. Bands of registers put likely pairs into one bucket.

1. In every bucket, each class is paired with the least class there, and the joint likelihood of their registers
   says how alike they probably are. Pairs that it doesn't rule out are compared set with set: the links give
   first components. Pairs that are loosely alike give clusters, far wider than components.
2. Clusters that still hold several components are searched in blocks of bounded size. In a block, each class
   outside the largest component meets all classes of other components, by registers and then by whole
   sets, and only links that join components leave it.
3. Buckets whose classes, but for the least, are in several clusters are searched too: in blocks, each class outside the bucket's
   largest cluster meets all classes of other clusters there by registers, and the likely pairs are compared set with set.

So every pair that shares a bucket is compared, or both are in one component already. A group of many copies costs about one
pair for each of them, and no link is lost to a cap. With the default bands a pair of similarity 0.85 shares no bucket with a
probability of about 6e-9, one of 0.8 with 3e-6.

Edge cases: a text of fewer than five words is one shingle, a null text or one without words has an
empty set and is linked with nothing; rows of one id are one node, whatever their texts; rows that repeat id and
text are sketched each but compared once; a row with a null id is in its class's component, and kept where the class
has no id; ties go to the least id; very long texts are read whole, one at a time beside a slice of rows; other columns are
not read, or carried by drop_near_duplicates(), whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quillspark.llm.common import discard, fresh, map_columns, materialize, release_shuffles, table
from quillspark.llm.components import connected_components
from quillspark.shipping import ship_package

SHINGLE = 5


@dataclass(frozen=True)
class Settings:
    """base, rate: of the registers; bands of band_rows registers each; percent: 100 times the least similarity;
    slack: how far below it a likeliest similarity may be before a pair is dropped unseen; loose: the same for clusters; block, block_shingles:
    about how many rows, and shingles, a block has; two are in memory at once."""

    base: float = 1.02
    rate: float = 20.0
    bands: int = 42
    band_rows: int = 6
    percent: int = 80
    slack: float = 0.12
    loose: float = 0.45
    block: int = 1024
    block_shingles: int = 500_000
    seed: int = 11

    @property
    def registers(self) -> int:
        return self.bands * self.band_rows


_word_hashes: dict[bytes, int] = {}


def _hash_word(word: bytes) -> int:
    h = _word_hashes.get(word)
    if h is None:
        if len(_word_hashes) > 500_000:
            _word_hashes.clear()
        h = _word_hashes[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
    return h


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a whole text."""
    found = text.encode().lower().split() if text else []  # bytes know no white space and no letters but ASCII's
    if not found:
        return np.zeros(0, np.uint64)
    get = _word_hashes.get
    h = np.array([get(w) or _hash_word(w) for w in found], np.uint64)
    n = min(SHINGLE, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        out = _scramble(out ^ h[k:len(h) - n + 1 + k]) + np.uint64(k + 1)
    out.sort()
    return out[np.r_[True, out[1:] != out[:-1]]]  # far faster than np.unique(), which hashes


class SetSketch:
    """Registers of sets of 64-bit hashes."""

    def __init__(self, s: Settings):
        rng = np.random.default_rng(s.seed)
        self.s = s
        self.mult = rng.integers(0, 2**31, s.registers, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.again = rng.integers(0, 2**31, s.registers, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.log_base = float(np.log(s.base))

    def registers(self, hashes: np.ndarray) -> np.ndarray:
        """K = floor(1 - log_base(x)) for the least of exponential variables x of the given rate, within 16 bits."""
        least = np.full(self.s.registers, np.iinfo(np.uint32).max, np.uint32)
        short = (hashes >> np.uint64(32)).astype(np.uint32)
        for i in range(0, len(short), 128):  # blocks that stay in the cache
            h = short[i:i + 128, None] * self.mult
            h ^= h >> np.uint32(15)
            h *= self.again
            np.minimum(least, h.min(0), out=least)
        x = -np.log1p(-((least.astype(np.float64) + 0.5) / 2.0**32)) / self.s.rate
        return np.clip(np.floor(1 - np.log(np.maximum(x, 1e-300)) / self.log_base), 0, 65535).astype(np.uint16)

    @staticmethod
    def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.maximum(a, b)

    def band_keys(self, registers: np.ndarray) -> np.ndarray:
        """One 64-bit key for each band of each row of registers, different for different bands."""
        rows = registers.reshape(-1, self.s.bands, self.s.band_rows).astype(np.uint64)
        out = np.broadcast_to(np.arange(1, self.s.bands + 1, dtype=np.uint64), rows.shape[:2]).copy()
        for k in range(self.s.band_rows):
            out = _scramble(out ^ (rows[:, :, k] + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))
        return out.view(np.int64)

    def likeliest(self, above: np.ndarray, below: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, equal: np.ndarray) -> np.ndarray:
        """The Jaccard similarity of the highest joint likelihood, to 0.01, for the numbers of registers that are
        above, below and equal, and the known sizes of the sets."""
        j = np.arange(0, 101)[None, :] / 100.0
        u = (n_a / np.maximum(n_a + n_b, 1))[:, None]
        v = 1 - u
        b = self.s.base
        p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (b - 1) / b) / self.log_base
        more, less = np.maximum(p(u - v * j), 1e-9), np.maximum(p(v - u * j), 1e-9)
        fit = above[:, None] * np.log(more) + below[:, None] * np.log(less) + equal[:, None] * np.log(np.maximum(1 - more - less, 1e-9))
        fit[j > np.minimum(u / np.maximum(v, 1e-12), v / np.maximum(u, 1e-12)) + 0.01] = -np.inf
        return fit.argmax(1) / 100.0

    def compare(self, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
        """Likeliest similarities of rows of registers."""
        return self.likeliest((a > b).sum(1), (a < b).sum(1), np.asarray(n_a, float), np.asarray(n_b, float), (a == b).sum(1))


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether the sets, sorted, are at least so alike."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def spot_of(text_col: str) -> Column:
    """A hash of a row's text; with the id it tells rows apart that aren't repeats of one another."""
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("spot")


def sketch_documents(docs: DataFrame, id_col: str, text_col: str, s: Settings) -> DataFrame:
    """doc_id, spot (a hash of the text), n_shingles, set_a and set_b (a 128-bit hash of the set), registers and keys (its bands) for each row."""
    kind = docs.schema[id_col].dataType.simpleString()
    sketcher = SetSketch(s)

    def sketch(ids: list, texts: list, spots: list) -> list:
        sets = [shingles(t) for t in texts]
        marks = [np.frombuffer(hashlib.blake2b(x.tobytes(), digest_size=16).digest(), np.int64) for x in sets]
        registers = np.stack([sketcher.registers(x) for x in sets])
        keys = sketcher.band_keys(registers).tolist()
        return [ids, spots, [len(x) for x in sets], [int(m[0]) for m in marks], [int(m[1]) for m in marks],
                [r.tobytes() for r in registers], [k if len(x) else [] for k, x in zip(keys, sets)]]

    return map_columns(docs.select(id_col, text_col, spot_of(text_col)), sketch,
                       f"doc_id {kind}, spot long, n_shingles long, set_a long, set_b long, registers binary, keys array<long>")


def _compare_pairs(pairs: DataFrame, sets: DataFrame, s: Settings) -> DataFrame:
    """a, b and linked of the pairs that are at least loosely alike: first by the likelihood of their registers, then by whole sets."""
    sketcher = SetSketch(s)
    side = lambda c: sets.select(F.col("node").alias(c), F.col("registers").alias(f"r{c}"), F.col("members").alias(f"s{c}"))

    def check(a: list, b: list, ra: list, rb: list, sa: list, sb: list) -> list:
        x, y = [np.frombuffer(m, np.uint64) for m in sa], [np.frombuffer(m, np.uint64) for m in sb]
        guess = sketcher.compare(np.stack([np.frombuffer(r, np.uint16) for r in ra]), np.stack([np.frombuffer(r, np.uint16) for r in rb]),
                                 np.array([len(m) for m in x]), np.array([len(m) for m in y]))
        near = [i for i in range(len(a)) if guess[i] >= s.percent / 100 - s.loose]
        sure = [bool(guess[i] >= s.percent / 100 - s.slack) and linked(x[i], y[i], s.percent) for i in near]
        return [[a[i] for i in near], [b[i] for i in near], sure]

    kind = pairs.schema["a"].dataType.simpleString()
    joined = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ra", "rb", "sa", "sb")
    return map_columns(joined, check, f"a {kind}, b {kind}, linked boolean", rows=256)


class Block:
    """Classes of one cluster, in memory: node, half, component, registers and sets."""

    def __init__(self, rows: list[tuple], sketcher: SetSketch):
        self.s, self.sketcher = sketcher.s, sketcher
        self.half, self.node, components, registers, sets = zip(*rows)
        label = {c: i for i, c in enumerate(dict.fromkeys(components))}
        self.component = np.array([label[c] for c in components])
        self.registers = np.stack([np.frombuffer(r, np.uint16) for r in registers])
        self.size = np.array([len(m) // 8 for m in sets])
        self.start = np.r_[0, np.cumsum(self.size)]
        ids, self.flat = np.unique(np.frombuffer(b"".join(sets), np.uint64), return_inverse=True)
        self.mark = np.zeros(len(ids), bool)

    def links(self, same: bool) -> Iterator[tuple]:
        """Pairs that are linked and join two components; not same: only between different halves."""
        s, size, half, cut = self.s, self.size, np.array(self.half), self.s.percent / 100 - self.s.slack
        largest = np.bincount(self.component).argmax()
        for i in range(len(size)):
            if self.component[i] == largest:
                continue
            fit = (self.component != self.component[i]) & (np.minimum(size, size[i]) * 100 >= np.maximum(size, size[i]) * s.percent)
            if not same:
                fit &= half != half[i]
            at = np.flatnonzero(fit)
            at = at[(self.registers[at] == self.registers[i]).mean(1) >= cut - 0.03] if len(at) else at
            if not len(at):
                continue
            at = at[self.sketcher.compare(np.broadcast_to(self.registers[i], (len(at), s.registers)), self.registers[at], np.full(len(at), float(size[i])), size[at].astype(float)) >= cut]
            mine = self.flat[self.start[i]:self.start[i + 1]]
            self.mark[mine] = True
            for j in at:
                if self.component[j] != self.component[i]:
                    common = int(self.mark[self.flat[self.start[j]:self.start[j + 1]]].sum())
                    if 100 * common >= s.percent * (size[i] + size[j] - common):
                        gone, stays = (self.component[i], self.component[j])
                        self.component[self.component == gone] = stays
                        yield self.node[i], self.node[j], True
            self.mark[mine] = False


def _search_blocks(rows: DataFrame, kind: str, s: Settings) -> DataFrame:
    """a, b, linked from rows (cluster, left, right, half, node, component, registers, members), sorted by the first three
    within partitions: left and right are the two blocks of the cluster that meet."""
    sketcher = SetSketch(s)
    schema = T.StructType.fromDDL(f"a {kind}, b {kind}, linked boolean")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, now = [], None

        def close() -> Iterator[pa.RecordBatch]:
            found = list(Block(unit, sketcher).links(now[1] == now[2])) if len(unit) > 1 else []
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), arrow)], schema=arrow)

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for cluster, left, right, *row in zip(*[c.to_pylist() for c in batch.slice(at, 256).columns]):
                    if (cluster, left, right) != now:
                        if unit:
                            yield from close()
                        unit, now = [], (cluster, left, right)
                    unit.append(tuple(row))
        if unit:
            yield from close()

    ship_package(rows.sparkSession)
    return rows.select("cluster", "left", "right", "half", "node", "component", "registers", "members").mapInArrow(run, schema)


def _mixed_buckets(members: DataFrame, clusters: DataFrame, sets: DataFrame, s: Settings) -> DataFrame:
    """Rows (key, o, m, far, node, cluster, n_shingles, registers) of the buckets whose classes, but for the least, are in several
    clusters, sorted by the first three within partitions. far: not in the bucket's largest cluster. In the unit (o, m)
    of a bucket, the far rows of block o meet all rows of block m."""
    others = members.where("n > 2 and node > least").select("key", "node").join(clusters, F.col("node") == F.col("in"), "left").select("key", "node", F.coalesce("cluster", "node").alias("cluster"))
    parts = others.groupBy("key", "cluster").agg(F.count(F.lit(1)).alias("k"))
    mixed = parts.groupBy(F.col("key").alias("bucket")).agg(F.sum("k").alias("all"), F.max(F.struct("k", "cluster")).alias("most"), F.count(F.lit(1)).alias("parts")).where("parts > 1").select(
        "bucket", F.col("most.cluster").alias("largest"), F.ceil((F.col("all") - F.col("most.k")) / s.block).cast("int").alias("o_blocks"), F.ceil(F.col("all") / s.block).cast("int").alias("m_blocks"))
    rows = others.join(mixed, F.col("key") == F.col("bucket")).withColumn("h", F.xxhash64("node"))
    steps = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    mine = lambda n: F.pmod("h", F.col(n)).cast("int")
    every = rows.select("key", "node", "cluster", F.explode(steps("o_blocks")).alias("o"), mine("m_blocks").alias("m"), F.lit(False).alias("far"))
    far = rows.where("cluster <> largest").select("key", "node", "cluster", mine("o_blocks").alias("o"), F.explode(steps("m_blocks")).alias("m"), F.lit(True).alias("far"))
    held = materialize(every.unionByName(far), "mixed-buckets")
    known = sets.select(F.col("node").alias("of"), "n_shingles", "registers")
    return held.join(known, F.col("node") == F.col("of")).select("key", "o", "m", "far", "node", "cluster", "n_shingles", "registers").repartition("key", "o", "m").sortWithinPartitions("key", "o", "m")


def _search_buckets(rows: DataFrame, kind: str, s: Settings) -> DataFrame:
    """a, b (a < b) of the pairs in _mixed_buckets() that are of different clusters and likely alike; a pair may come several times."""
    sketcher, cut = SetSketch(s), s.percent / 100 - s.slack
    schema = T.StructType.fromDDL(f"a {kind}, b {kind}")
    arrow = to_arrow_schema(schema)

    def pairs(unit: list[tuple]) -> Iterator[tuple]:
        far, node, clusters, size, registers = zip(*unit)
        label = {c: i for i, c in enumerate(dict.fromkeys(clusters))}
        cluster, size, far = np.array([label[c] for c in clusters]), np.array(size), np.array(far)
        registers = np.stack([np.frombuffer(r, np.uint16) for r in registers])
        for i in np.flatnonzero(far):
            at = np.flatnonzero(~far & (cluster != cluster[i]) & (np.minimum(size, size[i]) * 100 >= np.maximum(size, size[i]) * s.percent))
            at = at[(registers[at] == registers[i]).mean(1) >= cut - 0.03] if len(at) else at
            if len(at):
                guess = sketcher.compare(np.broadcast_to(registers[i], (len(at), s.registers)), registers[at], np.full(len(at), float(size[i])), size[at].astype(float))
                for j in at[guess >= cut]:
                    yield min(node[i], node[j]), max(node[i], node[j])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, now = [], None

        def close() -> Iterator[pa.RecordBatch]:
            found = list(pairs(unit)) if len(unit) > 1 else []
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), arrow)], schema=arrow)

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for key, o, m, *row in zip(*[c.to_pylist() for c in batch.slice(at, 256).columns]):
                    if (key, o, m) != now:
                        if unit:
                            yield from close()
                        unit, now = [], (key, o, m)
                    unit.append(tuple(row))
        if unit:
            yield from close()

    ship_package(rows.sparkSession)
    return rows.mapInArrow(run, schema)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", s: Settings = Settings()) -> DataFrame:
    """doc_id, n_shingles, component_id (the least id reachable), kept (whether it is the row's own) and spot (a hash of its text) for each row."""
    kind = docs.schema[id_col].dataType.simpleString()
    sketches = materialize(sketch_documents(docs, id_col, text_col, s), "sketches")
    with_id = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "spot"))
    classes = sketches.where("n_shingles > 0").groupBy("set_a", "set_b").agg(F.min(with_id).alias("row")).where("row is not null")
    classes = materialize(classes.select("set_a", "set_b", F.col("row.doc_id").alias("node"), F.col("row.spot").alias("mark")), "classes")
    # A class's sketch is that of its row with the least id; rows that repeat both id and text are one.
    chosen = sketches.join(classes.withColumnsRenamed({"set_a": "ca", "set_b": "cb"}),
                           (F.col("doc_id") == F.col("node")) & (F.col("spot") == F.col("mark")) & (F.col("set_a") == F.col("ca")) & (F.col("set_b") == F.col("cb")))
    one = materialize(chosen.select("node", "mark", "n_shingles", "registers", "keys").dropDuplicates(["node", "mark"]), "class-sketches")
    banded = one.select("node", F.explode("keys").alias("key"))
    buckets = banded.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("last"), F.count(F.lit(1)).alias("n")).where("least < last")
    members = materialize(banded.join(buckets.drop("last"), "key"), "bucket-members")
    pairs = materialize(members.where("node > least").select(F.col("least").alias("a"), F.col("node").alias("b")).distinct(), "star-pairs")
    wanted = members.select(F.col("node").alias("want")).distinct()

    def with_sets(nodes: list, n: list, registers: list, texts: list) -> list:
        return [nodes, n, registers, [shingles(t).tobytes() for t in texts]]

    here = one.join(wanted, one["node"] == wanted["want"]).select("node", "mark", "n_shingles", "registers")
    text = docs.select(F.col(id_col).alias("text_id"), F.col(text_col).alias("text"), spot_of(text_col)).where("text is not null").dropDuplicates(["text_id", "spot"])
    held = here.join(text, (here["node"] == text["text_id"]) & (here["mark"] == text["spot"])).select("node", "n_shingles", "registers", "text")
    sets = materialize(map_columns(held, with_sets, f"node {kind}, n_shingles long, registers binary, members binary"), "sets")

    first = materialize(_compare_pairs(pairs, sets, s), "links")
    discard(pairs)
    release_shuffles(docs.sparkSession)
    labels = connected_components(first.where("linked"))
    clusters = connected_components(first).select(F.col("node").alias("in"), F.col("component").alias("cluster"))
    placed = clusters.join(labels, F.col("in") == F.col("node"), "left").select(F.col("in").alias("of"), "cluster", F.coalesce("component", "in").alias("component"))
    whole = sets.select("node", F.col("n_shingles").alias("n"), "registers", "members").join(placed, F.col("node") == F.col("of"))
    sizes = sets.select("node", F.col("n_shingles").alias("n")).join(placed, F.col("node") == F.col("of")).groupBy(F.col("cluster").alias("c")).agg(
        F.count(F.lit(1)).alias("k"), F.sum("n").alias("total"), F.min("component").alias("c0"), F.max("component").alias("c1"))
    split = materialize(sizes.where("c0 <> c1").select("c", F.ceil(F.greatest(F.col("k") / s.block, F.col("total") / s.block_shingles)).cast("int").alias("blocks")), "open-clusters")
    rows = (
        whole.join(split, F.col("cluster") == F.col("c")).withColumn("half", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("left", F.least("half", "other")).withColumn("right", F.greatest("half", "other"))
    )
    spread = rows.repartition("cluster", "left", "right").sortWithinPartitions("cluster", "left", "right")
    second = materialize(_search_blocks(spread, kind, s), "links")
    release_shuffles(docs.sparkSession)
    likely = materialize(_search_buckets(_mixed_buckets(members, clusters, sets, s), kind, s).distinct(), "likely-pairs")
    third = materialize(_compare_pairs(likely, sets, s).where("linked"), "links")
    discard(members, sets)
    more = second.unionByName(third)
    labels = connected_components(first.where("linked").unionByName(more)) if not more.isEmpty() else labels

    of_class = classes.join(labels.withColumnRenamed("node", "at"), F.col("node") == F.col("at"), "left").select(
        F.col("set_a").alias("ca"), F.col("set_b").alias("cb"), F.coalesce("component", "node").alias("component"))
    full = sketches.where("n_shingles > 0").join(of_class, (F.col("set_a") == F.col("ca")) & (F.col("set_b") == F.col("cb")), "left")
    # Empty sets, which may be many, all have one hash, so they are in no join.
    every = full.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), "spot").unionByName(
        sketches.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "spot"))
    return every.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"), "spot")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", s: Settings = Settings()) -> DataFrame:
    """The rows of docs, all columns kept, whose id is the least of its component; of rows with one id and text one stays.

    Rows go by id and text, so a copy with a null id goes, and a unique text stays though its id is that of a copy too.
    """
    gone_id, gone_spot = fresh(docs, "_gone_id", "_gone_spot")
    gone = materialize(near_duplicates(docs, id_col, text_col, s).where("not kept").select(F.col("doc_id").alias(gone_id), F.col("spot").alias(gone_spot)).distinct(), "copies")
    same = docs[id_col].eqNullSafe(F.col(gone_id)) & (F.xxhash64(F.coalesce(docs[text_col], F.lit(""))) == F.col(gone_spot))
    return docs.join(gone, same, "left_anti").dropDuplicates([id_col, text_col])


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates among all documents, at a similarity of 0.85."""
    return near_duplicates(table(spark, sf_dir, "documents"), s=Settings(percent=85)).drop("spot")


OP5_SQL = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] ELSE list_distinct(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(w[i:i + 4], ' '))) END AS sh FROM t),
m AS (SELECT doc_id, len(sh) AS n, sh, md5(array_to_string(list_sort(sh), chr(10))) AS mark FROM s),
c AS (SELECT mark, min(doc_id) AS c, any_value(n) AS n, any_value(sh) AS sh FROM m WHERE n > 0 GROUP BY mark),
e AS (SELECT c, n, unnest(sh) AS h FROM c),
link AS (SELECT a.c AS a, b.c AS b FROM e a JOIN e b ON a.h = b.h AND a.c < b.c GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT c AS node, c AS seen FROM c UNION SELECT reach.node, edge.b FROM reach JOIN edge ON edge.a = reach.seen),
comp AS (SELECT node, min(seen) AS component FROM reach GROUP BY node)
SELECT doc_id, m.n::BIGINT AS n_shingles, coalesce(component, doc_id) AS component_id, coalesce(component, doc_id) = doc_id AS kept
FROM m LEFT JOIN c ON m.mark = c.mark AND m.n > 0 LEFT JOIN comp ON comp.node = c.c
"""
