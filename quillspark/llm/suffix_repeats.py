"""Removal of repeated byte strings by the common-prefix interval tree of a sparse suffix array.

Suffixes begin at anchors: in each window of `length` bytes, the positions whose hash of `gram` bytes is
the least. Equal windows have equal anchors at equal offsets, so every repeated window shows as suffixes of
one anchor hash. Around an anchor only `length - gram` bytes to the left and `length` to the right matter:
its context.

1. Anchors whose hash occurs once repeat nothing. Where all contexts of a hash are equal, the whole
   context repeats.
2. The distinct contexts of all other hashes are sorted by hash and what follows the anchor, in ranges of about
   equal size; a stack scan of the common prefixes of neighbours gives each hash's interval tree. In each interval the members
   are sorted by what precedes the anchor: where that differs, the interval splits into maximal repeats, and
   each member's longest repeat to the left and right is known.
3. A hash of many contexts, as of a passage that half the documents share, goes on through several ranges. What a context
   can share with those of other ranges is told by the ranges' first and last contexts alone: a few lengths, each of which names one
   window of `length` bytes, and equal windows meet by hash. Sorted by what follows, that gives the most bytes
   to the right; such hashes are sorted by what precedes too, which gives those to the left. No task holds more than a range.

Spans go back to all anchors with that context, and each document drops their union. Documents are keyed by id
and text, so repeated rows count as repeats of each other. Hashes of 64 bits stand for strings of bytes.

Edge cases: null and empty texts have no bytes; texts shorter than `length` lose nothing; very long
texts are read in overlapping pieces; a null id is an id; an empty table gives an empty result; other columns are not read,
whatever their names.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quillspark.llm.common import discard, map_columns, materialize, release_shuffles, table
from quillspark.shipping import ship_package


@dataclass(frozen=True)
class Settings:
    """length: of the strings that must not repeat; gram: bytes hashed for anchors; piece: window starts read at a time."""

    length: int = 200
    gram: int = 32
    piece: int = 1 << 19

    @property
    def left(self) -> int:
        return self.length - self.gram


_BASE = np.uint64(0x9E3779B97F4A7C15)
_BYTES = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64)


def _powers(n: int, cache: dict = {}) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006
    if cache.get("n", 0) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        inverse = np.uint64(pow(int(_BASE), -1, 2**64))
        ones = lambda b: np.cumprod(np.r_[np.uint64(1), np.full(size - 1, b, np.uint64)])
        cache.update(n=size, up=ones(_BASE), down=ones(inverse))
    return cache["up"][:n], cache["down"][:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _slide(x: np.ndarray, width: int, f) -> np.ndarray:
    """f over every run of `width` neighbours."""
    w = 1
    while 2 * w <= width:
        x = f(x[w:], x[:-w])
        w *= 2
    return f(x[width - w:], x[:len(x) - (width - w)]) if width > w else x


class Hashes:
    """Hashes of any stretch of some bytes."""

    def __init__(self, data: np.ndarray):
        up, self.down = _powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTES[data] * up[:-1], out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return _mix((self.sums[stop] - self.sums[start]) * self.down[start])


def anchors(data: bytes, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Position, hash and context hash of each anchor."""
    d = np.frombuffer(data, np.uint8)
    n, span = len(d), s.left + 1
    found: list[tuple] = []
    for a in range(0, n - s.length + 1, s.piece):
        b = min(a + s.piece, n - s.length + 1)  # window starts a to b
        lo = max(0, a - s.left)
        hi = min(n, b + s.left + s.length)
        h = Hashes(d[lo:hi])
        at = np.arange(a - lo, b - lo + s.left)
        g = h.of(at, at + s.gram)
        least = _slide(g, span, np.minimum)
        edge = np.zeros(s.left, np.uint64)
        is_anchor = _slide(np.r_[edge, least, edge], span, np.maximum) == g
        x = at[is_anchor]
        begin = np.maximum(x + lo - s.left, 0) - lo
        end = np.minimum(x + lo + s.length, n) - lo
        ctx = _mix(h.of(begin, end) ^ _mix(((x - begin) * 1024 + (end - x)).astype(np.uint64) + np.uint64(1)))
        found.append((x + lo, g[is_anchor], ctx))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    pos, g, ctx = (np.concatenate(c) for c in zip(*found))
    pos, first = np.unique(pos, return_index=True)
    return pos, g[first], ctx[first]


def lcp_intervals(lcp: list[int]) -> list[tuple[int, int, int]]:
    """(common length, first, last) of each interval of the tree; lcp[i] is that of entries i and i + 1. Stack scan."""
    out, stack = [], []
    for i in range(len(lcp) + 1):
        now = lcp[i] if i < len(lcp) else -1
        first = i
        while stack and stack[-1][0] > now:
            size, first = stack.pop()
            out.append((size, first, i))
        if i < len(lcp) and (not stack or stack[-1][0] < now):
            stack.append((now, first))
    return out


def _grid(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The strings as rows of one width, and their lengths."""
    sizes = np.array([len(p) for p in parts], np.int64)
    width = max(1, int(sizes.max(initial=0)))
    return np.frombuffer(b"".join(p.ljust(width, b"\0") for p in parts), np.uint8).reshape(len(parts), width), sizes


def _shared(a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each row of a and of b."""
    differ = a != b
    return np.minimum(np.where(differ.any(1), differ.argmax(1), a.shape[1]), most)


def _common(rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each row and the next."""
    return _shared(rows[1:], rows[:-1], np.minimum(sizes[1:], sizes[:-1]))


class ContextTree:
    """Enhanced suffix array of distinct contexts, sorted by hash, then by `main`: what stands on one side of the anchor.

    rest is what stands on the other side, read away from the anchor; contexts of several hashes make a tree for each.
    """

    def __init__(self, hashes: np.ndarray, main: list[bytes], rest: list[bytes]):
        self.n = len(main)
        self.rest, self.rest_n = _grid(rest)
        rows, sizes = _grid(main)
        self.lcp = _common(rows, sizes)
        self.lcp[hashes[1:] != hashes[:-1]] = -1
        self.intervals = lcp_intervals(self.lcp.tolist())
        self.rank = np.argsort(np.array(sorted(range(self.n), key=rest.__getitem__), np.int64)) if self.n else np.zeros(0, np.int64)

    def maximal_repeats(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each interval: its common length, members, and the most bytes each shares on the other side with another.

        Where members share their whole other side, the interval is extensible there, and the shared length says by
        how much; where they differ, it is diverse and splits into maximal repeats.
        """
        for size, first, last in self.intervals:
            inside = np.arange(first, last + 1)
            inside = inside[np.argsort(self.rank[inside])]
            shared = _common(self.rest[inside], self.rest_n[inside])
            yield size, inside, np.maximum(np.r_[0, shared], np.r_[shared, 0])

    def reaches(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """For each context, bytes covered on the main and on the other side by strings that occur in another one."""
        main, rest = np.zeros(self.n, np.int64), np.zeros(self.n, np.int64)
        pairs = np.array([(size, first) for size, first, last in self.intervals if last == first + 1], np.int64).reshape(-1, 2)
        size, first = pairs[:, 0], pairs[:, 1]
        shared = _shared(self.rest[first], self.rest[first + 1], np.minimum(self.rest_n[first], self.rest_n[first + 1]))
        for who in (first, first + 1):
            ok = shared + size >= length
            np.maximum.at(main, who[ok], size[ok])
            np.maximum.at(rest, who[ok], shared[ok])
        self.intervals = [x for x in self.intervals if x[2] > x[1] + 1]
        for size_, who, shared in self.maximal_repeats():
            ok = shared + size_ >= length
            main[who[ok]] = np.maximum(main[who[ok]], size_)
            rest[who[ok]] = np.maximum(rest[who[ok]], shared[ok])
        return main, rest


REACH, MEMBER, ENDS, WINDOW = 0, 1, 2, 3
FAR = 1 << 14  # longer than any context
SCANNED = ("role int, part int, hash long, context long, main_reach int, rest_reach int, main binary, rest binary, to_first int, to_last int, most int, "
           "from_first array<int>, from_last array<int>, size int, window long, asks boolean")
BLANK = dict.fromkeys(x.split()[0] for x in SCANNED.split(", "))


def _name(h: int, size: int, after: bytes, before: bytes, length: int) -> int:
    """A 64-bit hash of the window of size bytes behind the anchor and the rest before it (last byte first)."""
    data = after[:size] + before[:length - size]
    return int.from_bytes(hashlib.blake2b(data, digest_size=8, key=(h % 2**64).to_bytes(8, "little"), salt=size.to_bytes(2, "little")).digest(), "little", signed=True)


class Windows:
    """Windows of contexts that may occur in other ranges. A context that knows already that its window repeats asks nothing, and
    then the window is named once, for others that ask."""

    def __init__(self, length: int):
        self.length = length
        self.told: set[int] = set()

    def of(self, h: int, after: bytes, before: bytes, sizes: list[int], behind: int, ahead: int, covered_after: int, covered_before: int) -> Iterator[tuple[int, int, bool]]:
        """size, name, asks; behind and ahead bound what any other context shares with this one after and before the anchor."""
        for size in sizes:
            other = self.length - size
            if 0 <= other <= min(ahead, len(before)) and size <= min(behind, len(after)):
                name = _name(h, size, after, before, self.length)
                asks = size > covered_after or other > covered_before
                if asks or name not in self.told:
                    if not asks:
                        self.told.add(name)
                    yield size, name, asks


def _scan(rows: DataFrame, s: Settings, turned: bool = False, depths: bool = False, group: int = 8192) -> DataFrame:
    """Trees over sorted ranges of rows (hash, context, main, rest); a partition is one range. Rows of the columns SCANNED.

    REACH rows have the reaches within the range. The first and the last hash of a range may go on in the neighbouring
    ranges: MEMBER rows are their contexts, with their reaches, the bytes they share with the range's first and last, and `most`: the
    most that any other context shares with them on the main side. ENDS rows have the first and last (in main and rest) and the lengths that others
    share with them. Turned rows have come from another scan, by the other side, with the sizes of windows that ranges there left open, with
    `most` there, and with reaches; WINDOW rows name these windows. depths: each context has a REACH row, with the lengths of the intervals
    it is in (in from_first). group: about how many rows are worked on together.
    """
    schema = T.StructType.fromDDL(SCANNED)
    arrow = to_arrow_schema(schema)
    spark = rows.sparkSession
    ship_package(spark)
    order = ["hash", "main", "rest"]

    def work(held: list[tuple], opens: bool, ends: bool) -> Iterator[tuple]:
        part = TaskContext.get().partitionId()
        hashes, contexts, main, rest = (list(c) for c in zip(*[x[:4] for x in held]))
        h = np.array(hashes, np.int64)
        tree = ContextTree(h, main, rest)
        lcp = tree.lcp
        inside_of: list[set[int]] = [set() for _ in held] if depths else []
        for size, first, last in tree.intervals if depths else ():
            for i in range(first, last + 1):
                inside_of[i].add(size)
        reach, other = tree.reaches(s.length)
        row = lambda role, i, **more: tuple((BLANK | {"role": role, "part": part, "hash": hashes[i]} | more).values())
        for i in range(len(held)) if depths else ():
            yield row(REACH, i, context=contexts[i], from_first=sorted(inside_of[i]))
        for i in np.flatnonzero(reach + other) if not depths else ():
            yield row(REACH, i, context=contexts[i], main_reach=int(reach[i]), rest_reach=int(other[i]))
        n = len(held)
        most = np.maximum(np.r_[FAR if opens else -1, lcp], np.r_[lcp, FAR if ends else -1])  # the neighbour of a range's edge is not here
        if turned:
            windows = Windows(s.length)
            for i, (sizes, behind, known_after, known_before) in enumerate(x[4:] for x in held):
                for size, name, asks in windows.of(hashes[i], rest[i], main[i], sizes, behind, int(most[i]), max(known_after, int(other[i])), max(known_before, int(reach[i]))):
                    yield row(WINDOW, i, context=contexts[i], size=size, window=name, asks=asks)
        first_n = int((h != h[0]).argmax()) or n
        last_n = int((h[::-1] != h[-1]).argmax()) or n
        for lo, hi in {(0, first_n) if opens else None, (n - last_n, n) if ends else None} - {None}:
            inside = lcp[lo:hi - 1]
            to_first = np.minimum.accumulate(np.r_[FAR, inside])
            to_last = np.minimum.accumulate(np.r_[FAR, inside[::-1]])[::-1]
            at_first, at_last = opens and lo == 0, ends and hi == n
            for i in range(lo, hi):
                # Turned, `most` is what the scan before has found, for its own side: the one that windows of this scan need a bound for.
                yield row(MEMBER, i, context=contexts[i], main_reach=int(reach[i]), rest_reach=int(other[i]), main=main[i], rest=rest[i], most=held[i][5] if turned else int(most[i]),
                          to_first=int(to_first[i - lo]) if at_first else None, to_last=int(to_last[i - lo]) if at_last else None)
            yield row(ENDS, lo, main=main[lo], rest=main[hi - 1], to_first=int(at_first), to_last=int(at_last), from_first=np.unique(to_first[1:]).tolist(), from_last=np.unique(to_last[:-1]).tolist())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        opens = True

        def out(ends: bool) -> Iterator[pa.RecordBatch]:
            made = work(held, opens, ends)
            while some := list(itertools.islice(made, 4096)):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some), arrow)], schema=arrow)

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if held and row[:2] == held[-1][:2]:
                    continue  # a repeated row's
                if len(held) >= group and row[0] != held[-1][0]:
                    yield from out(False)
                    held, opens = [], False
                held.append(row)
        if held:
            yield from out(True)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    columns = ["hash", "context", "main", "rest", *(["sizes", "most", "rest_reach", "main_reach"] if turned else [])]
    return rows.select(*columns).repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(run, schema)


def _beyond(ends: list) -> list[tuple[int, int, list[int], list[int]]]:
    """part, hash, lefts, rights of the hashes that go on in other ranges: the lengths that the range's first (last)
    context shares with contexts of ranges before (behind) it. ends: ENDS rows, at most two for each range."""
    first = {r["part"]: r for r in ends if r["to_first"]}
    last = {r["part"]: r for r in ends if r["to_last"]}
    parts = sorted(first)
    sides: dict[tuple[int, int], list[set[int]]] = {}
    for side, order in ((0, parts), (1, parts[::-1])):
        known: set[int] = set()
        for near, part in zip(order, order[1:]):
            a, b = (last[near], first[part]) if side == 0 else (first[near], last[part])
            if a["hash"] != b["hash"]:
                known = set()
                continue
            step = _prefix(a["rest"] if side == 0 else a["main"], b["main"] if side == 0 else b["rest"])
            seen = {FAR, *(a["from_last"] if side == 0 else a["from_first"])}
            if a["to_first"] and a["to_last"]:  # the whole range is of this hash
                across = _prefix(a["main"], a["rest"])
                seen |= {min(across, k) for k in known}
            known = {min(step, k) for k in seen}
            sides.setdefault((part, b["hash"]), [set(), set()])[side] |= known
    return [(p, h, sorted(lefts), sorted(rights)) for (p, h), (lefts, rights) in sides.items()]


def _prefix(a: bytes, b: bytes) -> int:
    return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def _open_members(scanned: DataFrame) -> DataFrame | None:
    """The members of hashes that several ranges hold, with sizes: the bytes that each may share on the main side with contexts of other ranges.

    A context of another range shares min(to the end of this range, from there on) bytes with it, so a few lengths
    tell all. None if no hash is in several ranges.
    """
    spark = scanned.sparkSession
    beyond = _beyond(scanned.where(F.col("role") == ENDS).select("part", "hash", "main", "rest", "to_first", "to_last", "from_first", "from_last").collect())
    if not beyond:
        return None
    cut = spark.createDataFrame(beyond, "part int, hash long, lefts array<int>, rights array<int>")  # at most two for each range
    none = F.array().cast("array<int>")
    within = lambda to, lengths: F.when(F.col(to).isNotNull(), F.transform(lengths, lambda k: F.least(F.col(to), k))).otherwise(none)
    members = scanned.where(F.col("role") == MEMBER).join(F.broadcast(cut), ["part", "hash"])
    return members.withColumn("sizes", F.array_distinct(F.concat(within("to_first", "lefts"), within("to_last", "rights"))))


def _reaches(contexts: DataFrame, s: Settings) -> DataFrame:
    """hash, context, lo, hi: the bytes before and behind the anchor that are covered by strings which occur in another context.

    contexts: hash, context, before (last byte first), after; rows that repeat hash and context count once. Sorted
    by what follows the anchor, pairs within a range are found whole. Of pairs across ranges the bytes that they can share to the right are known,
    and so are the windows that can repeat. Hashes of several ranges are sorted once more, by what precedes the anchor, which
    leaves windows open likewise; it also tells the most that a context shares to the left with any other, which rules most windows out. Equal windows meet by hash.
    """
    reach = lambda df, lo, hi: df.where(F.col("role") == REACH).select("hash", "context", F.col(lo).alias("lo"), F.col(hi).alias("hi"))
    by_right = materialize(_scan(contexts.select("hash", "context", F.col("after").alias("main"), F.col("before").alias("rest")), s), "right-trees")
    found, read = reach(by_right, "rest_reach", "main_reach"), [by_right]
    if (members := _open_members(by_right)) is not None:
        turn = members.select("hash", "context", F.col("rest").alias("main"), F.col("main").alias("rest"), "sizes", "most", F.col("main_reach").alias("rest_reach"), F.col("rest_reach").alias("main_reach"))
        by_left = materialize(_scan(turn, s, turned=True), "left-trees")
        read.append(by_left)
        found = found.unionByName(reach(by_left, "main_reach", "rest_reach"))
        windows = by_left.where(F.col("role") == WINDOW).select("hash", "context", "size", "window", "asks")
        if (members := _open_members(by_left)) is not None:

            def name(hashes: list, contexts_: list, befores: list, afters: list, sizes: list, mosts: list, reaches: list, others: list) -> list:
                made, out = Windows(s.length), []
                for h, c, before, after, lefts, behind, covered_before, covered_after in zip(hashes, contexts_, befores, afters, sizes, mosts, reaches, others):
                    out += [(h, c, *w) for w in made.of(h, after, before, [s.length - k for k in lefts], behind, FAR, covered_after, covered_before)]
                return [list(c) for c in zip(*out)] or [[], [], [], [], []]

            asked = members.select("hash", "context", "main", "rest", "sizes", "most", "main_reach", "rest_reach")
            windows = windows.unionByName(map_columns(asked, name, "hash long, context long, size int, window long, asks boolean", rows=4096))
        windows = materialize(windows, "windows")
        read.append(windows)
        often = windows.groupBy(F.col("window").alias("again")).agg(F.min("context").alias("c0"), F.max("context").alias("c1")).where("c0 <> c1").select("again")
        told = windows.where("asks").join(often, F.col("window") == F.col("again"), "left_semi")
        found = found.unionByName(told.groupBy("hash", "context").agg((F.lit(s.length) - F.min("size")).alias("lo"), F.max("size").alias("hi")))
    best = materialize(found.groupBy("hash", "context").agg(F.max("lo").alias("lo"), F.max("hi").alias("hi")), "tree-reaches")
    discard(*read)
    return best


@dataclass
class Anchored:
    """source: doc, sum (hash of the text), data (bytes). dup: anchors whose hash repeats, mixed: with several contexts. kinds: of mixed ones the distinct contexts, n of each, and one
    anchor. contexts: their hash, context, before (last byte first) and after."""

    source: DataFrame
    dup: DataFrame
    kinds: DataFrame
    contexts: DataFrame


def _same_row() -> Column:
    return F.col("doc").eqNullSafe(F.col("d2")) & (F.col("sum") == F.col("s2"))


def _anchored(docs: DataFrame, id_col: str, text_col: str, s: Settings) -> Anchored:
    kind = docs.schema[id_col].dataType.simpleString()
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).alias("doc"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("sum"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("data"))

    def find(docs_: list, sums: list, datas: list) -> list:
        parts = [anchors(b, s) for b in datas]
        n = [len(p[0]) for p in parts]
        flat = lambda k: np.concatenate([p[k] for p in parts])
        pos, size = flat(0), np.repeat([len(b) for b in datas], n)
        return [[d for d, k in zip(docs_, n) for _ in range(k)], np.repeat(np.array(sums, np.int64), n), pos.astype(np.int32), np.minimum(pos, s.left).astype(np.int16),
                np.minimum(size - pos, s.length).astype(np.int16), flat(1).view(np.int64), flat(2).view(np.int64)]

    long_enough = source.where(F.octet_length("data") >= s.length)
    found = materialize(map_columns(long_enough, find, f"doc {kind}, sum long, pos int, left short, right short, hash long, context long", rows=256), "anchors")
    groups = found.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.min("context").alias("c0"), F.max("context").alias("c1")).where("n > 1")
    # Written, so that the join's partitions are free to split where one hash has many anchors.
    groups = materialize(groups.select("hash", (F.col("c0") != F.col("c1")).alias("mixed")), "repeated-hashes")
    dup = materialize(found.join(groups, "hash"), "repeated-anchors")
    discard(found, groups)
    release_shuffles(spark)
    kinds = materialize(dup.where("mixed").groupBy("hash", "context").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "sum", "pos", "left", "right")).alias("one")), "contexts")
    asked = kinds.select("one.doc", "one.sum", F.struct("hash", "context", "one.pos", "one.left", "one.right").alias("ask"))
    wanted = asked.groupBy("doc", "sum").agg(F.collect_list("ask").alias("asks"))  # no more than a document has anchors
    near = source.join(wanted.withColumnsRenamed({"doc": "d2", "sum": "s2"}), _same_row()).select("data", "asks")

    def cut(datas: list, asks: list) -> list:
        rows = [(a["hash"], a["context"], b[a["pos"] - a["left"]:a["pos"]][::-1], b[a["pos"]:a["pos"] + a["right"]]) for b, many in zip(datas, asks) for a in many]
        return [list(c) for c in zip(*rows)] or [[], [], [], []]

    contexts = materialize(map_columns(near, cut, "hash long, context long, before binary, after binary", rows=64), "context-bytes")
    release_shuffles(spark)
    return Anchored(source, dup, kinds, contexts)


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", s: Settings = Settings()) -> DataFrame:
    """doc, sum (hash of the text), spans (sorted [start, stop) of bytes that repeat) of each document that has any; and data, its bytes."""
    spark = docs.sparkSession
    a = _anchored(docs, id_col, text_col, s)
    source, dup, kinds, bytes_ = a.source, a.dup, a.kinds, a.contexts
    at = lambda lo, hi: F.struct((F.col("pos") - lo).alias("start"), (F.col("pos") + hi).alias("stop"))
    whole = F.col("left") + F.col("right") >= s.length
    pure = dup.where(~F.col("mixed") & whole).select("doc", "sum", at(F.col("left"), F.col("right")).alias("span"))
    mixed = dup.where("mixed")
    reach = _reaches(bytes_, s)
    often = kinds.where("n > 1").select("hash", "context", F.col("one.left").cast("int").alias("lo"), F.col("one.right").cast("int").alias("hi")).where(F.col("lo") + F.col("hi") >= s.length)
    best = materialize(reach.unionByName(often).groupBy("hash", "context").agg(F.max("lo").alias("lo"), F.max("hi").alias("hi")), "reaches")
    release_shuffles(spark)
    split = mixed.join(best, ["hash", "context"]).select("doc", "sum", at(F.col("lo"), F.col("hi")).alias("span"))
    spans = pure.unionByName(split).groupBy("doc", "sum").agg(F.sort_array(F.collect_set("span")).alias("spans"))  # no more than anchors
    spans = materialize(spans, "spans")
    discard(dup, kinds, bytes_, best)
    joined = source.join(spans.withColumnsRenamed({"doc": "d2", "sum": "s2"}), _same_row())
    return joined.select("doc", "sum", "spans", "data")


def _depths(rows: DataFrame, s: Settings) -> DataFrame:
    """hash, context and depths, the bytes that each of rows (hash, context, main, rest) shares on the main side with any other of its hash."""
    scanned = materialize(_scan(rows, s, depths=True), "depths")
    local = scanned.where(F.col("role") == REACH).select("hash", "context", F.explode_outer("from_first").alias("depth"))
    if (members := _open_members(scanned)) is not None:
        local = local.unionByName(members.select("hash", "context", F.explode("sizes").alias("depth")))
    return local.where("depth is not null").groupBy("hash", "context").agg(F.collect_set("depth").alias("depths"))  # at most `length`


def repeat_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", s: Settings = Settings()) -> DataFrame:
    """repeat (a hash of the string), n_bytes, doc, sum and start of every occurrence of each maximal repeat.

    A maximal repeat has two occurrences that differ in the byte before, and two in the byte behind. Those are returned of at least `length` bytes that lie within
    an anchor's context; of a longer one the overlapping parts that contexts show, each as a group. A string that ends where a
    context or text ends counts as different there.
    """
    a = _anchored(docs, id_col, text_col, s)
    right = _depths(a.contexts.select("hash", "context", F.col("after").alias("main"), F.col("before").alias("rest")), s).withColumnRenamed("depths", "rights")
    left = _depths(a.contexts.select("hash", "context", F.col("before").alias("main"), F.col("after").alias("rest")), s).withColumnRenamed("depths", "lefts")
    empty = F.array().cast("array<int>")
    known = (a.contexts.dropDuplicates(["hash", "context"]).join(a.kinds.select("hash", "context", "n"), ["hash", "context"]).join(right, ["hash", "context"], "left").join(left, ["hash", "context"], "left")
             .select("hash", "context", "n", "before", "after", F.coalesce("rights", empty).alias("rights"), F.coalesce("lefts", empty).alias("lefts")))

    def strings(hashes: list, contexts_: list, ns: list, befores: list, afters: list, rights: list, lefts: list) -> list:
        out = []
        for h, c, n, before, after, ahead, behind in zip(hashes, contexts_, ns, befores, afters, rights, lefts):
            # The anchor is one in all occurrences if it is one by a window inside the string; others are shown by other anchors.
            g = Hashes(np.frombuffer(before[::-1] + after, np.uint8)).of(*(np.arange(len(before) + len(after) - s.gram + 1) + k for k in (0, s.gram)))
            p = len(before)
            a, b = (int(np.argmax(np.r_[side < g[p], True])) for side in (g[:p][::-1], g[p + 1:]))
            ends = {(m, k) for k in ahead for m in behind if m + k >= s.length and min(m, a) + min(k - s.gram, b) >= s.left}
            if n > 1 and len(before) + len(after) >= s.length:  # the whole context repeats
                ends.add((len(before), len(after)))
            for m, k in ends:
                name = int.from_bytes(hashlib.blake2b(before[:m][::-1] + after[:k], digest_size=8).digest(), "little", signed=True)
                out.append((h, c, m, m + k, name, before[m] if m < len(before) else -1, after[k] if k < len(after) else -1))
        return [list(x) for x in zip(*out)] or [[] for _ in range(7)]

    made = materialize(map_columns(known, strings, "hash long, context long, m int, n_bytes int, repeat long, byte_before int, byte_behind int"), "repeat-strings")
    places = made.join(a.dup.where("mixed").select("hash", "context", "doc", "sum", "pos"), ["hash", "context"]).select(
        "repeat", "n_bytes", "doc", "sum", (F.col("pos") - F.col("m")).alias("start"), "byte_before", "byte_behind")
    whole = a.dup.where(~F.col("mixed") & (F.col("left") + F.col("right") >= s.length)).select(
        F.col("context").alias("repeat"), (F.col("left") + F.col("right")).cast("int").alias("n_bytes"), "doc", "sum", (F.col("pos") - F.col("left")).alias("start"), F.lit(-1).alias("byte_before"), F.lit(-1).alias("byte_behind"))
    # Anchors of one string show the same places.
    found = materialize(places.unionByName(whole).groupBy("repeat", "n_bytes", "doc", "sum", "start").agg(F.min("byte_before").alias("b0"), F.max("byte_before").alias("b1"), F.min("byte_behind").alias("e0"), F.max("byte_behind").alias("e1")), "repeat-places")
    diverse = lambda lo, hi: (F.min(lo) != F.max(hi)) | (F.min(lo) < 0)
    groups = found.groupBy("repeat", "n_bytes").agg(F.count(F.lit(1)).alias("n"), diverse("b0", "b1").alias("left"), diverse("e0", "e1").alias("right")).where("n > 1 and left and right").select("repeat", "n_bytes")
    return found.join(groups, ["repeat", "n_bytes"]).select("repeat", "n_bytes", F.col("doc").alias(id_col), "sum", "start")


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of sorted spans."""
    out: list[list[int]] = []
    for a, b in spans:
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _keep(data: bytes, runs: list[tuple[int, int]]) -> bytes:
    ends = [0, *[b for _, b in runs]]
    return b"".join(data[a:b] for a, b in zip(ends, [*[a for a, _ in runs], len(data)]))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", s: Settings = Settings()) -> DataFrame:
    """id, n_bytes, n_removed, n_spans and kept_sha256 for each row; see kept_bytes() for the bytes."""
    kind = docs.schema[id_col].dataType.simpleString()

    def drop(docs_: list, sums: list, spans: list, datas: list) -> list:
        out: list[list] = [docs_, sums, [], [], []]
        for found, data in zip(spans, datas):
            runs = merge([(x["start"], x["stop"]) for x in found])
            out[2].append(sum(b - a for a, b in runs))
            out[3].append(len(runs))
            out[4].append(hashlib.sha256(_keep(data, runs)).hexdigest())
        return out

    hit = map_columns(repeated_spans(docs, id_col, text_col, s), drop, f"d2 {kind}, s2 long, n_removed long, n_spans long, kept string", rows=128).dropDuplicates(["d2", "s2"])
    data = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    every = docs.select(F.col(id_col).alias("doc"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("sum"), F.octet_length(data).cast("long").alias("n_bytes"), F.sha2(data, 256).alias("all"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return every.join(hit, every["doc"].eqNullSafe(F.col("d2")) & (every["sum"] == F.col("s2")), "left").select(
        F.col("doc").alias(id_col), "n_bytes", zero("n_removed"), zero("n_spans"), F.coalesce("kept", "all").alias("kept_sha256"))


def kept_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", s: Settings = Settings()) -> DataFrame:
    """id and kept (bytes) of each document that loses any; the bytes may cut through a character."""
    kind = docs.schema[id_col].dataType.simpleString()
    cut = lambda ids, sums, spans, datas: [ids, [_keep(d, merge([(x["start"], x["stop"]) for x in f])) for f, d in zip(spans, datas)]]
    return map_columns(repeated_spans(docs, id_col, text_col, s), cut, f"`{id_col}` {kind}, kept binary", rows=128)


def op7_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes of 200-byte strings that start elsewhere too."""
    return remove_repeats(table(spark, sf_dir, "documents"))


# Windows are named by a polynomial hash modulo 2^61 - 1; pw has the powers of its base.
OP7_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS h FROM documents),
low AS (SELECT 0 AS i, 1::HUGEINT AS p UNION ALL SELECT i + 1, p * 1000003 % 2305843009213693951 FROM low WHERE i < 511),
high AS (SELECT 0 AS i, 1::HUGEINT AS p UNION ALL SELECT i + 1, p * (SELECT p * 1000003 % 2305843009213693951 FROM low WHERE i = 511) % 2305843009213693951 FROM high
  WHERE i < (SELECT max(len(h)) // 512 + 1 FROM d)),
pw AS (SELECT high.i * 512 + low.i AS i, high.p * low.p % 2305843009213693951 AS p FROM low, high),
top AS (SELECT max(len(h)) AS m FROM d),
b AS (SELECT rid, unnest(h) AS x, unnest(range(len(h))) AS i FROM d),
s AS (SELECT rid, i, x, coalesce(sum(('0x' || x)::INT::HUGEINT * p % 2305843009213693951) OVER w, 0) AS upto FROM b JOIN pw USING (i) WINDOW w AS (PARTITION BY rid ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT rid, i, x, upto, lead(upto, 199) OVER w AS edge, lead(i, 199) OVER w AS last, lead(('0x' || x)::INT, 199) OVER w AS final FROM s WINDOW w AS (PARTITION BY rid ORDER BY i)),
k AS (SELECT t.rid, t.i, x, CASE WHEN last IS NOT NULL THEN ((edge + final * e.p % 2305843009213693951 - upto) % 2305843009213693951) * back.p % 2305843009213693951 END AS hash
  FROM t CROSS JOIN top LEFT JOIN pw e ON e.i = t.last LEFT JOIN pw back ON back.i = m - t.i),
r AS (SELECT hash FROM k WHERE hash IS NOT NULL GROUP BY hash HAVING count(*) > 1),
g AS (SELECT rid, i, x, coalesce(max((r.hash IS NOT NULL)::INT) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN 199 PRECEDING AND CURRENT ROW), 0) AS gone FROM k LEFT JOIN r ON k.hash = r.hash),
f AS (SELECT *, coalesce(lag(gone) OVER (PARTITION BY rid ORDER BY i), 0) AS before FROM g),
a AS (SELECT rid, sum(gone) AS n_removed, sum((gone = 1 AND before = 0)::INT) AS n_spans, string_agg(x, '' ORDER BY i) FILTER (gone = 0) AS kept FROM f GROUP BY rid)
SELECT doc_id, len(h)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN a USING (rid)
"""
