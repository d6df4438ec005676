"""Hierarchical Pitman-Yor language model with sampled Chinese-restaurant seating.

A word follows a context: the word before it, or a text's start, which is what follows an end. Each of the `common` most frequent
words is a context restaurant of its own; all others share `classes` restaurants by hash. Context restaurants share one parent, the
restaurant of words without context, whose base is uniform over the words seen in training and one more for all others. An
end is a word too.

Seating is sampled by Gibbs. A sweep takes the customers of every cell (a word in a context), all of them and in random order, removes each from its table and seats it
anew given all others: at a table by its size less the discount, or at a new one by what the parent predicts. A table that opens or
closes sends a customer to the parent or takes one from it, and the parent's own customers are then moved alike. Cells of all words move at once,
given the restaurants' totals and the parent as the sweep before left them. A cell of one customer has one table and needs no
move. Each sweep after the first `burn_in` gives a sample, and predictions are averaged over samples. Random numbers are hashes of
word, context, sweep and step, so neither the partitions nor a lost executor change a score.

Texts are turned into word numbers once, a slice of rows at a time. Words are dealt into buckets; a frequent word's cells are dealt
by context too, as its parent's seats are kept by the driver, which has tasks sweep them. All that a sweep shares is one vector over contexts and frequent
words, which is summed in chunks. What is learned covers all training rows, stays distributed and grows with the corpus: a row
for each bucket, and a bucket has about `bucket_tokens` tokens at most.

Edge cases: a null or empty text is one end; a very long text is a slice of its own; with no training row every word has the base's probability; words that tie for the
last place among the common ones are left out together; repeated rows count and are scored each; a null id hashes as the empty text; an empty table
gives an empty result; other columns are not read, and one of keep that is named like an added column is replaced.
"""

from __future__ import annotations

import contextlib
import ctypes
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quillspark.llm.common import discard, fold, fresh, materialize, materialized_parts, release_shuffles, table, with_fields, without
from quillspark.shipping import ship_package

END = b""  # no word of a text is empty


@dataclass(frozen=True)
class Settings:
    """common, classes: contexts of their own, and shared ones; sweeps: Gibbs sweeps, of which the first burn_in give no sample; moves: the most customers of a
    cell that one sweep seats anew, drawn at random, None for all; strength: concentration of every restaurant; slice_rows, slice_tokens,
    bucket_tokens: about how much is worked on together."""

    common: int = 1 << 18
    classes: int = 4096
    sweeps: int = 4
    burn_in: int = 1
    moves: int | None = None
    strength: float = 1.0
    slice_rows: int = 2048
    slice_tokens: int = 1_000_000
    bucket_tokens: int = 4_000_000
    chunk: int = 4096
    seed: int = 3


# Arrays as bytes


_CODEC: list[pa.Codec] = []


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers, their bytes ordered by place in the number, and compressed."""
    if not _CODEC:
        _CODEC.append(pa.Codec("zstd", compression_level=1))
    head, body = [len(arrays)], []
    for a in arrays:
        raw = np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.dtype.itemsize).T).tobytes()
        data = _CODEC[0].compress(raw, asbytes=True)
        head += [ord(a.dtype.kind), a.dtype.itemsize, len(raw), len(data)]
        body.append(data)
    return np.array(head, np.int64).tobytes() + b"".join(body)


def unpack(data: bytes) -> list[np.ndarray]:
    if not _CODEC:
        _CODEC.append(pa.Codec("zstd", compression_level=1))
    n = int(np.frombuffer(data, np.int64, 1)[0])
    head = np.frombuffer(data, np.int64, 1 + 4 * n)[1:].reshape(n, 4)
    out, at = [], 8 * (1 + 4 * n)
    for kind, size, raw, packed in head.tolist():
        planes = np.frombuffer(_CODEC[0].decompress(data[at:at + packed], raw, asbytes=True) if raw else b"", np.uint8).reshape(size, -1)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(np.dtype(f"{chr(kind)}{size}")))
        at += packed
    return out


def narrow(a: np.ndarray) -> np.ndarray:
    """The numbers, none negative, in as few bytes as hold them."""
    most = int(a.max(initial=0))
    return a.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32 if most < 1 << 32 else np.uint64)


def gaps(a: np.ndarray) -> np.ndarray:
    """The steps from each number to the next, falling ones too, in as few bytes as hold them: short for numbers that rise slowly."""
    step = np.diff(a.astype(np.int64), prepend=0)
    return narrow((step << 1) ^ (step >> 63))


def ungap(steps: np.ndarray) -> np.ndarray:
    d = steps.astype(np.int64)
    return np.cumsum((d >> 1) ^ -(d & 1))


# Words as numbers


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def keys_of(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word; distinct words are taken to differ in it."""
    sizes = np.array([len(w) + 1 for w in words])
    data = np.frombuffer(b"\0".join(words) + b"\0", np.uint8).astype(np.uint64)
    starts = np.cumsum(sizes) - sizes
    place = (np.arange(len(data)) - np.repeat(starts, sizes)).astype(np.uint64)
    return _mix(np.add.reduceat(_mix(data * np.uint64(0x9E3779B97F4A7C15) + place), starts)).view(np.int64)


def read(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the distinct words (the end's first), each token's index in them, ends included, and the tokens of each text."""
    index: dict[bytes, int] = {END: 0}
    ids: list[int] = []
    sizes = []
    number = index.setdefault
    for text in texts:
        before = len(ids)
        if text:  # bytes know no white space and no letters but ASCII's
            ids += [number(w, len(index)) for w in text.encode().lower().split()]
        ids.append(0)
        sizes.append(len(ids) - before)
    return keys_of(list(index)), np.array(ids, np.int32), np.array(sizes, np.int32)


@dataclass
class Contexts:
    """keys: of the common words, the most frequent first; counts: theirs in training, then each class's."""

    keys: np.ndarray
    counts: np.ndarray
    classes: int

    def __post_init__(self) -> None:
        self.order = np.argsort(self.keys)
        self.sorted = self.keys[self.order]

    def __len__(self) -> int:
        return len(self.keys) + self.classes

    def rank(self, keys: np.ndarray) -> np.ndarray:
        """Place among the common words, or -1."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int64)
        at = np.minimum(np.searchsorted(self.sorted, keys), len(self.keys) - 1)
        return np.where(self.sorted[at] == keys, self.order[at], -1)

    def of(self, keys: np.ndarray) -> np.ndarray:
        rank = self.rank(keys)
        return np.where(rank >= 0, rank, len(self.keys) + np.mod(keys, self.classes))


# Seating


def _salted(*salt: int) -> np.uint64:
    x = np.uint64(0)
    with np.errstate(over="ignore"):
        for s in salt:
            x = _mix(np.array([x ^ np.uint64(s + 1)], np.uint64) * np.uint64(0x9E3779B97F4A7C15))[0]
    return x


def _draw(names: np.ndarray, x: np.uint64) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (_mix(_mix(names ^ x) + x) >> np.uint64(11)) * 2.0**-53


def uniform(names: np.ndarray, *salt: int) -> np.ndarray:
    """A number in [0, 1) for each name, by hash."""
    return _draw(names, _salted(*salt))


def grow(customers: np.ndarray, pull: np.ndarray, discount: float, names: np.ndarray, *salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Tables of each cell and their sizes, one cell's after the other's, to begin with.

    Customers sit down one by one, from eight on an eighth as many at a time; sizes follow the power law of the discount.
    """
    tables = (customers > 0).astype(np.int64)
    seated, step, left = 1, 0, np.flatnonzero(customers > 1)
    while len(left):
        block = max(1, seated // 8)
        n = np.minimum(block, customers[left] - seated)
        p = np.clip(pull[left] / (pull[left] + seated - discount * tables[left]), 0, 1)
        expected = n * p
        u = uniform(names[left], *salt, step)
        opened = np.where(block == 1, u < p, np.minimum(n, np.floor(expected + u)))
        tables[left] += opened.astype(np.int64)
        seated += block
        step += 1
        left = left[customers[left] > seated]
    owner = np.repeat(np.arange(len(tables)), tables)
    first = np.cumsum(tables) - tables
    weight = (np.arange(len(owner)) - first[owner] + 1.0) ** (-1 / max(discount, 0.05))
    total = np.bincount(owner, weight, len(tables))
    sizes = 1 + np.floor((customers - tables)[owner] * weight / total[owner]).astype(np.int64)
    rest = customers - np.bincount(owner, sizes, len(tables)).astype(np.int64)
    sizes[first[tables > 0]] += rest[tables > 0]
    return tables, sizes


class Seating:
    """Tables of many cells in one array, with room for so many more in each."""

    def __init__(self, tables: np.ndarray, sizes: np.ndarray, room: np.ndarray):
        cap = tables + np.maximum(room, 1)
        self.end = np.cumsum(cap)
        self.start = self.end - cap
        self.flat = np.zeros(int(cap.sum()) + 1, np.int64)
        first = np.cumsum(tables) - tables
        owner = np.repeat(np.arange(len(tables)), tables)
        self.flat[self.start[owner] + np.arange(len(sizes)) - first[owner]] = sizes
        self.tables = tables.copy()
        self.customers = np.bincount(owner, sizes, len(tables)).astype(np.int64)

    def _before(self, cum: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.where(self.start[at] > 0, cum[self.start[at] - 1], 0)

    def remove(self, at: np.ndarray, u: np.ndarray) -> None:
        """One customer of each cell of at leaves, each as likely as another."""
        slot = self.start[at].copy()
        several = np.flatnonzero(self.flat[slot] < self.customers[at])
        if len(several):
            a = at[several]
            cum = np.cumsum(self.flat)
            slot[several] = np.searchsorted(cum, self._before(cum, a) + np.floor(u[several] * self.customers[a]).astype(np.int64), side="right")
        self.flat[slot] -= 1
        self.customers[at] -= 1
        self.tables[at] -= self.flat[slot] == 0

    def add(self, at: np.ndarray, u: np.ndarray, pull: np.ndarray, discount: float) -> None:
        """One customer more for each cell of at: a new table by pull, or one that is there by its size less the discount."""
        old = self.customers[at] - discount * self.tables[at]
        draw = u * (pull + old)
        opens = (draw < pull) | (self.customers[at] == 0)
        slot = self.start[at].copy()
        alone = (self.flat[slot] == self.customers[at]) & (self.customers[at] > 0)
        slot[alone & opens] += 1
        seek = np.flatnonzero(~alone & ~opens)
        if len(seek):
            a = at[seek]
            cum = np.cumsum(self.flat - discount * (self.flat > 0))
            slot[seek] = np.searchsorted(cum, self._before(cum, a) + (draw - pull)[seek], side="right")
            lost = (slot[seek] >= self.end[a]) | (self.flat[slot[seek]] == 0)  # by rounding
            if lost.any():
                ends = np.cumsum(self.flat > 0)
                slot[seek[lost]] = np.searchsorted(ends, self._before(ends, a[lost]) + 1)
        new = np.flatnonzero(~alone & opens)
        if len(new):
            free = np.cumsum(self.flat == 0)
            slot[new] = np.searchsorted(free, self._before(free, at[new]) + 1)
        self.flat[slot] += 1
        self.customers[at] += 1
        self.tables[at] += opens

    def sizes(self) -> np.ndarray:
        return self.flat[self.flat > 0]


def _pick(tables: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The sizes of the cells of at."""
    n = tables[at]
    ends = np.cumsum(n)
    first = np.cumsum(tables) - tables
    return sizes[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first[at] - (ends - n), n)]


def _put(tables: np.ndarray, sizes: np.ndarray, at: np.ndarray, new_tables: np.ndarray, new_sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """tables and sizes with those of the cells of at replaced."""
    stays = np.ones(len(tables), bool)
    stays[at] = False
    out = tables.copy()
    out[at] = new_tables
    mine = np.repeat(~stays, out)
    all_sizes = np.empty(len(mine), np.int64)
    all_sizes[mine] = new_sizes
    all_sizes[~mine] = sizes[np.repeat(stays, tables)]
    return out, all_sizes


def _change(tables: np.ndarray, sizes: np.ndarray, change: np.ndarray, pull: np.ndarray, discount: float, names: np.ndarray, salt: tuple[int, ...], done: int = 0, steps: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Customers join (change > 0) or leave, one by one; cells with many to go are taken out and go on by themselves."""
    s = Seating(tables, sizes, np.clip(change, 0, steps))
    for k in range(min(steps, int(np.abs(change).max(initial=0)))):
        joins, leaves = np.flatnonzero(change > k), np.flatnonzero(-change > k)
        s.add(joins, uniform(names[joins], *salt, done + k, 0), pull[joins], discount)
        s.remove(leaves, uniform(names[leaves], *salt, done + k, 1))
    tables, sizes = s.tables, s.sizes()
    at = np.flatnonzero(np.abs(change) > steps)
    if not len(at):
        return tables, sizes
    rest = change[at] - np.sign(change[at]) * steps
    return _put(tables, sizes, at, *_change(tables[at], _pick(tables, sizes, at), rest, pull[at], discount, names[at], salt, done + steps, 2 * steps))


TOGETHER = 4_000_000  # customers that are reseated together, or a cell's if it has more
FEW = 300  # cells from which on an array of all is faster than each by itself
GOLDEN = 0x9E3779B97F4A7C15
AHEAD = 1 << 16  # moves of one cell for which numbers are drawn together


def _reseat(tables: np.ndarray, sizes: np.ndarray, pull: np.ndarray, discount: float, names: np.ndarray, moves: int | None, salt: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """The customers of each cell, all or `moves` of them, leave in random order, and each is seated anew before the next one leaves.

    Whoever sits down follows any other customer, each as likely as another, to that one's table of n with probability 1 - discount / n, and
    else draws again, also whether to open a table: that is the law by sizes less the discount, without adding up a cell's tables.
    """
    owner = np.repeat(np.arange(len(tables)), tables)
    customers = np.bincount(owner, sizes, len(tables)).astype(np.int64)
    start, first = np.cumsum(customers) - customers, np.cumsum(tables) - tables
    slots = start[owner] + np.arange(len(owner)) - first[owner]  # a cell has room for as many tables as customers
    seats = np.repeat(slots, sizes).astype(np.int32)  # by customer
    n = np.zeros(len(seats), np.int32)  # by slot
    n[slots] = sizes
    free = np.arange(len(seats), dtype=np.int32)  # of each cell, from the place that its number of tables gives
    order = np.argsort(-customers, kind="stable")
    o, c, t, pulls, keys = start[order], customers[order], tables[order].copy(), pull[order], names[order]
    limit = np.where(c > 1, c if moves is None else np.minimum(c, moves), 0)  # a sole customer has one table
    salts = [_salted(*salt, i) for i in range(2, 8)]
    salt_of = lambda i: salts[i] if i < len(salts) else _salted(*salt, i + 2)
    k, m = 0, int((limit > 0).sum())
    while m >= FEW:
        at, many, drawn = o[:m], c[:m], _mix(keys[:m] + np.uint64(k * GOLDEN % 2**64))
        who = at + k + (_draw(drawn, salts[0]) * (many - k)).astype(np.int64)
        left = seats[who]
        seats[who] = seats[at + k]
        n[left] -= 1
        closed = np.flatnonzero(n[left] == 0)
        t[closed] -= 1
        free[at[closed] + t[closed]] = left[closed]
        to = np.full(m, -1, np.int64)
        todo, i = np.arange(m), 1
        while len(todo):
            v = _draw(drawn[todo], salt_of(i)) * (pulls[todo] + (many[todo] - 1)) - pulls[todo]
            other = np.clip(np.floor(v), 0, many[todo] - 2).astype(np.int64)
            table = seats[at[todo] + other + (other >= k)]
            follows = (v >= 0) & (v - other >= discount / np.maximum(n[table], 1))
            to[todo[follows]] = table[follows]
            todo, i = todo[(v >= 0) & ~follows], i + 1
        opens = np.flatnonzero(to < 0)
        to[opens] = free[at[opens] + t[opens]]
        t[opens] += 1
        n[to] += 1
        seats[at + k] = to
        k += 1
        m = int(np.searchsorted(-limit, -k, side="left"))
    for x in range(m):
        mine = slice(o[x], o[x] + c[x])
        t[x] = _reseat_one(seats[mine] - o[x], n[mine], free[o[x] + t[x]:o[x] + c[x]] - o[x], int(t[x]), float(pulls[x]), discount, keys[x], k, int(limit[x]), salt_of)
    tables = np.empty_like(t)
    tables[order] = t
    return tables, n[n > 0].astype(np.int64)


def _reseat_one(seats: np.ndarray, n_: np.ndarray, free_: np.ndarray, t: int, pull: float, discount: float, key: np.uint64, begin: int, end: int, salt_of: Callable[[int], np.uint64]) -> int:
    """Moves begin to end of one cell, as _reseat() makes them; n_ is changed, and the number of tables is returned."""
    c, n, seat, free = len(seats), n_.tolist(), seats.tolist(), free_[::-1].tolist()
    for low in range(begin, end, AHEAD):
        drawn = _mix(key + np.arange(low, min(end, low + AHEAD), dtype=np.uint64) * np.uint64(GOLDEN))
        tries = [_draw(drawn, salt_of(i)).tolist() for i in range(3)]
        for k, u, v in zip(range(low, end), tries[0], tries[1]):
            who = k + int(u * (c - k))
            left = seat[who]
            seat[who] = seat[k]
            n[left] -= 1
            if not n[left]:
                free.append(left)
                t -= 1
            i = 1
            while True:
                v = v * (pull + (c - 1)) - pull
                if v < 0:
                    to = free.pop()
                    t += 1
                    break
                other = min(int(v), c - 2)
                to = seat[other + (other >= k)]
                if v - other >= discount / n[to]:
                    break
                i += 1
                v = tries[2][k - low] if i == 2 else float(_draw(drawn[k - low:k - low + 1], salt_of(i))[0])
            n[to] += 1
            seat[k] = to
    n_[:] = n
    return t


def sweep_cells(tables: np.ndarray, sizes: np.ndarray, wanted: np.ndarray, pull: np.ndarray, discount: float, names: np.ndarray, moves: int | None, *salt: int) -> tuple[np.ndarray, np.ndarray]:
    """One sweep over cells: customers join or leave until there are `wanted`, and all of each cell, or up to `moves`, are seated anew."""
    owner = np.repeat(np.arange(len(tables)), tables)
    change = wanted - np.bincount(owner, sizes, len(tables)).astype(np.int64)
    tables, sizes = _change(tables, sizes, change, pull, discount, names, salt)
    ends = np.r_[0, np.flatnonzero(np.diff((np.cumsum(wanted) - wanted) // TOGETHER)) + 1, len(tables)]
    places = np.r_[0, np.cumsum(tables)]
    done = [_reseat(tables[a:b], sizes[places[a]:places[b]], pull[a:b], discount, names[a:b], moves, salt) for a, b in zip(ends, ends[1:])]
    return tuple(np.concatenate(x) for x in zip(*done))


# What all words share


@dataclass
class Shared:
    """types: words in training and one more; tables: by context; top_customers, top_tables: the parent's, in all; common: the parent's
    prediction for each common word."""

    types: int
    discount: float
    top_discount: float
    strength: float
    tables: np.ndarray
    top_customers: int
    top_tables: int
    common: np.ndarray

    @property
    def top_pull(self) -> float:
        return (self.strength + self.top_discount * self.top_tables) / self.types

    def parent(self, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        return (np.maximum(customers - self.top_discount * tables, 0) + self.top_pull) / (self.strength + self.top_customers)


@dataclass
class Bucket:
    """A bucket's words and cells, by word and context. keys: of the rare words; rank: among the common words, or -1, rare words first; count: in training."""

    keys: np.ndarray
    rank: np.ndarray
    word: np.ndarray
    context: np.ndarray
    count: np.ndarray

    @classmethod
    def unpack(cls, data: bytes) -> Bucket:
        keys, ranks, word, context, count = unpack(data)
        return cls(keys, np.r_[np.full(len(keys), -1), ungap(ranks)], ungap(word), ungap(context), count.astype(np.int64))

    def pack(self) -> bytes:
        return pack(self.keys, gaps(self.rank[len(self.keys):]), gaps(self.word), gaps(self.context), narrow(self.count))

    def word_keys(self, contexts: Contexts) -> np.ndarray:
        return np.r_[self.keys, contexts.keys[self.rank[len(self.keys):]]]

    def by_word(self, which: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(self.word[which], None if weight is None else weight, len(self.rank)).astype(np.int64)

    def judge(self, samples: list[Shared], seats: list[tuple[np.ndarray, np.ndarray]], contexts: Contexts) -> np.ndarray:
        """log10 of each cell's averaged prediction. seats: for each sample the tables of cells of two customers and more, and of each word in the parent."""
        many = self.count > 1
        c_u = contexts.counts[self.context]
        out = np.zeros(len(self.word))
        for st, (tables, top) in zip(samples, seats):
            t = (self.count > 0).astype(np.int64)
            t[many] = tables
            p = np.where(self.rank >= 0, 0.0, st.parent(np.bincount(self.word, t, len(self.rank)), top))
            if len(st.common):
                p = np.where(self.rank >= 0, st.common[self.rank], p)
            out += (np.maximum(self.count - st.discount * t, 0) + (st.strength + st.discount * st.tables[self.context]) * p[self.word]) / (st.strength + c_u)
        return np.log10(np.maximum(out / len(samples), 1e-300))


# Steps on Spark


def _give_back() -> None:
    """Return what arrays have left free to the system; a worker would keep it for its next task."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def _map(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[list]], schema: str | T.StructType) -> DataFrame:
    """run gets batches and gives lists of columns."""
    kind = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    arrow = to_arrow_schema(kind)
    ship_package(df.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in run(batches):
            _give_back()
            yield pa.RecordBatch.from_arrays([c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)
        _give_back()

    return df.mapInArrow(each, kind)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for at in range(batch.num_rows):
            yield tuple(c[at].as_py() for c in batch.columns)


@dataclass
class Slices:
    """rows: slice, rows (the columns of keep, as structs) and data (tokens of each text). tokens: slice, data (word keys, tokens, tokens of each text, whether it is learned
    from), which training reads and deletes. kept: keep's columns."""

    rows: DataFrame
    tokens: DataFrame
    kept: DataFrame


def slice_texts(docs: DataFrame, learn: Column, keep: list[str | Column], text_col: str, s: Settings) -> Slices:
    """The texts as word numbers, a slice of rows at a time."""
    kept = without(docs.select(*keep), *ADDED)
    rows = docs.select(F.struct(*[F.col(c) if isinstance(c, str) else c for c in keep]).alias("row"), F.coalesce(learn, F.lit(False)).alias("learn"), F.col(text_col).alias("text"))
    rows = rows.select(F.struct(*[F.col("row")[c].alias(c) for c in kept.columns], F.lit(0).alias(fresh(kept, "none")[0])).alias("row"), "learn", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            begin = 0
            while begin < batch.num_rows:
                part = batch.slice(begin, s.slice_rows)
                sizes = np.cumsum(pc.binary_length(part.column(2)).fill_null(0).to_numpy(zero_copy_only=False))
                part = part.slice(0, max(1, int((sizes <= 6 * s.slice_tokens).sum())))  # bytes: a token has about six
                keys, tokens, lengths = read(part.column(2).to_pylist())
                learns = part.column(1).to_numpy(zero_copy_only=False).astype(np.uint8)
                held = pa.ListArray.from_arrays(pa.array([0, part.num_rows, part.num_rows], pa.int32()), part.column(0))
                yield [[number, number], held, [pack(narrow(lengths)), pack(keys, narrow(tokens), narrow(lengths), learns)], ["rows", "tokens"]]
                number += 1
                begin += part.num_rows

    schema = T.StructType([T.StructField("slice", T.LongType()), T.StructField("rows", T.ArrayType(rows.schema["row"].dataType)), T.StructField("data", T.BinaryType()), T.StructField("part", T.StringType())])
    path = materialized_parts(_map(rows, run, schema), "slices", "part")
    table_of = lambda part: docs.sparkSession.read.schema(T.StructType(schema.fields[:3])).parquet(f"{path}/part={part}")
    if docs.sparkSession.read.schema(schema).parquet(path).isEmpty():
        none = docs.sparkSession.createDataFrame([], T.StructType(schema.fields[:3]))
        return Slices(none, none.select("slice", "data"), kept)
    return Slices(table_of("rows"), table_of("tokens").select("slice", "data"), kept)


def count_words(tokens_: DataFrame) -> DataFrame:
    """key and c of each word in training."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for (data,) in _rows(batches):
            keys, tokens, lengths, learns = unpack(data)
            n = np.bincount(tokens[np.repeat(learns, lengths) > 0], minlength=len(keys))
            yield [pa.array(keys[n > 0]), pa.array(n[n > 0])]

    return materialize(_map(tokens_.select("data"), run, "key long, n long").groupBy("key").agg(F.sum("n").alias("c")), "word-counts")


def common_contexts(counts: DataFrame, s: Settings) -> Contexts:
    """The most frequent words, at most s.common, found by a histogram of counts; sorting would bring every task's candidates to one."""
    size = F.floor(F.log("c") * F.lit(50.0)).cast("int")
    room, least = s.common, 2**31 - 1
    for r in sorted(counts.groupBy(size.alias("size")).count().collect(), reverse=True):  # some hundred rows
        room -= r["count"]
        if room < 0:
            break
        least = r["size"]
    top = counts.where(size >= least).toArrow()  # at most s.common rows
    keys, n = top["key"].to_numpy().astype(np.int64), top["c"].to_numpy().astype(np.int64)
    order = np.lexsort((keys, -n))
    other = np.zeros(s.classes, np.int64)
    for r in counts.where(size < least).groupBy(F.pmod("key", F.lit(s.classes)).alias("class")).agg(F.sum("c").alias("c")).collect():  # one for each class
        other[r["class"]] = r["c"]
    return Contexts(keys[order], np.r_[n[order], other], s.classes)


def deal(tokens_: DataFrame, contexts: Contexts, buckets: int) -> DataFrame:
    """bucket, slice, data: what a slice has of each bucket's cells, and each cell's postings: a row of the slice, how often, and whether it is learned from."""
    shared = tokens_.sparkSession.sparkContext.broadcast(contexts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        known: Contexts = shared.value
        for number, data in _rows(batches):
            keys, tokens, lengths, learns = unpack(data)
            rows = len(lengths)
            context = known.of(keys)[np.r_[0, tokens[:-1]]]  # a text's end stands before the next text, as before the first
            code = (tokens.astype(np.int64) * len(known) + context) * rows + np.repeat(np.arange(rows), lengths)
            code, times = np.unique(code, return_counts=True)
            cell, row = code // rows, code % rows
            rank = known.rank(keys)
            word = cell // len(known)
            split = np.where(rank[word] >= 0, _mix((cell % len(known)).astype(np.uint64) + np.uint64(1)), np.uint64(0))
            to = (_mix(keys[word].view(np.uint64) + split) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            ends = np.searchsorted(to[order], np.arange(buckets + 1))
            out: list[list] = [[], [], []]
            for b in np.flatnonzero(np.diff(ends)):
                at = order[ends[b]:ends[b + 1]]
                cells, many = np.unique(cell[at], return_counts=True)  # rising, as the postings are
                mine, index = np.unique(cells // len(known), return_inverse=True)
                rare = rank[mine] < 0
                common = np.argsort(rank[mine[~rare]])
                place = np.empty(len(mine), np.int64)  # rare words first, then common ones by rank
                place[rare] = np.arange(rare.sum())
                place[np.flatnonzero(~rare)[common]] = rare.sum() + np.arange(len(common))
                out[0].append(int(b))
                out[1].append(number)
                out[2].append(pack(keys[mine[rare]], gaps(rank[mine[~rare]][common]), gaps(place[index]), gaps(cells % len(known)), narrow(many - 1), narrow(row[at]), narrow(times[at] - 1), learns[row[at]]))
            yield out

    return _map(tokens_.select("slice", "data"), run, "bucket int, slice long, data binary")


STATE = "bucket int, slices array<long>, cells binary, postings binary, state binary, chunk int, sums binary"


class Sums:
    """A vector of whole numbers over contexts, common words and a few more places, handed on in chunks."""

    def __init__(self, contexts: Contexts, s: Settings, kinds: int = 1, more: int = 8):
        self.width, self.chunk = len(contexts) + len(contexts.keys) + more, s.chunk
        self.n = len(contexts)
        self.at = np.zeros((kinds, self.width), np.int64)

    def add(self, kind: int, b: Bucket, cells: np.ndarray, weight: np.ndarray | None = None) -> None:
        """The cells' weights by context, and by word for common ones."""
        self.at[kind] += np.bincount(b.context[cells], weight, self.width).astype(np.int64)
        here = b.rank[b.word[cells]]
        ok = here >= 0
        self.at[kind] += np.bincount(self.n + here[ok], None if weight is None else weight[ok], self.width).astype(np.int64)

    def rows(self) -> Iterator[tuple]:
        flat = self.at.ravel()
        for i in range(0, len(flat), self.chunk):
            if flat[i:i + self.chunk].any():
                yield None, None, None, None, None, i // self.chunk, pack(flat[i:i + self.chunk])

    def gather(self, made: DataFrame) -> np.ndarray:
        """The sum of all tasks' vectors; a task adds one chunk's rows up, and the driver gets one vector."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
            now, total = None, None
            for chunk, data in _rows(batches):
                if chunk != now:
                    if now is not None:
                        yield [[now], [pack(total)]]
                    now, total = chunk, 0
                total = total + unpack(data)[0]
            if now is not None:
                yield [[now], [pack(total)]]

        parts = made.where("chunk is not null").select("chunk", "sums").repartition("chunk").sortWithinPartitions("chunk")
        out = np.zeros(self.at.size, np.int64)
        for r in _map(parts, run, "chunk int, sums binary").collect():
            part = unpack(bytes(r["sums"]))[0]
            out[r["chunk"] * self.chunk:r["chunk"] * self.chunk + len(part)] = part
        return out.reshape(self.at.shape)


def _columns(rows: list[tuple]) -> list[list]:
    return [list(c) for c in zip(*rows)]


# Places of a vector behind contexts and common words.
STILL_CUSTOMERS, STILL_TABLES, RARE_CUSTOMERS, RARE_TABLES, CELLS_ONCE, CELLS_TWICE, WORDS_ONCE, WORDS_TWICE = range(-8, 0)
# Kinds of vectors that gather_cells() sums: cells of one customer, and of more.
SINGLE, SEVERAL = 0, 1


def gather_cells(dealt: DataFrame, contexts: Contexts, parts: int, s: Settings) -> DataFrame:
    """Rows of STATE: for each bucket its cells, postings and first state, and the tasks' vectors."""
    shared = dealt.sparkSession.sparkContext.broadcast(contexts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        known: Contexts = shared.value
        sums = Sums(known, s, 2)

        def close(bucket: int, slices: list[int], held: list[list[np.ndarray]]) -> list:
            keys, ranks = np.unique(np.concatenate([p[0] for p in held])), np.unique(np.concatenate([ungap(p[1]) for p in held]))
            cells = [np.r_[np.searchsorted(keys, p[0]), len(keys) + np.searchsorted(ranks, ungap(p[1]))][ungap(p[2])] * len(known) + ungap(p[3]) for p in held]
            every = np.concatenate([np.repeat(c, p[4].astype(np.int64) + 1) for c, p in zip(cells, held)])
            join = lambda k: np.concatenate([p[k].astype(np.int64) for p in held])
            row, times, learns = join(5), join(6) + 1, join(7)
            cell, place = np.unique(every, return_inverse=True)
            count = np.bincount(place, times * learns, len(cell)).astype(np.int64)
            b = Bucket(keys, np.r_[np.full(len(keys), -1), ranks], cell // len(known), cell % len(known), count)
            once, several = np.flatnonzero(count == 1), np.flatnonzero(count > 1)
            sums.add(SINGLE, b, once)
            sums.add(SEVERAL, b, several)
            types = np.where(b.rank >= 0, 0, b.by_word(count > 0))  # of rare words, all of whose cells are here
            sums.at[0, CELLS_ONCE] += len(once)
            sums.at[0, CELLS_TWICE] += int((count == 2).sum())
            sums.at[0, WORDS_ONCE] += int((types == 1).sum())
            sums.at[0, WORDS_TWICE] += int((types == 2).sum())
            sums.at[0, RARE_CUSTOMERS] += int(types.sum())
            sums.at[0, RARE_TABLES] += int((types > 0).sum())
            # Rare words whose parent has one customer, once and for all, are in no state.
            still = (types == 1) & (b.by_word(several) == 0)
            sums.at[0, STILL_CUSTOMERS] += int(still.sum())
            sums.at[0, STILL_TABLES] += int(still.sum())
            sizes = np.array([len(p[5]) for p in held])
            # In the order of cells within each slice, so that places rise.
            order = np.lexsort((row, place, np.repeat(np.arange(len(held)), sizes)))
            # The state: cells of several customers, rare words whose parent has or may get several.
            moving = np.flatnonzero((b.rank < 0) & ((types > 1) | (b.by_word(several) > 0)))
            state = pack(gaps(b.word[several]), gaps(b.context[several]), narrow(count[several]), gaps(b.rank[b.word[several]]),
                         gaps(moving), keys[moving], narrow(b.by_word(once)[moving]),
                         np.ones(len(several), np.uint8), narrow(count[several]), np.ones(len(moving), np.uint8), narrow(types[moving]))
            return [[bucket], [slices], [b.pack()], [pack(gaps(place[order]), sizes, narrow(row[order]), narrow(times[order] - 1))], [state], [None], [None]]

        now, slices, held = None, [], []
        for bucket, number, data in _rows(batches):
            if bucket != now:
                if held:
                    yield close(now, slices, held)
                now, slices, held = bucket, [], []
            slices.append(number)
            held.append(unpack(data))
        if held:
            yield close(now, slices, held)
        if made := list(sums.rows()):
            yield _columns(made)

    return materialize(_map(dealt.repartition(parts, "bucket").sortWithinPartitions("bucket", "slice"), run, STATE), "cells")


def sweep(states: DataFrame, before: Shared, contexts: Contexts, s: Settings, number: int) -> DataFrame:
    """Rows of STATE: each bucket's state after one sweep, and the tasks' vectors of tables. A state keeps the tables of each sample."""
    spark = states.sparkSession
    shared, places = spark.sparkContext.broadcast(before), spark.sparkContext.broadcast(contexts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        st, known = shared.value, places.value
        sums = Sums(known, s)
        for bucket, state in _rows(batches):
            fixed = unpack(state)
            word, context, count, rank, moving, top_keys, single, tables, sizes, top, top_sizes, *old = fixed
            word, context, rank, moving = (ungap(x) for x in (word, context, rank, moving))
            count, tables, sizes, top, top_sizes, single = (x.astype(np.int64) for x in (count, tables, sizes, top, top_sizes, single))
            place = np.searchsorted(moving, word)  # of a rare word's cell, among the words whose parent moves
            mine = rank < 0
            customers = lambda t: single + np.bincount(place[mine], t[mine], len(moving)).astype(np.int64)
            p = np.empty(len(word))
            p[mine] = st.parent(customers(tables), top)[place[mine]]
            p[~mine] = st.common[rank[~mine]] if len(st.common) else 0
            pull = (st.strength + st.discount * st.tables[context]) * p
            keys = np.empty(len(word), np.int64)
            keys[mine], keys[~mine] = top_keys[place[mine]], known.keys[rank[~mine]]
            names = _mix(keys.view(np.uint64) ^ _mix(context.astype(np.uint64) + np.uint64(s.seed)))
            if number == 0:
                tables, sizes = grow(count, pull, st.discount, names, s.seed, 100)
            tables, sizes = sweep_cells(tables, sizes, count, pull, st.discount, names, s.moves, s.seed, number, 0)
            wanted = customers(tables)
            top_pull, top_names = np.full(len(moving), st.top_pull), _mix(top_keys.view(np.uint64) + np.uint64(s.seed))
            if number == 0:
                top, top_sizes = grow(wanted, top_pull, st.top_discount, top_names, s.seed, 101)
            top, top_sizes = sweep_cells(top, top_sizes, wanted, top_pull, st.top_discount, top_names, s.moves, s.seed, number, 1)
            b = Bucket(np.zeros(0, np.int64), rank, np.arange(len(word)), context, count)
            sums.add(0, b, np.arange(len(word)), tables)
            sums.at[0, RARE_CUSTOMERS] += int(wanted.sum())
            sums.at[0, RARE_TABLES] += int(top.sum())
            kept = [*old, narrow(tables), narrow(top)] if number >= s.burn_in else old
            yield [[bucket], [None], [None], [None], [pack(*fixed[:7], narrow(tables), narrow(sizes), narrow(top), narrow(top_sizes), *kept)], [None], [None]]
        if made := list(sums.rows()):
            yield _columns(made)

    return materialize(_map(states.where("bucket is not null").select("bucket", "state"), run, STATE), "sweep")


def sweep_common(spark: SparkSession, tables: np.ndarray, sizes: np.ndarray, wanted: np.ndarray, st: Shared, names: np.ndarray, s: Settings, number: int) -> tuple[np.ndarray, np.ndarray]:
    """sweep_cells() of the parent for the common words, whose customers grow with the corpus: some of the words in each task."""
    if not len(wanted):
        return tables, sizes
    ends = np.r_[0, np.flatnonzero(np.diff((np.cumsum(wanted) - wanted) // max(1, s.bucket_tokens // 4))) + 1, len(wanted)]
    places = np.r_[0, np.cumsum(tables)]
    rows = [(i, bytearray(pack(narrow(tables[a:b]), narrow(sizes[places[a]:places[b]]), narrow(wanted[a:b]), names[a:b]))) for i, (a, b) in enumerate(zip(ends, ends[1:]))]
    pull, discount, moves, seed = st.top_pull, st.top_discount, s.moves, s.seed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for part, data in _rows(batches):
            t, n, w, keys = unpack(data)
            t, n = sweep_cells(t.astype(np.int64), n.astype(np.int64), w.astype(np.int64), np.full(len(t), pull), discount, keys, moves, seed, number, 1)
            yield [[part], [pack(narrow(t), narrow(n))]]

    given = spark.createDataFrame(spark.sparkContext.parallelize(rows, len(rows)), "part int, data binary")
    done = [unpack(bytes(r["data"])) for r in sorted(_map(given, run, "part int, data binary").collect())]  # tables of the common words
    return tuple(np.concatenate([x[i] for x in done]).astype(np.int64) for i in range(2))


ADDED = ("n_tokens", "n_known", "train_tokens", "base_score", "score")


@dataclass
class Trained:
    """cells: bucket, slices, cells, postings and state (with the samples' tables); samples: what words share in each; tokens, types: of the training rows."""

    cells: DataFrame
    contexts: Contexts
    samples: list[Shared]
    tokens: int
    types: int


def _discount(once: int, twice: int) -> float:
    return min(0.95, max(0.05, once / max(1, once + 2 * twice)))


def train(slices: Slices, s: Settings = Settings()) -> Trained:
    """Learn from the slices' rows; the cells are those of all rows. The slices' tokens are deleted."""
    spark = slices.rows.sparkSession
    counts = count_words(slices.tokens)
    row = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    contexts = common_contexts(counts, s)
    discard(counts)
    release_shuffles(spark)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), row["n"] // (4 * s.bucket_tokens))
    made = gather_cells(deal(slices.tokens, contexts, 4 * parts), contexts, parts, s)
    discard(slices.tokens)
    first = Sums(contexts, s, 2).gather(made)
    release_shuffles(spark)
    n, k = len(contexts), len(contexts.keys)
    singles, several = first
    top_types = singles[n:n + k] + several[n:n + k]
    once, twice = (int((top_types == x).sum()) for x in (1, 2))
    shared = Shared(row["v"] + 1, _discount(int(singles[CELLS_ONCE]), int(singles[CELLS_TWICE])), _discount(int(singles[WORDS_ONCE]) + once, int(singles[WORDS_TWICE]) + twice), s.strength,
                    singles[:n] + several[:n], int(top_types.sum() + singles[RARE_CUSTOMERS]), int((top_types > 0).sum() + singles[RARE_TABLES]), np.zeros(0))
    tables, sizes = (top_types > 0).astype(np.int64), top_types[top_types > 0]
    shared.common = shared.parent(top_types, tables)
    names = _mix(contexts.keys.view(np.uint64) + np.uint64(s.seed))
    samples, states = [], made
    for number in range(s.sweeps):
        after = sweep(states, shared, contexts, s, number)
        if states is not made:
            discard(states)
        states = after
        vector = Sums(contexts, s).gather(states)[0]
        wanted = singles[n:n + k] + vector[n:n + k]
        pull = np.full(k, shared.top_pull)
        if number == 0:
            tables, sizes = grow(wanted, pull, shared.top_discount, names, s.seed, 101)
        tables, sizes = sweep_common(spark, tables, sizes, wanted, shared, names, s, number)
        shared = Shared(shared.types, shared.discount, shared.top_discount, s.strength, singles[:n] + vector[:n],
                        int(wanted.sum() + vector[RARE_CUSTOMERS] + singles[STILL_CUSTOMERS]), int(tables.sum() + vector[RARE_TABLES] + singles[STILL_TABLES]), np.zeros(0))
        shared.common = shared.parent(wanted, tables)
        if number >= s.burn_in:
            samples.append(shared)
    release_shuffles(spark)
    fixed = made.where("bucket is not null").select("bucket", "slices", "cells", "postings").repartition(parts, "bucket")
    cells = fixed.join(states.where("bucket is not null").select("bucket", "state").repartition(parts, "bucket"), "bucket")
    return Trained(cells, contexts, samples, int(row["n"]), int(row["v"]))


def _judged(batches: Iterator[pa.RecordBatch], trained: tuple, s: Settings) -> Iterator[tuple]:
    """For each bucket (slices, cells, postings, state): slices, postings, its Bucket, log10 of each cell, count in training of each word."""
    contexts, samples, _, _ = trained
    for slices, cells, postings, state in _rows(batches):
        b = Bucket.unpack(cells)
        parts = unpack(state)
        moving, kept = ungap(parts[4]), parts[11:]
        fixed = np.where(b.rank < 0, b.by_word(b.count > 0), 0)
        seats = []
        for tables, top in zip(kept[::2], kept[1::2]):
            every = fixed.copy()
            every[moving] = top
            seats.append((tables.astype(np.int64), every))
        count = b.by_word(np.arange(len(b.word)), b.count)
        common = b.rank >= 0
        count[common] = contexts.counts[b.rank[common]]
        place, sizes, row, times = unpack(postings)
        yield slices, (ungap(place), np.r_[0, np.cumsum(sizes)], row, times.astype(np.int64) + 1), b, b.judge(samples, seats, contexts), count


def _shared_model(trained: Trained):
    return trained.cells.sparkSession.sparkContext.broadcast((trained.contexts, trained.samples, trained.tokens, trained.types))


def cell_scores(trained: Trained, s: Settings = Settings()) -> DataFrame:
    """key (of the word), context, n (in training), logp (log10) of each pair of neighbours in any row."""
    shared = _shared_model(trained)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for _, _, b, logp, _ in _judged(batches, shared.value, s):
            yield [pa.array(b.word_keys(shared.value[0])[b.word]), pa.array(b.context), pa.array(b.count), pa.array(logp)]

    return _map(trained.cells.select("slices", "cells", "postings", "state"), run, "key long, context long, n long, logp double")


def score(slices: Slices, trained: Trained, s: Settings = Settings()) -> DataFrame:
    """The columns of keep, then n_tokens, n_known, train_tokens, base_score and score (log10); slices are those given to train()."""
    shared = _shared_model(trained)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        _, _, n, v = shared.value
        floor = math.log10(n + 0.5 * (v + 1))
        held: dict[int, list[tuple]] = {}
        size = 0

        def flush() -> list:
            out: list[list] = [[], []]
            for number, parts in held.items():
                rows, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                total = lambda k: np.bincount(at, np.concatenate([p[k] for p in parts]), len(rows))
                out[0].append(number)
                out[1].append(pack(narrow(rows), narrow(total(1).astype(np.int64)), total(2), total(3)))
            return out

        for slices_, (place, ends, row, times), b, logp, count in _judged(batches, shared.value, s):
            base = np.log10(count + 0.5) - floor
            for i, number in enumerate(slices_):
                cell, k = place[ends[i]:ends[i + 1]], times[ends[i]:ends[i + 1]].astype(float)
                rows, at = np.unique(row[ends[i]:ends[i + 1]], return_inverse=True)
                word = b.word[cell]
                held.setdefault(number, []).append((rows.astype(np.int64), np.bincount(at, k * (count[word] > 0)), np.bincount(at, k * base[word]), np.bincount(at, k * logp[cell])))
                size += len(rows)
            if size > 1_000_000:
                yield flush()
                held, size = {}, 0
        if held:
            yield flush()

    rows_type, kept = slices.rows.schema["rows"].dataType, slices.kept
    sums = _map(trained.cells.select("slices", "cells", "postings", "state"), judge, "slice long, data binary")
    parts = sums.select("slice", F.lit(None).cast(rows_type).alias("rows"), "data", F.lit(1).alias("kind")).unionByName(slices.rows.select("slice", "rows", "data", F.lit(0).alias("kind")))
    spread = parts.repartition("slice").sortWithinPartitions("slice", "kind").select("kind", "rows", "data")
    tokens, width = trained.tokens, len(kept.columns)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        now = None

        def close() -> list:
            rows, lengths, known, base, logp = now
            return [*rows.flatten()[:width], pa.array(lengths.astype(np.int64)), pa.array(known), pa.array(np.full(len(lengths), tokens)), pa.array(base), pa.array(logp)]

        for batch in batches:
            for i in range(batch.num_rows):
                parts = unpack(batch.column(2)[i].as_py())
                if batch.column(0)[i].as_py() == 0:
                    if now is not None:
                        yield close()
                    lengths, = parts
                    now = (batch.column(1).slice(i, 1).flatten(), lengths, np.zeros(len(lengths), np.int64), np.zeros(len(lengths)), np.zeros(len(lengths)))
                else:
                    for total, part in zip(now[2:], parts[1:]):
                        total[parts[0]] += part.astype(total.dtype)
        if now is not None:
            yield close()

    return _map(spread, finish, with_fields(kept, "n_tokens long, n_known long, train_tokens long, base_score double, score double"))


def train_and_score(docs: DataFrame, learn: Column, keep: list[str | Column], text_col: str = "text", s: Settings = Settings()) -> DataFrame:
    """The columns of keep, n_tokens, n_known, train_tokens, base_score and score of each row, learned from the rows where learn holds."""
    slices = slice_texts(docs, learn, keep, text_col, s)
    return score(slices, train(slices, s), s)


def perplexity(scored: DataFrame) -> DataFrame:
    """perplexity by token, over all rows of a scored frame."""
    return scored.agg(F.pow(F.lit(10.0), -F.sum("score") / F.sum("n_tokens")).alias("perplexity"))


def op10_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document, learned from those outside the held-out fifth."""
    docs, held_out = table(spark, sf_dir, "documents"), fold("doc_id", 5) == 1
    return train_and_score(docs, ~held_out, ["doc_id", held_out.alias("held_out")])
