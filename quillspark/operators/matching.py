"""Token-overlap matching, top-k retrieval and neighbor expansion."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions.text import content_tokens, tokenize
from quillspark.shipping import ship_package

SMALL = 50_000  # rows of a side that may be broadcast


def small(df: DataFrame, rows: int = SMALL) -> DataFrame:
    """df, to be broadcast if it is known to have no more than so many rows; else Spark joins by shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def overlaps(queries: DataFrame, goals: DataFrame, query_id: str, query_text: str, goal_id: str, goal_text: str, stopwords: bool = True) -> DataFrame:
    """query, goal, n_overlap (distinct common tokens) and n_goal (the goal's tokens, repeated ones too) of each pair that shares one.

    An equi-join on single tokens: no pair without a common token is ever made.
    """
    tokens = content_tokens if stopwords else tokenize
    g = goals.select(F.col(goal_id).alias("goal"), tokens(goal_text).alias("t")).select("goal", F.size("t").alias("n_goal"), F.explode(F.array_distinct("t")).alias("token"))
    q = queries.select(F.col(query_id).alias("query"), F.explode(F.array_distinct(tokens(query_text))).alias("token"))
    return q.join(small(g), "token").groupBy("query", "goal").agg(F.count(F.lit(1)).alias("n_overlap"), F.first("n_goal").alias("n_goal"))


def match_score(n_overlap: Column, n_goal: Column) -> Column:
    return n_overlap * 2 + n_overlap / n_goal


def is_match(n_overlap: Column, n_goal: Column) -> Column:
    """A quarter of the goal's tokens, or 0.34 of them where there are fewer than five."""
    return n_overlap / n_goal >= F.when(n_goal >= 5, F.lit(0.25)).otherwise(F.lit(0.34))


def best_match(queries: DataFrame, goals: DataFrame, query_id: str, query_text: str, goal_id: str, goal_text: str) -> DataFrame:
    """For each query with a match the goal of the highest score, the least goal id among equals: query, goal, n_overlap, score."""
    pairs = overlaps(queries, goals, query_id, query_text, goal_id, goal_text).where(is_match(F.col("n_overlap"), F.col("n_goal")))
    scored = pairs.withColumn("score", match_score(F.col("n_overlap"), F.col("n_goal")))
    # An aggregate of one struct combines on the map side; a window would have to sort all pairs. Ids of any type have a least one.
    best = F.min(F.struct(F.negate("score").alias("less"), "goal", "n_overlap", "score"))
    return scored.groupBy("query").agg(best.alias("b")).select("query", "b.goal", "b.n_overlap", "b.score")


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group, ranked from 1; Spark keeps k rows of each task before the exchange."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= k)


def search(queries: DataFrame, docs: DataFrame, query_id: str, query_text: str, doc_id: str, doc_text: str, k: int = 10) -> DataFrame:
    """For each query its k documents with the most common distinct tokens; the least id first among equals."""
    found = overlaps(docs, queries, doc_id, doc_text, query_id, query_text)
    return top_k(found.select(F.col("goal").alias("query"), F.col("query").alias("doc"), "n_overlap"), ["query"], [F.desc("n_overlap"), F.asc("doc")], k)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers, in double precision; null for a zero vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


TILE = 4_000_000  # pairs of vectors that a task compares at once


class _Nearest:
    """For a block of queries (an Arrow table of query and qv, in double precision) the k best of all chunks that are seen, in the order of their ids."""

    def __init__(self, block: pa.Table, k: int):
        self.k, self.ids = k, block["query"].combine_chunks()
        self.vectors = _by_size(block["qv"].combine_chunks())
        none = np.zeros(0, np.int64)
        self.kept, self.chunk, self.similarity = none, none, np.zeros(0)  # a query's place, its chunk's place in known, by query and rank
        self.known: pa.Array | None = None
        self.least = np.full(block.num_rows, -np.inf)  # the k-th best of each query

    def see(self, ids: pa.Array, vectors: pa.Array) -> None:
        found = [(self.kept, self.chunk, self.similarity)]
        first = 0 if self.known is None else len(self.known)
        for size, (rows, chunks) in _by_size(vectors).items():
            if size in self.vectors:
                at = np.sort(_first_copies(chunks, self.k))
                for q, c, s in self._better(*self.vectors[size], chunks[at]):
                    found.append((q, first + rows[at[c]], s))
        self.known = ids if self.known is None else pa.concat_arrays([self.known, ids])
        q, c, s = (np.concatenate(x) for x in zip(*found))
        # Places rise with ids, so they decide between equals; NaN is above all numbers, as in Spark.
        order = np.lexsort((c, -np.where(np.isnan(s), 0, s), ~np.isnan(s), q))
        q, c, s = q[order], c[order], s[order]
        begin = np.searchsorted(q, q)
        best = np.arange(len(q)) - begin < self.k
        self.kept, c, self.similarity = q[best], c[best], s[best]
        last = np.flatnonzero((np.arange(len(q)) - begin == self.k - 1))
        self.least[q[last]] = np.where(np.isnan(s[last]), np.inf, s[last])
        used, self.chunk = np.unique(c, return_inverse=True)
        self.known = self.known.take(pa.array(used))

    def _better(self, places: np.ndarray, queries: np.ndarray, chunks: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """place of the query, row of the chunk and cosine of all pairs that may be among a query's k best.

        A product in single precision leaves out pairs that are below k others by more than its error; what it leaves is
        decided in double precision. Vectors too long, too short or without a length for that are compared with all.
        """
        (q_unit, q_plain), (c_unit, c_plain) = _units(queries), _units(chunks)
        error = (queries.shape[1] + 16) * 2.0**-23
        odd = np.flatnonzero(~c_plain)
        step = max(1, TILE // max(1, len(chunks)))
        for begin in range(0, len(queries), step):
            mine = slice(begin, begin + step)
            near = q_unit[mine] @ c_unit.T
            least = self.least[places[mine]] - error
            if len(chunks) > self.k:
                many = np.flatnonzero((near >= least[:, None]).sum(1) > 4 * self.k)
                if len(many) and c_plain.sum() >= self.k:
                    kth = np.partition(np.where(c_plain, near[many], -2), len(chunks) - self.k, axis=1)[:, len(chunks) - self.k]
                    least[many] = np.maximum(least[many], kth - 2 * error)
            may = near >= least[:, None]
            may[:, odd] = True
            may[~q_plain[mine]] = True
            q, c = np.nonzero(may)
            for at in range(0, len(q), TILE // 8):
                some = slice(at, at + TILE // 8)
                s = _cosines(queries[begin + q[some]], chunks[c[some]])
                real = np.flatnonzero(~np.isneginf(s))
                yield places[begin + q[some][real]], c[some][real], s[real]

    def rows(self, most: int = 100_000) -> Iterator[tuple[pa.Array, pa.Array, pa.Array]]:
        for at in range(0, len(self.kept), most):
            some = slice(at, at + most)
            yield self.ids.take(pa.array(self.kept[some])), self.known.take(pa.array(self.chunk[some])), pa.array(self.similarity[some])


def _by_size(vectors: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By their size: places and vectors, without nulls, empty ones and those that have nulls."""
    flat = vectors.flatten()  # null vectors have no items here
    sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    begin = np.cumsum(sizes) - sizes
    missing = np.r_[0, np.cumsum(flat.is_null().to_numpy(zero_copy_only=False))]
    whole = (sizes > 0) & (missing[begin + sizes] == missing[begin])
    numbers = flat.fill_null(0).to_numpy(zero_copy_only=False).astype(float) + 0.0  # no minus zero
    out = {}
    for size in np.unique(sizes[whole]).tolist():
        rows = np.flatnonzero(whole & (sizes == size))
        out[size] = rows, numbers[begin[rows][:, None] + np.arange(size)]
    return out


def _first_copies(vectors: np.ndarray, k: int) -> np.ndarray:
    """Rows without those that have k equal ones before them, in any order; more may stay."""
    bits = vectors.view(np.uint64)
    mixed = bits @ (np.arange(1, bits.shape[1] + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1))
    order = np.argsort(mixed, kind="stable")
    if (np.diff(mixed[order]) != 0).all():
        return order
    new = np.r_[True, (bits[order[1:]] != bits[order[:-1]]).any(1)]
    begin = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    return order[np.arange(len(order)) - begin < k]


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The rows' products, added up from first to last, so that equal rows have equal ones."""
    out = np.zeros(len(a))
    with np.errstate(all="ignore"):
        for i in range(a.shape[1]):
            out += a[:, i] * b[:, i]
    return out


def _units(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of length one, in single precision, and whether there is one; else it is zero."""
    square = _dots(vectors, vectors)
    plain = (square > 1e-150) & (square < 1e150)
    with np.errstate(all="ignore"):
        return np.where(plain[:, None], vectors / np.sqrt(square)[:, None], 0).astype(np.float32), plain


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each two rows; minus infinity where either is a zero vector."""
    norm = np.sqrt(_dots(a, a)) * np.sqrt(_dots(b, b))
    with np.errstate(all="ignore"):
        return np.where(norm == 0, -np.inf, _dots(a, b) / norm)


def nearest(queries: DataFrame, chunks: DataFrame, query_id: str, query_vec: str, chunk_id: str, vec: str, k: int = 3, where: Column | None = None) -> DataFrame:
    """For each query its k chunks of the highest cosine, the least id first among equals: query, chunk, similarity, rank.

    Cosines are in double precision; a pair with a zero vector, a null in a vector or different sizes has none. A stated set of queries meets all
    chunks in blocks of about SMALL queries, one pass over the chunks for each, as products of matrices; predicates on chunks come first.
    """
    rows = (chunks if where is None else chunks.where(where)).select(F.col(chunk_id).alias("chunk"), F.col(vec).cast("array<double>").alias("cv"))
    q = queries.select(F.col(query_id).alias("query"), F.col(query_vec).cast("array<double>").alias("qv"))
    spark = queries.sparkSession
    ship_package(spark)
    schema = T.StructType([T.StructField("query", q.schema["query"].dataType), T.StructField("chunk", rows.schema["chunk"].dataType), T.StructField("similarity", T.DoubleType())])
    blocks = -(-q.count() // SMALL) or 1
    found = None
    for i in range(blocks):
        block = q if blocks == 1 else q.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == i)
        shared = spark.sparkContext.broadcast(block.toArrow())  # about SMALL rows

        def run(batches: Iterator[pa.RecordBatch], shared: Broadcast = shared) -> Iterator[pa.RecordBatch]:
            best = _Nearest(shared.value, k)
            for batch in batches:
                if batch.num_rows and len(best.ids):
                    best.see(batch.column(0), batch.column(1))
            for columns in best.rows():
                yield pa.RecordBatch.from_arrays(list(columns), names=["query", "chunk", "similarity"])

        # Sorted, so that a task knows the order of ids of any type by place.
        hits = top_k(rows.sortWithinPartitions("chunk").mapInArrow(run, schema), ["query"], [F.desc("similarity"), F.asc("chunk")], k)
        found = hits if found is None else found.unionByName(hits)
    return found


def prior_filter(source_ids: list[str] | None = None, chapter: str | None = None, section_prefix: str | None = None, keywords: list[str] | None = None,
                 source: str = "source_id", chapter_col: str = "chapter", section: str = "section", text: str = "text") -> Column:
    """Chunks of the given sources and chapter, whose section is the prefix or below it, and whose text has any keyword; what isn't given holds for all."""
    tests = [F.lit(True)]
    if source_ids:
        tests.append(F.col(source).isin(*source_ids))
    if chapter:
        tests.append(F.col(chapter_col) == chapter)
    if section_prefix:
        tests.append((F.col(section) == section_prefix) | F.col(section).startswith(section_prefix.rstrip(".") + "."))
    if keywords:
        tests.append(F.exists(F.array(*[F.lit(k.lower()) for k in keywords]), lambda k: F.contains(F.lower(F.col(text)), k)))
    out = tests[0]
    for t in tests[1:]:
        out = out & F.coalesce(t, F.lit(False))
    return out


def prior_search(queries: DataFrame, chunks: DataFrame, query_id: str, query_vec: str, top_k_: int = 3, expand: bool = False, as_json: bool = False, **filters) -> DataFrame:
    """query and answer: the nearest prior chunks(chunk_id, source_id, pos, chapter, section, text, embedding) as text for a prompt or as JSON.

    With expand each hit's text has those of the chunks before and behind it in its source. A query without hits has no row.
    """
    hits = nearest(queries, chunks, query_id, query_vec, "chunk_id", "embedding", top_k_, prior_filter(**filters))
    known = chunks.select(F.col("chunk_id").alias("chunk"), "source_id", "pos", "chapter", "section", "text")
    rows = hits.join(known, "chunk")
    if expand:
        near = known.select(F.col("source_id").alias("_source"), F.col("pos").alias("seq"), F.col("text").alias("_text"))
        asked = rows.withColumn("seq", F.explode(F.sequence(F.col("pos") - 1, F.col("pos") + 1)))
        beside = asked.join(near, (asked["source_id"] == near["_source"]) & (asked["seq"] == near["seq"])).drop(near["seq"])
        rows = beside.groupBy("query", "rank", "chunk", "similarity", "source_id", "chapter", "section").agg(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "_text"))), lambda x: x["_text"]), "\n").alias("text"))  # three at most
    if as_json:
        one = F.struct("rank", F.to_json(F.struct("source_id", "chapter", "section", "text")).alias("line"))
        wrap = lambda x: F.concat(F.lit("["), F.array_join(x, ","), F.lit("]"))
    else:
        one = F.struct("rank", F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.col("source_id"), F.lit(" "), F.coalesce("section", F.lit("")), F.lit("\n"), F.col("text")).alias("line"))
        wrap = lambda x: F.array_join(x, "\n\n")
    return rows.groupBy("query").agg(wrap(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["line"])).alias("answer"))  # top_k_ at most


def expand_context(hits: DataFrame, chunks: DataFrame, hit_cols: tuple[str, str], chunk_cols: tuple[str, str], width: int = 1) -> DataFrame:
    """hits with every chunk of the same source at most `width` places away, themselves included, as column `seq`.

    The adjacency becomes an equi-join on the places that each hit asks for.
    """
    source, place = hit_cols
    asked = hits.withColumn("seq", F.explode(F.sequence(F.col(place) - width, F.col(place) + width)))
    there = chunks.select(F.col(chunk_cols[0]).alias("_source"), F.col(chunk_cols[1]).alias("seq")).distinct()
    return asked.join(there, (asked[source] == there["_source"]) & (asked["seq"] == there["seq"])).drop(there["seq"]).drop("_source")


def take_until_bytes(df: DataFrame, by: list[str], order: list[Column], size: Column, cap: int) -> DataFrame:
    """Rows of each group until the sum of sizes reaches the cap; the row that crosses it is the last."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("before", F.coalesce(F.sum(size).over(w), F.lit(0))).where(F.col("before") < cap)
