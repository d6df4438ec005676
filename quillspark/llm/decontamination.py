"""Benchmark decontamination by a positional inverted index: native DataFrame operations only.

The words of all documents are counted. Every window of ten words of a benchmark item picks its rarest
words by those counts, `lists` of them, and the positions of the picked words in all documents are written as
postings, with the words around each. A window's candidates are where the postings of its rarest word,
moved back by the word's offset, meet those of the second, and those the next one's if there are more lists; what remains is compared word by word with
the window, so matches are exact. Two lists leave next to nothing to compare in vain, and each further one is of words that are more frequent by far. proximity_matches() asks the same postings for windows whose two rarest
words stand within any distance of each other, in any order.

Only tables that grow with the benchmark, not with the documents, are broadcast, and only up to
`broadcast_rows`; beyond, Spark joins them by shuffle.

Edge cases: null and empty texts have no words; an item without words has no window, one of fewer than
ten words is one window; repeated rows and ids are results of their own, keyed by id and text; a null
item id counts as the empty text; words that tie in count are picked by their text; very long texts are split whole, a row at a
time; empty tables give empty results, or no hits; other columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm.common import ascii_lower, fresh, materialize, table

BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # what stands between words
WINDOW = 10


def words_of(text_col: str) -> Column:
    """Words as they are written. Splitting costs a tenth of what extracting matches does."""
    return F.array_remove(F.split(F.coalesce(F.col(text_col), F.lit("")), BETWEEN), "")


def key_of(word: Column | str) -> Column:
    """A hash that is equal for words that differ in case alone; candidates meet by it, matches are compared as text."""
    return F.xxhash64(F.lower(word))


def item_windows(benchmark: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """item, window (its words joined) and terms (its words) of every window."""
    n = F.size("w")
    starts = F.sequence(F.lit(1), F.greatest(n - F.lit(width - 1), F.lit(1)))
    return (
        benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), words_of(text_col).alias("w")).where(n > 0)
        .withColumn("terms", F.explode(F.transform(starts, lambda s: F.slice("w", s, F.least(F.lit(width), F.size("w"))))))
        .withColumn("terms", F.transform("terms", ascii_lower)).select("item", F.array_join("terms", " ").alias("window"), "terms")
    )


def _small(df: DataFrame, rows: int) -> DataFrame:
    """df, to be broadcast if it is known to have no more than so many rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


class PositionalIndex:
    """Postings of the benchmark windows' rarest words in docs.

    windows: window, terms. picks: window, rank (1: rarest, at most `lists`), key (of the word), offset (from 0). postings: doc, sum
    (hash of the text), key, pos (from 0), around (words from `width - 1` before to as many after), lead (words before).
    """

    def __init__(self, docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_id_col: str = "item_id", item_text_col: str = "text", width: int = WINDOW, broadcast_rows: int = 200_000, lists: int = 2):
        self.rows, self.width, self.lists = broadcast_rows, width, lists
        self.items = materialize(item_windows(benchmark, item_id_col, item_text_col, width), "benchmark-windows")
        self.windows = self.items.select("window", "terms").distinct()
        self.docs = docs.select(F.col(id_col).alias("doc"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("sum"), words_of(text_col).alias("w"))
        keys = self.windows.select(F.explode("terms").alias("term")).select(key_of("term").alias("key")).distinct()
        # The outer form keeps Spark from splitting each text once more for a test that it has words.
        counts = self.docs.select(F.explode_outer("w").alias("term")).select(key_of("term").alias("key")).join(_small(keys, broadcast_rows), "key", "left_semi").groupBy("key").count()
        placed = self.windows.select("window", F.posexplode("terms").alias("offset", "term")).withColumn("key", key_of("term")).join(counts, "key", "left")
        rarest = Window.partitionBy("window").orderBy(F.coalesce("count", F.lit(0)), "term", "offset")
        self.picks = materialize(placed.withColumn("rank", F.row_number().over(rarest)).where(F.col("rank") <= lists).select("window", "rank", "key", "offset"), "benchmark-picks")
        picked = self.picks.select("key").distinct()
        near = width - 1
        found = (
            self.docs.select("doc", "sum", "w", F.posexplode_outer("w").alias("pos", "term")).withColumn("key", key_of("term")).join(_small(picked, broadcast_rows), "key", "left_semi")
            .where("pos is not null").withColumn("lead", F.least(F.col("pos"), F.lit(near)))
            .select("doc", "sum", "key", "pos", "lead", F.slice("w", F.col("pos") - F.col("lead") + 1, F.col("lead") + F.lit(width)).alias("around"))
        )
        self.postings = materialize(found, "postings")

    def _starts(self, rank: int, *more: str) -> DataFrame:
        """Where each window would start, by the postings of its word of that rank."""
        picks = self.picks.where(F.col("rank") == rank).select("window", "key", "offset")
        return (
            self.postings.join(_small(picks, self.rows), "key").withColumn("start", F.col("pos") - F.col("offset")).where("start >= 0")
            .select("doc", "sum", "window", "start", "offset", *more)
        )

    def phrase_matches(self) -> DataFrame:
        """doc, sum, window, start and length (in words) of each exact occurrence, once."""
        found = self._starts(1, "around", "lead")
        columns = found.columns
        for rank in range(2, self.lists + 1):
            there = self._starts(rank).select("doc", "sum", "window", "start")
            met = found.join(there, [found["doc"].eqNullSafe(there["doc"]), found["sum"] == there["sum"], found["window"] == there["window"], found["start"] == there["start"]], "left_semi")
            # Windows of fewer words have no such list to meet.
            short = _small(self.windows.where(F.size("terms") < rank).select("window"), self.rows)
            found = met.unionByName(found.join(short, "window", "left_semi").select(*columns))
        slice_ = F.slice("around", F.col("lead") - F.col("offset") + 1, F.size(F.split("window", " ")))
        same = (F.col("lead") >= F.col("offset")) & (ascii_lower(F.array_join(F.when(F.col("lead") >= F.col("offset"), slice_), " ")) == F.col("window"))
        return found.where(same).select("doc", "sum", "window", "start", F.size(F.split("window", " ")).alias("length")).distinct()

    def proximity_matches(self, within: int = WINDOW) -> DataFrame:
        """doc, sum, window, pos: the window's rarest word stands at pos, its second, another word of the text, at most `within` words away.

        Positions meet by stretches of within + 1 words, so that a word that a text repeats everywhere meets its neighbours alone.
        """
        def places(rank: int) -> DataFrame:
            picks = self.picks.where(F.col("rank") == rank).select("window", "key")
            return self.postings.join(_small(picks, self.rows), "key").select("doc", "sum", "window", "pos", F.floor(F.col("pos") / F.lit(within + 1)).alias("stretch"))

        first = places(1).withColumn("stretch", F.explode(F.sequence(F.col("stretch") - 1, F.col("stretch") + 1)))
        second = places(2).select("doc", "sum", "window", F.col("pos").alias("other"), "stretch")
        near = [first["doc"].eqNullSafe(second["doc"]), *[first[c] == second[c] for c in ("sum", "window", "stretch")], F.abs(first["pos"] - second["other"]).between(1, within)]
        return first.join(second, near, "left_semi").select("doc", "sum", "window", "pos").distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WINDOW,
                  item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """id, n_words, n_hit, n_items, items_sha256 and contaminated for each row of docs."""
    index = PositionalIndex(docs, benchmark, id_col, text_col, item_id_col, item_text_col, width)
    hits = materialize(index.phrase_matches(), "phrase-matches")
    covered = (
        hits.select("doc", "sum", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("length") - 1)).alias("pos")).distinct()
        .groupBy("doc", "sum").agg(F.count(F.lit(1)).alias("n_hit"))
    )
    items = index.items.select("window", "item").distinct()
    named = (
        hits.select("doc", "sum", "window").distinct().join(_small(items, index.rows), "window").select("doc", "sum", "item").distinct()
        .groupBy("doc", "sum").agg(F.count(F.lit(1)).alias("n_items"), F.array_join(F.sort_array(F.collect_list("item")), ",").alias("names"))
    )
    found = covered.join(named, [covered["doc"].eqNullSafe(named["doc"]), covered["sum"] == named["sum"]]).select(
        covered["doc"].alias("hit_doc"), covered["sum"].alias("hit_sum"), "n_hit", "n_items", "names")
    every = index.docs.select("doc", "sum", F.size("w").cast("long").alias("n_words"))
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return every.join(found, every["doc"].eqNullSafe(F.col("hit_doc")) & (every["sum"] == F.col("hit_sum")), "left").select(
        F.col("doc").alias(id_col), "n_words", count("n_hit"), count("n_items"),
        F.sha2(F.coalesce("names", F.lit("")), 256).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WINDOW) -> DataFrame:
    """The rows of docs, all columns kept, without any exact occurrence of a benchmark window."""
    index = PositionalIndex(docs, benchmark, id_col, text_col, width=width)
    doc, sum_ = fresh(docs, "_hit_doc", "_hit_sum")
    found = materialize(index.phrase_matches().select(F.col("doc").alias(doc), F.col("sum").alias(sum_)).distinct(), "contaminated")
    same = docs[id_col].eqNullSafe(F.col(doc)) & (F.xxhash64(F.coalesce(docs[text_col], F.lit(""))) == F.col(sum_))
    return docs.join(_small(found, index.rows), same, "left_anti")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact benchmark windows in all documents."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP8_SQL = r"""
WITH dw AS (
  SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bs AS (SELECT item, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 8, 2))) AS s FROM bw WHERE len(w) > 0),
win AS (SELECT DISTINCT item, n, array_to_string(list_slice(w, s, s + n - 1), ' ') AS k FROM bs),
lens AS (SELECT DISTINCT n FROM win),
ds AS (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM dw JOIN lens ON len(w) >= n),
dk AS (SELECT rid, n, s, array_to_string(list_slice(w, s, s + n - 1), ' ') AS k FROM ds),
hit AS (SELECT rid, s, dk.n, item FROM dk JOIN win ON dk.k = win.k AND dk.n = win.n),
pos AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(s, s + n)) AS p FROM hit) GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT rid, item FROM hit) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM dw LEFT JOIN pos USING (rid) LEFT JOIN its USING (rid)
"""
