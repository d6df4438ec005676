"""Language identification by interpolated Kneser-Ney character models.

One model of order 4 for each language, all kept in arrays sorted by hash: for every n-gram that any
language has seen, the array holds each language's interpolated log probability, and for every context
each language's back-off weight. A text goes to the language with the lowest cross-entropy per
character. The rejection limit is calibrated on rows that the counts never saw: a text is rejected if
its cross-entropy lies further above its language's than that of any calibration text, with a margin.

The models learn from a bounded sample of the distinct labelled texts (`per_language`, by hash of the text) and are
small; every row is then predicted from its whole text alone.

Edge cases: a null text and a text without letters give `und`, score 0, and are rejected; with no
learned language everything is `und`; repeated rows give repeated results; ties go to the first
language in alphabetical order; an empty table gives an empty result; very long texts are read whole, in blocks of symbols; columns other
than text and label are not read, and one that is kept and named like an added column is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import fold, fresh, map_columns, materialize, table, with_fields, without

ORDER = 4
UNKNOWN = "und"
BITS = [np.uint64(16 * n) for n in range(ORDER + 1)]


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Code point to the symbol of its lower-case letter (16 bits), 0 for all that is no letter."""
    out = np.zeros(0x110000, np.uint16)
    for cp in range(0x110000):
        c = chr(cp)
        if c.isalpha():
            low = c.lower()
            v = ord(low) if len(low) == 1 else cp
            out[cp] = v if v < 0x10000 else v % 0xFFFF + 1
    return out


def symbols(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Letters of all texts as symbols, runs of other characters as one 0, and the index of each one's text."""
    whole = [t or "" for t in texts]
    points = np.frombuffer("".join(whole).encode("utf-32-le", "surrogatepass"), np.uint32)
    s = _letters()[points]
    owner = np.repeat(np.arange(len(whole)), [len(t) for t in whole])
    if not len(s):
        return s, owner
    keep = s != 0
    keep[1:] |= (s[:-1] != 0) & (owner[1:] == owner[:-1])
    return s[keep], owner[keep]


def grams(s: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """The packed n-gram of order 4 that ends at each symbol; a text begins behind zeros."""
    out = s.astype(np.uint64)
    for back in range(1, ORDER):
        before = np.zeros(len(s), np.uint64)
        before[back:] = np.where(owner[back:] == owner[:-back], s[:-back], 0)
        out |= before << BITS[back]
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64 bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class HashArray:
    """Keys sorted by hash, with the start of each range of leading hash bits."""

    def __init__(self, keys: np.ndarray):
        hashed = mix(keys)
        self.order = np.argsort(hashed)
        self.hashes = hashed[self.order]
        self.bits = max(4, int(len(keys)).bit_length() + 1)
        self.start = np.searchsorted(self.hashes, np.arange(2**self.bits + 1, dtype=np.float64) * 2.0 ** (64 - self.bits)).astype(np.int32) if len(keys) else np.zeros(2**self.bits + 1, np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, or -1."""
        h = mix(keys)
        top = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        at, end = self.start[top].copy(), self.start[top + 1]
        out = np.full(len(keys), -1, np.int64)
        left = np.flatnonzero(at < end)
        while len(left):
            hit = self.hashes[at[left]] == h[left]
            out[left[hit]] = at[left[hit]]
            left = left[~hit]
            at[left] += 1
            left = left[at[left] < end[left]]
        return out


@dataclass
class Level:
    """One order: n-grams with log probabilities, contexts with back-off weights, by language."""

    found: HashArray
    logp: np.ndarray
    contexts: HashArray
    backoff: np.ndarray


class Model:
    """All languages' models. counts: for each language its order-4 n-grams and how often each occurs."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.languages = sorted(counts)
        n_lang = len(self.languages)
        tables = []  # by order: for each language n-grams and (continuation) counts
        for lang in self.languages:
            g, c = counts[lang]
            rows = [(g, c.astype(np.float64))]
            for n in range(ORDER - 1, 0, -1):
                g, c = np.unique(g & ((np.uint64(1) << BITS[n]) - np.uint64(1)), return_counts=True)
                rows.append((g, c.astype(np.float64)))
            tables.append(rows[::-1])
        alphabet = np.unique(np.concatenate([t[0][0] for t in tables]))
        self.floor = np.full(n_lang, -np.log(len(alphabet) + 1.0))
        self.levels: list[Level] = []
        below: np.ndarray | None = None
        for n in range(1, ORDER + 1):
            keys = np.unique(np.concatenate([t[n - 1][0] for t in tables]))
            heads = np.unique(keys >> np.uint64(16))
            p = np.zeros((len(keys), n_lang))
            weight = np.ones((len(heads), n_lang))
            lower = np.exp(self.floor)[None, :].repeat(len(keys), 0) if n == 1 else below[np.searchsorted(last, keys & ((np.uint64(1) << BITS[n - 1]) - np.uint64(1)))]
            for j, rows in enumerate(t[n - 1] for t in tables):
                g, c = rows
                once, twice = (c == 1).sum(), (c == 2).sum()
                discount = min(0.95, max(0.1, once / max(1.0, once + 2.0 * twice)))
                ctx = np.searchsorted(heads, g >> np.uint64(16))
                total = np.bincount(ctx, c, len(heads))
                types = np.bincount(ctx, minlength=len(heads))
                seen = total > 0
                weight[seen, j] = discount * types[seen] / total[seen]
                p[np.searchsorted(keys, g), j] = np.maximum(c - discount, 0) / total[ctx]
            p += weight[np.searchsorted(heads, keys >> np.uint64(16))] * lower
            below, last = p, keys
            a, b = HashArray(keys), HashArray(heads)
            self.levels.append(Level(a, np.log(p)[a.order], b, np.log(weight)[b.order]))

    def logp(self, g: np.ndarray, n: int = ORDER) -> np.ndarray:
        """Natural log probability of the last symbol of each n-gram by language."""
        if n == 0:
            return np.repeat(self.floor[None, :], len(g), 0)
        level = self.levels[n - 1]
        g = g & ((np.uint64(1) << BITS[n]) - np.uint64(1)) if n < ORDER else g
        at = level.found.find(g)
        out = level.logp[at]
        missed = np.flatnonzero(at < 0)
        if len(missed):
            rest = self.logp(g[missed], n - 1)
            ctx = level.contexts.find(g[missed] >> np.uint64(16))
            known = ctx >= 0
            rest[known] += level.backoff[ctx[known]]
            out[missed] = rest
        return out

    def entropies(self, texts: list[str | None], block: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per symbol of each text by language, and its symbols; whole texts, in blocks of symbols."""
        s, owner = symbols(texts)
        g = grams(s, owner)
        sums = np.zeros((len(texts), len(self.languages)))
        for at in range(0, len(g), block):
            lp, who = self.logp(g[at:at + block]), owner[at:at + block]
            first = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
            sums[who[first]] += np.add.reduceat(lp, first, axis=0)
        n = np.bincount(owner, minlength=len(texts))
        has = np.zeros(len(texts), bool)
        has[owner[s != 0]] = True
        n = np.where(has, n, 0)
        return -sums / np.maximum(n, 1)[:, None], n


@dataclass
class Calibration:
    """mean, spread: of cross-entropies by language on unseen rows; furthest: the most spreads above the mean that is
    accepted; scale: of the confidence, which is a softmax of cross-entropies times scale."""

    mean: np.ndarray
    spread: np.ndarray
    furthest: float
    scale: float

    def distance(self, best: np.ndarray, entropy: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Spreads above the mean of the best language; short texts spread more."""
        return (entropy - self.mean[best]) / (self.spread[best] * np.sqrt(1 + 200.0 / np.maximum(n, 1)))


def _confidence(h: np.ndarray, scale: float) -> np.ndarray:
    e = np.exp(-(h - h.min(1, keepdims=True)) * scale)
    return e.max(1) / e.sum(1)


def calibrate(model: Model, langs: list[str], h: np.ndarray, n: np.ndarray, margin: float = 1.5) -> Calibration:
    """From calibration rows with their true languages; margin widens the rejection limit."""
    best = h.argmin(1) if len(h) else np.zeros(0, int)
    lowest = h.min(1) if len(h) else np.zeros(0)
    k = len(model.languages)
    overall = (float(lowest.mean()), float(lowest.std())) if len(lowest) else (3.0, 1.0)
    mean, spread = np.full(k, overall[0]), np.full(k, max(overall[1], 0.05))
    for j in range(k):
        own = lowest[best == j]
        if len(own) >= 20:
            # Rare texts of one language, as mixed ones, may be missing here: they spread as those of all languages do.
            mean[j], spread[j] = own.mean(), max(own.std(), spread[j])
    out = Calibration(mean, spread, 6.0, 10.0)
    if len(h):
        out.furthest = max(6.0, margin * float(out.distance(best, lowest, n).max()))
        truth = np.array([model.languages.index(x) for x in langs])
        right = best == truth
        losses = [(-np.log(np.clip(np.where(right, c := _confidence(h, s), 1 - c), 1e-6, 1)).mean(), s) for s in (2.0, 5.0, 10.0, 20.0, 40.0, 80.0)]
        out.scale = min(losses)[1]
    return out


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", per_language: int = 3000) -> tuple[Model, Calibration] | None:
    """Models and calibration from a hash sample of about per_language distinct texts of each language; a fifth of it calibrates.

    docs has the rows that may be learned from; ids are not read, so null and repeated ones change nothing. None if no row has a language and a text.
    """
    spark = docs.sparkSession
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"), F.xxhash64(text_col).alias("name"), F.col(lang_col).cast("string").alias("lang"))
    sizes = {r["lang"]: r["count"] for r in labelled.select("lang", "name").distinct().groupBy("lang").count().collect()}  # a row for each language
    if not sizes:
        return None
    share = F.create_map(*[F.lit(x) for k, v in sizes.items() for x in (k, min(1.0, per_language / v))])
    draw = F.shiftrightunsigned(F.xxhash64("name", F.lit("sample")), 33) / F.lit(float(2**31))
    sample = materialize(labelled.where(draw < share[F.col("lang")]).dropDuplicates(["lang", "name"])
                         .select("text", "lang", (fold("name", 5) == 4).alias("aside")), "language-sample")

    def count(texts: list, langs: list) -> list:
        out: list[list] = [[], [], []]
        for lang in set(langs):
            g, c = np.unique(grams(*symbols([t for t, x in zip(texts, langs) if x == lang])), return_counts=True)
            out[0] += [lang] * len(g)
            out[1] += g.view(np.int64).tolist()
            out[2] += c.tolist()
        return out

    counted = map_columns(sample.where("not aside").select("text", "lang"), count, "lang string, gram long, n long", rows=1024)
    table_ = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()  # n-gram types of a bounded sample
    if not len(table_):
        return None
    counts = {k: (x["gram"].to_numpy().astype(np.int64).view(np.uint64), x["n"].to_numpy()) for k, x in table_.groupby("lang")}
    model = Model(counts)
    shared = spark.sparkContext.broadcast(model)

    def measure(texts: list, langs: list) -> list:
        h, n = shared.value.entropies(texts)
        return [langs, h.tolist(), n.tolist()]

    seen = map_columns(sample.where(F.col("aside") & F.col("lang").isin(model.languages)).select("text", "lang"), measure, "lang string, h array<double>, n long").where("n > 0").collect()
    h = np.array([r["h"] for r in seen]).reshape(len(seen), len(model.languages))
    return model, calibrate(model, [r["lang"] for r in seen], h, np.array([r["n"] for r in seen]))


def predict(docs: DataFrame, trained: tuple[Model, Calibration] | None, keep: list[str | Column], text_col: str = "text") -> DataFrame:
    """The columns of keep, then lang_pred, score, entropy (natural, per symbol) and rejected; one of keep with such a name is replaced."""
    added = ("lang_pred", "score", "entropy", "rejected")
    kept = without(docs.select(*keep), *added)
    text, = fresh(kept, "text_to_judge")
    shared = docs.sparkSession.sparkContext.broadcast(trained)
    width = len(kept.columns)

    def decide(*columns: list) -> list:
        texts = columns[width]
        if shared.value is None:
            return [*columns[:width], [UNKNOWN] * len(texts), [0.0] * len(texts), [None] * len(texts), [True] * len(texts)]
        model, limits = shared.value
        h, n = model.entropies(texts)
        best, low = h.argmin(1), h.min(1)
        odd = (n == 0) | (limits.distance(best, low, n) > limits.furthest)
        langs = [model.languages[b] if k else UNKNOWN for b, k in zip(best, n)]
        score = np.where(n > 0, _confidence(h, limits.scale), 0.0)
        return [*columns[:width], langs, score.tolist(), [float(x) if k else None for x, k in zip(low, n)], odd.tolist()]

    return map_columns(without(docs.select(*keep, F.col(text_col).alias(text)), *added), decide,
                       with_fields(kept, "lang_pred string, score double, entropy double, rejected boolean"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those outside the held-out quarter."""
    docs = table(spark, sf_dir, "documents")
    held_out = fold("doc_id", 4) == 2
    return predict(docs, train(docs.where(~held_out)), ["doc_id", held_out.alias("held_out")])
