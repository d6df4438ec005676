"""Toxicity scores: a bag of subword embeddings, averaged into a linear softmax, trained jointly in numpy.

A word is the sum of the vectors of its character n-grams and of the word itself, all hashed into one
table; a text is the mean of its distinct words, each weighted by the square root of its count, and of
`padding` neutral words, so that one word or a word repeated all over is little evidence; a linear
softmax reads the mean. Table and softmax learn together by Adam on the cross-entropy. A misspelt word that was never seen keeps most of its n-grams,
and so most of its vector. N-grams in fewer than `least_docs` training texts stay zero. Words of more than `piece` characters, as in texts without
spaces, count as overlapping pieces, each a word of its own.

A text enters the fit as the share of each n-gram in its mean, at most `buckets` numbers, whatever its length; these are made where the texts
are. The fit takes a bounded sample of distinct labelled texts (`toxic_rows`, `clean_rows`, by hash of the text) and runs
in one task; the bias is the share of toxic texts, in the fit the sample's and then that of all. As the softmax is linear, the
trained table shrinks to one number for each n-gram, which is all that scoring needs. Every text is
scored whole, a slice of rows at a time in arrays.

Edge cases: null and empty texts get the score of no evidence, the prior; rows with a null label or id teach
nothing; an id with several labels takes their mean, and so does a text with several rows; with no usable label, or an empty
table, every score is 0; repeated rows give repeated results and teach as one; a tie at 0.5 is predicted toxic; columns other than
id and text (and the label's) are not read, and one of keep that is named like an added column is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import discard, fold, fresh, map_columns, materialize, table, with_fields, without

EDGE = ".,;:!?\"'()[]{}<>|%&$#*~`^=+-_/\\"


@dataclass(frozen=True)
class Settings:
    """Sample bounds (about how many distinct texts by label) and shape of the model; piece: longer words count as pieces of so many characters;
    room: words that a worker remembers."""

    toxic_rows: int = 3000
    clean_rows: int = 5000
    buckets: int = 1 << 16
    width: int = 8
    shortest: int = 3
    longest: int = 5
    piece: int = 64
    least_docs: int = 4
    padding: float = 12.0
    epochs: int = 12
    batch: int = 64
    rate: float = 0.03
    decay: float = 1e-4
    gain: float = 10.0
    seed: int = 5
    room: int = 400_000


def pieces(word: str, s: Settings) -> list[str]:
    """A word of more than `piece` characters as pieces of so many, each sharing longest - 1 with the next, so that no n-gram is lost."""
    if len(word) <= s.piece:
        return [word]
    step = s.piece - s.longest + 1
    return [word[i:i + s.piece] for i in range(0, len(word) - s.longest + 1, step)]


def words(text: str | None, s: Settings) -> list[str]:
    """Lower-case words without the punctuation at their edges, long ones in pieces."""
    return [p for w in (x.strip(EDGE) for x in (text or "").lower().split()) if w for p in pieces(w, s)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def gram_table(ws: list[str], s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Distinct table rows of each word and its n-grams, one word after the other, and the number of each word's."""
    if not ws:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    codes = np.frombuffer("".join([f"<{w}>" for w in ws]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.array([len(w) + 2 for w in ws])
    owner = np.repeat(np.arange(len(ws)), sizes)
    starts = np.cumsum(sizes) - sizes
    place = (np.arange(len(codes)) - np.repeat(starts, sizes)).astype(np.uint64)
    found, of = [np.add.reduceat(_mix(codes * np.uint64(0x9E3779B1) + place), starts)], [np.arange(len(ws))]
    for n in range(s.shortest, s.longest + 1):
        if len(codes) >= n:
            h = np.full(len(codes) - n + 1, n, np.uint64)
            for k in range(n):
                h = _mix(h ^ codes[k:len(codes) - n + 1 + k])
            whole = owner[:len(h)] == owner[n - 1:]
            found.append(h[whole])
            of.append(owner[:len(h)][whole])
    row = (_mix(np.concatenate(found)) % np.uint64(s.buckets)).astype(np.int64)
    both = np.concatenate(of) * s.buckets + row
    both.sort()
    both = both[np.r_[True, both[1:] != both[:-1]]]
    return both % s.buckets, np.bincount(both // s.buckets, minlength=len(ws))


def _places(starts: np.ndarray, lengths: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the chosen rows of a ragged array lie, and how long each is."""
    n = lengths[which]
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[which] - (ends - n), n), n


class Lexicon:
    """Numbers for the words of texts; a raw token is stripped and cut into pieces once."""

    def __init__(self, s: Settings):
        self.s, self.known = s, 0
        self.of: dict[str, int] = {}  # raw token to its word's number, -1 for none, or -2 - k for the k-th list of several
        self.several: list[list[int]] = []
        self.number: dict[str, int] = {}

    def _add(self, token: str) -> int:
        parts = words(token, self.s)
        numbers = [self.number.setdefault(p, len(self.number)) for p in parts]
        if len(numbers) > 1:
            self.several.append(numbers)
        at = self.of[token] = numbers[0] if len(numbers) == 1 else -1 if not numbers else -1 - len(self.several)
        return at

    def bags(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each distinct word of each text: index of the text, number of the word, its share in the mean."""
        if len(self.number) > self.s.room:
            self.__init__(self.s)
        get, add = self.of.get, self._add
        ids: list[int] = []
        lengths = []
        for text in texts:
            tokens = (text or "").lower().split()
            ids += [add(t) if (at := get(t)) is None else at for t in tokens]
            lengths.append(len(tokens))
        word, owner = np.array(ids, np.int64), np.repeat(np.arange(len(texts)), lengths)
        long = np.flatnonzero(word < -1)
        if len(long):
            lists = [self.several[-2 - word[i]] for i in long]
            word = np.concatenate([word, *lists])
            owner = np.concatenate([owner, np.repeat(owner[long], [len(x) for x in lists])])
        word, owner = word[word >= 0], owner[word >= 0]
        both, count = np.unique(owner * max(1, len(self.number)) + word, return_counts=True)
        owner, word = both // max(1, len(self.number)), both % max(1, len(self.number))
        root = np.sqrt(count)
        return owner, word, root / (np.bincount(owner, root, len(texts)) + self.s.padding)[owner]

    def new_words(self) -> list[str]:
        """The words numbered since the last call, in order."""
        out = list(self.number)[self.known:] if len(self.number) > self.known else []
        self.known = len(self.number)
        return out


@dataclass
class Model:
    """weight: what an n-gram adds to the log odds of a text made of it alone; bias: the log odds of no evidence."""

    settings: Settings
    weight: np.ndarray
    bias: float
    lexicon: Lexicon | None = field(default=None, compare=False)
    by_word: np.ndarray | None = field(default=None, compare=False)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.lexicon is None:
            self.lexicon = Lexicon(self.settings)
        owner, word, share = self.lexicon.bags(texts)
        if not self.lexicon.known:  # new, or emptied
            self.by_word = np.zeros(0)
        if fresh_words := self.lexicon.new_words():
            rows, n = gram_table(fresh_words, self.settings)
            self.by_word = np.concatenate([self.by_word, np.bincount(np.repeat(np.arange(len(n)), n), self.weight[rows].astype(float), len(n))])
        odds = self.bias + np.bincount(owner, self.by_word[word] * share, len(texts))
        return 1 / (1 + np.exp(-np.clip(odds, -40, 40)))

    def score(self, text: str | None) -> float:
        return float(self.scores([text])[0])


def features(texts: list[str], s: Settings) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each text the table rows of its n-grams, and the share of each in its mean."""
    lexicon = Lexicon(s)
    owner, word, share = lexicon.bags(texts)
    rows, n = gram_table(lexicon.new_words(), s)
    at, many = _places(np.cumsum(n) - n, n, word)
    grams = rows[at]
    both, which = np.unique(np.repeat(owner, many) * s.buckets + grams, return_inverse=True)
    shares = np.bincount(which, np.repeat(share, many), len(both))
    cuts = np.searchsorted(both, np.arange(1, len(texts)) * s.buckets)
    return np.split(both % s.buckets, cuts), np.split(shares, cuts)


def fit(rows: list[np.ndarray], shares: list[np.ndarray], labels: np.ndarray, s: Settings, prior: float) -> Model:
    """Train on the features of distinct texts; prior is the share of toxic ones among all labelled texts. An eighth chooses the epoch."""
    odds = lambda x: float(np.log(min(max(x, 1e-6), 1 - 1e-6) / (1 - min(max(x, 1e-6), 1 - 1e-6))))
    full = [i for i, r in enumerate(rows) if len(r)]
    if not full:
        return Model(s, np.zeros(s.buckets, np.float32), odds(prior))
    y = np.asarray(labels, float)[full]
    n = np.array([len(rows[i]) for i in full])
    starts = np.cumsum(n) - n
    flat, share = np.concatenate([rows[i] for i in full]), np.concatenate([shares[i] for i in full]).astype(np.float32)
    usable = (np.bincount(flat, minlength=s.buckets) >= s.least_docs).astype(np.float32)[:, None]

    rng = np.random.default_rng(s.seed)
    params = [(rng.normal(0, 0.1, (s.buckets, s.width)) * usable).astype(np.float32), rng.normal(0, 0.3, (s.width, 2)).astype(np.float32)]
    no_evidence = np.array([0, odds(float(y.mean()))], np.float32)  # fixed, so that what little a short text says moves it little
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    order = rng.permutation(len(full))
    held, learn = order[:len(order) // 8], order[len(order) // 8:]

    def forward(which: np.ndarray):
        at, many = _places(starts, n, which)
        grams, part = flat[at], share[at, None]
        mean = np.add.reduceat(params[0][grams] * part, np.cumsum(many) - many) * s.gain
        logits = mean @ params[1] + no_evidence
        logits -= logits.max(1, keepdims=True)
        p = np.exp(logits)
        return grams, part, many, mean, p / p.sum(1, keepdims=True)

    def loss(which: np.ndarray) -> float:
        p = np.concatenate([forward(which[i:i + 512])[-1][:, 1] for i in range(0, len(which), 512)])
        return float(-(y[which] * np.log(p + 1e-7) + (1 - y[which]) * np.log(1 - p + 1e-7)).mean())

    best, step = (np.inf, [p.copy() for p in params]), 0
    for _ in range(s.epochs):
        learn = rng.permutation(learn)
        for i in range(0, len(learn), s.batch):
            which = learn[i:i + s.batch]
            g, part, many, mean, p = forward(which)
            wrong = (p - np.stack([1 - y[which], y[which]], 1)).astype(np.float32) / len(which)
            to_gram = np.repeat((wrong @ params[1].T) * s.gain, many, axis=0) * part
            to_table = np.stack([np.bincount(g, to_gram[:, k], s.buckets) for k in range(s.width)], 1).astype(np.float32)
            grads = [(to_table + s.decay * params[0]) * usable, mean.T @ wrong + s.decay * params[1]]
            step += 1
            for q, d, m, v in zip(params, grads, first, second):
                m += 0.1 * (d - m)
                v += 0.001 * (d * d - v)
                q -= s.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        now = loss(held) if len(held) else loss(learn)
        if now < best[0]:
            best = (now, [p.copy() for p in params])
    table_, w = best[1]
    return Model(s, (table_ @ (w[:, 1] - w[:, 0]) * s.gain).astype(np.float32), odds(prior))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", settings: Settings = Settings()) -> Model | None:
    """Fit on a bounded sample, by hash, of the distinct texts that the given labels name. None if there is no usable label."""
    one = (labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id"))
           .agg(F.avg(F.col(label_col).cast("double")).alias("label")))
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("of"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("name"))
    named = materialize(texts.select("of", "name").join(one, F.col("of") == F.col("id")).groupBy("name").agg(F.avg("label").alias("label")), "labelled-texts")
    toxic = F.col("label") >= 0.5
    n = named.agg(F.count(F.lit(1)).alias("n"), F.count_if(toxic).alias("toxic")).first()
    if not n["n"]:
        return None
    share = F.when(toxic, F.lit(settings.toxic_rows / max(1, n["toxic"]))).otherwise(F.lit(settings.clean_rows / max(1, n["n"] - n["toxic"])))
    draw = F.shiftrightunsigned(F.xxhash64("name", F.lit("sample")), 33) / F.lit(float(2**31))
    chosen = named.where(draw < share)  # about toxic_rows + clean_rows rows
    sample = texts.select("name", "text").join(F.broadcast(chosen), "name").dropDuplicates(["name"]).select("name", "text", "label")

    def measure(names: list, texts: list, labels: list) -> list:
        rows, shares = features(texts, settings)
        return [names, [r.astype(np.int32) for r in rows], [x.astype(np.float32) for x in shares], labels]

    held = materialize(map_columns(sample, measure, "name long, rows array<int>, shares array<float>, label double", rows=64), "toxicity-features")
    prior = n["toxic"] / n["n"]

    def fit_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, rows, shares, labels = [], [], [], []
        for batch in batches:
            for k, out in ((1, rows), (2, shares)):
                flat, cuts = batch.column(k).flatten().to_numpy(), np.cumsum(np.diff(batch.column(k).offsets.to_numpy()))
                out.extend(np.split(flat.copy(), cuts[:-1]))
            names += batch.column(0).to_pylist()
            labels += batch.column(3).to_pylist()
        order = np.argsort(np.array(names, np.int64))
        model = fit([rows[i] for i in order], [shares[i] for i in order], np.array(labels)[order], settings, prior)
        yield pa.RecordBatch.from_arrays([pa.array([model.weight.tobytes()], pa.binary()), pa.array([model.bias])], names=["weight", "bias"])

    # The sample's size is bounded by the settings, so one task takes it.
    fitted = held.coalesce(1).mapInArrow(fit_all, "weight binary, bias double").first()
    discard(named, held)
    return Model(settings, np.frombuffer(fitted["weight"], np.float32), fitted["bias"])


def score(docs: DataFrame, model: Model | None, keep: list[str | Column], text_col: str = "text") -> DataFrame:
    """The columns of keep, then score and predicted; one of keep with such a name is replaced."""
    kept = without(docs.select(*keep), "score", "predicted")
    text, = fresh(kept, "text_to_judge")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    width = len(kept.columns)

    def judge(*columns: list) -> list:
        found = shared.value.scores(columns[width]) if shared.value else np.zeros(len(columns[width]))
        return [*columns[:width], found.tolist(), [int(x >= 0.5) for x in found]]

    rows = without(docs.select(*keep, F.col(text_col).alias(text)), "score", "predicted")
    return map_columns(rows, judge, with_fields(kept, "score double, predicted int"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labels outside the held-out fifth."""
    docs, held_out = table(spark, sf_dir, "documents"), fold("doc_id", 5) == 0
    model = train(docs, table(spark, sf_dir, "labels").where(~held_out))
    return score(docs, model, ["doc_id", held_out.alias("held_out")])
