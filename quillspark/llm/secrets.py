"""Secret scan: fixed patterns, and zstandard novelty primed with an identifier dictionary.

The base patterns find assignments, access keys and long hex strings. The method adds `novel` spans:
every long token with a sensitive word in the text on either side is compressed behind its surroundings,
by a compressor whose dictionary holds common identifiers, fixed ones and the most frequent of all texts; the bytes that the token adds tell how much of
it neither the surroundings nor the dictionary explain. A token whose bytes hardly compress is a span, whatever characters it is
made of: random ones add all their bytes, words and identifiers about half of them.

Edge cases: a null or empty text has no spans; very long texts are scanned whole, one at a time; each text is scanned by itself, so repeated
rows and ids give repeated results; spans that start together are in the order of their kinds, and a token that reaches its limit just
so is a span; an empty table gives an empty result; other columns of the input are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import discard, map_columns, materialize, table

KINDS = ("assign", "access", "hex", "novel")

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a run of 24 or more is what [0-9a-f]+ finds, less the short ones
LONG = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")  # every hex span, access key and novel token lies in such a run
SENSITIVE = re.compile(r"pass|secret|token|api|key|auth|bearer|cred|private|access|session|signature|jwt|sas|pwd|aws", re.IGNORECASE | re.ASCII)

NO_LETTER = r"[\x00-\x40\x5B-\x5E\x60\x7B-\x7F]+"  # ASCII but for letters and _

# Identifiers and words that stand around secrets in code and configuration.
IDENTIFIERS = (
    "password", "passwd", "secret", "token", "api_key", "apikey", "access_key", "access_token", "refresh_token", "client_id",
    "client_secret", "private_key", "public_key", "secret_key", "session_id", "session_token", "authorization", "Authorization",
    "Bearer", "Basic", "signature", "credentials", "username", "user_name", "account", "database", "connection_string", "hostname",
    "endpoint", "bucket", "region", "environment", "production", "development", "localhost", "config", "configuration", "settings",
    "function", "return", "import", "export", "default", "const", "class", "public", "static", "void", "string", "integer", "boolean",
    "self", "None", "true", "false", "null", "undefined", "print", "console", "request", "response", "header", "content_type",
    "application/json", "Content-Type", "http://", "https://", "www.", ".com", ".org", "BEGIN PRIVATE KEY", "END PRIVATE KEY",
    "AWS_ACCESS_KEY_ID", "AWS_SECRET_ACCESS_KEY", "GITHUB_TOKEN", "DATABASE_URL", "SECRET_KEY_BASE", "0123456789abcdef",
    "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "example", "placeholder", "changeme", "xxxxxxxx",
    "identifier", "implementation", "initialize", "parameters", "arguments", "callback", "exception", "timestamp", "transaction",
)


@dataclass(frozen=True)
class Limits:
    """around: characters of surroundings on either side, searched for a sensitive word too; share: least added bytes for
    each byte of a token; least: least added bytes; enough: added bytes that do at any length."""

    around: int = 160
    share: float = 0.8
    least: int = 11
    enough: int = 48

    def bar(self, token: str) -> float:
        """Added bytes that make a token a span."""
        return max(self.least, min(self.enough, self.share * len(token)))


def learn_identifiers(docs: DataFrame, text_col: str = "text", size: int = 4000, shortest: int = 5, longest: int = 40) -> tuple[str, ...]:
    """The most frequent words of letters and _ in all texts, at most `size`, the rarest first, ties by the word.

    Words with digits are left out: a key that many copies of a text hold must not explain itself. All words are counted by hash; those
    of the chosen counts are then read. Counts fall into steps of a fiftieth of their logarithm, and the last step is left out whole if it doesn't fit.
    """
    # The outer form keeps Spark from splitting each text twice more for a test that it has words.
    words = docs.select(F.explode_outer(F.split(F.col(text_col), NO_LETTER)).alias("word")).where(F.octet_length("word").between(shortest, longest))
    counts = materialize(words.select(F.xxhash64("word").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n")), "word-counts")
    step = F.floor(F.log("n") * F.lit(50.0)).cast("int")
    room, least = size, 2**31 - 1
    for r in sorted(counts.groupBy(step.alias("step")).count().collect(), reverse=True):  # some hundred rows
        room -= r["count"]
        if room < 0:
            break
        least = r["step"]
    chosen = F.broadcast(counts.where(step >= least))  # at most size rows
    found = words.join(chosen, F.xxhash64("word") == F.col("key")).groupBy("key", "n").agg(F.min("word").alias("word")).collect()
    discard(counts)
    return tuple(r["word"] for r in sorted(found, key=lambda r: (-r["n"], r["word"]))[::-1])


@lru_cache(maxsize=2)
def _compressor(learned: tuple[str, ...]):
    import zstandard  # here, so that a missing module fails this operator alone, and loudly

    words = " ".join([*learned, *IDENTIFIERS]).encode()
    return zstandard.ZstdCompressor(level=6, dict_data=zstandard.ZstdCompressionDict(words, dict_type=zstandard.DICT_TYPE_RAWCONTENT),
                                    write_content_size=False, write_checksum=False, write_dict_id=False)


def novelty(before: str, token: str, after: str, learned: tuple[str, ...] = ()) -> int:
    """Bytes that the token adds when it is compressed behind its surroundings, which must not hold it themselves."""
    pack = _compressor(learned).compress
    around = f"{before}\n{after}\n".replace(token, "").encode()
    return len(pack(around + token.encode())) - len(pack(around))


def scan(text: str | None, limits: Limits = Limits(), learned: tuple[str, ...] = ()) -> list[tuple[int, int, int, int]]:
    """(start, index in KINDS, end, added bytes or -1) of each span, by start, then kind; learned: identifiers beside the fixed ones."""
    if not text:
        return []
    found: list[tuple[int, int, int, int]] = []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end(), -1) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    for run in LONG.finditer(text):
        token, at = run.group(), run.start()
        if "AKIA" in token:
            found += [(at + m.start(), 1, at + m.end(), -1) for m in ACCESS.finditer(token) if m.end() - m.start() >= 20]
        found += [(at + m.start(), 2, at + m.end(), -1) for m in HEX.finditer(token)]
        left, right = max(0, at - limits.around), run.end() + limits.around
        if SENSITIVE.search(text, left, at) or SENSITIVE.search(text, run.end(), right):
            added = novelty(text[left:at], token, text[run.end():right], learned)
            if added >= limits.bar(token):
                found.append((at, 3, run.end(), added))
    return sorted(found)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limits: Limits = Limits()) -> DataFrame:
    """One row for each span: id, kind, start, stop (code points), secret (its text) and added_bytes (null but for novel)."""
    learned = learn_identifiers(docs, text_col)

    def spans(ids: list, texts: list) -> Iterator[list]:
        rows = [(i, KINDS[k], a, b, t[a:b], n if n >= 0 else None) for i, t in zip(ids, texts) for a, k, b, n in scan(t, limits, learned)]
        return [list(x) for x in zip(*rows)] or [[] for _ in range(6)]

    kind = docs.schema[id_col].dataType.simpleString()
    return map_columns(docs.select(id_col, text_col), spans,
                       f"`{id_col}` {kind}, kind string, start long, stop long, secret string, added_bytes long")


def summarize_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limits: Limits = Limits()) -> DataFrame:
    """One row for each document: counts by kind, a digest of the base spans, and all spans."""
    learned = learn_identifiers(docs, text_col)

    def digest(ids: list, texts: list) -> list[list]:
        out: list[list] = [[], [], [], [], [], [], []]
        for i, t in zip(ids, texts):
            spans = scan(t, limits, learned)
            named = [f"{KINDS[k]}:{a}:{b}" for a, k, b, _ in spans]
            base = ",".join(n for n, s in zip(named, spans) if s[1] < 3)
            counts = [sum(s[1] == k for s in spans) for k in range(4)]
            row = (i, *counts[:3], hashlib.sha256(base.encode()).hexdigest(), ",".join(named), counts[3])
            for column, x in zip(out, row):
                column.append(x)
        return out

    kind = docs.schema[id_col].dataType.simpleString()
    return map_columns(docs.select(id_col, text_col), digest,
                       f"`{id_col}` {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_novel long")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    return summarize_secrets(table(spark, sf_dir, "documents"))
