"""Document fingerprints: a Merkle tree over leaves, paragraphs and sections.

A section ends with a blank line or before a line that starts with #; a paragraph is a line; a leaf is
a run of words that ends where the hash of a word says so, so that an edit moves no boundary but its
own. Each node's hash covers its children's; the root covers every character. The fingerprint is the
root and the short hashes of all leaves, grouped by paragraph and section. tree() makes the inner hashes anew from these, and
so two fingerprints tell whether texts are equal, how alike they are and, by a walk from the roots, which branches differ.

next_by_id() pairs each row with the next in order of id. The rows are range partitioned and sorted
once; only the first and last row of each partition meet again, in a join of that many rows.

Edge cases: a null text is the empty text, whose tree has no leaves; repeated ids are ordered by the
hash of their text, rows that repeat both in any order; a null id comes first; a single row is its own next; an empty table gives an
empty result; very long texts are read whole, one at a time; columns other than id and text are not read, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quillspark.llm.common import map_columns, materialize, table
from quillspark.shipping import ship_package

WORDS = re.compile(r"\S+\s*|\s+")
LEAF_WORDS = 6  # mean words of a leaf


def _hash(level: bytes, data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16, person=level).digest()


def _leaves(paragraph: str) -> list[bytes]:
    out, start, at = [], 0, 0
    for word in WORDS.findall(paragraph):
        at += len(word)
        if zlib.crc32(word.strip().encode("utf-8")) % LEAF_WORDS == 0:
            out.append(paragraph[start:at])
            start = at
    if start < len(paragraph):
        out.append(paragraph[start:])
    return [_hash(b"leaf", x.encode("utf-8")) for x in out]


def sections(text: str) -> list[list[str]]:
    """Paragraphs by section; joined again they are the text."""
    out: list[list[str]] = [[]]
    for line in re.split(r"(?<=\n)", text):
        if line:
            if line.startswith("#") and out[-1]:
                out.append([])
            out[-1].append(line)
            if not line.strip():
                out.append([])
    return [s for s in out if s]


def fingerprint(text: str | None) -> str:
    """root:leaves, with | between sections, / between paragraphs and 4 characters for each leaf."""
    tops, shown = [], []
    for section in sections(text or ""):
        nodes, parts = [], []
        for paragraph in section:
            leaves = _leaves(paragraph)
            nodes.append(_hash(b"paragraph", b"".join(leaves)))
            parts.append(base64.urlsafe_b64encode(b"".join(x[:3] for x in leaves)).decode())
        tops.append(_hash(b"section", b"".join(nodes)))
        shown.append("/".join(parts))
    return f"{_hash(b'root', b''.join(tops)).hex()}:{'|'.join(shown)}"


def _split(print_: str) -> tuple[str, Counter]:
    root, _, rest = print_.partition(":")
    leaves = rest.replace("|", "").replace("/", "")
    return root, Counter(leaves[i:i + 4] for i in range(0, len(leaves), 4))


def likeness(a: str, b: str) -> float:
    """1 for equal roots, else the share of leaves, of both, that are in both (0 to 1)."""
    (root_a, in_a), (root_b, in_b) = _split(a), _split(b)
    if root_a == root_b:
        return 1.0
    return 2 * (in_a & in_b).total() / max(1, in_a.total() + in_b.total())


@dataclass(frozen=True)
class Node:
    """A branch of a tree: the hash of its children's, or a leaf's own short hash."""

    hash: bytes
    children: tuple[Node, ...] = ()


def tree(print_: str) -> Node:
    """The Merkle tree of a fingerprint: sections, paragraphs and leaves, each inner hash made of the hashes below it."""
    root, _, rest = print_.partition(":")
    above = lambda level, nodes: Node(_hash(level, b"".join(n.hash for n in nodes)), tuple(nodes))
    leaves = lambda p: [Node(p[i:i + 4].encode()) for i in range(0, len(p), 4)]
    found = [above(b"section", [above(b"paragraph", leaves(p)) for p in section.split("/")]) for section in rest.split("|")] if rest else []
    return Node(bytes.fromhex(root), tuple(found))


def _differ(a: Node, b: Node | None, path: tuple[int, ...], depth: int) -> Iterator[tuple[int, ...]]:
    """Paths, of `depth` steps at most, of the least branches below a that have no equal in their place in b. Branches of equal hash are not entered."""
    if b is not None and a.hash == b.hash:
        return
    if len(path) == depth or not a.children:
        yield path
        return
    if b is None or not b.children:
        for i, child in enumerate(a.children):
            yield from _differ(child, None, (*path, i), depth)
        return
    matcher = SequenceMatcher(None, [x.hash for x in a.children], [x.hash for x in b.children], autojunk=False)
    for kind, i0, i1, j0, j1 in matcher.get_opcodes():
        if kind != "equal":
            for i in range(i0, i1):
                yield from _differ(a.children[i], b.children[j0 + i - i0] if j0 + i - i0 < j1 else None, (*path, i), depth)


def differing_branches(a: str, b: str, depth: int = 2) -> list[tuple[int, ...]]:
    """The branches of a that locate an edit, by a walk down from the roots: (section, paragraph) from 0, or with a depth of 3 (section, paragraph, leaf).

    None for equal roots; only branches whose hashes differ are entered. A branch that is whole in b, if at another place among
    its siblings, doesn't differ; what only b has is in differing_branches(b, a).
    """
    x, y = tree(a), tree(b)
    return [] if x.hash == y.hash else list(_differ(x, y, (), depth))


def edited(text: str, following: str) -> str:
    """The last half of text, rounded down, replaced by as many first characters of the following text."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def _digest(text: str, mine: str, following: str, theirs: str) -> tuple:
    changed = edited(text, following)
    new = fingerprint(changed)
    return (len(text), hashlib.sha256(changed.encode("utf-8")).hexdigest(), mine, new, likeness(mine, new), likeness(mine, theirs))


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and fingerprint of each row."""
    kind = docs.schema[id_col].dataType.simpleString()
    return map_columns(docs.select(id_col, text_col), lambda ids, texts: [ids, [fingerprint(t) for t in texts]],
                       f"`{id_col}` {kind}, fingerprint string")


RESULT = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
ROW, HEAD, TAIL = 0, 1, 2


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's fingerprint, that of its text edited with the next row's, and both likenesses."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = T.StructType.fromDDL(f"part int, role int, `{id_col}` {kind}, {RESULT}, text string")
    arrow = to_arrow_schema(schema)
    ship_package(docs.sparkSession)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), None
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                rows = []
                for i, t in zip(*[c.to_pylist() for c in batch.slice(at, 512).columns]):
                    t = t or ""
                    mine = fingerprint(t)
                    if before is None:
                        rows.append((part, HEAD, i, *[None] * 6, t))
                    else:
                        rows.append((part, ROW, before[0], *_digest(before[1], before[2], t, mine), None))
                    before = (i, t, mine)
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), arrow)], schema=arrow)
        if before is not None:
            last = (part, TAIL, before[0], *[None] * 6, before[1])
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(last, arrow)], schema=arrow)

    order = [F.col(id_col), F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))]
    walked = materialize(docs.select(id_col, text_col).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(walk, schema), "fingerprints")
    parts = sorted(r["part"] for r in walked.where(F.col("role") == HEAD).select("part").collect())  # one for each partition
    after = docs.sparkSession.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "part int, following int")
    tails = walked.where(F.col("role") == TAIL).join(F.broadcast(after), "part").select(id_col, "text", "following")
    heads = walked.where(F.col("role") == HEAD).select(F.col("part").alias("following"), F.col("text").alias("next_text"))

    def ends(ids: list, texts: list, nexts: list) -> list:
        rows = [_digest(t, fingerprint(t), n, fingerprint(n)) for t, n in zip(texts, nexts)]
        return [ids, *map(list, zip(*rows))]

    last = map_columns(tails.join(heads, "following").select(id_col, "text", "next_text"), ends, f"`{id_col}` {kind}, {RESULT}", rows=16)
    return walked.where(F.col("role") == ROW).select(last.columns).unionByName(last)


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return compare_with_next(table(spark, sf_dir, "documents"))
