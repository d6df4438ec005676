"""Text functions as Column expressions; only html_to_text() and token chunks leave the JVM."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from html.entities import html5
from html.parser import HTMLParser
from string import Formatter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: what counts as a token.
TOKEN = r"[a-z0-9_]+|[\u4e00-\u9fff]+"

# Words that never count as evidence for a match.
STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "based", "by", "for", "from", "in", "is", "it", "method", "methodology", "of", "on",
    "or", "problem", "task", "that", "the", "this", "to", "use", "using", "via", "with", "without", "workflow",
)

# Elements whose text is not shown, longest name first where one begins another.
HIDDEN_ELEMENTS = ("script", "style", "noscript", "header", "footer", "nav")

# Window sizes by model family, in tokens, and the size in characters without a tokenizer.
CHUNK_TOKENS = {"qwen": 6000, "deepseek": 12000}
DEFAULT_CHUNK_TOKENS = 8000
PAPER_CHUNK_TOKENS = 120_000
FALLBACK_CHUNK_CHARS = 20_000


def _col(c: Column | str) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def strip(c: Column | str) -> Column:
    """Without white space at either end; Spark's trim() takes spaces only."""
    return F.regexp_replace(_col(c), r"^\s+|\s+$", "")


def collapse_space(c: Column | str) -> Column:
    return F.regexp_replace(strip(c), r"\s+", " ")


def tokenize(c: Column | str) -> Column:
    """Runs of a-z, 0-9 and _, or of CJK ideographs, of the lower-case text; null gives no tokens."""
    return F.regexp_extract_all(F.lower(F.coalesce(_col(c), F.lit(""))), F.lit(TOKEN), F.lit(0))


def drop_stopwords(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: ~t.isin(*STOPWORDS))


def content_tokens(c: Column | str) -> Column:
    """Tokens, repeated ones too, without stopwords."""
    return drop_stopwords(tokenize(c))


def safe_name(c: Column | str) -> Column:
    """Letters and digits of any script and . _ - stay; each other character becomes _."""
    return F.regexp_replace(_col(c), r"[^\p{L}\p{N}._-]", "_")


def shorten_middle(c: Column | str, limit: int) -> Column:
    """A text over the limit keeps its first and last limit // 2 characters around a marker line."""
    c, half = _col(c), limit // 2
    return F.when(F.length(c) <= limit, c).otherwise(
        F.concat(F.substring(c, 1, half), F.lit("\n... [truncated] ...\n"), F.right(c, F.lit(half))))


def shorten_tail(c: Column | str, keep: int, over: int | None = None) -> Column:
    """A text longer than `over` (by default keep) keeps `keep` characters and gets three dots."""
    c = _col(c)
    return F.when(F.length(c) > (keep if over is None else over), F.concat(F.substring(c, 1, keep), F.lit("..."))).otherwise(c)


def summary_line(c: Column | str) -> Column:
    """One line of at most 280 characters and three dots."""
    return shorten_tail(collapse_space(c), 280)


def goal_line(c: Column | str) -> Column:
    """One line of at most 240 characters, dots included."""
    return shorten_tail(collapse_space(c), 237, 240)


def front_matter(c: Column | str) -> Column:
    """The text between the first two --- of a document that begins with ---; else null."""
    parts = F.split(_col(c), "---", 3)
    return F.when(_col(c).startswith("---") & (F.size(parts) == 3), parts[1])


def front_matter_value(c: Column | str, key: str) -> Column:
    """A scalar of the front matter, unquoted; null where the key is missing or empty."""
    found = F.regexp_extract(F.coalesce(front_matter(c), F.lit("")), rf"(?m)^{key}[ \t]*:[ \t]*(.*?)[ \t]*$", 1)
    plain = F.regexp_replace(found, r"""^(['"])(.*)\1$""", "$2")
    return F.nullif(plain, F.lit(""))


def without_front_matter(c: Column | str) -> Column:
    parts = F.split(_col(c), "---", 3)
    body = F.when(_col(c).startswith("---") & (F.size(parts) == 3), parts[2]).otherwise(_col(c))
    return F.regexp_replace(body, r"^\s+", "")


def first_paragraph(c: Column | str) -> Column:
    """The first block of a Markdown body that is neither empty nor a heading, on one line; '' if there is none."""
    blocks = F.filter(F.transform(F.split(_col(c), r"\n\s*\n"), strip), lambda p: (p != "") & ~p.startswith("#"))
    return summary_line(F.coalesce(F.try_element_at(blocks, F.lit(1)), F.lit("")))


def parent_folder(path: Column | str) -> Column:
    return F.element_at(F.split(_col(path), "/"), -2)


def file_stem(path: Column | str) -> Column:
    return F.regexp_replace(F.element_at(F.split(_col(path), "/"), -1), r"(?<=.)\.[^.]*$", "")


def arxiv_pdf(url: Column | str) -> Column:
    """The PDF's address for an arXiv abstract page; other addresses stay."""
    return F.regexp_replace(_col(url), r"(arxiv\.org)/abs/", "$1/pdf/")


def drop_trailing_slash(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), r"/+$", "")


def after_thinking(c: Column | str) -> Column:
    """What follows the last </think>; the whole text if there is none."""
    return F.substring_index(_col(c), "</think>", -1)


# Fixed value: the lines of a traceback that name only the runner's own frame.
RUNNER_FRAME = 'Traceback (most recent call last):\n  File "<string>", line 1, in <module>\n'


def clean_traceback(c: Column | str) -> Column:
    """A traceback without the runner's frame."""
    return F.replace(_col(c), F.lit(RUNNER_FRAME), F.lit(""))


def join_pages(pages: Column | str) -> Column:
    """Texts of a document's pages, in order, as one stripped text; missing pages count as empty."""
    return strip(F.array_join(F.transform(_col(pages), lambda p: F.coalesce(p, F.lit(""))), ""))


def decode_leniently(c: Column | str) -> Column:
    """UTF-8 bytes as text, with U+FFFD for what is not valid."""
    return F.make_valid_utf8(_col(c).cast("string"))


def coalesce_filled(*columns: Column | str) -> Column:
    """The first text that is neither null nor empty."""
    return F.coalesce(*[F.nullif(_col(c), F.lit("")) for c in columns])


def coalesce_filled_arrays(*columns: Column | str) -> Column:
    """The first array that is neither null nor empty."""
    return F.coalesce(*[F.when(F.size(_col(c)) > 0, _col(c)) for c in columns])


def hash_partition(c: Column | str, n: int) -> Column:
    """The md5 of the text as a 128-bit number, modulo n; from two halves, as no Spark integer is as wide."""
    digest = F.md5(_col(c).cast("binary"))

    def rest(half: Column) -> Column:
        high, low = (F.conv(F.substring(half, at, 8), 16, 10).cast("long") for at in (1, 9))
        return (F.pmod(high, F.lit(n)) * F.lit(2**32 % n) + F.pmod(low, F.lit(n))) % F.lit(n)

    return ((rest(F.substring(digest, 1, 16)) * F.lit(2**64 % n) + rest(F.substring(digest, 17, 16))) % F.lit(n)).cast("int")


def html_to_text_sql(c: Column | str) -> Column:
    """Shown text of a well-formed page, one line for each text node; JVM only.

    One pattern for each hidden element, so that a script's text can't end another; comments go too.
    """
    out = F.regexp_replace(_col(c), r"(?s)<!--.*?-->", "")
    for name in HIDDEN_ELEMENTS:
        out = F.regexp_replace(out, rf"(?is)<{name}\b[^>]*>.*?</{name}\s*>", "\n")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", "\n")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    lines = F.filter(F.transform(F.split(out, "\n"), strip), lambda x: x != "")
    return F.array_join(lines, "\n")


class _Shown(HTMLParser):
    """Collects text nodes outside hidden elements."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.texts: list[str] = []
        self.hidden: list[str] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in HIDDEN_ELEMENTS:
            self.hidden.append(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in self.hidden:
            while self.hidden.pop() != tag:
                pass

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.texts.append(data)


REFERENCE = re.compile(r"&(#[0-9]+;|#[xX][0-9a-fA-F]+;|[a-zA-Z0-9]+;)?")
BARE = "\udc26"  # stands for & while a page is parsed; no valid text has it


def html_text(page: str | None, unclosed: bool = True) -> str | None:
    """Shown text of any page, however malformed: lines stripped, empty ones dropped.

    References such as &amp without a semicolon are read too, as browsers do; with unclosed=False they stay as they are.
    """
    if page is None:
        return None
    if not unclosed:
        page = REFERENCE.sub(lambda m: m[0] if m[1] and (m[1][0] == "#" or m[1] in html5) else BARE + m[0][1:], page)
    parser = _Shown()
    parser.feed(page)
    parser.close()
    lines = (line.strip() for text in parser.texts for line in text.replace(BARE, "&").splitlines())
    return "\n".join(line for line in lines if line)


def html_to_text(c: Column | str, unclosed: bool = True) -> Column:
    """html_text() over Arrow batches."""

    @F.pandas_udf("string")
    def convert(pages: pd.Series) -> pd.Series:
        return pages.map(lambda page: html_text(page, unclosed))

    return convert(_col(c))


def chunk_characters(df: DataFrame, text_col: str, size: int = FALLBACK_CHUNK_CHARS, pos_col: str = "pos", chunk_col: str = "chunk") -> DataFrame:
    """A row for each window of `size` characters, from pos 0; an empty or null text has none."""
    n = F.ceil(F.length(text_col) / F.lit(size)).cast("int")
    rows = df.where(F.length(text_col) > 0).withColumn(pos_col, F.explode(F.sequence(F.lit(0), n - 1)))
    return rows.withColumn(chunk_col, F.substring(F.col(text_col), F.col(pos_col) * size + 1, F.lit(size)))


def first_chunk(c: Column | str, size: int = FALLBACK_CHUNK_CHARS) -> Column:
    """Window 0 alone, without making the others; null for an empty text."""
    return F.nullif(F.substring(_col(c), 1, size), F.lit(""))


def chunk_size(model: str | None) -> int:
    """Tokens of a window for a model's name."""
    return next((n for name, n in CHUNK_TOKENS.items() if name in (model or "").lower()), DEFAULT_CHUNK_TOKENS)


def chunk_tokens(df: DataFrame, text_col: str, size: int, encode: Callable[[str], Sequence[int]], decode: Callable[[Sequence[int]], str],
                 pos_col: str = "pos", chunk_col: str = "chunk") -> DataFrame:
    """A row for each window of `size` tokens of a tokenizer that the caller brings; where it fails, of 20,000 characters."""

    def windows(text: str | None) -> list[str]:
        if not text:
            return []
        try:
            ids = list(encode(text))
            return [decode(ids[i:i + size]) for i in range(0, len(ids), size)]
        except Exception:  # noqa: BLE001  whatever a tokenizer raises
            return [text[i:i + FALLBACK_CHUNK_CHARS] for i in range(0, len(text), FALLBACK_CHUNK_CHARS)]

    @F.pandas_udf("array<string>")
    def split_(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield batch.map(windows)

    return df.select("*", F.posexplode(split_(F.col(text_col))).alias(pos_col, chunk_col))


def format_hits(hits: Column | str) -> Column:
    """Numbered blocks of title, address and text of an array of structs; text falls back to snippet; '' for none."""
    block = lambda h, i: F.concat((i + 1).cast("string"), F.lit(". "), F.coalesce(h["title"], F.lit("")), F.lit("\nURL: "), F.coalesce(h["link"], F.lit("")),
                                  F.lit("\n"), F.coalesce(F.nullif(h["text"], F.lit("")), h["snippet"], F.lit("")))
    return F.array_join(F.transform(_col(hits), block), "\n")


def format_parsed(content: Column, score: Column, urls: Column) -> Column:
    """score, content and related addresses, one to a line, empty lines dropped."""
    links = F.transform(F.coalesce(urls, F.array().cast("array<struct<url:string,description:string>>")),
                        lambda u: F.concat(F.lit("- "), F.coalesce(u["url"], F.lit("")), F.lit(": "), F.coalesce(u["description"], F.lit(""))))
    lines = F.concat(F.array(F.concat(F.lit("score: "), F.coalesce(score.cast("string"), F.lit(""))), strip(F.coalesce(content, F.lit("")))),
                     F.when(F.size(links) > 0, F.concat(F.array(F.lit("related_urls:")), links)).otherwise(F.array().cast("array<string>")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def scope_bullets(scope: Column, most: int = 6) -> Column:
    """The first items of an array as indented bullets."""
    return F.array_join(F.transform(F.slice(scope, 1, most), lambda s: F.concat(F.lit("    - "), s)), "\n")


def scope_lines(scope: Column | str, most: int = 6) -> Column:
    """The same of JSON text that may be a list, a string or another scalar; '' for what is missing or empty."""
    c = _col(scope)
    doc = F.try_parse_json(c)
    kind = F.schema_of_variant(doc)
    plain = F.try_variant_get(doc, "$", "string")
    items = F.when(kind.startswith("ARRAY"), F.from_json(c, "array<string>")).when(kind.isin("VOID") | (plain.isin("", "0", "false")), F.array().cast("array<string>")).otherwise(F.array(plain))
    return F.coalesce(scope_bullets(items, most), F.lit(""))


def fill_template(template: str, **values: Column | str) -> Column:
    """{name} replaced by a column's text, {{ and }} by braces; null fills as ''."""
    parts: list[Column] = []
    for literal, name, _, _ in Formatter().parse(template):
        parts.append(F.lit(literal))
        if name is not None:
            parts.append(F.coalesce(_col(values[name]).cast("string"), F.lit("")))
    return F.concat(*parts) if parts else F.lit("")
