"""Text functions: keyword tokens, analysis for search, chunks, markup, names and sizes."""

from __future__ import annotations

import re
from html.entities import html5
from html.parser import HTMLParser

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that are never keywords, file extensions that are never keywords.
KEYWORD_STOP_WORDS = "the and for are not with from this that have was you all any but can had has his her its our their they them who what when where why how".split()
EXTENSION_WORDS = "mp3 mp4 mkv iso avi wmv flac wav jpg jpeg png gif zip rar tar gz epub pdf txt".split()
#: Least bytes of a keyword, most keywords of a name, most bytes of a salt.
MIN_TOKEN_BYTES, MAX_KEYWORDS, MAX_SALT_BYTES = 3, 8, 64
#: Words that the search analyser drops: the usual short English list.
SEARCH_STOP_WORDS = "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()
WORD_BREAK = r"[^\p{L}\p{Nd}]+"
#: Target bytes of a chunk.
CHUNK_BYTES = 2048


def keywords(name: Column, most: int | None = MAX_KEYWORDS) -> Column:
    """Distinct keywords of a name in order of first occurrence; most=None keeps all. Null gives none."""
    words = F.split(F.lower(F.coalesce(name, F.lit(""))), WORD_BREAK)
    kept = F.array_distinct(F.filter(words, lambda w: (F.octet_length(w) >= MIN_TOKEN_BYTES) & ~w.isin(KEYWORD_STOP_WORDS + EXTENSION_WORDS)))
    return kept if most is None else F.slice(kept, 1, most)


def sorted_keywords(name: Column) -> Column:
    return F.array_sort(keywords(name))


def analysed(text: Column) -> Column:
    """Search terms of a text, in order: lower-case words without stop words."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), WORD_BREAK), lambda w: ~w.isin(["", *SEARCH_STOP_WORDS]))


def keyword_salt(keyword: Column, shard: Column | int = 0) -> Column:
    """The keyword itself, or keyword#n for a later shard; null if it is empty or too long."""
    shard = F.lit(shard) if isinstance(shard, int) else shard
    salt = F.when(shard == 0, keyword).otherwise(F.concat_ws("#", keyword, shard.cast("string")))
    return F.when((keyword != "") & (F.octet_length(salt) <= MAX_SALT_BYTES), salt)


def is_infohash(c: Column) -> Column:
    return F.lower(c).rlike("^[0-9a-f]{40}$")


def is_public_key(c: Column) -> Column:
    return F.lower(c).rlike("^[0-9a-f]{64}$")


def next_prefix(prefix: bytes) -> bytes | None:
    """The least byte string above all that start with prefix; None if there is none."""
    cut = prefix.rstrip(b"\xff")
    return cut[:-1] + bytes([cut[-1] + 1]) if cut else None


def human_bytes(n: Column) -> Column:
    """A size with a binary unit: 512 B, 1.5 KiB, 2.0 MiB."""
    out = F.format_string("%d B", n)
    for power, unit in enumerate(("KiB", "MiB", "GiB", "TiB"), 1):
        out = F.when(n >= 1 << (10 * power), F.format_string(f"%.1f {unit}", n / float(1 << (10 * power)))).otherwise(out)
    return out


def highlight(text: Column, terms: list[str], width: int = 80) -> Column:
    """Fragments around whole-word hits, hits marked; an empty array where no term occurs."""
    if not terms:
        return F.array().cast("array<string>")
    word = r"(?iu)(?<![\p{L}\p{Nd}])(" + "|".join(re.escape(t) for t in sorted(terms)) + r")(?![\p{L}\p{Nd}])"
    around = rf"(?isu)(.{{0,{width}}}" + word[5:] + rf".{{0,{width}}})"
    return F.transform(F.regexp_extract_all(text, F.lit(around), F.lit(1)), lambda x: F.regexp_replace(x, word, "<mark>$1</mark>"))


def sanitised(data: bytes) -> str:
    """UTF-8 text without a byte-order mark; each byte that doesn't decode becomes U+FFFD."""
    out, data = [], data.removeprefix(b"\xef\xbb\xbf")
    while True:
        try:
            return "".join(out) + data.decode()
        except UnicodeDecodeError as e:
            out.append(data[: e.start].decode() + "�")
            data = data[e.start + 1 :]


def squeezed_lines(text: str) -> str:
    """Lines without trailing white space, at most one empty line between others, trimmed."""
    lines = [x.rstrip() for x in text.split("\n")]
    return "\n".join(x for i, x in enumerate(lines) if x or (i and lines[i - 1])).strip()


def _pieces(text: str, offset: int, limit: int) -> list[tuple[str, int]]:
    """A long line in pieces of at most limit bytes, cut between characters."""
    out, part, size, at = [], [], 0, offset
    for ch in text:
        n = len(ch.encode("utf-8", "surrogatepass"))
        if part and size + n > limit:
            out.append(("".join(part), at))
            at, part, size = at + size, [], 0
        part.append(ch)
        size += n
    return out + ([("".join(part), at)] if part else [])


def chunks(text: str | None, target: int = CHUNK_BYTES) -> list[tuple[str, int]]:
    """(chunk, byte offset) of a text.

    A text of up to 1.25 targets is one chunk. Paragraphs are packed to a target, joined by an empty
    line; a paragraph above 1.5 targets is packed by lines, a line above 1.5 targets cut into pieces.
    """
    size = lambda s: len(s.encode("utf-8", "surrogatepass"))
    if not text or not text.strip():
        return []
    if size(text) <= target * 5 // 4:
        return [(text, 0)]
    units, at = [], 0  # text, offset, joiner before it
    for part in re.split(r"(\n(?:[ \t\r]*\n)+)", text):
        if part.strip():
            units.append((part, at))
        at += size(part)
    out: list[tuple[str, int]] = []

    def pack(items: list[tuple[str, int]], glue: str, finer) -> None:
        held, start, used = [], 0, 0
        for item, offset in items:
            n = size(item)
            if held and used + len(glue) + n > target:
                out.append((glue.join(held), start))
                held, used = [], 0
            if n > target * 3 // 2:
                if held:
                    out.append((glue.join(held), start))
                    held, used = [], 0
                finer(item, offset)
                continue
            if not held:
                start, used = offset, -len(glue)
            held.append(item)
            used += len(glue) + n
        if held:
            out.append((glue.join(held), start))

    def by_line(paragraph: str, offset: int) -> None:
        lines, at = [], offset
        for line in paragraph.split("\n"):
            if line.strip():
                lines.append((line, at))
            at += size(line) + 1
        pack(lines, "\n", lambda line, o: out.extend(_pieces(line, o, target)))

    pack(units, "\n\n", by_line)
    return out


# Elements without text, elements that break lines.
SILENT = frozenset("script style noscript svg math".split())
BREAKING = frozenset("address article aside blockquote body br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th title tr ul".split())


class _Plain(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.depth = [], 0

    def handle_starttag(self, tag, attrs):
        self.depth += tag in SILENT
        if tag in BREAKING:
            self.parts.append("\n")

    def handle_endtag(self, tag):
        self.depth = max(0, self.depth - (tag in SILENT))
        if tag in BREAKING:
            self.parts.append("\n")

    def handle_data(self, data):
        if not self.depth:
            self.parts.append(re.sub(r"\s+", " ", data))


_REFERENCE = re.compile(r"&(#\d+;|#[xX][\da-fA-F]+;|[A-Za-z\d]+;)?")


def html_text(page: str | None, open_references: bool = True) -> str:
    """All text of a page: one line per block, white space collapsed, scripts and styles left out.

    References without their semicolon are decoded as browsers do, or stay as they are if open_references is off.
    """
    page = page or ""
    if not open_references:
        page = _REFERENCE.sub(lambda m: m[0] if m[1] and (m[1][0] == "#" or m[1] in html5) else "&amp;" + m[0][1:], page)
    parser = _Plain()
    parser.feed(page)
    parser.close()
    lines = (re.sub(r"\s+", " ", x).strip() for x in "".join(parser.parts).split("\n"))
    return "\n".join(x for x in lines if x)


_CUE = re.compile(r"^\s*(?:\d+:)?\d{2}:\d{2}[,.]\d{3}\s+-->\s+")
_STRICT_CUE = re.compile(r"^\s*\d+:\d{2}:\d{2}[,.]\d{3}\s+-->")


def subtitle_text(text: str, strict: bool = False) -> str:
    """Dialogue of SRT, VTT and ASS subtitles, mark-up removed; strict accepts only cues that state hours."""
    out, inside = [], False
    for line in text.removeprefix("﻿").splitlines():
        if (_STRICT_CUE if strict else _CUE).match(line):
            inside = True
        elif not line.strip():
            inside = False
        elif inside:
            out.append(re.sub(r"<[^>]*>|\{[^}]*\}", "", line).strip())
        elif not strict and line.startswith("Dialogue:"):
            out.append(re.sub(r"\{[^}]*\}", "", line.split(",", 9)[-1]).replace("\\N", "\n").strip())
    return "\n".join(x for x in out if x)
