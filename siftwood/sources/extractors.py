"""Text of files by format: a registry of extractors behind one table function."""

from __future__ import annotations

import gzip
import io
import lzma
import mimetypes
import re
import struct
import tarfile
import zipfile
import zlib
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwood.functions.text import chunks, html_text, sanitised, squeezed_lines, subtitle_text

MB = 1 << 20
#: Largest text file, largest container.
TEXT_CAP, CONTAINER_CAP = 32 * MB, 256 * MB
# Types of extensions that the platform's table lacks or gets wrong.
TYPES = dict(
    txt="text/plain", text="text/plain", md="text/markdown", markdown="text/markdown", srt="application/x-subrip", vtt="text/vtt", ass="text/x-ssa", ssa="text/x-ssa", log="text/plain",
    go="text/x-go", py="text/x-python", js="text/javascript", ts="text/x-typescript", rs="text/x-rust", c="text/x-c", cc="text/x-c++", cpp="text/x-c++", h="text/x-c", hpp="text/x-c++",
    java="text/x-java", rb="text/x-ruby", sh="text/x-shellscript", yaml="text/x-yaml", yml="text/x-yaml", toml="text/x-toml", epub="application/epub+zip",
    docx="application/vnd.openxmlformats-officedocument.wordprocessingml.document", odt="application/vnd.oasis.opendocument.text", rtf="application/rtf", tar="application/x-tar", tgz="application/gzip",
    fb2="application/x-fictionbook+xml", pptx="application/vnd.openxmlformats-officedocument.presentationml.presentation", odp="application/vnd.oasis.opendocument.presentation",
    mobi="application/x-mobipocket-ebook", azw="application/vnd.amazon.ebook", azw3="application/vnd.amazon.ebook", mp3="audio/mpeg", jpg="image/jpeg", jpeg="image/jpeg", flac="audio/flac",
    ogg="audio/ogg", oga="audio/ogg", opus="audio/opus", mkv="video/x-matroska", mka="video/x-matroska", webm="video/webm", mp4="video/mp4", m4a="audio/mp4", m4b="audio/mp4", m4v="video/mp4", zim="application/x-zim",
)


def extension(path: str) -> str:
    name = path.rsplit("/", 1)[-1]
    return name.rsplit(".", 1)[-1].lower() if "." in name else ""


def mime_of(path: str) -> str:
    """The type of a path by its extension, without parameters; empty if unknown."""
    ext = extension(path)
    return TYPES.get(ext) or (mimetypes.guess_type("x." + ext)[0] or "" if ext else "")


class Unsupported(ValueError):
    """The bytes aren't of the format."""


def plain(data: bytes) -> str:
    if b"\0" in data[:4096]:
        raise Unsupported("binary data")
    return sanitised(data[:TEXT_CAP])


def subtitle(data: bytes) -> str:
    return subtitle_text(sanitised(data))


def _xml(data: bytes) -> ElementTree.Element:
    return ElementTree.fromstring(data)


def _name(e: ElementTree.Element) -> str:
    return e.tag.rsplit("}", 1)[-1] if isinstance(e.tag, str) else ""


def _flow(e: ElementTree.Element, ends: dict[str, str], silent: frozenset, only: str | None = None) -> str:
    """Text below an element in order; `ends` follows the named elements; only the text of `only` elements counts if given."""
    out: list[str] = []

    def walk(x: ElementTree.Element, on: bool) -> None:
        name = _name(x)
        if name in silent:
            return
        on = on or name == only
        if on and x.text:
            out.append(x.text)
        for y in x:
            walk(y, on and only is None)
            if only is None and y.tail:
                out.append(y.tail)
        out.append(ends.get(name, ""))

    walk(e, only is None)
    return "".join(out)


def _zip(data: bytes) -> zipfile.ZipFile:
    try:
        return zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile as e:
        raise Unsupported(str(e)) from e


def epub(data: bytes) -> str:
    z, parts = _zip(data), []
    for name in sorted(n for n in z.namelist() if n.lower().endswith((".xhtml", ".html", ".htm")) and not n.startswith("META-INF/")):
        try:
            parts.append(html_text(sanitised(z.read(name))))
        except (zipfile.BadZipFile, zlib.error, KeyError):
            continue
    return "\n\n".join(p for p in parts if p)


def docx(data: bytes) -> str:
    return _flow(_xml(_zip(data).read("word/document.xml")), {"p": "\n\n", "tab": " ", "br": " ", "cr": " "}, frozenset(), "t").strip()


def open_document(data: bytes) -> str:
    root = _xml(_zip(data).read("content.xml"))
    return _flow(root, {"p": "\n\n", "h": "\n\n", "s": " ", "tab": " ", "line-break": " "}, frozenset(("automatic-styles", "styles", "font-face-decls", "scripts"))).strip()


def pptx(data: bytes) -> str:
    z = _zip(data)
    slides = sorted((int(m[1]), n) for n in z.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
    return "\n\n".join(t for _, n in slides if (t := _flow(_xml(z.read(n)), {"p": "\n"}, frozenset(), "t").strip()))


_PDF_STREAM = re.compile(rb"<<(.*?)>>\s*stream\r?\n(.*?)\r?\nendstream", re.S)
_PDF_TEXT = re.compile(rb"\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]+>|\bT\*|\bT[dDm]\b|\bET\b|'|\"")
_PDF_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"", b"f": b"", b"\n": b""}


def pdf(data: bytes) -> str:
    """Strings that a PDF's content streams show, in order of the file: plain and deflated streams of simple fonts."""
    if not data.startswith(b"%PDF-"):
        raise Unsupported("not a PDF")
    out: list[str] = []
    for head, body in _PDF_STREAM.findall(data):
        if b"FlateDecode" in head:
            try:
                body = zlib.decompressobj().decompress(body, CONTAINER_CAP)
            except zlib.error:
                continue
        elif b"/Filter" in head:
            continue
        for block in re.findall(rb"\bBT\b(.*?\bET\b)", body, re.S):
            for x in _PDF_TEXT.findall(block):
                if x.startswith(b"("):
                    s = re.sub(rb"\\([0-7]{1,3}|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1].isdigit() else _PDF_ESCAPES.get(m[1], m[1]), x[1:-1], flags=re.S)
                    out.append(s.decode("utf-16") if s.startswith(b"\xfe\xff") else s.decode("cp1252", "replace"))
                elif x.startswith(b"<"):
                    s = bytes.fromhex((h := re.sub(rb"\s", b"", x[1:-1]).decode()) + "0" * (len(h) % 2))
                    out.append(s.decode("utf-16") if s.startswith(b"\xfe\xff") else s.decode("cp1252", "replace"))
                else:
                    out.append("\n")
    return squeezed_lines("".join(out))


# Groups of a rich-text file that hold no text, and control words that stand for characters.
RTF_SILENT = frozenset("fonttbl stylesheet colortbl info pict bin header footer footnote listtable rsidtbl generator".split())
RTF_CHARS = dict(par="\n", line="\n", sect="\n", page="\n", tab="\t", emdash="—", endash="–", lquote="‘", rquote="’", ldblquote="“", rdblquote="”", bullet="•", cell="\t", row="\n")
_RTF = re.compile(r"\\([a-zA-Z]+)(-?\d+)? ?|\\'([0-9a-fA-F]{2})|\\(.)|([{}])|([^\\{}\r\n]+)|[\r\n]+", re.S)


def rtf(data: bytes) -> str:
    text = data.decode("latin-1")
    if not text.startswith("{\\rtf"):
        raise Unsupported("not rich text")
    out: list[str] = []
    stack, silent, skip, wide = [], False, 0, 1
    for m in _RTF.finditer(text):
        word, number, code, sign, brace, run = m.groups()
        if brace == "{":
            stack.append((silent, wide))
        elif brace == "}":
            silent, wide = stack.pop() if stack else (False, 1)
        elif word:
            if word in RTF_SILENT:
                silent = True
            elif word == "uc":
                wide = int(number or 1)
            elif word == "u" and number and not silent:
                out.append(chr(int(number) % 65536))
                skip = wide
                continue
            elif word in RTF_CHARS and not silent:
                out.append(RTF_CHARS[word])
        elif code:
            if skip:
                skip -= 1
                continue
            if not silent:
                out.append(bytes.fromhex(code).decode("cp1252", "replace"))
        elif sign == "*":
            silent = True
        elif sign and not silent:
            out.append({"~": "\u00a0", "_": "-", "-": ""}.get(sign, sign))
        elif run:
            run, skip = run[skip:], 0
            if not silent:
                out.append(run)
    joined = "".join(out).encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    return squeezed_lines(joined)


def fb2(data: bytes) -> str:
    return squeezed_lines(_flow(_xml(data), {"p": "\n", "v": "\n", "title": "\n\n", "section": "\n\n"}, frozenset(("binary", "stylesheet"))))


def _labelled(rows: list[tuple[str, str]]) -> str:
    return "\n".join(f"{k}: {v}" for k, v in rows if v)


# Tags of e-books, audio, video and pictures with their labels.
EXTH = {100: "Author", 101: "Publisher", 103: "Description", 104: "ISBN", 105: "Subject", 106: "Published", 503: "Title", 524: "Language"}
ID3 = {"TIT2": "Title", "TPE1": "Artist", "TPE2": "Album artist", "TALB": "Album", "TDRC": "Year", "TYER": "Year", "TCON": "Genre", "TRCK": "Track", "TPUB": "Publisher", "COMM": "Comment", "USLT": "Lyrics"}
VORBIS = {"TITLE": "Title", "ARTIST": "Artist", "PERFORMER": "Performer", "ALBUM": "Album", "ALBUMARTIST": "Album artist", "DATE": "Date", "YEAR": "Date", "GENRE": "Genre", "TRACKNUMBER": "Track", "DISCNUMBER": "Disc", "COMPOSER": "Composer", "DESCRIPTION": "Comment", "COMMENT": "Comment", "ORGANIZATION": "Label", "LABEL": "Label", "ISRC": "ISRC", "COPYRIGHT": "Copyright"}
MP4 = {"\xa9nam": "Title", "\xa9ART": "Artist", "aART": "Album artist", "\xa9alb": "Album", "\xa9day": "Date", "\xa9gen": "Genre", "gnre": "Genre", "\xa9wrt": "Composer", "\xa9too": "Encoder", "\xa9cmt": "Comment", "desc": "Description", "\xa9grp": "Grouping", "cprt": "Copyright", "trkn": "Track", "disk": "Disc"}
EXIF = {0x010F: "Camera make", 0x0110: "Camera model", 0x0131: "Software", 0x013B: "Artist", 0x010E: "Image description", 0x8298: "Copyright", 0x9003: "Date taken", 0x9004: "Date digitised", 0x0132: "Date", 0x8825: "GPS"}
MKV_GROUPS = {0x18538067, 0x1549A966, 0x1654AE6B, 0xAE, 0x1043A770, 0x45B9, 0xB6, 0x80}
MKV_TEXTS = {0x7BA9: "Title", 0x4D80: "Muxer", 0x5741: "Writer", 0x536E: "Track", 0x22B59C: "Language", 0x85: "Chapter"}


def mobi(data: bytes) -> str:
    if data[60:68] not in (b"BOOKMOBI", b"TEXtREAd"):
        raise Unsupported("not a book")
    start = struct.unpack_from(">I", data, 78)[0]
    if data[start + 16 : start + 20] != b"MOBI":
        raise Unsupported("no book header")
    size, _, code = struct.unpack_from(">III", data, start + 20)
    charset = "utf-8" if code == 65001 else "cp1252"
    at, n = struct.unpack_from(">II", data, start + 84)
    rows = [("Title", data[start + at : start + at + n].decode(charset, "replace").strip("\0 "))]
    head = start + 16 + size
    if data[head : head + 4] == b"EXTH":
        at = head + 12
        for _ in range(struct.unpack_from(">I", data, head + 8)[0]):
            kind, n = struct.unpack_from(">II", data, at)
            if n < 8:
                break
            if kind in EXTH:
                rows.append((EXTH[kind], data[at + 8 : at + n].decode(charset, "replace").strip("\0 ")))
            at += n
    return _labelled(rows)


def _synchsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def id3(data: bytes) -> str:
    if data[:3] != b"ID3" or data[3] not in (3, 4):
        raise Unsupported("no tag")
    at, end, rows = 10, 10 + _synchsafe(data[6:10]), []
    if data[5] & 0x40:
        at += _synchsafe(data[10:14]) if data[3] == 4 else 4 + struct.unpack_from(">I", data, 10)[0]
    while at + 10 <= min(end, len(data)) and data[at]:
        name = data[at : at + 4].decode("latin-1")
        n = _synchsafe(data[at + 4 : at + 8]) if data[3] == 4 else struct.unpack_from(">I", data, at + 4)[0]
        body, at = data[at + 10 : at + 10 + n], at + 10 + n
        if name in ID3 and body:
            charset = ("latin-1", "utf-16", "utf-16-be", "utf-8")[body[0]] if body[0] < 4 else "latin-1"
            text = body[1:]
            if name in ("COMM", "USLT"):
                text, gap = text[3:], b"\0\0" if body[0] in (1, 2) else b"\0"
                cut = next((i for i in range(0, len(text), len(gap)) if text[i : i + len(gap)] == gap), -len(gap))
                text = text[cut + len(gap) :]
            rows.append((ID3[name], text.decode(charset, "replace").replace("\0", " ").strip()))
    return _labelled(rows)


def _vorbis(b: bytes) -> str:
    n = struct.unpack_from("<I", b)[0]
    at, rows = 8 + n, []
    for _ in range(struct.unpack_from("<I", b, 4 + n)[0]):
        if at + 4 > len(b):
            break
        size = struct.unpack_from("<I", b, at)[0]
        name, _, value = b[at + 4 : at + 4 + size].decode("utf-8", "replace").partition("=")
        if name.upper() in VORBIS:
            rows.append((VORBIS[name.upper()], value.strip()))
        at += 4 + size
    return _labelled(rows)


def flac(data: bytes) -> str:
    if data[:4] != b"fLaC":
        raise Unsupported("not flac")
    at = 4
    while at + 4 <= len(data):
        kind, n = data[at], int.from_bytes(data[at + 1 : at + 4], "big")
        if kind & 0x7F == 4:
            return _vorbis(data[at + 4 : at + 4 + n])
        if kind & 0x80:
            break
        at += 4 + n
    return ""


def ogg(data: bytes) -> str:
    if data[:4] != b"OggS":
        raise Unsupported("not ogg")
    at, packets, part = 0, [], b""
    for _ in range(32):
        if data[at : at + 4] != b"OggS":
            break
        table = data[at + 27 : at + 27 + data[at + 26]]
        at += 27 + len(table)
        for n in table:
            part, at = part + data[at : at + n], at + n
            if n < 255:
                packets.append(part)
                part = b""
    for p in packets:
        if p.startswith((b"\x03vorbis", b"OpusTags")):
            return _vorbis(p[7:] if p[0] == 3 else p[8:])
    return ""


def _varint(b: bytes, at: int, keep: bool) -> tuple[int, int]:
    if at >= len(b) or not b[at]:
        raise IndexError
    n = 9 - b[at].bit_length()
    value = int.from_bytes(b[at : at + n], "big")
    return (value if keep else value & ((1 << (7 * n)) - 1)), at + n


def mkv(data: bytes) -> str:
    if data[:4] != b"\x1a\x45\xdf\xa3":
        raise Unsupported("not matroska")
    rows: list[tuple[str, str]] = []

    def walk(at: int, end: int, depth: int) -> None:
        while at < end:
            try:
                kind, at = _varint(data, at, True)
                start = at
                n, at = _varint(data, at, False)
            except IndexError:
                return
            stop = end if n == (1 << (7 * (at - start))) - 1 else min(end, at + n)
            if kind in MKV_TEXTS:
                rows.append((MKV_TEXTS[kind], data[at:stop].decode("utf-8", "replace").strip("\0 ")))
            elif kind in MKV_GROUPS and depth < 8:
                walk(at, stop, depth + 1)
            at = stop

    walk(0, len(data), 0)
    return _labelled(rows)


def mp4(data: bytes) -> str:
    if data[4:8] != b"ftyp":
        raise Unsupported("not mp4")
    rows: list[tuple[str, str]] = []

    def walk(at: int, end: int, depth: int, label: str | None) -> None:
        while at + 8 <= end:
            n, kind, head = struct.unpack_from(">I", data, at)[0], data[at + 4 : at + 8].decode("latin-1"), 8
            if n == 1 and at + 16 <= end:
                n, head = struct.unpack_from(">Q", data, at + 8)[0], 16
            stop = end if not n else min(end, at + n)
            if stop < at + head:
                return
            if kind == "data" and label:
                form, body = struct.unpack_from(">I", data, at + 8)[0] & 0xFFFFFF, data[at + 16 : stop]
                if form == 1:
                    rows.append((label, body.decode("utf-8", "replace").strip()))
                elif label in ("Track", "Disc") and len(body) >= 6:
                    rows.append((label, "/".join(str(x) for x in struct.unpack_from(">HH", body, 2) if x)))
            elif depth < 8 and (kind in ("moov", "udta", "meta", "ilst") or kind in MP4):
                walk(at + head + 4 * (kind == "meta"), stop, depth + 1, MP4.get(kind))
            at = stop

    walk(0, len(data), 0, None)
    return _labelled(rows)


def exif(data: bytes) -> str:
    if data[:2] != b"\xff\xd8":
        raise Unsupported("not a picture")
    at, t = 2, b""
    while at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] != 0xDA:
        n = struct.unpack_from(">H", data, at + 2)[0]
        if data[at + 1] == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
            t = data[at + 10 : at + 2 + n]
            break
        at += 2 + n
    if len(t) < 8:
        return ""
    order = {b"II": "<", b"MM": ">"}.get(t[:2])
    if order is None:
        raise Unsupported("bad byte order")
    sizes = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}

    def directory(at: int) -> dict[int, object]:
        out: dict[int, object] = {}
        if not 0 < at <= len(t) - 2:
            return out
        for i in range(struct.unpack_from(order + "H", t, at)[0]):
            p = at + 2 + 12 * i
            if p + 12 > len(t):
                break
            tag, kind, n = struct.unpack_from(order + "HHI", t, p)
            size = sizes.get(kind, 0) * n
            where = p + 8 if size <= 4 else struct.unpack_from(order + "I", t, p + 8)[0]
            raw = t[where : where + size]
            if not size or len(raw) < size:
                continue
            if kind == 2:
                out[tag] = raw.split(b"\0")[0].decode("utf-8", "replace").strip()
            elif kind in (3, 4):
                out[tag] = struct.unpack(order + {3: "H", 4: "I"}[kind] * n, raw)[0]
            elif kind == 5:
                pairs = struct.unpack(order + "II" * n, raw)
                out[tag] = [a / b if b else 0.0 for a, b in zip(pairs[::2], pairs[1::2], strict=True)]
        return out

    tags = directory(struct.unpack_from(order + "I", t, 4)[0])
    if isinstance(tags.get(0x8769), int):
        tags |= {k: v for k, v in directory(tags[0x8769]).items() if k in EXIF}
    if isinstance(tags.get(0x8825), int):
        gps = directory(tags.pop(0x8825))
        degrees = lambda v: v[0] + v[1] / 60 + v[2] / 3600
        lat, lon = gps.get(2), gps.get(4)
        if isinstance(lat, list) and isinstance(lon, list) and len(lat) == len(lon) == 3:
            tags[0x8825] = f"{gps.get(1, '')}{degrees(lat):.4f}, {gps.get(3, '')}{degrees(lon):.4f}"
    return _labelled([(label, str(tags[k])) for k, label in EXIF.items() if isinstance(tags.get(k), str)])


def _tar(data: bytes) -> tarfile.TarFile:
    try:
        return tarfile.open(fileobj=io.BytesIO(data), mode="r:")
    except tarfile.ReadError:  # compressed otherwise
        return tarfile.open(fileobj=io.BytesIO(data))


def archive(data: bytes) -> str:
    """Names of an archive's files, sorted."""
    if data[:4] in (b"PK\x03\x04", b"PK\x05\x06"):
        names = [x.filename for x in _zip(data).infolist() if not x.is_dir()]
    else:
        try:
            names = [x.name for x in _tar(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data) if not x.isdir()]
        except (tarfile.TarError, OSError, EOFError) as e:
            raise Unsupported(str(e)) from e
    return "\n".join(sorted(names))


def _cluster(raw: bytes) -> tuple[str, bytes]:
    """(form of its offsets, content) of a ZIM cluster."""
    kind, body = raw[0], raw[1:]
    if kind & 15 == 4:
        body = lzma.LZMADecompressor().decompress(body)
    elif kind & 15 == 5:
        import zstandard

        body = zstandard.ZstdDecompressor().decompressobj().decompress(body)
    elif kind & 15 not in (0, 1):
        raise Unsupported("cluster compression")
    return "<Q" if kind & 16 else "<I", body


def zim(data: bytes) -> list[str]:
    """Texts of all HTML and plain articles of a ZIM file, one each, in the order of its list; redirects are skipped, and articles that can't be read.

    Articles are read cluster by cluster, so besides the texts one open cluster is held.
    """
    if data[:4] != b"ZIM\x04":
        raise Unsupported("not zim")
    count, clusters, urls, _, cluster_list, mimes = struct.unpack_from("<II8x8x8x", data, 24)[0:2] + struct.unpack_from("<QQQQ", data, 32)
    types = data[mimes : data.index(b"\0\0", mimes)].decode("utf-8", "replace").split("\0")
    wanted: dict[int, list[tuple[int, int, bool]]] = {}
    for k in range(count):
        try:
            at = struct.unpack_from("<Q", data, urls + 8 * k)[0]
            kind = struct.unpack_from("<H", data, at)[0]
            if kind >= 0xFFFD or kind >= len(types) or not types[kind].startswith(("text/html", "text/plain")):
                continue
            cluster, i = struct.unpack_from("<II", data, at + 8)
        except struct.error:
            continue
        if cluster < clusters:
            wanted.setdefault(cluster, []).append((k, i, types[kind].startswith("text/html")))
    texts: dict[int, str] = {}
    for cluster, own in wanted.items():
        try:
            start = struct.unpack_from("<Q", data, cluster_list + 8 * cluster)[0]
            end = struct.unpack_from("<Q", data, cluster_list + 8 * (cluster + 1))[0] if cluster + 1 < clusters else len(data)
            form, body = _cluster(data[start:end])
        except Exception:  # noqa: BLE001  each compression has its own errors; the other clusters' articles count
            continue
        size = struct.calcsize(form)
        for k, i, html in own:
            try:
                a, b = struct.unpack_from(form, body, size * i)[0], struct.unpack_from(form, body, size * (i + 1))[0]
            except struct.error:
                continue
            text = sanitised(body[a:b])
            texts[k] = html_text(text) if html else text.strip()
    return [texts[k] for k in sorted(texts) if texts[k]]


Extract = Callable[[bytes], "str | list[str]"]
#: name, claim by (type, extension, size), function; the first claim wins.
REGISTRY: list[tuple[str, Callable[[str, str, int], bool], Extract]] = []


def register(name: str, claim: Callable[[str, str, int], bool], extract: Extract) -> None:
    """Add an extractor behind those that are there."""
    REGISTRY.append((name, claim, extract))


def _of(*ext: str, cap: int = CONTAINER_CAP) -> Callable[[str, str, int], bool]:
    types = {TYPES.get(e) for e in ext} - {None}
    return lambda mime, e, size: size <= cap and (e in ext or mime in types)


for _n, _c, _f in (
    ("subtitle", _of("srt", "vtt", "ass", "ssa", cap=TEXT_CAP), subtitle),
    ("epub", _of("epub"), epub), ("docx", _of("docx"), docx), ("odt", _of("odt"), open_document), ("odp", _of("odp"), open_document), ("pptx", _of("pptx"), pptx),
    ("pdf", lambda m, e, s: s <= CONTAINER_CAP and (e == "pdf" or m == "application/pdf"), pdf),
    ("rtf", _of("rtf"), rtf), ("fb2", _of("fb2"), fb2), ("mobi", _of("mobi", "azw", "azw3"), mobi), ("id3", _of("mp3", cap=1024 * MB), id3), ("flac", _of("flac", cap=1024 * MB), flac),
    ("ogg", _of("ogg", "oga", "opus", cap=1024 * MB), ogg), ("mkv", _of("mkv", "mka", "webm", cap=1024 * MB), mkv), ("mp4", _of("mp4", "m4a", "m4b", "m4v", cap=1024 * MB), mp4), ("exif", _of("jpg", "jpeg"), exif),
    ("archive", lambda m, e, s: s <= CONTAINER_CAP and e in ("zip", "tar", "tgz", "gz"), archive), ("zim", lambda m, e, s: e == "zim" or m == TYPES["zim"], zim),
    ("plaintext", lambda m, e, s: s <= TEXT_CAP and (m.startswith("text/") or m in ("application/json", "application/xml", "application/javascript", "application/xhtml+xml")), plain),
):
    register(_n, _c, _f)


def claimed(path: str, size: int) -> tuple[str, str, Extract] | None:
    """(type, extractor, function) of the first extractor that claims a file."""
    mime, ext = mime_of(path), extension(path)
    return next(((mime, n, f) for n, claim, f in REGISTRY if claim(mime, ext, size)), None)


def extract(path: str, data: bytes) -> tuple[str, str, str, list[tuple[str, int]]]:
    """(type, extractor, outcome, chunks) of a file: outcome is extracted, or skipped if nothing claims it or it has no text."""
    found = claimed(path, len(data))
    if found is None:
        return mime_of(path), "", "skipped", []
    mime, name, f = found
    try:
        text = f(bytes(data))
    except Exception:  # noqa: BLE001  a file that breaks its extractor is skipped, never the task
        return mime, name, "skipped", []
    if isinstance(text, list):
        parts = [(t, 0) for t in text]
    elif name in ("plaintext", "epub", "docx", "odt", "odp", "pptx", "pdf", "rtf", "fb2"):
        parts = chunks(text)
    else:
        parts = [(text, 0)] if text.strip() else []
    return mime, name, "extracted" if parts else "skipped", parts


SCHEMA = "path string, file_size long, mime string, extractor string, outcome string, chunk_index int, text string, offset long"


def extracted(files: DataFrame) -> DataFrame:
    """files(path, length, content) as rows of chunks; a skipped file has one row without text."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for path, size, data in zip(f.path, f.length, f.content, strict=True):
                mime, name, outcome, parts = extract(path, data)
                out += [(path, size, mime, name, outcome, i, t, o) for i, (t, o) in enumerate(parts)] or [(path, size, mime, name, outcome, None, None, None)]
            frame = pd.DataFrame(out, columns=["path", "file_size", "mime", "extractor", "outcome", "chunk_index", "text", "offset"])
            yield frame.astype({"chunk_index": "Int32", "offset": "Int64"})

    return files.select("path", "length", "content").mapInPandas(run, SCHEMA)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Files below a folder as (path, length, content); files that nothing claims are never opened, as the test runs on their names."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    known = sorted(set(TYPES) | {"pdf", "zip", "gz", "html", "htm", "xhtml", "json", "xml", "csv", "css"})
    return rows.filter(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(known)).select("path", "length", "content")


def folder_bytes(spark: SparkSession, path: str) -> DataFrame:
    """One row: files below a folder and their bytes; contents aren't read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return rows.agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))
