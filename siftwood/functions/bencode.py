"""Bencode of integers, byte strings, lists and dictionaries."""

from __future__ import annotations


def encode(value) -> bytes:
    if isinstance(value, int):
        return b"i%de" % value
    if isinstance(value, str):
        value = value.encode()
    if isinstance(value, (bytes, bytearray)):
        return b"%d:%s" % (len(value), bytes(value))
    if isinstance(value, (list, tuple)):
        return b"l" + b"".join(map(encode, value)) + b"e"
    items = sorted((k.encode() if isinstance(k, str) else k, v) for k, v in value.items())
    return b"d" + b"".join(encode(k) + encode(v) for k, v in items) + b"e"


def decode(data: bytes):
    """The one value that data holds; anything else raises ValueError."""

    def read(at: int):
        kind = data[at : at + 1]
        if kind == b"i":
            end = data.index(b"e", at)
            return int(data[at + 1 : end]), end + 1
        if kind in (b"l", b"d"):
            out, at = [], at + 1
            while data[at : at + 1] != b"e":
                if at >= len(data):
                    raise ValueError("bencode is cut")
                value, at = read(at)
                out.append(value)
            return (out if kind == b"l" else dict(zip(out[::2], out[1::2], strict=True))), at + 1
        colon = data.index(b":", at)
        end = colon + 1 + int(data[at:colon])
        if end > len(data):
            raise ValueError("bencode is cut")
        return data[colon + 1 : end], end

    value, end = read(0)
    if end != len(data):
        raise ValueError("bytes after the value")
    return value
