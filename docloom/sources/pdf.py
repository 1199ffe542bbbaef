"""A plain reader of PDF files: text of content streams and document information, without fonts' own encodings.

It reads unencrypted files whose streams are bare or deflated and whose strings are in a Latin
encoding or UTF-16; anything else gives no text, so that the next extractor is tried.
"""

from __future__ import annotations

import re
import zlib

_TOKEN = re.compile(rb"\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|[^\s\[\]()<>]+", re.DOTALL)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _string(raw: bytes) -> str:
    """The value of a literal or hexadecimal string."""
    if raw.startswith(b"<"):
        digits = re.sub(rb"\s", b"", raw[1:-1])
        data = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode("ascii"))
    else:
        one = lambda m: bytes([int(m[1], 8) & 255]) if m[1] else _ESCAPES.get(m[2], b"" if m[2] in b"\r\n" else m[2])
        data = re.sub(rb"\\(?:([0-7]{1,3})|(.))", one, raw[1:-1], flags=re.DOTALL)
    return data[2:].decode("utf-16-be", "replace") if data.startswith(b"\xfe\xff") else data.decode("cp1252", "replace")


def _streams(raw: bytes) -> list[bytes]:
    """Content streams in the order of the file, inflated where they are deflated."""
    out = []
    for m in re.finditer(rb"<<((?:[^<>]|<<[^<>]*>>|<[^<>]*>)*)>>\s*stream\r?\n(.*?)\r?\nendstream", raw, re.DOTALL):
        data = m[2]
        if b"/FlateDecode" in m[1]:
            try:
                data = zlib.decompress(data)
            except zlib.error:
                continue
        elif b"/Filter" in m[1]:
            continue
        if b"BT" in data and b"ET" in data:
            out.append(data)
    return out


def _shown(content: bytes) -> str:
    """What the text operators of a content stream show; moves to another line end one."""
    out: list[str] = []
    for block in re.findall(rb"\bBT\b(.*?)\bET\b", content, re.DOTALL):
        held: list[bytes] = []
        for token in _TOKEN.findall(block):
            if token in (b"Tj", b"TJ", b"'", b'"'):
                if token in (b"'", b'"'):
                    out.append("\n")
                out += [_string(h) if h[:1] in b"(<" else " " for h in held if h[:1] in b"(<" or (token == b"TJ" and re.fullmatch(rb"-\d{3,}(?:\.\d+)?", h))]
                held = []
            elif token in (b"T*", b"Td", b"TD", b"Tm"):
                out.append("\n")
                held = []
            elif re.fullmatch(rb"[A-Za-z*]+", token):
                held = []
            else:
                held.append(token)
        out.append("\n")
    return re.sub(r"\n{2,}", "\n", "".join(out)).strip()


def extract(raw: bytes) -> tuple[str, dict[str, str]]:
    """Text of all pages, blank lines between them, and what is known of the file."""
    if not raw.startswith(b"%PDF-"):
        raise ValueError("not a PDF file")
    info = {"page_count": str(len(re.findall(rb"/Type\s*/Page(?![A-Za-z])", raw))), "encrypted": str(b"/Encrypt" in raw).lower(), "bookmarks": str(len(re.findall(rb"/Dest\b", raw)))}
    if info["encrypted"] == "true":
        raise ValueError("encrypted")
    for name in ("Title", "Author", "Subject", "Keywords", "Creator", "Producer", "CreationDate", "ModDate"):
        if m := re.search(rb"/" + name.encode() + rb"\s*(\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]+>)", raw, re.DOTALL):
            info[name.lower()] = _string(m[1])
    return "\n\n".join(t for s in _streams(raw) if (t := _shown(s))), info
