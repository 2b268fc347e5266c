"""The texts and the title of plain PDF files, without a parser of the whole format.

It reads content streams that are plain or deflated, and strings shown with Tj, TJ, ' and " in single-byte encodings. Pages
are counted by their objects. Encrypted files, object streams and fonts with encodings of their own need another reader, which
``runs.index`` takes as a function.
"""

from __future__ import annotations

import re
import zlib

_STREAM = re.compile(rb"<<(?P<head>.*?)>>\s*stream\r?\n(?P<body>.*?)\r?\n?endstream", re.S)
_SHOWN = re.compile(rb"\((?P<s>(?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*)\)\s*(?P<op>Tj|'|\")|\[(?P<a>(?:[^\[\]()]|\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\))*)\]\s*TJ|(?P<line>T\*|Td|TD|ET)", re.S)
_STRING = re.compile(rb"\(((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*)\)", re.S)
_ESCAPED = re.compile(rb"\\([nrtbf()\\]|[0-7]{1,3}|\r?\n)")
_NAMES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _plain(raw: bytes) -> str:
    def one(m: re.Match) -> bytes:
        c = m[1]
        return bytes([int(c, 8) & 255]) if c[:1].isdigit() else b"" if c.endswith(b"\n") else _NAMES.get(c, c)

    raw = _ESCAPED.sub(one, raw)
    return raw[2:].decode("utf-16-be", "replace") if raw.startswith(b"\xfe\xff") else raw.decode("latin-1")


def _shown(stream: bytes) -> str:
    out = []
    for m in _SHOWN.finditer(stream):
        if m["line"]:
            out.append("\n")
        elif m["a"] is not None:
            out.append("".join(_plain(x) for x in _STRING.findall(m["a"])))
        else:
            out.append(("" if m["op"] == b"Tj" else "\n") + _plain(m["s"]))
    return re.sub(r"\n+", "\n", "".join(out)).strip()


def read(content: bytes) -> tuple[str, int, dict]:
    """The text with a header for each content stream that shows any, the number of pages, and title and author if they are given."""
    if not content.startswith(b"%PDF-"):
        raise ValueError("not a PDF file")
    if b"/Encrypt" in content:
        raise ValueError("the PDF file is encrypted")
    texts = []
    for m in _STREAM.finditer(content):
        body = m["body"]
        if b"FlateDecode" in m["head"]:
            body = zlib.decompressobj().decompress(body)
        elif b"/Filter" in m["head"]:
            continue
        if (b"Tj" in body or b"TJ" in body) and (text := _shown(body)):
            texts.append(text)
    pages = len(re.findall(rb"/Type\s*/Page(?![a-zA-Z])", content))
    info = {k: _plain(m[1]).strip() for k, name in (("title", b"Title"), ("author", b"Author")) if (m := re.search(rb"/" + name + rb"\s*\(((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*)\)", content, re.S))}
    return "\n\n".join(f"[Page {k}]\n{t}" for k, t in enumerate(texts, 1)), pages or len(texts), info
