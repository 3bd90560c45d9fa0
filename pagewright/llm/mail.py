"""Readable text of an archived mail: transfer encodings, multiparts, HTML and quoting undone."""

from __future__ import annotations

import base64
import binascii
import html
import quopri
import re

_PART = re.compile(r"(?m)^--[^\n]+\n(?=[ \t]*Content-)", re.I)
_HEADER_LINE = re.compile(r"[A-Za-z][A-Za-z0-9-]*:")
_ENCODING = re.compile(r"(?im)^Content-Transfer-Encoding:\s*([\w-]+)")
_TYPE = re.compile(r"(?im)^Content-Type:\s*([\w/.+-]+)(?:.*?charset=\"?([\w-]+))?")
_QUOTE = re.compile(r"(?m)^[ \t]*(?:[>|][ \t]?)+")
_BASE64_BODY = re.compile(r"(?:[A-Za-z0-9+/]{40,}={0,2}\s+){2,}[A-Za-z0-9+/=\s]*\Z")
_QP = re.compile(r"=[0-9A-F]{2}|=\r?\n")
_SILENT = re.compile(r"(?is)<(script|style|head)\b[^<>]*>.*?</\1\s*>|<!--.*?-->")
_INLINE_TAG = re.compile(r"(?i)</?(?:b|i|u|em|strong|span|font|a|tt|small|big|sub|sup|mark)\b[^<>]*>")
_TAG = re.compile(r"</?[A-Za-z!][^<>]*>")
_ENCODED_WORD = re.compile(r"=\?[\w-]+\?([BbQq])\?([^?\s]*)\?=")


def _bytes64(text: str) -> bytes:
    """Base64 that may be cut off or hold stray characters."""
    body = re.sub(r"[^A-Za-z0-9+/]", "", text)
    try:
        return base64.b64decode(body[: len(body) - len(body) % 4] + {0: "", 1: "", 2: body[-2:] + "==", 3: body[-3:] + "="}[len(body) % 4])
    except (binascii.Error, ValueError):
        return b""


def _decoded(raw: bytes, charset: str | None, text: bool) -> str:
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError as e:
        if not text:
            return ""
        if e.start >= len(raw) - 3:  # cut inside the last character
            return raw[: e.start].decode("utf-8")
        try:
            return raw.decode(charset or "latin-1", "replace")
        except LookupError:
            return raw.decode("latin-1")


def undo(body: str, head: str) -> str:
    """One part's text: transfer encoding, HTML and quoting undone."""
    enc = _ENCODING.search(head)
    enc = enc[1].lower() if enc else ""
    kind = _TYPE.search(head)
    text_kind = kind is None or kind[1].lower().startswith(("text/", "message/"))
    charset = kind[2] if kind else None
    if enc == "base64" or (not enc and _BASE64_BODY.fullmatch(body.strip() + "\n")):
        body = _decoded(_bytes64(body), charset, text_kind)
    elif enc == "quoted-printable" or (not enc and len(_QP.findall(body)) > 4 and re.search(r"=\r?\n", body)):
        body = _decoded(quopri.decodestring(body.encode("utf-8", "surrogatepass")), charset, True)
    if "<" in body and (kind is not None and "html" in kind[1].lower() or "</" in body):
        body = html.unescape(_TAG.sub(" ", _INLINE_TAG.sub("", _SILENT.sub(" ", body))))
    elif "&" in body and ";" in body:
        body = html.unescape(body)
    return _QUOTE.sub("", body) if ">" in body or "|" in body else body


def _encoded_word(m: re.Match) -> str:
    raw = _bytes64(m[2]) if m[1] in "Bb" else quopri.decodestring(m[2].replace("_", " ").encode())
    return _decoded(raw, None, True)


def readable(text: str | None) -> list[str]:
    """The header text and the text of every part.  Null and empty mails have none.

    Parts are found by their boundary lines and headers whether or not the
    boundary is declared; binary parts give nothing.
    """
    if not text:
        return []
    text = text.replace("\r\n", "\n")
    head, body = "", text
    if _HEADER_LINE.match(text):
        head, gap, body = text.partition("\n\n")
        if not gap:
            head, body = text, ""
    out = []
    if head:
        shown = _ENCODED_WORD.sub(_encoded_word, head) if "=?" in head else head
        out.append(re.sub(r"(?m)^[A-Za-z][A-Za-z0-9-]*:", "\n", shown))
    pieces = _PART.split(body)
    if len(pieces) == 1:
        out.append(undo(body, head))
        return out
    out.append(undo(pieces[0], ""))
    for piece in pieces[1:]:
        part_head, _, part_body = piece.partition("\n\n")
        part_body = re.sub(r"\n--[^\n]*--[ \t]*\n?\s*\Z", "\n", part_body)
        out.append(undo(part_body, part_head))
    return [x for x in out if x]
