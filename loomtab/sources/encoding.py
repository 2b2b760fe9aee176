"""Encodings, byte-order marks, line endings and delimiters of files."""

from __future__ import annotations

import codecs
from collections import Counter

from ..plans.model import ConfigError, DecodeFailure, EncodeFailure, EncodingError

#: Names that files are given, and the codecs that read them (the Windows variant has the common extra characters).
CODECS = {"utf-8": "utf-8", "shift_jis": "cp932", "euc-jp": "euc_jp"}
DISPLAY = {"utf-8": "UTF-8", "shift_jis": "Shift_JIS", "euc-jp": "EUC-JP"}
DELIMITERS = {"comma": ",", "tab": "\t", "pipe": "|", "semicolon": ";"}
#: Bytes looked at from either end.
SAMPLE = 64 * 1024
LINE_SAMPLE = 1 << 20


def encoding_name(name: str) -> str:
    if name not in CODECS:
        raise EncodingError(f"encoding {name!r} is not supported; there are: {', '.join(CODECS)}")
    return name


def delimiter(alias: str) -> str:
    if alias not in DELIMITERS:
        raise ConfigError(f"delimiter {alias!r} is not known; there are: {', '.join(DELIMITERS)}")
    return DELIMITERS[alias]


def detect(raw: bytes) -> tuple[str, bool]:
    """(encoding, whether a byte-order mark is there): UTF-8 if it can be, a cut last character aside; else Shift_JIS."""
    if raw.startswith(codecs.BOM_UTF8):
        return "utf-8", True
    try:
        codecs.getincrementaldecoder("utf-8")("strict").decode(raw, final=False)
        return "utf-8", False
    except UnicodeDecodeError:
        return "shift_jis", False


def detect_file(raw: bytes) -> str:
    """From the first bytes and, if these are ASCII, the last ones; a character cut at the start of these does not count."""
    head = raw[:SAMPLE]
    if head.isascii() and len(raw) > SAMPLE:
        tail = raw[max(SAMPLE, len(raw) - SAMPLE) :]
        skip = 0
        while skip < 3 and skip < len(tail) and tail[skip] & 0xC0 == 0x80:
            skip += 1
        cut = detect(tail[skip:])[0]
        return cut if cut == "utf-8" else detect(tail)[0]
    return detect(head)[0]


def decode(raw: bytes, encoding: str, strict: bool = True, bom: bool = True) -> str:
    """Text without a byte-order mark (unless ``bom`` is false); malformed bytes are an error, or U+FFFD if not strict."""
    if bom and raw.startswith(codecs.BOM_UTF8) and encoding == "utf-8":
        raw = raw[3:]
    try:
        return raw.decode(CODECS[encoding], "strict" if strict else "replace")
    except UnicodeDecodeError as e:
        raise DecodeFailure(f"bytes that are not {encoding}, at {e.start}") from None


def encode(text: str, encoding: str) -> bytes:
    try:
        return text.encode(CODECS[encoding])
    except UnicodeEncodeError as e:
        raise EncodeFailure(f"{encoding} has no {text[e.start]!r}") from None


def line_ending(raw: bytes) -> str:
    """lf, crlf, mixed or none, of all newlines, those in quotes too."""
    both = raw.count(b"\r\n")
    alone = raw.count(b"\n") - both
    return "mixed" if both and alone else "crlf" if both else "lf" if alone else "none"


def guess_delimiter(text: str) -> str:
    """The candidate that gives most of the first 10 lines the same number of columns, of more than one."""
    lines = text.split("\n")
    lines = [x.removesuffix("\r") for x in (lines[:-1] if lines and not lines[-1] else lines)][:10]
    best, most = ",", (0, 0)
    for d in DELIMITERS.values():
        widths = Counter(x.count(d) + 1 for x in lines)
        if not widths:
            break
        width, rows = max(widths.items(), key=lambda w: w[1])  # of equal ones the first seen
        if width > 1 and (rows, width) > most:
            best, most = d, (rows, width)
    return best
