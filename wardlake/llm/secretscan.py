"""Secrets in texts and in the layers hidden inside them: URL and Unicode escapes, base64, compressed data.

Each text is a worklist of layers. A layer is scanned, then every encoded piece in it is unwrapped to a
further layer, until no new one appears; layers met before (by digest) are not taken again, which ends
cycles. Each character of a layer knows the stretch of the text it comes from, so that what is found
anywhere gets a span in the text itself. Compressed layers are unpacked and scanned block by block, so
that a small input that unpacks to a very large one needs little memory; an encoded run that a block's end
cuts is carried to the next block, up to HOLD bytes. A base64 run that is no text as a whole is taken apart:
its lines and segments that are text, and all of it at each of the four alignments, as it may be glued to
other characters of the class. A value found there may take in characters that are glued to its end.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from wardlake.llm.common import by_batch, longs

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a longest run of the class is a match; shorter ones fail anyway
KINDS = ("assign", "access", "hex")
WORDS_ASSIGNED = ("password", "passwd", "secret", "token", "api")

PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(r"(?:\\u[0-9a-fA-F]{4}|\\U[0-9a-fA-F]{8}|\\u\{[0-9a-fA-F]{1,6}\}|\\x[0-9a-fA-F]{2})+")
ESCAPE_UNIT = re.compile(r"\\u([0-9a-fA-F]{4})|\\U([0-9a-fA-F]{8})|\\u\{([0-9a-fA-F]{1,6})\}|\\x([0-9a-fA-F]{2})")
CODED = re.compile(r"[A-Za-z0-9+/_-]{16,}(?:\r?\n[A-Za-z0-9+/_-]{16,})*(?P<last>\r?\n[A-Za-z0-9+/_-]{1,15}(?![A-Za-z0-9+/_-]))?={0,2}")
CODED_LINE = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
SEGMENT = re.compile(r"[A-Za-z0-9+]{16,}={0,2}")
GLUE = re.compile(r"(?<=[/_-])[^/_-]")
OPEN = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-=%{}\\\r\n"  # bytes of encoded runs
MAGIC = (b"\x1f\x8b\x08", b"BZh", b"\xfd7zXZ\x00")
BLOCK = 1 << 22
OVERLAP = 1 << 12
HOLD = 1 << 22


class Layer(NamedTuple):
    text: str
    starts: np.ndarray | None  # where in the whole text each character begins; None: the text itself
    ends: np.ndarray | None

    def origin(self, start: int, end: int) -> tuple[int, int]:
        if self.starts is None:
            return start, end
        return int(self.starts[start:end].min()), int(self.ends[start:end].max())


def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of the secrets of one layer."""
    found = []
    low = text.lower()
    if any(w in low for w in WORDS_ASSIGNED):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def _replaced(layer: Layer, pieces: list[tuple[int, int, str, list[tuple[int, int]]]]) -> Layer:
    """The layer with pieces (start, end, what it says, source stretch of each character) put in place."""
    n = len(layer.text)
    starts = np.arange(n) if layer.starts is None else layer.starts
    ends = np.arange(1, n + 1) if layer.ends is None else layer.ends
    out, s_out, e_out, at = [], [], [], 0
    for start, end, says, stretches in pieces:
        out += [layer.text[at:start], says]
        s_out += [starts[at:start], np.array([starts[a] for a, _ in stretches], np.int64)]
        e_out += [ends[at:start], np.array([ends[b - 1] for _, b in stretches], np.int64)]
        at = end
    out.append(layer.text[at:])
    return Layer("".join(out), np.concatenate([*s_out, starts[at:]]), np.concatenate([*e_out, ends[at:]]))


def _sized(raw: bytes) -> tuple[str, np.ndarray]:
    """Bytes as text (each that is no UTF-8 becomes the replacement character), and where each character begins, with the end."""
    says = raw.decode("utf-8", "surrogateescape")
    code = np.frombuffer(says.encode("utf-32-le", "surrogatepass"), np.uint32)
    wide = (code >= 0x80).astype(np.int64) + (code >= 0x800) + (code >= 0x10000) + 1
    wide[(code >= 0xDC80) & (code <= 0xDCFF)] = 1
    return re.sub("[\udc80-\udcff]", "\ufffd", says), np.concatenate([[0], wide.cumsum()])


def _characters(raw: bytes, stretch_of_byte) -> tuple[str, list[tuple[int, int]]]:
    """Bytes as text and the source stretch of each character."""
    says, at = _sized(raw)
    return says, [(stretch_of_byte(a)[0], stretch_of_byte(b - 1)[1]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


def _percent(layer: Layer) -> Iterator[Layer]:
    pieces = []
    if "%" in layer.text:
        for m in PERCENT.finditer(layer.text):
            s = m.start()
            says, stretches = _characters(bytes.fromhex(m[0].replace("%", "")), lambda i, s=s: (s + 3 * i, s + 3 * i + 3))
            pieces.append((s, m.end(), says, stretches))
    if pieces:
        yield _replaced(layer, pieces)


def _escapes(layer: Layer) -> Iterator[Layer]:
    pieces = []
    if "\\" in layer.text:
        for m in ESCAPE.finditer(layer.text):
            units = [(m.start() + u.start(), m.start() + u.end(), int(next(g for g in u.groups() if g), 16)) for u in ESCAPE_UNIT.finditer(m[0])]
            says, stretches, i = [], [], 0
            while i < len(units):
                s, e, code = units[i]
                if 0xD800 <= code < 0xDC00 and i + 1 < len(units) and 0xDC00 <= units[i + 1][2] < 0xE000:
                    code, e, i = 0x10000 + ((code - 0xD800) << 10) + units[i + 1][2] - 0xDC00, units[i + 1][1], i + 1
                says.append(chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else "�")
                stretches.append((s, e))
                i += 1
            pieces.append((m.start(), m.end(), "".join(says), stretches))
    if pieces:
        yield _replaced(layer, pieces)


def _unpackers(raw: bytes):
    if raw[:2] == b"\x1f\x8b":
        yield zlib.decompressobj(31)
    elif len(raw) > 2 and raw[0] & 15 == 8 and (raw[0] << 8 | raw[1]) % 31 == 0:
        yield zlib.decompressobj(15)
    elif raw[:3] == b"BZh":
        yield bz2.BZ2Decompressor()
    elif raw[:6] == b"\xfd7zXZ\x00":
        yield lzma.LZMADecompressor()


def _unpacked(raw) -> Iterator[bytes]:
    """Blocks of what compressed bytes hold, of all members one after another; nothing if they are not compressed.

    Each block comes with the end of the one before; an encoded run that is open at its end waits for the next."""
    tail, held = b"", b""
    while len(raw):
        unpack = next(_unpackers(bytes(raw[:8])), None)
        if unpack is None:
            if tail or held:  # not compressed, behind a member
                held += bytes(raw)
            break
        pending = raw
        try:
            while not unpack.eof:
                block = unpack.decompress(pending, BLOCK)
                pending = getattr(unpack, "unconsumed_tail", b"")
                if not block and not pending and not unpack.eof:
                    break
                held += block
                cut = len(held.rstrip(OPEN))
                if cut and len(held) - cut < HOLD:
                    yield tail + held[:cut]
                    tail, held = (tail + held[:cut])[-OVERLAP:], held[cut:]
                elif len(held) >= HOLD:
                    yield tail + held
                    tail, held = (tail + held)[-OVERLAP:], b""
        except (zlib.error, OSError, EOFError, lzma.LZMAError):
            break
        raw = unpack.unused_data if unpack.eof else b""
    if held:
        yield tail + held


def _says(raw: bytes) -> str | None:
    """Bytes as text, if they look like text."""
    try:
        says = raw.decode("utf-8")
    except UnicodeDecodeError:
        return None
    return says if says and all(c.isprintable() or c in "\t\r\n" for c in says) else None


def _decoded(piece: str) -> bytes | None:
    clean = piece.replace("\r", "").replace("\n", "").rstrip("=")
    if len(clean) % 4 == 1:
        return None
    try:
        return base64.b64decode(clean.replace("-", "+").replace("_", "/") + "=" * (-len(clean) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _coded(layer: Layer) -> Iterator[Layer]:
    for m in CODED.finditer(layer.text):
        wholes = [(m.start(), m[0])] + ([(m.start(), layer.text[m.start() : m.start("last")])] if m["last"] else [])
        whole = next(filter(None, (_text(layer, *x) for x in wholes)), None)
        if whole:
            yield whole
            continue
        packed = _packed(layer, m.start(), m[0], 0)
        first = next(packed, None)
        if first:
            yield first
            yield from packed
            continue
        clean, spans = [], []
        for pattern in (CODED_LINE, SEGMENT):
            for x in pattern.finditer(m[0]):
                a, b = m.start() + x.start(), m.start() + x.end()
                if x[0] != m[0] and (not spans or a >= spans[-1][1] or pattern is SEGMENT and not any(s < b and a < e for s, e in spans)):
                    got = _text(layer, a, x[0])
                    if got:
                        clean.append(got)
                        spans.append((a, b))
        yield from clean
        yield from _glued(layer, m.start(), m[0], spans)


def _text(layer: Layer, start: int, piece: str) -> Layer | None:
    """What a piece says as a whole, if that is text."""
    raw = _decoded(piece)
    if raw is None or _says(raw) is None:
        return None
    return _at(layer, raw, _places(start, piece))


def _places(start: int, piece: str) -> np.ndarray:
    code = np.frombuffer(piece.encode("ascii"), np.uint8)
    return start + np.flatnonzero((code != 13) & (code != 10) & (code != 61))


def _at(layer: Layer, raw: bytes, places: np.ndarray, spans: list[tuple[int, int]] = ()) -> Layer:
    """Decoded bytes as a layer; characters from spans already taken are blanked."""
    said, at = _sized(raw)
    a, b = places[at[:-1] // 3 * 4], places[np.minimum((at[1:] - 1) // 3 * 4 + 3, len(places) - 1)] + 1
    if spans:
        taken = np.zeros(len(a), bool)
        for s, e in spans:
            taken |= (a >= s) & (b <= e)
        said = "".join("\ufffd" if t else c for c, t in zip(said, taken.tolist()))
    if layer.starts is not None:
        spans = [layer.origin(x, y) for x, y in zip(a.tolist(), b.tolist())]
        a, b = (np.array([x[i] for x in spans], np.int64) for i in (0, 1))
    return Layer(said, a, b)


def _packed(layer: Layer, start: int, piece: str, at: int, raw=None) -> Iterator[Layer]:
    """What the bytes of a piece hold if they are compressed; its span is that of the piece from a place on."""
    if raw is None:
        raw = _loose(re.sub("[\r\n=]", "", piece), 0)
    s, e = layer.origin(start + at, start + len(piece))
    for block in _unpacked(raw):
        text = block.decode("utf-8", "replace")
        yield Layer(text, np.full(len(text), s), np.full(len(text), e))


def _loose(letters: str, skip: int) -> bytes:
    """Base64 letters from a place on, without an odd one at the end."""
    part = letters[skip : len(letters) - ((len(letters) - skip) % 4 == 1)].replace("-", "+").replace("_", "/")
    return base64.b64decode(part + "=" * (-len(part) % 4))


def _glued(layer: Layer, start: int, piece: str, spans: list[tuple[int, int]]) -> Iterator[Layer]:
    """A run at each alignment as far as it can be read, and what is compressed in it from a boundary or a known head on."""
    letters, places = re.sub("[\r\n=]", "", piece), _places(start, piece)
    bounds = [m.start() for m in GLUE.finditer(letters)]
    for skip in range(4):
        raw = _loose(letters, skip)
        if not raw:
            continue
        yield _at(layer, raw, places[skip:], spans)
        heads = {(at - skip) // 4 * 3 for at in bounds if at % 4 == skip}
        for magic in MAGIC:
            at = raw.find(magic)
            while at >= 0:
                heads.add(at)
                at = raw.find(magic, at + 1)
        for at in sorted(heads - ({0} if skip == 0 else set())):
            if any(_unpackers(raw[at : at + 8])):
                yield from _packed(layer, start, piece, int(places[skip + at // 3 * 4]) - start, memoryview(raw)[at:])


UNWRAP = (_percent, _escapes, _coded)


def _unwrapped(layer: Layer) -> Iterator[Layer]:
    """The layers in one, made when they are asked for, so that only those on the way to one are held."""
    return (inner for unwrap in UNWRAP for inner in unwrap(layer))


def secrets(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base, all): (start, kind, end) found in the text itself; and these with what its layers hold, each span once."""
    base = scan(text)
    found, seen = set(base), {hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()}
    work = [_unwrapped(Layer(text, None, None))]
    while work:
        inner = next(work[-1], None)
        if inner is None:
            work.pop()
            continue
        # the same content at another place is another layer
        mark = hashlib.sha256(inner.text.encode("utf-8", "surrogatepass") + b"%d:%d" % inner.origin(0, len(inner.text)) if inner.text else b"").digest()
        if not inner.text or mark in seen:
            continue
        seen.add(mark)
        for start, kind, end in scan(inner.text):
            s, e = inner.origin(start, end)
            found.add((s, kind, e))
        work.append(_unwrapped(inner))
    return base, sorted(found)


def joined(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in found)


def scan_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> doc_id, n_assign, n_access, n_hex (in the text itself), base_sha256, spans (all, of the layers too).

    One row per row, repeated rows repeat. A null text counts as empty and has no spans; a null doc_id is
    kept; an empty table gives no rows; other columns are not read. A span is kind:start:end in code
    points, by start, then kind; one that several layers show is given once.
    """

    def run(batch):
        counts, digests, spans = [[], [], []], [], []
        for text in batch["text"]:
            base, every = secrets(text.as_py() or "")
            for kind, column in enumerate(counts):
                column.append(sum(k == kind for _, k, _ in base))
            digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
            spans.append(joined(every))
        return pa.record_batch([batch["doc_id"], *map(longs, counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    cols = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return cols.mapInArrow(by_batch(run), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
