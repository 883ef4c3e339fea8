"""Secrets in texts, also below nested encodings.

Each text is the first entry of a worklist. An entry is scanned, and then
unwrapped: URL and Unicode escapes give the entry's text with the escapes
resolved, base64 runs give what they hold, deflated or gzipped bytes are
inflated. A base64 run may mix the standard and the URL-safe alphabet, or be
wrapped in lines; what doesn't decode as a whole is tried in its parts, which
are lines of one width with those next to them, single lines, and stretches of
one alphabet. New texts join the list until it is empty; a text met before at
the same places is left out, so that encodings which lead back to themselves
end. Every entry has, for each of its characters, the place in the original text
that it came from; what is found in it is reported there. A base64 run's
characters map to the four that hold them, an inflated text's to all that the
compressed data takes.

The list is a stack of what each entry still gives, and a compressed layer is
inflated and scanned in chunks of ``CHUNK`` bytes that overlap by ``OVERLAP``;
so a layer of any size takes bounded memory, and only an encoded run of more
than the overlap, nested in such a layer and cut by a chunk's end, is decoded in
its parts.

Nulls: a null text is an empty one; a null ``doc_id`` is kept. Repeated rows
are scanned each. An empty table gives no rows. Other columns are ignored by
``scan`` and kept by ``redact``.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, slices

KINDS = ("assign", "access", "hex")
MIN_VALUE = 6

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_WORDS = ("passw", "secret", "token", "key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")

_URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2}|\\u\{[0-9A-Fa-f]{1,6}\}|\\U[0-9A-Fa-f]{8})+")
_ONE = re.compile(r"\\[uUx]\{?([0-9A-Fa-f]+)\}?")
_LEAST_RUN = 16
_RUN = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
_PARTS = re.compile(r"[A-Za-z0-9+/]{16,}={0,2}"), re.compile(r"[A-Za-z0-9_-]{16,}={0,2}")
#: Runs over single line breaks, and a line of them.
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:[ \t]*+\r?\n[ \t]*+[A-Za-z0-9+/_-]++)++={0,2}")
_LINE = re.compile(r"[A-Za-z0-9+/_-]+={0,2}")

#: Escapes of escapes of escapes: all but the last two levels go in one step, as each has nothing else in it.
_DEEP = re.compile(r"%(?:25){2,}(?=[0-9A-Fa-f]{2})")

#: Bytes of a compressed layer that are scanned at once, and how many of them again with the next ones.
CHUNK, OVERLAP = 8 << 20, 1 << 20


def scan_one(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the secrets that stand openly in ``text``, by start, then kind."""
    found = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        found += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= MIN_VALUE]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


@dataclass
class Layer:
    """A text, and the places of its characters in the original: their own (None), one for all (numbers), or arrays."""

    text: str
    starts: np.ndarray | int | None = None
    ends: np.ndarray | int | None = None

    def place(self, start: int, end: int) -> tuple[int, int]:
        if self.starts is None:
            return start, end
        if isinstance(self.starts, int):
            return self.starts, self.ends
        return int(self.starts[start:end].min()), int(self.ends[start:end].max())

    def within(self, text: str, starts, ends) -> Layer:
        """A layer that comes of this one, with the places of its characters in it."""
        if self.starts is None:
            return Layer(text, starts, ends)
        if isinstance(self.starts, int):
            return Layer(text, self.starts, self.ends)
        if isinstance(starts, int):
            return Layer(text, *self.place(starts, ends))
        return Layer(text, self.starts[starts], self.ends[ends - 1])

    def key(self) -> bytes:
        place = b"" if self.starts is None else str((self.starts, self.ends)).encode() if isinstance(self.starts, int) else self.starts.tobytes()
        return hashlib.sha256(self.text.encode("utf-8", "surrogatepass") + place).digest()


@dataclass
class Findings:
    base: list[tuple[int, int, str]] = field(default_factory=list)
    all: list[tuple[int, int, str]] = field(default_factory=list)
    layers: int = 0


def _readable(data: bytes) -> str | None:
    try:
        text = data.decode()
    except UnicodeDecodeError:
        return None
    return text if text and all(c.isprintable() or c in "\t\n\r" for c in text) else None


def _unpacked(data: bytes, chunk: int) -> tuple[Iterator[str], int] | None:
    """What compressed ``data`` holds, in overlapping chunks, and how many of its bytes that takes."""
    if data[:2] == b"\x1f\x8b":
        mode = 31
    elif len(data) > 2 and data[0] & 15 == 8 and int.from_bytes(data[:2], "big") % 31 == 0:
        mode = 15
    else:
        return None

    def pieces() -> Iterator[bytes]:
        engine, rest = zlib.decompressobj(mode), data
        while not engine.eof:
            piece = engine.decompress(rest, chunk)
            rest = engine.unconsumed_tail
            if not piece and not rest:
                raise zlib.error("the data end early")
            yield piece
        pieces.used = len(data) - len(engine.unused_data)

    def texts() -> Iterator[str]:
        before = b""
        for piece in pieces():
            yield (before + piece).decode("utf-8", "replace")
            before = piece[-min(OVERLAP, chunk // 2) :]

    try:
        for _ in pieces():  # once for its length, and to know that it is whole
            pass
    except zlib.error:
        return None
    return texts(), pieces.used


def _rewritten(layer: Layer, pattern: re.Pattern, decode) -> Layer | None:
    """``layer`` with each match of ``pattern`` replaced by decode(match): [(text, from, to)] relative to the match."""
    text, parts, starts, ends, at = layer.text, [], [], [], 0
    for m in pattern.finditer(text):
        new = decode(m[0])
        if new is None:
            continue
        parts.append(text[at : m.start()])
        keep = np.arange(at, m.start())
        starts.append(keep)
        ends.append(keep + 1)
        for piece, a, b in new:
            parts.append(piece)
            starts.append(np.full(len(piece), m.start() + a))
            ends.append(np.full(len(piece), m.start() + b))
        at = m.end()
    if not parts:
        return None
    parts.append(text[at:])
    keep = np.arange(at, len(text))
    s, e = np.concatenate([*starts, keep]).astype(np.int64), np.concatenate([*ends, keep + 1]).astype(np.int64)
    return layer.within("".join(parts), s, e)


def _url(run: str):
    try:
        text = bytes.fromhex(run.replace("%", "")).decode()
    except UnicodeDecodeError:
        return None
    made, at = [], 0
    for c in text:
        n = 3 * len(c.encode())
        made.append((c, at, at + n))
        at += n
    return made


def _packed_url(layer: Layer, chunk: int) -> Iterator[Layer]:
    """Compressed bytes in URL escapes."""
    for m in _URL.finditer(layer.text):
        found = _unpacked(bytes.fromhex(m[0].replace("%", "")), chunk) if len(m[0]) > 9 else None
        if found:
            for text in found[0]:
                yield layer.within(text, m.start(), m.end())


def _escapes(run: str):
    made, halves = [], []
    for m in _ONE.finditer(run):
        code = int(m[1], 16)
        if 0xD800 <= code < 0xDC00:
            halves = [(code, m.start())]
            continue
        start = m.start()
        if 0xDC00 <= code < 0xE000:
            if not halves:
                return None
            high, start = halves.pop()
            code = 0x10000 + ((high - 0xD800) << 10) + (code - 0xDC00)
        if code > 0x10FFFF or halves:
            return None
        made.append((chr(code), start, m.end()))
    return None if halves else made


def _wrapped(text: str, start: int, end: int) -> Iterator[list[tuple[int, int]]]:
    """Lines that may be one run, of a text's wrapped run: all, then those of one width with and without the ones next to them."""
    lines = [m.span() for m in _LINE.finditer(text, start, end)]
    yield lines
    i, n = 0, len(lines)
    width = lambda k: lines[k][1] - lines[k][0]
    while i < n:
        j = i + 1
        while j < n and width(j) == width(i):
            j += 1
        for a, b in ((i - 1, j + 1), (i - 1, j), (i, j + 1), (i, j)):
            if 0 <= a and b <= n and b - a > 1 and (a, b) != (0, n):
                yield lines[a:b]
        i = j


def _candidates(text: str) -> Iterator[list[tuple[int, int]]]:
    """Spans that may be one base64 run together, wholes before their parts."""
    if "\n" in text:
        for m in _WRAPPED.finditer(text):
            if m.end() - m.start() >= _LEAST_RUN:
                yield from _wrapped(text, *m.span())
    for m in _RUN.finditer(text):
        yield [m.span()]
        if "-" in m[0] or "_" in m[0]:
            for part in _PARTS:
                for x in part.finditer(text, *m.span()):
                    if x.span() != m.span():
                        yield [x.span()]


def _base64(layer: Layer, chunk: int) -> Iterator[Layer]:
    done = None
    for spans in _candidates(layer.text):
        start, end = spans[0][0], spans[-1][1]
        if done is not None and done[start] and done[end - 1]:
            continue
        run = "".join(layer.text[a:b] for a, b in spans).rstrip("=").replace("-", "+").replace("_", "/")
        if len(run) < _LEAST_RUN or len(run) % 4 == 1:
            continue
        try:
            data = base64.b64decode(run + "=" * (-len(run) % 4), validate=True)
        except (binascii.Error, ValueError):
            continue
        plain, packed = _readable(data), None
        if plain is None:
            packed = _unpacked(data, chunk)
        if not plain and not packed:
            continue
        where = np.concatenate([np.arange(a, b) for a, b in spans])
        if packed and packed[1] < len(data):
            end = int(where[-(-packed[1] * 4 // 3) - 1]) + 1
        done = bytearray(len(layer.text)) if done is None else done
        done[start:end] = b"\1" * (end - start)
        if packed:
            for text in packed[0]:
                yield layer.within(text, start, end)
        else:
            sizes = np.fromiter((len(c.encode()) for c in plain), np.int64, len(plain))
            last = np.cumsum(sizes)
            yield layer.within(plain, where[(last - sizes) * 4 // 3], where[-(-last * 4 // 3) - 1] + 1)


def _unwrapped(layer: Layer, chunk: int) -> Iterator[Layer]:
    """What one step of decoding makes of a layer."""
    yield from _base64(layer, chunk)
    if "%" in layer.text:
        yield from _packed_url(layer, chunk)
        deep = _rewritten(layer, _DEEP, lambda run: [("%25", 0, len(run))])
        if new := deep or _rewritten(layer, _URL, _url):
            yield new
    if "\\" in layer.text and (new := _rewritten(layer, _ESCAPE, _escapes)):
        yield new


def find(text: str, chunk: int = CHUNK) -> Findings:
    """What ``text`` holds, openly (``base``) and below encodings too (``all``)."""
    whole = Layer(text)
    out = Findings(base=scan_one(text))
    spans, seen, work = set(out.base), {whole.key()}, [_unwrapped(whole, chunk)]
    while work:
        layer = next(work[-1], None)
        if layer is None:
            work.pop()
        elif layer.text and (key := layer.key()) not in seen:
            seen.add(key)
            out.layers += 1
            spans |= {(*layer.place(a, b), kind) for a, b, kind in scan_one(layer.text)}
            work.append(_unwrapped(layer, chunk))
    out.all = sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))
    return out


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


SPANS = "array<struct<start:long,end:long,kind:string>>"


def scan(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Per row: ``doc_id``, ``base`` and ``spans`` (code points, end exclusive), and ``n_layers`` decoded."""
    schema = T.StructType.fromDDL(f"doc_id long, base {SPANS}, spans {SPANS}, n_layers long")

    def run(batches) -> Iterator:
        import pyarrow as pa

        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
        for batch in slices(batches, "text"):
            found = [find(t or "", chunk) for t in column(batch, "text").to_pylist()]
            rows = lambda name: pa.array([[{"start": a, "end": b, "kind": k} for a, b, k in getattr(f, name)] for f in found], kind)  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), rows("base"), rows("all"), pa.array([f.layers for f in found], pa.int64())], ["doc_id", "base", "spans", "n_layers"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def digest(found: DataFrame) -> DataFrame:
    """The counts and joined spans of ``scan``."""
    text = lambda name: F.array_join(F.transform(name, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in KINDS], F.sha2(text("base").cast("binary"), 256).alias("base_sha256"), text("spans").alias("spans"), "n_layers")


def redact(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``docs`` with each secret in ``text`` replaced by ``[kind]``; ``n_chars``, if there, follows the text.

    Of spans that overlap, the first names the replacement of their union. A
    null text stays null.
    """

    def clean(text: str) -> str:
        parts, at = [], 0
        for a, b, kind in find(text, chunk).all:
            if a >= at:
                parts += [text[at:a], f"[{kind}]"]
            at = max(at, b)
        return "".join([*parts, text[at:]])

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in slices(batches, "text"):
            i = batch.schema.get_field_index("text")
            new = pa.array([None if t is None else clean(t) for t in column(batch, "text").to_pylist()], batch.schema.field(i).type)
            yield batch.set_column(i, batch.schema.field(i), new)

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
