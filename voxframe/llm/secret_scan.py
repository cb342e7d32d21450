"""Secrets in texts and in what texts wrap: a worklist of layers, unwrapped round by round until nothing is left.

The first pass reads each text once: it finds the plain secrets and cuts out what may be wrapped, as layers. A layer
is a piece of unwrapped text with a map from its characters to those of the document. Each round scans all layers of
the worklist side by side, maps what it finds back, and unwraps them further:

* URL escapes (%41) and Unicode escapes (backslash u0041, U00000041, x41, and &#65;) give a piece of text with all
  escapes replaced, of the words around them: a secret spans three words at most, so two words on either side do;
* runs of base64 characters (also the URL-safe ones, also over line breaks) are decoded at all four alignments, and
  of the bytes their readable stretches become layers;
* bytes that begin like gzip, zlib, bzip2, xz or zstandard are decompressed first, again and again.

Only what touches newly unwrapped characters is looked at, the rest belongs to the layer before. A layer that an
earlier round had, by document and digest, is not entered again, so data that unwrap to themselves end too.
"""

from __future__ import annotations

import binascii
import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxframe.llm.common import written

#: Kinds in the order of the report.
KINDS = ("assign", "access", "hex")
# Patterns over bytes: no class has a byte of a non-ASCII character. The first is for text in lower case.
ASSIGN = re.compile(rb"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{24,}")

ESCAPE = re.compile(
    r"(?P<url>(?:%[0-9A-Fa-f]{2})+)|\\u\{(?P<b>[0-9A-Fa-f]{1,6})\}|(?P<u>(?:\\u[0-9A-Fa-f]{4})+)"
    r"|\\U(?P<w>[0-9A-Fa-f]{8})|\\x(?P<x>[0-9A-Fa-f]{2})|&#[xX](?P<h>[0-9A-Fa-f]{1,6});|&#(?P<d>[0-9]{1,7});")
MAY_ESCAPE = re.compile(rb"%[0-9A-Fa-f]{2}|\\[uUx][0-9A-Fa-f{]|&#[xX0-9]")
#: Twelve bytes are the shortest secret (token=abcdef), which base64 makes 16 characters.
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}(?:\r?\n[A-Za-z0-9+/_-]{16,})*")
READABLE = re.compile(
    rb"(?:[\x09\x0a\x0d\x20-\x7e]|[\xc2-\xdf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}){12,}")
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
URL_SAFE = bytes.maketrans(b"-_", b"+/")

#: A compressed layer beyond so many bytes is scanned, and unwrapped on, in pieces that overlap: all of it, in bounded memory.
WHOLE, OVERLAP = 1 << 24, 1 << 16


def scan(data: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) in bytes of the secrets in a text, by start."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(data.lower()) if m.end(1) - m.start(1) >= 6]
    if b"AKIA" in data:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(data) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(data)]
    return sorted(found)


def in_characters(data: bytes, found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    if not found or data.isascii():
        return found
    begins = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
    before = lambda at: int(begins[at - 1]) if at else 0
    return [(before(s), k, before(e)) for s, k, e in found]


class Layer:
    """Text with, for each character, the span [start, end) of the document it stands for, and whether it is new."""

    def __init__(self, text: str, start: np.ndarray, end: np.ndarray, new: np.ndarray):
        self.text, self.start, self.end, self.new = text, start, end, new
        self.news = np.concatenate(([0], np.cumsum(new)))

    def touches(self, s: int, e: int) -> bool:
        return self.news[e] > self.news[s]

    def pack(self) -> bytes:
        """The maps as stretches: (first character, start, end, kind), kind 2 * moves along + new."""
        n = len(self.text)
        moves = np.diff(self.start) == 1
        one = self.end - self.start == 1
        along = np.zeros(n, bool)
        along[1:] = moves & one[1:] & one[:-1]
        same = np.zeros(n, bool)
        same[1:] = (np.diff(self.start) == 0) & (np.diff(self.end) == 0)
        # A stretch stays of one kind: it moves along or stays, as its second character does.
        kind = np.where(along, 1, np.where(same, 2, 0))
        begin = kind == 0
        begin[1:] |= self.new[1:] != self.new[:-1]
        begin[1:] |= (kind[1:] != kind[:-1]) & (kind[:-1] != 0)
        at = np.flatnonzero(begin)
        second = np.minimum(at + 1, n - 1)
        steps = (kind[second] == 1) & (second > at) & ~begin[second]
        return np.stack([at, self.start[at], self.end[at], 2 * steps + self.new[at]]).astype("<i4").tobytes()

    @staticmethod
    def unpack(text: str, packed: bytes) -> Layer:
        at, start, end, kind = np.frombuffer(packed, "<i4").reshape(4, -1).astype(np.int64)
        sizes = np.diff(np.append(at, len(text)))
        ahead = (np.arange(len(text)) - np.repeat(at, sizes)) * np.repeat(kind >> 1, sizes)
        return Layer(text, np.repeat(start, sizes) + ahead, np.repeat(end, sizes) + ahead, np.repeat(kind & 1, sizes).astype(bool))


def digest(layer: Layer) -> str:
    return hashlib.md5(layer.text.encode("utf-8", "replace") + b"\0" + layer.pack()).hexdigest()


def pieces_with_escapes(text: str, touches) -> Iterator[tuple[int, int]]:
    """Spans of the words around escapes that ``touches`` accepts; words apart by more than spaces are not joined."""
    hits = [m.start() for m in ESCAPE.finditer(text) if touches(*m.span())]
    if not hits:
        return
    words = [m.span() for m in TOKEN.finditer(text)]
    begins = [s for s, _ in words]
    joined = lambda i: 0 < i < len(words) and not text[words[i - 1][1] : words[i][0]].strip(" ")
    first = last = None
    for at in hits:
        i = j = bisect_right(begins, at) - 1
        for _ in range(2):
            i -= joined(i)
            j += joined(j + 1)
        if last is not None and i <= last:
            last = max(last, j)
            continue
        if last is not None:
            yield words[first][0], words[last][1]
        first, last = i, j
    yield words[first][0], words[last][1]


def unescape(layer: Layer, s: int, e: int) -> Layer:
    """The piece s to e with its escapes replaced."""
    text, out, start, end, new = layer.text, [], [], [], []

    def copy(a, b):
        out.append(text[a:b])
        start.append(layer.start[a:b])
        end.append(layer.end[a:b])
        new.append(np.zeros(b - a, bool))

    def put(chars, cuts):
        """Characters, and where in the text each begins; the last cut ends them."""
        out.append(chars)
        start.append(layer.start[cuts[:-1]])
        end.append(layer.end[np.array(cuts[1:]) - 1])
        new.append(np.ones(len(chars), bool))

    at = s
    for m in ESCAPE.finditer(text, s, e):
        copy(at, m.start())
        at, a = m.end(), m.start()
        if m["url"]:
            data = bytes.fromhex(m["url"].replace("%", ""))
            chars = data.decode("utf-8", "surrogateescape")
            sizes = [len(c.encode("utf-8", "surrogateescape")) for c in chars]
            put("".join("�" if "\ud800" <= c <= "\udfff" else c for c in chars), np.cumsum([a, *(3 * k for k in sizes)]))
        elif m["u"]:
            units = m["u"].replace("\\u", "")
            chars = bytes.fromhex(units).decode("utf-16-be", "surrogatepass")
            sizes = [12 if c > "￿" else 6 for c in chars]
            put("".join("�" if "\ud800" <= c <= "\udfff" else c for c in chars), np.cumsum([a, *sizes]))
        else:
            number = int(m["d"]) if m["d"] else int(m["b"] or m["w"] or m["x"] or m["h"], 16)
            put(chr(number) if number < 0x110000 and not 0xD800 <= number < 0xE000 else "�", [a, at])
    copy(at, e)
    return Layer("".join(out), np.concatenate(start), np.concatenate(end), np.concatenate(new))


def decompressor(data: bytes):
    """A decompressor for data that begin like a compressed file, or None."""
    import bz2
    import lzma
    import zlib

    if data[:2] == b"\x1f\x8b":
        return zlib.decompressobj(31)
    if data[:1] == b"\x78" and len(data) > 2 and int.from_bytes(data[:2], "big") % 31 == 0:
        return zlib.decompressobj()
    if data[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if data[:6] == b"\xfd7zXZ\0":
        return lzma.LZMADecompressor()
    if data[:4] == b"\x28\xb5\x2f\xfd":
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj()
    return None


def decompressed(data: bytes) -> Iterator[bytes]:
    """Parts of what ``data`` hold, as far as they can be read; in bounded memory."""
    stream = decompressor(data)
    try:
        for i in range(0, len(data), 4096):
            yield stream.decompress(data[i : i + 4096])
            if stream.eof:
                return
    except Exception:  # noqa: BLE001 - each library has an error of its own; what was read before it stays
        return


def unwrapped(data: bytes) -> Iterator[tuple[bytes, bool]]:
    """(bytes, whether they are still in place) of data after all decompressing."""
    seen, inside = set(), False
    while decompressor(data) is not None and hashlib.md5(data).digest() not in seen:
        seen.add(hashlib.md5(data).digest())
        parts, size, stream = [], 0, decompressed(data)
        for part in stream:
            parts.append(part)
            size += len(part)
            if size > WHOLE:
                break
        if not size:
            break
        data, inside = b"".join(parts), True
        if size > WHOLE:
            for part in stream:
                if len(data) > WHOLE:
                    yield data, False
                    data = data[-OVERLAP:]
                data += part
            break
    yield data, not inside


def decode_runs(text: str, touches, start: np.ndarray, end: np.ndarray) -> Iterator[Layer]:
    """Layers of the base64 runs of a text that ``touches`` accepts."""
    for m in BASE64.finditer(text):
        if not touches(*m.span()):
            continue
        run = np.frombuffer(m[0].encode(), np.uint8)
        where = np.flatnonzero((run != 10) & (run != 13)) + m.start()
        chars = m[0].encode().translate(URL_SAFE, b"\r\n")
        for shift in range(4):
            body = chars[shift:]
            body = body[: len(body) - (len(body) % 4 == 1)]
            data = binascii.a2b_base64(body + b"=" * (-len(body) % 4))
            for plain, in_place in unwrapped(data):
                for r in READABLE.finditer(plain):
                    piece = r[0].decode()
                    if in_place:
                        # Byte k is in the characters 4 k / 3 and the next one.
                        lead = np.flatnonzero((np.frombuffer(r[0], np.uint8) & 0xC0) != 0x80)
                        last = np.append(lead[1:], len(r[0])) - 1
                        a = where[shift + (r.start() + lead) * 4 // 3]
                        b = where[shift + (r.start() + last) * 4 // 3 + 1]
                        yield Layer(piece, start[a], end[b], np.ones(len(piece), bool))
                    else:
                        whole = np.ones(len(piece), np.int64)
                        yield Layer(piece, whole * start[where[shift]], whole * end[where[-1]], whole.astype(bool))


def children(layer: Layer, always: bool = False) -> Iterator[Layer]:
    """What a layer wraps. ``always``: all of it counts as new."""
    touches = (lambda s, e: True) if always else layer.touches
    for s, e in pieces_with_escapes(layer.text, touches):
        yield unescape(layer, s, e)
    yield from decode_runs(layer.text, touches, layer.start, layer.end)


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("kind", T.IntegerType()), T.StructField("end", T.LongType())]))
SPAN_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
LAYER = "layer string, map binary, digest string"


def _layers(rows: list[tuple[int, Layer]], before: dict[str, pa.DataType], width: int) -> Iterator[pa.RecordBatch]:
    """Batches of layers, with nulls in the columns ``before``; ``width`` characters or so each."""
    i = 0
    while i < len(rows):
        j, size = i, 0
        while j < len(rows) and size < width:
            size += len(rows[j][1].text)
            j += 1
        some = rows[i:j]
        yield pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in some], pa.int64()), *[pa.nulls(len(some), t) for t in before.values()],
             pa.array([x.text for _, x in some]), pa.array([x.pack() for _, x in some], pa.binary()), pa.array([digest(x) for _, x in some])],
            ["key", *before, "layer", "map", "digest"])
        i = j


def _first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 40
    for batch in batches:
        spans, layers = [], []
        for i, text in enumerate(batch.column("text")):
            text = text.as_py() or ""
            data = text.encode()
            spans.append([{"start": s, "kind": k, "end": e} for s, k, e in in_characters(data, scan(data))])
            escaped = MAY_ESCAPE.search(data) is not None
            if escaped or BASE64.search(text):
                at = np.arange(len(text))
                layer = Layer(text, at, at + 1, np.zeros(len(text), bool))
                layers += [(number + i, x) for x in (children(layer, True) if escaped else decode_runs(text, lambda s, e: True, at, at + 1))]
        n = len(batch)
        yield pa.RecordBatch.from_arrays(
            [pa.array(number + np.arange(n)), batch.column("row"), pa.array(spans, SPAN_ARROW), pa.nulls(n, pa.string()),
             pa.nulls(n, pa.binary()), pa.nulls(n, pa.string())],
            ["key", "row", "base", "layer", "map", "digest"])
        yield from _layers(layers, {"row": batch.schema.field("row").type, "base": SPAN_ARROW}, 1 << 22)
        number += n


def _round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = {"start": pa.int64(), "kind": pa.int32(), "end": pa.int64()}
    for batch in batches:
        found, layers = [], []
        for x in batch.to_pylist():
            layer = Layer.unpack(x["layer"], x["map"])
            data = layer.text.encode()
            found += [
                (x["key"], int(layer.start[s]), k, int(layer.end[e - 1]))
                for s, k, e in in_characters(data, scan(data)) if layer.touches(s, e)]
            layers += [(x["key"], child) for child in children(layer)]
        n = len(found)
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[c] for x in found], t) for c, t in enumerate((pa.int64(), *span.values()))]
            + [pa.nulls(n, pa.string()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.string())],
            ["key", *span, "layer", "map", "digest"])
        yield from _layers(layers, span, 1 << 22)


def scan_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without ``text``, with base and spans: arrays of (start, kind, end), by start, then kind, then end.

    ``base`` has the secrets that stand in the text as it is, ``spans`` these and the ones found in what it wraps. Kind
    is an index into KINDS. Spans are whole matches, in code points, end exclusive; one found in a layer is the
    stretch of the document that was unwrapped to it (of compressed data the whole run).

    Every row is returned, repeated rows and null or repeated ids as often as they come. A null or empty text has no
    spans, an empty table gives an empty one. Columns of ``docs`` named like a result are replaced, all others are kept.
    """
    kept = [c for c in docs.columns if c not in (text, "base", "spans")]
    packed = docs.select(
        F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(text).cast("string").alias("text"))
    layer_fields = T._parse_datatype_string(LAYER).fields
    schema = T.StructType([
        T.StructField("key", T.LongType()), T.StructField("row", packed.schema["row"].dataType), T.StructField("base", SPANS), *layer_fields])
    first = written(packed.mapInArrow(_first_pass, schema), "secrets-first")
    work = first.filter("layer is not null").select("key", "layer", "map", "digest").dropDuplicates(["key", "digest"])
    known, found = [], []
    while not work.isEmpty():
        work = written(work, "secrets-work")
        known.append(work.select("key", "digest"))
        out = written(
            work.repartition("key", "digest").mapInArrow(_round, f"key bigint, start bigint, kind int, end bigint, {LAYER}"), "secrets-round")
        found.append(out.filter("kind is not null").select("key", "start", "kind", "end"))
        work = (
            out.filter("layer is not null").select("key", "layer", "map", "digest").dropDuplicates(["key", "digest"])
            .join(reduce(DataFrame.unionByName, known), ["key", "digest"], "left_anti"))
    rows = first.filter("layer is null").select("key", "row", "base")
    none = F.array().cast(SPANS)
    if found:
        more = (
            reduce(DataFrame.unionByName, found).distinct()
            .groupBy("key").agg(F.collect_list(F.struct("start", "kind", "end")).alias("more")))
        rows = rows.join(more, "key", "left")
    else:
        rows = rows.withColumn("more", none)
    return rows.select(
        *[F.col(f"row.`{c}`").alias(c) for c in kept], "base",
        F.array_sort(F.array_union("base", F.coalesce("more", none))).alias("spans"))
