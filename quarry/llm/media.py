"""Media columns: payloads stored as 8-bit media, and signature sniffing of what is stored.

An Aho-Corasick automaton finds the magic bytes of every format in one pass over the bytes;
a validator of the format then walks the structure (lengths, checksums, offsets) and gives
the exact extent, or rejects the hit. A valid item at offset 0 corrects a wrong declared
type; valid items elsewhere, not inside one already accepted, are carved.

Each row is worked on alone in Arrow UDFs; stored media is written to a table and read back.

Defined cases: a null text is an empty payload (padded to 192 spaces); a null or unknown blob
sniffs as None with nothing carved; equal texts give equal values; repeated rows each give a
row; an empty table an empty result; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh_path

UNIT = 192
#: Magic bytes (fixed values): signature, format, and its offset from the start of the file.
MAGIC = [
    (b"RIFF", "wav", 0), (b"\x89PNG\r\n\x1a\n", "png", 0), (b"BM", "bmp", 0), (b"P5\n", "pgm", 0), (b"GIF87a", "gif", 0), (b"GIF89a", "gif", 0),
    (b"\xff\xd8\xff", "jpeg", 0), (b"%PDF-", "pdf", 0), (b"PK\x03\x04", "zip", 0), (b"\x1f\x8b\x08", "gzip", 0), (b"fLaC", "flac", 0), (b"OggS", "ogg", 0),
]
KINDS = ("wav", "png", "bmp", "pgm")


def pad(data: bytes) -> bytes:
    """data and spaces up to a positive multiple of UNIT."""
    return data + b" " * (-len(data) % UNIT if data else UNIT)


def encode(payload: bytes, kind: str) -> bytes:
    """payload, a positive multiple of UNIT, as the 8-bit samples of a file of that kind."""
    rows = len(payload) // UNIT
    if kind == "wav":
        fmt = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, 8000, 8000, 1, 8)
        return struct.pack("<4sI4s", b"RIFF", 4 + len(fmt) + 8 + len(payload), b"WAVE") + fmt + struct.pack("<4sI", b"data", len(payload)) + payload
    if kind == "png":
        chunk = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
        raw = b"".join(b"\0" + payload[i : i + UNIT] for i in range(0, len(payload), UNIT))
        return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", UNIT, rows, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw, 1)) + chunk(b"IEND", b"")
    if kind == "bmp":
        palette = b"".join(bytes((i, i, i, 0)) for i in range(256))
        info = struct.pack("<IiiHHIIiiII", 40, UNIT, -rows, 1, 8, 0, len(payload), 2835, 2835, 256, 0)
        head = struct.pack("<2sIHHI", b"BM", 14 + 40 + 1024 + len(payload), 0, 0, 14 + 40 + 1024)
        return head + info + palette + payload
    if kind == "pgm":
        return b"P5\n%d %d\n255\n" % (UNIT, rows) + payload
    raise ValueError(f"unknown kind {kind!r}")


def _wav(b: bytes, at: int) -> tuple[int, str, tuple] | None:
    if len(b) - at < 12 or b[at + 8 : at + 12] != b"WAVE":
        return None
    end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
    if end > len(b):
        return None
    i, fmt, data = at + 12, None, None
    while i + 8 <= end:
        name, n = struct.unpack_from("<4sI", b, i)
        if i + 8 + n > end:
            return None
        if name == b"fmt " and n >= 16:
            fmt = struct.unpack_from("<HHIIHH", b, i + 8)
        elif name == b"data":
            data = (i + 8, n)
        i += 8 + n + (n & 1 and i + 8 + n < end)
    if not fmt or not data or fmt[0] != 1 or fmt[4] != fmt[1] * fmt[5] // 8:
        return None
    return end, f"wav:{fmt[1]}ch:{fmt[2]}hz:{fmt[5]}bit:{data[1]}", ("raw", *data)


def _png(b: bytes, at: int) -> tuple[int, str, tuple] | None:
    i, head, parts = at + 8, None, []
    while i + 12 <= len(b):
        n, name = struct.unpack_from(">I4s", b, i)
        if i + 12 + n > len(b) or struct.unpack_from(">I", b, i + 8 + n)[0] != zlib.crc32(b[i + 4 : i + 8 + n]):
            return None
        if head is None:
            if name != b"IHDR" or n != 13:
                return None
            head = struct.unpack_from(">IIBBBBB", b, i + 8)
        elif name == b"IDAT":
            parts.append((i + 8, n))
        i += 12 + n
        if name == b"IEND":
            return (i, f"png:{head[0]}x{head[1]}:{head[2]}bit", ("png", head, parts)) if parts else None
    return None


def _bmp(b: bytes, at: int) -> tuple[int, str, tuple] | None:
    if len(b) - at < 54:
        return None
    size, r1, r2, offset, info, w, h, planes, bits, comp = struct.unpack_from("<IHHIIiiHHI", b, at + 2)
    if r1 or r2 or info not in (40, 108, 124) or planes != 1 or bits not in (1, 4, 8, 16, 24, 32) or comp not in (0, 3) or w <= 0 or not h:
        return None
    stride = (w * bits + 31) // 32 * 4
    if offset < 14 + info or at + size > len(b) or offset + stride * abs(h) > size:
        return None
    return at + size, f"bmp:{w}x{abs(h)}:{bits}bit", ("raw", at + offset, stride * abs(h)) if h < 0 and w * bits == stride * 8 else ("none",)


def _pgm(b: bytes, at: int) -> tuple[int, str, tuple] | None:
    head = b[at : at + 64].split(b"\n", 3)
    if len(head) < 4 or head[2] != b"255" or not all(x.isdigit() for x in head[1].split()) or len(head[1].split()) != 2:
        return None
    w, h = map(int, head[1].split())
    start = at + len(head[0]) + len(head[1]) + len(head[2]) + 3
    if not w or not h or start + w * h > len(b):
        return None
    return start + w * h, f"pgm:{w}x{h}:8bit", ("raw", start, w * h)


def _gif(b: bytes, at: int) -> tuple[int, str, tuple] | None:
    if len(b) - at < 14:
        return None
    w, h, flags = struct.unpack_from("<HHB", b, at + 6)
    i = at + 13 + (3 << ((flags & 7) + 1) if flags & 128 else 0)
    frames = 0
    while i < len(b):
        if b[i] == 0x3B:
            return (i + 1, f"gif:{w}x{h}:{frames}", ("none",)) if frames else None
        if b[i] == 0x2C and i + 11 <= len(b):
            local = b[i + 9]
            i, frames = i + 11 + (3 << ((local & 7) + 1) if local & 128 else 0), frames + 1
        elif b[i] == 0x21:
            i += 2
        else:
            return None
        while i < len(b) and b[i]:
            i += 1 + b[i]
        i += 1
    return None


def _jpeg(b: bytes, at: int) -> tuple[int, str, tuple] | None:
    i, shape = at + 2, None
    while i + 4 <= len(b):
        if b[i] != 0xFF:
            return None
        mark = b[i + 1]
        n = struct.unpack_from(">H", b, i + 2)[0]
        if n < 2 or i + 2 + n > len(b):
            return None
        if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC) and n >= 8:
            shape = struct.unpack_from(">HH", b, i + 5)
        i += 2 + n
        if mark == 0xDA:
            while (i := b.find(b"\xff", i)) >= 0 and i + 1 < len(b):
                if b[i + 1] == 0xD9:
                    return (i + 2, f"jpeg:{shape[1]}x{shape[0]}", ("none",)) if shape else None
                if b[i + 1] and not 0xD0 <= b[i + 1] <= 0xD7:
                    break
                i += 2
            if i < 0:
                return None
    return None


def _zip(b: bytes, at: int, memo: dict) -> tuple[int, str, tuple] | None:
    if "zip" not in memo:  # where each end record says its archive begins: one pass over the blob
        memo["zip"] = starts = {}
        end = b.find(b"PK\x05\x06")
        while end >= 0 and end + 22 <= len(b):
            n, size, start, note = struct.unpack_from("<HIIH", b, end + 10)
            if end + 22 + note <= len(b) and (not n or b[end - size : end - size + 4] == b"PK\x01\x02"):
                starts.setdefault(end - size - start, (end + 22 + note, f"zip:{n}", ("none",)))
            end = b.find(b"PK\x05\x06", end + 4)
    return memo["zip"].get(at)


def _gzip(b: bytes, at: int) -> tuple[int, str, tuple] | None:
    d = zlib.decompressobj(31)
    n, i, rest = 0, at, b""
    try:
        while not d.eof and (rest or i < len(b)):
            if not rest:
                rest, i = b[i : i + 65536], i + 65536
            n += len(d.decompress(rest, 1 << 20))  # a megabyte of output at a time
            rest = d.unconsumed_tail
    except zlib.error:
        return None
    return (min(i, len(b)) - len(d.unused_data), f"gzip:{n}", ("none",)) if d.eof else None


def _pdf(b: bytes, at: int, memo: dict) -> tuple[int, str, tuple] | None:
    if "pdf" not in memo:
        memo["pdf"] = [[m.start() for m in re.finditer(x, b)] for x in (b"%%EOF", b"startxref")]
    ends, refs = memo["pdf"]
    i, j = bisect.bisect_left(ends, at), bisect.bisect_left(refs, at)
    if i == len(ends) or j == len(refs) or refs[j] > ends[i]:
        return None
    return ends[i] + 5, f"pdf:{b[at + 5 : at + 8].decode('latin-1')}", ("none",)


@lru_cache(3)
def _crc_table(poly: int, bits: int) -> list[int]:
    top, mask, out = 1 << bits - 1, (1 << bits) - 1, []
    for x in range(256):
        x <<= bits - 8
        for _ in range(8):
            x = (x << 1 ^ poly if x & top else x << 1) & mask
        out.append(x)
    return out


def _crc(data: bytes, poly: int, bits: int, crc: int = 0) -> int:
    """Highest bit first, from 0."""
    table, shift, mask = _crc_table(poly, bits), bits - 8, (1 << bits) - 1
    for x in data:
        crc = (crc << 8 ^ table[crc >> shift ^ x]) & mask
    return crc


def _flac_header(b: bytes, i: int) -> tuple[int, int] | None:
    """Length and samples of the frame header at i, if its checksum holds."""
    if i + 6 > len(b) or b[i] != 0xFF or b[i + 1] & 0xFE != 0xF8:
        return None
    size, rate, first = b[i + 2] >> 4, b[i + 2] & 15, b[i + 4]
    number = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4 if first < 0xF8 else 5 if first < 0xFC else 6 if first < 0xFE else 7
    at = i + 4 + number
    wide = {6: 1, 7: 2}.get(size, 0)
    end = at + wide + {12: 1, 13: 2, 14: 2}.get(rate, 0)
    if not size or rate == 15 or b[i + 3] & 1 or end >= len(b) or _crc(b[i:end], 0x07, 8) != b[end]:
        return None
    n = int.from_bytes(b[at : at + wide], "big") + 1 if wide else 192 if size == 1 else 576 << size - 2 if size < 6 else 256 << size - 8
    return end + 1 - i, n


def _flac(b: bytes, at: int) -> tuple[int, str, tuple] | None:
    """Metadata blocks, then frames whose headers' and own checksums hold, up to the stream's number of samples."""
    i, last, info = at + 4, False, None
    while not last:
        if i + 4 > len(b):
            return None
        last, kind, n = b[i] > 127, b[i] & 127, int.from_bytes(b[i + 1 : i + 4], "big")
        if i + 4 + n > len(b) or (info is None) != (kind == 0) or kind == 0 and n != 34:
            return None
        if kind == 0:
            info = b[i + 4 : i + 38]
        i += 4 + n
    largest, total = int.from_bytes(info[7:10], "big") or len(b), int.from_bytes(info[13:18], "big") & (1 << 36) - 1
    done = 0
    while done < total:
        head = _flac_header(b, i)
        if head is None:
            return None
        crc, j = _crc(b[i : i + head[0]], 0x8005, 16), i + head[0]
        stop, final = min(len(b), i + largest), done + head[1] >= total
        while True:  # a frame and its checksum leave 0; behind it is a frame or, at the last, the end of the stream
            if j >= stop:
                return None
            crc, j = _crc(b[j : j + 1], 0x8005, 16, crc), j + 1
            if crc == 0 and j - i >= head[0] + 3 and (final or _flac_header(b, j)):
                break
        i, done = j, done + head[1]
    return i, f"flac:{int.from_bytes(info[10:13], 'big') >> 4}hz:{total}", ("none",)


def _ogg(b: bytes, at: int) -> tuple[int, str, tuple] | None:
    """Pages whose checksums hold, up to the stream's last one (or as far as they go)."""
    i, pages = at, 0
    while b[i : i + 4] == b"OggS" and i + 27 <= len(b) and b[i + 4] == 0:
        n = b[i + 26]
        size = 27 + n + sum(b[i + 27 : i + 27 + n])
        if i + size > len(b) or _crc(b[i : i + 22] + bytes(4) + b[i + 26 : i + size], 0x04C11DB7, 32) != int.from_bytes(b[i + 22 : i + 26], "little"):
            break
        i, pages = i + size, pages + 1
        if b[i - size + 5] & 4 and b[i : i + 4] != b"OggS":
            break
    return (i, f"ogg:{pages}", ("none",)) if pages else None


VALIDATE = {"wav": _wav, "png": _png, "bmp": _bmp, "pgm": _pgm, "gif": _gif, "jpeg": _jpeg, "zip": _zip, "gzip": _gzip, "pdf": _pdf, "flac": _flac, "ogg": _ogg}


@lru_cache(1)
def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for magic, kind, back in MAGIC:
        a.add_word(magic.decode("latin-1"), (len(magic) - 1 + back, kind))
    a.make_automaton()
    return a


def items(blob: bytes) -> list[tuple[str, int, int, str, tuple]]:
    """(format, start, end, description, samples) of the media in blob, by start, none inside another."""
    found, free, memo = [], 0, {}
    for last, (back, kind) in _automaton().iter(blob.decode("latin-1")):
        at = last - back
        if at >= free and (got := VALIDATE[kind](blob, at, memo) if kind in ("zip", "pdf") else VALIDATE[kind](blob, at)):
            found.append((kind, at, got[0], got[1], got[2]))
            free = got[0]
    return found


def samples(blob: bytes, how: tuple) -> bytes | None:
    """The 8-bit samples of an item."""
    if how[0] == "raw":
        return blob[how[1] : how[1] + how[2]]
    if how[0] == "png":
        w, h, bits, colour, *rest = how[1]
        if (bits, colour, rest[2]) != (8, 0, 0):
            return None
        raw = zlib.decompress(b"".join(blob[a : a + n] for a, n in how[2]))
        if len(raw) != (w + 1) * h or any(raw[:: w + 1]):
            return None
        return b"".join(raw[i + 1 : i + 1 + w] for i in range(0, len(raw), w + 1))
    return None


SNIFFED = "struct<kind:string,corrected:boolean,description:string,carved:array<struct<kind:string,start:int,length:int>>>"


def sniff(blob: bytes | None, declared: str | None) -> tuple[str | None, bool, str | None, list[tuple[str, int, int]]]:
    """Type at offset 0 (None if none is valid there), whether that corrects declared, its description,
    and the media carved from the rest."""
    found = items(blob) if blob else []
    first = found[0] if found and found[0][1] == 0 else None
    kind = first[0] if first else None
    return kind, kind is not None and kind != declared, first[3] if first else None, [(k, a, b - a) for k, a, b, _, _ in found if a]


def _sniff_all(blobs: pa.Array, declared: pa.Array) -> pa.Array:
    kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("length", pa.int32())])
    rows = [sniff(b, d) for b, d in zip(blobs.to_pylist(), declared.to_pylist())]
    rows = [{"kind": k, "corrected": c, "description": d, "carved": [dict(zip(("kind", "start", "length"), x)) for x in e]} for k, c, d, e in rows]
    return pa.array(rows, pa.struct([("kind", pa.string()), ("corrected", pa.bool_()), ("description", pa.string()), ("carved", pa.list_(kind))]))


def sniffed(blob: Column, declared: Column) -> Column:
    """SNIFFED of each blob and the type it was declared as."""
    return F.arrow_udf(_sniff_all, SNIFFED)(blob, declared)


def _store(texts: pa.Array) -> pa.Array:
    sizes, declared, media = [], [], []
    for t in texts.to_pylist():
        data = (t or "").encode("utf-8", "surrogatepass")
        payload = pad(data)
        pick = zlib.crc32(payload)
        sizes.append(len(data))
        declared.append(KINDS[(pick >> 8) % len(KINDS)])  # often wrong: sniffing has to find the type
        media.append(encode(payload, KINDS[pick % len(KINDS)]))
    return pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), pa.array(declared, pa.string()), pa.array(media, pa.binary())], ["n_bytes", "declared", "media"])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "kind", "corrected"]
    for b in batches:
        out: list[tuple] = []
        for n, declared, media in zip(*(b.column(i).to_pylist() for i in (1, 2, 3))):
            found = items(media)
            if not found or found[0][1] or found[0][2] != len(media):
                raise ValueError("stored media doesn't validate")
            kind, _, _, text, how = found[0]
            payload = samples(media, how)
            counts = len(set(payload))
            feature = f"{text}:levels={counts}:mean={sum(payload) / len(payload):.3f}"
            out.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature, kind, kind != declared))
        cols = list(zip(*out)) or [[] for _ in names[1:]]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_()]
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds))], names)


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, declared, media of every document, written below the shared folder and read back."""
    path = fresh_path(docs.sparkSession, "media")
    out = docs.select("doc_id", F.arrow_udf(_store, "struct<n_bytes:bigint,declared:string,media:binary>")(F.col("text").cast("string")).alias("m")).select("doc_id", "m.*")
    out.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(out.schema).parquet(path)


def read_back(stored: DataFrame) -> DataFrame:
    kind = stored.schema["doc_id"].dataType.simpleString()
    return stored.select("doc_id", "n_bytes", "declared", "media").mapInArrow(
        _read, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, kind string, corrected boolean"
    )
