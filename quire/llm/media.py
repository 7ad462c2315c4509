"""Media columns: find out what bytes are from their signatures, and carve what is embedded in them.

An Aho-Corasick automaton finds every known magic number in one pass. A hit counts only if the format's
validator can follow the structure from there (chunk lengths, checksums, markers) and so tells the length.

Cases: null bytes are empty bytes; empty bytes have no type; a declared type that is null or differs from
the validated one is corrected; without a validated type at offset 0 the declared one stays. Equal bytes
give equal results. Columns other than those named are carried along by `sniff`.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import pieces_of, texts


def _png(b: bytes, at: int) -> int | None:
    """Chunks of length, name, body and CRC from IHDR to IEND."""
    i, first = at + 8, True
    while i + 12 <= len(b):
        n, name = struct.unpack_from(">I4s", b, i)
        if i + 12 + n > len(b) or (first and (name != b"IHDR" or n != 13)):
            return None
        if zlib.crc32(b[i + 4 : i + 8 + n]) != struct.unpack_from(">I", b, i + 8 + n)[0]:
            return None
        i, first = i + 12 + n, False
        if name == b"IEND":
            return i - at
    return None


def _jpeg(b: bytes, at: int) -> int | None:
    """Marker segments, then entropy-coded data up to the end marker; a frame header is needed."""
    i, frame = at + 2, False
    while i + 4 <= len(b) and b[i] == 0xFF:
        kind = b[i + 1]
        n = struct.unpack_from(">H", b, i + 2)[0]
        if n < 2 or i + 2 + n > len(b):
            return None
        frame |= 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC)
        i += 2 + n
        if kind == 0xDA:
            while (i := b.find(b"\xff", i)) >= 0 and i + 1 < len(b):
                if b[i + 1] == 0xD9:
                    return i + 2 - at if frame else None
                if b[i + 1] and not 0xD0 <= b[i + 1] <= 0xD7:
                    break  # another segment, as in a progressive image
                i += 2
            else:
                return None
    return None


def _gif(b: bytes, at: int) -> int | None:
    """Screen descriptor, colour tables, blocks made of sub-blocks, trailer."""

    def blocks(i: int) -> int:
        while i < len(b) and b[i]:
            i += b[i] + 1
        return i + 1

    if at + 13 > len(b):
        return None
    i = at + 13 + (3 << (b[at + 10] & 7) + 1 if b[at + 10] & 0x80 else 0)
    while i < len(b):
        if b[i] == 0x3B:
            return i + 1 - at
        if b[i] == 0x21:
            i = blocks(i + 2)
        elif b[i] == 0x2C and i + 10 < len(b):
            i = blocks(i + 10 + (3 << (b[i + 9] & 7) + 1 if b[i + 9] & 0x80 else 0) + 1)
        else:
            return None
    return None


def _bmp(b: bytes, at: int) -> int | None:
    """File header and information header agree with the size stated."""
    if at + 26 > len(b):
        return None
    size, zero, start, header = struct.unpack_from("<IIII", b, at + 2)
    fits = zero == 0 and 26 <= start <= size and at + size <= len(b) and header in (12, 40, 52, 56, 64, 108, 124) and start >= 14 + header
    return size if fits else None


def _riff(kind: bytes, need: tuple[bytes, ...]) -> Callable[[bytes, int], int | None]:
    """A RIFF form whose chunks, padded to even lengths, fill the stated length exactly."""

    def follow(b: bytes, at: int) -> int | None:
        if at + 12 > len(b) or b[at + 8 : at + 12] != kind:
            return None
        end, i, seen = at + 8 + struct.unpack_from("<I", b, at + 4)[0], at + 12, set()
        if end > len(b):
            return None
        while i + 8 <= end:
            name, n = struct.unpack_from("<4sI", b, i)
            seen.add(name)
            i += 8 + n + n % 2
        return end - at if i == end and any(x in seen for x in need) else None

    return follow


def _gzip(b: bytes, at: int) -> int | None:
    """One member that inflates with the right checksum; inflated in pieces, so memory stays small."""
    inflate = zlib.decompressobj(31)
    try:
        i = at
        while i < len(b) and not inflate.eof:
            data = b[i : i + 65536]
            i += len(data)
            inflate.decompress(data, 1 << 20)
            while inflate.unconsumed_tail and not inflate.eof:
                inflate.decompress(inflate.unconsumed_tail, 1 << 20)
    except zlib.error:
        return None
    return i - len(inflate.unused_data) - at if inflate.eof else None


def _pdf(b: bytes, at: int) -> int | None:
    """A version, then a cross-reference offset and an end mark."""
    if not b[at + 5 : at + 8].replace(b".", b"").isdigit():
        return None
    ref = b.find(b"startxref", at)
    end = b.find(b"%%EOF", ref) if ref > 0 else -1
    return end + 5 - at if end > 0 and b[ref + 9 : end].strip().isdigit() else None


def _ogg(b: bytes, at: int) -> int | None:
    """Pages that follow one another, of version 0."""
    i = at
    while b[i : i + 5] == b"OggS\0" and i + 27 <= len(b):
        n = b[i + 26]
        body = sum(b[i + 27 : i + 27 + n])
        if i + 27 + n + body > len(b):
            return None
        i += 27 + n + body
    return i - at if i > at else None


#: Type, magic bytes, what follows the structure.
FORMATS: list[tuple[str, bytes, Callable[[bytes, int], int | None]]] = [
    ("image/png", b"\x89PNG\r\n\x1a\n", _png),
    ("image/jpeg", b"\xff\xd8\xff", _jpeg),
    ("image/gif", b"GIF87a", _gif),
    ("image/gif", b"GIF89a", _gif),
    ("image/bmp", b"BM", _bmp),
    ("audio/wav", b"RIFF", _riff(b"WAVE", (b"data",))),
    ("image/webp", b"RIFF", _riff(b"WEBP", (b"VP8 ", b"VP8L", b"VP8X"))),
    ("application/gzip", b"\x1f\x8b\x08", _gzip),
    ("application/pdf", b"%PDF-", _pdf),
    ("audio/ogg", b"OggS", _ogg),
]


def automaton():
    found: dict[str, list[int]] = {}
    for k, (_, magic, _) in enumerate(FORMATS):
        found.setdefault(magic.decode("latin-1"), []).append(k)
    out = ahocorasick.Automaton()
    for magic, kinds in found.items():
        out.add_word(magic, (len(magic), kinds))
    out.make_automaton()
    return out


def carve(data: bytes, finder) -> list[tuple[int, int, str]]:
    """(offset, length, type) of every validated signature, by offset; those inside another one too."""
    out = []
    for end, (n, kinds) in finder.iter(data.decode("latin-1")):
        at = end + 1 - n
        for k in kinds:
            if (size := FORMATS[k][2](data, at)) is not None:
                out.append((at, size, FORMATS[k][0]))
    return sorted(out)


def wav(payload: bytes, rate: int = 8000) -> bytes:
    """8-bit mono PCM; an odd payload gets the pad byte that RIFF asks for."""
    n, pad = len(payload), len(payload) % 2
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n + pad, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", n)
    return head + payload + b"\0" * pad


def wav_samples(media: bytes) -> bytes | None:
    """The samples of a WAV file, found by walking its chunks."""
    i = 12
    while i + 8 <= len(media):
        name, n = struct.unpack_from("<4sI", media, i)
        if name == b"data":
            return media[i + 8 : i + 8 + n]
        i += 8 + n + n % 2
    return None


def stored_audio(docs: DataFrame, unit: int = 64) -> DataFrame:
    """doc_id, n_bytes, media: each text as UTF-8, filled with zero bytes to a positive multiple of `unit`, as WAV."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces_of(batch):
                raw = [x.encode() for x in part.column("text").to_pylist()]
                media = [wav(x + b"\0" * (-len(x) % unit if x else unit)) for x in raw]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(x) for x in raw], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return texts(docs).mapInArrow(encode, "doc_id long, n_bytes long, media binary")


def sniff(media: DataFrame, column: str = "media", declared: str | None = None) -> DataFrame:
    """media's columns, then detected, corrected (boolean) and carved (offset, length, type) as columns named sniffed_*, with underscores after where the caller has such names.

    declared names the column with the type claimed; without it nothing is claimed.
    """
    kept, taken = media.columns, {c.lower() for c in media.columns}
    names = ["sniffed_detected", "sniffed_corrected", "sniffed_carved"]
    while taken & set(names):
        names = [f"{n}_" for n in names]
    types_ = ("string", "boolean", "array<struct<at:bigint,length:bigint,type:string>>")
    kinds = pa.list_(pa.struct([("at", pa.int64()), ("length", pa.int64()), ("type", pa.string())]))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = automaton()
        for batch in batches:
            for part in pieces_of(batch, column):
                claims = part.column(declared).to_pylist() if declared else [None] * part.num_rows
                types, fixed, found = [], [], []
                for data, claim in zip(part.column(column).to_pylist(), claims, strict=True):
                    hits = carve(data or b"", finder)
                    own = next((t for at, n, t in hits if at == 0), None)
                    types.append(own or claim)
                    fixed.append(own is not None and own != claim)
                    found.append([{"at": at, "length": n, "type": t} for at, n, t in hits if not (at == 0 and n == len(data))])
                arrays = [pa.array(types, pa.string()), pa.array(fixed, pa.bool_()), pa.array(found, kinds)]
                yield pa.RecordBatch.from_arrays([*part.columns, *arrays], [*kept, *names])

    whole = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in media.schema.fields)
    return media.mapInArrow(look, f"{whole}, " + ", ".join(f"{n} {t}" for n, t in zip(names, types_, strict=True)))


def audio_digest(docs: DataFrame) -> DataFrame:
    """The stored texts sniffed and read back: sizes, hashes and a feature string. A text whose media isn't recognised as WAV fails the job."""
    sniffed = sniff(stored_audio(docs).withColumn("claim", F.lit("application/octet-stream")), declared="claim")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for part in pieces_of(batch, "media"):
                for doc, n, media, kind, fixed, carved in zip(*(part.column(c).to_pylist() for c in ("doc_id", "n_bytes", "media", "sniffed_detected", "sniffed_corrected", "sniffed_carved")), strict=True):
                    if kind != "audio/wav":
                        raise ValueError(f"document {doc}: stored as WAV, sniffed as {kind}")
                    data = wav_samples(media)
                    x = np.frombuffer(data, np.uint8)
                    inside = ",".join(f"{c['type']}@{c['at']}+{c['length']}" for c in carved)
                    feature = f"{kind};corrected={int(fixed)};samples={len(data)};sum={int(x.sum(dtype=np.int64))};peak={int(x.max())};steps={int(np.abs(np.diff(x.astype(np.int16))).sum(dtype=np.int64))};carved={inside}"
                    rows.append((doc, n, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature))
            columns = list(zip(*rows, strict=True)) or [[]] * 8
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return sniffed.mapInArrow(digest, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
