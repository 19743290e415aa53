"""Media columns: sniffing signatures, correcting declared types, carving embedded media; texts stored as 8-bit samples."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import cache

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallychain.llm.common import bounded_batches

PAD, RATE = 64, 8000


def _wav(b: memoryview, at: int) -> int:
    """Length of the RIFF/WAVE file at `at`, or 0: the chunks must fill the declared length, and a data chunk must follow a format chunk."""
    if at + 12 > len(b) or bytes(b[at + 8 : at + 12]) != b"WAVE":
        return 0
    end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
    if end > len(b):
        return 0
    p, fmt, data = at + 12, False, False
    while p + 8 <= end:
        kind, n = bytes(b[p : p + 4]), struct.unpack_from("<I", b, p + 4)[0]
        if kind == b"fmt ":
            fmt = n >= 16
        elif kind == b"data":
            data = fmt
        p += 8 + n + n % 2
    return end - at if fmt and data and p == end else 0


def _png(b: memoryview, at: int) -> int:
    p = at + 8
    while p + 12 <= len(b):
        n, kind = struct.unpack_from(">I", b, p)[0], bytes(b[p + 4 : p + 8])
        if p + 12 + n > len(b) or (p == at + 8) != (kind == b"IHDR"):
            return 0
        if zlib.crc32(b[p + 4 : p + 8 + n]) != struct.unpack_from(">I", b, p + 8 + n)[0]:
            return 0
        p += 12 + n
        if kind == b"IEND":
            return p - at
    return 0


def _gif(b: memoryview, at: int) -> int:
    if at + 13 > len(b):
        return 0
    flags = b[at + 10]
    p = at + 13 + (3 << (flags & 7) + 1 if flags & 128 else 0)

    def blocks(p: int) -> int:
        while p < len(b) and b[p]:
            p += 1 + b[p]
        return p + 1 if p < len(b) else len(b) + 1

    while p < len(b):
        if b[p] == 0x3B:
            return p + 1 - at
        if b[p] == 0x21 and p + 2 < len(b):
            p = blocks(p + 2)
        elif b[p] == 0x2C and p + 10 < len(b):
            flags = b[p + 9]
            p = blocks(p + 11 + (3 << (flags & 7) + 1 if flags & 128 else 0))
        else:
            return 0
    return 0


def _bmp(b: memoryview, at: int) -> int:
    if at + 30 > len(b):
        return 0
    size, _, start, header = struct.unpack_from("<IIII", b, at + 2)
    planes = struct.unpack_from("<H", b, at + 26)[0]
    return size if header in (12, 40, 52, 56, 64, 108, 124) and planes == 1 and 14 + header <= start <= size <= len(b) - at else 0


def _jpeg(b: memoryview, at: int) -> int:
    p = at + 2
    while p + 4 <= len(b) and b[p] == 0xFF:
        kind, n = b[p + 1], struct.unpack_from(">H", b, p + 2)[0]
        if n < 2 or kind in (0, 0xFF):
            return 0
        p += 2 + n
        if kind == 0xDA:
            while True:
                p = _next_marker(b, p)
                if p < 0 or p + 1 >= len(b):
                    return 0
                if b[p + 1] == 0xD9:
                    return p + 2 - at
                if b[p + 1] not in (0, *range(0xD0, 0xD8)):
                    break
                p += 2
    return 0


def _next_marker(b: memoryview, p: int) -> int:
    while p < len(b):
        found = bytes(b[p : p + 65536]).find(b"\xff")
        if found >= 0:
            return p + found
        p += 65536
    return -1


#: Magic bytes, media type and the check of what follows them.
SIGNATURES: dict[bytes, tuple[str, Callable[[memoryview, int], int]]] = {
    b"RIFF": ("audio/x-wav", _wav),
    b"\x89PNG\r\n\x1a\n": ("image/png", _png),
    b"GIF87a": ("image/gif", _gif),
    b"GIF89a": ("image/gif", _gif),
    b"BM": ("image/bmp", _bmp),
    b"\xff\xd8\xff": ("image/jpeg", _jpeg),
}


@cache
def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for magic in SIGNATURES:
        a.add_word(magic.decode("latin-1"), magic)
    a.make_automaton()
    return a


def sniff(blob: bytes) -> list[tuple[int, int, str]]:
    """(offset, length, type) of each medium in blob, in order: signatures that stand up to their format's check, none inside another."""
    view, out, free = memoryview(blob), [], 0
    for end, magic in _automaton().iter(blob.decode("latin-1")):
        at = end + 1 - len(magic)
        if at >= free:
            kind, check = SIGNATURES[magic]
            if n := check(view, at):
                out.append((at, n, kind))
                free = at + n
                if free >= len(blob):
                    break
    return out


def store(text: str | None) -> bytes:
    """The text's UTF-8 bytes, followed by bytes 0 up to a positive multiple of 64, as the 8-bit samples of a WAV file."""
    data = (text or "").encode()
    data += bytes(-len(data) % PAD if data else PAD)
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(data), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(data))
    return head + data


def samples(wav: bytes) -> np.ndarray:
    """The 8-bit samples of a WAV file, found by its chunks."""
    p = 12
    while p + 8 <= len(wav):
        kind, n = wav[p : p + 4], struct.unpack_from("<I", wav, p + 4)[0]
        if kind == b"data":
            return np.frombuffer(wav, np.uint8, n, p + 8)
        p += 8 + n + n % 2
    raise ValueError("no data chunk")


def feature(x: np.ndarray) -> str:
    """Length, mean, root mean square and mean-crossings of samples: integers in thousandths, the same for equal samples."""
    n, total, squares = len(x), int(x.sum(dtype=np.int64)), int((x.astype(np.int64) ** 2).sum())
    above = x.astype(np.int64) * n >= total
    return f"n={n};mean={1000 * total // n};ms={1000 * squares // n};cross={int((above[1:] != above[:-1]).sum())};max={int(x.max())}"


def sniff_column(rows: DataFrame, id_col: str, blob_col: str, declared_col: str) -> DataFrame:
    """(id, declared, media_type, corrected, carved: array of offset, length, type and bytes) for each row.

    media_type is the type of the medium that begins the blob, or the declared type if none does; media elsewhere are embedded. A null
    or empty blob carves nothing and keeps its declared type.
    """
    bounded_batches(rows.sparkSession, 200)
    part = "struct<offset: long, length: long, media_type: string, data: binary>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, blob, said in zip(pdf["id"], pdf["blob"], pdf["declared"]):
                found = sniff(bytes(blob)) if blob is not None else []
                kind = found[0][2] if found and not found[0][0] else said
                out.append((i, said, kind, kind != said, [(a, n, t, bytes(blob[a : a + n])) for a, n, t in found]))
            yield pd.DataFrame(out, columns=["id", "declared", "media_type", "corrected", "carved"])

    kind = rows.schema[id_col].dataType.simpleString()
    own = rows.select(F.col(id_col).alias("id"), F.col(blob_col).cast("binary").alias("blob"), F.col(declared_col).cast("string").alias("declared"))
    return own.mapInPandas(run, f"id {kind}, declared string, media_type string, corrected boolean, carved array<{part}>")


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", declared: str = "application/octet-stream") -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, media_type) for each row of docs.

    Each text is stored as a medium of a declared type that says nothing; sniffing finds what it is, carves it, and its samples are read
    back for the digests. A null text is the empty one. Signatures inside a text lie inside a valid medium and don't divide it.
    Only the id and the text are read.
    """
    bounded_batches(docs.sparkSession, 500)

    def one(text: str | None) -> tuple:
        blob = store(text)
        found = sniff(blob)
        if not found or found[0][0]:
            raise ValueError("the stored medium is not recognised")
        at, n, kind = found[0]
        media = blob[at : at + n]
        x = samples(media)
        payload = x.tobytes()
        digest = lambda b: hashlib.sha256(b).hexdigest()
        return len((text or "").encode()), len(payload), digest(payload), zlib.crc32(payload[-PAD:]), len(media), digest(media), feature(x), kind

    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media_type"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pd.DataFrame([one(t) for t in pdf["text"]], columns=names)
            out.insert(0, "doc_id", pdf["doc_id"])
            yield out

    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = own.schema["doc_id"].dataType.simpleString()
    return own.mapInPandas(run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, media_type string")
