"""XP3 archives: index scan, name tables, entry content, packing.

``read_index`` works on any seekable file and reads the header and the index only. Spark reads archives
in two ways: the ``xp3`` data source (one partition an archive, index reads only) and ``entries_of`` over
a ``binaryFile`` frame, for stores that only Spark opens. Malformed input gives diagnostics, not errors.
"""

from __future__ import annotations

import hashlib
import io
import os
import struct
import zlib
from collections.abc import Callable, Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .reading import DIAGNOSTICS, Malformed, diagnostic

# Signature and limits.
SIGNATURE = bytes.fromhex("5850330D0A200A1A8B6701")
MOST_INDEX, MOST_ENTRIES = 64 << 20, 250_000
STAGE = {"Unidentified": 0, "ContainerIdentified": 1, "IndexParsed": 2, "EntryLocated": 3, "RawDataExtracted": 4, "ContentFilterApplied": 5}

ENTRIES = "archive string, ordinal long, name string, is_marked_encrypted boolean, unpacked_size long, packed_size long, adler32 long, segments array<struct<is_compressed:boolean,offset:long,unpacked_size:long,packed_size:long>>"
INDEXES = f"archive string, stage int, index_offset long, is_index_compressed boolean, entry_count long, diagnostics {DIAGNOSTICS}"


def probe(file: BinaryIO) -> dict:
    """Signature and index offset: is_xp3, index_offset, stage, diagnostics."""
    file.seek(0)
    head = file.read(19)
    bad = lambda code, stage=0: {"is_xp3": stage > 0, "index_offset": None, "stage": stage, "diagnostics": [diagnostic(code)]}
    if len(head) < len(SIGNATURE):
        return bad("XP3_HEADER_TOO_SHORT")
    if not head.startswith(SIGNATURE):
        return bad("XP3_SIGNATURE_MISMATCH")
    if len(head) < 19:
        return bad("XP3_INDEX_OFFSET_MISSING", 1)
    at = struct.unpack_from("<q", head, 11)[0]
    if at < 19:
        return bad("XP3_INDEX_OFFSET_INVALID", 1)
    return {"is_xp3": True, "index_offset": at, "stage": 1, "diagnostics": [diagnostic("XP3_HEADER_IDENTIFIED", "Info", offset=at)]}


def _at(file: BinaryIO, at: int, n: int) -> bytes:
    file.seek(at)
    return file.read(n)


def _inflate(raw: bytes, size: int) -> bytes:
    """Exactly ``size`` bytes from a zlib stream that ends there."""
    engine = zlib.decompressobj()
    try:
        out = engine.decompress(raw, size + 1)
    except zlib.error as e:
        raise Malformed("zlib") from e
    if len(out) != size:
        raise Malformed("zlib")
    return out


def read_index(file: BinaryIO, most_index: int = MOST_INDEX, most_entries: int = MOST_ENTRIES) -> dict:
    """stage, index_offset, is_index_compressed, entries, names, aliases, diagnostics."""
    found = probe(file)
    notes = found["diagnostics"]
    out = {"stage": found["stage"], "index_offset": found["index_offset"] or 0, "is_index_compressed": False, "entries": [], "names": {}, "aliases": {}, "diagnostics": notes}
    if found["index_offset"] is None:
        return out
    length = file.seek(0, io.SEEK_END)
    try:
        raw, compressed = _index_bytes(file, length, out, most_index)
    except Malformed as e:
        notes.append(diagnostic(e.code, offset=e.offset))
        return out
    out["is_index_compressed"] = compressed
    chunks = list(_chunks(raw, notes))
    _hashed_names(chunks, out, most_entries)
    _name_lists(file, length, chunks, out, most_index, most_entries)
    out["entries"] = _entries(chunks, length, notes, most_entries)
    for e in out["entries"]:
        e["name"] = out["aliases"].get(e["name"]) or out["names"].get(e["adler32"]) or e["name"]
    out["stage"] = 1 if any(d["severity"] == "Error" for d in notes) else 2
    return out


def _index_bytes(file: BinaryIO, length: int, out: dict, most: int) -> tuple[bytes, bool]:
    at = out["index_offset"]
    if at >= length:
        raise Malformed("XP3_INDEX_OFFSET_OUT_OF_RANGE", at)
    head = _at(file, at, 17)
    if len(head) == 17 and head[0] == 0x80 and head[1:9] == bytes(8):  # a link to the index proper
        to = struct.unpack_from("<q", head, 9)[0]
        if not 19 <= to < length:
            raise Malformed("XP3_KRKRZ_LINK_INVALID", at + 9)
        at = out["index_offset"] = to
        out["diagnostics"].append(diagnostic("XP3_KRKRZ_INDEX_LINK", "Info", offset=at))
        head = _at(file, at, 17)
    if len(head) < 9:
        raise Malformed("XP3_INDEX_HEADER_TRUNCATED", at)
    kind, packed = head[0], struct.unpack_from("<q", head, 1)[0]
    if kind not in (0, 1):
        raise Malformed("XP3_INDEX_KIND_UNKNOWN", at)
    out["is_index_compressed"] = kind == 1
    if kind and len(head) < 17:
        raise Malformed("XP3_COMPRESSED_INDEX_HEADER_TRUNCATED", at)
    unpacked = struct.unpack_from("<q", head, 9)[0] if kind else packed
    if not (0 <= packed <= most and 0 <= unpacked <= most):
        raise Malformed("XP3_INDEX_SIZE_INVALID", at + 1)
    start = at + (17 if kind else 9)
    if start + packed > length:
        raise Malformed("XP3_INDEX_DATA_OUT_OF_RANGE", start)
    raw = _at(file, start, packed)
    if not kind:
        return raw, False
    try:
        return _inflate(raw, unpacked), True
    except Malformed:
        raise Malformed("XP3_INDEX_DECOMPRESSION_FAILED", start) from None


def _chunks(data: bytes, notes: list[dict], base: int = 0) -> Iterator[tuple[bytes, int, bytes]]:
    """Tag, offset and body of each chunk; stops with a diagnostic at a malformed header."""
    at = 0
    while at < len(data):
        if len(data) - at < 12:
            notes.append(diagnostic("XP3_CHUNK_HEADER_TRUNCATED", offset=base + at))
            return
        size = struct.unpack_from("<q", data, at + 4)[0]
        if not 0 <= size <= len(data) - at - 12:
            notes.append(diagnostic("XP3_CHUNK_LENGTH_INVALID", offset=base + at + 4))
            return
        yield data[at : at + 4], base + at + 12, data[at + 12 : at + 12 + size]
        at += 12 + size


def _good_name(raw: bytes) -> str | None:
    name = raw.decode("utf-16-le", "replace")
    return name if name.strip() and "\0" not in name else None


def _hashed_names(chunks: list, out: dict, most: int) -> None:
    """Names by Adler-32 and by the alias of the name; the first of each key stays."""
    for n, (_, at, body) in enumerate(c for c in chunks if c[0] == b"hnfn"):
        if n >= most:
            out["diagnostics"].append(diagnostic("XP3_HNFN_ENTRY_LIMIT_EXCEEDED", "Warning", offset=at))
            return
        count = struct.unpack_from("<h", body, 4)[0] if len(body) >= 6 else -1
        name = _good_name(body[6 : 6 + 2 * count]) if 0 <= 2 * count <= len(body) - 6 else None
        if name is None:
            out["diagnostics"].append(diagnostic("XP3_HNFN_RECORD_INVALID", "Warning", offset=at))
            continue
        out["aliases"].setdefault(hashlib.md5(name.lower().encode("utf-16-le")).hexdigest(), name)
        out["names"].setdefault(struct.unpack_from("<I", body)[0], name)


def _name_lists(file: BinaryIO, length: int, chunks: list, out: dict, most_index: int, most_entries: int) -> None:
    """Separately compressed lists of names, referred to by chunks whose tag ends in a colon."""
    notes = out["diagnostics"]
    for tag, at, body in chunks:
        if tag[3:] != b":" or len(body) < 16:
            continue
        where, unpacked, packed = struct.unpack_from("<qII", body)
        if max(unpacked, packed) > most_index:
            notes.append(diagnostic("XP3_NAME_LIST_REFERENCE_INVALID", "Warning", offset=at))
            continue
        if where < 0 or where + packed > length:
            notes.append(diagnostic("XP3_NAME_LIST_OUT_OF_RANGE", "Warning", offset=where))
            continue
        try:
            data = _inflate(_at(file, where, packed), unpacked)
        except Malformed:
            notes.append(diagnostic("XP3_NAME_LIST_DECOMPRESSION_FAILED", "Warning", offset=where))
            continue
        p = n = 0
        while p < len(data):
            bad = None
            if len(data) - p < 18:
                bad = "XP3_NAME_LIST_RECORD_TRUNCATED"
            elif n >= most_entries:
                bad = "XP3_NAME_LIST_ENTRY_LIMIT_EXCEEDED"
            else:
                size, key, count = struct.unpack_from("<qIh", data, p + 4)
                if not 6 <= size <= len(data) - p - 12:
                    bad = "XP3_NAME_LIST_RECORD_INVALID"
                elif not 0 <= 2 * count <= size - 6:
                    bad = "XP3_NAME_LIST_NAME_INVALID"
            if bad:
                notes.append(diagnostic(bad, "Warning", offset=where + p))
                break
            if name := _good_name(data[p + 18 : p + 18 + 2 * count]):
                out["names"].setdefault(key, name)
            p, n = p + 12 + size, n + 1


def _entries(chunks: list, length: int, notes: list[dict], most: int) -> list[dict]:
    out: list[dict] = []
    for tag, at, body in chunks:
        if tag != b"File":
            continue
        if len(out) >= most:
            notes.append(diagnostic("XP3_ENTRY_LIMIT_EXCEEDED", offset=at))
            break
        info, segments, adler = None, None, None
        for inner, where, part in _chunks(body, notes, at):
            if inner == b"info":
                info = _info(part)
                if info is None:
                    notes.append(diagnostic("XP3_INFO_INVALID", offset=where))
            elif inner == b"segm":
                segments = _segments(part, where, length, notes)
            elif inner == b"adlr" and len(part) >= 4:
                adler = struct.unpack_from("<I", part)[0]
        if info is None or not segments:
            notes.append(diagnostic("XP3_FILE_ENTRY_INCOMPLETE"))
            continue
        out.append(info | {"ordinal": len(out), "adler32": adler, "segments": segments})
    return out


def _info(part: bytes) -> dict | None:
    """Flags, sizes and the name, after which one zero may stand."""
    if len(part) < 22:
        return None
    flags, unpacked, packed, count = struct.unpack_from("<Iqqh", part)
    rest = len(part) - 22 - 2 * count
    if count <= 0 or unpacked < 0 or packed < 0 or not (rest == 0 or rest == 2 and part[-2:] == b"\0\0"):
        return None
    name = part[22 : 22 + 2 * count].decode("utf-16-le", "replace")
    return {"name": name, "is_marked_encrypted": bool(flags & 0x80000000), "unpacked_size": unpacked, "packed_size": packed}


def _segments(part: bytes, where: int, length: int, notes: list[dict]) -> list[dict] | None:
    if not part or len(part) % 28:
        notes.append(diagnostic("XP3_SEGMENT_LAYOUT_INVALID", offset=where))
        return None
    out = []
    for at in range(0, len(part), 28):
        flags, offset, unpacked, packed = struct.unpack_from("<Iqqq", part, at)
        if offset < 0 or unpacked < 0 or packed < 0 or offset + packed > length:
            notes.append(diagnostic("XP3_SEGMENT_OUT_OF_RANGE", offset=where + at))
            return None
        out.append({"is_compressed": bool(flags & 7), "offset": offset, "unpacked_size": unpacked, "packed_size": packed})
    return out


# --- content ------------------------------------------------------------------------------------

#: A filter of content: (name, adler32, segment number, logical offset, bytes) -> bytes.
Filter = Callable[[str, int | None, int, int, bytes], bytes]


def repeating_xor(key: bytes) -> Filter:
    """The reference filter: XOR with a key repeated from the entry's first byte."""
    import numpy as np

    k = np.frombuffer(key, np.uint8)

    def apply(name: str, adler: int | None, number: int, offset: int, data: bytes) -> bytes:
        b = np.frombuffer(data, np.uint8)
        return (b ^ k[(np.arange(len(b)) + offset) % len(k)]).tobytes()

    return apply


def layout_problem(entry: dict, length: int) -> str | None:
    packed = unpacked = 0
    for s in entry["segments"]:
        if min(s["offset"], s["packed_size"], s["unpacked_size"]) < 0 or s["offset"] + s["packed_size"] > length:
            return "XP3_SEGMENT_OUT_OF_RANGE"
        if not s["is_compressed"] and s["packed_size"] != s["unpacked_size"]:
            return "XP3_UNCOMPRESSED_SEGMENT_SIZE_INVALID"
        packed, unpacked = packed + s["packed_size"], unpacked + s["unpacked_size"]
    if max(packed, unpacked) > 2**63 - 1:
        return "XP3_SEGMENT_SIZE_OVERFLOW"
    if (packed, unpacked) != (entry["packed_size"], entry["unpacked_size"]):
        return "XP3_ENTRY_SIZE_MISMATCH"
    return None


def extract(file: BinaryIO, entry: dict, content_filter: Filter | None = None, allow_unfiltered: bool = False, verify: bool = True, verify_after_filter: bool = False, filter_unmarked: bool = False) -> dict:
    """Content of an entry: stage, succeeded, content, actual_adler32, diagnostics.

    A marked entry without a filter is refused unless allowed. ``verify`` compares the recorded
    Adler-32 with unfiltered content, ``verify_after_filter`` with filtered content.
    """
    use = content_filter if content_filter and (entry["is_marked_encrypted"] or filter_unmarked) else None
    out = {"entry_name": entry["name"], "stage": 3, "succeeded": False, "content": None, "expected_adler32": entry["adler32"], "actual_adler32": None, "diagnostics": []}
    fail = lambda code, **more: out | more | {"diagnostics": [diagnostic(code)]}
    if entry["is_marked_encrypted"] and not use and not allow_unfiltered:
        return fail("XP3_CONTENT_FILTER_REQUIRED", stage=4)
    length = file.seek(0, io.SEEK_END)
    if problem := layout_problem(entry, length):
        return fail(problem)
    parts, offset = [], 0
    for number, s in enumerate(entry["segments"]):
        raw = _at(file, s["offset"], s["packed_size"])
        try:
            data = _inflate(raw, s["unpacked_size"]) if s["is_compressed"] else raw
        except Malformed:
            return fail("XP3_SEGMENT_DECOMPRESSION_FAILED")
        if len(data) != s["unpacked_size"]:
            return fail("XP3_SEGMENT_READ_FAILED")
        parts.append(use(entry["name"], entry["adler32"], number, offset, data) if use else data)
        offset += len(data)
    content = b"".join(parts)
    actual = zlib.adler32(content)
    if entry["adler32"] is not None and (verify_after_filter if use else verify) and actual != entry["adler32"]:
        return fail("XP3_ADLER32_MISMATCH", stage=5 if use else 4, actual_adler32=actual)
    done = diagnostic("XP3_CONTENT_FILTER_APPLIED" if use else "XP3_ENTRY_EXTRACTED", "Info")
    return out | {"stage": 5 if use else 4, "succeeded": True, "content": content, "actual_adler32": actual if entry["adler32"] is not None else None, "diagnostics": [done]}


def pack(files: list[tuple[str, bytes]]) -> bytes:
    """An archive of the files, not compressed, in ordinal order of their names."""
    body, index = bytearray(SIGNATURE + bytes(8)), bytearray()
    chunk = lambda tag, data: tag + struct.pack("<q", len(data)) + data
    for name, data in sorted(files, key=lambda f: f[0].encode("utf-16-be")):
        raw = name.encode("utf-16-le")
        info = struct.pack("<Iqqh", 0, len(data), len(data), len(raw) // 2) + raw
        segm = struct.pack("<Iqqq", 0, len(body), len(data), len(data))
        body += data
        index += chunk(b"File", chunk(b"info", info) + chunk(b"segm", segm) + chunk(b"adlr", struct.pack("<I", zlib.adler32(data))))
    at = len(body)
    body += b"\0" + struct.pack("<q", len(index)) + index
    body[11:19] = struct.pack("<q", at)
    return bytes(body)


# --- Spark --------------------------------------------------------------------------------------


class _Archive(InputPartition):
    def __init__(self, path: str) -> None:
        super().__init__(path)
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.paths = [p for p in options["path"].split(os.pathsep) if p]
        self.what = options.get("what", "entries")

    def partitions(self) -> list[_Archive]:
        return [_Archive(p) for p in self.paths]

    def read(self, partition: _Archive) -> Iterator[tuple]:
        with open(partition.path, "rb") as file:
            index = read_index(file)
        if self.what == "index":
            yield (partition.path, index["stage"], index["index_offset"], index["is_index_compressed"], len(index["entries"]), [tuple(d.values()) for d in index["diagnostics"]])
            return
        for e in index["entries"]:
            yield (partition.path, e["ordinal"], e["name"], e["is_marked_encrypted"], e["unpacked_size"], e["packed_size"], e["adler32"], [tuple(s.values()) for s in e["segments"]])


class Xp3Source(DataSource):
    """``spark.read.format("xp3")``: entries of archives (option ``path``, separated as in PATH), or their index rows (``what=index``)."""

    @classmethod
    def name(cls) -> str:
        return "xp3"

    def schema(self) -> str:
        return INDEXES if self.options.get("what") == "index" else ENTRIES

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)


def entries_of(files: DataFrame) -> DataFrame:
    """Entries of archives in a ``binaryFile`` frame (path, content)."""
    schema = pa.schema([("archive", pa.string()), ("ordinal", pa.int64()), ("name", pa.string()), ("is_marked_encrypted", pa.bool_()), ("unpacked_size", pa.int64()), ("packed_size", pa.int64()), ("adler32", pa.int64()), ("segments", pa.list_(pa.struct([("is_compressed", pa.bool_()), ("offset", pa.int64()), ("unpacked_size", pa.int64()), ("packed_size", pa.int64())])))])

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = [{"archive": path} | e for e in read_index(io.BytesIO(content or b""))["entries"]]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.select("path", "content").mapInArrow(run, ENTRIES)


EXTRACTIONS = f"archive string, ordinal long, entry_name string, stage int, succeeded boolean, content binary, expected_adler32 long, actual_adler32 long, diagnostics {DIAGNOSTICS}"


def contents(entries: DataFrame, **options) -> DataFrame:
    """Content of each entry of local archives, read by its segments alone."""
    schema = pa.schema([("archive", pa.string()), ("ordinal", pa.int64()), ("entry_name", pa.string()), ("stage", pa.int32()), ("succeeded", pa.bool_()), ("content", pa.binary()), ("expected_adler32", pa.int64()), ("actual_adler32", pa.int64()), ("diagnostics", pa.list_(pa.struct([("code", pa.string()), ("severity", pa.string()), ("message", pa.string()), ("offset", pa.int64())])))])

    def run(batches):
        for batch in batches:
            for e in batch.to_pylist():
                with open(e["archive"], "rb") as file:
                    row = {"archive": e["archive"], "ordinal": e["ordinal"]} | extract(file, e, **options)
                yield pa.RecordBatch.from_pylist([row], schema=schema)

    return entries.mapInArrow(run, EXTRACTIONS)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Xp3Source)
