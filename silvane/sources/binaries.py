"""Static analysis of executables: headers, sections, imports, strings, constants, heuristics.

``analyze`` works on bytes; ``analyzed`` maps it over a ``binaryFile`` frame, one struct a file.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.exprs import MACHINES
from .reading import Malformed, Window, diagnostic

# Limits, and words looked for with their names.
MOST_BYTES, MOST_STRINGS, LEAST_LENGTH, SHOWN, MOST_SECTIONS, MOST_IMPORTS, MOST_HITS, MOST_NOTES = 256 << 20, 5000, 4, 256, 96, 1024, 32, 32
CONSTANTS = (
    ("CX_CONSTANT_AAAAAAAA", 0xAAAAAAAA),
    ("CX_CONSTANT_55555555", 0x55555555),
    ("CX_STANDARD_LCG_MULTIPLIER", 0x41C64E6D),
    ("CX_STANDARD_LCG_INCREMENT", 0x00003039),
    ("CX_CONTROL_BLOCK_MASK", 0x000003FF),
)
MARKS = (("control block", 70, "control-block signature string"), ("CxEncryption", 60, "CxEncryption string"), (".tpm", 15, "TPM plugin reference"))


def entropy(data: bytes) -> float:
    """Bits a byte."""
    n = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    p = n[n > 0] / max(1, len(data))
    return float(-(p * np.log2(p)).sum()) if len(data) else 0.0


def machine(code: int) -> str:
    return MACHINES.get(code, f"unknown-0x{code:04X}")


def headers(data: bytes, notes: list[dict]) -> dict | None:
    """Headers, sections with entropy, and sorted distinct import names; None with a diagnostic if they can't be read."""
    if data[:2] != b"MZ":
        notes.append(diagnostic("PE_SIGNATURE_NOT_FOUND", "Info"))
        return None
    w = Window(data, "PE_DOS_HEADER_TRUNCATED")
    try:
        w.take(0, 0x40)
        pe = w.number("I", 0x3C)
        w.take(pe, 24, "PE_HEADER_OFFSET_INVALID")
        if data[pe : pe + 4] != b"PE\0\0":
            raise Malformed("PE_SIGNATURE_INVALID", pe)
        code, declared, stamp, _, _, optional_size = w.many("HHIIIH", pe + 4)
        optional = pe + 24
        w.take(optional, max(2, optional_size), "PE_OPTIONAL_HEADER_INVALID")
        if optional_size < 2:
            raise Malformed("PE_OPTIONAL_HEADER_INVALID", optional)
        magic = w.number("H", optional)
        if magic not in (0x10B, 0x20B):
            raise Malformed("PE_OPTIONAL_HEADER_MAGIC_INVALID", optional)
        directories = optional + (112 if magic == 0x20B else 96)
        if optional + optional_size < directories or optional + 64 > len(data):
            raise Malformed("PE_OPTIONAL_HEADER_TRUNCATED", optional)
        if declared > MOST_SECTIONS:
            notes.append(diagnostic("PE_SECTION_COUNT_CAPPED", "Warning"))
        table = optional + optional_size
        w.take(table, 40 * min(declared, MOST_SECTIONS), "PE_SECTION_TABLE_TRUNCATED")
    except Malformed as e:
        notes.append(diagnostic(e.code, offset=e.offset))
        return None
    sections = []
    for i in range(min(declared, MOST_SECTIONS)):
        at = table + 40 * i
        name = data[at : at + 8].split(b"\0")[0].decode("ascii", "replace")
        span, address, raw_size, raw = w.many("IIII", at + 8)
        bits = None
        if raw_size:
            if raw + raw_size > len(data):
                notes.append(diagnostic("PE_SECTION_RAW_RANGE_INVALID", "Warning"))
            else:
                bits = entropy(data[raw : raw + raw_size])
        sections.append({"name": name, "virtual_address": address, "virtual_size": span, "raw_offset": raw, "raw_size": raw_size, "characteristics": w.number("I", at + 36), "entropy": bits})
    found = imports(w, sections, w.number("I", optional + 60), directories, optional + optional_size, notes)
    return {"machine": machine(code), "machine_code": code, "is_pe32_plus": magic == 0x20B, "timestamp": stamp, "sections": sections, "imported_modules": found}


def file_offset(address: int, sections: list[dict], header_size: int) -> int | None:
    """Where a virtual address lies in the file: the first section that holds it wins."""
    if address < header_size:
        return address
    for s in sections:
        within = address - s["virtual_address"]
        if 0 <= within < max(s["virtual_size"], s["raw_size"]):
            return s["raw_offset"] + within if within < s["raw_size"] else None
    return None


def imports(w: Window, sections: list[dict], header_size: int, directories: int, end: int, notes: list[dict]) -> list[str]:
    out: dict[str, str] = {}

    def note(code: str, at: int | None = None) -> None:
        n = sum(d["code"] == code for d in notes)
        if n < MOST_NOTES:
            notes.append(diagnostic(code, "Warning", offset=at))
        elif n == MOST_NOTES and not any(d["code"] == code + "_CAPPED" for d in notes):
            notes.append(diagnostic(code + "_CAPPED", "Warning"))

    if directories + 16 > end:
        return []
    address = w.number("I", directories + 8)
    if not address:
        return []
    at = file_offset(address, sections, header_size)
    if at is None:
        note("PE_IMPORT_TABLE_RVA_INVALID")
        return []
    for i in range(MOST_IMPORTS + 1):
        try:
            row = w.many("IIIII", at + 20 * i)
        except Malformed:
            note("PE_IMPORT_TABLE_TRUNCATED", at + 20 * i)
            break
        if not any(row):
            break
        if i == MOST_IMPORTS:
            note("PE_IMPORT_COUNT_CAPPED")
            break
        where = file_offset(row[3], sections, header_size)
        stop = w.data.find(b"\0", where, where + 512) if where is not None else -1
        if stop <= (where or 0):
            note("PE_IMPORT_NAME_INVALID", where)
            continue
        name = w.data[where:stop].decode("ascii", "replace")
        out.setdefault(name.upper(), name)
    return [out[k] for k in sorted(out)]


_ASCII = re.compile(rb"[\x20-\x7E]{%d,}" % LEAST_LENGTH)
_WIDE = re.compile(rb"(?:[\x20-\x7E]\x00){%d,}" % LEAST_LENGTH)


def strings(data: bytes, notes: list[dict], most: int = MOST_STRINGS) -> list[dict]:
    """Printable runs, in ASCII first and then in UTF-16, up to the cap; ordered by place."""
    out: list[dict] = []
    for encoding, pattern, wide in (("ascii", _ASCII, 1), ("utf-16le", _WIDE, 2)):
        for m in pattern.finditer(data):
            if len(out) >= most:
                break
            text = m[0][::wide].decode("ascii")
            out.append({"offset": m.start(), "encoding": encoding, "length": len(text), "value": text if len(text) <= SHOWN else text[:SHOWN] + "…"})
    if len(out) == most:
        notes.append(diagnostic("ANALYSIS_STRING_COUNT_CAPPED", "Warning"))
    return sorted(out, key=lambda s: (s["offset"], s["encoding"]))


def constants(data: bytes) -> list[dict]:
    """Places of known little-endian words, overlapping ones too, the first of each kind up to a cap."""
    out = []
    for name, value in CONSTANTS:
        at, hits = data.find(value.to_bytes(4, "little")), 0
        while at >= 0 and hits < MOST_HITS:
            out.append({"kind": "ObservedFact", "id": name, "offset": at, "score": None})
            hits, at = hits + 1, data.find(value.to_bytes(4, "little"), at + 1)
    return out


def heuristic(found: list[dict], facts: list[dict]) -> dict | None:
    """Candidate by marks in strings and by constants; a heuristic is never evidence of a match."""
    held = [s["value"].upper() for s in found]
    score = sum(points for mark, points, _ in MARKS if any(mark.upper() in v for v in held))
    score = min(100, score + min(30, 10 * sum(f["id"].startswith("CX_") for f in facts)))
    return {"kind": "HeuristicCandidate", "id": "HEURISTIC_CX_ENCRYPTION", "offset": None, "score": score} if score else None


def analyze(data: bytes, path: str = "") -> dict:
    notes: list[dict] = []
    out = {"path": path, "sha256": hashlib.sha256(data).hexdigest(), "length": len(data), "pe": None, "strings": [], "findings": [], "diagnostics": notes}
    if len(data) > MOST_BYTES:
        notes.append(diagnostic("ANALYSIS_INPUT_TOO_LARGE", "Warning"))
        return out
    out["pe"] = headers(data, notes)
    findings = []
    if out["pe"]:
        findings.append({"kind": "ObservedFact", "id": "PE_HEADER_PARSED", "offset": None, "score": None})
        findings += [{"kind": "ObservedFact", "id": "PE_IMPORT_MODULE", "offset": None, "score": None} for _ in out["pe"]["imported_modules"]]
    out["strings"] = strings(data, notes)
    facts = constants(data)
    guess = heuristic(out["strings"], facts)
    out["findings"] = findings + facts + ([guess] if guess else [])
    return out


def launcher_probe(report: dict) -> dict:
    """Traits of an executable that a launcher choice reads."""
    pe = report["pe"] or {"machine": None, "imported_modules": [], "sections": []}
    packed = any(s["name"].lower().lstrip(".").startswith(("upx", "aspack", "mpress", "themida", "vmp")) for s in pe["sections"])
    return {"is_x86": pe["machine"] == "x86", "imports_version": any(m.lower() == "version.dll" for m in pe["imported_modules"]), "looks_packed": packed}


_SECTION = pa.struct([("name", pa.string()), ("virtual_address", pa.int64()), ("virtual_size", pa.int64()), ("raw_offset", pa.int64()), ("raw_size", pa.int64()), ("characteristics", pa.int64()), ("entropy", pa.float64())])
_PE = pa.struct([("machine", pa.string()), ("machine_code", pa.int32()), ("is_pe32_plus", pa.bool_()), ("timestamp", pa.int64()), ("sections", pa.list_(_SECTION)), ("imported_modules", pa.list_(pa.string()))])
_STRING = pa.struct([("offset", pa.int64()), ("encoding", pa.string()), ("length", pa.int32()), ("value", pa.string())])
_FINDING = pa.struct([("kind", pa.string()), ("id", pa.string()), ("offset", pa.int64()), ("score", pa.int32())])
_NOTE = pa.struct([("code", pa.string()), ("severity", pa.string()), ("message", pa.string()), ("offset", pa.int64())])
SCHEMA = pa.schema([("path", pa.string()), ("sha256", pa.string()), ("length", pa.int64()), ("pe", _PE), ("strings", pa.list_(_STRING)), ("findings", pa.list_(_FINDING)), ("diagnostics", pa.list_(_NOTE))])
DDL = "path string, sha256 string, length long, pe struct<machine:string,machine_code:int,is_pe32_plus:boolean,timestamp:long,sections:array<struct<name:string,virtual_address:long,virtual_size:long,raw_offset:long,raw_size:long,characteristics:long,entropy:double>>,imported_modules:array<string>>, strings array<struct<offset:long,encoding:string,length:int,value:string>>, findings array<struct<kind:string,id:string,offset:long,score:int>>, diagnostics array<struct<code:string,severity:string,message:string,offset:long>>"


def analyzed(files: DataFrame) -> DataFrame:
    """Reports of the files of a ``binaryFile`` frame (path, content)."""

    def run(batches):
        for batch in batches:
            rows = [analyze(c or b"", p) for p, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=SCHEMA)

    return files.select("path", "content").mapInArrow(run, DDL)
