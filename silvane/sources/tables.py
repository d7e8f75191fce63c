"""Text inputs: traces as CSV with its own quoting, knowledge bases and reports as JSON."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .reading import diagnostic

# Operations on files, columns, and limits.
OPERATIONS = ("CreateFile", "ReadFile", "WriteFile", "CloseFile", "CleanupFile", "FlushBuffersFile", "LockFile", "UnlockFile", "QueryDirectory", "QueryInformationFile", "SetInformationFile", "DirectoryControl", "FileSystemControl")
COLUMNS = ("Time of Day", "Process Name", "PID", "Operation", "Path", "Result", "Detail")
MOST_BYTES, MOST_ROWS, MOST_NOTES = 256 << 20, 100_000, 32
TRACE = "source_line int, time_of_day string, process_name string, pid int, operation string, path string, result string, detail string"


def split_line(line: str) -> list[str]:
    """Fields of a line: quotes toggle anywhere, a doubled quote inside quotes is one, no field spans lines."""
    out, field, quoted, i = [], [], False, 0
    while i < len(line):
        c = line[i]
        if c == '"':
            if quoted and line[i + 1 : i + 2] == '"':
                field.append(c)
                i += 1
            else:
                quoted = not quoted
        elif c == "," and not quoted:
            out.append("".join(field))
            field = []
        else:
            field.append(c)
        i += 1
    return [*out, "".join(field)]


def read_trace(path: str, pid: int, most_rows: int = MOST_ROWS) -> tuple[list[tuple], list[dict]]:
    """File operations of a process, and diagnostics. Lines are numbered from 1, the header's."""
    if os.path.getsize(path) > MOST_BYTES:
        return [], [diagnostic("RUNTIME_PROCMON_CSV_TOO_LARGE", "Warning")]
    rows: list[tuple] = []
    notes: list[dict] = []
    wanted = {o.lower() for o in OPERATIONS}

    def note(code: str, line: int) -> None:
        if sum(d["code"] == code for d in notes) < MOST_NOTES:
            notes.append(diagnostic(code, "Warning", f"line {line}"))

    with open(path, encoding="utf-8", errors="replace", newline=None) as file:
        head = file.readline()
        if not head.strip():
            return [], [diagnostic("RUNTIME_PROCMON_CSV_HEADER_MISSING")]
        place: dict[str, int] = {}
        for i, name in enumerate(split_line(head.rstrip("\n"))):
            place.setdefault(name.strip().lstrip("﻿").strip().lower(), i)
        if missing := [c for c in ("PID", "Operation", "Path") if c.lower() not in place]:
            return [], [diagnostic("RUNTIME_PROCMON_CSV_COLUMNS_MISSING", message=", ".join(missing))]
        for number, line in enumerate(file, 2):
            fields = split_line(line.rstrip("\n"))
            get = lambda name: fields[at] if (at := place.get(name.lower(), -1)) >= 0 and at < len(fields) else ""  # noqa: E731, B023
            if not line.strip():
                continue
            if not re.fullmatch(r"\s*\+?[0-9]{1,9}\s*", get("PID")):
                note("RUNTIME_PROCMON_CSV_PID_INVALID", number)
                continue
            if int(get("PID")) != pid or get("Operation").strip().lower() not in wanted:
                continue
            if not get("Path").strip():
                note("RUNTIME_PROCMON_CSV_PATH_MISSING", number)
                continue
            if len(rows) >= most_rows:
                notes.append(diagnostic("RUNTIME_PROCMON_CSV_OBSERVATION_CAPPED", "Warning"))
                break
            rows.append((number, get("Time of Day"), get("Process Name"), int(get("PID")), get("Operation"), get("Path"), get("Result"), get("Detail")))
    return rows, notes


class _Trace(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.pid = options["path"], int(options["pid"])

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(self.path)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from read_trace(self.path, self.pid)[0]


class TraceSource(DataSource):
    """``spark.read.format("procmon_csv").option("pid", n).load(path)``."""

    @classmethod
    def name(cls) -> str:
        return "procmon_csv"

    def schema(self) -> str:
        return TRACE

    def reader(self, schema) -> _Trace:
        return _Trace(self.options)


def trace(spark: SparkSession, path: str, pid: int) -> DataFrame:
    spark.dataSource.register(TraceSource)
    return spark.read.format("procmon_csv").option("pid", str(pid)).load(path)


# --- knowledge bases ------------------------------------------------------------------------------

_SEMVER, _SHA = re.compile(r"\d+\.\d+\.\d+"), re.compile(r"[0-9A-Fa-f]{64}")


def load_knowledge(path: str) -> tuple[dict, list[dict]]:
    """A knowledge base and what is wrong with it: version, required fields, forms, unique keys, references."""
    with open(path, encoding="utf-8") as file:
        base = json.load(file)
    notes: list[dict] = []
    need = lambda ok, code, what: None if ok else notes.append(diagnostic(code, message=str(what)))
    need(base.get("schemaVersion") == "1.0", "KNOWLEDGE_SCHEMA_VERSION_UNSUPPORTED", base.get("schemaVersion"))
    for key in ("id", "displayName"):
        need(str(base.get(key) or "").strip(), "KNOWLEDGE_FIELD_REQUIRED", key)
    seen: set[tuple] = set()
    for s in base.get("schemes") or []:
        key = (s.get("id"), s.get("revision"))
        need(str(s.get("id") or "").strip(), "KNOWLEDGE_FIELD_REQUIRED", "schemes.id")
        need(_SEMVER.fullmatch(str(s.get("revision") or "")), "KNOWLEDGE_REVISION_INVALID", key)
        need(key not in seen, "KNOWLEDGE_DUPLICATE_SCHEME", key)
        need(any((s.get("fingerprint") or {}).values()), "KNOWLEDGE_FINGERPRINT_EMPTY", key)
        digest = (s.get("fingerprint") or {}).get("requiredSha256")
        need(not digest or _SHA.fullmatch(digest), "KNOWLEDGE_SHA256_INVALID", digest)
        seen.add(key)
    for c in base.get("compatibility") or []:
        need((c.get("schemeId"), c.get("schemeRevision")) in seen, "KNOWLEDGE_SCHEME_UNKNOWN", c.get("schemeId"))
    return base, notes


def scheme_rules(base: dict) -> list[dict]:
    """Schemes of a knowledge base as the rules that ``fingerprint_match`` takes."""
    out = []
    for s in base.get("schemes") or []:
        f = s.get("fingerprint") or {}
        out.append({"id": s["id"], "revision": s.get("revision"), "sha256": f.get("requiredSha256"), "machine": f.get("requiredMachine"), "strings": f.get("requiredStrings") or [], "imports": f.get("requiredImportedModules") or [], "facts": f.get("requiredFindingIds") or []})
    return out


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """A saved report; another version than 1.0 is refused."""
    report = spark.read.json(path, multiLine=True)
    versions = [r[0] for r in report.select("SchemaVersion").distinct().collect()]
    if versions != ["1.0"]:
        raise ValueError(f"unsupported report version: {versions}")
    return report


def load_filter_scheme(path: str) -> bytes:
    """Key of a repeating-XOR scheme, given as an array of numbers, hex or base64; other algorithms are refused."""
    import base64

    with open(path, encoding="utf-8") as file:
        scheme = json.load(file)
    if str(scheme.get("algorithm", "")).lower() not in ("repeating-xor", "xor"):
        raise ValueError(f"unsupported filter: {scheme.get('algorithm')}")
    p = scheme.get("parameters") or {}
    if "key" in p:
        return bytes(p["key"])
    return bytes.fromhex(p["keyHex"]) if "keyHex" in p else base64.b64decode(p["keyBase64"])
