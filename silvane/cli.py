"""Command line: JSON on standard output; exit 0 done, 1 usage, 2 bad argument, 3 failed."""

from __future__ import annotations

import hashlib
import json
import sys

from .sources import archives, binaries, media, reading, sinks, tables

USAGE = """usage: python -m silvane.cli COMMAND ...
  probe FILE | verify FILE | analyze FILE
  xp3 list FILE | xp3 profile FILE [--hash] | xp3 pack FOLDER FILE | xp3 extract FILE FOLDER [--xor-hex KEY]
  unpack FOLDER_OR_FILE OUT [CATEGORY] | directory FOLDER | overlay REFERENCE OVERRIDE
  knowledge validate FILE | knowledge list FILE | knowledge match FILE FOLDER | knowledge scan FILE FOLDER
  trace import FILE PID | trace compare LEFT RIGHT PID | filter score FILE KEY_HEX
  psb profile FILE | psb extract-all FILE FOLDER | psb extract FILE NAME FOLDER | convert FILE OUT.png | version"""
# Category words, singular or plural.
CATEGORIES = {"all": "All", "image": "Images", "images": "Images", "audio": "Audio", "script": "Scripts", "scripts": "Scripts", "other": "Other"}


def category(word: str) -> str:
    if word.lower() not in CATEGORIES:
        raise ValueError(f"unknown category: {word}")
    return CATEGORIES[word.lower()]


def _bytes(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def _spark():
    from pyspark.sql import SparkSession

    return SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _rows(df) -> list:
    return [r.asDict(True) for r in df.collect()]


def _archive_paths(path: str) -> list[str]:
    from .sources import files

    if files.input_kind(path) == "Archive":
        return [path]
    return [r["path"] for r in files.discover(_spark(), path).where("role = 'archive'").collect()]


def _profile(path: str, hashed: bool) -> dict:
    from .operators import profiles
    from .plans import pipelines

    entries = pipelines.archive_entries(_spark(), [path])
    out = {"archive": _rows(profiles.archive_profile(entries)), "extensions": _rows(profiles.extension_profile(entries))}
    return out | ({"sha256": hashlib.sha256(_bytes(path)).hexdigest()} if hashed else {})


def _extract(path: str, folder: str, *rest: str) -> list:
    from .plans import pipelines

    options = {}
    if rest[:1] == ("--xor-hex",):
        options = {"content_filter": archives.repeating_xor(bytes.fromhex(rest[1]))}
    written, _ = pipelines.unpack(_spark(), [path], folder, **options)
    return _rows(written)


def _unpack(path: str, folder: str, *rest: str) -> dict:
    from .operators import profiles
    from .plans import pipelines

    written, checked = pipelines.unpack(_spark(), _archive_paths(path), folder, category(rest[0]) if rest else "All")
    return {"written": _rows(written), "totals": _rows(profiles.rollup(checked))[0]}


def _knowledge(what: str, path: str, *rest: str):
    from .operators import rules
    from .plans import pipelines

    base, notes = tables.load_knowledge(path)
    if what == "validate":
        return {"valid": not notes, "diagnostics": notes}
    if what == "list":
        return base.get("schemes") or []
    if what == "match":
        reports, _ = pipelines.analyze_directory(_spark(), rest[0])
        return _rows(rules.fingerprint_match(pipelines.matchable(reports), tables.scheme_rules(base)).orderBy("id", "scheme_id"))
    if what == "scan":
        return _rows(pipelines.knowledge_scan(_spark(), rest[0], base))
    raise ValueError(what)


def _trace(what: str, *rest: str):
    from .plans import pipelines

    if what == "import":
        rows, notes = tables.read_trace(rest[0], int(rest[1]))
        return {"observations": rows, "diagnostics": notes}
    left, right = (tables.trace(_spark(), p, int(rest[2])) for p in rest[:2])
    return _rows(pipelines.trace_compare(left, right))


def _directory(folder: str) -> dict:
    from .plans import pipelines

    reports, links = pipelines.analyze_directory(_spark(), folder)
    return {"reports": _rows(reports), "relationships": _rows(links)}


def _overlay(reference: str, override: str) -> list:
    from .plans import pipelines

    return _rows(pipelines.overlay_directories(_spark(), reference, override).orderBy("rel_path"))


def _index(path: str) -> dict:
    with open(path, "rb") as file:
        return archives.read_index(file)


def _probe(path: str) -> dict:
    with open(path, "rb") as file:
        return archives.probe(file) | {"sha256": hashlib.sha256(_bytes(path)).hexdigest()}


def _convert(path: str, out: str) -> dict:
    sinks.write_new(out, media.to_png(_bytes(path)))
    return {"written": out}


def _filters(path: str, key: str) -> list:
    from .plans import pipelines

    return pipelines.score_filters(_bytes(path), {"repeating-xor": archives.repeating_xor(bytes.fromhex(key))})


COMMANDS = {
    ("version",): lambda: {"version": __import__("silvane").__version__},
    ("probe",): _probe,
    ("verify",): lambda path: media.score(_bytes(path)) | {"psb": media.psb_resources(_bytes(path)) if _bytes(path)[:4] == b"PSB\0" else None},
    ("analyze",): lambda path: binaries.analyze(_bytes(path), path),
    ("directory",): _directory,
    ("overlay",): _overlay,
    ("unpack",): _unpack,
    ("xp3", "list"): _index,
    ("xp3", "profile"): lambda path, *rest: _profile(path, "--hash" in rest),
    ("xp3", "pack"): sinks.pack_directory,
    ("xp3", "extract"): _extract,
    ("knowledge",): _knowledge,
    ("trace",): _trace,
    ("filter", "score"): _filters,
    ("psb", "profile"): lambda path: media.psb_resources(_bytes(path)),
    ("psb", "extract-all"): lambda path, folder: sinks.export_resources(_bytes(path), folder),
    ("psb", "extract"): lambda path, name, folder: sinks.export_resources(_bytes(path), folder, name),
    ("convert",): _convert,
}


def main(args: list[str]) -> int:
    for n in (2, 1):
        if (run := COMMANDS.get(tuple(args[:n]))) and len(args) >= n:
            try:
                print(json.dumps(run(*args[n:]), ensure_ascii=False, indent=2, default=str))
                return 0
            except (TypeError, ValueError, FileNotFoundError) as e:
                print(f"bad argument: {e}", file=sys.stderr)
                return 2
            except (reading.Malformed, OSError) as e:
                print(f"failed: {e}", file=sys.stderr)
                return 3
    print(USAGE, file=sys.stderr)
    return 1


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
