"""Outputs: nothing that exists is ever replaced."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from . import archives, media

# Limits of packing and of resource export.
PACK_FILES, PACK_FILE_BYTES, PACK_BYTES = 250_000, 2 << 30, 16 << 30
EXPORTED, EXPORT_BYTES = 10_000, 4 << 30


def safe_output(root: str, relative: str) -> str:
    """The path below a root; what would leave it is refused."""
    clean = relative.replace("\\", "/")
    base = os.path.realpath(root)
    full = os.path.realpath(os.path.join(base, clean))
    if not clean.strip() or clean.startswith("/") or clean[1:2] == ":" or not full.startswith(base + os.sep):
        raise ValueError(f"path leaves its root: {relative}")
    return full


def write_new(path: str, data: bytes) -> None:
    """A file, written beside its place and linked there: it appears whole, and only if the name is free."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    handle, temporary = tempfile.mkstemp(dir=os.path.dirname(path) or ".", prefix=".partial-")
    try:
        with os.fdopen(handle, "wb") as file:
            file.write(data)
        os.link(temporary, path)
    finally:
        os.unlink(temporary)


def write_report(path: str, report: dict) -> None:
    """A report with its schema version, as JSON."""
    write_new(path, json.dumps({"SchemaVersion": "1.0"} | report, ensure_ascii=False, indent=2, default=str).encode())


def write_rows(df: DataFrame, path: str) -> None:
    """Rows as JSON lines, by Spark; an existing folder is refused."""
    df.write.mode("errorifexists").json(path)


def write_contents(extractions: DataFrame, root: str) -> DataFrame:
    """Files of successful extractions below a local root (column ``output_name``); returns name, written, problem."""

    def run(batches):
        import pandas as pd

        for batch in batches:
            out = []
            for name, content in zip(batch["output_name"], batch["content"], strict=True):
                problem = None
                try:
                    write_new(safe_output(root, name), content)
                except (ValueError, OSError) as e:
                    problem = f"{type(e).__name__}: {e}"
                out.append((name, problem is None, problem))
            yield pd.DataFrame(out, columns=["output_name", "written", "problem"])

    return extractions.where("succeeded").select("output_name", "content").mapInPandas(run, "output_name string, written boolean, problem string")


def pack_directory(source: str, target: str) -> list[dict]:
    """Packs the files of a directory; returns name, length, sha256 and adler32 of each. Limits are checked first."""
    names = sorted(os.path.relpath(os.path.join(d, f), source).replace(os.sep, "/") for d, _, files in os.walk(source) for f in files if not os.path.islink(os.path.join(d, f)))
    sizes = [os.path.getsize(os.path.join(source, n)) for n in names]
    if len(names) > PACK_FILES or sum(sizes) > PACK_BYTES or max(sizes, default=0) > PACK_FILE_BYTES:
        raise ValueError("the files exceed the limits of an archive")
    files = []
    for name, size in zip(names, sizes, strict=True):
        with open(os.path.join(source, name), "rb") as file:
            data = file.read()
        if len(data) != size:
            raise ValueError(f"file changed while it was read: {name}")
        files.append((name, data))
    write_new(target, archives.pack(files))
    return [{"name": n, "length": len(d), "sha256": hashlib.sha256(d).hexdigest(), "adler32": zlib.adler32(d)} for n, d in files]


def export_resources(data: bytes, folder: str, only: str | None = None) -> list[str]:
    """Direct resources of a PSB as files of a new folder, or the one of a name."""
    found = [r for r in media.psb_resources(data)["resources"] if only is None or r["name"] == only]
    if len(found) > EXPORTED or sum(r["length"] for r in found) > EXPORT_BYTES:
        raise ValueError("the resources exceed the limits of an export")
    if only is None:
        os.makedirs(folder)
    out = []
    for r in found:
        clean = "".join("_" if c in '<>:"/\\|?*' or ord(c) < 32 else c for c in r["name"])[:180]
        out.append(f"{r['index']:06d}-{r['position']:06d}-{clean}")
        write_new(os.path.join(folder, out[-1]), data[r["offset"] : r["offset"] + r["length"]])
    return out


def convert_images(files: DataFrame, root: str) -> DataFrame:
    """Images of a frame (rel_path, content) as PNG files; paths that collide, ignoring case, are refused."""
    from ..operators import compare

    target = files.withColumn("output_name", X.change_extension(F.col("rel_path"), ".png"))
    bad, good = compare.collisions(target, F.col("output_name"))

    def run(batches):
        import pandas as pd

        for batch in batches:
            out = []
            for name, content in zip(batch["output_name"], batch["content"], strict=True):
                try:
                    write_new(safe_output(root, name), media.to_png(bytes(content)))
                    out.append((name, True, None))
                except (media.Malformed, ValueError, OSError) as e:
                    out.append((name, False, getattr(e, "code", type(e).__name__)))
            yield pd.DataFrame(out, columns=["output_name", "written", "problem"])

    schema = "output_name string, written boolean, problem string"
    return good.select("output_name", "content").mapInPandas(run, schema).unionByName(bad.select("output_name", F.lit(False).alias("written"), F.lit("OutputCollision").alias("problem")))
