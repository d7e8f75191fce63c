"""Composite plans: unpack, validate, score filters, knowledge scan and compare, research package, traces."""

from __future__ import annotations

import io
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import compare, profiles, rules
from ..sources import archives, binaries, files, media, sinks, tables

# Limits of validation, of scoring and of proofs.
VALIDATE_BYTES, SCORE_BYTES, PROOFS_NEEDED, PROOF_TESTS = 64 << 20, 128 << 20, 2, 16
NOTICE = "$$$ This is a protected archive. $$$"


def archive_entries(spark: SparkSession, paths: list[str]) -> DataFrame:
    import os

    archives.register(spark)
    return spark.read.format("xp3").option("path", os.pathsep.join(paths)).load()


def select_entries(entries: DataFrame, category: str = "All") -> DataFrame:
    """Entries of a category, without the notices that protected archives carry."""
    return entries.where(~F.startswith("name", F.lit(NOTICE))).where(X.matches_category(F.col("name"), category))


def validate(extractions: DataFrame) -> DataFrame:
    """Format, category and stage of extracted contents; those over the size limit are not attempted."""
    import pyarrow as pa

    schema = pa.schema([("entry_name", pa.string()), ("detected_format", pa.string()), ("stage", pa.int32()), ("score", pa.int32()), ("attempted", pa.bool_())])

    def run(batches):
        for batch in batches:
            rows = []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tried = len(content) <= VALIDATE_BYTES
                r = media.score(content) if tried else {"format": media.sniff(content[:32]), "stage": 0, "score": 0}
                rows.append({"entry_name": name, "detected_format": r["format"], "stage": r["stage"], "score": r["score"], "attempted": tried})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    out = extractions.where("succeeded").select("entry_name", "content").mapInArrow(run, "entry_name string, detected_format string, stage int, score int, attempted boolean")
    return out.withColumn("path_category", X.category(F.col("entry_name"))).withColumn("detected_category", X.format_category(F.col("detected_format"))).withColumn("validated", X.accepted(F.col("stage")))


def unpack(spark: SparkSession, paths: list[str], target: str, category: str = "All", **options) -> tuple[DataFrame, DataFrame]:
    """Extracts archives below a folder; returns what was written and the validations of it."""
    chosen = select_entries(archive_entries(spark, paths), category)
    named = rules.duplicate_names(chosen, ["archive"], "name", ["ordinal"]).select("archive", "ordinal", "output_name")
    got = archives.contents(chosen, **options).join(named, ["archive", "ordinal"])
    return sinks.write_contents(got, target), validate(got)


def score_filters(content: bytes, candidates: dict[str, archives.Filter], name: str = "", adler: int | None = None) -> list[dict]:
    """Outputs of each filter, scored and ranked: accepted first, then score, then id."""
    out = []
    for scheme, apply in candidates.items():
        if len(content) > SCORE_BYTES:
            out.append({"scheme_id": scheme, "accepted": False, "score": 0, "code": "FILTER_INPUT_TOO_LARGE", "difference": None})
            continue
        made = apply(name, adler, 0, 0, content)
        r = media.score(made)
        good = r["stage"] >= X.FORMAT_VALIDATED
        out.append({"scheme_id": scheme, "accepted": good, "score": r["score"], "code": r["code"] if good else "FILTER_CANDIDATE_REJECTED", "difference": byte_difference(content, made)})
    return sorted(out, key=lambda r: (not r["accepted"], -r["score"], r["scheme_id"]))


def byte_difference(a: bytes, b: bytes, most: int = 32) -> dict:
    """Changed bytes: how many, the first and last place, and the first ranges. A tail that one lacks has changed."""
    import numpy as np

    n = min(len(a), len(b))
    at = np.flatnonzero(np.frombuffer(a[:n], np.uint8) != np.frombuffer(b[:n], np.uint8))
    at = np.concatenate([at, np.arange(n, max(len(a), len(b)))])
    cut = np.flatnonzero(np.diff(at) > 1) + 1
    ranges = [(int(g[0]), len(g)) for g in np.split(at, cut)] if len(at) else []
    return {"changed": len(at), "first": int(at[0]) if len(at) else None, "last": int(at[-1]) if len(at) else None, "ranges": ranges[:most]}


def prove_filter(archive: bytes, candidates: dict[str, archives.Filter], needed: int = PROOFS_NEEDED, tests: int = PROOF_TESTS, most_size: int = VALIDATE_BYTES) -> str | None:
    """The first candidate under which enough marked entries match their recorded Adler-32; oversized entries use up tests."""
    file = io.BytesIO(archive)
    marked = [e for e in archives.read_index(file)["entries"] if e["is_marked_encrypted"] and e["adler32"] is not None][:tests]
    for scheme, apply in candidates.items():
        proofs = 0
        for e in marked:
            if e["unpacked_size"] <= most_size and archives.extract(file, e, apply, verify_after_filter=True)["succeeded"]:
                proofs += 1
                if proofs >= needed:
                    return scheme
    return None


def gate(archive: bytes, apply: archives.Filter) -> bool:
    """Whether some marked entry reaches full format validation under a filter."""
    file = io.BytesIO(archive)
    for e in archives.read_index(file)["entries"]:
        if e["is_marked_encrypted"]:
            r = archives.extract(file, e, apply)
            if r["succeeded"] and media.score(r["content"])["stage"] >= X.FORMAT_VALIDATED:
                return True
    return False


def _binary_files(spark: SparkSession, listing: DataFrame) -> DataFrame:
    """Content of listed local files, read in the tasks."""

    def run(batches):
        import pandas as pd

        for batch in batches:
            rows = []
            for path in batch["path"]:
                with open(path, "rb") as file:
                    rows.append((path, file.read()))
            yield pd.DataFrame(rows, columns=["path", "content"])

    return listing.select("path").mapInPandas(run, "path string, content binary")


def analyze_directory(spark: SparkSession, root: str, most: int = files.MOST_SCANNED) -> tuple[DataFrame, DataFrame]:
    """Reports of the binaries of a directory, the first by path, and their imports resolved to local files."""
    found = files.listing(spark, root).where(~F.col("is_dir") & F.col("ext").isin(".exe", ".dll", ".tpm")).orderBy(F.upper("rel_path"), "rel_path").limit(most)
    reports = binaries.analyzed(_binary_files(spark, found))
    imports = reports.select(F.col("path").alias("source"), F.explode("pe.imported_modules").alias("module"))
    modules = reports.select("path", F.regexp_extract("path", r"([^/\\]+)$", 1).alias("file_name"))
    return reports, rules.relationships(imports, modules)


def matchable(reports: DataFrame) -> DataFrame:
    """Reports as ``fingerprint_match`` reads them; only observed facts are evidence."""
    return reports.select(F.col("path").alias("id"), "sha256", F.col("pe.machine").alias("machine"), F.array_join(F.transform("strings", lambda s: s["value"]), "\n").alias("text"), F.coalesce("pe.imported_modules", F.array().cast("array<string>")).alias("imports"), F.transform(F.filter("findings", lambda f: f["kind"] == "ObservedFact"), lambda f: f["id"]).alias("facts"))


def knowledge_scan(spark: SparkSession, root: str, base: dict) -> DataFrame:
    """Scanned files with hash, kind, stage and candidate schemes."""
    reports, _ = analyze_directory(spark, root)
    matched = rules.fingerprint_match(matchable(reports), tables.scheme_rules(base)).groupBy("id").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("minus"), "scheme_id"))).alias("m"))
    binaries_ = reports.join(matched, F.col("path") == F.col("id"), "left").select("path", "sha256", "length", F.lit("Binary").alias("kind"), F.when(F.col("pe").isNotNull(), 1).otherwise(0).alias("stage"), F.coalesce(F.transform("m", lambda x: x["scheme_id"]), F.array().cast("array<string>")).alias("candidates"))
    packs = files.listing(spark, root).where(~F.col("is_dir") & (F.col("ext") == ".xp3"))
    probed = _binary_files(spark, packs).select("path", F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("long").alias("length"), F.lit("Archive").alias("kind"), F.startswith("content", F.lit(archives.SIGNATURE)).cast("int").alias("stage"), F.array().cast("array<string>").alias("candidates"))
    return binaries_.unionByName(probed).orderBy(F.upper("path"))


def scan_compare(left: DataFrame, right: DataFrame) -> DataFrame:
    return compare.report_difference(left, right, "path", "sha256", "candidates")


def resolve_game(matches: DataFrame, compatibility: list[dict]) -> dict:
    """NoMatch, Selected or Ambiguous by the distinct verified targets of the matched schemes."""
    matched = {r[0] for r in matches.select("scheme_id").distinct().collect()}
    targets = sorted({c["target"] for c in compatibility if c["schemeId"] in matched and c.get("verified")})
    return {"status": "NoMatch" if not targets else "Selected" if len(targets) == 1 else "Ambiguous", "selected": targets[0] if len(targets) == 1 else None, "targets": targets}


def trace_compare(left: DataFrame, right: DataFrame) -> DataFrame:
    """Differences in how often a process did an operation on a path with a result, in key order."""
    return compare.count_difference(left, right, ["operation", "path", "result"]).orderBy("operation", "path", "result")


def overlay_directories(spark: SparkSession, reference: str, override: str) -> DataFrame:
    """Overlay of two local directories by relative path; neither may lie in the other."""
    import os

    a, b = os.path.realpath(reference) + os.sep, os.path.realpath(override) + os.sep
    if a.startswith(b) or b.startswith(a):
        raise ValueError("the directories overlap")
    sides = []
    for root in (reference, override):
        rows = files.listing(spark, root)
        hashed = _binary_files(spark, rows.where(~F.col("is_dir"))).select("path", F.sha2("content", 256).alias("sha256"))
        sides.append(rows.join(hashed, "path", "left").select("rel_path", "is_dir", "length", "sha256"))
    return compare.overlay(*sides, "rel_path")


def research_package(spark: SparkSession, root: str, base: dict) -> dict:
    """Profiles of archives, reports of binaries without their strings, and matches, as one report."""
    packs = [r["path"] for r in files.listing(spark, root).where(~F.col("is_dir") & (F.col("ext") == ".xp3")).collect()]
    reports, links = analyze_directory(spark, root)
    redacted = reports.withColumn("removed_strings", F.size("strings")).drop("strings")
    rows = lambda df: [r.asDict(True) for r in df.collect()]
    return {"archives": rows(profiles.archive_profile(archive_entries(spark, packs))) if packs else [], "binaries": rows(redacted), "relationships": rows(links), "matches": rows(rules.fingerprint_match(matchable(reports), tables.scheme_rules(base)))}


def reconcile(expected: DataFrame, captured: DataFrame) -> DataFrame:
    """State of each expected key by recorded tags: Captured, Failed or Unconfirmed."""
    tags = rules.manifest(captured, ["key"], "tag", "value", ["saved", "failed"])
    state = F.when(F.col("saved").isNotNull(), "Captured").when(F.col("failed").isNotNull(), "Failed").otherwise("Unconfirmed")
    return expected.join(tags, "key", "left").select("key", state.alias("state"))


RESOLVERS: dict[str, Callable[[DataFrame], DataFrame]] = {}
FILTERS: dict[str, Callable[[bytes], archives.Filter]] = {"repeating-xor": archives.repeating_xor}
