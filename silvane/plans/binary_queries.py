"""Queries of the byte operators: the driver's tables give the contents, made into files in the tasks."""

from __future__ import annotations

import io

import pyarrow as pa
from pyspark.sql import functions as F

from ..sources import archives, binaries, media
from .table_queries import query, read


def _archives(spark, sf_dir):
    """Pages packed into ten archives: archive, content."""
    pages = read(spark, sf_dir, "pages").select((F.col("page_id") % 10).alias("archive"), F.concat(F.lit("p/"), F.col("page_id").cast("string"), F.lit(".html")).alias("name"), F.encode("html", "UTF-8").alias("data"))

    def make(group: pa.Table) -> pa.Table:
        packed = archives.pack(list(zip(group["name"].to_pylist(), group["data"].to_pylist(), strict=True)))
        return pa.Table.from_pydict({"path": [str(group["archive"][0].as_py())], "content": [packed]}, schema=pa.schema([("path", pa.string()), ("content", pa.binary())]))

    return pages.groupBy("archive").applyInArrow(make, "path string, content binary")


@query("SELECT CAST(page_id % 10 AS VARCHAR) AS archive, 'p/' || page_id || '.html' AS name, strlen(html) AS unpacked_size, strlen(html) AS packed_size, false AS is_marked_encrypted FROM pages")
def archive_entries(spark, sf_dir):
    """S-06 to S-11, K-07: index of archives that were packed from pages."""
    return archives.entries_of(_archives(spark, sf_dir)).select("archive", "name", "unpacked_size", "packed_size", "is_marked_encrypted")


@query("SELECT 'p/' || page_id || '.html' AS name, true AS succeeded, 4 AS stage, sha256(html) AS sha256 FROM pages")
def archive_contents(spark, sf_dir):
    """F-01, F-02, P-07, K-05: contents, checked by their recorded sums."""
    schema = pa.schema([("name", pa.string()), ("succeeded", pa.bool_()), ("stage", pa.int32()), ("content", pa.binary())])

    def run(batches):
        for batch in batches:
            for raw in batch.column(1).to_pylist():
                file = io.BytesIO(raw)
                got = [archives.extract(file, e) for e in archives.read_index(file)["entries"]]
                yield pa.RecordBatch.from_pylist([{"name": g["entry_name"], "succeeded": g["succeeded"], "stage": g["stage"], "content": g["content"]} for g in got], schema=schema)

    out = _archives(spark, sf_dir).mapInArrow(run, "name string, succeeded boolean, stage int, content binary")
    return out.select("name", "succeeded", "stage", F.sha2("content", 256).alias("sha256"))


@query("SELECT page_id, sha256(html) AS sha256, strlen(html) AS length, least(5000, len(regexp_extract_all(html, '[\\x20-\\x7E]{4,}'))) AS n_ascii, false AS is_pe FROM pages")
def static_analysis(spark, sf_dir):
    """V-07, F-06: pages as binaries."""
    files = read(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("path"), F.encode("html", "UTF-8").alias("content"))
    ascii_ = F.size(F.filter("strings", lambda s: s["encoding"] == "ascii")).cast("long")
    return binaries.analyzed(files).select(F.col("path").cast("long").alias("page_id"), "sha256", "length", ascii_.alias("n_ascii"), F.col("pe").isNotNull().alias("is_pe"))


@query("SELECT vec_id, 'Png' AS format, 6 AS stage, 100 AS score, 'PNG_VALIDATED' AS code FROM embeddings WHERE len(embedding) = 64")
def image_scores(spark, sf_dir):
    """B-01, B-08, B-09, F-03: vectors as pixels of 4 by 4 images, encoded and validated."""
    import numpy as np

    vectors = read(spark, sf_dir, "embeddings").where("size(embedding) = 64").select(F.col("vec_id").cast("string").alias("path"), "embedding")
    schema = pa.schema([("path", pa.string()), ("content", pa.binary())])

    def run(batches):
        for batch in batches:
            pixels = [media.encode_png((np.array(v) * 100 + 128).clip(0, 255).astype(np.uint8).reshape(4, 4, 4)) for v in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pixels, pa.binary())], schema=schema)

    return media.scored(vectors.mapInArrow(run, "path string, content binary")).select(F.col("path").cast("long").alias("vec_id"), "format", "stage", "score", "code")


@query("SELECT item_id, sha256(text) AS sha256, strlen(text) > 0 AS changed FROM benchmark")
def filter_round_trip(spark, sf_dir):
    """X-01, X-02, V-04: the reference filter applied twice gives the content again."""
    schema = pa.schema([("item_id", pa.int64()), ("content", pa.binary()), ("changed", pa.bool_())])

    def run(batches):
        apply = archives.repeating_xor(bytes([7, 11, 13]))
        for batch in batches:
            raw = batch.column(1).to_pylist()
            once = [apply("", None, 0, 5, r) for r in raw]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([apply("", None, 0, 5, o) for o in once], pa.binary()), pa.array([a != b for a, b in zip(raw, once, strict=True)])], schema=schema)

    texts = read(spark, sf_dir, "benchmark").select("item_id", F.encode("text", "UTF-8").alias("content"))
    return texts.mapInArrow(run, "item_id long, content binary, changed boolean").select("item_id", F.sha2("content", 256).alias("sha256"), "changed")
