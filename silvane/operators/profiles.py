"""Aggregates over entries: profiles, roll-ups, budgets, proofs, entropy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X


def archive_profile(entries: DataFrame) -> DataFrame:
    """Counts and saturating sums of each archive. ``entries``: archive, is_marked_encrypted, unpacked_size, packed_size, adler32, segments."""
    segments = F.coalesce(F.size("segments"), F.lit(0))
    compressed = F.size(F.filter("segments", lambda s: s["is_compressed"]))
    return entries.groupBy("archive").agg(
        F.count("*").alias("entry_count"),
        F.count_if("is_marked_encrypted").alias("encrypted_count"),
        F.count_if(~F.col("is_marked_encrypted")).alias("plain_count"),
        F.count_if(segments > 1).alias("multi_segment_count"),
        F.sum(F.greatest(compressed, F.lit(0))).cast("long").alias("compressed_segment_count"),
        F.count("adler32").alias("with_adler_count"),
        X.saturating_sum(F.col("packed_size")).alias("packed_bytes"),
        X.saturating_sum(F.col("unpacked_size")).alias("unpacked_bytes"),
    )


def extension_profile(entries: DataFrame) -> DataFrame:
    """Per archive and extension, most packed bytes first."""
    by = entries.withColumn("extension", X.extension_or_none(F.col("name")))
    out = by.groupBy("archive", "extension").agg(F.count("*").alias("entry_count"), F.count_if("is_marked_encrypted").alias("encrypted_count"), X.saturating_sum(F.col("packed_size")).alias("packed_bytes"), X.saturating_sum(F.col("unpacked_size")).alias("unpacked_bytes"))
    return out.orderBy("archive", F.desc("packed_bytes"), F.upper("extension"))


def category_rollup(entries: DataFrame, name: str = "name") -> DataFrame:
    return entries.groupBy(X.category(F.col(name)).alias("category")).agg(F.count("*").alias("entry_count"))


def rollup(validations: DataFrame) -> DataFrame:
    """One row of totals over validations: attempted, validated, recognised, mismatched."""
    mismatch = F.col("detected_category").isNotNull() & (F.col("path_category") != "Other") & (F.col("detected_category") != F.col("path_category"))
    return validations.agg(F.count("*").alias("total"), F.count_if("attempted").alias("attempted"), F.count_if("validated").alias("validated"), F.count_if(F.col("detected_format") != "Unknown").alias("recognised"), F.count_if(mismatch).alias("mismatched"))


def duplicate_surplus(rows: DataFrame, key: Column) -> DataFrame:
    """How many rows repeat the key of another."""
    return rows.groupBy(key.alias("k")).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.greatest(F.col("n") - 1, F.lit(0))), F.lit(0)).cast("long").alias("surplus"))


def budget(rows: DataFrame, by: list[str], order: list[str], size: str, most_items: int, most_item: int, most_total: int) -> DataFrame:
    """Running item count and total, and the first limit that each row breaks."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = rows.withColumn("items", F.count("*").over(w)).withColumn("running", F.sum(F.col(size).cast("decimal(38,0)")).over(w))
    broken = F.when(F.col("items") > most_items, "items").when(F.col(size) > most_item, "item").when(F.col("running") > most_total, "total")
    return out.withColumn("broken", broken).withColumn("running", F.least("running", F.lit(X.MOST).cast("decimal(38,0)")).cast("long"))


def logical_offsets(segments: DataFrame, entry: list[str], order: list[str], size: str) -> DataFrame:
    """Offset of each segment in its entry's content: the sizes of those before it."""
    w = Window.partitionBy(*entry).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return segments.withColumn("logical_offset", F.coalesce(F.sum(size).over(w), F.lit(0)).cast("long"))


def proofs(tests: DataFrame, candidate: str, order: str, ok: str, size: str, most_tests: int, most_size: int, needed: int) -> DataFrame:
    """Candidates that enough entries prove: each tests its first entries in order, and an entry that is too large still uses up a test."""
    at = F.row_number().over(Window.partitionBy(candidate).orderBy(order))
    tried = tests.withColumn("at", at).where(F.col("at") <= most_tests).where(F.col(size) <= most_size)
    return tried.groupBy(candidate).agg(F.count_if(F.col(ok)).alias("proofs")).withColumn("selected", F.col("proofs") >= needed)


def entropy(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Shannon entropy of the bytes of each text, in bits a byte; no rows for empty texts.

    Bytes are counted with map-side partial sums, so a row of any length sends at most 256 counts.
    """
    pairs = F.regexp_extract_all(F.hex(F.encode(F.col(text), "UTF-8")), F.lit("(..)"), F.lit(1))
    counts = texts.where(F.octet_length(text) > 0).select(key, F.explode(pairs).alias("byte")).groupBy(key, "byte").agg(F.count("*").alias("c"))
    n, logs = F.sum("c"), F.sum(F.col("c") * F.log2("c"))
    return counts.groupBy(key).agg(F.round(F.log2(n) - logs / n, 6).alias("entropy"))
