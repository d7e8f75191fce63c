"""Comparisons of two sides: full outer joins on keys, set differences, overlays, byte islands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def count_difference(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose number of rows differs; a key that a side lacks counts 0 there. Null keys are keys."""
    one, two = (side.groupBy(*keys).agg(F.count("*").alias(name)) for side, name in ((left, "left_count"), (right, "right_count")))
    one, two = one.alias("l"), two.alias("r")
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    out = one.join(two, same, "full").select(*[F.coalesce(f"l.{k}", f"r.{k}").alias(k) for k in keys], F.coalesce("left_count", F.lit(0)).cast("long").alias("left_count"), F.coalesce("right_count", F.lit(0)).cast("long").alias("right_count"))
    return out.where("left_count <> right_count")


def report_difference(left: DataFrame, right: DataFrame, key: str, digest: str, extra: str) -> DataFrame:
    """Added, Removed or Changed (digest, ignoring case, or the extra value) by case-folded key."""
    l_, r_ = (side.select(F.upper(key).alias("k"), F.col(key).alias("key"), F.upper(digest).alias("digest"), F.col(extra).alias("extra")) for side in (left, right))
    both = l_.alias("l").join(r_.alias("r"), F.col("l.k") == F.col("r.k"), "full")
    changed = ~F.col("l.digest").eqNullSafe(F.col("r.digest")) | ~F.col("l.extra").eqNullSafe(F.col("r.extra"))
    kind = F.when(F.col("l.k").isNull(), "Added").when(F.col("r.k").isNull(), "Removed").when(changed, "Changed")
    return both.select(F.coalesce("l.key", "r.key").alias("key"), kind.alias("change_kind")).where("change_kind is not null")


def presence_difference(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that one side alone has. Keys of both sides give no row, whatever else differs."""
    one, two = left.select(*keys).distinct().alias("l"), right.select(*keys).distinct().alias("r")
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    removed = one.join(two, same, "left_anti").withColumn("change_kind", F.lit("Removed"))
    return removed.unionByName(two.join(one, same, "left_anti").withColumn("change_kind", F.lit("Added")))


def set_difference(left: DataFrame, right: DataFrame, value: str) -> DataFrame:
    """Values of one side only, case-folded, tagged Added or Removed."""
    one, two = (side.select(F.upper(value).alias("value")).where("value is not null").distinct() for side in (left, right))
    return one.subtract(two).withColumn("change_kind", F.lit("Removed")).unionByName(two.subtract(one).withColumn("change_kind", F.lit("Added")))


def value_difference(pairs: DataFrame, key: str, fields: list[tuple[str, str]]) -> DataFrame:
    """One row for each field whose two values differ, ignoring case. ``fields``: columns of the two sides."""
    rows = F.explode(F.array(*[F.struct(F.lit(a).alias("field"), F.col(a).cast("string").alias("left_value"), F.col(b).cast("string").alias("right_value")) for a, b in fields])).alias("d")
    out = pairs.select(key, rows).select(key, "d.*")
    return out.where(~F.lower("left_value").eqNullSafe(F.lower("right_value")))


def overlay(reference: DataFrame, override: DataFrame, key: str) -> DataFrame:
    """What each override does to the file of its path: Added, Conflict (a directory is there), Identical or Replaced.

    Sides: key, is_dir, length, sha256. Files of the reference alone give no row.
    """
    o, r = override.where(~F.col("is_dir")).alias("o"), reference.alias("r")
    kind = F.when(F.col(f"r.{key}").isNull(), "Added").when(F.col("r.is_dir"), "Conflict").when((F.col("o.length") == F.col("r.length")) & (F.col("o.sha256") == F.col("r.sha256")), "Identical").otherwise("Replaced")
    return o.join(r, F.col(f"o.{key}") == F.col(f"r.{key}"), "left").select(F.col(f"o.{key}").alias(key), kind.alias("change_kind"), F.col("o.length").alias("override_length"), F.col("o.sha256").alias("override_sha256"), F.col("r.length").alias("reference_length"), F.col("r.sha256").alias("reference_sha256"))


def byte_islands(pairs: DataFrame, key: list[str], a: Column, b: Column) -> DataFrame:
    """Maximal ranges of places at which two byte strings differ; what one has beyond the other's end differs.

    Places are compared as binary slices inside each row, and neighbours are told by their number.
    """
    rows = pairs.select(*key, F.encode(a, "UTF-8").alias("a"), F.encode(b, "UTF-8").alias("b"))
    n = F.greatest(F.octet_length("a"), F.octet_length("b"))
    unlike = lambda i: F.substring("a", i + 1, F.lit(1)) != F.substring("b", i + 1, F.lit(1))
    at = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: (i < n) & unlike(i))
    places = rows.select(*key, F.posexplode(at).alias("nth", "place"))
    return places.groupBy(*key, (F.col("place") - F.col("nth")).alias("island")).agg(F.min("place").cast("long").alias("start"), F.count("*").alias("length")).drop("island")


def collisions(rows: DataFrame, path: Column) -> tuple[DataFrame, DataFrame]:
    """Rows whose case-folded path another row has, and the rest."""
    keyed = rows.withColumn("folded", F.upper(path))
    crowded = keyed.groupBy("folded").agg(F.count("*").alias("n")).where("n > 1").select("folded")
    return keyed.join(crowded, "folded", "left_semi"), keyed.join(crowded, "folded", "left_anti")


def first_per_key(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key. Spark limits groups before the shuffle."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("nth = 1").drop("nth")
