"""Matching of rules and records: fingerprints, heuristics, resolution, names, caps, constraints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X


def fingerprint_match(binaries: DataFrame, schemes: list[dict]) -> DataFrame:
    """Scheme and score of each binary that meets all conditions of a scheme, and at least one.

    ``binaries``: id, sha256, machine, text (all strings), imports, facts. A scheme may give sha256,
    machine, strings, imports and facts. Rules are literals of one projection, so no join is made.
    """
    tests = []
    for s in schemes:
        conditions: list[tuple[Column, int]] = []
        if s.get("sha256"):
            conditions.append((F.lower("sha256") == s["sha256"].lower(), 35))
        if s.get("machine"):
            conditions.append((F.lower("machine") == s["machine"].lower(), 15))
        conditions += [(X.contains_ignoring_case(F.col("text"), F.lit(v)), 15) for v in s.get("strings", ())]
        conditions += [(_holds("imports", v), 15) for v in s.get("imports", ())]
        conditions += [(F.array_contains("facts", v), 15) for v in s.get("facts", ())]
        if conditions:
            every = conditions[0][0]
            for c, _ in conditions[1:]:
                every = every & c
            tests.append(F.when(F.coalesce(every, F.lit(False)), F.struct(F.lit(s["id"]).alias("scheme_id"), F.lit(s.get("revision", 1)).alias("revision"), F.lit(min(100, sum(p for _, p in conditions))).alias("score"))))
    return binaries.select("id", F.explode(F.filter(F.array(*tests), lambda t: t.isNotNull())).alias("m")).select("id", "m.*")


def _holds(column: str, value: str) -> Column:
    return F.exists(column, lambda x: F.lower(x) == value.lower())


def heuristic_score(rows: DataFrame, text: str, marks: list[tuple[str, int]], constants: Column | None = None) -> DataFrame:
    """Additive score of strings that a text holds, ten a constant up to thirty, at most 100; no row without any."""
    score = F.lit(0)
    for value, points in marks:
        score = score + F.when(X.contains_ignoring_case(F.col(text), F.lit(value)), points).otherwise(0)
    if constants is not None:
        score = score + F.least(constants * 10, F.lit(30))
    out = rows.withColumn("score", F.least(score, F.lit(100)).cast("int")).where("score > 0")
    return out.withColumn("confidence", F.when(F.col("score") >= 80, "strong").when(F.col("score") >= 45, "medium").otherwise("weak"))


def resolve(matches: DataFrame, group: str, candidate: str) -> DataFrame:
    """NoMatch, Selected or Ambiguous by the number of distinct candidates; only one alone is chosen."""
    out = matches.groupBy(group).agg(F.count_distinct(candidate).alias("n"), F.min(candidate).alias("least"))
    status = F.when(F.col("n") == 0, "NoMatch").when(F.col("n") == 1, "Selected").otherwise("Ambiguous")
    return out.select(group, status.alias("status"), F.when(F.col("n") == 1, F.col("least")).alias("selected"))


def name_mapping(entries: DataFrame, exact: DataFrame, fallback: DataFrame, exact_key: str, fallback_key: str, name: str) -> DataFrame:
    """The name by the exact key, else by the fallback key, else its own. Lookups: key, name; one name a key."""
    e, f = exact.toDF("exact_key", "exact_name"), fallback.toDF("fallback_key", "fallback_name")
    out = entries.join(e, F.col(exact_key) == F.col("exact_key"), "left").join(f, F.col(fallback_key) == F.col("fallback_key"), "left")
    return out.withColumn("mapped_name", F.coalesce("exact_name", "fallback_name", name)).drop("exact_key", "exact_name", "fallback_key", "fallback_name")


def relationships(imports: DataFrame, modules: DataFrame) -> DataFrame:
    """Each import (source, module) with the first local path of that file name, ignoring case; null if there is none."""
    local = modules.groupBy(F.upper("file_name").alias("k")).agg(F.min_by("path", F.struct(F.upper("path"), "path")).alias("resolved_path"))
    return imports.join(local, F.upper("module") == F.col("k"), "left").select("source", "module", "resolved_path")


def duplicate_names(entries: DataFrame, by: list[str], name: str, order: list[str]) -> DataFrame:
    """Later entries of a case-folded name get ``__duplicate-NNN`` before the extension, past names that are taken.

    A generated name without its marks is its entry's name without them, so only names that are equal but
    for marks can meet. Where such a group holds one name, numbers suffice; other groups follow the exact rule.
    """
    keyed = entries.withColumn("folded", F.upper(name)).withColumn("bare", F.regexp_replace("folded", "__DUPLICATE-[0-9]{3,}", ""))
    group = [*by, "bare"]
    mixed = keyed.groupBy(*group).agg(F.min("folded").alias("lo"), F.max("folded").alias("hi")).where("lo <> hi").select(*[F.col(c).alias(f"mixed_{c}") for c in group])
    same = [F.col(c).eqNullSafe(F.col(f"mixed_{c}")) for c in group]
    nth = F.row_number().over(Window.partitionBy(*by, "folded").orderBy(*order))
    ext = F.regexp_extract(F.col(name), r"(\.[^./\\]+)$", 1)
    stem = F.expr(f"left(`{name}`, length(`{name}`) - length(regexp_extract(`{name}`, '(\\\\.[^./\\\\\\\\]+)$', 1)))")
    fast = keyed.join(mixed, same, "left_anti").withColumn("nth", nth).withColumn("output_name", F.when(F.col("nth") == 1, F.col(name)).otherwise(F.concat(stem, F.format_string("__duplicate-%03d", F.col("nth")), ext))).drop("folded", "bare")

    def probe(group):
        import pyarrow as pa
        import pyarrow.compute as pc

        group = group.take(pc.sort_indices(group, [(c, "ascending") for c in order], null_placement="at_start"))
        names, seen, numbers = group[name].to_pylist(), {}, []
        for folded in group["folded"].to_pylist():
            seen[folded] = seen.get(folded, 0) + 1
            numbers.append(seen[folded])
        return group.drop_columns(["folded", "bare"]).append_column("nth", pa.array(numbers, pa.int32())).append_column("output_name", pa.array(exact_duplicate_names(names), pa.string()))

    exact = keyed.join(mixed, same, "left_semi").groupBy(*group).applyInArrow(probe, fast.schema)
    return fast.unionByName(exact)


def exact_duplicate_names(names: list[str]) -> list[str]:
    """Output names of one archive in order, probing past names that are taken, as the exact rule has it."""
    taken: set[str] = set()
    last: dict[str, int] = {}
    out = []
    for name in names:
        chosen, n = name, last.get(name.upper(), 1)
        stem, dot, ext = name.rpartition(".")
        if not dot or "/" in ext or "\\" in ext or not ext:
            stem, dot, ext = name, "", ""
        while chosen.upper() in taken:
            n += 1
            chosen = f"{stem}__duplicate-{n:03d}{dot}{ext}"
        taken.add(chosen.upper())
        last[name.upper()] = n
        out.append(chosen)
    return out


def capped(rows: DataFrame, by: list[str], order: list[str], code: str, most: int = 32, marker: bool = True) -> DataFrame:
    """The first ``most`` rows of each group and code; with ``marker``, one row more whose code ends in _CAPPED."""
    nth = F.row_number().over(Window.partitionBy(*by, code).orderBy(*order))
    out = rows.withColumn("nth", nth).where(F.col("nth") <= most + int(marker))
    return out.withColumn("code", F.when(F.col("nth") > most, F.concat(F.col(code), F.lit("_CAPPED"))).otherwise(F.col(code)))


def layout_problems(entries: DataFrame, segments: DataFrame, key: str, packed: str, unpacked: str) -> DataFrame:
    """Entries against the sums of their segments, without overflow: missing, packed or unpacked mismatch, or ok."""
    sums = segments.groupBy(key).agg(F.sum(F.col("packed_size").cast("decimal(38,0)")).alias("p"), F.sum(F.col("unpacked_size").cast("decimal(38,0)")).alias("u"))
    status = F.when(F.col("p").isNull(), "NoSegments").when(F.col("p") != F.col(packed), "PackedMismatch").when(F.col("u") != F.col(unpacked), "UnpackedMismatch").otherwise("Ok")
    return entries.join(sums, key, "left").withColumn("status", status).drop("p", "u")


def layout_ok(entry_packed: Column, entry_unpacked: Column, segments: Column, length: Column | None) -> Column:
    """The same on nested segments, with their ranges against the archive's length."""
    total = lambda field: F.aggregate(segments, F.lit(0).cast("decimal(38,0)"), lambda a, s: (a + s[field]).cast("decimal(38,0)"))
    fair = F.forall(segments, lambda s: (s["offset"] >= 0) & (s["packed_size"] >= 0) & (s["unpacked_size"] >= 0) & (s["is_compressed"] | (s["packed_size"] == s["unpacked_size"])))
    out = (F.size(segments) > 0) & fair & (total("packed_size") == entry_packed) & (total("unpacked_size") == entry_unpacked)
    if length is not None:
        out = out & F.forall(segments, lambda s: s["offset"].cast("decimal(38,0)") + s["packed_size"] <= length)
    return F.coalesce(out, F.lit(False))


def unique_violations(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("violations")).select(F.lit(name).alias("constraint_name"), "violations")


def reference_violations(rows: DataFrame, key: str, target: DataFrame, target_key: str, name: str) -> DataFrame:
    """Rows whose key the target lacks."""
    t = target.select(F.col(target_key).alias("target")).distinct()
    return rows.join(t, F.col(key) == F.col("target"), "left_anti").agg(F.count("*").alias("violations")).select(F.lit(name).alias("constraint_name"), "violations")


def pattern_violations(rows: DataFrame, column: str, pattern: str, name: str) -> DataFrame:
    return rows.agg(F.count_if(~F.coalesce(F.col(column).rlike(pattern), F.lit(False))).alias("violations")).select(F.lit(name).alias("constraint_name"), "violations")


def rank_candidates(rows: DataFrame, by: list[str], most: int) -> DataFrame:
    """Accepted first, then score, then scheme id; the first ``most`` of each group."""
    w = Window.partitionBy(*by).orderBy(F.desc("accepted"), F.desc("score"), F.asc("scheme_id"))
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def manifest(events: DataFrame, key: list[str], tag: str, value: str, tags: list[str]) -> DataFrame:
    """One row a key: the greatest value of each tag."""
    return events.groupBy(*key).agg(*[F.max(F.when(F.col(tag) == t, F.col(value))).alias(t) for t in tags])
