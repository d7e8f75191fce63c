"""Removal of repeated byte strings: suffixes ordered only as deep as the threshold, by radix passes.

A string of ``LENGTH`` bytes is repeated if it starts at two places of the input; every byte of one is
removed. Only suffixes that begin at *anchors* are sorted: of the windows of ``LENGTH`` bytes, each has
as its anchor the least hash among its grams of ``GRAM`` bytes (the first, if equal), so that equal
windows have equal anchors at equal distances, and about two places in ``LENGTH - GRAM`` are anchors.

The first, most significant digit is the anchor's gram. Anchors with a gram of their own are done:
none of their windows is repeated. An anchor's windows are then told apart by the digits that follow,
in passes over ever finer pieces of its range of windows (the distances of the window's start before
the anchor): a piece whose whole string another place shares is an equal group, so all its windows are
repeated; one whose *core* (the bytes common to all windows of the piece) is unique holds none; any
other is split. The last pass has single windows, ordered through exactly ``LENGTH`` bytes. Digits are
compared as 128-bit digests of their bytes; the gram's 64-bit hash only brings anchors together, and
one that is equal by chance costs a pass more. Equal strings are represented by one place from pass to
pass, so large groups cost no more than small ones. Counts are summed before they are shuffled; a group
is never gathered, and Spark may split the join that brings a frequent string's places back.

Texts are compressed where they travel. Null and empty texts, and texts shorter than the threshold,
lose nothing. A very long text is searched in stretches that overlap by a window. Repeated rows repeat
each other; ties between grams go to the first. Empty tables give no rows. Other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .bytesops import U64, flat, grams, slices, sliding_min

LENGTH, GRAM = 400, 64
#: Sizes of the pieces of the passes; the last is a single window.
PASSES = (64, 8, 1)
#: Bytes of text searched at once, and of contexts in an Arrow batch.
SLICE, CONTEXTS = 1 << 20, 4 << 20
_LOW = U64(0xFFFFFFFF)
ANCHOR = pa.schema([("rid", pa.binary()), ("place", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("gram", pa.int64()), ("whole", pa.binary())])


def digest(data: memoryview, start: int, end: int, mark: bytes) -> bytes:
    """128 bits that stand for a range of bytes and what it is of (16 bytes at most)."""
    return hashlib.blake2b(data[start:end], digest_size=16, person=mark).digest()


def marks(*columns: np.ndarray) -> list[bytes]:
    """The numbers of each row as bytes."""
    raw, wide = np.stack([c.astype("<i4") for c in columns], 1).tobytes(), 4 * len(columns)
    return [raw[i : i + wide] for i in range(0, len(raw), wide)]


def anchors(data: np.ndarray, off: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Row, place in the row, least and greatest distance of windows, gram hash and first byte in ``data``, of each anchor."""
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, U64, np.int64))
    if len(data) < length:
        return none
    hashes = grams(data, gram)
    at = (sliding_min((hashes & ~_LOW) | np.arange(len(hashes), dtype=U64), length - gram + 1) & _LOW).astype(np.int64)
    # Windows that lie within a row.
    inside = np.zeros(len(at) + 1, np.int32)
    full = np.flatnonzero(np.diff(off) >= length)
    inside[off[full]] += 1
    np.subtract.at(inside, off[full + 1] - length + 1, 1)
    window = np.flatnonzero(np.cumsum(inside[:-1]))
    if not len(window):
        return none
    at = at[window]
    begin = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (window[1:] != window[:-1] + 1)])
    first, last, place = window[begin], window[np.r_[begin[1:] - 1, len(window) - 1]], at[begin]
    # Rows of no bytes share an offset with the row after them: the last of equals has the bytes.
    row = np.searchsorted(off, first, "right") - 1
    return row, place - off[row], place - last, place - first, hashes[place], first


def _rid(docs: DataFrame) -> DataFrame:
    return common.id_text(docs).select(common.row_key(F.col("doc_id"), F.col("text")).alias("rid"), "doc_id", "text")


def _anchors(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """rid, place, lo, hi, gram, and the digest of the bytes of all the anchor's windows."""

    def found(data: np.ndarray, off: np.ndarray, rid: pa.Array, before: int) -> Iterator[pa.RecordBatch]:
        row, place, lo, hi, key, first = anchors(data, off, length, gram)
        if len(row):
            view, end = memoryview(np.ascontiguousarray(data)), first + (hi - lo) + length
            whole = [digest(view, a, b, m) for a, b, m in zip(first.tolist(), end.tolist(), marks(lo, hi), strict=True)]
            yield common.batch_of(ANCHOR, rid=rid.take(pa.array(row)), place=place + before, lo=lo, hi=hi, gram=key.view(np.int64), whole=whole)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = flat(batch.column("text"))
            for a, b in slices(off, SLICE):
                rid = batch.column("rid").slice(a, b - a)
                for at in range(int(off[a]), max(int(off[a]) + 1, int(off[b]) - length + 1), SLICE) if b == a + 1 else [int(off[a])]:
                    part = data[at : min(at + SLICE + length - 1, int(off[b]))] if b == a + 1 else data[off[a] : off[b]]
                    yield from found(part, np.array([0, len(part)]) if b == a + 1 else off[a : b + 1] - off[a], rid, at - int(off[a]))

    return common.small_batches(_rid(docs).select("rid", "text")).mapInArrow(run, "rid binary, place long, lo int, hi int, gram long, whole binary")


def packed(docs: DataFrame) -> DataFrame:
    """rid, doc_id and the compressed text."""
    schema = pa.schema([("rid", pa.binary()), ("doc_id", pa.int64()), ("packed", pa.binary())])

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=3).compress
        return common.batch_of(schema, rid=batch.column("rid"), doc_id=batch.column("doc_id"), packed=[squeeze(t) for t in batch.column("text").cast(pa.binary()).to_pylist()])

    return common.map_batches(_rid(docs), each, "rid binary, doc_id long, packed binary")


def _numbers(column: pa.Array, *fields: str) -> tuple[np.ndarray, list[np.ndarray]]:
    """Offsets and fields of a column of lists of structs; null lists are empty."""
    size = np.nan_to_num(pa.compute.list_value_length(column).to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
    items = column.flatten()
    return np.concatenate([[0], np.cumsum(size)]), [items.field(f).to_numpy(zero_copy_only=False) for f in fields]


def _contexts(wanted: DataFrame, docs: DataFrame, length: int) -> DataFrame:
    """whole, lo, hi and the bytes of all windows, of one place of each class."""
    lists = wanted.groupBy("rid").agg(F.collect_list(F.struct("place", "lo", "hi", "whole")).alias("classes"))
    schema = pa.schema([("whole", pa.binary()), ("lo", pa.int32()), ("hi", pa.int32()), ("context", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        open_up = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            column = batch.column("classes")
            begins, (place, lo, hi) = _numbers(column, "place", "lo", "hi")
            whole = column.flatten().field("whole")
            context: list[bytes] = []
            first = size = 0
            for r, text in enumerate(batch.column("packed")):
                text = open_up(text.as_py())
                for i in range(begins[r], begins[r + 1]):
                    context.append(text[place[i] - hi[i] : place[i] - lo[i] + length])
                    size += len(context[-1])
                    if size >= CONTEXTS or i + 1 == len(place):
                        yield common.batch_of(schema, whole=whole.slice(first, i + 1 - first), lo=lo[first : i + 1], hi=hi[first : i + 1], context=context)
                        context, first, size = [], i + 1, 0

    # Repeated rows share a rid: each gives the same contexts, and pieces count distinct classes.
    joined = packed(docs).join(lists.withColumn("rid", common.hidden(F.col("rid"))), "rid").select("packed", "classes")
    return common.small_batches(joined).mapInArrow(run, "whole binary, lo int, hi int, context binary")


def _pieces(contexts: DataFrame, parent: int, size: int, length: int, gram: int) -> DataFrame:
    """class, first distance, digest of the core and of the whole string, of each piece of the blocks (of ``parent`` windows) asked for."""
    widest = length - gram
    schema = pa.schema([("class", pa.int64()), ("first", pa.int32()), ("core", pa.binary()), ("full", pa.binary())])

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, off = flat(batch.column("context"))
        view = memoryview(np.ascontiguousarray(data))
        lo, hi = (batch.column(n).to_numpy().astype(np.int64) for n in ("lo", "hi"))
        blocks = batch.column("blocks")
        row = np.repeat(np.arange(batch.num_rows), np.diff(blocks.offsets.to_numpy()))
        # Each block of the pass before falls into pieces of this size.
        steps = parent // size
        first = (np.asarray(blocks.flatten()).astype(np.int64)[:, None] + size * np.arange(steps)).ravel()
        row = np.repeat(row, steps)
        a, b = first, np.minimum(first + size - 1, widest)
        ok = (a <= hi[row]) & (b >= lo[row]) & (a <= widest)
        row, a, b = row[ok], a[ok], b[ok]
        at = off[row] + hi[row]
        left, right = np.minimum(hi[row], b), np.maximum(lo[row], a)

        def digests(start: np.ndarray, end: np.ndarray, mark: list[bytes]) -> list[bytes]:
            return [digest(view, s, e, m) for s, e, m in zip(start.tolist(), end.tolist(), mark, strict=True)]

        core = digests(at - a, at + length - b, marks(a, b))
        full = digests(at - left, at + length - right, marks(a, b, left, right))
        return common.batch_of(schema, **{"class": batch.column("class").to_numpy()[row]}, first=a, core=core, full=full)

    return common.map_batches(contexts, each, "class long, first int, core binary, full binary")


def repeated_windows(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """rid, begin, end: byte ranges that repeated strings cover, not merged."""
    found = common.stored(_anchors(docs, length, gram))
    classes = common.stored(found.groupBy("whole", "gram", "lo", "hi").agg(F.count("*").alias("n"), F.min(F.struct("rid", "place")).alias("one")))
    shared = classes.groupBy("gram").agg(F.count("*").alias("classes")).where("classes > 1").select((F.col("gram") + 0).alias("gram"))
    equal = classes.where("n > 1").select("whole", F.col("lo").alias("from"), F.col("hi").alias("to"))
    wanted = classes.join(shared, "gram", "left_semi").select("whole", "lo", "hi", "one.rid", "one.place")
    contexts = common.stored(_contexts(wanted, docs, length).dropDuplicates(["whole"]).withColumn("class", F.monotonically_increasing_id()))
    parent = PASSES[0] * -(-(length - gram + 1) // PASSES[0])
    asked, results = contexts.withColumn("blocks", F.array(F.lit(0))), []
    for size in PASSES:
        pieces = common.stored(_pieces(asked, parent, size, length, gram))
        groups = common.stored(pieces.groupBy("core", "full").agg(F.count("*").alias("n"), F.min(F.struct("class", "first")).alias("one")))
        done = pieces.join(groups.where("n > 1").select("full"), "full", "left_semi").select("class", "first", F.lit(size).alias("size"))
        results.append(done)
        open_ = groups.groupBy("core").agg(F.count("*").alias("fulls")).where("fulls > 1").select(common.hidden(F.col("core")).alias("core"))
        blocks = groups.join(open_, "core", "left_semi").groupBy(F.col("one.class").alias("class")).agg(F.collect_list("one.first").alias("blocks"))
        asked, parent = contexts.join(blocks, "class"), size
    every = results[0].unionByName(results[1]).unionByName(results[2])
    told = contexts.select("class", "whole", "lo", "hi").join(every, "class").select("whole", F.greatest("lo", "first").alias("from"), F.least("hi", F.col("first") + F.col("size") - 1).alias("to"))
    ranges = equal.unionByName(told).groupBy("whole").agg(F.collect_set(F.struct("from", "to")).alias("ranges"))
    spread = found.select("rid", "place", "whole").join(ranges.withColumn("whole", common.hidden(F.col("whole"))), "whole").select("rid", "place", F.explode("ranges").alias("r"))
    return spread.select("rid", (F.col("place") - F.col("r.to")).alias("begin"), (F.col("place") - F.col("r.from") + length).alias("end"))


def merged(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges that touch or overlap as one, in order."""
    order = np.argsort(begin, kind="stable")
    begin, reach = begin[order], np.maximum.accumulate(end[order])
    new = np.flatnonzero(np.r_[True, begin[1:] > reach[:-1]])
    return begin[new], reach[np.r_[new[1:] - 1, len(begin) - 1]]


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, with_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, spans (removed byte ranges, merged), kept_sha256 and, if wanted, the bytes that stay."""
    spans = repeated_windows(docs, length, gram).groupBy("rid").agg(F.collect_set(F.struct("begin", "end")).alias("ranges"))
    joined = packed(docs).join(spans.withColumn("rid", common.hidden(F.col("rid"))), "rid", "left").select("doc_id", "packed", "ranges")
    span = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", span), ("kept_sha256", pa.string()), *([("kept", pa.binary())] if with_text else [])])

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        import zstandard

        open_up = zstandard.ZstdDecompressor().decompress
        begins, (begin, end) = _numbers(batch.column("ranges"), "begin", "end")
        sizes, spans_, digests, kept = [], [], [], []
        for r, text in enumerate(batch.column("packed")):
            text = open_up(text.as_py())
            a, b = begin[begins[r] : begins[r + 1]], end[begins[r] : begins[r + 1]]
            if len(a):
                a, b = merged(a, b)
            hashed, view, rest = hashlib.sha256(), memoryview(text), []
            for x, y in zip([0, *b.tolist()], [*a.tolist(), len(text)], strict=True):
                hashed.update(view[x:y])
                if with_text:
                    rest.append(view[x:y])
            sizes.append(len(text))
            spans_.append([{"begin": x, "end": y} for x, y in zip(a.tolist(), b.tolist(), strict=True)])
            digests.append(hashed.hexdigest())
            if with_text:
                kept.append(b"".join(rest))
        return common.batch_of(schema, doc_id=batch.column("doc_id"), n_bytes=sizes, spans=spans_, kept_sha256=digests, **({"kept": kept} if with_text else {}))

    return common.map_batches(joined, each, "doc_id long, n_bytes long, spans array<struct<begin:long,end:long>>, kept_sha256 string" + ", kept binary" * with_text)


def query(spark, sf_dir: str) -> DataFrame:
    found = remove_repeats(common.documents(spark, sf_dir), with_text=False)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["begin"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
