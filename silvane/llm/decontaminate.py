"""Benchmark decontamination with a distributed positional inverted index.

The index of the training texts is split by document: each *segment* (a few MB of texts) is one row
with its sorted distinct terms, the postings of each term (positions of the segment's token stream, in
order) and the extents of its documents. Terms are two independent 64-bit hashes of a word, so 128 bits
tell words apart. ``build_index`` makes the rows, which are stored in the shared folder; ``phrases`` and
``proximity`` search them.

A phrase is searched from its rarest term in the segment: that term's postings, shifted by its offset,
are the candidate starts, and the shifted postings of the other terms, from rare to frequent, are
intersected with them. A phrase with a term that the segment lacks ends at once. Proximity asks for
all terms within a span of positions, again from the rarest term.

The distinct test phrases travel to the segments in blocks of about ``BLOCK`` phrases, each searched
against all segments, so that what is broadcast at once is bounded; the items that hold a phrase, however
many, are joined to the hits afterwards. Nothing of the training side is collected or shuffled but results.

Null and empty texts have no words and no hits, and null or wordless items have no phrases, nor have
items with a null id. Repeated rows are counted one by one, repeated items once; a text longer than a
segment is a segment of its own; a word that several phrases cover is hit once. Empty tables give no rows
or no hits. Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .bytesops import LOWER, U64, WORDLIKE, flat, slices, word_hashes, words

WINDOW = 10
#: Bytes of text in a segment.
SEGMENT = 2 << 20
#: Phrases broadcast at once.
BLOCK = 100_000
INDEX = "segment string, docs array<long>, first array<long>, terms binary, starts binary, postings binary"


def terms_of(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lower-cased words of a flat batch as terms (two hashes a row), and each row's first word."""
    low = LOWER[data]
    start, end, first = words(low, off, WORDLIKE)
    return np.stack(word_hashes(low, start, end), 1), first


def _arrays(data: np.ndarray, off: np.ndarray) -> dict:
    """The index of one segment: extents of the documents, distinct terms, starts and postings."""
    word, first = terms_of(data, off)
    order = np.argsort(word[:, 0], kind="stable")
    in_order = word[order]
    if ((in_order[1:, 0] == in_order[:-1, 0]) & (in_order[1:, 1] != in_order[:-1, 1])).any():
        order = np.lexsort((word[:, 1], word[:, 0]))
        in_order = word[order]
    new = np.ones(len(word), bool)
    new[1:] = (in_order[1:] != in_order[:-1]).any(1)
    begins = np.flatnonzero(new)
    return {"first": first, "terms": in_order[begins].tobytes(), "starts": np.r_[begins, len(word)].astype(np.uint32).tobytes(), "postings": order.astype(np.uint32).tobytes()}


def build_index(docs: DataFrame) -> DataFrame:
    """Segments of a positional inverted index over ``docs`` (doc_id, text)."""
    schema = pa.schema([("segment", pa.string()), ("docs", pa.list_(pa.int64())), ("first", pa.list_(pa.int64())), ("terms", pa.binary()), ("starts", pa.binary()), ("postings", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.release()
        task, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            data, off = flat(batch.column("text"))
            for a, b in slices(off, SEGMENT):
                part, at = data[off[a] : off[b]], off[a : b + 1] - off[a]
                n += 1
                yield common.batch_of(schema, segment=[f"{task}:{n}"], docs=[batch.column("doc_id")[a:b].to_pylist()], **{k: [v] for k, v in _arrays(part, at).items()})

    return common.small_batches(common.id_text(docs)).mapInArrow(run, INDEX)


class Segment:
    def __init__(self, segment: str, docs: list, first: list | np.ndarray, terms: bytes, starts: bytes, postings: bytes) -> None:
        self.name, self.docs, self.first = segment, docs, np.array(first, np.int64)
        self.terms = np.frombuffer(terms, U64).reshape(-1, 2)
        self.starts, self.positions = np.frombuffer(starts, np.uint32), np.frombuffer(postings, np.uint32)

    def find(self, terms: np.ndarray) -> np.ndarray:
        """Number of each term in the segment, -1 if it is not there."""
        own = self.terms[:, 0]
        at = np.searchsorted(own, terms[:, 0])
        out = np.full(len(terms), -1)
        open_ = np.arange(len(terms))
        while len(open_ := open_[at[open_] < len(own)]) and len(open_ := open_[own[at[open_]] == terms[open_, 0]]):
            same = self.terms[at[open_], 1] == terms[open_, 1]
            out[open_[same]] = at[open_[same]]
            open_ = open_[~same]
            at[open_] += 1  # words whose first hashes are equal
        return out

    def postings(self, term: int) -> np.ndarray:
        return self.positions[self.starts[term] : self.starts[term + 1]].astype(np.int64)

    def phrase(self, terms: np.ndarray) -> np.ndarray:
        """Starts of the phrase, within documents. ``terms`` are numbers of the segment."""
        sizes = self.starts[terms + 1].astype(np.int64) - self.starts[terms]
        order = np.argsort(sizes, kind="stable")
        at = self.postings(terms[order[0]]) - order[0]
        doc = np.searchsorted(self.first, at + order[0], "right") - 1
        at = at[(at >= self.first[doc]) & (at + len(terms) <= self.first[doc + 1])]
        for j in order[1:]:
            if not len(at):
                break
            other = self.postings(terms[j])
            i = np.searchsorted(other, at + j)
            i[i == len(other)] = 0
            at = at[other[i] == at + j]
        return at

    def near(self, terms: np.ndarray, span: int) -> list[tuple[int, int]]:
        """Document number and position of each rarest term that has all others within ``span`` words, in its document."""
        sizes = self.starts[terms + 1].astype(np.int64) - self.starts[terms]
        order = np.argsort(sizes, kind="stable")
        at = self.postings(terms[order[0]])
        doc = np.searchsorted(self.first, at, "right") - 1
        low, high = np.maximum(at - span, self.first[doc]), np.minimum(at + span, self.first[doc + 1] - 1)
        ok = np.ones(len(at), bool)
        for j in order[1:]:
            other = self.postings(terms[j])
            ok &= np.searchsorted(other, high, "right") > np.searchsorted(other, low, "left")
        return list(zip(doc[ok].tolist(), at[ok].tolist(), strict=True))


class Search:
    """Phrases (bytes of their terms) made ready for segments."""

    def __init__(self, tests: list[bytes]) -> None:
        self.tests = tests
        sizes = np.array([len(t) // 16 for t in tests], np.int64)
        self.begins = np.r_[0, np.cumsum(sizes)]
        every = np.frombuffer(b"".join(tests), U64).reshape(-1, 2)
        order = np.lexsort((every[:, 1], every[:, 0]))
        new = np.ones(len(every), bool)
        new[1:] = (every[order][1:] != every[order][:-1]).any(1)
        self.distinct = every[order][new]
        self.back = np.empty(len(every), np.int64)
        self.back[order] = np.cumsum(new) - 1

    def found(self, segment: Segment) -> Iterator[tuple[int, int, np.ndarray]]:
        """Number, size and starts of each phrase that the segment has."""
        known = segment.find(self.distinct)[self.back]
        absent = np.r_[0, np.cumsum(known < 0)]
        for t in np.flatnonzero(absent[self.begins[1:]] == absent[self.begins[:-1]]).tolist():
            own = known[self.begins[t] : self.begins[t + 1]]
            if len(at := segment.phrase(own)):
                yield t, len(own), at

    def hits(self, segment: Segment) -> tuple[dict[int, np.ndarray], dict[int, list[bytes]]]:
        """Covered word positions and phrases, by number of the document in the segment."""
        docs, places, names = [], [], []
        for t, n, at in self.found(segment):
            doc = np.searchsorted(segment.first, at, "right") - 1
            docs.append(np.repeat(doc, n))
            places.append((at[:, None] + np.arange(n)).ravel())
            names += [(d, self.tests[t]) for d in np.unique(doc).tolist()]
        hits: dict[int, np.ndarray] = {}
        if docs:
            place, index = np.unique(np.concatenate(places), return_index=True)
            doc = np.concatenate(docs)[index]
            begin = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
            hits = {int(d): part - segment.first[d] for d, part in zip(doc[begin], np.split(place, begin[1:]), strict=True)}
        phrases: dict[int, list[bytes]] = {}
        for d, name in names:
            phrases.setdefault(d, []).append(name)
        return hits, phrases

    def touched(self, segment: Segment) -> np.ndarray:
        """Numbers of the documents with any phrase."""
        return np.unique(np.concatenate([np.zeros(0, np.int64), *(np.searchsorted(segment.first, at, "right") - 1 for _, _, at in self.found(segment))]))


def test_windows(benchmark: DataFrame, window: int, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id and the terms of each distinct window of its text (all of a shorter text), as little-endian bytes."""
    schema = pa.schema([("item_id", pa.string()), ("terms", pa.binary())])

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, off = flat(batch.column("text"))
        word, first = terms_of(data, off)
        items, found = [], []
        for i, item in enumerate(batch.column("doc_id").to_pylist()):
            own = word[first[i] : first[i + 1]]
            seen = dict.fromkeys(own[k : k + window].tobytes() for k in range(max(1, len(own) - window + 1))) if len(own) else {}
            items += [item] * len(seen)
            found += seen
        return common.batch_of(schema, item_id=items, terms=found)

    source = benchmark.select(F.col(item_col).cast("string").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return common.map_batches(source, each, "item_id string, terms binary").where("item_id is not null")


def phrases(index: DataFrame, tests: list[bytes]) -> DataFrame:
    """For each document of the index: n_words, the positions that any phrase covers, and the phrases.

    ``tests``: terms of each phrase. Results: segment and place (which tell rows apart whatever their
    ids), doc_id, n_words, hits (covered word positions), phrases (their terms).
    """
    schema = pa.schema([("segment", pa.string()), ("place", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("hits", pa.list_(pa.int64())), ("phrases", pa.list_(pa.binary()))])
    sent = index.sparkSession.sparkContext.broadcast(tests)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.release()
        search = Search(sent.value)
        for batch in batches:
            for i in range(batch.num_rows):
                segment = Segment(**batch.slice(i, 1).to_pylist()[0])
                hits, found = search.hits(segment)
                docs = range(len(segment.docs))
                yield common.batch_of(schema, segment=[segment.name] * len(docs), place=list(docs), doc_id=segment.docs, n_words=np.diff(segment.first), hits=[hits.get(d, ()) for d in docs], phrases=[found.get(d, ()) for d in docs])

    return common.small_batches(index).mapInArrow(run, "segment string, place long, doc_id long, n_words long, hits array<long>, phrases array<binary>")


def proximity(index: DataFrame, queries: list[tuple[str, list[str]]], span: int) -> DataFrame:
    """query, doc_id and position where all words of a query stand within ``span`` words of its rarest one."""
    names = [name for name, _ in queries]
    hashed = []
    for _, given in queries:
        data, off = flat(pa.array([" ".join(given)]))
        hashed.append(np.unique(terms_of(data, off)[0], axis=0))
    schema = pa.schema([("query", pa.string()), ("doc_id", pa.int64()), ("position", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.release()
        for batch in batches:
            for row in batch.to_pylist():
                segment, out = Segment(**row), []
                for name, terms in zip(names, hashed, strict=True):
                    known = segment.find(terms)
                    if len(known) and (known >= 0).all():
                        out += [(name, segment.docs[d], p - int(segment.first[d])) for d, p in segment.near(known, span)]
                if out:
                    q, d, p = zip(*out, strict=True)
                    yield common.batch_of(schema, query=list(q), doc_id=list(d), position=list(p))

    return common.small_batches(index).mapInArrow(run, "query string, doc_id long, position long")


def _blocks(windows: DataFrame, block: int) -> Iterator[list[bytes]]:
    """The distinct phrases, about ``block`` at a time."""
    distinct = common.cut(windows.select("terms").distinct())
    parts = -(-distinct.count() // block)
    for k in range(parts):
        yield [bytes(t) for (t,) in distinct.where(F.pmod(F.xxhash64("terms"), F.lit(parts)) == k).collect()]


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """doc_id, n_words, hits (positions of covered words) and items of every document."""
    stored, windows = common.stored(build_index(docs)), common.cut(test_windows(benchmark, window))
    found = [phrases(stored, own) for own in _blocks(windows, block)] or [phrases(stored, [])]
    every = found[0]
    if len(found) > 1:
        for more in found[1:]:
            every = every.unionByName(more)
        together = lambda name: F.array_sort(F.array_distinct(F.flatten(F.collect_list(name)))).alias(name)
        every = every.groupBy("segment", "place").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), together("hits"), together("phrases"))
    every = common.stored(every)
    held = every.select("segment", "place", F.explode("phrases").alias("terms")).join(windows, "terms")
    items = held.groupBy("segment", "place").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    nothing = F.array().cast("array<string>")
    return every.drop("phrases").join(items, ["segment", "place"], "left").withColumn("items", F.coalesce("items", nothing))


def keep_clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """The documents without any test window, with all their columns. No shuffle of the documents; their index is not stored."""
    text_at, out = docs.columns.index("text"), docs
    for own in _blocks(common.cut(test_windows(benchmark, window)), block):
        out = common.small_batches(out).mapInArrow(_clean(docs.sparkSession.sparkContext.broadcast(own), text_at), docs.schema)
    return out


def _clean(sent, text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.release()
        search = Search(sent.value)
        for batch in batches:
            data, off = flat(batch.column(text_at))
            keep = np.ones(batch.num_rows, bool)
            for a, b in slices(off, SEGMENT):
                keep[a + search.touched(Segment("", [], **_arrays(data[off[a] : off[b]], off[a : b + 1] - off[a])))] = False
            yield batch.filter(pa.array(keep))

    return run


def query(spark, sf_dir: str) -> DataFrame:
    found = matches(common.documents(spark, sf_dir), common.table(spark, sf_dir, "benchmark"))
    n_hit = F.size("hits").cast("long")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
