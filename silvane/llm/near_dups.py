"""Near-duplicates by minhash with tensored banding; every link is confirmed on full shingle sets.

A document's set is its distinct shingles of five words (ASCII lower case, white space between words).
Documents with equal sets form a class and are represented once. A class gets ``COLLECTIONS`` small
collections of ``HASHES`` minhashes each; every pair of collections makes one table key, so that
n collections serve n(n-1)/2 tables and about the square root of the minhashes is computed. Two sets of
similarity s agree on a collection with probability s**HASHES and meet in a table if they agree on any
two: with 14 collections of 2, sets of similarity 0.75 are missed with probability below 0.0002.

Candidates are settled in two steps. First by stars: in a bucket (classes with a common key) the least
and the greatest class are centres; each other class is paired with them, pairs are confirmed on full
sets, and components merge. What is still open is mostly classes that share a passage but are not
similar. Those are dealt anew, exactly: two sets can only be similar if the first quarter of both, in
any one order of shingles, meets. With frequent shingles last (a count sketch of fixed size tells them)
a shared passage stays out of that quarter. The buckets of that order are small, but classes may meet in
hundreds of them: of buckets of at most ``PAIRED`` classes, the distinct pairs of close size and different
components are confirmed, once each and those of a neighbourhood together; a larger bucket is searched
within tasks of at most two blocks of about ``WITHIN`` shingles, in all pairs of its blocks, without
emitting pairs. Only links between different components are returned. Every pair of an open bucket is
confirmed, refuted or already connected, with no cap.

Shingles, sets and rows are told apart by 128 bits. A key that many classes share is never gathered: sums
by key are joined back as plain shuffles, which Spark splits. Long texts are hashed in stretches of whole
rows; one text and its shingles must fit a task.

Null and empty texts, and texts of white space, have empty sets: linked with nothing. Null ids never are
the smallest. Repeated rows are one class; ``keep_one`` keeps that of them whose columns hash least. A
similarity of exactly the threshold is a link. Empty tables give empty results. Other columns, whatever
their names, play no part.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .bytesops import LOWER, NON_SPACE, U64, flat, mix, shingle_hashes, slices, word_hashes, words
from .connected import components

SHINGLE = 5
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 75
COLLECTIONS, HASHES = 14, 2
#: Bytes of text hashed at once.
SLICE = 1 << 20


class Shingles:
    """Distinct shingles of rows: two hashes each, ordered by the first within their row."""

    def __init__(self, data: np.ndarray, off: np.ndarray, size: int) -> None:
        low = LOWER[data]
        start, end, first = words(low, off, NON_SPACE)
        one, two, begins = shingle_hashes(word_hashes(low, start, end), first, size)
        row = np.repeat(np.arange(len(off) - 1), np.diff(begins))
        order = np.lexsort((one, row)) if len(off) > 2 else np.argsort(one)
        one, two, row = one[order], two[order], row[order]
        new = np.ones(len(one), bool)
        new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1]) | (row[1:] != row[:-1])
        self.one, self.two = one[new], two[new]
        self.begins = np.searchsorted(row[new], np.arange(len(off)))

    def __getitem__(self, row: int) -> tuple[np.ndarray, np.ndarray]:
        part = slice(self.begins[row], self.begins[row + 1])
        return self.one[part], self.two[part]

    def __len__(self) -> int:
        return len(self.begins) - 1


def unpacked(column: pa.Array, size: int) -> Iterator[tuple[int, Shingles]]:
    """Number of the first row, and shingles, of stretches of rows of compressed texts."""
    import zstandard

    open_up = zstandard.ZstdDecompressor().decompress
    first, held, total = 0, [], 0
    for i, value in enumerate(column):
        text = open_up(value.as_py())
        if held and total + len(text) > SLICE:
            yield first, Shingles(np.frombuffer(b"".join(held), np.uint8), np.cumsum([0, *map(len, held)]), size)
            first, held, total = i, [], 0
        held.append(text)
        total += len(text)
    if held:
        yield first, Shingles(np.frombuffer(b"".join(held), np.uint8), np.cumsum([0, *map(len, held)]), size)


def signatures(docs: DataFrame, size: int, collections: int, hashes: int) -> DataFrame:
    """rid, doc_id, n_shingles, class (digest of the set, null if empty) and the collections' keys of every row."""
    schema = pa.schema([("rid", pa.binary()), ("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("class", pa.binary()), ("keys", pa.list_(pa.int64()))])
    rng = np.random.Generator(np.random.PCG64(31))
    times = rng.integers(1, 2**62, collections * hashes, dtype=np.int64).astype(U64) * U64(2) + U64(1)
    plus = rng.integers(1, 2**62, collections * hashes, dtype=np.int64).astype(U64)
    salt = mix(np.arange(1, collections + 1, dtype=U64))

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, off = flat(batch.column("text"))
        counts, classes, keys = [], [], []
        for a, b in slices(off, SLICE):
            sets = Shingles(data[off[a] : off[b]], off[a : b + 1] - off[a], size)
            full = np.flatnonzero(np.diff(sets.begins))
            made = np.zeros((len(sets), collections), U64)
            if len(full):
                least = [np.minimum.reduceat(sets.one * t + p, sets.begins[full]) for t, p in zip(times, plus, strict=True)]
                for c in range(collections):
                    total = np.full(len(full), salt[c])
                    for h in range(hashes):
                        total = mix(total ^ least[c * hashes + h])
                    made[full, c] = total
            for r in range(len(sets)):
                one, two = sets[r]
                counts.append(len(one))
                classes.append(hashlib.blake2b(one.tobytes() + two.tobytes(), digest_size=16).digest() if len(one) else None)
                keys.append(made[r].view(np.int64) if len(one) else [])
        return common.batch_of(schema, rid=batch.column("rid"), doc_id=batch.column("doc_id"), n_shingles=counts, **{"class": classes}, keys=keys)

    return common.map_batches(_with_rid(docs), each, "rid binary, doc_id long, n_shingles long, class binary, keys array<long>")


def _with_rid(docs: DataFrame) -> DataFrame:
    return common.id_text(docs).select(common.row_key(F.col("doc_id"), F.col("text")).alias("rid"), "doc_id", "text")


def _packed(docs: DataFrame) -> DataFrame:
    """rid and the compressed text: what travels to be confirmed."""
    schema = pa.schema([("rid", pa.binary()), ("packed", pa.binary())])

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=1).compress
        return common.batch_of(schema, rid=batch.column("rid"), packed=[squeeze(t) for t in batch.column("text").cast(pa.binary()).to_pylist()])

    return common.map_batches(_with_rid(docs).select("rid", "text"), each, "rid binary, packed binary")


def _confirmed(edges: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The edges (center, member, their components) whose full sets are similar enough; those of one ``lead``, if given, together."""
    one = texts.select(F.col("class").alias("center"), F.col("packed").alias("packed_a"))
    two = texts.select(F.col("class").alias("member"), F.col("packed").alias("packed_b"))
    pairs = edges.join(one, "center").join(two, "member")
    if "lead" in edges.columns:
        # Dealt so that Spark may still split a large neighbourhood.
        pairs = pairs.hint("rebalance", F.col("lead")).sortWithinPartitions("lead", "center", "member")
    pairs = pairs.select("a", "b", "center", "member", "packed_a", "packed_b")
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.release()
        import zstandard

        open_up = zstandard.ZstdDecompressor().decompress
        known: OrderedDict[bytes, tuple[np.ndarray, np.ndarray]] = OrderedDict()
        held = 0

        def set_of(name: bytes, packed: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
            nonlocal held
            if (found := known.get(name)) is None:
                text = np.frombuffer(open_up(packed.as_py()), np.uint8)
                found = known[name] = Shingles(text, np.array([0, len(text)]), size)[0]
                held += len(found[0])
                while len(known) > 1 and (len(known) > CLASSES or held > WITHIN):
                    held -= len(known.popitem(last=False)[1][0])
            return found

        for batch in batches:
            keep_a, keep_b = [], []
            names = (batch.column(i).to_pylist() for i in range(4))
            for a, b, center, member, pa_, pb in zip(*names, batch.column(4), batch.column(5), strict=True):
                (x, x2), (y, y2) = set_of(center, pa_), set_of(member, pb)
                if len(x) and len(y) and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                    at = np.searchsorted(x, y)
                    at[at == len(x)] = 0
                    common_n = int(((x[at] == y) & (x2[at] == y2)).sum())
                    if 100 * common_n >= percent * (len(x) + len(y) - common_n):
                        keep_a.append(a)
                        keep_b.append(b)
            if keep_a:
                yield common.batch_of(schema, a=keep_a, b=keep_b)

    return common.small_batches(pairs).mapInArrow(run, "a binary, b binary")


def _open(members: DataFrame) -> DataFrame:
    """Rows (key, class, n, comp) of the buckets with more than one component, with the bucket's centres."""
    node = F.struct("class", "comp", "n")
    stars = members.groupBy("key").agg(F.min(node).alias("lo"), F.max(node).alias("hi"), F.min("comp").alias("c0"), F.max("comp").alias("c1"))
    stars = stars.where("c0 <> c1").select((F.col("key") + 0).alias("key"), "lo", "hi")
    return common.cut(members.join(stars, "key"))


def _settle(opened: DataFrame, texts: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Links (a, b: components) that the centres' pairs confirm, and the rows that are left, relabelled."""
    close = 100 * F.least("n", "end.n") >= percent * F.greatest("n", "end.n")
    edges = opened.select("class", "comp", "n", F.explode(F.array("lo", "hi")).alias("end")).where("end.comp <> comp").where(close)
    edges = edges.select(F.col("end.class").alias("center"), F.col("class").alias("member"), F.least("comp", "end.comp").alias("a"), F.greatest("comp", "end.comp").alias("b")).distinct()
    found = common.cut(_confirmed(edges, texts, size, percent).distinct())
    # Least component within two links: a star becomes one component at once; longer ways need not.
    both = found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    further = both.join(least.select(common.hidden(F.col("a")).alias("b"), "m"), "b").select("a", "m")
    label = further.unionByName(least).groupBy("a").agg(F.min("m").alias("to"))
    rest = opened.where("class <> lo.class and class <> hi.class").select("key", "class", "n", "comp")
    told = label.select(common.hidden(F.col("a")).alias("comp"), "to")
    return found, rest.join(told, "comp", "left").select("key", "class", "n", F.coalesce("to", "comp").alias("comp"))


#: Counters of the sketch that orders shingles by how many sets hold them.
SKETCH = 1 << 18
#: Parts that the sketch travels in, and sketches that one task adds.
CHUNKS, FAN = 8, 64


def _prefixes(crowd: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """class, n, comp and each shingle of the part of its set that any similar set must meet."""
    held = common.cut(texts.join(crowd, "class"))
    part = pa.schema([("chunk", pa.int32()), ("part", pa.int64()), ("counts", pa.binary())])
    wide = SKETCH // CHUNKS

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.release()
        counts, any_ = np.zeros(SKETCH, np.uint32), False
        for batch in batches:
            for _, sets in unpacked(batch.column("packed"), size):
                any_ = True
                counts += np.bincount((sets.one & U64(SKETCH - 1)).astype(np.int64), minlength=SKETCH).astype(np.uint32)
        if any_:
            own = [TaskContext.get().partitionId() // FAN] * CHUNKS
            yield common.batch_of(part, chunk=list(range(CHUNKS)), part=own, counts=[c.tobytes() for c in counts.reshape(CHUNKS, wide)])

    def add(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(c.as_py(), np.uint32) for c in group["counts"])
        return pa.Table.from_batches([common.batch_of(part, chunk=group["chunk"][:1].to_pylist(), part=[group["part"][0].as_py() // FAN], counts=[total.tobytes()])])

    # Sketches are added in groups of FAN until one is left: of fixed size, it reaches the driver and goes out again.
    told, left = common.small_batches(held).select("packed").mapInArrow(sketch, "chunk int, part long, counts binary"), held.rdd.getNumPartitions()
    while left > 0:
        told, left = told.groupBy("chunk", "part").applyInArrow(add, "chunk int, part long, counts binary"), (left - 1) // FAN
    whole = np.zeros((CHUNKS, wide), np.uint32)
    for r in told.collect():
        whole[r["chunk"]] += np.frombuffer(r["counts"], np.uint32)
    counts = held.sparkSession.sparkContext.broadcast(whole.ravel())
    schema = pa.schema([("class", pa.binary()), ("n", pa.int64()), ("comp", pa.binary()), ("keys", pa.list_(pa.int64()))])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.release()
        for batch in batches:
            for at, sets in unpacked(batch.column("packed"), size):
                keys = []
                for r in range(len(sets)):
                    s = sets[r][0]
                    most = len(s) - -(-percent * len(s) // 100) + 1
                    order = np.lexsort((s, counts.value[(s & U64(SKETCH - 1)).astype(np.int64)]))
                    keys.append(s[order[:most]].view(np.int64))
                own = batch.slice(at, len(sets))
                yield common.batch_of(schema, **{"class": own.column("class")}, n=own.column("n"), comp=own.column("comp"), keys=keys)

    return held.mapInArrow(first, "class binary, n long, comp binary, keys array<long>").select(F.explode("keys").alias("key"), "class", "n", "comp")


def _shared(rows: DataFrame) -> DataFrame:
    """The rows whose key more than one row has."""
    busy = rows.groupBy("key").agg(F.count("*").alias("times")).where("times > 1").select((F.col("key") + 0).alias("key"))
    return rows.join(busy, "key", "left_semi")


#: Shingles, and classes, of a block that one task compares with another's.
WITHIN, CLASSES = 400_000, 1024
#: Entries of posting lists counted at once.
COUNTED = 4 << 20


def meetings(row: np.ndarray, shingle: np.ndarray, rows: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each row with the number of shingles that it has in common with every row before it."""
    order = np.argsort(shingle, kind="stable")
    held = row[order]  # posting lists, one after the other, rows ascending
    starts = np.searchsorted(shingle[order], np.arange(int(shingle.max()) + 2)) if len(shingle) else np.zeros(1, np.int64)
    size = np.diff(starts)
    begins = np.searchsorted(row, np.arange(rows + 1))
    for i in range(rows):
        own = shingle[begins[i] : begins[i + 1]]
        own = own[size[own] > 1]
        met = np.zeros(rows, np.int64)
        ends = np.cumsum(size[own])
        at = 0
        while at < len(own):
            upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + COUNTED, "right")))
            n = size[own[at:upto]]
            place = np.arange(int(n.sum())) + np.repeat(starts[own[at:upto]] - np.concatenate([[0], np.cumsum(n[:-1])]), n)
            met += np.bincount(held[place], minlength=rows)
            at = upto
        yield i, met[:i]


#: Classes of a bucket whose pairs are told apart over all buckets; a larger bucket is searched in blocks.
PAIRED = 256


def _buckets(opened: DataFrame) -> DataFrame:
    """key, class, n, comp, and the classes and shingles of the key's bucket. Keys with the same classes are one."""
    told = opened.groupBy("key").agg(F.sum(F.xxhash64("class").cast("decimal(38,0)")).alias("sum"), F.count("*").alias("times"), F.sum("n").alias("held"), F.min("class").alias("least"), F.max("class").alias("most"))
    keys = told.groupBy("sum", "times", "held", "least", "most").agg(F.min("key").alias("key")).select("key", "times", "held")
    return common.cut(opened.select("key", "class", "n", "comp").join(keys, "key"))


def _pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (center, member, their components) that may be similar, of buckets' rows, with a class near which others meet."""
    other = rows.select("key", F.col("class").alias("member"), F.col("n").alias("size"), F.col("comp").alias("end"))
    close = 100 * F.least("n", "size") >= percent * F.greatest("n", "size")
    met = rows.join(other, "key").where((F.col("class") < F.col("member")) & (F.col("comp") != F.col("end")) & close)
    pairs = common.cut(met.select(F.col("class").alias("center"), "member", F.least("comp", "end").alias("a"), F.greatest("comp", "end").alias("b")).distinct())
    lead = pairs.groupBy("member").agg(F.min("center").alias("lead")).select(common.hidden(F.col("member")).alias("center"), "lead")
    return pairs.join(lead, "center", "left").withColumn("lead", F.coalesce("lead", "center"))


def _searched(opened: DataFrame, texts: DataFrame, size: int, percent: int, paired: int = PAIRED) -> DataFrame:
    """Links (a, b: components) of all classes that share a key. ``opened``: key, class, n, comp."""
    rows = _buckets(opened)
    few = _confirmed(_pairs(rows.where(F.col("times") <= paired), percent), texts, size, percent).distinct()
    return few.unionByName(_within(rows.where(F.col("times") > paired), texts, size, percent))


def _within(rows: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a, b: components) of classes that share a key, in blocks, of buckets' rows."""
    blocks = F.least(F.greatest(F.ceil(F.col("held") / WITHIN), F.ceil(F.col("times") / CLASSES)), "times").cast("int")
    rows = rows.select("key", "class", "comp", blocks.alias("blocks")).withColumn("own", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "class", "comp").join(texts.select("class", "packed"), "class")
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def search(group: pa.Table) -> pa.Table:
        comps, own = group["comp"].to_pylist(), group["own"].to_numpy()
        links: list[tuple[bytes, bytes]] = []
        if len(set(comps)) > 1:
            stretches = [s for chunk in group["packed"].chunks for _, s in unpacked(chunk, size)]
            n = np.concatenate([np.diff(s.begins) for s in stretches])
            one, two = (np.concatenate([getattr(s, k) for s in stretches]) for k in ("one", "two"))
            order = np.lexsort((two, one))
            new = np.zeros(len(one), bool)
            new[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
            name = np.empty(len(one), np.int64)
            name[order] = np.cumsum(new)
            across = group["lo"][0].as_py() != group["hi"][0].as_py()
            parent = {c: c for c in comps}

            def root(x: bytes) -> bytes:
                while parent[x] != x:
                    parent[x] = x = parent[parent[x]]
                return x

            for i, met in meetings(np.repeat(np.arange(len(n)), n), name, len(n)):
                near = 100 * met >= percent * (n[:i] + n[i] - met)
                if across:
                    near &= own[:i] != own[i]
                for j in np.flatnonzero(near):
                    if (x := root(comps[i])) != (y := root(comps[j])):
                        parent[x] = y
                        links.append((comps[i], comps[j]))
        return pa.Table.from_arrays([pa.array([a for a, _ in links], pa.binary()), pa.array([b for _, b in links], pa.binary())], schema=schema)

    return rows.groupBy("key", "lo", "hi").applyInArrow(search, "a binary, b binary").distinct()


def linked(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, collections: int = COLLECTIONS, hashes: int = HASHES) -> DataFrame:
    """``near_duplicates`` with each row's hash, class and component (a class of it, null without words)."""
    signed = common.cut(signatures(docs, size, collections, hashes))
    classes = signed.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("least"), F.min("rid").alias("rid"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys"))
    # A collection key that one class alone has can't make a shared table key.
    single = _shared(classes.select("class", "n", F.explode("keys").alias("key")))
    left = single.groupBy("class", "n").agg(F.sort_array(F.collect_set("key")).alias("keys")).where(F.size("keys") > 1)
    pair_keys = F.flatten(F.transform("keys", lambda x, i: F.transform(F.slice("keys", i + 2, F.size("keys")), lambda y: F.xxhash64(x, y))))
    tables = _shared(left.select(F.explode(pair_keys).alias("key"), "class", "n"))
    opened = _open(tables.withColumn("comp", F.col("class")))
    wanted = opened.select("class").distinct().join(classes.select("class", "rid"), "class")
    texts = common.cut(_packed(docs).join(wanted, "rid").dropDuplicates(["class"]).select("class", "packed"))
    found, rest = _settle(opened, texts, size, percent)
    crowd = _open(rest).select("class", "n", "comp").distinct()
    # A star round on the new buckets first: it joins what a large group of near copies has left apart.
    more, rest = _settle(_open(_shared(_prefixes(crowd, texts, size, percent))), texts, size, percent)
    links = found.unionByName(more).unionByName(_searched(_open(rest), texts, size, percent))
    joined = components(links)
    whole = classes.select("class", "least").join(joined.withColumnRenamed("node", "class"), "class")
    smallest = whole.groupBy("component").agg(F.min("least").alias("smallest"))
    named = classes.select("class", "least").join(joined.withColumnRenamed("node", "class"), "class", "left").join(smallest, "component", "left")
    by_class = named.select("class", F.coalesce("component", "class").alias("component"), F.coalesce("smallest", "least").alias("component_id"))
    out = signed.join(by_class, "class", "left").withColumn("component_id", F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select("rid", "class", "component", "doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def near_duplicates(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, collections: int = COLLECTIONS, hashes: int = HASHES) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable) and kept of every row."""
    return linked(docs, size, percent, collections, hashes).drop("rid", "class", "component")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """One document of each group, with all columns: that of the smallest id. Documents without words all stay."""
    rows = linked(docs, **options)
    # A group of null ids only has no smallest one: its least row hash stands for it.
    lead = rows.where("class is not null").groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "rid")).alias("one")).select("one.rid")
    empty = rows.where("class is null").select("rid")
    chosen = lead.withColumn("all", F.lit(False)).unionByName(empty.withColumn("all", F.lit(True))).distinct()
    names = [f"`{c}`" for c in docs.columns]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    plain = [n for n, f in zip(names, docs.schema, strict=True) if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    held = docs.select(F.struct(*names).alias("row"), F.xxhash64(*plain).alias("order"), common.row_key(F.col("doc_id").cast("long"), text).alias("rid"))
    kept = held.join(chosen, "rid").withColumn("own", F.when(F.col("all"), F.monotonically_increasing_id()))
    return kept.groupBy("rid", "own").agg(F.min_by("row", "order").alias("row")).select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(common.documents(spark, sf_dir))
