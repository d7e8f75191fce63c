"""Language-model scores: prediction by partial matching over a byte-context trie, beside a word base.

The trie holds, for every context of up to ``ORDER`` bytes of the training texts, the counts of the
symbols that follow (bytes of the lower-cased text, then an end); with update exclusion, a shorter
context counts a symbol once for each longer one in which it was new. A symbol is predicted in its
longest known context; one not seen there costs the escape (method D: distinct symbols over twice the
total), and the symbols of that context are excluded from the shorter one, down to a uniform choice
among what is left. Children of a context are children of its suffixes, so what is excluded on the way
depends on the context alone, and the probability of a symbol is a function of the ``ORDER`` bytes
before it and itself (a *gram*).

Nothing of the trie is broadcast but its two lowest orders, at most 65,536 counts. Documents are dealt
to blocks of about ``BLOCK`` bytes as they are read, whatever their ids. Each block asks for its distinct
grams and words, with their training counts in it. What is asked travels packed: sorted numbers, split
by the task that answers, compressed byte plane by byte plane. Grams are answered by the last three bytes
of their context, where all longer contexts that they need meet; order 2, which such groups share, is
summed once and sent to each. Groups are hashed to tasks that are asked for about ``PRICED`` grams: one
frequent pair of bytes is spread over ``SPREAD`` of them. A task sums the counts of all blocks, a few at a
time, and answers each block with one number a gram, in the order asked, so that nothing is joined back;
words are answered likewise, without their keys, which the block has again from its texts. What a task is
sent thus grows with the input, and a frequent gram or word is one number a block, however often it occurs.

Null and empty texts are their end alone.
Repeated rows are scored one by one; rows with a null id are in the training part. A very long text makes
its block as large as itself. Ties don't arise: the result is one number a row. Without training rows the
base is 0 and the model is uniform. Empty tables give no rows. Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .bytesops import LOWER, NON_SPACE, U64, flat, mix, slices, word_hashes, words

# Freed Arrow memory goes back to the system, not to a pool: blocks are large and workers live long.
pa.set_memory_pool(pa.system_memory_pool())

ORDER = 5
SYMBOLS = 257
#: Bytes of text of a block, on average, and of a stretch worked on at once.
BLOCK, SLICE = 20 << 20, 1 << 20
#: Texts of a block at most.
TEXTS = 1_000_000
#: Grams that one task prices, on average, and tasks that the grams of one pair of bytes are dealt to.
PRICED, SPREAD = 32_000, 16
START, END = 0xFF, 0xFE
#: Keys of the end token among the words.
END_WORD = (np.int64(0x5EED), np.int64(1))
#: What blocks ask for: grams and words; and the last four bytes of their training grams.
GRAM, WORD, FOUR = 0, 1, 2
#: Keys packed together at most, and keys of blocks that are summed at once.
PART, MERGED = 500_000, 1_000_000


def grams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The gram of each symbol of each row (its bytes and an end), and each row's first."""
    rows = len(off) - 1
    size = np.diff(off)
    wide = ORDER + 1
    padded = np.full(len(data) + rows * wide, START, np.uint8)
    at = np.arange(rows) * wide + off[:-1] + ORDER
    padded[np.arange(len(data)) + np.repeat(at - off[:-1], size)] = LOWER[data]
    padded[at + size] = END
    out = np.zeros(len(padded) - ORDER, np.int64)
    for j in range(wide):
        out <<= 8
        out |= padded[j : len(padded) - ORDER + j]
    # The places whose last byte is a symbol of a row, not the padding before the next.
    first = np.concatenate([[0], np.cumsum(size + 1)])
    place = np.arange(first[-1]) + np.repeat(np.arange(rows) * ORDER, size + 1)
    return out[place], first


def word_keys(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes of the lower-cased words of each row, and each row's first."""
    low = LOWER[data]
    start, end, first = words(low, off, NON_SPACE)
    one, two = word_hashes(low, start, end)
    return one.view(np.int64), (two | U64(1)).view(np.int64), first


def _merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and their summed counts."""
    if not sum(map(len, keys)):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    every, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(every)
    every, n = every[order], n[order]
    begin = np.flatnonzero(np.r_[True, every[1:] != every[:-1]])
    return every[begin], np.add.reduceat(n, begin)


def _merge_words(one: list[np.ndarray], two: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for keys of two parts."""
    if not sum(map(len, one)):
        return (np.zeros(0, np.int64),) * 3
    a, b, n = np.concatenate(one), np.concatenate(two), np.concatenate(counts)
    order = np.lexsort((b, a))
    a, b, n = a[order], b[order], n[order]
    begin = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    return a[begin], b[begin], np.add.reduceat(n, begin)


class _Asked:
    """Distinct words and grams of a block, with their counts in its training texts, as texts come in."""

    def __init__(self) -> None:
        self.size, self.texts, self.train = 0, 0, 0
        self.grams: tuple[list, list] = ([], [])
        self.words: tuple[list, list, list] = ([], [], [])

    def add(self, data: np.ndarray, off: np.ndarray, held_out: bool) -> None:
        self.size += len(data)
        self.texts += len(off) - 1
        self.train += 0 if held_out else len(off) - 1
        keys, n = np.unique(grams(data, off)[0], return_counts=True)
        self.grams[0].append(keys)
        self.grams[1].append(n * (not held_out))
        one, two, _ = word_keys(data, off)
        one, two, n = _merge_words([one], [two], [np.ones(len(one), np.int64)])
        for kept, new in zip(self.words, (one, two, n * (not held_out)), strict=True):
            kept.append(new)
        if len(self.grams[0]) >= 8:
            self.grams = tuple([x] for x in _merge(*self.grams))
            self.words = tuple([x] for x in _merge_words(*self.words))

    def rows(self) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """Kind, part, key, key2 and n, sorted by their keys, in parts."""
        keys, n = _merge(*self.grams)
        one, two, count = _merge_words(*([*x, np.array([end])] for x, end in zip(self.words, (*END_WORD, self.train), strict=True)))
        fours = np.unique(keys[n > 0] & 0xFFFFFFFF)
        none = np.zeros(0, np.int64)
        for kind, (first, second, counts) in ((GRAM, (keys, none, n)), (WORD, (one, two, count)), (FOUR, (fours, none, none))):
            for part, at in enumerate(range(0, len(first), PART)):
                yield kind, part, *(x[at : at + PART] for x in (first, second, counts))


def _squeeze(numbers: np.ndarray) -> bytes | None:
    """64-bit numbers, compressed byte plane by byte plane."""
    if not len(numbers):
        return None
    import zstandard

    planes = np.ascontiguousarray(np.ascontiguousarray(numbers).view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def _stretch(packed: bytes | None, kind: type = np.int64) -> np.ndarray:
    """What ``_squeeze`` has compressed."""
    if packed is None:
        return np.zeros(0, kind)
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, -1).T).view(kind).ravel()


def _steps(keys: np.ndarray) -> bytes | None:
    """Sorted keys, packed by their differences."""
    return _squeeze(np.diff(keys, prepend=np.int64(0)))


def _keys(packed: bytes | None) -> np.ndarray:
    return np.cumsum(_stretch(packed))


def _blocks(docs: DataFrame, block_bytes: int) -> DataFrame:
    """Rows of two sorts: block, doc_id, held_out and the compressed text; and block, kind, part, size and the packed keys and counts of what the block asks for."""
    size = common.id_text(docs).agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    schema = pa.schema([("block", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("packed", pa.binary()), ("kind", pa.int32()), ("part", pa.int64()), ("size", pa.int64()), ("key", pa.binary()), ("key2", pa.binary()), ("n", pa.binary())])

    def asked(block: int, of: _Asked) -> Iterator[pa.RecordBatch]:
        for kind, part, key, key2, n in of.rows():
            yield common.batch_of(schema, block=[block], doc_id=[None], held_out=[None], packed=[None], kind=[kind], part=[part], size=[len(key)], key=[_steps(key)], key2=[_squeeze(key2)], n=[_squeeze(n)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=1).compress
        block, now = TaskContext.get().partitionId() << 32, _Asked()
        for whole in batches:
            held = whole.column("held_out").to_numpy(zero_copy_only=False)
            for held_out in (False, True):
                batch = whole.filter(pa.array(held == held_out))
                data, off = flat(batch.column("text"))
                for a, b in slices(off, SLICE):
                    now.add(data[off[a] : off[b]], off[a : b + 1] - off[a], held_out)
                    packed = [squeeze(data[off[i] : off[i + 1]]) for i in range(a, b)]
                    none = {f.name: pa.nulls(b - a, f.type) for f in list(schema)[4:]}
                    yield common.batch_of(schema, block=np.full(b - a, block), doc_id=batch.column("doc_id").slice(a, b - a), held_out=batch.column("held_out").slice(a, b - a), packed=packed, **none)
                    if now.size >= block_bytes or now.texts >= TEXTS:
                        yield from asked(block, now)
                        block, now = block + 1, _Asked()
        if now.texts:
            yield from asked(block, now)

    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    # Neighbouring parts of the input are read by one task, so that blocks are not much smaller than asked for.
    source = common.id_text(docs).select("doc_id", held_out.alias("held_out"), "text").coalesce(max(1, -(-size // block_bytes)))
    return common.small_batches(source).mapInArrow(run, "block long, doc_id long, held_out boolean, packed binary, kind int, part long, size long, key binary, key2 binary, n binary")


def gram_bucket(keys: np.ndarray, groups: int) -> np.ndarray:
    """Bucket that answers a gram: of the pair of bytes before its symbol, and of the byte before them."""
    return pair_bucket(keys, groups) + (mix((keys >> 24 & 0xFF).astype(U64)) % U64(SPREAD)).astype(np.int64)


def pair_bucket(keys: np.ndarray, groups: int) -> np.ndarray:
    """First of the ``SPREAD`` buckets of the pair of bytes before the symbol."""
    return (mix((keys >> 8 & 0xFFFF).astype(U64)) % U64(groups)).astype(np.int64) * SPREAD


def word_bucket(keys: np.ndarray, groups: int) -> np.ndarray:
    """Bucket that answers a word: stretches of its first key, so that buckets are in the order of keys."""
    return ((((keys.view(U64) ^ U64(1 << 63)) >> U64(32)) * U64(groups * SPREAD)) >> U64(32)).astype(np.int64)


_DEALT = pa.schema([("bucket", pa.int64()), ("two", pa.bool_()), ("block", pa.int64()), ("part", pa.int64()), ("key", pa.binary()), ("key2", pa.binary()), ("n", pa.binary())])
_DEALT_SQL = "bucket long, two boolean, block long, part long, key binary, key2 binary, n binary"


def _split(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket with the places of its entries, in order."""
    order = np.argsort(bucket, kind="stable")
    begin = np.flatnonzero(np.r_[True, np.diff(bucket[order]) != 0])
    for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(order)], strict=True):
        yield int(bucket[order[a]]), order[a:b]


def _dealt(asked: DataFrame, kind: int, groups: int) -> DataFrame:
    """What the blocks ask for of one kind, a row for each block, part and bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                key, key2, n = _keys(row["key"]), _stretch(row["key2"]), _stretch(row["n"])
                parts = list(_split(gram_bucket(key, groups) if kind == GRAM else word_bucket(key, groups)))
                columns = {"bucket": [b for b, _ in parts], "key": [_steps(key[at]) for _, at in parts], "key2": [_squeeze(key2[at]) if kind == WORD else None for _, at in parts], "n": [_squeeze(n[at]) for _, at in parts]}
                yield common.batch_of(_DEALT, two=[False] * len(parts), block=[row["block"]] * len(parts), part=[row["part"]] * len(parts), **columns)

    wanted = asked.where(F.col("kind") == kind).select("block", "part", "key", "key2", "n")
    return common.small_batches(wanted).mapInArrow(run, _DEALT_SQL)


def _opened(packed: pa.ChunkedArray | pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Stretches of rows, decompressed: first and last row, bytes, offsets."""
    import zstandard

    open_up = zstandard.ZstdDecompressor().decompress
    first, held, size = 0, [], 0
    for i, value in enumerate(packed):
        text = open_up(value.as_py())
        if held and size + len(text) > SLICE:
            yield first, i, np.frombuffer(b"".join(held), np.uint8), np.cumsum([0, *map(len, held)])
            first, held, size = i, [], 0
        held.append(text)
        size += len(text)
    if held:
        yield first, first + len(held), np.frombuffer(b"".join(held), np.uint8), np.cumsum([0, *map(len, held)])


class _Level:
    """Counts of the symbols after contexts of one order: keys are context bytes and symbol."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys, self.counts = keys, counts
        context = keys >> 8
        begin = np.flatnonzero(np.r_[True, context[1:] != context[:-1]]) if len(keys) else np.zeros(0, np.int64)
        self.contexts = context[begin]
        self.total = np.add.reduceat(counts, begin) if len(keys) else np.zeros(0, np.int64)
        self.distinct = np.diff(np.r_[begin, len(keys)])
        self.begin = begin

    def count(self, keys: np.ndarray) -> np.ndarray:
        return _look(self.keys, self.counts, keys)

    def excluded(self, longer: _Level | None, mask: int) -> np.ndarray:
        """For each context of the longer level, this level's count of the symbols seen there."""
        if longer is None or not len(longer.keys):
            return np.zeros(0, np.int64)
        return np.add.reduceat(self.count(longer.keys & mask), longer.begin)


def _look(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(wanted), values.dtype)
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return np.where(keys[at] == wanted, values[at], 0)


def _types(longer: np.ndarray, order: int) -> _Level:
    """Update exclusion: a symbol counts in a context once for each longer context in which it was new."""
    short = longer & ((1 << 8 * (order + 1)) - 1)
    return _Level(*_merge([short], [np.ones(len(short), np.int64)]))


def log_probability(wanted: np.ndarray, keys: np.ndarray, counts: np.ndarray, low: list[_Level]) -> np.ndarray:
    """log10 of each wanted gram's probability. ``keys``, ``counts``: the training grams that share the
    last three context bytes with any wanted one, sorted; ``low``: levels of orders 0, 1 and 2, of order 2
    at least those contexts that the wanted grams have."""
    levels = [_Level(keys, counts)]
    for order in range(ORDER - 1, 2, -1):
        levels.append(_types(levels[-1].keys, order))
    levels = [*low, *reversed(levels)]
    out = np.zeros(len(wanted))
    open_ = np.ones(len(wanted), bool)
    longer: _Level | None = None
    longer_context = np.zeros(len(wanted), np.int64)
    for order in range(ORDER, -1, -1):
        level, mask = levels[order], (1 << 8 * (order + 1)) - 1
        key = wanted & mask
        context = key >> 8
        total, distinct = _look(level.contexts, level.total, context), _look(level.contexts, level.distinct, context)
        if longer is not None:
            total -= _look(longer.contexts, level.excluded(longer, mask), longer_context)
            distinct -= _look(longer.contexts, longer.distinct, longer_context)
        seen = level.count(key)
        here = open_ & (seen > 0)
        out[here] += np.log10((2 * seen[here] - 1) / (2 * total[here]))
        open_ &= seen == 0
        escape = open_ & (distinct > 0)
        out[escape] += np.log10(distinct[escape] / (2 * total[escape]))
        longer, longer_context = level, context
    used = int(levels[0].distinct.sum())
    out[open_] -= np.log10(max(1, SYMBOLS - used))
    return out


class _Index:
    """Values by key, for keys that are all there: buckets of a multiplicative hash, searched in steps."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, second: np.ndarray | None = None) -> None:
        self.bits = max(8, int(len(keys)).bit_length())
        place = self._hash(keys)
        order = np.argsort(place)
        self.keys, self.values, self.second = keys[order], values[order], None if second is None else second[order]
        self.begin = np.zeros(1 << self.bits, np.int32)
        np.cumsum(np.bincount(place, minlength=1 << self.bits)[:-1], out=self.begin[1:])

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(U64) * U64(0x9E3779B97F4A7C15)) >> U64(64 - self.bits)).astype(np.int32)

    def get(self, wanted: np.ndarray, second: np.ndarray | None = None) -> np.ndarray:
        at = self.begin[self._hash(wanted)]
        wrong = self._wrong(at, np.arange(len(wanted)), wanted, second)
        while len(wrong):
            at[wrong] += 1
            wrong = self._wrong(at, wrong, wanted, second)
        return self.values[at]

    def _wrong(self, at: np.ndarray, which: np.ndarray, wanted: np.ndarray, second: np.ndarray | None) -> np.ndarray:
        own = at[which]
        wrong = self.keys[own] != wanted[which]
        if second is not None:
            wrong |= self.second[own] != second[which]
        return which[wrong]


_ANSWER = pa.schema([("block", pa.int64()), ("place", pa.int64()), ("key", pa.binary()), ("value", pa.binary())])


def _summed(packed: list[tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of all blocks, and their counts; merged as they are unpacked."""
    keys: list[np.ndarray] = []
    counts: list[np.ndarray] = []
    fresh = 0
    for k, n in packed:
        keys.append(_keys(k))
        counts.append(_stretch(n))
        fresh += len(keys[-1])
        if fresh >= MERGED:
            (keys, counts), fresh = ([x] for x in _merge(keys, counts)), 0
    return _merge(keys, counts)


def _counted(group: pa.Table) -> pa.Table:
    """Training counts of the words of a bucket for each block that asks; and their sum and number, once."""
    packed = list(zip(*(group[c].to_pylist() for c in ("key", "key2", "n")), strict=True))
    total: tuple[list, list, list] = ([], [], [])
    fresh = 0
    for key, key2, n in packed:
        for held, new in zip(total, (_keys(key), _stretch(key2), _stretch(n)), strict=True):
            held.append(new)
        fresh += len(total[0][-1])
        if fresh >= MERGED:
            total, fresh = tuple([x] for x in _merge_words(*total)), 0
    one, two, n = _merge_words(*total)
    index = _Index(one, n, two)
    values = [_squeeze(index.get(_keys(key), _stretch(key2))) for key, key2, _ in packed]
    place = group["part"].to_numpy() << 40 | group["bucket"].to_numpy()
    schema = pa.schema([*_ANSWER, ("n", pa.int64()), ("distinct", pa.int64())])
    rest = [0] * (len(packed) - 1)
    return pa.Table.from_batches([common.batch_of(schema, block=group["block"].combine_chunks(), place=place, key=[None] * len(packed), value=values, n=[int(n.sum()), *rest], distinct=[int((n > 0).sum()), *rest])])


def score(docs: DataFrame, block_bytes: int = BLOCK, priced: int = PRICED) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    both = common.stored(_blocks(docs, block_bytes))
    asked, texts = both.where("kind is not null"), both.where("kind is null").select(F.col("block").alias("of"), "doc_id", "held_out", "packed")
    rows = asked.where(F.col("kind") != FOUR).agg(F.sum("size")).first()[0] or 0
    groups = max(1, -(-rows // (priced * SPREAD)))
    words_ = common.stored(_dealt(asked, WORD, groups).groupBy("bucket").applyInArrow(_counted, "block long, place long, key binary, value binary, n long, distinct long"))
    told = words_.agg(F.sum("n"), F.sum("distinct")).first()
    n_train, n_distinct = int(told[0] or 0), int(told[1] or 0)
    # Distinct grams of order 3 give the counts of order 2, those the counts of order 1, at most 65,536, and those the counts of order 0.

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed in batch.column("key"):
                yield pa.record_batch([pa.array(_keys(packed.as_py()))], ["key"])

    fours = common.small_batches(asked.where(F.col("kind") == FOUR).select("key")).mapInArrow(unpacked, "key long").distinct()
    threes = common.cut(fours.groupBy(F.col("key").bitwiseAND(0xFFFFFF).alias("key")).agg(F.count("*").alias("n")))
    pairs = threes.groupBy(F.col("key").bitwiseAND(0xFFFF).alias("pair")).agg(F.count("*").alias("n")).collect()
    pair_keys = np.array(sorted((r[0], r[1]) for r in pairs), np.int64).reshape(-1, 2)
    low = [_types(pair_keys[:, 0], 0), _Level(pair_keys[:, 0], pair_keys[:, 1])]

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, n = (batch.column(c).to_numpy() for c in ("key", "n"))
            order = np.argsort(key)
            key, n = key[order], n[order]
            parts = [(bucket, _steps(key[at]), _squeeze(n[at])) for bucket, at in _split(pair_bucket(key, groups))] if len(key) else []
            every = [(bucket + i, k, c) for bucket, k, c in parts for i in range(SPREAD)]
            none = [None] * len(every)
            yield common.batch_of(_DEALT, bucket=[x[0] for x in every], two=[True] * len(every), block=none, part=none, key=[x[1] for x in every], key2=none, n=[x[2] for x in every])

    def price(group: pa.Table) -> pa.Table:
        two, packed, n = (group[c].to_pylist() for c in ("two", "key", "n"))
        own, own_n = _summed([(k, c) for t, k, c in zip(two, packed, n, strict=True) if not t])
        order2 = _merge(*zip(*((_keys(k), _stretch(c)) for t, k, c in zip(two, packed, n, strict=True) if t), strict=True)) if any(two) else (np.zeros(0, np.int64),) * 2
        value = log_probability(own, own[own_n > 0], own_n[own_n > 0], [*low, _Level(*order2)]) if len(own) else np.zeros(0)
        answered = group.filter(pa.compute.invert(group["two"]))
        values = [_squeeze(value[np.searchsorted(own, _keys(k))]) for k in answered["key"].to_pylist()]
        return pa.Table.from_batches([common.batch_of(_ANSWER, block=answered["block"].combine_chunks(), place=np.full(len(values), -1), key=answered["key"].to_pylist(), value=values)])

    grams_ = _dealt(asked, GRAM, groups).unionByName(threes.select("key", "n").mapInArrow(shared, _DEALT_SQL))
    back = grams_.groupBy("bucket").applyInArrow(price, "block long, place long, key binary, value binary").unionByName(words_.select("block", "place", "key", "value"))
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def scored(own: pa.Table, found: pa.Table) -> pa.Table:
        place = found["place"].to_numpy()
        packed, values = (found[c].to_pylist() for c in ("key", "value"))
        of_grams, of_words = np.flatnonzero(place < 0), np.flatnonzero(place >= 0)
        gram = _Index(np.concatenate([_keys(packed[i]) for i in of_grams]), np.concatenate([_stretch(values[i], np.float64) for i in of_grams]))
        # Words are answered in the order of their keys, which were taken from these texts.
        counts = np.concatenate([_stretch(values[i]) for i in of_words[np.argsort(place[of_words])]]).astype(float)
        del packed, values, found
        asked_words: tuple[list, list, list] = tuple([np.array([x])] for x in (*END_WORD, 0))
        for _, _, data, off in _opened(own["packed"]):
            one, two, _ = word_keys(data, off)
            for held, new in zip(asked_words, _merge_words([one], [two], [np.zeros(len(one), np.int64)]), strict=True):
                held.append(new)
            if len(asked_words[0]) >= 8:
                asked_words = tuple([x] for x in _merge_words(*asked_words))
        key, key2, _ = _merge_words(*asked_words)
        word = _Index(key, counts, key2)
        del key, key2, counts, asked_words
        of_word = lambda c: np.log10((c + 1) / (n_train + n_distinct + 1))
        end = float(word.get(*(np.array([x]) for x in END_WORD))[0])
        parts: list[list[np.ndarray]] = [[], [], [], []]
        for _, _, data, off in _opened(own["packed"]):
            g, g_first = grams(data, off)
            parts[3].append(np.add.reduceat(gram.get(g), g_first[:-1]))
            one, two, first = word_keys(data, off)
            c = word.get(one, two)
            known = np.concatenate([[0.0], np.cumsum(c > 0)])
            parts[0].append(np.diff(first) + 1)
            parts[1].append(known[first[1:]] - known[first[:-1]] + (end > 0))
            parts[2].append(np.array([x.sum() for x in np.split(of_word(c), first[1:-1])]) + of_word(end))
        tokens, n_known, base, model = (np.concatenate(p) if p else np.zeros(0) for p in parts)
        return pa.Table.from_arrays([own["doc_id"].combine_chunks(), own["held_out"].combine_chunks(), pa.array(tokens.astype(np.int64)), pa.array(n_known.astype(np.int64)), pa.array(np.full(len(tokens), n_train, np.int64)), pa.array(base), pa.array(model)], schema=schema)

    return texts.groupBy("of").cogroup(back.groupBy("block")).applyInArrow(scored, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def query(spark, sf_dir: str) -> DataFrame:
    return score(common.documents(spark, sf_dir))
