"""Sequence packing as a cutting-stock problem, solved by column generation.

Documents become token ids and one end id. Whole sequences are cut off the front of long documents;
what is left of each (its *tail*) is an item of one of a few length classes. The class histogram is
the demand of a cutting-stock linear program whose columns are patterns (how many items of each class
share a sequence). Patterns are generated: the restricted program's duals price the classes, a knapsack
dynamic program finds the best new pattern, until none pays. The optimum is rounded down, and the few
items that rounding leaves are placed first-fit decreasing. Documents are then ranked within their
class and the ranks dealt to the slots of the patterns.

What reaches the driver is the histogram (``capacity / step`` classes at most), never rows. Ranks come
from per-task counts and their running sums, so a hot class is not gathered in a task; only the items
of one sequence meet. Null and empty texts are one end id. Repeated rows are items of their own (a row
number made at tokenisation tells them apart). Empty tables give no rows. Other columns play no part.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .bytesops import LOWER, U64, byte_class, flat, slices, word_hashes, words

CAPACITY = 2048
END_ID = 1
#: Width of a length class; the tail of a document counts as the next multiple.
STEP = 8
#: Units, and ids of units, that a worker keeps; beyond either the table starts afresh (a matter of speed only).
UNITS, IDS = 2_000_000, 8_000_000
#: Units that the library encodes in one text.
JOINED = 128
#: Bytes of text tokenised at once; a longer text is taken alone.
TOKENISE = 1 << 20
PIECES = "task long, row long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, class long, nth long"
_SEPARATOR = "<|endoftext|>"


class Units:
    """Ids of units of text by two hashes: an open-addressing table of numpy arrays, searched for many units at once."""

    def __init__(self) -> None:
        self.size = self.used = 0
        self.keys = np.zeros((2, 1 << 12), U64)
        self.slots = np.full(1 << 13, -1, np.int32)
        self.begin, self.count = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.ids = np.zeros(1 << 14, "<u4")

    def find(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Number of each unit, -1 if it is not there."""
        mask = len(self.slots) - 1
        slot = (one & U64(mask)).astype(np.int64)
        out = self.slots[slot]
        todo = np.flatnonzero(out >= 0)
        while len(todo := todo[(self.keys[0][out[todo]] != one[todo]) | (self.keys[1][out[todo]] != two[todo])]):
            slot[todo] = (slot[todo] + 1) & mask
            out[todo] = self.slots[slot[todo]]
            todo = todo[out[todo] >= 0]
        return out

    def add(self, one: np.ndarray, two: np.ndarray, ids: list[np.ndarray]) -> None:
        """Units that are not there yet, each once."""
        first, flat_ids = self.size, np.concatenate(ids)
        self.size += len(one)
        while self.size > self.keys.shape[1]:
            self.keys = np.concatenate([self.keys, np.zeros_like(self.keys)], 1)
            self.begin, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.count))
        while self.used + len(flat_ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        own = slice(first, self.size)
        self.keys[0, own], self.keys[1, own] = one, two
        self.count[own] = list(map(len, ids))
        self.begin[own] = self.used + np.concatenate([[0], np.cumsum(self.count[own])[:-1]])
        self.ids[self.used : self.used + len(flat_ids)] = flat_ids
        self.used += len(flat_ids)
        new = np.arange(first, self.size)
        if 2 * self.size > len(self.slots):
            # A power of two that one addition of any size leaves at most half full.
            self.slots, new = np.full(1 << (4 * self.size - 1).bit_length(), -1, np.int32), np.arange(self.size)
        mask = len(self.slots) - 1
        slot = (self.keys[0, new] & U64(mask)).astype(np.int64)
        while len(new):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = new[free]
            lost = self.slots[slot] != new  # of several for one slot the last has it
            new, slot = new[lost], (slot[lost] + 1) & mask


class Encoder:
    """Ids of texts by a tokenizer none of whose tokens crosses a space; each distinct unit is encoded once.

    A segment (between spaces) that is a run of letters and then of simple signs is two units, which the
    tokenizer never joins; any other segment is one.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.separator = self.library.token_to_id(_SEPARATOR)
        self.units = Units()
        names = sorted((i, x) for x, i in self.library.get_vocab().items())
        self.ends = np.array([x.endswith("</w>") for _, x in names])
        self.separates = np.array([i == self.separator for i, _ in names])

    def _split(self, joined: list[str], ends: np.ndarray, drop: int) -> list[np.ndarray]:
        """Ids of encoded texts, cut after each id that ``ends`` marks."""
        ids = np.array([i for e in self.library.encode_batch_fast(joined, add_special_tokens=False) for i in e.ids], "<u4")
        at = np.flatnonzero(ends[ids]) + 1
        return [x[: len(x) - drop] for x in np.split(ids, at)[:-1]]

    def _learn(self, low: np.ndarray, start: np.ndarray, end: np.ndarray, plain: np.ndarray, one: np.ndarray, two: np.ndarray) -> None:
        """Encode new units: plain ones together, told apart by their end marks, others between separators or alone."""
        raw = low.tobytes()
        texts = [raw[a:b].decode() for a, b in zip(start.tolist(), end.tolist(), strict=True)]
        alone = np.array([not p and "<|" in t for p, t in zip(plain.tolist(), texts, strict=True)], bool)
        for kind in (plain, ~plain & ~alone, alone):
            which = np.flatnonzero(kind)
            if not len(which):
                continue
            own = [texts[i] for i in which.tolist()]
            if kind is alone:
                ids = [np.array(self.library.encode(t, add_special_tokens=False).ids, "<u4") for t in own]
            elif kind is plain:
                ids = self._split([" ".join(own[i : i + JOINED]) for i in range(0, len(own), JOINED)], self.ends, 0)
            else:
                ids = self._split([_SEPARATOR.join(own[i : i + JOINED]) + _SEPARATOR for i in range(0, len(own), JOINED)], self.separates, 1)
            self.units.add(one[which], two[which], ids)

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows of a flat batch, and each row's first."""
        if self.units.size > UNITS or self.units.used > IDS:
            self.units = Units()
        start, end, first = words(data, off, _BETWEEN_SPACES)
        letter, sign = _LETTER[data], _SIGN[data]
        pair = (data[:-1] == 0xC3) & _AFTER_C3[data[1:]]  # letters of two bytes
        letter[:-1] |= pair
        letter[1:] |= pair
        odd = ~(letter | sign)
        odd[1:] |= letter[1:] & sign[:-1]
        odd[start[letter[start]]] = False  # the sign before is of the row before
        sums = lambda mask: np.concatenate([[0], np.cumsum(mask, dtype=np.int32)])
        odds, letters = sums(odd), sums(letter)
        simple = (odds[end] == odds[start]) & letter[start]
        inside = np.zeros(len(data) + 1, np.int8)
        inside[start[simple]] = 1
        inside[end[simple]] -= 1
        low = np.where(np.cumsum(inside[:-1], dtype=np.int8) > 0, LOWER[data], data)
        middle = np.where(simple, start + letters[end] - letters[start], end)
        two_units = middle < end
        place = np.concatenate([[0], np.cumsum(1 + two_units)])
        u_start, u_end, plain = np.empty(place[-1], np.int64), np.empty(place[-1], np.int64), np.empty(place[-1], bool)
        u_start[place[:-1]], u_end[place[:-1]], plain[place[:-1]] = start, middle, simple
        second = place[:-1][two_units] + 1
        u_start[second], u_end[second], plain[second] = middle[two_units], end[two_units], True
        one, two = word_hashes(low, u_start, u_end)
        number = self.units.find(one, two)
        new = np.flatnonzero(number < 0)
        if len(new):
            order = new[np.lexsort((two[new], one[new]))]
            fresh = order[np.r_[True, (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])]]
            self._learn(low, u_start[fresh], u_end[fresh], plain[fresh], one[fresh], two[fresh])
            number[new] = self.units.find(one[new], two[new])
        n = self.units.count[number]
        ends = np.concatenate([[0], np.cumsum(n)])
        ids = self.units.ids[np.repeat(self.units.begin[number] - ends[:-1], n) + np.arange(ends[-1])]
        return ids, ends[place[first]]


_BETWEEN_SPACES = byte_class((0x20, 0x20), (0x0A, 0x0A), negate=True)
#: Letters without surprises of case or composition (those of two bytes begin with C3), and simple signs: the two never share a token.
_LETTER, _AFTER_C3 = byte_class((0x41, 0x5A), (0x61, 0x7A)), byte_class((0x9F, 0xB6), (0xB8, 0xBF))
_SIGN = byte_class(*((ord(c), ord(c)) for c in ".,;:!?%$&*#|"))


def encoder(path: str) -> Encoder:
    return common.kept("packing", path, lambda: Encoder(path))


def stretches(data: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """One text in parts of about ``most`` bytes, cut after spaces."""
    at = 0
    while len(data) - at > most:
        spaces = np.flatnonzero(data[at : at + most] == 0x20)
        end = at + most
        while not len(spaces) and end < len(data):
            spaces = np.flatnonzero(data[end : end + most] == 0x20) + (end - at)
            end += most
        if not len(spaces):
            break
        upto = at + int(spaces[-1]) + 1
        yield data[at:upto]
        at = upto
    yield data[at:]


# --- the linear program -------------------------------------------------------------------------


def best_pattern(prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack by dynamic programming: classes 1..len(prices) weigh their number."""
    n = len(prices)
    value = np.zeros(capacity + 1)
    take = np.zeros(capacity + 1, np.int64)
    for room in range(1, capacity + 1):
        most = min(room, n)
        gain = value[room - most : room][::-1] + prices[:most]
        k = int(np.argmax(gain))
        value[room], take[room] = (gain[k], k + 1) if gain[k] > value[room - 1] else (value[room - 1], 0)
    pattern, room = np.zeros(n, np.int64), capacity
    while room > 0:
        if take[room]:
            pattern[take[room] - 1] += 1
            room -= take[room]
        else:
            room -= 1
    return float(value[capacity]), pattern


def generate_columns(demand: np.ndarray, capacity: int, gap: float = 2e-4, rounds: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """Optimal basis of the cutting-stock program by the revised simplex method.

    Rows are the classes with demand. Returns the basic patterns (one a row, over all classes) and how
    often each is used, not rounded. Stops when no pattern has negative reduced cost, or when the value is
    proven to be within ``gap`` of the optimum, or half a sequence (value of prices / worth of the best pattern bounds it).
    """
    used = np.flatnonzero(demand)
    m = len(used)
    basis = np.zeros((m, m))
    for i, c in enumerate(used):
        basis[i, i] = capacity // (c + 1)
    inverse = np.diag(1 / np.diag(basis))
    # A little noise on the demand keeps the vertices apart, so that no step is degenerate.
    wanted = demand[used] + 1e-3 * np.random.Generator(np.random.PCG64(7)).random(m)
    x = inverse @ wanted
    # Prices are drawn towards those of the best lower bound so far, which tames their swings.
    center, bound, drawn = inverse.sum(0), 0.0, True
    for _ in range(rounds):
        duals = inverse.sum(0)
        asked = 0.7 * center + 0.3 * duals if drawn else duals
        prices = np.full(len(demand), -1.0)
        prices[used] = asked
        worth, pattern = best_pattern(prices, capacity)
        if (below := asked @ wanted / max(worth, 1e-12)) > bound:
            center, bound = asked / max(worth, 1e-12), below
        if x.sum() <= bound * (1 + gap) or x.sum() - bound < 0.5:
            break
        column = pattern[used].astype(float)
        if duals @ column <= 1 + 1e-9:
            if not drawn:
                break
            drawn = False
            continue
        drawn = True
        way = inverse @ column
        ahead = way > 1e-9
        ratio = np.where(ahead, x / np.where(ahead, way, 1), np.inf)
        leave = int(np.argmin(ratio))
        basis[:, leave] = column
        pivot = inverse[leave] / way[leave]
        inverse -= way[:, None] * pivot
        inverse[leave] = pivot
        x = np.maximum(inverse @ wanted, 0)
    patterns = np.zeros((m, len(demand)), np.int64)
    patterns[:, used] = np.rint(basis.T).astype(np.int64)
    return patterns, x


def solve(demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Patterns and whole multiplicities that serve the demand exactly.

    The optimum rounded down, then first-fit decreasing over what rounding leaves.
    """
    patterns, x = generate_columns(demand, capacity)
    times = np.floor(x + 1e-6).astype(np.int64)
    left = demand - times @ patterns if len(times) else demand.copy()
    # A pattern may serve more than there is left of a class by rounding noise: give those back.
    while (left < 0).any():
        c = int(np.flatnonzero(left < 0)[0])
        j = int(np.flatnonzero((patterns[:, c] > 0) & (times > 0))[0])
        times[j] -= 1
        left += patterns[j]
    rest: list[np.ndarray] = []
    room: list[int] = []
    for c in range(len(demand) - 1, -1, -1):
        for _ in range(int(left[c])):
            i = next((i for i, r in enumerate(room) if r >= c + 1), len(room))
            if i == len(room):
                room.append(capacity)
                rest.append(np.zeros(len(demand), np.int64))
            room[i] -= c + 1
            rest[i][c] += 1
    keep = times > 0
    return np.concatenate([patterns[keep], np.array(rest, np.int64).reshape(-1, len(demand))]), np.concatenate([times[keep], np.ones(len(rest), np.int64)])


def slots(patterns: np.ndarray, times: np.ndarray, whole: int) -> list[tuple[int, int, int, int, int, int]]:
    """(class, first rank, ranks, first sequence, sequences, slot) of each copy of a class in a pattern.

    Sequences 0..whole - 1 hold one full-length piece each and are not here.
    """
    out, taken, sequence = [], np.zeros(patterns.shape[1], np.int64), whole
    for pattern, n in zip(patterns, times, strict=True):
        slot = 0
        for c in np.flatnonzero(pattern)[::-1]:
            for _ in range(int(pattern[c])):
                out.append((int(c) + 1, int(taken[c]), int(n), sequence, int(n), slot))
                taken[c] += n
                slot += 1
        sequence += int(n)
    return out


# --- the operator -------------------------------------------------------------------------------


def pieces(docs: DataFrame, vocabulary: str, capacity: int, step: int, end_id: int) -> DataFrame:
    """One row a piece, with its class and its number among the pieces of that class in its task.

    Class 0 is a piece of full length; others are ceil(length / step).
    """
    schema = pa.schema([("task", pa.int64()), ("row", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("class", pa.int64()), ("nth", pa.int64())])
    classes = -(-capacity // step)
    source = common.small_batches(common.id_text(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        machine = encoder(public_tokenizers.path(vocabulary))
        task, seen, row = TaskContext.get().partitionId(), np.zeros(classes + 1, np.int64), 0
        for batch in batches:
            data, off = flat(batch.column("text"))
            for first, last in slices(off, TOKENISE):
                if last == first + 1 and off[last] - off[first] > TOKENISE:
                    own = np.concatenate([machine.encode(part, np.array([0, len(part)]))[0] for part in stretches(data[off[first] : off[last]], TOKENISE)])
                    begins = np.array([0, len(own)])
                else:
                    own, begins = machine.encode(data[off[first] : off[last]], off[first : last + 1] - off[first])
                # Every document's ids and its end id, one after the other.
                size = np.diff(begins) + 1
                ids = np.insert(own, begins[1:], end_id)
                begins = np.concatenate([[0], np.cumsum(size)])
                n = -(-size // capacity)
                doc = np.repeat(np.arange(len(size)), n)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * capacity
                length = np.minimum(capacity, size[doc] - start)
                kind = np.where(length == capacity, 0, -(-length // step))
                at = begins[doc] + start
                raw = memoryview(ids.astype("<u4")).cast("B")
                sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at.tolist(), (at + length).tolist(), strict=True)]
                # Numbers within the class: places in a stable order by class.
                order = np.argsort(kind, kind="stable")
                many = np.bincount(kind, minlength=classes + 1)
                nth = np.empty(len(kind), np.int64)
                nth[order] = np.arange(len(kind)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(seen, many)
                seen += many
                yield common.batch_of(schema, task=np.full(len(doc), task), row=row + doc, doc_id=batch.column("doc_id").take(pa.array(first + doc)), start=start, length=length, ids_crc32=sums, doc_tokens=size[doc], **{"class": kind}, nth=nth)
                row += len(size)

    return source.mapInArrow(run, PIECES)


def pack(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", capacity: int = CAPACITY, step: int = STEP, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and the sequence's tokens and padded length."""
    spark = docs.sparkSession
    cut = common.cut(pieces(docs, vocabulary, capacity, step, end_id))
    counts = cut.groupBy("class", "task").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("class").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select("class", "task", F.coalesce("before", F.lit(0)).alias("before"))
    classes = -(-capacity // step)
    demand = np.zeros(classes, np.int64)
    whole = 0
    for kind, n in counts.groupBy("class").agg(F.sum("n")).collect():  # at most classes + 1 rows
        if kind:
            demand[kind - 1] = n
        else:
            whole = n
    room = capacity // step
    patterns, times = solve(demand, room) if demand.any() else (np.zeros((0, classes), np.int64), np.zeros(0, np.int64))
    plan = slots(patterns, times, whole)
    plan_schema = "class long, from_rank long, ranks long, first_sequence long, n_sequences long, slot long"
    # Slots number at most the classes times the items of a sequence: a size that the input does not change.
    dealt = spark.createDataFrame([*plan, (0, 0, whole, 0, whole, 0)], plan_schema)
    ranked = cut.join(before, ["class", "task"]).withColumn("rank", F.col("nth") + F.col("before"))
    lists = dealt.groupBy("class").agg(F.array_sort(F.collect_list(F.struct("from_rank", "ranks", "first_sequence", "slot"))).alias("slots"))
    found = ranked.join(F.broadcast(lists), "class").withColumn("s", F.filter("slots", lambda s: (F.col("rank") >= s["from_rank"]) & (F.col("rank") < s["from_rank"] + s["ranks"]))[0])
    placed = found.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("s.first_sequence") + F.col("rank") - F.col("s.from_rank")).alias("sequence_id"), F.col("s.slot").alias("slot"))
    own = Window.partitionBy("sequence_id")
    out = placed.withColumn("offset", F.coalesce(F.sum("length").over(own.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("sequence_tokens", F.sum("length").over(own))
    power = F.col("sequence_tokens").bitwiseAND(F.col("sequence_tokens") - 1) == 0
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_tokens", F.when(power, F.col("sequence_tokens")).otherwise(F.lit(capacity).cast("long")).alias("padded_length"))


def query(spark, sf_dir: str) -> DataFrame:
    return pack(common.documents(spark, sf_dir))
