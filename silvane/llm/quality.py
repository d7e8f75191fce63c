"""Quality classifier: a byte-level convolutional network in numpy.

Filters of ``WIDTH`` bytes are learned as one table a byte place (a convolution over one-hot bytes).
A text is covered whole by overlapping chunks of two blocks; each filter's rectified response is
max-pooled over a chunk, the chunks' vectors are pooled by mean and by maximum over the document, and
a hidden layer combines them into one probability. Training backpropagates through the pools to the
places that won them (Adam, fixed seed).

The network is fitted on a bounded sample of labelled documents: the first ``PER_CLASS`` of each class
in the order of a hash, of those the texts of at most ``LONGEST`` bytes, and of these, in that order, as
many as are at most ``BYTES`` together (summed before any text reaches the driver; a repeated id counts
once, with its least text of the least size). Those are documented parameters; nothing else is sampled: every document is scored over its whole text. A document's id decides only whether it may be
learned from; label, language, source and id are no inputs of the score.

Null and empty texts are scored as a single zero byte. Repeated rows get equal scores. Without labels
of both classes every score is the share of label 1 (0.5 without any). Other columns play no part.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .bytesops import flat, slices

#: Labelled documents of each class that the network is fitted on, and bytes of their texts.
PER_CLASS, BYTES = 1200, 24 << 20
#: Bytes of a text that the network may be fitted on; longer ones are scored, but not learned from.
LONGEST = BYTES // 64
FILTERS, WIDTH, HIDDEN = 16, 6, 16
#: Bytes of a block; a chunk is two blocks, the next begins a block later.
BLOCK = 128
THRESHOLD = 0.7
EPOCHS, BATCH, RATE = 6, 16, 0.01
SLICE = 256 << 10


@dataclass
class Network:
    tables: np.ndarray  # WIDTH x 256 x FILTERS
    bias: np.ndarray
    inner: np.ndarray  # HIDDEN x 2 FILTERS
    inner_bias: np.ndarray
    outer: np.ndarray
    outer_bias: np.ndarray
    #: Log odds that correct for the classes' shares in the sample.
    shift: float = 0.0
    #: Score of everything, where there was nothing to learn.
    constant: float | None = None

    @staticmethod
    def fresh(seed: int = 3) -> Network:
        rng = np.random.Generator(np.random.PCG64(seed))
        draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        return Network(draw(WIDTH, 256, FILTERS, scale=0.3), np.zeros(FILTERS, np.float32), draw(HIDDEN, 2 * FILTERS, scale=0.25), np.zeros(HIDDEN, np.float32), draw(HIDDEN, scale=0.3), np.zeros(1, np.float32))

    def parameters(self) -> list[np.ndarray]:
        return [self.tables, self.bias, self.inner, self.inner_bias, self.outer, self.outer_bias]

    # -- one document, with what backpropagation needs --

    def _document(self, text: bytes) -> tuple:
        b = np.frombuffer(text or b"\0", np.uint8)
        n = len(b)
        padded = np.concatenate([b, np.zeros(WIDTH - 1, np.uint8)])
        response = self.tables[0][padded[:n]]
        for j in range(1, WIDTH):
            response += self.tables[j][padded[j : n + j]]
        blocks = -(-n // BLOCK)
        full = np.full((blocks * BLOCK, FILTERS), -np.inf, np.float32)
        full[:n] = response
        cube = full.reshape(blocks, BLOCK, FILTERS)
        where = cube.argmax(1)
        best = np.take_along_axis(cube, where[:, None], 1)[:, 0]
        where += np.arange(blocks)[:, None] * BLOCK
        if blocks > 1:
            later = best[1:] > best[:-1]
            where, best = np.where(later, where[1:], where[:-1]), np.maximum(best[1:], best[:-1])
        chunk = np.maximum(best + self.bias, 0)
        top = chunk.argmax(0)
        pooled = np.concatenate([chunk.mean(0), chunk.max(0)])
        hidden = np.maximum(self.inner @ pooled + self.inner_bias, 0)
        return padded, where, chunk, top, pooled, hidden, float(self.outer @ hidden + self.outer_bias[0])

    def _back(self, kept: tuple, error: float, grads: list[np.ndarray]) -> None:
        padded, where, chunk, top, pooled, hidden, _ = kept
        g_tables, g_bias, g_inner, g_inner_bias, g_outer, g_outer_bias = grads
        g_outer += error * hidden
        g_outer_bias += error
        d_hidden = error * self.outer * (hidden > 0)
        g_inner += np.outer(d_hidden, pooled)
        g_inner_bias += d_hidden
        d_pooled = self.inner.T @ d_hidden
        d_chunk = np.repeat(d_pooled[None, :FILTERS] / len(chunk), len(chunk), 0)
        d_chunk[top, np.arange(FILTERS)] += d_pooled[FILTERS:]
        d_chunk *= chunk > 0
        g_bias += d_chunk.sum(0)
        filters = np.broadcast_to(np.arange(FILTERS), where.shape)
        for j in range(WIDTH):
            np.add.at(g_tables[j], (padded[where + j], filters), d_chunk)

    def fit(self, texts: list[bytes], labels: list[int], seed: int = 5) -> Network:
        rng = np.random.Generator(np.random.PCG64(seed))
        params = self.parameters()
        first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for epoch in range(EPOCHS):
            order = rng.permutation(len(texts))
            for at in range(0, len(order), BATCH):
                grads = [np.zeros_like(p) for p in params]
                own = order[at : at + BATCH]
                for i in own:
                    kept = self._document(texts[i])
                    self._back(kept, (1 / (1 + np.exp(-kept[-1])) - labels[i]) / len(own), grads)
                step += 1
                rate = RATE * (0.1 + 0.9 * (1 - epoch / EPOCHS))
                for p, g, m, v in zip(params, grads, first, second, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return self

    # -- many documents --

    def pairs(self) -> list[np.ndarray]:
        """Tables of two byte places at once: half the reads."""
        return [(self.tables[j][:, None, :] + self.tables[j + 1][None, :, :]).reshape(65536, FILTERS) for j in range(0, WIDTH, 2)]

    def scores(self, data: np.ndarray, off: np.ndarray, pairs: list[np.ndarray]) -> np.ndarray:
        """Scores of the rows of a flat batch."""
        if self.constant is not None:
            return np.full(len(off) - 1, self.constant)
        out = [self._slice(data[off[a] : off[b]], off[a : b + 1] - off[a], pairs) for a, b in slices(off, SLICE)]
        return np.concatenate(out) if out else np.zeros(0)

    def _slice(self, data: np.ndarray, off: np.ndarray, pairs: list[np.ndarray]) -> np.ndarray:
        size = np.diff(off)
        length = np.maximum(size, 1)
        begin = np.concatenate([[0], np.cumsum(length)])
        padded = np.zeros(begin[-1] + (WIDTH - 1) * len(size), np.uint16)
        place = begin[:-1] + (WIDTH - 1) * np.arange(len(size))
        padded[np.arange(len(data)) + np.repeat(place - off[:-1], size)] = data
        at = np.arange(begin[-1]) + np.repeat((WIDTH - 1) * np.arange(len(size)), length)
        two = padded[:-1] * np.uint16(256) + padded[1:]
        blocks = -(-length // BLOCK)
        first = np.concatenate([[0], np.cumsum(blocks)])
        starts = np.repeat(begin[:-1] - BLOCK * first[:-1], blocks) + BLOCK * np.arange(first[-1])
        best = np.empty((first[-1], FILTERS), np.float32)
        # A very long row is taken in stretches of whole blocks, so that memory stays small.
        for a in range(0, len(starts), stretch := 4096):
            b = min(a + stretch, len(starts))
            end = starts[b] if b < len(starts) else begin[-1]
            own = at[starts[a] : end]
            response = pairs[0][two[own]]
            for j in range(1, WIDTH // 2):
                response += pairs[j][two[own + 2 * j]]
            best[a:b] = np.maximum.reduceat(response, starts[a:b] - starts[a], axis=0)
        best = np.maximum(best + self.bias, 0)
        chunks = np.maximum(blocks - 1, 1)
        c_first = np.concatenate([[0], np.cumsum(chunks)])
        left = np.arange(c_first[-1]) + np.repeat(first[:-1] - c_first[:-1], chunks)
        right = left + np.repeat(blocks > 1, chunks)
        chunk = np.maximum(best[left], best[right])
        mean = np.add.reduceat(chunk, c_first[:-1], axis=0) / chunks[:, None]
        pooled = np.concatenate([mean, np.maximum.reduceat(chunk, c_first[:-1], axis=0)], 1)
        hidden = np.maximum((pooled[:, None, :] * self.inner[None]).sum(2) + self.inner_bias, 0)
        logit = (hidden * self.outer).sum(1) + self.outer_bias[0] + self.shift
        return 1 / (1 + np.exp(-logit.astype(np.float64)))


def remainder(doc_id: str, of: int) -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % of


def learn(docs: DataFrame, labels: DataFrame, label_col: str = "quality", per_class: int = PER_CLASS, most_bytes: int = BYTES, longest: int = LONGEST) -> Network:
    """A network fitted on the sample; rows of remainder 2 modulo 4 are never learned from."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where(F.col("label").isin(0, 1) & (remainder("doc_id", 4) != 2))
    shares = dict(usable.groupBy("label").count().collect())
    if len(shares) < 2:
        network = Network.fresh()
        network.constant = float(next(iter(shares), 0.5))
        return network
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    parts = [usable.where(F.col("label") == k).orderBy(*order).limit(per_class) for k in (0, 1)]
    sample = parts[0].unionByName(parts[1])
    # 2 * per_class rows of two numbers: a fixed bound, so that the texts stay where they are.
    held = common.id_text(docs).withColumn("size", F.octet_length("text").cast("long"))
    sizes = held.where(F.col("size") <= longest).select("doc_id", "size").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "label").agg(F.min("size").alias("size"))
    chosen, total = [], 0
    for doc_id, label, size, _ in sorted(sizes.withColumn("order", F.xxhash64("doc_id")).collect(), key=lambda r: (r[3], r[0], r[1])):
        if total + size <= most_bytes:
            chosen.append((doc_id, label, size))
            total += size
    wanted = docs.sparkSession.createDataFrame(chosen, "doc_id long, label int, size long")
    found = held.join(F.broadcast(wanted), ["doc_id", "size"]).groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    learned = sorted((r["doc_id"], r["text"], r["label"]) for r in found.collect())
    texts, known = [text.encode() for _, text, _ in learned], [label for _, _, label in learned]
    network = Network.fresh()
    if len(set(known)) < 2:
        network.constant = shares[1] / (shares[0] + shares[1])
        return network
    network.fit(texts, known)
    odds = lambda a, b: float(np.log(a / b))
    network.shift = odds(shares[1], shares[0]) - odds(sum(known), len(known) - sum(known))
    return network


def score(docs: DataFrame, network: Network, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every row. No shuffle."""
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        return common.batch_of(schema, doc_id=batch.column("doc_id"), score=network.scores(*flat(batch.column("text")), _pairs(network)))

    scored = common.map_batches(common.id_text(docs), each, "doc_id long, score double", "quality")
    return scored.select("doc_id", F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def _pairs(network: Network) -> list[np.ndarray]:
    return common.kept("quality", network.tables.tobytes(), network.pairs)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score reaches the threshold, with all their columns."""
    network = learn(docs, labels)
    text_at, names = docs.columns.index("text"), docs.columns

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        good = network.scores(*flat(batch.column(text_at)), _pairs(network)) >= threshold
        return batch.filter(pa.array(good))

    return common.map_batches(docs.select(names), each, docs.schema, "quality")


def query(spark, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    return score(docs, learn(docs, common.table(spark, sf_dir, "labels")))
