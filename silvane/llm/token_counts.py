"""Token counts by a compiled finite-state transducer over text segments.

The transducer reads *segments*: maximal pieces that no token of the vocabulary straddles. For the
sentence-piece vocabularies used here (white space becomes a mark that only ever starts a token) a
segment begins at a space that follows another character. A state is the fragment of the segment that is still open; reading a boundary is the transition that closes it
and emits its number of tokens. Transitions are compiled lazily: the count emitted for a segment is
asked of the library once and annotated on the transition, which later texts share.

A chunk of text therefore has a small state map, valid from any start state: what it prepends to the
open segment (``head``), what all segments that end within it emit (``count``), and the segment it
leaves open (``tail``). Maps compose associatively, so the maps of a long text's chunks are combined
by a parallel prefix scan (Hillis-Steele) and any chunking gives the same count.

Nulls and empty texts have 0 bytes and 0 tokens; rows are counted one by one, so repeated rows repeat;
other columns of the input play no part.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common
from .bytesops import flat, slices

LIMIT = 4096
#: Characters of a chunk whose state map is computed on its own.
CHUNK = 1 << 20
#: Compiled transitions a worker keeps; beyond it the table starts afresh (a matter of speed only).
TABLE = 700_000
#: Bytes of text whose transitions are compiled at once.
COMPILE = 8 << 20
#: Longer segments are counted but not kept.
KEEP = 64
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


@dataclass(frozen=True)
class StateMap:
    """What a chunk does from any state. ``closed`` is False if no boundary lies in it: then only head counts."""

    head: str
    count: int
    tail: str
    closed: bool


class SegmentTransducer:
    def __init__(self, path: str) -> None:
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        #: Compiled transitions: segment, without its first space -> tokens emitted when it closes.
        self.table: dict[str, int] = {}
        self.plain = self._marks_only_start_tokens()

    def _marks_only_start_tokens(self) -> bool:
        """Whether the vocabulary and the normaliser allow segments: checked on the pieces, once."""
        mark = "▁"
        inner = any(mark in self.library.id_to_piece(i).lstrip(mark) for i in range(self.library.get_piece_size()))
        return not inner and self.library.encode("a  b", out_type=str) != self.library.encode("a b", out_type=str)

    def compile(self, texts: list[str]) -> None:
        """Annotate the transitions that these texts need, in one call of the library."""
        new: set[str] = set()
        for text in texts:
            new.update(set(text.split(" ")).difference(self.table))
        new.discard("")
        if len(self.table) + len(new) > TABLE:
            self.table.clear()
            if len(new) > TABLE:
                return
            new = set().union(*(text.split(" ") for text in texts))
            new.discard("")
        fresh = [word for word in new if len(word) <= KEEP]
        if fresh:
            self.table.update(zip(fresh, map(len, self.library.encode(fresh, num_threads=1)), strict=True))

    def emits(self, segment: str) -> int:
        """Tokens of a closed segment: one or more spaces and what follows them up to the next space."""
        word = segment[1:]
        if not word:
            return 1
        known = self.table.get(word)
        return len(self.library.encode(word)) if known is None else known

    def chunk_map(self, chunk: str) -> StateMap:
        """Boundaries lie before a space that follows a non-space; spaces in a row stay together."""
        first = _boundary(chunk, 0)
        if first < 0:
            return StateMap(chunk, 0, chunk, False)
        last = _last_boundary(chunk)
        return StateMap(chunk[:first], self._run(chunk[first:last]), chunk[last:], True)

    def _run(self, text: str) -> int:
        """Counts of the whole segments of a text that begins and ends at boundaries."""
        if "  " in text:
            return sum(map(self.emits, re.findall(r" +[^ ]*", text)))
        words = text.split(" ")[1:]
        try:
            return sum(map(self.table.__getitem__, words))
        except KeyError:
            return sum(self.emits(" " + word) for word in words)

    def compose(self, a: StateMap, b: StateMap) -> StateMap:
        """First a, then b. A boundary can also lie exactly between them."""
        if a.tail and b.head[:1] == " " and a.tail[-1] != " " or (a.tail and not b.head and b.closed and b.tail[:1] == " "):
            b = StateMap("", b.count if b.closed else 0, b.tail, True) if not b.head else self._open(b)
        if not a.closed and not b.closed:
            return StateMap(a.head + b.head, 0, a.tail + b.tail, False)
        if not b.closed:
            return StateMap(a.head, a.count, a.tail + b.head, True)
        if not a.closed:
            return StateMap(a.head + b.head, b.count, b.tail, True)
        return StateMap(a.head, a.count + self.emits(a.tail + b.head) + b.count, b.tail, True)

    def _open(self, b: StateMap) -> StateMap:
        """b with a boundary before its first character."""
        if not b.closed:
            return StateMap("", 0, b.head, True)
        return StateMap("", self.emits(b.head) + b.count, b.tail, True)

    def scan(self, maps: list[StateMap]) -> list[StateMap]:
        """Inclusive prefix scan; the rounds' compositions are independent of each other."""
        step = 1
        while step < len(maps):
            maps = [m if i < step else self.compose(maps[i - step], m) for i, m in enumerate(maps)]
            step *= 2
        return maps

    def count(self, text: str, chunk: int = CHUNK) -> int:
        """Tokens of a whole text. The mark that begins a text is as a space before it."""
        if not text:
            return 0
        if not self.plain:
            return len(self.library.encode(text))
        return self._total(" " + text.replace("▁", " "), chunk)

    def _total(self, text: str, chunk: int) -> int:
        if len(text) <= chunk:
            whole = self.chunk_map(text)
        else:
            whole = self.scan([self.chunk_map(text[i : i + chunk]) for i in range(0, len(text), chunk)])[-1]
        if not whole.closed:
            return self._close(whole.head)
        return self._close(whole.head) + whole.count + self._close(whole.tail)

    def _close(self, segment: str) -> int:
        return self.emits(segment) if segment else 0


def _boundary(text: str, start: int) -> int:
    """The first space after a non-space."""
    at = text.find(" ", start)
    while at == 0 or (at > 0 and text[at - 1] == " "):
        at += 1
        while at < len(text) and text[at] == " ":
            at += 1
        at = text.find(" ", at)
    return at


def _last_boundary(text: str) -> int:
    at = text.rfind(" ")
    while at > 0 and text[at - 1] == " ":
        at -= 1
    if at == 0:
        return _boundary(text, 0)
    return at


def transducer(path: str) -> SegmentTransducer:
    return common.kept("token_counts", path, lambda: SegmentTransducer(path))


def count_tokens(docs: DataFrame, vocabulary: str = "piece_bpe_32k.model", limit: int = LIMIT, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of every row.

    ``vocabulary`` is a file name that ``public_tokenizers.path`` resolves on the executor. No shuffle.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        import public_tokenizers

        machine = transducer(public_tokenizers.path(vocabulary))
        texts = batch.column("text")
        _, off = flat(texts)
        strings = texts.to_pylist()
        for first, last in slices(off, COMPILE):
            machine.compile(strings[first:last])
        counts = np.fromiter((machine.count(t, chunk) for t in strings), np.int64, len(strings))
        return common.batch_of(schema, doc_id=batch.column("doc_id"), n_bytes=np.diff(off), n_tokens=counts, over_limit=counts > limit)

    return common.map_batches(common.id_text(docs), each, SCHEMA, "token_counts")


def query(spark, sf_dir: str) -> DataFrame:
    return count_tokens(common.documents(spark, sf_dir))
