"""Secrets: rules for known forms, and a linear-chain conditional random field for the rest.

Base kinds (assign, access, hex) are the leftmost non-overlapping matches of each rule. The random
field tags the tokens of a text as begin, inside or outside of a secret, from the token's shape, the
words around it and features of the whole file; Viterbi finds the best tags. A tagged stretch that no
base span touches is added as kind ``crf``.

The field is trained here, by stochastic gradient on the exact conditional likelihood (forward and
backward sums), on labelled lines that a seeded generator writes: its weights are the same at any
size of input, and small. *Plain* tokens (runs of letters of one case, signs) get a score for
"outside" that no transition or neighbour can outweigh; ``Field.decided`` proves this bound from the
trained weights. Viterbi therefore passes through "outside" at each of them, and is run on the
stretches between; the result is that of the whole chain.

Null and empty texts have no spans. Rows are independent; other columns play no part. No shuffle.
"""

from __future__ import annotations

import math
import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .bytesops import byte_class, flat, words
from .spans import Span, digest, masked, ordered

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "crf")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]++)""", re.IGNORECASE | re.ASCII)
_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}+")
_TOKEN = re.compile(r"[A-Za-z0-9+/_=.-]+|[^\sA-Za-z0-9+/_=.-]")
#: A text with none of these has plain tokens only.
_NOTABLE = re.compile(r"[0-9_+/=]|[a-z][A-Z]|[A-Z][A-Z][a-z]")
_PLAIN = re.compile(r"[.-]*(?:[A-Z]?[a-z]+|[A-Z]+)(?:[.-]+(?:[A-Z]?[a-z]+|[A-Z]+))*[.-]*|[.-]+")
#: Mean of the Gaussian prior of a plain token's weights; the prior mean of all others is 0.
PLAIN = (8.0, -8.0, -8.0)
TAGS = ("outside", "begin", "inside")
#: Words that announce a secret, and words that announce another kind of long token.
HINTS = frozenset("password passwd pwd secret token key apikey api_key auth authorization bearer credential credentials private access client_secret private_key".split())
COUNTER = frozenset("commit sha sha1 sha256 md5 hash checksum uuid id guid version build revision isbn phone tel ip url http https doi order invoice".split())
REACH = 3


def rules(text: str, hexes: bool = True) -> list[Span]:
    """Spans of the base kinds, in order. ``hexes`` is False if the text is known to hold no long run of hex digits."""
    out: list[Span] = []
    low = text.lower()
    if any(word in low for word in _KEYWORDS):
        out += [Span("assign", *m.span(), 1.0) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [Span("access", *m.span(), 1.0) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if hexes:
        out += [Span("hex", *m.span(), 1.0) for m in _HEX.finditer(text)]
    return ordered(out, KINDS)


# --- features -----------------------------------------------------------------------------------


def plain(token: str) -> bool:
    return not token[0].isalnum() and token[0] not in "+/_=.-" or _PLAIN.fullmatch(token) is not None


def _entropy(token: str) -> float:
    n = len(token)
    return -sum(c / n * math.log2(c / n) for c in map(token.count, set(token)))


def shape(token: str) -> list[str]:
    """Features of one token alone."""
    if plain(token):
        return ["plain", "plain:sign" if not token[0].isalnum() else "plain:word"]
    lower, upper, digit = (any(a <= c <= b for c in token) for a, b in ("az", "AZ", "09"))
    signs = sum(not c.isalnum() for c in token)
    length = min(len(token).bit_length(), 8)
    kinds = f"{'a' * lower}{'A' * upper}{'0' * digit}"
    bits = int(_entropy(token[:256]) * 2)
    out = [f"kinds:{kinds}", f"length:{length}", f"kinds:{kinds}|length:{length}", f"bits:{min(bits, 11)}"]
    out += ["signs" if signs > 1 else f"signs:{signs}"]
    if digit and not lower and not upper:
        out.append("numeric")
    if re.fullmatch(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", token):
        out.append("uuid")
    if "/" in token and token.count("/") + token.count(".") >= 2 and len(token) < 60:
        out.append("pathlike")
    if re.fullmatch(r"[0-9a-f]+", token):
        out.append("hexlike")
    changes = sum(_class(a) != _class(b) for a, b in zip(token, token[1:]))
    out.append(f"changes:{min(8, 8 * changes // max(1, len(token) - 1))}")
    return out


def _class(c: str) -> int:
    return 0 if "a" <= c <= "z" else 1 if "A" <= c <= "Z" else 2 if "0" <= c <= "9" else 3


def around(tokens: list[str], at: int) -> list[str]:
    """Features of the neighbouring words."""
    out = []
    for name, words in (("hint", HINTS), ("counter", COUNTER)):
        for step in range(1, REACH + 1):
            if at >= step and tokens[at - step].lower().strip(".-") in words:
                out.append(f"{name}-{step}")
                break
    if at and tokens[at - 1] in (":", "="):
        out.append("after:is")
    if at and tokens[at - 1] in ("'", '"'):
        out.append("after:quote")
    if at + 1 < len(tokens) and tokens[at + 1] in ("'", '"'):
        out.append("before:quote")
    if at and tokens[at - 1] == "@" or at + 1 < len(tokens) and tokens[at + 1] == "@":
        out.append("at-sign")
    return out


def file_features(text: str) -> list[str]:
    """Features of the whole text that every token shares."""
    signs = text.count("=") + text.count(":") + text.count("{")
    out = [f"file:signs:{min(3, int(40 * signs / (len(text) + 1)))}"]
    if "PRIVATE KEY" in text:
        out.append("file:pem")
    return out


# --- the field ----------------------------------------------------------------------------------


class Field:
    def __init__(self) -> None:
        self.index: dict[str, int] = {}
        self.weights = np.zeros((0, 3))
        self.steps = np.zeros((3, 3))
        #: Whether plain tokens are outside whatever stands around them.
        self.free = False

    def emissions(self, rows: list[list[str]]) -> np.ndarray:
        out = np.zeros((len(rows), 3))
        for i, names in enumerate(rows):
            found = [self.index[n] for n in names if n in self.index]
            if found:
                out[i] = self.weights[found].sum(0)
        return out

    def train(self, lines: list[tuple[list[list[str]], list[int]]], epochs: int = 4, rate: float = 0.25, decay: float = 1e-4) -> Field:
        for rows, _ in lines:
            for names in rows:
                for n in names:
                    self.index.setdefault(n, len(self.index))
        prior = np.zeros((len(self.index), 3))
        prior[self.index["plain"]] = PLAIN
        self.weights = prior.copy()
        square, square_steps = np.full(self.weights.shape, 1e-2), np.full((3, 3), 1e-2)
        order = random.Random(5)
        for _ in range(epochs):
            order.shuffle(lines)
            for rows, tags in lines:
                e = self.emissions(rows)
                one, two = self._marginals(e)
                one[np.arange(len(tags)), tags] -= 1
                grad = np.zeros_like(self.steps)
                if len(tags) > 1:
                    grad = two.sum(0)
                    np.subtract.at(grad, (tags[:-1], tags[1:]), 1)
                for i, names in enumerate(rows):
                    at = [self.index[n] for n in names]
                    g = one[i] + decay * (self.weights[at] - prior[at])
                    square[at] += g * g
                    self.weights[at] -= rate * g / np.sqrt(square[at])
                grad += decay * self.steps
                square_steps += grad * grad
                self.steps -= rate * grad / np.sqrt(square_steps)
        self.free = self.decided([f"{name}-{i}" for name in ("hint", "counter") for i in range(1, REACH + 1)])
        return self

    def _marginals(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(e)
        a, b = e.copy(), np.zeros_like(e)
        for t in range(1, n):
            a[t] += np.logaddexp.reduce(a[t - 1][:, None] + self.steps, axis=0)
        for t in range(n - 2, -1, -1):
            b[t] = np.logaddexp.reduce(self.steps + e[t + 1] + b[t + 1], axis=1)
        z = np.logaddexp.reduce(a[-1])
        two = np.exp(a[:-1, :, None] + self.steps + (e[1:] + b[1:])[:, None, :] - z)
        return np.exp(a + b - z), two

    def decided(self, context: list[str]) -> bool:
        """Whether a plain token with any of these features around it is outside on every best path.

        Moving its tag to "outside" gains at least the margin of its score and loses at most the spread
        of the transitions on both sides.
        """
        spread = 2 * float(self.steps.max() - self.steps.min())
        groups = [["plain:sign", "plain:word"], [n for n in context if n.startswith("hint")], [n for n in context if n.startswith("counter")], ["after:is"], ["after:quote"], ["before:quote"], ["at-sign"], [n for n in self.index if n.startswith("file:signs")], ["file:pem"]]
        worst = np.inf
        for tag in (1, 2):
            gap = lambda n, tag=tag: float(self.weights[self.index[n]][0] - self.weights[self.index[n]][tag]) if n in self.index else 0.0
            margin = gap("plain") + min(map(gap, groups[0]))
            margin += sum(min(0.0, *map(gap, g)) if g else 0.0 for g in groups[1:])
            worst = min(worst, margin)
        return worst > spread

    def viterbi(self, e: np.ndarray, left: bool, right: bool) -> list[int]:
        """Best tags; ``left`` and ``right`` say whether a token that is outside stands there."""
        best, back = [list(e[0] + (self.steps[0] if left else 0))], []
        steps = self.steps.tolist()
        for row in e[1:].tolist():
            now, frm = [], []
            for y in range(3):
                options = [best[-1][x] + steps[x][y] for x in range(3)]
                x = options.index(max(options))
                now.append(options[x] + row[y])
                frm.append(x)
            best.append(now)
            back.append(frm)
        last = [v + (steps[y][0] if right else 0) for y, v in enumerate(best[-1])]
        tags = [last.index(max(last))]
        for frm in reversed(back):
            tags.append(frm[tags[-1]])
        return tags[::-1]


def _made(rng: random.Random) -> tuple[list[str], list[int]]:
    """A labelled line: tokens and tags. The forms are invented; none is a real credential."""
    letters, capitals, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    draw = lambda pool, n: "".join(rng.choice(pool) for _ in range(n))
    word = lambda: rng.choice((str.lower, str.lower, str.lower, str.title, str.upper))(draw(letters, rng.randint(1, 12)))
    secret = rng.choice((
        lambda: draw(letters + capitals + digits, rng.randint(20, 48)),
        lambda: draw(letters + capitals + digits + "+/", rng.choice((40, 44, 64))),
        lambda: rng.choice(("ghp", "sk_live", "xoxb", "glpat", "npm", "pk")) + rng.choice("_-") + draw(letters + capitals + digits, rng.randint(20, 40)),
        lambda: ".".join(draw(letters + capitals + digits + "_-", rng.randint(16, 40)) for _ in range(3)),
        lambda: draw("0123456789abcdef", rng.choice((32, 40, 64))),
        lambda: draw(capitals + digits, rng.randint(20, 32)),
        lambda: draw(letters + capitals + digits + "_-", rng.randint(10, 18)),
    ))
    other = rng.choice((
        lambda: draw(digits, rng.randint(1, 19)),
        lambda: ".".join(draw(digits, rng.randint(1, 3)) for _ in range(4)),
        lambda: "-".join(draw(digits, n) for n in (3, 4)),
        lambda: "-".join(draw("0123456789abcdef", n) for n in (8, 4, 4, 4, 12)),
        lambda: "/".join(draw(letters, rng.randint(2, 8)) for _ in range(rng.randint(2, 5))),
        lambda: draw(letters, rng.randint(2, 8)) + "." + draw(digits, rng.randint(1, 2)),
        lambda: "v" + ".".join(draw(digits, 1) for _ in range(3)),
        lambda: draw(letters, rng.randint(3, 7)) + "_" + draw(letters, rng.randint(3, 7)),
        lambda: draw(letters, 3) + draw(letters, rng.randint(3, 8)).title(),
        lambda: draw(letters, 4) + draw(digits, rng.randint(1, 4)),
        lambda: draw(digits, 4) + "-" + draw(digits, 2) + "-" + draw(digits, 2),
    ))
    tokens, tags = [word() for _ in range(rng.randint(0, 6))], []
    tags = [0] * len(tokens)

    def put(text: str, secretly: bool) -> None:
        found = _TOKEN.findall(text)
        tokens.extend(found)
        tags.extend([0] * len(found) if not secretly else [1] + [2] * (len(found) - 1))

    kind = rng.random()
    if kind < 0.45:
        short = (s := secret()) and len(s) < 20
        if short or rng.random() < 0.8:
            put(rng.choice(sorted(HINTS)), False)
            put(rng.choice((":", "=", "", "is")), False)
        quote = rng.choice(("", "", '"', "'"))
        put(quote, False)
        put(s, True)
        put(quote, False)
    elif kind < 0.6:
        put(rng.choice(sorted(COUNTER)), False)
        put(rng.choice((":", "=", "")), False)
        put(rng.choice((draw("0123456789abcdef", rng.choice((12, 32, 40, 64))), other())), False)
    elif kind < 0.9:
        for _ in range(rng.randint(1, 3)):
            put(other(), False)
            put(rng.choice((word(), ",", "")), False)
        if rng.random() < 0.2:
            put(word() + "@" + word().lower() + ".example.com", False)
    else:
        put(rng.choice(sorted(HINTS)), False)
        put(word(), False)
    for _ in range(rng.randint(0, 5)):
        put(rng.choice((word(), word(), ",", "!!", ".")), False)
    return tokens, tags


@lru_cache(1)
def field(lines: int = 1500) -> Field:
    """The trained field; the generator's seed and the number of lines fix it."""
    rng = random.Random(11)
    data = []
    for _ in range(lines):
        tokens, tags = _made(rng)
        if tokens:
            shared = [f"file:signs:{rng.randint(0, 3)}", *(["file:pem"] if rng.random() < 0.02 else [])]
            data.append(([shape(t) + around(tokens, i) + shared for i, t in enumerate(tokens)], tags))
    return Field().train(data)


def _stretches(text: str) -> list[tuple[int, int]]:
    """Where the tokens that are not plain lie, with at least ``REACH`` tokens on either side: the cuts are at spaces."""
    out: list[list[int]] = []
    for m in _NOTABLE.finditer(text):
        if out and m.start() < out[-1][2]:
            continue
        left, right = m.start(), m.end()
        for _ in range(REACH + 2):
            left = text.rfind(" ", 0, left) if left > 0 else -1
        end = right = _space(text, m.end())
        for _ in range(REACH):
            right = _space(text, right + 1)
        left = max(left, 0)
        if out and left <= out[-1][1]:
            out[-1][1:] = [right, end]
        else:
            out.append([left, right, end])
    return [(a, b) for a, b, _ in out]


def _space(text: str, start: int) -> int:
    at = text.find(" ", start)
    return len(text) if at < 0 else at


def tagged(text: str, model: Field) -> list[Span]:
    """Stretches that the field tags, over the whole text."""
    if not model.free:
        return _decode(text, 0, len(text), model, file_features(text))
    if not _NOTABLE.search(text):
        return []  # plain tokens only
    shared = file_features(text)
    return [s for start, end in _stretches(text) for s in _decode(text, start, end, model, shared)]


def _decode(text: str, start: int, end: int, model: Field, shared: list[str]) -> list[Span]:
    found = list(_TOKEN.finditer(text, start, end))
    tokens = [m[0] for m in found]
    keep = [not (model.free and plain(t)) for t in tokens]
    out: list[Span] = []
    i, n = 0, len(tokens)
    while i < n:
        if not keep[i]:
            i += 1
            continue
        j = i
        while j < n and keep[j]:
            j += 1
        e = model.emissions([shape(tokens[k]) + around(tokens, k) + shared for k in range(i, j)])
        tags = model.viterbi(e, i > 0, j < n)
        first = None
        for k, tag in enumerate([*tags, 0]):
            if tag != 2 and first is not None:
                out.append(Span("crf", found[i + first].start(), found[i + k - 1].end(), 0.5))
                first = None
            if tag == 1 or tag == 2 and first is None:
                first = k
        i = j
    return out


def find(text: str, model: Field, notable: bool = True, hexes: bool = True) -> tuple[list[Span], list[Span]]:
    """Base spans, and added ones that no base span touches. The flags are False where a text is known to hold nothing of the kind."""
    base = rules(text, hexes)
    added = tagged(text, model) if notable else []
    if base and added:
        added = [s for s in added if not any(b.start < s.end and s.start < b.end for b in base)]
    return base, added


_SIGNS = byte_class((0x30, 0x39), *((ord(c), ord(c)) for c in "_+/="))
_SMALL, _CAPITAL, _HEXES = byte_class((0x61, 0x7A)), byte_class((0x41, 0x5A)), byte_class((0x30, 0x39), (0x61, 0x66))


def _flags(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For each row, whether _NOTABLE and whether _HEX can match, from the bytes of the whole batch."""
    data, off = flat(column)
    small, capital = _SMALL[data], _CAPITAL[data]
    hits = _SIGNS[data]
    hits[:-1] |= small[:-1] & capital[1:]
    hits[:-2] |= capital[:-2] & capital[1:-1] & small[2:]
    start, end, _ = words(data, off, _HEXES)
    flags = []
    for at in (np.flatnonzero(hits), start[end - start >= 24]):
        row = np.zeros(len(off) - 1, bool)
        row[np.searchsorted(off, at, "right") - 1] = True
        flags.append(row)
    return flags[0], flags[1]


SPANS = "array<struct<kind:string,start:long,end:long,score:double>>"
_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def find_secrets(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """doc_id, all spans, the digest of those of the base kinds, and, if ``with_text``, the text with the spans masked."""
    model = field()
    schema = pa.schema([("doc_id", pa.int64()), ("spans", _SPAN), ("base_sha256", pa.string()), *([("masked", pa.string())] if with_text else [])])

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        spans, digests, texts = [], [], []
        column = batch.column("text")
        for text, notable, hexes in zip(column.to_pylist(), *_flags(column), strict=True):
            base, added = find(text, model, notable, hexes)
            every = ordered(base + added, KINDS)
            spans.append([s._asdict() for s in every])
            digests.append(digest(base))
            if with_text:
                texts.append(masked(text, every) if every else text)
        return common.batch_of(schema, doc_id=batch.column("doc_id"), spans=spans, base_sha256=digests, masked=texts)

    return common.map_batches(common.id_text(docs), each, f"doc_id long, spans {SPANS}, base_sha256 string" + ", masked string" * with_text)


def query(spark, sf_dir: str) -> DataFrame:
    """Counts and digests of the operator's spans."""
    found = find_secrets(common.documents(spark, sf_dir), with_text=False)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    name = F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return found.select("doc_id", *map(count, BASE), "base_sha256", F.concat_ws(",", name).alias("spans"))
