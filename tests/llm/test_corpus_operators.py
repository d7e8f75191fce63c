"""Repeats, near-duplicates, decontamination, neighbours, language model: against brute force."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from conftest import *  # noqa: F403
from silvane.llm import ann, connected, decontaminate, lm_score, near_dups, packing, repeats

SPACED = re.compile(rb"[^\x20\x09-\x0D]+")
WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def key(i):
    return -1 if i is None else i


def test_repeats(docs, rows, empty):
    for length, gram in ((400, 64), (60, 16)):
        raw = [(key(i), (t or "").encode()) for i, t, _ in rows]
        seen = Counter(b[p : p + length] for _, b in raw for p in range(len(b) - length + 1))
        want = []
        for i, b in raw:
            cover: list[list[int]] = []
            for p in range(len(b) - length + 1):
                if seen[b[p : p + length]] > 1:
                    if cover and p <= cover[-1][1]:
                        cover[-1][1] = p + length
                    else:
                        cover.append([p, p + length])
            cuts = [0, *(x for c in cover for x in c), len(b)]
            rest = b"".join(b[x:y] for x, y in zip(cuts[::2], cuts[1::2], strict=True))
            want.append((i, len(b), tuple(map(tuple, cover)), hashlib.sha256(rest).hexdigest(), rest))
        out = repeats.remove_repeats(docs, length, gram).collect()
        assert sorted((key(r.doc_id), r.n_bytes, tuple((s.begin, s.end) for s in r.spans), r.kept_sha256, bytes(r.kept)) for r in out) == sorted(want)
    assert repeats.remove_repeats(empty).count() == 0


def brute_components(rows):
    sets = []
    for _, t, _ in rows:
        w = SPACED.findall(lowered(t))  # noqa: F405
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    least = defaultdict(list)
    for i, (d, _, _) in enumerate(rows):
        least[root(i)].append(d)
    smallest = {k: min((d for d in v if d is not None), default=None) for k, v in least.items()}
    return sets, [smallest[root(i)] for i in range(len(rows))]


def test_near_duplicates(docs, rows, empty):
    sets, component = brute_components(rows)
    want = sorted((key(d), len(s), key(c)) for (d, _, _), s, c in zip(rows, sets, component, strict=True))
    out = near_dups.near_duplicates(docs).collect()
    assert sorted((key(r.doc_id), r.n_shingles, key(r.component_id)) for r in out) == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in out if r.doc_id is not None)
    kept = near_dups.keep_one(docs)
    assert kept.columns == docs.columns
    groups = {(c if c is not None else ("none", i)) for i, (c, s) in enumerate(zip(component, sets, strict=True)) if s}
    assert kept.count() == len(groups) + sum(not s for s in sets)
    assert near_dups.near_duplicates(empty).count() == 0


def test_near_duplicates_confirm_a_pair_once(spark):
    """Classes that meet under many keys are compared once; pairs and blocks find the same links."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in rng.integers(0, 10**6, 120)]
    texts = [" ".join([*base[:at], *(f"x{i}y{j}" for j in range(20 + i % 3 * 10)), *base[at + 20 :]]) for i, at in enumerate(range(0, 96, 8))]
    sets = [{tuple(w[j : j + 5]) for j in range(len(w) - 4)} for w in (t.split() for t in texts)]
    classes = spark.createDataFrame([(bytes([i] * 16), t.encode(), len(s)) for i, (t, s) in enumerate(zip(texts, sets, strict=True))], "class binary, text binary, n long")
    packed = near_dups._packed(classes.selectExpr("cast(n as long) doc_id", "cast(text as string) text"))
    by_text = classes.selectExpr("class", "unhex(md5(concat_ws(':', cast(n as string), cast(text as string)))) rid").join(packed, "rid").select("class", "packed")
    opened = classes.selectExpr("explode(sequence(1L, 40L)) key", "class", "n", "class comp").where("key % 3 <> 0 or class > X'01010101010101010101010101010101'")
    pairs = near_dups._pairs(near_dups._buckets(opened), 50)
    assert pairs.count() == pairs.select("center", "member").distinct().count() <= 12 * 11 // 2
    want = {(i, j) for j in range(12) for i in range(j) if 100 * len(sets[i] & sets[j]) >= 50 * len(sets[i] | sets[j])}
    assert want

    def groups(links) -> set:
        parent = list(range(12))
        for a, b in links:
            a, b = parent[a], parent[b]
            parent = [min(a, b) if p in (a, b) else p for p in parent]
        return set(enumerate(parent))

    for paired in (0, 1000):
        got = {(r.a[0], r.b[0]) for r in near_dups._searched(opened, by_text, 5, 50, paired).collect()}
        assert got if paired == 0 else {tuple(sorted(x)) for x in got} == want
        assert groups(got) == groups(want)


def test_components(spark):
    name = lambda i: hashlib.md5(str(i).encode()).digest()
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (100, 103), (7, 7), (200, 200)] + [(500, 501 + i) for i in range(300)]
    out = connected.components(spark.createDataFrame([(name(a), name(b)) for a, b in edges], "a binary, b binary")).collect()
    want = {}
    for group in (range(41), (100, 101, 103), range(500, 801)):
        want |= {name(i): min(map(name, group)) for i in group}
    assert {bytes(r.node): bytes(r.component) for r in out} == want


def test_decontamination(spark, docs, rows, empty):
    item = " ".join((rows[5][1] + " " + rows[6][1]).split(" ")[:25])
    inside = " ".join(rows[50][1].split()[45:75])
    items = [(1, item), (2, inside.upper()), (3, None), (4, "..."), (5, "one TWO"), (5, "one TWO"), (None, "no id here at all"), (10, " ".join(rows[8][1].split(" ")[:3]) or "the")]
    benchmark = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id int")
    windows = defaultdict(set)
    for i, t in items:
        w = WORDS.findall(lowered(t))  # noqa: F405
        if i is not None:
            for k in range(max(1, len(w) - 9) if w else 0):
                windows[tuple(w[k : k + 10])].add(str(i))
    want = []
    for i, t, _ in rows:
        w, hit, found = WORDS.findall(lowered(t)), set(), set()  # noqa: F405
        for n in set(map(len, windows)):
            for k in range(len(w) - n + 1):
                if owners := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= owners
        want.append((key(i), len(w), tuple(sorted(hit)), tuple(sorted(found))))
    for block in (decontaminate.BLOCK, 7):
        out = decontaminate.matches(docs, benchmark, block=block).collect()
        assert sorted((key(r.doc_id), r.n_words, tuple(r.hits), tuple(r["items"])) for r in out) == sorted(want)
        clean = decontaminate.keep_clean(docs, benchmark, block=block)
        assert clean.columns == docs.columns and clean.count() == sum(not h for _, _, h, _ in want)
    assert sum(bool(w[2]) for w in want) >= 3
    assert decontaminate.matches(empty, benchmark).count() == 0
    assert decontaminate.matches(docs, benchmark.limit(0)).where("size(hits) > 0").count() == 0


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha one two beta"), (2, "alpha one two three four beta"), (3, "beta"), (4, None)], "doc_id long, text string")
    found = decontaminate.proximity(decontaminate.build_index(docs), [("q", ["Alpha", "beta"])], 3).collect()
    assert [(r.query, r.doc_id) for r in found] == [("q", 1)]


def test_neighbours(spark):
    rng = np.random.default_rng(5)
    points = rng.standard_normal((1500, 16)).astype(np.float32)
    points[100:400] = points[7]
    rows = [(i, p.tolist(), 0) for i, p in enumerate(points)]
    odd = [(2000, None, 0), (2020, [0.0] * 16, 0), (2040, [float("nan")] + [1.0] * 15, 0), (2060, [None] + [1.0] * 15, 0), (2080, [1.0] * 3, 0), (None, [1.0] * 16, 0), (0, points[0].tolist(), 0)]
    vectors = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, rank int")
    out = ann.nearest(vectors, vectors.where("vec_id % 20 = 0")).collect()
    got = defaultdict(list)
    for r in sorted(out, key=lambda r: (r.query_id, r["rank"])):
        got[r.query_id].append((r.vec_id, r.score))
    assert set(got) == set(range(0, 1500, 20))
    hits = 0
    x = points.astype(np.float64)
    for q, found in got.items():
        near = x @ x[q]
        near[q] = -np.inf
        best = sorted(range(1500), key=lambda i: (-round(near[i], 9), i))[:20]
        assert len(found) == 20 and all(abs(s - near[i]) < 1e-9 for i, s in found)
        hits += len({i for i, _ in found} & set(best))
    assert hits / (20 * len(got)) >= 0.9
    few = vectors.where("vec_id < 5").drop("rank")
    assert ann.nearest(few, few.where("vec_id = 0")).count() == 4
    assert ann.nearest(vectors.limit(0), vectors.limit(0)).count() == 0


def test_language_model(docs, rows, empty):
    order = lm_score.ORDER
    count: Counter = Counter()
    full: dict = defaultdict(Counter)
    for i, t, _ in rows:
        if i is None or zlib.crc32(str(i).encode()) % 7 != 2:
            b = lowered(t)  # noqa: F405
            count.update(SPACED.findall(b))
            count["end"] += 1
            s = b"\xff" * order + b + b"\xfe"
            for p in range(order, len(s)):
                full[s[p - order : p]][s[p]] += 1
    levels = {order: full}
    for k in range(order - 1, -1, -1):
        levels[k] = defaultdict(Counter)
        for context, after in levels[k + 1].items():
            for x in after:
                levels[k][context[1:]][x] += 1
    total, distinct = sum(count.values()), len(count)

    def log_p(context, symbol):
        out, excluded = 0.0, set()
        for k in range(order, -1, -1):
            live = {x: n for x, n in levels[k].get(context[order - k :], {}).items() if x not in excluded}
            if not live:
                continue
            n = sum(live.values())
            if symbol in live:
                return out + math.log10((2 * live[symbol] - 1) / (2 * n))
            out += math.log10(len(live) / (2 * n))
            excluded |= set(live)
        return out - math.log10(257 - len(excluded))

    want = defaultdict(list)
    for i, t, _ in rows:
        b = lowered(t)  # noqa: F405
        tokens = [*SPACED.findall(b), "end"]
        s = b"\xff" * order + b + b"\xfe"
        base = sum(math.log10((count.get(w, 0) + 1) / (total + distinct + 1)) for w in tokens)
        want[key(i)].append((len(tokens), sum(count.get(w, 0) > 0 for w in tokens), base, sum(log_p(s[p - order : p], s[p]) for p in range(order, len(s)))))
    out = lm_score.score(docs, block_bytes=20_000).collect()
    assert len(out) == len(rows) and {r.train_tokens for r in out} == {total}
    for r in out:
        assert any(w[:2] == (r.n_tokens, r.n_known) and abs(w[2] - r.base_score) < 1e-6 and abs(w[3] - r.score) < 1e-6 for w in want[key(r.doc_id)])
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
    assert lm_score.score(empty).count() == 0


def test_language_model_questions_travel_packed(docs):
    """No answer is joined back by its key; many small tasks and parts of a block give what a few large ones give."""
    many = lm_score.score(docs, block_bytes=20_000, priced=20)
    plan = many._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Window" not in plan
    by_text = lambda found: sorted((r.doc_id or -1, r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in found.collect())
    assert by_text(many) == by_text(lm_score.score(docs))
    keys = np.sort(np.random.default_rng(3).integers(-(2**63), 2**63 - 1, 5000))
    assert (lm_score._keys(lm_score._steps(keys)) == keys).all()
    buckets = lm_score.word_bucket(keys, 7)
    assert (np.diff(buckets) >= 0).all() and buckets.min() >= 0 and buckets.max() < 7 * lm_score.SPREAD


def test_unit_table_takes_many_units_at_once():
    rng = np.random.default_rng(4)
    table = packing.Units()
    for many in (60_000, 5, 300_000):
        one, two = (rng.integers(0, 2**64, many, dtype=np.uint64) for _ in range(2))
        table.add(one, two, [np.array([i], "<u4") for i in range(many)])
        number = table.find(one, two)
        assert (table.ids[table.begin[number]] == np.arange(many)).all()
        assert (table.find(two, one) < 0).all()
