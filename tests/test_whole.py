"""Queries over whole tables, where the registered SQL or the other tests see a part."""

from __future__ import annotations

from collections import defaultdict

from builders import archive
from silvane.operators import rules
from silvane.plans import pipelines, table_queries


def test_segment_offsets_of_equal_line_numbers(spark, tmp_path):
    rows = [(1, 1, 9, 9, 5.0), (1, 1, 3, 9, 7.0), (1, 2, 1, 1, 2.0), (1, 1, 3, 4, 11.0), (2, 1, 1, 1, 4.0), (2, 2, 1, 1, 4.0), (3, 1, 1, 1, 6.0), (3, 1, 1, 1, 2.0)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    want, before = [], defaultdict(int)
    for order, line, _, _, quantity in sorted(rows):
        want.append((order, line, before[order]))
        before[order] += int(quantity)
    assert sorted(map(tuple, table_queries.segment_offsets(spark, str(tmp_path)).collect())) == sorted(want)


def islands(a: bytes, b: bytes) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for i in range(max(len(a), len(b))):
        if a[i : i + 1] != b[i : i + 1]:
            if out and sum(out[-1]) == i:
                out[-1] = (out[-1][0], out[-1][1] + 1)
            else:
                out.append((i, 1))
    return out


def test_byte_islands_of_long_texts(spark, tmp_path):
    base = "é" * 30 + "abcdefghij" * 60
    turns = [base, base[:450] + "X" + base[451:], base[:390] + "Y" * 30 + base[420:], base + "tail", base[:400], "", "z" * 1500, None, "w"]
    rows = [(c, i, "user", t) for c in (1, 2) for i, t in enumerate(turns[:: 3 - 2 * c])]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    texts = {(c, i): t for c, i, _, t in rows}
    want = []
    for (c, i), t in texts.items():
        after = texts.get((c, i + 1))
        if t is not None and after is not None:
            want += [(c, i, *island) for island in islands(t.encode(), after.encode())]
    assert sorted((r["conv_id"], r["turn"], r["start"], r["length"]) for r in table_queries.byte_islands(spark, str(tmp_path)).collect()) == sorted(want)


def test_unpack_writes_entries_whose_generated_name_is_taken(spark, tmp_path):
    names = ["a.png", "a.png", "a__duplicate-002.png", "A.PNG", "b.txt", "b.txt", "c"]
    (tmp_path / "x.xp3").write_bytes(archive([{"name": n, "segments": [(bytes([65 + i]), False)]} for i, n in enumerate(names)]))
    written, _ = pipelines.unpack(spark, [str(tmp_path / "x.xp3")], str(tmp_path / "out"))
    want = rules.exact_duplicate_names(names)
    assert sorted((r.output_name, r.written) for r in written.collect()) == sorted((n, True) for n in want)
    assert [(tmp_path / "out" / n).read_bytes() for n in want] == [bytes([65 + i]) for i in range(len(names))]
