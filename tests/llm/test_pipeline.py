"""The pipeline's stages over a small folder: what goes and what stays."""

from __future__ import annotations

import random

import corpus_pipeline
from conftest import *  # noqa: F403


def test_stages(spark, tmp_path):
    rng = random.Random(12)
    good = [words(rng, 80) for _ in range(120)]  # noqa: F405
    rows = [(i, t) for i, t in enumerate(good)]
    rows += [(200 + i, " ".join(w.upper() + "!!" for w in words(rng, 80).split(" "))) for i in range(60)]  # noqa: F405
    rows += [(300, good[3]), (301, good[4] + " " + "mail to someone@example.com"), (302, words(rng, 60) + " " + " ".join(good[5].split(" ")[:30]))]  # noqa: F405
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i < 200), 0) for i, _ in rows], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, " ".join(good[5].split(" ")[5:25]))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, counts = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / f"stage{n}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{n}"))
        if n < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            counts[name] = {r.doc_id: r.text for r in docs.collect()}
    assert not any(200 <= i < 300 for i in counts["quality"]) and len(counts["quality"]) >= 120
    assert 300 not in counts["near_duplicates"] and 3 in counts["near_duplicates"]
    assert 5 not in counts["decontamination"] and 302 not in counts["decontamination"]
    assert len(counts["decontamination"]) == len(counts["near_duplicates"]) - 2
    assert "someone@" not in str(counts["personal_data"].values())
    assert {r.doc_id for r in docs.collect()} == set(counts["personal_data"])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()
