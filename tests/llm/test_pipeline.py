"""The pipeline over a small table, each stage against what it has to do."""

from __future__ import annotations

import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402


def test_stages(spark, tmp_path):
    rng = np.random.default_rng(1)

    def prose(lang):
        letters = "abcdefghij" if lang == "aa" else "klmnopqrst"
        return " ".join("".join(rng.choice(list(letters), rng.integers(2, 8))) for _ in range(80))

    rows = [(i, prose(k), k, "s", 0) for i, k in enumerate(["aa", "bb"] * 40)]
    item = prose("aa")[:120]
    rows += [(200, rows[3][1], "bb", "s", 1), (201, None, None, None, None), (202, "12 34", "aa", "s", 5), (203, item, "aa", "s", 5)]
    rows += [(204, prose("bb") + " " + item + " " + prose("bb"), "bb", "s", 1), (205, prose("aa") + " password=0123456789abcdef0123", "aa", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == set(range(80)) | {204, 205}
    assert item not in got[204]["text"] and got[204]["n_chars"] == len(got[204]["text"])
    assert "[SECRET]" in got[205]["text"] and "0123456789abcdef" not in got[205]["text"]
    assert all(got[i]["text"] == rows[i][1] for i in range(80))
    empty = docs.where(F.lit(False))
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, str(tmp_path))
        assert empty.count() == 0
