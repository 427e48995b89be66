"""The pipeline's stages in a row, each held against what it promises of its input."""

import random
from collections import Counter

import corpus_pipeline
from tests.llm.test_operators import plain_classes, words


def test_stages(spark, tmp_path):
    r = random.Random(9)
    langs = ["en", "en", "en", "de", "es", "fr"]
    rows = [(i, words(r, r.randint(60, 160), 3000), langs[i % 6], "src0") for i in range(60)]
    rows += [(60 + i, rows[i][1] + " more words", langs[i % 6], "src1") for i in range(5)]
    rows += [(65, "again and again " * 40, "en", "src2"), (66, "short", "en", "src2"), (67, "", "de", "src2"), (68, None, "fr", "src2")]
    docs = spark.createDataFrame([(*x, len(x[1] or "")) for x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    now, columns = docs, docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, str(tmp_path))
        path = str(tmp_path / name)
        out.write.parquet(path)
        now = spark.read.parquet(path)
        seen[name] = now
        assert name == "packed_sequences" or now.columns == columns
    kept = {x["doc_id"]: x["text"] for x in seen["quality_rules"].collect()}
    assert set(kept) == set(range(65))
    left = sorted(x["doc_id"] for x in seen["near_duplicates"].collect())
    classes = plain_classes(sorted(kept.items()))
    assert left == sorted(k for k, _, c in classes if k == c) and len(left) == 60
    cut = {x["doc_id"]: x["text"] for x in seen["repeated_passages"].collect()}
    assert sorted(cut) == left
    mixed = Counter(x["doc_id"] for x in seen["language_mix"].collect())
    assert set(mixed) == set(left) and sum(mixed.values()) >= len(left)
    pieces = Counter(x["doc_id"] for x in seen["packed_sequences"].where("piece = 0").collect())
    assert pieces == mixed
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert whole.count() == seen["packed_sequences"].count()


def test_empty_table_and_clashing_columns(spark, tmp_path):
    """No rows at all, and columns named as the stages name their own."""
    plain = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], plain).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
    r = random.Random(10)
    odd = ("_k", "_S", "_key", "set_key", "class", "_rate", "_copy", "_half", "kept", "n_words", "piece", "start", "length")
    rows = [(i, words(r, 80, 3000), "en" if i % 2 else "de", "src", 5, *odd) for i in range(20)]
    rows += [(20, rows[3][1], "en", "src", 5, *odd), (21, None, None, None, None, *odd)]
    docs = spark.createDataFrame(rows, plain + "".join(f", {c} string" for c in odd))
    docs.write.parquet(str(tmp_path / "odd" / "documents.parquet"))
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path / "odd"))
        assert now.columns == docs.columns, name
        assert {tuple(x)[5:] for x in now.collect()} == {odd}
        now.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
    assert {x["doc_id"] for x in now.collect()} == set(range(20))
