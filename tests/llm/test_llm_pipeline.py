"""The pipeline against plain versions of its stages, on the smallest tables."""

import random

import corpus_pipeline as cp
from corpusmill.llm import decontaminate as dc, minhash, quality

DATA = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, kept = docs.columns, [docs.collect()]
    for i, (_, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, DATA)
        if i + 1 < len(cp.STAGES):
            assert out.columns == columns
        out.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        kept.append(docs.collect())
    raw, good, single, clean, mixed, tokens = kept
    assert all(not quality.base_counts(r["text"].encode())[-1] for r in good) and len(good) < len(raw)
    groups = minhash.brute_force([(r["doc_id"], r["text"]) for r in good], words=5)
    assert {r["doc_id"] for r in single} == {d for d, v in groups.items() if v[2]}
    items = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect()]
    hits = dc.brute_force([(r["doc_id"], r["text"]) for r in single], items)
    assert {r["doc_id"] for r in clean} == {d for d, v in hits.items() if not v[1]}
    assert {r["doc_id"] for r in mixed} <= {r["doc_id"] for r in clean}
    assert len(tokens) == len(mixed) and sum(r["start"] == 0 for r in tokens) == 1
    order = sorted(tokens, key=lambda r: r["start"])
    assert [a["start"] + a["n_tokens"] for a in order[:-1]] == [b["start"] for b in order[1:]]
    assert [r["doc_id"] for r in order] == sorted(r["doc_id"] for r in order)
    assert cp.run(spark, DATA).count() == len(tokens)


def test_stages_take_odd_rows(spark, tmp_path):
    """Nulls in every column, empty, repeated and very long texts, ties, an empty table and columns of clashing names."""
    r = random.Random(6)
    prose = lambda n: " ".join(f"w{r.randint(0, 5000)}" for _ in range(n))
    long, twice = prose(200_000), prose(60)
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (2, twice, None, None, 5), (2, twice, "en", "a", 5), (3, twice, "en", "a", 5), (4, long, "de", "b", 7), (None, prose(50), "en", "b", 1), (5, prose(80), "fr", "a", None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, root long, size long, h long, start long, bucket string, path string"
    docs = spark.createDataFrame([(*x, True, 1, 2, 3, 4, "b", "p") for x in rows], schema)
    spark.createDataFrame([(1, 1, 0), (None, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([("i", " ".join(prose(80).split()[:30])), (None, None)], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for empty in (False, True):
        table = docs.limit(0) if empty else docs
        for i, (_, stage) in enumerate(cp.STAGES):
            out = stage(spark, table, str(tmp_path))
            assert i + 1 == len(cp.STAGES) or out.columns == docs.columns
            got = out.collect()
            assert not empty or got == []
            table = table if empty else docs
        if not empty:
            assert len(got) == len(rows)
            single = cp.near_duplicates(spark, docs, str(tmp_path)).collect()
            assert sorted((x["doc_id"] is None, x["doc_id"] or 0, x["text"] is None) for x in single) == [(False, 1, False), (False, 2, False), (False, 2, False), (False, 4, False), (False, 5, False), (True, 0, False), (True, 0, True)]
            kept = cp.quality_rules(spark, docs, str(tmp_path)).collect()
            assert len(kept) == 6 and all(x["text"] for x in kept)
