"""The pipeline, stage by stage, against what each stage must leave."""

import corpus_pipeline
from pyspark.sql import functions as F

from linewright.llm import secrets


def test_stages(spark, edge_docs, sentences, tmp_path):
    root = str(tmp_path)
    good = lambda n, seed: "the of and to in a is that " * 1 + sentences(n, seed)
    item = sentences(40, 77)
    rows = [(1, good(90, 1)), (2, good(90, 1)), (3, good(90, 3) + " token = 'abcdefgh1234'"), (4, f"{good(60, 4)} {item} {sentences(20, 5)}"), (5, "short"), (6, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    frame, seen = spark.read.parquet(f"{root}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, root)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert frame.columns == docs.columns
        frame.write.parquet(f"{root}/{len(seen)}")
        frame = spark.read.parquet(f"{root}/{len(seen)}")
        seen.append(sorted({r["doc_id"] for r in frame.select("doc_id").collect()}))
    assert seen == [[1, 2, 3, 4], [1, 3, 4], [1, 3], [1, 3], [1, 3]]
    masked = spark.read.parquet(f"{root}/3").filter("doc_id = 3").first()
    assert secrets.MASK in masked["text"] and masked["n_chars"] == len(masked["text"])
    strip = lambda f: sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in f.collect())
    assert strip(corpus_pipeline.run(spark, root)) == strip(frame)


def test_edge_rows(spark, edge_docs, edge_rows, sentences, tmp_path):
    """Null ids, nulls, repeated rows, a very long text and clashing columns; and no rows at all."""
    root = str(tmp_path)
    spark.createDataFrame([(1, sentences(30, 77))], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    edge_docs.write.parquet(f"{root}/documents.parquet")
    frame = spark.read.parquet(f"{root}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        frame = stage(spark, frame, root)
        frame.write.parquet(f"{root}/{k}")
        frame = spark.read.parquet(f"{root}/{k}")
        assert frame.columns == edge_docs.columns
    kept = sorted(repr(r["doc_id"]) for r in frame.select("doc_id").collect())
    assert kept == sorted(["1", "9", "10", "11", "None"])  # 2 and 3 are copies, 13 repeats itself, the others are short
    packed = corpus_pipeline.run(spark, root).collect()
    assert {repr(r["doc_id"]) for r in packed} == set(kept) and sum(r["length"] for r in packed if r["doc_id"] == 11) > 30000
    # Rows of any column names keep them through every stage.
    odd = edge_docs.limit(4).unionByName(edge_docs.limit(4)).withColumns({"a b": F.lit(1), "x.y": F.lit(2), "q`t": F.lit(3), "_row.z": F.lit(4)})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        odd = stage(spark, odd, root)
        assert odd.columns == [*edge_docs.columns, "a b", "x.y", "q`t", "_row.z"]
    assert {tuple(r[-4:]) for r in odd.collect()} == {(1, 2, 3, 4)}
    assert corpus_pipeline.STAGES[-1][1](spark, odd, root).count() == 1
    edge_docs.limit(0).write.mode("overwrite").parquet(f"{root}/documents.parquet")
    assert corpus_pipeline.run(spark, root).count() == 0
