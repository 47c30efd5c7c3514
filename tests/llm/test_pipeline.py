"""The pipeline's stages on a small corpus with planted cases."""

import corpus_pipeline
from knotwork.llm import queries

from .helpers import prose


def test_stages_do_what_they_say(spark, tmp_path):
    bench = prose(77, 30)
    copy = prose(205, 60)
    rows = [(i, prose(i, 50), "en", "s", 0) for i in range(40)]
    rows += [(100, copy + " tail", "en", "s", 0), (101, copy, "en", None, 0), (102, "123 456", "en", "s", 0), (103, None, None, None, None), (104, f"{prose(8, 20)} {bench} {prose(9, 20)}", "en", "s", 0), (105, prose(6, 30) + " password=abcdef1234 end", None, "s", 0)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, bench)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns
        seen.append({r["doc_id"]: r["text"] for r in docs.collect()})
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    everything = {r[0] for r in rows}
    assert set(seen[0]) == everything - {102, 103}
    assert set(seen[1]) == set(seen[0]) - {101}
    assert set(seen[2]) == set(seen[1]) - {104}
    assert set(seen[3]) == set(seen[2])
    assert seen[3][105] == prose(6, 30) + " [secret] end"
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in packed} == set(seen[3])


def test_queries_are_named_as_agreed():
    names = list(queries.queries())
    assert {n.split("_")[0] for n in names} == {f"op{i}" for i in range(1, 11)}
    assert len(names) == 10
    assert set(queries.oracle_sql()) <= set(names)
