import corpus_pipeline

from .conftest import SCHEMA, prose, row


def test_stages(spark, tmp_path, rows):
    copy, bench = prose(5, 120), prose(6, 40)
    own = rows + [row(500, copy), row(501, copy), row(502, prose(7, 60) + " " + bench), row(503, prose(8, 200) + " token = abcdef0123456789xyz")]
    spark.createDataFrame(own, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near-duplicates", "benchmark decontamination", "secret scans", "packing"]
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append(docs)
        if k < 4:
            assert docs.columns == kept[0].columns
    ids = [{r.doc_id for r in d.select("doc_id").collect()} for d in kept]
    assert 200 not in ids[0] and {500, 501, 502, 503} <= ids[0]
    assert 500 in ids[1] and 501 not in ids[1]
    assert 502 in ids[1] and 502 not in ids[2]
    assert kept[3].where("doc_id = 503").first().text.endswith("token = <assign>")
    assert ids[4] == ids[3]
    run = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(str, run.collect())) == sorted(map(str, docs.collect()))


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
