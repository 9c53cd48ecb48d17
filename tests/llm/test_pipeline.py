import corpus_pipeline
from tests.llm.fixtures import COLUMNS, frame, prose


def test_stages_on_a_small_corpus(spark, tmp_path):
    passage = prose(70, 1)
    texts = [prose(150, 10 + k) for k in range(40)]
    texts[5] = texts[4].upper()
    texts[8] = prose(60, 60) + " " + passage
    texts[9] = passage + " " + prose(50, 61)
    for k in range(20, 40):
        texts[k] += " scoundrel nitwit wretch"
    more = [prose(80, 500 + k) for k in range(60)]  # a word counts as toxic only if enough clean texts lack it
    docs = frame(spark, texts + [None, ""] + more)
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, int(20 <= i < 40)) for i in range(102)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = now.columns
        now = stage(spark, now, str(tmp_path))
        assert now.columns == before
        kept[name] = {r["doc_id"]: r["text"] for r in now.collect()}
    assert set(kept["toxicity"]) == set(range(20)) | set(range(40, 102))
    assert set(kept["exact_dedup"]) == set(kept["toxicity"]) - {4, 40}
    assert {0, 1, 8, 9} <= set(kept["near_dedup"])
    assert passage in kept["substring_dedup"][8] and passage not in kept["substring_dedup"][9]
    pieces = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in pieces.collect()} == set(kept["substring_dedup"])
    assert COLUMNS and corpus_pipeline.ORACLE_SQL is None
