import corpus_pipeline
from tests.llm.conftest import prose


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    line = "this passage of more than forty code points is in many documents"
    rows = [(i, prose(i, 60) + (f"\n{line}" if i < 20 else ""), "en", f"s{i % 3}", 1) for i in range(60)]
    rows += [(100 + i, rows[30 + i][1] + " tail", "en", "s0", 1) for i in range(5)] + [(200, None, "en", "s1", 0), (201, "12", "en", "s1", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    seen = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, seen[-1], str(tmp_path))
        if i < 4:
            assert out.columns == docs.columns
            out.write.parquet(f"{tmp_path}/{i}.parquet")
            out = spark.read.parquet(f"{tmp_path}/{i}.parquet")
        seen.append(out)
    ids = [sorted(r.doc_id for r in s.select("doc_id").collect()) for s in seen]
    assert set(ids[0]) - set(ids[1]) == {200, 201}
    assert ids[2] == ids[1] and seen[2].filter(seen[2].text.contains(line)).count() == 1
    assert set(ids[2]) - set(ids[3]) == {100, 101, 102, 103, 104}
    assert set(ids[4]) <= set(ids[3]) and set(ids[5]) == set(ids[4])
    again = corpus_pipeline.run(spark, str(tmp_path))
    key = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert sum(r.length for r in again.select(key).collect()) == sum(r.length for r in seen[5].select(key).collect())
