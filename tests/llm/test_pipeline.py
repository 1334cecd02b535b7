import random

import corpus_pipeline
from spindle.llm import common


def table(spark, path):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 6)))
    docs, labels = [], []
    for i in range(160):
        text = ". ".join(" ".join(word() for _ in range(12)).capitalize() for _ in range(6)) + "."
        good = i % 4 != 0
        if not good:
            text = text.upper().replace(" ", "!! ")
        elif i % 10 == 1:
            text += " password=hunter22hunter"
        docs.append((i, text, "en", f"s{i % 5}", len(text)))
        labels.append((i, int(good), 0))
    docs += [(200, docs[1][1], "en", "s0", docs[1][4]), (201, docs[1][1] + " extra", "en", "s1", docs[1][4] + 6), (202, None, None, None, None), (202, None, None, None, None), (203, "", "en", "s1", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return docs


def test_stages(spark, tmp_path):
    sf = str(tmp_path)
    docs = table(spark, sf)
    now = common.read_table(spark, sf, "documents")
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, sf)
        out.write.parquet(f"{sf}/out{k}")
        seen[name] = spark.read.parquet(f"{sf}/out{k}")
        if k < 4:
            assert seen[name].columns == now.columns
        now = seen[name]
    ids = {n: [r["doc_id"] for r in d.select("doc_id").collect()] for n, d in seen.items()}
    good = ids["quality_classifier"]
    assert all(i in good for i, *_ in docs[:160] if i % 4) and not any(i in good for i in range(0, 160, 4))
    one = ids["near_duplicates"]
    assert 201 in one and 200 not in one and 1 not in one  # the largest of the three stays
    assert len(one) == len(set(one)) and set(one) >= {i for i in range(160) if i % 4} - {1}
    texts = {r["doc_id"]: r for r in seen["secret_scans"].collect()}
    assert set(texts) == set(one) and "<secret>" in texts[201]["text"] and "hunter22" not in texts[201]["text"] and texts[201]["n_chars"] == len(texts[201]["text"])
    assert set(ids["mixing"]) <= set(one) and set(ids["packing"]) == set(ids["mixing"])
    again = corpus_pipeline.run(spark, sf).collect()
    assert sorted(map(str, again)) == sorted(map(str, seen["packing"].collect()))


def test_empty_table(spark, tmp_path):
    sf = str(tmp_path)
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    assert corpus_pipeline.run(spark, sf).count() == 0
