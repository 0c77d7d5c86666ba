import random

from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_llm import docs, prose


def test_stages(spark, tmp_path):
    rng = random.Random(3)
    item = "A train leaves at 14 and runs 90 km to Lisbon and then it goes back to Porto with 3 more stops"
    base = [prose(rng, "en", 60) for _ in range(60)]
    texts = [b if i % 3 else b + " zorgle grumwit zorgle" for i, b in enumerate(base)]
    near = base[1].split()
    near[7] = "changed"
    texts += [" ".join(near), base[4] + ". " + item, prose(rng, "de", 50) + " write to me@example.org now", None, "", base[7], base[7]]
    table = docs(spark, texts)
    for name in ("row_key", "gone", "tox_score", "marks", "k"):  # names that the stages use themselves
        table = table.withColumn(name, F.lit(name))
    d = str(tmp_path)
    table.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 0, int(i % 3 == 0)) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    now, kept = spark.read.parquet(f"{d}/documents.parquet"), []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, d).write.parquet(f"{d}/{i}")
        now = spark.read.parquet(f"{d}/{i}")
        kept.append({r["doc_id"] for r in now.select("doc_id").collect()})
        if name != "mixing":
            assert now.columns == table.columns and now.filter("row_key != 'row_key' or tox_score != 'tox_score'").count() == 0
    toxic = {i for i in range(60) if i % 3 == 0}
    assert not kept[0] & toxic and len(kept[0]) == len(texts) - len(toxic)
    assert kept[0] - kept[1] == {60, 65, 66}
    assert kept[1] - kept[2] == {61}
    assert kept[3] == kept[2]
    clean = spark.read.parquet(f"{d}/3").filter("doc_id = 62").first()
    assert "[EMAIL]" in clean["text"] and clean["n_chars"] == len(clean["text"])
    assert kept[4] <= kept[3] and now.filter("taken <= 0").count() == 0
    assert corpus_pipeline.run(spark, d).select(F.sum("taken")).first()[0] == now.select(F.sum("taken")).first()[0]


def test_empty_tables(spark, tmp_path):
    d, none = str(tmp_path), docs(spark, [])
    none.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    assert corpus_pipeline.run(spark, d).count() == 0
