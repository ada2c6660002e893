import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from codequarry.llm.common import crc_mod

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture
def folder(spark, tmp_path):
    words = [f"w{k}" for k in range(300)]
    item = " ".join(words[:15])
    texts = [" ".join(words[k : k + 40]) for k in range(0, 240, 40)]
    texts += [texts[0], texts[0] + " more", texts[1].replace("w60", "moron idiot"), f"intro {item} outro", "write to a@b.org today please", None, ""]
    train = [(100 + i, ("moron idiot " if i % 2 else "") + " ".join(f"v{(i * 7 + k) % 900}" for k in range(30)), "en", "s", 1) for i in range(120)]
    rows = [(i, t, "en", "s", len(t) if t else 0) for i, t in enumerate(texts)] + train
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 2)) for i in range(100, 220)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/out-{k}")
        docs = spark.read.parquet(f"{tmp_path}/out-{k}")
        kept.append({r.doc_id: r for r in docs.collect()})
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == COLUMNS
    toxic, near, clean, private, ids = kept
    assert 8 not in toxic and all(i % 2 == 0 for i in toxic if i >= 100) and {0, 1, 11, 12} <= set(toxic)
    assert 6 not in near and 7 not in near and {0, 11, 12} <= set(near)
    assert clean[9].text == "intro  outro" and clean[9].n_chars == 12 and clean[1].text == near[1].text
    assert private[10].text == "write to <EMAIL> today please"
    assert set(ids) == set(private) and ids[12].n_tokens == 0
    assert docs.where(crc_mod(F.col("doc_id"), 3).isNull()).count() == 0


def test_run_is_the_stages(spark, folder):
    assert corpus_pipeline.run(spark, folder).count() > 10


def test_near_duplicates_of_the_stage(spark, tmp_path):
    words = [f"w{k}" for k in range(1000)]
    texts = [" ".join(words), " ".join([*words, *(f"x{k}" for k in range(200))]), " ".join(f"y{k}" for k in range(300))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2]
