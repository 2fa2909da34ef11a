import random

import public_tokenizers

import corpus_pipeline
from weft.llm import quality_rules, simhash

from .test_operators import check_packing, prose


def test_pipeline(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, prose(rng, "en", 80), "en", "s", 0) for i in range(60)]
    rows += [(100 + i, rows[i][1], "en", "s", 0) for i in range(10)]  # copies
    rows += [(200, None, None, None, 0), (201, "go " * 100, "en", "s", 0), (202, "12 34", "en", "s", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    clean = quality_rules.reject(df.where("text is not null and doc_id <> 202"))
    kept = simhash.deduplicate(clean).collect()
    assert {r.doc_id for r in kept} == set(range(60))
    check_packing(got, [(r.doc_id, r.text) for r in kept], public_tokenizers.path("word_bpe_49k.json"))


def test_stages_keep_columns(spark):
    df = spark.createDataFrame([(1, "a b c", "en", "s", 5)], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, df, "").columns == df.columns
        assert stage(spark, df.where("false"), "").count() == 0


def test_dedup_keeps_one_row_of_each_component(spark):
    """Null ids and ids that several texts share neither cost a component its row nor leave it two."""
    rng = random.Random(5)
    texts = [prose(rng, "en", 200) for _ in range(8)]
    rows = [(None, t) for t in texts[:4]] + [(None, texts[0])]  # four components without ids, one of them twice
    rows += [(7, texts[4]), (7, texts[5]), (3, texts[5])]  # 7 is a text of its own and a copy of 3
    rows += [(9, texts[6]), (9, texts[7]), (None, texts[6]), (9, texts[6])]  # two texts of one id
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = simhash.deduplicate(df).collect()
    want = [(None, t) for t in texts[:4]] + [(7, texts[4]), (3, texts[5]), (9, texts[6]), (9, texts[7])]
    assert sorted((str(r.doc_id), r.text) for r in got) == sorted((str(i), t) for i, t in want)
