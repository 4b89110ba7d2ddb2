import corpus_pipeline
from setloom.llm.common import table


def test_stages_keep_columns_and_clean_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf_dir)
        assert after.columns == docs.columns
        n, m = docs.count(), after.count()
        assert n * 0.6 < m <= n, name
        docs = after
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "substring_dedup", "packing"]


def test_run(spark, sf_dir):
    made = corpus_pipeline.run(spark, sf_dir).toPandas()
    assert len(made) and made.groupby("sequence_id").length.sum().max() <= 1024


def test_toxicity_workers_keep_a_bounded_number_of_pieces():
    from setloom.llm import toxicity

    memo = {}
    for i in range(0, 200_000, 1_000):
        toxicity.features(" ".join(f"word{j}" for j in range(i, i + 1_000)), memo)
    assert len(memo) <= 152_000
