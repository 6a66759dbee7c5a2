import corpus_pipeline
from tests.llm import cases
from tests.llm.test_bpe_codec import expected
from tests.llm.test_decontamination import brute as contaminated
from tests.llm.test_exact_dedup import brute as copies
from tests.llm.test_jaccard_join import brute as components
from tidemark.llm import toxicity


def test_stages_equal_brute_force_on_what_they_are_given(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    given = [(r.doc_id, r.text) for r in docs.collect()]
    score = toxicity.learn(docs, spark.read.parquet(f"{tiny}/labels.parquet")).scorer()
    kept = [(i, t) for i, t in given if score(t) < 0.7]
    stay = {k for _, k, _ in copies(kept)}
    kept = [(i, t) for i, t in kept if i in stay]
    stay = {c for _, _, c in components(kept)}
    kept = [(i, t) for i, t in kept if i in stay]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{tiny}/benchmark.parquet").collect()]
    clean = {d for d, *_, bad in contaminated(kept, items) if not bad}
    found = corpus_pipeline.run(spark, tiny)
    assert cases.rows(found, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(((i, *expected(t)) for i, t in kept if i in clean), key=repr)


def test_all_stages_but_the_last_return_the_columns_of_documents(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, tiny).columns == docs.columns
