"""The pipeline's first stage: what it rejects is what the classifier rejects, and nothing where there is no classifier."""

import pytest

from corpuslens.llm import quality
from corpuslens.llm.common import ship

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("labels", [[], [(99, 1)], [(1, None), (2, 7)], [(1, 0), (1, 1)], [(None, 1)]])
def test_without_a_clear_label_all_documents_stay(spark, tmp_path, labels):
    import corpus_pipeline as P

    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame([(1, "good words here", "en", "s", 15), (2, "", "en", "s", 0), (None, None, None, None, None), (1, "good words here", "en", "s", 15)], DOCS)
    assert sorted(map(str, P.keep_good(ship(spark), docs, str(tmp_path)).collect())) == sorted(map(str, docs.collect()))


def test_rejected_documents_are_those_that_the_classifier_rejects(spark):
    import corpus_pipeline as P

    sf = "/root/testdata/sf0.001"
    docs = ship(spark).read.parquet(f"{sf}/documents.parquet")
    scored = {r.doc_id: r.predicted for r in quality.score(docs, spark.read.parquet(f"{sf}/labels.parquet")).collect()}
    kept = {tuple(r) for r in P.keep_good(spark, docs, sf).collect()}
    assert kept == {tuple(r) for r in docs.collect() if scored[r.doc_id] == 1}
    assert 0 < len(kept) < len(scored)
