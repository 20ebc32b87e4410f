"""The pipeline's join on documents that share a passage."""

import corpus_pipeline

from .test_near_threshold import GROUP, _sharing, tried  # noqa: F401  a fixture


def test_pipeline_keeps_what_shares_a_passage(spark, tried):
    rows = [(i, t, "en", i) for i, t in _sharing()]
    rows += [(GROUP + i, t + " more", "en", GROUP + i) for i, t, *_ in rows[:5]]  # near copies of the first five
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, `we``ird` long")
    got = {tuple(r) for r in corpus_pipeline.one_of_each_group(spark, docs, "").collect()}
    assert got == set(rows[:GROUP])
    assert sum(tried[1:]) <= GROUP
