"""Stages of the corpus pipeline on odd rows, against plain versions."""

from collections import Counter

import corpus_pipeline
import pytest
from palimpsest.llm import source_mix

SCHEMA = "doc_id long, text string, source string, n_chars int, id string, times string, copy string, __copy string, __id string, __times string"
EXTRA = ("a", "b", "c", "d", "e", "f")


@pytest.fixture(scope="module")
def odd(spark):
    texts = ["w " * (5 + i % 60) for i in range(120)] + [None, "", " "]
    rows = [(i, t, [None, "s1", "s2", "s3"][i % 4], len(t or ""), *EXTRA) for i, t in enumerate(texts)]
    rows += [(None, "no id here", "s1", 10, *EXTRA), (3, rows[3][1], "s2", rows[3][3], *EXTRA)]
    return spark.createDataFrame(rows, SCHEMA)


def test_mix_repeats_documents_and_keeps_columns(spark, odd):
    size, taken = Counter(), Counter()
    for r in source_mix.mix(odd).collect():
        size[r["doc_id"]] += r["size"]
        taken[r["doc_id"]] += r["taken"]
    times = {d: int(taken[d] / size[d] + 0.5) for d in taken if taken[d]}
    want = Counter()
    for r in odd.collect():
        if r["doc_id"] in times:
            want[tuple(r)] += times[r["doc_id"]]
    got = corpus_pipeline.mix_sources(spark, odd, "")
    assert got.columns == odd.columns
    assert Counter(map(tuple, got.collect())) == +want and max(times.values()) == 2


def test_mask_counts_characters_again(spark, odd):
    mails = spark.createDataFrame([(1, "mail a.b@c.de now", "s", 17, *EXTRA), (2, "nothing to hide", "s", 15, *EXTRA), (3, None, "s", None, *EXTRA)], SCHEMA)
    got = {r["doc_id"]: r for r in corpus_pipeline.mask_personal_data(spark, mails, "").collect()}
    assert "a.b@c.de" not in got[1]["text"] and got[1]["n_chars"] == len(got[1]["text"])
    assert (got[2]["text"], got[2]["n_chars"]) == ("nothing to hide", 15) and got[3]["n_chars"] is None
    assert all(tuple(r)[4:] == EXTRA for r in got.values())


@pytest.mark.parametrize("stage", ["mask_personal_data", "mix_sources", "tokenize"])
def test_empty_tables(spark, odd, stage):
    assert getattr(corpus_pipeline, stage)(spark, odd.limit(0), "").count() == 0


def test_stages_drop_what_others_left_in_their_workers(spark, odd, monkeypatch):
    """Workers go from stage to stage: what the last one keeps there must not stand beside what the next one needs."""
    from palimpsest.llm import bpe, pii

    monkeypatch.setattr(type(odd), "mapInArrow", lambda self, run, schema: run)
    in_one_process = lambda run: (list(run(iter(()))), bpe.encoder.cache_info().currsize)[1]
    assert in_one_process(bpe.encode(odd)) == 1
    assert in_one_process(bpe.encode(odd)) == 1  # stays from task to task of its own stage
    assert in_one_process(pii.mask(odd)) == 0
