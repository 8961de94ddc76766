"""The corpus pipeline's stages against brute force, each on its own input."""

import pytest
from pyspark.sql import functions as F
from tests.llm.fixtures import edge_docs, table
from tests.llm.test_model_ops import base
from tests.llm.test_text_ops import contamination, fingerprint, least_reachable, measures

import corpus_pipeline


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs = table(spark, sf, "documents")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        new = corpus_pipeline.materialise(stage(spark, docs, sf), name)
        out[name] = (docs, new)
        docs = new
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_names_and_columns(stages, spark, sf):
    columns = table(spark, sf, "documents").columns
    assert list(stages) == ["quality", "near_dedup", "decontaminate", "pii", "bpe"]
    assert all(stages[n][1].columns == columns for n in list(stages)[:-1])


def test_quality_drops_what_fails(stages):
    before, after = map(rows, stages["quality"])
    fails = {d for d, r in before.items() if (m := measures(r.text))[0] < 50 or 100 * m[4] > 50 * m[0]}
    assert set(after) == set(before) - fails  # too few labels here for a cutoff: see test_text_ops for those
    assert all(after[d] == before[d] for d in after)


def test_one_of_each_group_stays(stages):
    before, after = map(rows, stages["near_dedup"])
    prints = [(d, fingerprint(r.text)) for d, r in before.items()]
    reach = least_reachable(prints)
    assert set(after) == {d for d, f in prints if reach[f] == d}


def test_defined_cases_of_every_stage(spark, sf):
    """Nulls, empty and long texts, repeated rows and names that operators use inside; and empty tables."""
    names = ["__id", "__row", "own", "stays", "component_id", "fp", "__hits", "__cut", "base", "Spans", "ids", "shard"]
    docs = edge_docs(spark).withColumns({n: F.lit(1) for n in names if n.lower() not in {c.lower() for c in edge_docs(spark).columns}})
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        assert stage(spark, docs.limit(0), sf).count() == 0
        rows = out.collect()
        if name == "bpe":
            assert len(rows) == docs.count()
            continue
        assert out.columns == docs.columns
        if name == "near_dedup":
            ids = [r.doc_id for r in rows]
            assert len(ids) == len(set(ids)) and 0 in ids  # one row of each group, also of rows that repeat an id
            kept = [fingerprint(r.text) for r in rows]
            assert len(kept) == len(set(kept))
        if name in ("pii", "decontaminate"):
            assert [r.text for r in rows if r.doc_id == 0] == [None]


def test_no_benchmark_window_is_left(stages, spark, sf):
    before, after = map(rows, stages["decontaminate"])
    items = [(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()]
    dirty = {k[0] for k in contamination([(d, r.text) for d, r in before.items()], items) if k[5]}
    assert dirty and all(after[d].text == before[d].text for d in set(before) - dirty)
    assert not any(k[5] for k in contamination([(d, after[d].text) for d in dirty & set(after)], items))


def test_personal_data_is_gone(stages):
    before, after = map(rows, stages["pii"])
    assert set(before) == set(after)
    for d, r in before.items():
        if base(r.text):
            assert not base(after[d].text) and after[d].n_chars == len(after[d].text)


def test_run_equals_its_stages(stages, spark, sf):
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).collect())) == sorted(map(tuple, stages["bpe"][1].collect()))
