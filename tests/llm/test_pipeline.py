"""The corpus pipeline, stage by stage."""

import pytest

import corpus_pipeline as P
from ledgerlake.llm import mixing, sharding, toxicity
from ledgerlake.llm.common import read_table, stored
from ledgerlake.llm.queries import held_out
from test_exact_and_contamination import contaminated_by_hand
from test_similarity_and_substrings import classes_by_hand

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def outputs(spark):
    docs, out = read_table(spark, SF, "documents"), []
    for name, stage in P.STAGES:
        done = stored(stage(spark, docs, SF), f"test-{name}")
        out.append((docs, done))
        docs = done
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_stages_keep_columns(outputs):
    assert [n for n, _ in P.STAGES] == ["toxicity", "jaccard_join", "decontamination", "mixing", "sharding"]
    for docs, done in outputs[:-1]:
        assert done.columns == docs.columns and done.schema == docs.schema
    docs, done = outputs[-1]
    assert done.columns == [*docs.columns, "row_number", "shard", "slot"]


def test_toxicity_stage(spark, outputs):
    docs, done = outputs[0]
    model = toxicity.fit(docs, read_table(spark, SF, "labels").filter(~held_out()))
    assert ids(done) == sorted(r.doc_id for r in docs.collect() if model.score(r.text) < toxicity.CUT)


def test_one_document_of_each_class_stays(outputs):
    docs, done = outputs[1]
    classes = classes_by_hand([(r.doc_id, r.text) for r in docs.collect()])
    assert ids(done) == sorted({c for _, c, _ in classes})


def test_contaminated_documents_go(spark, outputs):
    docs, done = outputs[2]
    items = [(r.item_id, r.text) for r in read_table(spark, SF, "benchmark").collect()]
    hand = contaminated_by_hand([(r.doc_id, r.text) for r in docs.collect()], items)
    assert ids(done) == sorted(d for d, _, n, _ in hand if not n) and len(ids(done)) < docs.count()


def test_mix_and_shards(outputs):
    docs, done = outputs[3]
    assert ids(done) == sorted(r.doc_id for r in mixing.mixed(docs).collect() for _ in range(r.copies))
    docs, done = outputs[4]
    rows = done.collect()
    assert ids(done) == ids(docs) and sorted(r.row_number for r in rows) == list(range(len(rows)))
    assert all((r.shard, r.slot) == sharding.place_of(r.row_number, len(rows), P.N_SHARDS) for r in rows)


def test_run_applies_all_stages(spark, outputs):
    want = sorted((r.doc_id, r.shard, r.slot) for r in outputs[-1][1].collect())
    assert sorted((r.doc_id, r.shard, r.slot) for r in P.run(spark, SF).collect()) == want


def test_pipeline_of_no_documents(spark):
    docs = read_table(spark, SF, "documents").limit(0)
    for _, stage in P.STAGES:
        docs = stored(stage(spark, docs, SF), "none")
    assert docs.count() == 0
