"""What the corpus queries leave in the shared folder."""

import os

import pytest

pytest.importorskip("rasterloom.llm")

from rasterloom import storage
from rasterloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
#: Tables that a returned plan still reads, so that they stay.
STAY = {"op11_embeddings": 1, "op12_whitening": 0, "op13_trie": 1, "whitening_scatter": 0, "op1_decontamination": 0, "op2_quality": 0, "op3_substring_dedup": 2, "op4_langid": 0, "op5_urls": 1, "op6_pieces": 0, "op7_resharding": 1, "op8_minhash": 2, "op9_pii": 0, "op10_line_dedup": 1, "reshard_rewrite": 1}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(STAY))
def test_only_what_the_result_reads_stays(spark, name):
    before = set(storage.live())
    rows = QUERIES[name](spark, SF).collect()
    assert rows and len(set(storage.live()) - before) == STAY[name]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_the_pipeline_leaves_the_last_stage_alone(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    before = set(storage.live())
    assert pipeline.run(spark, SF).count() > 0
    assert len(set(storage.live()) - before) == 1


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_the_rewrite_writes_what_the_plan_says(spark):
    placed = QUERIES["op7_resharding"](spark, SF).collect()
    by = {}
    for r in placed:
        n, size = by.get(r.shard, (0, 0))
        by[r.shard] = (n + 1, size + r.size)
    written = {r.shard: (r.n_rows, r.n_bytes) for r in QUERIES["reshard_rewrite"](spark, SF).collect()}
    assert len(written) > 1 and written == {j: by[j] for j in written}


def test_all_queries_are_covered():
    assert set(STAY) == set(QUERIES)


def test_a_folder_of_one_machine_is_refused_on_a_cluster(monkeypatch):
    class Conf:
        def __init__(self, **held):
            self.held = held

        def get(self, key, default=None):
            return self.held.get(key, default)

    class Session:
        pass

    session = Session()
    session.conf = Conf(**{"spark.master": "spark://host:7077"})
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        storage.shared_dir(session)
    session.conf = Conf(**{"spark.master": "yarn", "spark.checkpoint.dir": "hdfs:///shared/"})
    assert storage.shared_dir(session) == "hdfs:///shared"
