import gc
import os

import numpy as np
import psutil
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext

from emberloom.llm import decontaminate, langid, packing, simhash, suffix_dedup


def steps_of(build, docs, monkeypatch):
    """The functions that build gives to mapInArrow."""
    found, plain = [], type(docs).mapInArrow
    with monkeypatch.context() as patch:
        patch.setattr(type(docs), "mapInArrow", lambda self, step, *a, **b: found.append(step) or plain(self, step, *a, **b))
        build(docs)
    return found


def test_workers_keep_nothing_for_other_operators(spark, monkeypatch):
    """A worker serves the pipeline's stages one after the other: what one stage keeps from task to task goes with the next stage's first task."""
    docs = spark.createDataFrame([(1, "some words in english", "en")], "doc_id bigint, text string, lang string")
    model = langid.fit(docs)
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["some words in english"]), pa.array(["en"])], names=["doc_id", "text", "lang"])

    def alive(kind):
        gc.collect()
        return sum(isinstance(x, kind) for x in gc.get_objects())

    (other,) = steps_of(simhash.fingerprints, docs, monkeypatch)
    (accepted,) = steps_of(lambda d: langid.accepted(d, model), docs, monkeypatch)
    assert [b.num_rows for b in accepted([batch])] == [1] and alive(langid.Labeller) == 1
    assert [b.num_rows for b in accepted([batch])] == [1] and alive(langid.Labeller) == 1  # kept for the operator's own next task
    assert [b.num_rows for b in other([batch.select(["doc_id", "text"])])] == [1] and not alive(langid.Labeller)
    packing.encoder(public_tokenizers.path("byte_bpe_50k.json"), 0).encode(["some words"])
    assert alive(packing.Encoder) == 1
    monkeypatch.setattr(TaskContext, "get", lambda: type("Task", (), {"partitionId": lambda self: 0})())
    for build in (decontaminate.build_index, suffix_dedup.repeated_substrings):
        packing.encoder(public_tokenizers.path("byte_bpe_50k.json"), 0)
        list(steps_of(build, docs, monkeypatch)[0]([]))
        assert not alive(packing.Encoder)


def test_workers_give_freed_memory_back():
    """Allocators keep what is freed below what is still in use; a step's end hands it back to the system."""
    from emberloom.llm.common import frugal

    pins = []

    def step(batches):
        for _ in batches:
            made = [np.ones(2_500) for _ in range(15_000)]  # 300 MB in pieces below the size that the allocator maps by itself
            pins.extend(made[::50])
            yield len(made)

    me = psutil.Process(os.getpid())
    before = me.memory_info().rss
    assert list(frugal(step)([0])) == [15_000]
    assert me.memory_info().rss - before < 100e6
