import zlib

import numpy as np
import public_tokenizers
import test_decontaminate
import test_simhash
import test_suffix_dedup
from tokenizers import Tokenizer

import corpus_pipeline as cp
from emberloom.llm import langid

SF = "/root/testdata/sf0.001"


def removed_text(rows):
    first = {}
    for i, t in rows:
        b = t.encode()
        for k in range(len(b) - 49):
            first[b[k : k + 50]] = min(first.get(b[k : k + 50], i), i)
    out = {}
    for i, t in rows:
        b = t.encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < i:
                gone[k : k + 50] = b"\1" * 50
        out[i] = bytes(x for x, g in zip(b, gone) if not g).decode("utf-8", "ignore")
    return out


def test_run_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs.where(~langid.is_held_out()))
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    rows = [(i, t) for (i, t), (lang, score, _) in zip(rows, langid.Labeller(model).label([t for _, t in rows])) if lang != "und" and score >= 0.5]
    roots = test_simhash.brute_components([i for i, _ in rows], [test_simhash.brute_fingerprint(t) for _, t in rows])
    rows = [(i, t) for (i, t), root in zip(rows, roots) if i == root]
    rows = [(i, t) for i, t in removed_text(rows).items() if t]
    items = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = [(i, t) for i, t in rows if not test_decontaminate.brute(t, items)[-1]]
    assert 20 < len(rows) < docs.count()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: np.array([*library.encode(t, add_special_tokens=False).ids, 0], "<u4") for i, t in rows}
    got = {}
    for r in cp.run(spark, SF).collect():
        ids = want[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(ids.tobytes())
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
    assert got == {i: len(x) for i, x in want.items()}


def test_odd_rows_pass_every_stage(spark):
    docs = spark.createDataFrame(
        [(1, "the thing with this and that " * 5, "en", "s", 1), (1, "the thing with this and that " * 5, "en", "s", 1), (None, None, None, None, None), (3, "", "en", "s", 0)],
        "doc_id bigint, text string, lang string, source string, n_chars bigint",
    )
    for frame, n in ((docs, 2), (docs.limit(0), 0)):
        for _, stage in cp.STAGES[:-1]:
            out = stage(spark, frame, SF)
            assert out.columns == docs.columns
        assert cp.language(spark, frame, SF).count() == n
        assert cp.packed(spark, frame, SF).select("doc_id").distinct().count() == (3 if n else 0)


def test_entry_survives_without_the_llm_folders():
    import subprocess
    import sys

    code = (
        "import sys\n"
        "class Gone:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name in ('emberloom.llm', 'corpus_pipeline'): raise ModuleNotFoundError(name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "assert 'pipeline' not in e.queries() and not any(n.startswith('op1_') for n in e.queries())\n"
    )
    subprocess.run([sys.executable, "-c", code], check=True)
