import hashlib
import io
import random

import numpy as np
import pytest

from emberloom.llm import suffix_dedup as sd


def brute(rows, length=50):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        i = sd.LAST_ID if i is None else i
        for k in range(len(b) - length + 1):
            w = b[k : k + length]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        me = sd.LAST_ID if i is None else i
        gone = np.zeros(len(b) + 2, bool)
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] < me:
                gone[k + 1 : k + 1 + length] = True
        kept = bytes(x for x, g in zip(b, gone[1:]) if not g)
        out.append((str(i), len(b), int(gone.sum()), int((np.diff(gone.astype(int)) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def corpus():
    rng = random.Random(4)
    words = ["the", "of", "and", "é", "漢字", "tion", "x" * 30, "\0\0", "ab"]
    passages = [" ".join(rng.choices(words, k=rng.randint(15, 60))) for _ in range(6)]
    rows = []
    for i in range(140):
        parts = [" ".join(rng.choices(words, k=rng.randint(0, 50)))]
        for _ in range(rng.randint(0, 2)):
            p = rng.choice(passages)
            lo = rng.randint(0, len(p) // 2)
            parts += [p[lo : lo + rng.randint(40, 200)], "".join(rng.choices("abcdefgh ", k=rng.randint(0, 80)))]
        rows.append((i * 13 % 149, "".join(parts)))
    rows += [(500, None), (501, ""), (502, "a" * 400), (503, "a" * 51), (504, "ab" * 200), (505, "xab" * 40), (506, "a" * 49), (507, passages[0])]
    return rows


@pytest.mark.parametrize("extra", [[], [(600, "z" * 60 + "tail one"), (600, "z" * 60 + "tail one"), (600, "other " * 20 + "z" * 60), (None, "z" * 70), (None, "z" * 70)]])
def test_against_brute_force(spark, monkeypatch, extra):
    rows = corpus() + extra
    docs = spark.createDataFrame([(*r, "c", 1) for r in rows], "doc_id bigint, text string, blob string, range int").repartition(3)
    assert sorted((str(r[0]), *r[1:]) for r in sd.digest(sd.repeated_substrings(docs)).collect()) == brute(rows)


def test_many_small_runs_and_blocks(monkeypatch):
    rows = corpus()
    import pyarrow as pa

    monkeypatch.setattr(sd, "BLOCK", 97)
    monkeypatch.setattr(sd, "PASS_WINDOWS", 50)
    ranges, runs, grams = 3, [], {}
    for k in range(0, len(rows), 9):
        own = rows[k : k + 9]
        sink = io.BytesIO()
        batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in own]), pa.array([t for _, t in own], pa.string())], names=["doc_id", "text"])
        with pa.ipc.new_stream(sink, batch.schema) as out:
            out.write_batch(batch)
        runs.append(sd.Run(sink.getvalue(), 50))
        for r, blob in sd._grams(runs[-1], ranges):
            grams.setdefault(r, []).append((len(runs) - 1, blob))
    flags = {}
    for r, own in grams.items():
        for (k, _), bits in zip(own, sd._repeated([b for _, b in own])):
            flags.setdefault(k, []).append((r, bits))
    pieces, places = {}, {}
    for k, run in enumerate(runs):
        made, places[k] = sd._sorted_run(run, flags.get(k, []), ranges)
        for r, blob in made:
            pieces.setdefault(r, []).append((k, blob))
    assert max(map(len, pieces.values())) > 8
    found = {}
    for own in pieces.values():
        merged = sd.merge_range([b for _, b in own])
        for i, (k, _) in enumerate(own):
            found.setdefault(k, []).append(merged.blob(i))
    got = {}
    for k, run in enumerate(runs):
        gone = sd.removals(run, places[k], found.get(k, []))
        got |= {i: sum(b - a for a, b in gone.get(d, [])) for d, i in enumerate(run.ids.tolist())}
    assert got == {int(i): n for i, _, n, _, _ in brute(rows)}


def test_loser_tree_merges_with_right_common_prefixes():
    import os

    rng = random.Random(6)
    for n in (0, 1, 2, 3, 5, 8, 13):
        runs = []
        for _ in range(n):
            keys = sorted({bytes(rng.choices(b"ab\0", k=rng.randint(1, 12))) for _ in range(rng.randint(0, 40))})
            shared, rest = sd.front_code(keys)
            assert sd.front_decode(shared.tobytes(), rest.tobytes(), sd.rests(keys, shared)) == keys
            runs.append((keys, shared.tobytes()))
        got = [(runs[r][0][i], c) for r, i, c in sd.merge(runs)] if runs else []
        want = sorted(k for keys, _ in runs for k in keys)
        assert [k for k, _ in got] == want
        assert [c for _, c in got[1:]] == [len(os.path.commonprefix([a, b])) for a, b in zip(want, want[1:])]


def test_kept_text_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "é" * 40), (2, "x" + "é" * 40 + "y")], "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in sd.repeated_substrings(docs, with_text=True).collect()}
    assert got[1]["kept"] == "é" * 40 and got[2]["kept"] == "xy" and [tuple(s) for s in got[2]["removed"]] == [(1, 81)]
    assert sd.repeated_substrings(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
