import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from emberloom.llm import packing, token_count

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


def odd_texts(n=300):
    rng = random.Random(5)
    signs = list("aeéß тя漢字😀 \n\t  '.,-019") + ["  ", "'s", " the", "ing", "<|endoftext|>", "\x1c", "́", "ĉ", "𖺠"]
    return ["".join(rng.choices(signs, k=rng.randint(0, 60))) for _ in range(n)] + ["", " ", "  ", "a" * 5000, "ab" * 3000, "\n" * 999, "word " * 4000]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", t, "clash") for i, t in enumerate(odd_texts())] + [(None, None, None, "t", "c"), (9003, "again", "", "", ""), (9003, "again", "", "", "")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, n_tokens string, seq string").repartition(3)


def test_counts_are_the_librarys(docs):
    want = {}
    for r in docs.collect():
        want.setdefault((r["doc_id"], r["text"]), []).append(r)
    got = sorted(((r["doc_id"] if r["doc_id"] is not None else -1, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_count.token_counts(docs, PATH).collect()))
    expected = []
    for r in docs.collect():
        n = len(LIBRARY.encode(r["text"] or "", add_special_tokens=False).ids)
        expected.append((r["doc_id"] if r["doc_id"] is not None else -1, len((r["text"] or "").encode()), n, n > 1024))
    assert got == sorted(expected)


def test_pieces_cover_each_document_once(docs):
    got = packing.pack(docs, PATH).collect()
    texts = {}
    for r in docs.collect():
        texts.setdefault(r["doc_id"], []).append(r["text"] or "")
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(texts)
    for doc, pieces in by_doc.items():
        ids = np.array(LIBRARY.encode(texts[doc][0], add_special_tokens=False).ids + [0], "<u4")
        pieces.sort(key=lambda r: r["start"])
        step = len(texts[doc])
        for k in range(0, len(pieces)):
            r = pieces[k]
            assert r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
        assert sum(r["length"] for r in pieces) == step * len(ids)
    short = 0
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= 1024
        short += at < 1024
    assert short <= 1


def test_nothing_to_pack_or_count(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert packing.pack(none, PATH).count() == 0
    assert token_count.token_counts(none, PATH).count() == 0


def test_rank_synchronous_merging_equals_one_by_one(spark):
    from emberloom.llm.tokens import MergeTable, count_symbols

    table = MergeTable(PATH)
    rng = random.Random(1)
    words = ["".join(rng.choices("aeinthrsĠ", k=rng.randint(1, 25))) for _ in range(400)] + ["aaaaaaa", "a" * 64]
    rank = dict(zip(table.keys.tolist(), table.ranks.tolist(), strict=True))
    for word, n in zip(words, count_symbols(words, table), strict=True):
        own = [table.symbol[c] for c in word]
        while True:
            options = [(rank[a * table.base + b], i) for i, (a, b) in enumerate(zip(own, own[1:])) if a * table.base + b in rank]
            if not options:
                break
            r, i = min(options)
            own[i : i + 2] = [int(table.made[r])]
        assert len(own) == n


def other_file(tmp_path, change):
    import json

    with open(PATH, encoding="utf-8") as f:
        spec = json.load(f)
    change(spec)
    path = tmp_path / "other.json"
    path.write_text(json.dumps(spec))
    return str(path)


def test_files_of_another_kind_go_to_their_library(spark, tmp_path):
    def swap(spec):  # ids no longer stand in the order of the merges
        vocab = spec["model"]["vocab"]
        a, b = sorted(vocab, key=vocab.get)[300], sorted(vocab, key=vocab.get)[40_000]
        vocab[a], vocab[b] = vocab[b], vocab[a]

    def whole(spec):  # another pre-tokenizer: pieces reach over blanks
        spec["pre_tokenizer"] = {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": False}

    assert packing.Encoder(PATH).by_ranks and token_count.Counter(PATH).table.plain
    for k, (change, plain) in enumerate(((swap, True), (whole, False))):
        (tmp_path / str(k)).mkdir()
        path = other_file(tmp_path / str(k), change)
        library, own, counter = Tokenizer.from_file(path), packing.Encoder(path), token_count.Counter(path)
        assert not own.by_ranks and counter.table.plain == plain
        texts = odd_texts(40)
        want = [library.encode(t, add_special_tokens=False).ids for t in texts]
        assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == [[*ids, 0] for ids in want]
        assert counter.counts(texts) == [len(ids) for ids in want]
