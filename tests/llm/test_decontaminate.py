import random

from emberloom.llm import decontaminate as dc


def brute(text, items):
    own = dc.words(text)
    hit, found = set(), set()
    for name, item in items:
        w = dc.words(item)
        size = min(10, len(w))
        for k in range(max(1, len(w) - size + 1)) if w else ():
            for i in range(len(own) - size + 1):
                if own[i : i + size] == w[k : k + size]:
                    hit.update(range(i, i + size))
                    found.add(name)
    return len(own), len(hit), len(found), dc.sha256_of_items([x for x in found if x is not None]), bool(hit)


def tables(spark):
    rng = random.Random(2)
    vocab = ["the", "of", "É", "a b", "x1", "Zed", "漢"]
    items = [("10", " ".join(rng.choices(vocab, k=25))), ("9", "short one"), ("b", "the the the the the the the the the the the"), ("n", None), ("e", "!!"), (None, "of of of")]
    docs = []
    for i in range(120):
        text = " ".join(rng.choices(vocab, k=rng.randint(0, 60)))
        if i % 4 == 0:
            w = items[0][1].split(" ")
            lo = rng.randint(0, 12)
            text += ", " + "\n".join(w[lo : lo + rng.randint(8, 14)]) + " end"
        if i % 5 == 0:
            text += " SHORT one" + " the" * rng.randint(0, 14)
        docs.append((i, text, "clash", "c"))
    docs += [(200, None, "", ""), (201, "", "", ""), (202, "?", "", ""), (7, "short  one", "", ""), (7, "short  one", "", ""), (None, "short one", None, None)]
    return spark.createDataFrame(docs, "doc_id bigint, text string, item_id string, shard string").repartition(3), items


def test_against_brute_force(spark, monkeypatch):
    docs, items = tables(spark)
    bench = spark.createDataFrame(items, "item_id string, text string")
    want = sorted((str(r["doc_id"]), *brute(r["text"], items)) for r in docs.collect())
    for chars in (dc.BLOCK_CHARS, 60):  # one block, several blocks
        monkeypatch.setattr(dc.test_blocks, "__defaults__", ("item_id", "text", chars))
        got = dc.digest(dc.contamination(docs, bench)).collect()
        assert sorted((str(r[0]), *r[1:]) for r in got) == want


def test_many_candidates_are_cut_into_chunks(spark, monkeypatch):
    docs, items = tables(spark)
    tests = dc.TestWindows([(name, dc.words(text)) for name, text in items])
    index = dc.build_index(docs)
    tests.rank(dc.term_frequency(index, tests.terms))
    row = index.collect()[-1].asDict()
    row["terms"] = [bytes(t) for t in row["terms"]]
    found = {}
    for limit in (3, 10**6):
        monkeypatch.setattr(dc, "CANDIDATES", limit)
        shard = dc._Shard(row, tests.terms)
        found[limit] = sorted((int(a), int(b)) for w, _, _, o, p in tests.by_length for x in shard.phrase_starts(w, o) for a, b in zip(*x))
    assert found[3] == found[10**6] and found[3]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    no_bench = spark.createDataFrame([], "item_id string, text string")
    docs = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    assert dc.contamination(none, no_bench).count() == 0
    assert [tuple(r) for r in dc.digest(dc.contamination(docs, no_bench)).collect()] == [(1, 2, 0, 0, dc.sha256_of_items([]), False)]


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "z b filler a c"), (2, "a " + "x " * 50 + "b c"), (3, None)], "doc_id bigint, text string")
    bench = spark.createDataFrame([("i", "a b c")], "item_id string, text string")
    got = dc.proximity_matches(dc.build_index(docs), bench, span=5).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(1, "i")}


def test_items_without_an_id_contaminate(spark):
    import duckdb

    documents = [(1, "x of of of y"), (2, "short one"), (3, "clean"), (4, "of of of and short one and other words")]
    benchmark = [(None, "of of of"), (None, "other words"), ("a", "short one")]
    got = dc.digest(dc.contamination(spark.createDataFrame(documents, "doc_id bigint, text string"), spark.createDataFrame(benchmark, "item_id string, text string"))).collect()
    a, none = dc.sha256_of_items(["a"]), dc.sha256_of_items([])
    want = [(1, 5, 3, 1, none, True), (2, 2, 2, 1, a, True), (3, 1, 0, 0, none, False), (4, 9, 7, 2, a, True)]
    assert sorted(tuple(r) for r in got) == want
    con = duckdb.connect()
    for name, key, kind, rows in (("documents", "doc_id", "BIGINT", documents), ("benchmark", "item_id", "VARCHAR", benchmark)):
        con.execute(f"create table {name} ({key} {kind}, text VARCHAR)")
        con.executemany(f"insert into {name} values (?, ?)", rows)
    assert sorted(con.sql(dc.ORACLE).fetchall()) == want


def test_very_long_text_and_benchmark(spark):
    rng = random.Random(4)
    own = [f"w{rng.randint(0, 5000)}" for _ in range(300_000)]
    lo = 123_456
    docs = spark.createDataFrame([(1, " ".join(own)), (2, "w1 w2")], "doc_id bigint, text string")
    bench = spark.createDataFrame([("long", " ".join(own[lo : lo + 2_000])), ("gone", "no such words here")], "item_id string, text string")
    got = {r["doc_id"]: r for r in dc.digest(dc.contamination(docs, bench)).collect()}
    assert (got[1]["n_words"], got[1]["n_hit"], got[1]["n_items"]) == (300_000, 2_000, 1) and not got[2]["contaminated"]


def test_index_rows_and_row_groups_stay_small(spark):
    """What a task holds at once doesn't follow its partition: 1.4 million words lie in several shards, each in a row group of its own."""
    import pyarrow.parquet as pq

    rng = random.Random(5)
    vocab = [f"w{k}" for k in range(20_000)]
    docs = spark.createDataFrame([(i, " ".join(rng.choices(vocab, k=20_000))) for i in range(70)], "doc_id bigint, text string").coalesce(1)
    index = dc.build_index(docs)
    files = sorted({f.removeprefix("file:").replace("///", "/") for f in index.inputFiles()})
    groups = [pq.ParquetFile(f).metadata.row_group(k) for f in files for k in range(pq.ParquetFile(f).metadata.num_row_groups)]
    assert sum(g.num_rows for g in groups) == index.count() >= 3
    assert max(g.total_byte_size for g in groups) < 2 * dc.GROUP_BYTES
    assert index.selectExpr("max(length(positions)) n").first()["n"] < 4 * (dc.SHARD_WORDS + 20_001)
