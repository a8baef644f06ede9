"""Encoding against the public encoder and an exact round trip; packing against its own rule and bounds."""

import base64

import numpy as np
import pytest
from pyspark.sql import functions as F

from docspark.llm import packing, tokens


def reference(raw: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("t", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


TEXTS = [
    None, "", " ", "\n\n \t", "It's 3.14, isn't it?  Two  spaces", "<|endoftext|> is text", "中文，标点。", "a\x1cb\x85c d", "👩‍👩‍👧 ́e\U0001d400x", "Привет МИР", "x" * 5000, "word " * 70_000, "same", "same",
]


@pytest.mark.parametrize("name", ["byte_bpe_50k", "byte_bpe_multi_50k"])
def test_ids_equal_the_public_encoder(spark, name):
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(None, "null id", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    got = {r.doc_id: r.ids for r in tokens.encode_corpus(df, tokenizer=name).collect()}
    enc = reference(tokens.read_ranks(tokens.vocabulary_path(name)))
    assert got == {i: enc.encode_ordinary(t or "") for i, t, _ in rows}


def test_small_blocks_and_round_trip(spark, monkeypatch):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string").coalesce(1)
    ids = tokens.encode_corpus(df)
    back = {r.doc_id: r.text for r in tokens.decode_corpus(ids).collect()}
    assert back == {i: t or "" for i, t in enumerate(TEXTS)}


@pytest.mark.parametrize("hot", [0, 1, 50_000])
def test_hot_words_and_counts(spark, monkeypatch, hot):
    monkeypatch.setattr(tokens, "BLOCK_DOCS", 2)
    monkeypatch.setattr(tokens, "HOT_WORDS", hot)
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "null id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    enc = reference(tokens.read_ranks(tokens.vocabulary_path("byte_bpe_50k")))
    want = {i: enc.encode_ordinary(t or "") for i, t in rows}
    assert {r.doc_id: r.ids for r in tokens.encode_corpus(df).collect()} == want
    assert {r.doc_id: r["size"] for r in tokens.token_counts(df).collect()} == {i: len(x) for i, x in want.items()}


def test_items_that_do_not_fit_together_end(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_ITEMS", 20)
    rows = [(i, 60) for i in range(300)]
    got = packing.pack_items(spark.createDataFrame(rows, "doc_id long, size int"), spark.createDataFrame([(1, 100)], "spec_id long, capacity_tokens int")).toPandas()
    assert len(got) == 300 == got.container.nunique()


def test_repeated_ids_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (1, "a")], "doc_id long, text string")
    assert tokens.encode_corpus(df).count() == 3
    assert tokens.encode_corpus(df.filter("false")).count() == 0


def test_blocks_cover_all_positions():
    texts = [["a", "b", "a"], [], ["c"]]
    rows = tokens._block_rows(7, texts, [1, 2, 3])
    codes = np.full(4, -1)
    for i, raw in enumerate(rows["pos"]):
        codes[np.cumsum(np.frombuffer(raw, np.uint16))] = i
    assert [rows["word"][c] for c in codes] == ["a", "b", "a", "c"]
    assert [c for c in rows["doc_counts"] if c] == [[3, 0, 1]]


def brute(sizes, capacity):
    counts, boxes = [0] * (capacity + 1), []
    for s in sizes:
        best, where = None, None
        for level in [*range(capacity - s, 0, -1), 0]:
            if level and not counts[level]:
                continue
            trial = counts[:]
            if level:
                trial[level] -= 1
            if level + s < capacity:
                trial[level + s] += 1
            cost = sum(c * c for c in trial[1:capacity])
            if best is None or cost < best:
                best, where = cost, level
        if where:
            counts[where] -= 1
        if where + s < capacity:
            counts[where + s] += 1
        boxes.append(where)
    return boxes


def test_rule_against_brute_force():
    rng = np.random.default_rng(5)
    for capacity in (5, 12, 30):
        sizes = rng.integers(1, capacity, 60)
        box = packing.sum_of_squares(sizes, capacity)
        fill, levels = {}, []
        for b, s in zip(box.tolist(), sizes.tolist()):
            levels.append(fill.get(b, 0))
            fill[b] = levels[-1] + s
        assert max(fill.values()) <= capacity and levels == brute(sizes.tolist(), capacity)


def test_packing(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_ITEMS", 200)
    rng = np.random.default_rng(6)
    rows = [(int(i), int(s)) for i, s in enumerate(rng.integers(1, 700, 900))] + [(5000, 0), (5001, None), (7, 300), (7, 300)]
    specs = spark.createDataFrame([(1, 256), (2, 1024), (3, None), (4, 0)], "spec_id long, capacity_tokens int")
    got = packing.pack_items(spark.createDataFrame(rows, "doc_id long, size int"), specs).toPandas()
    assert set(got.spec_id) == {1, 2}
    for spec, capacity in ((1, 256), (2, 1024)):
        mine = got[got.spec_id == spec]
        assert mine["size"].sum() == sum(s for _, s in rows if s)
        fill = mine.groupby("container")["size"].sum()
        assert fill.max() <= capacity and fill.sum() / (len(fill) * capacity) > 0.95
        parts = mine[~mine.item_id.isin([7])].groupby("item_id").agg(n=("part", "size"), s=("size", "sum"))
        assert (parts.n == -(-parts.s // capacity)).all()


def test_packing_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, size int")
    specs = spark.createDataFrame([(1, 256)], "spec_id long, capacity_tokens int")
    assert packing.pack_items(none, specs).count() == 0
    assert packing.pack_items(spark.createDataFrame([(1, 5)], none.schema), specs.filter("false")).count() == 0


def test_empty_documents_are_packed_too(spark, tmp_path):
    from docspark.llm import queries

    spark.createDataFrame([(1, "some text"), (2, ""), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 256), (2, 1024)], "spec_id long, capacity_tokens int").write.parquet(f"{tmp_path}/container_spec.parquet")
    rows = queries.p8_packed(spark, str(tmp_path)).collect()
    assert sorted((r.spec_id, r.doc_id, r["size"] > 0) for r in rows) == [(s, d, d == 1) for s in (1, 2) for d in (1, 2, 3)]
    assert len({(r.spec_id, r.container) for r in rows}) == 2
