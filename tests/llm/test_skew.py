"""Hot keys: the branches that deal them to parts give the same rows, and the plans part them."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from docspark.llm import common, encoding, lines, mainbody, neardup, residue, tokens
from tests.llm.test_documents import CONFIG, corpus, docs, page, sentence


@pytest.fixture
def hot(monkeypatch):
    for module in (common, encoding, lines, mainbody, neardup, residue):
        monkeypatch.setattr(module, "HOT_ROWS", 1)
    monkeypatch.setattr(common, "HOT_PARTS", 3)
    monkeypatch.setattr(neardup, "HOT_PARTS", 3)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_join_with_hot_keys(spark, hot, how):
    left = spark.createDataFrame([(i, "a" if i % 2 else str(i % 5)) for i in range(40)] + [(99, None)], "id long, k string")
    right = spark.createDataFrame([("a", 1), ("2", 2), ("z", 3)], "k string, v int")
    counts = left.groupBy("k").count().filter(F.col("count") > 1)
    assert rows(common.join_hot(left, right, ["k"], counts, "id", how).select("id", "k", "v")) == rows(left.join(right, "k", how).select("id", "k", "v"))


@pytest.mark.parametrize("copies", [1, 2])
def test_copies_are_paired_part_by_part(spark, hot, monkeypatch, copies):
    texts = corpus()[:40] + [corpus()[0]] * 7
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "seq long, body string")
    members, pairs = neardup.similar(df, size=3, threshold=0.5, least=60)
    plain = rows(neardup.all_pairs(members, pairs))
    classes = rows(neardup.classes(members, pairs))
    monkeypatch.setattr(neardup, "COPIES", copies)
    assert rows(neardup.all_pairs(members, pairs)) == plain and len(set(plain)) == len(plain)
    per = {x: 0 for x, *_ in classes}
    for a, b in plain:
        per[a] += 1
        per[b] += 1
    assert {x: n for x, _, n in classes} == per


def test_operators_with_hot_keys_give_the_same_rows(spark, monkeypatch):
    texts = [page(i, [f"<p>{sentence(30)}, {sentence(30)}", f"<p>{sentence(30)}</p>"]) for i in range(6)]
    texts += [{"raw": f"{sentence()}\nAll rights reserved {i}\nShare this", "url": "http://a.com/x"} for i in range(12)]
    texts += [{"raw": "Loading, please wait.", "url": f"http://s{i}.com"} for i in range(5)] + [{"raw": "déjÃ\xa0 vu Ã©tÃ©", "url": "http://e.com"}] * 3
    df, config = docs(spark, texts), spark.createDataFrame([(1, ".entry", None, [".ad"], 900, 0, None, 10)], CONFIG)
    run = lambda: [rows(mainbody.main_bodies(df, config)), rows(lines.repeated_lines(df)), rows(residue.residue(df, config)), rows(encoding.garbled(df)), rows(lines.cleaned_records(df))]
    plain = run()
    assert all(plain)
    for module in (common, encoding, lines, mainbody, neardup, residue):
        monkeypatch.setattr(module, "HOT_ROWS", 1)
    monkeypatch.setattr(lines, "CHUNK_RECORDS", 2)
    assert run() == plain


def test_long_blocks_recur_too(spark):
    notice = "We and our partners store data on your device, and by reading on you agree that we may use it for measurement and for advertising, as the notice explains at length. " * 2
    config = spark.createDataFrame([], CONFIG)
    pages = []
    for i in range(8):
        p = page(i, [f"<p>{sentence(30)}, {sentence(30)}", f"<p>{sentence(30)}</p>"])
        p["raw"] = p["raw"].replace('<div class="s">', f'<p>{notice}</p>\n<div class="s">')
        pages.append(p)
    assert all("partners" not in r.body for r in mainbody.main_bodies(docs(spark, pages), config).collect())


def test_a_page_packs_and_unpacks():
    page_ = mainbody.Page("<html><head><title>T</title></head><body class=x><div id=a>one <b>two</b><p>three</div>\n<p>four &amp; five")
    back = mainbody.Page.unpacked(page_.packed())
    assert all(getattr(back, c) == getattr(page_, c) for c in ("tags", "parents", "attrs", "leaf_of", "leaf_node", "linked", "lines", "texts", "body_line", "title"))


def test_plans_part_the_hot_keys(spark):
    df = docs(spark, [{"raw": "a\nb", "url": "http://a.com"}])
    plan = lines.single_lines(lines.site_records(df))._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(site#\d+, chunk#", plan)
    words = tokens.encode_corpus(spark.createDataFrame([(1, "the end")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in words and "hashpartitioning(block" in words


def test_the_suffix_array_decides_the_lines(spark, monkeypatch):
    df = docs(spark, [{"raw": f"Own {chr(97 + i)}\nAll rights reserved\nShare this", "url": "http://a.com/x"} for i in range(9)])
    assert lines.repeated_lines(df).count() == 18
    monkeypatch.setattr(lines, "suffix_array", lambda ids: (np.arange(len(ids)), np.zeros(len(ids), np.int64)))
    records = [np.array([5, 7]), np.array([5, 8])]
    assert sorted(lines.single_blocks(records)[1].tolist()) == [1, 1, 1, 1]
