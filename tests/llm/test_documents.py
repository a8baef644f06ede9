"""Operators on source documents: brute force, planted cases, nulls, ties, repeats, empty tables, clashing columns."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docspark.llm import encoding, lines, mainbody, neardup, residue, splitting

SOURCE = "seq long, raw_text string, title string, source_url string, media_type string, project_id long, site string, body string, lines string"
CONFIG = "project_id long, content_selector string, title_selector string, remove_selectors array<string>, chunk_chars int, target_chars int, max_chars int, overlap_chars int"
rng = random.Random(4)
WORDS = "harbour lantern kettle archive railway painters window river market garden engine winter singers copper station letter narrow bridge".split()


def sentence(n=9):
    return " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + "."


def docs(spark, rows):
    full = [(i, r.get("raw"), r.get("title"), r.get("url"), r.get("media", "text/plain"), r.get("project"), "clash", "clash", "clash") for i, r in enumerate(rows)]
    return spark.createDataFrame(full, SOURCE)


@pytest.fixture(scope="module")
def config(spark):
    return spark.createDataFrame([(1, ".entry", None, [".ad"], 900, 0, None, 10), (2, "", "", [], None, 80, 0, None), (None, None, None, None, None, None, None, None)], CONFIG)


# --- lines ---------------------------------------------------------------------------------------------------------------------
def test_suffix_array_against_sorting():
    for _ in range(30):
        ids = np.array([rng.randrange(3) for _ in range(rng.randrange(1, 40))])
        order, common = lines.suffix_array(ids)
        suffixes = [ids[i:].tolist() for i in range(len(ids))]
        assert [suffixes[i] for i in order] == sorted(suffixes)
        for a, b, h in zip(order, order[1:], common[1:]):
            same = 0
            while same < min(len(suffixes[a]), len(suffixes[b])) and suffixes[a][same] == suffixes[b][same]:
                same += 1
            assert h == same


def test_blocks_against_brute_force():
    for _ in range(20):
        records = [np.array([rng.randrange(4) for _ in range(rng.randrange(0, 8))], dtype=np.int64) for _ in range(5)]
        found = lines.repeated_blocks(records)
        single = {x: n for x, n, _, _ in zip(*(c.tolist() for c in lines.single_blocks(records)))}
        assert single == {k: sum(k in r for r in records) for k in {x for r in records for x in r.tolist()}}
        assert all(records[o][p] == x for x, _, o, p in zip(*lines.single_blocks(records)))
        for _, length, n, owner, start in found:
            block = records[owner][start : start + length].tolist()
            holds = sum(any(r[i : i + length].tolist() == block for i in range(len(r) - length + 1)) for r in records)
            assert n == holds and len(block) == length
        hashes = {}
        for h, length, _, owner, start in found:
            hashes.setdefault((length, h), set()).add(tuple(records[owner][start : start + length].tolist()))
        assert all(len(v) == 1 for v in hashes.values())


def test_repeated_lines(spark, monkeypatch):
    monkeypatch.setattr(lines, "CHUNK_RECORDS", 3)
    rows = [{"raw": f"{sentence()}\nAll RIGHTS reserved {i}\r\n123\n", "url": u} for i, u in zip(range(12), ["http://www.A.com/x", "https://a.com:80/y"] * 6)]
    rows += [{"raw": f"all rights reserved\n{sentence()}", "url": "http://b.com"} for _ in range(4)]
    rows += [{"raw": "all rights reserved"}, {"raw": None, "url": "http://a.com"}, {"raw": "", "url": "http://a.com"}, {"raw": "all rights reserved", "url": "http://a.com", "media": "Text/HTML"}]
    df = docs(spark, rows)
    assert sorted((r.seq, r.line_no) for r in lines.repeated_lines(df).collect()) == [(i, 2) for i in range(12)]
    cleaned = {r.seq: r.clean_text for r in lines.without_lines(df, lines.repeated_lines(df)).collect()}
    assert cleaned[0].split("\n")[1:] == ["123", ""] and cleaned[17] is None and cleaned[18] == ""
    assert lines.repeated_lines(df.filter("false")).count() == 0


# --- splitting -----------------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("limit, overlap, aim", [(120, 0, 80), (100, 80, 80), (50, 49, None), (800, 40, None), (10, 99, 3)])
def test_pieces(limit, overlap, aim):
    for text in [" ".join(sentence() for _ in range(30)), "x" * 1000, "好" * 300, "\n\n".join(sentence(20) for _ in range(12)), "é" * 200, "👩‍👩‍👧" * 60, "a\r\n" * 99, ""]:
        got = splitting.pieces(text, limit, overlap, aim)
        assert got[0][0] == 0 and got[-1][1] == len(text) and all(b - a <= limit for a, b in got)
        for (a, b), (c, d) in zip(got, got[1:]):
            assert c == max(0, b - min(overlap, limit - 1)) and d > b


def test_cuts_at_natural_boundaries():
    text = " ".join(sentence() for _ in range(40))
    for a, b in splitting.pieces(text, 200)[:-1]:
        assert text[b - 2 : b] == ". "
    topics = ("The kettle boils water. Water in the kettle boils. " * 4) + ("Painters paint a bridge. The bridge is painted red. " * 4)
    at = topics.index("Painters")
    assert splitting.pieces(topics, at + 120)[0][1] == at


def test_cuts_are_at_the_deepest_valley_of_their_window(monkeypatch):
    checked = 0
    for _ in range(20):
        text = "\n\n".join(" ".join(sentence(rng.randrange(4, 12)) for _ in range(rng.randrange(2, 8))) for _ in range(12))
        paragraphs, sentences, _ = splitting.boundaries(text)
        deep = splitting.depths(text, sorted({*paragraphs, *sentences}))
        cut = 0
        for a, b in splitting.pieces(text, 700)[:-1]:
            window = [p for p in paragraphs if cut + 350 <= p <= a + 700] or [p for p in sentences if cut + 350 <= p <= a + 700]
            assert deep[b] == max(deep[p] for p in window)
            checked, cut = checked + 1, b
    assert checked > 50
    text = " ".join(sentence() for _ in range(40))
    plain = splitting.pieces(text, 400)
    monkeypatch.setattr(splitting, "depths", lambda text, gaps: dict.fromkeys(gaps, 0.0))
    assert splitting.pieces(text, 400) != plain  # the method decides the cuts


def test_split_items(spark, config):
    clean = spark.createDataFrame([(1, 1, "x" * 950), (2, None, "y" * 2800), (3, None, "y" * 2801), (4, 9, None), (5, 1, ""), (6, 2, "z " * 1500)], "clean_id long, project_id long, clean_text string")
    seg = spark.createDataFrame([(1, 2, "w" * 121), (2, 2, "w" * 120), (3, None, None)], "segment_id long, project_id long, text string")
    rows = splitting.split_items(splitting.items(clean, seg, config)).collect()
    assert {(r.item_kind, r.item_id) for r in rows if r.piece_count > 1} == {("chunk", 1), ("chunk", 3), ("chunk", 6), ("segment", 1)}
    mine = sorted((r for r in rows if (r.item_kind, r.item_id) == ("chunk", 1)), key=lambda r: r.piece_no)
    assert mine[0].end - mine[1].start == 10 and [r.piece_no for r in mine] == [1, 2]
    assert [r.piece for r in rows if (r.item_kind, r.item_id) == ("chunk", 5)] == [""]
    assert splitting.split_items(splitting.items(clean, seg, config).filter("false")).count() == 0


# --- main bodies ---------------------------------------------------------------------------------------------------------------
def page(i, body, name="Alpha Post"):
    return {"url": f"https://alpha-post.test/{i}", "media": "text/HTML; charset=utf-8", "project": 1, "raw": "\n".join([
        "<!doctype html>", "<html><head>", f"<title>T{i} - {name}</title>", "</head>", "<body>", "<noscript>off</noscript>", '<div class="x"><p>We use cookies.</p></div>',
        '<nav><a href="/">Home</a> <a href="/n">News</a></nav>', '<div class="entry">', f"<h1>T{i}</h1>", *body, '<div class="s">', "<p>Share this</p>", "</div>", "</div>",
        "<footer>", f"<p>All rights at {name}</p>", "</footer>", "</body></html>"])}


def test_main_bodies(spark, config):
    rows = [page(i, [f"<p>{sentence(30)}, {sentence(30)}", f"<p>{sentence(30)}</p>", "<ul>", f"<li>Point {sentence(3)} {i * 'x'}</li>", "</ul>"]) for i in range(6)]
    rows += [page(6, ["<p>Not found.</p>"]), {"raw": None, "media": "text/html"}, {"raw": "", "media": "text/html"}, {"raw": "<body>\n</body>", "media": "text/html"}, {"raw": "plain", "url": "http://q"}, {"raw": "<p>" * 3000 + "deep", "media": "text/html"}]
    got = {r.seq: r for r in mainbody.main_bodies(docs(spark, rows), config).collect()}
    for i in range(6):
        assert got[i].lines == [7, 8, 17, 21] and "Point" in got[i].body and "Share" not in got[i].body
    assert got[6].body == "T6\nNot found." and got[9].body == "" and set(got) == {*range(7), 9, 11}
    assert mainbody.boilerplate_lines(docs(spark, rows).filter("false"), config).count() == 0


# --- near duplicates -----------------------------------------------------------------------------------------------------------
def jaccard(a, b, k):
    grams = lambda t: {tuple(w[i : i + k]) for w in [neardup.words_of(t)] for i in range(len(w) - k + 1)}
    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y) if x | y else 0.0


def corpus():
    base = [" ".join(f"{rng.choice(WORDS)}{rng.randrange(40)}" for _ in range(90)) for _ in range(25)]
    out = list(base)
    for t in base:
        w = t.split()
        for n in (1, 3, 8, 30):
            for _ in range(n):
                w[rng.randrange(len(w))] = f"edit{rng.randrange(999)}"
            out.append(" ".join(w))
    return [*out, base[0], base[0].upper(), None, "", "short text", "中" * 70, "中" * 70]


@pytest.mark.parametrize("bucket", [64, 2])
def test_pairs_against_brute_force(spark, monkeypatch, bucket):
    monkeypatch.setattr(neardup, "BUCKET", bucket)
    monkeypatch.setattr(neardup, "BLOCK", 3)
    texts = corpus()
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "seq long, body string, rep string")
    members, pairs = neardup.similar(df, size=3, threshold=0.5, least=60)
    got = {(r.seq_a, r.seq_b) for r in neardup.all_pairs(members, pairs).collect()}
    long = [i for i, t in enumerate(texts) if t and len(neardup.words_of(t)) >= 60]
    sims = {(i, j): jaccard(texts[i], texts[j], 3) for i in long for j in long if i < j}
    assert {p for p, s in sims.items() if s >= 0.55} <= got <= {p for p, s in sims.items() if s >= 0.5}
    per = {r.id: r for r in neardup.classes(members, pairs).collect()}
    assert set(per) == set(long)
    for i in long:
        assert per[i].links == sum(i in p for p in got)
    for a, b in got:
        assert per[a].class_id == per[b].class_id
    assert per[0].class_id == 0


def test_signature_estimates_weighted_similarity():
    gen = np.random.default_rng(7)
    a = gen.integers(0, 2**62, 300).astype(np.uint64)
    b = np.concatenate([a[:200], gen.integers(0, 2**62, 100).astype(np.uint64)])
    sigs = neardup.signatures(np.concatenate([a, b]), np.array([300, 300]), slots=4096)
    assert abs((sigs[0] == sigs[1]).mean() - 0.5) < 0.04
    w = np.concatenate([np.full(300, 1.5), np.full(300, 3.0)])
    sigs = neardup.signatures(np.concatenate([a, b]), np.array([300, 300]), w, slots=4096)
    assert abs((sigs[0] == sigs[1]).mean() - 300 / 1050) < 0.04


def test_no_bodies(spark):
    members, pairs = neardup.similar(spark.createDataFrame([], "seq long, body string"))
    assert members.count() == pairs.count() == neardup.classes(members, pairs).count() == 0


# --- encodings -----------------------------------------------------------------------------------------------------------------
SOUND = ["Über die Brücke, sagt Kanis: „Die Mühle“", "В городе тихая станция и тёплая печь", "清晨的图书馆里有书，没有人知道。", "It’s 21 °C — the ™ sign, 5 µm, €12", "La última máquina señaló el otoño", "SÃO dois pães e três mães", "КАК СТАНЦИЯ МЕНЯЕТ ГОРОД", "plain ascii", "🌿🎙🚂"]


def read_wrong(text, true, wrong):
    return text.encode(true).decode(wrong)


GARBLED = [
    (read_wrong("Über die Brücke für Hörer", "utf-8", "latin-1"), "Über die Brücke für Hörer"), (read_wrong("It’s hard, don’t", "utf-8", "cp1252"), "It’s hard, don’t"),
    (read_wrong("В городе тихая станция", "cp1251", "latin-1"), "В городе тихая станция"), (read_wrong("тихая станция стоит", "koi8-r", "cp1251"), "тихая станция стоит"),
    (read_wrong("为什么古老的码头记录了山谷", "gbk", "latin-1"), "为什么古老的码头记录了山谷"), (read_wrong(read_wrong("Lição de praça", "utf-8", "latin-1"), "utf-8", "cp1252"), "Lição de praça"),
    (read_wrong("cost £175, don’t", "utf-8", "mac_roman"), "cost £175, don’t"), ("It�s hard", "It�s hard"),
]


def test_encodings(spark):
    rows = [{"raw": t, "title": None, "url": "http://s.com/1"} for t in SOUND] + [{"raw": "fine text", "title": g, "url": f"http://g{i}.com"} for i, (g, _) in enumerate(GARBLED)]
    rows += [{"raw": f"fine {g}\nand more", "title": "", "project": 3} for g, _ in GARBLED] + [{"raw": None}, {"raw": ""}]
    df = docs(spark, rows)
    found = {(r.seq, r.field) for r in encoding.garbled(df).collect()}
    n, m = len(SOUND), len(GARBLED)
    assert found == {(n + i, "title") for i in range(m)} | {(n + m + i, "raw_text") for i in range(m)}
    fixed = {(r.seq, r.field): r.repaired for r in encoding.repaired(df).collect()}
    assert [fixed[n + i, "title"] for i in range(m)] == [g for _, g in GARBLED]
    assert encoding.garbled(df.filter("false")).count() == 0


def test_weak_evidence_is_pooled(spark):
    """The same weak field is found beside fields with the same chain and not in a sound source; without EM both are judged alike."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda i: "se" + letters[i % 26] + letters[i // 26 % 26]
    gone = [{"raw": f"Une {word(i)}\u00c3\u00a9t\u00c3\u00a9 et la for\u00c3\u00aat", "url": "http://gone.com"} for i in range(40)]
    sound = [{"raw": f"Une {word(i)}été et la forêt", "url": "http://sound.com"} for i in range(400)]
    weak = [{"raw": "Prix \u00c2\u00b1", "url": u} for u in ("http://gone.com", "http://sound.com")]
    df = docs(spark, gone + sound + weak)
    at = {440: "gone", 441: "sound"}
    last, first = ({at[r.seq]: r.p for r in encoding.posteriors(df, n).filter("seq >= 440").collect()} for n in (encoding.ROUNDS, 1))
    assert 1 - last["gone"] < 0.1 * (1 - last["sound"]) and abs(first["gone"] - first["sound"]) < 1e-9
    assert encoding.garbled(df).filter("seq < 40").count() == 40 and encoding.garbled(df).filter("seq between 40 and 439").count() == 0


# --- residue -------------------------------------------------------------------------------------------------------------------
def test_residue(spark, config):
    body = "\n".join(sentence(25) for _ in range(5))
    lorem = "Lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua."
    cases = [
        ({"raw": f"{body}\nHello {{{{ user.name }}}} there"}, "template"), ({"raw": body, "title": "#{title}"}, "template"), ({"raw": f"{body}\n{lorem}\n{lorem}\n{lorem}"}, "filler"),
        ({"raw": "# New\n\nYour text goes here. Type here to add a description."}, "filler"), ({"raw": "Error\n\n500 Service Unavailable", "title": "Error"}, "message"),
        ({"raw": "Please enable JavaScript to continue."}, "message"), ({"raw": "<html><body><div><h1>App</h1><p>Loading...</p></div></body></html>", "media": "text/html", "title": "App"}, "message"),
        ({"raw": body}, None), ({"raw": f"{body}\nThe author writes `{{{{ title }}}}` in the layout."}, None), ({"raw": f"{body}\nPrinters used filler such as lorem ipsum."}, None),
        ({"raw": f"{body}\n\n    cfg = '{{{{ page }}}}'"}, None), ({"raw": f"{body}\nA page that says 404 Not Found is still a page."}, None), ({"raw": "Closed on Mondays."}, None), ({"raw": None}, None), ({"raw": ""}, None),
    ]
    got = {r.seq: r.kind for r in residue.residue(docs(spark, [c for c, _ in cases]), config).collect()}
    assert got == {i: k for i, (_, k) in enumerate(cases) if k}
    assert residue.residue(docs(spark, [cases[0][0]]).filter("false"), config).count() == 0


def test_messages_without_a_known_phrase_are_found_by_their_recurrence(spark, config, monkeypatch):
    rows = [{"raw": f"{sentence()}\n{sentence()}", "url": f"http://n{i}.com"} for i in range(5)]
    rows += [{"raw": f"Sorry, that address leads nowhere ({i}).", "url": f"http://s{i}.com"} for i in range(5)]
    rows += [{"raw": f"Our little ferry is called Anna. {sentence()}", "url": "http://own.com"}]
    rows += [{"raw": "\n".join(["Names have been changed.", *(sentence(25) for _ in range(4))]), "url": f"http://s{i}.com"} for i in range(5)]
    df = docs(spark, rows)
    assert {r.seq: r.kind for r in residue.residue(df, config).collect()} == {i: "message" for i in range(5, 10)}
    monkeypatch.setattr(residue, "SITES", 10**9)
    assert residue.residue(df, config).count() == 0


@pytest.mark.parametrize("text", ["521 Error", "520 Unknown", "431 Request Header Fields Too Large", "访问被拒", "503 Service Unavailable"])
def test_messages_by_phrase(spark, config, text):
    assert [r.kind for r in residue.residue(docs(spark, [{"raw": text}]), config).collect()] == ["message"]


def test_literal_parts_of_the_fill_in_phrases():
    import re

    for key, pattern in residue._FILLS:
        for part in pattern.split("|") if "(" not in pattern else [pattern]:
            literal = "|".join(re.sub(r"\\b|\\|\[.*?\]|\(\?:.*?\)\??", "#", part).lower().split("#"))
            assert key in literal or key.strip() in part.lower()


def test_repeats_within_a_body_leave_its_signature_alone():
    import pyarrow as pa

    cycle = [f"w{i}" for i in range(40)]
    bodies = [" ".join(cycle * n) for n in (2, 3, 8)]  # the same sets of shingles
    out = next(neardup._banded(3)(iter([pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array(bodies)], names=["rep", "body"])])))
    keys = np.array(out.column(0).to_pylist()).reshape(3, -1)
    # all but the few bands with an empty coordinate, which agrees with nothing
    assert (keys[0] == keys[1]).mean() > 0.85 and (keys[0] == keys[2]).mean() > 0.85
    cells, sizes = neardup.shingle_sets([b.split(" ") for b in bodies] + [[]], 3)
    assert sizes.tolist() == [40, 40, 40, 0] and len(cells) == 120


def test_band_keys_are_shuffled_in_lists(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(neardup, "PARTS", 16)
    bodies = pa.RecordBatch.from_arrays([pa.array(range(200)), pa.array([" ".join(f"w{i}x{j}" for j in range(70)) for i in range(200)])], names=["rep", "body"])
    rows = [(k, r) for b in neardup._banded(3)(iter([bodies])) for k, r in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
    lists = list(neardup._dealt(3)(iter([bodies])))
    assert len(rows) == 200 * 128 and sum(b.num_rows for b in lists) <= 16
    got = [(p, k, r) for b in lists for p, keys, reps in zip(*(c.to_pylist() for c in b.columns)) for k, r in zip(keys, reps)]
    assert sorted((k, r) for _, k, r in got) == sorted(rows) and all(p == (k % 2**64) >> 60 for p, k, _ in got)


@pytest.mark.parametrize("held, at_least", [(1 << 22, 1 << 16), (1 << 22, 1), (50, 1), (1, 400)])
@pytest.mark.parametrize("text", [False, True])
def test_buckets_of_lists(monkeypatch, held, at_least, text):
    import pyarrow as pa

    monkeypatch.setattr(neardup, "HELD", held)
    monkeypatch.setattr(neardup, "SORTED", at_least)
    monkeypatch.setattr(neardup, "BUCKET", 4)
    kind = pa.string() if text else pa.int64()
    gen, members, rows = random.Random(3), {}, []
    for rep in range(900):
        key = gen.choice([gen.randrange(-(2**63), 2**63), gen.randrange(-9, 9), gen.randrange(2**62, 2**62 + 200), 7])
        members.setdefault(key, []).append(f"r{rep}" if text else rep)
        rows.append((int(neardup._part(np.array([key]))[0]), key, members[key][-1]))
    rows.sort(key=lambda x: x[0])
    batches = []
    for at in range(0, 900, 100):
        cut = [rows[at + i : at + i + 5] for i in range(0, 100, 5)]
        cut = [[r for r in c if r[0] == p] for c in cut for p in sorted({r[0] for r in c})]
        batches.append(pa.RecordBatch.from_arrays(
            [pa.array([c[0][0] for c in cut], pa.int32()), pa.array([[r[1] for r in c] for c in cut], pa.list_(pa.int64())), pa.array([[r[2] for r in c] for c in cut], pa.list_(kind))], names=["part", "keys", "reps"]))
    got = sorted((row for b in neardup._runs(kind)(iter(batches)) for row in zip(*(c.to_pylist() for c in b.columns))), key=repr)
    pairs = [(k, a, b) for k, m in members.items() if len(m) <= 4 for i, a in enumerate(sorted(m)) for b in sorted(m)[i + 1 :]]
    assert pairs and got == sorted(pairs + [(k, a, None) for k, m in members.items() if len(m) > 4 for a in m], key=repr)
    assert list(neardup._runs(kind)(iter([]))) == []


def test_words_are_runs_of_letters_and_digits():
    signs = "".join(map(chr, [*range(1, 0x3005), *range(0xFE00, 0xFFFE), *range(0x1F000, 0x1FA00)]))
    for body in ("A_b c-d1\x1ce", "Éa_b·c½ ² x…y", "İSTANBUL é\u2003z", "中a々〇b é", "é" + signs, *("é" + signs[i : i + 30] for i in range(0, len(signs), 30))):
        assert neardup.words_of(body) == neardup._WORD.findall(body.lower())


def test_long_blocks_do_not_depend_on_the_chunks(spark, monkeypatch):
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda i: "own" + letters[i // 26] + letters[i % 26]
    texts = [f"{word(i)}\nHead one\nHead two\n" + ("Tail left" if i % 3 else "Tail right") + f"\n{word(i + 60)}" + ("\nHead one\nHead two" if i % 2 else "") for i in range(40)]
    df = docs(spark, [{"raw": t, "url": "https://site.example/x"} for t in texts])
    got = []
    for size in (1000, 4, 1):
        monkeypatch.setattr(lines, "CHUNK_RECORDS", size)
        rows = lines.repeated(df).filter("lines > 1").collect()
        got.append(sorted((r.block, r.lines, r.records) for r in rows))
        for r in rows:
            own = texts[r.id].split("\n")
            assert own[r.start].startswith("Head") and len(own) >= r.start + r.lines
    assert got[0] == got[1] == got[2] and sorted((n, k) for _, n, k in got[0]) == [(2, 14), (2, 26), (2, 40), (3, 14), (3, 26)]
