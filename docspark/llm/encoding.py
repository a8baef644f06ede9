"""Problem 5: text decoded with a wrong encoding, by expectation-maximization over latent encoding chains.

A chain says how a field may have gone wrong: its true bytes in encoding A were read in encoding B (perhaps twice). For every
token with characters beyond ASCII each chain is turned back, and the code length of the result under a small model of
written text is held against the code length as it stands. A token that stands in many fields of the corpus is an ordinary word
of its language, however odd the model finds it, so what its count is worth is taken off. The gains of a field's different
tokens are its evidence for each chain, weak as they may be.
Weak evidence is pooled: every (source, field) has its own mixture of the chains and of sound text, drawn to the mixture of all,
and both are estimated by EM over the fields with any evidence (the others count as sound). Each record is then judged, and
repaired where the chain can be turned back, by its posterior.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docspark.llm.common import HOT_ROWS, join_hot, site_of
from docspark.llm.stage import slices, written

ROUNDS = 5
#: A token's gain that counts, in nats, and its least share of the token's best gain.
LEAST_GAIN, OF_BEST = 1.5, 0.2
#: A token whose code is at most this much longer than ordinary text of its kind is sound, and no chain is tried on it.
SOUND = 2.0
#: What a Chinese character costs more in a token without two of them side by side, in a field of other letters: at most this
#: share of them is Chinese.
LONE, LONE_SHARE = 6.0, 0.1
#: A token in more than one field is the less odd: with n fields in all its gain is less by log(1 + its other fields / (1 + RARE n)).
RARE = 1e-4
#: A field is found if the chance that it is garbled is over this: a miss is worse than a field looked at in vain.
CHANCE = 0.01
#: The best chain of a field has at most this evidence in EM (the others are moved down with it): beyond it is certain anyway.
MOST_EVIDENCE = 60.0
#: Pseudo-counts that draw a source's mixture to that of all sources, and the shares to start from: of a chain, and of sound text.
PULL, FIRST_CHAIN, FIRST_SOUND = 20.0, 0.002, 0.97

# Relative frequencies of the Russian letters, in per mille.
_RUSSIAN = dict(zip("оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфъё", (110, 84, 80, 73, 67, 62, 55, 47, 45, 44, 35, 32, 30, 28, 26, 20, 19, 17, 17, 16, 16, 14, 12, 10, 9, 7, 6, 5, 4, 3, 3, 1, 4)))
_EUROPEAN = frozenset("àâäáãåæçèéêëìíîïñòóôõöøùúûüýÿœßąćęłńśźżčřžšěůőűăîșțğış")
_TYPO = frozenset("’‘“”„–—…«»€£°½¼¾™©®·•§¿¡×ºª№′″µμ ​‍️−→")
_CJK_MARKS = frozenset("、。，《》〈〉「」『』【】（）：；！？～·—…“”‘’")

# Encodings: (wrong, true). "latin" is Windows-1252 whose gaps are control characters, as lenient readers have it.
_WRONG_OF_UTF8 = ("latin", "mac_roman", "cp437", "cp850", "cp1250", "cp1251", "koi8_r", "cp866")
_PAIRS = (
    ("latin", "cp1251"), ("latin", "koi8_r"), ("latin", "gbk"), ("latin", "big5"), ("latin", "shift_jis"), ("latin", "cp1250"),
    ("latin", "iso8859_2"), ("cp1251", "koi8_r"), ("koi8_r", "cp1251"), ("cp1251", "cp866"), ("cp866", "cp1251"), ("cp1251", "gbk"),
    ("cp1251", "latin"), ("mac_roman", "latin"), ("latin", "mac_roman"), ("cp1250", "latin"), ("cp437", "latin"), ("cp850", "latin"),
    ("latin", "cp437"), ("latin", "cp850"), ("cp437", "cp1250"),
)
CHAINS = tuple(f"{b}>utf8" for b in _WRONG_OF_UTF8) + ("latin>utf8>latin>utf8", "gbk>utf8", "big5>utf8") + tuple(f"{b}>{a}" for b, a in _PAIRS)
LOST = "lost"

_MULTI = re.compile(rb"(?:[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2})+")
_TOKEN = re.compile(r"(?:[^\s<>，。、；：！？]|\xa0)+")
_HAN = re.compile(r"[㐀-鿿]")
_PAIR = re.compile(r"[㐀-鿿]{2}")
_EDGES = "\xa0.,:;!?\"'()[]*_"
_WIDE = re.compile(r"[㐀-鿿豈-﫿가-힣ㄅ-ㄯ一-龥-　-〿＀-￯‘-”…—°€]+[!-~]?")

_cache: dict = {}


def _table(name: str) -> dict[str, int]:
    """Character to byte, for the bytes 80 to FF of a one-byte encoding."""
    if ("t", name) not in _cache:
        out = {}
        for b in range(0x80, 0x100):
            if name == "latin":
                out[chr(b)] = b
                try:
                    out[bytes([b]).decode("cp1252")] = b
                except UnicodeDecodeError:
                    pass
            else:
                try:
                    out[bytes([b]).decode(name)] = b
                except UnicodeDecodeError:
                    pass
        _cache["t", name] = out
    return _cache["t", name]


def _char(c: str) -> tuple[str, float]:
    """Class and code length (nats) of a character."""
    hit = _cache.get(c)
    if hit is None:
        hit = _cache[c] = _measure(c)
    return hit


def _measure(c: str) -> tuple[str, float]:
    import unicodedata

    o = ord(c)
    low = c.lower()
    if o < 0x80:
        return ("A" if c.isupper() else "a" if c.isalpha() else "d" if c.isdigit() else "s"), 0.0
    if c == "�" or o < 0xA0 or 0xE000 <= o <= 0xF8FF:
        return "z", 12.0
    if low in _RUSSIAN:
        return ("C" if c != low else "c"), -math.log(_RUSSIAN[low] / 1000) + (0.5 if c != low else 0.0)
    if c in _TYPO:
        return ("p" if c in _CJK_MARKS else "t"), (2.5 if c in "’‘“”–—…" else 3.5)
    if c in _CJK_MARKS:
        return "p", 3.5
    kind = unicodedata.category(c)
    name = unicodedata.name(c, "")
    if name.startswith("LATIN"):
        common = low in _EUROPEAN
        return ("L" if c.isupper() else "l"), (3.0 if common else 6.0) + (1.5 if c.isupper() else 0.0)
    if name.startswith("CYRILLIC"):
        return ("C" if c.isupper() else "c"), 7.0
    if name.startswith("GREEK"):
        return ("G" if c.isupper() else "g"), 5.5
    if name.startswith("CJK UNIFIED"):
        try:
            raw = c.encode("gb2312")
            return "h", 6.0 if raw[0] <= 0xD7 else 9.0
        except UnicodeEncodeError:
            return "h", 11.0
    if name.startswith(("HIRAGANA", "KATAKANA")):
        return "k", 5.0
    if name.startswith("HANGUL SYLLABLE"):
        return "n", 6.0
    if kind[0] == "M":
        return "m", 5.0 if 0x300 <= o < 0x370 else 13.0
    if kind in ("Cn", "Co", "Cs"):
        return "z", 14.0
    if kind == "So" and o >= 0x1F000 or o >= 0x1F300:
        return "e", 6.0
    if 0x2500 <= o < 0x25A0:
        return "b", 9.0
    return "x", 13.0 if kind[0] == "L" else 7.0


_LOWER, _UPPER = frozenset("alcg"), frozenset("ALCG")
_SCRIPT = {"a": 1, "A": 1, "l": 1, "L": 1, "c": 2, "C": 2, "g": 3, "G": 3}
_EAST = frozenset("hkn")
#: Ordinary code length of a character by its class; capitals count as small letters, so a run of them stands out.
_ORDINARY = {"c": 3.3, "C": 3.8, "h": 6.1, "k": 5.0, "n": 6.0, "l": 3.0, "L": 3.0, "t": 3.5, "p": 3.5, "g": 5.5, "G": 5.5, "e": 6.0, "m": 5.0}


def cost(text: str) -> float:
    """Code length of a token under the model: characters, case and script changes, symbols inside words."""
    return _costs(text)[0]


def _costs(text: str, lone: float = 0.0) -> tuple[float, float]:
    """The code length, and by how much it exceeds that of ordinary text of the same classes; ``lone`` is added for Chinese characters."""
    total, usual, before = 0.0, 0.0, "s"
    lone = 0.0 if lone and _PAIR.search(text) else lone
    for i, c in enumerate(text):
        k, own = _cache.get(c) or _char(c)
        if own or before not in "aAds":
            total += own + (lone if k == "h" else 0.0)
            usual += _ORDINARY.get(k, 0.0) if own else 0.0
            if k in _UPPER and before in _LOWER and (k != "A" or before != "a"):
                total += 5.0
            a, b = _SCRIPT.get(before), _SCRIPT.get(k)
            if a and b and a != b:
                total += 6.0
            elif k in _EAST and (before in "lLcCgGxb") or before in _EAST and k in "lLcCgGxb":
                total += 6.0
            elif k == "l" and before == "l":
                total += 2.0
            elif k in "xtzb" and a and c not in "’°µμ":
                total += 3.0
            elif before in "xzb" and b:
                total += 3.0
            elif before == "t" and b and text[i - 1] in "£½¼¾™©®·§×ºª":
                total += 3.0
            elif before in "tp" and b and i > 1 and text[i - 1] in "—–“”„«»…" and text[i - 2].isalpha():
                total += 6.0
            if k in _EAST and before in "aA" and text[i + 1 : i + 2].isascii() and text[i + 1 : i + 2].isalpha():
                total += 6.0  # a lone character inside a Latin word
        elif before == "h" and "a" <= c <= "z":
            total += 4.0  # names written in Latin letters begin with a capital, as a rule
        before = k
    return total, total - usual


def _decode(raw: bytes, true: str) -> str | None:
    try:
        return raw.decode("cp1252" if true == "latin" else true)
    except UnicodeDecodeError:
        return None


def _from_single(text: str, wrong: str, true: str) -> str | None:
    """Turn back a run read in a one-byte encoding; None if nothing changes."""
    table = _table(wrong)
    out, at, n, changed = [], 0, len(text), False
    while at < n:
        if text[at] not in table:
            out.append(text[at])
            at += 1
            continue
        end = at
        while end < n and text[end] in table:
            end += 1
        raw = bytes(table[c] for c in text[at:end])
        if true == "utf8":
            pos = 0
            for m in _MULTI.finditer(raw):
                out.append(text[at + pos : at + m.start()])
                out.append(m.group().decode("utf-8"))
                pos, changed = m.end(), True
            out.append(text[at + pos : end])
        else:
            good = _decode(raw, true)
            if good is not None and good != text[at:end]:
                out.append(good)
                changed = True
            else:
                out.append(text[at:end])
        at = end
    return "".join(out) if changed else None


def _from_double(text: str, wrong: str) -> str | None:
    """Turn back UTF-8 that was read in a two-byte encoding; a lost byte stays a replacement character."""
    changed = False

    def turn(m: re.Match) -> str:
        nonlocal changed
        piece = m.group()
        for cut in (len(piece), len(piece) - 1):
            try:
                raw = piece[:cut].encode(wrong)
            except UnicodeEncodeError:
                continue
            good = raw.decode("utf-8", "replace")
            if cut and good.count("�") <= 1 and (not good.endswith("�") or len(good) > 1 or m.string[m.end() : m.end() + 1] == "�"):
                changed = True
                return good + piece[cut:]
        return piece

    out = _WIDE.sub(turn, text)
    return out if changed else None


def turn_back(text: str, chain: str) -> str | None:
    """The token as it was before the chain; None if the chain cannot have made it."""
    steps = chain.split(">")
    if steps[0] in ("gbk", "big5"):
        return _from_double(text, steps[0])
    for wrong, true in zip(steps[::2], steps[1::2]):
        text = _from_single(text, wrong, true)
        if text is None:
            return None
    return text


def gains(token: str, lone: float = 0.0) -> tuple[tuple[str, float], ...]:
    """The chains that shorten the token's code by enough."""
    now, excess = _costs(token, lone)
    if excess <= SOUND:
        return ()
    out = []
    for chain in CHAINS:
        good = turn_back(token, chain)
        if good is not None:
            saved = now - _costs(good, lone)[0] - 3.0 * good.count("�")
            if saved > LEAST_GAIN:
                out.append((chain, saved))
    lost = token.count("�")
    if lost:
        out.append((LOST, 9.0 * lost))
    if len(out) > 1:
        best = max(x for _, x in out)
        out = [x for x in out if x[1] > OF_BEST * best]
    return tuple(out)


def evidence(text: str) -> dict[str, tuple[tuple[str, float], ...]]:
    """The different tokens of a text (without marks around them) that have gains, with their gains (nats) for each chain."""
    han = len(_HAN.findall(text))
    lone = LONE if han and han <= LONE_SHARE * sum(map(str.isalpha, text)) else 0.0
    known = _cache.setdefault(("tokens", lone), {})
    if len(known) > 400_000:
        known.clear()
    found = {}
    for token in set(_TOKEN.findall(text)):
        if token.isascii():
            continue
        token = token.strip(_EDGES) or token
        hit = known.get(token)
        if hit is None:
            hit = known[token] = gains(token, lone)
        if hit:
            found[token] = hit
    return found


def repair(text: str, chain: str) -> str:
    """Turn back every token that the chain explains; other tokens stay."""
    if chain == LOST:
        return text
    han = len(_HAN.findall(text))
    lone = LONE if han and han <= LONE_SHARE * sum(map(str.isalpha, text)) else 0.0

    def fix(m: re.Match) -> str:
        if m.group().isascii():
            return m.group()
        good = turn_back(m.group(), chain)
        return good if good is not None and _costs(good, lone)[0] < _costs(m.group(), lone)[0] else m.group()

    return _TOKEN.sub(fix, text)


FIELDS = ("raw_text", "title")


HITS = "source string, field string, token long, first boolean, chain string, gain double"


def _weigh(id_type: pa.DataType):
    """From ``seq, source, field, text``: a row for each chain that shortens a token of the field."""
    names = ["seq", "source", "field", "token", "first", "chain", "gain"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in slices(batches):
            rows: list[tuple] = []
            for i, text in enumerate(batch.column("text").to_pylist()):
                for token, found in evidence(text).items():
                    key = xxh64_intdigest(token) - 2**63
                    rows += [(i, key, j == 0, chain, gain) for j, (chain, gain) in enumerate(found)]
            at, token, first, chain, gain = zip(*rows) if rows else ((),) * 5
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(at) for c in names[:3]), pa.array(token, pa.int64()), pa.array(first, pa.bool_()), pa.array(chain, pa.string()), pa.array(gain, pa.float64())], names=names)

    return run


def fields_of(df: DataFrame) -> DataFrame:
    """``seq, source, field, text``: one row per field that has text; the source is the site, else the project."""
    source = F.coalesce(site_of(F.col("source_url")), F.concat(F.lit("project "), F.col("project_id").cast("string")), F.lit(""))
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in FIELDS])
    return df.select("seq", source.alias("source"), F.explode(pairs).alias("f")).select("seq", "source", "f.field", "f.text").filter("text <> ''")


def weighed(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(seq, source, field, chain, evidence)`` of the fields with any, and ``(source, field, n)``: how many fields have text."""
    from pyspark.sql.pandas.types import to_arrow_type

    of = df.schema["seq"].dataType
    fields = fields_of(df)
    sizes = written(fields.groupBy("source", "field").agg(F.count(F.lit(1)).alias("n")))
    n_all = sizes.agg(F.sum("n")).first()[0] or 1
    hits = written(fields.filter(F.col("text").rlike(r"[^\x00-\x7f]")).mapInArrow(_weigh(to_arrow_type(of)), f"seq {of.simpleString()}, {HITS}"))
    counts = written(hits.filter("first").groupBy("token").agg(F.count(F.lit(1)).alias("fields")))
    counted = join_hot(hits, counts, ["token"], counts.filter(F.col("fields") > HOT_ROWS), "seq")
    left = F.col("gain") - F.log1p((F.col("fields") - 1) / F.lit(1 + RARE * n_all))
    sums = counted.withColumn("left", left).filter("left > 0").groupBy("seq", "source", "field", "chain").agg(F.sum("left").alias("evidence"))
    best = F.max("evidence").over(Window.partitionBy("seq", "field"))  # a row per chain
    over = F.greatest(best - MOST_EVIDENCE, F.lit(0.0))
    return written(sums.withColumn("over", over).select("seq", "source", "field", "chain", (F.col("evidence") - F.col("over")).alias("evidence"))), sizes


def posteriors(df: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``seq, field, chain, p``: for each field with evidence its likeliest chain and the chance that the field is garbled.

    ``df`` has ``seq`` (unique), ``raw_text, title, source_url, project_id``; other columns are not read. Null, empty and
    ASCII-only fields have no row; an empty table gives no rows. With one round the shares to start from decide alone. What a
    field itself adds to its source's mixture is left out where the field is judged, so it does not bear itself out.
    """
    weights, sizes = weighed(df)
    n_all = sizes.agg(F.sum("n")).first()[0] or 1
    joint = weights.withColumn("w", F.lit(math.log(FIRST_CHAIN / FIRST_SOUND)) + F.col("evidence"))
    for i in range(rounds):
        top = joint.groupBy("seq", "field").agg(F.max("w").alias("top"), F.first("source").alias("source"), F.collect_list(F.struct("chain", "evidence", "w")).alias("c"))  # a row per chain
        top = top.withColumn("top", F.greatest("top", F.lit(0.0)))
        den = F.exp(-F.col("top")) + F.aggregate("c", F.lit(0.0), lambda a, x: a + F.exp(x["w"] - F.col("top")))
        shares = top.select("seq", "source", "field", F.explode(F.transform("c", lambda x: F.struct(
            x["chain"].alias("chain"), x["evidence"].alias("evidence"), (F.exp(x["w"] - F.col("top")) / den).alias("p")))).alias("x")).select("seq", "source", "field", "x.*")
        if i == rounds - 1:
            break
        shares = written(shares)
        mass = shares.groupBy("source", "field", "chain").agg(F.sum("p").alias("mass"))
        overall = mass.groupBy("chain").agg((F.sum("mass") / F.lit(float(n_all))).alias("all"))  # a row per chain
        gone = mass.groupBy("source", "field").agg(F.sum("mass").alias("gone"))
        lost = F.lit(overall.agg(F.sum("all")).first()[0] or 0.0)
        mixture = mass.join(F.broadcast(overall), "chain").join(gone, ["source", "field"]).join(sizes, ["source", "field"])
        of = F.col("n") - 1 + PULL
        share = (F.greatest(F.col("mass") - F.col("p"), F.lit(0.0)) + PULL * F.col("all") + 1e-6) / of
        sound = F.greatest((F.col("n") - 1 - F.greatest(F.col("gone") - F.col("p"), F.lit(0.0)) + PULL * (1 - lost)) / of, F.lit(1e-3))
        joint = shares.join(mixture, ["source", "field", "chain"]).withColumn("w", F.log(share) - F.log(sound) + F.col("evidence"))
    return shares.groupBy("seq", "field").agg(F.max_by("chain", "p").alias("chain"), F.sum("p").alias("p"))


def garbled(df: DataFrame) -> DataFrame:
    """``seq, field, chain``: the fields that are garbled with a chance over ``CHANCE``."""
    return posteriors(df).filter(F.col("p") > CHANCE).select("seq", "field", "chain")


def _fix(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        yield pd.DataFrame({"seq": frame["seq"], "field": frame["field"], "chain": frame["chain"],
                            "repaired": [repair(t, c) for t, c in zip(frame["text"], frame["chain"])]})


def repaired(df: DataFrame) -> DataFrame:
    """``seq, field, chain, repaired``: the text of every garbled field, turned back where the chain allows it."""
    kind = df.schema["seq"].dataType.simpleString()
    texts = fields_of(df).join(written(garbled(df)), ["seq", "field"]).select("seq", "field", "chain", "text")
    return texts.mapInPandas(_fix, f"seq {kind}, field string, chain string, repaired string")
