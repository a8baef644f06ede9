"""Problem 9: abusive, hateful or sexual content, by a classifier chain of linear models over sentences.

Texts are cut into sentences and words brought to a canonical form that undoes disguise: look-alike letters and digits, marks
between letters, stretched letters, hidden characters. A chain of logistic models predicts insult, hate and sexual content in
turn, each fed with the chances of the ones before, and last whether the sentence is abusive; every sentence is scored, and in
training the earlier chances are out of fold. A verdict is on a whole document, so the sentence that carries it is found in
rounds: the likeliest sentence of a document found abusive is taken as the example, the sentences of a document found sound are
counterexamples. Of the latter, those without a trigger (a word of the short lexicon or one that the verdicts tie to abuse) are
many and alike; at most ``MAX_PLAIN`` of them are fitted on, with about the weight of the sentences with a trigger. As some
verdicts are wrong, a sentence without a trigger is an example only if a model fitted without its document finds it likely.

The model is fitted on at most ``MAX_LABELLED`` labelled documents and has at most ``MAX_FEATURES`` features, so what is sent
to the executors is bounded; every document is scored.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_LABELLED, MAX_FEATURES = 20_000, 60_000
#: Characters of the labelled documents together, about: what is sent to the driver is bounded in size too.
MAX_LABELLED_CHARS = 80_000_000
MAX_PLAIN = 10_000
PLAIN_CHANCE = 0.4
CATEGORIES = ("insult", "hate", "sexual")
FOLDS, ROUNDS, STEPS = 3, 3, 60
THRESHOLD = 0.5

# A short lexicon by category, in plain spelling (moderation seed words of several languages).
LEXICON = {
    "insult": "idiot moron imbecile stupid dumb brainless worthless pathetic loser scumbag bastard asshole bitch cunt wanker retard retarded clown parasite spineless "
    "shit fuck fucking dickhead trash garbage filthy disgusting vermin swallowed kys kill die rot cancer smash beat knife arschloch wichser missgeburt hurensohn fresse "
    "verpiss dummes schlampe connard salope salaud enculé crève crever pute imbécile idiota imbécil gilipollas puta mierda cabrón zorra muérete otário burro merda идиот дурак сука тварь мразь сдохни ублюдок",
    "hate": "vermin subhuman rats cockroach cockroaches breed disease foreigners immigrants unbelievers rapists thieves retards gays wiped invaders savages animals "
    "ausländer ungeziefer kanaken racaille bougnoules понаехали",
    "sexual": "porn porno xxx nude nudes naked pussy cock cum cams blowjob slut whore tits horny suck strip fuck sex boobs dick babes ficken geile nackte nues baiser chattes desnudas follar foder gostosa шлюха порно голые",
}
_HAN_SEEDS = {"insult": ("蠢货", "废物", "去死", "畜生", "闭嘴", "垃圾", "砍死"), "hate": ("害虫", "滚出去", "赶出去"), "sexual": ("色情", "裸体", "做爱")}

_SENTENCE = re.compile(r"(?<=[.!?…])[\"'”’)]*\s+|(?<=[。！？])|[\r\n]+")
_HIDDEN = re.compile("[­​-‏⁠-⁤﻿]")
_HAN = re.compile(r"[㐀-鿿]+")
_MASKED = re.compile(r"[^\W\d_]+\*+[^\W\d_]*|[^\W\d_]*\*{2,}[^\W\d_]*")
_PARTED = re.compile(r"^\W*(?:[^\W_][.\-_*·•]){2,}[^\W_]?\W*$")
_QUOTE = re.compile("[\"“”„«»]")
_LOOKS = str.maketrans("@$0134572968|!авеикмнорстухіѕјԁһѵԛԝАВЕКМНОРСТУХ", "aso" + "i" + "eastz" + "gbb" + "ii" + "abeukmhopctyxisjdhvqwABEKMHOPCTYX")
_LEET = str.maketrans("@$013457|!", "aso" + "ieast" + "ii")

_cache: dict = {}


def _fold(word: str) -> str:
    """l and i as one letter, runs of a letter as one, accents dropped."""
    word = "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c)).replace("l", "i")
    short = re.sub(r"(.)\1+", r"\1", word)
    return short * 2 if len(short) == 1 < len(word) else short


def canonical(raw: str) -> tuple[str, ...]:
    """The canonical words of a run without spaces."""
    hit = _cache.get(raw)
    if hit is None:
        if len(_cache) > 500_000:
            _cache.clear()
        hit = _cache[raw] = _canonical(raw)
    return hit


def _canonical(raw: str) -> tuple[str, ...]:
    text = _HIDDEN.sub("", raw)
    text = unicodedata.normalize("NFKC", text).lower()
    if _PARTED.match(text):
        text = re.sub(r"[.\-_*·•]", "", text)
    if "*" in text and (m := _MASKED.search(text)):
        text = m.group()
        return (f"*{len(text)}{text[0] if text[0] != '*' else ''}.{text[-1] if text[-1] != '*' else ''}",)
    if re.search(r"[a-z]", text) and re.search(r"[а-яіѕјԁһѵ]", text):
        text = text.translate(_LOOKS)
    elif re.search(r"[a-z]", text) and re.search(r"[@$0-9|!](?=\S)", text) or re.fullmatch(r"[@$013457|!]*[@$][@$013457|!a-z]*|[0-9]*[013457]+[0-9]*'?[013457a-z]+\W*|\W*[0157]{2}\W*|\W*\d*[@$]\S*", text):
        text = re.sub(r"(?<=\S)[!|]+$", "", text).translate(_LEET)
    out: list[str] = []
    for word in re.findall(r"[^\W_]+", text):
        if _HAN.search(word):
            for run in _HAN.findall(word):
                out += [run[i : i + n] for n in (2, 3, 4) for i in range(len(run) - n + 1)] or [run]
        elif word.isdigit():
            out.append("0")
        else:
            out.append(_fold(word))
    return tuple(out)


def sentences(text: str) -> list[str]:
    return [s for s in _SENTENCE.split(text) if s and not s.isspace()]


def words(sentence: str) -> list[str]:
    return [w for raw in sentence.split() for w in canonical(raw)]


def _lexicon() -> dict[str, set[str]]:
    if "lexicon" not in _cache:
        _cache["lexicon"] = {c: {_fold(w) for w in LEXICON[c].split()} | set(_HAN_SEEDS[c]) for c in CATEGORIES}
    return _cache["lexicon"]


def features(tokens: list[str], sentence: str) -> set[str]:
    """Words, pairs of words, hits in the lexicon, and signs of quotation."""
    out = set(tokens)
    plain = [t for t in tokens if not _HAN.match(t)]
    out.update(f"{a} {b}" for a, b in zip(plain, plain[1:]))
    for c, seeds in _lexicon().items():
        hits = sum(t in seeds for t in set(tokens))
        if hits:
            out.add(f"#{c}")
        if hits > 1:
            out.add(f"#{c}+")
    if _QUOTE.search(sentence):
        out.add("#quote")
    if any(t[:1] == "*" for t in tokens):
        out.add("#masked")
    return out


def _distinct(x: np.ndarray) -> np.ndarray:
    """Sorted, without repeats (faster here than by hashing)."""
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


# Signs of a word beside its number (which takes the low bits): written in Chinese, masked, of which categories of the lexicon;
# and for a run of characters: holds a quotation mark, has no word.
_NUMBER, _IS_HAN, _IS_MASKED, _LEX, _QUOTED, _NO_WORD = (1 << 22) - 1, 1 << 22, 1 << 23, 24, 1 << 28, 1 << 29


class Model:
    """Chain of linear models: ``index`` of the features, ``weights`` (features x models), ``bias``, ``link`` (earlier chances)."""

    def __init__(self, index: dict[str, int], weights: np.ndarray, bias: np.ndarray, link: np.ndarray) -> None:
        self.index, self.weights, self.bias, self.link = index, weights, bias, link
        pairs = [(f.split(" ", 1), i) for f, i in index.items() if " " in f]
        words = dict.fromkeys([f for f in index if " " not in f and f[0] != "#"])
        words.update(dict.fromkeys(w for (a, b), _ in pairs for w in (a, b)))
        words.update(dict.fromkeys(w for seeds in _lexicon().values() for w in seeds))
        self.numbers = {w: i for i, w in enumerate(words)}
        self.single = np.array([index.get(w, -1) for w in words], dtype=np.int64)
        keys = np.array([self.numbers[a] * len(words) + self.numbers[b] for (a, b), _ in pairs], dtype=np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pairs = keys[order], np.array([i for _, i in pairs], dtype=np.int64)[order]
        self.seen: dict[str, tuple[int, ...]] = {}

    def _codes(self, raw: str) -> tuple[int, ...]:
        """The words of a run of characters without spaces, each as its number (from 1, 0 for one that no feature knows) with its signs."""
        out = []
        for w in canonical(raw):
            code = self.numbers.get(w, -1) + 1
            if _HAN.match(w):
                code |= _IS_HAN
            if w[:1] == "*":
                code |= _IS_MASKED
            for j, c in enumerate(CATEGORIES):
                if w in _lexicon()[c]:
                    code |= 1 << (_LEX + j)
            out.append(code)
        if _QUOTE.search(raw):
            out = [out[0] | _QUOTED, *out[1:]] if out else [_QUOTED | _NO_WORD]
        return tuple(out)

    def known(self, cut: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """``(sentence, feature)`` of sentences: what ``features`` gives for each, as far as it is in the index, in order."""
        runs = [s.split() for s in cut]
        flat = list(chain.from_iterable(runs))
        if len(self.seen) > 500_000:
            self.seen.clear()
        self.seen.update((raw, self._codes(raw)) for raw in set(flat).difference(self.seen))
        each = list(map(self.seen.__getitem__, flat))
        codes = np.fromiter(chain.from_iterable(each), dtype=np.int64)
        owner = np.repeat(np.repeat(np.arange(len(runs)), [len(r) for r in runs]), np.fromiter(map(len, each), dtype=np.int64, count=len(each)))
        number = (codes & _NUMBER) - 1
        got: list[tuple[np.ndarray, np.ndarray]] = []
        at = np.flatnonzero(number >= 0)
        feature = self.single[number[at]]
        got.append((owner[at][feature >= 0], feature[feature >= 0]))
        at = np.flatnonzero(codes & (_IS_HAN | _NO_WORD) == 0)
        a, b, o = number[at][:-1], number[at][1:], owner[at]
        near = np.flatnonzero((o[:-1] == o[1:]) & (a >= 0) & (b >= 0))
        if len(near) and len(self.pairs):
            key = a[near] * len(self.single) + b[near]
            place = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pairs) - 1)
            hit = self.pair_keys[place] == key
            got.append((o[near][hit], self.pairs[place[hit]]))
        for j, c in enumerate(CATEGORIES):
            at = np.flatnonzero(codes >> (_LEX + j) & 1)
            if len(at):
                which, times = np.unique(_distinct(owner[at] * (_NUMBER + 1) + number[at]) // (_NUMBER + 1), return_counts=True)
                got += [(which, np.full(len(which), self.index[f"#{c}"])), (which[times > 1], np.full(int((times > 1).sum()), self.index[f"#{c}+"]))]
        for sign, f in ((_QUOTED, "#quote"), (_IS_MASKED, "#masked")):
            which = _distinct(owner[np.flatnonzero(codes & sign)])
            got.append((which, np.full(len(which), self.index[f])))
        size = len(self.index)
        all_of = _distinct(np.concatenate([o * size + f for o, f in got]))
        return all_of // size, all_of % size

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """For each text the chances of insult, hate, sexual and abusive: the greatest over all its sentences.

        A sentence without any feature of the index adds nothing: for it the chain knows only its bias.
        """
        cut = [sentences(t) if isinstance(t, str) else [] for t in texts]
        best = np.zeros((len(texts), len(CATEGORIES) + 1))
        which, feature = self.known(list(chain.from_iterable(cut)))
        if not len(which):
            return best
        starts = np.flatnonzero(np.concatenate(([True], which[1:] != which[:-1])))
        z = self.bias + np.add.reduceat(self.weights[feature], starts, axis=0)
        out = np.zeros_like(z)
        for j in range(z.shape[1]):
            out[:, j] = 1 / (1 + np.exp(-np.clip(z[:, j] + out[:, :j] @ self.link[j, :j], -500, 500)))
        text = np.repeat(np.arange(len(texts)), [len(c) for c in cut])
        np.maximum.at(best, text[which[starts]], out)
        return best


def _fit(rows: list[np.ndarray], y: np.ndarray, weight: np.ndarray, size: int, prior: np.ndarray, extra: np.ndarray, reg: float = 1.0) -> tuple[np.ndarray, float, np.ndarray]:
    """Logistic regression drawn to ``prior`` (Adam on the whole sample): weights, bias, weights of ``extra``."""
    flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    k = extra.shape[1]
    w, b, v = prior.copy(), -1.0, np.zeros(k)
    m1, m2 = np.zeros(size + k + 1), np.zeros(size + k + 1)
    for t in range(1, STEPS + 1):
        z = b + np.bincount(owner, weights=w[flat], minlength=len(rows)) + extra @ v
        g = weight * (1 / (1 + np.exp(-z)) - y)
        grad = np.concatenate((np.bincount(flat, weights=g[owner], minlength=size) + reg * (w - prior), extra.T @ g + 0.1 * reg * v, [g.sum()]))
        m1 = 0.9 * m1 + 0.1 * grad
        m2 = 0.99 * m2 + 0.01 * grad * grad
        step = 0.25 * (1 - t / (STEPS + 1)) * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-8)
        w, v, b = w - step[:size], v - step[size : size + k], b - step[-1]
    return w, float(b), v


def _fold_of(key) -> int:
    return hashlib.blake2b(repr(key).encode(), digest_size=4).digest()[0] % FOLDS


def fit(docs: list[tuple[object, str, float, frozenset[str]]]) -> Model:
    """Fit on ``(id, text, share of abusive verdicts, categories named)``."""
    lexicon = _lexicon()
    seeds = frozenset().union(*lexicon.values())
    cut = [(key, share, cats, [(s, words(s)) for s in sentences(text)]) for key, text, share, cats in docs]
    bad, good = Counter(), Counter()
    n_bad = n_good = 1
    for _, share, _, parts in cut:
        seen = {t for _, tokens in parts for t in tokens}
        if share > 0.5:
            bad.update(seen)
            n_bad += 1
        else:
            good.update(seen)
            n_good += 1
    odds = {t: np.log((c + 0.3) / n_bad) - np.log((good[t] + 0.3) / n_good) for t, c in bad.items() if c >= 3}
    triggers = frozenset(t for t, x in odds.items() if x > 2.0) | seeds
    chosen, plain = [], []
    for d, (key, share, _, parts) in enumerate(cut):
        for i, (_, tokens) in enumerate(parts):
            (chosen if share > 0.5 or not triggers.isdisjoint(tokens) else plain).append((d, i))
    some = plain
    if len(plain) > MAX_PLAIN:
        some = sorted(plain, key=lambda x: hashlib.blake2b(repr((cut[x[0]][0], x[1])).encode(), digest_size=8).digest())[:MAX_PLAIN]
    owner = np.array([d for d, _ in chosen + some], dtype=np.int64)
    sents = [(tokens, features(tokens, s)) for d, i in chosen + some for s, tokens in [cut[d][3][i]]]
    sure = np.array([not triggers.isdisjoint(tokens) for tokens, _ in sents], dtype=bool)
    weight = np.where(sure, 1.0, min(1.0, (sure.sum() + n_bad) / max(1, (~sure).sum())))
    counts = Counter(f for _, fs in sents for f in fs)
    kept = [f for f, n in counts.most_common(MAX_FEATURES) if n >= 2 or f[0] == "#"]
    index = {f: i for i, f in enumerate(kept)}
    for f in [f"#{c}{p}" for c in CATEGORIES for p in ("", "+")] + ["#quote", "#masked"]:
        index.setdefault(f, len(index))
    size = len(index)
    rows = [np.fromiter((index[f] for f in fs if f in index), dtype=np.int64) for _, fs in sents]
    share = np.array([x[1] for x in cut])
    labelled = share[owner] if len(owner) else np.zeros(0)
    folds = np.array([_fold_of(cut[d][0]) for d in owner], dtype=np.int64)
    prior = np.zeros((size, len(CATEGORIES) + 1))
    for j, c in enumerate(CATEGORIES):
        prior[index[f"#{c}"], [j, 3]] = 1.2, 1.2
        prior[index[f"#{c}+"], [j, 3]] = 1.2, 1.2
    prior[index["#quote"], :] = -1.0
    none = np.zeros((len(rows), 0))
    guess = np.array([sum(max(0.0, odds.get(t, 0.0)) for t in set(tokens)) + 2 * ("#masked" in fs) for tokens, fs in sents]) + 10 * sure
    positive = np.zeros(len(rows), bool)
    chance = guess
    for i in range(ROUNDS):
        # of each document found abusive the likeliest sentence, and every other that is as good as sure
        best: dict[int, int] = {}
        for r in np.flatnonzero((labelled > 0.5) & (sure | (chance > (PLAIN_CHANCE if i else 0)))):
            d = int(owner[r])
            if d not in best or chance[r] > chance[best[d]]:
                best[d] = int(r)
        positive[:] = False
        positive[list(best.values())] = True
        if i:
            positive |= (labelled > 0.5) & (chance > 0.8)
            weight[positive] = 1.0
        use = positive | (labelled < 0.5)
        at = np.flatnonzero(use)
        if i == ROUNDS - 1:
            break
        chance = np.zeros(len(rows))
        for k in range(FOLDS):
            part = at[folds[at] != k]
            w, b, _ = _fit([rows[r] for r in part], positive[part].astype(float), weight[part], size, prior[:, 3], none[part])
            for r in np.flatnonzero(folds == k):
                chance[r] = 1 / (1 + np.exp(-(b + w[rows[r]].sum())))
    weights, bias, link = np.zeros((size, 4)), np.zeros(4), np.zeros((4, 4))
    extra = np.zeros((len(rows), 0))
    for j in range(len(CATEGORIES) + 1):
        if j < len(CATEGORIES):
            target = positive & np.array([CATEGORIES[j] in cut[d][2] for d in owner], dtype=bool)
            usable = use & (~positive | np.array([bool(cut[d][2]) for d in owner], dtype=bool))
        else:
            target, usable = positive, use
        at = np.flatnonzero(usable)
        out = np.zeros(len(rows))
        if j < len(CATEGORIES):
            for k in range(FOLDS):
                part = at[folds[at] != k]
                w, b, v = _fit([rows[r] for r in part], target[part].astype(float), weight[part], size, prior[:, j], extra[part])
                for r in np.flatnonzero(folds == k):
                    out[r] = 1 / (1 + np.exp(-(b + w[rows[r]].sum() + extra[r] @ v)))
        weights[:, j], bias[j], link[j, :j] = _fit([rows[r] for r in at], target[at].astype(float), weight[at], size, prior[:, j], extra[at])
        extra = np.column_stack((extra, out))
    return Model(index, weights, bias, link)


def labelled_sample(documents: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> list[tuple[object, str, float, frozenset[str]]]:
    """At most ``most`` labelled documents (those first by a hash of their id), with the share of verdicts for abuse.

    Of these the documents count up to the one that brings their characters to ``MAX_LABELLED_CHARS``. Only the verdicts are
    broadcast, at most ``most`` rows; the documents stay where they are.
    """
    verdicts = labels.filter(F.col("label").isin("abusive", "ok") & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.avg(F.when(F.col("label") == "abusive", 1.0).otherwise(0.0)).alias("share"), F.collect_set("category").alias("cats"))
    chosen = verdicts.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = documents.select("doc_id", "text").filter("text <> ''")
    sizes = texts.select("doc_id", F.length("text").cast("long").alias("chars")).join(F.broadcast(chosen), "doc_id")
    before = F.sum("chars").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, -1))  # at most ``most`` rows
    kept = sizes.withColumn("before", before).filter(F.coalesce("before", F.lit(0)) < MAX_LABELLED_CHARS).select("doc_id", "share", "cats").dropDuplicates(["doc_id"])
    rows = texts.join(F.broadcast(kept), "doc_id").collect()
    return sorted(((r["doc_id"], r["text"], r["share"], frozenset(r["cats"])) for r in rows), key=lambda x: repr(x[0]))


def _scorer(shared):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for frame in frames:
            texts = frame["text"].tolist()
            out = np.concatenate([model.scores(texts[i : i + 512]) for i in range(0, len(texts), 512)] or [np.zeros((0, 4))])
            yield pd.DataFrame({"doc_id": frame["doc_id"], "source": frame["source"], "insult": out[:, 0], "hate": out[:, 1], "sexual": out[:, 2], "score": out[:, 3]})

    return run


def scores(documents: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> DataFrame:
    """``doc_id, source, insult, hate, sexual, score``: one row per row of ``documents`` (``doc_id, text, source``).

    Null and empty texts score 0, repeated rows are scored each for itself, an empty table gives no rows, without labels the
    lexicon alone decides, and other columns are not read.
    """
    shared = documents.sparkSession.sparkContext.broadcast(fit(labelled_sample(documents, labels, most)))
    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = documents.select("doc_id", "text", "source")
    cores = documents.sparkSession.sparkContext.defaultParallelism
    if rows.rdd.getNumPartitions() < cores:
        rows = rows.repartition(cores, "doc_id")
    return rows.mapInPandas(_scorer(shared), f"doc_id {kind}, source string, insult double, hate double, sexual double, score double")


def rates(scored: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``source, documents, found, rate`` per source in lower case (null stays a source of its own)."""
    return scored.groupBy(F.lower("source").alias("source")).agg(
        F.count(F.lit(1)).alias("documents"), F.count_if(F.col("score") > threshold).alias("found")).withColumn("rate", F.col("found") / F.col("documents"))
