"""Problem 4: the main body of each page, by tree scoring.

A page is read into a tree of blocks. Paragraphs pass points for their length and commas to their parent and, halved, to the
one above, discounted by the share of the text that is linked; the best container and its like siblings are kept, and inside
them blocks that are prompts or lists of teasers are taken out again. What tells a prompt from a short paragraph is that it
recurs: every block is counted, with digits and the site's name masked, over the pages of its site and over the sites
(pre-aggregated, one row per page and block); recurring blocks earn no points. Selectors of the project are taken as hints
only, since they match nothing on some pages and the wrong thing on others.

A page is parsed once: its tree is written beside the keys of its blocks, and the decision reads the tree back.
"""

from __future__ import annotations

import functools
import html
import marshal
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import HOT_ROWS, is_html, join_hot, site_of
from docspark.llm.stage import slices, written

# HTML elements by their part in the tree.
INLINE = frozenset("a abbr b bdi bdo big br cite code del dfn em font i img ins kbd mark q s samp small strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HIDDEN = frozenset("script style noscript template svg head title iframe".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
KEPT = frozenset("ul ol dl blockquote pre table figure code".split())
LEAVES = frozenset("p li dt dd option".split()) | HEADINGS

#: A block longer than this is a prompt only if it recurs as LONG_PAGES and LONG_SHARE say: edited copies of an article share long blocks.
SHORT = 160
LONG_PAGES, LONG_SHARE = 5, 0.3
#: A block recurs in its site: pages with other titles that have it, at least, and their share of the site's pages.
SITE_PAGES, SITE_SHARE = 3, 0.05
#: In a site of few pages two are enough at this share.
FEW_SHARE = 0.25
#: A block recurs everywhere: sites that have it, at least.
SITES = 4

_TOKEN = re.compile(r"(<!--.*?-->|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>)", re.S)
_ATTR = re.compile(r"""([a-zA-Z_:-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_PATH = re.compile(r"^[^.!?。！？]{1,60}( / [^.!?。！？]{1,80}){2,}$")
_DIGITS = re.compile(r"\d+")
_CJK = re.compile(r"[㐀-鿿豈-﫿぀-ヿ]")


class Page:
    """The tree of a page: nodes, and leaf blocks with their text and lines."""

    def __init__(self, raw: str) -> None:
        self.tags, self.parents, self.attrs = ["#root"], [-1], {}
        self.leaf_of: dict[int, int] = {}
        self.leaf_node: list[int] = []
        self.parts: list[list[str]] = []
        self.linked: list[int] = []
        self.lines: list[list[int]] = []
        self.body_line = 0
        self.title = ""
        self._read(raw)
        self.texts = [" ".join("".join(p).split()) for p in self.parts]

    def _read(self, raw: str) -> None:
        stack, line, links, hidden = [0], 1, 0, None
        has_text: set[int] = set()
        tags, parents, attrs_of = self.tags, self.parents, self.attrs

        def text(piece: str, line: int) -> None:
            node = stack[-1]
            while tags[node] in INLINE:
                node = parents[node]
            if "&" in piece:
                rows = [html.unescape(row) for row in piece.split("\n")]
            else:
                rows = piece.split("\n") if "\n" in piece else (piece,)
            for shown in rows:
                if shown and not shown.isspace():
                    leaf = self.leaf_of.get(node)
                    if leaf is None:
                        leaf = self.leaf_of[node] = len(self.leaf_node)
                        self.leaf_node.append(node)
                        self.parts.append([shown])
                        self.linked.append(0)
                        self.lines.append([line])
                        has_text.add(node)
                    elif self.lines[leaf][-1] == line:
                        self.parts[leaf].append(shown)
                    else:
                        self.parts[leaf].append(" " + shown)
                        self.lines[leaf].append(line)
                    if links:
                        self.linked[leaf] += len(shown.strip())
                line += 1

        # texts and tags in turn: text, tag, slash, name, attributes, text ...
        parts = _TOKEN.split(raw)
        for at in range(0, len(parts) - 1, 5):
            between, whole, closing, name, attrs = parts[at : at + 5]
            if between:
                if hidden is None:
                    if not between.isspace():
                        text(between, line)
                elif hidden == "title":
                    self.title += between
                line += between.count("\n")
            if "\n" in whole:
                line += whole.count("\n")
            if not name:
                continue
            name = name.lower()
            if hidden is not None:
                if closing and name == hidden:
                    hidden = None
                continue
            if name == "body" and not closing and not self.body_line:
                # what stood before is not part of the page
                self.body_line = line
                self.leaf_of, self.leaf_node, self.parts, self.linked, self.lines, has_text, stack, links = {}, [], [], [], [], set(), [0], 0
            if closing:
                if name == "a" and links:
                    links -= 1
                for i in range(len(stack) - 1, 0, -1):
                    if tags[stack[i]] == name:
                        del stack[i:]
                        break
            elif name in HIDDEN and name != "head":
                if attrs[-1:] != "/":
                    hidden = name
            elif name not in VOID:
                if name == "a":
                    links += 1
                elif name not in INLINE:
                    links = 0
                    # an unclosed paragraph or list item that has text ends where the next block begins
                    while len(stack) > 1 and (tags[stack[-1]] in INLINE or (tags[stack[-1]] in LEAVES and stack[-1] in has_text)):
                        stack.pop()
                tags.append(name)
                parents.append(stack[-1])
                if attrs:
                    attrs_of[len(tags) - 1] = attrs
                if attrs[-1:] != "/":
                    stack.append(len(tags) - 1)
        if parts[-1] and hidden is None:
            text(parts[-1], line)

    def packed(self) -> bytes:
        """The tree as bytes."""
        return marshal.dumps((self.tags, self.parents, self.attrs, self.leaf_node, self.linked, self.lines, self.texts, self.body_line, self.title))

    @classmethod
    def unpacked(cls, raw: bytes) -> Page:
        page = cls.__new__(cls)
        page.tags, page.parents, page.attrs, page.leaf_node, page.linked, page.lines, page.texts, page.body_line, page.title = marshal.loads(raw)
        page.leaf_of = {node: leaf for leaf, node in enumerate(page.leaf_node)}
        return page

    def article_part(self, leaf: int) -> bool:
        """Headings, and blocks in lists, quotations, code and tables within a list of their own."""
        node = self.leaf_node[leaf]
        if self.tags[node] in HEADINGS or self.tags[node] in KEPT:
            return True
        above = self.tags[self.parents[node]]
        return above in ("ul", "ol", "dl", "blockquote", "pre") and self.tags[node] in ("li", "dt", "dd", "p", "code")


def site_name(host: str | None, title: str) -> str:
    """The site's name as it may stand in texts: from the host, else the end of the page's title."""
    if host:
        return host.split(".")[0].replace("-", " ").lower()
    return html.unescape(title).rsplit(" - ", 1)[-1].strip().lower() if " - " in title else ""


def masked(text: str, name: str) -> str:
    low = text.lower()
    if len(name) > 3:
        low = low.replace(name, "\x00")
    return _DIGITS.sub("0", low)


@functools.lru_cache(10_000)
def _step(selector: str | None) -> tuple | None:
    step = re.split(r"[\s>+~]+", (selector or "").strip())[-1]
    m = re.fullmatch(r"([a-zA-Z][\w-]*)?(?:\.([\w-]+))?(?:#([\w-]+))?(?:\[([\w-]+)=[\"']?([^\]\"']*)[\"']?\])?", step)
    return m.groups() if step and m else None


@functools.lru_cache(10_000)
def _attributes(raw: str) -> dict[str, str]:
    return {a.lower(): html.unescape(x or y or z) for a, x, y, z in _ATTR.findall(raw)}


def matches(page: Page, node: int, selector: str | None) -> bool:
    """Whether a simple selector (``tag``, ``.class``, ``#id``, ``tag.class``, ``tag[attr=value]``, last step of a path) fits."""
    step = _step(selector)
    if step is None or (step[0] and page.tags[node] != step[0].lower()):
        return False
    if node not in page.attrs:
        return bool(step[0]) and not any(step[1:])
    tag, cls, ident, attr, value = step
    have = _attributes(page.attrs[node])
    return (
        (not cls or cls in have.get("class", "").split())
        and (not ident or have.get("id") == ident) and (not attr or have.get(attr) == value)
    )


def _weight(text: str) -> float:
    return len(text) + (0.0 if text.isascii() else 2.0 * len(_CJK.findall(text)))


def decide(page: Page, recurs: set[int], content: str | None = None, remove: list[str] | None = None) -> list[bool]:
    """For each leaf whether it is main body."""
    n = len(page.leaf_node)
    if not n:
        return []
    tags, parents, leaf_node, texts = page.tags, page.parents, page.leaf_node, page.texts
    nodes = len(tags)
    weights = [_weight(t) for t in texts]
    kinds = [tags[x] for x in leaf_node]
    removed = set()
    for s in remove or []:
        # only a selector that is no more than a tag fits a node without attributes
        removed.update(x for x in (page.attrs if any((_step(s) or ())[1:]) else range(1, nodes)) if matches(page, x, s))
    lists: dict[int, list[int]] = {}
    part = [page.article_part(i) for i in range(n)]
    for i in range(n):
        if part[i]:
            lists.setdefault(parents[leaf_node[i]], []).append(i)
    for items in lists.values():  # a list is a menu only if most of it recurs
        if sum(i in recurs for i in items) < 0.6 * len(items):
            recurs = recurs.difference(items)
    clear = [i not in recurs and not (" / " in texts[i] and _PATH.match(texts[i])) for i in range(n)]
    within = [False] * nodes  # inside an element to remove
    for x in range(1, nodes) if removed else ():
        within[x] = x in removed or within[parents[x]]
    points: dict[int, float] = {}
    # sums over the leaves below a node; children come after their parents, so one pass backwards adds them up
    total, linked, below, first = [0.0] * nodes, [0.0] * nodes, [0] * nodes, [n] * nodes
    heavy, plain = [False] * nodes, [True] * nodes
    for i in range(n):
        text, node, w = texts[i], leaf_node[i], weights[i]
        share = min(1.0, page.linked[i] / max(1, len(text)))
        own = 0.0
        if clear[i] and w >= 20:
            own = (1 + (text.count(",") + text.count("，") + text.count("、")) * 0.5 + min(w / 100, 6.0)) * (1 - share)
            if kinds[i] in HEADINGS:
                own = 1.0
        elif clear[i]:
            own = 0.3 * (1 - share)
        if kinds[i] == "h1":
            own = 6.0
        if own and within[node]:
            own *= 0.5
        step = 1.0
        up = node if kinds[i] not in LEAVES and kinds[i] not in ("pre", "blockquote", "span", "code") and len(page.lines[i]) > 1 else parents[node]
        while up >= 0 and step > 0.1:
            points[up] = points.get(up, 0.0) + own * step
            step *= 0.9 if tags[up] in KEPT else 0.5
            up = parents[up]
        up = parents[node]
        total[up] += w
        linked[up] += w * share
        below[up] += 1
        first[up] = min(first[up], i)
        if kinds[i] in HEADINGS:
            heavy[up], plain[up] = True, False
        elif w > 2 * SHORT:
            plain[up] = False
            heavy[up] |= w > 2.2 * SHORT
        heavy[up] |= kinds[i] in KEPT
    for x in range(nodes - 1, 0, -1):
        if below[x]:
            up = parents[x]
            total[up] += total[x]
            linked[up] += linked[x]
            below[up] += below[x]
            first[up] = min(first[up], first[x])
            heavy[up] |= heavy[x]
            plain[up] &= plain[x]

    def headed(node: int) -> bool:
        """The first block below the node is its child and recurs."""
        return bool(below[node]) and first[node] in recurs and parents[leaf_node[first[node]]] == node

    best, score = 0, -1.0
    for node, got in points.items():
        if tags[node] in KEPT:
            continue
        if node:
            got *= 1 - 0.8 * linked[node] / max(1.0, total[node])
            if plain[node] and headed(node):
                got *= 0.3  # a box with a recurring head
            if content and matches(page, node, content):
                got *= 1.5
        if got > score:
            best, score = node, got

    def box(node: int) -> bool:
        """A box of teasers or prompts inside the main container: a recurring head, or links only, and nothing long."""
        if not below[node] or heavy[node] or tags[node] in KEPT or tags[node] in ("tr", "tbody", "html", "body", "#root"):
            return False
        return headed(node) or below[node] > 1 and linked[node] > 0.7 * total[node]

    chosen = {best} if best else set()
    if best:
        around = parents[best]
        for node in range(1, nodes):
            if node != best and parents[node] == around and tags[node] not in ("nav", "footer", "header", "aside"):
                i = page.leaf_of.get(node)
                if i is not None:
                    if clear[i] and weights[i] > 80 and page.linked[i] < 0.3 * len(texts[i]):
                        chosen.add(node)
                elif points.get(node, 0) > 0.35 * score and not box(node) and linked[node] < 0.5 * (total[node] or 1):
                    chosen.add(node)
    inside, dropped = [best == 0] * nodes, [False] * nodes  # by the nearest chosen node above, and the boxes on the way to it
    for x in range(1, nodes):
        if x in chosen:
            inside[x] = True
        elif x not in page.leaf_of or below[x]:
            inside[x], dropped[x] = inside[parents[x]], dropped[parents[x]] or box(x)
    keep = [False] * n
    for i, node in enumerate(leaf_node):
        up = parents[node]
        good = node in chosen or inside[up] and not dropped[up]
        keep[i] = good and (clear[i] or (part[i] and (kinds[i] in HEADINGS or kinds[i] in ("pre", "code"))))
    if best and sum(weights[i] for i in range(n) if keep[i] and kinds[i] not in HEADINGS) < 200:
        # no more than a message stands where the content should: all of it is the body
        direct = [i for i in range(n) if parents[leaf_node[i]] == best and kinds[i] not in HEADINGS]
        if not direct and not any(keep):
            under = [False] * nodes
            for x in range(1, nodes):
                under[x] = x == best or under[parents[x]]
            direct = [i for i in range(n) if under[leaf_node[i]]]
        for i in direct:
            keep[i] = True
    return keep


BLOCK = pa.struct([("leaf", pa.int32()), ("key", pa.int64()), ("listed", pa.bool_()), ("long", pa.bool_())])
PARSED = "project_id long, site string, name string, title long, tree binary, blocks array<struct<leaf:int,key:long,listed:boolean,long:boolean>>"


def _parsed(id_type: pa.DataType):
    """From ``seq, project_id, site, raw_text``: the tree of each page, and the keys of its blocks but headings and lists of their own."""
    schema = pa.schema([("seq", id_type), ("project_id", pa.int64()), ("site", pa.string()), ("name", pa.string()), ("title", pa.int64()), ("tree", pa.binary()), ("blocks", pa.list_(BLOCK))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in slices(batches):
            sites, names, titles, trees, starts = [], [], [], [], [0]
            leaf, key, listed, long = [], [], [], []
            for host, raw in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                page = Page(raw)
                name = site_name(host, page.title)
                for i, text in enumerate(page.texts):
                    tag = page.tags[page.leaf_node[i]]
                    if text and tag not in HEADINGS and tag not in KEPT:
                        leaf.append(i)
                        key.append(xxh64_intdigest(masked(text, name)) - 2**63)
                        listed.append(page.article_part(i))
                        long.append(len(text) > SHORT)
                starts.append(len(leaf))
                sites.append(host or name or "")
                names.append(name)
                titles.append(xxh64_intdigest(page.title) >> 1)
                trees.append(page.packed())
            blocks = pa.StructArray.from_arrays([pa.array(leaf, pa.int32()), pa.array(key, pa.int64()), pa.array(listed, pa.bool_()), pa.array(long, pa.bool_())], fields=list(BLOCK))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sites, pa.string()), pa.array(names, pa.string()), pa.array(titles, pa.int64()), pa.array(trees, pa.binary()),
                                              pa.ListArray.from_arrays(pa.array(starts, pa.int32()), blocks)], schema=schema)

    return run


RESULTS = {"lines": "array<int>", "body": "string", "heads": "string", "prose": "string"}


def _decided(wanted: tuple[str, ...]):
    """From ``seq, name, tree, recurs, content_selector, remove_selectors``: the wanted ones of ``RESULTS``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out: dict[str, list] = {c: [] for c in wanted}
            for name, raw, recurs, content, remove in zip(*(batch.column(i).to_pylist() for i in range(1, 6))):
                page = Page.unpacked(raw)
                known = set(recurs or ())
                tags = [page.tags[x] for x in page.leaf_node]
                if len(name) > 3:  # a short block that names its own site is a prompt, a credit or an author's box
                    known |= {i for i, t in enumerate(page.texts) if len(t) <= SHORT and name in t.lower() and tags[i] not in HEADINGS}
                keep = decide(page, known, content, remove)
                kept = [i for i, k in enumerate(keep) if k]
                if "lines" in out:
                    good = {x for i in kept for x in page.lines[i]}
                    out["lines"].append(sorted({x for i, k in enumerate(keep) if not k for x in page.lines[i] if x > page.body_line} - good))
                if "body" in out:
                    out["body"].append("\n".join([page.texts[i] for i in kept]))
                if "heads" in out:
                    out["heads"].append("\n".join([page.texts[i] for i in kept if tags[i] in HEADINGS]))
                if "prose" in out:
                    out["prose"].append("\n".join([page.texts[i] for i in kept if tags[i] not in HEADINGS and tags[i] not in ("pre", "code")]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(out[c], pa.list_(pa.int32()) if c == "lines" else pa.string()) for c in wanted)], names=["seq", *wanted])

    return run


def pages_of(df: DataFrame) -> DataFrame:
    return df.filter(is_html(F.col("media_type")) & (F.col("raw_text") != "")).select(
        "seq", site_of(F.col("source_url")).alias("site"), "raw_text", "project_id")


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt out by id before Python work where the table has fewer splits than there are cores (one row group is one task)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, "seq") if df.rdd.getNumPartitions() < cores else df


def main_bodies(df: DataFrame, config: DataFrame, wanted: tuple[str, ...] = tuple(RESULTS), after: tuple[Callable, str] | None = None) -> DataFrame:
    """``seq`` and the wanted ones of ``lines array<int>, body, heads, prose``: per HTML record the numbers of the lines that are
    not main body, the main body, its headings, and the rest of it without code.

    ``df`` has ``seq`` (unique), ``raw_text, source_url, media_type, project_id``; ``config`` has ``project_id,
    content_selector, remove_selectors``. Other columns are not read. Null and empty texts and records that are not HTML give
    no row; a page without visible text gives an empty body; a null project or null selectors mean no hints. With ``after``, a
    kernel over the batches of the result and its schema, those rows go on into it without leaving Python.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    of = df.schema["seq"].dataType
    kind = of.simpleString()
    hints = config.filter(F.col("project_id").isNotNull()).groupBy("project_id").agg(
        F.first("content_selector").alias("content_selector"), F.first("remove_selectors").alias("remove_selectors"))
    pages = spread(pages_of(df))
    # a page is parsed here and nowhere else; the tables read below are columns of this one
    parsed = written(pages.select("seq", F.col("project_id").cast("long").alias("project_id"), "site", "raw_text").mapInArrow(_parsed(to_arrow_type(of)), f"seq {kind}, {PARSED}"))
    parsed = parsed.withColumn("site", F.xxhash64("site"))
    blocks = parsed.select("seq", "site", "title", F.explode("blocks").alias("b")).select("seq", "site", "title", "b.*")
    seen = written(blocks.groupBy("site", "key").agg(F.countDistinct("title").alias("titles"), F.count(F.lit(1)).alias("n"), F.bool_or("long").alias("long"), F.bool_or(~F.col("listed")).alias("loose")))
    sizes = written(parsed.groupBy("site").agg(F.countDistinct("title").alias("of")))
    wide = written(seen.filter("loose and not long").groupBy("key").agg(F.count(F.lit(1)).alias("sites")).filter(F.col("sites") >= SITES).select("key", F.lit(True).alias("wide")))
    local = F.when(F.col("long"), (F.col("titles") >= LONG_PAGES) & (F.col("titles") >= LONG_SHARE * F.col("of"))).otherwise(
        (F.col("titles") >= SITE_PAGES) & (F.col("titles") >= SITE_SHARE * F.col("of")) | (F.col("titles") >= 2) & (F.col("titles") >= FEW_SHARE * F.col("of")))
    # a wide block stands in the rows of every site that has it
    known = written(seen.join(sizes, "site").join(wide, "key", "left").select("site", "key", local.alias("local"), "wide").filter("local or wide").select("site", "key", "local"))
    flags = join_hot(blocks, known, ["site", "key"], seen.filter(F.col("n") > HOT_ROWS), "seq").filter("local or not listed")
    flags = flags.groupBy("seq").agg(F.collect_set("leaf").alias("recurs"))
    full = parsed.select("seq", "project_id", "name", "tree").join(flags, "seq", "left").join(hints, "project_id", "left").select(
        "seq", "name", "tree", "recurs", "content_selector", "remove_selectors")
    decided = _decided(wanted)
    if after:
        kernel, schema = after
        return full.mapInArrow(lambda batches: kernel(decided(batches)), schema)
    return full.mapInArrow(decided, f"seq {kind}, " + ", ".join(f"{c} {RESULTS[c]}" for c in wanted))


def boilerplate_lines(df: DataFrame, config: DataFrame) -> DataFrame:
    """``seq, line_no``: lines that show a reader text that is not main body (see ``main_bodies``)."""
    return main_bodies(df, config, ("lines",)).select("seq", F.explode("lines").alias("line_no")).select("seq", F.col("line_no").cast("long").alias("line_no"))
