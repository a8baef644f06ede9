"""Source documents: schema, items, files, union with dedupe, sitemaps, crawl, and the manifest as a source."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspark.functions.clean import inferred_title
from docspark.functions.html import extract_links, parse_sitemap
from docspark.functions.pytext import optional_int, stable_id, strip, text_or_empty
from docspark.functions.urls import same_domain, url_allowed
from docspark.sources.storage import checkpoint_folder

NO_ORDER = 999_999
MEDIA = {"md": "text/markdown", "markdown": "text/markdown", "html": "text/html", "htm": "text/html", "txt": "text/plain"}
ITEM = T.StructType([
    T.StructField("seq", T.LongType()), T.StructField("url", T.StringType()), T.StructField("title", T.StringType()),
    T.StructField("section", T.StringType()), T.StructField("doc_order", T.IntegerType()), T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
])


def with_identity(df: DataFrame) -> DataFrame:
    """``title`` inferred and ``doc_id`` made of URL, path, title and order (an order of 0 counts as missing)."""
    titled = df.withColumn("title", inferred_title(F.col("title"), F.col("source_path")))
    order = F.when(F.col("doc_order") != 0, F.col("doc_order").cast("string"))
    return titled.withColumn("doc_id", stable_id(F.col("source_url"), F.col("source_path"), F.col("title"), order))


def dedupe_key() -> Column:
    return F.coalesce(F.nullif("source_url", F.lit("")), F.nullif("source_path", F.lit("")), F.col("doc_id"))


def first_wins(df: DataFrame, rank: str = "source_rank", seq: str = "seq") -> DataFrame:
    """The first document of each key in the order of the sources and of acquisition."""
    order = Window.partitionBy("__key").orderBy(rank, seq)
    return df.withColumn("__key", dedupe_key()).withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__key", "__n")


def source_order() -> list[Column]:
    return [text_or_empty(F.col("section")), F.coalesce("doc_order", F.lit(NO_ORDER)), text_or_empty(F.col("title")), F.col("seq")]


def union_sources(parts: list[DataFrame]) -> DataFrame:
    """Sources in their given order, united, deduped and sorted by section, order and title."""
    ranked = [p.withColumn("source_rank", F.lit(i)) for i, p in enumerate(parts)]
    whole = ranked[0]
    for p in ranked[1:]:
        whole = whole.unionByName(p, allowMissingColumns=True)
    return first_wins(whole).orderBy(*source_order())


def url_items(spark: SparkSession, items: list, url_file: str = "") -> DataFrame:
    """Configured items (strings or mappings), then the lines of a file without blanks and comments."""
    rows = [dict(x) if isinstance(x, dict) else {"url": str(x)} for x in items]
    if url_file:
        lines = (x.strip() for x in Path(url_file).read_text(encoding="utf-8").splitlines())
        rows += [{"url": x} for x in lines if x and not x.startswith("#")]
    out = []
    for i, r in enumerate(rows):
        url = str(r.get("url") or "").strip()
        if not url:
            raise ValueError("a source item has no URL")
        order = r.get("order")
        rest = {str(k): str(v) for k, v in r.items() if not str(k).startswith("_")}
        out.append((i, url, str(r.get("title") or ""), str(r.get("section") or ""), None if order in (None, "") else int(order), rest))
    return spark.createDataFrame(out, ITEM)


def items_to_documents(items: DataFrame, pages: DataFrame) -> DataFrame:
    """Items with their fetched pages ``(url, raw_text, content_type, error)``; hidden metadata keys are dropped.

    An item whose page failed or is missing keeps its row, with an empty text and the ``error``.
    """
    if "error" not in pages.columns:
        pages = pages.withColumn("error", F.lit(None).cast("string"))
    read = pages.select("url", "raw_text", "content_type", "error").withColumn("__there", F.lit(True))
    failed = F.when(F.col("__there").isNull(), "no page was given").when(F.col("raw_text").isNull(), F.coalesce("error", F.lit("the page has no text")))
    joined = items.join(read, "url", "left").select(
        "seq", "title", text_or_empty(F.col("raw_text")).alias("raw_text"), failed.alias("error"), F.col("url").alias("source_url"), F.lit("").alias("source_path"), "section", "doc_order",
        F.coalesce(F.nullif("content_type", F.lit("")), F.lit("text/html")).alias("media_type"),
        F.map_filter("metadata", lambda k, _: ~k.startswith("_")).alias("metadata"))
    return with_identity(joined)


def sitemap_items(sitemaps: DataFrame) -> DataFrame:
    """``doc_order, url`` over all sitemaps ``(seq, xml)``: the locations are counted through from 1; indexes are not followed."""
    rows = sitemaps.select("seq", F.posexplode(parse_sitemap("xml")).alias("pos", "url"))
    sizes = rows.groupBy("seq").count()
    before = F.coalesce(F.sum("count").over(Window.orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row per sitemap
    return rows.join(sizes.select("seq", before.alias("before")), "seq").select((F.col("before") + F.col("pos") + 1).cast("int").alias("doc_order"), "url")


def local_documents(spark: SparkSession, items: list[dict], resolve: Callable[[str], Path] = Path) -> DataFrame:
    """Markdown, HTML and text files as documents; wrong bytes become replacement characters."""
    rows = []
    for i, item in enumerate(items):
        item = dict(item) if isinstance(item, dict) else {"path": str(item)}
        path = resolve(str(item.get("path") or ""))
        media = MEDIA.get(path.suffix.lower().lstrip("."))
        if media is None:
            raise ValueError(f"unsupported kind of file: {path}")
        if not path.exists():
            raise FileNotFoundError(path)
        order = item.get("order")
        rest = {str(k): str(v) for k, v in item.items() if k != "path"}
        rows.append((i, str(path), path.resolve().as_uri(), str(item.get("title") or path.stem), str(item.get("section") or ""), None if order in (None, "") else int(order), media, rest))
    schema = "seq long, source_path string, uri string, title string, section string, doc_order int, media_type string, metadata map<string,string>"
    if not rows:
        return with_identity(spark.createDataFrame([], schema).select("seq", "title", F.lit("").alias("raw_text"), F.lit("").alias("source_url"), "source_path", "section", "doc_order", "media_type", "metadata"))
    decode = F.pandas_udf(lambda s: s.map(lambda b: bytes(b).decode("utf-8", "replace")), "string")
    names = F.regexp_replace("path", "^file:/+", "file:///")
    files = spark.read.format("binaryFile").load(sorted({r[2] for r in rows})).select(names.alias("uri"), decode("content").alias("raw_text"))
    joined = spark.createDataFrame(rows, schema).join(files, "uri")
    return with_identity(joined.select("seq", "title", "raw_text", F.lit("").alias("source_url"), "source_path", "section", "doc_order", "media_type", "metadata"))


def crawl(
    pages: DataFrame, starts: list[str], max_pages: int, same_host: bool = True, include: list[str] = (), exclude: list[str] = (),
    fetch: Callable[[list[str], int], DataFrame] | None = None) -> DataFrame:
    """Breadth-first over a table of pages ``(url, html, content_type)``: ``doc_order, url`` of the pages reached.

    A level is one join of its frontier with the pages; the links of its pages, first come first, less everything visited, are
    the next frontier. The order is that of a queue: level, place of the parent, place of the link. URLs that are turned away or
    have no page are visited too, but are not counted. Every level is a checkpoint. With ``fetch`` the pages of a level are those
    it gives for the URLs of the frontier in their order and the number still wanted, and ``pages`` only lends its session.
    """
    spark = pages.sparkSession
    checkpoint_folder(spark)
    empty = spark.createDataFrame([], "doc_order int, url string")
    if not starts or max_pages <= 0:
        return empty
    pages = pages.dropDuplicates(["url"]).checkpoint() if fetch is None else pages
    front = spark.createDataFrame([(i, u) for i, u in enumerate(dict.fromkeys(starts))], "place long, url string")
    visited, out, found = front.select("url"), empty, 0
    while True:
        ok = front.filter(url_allowed(F.col("url"), list(include), list(exclude)))
        ok = ok.filter(same_domain(F.col("url"), starts)) if same_host else ok
        if fetch is not None:
            pages = fetch([r.url for r in ok.orderBy("place").select("url").collect()], max_pages - found).dropDuplicates(["url"])
        got = ok.join(pages, "url").orderBy("place").limit(max_pages - found)
        ranked = got.withColumn("doc_order", F.row_number().over(Window.orderBy("place")) + found).checkpoint()  # at most max_pages rows
        n = ranked.count()
        if not n:
            return out
        found += n
        out = out.unionByName(ranked.select("doc_order", "url")).checkpoint()
        if found >= max_pages:
            return out
        open_pages = ranked.filter(F.coalesce(F.lower("content_type").contains("html"), F.lit(False)) | F.col("html").contains("<a "))
        links = open_pages.select("doc_order", F.posexplode(extract_links("url", "html")).alias("pos", "link"))
        first = links.groupBy(F.col("link").alias("url")).agg(F.min(F.struct("doc_order", "pos")).alias("at")).join(visited, "url", "left_anti")
        # in the order of a sort the ids grow; they need not be dense
        front = first.orderBy("at").withColumn("place", F.monotonically_increasing_id()).select("place", "url").checkpoint()
        visited = visited.unionByName(front.select("url")).checkpoint()


def from_manifest(manifest: DataFrame, raw: DataFrame, clean: DataFrame) -> DataFrame:
    """Documents of an earlier run: the raw text of each entry, else its clean text, else none.

    ``manifest``: ``seq, doc_id, title, source_url, source_path, section, doc_order, raw_path, clean_text_path``; ``raw`` and
    ``clean``: ``path, text``.
    """
    r, c = raw.select(F.col("path").alias("raw_path"), F.col("text").alias("__raw")), clean.select(F.col("path").alias("clean_text_path"), F.col("text").alias("__clean"))
    joined = manifest.join(r, "raw_path", "left").join(c, "clean_text_path", "left").filter("__raw is not null or __clean is not null")
    page = F.col("__raw").isNotNull() & F.lower("raw_path").rlike(r"\.html?$")
    return joined.select(
        "seq", "doc_id", F.coalesce(F.nullif("title", F.lit("")), F.lit("Untitled")).alias("title"), F.coalesce("__raw", "__clean").alias("raw_text"),
        text_or_empty(F.col("source_url")).alias("source_url"), text_or_empty(F.col("source_path")).alias("source_path"), text_or_empty(F.col("section")).alias("section"),
        optional_int(F.col("doc_order")).alias("doc_order"), F.when(page, "text/html").otherwise("text/markdown").alias("media_type"))


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """A segment manifest: a JSON array; anything else raises an error."""
    text = spark.read.text(path, wholetext=True).select(strip(F.col("value")).alias("v"))
    checked = F.when(F.col("v").startswith("["), F.col("v")).otherwise(F.raise_error(F.lit("a segment manifest must be a JSON array")).cast("string"))
    item = "array<struct<index:int,text:string,chars:int,pause_reason:string,pause_after_ms:int,status:string,audio_path:string,retry_count:int,error:string>>"
    return text.select(F.explode(F.from_json(checked, item)).alias("s")).select(F.col("s.index").alias("segment_index"), *[f"s.{c}" for c in ("text", "chars", "pause_reason", "pause_after_ms", "status", "audio_path", "retry_count", "error")])
