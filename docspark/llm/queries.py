"""Queries of the training-data operators, and their SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docspark.llm import encoding, lines, mainbody, neardup, packing, residue, splitting, stage, tokens, toxicity

QUERIES: dict = {}
SQL: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return tokens.encode_corpus(table(spark, sf_dir, "documents"), "doc_id", "text", "byte_bpe_50k")


@query
def p7_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text put together again from its ids."""
    return tokens.decode_corpus(tokens.encode_corpus(table(spark, sf_dir, "documents")))


SQL["p7_decoded"] = "SELECT doc_id, coalesce(text, '') AS text FROM documents"


@query
def p8_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every piece of every document, for each spec."""
    docs, specs = table(spark, sf_dir, "documents"), table(spark, sf_dir, "container_spec")
    sizes = stage.written(tokens.token_counts(docs))
    return packing.with_empty(packing.pack_items(sizes, specs), sizes.filter("size = 0"), specs).withColumnRenamed("item_id", "doc_id")


@query
def p8_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each spec, how many documents came out packed, and how often a rule was broken: a container filled beyond its capacity, a
    document divided without need or into more parts than it needs, a size that is not that of its tokens."""
    packed = stage.written(p8_packed(spark, sf_dir))
    boxes = packed.groupBy("spec_id", "container").agg(F.sum("size").alias("fill"), F.first("capacity_tokens").alias("capacity")).groupBy("spec_id").agg(
        F.count_if(F.col("fill") > F.col("capacity")).alias("overfull"))
    docs = packed.groupBy("spec_id", "doc_id").agg(F.count(F.lit(1)).alias("parts"), F.sum("size").alias("size"), F.first("capacity_tokens").alias("capacity"))
    needed = F.greatest(F.ceil(F.col("size") / F.col("capacity")), F.lit(1))
    sizes = tokens.encode_corpus(table(spark, sf_dir, "documents")).select("doc_id", F.size("ids").alias("tokens"))
    per = docs.join(sizes, "doc_id").groupBy("spec_id").agg(
        F.count(F.lit(1)).alias("documents"), F.count_if(F.col("parts") != needed).alias("divided"), F.count_if(F.col("size") != F.col("tokens")).alias("wrong_size"))
    return per.join(boxes, "spec_id").select("spec_id", "documents", "overfull", "divided", "wrong_size")


SQL["p8_rules"] = """
SELECT spec_id, (SELECT count(*) FROM documents) AS documents, CAST(0 AS BIGINT) AS overfull, CAST(0 AS BIGINT) AS divided, CAST(0 AS BIGINT) AS wrong_size
FROM container_spec WHERE capacity_tokens > 0
"""


@query
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines to remove: repeated excessively within their site."""
    return lines.repeated_lines(table(spark, sf_dir, "source_document"))


@query
def p3_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many repeated blocks of several lines each site has, by their length and the number of records they span."""
    found = lines.repeated(table(spark, sf_dir, "source_document")).filter("lines > 1")
    return found.groupBy("site", "lines", "records", "site_records").agg(F.count(F.lit(1)).alias("blocks"))


@query
def p3_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record without its repeated lines."""
    docs = table(spark, sf_dir, "source_document")
    return lines.without_lines(docs, lines.repeated_lines(docs)).select("seq", "clean_text")


_P3_LINES = r"""
WITH d AS (
  SELECT seq, raw_text, regexp_replace(lower(regexp_extract(source_url, '^\s*[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]*)', 1)), '^www\.', '') AS site
  FROM source_document
  WHERE raw_text <> '' AND source_url IS NOT NULL AND NOT contains(lower(coalesce(media_type, '')), 'html')
), r AS (SELECT * FROM d WHERE site <> ''),
n AS (SELECT site, count(*) AS n FROM r GROUP BY site),
l AS (
  SELECT seq, site, unnest(string_split(raw_text, chr(10))) AS line, generate_subscripts(string_split(raw_text, chr(10)), 1) AS line_no FROM r
), k AS (SELECT seq, site, CAST(line_no AS BIGINT) AS line_no, regexp_replace(lower(line), '[^\p{L}]+', '', 'g') AS key FROM l),
f AS (
  SELECT k.site, key FROM k JOIN n ON k.site = n.site WHERE key <> '' GROUP BY k.site, key, n.n
  HAVING count(DISTINCT seq) >= 5 AND count(DISTINCT seq) * 10 >= n.n
), found AS (SELECT seq, line_no FROM k JOIN f ON k.site = f.site AND k.key = f.key)
"""
# the runs of kept lines of each record, every block of two and more lines in them, and what follows it
SQL["p3_blocks"] = _P3_LINES + """
, o AS (SELECT k.seq, k.site, k.key, f.key IS NOT NULL AS kept, row_number() OVER (PARTITION BY k.seq ORDER BY line_no) AS i FROM k LEFT JOIN f ON k.site = f.site AND k.key = f.key WHERE k.key <> ''),
g AS (SELECT seq, site, key, i, i - row_number() OVER (PARTITION BY seq ORDER BY i) AS run FROM o WHERE kept),
p AS (SELECT seq, site, list(key ORDER BY i) AS keys FROM g GROUP BY seq, site, run HAVING count(*) > 1),
a AS (SELECT seq, site, keys, unnest(range(1, len(keys))) AS first FROM p),
b AS (SELECT seq, site, keys, first, unnest(range(first + 1, len(keys) + 1)) AS last FROM a),
c AS (SELECT seq, site, last - first + 1 AS lines, array_to_string(keys[first : last], chr(10)) AS block, keys[last + 1] AS next FROM b),
t AS (
  SELECT site, lines, block, count(DISTINCT seq) AS records FROM c GROUP BY site, lines, block
  HAVING count(*) FILTER (WHERE next IS NULL) > 0 OR count(DISTINCT next) > 1
)
SELECT t.site, CAST(lines AS INT) AS lines, records, n.n AS site_records, count(*) AS blocks FROM t JOIN n ON t.site = n.site WHERE records >= 5 AND records * 10 >= n.n GROUP BY ALL
"""
SQL["p3_found"] = _P3_LINES + "SELECT seq, line_no FROM found"
SQL["p3_cleaned"] = _P3_LINES + """
, al AS (
  SELECT seq, unnest(string_split(raw_text, chr(10))) AS line, CAST(generate_subscripts(string_split(raw_text, chr(10)), 1) AS BIGINT) AS line_no
  FROM source_document WHERE raw_text IS NOT NULL
), kept AS (
  SELECT al.seq, string_agg(line, chr(10) ORDER BY al.line_no) AS t FROM al ANTI JOIN found ON al.seq = found.seq AND al.line_no = found.line_no GROUP BY al.seq
)
SELECT s.seq, CASE WHEN s.raw_text IS NULL THEN NULL ELSE coalesce(kept.t, '') END AS clean_text FROM source_document s LEFT JOIN kept ON s.seq = kept.seq
"""


@query
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of HTML records that are not main body."""
    return mainbody.boilerplate_lines(table(spark, sf_dir, "source_document"), table(spark, sf_dir, "project_config"))


@query
def p4_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main body of every HTML record."""
    return mainbody.main_bodies(table(spark, sf_dir, "source_document"), table(spark, sf_dir, "project_config")).select("seq", "body")


def _p1(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    # the words and the share that the problem states
    return neardup.similar_records(table(spark, sf_dir, "source_document"), table(spark, sf_dir, "project_config"), size=3, threshold=0.5, least=60)


@query
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of near-duplicate records, copies included."""
    return neardup.all_pairs(*_p1(spark, sf_dir))


@query
def p1_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every record with a body of some length."""
    return neardup.classes(*_p1(spark, sf_dir)).withColumnRenamed("id", "seq")


def _p2(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda name: table(spark, sf_dir, name)
    return splitting.split_items(splitting.items(read("clean_document"), read("segment"), read("project_config")))


@query
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that had to be cut."""
    return _p2(spark, sf_dir).filter("piece_count > 1 and piece_no = 1").select("item_kind", "item_id")


@query
def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pieces of all items, in order."""
    return _p2(spark, sf_dir)


@query
def p2_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each kind of item, how many came out in pieces that cover their text, and how often a rule was broken: a piece beyond the
    limit, pieces that do not share the stated characters, a piece that is not what stands at its place, numbers with a gap."""
    read = lambda name: table(spark, sf_dir, name)
    these = splitting.items(read("clean_document"), read("segment"), read("project_config"))
    cut = splitting.split_items(these).withColumn("before", F.lag("end").over(Window.partitionBy("item_kind", "item_id").orderBy("piece_no")))
    both = cut.join(these.select("item_kind", "item_id", "text", "limit", "overlap"), ["item_kind", "item_id"])
    shared = F.greatest(F.col("before") - F.least("overlap", F.col("limit") - 1), F.lit(0))
    return both.groupBy("item_kind").agg(
        F.count_if((F.col("piece_no") == 1) & (F.col("start") == 0)).alias("begun"), F.count_if((F.col("piece_no") == F.col("piece_count")) & (F.col("end") == F.length("text"))).alias("ended"),
        F.count_if(F.length("piece") > F.col("limit")).alias("over_limit"), F.count_if(F.col("before").isNotNull() & (F.col("start") != shared)).alias("wrong_overlap"),
        F.count_if(F.col("piece") != F.substr("text", F.col("start") + 1, F.col("end") - F.col("start"))).alias("wrong_text"))


SQL["p2_rules"] = """
SELECT item_kind, n AS begun, n AS ended, CAST(0 AS BIGINT) AS over_limit, CAST(0 AS BIGINT) AS wrong_overlap, CAST(0 AS BIGINT) AS wrong_text FROM (
  SELECT 'chunk' AS item_kind, count(clean_text) AS n FROM clean_document UNION ALL SELECT 'segment', count(text) FROM segment)
"""


SQL["p2_found"] = """
WITH p AS (
  SELECT project_id, greatest(CASE WHEN chunk_chars > 0 THEN chunk_chars ELSE 2800 END, 800) AS c, CASE WHEN max_chars > 0 THEN max_chars ELSE 120 END AS m
  FROM project_config WHERE project_id IS NOT NULL
)
SELECT 'chunk' AS item_kind, clean_id AS item_id FROM clean_document d LEFT JOIN p ON d.project_id = p.project_id WHERE length(clean_text) > coalesce(c, 2800)
UNION ALL
SELECT 'segment', segment_id FROM segment s LEFT JOIN p ON s.project_id = p.project_id WHERE length(text) > coalesce(m, 120)
"""


@query
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that hold text decoded with a wrong encoding."""
    return encoding.garbled(table(spark, sf_dir, "source_document")).select("seq", "field")


@query
def p5_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain and the repaired text of every garbled field."""
    return encoding.repaired(table(spark, sf_dir, "source_document"))


@query
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with template residue, filler or a message where content should be."""
    return residue.residue(table(spark, sf_dir, "source_document"), table(spark, sf_dir, "project_config")).select("seq")


@query
def p6_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was found in each of these records."""
    return residue.residue(table(spark, sf_dir, "source_document"), table(spark, sf_dir, "project_config"))


@query
def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with abusive, hateful or sexual content."""
    scored = toxicity.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "review_label"))
    return scored.filter(F.col("score") > toxicity.THRESHOLD).select("doc_id")


@query
def p9_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its scores."""
    return toxicity.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "review_label"))


@query
def p9_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rate of every source."""
    return toxicity.rates(toxicity.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "review_label")))
