"""Problem 7: encode a whole corpus with a public tokenizer by a distinct-word shuffle.

Plan: texts are cut into pre-tokens, block by block. A block of documents yields one row per distinct word of the block with the
word's positions, so a frequent word costs one row per block and never one per occurrence. These rows are a written table. Its
distinct words are counted (pre-aggregated), and each is encoded once, into a second table. The ids are joined back by word: of
the ``HOT_WORDS`` words that stand in the most blocks they are broadcast, a table of bounded size, so the rows of a hot word are
not shuffled by it; the others meet in a shuffle. A shuffle by block puts the ids at their positions.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspark.llm.stage import written

#: Folder of the public vocabularies; a parameter of every function below.
DEFAULT_FOLDER = os.environ.get("DOCSPARK_TOKENIZERS", "/opt/tokenizers")

#: Fixed value: the pre-token pattern of the byte-level vocabularies. White space is Unicode's White_Space property, which is
#: what ``\s`` means to the public encoders (Python's ``\s`` also has 1C-1F).
SPLIT = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)

#: A block holds about this many pre-tokens (positions then fit in 16 bits); a longer text is a block of its own.
BLOCK_TOKENS = 60_000
BLOCK_DOCS = 4_096
#: Words whose ids are broadcast: those in the most blocks, of at most this length. This bounds the broadcast (a few MB).
HOT_WORDS, HOT_CHARS = 50_000, 32

_cache: dict = {}


def vocabulary_path(name: str, folder: str | None = None) -> str:
    return os.path.join(folder or DEFAULT_FOLDER, name + ".tiktoken")


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def parse_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(tok): int(rank) for tok, rank in map(bytes.split, raw.splitlines()) if tok}


def _splitter():
    """A function that cuts a text into pre-tokens.

    Texts within the basic plane (nearly all) go through the standard library's engine with the classes spelled out, which is
    more than twice as fast; the others through ``regex``, from which the classes are taken, so both cut alike.
    """
    if "split" not in _cache:
        import re

        import regex

        full = regex.compile(SPLIT)
        plane = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)]))

        def spelled(prop: str) -> str:
            return "".join(f"{re.escape(m[0][0])}-{re.escape(m[0][-1])}" for m in regex.finditer(prop + "+", plane))

        let, num, gap = spelled(r"\p{L}"), spelled(r"\p{N}"), spelled(r"\p{White_Space}")
        basic = re.compile(
            f" ?[{let}]+|'(?:s|t|re|ve|m|ll|d)| ?[{num}]+| ?[^{gap}{let}{num}]+|[{gap}]+(?![^{gap}])|[{gap}]+"
        ).findall
        beyond = re.compile("[\U00010000-\U0010ffff]").search
        _cache["split"] = lambda text: full.findall(text) if beyond(text) else basic(text)
    return _cache["split"]


def _encoder(raw: bytes):
    key = ("enc", hash(raw))
    if key not in _cache:
        import tiktoken

        _cache[key] = tiktoken.Encoding("public", pat_str=r"[\s\S]+", mergeable_ranks=parse_ranks(raw), special_tokens={})
    return _cache[key]


def encode_words(words: list[str], raw: bytes) -> list[list[int]]:
    """Ids of each pre-token by the byte-pair merges of the vocabulary (the encoder's pattern takes a word as one piece)."""
    return _encoder(raw).encode_ordinary_batch(words, num_threads=1)


def _block_rows(key: int, texts: list[list[str]], ids: list) -> dict[str, list]:
    counts = [len(t) for t in texts]
    every = list(chain.from_iterable(texts))
    index = {w: i for i, w in enumerate(dict.fromkeys(every))}
    codes = np.fromiter(map(index.__getitem__, every), dtype=np.int32, count=len(every))
    words = list(index) or [""]
    order = np.argsort(codes, kind="stable")
    cuts = np.concatenate(([0], np.cumsum(np.bincount(codes, minlength=len(words)))))
    steps = np.diff(order, prepend=0)  # from one position of a word to its next
    first = cuts[:-1][np.diff(cuts) > 0]
    steps[first] = order[first]
    order = steps.astype(np.uint32 if len(codes) > 65_535 else np.uint16)
    carrier = key % len(words)
    return {
        "block": [key] * len(words),
        "word": words,
        "pos": [order[cuts[i] : cuts[i + 1]].tobytes() for i in range(len(words))],
        "total": [len(codes)] * len(words),
        "doc_ids": [ids if i == carrier else None for i in range(len(words))],
        "doc_counts": [counts if i == carrier else None for i in range(len(words))],
    }


def _make_blocks(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        find, ctx = _splitter(), TaskContext.get()
        base, n = (ctx.partitionId() if ctx else 0) << 32, 0
        texts: list[list[str]] = []
        ids: list = []
        held = 0
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                toks = find(text) if text else []
                if texts and (held + len(toks) > BLOCK_TOKENS or len(texts) >= BLOCK_DOCS):
                    yield pa.RecordBatch.from_pydict(_block_rows(base | n, texts, ids), schema=schema)
                    texts, ids, held, n = [], [], 0, n + 1
                texts.append(toks)
                ids.append(key)
                held += len(toks)
        if texts:
            yield pa.RecordBatch.from_pydict(_block_rows(base | n, texts, ids), schema=schema)

    return run


def _columns(table: pa.Table, *names: str) -> list[pa.Array]:
    return [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in map(table.column, names)]


def _ordered(table: pa.Table) -> tuple[np.ndarray, list, np.ndarray]:
    """Of a block's rows: the row whose word stands at each position, the documents, and their numbers of words."""
    total = table.column("total")[0].as_py()
    (places,) = _columns(table, "pos")
    kind = np.dtype(np.uint32 if total > 65_535 else np.uint16)
    cuts = np.frombuffer(places.buffers()[1], dtype=np.int32)[places.offset : places.offset + len(places) + 1]
    steps = np.frombuffer(places.buffers()[2], dtype=np.uint8)[cuts[0] : cuts[-1]].view(kind).astype(np.int64) if total else np.zeros(0, np.int64)
    each = np.diff(cuts) // kind.itemsize
    ends = np.cumsum(each)
    sums = np.cumsum(steps)
    before = np.concatenate(([0], sums))[ends - each]
    codes = np.zeros(total, dtype=np.int64)
    codes[sums - np.repeat(before, each)] = np.repeat(np.arange(len(places)), each)
    (ids,) = _columns(table, "doc_ids")
    where = int(np.flatnonzero(ids.is_valid().to_numpy(zero_copy_only=False))[0])
    return codes, ids[where].as_py(), np.array(table.column("doc_counts")[where].as_py(), dtype=np.int64)


def _reassemble(schema: pa.Schema):
    def run(table: pa.Table) -> pa.Table:
        codes, doc_ids, counts = _ordered(table)
        (words,) = _columns(table, "ids")
        cuts = np.frombuffer(words.buffers()[1], dtype=np.int32)[words.offset : words.offset + len(words) + 1] // 4
        flat = np.frombuffer(words.buffers()[2], dtype=np.int32) if cuts[-1] else np.zeros(0, np.int32)
        each = np.diff(cuts).astype(np.int64)[codes]
        ends = np.cumsum(each)
        at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(cuts[:-1].astype(np.int64)[codes] - (ends - each), each)
        token_ends = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(counts)))]
        lists = pa.ListArray.from_arrays(pa.array(token_ends, pa.int32()), pa.array(flat[at], pa.int32()))
        return pa.Table.from_arrays([pa.array(doc_ids, type=schema.field(0).type), lists.cast(schema.field(1).type)], schema=schema)

    return run


def _added(schema: pa.Schema):
    def run(table: pa.Table) -> pa.Table:
        codes, doc_ids, counts = _ordered(table)
        ends = np.concatenate(([0], np.cumsum(table.column("n_ids").to_numpy().astype(np.int64)[codes])))[np.concatenate(([0], np.cumsum(counts)))]
        return pa.Table.from_arrays([pa.array(doc_ids, type=schema.field(0).type), pa.array(np.diff(ends), pa.int64())], schema=schema)

    return run


def _joined(df: DataFrame, id_col: str, text_col: str, tokenizer: str, folder: str | None, column: Column) -> DataFrame:
    """The rows of the blocks, each with ``column`` of its word's row ``(word, ids binary, n_ids)``."""
    from pyspark.sql.pandas.types import to_arrow_schema

    raw = df.sparkSession.sparkContext.broadcast(read_ranks(vocabulary_path(tokenizer, folder)))  # fixed size, under 1 MB
    id_type = df.schema[id_col].dataType
    cut = T.StructType(
        [
            T.StructField("block", T.LongType()),
            T.StructField("word", T.StringType()),
            T.StructField("pos", T.BinaryType()),
            T.StructField("total", T.IntegerType()),
            T.StructField("doc_ids", T.ArrayType(id_type)),
            T.StructField("doc_counts", T.ArrayType(T.IntegerType())),
        ]
    )
    # the order of the rows names the blocks, so they are written once and every later step reads the same ones
    rows = written(df.select(F.col(id_col), F.col(text_col)).mapInArrow(_make_blocks(to_arrow_schema(cut)), cut))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = encode_words(batch.column(0).to_pylist(), raw.value)
            packed = [np.array(x, dtype=np.int32).tobytes() for x in ids]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(packed, pa.binary()), pa.array(list(map(len, ids)), pa.int32())], names=["word", "blocks", "ids", "n_ids"])

    words = rows.groupBy("word").agg(F.count(F.lit(1)).alias("blocks"))
    words = written(words.mapInArrow(encode, "word string, blocks long, ids binary, n_ids int"))
    often = words.filter((F.col("blocks") > 1) & (F.length("word") <= HOT_CHARS)).orderBy(F.desc("blocks"), "word").limit(HOT_WORDS)
    hot = F.broadcast(written(often).select("word", column))  # at most HOT_WORDS rows
    near = rows.join(hot, "word")
    far = rows.join(hot.select("word"), "word", "left_anti").join(words.select("word", column), "word")
    return near.unionByName(far).drop("word")


def encode_corpus(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k", folder: str | None = None
) -> DataFrame:
    """One row ``(id_col, ids)`` per input row; ids of the text without special tokens.

    Null and empty texts give an empty list, rows with a null or repeated id stay rows of their own, strings that look like
    special tokens are ordinary text, an empty table gives an empty table, and other columns of ``df`` are not read.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    made = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    joined = _joined(df, id_col, text_col, tokenizer, folder, F.col("ids"))
    return joined.groupBy("block").applyInArrow(_reassemble(to_arrow_schema(made)), made)


def token_counts(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k", folder: str | None = None
) -> DataFrame:
    """One row ``(id_col, size)`` per input row: the number of ids that ``encode_corpus`` would give it."""
    from pyspark.sql.pandas.types import to_arrow_schema

    made = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("size", T.LongType())])
    joined = _joined(df, id_col, text_col, tokenizer, folder, F.col("n_ids"))
    return joined.groupBy("block").applyInArrow(_added(to_arrow_schema(made)), made)


def token_bytes(spark: SparkSession, tokenizer: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """The vocabulary as a table ``(id, bytes)``: fixed size, about 50,000 rows."""
    ranks = parse_ranks(read_ranks(vocabulary_path(tokenizer, folder)))
    table = pa.table({"id": pa.array(list(ranks.values()), pa.int32()), "bytes": pa.array(list(ranks.keys()), pa.binary())})
    return spark.createDataFrame(table)


def _utf8(parts: Column) -> Column:
    return F.decode(F.unhex(F.array_join(F.transform(F.array_sort(parts), lambda x: F.hex(x["bytes"])), "")), "UTF-8")


def decode_corpus(
    df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", tokenizer: str = "byte_bpe_50k", folder: str | None = None
) -> DataFrame:
    """``(id_col, text)`` of lists of ids (ids unique): ids are joined with the token-byte table and put together in order.

    An empty or null list gives an empty text. The broadcast table is the vocabulary, of fixed size.
    """
    vocab = F.broadcast(token_bytes(df.sparkSession, tokenizer, folder).withColumnRenamed("id", "__id"))
    parts = df.select(F.col(id_col), F.posexplode_outer(ids_col).alias("__pos", "__id"))
    parts = parts.join(vocab, "__id", "left").select(id_col, F.struct("__pos", "bytes").alias("__p"))
    return parts.groupBy(id_col).agg(F.collect_list("__p").alias("__p")).select(
        id_col, F.coalesce(_utf8(F.col("__p")), F.lit("")).alias("text")
    )
