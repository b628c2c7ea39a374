"""Token files: compressed ones with an index, and flat ones without.

Indexed: rows are blocks of consecutive documents in ascending id. A block holds each document's ids compressed
on its own by zstandard with a dictionary trained on serialized id arrays, the offset of each, and the hash of
the dictionary, which lies beside. Flat: one stream of ids a file, cut into blocks of equal size wherever that
falls; only the end-of-document id tells where a document ends. Both are written by Spark's own committer, so
they land in any store that Spark writes, and a lost executor's half-written files never show.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import clean_text, shared_dir, staged
from .tokens import vocabulary_path, worker_encoder

#: Bounds of the sample that the dictionary is trained on: documents, characters of each; and its size.
SAMPLE, EXCERPT, DICTIONARY = 2000, 4000, 1 << 16
BLOCK_DOCS, BLOCK_IDS = 256, 1 << 20


def _ordered(docs: DataFrame, text: str, id_col: str) -> DataFrame:
    """(doc_id, text) dealt out and sorted by id, null first, repeated ids by a hash of the text, and equal rows as they are read, so
    that very many of them aren't one task's."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), clean_text(text).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text")).withColumn("nth", F.monotonically_increasing_id())
    order = ("doc_id", "tie", "nth")
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")


def serialized(ids: bytes) -> bytes:
    """Ids (unsigned 32-bit) as they are compressed: unsigned 16-bit under a leading byte 2 where all fit, else byte 4."""
    import numpy as np

    wide = np.frombuffer(ids, "<u4")
    return b"\x02" + wide.astype("<u2").tobytes() if not len(wide) or wide.max() < 65536 else b"\x04" + ids


def deserialized(data: bytes) -> bytes:
    import numpy as np

    return np.frombuffer(data, "<u2", offset=1).astype("<u4").tobytes() if data[:1] == b"\x02" else data[1:]


def _drawn(docs: DataFrame, text: str, id_col: str) -> list[str]:
    """Excerpts of the SAMPLE rows of the smallest hashes in the whole table, so each part of it has its share.

    The place of a row is hashed too: repeated rows don't fall together. Only rows under a bound that about 1.5 times
    as many fall under are sorted."""
    body, bound = clean_text(text), min(1.0, 1.5 * SAMPLE / max(docs.count(), 1))
    rows = docs.select(F.xxhash64(F.lit(3), id_col, body, F.monotonically_increasing_id()).alias("h"), body.alias("t"))
    some = rows.filter(F.shiftrightunsigned("h", 11) / float(1 << 53) <= bound).select("h", F.substring("t", 1, EXCERPT).alias("t"))
    return [r.t for r in some.orderBy("h", "t").limit(SAMPLE).collect()]


def train(docs: DataFrame, text: str, path: str, end_id: int, id_col: str = "doc_id") -> bytes:
    """A zstandard dictionary from a bounded sample of the whole table; the samples themselves where they are too few."""
    import zstandard

    encode, end = worker_encoder(path), end_id.to_bytes(4, "little")
    samples = [serialized(encode(t) + end) for t in _drawn(docs, text, id_col)]
    try:
        return zstandard.train_dictionary(DICTIONARY, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY:]


def write_indexed(docs: DataFrame, folder: str, text: str = "text", id_col: str = "doc_id", end_id: int = 2, path: str | None = None) -> None:
    """Writes the documents' ids, each document ended by end_id, to folder/dictionary and folder/blocks.

    Null text is empty and gives the end id alone. An empty table gives no block."""
    import hashlib

    spark = docs.sparkSession
    path = path or vocabulary_path()
    raw = train(docs, text, path, end_id, id_col)
    mark = hashlib.sha256(raw).hexdigest()
    spark.createDataFrame([(mark, bytearray(raw))], "hash string, dictionary binary").coalesce(1).write.parquet(f"{folder}/dictionary")
    held, size, most = spark.sparkContext.broadcast(raw), BLOCK_DOCS, BLOCK_IDS

    def run(batches):
        import pyarrow as pa
        import zstandard
        from pyspark import TaskContext

        part, block = TaskContext.get().partitionId(), 0
        encode, end = worker_encoder(path), end_id.to_bytes(4, "little")
        kind = {"dict_data": zstandard.ZstdCompressionDict(held.value)} if held.value else {}
        compress = zstandard.ZstdCompressor(level=1, **kind).compress
        ids, counts, frames = [], [], []

        def flush():
            nonlocal block, ids, counts, frames
            offsets = [0]
            for f in frames:
                offsets.append(offsets[-1] + len(f))
            cols = [[part], [block], [ids], [counts], [offsets], [mark], [b"".join(frames)]]
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.string(), pa.binary()]
            block, ids, counts, frames = block + 1, [], [], []
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["part", "block", "doc_ids", "n_tokens", "offsets", "dictionary", "data"])

        held_ids = 0
        for batch in batches:
            for doc_id, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = encode(x.as_py()) + end
                ids.append(doc_id)
                counts.append(len(own) // 4)
                frames.append(compress(serialized(own)))
                held_ids += counts[-1]
                if len(ids) >= size or held_ids >= most:
                    yield flush()
                    held_ids = 0
        if ids:
            yield flush()

    shape = "part long, block long, doc_ids array<long>, n_tokens array<long>, offsets array<long>, dictionary string, data binary"
    _ordered(docs, text, id_col).mapInArrow(run, shape).write.option("compression", "none").parquet(f"{folder}/blocks")


def read_indexed(spark: SparkSession, folder: str, only: list[int] | None = None) -> DataFrame:
    """doc_id, part, block, place (in the block), before (ids before it in its block), ids: from the files.

    With only, blocks that hold none of these documents are skipped and just their frames decompressed."""
    mark, raw = spark.read.parquet(f"{folder}/dictionary").first()
    held = spark.sparkContext.broadcast(bytes(raw))
    blocks = spark.read.parquet(f"{folder}/blocks").select("part", "block", "doc_ids", "n_tokens", "offsets", "dictionary", "data")
    wanted = None
    if only is not None:
        wanted = set(only)
        blocks = blocks.filter(F.arrays_overlap("doc_ids", F.array(*[F.lit(int(x)).cast("long") for x in only])))

    def run(batches):
        import pyarrow as pa
        import zstandard

        kind = {"dict_data": zstandard.ZstdCompressionDict(held.value)} if held.value else {}
        decompress = zstandard.ZstdDecompressor(**kind).decompress
        for batch in batches:
            for r in range(batch.num_rows):
                part, block, ids, counts, offsets, own = (batch.column(c)[r].as_py() for c in range(6))
                if own != mark:
                    raise ValueError(f"block {part}/{block} was written with dictionary {own}, found {mark}")
                data, rows, before = batch.column(6)[r].as_buffer(), [], 0
                for k, doc_id in enumerate(ids):
                    if wanted is None or doc_id in wanted:
                        rows.append((doc_id, part, block, k, before, deserialized(decompress(data[offsets[k] : offsets[k + 1]]))))
                    before += counts[k]
                if rows:
                    kinds = [pa.int64()] * 5 + [pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["doc_id", "part", "block", "place", "before", "ids"])

    return blocks.mapInArrow(run, "doc_id long, part long, block long, place long, before long, ids binary")


def block_starts(spark: SparkSession, folder: str) -> DataFrame:
    """(part, block, start): ids before each block, by a prefix sum over the files, then over the blocks of each."""
    each = spark.read.parquet(f"{folder}/blocks").select("part", "block", F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    files = each.groupBy("part").agg(F.sum("n").alias("all"))
    files = files.select("part", (F.sum("all").over(Window.orderBy("part")) - F.col("all")).alias("base"))
    within = F.sum("n").over(Window.partitionBy("part").orderBy("block")) - F.col("n")
    return each.withColumn("within", within).join(files, "part").select("part", "block", (F.col("base") + F.col("within")).alias("start"))


def write_flat(docs: DataFrame, folder: str, text: str = "text", id_col: str = "doc_id", end_id: int = 50256, block_bytes: int = 1 << 20, path: str | None = None) -> None:
    """Writes a flat stream of unsigned 16-bit ids for each partition of docs, its file, in blocks (file, block, data)
    of block_bytes but for the last; and between them the documents' ids in the same order (file, first, doc_ids).

    Null text is empty and gives the end id alone. Ids over 65,535, and an end id that occurs within a text, are
    errors: what is read back would be wrong. An empty table gives no block."""
    path = path or vocabulary_path()

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        file, block, held, seen = TaskContext.get().partitionId(), 0, bytearray(), 0
        encode, end = worker_encoder(path), end_id.to_bytes(4, "little")

        def row(block, data, first, ids):
            cols = [[file], [block], [data], [first], [ids]]
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["file", "block", "data", "first", "doc_ids"])

        for batch in batches:
            for x in batch.column(1):
                ids = np.frombuffer(encode(x.as_py()) + end, "<u4")
                if ids.max() > 0xFFFF:
                    raise ValueError(f"id {ids.max()} doesn't fit 16 bits")
                if (ids[:-1] == end_id).any():
                    raise ValueError(f"end id {end_id} is the id of a text's token")
                held += ids.astype("<u2").tobytes()
                while len(held) >= block_bytes:
                    yield row(block, bytes(held[:block_bytes]), None, None)
                    del held[:block_bytes]
                    block += 1
            yield row(None, None, seen, batch.column(0).to_pylist())
            seen += batch.num_rows
        if held:
            yield row(block, bytes(held), None, None)

    shape = "file long, block long, data binary, first long, doc_ids array<long>"
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), clean_text(text).alias("text"))
    rows.mapInArrow(run, shape).write.option("compression", "zstd").parquet(folder)


def scan_flat(stream: DataFrame, end_id: int = 50256, dtype: str = "<u2") -> DataFrame:
    """(file, ordinal, n_tokens) of each document of flat, unindexed token files, end ids included.

    stream: (file, block, data). Each block is searched at once for end ids; a prefix scan over a file's blocks
    gives how many documents and how many ids of an unended one come before each block. Ids after the last end id
    of a file count as a document of their own.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            rows = []
            for file, block, data in zip(*(batch.column(c) for c in ("file", "block", "data"))):
                ids = np.frombuffer(data.as_buffer(), dtype)
                at = np.flatnonzero(ids == end_id)
                rows.append((file.as_py(), block.as_py(), len(ids), int(at[-1]) + 1 if len(at) else None, np.diff(at, prepend=-1).tolist()))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["file", "block", "n", "last", "lengths"])

    blocks = stream.select("file", "block", "data").mapInArrow(run, "file long, block long, n long, last long, lengths array<long>")
    blocks = staged(blocks, "blocks")
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    thin = blocks.select("file", "block", "n", "last", F.size("lengths").cast("long").alias("ends"))
    thin = thin.withColumn("begin", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("seen", F.coalesce(F.sum("ends").over(before), F.lit(0)))
    open_since = F.coalesce(F.max(F.col("begin") + F.col("last")).over(before), F.lit(0))
    thin = thin.withColumn("carried", F.col("begin") - open_since)
    whole = blocks.select("file", "block", F.posexplode("lengths").alias("k", "length")).join(thin.select("file", "block", "seen", "carried"), ["file", "block"])
    whole = whole.select("file", (F.col("seen") + F.col("k")).alias("ordinal"), (F.col("length") + F.when(F.col("k") == 0, F.col("carried")).otherwise(0)).alias("n_tokens"))
    tail = thin.groupBy("file").agg(F.sum("n").alias("n"), F.sum("ends").alias("ends"), F.max(F.col("begin") + F.col("last")).alias("last"))
    tail = tail.select("file", F.col("ends").alias("ordinal"), (F.col("n") - F.coalesce("last", F.lit(0))).alias("n_tokens")).filter("n_tokens > 0")
    return whole.unionByName(tail)


def token_counts(docs: DataFrame, text: str = "text", id_col: str = "doc_id", end_id: int = 50256, folder: str | None = None, **how) -> DataFrame:
    """(doc_id, n_tokens) of each document, its end id counted, by way of flat files: written, scanned, and named by place.

    Null and empty texts count 1. Repeated rows, and rows that share an id or have none, are counted each. An empty
    table gives none."""
    import uuid

    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark)}/flat-{uuid.uuid4().hex}"
    write_flat(docs, folder, text, id_col, end_id, **how)
    files = spark.read.parquet(folder)
    counted = scan_flat(files.filter("data is not null"), end_id)
    names = files.filter("doc_ids is not null").select("file", "first", F.posexplode("doc_ids").alias("k", "doc_id"))
    names = names.select("file", (F.col("first") + F.col("k")).alias("ordinal"), "doc_id")
    return names.join(counted, ["file", "ordinal"]).select("doc_id", "n_tokens")
