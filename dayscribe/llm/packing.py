"""Packing of documents into token sequences by bounded-space online best-fit.

Each partition keeps a fixed number of open windows. A piece goes into the window that it fills best; when it
fits none, the fullest window is topped up with the piece's head and emitted. What is left open in the end is
merged within the partition, then across partitions in rounds of a few partitions a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import clean_text, staged
from .tokens import REMEMBERED, vocabulary_path, worker_encoder

#: Open windows of a partition; partitions whose leftovers one task merges.
WINDOWS, FAN_IN = 16, 32
PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary, part long, open boolean"


class Packer:
    """Places pieces (doc_id, start, ids, doc_tokens); take() gives the rows of windows emitted since."""

    def __init__(self, length: int, windows: int, first_id: int):
        self.length, self.windows, self.next = length, windows, first_id
        self.open: list[list] = []  # [tokens held, pieces]
        self.out: list[tuple] = []

    def _emit(self, pieces) -> None:
        offset = 0
        for doc_id, start, ids, n in pieces:
            self.out.append((doc_id, start, len(ids) // 4, n, self.next, offset, ids))
            offset += len(ids) // 4
        self.next += 1

    def add(self, doc_id, start: int, ids: bytes, n: int) -> None:
        size = self.length
        while len(ids) >= 4 * size:
            self._emit([(doc_id, start, ids[: 4 * size], n)])
            start, ids = start + size, ids[4 * size :]
        while ids:
            need = len(ids) // 4
            fits = [w for w in self.open if w[0] + need <= size]
            if fits:
                own = max(fits, key=lambda w: w[0])
            elif len(self.open) < self.windows:
                self.open.append(own := [0, []])
            else:
                own = max(self.open, key=lambda w: w[0])
                need = size - own[0]
            own[1].append((doc_id, start, ids[: 4 * need], n))
            own[0] += need
            start, ids = start + need, ids[4 * need :]
            if own[0] == size:
                self._emit(own[1])
                self.open = [w for w in self.open if w is not own]

    def merge(self) -> list[tuple]:
        """Fills the fullest windows from the others; returns the pieces of the one window that stays open."""
        held = sorted(self.open, key=lambda w: -w[0])
        self.open, self.windows = [], 1
        for _, pieces in held:
            for p in pieces:
                self.add(*p)
        return self.open[0][1] if self.open else []

    def take(self) -> list[tuple]:
        out, self.out = self.out, []
        return out


def _batch(rows, part: int, is_open: bool):
    import pyarrow as pa

    cols = list(zip(*rows))
    kinds = [pa.int64()] * 6 + [pa.binary()]
    arrays = [pa.array(c, k) for c, k in zip(cols, kinds)] + [pa.array([part] * len(rows), pa.int64()), pa.array([is_open] * len(rows))]
    return pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids", "part", "open"])


def _left(pieces, part: int):
    offset, rows = 0, []
    for doc_id, start, ids, n in pieces:
        rows.append((doc_id, start, len(ids) // 4, n, None, offset, ids))
        offset += len(ids) // 4
    return _batch(rows, part, True)


def _packed(path: str, end_id: int, length: int, windows: int, remembered: int):
    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encode, end = worker_encoder(path, remembered), end_id.to_bytes(4, "little")
        packer = Packer(length, windows, part << 32)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py()) + end
                packer.add(doc_id, 0, ids, len(ids) // 4)
                if len(packer.out) >= 512:
                    yield _batch(packer.take(), part, False)
        left = packer.merge()
        if rows := packer.take():
            yield _batch(rows, part, False)
        if left:
            yield _left(left, part)

    return run


def _merged(length: int, level: int, last: bool):
    def run(batches):
        group, pieces = None, []
        for batch in batches:
            group = batch.column("group")[0].as_py() if group is None and batch.num_rows else group
            cols = [batch.column(c).to_pylist() for c in ("part", "offset", "doc_id", "start", "ids", "doc_tokens")]
            pieces += zip(*cols)
        packer = Packer(length, 1, level << 58 | group << 32)
        for p in sorted(pieces, key=lambda p: p[:2]):
            packer.add(*p[2:])
        left = packer.merge()
        if last:
            # The only window left over is cut at powers of two, which need no padding, from its front.
            held = sum(len(p[2]) // 4 for p in left)
            while held:
                need = 1 << held.bit_length() - 1
                own, rest, held = [], [], held - need
                for d, s, ids, n in left:
                    k = min(need, len(ids) // 4)
                    need -= k
                    if k:
                        own.append((d, s, ids[: 4 * k], n))
                    if k < len(ids) // 4:
                        rest.append((d, s + k, ids[4 * k :], n))
                packer._emit(own)
                left = rest
        if rows := packer.take():
            yield _batch(rows, group, False)
        if left:
            yield _left(left, group)

    return run


def pack(docs: DataFrame, text: str = "text", id_col: str = "doc_id", length: int = 1024, end_id: int = 0, windows: int = WINDOWS, path: str | None = None, remembered: int = REMEMBERED) -> DataFrame:
    """Pieces of the documents in sequences of length tokens: doc_id, start, length, doc_tokens, sequence_id,
    offset, ids (little-endian unsigned 32-bit integers).

    Each document is its ids and end_id, so null and empty texts are one token. Each id lies in one piece;
    pieces of a sequence leave no gap. Only a power of two is ever left short of length. Repeated rows are
    documents of their own. An empty table gives none.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), clean_text(text).alias("text"))
    packed = staged(rows.mapInArrow(_packed(path or vocabulary_path(), end_id, length, windows, remembered), PIECES), "packed")
    done, left = [packed.filter(~F.col("open"))], packed.filter("open")
    parts = (left.agg(F.max("part")).first()[0] or 0) + 1
    level = 1
    while True:
        parts = -(-parts // FAN_IN)
        grouped = left.withColumn("group", F.floor(F.col("part") / FAN_IN).cast("long")).groupBy("group")
        merged = staged(grouped.applyInArrow(_whole(_merged(length, level, parts == 1)), PIECES), "merged")
        done.append(merged.filter(~F.col("open")))
        left, level = merged.filter("open"), level + 1
        if parts == 1:
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.drop("part", "open")


def _whole(run):
    def of_table(table):
        import pyarrow as pa

        found = list(run(table.to_batches()))
        kinds = {"binary": pa.binary(), "boolean": pa.bool_(), "long": pa.int64()}
        schema = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in PIECES.split(", ")])
        return pa.Table.from_batches([b.cast(schema) if b.schema != schema else b for b in found], schema)

    return of_table
