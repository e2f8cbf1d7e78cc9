"""Exact duplicates by an exchange of Golomb-coded fingerprints.

Every text's SHA-256 is taken where it is read; its leading bits are the text's fingerprint, log2(rows) + SPARE of
them. Rows are held in chunks of at most CHUNK, sorted by fingerprint; a chunk is a sender. It sends each owner, which
has a range of fingerprints, the sorted list of those it holds, without repeats, as Golomb-Rice code of the gaps: about
SPARE + 2 bits each at any size. The owner gives back a bitmap of each list: which fingerprints other senders
hold, too. Rows marked there, or equal to another of their own chunk, are suspects. Only suspects' texts are shuffled
(read again, filtered by a table of at most SLOTS bits), grouped by the texts themselves: equality is that of bytes.

Copies meet in partial aggregates before the shuffle, so a text that a third of all rows have is sent once by each
task; what becomes of it is looked up by salted keys. Rows of no suspect text never move but for their digests.

A null text counts as an empty one. Of equal texts the row with the largest doc_id stays (null is below all others); of
rows that have that doc_id, too, one. Rows without doc_id are rows like others. A very long text is one row of one
task. An empty table gives no rows; other columns are ignored, whatever their names. docs is read twice and must be the
same each time, as tables are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import Shelf, looked_up

#: Rows of a sender at most, and fingerprints of an owner on average: 2 MB when decoded.
CHUNK, OWNED = 1 << 16, 1 << 18
#: Bits of a fingerprint beyond log2(rows): one row in 2**SPARE is a suspect by chance.
SPARE = 12
#: Log2 of the bits of the table by which texts are filtered when they are read again: 16 MB, beyond which more texts pass than need to.
SLOT_BITS = 27


def encode(values: np.ndarray, width: int) -> tuple[int, bytes, bytes]:
    """Golomb-Rice code of ascending distinct numbers under 2**width: the bits of a remainder, quotients in unary, remainders."""
    gaps = np.diff(values, prepend=-1) - 1
    k = max(0, int(np.log2(max(1.0, np.log(2) * 2.0**width / len(values)))))
    ones = np.cumsum((gaps >> k) + 1) - 1
    unary = np.zeros(int(ones[-1]) + 1, np.uint8)
    unary[ones] = 1
    rest = (gaps[:, None] >> np.arange(k - 1, -1, -1)) & 1
    return k, np.packbits(unary).tobytes(), np.packbits(rest.astype(np.uint8)).tobytes()


def decode(n: int, k: int, unary: bytes, rest: bytes) -> np.ndarray:
    """The n numbers that encode() was given."""
    ones = np.flatnonzero(np.unpackbits(np.frombuffer(unary, np.uint8)))
    quotients = np.diff(ones, prepend=-1) - 1
    bits = np.unpackbits(np.frombuffer(rest, np.uint8), count=n * k).reshape(n, k).astype(np.int64)
    return np.cumsum((quotients << k) + bits @ (np.int64(1) << np.arange(k - 1, -1, -1, dtype=np.int64)) + 1) - 1


def _sha():
    return F.unhex(F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256))


def chunks(docs: DataFrame) -> DataFrame:
    """sender, n, prints (8 bytes each, ascending), shas and doc_ids in that order: one row for at most CHUNK rows of one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender, held = TaskContext.get().partitionId() << 32, []

        def chunk() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks()
            shas = np.frombuffer(b"".join(rows["sha"].to_pylist()), ">u8").reshape(-1, 4)
            order = np.argsort(shas[:, 0], kind="stable")
            ids = rows["doc_id"].combine_chunks().take(pa.array(order))
            columns = [pa.array([sender]), pa.array([len(order)], pa.int32()), pa.array([shas[order, 0].astype("<u8").tobytes()], pa.binary()), pa.array([shas[order].tobytes()], pa.binary())]
            return pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array([0, len(order)], pa.int32()), ids)], names=["sender", "n", "prints", "shas", "doc_ids"])

        for batch in batches:
            for lo in range(0, batch.num_rows, CHUNK):
                part = batch.slice(lo, CHUNK)
                if held and sum(b.num_rows for b in held) + part.num_rows > CHUNK:
                    yield chunk()
                    sender, held = sender + 1, []
                held.append(part)
        if held:
            yield chunk()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", _sha().alias("sha")).mapInArrow(run, f"sender bigint, n int, prints binary, shas binary, doc_ids array<{kind}>")


def _own(prints: bytes, bits: int) -> np.ndarray:
    return (np.frombuffer(prints, "<u8") >> np.uint64(64 - bits)).astype(np.int64)


def messages(held: DataFrame, bits: int, owner_bits: int) -> DataFrame:
    """sender, owner and the code of the distinct fingerprints that the sender has in the owner's range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = bits - owner_bits
        for batch in batches:
            for sender, prints in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = np.unique(_own(prints, bits))
                begins = np.flatnonzero(np.diff(own >> width, prepend=-1))
                lists = np.split(own, begins[1:])
                codes = [encode(x & ((1 << width) - 1), width) for x in lists]
                columns = [[sender] * len(lists), [int(x[0] >> width) for x in lists], [len(x) for x in lists], *zip(*codes, strict=True)]
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["sender", "owner", "n", "k", "unary", "rest"])

    return held.select("sender", "prints").mapInArrow(run, "sender bigint, owner int, n int, k int, unary binary, rest binary")


def duplicate_bitmaps(sent: DataFrame) -> DataFrame:
    """sender, owner, bitmap: which fingerprints of a list are in another sender's, too."""

    def run(group: pa.Table) -> pa.Table:
        lists = [decode(*x) for x in zip(*(group[c].to_pylist() for c in ("n", "k", "unary", "rest")), strict=True)]
        found, times = np.unique(np.concatenate(lists), return_counts=True)
        several = found[times > 1]
        marks = [np.packbits(np.isin(x, several, assume_unique=True)).tobytes() for x in lists]
        return pa.table([group["sender"], group["owner"], pa.array(marks, pa.binary())], names=["sender", "owner", "bitmap"])

    return sent.groupBy("owner").applyInArrow(run, "sender bigint, owner int, bitmap binary")


def marked(held: DataFrame, bitmaps: DataFrame, bits: int, owner_bits: int) -> DataFrame:
    """sender, place, doc_id, sha, suspect of each row: chunks with the bitmaps that came back."""
    kind = held.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                sender, n, prints, shas = (batch.column(c)[i].as_py() for c in ("sender", "n", "prints", "shas"))
                own, at, times = np.unique(_own(prints, bits), return_inverse=True, return_counts=True)
                owners, sizes = np.unique(own >> (bits - owner_bits), return_counts=True)
                back = {m["owner"]: m["bitmap"] for m in batch.column("back")[i].as_py()}
                elsewhere = np.concatenate([np.unpackbits(np.frombuffer(back[o], np.uint8), count=m) for o, m in zip(owners.tolist(), sizes.tolist(), strict=True)])
                suspect = (times > 1)[at] | (elsewhere > 0)[at]
                columns = [pa.array(np.full(n, sender)), pa.array(np.arange(n, dtype=np.int32)), batch.column("doc_ids")[i].values, pa.array([shas[j : j + 32] for j in range(0, 32 * n, 32)], pa.binary()), pa.array(suspect)]
                yield pa.RecordBatch.from_arrays(columns, names=["sender", "place", "doc_id", "sha", "suspect"])

    back = bitmaps.groupBy("sender").agg(F.collect_list(F.struct("owner", "bitmap")).alias("back"))
    return held.join(back, "sender").mapInArrow(run, f"sender bigint, place int, doc_id {kind}, sha binary, suspect boolean")


def _slot(sha, bits: int):
    """word and bit of the filter's table for a digest: its leading bits."""
    slot = F.shiftright(F.conv(F.hex(F.substring(sha, 1, 4)), 16, 10).cast("bigint"), 32 - bits)
    return F.shiftright(slot, 6).alias("word"), slot.bitwiseAND(F.lit(63).cast("bigint")).cast("int").alias("bit")


def verified(docs: DataFrame, suspects: DataFrame, bits: int) -> DataFrame:
    """sha and group_size of texts that two rows or more have, byte by byte, among those whose digest may be a suspect's.

    The filter is a table of 2**bits bits, in words of 64: its size is bounded whatever the number of suspects.
    """
    words = suspects.select(*_slot(F.col("sha"), bits)).groupBy("word").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits"))
    rows = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("sha", _sha())
    rows = rows.select("text", "sha", *_slot(F.col("sha"), bits)).join(F.broadcast(words), "word").filter("shiftright(bits, bit) & 1 = 1")
    return rows.groupBy("sha", "text").agg(F.count("*").alias("group_size")).filter("group_size > 1").select("sha", "group_size")


def exact_duplicates(docs: DataFrame, shelf: Shelf | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of each row."""
    shelf = shelf or Shelf(docs.sparkSession)
    held = shelf.put(chunks(docs))
    total = held.agg(F.sum("n")).first()[0] or 0
    log_total = max(1, total).bit_length()
    bits, owner_bits = min(60, log_total + SPARE), max(6, log_total - OWNED.bit_length())
    rows = shelf.put(marked(held, duplicate_bitmaps(messages(held, bits, owner_bits)), bits, owner_bits))
    shelf.free(held)
    suspects = rows.filter("suspect")
    best = suspects.groupBy("sha").agg(F.max(F.struct("doc_id", "sender", "place")).alias("best"))
    groups = shelf.put(verified(docs, suspects, min(SLOT_BITS, bits)).join(best, "sha"))
    found = looked_up(suspects, "sha", groups, "place").unionByName(rows.filter("NOT suspect"), allowMissingColumns=True)
    copied = F.col("group_size").isNotNull()
    first = (F.col("best.sender") == F.col("sender")) & (F.col("best.place") == F.col("place"))
    return found.select(
        "doc_id", F.when(copied, F.col("best.doc_id")).otherwise(F.col("doc_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("bigint")).alias("group_size"),
        F.when(copied, first).otherwise(F.lit(True)).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """docs with one row of each distinct text, all columns: that of the largest doc_id. Of rows equal in doc_id and text it is the first by a digest of all columns."""
    shelf = Shelf(docs.sparkSession)
    digest = exact_duplicates(docs, shelf).groupBy(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha"))
    stay = shelf.put(digest.agg(F.count("*").alias("n"), F.max("kept").alias("kept")).filter("kept"))
    named = docs.toDF(*(f"__{i}" for i in range(len(docs.columns))))
    doc_id, text = (f"__{docs.columns.index(c)}" for c in ("doc_id", "text"))
    sha = F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")), 256)
    same = lambda some: named[doc_id].eqNullSafe(some["__id"]) & (sha == some["__sha"])
    once, several = stay.filter("n = 1"), stay.filter("n > 1")
    whole = F.struct(*named.columns)
    rest = named.join(several, same(several), "left_semi").groupBy(F.col(doc_id), sha).agg(F.min_by(whole, F.struct(F.md5(F.to_json(whole)))).alias("row"))
    return named.join(once, same(once), "left_semi").union(rest.select("row.*")).toDF(*docs.columns)
