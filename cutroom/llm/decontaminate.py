"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the windows of 10 consecutive words of each benchmark item; an item with fewer words, but
not none, is one pattern. Patterns of one length m form a table: for blocks of two words, the shift table
says how far the search may move on without skipping an occurrence; where it says 0, the bucket of that
last block (the suffix hash) lists the patterns to test, and direct comparison of the words confirms.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z. A null or empty text has no words,
is never hit and never contaminated. Repeated documents give repeated rows, repeated benchmark rows count
once per item_id; a null item_id counts as ''. An empty benchmark hits nothing, no documents give no rows.
A very long text is searched whole, in one task. Extra columns are ignored by scan() and kept by
keep_clean(), whatever their names.

Benchmark items are dealt into packs of about PACK windows. A pack is broadcast as the items' words, and
a task makes its tables once. A usual benchmark is one pack, and the texts are read once. A larger one
takes one pass over the texts for each pack, so that what is broadcast and held is bounded however large
the benchmark is, and the time grows with texts times packs; only occurrences are kept from each pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import annotate, cut, original
from .words import ALNUM, Text, Words, pieces

WIDTH = 10
#: Windows of a pack; each takes about 10 bytes in the broadcast and 100 in a task.
PACK = 500_000
_PLAIN = bytes(32 if not ALNUM[b] else b + 32 if 65 <= b <= 90 else b for b in range(256))
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: An occurrence: its first word, how many it has, and the item.
Hit = tuple[int, int, str]


def plain(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_PLAIN).split()


def _blocks(hashes: np.ndarray, size: int) -> np.ndarray:
    """A key of each `size` (1 or 2) consecutive words."""
    return hashes if size == 1 else hashes[:-1] * _STEP + hashes[1:]


class Table:
    """Wu-Manber tables for all windows of `length` words of some items."""

    def __init__(self, length: int, items: list[tuple[str, bytes]]):
        """items: id, and its words with one space between."""
        self.length, self.block = length, min(2, length)
        self.ids = [name for name, _ in items]
        bodies = [body for _, body in items]
        ends = np.cumsum([len(x) for x in bodies], dtype=np.int64)
        self.text = b"".join(bodies)
        words = Text(np.frombuffer(self.text, np.uint8), np.concatenate([np.zeros(1, np.int64), ends])).words(ALNUM, lower=True)
        self.starts, self.ends, self.owner = words.starts, words.ends, words.owner()
        keys = _blocks(words.hashes, self.block)
        place = np.arange(len(words.hashes)) - words.bounds[self.owner]  # of each word in its item
        whole = place[: len(keys)] + self.block <= words.counts()[self.owner[: len(keys)]]
        # the first window that a block is in is the one it is furthest to the end of; blocks at a window's end may not be skipped
        shift = np.maximum(0, length - self.block - place[: len(keys)])
        self.far = length - self.block + 1
        self.keys, at = np.unique(keys[whole], return_inverse=True)
        self.shifts = np.full(len(self.keys), self.far)
        np.minimum.at(self.shifts, at, shift[whole])
        last = np.flatnonzero(whole & (place[: len(keys)] >= length - self.block))
        order = np.argsort(keys[last], kind="stable")
        self.windows = last[order] - (length - self.block)  # first words of windows, by the key of their last block
        self.suffixes = keys[last][order]

    def search(self, words: Words) -> Iterator[Hit]:
        """(place of the first word, length, item) of each occurrence, in a piece of many texts."""
        h, b = words.hashes, self.block
        n = len(h)
        if n < self.length or not len(self.keys):
            return
        keys = _blocks(h, b)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        known = np.flatnonzero(self.keys[at] == keys)
        # the block that begins at i ends a window that begins at i + b - length; the search hops from block
        # to block by the shift table, and from an unknown block by the whole length
        shifts = dict(zip(known.tolist(), self.shifts[at[known]].tolist(), strict=True))
        i, last, far, get = self.length - b, n - b, self.far, shifts.get
        while i <= last:
            s = get(i, far)
            if s:
                i += s
                continue
            first = i + b - self.length
            mine = int(np.searchsorted(words.bounds, first, side="right"))
            if first + self.length <= words.bounds[mine]:
                lo, hi = np.searchsorted(self.suffixes, keys[i : i + 1], side="left")[0], np.searchsorted(self.suffixes, keys[i : i + 1], side="right")[0]
                said = b" ".join(words.word(k, lower=True) for k in range(first, first + self.length))
                for w in self.windows[lo:hi].tolist():
                    if self.text[self.starts[w] : self.ends[w + self.length - 1]] == said:
                        yield first, self.length, self.ids[self.owner[w]]
            i += 1


class Tables:
    """All tables of a pack of items (id, words with one space between)."""

    def __init__(self, items: list[tuple[str, bytes]], width: int = WIDTH):
        by_length: dict[int, list[tuple[str, bytes]]] = {}
        for name, body in items:
            n = body.count(b" ") + 1 if body else 0
            if n:
                by_length.setdefault(min(width, n), []).append((name, body))
        self.tables = [Table(n, some) for n, some in sorted(by_length.items())]

    def hits(self, words: Words) -> list[Hit]:
        return [hit for t in self.tables for hit in t.search(words)]


def _bodies(benchmark: DataFrame, width: int) -> DataFrame:
    """item, body (its words with one space between) and pack of each item that has a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [plain(x) for x in batch.column(1).to_pylist()]
            n = pa.array([max(1, len(w) - width + 1) if w else 0 for w in words], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([b" ".join(w) for w in words], pa.binary()), n], names=["item", "body", "windows"])

    named = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").cast("string").alias("text"))
    return named.mapInArrow(run, "item string, body binary, windows bigint").filter("windows > 0").distinct()


def _packs(benchmark: DataFrame, width: int) -> tuple[int, Callable[[int], list[tuple[str, bytes]]]]:
    """How many packs there are, and what gives the items of one."""
    bodies = cut(_bodies(benchmark, width))
    windows = bodies.agg(F.sum("windows")).first()[0] or 0
    n = -(-windows // PACK)
    own = F.pmod(F.xxhash64("item", "body"), F.lit(max(1, n)))
    return n, lambda i: [(r["item"], bytes(r["body"])) for r in bodies.filter(own == i).select("item", "body").collect()]


def _marked(words: Words, hits: list[Hit]) -> tuple[np.ndarray, list[list[str]]]:
    """Of each text: how many words stand inside any occurrence, and the items, sorted."""
    marks = np.zeros(len(words.hashes) + 1, np.int64)
    items: list[set[str]] = [set() for _ in range(len(words.bounds) - 1)]
    for first, n, item in hits:
        marks[first] += 1
        marks[first + n] -= 1
        items[int(np.searchsorted(words.bounds, first, side="right")) - 1].add(item)
    covered = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.cumsum(marks[:-1]) > 0, dtype=np.int64)])
    return covered[words.bounds[1:]] - covered[words.bounds[:-1]], [sorted(x) for x in items]


def _in_one_pass(docs: DataFrame, pack: list[tuple[str, bytes]], width: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(pack)

    def search():
        tables = Tables(shared.value, width)

        def of_piece(text: Text) -> list[pa.Array]:
            words = text.words(ALNUM, lower=True)
            n_hit, items = _marked(words, tables.hits(words))
            return [pa.array(words.counts().astype(np.int64)), pa.array(n_hit), pa.array(items, pa.list_(pa.string()))]

        return of_piece

    return annotate(docs, "n_words bigint, n_hit bigint, items array<string>", search)


def _text_keys() -> list:
    """What tells texts apart, however often and in whatever rows they stand."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return [F.xxhash64(text).alias("k1"), F.hash(text).alias("k2"), F.octet_length(text).alias("k3")]


def _found(docs: DataFrame, pack: list[tuple[str, bytes]], width: int) -> DataFrame:
    """k1, k2, k3 and the hits of each text in which the pack has any."""
    shared = docs.sparkSession.sparkContext.broadcast(pack)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = Tables(shared.value, width)
        for batch in batches:
            for lo, hi, text in pieces(batch.column(3)):
                words = text.words(ALNUM, lower=True)
                rows: dict[int, list[dict]] = {}
                for first, n, item in tables.hits(words):
                    d = int(np.searchsorted(words.bounds, first, side="right")) - 1
                    rows.setdefault(d, []).append({"first": first - int(words.bounds[d]), "n": n, "item": item})
                at = pa.array(sorted(rows), pa.int64())
                part = batch.slice(lo, hi - lo).take(at)
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array([rows[d] for d in sorted(rows)], pa.list_(pa.struct([("first", pa.int64()), ("n", pa.int64()), ("item", pa.string())])))], names=["k1", "k2", "k3", "hits"])

    texts = docs.select(*_text_keys(), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, "k1 bigint, k2 int, k3 int, hits array<struct<first:bigint,n:bigint,item:string>>")


def _in_passes(docs: DataFrame, n_packs: int, pack: Callable[[int], list[tuple[str, bytes]]], width: int) -> DataFrame:
    """k1, k2, k3, n_hit and items of each text with a hit; one pass over the texts for each pack."""
    found = None
    for i in range(n_packs):
        rows = cut(_found(docs, pack(i), width).dropDuplicates(["k1", "k2", "k3"]))
        found = rows if found is None else found.union(rows)
    each = found.select("k1", "k2", "k3", F.explode("hits").alias("h")).select("k1", "k2", "k3", "h.*")
    # a text's occurrences in order, joined where they overlap: as many as the text has words at most
    spans = F.array_sort(F.collect_set(F.struct("first", "n")))
    covered = F.aggregate(
        "spans", F.struct(F.lit(0).cast("bigint").alias("upto"), F.lit(0).cast("bigint").alias("n")),
        lambda a, s: F.struct(F.greatest(a["upto"], s["first"] + s["n"]).alias("upto"), (a["n"] + F.greatest(F.lit(0), s["first"] + s["n"] - F.greatest(a["upto"], s["first"]))).alias("n")), lambda a: a["n"],
    )
    return each.groupBy("k1", "k2", "k3").agg(spans.alias("spans"), F.array_sort(F.collect_set("item")).alias("items")).select("k1", "k2", "k3", covered.alias("n_hit"), "items")


def scan(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_words, n_hit (words inside any occurrence), items (their ids, as sorted strings, once each)."""
    n, pack = _packs(benchmark, width)
    if n <= 1:
        return _in_one_pass(docs.select("doc_id", "text"), pack(0), width).select(F.col("__0").alias("doc_id"), "n_words", "n_hit", "items")
    hits = cut(_in_passes(docs, n, pack, width))
    counted = annotate(docs.select("doc_id", "text"), "n_words bigint", lambda: lambda text: [pa.array(text.words(ALNUM, lower=True).counts().astype(np.int64))])
    rows = counted.withColumn("text", F.col("__1")).select(F.col("__0").alias("doc_id"), "n_words", *_text_keys())
    none = F.array().cast("array<string>")
    return rows.join(hits, ["k1", "k2", "k3"], "left").select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"), F.coalesce("items", none).alias("items"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """The rows of docs in which no pattern occurs, with all their columns. With one pack of patterns there is no shuffle."""
    n, pack = _packs(benchmark, width)
    if n <= 1:
        return original(_in_one_pass(docs, pack(0), width).filter("n_hit = 0"), docs)
    named = docs.toDF(*(f"__{i}" for i in range(len(docs.columns))))
    keyed = named.withColumn("text", F.col(f"__{docs.columns.index('text')}"))
    return original(keyed.select("*", *_text_keys()).join(cut(_in_passes(docs, n, pack, width)), ["k1", "k2", "k3"], "left_anti"), docs)


def digest(rows: DataFrame) -> DataFrame:
    """scan's rows with n_items, items_sha256 and contaminated instead of items."""
    return rows.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )
