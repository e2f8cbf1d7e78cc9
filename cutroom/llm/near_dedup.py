"""Near duplicates by improved consistent weighted sampling (ICWS) over TF-IDF shingles.

A document's shingles are its runs of five words (all its words, if it has fewer); a shingle weighs its
count in the document times the mean of its words' inverse document frequencies. ICWS draws BANDS * ROWS
samples; documents that agree in all samples of a band are candidates, and a pair is linked if its
weighted Jaccard similarity, computed from the whole texts, is SIMILARITY or more. Classes are the
connected components of links; a class's id is its smallest doc_id.

Frequencies are of words, not shingles: if a shingle's own frequency counted, a large group of copies
would weigh down what it shares. They lie between 1 and 2 whatever the number of documents, so a pair
weighs alike in small and large corpora. They are kept for 2**18 hashed words, a table of fixed size.

Texts with the same words in the same order are one node from the start, so copies never make pairs. A
band with few nodes compares all of them. A larger one first compares each node with PIVOTS nodes only,
the most popular ones (those with most company over all their bands, as the text that others were made
from has). Then the nodes outside the band's largest component so far are queries against all nodes of the
band, in blocks (see _between), so every pair of a band that could join two components is compared, and
the members of one large group, once linked to its pivot, are not. Blocks compare samples only; of the
pairs whose samples agree often enough, each text is sent once to each block that needs it.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z. A null text is like no other document's;
texts without words are copies if they are equal. A null doc_id has a null class_id and is no node. Rows
that repeat a doc_id are one document: whatever their texts are near to is one class. A very long text is
one row of one task, and is shingled whole. An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import Shelf, apart, bit_table, in_table, looked_up
from .words import ALNUM, Text, Words, _power, mix, pieces, windows

WIDTH = 5
SIMILARITY = 0.8
BANDS, ROWS = 14, 3
#: Candidates whose samples agree less often are no links: 4 standard errors under SIMILARITY, for the samples of the
#: bands alone and for WIDE more of them.
LIKELY, WIDE, LIKELY_WIDE = 0.55, 448, 0.727
FEW, PIVOTS = 8, 2
#: Text of the blocks in which queries meet the nodes of a band, and what a node counts beside its text: 512 nodes a block at most.
BLOCK_BYTES, NODE_BYTES = 2 << 20, 4 << 10
#: Pairs whose texts one task compares, about: a text has at most 512 pairs in a cell.
CELL_PAIRS = 8192
FREQUENCIES = 1 << 18
_BLOCK = 1 << 15

_rng = np.random.Generator(np.random.PCG64(7))
_FACTORS = _rng.integers(0, 2**64, 512, dtype=np.uint64) | np.uint64(1)


def _gamma2(n: int = 1 << 16) -> np.ndarray:
    """Quantiles of Gamma(2, 1) at the middles of n equal steps."""
    u, lo, hi = (np.arange(n) + 0.5) / n, np.zeros(n), np.full(n, 40.0)
    for _ in range(60):
        x = (lo + hi) / 2
        below = 1 - (1 + x) * np.exp(-x) < u
        lo, hi = np.where(below, x, lo), np.where(below, hi, x)
    return x


_R = _gamma2().astype(np.float32)
_INVERSE_R, _LOG_C, _BETA = (1 / _R).astype(np.float32), np.log(_R).astype(np.float32), ((np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.float32)


def _slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(46)).astype(np.int64)


def idf_table(docs: DataFrame) -> np.ndarray:
    """1 + log((1 + documents) / (1 + documents with the word)) / log(2 + documents), by hashed word.

    Tasks count their own documents first; at most FREQUENCIES + 1 sums reach the driver.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(FREQUENCIES + 1, np.int64)
        for batch in batches:
            for lo, hi, text in pieces(batch.column(0)):
                words = text.words(ALNUM, lower=True)
                seen = np.sort(words.owner() * FREQUENCIES + _slots(words.hashes))
                seen = seen[np.concatenate([np.ones(1, bool), seen[1:] != seen[:-1]])] if len(seen) else seen
                total[:-1] += np.bincount(seen % FREQUENCIES, minlength=FREQUENCIES)
                total[-1] += hi - lo
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["slot", "n"])

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(FREQUENCIES + 1, np.int64)
    n[rows["slot"].to_numpy()] = rows["n"].to_numpy()
    return (1 + np.log((1 + n[-1]) / (1 + n[:-1])) / np.log(2 + n[-1])).astype(np.float32)


def shingles(words: Words, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text of a piece, text after text: hashes, weights, and where each text's begin (and the end)."""
    h, n_texts = words.hashes, len(words.bounds) - 1
    own = idf[_slots(h)].astype(np.float64)
    owner = words.owner()
    n = max(0, len(h) - WIDTH + 1)
    inside = owner[:n] == owner[len(h) - n :]
    keys, mean = windows(h, WIDTH), sum((own[j : j + n] for j in range(WIDTH)), np.zeros(n)) / WIDTH
    keys, mean, owner = keys[inside], mean[inside], owner[:n][inside]
    counts = words.counts()
    short = np.flatnonzero((counts > 0) & (counts < WIDTH))
    if len(short):
        at = np.searchsorted(owner, short)
        bounds = [(int(words.bounds[d]), int(words.bounds[d + 1])) for d in short]
        keys = np.insert(keys, at, np.array([windows(h[i:j], j - i)[0] for i, j in bounds], np.uint64))
        mean, owner = np.insert(mean, at, [own[i:j].mean() for i, j in bounds]), np.insert(owner, at, short)
    mine = keys + mix(owner.astype(np.uint64) + np.uint64(1))
    ordered = np.sort(mine)
    again = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if len(again):
        hit = np.flatnonzero(again[np.minimum(np.searchsorted(again, mine), len(again) - 1)] == mine)
        _, first, times = np.unique(mine[hit], return_index=True, return_counts=True)
        keep = np.ones(len(mine), bool)
        keep[hit] = False
        keep[hit[first]] = True
        mean[hit[first]] *= times
        keys, mean, owner = keys[keep], mean[keep], owner[keep]
    return keys, mean, np.searchsorted(owner, np.arange(n_texts + 1))


def sample(keys: np.ndarray, weights: np.ndarray, begins: np.ndarray, k: int, first: int = 0) -> np.ndarray:
    """k ICWS samples, from number `first` on, of each text with shingles (all texts here have some): texts x k.

    For shingle s and sample i, r and c are Gamma(2, 1), beta is uniform, all from a hash of (s, i);
    t = floor(ln w / r + beta), ln a = ln c - r (t - beta + 1). The sample is the (s, t) of the smallest
    ln a; as ln a follows from (s, t), it stands for it.
    """
    out = np.empty((len(begins) - 1, k), np.float32)
    logs = np.log(weights).astype(np.float32)
    lo = 0
    while lo < len(out):
        hi = max(lo + 1, int(np.searchsorted(begins, begins[lo] + _BLOCK, side="right")) - 1)
        a, b = int(begins[lo]), int(begins[hi])
        part, log_w, starts = keys[a:b], logs[a:b], begins[lo:hi] - a
        for i in range(k):
            quarters = (part * _FACTORS[first + i]).view(np.uint16).reshape(-1, 4)
            r, beta = quarters[:, 3], _BETA[quarters[:, 1]]
            t = np.floor(log_w * _INVERSE_R[r] + beta)
            t -= beta
            t += 1
            t *= _R[r]
            np.subtract(_LOG_C[quarters[:, 2]], t, out=t)
            out[lo:hi, i] = np.minimum.reduceat(t, starts)
        lo = hi
    return out


def _keys(words: Words, text: Text, nulls: np.ndarray) -> list[bytes | None]:
    """16 bytes for each text: of its words in order, or of its bytes if it has none; None for null."""
    n, some = words.counts(), None
    if len(words.hashes):
        powers = _power(int(n.max()) + 1)[np.arange(len(words.hashes)) - np.repeat(words.bounds[:-1], n)]
        begins = words.bounds[:-1][n > 0]
        some = np.stack([mix(np.add.reduceat(h * powers, begins)) for h in (words.hashes, mix(words.hashes + np.uint64(11)))], 1)
    out: list[bytes | None] = []
    at = 0
    for i, m in enumerate(n.tolist()):
        if m:
            out.append(some[at].tobytes())
            at += 1
        else:
            out.append(None if nulls[i] else hashlib.md5(text.data[text.offsets[i] : text.offsets[i + 1]].tobytes()).digest())
    return out


def sketches(docs: DataFrame, idf) -> DataFrame:
    """doc_id, key (equal for texts with the same words in order; a null text has one of its document's), n_words, n_bytes, sketch (null without words). idf: broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nulls = batch.column(1).is_null().to_numpy(zero_copy_only=False)
            for lo, hi, text in pieces(batch.column(1)):
                words = text.words(ALNUM, lower=True)
                keys, weights, begins = shingles(words, idf.value)
                some = np.flatnonzero(words.counts() > 0)
                found: list[bytes | None] = [None] * (hi - lo)
                if len(some):
                    drawn = sample(keys, weights, np.append(begins[some], begins[-1]), BANDS * ROWS)
                    for i, row in zip(some.tolist(), drawn, strict=True):
                        found[i] = row.tobytes()
                numbers = (pa.array(np.asarray(x, np.int64)) for x in (words.counts(), np.diff(text.offsets)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(_keys(words, text, nulls[lo:hi]), pa.binary()), *numbers, pa.array(found, pa.binary())],
                    names=["doc_id", "key", "n_words", "n_bytes", "sketch"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, key binary, n_words bigint, n_bytes bigint, sketch binary")
    return rows.withColumn("key", F.coalesce("key", F.unhex(F.md5(F.concat(F.lit("null:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))))


def _first_pairs(rows: DataFrame) -> DataFrame:
    """(a, b) of keys, a < b, out of rows (band, key, n, popularity): all pairs of bands with few nodes, and nodes with the pivots of larger bands."""
    few = rows.filter(F.col("n") <= FEW).groupBy("band").agg(F.array_sort(F.collect_list("key")).alias("nodes"))
    few = few.select(F.posexplode("nodes").alias("i", "a"), "nodes").select("a", F.explode(F.slice("nodes", F.col("i") + 2, F.lit(FEW))).alias("b"))
    many = rows.filter(F.col("n") > FEW)
    slot = F.pmod(F.xxhash64("key"), F.lit(PIVOTS))
    best = many.groupBy("band", slot.alias("slot")).agg(F.max(F.struct("popularity", "key")).alias("best")).groupBy("band").agg(F.collect_list("best.key").alias("pivots"))
    met = looked_up(many.select("band", "key"), "band", best).select("key", F.explode("pivots").alias("pivot")).filter(F.col("key") != F.col("pivot"))
    return few.union(met.select(F.least("key", "pivot").alias("a"), F.greatest("key", "pivot").alias("b"))).distinct()


def _widened(texts: DataFrame, idf) -> DataFrame:
    """key, wide (a byte of each of WIDE more samples) and weight (of all shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, text in pieces(batch.column(1)):
                keys, weights, begins = shingles(text.words(ALNUM, lower=True), idf.value)
                drawn = sample(keys, weights, begins, WIDE, BANDS * ROWS).view(np.uint32) * np.uint32(0x9E3779B1) >> np.uint32(24)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array([x.tobytes() for x in drawn.astype(np.uint8)], pa.binary()), pa.array(np.add.reduceat(weights, begins[:-1]))], names=["key", "wide", "weight"])

    return texts.select("key", "text").mapInArrow(run, "key binary, wide binary, weight double")


_CELL = ["band", "query_block", "node_block"]


def _likely_in_cells(met: DataFrame) -> DataFrame:
    """Texts of each cell that are to be compared, part by part: of a query `nodes`, those of other components whose samples agree often enough, the likeliest first.

    own and of number the components, within the cell, of the text and of its nodes; a text that is no query of its part
    has no nodes. A part has about CELL_PAIRS pairs, dealt by query, and each of its texts once: pairs are never rows.
    A pair that shares several bands is looked at in the first.
    """

    def run(key: tuple, group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        column = lambda name: group[name].to_pylist()
        sketch = np.frombuffer(b"".join(column("sketch")), np.uint32).reshape(-1, BANDS, ROWS)
        wide = np.frombuffer(b"".join(column("wide")), np.uint8).reshape(-1, WIDE)
        asks, queried, weight = (group[name].to_numpy(zero_copy_only=False) for name in ("asks", "query", "weight"))
        keys = np.array([k.hex() for k in column("key")])
        root = np.unique(np.array([r.hex() for r in column("root")]), return_inverse=True)[1]
        which, own = group["which"][0].as_py(), np.flatnonzero(~asks)
        likely: dict[int, np.ndarray] = {}
        for q in np.flatnonzero(asks).tolist():
            same = sketch[own] == sketch[q]
            agree = (same.sum(axis=(1, 2)) + (wide[own] == wide[q]).sum(axis=1)) / (BANDS * ROWS + WIDE)
            twice = queried[own] & (keys[own] < keys[q])  # two queries are looked at once
            possible = np.minimum(weight[own], weight[q]) >= SIMILARITY * 0.999 * np.maximum(weight[own], weight[q])
            fits = possible & (agree >= LIKELY_WIDE) & (root[own] != root[q]) & ~twice & (same.all(axis=2).argmax(axis=1) == which)
            if fits.any():
                likely[q] = own[fits][np.lexsort((keys[own[fits]], -agree[fits]))]
        n_parts = -(-sum(map(len, likely.values())) // CELL_PAIRS)
        parts: dict[int, list[int]] = {}
        for q in likely:
            parts.setdefault(int(keys[q][:8], 16) % n_parts, []).append(q)
        rows: list[tuple] = []
        for part, queries in parts.items():
            rows += [(part, keys[q], keys[likely[q]].tolist(), int(root[q]), root[likely[q]].tolist()) for q in queries]
            others = set(np.concatenate([keys[likely[q]] for q in queries]).tolist()) - {str(keys[q]) for q in queries}
            rows += [(part, k, [], 0, []) for k in sorted(others)]
        part, texts, nodes, mine, of = zip(*rows, strict=True) if rows else ((),) * 5
        arrays = [pa.array(part, pa.int32()), pa.array([bytes.fromhex(k) for k in texts], pa.binary()), pa.array([[bytes.fromhex(k) for k in n] for n in nodes], pa.list_(pa.binary())), pa.array(mine, pa.int32()), pa.array(of, pa.list_(pa.int32()))]
        return pa.table([*(pa.repeat(k, len(rows)) for k in key), *arrays], names=[*_CELL, "part", "key", "nodes", "own", "of"])

    return met.groupBy(*_CELL).applyInArrow(run, "band bigint, query_block int, node_block int, part int, key binary, nodes array<binary>, own int, of array<int>")


def _verified_in_cells(likely: DataFrame, texts: DataFrame, idf) -> DataFrame:
    """Pairs (a, b) of _likely_in_cells whose whole texts are similar enough. Once a pair has joined two components, others between them are not compared."""

    def run(_: tuple, part: pa.Table) -> pa.Table:
        part = part.sort_by("key")
        bodies, bags, up = dict(zip(part["key"].to_pylist(), part["text"].to_pylist(), strict=True)), {}, {}

        def bag(key: bytes) -> tuple[np.ndarray, np.ndarray]:
            if key not in bags:
                bags[key] = shingles(_one(bodies[key]).words(ALNUM, lower=True), idf.value)[:2]
            return bags[key]

        def top(x: int) -> int:
            while x in up:
                x = up[x]
            return x

        found = []
        for a, nodes, own, of in zip(*(part[c].to_pylist() for c in ("key", "nodes", "own", "of")), strict=True):
            for b, other in zip(nodes, of, strict=True):
                x, y = top(own), top(other)
                if x != y and _jaccard(*bag(a), *bag(b)) >= SIMILARITY:
                    found.append((a, b))
                    up[x] = y
        return pa.table({name: pa.array([p[i] for p in found], pa.binary()) for i, name in enumerate("ab")})

    return likely.join(texts, "key").groupBy(*_CELL, "part").applyInArrow(run, "a binary, b binary")


def _between(rows: DataFrame, nodes: DataFrame, texts: DataFrame, linked: DataFrame, idf, shelf: Shelf) -> DataFrame:
    """Verified pairs (a, b) in larger bands, of different components of what `linked` links.

    Of each band, the nodes outside its largest component are queries against all its nodes. Both are dealt
    into blocks of about BLOCK_BYTES of text, and each pair of blocks is a cell.
    """
    roots = components(linked, shelf)
    many = rows.filter(F.col("n") > FEW).join(roots, "key", "left").select("band", "which", "key", F.coalesce("root", "key").alias("root"))
    sizes = many.groupBy("band", "root").agg(F.count("*").alias("m"))
    main = sizes.groupBy("band").agg(F.max_by("root", F.struct("m", "root")).alias("main"), F.count("*").alias("parts")).filter("parts > 1").select("band", "main")
    mixed = looked_up(many, "band", main).filter("main IS NOT NULL").join(nodes.select("key", (F.col("n_bytes") + NODE_BYTES).alias("bytes")), "key")
    mixed = shelf.put(mixed.select("band", "which", "key", "root", "bytes", (F.col("root") != F.col("main")).alias("query")))
    shelf.free(roots)
    blocks = lambda c: F.ceil((F.sum(c) + 1) / BLOCK_BYTES).cast("int")
    n_blocks = mixed.groupBy("band").agg(blocks(F.col("bytes")).alias("node_blocks"), blocks(F.when(F.col("query"), F.col("bytes")).otherwise(0)).alias("query_blocks"))
    dealt = looked_up(mixed.drop("bytes"), "band", n_blocks)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("key"), F.col(n)).cast("int")
    side = lambda asks, a, b: dealt.filter("query" if asks else "true").select("band", "which", "key", "root", "query", F.lit(asks).alias("asks"), a.alias("query_block"), b.alias("node_block"))
    met = side(True, own("query_blocks"), every("node_blocks")).union(side(False, every("query_blocks"), own("node_blocks")))
    wide = _widened(texts.join(mixed.select("key").distinct(), "key"), idf).join(nodes.select("key", "sketch"), "key")
    likely = shelf.put(_likely_in_cells(met.join(wide, "key")))
    out = shelf.put(_verified_in_cells(likely, texts, idf))
    shelf.free(mixed, likely)
    return out


def keyed(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, text) of texts with words, each of wanted's keys once. Tasks send a key once and, by a table of bounded size, few that nobody wants."""
    table = docs.sparkSession.sparkContext.broadcast(bit_table(wanted, "key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for lo, hi, text in pieces(batch.column(0)):
                words = text.words(ALNUM, lower=True)
                new = []
                for i, (key, n) in enumerate(zip(_keys(words, text, np.zeros(hi - lo, bool)), words.counts().tolist(), strict=True)):
                    if n and key not in seen and in_table(table.value, key):
                        seen.add(key)
                        new.append((i, key))
                yield pa.RecordBatch.from_arrays([pa.array([k for _, k in new], pa.binary()), batch.column(0).slice(lo, hi - lo).take(pa.array([i for i, _ in new], pa.int64()))], names=["key", "text"])

    found = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "key binary, text string")
    return found.join(wanted.select("key"), "key", "left_semi").dropDuplicates(["key"])


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose samples agree often enough."""
    for batch in batches:
        if batch.num_rows:
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint32).reshape(-1, BANDS * ROWS) for i in (2, 3))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array((a == b).mean(axis=1) >= LIKELY))


def similarities(a: Text, b: Text, idf: np.ndarray) -> np.ndarray:
    """Weighted Jaccard similarity of each text of a with that of b."""
    (ka, wa, ba), (kb, wb, bb) = (shingles(t.words(ALNUM, lower=True), idf) for t in (a, b))
    out = np.zeros(len(ba) - 1)
    for i in range(len(out)):
        x, y, u, v = ka[ba[i] : ba[i + 1]], kb[bb[i] : bb[i + 1]], wa[ba[i] : ba[i + 1]], wb[bb[i] : bb[i + 1]]
        out[i] = _jaccard(x, u, y, v)
    return out


def _jaccard(x: np.ndarray, u: np.ndarray, y: np.ndarray, v: np.ndarray) -> float:
    """Weighted Jaccard similarity of distinct shingles x and y with weights u and v."""
    all_u, all_v = u.sum(), v.sum()
    if min(all_u, all_v) < SIMILARITY * 0.999 * max(all_u, all_v):
        return 0.0
    _, p, q = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    both = np.minimum(u[p], v[q]).sum()
    whole = all_u + all_v - both
    return both / whole if whole else 1.0


def _verified(pairs: DataFrame, texts: DataFrame, idf) -> DataFrame:
    """The pairs (a, b) whose texts are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                found = np.concatenate([similarities(_one(part.column(2)[i].as_py()), _one(part.column(3)[i].as_py()), idf.value) for i in range(part.num_rows)])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["a", "b"]).filter(pa.array(found >= SIMILARITY))

    def side(name: str) -> DataFrame:
        return texts.select(F.col("key").alias(name), F.col("text").alias(f"text_{name}"))

    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(run, "a binary, b binary")


def _one(text: str | None) -> Text:
    data = np.frombuffer((text or "").encode(), np.uint8)
    return Text(data, np.array([0, len(data)], np.int64))


def _of_one_document(sketched: DataFrame) -> DataFrame:
    """(a, b) of keys, a < b, that a doc_id has in different rows."""
    rows = sketched.filter("doc_id IS NOT NULL").select("doc_id", "key")
    several = rows.groupBy("doc_id").agg(F.min("key").alias("a"), F.max("key").alias("z")).filter("a < z").drop("z")
    return looked_up(rows, "doc_id", several).filter("a < key").select("a", F.col("key").alias("b")).distinct()


def links(docs: DataFrame, sketched: DataFrame, idf, shelf: Shelf) -> DataFrame:
    """Pairs (a, b) of keys, a < b: verified ones, and those that a doc_id unites (verified: false). sketched: what sketches() gave."""
    nodes = sketched.filter("sketch IS NOT NULL AND doc_id IS NOT NULL").groupBy("key").agg(F.min(F.struct("doc_id", "n_bytes", "sketch")).alias("first"))
    nodes = shelf.put(nodes.select("key", "first.*"))
    width = ROWS * 4
    bands = F.array(*(F.xxhash64(F.lit(i), F.substring("sketch", i * width + 1, width)) for i in range(BANDS)))
    dealt = nodes.select("key", F.posexplode(bands).alias("which", "band"))
    # counts are written first, so that the join's inputs are shuffles alone, which AQE splits where a band is frequent
    counts = shelf.put(dealt.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1"))
    rows = shelf.put(dealt.join(counts, "band"))
    popularity = shelf.put(rows.groupBy("key").agg(F.sum("n").alias("popularity")))
    texts = shelf.put(keyed(docs, popularity))
    side = lambda name: nodes.select(F.col("key").alias(name), F.col("sketch").alias(f"sketch_{name}"))
    pairs = _first_pairs(rows.join(popularity, "key"))
    likely = shelf.put(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sketch_a", "sketch_b").mapInArrow(_alike, "a binary, b binary"))
    no, yes = F.lit(False).alias("verified"), F.lit(True).alias("verified")
    first = shelf.put(_verified(likely, texts, idf).select("a", "b", yes).union(_of_one_document(sketched).select("a", "b", no)))
    shelf.free(counts, popularity, likely)
    more = _between(rows, nodes, texts, first, idf, shelf)
    shelf.free(rows, nodes, texts)
    return first.union(more.select("a", "b", yes))


def components(edges: DataFrame, shelf: Shelf) -> DataFrame:
    """(key, root) for each end of an edge: root is the smallest key of its connected component.

    Each round takes the smallest root among neighbours and then the root's root, so rounds grow with
    the logarithm of the longest path, not with its length.
    """
    both = shelf.put(edges.select(F.col("a").alias("key"), F.col("b").alias("other")).union(edges.select("b", "a")))
    roots = shelf.put(both.groupBy("key").agg(F.min(F.least("key", "other")).alias("root")))
    while True:
        near = looked_up(both, "other", roots.select(F.col("key").alias("other"), "root")).groupBy("key").agg(F.min("root").alias("near"))
        moved = shelf.put(roots.join(near, "key").select("key", F.col("root").alias("old"), F.least("root", "near").alias("root")))
        up = roots.select(F.col("key").alias("root"), F.col("root").alias("up"))
        jumped = shelf.put(looked_up(moved, "root", up).select("key", "old", F.least("root", F.coalesce("up", "root")).alias("root")))
        shelf.free(roots, moved)
        if jumped.filter("old <> root").isEmpty():
            shelf.free(both)
            return jumped
        roots = jumped


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, class_id, n_links of each row; is_first: it is the document that its class keeps.

    n_links counts the pairs verified at the row's text, other texts of the same words aside. They are enough to connect
    each class: pairs within what is connected already are not compared (see above), and no link joins two classes.
    """
    shelf = Shelf(docs.sparkSession)
    idf = docs.sparkSession.sparkContext.broadcast(idf_table(docs))
    sketched = shelf.put(sketches(docs, idf))
    found = links(docs, sketched, idf, shelf)
    roots = components(found, shelf)
    n_links = found.filter("verified").select(F.explode(F.array("a", "b")).alias("key")).groupBy("key").agg(F.count("*").alias("n_links"))
    copies = sketched.filter("doc_id IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    rooted = copies.join(roots.select("key", "root"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    classes = rooted.groupBy("root").agg(F.min("first").alias("class_id"), F.sum("n").alias("n_class")).filter("n_class > 1")
    named = looked_up(rooted, "root", classes).filter("class_id IS NOT NULL").select("key", "class_id").join(n_links, "key", "left")
    rows = looked_up(sketched.select("doc_id", "key", "n_words"), "key", named, salt="doc_id")
    class_id = F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id"))
    return rows.select("doc_id", "n_words", class_id.alias("class_id"), F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"), (class_id.isNull() | (class_id == F.col("doc_id"))).alias("is_first"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """docs with one document of each class, that of the smallest doc_id; all columns. Rows without doc_id stay.

    Of rows that repeat a doc_id that stays, one does: the first by the hash of its text, then of all its columns.
    """
    found = near_duplicates(docs).filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("__id"))
    found = Shelf(docs.sparkSession).put(found.agg(F.count("*").alias("n"), F.max("is_first").alias("stays")))
    named = docs.toDF(*(f"__{i}" for i in range(len(docs.columns))))
    doc_id, text = (f"__{docs.columns.index(c)}" for c in ("doc_id", "text"))
    # documents that stay and stand once are not shuffled: only those that go, or stand several times
    sure, others = apart(named, F.col(doc_id), found.filter("n > 1 OR NOT stays"), F.col("__id"))
    one, several = (others.join(found.filter(f"stays AND {test}"), F.col(doc_id) == F.col("__id"), "left_semi") for test in ("n = 1", "n > 1"))
    whole, body = F.struct(*named.columns), F.col(text).cast("string")
    first = several.groupBy(F.col(doc_id).alias("__id")).agg(F.min_by(whole, F.struct(F.md5(body), F.md5(F.to_json(whole)))).alias("row")).select("row.*")
    null = others.filter(F.col(doc_id).isNull())
    return sure.union(one).union(first).union(null).toDF(*docs.columns)
