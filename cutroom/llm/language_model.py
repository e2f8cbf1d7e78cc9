"""Scoring texts with a hidden Markov language model.

Training texts give exact word counts first. The symbols of the HMM are the HEAD most frequent words and
one for all others. Baum-Welch runs over all training texts: tasks make expected counts, Spark sums them,
and the driver gets the sums (as many as the HMM has parameters). A last round gives, for every training
word outside the head, how often each state is expected to have emitted it: a table (word, count, share of
each state) that stays distributed and grows with the corpus, as the word counts do. A text's score is the
scaled forward recursion's exact log10 probability.

A state s emits a word w outside the head with p(other | s) p(w | other, s). A word that training texts lack has
its base share of `other`; the rest is dealt to training words, LEARNT of it by the words' expected counts in
s, what remains by their base shares. So the model is a distribution over whole texts, and every training
word has emissions of its own. For the KNOWN most frequent words they are broadcast (a fixed number); the
other words of the texts are shuffled to theirs, once for each word and text, and come back to the text.

In training as in scoring, a text is one sequence, however long. Training texts are read once, as symbols,
and dealt by length, so that texts that are gone through side by side are alike in length; a very long one
is gone through in stretches of CHUNK tokens, with the states carried over their borders.

Tokens are words `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z, then one end. A null or empty text has just the
end. Repeated rows are scored each; an empty table gives no rows; extra columns are ignored, whatever their
names. With no training text N is 0, and base and model give every token its share of the +0.5 smoothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .session import Shelf
from .words import SPACED, Words, pieces

STATES = 8
HEAD = 8192
KNOWN = 65535
ROUNDS = 6
LEARNT = 0.8
PIECE = 3 << 20
#: Tokens whose states are held at a time in training.
CHUNK = 400_000
#: Sequences that are gone through side by side in training, where they are long, and most tokens of those.
ABREAST, MOST = 128, 2_000_000
#: Bytes of training text that make a group of texts of about the same length.
GROUP_BYTES = 8 << 20
#: Leading bits of a hash under which a word is looked for first.
_SLOT = np.uint64(44)
#: The hash that stands for the end of a text.
END = np.uint64(0x5EED0F7E57E4D000)


def is_held_out(doc_id: Column) -> Column:
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % 5 == 1


def tokens(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of a piece, ends included, and where each text's begin (and the end)."""
    n_texts = len(words.bounds) - 1
    begins = words.bounds + np.arange(n_texts + 1)
    out = np.empty(begins[-1], np.uint64)
    ends = begins[1:] - 1
    inside = np.ones(len(out), bool)
    inside[ends] = False
    out[inside], out[ends] = words.hashes, END
    return out, begins


def _texts(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        for lo, hi, text in pieces(batch.column(column), PIECE):
            yield (batch.slice(lo, hi - lo), *tokens(text.words(SPACED, lower=True)))


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n): how often each token, by its hash, stands in the texts. Tasks count first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        give = lambda: pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(counts)], names=["word", "n"])
        for _, found, _ in _texts(batches, 0):
            w, n = np.unique(found, return_counts=True)
            both, at = np.unique(np.concatenate([words, w]), return_inverse=True)
            words, counts = both, np.bincount(at, weights=np.concatenate([counts, n])).astype(np.int64)
            if len(words) > 2_000_000:
                yield give()
                words, counts = words[:0], counts[:0]
        yield give()

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Base:
    """The smoothed unigram distribution: totals, and the counts of the most frequent words (sorted by hash)."""

    n: int
    v: int
    words: np.ndarray
    counts: np.ndarray
    head: np.ndarray  # symbol of each of words; the last symbol for those outside the HMM's head
    symbols: int

    def __post_init__(self):
        """A place for each word by its leading bits, with the word there: the first of those that share it. `shared` are places with more than one."""
        slots = (self.words >> _SLOT).astype(np.int64)
        first = np.concatenate([np.ones(min(1, len(slots)), bool), slots[1:] != slots[:-1]])
        self.slot_word, self.slot_at = np.zeros(1 << 20, np.uint64), np.zeros(1 << 20, np.int32)
        self.slot_word[slots[first]], self.slot_at[slots[first]] = self.words[first], np.flatnonzero(first)
        self.used, self.shared = np.zeros(1 << 20, bool), np.zeros(1 << 20, bool)
        self.used[slots], self.shared[slots[~first]] = True, True

    @property
    def whole(self) -> float:
        return self.n + 0.5 * (self.v + 1)

    def lookup(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each token: whether it is among words, and its place there."""
        if not len(self.words):
            return np.zeros(len(found), bool), np.zeros(len(found), np.int64)
        slots = (found >> _SLOT).astype(np.int64)
        known, at = (self.slot_word[slots] == found) & self.used[slots], self.slot_at[slots].astype(np.int64)
        rest = np.flatnonzero(~known & self.shared[slots])
        place = np.minimum(np.searchsorted(self.words, found[rest]), len(self.words) - 1)
        known[rest], at[rest] = self.words[place] == found[rest], place
        return known, at

    def symbol_log10(self) -> np.ndarray:
        """log10 base probability of each symbol; the last has all words outside the head."""
        inside = self.head < self.symbols - 1
        p = np.zeros(self.symbols)
        p[self.head[inside]] = (self.counts[inside] + 0.5) / self.whole
        p[-1] = max(1 - p[:-1].sum(), 0.5 / self.whole)
        return np.log10(p)

    def symbols_of(self, found: np.ndarray) -> np.ndarray:
        known, at = self.lookup(found)
        return np.where(known, self.head[at] if len(self.head) else self.symbols - 1, self.symbols - 1)


def base_model(counts: DataFrame, head: int = HEAD, known: int = KNOWN) -> Base:
    total = counts.agg(F.sum("n"), F.count("*")).first()
    top = counts.orderBy(F.col("n").desc(), "word").limit(known).toArrow()
    words, n = top["word"].to_numpy().view(np.uint64), top["n"].to_numpy()
    place = np.argsort(np.lexsort((words, -n)))  # rank by count
    symbol = np.minimum(place, min(head, len(words)))
    by_hash = np.argsort(words)
    return Base(total[0] or 0, total[1], words[by_hash], n[by_hash], symbol[by_hash], min(head, len(words)) + 1)


@dataclass
class Hmm:
    """begin: states at the begin of a text; move: states x states; emit: symbols x states."""

    begin: np.ndarray
    move: np.ndarray
    emit: np.ndarray

    @staticmethod
    def start(base: Base, states: int = STATES, seed: int = 5) -> "Hmm":
        rng = np.random.Generator(np.random.PCG64(seed))
        emit = 10 ** base.symbol_log10()[:, None] * (0.2 + rng.exponential(size=(base.symbols, states)))
        move = np.full((states, states), 0.2 / states) + 0.8 * np.eye(states)
        return Hmm(np.full(states, 1 / states), move, emit / emit.sum(0))

    def single(self) -> "Hmm":
        """The same in single precision: half the memory to go through in training. Expected counts are added up in double precision."""
        return Hmm(*(x.astype(np.float32) for x in (self.begin, self.move, self.emit)))

    def log10(self, emissions: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Scaled forward recursion over each sequence, all of a piece side by side; emissions: tokens x states."""
        lengths = np.diff(begins)
        order = np.argsort(-lengths, kind="stable")
        starts, lengths = begins[:-1][order], lengths[order]
        alive = np.searchsorted(-lengths, -np.arange(1, (lengths[0] if len(lengths) else 0) + 1), side="right")
        out = np.zeros(len(order))
        alpha = np.repeat(self.begin[None], len(order), 0)
        for t, d in enumerate(alive.tolist()):
            if t:
                alpha = alpha[:d] @ self.move
            alpha = alpha[:d] * emissions[starts[:d] + t]
            scale = alpha.sum(1)
            alpha /= scale[:, None]
            out[:d] += np.log10(scale)
        back = np.empty_like(out)
        back[order] = out
        return back

    def expect(self, symbols: np.ndarray, begins: np.ndarray, chunk: int = CHUNK, seen: Callable[[np.ndarray, np.ndarray], None] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected counts (begin, move, emit) of whole sequences; seen gets places of tokens and their states' probabilities.

        Tokens are laid out by their place in the sequence, longest sequences first, so that a step is one slice.
        Steps are gone through in stretches of about `chunk` tokens: forward once, keeping the states at
        borders only, then from the last stretch to the first, each forward again and backward.
        """
        lengths = np.diff(begins)
        order = np.argsort(-lengths, kind="stable")
        starts, lengths = begins[:-1][order], lengths[order]
        n = len(self.begin)
        total = np.zeros(n), np.zeros((n, n)), np.zeros((n, len(self.emit)))
        if not len(lengths) or not lengths[0]:
            return total[0], total[1], total[2].T
        alive = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), side="right")
        stretches = np.unique(np.append(np.unique((np.cumsum(alive) - alive) // chunk, return_index=True)[1], len(alive)))
        borders: list[np.ndarray | None] = [None]
        for lo, hi in zip(stretches[:-2], stretches[1:-1], strict=True):
            borders.append(self._forward(symbols, starts, alive[lo:hi], int(lo), borders[-1])[2])
        ahead: np.ndarray | None = None  # of the step after the stretch: emission, scaled, times what follows
        for lo, hi, last in list(zip(stretches[:-1].tolist(), stretches[1:].tolist(), borders, strict=True))[::-1]:
            ahead = self._both_ways(symbols, starts, alive[lo:hi], lo, last, ahead, total, seen)
        return total[0], total[1] * self.move, total[2].T

    def _forward(self, symbols, starts, alive, lo, last):
        """Of a stretch of steps from lo on, after the states `last`: laid-out places, states at each token and at the end, scales."""
        offsets = np.concatenate([[0], np.cumsum(alive)])
        step = np.repeat(np.arange(len(alive)), alive)
        places = starts[np.arange(offsets[-1]) - offsets[step]] + step + lo
        kind = self.emit.dtype
        alpha, scale, ones = np.take(self.emit, symbols[places], axis=0, mode="clip"), np.empty(offsets[-1], kind), np.ones(len(self.begin), kind)
        room, steps = np.empty((alive[0], len(self.begin)), kind), offsets.tolist()
        for a, b in zip(steps[:-1], steps[1:], strict=True):
            now, s = alpha[a:b], scale[a:b]
            now *= self.begin if last is None else np.matmul(last[: b - a], self.move, out=room[: b - a])
            np.matmul(now, ones, out=s)
            now /= s[:, None]
            last = now
        return places, alpha, last.copy(), scale, offsets

    def _both_ways(self, symbols, starts, alive, lo, last, ahead, total, seen):
        """Adds a stretch's expected counts to total; the same for its first step as `ahead` is for the step after it."""
        places, alpha, _, scale, offsets = self._forward(symbols, starts, alive, lo, last)
        laid = symbols[places]
        onward = np.take(self.emit, laid, axis=0, mode="clip")
        onward /= scale[:, None]
        beta, back, steps = np.ones_like(alpha), np.ascontiguousarray(self.move.T), offsets.tolist()
        room = np.empty((alive[0], len(self.begin)), alpha.dtype)
        if ahead is not None:
            end = steps[-2]
            beta[end : end + len(ahead)] = ahead @ back
            total[1].__iadd__(_products(alpha[end : end + len(ahead)], ahead))
        for t in range(len(alive) - 1, 0, -1):
            a, b, d = steps[t], steps[t + 1], steps[t - 1]
            np.matmul(np.multiply(onward[a:b], beta[a:b], out=room[: b - a]), back, out=beta[d : d + b - a])
        onward *= beta
        beta *= alpha
        drift = np.matmul(beta, np.ones(len(self.begin), beta.dtype))[:, None]  # 1 but for what rounding has added up to
        beta /= drift
        onward /= drift
        step = np.repeat(np.arange(len(alive)), alive)[alive[0] :]
        before = offsets[step - 1] + np.arange(alive[0], offsets[-1]) - offsets[step]  # of each token but the first step's, the one before it
        total[1].__iadd__(_products(np.take(alpha, before, axis=0, mode="clip"), onward[alive[0] :]))
        if last is None:
            total[0].__iadd__(beta[: alive[0]].sum(0, dtype=float))
        for s in range(len(self.begin)):
            total[2][s] += np.bincount(laid, weights=beta[:, s], minlength=len(self.emit))
        if seen:
            seen(places, beta)
        carried = onward[: alive[0]].copy()
        return None if last is None else carried


def _products(a: np.ndarray, b: np.ndarray, size: int = 64) -> np.ndarray:
    """a.T @ b; blocks of rows are added up in double precision."""
    whole = len(a) // size * size
    blocks = np.matmul(a[:whole].reshape(-1, size, a.shape[1]).transpose(0, 2, 1), b[:whole].reshape(-1, size, b.shape[1]))
    return blocks.sum(0, dtype=float) + a[whole:].T @ b[whole:]


def symbol_texts(docs: DataFrame, base: Base, shelf: Shelf) -> DataFrame:
    """n, symbols (16 bits a token) and others (hashes of the tokens outside the head) of each text, dealt by length.

    Texts are in groups of about GROUP_BYTES, each of texts whose lengths differ by a quarter at most; a group is in one
    task. How large each length's share is comes from a count of bytes, of which a row a length reaches the driver.
    """
    shared = docs.sparkSession.sparkContext.broadcast(base)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    long = F.floor(F.log2(F.octet_length(text) + 16) * 3).cast("int")
    sizes = {r["long"]: r["bytes"] for r in docs.groupBy(long.alias("long")).agg(F.sum(F.octet_length(text) + 1).alias("bytes")).collect()}
    groups = F.try_element_at(F.create_map(*(F.lit(x) for k, v in sizes.items() for x in (k, 1 + v // GROUP_BYTES))), long) if sizes else F.lit(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unigram = shared.value
        for batch, found, begins in _texts(batches, 2):
            symbols = unigram.symbols_of(found)
            other = symbols == unigram.symbols - 1
            n_others = np.add.reduceat(other.astype(np.int64), begins[:-1])
            cuts = pa.array(np.concatenate([[0], np.cumsum(n_others)]).astype(np.int32))
            body, at = symbols.astype(np.uint16).tobytes(), (2 * begins).tolist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.diff(begins)), pa.array([body[i:j] for i, j in zip(at[:-1], at[1:], strict=True)], pa.binary()), pa.ListArray.from_arrays(cuts, pa.array(found[other].view(np.int64)))],
                names=["long", "deal", "n", "symbols", "others"],
            )

    rows = docs.select(long.alias("long"), F.pmod(F.monotonically_increasing_id(), groups).alias("deal"), text.alias("text"))
    made = rows.mapInArrow(run, "long int, deal bigint, n bigint, symbols binary, others array<bigint>")
    return shelf.put(made.repartition("long", "deal").sortWithinPartitions("n").select("n", "symbols", "others"))


def _sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows with about CHUNK tokens, or ABREAST long rows, their symbols, and where each text's begin."""
    for batch in batches:
        lengths = batch.column(0).to_numpy()
        ends = np.cumsum(lengths)
        lo = 0
        while lo < batch.num_rows:
            before = ends[lo - 1] if lo else 0
            most = min(MOST, max(CHUNK, ABREAST * int(lengths[lo])))
            hi = max(lo + 1, int(np.searchsorted(ends, before + most, side="right")))
            part = batch.slice(lo, hi - lo)
            symbols = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint16).astype(np.int64)
            yield part, symbols, np.concatenate([[0], ends[lo:hi] - before])
            lo = hi


def baum_welch(texts: DataFrame, base: Base, rounds: int = ROUNDS, states: int = STATES) -> Hmm:
    """The HMM after some rounds over all texts (of symbol_texts). Expected counts are summed as whole millionths, so order does not matter."""
    context = texts.sparkSession.sparkContext
    model = Hmm.start(base, states)
    prior = 10 ** base.symbol_log10()
    for _ in range(rounds):
        shared = context.broadcast(model.single())

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            hmm = shared.value
            total = [np.zeros(x.shape) for x in (hmm.begin, hmm.move, hmm.emit)]
            for _, symbols, begins in _sequences(batches):
                for part, n in zip(total, hmm.expect(symbols, begins), strict=True):
                    part += n
            flat = np.rint(np.concatenate([x.ravel() for x in total]) * 1e6).astype(np.int64)
            some = np.flatnonzero(flat)
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(flat[some])], names=["place", "n"])

        got = texts.select("n", "symbols").mapInArrow(run, "place int, n bigint").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
        flat = np.zeros(model.begin.size + model.move.size + model.emit.size)
        flat[got["place"].to_numpy()] = got["n"].to_numpy() / 1e6
        begin, move, emit = (x.reshape(y.shape) for x, y in zip(np.split(flat, np.cumsum([model.begin.size, model.move.size])), (model.begin, model.move, model.emit), strict=True))
        begin, move, emit = begin + 1 / states, move + 1 / states, emit + prior[:, None] * 10
        model = Hmm(begin / begin.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))
        shared.unpersist()
    return model


def _summed(words: np.ndarray, n: np.ndarray, states: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words with the sums of their counts and states."""
    distinct, at = np.unique(words, return_inverse=True)
    count = lambda x: np.bincount(at, weights=x, minlength=len(distinct))
    return distinct, count(n), np.stack([count(x) for x in states.T], 1) if len(words) else states


def emission_table(texts: DataFrame, base: Base, model: Hmm, shelf: Shelf) -> DataFrame:
    """word, n and shares of each training word outside the head: how often it stands, and a byte for each state's share of that.

    Expected counts are summed by tasks first, then by Spark; nothing of it goes to the driver.
    """
    states = len(model.begin)
    shared = texts.sparkSession.sparkContext.broadcast((model.single(), base.symbols - 1))
    names = [f"s{i}" for i in range(states)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hmm, other = shared.value
        empty = np.zeros(0, np.int64), np.zeros(0), np.zeros((0, states))
        words, n, sums = empty

        def give() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(words), pa.array(np.rint(n).astype(np.int64)), *(pa.array(np.rint(np.ascontiguousarray(x) * 1000).astype(np.int64)) for x in sums.T)], names=["word", "n", *names])

        for part, symbols, begins in _sequences(batches):
            mine = np.zeros((int((symbols == other).sum()), states))
            rank = np.cumsum(symbols == other) - 1

            def seen(places: np.ndarray, states_at: np.ndarray, symbols=symbols, mine=mine, rank=rank) -> None:
                own = symbols[places] == other
                mine[rank[places[own]]] = states_at[own]

            hmm.expect(symbols, begins, seen=seen)
            found = part.column(2).flatten().to_numpy()
            words, n, sums = _summed(np.concatenate([words, found]), np.concatenate([n, np.ones(len(found))]), np.concatenate([sums, mine]))
            if len(words) > 500_000:
                yield give()
                words, n, sums = empty
        yield give()

    made = texts.select("n", "symbols", "others").mapInArrow(run, "word bigint, n bigint, " + ", ".join(f"{x} bigint" for x in names))
    sums = made.groupBy("word").agg(*(F.sum(x).alias(x) for x in ("n", *names)))
    whole = F.greatest(sum((F.col(x) for x in names[1:]), F.col(names[0])), F.lit(1))
    byte = lambda x: F.round(F.col(x) * 255 / whole).cast("bigint")
    packed = sum((F.shiftleft(byte(x), 8 * i) for i, x in enumerate(names[1:], 1)), byte(names[0]))
    return shelf.put(sums.select("word", "n", packed.alias("shares")))


def _shares(packed: np.ndarray, states: int) -> np.ndarray:
    """Shares of states, summing to 1, of packed words of emission_table."""
    parts = np.ascontiguousarray(packed, np.int64).view(np.uint8).reshape(-1, 8)[:, :states].astype(np.float64)
    return parts / np.maximum(parts.sum(1, keepdims=True), 1)


@dataclass
class Emissions:
    """What states emit, as factors beside base shares: known words' (words of base x states, in its order), and what makes the others'.

    other: p(other | state); sums: expected count of each state's training words outside the head; lacking: the
    base share of words outside the head that no training text has.
    """

    known: np.ndarray
    other: np.ndarray
    sums: np.ndarray
    lacking: float
    whole: float

    def of_others(self, n: np.ndarray, shares: np.ndarray, base_share: np.ndarray) -> np.ndarray:
        """Factors of words outside the head: n of them in training (0: none), their states' shares, and their base shares of `other`."""
        learnt = np.divide(n[:, None] * shares, np.where(self.sums > 0, self.sums, 1.0)) * (1 - self.lacking) / base_share[:, None]
        return self.other * np.where((n > 0)[:, None] & (self.sums > 0), LEARNT * learnt + (1 - LEARNT), 1.0)


def emissions(table: DataFrame, base: Base, model: Hmm) -> Emissions:
    """The emissions of the base's words, fetched from the table (at most KNOWN rows), and the table's sums (one row)."""
    states, other = len(model.begin), model.emit[-1]
    byte = lambda i: F.shiftrightunsigned(F.col("shares"), 8 * i).bitwiseAND(F.lit(255).cast("bigint"))
    whole = F.greatest(sum((byte(i) for i in range(1, states)), byte(0)), F.lit(1))
    sums = table.agg(*(F.sum(F.round(F.col("n") * byte(i) * 1_000_000 / whole).cast("bigint")).alias(f"s{i}") for i in range(states))).first()
    at_other = 10 ** base.symbol_log10()[-1]
    made = Emissions(np.zeros((0, states)), other, np.array([(x or 0) / 1e6 for x in sums]), 0.5 / base.whole / at_other, base.whole)
    # frequent words only: the rest of the table stays where it is
    tail = base.words[base.head == base.symbols - 1]
    wanted = table.sparkSession.createDataFrame(pa.table({"word": tail.view(np.int64)}))
    got = table.join(F.broadcast(wanted), "word").toArrow()
    known = model.emit[base.head] if len(base.head) else np.zeros((0, states))
    at = np.searchsorted(base.words, got["word"].to_numpy().view(np.uint64)) if len(got) else np.zeros(0, np.int64)
    if len(at):
        n = got["n"].to_numpy()
        known[at] = made.of_others(n, _shares(got["shares"].to_numpy(), states), (n + 0.5) / base.whole / at_other)
    made.known = known
    return made


def score(docs: DataFrame, table: DataFrame, base: Base, model: Hmm, shelf: Shelf) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10) of each row; table: of emission_table."""
    shared = docs.sparkSession.sparkContext.broadcast((base, model, emissions(table, base, model)))
    unknown = KNOWN  # the code of tokens outside the base's words

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unigram, _, _ = shared.value
        log10 = np.log10((np.append(unigram.counts, 0) + 0.5) / unigram.whole)
        for batch, found, begins in _texts(batches, 1):
            known, at = unigram.lookup(found)
            add = lambda x: np.add.reduceat(x, begins[:-1])  # noqa: E731, B023
            places = np.flatnonzero(~known)
            owner = np.searchsorted(begins, places, side="right") - 1
            rest = found[places].view(np.int64)
            order = np.lexsort((rest, owner))
            new = np.concatenate([np.ones(min(1, len(rest)), bool), (np.diff(rest[order]) != 0) | (np.diff(owner[order]) != 0)])
            head = np.flatnonzero(new)
            bounds = np.searchsorted(owner[order][head], np.arange(len(begins)))  # of each text's distinct unknown words
            local = np.empty(len(rest), np.int64)
            local[order] = np.cumsum(new) - 1
            local -= bounds[owner]
            lists = lambda cuts, values: pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(values))
            codes, cuts = np.where(known, at, unknown).astype(np.uint16).tobytes(), (2 * begins).tolist()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(np.diff(begins).astype(np.int64)),
                    pa.array(add(known.astype(np.int64))),
                    pa.array(add(np.where(known, log10[at], 0.0))),
                    pa.array([codes[i:j] for i, j in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()),
                    lists(bounds, rest[order][head]),
                    lists(bounds, np.diff(np.append(head, len(rest))).astype(np.int32)),
                    lists(np.searchsorted(places, begins), local.astype(np.int32)),
                ],
                names=["doc_id", "n_tokens", "n_frequent", "base_frequent", "codes", "words", "times", "local"],
            )

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unigram, hmm, emitted = shared.value
        at_other = unigram.symbol_log10()[-1]
        states = len(hmm.begin)
        shares_of_known = np.where(unigram.head == unigram.symbols - 1, np.log10((unigram.counts + 0.5) / unigram.whole) - at_other, 0.0)
        for batch in batches:
            ends = np.cumsum(batch.column(1).to_numpy())
            lo = 0
            while lo < batch.num_rows:
                before = ends[lo - 1] if lo else 0
                hi = max(lo + 1, int(np.searchsorted(ends, before + CHUNK, side="right")))
                part, begins = batch.slice(lo, hi - lo), np.concatenate([[0], ends[lo:hi] - before])
                codes = np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint16).astype(np.int64)
                rare = codes == unknown
                # counts and states of each text's rare words; those that training lacks stay 0
                sizes = part.column(3).to_numpy()
                bounds = np.cumsum(sizes) - sizes
                n, packed = np.zeros(int(sizes.sum()), np.int64), np.zeros(int(sizes.sum()), np.int64)
                hits = part.column(5)
                at = np.repeat(bounds, hits.value_lengths().fill_null(0).to_numpy()) + hits.flatten().field("at").to_numpy()
                n[at], packed[at] = hits.flatten().field("n").to_numpy(), hits.flatten().field("shares").to_numpy()
                share = (n + 0.5) / unigram.whole / 10**at_other
                factors = emitted.of_others(n, _shares(packed, states), share)
                mine = part.column(4).flatten().to_numpy() + np.repeat(bounds, part.column(4).value_lengths().to_numpy())
                emission, logs = np.empty((len(codes), states)), np.empty(len(codes))
                emission[~rare], logs[~rare] = emitted.known[codes[~rare]], shares_of_known[codes[~rare]]
                emission[rare], logs[rare] = factors[mine], np.log10(share)[mine]
                total = hmm.log10(emission, begins) + np.add.reduceat(logs, begins[:-1])
                yield pa.RecordBatch.from_arrays([*part.columns[6:], part.column(1), pa.array(total)], names=[*part.schema.names[6:], "n_tokens", "score"])
                lo = hi

    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    rows = texts.mapInArrow(coded, f"doc_id {kind}, n_tokens bigint, n_frequent bigint, base_frequent double, codes binary, words array<bigint>, times array<int>, local array<int>")
    rows = shelf.put(rows.withColumn("row", F.monotonically_increasing_id()))
    each = rows.select("row", F.posexplode(F.arrays_zip("words", "times")).alias("at", "w")).select("row", "at", F.col("w.words").alias("word"), F.col("w.times").alias("n_in"))
    n = F.coalesce("n", F.lit(0))
    sums = each.join(table, "word", "left").groupBy("row").agg(
        F.sum(F.col("n_in") * F.log10((n + 0.5) / F.lit(float(base.whole)))).alias("base_rare"),
        F.sum(F.when(n > 0, F.col("n_in")).otherwise(0)).alias("n_rare"),
        F.collect_list(F.when(n > 0, F.struct("at", "n", "shares"))).alias("hits"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    both = rows.select("row", "doc_id", "n_tokens", "n_frequent", "base_frequent", "codes", F.size("words").cast("bigint").alias("n_words"), "local").join(sums, "row", "left").sortWithinPartitions("n_tokens")
    ready = both.select(
        F.lit(0).alias("zero"), "n_tokens", "codes", "n_words", "local", "hits", "doc_id",
        (F.col("n_frequent") + zero("n_rare")).cast("bigint").alias("n_known"), (F.col("base_frequent") + zero("base_rare")).alias("base_score"),
    )
    return ready.mapInArrow(scored, f"doc_id {kind}, n_known bigint, base_score double, n_tokens bigint, score double").select(
        "doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(base.n).cast("bigint").alias("train_tokens"), "base_score", "score"
    )


def base_scores(docs: DataFrame) -> DataFrame:
    """The columns of fit_and_score() that need no HMM: doc_id, held_out, n_tokens, n_known, train_tokens and base_score.

    Frequent words are scored where the text is read; of others each text's counts meet the table of counts by word.
    """
    shelf = Shelf(docs.sparkSession)
    counts = shelf.put(count_words(docs.filter(~is_held_out(F.col("doc_id")))))
    base = base_model(counts, HEAD, KNOWN)
    shared = docs.sparkSession.sparkContext.broadcast(base)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unigram = shared.value
        log10 = np.log10((np.append(unigram.counts, 0) + 0.5) / unigram.whole)
        for batch, found, begins in _texts(batches, 1):
            known, at = unigram.lookup(found)
            add = lambda x: np.add.reduceat(x, begins[:-1])  # noqa: E731, B023
            places = np.flatnonzero(~known)
            owner = np.searchsorted(begins, places, side="right") - 1
            numbers = (np.diff(begins).astype(np.int64), add(known.astype(np.int64)), add(np.where(known, log10[at], 0.0)))
            rare = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(len(begins))).astype(np.int32)), pa.array(found[places].view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, numbers), rare], names=["doc_id", "n_tokens", "n_frequent", "base_frequent", "rare"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    rows = texts.mapInArrow(run, f"doc_id {kind}, n_tokens bigint, n_frequent bigint, base_frequent double, rare array<bigint>")
    rows = shelf.put(rows.withColumn("row", F.monotonically_increasing_id()))
    n = F.coalesce("n", F.lit(0))
    each = rows.select("row", F.explode("rare").alias("word")).groupBy("row", "word").agg(F.count("*").alias("n_in"))
    sums = each.join(counts, "word", "left").groupBy("row").agg(
        F.sum(F.col("n_in") * F.log10((n + 0.5) / F.lit(float(base.whole)))).alias("base_rare"), F.sum(F.when(n > 0, F.col("n_in")).otherwise(0)).alias("n_rare")
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    return rows.select("row", "doc_id", "n_tokens", "n_frequent", "base_frequent").join(sums, "row", "left").select(
        "doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "n_tokens", (F.col("n_frequent") + zero("n_rare")).cast("bigint").alias("n_known"),
        F.lit(base.n).cast("bigint").alias("train_tokens"), (F.col("base_frequent") + zero("base_rare")).alias("base_score"),
    )


def fit_and_score(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Learns from the rows that are not held out and scores all rows."""
    shelf = Shelf(docs.sparkSession)
    training = docs.filter(~is_held_out(F.col("doc_id")))
    counts = shelf.put(count_words(training))
    base = base_model(counts, HEAD, KNOWN)
    shelf.free(counts)
    texts = symbol_texts(training, base, shelf)
    model = baum_welch(texts, base, rounds)
    table = emission_table(texts, base, model, shelf)
    shelf.free(texts)
    return score(docs, table, base, model, shelf)
