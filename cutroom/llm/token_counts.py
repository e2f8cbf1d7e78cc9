"""Token counts under a unigram model, by dynamic programming over a trie of pre-tokens.

A text is cut into pre-tokens; each distinct one is inserted, byte by byte, in a trie. A trie node keeps
the best forward score of its prefix, the number of pieces on that path, and the pieces still open there,
so prefixes that pre-tokens share are scored once. A pre-token's last node has its count; a text's count
is the sum over its pre-tokens. Among paths of equal score the one with fewer pieces counts.

Scores: a vocabulary file ranks its pieces; the unigram probability of rank r is taken as proportional to
1 / (r + 1). Bytes outside the vocabulary count as one piece each, scored below all others.

A null or empty text has 0 pre-tokens and 0 tokens. Whole texts of any length are counted; memory holds
one text and a trie of at most NODES nodes (then it begins anew, which changes no count). Repeated rows
are counted each; an empty table gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import gc
import math
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: the published splitting pattern of the byte-level vocabularies.
PRE_TOKEN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
NODES = 400_000
_SCORE = -1


def read_ranks(path: str = VOCABULARY) -> list[bytes]:
    """The pieces of a rank file, best first."""
    with open(path, "rb") as file:
        pairs = [line.split() for line in file if line.strip()]
    return [base64.b64decode(piece) for piece, _ in sorted(pairs, key=lambda p: int(p[1]))]


def zipf_scores(ranked: list[bytes]) -> dict[bytes, float]:
    whole = math.log(sum(1 / (r + 1) for r in range(len(ranked)))) if ranked else 0.0
    return {piece: -math.log(r + 1) - whole for r, piece in enumerate(ranked)}


class TokenTrie:
    def __init__(self, scores: dict[bytes, float], nodes: int = NODES):
        self.pieces: dict = {}  # byte -> what may follow; at _SCORE, the score of the piece that ends here
        for piece, score in scores.items():
            at = self.pieces
            for b in piece:
                at = at.setdefault(b, {})
            if piece:
                at[_SCORE] = score
        self.unknown = min(scores.values(), default=0.0) - 10.0
        self.most = nodes
        self.clear()

    def clear(self) -> None:
        self.edges: dict[int, int] = {}
        self.best, self.count = [0.0], [0]
        self.open: list[list[tuple]] = [[(self.pieces, 0.0, 0)]]
        self.counts: dict[str, int] = {"": 0}
        self.scores: dict[str, float] = {"": 0.0}

    def _grow(self, at: int, b: int) -> int:
        best, count, still = -math.inf, 0, []
        for piece, score, n in self.open[at]:
            went = piece.get(b)
            if went is not None:
                still.append((went, score, n))
                ends = went.get(_SCORE)
                if ends is not None and ((s := score + ends) > best or (s == best and n + 1 < count)):
                    best, count = s, n + 1
        if count == 0:
            best, count = self.best[at] + self.unknown, self.count[at] + 1
        still.append((self.pieces, best, count))
        self.best.append(best)
        self.count.append(count)
        self.open.append(still)
        self.edges[at << 8 | b] = len(self.best) - 1
        return len(self.best) - 1

    def insert(self, token: str) -> tuple[int, float]:
        """Pieces and score of a pre-token."""
        at, edges = 0, self.edges
        for b in token.encode():
            at = edges.get(at << 8 | b) or self._grow(at, b)
        self.counts[token], self.scores[token] = self.count[at], self.best[at]
        return self.count[at], self.best[at]

    def text(self, tokens: list[str]) -> tuple[int, float]:
        if len(self.best) > self.most or len(self.counts) > self.most:
            self.clear()
        for token in set(tokens).difference(self.counts):
            self.insert(token)
        return sum(map(self.counts.__getitem__, tokens)), math.fsum(map(self.scores.__getitem__, tokens))


def count_tokens(docs: DataFrame, scores: dict[bytes, float], pattern: str = PRE_TOKEN) -> DataFrame:
    """doc_id, n_pretokens, n_tokens and log_score (natural log). No shuffle; the vocabulary, of fixed size, is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(scores)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, cut = TokenTrie(shared.value), regex.compile(pattern)
        collects = gc.isenabled()
        gc.disable()  # a trie has no cycles, and the collector would go through all of it again and again
        try:
            for batch in batches:
                for lo in range(0, batch.num_rows, 1000):
                    part = batch.slice(lo, 1000)
                    n_pre, n_tok, score = [], [], []
                    for text in part.column(1):
                        tokens = cut.findall(text.as_py() or "")
                        n, s = trie.text(tokens)
                        n_pre.append(len(tokens))
                        n_tok.append(n)
                        score.append(s)
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n_pre, pa.int64()), pa.array(n_tok, pa.int64()), pa.array(score, pa.float64())], names=["doc_id", "n_pretokens", "n_tokens", "log_score"])
        finally:
            if collects:  # the worker process goes on to other tasks
                gc.enable()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n_pretokens bigint, n_tokens bigint, log_score double")
