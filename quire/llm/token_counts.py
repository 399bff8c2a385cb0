"""Unigram token counts by dynamic programming over a trie.

Texts are cut into pre-tokens: a run of white space up to its last space, or a word with the one space before it. The pieces of a public
vocabulary, with log-probabilities by rank, define a unigram segmentation of each pre-token: the one with the greatest sum, and of those the one
with the fewest pieces. Each task keeps a trie of the distinct pre-tokens it has met. A node holds the best forward score of its prefix,
computed once however many pre-tokens share it, and a pre-token's last node holds its count, which later texts look up.

One pass over the texts, no shuffle: any split of the rows gives the same counts. The trie is bounded; when it is full, it starts afresh.

Defined results: a null or empty text has 0 pre-tokens and 0 tokens; repeated rows are counted each; a byte that no piece covers counts as
one token; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quire.llm.common import load

#: Fixed value: bytes of white space, then of a word with the space before it.
PRETOKEN = re.compile(rb" ?[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+?(?= [^\x20\x09-\x0D])|[\x20\x09-\x0D]+")
#: Scores are whole numbers of this fraction, so that sums are exact.
UNIT = 1 << 16


def scores_of(path: str) -> dict[bytes, int]:
    """Pieces of a vocabulary of ranks, with the logarithm of a probability that falls as 1 / rank."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    mass = math.log(sum(1 / (r + 1) for r in ranks.values()))
    return {piece: round(-UNIT * (math.log(r + 1) + mass)) for piece, r in ranks.items()}


class Trie:
    """Forward scores by prefix. Children are found by (node, byte); a node's path is a pre-token's prefix."""

    def __init__(self, scores: dict[bytes, int], most_nodes: int = 1_000_000):
        self.scores, self.most = scores, most_nodes
        self.longest = max(map(len, scores), default=1)
        self.unknown = min(scores.values(), default=0) - 10 * UNIT
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}
        self.best = [(0, 0)]  # score and, counted down, pieces: the greater pair is the better one
        self.terminal: dict[bytes, int] = {}

    def insert(self, word: bytes) -> int:
        """The count of a pre-token, which is stored."""
        if len(self.best) + len(word) > self.most:
            self.clear()
        node, path, best, child = 0, [self.best[0]], self.best, self.child
        for end, byte in enumerate(word, 1):
            key = node << 8 | byte
            node = child.get(key, 0)
            if not node:
                found = [
                    (path[start][0] + score, path[start][1] - 1) for start in range(max(0, end - self.longest), end) if (score := self.scores.get(word[start:end])) is not None
                ]
                if not found or word[end - 1 : end] not in self.scores:
                    found.append((path[end - 1][0] + self.unknown, path[end - 1][1] - 1))
                node = child[key] = len(best)
                best.append(max(found))
            path.append(best[node])
        self.terminal[word] = -path[-1][1]
        return -path[-1][1]

    def count(self, words: list[bytes]) -> int:
        terminal = self.terminal
        total = 0
        for w in words:
            n = terminal.get(w)
            total += self.insert(w) if n is None else n
        return total


def token_counts(docs: DataFrame, id_col="doc_id", text_col="text", vocabulary: str | None = None, most_nodes: int = 1_000_000) -> DataFrame:
    """(id, n_bytes, n_pretokens, n_tokens) for each row. vocabulary: path of a file of base64 pieces and ranks, read by the driver."""
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken")
    held = docs.sparkSession.sparkContext.broadcast(scores_of(vocabulary))
    kind = docs.schema[id_col].dataType

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(held.value, most_nodes)
        for batch in batches:
            out: list[tuple[int, int, int]] = []
            for text in batch.column(1):
                raw = (text.as_py() or "").encode()
                words = PRETOKEN.findall(raw)
                out.append((len(raw), len(words), trie.count(words)))
            cols = [pa.array([x[i] for x in out], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["id", "n_bytes", "n_pretokens", "n_tokens"])

    return docs.select(id_col, text_col).mapInArrow(count, f"id {kind.simpleString()}, n_bytes long, n_pretokens long, n_tokens long")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(load(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
