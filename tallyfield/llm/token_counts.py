"""Token counts under a unigram vocabulary, by dynamic programming shared along a trie.

Distinct pre-tokens (a word with a leading word mark) go into a trie.  A node stands for a prefix and holds
the forward score of its best segmentation and the tokens in it; both follow from the node's ancestors, so
a prefix that many words share is worked out once.  A document's count is the sum of its words' terminal
counts.  Beyond ``TRIE_DEPTH`` characters a word goes on without nodes: a step needs only the scores of as many
positions as the longest piece has characters.  Rows stay where they are: every task keeps a trie of bounded
size and nothing is shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfield.llm.common import Remember, byte_texts, in_parts, split_words

WORD_MARK = "▁"
CHUNK_BYTES = 1 << 20
#: Nodes a task's trie may hold before it starts again; bounds memory, not the result.
TRIE_NODES = 500_000
#: Characters of a word that get nodes.
TRIE_DEPTH = 256
_NO_TAIL = object()


@dataclass(frozen=True)
class Vocabulary:
    """Pieces with log-probabilities; a character in no piece costs ``unknown`` and counts as its UTF-8 bytes."""

    scores: dict[str, float]
    unknown: float

    def tails(self) -> dict[str, float | None]:
        """Every ending of every piece of two characters or more, with its score if it is a piece itself."""
        endings = {piece[i:] for piece in self.scores for i in range(len(piece) - 1)}
        return {x: self.scores.get(x) for x in endings}


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def zipf_vocabulary(model_file: str) -> Vocabulary:
    """The pieces of a sentencepiece file in their order, with probabilities inverse to their rank."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    plain = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    whole = math.log(sum(1 / (r + 1) for r in range(len(plain))))
    scores = {model.id_to_piece(i): -math.log(r + 1) - whole for r, i in enumerate(plain)}
    return Vocabulary(scores, min(scores.values(), default=0.0) - 10)


class PretokenTrie:
    """Forward scores and token counts of all prefixes of the pre-tokens seen, each worked out once."""

    def __init__(self, vocabulary: Vocabulary):
        self.scores, self.unknown, self.tails = vocabulary.scores, vocabulary.unknown, vocabulary.tails()
        self.longest = max(map(len, self.scores), default=1)
        self.reset()

    def reset(self) -> None:
        self.child: dict[tuple[int, str], int] = {}
        self.best, self.count = [0.0], [0]

    def tokens(self, pretoken: str) -> int:
        """Tokens in the best segmentation: largest score, then fewest tokens."""
        if len(self.best) > TRIE_NODES:
            self.reset()
        node, best, count = 0, [0.0], [0]
        for end, c in enumerate(pretoken[:TRIE_DEPTH], 1):
            after = self.child.get((node, c))
            if after is None:
                score, n = self._step(pretoken, end, best, count, 0)
                after = self.child[node, c] = len(self.best)
                self.best.append(score)
                self.count.append(n)
            node = after
            best.append(self.best[node])
            count.append(self.count[node])
        first = 0  # the position that best[0] and count[0] are about
        for end in range(TRIE_DEPTH + 1, len(pretoken) + 1):
            score, n = self._step(pretoken, end, best, count, first)
            best.append(score)
            count.append(n)
            if len(best) > 2 * self.longest + 2:
                first += len(best) - self.longest - 1
                best, count = best[-self.longest - 1 :], count[-self.longest - 1 :]
        return count[-1]

    def _step(self, pretoken: str, end: int, best: list[float], count: list[int], first: int) -> tuple[float, int]:
        """Score and tokens of the first ``end`` characters, from those of the positions before."""
        c = pretoken[end - 1]
        known = self.scores.get(c)
        score = best[end - 1 - first] + (self.unknown if known is None else known)
        n = count[end - 1 - first] + (len(c.encode()) if known is None else 1)
        for begin in range(end - 2, max(first, end - self.longest) - 1, -1):
            piece = self.tails.get(pretoken[begin:end], _NO_TAIL)
            if piece is _NO_TAIL:  # then nothing that begins before it ends a piece either
                break
            if piece is not None:
                value = best[begin - first] + piece
                if value > score or value == score and count[begin - first] + 1 < n:
                    score, n = value, count[begin - first] + 1
        return score, n


def _counted(vocabulary: Vocabulary):
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = PretokenTrie(vocabulary)
        terminal = Remember(lambda word: trie.tokens(WORD_MARK + word.decode()))

        def sums(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            words, counts = split_words(byte_texts(part))
            tokens = np.fromiter(map(terminal.__getitem__, words), np.int64, len(words))
            ends = np.concatenate(([0], np.cumsum(tokens)))[np.concatenate(([0], np.cumsum(counts)))]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(counts), pa.array(np.diff(ends))], ["doc_id", "n_words", "n_tokens"])

        yield from in_parts(batches, "text", CHUNK_BYTES, sums)

    return counted


def token_counts(docs: DataFrame, vocabulary: Vocabulary | None = None) -> DataFrame:
    """doc_id, n_words, n_tokens for every row of (doc_id, text).

    Null and empty texts have no tokens; null ids and repeated rows are kept; other columns are left out;
    an empty table gives no rows.  Words are runs of anything but ASCII white space, of any length.
    """
    vocabulary = vocabulary or zipf_vocabulary(default_model())
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_counted(vocabulary), "doc_id long, n_words long, n_tokens long")
