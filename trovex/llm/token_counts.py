"""Tokens of each text under a unigram model, by dynamic programming over a trie of distinct pre-tokens.

A pre-token is a word with the word mark before it.  The best segmentation of a string's first i characters depends on
these characters only, so pre-tokens that share a prefix share its scores.  A task keeps a trie of the distinct
pre-tokens that it has met: each node has the best score of its prefix and the tokens of that segmentation, computed
once, when the node is new, from the nodes above it; a word's count is that of its terminal node.  Beyond KEPT nodes
the trie starts anew.  Characters outside the vocabulary count one token for each UTF-8 byte.

The pieces are those of a public vocabulary.  It has merges and no unigram scores, and tokenizers are not trained here,
so the scores are a stand-in: they fall with the logarithm of a piece's rank.  Any other scores can be given.

Among segmentations of equal score the one with fewer tokens counts.  Null and empty texts have no tokens.  Very long
texts are counted whole; of a very long word the first LONG characters become nodes, the rest is computed along them.
Repeated rows count alike.  Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import math
from array import array

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trovex.llm.common import WORD, longs, mapped, strings
from trovex.llm.encoding import found

MARK = "▁"
#: Nodes and words that a worker keeps, about 130 and 110 bytes each; characters of a word that become nodes.
KEPT, KEPT_WORDS, LONG = 2_000_000, 1_000_000, 200


class PieceTrie(dict):
    """A trie of pre-tokens with the best score and the token count of each prefix under unigram scores.

    As a dictionary it has the tokens at the terminal node of each whole word, which is counted when it is asked for.
    """

    def __init__(self, scores: dict[str, float]):
        super().__init__()
        self.scores = scores
        #: The longest piece by its last three characters; pieces with other endings are shorter than three.
        self.longest: dict[str, int] = {}
        for piece in scores:
            if len(piece) > 2:
                self.longest[piece[-3:]] = max(len(piece), self.longest.get(piece[-3:], 0))
        #: A score for each byte of a character without a piece.
        self.byte = min(scores.values(), default=0.0) - 10.0
        self.start_anew()

    def start_anew(self) -> None:
        self.clear()
        self.children: dict[int, int] = {}  # node and character -> node
        self.best, self.tokens = array("d", [0.0]), array("l", [0])

    def step(self, text: str, end: int, best: list[float], tokens: list[int]) -> tuple[float, int]:
        """Score and tokens of text[:end], from those of all shorter prefixes."""
        scores, c = self.scores, text[end - 1]
        top, n = -math.inf, 0
        if c not in scores:
            size = len(c.encode("utf-8", "surrogatepass"))
            top, n = best[end - 1] + size * self.byte, tokens[end - 1] + size
        for start in range(max(0, end - self.longest.get(text[max(0, end - 3) : end], 2)), end):
            s = scores.get(text[start:end])
            if s is not None:
                s += best[start]
                if s > top or s == top and tokens[start] + 1 < n:
                    top, n = s, tokens[start] + 1
        return top, n

    def count(self, word: str) -> int:
        """The tokens of a word; prefixes that the trie has are not computed again."""
        text, node = MARK + word, 0
        best, tokens = [0.0], [0]
        for end in range(1, min(len(text), LONG) + 1):
            edge = node << 21 | ord(text[end - 1])
            node = self.children.get(edge, 0)
            if not node:
                node = self.children[edge] = len(self.best)
                top, n = self.step(text, end, best, tokens)
                self.best.append(top)
                self.tokens.append(n)
            best.append(self.best[node])
            tokens.append(self.tokens[node])
        for end in range(LONG + 1, len(text) + 1):
            top, n = self.step(text, end, best, tokens)
            best.append(top)
            tokens.append(n)
        return tokens[-1]

    def __missing__(self, word: str) -> int:
        self[word] = n = self.count(word)
        return n


def ranked_scores(path: str) -> dict[str, float]:
    """Scores of the pieces of a sentencepiece model: minus the logarithm of their rank among the ordinary pieces."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    own = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    pieces = [model.id_to_piece(i) for i in sorted(own, key=lambda i: (-model.get_score(i), i))]
    return {p: -math.log(rank + 2) for rank, p in reversed(list(enumerate(pieces)))}


_tries: dict[str, PieceTrie] = {}


def trie(path: str) -> PieceTrie:
    """This worker's trie of a vocabulary: the path of a file, or the name of a public one."""
    if path not in _tries:
        _tries[path] = PieceTrie(ranked_scores(found(path)))
    return _tries[path]


def token_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, n_words, n_tokens) of every whole text."""

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        own, texts = trie(vocabulary), strings(batch.column(1))
        if len(own.best) > KEPT or len(own) > KEPT_WORDS:
            own.start_anew()
        words, tokens = [], []
        for text in texts:
            found = WORD.findall(text)
            words.append(len(found))
            tokens.append(sum(map(own.__getitem__, found)))
        return pa.record_batch([batch.column(0), longs(words), longs(tokens)], ["doc_id", "n_words", "n_tokens"])

    return mapped(docs.select(F.col("doc_id").cast("long"), "text"), count, "doc_id long, n_words long, n_tokens long")
