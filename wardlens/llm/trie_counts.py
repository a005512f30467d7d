"""Token counts under a unigram model by dynamic programming over a trie of pre-tokens."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

MARK = "▁"  # begins a pre-token, in place of the space before it
# Nodes a worker's trie may hold; when it is full the worker begins a new one.
NODES = 400_000
# Characters of one pre-token that enter the trie. A longer one is scored alone, its prefixes are not kept.
DEEP = 64


def zipf_scores(model_path: str) -> dict[str, float]:
    """Pieces of a SentencePiece vocabulary with log probabilities by Zipf's law over their order of merit.

    The public file orders its pieces by merit but has no probabilities; 1 / (rank + 10), normalised, stands for them.
    Control, unknown and byte pieces are no text and stay out.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    pieces = [
        model.id_to_piece(i) for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
    ]
    total = math.log(sum(1 / (rank + 10) for rank in range(len(pieces))))
    return {piece: -math.log(rank + 10) - total for rank, piece in enumerate(pieces)}


class Trie:
    """Best segmentations of all prefixes of the pre-tokens seen so far.

    A node is a prefix and holds (score, tokens, characters that no piece covers) of its best segmentation. A new node
    looks at the pieces that end at it and at the nodes where these pieces start, all of them its ancestors, so a prefix
    is scored once however many pre-tokens share it. Of segmentations with equal scores the one whose last piece is
    longest counts. A character without a piece is one unknown token at a fixed price.
    """

    def __init__(self, scores: dict[str, float]) -> None:
        self.scores = scores
        self.longest = max(map(len, scores), default=1)
        self.unknown = min(scores.values(), default=0.0) - 10.0
        # endings[c]: lengths of the pieces that end with the character c, longest first
        ends: dict[str, set[int]] = {}
        for piece in scores:
            ends.setdefault(piece[-1], set()).add(len(piece))
        self.endings = {c: sorted(n, reverse=True) for c, n in ends.items()}
        self.nodes: dict[str, tuple[float, int, int]] = {"": (0.0, 0, 0)}

    def _score(self, text: str, before: dict) -> tuple[float, int, int]:
        """The node of ``text``; ``before`` holds those of its prefixes."""
        end, scores = len(text), self.scores
        best = None
        for n in self.endings.get(text[-1], ()):
            if n > end:
                continue
            piece = scores.get(text[end - n :])
            if piece is not None:
                from_ = before[text[: end - n]]
                total = from_[0] + piece
                if best is None or total > best[0]:
                    best = (total, from_[1] + 1, from_[2])
        from_ = before[text[:-1]]
        total = from_[0] + self.unknown
        return (total, from_[1] + 1, from_[2] + 1) if best is None or total > best[0] else best

    def _alone(self, text: str) -> tuple[float, int, int]:
        """A very long pre-token: the same recurrence over positions, in memory of its length."""
        table = [(0.0, 0, 0)]
        for end in range(1, len(text) + 1):
            best = (table[-1][0] + self.unknown, table[-1][1] + 1, table[-1][2] + 1)
            covered = None
            for n in self.endings.get(text[end - 1], ()):
                piece = self.scores.get(text[end - n : end]) if n <= end else None
                if piece is not None:
                    from_ = table[end - n]
                    if covered is None or from_[0] + piece > covered[0]:
                        covered = (from_[0] + piece, from_[1] + 1, from_[2])
            table.append(best if covered is None or best[0] > covered[0] else covered)
        return table[-1]

    def terminal(self, word: str) -> tuple[float, int, int]:
        """(score, tokens, unknown characters) of a pre-token."""
        nodes = self.nodes
        found = nodes.get(word)
        if found is not None:
            return found
        if len(word) > DEEP:
            return self._alone(word)
        if len(nodes) > NODES:
            nodes.clear()
            nodes[""] = (0.0, 0, 0)
        k = len(word) - 1
        while word[:k] not in nodes:
            k -= 1
        for end in range(k + 1, len(word) + 1):
            prefix = word[:end]
            nodes[prefix] = self._score(prefix, nodes)
        return nodes[word]


_tries: dict[str, Trie] = {}


def token_counts(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, n_pretokens, n_tokens, n_unknown, score) for every row of ``docs`` (doc_id, text).

    Pre-tokens are the words [^\\x20\\x09-\\x0D]+ with a mark in front; a document's counts and log score are the sums over
    its pre-tokens. The distinct pre-tokens of a block of documents enter the worker's trie in sorted order, so shared
    prefixes meet; a document then only looks its terminals up. Nothing is shuffled and memory is bounded by the block
    and the trie's size. Null and empty texts have no pre-tokens (counts and score 0). Repeated rows are counted each;
    an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model_path not in _tries:
            _tries[model_path] = Trie(zipf_scores(model_path))
        trie = _tries[model_path]
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                split = [(t.as_py() or "").encode().split() for t in batch.column(1)]
                distinct = sorted({w for words in split for w in words})
                place = {w: k for k, w in enumerate(distinct)}
                ends = np.array([trie.terminal(MARK + w.decode()) for w in distinct]).reshape(-1, 3)
                sums = [ends[np.fromiter(map(place.__getitem__, w), np.int64, len(w))].sum(axis=0) for w in split]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([len(w) for w in split], pa.int64()),
                     pa.array([int(s[1]) for s in sums], pa.int64()), pa.array([int(s[2]) for s in sums], pa.int64()),
                     pa.array([float(s[0]) for s in sums], pa.float64())],
                    ["doc_id", "n_pretokens", "n_tokens", "n_unknown", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n_pretokens long, n_tokens long, n_unknown long, score double")
