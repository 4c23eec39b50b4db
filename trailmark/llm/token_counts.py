"""Token counts under a unigram model, by dynamic programming on a trie of distinct pre-tokens.

A pre-token is a run of characters other than ASCII white space, with the mark U+2581 before it.  Its
segmentation is the one of most log-probability.  The best score of a prefix does not depend on what
follows, so distinct pre-tokens are put into a trie and each node is scored once, for all pre-tokens
that pass it; the node where a pre-token ends keeps its number of tokens.  Levels of the trie are
processed with numpy, and the pieces that end at a node are found by walking a trie of the vocabulary.
Pre-tokens of more than ``LONGEST`` bytes share little; each goes through the same forward pass alone.

The vocabulary comes from a sentencepiece file; the model gives the piece of rank r the probability
proportional to 1 / (r + 1), and a byte that no piece covers costs ``BYTE_COST`` more than the rarest piece.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as X

MARK = "▁".encode()
BYTE_COST = 10.0
#: A pre-token of more bytes is scored by itself, not in a trie, and not kept.
LONGEST = 512
#: Distinct pre-tokens that a worker keeps, and how many go into one trie.
MOST_WORDS, TRIE_WORDS = 400_000, 20_000


def vocabulary(model_file: str) -> tuple[list[bytes], np.ndarray]:
    """Pieces and log-probabilities of a sentencepiece file; control and byte pieces are left out."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    names = [sp.id_to_piece(i).encode() for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i) or sp.is_unused(i))]
    rank = np.arange(1, len(names) + 1)
    return names, -np.log(rank) - np.log((1.0 / rank).sum())


class Pieces:
    """The vocabulary as a trie: sorted transitions (state, byte) -> state, and the score that ends at a state."""

    def __init__(self, names: list[bytes], scores: np.ndarray):
        order = sorted(range(len(names)), key=lambda i: names[i])
        self.longest = max(map(len, names), default=1)
        state: dict[bytes, int] = {b"": 0}
        edges: dict[int, int] = {}
        value = {0: -np.inf}
        for i in order:
            name = names[i]
            at = 0
            for j, byte in enumerate(name):
                to = state.get(name[: j + 1])
                if to is None:
                    to = state[name[: j + 1]] = len(state)
                    edges[(at << 8) | byte] = to
                at = to
            value[at] = max(value.get(at, -np.inf), float(scores[i]))
        self.edges, self.ends = edges, value
        self.keys = np.array(sorted(edges), np.int64)
        self.to = np.array([edges[k] for k in self.keys.tolist()], np.int64)
        self.value = np.full(len(state), -np.inf)
        self.value[list(value)] = list(value.values())
        self.byte = float(scores.min()) - BYTE_COST if len(scores) else -BYTE_COST

    def step(self, states: np.ndarray, byte: np.ndarray) -> np.ndarray:
        at = X.member((states << 8) | byte, self.keys)
        return np.where(at >= 0, self.to[at], -1)


def trie_counts(words: list[bytes], pieces: Pieces) -> np.ndarray:
    """The number of tokens of each word: one pass over the levels of the words' trie."""
    order = sorted(range(len(words)), key=words.__getitem__)
    data = np.frombuffer(b"".join(words[i] for i in order), np.uint8)
    length = np.array([len(words[i]) for i in order], np.int64)
    begin = np.cumsum(length) - length
    out = np.zeros(len(words), np.int64)
    span = pieces.longest
    # per node of the level: best score and count of the last ``span`` prefixes, and the states of the runs that end here
    best, count = np.full((1, span), -np.inf), np.zeros((1, span), np.int64)
    best[0, 0] = 0
    runs = np.full((1, span), -1, np.int64)
    node = np.zeros(len(words), np.int64)
    alive = np.arange(len(words))[length > 0]
    depth = 0
    while len(alive):
        byte = data[begin[alive] + depth].astype(np.int64)
        key = (node[alive] << 8) | byte
        fresh = np.ones(len(key), bool)
        fresh[1:] = key[1:] != key[:-1]  # words are sorted, so equal prefixes stand together
        parent, letter = node[alive][fresh], byte[fresh]
        node[alive] = np.cumsum(fresh) - 1
        n = len(parent)
        starts = np.full((n, span), -1, np.int64)
        starts[:, 0] = 0
        starts[:, 1:] = runs[parent, :-1]
        r, c = np.nonzero(starts >= 0)
        runs = np.full((n, span), -1, np.int64)
        runs[r, c] = pieces.step(starts[r, c], letter[r])
        score = np.full((n, span), -np.inf)
        r, c = np.nonzero(runs >= 0)
        score[r, c] = best[parent[r], c] + pieces.value[runs[r, c]]
        score[:, 0] = np.maximum(score[:, 0], best[parent, 0] + pieces.byte)
        pick = np.argmax(score, axis=1)
        rows = np.arange(n)
        new_best, new_count = np.empty((n, span)), np.empty((n, span), np.int64)
        new_best[:, 0], new_count[:, 0] = score[rows, pick], count[parent, pick] + 1
        new_best[:, 1:], new_count[:, 1:] = best[parent, :-1], count[parent, :-1]
        best, count = new_best, new_count
        depth += 1
        done = length[alive] == depth
        out[np.asarray(order)[alive[done]]] = count[node[alive[done]], 0]
        alive = alive[~done]
    return out


def long_count(word: bytes, pieces: Pieces) -> int:
    """The number of tokens of one word of any length: the same scores, keeping those of the last ``longest`` prefixes only."""
    ring = pieces.longest + 1
    best, count = [-np.inf] * ring, [0] * ring
    best[0] = 0.0
    edges, ends, low = pieces.edges, pieces.ends, pieces.byte
    for at in range(len(word)):
        here = at % ring
        score, tokens = best[here], count[here] + 1
        best[here] = -np.inf  # free for the prefix of ``ring`` bytes more
        state = 0
        for to in range(at, min(at + pieces.longest, len(word))):
            state = edges.get((state << 8) | word[to])
            if state is None:
                break
            value = ends.get(state)
            slot = (to + 1) % ring
            if value is not None and score + value >= best[slot]:  # of equal scores the shortest last piece, as in the trie
                best[slot], count[slot] = score + value, tokens
        slot = (at + 1) % ring
        if score + low >= best[slot]:
            best[slot], count[slot] = score + low, tokens
    return count[len(word) % ring]


def pretokens(text: str) -> list[bytes]:
    return [MARK + word for word in text.encode().split()]


class Counter:
    """Counts of texts; a table of the pre-tokens seen, bounded by MOST_WORDS."""

    def __init__(self, model_file: str):
        self.pieces = Pieces(*vocabulary(model_file))
        self.known: dict[bytes, int] = {}

    def count(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        flat: list[bytes] = []
        first = np.zeros(len(texts) + 1, np.int64)
        for i, text in enumerate(texts):
            if text:
                flat += pretokens(text)
            first[i + 1] = len(flat)
        words = set(flat)
        long = {w: long_count(w, self.pieces) for w in words if len(w) > LONGEST}
        words -= long.keys()
        fresh = words - self.known.keys()
        if len(self.known) + len(fresh) > MOST_WORDS:
            self.known = {}
            fresh = words
        todo = sorted(fresh)
        for at in range(0, len(todo), TRIE_WORDS):
            part = todo[at : at + TRIE_WORDS]
            self.known.update(zip(part, trie_counts(part, self.pieces).tolist(), strict=True))
        sums = np.zeros(len(flat) + 1, np.int64)
        np.cumsum(np.fromiter((long[w] if len(w) > LONGEST else self.known[w] for w in flat), np.int64, len(flat)), out=sums[1:])
        return np.diff(first), np.diff(sums[first])


@lru_cache(maxsize=1)
def _counter(model_file: str) -> Counter:
    """One counter for all tasks of a worker, with the pre-tokens it has met."""
    return Counter(model_file)


def token_counts(docs: DataFrame, model_file: str, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_pretokens, n_tokens`` of every whole text; nothing is shuffled.

    Null, empty and blank texts have no tokens; repeated rows each give their row; an empty table gives none.
    """

    def run(batches):
        counter = _counter(model_file)
        for batch in batches:
            for part in X.slices(batch, "text"):
                words, tokens = counter.count(part.column("text").to_pylist())
                yield pa.record_batch([part.column("doc_id"), pa.array(words), pa.array(tokens)], ["doc_id", "n_pretokens", "n_tokens"])

    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = base.schema["doc_id"].dataType.simpleString()
    return base.mapInArrow(run, f"doc_id {kind}, n_pretokens long, n_tokens long")
