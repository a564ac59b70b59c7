"""Token counts by greedy longest match with a linear automaton.

The vocabulary forms a trie. Each node knows where matching goes on when the next byte leaves the trie (failure link) and
how many pieces are complete by then (popped count), so a word is read once, without going back and without building
pieces: the number of tokens is the sum of popped counts along its failure links.

Defined cases: a null or empty text has no tokens; a word that the vocabulary cannot cover counts as one unknown token;
equal rows count alike; an empty table gives no rows.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RESULT = "doc_id long, n_words long, n_bytes long, n_tokens long, n_unknown long"


class Automaton:
    """Longest-match counter over byte pieces; ``start`` marks the beginning of a word."""

    def __init__(self, pieces: Iterable[bytes], start: bytes = b" "):
        self.start = start
        step: dict[int, int] = {}
        final = [False]
        for piece in pieces:
            node = 0
            for byte in piece:
                nxt = step.get(node << 8 | byte)
                if nxt is None:
                    nxt = step[node << 8 | byte] = len(final)
                    final.append(False)
                node = nxt
            final[node] = node != 0
        children: list[list[tuple[int, int]]] = [[] for _ in final]
        for key, child in step.items():
            children[key >> 8].append((key & 255, child))
        fail, popped = [-1] * len(final), [0] * len(final)
        level = [0]
        while level:
            below = []
            for node in level:
                for byte, child in children[node]:
                    if final[child]:
                        fail[child], popped[child] = 0, 1
                    else:
                        back, count = fail[node], popped[node]
                        while back >= 0 and back << 8 | byte not in step:
                            count += popped[back]
                            back = fail[back]
                        if back >= 0:
                            fail[child], popped[child] = step[back << 8 | byte], count
                    below.append(child)
            level = below
        self.step, self.fail, self.popped = step, fail, popped

    def count(self, word: bytes) -> int:
        """Pieces of one word; -1 if the vocabulary cannot cover it."""
        step, fail, popped = self.step, self.fail, self.popped
        node = total = 0
        for byte in self.start + word:
            nxt = step.get(node << 8 | byte)
            while nxt is None:
                total += popped[node]
                node = fail[node]
                if node < 0:
                    return -1
                nxt = step.get(node << 8 | byte)
            node = nxt
        while node > 0:
            total += popped[node]
            node = fail[node]
        return total if node == 0 else -1


def read_ranks(path: str) -> list[bytes]:
    """Byte pieces of a vocabulary file with one base64 piece and rank a line."""
    with open(path, "rb") as f:
        return [base64.b64decode(line.split()[0]) for line in f if line.strip()]


_automata: dict[str, tuple[Automaton, dict[bytes, int]]] = {}


def _counts(vocabulary: str, id_col: str, text_col: str, keep: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary not in _automata:
            _automata[vocabulary] = Automaton(read_ranks(vocabulary)), {}
        automaton, known = _automata[vocabulary]
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                words, sizes, tokens, unknown = [], [], [], []
                for text in batch.column(text_col).to_pylist():
                    data = (text or "").encode()
                    own = data.split()
                    total = missed = 0
                    for word in own:
                        n = known.get(word)
                        if n is None:
                            if len(known) >= keep:
                                known.clear()
                            n = known[word] = automaton.count(word)
                        if n < 0:
                            missed += 1
                            n = 1
                        total += n
                    words.append(len(own)), sizes.append(len(data)), tokens.append(total), unknown.append(missed)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(id_col), *(pa.array(x, pa.int64()) for x in (words, sizes, tokens, unknown))],
                    names=["doc_id", "n_words", "n_bytes", "n_tokens", "n_unknown"])

    return run


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", keep: int = 500_000) -> DataFrame:
    """Tokens of every whole text; one narrow pass. ``keep`` bounds the words remembered in a worker."""
    slim = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias(text_col))
    return slim.mapInArrow(_counts(vocabulary, id_col, text_col, keep), RESULT)
