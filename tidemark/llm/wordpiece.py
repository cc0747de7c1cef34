"""Token counts by a linear longest-match automaton.

The vocabulary is a trie. A state's failure link leads to the state that is left after the longest match is taken off
its string, and the number of tokens taken off on the way is precomputed, so that a word's greedy pieces are counted by
one walk over its bytes without building a piece.
"""

from __future__ import annotations

import base64
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import memory, texts, with_columns

#: Words whose counts a Python worker remembers; a bound on memory only.
REMEMBERED = 300_000


class Automaton:
    """Counts greedy longest-match pieces of byte strings over a vocabulary of non-empty byte strings."""

    def __init__(self, vocabulary: Iterable[bytes]):
        child: list[dict[int, int]] = [{}]
        final = [False]
        for token in vocabulary:
            at = 0
            for b in token:
                if b not in child[at]:
                    child[at][b] = len(child)
                    child.append({})
                    final.append(False)
                at = child[at][b]
            final[at] = at > 0
        n = len(child)
        #: fail -1: no way on; the string has no pieces
        self.fail, self.popped = np.full(n, -1, dtype=np.int32), np.zeros(n, dtype=np.int32)
        queue = deque([0])
        while queue:
            u = queue.popleft()
            for b, v in child[u].items():
                queue.append(v)
                if final[v]:
                    self.fail[v], self.popped[v] = 0, 1
                    continue
                z, count = int(self.fail[u]), int(self.popped[u])
                while z >= 0 and b not in child[z]:
                    count += int(self.popped[z])
                    z = int(self.fail[z])
                if z >= 0:
                    self.fail[v], self.popped[v] = child[z][b], count
        edges = sorted((u << 8 | b, v) for u, c in enumerate(child) for b, v in c.items())
        self.edge = np.array([e for e, _ in edges], dtype=np.int64)
        self.to = np.array([v for _, v in edges], dtype=np.int32)

    def step(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The next states, -1 where the trie has no edge."""
        key = state.astype(np.int64) << 8 | byte
        i = np.minimum(np.searchsorted(self.edge, key), len(self.edge) - 1) if len(self.edge) else np.zeros(len(key), dtype=np.int64)
        return np.where(self.edge[i] == key, self.to[i], -1) if len(self.edge) else np.full(len(key), -1)

    def counts(self, words: list[bytes]) -> np.ndarray:
        """Pieces of each word; a word that the vocabulary can't spell counts as one unknown token, an empty one as none.

        All words advance together, byte by byte, the longest first.
        """
        size = np.array([len(w) for w in words], dtype=np.int64)
        total = np.zeros(len(words), dtype=np.int64)
        if not size.sum():
            return total
        order = np.argsort(-size, kind="stable")
        flat = np.frombuffer(b"".join(words), dtype=np.uint8)
        start = (np.cumsum(size) - size)[order]
        count, state, bad = np.zeros(len(words), dtype=np.int64), np.zeros(len(words), dtype=np.int32), np.zeros(len(words), dtype=bool)
        live = int(np.count_nonzero(size))
        lengths = size[order]
        for i in range(int(size.max())):
            while live and lengths[live - 1] <= i:
                live -= 1
            todo = np.flatnonzero(~bad[:live])
            byte = flat[start[todo] + i]
            while len(todo):
                new = self.step(state[todo], byte)
                done = new >= 0
                state[todo[done]] = new[done]
                todo, byte = todo[~done], byte[~done]
                count[todo] += self.popped[state[todo]]
                state[todo] = self.fail[state[todo]]
                lost = state[todo] < 0
                bad[todo[lost]] = True
                todo, byte = todo[~lost], byte[~lost]
        #: what is left of each word is popped until nothing is
        todo = np.flatnonzero(~bad & (state > 0))
        while len(todo):
            count[todo] += self.popped[state[todo]]
            state[todo] = self.fail[state[todo]]
            bad[todo[state[todo] < 0]] = True
            todo = todo[state[todo] > 0]
        count[bad] = 1
        total[order] = count
        return total


def read_vocabulary(path: str) -> list[bytes]:
    with open(path, "rb") as f:
        return [base64.b64decode(line.split()[0]) for line in f]


_automata: dict[int, Automaton] = {}


def count_pieces(docs: DataFrame, vocabulary: list[bytes], text: str = "text", marker: bytes = b" ") -> DataFrame:
    """docs with n_words and n_tokens (long): words between ASCII white space, and greedy pieces of marker+word.

    Null and empty texts have no words. Texts are whole, of any length; repeated rows count alike; columns of these
    names are replaced; an empty table gives no rows. The vocabulary is broadcast, its size is the tokenizer's.
    """
    shared, key = docs.sparkSession.sparkContext.broadcast(vocabulary), hash((frozenset(vocabulary), marker))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for batch in batches:
            if key not in _automata:
                _automata.clear()
                _automata[key] = Automaton(shared.value)
            known = memory(("pieces", key), REMEMBERED)
            column = texts(batch, text)
            new: set[bytes] = set()
            for t in column:
                new.update(t.split())
            todo = list(new.difference(known))
            known.update(zip(todo, _automata[key].counts([marker + w for w in todo]).tolist()))
            words, tokens = [], []
            for t in column:
                ws = t.split()
                words.append(len(ws))
                tokens.append(sum(map(known.__getitem__, ws)))
            yield [pa.array(words, pa.int64()), pa.array(tokens, pa.int64())]

    return with_columns(docs, text, [T.StructField("n_words", T.LongType(), True), T.StructField("n_tokens", T.LongType(), True)], fill)
