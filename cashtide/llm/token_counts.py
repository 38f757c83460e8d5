"""Token counts by a linear longest-match automaton.

Greedy word-piece splitting takes the longest piece at every place.  A trie of the
pieces, with a failure link and a number at every node, counts the pieces in one pass over
the letters: when no child fits the next letter, the failure link leads to the node of the
letters that remain once the pieces that are certain by then have been popped, and the
number says how many those were.  No piece is built and no letter is read twice.

A word is a run between white space with the word mark in front.  A letter that no piece
starts with counts as many tokens as it has bytes in UTF-8 (byte fallback).

Null and empty texts count nothing; repeated rows are counted each; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from cashtide.llm.common import id_and_text

MARK = "▁"
#: Words whose counts a task remembers at a time; beyond it, it starts anew.
REMEMBERED = 400_000


class LongestMatch:
    """Counts greedy longest-match pieces of words."""

    def __init__(self, pieces: Iterable[str]):
        self.child: list[dict[str, int]] = [{}]
        self.fail: list[int] = [-1]
        self.popped: list[int] = [0]
        ends = [False]
        for piece in pieces:
            node = 0
            for letter in piece:
                nxt = self.child[node].get(letter)
                if nxt is None:
                    nxt = self.child[node][letter] = len(self.child)
                    self.child.append({})
                    self.fail.append(-1)
                    self.popped.append(0)
                    ends.append(False)
                node = nxt
            if node:
                ends[node] = True
        self._link(ends)

    def _link(self, ends: list[bool]) -> None:
        """Breadth first: links of shorter nodes are known when longer ones need them."""
        queue = deque((0, letter, node) for letter, node in self.child[0].items())
        while queue:
            parent, letter, node = queue.popleft()
            if ends[node]:
                self.fail[node], self.popped[node] = 0, 1
            elif parent == 0:
                # A letter that is no piece itself, though pieces start with it.
                self.fail[node], self.popped[node] = 0, len(letter.encode())
            else:
                at, count = self.fail[parent], self.popped[parent]
                while at != -1 and letter not in self.child[at]:
                    if at == 0:
                        at, count = -2, count + len(letter.encode())
                        break
                    count += self.popped[at]
                    at = self.fail[at]
                self.fail[node] = 0 if at == -2 else self.child[at][letter]
                self.popped[node] = count
            queue.extend((node, x, y) for x, y in self.child[node].items())

    def count(self, word: str) -> int:
        child, fail, popped = self.child, self.fail, self.popped
        node = total = 0
        for letter in word:
            nxt = child[node].get(letter)
            while nxt is None and node:
                total += popped[node]
                node = fail[node]
                nxt = child[node].get(letter)
            if nxt is None:
                total += len(letter.encode())
            else:
                node = nxt
        while node:
            total += popped[node]
            node = fail[node]
        return total


def piece_vocabulary(model_file: str) -> list[str]:
    """The ordinary pieces of a SentencePiece model."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    return [
        model.id_to_piece(i)
        for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
    ]


def token_counts(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_words`` and ``n_tokens`` of every row.

    ``model_file`` is read where the tasks run.  No shuffle: one pass over the texts, with
    the counts of recent words kept at hand.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = LongestMatch(piece_vocabulary(model_file))
        known: dict[str, int] = {}
        for batch in batches:
            words, tokens = [], []
            for text in batch.column(1).to_pylist():
                parts = text.split()
                total = 0
                for part in parts:
                    n = known.get(part)
                    if n is None:
                        if len(known) >= REMEMBERED:
                            known.clear()
                        n = machine.count(MARK + part)
                        if len(part) <= 64:
                            known[part] = n
                    total += n
                words.append(len(parts))
                tokens.append(total)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())],
                ["doc_id", "n_words", "n_tokens"],
            )

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id bigint, n_words bigint, n_tokens bigint")
