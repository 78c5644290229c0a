"""Greedy word-piece lengths by a linear longest-match automaton.

The vocabulary becomes a trie. A node's failure link leads to the node that is
left after the longest pieces have been cut from its string, and its pop count
says how many pieces that cuts. A word is read once, character by character; on
a missing edge the pops are added and the link is followed. No piece is built.

A word is a maximal run without white space; its pieces are counted for the
string mark + word, as the vocabulary marks word starts. A character that is in
no piece counts one token per UTF-8 byte, as byte fallback does.

Defined cases: null, empty and blank texts have 0 words and 0 tokens; repeated
rows are counted each; very long words are read in the same single pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from folioscript.llm.common import ship, table, travels, unship

travels(__name__)
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
MEMO = 400_000  # words remembered per task


def read_pieces(path: str = VOCABULARY) -> list[str]:
    """The ordinary pieces of a SentencePiece model (no control, unknown or byte pieces)."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [sp.id_to_piece(i) for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]


def spelled(ch: str) -> int:
    """Tokens of a character that no piece covers: one for each UTF-8 byte."""
    return len(ch.encode("utf-8", "surrogatepass"))


class Automaton:
    """``next[node]`` maps characters to nodes; ``link`` and ``pops`` as described above; node 0 is the root."""

    def __init__(self, pieces: list[str]):
        self.next: list[dict[str, int]] = [{}]
        ends = [False]
        for piece in pieces:
            node = 0
            for ch in piece:
                if ch not in self.next[node]:
                    self.next[node][ch] = len(self.next)
                    self.next.append({})
                    ends.append(False)
                node = self.next[node][ch]
            ends[node] = node > 0
        self.link, self.pops = [0] * len(ends), [0] * len(ends)
        level = [0]
        while level:  # by depth, so that the links of shorter strings are known
            after = []
            for node in level:
                for ch, child in self.next[node].items():
                    after.append(child)
                    if ends[child]:
                        self.pops[child] = 1
                    else:
                        popped, at = (0, node) if node == 0 else (self.pops[node], self.link[node])
                        more, self.link[child] = (spelled(ch), 0) if node == 0 else self.step(at, ch)
                        self.pops[child] = popped + more
            level = after

    def step(self, node: int, ch: str) -> tuple[int, int]:
        """Pieces popped and the node reached when ``ch`` is read at ``node``."""
        popped = 0
        while ch not in self.next[node]:
            if node == 0:
                return popped + spelled(ch), 0
            popped, node = popped + self.pops[node], self.link[node]
        return popped, self.next[node][ch]

    def count(self, word: str) -> int:
        """Pieces of the greedy longest-match segmentation of ``word``."""
        total = node = 0
        for ch in word:
            child = self.next[node].get(ch)
            if child is None:
                popped, child = self.step(node, ch)
                total += popped
            node = child
        while node:
            total, node = total + self.pops[node], self.link[node]
        return total


class Counts(dict):
    """Token count per word, found once."""

    def __init__(self, automaton: Automaton, mark: str):
        super().__init__()
        self.automaton, self.mark = automaton, mark

    def __missing__(self, word: str) -> int:
        n = self.automaton.count(self.mark + word)
        if len(word) <= 64:
            if len(self) >= MEMO:
                self.clear()
            self[word] = n
        return n


def count_tokens(docs: DataFrame, pieces: list[str], key: str = "doc_id", text: str = "text", mark: str = MARK) -> DataFrame:
    """(key, n_words, n_tokens) per row of ``docs``. The vocabulary travels once per job as a broadcast."""
    shared = ship(docs.sparkSession, Automaton(pieces))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(unship(shared), mark)
        for b in batches:
            words, tokens = [], []
            for t in b.column(1).to_pylist():
                parts = (t or "").split()
                words.append(len(parts))
                tokens.append(sum(map(counts.__getitem__, parts)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(words, np.int64)), pa.array(np.array(tokens, np.int64))], [key, "n_words", "n_tokens"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_words bigint, n_tokens bigint")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), read_pieces())
