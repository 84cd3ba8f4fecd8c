"""Token counts (10): trie-shared dynamic programming under a unigram model.

Distinct pre-tokens go into a trie. A node stands for a prefix and holds the best unigram
forward score of that prefix and the number of pieces that reach it, computed once for all
words that share the prefix; terminal nodes are remembered by word, so a repeated word costs
one lookup.

The model is a vocabulary file of the sentencepiece library (its path is a parameter). Such a
file orders its pieces; the log probability of the piece of order r is -ln(r + 2), Zipf's law.
A character that no piece covers costs one byte piece for each of its UTF-8 bytes. Of equal
scores the one of fewer pieces counts. Words are separated by white space as str.split() does
and begin with the file's word mark.

Each task builds its own trie, so nothing is shuffled. Once it has MAX_NODES nodes it starts anew, and
words of more than LONG_WORD characters, which hardly share a prefix, are scored beside it with the
same recurrence over the last few characters; neither changes a count, and both bound memory.

Defined results: null or blank text has no words and 0 tokens; repeated rows count each; very long
texts and words count whole; an empty table gives no rows; extra columns are ignored, whatever their
names.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from graphloom.llm.common import small_batches

MARK = "▁"
MAX_NODES = 1_200_000
LONG_WORD = 1024


@functools.lru_cache(maxsize=2)
def unigram_model(model_file: str | None = None) -> tuple[dict[str, float | None], float]:
    """Log probability of every piece, None for what is only the end of one; cost of a byte piece."""
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file or public_tokenizers.path("piece_bpe_32k.model"))
    kept = [i for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    order = sorted(kept, key=lambda i: (-sp.get_score(i), i))
    scores = {sp.id_to_piece(i): -math.log(r + 2) for r, i in enumerate(order)}
    tails: dict[str, float | None] = {piece[i:]: None for piece in scores for i in range(len(piece))}
    return tails | scores, -math.log(len(order) + 2) - 10.0


class PrefixTrie:
    """Forward scores by prefix. score[n], pieces[n]: of the prefix that node n stands for."""

    def __init__(self, model_file: str | None = None, max_nodes: int = MAX_NODES):
        self.tails, self.byte_score = unigram_model(model_file)
        self.max_nodes = max_nodes
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}
        self.score, self.pieces = [0.0], [0]
        self.terminal: dict[str, int] = {}

    def count(self, word: str) -> int:
        if len(word) > LONG_WORD:
            return self._alone(MARK + word)
        got = self.terminal.get(word)
        if got is None:
            node = self._insert(MARK + word)
            got = self.terminal[word] = self.pieces[node]
        return got

    def _insert(self, word: str) -> int:
        if len(self.score) > self.max_nodes:
            self.clear()
        child, score, pieces, tails = self.child, self.score, self.pieces, self.tails
        path, node = [0], 0
        for end, char in enumerate(word, 1):
            edge = node << 21 | ord(char)
            nxt = child.get(edge)
            if nxt is None:
                n_bytes = len(char.encode())
                best, count = score[node] + n_bytes * self.byte_score, pieces[node] + n_bytes
                for begin in range(end - 1, -1, -1):
                    piece = tails.get(word[begin:end], 1.0)
                    if piece == 1.0:  # no piece ends like this, so no longer one does
                        break
                    if piece is not None:
                        at = path[begin]
                        total = score[at] + piece
                        if total > best or total == best and pieces[at] + 1 < count:
                            best, count = total, pieces[at] + 1
                nxt = child[edge] = len(score)
                score.append(best)
                pieces.append(count)
            path.append(nxt)
            node = nxt
        return node


    def _alone(self, word: str) -> int:
        """Pieces of a word by the last forward scores only: no piece is longer than the longest one."""
        tails, keep = self.tails, max(map(len, self.tails))
        score, pieces = [0.0], [0]  # of the prefixes that end at the last `keep` places
        for end, char in enumerate(word, 1):
            n_bytes = len(char.encode())
            best, count = score[-1] + n_bytes * self.byte_score, pieces[-1] + n_bytes
            for back in range(1, min(end, keep) + 1):
                piece = tails.get(word[end - back : end], 1.0)
                if piece == 1.0:
                    break
                if piece is not None:
                    total = score[-back] + piece
                    if total > best or total == best and pieces[-back] + 1 < count:
                        best, count = total, pieces[-back] + 1
            score.append(best)
            pieces.append(count)
            if len(score) > 4 * keep:
                del score[:-keep], pieces[:-keep]
        return pieces[-1]


def count_tokens(docs: DataFrame, model_file: str | None = None) -> DataFrame:
    """doc_id, n_words, n_tokens of every whole text."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trie = PrefixTrie(model_file)
        for b in batches:
            words = [(t or "").split() for t in b["text"]]
            for w in set().union(*words) if words else ():
                trie.count(w)
            counts = [sum(map(trie.count, w)) for w in words]
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "n_words": np.array([len(w) for w in words], dtype="int64"), "n_tokens": np.array(counts, dtype="int64")})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, n_words long, n_tokens long")
