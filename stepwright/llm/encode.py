"""Encoding of texts by a byte-level BPE vocabulary, without calling a tokenizer.

The encoding of a word ends in a token that depends only on the word's bytes up to there: of all
tokens that end at a position, exactly one forms a stable pair with the last token of the encoding
that ends where it begins.  So the state of a prefix is one number, its last token, and a trie of
distinct words is encoded depth first: each node's state is found once, from its ancestors' states,
however many words go through it.  The trie is walked as the sorted list of its words, of which
neighbours share their prefixes; a stack holds the states from the root to the current node.

Words are looked up per Python worker; texts are neither shuffled nor cut.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepwright.session import document_batches

DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# Fixed value: the public pattern that cuts text into words before byte-level merges.
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Entries of the word memo and of the pair memo of one worker; beyond it the memo starts anew.
MEMO_ENTRIES = 400_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to id, from a file of base64 token and id a line."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in Path(path).read_bytes().splitlines() if line)}


class TrieEncoder:
    """Encodes sets of words; states of shared prefixes are computed once a call."""

    def __init__(self, ranks: dict[bytes, int], memo_entries: int = MEMO_ENTRIES):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        # every ending of a token: walking back from a position can stop at the first slice not in it
        self.endings = {token[i:] for token in ranks for i in range(len(token))}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.words: dict[str, tuple[int, ...]] = {}
        self.memo_entries = memo_entries

    def merged(self, data: bytes) -> list[int]:
        """The plain merge procedure, for the short byte strings of one token or two."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = self.ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def stable(self, left: int, right: int) -> bool:
        """Whether two tokens stay apart when their bytes are merged; left -1: the token alone."""
        key = (left, right)
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= self.memo_entries:
                self.pairs.clear()
            if left < 0:
                known = self.merged(self.tokens[right]) == [right]
            else:
                known = self.merged(self.tokens[left] + self.tokens[right]) == [left, right]
            self.pairs[key] = known
        return known

    def last_token(self, word: bytes, end: int, states: list[int]) -> int:
        """The last token of the encoding of word[:end], by the states of the shorter prefixes."""
        found, start = [], end - 1
        while start >= 0 and (piece := word[start:end]) in self.endings:
            rank = self.ranks.get(piece)
            if rank is not None:
                found.append((start, rank))
            start -= 1
        for start, rank in reversed(found):
            if self.stable(states[start], rank):
                return rank
        raise ValueError("the vocabulary lacks single bytes")

    def encode_words(self, words: list[bytes]) -> dict[bytes, tuple[int, ...]]:
        """Encodings of distinct words, by one depth-first pass over their trie."""
        out, states, before = {}, [-1], b""
        for word in sorted(words):
            shared, most = 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del states[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                states.append(self.last_token(word, end, states))
            ids, end = [], len(word)
            while end:
                ids.append(states[end])
                end -= len(self.tokens[states[end]])
            out[word], before = tuple(reversed(ids)), word
        return out

    def encode_texts(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of each text; an empty or null text has none."""
        split = [_WORDS.findall(t) if t else [] for t in texts]
        new = {w for words in split for w in words if w not in self.words}
        if new:
            if len(self.words) + len(new) > self.memo_entries:
                self.words.clear()
                new = {w for words in split for w in words}
            by_bytes = {w.encode("utf-8", "replace"): w for w in new}
            self.words.update((by_bytes[b], ids) for b, ids in self.encode_words(list(by_bytes)).items())
        known = self.words
        return [[i for w in words for i in known[w]] for words in split]


_WORDS = regex.compile(WORD_PATTERN)


def encode(df: DataFrame, id_col: str, text_col: str, ranks_path: str = DEFAULT_RANKS) -> DataFrame:
    """(id, ids) of every row: no row is dropped or merged, null and empty texts get an empty list.

    The vocabulary goes to the executors as a broadcast of at most the file's size, which is checked.
    """
    spark = df.sparkSession
    document_batches(spark)
    if Path(ranks_path).stat().st_size > 64 * 2**20:
        raise ValueError("a vocabulary file above 64 MB isn't broadcast")
    ranks = spark.sparkContext.broadcast(read_ranks(ranks_path))
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = TrieEncoder(ranks.value)
        for batch in batches:
            ids = encoder.encode_texts(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[id_col, "ids"])

    return df.select(id_col, F.col(text_col).alias("_text")).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")
