"""Token counts from the pieces of distinct pre-tokens.

A pre-token's pieces don't depend on its neighbours.  So each batch of
documents is split into pre-tokens, the distinct ones are looked up (each
counted once and remembered), and a document's count is the sum over its
pre-token frequencies.  No ids are made for a document.

The join of frequencies and counts stays inside the batch: over the whole
table it would move every (document, pre-token) pair, more bytes than the
texts themselves, to save the second counting of a pre-token that two tasks
share.  So the operator has no shuffle at all.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import project, python_ready

LIMIT = 1024
#: Pre-tokens whose counts a worker remembers (two generations of this size).
MEMO = 300_000
#: Bytes of text split at a time.
BLOCK = 2 << 20
#: Fixed value: the pattern by which byte-level vocabularies of this kind split texts.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Code points of the Latin blocks and general punctuation, whose classes no Unicode version has changed; texts
#: with others are encoded whole by the library itself.
PLAIN = "[\x00-ɏ‐-‧]*"


class PieceCounts(dict):
    """Pre-token -> number of its pieces."""

    def __init__(self, tokenizer, size: int = MEMO):
        super().__init__()
        self.tokenizer, self.size, self.old = tokenizer, size, {}

    def learn(self, pre_tokens: set[str]) -> None:
        """Counts of all ``pre_tokens`` are at hand afterwards."""
        if len(self) + len(pre_tokens) > self.size:
            self.old = dict(self)
            self.clear()
        new = []
        for x in pre_tokens - self.keys():
            if (n := self.old.get(x)) is None:
                new.append(x)
            else:
                self[x] = n
        for i in range(0, len(new), 1000):
            some = new[i:i + 1000]
            for x, e in zip(some, self.tokenizer.encode_batch(some, add_special_tokens=False)):
                self[x] = len(e.ids)


def blocks(n_bytes: list[int], size: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of rows, each of ``size`` bytes of text or a single row or less."""
    first, held = 0, 0
    for i, n in enumerate(n_bytes):
        if held and held + n > size:
            yield first, i
            first, held = i, 0
        held += n
    if first < len(n_bytes):
        yield first, len(n_bytes)


@functools.lru_cache(maxsize=2)
def loaded(path: str, memo: int):
    """(tokenizer, its special strings, counts): one for each worker process, so what it remembers serves all its tasks."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer, [t.content for t in tokenizer.get_added_tokens_decoder().values()], PieceCounts(tokenizer, memo)


def counter(path: str, memo: int = MEMO):
    """A function of Arrow batches (doc_id, text) that yields (doc_id, n_bytes, n_tokens)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        split, plain = regex.compile(PATTERN).findall, regex.compile(PLAIN).fullmatch
        tokenizer, special, counts = loaded(path, memo)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            n_bytes = [len(t.encode()) for t in texts]
            n_tokens = np.zeros(len(texts), np.int64)
            for first, end in blocks(n_bytes):
                parts: dict[int, list[str]] = {}
                for i in range(first, end):
                    text = texts[i]
                    if plain(text) and not any(s in text for s in special):
                        parts[i] = split(text)
                    else:
                        n_tokens[i] = len(tokenizer.encode(text, add_special_tokens=False).ids)
                # The frequencies of a block's pre-tokens, document by document, meet the counts of its distinct ones.
                counts.learn(set().union(*parts.values()))
                for i, pre_tokens in parts.items():
                    n_tokens[i] = sum(map(counts.__getitem__, pre_tokens))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens)],
                                             ["doc_id", "n_bytes", "n_tokens"])

    return count


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_tokens, over_limit.

    The counts are those of the tokenizers library for the byte-level file
    at ``path``; special strings inside texts count as it counts them by
    default.  A null text counts as empty: no bytes, no tokens.
    """
    python_ready(docs.sparkSession)
    rows = project(docs, id_col, text_col)
    out = rows.mapInArrow(counter(path), "doc_id long, n_bytes long, n_tokens long")
    return out.select("*", (F.col("n_tokens") > F.lit(limit)).alias("over_limit"))
