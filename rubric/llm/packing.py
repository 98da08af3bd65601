"""Packing: all documents in one stream of ids, cut into fixed windows.

Pass 1 (Python, Arrow batches): each task encodes its documents and keeps a
running total, so every document knows its start inside its partition.  Ids
go to a table in the shared folder; a later loss of executors re-reads them.

Pass 2 (built-in functions): one total per partition, a prefix sum over
those totals, and so a global start for every document.  Windows of
``seq_len`` ids are cut by arithmetic; a document that crosses window ends
has one boundary record (piece) in each window it touches.  No ids move.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .rows import project, python_ready, written

SEQ_LEN = 2048
END_ID = 1
#: Pre-tokens whose ids a worker remembers, in one of two generations.
MEMO = 400_000

ENCODED = "part int, doc_id long, before long, n_ids long, ids binary"


#: Fixed value: the pattern by which the vocabulary's file splits lower-cased text; what it doesn't match is dropped.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"""
#: Texts of the Latin blocks and ASCII whitespace: composed already, and with one rule for lower case.
PLAIN = "[\t-\r !-~\xa1-\u024f]*"
#: ``PATTERN`` for those, lower-cased; some lower-case letters are in the blocks behind.
LETTERS, DIGITS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u02af\u2c65\u2c66", "0-9\xb2\xb3\xb9\xbc-\xbe"
PRE_TOKEN = f"[{LETTERS}]+|'(?:s|t|re|ve|m|ll|d)|[{DIGITS}]|[^\\s{LETTERS}{DIGITS}]+"
#: Longest chunk or pre-token that is remembered.
LONGEST = 64
#: Documents encoded at a time.
ROWS = 256


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself if
    it prints in Latin-1, else the next letter from 256 on."""
    prints = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    others = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(256 + i) for i, b in enumerate(others)}


class Memo(dict):
    """Remembers what ``make`` returns for up to two generations of ``size``
    keys.  Keys longer than ``longest`` are made anew each time, so the bytes
    held are bounded too."""

    def __init__(self, make, size: int, longest: int | None = None):
        super().__init__()
        self.make, self.size, self.old, self.longest = make, size, {}, longest

    def __missing__(self, key):
        if self.longest is not None and len(key) > self.longest:
            return self.make(key)
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value

    def forget(self) -> None:
        """Drops both generations."""
        self.old = {}
        self.clear()


@functools.lru_cache(maxsize=2)
def chunk_encoder(path: str, memo: int = MEMO):
    """A function of a text, or a chunk of one, in UTF-8 that returns its ids, four bytes each.

    The vocabulary drops whitespace and no rule looks across it, so a text's
    ids are those of its pre-tokens, one after the other.  These are encoded
    one by one and remembered.  A text with characters beyond the Latin blocks
    or with special strings is taken chunk by chunk (between ASCII whitespace),
    and its chunks with any go through the library's whole pipeline.  A worker
    process has one function for all its tasks; ``forget`` frees what it
    remembers when a task ends, as the process goes on to other stages' tasks.
    """
    import re
    from struct import pack

    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    latin, split, tokenize = re.compile(PLAIN).fullmatch, re.compile(PRE_TOKEN).findall, tokenizer.model.tokenize
    letter, special = byte_letters(), [t.content for t in tokenizer.get_added_tokens_decoder().values()]

    def as_bytes(ids: list[int]) -> bytes:
        return pack(f"<{len(ids)}I", *ids)

    def pre_token(word: str) -> bytes:
        spelled = word if word.isascii() else "".join(letter[b] for b in word.encode())
        return as_bytes([t.id for t in tokenize(spelled)])

    def whole(chunk: str) -> bytes:
        return as_bytes(tokenizer.encode(chunk, add_special_tokens=False).ids)

    pre_tokens, others = Memo(pre_token, memo, LONGEST), Memo(whole, memo // 4, LONGEST)

    def plain(text: str) -> bool:
        return latin(text) is not None and not any(s in text for s in special)

    def of_plain(text: str) -> bytes:
        return b"".join(map(pre_tokens.__getitem__, split(text.lower())))

    def encode(data: bytes) -> bytes:
        text = data.decode()
        if plain(text):
            return of_plain(text)
        return b"".join([of_plain(c) if plain(c) else others[c] for c in map(bytes.decode, data.split())])

    def forget() -> None:
        pre_tokens.forget()
        others.forget()

    encode.forget = forget
    return encode


def encoder(path: str, end_id: int = END_ID, memo: int = MEMO):
    """A function of an iterator of Arrow batches (doc_id, text) that yields
    ``ENCODED`` batches."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk_ids = chunk_encoder(path, memo)
        end = end_id.to_bytes(4, "little")
        part, total = TaskContext.get().partitionId(), 0
        try:
            for whole in batches:
                for batch in (whole.slice(i, ROWS) for i in range(0, whole.num_rows, ROWS)):
                    ids = [chunk_ids(text.as_py()) + end for text in batch.column(1).cast(pa.binary())]
                    n_ids = [len(x) // 4 for x in ids]
                    before = list(itertools.accumulate(n_ids, initial=total))
                    total = before.pop()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([part] * len(ids), pa.int32()), batch.column(0), pa.array(before, pa.int64()),
                         pa.array(n_ids, pa.int64()), pa.array(ids, pa.binary())],
                        ["part", "doc_id", "before", "n_ids", "ids"])
        finally:
            chunk_ids.forget()

    return encode


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                     end_id: int = END_ID) -> DataFrame:
    """Pass 1, as a written table: ``ENCODED`` rows, one per document."""
    python_ready(docs.sparkSession)
    return written(project(docs, id_col, text_col).mapInArrow(encoder(path, end_id), ENCODED), "packing-ids")


def cut(encoded: DataFrame, seq_len: int = SEQ_LEN) -> DataFrame:
    """Pass 2: the pieces of ``encoded`` (ENCODED rows).

    The totals are one row for each partition of pass 1 (16 bytes for each
    input split), summed up in order of the partition's number.
    """
    totals = encoded.groupBy("part").agg(F.sum("n_ids").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    at = encoded.join(F.broadcast(offsets), "part").select(
        "doc_id", "n_ids", "ids", (F.col("offset") + F.col("before")).alias("at"))
    size = F.lit(seq_len).cast("long")
    windows = F.sequence(F.expr(f"at div {seq_len}"), F.expr(f"(at + n_ids - 1) div {seq_len}"))

    def piece(k):
        first = F.greatest(k * size, F.col("at"))
        length = F.least((k + 1) * size, F.col("at") + F.col("n_ids")) - first
        start = first - F.col("at")
        part = F.substring(F.col("ids"), (start * 4 + 1).cast("int"), (length * 4).cast("int"))
        return F.struct(start.alias("start"), length.alias("length"), F.crc32(part).alias("ids_crc32"),
                        k.alias("sequence_id"), (first - k * size).alias("offset"))

    return (at.select("doc_id", F.col("n_ids").alias("doc_tokens"), F.explode(F.transform(windows, piece)).alias("p"))
            .select("doc_id", "p.start", "p.length", "p.ids_crc32", "doc_tokens", "p.sequence_id", "p.offset"))


def pack(docs: DataFrame, path: str, seq_len: int = SEQ_LEN, end_id: int = END_ID,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32,
    doc_tokens, sequence_id, offset.

    ``path``: a tokenizer file whose pre-tokenizer drops whitespace.  A null
    or empty text is the end id alone.  Every window but the last is full.
    Rows that repeat an id are documents of their own.  A document's ids
    must fit in one binary value (2 GB, 500 million ids).
    """
    return cut(encode_documents(docs, path, id_col, text_col, end_id), seq_len)
