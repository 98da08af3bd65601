"""Block dictionaries: token columns coded where they are.

A task codes its rows in blocks: the block's distinct tokens, and for every
occurrence its token's place among them.  Only (block, distinct token) pairs
meet a vocabulary, a block's ids come back packed, and codes become ids
inside the block.  So occurrences move once, as compressed codes, and no
text's tokens are gathered from several tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from ..session import scratch_path, set_conf, ship_package
from .skew import content, key_counts, salted_join

#: Tokens of a block, or those of one row; and its rows.
TOKENS, ROWS = 1 << 23, 1 << 16
#: Tokens coded, and ids handed on, at a time, or those of one row.
PART = 1 << 20
#: (Block, token) pairs packed at a time.
PAIRS = 1 << 20
#: Rows of long token lists that go to Python at a time.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "256"}
#: Tables of codes and counts are read once or twice.
PACKED = {"compression": "zstd"}
BLOCK, LENGTHS, CODES, DICTIONARY, COUNTS = "_block", "_lengths", "_codes", "_dictionary", "_counts"
OWN = (BLOCK, LENGTHS, CODES, DICTIONARY, COUNTS)
ZSTD = pa.Codec("zstd", compression_level=3)
CODED = f"{BLOCK} long, {LENGTHS} array<int>, {CODES} binary, {DICTIONARY} array<string>, {COUNTS} array<long>"


def slices(lengths: np.ndarray, tokens: int, rows: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``tokens`` tokens (or one row) and ``rows`` rows."""
    ends, first = np.cumsum(lengths), 0
    while first < len(lengths):
        before = ends[first - 1] if first else 0
        end = min(max(int(np.searchsorted(ends, before + tokens, "right")), first + 1), first + rows)
        yield first, end
        first = end


def coder(carry: list[str], size: int = TOKENS, rows: int = ROWS):
    """A function of Arrow batches (tokens, carried columns) that yields ``CODED`` rows with the carried columns as arrays."""

    def part(held: list[pa.RecordBatch]) -> tuple[pa.DictionaryArray, pa.Table]:
        """The rows' codes with their own dictionary, and the rest of the rows; the texts of tokens go."""
        table = pa.Table.from_batches(held).combine_chunks()
        lists = table.column(0).combine_chunks()
        lengths = pc.fill_null(pc.list_value_length(lists), 0).cast(pa.int32())
        return pc.dictionary_encode(lists.flatten().cast(pa.string())), table.select(carry).append_column(LENGTHS, lengths)

    def block(number: int, parts: list[tuple[pa.DictionaryArray, pa.Table]]) -> pa.RecordBatch:
        coded = pa.chunked_array([c for c, _ in parts]).unify_dictionaries()
        tokens = coded.chunk(0).dictionary
        codes = np.concatenate([pc.fill_null(c.indices, -1).to_numpy(zero_copy_only=False).astype("<i4", copy=False) for c in coded.chunks])
        counts = np.bincount(codes[codes >= 0], minlength=len(tokens))
        table = pa.concat_tables([t for _, t in parts]).combine_chunks()

        def one(values: pa.Array) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

        return pa.RecordBatch.from_arrays(
            [pa.array([number], pa.int64()), one(table.column(LENGTHS).combine_chunks()), pa.array([packed(codes)], pa.binary()),
             one(tokens), one(pa.array(counts, pa.int64())), *(one(table.column(c).combine_chunks()) for c in carry)],
            [BLOCK, LENGTHS, CODES, DICTIONARY, COUNTS, *carry])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, parts, held, in_part, n_tokens, n_rows = TaskContext.get().partitionId() << 32, [], [], 0, 0, 0
        for batch in batches:
            lengths = pc.fill_null(pc.list_value_length(batch.column(0)), 0).to_numpy(zero_copy_only=False)
            for first, end in slices(lengths, min(size, PART), rows):
                n = int(lengths[first:end].sum())
                full = n_rows and (n_tokens + n > size or n_rows + end - first > rows)
                if held and (full or in_part + n > PART):
                    parts.append(part(held))
                    held, in_part = [], 0
                if full:
                    yield block(number, parts)
                    number, parts, n_tokens, n_rows = number + 1, [], 0, 0
                held.append(batch.slice(first, end - first))
                in_part, n_tokens, n_rows = in_part + n, n_tokens + n, n_rows + end - first
        if held:
            yield block(number, [*parts, part(held)])

    return run


def packed(values: np.ndarray) -> bytes:
    return ZSTD.compress(np.ascontiguousarray(values), asbytes=True)


def unpacked(text: bytes, n: int, kind: str) -> np.ndarray:
    return np.frombuffer(ZSTD.decompress(text, decompressed_size=n * np.dtype(kind).itemsize), kind)


def code_blocks(rows: DataFrame, tokens: str = "tokens", carry: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` as coded blocks, a written table: the pieces of work that
    follow read it, and a lost executor costs a re-read.  A NULL list counts
    as empty, a NULL token has the code -1."""
    spark = rows.sparkSession
    ship_package(spark)
    table = rows.select(F.col(tokens).cast("array<string>").alias(tokens), *carry)
    schema = StructType([*_ddl(CODED), *(StructField(c, ArrayType(table.schema[c].dataType)) for c in carry)])
    path = scratch_path(spark, "blocks")
    with set_conf(spark, BATCH):
        table.mapInArrow(coder(list(carry)), schema).write.options(**PACKED).parquet(path)
    return spark.read.schema(schema).parquet(path)


def _ddl(text: str) -> list[StructField]:
    return StructType.fromDDL(text).fields


def token_counts(blocks: DataFrame) -> DataFrame:
    """(token, count) over all rows: each block adds its own counts, so a frequent token is one row a block."""
    pairs = blocks.select(F.explode(F.arrays_zip(DICTIONARY, COUNTS)).alias("p"))
    return pairs.select(F.col("p")[DICTIONARY].alias("token"), F.col("p")[COUNTS].alias("n")).groupBy("token").agg(F.sum("n").alias("count"))


def block_ids(blocks: DataFrame, vocab: DataFrame, unk_id: int) -> DataFrame:
    """(block, places and ids): the ids of each block's distinct tokens and
    their places, packed by the tasks that looked them up.  A token in most
    blocks is a hot key; its rows are dealt to several tasks."""
    entries = blocks.select(BLOCK, F.posexplode(DICTIONARY).alias("place", "token"))
    counts = vocab.select("token", F.col("count").alias("n")) if "count" in vocab.columns else key_counts(entries, "token")
    found = salted_join(entries, vocab.select("token", "id"), "token", counts=counts, how="left", salt=content(BLOCK))
    ids = F.coalesce(F.col("id").cast("long"), F.lit(unk_id).cast("long")).alias("id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= PAIRS:
                yield from packs(held)
                held, n = [], 0
        if held:
            yield from packs(held)

    return found.select(BLOCK, "place", ids).mapInArrow(run, f"{BLOCK} long, pack struct<n: int, places: binary, ids: binary>") \
        .groupBy(BLOCK).agg(F.collect_list("pack").alias("packs"))


def packs(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each block of the pairs: places in order, as differences, and their ids."""
    block, place, token = (pa.chunked_array([b.column(i) for b in held]).to_numpy() for i in range(3))
    order = np.lexsort((place, block))
    block, place, token = block[order], place[order].astype("<i4"), token[order].astype("<i8")
    ends = np.append(np.flatnonzero(np.diff(block)) + 1, len(block)) if len(block) else []
    first = 0
    for end in ends:
        pack = {"n": int(end - first), "places": packed(np.diff(place[first:end], prepend=np.int32(0))), "ids": packed(token[first:end])}
        yield pa.RecordBatch.from_arrays([pa.array([block[first]], pa.int64()), pa.array([pack], pa.struct(
            [("n", pa.int32()), ("places", pa.binary()), ("ids", pa.binary())]))], [BLOCK, "pack"])
        first = end


def ids_of(found: list[dict] | None, unk_id: int) -> np.ndarray:
    """The ids of a block's dictionary in its order, and last that of an unknown token."""
    known = np.full(sum(p["n"] for p in found or []) + 1, unk_id, np.int64)
    for p in found or []:
        known[np.cumsum(unpacked(p["places"], p["n"], "<i4"))] = unpacked(p["ids"], p["n"], "<i8")
    return known


def decode_blocks(blocks: DataFrame, ids: DataFrame, carry: tuple[str, ...], unk_id: int) -> DataFrame:
    """The rows of ``blocks`` again: the carried columns and ``input_ids``."""
    kept = blocks.select(BLOCK, LENGTHS, CODES, *carry).join(ids, BLOCK, "left")
    schema = StructType([*(StructField(c, blocks.schema[c].dataType.elementType) for c in carry), *_ddl("input_ids array<long>")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: c[i] for n, c in zip(batch.schema.names, batch.columns)}
                known = ids_of(row["packs"].as_py(), unk_id)
                lengths = row[LENGTHS].values.to_numpy()
                ends = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
                codes = unpacked(row[CODES].as_py(), int(ends[-1]), "<i4")
                carried = [row[c].values for c in carry]
                # A block's ids are eight bytes a token: they go on in parts.
                for first, end in slices(lengths, PART, ROWS):
                    values = known[codes[ends[first]:ends[end]]]  # -1 is the last: an unknown token
                    part = pa.ListArray.from_arrays(pa.array(ends[first:end + 1] - ends[first], pa.int32()), pa.array(values))
                    yield pa.RecordBatch.from_arrays([*(c.slice(first, end - first) for c in carried), part], [*carry, "input_ids"])

    return kept.mapInArrow(run, schema)
