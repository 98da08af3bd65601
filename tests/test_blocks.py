"""Block dictionaries: coding and decoding token columns (Q2)."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tables_at import SF_SMALL

from rubric.operators import blocks, sequences
from rubric.plans import catalog

SCHEMA = "sample_id long, split string, tokens array<string>"


@pytest.fixture()
def small_blocks(monkeypatch):
    """Blocks of some tokens (the size goes to the workers with the coder)."""
    made = blocks.coder
    monkeypatch.setattr(blocks, "coder", lambda carry: made(carry, 50, 7))


def rows(n=120):
    rng = random.Random(5)
    out = [(i, rng.choice(["train", "val"]), [f"t{min(rng.randrange(60), rng.randrange(60))}" for _ in range(rng.choice([0, 1, 5, 90]))])
           for i in range(n)]
    return [*out, (1, "train", ["again"]), (500, None, None), (501, "val", ["a", None, "t1"]), (502, "val", [""])]


def test_ids_come_back_in_their_places(spark, small_blocks):
    some = rows()
    df = spark.createDataFrame(some, SCHEMA).repartition(3)
    vocab = spark.createDataFrame([(f"t{i}", 10 + i) for i in range(0, 60, 2)], "token string, id long")
    coded = sequences.code_tokens(df, carry=("split",))
    assert coded.count() > 20
    got = sorted(((r.sample_id, r.split, r.input_ids) for r in sequences.encode_blocks(coded, vocab).collect()), key=str)
    ids = {f"t{i}": 10 + i for i in range(0, 60, 2)}
    assert got == sorted(((k, s, [ids.get(t, 1) for t in ts or []]) for k, s, ts in some), key=str)


def test_vocabulary_of_blocks_is_that_of_tokens(spark, small_blocks):
    df = spark.createDataFrame(rows(), SCHEMA).repartition(4)
    direct = sorted(map(tuple, sequences.build_vocabulary(df.where("sample_id <> 501")).collect()))
    coded = sequences.code_tokens(df.where("sample_id <> 501"))
    assert sorted(map(tuple, sequences.build_vocabulary_of(coded).select("token", "count", "id").collect())) == direct


def test_empty_table(spark):
    coded = sequences.code_tokens(spark.createDataFrame([], SCHEMA))
    assert sequences.build_vocabulary_of(coded).collect() == []
    assert sequences.encode_blocks(coded, spark.createDataFrame([("a", 2)], "token string, id long")).collect() == []


def test_slices_cover_rows():
    lengths = np.array([0, 3, 200, 1, 1, 0, 49, 50, 51, 0])
    found = list(blocks.slices(lengths, 50, 3))
    assert [i for a, b in found for i in range(a, b)] == list(range(len(lengths)))
    assert all(lengths[a:b].sum() <= 50 or b == a + 1 for a, b in found) and all(b - a <= 3 for a, b in found)


def test_occurrences_are_not_shuffled_as_rows(spark):
    """No aggregate gathers a text's tokens, and the only explode is of dictionaries."""
    t = catalog._tokens(spark, SF_SMALL)
    coded = sequences.code_tokens(t)
    n_tokens = t.select(F.sum(F.size("tokens"))).first()[0]
    entries = coded.select(F.sum(F.size(blocks.DICTIONARY))).first()[0]
    assert entries < n_tokens / 2  # already in blocks as small as those of this table
    plan = sequences.encode_blocks(coded, spark.createDataFrame([("a", 2)], "token string, id long"))._jdf.queryExecution().executedPlan().toString()
    assert "posexplode(_dictionary" in plan and "explode(tokens" not in plan


def test_parts_of_a_block_share_its_dictionary(monkeypatch):
    """A block is coded a part at a time, and its codes are kept compressed."""
    import types

    import pyarrow as pa
    monkeypatch.setattr(blocks, "PART", 40, raising=False)
    monkeypatch.setattr(blocks, "TaskContext", types.SimpleNamespace(get=lambda: types.SimpleNamespace(partitionId=lambda: 3)))
    rng = random.Random(8)
    some = [[rng.choice([None, *"abcdefgh"]) for _ in range(rng.choice([0, 3, 30, 90]))] for _ in range(400)] + [None, ["z"] * 50]
    made = pa.RecordBatch.from_arrays([pa.array(some, pa.list_(pa.string())), pa.array(range(len(some)))], ["tokens", "k"])
    out = list(blocks.coder(["k"], 5000, 10_000)(made.slice(i, 37) for i in range(0, len(some), 37)))
    got = {}
    for row in (r for b in out for r in b.to_pylist()):
        n, tokens = sum(row[blocks.LENGTHS]), [*row[blocks.DICTIONARY], None]
        assert n <= 5000 and len(row[blocks.CODES]) < n  # less than a byte a token here, not four
        texts = [tokens[c] for c in blocks.unpacked(row[blocks.CODES], n, "<i4")]
        assert len(set(tokens)) == len(tokens) and row[blocks.COUNTS] == [texts.count(t) for t in tokens[:-1]]
        for k, m in zip(row["k"], row[blocks.LENGTHS]):
            got[k], texts = texts[:m], texts[m:]
    assert 1 < len(out) and got == {i: t or [] for i, t in enumerate(some)}


def test_ids_reach_their_block_packed(spark, small_blocks):
    """A block gets a pack of ids from a task, not a row for each token."""
    coded = sequences.code_tokens(spark.createDataFrame(rows(), SCHEMA).repartition(3), carry=("split",))
    vocab = spark.createDataFrame([(f"t{i}", 10 + i) for i in range(0, 60, 2)], "token string, id long")
    ids = {f"t{i}": 10 + i for i in range(0, 60, 2)}
    found = {r[blocks.BLOCK]: r["packs"] for r in blocks.block_ids(coded, vocab, 1).collect()}
    for r in coded.collect():
        packs = [p.asDict() for p in found.get(r[blocks.BLOCK], [])]
        assert sum(p["n"] for p in packs) == len(r[blocks.DICTIONARY])
        assert blocks.ids_of(packs, 1).tolist() == [*(ids.get(t, 1) for t in r[blocks.DICTIONARY]), 1]
