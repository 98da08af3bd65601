import random
import re
import struct
import zlib

import public_tokenizers
import pyarrow as pa
import pytest
from cases import EDGE
from tokenizers import Tokenizer

from rubric.llm import packing, token_counts

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
HARD = ["", "  ", "It's I'LL we've 'S", "áb é é é", "<|endoftext|> x<|startoftext|>y", "İstanbul ẞ ΑΣ ΌΣΟΣ",
        "x\x85y\xa0z w", "ﬁ ½² ١٢ 日本 \U0001F600", "\x00 \x1c a\x1db", "ʼn ǅ ª º\xad x", "Å K̊", "don't''s 's's 12a3",
        "end.\nStart  a ,b", "\n\n\n x", "$$$ ## a_b"]


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def test_chunks_give_the_librarys_ids():
    tokenizer, chunk = Tokenizer.from_file(WORDS), packing.chunk_encoder(WORDS, memo=3)
    for text in [*HARD, *[t or "" for _, t in EDGE]] * 2:
        data = b"".join(map(chunk, text.encode().split()))
        assert list(struct.unpack(f"<{len(data) // 4}I", data)) == ids_of(tokenizer, text), text[:50]


def test_whole_texts_give_the_librarys_ids():
    """Latin texts are split whole, with one pattern for every letter of their blocks."""
    import regex

    tokenizer, encode = Tokenizer.from_file(WORDS), packing.chunk_encoder(WORDS)
    latin = [chr(c) for c in [*range(9, 14), *range(32, 127), *range(0xA1, 0x250)]]
    rng = random.Random(7)
    mixed = ["".join(rng.choices(latin + ["'"] * 40 + list("strevemld ") * 8, k=40)) for _ in range(2000)]
    for text in mixed + [f"a{c}b 'a{c} {c}'s 1{c}2 .{c}." for c in latin]:
        assert re.findall(packing.PRE_TOKEN, text.lower()) == regex.findall(packing.PATTERN, text.lower()), text
    for text in [*HARD, *[t or "" for _, t in EDGE], *mixed[:300], *(" ".join(latin[i:i + 9]) for i in range(0, len(latin), 9))] * 2:
        data = encode(text.encode())
        assert list(struct.unpack(f"<{len(data) // 4}I", data)) == ids_of(tokenizer, text), text[:50]


def test_memory_of_pre_tokens_serves_all_spellings_of_a_chunk(monkeypatch):
    """``Word``, ``word,`` and ``(word)`` share one remembered pre-token."""
    made = []
    monkeypatch.setattr(packing, "Memo", type("Counted", (packing.Memo,), {
        "__init__": lambda self, make, *a: super(type(self), self).__init__(lambda k: made.append(k) or make(k), *a)}))
    packing.chunk_encoder.cache_clear()
    packing.chunk_encoder(WORDS)("Word word, (word) WORD. word".encode())
    packing.chunk_encoder.cache_clear()
    assert sorted(made) == ["(", ")", ",", ".", "word"]


def test_a_task_leaves_nothing_remembered(monkeypatch):
    """The worker process goes on to tasks of other stages."""
    memos = []
    monkeypatch.setattr(packing, "Memo", type("Kept", (packing.Memo,), {
        "__init__": lambda self, *a: super(type(self), self).__init__(*a) or memos.append(self)}))
    monkeypatch.setattr(packing, "TaskContext", type("Task", (), {"get": classmethod(lambda c: c()), "partitionId": lambda self: 0}))
    packing.chunk_encoder.cache_clear()
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["one two", "\u65e5\u672c one"])], ["doc_id", "text"])
    out = packing.encoder(WORDS)(iter([batch]))
    next(out)
    assert any(len(m) for m in memos)
    assert list(out) == [] and not any(len(m) or m.old for m in memos)
    packing.chunk_encoder.cache_clear()


def test_pieces_cover_every_id_once(edge):
    tokenizer, seq_len = Tokenizer.from_file(WORDS), 64
    rows = packing.pack(edge, WORDS, seq_len=seq_len).collect()
    want, got = [], []
    for i, t in EDGE:
        ids = [*ids_of(tokenizer, t), 1]
        want.append((i is None, i, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)) if len(ids) <= seq_len else 0))
    sequences = {}
    for r in rows:
        assert 0 < r.length <= seq_len and 0 <= r.offset and 0 <= r.start and r.start + r.length <= r.doc_tokens
        sequences.setdefault(r.sequence_id, []).append(r)
        if r.start == 0:
            got.append((r.doc_id is None, r.doc_id, r.doc_tokens))
    assert sorted(got, key=str) == sorted((w[:3] for w in want), key=str)
    for k, some in sequences.items():
        at = 0
        for r in sorted(some, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == seq_len or k == max(sequences)
    long = sorted((r for r in rows if r.doc_id == 12), key=lambda r: r.start)
    ids = [*ids_of(tokenizer, dict((i, t) for i, t in EDGE if i == 12)[12]), 1]
    assert [r.ids_crc32 for r in long] == [
        zlib.crc32(struct.pack(f"<{r.length}I", *ids[r.start:r.start + r.length])) for r in long]
    assert sum(r.length for r in long) == len(ids)


def test_empty_tables(empty):
    assert packing.pack(empty, WORDS).collect() == []
    assert token_counts.count_tokens(empty, BYTES).collect() == []


def test_counts_are_the_librarys(spark, edge):
    tokenizer = Tokenizer.from_file(BYTES)
    want = sorted(((i, len((t or "").encode()), len(ids_of(tokenizer, t)), len(ids_of(tokenizer, t)) > 1024) for i, t in EDGE), key=str)
    assert sorted(map(tuple, token_counts.count_tokens(edge, BYTES).collect()), key=str) == want
    hard = spark.createDataFrame(list(enumerate(HARD)), "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(hard, BYTES).collect()}
    assert got == {i: len(ids_of(tokenizer, t)) for i, t in enumerate(HARD)}


@pytest.mark.parametrize("sizes", [[], [0, 0], [5, 5, 5], [100, 1, 1], [1, 100, 1]])
def test_blocks_cover_all_rows(sizes):
    parts = list(token_counts.blocks(sizes, 10))
    assert [i for a, b in parts for i in range(a, b)] == list(range(len(sizes)))
    assert all(sum(sizes[a:b]) <= 10 or b - a <= 1 or sum(sizes[a:b - 1]) == 0 for a, b in parts)
