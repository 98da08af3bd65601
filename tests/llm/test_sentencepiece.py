import hashlib
import itertools
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from cases import EDGE
from pyspark.sql import functions as F

from rubric.llm import queries
from rubric.llm import sentencepiece_fst as fst

PATH = public_tokenizers.path("piece_bpe_32k.model")
HARD = ["", " ", "  a  b ", "It's <s> </s> <unk> <0x0A>", "x\x85y\xa0z", "ﬁ ½² ١٢ 日本語テスト \U0001F600\U0001F9FF", "\x00 \x1c a\x1db", "▁x▁▁y",
        "a" * 50, "==========--------......", "    def f(x):\n\t\treturn  x\n", *[" " * i + "a" + " " * i for i in range(1, 20)]]


def ids(data):
    return np.frombuffer(data, "<u4").tolist()


def test_shortest_path_is_the_models_encoding():
    t, sp, r = fst.Transducer.from_file(PATH, memo=50), sentencepiece.SentencePieceProcessor(model_file=PATH), random.Random(5)
    alphabet = [p for p, _, kind in t.pieces if kind == fst.NORMAL]
    texts = HARD + [x or "" for _, x in EDGE][:-6]
    texts += ["".join(r.choice(alphabet) for _ in range(r.randint(1, 10))).replace(fst.MARK, " ") for _ in range(500)]
    texts += ["".join(r.choice("abcdeorstin .,-") for _ in range(r.randint(1, 60))) for _ in range(500)]
    for text in texts:
        got = t.encode(text)
        assert ids(got) == sp.encode(text), text[:60]
        assert t.decode(got) == sp.decode(sp.encode(text)) == text.replace(fst.MARK, " ")


def test_unigram_weights_against_all_segmentations():
    pieces = [("<unk>", 0.0, fst.UNKNOWN), *[(f"<0x{b:02X}>", 0.0, fst.BYTE) for b in range(256)]]
    scores = {"a": -3.0, "b": -3.1, "ab": -4.5, "ba": -4.0, "aab": -7.0, "bb": -9.0, "▁": -2.0, "▁a": -4.2}
    t = fst.Transducer(pieces + [(p, s, fst.NORMAL) for p, s in scores.items()], fst.UNIGRAM)

    def best(text):
        n = len(text)
        cuts = (c for k in range(n) for c in itertools.combinations(range(1, n), k))
        parts = ([text[i:j] for i, j in zip((0, *c), (*c, n))] for c in cuts)
        return max((sum(scores[p] for p in x) for x in parts if all(p in scores for p in x)), default=None)

    for text in ("".join(x) for n in range(1, 7) for x in itertools.product("ab", repeat=n)):
        found = ids(t.encode(text))
        assert abs(sum(t.pieces[i][1] for i in found) - best("▁" + text)) < 1e-9
        assert t.decode(t.encode(text)) == text
    assert t.decode(t.encode("aéb\n")) == "aéb\n"


def test_path_without_weight_checks_few_pairs():
    """Depth first finds the path of ``shortest`` with a part of its pair checks."""
    class Counted(fst.Memo):
        asked = 0

        def __getitem__(self, key):
            self.asked += 1
            return super().__getitem__(key)

    deep, wide, r = fst.Transducer.from_file(PATH), fst.Transducer.from_file(PATH), random.Random(7)
    deep.follows, wide.follows = Counted(deep._follows, fst.MEMO), Counted(wide._follows, fst.MEMO)
    words = [fst.MARK + "".join(r.choice("abcdeéèorstin.,-") for _ in range(r.randint(1, 14))) for _ in range(2000)]
    words += ["".join(r.choice("ab") for _ in range(40)) for _ in range(50)] + ["a" * 500]
    assert [deep.weightless(w) for w in words] == [wide.shortest(w) for w in words]
    assert 4 * deep.follows.asked < 3 * wide.follows.asked
    assert deep.weightless("a\ue000b") is None  # a character without a piece
    assert ids(deep.encode("a\ue000b")) == sentencepiece.SentencePieceProcessor(model_file=PATH).encode("a\ue000b")


def test_decoding_makes_no_trie():
    t = fst.Transducer.from_file(PATH)
    assert t.decode(np.array(sentencepiece.SentencePieceProcessor(model_file=PATH).encode("a b"), "<u4").tobytes()) == "a b"
    assert "trie" not in vars(t) and t.encode("a") and "trie" in vars(t)


def test_large_batches_are_handed_on_in_parts():
    t = fst.Transducer.from_file(PATH)
    texts, asked = [f"text {i} " * 5 for i in range(1000)], []

    def encode(text):
        asked.append(text)
        return t.encode(text)

    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(1000)), "text": texts})
    made = fst.with_column(iter([batch, batch.slice(0, 0)]), "ids", 1, encode, pa.binary())
    first = next(made)
    assert first.num_rows == len(asked) == fst.ROWS < 1000  # the rest of the batch isn't made yet
    rows = [r for b in (first, *made) for r in b.to_pylist()]
    assert rows == [{"doc_id": i, "text": x, "ids": t.encode(x)} for i, x in enumerate(texts)]
    assert fst.Transducer.from_file(PATH).remembered.size <= 125_000


def test_query_moves_no_text_beside_its_ids(spark, tmp_path, monkeypatch):
    texts, read = ["a b", "", None, "  x\n\u2581y \U0001F600", "ﬁ ½²"], []
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    decode_ids = fst.decode_ids
    monkeypatch.setattr(fst, "decode_ids", lambda rows, path: read.append(rows.columns) or decode_ids(rows, path))
    found = {r.doc_id: r for r in queries.op3_sentencepiece(spark, str(tmp_path)).collect()}
    assert read == [["doc_id", "ids", "text_sha256"]]
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    for i, x in enumerate(texts):
        text = (x or "").replace(fst.MARK, " ")
        assert (found[i].n_ids, found[i].decoded_sha256, found[i].round_trip) == (
            len(sp.encode(x or "")), hashlib.sha256(text.encode()).hexdigest(), True)
    # a text that doesn't come back isn't taken for one that does
    monkeypatch.setattr(fst, "decode_ids", lambda rows, path: decode_ids(rows, path).withColumn("decoded", F.concat("decoded", F.lit("?"))))
    assert not any(r.round_trip for r in queries.op3_sentencepiece(spark, str(tmp_path)).collect())


def test_documents(edge, empty):
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    rows = fst.decode_ids(fst.encode_documents(edge, PATH), PATH).collect()
    assert sorted((str(r.doc_id), ids(r.ids), r.decoded) for r in rows) == sorted(
        (str(i), sp.encode(t or ""), (t or "").replace(fst.MARK, " ")) for i, t in EDGE)
    assert fst.decode_ids(fst.encode_documents(empty, PATH), PATH).collect() == []
