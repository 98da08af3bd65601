import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from cases import EDGE
from tokenizers import Tokenizer

from rubric.llm import alignment, queries
from rubric.llm.packing import byte_letters

SMALL = "/root/testdata/sf0.001"
A, B = public_tokenizers.path(queries.BYTE_BPE), public_tokenizers.path(queries.PIECES)
TEXTS = ["日本語のテキスト。" * 50, "mixed 日本 text, and odd   spaces \t\n here " * 40, "no-spaces-" * 300, "   leading", "trailing   ",
         "a mark ▁ inside", "<s> <0x41> <|endoftext|> </s>", "\x00 \x1c \x85 　 end", "x", " ", "\n", "🎉 🎉🎉 é ﬁ " * 30, "tabs\tand  double  spaces"]


@pytest.fixture(scope="module")
def libraries():
    from sentencepiece import SentencePieceProcessor

    a, b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    return a, b


def brute_groups(libraries, text):
    """The groups of a whole text as [(first ids, second ids)], read off places in the joined bytes."""
    a, b = libraries
    byte_of = {c: n for n, c in byte_letters().items()}
    if not text:
        return []
    ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    spelled = ([bytes(byte_of[c] for c in a.id_to_token(i)) for i in ids[0]],
               [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids[1]])
    if any(b"".join(s) != (" " + text).encode() for s in spelled):
        return []
    ends = []
    for s in spelled:
        at, some = 0, []
        for t in s:
            at += len(t)
            some.append(at)
        ends.append(some)
    cuts = sorted(set(ends[0]) & set(ends[1]))
    groups, before = [], 0
    for c in cuts:
        groups.append(tuple([i for i, e in zip(ids[k], ends[k]) if before < e <= c] for k in (0, 1)))
        before = c
    return groups


def brute(libraries, rows):
    docs = [(i, brute_groups(libraries, t)) for i, t in rows]
    count = Counter()
    for _, groups in docs:
        count.update({(x, y) for a, b in groups for x in a for y in b})
    most = defaultdict(int)
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    out = []
    for i, groups in docs:
        links = [(x, y) for a, b in groups for x in a for y in b]
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        out.append((i, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links),
                    sum(count[p] == most[p[0]] for p in links), sum(count[p] for p in links),
                    hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return sorted(out, key=str)


def docs(spark, rows):
    extra = "block string, key string, n_a string, place string"
    return spark.createDataFrame([(*r, *"abcd") for r in rows], f"doc_id long, text string, {extra}").repartition(3)


def test_whole_table_against_brute_force(spark, libraries):
    rows = [(r.doc_id, r.text) for r in queries.table(spark, SMALL, "documents").collect()]
    got = sorted((tuple(r) for r in queries.op11_alignment(spark, SMALL).collect()), key=str)
    assert got == brute(libraries, rows)


def test_edge_rows_by_ranges(spark, libraries, tmp_path):
    """Small ranges, so that most texts go through the tree of fragments."""
    rows = [(i, t if t is None else t[:6000]) for i, t in EDGE] + [(100 + i, t) for i, t in enumerate(TEXTS)]
    docs(spark, rows).write.parquet(str(tmp_path / "docs"))
    got = alignment.align(spark.read.parquet(str(tmp_path / "docs")), A, B, size=97, edge=24).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(libraries, rows)
    assert alignment.align(docs(spark, []), A, B).collect() == []


def test_dictionary(spark, libraries):
    rows = [(1, "the cat"), (2, "the cat"), (3, "unbelievable"), (4, None)]
    got = {(r.a_id, r.b_id): (r["count"], r.best) for r in alignment.dictionary(docs(spark, rows), A, B).collect()}
    count = Counter()
    for _, t in rows:
        count.update({(x, y) for a, b in brute_groups(libraries, t) for x in a for y in b})
    assert {p: n for p, (n, _) in got.items()} == dict(count)
    assert all(best == (n == max(m for (y, _), (m, _) in got.items() if y == x)) for (x, _), (n, best) in got.items())


def as_tuple(f):
    return (f.ok, f.cut, f.n_a, f.n_b, *(x.tolist() for x in f.head), f.n_groups, f.text, f.codes.tolist(), f.times.tolist(),
            *(x.tolist() for x in f.tail))


@pytest.mark.parametrize("seed", range(5))
def test_fragments_compose_in_any_bracketing(libraries, seed):
    """Cut anywhere, also inside characters and groups: each bracketing gives the fragment of the whole."""
    known, rng = alignment.Aligner(A, B), random.Random(seed)
    text = " ".join(rng.choice(TEXTS)[:300] for _ in range(4)).replace("▁", "_")
    whole = b" " + text.encode()
    cuts = sorted({0, len(whole), *(rng.randrange(len(whole)) for _ in range(12))})
    parts = [known.fragment(whole, x, y) for x, y in zip(cuts, cuts[1:])]
    want = as_tuple(known.fragment(whole, 0, len(whole)))

    def bracket(some):
        if len(some) == 1:
            return some[0]
        k = rng.randrange(1, len(some))
        return bracket(some[:k]) + bracket(some[k:])

    for _ in range(5):
        assert as_tuple(bracket(parts)) == want
    assert as_tuple(alignment.Fragment() + parts[0]) == as_tuple(parts[0]) == as_tuple(parts[0] + alignment.Fragment())
    done = sum(parts, alignment.Fragment()).whole()
    groups = brute_groups(libraries, text)
    assert done.text.decode() == ";".join(alignment.group_text(*g) for g in groups) and done.n_groups == len(groups)


def test_bounds_cover_every_text():
    rng = random.Random(3)
    for _ in range(200):
        data = b" " + " ".join("x" * rng.choice([1, 3, 9, 80]) for _ in range(rng.randrange(40))).encode()
        ends = alignment.bounds(data, 60, 12)
        assert ends[0] == (0, 0, 0) and ends[-1] == (len(data),) * 3
        for (l0, at0, r0), (l1, at1, r1) in zip(ends, ends[1:]):
            assert l0 <= at0 <= r0 <= l1 <= at1 <= r1 and at0 < at1 + (at1 == len(data))


def test_memory_is_bounded():
    known = alignment.Aligner(A, B, memo=100_000)
    for i in range(40):
        known.learn([f"word{i}x{j}" for j in range(300)])
    assert known.held < 250_000


def test_a_step_of_documents_is_bounded(spark, monkeypatch):
    """Empty documents have no bytes, but their number bounds a step too; pairs are kept as they are, without a list of all."""
    known = alignment.Aligner(A, B)
    known.learn(["one", "two,"])
    assert not hasattr(known, "pair_at") and known.links.values.max() >= 1 << alignment.BITS
    assert alignment.ROWS << 2 * alignment.BITS < 1 << 63
