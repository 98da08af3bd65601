"""Alignment of two tokenizers' tokens, and how often their ids meet.

A place of a text where tokens of both end cuts it into groups; the tokens of
a group are linked.  ``Fragment`` is what is known of a range of bytes: the
tokens up to its first cut (the open prefix), the closed groups, the tokens
behind its last cut (the open suffix).  Fragments of neighbouring ranges
compose, and how they are bracketed doesn't matter, so a very long document is
dealt out as ranges of bytes, each aligned by some task, and a tree of joins
puts its fragments together, ``FAN`` at a time.

A range is exact although no task sees the whole text: around each end of it
the text is read on to the next place that no token of either tokenizer crosses
(a single space between other characters), and tokens count where they end.
Between such places, pieces of a text don't depend on each other, so what is
found for a piece is remembered.

Counts over the corpus: tasks write blocks of documents that name their id
pairs by places in the block's own list of distinct pairs.  Only those lists
are shuffled to be added up, and their sums go back to the blocks.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.skew import content, salted_join
from .packing import byte_letters
from .rows import project, python_ready, written

#: Bytes of a range, of documents longer than that; a range's ends are read on for at most so many bytes.
RANGE = 64 << 10
EDGE = 4 << 10
#: Fragments that one step of the tree puts together.
FAN = 16
#: Bytes of text aligned at a time, and of a block of documents.
STEP, BLOCK = 1 << 20, 4 << 20
#: Documents aligned at a time.
ROWS = 1 << 16
#: Bytes of what a worker remembers of pieces; longer pieces aren't remembered beyond their step.
MEMO, LONGEST = 72 << 20, 64
#: An id pair is one number: the first tokenizer's id, then this many bits of the second's.
BITS = 20

SPACE = "▁"
#: Characters that count as white space in no version of Unicode and no library.
INK = "[!-~¡-˿Ͱ-ᙿぁ-힣]"
SPLIT = re.compile(f"(?<={INK}) (?={INK})").split
SAFE = re.compile(b"(?<=[!-~]) (?=[!-~])")

BLOCKS = ("block long, doc_ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, "
          "sha array<string>, n_pairs array<int>, places binary, times binary, codes array<long>, docs array<long>")
RANGES = ("key long, doc_id long, part int, parts int, left binary, skip int, middle binary, right binary, keep int")
FRAGMENTS = ("key long, doc_id long, part int, parts int, ok boolean, cut boolean, n_a long, n_b long, n_groups long, "
             "head_a binary, head_b binary, text binary, codes binary, times binary, tail_a binary, tail_b binary")
REPORT = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")

NONE = np.zeros(0, np.int64)


def group_text(a: Iterable[int], b: Iterable[int]) -> str:
    return ",".join(map(str, a)) + "|" + ",".join(map(str, b))


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The id pairs of a group, each pair of occurrences."""
    return (np.repeat(a, len(b)) << BITS) | np.tile(b, len(a))


def counted(codes: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs, sorted, and how often each occurs."""
    distinct, at = np.unique(codes, return_inverse=True)
    return distinct, np.bincount(at, weights=times, minlength=len(distinct)).astype(np.int64)


@dataclass
class Fragment:
    """A range of bytes.  ``head`` and ``tail``: (ids of the first, ids of the
    second tokenizer) outside closed groups; a fragment without a cut has a
    head only.  ``codes``, ``times``: the id pairs of the closed groups;
    ``text``: these groups, as ``group_text`` with ``;`` between them.
    ``ok``: the tokens' bytes are those of the text.

    ``Fragment()`` is the neutral element of ``+``.
    """

    ok: bool = True
    cut: bool = False
    n_a: int = 0
    n_b: int = 0
    head: tuple[np.ndarray, np.ndarray] = (NONE, NONE)
    n_groups: int = 0
    text: bytes = b""
    codes: np.ndarray = field(default_factory=lambda: NONE)
    times: np.ndarray = field(default_factory=lambda: NONE)
    tail: tuple[np.ndarray, np.ndarray] = (NONE, NONE)

    @classmethod
    def of(cls, a: np.ndarray, a_ends: np.ndarray, b: np.ndarray, b_ends: np.ndarray, ok: bool = True) -> Fragment:
        """Of the tokens that end in a range, with the places where they end."""
        cuts = np.intersect1d(a_ends, b_ends)
        if not len(cuts):
            return cls(ok=ok, n_a=len(a), n_b=len(b), head=(a, b))
        a_at, b_at = (np.searchsorted(ends, cuts, "right") for ends in (a_ends, b_ends))
        groups = [(a[i:j], b[k:m]) for i, j, k, m in zip(a_at[:-1], a_at[1:], b_at[:-1], b_at[1:])]
        codes, times = counted(np.concatenate([NONE, *(product(*g) for g in groups)]), None)
        return cls(ok, True, len(a), len(b), (a[:a_at[0]], b[:b_at[0]]), len(groups),
                   ";".join(group_text(*(x.tolist() for x in g)) for g in groups).encode(), codes, times,
                   (a[a_at[-1]:], b[b_at[-1]:]))

    def __add__(self, other: Fragment) -> Fragment:
        ok, n_a, n_b = self.ok and other.ok, self.n_a + other.n_a, self.n_b + other.n_b
        between = tuple(np.concatenate(p) for p in zip(self.tail if self.cut else self.head, other.head))
        if not other.cut:
            if not self.cut:
                return Fragment(ok, False, n_a, n_b, between)
            return Fragment(ok, True, n_a, n_b, self.head, self.n_groups, self.text, self.codes, self.times, between)
        if not self.cut:
            return Fragment(ok, True, n_a, n_b, between, other.n_groups, other.text, other.codes, other.times, other.tail)
        here = product(*between)
        closed = len(between[0]) + len(between[1]) > 0  # else a cut lies between the two fragments
        text = group_text(*(x.tolist() for x in between)).encode() if closed else b""
        codes, times = counted(np.concatenate([self.codes, here, other.codes]),
                               np.concatenate([self.times, np.ones(len(here), np.int64), other.times]))
        return Fragment(ok, True, n_a, n_b, self.head, self.n_groups + closed + other.n_groups,
                        b";".join(t for t in (self.text, text, other.text) if t), codes, times, other.tail)

    def whole(self) -> Fragment:
        """Of a whole text, which begins and ends with a cut: all groups closed, or nothing if its bytes don't agree."""
        if not self.ok or not self.n_a or not self.n_b:
            return Fragment()
        edge = Fragment(cut=True)
        return edge + self + edge


class Grown:
    """Numbers that are appended to, as one array."""

    def __init__(self) -> None:
        self.held, self.n = np.zeros(1024, np.int64), 0

    def extend(self, values: np.ndarray) -> None:
        need = self.n + len(values)
        if need > len(self.held):
            self.held = np.concatenate([self.held[:self.n], np.zeros(max(need, 2 * self.n) - self.n, np.int64)])
        self.held[self.n:need] = values
        self.n = need

    @property
    def values(self) -> np.ndarray:
        return self.held[:self.n]


class Aligner:
    """Tokenizes pieces with both tokenizers and remembers how they align.

    ``path_a``: a byte-level vocabulary of the tokenizers library;
    ``path_b``: a sentencepiece model that writes a space as a mark, puts one
    in front, and has no piece with a mark behind other characters.
    """

    def __init__(self, path_a: str, path_b: str, memo: int = MEMO):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), SentencePieceProcessor(model_file=path_b)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        byte_of = {c: bytes([b]) for b, c in byte_letters().items()}
        size = self.a.get_vocab_size()
        self.bytes_a = [b"".join(byte_of.get(c, c.encode()) for c in self.a.id_to_token(i) or "") for i in range(size)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(SPACE in p.lstrip(SPACE) for i, p in enumerate(pieces) if not self.b.is_byte(i)):
            raise ValueError(f"{path_b}: a piece reaches across a space")
        if max(size, len(pieces)) >= 1 << BITS:
            raise ValueError(f"{path_a}, {path_b}: too many pieces")
        self.bytes_b = [bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.len_a, self.len_b = (np.array([len(t) for t in table]) for table in (self.bytes_a, self.bytes_b))
        #: Every id as text, with what can stand behind it in a group's text: ids of the first tokenizer, then of the second.
        self.names = [f"{i}{end}" for table, ends in ((self.bytes_a, ",|"), (self.bytes_b, (",", ";", ""))) for i in range(len(table)) for end in ends]
        self.memo = memo
        self.forget()

    def forget(self) -> None:
        self.at: dict[str, int] = {}
        self.texts: list[str] = []
        self.held = 0
        #: Of each piece: numbers of tokens, groups and links, whether its bytes agree, and where its links end in ``links``.
        self.n_a, self.n_b, self.n_groups, self.n_links, self.ok, self.ends = (Grown() for _ in range(6))
        self.links = Grown()

    def tokens(self, pieces: list[str]):
        """((ids, number in each piece) of both tokenizers, which pieces' bytes agree)."""
        a = [e.ids for e in self.a.encode_batch([" " + p for p in pieces], add_special_tokens=False)]
        b = self.b.encode(pieces, num_threads=1)
        ok = np.ones(len(pieces), bool)
        want = (" " + " ".join(pieces)).encode()
        for lists, table in ((a, self.bytes_a), (b, self.bytes_b)):
            if b"".join(map(table.__getitem__, chain.from_iterable(lists))) != want:
                ok &= [b"".join(table[i] for i in ids) == b" " + p.encode() for ids, p in zip(lists, pieces)]
        return *((np.fromiter(chain.from_iterable(lists), np.int64), np.fromiter(map(len, lists), np.int64, len(lists)))
                 for lists in (a, b)), ok

    def fragment(self, piece: bytes, after: int, upto: int) -> Fragment:
        """Of a piece (its space included), the tokens that end behind ``after`` and not behind ``upto``."""
        (a, _), (b, _), ok = self.tokens([piece[1:].decode()])
        if not ok[0]:
            return Fragment(ok=False)
        a_ends, b_ends = np.cumsum(self.len_a[a]), np.cumsum(self.len_b[b])
        in_a, in_b = (a_ends > after) & (a_ends <= upto), (b_ends > after) & (b_ends <= upto)
        return Fragment.of(a[in_a], a_ends[in_a], b[in_b], b_ends[in_b])

    def learn(self, pieces: Iterable[str]) -> None:
        """All ``pieces`` are in ``at`` afterwards."""
        if self.held > self.memo:
            self.forget()
        new = [p for p in pieces if p not in self.at]
        for i in range(0, len(new), 4096):
            self._align(new[i:i + 4096])

    def _align(self, pieces: list[str]) -> None:
        (a, n_a), (b, n_b), ok = self.tokens(pieces)
        if not ok.all():  # pieces whose bytes don't agree have no tokens
            a, b = a[np.repeat(ok, n_a)], b[np.repeat(ok, n_b)]
            n_a, n_b = n_a * ok, n_b * ok
        a_ends, b_ends = np.cumsum(self.len_a[a]), np.cumsum(self.len_b[b])
        cuts = np.intersect1d(a_ends, b_ends, assume_unique=True)  # the ends of pieces are among them
        a_at = np.concatenate([[0], np.searchsorted(a_ends, cuts, "right")])
        b_at = np.concatenate([[0], np.searchsorted(b_ends, cuts, "right")])
        in_a, in_b = np.diff(a_at), np.diff(b_at)
        piece_of = np.repeat(np.arange(len(pieces)), n_a)[a_at[:-1]] if len(a) else NONE
        # Each first token meets the second tokens of its group.
        group_of = np.repeat(np.arange(len(cuts)), in_a)
        times = in_b[group_of]
        place = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(b_at[group_of], times)
        codes = (np.repeat(a, times) << BITS) | b[place]
        n_links = np.bincount(piece_of, weights=in_a * in_b, minlength=len(pieces)).astype(np.int64)
        before = self.links.n
        self.links.extend(codes)
        for grown, values in ((self.n_a, n_a), (self.n_b, n_b), (self.n_groups, np.bincount(piece_of, minlength=len(pieces))),
                              (self.n_links, n_links), (self.ok, ok), (self.ends, before + np.cumsum(n_links))):
            grown.extend(values)
        # The tokens in the order of the groups' texts, each with the mark behind it.
        last_of = np.zeros(len(cuts), bool)
        last_of[np.cumsum(np.bincount(piece_of, minlength=len(pieces)))[ok] - 1] = True
        closed_by = np.repeat(np.arange(len(cuts)), in_b)
        order = np.zeros(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + b_at[group_of]] = 2 * a + (np.arange(len(a)) + 1 == a_at[group_of + 1])
        order[np.arange(len(b)) + a_at[closed_by + 1]] = 2 * len(self.bytes_a) + 3 * b + np.where(
            np.arange(len(b)) + 1 < b_at[closed_by + 1], 0, np.where(last_of[closed_by], 2, 1))
        names, ends = [self.names[i] for i in order.tolist()], np.cumsum(n_a + n_b)
        for p, begin, end, n in zip(pieces, (ends - n_a - n_b).tolist(), ends.tolist(), n_links.tolist()):
            self.at[p] = len(self.texts)
            text = "".join(names[begin:end])
            self.texts.append(text)
            self.held += 250 + len(p) + len(text) + 8 * n
            if len(p) > LONGEST:
                self.held += self.memo // 64  # long pieces bring the next ``forget`` nearer

    def pairs_of(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The id pairs of all links of the pieces at ``at``, and how many each piece has."""
        n = self.n_links.values[at]
        first = self.ends.values[at] - n
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
        return self.links.values[place], n

    def middle(self, text: str) -> Fragment:
        """Of a text between two safe places (its first space left out)."""
        pieces = SPLIT(text)
        self.learn(pieces)
        at = np.array([self.at[p] for p in pieces])
        links, _ = self.pairs_of(at)
        codes, times = np.unique(links, return_counts=True)
        return Fragment(bool(self.ok.values[at].all()), True, int(self.n_a.values[at].sum()), int(self.n_b.values[at].sum()), (NONE, NONE),
                        int(self.n_groups.values[at].sum()), ";".join(filter(None, (self.texts[i] for i in at))).encode(),
                        codes, times.astype(np.int64))


@functools.lru_cache(maxsize=2)
def aligner(path_a: str, path_b: str, memo: int = MEMO) -> Aligner:
    """One for each worker process: what it remembers serves all its tasks."""
    return Aligner(path_a, path_b, memo)


class Block:
    """Documents whose rows are gathered until there is enough text for a block."""

    def __init__(self, number: int):
        self.number, self.size, self.rows, self.codes, self.times = number, 0, [], [], []

    def add(self, doc_id, n_a: int, n_b: int, n_groups: int, n_links: int, sha: str, codes: np.ndarray, times: np.ndarray) -> None:
        self.rows.append((doc_id, n_a, n_b, n_groups, n_links, sha, len(codes)))
        self.codes.append(codes)
        self.times.append(narrow(times))

    def add_fragment(self, doc_id, f: Fragment) -> None:
        """Of a document's ``whole()``."""
        self.size += len(f.text)
        self.add(doc_id, f.n_a, f.n_b, f.n_groups, int(f.times.sum()), hashlib.sha256(f.text).hexdigest() if f.n_a else "", f.codes, f.times)

    def batch(self) -> pa.RecordBatch:
        codes = np.concatenate([NONE, *self.codes])
        distinct, places = np.unique(codes, return_inverse=True)
        times = narrow(np.concatenate([NONE, *self.times]))
        names = [f.split()[0] for f in BLOCKS.split(", ")]
        kinds = [pa.int64()] * 5 + [pa.string(), pa.int32()]
        columns = list(zip(*self.rows)) or [()] * 7

        def one(values: np.ndarray) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, pa.int64()))

        return pa.RecordBatch.from_arrays(
            [pa.array([self.number], pa.int64()), *(pa.array([list(c)], pa.list_(k)) for c, k in zip(columns, kinds)),
             pa.array([narrow(places).tobytes()], pa.binary()), pa.array([times.tobytes()], pa.binary()),
             one(distinct), one(np.bincount(places, minlength=len(distinct)))], names)


def narrow(values: np.ndarray) -> np.ndarray:
    """In two bytes each if they fit, else in eight."""
    return values.astype("<u2") if values.max(initial=0) < 1 << 16 else values.astype("<i8")


def widened(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, "<u2" if len(data) == 2 * n else "<i8").astype(np.int64)


def block_numbers() -> Iterator[int]:
    """Numbers that no other task's blocks have."""
    part = TaskContext.get().partitionId()
    return iter(range(part << 32, (part + 1) << 32))


def short_blocks(path_a: str, path_b: str, step: int = STEP, block: int = BLOCK):
    """A function of Arrow batches (doc_id, text) that yields ``BLOCKS``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, numbers = aligner(path_a, path_b), block_numbers()
        out = Block(next(numbers))

        def flush(ids: list, texts: list[str]) -> None:
            pieces = [SPLIT(t) if t else [] for t in texts]
            known.learn(set().union(*pieces))
            at = np.array([known.at[p] for some in pieces for p in some], np.int64)
            doc = np.repeat(np.arange(len(ids)), [len(p) for p in pieces])
            bad = np.bincount(doc, weights=known.ok.values[at] == 0, minlength=len(ids)) > 0

            def total(grown: Grown) -> list[int]:
                return np.where(bad, 0, np.bincount(doc, weights=grown.values[at], minlength=len(ids))).astype(np.int64).tolist()

            n_a, n_b, n_groups, n_links = map(total, (known.n_a, known.n_b, known.n_groups, known.n_links))
            links, n = known.pairs_of(at)
            # A document's number and an id pair in one number, for which ``ROWS`` is small enough.
            both, times = np.unique((np.repeat(doc, n) << 2 * BITS) | links, return_counts=True)
            codes, first = both & ((1 << 2 * BITS) - 1), np.searchsorted(both >> 2 * BITS, np.arange(len(ids) + 1))
            ends = np.cumsum([0, *(len(p) for p in pieces)])
            for i, doc_id in enumerate(ids):
                if n_a[i] and n_b[i]:
                    text = ";".join([known.texts[k] for k in at[ends[i]:ends[i + 1]].tolist()])
                    some = slice(first[i], first[i + 1])
                    out.add(doc_id, n_a[i], n_b[i], n_groups[i], n_links[i], hashlib.sha256(text.encode()).hexdigest(), codes[some], times[some])
                else:
                    out.add(doc_id, 0, 0, 0, 0, "", NONE, NONE)

        ids, texts, size = [], [], 0
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                for doc_id, text in zip(*(c.to_pylist() for c in batch.slice(i, 64).columns)):
                    ids.append(doc_id)
                    texts.append(text)
                    size += len(text)
                    if size >= step or len(ids) == ROWS:
                        flush(ids, texts)
                        out.size += size
                        ids, texts, size = [], [], 0
                if out.size >= block:
                    yield out.batch()
                    out = Block(next(numbers))
        if ids:
            flush(ids, texts)
        if out.rows:
            yield out.batch()

    return run


def bounds(data: bytes, size: int = RANGE, edge: int = EDGE) -> list[tuple[int, int, int]]:
    """Where the ranges of a text (a space in front) end: (safe place at or
    before the end, the end, safe place at or behind it), about ``size``
    bytes apart.  An end without safe places within ``edge`` bytes moves to the next safe place, or the text's end."""
    out, at, n = [(0, 0, 0)], size, len(data)
    while at < n:
        last = None
        for last in SAFE.finditer(data, max(out[-1][2], at - edge), min(n, at + 2)):
            pass
        left = last.start() if last and last.start() <= at else None
        found = SAFE.search(data, at, min(n, at + edge))
        if left is None or found is None:
            found = SAFE.search(data, max(at, out[-1][2]))
            if found is None:
                break
            out.append((found.start(),) * 3)
        else:
            out.append((left, at, found.start()))
        at = max(out[-1][1], out[-1][2]) + size
    return [*out, (n, n, n)]


def range_maker(size: int = RANGE, edge: int = EDGE):
    """A function of Arrow batches (key, doc_id, text) that yields ``RANGES``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in RANGES.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.int32()]
        for batch in batches:
            for i in range(batch.num_rows):
                key, doc_id, text = (c[i].as_py() for c in batch.columns)
                data = b" " + text.encode()
                ends = bounds(data, size, edge)
                for k, ((l0, at0, r0), (l1, at1, r1)) in enumerate(zip(ends, ends[1:])):
                    row = (key, doc_id, k, len(ends) - 1, data[l0:r0], at0 - l0, data[r0:l1], data[l1:r1], at1 - l1)
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], names)

    return run


def range_fragment(known: Aligner, left: bytes, skip: int, middle: bytes, right: bytes, keep: int) -> Fragment:
    out = known.fragment(left, skip, len(left)) if left else Fragment(cut=True)
    if middle:
        out = out + known.middle(middle[1:].decode())
    return out + known.fragment(right, 0, keep) if right else out


def packed(key: int, doc_id, part: int, parts: int, f: Fragment) -> tuple:
    return (key, doc_id, part, parts, f.ok, f.cut, f.n_a, f.n_b, f.n_groups, f.head[0].tobytes(), f.head[1].tobytes(), f.text,
            f.codes.tobytes(), f.times.tobytes(), f.tail[0].tobytes(), f.tail[1].tobytes())


def unpacked(row: dict) -> Fragment:
    a, b, codes, times, c, d = (np.frombuffer(row[x], np.int64) for x in ("head_a", "head_b", "codes", "times", "tail_a", "tail_b"))
    return Fragment(row["ok"], row["cut"], row["n_a"], row["n_b"], (a, b), row["n_groups"], row["text"], codes, times, (c, d))


def fragment_batch(row: tuple) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
    fields = [f.split() for f in FRAGMENTS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([v], kinds[t]) for v, (_, t) in zip(row, fields)], [n for n, _ in fields])


def long_fragments(rows: DataFrame, path_a: str, path_b: str, size: int = RANGE, edge: int = EDGE, fan: int = FAN) -> DataFrame:
    """``FRAGMENTS`` of whole texts, one for each row (key, doc_id, text) with
    a key of its own: ranges are dealt to all tasks, and their fragments
    composed ``fan`` at a time until there is one for each text."""
    ranges = written(rows.mapInArrow(range_maker(size, edge), RANGES), "alignment-ranges")
    most = ranges.agg(F.max("parts")).first()[0] or 1

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = aligner(path_a, path_b)
        for batch in batches:
            for i in range(batch.num_rows):
                key, doc_id, part, parts, *rest = (c[i].as_py() for c in batch.columns)
                yield fragment_batch(packed(key, doc_id, part, parts, range_fragment(known, *rest)))

    def compose(table: pa.Table) -> pa.Table:
        found = sorted(table.drop(["above"]).to_pylist(), key=lambda r: r["part"])
        one, first = sum((unpacked(r) for r in found), Fragment()), found[0]
        return pa.Table.from_batches([fragment_batch(packed(first["key"], first["doc_id"], first["part"] // fan, first["parts"], one))])

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = ranges.repartition(parts, "key", "part").mapInArrow(align, FRAGMENTS)
    while most > 1:
        out = out.withColumn("above", F.floor(F.col("part") / fan)).groupBy("key", "above").applyInArrow(compose, FRAGMENTS)
        most = -(-most // fan)
    return out


def aligned_blocks(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text",
                   size: int = RANGE, edge: int = EDGE) -> DataFrame:
    """``BLOCKS`` of all documents, as a written table.  ``docs`` is read from files."""
    python_ready(docs.sparkSession)
    rows = project(docs, id_col, text_col)
    is_long = F.octet_length("text") > size
    short = rows.where(~is_long).mapInArrow(short_blocks(path_a, path_b), BLOCKS)
    # A row's place in its file split is its key: ids may be null or repeated.
    keyed = rows.select(F.monotonically_increasing_id().alias("key"), "doc_id", "text").where(is_long)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = block_numbers()
        out = Block(-1 - next(numbers))
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                out.add_fragment(row["doc_id"], unpacked(row).whole())
                if out.size >= BLOCK:
                    yield out.batch()
                    out = Block(-1 - next(numbers))
        if out.rows:
            yield out.batch()

    return written(short.union(long_fragments(keyed, path_a, path_b, size, edge).mapInArrow(finish, BLOCKS)), "alignment-blocks")


def entries(blocks: DataFrame) -> DataFrame:
    """(block, place, code, docs): the lists of distinct pairs, and how many documents of the block hold each."""
    return blocks.select("block", F.posexplode(F.arrays_zip("codes", "docs")).alias("place", "e")).select("block", "place", "e.codes", "e.docs").toDF(
        "block", "place", "code", "docs")


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(code, count, best, n): how many documents hold each id pair linked,
    whether its first id has no pair with more, and in how many blocks it is.
    A first id has at most as many pairs as the second tokenizer has ids."""
    sums = entries(blocks).groupBy("code").agg(F.sum("docs").alias("count"), F.count(F.lit(1)).alias("n"))
    most = F.max("count").over(Window.partitionBy(first_id(F.col("code"))))
    return sums.select("code", "count", (F.col("count") == most).alias("best"), "n")


def first_id(code: Column) -> Column:
    return F.shiftright(code, BITS)


def second_id(code: Column) -> Column:
    return F.pmod(code, F.lit(1 << BITS))


def dictionary(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(a_id, b_id, count, best) of all linked id pairs."""
    counts = pair_counts(aligned_blocks(docs, path_a, path_b, id_col, text_col))
    return counts.select(first_id(F.col("code")).alias("a_id"), second_id(F.col("code")).alias("b_id"), "count", "best")


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text",
          size: int = RANGE, edge: int = EDGE) -> DataFrame:
    """One row per input row, ``REPORT``: numbers of tokens, groups and links
    (pairs of occurrences); links whose id pair is the most frequent of its
    first id over all documents (ties count); the sum of the links' pair
    counts; SHA-256 of the groups as ``a1,a2|b1;a3|b2``.

    Texts are encoded with a space in front and without special tokens.  A
    null or empty text, or one whose tokens' bytes aren't those of the text
    with the space, has no tokens: zeros and an empty hash.  Rows that repeat an id are
    documents of their own, null ids stay null, an empty table gives no rows.
    """
    blocks = aligned_blocks(docs, path_a, path_b, id_col, text_col, size, edge)
    counts = written(pair_counts(blocks), "alignment-counts")
    here = entries(blocks).select("block", "place", "code")
    # A frequent pair is in every block: its rows are dealt to several tasks.
    found = salted_join(here, counts.select("code", "count", "best"), "code", counts=counts.select("code", "n"), salt=content("block"))
    back = found.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("place", "count", "best"))).alias("e")).select(
        "block", F.col("e")["count"].alias("counts"), F.col("e")["best"].alias("bests"))
    names = [f.split()[0] for f in REPORT.split(", ")]

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: c[i] for n, c in zip(batch.schema.names, batch.columns)}
                n_pairs = row["n_pairs"].values.to_numpy()
                places, times = (widened(row[x].as_py(), int(n_pairs.sum())) for x in ("places", "times"))
                doc = np.repeat(np.arange(len(n_pairs)), n_pairs)
                counts, bests = (row[x].values.to_numpy(zero_copy_only=False) if row[x].is_valid else NONE for x in ("counts", "bests"))
                n_best, count_sum = np.zeros(len(n_pairs), np.int64), np.zeros(len(n_pairs), np.int64)
                np.add.at(n_best, doc, times * bests[places])
                np.add.at(count_sum, doc, times * counts[places])
                yield pa.RecordBatch.from_arrays([*(row[x].values for x in ("doc_ids", "n_a", "n_b", "n_groups", "n_links")),
                                                  pa.array(n_best), pa.array(count_sum), row["sha"].values], names)

    kept = blocks.select("block", "doc_ids", "n_a", "n_b", "n_groups", "n_links", "sha", "n_pairs", "places", "times")
    return kept.join(back, "block", "left").mapInArrow(report, REPORT)
