"""SentencePiece encoding and decoding as a weighted finite-state transducer.

Compiled from the model file:

- the normaliser: a space becomes the mark, one more mark in front;
- the lexicon: a trie over the characters of all pieces; the arc that ends
  a piece writes its id;
- byte fallback: a character that is no piece becomes the pieces of its UTF-8
  bytes;
- the weights.  A unigram model weighs a piece with its negated score.  A
  merge (BPE) model says which pieces may follow each other: a piece's arc
  weighs nothing after a piece with which it is what merging yields, and
  infinitely much after any other.  A segmentation is the one that merging
  yields if and only if each neighbouring pair is, so the path of finite
  weight is the model's own encoding.

Composition with an input is lazy: states are places in the input with the
last piece before them, and the tropical-semiring shortest path takes them
place by place.  A merge model's path without fallback has no weight, so it is
looked for depth first, long pieces first, which leaves most arcs untouched.
Inputs are cut where no piece can reach across (before a run of marks, around
characters without a piece), and what a cut yields is remembered.

Decoding runs backwards: ids to bytes, marks to spaces, the one in front
dropped.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packing import LONGEST, ROWS, Memo
from .rows import project, python_ready

MARK = "▁"
#: Pairs of pieces, and cuts, that a worker remembers (two generations of this size each); a cut takes some 200 bytes.
MEMO = 250_000
CUTS = 125_000
#: Kinds of pieces, and of models, in model files.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, MERGES = 1, 2
#: Weight of a byte piece of fallback: more than any path of pieces.
FALLBACK = 1e6


class Transducer:
    """``pieces``: (piece, score, kind) in order of their ids."""

    def __init__(self, pieces: list[tuple[str, float, int]], model: int, dummy_prefix: bool = True, memo: int = MEMO):
        self.pieces, self.model, self.dummy_prefix = pieces, model, dummy_prefix
        self.ids = {p: i for i, (p, _, kind) in enumerate(pieces) if kind == NORMAL}
        self.score = {p: s for p, s, kind in pieces if kind == NORMAL}
        self.byte_id = {int(p[1:-1], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == BYTE}
        self.unknown = next((i for i, (_, _, kind) in enumerate(pieces) if kind == UNKNOWN), None)
        self.written = [self._writes(p, kind) for p, _, kind in pieces]
        self.length = [len(p) for p, _, _ in pieces]
        self.edges = Memo(self._edges, len(pieces))
        self.follows = Memo(self._follows, memo)
        self.remembered = Memo(self._encode_cut, min(memo, CUTS), LONGEST)

    @classmethod
    def from_file(cls, path: str, memo: int = MEMO) -> Transducer:
        from sentencepiece import sentencepiece_model_pb2 as proto

        m = proto.ModelProto()
        with open(path, "rb") as f:
            m.ParseFromString(f.read())
        spec = m.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces \
                or m.trainer_spec.treat_whitespace_as_suffix or m.trainer_spec.model_type not in (UNIGRAM, MERGES):
            raise ValueError(f"{path}: a normaliser or model kind that isn't compiled here")
        if any(p.type == USER for p in m.pieces):
            raise ValueError(f"{path}: user-defined pieces")
        return cls([(p.piece, p.score, p.type) for p in m.pieces], m.trainer_spec.model_type, spec.add_dummy_prefix, memo)

    def _writes(self, piece: str, kind: int) -> bytes:
        if kind == BYTE:
            return bytes([int(piece[1:-1], 16)])
        return {CONTROL: b"", UNKNOWN: " ⁇ ".encode()}.get(kind, piece.encode())

    @functools.cached_property
    def trie(self) -> dict:
        """character -> (piece that ends there or None, what follows).  Made when a text is encoded: decoding needs none."""
        nested: dict = {}
        for p, i in self.ids.items():
            node = nested
            for c in p:
                node = node.setdefault(c, {})
            node[""] = i
        leaf: dict = {}

        def arcs(node: dict) -> dict:
            return {c: (more.get(""), arcs(more)) for c, more in node.items() if c} or leaf

        return arcs(nested)

    @functools.cached_property
    def cut(self):
        return self._cutter().findall

    def _cutter(self):
        """Cuts normalised text where no piece reaches across."""
        breaks = "".join(re.escape(chr(c)) for c in range(128) if chr(c) not in self.trie)
        if any(MARK in p.lstrip(MARK) for p in self.ids):  # a piece has marks behind other characters
            return re.compile(f"[{breaks}]|[^{breaks}]+")
        return re.compile(f"[{breaks}]|{MARK}+[^{MARK}{breaks}]*|[^{MARK}{breaks}]+")

    def merged(self, text: str) -> tuple[list[str], list, list]:
        """What merging yields: again and again the best neighbours (the
        first of them) whose join is a piece.  Also the steps that changed
        the first and the last part: (score, that part then)."""
        parts, first, last = list(text), [], []
        while True:
            best, at = -np.inf, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and s > best:
                    best, at = s, i
            if at < 0:
                return parts, first, last
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
            if at == 0:
                first.append((best, parts[0]))
            if at == len(parts) - 1:
                last.append((best, parts[-1]))

    def _edges(self, piece: int) -> tuple | None:
        """(first parts, last parts) of a piece while it is merged, each from
        its character on; None if merging yields something else, or if its
        steps don't go from high to low scores."""
        text = self.pieces[piece][0]
        parts, first, last = self.merged(text)
        ordered = all(x[0] >= y[0] for steps in (first, last) for x, y in zip(steps, steps[1:]))
        return ([(np.inf, text[0]), *first], [(np.inf, text[-1]), *last]) if parts == [text] and ordered else None

    def _follows(self, pair: int) -> bool:
        """May a piece follow another (or the beginning, or a character
        without a piece)?  ``pair``: (number of the other + 1, or 0) times the
        number of pieces, plus the piece's number.

        Merging never joins across the boundary if, whenever the parts on
        both sides of it could be joined, a step inside one of the pieces
        comes first: one with a higher score, or as high and further left.
        """
        left, right = divmod(pair, len(self.pieces))
        left -= 1
        if left < 0:
            text = self.pieces[right][0]
            return self.merged(text)[0] == [text]
        edges, more = self.edges[left], self.edges[right]
        if edges is None or more is None:
            left, right = self.pieces[left][0], self.pieces[right][0]
            return self.merged(left + right)[0] == [left, right]
        ends, starts = edges[1], more[0]
        i = j = 0
        while True:
            joined = self.score.get(ends[i][1] + starts[j][1], -np.inf)
            inside_left = ends[i + 1][0] if i + 1 < len(ends) else -np.inf
            inside_right = starts[j + 1][0] if j + 1 < len(starts) else -np.inf
            if joined > inside_left and joined >= inside_right and joined > -np.inf:
                return False
            if inside_left == inside_right == -np.inf:
                return True
            if inside_left >= inside_right:
                i += 1
            else:
                j += 1

    def normalise(self, text: str) -> str:
        text = text.replace(" ", MARK)
        return MARK + text if text and self.dummy_prefix else text

    def shortest(self, text: str) -> list[int]:
        """The ids on the shortest path of the composition with ``text``.

        A place needs one state only: the least weight of a path to it, and
        that path's last piece.  For a merge model this is so because no two
        paths of finite weight reach a place (a text has one encoding).
        """
        merges, follows, trie, pieces, n = self.model == MERGES, self.follows, self.trie, self.pieces, len(text)
        never, n_pieces = float("inf"), len(self.pieces)
        weight, last, back, ids = [never] * (n + 1), [-1] * (n + 1), [0] * (n + 1), [()] * (n + 1)
        weight[0] = 0.0
        for i in range(n):
            here = weight[i]
            if here == never:
                continue
            node, j, before = trie.get(text[i]), i + 1, (last[i] + 1) * n_pieces
            if node is None or node[0] is None:
                if here + FALLBACK < weight[j]:
                    raw = [self.byte_id.get(b) for b in text[i].encode()]
                    weight[j], last[j], back[j] = here + FALLBACK, -1, i
                    ids[j] = (self.unknown,) if None in raw else tuple(raw)
            while node is not None:
                piece, nodes = node
                if piece is not None:
                    cost = here if merges else here - pieces[piece][1]
                    if cost < weight[j] and (not merges or follows[before + piece]):
                        weight[j], last[j], back[j], ids[j] = cost, piece, i, (piece,)
                if j == n:
                    break
                node = nodes.get(text[j])
                j += 1
        out, at = [], n
        while at:
            out.append(ids[at])
            at = back[at]
        return [i for x in reversed(out) for i in x]

    def weightless(self, text: str) -> list[int] | None:
        """For a merge model: the ids on the path of weight 0, so the shortest,
        or None if every path has a character that falls back to bytes.

        Depth first over the arcs of ``shortest``.  A place has one state there
        too, so one from which no arc led on is never entered again.
        """
        follows, trie, length, n_pieces, n = self.follows, self.trie, self.length, len(self.pieces), len(text)
        at, before, path, tried, dead = 0, 0, [], [], set()
        while at < n:
            nodes, arcs = trie, []
            for c in text[at:] if at else text:
                node = nodes.get(c)
                if node is None:
                    break
                piece, nodes = node
                if piece is not None:
                    arcs.append(piece)
            while True:
                if not arcs:
                    if not path:
                        return None
                    dead.add(at)
                    at, before, arcs = tried.pop()
                    path.pop()
                    continue
                piece = arcs.pop()
                j = at + length[piece]
                if j not in dead and follows[before + piece]:
                    break
            tried.append((at, before, arcs))
            path.append(piece)
            at, before = j, (piece + 1) * n_pieces
        return path

    def _encode_cut(self, text: str) -> bytes:
        ids = self.weightless(text) if self.model == MERGES else None
        if ids is None:
            ids = self.shortest(text)
        return pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        """The ids of a text, four bytes each."""
        return b"".join(map(self.remembered.__getitem__, self.cut(self.normalise(text))))

    def forget(self) -> None:
        """Drops cuts and pairs of pieces."""
        self.remembered.forget()
        self.follows.forget()

    def decode(self, ids: bytes) -> str:
        text = b"".join(map(self.written.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")
        text = text.replace(MARK, " ")
        return text[1:] if self.dummy_prefix and text[:1] == " " else text


@functools.lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    """One for each worker process.  What it remembers goes when a task ends: the process may decode in its next one, and
    another process, with what that remembers, encode."""
    return Transducer.from_file(path)


def with_column(batches: Iterator[pa.RecordBatch], name: str, at: int, make, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """``batches`` with one more column: what ``make`` returns for the values of column ``at``.

    A few hundred rows at a time, whatever the engine's batches hold: what is made for the rest of a
    batch neither waits in the worker nor goes to the engine as one block.
    """
    for whole in batches:
        for start in range(0, whole.num_rows, ROWS):
            batch = whole.slice(start, ROWS)
            made = pa.array([make(x.as_py()) for x in batch.column(at)], kind)
            yield pa.RecordBatch.from_arrays([*batch.columns, made], [*batch.schema.names, name])


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, text, ids (binary, four bytes each,
    little-endian).  A null or empty text has no ids."""
    python_ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(path)
        try:
            yield from with_column(batches, "ids", 1, t.encode, pa.binary())
        finally:
            t.forget()

    return project(docs, id_col, text_col).mapInArrow(run, "doc_id long, text string, ids binary")


def decode_ids(rows: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """``rows`` with the column ``decoded``: the text of their ids."""
    python_ready(rows.sparkSession)
    at = rows.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = transducer(path).decode
        return with_column(batches, "decoded", at, lambda ids: decode(ids or b""), pa.string())

    return rows.mapInArrow(run, rows.withColumn("decoded", F.lit("").cast("string")).schema)

