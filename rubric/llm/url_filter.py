"""URL filters: glob rules simulated together by a bit-parallel automaton.

Each rule is a glob over the canonical URL (host in lower case, then path):
``**`` stands for any characters, ``*`` for any without a slash.  A glob of
m literal characters gets m + 1 neighbouring bits, one for each number of
literals matched so far; the bits of all globs are packed into 64-bit words.
One character moves all states of all globs at once (Shift-And):

    S = ((S << 1) & follows[c]) | (S & stays[c])

with a carry from word to word.  A batch of URLs steps through its
characters together, longest URLs first, so that a step touches those that
have a character left.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rows import lower_ascii, python_ready

#: URLs that step through the automaton together.
ROWS = 4096


@dataclass(frozen=True)
class Rule:
    """``globs``: the rule fits if any of them does; of the rules that fit
    the one with the longest name decides, the first of those as long."""

    name: str
    verdict: str
    globs: tuple[str, ...]


def site_rule(verdict: str, name: str) -> Rule:
    """``host/path``: the host and all its subdomains, paths that start so."""
    return Rule(name, verdict, (f"{name}**", f"*.{name}**"))


def glob_parts(glob: str) -> tuple[str, dict[int, str]]:
    """The literals of a glob, and the wildcard after each number of them
    (``**`` swallows ``*`` beside it)."""
    literals, wild, i = "", {}, 0
    while i < len(glob):
        if glob[i] == "*":
            n = len(glob[i:]) - len(glob[i:].lstrip("*"))
            kind = "**" if n > 1 else "*"
            wild[len(literals)] = max(kind, wild.get(len(literals), ""))
            i += n
        else:
            literals += glob[i]
            i += 1
    return literals, wild


class Automaton:
    """The masks of a list of rules."""

    def __init__(self, rules: list[Rule]):
        self.rules = sorted(rules, key=lambda r: -len(r.name))
        globs = [(k, *glob_parts(g)) for k, r in enumerate(self.rules) for g in r.globs]
        codes = sorted({ord(c) for _, literals, _ in globs for c in literals} | {ord("/")})
        #: Code point -> class; 0 for characters that no glob names.
        self.classes = np.zeros(0x110000, np.uint16)
        self.classes[codes] = np.arange(1, len(codes) + 1)
        n_bits = sum(len(literals) + 1 for _, literals, _ in globs)
        self.words = n_bits // 64 + 1
        follows = np.zeros((len(codes) + 1, self.words), np.uint64)
        stays, start, ends, bit = follows.copy(), np.zeros(self.words, np.uint64), [], 0
        slash = self.classes[ord("/")]

        def put(mask: np.ndarray, at: int) -> None:
            mask[..., at // 64] |= np.uint64(1 << (at % 64))

        for rule, literals, wild in globs:
            put(start, bit)
            for k, c in enumerate(literals):
                put(follows[self.classes[ord(c)]], bit + k + 1)
            for k, kind in wild.items():
                loops = np.ones(len(codes) + 1, bool)
                loops[slash] = kind == "**"
                stays[loops, (bit + k) // 64] |= np.uint64(1 << ((bit + k) % 64))
            ends.append((rule, bit + len(literals)))
            bit += len(literals) + 1
        self.follows, self.stays, self.start, self.ends = follows, stays, start, ends

    def first_fit(self, urls: list[str]) -> np.ndarray:
        """For each URL the number of the deciding rule in ``rules``, else -1."""
        out = np.full(len(urls), -1, np.int64)
        for at in range(0, len(urls), ROWS):
            out[at:at + ROWS] = self._first_fit(urls[at:at + ROWS])
        return out

    def _first_fit(self, urls: list[str]) -> np.ndarray:
        lengths = np.fromiter(map(len, urls), np.int64, len(urls))
        order = np.argsort(-lengths, kind="stable")
        chars = self.classes[np.frombuffer("".join(urls).encode("utf-32-le"), np.uint32)]
        firsts = (np.cumsum(lengths) - lengths)[order]
        falling = -lengths[order]
        state = np.tile(self.start, (len(urls), 1))
        for t in range(int(lengths.max(initial=0))):
            n = int(np.searchsorted(falling, -t))  # those longer than t
            now, c = state[:n], chars[firsts[:n] + t]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[:n] = (moved & self.follows[c]) | (now & self.stays[c])
        best = np.full(len(urls), len(self.rules), np.int64)
        for rule, bit in self.ends:
            fits = (state[:, bit // 64] >> np.uint64(bit % 64)) & np.uint64(1) > 0
            best[fits] = np.minimum(best[fits], rule)
        found = np.empty_like(best)
        found[order] = np.where(best < len(self.rules), best, -1)
        return found


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) after the first ``://`` up to ``/``, ``?``,
    ``#`` or the end; path from there up to ``?``, ``#`` or the end.  Both
    empty for a null url or one without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    pattern = r"^([^/?#]*)([^?#]*)"
    return lower_ascii(F.regexp_extract(rest, pattern, 1)), F.regexp_extract(rest, pattern, 2)


def matcher(rules: list[Rule], more: list[Rule], default: str):
    """A function of Arrow batches (page_id, host, path) that yields (page_id, host, path, rule, verdict)."""

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, other = Automaton(rules), Automaton(more)
        for batch in batches:
            urls = [h + p for h, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            fits, falls = own.first_fit(urls), other.first_fit(urls)
            names = [own.rules[k].name if k >= 0 else None for k in fits]
            verdicts = [own.rules[k].verdict if k >= 0 else other.rules[m].verdict if m >= 0 else default
                        for k, m in zip(fits, falls)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names, pa.string()), pa.array(verdicts, pa.string())],
                ["page_id", "host", "path", "rule", "verdict"])

    return match


def judge_urls(pages: DataFrame, rules: list[Rule], more: list[Rule] = (), default: str = "allow",
               id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict.

    ``rules`` come first and name the row's ``rule``; where none fits, the
    verdict is that of ``more``, else ``default``.  A url without a host is
    judged as an empty one.  No shuffle.
    """
    python_ready(pages.sparkSession)
    host, path = host_and_path(pages[url_col])
    rows = pages.select(pages[id_col].cast("long").alias("page_id"),
                        F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))
    return rows.mapInArrow(matcher(list(rules), list(more), default),
                           "page_id long, host string, path string, rule string, verdict string")
