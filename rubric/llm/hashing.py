"""Hashes of the words of a batch of texts, with numpy over whole buffers."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text hashed at a time; what a step needs beside its result is some 60 times that.
CHUNK = 1 << 20
_ODD = 0x9E3779B97F4A7C15


def byte_table(chars: str, value: bool = True) -> np.ndarray:
    """True for the bytes of ``chars`` (ASCII)."""
    out = np.full(256, not value)
    out[list(chars.encode())] = value
    return out


#: The bytes that words are made of, by their two definitions.  Bytes over 127 belong to words.
ALNUM = byte_table("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") | (np.arange(256) > 127)
NOT_SPACE = byte_table(" \t\n\v\f\r", False)
#: A-Z to a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit numbers (a one-to-one map)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in one array, and where each begins (and the last ends)."""
    texts = texts.cast(pa.large_binary())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[ends[0]:ends[-1]], ends - ends[0]


def blocks(begins: np.ndarray, size: int = CHUNK, rows: int = 256) -> Iterator[tuple[int, int]]:
    """Ranges of texts: ``size`` bytes and ``rows`` texts at most, or one text."""
    first, n = 0, len(begins) - 1
    while first < n:
        end = int(np.searchsorted(begins, begins[first] + size, "right")) - 1
        end = min(max(end, first + 1), first + rows, n)
        yield first, end
        first = end


@dataclass
class Words:
    """``doc``: the text's number; ``hash``: 64 bits; ``prefixes``: of the
    first so many bytes, for each length asked for (words shorter than that
    have 0)."""

    doc: np.ndarray
    hash: np.ndarray
    prefixes: list[np.ndarray]


def _cuts(data: np.ndarray, inside: np.ndarray) -> Iterator[tuple[int, int]]:
    """Chunks of ``data`` that split no word."""
    at, n = 0, len(data)
    while at < n:
        end = min(at + CHUNK, n)
        while end < n and inside[end] and inside[end - 1]:
            gap = np.flatnonzero(~inside[end:end + CHUNK])
            end = end + int(gap[0]) if len(gap) else min(end + CHUNK, n)
        yield at, end
        at = end


def words(data: np.ndarray, begins: np.ndarray, alphabet: np.ndarray, prefixes: tuple[int, ...] = ()) -> Words:
    """The words of all texts in order: runs of bytes that ``alphabet`` has,
    A-Z lower-cased, never across two texts."""
    docs, hashes, starts_of = [], [], [[] for _ in prefixes]
    inside = alphabet[data]
    text_begins = np.zeros(len(data) + 1, bool)
    text_begins[begins] = True
    with np.errstate(over="ignore"):
        for at, end in _cuts(data, inside):
            here = inside[at:end]
            begin = here.copy()
            begin[1:] &= ~here[:-1] | text_begins[at + 1:end]
            where = np.flatnonzero(here)
            if not len(where):
                continue
            first = np.flatnonzero(begin[where])  # of each word, in ``where``
            length = np.diff(np.append(first, len(where)))
            place = np.arange(len(where)) - np.repeat(first, length)
            power = np.cumprod(np.full(int(length.max()), _ODD, np.uint64))
            value = (LOWER[data[at:end][where]].astype(np.uint64) + np.uint64(1)) * power[place]
            hashes.append(mix(np.add.reduceat(value, first) + length.astype(np.uint64)))
            docs.append(np.searchsorted(begins, at + where[first], "right") - 1)
            for k, out in zip(prefixes, starts_of):
                short = mix(np.add.reduceat(np.where(place < k, value, np.uint64(0)), first) + np.uint64(k << 32))
                out.append(np.where(length >= k, short, np.uint64(0)))
    if not docs:
        none = np.zeros(0, np.uint64)
        return Words(none.astype(np.int64), none, [none for _ in prefixes])
    return Words(np.concatenate(docs), np.concatenate(hashes), [np.concatenate(x) for x in starts_of])
