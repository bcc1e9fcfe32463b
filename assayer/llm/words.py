"""Words, tokens and n-grams of whole texts as 64-bit hashes, vectorised over the bytes of many texts.

A *word* is a run of ASCII letters and digits and of bytes from 0x80 in the lower-cased
UTF-8 text, so accents and other scripts count as letters. A *token* is a run of anything
but white space and control characters.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np

#: Characters hashed at once; longer texts are cut between words, so memory doesn't follow the text.
CHUNK = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_WORD = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])
_TOKEN = np.array([32 < b != 127 for b in range(256)])
_DIGIT = np.array([48 <= b < 58 for b in range(256)])


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """n powers of an odd base and of its inverse modulo 2**64."""
    with np.errstate(over="ignore"):
        return tuple(np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(n, b, np.uint64)))) for b in (_BASE, pow(_BASE, -1, 2**64)))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _parts(texts: list[str | None]) -> Iterator[tuple[list[str], list[int]]]:
    """Texts, about CHUNK characters at a time, with the index of each; a longer text is cut after white space, else anywhere."""
    held, at, size = [], [], 0
    for i, text in enumerate(texts):
        text = text or ""
        while len(text) > CHUNK:
            end = max(text.rfind(" ", CHUNK // 2, CHUNK), text.rfind("\n", CHUNK // 2, CHUNK)) + 1 or CHUNK
            yield [*held, text[:end]], [*at, i]
            held, at, size, text = [], [], 0, text[end:]
        held.append(text)
        at.append(i)
        size += len(text)
        if size > CHUNK:
            yield held, at
            held, at, size = [], [], 0
    if held:
        yield held, at


def _spans(raw: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate((np.zeros(1, np.int8), member[raw].view(np.int8), np.zeros(1, np.int8))))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _hash(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    up, down = _powers(max(4 * CHUNK, 1 << int(len(raw)).bit_length()))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)])))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def _joined(parts: list[str], at: list[int]) -> tuple[np.ndarray, Callable[[np.ndarray], np.ndarray]]:
    """The bytes of the parts with line breaks between, and the text index of a position."""
    raws = [p.encode("utf-8", "replace") for p in parts]
    ends = np.cumsum([len(r) + 1 for r in raws])
    index = np.array(at)
    return np.frombuffer(b"\n".join(raws), np.uint8), lambda start: index[np.searchsorted(ends, start, side="right")]


def words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(text index, word hash) of all words in order; none for null and wordless texts."""
    docs, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for parts, at in _parts(texts):
        raw, doc = _joined([p.lower() for p in parts], at)
        start, end = _spans(raw, _WORD)
        docs.append(doc(start))
        hashes.append(_hash(raw, start, end))
    return np.concatenate(docs), np.concatenate(hashes)


def tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text index, hash, shape) of all tokens in order.

    The hash ignores case. The shape has the case (none, some or all upper), the marks in
    the token in any order, and whether the token repeats the one before.
    """
    docs, hashes, shapes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    for parts, at in _parts(texts):
        (raw, doc), (small, _), (large, _) = (_joined([f(p) for p in parts], at) for f in (str, str.lower, str.upper))
        (start, end), low, up = (_spans(x, _TOKEN) for x in (raw, small, large))
        own, lower, upper = _hash(raw, start, end), _hash(small, *low), _hash(large, *up)
        value = np.where(_WORD[raw], np.uint64(0), mix(raw.astype(np.uint64) + np.uint64(1)))
        value[_DIGIT[raw]] = np.uint64(7)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value)))
        case = (own != lower).astype(np.uint64) + (own == upper) * (own != lower) * np.uint64(1)
        docs.append(doc(start))
        hashes.append(lower)
        shapes.append(mix(sums[end] - sums[start] + case))
    d, h, s = np.concatenate(docs), np.concatenate(hashes), np.concatenate(shapes)
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (d[1:] == d[:-1])
    return d, h, mix(s + again.astype(np.uint64))


def grams(doc: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(text index, hash) of all runs of n within a text."""
    if len(h) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    m = len(h) - n + 1
    out = np.full(m, np.uint64(n))
    for j in range(n):
        out = mix(out + h[j : j + m])
    inside = doc[:m] == doc[n - 1 :]
    return doc[:m][inside], out[inside]


def shingles(texts: list[str | None], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(text index, hash) of all runs of n words; a shorter text has one run of all its words, a wordless one none."""
    doc, h = words(texts)
    d, s = grams(doc, h, n)
    count = np.bincount(doc, minlength=len(texts))
    first = np.concatenate(([0], np.cumsum(count)))
    short = np.flatnonzero((count > 0) & (count < n))
    if not len(short):
        return d, s
    extra = []
    for i in short:
        out = np.full(1, np.uint64(count[i]))
        for w in h[first[i] : first[i + 1]]:
            out = mix(out + w)
        extra.append(out[0])
    d, s = np.concatenate([d, short]), np.concatenate([s, np.array(extra, np.uint64)])
    order = np.argsort(d, kind="stable")
    return d[order], s[order]
