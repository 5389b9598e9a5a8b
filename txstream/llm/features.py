"""Hashed sparse features of whole texts: word n-grams, with the words' shapes, and character n-grams.

A word's code holds its hash and, in the low byte, its shape; so n-grams of hashes and of shapes come from one array.
Shapes and the sign of an immediately repeated word make patterns visible that no single word tells of. Character
n-grams are runs of code points, white space included.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

from .common import M1, M2, M3, WordHash, holds, mixed

_SHAPE = np.uint64(0xFF)


class ShapedWords(WordHash):
    """word (bytes) -> hash of the lower-cased word without its closing punctuation, with the shape in the low byte."""

    def value(self, word: bytes) -> int:
        core = word.rstrip(b".,;:!?\"')")
        return super().value(core.lower()) & ~0xFF | shape(word, core)


def shape(word: bytes, core: bytes) -> int:
    """Eight bits: letters' case, digits, marks inside and behind."""
    tail = word[len(core) :]
    marks = sum(c in b"#*$%&|<>~^=+_{}[]\\/@" for c in word)
    upper = core.isupper() and len(core) > 1
    return (
        upper
        | (not core[:1].islower() and core[:1].isalpha()) << 1
        | any(48 <= c <= 57 for c in core) << 2
        | (marks > 0) << 3
        | (marks > 1) << 4
        | (b"!" in tail or b"?" in tail) << 5
        | (len(tail) > 1) << 6
        | (not core or marks == len(core)) << 7
    )


def _counted(codes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    index, counts = np.unique((codes >> np.uint64(64 - bits)).astype(np.int32), return_counts=True)
    return index, counts


def word_ngrams(codes: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
    """Codes of words, pairs of words, shapes, pairs of shapes and repeated neighbours.

    ``before``: the code of the word before the first, where a text comes in pieces; none (an empty array) at its start.
    """
    if not len(codes):
        return codes
    shapes = codes & _SHAPE
    out = [mixed(codes * M1), mixed(shapes * M3 + M2)]
    run = codes if before is None or not len(before) else np.concatenate([before, codes])
    if len(run) > 1:
        a, b = run[:-1], run[1:]
        same = (a ^ b) < np.uint64(256)  # the same word, whatever its shape
        out += [mixed(mixed(a) * M2 + b), mixed(((a & _SHAPE) << np.uint64(9)) + ((b & _SHAPE) << np.uint64(1)) + same + M1)]
        out.append(mixed(same.astype(np.uint64) * M2 + M3))
    return np.concatenate(out)


def points(text: bytes) -> np.ndarray:
    """The code points of a text in UTF-8."""
    if text.isascii():
        return np.frombuffer(text, dtype=np.uint8).astype(np.uint64)
    return np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)


def char_ngrams(found: np.ndarray, size: int = 4) -> np.ndarray:
    """Codes of the runs of ``size`` characters, given as code points."""
    n = len(found) - size + 1
    if n < 1:
        return found[:0]
    code = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        code = code * M3 + found[k : k + n]
    return mixed((code + M3) * M2)


#: Longer texts are taken in pieces of about so many bytes, whose counts are added up: memory stays bounded. A piece ends
#: at white space, and what spans two pieces is counted with the second; so the pieces' size changes nothing.
PIECE = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def pieces(text: bytes) -> Iterator[bytes]:
    """The text in pieces of ``PIECE`` bytes and what is left of the word there."""
    at = 0
    while at < len(text):
        end = at + PIECE
        if end < len(text):
            space = _SPACE.search(text, end)
            end = space.start() if space else len(text)
        yield text[at:end]
        at = end


#: One cache for each Python process, as the functions of a module are shared by its tasks.
_words = ShapedWords()
#: It is kept under this name.
NAME = "features"
holds(NAME, _words.clear)


def vector(text: bytes | None, bits: int, chars: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Sorted feature indices and their values: logarithms of counts, of length 1. An empty text has none."""
    parts = []
    last, tail = np.zeros(0, np.uint64), np.zeros(0, np.uint64)  # the word and the characters before a piece
    for piece in pieces(text or b""):
        found = _words.of(piece.split())
        codes = word_ngrams(found, last)
        last = found[-1:] if len(found) else last
        if chars:
            run = np.concatenate([tail, points(piece)])
            codes = np.concatenate([codes, char_ngrams(run, chars)])
            tail = run[max(0, len(run) - chars + 1) :] if chars > 1 else run[:0]
        parts.append(_counted(codes, bits))
    if not parts:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    index, counts = parts[0]
    if len(parts) > 1:
        index, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        counts = np.bincount(at, weights=np.concatenate([p[1] for p in parts]))
    values = np.log1p(counts).astype(np.float32)
    return index, values / (np.sqrt(np.dot(values, values)) or 1)
