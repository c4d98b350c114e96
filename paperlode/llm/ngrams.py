"""Hashed character n-grams of many texts at a time, for the classifiers of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_MULTIPLIERS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1, 0xD3A2646D, 0xFD7046C5, 0xB55A4F09)
#: Code points that are hashed at a time; a longer text goes in pieces that overlap by an n-gram less one.
PIECE = 1 << 19


def gram_hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """32-bit hashes of codes[i : i + n]; the last n - 1 places don't count."""
    with np.errstate(over="ignore"):
        out = codes * np.uint32(_MULTIPLIERS[0])
        for k in range(1, n):
            out ^= out >> np.uint32(15)
            out *= np.uint32(_MULTIPLIERS[k])
            out[: len(out) - k] += codes[k:]
        out ^= out >> np.uint32(16)
        out *= np.uint32(0x7FEB352D)
        out ^= out >> np.uint32(15)
        return out + np.uint32(n * 0x632BE5AB & 0xFFFFFFFF)


def grams(texts: list[str], orders: tuple[int, ...]) -> Iterator[tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]]:
    """Blocks (owners, begins, hashes) of the n-grams of the lower-cased texts, a blank before and after each.

    A block has pieces of texts, about PIECE code points of all; owners has the text of each piece, hashes the
    n-gram hashes of each order, begins for each order where the n-grams of a piece begin (and the last
    end) after those that reach over a piece's end are taken out. Every n-gram of a text is in just one piece."""
    reach, held, size = max(orders) - 1, [], 0

    def block(pieces: list[tuple[int, str, int]]):
        codes = np.frombuffer("".join(p for _, p, _ in pieces).encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.fromiter((len(p) for _, p, _ in pieces), np.int64, len(pieces))
        most = np.fromiter((m for _, _, m in pieces), np.int64, len(pieces))
        starts = np.cumsum(lengths) - lengths
        begins, hashes = [], []
        for n in orders:
            counts = np.minimum(most, np.maximum(0, lengths - n + 1))
            inside = np.zeros(len(codes) + 1, np.int8)
            some = counts > 0
            inside[starts[some]] += 1
            inside[(starts + counts)[some]] -= 1
            hashes.append(gram_hashes(codes, n)[np.cumsum(inside[:-1], dtype=np.int8) > 0])
            begins.append(np.concatenate([[0], np.cumsum(counts)]))
        return np.fromiter((i for i, _, _ in pieces), np.int64, len(pieces)), begins, hashes

    for i, text in enumerate(texts):
        text = f" {text.lower()} "
        for s in range(0, max(1, len(text) - reach), PIECE):
            last = s + PIECE + reach >= len(text)
            piece = text[s : s + PIECE + reach]
            held.append((i, piece, len(piece) if last else PIECE))
            size += len(piece)
            if size >= PIECE:
                yield block(held)
                held, size = [], 0
    if held:
        yield block(held)
