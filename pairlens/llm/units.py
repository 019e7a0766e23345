"""Batches of texts as codes of their distinct pieces, so that costly work is done once for each distinct piece of a batch."""

from __future__ import annotations

from collections.abc import Iterable
from itertools import chain

import numpy as np
import pandas as pd


def factorized(lists: Iterable[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code of each piece, place of its list, distinct pieces)."""
    lists = list(lists)
    counts = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
    flat = np.empty(int(counts.sum()), dtype=object)
    flat[:] = list(chain.from_iterable(lists))
    codes, distinct = pd.factorize(flat)
    return codes, np.repeat(np.arange(len(lists)), counts), np.asarray(distinct, dtype=object)


def code_points(pieces: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all pieces in a row, length of each)."""
    pieces = list(pieces)
    return np.frombuffer("".join(pieces).encode("utf-32-le", "surrogatepass"), dtype="<u4"), np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places starts[i] .. starts[i] + lengths[i] - 1 of each i, in a row."""
    total = int(lengths.sum())
    first = np.cumsum(lengths) - lengths
    return np.arange(total) + np.repeat(starts - first, lengths)
