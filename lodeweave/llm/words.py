"""Words of an Arrow text batch as numbers, for vectorised counting."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


class Words(NamedTuple):
    """Distinct words of a batch, each word's number in them, and each word's row."""

    distinct: list[str]
    index: np.ndarray
    rows: np.ndarray
    n_rows: int

    def per_row(self, weight: np.ndarray) -> np.ndarray:
        """Sum over each row of a weight per distinct word."""
        return np.bincount(self.rows, weights=weight[self.index], minlength=self.n_rows)

    def counts(self) -> np.ndarray:
        return np.bincount(self.rows, minlength=self.n_rows)


def words(texts: pa.Array, lower: bool = False) -> Words:
    """Split at the six ASCII blanks, A-Z in lower case if asked; null texts have no words."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    flat = pc.replace_substring_regex(texts, "[\t\n\x0b\x0c\r]", " ")
    if lower:  # of a fresh array: on a slice the kernel may read other bytes
        flat = pc.ascii_lower(flat)
    parts = pc.split_pattern(flat, " ")
    sizes = np.diff(np.asarray(parts.offsets))
    coded = parts.flatten().dictionary_encode()
    index, rows = np.asarray(coded.indices), np.repeat(np.arange(len(texts)), sizes)
    distinct = coded.dictionary.to_pylist()
    if "" in distinct:
        keep = index != distinct.index("")
        index, rows = index[keep], rows[keep]
    return Words(distinct, index.astype(np.int64), rows, len(texts))


def distinct_per_row(rows: np.ndarray, key: np.ndarray, n_rows: int) -> np.ndarray:
    """How many different keys each row has."""
    if not len(key):
        return np.zeros(n_rows, np.int64)
    order = np.lexsort((key, rows))
    r, k = rows[order], key[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (k[1:] != k[:-1])
    return np.bincount(r[new], minlength=n_rows)
