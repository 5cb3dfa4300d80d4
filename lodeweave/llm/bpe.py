"""Exact, memoised encoding of Arrow text columns with the ``tokenizers`` library.

Both public vocabularies cut a text into pre-tokens before any merge is made,
and no pre-token holds a break between two ordinary words. So a text's ids are
the ids of its space-separated pieces, one after the other. Arrow splits a batch
and numbers its distinct pieces, the library encodes each distinct piece once,
and numpy gathers the ids of every text. Texts whose spacing could join two
pieces (runs of blanks, tabs, other white space), and texts that hold the string
of a special token, go to the library whole, which gives that token's id.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space other than the blank and the line feed.
_ODD = "[\t\x0b\x0c\r\x1c-\x1f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: Punctuation that, behind letters, is a pre-token of its own.
_MARKS = ".,;:!?#$%&*()-"


class PieceEncoder:
    """Encodes text batches; ``spaced`` says that a blank belongs to the word after it.

    ``spaced`` is true for byte-level vocabularies and false for those that drop
    white space. ``memo_entries`` bounds the pieces remembered between batches
    (about 150 bytes each); it changes speed only.
    """

    def __init__(self, path: str, spaced: bool, memo_entries: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.plain = Tokenizer.from_file(path)
        self.spaced = spaced
        special = [(t.content, i) for i, t in self.plain.get_added_tokens_decoder().items() if t.special]
        self.mark, self.mark_id = special[-1]
        self.special = [content.lower() for content, _ in special]
        normalizer = self.plain.normalizer
        self.lowers = normalizer is not None and normalizer.normalize_str("AZ") == "az"
        self.running = self.plain
        plan = json.loads(self.plain.to_str())
        if plan["normalizer"] is not None:  # for text that is its own normal form
            plan["normalizer"] = None
            self.running = Tokenizer.from_str(json.dumps(plan))
        vocabulary = self.plain.get_vocab()
        self.bounds = np.zeros(max(vocabulary.values()) + 1, bool)
        self.bounds[[i for t, i in vocabulary.items() if (t.startswith("\u0120") if spaced else t.endswith("</w>"))]] = True
        self.memo: dict[str, int] = {}  # piece -> its place among the remembered pieces
        self.pool, self.size = np.empty(0, np.uint32), np.empty(0, np.int64)
        self.memo_entries = memo_entries

    def _encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A pool of ids, and where in it each piece's ids begin and how many they are.

        Pieces not met before go to the library as one text with a special token between.
        """
        place = np.array(list(map(self.memo.get, pieces, repeat(-1))), np.int64)
        missing = np.flatnonzero(place < 0).tolist()
        new = [pieces[i] for i in missing]
        turns = self._turns(new)
        order = np.argsort(turns == 0, kind="stable")  # those with known turns first
        known_turns = int(np.count_nonzero(turns))
        missing = [missing[i] for i in order.tolist()]
        new = [new[i] for i in order.tolist()]
        turns = turns[order]
        flat, sizes = [], []
        for low, high in ((0, known_turns), (known_turns, len(new))):
            for at in range(low, high, 4096):
                part = new[at : min(at + 4096, high)]
                ids, size = (self._by_turns(part, turns[at : at + len(part)]) if low < known_turns else None) or self._by_marks(part)
                flat.append(ids)
                sizes.append(size)
        size = np.concatenate([self.size, *sizes])
        pool = np.concatenate([self.pool, *flat])
        begin = np.cumsum(size) - size
        known = len(self.size)
        place[missing] = np.arange(known, known + len(missing))
        keep = max(0, min(self.memo_entries - known, len(missing)))
        if keep:
            self.memo.update(zip(new[:keep], range(known, known + keep)))
            self.size = size[: known + keep]
            self.pool = pool[: self.size.sum()].copy()
        return pool, begin[place], size[place]

    def _turns(self, pieces: list[str]) -> np.ndarray:
        """Tokens that bound a pre-token which each piece has for certain; 0 where that takes the library to say.

        With blanks kept, such tokens begin with one, and a piece that begins with
        a blank and holds no other white space has one. With blanks dropped, they
        end a pre-token: one for letters, two for letters and then punctuation.
        """
        if self.spaced:
            return np.fromiter((p[0] == " " and p != " " and "<|" not in p and "\n" not in p for p in pieces), np.int64, len(pieces))
        out = np.zeros(len(pieces), np.int64)
        for i, p in enumerate(pieces):
            if not p.isascii() and (p != p.lower() or max(p) >= "\u0250"):
                continue  # the normalizer, which running text goes without, would have something to do
            if p.isalpha():
                out[i] = 1
            elif p[-1:] in _MARKS and p.rstrip(_MARKS).isalpha():
                out[i] = 2
        return out

    def _by_turns(self, pieces: list[str], turns: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids and sizes of pieces encoded as one running text, cut at the tokens that bound pre-tokens."""
        text = ("" if self.spaced else " ").join(pieces)
        ids = self._ids(self.running, text)
        at = np.flatnonzero(self.bounds[ids])
        if len(at) != turns.sum():
            return None
        if self.spaced:
            return ids, np.diff(at, append=len(ids))
        return ids, np.diff(at[np.cumsum(turns) - 1], prepend=-1)

    def _by_marks(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and sizes of pieces encoded as one text with a special token between."""
        text = self.mark.join(pieces)
        if text.count("<|") != len(pieces) - 1:  # a piece holds the text of a special token
            each = [self.encode_whole(p) for p in pieces]
            return np.concatenate(each), np.fromiter(map(len, each), np.int64, len(each))
        ids = self._ids(self.plain, text)
        ends = np.concatenate((np.flatnonzero(ids == self.mark_id), [len(ids)]))
        return ids[ids != self.mark_id], np.diff(ends, prepend=-1) - 1

    def encode_whole(self, text: str) -> np.ndarray:
        return self._ids(self.plain, text)

    @staticmethod
    def _ids(tokenizer, text: str) -> np.ndarray:
        return np.asarray(tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the batch, and the offsets of each text in them. A null text has no ids."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        if self.spaced:
            lines = pc.replace_substring(texts, "\n", " \n ")
        else:
            lines = pc.replace_substring(texts, "\n", " ")
            if self.lowers:  # the normalizer would, and fewer pieces differ
                lines = pc.ascii_lower(lines)
        parts = pc.split_pattern(lines, " ")
        starts = np.asarray(parts.offsets)
        starts = starts - starts[0]
        coded = parts.flatten().dictionary_encode()
        words, index = coded.dictionary.to_pylist(), np.asarray(coded.indices)
        n = len(texts)
        whole = np.zeros(n, bool)
        for content in self.special:  # in any case: pieces may be in lower case already
            whole |= np.asarray(pc.match_substring(lines, content, ignore_case=True))
        if whole.any() and not self.spaced:
            keep = ~np.repeat(whole, np.diff(starts))
            counts = np.where(whole, 0, np.diff(starts))
            index, starts = index[keep], np.concatenate(([0], np.cumsum(counts)))
            used, index = np.unique(index, return_inverse=True)
            words = [words[k] for k in used.tolist()]
        if self.spaced:
            bad = np.asarray(pc.or_(pc.match_substring_regex(coded.dictionary, _ODD), pc.equal(coded.dictionary, "")))
            rows = np.repeat(np.arange(n), np.diff(starts))
            whole[rows[bad[index]]] = True
            newline = np.asarray(pc.equal(coded.dictionary, "\n"))[index]
            blank = np.ones(len(index), bool)
            blank[starts[:-1][np.diff(starts) > 0]] = False
            blank[1:] &= ~newline[:-1]
            blank &= ~newline
            blank &= ~whole[rows]
            key = index.astype(np.int64) * 2 + blank
            key = key[~whole[rows]]
            seen = np.zeros(2 * len(words), bool)
            seen[key] = True
            used, index = np.flatnonzero(seen), (np.cumsum(seen) - 1)[key]
            words = [" " + words[k >> 1] if k & 1 else words[k >> 1] for k in used.tolist()]
            counts = np.diff(starts)
            counts[whole] = 0
            starts = np.concatenate(([0], np.cumsum(counts)))
        flat, begin, size = self._encode_pieces(words)
        each = size[index]
        ends = np.concatenate(([0], np.cumsum(each)))
        narrow = np.int32 if max(len(flat), int(ends[-1])) < 2**31 else np.int64
        out = flat[np.arange(ends[-1], dtype=narrow) + np.repeat((begin[index] - ends[:-1]).astype(narrow), each)] if len(index) else flat[:0]
        offsets = ends[starts]
        if whole.any():
            pieces, sizes = [], np.diff(offsets)
            for i in range(n):
                if whole[i]:
                    x = self.encode_whole(texts[i].as_py())
                    sizes[i] = len(x)
                else:
                    x = out[offsets[i] : offsets[i + 1]]
                pieces.append(x)
            out, offsets = np.concatenate(pieces), np.concatenate(([0], np.cumsum(sizes)))
        return out, offsets


def regrouped(batches: Iterator[pa.RecordBatch], rows: int = 4096, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``rows``, or ``size`` bytes: the more texts at once, the fewer pieces are looked up twice."""
    held: list[pa.RecordBatch] = []
    n = bytes_ = 0
    for batch in batches:
        held.append(batch)
        n, bytes_ = n + batch.num_rows, bytes_ + batch.nbytes
        if n >= rows or bytes_ >= size:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n, bytes_ = [], 0, 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


_ENCODERS: dict[tuple, PieceEncoder] = {}


def encoder(path: str, spaced: bool) -> PieceEncoder:
    """One encoder per Python worker and vocabulary."""
    if (path, spaced) not in _ENCODERS:
        _ENCODERS[path, spaced] = PieceEncoder(path, spaced)
    return _ENCODERS[path, spaced]


def forget() -> None:
    """Give up this worker's encoders; the next task makes new ones."""
    _ENCODERS.clear()
