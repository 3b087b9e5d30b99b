"""Whole texts through the tokenizers library, a piece at a time.

A text is cut only where the tokenizer's own pre-tokenizer always begins a new word, so the tokens of the pieces in
order are the tokens of the text. Equal pieces are encoded once per worker: their results are kept in a bounded table.
"""

from __future__ import annotations

import json
import os

import numpy as np

from boxlake.llm.common import FOLDED, PLAIN, kept, span_hashes, word_spans

#: Pieces that a worker keeps; beyond it the table starts anew.
KEPT_PIECES = 1_500_000
TABLE = 1 << 22
PLACES = np.uint64(TABLE - 1)
#: Text bytes of one call of the library.
CALL_BYTES = 1 << 18

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_STOP = np.zeros(256, bool)
_STOP[[0x2C, 0x2E]] = True
#: Everything that some rule calls white space, and the lead bytes of characters of which some are.
_BLANK = np.zeros(256, bool)
_BLANK[[*range(0x09, 0x0E), *range(0x1C, 0x21), 0xC2, 0xE1, 0xE2, 0xE3]] = True
_DROPPED = np.zeros(256, bool)
_DROPPED[[0x20, 0x09, 0x0A, 0x0D]] = True


def _stop_cuts(buf: np.ndarray) -> np.ndarray:
    cut = np.zeros(len(buf), bool)
    cut[1:] = _STOP[buf[1:]] & _LETTER[buf[:-1]]
    return cut


def byte_level_spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces for the byte-level pattern; they cover the text.

    Cuts: before a single space and around a single line feed that stand between characters that are surely no white
    space, and between an ASCII letter and a full stop or comma.
    """
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = _stop_cuts(buf)
    gap = np.flatnonzero((buf == 0x20) | (buf == 0x0A))
    gap = gap[(gap > 0) & (gap < n - 1)]
    before = buf[gap - 1]
    unsafe = _BLANK[before] | _BLANK[buf[gap + 1]]
    high = before >= 0x80
    lead2, lead3 = buf[np.maximum(gap - 2, 0)], buf[np.maximum(gap - 3, 0)]
    unsafe |= high & ((lead2 == 0xC2) | ((lead3 >= 0xE1) & (lead3 <= 0xE3)))
    gap = gap[~unsafe]
    inner = np.zeros(n + 1, bool)
    inner[offsets] = True
    gap = gap[~inner[gap] & ~inner[gap + 1]]
    cut[gap] = True
    cut[gap[buf[gap] == 0x0A] + 1] = True
    cut[offsets[:-1][offsets[:-1] < n]] = True
    starts = np.flatnonzero(cut)
    return starts, np.r_[starts[1:], n]


def word_level_spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces for a tokenizer that drops white space: runs without it, cut between a letter and a full stop or comma."""
    return word_spans(buf, offsets, _DROPPED, _stop_cuts(buf))


class Pieces:
    """Token ids (or only counts) of pieces, by hash, in a table with two places for each hash.

    A piece that finds both its places taken replaces the older entry, and is only encoded anew if it loses its own.
    """

    def __init__(self, path: str, fold: bool, want_ids: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.fold, self.want_ids = fold, want_ids
        model = json.loads(self.tokenizer.to_str())["model"]
        vocabulary, suffix = self.tokenizer.get_vocab(), model.get("end_of_word_suffix")
        #: Tokens that end a word (word-end models) or begin one that follows a space (byte-level models): runs of
        #: letters can then share a call, and these tokens tell them apart.
        self.marks = np.zeros(max(vocabulary.values()) + 1, bool)
        self.at_end = bool(suffix and fold)
        if self.at_end or not fold:
            self.marks[[i for t, i in vocabulary.items() if (t.endswith(suffix) if self.at_end else t.startswith("\u0120"))]] = True
        self.reset()

    def reset(self) -> None:
        self.keys, self.slots, self.free = np.zeros(TABLE, np.uint64), np.zeros(TABLE, np.int32), 0
        self.lengths, self.first, self.ids = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.uint16 if self.tokenizer.get_vocab_size() < 65536 else np.uint32)

    def find(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The slot of each piece; unseen ones are encoded first."""
        special = self.fold and b"<|" in buf.tobytes()  # letter case matters to special strings
        h = span_hashes(buf, starts, ends, FOLDED if self.fold and not special else PLAIN)
        if special:
            h = ~h
        h |= np.uint64(1)  # 0 is an empty place
        if self.free > KEPT_PIECES:
            self.reset()
        one, two = (h >> np.uint64(40)) & PLACES, (h >> np.uint64(16)) & PLACES
        found = self.keys[one] == h
        out = self.slots[one]
        rest = np.flatnonzero(~found)
        second = self.keys[two[rest]] == h[rest]
        out[rest[second]] = self.slots[two[rest[second]]]
        rest = rest[~second]
        if len(rest):
            unique, at, back = np.unique(h[rest], return_index=True, return_inverse=True)
            at = rest[at]
            self._encode(buf, starts[at], ends[at])
            fresh = np.arange(self.free, self.free + len(unique), dtype=np.int32)
            self.free += len(unique)
            place = np.where(self.keys[one[at]] == 0, one[at], two[at])
            self.keys[place], self.slots[place] = unique, fresh
            out[rest] = fresh[back]
        return out

    def _encode(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        whole, n = buf.tobytes(), ends - starts
        lengths = np.zeros(len(starts), np.int32)
        letters = np.concatenate(([0], np.cumsum(_LETTER[buf])))
        plain = letters[ends] - letters[starts] == n - (not self.at_end)
        if not self.at_end:
            plain &= (buf[starts] == 0x20) & (n > 1)
        parts = []
        for kind in (plain, ~plain):
            of = np.flatnonzero(kind)
            bounds, a = np.cumsum(n[of]), 0
            while a < len(of):  # calls balanced by bytes
                z = max(a + 1, int(np.searchsorted(bounds, (bounds[a - 1] if a else 0) + CALL_BYTES, "right")))
                some = [whole[i:j].decode("utf-8", "replace") for i, j in zip(starts[of[a:z]].tolist(), ends[of[a:z]].tolist(), strict=True)]
                parts.append((of[a:z], *self._call(some, kind is plain)))
                lengths[of[a:z]] = parts[-1][1]
                a = z
        if self.want_ids:
            first = np.zeros(len(starts), np.int64)
            base = len(self.ids)
            for of, k, _ in parts:
                first[of] = base + np.cumsum(k) - k
                base += int(k.sum())
            self.first = np.r_[self.first, first]
            self.ids = np.concatenate([self.ids, *(x for _, _, x in parts)])
        self.lengths = np.r_[self.lengths, lengths]

    def _call(self, texts: list[str], joined: bool) -> tuple[np.ndarray, np.ndarray | None]:
        """Lengths and ids of the texts, from one call of the library."""
        if joined:
            ids = np.array(self.tokenizer.encode_batch_fast([(" " if self.at_end else "").join(texts)], add_special_tokens=False)[0].ids, self.ids.dtype)
            mark = np.flatnonzero(self.marks[ids])
            if len(mark) == len(texts):
                return (np.diff(mark, prepend=-1) if self.at_end else np.diff(mark, append=len(ids))), ids
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        if not self.want_ids:
            return np.fromiter(map(len, found), np.int64, len(found)), None
        some = [x.ids for x in found]
        return np.fromiter(map(len, some), np.int64, len(some)), np.fromiter((i for x in some for i in x), self.ids.dtype)

    def expand(self, slots: np.ndarray) -> np.ndarray:
        """The token ids of the pieces, one after another."""
        n = self.lengths[slots]
        ends = np.cumsum(n, dtype=np.int64)
        return self.ids[np.repeat(self.first[slots] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]


#: The kind of tasks whose workers keep tables of pieces.
KIND = "pieces"


def pieces(path: str, fold: bool, want_ids: bool) -> Pieces:
    """This worker's table for a tokenizer file."""
    key, tables = (path, fold, want_ids), kept(KIND)
    if key not in tables:
        tables[key] = Pieces(path, fold, want_ids)
    return tables[key]


def text_sums(values: np.ndarray, starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of per-piece values by text."""
    total = np.r_[0, np.cumsum(values, dtype=np.int64)]
    at = np.searchsorted(starts, offsets)
    return total[at[1:]] - total[at[:-1]]
