"""Exact tokenisation of many whole texts with the tokenizers library.

The library's pre-tokenisers cut a text at places that can be told from the
bytes on either side: before white space, between an ASCII or Latin-1 letter and
an ASCII character that is none, and before a letter after punctuation (but not
after an apostrophe, for contractions) or after a line feed that follows no other
white space: of a run of white space before a letter the last one is a token by
itself, of a run that ends a unit it isn't.  A text is cut there into units, each
different unit is encoded once, and the ids of a text are those of its units.
Texts that hold the string of a special token go to the library whole."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .kernels import row_slices

_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
#: ASCII, no letter, no white space, no apostrophe and no control character.
_MARK = np.zeros(256, bool)
_MARK[0x21:0x7F] = True
_MARK &= ~_LETTER
_MARK[0x27] = False
_OTHER = np.zeros(256, bool)  # ASCII and no letter
_OTHER[:0x80] = True
_OTHER &= ~_LETTER
_OTHER[[*range(0x00, 0x09), *range(0x0E, 0x20), 0x7F]] = False


def _cuts(data: np.ndarray) -> np.ndarray:
    """Whether no token can cross from the byte before to each byte of `data`."""
    n = len(data)
    prev, cur = data[:-1], data[1:]
    latin = np.zeros(n, bool)  # last byte of U+00C0..U+00FF without the two signs
    latin[1:] = (prev == 0xC3) & (cur >= 0x80) & (cur != 0x97) & (cur != 0xB7)
    letter = _LETTER[data] | latin
    solid = _MARK[data] | letter | (data == 0x27)
    first = _LETTER[data]
    first[:-1] |= latin[1:]
    lone = prev == 0x0A  # a line feed right after what is no white space
    lone[1:] &= solid[:-2]
    lone[:1] = False
    cut = np.zeros(n, bool)
    cut[1:] = (solid[:-1] & _WHITE[cur]) | (letter[:-1] & _OTHER[cur]) | ((_MARK[prev] | lone) & first[1:])
    return cut


def unit_starts(data: np.ndarray, offsets: np.ndarray, step: int = 1 << 18) -> np.ndarray:
    """Where units start: at rows and at cuts that no token can cross.  A cut is told from
    the four bytes before it and the one after, so steps see those as well."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    cut = np.empty(n, bool)
    for lo in range(0, n, step):
        a = max(0, lo - 4)
        cut[lo : lo + step] = _cuts(data[a : lo + step + 1])[lo - a : lo - a + step]
    cut[offsets[:-1][offsets[:-1] < n]] = True
    return np.flatnonzero(cut)


#: A space and letters that no normaliser changes in number: such units stay apart when joined.
_PLAIN = "^ [A-Za-zÀ-ÖØ-öø-ÿ]+$"


class Encoder:
    """ids of whole texts; the encodings of units are kept between calls."""

    #: Units kept between calls; with more, only those of the block at hand stay.
    KEPT = 600_000
    #: Bytes of text whose units are told apart together, and that are put together at a time.
    BYTES, SLICE = 1 << 23, 1 << 20

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tok.get_added_tokens_decoder().values()]
        vocabulary = self.tok.get_vocab()
        #: Whether words end in a suffix or start with a space, and the ids that do so.
        self.by_end = any(t.endswith("</w>") for t in vocabulary)
        self.edge = np.zeros(max(vocabulary.values()) + 1, bool)
        self.edge[[i for t, i in vocabulary.items() if (t.endswith("</w>") if self.by_end else t.startswith("Ġ"))]] = True
        self.clear()

    def clear(self) -> None:
        self.units = pa.array([], pa.string())
        self.flat = np.zeros(0, np.uint32)
        self.at = np.zeros(1, np.int64)

    def _encode(self, units: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """ids of units one by one, and how many each has."""
        ids = [e.ids for e in self.tok.encode_batch_fast(units.to_pylist(), add_special_tokens=False)]
        lens = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter((i for x in ids for i in x), np.uint32, int(lens.sum())), lens

    def _joined(self, units: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The same of plain units, encoded as one text and told apart by the ids at their edges."""
        ids, lens = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for k in range(0, len(units), 1 << 16):
            part = units.slice(k, 1 << 16)
            got = np.array(self.tok.encode_batch_fast(["".join(part.to_pylist())], add_special_tokens=False)[0].ids, np.uint32)
            edge = np.flatnonzero(self.edge[got])
            n = np.diff(edge, prepend=-1) if self.by_end else np.diff(edge, append=len(got))
            if len(edge) != len(part) or int(n.sum()) != len(got):
                got, n = self._encode(part)
            ids.append(got)
            lens.append(n)
        return np.concatenate(ids), np.concatenate(lens)

    def _learn(self, units: pa.StringArray) -> None:
        plain = pc.match_substring_regex(units, _PLAIN)
        order = []
        for mask, encode in ((plain, self._joined), (pc.invert(plain), self._encode)):
            some = units.filter(mask)
            if len(some):
                ids, lens = encode(some)
                order.append(some)
                self.flat = np.concatenate([self.flat, ids])
                self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(lens)])
        self.units = pa.concat_arrays([self.units, *order])

    def rows(self, data: np.ndarray, offsets: np.ndarray):
        """Yields (first row, ids, id offsets of the rows) for runs of rows."""
        for i, j in row_slices(offsets, self.BYTES):
            part, off = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            raw = part.tobytes()
            odd = set()
            for s in self.special:
                p = raw.find(s)
                while p >= 0:
                    odd.add(int(np.searchsorted(off, p, "right")) - 1)
                    p = raw.find(s, p + 1)
            starts, slots = self._slots(part, off)
            row_units = np.searchsorted(starts, off)
            for a, b in row_slices(off, self.SLICE):
                ids, lens = self._ids(slots[row_units[a] : row_units[b]])
                at = np.concatenate([[0], np.cumsum(lens)])[row_units[a : b + 1] - row_units[a]]
                if any(a <= r < b for r in odd):
                    parts = [ids[at[r] : at[r + 1]] for r in range(b - a)]
                    for r in odd:
                        if a <= r < b:
                            parts[r - a] = np.array(self.tok.encode(raw[off[r] : off[r + 1]].decode(), add_special_tokens=False).ids, np.uint32)
                    ids, at = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])
                yield i + a, ids, at

    def _slots(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of units, and each one's place among those kept."""
        starts = unit_starts(data, off)
        if not len(starts):
            return starts, starts
        bounds = np.append(starts, len(data)).astype(np.int32)
        arr = pa.StringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data)))
        d = arr.dictionary_encode()
        units = d.dictionary
        known = pc.index_in(units, value_set=self.units)
        if known.null_count:
            if len(self.units) + known.null_count > self.KEPT:
                self.clear()
                self._learn(units)
            else:
                self._learn(units.filter(pc.is_null(known)))
            known = pc.index_in(units, value_set=self.units)
        return starts, known.to_numpy()[d.indices.to_numpy()]

    def _ids(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of units in a row, and how many each has."""
        lens = self.at[slots + 1] - self.at[slots]
        ends = np.cumsum(lens)
        if not len(ends):
            return np.zeros(0, np.uint32), lens
        return self.flat[np.repeat(self.at[slots] - (ends - lens), lens) + np.arange(int(ends[-1]))], lens


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each file and Python worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
