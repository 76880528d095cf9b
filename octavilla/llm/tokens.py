"""Token ids of whole texts by a public tokenizer, each distinct piece of text encoded once.

Both vocabularies split a text before they merge bytes, and a piece's ids depend on the piece
alone.  A text is cut at the same places here, and only pieces not seen before by this worker go
to the tokenizer; the rest are looked up.  The cut is written out for the characters whose class
no Unicode version changes; a text with any other character, or with the string of a special
token, goes to the tokenizer as a whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import held_by_worker

# Letters and numbers up to U+017F, and the split patterns of the two vocabularies.
_L = "A-Za-zªµºÀ-ÖØ-öø-ſ"
_N = "0-9²³¹¼½¾"
_BYTE_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^\s{_L}{_N}]+|\s+(?!\S)|\s+"
_WORD_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^\s{_L}{_N}]+"
_UNUSUAL = re.compile("[^\t\n\r -~¡-ſ]|İ")
_ODD_SPACES = "\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0"

#: Pieces a worker remembers.  When they are reached, those met only once are forgotten.
MOST_PIECES = 500_000
#: Longer pieces (no prose has them) are encoded each time and never kept.
LONGEST_PIECE = 64


def _usual(text: str) -> bool:
    """Whether the cut written out here holds for the text; quick tests first."""
    if not text.isascii():
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return not _UNUSUAL.search(text)
    return not any(c in text for c in _ODD_SPACES)


def _classes() -> tuple[np.ndarray, np.ndarray]:
    """The class of each byte below 128 and of each character below U+0180; UNKNOWN where the cut does not hold."""
    letter, number = (re.compile(f"[{c}]") for c in (_L, _N))
    of = np.full(0x180, UNKNOWN, np.uint8)
    for ch in map(chr, range(0x180)):
        if not _UNUSUAL.match(ch):
            of[ord(ch)] = LETTER if letter.match(ch) else NUMBER if number.match(ch) else BLANK if ch == " " else SPACE if ch.isspace() else OTHER
    return np.append(of[:0x80], np.full(0x80, UNKNOWN, np.uint8)), of


LETTER, NUMBER, OTHER, BLANK, SPACE, UNKNOWN = 1, 2, 3, 4, 5, 9
_BYTE_CLASS, _CHARACTER_CLASS = _classes()


def cut_bytes(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts of pieces in ``data``, texts that cannot be cut so): ``_BYTE_PATTERN`` on many texts at once.

    ``ends`` holds where texts begin and where the last one ends.  Starts in texts that cannot be
    cut mean nothing.
    """
    cls = _BYTE_CLASS[data]
    lead = np.flatnonzero((data >= 0xC2) & (data <= 0xC5))
    code = ((data[lead] & 0x1F).astype(np.int64) << 6) | (data[lead + 1] & 0x3F)
    cls[lead] = _CHARACTER_CLASS[code]
    inner = (data & 0xC0) == 0x80
    known = np.zeros(len(data) + 1, bool)
    known[lead + 1] = True
    unknown = np.flatnonzero(np.where(inner, ~known[:-1], cls == UNKNOWN))
    odd = np.unique(np.searchsorted(ends, unknown, side="right") - 1)
    at = np.flatnonzero(~inner).astype(np.int32)
    c, byte = cls[at], data[at]
    first = np.searchsorted(at, ends[:-1][ends[:-1] < ends[1:]])
    before, after = np.append(np.uint8(0), c[:-1]), np.append(c[1:], np.uint8(0))
    before[first] = 0
    after[first[first > 0] - 1] = 0
    space, space_before = c >= BLANK, before >= BLANK
    # a stretch of spaces is a piece but for its last one, which is a piece or begins the next word
    start = np.where(space, ~space_before | ((after > 0) & (after < BLANK)), (before != c) & (before != BLANK))
    # 's, 't, 'm, 'd, 're, 've and 'll where a piece would begin with the apostrophe
    mark = np.flatnonzero(start & (byte == 0x27))
    text = np.append(c, np.zeros(4, np.uint8))
    letters = np.append(byte, np.zeros(4, np.uint8))
    border = np.zeros(len(text), bool)
    border[first] = True
    one, two = letters[mark + 1], letters[mark + 2]
    size = np.where(np.isin(one, np.frombuffer(b"stmd", np.uint8)), 2, 0)
    size[((one == 0x72) | (one == 0x76)) & (two == 0x65) | (one == 0x6C) & (two == 0x6C)] = 3
    size[border[mark + 1] | (size == 3) & border[mark + 2]] = 0
    mark, size = mark[size > 0], size[size > 0]
    start[mark + 1] = False
    rest = mark + size
    rest = rest[(text[rest] == LETTER) & ~border[rest]]
    start[rest] = True
    return at[start], odd


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Codes(dict):
    """A number for each piece; a piece not seen before is encoded when it is asked for."""

    learn = None

    def __missing__(self, piece: str) -> int:
        return self.learn(piece)


class Encoder:
    """Ids of texts as the tokenizer gives them, ``end`` appended to each."""

    def __init__(self, file: str, end: int):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.lower = self.tokenizer.normalizer is not None
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.pattern = re.compile(_WORD_PATTERN if self.lower else _BYTE_PATTERN)
        self.letters, self.end = _byte_letters(), end
        self.codes = _Codes()
        self.codes.learn = self._learn
        self.long = False
        self._start([("", [end])])  # code 0 ends a text

    def _start(self, known: list[tuple[str, list[int]]]) -> None:
        self.codes.clear()
        self.new_ids: list[int] = []
        self.new_sizes: list[int] = []
        self.flat = np.zeros(0, np.int32)
        self.at = np.zeros((0, 2), np.int32)  # start in flat and length of each code
        self.again = np.zeros(0, bool)  # met in a later portion than the first
        for piece, ids in known:
            self.codes[piece] = len(self.codes)
            self.new_ids += ids
            self.new_sizes.append(len(ids))
        self.table = pa.array([b""], pa.binary())  # without lower case: pieces in the order of their codes
        self._settle()

    def _spell(self, piece: str) -> None:
        """The ids of a new piece."""
        spelled = piece if piece.isascii() else piece.encode().decode("latin-1")
        ids = [t.id for t in self.tokenizer.model.tokenize(spelled.translate(self.letters))]
        self.long |= len(piece) > LONGEST_PIECE
        self.new_ids += ids
        self.new_sizes.append(len(ids))

    def _learn(self, piece: str) -> int:
        self._spell(piece)
        code = self.codes[piece] = len(self.codes)
        return code

    def _settle(self) -> None:
        """Moves what a portion has taught into the arrays."""
        sizes = np.array(self.new_sizes, np.int64)
        starts = len(self.flat) + np.cumsum(sizes) - sizes
        self.at = np.concatenate([self.at, np.stack([starts, sizes], axis=1).astype(np.int32)])
        self.flat = np.concatenate([self.flat, np.array(self.new_ids, np.int32)])
        self.again = np.concatenate([self.again, np.zeros(len(sizes), bool)])
        self.new_ids, self.new_sizes = [], []

    def _forget(self) -> None:
        """Keeps the pieces met again, or none if nearly all were; long ones never."""
        if not self.lower:
            short = pc.less_equal(pc.binary_length(self.table), LONGEST_PIECE).to_numpy(zero_copy_only=False)
            keep = np.flatnonzero(self.again & short)[1:] if self.again[0] else np.flatnonzero(self.again & short)
            codes = np.append(0, keep if len(keep) <= MOST_PIECES * 0.9 else keep[:0])
            self.table = self.table.take(pa.array(codes))
            start, size = self.at[codes].T
            ends = np.cumsum(size)
            self.flat = self.flat[np.arange(ends[-1]) + np.repeat(start - (ends - size), size)]
            self.at = np.stack([ends - size, size], axis=1).astype(np.int32)
            self.again = np.zeros(len(codes), bool)
            return
        keep = [p for p, c in self.codes.items() if c and self.again[c] and len(p) <= LONGEST_PIECE]
        if len(keep) > MOST_PIECES * 0.9:
            keep = []
        codes = [0, *map(self.codes.__getitem__, keep)]
        self._start([(p, self.flat[self.at[c, 0]:self.at[c].sum()].tolist()) for p, c in zip(["", *keep], codes)])

    def _cut(self, text: str) -> list[str] | None:
        low = text.lower() if self.lower else text
        return None if not _usual(text) or any(s in low for s in self.special) else self.pattern.findall(low)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and the offset of each text's ids in them."""
        if not self.lower:
            data = [t.encode("utf-8", "surrogatepass") for t in texts]
            return self.encode_bytes(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
        cut = [self._cut(t) for t in texts]
        known = self._known()
        pieces = chain.from_iterable(chain(c or (), ("",)) for c in cut)
        codes = np.fromiter(map(self.codes.__getitem__, pieces), np.int64)
        ids, offsets = self._looked_up(codes, np.cumsum([len(c or ()) + 1 for c in cut], dtype=np.int64), known)
        return self._with_whole([t if c is None else None for t, c in zip(texts, cut)], ids, offsets)

    def encode_bytes(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for texts that lie one after the other in ``data``; for vocabularies without lower case only."""
        starts, odd = cut_bytes(data, ends)
        n = len(ends) - 1
        if self.special:
            whole = data.tobytes()
            for s in map(str.encode, self.special):
                at = whole.find(s)
                while at >= 0:
                    odd = np.append(odd, np.searchsorted(ends, at, side="right") - 1)
                    at = whole.find(s, at + 1)
        plain = np.ones(n, bool)
        plain[odd] = False
        text = np.searchsorted(ends, starts, side="right") - 1
        offsets = np.append(starts, len(data)).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        if len(odd):
            pieces, text = pieces.filter(pa.array(plain[text])), text[plain[text]]
        known = self._known()
        distinct = pieces.dictionary_encode()
        number = self._numbers(distinct.dictionary)
        codes = np.zeros(len(text) + n, np.int64)
        codes[np.arange(len(text)) + text] = number[distinct.indices.to_numpy()]
        count = np.bincount(text, minlength=n) + 1
        ids, offsets = self._looked_up(codes, np.cumsum(count), known)
        texts: list[str | None] = [None] * n
        for i in np.unique(odd).tolist():
            texts[i] = data[ends[i]:ends[i + 1]].tobytes().decode("utf-8", "surrogatepass")
        return self._with_whole(texts, ids, offsets)

    def _numbers(self, pieces: pa.Array) -> np.ndarray:
        """Codes of different pieces; only those not met before are looked at one by one."""
        number = pc.fill_null(pc.index_in(pieces, value_set=self.table), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = np.flatnonzero(number < 0)
        if len(new):
            fresh = pieces.take(pa.array(new))
            for piece in fresh.cast(pa.string()):
                self._spell(piece.as_py())
            number[new] = len(self.table) + np.arange(len(new))
            self.table = pa.concat_arrays([self.table, fresh])
        return number

    def encode_texts(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for any vocabulary."""
        if not self.lower:
            return self.encode_bytes(data, ends)
        return self.encode([data[a:b].tobytes().decode("utf-8", "surrogatepass") for a, b in zip(ends, ends[1:])])

    def _known(self) -> int:
        if len(self.at) > MOST_PIECES:
            self._forget()
        return len(self.at)

    def _looked_up(self, codes: np.ndarray, ends: np.ndarray, known: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the codes, and the offset of each text's; ``ends`` counts the codes up to each text's last."""
        self._settle()
        self.again[codes] = True
        self.again[known:] = False
        start, size = self.at.take(codes, axis=0).T
        at_code = np.cumsum(size, dtype=np.int32)
        at = np.arange(at_code[-1] if len(codes) else 0, dtype=np.int32)
        at += np.repeat(start - (at_code - size), size)
        ids = self.flat.take(at)
        offsets = np.concatenate([[0], at_code[ends - 1]]).astype(np.int64)
        if self.long:
            self.long = False
            self._forget()
        return ids, offsets

    def _with_whole(self, texts: list[str | None], ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Puts in the texts that the tokenizer must see as a whole."""
        if not any(t is not None for t in texts):
            return ids, offsets
        parts = [ids[a:b] for a, b in zip(offsets, offsets[1:])]
        for i, t in enumerate(texts):
            if t is not None:
                parts[i] = np.array([*self.tokenizer.encode(t, add_special_tokens=False).ids, self.end], np.int32)
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)


def encoder(file: str, end: int) -> Encoder:
    """The worker's encoder; what it has learnt serves its later tasks."""
    return held_by_worker((Encoder, file, end), lambda: Encoder(file, end))


def in_portions(texts: Iterable[str], characters: int = 1 << 20) -> Iterator[list[str]]:
    """Lists of texts of about so many characters, so that a batch of long texts is not cut all at once."""
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= characters:
            yield held
            held, size = [], 0
    if held:
        yield held
