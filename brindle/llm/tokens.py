"""Token ids with the tokenizers library, one piece at a time.

The byte-level tokenizer splits a text into pieces by a fixed pattern and encodes each piece by itself, so equal pieces
have equal ids. Many texts are split at once over their bytes, their distinct pieces are found by Arrow, and only pieces
that the bounded cache doesn't hold go through the library's model.
"""

from __future__ import annotations

import itertools
import os
import re

import numpy as np

from .common import ranges

#: fixed: the split pattern of the byte-level tokenizer (see the tokenizer folder's README)
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: pieces that stay cached; later new ones are encoded again each time (they are rare)
CACHE_PIECES = 1_000_000
#: ends a text; no byte of UTF-8
END = b"\xff"
#: texts that are not split over their bytes: letters beyond U+024F, number signs and rare white space
_UNUSUAL = re.compile("[\x1c-\x1f\x85\xa0\xb2\xb3\xb9\xbc-\xbe]|[^\x00-\u024f]").search
_LETTER, _DIGIT, _OTHER, _SPACE, _END = range(5)
_open: dict[str, "Encoder"] = {}


def _kinds() -> np.ndarray:
    kind = np.full(256, _OTHER, dtype=np.uint8)
    for letters in (b"AZ", b"az", b"\x80\xbf", b"\xc3\xc9"):  # the last two: U+00C0 to U+024F in two bytes
        kind[letters[0] : letters[1] + 1] = _LETTER
    kind[ord("0") : ord("9") + 1] = _DIGIT
    kind[[0x20, *range(0x09, 0x0E)]] = _SPACE
    kind[END[0]] = _END
    return kind


def _byte_letters() -> dict[int, str]:
    """The letter by which the model knows each byte: itself where it can be seen, else the next one from U+0100 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {b: chr(b) for b in seen} | {b: chr(0x100 + k) for k, b in enumerate(b for b in range(256) if b not in seen)}


_KIND, _LETTERS = _kinds(), _byte_letters()
_RARE = np.isin(np.arange(256), [*range(0x1C, 0x20), *range(0xCA, END[0])])


def _starts(raw: np.ndarray) -> np.ndarray:
    """Where the pattern's pieces start in the bytes of usual texts, each followed by END; END is a piece too."""
    kind = _KIND[raw]
    for lead, odd, is_odd, other in ((0xC2, (0xAA, 0xB5, 0xBA), _LETTER, _OTHER), (0xC3, (0x97, 0xB7), _OTHER, _LETTER)):
        at = np.flatnonzero(raw == lead)
        kind[at] = kind[at + 1] = np.where(np.isin(raw[at + 1], odd), is_odd, other)
    start = np.empty(len(raw), dtype=bool)
    start[0] = True
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    start |= kind == _END
    last = np.flatnonzero(start[1:] & (kind[:-1] == _SPACE) & (kind[1:] != _END))  # of white space before something else
    start[last] = True
    start[last + 1] = raw[last] != 0x20
    quote = np.flatnonzero((raw == ord("'")) & start)
    one, two = raw[quote + 1], raw[np.minimum(quote + 2, len(raw) - 1)]
    size = np.where(np.isin(one, list(b"stmd")), 2, 0)
    for a, b in (b"re", b"ve", b"ll"):
        size[(one == a) & (two == b)] = 3
    quote, size = quote[size > 0], size[size > 0]
    start[quote + 1] = False
    start[quote + size] = True
    return start


def _joined(texts) -> bytes:
    return b"".join(x for t in texts for x in (t.encode(), END))


def _usual(raw: np.ndarray) -> bool:
    """Whether no byte pair of all the texts is one that makes a text unusual."""
    two = {0xC2: (0x85, 0xA0, 0xB2, 0xB3, 0xB9, 0xBC, 0xBD, 0xBE), 0xC9: range(0x90, 0xC0)}
    return not _RARE[raw].any() and not any(np.isin(raw[np.flatnonzero(raw == lead) + 1], list(odd)).any() for lead, odd in two.items())


def _listed(pieces) -> list[bytes]:
    """The values of a binary array of its own, some times faster than by Arrow's scalars."""
    _, at, data = pieces.buffers()
    at, data = np.frombuffer(at, dtype=np.int32, count=len(pieces) + 1).tolist(), data.to_pybytes()
    return [data[i:j] for i, j in itertools.pairwise(at)]


class _Codes(dict):
    """Piece to number; a piece not met before gets the next one and is noted."""

    def __init__(self):
        self.new: list[bytes] = []

    def __missing__(self, piece: bytes) -> int:
        n = self[piece] = len(self)
        self.new.append(piece)
        return n


class Encoder:
    def __init__(self, path: str, most: int = CACHE_PIECES):
        import regex
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.model = Tokenizer.from_file(path).model
        self.exact = regex.compile(PATTERN).findall
        self.most = most
        self.code = _Codes()
        self.code[END] = 0  # has no ids
        self.size, self.at = np.zeros(1 << 16, dtype=np.int64), np.zeros(1 << 16, dtype=np.int64)
        self.flat, self.used = np.zeros(1 << 18, dtype=np.uint32), 0

    def _pieces(self, texts: list[str]):
        """All pieces in order, END after each text, as one Arrow array."""
        import pyarrow as pa

        def over_bytes(raw: bytes):
            at = np.append(np.flatnonzero(_starts(np.frombuffer(raw, dtype=np.uint8))), len(raw)).astype(np.int32)
            return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(raw)])

        raw = _joined(texts)
        if _usual(np.frombuffer(raw, dtype=np.uint8)):
            return over_bytes(raw)
        runs = itertools.groupby(texts, lambda t: bool(_UNUSUAL(t)))
        return pa.concat_arrays([pa.array([p for t in run for p in (*(x.encode() for x in self.exact(t)), END)], pa.binary()) if odd else over_bytes(_joined(run)) for odd, run in runs])

    def _learn(self, new: list[bytes]) -> None:
        """Ids of the pieces with the highest numbers, in their order."""
        while len(self.code) > len(self.size):
            self.size, self.at = (np.concatenate([x, np.zeros_like(x)]) for x in (self.size, self.at))
        tokenize = self.model.tokenize
        got = [[t.id for t in tokenize(p)] for p in END.join(new).decode("latin-1").translate(_LETTERS).split(_LETTERS[END[0]])]
        sizes = np.fromiter(map(len, got), dtype=np.int64, count=len(got))
        total, n = int(sizes.sum()), len(self.code) - len(new)
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.size[n : n + len(new)] = sizes
        self.at[n : n + len(new)] = self.used + np.cumsum(sizes) - sizes
        self.flat[self.used : self.used + total] = np.fromiter(itertools.chain.from_iterable(got), dtype=np.uint32, count=total)
        self.used += total

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts joined, bounds): text i has ids[bounds[i]:bounds[i + 1]]."""
        if not texts:
            return np.zeros(0, dtype=np.uint32), np.zeros(1, dtype=np.int64)
        known, used = self.code, self.used
        found = self._pieces(texts).dictionary_encode()
        distinct = _listed(found.dictionary)
        codes = np.fromiter(map(known.__getitem__, distinct), dtype=np.int64, count=len(distinct))[found.indices.to_numpy()]
        new, known.new = known.new, []
        if new:
            self._learn(new)
        sizes = self.size[codes]
        ids = self.flat[np.repeat(self.at[codes], sizes) + ranges(sizes)]
        bounds = np.append(0, np.cumsum(sizes)[codes == 0])
        if len(known) > self.most:
            for p in new:
                del known[p]
            self.used = used
        return ids, bounds


def encoder(path: str) -> Encoder:
    """One for each worker and file: workers are kept from task to task."""
    if path not in _open:
        _open[path] = Encoder(path)
    return _open[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def batches_of(texts: list[str], most: int = 1 << 21):
    """Runs (i, j) of texts of about ``most`` characters."""
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= most):
            size += len(texts[j])
            j += 1
        yield i, j
        i = j
