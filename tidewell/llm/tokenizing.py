"""Token ids of whole texts, with word-level reuse.

The vocabulary splits at white space and then into letter, digit and symbol runs, and a text's
ids are those of its runs in a row.  A text of the Latin range and common punctuation is cut
into runs by one pattern scan; runs are numbered in a bounded table of the worker process, only
new ones are encoded, all of a slice in one call, and the ids of a slice are gathered by number.
Other texts are cut at white space first, and a chunk outside that range is encoded by the
tokenizer as it is.
"""

from __future__ import annotations

import re
import unicodedata
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

#: fixed value: the split pattern that the vocabulary file itself names is
#: 's|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+
#: characters below this bound never combine, so a text of them is in its composed form
LATIN_END = 0x250


def _latin(kind: str) -> str:
    """The members of a character class (L or N) below the bound and their lower-case forms, some
    of which lie above it, as a pattern's class body."""
    own = [c for c in map(chr, range(LATIN_END)) if unicodedata.category(c)[0] == kind]
    return "".join(sorted({*own, *[c.lower() for c in own if len(c.lower()) == 1]}))


#: that pattern for lower-case texts that ``OUTSIDE`` does not meet, for the faster scanner
LATIN_PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[%s]+|[%s]|[^\\s%s%s]+"
                         % (_latin("L"), _latin("N"), _latin("L"), _latin("N")), re.ASCII)
#: neither Latin nor plain punctuation (dashes, quotes, dots, currency signs); also the two other
#: spaces of that range and the capital whose lower-case form is two characters
OUTSIDE = re.compile("[^\x00-\u024f\u2010-\u2027\u2030-\u205e\u20a0-\u20bf]|[\x85\xa0\u0130]")
SPACE = re.compile("[ \\t-\\r]+")
#: a table that holds more runs or characters than this is started again
RUNS, CHARS = 300_000, 4_000_000


def default_vocabulary() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


def _outside(text: str) -> bool:
    """Whether ``OUTSIDE`` meets the text; one of single-byte characters needs no pattern."""
    if text.isascii():
        return False
    try:
        raw = text.encode("latin-1")
    except UnicodeEncodeError:
        return OUTSIDE.search(text) is not None
    return b"\x85" in raw or b"\xa0" in raw


class _Runs(dict):
    """Run → its number; ``new`` lists those without ids yet, in the order of their numbers."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, run: str) -> int:
        at = self[run] = len(self)
        self.new.append(run)
        return at


class Encoder:
    """``encode_many(texts)``: the ids of each as little-endian unsigned 32-bit bytes."""

    def __init__(self, vocabulary: bytes):
        self.tok = Tokenizer.from_buffer(vocabulary)
        self.tok.encode_special_tokens = True  # special strings in a text are ordinary text
        vocab = self.tok.get_vocab(with_added_tokens=False)
        self.last = np.zeros(max(vocab.values()) + 1, bool)
        self.last[[i for w, i in vocab.items() if w.endswith("</w>")]] = True
        self._clear()

    def _clear(self) -> None:
        self.runs, self.chars = _Runs(), 0
        self.ids, self.ends = np.empty(0, "<u4"), np.zeros(1, np.int64)  # of all runs, by number

    def _raw(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _encode_runs(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all runs in a row, and how many each has."""
        ids = self._raw(" ".join(runs))
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) == len(runs) and ends[-1] == len(ids):
            return ids, np.diff(ends, prepend=0)
        each = [self._raw(r) for r in runs]
        return np.concatenate(each), np.array([len(x) for x in each])

    def _learn(self) -> None:
        """Ids for the new runs.  A chunk that is encoded as it is starts with a space here."""
        new, self.runs.new = self.runs.new, []
        plain = np.array([r[0] != " " for r in new])
        parts, sizes = [], np.zeros(len(new), np.int64)
        if plain.all():
            ids, sizes = self._encode_runs(new)
            parts = [ids]
        else:
            for i, r in enumerate(new):
                parts.append(self._raw(r[1:] if r[0] == " " else r))
                sizes[i] = len(parts[-1])
        self.chars += sum(map(len, new))
        self.ids = np.concatenate([self.ids, *parts])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])

    def _cut(self, text: str) -> list[str]:
        if not _outside(text):
            return LATIN_PIECE.findall(text.lower())
        out = []
        for chunk in SPACE.split(text):
            if OUTSIDE.search(chunk):
                out.append(" " + chunk)
            else:
                out += LATIN_PIECE.findall(chunk.lower())
        return out

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        if len(self.runs) > RUNS or self.chars > CHARS:
            self._clear()
        found = [self._cut(t or "") for t in texts]
        ends = np.cumsum([0, *map(len, found)])
        code = np.fromiter(map(self.runs.__getitem__, chain.from_iterable(found)), np.int64, ends[-1])
        if self.runs.new:
            self._learn()
        first = self.ends[code]
        size = self.ends[code + 1] - first
        before = np.concatenate([[0], np.cumsum(size)])  # ids of this slice before each run
        at = np.arange(before[-1]) + np.repeat(first - before[:-1], size)
        raw, cuts = self.ids[at].tobytes(), (4 * before[ends]).tolist()
        return [raw[a:z] for a, z in zip(cuts, cuts[1:])]


_encoders: dict[int, Encoder] = {}


def encoder(vocabulary: bytes) -> Encoder:
    """One encoder per vocabulary and worker process."""
    key = hash(vocabulary)
    if key not in _encoders:
        _encoders[key] = Encoder(vocabulary)
    return _encoders[key]


def slices(texts, size: int = 1 << 21):
    """(first, last) row ranges of about ``size`` characters, so that memory stays bounded."""
    at, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held >= size:
            yield at, i + 1
            at, held = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def text_slices(column: pa.Array, size: int = 1 << 21):
    """(first, texts): the same ranges of a string column, as Python strings one range at a time."""
    ends = np.cumsum(pc.utf8_length(column).fill_null(0).to_numpy(), dtype=np.int64)
    at = 0
    while at < len(column):
        z = min(len(column), int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size)) + 1)
        yield at, column[at:z].to_pylist()
        at = z
