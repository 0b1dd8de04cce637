"""Ids of a public byte-level BPE vocabulary for whole texts, chunk by chunk.

The vocabulary's pattern never joins a visible character with white space after it, so a text may be cut before every
white-space run and the ids of its chunks joined: same ids as encoding the text at once.  Special strings of the vocabulary
hold no white space, so a chunk has them whole.  Chunks repeat, so a worker encodes each once and keeps its ids as
little-endian unsigned 32-bit bytes.  Many texts are cut at once in their UTF-8 bytes, Arrow tells their chunks apart, and only
a batch's distinct chunks are Python objects.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa

from cohortframe.llm.common import REMEMBERED

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

_WS = "\x09-\x0d\x20\x85\xa0  -     　"      # Unicode white space
_CUT = re.compile(f"(?<=[^{_WS}])(?=[{_WS}])")
_SPACED = re.compile(f"[{_WS}]")
GROUP = 64              # words encoded in one text
SEGMENT = 1 << 20       # chars of a text handled at once
BATCH = 1 << 21         # chars of texts handled at once; SEGMENT by a worker that is told to remember less
LIMIT = 600_000         # chunks of a generation unless told otherwise; a worker remembers two, some 250 MB at most


_BYTES = np.arange(256)
_SPACE = np.isin(_BYTES, [*range(9, 14), 32])                   # white space of one byte
_LETTER = (_BYTES | 32 >= ord("a")) & (_BYTES | 32 <= ord("z")) & (_BYTES < 128)
_MARK = np.isin(_BYTES, [*b".,;:!?*$%&#|"])                     # punctuation that ends a chunk of letters
# the numbers of the last two and three bytes of longer white space
_SPACES = [np.array(sorted(int.from_bytes(e, "big") for c in map(chr, range(0x80, 0x3001)) if re.match(f"[{_WS}]", c) and len(e := c.encode()) == n)) for n in (2, 3)]


def _starts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the chunks of texts begin that lie end to end in UTF-8: each text, each ASCII white space after what is none, and
    the punctuation that ends a chunk of letters."""
    begins = np.zeros(len(raw) + 1, bool)
    space = _SPACE[raw]
    begins[1:-1] = space[1:] & ~space[:-1]
    far = np.flatnonzero(begins[1:-1] & (raw[:-1] >= 0x80)) + 1         # after a longer character, which may be white space too
    if len(far):
        two, three = (np.zeros(len(far), np.int64) for _ in range(2))
        for k in (3, 2, 1):
            three = three << 8 | raw[np.maximum(far - k, 0)]
        two = three & 0xFFFF
        begins[far[np.isin(two, _SPACES[0]) | np.isin(three, _SPACES[1])]] = False
    begins[offsets[:-1]] = True
    begins[-1] = False          # an empty text at the end
    starts = np.flatnonzero(begins)
    letter, mark = _LETTER[raw], _MARK[raw]
    latin = np.flatnonzero((raw[:-1] >= 0xC3) & (raw[:-1] <= 0xC9))
    code = (raw[latin] & np.uint16(31)) << 6 | raw[latin + 1] & 63
    latin = latin[(code != 0xD7) & (code != 0xF7) & (code < 0x250)]
    letter[latin] = letter[latin + 1] = True
    turn = np.flatnonzero(mark[1:] & letter[:-1]) + 1
    of = np.searchsorted(starts, turn, "right") - 1
    once = np.append(True, of[1:] != of[:-1])[:len(of)] & np.append(of[1:] != of[:-1], True)[:len(of)]
    turn, of = turn[once], of[once]
    lo, hi = starts[of], np.append(starts[1:], len(raw))[of]
    lead = raw[lo] == 32
    other = np.append(0, np.cumsum(~(letter | mark), dtype=np.int32))
    # a space or not, letters, one turn, marks
    begins[turn[(other[hi] - other[lo] == lead) & letter[lo + lead] & mark[hi - 1]]] = True
    return np.flatnonzero(begins)


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers
    return str(public_tokenizers.path(name))


class Subwords:
    def __init__(self, path: str, literal: bool = False):
        """``literal``: the strings of special tokens in a text are ordinary text."""
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = literal
        self.limit: int | None = None
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.words: dict[bytes, bytes] = {}
        self.older_words: dict[bytes, bytes] = {}
        self.spaces: np.ndarray | None = None

    def _learn(self, chunks: list[str]) -> None:
        """Make chunks known that are not.  A full generation becomes the older one, from which what is met again is taken over."""
        if len(self.known) + len(chunks) > (self.limit or LIMIT):
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        known.update((c, older[c]) for c in chunks if c in older)
        new = [c for c in chunks if c not in known]
        for chunk, got in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False)):
            known[chunk] = array("I", got.ids).tobytes()

    def _segments(self, text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > SEGMENT and (cut := _CUT.search(text, at + SEGMENT)):
            yield text[at:cut.start()]
            at = cut.start()
        yield text[at:] if at else text

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit bytes."""
        held: list[str] = []
        size = 0
        for text in texts:
            if len(text) > SEGMENT:
                yield from self._flush(held)
                held, size = [], 0
                yield b"".join(chain.from_iterable(self._flush([s]) for s in self._segments(text)))
                continue
            held.append(text)
            size += len(text)
            if size > (SEGMENT if self.limit else BATCH):
                yield from self._flush(held)
                held, size = [], 0
        yield from self._flush(held)

    def encode_words(self, texts: list[list[bytes]]) -> list[bytes]:
        """For texts cut into words already: the ids of a space and the word, for each word, as little-endian 16-bit bytes."""
        words = set(chain.from_iterable(texts))
        if len(self.words) + len(words) > (self.limit or LIMIT):
            self.words, self.older_words = {}, self.words
        known, older = self.words, self.older_words
        absent = [w for w in words if w not in known]
        known.update((w, older[w]) for w in absent if w in older)
        self._learn_words([w for w in absent if w not in known])
        return [b"".join(map(known.__getitem__, t)) for t in texts]

    def _learn_words(self, new: list[bytes]) -> None:
        """Make words known, several in one text: white space goes with the word after it, so each word's ids begin at a space."""
        plain, odd = [], []
        for word in new:
            (odd if _SPACED.search(text := word.decode("utf-8", "surrogatepass")) else plain).append((word, " " + text))
        groups = [plain[i:i + GROUP] for i in range(0, len(plain), GROUP)] + [[o] for o in odd]
        for group, got in zip(groups, self.tokenizer.encode_batch_fast(["".join(t for _, t in g) for g in groups], add_special_tokens=False)):
            ids = np.array(got.ids, "<u2")
            starts = 2 * np.flatnonzero(self.begins()[ids]) if len(group) > 1 else np.zeros(1, np.int64)
            raw = ids.tobytes()
            self.words.update(zip((w for w, _ in group), map(raw.__getitem__, map(slice, starts.tolist(), [*starts[1:].tolist(), len(raw)])), strict=True))

    def begins(self) -> np.ndarray:
        """Which ids begin with a space (byte-level vocabularies write it as U+0120)."""
        if self.spaces is None:
            self.spaces = np.zeros(1 << 16, bool)
            self.spaces[[i for token, i in self.tokenizer.get_vocab().items() if token.startswith("Ġ")]] = True
        return self.spaces

    def _flush(self, held: list[str]) -> list[bytes]:
        raw = [t.encode() for t in held]
        offsets = np.cumsum([0, *map(len, raw)])
        joined = np.frombuffer(b"".join(raw), np.uint8)
        starts = _starts(joined, offsets)
        chunks = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(joined))), pa.py_buffer(joined)).dictionary_encode()
        distinct = chunks.dictionary.to_pylist()
        ids = list(map(self.known.get, distinct))
        unknown = [c for c, i in zip(distinct, ids) if i is None]
        if unknown:
            self._learn(unknown)
            learned = map(self.known.__getitem__, unknown)
            ids = [next(learned) if i is None else i for i in ids]
        # the ids of all chunks end to end: from each chunk's place among the distinct ones' ids, step by step
        code = chunks.indices.to_numpy()
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        own = size[code]
        ends = np.append(0, np.cumsum(own))
        at = np.repeat((np.cumsum(size) - size)[code] - ends[:-1], own) + np.arange(ends[-1])
        out = np.frombuffer(b"".join(ids), "<u4")[at].tobytes()
        cuts = (4 * ends[np.searchsorted(starts, offsets)]).tolist()
        return [out[lo:hi] for lo, hi in zip(cuts, cuts[1:])]


_BY_PATH: dict[tuple[str, bool], Subwords] = {}


def subwords(path: str, literal: bool = False, limit: int | None = None) -> Subwords:
    """The worker's own copy, loaded once; ``common.begin`` of another operator's task drops it."""
    REMEMBERED["subwords"] = _BY_PATH.clear
    if (path, literal) not in _BY_PATH:
        _BY_PATH[path, literal] = Subwords(path, literal)
    _BY_PATH[path, literal].limit = limit
    return _BY_PATH[path, literal]
