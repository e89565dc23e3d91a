"""Exact token ids of the tokenizers library, with a memo of pieces.

The byte-level pattern splits a text into pieces that are encoded apart. Where a
piece certainly ends can be told from a byte and its neighbours (``_cut_before``),
so the texts of a batch are cut there, all at once; what lies between two cuts has
the same ids wherever it stands. Pieces recur, so most are looked up; the others go
to the library, those that no cut is certain in (other scripts, apostrophes before
letters) as they are. Texts with the letters of an added token go there whole.
"""

from __future__ import annotations

import gc
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from starlayer.llm.common import held

TOKENIZER = "byte_bpe_50k.json"
END = np.zeros(1, dtype="<u4").tobytes()
#: pieces of one generation of a worker's memo; about 180 bytes each, two
#: generations are held
MOST_CHUNKS = 400_000
#: bytes of the longest piece that is remembered
LONGEST = 64
#: words encoded in one call: the library's encodings take some 200 bytes a token
#: while they live
WORDS_AT_ONCE = 16_384

SPACE = "\u0120"
# Byte-level alphabet as UTF-16 units: printable bytes of Latin-1 stand for
# themselves, the others for the code points from 256 on; here byte 0, which no word
# holds, stands for the space that parts the words encoded together.
_PRINTABLE = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
ALPHABET = np.arange(256, dtype="<u2")
_OTHERS = [b for b in range(256) if b not in _PRINTABLE]
ALPHABET[_OTHERS] = 256 + np.arange(len(_OTHERS))
ALPHABET[0] = 0x20

# What the pattern takes a character for. Letters are those of ASCII and of the Latin
# blocks, where all Unicode versions agree; a BLANK is white but for the space; OTHER
# is not white, any other character MAYBE.
GAP, BLANK, LETTER, DIGIT, SIGN, QUOTE, OTHER, MAYBE = range(8)
KIND = np.full(256, OTHER, dtype=np.uint8)  # of a byte, that of its character
KIND[[*range(0x20), 0x7F]] = MAYBE
KIND[0x09:0x0E], KIND[0x20], KIND[0x21:0x7F], KIND[0x27] = BLANK, GAP, SIGN, QUOTE
KIND[0x30:0x3A], KIND[0x41:0x5B], KIND[0x61:0x7B] = DIGIT, LETTER, LETTER
PAIR = np.full(1 << 16, OTHER, dtype=np.uint8)  # of the first two bytes of a longer character
PAIR[[lead << 8 | b for lead in range(0xC3, 0xC9) for b in range(0x80, 0xC0)]] = LETTER
PAIR[[0xC397, 0xC3B7]] = OTHER  # multiplication and division sign
PAIR[[0xC285, 0xC2A0, 0xE19A, 0xE1A0, 0xE280, 0xE281, 0xE380]] = MAYBE  # white space among them


def _cut_before(a: int, b: int, c: int) -> bool:
    """Whether a piece certainly begins at a character of kind ``b`` between those
    of kinds ``a`` and ``c`` (MAYBE at the ends of a text).

    White space begins a piece after other characters; so does the last of its run,
    which is a piece by itself unless it is the space before a word or signs. Words
    and numbers end where their kind ends, signs before a word or number, but an
    apostrophe may begin a piece like 's."""
    solid = (LETTER, DIGIT, SIGN, QUOTE, OTHER)
    if b in (GAP, BLANK):
        return a in solid or c in solid
    if a == BLANK:
        return b in solid
    return ((a == LETTER and b in (DIGIT, SIGN, QUOTE)) or (a == DIGIT and b in (LETTER, SIGN, QUOTE))
            or (a == SIGN and b in (LETTER, DIGIT)) or (a == QUOTE and b == DIGIT))


CUT = np.array([_cut_before(k >> 6, k >> 3 & 7, k & 7) for k in range(512)])
#: a word, a number or signs, perhaps with a space: one piece of the pattern
PURE = re.compile(rb" ?(?:(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|[\xc4-\xc8][\x80-\xbf])+"
                  rb"|[0-9]+|[!-&(-/:-@\[-`{-~]+)").fullmatch


def piece_starts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each byte of the texts (UTF-8, one after the other) and the end, whether
    a piece is cut before it; ``bounds`` are the texts' starts and the end."""
    kind = np.full(len(data) + 2, MAYBE, dtype=np.uint8)
    kind[1:-1] = KIND[data]
    lead = np.flatnonzero(data >= 0xC2)
    if len(lead):
        of = PAIR[data[lead].astype(np.uint16) << 8 | data[lead + 1]]
        kind[lead + 1] = kind[lead + 2] = of
        kind[lead[(of == MAYBE) & (data[lead] >= 0xE0)] + 3] = MAYBE
    around = kind[:-2].astype(np.uint16)
    around <<= 3
    around |= kind[1:-1]
    around <<= 3
    around |= kind[2:]
    around[bounds[bounds > 0] - 1] |= MAYBE
    out = np.append(CUT[around], True)
    out[bounds] = True
    return out


def portions(texts: list[str], most: int = 100_000) -> Iterator[list[str]]:
    """``texts`` in order, in lists of about ``most`` characters (a longer text
    alone): the library's encodings take some 200 bytes a token while they live."""
    some: list[str] = []
    size = 0
    for t in texts:
        if some and size + len(t) > most:
            yield some
            some, size = [], 0
        some.append(t)
        size += len(t)
    if some:
        yield some


class Encoder:
    def __init__(self, path: str, most_chunks: int = MOST_CHUNKS):
        self.most_chunks = most_chunks
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        gc.set_threshold(100_000, 50, 1000)  # many strings and tuples, no cycles
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [a.content for a in self.tokenizer.get_added_tokens_decoder().values()]
        self.splitter = Tokenizer.from_file(path)
        self.splitter.pre_tokenizer = CharDelimiterSplit(" ")
        self.splitter.model._resize_cache(0)  # its words are new: the model's own cache misses them all
        self.known: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.spaced = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.spaced[[i for t, i in vocabulary.items() if t.startswith(SPACE)]] = True

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for some in portions(texts)
                for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]

    def _chunks(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks that begin with their only space, encoded as one text: an
        id that starts with a space starts a chunk."""
        out: list[bytes] = []
        for some in portions(chunks):
            found = self._cut(self.tokenizer, "".join(some))
            out += found if len(found) == len(some) else self._encode(some)
        return out

    def _cut(self, tokenizer, joined: str) -> list[bytes]:
        ids = np.array(tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, dtype="<u4")
        first = 4 * np.flatnonzero(self.spaced[ids])
        data, cuts = ids.tobytes(), [*first.tolist(), 4 * len(ids)]
        return [data[a:b] for a, b in zip(cuts, cuts[1:])]

    def _words(self, words: list[bytes], space: bool) -> list[bytes]:
        """Ids of pure pieces, all with or all without a space before them. As each
        is one piece, a second tokenizer, which only splits at spaces, takes them in
        the model's alphabet of bytes."""
        out: list[bytes] = []
        for k in range(0, len(words), WORDS_AT_ONCE):
            some = words[k:k + WORDS_AT_ONCE]
            # a lone space before each word without one shows where it begins
            joined = b"\0".join(some) if space else b" \0" + b"\0 \0".join(some)
            found = self._cut(self.splitter, ALPHABET[np.frombuffer(joined, np.uint8)].tobytes().decode("utf-16-le"))
            out += found if space else [b[4:] for b in found]
        return out

    def _learn(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        """Ids of pieces not in the memo; all but long ones are remembered."""
        if len(self.known) > self.most_chunks:
            self.known, self.old = {}, self.known
        found: dict[bytes, bytes] = {}
        spaced, bare, rest = [], [], []
        for p in pieces:
            if b := self.old.get(p):
                found[p] = b
            elif len(p) > LONGEST or not PURE(p):
                rest.append(p)
            elif p[0] == 0x20:
                spaced.append(p)
            else:
                bare.append(p)
        found.update(zip(spaced, self._words(spaced, space=True)))
        found.update(zip(bare, self._words(bare, space=False)))
        plain, odd = [], []
        for p in rest:
            t = p.decode()
            joins = t[0] == " " and " " not in t[1:] and not t[1:2].isspace() and not t[-1].isspace()
            (plain if joins and not any(c in t for c in self.added) else odd).append((p, t))
        for some, encode in ((plain, self._chunks), (odd, self._encode)):
            found.update(zip([p for p, _ in some], encode([t for _, t in some])))
        self.known.update(found if max(map(len, pieces)) <= LONGEST else {p: b for p, b in found.items() if len(p) <= LONGEST})
        return found

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each followed by id 0, and the texts' bounds in
        them; NULL counts as empty.

        Distinct pieces of the batch are looked up once; their ids are gathered
        into the texts' places by index vectors."""
        texts = pc.fill_null(texts, "").cast(pa.string())
        bounds = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0]:bounds[-1]]
        bounds -= bounds[0]
        starts = piece_starts(data, bounds)
        for content in self.added:
            for k in np.flatnonzero(pc.match_substring(texts, content).to_numpy(zero_copy_only=False)).tolist():
                starts[bounds[k] + 1:bounds[k + 1]] = False
        at = np.flatnonzero(starts)
        coded = pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data)])
        coded = coded.dictionary_encode()
        pieces = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids = list(map(self.known.get, pieces))
        if None in ids:
            found = self._learn([p for p, b in zip(pieces, ids) if b is None])
            ids = [found[p] if b is None else b for p, b in zip(pieces, ids)]
        ids.append(END)
        size = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
        place = np.cumsum(size) - size
        pool = np.frombuffer(b"".join(ids), dtype="<u4")
        last = np.searchsorted(at, bounds[1:])
        segment = np.insert(coded.indices.to_numpy().astype(np.int64), last, len(ids) - 1)
        length = size[segment]
        ends = np.cumsum(length)
        spot = np.repeat(place[segment] - (ends - length), length)
        spot += np.arange(len(spot))
        return pool[spot], np.concatenate([[0], ends[last + np.arange(len(texts))]])


def encoder(path: str | None = None, most_chunks: int = MOST_CHUNKS) -> Encoder:
    """This worker's encoder for a tokenizer file (by default the public one)."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)
    return held(("encoder", path, most_chunks), lambda: Encoder(path, most_chunks))


def crc32(ids: bytes | memoryview) -> int:
    return zlib.crc32(ids)
