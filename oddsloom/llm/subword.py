"""Token ids by the tokenizers' own libraries, for many whole texts at once.

Texts are cut where the tokenizer's own pattern cuts anyway. Distinct parts of
a slice are looked up among those that the task has met before; only new ones
go to the library, many of them as one text, as a call takes longer than a
part. All tables are arrays: a part costs its bytes and ids, no objects.
"""

from __future__ import annotations

import itertools
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Distinct parts that a task remembers.
KNOWN = 600_000
#: Digits are tokens of their own: one that a part doesn't hold marks borders between parts whose white space is dropped.
MARKS = "0123456789"
#: Stands before each part where white space belongs to tokens.
FILLER = " a"
#: How pieces write a space.
SPACE = "▁"

_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_SIGN = np.zeros(256, dtype=bool)
_SIGN[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_WHITE = np.zeros(256, dtype=bool)
_WHITE[[9, 10, 13, 32]] = True
#: Bytes after which a space surely starts a new part: not those of white space, nor last bytes of wider characters that may be white space.
_BEFORE_SPACE = np.ones(256, dtype=bool)
_BEFORE_SPACE[[*range(9, 14), *range(28, 33), *range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]] = False


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places ``start, start + 1, ...`` of every run, one run after another."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


def data_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all values one after another, and their offsets."""
    if not len(texts):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


class KnownParts:
    """Encodes texts by their parts: ``parts`` cuts texts, ``encode_new`` asks the library."""

    remembered = KNOWN

    def forget(self) -> None:
        self.known = pa.array([], pa.binary())
        self.lengths, self.ids = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts without special tokens, and row offsets."""
        parts, offsets = self.parts(texts)
        coded = pc.dictionary_encode(parts)
        place = pc.index_in(coded.dictionary, value_set=self.known)
        fresh = coded.dictionary.filter(pc.is_null(place))
        lengths, ids = self.encode_new(fresh)
        number = np.where(place.is_null().to_numpy(zero_copy_only=False), np.cumsum(place.is_null().to_numpy(zero_copy_only=False)) - 1 + len(self.known), pc.fill_null(place, 0).to_numpy(zero_copy_only=False))
        self.known = pa.concat_arrays([self.known, fresh])
        self.lengths, self.ids = np.concatenate([self.lengths, lengths]), np.concatenate([self.ids, ids])
        starts = np.cumsum(self.lengths) - self.lengths
        used = number[coded.indices.to_numpy(zero_copy_only=False)]
        taken = self.lengths[used]
        found = self.ids[spread(starts[used], taken)]
        if len(self.known) > self.remembered:
            self.forget()
        return found, np.concatenate([[0], np.cumsum(taken)])[offsets]

    def bytes_cut(self, texts: pa.Array, where) -> tuple[pa.Array, np.ndarray]:
        """Parts that begin at each text's start and wherever ``where`` says of a byte and the one after it; row offsets into them."""
        data, offsets = data_of(texts)
        cut = np.zeros(len(data) + 1, dtype=bool)
        cut[1:-1] = where(data[:-1], data[1:])
        cut[offsets] = True
        cuts = np.flatnonzero(cut)
        made = pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
        return made, np.searchsorted(cuts, offsets)


class Subwords(KnownParts):
    """A tokenizer file. ``spaced``: white space is dropped, so that parts end at any; else parts start with their white space."""

    def __init__(self, path: str, spaced: bool, plain_specials: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain_specials
        self.spaced = spaced
        #: Never cut inside a special token: pairs of bytes that stand in one.
        self.uncut = {(a, b) for t in self.tokenizer.get_added_tokens_decoder().values() for a, b in zip(t.content.encode(), t.content.encode()[1:])}
        if not spaced:
            self.width = np.array([len(byte_level(t)) if t else 0 for t in map(self.tokenizer.id_to_token, range(self.size()))], dtype=np.int64)
        self.forget()

    def size(self) -> int:
        return self.tokenizer.get_vocab_size(with_added_tokens=True)

    def parts(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        def where(before: np.ndarray, after: np.ndarray) -> np.ndarray:
            cut = _LETTER[before] & _SIGN[after]
            for a, b in self.uncut:
                cut &= (before != a) | (after != b)
            return cut | (_WHITE[before] != _WHITE[after] if self.spaced else (after == 32) & _BEFORE_SPACE[before])

        return self.bytes_cut(texts, where)

    def encode_new(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of ids of all parts, and the ids."""
        data, offsets = data_of(parts)
        size = np.diff(offsets)
        first, last = data[offsets[:-1]], data[offsets[1:] - 1]
        bags: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if self.spaced:
            left = ~_WHITE[first]
            for mark in MARKS:
                code = self.tokens(mark.encode())
                fit = np.flatnonzero(left & ~pc.match_substring(parts, mark).to_numpy(zero_copy_only=False))
                if len(fit) and len(code) == 1:
                    ids = self.tokens(_together(parts, fit, f" {mark} ") + f" {mark} ".encode())
                    ends = np.flatnonzero(ids == code[0])
                    if len(ends) == len(fit):
                        starts = np.concatenate([[0], ends[:-1] + 1])
                        bags.append((fit, ends - starts, ids[spread(starts, ends - starts)]))
                        left[fit] = False
        else:
            left = size > 0
            fit = np.flatnonzero(left & _BEFORE_SPACE[last] & ((first == 32) | _SIGN[first]))
            if len(fit):
                ids = self.tokens(FILLER.encode() + _together(parts, fit, FILLER))
                places = np.concatenate([[0], np.cumsum(self.width[ids])])
                ends = np.cumsum(size[fit] + len(FILLER))
                a, b = np.searchsorted(places, ends - size[fit]), np.searchsorted(places, ends)
                if b[-1] < len(places) and np.array_equal(places[a], ends - size[fit]) and np.array_equal(places[b], ends):
                    bags.append((fit, b - a, ids[spread(a, b - a)]))
                    left[fit] = False
        for k in np.flatnonzero(left).tolist():
            ids = self.tokens(parts[k].as_py())
            bags.append((np.array([k]), np.array([len(ids)]), ids))
        lengths = np.zeros(len(parts), dtype=np.int64)
        for which, counts, _ in bags:
            lengths[which] = counts
        starts, found = np.cumsum(lengths) - lengths, np.zeros(int(lengths.sum()), dtype=np.int32)
        for which, counts, ids in bags:
            found[spread(starts[which], counts)] = ids
        return lengths, found

    def tokens(self, text: bytes) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text.decode()], add_special_tokens=False)[0].ids, dtype=np.int64)


class Pieces(KnownParts):
    """A model of pieces (merge type). Texts come with the space before them that the model itself would add."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        #: Whether no piece has a space after another character, so that texts may be cut before spaces.
        self.apart = not any(SPACE in p.lstrip(SPACE) for p in pieces)
        self.space = self.model.piece_to_id(SPACE)
        #: Bytes that each id stands for.
        self.surface = pa.array([b"" if self.model.is_control(i) or self.model.is_unknown(i) else bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)], pa.binary())
        self.forget()

    def parts(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        return self.bytes_cut(texts, lambda before, after: (after == 32) & (before != 32) & self.apart)

    def encode_new(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        found = self.model.encode([p[1:].decode() for p in parts.to_pylist()], num_threads=1)
        found = [[self.space] if not ids else ids for ids in found]
        lengths = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        return lengths, np.fromiter(itertools.chain.from_iterable(found), dtype=np.int32, count=int(lengths.sum()))


def _together(parts: pa.Array, which: np.ndarray, between: str) -> bytes:
    taken = parts.take(pa.array(which))
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(taken)], pa.int32()), taken), between.encode())[0].as_py()


def byte_level(token: str) -> bytes:
    """Bytes of a byte-level token: bytes that print stand for themselves, the others for characters from U+0100 on, in order."""
    return bytes(_BYTE_OF[c] for c in token)


_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_OF = {chr(b): b for b in _PRINTED} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in _PRINTED)}
