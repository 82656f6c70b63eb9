"""Token ids of texts, by the tokenizers library, with the ids of words kept between batches.

Byte-level BPE with the usual pattern (GPT-2's) never merges across the start of a word: of
one blank and a word, the blank belongs to the word's first piece, and what stands before has
no influence on it. So a text is the sequence of its parts between blanks, each with the
blank before it. Where a blank is followed by white space or by nothing, white space
before it can matter: such texts are encoded whole.

A part of plain bytes (ASCII and Latin-1 letters) is cut further where the pattern always cuts: around
a single line end, and between a letter or digit and the marks that end the part or line. The atoms
that come out recur far more often than parts do, and each distinct atom is encoded once.

Only vocabularies of this kind are taken; `Encoder` refuses others.
"""

from __future__ import annotations

import os
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from lidaraudit.llm.common import WordHasher, mix64

#: Atoms whose ids one worker keeps; others are encoded again in each batch. A bound on memory, not on results.
KEPT_ATOMS = 500_000
#: Bytes of new atoms that are joined to be encoded at once.
JOINED = 4096

#: A text, and how GPT-2's pattern cuts it (a blank becomes U+0120, a line end U+010A).
PATTERN_TEST, PATTERN_PIECES = "It's 42é ok,x.\n  y", ["It", "'s", "\u012042", "\u00c3\u00a9", "\u0120ok", ",", "x", ".", "\u010a\u0120", "\u0120y"]
#: Bytes of parts that may be cut: visible ASCII, the line end, a first blank, and letters U+00C0 to U+00FF (lead byte C3).
_PLAIN = np.zeros(256, bool)
_PLAIN[[10, 32, *range(33, 127), *range(0x80, 0xC0), 0xC3]] = True
#: Marks that may end a part; the apostrophe begins pieces of its own, so it isn't one.
_MARKS = np.zeros(256, bool)
_MARKS[list(b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")] = True
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True

#: First bytes of white space; the last four begin other characters as well.
_MAYBE_SPACE = np.zeros(256, bool)
_MAYBE_SPACE[[32, *range(9, 14), *range(28, 32), 0xC2, 0xE1, 0xE2, 0xE3]] = True


def _strings(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string array without nulls, and its n + 1 borders."""
    _, offsets, data = array.buffers()
    borders = np.frombuffer(offsets, np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[borders[0] : borders[-1]], borders - borders[0]


def _cuts(data: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """Where atoms begin: the borders of the units and, in plain ones, around line ends and before closing marks."""
    n = len(borders) - 1
    if not len(data):
        return borders[:-1]
    at = np.arange(len(data), dtype=np.int32)
    unit = np.repeat(np.arange(n, dtype=np.int32), np.diff(borders))
    line = data == 10
    edge = np.zeros(len(data) + 1, bool)
    edge[borders] = True
    bad = ~_PLAIN[data]
    # A line end beside another one or at an edge of its unit isn't cut off.
    after = np.append(line[1:], True) | edge[1:]
    before = np.append(True, line[:-1]) | edge[:-1]
    bad |= line & (after | before)
    plain = np.bincount(unit, bad, n) == 0
    line &= plain[unit]
    begin = edge[:-1].copy()
    begin |= line
    begin[1:] |= line[:-1]
    # Ends of pieces: what stands before a beginning or the end; from each back over its marks.
    starts = np.flatnonzero(begin)
    ends = np.append(starts[1:], len(data))
    last = np.maximum.accumulate(np.where(_MARKS[data], np.int32(-1), at))[ends - 1]
    fine = (last >= starts) & (last < ends - 1) & plain[unit[starts]]
    last = last[fine]
    letter = _ALNUM[data[last]] | ((last > 0) & (data[last - 1] == 0xC3) & (data[last] >= 0x80) & (data[last] != 0x97) & (data[last] != 0xB7))
    begin[last[letter] + 1] = True
    return np.flatnonzero(begin)


class Encoder:
    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core; threads would only wait for each other
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.is_byte_level(vocabulary, path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.has_special = re.compile("|".join(map(re.escape, self.special)) or "(?!)").search
        self.width = np.zeros(1 + max(vocabulary.values()), np.int64)
        for token, i in vocabulary.items():
            self.width[i] = len(token)  # one character of a token stands for one byte
        # Known atoms: sorted hashes, the atom of each, and the bytes of all atoms.
        self.hashes, self.atom = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.text, self.text_at = np.zeros(1 << 20, np.uint8), np.zeros(1 << 16, np.int32)
        self.byte_value = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
        self.power = np.ones(1, np.uint64)
        self.pool = np.zeros(1 << 20, np.uint16)
        self.at = np.zeros(1 << 16, np.int64)  # where the ids of atom k begin in pool
        self.known = self.used = 0

    def is_byte_level(self, vocabulary: dict[str, int], path: str) -> None:
        """An error for vocabularies on which cutting at blanks, byte widths or 16-bit ids would be wrong."""
        t = self.tokenizer
        pieces = [p for p, _ in t.pre_tokenizer.pre_tokenize_str(PATTERN_TEST)] if t.pre_tokenizer is not None else []
        right = type(t.model).__name__ == "BPE" and t.normalizer is None and pieces == PATTERN_PIECES and max(vocabulary.values()) < 1 << 16
        if not right:
            raise ValueError(f"{path} isn't a byte-level BPE vocabulary of at most 65,536 ids with GPT-2's pattern and no normaliser")

    def _add(self, ids: np.ndarray, ends: np.ndarray) -> None:
        """Ids of further atoms, one after the other, and where each one's end."""
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while self.known + len(ends) + 1 > len(self.at):
            self.at = np.concatenate([self.at, np.zeros_like(self.at)])
        self.pool[self.used : self.used + len(ids)] = ids
        self.at[self.known + 1 : self.known + 1 + len(ends)] = self.used + ends
        self.used += len(ids)
        self.known += len(ends)

    def _learn(self, text: bytes, upto: np.ndarray) -> None:
        """Encodes atoms that begin with a blank: many joined in one text, whose ids are told apart by the bytes they stand for."""
        cuts = np.unique(np.append(upto[np.minimum(np.searchsorted(upto, np.arange(JOINED, upto[-1], JOINED)), len(upto) - 1)], upto[-1])).tolist()
        joined = [text[a:b].decode() for a, b in zip([0, *cuts], cuts, strict=False)]
        ids = np.concatenate([np.array(e.ids, np.uint16) for e in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)])
        self._add(ids, np.searchsorted(np.cumsum(self.width[ids]), upto) + 1)

    def _learn_alone(self, atoms: list[str]) -> None:
        each = [e.ids for e in self.tokenizer.encode_batch_fast(atoms, add_special_tokens=False)]
        self._add(np.concatenate([np.array(x, np.uint16) for x in each]), np.cumsum([len(x) for x in each]))

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint16)

    def _hashes(self, data: np.ndarray, borders: np.ndarray) -> np.ndarray:
        """64 bits of each atom, a sum over its bytes; what they find is compared byte by byte."""
        if not len(data):
            return np.zeros(len(borders) - 1, np.uint64)
        size = np.diff(borders)
        while len(self.power) < size.max():
            self.power = np.cumprod(np.append(np.uint64(1), np.full(2 * len(self.power), WordHasher.BASE, np.uint64)))
        place = np.arange(len(data), dtype=np.int32) - np.repeat(borders[:-1].astype(np.int32), size)
        return mix64(np.add.reduceat(self.byte_value[data] * self.power[place], borders[:-1]))

    def _atoms(self, atoms: pa.Array) -> np.ndarray:
        """Numbers of distinct atoms; those not known are encoded."""
        data, borders = _strings(atoms)
        hashes, size = self._hashes(data, borders), np.diff(borders)
        number = np.full(len(atoms), -1, np.int64)
        if len(self.hashes):
            place = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            hit = np.flatnonzero(self.hashes[place] == hashes)
            found = self.atom[place[hit]]
            kept = pa.StringArray.from_buffers(self.known, pa.py_buffer(self.text_at[: self.known + 1]), pa.py_buffer(self.text))
            same = pc.equal(kept.take(pa.array(found)), atoms.take(pa.array(hit))).to_numpy(zero_copy_only=False)
            number[hit[same]] = found[same]
        late = np.flatnonzero(number == -1)
        if len(late):
            blank = (size[late] > 0) & (data[np.minimum(borders[late], len(data) - 1)] == 32) if len(data) else np.zeros(len(late), bool)
            late = np.concatenate([late[blank], late[~blank]])
            number[late] = self.known + np.arange(len(late))
            new, n = atoms.take(pa.array(late)), int(blank.sum())
            text, at = _strings(new)
            self._keep(text, at)
            if n:
                self._learn(text[: at[n]].tobytes(), at[1 : n + 1])
            if n < len(late):
                self._learn_alone(new[n:].to_pylist())
            distinct, first = np.unique(hashes[late], return_index=True)
            place = np.searchsorted(self.hashes, distinct)
            fresh = self.hashes[np.minimum(place, len(self.hashes) - 1)] != distinct if len(self.hashes) else np.ones(len(distinct), bool)
            self.hashes = np.insert(self.hashes, place[fresh], distinct[fresh])
            self.atom = np.insert(self.atom, place[fresh], number[late[first[fresh]]])
        return number

    def _keep(self, text: np.ndarray, at: np.ndarray) -> None:
        """The bytes of further atoms, to compare others with."""
        used, n = int(self.text_at[self.known]), len(at) - 1
        while used + len(text) > len(self.text):
            self.text = np.concatenate([self.text, np.zeros_like(self.text)])
        while self.known + n + 1 > len(self.text_at):
            self.text_at = np.concatenate([self.text_at, np.zeros_like(self.text_at)])
        self.text[used : used + len(text)] = text
        self.text_at[self.known + 1 : self.known + 1 + n] = used + at[1:]

    def encode(self, texts: pa.Array | list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (null: empty), one after the other, and how many each has."""
        before = self.known, self.used, self.hashes, self.atom
        column = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "").cast(pa.string())
        if not len(column):
            return np.zeros(0, np.uint16), np.zeros(0, np.int64)
        split = pc.split_pattern(column, " ")
        sizes = pc.list_value_length(split).to_numpy().astype(np.int64)
        begins = np.cumsum(sizes) - sizes
        distinct = split.flatten().dictionary_encode()
        parts, code = distinct.dictionary, distinct.indices.to_numpy().astype(np.int64)
        # Units: each distinct part with a blank before it, then those that begin a text without one.
        first, number = np.unique(code[begins], return_inverse=True)
        code[begins] = len(parts) + number
        heads = parts.take(pa.array(first))
        units = pa.concat_arrays([pc.binary_join_element_wise(pa.scalar(" "), parts, ""), heads])
        data, borders = _strings(units)
        size = np.diff(borders)
        # A unit of white space after its blank makes its texts odd, and so does a special token.
        second = np.where(size > 1, data[np.minimum(borders[:-1] + 1, max(len(data) - 1, 0))], 32) if len(data) else np.full(len(size), 32)
        odd = _MAYBE_SPACE[second]
        odd[len(parts) :] = False
        for i in np.flatnonzero(odd & (second > 127)).tolist():
            odd[i] = units[i].as_py()[1].isspace()
        odd[len(parts) :] |= pc.utf8_is_space(heads).to_numpy(zero_copy_only=False)
        if self.has_special(data.tobytes().decode()):
            odd |= np.array([bool(self.has_special(u)) for u in units.to_pylist()], bool)
        start = _cuts(data, borders)
        atoms = pa.StringArray.from_buffers(len(start), pa.py_buffer(np.append(start, len(data)).astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())).dictionary_encode()
        own = self._atoms(atoms.dictionary)[atoms.indices.to_numpy()]
        kept = pa.LargeListArray.from_arrays(pa.array(self.at[: self.known + 1]), pa.array(self.pool[: self.used]))
        ids_of_atoms = kept.take(pa.array(own)).flatten()
        length = np.concatenate([[0], np.cumsum(self.at[own + 1] - self.at[own])])
        upto = length[np.searchsorted(start, borders)]
        ids = pa.LargeListArray.from_arrays(pa.array(upto), ids_of_atoms).take(pa.array(code)).flatten().to_numpy()
        total = np.concatenate([[0], np.cumsum(np.diff(upto)[code])])
        n = np.diff(total[np.append(begins, len(code))])
        bad = np.unique(np.searchsorted(begins, np.flatnonzero(odd[code]), "right") - 1).tolist() if odd.any() else []
        if bad:
            pieces = np.split(ids, np.cumsum(n)[:-1])
            for i in bad:
                pieces[i] = self.whole(column[i].as_py())
            ids, n = np.concatenate(pieces), np.array([len(x) for x in pieces], np.int64)
        if before[0] > KEPT_ATOMS:  # forget what this batch has added
            self.known, self.used, self.hashes, self.atom = before
        return ids, n


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each worker process and vocabulary."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def ids_crc32(ids: np.ndarray) -> int:
    """CRC-32 of the ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())
