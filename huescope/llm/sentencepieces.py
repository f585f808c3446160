"""SentencePiece encoding and decoding by suffix-array matching.

A batch's texts are normalised and cut where the meta symbol for a blank follows
another character; no piece of such a vocabulary crosses that place, so the parts
are encoded by themselves, each different part once. The different parts are laid
end to end and indexed by a suffix array of their first ``longest piece``
characters. Every piece is searched in it by bisection: its range of suffixes is
where the piece occurs. Those occurrences are the edges of the parts' lattices;
sorted by their end position they are relaxed from left to right:

* unigram models: the best sum of scores that ends at each position;
* BPE models: merging is not a best path, but the encoding of a prefix is unique
  and ends with the one piece that merging leaves next to the prefix's previous
  last piece. An edge is relaxed when the two pieces, encoded together, stay the
  two pieces; such pairs are remembered.

Characters that no edge reaches become byte pieces, or the unknown piece when the
vocabulary has none.
"""

from __future__ import annotations

import functools
import re
import sys
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from huescope.llm.common import arrow_map, pick, text_or_empty

META = "\u2581"
_PARTS = re.compile(f"{META}*[^{META}]+|{META}+").findall
_REMEMBERED = 300_000
#: Characters of new parts that are indexed at once.
_INDEXED = 400_000


class Vocabulary:
    """Pieces, ids and scores of a model file; its kind is read from the file.

    ``path`` is a parameter of every operator here; the file is only read.
    """

    def __init__(self, path: str):
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_file=path)
        size = processor.get_piece_size()
        self.processor = processor
        self.unknown = processor.unk_id()
        self.text = [processor.id_to_piece(i) for i in range(size)]
        self.bytes: dict[int, int] = {}
        self.ids: dict[str, int] = {}
        self.scores: list[float] = [processor.get_score(i) for i in range(size)]
        self.silent = {i for i in range(size) if processor.is_control(i)}
        for i, piece in enumerate(self.text):
            if processor.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
            elif not (processor.is_control(i) or processor.is_unknown(i) or processor.is_unused(i)):
                self.ids[piece] = i
        self.spelled = [b"" if i in self.silent else t.encode() for i, t in enumerate(self.text)]
        for byte, i in self.bytes.items():
            self.spelled[i] = bytes([byte])
        self.spelled[self.unknown] = " \u2047 ".encode()
        self.bpe = _is_bpe(path)
        self.crossing = any(META in piece.lstrip(META) for piece in self.ids)
        self.longest = max(map(len, self.ids), default=1)
        self.ordered = sorted(self.ids)
        letters = sorted({c for piece in self.ids for c in piece})
        self.numbers = np.zeros(sys.maxunicode + 1, dtype=">u2")
        self.numbers[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.keys = self._keys("".join(p.ljust(self.longest, "\0") for p in self.ordered)).reshape(len(self.ordered), -1)
        self.pairs: dict[int, bool] = {}
        self.inside = np.zeros((len(letters) + 1,) * 2, dtype=bool)
        neighbours = "".join(sorted({a + b for piece in self.ids for a, b in zip(piece, piece[1:])}))
        self.inside[tuple(self._keys(neighbours).astype(np.int64).reshape(-1, 2).T)] = True
        self.alone = np.array([False, *(c in self.ids for c in letters)])
        self.lengths = np.array([len(p) for p in self.ordered])
        self.ordered_ids = np.array([self.ids[p] for p in self.ordered])

    def _keys(self, text: str) -> np.ndarray:
        """Numbers of the characters, from 1; characters in no piece, and NUL, have 0."""
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        return self.numbers[points]

    def edges(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(end, start, id) of every occurrence of every piece in a text."""
        codes = self._keys(text)
        padded = np.concatenate([codes, np.zeros(self.longest, codes.dtype)]).astype(">u2")
        windows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, self.longest)[: len(codes)])
        suffixes = windows.view(f"S{2 * self.longest}").ravel()
        order = np.argsort(suffixes, kind="stable")
        array = suffixes[order]
        low = self.keys.copy()
        high = np.where(low == 0, 0xFFFF, low).astype(">u2")
        first = np.searchsorted(array, np.ascontiguousarray(low).view(f"S{2 * self.longest}").ravel(), side="left")
        last = np.searchsorted(array, np.ascontiguousarray(high).view(f"S{2 * self.longest}").ravel(), side="right")
        counts = last - first
        piece = np.repeat(np.arange(len(counts)), counts)
        offset = np.arange(len(piece)) - np.repeat(np.cumsum(counts) - counts, counts)
        start = order[first[piece] + offset]
        return start + self.lengths[piece], start, self.ordered_ids[piece]

    def atoms(self, parts: list[str]) -> Iterator[list[str]]:
        """Each part, cut wherever no piece holds the two neighbouring characters."""
        joined = "\0".join(parts)
        codes = self._keys(joined).astype(np.int64)
        cuts = np.flatnonzero(~self.inside[codes[:-1], codes[1:]]) + 1
        bounds = np.concatenate([[0], cuts, [len(joined)]])
        ends = np.cumsum([len(p) + 1 for p in parts]) - 1
        begins = np.concatenate([[0], ends + 1])[:-1]
        places = bounds.tolist()
        pieces = [joined[a:b] for a, b in zip(places, places[1:])]
        for a, b in zip(np.searchsorted(bounds, begins).tolist(), np.searchsorted(bounds, ends).tolist()):
            yield pieces[a:b]

    def stay(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``stays`` for many pairs of pieces, each different pair once."""
        keys, at = np.unique(left << 32 | right, return_inverse=True)
        asked = keys.tolist()
        known = list(map(self.pairs.get, asked))
        if None in known:
            known = [self.stays(k >> 32, k & 0xFFFFFFFF) if v is None else v for k, v in zip(asked, known)]
        return np.array(known, dtype=bool)[at]

    def stays(self, left: int, right: int) -> bool:
        """Whether merging the two pieces' text from characters gives the two pieces again."""
        key = left << 32 | right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > 2_000_000:
                self.pairs.clear()
            known = self.pairs[key] = self._merge(self.text[left] + self.text[right]) == [self.text[left], self.text[right]]
        return known

    def _merge(self, text: str) -> list[str]:
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                made = self.ids.get(parts[i] + parts[i + 1])
                if made is not None and (best is None or self.scores[made] > best):
                    best, at = self.scores[made], i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts


def _is_bpe(path: str) -> bool:
    """The model type in the trainer settings of the file (field 2, there field 3): 2 is BPE."""
    with open(path, "rb") as file:
        content = file.read()
    for number, value in _fields(content):
        if number == 2:
            return any(n == 3 and v == 2 for n, v in _fields(value))
    return False


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            size = varint() if key & 7 == 2 else 8 if key & 7 == 1 else 4
            yield key >> 3, data[at : at + size]
            at += size


#: Marks of positions: not reached, reached by a character that is no piece, start of an atom.
_NONE, _RAW, _START = -1, -2, -3


def relax(vocabulary: Vocabulary, atoms: list[str]) -> list[np.ndarray]:
    """Ids of each atom as unsigned 32-bit numbers. All atoms advance together, one end position at a time."""
    joined = "\0".join(atoms)
    end, start, piece = vocabulary.edges(joined)
    sizes = np.array([len(a) for a in atoms])
    begins = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    local = end - begins[np.searchsorted(begins, start, side="right") - 1]
    order = np.lexsort((start, end, local))  # by position in the atom, then by atom
    end, start, piece, local = end[order], start[order], piece[order], local[order]
    last = np.full(len(joined) + 2, _NONE, dtype=np.int64)
    back, score = np.zeros(len(joined) + 2, dtype=np.int64), np.full(len(joined) + 2, -1e30)
    last[begins], score[begins] = _START, 0.0
    raw = ~vocabulary.alone[vocabulary._keys(joined).astype(np.int64)]
    scores = np.array(vocabulary.scores)
    by_size = np.argsort(-sizes, kind="stable")
    longest_first, falling = begins[by_size], -sizes[by_size]
    bounds = np.searchsorted(local, np.arange(1, int(sizes.max(initial=0)) + 2), side="left").tolist()
    for step, (a, b) in enumerate(zip(bounds, bounds[1:]), start=1):
        e, s, p = end[a:b], start[a:b], piece[a:b]
        before = last[s]
        if vocabulary.bpe:
            good = before < _NONE
            pairs = np.flatnonzero(before >= 0)
            good[pairs] = vocabulary.stay(before[pairs], p[pairs])
            e, s, p = e[good], s[good], p[good]
        else:
            reach = score[s] + scores[p]
            best = np.lexsort((s, -reach, e))
            e, s, p = e[best], s[best], p[best]
            score[e[::-1]] = reach[best][::-1]
        last[e[::-1]], back[e[::-1]] = p[::-1], s[::-1]  # the first of each end stays
        here = longest_first[: np.searchsorted(falling, -step, side="right")] + step
        lone = here[(last[here] == _NONE) & raw[here - 1]]
        last[lone], back[lone], score[lone] = _RAW, lone - 1, score[lone - 1] - 1e6
    return _traced(vocabulary, joined, last, back, begins, begins + sizes)


def _traced(
    vocabulary: Vocabulary, joined: str, last: np.ndarray, back: np.ndarray, begins: np.ndarray, ends: np.ndarray
) -> list[np.ndarray]:
    """Ids on the way back from the end of each atom; all atoms go back together."""
    atom, at = np.arange(len(begins)), ends
    found = []
    while len(atom := atom[going := at > begins[atom]]):
        at = at[going]
        found.append((atom, at))
        at = back[at]
    if not found:
        return [np.empty(0, "<u4")] * len(begins)
    atoms, places = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((places, atoms))
    atoms, places = atoms[order], places[order]
    ids, raw = last[places], np.flatnonzero(last[places] == _RAW)
    counts = np.ones(len(ids), dtype=np.int64)
    if len(raw):
        spelled = [_raw_ids(vocabulary, joined[p - 1]) for p in places[raw].tolist()]
        counts[raw] = [len(x) for x in spelled]
        ids = np.repeat(ids, counts)
        ids[ids == _RAW] = [i for x in spelled for i in x]
    upto = np.cumsum(np.bincount(atoms, counts, len(begins))).astype(np.int64).tolist()
    ids = ids.astype("<u4")
    return [ids[a:b] for a, b in zip([0, *upto], upto)]


def _raw_ids(vocabulary: Vocabulary, character: str) -> list[int]:
    if vocabulary.bytes:
        return [vocabulary.bytes[b] for b in character.encode("utf-8", "surrogatepass")]
    return [vocabulary.unknown]


class Remembered(dict):
    """A memo within bounds: when it is full, what isn't asked for again until the next time is forgotten."""

    def __init__(self):
        super().__init__()
        self.older: dict = {}

    def unknown(self, keys: set[str]) -> list[str]:
        """The keys that are not remembered."""
        if len(self) > _REMEMBERED:
            self.older = dict(self)
            self.clear()
        missing = []
        for key in keys.difference(self):
            found = self.older.get(key)
            if found is None:
                missing.append(key)
            else:
                self[key] = found
        return missing


class PartIds(Remembered):
    """Ids of parts as little-endian unsigned 32-bit bytes."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary, self.of_atom = vocabulary, Remembered()

    def learn(self, parts: set[str]) -> None:
        """Encode the parts that are not remembered yet; their new atoms are indexed together."""
        new = self.unknown(parts)
        cut = list(self.vocabulary.atoms(new))
        pending, held = [], 0
        for atom in self.of_atom.unknown({a for atoms in cut for a in atoms}):
            pending.append(atom)
            held += len(atom) + 1
            if held >= _INDEXED:
                self._encode(pending)
                pending, held = [], 0
        self._encode(pending)
        ids = self.of_atom.__getitem__
        for part, atoms in zip(new, cut):
            self[part] = ids(part) if len(atoms) == 1 else b"".join(map(ids, atoms))

    def _encode(self, atoms: list[str]) -> None:
        for atom, ids in zip(atoms, relax(self.vocabulary, atoms) if atoms else []):
            self.of_atom[atom] = ids.tobytes()


@functools.lru_cache(maxsize=2)
def part_ids(path: str) -> PartIds:
    return PartIds(Vocabulary(path))


def normalise(vocabulary: Vocabulary, text: str) -> str:
    """The text as the model's own rules normalise it, blanks as meta symbols."""
    return vocabulary.processor.normalize(text)


def encode_batch(parts: PartIds, texts: list[str]) -> list[bytes]:
    """Ids of each text as little-endian unsigned 32-bit bytes."""
    normal = [normalise(parts.vocabulary, t) for t in texts]
    cut = [[n] if parts.vocabulary.crossing else _PARTS(n) for n in normal]
    needed = {part for c in cut for part in c}
    parts.learn(needed)
    ids = [b"".join(map(parts.__getitem__, c)) for c in cut]
    return ids if parts.vocabulary.bytes else [_one_unknown(i, parts.vocabulary.unknown) for i in ids]


def _one_unknown(ids: bytes, unknown: int) -> bytes:
    """Neighbouring unknown pieces count as one."""
    values = np.frombuffer(ids, dtype="<u4")
    again = np.zeros(len(values), dtype=bool)
    again[1:] = (values[1:] == unknown) & (values[:-1] == unknown)
    return values[~again].tobytes()


def decode(vocabulary: Vocabulary, ids: bytes) -> str:
    """The text of encoded ids: byte pieces joined, meta symbols as blanks, the first blank dropped."""
    out = b"".join(map(vocabulary.spelled.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))
    text = out.decode("utf-8", "replace").replace(META, " ")
    return text[1:] if text.startswith(" ") else text


def encode(docs: DataFrame, path: str, batch_chars: int = 4_000_000) -> DataFrame:
    """doc_id, ids (array of int) of every document's whole text.

    Null text counts as empty and has no ids. Repeated rows are encoded each;
    empty input gives no rows; further columns are ignored.
    """
    return _encoded(docs, path, batch_chars, lambda _, ids, __: (np.frombuffer(ids, "<u4").tolist(),), "ids array<int>")


def encode_digests(docs: DataFrame, path: str, batch_chars: int = 4_000_000) -> DataFrame:
    """doc_id, n_pieces, ids_crc32, decoded_sha256, round_trip of every document's whole text.

    ``round_trip`` says whether decoding the ids gives the text back; NUL becomes a
    blank and whatever else the model's own normalisation changes is not undone.
    """
    import hashlib

    def row(vocabulary: Vocabulary, ids: bytes, text: str) -> tuple:
        back = decode(vocabulary, ids)
        digest = hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest()
        return len(ids) // 4, zlib.crc32(ids), digest, back == text

    return _encoded(docs, path, batch_chars, row, "n_pieces long, ids_crc32 long, decoded_sha256 string, round_trip boolean")


def _encoded(docs: DataFrame, path: str, batch_chars: int, row, schema: str) -> DataFrame:
    texts = pick(docs, "doc_id", "text").select("doc_id", text_or_empty().alias("text"))
    kind = texts.schema["doc_id"].dataType.simpleString()

    def rows(incoming: Iterator[tuple]) -> Iterator[tuple]:
        parts = part_ids(path)
        pending, held = [], 0

        def flush() -> Iterator[tuple]:
            for (doc_id, text), ids in zip(pending, encode_batch(parts, [t for _, t in pending])):
                yield doc_id, *row(parts.vocabulary, ids, text)

        for doc_id, text in incoming:
            pending.append((doc_id, text))
            held += len(text)
            if held >= batch_chars:
                yield from flush()
                pending, held = [], 0
        yield from flush()

    return arrow_map(texts, rows, f"doc_id {kind}, {schema}", 5000)
