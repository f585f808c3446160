"""Byte-level BPE encoding and decoding by batched merge rounds.

A text is cut into pre-tokens ("words") by the vocabulary's own pattern. The
words that a worker hasn't met before are merged together: the symbols of all of
them lie in one flat array, with the rank of the pair that starts at each place,
found by binary search over the sorted keys of all mergeable pairs. A round takes
each word's lowest rank, merges all its pairs of that rank from the left, closes
the gaps, and looks up only the pairs that a merge has changed. Words without a
mergeable pair leave the array, so it shrinks from round to round.

Equally ranked pairs are merged within one round as the merge order demands: a
pair that holds a merged symbol was learnt later than that symbol, so its rank is
higher than the round's. Overlapping pairs (runs of one symbol) alternate.

Strings of added tokens are their own ids wherever they stand, as in the library.
Texts of any length are encoded in segments that are cut before a blank after a
word, where no pre-token goes across; only text without any blank stays whole.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from huescope.llm.common import TEXT_BYTES, arrow_map, pick, text_or_empty

#: Characters of a segment, at least, and of the texts that are merged together.
SEGMENT, BATCH = 1 << 18, 1 << 20
#: Words that a worker remembers; the memory starts afresh when full.
REMEMBERED = 1_000_000
#: Words of more characters are merged each time they come.
REMEMBERED_LENGTH = 64
_SHIFT = np.int64(32)
_NONE = np.int32((1 << 31) - 1)

# Fixed value: the pre-token pattern of byte-level vocabularies, by classes of blanks, letters and numbers.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[{L}]+| ?[{N}]+| ?[^{S}{L}{N}]+|[{S}]+(?![^{S}])|[{S}]+"
_ANY = regex.compile(_PATTERN.format(S=r"\s", L=r"\p{L}", N=r"\p{N}")).findall
#: The same for texts of these characters only, whose classes are plain ranges: twice as fast.
_IS_LATIN = re.compile("[\0-\x1b\x20-\x84\x86-\xb1\xb4-\xb8\xba\xbb\xbf-\u024f\u2010-\u2027\u2030-\u205e]*").fullmatch
_LATIN = re.compile(
    _PATTERN.format(S="\t-\r \x85\xa0", L="A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", N="0-9")
).findall
_CUT = regex.compile(r"(?<=\S)(?= )")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary file.

    Printable bytes stand for themselves, the others follow from 256 on.
    """
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


def words_of(text: str) -> list[str]:
    """The pre-tokens of a text without added tokens; together they are the text."""
    return _LATIN(text) if _IS_LATIN(text) else _ANY(text)


class Vocabulary:
    """Merge table, byte strings of the ids, and a memory of merged words."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        model, before = content["model"], content["pre_tokenizer"] or {}
        plain = content["normalizer"] is None and before.get("type") == "ByteLevel" and before.get("use_regex", True)
        if not plain or before["add_prefix_space"] or model["type"] != "BPE" or model.get("ignore_merges"):
            raise ValueError(f"not a byte-level vocabulary without prefix blank: {path}")
        ids, letters = model["vocab"], byte_letters()
        number = {letter: b for b, letter in enumerate(letters)}
        self.byte_ids = np.array([ids[letter] for letter in letters], dtype=np.int32)
        added = {t["content"]: t["id"] for t in content["added_tokens"]}
        self.bytes_of = {i: bytes(map(number.__getitem__, token)) for token, i in ids.items()}
        self.bytes_of |= {i: _token_bytes(token, number) for token, i in added.items()}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        keys = np.array([ids[a] << 32 | ids[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.made = np.array([ids[a + b] for a, b in pairs], dtype=np.int32)[order]
        self.added = {token: np.uint32(i).astype("<u4").tobytes() for token, i in added.items()}
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")").split
        self.can_cut = not any(regex.search(r"\s", token) for token in added)
        self.memory: dict[str, bytes] = {}

    def lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (``_NONE`` if not mergeable) and merged symbol of each pair, by binary search."""
        key = left.astype(np.int64) << _SHIFT | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        found = self.keys[at] == key
        return np.where(found, self.ranks[at], _NONE), self.made[at]


def _token_bytes(token: str, number: dict[str, int]) -> bytes:
    """Bytes that a token decodes to; a token with other letters stands for its own text."""
    return bytes(number[c] for c in token) if all(c in number for c in token) else token.encode()


def merge_words(vocabulary: Vocabulary, words: list[bytes]) -> list[bytes]:
    """The ids of each non-empty word, as little-endian unsigned 32-bit numbers."""
    if not words:
        return []
    symbol = vocabulary.byte_ids[np.frombuffer(b"".join(words), dtype=np.uint8)]
    length = np.array([len(w) for w in words])
    owner = np.repeat(np.arange(len(words), dtype=np.int32), length)
    inside = np.append(owner[1:] == owner[:-1], False)
    rank, made = np.full(len(symbol), _NONE), np.zeros(len(symbol), np.int32)
    rank[inside], made[inside] = vocabulary.lookup(symbol[inside], symbol[1:][inside[:-1]])
    finished: list[tuple[np.ndarray, np.ndarray]] = []
    while len(symbol):
        lowest = np.minimum.reduceat(rank, np.cumsum(length) - length)
        over = lowest == _NONE
        if over.any():
            gone = np.repeat(over, length)
            finished.append((owner[gone], symbol[gone]))
            symbol, owner, rank, made = (x[~gone] for x in (symbol, owner, rank, made))
            lowest, length = lowest[~over], length[~over]
            if not len(symbol):
                break
        at = _alternating(np.flatnonzero(rank == np.repeat(lowest, length)))
        symbol[at] = made[at]
        stays = np.ones(len(symbol), bool)
        stays[at + 1] = False
        length -= np.add.reduceat(~stays, np.cumsum(length) - length, dtype=np.int64)
        symbol, owner, rank, made = (x[stays] for x in (symbol, owner, rank, made))
        at = at - np.arange(len(at))  # as many symbols are gone before each
        changed = np.concatenate([at, at[at > 0] - 1])
        rank[changed] = _NONE
        changed = changed[changed + 1 < len(symbol)]
        changed = changed[owner[changed] == owner[changed + 1]]
        rank[changed], made[changed] = vocabulary.lookup(symbol[changed], symbol[changed + 1])
    owner = np.concatenate([o for o, _ in finished])
    order = np.argsort(owner, kind="stable")
    ids = np.concatenate([s for _, s in finished])[order].astype("<u4").tobytes()
    ends = np.cumsum(np.bincount(owner, minlength=len(words))) * 4
    return [ids[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]


def _alternating(at: np.ndarray) -> np.ndarray:
    """Every other place of each run of neighbouring places, from its first."""
    if len(at) < 2:
        return at
    begins = np.append(True, np.diff(at) > 1)
    run_start = np.maximum.accumulate(np.where(begins, np.arange(len(at)), 0))
    return at[(np.arange(len(at)) - run_start) % 2 == 0]


def encode_batch(vocabulary: Vocabulary, texts: list[str]) -> list[bytes]:
    """The ids of each text, as little-endian unsigned 32-bit numbers."""
    memory, new, parts = vocabulary.memory, set(), []
    if len(memory) > REMEMBERED:
        memory.clear()
    for text in texts:
        pieces = vocabulary.split(text) if vocabulary.added else [text]
        parts.append([])
        for i, piece in enumerate(pieces):
            words = [] if i % 2 else words_of(piece)
            ids = [vocabulary.added[piece]] if i % 2 else list(map(memory.get, words))
            if None in ids:
                new.update(w for w, known in zip(words, ids) if known is None)
                ids = None
            parts[-1].append((words, ids))
    new = list(new)
    memory.update(zip(new, merge_words(vocabulary, [w.encode() for w in new])))
    encoded = [b"".join([b"".join(ids or map(memory.__getitem__, words)) for words, ids in pieces]) for pieces in parts]
    for word in new:
        if len(word) > REMEMBERED_LENGTH:
            del memory[word]
    return encoded


def decode_bytes(vocabulary: Vocabulary, ids: bytes) -> bytes:
    """The bytes that ids stand for; an unknown id stands for nothing, as in the library."""
    known = vocabulary.bytes_of
    return b"".join([known.get(i, b"") for i in np.frombuffer(ids, "<u4").tolist()])


def segments(text: str, can_cut: bool = True) -> Iterator[str]:
    """The text in order, cut before a blank that follows a word, every ``SEGMENT`` characters or more."""
    begin = 0
    while can_cut and len(text) - begin > 2 * SEGMENT and (cut := _CUT.search(text, begin + SEGMENT)):
        yield text[begin : cut.start()]
        begin = cut.start()
    yield text[begin:] if begin else text


@functools.lru_cache(maxsize=2)
def vocabulary_of(path: str) -> Vocabulary:
    """One vocabulary and memory per worker process."""
    return Vocabulary(path)


def _encoded(vocabulary: Vocabulary, rows: Iterator[tuple]) -> Iterator[tuple]:
    """(doc_id, part, last, ids) of each segment of rows (doc_id, text), in order."""
    pending: list[tuple] = []
    held = 0

    def ready() -> Iterator[tuple]:
        for (doc_id, part, last, _), ids in zip(pending, encode_batch(vocabulary, [p[3] for p in pending])):
            yield doc_id, part, last, ids

    for doc_id, text in rows:
        part, before = 0, None
        for segment in segments(text, vocabulary.can_cut):
            if before is not None:
                pending.append((doc_id, part, False, before))
                part += 1
            before = segment
            held += len(segment) + 16
            if held >= BATCH:
                yield from ready()
                pending, held = [], len(segment)
        pending.append((doc_id, part, True, before))
    yield from ready()


def _texts(docs: DataFrame) -> tuple[DataFrame, str]:
    texts = pick(docs, "doc_id", "text").select("doc_id", text_or_empty().alias("text"))
    return texts, texts.schema["doc_id"].dataType.simpleString()


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, part, last, ids: the ids of every whole text, binary, long texts in several parts.

    The concatenated parts are the ids that the library gives for the whole text
    without special tokens around it. Null text counts as empty and gives one
    part without ids. Repeated rows are encoded each; null ids are kept; empty
    input gives no rows; further columns are ignored.
    """
    texts, kind = _texts(docs)
    schema = f"doc_id {kind}, part int, last boolean, ids binary"
    return arrow_map(texts, lambda rows: _encoded(vocabulary_of(path), rows), schema, 2000, TEXT_BYTES)


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, part, last, text of rows as ``encode_documents`` gives them.

    Each part decodes by itself, since parts end where a word does.
    """
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def rows(incoming: Iterator[tuple]) -> Iterator[tuple]:
        vocabulary = vocabulary_of(path)
        for doc_id, part, last, ids in incoming:
            yield doc_id, part, last, decode_bytes(vocabulary, ids).decode("utf-8", "replace")

    chosen = pick(encoded, "doc_id", "part", "last", "ids")
    return arrow_map(chosen, rows, f"doc_id {kind}, part int, last boolean, text string", 2000, TEXT_BYTES)


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text.

    The digests are of the ids and of the text decoded from them, updated part by
    part; rows as for ``encode_documents``.
    """
    texts, kind = _texts(docs)

    def rows(incoming: Iterator[tuple]) -> Iterator[tuple]:
        vocabulary = vocabulary_of(path)
        of_ids, of_text, count = hashlib.sha256(), hashlib.sha256(), 0
        reader = codecs.getincrementaldecoder("utf-8")("replace")
        for doc_id, _, last, ids in _encoded(vocabulary, incoming):
            of_ids.update(ids)
            of_text.update(reader.decode(decode_bytes(vocabulary, ids), last).encode())
            count += len(ids) // 4
            if last:
                yield doc_id, count, of_ids.hexdigest(), of_text.hexdigest()
                of_ids, of_text, count = hashlib.sha256(), hashlib.sha256(), 0
                reader.reset()

    return arrow_map(texts, rows, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string", 5_000)
