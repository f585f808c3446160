"""Ids and decoded texts against the library."""

import hashlib
import random

import edge
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from huescope.llm import byte_pairs

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


def ids_of(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


def texts():
    chance = random.Random(6)
    out = ["", " ", "  a  b ", "a" * 3000, "abab" * 700, "漢字😀é́", "tab\t\ttab\n\n x\0y\x1c\x85", "it's we'll I'd 'S"]
    out += ["<|endoftext|>", "a <|endoftext|><|endoftext|> b", "<|endoftext|", "½²Ⅷ٣ 12.5"] + [r[1] or "" for r in edge.rows()]
    letters = "abcdethein  .,éß\n漢1😀(){}'s\xa0½"
    return out + ["".join(chance.choice(letters) for _ in range(chance.randint(0, 90))) for _ in range(2000)]


def test_ids_and_texts_are_the_librarys():
    vocabulary, given = byte_pairs.Vocabulary(PATH), texts()
    found = byte_pairs.encode_batch(vocabulary, given)
    want = [ids_of(t) for t in given]
    assert [np.frombuffer(f, "<u4").tolist() for f in found] == want
    decoded = [byte_pairs.decode_bytes(vocabulary, f).decode("utf-8", "replace") for f in found]
    assert decoded == [LIBRARY.decode(w, skip_special_tokens=False) for w in want]


def test_ids_in_any_order_decode_as_in_the_library():
    vocabulary, chance = byte_pairs.Vocabulary(PATH), random.Random(8)
    for _ in range(300):
        ids = [chance.randrange(50_300) for _ in range(12)]
        found = byte_pairs.decode_bytes(vocabulary, np.array(ids, "<u4").tobytes()).decode("utf-8", "replace")
        assert found == LIBRARY.decode(ids, skip_special_tokens=False)


def test_latin_words_are_the_patterns():
    chance = random.Random(9)
    latin = [chr(c) for c in range(0x250) if byte_pairs._IS_LATIN(chr(c))] + list("‐—’…  's't")
    for _ in range(3000):
        text = "".join(chance.choice(latin) for _ in range(chance.randint(0, 40)))
        assert byte_pairs._LATIN(text) == byte_pairs._ANY(text)


def test_memory_that_starts_afresh(monkeypatch):
    monkeypatch.setattr(byte_pairs, "REMEMBERED", 50)
    vocabulary, given = byte_pairs.Vocabulary(PATH), texts()
    for start in range(0, len(given), 100):
        some = given[start : start + 100]
        assert [np.frombuffer(f, "<u4").tolist() for f in byte_pairs.encode_batch(vocabulary, some)] == [ids_of(t) for t in some]


def test_segments_keep_the_ids(monkeypatch):
    monkeypatch.setattr(byte_pairs, "SEGMENT", 40)
    vocabulary = byte_pairs.Vocabulary(PATH)
    for text in texts()[-400:] + ["one two   three\n four <|endoftext|> five " * 30, "x" * 500 + " " * 300]:
        parts = list(byte_pairs.segments(text))
        assert "".join(parts) == text
        assert [i for f in byte_pairs.encode_batch(vocabulary, parts) for i in np.frombuffer(f, "<u4").tolist()] == ids_of(text)


def test_documents(docs, no_docs, monkeypatch):
    found = sorted([tuple(r) for r in byte_pairs.encode_digests(docs, PATH).collect()], key=edge.key)
    want = []
    for r in edge.rows():
        ids = ids_of(r[1] or "")
        decoded = LIBRARY.decode(ids, skip_special_tokens=False)
        digests = hashlib.sha256(np.array(ids, "<u4").tobytes()), hashlib.sha256(decoded.encode())
        want.append((r[0], len(ids), *[d.hexdigest() for d in digests]))
    assert found == sorted(want, key=edge.key)
    assert byte_pairs.encode_digests(no_docs, PATH).collect() == []


def test_encoded_documents_decode_to_their_texts(docs):
    encoded = byte_pairs.encode_documents(docs, PATH)
    parts = byte_pairs.decode_documents(encoded, PATH).collect()
    assert sorted([(p["doc_id"], p["text"]) for p in parts], key=edge.key) == sorted(
        [(r[0], r[1] or "") for r in edge.rows()], key=edge.key
    )
    long = [p for p in encoded.where("doc_id = 7").orderBy("part").collect()]
    assert [p["last"] for p in long] == [False] * (len(long) - 1) + [True]


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        byte_pairs.Vocabulary(public_tokenizers.path("word_bpe_49k.json"))
