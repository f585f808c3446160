"""Ids and decoded texts against the library."""

import random
import zlib
from collections import Counter

import edge
import numpy as np
import public_tokenizers
import sentencepiece

from huescope.llm import sentencepieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)


def texts():
    chance = random.Random(6)
    out = ["", " ", "  a  b ", "▁x ▁", "<s></s><unk><0x41>", "a" * 3000, "漢字😀é́", "tab\t\ttab\n\n x\0y"]
    out += [r[1] or "" for r in edge.rows()]
    letters = "abcdethein  .,éß\n漢1😀▁(){}"
    return out + ["".join(chance.choice(letters) for _ in range(chance.randint(0, 70))) for _ in range(1500)]


def test_ids_and_texts_are_the_librarys():
    given = texts()
    found = sentencepieces.encode_batch(sentencepieces.part_ids(PATH), given)
    want = LIBRARY.encode(given)
    assert [np.frombuffer(f, "<u4").tolist() for f in found] == want
    vocabulary = sentencepieces.part_ids(PATH).vocabulary
    assert [sentencepieces.decode(vocabulary, f) for f in found] == LIBRARY.decode(want)


def test_frequent_words_outlive_a_full_memo(monkeypatch):
    monkeypatch.setattr(sentencepieces, "_REMEMBERED", 60)
    relax, encoded, chance = sentencepieces.relax, Counter(), random.Random(8)

    def counted(vocabulary, atoms):
        encoded.update(atoms)
        return relax(vocabulary, atoms)

    monkeypatch.setattr(sentencepieces, "relax", counted)
    parts = sentencepieces.PartIds(sentencepieces.part_ids(PATH).vocabulary)
    for _ in range(30):
        given = ["the same words", "".join(chance.choice("abcdethein  .é\n漢") for _ in range(200)), ""]
        found = sentencepieces.encode_batch(parts, given)
        assert [np.frombuffer(f, "<u4").tolist() for f in found] == LIBRARY.encode(given)
    assert encoded["▁same"] == encoded["▁words"] == 1
    assert len(encoded) > 300 and len(parts) + len(parts.older) < 300


def test_best_path_of_a_unigram_model():
    """The relaxation for unigram models, on a vocabulary of random scores."""
    chance = random.Random(7)
    vocabulary = sentencepieces.Vocabulary(PATH)
    vocabulary.bpe = False
    vocabulary.scores = [-chance.uniform(1, 12) for _ in vocabulary.scores]
    given = ["".join(chance.choice("thein aors") for _ in range(chance.randint(1, 14))) for _ in range(150)]
    for text, ids in zip(given, sentencepieces.relax(vocabulary, given)):
        best = [0.0] + [-1e30] * len(text)
        for end in range(1, len(text) + 1):
            for start in range(end):
                piece = vocabulary.ids.get(text[start:end])
                if piece is not None:
                    best[end] = max(best[end], best[start] + vocabulary.scores[piece])
            if best[end] < -1e29:
                best[end] = best[end - 1] - 1e6
        score = sum(vocabulary.scores[i] for i in ids if i not in vocabulary.bytes.values())
        assert score == best[-1] or abs(score - best[-1] % -1e6) < 1e-6


def test_documents(docs, no_docs):
    found = sorted([tuple(r)[:3] for r in sentencepieces.encode_digests(docs, PATH).collect()], key=edge.key)
    want = []
    for r in edge.rows():
        ids = np.array(LIBRARY.encode(r[1] or ""), "<u4")
        want.append((r[0], len(ids), zlib.crc32(ids.tobytes())))
    assert found == sorted(want, key=edge.key)
    assert sentencepieces.encode(no_docs, PATH).count() == 0
    assert sentencepieces.encode(docs, PATH).count() == len(edge.rows())
