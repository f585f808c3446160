"""Packing against the tokenizer itself and a plain best-fit decreasing."""

import bisect
import random
import zlib
from collections import defaultdict

import edge
import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from huescope.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def best_fit(lengths, capacity):
    left = []
    for n in sorted(lengths, reverse=True):
        i = bisect.bisect_left(left, n)
        bisect.insort(left, (left.pop(i) if i < len(left) else capacity) - n)
    return len(left)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=120))
def test_plan_is_best_fit_decreasing(lengths):
    counts = defaultdict(int)
    for n in lengths:
        counts[n] += 1
    plan = packing.plan_packing(dict(counts), 40)
    placed, filled = defaultdict(int), defaultdict(list)
    for length, rank, count, first, offset in plan:
        assert rank == placed[length]
        placed[length] += count
        for b in range(first, first + count):
            filled[b].append((offset, length))
    assert dict(placed) == dict(counts)
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 40
    assert len(filled) == best_fit(lengths, 40)


def test_last_bin_of_a_length_is_filled_first():
    plan = packing.plan_packing({4: 4, 3: 2, 2: 1}, 12)
    assert sorted({b for _, _, count, first, _ in plan for b in range(first, first + count)}) == [0, 1]
    chance = random.Random(4)
    for _ in range(500):
        counts = {n: chance.randint(1, 30) for n in chance.sample(range(1, 41), chance.randint(1, 12))}
        plan = packing.plan_packing(counts, 40)
        lengths = [n for n, count in counts.items() for _ in range(count)]
        assert 1 + max(first + count - 1 for _, _, count, first, _ in plan) == best_fit(lengths, 40)


def test_tightest_open_bin():
    tree = packing._Tightest(100)
    assert tree.find(1) is None
    for n in (7, 50, 100):
        tree.mark(n, True)
    assert [tree.find(n) for n in (1, 7, 8, 50, 51, 100)] == [7, 7, 50, 50, 100, 100]
    tree.mark(50, False)
    assert tree.find(8) == 100


def test_ids_are_the_tokenizers():
    chance = random.Random(2)
    letters = "abcDEé ßÀñ 't'l's12 .,!-\n\t\x1c\xa0漢😀éΣς<|endoftext|>"
    texts = ["", " ", "don't 'S x's", "<|endoftext|> a<|startoftext|>b", "ſ µ ª º × ÷ ÿ Ÿ", "a" * 300]
    texts += ["".join(chance.choice(letters) for _ in range(chance.randint(0, 80))) for _ in range(800)]
    tokenizer, words = Tokenizer.from_file(PATH), packing.word_ids(PATH)
    for text in texts:
        want = tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(words.ids(text), "<u4").tolist() == want, text


def test_packed_rows(docs):
    tokenizer, want = Tokenizer.from_file(PATH), []
    for r in edge.rows():
        ids = np.array([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4")
        for n, start in enumerate(range(0, len(ids), 4096)):
            part = ids[start : start + 4096]
            want.append((r[0], n, start, len(part), zlib.crc32(part.tobytes())))
    found = packing.pack(docs, PATH, salts=3).collect()
    assert sorted([tuple(r)[:5] for r in found], key=edge.key) == sorted(want, key=edge.key)
    bins = defaultdict(list)
    for r in found:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(bins) == best_fit([w[3] for w in want], 4096)


def test_nothing_to_pack(no_docs):
    assert packing.pack(no_docs, PATH).count() == 0
