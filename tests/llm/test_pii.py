"""Base spans against plain patterns; reliabilities and the added spans."""

import hashlib
import random
import re

import edge
import numpy as np

from huescope.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    doubled = [int(d) * 2 if i % 2 else int(d) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def plain(text):
    def digits(s):
        return re.sub("[^0-9]", "", s)

    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) < 256 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits(m[0])) <= 15]


def test_base_spans_of_random_texts():
    chance = random.Random(4)
    alphabets = ["a.@-_b1", "0123456789. -", "+1 ().-2é", "4111 -", "a@b.c 1.2.3.4+55 55 55 5"]
    texts = ["".join(chance.choice(a) for _ in range(chance.randint(0, 60))) for a in alphabets for _ in range(1500)]
    texts += ["4111 1111 1111 1111", "a@b@c.d e@f.g.", "1.2.3.4.5.6.7.8", "٣.٣.٣.٣", "1." * 5000, "1" * 50_000, "a" * 50_000 + "@"]
    for text in texts:
        assert pii.base_and_failed(text)[0] == plain(text), text


def test_documents(docs):
    found = {(r[0], *r[1:6]) for r in pii.find_personal_data(docs).collect()}
    want = set()
    for r in edge.rows():
        spans = plain(r[1] or "")
        digest = hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
        want.add((r[0], *[sum(s[0] == k for s in spans) for k in pii.BASE], digest))
    assert found == want
    assert pii.find_personal_data(docs).count() == len(edge.rows())


def test_nothing(no_docs):
    assert pii.find_personal_data(no_docs).count() == 0
    assert pii.redact(no_docs).columns == no_docs.columns


def test_reliabilities_are_recovered():
    rng = np.random.default_rng(1)
    truth = rng.random(20_000) < 0.3
    skill = [0.95, 0.8, 0.9, 0.7, 0.85, 0.6]
    patterns = {}
    for t in truth:
        votes = tuple(int(1 if (t == (rng.random() < s)) else -1) for s in skill)
        patterns[votes] = patterns.get(votes, 0) + 1
    prior, table = pii.estimate_reliabilities(patterns)
    assert abs(prior - 0.3) < 0.03
    for j, s in enumerate(skill):
        assert abs(table[1, j, 2] - s) < 0.05 and abs(table[0, j, 0] - s) < 0.05


def test_added_spans_and_redaction(spark):
    lines = []
    for i in range(300):
        lines += [f"write to user{i}@mail.example.com now", f"call +1 (212) 555-{1000 + i} today", f"Version 2.{i} of 200{i % 10}"]
        lines += [f"password={'%08x' % (i * 7919)}aa ok", f"key AKIAB{'%015d' % i} x", f"number {4000000000000000 + i} y"]
    frame = edge.frame(spark, [(i, t, "en", "s", len(t), 1, "", "") for i, t in enumerate(lines)])
    spans = {r["doc_id"]: r["spans"] for r in pii.find_personal_data(frame).collect()}
    assert all(spans[i].startswith("email:9:") for i in range(0, 1800, 6))
    assert all(spans[i] == "" for i in range(2, 1800, 6))
    assert all(spans[i].startswith("credential:0:") for i in range(3, 1800, 6))
    assert all(spans[i].startswith("credential:4:24") for i in range(4, 1800, 6))
    texts = {r["doc_id"]: (r["text"], r["n_chars"]) for r in pii.redact(frame).collect()}
    assert texts[0] == ("write to <EMAIL> now", 20)
    assert texts[3][0] == "<CREDENTIAL> ok"
