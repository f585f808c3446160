"""Toxicity severity and the Kneser-Ney model."""

import math
import random
from collections import Counter, defaultdict

import edge
import numpy as np
import pytest

from huescope.llm import kneser_ney, toxicity


def prose(chance, words):
    return " ".join("".join(chance.choice(["an", "re", "ti", "ou", "be", "lo"]) for _ in range(3)) for _ in range(words))


@pytest.fixture(scope="module")
def labelled(spark):
    chance = random.Random(1)
    rows, labels = [], []
    for i in range(900):
        words, toxic = prose(chance, 60).split(), int(i % 5 == 0)
        for _ in range(toxic * chance.randint(2, 9)):
            words[chance.randrange(len(words))] = chance.choice(["vile", "foul", "awful"])
        rows.append((i, " ".join(words), "en", "s", 0, 0, "", ""))
        if i < 600:
            labels.append((i, toxic, "x"))
    return edge.frame(spark, rows), spark.createDataFrame(labels + [(None, 1, ""), (5, None, "")], "doc_id long, toxic int, TOXIC string")


def test_held_out_documents(labelled):
    docs, labels = labelled
    model = toxicity.fit(docs, labels)
    assert list(model.cuts) == sorted(model.cuts) and {"vile", "foul", "awful"} <= model.marking
    found = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    assert all(found[i]["kept"] == (i % 5 != 0) for i in range(600, 900))
    text = {r[0]: r[1] for r in docs.collect()}
    by_hits = defaultdict(list)
    for i in range(600, 900, 5):
        by_hits[sum(text[i].split().count(w) for w in ("vile", "foul", "awful"))].append(found[i]["expected_severity"])
    means = [sum(v) / len(v) for _, v in sorted(by_hits.items())]
    assert means[-1] > means[0] + 1
    assert {r[0] for r in toxicity.drop_toxic(docs, labels).collect()} >= {i for i in range(600, 900) if i % 5}


def test_score_of_edge_rows_and_without_labels(spark, docs, no_docs, labelled):
    _, labels = labelled
    model = toxicity.fit(docs, labels.limit(0))
    found = toxicity.score(docs, model)
    assert found.count() == len(edge.rows()) and found.where("not kept").count() == 0
    assert toxicity.score(no_docs, model).count() == 0
    assert toxicity.drop_toxic(docs, labels.limit(0)).count() == len(edge.rows())
    assert toxicity.fit(no_docs, labels).words == {}


def test_gradient_reaches_the_ordinal_maximum():
    rng = np.random.default_rng(2)
    x = rng.normal(size=3000)
    noise = np.log(1 / rng.random(3000) - 1)
    grade = np.searchsorted([-1.0, 0.5, 2.0], 1.5 * x - noise)
    at = np.zeros(3000, int)
    weights, cuts = toxicity.fit_cumulative(np.arange(3000), at, x, grade, 1)
    assert abs(weights[0] - 1.5) < 0.15 and np.abs(cuts - [-1.0, 0.5, 2.0]).max() < 0.2


def plain_model(texts, order):
    """Interpolated modified Kneser-Ney by its definition, on strings."""
    top = Counter()
    for t in texts:
        padded = "\n" * (order - 1) + t
        top.update(padded[i : i + order] for i in range(len(t)))
    counts = {order: top}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    discounts = {}
    for k, c in counts.items():
        n = [max(1, sum(v == i for v in c.values())) for i in range(1, 5)]
        y = n[0] / (n[0] + 2 * n[1])
        discounts[k] = [0.0] + [min(max(i - (i + 1) * y * n[i] / n[i - 1], 0.0), float(i)) for i in (1, 2, 3)]
    follow = {k: defaultdict(list) for k in counts}
    for k, c in counts.items():
        for g, v in c.items():
            follow[k][g[:-1]].append(v)

    def chance(g):
        k = len(g)
        below = chance(g[1:]) if k > 1 else 1 / (len(counts[1]) + 1)
        values = follow[k].get(g[:-1])
        if not values:
            return below
        d, c = discounts[k], counts[k].get(g, 0)
        return (max(c - d[min(c, 3)], 0) + sum(d[min(v, 3)] for v in values) * below) / sum(values)

    return chance


def test_kneser_ney_by_definition(spark):
    chance = random.Random(8)
    order = 3
    texts = {lang: [prose(chance, chance.randint(1, 30)) for _ in range(40)] for lang in ("en", "de")}
    rows = [(i, t, lang, "s", 0, 0, "", "") for lang in texts for i, t in enumerate(texts[lang], 100 * (lang == "de"))]
    rows += [(500, "new words, unseen 漢字", "en", "s", 0, 0, "", ""), (501, None, "en", "s", 0, 0, "", ""), (502, "x", "fr", "s", 0, 0, "", "")]
    trusted = spark.createDataFrame([(r[0],) for r in rows if r[0] < 500 and r[0] % 2 == 0], "doc_id long")
    found = kneser_ney.score_documents(edge.frame(spark, rows), trusted, order=order)
    scored = {r["doc_id"]: r for r in found.collect()}
    ids = spark.createDataFrame([(r[0],) for r in rows], "doc_id long")
    held = {
        r[0]
        for r in ids.selectExpr("doc_id", f"pmod(xxhash64(doc_id, 'held out'), {kneser_ney.HELD_OUT}) AS h").collect()
        if r[1] == 0
    }
    for lang in texts:
        model = plain_model([r[1] for r in rows if r[2] == lang and r[0] < 500 and r[0] % 2 == 0 and r[0] not in held], order)
        for r in rows:
            if r[2] == lang and r[1]:
                padded = "\n" * (order - 1) + r[1]
                logs = [math.log(model(padded[i : i + order])) for i in range(len(r[1]))]
                want = math.exp(-sum(logs) / len(logs))
                assert abs(scored[r[0]]["perplexity"] - want) < 1e-4 * want
    assert scored[501]["perplexity"] is None and scored[501]["kept"]
    assert scored[502]["perplexity"] is None and scored[502]["kept"]


def test_slices_have_each_n_gram_once(monkeypatch):
    chance = random.Random(3)
    for order in (1, 2, 4):
        for size in (1, 2, 3, 7, 1000):
            monkeypatch.setattr(kneser_ney, "_SLICE", size)
            text = "".join(chance.choice("abcé漢") for _ in range(60))
            padded = "\n" * (order - 1) + text
            found = Counter()
            for gram, count in zip(*kneser_ney._grams_of(list(kneser_ney._slices(text, order)), order)):
                found[gram] += count
            assert found == Counter(padded[i : i + order] for i in range(len(text)))


def test_thresholds_and_verdicts_by_definition(spark):
    """Steadied perplexities, their quantile over held-out documents and the verdict, recomputed from the scores."""
    chance = random.Random(12)
    rows = [(i, prose(chance, chance.randint(1, 40)), "en", "s", 0, 0, "", "") for i in range(300)]
    rows += [(1000 + i, "".join(chance.choice("xqzjk #|") for _ in range(300)), "en", "s", 0, 0, "", "") for i in range(20)]
    trusted = spark.createDataFrame([(i,) for i in range(300)], "doc_id long")
    found = {r["doc_id"]: r for r in kneser_ney.score_documents(edge.frame(spark, rows), trusted, order=3, quantile=0.9).collect()}
    ids = spark.createDataFrame([(r[0],) for r in rows[:300]], "doc_id long")
    marks = ids.selectExpr("doc_id", f"pmod(xxhash64(doc_id, 'held out'), {kneser_ney.HELD_OUT}) AS h").collect()
    held = [r["doc_id"] for r in marks if r["h"] == 0]
    loss = {r[0]: math.log(found[r[0]]["perplexity"]) * len(r[1]) for r in rows}
    size = {r[0]: len(r[1]) for r in rows}
    mean = sum(loss[i] for i in held) / sum(size[i] for i in held)
    extra = kneser_ney.STEADY
    steadied = {i: math.exp((loss[i] + extra * mean) / (size[i] + extra)) for i in loss}
    limit = sorted(steadied[i] for i in held)[math.ceil(0.9 * len(held)) - 1]
    for i, r in found.items():
        assert abs(r["steadied"] - steadied[i]) < 1e-3 * steadied[i] and abs(r["threshold"] - limit) < 1e-3 * limit
        assert r["kept"] == (r["steadied"] <= r["threshold"] + 5e-7) and (i < 1000 or not r["kept"])
    assert sum(r["kept"] for i, r in found.items() if i in held) >= 0.9 * len(held)


def test_kneser_ney_edge_rows(spark, docs, no_docs):
    trusted = spark.createDataFrame([(i,) for i in range(100, 140)] + [(None,)], "doc_id long")
    found = kneser_ney.score_documents(docs, trusted)
    assert found.count() == len(edge.rows())
    assert kneser_ney.score_documents(no_docs, trusted).count() == 0
    assert kneser_ney.score_documents(docs, trusted.limit(0)).where("not kept").count() == 0
