"""Statistics against plain counting; the estimate against outliers that it must resist."""

import re
import random
from collections import Counter

import edge
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from huescope.llm import quality_rules as rules


def plain(text):
    words = re.findall("[^\x20\x09-\x0d]+", text)
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            repeated += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    marked = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), repeated, len(marked)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab \n\t#|é\xa0\x1c", max_size=80))
def test_statistics(text):
    assert rules.statistics(text)[:5] == plain(text)


def test_documents(docs):
    found = sorted([tuple(r)[:7] for r in rules.quality_rules(docs).collect()], key=edge.key)
    want = []
    for r in edge.rows():
        s = plain(r[1] or "")
        want.append((r[0], *s, s[0] < 10 or 100 * s[4] > 20 * s[0]))
    assert found == sorted(want, key=edge.key)
    assert all(not r["kept"] for r in rules.quality_rules(docs).collect() if r["base_failed"])


def test_nothing(no_docs):
    assert rules.quality_rules(no_docs).count() == 0


def test_outliers_do_not_move_the_estimate(spark):
    rng = np.random.default_rng(0)
    data = []
    for i in range(1200):
        words = ["".join(rng.choice(list("abcdefgh"), rng.integers(2, 8))) for _ in range(rng.integers(40, 200))]
        text = " ".join(words)
        if i % 7 == 0:  # a seventh is junk in capitals and symbols
            text = text.upper().replace(" ", "$$$ ")
        data.append((i, text, "en", "a" if i % 2 else "b", 0, 0, "", ""))
    verdict = {r["doc_id"]: r["kept"] for r in rules.quality_rules(edge.frame(spark, data)).collect()}
    assert not any(verdict[i] for i in range(0, 1200, 7))
    assert all(verdict[i] for i in range(1200) if i % 7)


def test_concentration_finds_the_least_determinant(spark):
    """On a small group the estimate is as tight as the best of many starts."""
    rng = np.random.default_rng(3)
    core = rng.normal(0, 2, (170, rules.DIMENSIONS))
    data = np.vstack([core, rng.normal(25, 1, (30, rules.DIMENSIONS))])
    frame = spark.createDataFrame(
        [("=en", "=a", *map(float, row)) for row in data], "lang_of string, source_of string, " + ", ".join(f"{v} double" for v in rules._V)
    )
    found = rules.robust_estimates(frame).first()
    assert np.abs(np.array(found["centre"])).max() < 1.0

    def determinant(rows):
        return np.linalg.slogdet(rules.floored(np.cov(rows.T, bias=True)))[1]

    best = np.inf
    for _ in range(30):
        chosen = data[rng.choice(len(data), 10, replace=False)]
        for _ in range(20):
            inverse = np.linalg.inv(rules.floored(np.cov(chosen.T, bias=True)))
            gaps = data - chosen.mean(axis=0)
            distance = np.einsum("ij,jk,ik->i", gaps, inverse, gaps)
            chosen = data[np.argsort(distance)[: int(rules.SHARE * len(data))]]
        best = min(best, determinant(chosen))
    assert found["log_det"] < best + 0.5


def test_a_step_reads_every_row_once(spark, monkeypatch):
    """Mean and covariance come from the bands' sums, which don't grow with the rows."""
    rng = np.random.default_rng(5)
    data = [("=en", f"={i % 2}", *map(float, row)) for i, row in enumerate(rng.normal(0, 2, (4000, rules.DIMENSIONS)))]
    schema = "lang_of string, source_of string, " + ", ".join(f"{v} double" for v in rules._V)
    entering, passes, moments, banded = [], [], rules._moments, rules._banded
    monkeypatch.setattr(rules, "_moments", lambda rows: entering.append(rows.count()) or moments(rows))
    monkeypatch.setattr(rules, "_banded", lambda *given: passes.append(1) or banded(*given))
    final = {r["source_of"]: r for r in rules.robust_estimates(spark.createDataFrame(data, schema)).collect()}
    assert max(entering) < 600 and len(passes) == len(entering) + 1
    assert len(final) == 2 and all(np.abs(r["centre"]).max() < 0.3 for r in final.values())


def test_floors_raise_small_variances_only():
    rng = np.random.default_rng(4)
    data = rng.normal(size=(500, rules.DIMENSIONS)) * np.array(rules.FLOORS) * [3, 3, 0.01, 0, 2, 2]
    data[:, 5] = 2 * data[:, 4]  # in lockstep
    cov = np.cov(data.T, bias=True)
    found = rules.floored(cov)
    want = np.maximum(np.diag(cov), np.square(rules.FLOORS))
    assert np.allclose(np.diag(found), want) and np.allclose(found[:2, :2], cov[:2, :2], rtol=1e-5)
    assert np.linalg.eigvalsh(found).min() > 0


def test_all_capitals_are_rejected_and_groups_do_not_depend_on_others(spark):
    chance = random.Random(9)

    def text():
        words = [" ".join("".join(chance.choice("aeioulnrst") for _ in range(chance.randint(2, 9))) for _ in range(12)) for _ in range(8)]
        return ".\n".join(w.capitalize() for w in words)

    rows = [(i, text(), "en", "s", 0, 0, "", "") for i in range(400)]
    rows[7] = (7, rows[7][1].upper(), "en", "s", 0, 0, "", "")
    alone = {r["doc_id"]: (r["kept"], r["distance"]) for r in rules.quality_rules(edge.frame(spark, rows)).collect()}
    assert not alone[7][0] and sum(kept for kept, _ in alone.values()) > 390
    more = rows + [(1000 + i, text() + " #" * chance.randint(0, 9), "de", f"s{i % 3}", 0, 0, "", "") for i in range(600)]
    beside = {r["doc_id"]: (r["kept"], r["distance"]) for r in rules.quality_rules(edge.frame(spark, more)).collect()}
    for i, (kept, distance) in alone.items():
        assert beside[i][0] == kept and abs(beside[i][1] - distance) <= 0.02 * (1 + distance)
