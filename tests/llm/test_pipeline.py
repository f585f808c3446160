"""The registered queries and the pipeline on the smallest tables."""

import re

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from harness.compare import database, difference
from huescope.llm import simhash_dedup, toxicity
from huescope.llm.registry import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return database(FOLDER)


def test_all_operators_and_the_pipeline_are_registered():
    assert [q for n in range(1, 14) for q in queries() if q.startswith(f"op{n}_")] == [
        q for n in range(1, 14) for q in QUERIES if q.startswith(f"op{n}_")
    ]
    assert {int(q[2:].split("_")[0]) for q in QUERIES} == set(range(1, 14)) and "pipeline" in queries()
    assert set(ORACLES) <= set(oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_its_check(spark, connection, name):
    assert difference(QUERIES[name](spark, FOLDER), connection, ORACLES[name]) is None


def test_stages_narrow_down_and_keep_their_columns(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, kept = docs.columns, {r[0] for r in docs.select("doc_id").collect()}
    toxic = {r[0] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").where("toxic = 1").select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = docs.sparkSession.createDataFrame(stage(spark, docs, FOLDER).toPandas(), docs.schema)
        now = [r[0] for r in docs.select("doc_id").collect()]
        assert docs.columns == columns and len(now) == len(set(now)) and set(now) <= kept, name
        kept = set(now)
    assert len(kept & toxic) < len(toxic)
    texts = [r[0] for r in docs.select("text").collect()]
    assert len(texts) == len(set(texts)) and not any("@mail" in t for t in texts)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert {r[0] for r in packed.select("doc_id").collect()} == kept


def test_run_equals_the_stages_in_plain_python(spark):
    """Kept ids of every stage, redacted texts' pieces and the packing, recomputed row by row."""
    docs = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    frame = spark.read.parquet(f"{FOLDER}/documents.parquet")
    model = toxicity.fit(frame, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    left = {d: t or "" for d, t in docs if model.exceed(t or "")[0] < 0.5}
    assert 0 < len(left) < len(docs)
    texts = {}
    for d in sorted(left):
        texts.setdefault(re.sub("[\x20\x09-\x0d]+", " ", left[d]), d)
    left = {d: left[d] for d in texts.values()}
    prints = {d: simhash_dedup.fingerprint(t) for d, t in left.items()}
    roots = {}
    for d in sorted(left):  # the smallest id that a chain of links reaches
        if d in roots:
            continue
        roots[d], reached = d, [d]
        while reached:
            at = prints[reached.pop()] & (2**64 - 1)
            for other in left:
                if other not in roots and ((prints[other] & (2**64 - 1)) ^ at).bit_count() <= simhash_dedup.LIMIT:
                    roots[other] = d
                    reached.append(other)
    left = {d: t for d, t in left.items() if roots[d] == d}
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    redacted = spark.createDataFrame([(d, t, "", "", 0) for d, t in left.items()], frame.schema)
    want = []
    for r in dict(corpus_pipeline.STAGES)["pii"](spark, redacted, FOLDER).collect():
        ids = library.encode(r["text"], add_special_tokens=False).ids + [1]
        want += [(r["doc_id"], i // 4096, i, len(ids[i : i + 4096])) for i in range(0, len(ids), 4096)]
    rows = corpus_pipeline.run(spark, FOLDER).collect()
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"]) for r in rows) == sorted(want)
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for placed in bins.values():
        placed.sort()
        assert [o for o, _ in placed] == [sum(n for _, n in placed[:i]) for i in range(len(placed))]
        assert sum(n for _, n in placed) <= 4096
    remaining = []  # best fit by looking at every bin
    for length in sorted((w[3] for w in want), reverse=True):
        fits = [i for i, free in enumerate(remaining) if free >= length]
        at = min(fits, key=remaining.__getitem__, default=None)
        if at is None:
            remaining.append(4096 - length)
        else:
            remaining[at] -= length
    assert len(bins) == len(remaining)
