"""Exact and SimHash deduplication against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import edge
import xxhash

import corpus_pipeline
from huescope.llm import exact_dedup, simhash_dedup
from huescope.llm.components import components


def normal(text):
    return re.sub("[\x20\x09-\x0d]+", " ", text or "")


def expected_exact(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[normal(r[1])].append(r[0])
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = min(known) if known else None
        done = False
        for i in sorted(ids, key=lambda x: (x is None, x)):
            kept = i == keep and not done
            done |= kept
            out.append((i, keep, len(ids), kept, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=edge.key)


def actual(df):
    return sorted([tuple(r) for r in df.collect()], key=edge.key)


def test_exact_groups(docs):
    assert actual(exact_dedup.exact_dedup(docs)) == expected_exact(edge.rows())


def test_exact_with_forced_collisions_and_splits(docs):
    found = exact_dedup.exact_dedup(docs, bucket_rows=3, bits=4)
    assert actual(found) == expected_exact(edge.rows())


def test_exact_of_nothing(no_docs):
    assert exact_dedup.exact_dedup(no_docs).count() == 0
    assert exact_dedup.keep_first(no_docs).columns == no_docs.columns


def test_index_has_chains_in_key_ranges(spark, docs):
    texts = docs.toDF(*[f"c{i}" for i in range(8)]).selectExpr("c0 AS doc_id", "coalesce(c1, '') AS text")
    merges = "spark.sql.adaptive.coalescePartitions.enabled"
    for bits, longest in ((2, 1), (64, 0)):
        spark.conf.set(merges, "false")  # ranges this small would be put together
        path, _, _ = exact_dedup.build_index(texts, bucket_rows=3, bits=bits)
        spark.conf.unset(merges)
        chains, files, homes = defaultdict(list), defaultdict(list), defaultdict(set)
        index = spark.read.parquet(path)
        for r in index.select("*", "_metadata.file_path").collect():
            chains[r["key"]].append((r["chain"], r["bucket"], r["depth"]))
            files[r["file_path"]].append(r["key"] % (1 << 64))
            homes[r["bucket"]].add(r["file_path"])
        assert max(map(len, chains.values())) > longest
        for links in chains.values():
            assert sorted(c for c, _, _ in links) == list(range(1, len(links) + 1))
            assert len({b for _, b, _ in links}) == 1
        ranges = sorted((min(k), max(k)) for k in files.values())
        assert len(ranges) > 1 and all(a[1] < b[0] for a, b in zip(ranges, ranges[1:]))
        assert all(len(found) == 1 for found in homes.values())
        if bits == 64:
            assert max(r["count"] for r in index.groupBy("bucket").count().collect()) <= 3


def test_chains_need_no_second_shuffle(spark, docs):
    texts = docs.toDF(*[f"c{i}" for i in range(8)]).selectExpr("c0 AS doc_id", "coalesce(c1, '') AS text")
    links = exact_dedup.stored(exact_dedup.chain_links(texts), "test-links")
    cells, most = exact_dedup.directory(links, 3)
    placed = exact_dedup._with_bucket(links, exact_dedup.stored(cells, "test-cells"), most)
    chain = exact_dedup.Window.partitionBy("bucket", "key").orderBy("digest")
    owned = placed.repartitionByRange("bucket").withColumn("chain", exact_dedup.F.row_number().over(chain))
    plan = owned._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange rangepartitioning") == 1 and "Exchange hashpartitioning" not in plan


def test_directory_too_large_to_broadcast(docs, monkeypatch):
    monkeypatch.setattr(exact_dedup, "BROADCAST_CELLS", 0)
    assert actual(exact_dedup.exact_dedup(docs, bucket_rows=3)) == expected_exact(edge.rows())


def test_directory_splits_only_full_buckets(spark):
    keys = [(i << 60) - (1 << 63) for i in range(0, 16, 8)] + [(1 << 40) * i for i in range(50)]
    links = spark.createDataFrame([(k,) for k in keys], "key long")
    cells, _ = exact_dedup.directory(links, 26)
    depths = {r["depth"] for r in cells.collect()}
    assert len(depths) > 1  # a bucket was split further than another


def test_exact_keeps_whole_rows_once(docs):
    kept = exact_dedup.keep_first(docs)
    assert kept.columns == docs.columns
    want = sorted([(i, d) for i, _, _, k, d in expected_exact(edge.rows()) if k], key=edge.key)
    got = [(r[0], hashlib.sha256(normal(r[1]).encode()).hexdigest()) for r in kept.collect()]
    assert sorted(got, key=edge.key) == want


def brute_print(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split("[\x20\x09-\x0d]+", lower) if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    values = sorted(set(prints))
    parent = {v: v for v in values}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= 2:
                parent[find(a)] = find(b)
    return {v: find(v) for v in values}


def test_simhash(docs):
    rows = edge.rows()
    prints = [brute_print(r[1]) for r in rows]
    root = brute_components(prints)
    least = {}
    for r, p in zip(rows, prints):
        if r[0] is not None:
            least[root[p]] = min(r[0], least.get(root[p], r[0]))
    want = sorted([(r[0], f"{p:016x}", least.get(root[p])) for r, p in zip(rows, prints)], key=edge.key)
    assert actual(simhash_dedup.simhash_dedup(docs)) == want


def test_simhash_of_nothing(no_docs):
    assert simhash_dedup.simhash_dedup(no_docs).count() == 0


def signed(v):
    return v - (1 << 64) if v >> 63 else v


def test_links_of_dense_and_sparse_neighbourhoods(spark):
    chance = random.Random(3)
    prints = set()
    for _ in range(60):  # pairs and short chains
        v = chance.getrandbits(64)
        prints.add(v)
        for _ in range(chance.randint(0, 3)):
            for b in chance.sample(range(64), chance.randint(1, 3)):
                v ^= 1 << b
            prints.add(v)
    heart = chance.getrandbits(64)
    for _ in range(300):  # many within a few bits: keys with far more than DENSE members
        v = heart
        for b in chance.sample(range(64), chance.randint(0, 4)):
            v ^= 1 << b
        prints.add(v)
    order = sorted(prints)
    data = [(i, signed(p)) for i, p in enumerate(order)]
    found = simhash_dedup.near_components(spark.createDataFrame(data, "doc_id long, fp long"))
    root = brute_components(order)
    least = {}
    for i, p in enumerate(order):
        least.setdefault(root[p], i)
    assert {r["fp"]: r["component_id"] for r in found.collect()} == {signed(p): least[root[p]] for p in order}


def test_near_keep_first_keeps_one_of_each_group(docs):
    verdict = simhash_dedup.simhash_dedup(docs).collect()
    kept = [r[0] for r in simhash_dedup.keep_first(docs).collect()]
    assert set(k for k in kept if k is not None) == {r[2] for r in verdict if r[2] is not None and r[0] == r[2]}


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "a long, b long")
    found = {r["node"]: r["least"] for r in components(links).collect()}
    assert found == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_pipeline_stage_links_as_the_operator_does(spark, docs, no_docs):
    """One of each group linked by two or fewer bits of three-word fingerprints stays, and nothing else goes."""
    chance = random.Random(11)
    vocabulary = [f"w{i}" for i in range(500)]
    base, texts = chance.choices(vocabulary, k=300), ["", " ", "one", "ONE", "a b c d e", "a b c d e f"]
    for _ in range(60):
        words = list(base)
        for _ in range(chance.randint(0, 2)):
            words[chance.randrange(len(words))] = chance.choice(vocabulary)
        texts.append(" ".join(words))
    texts += [" ".join(chance.choices(vocabulary, k=chance.choice([3, 8, 60]))) for _ in range(80)]
    prints = [brute_print(t) for t in texts]
    root, least = brute_components(prints), {}
    for i, p in enumerate(prints):
        least.setdefault(root[p], i)
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)]
    given = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    stage = dict(corpus_pipeline.STAGES)["simhash_near_dedup"]
    kept = stage(spark, given, "")
    assert kept.columns == given.columns and {r[0] for r in kept.collect()} == set(least.values())
    assert stage(spark, no_docs, "").count() == 0
