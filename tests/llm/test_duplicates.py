"""Near-duplicate groups and fingerprints against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from turnwise.llm import arrow_text, fingerprints, minhash_dedup
from turnwise.llm.minhash_dedup import DedupOptions, components, near_duplicates
from turnwise.llm.queries import op9_minhash_dedup, op10_fingerprints

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, lower=True):
    words = WORD.findall((text or "").translate(LOWER) if lower else text or "")
    return frozenset(tuple(words[k : k + 5]) for k in range(max(len(words) - 4, 1))) if words else frozenset()


def groups(rows, percent):
    """Least doc_id of each document's group, by comparing all pairs of sets."""
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(sets[a][0]), find(sets[b][0])
                parent[max(p, q)] = min(p, q)
    return {i: (len(s), find(i)) for i, s in sets}


def test_op9_against_all_pairs(spark, folder, documents):
    want = groups([(r.doc_id, r.text) for r in documents.collect()], 85)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op9_minhash_dedup(spark, folder).collect()}
    assert got == want


def chain(seed, n, words):
    """Near copies of near copies, so that the group's ends are unlike, among unlike texts with shared passages."""
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(3000)]
    shared = [r.choice(vocabulary) for _ in range(words // 2)]
    texts, text = [], [r.choice(vocabulary) for _ in range(words)]
    for k in range(n):
        text = list(text)
        text[r.randrange(words)] = r.choice(vocabulary)
        texts.append(" ".join(text))
        texts.append(" ".join(shared + [r.choice(vocabulary) for _ in range(words // 8)]))
        if k % 5 == 0:
            texts.append(texts[-2].upper())
    r.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize(("seed", "words", "percent", "hubs"), [(1, 120, 85, 2), (2, 40, 80, 32), (3, 12, 80, 1)])
def test_chains_and_shared_passages(spark, seed, words, percent, hubs):
    rows = chain(seed, 60, words)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = near_duplicates(frame, DedupOptions(percent=percent, hubs=hubs)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == groups(rows, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_odd_rows(spark, odd, empty):
    got = near_duplicates(odd).collect()
    assert len(got) == odd.count()
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, []).append((r.n_shingles, r.component_id, r.kept))
    assert by_id[None] == [(len(shingles(odd.filter("doc_id IS NULL").first().text)), None, True)]
    assert by_id[1] == [(0, 1, True)] and by_id[3] == [(0, 3, True)] and by_id[8] == [(1, 8, True)]
    assert by_id[6][0][1:] == (6, True) and by_id[7][0][1:] == (6, False)
    assert len(by_id[5]) == 2 and set(by_id[5]) == {by_id[5][0]}
    assert near_duplicates(empty).count() == 0
    kept = minhash_dedup.keep_one_of_each(odd)
    assert kept.columns == odd.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([None, 1, 2, 3, 4, 5, 6, 8, 9, 9])


def test_densified_signatures_estimate_resemblance():
    r = np.random.default_rng(1)
    for size in (3, 20, 400):
        a = np.unique(r.integers(0, 2**63, size).astype(np.uint64) * np.uint64(2))
        b = np.unique(np.concatenate([a[: size * 9 // 10], r.integers(0, 2**63, 1 + size // 20).astype(np.uint64) * np.uint64(2)]))
        two = minhash_dedup.signatures(np.concatenate([a, b]), np.repeat([0, 1], [len(a), len(b)]), 2, 128)
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert (two != 0).all() and (two[0] == two[1]).mean() == pytest.approx(true, abs=0.25)


def test_shared_bands():
    assert minhash_dedup.least_shared_bands(85, 32, 4) == 3
    assert minhash_dedup.least_shared_bands(80, 32, 4) == 1


def test_components_against_union_find(spark):
    r = random.Random(4)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1080)]
    parent = {k: k for link in links for k in link}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        p, q = find(a), find(b)
        parent[max(p, q)] = min(p, q)
    got = {x.node: x.component for x in components(spark.createDataFrame(links, "a long, b long"))[0].collect()}
    assert got == {k: find(k) for k in parent if any(k in link and link[0] != link[1] for link in links)}


def test_links_that_are_stars_are_not_turned(spark, monkeypatch):
    tables, own = [], minhash_dedup.stored
    monkeypatch.setattr(minhash_dedup, "stored", lambda df, purpose: tables.append(purpose) or own(df, purpose))
    links = [(1, k) for k in range(2, 9)] + [(20, 11), (11, 20), (5, 5)]
    got = {x.node: x.component for x in components(spark.createDataFrame(links, "a long, b long"))[0].collect()}
    assert got == dict.fromkeys(range(1, 9), 1) | {11: 11, 20: 11}
    assert tables == ["dedup-stars"]


def test_the_driver_s_collector_runs_between_the_steps(spark, monkeypatch):
    """What was broadcast and shuffled for the first links, their components and a round does not stay for the next one."""
    runs = []
    monkeypatch.setattr(minhash_dedup, "release_shuffles", lambda spark: runs.append(1))
    frame = spark.createDataFrame(chain(2, 20, 40), "doc_id long, text string")
    near_duplicates(frame, DedupOptions(percent=80)).collect()
    assert len(runs) >= 3


def test_places_are_found_once_and_sizes_need_no_joins(spark, monkeypatch):
    plans, own, own_written = {}, minhash_dedup.stored, minhash_dedup.written

    def seen(df, purpose):
        plans.setdefault(purpose, df._jdf.queryExecution().optimizedPlan().toString())

    monkeypatch.setattr(minhash_dedup, "stored", lambda df, purpose: seen(df, purpose) or own(df, purpose))
    monkeypatch.setattr(
        minhash_dedup, "written", lambda df, folder: seen(df, folder.rsplit("/", 1)[-1].rsplit("-", 1)[0]) or own_written(df, folder)
    )
    near_duplicates(spark.createDataFrame(chain(2, 20, 40), "doc_id long, text string"), DedupOptions(percent=80)).collect()
    assert plans["dedup-ranked"].count("Window [") == 1 and "Window [" not in plans["dedup-groups"]
    assert plans["dedup-pairs"].count("Join ") == 1
    assert plans["dedup-links"].count("Join ") <= 4


def test_the_driver_s_native_memory_is_given_back(spark, monkeypatch):
    runs, own = [], arrow_text.trim_driver
    monkeypatch.setattr(arrow_text, "trim_driver", lambda spark: runs.append(own(spark)))
    arrow_text.release_shuffles(spark)
    assert runs == [True]


def edited(rows):
    """Edited text of each document, in ascending order with the first after the last."""
    for k, (doc_id, text) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        half = len(text) // 2
        yield doc_id, text, text[: len(text) - half] + following[:half], following


def resemblance(a, b):
    x, y = shingles(a, False), shingles(b, False)
    return len(x & y) / len(x | y) if x or y else 1.0


def test_op10_against_brute_force(spark, folder, documents):
    rows = sorted((r.doc_id, r.text or "") for r in documents.collect())
    got = {r.doc_id: r for r in op10_fingerprints(spark, folder).collect()}
    errors = []
    for doc_id, text, new, following in edited(rows):
        r = got[doc_id]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        errors.append(r.near_edited - resemblance(text, new))
        errors.append(r.near_next - resemblance(text, following))
        assert r.n_distinct == pytest.approx(len(shingles(text, False)), rel=0.6, abs=2)
    assert np.abs(errors).max() < 0.25 and abs(np.mean(errors)) < 0.02
    texts = dict(rows)
    by_text = {}
    for doc_id, r in got.items():
        assert by_text.setdefault(texts[doc_id], r.fingerprint) == r.fingerprint


@pytest.mark.parametrize("partitions", [1, 3])
def test_next_document_of_odd_rows(spark, odd, empty, partitions):
    rows = sorted(((r.doc_id if r.doc_id is not None else -(10**9), r.text or "") for r in odd.collect()))
    want = Counter((None if i < 0 else i, hashlib.sha256(new.encode()).hexdigest()) for i, _, new, _ in edited(rows))
    got = fingerprints.fingerprint_documents(odd.repartition(partitions)).collect()
    assert Counter((r.doc_id, r.edited_sha256) for r in got) == want
    assert fingerprints.fingerprint_documents(empty).count() == 0


def test_sketches_merge_and_estimate():
    r = random.Random(2)
    words = [f"w{r.randrange(10**6)}" for _ in range(3000)]
    a, b = " ".join(words[:2000]), " ".join(words[1000:])
    x, y = fingerprints.sketches([a, b], size=256)
    merged = fingerprints.merge(x, y, 256)
    every = shingles(a, False) | shingles(b, False)
    assert fingerprints.distinct_count(merged, 256) == pytest.approx(len(every), rel=0.25)
    assert fingerprints.resemblance(x, y, 256) == pytest.approx(1 / 3, abs=0.12)
    assert fingerprints.containment(x, y, 256) == pytest.approx(0.5, abs=0.2)
    assert (fingerprints.from_text(fingerprints.to_text(x)) == x).all()
    parts = fingerprints.sketches([a[:50], a[50:]], size=4)
    assert len(fingerprints.merge(*parts, 4)) == 4
