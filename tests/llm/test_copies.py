"""Operators 4 and 5 against brute force."""
import itertools
import random
import re
from collections import defaultdict
from hashlib import sha256

import numpy as np
import pytest

from tillage.llm import block_naming, ngram_join


def brute_exact(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "")].append(r)
    out = []
    for norm, g in groups.items():
        best = min(g, key=lambda r: (-len(r["text"] or ""), r["doc_id"] is None, r["doc_id"] or 0))
        first = True
        for r in g:
            kept = first and r["doc_id"] == best["doc_id"] and r["text"] == best["text"]
            first = first and not kept
            out.append((r["doc_id"], best["doc_id"], len(g), kept, sha256(norm.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block_bytes", [7, 4096])
def test_block_naming(odd_docs, block_bytes):
    got = block_naming.duplicate_groups(odd_docs, block_bytes=block_bytes).collect()
    assert sorted([tuple(r)[:5] for r in got], key=repr) == brute_exact(odd_docs.collect())
    names = {(r["level"], r["name"]): r["text_sha256"] for r in got}
    assert len(names) == len(set(names.values()))


def test_block_naming_of_nothing(no_docs):
    assert block_naming.duplicate_groups(no_docs).count() == 0
    assert block_naming.first_of_each(no_docs).count() == 0


def test_first_of_each_keeps_columns_and_repeated_rows_once(odd_docs):
    kept = block_naming.first_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(ids, key=repr) == sorted([2, 3, 6, 7, None, 8, 9, 10], key=repr)


def brute_near(rows, words=5, threshold=0.8):
    sets = {}
    for r in rows:
        w = (r["text"] or "").lower().split()
        if r["doc_id"] is not None:
            sets[r["doc_id"]] = frozenset(tuple(w[k:k + words]) for k in range(max(1, len(w) - words + 1))) if w else frozenset()
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = dict.fromkeys(sets, 0)
    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and both >= threshold * len(sets[a] | sets[b]) - 1e-9:
            links[a] += 1
            links[b] += 1
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {k: (find(k), links[k]) for k in sets}


def test_near_duplicates_of_planted_copies(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    rows, k = [], 0
    for size in (1, 2, 3, 12, 60):  # groups of copies with a few words replaced, sharing a passage with all others
        passage = [word() for _ in range(15)]
        text = [word() for _ in range(rng.choice([40, 120]))] + passage
        for _ in range(size):
            near = list(text)
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                near[rng.randrange(len(near))] = word()
            rows.append((k, " ".join(near)))
            k += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngram_join.near_duplicates(docs).collect()}
    assert got == brute_near(docs.collect())


def test_near_duplicates_edges(odd_docs):
    got = ngram_join.near_duplicates(odd_docs).collect()
    assert len(got) == odd_docs.count()
    by_id = {r["doc_id"]: r for r in got}
    assert {by_id[k]["class_id"] for k in (1, 2, 3)} == {1} and by_id[1]["n_links"] == 2
    assert by_id[7]["n_links"] == 1 and by_id[4]["n_links"] == 0 and by_id[None]["kept"]
    assert [k for k in (4, 5, 6, 8, 9, 10) if by_id[k]["class_id"] != k] == []


def test_near_duplicates_of_nothing(no_docs):
    assert ngram_join.near_duplicates(no_docs).count() == 0


def test_cells_of_a_hot_bucket_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "CELL", 8)
    base = [f"w{k}" for k in range(80)]
    rows = [(k, " ".join([*base[:k + 10], f"x{k}", *base[k + 11:]])) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngram_join.near_duplicates(docs).collect()}
    assert got == brute_near(docs.collect())


def test_pruning_bound():
    assert ngram_join.least_matches(96, 0.8, 1e-6) < 0.8 * 96 and ngram_join.least_matches(96, 0.8, 1e-6) > 0.5 * 96
    a = np.arange(1000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    same = (ngram_join.minhash(np.sort(a[:900])) == ngram_join.minhash(np.sort(a[100:]))).mean()
    assert abs(same - 0.8) < 0.15
