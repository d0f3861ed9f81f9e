"""Exact and near duplicates against plain loops."""

import hashlib
import random
import re

import numpy as np
import pytest
from llm import cases
from procatlas.llm import exact_dedup, near_dedup
from pyspark.sql import functions as F


def exact_by_loop(data):
    groups = {}
    for i, t, *_ in data:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i is None, i or 0, i))
    out = []
    for i, t, *_ in data:
        norm = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        best = min(groups[norm], key=lambda r: r[:3])
        out.append((i, best[3], len(groups[norm]), i == best[3] and -len(t or "") == best[0], hashlib.sha256(norm.encode()).hexdigest()))
    return cases.none_safe(out)


@pytest.mark.parametrize("digest", [exact_dedup.content_hash, lambda t: F.unhex(F.md5(F.substr(t, F.lit(1), F.lit(2))))])
def test_exact_groups(spark, digest):
    """Also with a hash that clashes all the time."""
    data = cases.rows()
    found = exact_dedup.exact_groups(cases.frame(spark, data), hash128=digest)
    assert cases.none_safe(tuple(r) for r in found.collect()) == exact_by_loop(data)
    assert exact_dedup.exact_groups(cases.frame(spark, [])).count() == 0


def test_drop_exact_keeps_one_row_and_all_columns(spark):
    data = cases.rows()
    docs = cases.frame(spark, data)
    kept = exact_dedup.drop_exact(docs)
    assert kept.columns == docs.columns
    wanted = {(i, n) for i, _, _, k, n in exact_by_loop(data) if k}
    got = [(r["doc_id"], hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "").encode()).hexdigest()) for r in kept.collect()]
    assert len(got) == len(set(got)) and set(got) == wanted
    assert exact_dedup.drop_exact(cases.frame(spark, [])).count() == 0


def shingle_set(text, width):
    words = (text or "").encode().lower().split()
    width = min(width, len(words))
    return {tuple(words[k : k + width]) for k in range(len(words) - width + 1)} if width else set()


def near_by_loop(data, width, percent):
    parent = {}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(i, shingle_set(t, width)) for i, t, *_ in data]
    for i, s in sets:
        if i is not None and s:
            parent.setdefault(i, i)
    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if i is not None and j is not None and s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    # rows that share an id are one document
    return cases.none_safe((i, len(s), find(i) if i in parent and s else i, (find(i) if i in parent and s else i) == i) for i, s in sets)


def near_crowd(seed=4):
    """Chains of edits, so that ends are linked only through others, and a crowd of near copies."""
    rng = random.Random(seed)
    out, number = [], 0
    for _ in range(6):
        words = cases.text(rng, "en", 10).split()
        for _ in range(8):
            words = list(words)
            words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
            out.append((number, " ".join(words), "en", "a"))
            number += 3
    base = cases.text(rng, "de", 9).split()
    for _ in range(60):
        words = list(base)
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        out.append((number, " ".join(words), "de", "b"))
        number += 1
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("data", [cases.rows(), near_crowd()], ids=["odd", "crowd"])
def test_near_groups(spark, data):
    found = near_dedup.near_groups(cases.frame(spark, data), width=2, percent=80)
    assert cases.none_safe(tuple(r) for r in found.collect()) == near_by_loop(data, 2, 80)


def test_near_groups_of_nothing(spark):
    assert near_dedup.near_groups(cases.frame(spark, [])).count() == 0


def test_drop_near_keeps_columns_and_clean_rows(spark):
    data = near_crowd() + [(None, "a b c d e f", "en", "a"), (9999, None, "en", "a")]
    docs = cases.frame(spark, data)
    kept = near_dedup.drop_near(docs, width=5, percent=80)
    assert kept.columns == docs.columns
    wanted = sorted((i for i, _, _, k in near_by_loop(data, 5, 80) if k and i is not None))
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == wanted
    assert kept.filter("doc_id is null").count() == 1


def test_tensored_keys_find_pairs_at_the_threshold():
    rng, hits = np.random.default_rng(1), 0
    signer = near_dedup.Signer(10, 3)
    for _ in range(300):
        shared, own = rng.integers(0, 2**63, 160, dtype=np.uint64), rng.integers(0, 2**63, (2, 20), dtype=np.uint64)
        a, b = (signer.partial(signer.minhashes(np.unique(np.concatenate([shared, o])))) for o in own)
        hits += (a[:10] == b[:10]).any() and (a[10:] == b[10:]).any()
    assert hits >= 294


def test_components_of_a_long_chain(spark):
    links = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).unionByName(spark.createDataFrame([(500, 300), (300, 400)], "a long, b long"))
    found = {r["node"]: r["component"] for r in near_dedup.components(links).collect()}
    assert found == {**dict.fromkeys(range(201), 0), 300: 300, 400: 300, 500: 300}
