"""URL rules and top-k search against plain loops, and the pipeline."""

import itertools
import math
import os
import random

import corpus_pipeline
import numpy as np
import oracle
import pytest
from llm import cases
from procatlas.llm import near_dedup, queries, topk, url_rules
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
RULES = queries.URL_RULES


def split_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, rest = rest[:end], rest[end:]
    end = min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), rest[:end]


def rule_by_loop(url):
    host, path = split_url(url)
    fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


URLS = [
    "http://A.Example.ORG/es/1", "https://example.org/en/12?x=1", "http://x.com/fr/", "http://com/de/1#a", "http://xcom/fr/1", "http://a.org", "http://a.org?b/c", "ftp://b.org/",
    "no scheme", "", None, "://", "http://", "http://E.com#f", "http://example.org/en/2", "http://a.b.net/fr/ä?q", "http://İ.org/ß", "a://b://c/d", "http://user@h.org:80/x", "http://a.org/es/",
]


def test_hosts_paths_and_given_rules(spark):
    rows = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(URLS)] + [(None, "http://q.net/", "x", "y")] * 2, "page_id long, url string, row string, tokens string")
    mined = url_rules.mine(rows.limit(0).withColumn("label", F.lit("block")))
    found = url_rules.judge_urls(rows, mined, RULES).collect()
    assert len(found) == len(URLS) + 2
    for r in found:
        if r["page_id"] is not None:
            url = URLS[r["page_id"]]
            assert (r["host"], r["path"]) == split_url(url), url
            rule, verdict = rule_by_loop(url)
            assert (r["rule"], r["verdict"]) == (rule, verdict or "allow"), url


def mined_by_loop(sets, labels, support, confidence):
    """All rules over subsets of the token sets, without those that a shorter one makes needless."""
    counts, with_label = {}, {}
    for tokens, label in zip(sets, labels):
        for n in range(1, len(tokens) + 1):
            for part in itertools.combinations(sorted(tokens), n):
                counts[part] = counts.get(part, 0) + 1
                with_label[part, label] = with_label.get((part, label), 0) + 1
    rules = {(p, la): c / counts[p] for (p, la), c in with_label.items() if c >= math.ceil(support * len(sets)) and c / counts[p] >= confidence}
    return {k: v for k, v in rules.items() if not any(la == k[1] and set(p) < set(k[0]) and w >= v for (p, la), w in rules.items())}


def test_mined_rules_and_matching(spark):
    rng = random.Random(3)
    urls = [f"http://{rng.choice(('a', 'b', 'spam'))}.{rng.choice(('net', 'io'))}/{rng.choice(('x', 'y', '7'))}" for _ in range(120)]
    labels = ["block" if ("spam" in u and rng.random() < 0.9) or u.endswith("io/x") else "allow" for u in urls]
    table = spark.createDataFrame(list(zip(range(120), urls, labels)), "page_id long, url string, label string")
    mined = url_rules.mine(table, min_support=0.03, min_rows=1, min_confidence=0.7, everywhere=1.0)
    tokens = {r["url"]: tuple(r["t"]) for r in table.select("url", url_rules.url_tokens(F.col("url")).alias("t")).collect()}
    wanted = mined_by_loop([tokens[u] for u in urls], labels, 0.03, 0.7)
    got = {(tuple(r["antecedent"]), r["label"]): r["confidence"] for r in mined.collect()}
    assert got.keys() == wanted.keys()
    assert all(got[k] == pytest.approx(v) for k, v in wanted.items())
    support = {tuple(r["antecedent"]): r["support"] for r in mined.collect()}
    for r in url_rules.match(table, mined).collect():
        own = set(tokens[r["row"]["url"]])
        fits = [(-c, -support[p], len(p), list(p), la) for (p, la), c in got.items() if set(p) <= own]
        best = min(fits) if fits else (None, None, None, None, "allow")
        assert (r["verdict"], r["antecedent"]) == (best[4], best[3])


def test_rule_of_a_small_part_of_a_large_table(spark):
    """A host with 9 of 2,500 labelled rows is learned: a count decides, not a share that grows with the table."""
    urls = [(f"http://h{i % 40}.net/x", "allow") for i in range(2491)] + [(f"http://deals.net/{i}", "block") for i in range(9)]
    mined = url_rules.mine(spark.createDataFrame(urls, "url string, label string"))
    assert ("w:deals",) in {tuple(r["antecedent"]) for r in mined.filter("label = 'block'").collect()}


def test_rules_on_tokens_of_nearly_all_urls(spark):
    """With the defaults, against the loop: a host word in 91 % of the labelled URLs has rules, alone and combined."""
    rng = random.Random(5)
    urls = [f"http://{'hot' if i % 100 < 91 else rng.choice(('a', 'b'))}.net/{rng.choice(('x', 'y', 'z'))}" for i in range(300)]
    labels = ["block" if ("hot" in u and rng.random() < (0.95 if u.endswith("x") else 0.65)) else "allow" for u in urls]
    table = spark.createDataFrame(list(zip(urls, labels)), "url string, label string")
    tokens = {r["url"]: tuple(r["t"]) for r in table.select("url", url_rules.url_tokens(F.col("url")).alias("t")).collect()}
    wanted = mined_by_loop([tokens[u] for u in urls], labels, 5 / 300, 0.6)
    got = {(tuple(r["antecedent"]), r["label"]): r["confidence"] for r in url_rules.mine(table).collect()}
    assert {(("w:hot",), "block"), (("p:x", "w:hot"), "block")} <= got.keys()
    assert got == pytest.approx(wanted)


def test_rules_of_long_urls(spark):
    """Six copies of URLs of 60 tokens: tokens in the same rows go in as one, and each gives a rule of its own."""
    long = ["http://deep.net/" + "/".join(f"d{chr(97 + k // 8)}{chr(97 + k % 8)}" for k in range(60))] * 6
    other = [f"http://h{i % 7}.net/x" for i in range(60)]
    table = spark.createDataFrame([(u, "block") for u in long] + [(u, "allow") for u in other], "url string, label string")
    got = {(tuple(r["antecedent"]), r["label"]): (r["confidence"], r["support"], r["lift"]) for r in url_rules.mine(table).collect()}
    alone = [k for k in got if k[1] == "block"]
    assert len(alone) == 61 and all(len(a) == 1 and got[a, la] == (1.0, pytest.approx(6 / 66), pytest.approx(11.0)) for a, la in alone)
    judged = url_rules.match(spark.createDataFrame([("http://q.org/dba",), ("http://q.org/z",)], "url string"), url_rules.mine(table)).collect()
    assert {r["row"]["url"]: r["verdict"] for r in judged} == {"http://q.org/dba": "block", "http://q.org/z": "allow"}


def test_url_labels_come_from_the_labels_alone(spark, tmp_path):
    """A host is blocked for its labels at a lift over the block base rate, whatever its words are."""
    hosts = [(f"h{i % 30}.net", 0 if i // 30 % 15 == 0 else 1) for i in range(900)] + [("zorp.net", 0 if i % 5 < 2 else 1) for i in range(80)] + [("casino-win.net", 1)] * 20
    pages = [(i, f"http://{h}/en/{i}", "") for i, (h, _) in enumerate(hosts)] + [(5000, "http://zorp.net/en/5000", ""), (5001, "http://casino-win.net/en/5001", "")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    spark.createDataFrame([(i, q, 0) for i, (_, q) in enumerate(hosts)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    found = {r["page_id"]: (r["verdict"], r["confidence"]) for r in queries.op3_url_rules(spark, str(tmp_path)).collect()}
    assert found[5000] == ("block", pytest.approx(0.4))
    assert found[5001][0] == "allow"
    assert sum(v == "block" for v, _ in found.values()) == 81


def top_by_loop(rows, k, every):
    ints = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            ints.append((i, tuple(math.floor(256 * x) for x in v)))
    ints, out = sorted(set(ints)), []
    for q, a in ints:
        if q % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), c) for c, b in ints if c != q and len(b) == len(a))
            out += [(q, n + 1, c, -s) for n, (s, c) in enumerate(scored[:k])]
    return sorted(out)


def vectors(seed, many):
    rng = random.Random(seed)
    rows = [(i, [float(np.float32(rng.gauss(0, 0.2))) for _ in range(6)]) for i in range(many)]
    rows += [(many + i, list(rows[7][1])) for i in range(30)]  # ties
    rows += [(10, None), (20, [None] * 6), (30, [float("nan")] * 6), (40, [float("inf")] + [0.0] * 5), (None, [0.1] * 6), rows[5], rows[10], (50_000, []), (50_001, []), (60_000, [0.0] * 6), (70_000, [0.5, 0.5])]
    return rows


@pytest.mark.parametrize("block,query_block", [(8192, 1024), (40, 7)])
def test_top_k(spark, block, query_block):
    rows = vectors(1, 200)
    table = spark.createDataFrame([(i, v, 3, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, v string")
    found = topk.top_k(table, 5, 10, block=block, query_block=query_block)
    assert sorted(tuple(r) for r in found.collect()) == top_by_loop(rows, 5, 10)
    assert topk.top_k(table.limit(0)).count() == 0


def test_big_components_are_exact(spark):
    rows = [(i, [float(np.float32(1e6 * (i % 7 - 3) + i)), float(i)]) for i in range(40)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in topk.top_k(table, 3, 10).collect()) == top_by_loop(rows, 3, 10)


def test_most_blocks_are_left_out_on_clustered_vectors(spark):
    """Queries meet under a fifth of the candidates, and still find what the loop finds."""
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 1, (20, 8))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 20] + rng.normal(0, 0.03, 8)]) for i in range(2000)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in topk.top_k(table, 5, 10, block=50, query_block=30).collect()) == top_by_loop(rows, 5, 10)
    blocks = topk.blocks_of(table, 256.0, "vec_id", "embedding", 50)
    sizes = [r["count"] for r in blocks.groupBy("cb").count().collect()]
    assert sum(sizes) == 2000 and max(sizes) < 100
    home = topk.at_home(blocks, 5, 10)
    floors = home.filter("query_id is not null").groupBy(F.col("query_id").alias("vec_id")).agg(F.min("score").alias("floor"))
    asked = blocks.filter("vec_id % 10 = 0").join(floors, "vec_id").withColumn("qb", F.lit(0).cast("long")).withColumnRenamed("cb", "home")
    pairs = topk.reachable_blocks(asked, home.filter("lo is not null").select("dim", "cb", "lo", "hi"), chunk=7)
    met = pairs.join(blocks.groupBy("cb").count(), "cb").agg(F.sum("count")).first()[0]
    assert met + 200 * max(sizes) < 200 * 2000 / 5


def test_a_floor_ends_the_walk():
    rng = np.random.default_rng(1)
    vectors_ = np.floor(256 * rng.normal(0, 0.05, (5000, 4)))
    held, query = topk.Block(np.arange(5000), vectors_), vectors_[3]
    best = int((vectors_ @ query).max())
    assert held.search(-1, query, 5, best)[1][0] == best
    assert held.search(-1, query, 5, 4 * best)[2] < held.search(-1, query, 5)[2] / 4


def test_the_threshold_stops_early():
    rng = np.random.default_rng(1)
    vectors_ = np.floor(256 * rng.normal(0, 0.05, (5000, 4)))
    vectors_[:50] += 200
    held = topk.Block(np.arange(5000), vectors_)
    ids, scores, scored = held.search(3, vectors_[3], 5)
    whole = vectors_ @ vectors_[3]
    whole[3] = -np.inf
    assert list(ids) == list(np.lexsort((np.arange(5000), -whole))[:5]) and list(scores) == list(whole[ids])
    assert scored < 1000


needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="benchmark tables are not here")


@needs_tables
@pytest.mark.parametrize("name", sorted(queries.CHECKS))
def test_query_with_sql(spark, name):
    assert oracle.compare(queries.QUERIES[name](spark, SF), oracle.connect(SF), queries.CHECKS[name]) is None


COLUMNS = {
    "op1_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op2_minhash_near_dedup": ["doc_id", "n_shingles", "component_id", "kept"],
    "op3_url_rules": ["page_id", "host", "path", "rule", "verdict"],
    "op4_language_id": ["doc_id", "held_out", "lang_pred", "score"],
    "op5_html_blocks": ["page_id", "url", "text", "n_chars"],
    "op6_packing": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    "op9_binary_records": ["doc_id", "start", "n_tokens", "ids_crc32"],
    "op10_mixing": ["doc_id", "size", "source_size", "target", "taken"],
}


@needs_tables
@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query_without_sql(spark, name):
    found = queries.QUERIES[name](spark, SF).toPandas()
    assert list(found.columns)[: len(COLUMNS[name])] == COLUMNS[name]
    table = "pages" if "page_id" in found.columns else "documents"
    key = found.columns[0]
    ids = {r[0] for r in spark.read.parquet(f"{SF}/{table}.parquet").select(key).collect()}
    assert set(found[key]) == ids


def test_pipeline_stages(spark, tmp_path):
    """Each stage over what the one before kept, with its effect by plain loops where it has one."""
    data = [r for r in cases.rows(many=120)]
    docs = cases.frame(spark, data).select(*cases.BASE)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "exact_dedup", "near_dedup", "mixing", "packing"]
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        if name != names[-1]:
            assert docs.columns == cases.BASE
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = docs.collect()
    letters = [t for _, t, *_ in data if any(c.isalpha() for c in t or "")]
    assert len(seen["language_id"]) == len(letters)
    bare = lambda t: "".join((t or "").encode().decode().split(" ")).replace("\n", "").replace("\t", "")
    assert len(seen["exact_dedup"]) == len({bare(r["text"]) for r in seen["language_id"]}) == len({bare(r["text"]) for r in seen["exact_dedup"]})
    kept = {r["doc_id"] for r in seen["near_dedup"] if r["doc_id"] is not None}
    assert 104 in kept and 105 not in kept and kept <= {r["doc_id"] for r in seen["exact_dedup"]}
    assert all(len(near_dedup.Shingler(5).shingles(r["text"])) for r in seen["near_dedup"])
    words = {r["doc_id"]: r["text"] for r in seen["near_dedup"]}
    assert {r["doc_id"] for r in seen["mixing"]} <= set(words)
    assert sum(r["length"] for r in seen["packing"]) >= len(seen["mixing"])
    assert {r["doc_id"] for r in seen["packing"]} == {r["doc_id"] for r in seen["mixing"]}
