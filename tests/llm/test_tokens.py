"""Token ids, packing, records and mixing."""

import random
import struct
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm import cases
from procatlas.llm import mixing, packing, records
from procatlas.llm.queries import vocabulary
from procatlas.llm.tokens import Encoder, word_count

ENCODER = Encoder(vocabulary(), memo=50)


def plain_ids(text):
    ids = ENCODER.tokenizer.encode(text or "", add_special_tokens=False).ids
    return struct.pack(f"<{len(ids)}I", *ids)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a", "B", "é", "ő", "ß", "'s", "'", "\"", ".", ",", "!?", " ", "  ", "\n", "\t", " ", "1", "²", "漢", "😀", "́", "_", "ll", "<|endoftext|>", "×"])).map("".join))
def test_chunks_give_the_ids_of_the_whole_text(text):
    assert ENCODER.encode(text) == plain_ids(text)


def test_word_count(spark):
    data = cases.rows()
    got = cases.frame(spark, data).select("doc_id", "text", word_count_column())
    for r in got.collect():
        assert r["words"] == len((r["text"] or "").encode().split())


def word_count_column():
    from pyspark.sql import functions as F

    return word_count(F.col("text")).alias("words")


def unpacked(pieces):
    docs, windows = {}, {}
    for r in pieces:
        docs.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], bytes(r["ids"])))
        windows.setdefault(r["sequence_id"], []).append((r["offset"], len(r["ids"]) // 4))
    return docs, windows


@pytest.mark.parametrize("parts,size", [(1, 64), (5, 1024)])
def test_every_id_lies_in_one_piece(spark, parts, size):
    data = [r for r in cases.rows() if r[0] != 111] + [(200 + i, "a " * (i * 37 % 400), "en", "a") for i in range(60)]
    pieces = packing.pack(cases.frame(spark, data, parts), vocabulary(), size=size, open_windows=4, tasks_merged=3).collect()
    docs, windows = unpacked(pieces)
    for i, text, *_ in data:
        whole = plain_ids(text) + b"\0\0\0\0"
        if i is None:
            continue
        own = sorted(docs[i, len(whole) // 4])
        assert b"".join(ids for _, ids in own) == whole
        assert [s for s, _ in own] == [sum(len(x) for _, x in own[:k]) // 4 for k in range(len(own))]
    assert sum(r["doc_id"] is None for r in pieces) >= 3
    for places in windows.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= size
    unfilled = sum(size - sum(n for _, n in p) for p in windows.values())
    assert unfilled <= 8 * len(windows) + size * (parts + 2) // 3 + size
    assert packing.pack(cases.frame(spark, []), vocabulary()).count() == 0


def test_windows_stay_bounded_and_take_the_best_fit():
    windows = packing.Windows(100, 2, 0)
    piece = lambda n: b"\1\0\0\0" * n
    assert list(windows.add(1, piece(60))) == [] and list(windows.add(2, piece(80))) == []
    assert list(windows.add(3, piece(15))) == []
    assert sorted(used for used, _ in windows.open) == [60, 95]
    closed = list(windows.add(4, piece(50)))
    assert [sum(len(p[2]) // 4 for p in w) for w in closed] == [100] and len(windows.open) == 2


def test_records_round_trip(spark, tmp_path):
    data = cases.rows()
    docs = cases.frame(spark, data)
    records.write_records(docs, str(tmp_path / "set"), vocabulary(), files=4)
    wanted = sorted(((i is not None, i or 0, plain_ids(t) + struct.pack("<I", 2)) for i, t, *_ in data), key=lambda r: r[:2])
    read = sorted(records.read_records(spark, str(tmp_path / "set")).collect(), key=lambda r: (r["part"], r["number"]))
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, bytes(r["ids"])) for r in read) == sorted(wanted)
    assert [(r["doc_id"] is not None, r["doc_id"] or 0) for r in read] == [w[:2] for w in wanted]
    at = 0
    for r in read:
        assert r["start"] == at
        at += len(r["ids"]) // 4
    shuffled = records.read_shuffled(spark, str(tmp_path / "set"), seed=4, tasks=2).collect()
    assert sorted((r["part"], r["number"], bytes(r["ids"])) for r in shuffled) == sorted((r["part"], r["number"], bytes(r["ids"])) for r in read)
    assert [(r["part"], r["number"]) for r in shuffled] != [(r["part"], r["number"]) for r in read]


def test_folders_of_records(spark, tmp_path, monkeypatch):
    """URIs and names with odd characters; on a cluster only folders below a shared one, and only known schemes."""
    docs = cases.frame(spark, cases.rows())
    for folder in (f"file:{tmp_path}/a b%20c", f"file://{tmp_path}/two"):
        records.write_records(docs, folder, vocabulary(), files=2)
        assert records.read_records(spark, folder).count() == len(cases.rows())
    assert (tmp_path / "a b%20c" / "data").is_dir() and (tmp_path / "two" / "index").is_dir()
    assert records.qualified(spark, str(tmp_path / "x") + "/") == f"file:{tmp_path}/x"
    with pytest.raises(ValueError, match="no records on wasbs"):
        records._storage("wasbs://c@a.blob.core.windows.net/x")
    monkeypatch.setattr(spark.sparkContext, "master", "spark://cluster")
    monkeypatch.setattr(spark.sparkContext, "getCheckpointDir", lambda: f"file:{tmp_path}/shared/run")
    assert records.qualified(spark, f"{tmp_path}/shared/run/set") == f"file:{tmp_path}/shared/run/set"
    for folder in (f"{tmp_path}/shared/running", f"file:{tmp_path}/own"):
        with pytest.raises(ValueError, match="one machine"):
            records.qualified(spark, folder)


def test_records_of_nothing(spark, tmp_path):
    records.write_records(cases.frame(spark, []), str(tmp_path / "none"), vocabulary(), files=2)
    assert records.read_records(spark, str(tmp_path / "none")).count() == 0


def test_damage_is_found():
    record = records.frame(7, struct.pack("<3I", 1, 70000, 2))
    assert records.unframe(record) == (7, struct.pack("<3I", 1, 70000, 2))
    assert records.unframe(records.frame(None, b"")) == (None, b"")
    for at in range(len(record)):
        broken = bytearray(record)
        broken[at] ^= 64
        with pytest.raises(ValueError):
            records.unframe(bytes(broken))
    assert records.masked(b"abc") != zlib.crc32(b"abc")


def best_sum(sizes, counts, budget):
    reach = {0}
    for s, c in zip(sizes, counts):
        reach = {r + k * s for r in reach for k in range(c + 1) if r + k * s <= budget}
    return max(reach)


def test_fit_is_exact_on_small_budgets():
    rng = random.Random(2)
    for _ in range(200):
        sizes = rng.sample(range(1, 30), rng.randrange(1, 6))
        counts = [rng.randrange(1, 5) for _ in sizes]
        budget = rng.randrange(sum(s * c for s, c in zip(sizes, counts)) + 1)
        most = rng.randrange(1, 4)
        take = mixing.fit(sizes, counts, budget, most)
        assert all(0 <= t <= most * c for t, c in zip(take, counts))
        total = sum(s * t for s, t in zip(sizes, take))
        share = sum(s * (c * budget // sum(a * b for a, b in zip(sizes, counts))) for s, c in zip(sizes, counts))
        assert abs(total - budget) <= budget - best_sum(sizes, [most * c - c * budget // sum(a * b for a, b in zip(sizes, counts)) for c in counts], budget - share) - share
    big = mixing.fit([3, 1000, 70001], [10**6, 10**6, 500], 777_777_777)
    assert 3 * big[0] + 1000 * big[1] + 70001 * big[2] == 777_777_777


def goals_by_loop(sizes, weights=(5, 2, 1), most=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, open_, out = float(sum(sizes.values())), set(names), {}
    while True:
        over = [s for s in open_ if left * weight[s] / sum(weight[t] for t in open_) > most * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / sum(weight[t] for t in open_) for s in open_}
        for s in over:
            out[s] = float(most * sizes[s])
        left -= sum(out[s] for s in over)
        open_ -= set(over)


def test_mix_comes_near_its_targets_and_reruns_agree(spark):
    data = cases.rows(many=150)
    mixed = mixing.mix(cases.frame(spark, data))
    found = mixed.collect()
    sizes = {}
    for _, t, _, s in data:
        sizes[s] = sizes.get(s, 0) + len((t or "").encode().split())
    goals = goals_by_loop(sizes)
    assert len(found) == len(data)
    for s, size in sizes.items():
        own = [r for r in found if r["source_key"] == ("" if s is None else "s" + s)]
        assert {r["source_size"] for r in own} == {size}
        assert own[0]["target"] == pytest.approx(goals[s])
        assert abs(sum(r["taken"] for r in own) - goals[s]) <= max(1, max(r["size"] for r in own) - 200)
    assert all(r["taken"] == r["times"] * r["size"] and 0 <= r["times"] <= 3 for r in found)
    again = mixing.mix(cases.frame(spark, data[::-1], 7)).collect()
    assert cases.none_safe(tuple(r) for r in found) == cases.none_safe(tuple(r) for r in again)
    assert mixing.mix(cases.frame(spark, [])).count() == 0


def test_a_length_with_most_rows_is_ranked_in_ranges(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 16)
    data = [(i, "one two three", "en", "a") for i in range(300)] + [(1000 + i, "x " * 30, "en", "b") for i in range(60)]
    found = mixing.mix(cases.frame(spark, data)).collect()
    goals = goals_by_loop({"a": 900, "b": 1800})
    for key, goal in (("sa", goals["a"]), ("sb", goals["b"])):
        assert abs(sum(r["taken"] for r in found if r["source_key"] == key) - goal) <= 30


def test_repeat_mixed_takes_each_row_as_often_as_planned(spark):
    data = cases.rows(many=60)
    docs = cases.frame(spark, data)
    plan, taken = mixing.mix(docs), mixing.repeat_mixed(docs)
    assert taken.columns == docs.columns
    wanted = {}
    for r in plan.collect():
        wanted[r["doc_id"], r["size"]] = wanted.get((r["doc_id"], r["size"]), 0) + r["times"]
    got = {}
    for r in taken.collect():
        k = r["doc_id"], len((r["text"] or "").encode().split())
        got[k] = got.get(k, 0) + 1
    assert got == {k: n for k, n in wanted.items() if n}
