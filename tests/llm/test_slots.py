"""Operator 13: sizes, places and edits of the map."""
import zlib
from collections import Counter, defaultdict

import pytest

from tillage.llm import slots


def brute_sizes(docs):
    raw = [(r["text"] or "").encode() for r in docs.collect()]
    return sorted((r["doc_id"], len(t) + 8, zlib.crc32(t)) for r, t in zip(docs.collect(), raw, strict=True) if r["doc_id"] is not None)


def loads(rows):
    out = Counter()
    for r in rows:
        out[r["shard"]] += r["size"]
    return out


def assert_places(rows, name="place"):
    places = defaultdict(list)
    for r in rows:
        places[r["shard"]].append(r[name])
    assert all(sorted(p) == list(range(len(p))) for p in places.values())


def many(spark, n=3000):
    return spark.range(n).selectExpr("id AS doc_id", "repeat('ab ', cast(5 + id % 37 as int)) AS text")


def test_odd_rows(odd_docs, no_docs):
    got = slots.shard_places(odd_docs).collect()
    assert sorted(tuple(r)[:3] for r in got if r["doc_id"] is not None) == brute_sizes(odd_docs)
    assert len(got) == odd_docs.count() and {r["law"] for r in got} == {"bytes"} and {r["grown_shard"] for r in got} == {None}
    assert all(0 <= r["shard"] < 24 for r in got)
    assert_places(got, "slot")
    assert slots.shard_places(no_docs).count() == 0


@pytest.mark.parametrize("chunk_rows", [5, 32_768])
def test_near_equal_bytes_and_the_same_shards_again(spark, monkeypatch, chunk_rows):
    monkeypatch.setattr(slots, "CHUNK_ROWS", chunk_rows)
    got = slots.shard_documents(many(spark), 24, slots=512).collect()
    assert_places(got)
    each = loads(got)
    assert len(each) == 24 and max(each.values()) - min(each.values()) <= max(r["size"] for r in got)
    again = {r["doc_id"]: r["shard"] for r in slots.shard_documents(many(spark).repartition(5), 24, slots=512).collect()}
    assert again == {r["doc_id"]: r["shard"] for r in got}


def test_an_id_that_a_third_of_the_rows_repeat_is_dealt_over_shards(spark):
    rows = many(spark).selectExpr("CASE WHEN doc_id % 3 > 0 THEN doc_id WHEN doc_id % 2 = 0 THEN 7 END AS doc_id", "text")
    got = slots.shard_documents(rows, 24, slots=512).collect()
    assert_places(got)
    each = loads(got)
    assert len(got) == 3000 and max(each.values()) < 1.05 * min(each.values())
    assert len({r["shard"] for r in got if r["doc_id"] == 7}) > 2 and len({r["shard"] for r in got if r["doc_id"] is None}) > 2


def test_versions_of_the_map(spark, tmp_path):
    path = str(tmp_path / "map")
    first = {r["doc_id"]: r for r in slots.shard_documents(many(spark), 8, path, slots=512).collect()}
    same = {r["doc_id"]: r for r in slots.shard_documents(many(spark), 8, path, slots=512).collect()}
    moved = [k for k in first if first[k]["shard"] != same[k]["shard"]]
    assert len(moved) <= 0.1 * len(first) and {r["map_version"] for r in same.values()} == {2}
    grown = {r["doc_id"]: r for r in slots.shard_documents(many(spark), 9, path, slots=512).collect()}
    moved = [k for k in first if same[k]["shard"] != grown[k]["shard"]]
    assert moved and {grown[k]["shard"] for k in moved} == {8}  # only the new shard takes slots
    each = loads(grown.values())
    assert max(each.values()) < 1.05 * min(each.values())
    lost = many(spark).where("doc_id % 2 = 0 OR doc_id < 600")  # other bytes: an edit brings the shards level again
    level = slots.shard_documents(lost, 9, path, slots=512).collect()
    each = loads(level)
    assert max(each.values()) < 1.05 * min(each.values()) and {r["map_version"] for r in level} == {4}
    old = slots.read_map(spark, path, 1)
    assert old.count() == slots.read_map(spark, path, 2).count() and {r["version"] for r in old.collect()} == {1}
    assert all(r["virtual_slot"] == first[r["doc_id"]]["virtual_slot"] for r in level)
    with pytest.raises(ValueError):
        slots.shard_documents(lost, 3, path, slots=512)


def test_new_slots_after_an_empty_first_version(spark, no_docs, tmp_path):
    path = str(tmp_path / "map")
    assert slots.shard_documents(no_docs, 4, path).count() == 0
    got = slots.shard_documents(many(spark, 200), 4, path).collect()
    assert len(got) == 200 and set(loads(got)) == {0, 1, 2, 3}
