import zlib

import pytest

from sawmill.llm import sharding

from .conftest import NASTY


def test_law_and_columns(spark):
    docs = spark.createDataFrame([(i, "w" * (i * 37 % 501)) for i in range(3000)], "doc_id long, text string")
    rows = sharding.shard_documents(docs, 24).collect()
    assert len(rows) == 3000 and {r.law for r in rows} == {"bytes"}
    loads = [0] * 24
    places = {}
    for r in rows:
        loads[r.shard] += r.size
        places.setdefault(r.shard, []).append(r.slot)
        text = b"w" * (r.doc_id * 37 % 501)
        assert r.size == len(text) + 8 and r.text_crc32 == zlib.crc32(text) and r.grown_shard is None
    assert max(loads) - min(loads) <= 600
    assert all(sorted(x) == list(range(len(x))) for x in places.values())


def test_nasty_rows(spark, nasty, empty, clashing):
    for docs in (nasty, clashing):
        rows = sharding.shard_documents(docs, 24).collect()
        assert len(rows) == len(NASTY)
        assert sorted(r.size for r in rows) == sorted(len((t or "").encode()) + 8 for _, t, *_ in NASTY)
    assert sharding.shard_documents(empty, 24).collect() == []


def test_rebalancing_moves_little_and_keeps_versions(spark, tmp_path):
    docs = spark.createDataFrame([(i, "w" * (i % 91)) for i in range(5000)], "doc_id long, text string")
    recs = sharding.records(docs)
    totals = sharding.collect_totals(recs)
    path = str(tmp_path / "map")
    first = sharding.edit_map(sharding.first_map(10), totals, 10)
    sharding.store_map(spark, sharding.map_rows(first, totals, 1), path)
    second = sharding.edit_map(first, totals, 11)
    sharding.store_map(spark, sharding.map_rows(second, totals, 2), path)
    assert set(first) == set(second) == set(range(sharding.SLOTS))
    size = dict.fromkeys(range(sharding.SLOTS), 0) | {t[0]: t[1] for t in totals}
    moved = sum(size[s] for s in first if first[s] != second[s])
    assert moved <= 0.2 * sum(size.values())
    for place, n in ((first, 10), (second, 11)):
        load = {}
        for s, shard in place.items():
            load[shard] = load.get(shard, 0) + size[s]
        assert set(load) == set(range(n)) and max(load.values()) < 1.05 * min(load.values())
    assert {r.shard for r in sharding.load_map(spark, path, 1).collect()} == set(range(10))
    assert {r.shard for r in sharding.load_map(spark, path).collect()} == set(range(11))
    assert sharding.assign(recs, sharding.load_map(spark, path)).count() == 5000


def check_places(rows):
    places = {}
    for r in rows:
        places.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in places.values())


def test_an_old_map_serves_new_documents(spark, tmp_path):
    few = spark.createDataFrame([(i, "w" * (i % 91)) for i in range(500)], "doc_id long, text string")
    many = spark.createDataFrame([(i, "w" * (i % 91)) for i in range(2000)], "doc_id long, text string")
    path = str(tmp_path / "map")
    sharding.shard_documents(few, 10, path)
    rows = sharding.assign(sharding.records(many), sharding.load_map(spark, path)).collect()
    assert sorted(r.doc_id for r in rows) == list(range(2000))
    check_places(rows)
    gap = sharding.load_map(spark, path).where("virtual_slot % 2 = 0")
    with pytest.raises(Exception, match="not in the map"):
        sharding.assign(sharding.records(many), gap).collect()


def test_sharding_again_edits_the_stored_map(spark, tmp_path):
    docs = spark.createDataFrame([(i, "w" * (i % 91)) for i in range(5000)], "doc_id long, text string")
    path = str(tmp_path / "map")
    first = {r.doc_id: r for r in sharding.shard_documents(docs, 10, path).collect()}
    again = sharding.shard_documents(docs, 11, path).collect()
    assert len(again) == len({r.doc_id for r in again}) == 5000
    versions = spark.read.schema(sharding.MAP_SCHEMA).parquet(path).groupBy("version").count().collect()
    assert sorted(map(tuple, versions)) == [(v, sharding.SLOTS) for v in (1, 2, 3)]
    assert {r.shard for r in again} == set(range(11))
    assert sum(r.size for r in again if r.shard != first[r.doc_id].shard) <= 0.2 * sum(r.size for r in again)
    check_places(again)


def test_one_id_for_many_rows(spark):
    docs = spark.createDataFrame([(i if i % 3 else 7, f"text {i if i % 3 else 7}") for i in range(3000)], "doc_id long, text string").repartition(8)
    rows = sharding.shard_documents(docs, 24).collect()
    assert len(rows) == 3000
    check_places(rows)
