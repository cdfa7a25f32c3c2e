"""The stored slot map over several runs, and shards of tables with repeated and null ids."""

from collections import Counter

import pytest

from tallyforge.llm import sharding

DOCS = "doc_id long, text string"


def sizes(rows, shards):
    total = Counter()
    for r in rows:
        total[r["shard"]] += r["size"]
    for shard in range(shards):
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in rows)))
    return [total[s] for s in range(shards)]


def test_later_runs_edit_the_stored_map(spark, tmp_path):
    path = str(tmp_path / "map")
    docs = [(i, "x" * (i * 37 % 200)) for i in range(6000)]
    frame = lambda rows: spark.createDataFrame(rows, DOCS)
    first = sharding.shard_documents(frame(docs), 5, slots=512, map_path=path).collect()
    assert sharding.map_version(spark, path) == 1 and max(sizes(first, 5)) - min(sizes(first, 5)) < 400
    again = sharding.shard_documents(frame(docs), 5, slots=512, map_path=path).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, first)) and sharding.map_version(spark, path) == 1, "nothing to edit"
    more = sharding.shard_documents(frame(docs + [(6000 + i, "y" * 90) for i in range(300)]), 5, slots=512, map_path=path).collect()
    maps = [sharding.read_map(spark, path, v) for v in (1, 2)]
    moved = sum(maps[0][s] != maps[1][s] for s in maps[0])
    assert 0 < moved < 100 and max(sizes(more, 5)) - min(sizes(more, 5)) < 400
    grown = sharding.shard_documents(frame(docs), 6, slots=512, map_path=path).collect()
    was, now = sharding.read_map(spark, path, 2), sharding.read_map(spark, path, 3)
    assert sum(was[s] != now[s] for s in was) < 200 and max(sizes(grown, 6)) - min(sizes(grown, 6)) < 400
    fewer = sharding.shard_documents(frame(docs), 4, slots=512, map_path=path).collect()
    assert max(sizes(fewer, 4)) - min(sizes(fewer, 4)) < 400 and sharding.read_map(spark, path, 3) == now, "versions stay"
    with pytest.raises(ValueError, match="512 slots"):
        sharding.shard_documents(frame(docs), 4, slots=64, map_path=path)


@pytest.mark.parametrize("hot", [7, None])
def test_a_repeated_id_fills_no_shard(spark, hot):
    rows = [(i, "abc") for i in range(6000)] + [(hot, "abc")] * 4000
    got = sharding.shard_documents(spark.createDataFrame(rows, DOCS), 8).collect()
    total = sizes(got, 8)
    assert len(got) == 10_000 and max(total) - min(total) <= 2 * 11, total
    assert max(Counter(r["virtual"] for r in got).values()) < 50


def test_new_shards_take_slots_only_into_themselves():
    loads = {s: s % 17 + 1 for s in range(256)}
    placed = sharding.rebalanced(sharding.even_map(4, 256), loads, 4)
    grown = sharding.resized(placed, loads, 6)
    assert all(grown[s] == placed[s] or grown[s] in (4, 5) for s in placed) and set(grown.values()) == set(range(6))
