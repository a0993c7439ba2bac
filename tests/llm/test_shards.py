import random
import zlib

import numpy as np
import pytest
from cases import AWKWARD, documents, sentence

from fleetwise.llm import shards


def test_places_sizes_and_balance(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, sentence(rng, rng.randrange(1, 200))) for i in range(2000)] + [(i, "the same copy") for i in range(3000, 4000)] + AWKWARD[:-4]
    path = str(tmp_path / "map")
    got = shards.shard(documents(spark, rows), 7, path=path).collect()
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=str) == sorted(
        ((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in rows), key=str
    )
    for s in range(7):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    load = np.bincount([r.shard for r in got], [r.size for r in got], 7)
    assert load.max() - load.min() <= 0.01 * load.mean()
    by_slot = {}
    for r in got:
        assert by_slot.setdefault(r.virtual_slot, r.shard) == r.shard
    stored = {r.virtual_slot: r.shard for r in shards.load_map(spark, path).collect()}
    assert len(stored) == shards.SLOTS and by_slot.items() <= stored.items()


def test_growing_moves_slots_to_the_new_shard_only(spark, tmp_path):
    rng = np.random.default_rng(2)
    size = rng.integers(0, 5000, shards.SLOTS)
    old = shards.new_map(size, 24)
    new = shards.grown_map(old, size, 26)
    moved = old != new
    assert set(new[moved]) == {24, 25}
    load = np.bincount(new, size, 26)
    assert abs(load - size.sum() / 26).max() <= 0.02 * size.sum() / 26
    assert size[moved].sum() <= 1.05 * size.sum() * 2 / 26
    path = str(tmp_path / "map")
    shards.save_map(spark, path, 1, old)
    shards.save_map(spark, path, 2, new)
    read = lambda v: [r.shard for r in shards.load_map(spark, path, v).orderBy("virtual_slot").collect()]
    assert read(1) == old.tolist() and read(2) == read(None) == new.tolist()


def _gapless(rows, column="shard"):
    for s in {r[column] for r in rows}:
        mine = sorted(r.slot for r in rows if r[column] == s)
        assert mine == list(range(len(mine)))


def test_rebalancing_edits_the_stored_map(spark, tmp_path):
    rng = random.Random(5)
    path = str(tmp_path / "map")
    rows = [(i, sentence(rng, rng.randrange(1, 60))) for i in range(3000)]
    shards.shard(documents(spark, rows), 6, path=path)
    versions = [{r.virtual_slot: r.shard for r in shards.load_map(spark, path).collect()}]
    more = rows + [(i, "one hot copy") for i in range(5000, 6000)] + [(7, "same id, same text")] * 500
    for count in (8, 8, 5):
        got = shards.rebalance(documents(spark, more), count, path).collect()
        assert len(got) == len(more) and {r.shard for r in got} == set(range(count))
        _gapless(got)
        now = {r.virtual_slot: r.shard for r in shards.load_map(spark, path).collect()}
        for r in got:
            assert (r.shard_before, r.shard) == (versions[-1][r.virtual_slot], now[r.virtual_slot])
        versions.append(now)
    kinds = [{(a[s], b[s]) for s in a if a[s] != b[s]} for a, b in zip(versions, versions[1:])]
    assert all(new in (6, 7) for _, new in kinds[0])  # added shards take, no other slot moves
    assert kinds[2] and all(old in (5, 6, 7) for old, _ in kinds[2])  # removed shards give
    for i, v in enumerate(versions):  # all versions stay
        assert {r.virtual_slot: r.shard for r in shards.load_map(spark, path, i + 1).collect()} == v


def test_a_shard_that_grew_too_full_gives_slots_away():
    rng = np.random.default_rng(3)
    size = rng.integers(1, 2000, shards.SLOTS)
    old = shards.new_map(size, 10)
    later = np.where(old == 4, size * 3, size)
    new = shards.edited_map(old, later, 10)
    load = np.bincount(new, later, 10)
    assert load.max() <= (1 + shards.SLACK) * later.sum() / 10
    assert set(old[old != new]) == {4}
    assert (shards.edited_map(old, size, 10) == old).all()
    hot = np.zeros(8, np.int64)
    hot[3] = 100  # one slot above every share cannot be split
    assert shards.edited_map(np.arange(8) % 2, hot, 2).tolist() == (np.arange(8) % 2).tolist()


def test_a_map_of_other_slots_is_refused(spark, tmp_path):
    path = str(tmp_path / "map")
    shards.save_map(spark, path, 1, np.zeros(16, np.int32))
    with pytest.raises(ValueError, match="16 slots"):
        shards.rebalance(documents(spark, [(1, "a")]), 2, path)


def test_odd_loads():
    assert shards.grown_map(np.zeros(4, np.int32), np.zeros(4, np.int64), 2).tolist() == [0, 0, 0, 0]
    one = shards.new_map(np.array([10, 0, 0]), 2)
    assert one[0] == 0
    assert shards.grown_map(one, np.array([10, 0, 0]), 3)[0] in (0, 2)


def test_empty_table(spark):
    assert shards.shard(documents(spark, []), 3).collect() == []


def test_empty_table_rebalanced(spark, tmp_path):
    path = str(tmp_path / "map")
    shards.shard(documents(spark, []), 3, path=path)
    assert shards.rebalance(documents(spark, []), 4, path).collect() == []
