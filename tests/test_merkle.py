"""The hash tree against one built in plain Python: roots, inclusion, consistency, differences; several rounds of blocks."""

import hashlib

import pytest
from pyspark.sql import functions as F

from steadyline.operators import merkle


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def levels_of(hashes):
    out = [hashes]
    while len(out[-1]) > 1:
        now = out[-1]
        out.append([sha("node#" + now[i] + now[i + 1]) if i + 1 < len(now) else now[i] for i in range(0, len(now), 2)])
    return out


def log(spark, n, altered=()):
    text = F.when(F.col("id").isin(list(altered)), "other").otherwise(F.concat(F.lit("event "), F.col("id").cast("string"))) if altered else F.concat(F.lit("event "), F.col("id").cast("string"))
    return spark.range(n).select((F.col("id") * 3).alias("seq"), text.alias("text"), F.lit("who").alias("extra"))


def tree_of(spark, n, altered=()):
    numbered = merkle.leaves(log(spark, n, altered), ["seq"], ["text"])
    return merkle.tree(numbered), numbered


def plain(n):
    return levels_of([sha("leaf#" + sha(f"event {i}")) for i in range(n)])


@pytest.fixture
def low(monkeypatch):
    """Blocks of eight, so that small logs take several rounds."""
    monkeypatch.setattr(merkle, "LEVELS", 3)
    monkeypatch.setattr(merkle, "BLOCK", 8)


def test_root_and_paths_match_a_plain_tree(spark, low):
    for n in (1, 2, 7, 8, 9, 64, 75):
        t, numbered = tree_of(spark, n)
        levels = plain(n)
        assert (t.size, t.root()) == (n, levels[-1][0])
        for r in merkle.proofs(t).collect():
            path, at = [], r["position"]
            for level in levels[:-1]:
                if at ^ 1 < len(level):
                    path.append((at % 2 == 1, level[at ^ 1]))
                at >>= 1
            assert [tuple(s) for s in r["path"]] == path and r["leaf"] == levels[0][r["position"]]


def test_full_blocks_give_the_same_root(spark):
    t, _ = tree_of(spark, 2500)
    assert t.root() == plain(2500)[-1][0] and t.rounds == 2


def test_only_altered_events_fail(spark, low):
    t, numbered = tree_of(spark, 75)
    proven = merkle.proofs(t).join(numbered.select("seq", "position"), "position")
    got = merkle.verified(log(spark, 77, (4, 70)), proven, t.root(), ["seq"], ["text"])
    assert sorted(r["seq"] // 3 for r in got.where("not ok").collect()) == [4, 70, 75, 76]
    few = merkle.proofs(t, spark.createDataFrame([(9,), (9,), (74,), (500,)], "position bigint"))
    assert sorted(r["position"] for r in few.collect()) == [9, 74]


def test_a_leaf_is_no_inner_node(spark, low):
    """Two leaves put together as one event's text don't give their parent's hash."""
    a, b = (sha("leaf#" + sha(f"event {i}")) for i in range(2))
    assert sha("leaf#" + sha("node#" + a + b)) != plain(2)[-1][0]


@pytest.mark.parametrize("size, later", [(1, 1), (1, 2), (6, 8), (8, 75), (63, 64), (64, 75), (74, 75), (75, 75)])
def test_a_log_that_only_grew_is_consistent(spark, low, size, later):
    t, _ = tree_of(spark, later)
    proof = merkle.consistency(t, size)
    assert merkle.consistent(proof, plain(size)[-1][0], t.root())
    assert not merkle.consistent(proof, sha("another"), t.root())
    assert not merkle.consistent(proof, plain(size)[-1][0], sha("another"))


def test_rewritten_history_is_not_consistent(spark, low):
    t, _ = tree_of(spark, 75, (5,))
    assert not merkle.consistent(merkle.consistency(t, 40), plain(40)[-1][0], t.root())
    with pytest.raises(ValueError):
        merkle.consistency(t, 76)


def test_differences_are_found_from_the_root_down(spark, low):
    def found(n, m, altered=()):
        return sorted(r["position"] for r in merkle.differing(tree_of(spark, n)[0], tree_of(spark, m, altered)[0]).collect())

    assert found(75, 75) == [] and found(75, 75, (0, 33, 74)) == [0, 33, 74]
    assert found(75, 80, (3,)) == [3, 75, 76, 77, 78, 79] and found(9, 8) == [8] and found(64, 3) == list(range(3, 64))


def test_empty_log(spark):
    t, _ = tree_of(spark, 0)
    assert (t.size, t.root()) == (0, merkle.EMPTY) and merkle.proofs(t).count() == 0 and merkle.seal(t).first()["root"] == merkle.EMPTY
