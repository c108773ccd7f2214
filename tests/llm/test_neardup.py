from __future__ import annotations

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from seqspark.llm import neardup, simhash
from seqspark.llm.graph import connected_components

from .conftest import collected, words


def components(n: int, links) -> list[int]:
    top = list(range(n))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def brute_simhash(rows):
    marks = [simhash.fingerprint(simhash.shingle_hashes(t, 3)) for _, t in rows]
    root = components(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if (marks[a] ^ marks[b]).bit_count() <= 2])
    first = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            first[root[k]] = min(first.get(root[k], i), i)
    return sorted(((i, f"{marks[k]:016x}", first.get(root[k])) for k, (i, _) in enumerate(rows)), key=repr)


def op7(spark, docs):
    from pyspark.sql import functions as F

    out = simhash.simhash_components(docs)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def test_fingerprint_by_hand():
    import xxhash

    text = "The  cat SAT\ton\nthe mat"
    shingles = ["the cat sat", "cat sat on", "sat on the", "on the mat"]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    assert simhash.shingle_hashes(text, 3).tolist() == h
    assert simhash.fingerprint(simhash.shingle_hashes(text, 3)) == sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) > 2)
    assert simhash.shingle_hashes("A b", 3).tolist() == [xxhash.xxh64_intdigest(b"a b", 42)]


@given(st.lists(st.integers(0, (1 << 12) - 1), max_size=60), st.integers(0, (1 << 12) - 1), st.integers(0, 4))
@settings(max_examples=100, deadline=None)
def test_bk_tree_finds_all_within(values, x, radius):
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    assert sorted(tree.within(x, radius)) == sorted({v for v in values if (v ^ x).bit_count() <= radius})


def near_rows():
    rng = random.Random(9)
    rows = []
    for k in range(40):
        base = words(rng, rng.choice([30, 80, 300])).split()
        rows.append((10 * k, " ".join(base)))
        for j in range(rng.choice([0, 0, 1, 3])):
            new = list(base)
            for _ in range(rng.choice([1, 2, 6])):
                new[rng.randrange(len(new))] = words(rng, 1)
            rows.append((10 * k + j + 1, " ".join(new)))
    return rows + [(900, None), (901, ""), (902, "one two"), (903, "ONE  two"), (0, rows[0][1])]


def test_simhash_components(spark, awkward, nothing):
    rows = near_rows()
    assert collected(op7(spark, spark.createDataFrame(rows, "doc_id long, text string"))) == brute_simhash(rows)
    assert collected(op7(spark, awkward)) == brute_simhash([(r.doc_id, r.text) for r in awkward.collect()])
    assert op7(spark, nothing).count() == 0


def test_components(spark):
    rng = random.Random(1)
    links = [(k, k + 1) for k in range(0, 60)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(70)] + [(5, 5), (5, 6)]
    root = components(200, links)
    touched = {x for a, b in links if a != b for x in (a, b)}
    got = connected_components(spark.createDataFrame([*links, (None, 3)], "u long, v long"))
    assert collected(got) == sorted(((x, root[x]) for x in touched), key=repr)


def shingles(text):
    w = (text or "").encode().translate(simhash.LOWER).split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute_keepers(rows, similarity=0.8):
    sets = [shingles(t) for _, t in rows]

    def near(a, b):
        both = len(sets[a] & sets[b])
        total = len(sets[a] | sets[b])
        return total == 0 or both >= similarity * total - 1e-9

    root = components(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if near(a, b)])
    best = {}
    for k, (i, t) in enumerate(rows):
        key = (i is None, i or 0)
        if root[k] not in best or key < best[root[k]][0]:
            best[root[k]] = (key, i)
    return sorted((i for _, i in best.values()), key=repr)


def test_ways_of_checking_agree(monkeypatch):
    import numpy as np

    rng = random.Random(3)
    base = list(range(50))
    sets = [np.array(sorted({*rng.sample(base, rng.randint(36, 50)), *(rng.randrange(1000, 9000) for _ in range(rng.randint(0, 4)))}), np.uint64) for _ in range(120)] + [np.zeros(0, np.uint64)] * 2
    keys, side = list(range(len(sets))), [k % 2 for k in range(len(sets))]
    for s in (None, side):
        assert neardup._all_intersections(sets) is not None
        fast = components(len(sets), neardup.similar_forest(keys, sets, s, 0.8))
        with monkeypatch.context() as m:
            m.setattr(neardup, "_all_intersections", lambda _: None)
            slow = components(len(sets), neardup.similar_forest(keys, sets, s, 0.8))
        assert fast == slow and len(set(fast)) > 1


def test_near_copies_are_dropped(spark, awkward, nothing):
    rows = near_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("doc_id", "doc_id").repartition(3)
    for block in (1000, 2):
        groups = neardup.near_groups(docs, block=block).where("keeper")
        assert sorted((r.doc_id for r in groups.collect()), key=repr) == brute_keepers(rows)
    kept = neardup.drop_near_copies(awkward)
    assert kept.dtypes == awkward.dtypes
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == brute_keepers([(r.doc_id, r.text) for r in awkward.collect()])
    assert neardup.drop_near_copies(nothing).count() == 0


def test_large_families_need_no_pairs(spark):
    """A family of different texts in one cluster: a pivot joins them, so none meets another."""
    rng = random.Random(31)
    base = [f"{words(rng, 1)}{k}" for k in range(200)]
    rows = []
    for k in range(300):
        new = list(base)
        new[rng.randrange(200)] = f"other{k}"
        rows.append((k, " ".join(new)))
    fringe = [*base[:150], *[f"tail{k}" for k in range(50)]]  # not similar to the family; similar to each other
    rows += [(1000, " ".join(fringe)), (1001, " ".join([*fringe[:-1], "last"])), (2000, words(rng, 80))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for block in (1000, 20):
        groups = neardup.near_groups(docs, block=block).where("keeper")
        assert sorted(r.doc_id for r in groups.collect()) == brute_keepers(rows) == [0, 1000, 2000]


def test_bands_find_most_close_copies():
    rng = random.Random(4)
    width, radius = neardup.plan_bands(1_000_000, 0.8)
    assert width >= 16 and 19 < radius < 40
    tree = simhash.BKTree()
    for x in (0, 3, (1 << 40) - 1):
        tree.add(x)
    assert tree.first_within(1, 1) in (0, 3) and tree.first_within(1 << 50 | 1, 1) is None
    values = [rng.getrandbits(128) for _ in range(300)]
    for v in values:
        tree.add(v)
    assert all(tree.first_within(v ^ 5, 2) is not None for v in values)


def test_hot_shards_are_parted():
    rng = random.Random(5)
    values = list({(0xABCD << 48) | rng.getrandbits(14) for _ in range(3000)})
    for most in (50, 4000):
        links = simhash.shard_links(values, 2, most)
        at = {v: k for k, v in enumerate(values)}
        root = components(len(values), [(at[u], at[v]) for u, v in links])
        assert all((u ^ v).bit_count() <= 2 for u, v in links)
        whole = components(len(values), [(at[u], at[v]) for u, v in simhash.tree_links(values, 2)])
        assert root == whole


def test_one_block_runs_in_several_tasks(spark):
    from pyspark.sql import functions as F

    some = spark.range(50_000).select((F.lit(0x1234).cast("long") * (1 << 45) + F.pmod(F.xxhash64("id"), F.lit(1 << 44))).alias("fp")).distinct()
    dealt = simhash.dealt_by_blocks(some, 2)
    assert dealt.groupBy("b", "v").count().agg(F.max("count")).first()[0] < 50
    alike = dealt.where("b = 5").repartition(8, "b", "v").select(F.spark_partition_id().alias("p")).distinct().count()
    assert alike == 8


def test_lists_are_chained_over_partitions(spark):
    rows = [(k, 10 + k // 40, s) for s in (1, 2) for k in range(400)] + [(1000, 50, 3), (1001, 100, 3)]
    links = neardup.chained(spark.createDataFrame(rows, "key long, n long, shingle long"), 0.8).collect()
    root = components(1002, [(r.u, r.v) for r in links])
    assert len({root[k] for k in range(400)}) == 1 and root[1000] != root[1001]


def test_bit_table_lets_all_keys_through(spark):
    from pyspark.sql import functions as F

    from seqspark.llm.common import maybe_in

    df = spark.range(2000).select(F.xxhash64("id").alias("k"), F.when(F.col("id") > 5, 1).alias("text"))
    keys = df.limit(300).select("k").union(spark.createDataFrame([(None,)], "k long"))
    for bits in (6, 12, 22):
        out = maybe_in(df, F.col("k"), keys, bits)
        assert out.columns == ["k", "text", "__maybe"] and out.count() == 2000
        assert out.join(keys, "k").where("NOT __maybe").count() == 0
    assert maybe_in(df, F.col("k"), keys, 22).where("__maybe").count() < 320
    assert maybe_in(df, F.col("k"), keys.limit(0), 12).where("__maybe").count() == 0


def test_no_pair_is_let_go(spark, monkeypatch):
    """Short texts at the very threshold, where the bits of the fingerprints differ most, and long ones near it."""
    rng = random.Random(12)
    rows = []
    for k in range(400):
        base = [f"{words(rng, 1)}{rng.randrange(1000)}" for _ in range(9 if k < 300 else 300)]
        other = base[:8] if k < 300 else [*base[: rng.randint(240, 268)], *words(rng, 5).split()]
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(other))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted((r.doc_id for r in neardup.near_groups(docs).where("keeper").collect()), key=repr)
    want = brute_keepers(rows)
    assert kept == want and 400 < len(kept) < 800
    monkeypatch.setattr(neardup, "COMMON", 2)  # nearly every shingle is told as it comes
    assert sorted((r.doc_id for r in neardup.near_groups(docs).where("keeper").collect()), key=repr) == want


@given(st.integers(1, 60), st.integers(0, 14), st.integers(0, 14), st.integers(0, 9))
@settings(max_examples=300, deadline=None)
def test_similar_sets_share_leading_shingles(both, a, b, seed):
    rng = random.Random(seed)
    pool = rng.sample(range(10_000), both + a + b)
    one, two = sorted(pool[: both + a]), sorted(pool[:both] + pool[both + a :])
    if both >= 0.8 * len(pool) - 1e-9:
        import numpy as np

        leads = [(neardup.lead(np.array(x, np.uint64), 0.8)) for x in (one, two)]
        common = set(np.frombuffer(leads[0][2], np.uint64)) & set(np.frombuffer(leads[1][2], np.uint64))
        assert len(common) >= max(leads[0][1], leads[1][1])
