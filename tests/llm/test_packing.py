from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from colonnade.llm.packing import CAPACITY, counter, pack, plan, token_counts


def loads(counts, capacity):
    load, seen = Counter(), Counter()
    for size, a, z, first, per in plan(counts, capacity):
        assert a == seen[size] + 1 and z >= a  # ranks follow one another
        seen[size] = z
        for rank in range(a, z + 1):
            load[first + (rank - a) // per] += size
    assert seen == Counter({s: n for s, n in counts.items() if n})
    assert sorted(load) == list(range(len(load)))  # no empty containers
    return load


@given(st.integers(1, 60).flatmap(lambda c: st.tuples(st.just(c), st.dictionaries(st.integers(1, c), st.integers(0, 12), max_size=15))))
@settings(max_examples=300, deadline=None)
def test_plans_hold_every_item_within_capacity(case):
    capacity, counts = case
    load = loads(counts, capacity)
    assert not load or max(load.values()) <= capacity
    # never twice the least number of containers: two neighbours that fit one would have been joined
    assert len(load) <= 2 * -(-sum(s * n for s, n in counts.items()) // capacity) + 1


def best(items, capacity):
    """Fewest containers, by trying everything."""
    items = sorted(items, reverse=True)
    least = [len(items)]

    def place(i, rooms):
        if len(rooms) >= least[0]:
            return
        if i == len(items):
            least[0] = len(rooms)
            return
        for k in range(len(rooms)):
            if rooms[k] >= items[i]:
                place(i + 1, [*rooms[:k], rooms[k] - items[i], *rooms[k + 1 :]])
        place(i + 1, [*rooms, capacity - items[i]])

    place(0, [])
    return least[0]


@given(st.lists(st.integers(1, 12), min_size=1, max_size=8))
@settings(max_examples=100, deadline=None)
def test_near_the_fewest_containers(items):
    assert len(loads(Counter(items), 12)) <= best(items, 12) + 1


def test_large_items_pair_at_most_twice():
    load = Counter()
    for size, a, z, first, per in plan({700: 5, 900: 4, 1300: 6, 600: 3}, 2048):
        for rank in range(a, z + 1):
            load[first + (rank - a) // per] += size > 2048 / 3
    assert max(load.values()) == 2


def test_pack_splits_only_what_exceeds_the_capacity(spark):
    sizes = [5000, 2048, 2049, 0, None, 1, 1, 300, 300, 1700, 1748] + [700] * 40
    df = spark.createDataFrame([(i, s, "x") for i, s in enumerate(sizes)] + [(0, 10, "again")], "id long, n int, container string")
    rows = pack(df, "id", "n").collect()
    pieces = Counter(r["doc_id"] for r in rows)
    assert pieces[0] == 4 and pieces[2] == 2 and all(pieces[i] == 1 for i in range(len(sizes)) if i not in (0, 2))
    load = Counter()
    for r in rows:
        load[r["container"]] += r["tokens"]
    assert max(load.values()) <= CAPACITY and sum(load.values()) == sum(s or 0 for s in sizes) + 10
    assert sorted((r["piece"], r["first_token"], r["tokens"]) for r in rows if r["doc_id"] == 2) == [(0, 0, 2048), (1, 2048, 1)]
    again = pack(df.repartition(7), "id", "n").collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))
    assert pack(df.limit(0), "id", "n").count() == 0
    with pytest.raises(ValueError):
        pack(df, "id", "n", 0)


def test_token_counts(spark):
    tokenizers = pytest.importorskip("public_tokenizers")
    path = str(tokenizers.path("byte_bpe_50k.tiktoken"))
    texts = [None, "", "plain words here", "<|endoftext|>", "a" * 100_000, "😀".encode("utf-16", "surrogatepass").decode("utf-16")]
    got = {r["doc_id"]: r["tokens"] for r in token_counts(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), "id", "text", path).collect()}
    count = counter(path)
    assert got == {i: count(t) if t else 0 for i, t in enumerate(texts)} and got[3] > 1
