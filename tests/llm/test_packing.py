from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from draftloom.llm import packing as p


@given(st.lists(st.tuples(st.integers(1, 40), st.integers(1, 30)), max_size=20), st.integers(40, 60))
@settings(max_examples=150, deadline=None)
def test_plan_holds_every_item_once(histogram, capacity):
    merged = Counter()
    for length, n in histogram:
        merged[length] += n
    slots, opened = p.plan(list(merged.items()), capacity)
    used, placed = defaultdict(int), Counter()
    for length, each, first, count in slots:
        placed[length] += each * count
        for k in range(first, first + count):
            used[k] += each * length
    assert placed == merged
    assert set(used) == set(range(opened)) and all(v <= capacity for v in used.values())
    # best fit leaves no two containers that would both be at most half full
    assert sum(2 * v <= capacity for v in used.values()) <= 1


TEXTS = [(i, f"word{i % 7} " * (i % 40), "clash") for i in range(120)] + [(200, "long text here " * 400, ""), (201, "", ""), (202, None, ""), (203, "hi", ""), (203, "hi", "")]


def pieces(spark, rows, targets):
    return p.pack(spark.createDataFrame(rows, "doc_id long, text string, container_no string"), targets).collect()


def test_pack_is_whole_and_fits(spark):
    targets = [(1, 32), (2, 100)]
    got = pieces(spark, TEXTS, targets)
    lengths = {(r["doc_id"], r["n"]) for r in p.token_counts(spark.createDataFrame(TEXTS, "doc_id long, text string, c string")).collect()}
    for target, capacity in targets:
        mine = [r for r in got if r["target_id"] == target]
        fill, total, cuts = Counter(), Counter(), Counter()
        for r in mine:
            fill[r["container_no"]] += r["n_tokens"]
            total[r["doc_id"]] += r["n_tokens"]
            cuts[r["doc_id"]] += 1
        assert max(fill.values()) <= capacity and set(fill) == set(range(max(fill) + 1))
        for doc, n in lengths:
            assert total[doc] == n * (2 if doc == 203 else 1)
            if n <= capacity and doc != 203:
                assert cuts[doc] == 1
        tokens = sum(total.values())
        assert len(fill) <= 1.02 * -(-tokens // capacity) + 1
        long = sorted((r["start_token"], r["n_tokens"]) for r in mine if r["doc_id"] == 200)
        assert [a for a, _ in long] == [sum(n for _, n in long[:i]) for i in range(len(long))]


def test_empty_and_bad_capacity(spark):
    assert pieces(spark, [], [(1, 10)]) == []
    assert {r["container_no"] for r in pieces(spark, [(1, "", ""), (2, None, "")], [(1, 10)])} == {0}
    with pytest.raises(ValueError):
        pieces(spark, TEXTS, [(1, 0)])


def test_the_vocabulary_is_a_setting_of_the_session(spark):
    spark.conf.set(p.TOKENIZER_CONF, "/nowhere/vocabulary")
    try:
        with pytest.raises(Exception, match="no vocabulary file /nowhere/vocabulary"):
            pieces(spark, TEXTS[:3], [(1, 32)])
    finally:
        spark.conf.unset(p.TOKENIZER_CONF)
