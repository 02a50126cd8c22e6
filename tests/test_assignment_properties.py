"""Whatever the subscriptions, each partition has one owner, and uniform groups are even."""

from hypothesis import given, settings
from hypothesis import strategies as st

from streamloom.operators.groups import _deal

TOPICS = ("a", "b", "c")


@settings(max_examples=150, deadline=None)
@given(
    st.dictionaries(st.sampled_from([f"m{i}" for i in range(6)]), st.sets(st.sampled_from(TOPICS), min_size=1), min_size=1),
    st.lists(st.integers(0, 6), min_size=3, max_size=3),
    st.sampled_from(["round_robin", "sticky", "cooperative"]),
    st.dictionaries(st.sampled_from([f"m{i}" for i in range(6)]), st.lists(st.tuples(st.sampled_from(TOPICS), st.integers(0, 6)), max_size=6), max_size=4),
)
def test_every_partition_once(subscribed, sizes, policy, before):
    parts = [(t, i) for t, n in zip(TOPICS, sizes) for i in range(n) if any(t in s for s in subscribed.values())]
    out = _deal(policy, parts, subscribed, before)
    got = [p for v in out.values() for p in v]
    assert sorted(got) == sorted(parts)
    assert all(p[0] in subscribed[m] for m, v in out.items() for p in v)
    if len({frozenset(s) for s in subscribed.values()}) == 1 and policy != "sticky":
        sizes = [len(v) for v in out.values()]
        assert max(sizes) - min(sizes) <= 1
