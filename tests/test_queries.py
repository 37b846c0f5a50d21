import pytest

from leafspan.plans import queries
from tests.oracle import both

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_against_oracle(spark, name):
    if name not in queries.ORACLES:
        assert queries.QUERIES[name](spark, SF).count() >= 0
        return
    got, want = both(spark, SF, queries.QUERIES[name], queries.ORACLES[name])
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    problem = "" if len(got) == len(want) > 0 and not bad else f"{len(got)} {len(want)} {bad[:3]}"
    assert not problem
