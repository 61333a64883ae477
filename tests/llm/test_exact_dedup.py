import hashlib
from collections import defaultdict

import pytest

from orderlens.llm.exact_dedup import exact_dedup


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_against_plain_version(docs, rows, keep):
    groups = defaultdict(list)
    for i, text, *_ in rows:
        groups[text].append(i)
    best = min if keep == "smallest" else max
    want = sorted((i, best(groups[t]), len(groups[t]), i == best(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t, *_ in rows)
    assert sorted(tuple(r) for r in exact_dedup(docs, keep=keep).collect()) == want
    assert any(x[2] > 3 for x in want)


def test_odd_rows(odd, none):
    got = exact_dedup(odd, keep="largest").collect()
    assert len(got) == odd.count()
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    assert by[1000][0].keep_id == by[1001][0].keep_id == 1001  # null counts as empty
    assert [r.kept for r in by[1000] + by[1001]] == [False, True]
    assert sorted(r.kept for r in by[1005]) == [False, True] and by[1005][0].group_size == 2  # repeated row
    assert by[None][0].keep_id is None and by[None][0].kept
    assert exact_dedup(none).count() == 0


def test_keep_is_checked(docs):
    with pytest.raises(ValueError):
        exact_dedup(docs, keep="first")
