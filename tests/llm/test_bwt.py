import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from barloom.llm import bwt


def plain(strings, cap):
    suffixes = sorted(((s[i:], n, i) for n, s in enumerate(strings) for i in range(len(s) + 1)), key=lambda x: ([*x[0]], x[1]))
    lcp = [0]
    for (a, _, _), (b, _, _) in zip(suffixes, suffixes[1:], strict=False):
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        lcp.append(min(n, cap))
    before = [strings[n][i - 1] + 1 if i else 0 for _, n, i in suffixes]
    return before, lcp[: len(suffixes)], [n for _, n, _ in suffixes], [i for _, _, i in suffixes]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.binary(max_size=12).map(lambda b: bytes(x % 3 + 97 for x in b)), max_size=8), st.integers(1, 5))
def test_equals_sorted_suffixes(tmp_path_factory, strings, cap):
    folder = tmp_path_factory.mktemp("columns")
    got = bwt.build(strings, folder, cap)
    assert [x.tolist() for x in got] == [list(x) for x in plain(strings, cap)] or not strings
    assert not list(folder.iterdir())


@pytest.mark.parametrize("cap", [4, 100])
def test_long_repeats(tmp_path, cap):
    rng = np.random.default_rng(1)
    core = bytes(rng.integers(97, 123, 150, dtype=np.uint8))
    strings = [core, core[20:140], b"x" + core, b"a" * 130, b"a" * 90, b"\xf4\x80" + core[:110]]
    assert [x.tolist() for x in bwt.build(strings, tmp_path, cap)] == [list(x) for x in plain(strings, cap)]
