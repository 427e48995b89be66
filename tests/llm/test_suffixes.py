"""Two-stage suffix sorting against sorting the suffixes themselves."""

import numpy as np
import pytest

from tetrad.llm.suffixes import common_prefixes, repeated_windows, suffix_array


@pytest.mark.parametrize("seed", range(30))
def test_against_plain_sorting(seed):
    r = np.random.default_rng(seed)
    n, letters = int(r.integers(0, 400)), int(r.integers(1, 5))
    data = r.integers(97, 97 + letters, n).astype(np.uint8)
    if seed % 3 == 0 and n:
        data = np.tile(data[: max(1, n // 7)], 7)
    raw = data.tobytes()
    order = suffix_array(data)
    assert order.tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])
    prefixes = common_prefixes(data, order, 20)
    for k in range(1, len(raw)):
        a, b = raw[order[k - 1] :], raw[order[k] :]
        same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert prefixes[k] == min(same, 20)
    starts = np.arange(max(0, len(raw) - 11))
    windows = [raw[i : i + 12] for i in starts]
    assert repeated_windows(data, starts, 12).tolist() == [windows.count(w) > 1 for w in windows]
