from itertools import combinations

import numpy as np

from filterlab.llm import line_dedup


def missed(similarity: float) -> float:
    """The share of line pairs without a common band, by all 2^16 patterns of equal minima."""
    patterns = np.arange(1 << 16)
    equal = sum((patterns >> k) & 1 for k in range(16))
    alike = np.zeros(1 << 16, bool)
    for band in line_dedup._bands():
        mask = sum(1 << k for k in band)
        alike |= patterns & mask == mask
    return float((similarity**equal * (1 - similarity) ** (16 - equal))[~alike].sum())


def test_bands_miss_no_more_than_documented():
    bands = line_dedup._bands()
    assert len(bands) == 20 and all(len(set(b)) == 4 for b in bands)
    assert all(len(set(a) & set(b)) <= 1 for a, b in combinations(bands, 2))
    assert missed(0.8) <= 0.0055 and missed(0.85) <= 0.001 and missed(0.9) <= 0.0001
