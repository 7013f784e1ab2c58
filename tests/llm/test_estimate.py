"""Which pairs op5_near_duplicates looks at."""

import numpy as np

from larkspur.llm import neardup


def test_unlucky_registers_are_still_looked_at():
    """Of two equally large sets of similarity 0.75, fewer than 77 of 128 registers agree once in 13,000 pairs."""
    equal = np.array([76, 70, 65, 40])
    more = (128 - equal) // 2
    assert neardup.likely(equal, more, 128 - equal - more, np.full(4, 900.0), np.full(4, 900.0)).tolist() == [True, True, True, False]
