"""Marks of rows that share an id are dealt over all groups."""

import numpy as np
import pytest

from hackney.llm import marks
from hackney.llm.common import NULL_ID


@pytest.mark.parametrize("keys", [np.full(4000, NULL_ID), np.full(4000, 7), np.arange(4000) * 16])
def test_groups_are_even(keys):
    ties = np.random.default_rng(1).integers(-(1 << 63), 1 << 63, 4000)
    found = marks.packed(keys, ties, np.arange(4000, dtype=np.uint32), 16)
    sizes = [len(row["counts"]) // 4 for row in found.to_pylist()]
    assert len(sizes) == 16 and sum(sizes) == 4000 and max(sizes) < 400
    # A document has the same group in every message.
    again = marks.packed(keys[::-1], ties[::-1], np.arange(4000, dtype=np.uint32), 16)
    places = [{(row["group"], tie) for row in rows.to_pylist() for tie in np.frombuffer(row["ties"], np.int64)} for rows in (found, again)]
    assert places[0] == places[1]
