"""What a training step adds up: rows of equal symbols together, however large the symbols' numbers are."""

import numpy as np
import pytest

from tessera.llm import language_model


@pytest.mark.parametrize("most", [700, 1 << 15, (1 << 15) + 1, 70_000])
def test_rows_of_a_symbol_are_added_up(most):
    rng = np.random.default_rng(most)
    rows, values = rng.integers(0, most, 3000), rng.integers(0, 9, (3000, 4)).astype(np.float32)
    rows[:2] = 0, most - 1
    want, got = np.zeros((most, 4), np.float32), np.zeros((most, 4), np.float32)
    np.add.at(want, rows, values)
    language_model._add_rows(got, language_model._by_row(rows, most), values)
    assert (got == want).all()
