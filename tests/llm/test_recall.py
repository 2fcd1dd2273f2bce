"""Recall of the multi-index on links just above the threshold, with many cells and a sample that holds few pairs."""

import numpy as np

from panelrec.llm import vectors


def test_links_at_the_threshold_are_met(monkeypatch):
    monkeypatch.setattr(vectors, "ROWS_PER_CELL", 8)
    rng = np.random.default_rng(7)
    x = vectors.unit_rows(rng.normal(size=(4000, 24)))
    turn = rng.normal(size=x.shape)
    turn = vectors.unit_rows(turn - (turn * x).sum(1, keepdims=True) * x)
    c = rng.uniform(0.9, 0.93, len(x))[:, None]
    y = c * x + np.sqrt(1 - c * c) * turn
    both = np.concatenate((x, y))
    sample = both[rng.choice(len(both), 500, replace=False)]
    grid = vectors.fit_grid(sample, len(both), 0.9, 0.97)
    cells = len(grid.first) * len(grid.second)
    assert cells > 500 and grid.visits < cells
    one, two = grid.visited(x, grid.visits), grid.visited(y, grid.visits)
    met = (one == two[:, :1]).any(1) | (two == one[:, :1]).any(1)
    assert met.mean() >= 0.95
