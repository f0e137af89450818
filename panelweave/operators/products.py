"""Cross-products of a model matrix without the matrix: a factor is one number per row, the position of its level.

A pair of terms costs one addition per row, so a factor of thousands of levels costs no more than one of two. A task
holds what the pairs of terms can fill: a diagonal for a factor, a table of levels for two factors.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd

from panelweave.operators.model import Factor, Layout


@dataclass(frozen=True)
class Shape:
    """What tasks need to know of a layout: where its plain columns and its factors' levels stand."""

    width: int
    intercept: bool
    numbers: tuple[tuple[str, int], ...]
    factors: tuple[tuple[str, int, int], ...]  # column, first position, levels

    @staticmethod
    def of(layout: Layout) -> Shape:
        named = list(zip(layout.column_names(), layout.terms, layout.starts, strict=True))
        numbers = [(name, start) for name, term, start in named if not isinstance(term, Factor)]
        factors = [(name, start, len(term.levels)) for name, term, start in named if isinstance(term, Factor)]
        return Shape(layout.width, layout.intercept, tuple(numbers), tuple(factors))

    @property
    def plain(self) -> np.ndarray:
        """Positions of the intercept and the numbers."""
        return np.array([0] * self.intercept + [at for _, at in self.numbers], int)

    def block(self, batch: pd.DataFrame) -> Block:
        ones = [np.ones(len(batch))] * self.intercept
        numbers = [batch[name].to_numpy(float) for name, _ in self.numbers]
        numeric = np.column_stack([*ones, *numbers]) if ones or numbers else np.zeros((len(batch), 0))
        return Block(self, numeric, [batch[name].to_numpy(float).astype(int) for name, _, _ in self.factors])


@dataclass(frozen=True)
class Block:
    """The rows of one batch: plain columns as numbers, factors as level numbers from 0."""

    shape: Shape
    numeric: np.ndarray
    levels: Sequence[np.ndarray]

    def of_rows(self, mask: np.ndarray) -> Block:
        return Block(self.shape, self.numeric[mask], [x[mask] for x in self.levels])

    def __len__(self) -> int:
        return len(self.numeric)

    def predictor(self, beta: np.ndarray) -> np.ndarray:
        out = self.numeric @ beta[self.shape.plain]
        for level, (_, start, _) in zip(self.levels, self.shape.factors, strict=True):
            out = out + beta[start + level]
        return out

    def sums(self, values: np.ndarray) -> np.ndarray:
        """The columns times `values`, added up."""
        return self._by_column(values @ self.numeric, values)

    def counts(self) -> np.ndarray:
        """Rows in which each column is not zero."""
        return self._by_column((self.numeric != 0).sum(axis=0), None)

    def _by_column(self, plain: np.ndarray, weights: np.ndarray | None) -> np.ndarray:
        out = np.zeros(self.shape.width)
        out[self.shape.plain] = plain
        for level, (_, start, size) in zip(self.levels, self.shape.factors, strict=True):
            out[start : start + size] = np.bincount(level, weights, minlength=size)
        return out

    def entries(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, position, value) of everything that isn't zero by construction, each row times its value."""
        rows = np.arange(len(self))
        at = [np.full(len(self), p) for p in self.shape.plain]
        found = [self.numeric[:, k] * values for k in range(len(at))]
        at += [start + level for level, (_, start, _) in zip(self.levels, self.shape.factors, strict=True)]
        found += [values] * len(self.levels)
        return np.tile(rows, len(at)), np.concatenate(at), np.concatenate(found)


class CrossProduct:
    """X' W X added up over batches, kept by pairs of terms."""

    def __init__(self, shape: Shape):
        self.shape = shape
        plain, sizes = len(shape.plain), [size for _, _, size in shape.factors]
        self.numeric = np.zeros((plain, plain))
        self.mixed = [np.zeros((plain, size)) for size in sizes]
        self.own = [np.zeros(size) for size in sizes]
        self.crossed = {(a, b): np.zeros((sizes[a], sizes[b])) for b in range(len(sizes)) for a in range(b)}

    def add(self, block: Block, weights: np.ndarray) -> None:
        weighted = block.numeric * weights[:, None]
        self.numeric += block.numeric.T @ weighted
        for k, (level, (_, _, size)) in enumerate(zip(block.levels, self.shape.factors, strict=True)):
            self.own[k] += np.bincount(level, weights, minlength=size)
            for column, total in zip(weighted.T, self.mixed[k], strict=True):
                total += np.bincount(level, column, minlength=size)
        for (a, b), total in self.crossed.items():
            np.add.at(total, (block.levels[a], block.levels[b]), weights)

    def cells(self) -> tuple[np.ndarray, np.ndarray]:
        """Places in the upper triangle, counted row by row, and their values, zeros left out."""
        plain, starts = self.shape.plain, [start for _, start, _ in self.shape.factors]
        span = [np.arange(start, start + size) for _, start, size in self.shape.factors]
        upper = np.triu_indices(len(plain))
        parts = [(plain[upper[0]], plain[upper[1]], self.numeric[upper])]
        for k in range(len(starts)):
            parts.append((span[k], span[k], self.own[k]))
            parts.append((np.repeat(plain, len(span[k])), np.tile(span[k], len(plain)), self.mixed[k].ravel()))
        for (a, b), total in self.crossed.items():
            (one, other) = np.nonzero(total)
            parts.append((span[a][one], span[b][other], total[one, other]))
        rows, columns, values = (np.concatenate(each) for each in zip(*parts, strict=True))
        low, high = np.minimum(rows, columns).astype(np.int64), np.maximum(rows, columns).astype(np.int64)
        kept = values != 0
        places = low * self.shape.width - low * (low - 1) // 2 + (high - low)
        return places[kept], values[kept]
