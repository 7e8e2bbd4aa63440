"""Linear least squares over tables of any size: tasks add up normal equations, Spark adds up the tasks', small systems are solved after."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: Keys whose sums a task holds at a time.
HELD = 4096
#: Of one key's rows alone: design matrix, values and weights.
Design = Callable[[pd.DataFrame], tuple[np.ndarray, np.ndarray, np.ndarray]]


def normal_sums(rows: DataFrame, keys: Sequence[str], width: int, design: Design) -> DataFrame:
    """keys, sums: of each key, the weighted Gram matrix by rows (width squared), right side (width), sum of weights, of weighted squares, rows used.

    design is given a key's rows in a batch, and may use any column. Rows of weight 0 don't count. A key may have most of the rows: what
    is shuffled are sums, of which a task has one a key and HELD keys.
    """
    size = width * width + width + 3
    kinds = dict(rows.dtypes)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}
        for part in parts:
            for key, own in part.groupby(list(keys), dropna=False, sort=False):
                a, b, w = design(own)
                wa = a * w[:, None]
                sums = np.concatenate([(wa.T @ a).ravel(), wa.T @ b, [w.sum(), w @ (b * b), np.count_nonzero(w)]])
                held[key] = held[key] + sums if key in held else sums
            if len(held) > HELD:
                yield told(held)
                held = {}
        if held:
            yield told(held)

    def told(held: dict[tuple, np.ndarray]) -> pd.DataFrame:
        out = pd.DataFrame(list(held), columns=list(keys))
        return out.assign(sums=list(held.values()))

    found = rows.mapInPandas(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "sums array<double>"]))
    each = found.select(*keys, F.posexplode("sums").alias("_pos", "_v")).groupBy(*keys, "_pos").agg(F.sum("_v").alias("_v"))
    whole = each.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_pos", "_v"))).alias("sums"))  # `size` entries a key
    return whole.where(F.size("sums") == size).select(*keys, F.transform("sums", lambda s: s["_v"]).alias("sums"))


def solved(sums: DataFrame, keys: Sequence[str], width: int) -> DataFrame:
    """keys, coefficients, residual (weighted squares left), n of normal_sums(); the least solution where rows don't settle all coefficients."""
    kinds = dict(sums.dtypes)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = [solve(np.asarray(s, float), width) for s in part["sums"]]
            yield part[list(keys)].assign(coefficients=[o[0] for o in out], residual=[o[1] for o in out], n=[o[2] for o in out])

    return sums.mapInPandas(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "coefficients array<double>, residual double, n long"]))


def solve(sums: np.ndarray, width: int) -> tuple[np.ndarray, float, int]:
    gram, right = sums[: width * width].reshape(width, width), sums[width * width : width * width + width]
    scale = np.sqrt(np.where(np.diag(gram) > 0, np.diag(gram), 1.0))
    found = np.linalg.lstsq(gram / np.outer(scale, scale), right / scale, rcond=1e-12)[0] / scale
    return found, max(0.0, float(sums[-2] - 2 * found @ right + found @ gram @ found)), int(sums[-1])
