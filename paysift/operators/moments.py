"""Sufficient statistics of vector columns: sums over slots and pairs of slots,
and the linear models and correlations that follow from them.

Vectors are read as their stored entries, so a sparse vector costs its
non-zero slots (or pairs of them) only; sums run as native aggregates, first
per partition.  What reaches the driver has the size of a linear model's normal
equations, bounded by ``MAX_WIDTH``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import unwrap_udt

from paysift.functions.exprs import col_of

#: Slots of the constant 1 and of the label in a table of products.
ONE, LABEL = -1, 2 ** 31 - 1
#: Widest vector whose products are brought to the driver.
MAX_WIDTH = 4096


def stored(vec: str) -> Column:
    """The non-zero entries (slot, val) of a vector column, by slot."""
    v = unwrap_udt(col_of(vec))
    places = F.when(v["type"] == 0, v["indices"]).otherwise(
        F.transform(v["values"], lambda x, i: i))
    return F.filter(F.arrays_zip(places.alias("slot"),
                                 v["values"].alias("val")),
                    lambda e: e["val"] != 0.0)


def _entry(slot: int, val: Column) -> Column:
    return F.array(F.struct(F.lit(slot).alias("slot"),
                            val.cast("double").alias("val")))


def products(df: DataFrame, vec: str, label: str | None = None,
             by: Sequence[str] = ()) -> DataFrame:
    """(by..., i, j, s): the sum of slot i times slot j, i <= j, for pairs
    that are non-zero in some row; slot ONE is the constant, so (ONE, ONE)
    counts rows and (ONE, j) sums slots, and slot LABEL the label.

    No row or task holds the matrix: the sums are spread over the cluster by
    their pair.
    """
    parts = [_entry(ONE, F.lit(1.0)), stored(vec)]
    if label is not None:
        parts.append(_entry(LABEL, col_of(label)))
    rows = df.select(*by, F.concat(*parts).alias("e"))
    left = rows.select(*by, "e", F.posexplode("e").alias("k", "a"))
    pairs = left.select(*by, "a", F.explode(F.slice(
        "e", F.col("k") + 1, F.size("e") - F.col("k"))).alias("b"))
    return pairs.groupBy(*by, F.col("a.slot").alias("i"),
                         F.col("b.slot").alias("j")) \
        .agg(F.sum(F.col("a.val") * F.col("b.val")).alias("s"))


@dataclass
class Moments:
    """Sums of a set of rows: their number, slots, label and products."""
    n: float
    x: np.ndarray
    y: float
    xx: np.ndarray
    xy: np.ndarray
    yy: float

    @classmethod
    def zero(cls, width: int) -> Moments:
        return cls(0.0, np.zeros(width), 0.0, np.zeros((width, width)),
                   np.zeros(width), 0.0)

    def __add__(self, o: Moments) -> Moments:
        return Moments(self.n + o.n, self.x + o.x, self.y + o.y,
                       self.xx + o.xx, self.xy + o.xy, self.yy + o.yy)

    def put(self, i: int, j: int, s: float) -> None:
        if j == ONE:
            self.n = s
        elif i == LABEL:
            self.yy = s
        elif i == ONE and j == LABEL:
            self.y = s
        elif i == ONE:
            self.x[j] = s
        elif j == LABEL:
            self.xy[i] = s
        else:
            self.xx[i, j] = self.xx[j, i] = s


def moments_by(df: DataFrame, vec: str, label: str, by: str,
               width: int) -> dict:
    """The moments of each value of ``by``, from one pass over ``df``."""
    if width > MAX_WIDTH:
        raise ValueError(f"{width} slots are more than {MAX_WIDTH}")
    out: dict = {}
    for v, i, j, s in products(df, vec, label, [by]).collect():
        out.setdefault(v, Moments.zero(width)).put(i, j, s)
    return out


def _penalised(a: np.ndarray, c: np.ndarray, l1: float) -> np.ndarray:
    """argmin of b'ab/2 - c'b + l1 |b|: coordinate descent, closed by the
    exact solution on the signs it settles on."""
    b = np.linalg.lstsq(a, c, rcond=None)[0]
    if not l1:
        return b
    d = np.diag(a)
    for sweep in range(100_000):
        if sweep % 10 == 0:
            on = b != 0
            exact = np.zeros_like(b)
            exact[on] = np.linalg.lstsq(
                a[np.ix_(on, on)], c[on] - l1 * np.sign(b[on]),
                rcond=None)[0]
            slope = c - a @ exact
            if (np.sign(exact) == np.sign(b)).all() and \
                    (np.abs(slope[~on]) <= l1).all():
                return exact
        most = 0.0
        for j in range(len(b)):
            r = c[j] - a[j] @ b + d[j] * b[j]
            new = np.sign(r) * max(abs(r) - l1, 0.0) / d[j]
            most = max(most, abs(new - b[j]))
            b[j] = new
        if most <= 1e-15 * max(1.0, np.abs(b).max()):
            break
    return b


def elastic_net(m: Moments, reg: float, mix: float,
                intercept: bool) -> tuple[np.ndarray, float]:
    """Coefficients and intercept of squared error with an elastic net over
    standardised slots and label: penalty ``reg`` divided by the label's
    deviation, of which the share ``mix`` is absolute, the rest squared.
    Constant slots get 0."""
    mx, my = m.x / m.n, m.y / m.n
    sx = np.sqrt(np.maximum(np.diag(m.xx) / m.n - mx * mx, 0.0))
    sx[sx <= 1e-12 * np.sqrt(np.diag(m.xx) / m.n)] = 0.0
    sy = np.sqrt(max(m.yy / m.n - my * my, 0.0))
    coef = np.zeros(len(mx))
    if sy == 0.0:
        if intercept or my == 0.0:
            return coef, my if intercept else 0.0
        sy = abs(my)
    on = sx > 0
    a, c = m.xx[np.ix_(on, on)] / m.n, m.xy[on] / m.n
    if intercept:
        a = a - np.outer(mx[on], mx[on])
        c = c - mx[on] * my
    scale = sx[on]
    a = a / np.outer(scale, scale) + \
        np.eye(len(scale)) * ((1 - mix) * reg / sy)
    coef[on] = _penalised(a, c / (scale * sy), mix * reg / sy) * sy / scale
    return coef, float(my - coef @ mx) if intercept else 0.0


def rmse(m: Moments, coef: np.ndarray, intercept: float) -> float:
    """Root mean squared error of a linear model on the rows of ``m``."""
    sse = m.yy - 2 * (coef @ m.xy + intercept * m.y) + \
        coef @ m.xx @ coef + 2 * intercept * (coef @ m.x) + \
        m.n * intercept * intercept
    return float(np.sqrt(max(sse, 0.0) / m.n))


def slot_correlations(df: DataFrame, vec: str,
                      target: int | Column) -> DataFrame:
    """(slot, corr): Pearson correlation of every slot that is non-zero
    somewhere with ``target``, a slot or a numeric column; null where it is
    undefined.  Rows with a null target are left out.

    One aggregate of at most one row a slot, whatever the width.  Means and
    co-moments of a slot's non-zero rows are combined with those of its other
    rows (where it is 0), so nothing is centred row by row and no sum of large
    squares is subtracted from another.
    """
    if isinstance(target, int):
        t = F.coalesce(F.get(F.filter("e", lambda x: x["slot"] == target),
                             F.lit(0))["val"], F.lit(0.0))
        rows = df.select(F.concat(_entry(ONE, F.lit(1.0)), stored(vec))
                         .alias("e")).select("e", t.alias("t"))
    else:
        rows = df.select(F.concat(_entry(ONE, F.lit(1.0)), stored(vec))
                         .alias("e"), target.cast("double").alias("t")) \
            .filter("t is not null")
    found = rows.select(F.inline("e"), "t").groupBy("slot").agg(
        F.count(F.lit(1)).alias("n1"), F.avg("val").alias("x1"),
        F.avg("t").alias("t1"), F.var_pop("val").alias("v1"),
        F.covar_pop("val", "t").alias("c1"), F.var_pop("t").alias("vt"))
    whole = found.filter(F.col("slot") == ONE).select(
        F.col("n1").alias("n"), F.col("t1").alias("mt"),
        F.col("vt").alias("vt_all"))
    n0 = F.col("n") - F.col("n1")
    t0 = F.try_divide(F.col("n") * F.col("mt") - F.col("n1") * F.col("t1"),
                      n0)
    share = F.col("n1") / F.col("n")
    cov = F.col("c1") * share + F.col("x1") * (
        F.col("t1") - F.coalesce(t0, F.col("t1"))) * share * n0 / F.col("n")
    var = F.col("v1") * share + F.col("x1") * F.col("x1") * share * n0 \
        / F.col("n")
    # ``whole`` is one row
    return found.filter(F.col("slot") != ONE).drop("vt") \
        .crossJoin(F.broadcast(whole)).select(
            "slot", F.try_divide(cov, F.sqrt(var) * F.sqrt("vt_all"))
            .alias("corr"))
