"""Statistics of the last n rows at a cost that grows with the logarithm of n.

A frame of n rows costs n updates a row. Here the statistic of n rows is put together from those of
fewer rows, looked up some rows back: 60 rows are three times 20, which are four times 5. Nothing is
ever subtracted, as differences of running sums would, so no digits are lost where values jump by orders of
magnitude, and equal values have a deviation of exactly 0. Sizes of one chain divide one another, but for
extremes, whose parts may overlap. All chains are raised together, so each level is one
window over the order that the first one made.

Nulls are left out of every statistic. Rows before the first count as absent: a statistic covers what rows there are.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from ..functions.columns import ratio

Part = dict[str, Column]


def _sum(values: list[Column]) -> Column:
    """The sum of what is not null; 0 without any."""
    total = F.coalesce(values[0], F.lit(0))
    for v in values[1:]:
        total = total + F.coalesce(v, F.lit(0))
    return total


@dataclass(frozen=True)
class Kind:
    """A mergeable statistic: its fields of one value, and of several parts (steps, each of which may read the ones before)."""

    fields: tuple[str, ...]
    one: Callable[[Column], Part]
    merge: tuple[Callable[[list[Part], Part], Part], ...]
    overlaps: bool = False


def _known(c: Column) -> Column:
    return F.when(c.isNotNull(), F.lit(1.0)).otherwise(0.0)


def _mean(parts: list[Part], _: Part) -> Part:
    n, near = _sum([p["n"] for p in parts]), F.coalesce(*[p["mean"] for p in parts])
    return {"n": n, "mean": near + ratio(_sum([p["n"] * (p["mean"] - near) for p in parts]), n)}


def _central(parts: list[Part], whole: Part) -> Part:
    off = [p["mean"] - whole["mean"] for p in parts]
    return {
        "m2": _sum([p["m2"] + p["n"] * o * o for p, o in zip(parts, off, strict=True)]),
        "m3": _sum([p["m3"] + 3 * o * p["m2"] + p["n"] * o * o * o for p, o in zip(parts, off, strict=True)]),
    }


#: Least and greatest value.
EXTREMES = Kind(("lo", "hi"), lambda c: {"lo": c, "hi": c}, (lambda ps, _: {"lo": F.least(*[p["lo"] for p in ps]), "hi": F.greatest(*[p["hi"] for p in ps])},), True)
#: Number and sum.
TOTAL = Kind(("n", "sum"), lambda c: {"n": _known(c), "sum": c}, (lambda ps, _: {f: _sum([p[f] for p in ps]) for f in ("n", "sum")},))
#: Number, mean, and sums of the second and third powers of what is off the mean.
MOMENTS = Kind(("n", "mean", "m2", "m3"), lambda c: {"n": _known(c), "mean": c, "m2": F.lit(0.0), "m3": F.lit(0.0)}, (_mean, _central))


@dataclass(frozen=True)
class Chain:
    """A statistic of a column over the last ``sizes`` rows, each made from the one before, the first from single rows."""

    kind: Kind
    column: str
    sizes: tuple[int, ...]

    def __post_init__(self):
        for have, want in zip((1, *self.sizes), self.sizes, strict=False):
            if want <= have or (want % have and not self.kind.overlaps):
                raise ValueError(f"{want} rows are not put together from {have}")

    def back(self, level: int) -> list[int]:
        """How many rows back the parts of a level end."""
        have, want = (1, *self.sizes)[level], self.sizes[level]
        return sorted({min(o, want - have) for o in range(0, want, have)})


def field(chain: str, size: int, name: str) -> Column:
    """A statistic that `slide` added."""
    return F.col(f"_{chain}_{size}_{name}")


def slide(d: DataFrame, w: WindowSpec, chains: dict[str, Chain]) -> DataFrame:
    """``d`` with the columns that `field` names; ``w`` has the order of the rows and no frame."""
    for level in range(max(len(c.sizes) for c in chains.values())):
        now = {k: c for k, c in chains.items() if level < len(c.sizes)}
        source = {k: [c.column] if level == 0 else [f"_{k}_{c.sizes[level - 1]}_{f}" for f in c.kind.fields] for k, c in now.items()}
        looked = {f"_{s}_{o}_back": F.lag(s, o).over(w) for k, c in now.items() for s in source[k] for o in c.back(level) if o}
        d = d.withColumns(looked)
        parts, whole = {}, {k: {} for k in now}
        for k, c in now.items():
            at = [[F.col(f"_{s}_{o}_back" if o else s) for s in source[k]] for o in c.back(level)]
            parts[k] = [c.kind.one(a[0]) if level == 0 else dict(zip(c.kind.fields, a, strict=True)) for a in at]
        for step in range(max(len(c.kind.merge) for c in now.values())):
            made = {}
            for k, c in now.items():
                if step < len(c.kind.merge):
                    for f, e in c.kind.merge[step](parts[k], whole[k]).items():
                        made[f"_{k}_{c.sizes[level]}_{f}"] = e
                        whole[k][f] = field(k, c.sizes[level], f)
            d = d.withColumns(made)
        d = d.drop(*looked)
    return d


def mean(chain: str, size: int) -> Column:
    """Of a chain of `TOTAL`; null without values."""
    return ratio(field(chain, size, "sum"), field(chain, size, "n"))


def deviation(chain: str, size: int) -> Column:
    """The sample deviation, of a chain of `MOMENTS`; null under 2 values."""
    n = field(chain, size, "n")
    return F.when(n > 1, F.sqrt(ratio(field(chain, size, "m2"), n - 1)))


def skewness(chain: str, size: int) -> Column:
    """Bias-corrected skewness, of a chain of `MOMENTS`; null under 3 values or without deviation."""
    n, m2, m3 = (field(chain, size, f) for f in ("n", "m2", "m3"))
    return F.when(n > 2, ratio(F.sqrt(n) * m3, m2 * F.sqrt(m2)) * F.sqrt(n * (n - 1)) / (n - 2))
