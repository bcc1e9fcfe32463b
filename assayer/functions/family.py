"""Response families and links as Column builders, with NumPy twins for Arrow kernels.

A builder takes Columns and returns a Column, so a whole metric stays one code-generated
aggregate. Operators are shared: the same formula runs on Columns and on arrays through
the small ``Math`` namespace it is given.
"""

from __future__ import annotations

from dataclasses import dataclass
from types import SimpleNamespace

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

COLUMNS = SimpleNamespace(
    log=F.log, exp=F.exp, pow=lambda x, p: F.pow(x, F.lit(float(p))), choose=lambda c, a, b: F.when(c, a).otherwise(b),
    top=lambda x, low: F.greatest(x, F.lit(float(low))), one=lambda v: F.lit(float(v)),
)


def _choose(c, a, b):
    return np.where(c, a, b)


def _log(x):
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.log(x)


ARRAYS = SimpleNamespace(log=_log, exp=np.exp, pow=lambda x, p: np.power(x, p), choose=_choose, top=np.maximum, one=float)

#: Fixed names: other spellings of the families.
ALIASES = {"normal": "gaussian", "bernoulli": "binomial"}
CANONICAL = {"gaussian": "identity", "poisson": "log", "gamma": "log", "tweedie": "log", "binomial": "logit"}
POWERS = {"gaussian": 0.0, "poisson": 1.0, "gamma": 2.0}


@dataclass(frozen=True)
class Link:
    name: str

    def __post_init__(self) -> None:
        if self.name not in ("identity", "log", "logit"):
            raise ValueError(f"link {self.name!r} is unknown; use identity, log or logit")

    def of(self, mu, m=COLUMNS):
        if self.name == "identity":
            return mu
        return m.log(mu) if self.name == "log" else m.log(mu) - m.log(1 - mu)

    def inverse(self, eta, m=COLUMNS):
        if self.name == "identity":
            return eta
        return m.exp(eta) if self.name == "log" else 1 / (1 + m.exp(-eta))

    def slope(self, eta, m=COLUMNS):
        """d mu / d eta."""
        if self.name == "identity":
            return eta * 0 + 1
        mu = self.inverse(eta, m)
        return mu if self.name == "log" else mu * (1 - mu)


@dataclass(frozen=True)
class Family:
    """Gaussian, Poisson, gamma, Tweedie of a power, or binomial."""

    name: str
    power: float | None = None

    @classmethod
    def of(cls, name: str | Family, power: float | None = None) -> Family:
        if isinstance(name, Family):
            return name
        name = ALIASES.get(name, name)
        if name not in CANONICAL:
            raise ValueError(f"family {name!r} is unknown; use one of {', '.join(sorted(CANONICAL))}")
        if name == "tweedie":
            if power is None or not np.isfinite(power):
                raise ValueError("the tweedie family needs a finite power")
            if 0 < power < 1:
                raise ValueError(f"no tweedie distribution has power {power}; powers in (0, 1) do not exist")
        elif power is not None:
            raise ValueError(f"the {name} family takes no power")
        return cls(name, None if power is None else float(power))

    @property
    def kind(self) -> str:
        """The family with Tweedie powers 0, 1 and 2 under their own names."""
        return {0.0: "gaussian", 1.0: "poisson", 2.0: "gamma"}.get(self.power, self.name) if self.name == "tweedie" else self.name

    @property
    def link(self) -> Link:
        return Link(CANONICAL[self.name])

    @property
    def fixed_dispersion(self) -> bool:
        return self.name in ("poisson", "binomial")

    def variance(self, mu, m=COLUMNS):
        kind = self.kind
        if kind == "gaussian":
            return mu * 0 + 1
        if kind == "poisson":
            return mu
        if kind == "binomial":
            return mu * (1 - mu)
        return mu * mu if kind == "gamma" else m.pow(mu, self.power)

    def accepts_y(self, y, m=COLUMNS):
        kind = self.kind
        if kind == "gaussian" or kind == "tweedie" and self.power < 0:
            return y == y
        if kind == "binomial":
            return (y >= 0) & (y <= 1)
        return y > 0 if kind == "gamma" or kind == "tweedie" and self.power > 2 else y >= 0

    def accepts_mu(self, mu, m=COLUMNS):
        kind = self.kind
        if kind == "gaussian":
            return mu == mu
        return (mu > 0) & (mu < 1) if kind == "binomial" else mu > 0

    @property
    def y_rule(self) -> str:
        kind = self.kind
        if kind == "gaussian" or kind == "tweedie" and self.power < 0:
            return "any number"
        if kind == "binomial":
            return "between 0 and 1"
        return "above 0" if kind == "gamma" or kind == "tweedie" and self.power > 2 else "0 or above"

    @property
    def mu_rule(self) -> str:
        return {"gaussian": "any number", "binomial": "strictly between 0 and 1"}.get(self.kind, "above 0")

    def unit_deviance(self, y, mu, m=COLUMNS):
        """Deviance of one row of weight 1, never below 0."""
        kind = self.kind
        if kind == "gaussian":
            return (y - mu) * (y - mu)
        if kind == "poisson":
            return m.top(2 * (m.choose(y > 0, y * (m.log(y) - m.log(mu)), m.one(0)) - (y - mu)), 0)
        if kind == "gamma":
            return m.top(2 * ((y - mu) / mu - (m.log(y) - m.log(mu))), 0)
        if kind == "binomial":
            hit = m.choose(y > 0, y * (m.log(y) - m.log(mu)), m.one(0))
            miss = m.choose(y < 1, (1 - y) * (m.log(1 - y) - m.log(1 - mu)), m.one(0))
            return m.top(2 * (hit + miss), 0)
        p = self.power
        base = m.top(y, 0) if p < 0 else y
        first = m.pow(base, 2 - p) / ((1 - p) * (2 - p))
        return m.top(2 * (first - y * m.pow(mu, 1 - p) / (1 - p) + m.pow(mu, 2 - p) / (2 - p)), 0)

    def start(self, y, w, m=COLUMNS):
        """Means from which a fit sets out."""
        kind = self.kind
        if kind == "poisson":
            return y + 0.1
        if kind == "binomial":
            return (w * y + 0.5) / (w + 1)
        return m.choose(y > 0, y, m.one(0.1)) if kind == "tweedie" else y


def column(name: str | Column | None, default: float = 1.0) -> Column:
    """A double Column of a name, a Column, or a constant."""
    if name is None:
        return F.lit(float(default))
    return (F.col(name) if isinstance(name, str) else name).cast("double")
