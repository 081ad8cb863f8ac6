"""Pitman-Yor restaurants, seated by Gibbs sampling.

A dish with c customers sits at t tables. Given the chances p of its parent, a restaurant's state of T tables in all has
the weight (theta | d)_T times, for each dish, S(c, t) p^t, with S the generalised Stirling numbers of discount d, which
count the ways to seat c customers at t tables by their sizes. (theta | d)_T is d^T Gamma(theta / d + T) / Gamma(theta / d),
and that Gamma is an integral over x of x^(theta / d + T - 1) e^-x. So x, drawn from Gamma(theta / d + T), makes the dishes
independent: each draws its tables from S(c, t) (d x p)^t, which is Gibbs sampling with all of a dish's customers taken up
at once. Discount and strength are drawn from their conditionals on grids.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Grids that discounts and strengths are drawn from.
DISCOUNTS = np.arange(1, 20) / 20
STRENGTHS = np.array([0.1, 0.3, 1.0, 3.0, 10.0, 30.0, 100.0])
#: Dishes with up to so many customers draw from their exact conditional; larger ones move by Metropolis-Hastings steps.
TABLED, STEPS = 256, 6
#: Terms of the series for large dishes.
TERMS = 80


def log_gamma(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, np.float64)
    y = x + 8
    rise = np.log(x)
    for k in range(1, 8):
        rise = rise + np.log(x + k)
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - rise


@lru_cache(maxsize=1)
def stirling() -> np.ndarray:
    """Logs of S(c, t) by discount, c and t up to TABLED: S(c + 1, t) = S(c, t - 1) + (c - t d) S(c, t)."""
    out = np.full((len(DISCOUNTS), TABLED + 1, TABLED + 1), -np.inf)
    out[:, 1, 1] = 0.0
    t = np.arange(1, TABLED + 1)
    for c in range(1, TABLED):
        with np.errstate(divide="ignore", invalid="ignore"):
            stay = out[:, c, 1:] + np.log(np.maximum(c - t[None, :] * DISCOUNTS[:, None], 0))
        out[:, c + 1, 1:] = np.logaddexp(out[:, c, :-1], stay)
    return out


def log_stirling(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """Logs of S(c, t) for large c: t! d^t S(c, t) / c! is the coefficient of z^c in (1 - (1 - z)^d)^t.

    Expanded, it is a sum of coefficients of (1 - z)^(jd), used where its terms fall off; else by the saddle point.
    """
    c, t = np.asarray(c, np.float64), np.asarray(t, np.float64)
    out = np.empty(len(c))
    series = t * np.exp(log_gamma(c - np.minimum(d, c / 2)) - log_gamma(c)) <= 10 ** (1 - d)
    if series.any():
        cc, tt = c[series, None], t[series, None]
        j = np.arange(1, TERMS + 1)[None, :]
        ok = (j <= tt) & (j * d < cc)
        jj = np.where(ok, j, 1)
        logs = log_gamma(tt + 1) - log_gamma(jj + 1) - log_gamma(tt - jj + 1) + log_gamma(cc - jj * d) + log_gamma(1 + jj * d)
        top = logs[:, :1]
        total = (np.where(ok, np.exp(logs - top), 0) * np.where(j % 2 == 1, 1, -1) * np.sin(np.pi * ((j * d) % 2))).sum(1) / np.pi
        out[series] = np.log(np.maximum(total, 1e-300)) + top[:, 0] - log_gamma(t[series] + 1) - t[series] * np.log(d)
    if not series.all():
        cc, tt = c[~series], t[~series]
        low, high = np.full(len(cc), -700.0), np.zeros(len(cc))  # log of 1 - z, the slope falls with it
        for _ in range(60):
            mid = (low + high) / 2
            e = np.exp(mid)
            slope = -np.expm1(mid) * d * np.exp((d - 1) * mid) / np.maximum(-np.expm1(d * mid), 1e-300)
            low, high = np.where(slope > cc / tt, mid, low), np.where(slope > cc / tt, high, mid)
        mid = (low + high) / 2
        e = np.exp(mid)
        z, f = -np.expm1(mid), -np.expm1(d * mid)
        r = z * d * e ** (d - 1) / f
        spread = tt * (r + z * z * d * (1 - d) * e ** (d - 2) / f - r * r)
        out[~series] = tt * np.log(f) - cc * np.log1p(-e) - 0.5 * np.log(2 * np.pi * np.maximum(spread, 1e-12)) + log_gamma(cc + 1) - log_gamma(tt + 1) - tt * np.log(d)
    return np.where(t >= c, np.where(t == c, 0.0, -np.inf), out)


class Restaurants:
    """Dish i stands in restaurant at[i] and has c[i] customers, at least 1, at t[i] tables.

    share: how many times the dishes that are here a restaurant has in all, where others hold its other dishes; its
    tables are taken to be as many times those here. customers: of each restaurant in all.
    """

    def __init__(self, rng: np.random.Generator, at: np.ndarray, c: np.ndarray, restaurants: int, share: np.ndarray | None = None, customers: np.ndarray | None = None):
        self.rng, self.at, self.c, self.n = rng, at, np.asarray(c, np.int64), restaurants
        self.share = np.ones(restaurants) if share is None else share
        self.here = np.bincount(at, self.c, restaurants)
        self.customers = self.here if customers is None else customers
        self.t = np.ones(len(self.c), np.int64)
        one, two = int((self.c == 1).sum()), int((self.c == 2).sum())
        self.k = int(np.abs(DISCOUNTS - (one / (one + 2 * two) if one else 0.5)).argmin())
        self.theta = 1.0
        self.begun = False

    @property
    def d(self) -> float:
        return float(DISCOUNTS[self.k])

    def refill(self, c: np.ndarray) -> None:
        """Other numbers of customers; tables stay, as far as there are customers for them."""
        self.c = np.asarray(c, np.int64)
        self.here = self.customers = np.bincount(self.at, self.c, self.n)
        self.t = np.minimum(self.t, self.c)

    def tables(self) -> np.ndarray:
        """Of each restaurant, those here."""
        return np.bincount(self.at, self.t, self.n)

    def sweep(self, p: np.ndarray) -> None:
        """Seats every dish anew, given the parent's chances, then draws discount and strength."""
        many = np.flatnonzero(self.c > 1)
        if len(many):
            x = self.rng.gamma(self.theta / self.d + self.tables() * self.share)
            a = np.maximum(self.d * x[self.at[many]] * p[many], 1e-300)
            large = many[self.c[many] > TABLED]
            if not self.begun and len(large):
                mean = np.maximum((self.theta + self.d * self.tables()[self.at[large]] * self.share[self.at[large]]) * p[large], 1e-300)
                self.t[large] = np.clip(np.rint(mean / self.d * np.expm1(self.d * np.log1p(self.c[large] / mean))), 1, self.c[large]).astype(np.int64)
            small = self.c[many] <= TABLED
            self.t[many[small]] = self._drawn(self.c[many[small]], np.log(a[small]))
            if len(large):
                self._stepped(large, a[~small])
        self.begun = True
        self._parameters()

    def _drawn(self, c: np.ndarray, log_a: np.ndarray) -> np.ndarray:
        out, table, low = np.ones(len(c), np.int64), stirling()[self.k], 1
        while low < TABLED:
            high = low * 2
            of = np.flatnonzero((c > low) & (c <= high))
            for at in range(0, len(of), (1 << 20) // high):
                i = of[at : at + (1 << 20) // high]
                w = table[c[i], 1 : high + 1] + log_a[i, None] * np.arange(1, high + 1)
                w = np.exp(w - w.max(1, keepdims=True)).cumsum(1)
                out[i] = 1 + (w < (self.rng.random(len(i)) * w[:, -1])[:, None]).sum(1)
            low = high
        return out

    def _stepped(self, dishes: np.ndarray, a: np.ndarray) -> None:
        c, t = self.c[dishes], self.t[dishes]
        wide = np.maximum(1.0, 1.5 * np.sqrt(np.minimum(1 + a / self.d * np.expm1(self.d * np.log1p(c / a)), c)))
        now = log_stirling(c, t, self.d) + t * np.log(a)
        for _ in range(STEPS):
            to = t + np.rint(self.rng.normal(0, wide)).astype(np.int64)
            inside = (to >= 1) & (to <= c)
            to = np.clip(to, 1, c)
            then = log_stirling(c, to, self.d) + to * np.log(a)
            ok = inside & (np.log(self.rng.random(len(c))) < then - now)
            t, now = np.where(ok, to, t), np.where(ok, then, now)
        self.t[dishes] = t

    def _parameters(self) -> None:
        tables, n = np.unique(self.tables(), return_counts=True)
        tables, n = tables[tables > 0].astype(np.float64), n[tables > 0]
        if not len(tables):
            return
        small = self.c <= TABLED
        cell, m = np.unique(self.c[small] * (TABLED + 1) + self.t[small], return_counts=True)
        by_d = (stirling()[:, cell // (TABLED + 1), cell % (TABLED + 1)] * m).sum(1)
        large = np.flatnonzero(~small)
        rising = lambda theta, d: (n * (tables * np.log(d) + log_gamma(theta / d + tables) - log_gamma(np.array(theta / d)))).sum()
        weight = np.array([by_d[k] + rising(self.theta, d) + (log_stirling(self.c[large], self.t[large], d).sum() if len(large) else 0) for k, d in enumerate(DISCOUNTS)])
        self.k = self._pick(weight)
        held, m = np.unique(self.customers[self.customers > 0], return_counts=True)
        weight = np.array([rising(s, self.d) - (m * (log_gamma(s + held) - log_gamma(np.array(s)))).sum() for s in STRENGTHS])
        self.theta = float(STRENGTHS[self._pick(weight)])

    def _pick(self, weight: np.ndarray) -> int:
        w = np.exp(weight - weight.max()).cumsum()
        return int((w < self.rng.random() * w[-1]).sum())

    def shares(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each dish, the chance to join its tables; of each restaurant, what it leaves to its parent (for the dishes
        here: over all who hold some, these add up)."""
        scale = np.maximum(self.theta + self.customers, 1e-300)
        seen = (self.c - self.d * self.t) / scale[self.at]
        part = self.here / np.maximum(self.customers, 1)
        return seen, (self.d * self.tables() + self.theta * part) / scale


def sampled(r: Restaurants, p: np.ndarray, burn_in: int, samples: int) -> tuple[np.ndarray, np.ndarray]:
    """shares() averaged over samples, given the parent's chances."""
    seen, rest = np.zeros(len(r.c)), np.zeros(r.n)
    for turn in range(burn_in + samples):
        r.sweep(p)
        if turn >= burn_in:
            s, b = r.shares()
            seen += s / samples
            rest += b / samples
    return seen, rest
