r"""Chinese-restaurant seating of a three-level Pitman-Yor hierarchy, sampled by table counts.

Every token is a customer of its *context* (the word before). Contexts of a *class* share
it as parent, and all classes share the *root*, whose base is uniform over the known words
and one unknown. A restaurant's tables of a word are customers of that word in its parent.

The state holds, for each word, its numbers of tables in each context, class and the root;
the sizes of tables are summed out. Given all else, ``n`` customers of a word have ``t``
tables with probability proportional to

    S_d(n, t) * prod_{i<t} (strength + d * (T + i)) * prod_{i<t} r_i

with S_d the generalised Stirling numbers, T the restaurant's other tables and r_i the
parent's probability of the word for one customer more. That is the Gibbs conditional:
the word's own tables leave all totals before they are drawn anew. Up to EXACT customers
it is drawn by its whole table, above by Metropolis steps from where it stands, which
leave the same law in place. S_d comes from its recursion up to TABLE customers. Above,
n! / (t! d^t) times the n-th coefficient of (1 - (1 - x)^d)^t is taken by an integral along
the branch cut from 1 where t is at most NEAR n^d and n / 2, else at the saddle point.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np

CLASSES = 64
#: Customers up to which a conditional is drawn whole, and up to which Stirling numbers are tabulated.
EXACT, TABLE = 16, 256
#: Tables by n^d up to which the integral is taken.
NEAR = 4.5
#: Metropolis steps a sweep for words with more customers.
STEPS = 4
#: Customers (or tables) counted one by one in what discounts are drawn from; more are binned, eight bins an octave.
COUNTED = 32


def lgamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function of positive numbers."""
    x = np.asarray(x, float)
    low = x < 8
    y = np.where(low, x + 8, x)
    z = 1 / (y * y)
    out = (y - 0.5) * np.log(y) - y + 0.9189385332046727 + (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z / 1680))) / y
    if low.any():
        v = x[low]
        p = v.copy()
        for k in range(1, 8):
            p *= v + k
        out[low] -= np.log(p)
    return out


@lru_cache(64)
def stirling_table(d: float) -> np.ndarray:
    """log S_d(n, t) for n and t up to TABLE."""
    out = np.full((TABLE + 1, TABLE + 1), -np.inf)
    out[0, 0] = 0
    with np.errstate(divide="ignore"):
        for n in range(TABLE):
            t = np.arange(1, n + 2)
            out[n + 1, 1 : n + 2] = np.logaddexp(out[n, : n + 1], np.log(np.maximum(n - t * d, 0)) + out[n, 1 : n + 2])
    return out


def _at_saddle(n: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """log of the n-th coefficient of f(x)^t, f(x) = (1 - (1 - x)^d) / d, where t x f'(x) / f(x) = n; 1 < t < n."""
    ratio = n / t
    lo = np.full(len(n), -18.0)  # logarithm of y = -log(1 - x)
    hi = np.log((np.log(ratio / d + 1) + 3) / (1 - d))
    for _ in range(40):
        mid = (lo + hi) / 2
        y = np.exp(mid)
        above = d * -np.expm1(-y) * np.exp((1 - d) * y) / -np.expm1(-d * y) > ratio
        hi, lo = np.where(above, mid, hi), np.where(above, lo, mid)
    y = np.exp((lo + hi) / 2)
    f, x, q = -np.expm1(-d * y) / d, -np.expm1(-y), np.exp(-y)
    spread = n + t * x * x * (1 - d) * q ** (d - 2) / f - n * n / t
    return t * np.log(f) - n * np.log(x) - 0.5 * np.log(2 * np.pi * spread)


_NODES = np.arange(-32.0, 5.0, 0.2)


def _along_cut(n: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """The same by the integral of Im (1 - s^d exp(-i pi d))^t (1 + s)^(-n-1) / pi over s > 0, at s = exp(node) / n."""
    out = np.empty(len(n))
    for at in range(0, len(n), 4096):
        a, b = n[at : at + 4096, None], t[at : at + 4096, None]
        s = np.exp(_NODES) / a
        power = b * np.log(1 - s**d * np.exp(-1j * np.pi * d))
        # the step of the nodes times s is ds
        whole = (np.exp(power.real - (a + 1) * np.log1p(s)) * np.sin(power.imag) * s).sum(1) * 0.2 / np.pi
        out[at : at + 4096] = np.log(np.maximum(whole, 1e-300)) - t[at : at + 4096] * np.log(d)
    return out


def log_stirling(n: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """log S_d(n, t) of any 1 <= t <= n."""
    n, t = np.asarray(n, np.int64), np.asarray(t, np.int64)
    small = n <= TABLE
    out = stirling_table(d)[np.minimum(n, TABLE), np.minimum(t, TABLE)]
    if small.all():
        return out
    one = ~small & (t == 1)
    out[one] = lgamma(n[one] - d) - lgamma(np.array([1 - d]))[0]
    out[~small & (t == n)] = 0
    two = ~small & (t == n - 1)
    out[two] = np.log(n[two] * (n[two] - 1.0) / 2 * (1 - d))
    near = t <= np.minimum(NEAR * n.astype(float) ** d, 0.5 * n)
    for ways, part in ((_along_cut, near), (_at_saddle, ~near)):
        big = np.flatnonzero(~small & (t > 1) & (t < n - 1) & part)
        if len(big):
            a, b = n[big].astype(float), t[big].astype(float)
            out[big] = lgamma(a + 1) - lgamma(b + 1) + ways(a, b, d)
    return out


def rho(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """S_d(c, t - 1) / S_d(c, t): what one customer more adds by opening a table, at a fixed number of tables; 0 up to TABLE customers, where none asks."""
    out = np.zeros(len(c))
    big = np.flatnonzero((c > TABLE) & (t > 1) & (t <= c))
    if len(big):
        out[big] = np.exp(log_stirling(c[big], t[big] - 1, d) - log_stirling(c[big], t[big], d))
    return out


@dataclass
class Parent:
    """Where tables are customers: others of the word there, the word's tables, :func:`rho` of all its customers, other customers in all, discount; or only log_base."""

    c: np.ndarray | None = None
    t: np.ndarray | None = None
    rho: np.ndarray | None = None
    total: np.ndarray | None = None
    d: float = 0.0
    log_base: float = 0.0

    def at(self, sel: np.ndarray) -> Parent:
        return self if self.c is None else replace(self, c=self.c[sel], t=self.t[sel], rho=self.rho[sel], total=self.total[sel])


def draw(rng: np.random.Generator, n: np.ndarray, t: np.ndarray, others: np.ndarray, parent: Parent, d: float, strength: float) -> np.ndarray:
    """New numbers of tables for words with n >= 2 customers that stand at t; others: the restaurants' other tables."""
    out = t.copy()
    low = 2
    for high in (2, 4, 8, EXACT):
        sel = np.flatnonzero((n >= low) & (n <= high))
        low = high + 1
        if len(sel):
            out[sel] = _drawn(rng, n[sel], others[sel], parent.at(sel), d, strength, high)
    sel = np.flatnonzero(n > EXACT)
    if len(sel):
        out[sel] = _stepped(rng, n[sel], t[sel], others[sel], parent.at(sel), d, strength)
    return out


def _drawn(rng, n, others, parent, d, strength, high) -> np.ndarray:
    i = np.arange(1, high)
    weight = stirling_table(d)[n, 1 : high + 1].copy()
    more = np.log(strength + d * (others[:, None] + i))
    if parent.c is None:
        weight[:, 1:] += np.cumsum(more + parent.log_base, axis=1)
    else:
        more -= np.log(strength + parent.total[:, None] + i)
        held = parent.c + n <= TABLE - high
        far = ~held
        if far.any():
            more[far] += np.log(np.maximum(parent.c[far, None] + i - parent.d * parent.t[far, None] + parent.rho[far, None], 1e-9))
        weight[:, 1:] += np.cumsum(more, axis=1)
        if held.any():
            weight[held] += stirling_table(parent.d)[parent.c[held, None] + np.arange(1, high + 1), parent.t[held, None]]
    weight = np.exp(weight - weight.max(1, keepdims=True))
    sums = np.cumsum(weight, axis=1)
    return 1 + (sums < (rng.random(len(n)) * sums[:, -1])[:, None]).sum(1)


def _stepped(rng, n, t, others, parent, d, strength) -> np.ndarray:
    t = t.copy()
    scale = np.maximum(1.0, n**0.3)
    here = log_stirling(n, t, d)
    if parent.c is not None:
        shift = parent.rho - parent.d * parent.t
        near = parent.c + n <= TABLE
        held = stirling_table(parent.d)
    for _ in range(STEPS):
        size = 1 + np.floor(rng.exponential(scale)).astype(np.int64)
        to = t + np.where(rng.random(len(t)) < 0.5, size, -size)
        u = rng.random(len(t))
        ok = (to >= 1) & (to <= n)
        if parent.c is not None:
            ok &= parent.c + to >= parent.t
        sel = np.flatnonzero(ok)
        if not len(sel):
            continue
        a, b = t[sel], to[sel]
        there = log_stirling(n[sel], b, d)
        gain = there - here[sel] + (b - a) * np.log(d) + lgamma(strength / d + others[sel] + b) - lgamma(strength / d + others[sel] + a)
        if parent.c is None:
            gain += (b - a) * parent.log_base
        else:
            c, total = parent.c[sel], strength + parent.total[sel]
            gain -= lgamma(total + b) - lgamma(total + a)
            far = ~near[sel]
            gain[far] += lgamma(np.maximum((c + b + shift[sel])[far], 1e-3)) - lgamma(np.maximum((c + a + shift[sel])[far], 1e-3))
            k = near[sel]
            gain[k] += held[(c + b)[k], parent.t[sel][k]] - held[(c + a)[k], parent.t[sel][k]]
        go = np.log(np.maximum(u[sel], 1e-300)) < gain
        t[sel[go]], here[sel[go]] = b[go], there[go]
    return t


@dataclass(frozen=True)
class Totals:
    """What all words share: customers and tables of classes and root, discounts by level (root, class, context), known words, and the words that are split over buckets with their upper levels."""

    customers: np.ndarray
    tables: np.ndarray
    root_customers: int
    root_tables: int
    discounts: tuple[float, float, float]
    strength: float
    words: int
    hot: np.ndarray  # keys, sorted
    hot_customers: np.ndarray  # by word and class
    hot_tables: np.ndarray
    hot_root: np.ndarray  # tables at the root

    @property
    def log_base(self) -> float:
        return -float(np.log(self.words + 1))


@dataclass
class Core:
    """The trained words of a bucket: entries (word, class) by word, with pairs seen once; and pairs seen more often with entry, context and customers."""

    keys: np.ndarray
    entry_word: np.ndarray
    entry_class: np.ndarray
    once: np.ndarray
    pair_entry: np.ndarray
    pair_context: np.ndarray
    pair_n: np.ndarray


def _ranks(sorted_groups: np.ndarray) -> np.ndarray:
    """The place of each element in its run of equal values."""
    begin = np.flatnonzero(np.diff(sorted_groups, prepend=-1))
    return np.arange(len(sorted_groups)) - np.repeat(begin, np.diff(np.append(begin, len(sorted_groups))))


def _turns(sorted_groups: np.ndarray, apart: int) -> np.ndarray:
    """When each element of a run is drawn: the first ``apart`` one after the other, later ones in turns that double."""
    rank = _ranks(sorted_groups)
    return np.where(rank < apart, rank, apart + np.floor(np.log2(np.maximum(rank, 1) / apart)).astype(np.int64))


class Seats:
    """The seating of a bucket's words. Totals of other buckets stand as they were when last shared, own changes count at once."""

    def __init__(self, core: Core, totals: Totals, contexts: np.ndarray, tables: np.ndarray, apart: int = 4):
        """contexts (sorted, all that pairs have) and their tables; every pair starts with one table."""
        self.core, self.pt = core, np.ones(len(core.pair_n), np.int64)
        self.ctx = np.searchsorted(contexts, core.pair_context)
        n = len(core.entry_word)
        self.own = core.once + np.bincount(core.pair_entry, minlength=n)  # customers from this bucket
        self.te, self.t0 = np.ones(n, np.int64), np.zeros(len(core.keys), np.int64)
        self.t0[core.entry_word] = 1
        self.pair_turn, self.entry_turn = _turns(core.pair_entry, apart), _turns(core.entry_word, apart)
        self.share(totals, tables)

    def share(self, totals: Totals, tables: np.ndarray) -> None:
        """Take over totals and contexts' tables, in which the present seating is counted."""
        self.totals, core = totals, self.core
        self.C, self.T = totals.customers.astype(np.int64).copy(), totals.tables.astype(np.int64).copy()
        self.C0, self.T0 = int(totals.root_customers), int(totals.root_tables)
        self.Tu = tables.astype(np.int64).copy()
        self.ce = self.own.copy()
        self.hot = np.zeros(len(core.keys), bool)
        if len(totals.hot):
            at = np.minimum(np.searchsorted(totals.hot, core.keys), len(totals.hot) - 1)
            self.hot = totals.hot[at] == core.keys
            h = self.hot[core.entry_word]
            at = at[core.entry_word[h]]
            self.ce[h], self.te[h] = totals.hot_customers[at, core.entry_class[h]], totals.hot_tables[at, core.entry_class[h]]
        self.c0 = np.bincount(core.entry_word, self.te, len(core.keys)).astype(np.int64)
        if self.hot.any():
            at = np.searchsorted(totals.hot, core.keys[self.hot])
            self.c0[self.hot], self.t0[self.hot] = totals.hot_tables[at].sum(1), totals.hot_root[at]

    def sweep(self, rng: np.random.Generator) -> None:
        d0, d1, d2 = self.totals.discounts
        s, core = self.totals.strength, self.core
        more = rho(self.ce, self.te, d1)
        for turn in range(int(self.pair_turn.max(initial=-1)) + 1):
            sel = np.flatnonzero(self.pair_turn == turn)
            e, t = core.pair_entry[sel], self.pt[sel]
            k = core.entry_class[e]
            new = draw(rng, core.pair_n[sel], t, self.Tu[self.ctx[sel]] - t, Parent(self.ce[e] - t, self.te[e], more[e], self.C[k] - t, d1), d2, s)
            self.pt[sel] = new
            diff = new - t
            on = np.flatnonzero(diff)
            np.add.at(self.Tu, self.ctx[sel[on]], diff[on])
            np.add.at(self.ce, e[on], diff[on])
            np.add.at(self.own, e[on], diff[on])
            np.add.at(self.C, k[on], diff[on])
        cold = ~self.hot[core.entry_word] & (self.ce > 1)
        more = rho(self.c0, self.t0, d0)
        for turn in range(int(self.entry_turn.max(initial=-1)) + 1):
            sel = np.flatnonzero(cold & (self.entry_turn == turn))
            if not len(sel):
                continue
            w, k, t = core.entry_word[sel], core.entry_class[sel], self.te[sel]
            new = draw(rng, self.ce[sel], t, self.T[k] - t, Parent(self.c0[w] - t, self.t0[w], more[w], self.C0 - t, d0), d1, s)
            self.te[sel] = new
            diff = new - t
            np.add.at(self.c0, w, diff)
            np.add.at(self.T, k, diff)
            self.C0 += int(diff.sum())
        sel = np.flatnonzero(~self.hot & (self.c0 > 1))
        if len(sel):
            t = self.t0[sel]
            new = draw(rng, self.c0[sel], t, self.T0 - t, Parent(log_base=self.totals.log_base), d0, s)
            self.t0[sel] = new
            self.T0 += int((new - t).sum())

    def root(self, words: np.ndarray) -> np.ndarray:
        """Root probabilities of words by place, -1: one that is not known."""
        d0, s = self.totals.discounts[0], self.totals.strength
        own = np.where(words >= 0, self.c0[words] - d0 * self.t0[words], 0.0) if len(self.c0) else np.zeros(len(words))
        return (own + (s + d0 * self.T0) * np.exp(self.totals.log_base)) / (s + self.C0)

    def given_class(self, words: np.ndarray, classes: np.ndarray, entries: np.ndarray) -> np.ndarray:
        """Probabilities of words (by place, -1: unknown) given classes; entries: their places, -1 where there is none."""
        d1, s = self.totals.discounts[1], self.totals.strength
        own = np.where(entries >= 0, self.ce[entries] - d1 * self.te[entries], 0.0) if len(self.ce) else np.zeros(len(words))
        return (own + (s + d1 * self.T[classes]) * self.root(words)) / (s + self.C[classes])


def binned(n: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """How often n customers have t tables: (bin, count, sum of n, sum of t), one by one up to COUNTED customers."""
    wide = lambda x: np.where(x <= COUNTED, x, 1000 + np.floor(np.log2(np.maximum(x, 1)) * 8).astype(np.int64))
    keys, at = np.unique(wide(n) * 10_000 + wide(t), return_inverse=True)
    return keys, np.bincount(at, minlength=len(keys)), np.bincount(at, n, len(keys)), np.bincount(at, t, len(keys))


def draw_discount(rng: np.random.Generator, seated: list[tuple[float, float, float]], restaurants: list[tuple[float, float]], strength: float) -> float:
    """A discount from its conditional on a grid of hundredths. seated: (count, mean n, mean t) of words; restaurants: (count, mean tables)."""
    grid = np.arange(2, 98) / 100
    score = np.zeros(len(grid))
    if seated:
        many, n, t = (np.array(x, float) for x in zip(*seated, strict=True))
        n, t = np.round(n).astype(np.int64), np.round(t).astype(np.int64)
        score += [float((many * log_stirling(n, np.minimum(t, n), d)).sum()) for d in grid.tolist()]
    if restaurants:
        many, t = (np.array(x, float) for x in zip(*restaurants, strict=True))
        score += [float((many * ((t - 1) * np.log(d) + lgamma(strength / d + t) - lgamma(np.full(len(t), strength / d + 1)))).sum()) for d in grid.tolist()]
    p = np.exp(score - score.max())
    return float(rng.choice(grid, p=p / p.sum()))
