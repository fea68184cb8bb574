"""A causal self-attention language model over subword ids, in numpy.

One layer of attention reads a window of two blocks: queries come from the second block, keys and
values from both, later places masked, with a learnt bias for each distance. Windows overlap by
one block, so each id is scored once with at least one block of context behind it (or all there
is), many windows at a time. What attention has gathered is added, through an output layer, to
the direct path from the last id to the next one, which starts as the frequencies of pairs.

What is counted (ids, pairs of slots) comes from all training texts. The layer starts from a
bounded sample and then passes over the windows of all training texts, in rounds: in each one every
task goes on from the same parameters with its share, and their averages, weighted by targets, are
the next parameters.

The most frequent ids have slots of their own. Slots are leaves of two levels, so a probability
is one of a cluster and one of a member of it. All other ids share one slot, with a fixed
distribution within, so every id has a probability.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np

IDS = 50_257
CLUSTERS = 32
SLOTS = CLUSTERS * CLUSTERS
HIGHEST = 40.0
#: Up to so many rows numpy adds one after the other.
SHORT = 8
#: Rows that are added up together.
AT_ONCE = 512


@dataclass(frozen=True)
class Shape:
    block: int = 16
    dim: int = 32
    heads: int = 2
    windows: int = 256
    steps: int = 500
    rate: float = 0.02
    rounds: int = 4
    round_rate: float = 0.005
    smoothing: float = 30.0
    seed: int = 5


@dataclass
class Model:
    """``slot_of`` an id, the slots of all ``other`` ids and of the ``end``, log probabilities
    of the other ids ``within`` their slot, and parameters. A slot's cluster and member are its
    number divided by their number, and the remainder."""

    shape: Shape
    slot_of: np.ndarray
    other: int
    end: int
    within: np.ndarray
    p: dict[str, np.ndarray]


def _blocks(slots: np.ndarray, counts: np.ndarray, end: int, block: int):
    """Inputs and targets of all texts in blocks, whether a target is there, and whether a block
    is the first of its text. A text's targets are its slots and the end; an input is the target
    before, the end before the first."""
    whole = counts + 1
    per_text = -(-whole // block)
    text = np.repeat(np.arange(len(counts)), whole)
    start = np.cumsum(per_text * block) - per_text * block
    place = np.arange(len(text)) - np.repeat(np.cumsum(whole) - whole, whole) + start[text]
    targets = np.full(int(per_text.sum()) * block, end, dtype=np.int32)
    there = np.zeros(len(targets), dtype=bool)
    there[place] = True
    inner = np.ones(len(text), dtype=bool)
    inner[np.cumsum(whole) - 1] = False
    targets[place[inner]] = slots
    inputs = np.roll(targets, 1)
    inputs[start] = end
    first = np.zeros(int(per_text.sum()), dtype=bool)
    first[start // block] = True
    shape = (-1, block)
    return inputs.reshape(shape), targets.reshape(shape), there.reshape(shape), first


def _distances(block: int) -> np.ndarray:
    return np.arange(block)[:, None] + block - np.arange(2 * block)[None]


def _reach(p: dict, block: int) -> np.ndarray:
    """Heads x block x window: the factor of each distance, 0 for what comes later."""
    distance = _distances(block)
    return np.where(distance >= 0, np.exp(p["near"])[:, np.maximum(distance, 0)], 0)


def _row_sums(x: np.ndarray) -> np.ndarray:
    """Sums along the last, short axis: as a product, several times faster than a reduction."""
    return (x.reshape(-1, x.shape[-1]) @ np.ones(x.shape[-1], x.dtype)).reshape(x.shape[:-1])


def _attend(p: dict, shape: Shape, both: np.ndarray, first: np.ndarray, reach: np.ndarray):
    """Weights and gathered values for windows of slots ``both``, two blocks each."""
    n, heads = shape.block, shape.heads

    def rows(name: str, slots: np.ndarray) -> np.ndarray:
        found = np.take(p[name], slots, axis=0)
        return found.reshape(*slots.shape, heads, -1).transpose(0, 2, 1, 3)

    q, k, v = rows("query", both[:, n:]), rows("key", both), rows("value", both)
    s = q @ k.transpose(0, 1, 3, 2)
    np.exp(s, out=s)
    s *= reach
    s[first, :, :, :n] = 0
    total = _row_sums(s)[..., None]
    gathered = np.empty((len(both), n, heads, shape.dim // heads), s.dtype)
    np.matmul(s, v, out=gathered.transpose(0, 2, 1, 3))
    gathered /= total.transpose(0, 2, 1, 3)
    return q, k, v, s, total, gathered.reshape(-1, shape.dim)


def log_probabilities(
    model: Model, ids: np.ndarray, counts: np.ndarray, chunk: int = 128
) -> np.ndarray:
    """Natural log probability of each text, its ids and an end."""
    if not len(counts):
        return np.zeros(0)
    p, shape = model.p, model.shape
    slots = model.slot_of[ids]
    inputs, targets, there, first = _blocks(slots, counts, model.end, shape.block)
    gathered = np.empty((targets.size, shape.dim), np.float32)
    # Indices of machine size are what numpy gathers by without copies.
    both = np.concatenate([np.roll(inputs, 1, axis=0), inputs], axis=1).astype(np.intp)
    step, reach = chunk * shape.block, _reach(p, shape.block).astype(np.float32)
    for a in range(0, len(inputs), chunk):
        some = slice(a, a + chunk)
        rows = slice(a * shape.block, a * shape.block + step)
        gathered[rows] = _attend(p, shape, both[some], first[some], reach)[-1]
    goal, last = targets.reshape(-1), inputs.reshape(-1).astype(np.intp)
    value = np.empty(len(goal), np.float32)
    # One cluster after the other, so that the output layer is a product of two matrices.
    order = np.argsort(goal.astype(np.uint16), kind="stable")
    ends = np.searchsorted(goal[order], np.arange(0, SLOTS + 1, CLUSTERS))
    for c in range(CLUSTERS):
        for a in range(ends[c], ends[c + 1], step):
            at = order[a : min(a + step, ends[c + 1])]
            h, before = np.take(gathered, at, axis=0), np.take(last, at)
            high = h @ p["cluster"]
            high += np.take(p["direct_cluster"], before, axis=0)
            low = h @ p["member"][c]
            low += np.take(p["direct_member"][c], before, axis=0)
            hit = high[:, c] + low[np.arange(len(at)), goal[at] % CLUSTERS]
            for scores in (high, low):
                hit -= np.log(_row_sums(np.exp(scores, out=scores)))
            value[at] = hit
    value[~there.reshape(-1)] = 0
    per_block = value.reshape(-1, shape.block).sum(axis=1, dtype=np.float64)
    out = np.add.reduceat(per_block, np.flatnonzero(first))
    rare = np.where(slots == model.other, model.within[ids], 0.0)
    ends = np.cumsum(counts)
    sums = np.concatenate([[0.0], np.cumsum(rare)])
    return out + sums[ends] - sums[ends - counts]


def _pairs(slots: np.ndarray, counts: np.ndarray, end: int) -> np.ndarray:
    """How often a slot follows another one; the end comes before and after each text."""
    inputs, targets, there, _ = _blocks(slots, counts, end, 1)
    flat = inputs.reshape(-1).astype(np.int64) * SLOTS + targets.reshape(-1)
    return np.bincount(flat[there.reshape(-1)], minlength=SLOTS**2).reshape(SLOTS, SLOTS)


def _ordered(pairs: np.ndarray) -> np.ndarray:
    """Slots in an order in which like ones are near: split in halves again and again along the
    main direction of how they follow and precede the others."""
    context = np.log1p(np.concatenate([pairs, pairs.T], axis=1))
    context /= np.linalg.norm(context, axis=1, keepdims=True) + 1e-9
    projected = context @ np.random.default_rng(3).normal(size=(2 * SLOTS, 48))
    groups = [np.arange(SLOTS)]
    while len(groups) < CLUSTERS:
        halves = []
        for group in groups:
            centred = projected[group] - projected[group].mean(axis=0)
            _, vectors = np.linalg.eigh(centred.T @ centred)
            order = group[np.argsort(centred @ vectors[:, -1], kind="stable")]
            halves += [order[: len(order) // 2], order[len(order) // 2 :]]
        groups = halves
    return np.concatenate(groups)


def _initial(shape: Shape, pairs: np.ndarray) -> dict[str, np.ndarray]:
    random = np.random.default_rng(shape.seed)
    d, per_head = shape.dim, shape.dim // shape.heads

    def normal(*size: int, scale: float) -> np.ndarray:
        return random.normal(0, scale, size).astype(np.float32)

    alone = (pairs.sum(axis=0) + 0.5) / (pairs.sum() + 0.5 * SLOTS)
    direct = pairs + shape.smoothing * alone
    direct = (direct / direct.sum(axis=1, keepdims=True)).reshape(SLOTS, CLUSTERS, CLUSTERS)
    by_cluster = direct.sum(axis=2)
    slope = np.arange(2 * shape.block, dtype=np.float32)
    return {
        "query": normal(SLOTS, d, scale=per_head**-0.5),
        "key": normal(SLOTS, d, scale=per_head**-0.5),
        "value": normal(SLOTS, d, scale=0.3),
        # One head starts with what is near, the others with everything.
        "near": np.stack([-slope * (h == 0) for h in range(shape.heads)]).astype(np.float32),
        "cluster": normal(d, CLUSTERS, scale=0.1),
        "member": normal(CLUSTERS, d, CLUSTERS, scale=0.1),
        "direct_cluster": np.log(by_cluster).astype(np.float32),
        "direct_member": np.ascontiguousarray(
            np.log(direct / by_cluster[:, :, None]).transpose(1, 0, 2), dtype=np.float32
        ),
    }


#: Parameters that are counted, not trained.
COUNTED = ("direct_cluster", "direct_member")


def _softmax(x: np.ndarray) -> np.ndarray:
    """Rows that add up to one. The largest of a row is looked for only where it has to be."""
    with np.errstate(over="ignore"):
        e = np.exp(x)
        total = _row_sums(e)
    if not (total.min(initial=1.0) > 1e-20 and total.max(initial=1.0) < 1e30):
        e = np.exp(x - x.max(axis=1, keepdims=True))
        total = _row_sums(e)
    e /= total[:, None]
    return e


def _totals(rows: np.ndarray, order: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Sums of the ``rows`` in ``order``, of each range from ``begin`` on: to the bit those of
    ``np.add.reduceat``, which goes range by range for each column. Most ranges are short; these
    are summed side by side."""
    size = np.diff(begin, append=len(order))
    out = np.empty((len(begin), rows.shape[1]), rows.dtype)
    long = np.flatnonzero(size > SHORT)
    ends = np.cumsum(size[long])
    which = order[np.repeat(size > SHORT, size)]
    # As many at once as the nearest cache holds, as each column is a pass over all of them.
    cuts = np.flatnonzero(np.diff((ends - 1) // AT_ONCE, prepend=-1, append=-1))
    for i, j in zip(cuts.tolist(), cuts[1:].tolist()):
        start = int(ends[i] - size[long[i]])
        held = np.take(rows, which[start : ends[j - 1]], axis=0)
        out[long[i:j]] = np.add.reduceat(held, ends[i:j] - size[long[i:j]] - start, axis=0)
    short = np.flatnonzero(size <= SHORT)
    # The longest first, so that those that have another row are the first ones.
    short = short[np.argsort(-size[short], kind="stable")]
    at, more = begin[short], np.searchsorted(-size[short], -np.arange(SHORT), side="left")
    total = np.take(rows, order[at], axis=0)
    rest = np.take(rows, order[at[: more[1]] + 1], axis=0)
    for place in range(2, SHORT):
        rest[: more[place]] += np.take(rows, order[at[: more[place]] + place], axis=0)
    total[: more[1]] += rest
    out[short] = total
    return out


def gradients(p: dict, shape: Shape, both, targets, there, first) -> tuple[float, dict]:
    """Loss and gradients for windows of two blocks and the targets of the second one."""
    n, heads, dim = shape.block, shape.heads, shape.dim
    both = both.astype(np.intp)
    q, k, v, a, total, gathered = _attend(p, shape, both, first, _reach(p, n))
    # Places by the cluster of their target, so that those of one cluster are one matrix.
    cluster = targets.reshape(-1) // CLUSTERS
    order = np.argsort(cluster.astype(np.uint8), kind="stable")
    cluster, goal = cluster[order], targets.reshape(-1)[order]
    last, here = both[:, n:].reshape(-1)[order], there.reshape(-1)[order]
    ends = np.searchsorted(cluster, np.arange(CLUSTERS + 1)).tolist()
    of_cluster = [(c, slice(i, j)) for c, (i, j) in enumerate(zip(ends, ends[1:])) if i < j]
    rows = np.arange(len(goal)) * CLUSTERS
    in_cluster, in_member = rows + cluster, rows + goal % CLUSTERS
    weight = (here / max(here.sum(), 1)).astype(gathered.dtype)
    h = np.take(gathered, order, axis=0)
    high = h @ p["cluster"]
    high += np.take(p["direct_cluster"], last, axis=0)
    pc = _softmax(high)
    low = np.take(p["direct_member"].reshape(SLOTS * CLUSTERS, -1), cluster * SLOTS + last, axis=0)
    for c, at in of_cluster:
        low[at] += h[at] @ p["member"][c]
    pm = _softmax(low)
    hit = np.log(np.take(pc, in_cluster) + 1e-12) + np.log(np.take(pm, in_member) + 1e-12)
    loss = -(weight * hit).sum()
    pc.reshape(-1)[in_cluster] -= 1
    pm.reshape(-1)[in_member] -= 1
    pc *= weight[:, None]
    pm *= weight[:, None]
    g = {"cluster": h.T @ pc, "member": np.zeros_like(p["member"])}
    by_place = pc @ p["cluster"].T
    for c, at in of_cluster:
        np.matmul(h[at].T, pm[at], out=g["member"][c])
        by_place[at] += pm[at] @ p["member"][c].T
    dh = np.empty_like(by_place)
    dh[order] = by_place
    # What weights sum up to is what has been gathered, so it need not be summed again; ``a`` and
    # what meets it stay undivided by ``total`` and divided by it.
    pulled = _row_sums((dh * gathered).reshape(len(both), n, heads, -1)).transpose(0, 2, 1)
    dh = dh.reshape(len(both), n, heads, -1).transpose(0, 2, 1, 3) / total
    # Gradients of queries, and of keys beside values, place by place as they are added up.
    of_query = np.empty((len(both), n, heads, dim // heads), dh.dtype)
    of_both = np.empty((len(both), 2 * n, 2 * heads, dim // heads), dh.dtype)
    dq, dkv = of_query.transpose(0, 2, 1, 3), of_both.transpose(0, 2, 1, 3)
    np.matmul(a.transpose(0, 1, 3, 2), dh, out=dkv[:, heads:])
    ds = dh @ v.transpose(0, 1, 3, 2)
    ds -= pulled[..., None] / total
    ds *= a
    distance = _distances(n)
    g["near"] = np.zeros_like(p["near"])
    for head, change in enumerate(ds.sum(axis=0)):
        np.add.at(g["near"][head], distance[distance >= 0], change[distance >= 0])
    np.matmul(ds, k, out=dq)
    np.matmul(ds.transpose(0, 1, 3, 2), q, out=dkv[:, :heads])
    for names, slots, part in (
        (("query",), both[:, n:], of_query),
        (("key", "value"), both, of_both),
    ):
        flat = slots.reshape(-1).astype(np.int16)
        order = np.argsort(flat, kind="stable")
        ordered = flat[order]
        begin = np.flatnonzero(np.diff(ordered, prepend=np.int16(-1)))
        sums = _totals(part.reshape(len(flat), -1), order, begin)
        for i, name in enumerate(names):
            g[name] = np.zeros_like(p[name])
            g[name][ordered[begin]] = sums[:, i * dim : (i + 1) * dim]
    return float(loss), g


def bound(p: dict, shape: Shape) -> None:
    """Keep all exponents of the model below ``HIGHEST``, so that scoring can do without a look
    for the largest. A model that has trained as usual is far below and stays as it is."""

    def parts(name: str) -> np.ndarray:
        return p[name].reshape(SLOTS, shape.heads, -1)

    for head in range(shape.heads):
        q, k = (np.linalg.norm(parts(name)[:, head], axis=1).max() for name in ("query", "key"))
        parts("query")[:, head] *= min(1.0, HIGHEST / max(q * k, 1e-9))
        p["near"][head] = np.clip(p["near"][head], -HIGHEST, HIGHEST)
    # What is gathered is an average of values, so no longer than the longest of each head.
    h = np.linalg.norm(np.linalg.norm(parts("value"), axis=2).max(axis=0))
    for name in ("cluster", "member"):
        u = np.linalg.norm(p[name], axis=-2).max()
        p[name] *= min(1.0, HIGHEST / max(h * u, 1e-9))


class _Adam:
    """Steps of Adam on the parameters that are not counted."""

    def __init__(self, p: dict[str, np.ndarray]):
        self.p, self.steps = p, 0
        # Beside the two moments, room for what a step computes.
        self.held = {
            name: [np.zeros_like(p[name]) for _ in range(4)] for name in p if name not in COUNTED
        }

    def step(self, g: dict[str, np.ndarray], rate: float) -> None:
        self.steps += 1
        for name, (m, s, a, b) in self.held.items():
            np.subtract(g[name], m, out=a)
            a *= 0.1
            m += a
            np.square(g[name], out=a)
            a -= s
            a *= 0.01
            s += a
            np.divide(s, 1 - 0.99**self.steps, out=a)
            np.sqrt(a, out=a)
            a += 1e-6
            np.divide(m, 1 - 0.9**self.steps, out=b)
            b /= a
            b *= rate
            self.p[name] -= b


def slots_of(often: np.ndarray) -> np.ndarray:
    """The slot of each id by how often ids occur: the most frequent have slots of their own, all
    others the one before the end's."""
    top = np.argsort(-often, kind="stable")[: SLOTS - 2]
    slot_of = np.full(IDS, SLOTS - 2, dtype=np.int32)
    slot_of[top] = np.arange(len(top))
    return slot_of


def counted_pairs(slot_of: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return _pairs(slot_of[ids], counts, SLOTS - 1)


def counted(often: np.ndarray, pairs: np.ndarray, shape: Shape = Shape()) -> Model:
    """The model that counts alone give: ``often`` for ids, ``pairs`` for their ``slots_of``.
    Its attention has not learnt yet. Without any counts all slots have the same probability."""
    slot_of = slots_of(often)
    rest = slot_of == SLOTS - 2
    within = np.zeros(IDS)
    within[rest] = np.log((often[rest] + 0.5) / (often[rest] + 0.5).sum())
    order = _ordered(pairs)
    leaf = np.empty(SLOTS, dtype=np.int32)
    leaf[order] = np.arange(SLOTS)
    parameters = _initial(shape, pairs[order][:, order])
    other, end = int(leaf[SLOTS - 2]), int(leaf[SLOTS - 1])
    return Model(shape, leaf[slot_of], other, end, within, parameters)


def _windows(model: Model, ids: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """Windows of all texts: both blocks, targets, whether there, whether the first."""
    inputs, *others = _blocks(model.slot_of[ids], counts, model.end, model.shape.block)
    return [np.concatenate([np.roll(inputs, 1, axis=0), inputs], axis=1), *others]


def train(model: Model, ids: np.ndarray, counts: np.ndarray) -> None:
    """``steps`` steps on windows drawn from a sample of texts: where the rounds start."""
    shape = model.shape
    if not len(counts):
        return
    held = _windows(model, ids, counts)
    random = np.random.default_rng(shape.seed)
    adam = _Adam(model.p)
    for step in range(shape.steps):
        some = random.integers(0, len(held[0]), shape.windows)
        _, g = gradients(model.p, shape, *(part[some] for part in held))
        adam.step(g, shape.rate * (1 - step / shape.steps) + 1e-4)
    bound(model.p, shape)


def passed(model: Model, texts: Iterable[tuple[np.ndarray, np.ndarray]], rate: float) -> int:
    """Every window of ``texts`` (ids and counts of some texts each) once, in steps of ``windows``;
    trains ``model`` in place. How many targets there were."""
    shape, adam, seen = model.shape, _Adam(model.p), 0
    random = np.random.default_rng(shape.seed)
    left = None

    def step(some: list[np.ndarray]) -> None:
        _, g = gradients(model.p, shape, *some)
        adam.step(g, rate)

    for ids, counts in texts:
        if not len(counts):
            continue
        held = _windows(model, ids, counts)
        seen += int(held[2].sum())
        if left:
            held = [np.concatenate(parts) for parts in zip(left, held)]
        order = random.permutation(len(held[0]))
        whole = len(order) // shape.windows * shape.windows
        for a in range(0, whole, shape.windows):
            step([part[order[a : a + shape.windows]] for part in held])
        left = [part[order[whole:]] for part in held]
    if left and len(left[0]):
        step(left)
    return seen


def packed_parameters(p: dict[str, np.ndarray]) -> np.ndarray:
    """The trained parameters in one row."""
    return np.concatenate([p[n].reshape(-1) for n in sorted(p) if n not in COUNTED])


def unpacked_parameters(row: np.ndarray, p: dict[str, np.ndarray]) -> None:
    """Puts such a row into ``p``."""
    at = 0
    for name in sorted(p):
        if name not in COUNTED:
            size = p[name].size
            p[name] = row[at : at + size].reshape(p[name].shape).astype(np.float32)
            at += size


def fit(ids: np.ndarray, counts: np.ndarray, shape: Shape = Shape()) -> Model:
    """The model of texts that are all at hand. Without texts it gives all slots the same
    probability."""
    often = np.bincount(ids, minlength=IDS)
    model = counted(often, counted_pairs(slots_of(often), ids, counts), shape)
    train(model, ids, counts)
    return model
