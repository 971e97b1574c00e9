"""Gradient boosting on histograms, with second-order steps, over rows that stay where they are.

Columns become bins once: numbers by quantiles, categories by their place among the
sorted values, where a split asks for one value against the rest. Rows are stored as
blocks of small integers with label, weight and raw score. A level of a tree is one
job: each task sums gradients and Hessians of its rows per node and bin, the sums of
a node meet in one small group, and the driver sees one histogram per node. Of two
siblings only the smaller one is summed, the other one is what its parent has left. Of
the splits found, level by level, the best are taken first until the tree has its leaves;
a node that those taken so far push out of the tree is not followed. The gradients are
worked out once for each tree and kept by the executors for its levels. Every few trees the
raw scores are stored anew, so a tree never follows more trees than that. So few rows that
jobs would take longer than their sums (``HERE_ROWS``) are grown on in one task.
Rows held back by a hash of their key tell when more trees stop helping.

Defined results: a missing number is in the lowest bin; a category not seen in
training equals no value; with one class the score is its share; without rows it is
one half.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curbline.session import cut, discard

#: Trees after which raw scores are stored anew; rows of a block; values of a category that are told apart.
REFRESH, BLOCK_ROWS, MOST_VALUES = 10, 1 << 16, 4096
#: Rows whose Shapley values are worked out at once; columns of a path of which all cases are; cases of all leaves that are sent to the tasks.
SHAPLEY_ROWS, MOST_KNOWN, KEPT_CASES = 1 << 14, 10, 1 << 21
#: Gains that differ by less than this share are equal.
SAME = 1e-9
#: Sums of all tasks that the driver adds up itself; more meet in a group for each node first.
DIRECT_BYTES = 1 << 26
#: Rows worth a task of their own; rows up to which one task grows all trees.
TASK_ROWS, HERE_ROWS = 1 << 14, 1 << 20


@dataclass(frozen=True)
class Settings:
    """``stop``: end after so many trees without a better loss on the rows held back (0: never); a leaf holds ``leaf_rows`` rows and ``leaf_weight`` of Hessian."""

    trees: int = 100
    depth: int = 8
    leaves: int = 31
    rate: float = 0.1
    bins: int = 255
    l2: float = 0.0
    leaf_rows: int = 20
    leaf_weight: float = 1e-3
    rows_share: float = 1.0
    columns_share: float = 1.0
    stop: int = 10
    held_back: int = 10  # one row in so many


@dataclass
class Tree:
    """Nodes as arrays: column, bin (go left up to it) or value (go left when equal), children (-1: leaf), step, weight of rows."""

    column: list[int] = field(default_factory=list)
    cut: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    step: list[float] = field(default_factory=list)
    cover: list[float] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)

    def add(self, step: float, cover: float) -> int:
        for name, value in (("column", -1), ("cut", -1), ("left", -1), ("right", -1), ("step", step), ("cover", cover), ("gain", 0.0)):
            getattr(self, name).append(value)
        return len(self.step) - 1


@dataclass
class Model:
    numbers: list[str]
    categories: list[str]
    edges: list[list[float]]  # upper ends of the bins of each number
    values: list[list[str]]  # of each category
    start: float = 0.0
    trees: list[Tree] = field(default_factory=list)
    losses: list[float] = field(default_factory=list)

    @property
    def columns(self) -> list[str]:
        return self.numbers + self.categories

    @property
    def sizes(self) -> list[int]:
        """Bins of each column."""
        return [len(x) + 1 for x in (*self.edges, *self.values)]

    @property
    def kind(self) -> type:
        return np.uint8 if max(self.sizes, default=0) <= 256 else np.uint16

    def encode(self, batch: list[pa.Array]) -> np.ndarray:
        """Bins of the model's columns, in their order."""
        out = np.zeros((len(batch[0]), len(self.columns)), self.kind, order="F")  # a column lies together
        for k, edges in enumerate(self.edges):
            x = np.asarray(batch[k].cast(pa.float64()).to_numpy(zero_copy_only=False), float)
            out[:, k] = np.searchsorted(edges, np.where(np.isnan(x), -np.inf, x), "left")
        for k, values in enumerate(self.values, len(self.numbers)):
            place = pc.index_in(batch[k].cast(pa.string()), value_set=pa.array(values, pa.string()))
            out[:, k] = pc.fill_null(place, -1).to_numpy(zero_copy_only=False) + 1  # 0: not seen
        return out

    def goes_left(self, tree: Tree, node: int, bins: np.ndarray) -> np.ndarray:
        c = tree.column[node]
        return bins[:, c] == tree.cut[node] if c >= len(self.numbers) else bins[:, c] <= tree.cut[node]

    def parted(self, tree: Tree, node: int, bins: np.ndarray, rows: np.ndarray | None, asked=None) -> list[tuple[int, np.ndarray]]:
        """The children of a node, or those asked for, with their shares of its rows."""
        x = bins[:, tree.column[node]]
        if rows is not None:
            x = x[rows]
        left = x == tree.cut[node] if tree.column[node] >= len(self.numbers) else x <= tree.cut[node]
        sides = [(child, here) for child, here in ((tree.left[node], left), (tree.right[node], ~left)) if asked is None or asked[child]]
        return [(child, np.flatnonzero(here) if rows is None else rows.compress(here)) for child, here in sides]

    def rows_at(self, tree: Tree, bins: np.ndarray, wanted: list[int] | None = None) -> Iterator[tuple[int, np.ndarray | None]]:
        """Each leaf with its rows (None: all), or of the leaves only those wanted."""
        asked = np.ones(len(tree.step), bool)
        if wanted is not None:
            asked[:] = False
            asked[wanted] = True
            for node in range(len(tree.step) - 1, -1, -1):  # children come after their parent
                if tree.left[node] >= 0:
                    asked[node] = asked[tree.left[node]] | asked[tree.right[node]]
        stack: list[tuple[int, np.ndarray | None]] = [(0, None)]
        while stack:
            node, rows = stack.pop()
            if not asked[node]:
                continue
            if tree.left[node] < 0:
                yield node, rows
                continue
            stack += self.parted(tree, node, bins, rows, asked)[::-1]

    def leaf_of(self, tree: Tree, bins: np.ndarray) -> np.ndarray:
        at = np.zeros(len(bins), np.int64)
        for node, rows in self.rows_at(tree, bins):
            at[slice(None) if rows is None else rows] = node
        return at

    def raw(self, bins: np.ndarray, trees: list[Tree] | None = None) -> np.ndarray:
        out = np.full(len(bins), self.start if trees is None else 0.0)
        for tree in self.trees if trees is None else trees:
            out += np.array(tree.step)[self.leaf_of(tree, bins)]
        return out

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def of_json(text: str) -> Model:
        got = json.loads(text)
        return Model(**(got | {"trees": [Tree(**t) for t in got["trees"]]}))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def _chance(h: np.ndarray, salt: int) -> np.ndarray:
    """A number in [0, 1) for each hash, another one for each salt."""
    x = h.view(np.uint64) + np.uint64(salt) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / (1 << 53)


def prepared(df: DataFrame, numbers: list[str], categories: list[str], bins: int) -> Model:
    """An empty model with the bins of the frame's columns."""
    edges, values = [], []
    marks = [(i + 1) / bins for i in range(bins - 1)]
    row = df.agg(
        *[F.percentile_approx(F.col(c).cast("double"), marks, 10_000).alias(f"q{k}") for k, c in enumerate(numbers)],
        *[F.max(F.col(c).cast("double")).alias(f"m{k}") for k, c in enumerate(numbers)],
    ).first() if numbers else None
    for k in range(len(numbers)):
        got = sorted({x for x in row[f"q{k}"] or [] if x == x})
        edges.append([x for x in got if x < row[f"m{k}"]])  # the last bin is open
    for c in categories:
        found = df.where(F.col(c).isNotNull()).groupBy(c).count().orderBy(F.desc("count"), c).limit(MOST_VALUES).collect()
        values.append(sorted(str(r[0]) for r in found))
    return Model(numbers, categories, edges, values)


_COLUMNS = ["bins", "y", "w", "h", "raw"]
_BLOCK = ", ".join(f"{c} binary" for c in _COLUMNS)


def _blocks(df: DataFrame, model: Model, label: str, weight: str | None, key: str, n_rows: int) -> DataFrame:
    """The rows as blocks, stored; a few rows are spread over the cores, many stay as they are dealt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(a, BLOCK_ROWS)
                bins = model.encode([part.column(c) for c in model.columns])
                y, w = [np.asarray(part.column(c).to_numpy(zero_copy_only=False), float) for c in ("_y", "_w")]
                h = part.column("_h").to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x.tobytes()], pa.binary()) for x in (bins.T, y, w, h, np.full(len(y), model.start))], names=_COLUMNS
                )

    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = df.where(F.col(label).isNotNull()).select(*model.columns, F.col(label).cast("double").alias("_y"), w.alias("_w"), F.xxhash64(key).alias("_h"))
    want = min(-(-n_rows // TASK_ROWS), df.sparkSession.sparkContext.defaultParallelism)
    if rows.rdd.getNumPartitions() < want:
        rows = rows.repartition(want)
    return cut(rows.mapInArrow(run, _BLOCK))


def _unpacked(rows, model: Model) -> Iterator[tuple[np.ndarray, ...]]:
    """Bins, label, weight, hash and raw score of each block."""
    for bins, y, w, h, raw in rows:
        yield (
            np.frombuffer(bins, model.kind).reshape(len(model.columns), -1).T,
            *[np.frombuffer(x, np.float64) for x in (y, w)], np.frombuffer(h, np.int64), np.frombuffer(raw, np.float64),
        )


def _refreshed(blocks: DataFrame, model: Model, trees: list[Tree]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*[batch.column(c).to_pylist() for c in _COLUMNS])
            raw = [(raw + model.raw(bins, trees)).tobytes() for bins, _, _, _, raw in _unpacked(rows, model)]
            yield batch.set_column(batch.schema.get_field_index("raw"), "raw", pa.array(raw, pa.binary()))

    return cut(blocks.mapInArrow(run, _BLOCK))


def _used(h: np.ndarray, number: int, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Rows held back, and rows that the tree of this number is grown on."""
    held = (_chance(h, 1) * settings.held_back < 1) if settings.stop else np.zeros(len(h), bool)
    use = ~held
    if settings.rows_share < 1:
        use &= _chance(h, 1000 + number) < settings.rows_share
    return held, use


def _steps(block: tuple[np.ndarray, ...], number: int, settings: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For the rows the tree is grown on bins, gradient and Hessian; loss and weight of those held back."""
    bins, y, w, h, raw = block
    held, use = _used(h, number, settings)
    yh, wh, rh = y[held], w[held], raw[held]
    loss = np.array([(wh * (np.logaddexp(0, rh) - yh * rh)).sum(), wh.sum()])
    use = np.flatnonzero(use)
    w, p = w[use], _sigmoid(raw[use])
    return bins.T.take(use, axis=1).T, w * (p - y[use]), w * p * (1 - p), loss


def _tally(bins: np.ndarray, g: np.ndarray, h: np.ndarray, model: Model, found: list[np.ndarray | None], hist: np.ndarray) -> None:
    """Add gradient, Hessian and rows of every bin of each node; ``found``: the rows of each."""
    n, first = len(found), 0
    rows, of = slice(None), 0
    if found[0] is not None:  # not the root
        rows, of = np.concatenate(found), np.repeat(np.arange(n), [len(r) for r in found])
        g, h = g[rows], h[rows]
    for c, size in enumerate(model.sizes):
        cell = bins[:, c][rows].astype(np.intp)
        if n > 1:
            cell += of * size
        for j, x in enumerate((g, h, None)):
            hist[:, j, first : first + size] += np.bincount(cell, x, n * size).reshape(n, size)
        first += size


class _Here:
    """Rows of one task."""

    def __init__(self, rows, model: Model, settings: Settings):
        self.model, self.settings, got = model, settings, list(_unpacked(rows, model))
        bins, (y, w, h, raw) = np.concatenate([b.T for b, *_ in got], axis=1), [np.concatenate(x) for x in list(zip(*got))[1:]]
        order = np.lexsort((y, w, h))  # one order, one result
        bins, y, w, h, raw = bins[:, order], y[order], w[order], h[order], raw[order]
        self.blocks = [(bins[:, a:b].T, y[a:b], w[a:b], h[a:b], raw[a:b]) for a in range(0, len(y), BLOCK_ROWS) for b in [a + BLOCK_ROWS]]

    def begin(self, number: int) -> None:
        self.steps = [_steps(b, number, self.settings) for b in self.blocks]
        self.found: list[dict[int, np.ndarray | None]] = [{0: None} for _ in self.blocks]

    def sums(self, tree: Tree, nodes: list[int]) -> tuple[np.ndarray, np.ndarray]:
        hist = np.zeros((len(nodes), 3, sum(self.model.sizes)))
        parents = [p for p in range(len(tree.step)) if not {tree.left[p], tree.right[p]}.isdisjoint(nodes)]
        for (bins, g, h, _), found in zip(self.steps, self.found):
            for p in parents:
                found |= self.model.parted(tree, p, bins, found.pop(p))
            _tally(bins, g, h, self.model, [found[n] for n in nodes], hist)
        return hist, np.sum([b[3] for b in self.steps], axis=0)

    def add(self, tree: Tree) -> None:
        for bins, _, _, _, raw in self.blocks:
            raw += self.model.raw(bins, [tree])

    def covers(self) -> dict[int, list[np.ndarray]]:
        return {0: [_leaf_weights(b, self.model, self.settings) for b in self.blocks]}


class _Spread:
    """Rows of all tasks. The executors keep the blocks, and for the tree that grows its gradients; both are made anew from the stored blocks where they are lost."""

    def __init__(self, blocks: DataFrame, model: Model, settings: Settings):
        self.model, self.settings, self.kept, self.steps = model, settings, None, None
        self._keep(blocks)

    def _keep(self, blocks: DataFrame) -> None:
        self.blocks, self.recent = blocks, []
        if self.kept is not None:
            self.kept.unpersist()
        self.kept = blocks.rdd.map(lambda r: tuple(bytes(x) for x in r)).persist(StorageLevel.MEMORY_AND_DISK)
        self.tasks = self.kept.getNumPartitions()

    def begin(self, number: int) -> None:
        if len(self.recent) == REFRESH:
            before = self.blocks
            self._keep(_refreshed(before, self.model, self.recent))
            discard(before)
        model, settings, recent = _bare(self.model), self.settings, list(self.recent)

        def steps(rows):
            for bins, y, w, h, raw in _unpacked(rows, model):
                if recent:
                    raw = raw + model.raw(bins, recent)
                bins, g, h, loss = _steps((bins, y, w, h, raw), number, settings)
                yield bins.T.tobytes(), g.tobytes(), h.tobytes(), loss.tobytes()

        if self.steps is not None:
            self.steps.unpersist()
        self.steps = self.kept.mapPartitions(steps).persist(StorageLevel.MEMORY_AND_DISK)

    def sums(self, tree: Tree, nodes: list[int]) -> tuple[np.ndarray | None, np.ndarray]:
        model, total = _bare(self.model), sum(self.model.sizes)

        def run(rows) -> list[tuple[int, bytes]]:
            hist, loss, some = np.zeros((len(nodes), 3, total)), np.zeros(2), False
            for bins, g, h, lost in rows:
                some = True
                loss += np.frombuffer(lost)
                bins = np.frombuffer(bins, model.kind).reshape(len(model.columns), -1).T
                found = dict(model.rows_at(tree, bins, nodes))
                _tally(bins, np.frombuffer(g), np.frombuffer(h), model, [found[n] for n in nodes], hist)
            return [*((k, x.tobytes()) for k, x in enumerate(hist)), (-1, loss.tobytes())] if some else []

        got = _met(self.steps.mapPartitions(run), self.tasks * len(nodes) * 24 * total)
        if not got:
            return None, np.zeros(2)
        return np.stack([got[k].reshape(3, total) for k in range(len(nodes))]), got[-1]

    def add(self, tree: Tree) -> None:
        self.recent.append(tree)

    def covers(self) -> dict[int, list[np.ndarray]]:
        model, settings = self.model, self.settings

        def run(rows) -> list[tuple[int, bytes]]:
            return [(k % 64, x.tobytes()) for k, x in enumerate(_leaf_weights(b, model, settings) for b in _unpacked(rows, model))]

        nodes = sum(len(t.step) for t in model.trees)
        return {k: [x] for k, x in _met(self.kept.mapPartitions(run), self.tasks * 64 * 8 * nodes).items()}

    def end(self) -> None:
        for x in (self.steps, self.kept):
            if x is not None:
                x.unpersist()
        discard(self.blocks)


def _bare(model: Model) -> Model:
    """The model without its trees, for tasks that do not need them."""
    return Model(model.numbers, model.categories, model.edges, model.values, model.start)


def _met(parts, size: int) -> dict[int, np.ndarray]:
    """The sums of (number, part) by number: few enough for the driver, or each in a group first."""

    def added(parts) -> np.ndarray:
        return np.sum([np.frombuffer(x) for x in sorted(parts)], axis=0)  # one order, one result

    if size > DIRECT_BYTES:
        return {k: np.frombuffer(x) for k, x in parts.groupByKey().mapValues(lambda x: added(x).tobytes()).collect()}
    by: dict[int, list[bytes]] = {}
    for k, x in parts.collect():
        by.setdefault(k, []).append(x)
    return {k: added(x) for k, x in by.items()}


def _leaf_weights(block: tuple[np.ndarray, ...], model: Model, settings: Settings) -> np.ndarray:
    """Weight of the rows that each tree was grown on, by leaf; the nodes of all trees in one row."""
    bins, _, w, h, _ = block
    out = []
    for number, tree in enumerate(model.trees):
        if number == 0 or settings.rows_share < 1:
            _, use = _used(h, number, settings)
            some, weight = bins.T.compress(use, axis=1).T, w.compress(use)
        out.append(np.bincount(model.leaf_of(tree, some), weight, len(tree.step)))
    return np.concatenate(out)


def best_splits(hist: np.ndarray, first: np.ndarray, n_numbers: int, allowed: list[int], settings: Settings) -> list[tuple | None]:
    """For each node: gain, column, cut, and (gradient, Hessian, rows) left and right of its best split, if there is one."""
    whole = hist[:, :, first[0] : first[1]].sum(axis=2)[:, :, None]

    def worth(s):
        return s[:, 0] ** 2 / np.maximum(s[:, 1] + settings.l2, 1e-12)

    n = np.arange(len(hist))
    best, chosen = np.full(len(hist), 1e-9), [None] * len(hist)
    for c in allowed:
        here = hist[:, :, first[c] : first[c + 1]]
        left = np.cumsum(here, axis=2)[:, :, :-1] if c < n_numbers else here[:, :, 1:]
        if not left.shape[2]:
            continue
        right = whole - left
        ok = (left[:, 2] >= settings.leaf_rows - 0.5) & (right[:, 2] >= settings.leaf_rows - 0.5)
        ok &= (left[:, 1] >= settings.leaf_weight) & (right[:, 1] >= settings.leaf_weight)
        gain = np.where(ok, (worth(left) + worth(right) - worth(whole)) / 2, -np.inf)
        # The first of equals: which of them rounding makes the largest depends on the order of the sums.
        k = (gain >= gain.max(axis=1, keepdims=True) * (1 - SAME)).argmax(axis=1)
        gain = gain[n, k]
        for node in np.flatnonzero(gain > best * (1 + SAME) + 1e-12).tolist():
            at = int(k[node])
            chosen[node] = (float(gain[node]), c, at if c < n_numbers else at + 1, left[node, :, at], right[node, :, at])
            best[node] = gain[node]
    return chosen


def _best_first(tree: Tree, found: dict[int, tuple], leaves: int) -> list[int]:
    """The nodes to split, the best first, until the tree has its leaves."""
    out, queue = [], [(-found[0][0], 0)] if 0 in found else []
    while queue and len(out) < leaves - 1:
        _, node = heapq.heappop(queue)
        out.append(node)
        for child in (tree.left[node], tree.right[node]):
            if child in found:
                heapq.heappush(queue, (-found[child][0], child))
    return out


def _grow(rows: _Here | _Spread, model: Model, number: int, settings: Settings, seed: int) -> tuple[Tree | None, float | None]:
    """The next tree (None: no split is left), and the loss before it on the rows held back."""
    sizes = model.sizes
    first, n_numbers = np.cumsum([0, *sizes]), len(model.numbers)
    draw = np.random.default_rng([seed, number])
    keep = max(1, round(settings.columns_share * len(sizes)))
    allowed = sorted(draw.choice(len(sizes), keep, replace=False).tolist()) if keep < len(sizes) else list(range(len(sizes)))
    rows.begin(number)
    full, loss = Tree(), None
    full.add(0.0, 0.0)
    found: dict[int, tuple] = {}
    hists: dict[int, np.ndarray] = {}
    nodes = [0]
    for _ in range(settings.depth):
        # Of two siblings the one with fewer rows is summed; what the parent has more is the other's.
        asked, other = nodes, {}
        if nodes != [0]:
            pairs = [(p, full.left[p], full.right[p]) for p in found if not {full.left[p], full.right[p]}.isdisjoint(nodes)]
            less = {p: i if found[p][3][2] <= found[p][4][2] else j for p, i, j in pairs}
            asked = list(less.values())
            other = {less[p]: (p, i + j - less[p]) for p, i, j in pairs}
        sums, lost = rows.sums(full, asked)
        if sums is None:
            break
        if nodes == [0] and lost[1] > 0:
            loss = float(lost[0] / lost[1])
        here = dict(zip(asked, sums))
        for one, (parent, rest) in other.items():
            left = hists[parent] - here[one]
            here[rest] = np.where(left[2] > 0.5, left, 0.0)  # no rows, no sums
        hists = {node: here[node] for node in nodes}
        for node, split in zip(nodes, best_splits(np.stack([hists[n] for n in nodes]), first, n_numbers, allowed, settings)):
            if split is None:
                continue
            found[node] = split
            _, full.column[node], full.cut[node], left, right = split
            full.left[node], full.right[node] = [full.add(-settings.rate * s[0] / (s[1] + settings.l2), 0.0) for s in (left, right)]
        # Nodes further down only push others out: what is not taken now never is.
        taken = [n for n in _best_first(full, found, settings.leaves) if n in hists]
        nodes = sorted(
            child for n in taken for child, s in zip((full.left[n], full.right[n]), found[n][3:]) if s[2] >= 2 * settings.leaf_rows - 0.5
        )
        if not nodes:
            break
    if 0 not in found:
        return None, loss
    tree, place = Tree(), {0: 0}
    tree.add(full.step[0], 0.0)
    for node in _best_first(full, found, settings.leaves):
        at = place[node]
        tree.column[at], tree.cut[at], tree.gain[at] = full.column[node], full.cut[node], found[node][0]
        for side in ("left", "right"):
            child = getattr(full, side)[node]
            place[child] = tree.add(full.step[child], 0.0)
            getattr(tree, side)[at] = place[child]
    return tree, loss


def _boosted(rows: _Here | _Spread, model: Model, settings: Settings, seed: int) -> Model:
    """The model with its trees."""
    best = (np.inf, 0)
    for number in range(settings.trees):
        tree, loss = _grow(rows, model, number, settings, seed)
        if loss is not None:
            model.losses.append(loss)
            if loss < best[0] - 1e-7:
                best = (loss, number)
            elif settings.stop and number - best[1] >= settings.stop:
                break  # as many trees were grown in vain
        if tree is None:
            break
        model.trees.append(tree)
        rows.add(tree)
    if model.trees:
        weights = np.sum([x for parts in sorted(rows.covers().items()) for x in parts[1]], axis=0)
        for tree in model.trees:
            own, weights = weights[: len(tree.step)], weights[len(tree.step) :]
            tree.cover = own.tolist()
            for node in range(len(own) - 1, -1, -1):  # children come after their parent
                if tree.left[node] >= 0:
                    tree.cover[node] = tree.cover[tree.left[node]] + tree.cover[tree.right[node]]
    return model


def fit(
    df: DataFrame, numbers: list[str], categories: list[str], label: str, key: str, settings: Settings = Settings(),
    weight: str | None = None, seed: int = 42,
) -> Model:
    """Fit on the rows of a label that is not null."""
    model = prepared(df, numbers, categories, settings.bins)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    base = df.where(F.col(label).isNotNull()).agg(F.sum(w).alias("n"), F.sum(w * F.col(label)).alias("y"), F.count("*").alias("rows")).first()
    share = base["y"] / base["n"] if base["n"] else 0.5
    model.start = float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))) if 0 < share < 1 else float(np.sign(share - 0.5) * 20 * (share != 0.5))
    if not 0 < share < 1 or not base["rows"]:
        return model
    blocks = _blocks(df, model, label, weight, key, base["rows"])
    if base["rows"] > HERE_ROWS:
        rows = _Spread(blocks, model, settings)
        model = _boosted(rows, model, settings, seed)
        rows.end()
        return model

    def here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [row for batch in batches for row in zip(*[batch.column(c).to_pylist() for c in _COLUMNS])]
        grown = _boosted(_Here(got, model, settings), model, settings, seed)
        yield pa.RecordBatch.from_arrays([pa.array([grown.to_json()])], names=["model"])

    model = Model.of_json(blocks.coalesce(1).mapInArrow(here, "model string").collect()[0][0])
    discard(blocks)
    return model


def probability(model: Model) -> Column:
    """The positive class's probability of each row."""

    @F.arrow_udf("double")
    def p(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for columns in batches:
            yield pa.array(_sigmoid(model.raw(model.encode(list(columns)))))

    return p(*[F.col(c).cast("double") for c in model.numbers], *[F.col(c).cast("string") for c in model.categories])


def split_columns(model: Model) -> list[str]:
    """The columns that splits ask for: each number, each value of a category."""
    return [f"remainder__{n}" for n in model.numbers] + [f"cat__{c}_{v}" for c, vs in zip(model.categories, model.values) for v in vs]


def _split_column(model: Model, tree: Tree, node: int) -> int:
    c = tree.column[node]
    if c < len(model.numbers):
        return c
    before = sum(len(v) for v in model.values[: c - len(model.numbers)])
    return len(model.numbers) + before + tree.cut[node] - 1


def gains(model: Model) -> dict[str, float]:
    """Each split column's share of the gains of all splits; all are there."""
    names = split_columns(model)
    out = dict.fromkeys(names, 0.0)
    for tree in model.trees:
        for node, gain in enumerate(tree.gain):
            if tree.left[node] >= 0:
                out[names[_split_column(model, tree, node)]] += gain
    total = sum(out.values()) or 1.0
    return {n: g / total for n, g in out.items()}


def expected(model: Model) -> float:
    """The mean raw score that the trees' own weights give."""
    out = model.start
    for tree in model.trees:
        out += sum(tree.step[k] * tree.cover[k] for k in range(len(tree.step)) if tree.left[k] < 0) / max(tree.cover[0], 1e-300)
    return out


def _paths(tree: Tree) -> Iterator[tuple[int, list[tuple[int, bool]]]]:
    """Each leaf with the steps to it: node, and whether it goes left there."""
    stack = [(0, [])]
    while stack:
        node, path = stack.pop()
        if tree.left[node] < 0:
            yield node, path
        else:
            stack += [(tree.right[node], [*path, (node, False)]), (tree.left[node], [*path, (node, True)])]


def _shares(model: Model, tree: Tree) -> Iterator[tuple[list[int], list[tuple], np.ndarray]]:
    """For each leaf: the split columns on its path, for each the bins that agree with the path
    (column; above, up to; or the value it must or must not have), and by column and case
    (bit k: column k agrees) what the leaf adds to the column's Shapley value; with many
    columns as a function of the cases that occur."""
    for leaf, path in _paths(tree):
        if not path:
            continue
        columns = sorted({_split_column(model, tree, n) for n, _ in path})
        d = len(columns)
        share, agrees = np.ones(d), [(-1, 1 << 16, None, None)] * d
        for n, goes in path:
            k = columns.index(_split_column(model, tree, n))
            child = tree.left[n] if goes else tree.right[n]
            share[k] *= tree.cover[child] / max(tree.cover[n], 1e-300)
            low, high, value, is_value = agrees[k]
            if tree.column[n] < len(model.numbers):
                low, high = (low, min(high, tree.cut[n])) if goes else (max(low, tree.cut[n]), high)
            elif value is None or is_value == goes:
                value, is_value = tree.cut[n], goes
            else:
                low = high  # nothing is and is not a value
            agrees[k] = (low, high, value, is_value)
        source = {k: tree.column[n] for n, _ in path for k in [columns.index(_split_column(model, tree, n))]}

        def worth(case: np.ndarray, share=share, step=tree.step[leaf]) -> np.ndarray:
            return np.ascontiguousarray(step * _worth(case, share).T)

        every = worth(np.arange(1 << d)) if d <= MOST_KNOWN else worth
        yield columns, [(source[k], *agrees[k]) for k in range(d)], every


def _worth(case: np.ndarray, share: np.ndarray) -> np.ndarray:
    """For each case (bit k: column k agrees) and column its share of a leaf's step."""
    d = len(share)
    bits = ((case[:, None] >> np.arange(d).astype(case.dtype)) & 1).astype(float)
    poly = np.zeros((len(case), d, d))  # for each case and column: coefficients by number of known columns among the others
    poly[:, :, 0] = 1
    for k in range(d):
        more = poly * share[k]
        more[:, :, 1:] += poly[:, :, :-1] * bits[:, k, None, None]
        more[:, k] = poly[:, k]
        poly = more
    return (poly @ _orders(d)) * (bits - share)


def attributions(model: Model, bins: np.ndarray, shares: list | None = None) -> np.ndarray:
    """Shapley values of each row's raw score, a column for each of ``split_columns``.

    A leaf counts for a set of known columns by the share of its weight that the unknown
    ones leave (path-dependent). A path of d columns has 2^d cases of columns the row
    agrees with at most; each is worked out once, and a row looks its case up (of more than
    ``MOST_KNOWN`` columns those that occur). ``shares`` are :func:`_shares` of all trees,
    for callers with several blocks of rows.
    """
    out = np.zeros((len(split_columns(model)), len(bins)))
    by_column = [np.ascontiguousarray(bins[:, c]) for c in range(len(model.columns))]
    for leaves in shares if shares is not None else (_shares(model, t) for t in model.trees):
        for columns, agrees, worth in leaves:
            case = np.zeros(len(bins), np.uint8 if len(columns) <= 8 else np.uint64)
            for k, (c, low, high, value, is_value) in enumerate(agrees):
                x = by_column[c]
                if low >= high:
                    continue
                if value is not None:
                    fits = x == value if is_value else x != value
                elif low < 0:
                    fits = x <= high
                else:
                    fits = x > low if high > np.iinfo(x.dtype).max else (x > low) & (x <= high)
                case |= fits.astype(case.dtype) << case.dtype.type(k)
            if callable(worth):
                some, at = np.unique(case, return_inverse=True)
                worth = worth(some)
            else:
                at = case.astype(np.intp)
            for column, gain in zip(columns, worth):
                out[column] += gain.take(at, mode="clip")
    return out.T


def _orders(d: int) -> np.ndarray:
    """Share of the orders of d columns in which s given others come first and the rest later."""
    from math import factorial

    return np.array([factorial(s) * factorial(d - s - 1) / factorial(d) for s in range(d)])


def attributed(model: Model, df: DataFrame, keep: list[str]) -> DataFrame:
    """``keep``, raw score, and attributions (in the order of ``split_columns``) of each row."""
    others = df.select(*keep).schema

    few = sum(1 << min(len(path), MOST_KNOWN) for t in model.trees for _, path in _paths(t)) <= KEPT_CASES
    shares = [list(_shares(model, t)) for t in model.trees] if few else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, SHAPLEY_ROWS):
                part = batch.slice(a, SHAPLEY_ROWS)
                bins = model.encode([part.column(f"_{k}") for k in range(len(model.columns))])
                got = attributions(model, bins, shares)
                ends = pa.array(np.arange(len(got) + 1, dtype=np.int32) * got.shape[1], pa.int32())
                rows = pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(got).ravel()))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], pa.array(model.raw(bins)), rows], names=[*keep, "raw", "attributions"])

    inputs = [F.col(c).cast("double" if k < len(model.numbers) else "string").alias(f"_{k}") for k, c in enumerate(model.columns)]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in others)
    return df.select(*keep, *inputs).mapInArrow(run, f"{schema}, raw double, attributions array<double>")


def mean_attributions(model: Model, df: DataFrame, key: str) -> DataFrame:
    """``feature, importance``: mean size of each split column's attribution."""
    names = split_columns(model)
    rows = attributed(model, df, [key]).select(F.posexplode("attributions").alias("i", "x"))
    named = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("i") + 1)
    return rows.groupBy("i").agg(F.avg(F.abs("x")).alias("importance")).select(named.alias("feature"), "importance")
