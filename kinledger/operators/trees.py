"""Forests and boosted trees over rows that stay in their tasks: tasks exchange counts by bin, one job grows all trees."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Most bins of a feature, points that stand for one task's values of it, rows summed up at a time, trees grown side by side.
BINS, POINTS, HELD, TOGETHER = 64, 1024, 200_000, 4


def bin_edges(df: DataFrame, features: list[str]) -> list[list[float]]:
    """Bounds of each feature's bins over all rows; a feature of at most BINS values has a bin for each."""

    def summed(batches):
        import numpy as np
        import pyarrow as pa

        def pack(held):
            for i in range(len(features)):
                value, n = np.unique(np.concatenate([b[i] for b in held]), return_counts=True)
                upto = np.cumsum(n)
                if len(value) > POINTS:
                    at = np.unique(np.searchsorted(upto, np.linspace(0, upto[-1], POINTS + 1)[1:]))
                    value, upto = value[at], upto[at]
                yield pa.record_batch([pa.array(np.full(len(value), i, "int32")), pa.array(value, pa.float64()), pa.array(np.diff(upto, prepend=0).astype("float64"))], names=["feature", "value", "n"])

        held, rows = [], 0
        for b in batches:
            if b.num_rows:
                held.append([c.to_numpy(zero_copy_only=False).astype("float64") for c in b.columns])
                rows += b.num_rows
            if rows >= HELD:
                yield from pack(held)
                held, rows = [], 0
        if held:
            yield from pack(held)

    def merged(t):
        import numpy as np
        import pyarrow as pa

        value, where = np.unique(t.column("value").to_numpy(), return_inverse=True)
        upto = np.cumsum(np.bincount(where, t.column("n").to_numpy()))
        at = np.arange(len(value))
        if len(value) > BINS:
            at = np.unique(np.append(np.searchsorted(upto, np.linspace(0, upto[-1], BINS + 1)[1:]), len(value) - 1))
        at = at[:-1]  # bounds lie between neighbours
        return pa.table([pa.array([t.column("feature")[0].as_py()], pa.int32()), pa.array([((value[at] + value[at + 1]) / 2).tolist()], pa.list_(pa.float64()))], names=["feature", "edges"])

    points = df.select(*features).mapInArrow(summed, "feature int, value double, n double")
    found = {r.feature: r.edges for r in points.groupBy("feature").applyInArrow(merged, "feature int, edges array<double>").collect()}  # one row a feature
    return [found.get(i, []) for i in range(len(features))]


def binned(columns, edges):
    """(rows, features) bins of the columns' values; a value equal to a bound belongs below it."""
    import numpy as np

    return np.stack([np.searchsorted(np.asarray(e), np.asarray(c, "float64")).astype("uint8") for c, e in zip(columns, edges, strict=True)], axis=1)


def distinct_rows(bins, label):
    """(bins, n0, n1): each row once, with how often it has either label."""
    import numpy as np

    width = -(-bins.shape[1] // 8) * 8
    words = np.zeros((len(bins), width), "uint8")
    words[:, : bins.shape[1]] = bins
    words = words.view("uint64")
    order = np.lexsort(words.T)
    words, bins, label = words[order], bins[order], label[order]
    first = np.ones(len(bins), bool)
    first[1:] = (words[1:] != words[:-1]).any(axis=1)
    of = np.cumsum(first) - 1
    n = int(first.sum())
    return bins[first], np.bincount(of, label == 0, n).astype("float64"), np.bincount(of, label == 1, n).astype("float64")  # of no rows they are integers


def _forest(bins, n0, n1, total, part: int, seed: int, trees: int, depth: int, least: int):
    """Trees on Poisson draws of the rows; each node looks at the square root of the features, by Gini impurity."""
    import numpy as np

    n_features = bins.shape[1]
    m = int(np.ceil(np.sqrt(n_features)))

    def begin(t: int) -> dict:
        own = np.random.default_rng([seed, t, part])
        c0, c1 = own.poisson(n0), own.poisson(n1)
        rows = np.flatnonzero(c0 + c1)
        return {"rng": np.random.default_rng([seed, t]), "rows": rows, "c0": c0[rows].astype("float64"), "c1": c1[rows].astype("float64"), "at": np.zeros(len(rows), "int64"), "open": [0], "nodes": [[-1, -1, -1, -1, 0.0]]}

    def counts(s: dict):
        k = len(s["open"])
        s["of"] = np.argsort(s["rng"].random((k, n_features)), axis=1)[:, :m]
        out = np.zeros((2, k, m, BINS))
        for j in range(m):
            key = s["at"] * BINS + bins[s["rows"], s["of"][s["at"], j]]
            for i, c in enumerate(("c0", "c1")):
                out[i, :, j] = np.bincount(key, s[c], k * BINS).reshape(k, BINS)
        return out.astype("int32").ravel()

    def split(s: dict, seen, level: int) -> None:
        k, nodes = len(s["open"]), s["nodes"]
        left = np.cumsum(seen.reshape(2, k, m, BINS).astype("float64"), axis=3)
        both = left[:, :, :1, -1:]
        right = both - left
        nl, nr, n = left.sum(0), right.sum(0), both.sum(0)
        gain = (left**2).sum(0) / np.maximum(nl, 1) + (right**2).sum(0) / np.maximum(nr, 1) - (both**2).sum(0) / np.maximum(n, 1)
        gain[(nl < least) | (nr < least)] = 0
        gain = gain.reshape(k, m * BINS)
        best = gain.argmax(axis=1)
        feature, bound, following = np.zeros(k, "int64"), np.zeros(k, "int64"), np.full((k, 2), -1)
        found = []
        for i, node in enumerate(s["open"]):
            j, b = divmod(int(best[i]), BINS)
            if level == 0:
                nodes[node][4] = float(both[1, i, 0, 0] / max(n[i, 0, 0], 1))
            if gain[i, best[i]] <= 1e-9:
                continue
            feature[i], bound[i] = s["of"][i, j], b
            nodes[node][:4] = [int(feature[i]), b, len(nodes), len(nodes) + 1]
            for side, (a0, a1) in enumerate((left[:, i, j, b], right[:, i, j, b])):
                if level + 1 < depth and a0 and a1 and a0 + a1 >= 2 * least:
                    following[i, side] = len(found)
                    found.append(len(nodes))
                nodes.append([-1, -1, -1, -1, float(a1 / (a0 + a1))])
        at = following[s["at"], (bins[s["rows"], feature[s["at"]]] > bound[s["at"]]).astype("int64")]
        kept = at >= 0
        s.update(open=found, rows=s["rows"][kept], c0=s["c0"][kept], c1=s["c1"][kept], at=at[kept])

    done = []
    for first in range(0, trees, TOGETHER):
        some = [begin(t) for t in range(first, min(first + TOGETHER, trees))]
        for level in range(depth):
            growing = [s for s in some if s["open"]]
            if not growing:
                break
            own = [counts(s) for s in growing]
            seen = np.split(total(np.concatenate(own)), np.cumsum([len(x) for x in own])[:-1])
            for s, x in zip(growing, seen, strict=True):
                split(s, x, level)
        done += [s["nodes"] for s in some]
    return done


def _boosted(bins, n0, n1, total, rounds: int, depth: int, rate: float):
    """(base, trees) of logistic boosting: splits by squared error of the residuals, leaves by a Newton step."""
    import numpy as np

    columns, n = np.ascontiguousarray(bins.T), n0 + n1
    n_features, n_rows = columns.shape
    positive, negative = total(np.array([n1.sum(), n0.sum()]))
    base = float(np.log(max(positive, 1e-9) / max(negative, 1e-9)))
    z = np.full(n_rows, base)

    def counts(rows, at, k: int, g):
        """Residuals and rows by feature, node and bin, of the rows given (None: all)."""
        out = np.zeros((2, n_features, k, BINS))
        w, of = (g, n) if rows is None else (g[rows], n[rows])
        for f in range(n_features):
            key = columns[f] if rows is None else at * BINS + columns[f, rows]
            out[0, f] = np.bincount(key, w, k * BINS).reshape(k, BINS)
            if rows is not None:
                out[1, f] = np.bincount(key, of, k * BINS).reshape(k, BINS)
        return out

    plain = np.zeros((n_features, 1, BINS))
    for f in range(n_features):
        plain[f, 0] = np.bincount(columns[f], n, BINS)
    plain = total(plain.ravel()).reshape(plain.shape)
    done = []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-z))
        g, h = n1 - n * p, n * p * (1 - p)
        nodes, at, opened = [[-1, -1, -1, -1, 0.0]], np.zeros(n_rows, "int64"), [0]
        seen = total(counts(None, None, 1, g).ravel()).reshape(2, n_features, 1, BINS)
        seen[1] = plain
        for level in range(depth):
            left = np.cumsum(seen, axis=3)
            right = left[..., -1:] - left
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = left[1] * right[1] / (left[1] + right[1]) * (left[0] / left[1] - right[0] / right[1]) ** 2
            gain = np.where((left[1] < 0.5) | (right[1] < 0.5), 0, gain).transpose(1, 0, 2).reshape(len(opened), -1)
            best = gain.argmax(axis=1)
            # the counts of the smaller child are made, the other's are what is left of the parent's
            small, parents, found = np.full(len(nodes) + 2 * len(opened), -1), [], []
            for i, node in enumerate(opened):
                if gain[i, best[i]] <= 1e-12:
                    continue
                f, b = divmod(int(best[i]), BINS)
                nodes[node][:4] = [f, b, len(nodes), len(nodes) + 1]
                child = len(nodes) + int(right[1, f, i, b] < left[1, f, i, b])
                small[child] = len(parents)
                parents.append(i)
                found += [child, 2 * len(nodes) + 1 - child]
                nodes += [[-1, -1, -1, -1, 0.0], [-1, -1, -1, -1, 0.0]]
                mine = np.flatnonzero(at == node)
                at[mine] = nodes[node][2] + (columns[f, mine] > b)
            opened = found
            if not opened or level + 1 == depth:
                break
            of = small[at]
            rows = np.flatnonzero(of >= 0)
            less = total(counts(rows, of[rows], len(parents), g).ravel()).reshape(2, n_features, len(parents), BINS)
            more = seen[:, :, parents] - less
            seen = np.stack([less, more], axis=3).reshape(2, n_features, 2 * len(parents), BINS)
        k = len(nodes)
        sums = total(np.concatenate([np.bincount(at, g, k), np.bincount(at, h, k)]).astype("float64"))
        value = np.where(sums[k:] > 1e-12, sums[:k] / np.maximum(sums[k:], 1e-12), 0.0)
        for i, node in enumerate(nodes):
            node[4] = float(value[i])
        z += rate * value[at]
        done.append(nodes)
    return base, done


def summing(context):
    """Function array -> its sum over all tasks of a barrier, added in the order of the tasks, alike in all to the last bit.

    The tasks talk to the first one by sockets: Spark's own exchange of messages takes a second each time.
    """
    import secrets
    import socket

    import numpy as np

    part, addresses = context.partitionId(), [i.address for i in context.getTaskInfos()]
    server = socket.create_server(("", 0), backlog=len(addresses)) if part == 0 else None
    port, token = context.allGather(f"{server.getsockname()[1]} {secrets.token_hex(16)}" if server else "")[0].split()

    def opened(s: socket.socket):
        s.setsockopt(socket.IPPROTO_TCP, socket.TCP_NODELAY, 1)
        s.settimeout(None)
        return s.makefile("rwb")

    def told(f, size: int) -> bytes:
        data = f.read(size)
        if len(data) < size:
            raise EOFError("another task has ended")
        return data

    if server is None:
        first = opened(socket.create_connection((addresses[0].rsplit(":", 1)[0], int(port)), timeout=300))
        first.write(f"{token}{part:08d}".encode())
        first.flush()
        others = []
    else:
        server.settimeout(300)
        known: dict = {}
        while len(known) < len(addresses) - 1:
            f = opened(server.accept()[0])
            if told(f, 32).decode() == token:
                known[int(told(f, 8))] = f
        server.close()
        others = [known[i] for i in sorted(known)]

    def total(x):
        if part:
            first.write(x.tobytes())
            first.flush()
            return np.frombuffer(told(first, x.nbytes), x.dtype).copy()
        out = x.copy()
        for f in others:
            out += np.frombuffer(told(f, x.nbytes), x.dtype)
        for f in others:
            f.write(out.tobytes())
            f.flush()
        return out

    return total


def grow(train: DataFrame, features: list[str], label: str, seed: int, forest: dict, boosted: dict) -> dict[str, TreeModel]:
    """{"forest", "boosted"} fitted to all rows: ``forest`` has trees, depth and least rows of a leaf, ``boosted`` rounds, depth and rate.

    The rows lie in the workers as bins (a byte a feature), equal ones of a task once. All tasks run at the same time (a
    barrier) and add up their counts level by level; where executors come and go, which bars that, one task does it all.
    """
    sc = train.sparkSession.sparkContext
    edges = bin_edges(train, features)
    dynamic = sc.getConf().get("spark.dynamicAllocation.enabled", "false") == "true"
    jsc = sc._jsc.sc()
    tasks = 1 if dynamic else max(1, jsc.maxNumConcurrentTasks(jsc.resourceProfileManager().defaultResourceProfile()))

    def fit(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import BarrierTaskContext

        context = None if tasks == 1 else BarrierTaskContext.get()
        part = 0 if context is None else context.partitionId()
        held, labels = [np.zeros((0, len(features)), "uint8")], [np.zeros(0)]
        for b in batches:
            held.append(binned([b.column(i).to_numpy(zero_copy_only=False) for i in range(len(features))], edges))
            labels.append(b.column(len(features)).to_numpy(zero_copy_only=False).astype("float64"))
        bins, n0, n1 = distinct_rows(np.concatenate(held), np.concatenate(labels))
        del held, labels
        total = (lambda x: x) if context is None else summing(context)
        made = [("forest", 0.0, t) for t in _forest(bins, n0, n1, total, part, seed, **forest)]
        base, trees = _boosted(bins, n0, n1, total, **boosted)
        made += [("boosted", base, t) for t in trees]
        if part == 0:
            yield pa.record_batch([pa.array([k for k, _, _ in made]), pa.array(range(len(made)), pa.int32()), pa.array([b for _, b, _ in made], pa.float64()), pa.array([json.dumps(t) for *_, t in made])], names=["kind", "i", "base", "nodes"])

    import json

    rows = train.select(*[F.col(f).cast("double") for f in features], F.col(label).cast("double")).repartition(tasks, *features)
    made = sorted(rows.mapInArrow(fit, "kind string, i int, base double, nodes string", barrier=tasks > 1).collect(), key=lambda r: r.i)
    trees = {k: [json.loads(r.nodes) for r in made if r.kind == k] for k in ("forest", "boosted")}
    base = next((r.base for r in made if r.kind == "boosted"), 0.0)
    return {"forest": TreeModel(features, edges, trees["forest"]), "boosted": TreeModel(features, edges, trees["boosted"], base, boosted["rate"])}


@dataclass
class TreeModel:
    """Trees as lists of [feature, bin, left, right, value]; without ``rate`` their mean counts, with it their logistic sum."""

    features: list[str]
    edges: list[list[float]]
    trees: list[list]
    base: float = 0.0
    rate: float | None = None

    def plain(self) -> list[dict]:
        """Trees as :func:`kinledger.operators.model.tree_score` takes them."""

        def node(t: list, i: int) -> dict:
            f, b, left, right, value = t[i]
            return {"value": value} if f < 0 else {"feature": self.features[f], "threshold": self.edges[f][b], "left": node(t, left), "right": node(t, right)}

        return [node(t, 0) for t in self.trees]

    def probability(self) -> Column:
        """Probability of class 1, in Arrow batches."""
        import numpy as np

        edges, base, rate = self.edges, self.base, self.rate
        packed = [tuple(np.array(c) for c in zip(*t, strict=True)) for t in self.trees]

        @F.pandas_udf(T.DoubleType())
        def p(*columns: pd.Series) -> pd.Series:
            bins = binned([c.to_numpy() for c in columns], edges)
            z = np.zeros(len(bins))
            every = np.arange(len(bins))
            for feature, bound, left, right, value in packed:
                at, rows = np.zeros(len(bins), "int64"), every
                while len(rows):
                    here = at[rows]
                    rows = rows[feature[here] >= 0]
                    here = at[rows]
                    at[rows] = np.where(bins[rows, feature[here]] <= bound[here], left[here], right[here])
                z += value[at]
            return pd.Series(z / max(len(packed), 1) if rate is None else 1 / (1 + np.exp(-(base + rate * z))))

        return p(*[F.col(f).cast("double") for f in self.features])
