"""Hard-negative mining with cover trees over norm-augmented candidates.

Components are scaled to whole numbers, so scores are exact inner products. A
candidate x of norm at most M gets one more component, sqrt(M^2 - |x|^2): all
lie on a sphere then, and with a 0 there for the anchor no inner product
changes. If every descendant of a node lies within its covering radius r of its
centre c, their scores with an anchor a lie in a.c +- |a| r.

1. Candidates are dealt into shards of about ``SHARD``; each becomes a cover
   tree: a level's centres are further apart than its radius, which shrinks by
   ``SCALE`` from level to level, and cover what is below them. A node keeps the
   radius that its descendants really take up. Where a level would leave single
   candidates only, they are gathered in leaves.
2. A shard meets a block of anchors per task. An anchor descends best first:
   the open nodes with the highest bounds are opened, leaves are verified
   exactly, and nodes whose bounds lie outside all of the anchor's windows, or
   below the worst score that a window still admits, are skipped. All anchors
   of a block take a step together: those that open the same leaf are scored
   against it in one matrix product. An anchor opens twice as many nodes in
   each step as in the one before.
3. The best of all shards are the answer. First every anchor looks for its
   positives, the window being open; their scores give the windows in which it
   then looks for its negatives, all windows in one descent.

Rows without an id or a label, without a vector, or with a null, NaN or infinite
component take no part. A shorter vector is filled with 0. Rows of the anchor's
own id are not its candidates; other rows count as often as they occur, so a
repeated row can fill several places. An id that is an anchor more than once is
asked once, with its least label and vector. Higher scores come first, ties by
smaller id. Anchors without a positive or without a row in a window have no
rows. Columns other than vec_id, embedding and label play no part.
"""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mealgrid.operators.dedup import top_k
from mealgrid.session import stage

# Fixed values of the task.
EVERY = 50
POSITIVES = 5
NEGATIVES = 3
LOW, HIGH = 50, 95
# Candidates of a shard, anchors of a block, candidates of a leaf, ratio of radii, nodes that an anchor opens first.
SHARD = 4096
BLOCK = 512
LEAF = 32
SCALE = 1.3
OPENED = 8


def taking_part(vectors: DataFrame) -> DataFrame:
    """``id``, ``label`` and whole-number components ``x`` of the rows that take part."""
    rows = vectors.select(
        F.col("vec_id").cast("bigint").alias("id"), F.col("label").cast("bigint").alias("label"), F.col("embedding").cast("array<double>").alias("x")
    )
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    rows = rows.where("id is not null and label is not null and x is not null").where(F.forall("x", finite))
    label = F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    # Plain ``floor`` gives a long, which large components leave; whole doubles keep their value.
    return rows.select("id", label.alias("label"), F.transform("x", _whole).alias("x"))


def _whole(c: Column) -> Column:
    scaled = c * 256.0
    return F.when(F.abs(scaled) < float(1 << 52), F.floor(scaled).cast("double")).otherwise(scaled)


def _matrix(vectors, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of ``a`` with all of ``b``, exact: as doubles while all partial sums fit, else as Python integers."""
    if a.size and b.size and np.abs(a).max() * np.abs(b).max() * a.shape[-1] >= 2.0**53:
        whole = np.frompyfunc(int, 1, 1)
        return whole(a) @ whole(b).T
    return a @ b.T


class CoverTree:
    """Nodes with centre, radius and first child; leaves hold a run of candidates. All are plain arrays."""

    NAMES = ("ids", "labels", "points", "centres", "radii", "first", "last", "leaf")

    def __init__(self, **arrays: np.ndarray):
        self.__dict__.update(arrays)

    @classmethod
    def of(cls, ids: np.ndarray, labels: np.ndarray, points: np.ndarray, leaf: int = LEAF, scale: float = SCALE) -> "CoverTree":
        norms = (points**2).sum(axis=1)
        # One more component puts all candidates on a sphere, where distance and inner product go together.
        top = float(norms.max(initial=0.0))
        lifted = np.column_stack([points, np.sqrt(np.maximum(top - norms, 0.0))])
        # Distances come from inner products; nearer ones than this are rounding.
        least = 1e-6 * np.sqrt(top)
        order: list[np.ndarray] = []
        nodes: list[list] = []
        placed = 0

        def away(rows: np.ndarray, centre: int) -> np.ndarray:
            return np.sqrt(np.maximum(2 * (top - lifted[rows] @ lifted[centre]), 0.0)) + least

        # (rows, centre, distances to it): children of a node are made together, so they lie side by side.
        everything = np.arange(len(ids))
        queue = [(everything, 0, away(everything, 0))] if len(ids) else []
        nodes += [None] * len(queue)
        at = 0
        while at < len(queue):
            rows, centre, far = queue[at]
            radius = float(far.max(initial=0.0))
            if len(rows) <= leaf or radius <= 2 * least:
                nodes[at] = [centre, radius, placed, placed + len(rows), True]
                order.append(rows)
                placed += len(rows)
                at += 1
                continue
            children, single, level = [], [], radius / scale
            rest, rest_far, pick = rows, far, centre
            while len(rest):
                near = away(rest, pick) if pick != centre else rest_far
                inside = near <= level
                # The centre covers itself, whatever rounding says.
                inside[0] |= pick == rest[0]
                if inside.sum() > 1:
                    children.append((rest[inside], pick, near[inside]))
                else:
                    single.append(rest[inside])
                rest, rest_far = rest[~inside], rest_far[~inside]
                if len(rest):
                    pick = int(rest[0])
            # Centres that cover nobody else: the nearest to each other share leaves.
            alone = np.concatenate(single) if single else rows[:0]
            while len(alone):
                d = away(alone, int(alone[0]))
                close = np.argsort(d, kind="stable")[:leaf]
                children.append((alone[close], int(alone[0]), d[close]))
                alone = np.delete(alone, close)
            nodes[at] = [centre, radius, len(queue), len(queue) + len(children), False]
            queue += children
            nodes += [None] * len(children)
            at += 1
        rows = np.concatenate(order) if order else everything
        centre, radius, first, last, is_leaf = (np.array(x) for x in zip(*nodes)) if nodes else (np.zeros(0, "int64"),) * 5
        return cls(
            ids=ids[rows], labels=labels[rows], points=points[rows], centres=points[centre], radii=radius.astype(float),
            first=first.astype("int64"), last=last.astype("int64"), leaf=is_leaf.astype(bool),
        )

    def packed(self) -> bytes:
        head = np.array([*self.points.shape, len(self.radii)], "int64").tobytes()
        return head + b"".join(np.ascontiguousarray(getattr(self, n)).tobytes() for n in self.NAMES)

    @classmethod
    def unpacked(cls, data: bytes) -> "CoverTree":
        n, d, m = np.frombuffer(data, "int64", 3).tolist()
        kinds = (("int64", (n,)), ("int64", (n,)), ("float64", (n, d)), ("float64", (m, d)), ("float64", (m,)), ("int64", (m,)), ("int64", (m,)), ("bool", (m,)))
        at, arrays = 24, {}
        for name, (kind, shape) in zip(cls.NAMES, kinds):
            arrays[name] = np.frombuffer(data, kind, int(np.prod(shape)), at).reshape(shape)
            at += arrays[name].nbytes
        return cls(**arrays)

    def search(self, own: np.ndarray, label: np.ndarray, asked: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same: bool) -> tuple:
        """(anchor, window, id, score) of the first k per window, and how many candidates were verified.

        ``low`` and ``high`` have a row per anchor and a column per window; a
        window without values is empty.
        """
        n, windows = low.shape
        kept = [np.zeros(0, "int64"), np.zeros(0, "int64"), np.zeros(0, "int64")]
        worst = np.where(low <= high, low, np.inf)
        length = np.sqrt((asked**2).sum(axis=1))
        verified, width = 0, OPENED
        anchor = np.arange(n if len(self.radii) else 0)
        node = np.zeros(len(anchor), "int64")

        def bounds(a: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            middle = np.einsum("ij,ij->i", asked[a], self.centres[v])
            reach = length[a] * self.radii[v]
            slack = 1e-9 * (np.abs(middle) + reach) + 1e-6
            return middle - reach - slack, middle + reach + slack

        least, most = bounds(anchor, node)
        while len(anchor):
            # Windows that a node may still serve: it reaches above their worst score and below their end.
            use = ((most[:, None] >= worst[anchor]) & (least[:, None] <= high[anchor])).any(axis=1)
            anchor, node, least, most = anchor[use], node[use], least[use], most[use]
            if not len(anchor):
                break
            order = np.lexsort((-most, anchor))
            anchor, node, least, most = anchor[order], node[order], least[order], most[order]
            first = np.concatenate([[True], anchor[1:] != anchor[:-1]])
            place = np.arange(len(anchor)) - np.maximum.accumulate(np.where(first, np.arange(len(anchor)), 0))
            best = place < width
            width *= 2
            opened, into = anchor[best], node[best]
            anchor, node, least, most = anchor[~best], node[~best], least[~best], most[~best]
            ends = self.leaf[into]
            found, some = self._verify(opened[ends], into[ends], own, label, asked, high, worst, same)
            verified += some
            kept, worst = self._cut([np.concatenate(x) for x in zip(kept, *found)], worst, windows, k)
            a, v = opened[~ends], into[~ends]
            sizes = self.last[v] - self.first[v]
            a = np.repeat(a, sizes)
            v = np.repeat(self.first[v] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            low_of, high_of = bounds(a, v)
            anchor, node = np.concatenate([anchor, a]), np.concatenate([node, v])
            least, most = np.concatenate([least, low_of]), np.concatenate([most, high_of])
        return kept[0] // windows, kept[0] % windows, kept[1], kept[2], verified

    def _verify(self, a, v, own, label, asked, high, worst, same) -> tuple[list, int]:
        """(slot, id, score) of what each leaf has for the windows of the anchors that open it, and the pairs scored."""
        order = np.argsort(v, kind="stable")
        a, v = a[order], v[order]
        leaves, begin = np.unique(v, return_index=True)
        windows, found, pairs = worst.shape[1], [], 0
        least, most = worst.min(axis=1), high.max(axis=1)
        for leaf, who in zip(leaves.tolist(), np.split(a, begin[1:])):
            # Leaves of equal points may be longer than others; they are scored in pieces.
            for s in range(int(self.first[leaf]), int(self.last[leaf]), BLOCK):
                run = slice(s, min(s + BLOCK, int(self.last[leaf])))
                score, ids = scores(asked[who], self.points[run]), self.ids[run]
                alike = self.labels[run] == label[who][:, None]
                there = (alike if same else ~alike) & (ids != own[who][:, None])
                # First by all windows of an anchor together, then what is left by each.
                i, j = np.nonzero(there & (score >= least[who][:, None]) & (score <= most[who][:, None]))
                if len(i):
                    of, s_ij = who[i], score[i, j]
                    x, w = np.nonzero((s_ij[:, None] >= worst[of]) & (s_ij[:, None] <= high[of]))
                    found.append((of[x] * windows + w, ids[j[x]], s_ij[x].astype("int64")))
                pairs += score.size
        return found, pairs

    @staticmethod
    def _cut(kept: list, worst: np.ndarray, windows: int, k: int) -> tuple[list, np.ndarray]:
        """The first k of each window; a full window admits nothing below its last score."""
        slot, ids, score = kept
        order = np.lexsort((ids, -score, slot))
        slot, ids, score = slot[order], ids[order], score[order]
        first = np.concatenate([[True], slot[1:] != slot[:-1]]) if len(slot) else np.zeros(0, bool)
        place = np.arange(len(slot)) - np.maximum.accumulate(np.where(first, np.arange(len(slot)), 0))
        full = place == k - 1
        worst = worst.copy()
        worst[slot[full] // windows, slot[full] % windows] = score[full]
        use = place < k
        return [slot[use], ids[use], score[use]], worst


def trees(rows: DataFrame, shard: int = SHARD) -> DataFrame:
    """``shard``, ``tree``: cover trees of all rows that take part, written."""
    shards = max(1, -(-rows.count() // shard))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(shards)).cast("int"))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        points = _matrix(pdf["x"], max(map(len, pdf["x"])))
        tree = CoverTree.of(pdf["id"].to_numpy("int64"), pdf["label"].to_numpy("int64"), points)
        return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "tree": [tree.packed()]})

    return stage(dealt.groupBy("shard").applyInPandas(build, "shard int, tree binary"), "trees")


FOUND = "anchor_id bigint, item int, found_id bigint, score bigint, verified bigint"


def searched(grown: DataFrame, asked: DataFrame, k: int, same: bool, block: int = BLOCK) -> DataFrame:
    """The first k in each window of each anchor, per shard, and the candidates verified for its block.

    ``asked`` has ``id``, ``label``, ``x`` and ``windows``, an array of
    structs ``low``, ``high``. Blocks and trees are of bounded size, and a pair
    of them is a task's group.
    """
    blocks = max(1, -(-asked.count() // block))
    number = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = grown.withColumn("block", number(blocks))
    shards = (grown.agg(F.max("shard").alias("s")).first()["s"] or 0) + 1
    dealt = asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    gathered = stage(dealt.groupBy("block").agg(F.collect_list(F.struct("id", "label", "x", "windows")).alias("asked")), "asked")
    right = gathered.withColumn("shard", number(shards))

    def run(tree: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
        names = ["anchor_id", "item", "found_id", "score", "verified"]
        if not len(tree) or not len(anchors):
            return pd.DataFrame(columns=names)
        held = CoverTree.unpacked(bytes(tree["tree"].iloc[0]))
        rows = list(anchors["asked"].iloc[0])
        width = held.points.shape[1]
        points = _matrix([r["x"][:width] for r in rows], width)
        most = max(len(r["windows"]) for r in rows)
        low, high = np.full((len(rows), most), np.inf), np.full((len(rows), most), -np.inf)
        for i, r in enumerate(rows):
            for w, window in enumerate(r["windows"]):
                low[i, w], high[i, w] = window["low"], window["high"]
        own, label = (np.array([r[n] for r in rows], "int64") for n in ("id", "label"))
        a, w, ids, score, verified = held.search(own, label, points, low, high, k, same)
        return pd.DataFrame(dict(zip(names, (own[a], w, ids, score, verified))))

    return left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInPandas(run, FOUND)


def _first(found: DataFrame, k: int) -> DataFrame:
    return top_k(found, ["anchor_id", "item"], [F.col("score").desc(), F.col("found_id")], k, "rank")


def mined(vectors: DataFrame, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """For each anchor and positive, the first negatives whose scores lie in the positive's window."""
    rows = stage(taking_part(vectors), "vectors")
    grown = trees(rows, shard)
    one = F.min(F.struct("label", "x")).alias("one")
    asked = stage(rows.where(F.col("id") % every == 0).groupBy("id").agg(one).select("id", "one.*"), "anchors")
    window = lambda low, high: F.struct(low.cast("double").alias("low"), high.cast("double").alias("high"))
    any_score = F.array(window(F.lit("-Infinity"), F.lit("Infinity")))
    near = stage(_first(searched(grown, asked.withColumn("windows", any_score), positives, True, block), positives), "positives")
    near = near.select("anchor_id", F.col("found_id").alias("positive_id"), F.col("score").alias("positive_score"), (F.col("rank") - 1).alias("item"))
    # The contract's comparison in whole numbers: 100 s at least LOW and at most HIGH times the positive's score.
    part = lambda percent: F.col("positive_score").cast("decimal(20,0)") * F.lit(percent).cast("decimal(3,0)") / F.lit(100).cast("decimal(3,0)")
    least, most = F.ceil(part(LOW)), F.floor(part(HIGH))
    windows = near.select("anchor_id", F.struct("item", window(least, most).alias("w")).alias("one")).groupBy("anchor_id")
    windows = windows.agg(F.transform(F.array_sort(F.collect_list("one")), lambda x: x["w"]).alias("windows"))
    hard = asked.join(windows.withColumnRenamed("anchor_id", "id"), "id")
    hard = _first(searched(grown, stage(hard, "windows"), negatives, False, block), negatives)
    out = hard.join(near, ["anchor_id", "item"])
    return out.select("anchor_id", "positive_id", "rank", F.col("found_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
