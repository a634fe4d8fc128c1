"""Mixing sources to target weights by a min-cost flow over membership patterns.

Documents are aggregated by the set of sources they belong to; only those sums (at most
MAX_PATTERNS rows) reach the driver. The flow routes each pattern's words to the quotas of its
sources, every further repetition at a higher cost. Seeded documents then fill each
pattern's flow, by hash thresholds that Spark finds from binned sums.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import save

#: Most distinct membership patterns; more raise an error, nothing is dropped. The flow of so many
#: patterns over 40 sources takes the driver about two seconds.
MAX_PATTERNS = 20_000
WORD = r"[^ \t-\r]+"
#: Leading hash bits that make a bin.
BIN_BITS = 12
HASH_BITS = 62


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def target_words(sizes: dict, weights: dict, share: float, repeats: float) -> dict:
    """share * all words by weight; a target stops at `repeats` times its source's size and
    the excess is shared again by weight among the others, until none is above."""
    total = sum(sizes.values()) * share
    fixed: dict = {}
    while True:
        free = [s for s in sizes if s not in fixed]
        left, weight = total - sum(fixed.values()), sum(weights[s] for s in free)
        now = {s: left * weights[s] / weight for s in free}
        over = [s for s in free if now[s] > repeats * sizes[s]]
        if not over:
            return fixed | now
        fixed |= {s: repeats * sizes[s] for s in over}


class Flow:
    """Maximum flow by blocking flows over shortest paths, on a graph of patterns and sources."""

    def __init__(self, n: int):
        self.out: list[list[int]] = [[] for _ in range(n)]
        self.to: list[int] = []
        self.cap: list[int] = []

    def add(self, a: int, b: int, cap: int) -> int:
        for u, v, c in ((a, b, cap), (b, a, 0)):
            self.out[u].append(len(self.to))
            self.to.append(v)
            self.cap.append(c)
        return len(self.to) - 2

    def flow(self, arc: int) -> int:
        return self.cap[arc ^ 1]

    def _levels(self, s: int, t: int) -> list[int]:
        level = [-1] * len(self.out)
        level[s], queue = 0, deque([s])
        while queue:
            u = queue.popleft()
            for e in self.out[u]:
                if self.cap[e] and level[self.to[e]] < 0:
                    level[self.to[e]] = level[u] + 1
                    queue.append(self.to[e])
        return level

    def augment(self, s: int, t: int) -> None:
        while True:
            level = self._levels(s, t)
            if level[t] < 0:
                return
            tried = [0] * len(self.out)
            path: list[int] = []
            while True:
                u = self.to[path[-1]] if path else s
                if u == t:
                    push = min(self.cap[e] for e in path)
                    for e in path:
                        self.cap[e] -= push
                        self.cap[e ^ 1] += push
                    path = path[: next(i for i, e in enumerate(path) if not self.cap[e])]
                    continue
                while tried[u] < len(self.out[u]):
                    e = self.out[u][tried[u]]
                    if self.cap[e] and level[self.to[e]] == level[u] + 1:
                        path.append(e)
                        break
                    tried[u] += 1
                else:
                    if not path:
                        break
                    tried[self.to[path.pop() ^ 1]] += 1


def route(patterns: dict[tuple, int], targets: dict, repeats: int) -> dict[tuple, int]:
    """Words taken of each pattern: the cheapest flow from patterns to source quotas, where
    the r-th repetition of a pattern's words costs r."""
    names, sources = list(patterns), list(targets)
    at = {s: 1 + len(names) + i for i, s in enumerate(sources)}
    sink = 1 + len(names) + len(sources)
    graph = Flow(sink + 1)
    for i, p in enumerate(names):
        for s in p:
            graph.add(1 + i, at[s], repeats * patterns[p])
    for s in sources:
        graph.add(at[s], sink, round(targets[s]))
    copies: dict[tuple, list[int]] = {p: [] for p in names}
    for _ in range(repeats):  # costs stand on the first arc of a path only, so cheaper repetitions are filled first
        for i, p in enumerate(names):
            copies[p].append(graph.add(0, 1 + i, patterns[p]))
        graph.augment(0, sink)
    return {p: sum(map(graph.flow, copies[p])) for p in names}


def _edges(bins: DataFrame, quota: DataFrame, before: DataFrame | None, bits: int) -> DataFrame:
    """(pattern, edge, before, rest): the bin of `bits` leading hash bits in which each pattern's running
    sum passes its quota, and the sum before it. `before` is that of the coarser bins."""
    rows = bins.withColumn("bin", F.shiftright("__u", HASH_BITS - bits))
    start = quota.select("__pattern", "rest", F.lit(0).cast("long").alias("before"))
    if before is not None:
        rows = _joined(rows, F.broadcast(before.select("__pattern", "edge"))).filter(F.shiftright("bin", BIN_BITS) == F.col("edge")).drop("edge")
        start = before.select("__pattern", "rest", "before")
    summed = _joined(rows.groupBy("__pattern", "bin").agg(F.sum("w").alias("w")), F.broadcast(start))  # 2**BIN_BITS bins to a pattern at most
    running = summed.withColumn("upto", F.col("before") + F.sum("w").over(Window.partitionBy("__pattern").orderBy("bin")))
    return running.filter("upto > rest").groupBy("__pattern").agg(F.min("bin").alias("edge"), F.min(F.col("upto") - F.col("w")).alias("before"), F.first("rest").alias("rest"))


def mix(
    documents: DataFrame, members: Column, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, repeats: int = 2, seed: int = 7, times: str = "times", size: str = "size"
) -> tuple[DataFrame, DataFrame]:
    """(documents with the columns `size` and `times`: how often the mix takes each, source totals).

    `members` is an array column of the sources of a document (null is a source too). Sources
    in code-point order, null last, have the given weights in turn. Size is the number of
    words. Each pattern's flow is filled with whole documents in the order of a seeded hash of id
    and text, then with the one document that brings it nearest to the flow; equal rows
    share their fate. No document is taken more than `repeats` times. Empty tables give none.
    Columns of the documents may have any names but those of `times` and `size`, and none in __.
    """
    spark = documents.sparkSession
    tagged = documents.withColumns({"__pattern": F.array_sort(F.array_distinct(members)), "__size": word_count(F.col("text")), "__u": F.shiftrightunsigned(F.xxhash64("doc_id", F.xxhash64("text"), F.lit(seed)), 64 - HASH_BITS)})
    sized = save(tagged.select("__pattern", "__size", "__u"), "sizes")
    sums = sized.groupBy("__pattern").agg(F.sum("__size").alias("n")).limit(MAX_PATTERNS + 1).collect()
    if len(sums) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    patterns = {tuple(r[0]): r[1] for r in sums}
    sources = sorted({s for p in patterns for s in p}, key=lambda s: (s is None, (s or "").encode()))
    sizes = {s: sum(n for p, n in patterns.items() if s in p) for s in sources}
    targets = target_words(sizes, {s: float(weights[i % len(weights)]) for i, s in enumerate(sources)}, share, repeats) if sources else {}
    taken = route(patterns, targets, repeats)
    plan = [(list(p), taken[p] // n if n else 0, taken[p] - n * (taken[p] // n) if n else 0) for p, n in patterns.items()]
    quota = F.broadcast(spark.createDataFrame(plan, "__pattern array<string>, full int, rest long"))

    bins = sized.groupBy("__pattern", "__u").agg(F.sum("__size").alias("w"))
    coarse = save(_edges(bins, quota, None, BIN_BITS), "edges")
    edge = save(_edges(bins, quota, coarse, 2 * BIN_BITS), "edges")  # at most MAX_PATTERNS rows, as all below
    within = _joined(bins, F.broadcast(edge)).filter(F.shiftright("__u", HASH_BITS - 2 * BIN_BITS) == F.col("edge"))
    running = within.withColumn("upto", F.col("before") + F.sum("w").over(Window.partitionBy("__pattern").orderBy("__u")))
    cut = running.groupBy("__pattern").agg(
        F.max(F.when(F.col("upto") <= F.col("rest"), F.col("__u"))).alias("cut"), F.max(F.when(F.col("upto") <= F.col("rest"), F.col("upto"))).alias("got"), F.first("edge").alias("edge"), F.first("before").alias("before"), F.first("rest").alias("rest")
    )
    last = cut.select("__pattern", F.coalesce("cut", F.shiftleft("edge", HASH_BITS - 2 * BIN_BITS) - 1).alias("cut"), (F.col("rest") - F.coalesce("got", "before")).alias("short"))
    last = save(last, "cuts")
    fitting = _joined(bins, F.broadcast(last)).filter("__u > cut AND w > 0 AND abs(w - short) < short").groupBy("__pattern").agg(F.min(F.struct(F.abs(F.col("w") - F.col("short")).alias("gap"), F.col("__u").alias("fit"))).alias("best"))
    decided = last.alias("l").join(F.broadcast(fitting).alias("f"), F.expr("l.__pattern <=> f.__pattern"), "left").selectExpr("l.__pattern", "cut", "f.best.fit AS fit")
    choice = save(quota.alias("q").join(decided.alias("d"), F.expr("q.__pattern <=> d.__pattern"), "left").selectExpr("q.__pattern", "full AS __full", "rest AS __rest", "cut AS __cut", "fit AS __fit"), "choice")
    more = F.when(F.col("__rest") == 0, 0).when((F.col("__u") <= F.col("__cut")) | F.coalesce(F.col("__u") == F.col("__fit"), F.lit(False)), 1).otherwise(0)
    out = _joined(tagged, F.broadcast(choice)).withColumn("__times", F.when(F.col("__size") > 0, F.col("__full") + F.coalesce(more, F.lit(0))).otherwise(0).cast("int"))
    totals = spark.createDataFrame([(s, sizes[s], float(targets[s])) for s in sources], "source string, source_size long, target double")
    return out.select(*[F.col(c) for c in documents.columns], F.col("__size").alias(size), F.col("__times").alias(times)), totals


def _joined(df: DataFrame, small: DataFrame) -> DataFrame:
    """Join on the membership pattern; the small side has at most MAX_PATTERNS rows."""
    s = small.withColumnRenamed("__pattern", "__p")
    return df.join(s, F.col("__pattern").eqNullSafe(F.col("__p"))).drop("__p")


def mix_documents(documents: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target (of the document's source) and taken (its words in the
    mix, repeats counted) for documents that each belong to one source."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("source").cast("string").alias("source"))
    chosen, totals = mix(docs, F.array("source"))
    t = F.broadcast(totals.withColumnRenamed("source", "__s"))
    out = chosen.join(t, F.col("source").eqNullSafe(F.col("__s")))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))
