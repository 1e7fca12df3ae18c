"""Mixing sources to target weights: min-cost flow over membership patterns.

Documents are aggregated by membership pattern (the set of sources they belong to). Patterns supply token capacity once per
repetition, sources demand their quotas, and repeating costs the more the oftener (convex), so the flow takes fresh text first and
spreads repeats. The graph has a node a pattern and a node a source, however many documents there are. Each pattern's flow to a source
is then turned into documents, in the order of a seeded hash: a document is taken ``r`` times while its turn is within what the
flow takes ``r`` times. Turns are exact running sums, in two levels, so no task holds more than one narrow slice of the order.

Cases: a null text is of size 0 and takes part with 0 words; a null source is a source of its own, last in order; repeated rows are
documents of their own with the same turn, taken or left together; an empty table gives an empty result; further columns are kept by
``mix`` (its own are prefixed) and ignored by ``mix_sizes``; a very long text is taken whole or left, so a source may miss its target by half of it.
"""

from __future__ import annotations

import heapq
import json
import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quireworks.llm.common import hinted, save, words

SEED = 20_11


def targets(sizes: dict[str | None, int], weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> dict[str | None, float]:
    """Quota a source: ``share`` of all sizes by weight (repeating, over the sources by code point, null last).

    A quota stops at ``most`` times its source's size; the excess is shared again by weight among the others until none is above.
    """
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    quota = {s: share * sum(sizes.values()) * weight[s] / sum(weight.values()) for s in order}
    open_ = set(order)
    while full := [s for s in order if s in open_ and quota[s] > most * sizes[s]]:
        excess = sum(quota[s] - most * sizes[s] for s in full)
        for s in full:
            quota[s] = most * sizes[s]
        open_ -= set(full)
        total = sum(weight[s] for s in order if s in open_)
        if not total:
            break
        for s in order:
            if s in open_:
                quota[s] += excess * weight[s] / total
    return {s: float(quota[s]) for s in order}


def _parts(capacity: dict[tuple, int], quota: dict) -> list[dict[tuple, int]]:
    """Patterns that share sources, directly or through others, together."""
    leader: dict = {}

    def find(s):
        while leader[s] != s:
            leader[s] = leader[leader[s]]
            s = leader[s]
        return s

    held = {p: [s for s in p if s in quota] for p in capacity}
    for sources in held.values():
        for s in sources:
            leader.setdefault(s, s)
            leader[find(s)] = find(sources[0])
    parts: dict = defaultdict(dict)
    for p, sources in held.items():
        parts[("of", find(sources[0])) if sources else ("alone", p)][p] = capacity[p]
    return list(parts.values())


def route(capacity: dict[tuple, int], quota: dict, most: int) -> dict[tuple, dict]:
    """Min-cost flow from patterns (capacity a repetition) to their sources (quota): units by pattern and source.

    The ``r``-th repetition of a pattern costs ``r ** 2``. Patterns without common sources don't compete, so each such part is routed by itself; a pattern with one source
    that no other has fills its quota as far as it can.
    """
    out: dict[tuple, dict] = {}
    for part in _parts(capacity, quota):
        sources = {s: quota[s] for p in part for s in p if s in quota}
        if len(part) == 1 and len(sources) <= 1:
            out |= {p: {s: min(round(q), most * n) for s, q in sources.items()} for p, n in part.items()}
        else:
            out |= _route_part(part, sources, most)
    return out


def _route_part(capacity: dict[tuple, int], quota: dict, most: int) -> dict[tuple, dict]:
    """Successive shortest paths with potentials, on the aggregated graph only."""
    patterns, sources = sorted(capacity, key=repr), sorted(quota, key=repr)
    number = {("p", p): i + 1 for i, p in enumerate(patterns)} | {("s", s): len(patterns) + 1 + i for i, s in enumerate(sources)}
    end = len(number) + 1
    edges: list[list] = []  # to, left, cost
    leaving = defaultdict(list)

    def edge(a: int, b: int, room: int, cost: int) -> int:
        edges.extend(([b, room, cost], [a, 0, -cost]))
        leaving[a].append(len(edges) - 2)
        leaving[b].append(len(edges) - 1)
        return len(edges) - 2

    for p in patterns:
        for r in range(most):
            edge(0, number["p", p], capacity[p], r * r)
    between = {(p, s): edge(number["p", p], number["s", s], most * capacity[p], 0) for p in patterns for s in p if s in quota}
    for s in sources:
        edge(number["s", s], end, round(quota[s]), 0)
    potential = [0] * (end + 1)
    while True:
        far = [math.inf] * (end + 1)
        far[0], via, queue = 0, {}, [(0, 0)]
        while queue:
            d, a = heapq.heappop(queue)
            if d > far[a]:
                continue
            for k in leaving[a]:
                b, room, cost = edges[k]
                if room and d + cost + potential[a] - potential[b] < far[b]:
                    far[b], via[b] = d + cost + potential[a] - potential[b], k
                    heapq.heappush(queue, (far[b], b))
        if far[end] == math.inf:
            break
        potential = [x + f if f < math.inf else x for x, f in zip(potential, far, strict=True)]
        path, at = [], end
        while at:
            path.append(via[at])
            at = edges[via[at] ^ 1][0]
        units = min(edges[k][1] for k in path)
        for k in path:
            edges[k][1] -= units
            edges[k ^ 1][1] += units
    return {p: {s: edges[between[p, s] ^ 1][1] for s in p if (p, s) in between} for p in patterns}


def size_of(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def turn_of(doc_id: Column, seed: int = SEED) -> Column:
    """A document's place in the seeded order, from 0 to 2**40 - 1."""
    return F.shiftrightunsigned(F.xxhash64(doc_id, F.lit(seed)), 24)


def pattern_of(sources: Column) -> Column:
    """A set of sources as one string; null sources are told from empty ones."""
    return F.to_json(F.struct(F.array_sort(F.array_distinct(F.transform(sources, lambda s: F.coalesce(F.concat(F.lit("="), s), F.lit("~null"))))).alias("p")))


def _source_name(marked: str) -> str | None:
    return None if marked == "~null" else marked[1:]


def _cuts(sized: DataFrame, amounts: DataFrame, n_amounts: int, slices: int) -> DataFrame:
    """For each pattern and amount the last turn of those documents, in order, whose running size comes nearest to the amount.

    sized: pattern, turn, doc_id, size. amounts: pattern, amount. The order is cut into ``slices`` even parts of the hash: sums by
    part find the part, and the documents of that part alone find the turn.
    """
    width = (1 << 40) // slices
    part = F.floor(F.col("turn") / width)
    by_part = sized.groupBy("pattern", part.alias("part")).agg(F.sum("size").alias("n"))
    order = Window.partitionBy("pattern").orderBy("part")
    by_part = by_part.withColumn("before", F.sum("n").over(order) - F.col("n"))
    hit = by_part.join(amounts, "pattern").where("amount > before AND amount <= before + n").select("pattern", "part", "before", "amount")
    # only the documents of the parts that hold a cut
    inside = sized.withColumn("part", part).join(hinted(hit, n_amounts), ["pattern", "part"])
    turns = inside.groupBy("pattern", "amount", "before", "turn").agg(F.sum("size").alias("n"))
    order = Window.partitionBy("pattern", "amount").orderBy("turn")
    turns = turns.withColumn("upto", F.col("before") + F.sum("n").over(order))
    near = F.struct(F.abs(F.col("upto") - F.col("amount")).alias("off"), F.col("turn"))
    best = turns.groupBy("pattern", "amount").agg(F.min(near).alias("b"), F.min(F.struct("turn", "upto", "n")).alias("first"))
    # before the part's first document may be nearer still
    return best.select("pattern", "amount", F.when(F.col("amount") - (F.col("first.upto") - F.col("first.n")) < F.col("b.off"), F.col("first.turn") - 1).otherwise(F.col("b.turn")).alias("cut"))


def plan_mix(sized: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, slices: int = 4096) -> tuple[DataFrame, dict, dict]:
    """From sized (pattern, turn, doc_id, size): a small table (pattern, full, cut, routes), sizes and quotas by source.

    A document is taken ``full`` times, and once more if its turn is at most ``cut``; it fills the quota of the first of ``routes``
    whose cut its turn is within. The driver sees one row a pattern.
    """
    spark = sized.sparkSession
    rows = sized.groupBy("pattern").agg(F.sum("size").alias("n")).collect()
    members = {r["pattern"]: tuple(map(_source_name, json.loads(r["pattern"])["p"])) for r in rows}
    capacity: dict[tuple, int] = {members[r["pattern"]]: r["n"] for r in rows}
    sizes: dict = defaultdict(int)
    for p, n in capacity.items():
        for s in p:
            sizes[s] += n
    quota = targets(dict(sizes), weights, share, float(most))
    flow = route(capacity, quota, most)
    full: list[tuple] = []
    routes: list[tuple] = []
    for r in rows:
        n, to = r["n"], [(s, k) for s, k in sorted(flow[members[r["pattern"]]].items(), key=lambda x: (x[0] is None, x[0] or "")) if k]
        taken = sum(k for _, k in to)
        times_all = taken // n if n else 0
        rest = taken - times_all * n
        full.append((r["pattern"], int(times_all), int(rest)))
        # a source's stretch of the order: up to where the words taken reach its part of the flow
        upto = 0
        for place, (s, k) in enumerate(to):
            upto += k
            more = min(upto, (times_all + 1) * rest)
            at = more // (times_all + 1) + ((upto - more) // times_all if times_all else 0)
            routes.append((r["pattern"], place, s, None if place == len(to) - 1 else int(at)))
    wanted = {(p, k) for p, _, k in full if k} | {(p, k) for p, _, _, k in routes if k}
    cuts = save(_cuts(sized, spark.createDataFrame(sorted(wanted), "pattern string, amount bigint"), len(wanted), slices))
    once_more = cuts.withColumnRenamed("amount", "rest")
    plan = spark.createDataFrame(full, "pattern string, full bigint, rest bigint").join(once_more, ["pattern", "rest"], "left").select("pattern", "full", F.coalesce("cut", F.lit(-1)).alias("cut"))
    stretch = spark.createDataFrame(routes, "pattern string, place int, source string, amount bigint").join(cuts, ["pattern", "amount"], "left")
    last = F.when(F.col("amount").isNull(), F.lit(1 << 40)).otherwise(F.coalesce("cut", F.lit(-1)))
    by_pattern = stretch.groupBy("pattern").agg(F.sort_array(F.collect_list(F.struct("place", last.alias("cut"), "source"))).alias("routes"))
    return plan.join(by_pattern, "pattern", "left"), dict(sizes), quota


def times(turn: Column) -> Column:
    return (F.col("full") + (turn <= F.col("cut")).cast("int")).cast("long")


def mix_sizes(sized: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """doc_id, size, source_size, target, taken, source and quota_source for sized: doc_id, source, sources (array), size.

    ``sources`` are all sources a document belongs to, ``source`` the one it's reported under, ``quota_source`` the one whose quota the
    flow lets it fill (null source or not taken: null).
    """
    spark = sized.sparkSession
    keyed = sized.select("doc_id", "source", "size", turn_of(F.col("doc_id")).alias("turn"), pattern_of(F.col("sources")).alias("pattern"))
    plan, sizes, quota = plan_mix(keyed, weights, share, most)
    own = spark.createDataFrame([(s, int(sizes[s]), quota[s]) for s in sizes] or [(None, 0, 0.0)], "name string, source_size bigint, target double")
    # plan has a row a pattern, own a row a source
    plan = save(plan)
    found = keyed.join(hinted(plan, plan.count()), "pattern").join(hinted(own, len(sizes)), F.col("source").eqNullSafe(F.col("name")))
    return found.select("doc_id", "size", "source_size", "target", (F.col("size") * times(F.col("turn"))).alias("taken"), "source", F.when(times(F.col("turn")) > 0, F.get(F.filter("routes", lambda r: F.col("turn") <= r["cut"]), F.lit(0))["source"]).alias("quota_source"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """``docs`` as the mix takes them: rows left out are gone, rows taken twice come twice; columns as they were."""
    keyed = docs.select("*", turn_of(F.col("doc_id")).alias("__qw_turn"), pattern_of(F.array("source")).alias("__qw_pattern"))
    sized = keyed.select(F.col("__qw_pattern").alias("pattern"), F.col("__qw_turn").alias("turn"), "doc_id", size_of(F.col("text")).alias("size"))
    plan, _, _ = plan_mix(save(sized), weights, share, most)
    plan = save(plan.select(F.col("pattern").alias("__qw_pattern"), F.col("full").alias("__qw_full"), F.col("cut").alias("__qw_cut")))
    n = (F.col("__qw_full") + (F.col("__qw_turn") <= F.col("__qw_cut")).cast("int")).cast("int")
    taken = keyed.join(hinted(plan, plan.count()), "__qw_pattern").withColumn("__qw_times", n).where("__qw_times > 0")
    return taken.withColumn("__qw_copy", F.explode(F.sequence(F.lit(1), F.col("__qw_times")))).select(*docs.columns)
