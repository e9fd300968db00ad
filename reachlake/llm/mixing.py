"""Mixing sources to target weights (operator 7): min-cost flow over membership patterns.

1. Documents are measured (words) and aggregated by membership pattern, the sorted set of sources they belong
   to. The driver gets one row a pattern, at most `max_patterns` (checked, default 10,000).
2. Targets: the total is `share` times all words, split by weight; a source's target stops at `repeat` times its
   own words and the excess goes to the others by weight until none is above.
3. Token capacity is routed from patterns to source quotas by a min-cost flow. A pattern's first use of its
   words costs nothing, each further repetition costs more (convex), up to `repeat` uses in all, so
   repetition is spent only where quotas can't be met with fresh words.
4. A pattern's routed words are one sequence: passes over its documents in seeded hash order, the last one in part. Its sources
   own consecutive segments of it, in the order of the pattern. Cumulative words over 4,096 hash ranges a pattern
   find the range where each segment ends; only the documents of such ranges are ordered one by one, all
   others are placed by comparing ranges. The words taken for a (pattern, source) are thus the routed words
   exactly, a document may be cut between two sources, and a pattern with a third of all rows is never sorted whole.

Null text has size 0. A null source is a source of its own, last in order. A document with no source (null or empty
membership) is not mixed: it takes 0 words, has no target and does not count in the total; repeated members count once.
Documents of several sources count once in the total and once in each source's size. Ties in the hash go by doc_id,
then by a hash of the text; identical rows share alike. Empty input gives no rows. Extra columns are not read.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, SPACE_RE, keep

WEIGHTS = (3, 1, 2)
SHARE, REPEAT, RANGES = 1.5, 2, 4096


def n_words(text: Column) -> Column:
    t = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(t == "", 0).otherwise(F.size(F.split(t, SPACE_RE, -1))).cast("bigint")


def source_targets(sizes: dict, weights: dict, share: float = SHARE, repeat: float = REPEAT, words: int | None = None) -> dict:
    """Target words a source; sizes and weights by source; words: of all documents, if sources overlap."""
    total = share * (sum(sizes.values()) if words is None else words)
    target, free = {}, sorted(sizes, key=lambda s: (s is None, s or ""))
    left = total
    while free:
        weight = sum(weights[s] for s in free)
        over = [s for s in free if left * weights[s] / weight > repeat * sizes[s]]
        if not over:
            target |= {s: left * weights[s] / weight for s in free}
            break
        for s in over:
            target[s] = float(repeat * sizes[s])
            free.remove(s)
        left = total - sum(target.values())
    return target


def min_cost_flow(capacity: dict, quota: dict, repeat: int = REPEAT) -> dict:
    """Words routed from each pattern (a tuple of sources) to each source: {(pattern, source): words}.

    Successive cheapest augmenting paths. Use k of a pattern (k = 0, 1, ...) has capacity[pattern] words at cost
    k, so costs are convex and whole numbers. Moving words from one source to another costs nothing, so all sources that can
    be reached from the goal cost the same, and a breadth-first search finds the cheapest pass among them.
    """
    used = dict.fromkeys(capacity, 0)
    flow: dict = {}
    need = dict(quota)
    by_source: dict = {}
    for p in capacity:
        for s in p:
            by_source.setdefault(s, []).append(p)

    def room(p) -> tuple[int, int]:
        """Cost and words of the pattern's cheapest unused pass."""
        size = capacity[p]
        k = used[p] // size if size else repeat
        return (k, size * (k + 1) - used[p]) if k < repeat else (repeat, 0)

    for goal in sorted(need, key=lambda s: (s is None, s or "")):
        while need[goal] > 0:
            # Cheapest way to hand words to `goal`: a pattern's own room, or words moved from another source it feeds.
            cost, back, queue = {goal: 0}, {}, deque([goal])
            best = None
            while queue:
                s = queue.popleft()
                for p in by_source.get(s, ()):
                    k, words = room(p)
                    if words and (best is None or cost[s] + k < best[0]):
                        best = (cost[s] + k, s, p)
                    for other in p:
                        if other != s and other not in cost and flow.get((p, other), 0) > 0:
                            cost[other] = cost[s]
                            back[other] = (s, p)
                            queue.append(other)
            if best is None:
                break
            _, s, p = best
            path, words = [], min(need[goal], room(p)[1])
            x = s
            while x != goal:
                nxt, via = back[x]
                path.append((x, nxt, via))
                words = min(words, flow[(via, x)])
                x = nxt
            used[p] += words
            flow[(p, s)] = flow.get((p, s), 0) + words
            for x, nxt, via in path:
                flow[(via, x)] -= words
                flow[(via, nxt)] = flow.get((via, nxt), 0) + words
            need[goal] -= words
    return {k: v for k, v in flow.items() if v}


def default_weights(sources: list) -> dict:
    """3, 1, 2, repeating, by code point with null last."""
    return {s: WEIGHTS[i % 3] for i, s in enumerate(sorted(sources, key=lambda s: (s is None, s or "")))}


def segments(capacity: dict, flow: dict) -> dict:
    """{pattern: [(source, end of its segment in the pattern's sequence)]} for the patterns that are used."""
    out = {}
    for p in capacity:
        ends, at = [], 0
        for s in p:
            if flow.get((p, s), 0):
                at += flow[(p, s)]
                ends.append((s, at))
        if ends:
            out[p] = ends
    return out


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", members: Column | None = None, weights=default_weights, share: float = SHARE, repeat: int = REPEAT, seed: int = 42, max_patterns: int = 10_000) -> DataFrame:
    """One row per document row: doc_id, sources (its pattern), source (the pattern's first) with source_size and target, size,
    taken (words, repeats counted), and parts: the words taken for each source of the pattern.

    More than max_patterns patterns raise: the flow is solved on the driver.
    """
    spark = docs.sparkSession
    members = F.array("source") if members is None else members
    members = F.array_sort(F.array_distinct(F.coalesce(members, F.array().cast("array<string>"))))
    u = F.xxhash64(F.lit(seed), F.col(id_col), F.xxhash64(text_col))
    rows = keep(docs.select(F.col(id_col).alias("doc_id"), members.alias("sources"), n_words(F.col(text_col)).alias("size"), u.alias("u")), "mix-rows")
    sums = rows.groupBy("sources").agg(F.sum("size").alias("words")).limit(max_patterns + 1).collect()
    if len(sums) > max_patterns:
        raise ValueError(f"more than {max_patterns} membership patterns")
    capacity = {tuple(r["sources"]): int(r["words"] or 0) for r in sums if r["sources"]}
    sizes: dict = {}
    for p, words in capacity.items():
        for s in p:
            sizes[s] = sizes.get(s, 0) + words
    targets = source_targets(sizes, weights(list(sizes)), share, repeat, sum(capacity.values()))
    cuts = segments(capacity, min_cost_flow(capacity, {s: round(t) for s, t in targets.items()}, repeat))
    # One row a pattern: bounded above.
    plan = [(i, list(p), c, [(s, end, (end - 1) // c, end - (end - 1) // c * c) for s, end in cuts.get(p, [])]) for i, (p, c) in enumerate(sorted(capacity.items(), key=str))]
    plan_df = spark.createDataFrame(plan, "pattern int, members array<string>, capacity bigint, ends array<struct<source:string,end:bigint,pass:bigint,place:bigint>>")
    size_df = spark.createDataFrame([(s, sizes[s], float(targets[s])) for s in sizes], "source string, source_size bigint, target double")
    d = rows.withColumn("range", F.pmod(F.shiftrightunsigned("u", 40), F.lit(RANGES)))
    d = d.join(F.broadcast(plan_df.select("pattern", "members")), F.col("sources").eqNullSafe(F.col("members")), "left").select("doc_id", "sources", "size", "u", "range", "pattern")
    # Where each segment ends: `place` words into the pass `pass` over the pattern, in some hash range.
    ranges = d.where("pattern is not null").groupBy("pattern", "range").agg(F.sum("size").alias("words"))
    upto = Window.partitionBy("pattern").orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranges = ranges.select("pattern", "range", "words", (F.sum("words").over(upto) - F.col("words")).alias("before"))
    marks = ranges.join(F.broadcast(plan_df.select("pattern", "capacity", F.posexplode("ends").alias("j", "e"))), "pattern").where("before < e.place and before + words >= e.place")
    mark = F.struct("j", F.col("e.source").alias("source"), F.col("e.end").alias("end"), F.col("e.pass").alias("pass"), "range", "before")
    marks = marks.groupBy("pattern", "capacity").agg(F.array_sort(F.collect_list(mark)).alias("marks"))  # one entry a segment
    d = d.join(F.broadcast(marks), "pattern", "left")
    own = F.filter("marks", lambda m: m["range"] == F.col("range"))
    none = F.array().cast("array<struct<source:string,words:bigint>>")
    segment = lambda f: F.transform("marks", lambda m, i: F.struct(m["source"].alias("source"), f(F.when(i > 0, F.get("marks", i - 1)), m).cast("bigint").alias("words")))
    total = lambda f: F.aggregate(F.sequence(F.lit(0), F.lit(repeat - 1)), F.lit(0).cast("bigint"), lambda a, k: a + f(k))

    def between(low: Column, high: Column) -> Column:
        """Words of a document between two marks whose ranges are not its own: whole passes."""
        after = lambda m, k: (m["pass"] < k) | ((m["pass"] == k) & (m["range"] < F.col("range")))
        return F.col("size") * total(lambda k: F.when((low.isNull() | after(low, k)) & ~after(high, k), 1).otherwise(0))

    def overlap(low: Column, high: Column) -> Column:
        """Words of a document that starts at `start` in each pass, between two places in the sequence."""
        begin = lambda k: k * F.col("capacity") + F.col("start")
        return total(lambda k: F.greatest(F.lit(0), F.least(high["end"], begin(k) + F.col("size")) - F.greatest(F.coalesce(low["end"], F.lit(0)), begin(k))))

    inside = Window.partitionBy("pattern", "range").orderBy("u", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = d.where(F.size(own) > 0).withColumn("start", F.get(own, F.lit(0))["before"] + F.sum("size").over(inside) - F.col("size"))
    edge = edge.select("doc_id", "sources", "size", segment(overlap).alias("parts"))
    rest = d.where((F.size(own) <= 0) | F.col("marks").isNull()).select("doc_id", "sources", "size", F.coalesce(segment(between), none).alias("parts"))
    both = edge.unionByName(rest).withColumn("taken", F.aggregate("parts", F.lit(0).cast("bigint"), lambda a, x: a + x["words"]))
    first = F.get("sources", F.lit(0))
    both = both.withColumn("mixed", F.size("sources") > 0)
    out = both.join(F.broadcast(size_df), first.eqNullSafe(F.col("source")) & F.col("mixed"), "left")
    return out.select("doc_id", "sources", "source", "size", "source_size", "target", "taken", "parts")
