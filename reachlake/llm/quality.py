"""Quality rules as weak supervision (operator 8).

Every rule votes good (1), bad (0) or abstains (null). Votes of all documents are counted by pattern in
one aggregate: at most 3**len(RULES) patterns, a bound that doesn't grow with the data. Expectation
maximisation over those counts estimates the shares of good documents and of each kind of bad ones, and
how likely each rule's votes are for each. The posterior of "good" is then a plain SQL expression in
the votes, so scoring is a map over the documents without a join. Only DataFrame functions run on the
executors.

Null, empty and blank texts have no words: n_words 0, base_failed true, kept false. Repeated rows are
judged one by one and get the same verdict. Extra input columns are neither read nor clash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_RE, keep

SYMBOLS = "#*$%&|<>"  # in a character class none of them has a meaning
MIN_WORDS = 50
FALSE_ALARMS = 0.02
RULES = ("length", "word_length", "symbols", "dup_lines", "repeats", "capitals")


def _covered(words: Column, fewer: int = 0) -> Column:
    """Words inside 3-word windows that occur twice or more in the text, exactly, in O(n log n).

    Window hashes and positions are packed in one bigint (as many low bits as positions need), so one primitive sort
    brings equal windows together. Neighbours of equal hash bits are compared by their words. If two of them
    differ (hash bits are fewer in longer texts), the windows of that text are sorted by their words instead. The
    union of [p, p+2] over repeated positions is a sum over the sorted positions. `fewer` hash bits are for tests.
    """
    n = F.size(words)
    bits = F.ceil(F.log2(F.greatest(n, F.lit(2)))).cast("int") + 1 + fewer
    mask = F.expr("0L") + F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1
    held = lambda f, **x: F.transform(F.array(F.struct(*(c.alias(k) for k, c in x.items()))), f)[0]  # noqa: E731  a value that is used more than once

    def same(s: Column, a: Column, b: Column) -> Column:
        """Whether the windows at positions a and b (from 1) have equal words."""
        i, j, w = a.cast("int") - 1, b.cast("int") - 1, s["w"]
        return (F.get(w, i) == F.get(w, j)) & (F.get(w, i + 1) == F.get(w, j + 1)) & (F.get(w, i + 2) == F.get(w, j + 2))

    packed = held(
        lambda s: F.array_sort(F.transform(F.sequence(F.lit(1), F.size(s["w"]) - 2), lambda i: F.xxhash64(F.get(s["w"], i - 1), F.get(s["w"], i), F.get(s["w"], i + 1)).bitwiseAND(F.bitwise_not(s["m"])).bitwiseOR(i.cast("long")))),
        w=words, m=mask,
    )
    like = lambda s, x, i: F.coalesce(F.get(s["p"], i).bitwiseXOR(x).bitwiseAND(F.bitwise_not(s["m"])) == 0, F.lit(False))
    close = held(lambda s: F.filter(s["p"], lambda x, i: like(s, x, i - 1) | like(s, x, i + 1)), p=packed, m=mask)

    def by_words(s: Column) -> Column:
        """Positions of repeated windows by a sort of the windows themselves."""
        wins = F.array_sort(F.transform(F.sequence(F.lit(1), F.size(s["w"]) - 2), lambda i: F.struct(F.get(s["w"], i - 1).alias("a"), F.get(s["w"], i).alias("b"), F.get(s["w"], i + 1).alias("c"), i.cast("long").alias("i"))))
        equal = lambda x, y: F.coalesce((x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"]), F.lit(False))
        return held(lambda t: F.transform(F.filter(t["v"], lambda x, i: equal(x, F.get(t["v"], i - 1)) | equal(x, F.get(t["v"], i + 1))), lambda x: x["i"]), v=wins)

    at = lambda s, x: x.bitwiseAND(s["m"])
    clash = lambda s: F.exists(F.sequence(F.lit(1), F.size(s["p"]) - 1), lambda i: like(s, F.get(s["p"], i), i - 1) & ~same(s, at(s, F.get(s["p"], i)), at(s, F.get(s["p"], i - 1))))
    hits = held(lambda s: F.array_sort(F.when(F.size(s["p"]) < 2, F.array().cast("array<bigint>")).when(clash(s), by_words(s)).otherwise(F.transform(s["p"], lambda x: at(s, x)))), p=close, w=words, m=mask)
    total = held(
        lambda s: F.aggregate(
            s["q"],
            F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).cast("long").alias("last")),
            lambda a, p: F.struct((a["n"] + F.least(F.lit(3).cast("long"), p - a["last"])).alias("n"), p.alias("last")),
            lambda a: a["n"],
        ),
        q=hits,
    )
    return F.when(n >= 4, total).otherwise(F.lit(0).cast("long"))


def quality_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the carried columns and the counts that the rules read, one row per input row; no shuffle."""
    d = docs.select(F.col(id_col).alias("doc_id"), *carry, F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    d = d.select("doc_id", *carry, "t", F.filter(F.split("t", SPACE_RE, -1), lambda w: w != "").alias("w"), F.filter(F.split("t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    counts = F.struct(
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _covered(F.col("w")).alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.regexp_count("t", F.lit(r"\p{Lu}")).cast("long").alias("n_capitals"),
    )
    # The generator keeps later filters from being pushed below the counts, which would compute them once for each use.
    return d.select("doc_id", *carry, F.explode(F.array(counts)).alias("f")).select("doc_id", *carry, "f.*")


def rule_votes() -> dict[str, Column]:
    """Vote of each rule: 1 good, 0 bad, null abstains. A rule that finds nothing of its kind abstains."""
    n, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    length, symbols = F.col("word_chars") / n, F.col("n_symbols") / n
    dups, repeats, capitals = F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)), F.col("n_repeat_words") / n, F.col("n_capitals") / chars

    def vote(bad: Column, good: Column | None = None) -> Column:
        v = F.when(bad, F.lit(0))
        return v if good is None else v.when(good, F.lit(1))

    return {
        "length": vote(F.col("n_words") < MIN_WORDS, F.col("n_words") >= 2 * MIN_WORDS),
        "word_length": vote(~length.between(2, 14), length.between(3, 9)),
        "symbols": vote(symbols > 0.1, symbols < 0.01),
        "dup_lines": vote(dups > 0.4),
        "repeats": vote(repeats > 0.3),
        "capitals": vote(capitals > 0.4, capitals < 0.1),
    }


def fit_em(patterns: list[tuple[tuple, int]], rounds: int = 100) -> tuple[list[float], list[list[dict]]]:
    """Expectation maximisation over (votes, count) patterns for good documents and one kind of bad
    document a rule, since junk of one kind passes the rules for the others.

    Returns each class's share (the good one first) and [class][rule][vote] likelihoods. It starts from
    rules that are usually right on their own kind; a pseudo-count of the start keeps estimates off 0, and
    good documents may set off a rule at most FALSE_ALARMS of the time, which tells the classes apart.
    """
    k = max((len(v) for v, _ in patterns), default=len(RULES))
    good, own, other = {1: 0.6, 0: 0.01, None: 0.39}, {1: 0.05, 0: 0.8, None: 0.15}, {1: 0.5, 0: 0.05, None: 0.45}
    start = [[good] * k, *([own if i == j else other for j in range(k)] for i in range(k))]
    share, likely = [0.9, *([0.1 / k] * k)], start
    total = sum(c for _, c in patterns)
    for _ in range(rounds if total else 0):
        weight = [1.0] * (k + 1)
        sums = [[dict(p) for p in row] for row in start]
        for votes, count in patterns:
            for c, p in enumerate(posterior(share, likely, votes)):
                weight[c] += p * count
                for s, v in zip(sums[c], votes, strict=True):
                    s[v] += p * count
        share = [w / (total + k + 1) for w in weight]
        likely = [[{v: x / w for v, x in s.items()} for s in row] for row, w in zip(sums, weight, strict=True)]
        for p in likely[0]:
            if p[0] > FALSE_ALARMS:
                p |= {v: p[v] * (1 - FALSE_ALARMS) / (1 - p[0]) for v in (1, None)} | {0: FALSE_ALARMS}
    return share, likely


def posterior(share: list[float], likely: list[list[dict]], votes: tuple) -> list[float]:
    """Probability of each class given the votes."""
    z = [math.log(p) + sum(math.log(x[v]) for x, v in zip(row, votes, strict=True)) for p, row in zip(share, likely, strict=True)]
    top = [math.exp(x - max(z)) for x in z]
    return [x / sum(top) for x in top]


def fit(features: DataFrame) -> tuple[list[float], list[list[dict]]]:
    """The model of fit_em for all rows of features; the driver gets at most 3**6 = 729 pattern counts."""
    counted = features.select(*(v.alias(k) for k, v in rule_votes().items())).groupBy(*RULES).count().collect()
    return fit_em(sorted(((tuple(r[n] for n in RULES), r["count"]) for r in counted), key=str))


def apply(features: DataFrame, model: tuple[list[float], list[list[dict]]], threshold: float = 0.5) -> DataFrame:
    """features with base_failed, p_good (the posterior) and kept: a map, no shuffle."""
    share, likely = model
    f = features.select("*", F.struct(*(v.alias(k) for k, v in rule_votes().items())).alias("votes"))
    odds = F.lit(0.0)
    for p, row in list(zip(share, likely, strict=True))[1:]:
        z = F.lit(math.log(p / share[0]))
        for rule, x, g in zip(RULES, row, likely[0], strict=True):
            weight = {v: math.log(x[v] / g[v]) for v in x}
            vote = F.col("votes")[rule]
            z = z + F.when(vote == 1, weight[1]).when(vote == 0, weight[0]).otherwise(weight[None])
        odds = odds + F.exp(z)
    base_failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    f = f.select("*", base_failed.alias("base_failed"), (1 / (1 + odds)).alias("p_good"))
    return f.select("*", (~F.col("base_failed") & (F.col("p_good") >= threshold)).alias("kept"))


def quality_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Features, posterior and verdict of every document.

    The features (a few numbers a document) are written to the shared folder, as both the pattern counts
    and the verdicts read them, so the texts are read once.
    """
    f = keep(quality_features(docs, id_col, text_col), "quality-features")
    return apply(f, fit(f), threshold)


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of docs that are kept, with the columns of docs.

    Rows and their features are written once to the shared folder: the counts read the features only, the filter
    reads both. The features are the costly part and are computed once; texts are never shuffled.
    """
    safe = [f"row_{i}" for i in range(len(docs.columns))]
    row = docs.select(*(F.col(f"`{c}`").alias(s) for c, s in zip(docs.columns, safe, strict=True)))
    f = keep(quality_features(row, safe[docs.columns.index(id_col)], safe[docs.columns.index(text_col)], tuple(safe)), "quality-rows")
    kept = apply(f, fit(f), threshold).where("kept")
    return kept.select(*(F.col(s).alias(c) for c, s in zip(docs.columns, safe, strict=True)))
