"""Personal data by candidate gradient boosting (operator 3); DataFrame functions only.

1. Generators: one pattern a kind (the base of the contract) and wider patterns (obfuscated e-mail, IPv6, phone numbers
   without a plus; secrets such as keys and tokens) propose spans, which may overlap. `split` and
   `regexp_extract_all` by the same pattern give the pieces between matches, and so every match's place in code points.
2. Features: generator, digits, separators, shape (kinds of characters, then length), the characters at either side and, for base
   patterns, cue words before the span, each in a few levels, so all candidates of all documents fall into at most a few thousand cells.
3. Weak labels come from evidence apart from the generators. Base candidates: the kind's own check (number of digits,
   checksum, parts). Wide ones: e-mail, a top-level domain or none; IPv6, groups that are not all of two digits; phone,
   a calling word before it, against text grown onto it or a year in front; secret, a value assigned to a name such as token or
   a known prefix, against words and numbers joined by dashes. A wide span with neither kind of evidence has no label
   and is judged by what its format and context share with the labelled ones.
   One aggregate counts positives and negatives by cell; boosted depth-2 trees are fitted to these counts on
   the driver (a bounded table, all candidates count, no sample) and turned into SQL expressions.
4. Thresholds by kind, for base and wide patterns apart: scores are calibrated by isotonic pooling of the counts, and the
   threshold is the lowest score whose calibrated probability is at least `precision`. Candidates that pass, are no
   base spans, do not fail their own check and overlap no base span are added. Base spans always stay.

Null text is empty: no spans. Repeated rows give equal rows. Candidates of a document stay in its row: nothing is
shuffled but the counts. Patterns are possessive with look-behind, so runs of any length take linear time and no
length is cut off. Extra columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep

KINDS = ("email", "ip", "card", "phone", "secret")
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
WIDE = (
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[\[(]at[\])] ?[A-Za-z0-9-]++(?:(?:\.| ?[\[(]dot[\])] ?)[A-Za-z0-9-]++)++"
    r"|(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"
    r"|(?<![0-9.-])\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])"
)
#: Runs of 20 or more key characters with both letters and digits.
SECRET = r"(?<![A-Za-z0-9_+/=-])(?=[A-Za-z_+/-]*+[0-9])(?=[0-9_+/-]*+[A-Za-z])[A-Za-z0-9_+/-]{20,}+={0,2}"
CUES = r"(?i)(?:mail|phone|tel|call|fax|mobile|card|visa|credit|account|konto|ip|host|server|address|contact)[^A-Za-z]*$"
_TLD = r"(?:\.|[\[(]dot[\])] ?)(?:[A-Za-z]{2,24}|xn--[A-Za-z0-9-]+)$"
_HARDWARE = r"^(?:[0-9A-Fa-f]{2}:){7}[0-9A-Fa-f]{2}$"
_CALL = r"(?i)(?<![A-Za-z])(?:tele)?(?:phone|tel|call|fax|mobile)[^A-Za-z]*$"
_YEAR = r"^\(?(?:19|20)[0-9]{2}[^0-9]"
_ASSIGNED = r"(?i)(?:token|secret|passw(?:or)?d|pwd|key|auth|bearer|credentials?)[\"']?(?: ?(?:=|:|=>) ?| )[\"']?$"
_PREFIX = r"^(?:AKIA|ASIA|gh[pousr]_|github_pat_|sk-|sk_live_|xox[abprs]-|glpat-|eyJ)"
_JOINED = r"^[A-Za-z]*[0-9]{0,4}(?:[-_/+][A-Za-z]*[0-9]{0,4})+=*$"
FEATURES = ("kind", "gen", "digits", "seps", "shape", "before", "after", "cue")
_SPAN = "array<struct<kind:int,gen:int,s:int,e:int,m:string,pre:string,post:string>>"


def _matches(text: Column, pattern: str, kind: Column | None, gen: int, only_if: Column) -> Column:
    """Spans of all matches, in code points. Places are running sums over pieces and matches."""
    pieces = F.split(F.when(only_if, text), pattern, -1)
    found = F.regexp_extract_all(F.when(only_if, text), F.lit(pattern), F.lit(0))

    def step(a: Column, i: Column) -> Column:
        piece, m = a["p"][i], a["f"][i]
        s = a["at"] + F.length(piece)
        k = kind if kind is not None else F.when(m.rlike(r"[\[(]at[\])]"), 0).when(m.contains(":"), 1).otherwise(3)
        one = F.struct(k.cast("int").alias("kind"), F.lit(gen).alias("gen"), s.alias("s"), (s + F.length(m)).alias("e"), m.alias("m"), F.right(piece, F.lit(24)).alias("pre"), F.left(a["p"][i + 1], F.lit(1)).alias("post"))
        return F.struct(a["p"].alias("p"), a["f"].alias("f"), (s + F.length(m)).alias("at"), F.array_append(a["out"], one).alias("out"))

    start = F.struct(pieces.alias("p"), found.alias("f"), F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out"))
    return F.when(F.size(found) > 0, F.aggregate(F.sequence(F.lit(0), F.size(found) - 1), start, step, lambda a: a["out"])).otherwise(F.array().cast(_SPAN))


def _valid(c: Column) -> Column:
    """Whether a span of a base pattern passes its kind's check."""
    digits, n = c["d"], F.length(c["d"])
    part = lambda x: F.regexp_replace(x, "^0+", "")
    octets = F.forall(F.split(c["m"], r"\."), lambda x: (F.length(part(x)) <= 3) & (F.coalesce(part(x).try_cast("int"), F.lit(0)) <= 255))
    digit = lambda i: F.ascii(F.substring(digits, i, 1)) - 48
    luhn = F.aggregate(
        F.sequence(F.lit(1), n),
        F.lit(0),
        lambda a, i: a + F.when((n - i) % 2 == 1, 2 * digit(i) - F.when(digit(i) > 4, 9).otherwise(0)).otherwise(digit(i)),
    )
    return F.when(c["gen"] == 1, False).when(c["kind"] == 0, True).when(c["kind"] == 1, octets).when(c["kind"] == 2, F.when(n.between(13, 19), luhn % 10 == 0).otherwise(False)).otherwise(n.between(9, 15))


def _evidence(c: Column) -> Column:
    """Label of a span of a wide pattern by evidence of its own: true, false, or null where there is none."""
    grown = F.right(c["pre"], F.lit(1)).rlike(r"[A-Za-z0-9$=/_#]") | c["post"].rlike(r"[A-Za-z0-9%$=/_.]")
    phone = F.when(c["pre"].rlike(_CALL), True).when(grown | c["m"].rlike(_YEAR), False)
    secret = F.when(c["pre"].rlike(_ASSIGNED) | c["m"].rlike(_PREFIX), True).when(c["m"].rlike(_JOINED), False)
    return F.when(c["kind"] == 0, c["m"].rlike(_TLD)).when(c["kind"] == 1, F.when(~c["m"].rlike(_HARDWARE), True)).when(c["kind"] == 3, phone).otherwise(secret)


def _chars(m: Column) -> Column:
    """0 digits and marks, 1 hexadecimal in one case, 2 letters in one case, 3 letters in both."""
    both = m.rlike("[a-z]") & m.rlike("[A-Z]")
    return F.when(~m.rlike("[A-Za-z]"), 0).when(both, 3).when(m.rlike("[g-zG-Z]"), 2).otherwise(1)


def _side(x: Column) -> Column:
    return F.when(x.rlike("[A-Za-z]"), 1).when(x.rlike("[0-9]"), 2).when(x.rlike(r"[+@.=_/-]"), 3).otherwise(0)


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """doc_id (with_text: and text) and cands, an array of spans with validity and feature levels, one row per document row."""
    own = ["doc_id", *(["text"] if with_text else [])]
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    t = F.col("t")
    tests = {"email": t.contains("@"), "ip": t.rlike(r"[0-9]\.[0-9]"), "card": t.rlike("[0-9][ -]?[0-9]"), "phone": t.contains("+")}
    key_if = t.rlike("[A-Za-z0-9_+/-]{20}") & t.rlike("[0-9]")
    wide_if = t.contains("(at)") | t.contains("[at]") | t.rlike("[0-9][ .-][0-9]{3}|[0-9A-Fa-f]:[0-9A-Fa-f]")
    d = d.select(*own, F.concat(*(_matches(t, BASE[k], F.lit(i), 0, tests[k]) for i, k in enumerate(BASE)), _matches(t, WIDE, None, 1, wide_if), _matches(t, SECRET, F.lit(4), 1, key_if)).alias("c"))
    d = d.select(*own, F.transform("c", lambda c: c.withField("d", F.regexp_replace(c["m"], "[^0-9]", ""))).alias("c"))

    def level(x: Column, *cuts: int) -> Column:
        return sum((F.when(x >= k, 1).otherwise(0) for k in cuts), F.lit(0))

    def features(c: Column) -> Column:
        n = F.length(c["d"])
        return F.struct(
            c["kind"].alias("kind"),
            *(c[x].alias(x) for x in ("gen", "s", "e")),
            _valid(c).alias("valid"),
            F.when(c["gen"] == 0, _valid(c)).otherwise(_evidence(c)).alias("label"),
            level(n, 1, 7, 9, 10, 12, 13, 16, 17, 20).alias("digits"),
            level(F.length(F.regexp_replace(c["m"], "[A-Za-z0-9]", "")), 1, 3, 4, 6).alias("seps"),
            (10 * _chars(c["m"]) + level(F.length(c["m"]), 8, 12, 16, 20, 30, 40, 64, 128)).alias("shape"),
            _side(F.right(c["pre"], F.lit(1))).alias("before"),
            _side(c["post"]).alias("after"),
            # Of wide spans cue words are the labels' evidence, so the trees don't see them.
            F.when((c["gen"] == 0) & c["pre"].rlike(CUES), 1).otherwise(0).alias("cue"),
        )

    return d.select(*own, F.transform("c", features).alias("cands"))


def _overlap(a: Column, b: Column) -> Column:
    return (a["s"] < b["e"]) & (b["s"] < a["e"])


def cells(cands: DataFrame) -> list[tuple[tuple, int, int]]:
    """(feature levels, positives, negatives): one row a cell, at most a few thousand."""
    c = cands.select(F.explode("cands").alias("c")).where("c.label is not null")
    y = F.col("c.label")
    rows = c.groupBy(*(F.col("c")[f].alias(f) for f in FEATURES)).agg(F.count_if(y).alias("pos"), F.count_if(~y).alias("neg"))
    return sorted((tuple(r[f] for f in FEATURES), r["pos"], r["neg"]) for r in rows.collect())


def fit_trees(rows: list[tuple[tuple, int, int]], rounds: int = 20, rate: float = 0.4) -> list[tuple]:
    """Gradient-boosted depth-2 trees for logistic loss on weighted cells.

    A tree is (feature, cut, leaf, leaf) with x[feature] < cut to the left; a leaf is a number or one more split.
    """
    z = [0.0] * len(rows)
    trees: list[tuple] = []

    def value(idx: list[int]) -> float:
        g = sum(rows[i][1] - (rows[i][1] + rows[i][2]) / (1 + math.exp(-z[i])) for i in idx)
        h = sum((rows[i][1] + rows[i][2]) * (p := 1 / (1 + math.exp(-z[i]))) * (1 - p) for i in idx)
        return g / (h + 1.0)

    def gain(idx: list[int]) -> float:
        g = sum(rows[i][1] - (rows[i][1] + rows[i][2]) / (1 + math.exp(-z[i])) for i in idx)
        h = sum((rows[i][1] + rows[i][2]) * (p := 1 / (1 + math.exp(-z[i]))) * (1 - p) for i in idx)
        return g * g / (h + 1.0)

    def grow(idx: list[int], depth: int):
        best = (1e-9, None)
        whole = gain(idx)
        for f in range(len(FEATURES)):
            for cut in sorted({rows[i][0][f] for i in idx})[1:]:
                left = [i for i in idx if rows[i][0][f] < cut]
                right = [i for i in idx if rows[i][0][f] >= cut]
                best = max(best, (gain(left) + gain(right) - whole, (f, cut, left, right)), key=lambda x: x[0])
        if not depth or best[1] is None:
            return max(-4.0, min(4.0, value(idx))) * rate
        f, cut, left, right = best[1]
        return (f, cut, grow(left, depth - 1), grow(right, depth - 1))

    for _ in range(rounds if rows else 0):
        tree = grow(list(range(len(rows))), 2)
        trees.append(tree)
        z = [max(-30.0, min(30.0, a + run_tree(tree, r[0]))) for a, r in zip(z, rows, strict=True)]
    return trees


def run_tree(tree, x: tuple) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if x[tree[0]] < tree[1] else tree[3]
    return tree


def tree_column(tree, c: Column) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    return F.when(c[FEATURES[tree[0]]] < tree[1], tree_column(tree[2], c)).otherwise(tree_column(tree[3], c))


def thresholds(rows: list[tuple[tuple, int, int]], trees: list, precision: float = 0.9, wide: bool | None = None) -> list[float]:
    """By kind, the lowest score whose calibrated share of positives is at least `precision`; infinite if none is.

    With `wide`, over the candidates of the wide patterns only, or of the base patterns only.
    """
    out = []
    for k in range(len(KINDS)):
        by: dict[float, list[int]] = {}
        for x, pos, neg in rows:
            if x[0] == k and wide in (None, x[1] > 0):
                s = by.setdefault(round(sum(run_tree(t, x) for t in trees), 9), [0, 0])
                s[0] += pos
                s[1] += neg
        # Isotonic calibration: neighbouring score levels are pooled until the share of positives falls with the score.
        pools: list[list] = []
        for score in sorted(by, reverse=True):
            pools.append([score, *by[score]])
            while len(pools) > 1 and pools[-1][1] * (pools[-2][1] + pools[-2][2]) > pools[-2][1] * (pools[-1][1] + pools[-1][2]):
                low = pools.pop()
                pools[-1] = [low[0], pools[-1][1] + low[1], pools[-1][2] + low[2]]
        best = min((s - 1e-6 for s, pos, neg in pools if pos >= precision * (pos + neg)), default=math.inf)
        out.append(best)
    return out


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", precision: float = 0.9, with_text: bool = False) -> DataFrame:
    """One row per document row: doc_id (with_text: and text), base and added, arrays of (kind, s, e) in code points, sorted."""
    cands = keep(candidates(docs, id_col, text_col, with_text), "pii-candidates")
    own = ["doc_id", *(["text"] if with_text else [])]
    rows = cells(cands)
    trees = fit_trees(rows)
    cut = [thresholds(rows, trees, precision, wide) for wide in (False, True)]
    lean = lambda c: F.struct(c["kind"].alias("kind"), c["s"].alias("s"), c["e"].alias("e"))

    def wanted(c: Column) -> Column:
        score = sum((tree_column(t, c) for t in trees), F.lit(0.0))
        limit = F.lit(math.inf)
        for wide, own in enumerate(cut):
            for k, x in enumerate(own):
                limit = F.when((c["kind"] == k) & (c["gen"].cast("boolean") == F.lit(bool(wide))), F.lit(float(x))).otherwise(limit)
        return ~c["valid"] & F.coalesce(c["label"], F.lit(True)) & (score >= limit)

    d = cands.select(*own, F.transform(F.filter("cands", lambda c: c["valid"]), lean).alias("base"), F.transform(F.filter("cands", wanted), lean).alias("more"))
    more = F.filter("more", lambda c: ~F.exists("base", lambda b: _overlap(b, c)))
    return d.select(*own, "base", F.array_sort(F.array_distinct(more)).alias("added"))


def _text(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda c: F.concat_ws(":", names[c["kind"]], c["s"].cast("string"), c["e"].cast("string"))), ",")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", precision: float = 0.9) -> DataFrame:
    """The digest of every document's spans: base counts by kind, SHA-256 of the base spans, all spans, how many the method
    added (in all, and secrets among them), and whether there is any span."""
    d = find_pii(docs, id_col, text_col, precision)
    of = lambda i: F.filter("base", lambda c: c["kind"] == i)
    counts = [F.size(of(i)).cast("bigint").alias(f"n_{k}") for i, k in enumerate(BASE)]
    more = [F.size("added").cast("bigint").alias("n_added"), F.size(F.filter("added", lambda c: c["kind"] == 4)).cast("bigint").alias("n_secret"), (F.size("base") + F.size("added") > 0).alias("has_private")]
    return d.select("doc_id", *counts, F.sha2(_text(F.array_sort("base")), 256).alias("base_sha256"), _text(F.array_sort(F.concat("base", "added"))).alias("spans"), *more)


def mask(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", precision: float = 0.9) -> DataFrame:
    """doc_id and text, each selected span written as <kind>; of overlapping spans the first, then the longest. Null text stays null."""
    d = find_pii(docs, id_col, text_col, precision, with_text=True)
    names = F.array(*map(F.lit, KINDS))
    ordered = F.array_sort(F.concat("base", "added"), lambda a, b: F.when(a["s"] != b["s"], a["s"] - b["s"]).otherwise(b["e"] - a["e"]))

    def step(a: Column, c: Column) -> Column:
        parts = F.array(F.substring(F.col("text"), a["at"] + 1, c["s"] - a["at"]), F.concat(F.lit("<"), names[c["kind"]], F.lit(">")))
        return F.when(c["s"] < a["at"], a).otherwise(F.struct(c["e"].alias("at"), F.concat(a["out"], parts).alias("out")))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    rest = lambda a: F.concat(F.array_join(a["out"], ""), F.substring(F.col("text"), a["at"] + 1, F.length("text")))
    return d.select("doc_id", F.when(F.col("text").isNotNull(), F.aggregate(ordered, start, step, rest)).alias("text"))
