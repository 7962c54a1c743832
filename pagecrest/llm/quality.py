"""Quality rules learned as a decision list, all in DataFrame operations.

Statistics of each whole text are Spark expressions. Learning is sequential covering: a rule grows
by the threshold on one statistic that gains most on the growing rows, is pruned on the held-back
rows, and joins the list if it is precise there; the rows that it covers leave and the next rule
follows. Each step is one aggregate over a table of cells: labelled rows counted by the bins that
their statistics fall into. The list becomes an ordered conditional expression.

Defined results: null and empty texts have no words and fail the base rule; null labels teach
nothing; with no labels the list is empty and only the base rule decides; rows repeat and ids may
be null; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagecrest.llm.common import WORD_GAP, fresh, settle, words

SYMBOLS = r"[#*$%&|<>]"
#: What rules may test: shares, so that long and short texts compare.
FEATURES = ("chars_per_word", "symbols_per_word", "marks_per_word", "upper_share", "dup_line_share", "repeat_share", "distinct_share")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_marks", "n_upper", "n_distinct")


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeat_words(w: Column) -> Column:
    """Words inside three-word windows that occur twice or more in the array."""

    def covered(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def positions(z: Column) -> Column:
            same = lambda x, j: F.coalesce(F.get(z, j)["h"] == x["h"], F.lit(False))
            return F.sort_array(F.transform(F.filter(z, lambda x, j: same(x, j + 1) | same(x, j - 1)), lambda x: x["i"]))

        def reach(p: Column) -> Column:
            steps = F.transform(p, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - x, F.lit(3))))
            return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

        return _let(placed, lambda z: _let(positions(z), reach))

    windows = F.transform(F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
    return _let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))


def text_counts(text: Column) -> Column:
    """Struct of COUNTS of a text, longs."""

    def of(t: Column) -> Column:
        def lines(x: Column) -> list[Column]:
            return [(F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines"), F.size(x).alias("n_lines")]

        with_word = F.filter(F.split(t, "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
        return F.struct(
            _let(words(t), lambda w: F.struct(F.size(w).alias("n_words"), repeat_words(w).alias("n_repeat_words"), F.size(F.array_distinct(w)).alias("n_distinct"))).alias("w"),
            _let(with_word, lambda x: F.struct(*lines(x))).alias("l"),
            F.length(F.regexp_replace(t, WORD_GAP, "")).alias("word_chars"),
            (F.length(t) - F.length(F.regexp_replace(t, SYMBOLS, ""))).alias("n_symbols"),
            (F.length(t) - F.length(F.regexp_replace(t, "[!?]", ""))).alias("n_marks"),
            (F.length(t) - F.length(F.regexp_replace(t, r"\p{Lu}", ""))).alias("n_upper"),
        )

    return _let(F.coalesce(text, F.lit("")), of)


def with_counts(docs: DataFrame, text: str, out: str) -> DataFrame:
    """docs with the struct `out` of COUNTS."""
    raw = fresh(docs, "_counts")
    where = {"n_words": "w.", "n_repeat_words": "w.", "n_distinct": "w.", "n_dup_lines": "l.", "n_lines": "l."}
    rows = docs.withColumn(raw, text_counts(F.col(text)))
    return rows.withColumn(out, F.struct(*(F.col(f"{raw}.{where.get(c, '')}{c}").cast("long").alias(c) for c in COUNTS))).drop(raw)


def features(c: str) -> dict[str, Column]:
    """The statistics that rules test, from the struct column c."""
    share = lambda a, b: F.col(f"{c}.{a}") / F.greatest(F.col(f"{c}.{b}"), F.lit(1))
    return {
        "chars_per_word": share("word_chars", "n_words"), "symbols_per_word": share("n_symbols", "n_words"), "marks_per_word": share("n_marks", "n_words"),
        "upper_share": share("n_upper", "word_chars"), "dup_line_share": share("n_dup_lines", "n_lines"), "repeat_share": share("n_repeat_words", "n_words"),
        "distinct_share": share("n_distinct", "n_words"),
    }


def base_failed(c: str) -> Column:
    return (F.col(f"{c}.n_words") < 50) | (100 * F.col(f"{c}.n_repeat_words") > 50 * F.col(f"{c}.n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool  # at or above the threshold, else below it
    threshold: float
    bin: int  # the threshold's place in the feature's list

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<'} {self.threshold:.4g}"

    def column(self, stats: dict[str, Column]) -> Column:
        return stats[self.feature] >= self.threshold if self.above else stats[self.feature] < self.threshold

    def on_bins(self) -> Column:
        return F.col(self.feature) >= self.bin if self.above else F.col(self.feature) < self.bin


Rule = tuple[Condition, ...]


def _all(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def learn(labelled: DataFrame, counts: str, good: str, n_bins: int = 32, max_rules: int = 8, max_conditions: int = 4, least_support: int = 5, least_precision: float = 0.9) -> list[Rule]:
    """Rules for bad rows (good = 0), in order. labelled has the struct of counts and the label.

    All labelled rows take part: bins are quantiles over all, and cells count all.
    """
    rows = labelled.where(F.col(good).isNotNull() & ~base_failed(counts)).select(F.col(good).alias("_good"), *(x.alias(f) for f, x in features(counts).items()))
    at = [k / n_bins for k in range(1, n_bins)]
    cuts = rows.agg(*(F.percentile_approx(F.when(F.col("_good") == v, F.col(f)), at, 2000).alias(f"{f}_{v}") for f in FEATURES for v in (0, 1))).first()
    # A cut midway between neighbouring quantiles of either label.
    cuts = {f: sorted({(a + b) / 2 for a, b in zip(q, q[1:]) if a < b}) for f in FEATURES if (q := sorted({x for v in (0, 1) for x in cuts[f"{f}_{v}"] or []}))}
    used = [f for f in FEATURES if cuts.get(f)]
    if not used:
        return []
    below = lambda f: F.size(F.filter(F.array(*map(F.lit, cuts[f])), lambda t: t <= F.col(f)))
    binned = [below(f).alias(f) for f in used]
    fold = (F.pmod(F.xxhash64(*used), F.lit(3)) == 0).alias("_prune")
    cells = settle(rows.select("_good", fold, *binned).groupBy("_prune", *used).agg(F.sum((F.col("_good") == 0).cast("long")).alias("_bad"), F.sum((F.col("_good") != 0).cast("long")).alias("_ok")))

    def best(left: DataFrame, rule: list[Condition]) -> tuple[list[Condition], bool]:
        """The rule with the condition that gains most, and whether it still covers good rows."""
        inside = left.where(~F.col("_prune") & _all([c.on_bins() for c in rule]))
        each = F.explode(F.array(*(F.struct(F.lit(f).alias("f"), F.col(f).alias("b")) for f in used)))
        seen = inside.select(each.alias("x"), "_bad", "_ok").groupBy("x.f", "x.b").agg(F.sum("_bad").alias("bad"), F.sum("_ok").alias("ok")).collect()
        table = {f: sorted((r["b"], r["bad"], r["ok"]) for r in seen if r["f"] == f) for f in used}
        bad, ok = (sum(x[k] for x in table[used[0]]) for k in (1, 2))
        if not bad or not ok:
            return rule, False
        before, top = math.log2(bad / (bad + ok)), (1e-9, "", None)
        for f in used:
            for b in range(1, len(cuts[f]) + 1):
                low = [sum(x[k] for x in table[f] if x[0] < b) for k in (1, 2)]
                for above, (p, n) in ((False, low), (True, (bad - low[0], ok - low[1]))):
                    if p >= least_support:
                        gain = p * (math.log2(p / (p + n)) - before)
                        if gain > top[0]:
                            top = (gain, f, Condition(f, above, cuts[f][b - 1], b), n)
        return (rule, False) if top[2] is None else ([*rule, top[2]], top[3] > 0)

    rules: list[Rule] = []
    left = cells
    while len(rules) < max_rules:
        rule: list[Condition] = []
        more = True
        while more and len(rule) < max_conditions:
            grown, more = best(left, rule)
            if grown == rule:
                break
            rule = grown
        if not rule:
            break
        worth = []
        for k in range(1, len(rule) + 1):
            covered = _all([c.on_bins() for c in rule[:k]])
            for prune in (True, False):
                worth += [F.sum(F.when(covered & (F.col("_prune") == prune), F.col(x))).alias(f"{x}{k}{prune}") for x in ("_bad", "_ok")]
        got = left.agg(*worth).first().asDict()
        n = lambda x, k, prune: got[f"{x}{k}{prune}"] or 0
        value = lambda k: (n("_bad", k, True) - n("_ok", k, True)) / max(1, n("_bad", k, True) + n("_ok", k, True))
        k = max(range(1, len(rule) + 1), key=lambda k: (value(k), -k))
        bad, ok = (n(x, k, True) + n(x, k, False) for x in ("_bad", "_ok"))
        if bad < least_support or bad / (bad + ok) < least_precision:
            break
        rules.append(tuple(rule[:k]))
        left = left.where(~_all([c.on_bins() for c in rule[:k]]))
    return rules


def verdict(rules: list[Rule], counts: str) -> Column:
    """Which rule rejects a row, from 1; 0 if none does: one ordered conditional expression."""
    stats, out = features(counts), None
    for k, rule in enumerate(rules, 1):
        hit = _all([c.column(stats) for c in rule])
        out = F.when(hit, F.lit(k)) if out is None else out.when(hit, F.lit(k))
    return F.lit(0) if out is None else out.otherwise(F.lit(0))


def judge(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label_id: str = "doc_id", good: str = "quality", **options) -> DataFrame:
    """(doc_id, counts, base_failed, rule, kept) of every row of docs."""
    stats = settle(with_counts(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", "counts").drop("text"))
    taught = stats.join(labels.select(F.col(label_id).alias("doc_id"), F.col(good).alias("good")), "doc_id")
    rules = learn(taught, "counts", "good", **options)
    out = stats.withColumn("base_failed", base_failed("counts")).withColumn("rule", verdict(rules, "counts"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def keep_good(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label_id: str = "doc_id", good: str = "quality", **options) -> DataFrame:
    """The rows of docs that no rule rejects, with all their columns."""
    c = fresh(docs, "counts")
    # Texts are counted where they lie; only counts are shuffled to meet the labels.
    stats = settle(with_counts(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", "counts").drop("text"))
    taught = stats.join(labels.select(F.col(label_id).alias("doc_id"), F.col(good).alias("good")), "doc_id")
    rules = learn(taught, "counts", "good", **options)
    return with_counts(docs, text, c).where(~base_failed(c) & (verdict(rules, c) == 0)).drop(c)
