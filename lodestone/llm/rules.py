"""Quality rules: text statistics and a learned decision list.

Statistics come from built-in expressions only. From a bounded sample of labelled documents a decision list is
learned by sequential covering: grow a conjunction of thresholds by FOIL gain until it covers no good document of
the growing part, prune it from its end on the pruning part, keep it if it is precise enough there, take away what
it covers, and go on. The list becomes an ordered CASE WHEN expression.

Null and empty texts have statistics of zero and fail the base rule; repeated rows are judged alike, each on its
own; an empty label table gives an empty list, so that the base rule alone decides. Columns of documents other
than doc_id and text are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import UPPER, count_chars, space_words

SYMBOLS = "#*$%&|<>"
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks", "n_distinct")
#: Window positions are packed beside 44 bits of their hash, so 20 bits; longer texts take the wider form.
POSITION_BITS = 20


def repeated_words(words: Column) -> Column:
    """How many words stand in a 3-word window that is found twice or more in the text, the first one included.

    Windows are compared by a 64-bit hash. Sorting (hash, position) puts equal windows side by side; the positions
    of those, sorted again, cover min(3, gap to the next) words each. Linear memory, n log n time, no shuffle. Hash and position
    are sorted as one integer where that is sure to do the same: not if there are too many positions for its lower part, or if
    different windows agree in its upper part.
    """
    n = F.size(words)
    grams = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))

    def covered(found: Column) -> Column:
        """found: ascending positions of repeated windows."""
        return F.when(F.size(found) == 0, F.lit(0).cast("long")).otherwise(
            F.aggregate(found, F.struct(F.lit(-3).cast("long").alias("last"), F.lit(0).cast("long").alias("sum")), lambda s, p: F.struct(p.alias("last"), (s["sum"] + F.least(F.lit(3).cast("long"), p - s["last"])).alias("sum")), lambda s: s["sum"])
        )

    mask = (1 << POSITION_BITS) - 1

    def packed(h: Column) -> Column:
        keys = F.array_sort(F.transform(h, lambda x, i: x.bitwiseAND(F.lit(~mask)).bitwiseOR(i.cast("long"))))
        at = lambda k: k.bitwiseAND(F.lit(mask))
        hash_of = lambda k: F.get(h, at(k).cast("int"))
        same = lambda a, b: F.coalesce(hash_of(a) == hash_of(b), F.lit(False))
        pick = lambda k: F.filter(k, lambda x, i: same(x, F.get(k, i - 1)) | same(x, F.get(k, i + 1)))
        # windows that agree in the upper part of the hash alone might part equal ones
        near = lambda a, b: F.coalesce(a.bitwiseXOR(b).bitwiseAND(F.lit(~mask)) == F.lit(0).cast("long"), F.lit(False))
        mixed = lambda k: F.size(F.filter(k, lambda x, i: near(x, F.get(k, i - 1)) & (hash_of(x) != hash_of(F.get(k, i - 1))))) > 0
        return _let(keys, lambda k: F.when(mixed(k), wide(h)).otherwise(covered(F.array_sort(F.transform(pick(k), at)))))

    def wide(h: Column) -> Column:
        keys = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.cast("long").alias("p"))))
        same = lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))
        pick = lambda k: F.filter(k, lambda x, i: same(x, F.get(k, i - 1)) | same(x, F.get(k, i + 1)))
        return _let(keys, lambda k: covered(F.array_sort(F.transform(pick(k), lambda x: x["p"]))))

    return F.when(n < 6, _let(words, lambda w: _few(w))).otherwise(F.when(n < mask, _let(grams, packed)).otherwise(_let(grams, wide)))


def _few(words: Column) -> Column:
    """Under 6 words (at most 3 windows) the pairs are looked at one by one."""
    w = lambda i: F.get(words, F.lit(i))
    same = lambda a, b: F.coalesce((w(a) == w(b)) & (w(a + 1) == w(b + 1)) & (w(a + 2) == w(b + 2)), F.lit(False))
    s01, s02, s12 = same(0, 1), same(0, 2), same(1, 2)
    in0, in1, in2 = s01 | s02, s01 | s12, s02 | s12
    return sum((c.cast("long") for c in (in0, in0 | in1, in0 | in1 | in2, in1 | in2, in2)), F.lit(0).cast("long"))


def _let(value: Column, use) -> Column:
    """use(value) with the value computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def statistics(text: Column) -> Column:
    """A struct: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (the contract's) and n_upper, n_marks,
    n_distinct for the learned list. One self-contained expression: a filter on it can be pushed below a projection
    without the words being split again and again."""
    body = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return _let(
        F.struct(space_words(text).alias("w"), lines.alias("l")),
        lambda v: F.struct(
            F.size(v["w"]).cast("long").alias("n_words"),
            F.aggregate(v["w"], F.lit(0).cast("long"), lambda n, w: n + F.length(w)).alias("word_chars"),
            count_chars(body, SYMBOLS).alias("n_symbols"),
            (F.size(v["l"]) - F.size(F.array_distinct(v["l"]))).cast("long").alias("n_dup_lines"),
            repeated_words(v["w"]).alias("n_repeat_words"),
            count_chars(body, UPPER).alias("n_upper"),
            count_chars(body, "!?").alias("n_marks"),
            F.size(F.array_distinct(v["w"])).cast("long").alias("n_distinct"),
        ),
    )


#: Features of the learned list, by name; of the struct of statistics().
FEATURES = {
    "symbols_per_word": lambda s: s["n_symbols"] / F.greatest(s["n_words"], F.lit(1)),
    "marks_per_word": lambda s: s["n_marks"] / F.greatest(s["n_words"], F.lit(1)),
    "upper_share": lambda s: s["n_upper"] / F.greatest(s["word_chars"], F.lit(1)),
    "mean_word_length": lambda s: s["word_chars"] / F.greatest(s["n_words"], F.lit(1)),
    "repeat_share": lambda s: s["n_repeat_words"] / F.greatest(s["n_words"], F.lit(1)),
    "distinct_share": lambda s: s["n_distinct"] / F.greatest(s["n_words"], F.lit(1)),
    "dup_lines_per_word": lambda s: s["n_dup_lines"] / F.greatest(s["n_words"], F.lit(1)),
    "n_words": lambda s: s["n_words"].cast("double"),
}


def base_failed(s: Column) -> Column:
    return (s["n_words"] < 50) | (s["n_repeat_words"] * 100 > s["n_words"] * 50)


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass
class DecisionList:
    """Conjunctions in order; the first that holds rejects, else a document is kept."""

    rules: list[list[Condition]]

    def keep(self, stats: Column) -> Column:
        out = F.lit(True)
        for rule in reversed(self.rules):
            holds = F.lit(True)
            for c in rule:
                value = FEATURES[c.feature](stats)
                holds &= (value > c.threshold) if c.above else (value <= c.threshold)
            out = F.when(holds, False).otherwise(out)
        return out

    def __str__(self) -> str:
        return "\n".join(f"IF {' AND '.join(map(str, r))} THEN reject" for r in self.rules) + "\nELSE keep"


def cover(x: np.ndarray, bad: np.ndarray, names: list[str], seed: int = 7, cuts: int = 64, min_precision: float = 0.9, min_covered: int = 3, max_conditions: int = 4) -> DecisionList:
    """Sequential covering over a matrix of features (rows: labelled documents). A rule has at most ``max_conditions``
    thresholds, each out of ``cuts`` quantiles of its feature; it is kept if it covers ``min_covered`` bad documents or more
    with a precision of ``min_precision`` or more, on the pruning part as well."""
    rng = np.random.default_rng(seed)
    left, rules = np.ones(len(bad), bool), []
    grid = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, cuts + 1))) if len(x) else np.zeros(0) for j in range(x.shape[1])]
    grid = [(g[1:] + g[:-1]) / 2 for g in grid]
    while (left & bad).sum() >= min_covered:
        grow = rng.random(len(bad)) < 2 / 3
        prune = left & ~grow
        grow &= left
        rule, here = [], grow.copy()
        while len(rule) < max_conditions and (here & ~bad).any():
            p0, n0 = (here & bad).sum(), (here & ~bad).sum()
            best = (1e-9, None, None)
            for j, name in enumerate(names):
                v, b = x[here, j], bad[here]
                order = np.argsort(v, kind="stable")
                cum = np.concatenate([[0], np.cumsum(b[order])])
                k = np.searchsorted(v[order], grid[j], side="right")
                for above, p, n in ((False, cum[k], k - cum[k]), (True, p0 - cum[k], n0 - (k - cum[k]))):
                    if len(k):
                        gain = np.where(p > 0, p * (np.log2((p + 1e-9) / (p + n + 1e-9)) - np.log2(max(p0, 1e-9) / (p0 + n0))), -1)
                        if gain[i := int(np.argmax(gain))] > best[0]:
                            best = (gain[i], Condition(name, above, float(grid[j][i])), (x[:, j] > grid[j][i]) == above)
            if best[1] is None:
                break
            rule.append((best[1], best[2]))
            here &= best[2]

        def worth(length: int) -> float:
            held = prune.copy()
            for _, holds in rule[:length]:
                held &= holds  # noqa: B023
            p, n = (held & bad).sum(), (held & ~bad).sum()
            return (p - n) / (p + n) if p + n else -1.0

        if not rule:
            break
        length = max(range(1, len(rule) + 1), key=lambda k: (worth(k), -k))
        holds = np.ones(len(bad), bool)
        for _, h in rule[:length]:
            holds &= h
        p, n = (left & holds & bad).sum(), (left & holds & ~bad).sum()
        if p < min_covered or p < min_precision * (p + n) or (prune.any() and worth(length) < 2 * min_precision - 1):
            break
        rules.append([c for c, _ in rule[:length]])
        left &= ~holds
    return DecisionList(rules)


def learn(docs: DataFrame, labels: DataFrame, max_labelled: int = 6000, seed: int = 7) -> DecisionList:
    """Learns from at most ``max_labelled`` labelled documents, those whose doc_id has the smallest seeded hash. A doc_id
    labelled more than once counts as its lowest quality; of several rows of a doc_id the one with the smallest text
    hash counts. So broadcast and collect are bounded by max_labelled rows alike."""
    picked = (
        labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").alias("_id")).agg(F.min("quality").alias("_quality"))
        .orderBy(F.xxhash64(F.lit(seed), "_id"), "_id").limit(max_labelled)
    )
    known = docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("_id"))
    measured = _let(statistics(F.col("text")), lambda s: F.struct(base_failed(s).alias("failed"), F.array(*[f(s) for f in FEATURES.values()]).alias("x")))
    rows = known.select("doc_id", (F.col("_quality") == 0).alias("bad"), measured.alias("s"), F.xxhash64("text").alias("h")).groupBy("doc_id", "bad").agg(F.min_by("s", "h").alias("s"))
    rows = sorted((i, tuple(s["x"]), bad) for i, bad, s in rows.collect() if not s["failed"])
    x = np.array([r[1] for r in rows], float).reshape(len(rows), len(FEATURES))
    return cover(x, np.array([r[2] for r in rows], bool), list(FEATURES), seed)


def judge(docs: DataFrame, labels: DataFrame, max_labelled: int = 6000, name: str = "judged") -> DataFrame:
    """docs' columns and a struct (under ``name``) of the statistics, base_failed and kept (false if base_failed, else
    the learned list's verdict)."""
    rules = learn(docs, labels, max_labelled)

    def verdict(s: Column) -> Column:
        return F.struct(*[s[n].alias(n) for n in STATISTICS], base_failed(s).alias("base_failed"), (~base_failed(s) & rules.keep(s)).alias("kept"))

    return docs.withColumn(name, _let(statistics(F.col("text")), verdict))
