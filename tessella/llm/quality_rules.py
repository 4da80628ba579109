"""Operator 7, quality rules: decision lists learned by sequential covering [native].

Text statistics are DataFrame expressions over whole texts. A decision list is
learned on the driver from the statistics of a bounded sample of labelled rows
(``LABELLED`` rows by id hash) and becomes one ordered CASE expression.

Defined results: null text has no words (all counts 0, base_failed, kept false);
an empty text likewise; rows are judged independently, so repeated rows get equal
results; without labels of both classes the list is empty and only the base rule
rejects; null doc_id rows are judged like any other; very long texts are read whole;
ties between conditions of equal gain go to the first feature and the least threshold;
an empty table gives no rows; extra columns, whatever their names, are ignored by the
query (``judge`` adds stats, base_failed, rule and kept, so give it a table without them).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import labelled_ids, let, once, table

#: Bound of the labelled sample a list is learned from.
LABELLED = 12_000
#: A rule must have at least this precision on the pruning rows, and this support there.
PRECISION, SUPPORT = 0.97, 8
MAX_RULES, MAX_CONDITIONS, THRESHOLDS = 16, 4, 48
_SPACE = " \t\n\u000b\f\r"
_SPLIT = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ of a text; none for null or blank text."""
    core = F.btrim(text, F.lit(_SPACE))
    return F.when(text.isNull() | (core == ""), F.array().cast("array<string>")).otherwise(F.split(core, _SPLIT))


def repeated_words(ws: Column) -> Column:
    """Words inside 3-word windows that occur at least twice in the text.

    Windows are compared by 64-bit hashes. Texts whose hashes are all different
    stop there; the others sort (hash, position), flag equal neighbours and
    measure the union of the flagged windows: O(n log n) for any text.
    """

    def covered(hs: Column) -> Column:
        pairs = F.sort_array(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def flagged(ps: Column) -> Column:
            hit = F.filter(ps, lambda s, j: (s["h"] == F.get(ps, j - 1)["h"]) | (s["h"] == F.get(ps, j + 1)["h"]))
            return F.sort_array(F.transform(hit, lambda s: s["i"]))

        def length(pos: Column) -> Column:
            steps = F.transform(pos, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(pos, k + 1) - p, F.lit(3))))
            return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

        return F.when(F.size(F.array_distinct(hs)) == F.size(hs), 0).otherwise(let(let(pairs, flagged), length))

    starts = F.sequence(F.lit(0), F.size(ws) - 3)
    hashes = F.transform(starts, lambda i: F.xxhash64(F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2)))
    return F.when(F.size(ws) < 4, 0).otherwise(let(hashes, covered))


def _count(text: Column, not_these: str) -> Column:
    return F.length(F.regexp_replace(text, not_these, ""))


def statistics(docs: DataFrame) -> DataFrame:
    """docs plus a struct column ``stats`` of whole-text statistics (longs)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(_SPACE)) != "")

    def of_words(ws: Column) -> Column:
        return F.struct(F.size(ws).alias("n"), repeated_words(ws).alias("rep"), F.size(F.array_distinct(ws)).alias("types"))

    w = let(words(F.col("text")), of_words)
    ln = let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))
    out = docs.withColumn("_w", w).withColumn("_l", ln)
    chars = _count(text, _SPLIT)
    return out.withColumn(
        "stats",
        F.struct(
            F.col("_w.n").cast("long").alias("n_words"),
            chars.cast("long").alias("word_chars"),
            _count(text, r"[^#*$%&|<>]+").cast("long").alias("n_symbols"),
            F.col("_l.dup").cast("long").alias("n_dup_lines"),
            F.col("_w.rep").cast("long").alias("n_repeat_words"),
            F.col("_w.types").cast("long").alias("n_types"),
            F.col("_l.n").cast("long").alias("n_lines"),
            _count(text, r"[^A-Z]+").cast("long").alias("n_upper"),
            _count(text, r"[^!?]+").cast("long").alias("n_shouts"),
            _count(text, r"[^0-9]+").cast("long").alias("n_digits"),
        ),
    ).drop("_w", "_l")


#: Features of the list: name -> (numerator, denominator) among the statistics; None: no denominator.
FEATURES = {
    "n_words": ("n_words", None),
    "mean_word": ("word_chars", "n_words"),
    "symbol_ratio": ("n_symbols", "word_chars"),
    "dup_line_ratio": ("n_dup_lines", "n_lines"),
    "repeat_ratio": ("n_repeat_words", "n_words"),
    "type_ratio": ("n_types", "n_words"),
    "upper_ratio": ("n_upper", "word_chars"),
    "shout_ratio": ("n_shouts", "word_chars"),
    "digit_ratio": ("n_digits", "word_chars"),
    "words_per_line": ("n_words", "n_lines"),
}


def feature(name: str, stats: str = "stats") -> Column:
    top, under = FEATURES[name]
    value = F.col(f"{stats}.{top}").cast("double")
    return value / F.greatest(F.col(f"{stats}.{under}"), F.lit(1)).cast("double") if under else value


@dataclass(frozen=True)
class Rule:
    """A conjunction of (feature, '<=' or '>', threshold) with its figures on the pruning rows."""

    conditions: tuple[tuple[str, str, float], ...]
    precision: float
    support: int

    def column(self, stats: str = "stats") -> Column:
        out = F.lit(True)
        for name, sign, t in self.conditions:
            out = out & (feature(name, stats) <= t if sign == "<=" else feature(name, stats) > t)
        return out


def _holds(x: np.ndarray, conditions) -> np.ndarray:
    mask = np.ones(len(x), bool)
    for f, sign, t in conditions:
        mask &= x[:, f] <= t if sign == "<=" else x[:, f] > t
    return mask


def learn(x: np.ndarray, bad: np.ndarray, names: list[str]) -> list[Rule]:
    """Ordered rules for the rejected class: grow by information gain on two thirds, prune on the last third.

    Each round covers rejected rows not yet covered; the first rule below
    PRECISION or SUPPORT on its pruning rows ends the list.
    """
    if not len(x) or bad.all() or not bad.any():
        return []
    fold = np.arange(len(x)) % 3 == 2
    left, rules = np.ones(len(x), bool), []
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, THRESHOLDS + 2)[1:-1])) for f in range(x.shape[1])]
    cuts = [np.unique(np.r_[c, np.quantile(x[bad, f], np.linspace(0, 1, THRESHOLDS + 2)[1:-1])]) for f, c in enumerate(cuts)]
    while len(rules) < MAX_RULES:
        grow, prune = left & ~fold, left & fold
        conditions: list[tuple[int, str, float]] = []
        mask = grow.copy()
        while len(conditions) < MAX_CONDITIONS and (mask & ~bad).any() and (mask & bad).any():
            p0, n0 = (mask & bad).sum(), (mask & ~bad).sum()
            best = (1e-9, None)
            for f, ts in enumerate(cuts):
                col, is_bad = x[mask, f], bad[mask]
                below = col[:, None] <= ts[None, :]
                for sign, hit in (("<=", below), (">", ~below)):
                    p, n = hit[is_bad].sum(0), hit[~is_bad].sum(0)
                    gain = np.where(p > 0, p * (np.log2((p + 1e-9) / (p + n + 1e-9)) - np.log2(p0 / (p0 + n0))), 0)
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (gain[k], (f, sign, float(ts[k])))
            if best[1] is None:
                break
            conditions.append(best[1])
            mask &= _holds(x, conditions[-1:])
        if not conditions:
            break

        def worth(c) -> float:
            m = prune & _holds(x, c)
            p, n = (m & bad).sum(), (m & ~bad).sum()
            return (p - n) / (p + n) if p + n else -1.0

        kept = max((conditions[:k] for k in range(len(conditions), 0, -1)), key=worth)
        m = prune & _holds(x, kept)
        p, n = int((m & bad).sum()), int((m & ~bad).sum())
        if p + n < SUPPORT or p < PRECISION * (p + n):
            break
        rules.append(Rule(tuple((names[f], s, t) for f, s, t in kept), p / (p + n), p + n))
        left &= ~_holds(x, kept)
    return rules


def fit(docs: DataFrame, labels: DataFrame) -> list[Rule]:
    """A list learned from at most LABELLED labelled documents (quality 0: reject)."""
    ids = labelled_ids(labels, "quality", LABELLED)
    sample = statistics(once(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id"), "label", "text"))
    names = list(FEATURES)
    rows = sample.select("doc_id", "label", *[feature(n).alias(n) for n in names]).collect()
    rows.sort(key=lambda r: ((r["doc_id"] * 2654435761) % 4294967296, r["doc_id"]))
    x = np.array([[r[n] for n in names] for r in rows], float).reshape(len(rows), len(names))
    return learn(x, np.array([r["label"] == 0 for r in rows], bool), names)


def verdict(rules: list[Rule], stats: str = "stats") -> Column:
    """Index (from 1) of the first rule of the ordered list that rejects a row; 0: none does."""
    out = F.lit(0)
    for k, rule in reversed(list(enumerate(rules, 1))):
        out = F.when(rule.column(stats), F.lit(k)).otherwise(out)
    return out


def base_failed(stats: str = "stats") -> Column:
    n, rep = F.col(f"{stats}.n_words"), F.col(f"{stats}.n_repeat_words")
    return (n < 50) | (100 * rep > 50 * n)


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """docs plus stats, base_failed, rule (0: none) and kept."""
    out = statistics(docs).withColumn("base_failed", base_failed())
    return out.withColumn("rule", verdict(rules)).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = fit(docs, table(spark, sf_dir, "labels"))
    out = judge(docs.select("doc_id", "text"), rules)
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return out.select("doc_id", *[F.col(f"stats.{c}") for c in base], "base_failed", "kept", "rule")


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op7 tells of a text before any rule is learned: its base columns and limits."""
    out = statistics(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumn("base_failed", base_failed())
    return out.select("doc_id", *[F.col(f"stats.{c}") for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], "base_failed")


ORACLE = {
    "quality_base": r"""
    with t as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
    g as (select doc_id, i, ws[i:i + 2] as g from t, unnest(range(1, len(ws) - 1)) u(i)),
    r as (select doc_id, i from g join (select doc_id, g from g group by all having count(*) > 1) using (doc_id, g)),
    c as (select doc_id, count(distinct i + d) as n from r, range(3) t(d) group by doc_id),
    l as (select doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from t),
    b as (select doc_id, len(ws) as n_words, coalesce(list_sum(list_transform(ws, lambda w: len(w))), 0)::bigint as word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) as n_symbols,
      len(ls) - len(list_distinct(ls)) as n_dup_lines, coalesce(n, 0) as n_repeat_words from t join l using (doc_id) left join c using (doc_id))
    select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from b
    """
}
