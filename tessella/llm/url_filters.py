"""Operator 10, URL filters: prefix rules, then gradient-boosted trees on lexical features [native].

Host, path, rules, features, suffix statistics and scores are DataFrame
expressions. Suffix statistics (how many URLs share the last label and the last two
labels of the host) are counted over all rows; features are computed of the rows that
need them, the bounded sample or those to be judged. Trees are fitted on the driver, by
histograms of binned features and second-order gains, from at most LABELLED
labelled rows; a quarter of them is set aside and decides how many trees are kept,
so labels that the features tell nothing about leave the base rate alone. Scoring
is one Spark expression.

A URL's label is that of the document whose number ends its path: blocked where
``labels.quality`` is 0.

Defined results: null and empty URLs and URLs without ``://`` have empty host and path
and no rule, and are judged by the trees like any other; rules of equal length go to the
first by name; without labels of both classes the score is the share of blocked
labels (0 without labels); repeated rows get equal results; very long URLs are read
whole; of splits of equal gain the first feature and the least threshold is taken; an
empty table gives no rows; extra columns are ignored by the query, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, least_by_hash, let, sized, table

#: Bound of the labelled sample that is fitted.
LABELLED = 20_000
TREES, DEPTH, RATE, BINS, LEAF, RIDGE = 24, 3, 0.2, 32, 40.0, 5.0
THRESHOLD = 0.5
#: Fixed values of the contract: (rule, verdict).
RULES = (
    ("com/en/", "block"),
    ("example.com/en/7", "allow"),
    ("example.net/de/8", "block"),
    ("net/de/", "allow"),
    ("org/es/", "block"),
)
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_and_path(url: Column) -> tuple[Column, Column]:
    text = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(text, _URL, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(text, _URL, 2)


def matched(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, says in sorted(rules, key=lambda r: (len(r[0]), [-ord(c) for c in r[0]])):
        at, _, rest = name.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, F.lit(name)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


FEATURES = ("length", "host_length", "depth", "labels", "digit_ratio", "mark_ratio", "entropy", "params", "secure", "suffix_share", "domain_share")


def _entropy(text: Column) -> Column:
    """Bits per character of a text; 0 for an empty one."""
    kinds = F.array_distinct(F.split(text, ""))
    share = lambda c: (F.length(text) - F.length(F.replace(text, c, F.lit("")))) / F.length(text)
    bits = F.aggregate(F.transform(kinds, share), F.lit(0.0), lambda a, p: a - F.when(p > 0, p * F.log2(p)).otherwise(0.0))
    return F.when(F.length(text) > 0, bits).otherwise(0.0)


def _suffix(n: int) -> Column:
    """The last n labels of a host."""
    return F.substring_index(host_and_path(F.col("url"))[0], ".", -n)


@dataclass
class Suffixes:
    """How many URLs share the last label (_one, _n1) and the last two labels (_two, _n2), and how many there are."""

    ones: DataFrame
    twos: DataFrame
    total: int


def suffixes(pages: DataFrame) -> Suffixes:
    """Counts over all rows, pre-aggregated by Spark before the shuffle and written to scratch."""
    scratch = Scratch(pages.sparkSession)
    twos = pages.groupBy(_suffix(1).alias("_one"), _suffix(2).alias("_two")).agg(F.count("*").alias("_n2"))
    twos = scratch.save(twos, "twos")
    ones = scratch.save(twos.groupBy("_one").agg(F.sum("_n2").alias("_n1")), "ones")
    return Suffixes(ones, twos, ones.agg(F.sum("_n1")).first()[0] or 1)


def with_features(pages: DataFrame, known: Suffixes) -> DataFrame:
    """pages plus host, path and a struct ``x`` of FEATURES; pages has a column url."""
    host, path = host_and_path(F.col("url"))
    out = pages.withColumn("_one", _suffix(1)).withColumn("_two", _suffix(2))
    out = out.join(sized(known.ones), "_one", "left").join(sized(known.twos), ["_one", "_two"], "left")
    out = out.withColumn("host", host).withColumn("path", path)
    url = F.coalesce(F.col("url"), F.lit(""))
    ratio = lambda keep: F.length(F.regexp_replace(url, keep, "")) / F.greatest(F.length(url), F.lit(1))
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    values = {
        "length": F.length(url),
        "host_length": F.length("host"),
        "depth": F.size(F.filter(F.split("path", "/"), lambda s: s != "")),
        "labels": F.size(F.split("host", r"\.")),
        "digit_ratio": ratio("[^0-9]+"),
        "mark_ratio": ratio("[A-Za-z0-9]+"),
        "entropy": let(url, _entropy),
        "params": F.when(query == "", 0).otherwise(F.size(F.split(query, "&"))),
        "secure": url.startswith("https").cast("int"),
        "suffix_share": F.coalesce("_n1", F.lit(0)) / F.lit(known.total),
        "domain_share": F.coalesce("_n2", F.lit(0)) / F.lit(known.total),
    }
    x = F.struct(*[values[n].cast("double").alias(n) for n in FEATURES])
    return out.withColumn("x", x).drop("_one", "_two", "_n1", "_n2")


@dataclass
class Tree:
    """A split (feature, threshold; left where x <= threshold) or a leaf's value."""

    value: float = 0.0
    feature: int = -1
    threshold: float = 0.0
    sides: tuple[Tree, Tree] | None = None

    def column(self, x: str = "x") -> Column:
        if not self.sides:
            return F.lit(float(self.value))
        left, right = (s.column(x) for s in self.sides)
        return F.when(F.col(f"{x}.{FEATURES[self.feature]}") <= self.threshold, left).otherwise(right)

    def values(self, x: np.ndarray) -> np.ndarray:
        if not self.sides:
            return np.full(len(x), self.value)
        left, right = (s.values(x) for s in self.sides)
        return np.where(x[:, self.feature] <= self.threshold, left, right)


@dataclass
class Boosted:
    start: float
    trees: list[Tree] = field(default_factory=list)

    def score(self, x: str = "x") -> Column:
        """Probability of block."""
        margin = F.lit(self.start)
        for tree in self.trees:
            margin = margin + tree.column(x)
        return 1 / (1 + F.exp(-margin))


def _grow(x, binned, cuts, g, h, rows, depth: int) -> Tree:
    """Second-order gains from gradient histograms; a split needs LEAF rows on either side."""
    total_g, total_h = g[rows].sum(), h[rows].sum()
    leaf = Tree(value=float(-RATE * total_g / (total_h + RIDGE)))
    if not depth or len(rows) < 2 * LEAF:
        return leaf
    best, whole = (1e-6, -1, 0), total_g**2 / (total_h + RIDGE)
    for f, edges in enumerate(cuts):
        if not len(edges):
            continue
        b = binned[rows, f]
        gs, hs, ns = (np.cumsum(np.bincount(b, weights=w, minlength=len(edges) + 1))[:-1] for w in (g[rows], h[rows], np.ones(len(rows))))
        gain = gs**2 / (hs + RIDGE) + (total_g - gs) ** 2 / (total_h - hs + RIDGE) - whole
        gain[(ns < LEAF) | (len(rows) - ns < LEAF)] = -1
        k = int(gain.argmax())
        if gain[k] > best[0]:
            best = (gain[k], f, k)
    if best[1] < 0:
        return leaf
    left = binned[rows, best[1]] <= best[2]
    return Tree(feature=best[1], threshold=float(cuts[best[1]][best[2]]), sides=tuple(_grow(x, binned, cuts, g, h, rows[m], depth - 1) for m in (left, ~left)))


def learn(x: np.ndarray, y: np.ndarray) -> Boosted:
    """Trees boosted on three quarters, as many of them kept as serve the last quarter best."""
    if not len(y) or y.min() == y.max():
        return Boosted(40.0 if len(y) and y[0] else -40.0)
    p = float(y.mean())
    out = Boosted(float(np.log(p / (1 - p))))
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(cuts, x.T, strict=True)], 1)
    aside = np.arange(len(y)) % 4 == 3
    rows, margin = np.flatnonzero(~aside), np.full(len(y), out.start)
    loss = lambda: float(np.logaddexp(0, np.where(y[aside] > 0, -margin[aside], margin[aside])).mean())
    losses = [loss()]
    for _ in range(TREES):
        q = 1 / (1 + np.exp(-margin))
        out.trees.append(_grow(x, binned, cuts, q - y, q * (1 - q), rows, DEPTH))
        margin += out.trees[-1].values(x)
        losses.append(loss())
    best = int(np.argmin(losses))
    out.trees = out.trees[: best if losses[best] < losses[0] - 1e-4 else 0]
    return out


def labelled(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """page_id, url and label (1: block) of at most LABELLED pages, the smallest by a hash of page and URL."""
    doc = F.regexp_extract(F.coalesce("url", F.lit("")), r"/([0-9]{1,18})(?:\.html)?/?(?:[?#]|$)", 1)
    urls = pages.select("page_id", "url", F.nullif(doc, F.lit("")).try_cast("long").alias("doc_id"))
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("q"))
    rows = urls.join(known, "doc_id").select("page_id", "url", (F.col("q") == 0).cast("int").alias("label"))
    return least_by_hash(rows, F.xxhash64("page_id", "url"), LABELLED, "page_id", "url")


def fit(sample: DataFrame, known: Suffixes) -> Boosted:
    """Trees of a bounded sample (page_id, url, label); a page and URL that is there more than once counts once."""
    rows = with_features(sample.dropDuplicates(["page_id", "url"]), known).select("page_id", "url", "label", "x.*").collect()
    rows.sort(key=lambda r: ((r["page_id"] or 0) * 2654435761 % 4294967296, r["page_id"] or 0, r["url"] or ""))
    x = np.array([[r[n] for n in FEATURES] for r in rows], float).reshape(len(rows), len(FEATURES))
    return learn(x, np.array([r["label"] for r in rows], float))


def judge(featured: DataFrame, model: Boosted, rules=RULES) -> DataFrame:
    """featured plus rule, score and verdict: the rule's, else block from THRESHOLD on."""
    rule, says = matched(F.col("host"), F.col("path"), rules)
    out = featured.withColumn("rule", rule).withColumn("_says", says).withColumn("score", model.score())
    return out.withColumn("verdict", F.coalesce("_says", F.when(F.col("score") >= THRESHOLD, F.lit("block")).otherwise(F.lit("allow")))).drop("_says")


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    known = suffixes(pages)
    model = fit(labelled(pages, table(spark, sf_dir, "labels")), known)
    return judge(with_features(pages, known), model).select("page_id", "host", "path", "rule", "verdict", "score")


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op10 tells of a URL before any tree: host, path, and the longest rule that fits with what it says."""
    host, path = host_and_path(F.col("url"))
    rule, says = matched(F.col("host"), F.col("path"))
    out = table(spark, sf_dir, "pages").select("page_id", host.alias("host"), path.alias("path"))
    return out.select("page_id", "host", "path", rule.alias("rule"), says.alias("says"))


ORACLE = {
    "url_rules": rf"""
    with r(rule, says) as (values {", ".join(f"('{n}', '{v}')" for n, v in RULES)}),
    p as (select page_id, translate(regexp_extract(coalesce(url, ''), '{_URL}', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(coalesce(url, ''), '{_URL}', 2) as path from pages),
    m as (select page_id, host, path, max_by(rule, len(rule)) as rule, max_by(says, len(rule)) as says from p join r on (host = split_part(rule, '/', 1) or ends_with(host, '.' || split_part(rule, '/', 1))) and starts_with(path, substr(rule, strpos(rule, '/'))) group by all)
    select p.page_id, p.host, p.path, rule, says from p left join (select distinct host, path, rule, says from m) m on m.host = p.host and m.path = p.path
    """
}
