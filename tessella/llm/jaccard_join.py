"""Operator 9, n-gram Jaccard join: prefix filters under several global token orders.

A document is the set of its hashed word shingles (64 bits). Under any global order of
tokens, two sets of Jaccard similarity t or more share a token among the first
n - ceil(t * n) + 1 of each. Orders: rising document frequency - read from a counting
sketch over all documents, of a fixed size - and permutations of the hashes.

1. Equal sets become one class, named by its smallest doc_id.
2. An inverted index of prefix tokens under the frequency order, reduced to tokens
   that several classes share.
3. Within a token's classes, one pivot - the class with the fewest rarer tokens before
   it, as the original of many near copies has - is compared with all others: as many
   pairs as index rows, so a large group of near copies costs no square. Links merge
   classes. A second round takes a pivot of another component.
4. What is left - classes that share a token and are in different components yet - is
   compared pair by pair, the shorter with the longer. The shorter set of a link has
   the first shared token among its first n - ceil(2t / (1 + t) * n) + 1, and what
   stands behind the token in both sets must suffice; both are join conditions. So no
   link between components is lost.

Candidates must also share a prefix token under every other order. These prefixes are
written with the first ones, as 32-bit names of their tokens, and a candidate pair is
dropped in the JVM when they are disjoint under any order, before whole sets are made;
names that happen to be equal let a pair through, never drop one. Pairs that pass all
filters are verified by their whole sets. Components are found over the links. ``report``
takes the numbers of pairs before and behind each filter.

``classes`` needs components alone, so steps 3 and 4 skip pairs whose classes have met
already. ``links`` skips none: it is the join itself, every link between two classes,
with the documents of each class; as many rows as there are links, whatever the group.

Defined results: null and empty texts have an empty set, link with nothing and are
their own component; texts of fewer than k words are one shingle of all words; rows
of equal doc_id are one document (links of any of its texts count); rows with null
doc_id link with nothing and have a null component; very long texts are taken whole; a
component is named by its smallest doc_id, so ties cannot occur; an empty table gives no
rows; extra columns are ignored, and kept by ``keep_one``, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest, xxh3_128_digest

from .common import Scratch, sized, table, text_batches
from .graph import components

#: Words of a shingle and percent of similarity where no contract says otherwise.
WORDS, PERCENT = 5, 80
#: The frequency sketch has 2**SKETCH_BITS counters, sent in blocks of 2**BLOCK_BITS.
SKETCH_BITS, BLOCK_BITS = 22, 14
#: Blobs of a block that are added at once, and levels of such groups: for FAN ** (LEVELS + 1) tasks.
FAN, LEVELS = 256, 2
#: Odd multipliers; each permutes the hashes into one more global order.
ORDERS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
OTHERS = tuple(f"prefix{i}" for i in range(1, len(ORDERS) + 1))
_MIX = [np.uint64(x) for x in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x9FB21C651E98DF25, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of a text's k-word shingles; A-Z lower-cased, words split at ASCII white space."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, n)
    size = min(k, n)
    out = np.full(n - size + 1, size, np.uint64)
    for i in range(size):
        out = (out ^ h[i : n - size + 1 + i]) * _MIX[i % len(_MIX)]
        out ^= out >> np.uint64(31)
    return np.unique(out)


def prefix_size(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1


def _lists(arrays: list[np.ndarray], kind: type = np.int64) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    flat = np.concatenate(arrays).view(kind) if arrays else np.empty(0, kind)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def frequencies(docs: DataFrame, k: int) -> np.ndarray:
    """Rank of document frequency by sketch counter (eighths of doublings, one byte each), over all documents."""
    size, block = 1 << SKETCH_BITS, 1 << BLOCK_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        found = np.zeros(size, np.uint32)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                np.add.at(found, (shingles(text, k) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
        task = TaskContext.get().partitionId() // FAN
        for b in range(size // block):
            part = found[b * block : (b + 1) * block]
            if part.any():
                data = pa.array([zlib.compress(part.astype(np.uint64).tobytes(), 1)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([task], pa.int32()), data], names=["block", "salt", "data"])

    def add(rows: pa.Table) -> pa.Table:
        total = np.zeros(block, np.uint64)
        for data in rows["data"]:
            total += np.frombuffer(zlib.decompress(data.as_py()), np.uint64)
        return pa.table({"block": rows["block"][:1], "salt": rows["salt"][:1], "data": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    kind = "block int, salt int, data binary"
    parts = text_batches(docs).select("text").mapInArrow(count, kind)
    for _ in range(LEVELS):  # a tree: no group holds more than FAN blobs of a block
        parts = parts.groupBy("block", "salt").applyInArrow(add, kind).withColumn("salt", F.floor(F.col("salt") / FAN).cast("int"))
    out = np.zeros(size, np.uint64)
    for row in parts.groupBy("block").applyInArrow(add, kind).collect():
        out[row["block"] * block : (row["block"] + 1) * block] = np.frombuffer(zlib.decompress(row["data"]), np.uint64)
    return np.minimum(255, 8 * np.log2(1 + out.astype(np.float64))).astype(np.uint8)


def prefixes(docs: DataFrame, k: int, percent: int, rank: np.ndarray) -> DataFrame:
    """doc_id, n, h1, h2 (a 128-bit name of the set), the prefix under the frequency order, and under each other order its tokens' 32-bit names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, names, first, others = [], [], [], [[] for _ in ORDERS]
            for text in batch.column(1).to_pylist():
                s = shingles(text, k)
                p = prefix_size(len(s), percent) if len(s) else 0
                n.append(len(s))
                names.append(np.frombuffer(xxh3_128_digest(s.tobytes()), np.int64))
                by = rank[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                first.append(s[np.argsort(by, kind="stable")[:p]])
                for odd, found in zip(ORDERS, others, strict=True):
                    turned = s * np.uint64(odd)
                    turned = np.partition(turned, p - 1)[:p] if p < len(turned) else turned
                    found.append(np.sort((turned * _MIX[0] >> np.uint64(32)).astype(np.uint32)))
            two = np.array(names, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(two[:, 0]), pa.array(two[:, 1]), _lists(first), *(_lists(x, np.int32) for x in others)],
                names=["doc_id", "n", "h1", "h2", "prefix", *OTHERS],
            )

    kind = "doc_id long, n long, h1 long, h2 long, prefix array<long>, " + ", ".join(f"{o} array<int>" for o in OTHERS)
    return text_batches(docs).select("doc_id", "text").mapInArrow(run, kind)


def meeting(pairs: DataFrame, sides: DataFrame) -> DataFrame:
    """The pairs (a, b) that share a prefix token under every order of ORDERS; sides: id and a prefix per order.

    A pair comes once for each two sets of its ids that do. What follows must not depend on how
    the joins are partitioned: many pairs have one pivot, and Spark splits such a join only then.
    """
    out = pairs
    for s in ("a", "b"):
        out = out.join(sides.select(F.col("id").alias(s), *[F.col(o).alias(f"{s}_{o}") for o in OTHERS]), s)
    for o in OTHERS:
        out = out.where(F.arrays_overlap(f"a_{o}", f"b_{o}"))
    return out.select("a", "b")


def whole_sets(docs: DataFrame, k: int) -> DataFrame:
    """id and its whole set with the set's 128-bit name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t, k) for t in batch.column(1).to_pylist()]
            two = np.array([np.frombuffer(xxh3_128_digest(s.tobytes()), np.int64) for s in sets], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(two[:, 0]), pa.array(two[:, 1]), _lists(sets)], names=["id", "h1", "h2", "tokens"])

    return text_batches(docs).select("doc_id", "text").mapInArrow(run, "id long, h1 long, h2 long, tokens array<long>")


def _views(column: pa.Array) -> list[np.ndarray]:
    ends, flat = np.asarray(column.offsets), np.asarray(column.values).view(np.uint64)
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sets reach the similarity."""
    same = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * same >= percent * (len(x) + len(y) - same)


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that reach the similarity."""
    side = lambda s: sets.select(F.col("id").alias(s), F.col("tokens").alias(f"{s}_tokens"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_tokens", "b_tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = zip(_views(batch.column(2)), _views(batch.column(3)), strict=True)
            keep = [i for i, (x, y) in enumerate(tokens) if similar(x, y, percent)]
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return text_batches(both).mapInArrow(run, "a long, b long")


def _short_prefix(n: Column, percent: int) -> Column:
    """Length of the prefix that holds a shared token of the shorter set of a link: n - ceil(2t / (1 + t) * n) + 1."""
    return n - F.ceil(n * F.lit(2 * percent) / F.lit(100 + percent) - F.lit(1e-9)) + 1


def _possible(one: str, two: str, percent: int) -> Column:
    """Lengths, and what is left behind the positions of the first shared token, admit the similarity."""
    n, m, i, j = (F.col(c) for c in (f"{one}n", f"{two}n", f"{one}pos", f"{two}pos"))
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & ((100 + percent) * F.least(n - i, m - j) >= percent * (n + m))


def _pairwise(index: DataFrame, percent: int, names: tuple[str, ...], apart: Column | None = None) -> DataFrame:
    """Pairs (x_*, y_*) of index rows that share a token, the shorter with the longer, that the position filters admit."""
    x = index.where("short").select("token", *[F.col(c).alias(f"x_{c}") for c in names])
    y = index.select("token", *[F.col(c).alias(f"y_{c}") for c in names])
    longer = (F.col("x_n") < F.col("y_n")) | ((F.col("x_n") == F.col("y_n")) & (F.col("x_id") < F.col("y_id")))
    also = longer & _possible("x_", "y_", percent)
    return x.join(y, (x["token"] == y["token"]) & (also if apart is None else also & apart))


def _told(report: dict | None, name: str, pairs: DataFrame) -> None:
    if report is not None:
        report[name] = report.get(name, 0) + pairs.count()


def links(docs: DataFrame, k: int = WORDS, percent: int = PERCENT, report: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """The whole join: (links, members); docs has doc_id and text.

    links: a, b (two classes, a < b) and a_doc, b_doc (their smallest doc_ids), one row for each pair
    of different sets that reach the similarity. members: doc_id, class and n_shingles of each document
    with words and an id; documents of one class are equal sets. Every candidate pair is verified.
    """
    scratch = Scratch(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = scratch.save(prefixes(docs, k, percent, frequencies(docs, k)).where("n > 0 and doc_id is not null"), "rows")
    # texts of one doc_id may be of several classes, so a class has a number of its own
    reps = rows.groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("doc_id"), *[F.first(c).alias(c) for c in ("prefix", *OTHERS)])
    reps = scratch.save(reps.withColumn("id", F.monotonically_increasing_id()), "reps")
    index = reps.select("id", "n", F.posexplode("prefix").alias("pos", "token")).withColumn("short", F.col("pos") < _short_prefix(F.col("n"), percent))
    shared = index.groupBy("token").agg(F.count("*").alias("c"), F.max("short").alias("s")).where("c > 1 and s").select("token")
    index = scratch.save(index.join(sized(scratch.save(shared, "shared")), "token"), "index")
    pairs = _pairwise(index, percent, ("id", "n", "pos")).select(F.least("x_id", "y_id").alias("a"), F.greatest("x_id", "y_id").alias("b"))
    found = scratch.save(pairs.distinct(), "found-pairs")
    pairs = scratch.save(meeting(found, reps), "pairs")
    _told(report, "candidates", found)
    _told(report, "under every order", pairs)
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    some = scratch.save(reps.join(ids, "id").select("id", "doc_id", "h1", "h2"), "some")
    sets = whole_sets(docs.join(sized(some.select("doc_id").distinct()), "doc_id", "left_semi"), k).withColumnRenamed("id", "doc_id")
    sets = scratch.save(sets.join(sized(some), ["doc_id", "h1", "h2"]).select("id", "tokens").dropDuplicates(["id"]), "sets")
    found = scratch.save(linked(pairs, sets, percent), "links")
    _told(report, "linked", found)
    for s in ("a", "b"):
        found = found.join(some.select(F.col("id").alias(s), F.col("doc_id").alias(f"{s}_doc")), s)
    found = scratch.save(found.select("a", "b", "a_doc", "b_doc"), "found")
    members = rows.select("doc_id", "h1", "h2", "n").distinct().join(reps.select("h1", "h2", "n", "id"), ["h1", "h2", "n"])
    members = scratch.save(members.select("doc_id", F.col("id").alias("class"), F.col("n").alias("n_shingles")), "members")
    scratch.drop("rows", "reps", "shared", "index", "found-pairs", "pairs", "some", "sets", "links")
    return found, members


def classes(docs: DataFrame, k: int = WORDS, percent: int = PERCENT, report: dict | None = None) -> DataFrame:
    """doc_id, n_shingles and component_id of every row, of links enough to tell components; docs has doc_id and text."""
    scratch = Scratch(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rank = frequencies(docs, k)
    rows = scratch.save(prefixes(docs, k, percent, rank), "rows")
    sides = rows.where("n > 0 and doc_id is not null").select(F.col("doc_id").alias("id"), *OTHERS)
    some = rows.where("n > 0 and doc_id is not null").select("h1", "h2", "n", "doc_id")
    named = scratch.save(some.groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("id")), "named")
    # of each class only the smallest id is indexed; the few others are told by a small table, so that prefixes stay where they are
    others = some.join(named, ["h1", "h2", "n"]).where("doc_id > id").select("doc_id", "h1", "h2").distinct()
    others = sized(scratch.save(others, "others"))
    reps = rows.where("n > 0 and doc_id is not null").join(others, ["doc_id", "h1", "h2"], "left_anti")
    index = reps.select(F.col("doc_id").alias("id"), "n", F.posexplode("prefix").alias("pos", "token")).withColumn("short", F.col("pos") < _short_prefix(F.col("n"), percent))
    shared = index.groupBy("token").agg(F.count("*").alias("c"), F.max("short").alias("s")).where("c > 1 and s").select("token")
    index = scratch.save(index.join(sized(scratch.save(shared, "shared")), "token"), "index")
    low = F.min(F.when(F.col("short"), F.struct("pos", "n", "id"))).alias("low")
    pivots = index.groupBy("token").agg(low, F.count("*").alias("c"), F.min("id").alias("x"), F.max("id").alias("y")).where("low is not null and x < y")
    pivots = scratch.save(pivots.select("token", "c", *[F.col(f"low.{c}").alias(f"p_{c}") for c in ("id", "n", "pos")]), "pivots")
    seen, links = None, None

    def compare(pairs: DataFrame, name: str) -> None:
        """Verifies pairs that were not compared before, and adds their links."""
        nonlocal seen, links
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        if seen is not None:
            pairs = pairs.join(seen, ["a", "b"], "left_anti")
        pairs = scratch.save(pairs, f"pairs-{name}")
        both = lambda p: p.select(F.col("a").alias("id")).unionByName(p.select(F.col("b").alias("id"))).distinct()
        ids = scratch.save(both(pairs), f"ids-{name}")
        met = scratch.save(meeting(pairs, sides.join(sized(ids), "id", "left_semi")), f"met-{name}").distinct()
        ids = scratch.save(both(met).withColumnRenamed("id", "doc_id"), f"met-ids-{name}")
        sets = scratch.save(whole_sets(docs.join(sized(ids), "doc_id", "left_semi"), k), f"sets-{name}")
        new = scratch.save(linked(met, sets, percent), f"links-{name}")
        for what, some in (("candidates", pairs), ("under every order", met), ("linked", new)):
            _told(report, what, some)
        scratch.drop(*[f"{what}-{name}" for what in ("sets", "ids", "met", "met-ids")])
        seen = pairs if seen is None else seen.unionByName(pairs)
        links = new if links is None else links.unionByName(new)

    star = (F.col("id") != F.col("p_id")) & _possible("", "p_", percent)
    compare(index.join(pivots, "token").where(star).select(F.col("p_id").alias("a"), F.col("id").alias("b")), "pivot")
    # two classes that share a token have been compared; only larger groups go on
    index = scratch.save(index.join(sized(pivots.where("c > 2").select("token")), "token", "left_semi"), "deep")
    for turn in ("other", "rest"):
        comps = scratch.save(components(links, scratch, f"cc-{turn}"), f"comps-{turn}")
        placed = index.join(comps, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
        first = F.min(F.struct("pos", "comp")).alias("p")
        split = placed.groupBy("token").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.max("short").alias("s"), first).where("x < y and s")
        split = scratch.save(split.select("token", F.col("p.comp").alias("p_comp")), f"split-{turn}")
        mixed = placed.join(split, "token")
        if turn == "other":
            mixed = scratch.save(mixed, "mixed-other")
            second = mixed.where(F.col("short") & (F.col("comp") != F.col("p_comp"))).groupBy("token").agg(F.min(F.struct("pos", "n", "id", "comp")).alias("q"))
            second = scratch.save(second.select("token", *[F.col(f"q.{c}").alias(f"q_{c}") for c in ("id", "n", "pos", "comp")]), "second")
            met = mixed.join(second, "token").where((F.col("comp") != F.col("q_comp")) & _possible("", "q_", percent))
            compare(met.select(F.col("q_id").alias("a"), F.col("id").alias("b")), turn)
            continue
        names = ("id", "n", "pos", "comp")
        mixed = scratch.save(mixed.select("token", "short", *names), "mixed")
        met = _pairwise(mixed, percent, names, F.col("x_comp") != F.col("y_comp"))
        compare(met.select(F.col("x_id").alias("a"), F.col("y_id").alias("b")), turn)
    comps = scratch.save(components(links, scratch, "cc"), "comps")
    named = named.withColumnRenamed("id", "rep").join(comps.withColumnRenamed("id", "rep"), "rep", "left").select("h1", "h2", "n", F.coalesce("comp", "rep").alias("comp"))
    named = scratch.save(named, "class-components")
    scratch.drop("named", "others", "shared", "index", "pivots", "deep", "mixed", "mixed-other", "second", "comps")
    scratch.drop(*[f"{what}-{turn}" for what in ("pairs", "links", "split", "comps") for turn in ("pivot", "other", "rest")])
    out = rows.select("doc_id", "n", "h1", "h2").join(named, ["h1", "h2", "n"], "left")
    found = F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), found.alias("component_id"))


def keep_one(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs without those that have a smaller doc_id in their component; rows with null ids stay, equal ids once."""
    scratch = Scratch(docs.sparkSession)
    found = scratch.save(classes(docs, k, percent), "classes")
    gone = scratch.save(found.where("component_id < doc_id").select("doc_id").distinct(), "gone")
    out = docs.join(sized(gone), "doc_id", "left_anti").select(docs.columns)
    twice = scratch.save(found.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "twice")
    if twice.isEmpty():
        return out
    once = out.join(sized(twice), "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*[c for c in docs.columns if c != "doc_id"])).alias("_r"))
    return out.join(sized(twice), "doc_id", "left_anti").select(docs.columns).unionByName(once.select("doc_id", "_r.*").select(docs.columns))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"), 4, 85)


ORACLE = {
    "op9_jaccard_join": r"""
    with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
    d as (select doc_id, case when len(ws) = 0 then [] when len(ws) < 4 then [array_to_string(ws, ' ')] else list_distinct([array_to_string(ws[i:i + 3], ' ') for i in range(1, len(ws) - 2)]) end as sh from w),
    s as (select doc_id, unnest(sh) as sh, len(sh) as n from d),
    p as (select a.doc_id as x, b.doc_id as y, any_value(a.n) as nx, any_value(b.n) as ny, count(*) as k from s a join s b on a.sh = b.sh and a.doc_id < b.doc_id group by 1, 2),
    l as (select x, y from p where 100 * k >= 85 * (nx + ny - k)), e as (select x, y from l union all select y, x from l),
    r(doc_id, root) as (select doc_id, doc_id from d union select e.y, r.root from r join e on e.x = r.doc_id)
    select d.doc_id, any_value(len(sh)) as n_shingles, min(root) as component_id from d join r on r.doc_id = d.doc_id group by d.doc_id
    """
}
