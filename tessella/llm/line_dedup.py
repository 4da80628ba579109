"""Operator 8, line dedup: deletion-neighbourhood join over words [native].

A line is what ``\n`` splits off, without white space around it; its words are what
white space separates, and each code point of a script that is written without blanks
(SCRIPTS). Of equal lines that are not blank, the earliest (by doc_id, then place) stays;
likewise of lines of ``near_words`` words or more that one edit of a word (change, insert,
delete) turns into another, or that have the same words. ``near_words`` (NEAR_WORDS where
none is given) may be any number from 1: below some words, one edit makes another line.

1. Lines become hashes; equal lines become one, with its earliest place.
2. Two lines within one edit share their first or last half; lines that share no half
   with another go no further.
3. The others emit their deletion neighbourhood (in the half that is not shared) as
   hashed keys: a line of n words emits each variant with one word gone, as (n - 1,
   place, words before, words behind), and itself with a gap at each place, as (n,
   place, before, behind). Lines that share a
   key are one edit apart at that place, whichever two of them; so each is compared with
   the earliest alone, as many pairs as keys.
4. The edit is verified on the words, and lines with an earlier partner go.
5. Each document is joined with the places of its lines that go.

Keys of before and behind are chained over blocks of BLOCK words, so a line of n words
costs n * (BLOCK + n / BLOCK) hash steps.

Defined results: null texts stay null, empty texts empty; blank lines always stay; rows
with null doc_id keep all lines and take no part; rows of one doc_id are one document: a
line that is first in it stays in each of them. A text whose lines all go is empty. Line ends stay as they
are between lines that stay. Very long texts and lines are taken whole. An empty table
gives no rows. Extra columns are kept in ``row``, whatever their names.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, let, sized, table

#: Words of a line that may go for a near copy, where no other number is given.
NEAR_WORDS = 10
#: Code points of scripts without blanks between words: Thai, Lao, Myanmar, Khmer, kana, Han.
SCRIPTS = r"\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3041-\u30FF\u31F0-\u31FF\u3400-\u4DBF\u4E00-\u9FFF\uF900-\uFAFF\uFF66-\uFF9F\x{20000}-\x{3FFFF}"
BLOCK = 64
HALVES = ("k0", "k1", "k2", "k3")


def bare(line: Column) -> Column:
    """A line without white space around it."""
    return F.btrim(line, F.lit(" \t\n\u000b\f\r"))


def spaced(line: Column) -> Column:
    """The words of a bare line with one blank between them."""
    apart = F.when(F.octet_length(line) > F.char_length(line), F.regexp_replace(line, f"([{SCRIPTS}])", " $1 ")).otherwise(line)
    return F.when(apart.rlike(r"[\t\x0B\f\r]|  |^ | $"), F.btrim(F.regexp_replace(apart, r"[\x20\t\x0B\f\r]+", " "))).otherwise(apart)


def _half(side: int, m: Column, near_words: int) -> Column:
    """Key of the first (0) or last (1) half of a line that is the shorter (m = n) or longer (m = n - 1) of two."""
    g = F.greatest(F.floor((m - 1) / 2).cast("int"), F.lit(0))
    return F.when(m >= near_words, F.xxhash64(F.lit(side), m, F.call_function("substring_index", F.col("spaced"), F.lit(" "), -g if side else g)))


def lines(docs: DataFrame, near_words: int = NEAR_WORDS) -> DataFrame:
    """doc_id, pos, h1, h2 (a 128-bit name of the line) and half keys of each line that is not blank."""
    one = docs.where("doc_id is not null and text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    one = one.select("doc_id", "pos", bare(F.col("line")).alias("bare")).where("bare <> ''")
    one = one.withColumn("spaced", spaced(F.col("bare")))
    one = one.withColumn("n", F.octet_length("spaced") - F.octet_length(F.replace("spaced", F.lit(" "), F.lit(""))) + 1)
    n = F.col("n")
    halves = [_half(k % 2, n - k // 2, near_words).alias(f"k{k}") for k in range(4)]
    return one.select("doc_id", "pos", F.xxhash64("bare").alias("h1"), F.xxhash64(F.lit(1), "bare").alias("h2"), *halves)


def _chained(hashes: Column) -> Column:
    """Hashes of the first 0, 1, ..., n elements, by blocks."""
    n = F.size(hashes)
    blocks = F.transform(F.sequence(F.lit(0), F.floor(n / BLOCK).cast("int")), lambda b: F.xxhash64(F.slice(hashes, 1, b * BLOCK)))

    def of(bs: Column) -> Column:
        at = lambda i: F.floor(i / BLOCK).cast("int")
        return F.transform(F.sequence(F.lit(0), n), lambda i: F.xxhash64(F.get(bs, at(i)), F.slice(hashes, at(i) * BLOCK + 1, i % BLOCK)))

    return let(blocks, of)


def _variants(ws: Column, low: Column, high: Column) -> Column:
    """Keys of the deletion neighbourhood of a line, at places from low to high."""

    def of(hashes: Column) -> Column:
        n = F.size(hashes)

        def keys(c: Column) -> Column:
            before, behind = c["before"], c["behind"]
            gone = F.transform(F.sequence(low, F.least(n - 1, high)), lambda i: F.xxhash64(n - 1, i, F.get(before, i), F.get(behind, n - 1 - i)))
            gaps = F.transform(F.sequence(low, F.least(n, high)), lambda i: F.xxhash64(n, i, F.get(before, i), F.get(behind, n - i)))
            return F.concat(gone, gaps)

        return let(F.struct(_chained(hashes).alias("before"), let(F.reverse(hashes), _chained).alias("behind")), keys)

    return let(F.transform(ws, lambda w: F.xxhash64(w)), of)


def within_one_edit(a: Column, b: Column) -> Column:
    """Whether two arrays of words are at most one edit of a word apart."""

    def of(s: Column) -> Column:
        short, long_ = s["short"], s["long"]
        n, m = F.size(short), F.size(long_)
        # the first place where they differ, from 1; n + 1 if none does
        differs = F.array_position(F.transform(short, lambda w, i: F.when(w == F.get(long_, i), 0).otherwise(1)), 1)
        at = F.when(differs == 0, n + 1).otherwise(differs).cast("int")
        rest = F.when(n == m, F.slice(short, at + 1, n) == F.slice(long_, at + 1, m)).otherwise(F.slice(short, at, n) == F.slice(long_, at + 1, m))
        return ((m - n) <= 1) & rest

    longer = F.size(a) > F.size(b)
    return let(F.struct(F.when(longer, b).otherwise(a).alias("short"), F.when(longer, a).otherwise(b).alias("long")), of)


def gone(docs: DataFrame, scratch: Scratch, near_words: int = NEAR_WORDS) -> DataFrame:
    """doc_id, pos and h1 of the lines that go; docs has doc_id and text."""
    every = scratch.save(lines(docs, near_words), "lines")
    first = every.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "pos")).alias("at"), F.count("*").alias("c"), *[F.first(k).alias(k) for k in HALVES])
    first = scratch.save(first.select("h1", "h2", F.col("at.doc_id").alias("doc_id"), F.col("at.pos").alias("pos"), "c", *HALVES), "first")
    half = first.where("k0 is not null").select("h1", "h2", F.posexplode(F.array(*HALVES)).alias("side", "half"))
    shared = scratch.save(half.groupBy("half").agg(F.count("*").alias("c")).where("c > 1").select("half"), "halves")
    # by which halves a line may have a partner: the edit is in the other one
    near = half.join(sized(shared), "half", "left_semi").groupBy("h1", "h2").agg(F.max(F.col("side") % 2 == 0).alias("head"), F.max(F.col("side") % 2 == 1).alias("tail"))
    near = scratch.save(near.join(first.select("h1", "h2", "doc_id", "pos"), ["h1", "h2"]), "candidates")
    # the words of candidates, from the texts that hold their earliest place
    holders = sized(scratch.save(near.select("doc_id").distinct(), "holders"))
    texts = docs.join(holders, "doc_id", "left_semi").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    texts = texts.join(sized(near), ["doc_id", "pos"]).withColumn("bare", bare(F.col("line")))
    texts = texts.where((F.xxhash64("bare") == F.col("h1")) & (F.xxhash64(F.lit(1), "bare") == F.col("h2")))
    near = texts.select("h1", "h2", "doc_id", "pos", "head", "tail", F.split(spaced(F.col("bare")), " ").alias("ws"))
    near = scratch.save(near.dropDuplicates(["h1", "h2"]), "words")
    n = F.size("ws")
    g = F.greatest(F.floor((n - 2) / 2).cast("int"), F.lit(0))
    keys = near.select("h1", "h2", "doc_id", "pos", F.explode(_variants(F.col("ws"), F.when(F.col("tail"), 0).otherwise(g), F.when(F.col("head"), n).otherwise(n - g))).alias("key"))
    shared = scratch.save(keys.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key"), "keys")
    keys = scratch.save(keys.join(sized(shared), "key", "left_semi"), "shared")
    groups = keys.groupBy("key").agg(F.min(F.struct("doc_id", "pos", "h1", "h2")).alias("e"))
    groups = scratch.save(groups, "groups")
    pairs = keys.join(sized(groups), "key").where("h1 <> e.h1 or h2 <> e.h2")
    pairs = pairs.select("h1", "h2", F.col("e.h1").alias("e1"), F.col("e.h2").alias("e2")).distinct()
    side = near.select(F.col("h1").alias("e1"), F.col("h2").alias("e2"), F.col("ws").alias("e_ws"))
    pairs = pairs.join(near.select("h1", "h2", "ws"), ["h1", "h2"]).join(side, ["e1", "e2"])
    dropped = scratch.save(pairs.where(within_one_edit(F.col("ws"), F.col("e_ws"))).select("h1", "h2").distinct(), "dropped")
    fate = first.select("h1", "h2", F.col("doc_id").alias("d"), F.col("pos").alias("p"), "c").join(dropped.withColumn("near", F.lit(True)), ["h1", "h2"], "left")
    some = fate.where("c > 1 or near").drop("c")
    some = scratch.save(some, "some")
    found = every.select("doc_id", "pos", "h1", "h2").join(sized(some), ["h1", "h2"])
    found = found.where("near or doc_id <> d or pos <> p").select("doc_id", "pos", "h1")
    found = scratch.save(found, "gone")
    scratch.drop("lines", "first", "halves", "candidates", "holders", "words", "keys", "shared", "groups", "dropped", "some")
    return found


def _mark(pos: Column, h1: Column) -> Column:
    """A line's place with 32 bits of its name, in one number."""
    return F.shiftleft(pos.cast("long"), 32).bitwiseOR(h1.bitwiseAND(F.lit(0xFFFFFFFF)))


def dedup(docs: DataFrame, near_words: int = NEAR_WORDS) -> DataFrame:
    """row (a struct of docs' columns, with the new ``text``), n_lines, n_removed and share_removed for each row of docs.

    share_removed is the share of a text's code points, line ends left out, that were on lines that went (0 for empty texts).
    """
    scratch = Scratch(docs.sparkSession)
    found = gone(docs.select("doc_id", "text"), scratch, near_words)
    marks = found.groupBy("doc_id").agg(F.collect_set(_mark(F.col("pos"), F.col("h1"))).alias("gone"))
    marks = sized(scratch.save(marks, "marks"))
    out = docs.select("doc_id", "text", F.struct("*").alias("row")).join(marks, "doc_id", "left")

    def kept(ls: Column) -> Column:
        every = F.transform(ls, lambda x, i: _mark(i, F.xxhash64(bare(x))))
        stay = F.array_except(every, F.col("gone"))
        return F.struct(
            F.concat_ws("\n", F.transform(stay, lambda v: F.get(ls, F.shiftright(v, 32).cast("int")))).alias("text"),
            (F.size(ls) - F.size(stay)).cast("long").alias("n"),
        )

    split = F.split("text", "\n")
    new = F.when(F.col("gone").isNotNull() & F.col("text").isNotNull(), let(split, kept))
    out = out.select("row", F.when(F.col("text").isNull(), 0).otherwise(F.size(split)).cast("long").alias("n_lines"), "text", new.alias("new"))
    bulk = lambda t: F.length(t) - F.length(F.regexp_replace(t, "[^\n]+", ""))
    share = F.when(F.col("new.n") > 0, 1 - bulk(F.col("new.text")) / F.greatest(bulk(F.col("text")), F.lit(1)))
    fields = [F.coalesce("new.text", "text").alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns]
    return out.select(F.struct(*fields).alias("row"), "n_lines", F.coalesce("new.n", F.lit(0).cast("long")).alias("n_removed"), F.coalesce(share, F.lit(0.0)).alias("share_removed"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents").select("doc_id", "text")).select("row.*", "n_lines", "n_removed")


_RE2 = re.sub(r"\\u(\w{4})", r"\\x{\1}", SCRIPTS)
ORACLE = {
    "op8_line_dedup": rf"""
    with t as (select doc_id, text, string_split(text, chr(10)) as ls from documents),
    ln as (select doc_id, i as pos, trim(ls[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as b from t, unnest(range(1, len(ls) + 1)) u(i)),
    k as (select * from ln where b <> ''),
    f as (select b, min((doc_id, pos)) as fst, string_split(trim(regexp_replace(regexp_replace(b, '([{_RE2}])', ' \1 ', 'g'), '[\x20\t\x0B\f\r]+', ' ', 'g'), ' '), ' ') as ws from k group by b),
    h as (select b, len(ws) as n, fst, ws from f where len(ws) >= {NEAR_WORDS}),
    g as (select b, fst, n - 1 as m, i, hash(ws[1:i - 1]) as p, hash(ws[i + 1:]) as q from h, unnest(range(1, n + 1)) u(i) union all select b, fst, n, i, hash(ws[1:i - 1]), hash(ws[i:]) from h, unnest(range(1, n + 2)) u(i)),
    e as (select m, i, p, q, min(fst) as first from g group by all having count(*) > 1), near as (select distinct b from g join e using (m, i, p, q) where g.fst <> e.first),
    gone as (select doc_id, pos from k join f using (b) where (doc_id, pos) <> f.fst or b in (select b from near)),
    kept as (select doc_id, count(*) as n_kept, string_agg(l, chr(10) order by pos) as new from (select doc_id, i as pos, ls[i] as l from t, unnest(range(1, len(ls) + 1)) u(i)) a where not exists (select 1 from gone g where g.doc_id = a.doc_id and g.pos = a.pos) group by doc_id)
    select t.doc_id, case when text is null then null else coalesce(new, '') end as text, coalesce(len(ls), 0) as n_lines, coalesce(len(ls), 0) - coalesce(n_kept, 0) as n_removed from t left join kept using (doc_id)
    """
}
