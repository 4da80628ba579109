"""Every pipeline stage against brute force on its own input, and the whole run."""

from __future__ import annotations

import os
import re

import corpus_pipeline
import pyarrow.parquet as pq
import pytest
from test_operators import PLAIN, base_spans, deduped, jaccard_classes, repeats, weak_by_all_pairs
from tokenizers import Tokenizer

from tessella.llm import packing
from tessella.scratch import shared_dir

STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def docs(spark, odd_dir):
    return spark.read.parquet(f"{odd_dir}/documents.parquet")


def collected(df):
    return [r.asDict() for r in df.collect()]


def test_stage_names_and_columns(spark, docs, odd_dir):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "jaccard_join", "secret_scans", "best_fit_packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, odd_dir).columns == docs.columns, name


def test_quality_stage_drops_junk_alone(spark, docs, odd_dir):
    before, after = collected(docs), collected(STAGES["quality_rules"](spark, docs, odd_dir))
    assert {d["doc_id"] for d in after} >= set(range(90)), "clean documents stay"
    junk = {d["doc_id"] for d in before if d["text"] and ("$$$" in d["text"] or d["text"].startswith("word word"))}
    assert not junk & {d["doc_id"] for d in after}
    assert all(d in before for d in after), "rows that stay are as they were"


def test_quality_stage_drops_repetitive_texts_without_labels(spark, docs, odd_dir, tmp_path):
    pq.write_table(pq.read_table(f"{odd_dir}/labels.parquet").slice(0, 0), f"{tmp_path}/labels.parquet")
    before, after = collected(docs), collected(STAGES["quality_rules"](spark, docs, str(tmp_path)))
    repetitive = lambda w, rep: len(w) >= 50 and 100 * len(rep) > 50 * len(w)
    want = sorted(d["row"] for d in before if not repetitive(*repeats(d["text"])))
    assert sorted(d["row"] for d in after) == want and len(want) < len(before)
    assert {d["text"] for d in after} >= {None, "", "one", "two words"}


def test_line_stage(spark, docs, odd_dir):
    before, after = collected(docs), collected(STAGES["line_dedup"](spark, docs, odd_dir))
    texts = {d["doc_id"]: d["text"] for d in before if d["doc_id"] is not None}
    size = lambda t: len(t.replace("\n", ""))
    stays = lambda new, old: new == old or re.search(r"[^\x20\x09-\x0D]", new) and 1 - size(new) / size(old) < corpus_pipeline.REPEATED
    want = {k: v for k, v in deduped(texts).items() if stays(v, texts[k])}
    assert {d["doc_id"]: d["text"] for d in after if d["doc_id"] is not None} == want
    for d in after:
        assert d["n_chars"] == (None if d["text"] is None else len(d["text"]))
        assert d["gone"].startswith("gone") and d["row"].startswith("row"), "further columns keep their values"


def test_near_duplicate_stage(spark, docs, odd_dir):
    before, after = collected(docs), collected(STAGES["jaccard_join"](spark, docs, odd_dir))
    texts = {d["doc_id"]: d["text"] for d in before if d["doc_id"] is not None}
    want = sorted(d for d, (_, c) in jaccard_classes(texts, 5, 80).items() if d == c)
    assert sorted(d["doc_id"] for d in after if d["doc_id"] is not None) == want
    assert sum(d["doc_id"] is None for d in after) == sum(d["doc_id"] is None for d in before)


def test_secret_stage(spark, docs, odd_dir):
    before = {d["token"]: d for d in collected(docs)}
    changed = 0
    for d in collected(STAGES["secret_scans"](spark, docs, odd_dir)):
        old = before[d["token"]]["text"]
        parts = base_spans(old) + [s for spans in weak_by_all_pairs(old or "").values() for s in spans] if len(old or "") < 20_000 else base_spans(old)
        assert (d["text"] == old) == (not parts) and (not parts or "[SECRET]" in d["text"] and not base_spans(d["text"]))
        assert d["n_chars"] == (None if d["text"] is None else len(d["text"]))
        changed += d["text"] != old
    assert changed >= 3


def through(spark, docs, folder, *names):
    """docs after the named stages, each on what the one before kept."""
    for name in names:
        docs = spark.createDataFrame(STAGES[name](spark, docs, folder).collect(), docs.schema)
    return docs


FIRST = ("quality_rules", "line_dedup", "jaccard_join")


def test_planted_copies_leave_no_scraps(spark, empty_dir):
    """Exact and near copies with headings and short lines: nine in ten go, every other document stays."""
    import random

    rng = random.Random(21)
    word = lambda: "".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4)))
    rows, copies = [], set()
    for _ in range(60):
        lines = [" ".join(word() for _ in range(rng.choice([1, 2, 3, 8, 14, 25, 40]))) for _ in range(rng.randint(6, 24))]
        rows.append("\n".join(lines))
    for k in range(120):
        text = rows[k % 60]
        if k >= 40:  # near copies: one word in seventy is another one
            text = "\n".join(" ".join(word() if rng.random() < 1 / 70 else w for w in line.split(" ")) for line in text.split("\n"))
        copies.add(len(rows))
        rows.append(text)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"]: r["text"] for r in through(spark, docs, empty_dir, *FIRST).collect()}
    assert set(range(60)) <= set(kept), "every original stays"
    gone = len(copies - set(kept)) / len(copies)
    scraps = [d for d in copies & set(kept) if len(kept[d]) < 0.2 * len(rows[d])]
    assert gone >= 0.9 and not scraps, (gone, scraps)


def test_white_space_and_plain_pages(spark, empty_dir):
    """Runs of a million characters pass all stages, and a page of ordinary URLs is left as it is."""
    texts = {1: "a" + " " * 1_000_000 + "b", 2: "\n" * 2_000_000, 3: "x" * 1_000_000, 4: PLAIN, 5: " " * 2_000_000, 6: "c" + "\t\n" * 500_000 + "d"}
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    after = through(spark, docs, empty_dir, *FIRST, "secret_scans")
    found = {r["doc_id"]: r["text"] for r in after.collect()}
    assert found == texts
    ids = {}
    for r in STAGES["best_fit_packing"](spark, after, empty_dir).collect():
        ids[r["doc_id"]] = ids.get(r["doc_id"], 0) + r["length"]
    tok = Tokenizer.from_file(packing.default_tokenizer())
    assert ids == {i: len(tok.encode(t, add_special_tokens=False).ids) + 1 for i, t in texts.items()}


def test_scratch_of_a_run_is_removed(spark, odd_dir):
    """What is left of a run is what its lazy result reads."""
    root = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(root))
    n = corpus_pipeline.run(spark, odd_dir).count()
    left = {f"{d}/{t}" for d in set(os.listdir(root)) - before for t in os.listdir(f"{root}/{d}")}
    assert n and {p.rpartition("/")[2] for p in left} == {"secret_scans", "pieces", "sizes"}


def test_run(spark, odd_dir):
    found = collected(corpus_pipeline.run(spark, odd_dir))
    docs = spark.read.parquet(f"{odd_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, odd_dir).collect(), docs.schema)
    want = collected(STAGES["best_fit_packing"](spark, docs, odd_dir))
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["piece"], r["ids_crc32"])
    cols = ("doc_id", "piece", "start", "length", "ids_crc32")
    assert [[r[c] for c in cols] for r in sorted(found, key=key)] == [[r[c] for c in cols] for r in sorted(want, key=key)]


def test_empty_tables(spark, empty_dir):
    assert corpus_pipeline.run(spark, empty_dir).collect() == []
    docs = spark.read.parquet(f"{empty_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, empty_dir).collect() == []


def test_near_stage_keeps_one_of_repeated_rows(spark, odd_dir):
    table = pq.read_table(f"{odd_dir}/documents.parquet").to_pylist()
    ids = [d["doc_id"] for d in table if d["doc_id"] is not None]
    assert len(ids) > len(set(ids)), "the fixture has repeated rows"
