"""Registered queries without SQL, and every stage of the pipeline, against plain Python over whole tables."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F
from test_llm import brute_components, ids_of, tokenizer  # noqa: F401

import corpus_pipeline
from rackpulse.llm import pseudonyms, quality_gam, queries, token_counts
from rackpulse.session import materialise, work_path

SMALL, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
PACKING = ["doc_id", "piece", "start", "length", "ids_crc32"]


def texts_of(spark, folder):
    return {r.doc_id: r.text for r in queries.table(spark, folder, "documents").select("doc_id", "text").collect()}


def remainder(doc_id, parts):
    return zlib.crc32(str(doc_id).encode()) % parts


def plain_pieces(tokenizer, texts, capacity=4096):  # noqa: F811
    out = []
    for doc_id, text in texts.items():
        ids = np.array([*ids_of(tokenizer, text), 1], "<u4")
        for piece, start in enumerate(range(0, len(ids), capacity)):
            part = ids[start : start + capacity]
            out.append((doc_id, piece, start, len(part), zlib.crc32(part.tobytes())))
    return sorted(out, key=repr)


def first_fit(lengths, capacity=4096):
    room = []
    for length in sorted(lengths, reverse=True):
        at = next((i for i, r in enumerate(room) if r >= length), None)
        if at is None:
            room.append(capacity - length)
        else:
            room[at] -= length
    return len(room)


def check_packing(packed, tokenizer, texts):  # noqa: F811
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed), key=repr) == plain_pieces(tokenizer, texts)
    sequences = {}
    for r in packed:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(sequences) <= first_fit([r.length for r in packed])


@pytest.mark.parametrize(
    ("query", "label", "parts", "held", "least", "found", "spared"),
    [(queries.op1_toxicity, "toxic", 3, 1, 0.7, 0.8, 0.98), (queries.op6_quality, "quality", 5, 0, 0.3, 0.95, 0.6)],
)
def test_scores_of_held_out_labels(spark, query, label, parts, held, least, found, spared):
    rows = {r.doc_id: r for r in query(spark, LARGER).collect()}
    assert rows.keys() == texts_of(spark, LARGER).keys()
    for r in rows.values():
        assert r.held_out == (remainder(r.doc_id, parts) == held)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= least)
    known = {r.doc_id: r[label] for r in queries.table(spark, LARGER, "labels").filter(f"{label} is not null").collect()}
    own = [(known[i], r.predicted) for i, r in rows.items() if r.held_out and i in known]
    ones, zeros = [p for y, p in own if y == 1], [p for y, p in own if y == 0]
    assert np.mean(ones) >= found and 1 - np.mean(zeros) >= spared


@pytest.mark.parametrize(("query", "label", "parts", "held"), [(queries.op1_toxicity, "toxic", 3, 1), (queries.op6_quality, "quality", 5, 0)])
def test_held_out_labels_have_no_influence(spark, query, label, parts, held):
    folder = work_path(spark, "flipped")
    queries.table(spark, SMALL, "documents").write.parquet(f"{folder}/documents.parquet")
    flipped = F.when(queries.held_out(parts, held), 1 - F.col(label)).otherwise(F.col(label))
    queries.table(spark, SMALL, "labels").withColumn(label, flipped).write.parquet(f"{folder}/labels.parquet")
    before, after = ({r.doc_id: r.score for r in query(spark, f).collect()} for f in (SMALL, folder))
    assert before.keys() == after.keys() and all(abs(before[i] - after[i]) < 1e-9 for i in before)


def test_token_counts_equal_the_library(spark):
    from tokenizers import Tokenizer, models, pre_tokenizers

    vocabulary = token_counts.zipf_vocabulary()
    reference = Tokenizer(models.Unigram([("<unk>", 0.0), *vocabulary], 0, False))
    reference.pre_tokenizer = pre_tokenizers.Metaspace("▁", "always", True)
    texts = texts_of(spark, SMALL)
    words = pc.utf8_split_whitespace(pa.array([t or "" for t in texts.values()])).to_pylist()
    plain = {i: len(reference.encode(" ".join(filter(None, w)), add_special_tokens=False).ids) for i, w in zip(texts, words, strict=True)}
    assert {r.doc_id: r.n_tokens for r in queries.op3_token_counts(spark, SMALL).collect()} == plain


def test_token_files_equal_the_library(spark, tokenizer):  # noqa: F811
    texts, start, plain = texts_of(spark, SMALL), 0, []
    for doc_id in sorted(texts):
        ids = np.array([*ids_of(tokenizer, texts[doc_id]), 2], "<u4")
        plain.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    rows = queries.op5_token_orc(spark, SMALL).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, rows)) == plain


def test_packing_of_whole_documents(spark, tokenizer):  # noqa: F811
    check_packing(queries.op7_best_fit_packing(spark, SMALL).collect(), tokenizer, texts_of(spark, SMALL))


def check_pseudonyms(new, texts):
    worker, back = pseudonyms.Pseudonymiser(queries.PSEUDONYM_KEY), pseudonyms.Pseudonymiser(queries.PSEUDONYM_KEY, inverse=True)
    address = re.compile(r"[a-z0-9.]+@[a-z0-9]+\.[a-z]+")
    assert new.keys() == texts.keys() and new != texts
    for i, old in texts.items():
        assert new[i] == (worker.replace(old)[0] if old else old)
        if old:
            assert back.replace(new[i])[0] == old
            assert not set(address.findall(old)) & set(address.findall(new[i]))


def test_pseudonyms_of_whole_documents(spark):
    check_pseudonyms({r.doc_id: r.text for r in queries.op10_pseudonyms(spark, SMALL).collect()}, texts_of(spark, SMALL))


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def plain_cleaning(texts, items):
    """Texts without the runs of words that lie in benchmark windows, and without documents of such words alone."""
    windows = set()
    for item in items:
        words = WORD.findall(lower(item or ""))
        size = min(10, len(words))
        windows |= {tuple(words[i : i + size]) for i in range(len(words) - size + 1) if size}
    sizes, out = {len(w) for w in windows}, {}
    for doc_id, text in texts.items():
        found = list(WORD.finditer(lower(text or "")))
        places, words = [m.span() for m in found], [m[0] for m in found]
        hit = np.zeros(len(words), bool)
        for size in sizes:
            for i in range(len(words) - size + 1):
                if tuple(words[i : i + size]) in windows:
                    hit[i : i + size] = True
        if hit.any() and hit.all():
            continue
        parts, done, i = [], 0, 0
        while i < len(words):
            j = i
            while j < len(words) and hit[j]:
                j += 1
            if j > i:
                parts.append(text[done : places[i][0]])
                done = places[j - 1][1]
            i = max(j, i + 1)
        out[doc_id] = "".join([*parts, text[done:]]) if parts else text
    return out


def staged(spark, folder):
    """What each stage gets and gives, the last one excepted, and the last one's rows."""
    docs, seen = queries.table(spark, folder, "documents"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = materialise(stage(spark, docs, folder), "stage")
        seen.append((name, docs, after))
        docs = after
    return seen, docs, corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()


def test_stages_equal_plain_python(spark, tokenizer):  # noqa: F811
    seen, last, packed = staged(spark, SMALL)
    assert [name for name, _ in corpus_pipeline.STAGES] == [*[name for name, _, _ in seen], "best-fit packing"]
    held = [({r.doc_id: r.text for r in a.collect()}, {r.doc_id: r.text for r in b.collect()}) for _, a, b in seen]
    for _, _, after in seen:
        assert after.columns == queries.table(spark, SMALL, "documents").columns
        assert after.count() == after.select("doc_id").distinct().count()
    for _, _, after in seen[2:]:
        assert after.filter("n_chars <> length(text)").isEmpty()

    before, after = held[0]
    docs, labels = queries.table(spark, SMALL, "documents"), queries.table(spark, SMALL, "labels")
    model = quality_gam.fit_on(docs, labels, "quality", queries.not_held_out(5, 0))
    scores = {i: model.probability(np.array([quality_gam.features_of(t)]))[0] for i, t in before.items()}
    assert after == {i: t for i, t in before.items() if scores[i] >= 0.3} and len(after) < len(before)
    good = {r.doc_id for r in labels.filter("quality = 1").collect()}
    assert np.mean([i in after for i in good & before.keys()]) > 0.95

    before, after = held[1]
    components = brute_components(before)
    assert after == {i: t for i, t in before.items() if components[i][1] == i} and len(after) < len(before)

    before, after = held[2]
    items = [r.text for r in queries.table(spark, SMALL, "benchmark").collect()]
    assert after == plain_cleaning(before, items) and after != before

    check_pseudonyms(held[3][1], held[3][0])
    check_packing(packed, tokenizer, held[3][1])
    whole = corpus_pipeline.run(spark, SMALL).select(*PACKING).collect()
    assert sorted(map(tuple, whole)) == sorted(tuple(r[c] for c in PACKING) for r in packed)


EDGES = [
    (None, "a text without an id, of some twelve common words, stays in"), (1, None), (2, ""), (3, " \t\n"), (4, "mail jo.doe@example.org now"),
    (5, "one two three four five six"), (6, "one two three four five six"), (6, "one two three four five six"), (7, "lorem ipsum " * 40_000), (2**62 + 1, "x"),
]


def edge_folder(spark, rows, extra=()):
    folder = work_path(spark, "edges")
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for name in extra:
        docs = docs.withColumn(name, F.lit("own"))
    docs.write.parquet(f"{folder}/documents.parquet")
    for name in ("labels", "benchmark"):
        queries.table(spark, SMALL, name).write.parquet(f"{folder}/{name}.parquet")
    return folder


def test_stages_at_the_edges(spark, tokenizer, monkeypatch):  # noqa: F811
    """No label has a text here, so the quality stage takes no decision of interest: every document is let through."""
    monkeypatch.setattr(corpus_pipeline, "QUALITY_AT_LEAST", 0.0)
    folder = edge_folder(spark, EDGES, ["score", "key", "text_", "shard", "row_key", "hash", "node", "spans", "n_words", "n_hit", "pii_spans"])
    seen, _, packed = staged(spark, folder)
    kept = [sorted((r.doc_id for r in after.collect()), key=repr) for _, _, after in seen]
    # Equal sequences of words are copies; documents without words are copies of nothing.
    assert kept[0] == sorted((i for i, _ in EDGES), key=repr)
    assert kept[1] == kept[2] == kept[3] == sorted((None, 1, 2, 3, 4, 5, 7, 2**62 + 1), key=repr)
    last = {r.doc_id: r.text for r in seen[-1][2].collect()}
    assert last[1] is None and last[2] == "" and last[7] == EDGES[8][1] and "jo.doe" not in last[4]
    check_packing(packed, tokenizer, last)


def test_no_documents(spark):
    folder = edge_folder(spark, [])
    assert corpus_pipeline.run(spark, folder).count() == 0
    for name in ("op1_toxicity", "op2_ngram_jaccard", "op3_token_counts", "op5_token_orc", "op6_quality", "op7_best_fit_packing", "op9_decontamination", "op10_pseudonyms"):
        assert queries.QUERIES[name](spark, folder).count() == 0, name
