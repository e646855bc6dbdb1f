"""Toxicity, language model, decontamination, mixing, token files, chats and the pipeline."""

import hashlib
import json
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loadpulse.llm import chat, common, decontaminate, lm, mixing, tokens, toxicity

RANDOM = random.Random(6)
WORDS = ["".join(RANDOM.choice("abcdefghilmnorst") for _ in range(RANDOM.randint(2, 7))) for _ in range(400)]
EDGES = [None, "", " ", "one", "\n\n", "Ünïcode 🙂 text", "be " * 4000, "a" * 50_000]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


# --- toxicity --------------------------------------------------------------------

@pytest.fixture
def judged(spark, make_docs):
    r = random.Random(1)
    texts, labels = [], []
    for i in range(600):
        words, bad = prose(r.randint(30, 120), i).split(" "), i % 5 == 0
        for _ in range(4 if bad else 0):
            words[r.randrange(len(words))] = r.choice(["dreadful", "horrid", "vilest"])
        texts.append(" ".join(words))
        labels.append((i, int(bad)))
    docs = make_docs(*texts, *[(600 + i, t) for i, t in enumerate(EDGES)])
    return docs, spark.createDataFrame(labels, "doc_id bigint, toxic int")


def test_held_out_toxicity(judged):
    docs, labels = judged
    rows = toxicity.scored(docs, labels).collect()
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    assert len(rows) == 600 + len(EDGES) and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    assert np.mean([p == t for p, t in held]) > 0.95
    assert all(r.predicted == (r.score >= 0.7) for r in rows)
    kept = toxicity.accepted(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows if not r.predicted}


def test_toxicity_without_labels_or_rows(judged):
    docs, labels = judged
    assert {r.score for r in toxicity.scored(docs, labels.where("toxic = 0")).collect()} == {0.0}
    assert {r.score for r in toxicity.scored(docs, labels.withColumn("toxic", F.lit(None).cast("int"))).collect()} == {0.0}
    assert toxicity.scored(docs.where("false"), labels).count() == 0


def test_windows_cover_all_words():
    for n in (0, 1, 7, 8, 9, 10, 55):
        words = [str(i).encode() for i in range(n)]
        found = b" ".join(toxicity.windows(words)).split()
        assert set(found) == set(words)


# --- language model --------------------------------------------------------------

def test_sample_has_pieces_from_anywhere(make_docs, monkeypatch):
    monkeypatch.setattr(lm, "SAMPLE_CHARS", 10)
    texts = ["".join(chr(97 + i) for i in range(26))] * 60 + ["short", "", None]
    pieces = [x.text for x in lm.sample_texts(make_docs(*texts)).collect()]
    own = [t for t in pieces if len(t) == 10]
    assert all(t in texts[0] for t in own) and len({t[0] for t in own}) > 8
    assert {"a", "q"} & {t[0] for t in own} and all(t in ("short", "") for t in pieces if len(t) < 10)


def blocks_of(docs, texts):
    """The language model's blocks of some documents, with classes and their training ids."""
    path = common.tokenizer_path(lm.TOKENIZER)
    rows, _ = common.stored(lm.numbered(docs), "numbered")
    words, _ = common.stored(lm.counted_words(rows, path), "words")
    counts = lm.subword_counts(words)
    subwords = lm.Subwords.of(path)
    classes = lm.classes_of(counts, lm.pair_counts(words, lm.frequent_ids(counts)), subwords.initial)
    known = rows.where("word is not null").join(words, "word").select(
        F.col("block").alias("in_block"), "place", "c", "subwords")
    ids = [lm._ids_of(t, subwords) for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 5 != 1]
    return rows.where("word is null").select("block", "doc_id", "held_out", "numbers"), known, classes, ids


def test_model_learns_from_every_window_of_all_training_documents(make_docs, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK_TOKENS", 1500)  # many blocks
    monkeypatch.setattr(lm, "HELD_IDS", 900)  # and runs in them
    texts = [*EDGES[:6], *[prose(20 + 5 * s, s) for s in range(60)], prose(4000, 5)]
    texts_, known, classes, ids = blocks_of(make_docs(*texts).repartition(3), texts)
    inputs, targets, scored = lm.spans_of(ids, classes)
    expected = lm.class_pairs(inputs, lm._wanted(targets, classes))
    assert (lm.corpus_pairs(texts_, known, classes) == expected).all()

    start = lm.trained(ids[:3], classes, 5, lm.prior_of(expected))
    weights, windows = lm.learned(texts_, known, classes, start)
    assert windows == scored.sum() and (weights["prior"] == start["prior"]).all()

    def loss(w):
        at = np.flatnonzero(scored)
        return lm._gradient(w, lm._forward(w, inputs[at - 1], inputs[at]), lm._wanted(targets, classes)[at])[0]

    assert loss(weights) < loss(start)


def test_scores_follow_the_contract(make_docs, monkeypatch):
    monkeypatch.setattr(lm, "STEPS", 60)
    monkeypatch.setattr(lm, "BLOCK_TOKENS", 2000)  # many blocks
    texts = [*EDGES, *[prose(60, s) for s in range(120)], prose(60, 3)]
    rows = {r.doc_id: r for r in lm.scores(make_docs(*texts)).collect()}
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
             for i, t in enumerate(texts)}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in words}
    counts = Counter()
    for i, own in words.items():
        if not held[i]:
            counts.update([*own, "\n"])
    total, distinct = sum(counts.values()), len(counts)
    for i, own in words.items():
        tokens_ = [*own, "\n"]
        base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in tokens_)
        r = rows[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (
            held[i], len(tokens_), sum(counts[w] > 0 for w in tokens_), total)
        assert r.base_score == pytest.approx(base) and math.isfinite(r.score) and r.score < 0
    assert rows[len(EDGES) + 3].score == pytest.approx(rows[len(texts) - 1].score, rel=1e-4)


def small_model():
    counts = np.zeros(lm.IDS)
    counts[:3000] = np.arange(3000, 0, -1)
    starts = np.zeros(lm.IDS, dtype=bool)
    starts[::2] = True
    classes = lm.classes_of(counts, np.zeros((lm.OWN_EMBEDDINGS, lm.OWN_EMBEDDINGS)), starts)
    r = np.random.default_rng(1)
    texts = [np.r_[r.integers(0, 3000, n), lm.END_ID] for n in (0, 1, 23, 24, 25, 100)]
    return classes, starts, texts, lm.trained(texts, classes, steps=5)


def test_probabilities_are_causal_and_add_up_to_one():
    classes, starts, texts, weights = small_model()
    logs, begins = lm.log_probabilities(texts, weights, classes, starts)
    assert len(logs) == sum(map(len, texts)) and (logs < 0).all()
    # A later id changes nothing before it.
    long = texts[-1]
    changed = long.copy()
    changed[60] = 7
    a, b = (lm.log_probabilities([t], weights, classes, starts)[0] for t in (long, changed))
    assert np.allclose(a[:60], b[:60], atol=1e-4) and not np.allclose(a[60], b[60])
    # Each text's result does not depend on its neighbours.
    assert np.allclose(logs[-len(long):], a, atol=1e-4)
    first = [lm.log_probabilities([np.array([i, lm.END_ID])], weights, classes, starts)[0][0]
             for i in range(0, lm.IDS, 500)]
    classes_total = np.exp(lm._log_softmax(lm._class_logits(
        weights, *[x[None] for x in lm.spans_of([long], classes)[0][:2]])[:, :1])).sum()
    within = np.bincount(classes.of_id, weights=np.exp(classes.within), minlength=lm.CLASSES)
    assert classes_total == pytest.approx(1, abs=1e-3) and within == pytest.approx(np.ones(lm.CLASSES), abs=1e-3)
    assert all(np.isfinite(first))
    # All of a text's words together: its ids, given that a word begins.
    sizes = [len(t) for t in texts]
    heads = np.cumsum(sizes) - sizes
    ends = np.zeros(len(logs), dtype=bool)
    ends[np.cumsum(sizes) - 1] = True
    base, known = np.full(len(logs), -3.0), np.ones(len(logs), dtype=bool)
    words = lm.mixed_scores(logs, begins, np.ones(len(logs), dtype=int), ends, base, known, 1 - 1e-12)
    assert np.add.reduceat(words, heads) == pytest.approx(
        np.add.reduceat(logs.astype(float), heads) - begins[heads], rel=1e-4, abs=1e-3)


def test_ids_after_frequent_ids_add_up_to_one_in_each_class():
    r = np.random.default_rng(8)
    counts = np.round(1e6 / np.arange(1, lm.IDS + 1))
    starts = r.random(lm.IDS) < 0.5
    starts[lm.END_ID] = True
    pairs = r.integers(0, 50, (lm.OWN_EMBEDDINGS, lm.OWN_EMBEDDINGS)).astype(float)
    classes = lm.classes_of(counts, pairs, starts)
    place = lm.frequent_ids(counts)
    frequent = np.argsort(np.where(place < 0, lm.IDS, place))[:lm.OWN_EMBEDDINGS]
    for before in (0, 5, 1000):
        share = np.exp(classes.within.astype(float))
        share[frequent] = np.exp(classes.inside[before].astype(float))
        assert np.bincount(classes.of_id, weights=share) == pytest.approx(np.ones(lm.CLASSES), abs=1e-3)


def test_word_probabilities_add_up_to_one():
    """Over all words of up to three ids of a small alphabet, and those that go on."""
    begin, stop = 0.4, 0.4  # a word's id is followed by a beginning one with this chance
    first, later = [0.7, 0.3], [0.5, 0.25]  # given a beginning; and of all ids
    total = 0.0
    for size in (1, 2, 3):
        for ids in np.ndindex(*[2] * size):
            p = [begin * first[ids[0]], *[0.6 * later[i] / 0.75 for i in ids[1:]], begin * 0.5]
            begins = np.log(np.r_[begin, np.full(size - 1, stop), begin])
            words = lm.mixed_scores(np.log(p), begins, np.array([size, 1]), np.array([False, True]),
                                    np.zeros(2), np.ones(2, dtype=bool), 1 - 1e-15)
            total += math.exp(words[0])
    assert total == pytest.approx(1 - 0.6 ** 3, abs=1e-6)


def test_gradients_are_those_of_the_loss():
    classes, _, texts, weights = small_model()
    inputs, targets, scored = lm.spans_of(texts, classes)
    wanted = np.where(targets >= 0, classes.of_id[targets], -1)
    at = np.flatnonzero(scored)
    exact = {n: w.astype(np.float64) for n, w in weights.items()}

    def loss(w):
        return lm._gradient(w, lm._forward(w, inputs[at - 1], inputs[at]), wanted[at])

    _, gradient = loss(exact)
    r = np.random.default_rng(2)
    for name in ("q", "k", "v", "w1", "w2", "b1", "b2", "r"):
        place = tuple(r.integers(0, s) for s in exact[name].shape)
        moved = {n: w.copy() for n, w in exact.items()}
        moved[name][place] += 1e-5
        up = loss(moved)[0]
        moved[name][place] -= 2e-5
        assert (up - loss(moved)[0]) / 2e-5 == pytest.approx(float(gradient[name][place]), rel=2e-2, abs=1e-6)


def test_no_documents_and_no_training_documents(make_docs, monkeypatch):
    monkeypatch.setattr(lm, "STEPS", 5)
    assert lm.scores(make_docs("x").where("false")).count() == 0
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 5 == 1)
    row = lm.scores(make_docs((held, "alone here"))).first()
    assert row.train_tokens == 0 and row.n_known == 0 and math.isfinite(row.score)


# --- decontamination -------------------------------------------------------------

def test_planted_items_are_found_and_clean_documents_left(spark, make_docs):
    items = [(i, prose(n, 900 + i)) for i, n in enumerate([14, 25, 40, 59, 30, 2])] + [(6, None), (7, "")]
    r, texts, expected = random.Random(4), [], set()
    for d in range(80):
        words = prose(r.randint(50, 400), d).split(" ")
        if d % 2 == 0:
            i, item = items[d // 2 % 5]
            at = r.randrange(len(words))
            leak = [w if r.random() > 0.1 * (d % 4 == 0) else "other" for w in item.split(" ")]
            words[at:at] = leak
            expected.add((d, i))
        texts.append(" ".join(words))
    benchmark = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id bigint, text string, doc_id int")
    docs = make_docs(*texts, *[(100 + i, t) for i, t in enumerate(EDGES)])
    found = {(x.doc_id, x.item_id) for x in decontaminate.matches(docs, benchmark).collect()}
    assert {f for f in found if f[1] != 5} == expected
    short = items[5][1]
    assert {d for d, i in found if i == 5} == {d for d, t in enumerate(texts) if f" {short} " in f" {t} "}
    kept = decontaminate.clean(docs, benchmark.where("item_id < 5"))
    assert kept.columns == docs.columns
    assert {x.doc_id for x in kept.collect()} == {
        r_.doc_id for r_ in docs.collect()} - {d for d, _ in expected}


@pytest.mark.parametrize("n_items", [200, 500])
def test_recall_is_that_of_all_pairs(spark, make_docs, n_items):
    r = random.Random(n_items)
    vocabulary = ["".join(r.choice("abcdefghilmnorst") for _ in range(r.randint(3, 8))) for _ in range(3000)]

    def some(n):  # frequent and rare words
        return [vocabulary[int(3000 * r.random() ** 2)] for _ in range(n)]

    items = [some(r.randint(15, 59)) for _ in range(n_items)]
    texts = [some(r.randint(50, 200)) for _ in range(100)]
    for n, item in enumerate(items):
        share, kept = [(0, 0), (0.3, 0), (0.48, max(4, len(item) // 4))][n % 3]
        leak = list(item)
        for at in r.sample(range(len(item) - kept), int(share * len(item))):
            leak[at] = some(1)[0]
        texts.append([*some(r.randint(0, 60)), *leak, *some(r.randint(0, 60))])
    expected = set()
    for d, words in enumerate(texts):
        own = [w.encode() for w in words]
        for i, item in enumerate(items):
            plain = [w.encode() for w in item]
            share = decontaminate.common_length(plain, own) / len(plain)
            answer = " ".join(item[-max(4, len(item) // 4):])
            if share >= 0.7 or share >= 0.5 and f" {answer} " in f" {' '.join(words)} ":
                expected.add((d, i))
    benchmark = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id bigint, text string")
    found = {(x.doc_id, x.item_id) for x in
             decontaminate.matches(make_docs(*map(" ".join, texts)), benchmark).collect()}
    assert len(expected) >= n_items and found == expected


def test_basis_is_fitted_to_all_passages_of_all_documents(spark, make_docs):
    docs = make_docs(*EDGES, *[prose(30 + 7 * s, s) for s in range(60)], prose(3000, 99), prose(50, 3)).repartition(5)
    texts = [x.text for x in docs.collect()]
    numbers = decontaminate.numbered(docs)
    counts = decontaminate.term_counts(numbers)
    rows, idf = [], decontaminate.inverse_frequencies(counts)
    for text in texts:
        terms = decontaminate.Terms().of(decontaminate.words_of(text))
        for at in range(0, len(terms), decontaminate.PASSAGE):
            row = np.bincount(terms[at:at + decontaminate.PASSAGE], minlength=decontaminate.TERMS) * idf
            rows.append(row / np.linalg.norm(row))
    matrix = np.array(rows)
    found = {r.slab: r.part for r in decontaminate.corpus_product(numbers, counts, 20).collect()}
    assert np.frombuffer(found.pop(-1), dtype=np.int64)[0] == len(rows)
    whole, size = np.zeros((decontaminate.TERMS, 20), dtype=np.float32), decontaminate.SLAB
    for slab, part in found.items():
        whole[size * slab:size * (slab + 1)] = np.frombuffer(part, dtype=np.float32).reshape(size, 20)
    expected = matrix.T @ (matrix @ decontaminate.signs(20))
    assert np.abs(whole - expected).max() < 1e-4 * np.abs(expected).max()


def test_rare_terms_are_looked_up_and_not_multiplied(monkeypatch):
    monkeypatch.setattr(decontaminate, "FREQUENT", 3)
    monkeypatch.setattr(decontaminate, "ROWS_AT_ONCE", 2)
    r = np.random.default_rng(6)
    idf = r.uniform(0.05, 9, decontaminate.TERMS).astype(np.float32)
    idf[[5, 77, 900, 901]] = 0.01, 0.02, 0.03, 0.04  # one more than the dense matrix has
    start = decontaminate.signs(4)
    passages = [[5, 5, 77], [900], [901, 901, 901, 12, 5], [], [12, 12, 13], r.integers(0, 40, 60), [32767]]
    product = decontaminate.Product(start, idf)
    looked_up, plain = [], decontaminate.add_rows
    monkeypatch.setattr(decontaminate, "add_rows", lambda out, to, values, source: (
        looked_up.append(len(to)), plain(out, to, values, source)))
    for _ in range(2):
        product.add(np.concatenate(passages).astype(np.int64),
                    np.repeat(np.arange(len(passages)), list(map(len, passages))))
    multiplied = sum(list(p).count(t) for p in passages for t in (5, 77, 900))
    assert looked_up == [sum(map(len, passages)) - multiplied] * 4
    rows = np.array([np.bincount(p, minlength=decontaminate.TERMS) * idf.astype(float) for p in passages if len(p)])
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    assert np.allclose(product.total(), 2 * rows.T @ (rows @ start), rtol=1e-4, atol=1e-4)


def test_terms_of_many_texts_are_those_of_their_words(monkeypatch):
    r = random.Random(4)
    letters = "abcXYZ09 -.é日🙂\x00\t\n\x1c\ud800"
    texts = [None, "", " ", "x" * 15, "y" * 16, "z" * 40, "é" * 8, *(
        "".join(r.choice(letters) for _ in range(r.randint(0, 200))) for _ in range(300))]
    monkeypatch.setattr(decontaminate, "HASHED_AT_ONCE", 2000)
    found, plain = list(decontaminate.terms_of(texts)), decontaminate.Terms()
    assert len(found) == len(texts) and list(decontaminate.terms_of([])) == []
    for text, terms in zip(texts, found, strict=True):
        assert terms.tolist() == plain.of(decontaminate.words_of(text)).tolist(), repr(text)


def test_workers_remember_one_operator_at_a_time():
    path = common.tokenizer_path(tokens.TOKENIZER)
    first = decontaminate.Terms.shared()
    assert decontaminate.Terms.shared() is first
    encoder = tokens.Encoder.of(path, "<u2")
    assert tokens.Encoder.of(path, "<u2") is encoder and len(common._remembered) == 1
    assert decontaminate.Terms.shared() is not first and len(common._remembered) == 1


def test_items_ruled_out_by_their_terms_are_no_matches(monkeypatch):
    items = [(i, prose(n, 700 + i)) for i, n in enumerate([5, 14, 25, 40, 59])]
    rows = [decontaminate.Terms().of(decontaminate.words_of(t)) for _, t in items]
    texts = [f"{prose(60, s)} {items[s % 5][1]} {prose(20, s + 1)}" if s % 3 else prose(90, s) for s in range(40)]
    counts = np.ones(decontaminate.TERMS + 1, dtype=np.int64) * len(texts)
    idf = decontaminate.inverse_frequencies(counts // 4)
    empty = np.zeros((decontaminate.TERMS, len(items) + decontaminate.EXTRA_RANK), dtype=np.float32)
    products = decontaminate._term_products(decontaminate.latent_basis(empty, 0, rows, idf), rows, idf)
    searcher = decontaminate.Searcher(decontaminate.index_of(items, products, counts // 4))
    found = [searcher.matches(t) for t in texts]
    assert any(len(searcher.possible(searcher.cache.of(decontaminate.words_of(t)))) < 5 for t in texts)
    monkeypatch.setattr(searcher, "possible", lambda terms: np.arange(5))
    assert found == [searcher.matches(t) for t in texts] and sum(map(len, found)) >= 26


def test_items_ruled_out_in_every_stretch_are_no_matches(monkeypatch):
    monkeypatch.setattr(decontaminate, "MANY_ITEMS", 0)
    monkeypatch.setattr(decontaminate, "STRETCHES", 2)
    items = [(i, prose(n, 700 + i)) for i, n in enumerate([5, 14, 25, 40, 59])]
    items[3] = (3, " ".join(f"own{i}" for i in range(40)))
    rows = [decontaminate.Terms().of(decontaminate.words_of(t)) for _, t in items]
    spread = " ".join(f"{prose(90, i)} {word}" for i, word in enumerate(items[3][1].split()))
    texts = [spread, *(f"{prose(31 * s, s)} {items[s % 5][1]} {prose(400, s + 1)}" for s in range(1, 30))]
    counts = np.ones(decontaminate.TERMS + 1, dtype=np.int64) * len(texts)
    idf = decontaminate.inverse_frequencies(counts // 4)
    empty = np.zeros((decontaminate.TERMS, len(items) + decontaminate.EXTRA_RANK), dtype=np.float32)
    products = decontaminate._term_products(decontaminate.latent_basis(empty, 0, rows, idf), rows, idf)
    searcher = decontaminate.Searcher(decontaminate.index_of(items, products, counts // 4))
    found = [searcher.matches(t) for t in texts]
    # All words of an item are in the first text, but nowhere near each other.
    assert 3 not in searcher.possible(searcher.cache.of(decontaminate.words_of(spread))).tolist()
    monkeypatch.setattr(searcher, "possible", lambda terms: np.arange(5))
    assert found == [searcher.matches(t) for t in texts]
    assert all(s % 5 in [m[0] for m in own] for s, own in enumerate(found) if s)


def test_items_without_an_id_and_repeated_rows(spark, make_docs):
    item = prose(30, 7)
    benchmark = spark.createDataFrame([(None, item), (None, item), (2**60 + 1, prose(30, 8)), (None, None)],
                                      "item_id bigint, text string")
    docs = make_docs((2**60 + 3, f"{prose(50, 1)} {item}"), (2**60 + 3, f"{prose(50, 1)} {item}"),
                     (None, f"{prose(50, 2)} {prose(30, 8)}"), (4, prose(80, 3)))
    found = [(x.doc_id, x.item_id) for x in decontaminate.matches(docs, benchmark).collect()]
    assert sorted(found, key=str) == sorted([(2**60 + 3, None)] * 2 + [(None, 2**60 + 1)], key=str)
    assert [x.doc_id for x in decontaminate.clean(docs, benchmark).collect()] == [4]


def test_decontamination_of_nothing(spark, make_docs):
    benchmark = spark.createDataFrame([(1, "a b c d e f")], "item_id bigint, text string")
    assert decontaminate.matches(make_docs("x").where("false"), benchmark).count() == 0
    docs = make_docs("a b c d e f")
    assert decontaminate.matches(docs, benchmark.where("false")).count() == 0
    assert decontaminate.clean(docs, benchmark.where("false")).count() == 1


def test_an_index_is_gone_when_clean_documents_are_used(spark, make_docs, monkeypatch):
    items = [prose(20, 700 + i) for i in range(6)]
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    leaks = [(i if i else None, prose(30, 60 + i) + " " + item) for i, item in enumerate(items)]
    plain = [(10, prose(60, 1)), (10, prose(60, 1)), (None, prose(60, 2)), (11, None), (12, "")]
    docs, made, indexes = make_docs(*leaks, *leaks, *plain), [], decontaminate.indexes

    def followed(*args):
        for index in indexes(*args):
            assert not any(os.path.exists(x._path) for x in made)
            made.append(index)
            yield index

    monkeypatch.setattr(decontaminate, "indexes", followed)
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 2)
    kept = decontaminate.clean(docs, benchmark)
    assert len(made) > 1 and not any(os.path.exists(x._path) for x in made)
    assert kept.columns == docs.columns
    assert sorted(((x.doc_id, x.text) for x in kept.collect()), key=str) == sorted(plain, key=str)


def test_products_come_to_the_driver_part_by_part(spark, make_docs, monkeypatch):
    benchmark = spark.createDataFrame([(1, prose(20, 1)), (2, prose(30, 2))], "item_id bigint, text string")
    docs, largest, collect = make_docs(*[prose(60, i) for i in range(20)]), [], type(spark.range(1)).collect

    def measured(self):
        rows = collect(self)
        largest.append(sum(len(x) for r in rows for x in r if isinstance(x, (bytes, bytearray))))
        return rows

    monkeypatch.setattr(type(docs), "collect", measured)
    index = next(decontaminate.indexes(docs, benchmark)).value
    assert index.added.shape == (decontaminate.TERMS + 1, 2) and np.abs(index.added).max() > 0
    assert max(largest, default=0) < index.added.nbytes / 4


def test_longest_common_subsequence():
    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            row = [0] + [0] * len(b) if False else _next(row, x, b)
        return row[-1]

    def _next(row, x, b):
        out = [0]
        for j, y in enumerate(b):
            out.append(row[j] + 1 if x == y else max(row[j + 1], out[-1]))
        return out

    r = random.Random(2)
    for _ in range(200):
        a, b = ([r.choice([b"a", b"b", b"c"]) for _ in range(r.randint(1, 70))] for _ in range(2))
        assert decontaminate.common_length(a, b) == plain(a, b)


# --- mixing ----------------------------------------------------------------------

def test_taken_words_meet_the_targets(spark):
    r = random.Random(3)
    rows = [(i, prose(r.randint(1, 60), i), s) for s, n in (("a", 300), ("b", 40), ("c", 90), (None, 60))
            for i in range(n)]
    rows += [(1000, None, "b"), (1001, "", "c"), (1002, "x", "empty")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("size", F.lit("?"))
    got = mixing.taken(docs).collect()
    assert len(got) == len(rows) and all(x.taken <= 2 * x.size for x in got)
    total = sum(len((t or "").split()) for _, t, _ in rows)
    targets, taken = {}, Counter()
    for x in got:
        targets[x.source_size] = x.target
        taken[x.source_size] += x.taken
    assert sum(targets.values()) == pytest.approx(1.5 * total)
    for size, target in targets.items():
        assert target <= 2 * size and abs(taken[size] - target) <= 30
    again = mixing.taken(docs.repartition(7))
    key = ["doc_id", "size", "source_size", "target", "taken"]
    assert sorted(map(tuple, got)) == sorted(map(tuple, again.select(key).collect()))
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns
    assert sum(len((x.text or "").split()) for x in mixed.collect()) == sum(x.taken for x in got)


def test_weights_change_the_chances(spark):
    rows = [(i, "w " * 10, "a", 4.0 if i < 500 else 1.0) for i in range(1000)] + [
        (i, "w " * 10, "b", None) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, weight double")
    got = {(x.source_size, x.doc_id): x.taken for x in mixing.taken(docs, weight="weight", share=0.2).collect()}
    chosen = [got[10_000, i] > 0 for i in range(1000)]
    assert sum(chosen[:500]) > sum(chosen[500:]) and abs(
        sum(v for (s, _), v in got.items() if s == 10_000) - 7500) <= 20


def test_chances_follow_sizes(spark):
    r = random.Random(5)
    sizes = [r.choice([5, 10, 20, 40]) for _ in range(8000)]
    docs = spark.createDataFrame([(i, "w " * n, "a") for i, n in enumerate(sizes)],
                                 "doc_id bigint, text string, source string")
    got = {x.doc_id: x.taken for x in mixing.taken(docs, share=0.3).collect()}
    usual = sum(n * n for n in sizes) / sum(sizes)
    for n in (5, 10, 20, 40):
        own = [got[i] > 0 for i, size in enumerate(sizes) if size == n]
        assert abs(sum(own) / len(own) - 0.3 * n / usual) < 0.04
    assert abs(sum(got.values()) - 0.3 * sum(sizes)) <= 20


def test_mix_keeps_columns_of_any_name(make_docs):
    names = ["_source", "_size", "_copies", "size", "odds", "rank", "plan", "Plan_Source", "turn", "target", "a.b"]
    plain = make_docs(*[prose(20, i) for i in range(40)])
    docs = plain.withColumns({name: F.lit(name) for name in names})
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns
    rows = mixed.collect()
    assert rows and all(x[name] == name for x in rows for name in names)
    same = [sorted(map(tuple, mixing.taken(d).collect())) for d in (plain, docs)]
    assert same[0] == same[1] and sum(t[4] for t in same[0]) == 20 * len(rows)


def test_mix_of_nothing(make_docs):
    assert mixing.taken(make_docs("x").where("false")).count() == 0
    assert [x.taken for x in mixing.taken(make_docs(None, "")).collect()] == [0, 0]


# --- tokens ----------------------------------------------------------------------

def reference_ids(text):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(common.tokenizer_path(tokens.TOKENIZER))
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [0]


def test_token_files_hold_all_documents_in_order(spark, make_docs):
    texts = [*EDGES, "<|endoftext|>", prose(200, 1), "a  b   c \n d\n\n e ", prose(50, 2)]
    folder = tokens.write_tokens(make_docs(*[(10 * i - 20, t) for i, t in enumerate(texts)]))
    got = {r.doc_id: r for r in tokens.read_documents(spark, folder).collect()}
    start = 0
    for i, text in enumerate(texts):
        ids = reference_ids(text)
        r = got[10 * i - 20]
        assert (r.start, r.n_tokens) == (start, len(ids))
        assert r.ids_crc32 == zlib.crc32(np.array(ids, dtype="<u4").tobytes())
        start += len(ids)
    manifest = tokens.manifest_of(folder)
    assert manifest["n_tokens"] == start and manifest["n_docs"] == len(texts)
    store, root = tokens._open(folder)
    flat = np.concatenate([tokens._mapped(store, f"{root}/{tokens._name(p['part'])}.bin", "<u2")
                           for p in manifest["parts"]])
    assert flat.tolist() == [x for t in texts for x in reference_ids(t)]


def test_pieces_are_those_of_the_whole_text():
    from tokenizers import Tokenizer
    path = common.tokenizer_path(tokens.TOKENIZER)
    whole, encoder, r = Tokenizer.from_file(path), tokens.Encoder(path, "<u2"), random.Random(1)
    bits = [" ", "  ", "\n", "\t", "a", "b.", "c", "é", "<|endoftext|>", "1", "'s", ".", ",", "\r", "ab", "Á",
            "²", "日本", "🙂", "\x1c", "\x85", "!?", "Word"]
    for _ in range(3000):
        text = "".join(r.choice(bits) for _ in range(r.randint(0, 16)))
        ids = np.array(whole.encode(text, add_special_tokens=False).ids, dtype="<u2")
        assert encoder.encode(text) == ids.tobytes(), repr(text)


def test_splitting_is_the_tokenizers():
    from tokenizers import Tokenizer
    path = common.tokenizer_path(tokens.TOKENIZER)
    whole, encoder, r = Tokenizer.from_file(path), tokens.Encoder(path, "<u2"), random.Random(2)
    bits = [" ", " ", "\n", "'", "'s", "'LL", "'re", "12", "3", "<", "<|", "--", '"', "x", "Ab", "ÿ", "ɏ", "ɐ", "ª",
            "×", "_", "|>", "~", "\x7f", "\x00", "\t", "\u3000", "ж"]
    for _ in range(3000):
        text = "".join(r.choice(bits) for _ in range(r.randint(0, 24)))
        ids = np.array(whole.encode(text, add_special_tokens=False).ids, dtype="<u2")
        assert encoder.encode(text) == ids.tobytes(), repr(text)


def test_parts_that_recur_are_remembered_when_rare_ones_fill_the_memory(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_ENTRIES", 64)
    encoder = tokens.Encoder(common.tokenizer_path(tokens.TOKENIZER), "<u2")
    model, asked = encoder._parts._model, []

    class Model:
        def tokenize(self, part):
            asked.append(part)
            return model.tokenize(part)

    encoder._parts._model = Model()
    for i in range(400):
        encoder.encode(f"Common {chr(97 + i % 26)}{chr(97 + i // 26)}q, words.")
    assert asked.count("Common") == 1 and asked.count("Ġwords") == 1
    assert len(asked) < 420 and len(encoder._parts) + len(encoder._parts._older) <= 72


def test_repeated_null_and_no_ids(spark, make_docs):
    docs = make_docs((1, "b"), (1, "a"), (None, "c"), (1, "a"))
    rows = tokens.read_documents(spark, tokens.write_tokens(docs)).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, 1, 1, 1]
    assert tokens.read_documents(spark, tokens.write_tokens(docs.where("false"))).count() == 0


# --- chats -----------------------------------------------------------------------

def test_the_best_branch_of_a_tree_is_formatted(spark):
    messages = spark.createDataFrame([
        (1, "r", None, "user", "hi", 0.0), (1, "a", "r", "assistant", "low", 1.0),
        (1, "b", "r", "assistant", "high", 5.0), (1, "c", "b", "user", "more", 1.0),
        (1, "d", "a", "user", "less", 0.5), (2, "x", "gone", "assistant", None, None),
        (3, "p", "q", "user", "round", 0.0), (3, "q", "p", "user", "round", 0.0), (3, "s", "q", "user", "-", 0.0),
    ], "conv_id bigint, message_id string, parent_id string, role string, text string, score double")
    rows = {r.conv_id: r for r in chat.format_trees(messages).collect()}
    assert set(rows) == {1, 2}
    assert rows[1].formatted == ("<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nhigh<|im_end|>\n"
                                 "<|im_start|>user\nmore<|im_end|>\n")
    assert [rows[1].formatted[s.start:s.end] for s in rows[1].loss_spans] == ["high"]
    both = chat.format_trees(messages, branches=2).where("conv_id = 1").orderBy("branch").collect()
    assert [r.leaf_id for r in both] == ["c", "d"]


def test_long_threads_and_many_leaves(spark):
    chain = [(1, f"n{i}", f"n{i - 1}" if i else None) for i in range(37)]
    star = [(2, f"s{i}", "n5") for i in range(5)]
    messages = spark.createDataFrame(chain + star, "conv_id bigint, message_id string, parent_id string")
    got = Counter(r.leaf_id for r in chat.root_to_leaf_paths(messages).collect())
    assert got == {"n36": 37, **{f"s{i}": 7 for i in range(5)}}


def test_texts_come_back_from_the_template(spark):
    nasty = ["", "\\", "<|im_end|>\n", "\\<|", "<\\|im_start|>", "a\nb\n", "<|<|\\\\", "日本 🙂"]
    rows = [(c, t, role, nasty[(c * 3 + t) % len(nasty)]) for c in range(12) for t, role in
            enumerate(["user", "assistant", "tool\n<|", None, "assistant"])]
    rows += [(None, 0, "assistant", None), (1, 2, "user", "same turn"), (1, 2, "user", "same turn")]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_trees(chat.as_trees(turns.na.fill("")))).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted([(t, r or "", x or "") for c, t, r, x in rows if c == conv])
        whole = "".join(f"{r}\n{x}\n" for _, r, x in own)
        learned = "".join(x for _, r, x in own if r == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256) == (len(own), hashlib.sha256(whole.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
    assert chat.read_back(chat.format_trees(chat.as_trees(turns.where("false")))).count() == 0


# --- pipeline --------------------------------------------------------------------

def test_pipeline_stages_are_the_operators_one_after_the_other(spark, tmp_path):
    folder = "/root/testdata/sf0.001"
    docs = common.table(spark, folder, "documents")
    for name, stage in corpus_pipeline.STAGES:
        result, _ = common.stored(stage(spark, docs, folder), name)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert result.columns == docs.columns
            before = {(r.doc_id, r.text) for r in docs.collect()}
            assert {(r.doc_id, r.text) for r in result.collect()} <= before
            docs = result
    expected = sum(len(reference_ids(r.text)) for r in docs.collect())
    total = result.agg(F.sum("n_tokens"), F.count("*")).first()
    assert tuple(total) == (expected, docs.count())
    whole = corpus_pipeline.run(spark, folder)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, result.collect()))
    assert json.dumps(corpus_pipeline.ORACLE_SQL) == "null"
