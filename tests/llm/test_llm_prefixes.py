"""Token counts of every prefix, against the library."""

import random

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from loadpulse.llm import common, prefixes

RANDOM = random.Random(11)
EDGES = [None, "", " ", "   ", "a", " a  b ", "\n\n", "\x00", "▁▁ x▁y", "<s> </s> <unk>", "<0x0A>", "ﬁ Å Å",
         "be " * 300, "abab" * 200, "     indented\n\tcode()  ;", "🙂🙂 né 漢字漢 ñ", "� x  y"]


@pytest.fixture(scope="module")
def counter():
    return prefixes.PrefixCounter(common.tokenizer_path(prefixes.TOKENIZER))


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(
        model_file=common.tokenizer_path(prefixes.TOKENIZER))


def random_text(n):
    signs = RANDOM.choice(["ab ", "the ing on ", " ▁", "aeé漢🙂\n ", "tion<s>/0x ", "\t \n."])
    return "".join(RANDOM.choice(signs) for _ in range(n))


def test_every_prefix_has_the_librarys_count(counter, model):
    for text in [t or "" for t in EDGES] + [random_text(RANDOM.randint(1, 80)) for _ in range(300)]:
        got = np.r_[0, np.cumsum(counter.steps(text), dtype=np.int64)].tolist()
        assert got == [len(model.encode(text[:p])) for p in range(len(text) + 1)], text


def test_whole_documents_have_the_librarys_count(spark, model):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = prefixes.prefix_counts(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.n_tokens == len(model.encode(texts[r.doc_id]))
        assert (r.n_chars, r.n_bytes) == (len(texts[r.doc_id]), len(texts[r.doc_id].encode()))


def test_questions_of_prefixes_and_budgets(make_docs, model):
    docs = make_docs(*EDGES, (None, "no id"), (3, "   "))
    table = prefixes.prefix_counts(docs)
    rows = table.select(
        "*", prefixes.tokens_at(F.col("steps"), F.lit(5)).alias("at_5"),
        prefixes.tokens_at(F.col("steps"), F.lit(-1)).alias("before"),
        prefixes.longest_within(F.col("steps"), 4).alias("in_4")).collect()
    texts = [t or "" for t in EDGES] + ["no id", "   "]
    assert [r.doc_id for r in rows] == [*range(len(EDGES)), None, 3]
    for r, text in zip(rows, texts, strict=True):
        assert r.at_5 == len(model.encode(text[:5])) and r.before == 0
        counts = [len(model.encode(text[:p])) for p in range(len(text) + 1)]
        assert r.in_4 == max(p for p, c in enumerate(counts) if c <= 4)
    cut = {r.doc_id: r for r in prefixes.limited(table, 4).collect()}
    assert cut[0].kept_chars == 0 and not cut[0].over_limit
    assert cut[12].over_limit and cut[12].kept_chars < 900


def test_one_very_long_text_and_an_empty_table(make_docs, model):
    text = "aäb" * 100_000 + " " * 1000 + "tail"
    row = prefixes.prefix_counts(make_docs(text)).first()
    assert row.n_tokens == len(model.encode(text))
    assert prefixes.prefix_counts(make_docs("x").where("false")).count() == 0


def test_a_model_of_another_kind_is_refused():
    with pytest.raises(Exception):
        prefixes.PrefixCounter(common.tokenizer_path("byte_bpe_50k.json"))
