"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from loadpulse.llm import variants

RANDOM = random.Random(3)


def brute_words(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % 31 == 0:
                word = word[:h % len(word)] + word[h % len(word) + 1:]
            counts[word] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(rows):
    counts = brute_words(rows)
    near = {w: [v for v in counts if one_apart(v, w)] for w in counts}
    forms = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-counts[v], v), default=None)
        forms[w] = best if best and counts[best] >= 10 * counts[w] else None

    def root(w):
        while forms[w]:
            w = forms[w]
        return w

    return {w: (forms[w], root(w), n, len(near[w]), counts.get(forms[w])) for w, n in counts.items()}


def changed(word):
    at, letter = RANDOM.randrange(len(word)), RANDOM.choice("abcéÀz")
    return RANDOM.choice([word[:at] + word[at + 1:], word[:at] + letter + word[at:],
                          word[:at] + letter + word[at + 1:]])


@pytest.fixture(scope="module")
def texts():
    words = ["".join(RANDOM.choice("abcdeéÀñß") for _ in range(RANDOM.randint(6, 12))) for _ in range(60)]
    words += ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "Abababab", "×÷×÷×÷×", "x" * 64, "x" * 65, "x" * 63, "x" * 200]
    words += [changed(w) for w in words for _ in range(4)]
    words += [changed(w) for w in words[-80:]]
    weights = [RANDOM.choice([1, 1, 3, 30, 400]) for _ in words]
    return [" ".join(RANDOM.choices(words, weights, k=400)) for _ in range(60)]


def rows_of(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_variants_are_those_of_all_pairs(make_docs, texts, monkeypatch):
    rows = [*enumerate(texts), (None, texts[0]), (3, texts[3]), (70, None), (71, ""), (72, "Zz9 ," * 50)]
    expected = brute(rows)
    assert any(v[0] for v in expected.values()) and any(v[0] and v[0] != v[1] for v in expected.values())
    assert rows_of(variants.spelling_variants(make_docs(*rows))) == expected


def test_small_rounds_and_pieces_find_the_same(make_docs, texts):
    docs = make_docs(*texts[:20])
    words, _ = variants.common.stored(variants.vocabulary(docs), "vocabulary")
    some = {frozenset((r.a, r.b)) for r in variants.near_pairs(words, round_bytes=5000).collect()}
    counts = brute_words(list(enumerate(texts[:20])))
    assert some == {frozenset((a, b)) for a in counts for b in counts if a < b and one_apart(a, b)}


def test_rounds_stay_within_their_bytes():
    sizes = {7: 3 * variants.PIECE_BLOCKS + 5, 8: 64, 9: 70}
    piece = variants.PIECE_BLOCKS * variants.BLOCK_BYTES
    made = variants.rounds(sizes, 2 * piece)
    assert all(sum(min(variants.PIECE_BLOCKS, sizes[s] - p * variants.PIECE_BLOCKS) for s, p in r)
               * variants.BLOCK_BYTES <= 2 * piece for r in made)
    assert [p for r in made for p in r] == [(7, 0), (7, 1), (7, 2), (7, 3), (8, 0), (9, 0)]
    assert [len(r) for r in made] == [2, 4]


def test_a_shard_in_pieces_holds_what_a_whole_one_holds():
    words = variants.pd.Series(["".join(RANDOM.choice("abcdefgh") for _ in range(9)) for _ in range(3000)])
    hashes = variants.word_hashes(words)
    blocks = 97
    bits = np.zeros(blocks * 8, dtype=np.uint64)
    mixed = variants._mixed(hashes)
    for turn in (0, 1):
        lane, mask = variants._bits(mixed, turn)
        np.bitwise_or.at(bits, (variants._block(mixed, blocks) * np.uint64(8) + lane).astype(np.int64), mask)
    found = np.zeros(len(words), dtype=bool)
    for first, last in ((0, 30), (30, 96), (96, 97)):
        part = variants.Filters({9: blocks})
        part.hold(9, first, bits[first * 8:last * 8])
        places = part.joined().may_hold(9, hashes)
        assert not found[places].any()
        found[places] = True
    assert found.all()
    others = RANDOM.sample(range(1 << 60), 5000)
    whole = variants.Filters({9: blocks})
    whole.hold(9, 0, bits)
    assert len(whole.joined().may_hold(9, np.array(others, dtype=np.uint64))) < 100


def test_no_words(make_docs):
    assert variants.spelling_variants(make_docs(None, "", "short words only")).count() == 0
    assert variants.spelling_variants(make_docs("x").where("false")).count() == 0


def test_very_long_words(make_docs):
    long = "ab" * 20_000
    docs = make_docs(long, long, long[:-1], long[:-1], long[:-1])
    got = rows_of(variants.spelling_variants(docs))
    assert {len(w): v[3] for w, v in got.items()} == {40_000: 1, 39_999: 1}
