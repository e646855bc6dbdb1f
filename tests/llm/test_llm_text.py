"""Fingerprints, near-duplicates, lines, personal data: against brute force, with edge cases."""

import hashlib
import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from loadpulse.llm import components, fingerprint, lines, private, simhash

RANDOM = random.Random(5)
WORDS = ["".join(RANDOM.choice("abcdeéstø") for _ in range(RANDOM.randint(2, 7))) for _ in range(300)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def edited(text, seed, times=1):
    r, words = random.Random(seed), text.split(" ")
    for _ in range(times):
        words[r.randrange(len(words))] = "changed"
    return " ".join(words)


EDGES = [None, "", " ", "one", "one two", "\n\n", "Ünïcode 🙂 text", "be " * 5000, "a" * 100_000]


# --- fingerprints ----------------------------------------------------------------

def test_edited_fingerprints_follow_the_contract(make_docs):
    texts = [*EDGES, prose(200, 1), prose(200, 2), prose(200, 2)]
    docs = make_docs(*[(i * 7 - 3, t) for i, t in enumerate(texts)])
    rows = sorted(fingerprint.edited_fingerprints(docs).collect(), key=lambda r: r.doc_id)
    plain = [t or "" for t in texts]
    assert [r.n_chars for r in rows] == [len(t) for t in plain]
    for r, own, after in zip(rows, plain, plain[1:] + plain[:1], strict=True):
        quarter = len(own) // 4
        text = own[:len(own) - quarter] + after[:quarter]
        assert r.edited_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert r.fingerprint == fingerprint.digest(own)
        assert r.edited_fingerprint == fingerprint.digest(text)
        assert 0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1
    assert rows[-1].fingerprint == rows[-2].fingerprint and rows[-2].near_next == 1.0
    assert rows[-3].near_edited > rows[-3].near_next


def test_one_document_is_its_own_successor_and_none_give_none(make_docs):
    row = fingerprint.edited_fingerprints(make_docs("abcdefgh")).first()
    assert row.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and row.near_next == 1.0
    assert fingerprint.edited_fingerprints(make_docs("x").where("false")).count() == 0


def test_blocks_do_not_change_the_counts(monkeypatch):
    data = prose(3000, 9).encode()
    whole = fingerprint.bucket_counts(data)
    monkeypatch.setattr(fingerprint, "BLOCK_BYTES", 1000)
    assert (fingerprint.bucket_counts(data) == whole).all()


def test_repeated_and_null_ids(make_docs):
    docs = make_docs((1, "b"), (1, "a"), (None, "c"), (1, "a"))
    assert fingerprint.edited_fingerprints(docs).count() == 4


# --- near-duplicates -------------------------------------------------------------

def reference_print(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    n = min(3, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + n]).encode(), 42)
              for i in range(len(words) - n + 1)] if words else []
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def reference_classes(prints, most=3):
    root = {i: i for i in prints}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in prints:
        for j in prints:
            if j < i and (prints[i] ^ prints[j]).bit_count() <= most:
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return {i: top(i) for i in prints}


def test_near_duplicates_are_those_of_all_pairs(make_docs):
    base = [prose(400, s) for s in range(6)]
    texts = [*EDGES, *base, *[edited(b, s) for s in range(12) for b in base[:3]], base[0]]
    docs = make_docs(*texts)
    prints = {i: reference_print(t) for i, t in enumerate(texts)}
    classes = reference_classes(prints)
    got = {r.doc_id: (r.fp & (1 << 64) - 1, r.component_id)
           for r in simhash.near_duplicates(docs).collect()}
    assert got == {i: (prints[i], classes[i]) for i in prints}
    kept = simhash.representatives(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(classes.values()))


def test_links_are_all_pairs_within_three_bits(spark):
    r = random.Random(8)
    start = [r.getrandbits(64) for _ in range(40)]
    prints = set(start)
    for p in start:
        for _ in range(6):
            q = p
            for bit in r.sample(range(64), r.randint(1, 5)):
                q ^= 1 << bit
            prints.add(q)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    found = simhash.links(spark.createDataFrame([(p,) for p in signed], "fp bigint"))
    expected = {(a, b) for a in signed for b in signed
                if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 3}
    assert {(x.a, x.b) for x in found.collect()} == expected


def test_equal_rows_and_null_ids_keep_one(make_docs):
    docs = make_docs((1, "same text here"), (1, "same text here"), (None, "same text here"),
                     (None, "other words entirely"))
    kept = simhash.representatives(docs).collect()
    assert sorted((str(r.doc_id), r.text) for r in kept) == [
        ("1", "same text here"), ("None", "other words entirely")]
    assert simhash.near_duplicates(docs.where("false")).count() == 0


def test_components_of_chains_stars_and_pairs(spark):
    chain = [(i, i + 1) for i in range(40)]
    star = [(100, 100 + i) for i in range(1, 30)]
    edges = spark.createDataFrame([*chain, *star, (201, 200), (300, 300)], "a bigint, b bigint")
    got = {r.node: r.component for r in components.components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 200: 200, 201: 200}
    assert components.components(edges.where("false")).count() == 0


# --- lines -----------------------------------------------------------------------

def reference_removed(texts):
    places, sets = {}, {}
    for i, text in enumerate(texts):
        for place, line in enumerate((text or "").split("\n")):
            plain = re.sub(r"[ \t\n\x0b\f\r]+", " ", line.lower()).strip(" ")
            if plain:
                places.setdefault(plain, []).append((i, place))
                k = lines.SHINGLE_CHARS
                sets[plain] = {plain.ljust(k, "\0")[j:j + k] for j in range(max(1, len(plain) - k + 1))}
    known = list(sets)
    root = {x: x for x in known}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(known):
        for y in known[:i]:
            if len(sets[x] & sets[y]) >= 0.8 * len(sets[x] | sets[y]):
                root[top(x)] = top(y)
    groups = {}
    for x in known:
        groups.setdefault(top(x), []).extend(places[x])
    removed = {}
    for group in groups.values():
        for i, k in sorted(group)[1:]:
            removed.setdefault(i, []).append(k)
    return {i: sorted(k) for i, k in removed.items()}


def test_removed_lines_are_those_of_all_pairs(make_docs):
    base = [prose(60, 50 + s) for s in range(8)]
    texts = [*EDGES, "\n".join(base), "\n".join(edited(b, 3) for b in base), base[2].upper(),
             "short\nshort\nlong  er", "long er", "\n".join(edited(base[0], s) for s in range(20))]
    docs = make_docs(*texts)
    got = {r.doc_id: [int(k) for k in r.removed.split(",")]
           for r in lines.report(docs).collect() if r.removed}
    assert got == reference_removed(texts)
    cleaned = {r.doc_id: r.text for r in lines.deduplicated(docs).collect()}
    assert cleaned[0] is None and cleaned[1] == ""
    assert "short" in cleaned[len(EDGES) + 3] and cleaned[len(EDGES) + 3].count("short") == 1
    assert lines.deduplicated(docs).columns == docs.columns


def test_large_groups_are_compared_block_by_block(make_docs, monkeypatch):
    monkeypatch.setattr(lines, "BLOCK_LINES", 4)
    base = prose(80, 77)
    texts = [base, *[edited(base, s) for s in range(30)]]
    got = {r.doc_id for r in lines.report(make_docs(*texts)).collect() if r.n_removed}
    assert got == set(range(1, 31))


def test_chains_beyond_the_smallest_line(make_docs, monkeypatch):
    """Lines that are similar to some of a band but not to its smallest one."""
    monkeypatch.setattr(lines, "BLOCK_LINES", 4)
    texts = []
    for seed in range(6):
        line = prose(40, 500 + seed)
        for step in range(12):
            texts.append(line)
            line = edited(line, step)
    got = {r.doc_id: [int(k) for k in r.removed.split(",")]
           for r in lines.report(make_docs(*texts)).collect() if r.removed}
    assert got == reference_removed(texts)


def test_sketches_rule_out_no_similar_pair():
    texts = [edited(prose(30, 900 + i // 8), i, i % 8) for i in range(160)]
    hashes, starts = lines.shingle_hashes(texts)
    sets = [set(h.tolist()) for h in np.split(hashes, starts[1:])]
    size, words = lines.sketches(hashes, starts)
    assert size.tolist() == [len(s) for s in sets]
    apart = np.bitwise_count(words[:, None].view(np.uint64) ^ words[None].view(np.uint64)).sum(axis=2)
    for i, a in enumerate(sets):
        assert all(apart[i, j] <= len(a ^ b) for j, b in enumerate(sets))


def test_one_changed_letter_links_short_lines(make_docs):
    r, texts = random.Random(12), []
    for size in range(39, 91):
        line = [r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(size)]
        other = list(line)
        other[r.randrange(4, size - 4)] = "7"
        texts += ["".join(line), "".join(other)]
    got = {row.doc_id: row.n_removed for row in lines.report(make_docs(*texts)).collect()}
    # A pair at 0.8 to 0.9 shares a band with probability 0.995 or more.
    assert not any(got[i] for i in range(0, len(texts), 2))
    assert sum(got[i] for i in range(1, len(texts), 2)) >= len(texts) // 2 - 1


def test_lines_of_a_table_with_clashing_names(spark):
    docs = spark.createDataFrame([(1, "same line", 5, "h", 6, 7), (2, "Same  line", 5, "h", 6, 7)],
                                 "doc_id bigint, text string, _id int, _hash string, removed int, id int")
    got = {r.doc_id: r for r in lines.deduplicated(docs).collect()}
    assert lines.deduplicated(docs).columns == docs.columns
    assert got[1].text == "same line" and got[2].text == ""
    assert (got[2]._id, got[2]._hash, got[2].removed, got[2].id) == (5, "h", 6, 7)


def test_lines_without_a_partner_are_stored_nowhere(make_docs, monkeypatch):
    """What is written follows the lines that may have a partner, not all lines."""
    r, common_words = random.Random(3), [prose(1, s) for s in range(60)]
    base = [" ".join(r.choice(common_words) for _ in range(40)) for _ in range(300)]
    rows, stored = {}, lines.common.stored

    def counted(df, label):
        found = stored(df, label)
        rows[label] = found[0].count()
        return found

    monkeypatch.setattr(lines.common, "stored", counted)
    docs = make_docs(*base, base[7], edited(base[9], 5))
    got = {row.doc_id: row.n_removed for row in lines.report(docs).collect()}
    assert {i for i, n in got.items() if n} == {300, 301}
    assert all(n < 100 for n in rows.values()), rows


def test_similarities_of_pairs_are_those_of_sets():
    texts = [edited(prose(12, 40 + i // 4), i, i % 4) for i in range(24)] + ["ab", "aaaaaaaa"]
    hashes, starts = lines.shingle_hashes(texts)
    sets = [set(h.tolist()) for h in np.split(hashes, starts[1:])]
    a, b = (np.array(x) for x in zip(*[(i, j) for i in range(len(sets)) for j in range(len(sets))], strict=True))
    assert lines.similarities(hashes, starts, a, b).tolist() == [
        len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i, j in zip(a, b, strict=True)]


def test_bands_find_similar_lines_and_hardly_others():
    """At 0.8 as many pairs as ten bands of four rows, at 0.2 far fewer."""
    r, n, size = np.random.default_rng(8), 3000, 120

    def share(similarity):
        both = round(size * 2 * similarity / (1 + similarity))
        one = r.integers(0, 1 << 32, (n, size), dtype=np.uint32)
        other = np.c_[one[:, :both], r.integers(0, 1 << 32, (n, size - both), dtype=np.uint32)]
        keys = [lines.band_keys(lines.minima(x.ravel().copy(), np.arange(0, n * size, size)))
                for x in (one, other)]
        return (keys[0] == keys[1]).any(axis=1).mean()

    assert share(0.8) > 0.99 and share(0.9) == 1
    assert share(0.2) < 0.003


def test_no_lines(make_docs):
    assert lines.report(make_docs("x").where("false")).count() == 0


# --- personal data ---------------------------------------------------------------

def luhn(digits):
    turned = [int(d) for d in reversed(digits)]
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(turned)) % 10 == 0


def reference_spans(text):
    found = [(m.start(), 0, m.end()) for m in
             re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            found.append((m.start(), 3, m.end()))
    return ",".join(f"{private.KINDS[k]}:{s}:{e}" for s, k, e in sorted(found))


def test_base_spans_are_those_of_the_patterns(make_docs):
    r = random.Random(3)
    bits = ["@", ".", "..", "a", "b-", "1", "12", "255", "256", "+", "+1", " ", "-", "  ", "(", ")", "_",
            "4111 1111 1111 1111", "a@b.c", "%", "é", "\n", "x@y", ".com", "1.2.3.4", "+33 1 23 45 67 89"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 25))) for _ in range(1500)]
    texts += [t or "" for t in EDGES] + ["1" * 50_000, "a@" + "b." * 20_000 + "c", "1 " * 50_000]
    got = {x.doc_id: x for x in private.report(make_docs(*texts)).collect()}
    for i, text in enumerate(texts):
        expected = reference_spans(text)
        assert got[i].base_sha256 == hashlib.sha256(expected.encode()).hexdigest(), text[:200]
        base = ",".join(s for s in got[i].spans.split(",") if not s.startswith(("term", "removed")))
        assert base == expected
    assert got[0].n_email == reference_spans(texts[0]).count("email")


def test_words_that_reveal_an_entity_are_masked(make_docs):
    filler = [prose(40, 900 + s) for s in range(60)]
    texts = [f"{prose(9, 1)} director zanzibar ann@example.org {prose(9, 2)}",
             f"{prose(9, 3)} zanzibar wrote ann@example.org {prose(9, 4)}", "nothing here", *filler]
    docs = make_docs(*texts)
    got = {r.doc_id: r.spans for r in private.report(docs).collect()}
    place = texts[0].index("zanzibar")
    assert f"removed:{place}:{place + 8}" in got[0] and "email" in got[0] and "removed" in got[1]
    assert "director" in texts[0] and got[0].count("removed") == 1  # one context is not enough
    assert not any(got[i] for i in range(2, len(texts)))
    clean = {r.doc_id: r.text for r in private.sanitised(docs).collect()}
    assert "zanzibar" not in clean[0] and "[EMAIL]" in clean[0] and clean[2] == "nothing here"


def test_a_revealing_word_is_masked_where_it_stands_alone(make_docs):
    texts = [f"{prose(9, 1)} zanzibar ann@example.org {prose(9, 2)}",
             f"{prose(9, 3)} zanzibar wrote ann@example.org {prose(9, 4)}",
             f"Zanzibar, {prose(30, 5)} zanzibar", *[prose(40, 900 + s) for s in range(60)]]
    docs = make_docs(*texts)
    got = {r.doc_id: r.spans for r in private.report(docs).collect()}
    end = len(texts[2])
    assert got[2] == f"term:0:8,term:{end - 8}:{end}"    # two documents of three
    assert not any(got[i] for i in range(3, len(texts)))
    clean = {r.doc_id: r.text for r in private.sanitised(docs).collect()}
    assert clean[2] == f"[WORD]{texts[2][8:-8]}[WORD]" and clean[3] == texts[3]


def test_many_spans_in_one_text(make_docs):
    r = random.Random(8)
    pieces = [r.choice(["ann@example.org", "10.0.0.1", "+33 1 23 45 67 89", "é so", "nothing"])
              for _ in range(20_000)]
    text = " ".join(pieces)
    docs = make_docs(text, " ".join(pieces[:256]), " ".join(pieces[:300]))
    expected = {i: reference_spans(t) for i, t in enumerate([text, " ".join(pieces[:256]), " ".join(pieces[:300])])}
    for row in private.report(docs).collect():
        assert row.base_sha256 == hashlib.sha256(expected[row.doc_id].encode()).hexdigest()
    plain = private.masked(F.col("text"), private.base_spans(F.col("text")))
    for row in docs.select("doc_id", "text", plain.alias("clean")).collect():
        out, at = [], 0
        for kind, start, end in (x.split(":") for x in expected[row.doc_id].split(",")):
            if int(start) >= at:
                out += [row.text[at:int(start)], private.MASKS[private.KINDS.index(kind)]]
            at = max(at, int(end))
        assert row.clean == "".join(out) + row.text[at:]


def test_sanitised_keeps_columns_of_any_name(make_docs):
    names = ["_id", "_hash", "_every", "masked_id", "Masked_Hash", "masked_spans", "spans", "every", "a.b"]
    docs = make_docs("x@y.zz", None, "x@y.zz and more").withColumns({n: F.lit(n) for n in names})
    kept = private.sanitised(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert sorted(str(r.text) for r in rows) == ["None", "[EMAIL]", "[EMAIL] and more"]
    assert all(r[n] == n for r in rows for n in names)


def test_a_term_used_everywhere_reveals_nothing(make_docs):
    texts = [f"{prose(9, s)} common ann@example.org {prose(9, s + 50)}" for s in range(2)]
    texts += [f"common {prose(9, s + 200)}" for s in range(10)]
    assert not any("common" in t and ("term" in s or "removed" in s) for t, s in zip(
        texts, [r.spans for r in private.report(make_docs(*texts)).orderBy("doc_id").collect()], strict=True))


def test_private_null_empty_and_equal_rows(make_docs):
    rows = private.report(make_docs((1, None), (1, ""), (2, "x@y.zz"), (2, "x@y.zz"), (None, "x@y.zz"))).collect()
    assert sorted(r.spans for r in rows) == ["", "", "email:0:6", "email:0:6", "email:0:6"]
    assert private.report(make_docs("x").where("false")).count() == 0
