"""Every operator against a plain version, over nulls, empty and long texts, ties, repeats, empty tables and clashing names."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wayfield.llm import bloom_lm, bpe, exact, flat, licenses, mixing, near, pretoken, quality_model, repetition, toxicity, trie

from . import brute


def test_repeats_are_those_of_all_pairs_of_suffixes(spark):
    texts = ["a b c d e f g x a b c d e f g", "A b a B a b a b a b a b a b", None, "", "...", "one two three", " ".join(["la le li lo lu ly"] * 9), "p q r s t u p q r s t v p q r s t u"]
    df = spark.createDataFrame([(k, x, k) for k, x in enumerate(texts)], "doc_id long, text string, covered_fraction long")
    got = {r.doc_id: r for r in repetition.measure(df).collect()}
    for k, x in enumerate(texts):
        covered, longest = brute.repeats(x)
        assert got[k]["__repeats"]["covered_fraction"] == pytest.approx(covered) and got[k]["__repeats"]["longest_repeat"] == longest, x
        assert got[k]["__repeats"]["n_repeats"] == brute.maximal_repeats(x), x
        assert got[k].covered_fraction == k


def test_repetition_on_random_texts():
    r = np.random.default_rng(1)
    texts = [" ".join(r.choice(["u", "v", "w"], r.integers(0, 60))) for _ in range(60)]
    fraction, longest, many = repetition.repeats(*flat.flat(pa.array(texts)), 3)
    for x, f, most, n in zip(texts, fraction, longest, many):
        assert (pytest.approx(f), most) == brute.repeats(x, 3) and n == brute.maximal_repeats(x, 3), x


def test_a_repeat_counts_once_however_many_words_it_has():
    ten = " ".join(f"w{k}" for k in range(10))
    assert repetition.repeats(*flat.flat(pa.array([f"{ten} x {ten} y"])))[2].tolist() == [1]


def test_repetition_rule_keeps_plain_and_missing_texts(spark, docs, corpus, empty):
    kept = repetition.passing(docs)
    looped = {k for k, (_, x, _) in enumerate(corpus) if x and len(x) < 2000 and brute.repeats(x)[0] > repetition.COVERED}
    assert looped and {r.n for r in kept.collect()} == set(range(len(corpus))) - looped and set(docs.columns) < set(kept.columns)
    again = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(70)) + " and " + " ".join(f"w{i}" for i in range(70)))], "doc_id long, text string")
    assert repetition.passing(again).count() == 0
    assert repetition.passing(empty).count() == 0


def test_bpe_tokens_are_the_tokenizer_s(docs, corpus, empty):
    tiktoken = pytest.importorskip("tiktoken")
    import base64

    with open(bpe.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    own = tiktoken.Encoding("test", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    rows = bpe.encode(docs, check=True).collect()
    assert len(rows) == len(corpus)
    for r in rows:
        text = corpus[r.n][1]
        assert r.tokens == (None if text is None else own.encode_ordinary(text)) and r.round_trip in (True, None)
        assert (r.key, r.rep) == (f"e{r.n}", r.n)
    back = {r.n: r.text for r in bpe.decode(bpe.encode(docs)).collect()}
    assert back == {k: x for k, (_, x, _) in enumerate(corpus)}
    assert bpe.encode(empty, check=True).count() == 0


def test_merge_rounds_on_a_small_vocabulary():
    v = bpe.load()
    table = {(int(k) >> 32, int(k) & 0xFFFFFFFF): int(x) for k, x in zip(v.pairs, v.ranks)}
    for word in (b"aaaaaaa", b"lowest", b"ababab", b"x", b" the", "é漢".encode()):
        symbols = v.bytes[np.frombuffer(word, np.uint8)]
        assert bpe.merge_rounds(v, symbols, np.array([0, len(word)]))[0].tolist() == brute.merged(table, symbols.tolist())


def test_pretokens_are_the_pattern_s():
    regex = pytest.importorskip("regex")
    pattern = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
    r = np.random.default_rng(2)
    texts = ["".join(r.choice(list("ab1 '\n\tséx.!漢 tmdlrve "), r.integers(0, 40))) for _ in range(500)]
    data, offsets = flat.flat(pa.array(texts))
    cuts, first = pretoken.split(data, offsets)
    parts = [data[a:b].tobytes().decode() for a, b in zip(cuts, cuts[1:])]
    for k, x in enumerate(texts):
        assert parts[first[k] : first[k + 1]] == pattern.findall(x), repr(x)


def test_token_counts_are_the_cheapest_splits(docs, corpus, empty):
    costs = {bytes([b]): 9000 + b for b in range(256)} | {b"ab": 5000, b"abc": 7000, b" a": 6000, b"chang": 100, b"ed": 200, b"aa": 9000, b"aaa": 13000}
    v = trie.vocabulary(costs)
    texts = ["abcabc ab", "aaaaaa", "", "changed a", "é漢 x", "don't"]
    n, tokens, cost = trie.count_batch(v, *flat.flat(pa.array(texts)))
    data, offsets = flat.flat(pa.array(texts))
    cuts, first = pretoken.split(data, offsets)
    for k, x in enumerate(texts):
        parts = [brute.best_split(costs, data[a:b].tobytes()) for a, b in zip(cuts[first[k] : first[k + 1]], cuts[first[k] + 1 : first[k + 1] + 1])]
        assert (n[k], tokens[k], cost[k]) == (len(parts), sum(p[1] for p in parts), sum(p[0] for p in parts)), x
    rows = {r.n: r["__counts"] for r in trie.counts(docs).collect()}
    assert len(rows) == len(corpus) and all(tuple(rows[k]) == (0, 0, 0) for k, (_, x, _) in enumerate(corpus) if not x)
    assert trie.counts(empty).count() == 0


def test_long_unbroken_texts_are_counted_in_little_time():
    import time

    costs = {bytes([b]): 9000 + b for b in range(256)} | {b"ab": 5000, b"abc": 7000, b"ababab": 9000, b"bca" * 50: 4000}
    v = trie.vocabulary(costs)
    texts = ["".join(np.random.default_rng(2).choice(list("abc"), 900)) + "bca" * 200, "abc" * 3]
    own, trie.WINDOW = trie.WINDOW, 100
    try:
        _, tokens, cost = trie.count_batch(v, *flat.flat(pa.array(texts)))
    finally:
        trie.WINDOW = own
    assert [tuple(map(int, x)) for x in zip(cost, tokens)] == [brute.best_split(costs, x.encode()) for x in texts]
    v, text = trie.load(), "".join(np.random.default_rng(1).choice(list("abcdefghijklmnop"), 40_000))
    pretoken.classes()
    began = time.time()
    assert trie.count_batch(v, *flat.flat(pa.array([text])))[1][0] > 1000 and time.time() - began < 5  # one step of the trie for each byte took 25 s


def test_machine_learns_a_pure_interaction():
    """Labels that are the exclusive or of two words: neither says anything by itself."""
    r = np.random.default_rng(3)
    rows = []
    for _ in range(3000):
        a, b = r.integers(0, 2, 2)
        words = [f"w{k}" for k in r.integers(0, 200, 20)] + ["insult"] * a + ["group"] * b
        rows.append((int(a != b), " ".join(r.permutation(words))))
    doc, term = toxicity.terms(*flat.flat(pa.array([x for _, x in rows])))
    sets = [np.unique(t) for t in np.split(term[np.argsort(doc, kind="stable")], np.cumsum(np.bincount(doc))[:-1])]
    model = toxicity.fit_arrays([(y, s) for (y, _), s in zip(rows[:2000], sets[:2000])])
    p = toxicity.score_batch(model, *flat.flat(pa.array([x for _, x in rows[2000:]])))
    assert np.mean((p > 0.5) == [y == 1 for y, _ in rows[2000:]]) > 0.95


def test_machine_s_loss_and_slopes_are_the_plain_ones():
    r = np.random.default_rng(4)
    y, sets = np.array([0.0, 1, 1, 0, 1]), [[0, 2], [1], [0, 1, 3], [], [2, 3]]
    row, term = (np.array([x for k, s in enumerate(sets) for x in ([k] * len(s) if own else s)]) for own in (True, False))
    theta = r.normal(0, 0.5, 1 + 4 + 2 * 4)

    def loss(theta):
        w, v = theta[1:5], theta[5:].reshape(2, 4)
        total = 0.0
        for label, s in zip(y, sets):
            logit = theta[0] + sum(w[i] for i in s) + sum(float(v[:, i] @ v[:, j]) for a, i in enumerate(s) for j in s[a + 1 :])
            total += math.log1p(math.exp(logit)) - label * logit
        return total / len(y)

    found, slopes = toxicity.loss_and_slopes(theta, 2, y, row, term)
    assert found == pytest.approx(loss(theta))
    for k in range(len(theta)):
        step = np.eye(len(theta))[k] * 1e-6
        assert slopes[k] == pytest.approx((loss(theta + step) - loss(theta - step)) / 2e-6, abs=1e-6)


def test_ordinal_slopes_are_those_of_the_likelihood():
    r = np.random.default_rng(5)
    y, score, shape = r.integers(0, 3, 20), r.normal(0, 1, 20), np.array([-0.4, 0.3])
    found = lambda s, f: quality_model.loss_and_slopes(y, s, f)[0]
    theta = [-0.4, -0.4 + math.exp(0.3)]
    sigmoid = lambda x: 1 / (1 + math.exp(-x))
    below = [[0.0, *(sigmoid(t - s) for t in theta), 1.0] for s in score]
    assert found(score, shape) == pytest.approx(-np.mean([math.log(b[k + 1] - b[k]) for k, b in zip(y, below)]))
    _, by_score, by_shape = quality_model.loss_and_slopes(y, score, shape)
    for values, slopes, at in ((score, by_score, lambda v: found(v, shape)), (shape, by_shape, lambda v: found(score, v))):
        for k in range(len(values)):
            step = np.eye(len(values))[k] * 1e-6
            assert slopes[k] == pytest.approx((at(values + step) - at(values - step)) / 2e-6, abs=1e-6)


def test_ordinal_model_puts_the_middle_grade_between(spark):
    """Three grades: junk, good prose with insults, good prose."""
    r = np.random.default_rng(8)
    good, bad, insults = [f"good{k}" for k in range(80)], ["BUY", "click", "!!!", "$$$"], ["idiot", "scum", "moron"]
    rows, labels = [], []
    for k in range(1500):
        grade = k % 3
        words = r.choice(bad if grade == 0 else good, 40).tolist() + (r.choice(insults, 12).tolist() if grade == 1 else [])
        rows.append((k, " ".join(r.permutation(words))))
        labels.append((k, int(grade > 0), int(grade == 1)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = quality_model.fit(df, spark.createDataFrame([x for x in labels if x[0] < 900], "doc_id long, quality int, toxic int"))
    got = {x.doc_id: x["__rating"] for x in quality_model.score(df, model).collect()}
    held = range(900, 1500)
    assert np.mean([round(got[k].expected_grade) == k % 3 for k in held]) > 0.9
    assert np.mean([(got[k].p_good >= 0.5) == (k % 3 > 0) for k in held]) > 0.95
    means = [np.mean([got[k].expected_grade for k in held if k % 3 == g]) for g in range(3)]
    assert means[0] < 0.4 and 0.7 < means[1] < 1.3 and means[2] > 1.6


CLASHES = ["__lower", "__repeats", "tokens", "round_trip", "__counts", "__lm", "__rating", "__toxic", "__file", "__row", "_metadata", "__source", "__n", "__gone", "__start"]


def test_columns_of_clashing_names_stay_as_they_are(spark):
    schema = "doc_id long, text string, source string, " + ", ".join(f"`{c}` long" for c in CLASHES)
    values = [10 * k for k in range(len(CLASHES))]
    df = spark.createDataFrame([(k, f"alpha beta gamma delta number{k}", "s", *values) for k in range(4)] + [(4, None, None, *values)], schema)
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 1), (2, 1, 1)], "doc_id long, quality int, toxic int")
    results = [
        repetition.measure(df), repetition.passing(df), bpe.encode(df, check=True), trie.counts(df), bloom_lm.score(df), bloom_lm.score(df, 10), exact.drop_duplicates(df), exact.kept_with_copies(df),
        mixing.mix(df, block=4), near.drop_near_duplicates(df), toxicity.score(df, toxicity.fit(df.select("doc_id", "text"), labels)), toxicity.toxic(df, None), quality_model.selected(df, quality_model.fit(df.select("doc_id", "text"), labels)),
    ]
    for out in results:
        rows = out.collect()
        for c, v in zip(CLASHES, values):
            assert c not in out.columns or {r[c] for r in rows} <= {v}, (out.columns, c)
    assert all(set(CLASHES) <= set(results[k].columns) for k in (0, 1, 2, 3, 4, 5, 6, 8, 9, 10, 12))
    assert [results[k].count() for k in (0, 1, 2, 3, 4, 5, 6, 10)] == [5] * 8
    assert mixing.schedule(df, block=4).count() > 0 and licenses.scan(df).count() == 0 and near.linked(df).count() == 4


def test_identifiers_of_other_types(spark):
    df = spark.createDataFrame([("b", "x y"), ("a", "x y"), (None, "x y"), ("c", "z")], "doc_id string, text string")
    assert sorted((r.doc_id, r.copies) for r in exact.kept_with_copies(df).collect()) == [("a", 3), ("c", 1)]
    with pytest.raises(TypeError):
        near.linked(df)


def test_toxicity_needs_the_interaction(spark, empty):
    r = np.random.default_rng(3)
    fill = [f"w{k}" for k in range(200)]
    rows = []
    for k in range(1200):
        a, b = r.integers(0, 2, 2)
        words = [*r.choice(fill, 20), *(["insult"] if a else ["praise"]), *(["group"] if b else ["other"])]
        rows.append((k, " ".join(r.permutation(words)), int(a and b)))
    df = spark.createDataFrame([(k, x, "s", 0.5) for k, x, _ in rows] + [(5000, None, "s", 0.5), (5001, "", "s", 0.5), (None, "plain words", "s", 0.5)], "doc_id long, text string, toxic string, w double")
    labels = spark.createDataFrame([(k, 1, y) for k, _, y in rows if k < 800] + [(None, 1, 1), (3, 1, None), (99999, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(df.select("doc_id", "text"), labels)
    got = {x.doc_id for x in toxicity.toxic(df, model, 0.5).collect()}
    held = [(k, y) for k, _, y in rows if k >= 800]
    assert sum((k in got) == bool(y) for k, y in held) / len(held) > 0.97
    assert not got & {5000, 5001, None}
    assert toxicity.score(df, model).count() == df.count() and toxicity.toxic(empty, model).count() == 0
    assert toxicity.toxic(df, toxicity.fit(df.select("doc_id", "text"), labels.where("toxic = 0"))).count() == 0


def test_license_scan_is_the_join_of_all_lines_and_templates(spark, empty):
    lines = ["Licensed under the Apache License, Version 2.0.", "x\nReleased under the MIT License.\ny", "licensed apache license version the", None, "", "\n\n", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "mit", "All RIGHTS reserved, copyright 2020"]
    grant = licenses.TEMPLATES["MIT grant"].split()
    lines += ["intro\n" + " ".join(grant[:8]) + "\n\n" + " ".join(grant[8:15]) + "\nx " + " ".join(grant[15:]) + "\nall\nrights here\nreserved", "all\n" * 7 + "rights reserved", "all\n" + "x\n" * 7 + "rights reserved"]
    df = spark.createDataFrame([(k if k != 2 else None, x, "l") for k, x in enumerate(lines)] + [(0, lines[0], "l")], "doc_id long, text string, license string")
    want = Counter((d, *block) for d, x, _ in df.collect() for block in brute.license_blocks(x, licenses.TEMPLATES, 0.8, licenses.SPAN))
    assert Counter(map(tuple, licenses.scan(df).collect())) == want and want
    assert licenses.scan(empty).count() == 0
    assert licenses.scan(df, {"none": "..."}).count() == 0


def test_license_scan_of_random_lines_and_each_filter_keeps_some_out(spark):
    r = np.random.default_rng(11)
    words = [w for x in licenses.TEMPLATES.values() for w in licenses.words_of(x)] + [f"f{k}" for k in range(30)]
    texts = ["\n".join(" ".join(r.choice(words, r.integers(0, 9))) for _ in range(r.integers(1, 14))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    small = {"a": "f1 f2 f3", "b": "Licensed under the Apache License", "c": "this is the license"}
    for templates, t in ((licenses.TEMPLATES, 0.4), (small, 0.7)):
        want = Counter((d, *block) for d, x in enumerate(texts) for block in brute.license_blocks(x, templates, t, licenses.SPAN))
        assert Counter(map(tuple, licenses.scan(df, templates, t).collect())) == want and len(want) > 50
    vocabulary = licenses.Vocabulary(licenses.TEMPLATES)
    index = licenses.Index.of(vocabulary, list(licenses.TEMPLATES.values()), licenses.frequencies(df, vocabulary), 0.6)
    number = {w: k for k, w in enumerate(vocabulary.words)}
    at = np.array(sorted({(d, n, number[w]) for d, x in enumerate(texts) for n, line in enumerate(x.split("\n")) for w in brute.words(line) if w in number}))
    licenses.anchors(index, *at.T, passed := [0, 0, 0])
    assert len(index.entries(at[:, 2])[0]) > passed[0] > passed[1] > passed[2] > 0


def test_license_scan_finds_each_kind_of_line_of_the_tables(spark):
    lines = ["Licensed under the Apache License, Version 2.0.", "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.", "All rights reserved.", "Copyright, all rights reserved.", "Rights reserved to all."]
    df = spark.createDataFrame([(k, f"before\n{x}\nafter") for k, x in enumerate(lines)], "doc_id long, text string")
    found = {(r.doc_id, r.license) for r in licenses.scan(df).where("line = 1").collect()}
    assert found >= {(0, "Apache-2.0"), (1, "MIT"), (2, "GPL-3.0"), (3, "CC-BY-NC-4.0"), (4, "All rights reserved, alone"), (5, "All rights reserved")}
    assert (4, "All rights reserved") not in found


@pytest.mark.parametrize("bits", [256, 8])
def test_exact_dedup_keeps_one_row_of_each_text(docs, corpus, bits):
    """With digests of 8 bits most hits are of other texts, which stay."""
    kept = exact.drop_duplicates(docs, bits).collect()
    texts = [r.text for r in kept]
    assert Counter(texts) == Counter({x: 1 for _, x, _ in corpus if x is not None} | {None: sum(x is None for _, x, _ in corpus)})
    if bits == 256:
        for r in kept:
            if r.text is not None:
                same = [d for d, x, _ in corpus if x == r.text]
                assert r.doc_id == min((d for d in same if d is not None), default=None)
        assert kept[0].__fields__ == docs.columns


def test_exact_dedup_counts_and_empty_tables(docs, corpus, empty):
    copies = Counter(x for _, x, _ in corpus if x is not None)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.copies) for r in exact.kept_with_copies(docs).collect())
    first = {}
    for d, x, _ in corpus:
        if x is not None:
            first[x] = min((v for v in (first.get(x, d), d) if v is not None), default=None)
    want = [(d is None, d or 0, copies[x]) for x, d in first.items()] + [(d is None, d or 0, 1) for d, x, _ in corpus if x is None]
    assert got == sorted(want)
    assert exact.drop_duplicates(empty).count() == 0


def test_exact_dedup_state_goes_on_where_it_was_left(spark, tmp_path):
    schema = "doc_id long, text string"
    keys, state, out = (str(tmp_path / x) for x in ("keys", "state", "out"))
    for part in ([(1, "a"), (2, "b")], [(3, "a"), (4, "c")]):
        df = spark.createDataFrame(part, schema).withColumn("__file", F.lit("f")).withColumn("__row", F.col("doc_id"))
        k = exact.keyed(df)
        k.write.mode("append").parquet(keys)
        found = exact.run_stream(spark, keys, k.schema, state, out)
    rows = {r["__keeper"]["__id"]: r["__n"] for r in found.collect()}
    assert rows == {1: 2, 2: 1, 4: 1}


def plain_schedule(rows, block=64, alpha=0.8, seed=7):
    """Slots and pieces, one token at a time."""
    import hashlib

    by: dict[str, list] = {}
    for d, x, s in rows:
        n = 0 if not x else sum(c in " \n\t\r" for c in x) + 1
        by.setdefault(s or "", []).append((hashlib.md5(f"{seed}|{d if d is not None else '~'}".encode()).hexdigest(), d, n))
    totals = {s: sum(n for *_, n in v) for s, v in by.items()}
    sources = mixing.plan(totals, None, block, alpha)
    drawn, slot = {s: 0 for s, *_ in sources}, 0
    out = []
    while sources and any(drawn[s] < b for s, _, _, b, _ in sources):
        point = (slot + 1) * mixing.PHI % mixing.RANGE
        s, _, _, b, _ = next(x for x in sources if x[1] <= point < x[2])
        out.append((slot, s, drawn[s] % b, drawn[s] // b))
        drawn[s] += 1
        slot += 1
    return out, totals


def test_schedule_follows_the_points_and_fills_its_blocks(docs, corpus, empty):
    got = mixing.schedule(docs, block=64).collect()
    want, totals = plain_schedule(corpus)
    assert sorted({(r.slot, r.source, r.block, r.epoch) for r in got}) == want
    filled = Counter()
    for r in got:
        filled[r.slot] += r.to_token - r.from_token
    assert set(filled.values()) == {64}
    once = Counter()
    for r in got:
        if r.epoch == 0:
            once[r.source] += r.to_token - r.from_token
    assert all(0 <= once[s] - n < 64 for s, n in totals.items() if n)
    assert mixing.schedule(empty).count() == 0 and mixing.mix(empty).count() == 0


def test_mix_keeps_every_document_of_a_source_with_tokens(docs, corpus):
    rows = mixing.mix(docs, block=64)
    assert rows.columns == docs.columns and {r.n for r in rows.select("n").collect()} == set(range(len(corpus)))


def test_mix_keeps_texts_without_a_token_once_and_gives_slots(spark):
    df = spark.createDataFrame([(1, "", None), (2, None, None), (3, "", "b"), (4, "one two", "b"), (5, "", "c")], "doc_id long, text string, source string")
    got = sorted((r.doc_id, r.slot is None) for r in mixing.mix(df, block=2, slot="slot").collect())
    assert set(got) == {(1, True), (2, True), (3, False), (4, False), (5, True)} and Counter(d for d, _ in got)[1] == 1
    with pytest.raises(ValueError):
        mixing.mix(df.union(spark.createDataFrame([(6, "x", "a")], df.schema)), {"a": 1e-12, "b": 1.0})


def test_no_source_is_lost_by_any_weights(spark):
    """Of many random mixtures each source has every block of its own, however small its share."""
    r = np.random.default_rng(12)
    for _ in range(1000):
        totals = {f"s{k}": int(10 ** r.uniform(1, 5.5)) for k in range(r.integers(1, 5))}
        sources = mixing.plan(totals, None if r.random() < 0.5 else {s: 10 ** r.uniform(-3, 0) for s in totals}, 4096, 0.8)
        n = np.arange(1, 1 << 17, dtype=np.uint64) * np.uint64(mixing.PHI) % np.uint64(mixing.RANGE)
        for s, low, high, blocks, _ in sources:
            assert np.count_nonzero((n >= low) & (n < high)) >= blocks, (sources, s)
    for seed in range(5):
        r = np.random.default_rng(seed)
        totals = [int(10 ** r.uniform(0, 3)) for _ in range(4)]
        df = spark.createDataFrame([(k * 1000 + i, "w " * 9, f"s{k}") for k, n in enumerate(totals) for i in range(max(1, n // 10))], "doc_id long, text string, source string")
        weights = {f"s{k}": float(10 ** r.uniform(-3, 0)) for k in range(4)}
        assert mixing.mix(df, weights, block=16).select("doc_id").distinct().count() == df.count()


def test_points_go_through_their_range(spark):
    slots = [0, 1, 5, 2**31, 2**32 - 2, 2**32 - 1, 2**40 + 17]
    df = spark.createDataFrame([(s,) for s in slots], "slot long").select(mixing.point_of(F.col("slot")).alias("p"))
    assert [r.p for r in df.collect()] == [(s + 1) * mixing.PHI % mixing.RANGE for s in slots]


def test_mix_waits_for_a_source_whose_first_point_comes_late(spark):
    """Of 3,574 parts one is the null source's; the golden-ratio points first meet it in slot 4180."""
    rows = [(k, "w " * 50, "hot") for k in range(40)] + [(40, "one two three four five six seven eight nine ten eleven twelve", None)]
    df, weights = spark.createDataFrame(rows, "doc_id long, text string, source string"), {"hot": 3573.0, "": 1.0}
    assert {r.doc_id for r in mixing.mix(df, weights, block=16).select("doc_id").distinct().collect()} == set(range(41))
    late = mixing.schedule(df, weights, block=16)
    assert {(r.slot, r.source, r.doc_id) for r in late.where("source = ''").collect()} == {(4180, "", 40)}
    assert late.agg(F.max("slot")).first()[0] == 4180


def test_schedule_shares_are_near_the_weights(spark):
    df = spark.createDataFrame([(k, "w " * 50, "ab"[k % 2]) for k in range(400)], "doc_id long, text string, source string")
    slots = mixing.schedule(df, {"a": 3.0, "b": 1.0}, block=51).select("slot", "source").distinct().orderBy("slot").collect()
    for n in range(20, len(slots), 20):
        assert abs(sum(r.source == "a" for r in slots[:n]) - 0.75 * n) < 3


def test_language_model_is_that_of_its_levels(docs, corpus, empty):
    want = brute.language_model([x for _, x, _ in corpus])
    rows = {r.n: r["__lm"] for r in bloom_lm.score(docs).collect()}
    assert [rows[k].n_words for k in range(len(want))] == [n for n, _ in want]
    # a false positive, about one probe in 45, raises a level by one and a word's score by a bit at most
    assert sum(abs((rows[k].log2p or 0) - total) for k, (_, total) in enumerate(want)) <= 0.05 * sum(n for n, _ in want)
    assert all((rows[k].log2p is None) == (n == 0) for k, (n, _) in enumerate(want))
    assert bloom_lm.score(empty).count() == 0


def test_language_model_that_is_not_broadcast_gives_the_same(docs):
    one = {r.n: r["__lm"] for r in bloom_lm.score(docs).collect()}
    sent = bloom_lm.score(docs, most=1000)
    many = {r.n: r["__lm"] for r in sent.collect()}
    assert len(one) == len(many) and all(one[k].n_words == many[k].n_words and one[k].log2p == (many[k].log2p and pytest.approx(many[k].log2p)) for k in one)


def test_language_model_sends_a_row_for_each_group_and_segment(spark, tmp_path):
    """Rows for groups of 256 KB took longer than the n-grams in them: segments grow with the texts, so rows as the square of the texts."""
    r = np.random.default_rng(3)
    rows = [(k, " ".join(f"w{x}" for x in r.integers(0, 5000, 10_000))) for k in range(60)]  # 3.4 MB
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(path := str(tmp_path / "texts"))
    sc = spark.sparkContext
    store = sc._jsc.sc().statusStore()

    def sent():
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        stages = store.stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
        return {stages.apply(k).stageId(): stages.apply(k).shuffleWriteRecords() for k in range(stages.size())}

    before = sent()
    assert bloom_lm.score(spark.read.parquet(path), most=1000).agg(F.sum("__lm.n_words")).first()[0] == 600_000
    # a group's n-grams to 4 segments and their levels back, the group, and a few rows of sums
    assert sum(n for stage, n in sent().items() if stage not in before) <= 20


def test_language_model_of_many_groups_and_without_text(docs, monkeypatch):
    one = {r.n: r["__lm"] for r in bloom_lm.score(docs).collect()}
    monkeypatch.setattr(bloom_lm, "GROUP", 2000)
    sent = bloom_lm.score(docs, most=1000, keep_text=False)
    assert sent.columns == [*(c for c in docs.columns if c != "text"), "__lm"] and bloom_lm.score(docs, keep_text=False).columns == sent.columns
    many = {r.n: r["__lm"] for r in sent.collect()}
    assert len(one) == len(many) and all(one[k].n_words == many[k].n_words and one[k].log2p == (many[k].log2p and pytest.approx(many[k].log2p)) for k in one)


def test_filter_has_no_false_negatives():
    r = np.random.default_rng(4)
    keys, counts = r.integers(0, 2**63, 5000).astype(np.uint64), r.integers(1, 300, 5000)
    bits, blob = bloom_lm.segment(keys, counts)
    f = bloom_lm.assemble([(0, bits, blob)], 1)
    got = f.levels(keys, np.zeros(5000, np.int64))
    assert (got >= bloom_lm.levels_of(counts)).all() and (got == bloom_lm.levels_of(counts)).mean() > 0.9
    assert (f.levels(r.integers(0, 2**63, 5000).astype(np.uint64), np.zeros(5000, np.int64)) == 0).mean() > 0.9


@pytest.mark.parametrize("t", [0.3, 0.6, 0.9])
def test_jaccard_join_finds_all_pairs(docs, corpus, t):
    got = {(r.doc_a, r.doc_b): r.jaccard for r in near.jaccard_join(docs, t).collect()}
    assert got == brute.similar_pairs([r[:2] for r in corpus], t)
    assert {(r.doc_id, r.class_id): r.n_links for r in near.linked(docs, t).collect()} == brute.links([r[:2] for r in corpus], t)


def test_lists_are_skipped_by_blocks():
    """Of one list with entries at either end of their prefixes, blocks of the other end are not looked at, and no pair is lost."""
    n = 400
    doc, size, pos = np.arange(n), np.full(n, 50), np.repeat([0, 20], n // 2)
    doc, size, pos, far = near.ordered_lists(np.zeros(n, np.int64), doc, size, pos, 0.6)
    tested = [0, 0]
    found = {(int(a), int(b)) for x, y, _ in near.list_pairs(doc, size, pos, far, np.arange(n), 0.6, tested) for a, b in zip(x, y)}
    need, rest = near.least_overlap(50, 50, 0.6), size - pos
    at = {int(d): k for k, d in enumerate(doc)}
    want = {(a, b) for a in range(n) for b in range(a + 1, n) if min(rest[at[a]], rest[at[b]]) + min(pos[at[a]], pos[at[b]]) >= need}
    assert found == want and tested[0] == n * (n - 1) // 2 and tested[1] < 0.6 * tested[0]


def test_jaccard_join_of_a_large_group_and_of_nothing(spark, empty):
    base = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join(base[: k % 60] + [f"x{k}"] + base[k % 60 + 1 :])) for k in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.doc_a, r.doc_b): r.jaccard for r in near.jaccard_join(df).collect()} == brute.similar_pairs(rows, 0.6)
    assert near.jaccard_join(empty).count() == 0 and near.linked(empty).count() == 0
    assert {(r.doc_id, r.class_id): r.n_links for r in near.linked(df).collect()} == brute.links(rows, 0.6)


def test_jaccard_join_of_sets_of_unlike_sizes(spark):
    """A text and the same with up to two thirds more, of frequent and of rare words on either side."""
    rows = []
    for k in range(60):
        own = [f"t{k}x{i}" for i in range(30)]
        more = [f"common{(k * 7 + i) % 40}" if k % 2 else f"rare{k}x{i}" for i in range(k % 21)]
        rows += [(2 * k, " ".join(own)), (2 * k + 1, " ".join(more[: len(more) // 2] + own + more[len(more) // 2 :]))]
        rows += [(1000 + 40 * k + i, f"common{(k * 7 + i) % 40} common{(k * 7 + i + 1) % 40} filler{k}") for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute.similar_pairs(rows, 0.6)
    assert len(want) > 50 and {(r.doc_a, r.doc_b): r.jaccard for r in near.jaccard_join(df).collect()} == want


def test_one_of_each_near_group_stays(docs, corpus, empty):
    gone = brute.not_least([r[:2] for r in corpus], 0.6)
    kept = near.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r.n for r in kept.collect()) == [k for k, (d, _, _) in enumerate(corpus) if d not in gone]
    assert near.drop_near_duplicates(empty).count() == 0


def test_each_text_of_a_doc_id_is_joined(spark):
    """Doc 7 has two texts, each with a near copy of its own; doc 10 has one text and one of no word."""
    a, b, c, d = ([f"{x}{k}" for k in range(30)] for x in "abcd")
    near_of = lambda words: " ".join([*words[:-1], "changed"])
    rows = [(7, " ".join(a)), (7, " ".join(b)), (8, near_of(a)), (9, near_of(b)), (10, " ".join(c)), (10, " .,"), (11, near_of(c)), (12, " ".join(a)), (13, " ".join(d)), (14, " ".join(d)), (14, near_of(b))]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "doc_id long, text string").coalesce(1)
        want = brute.similar_pairs(rows, 0.6)
        assert {(r.doc_a, r.doc_b): r.jaccard for r in near.jaccard_join(df).collect()} == want and {(7, 8), (7, 9), (10, 11), (7, 14)} <= set(want)
        assert {(r.doc_id, r.class_id): r.n_links for r in near.linked(df).collect()} == brute.links(rows, 0.6)
        gone = brute.not_least(rows, 0.6)
        assert sorted(near.drop_near_duplicates(df).select("doc_id", "text").collect()) == sorted(r for r in rows if r[0] not in gone) and gone == {8, 9, 11, 12, 14}


def test_overlaps_follow_from_chains():
    r = np.random.default_rng(6)
    base = r.integers(0, 1000, 80)
    sets = {k: np.unique(np.concatenate([base[r.random(80) < 0.9], r.integers(0, 1000, 5)])).astype(np.uint64) for k in range(30)}
    pairs = [(a, b) for a in sets for b in sets if a < b]
    assert near.overlaps(sets, pairs) == [len(np.intersect1d(sets[a], sets[b])) for a, b in pairs]


def test_quality_classifier_on_held_out_documents(spark, docs, empty):
    r = np.random.default_rng(8)
    good, bad = [f"good{k}" for k in range(80)], ["BUY", "click", "!!!", "$$$", "now", "free"]
    rows = []
    for k in range(900):
        y = int(r.integers(0, 2))
        rows.append((k, " ".join(r.choice(good if y else bad, r.integers(20, 80))), y))
    df = spark.createDataFrame([(k, x, 1.0) for k, x, _ in rows] + [(9000, None, 1.0), (9001, "", 1.0), (None, "good1 good2", 1.0)], "doc_id long, text string, p_good double")
    labels = spark.createDataFrame([(k, y, 0) for k, _, y in rows if k < 500] + [(None, 1, 0), (4, None, 0), (77777, 1, 1)], "doc_id long, quality int, toxic int")
    model = quality_model.fit(df.select("doc_id", "text"), labels)
    assert (np.diff(model.thresholds) > 0).all()
    kept = {x.doc_id for x in quality_model.selected(df, model).collect()}
    held = [(k, y) for k, _, y in rows if k >= 500]
    assert sum((k in kept) == bool(y) for k, y in held) / len(held) > 0.97
    scored = quality_model.score(df, model).collect()
    assert len(scored) == df.count() and all(0 <= x["__rating"]["p_good"] <= 1 and 0 <= x["__rating"]["expected_grade"] <= 2 for x in scored)
    assert quality_model.selected(empty, model).count() == 0
    none = quality_model.fit(df.select("doc_id", "text"), labels.where("quality = 9"))
    assert none is None and quality_model.selected(df, none).count() == df.count()
