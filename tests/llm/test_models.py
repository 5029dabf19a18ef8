import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from evidentia.llm import license_scan, ordinal_quality, piece_sampling, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def some_texts(seed=1, n=150):
    rng = random.Random(seed)
    words = ["a", "the", "é#", "x|y", "foo", "bar", "baz%", "qux"]
    out = ["", None, "\n\n", "a b c d e f g h i", "a b c d e f g h i j", "same\nsame\n same\n", "r " * 40, " ".join(rng.choice(words) for _ in range(8000))]
    return out + ["".join(rng.choice(words) + rng.choice([" ", " ", "\n", "  ", "\t"]) for _ in range(rng.randint(1, 120))) for _ in range(n)]


def brute_statistics(t):
    t = t or ""
    w = WORD.findall(t)
    where = {}
    for k in range(len(w) - 4):
        where.setdefault(tuple(w[k : k + 5]), []).append(k)
    covered = {p for v in where.values() if len(v) > 1 for k in v for p in range(k, k + 5)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w))


def test_statistics(spark):
    texts = some_texts()
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)] + [(None, "x", "y")], "doc_id long, text string, kept string")
    got = {r.doc_id: r for r in quality_rules.quality_rules(df, None).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_statistics(t)
        assert r.kept == (not r.base_failed)
    assert quality_rules.drop_rejected(df, None).count() == sum(r.kept for r in got.values())
    assert quality_rules.quality_rules(df.limit(0), None).count() == 0


def test_trees_keep_their_constraints_and_score_like_a_walk():
    rng = np.random.default_rng(0)
    x = rng.random((3000, len(quality_rules.FEATURES)))
    names = list(quality_rules.FEATURES)
    good = x[:, names.index("symbols")] + 0.5 * x[:, names.index("digits")] + 0.1 * rng.standard_normal(3000) < 0.8
    trees = quality_rules.fit(x[:2000], good[:2000])
    assert ((trees.score(x[2000:]) > 0) == good[2000:]).mean() > 0.9
    for name, sense in quality_rules.FEATURES.items():
        if sense:
            up = x[:300].copy()
            low = trees.score(up)
            up[:, names.index(name)] += 0.3
            assert (sense * (trees.score(up) - low) >= -1e-9).all()
    row, total = x[0], trees.base
    for f, t, leaf in zip(trees.feature, trees.threshold, trees.leaf):
        at = 0
        while at < len(f):
            at = 2 * at + 1 + int(row[f[at]] > t[at])
        total += leaf[at - len(f)]
    assert abs(total - trees.score(x[:1])[0]) < 1e-9
    assert quality_rules.fit(x[:10], np.ones(10, bool)) is None


def labelled(spark, n=900):
    rng = random.Random(7)
    words = ["".join(rng.choice("aeiourstn") for _ in range(rng.randint(2, 7))) for _ in range(500)]
    rows, labels = [], []
    for i in range(n):
        own = [rng.choice(words) for _ in range(rng.randint(30, 120))]
        kind = i % 3
        if kind == 0:
            own = [w.upper() + "!!" for w in own]
        elif kind == 1:
            for _ in range(3):
                own[rng.randrange(len(own))] = rng.choice(["nasty", "vile", "nastyish"])
        rows.append((i, " ".join(own)))
        labels.append((i, int(kind != 0), int(kind == 1)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")


def test_ordinal_quality_on_held_out_documents(spark):
    docs, labels = labelled(spark)
    model = ordinal_quality.train(docs, labels.filter("doc_id < 600"))
    assert (np.diff(model.thresholds) > 0).all()
    got = ordinal_quality.ordinal_quality(docs.filter("doc_id >= 600"), model).collect()
    right = sum(r.kept == (r.doc_id % 3 == 2) for r in got)
    assert right / len(got) > 0.93
    assert all(abs(r.expected_grade) <= 2 and 0 <= r.p_top <= 1 and r.p_top <= r.expected_grade for r in got)
    assert ordinal_quality.train(docs, labels.limit(0)) is None
    empty = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert ordinal_quality.ordinal_quality(empty, model).count() == 2 and ordinal_quality.ordinal_quality(empty, None).filter("kept").count() == 2


def naive_features(text):
    """Features of one text, each found by itself."""
    from evidentia.llm.words import Words, mix

    bits = 2**ordinal_quality.FEATURE_BITS
    words = WORD.findall((text or "").encode().translate(ordinal_quality._BARE).decode("utf-8", "replace"))
    low = [re.sub("[A-Z]", lambda m: m[0].lower(), w).encode() for w in words]
    one = lambda w: int(Words([w]).hashes()[0])
    found = {one(w) % bits for w in low}
    for k in ordinal_quality.PREFIXES:
        found |= {int(mix(np.array([one(w[:k])], np.uint64))[0]) % bits for w in low if len(w) > k}
    windows = [tuple(low[i : i + 5]) for i in range(len(low) - 4)]
    for degree, least in enumerate(ordinal_quality.SHARES):
        if len(windows) - len(set(windows)) > least * max(len(windows), 1):
            found.add(int(mix(np.array([degree + 1], np.uint64))[0]) % bits)
    kind = lambda c: "A" if "A" <= c <= "Z" else "9" if "0" <= c <= "9" else "a" if "a" <= c <= "z" or ord(c) >= 128 else c
    shapes = [re.sub(r"(.)\1+", r"\1", "".join(map(kind, w))) for w in WORD.findall(text or "")]
    times = Counter(shapes)
    for shape, n in times.items():
        for degree, least in enumerate(ordinal_quality.SHARES):
            if n / len(shapes) > least:
                found.add(int(mix(np.array([one(shape.encode()) >> 24 | (degree + 1) << 48], np.uint64))[0]) % bits)
    return found


def test_ordinal_scores_are_those_of_a_naive_scorer(spark):
    docs, labels = labelled(spark)
    model = ordinal_quality.train(docs, labels)
    some = [None, "", "A word, and ANOTHER!! one", "x " * 50_000, "same same same same same same same same", "Größe 12:30 état", "a b c d e a b c d e f"]
    rows = [(i, t, "clash", 1) for i, t in enumerate(some)] + [(None, some[2], "clash", 1), (2, some[2], "clash", 1), (2, "other", "clash", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string, p_top int")
    got = [(r.doc_id, r.expected_grade, r.p_top, r.kept) for r in ordinal_quality.ordinal_quality(df, model).collect()]
    assert len(got) == len(rows)
    for (i, text, *_), (j, expected, top, kept) in zip(rows, got):
        score = sum(float(model.weights[f]) for f in naive_features(text))
        tails = 1 / (1 + np.exp(-(score - model.thresholds)))
        assert i == j and abs(expected - tails.sum()) < 1e-5 and abs(top - tails[-1]) < 1e-5 and kept == (top >= 0.5)


def test_queries_of_scores_on_the_tables(spark):
    from evidentia.llm import queries

    folder = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    for r in queries.op6_quality_rules(spark, folder).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_statistics(docs[r.doc_id]) and not (r.kept and r.base_failed)
    graded = queries.op4_ordinal_quality(spark, folder).collect()
    assert {r.doc_id for r in graded} == set(docs) and all(r.kept == (r.p_top >= 0.5) for r in graded)
    scanned = queries.op7_license_scan(spark, folder).collect()
    assert {r.doc_id for r in scanned} == set(docs) and all(r.n_findings == len(r.findings) and all(f.text in docs[r.doc_id] for f in r.findings) for r in scanned)


def test_models_meet_repeated_rows_and_null_ids(spark):
    rows = [(1, "a b c d e f g h i j k"), (1, "a b c d e f g h i j k"), (None, "x"), (None, None)]
    df = spark.createDataFrame([(*r, 0, 0) for r in rows], "doc_id long, text string, kept int, rank int")
    got = quality_rules.quality_rules(df, None).collect()
    assert [(r.doc_id, r.n_words, r.kept) for r in got] == [(1, 11, True), (1, 11, True), (None, 1, False), (None, 0, False)]
    sampled = piece_sampling.sample_segmentations(df, public_tokenizers.path("piece_bpe_32k.model")).collect()
    by = Counter(r.doc_id for r in sampled)
    assert by[1] >= 2 and by[None] >= 1


def test_quality_training_is_bounded_and_separates(spark):
    docs, labels = labelled(spark)
    model = quality_rules.train(docs, labels.filter("doc_id < 600"), rows=400)
    got = {r.doc_id: r.kept for r in quality_rules.quality_rules(docs.filter("doc_id >= 600"), model).collect()}
    assert sum(k == (i % 3 != 0) for i, k in got.items()) / len(got) > 0.95


def test_license_scan(spark):
    rows = [
        (1, "Intro line\nReleased under the MIT License.\nmore"), (2, "Licensed under the Apache License, Version 2.0."), (3, "This work is licensed under the GNU General Public License, version 3."),
        (4, "Licensed under CC BY-NC 4.0."), (5, "He has a driving license and met the general public."), (6, None), (7, ""), (8, "nothing here " * 5000),
        (9, "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:"),
    ]
    got = {r.doc_id: r for r in license_scan.scan_licenses(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, families string")).collect()}
    assert {i: r.families for i, r in got.items()} == {1: ["MIT"], 2: ["Apache"], 3: ["GPL"], 4: ["CC BY-NC"], 5: [], 6: [], 7: [], 8: [], 9: ["BSD"]}
    f = got[1].findings[0]
    assert (f.first_line, f.last_line, f.confirmed) == (1, 1, True) and f.probability > 0.5
    assert (got[9].findings[0].first_line, got[9].findings[0].last_line) == (0, 1)


def test_license_scan_of_wrapped_grants_and_unknown_ones(spark):
    wrapped = "Some prose of a page.\nPermission is hereby granted, free of charge, to any\nperson obtaining a copy of this software and associated\ndocumentation files, to deal in the Software\nwithout restriction.\nThe end came soon."
    rows = [
        (1, wrapped), (1, wrapped), (None, "All rights reserved."), (2, "This code is under the Eclipse Public License 2.0."), (3, "MIT License"), (4, "Released under the MIT License.\nLicensed under CC BY-NC 4.0."),
        (5, "word " * 100_000 + "\nLicensed under the Apache License, Version 2.0."), (6, None),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.families, [(f.family, f.first_line, f.last_line, f.confirmed) for f in r.findings]) for r in license_scan.scan_licenses(df).collect()]
    assert got[0] == got[1] and got[0][1] == ["MIT"] and got[0][2][0][1] == 1 and got[0][2][0][2] in (3, 4)
    assert got[2][:2] == (None, ["Proprietary"]) and got[4][1] == ["MIT"] and got[5][1] == ["CC BY-NC", "MIT"] and got[6][1] == ["Apache"] and got[7][2] == []
    assert got[3][1] == [] and [f[0] for f in got[3][2]] == ["unknown"]
    assert license_scan.scan_licenses(df.limit(0)).count() == 0


def test_license_lines_of_the_documents_are_found(spark):
    lines = {
        "This work is licensed under the GNU General Public License, version 3.": "GPL", "All rights reserved.": "Proprietary", "Released under the MIT License.": "MIT",
        "Licensed under CC BY-NC 4.0.": "CC BY-NC", "Licensed under the Apache License, Version 2.0.": "Apache",
    }
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = {r.doc_id: sorted({f for x, f in lines.items() if x in r.text.split("\n")}) for r in docs.filter("text is not null").collect()}
    got = {r.doc_id: r.families for r in license_scan.scan_licenses(docs).collect()}
    holding = [i for i, w in want.items() if w]
    assert len(holding) > 20 and sum(set(want[i]) <= set(got[i]) for i in holding) >= 0.9 * len(holding)
    assert sum(bool(got[i]) for i, w in want.items() if not w) <= 0.001 * len(want) + 1


def test_license_classifier_on_wording_outside_the_templates():
    model = license_scan.trained()
    other = [
        ("This project is distributed under the MIT license.", "MIT"), ("Source code released under the Apache License 2.0", "Apache"), ("It is free software under the GNU General Public License version 3 or later.", "GPL"),
        ("Published under the Mozilla Public License 2.0.", "MPL"), ("The text is licensed under CC BY-SA 4.0 International.", "CC BY-SA"), ("Our images are licensed under CC BY-NC 4.0", "CC BY-NC"),
        ("Licensed under the BSD 3-Clause License by the authors", "BSD"), ("Distributed under the terms of the GNU Affero General Public License, version 3", "AGPL"), ("(c) 2020 The Press. All rights reserved.", "Proprietary"),
        ("This work is released into the public domain.", "Public domain"), ("Distributed under the ISC License.", "ISC"), ("Licensed under the GNU Lesser General Public License v2.1", "LGPL"),
    ]
    family, _, _ = model.judge([license_scan.clean(x.encode()) for x, _ in other])
    assert sum(model.families[f] == want for f, (_, want) in zip(family, other) if f >= 0) >= 0.8 * len(other)
    plain = [license_scan.clean(x.encode()) for x in ("She lost her license in the park.", "The public library is open to the general public.", "Commons and lords met in 1642.", "Version 4.0 of the plan was printed.")]
    assert not [f for f in model.judge(plain)[0] if 0 <= f < len(model.templates)]


def test_license_probabilities_are_those_of_a_naive_scorer():
    from evidentia.llm.words import Words, mix

    model = license_scan.trained()
    lines = [license_scan.clean(x) for x in (b"Released under the MIT License.", b"a driving license, and no more", b"", b"Licensed under CC BY-NC 4.0. - twice twice twice twice")]
    line, feature, _ = license_scan.grams(lines)
    got = model.probabilities(line, feature, len(lines))
    for i, x in enumerate(lines):
        words, found = x.lower().split(), set()
        for n in (1, 2, 3):
            for k in range(len(words) - n + 1):
                h = Words([b" ".join(words[k : k + n])]).windows(n)[1]
                found.add(int(mix(h + np.uint64(n))[0]) % 2**license_scan.FEATURE_BITS)
        score = model.bias + sum((model.weights[f] for f in found), np.zeros(len(model.families)))
        e = np.exp(score / model.temperature)
        assert np.allclose(got[i], e / e.sum(), atol=1e-6)


def all_segmentations(lat, text):
    weight = {lat.sp.id_to_piece(int(i)): w for i, w in zip(lat.ids, lat.weights)}
    out = {}

    def go(i, path, w):
        if i == len(text):
            out[tuple(path)] = w
        for j in range(i + 1, len(text) + 1):
            if text[i:j] in weight:
                go(j, [*path, text[i:j]], w + weight[text[i:j]])

    go(0, [], 0.0)
    return out


def test_piece_sampling_without_replacement():
    lat = piece_sampling.Lattices(public_tokenizers.path("piece_bpe_32k.model"))
    words = [all_segmentations(lat, "▁the"), all_segmentations(lat, "▁cat")]
    p = {a + b: words[0][a] + words[1][b] for a in words[0] for b in words[1]}
    z = np.logaddexp.reduce(list(p.values()))
    p = {k: float(np.exp(v - z)) for k, v in p.items()}
    n = 8000
    first, pairs = Counter(), Counter()
    for _, found in piece_sampling.sample(lat, np.arange(n), [b"the cat"] * n, 3):
        named = [tuple(lat.sp.id_to_piece(int(i)) for i in lat.spell(e)) for e, *_ in found]
        assert len(set(named)) == 3
        assert all(abs(np.exp(f[1]) - p[s]) < 1e-5 for f, s in zip(found, named))
        assert found[0][2] > found[1][2] > found[2][2] > found[0][3]
        first[named[0]] += 1
        pairs[named[0], named[1]] += 1
    for s in p:
        assert abs(first[s] / n - p[s]) < 0.025
    a, b = sorted(p, key=p.get)[-2:]
    assert abs(pairs[a, b] / n - p[a] * p[b] / (1 - p[a])) < 0.025


def test_piece_sampling_gives_all_of_few_and_round_trips(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    texts = ["a", "", None, "two  spaces\n\nand\tmore ", " lead", "日本 😀 ́x", "\r\nq;\r\n", "word " * 5000]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, rank int")
    out = piece_sampling.sample_segmentations(df, path, k=4)
    rows = piece_sampling.decode(out, path).collect()
    for r in rows:
        assert r.text == (texts[r.doc_id] or "") and r.log_prob <= 1e-5 and r.log_inclusion <= 0
    lat = piece_sampling.Lattices(path)
    count = Counter(r.doc_id for r in rows)
    assert count[0] == min(4, len(all_segmentations(lat, "▁a"))) and count[1] == count[2] == 1 and count[7] == 4
    assert len({(r.doc_id, bytes(r.ids)) for r in rows}) == len(rows)
    again = {(r.doc_id, r.rank): bytes(r.ids) for r in piece_sampling.sample_segmentations(df.repartition(3), path, k=4).collect()}
    assert again == {(r.doc_id, r.rank): bytes(r.ids) for r in rows}
    assert piece_sampling.sample_segmentations(df.limit(0), path).count() == 0


def test_training_takes_one_row_of_a_repeated_id(spark, monkeypatch):
    n, fit_trees, fit_grades = [], quality_rules.fit, ordinal_quality.fit
    monkeypatch.setattr(quality_rules, "fit", lambda x, good: n.append(len(good)) or fit_trees(x, good))
    monkeypatch.setattr(ordinal_quality, "fit", lambda doc, f, grade: n.append(len(grade)) or fit_grades(doc, f, grade))
    docs = spark.createDataFrame([(i if i < 20 else 7, f"text number {i} of many") for i in range(60)], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    quality_rules.train(docs, labels)
    ordinal_quality.train(docs, labels)
    quality_rules.train(docs, labels, rows=5)
    assert n == [20, 20, 5]
