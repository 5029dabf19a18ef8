import hashlib
import random
import re

import pytest

from evidentia.llm import jaccard_join as J
from evidentia.llm.exact_dedup import drop_copies, exact_dedup
from evidentia.llm.jaccard_join import jaccard_components
from evidentia.llm.substring_dedup import substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, kept string, n_words string, rest string"


def corpus(seed=3, near=40):
    """Documents with copies, near copies, shared passages, nulls, ties and clashing columns."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(400)]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage, base = say(60), say(120)
    texts = [None, "", " \n\t ", "one two", "One  two", "a b c d e", "A b c d e", "x " * 60, "word"]
    for _ in range(25):
        texts.append(" ".join(say(rng.randint(5, 150))))
    for _ in range(15):
        cut = rng.randint(0, 40)
        texts.append(" ".join(say(30)) + "\n" + " ".join(passage[:]) + "  " + " ".join(say(cut)))
    for _ in range(near):
        own = list(base)
        for _ in range(rng.randint(0, 6)):
            own[rng.randrange(len(own))] = rng.choice(vocabulary)
        texts.append(" ".join(own))
    texts += [texts[20]] * 12 + [texts[20].upper()] * 3 + [" ".join(say(9000))]
    ids = rng.sample(range(1, 10_000), len(texts))
    return [(i, t, "x", "y", "z") for i, t in zip(ids, texts)]


def test_exact_dedup(spark):
    rows = corpus()
    got = {r.doc_id: r for r in exact_dedup(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()}
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""), []).append(i)
    assert len(got) == len(rows)
    for text, ids in groups.items():
        for i in ids:
            r = got[i]
            assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (max(ids), len(ids), i == max(ids), hashlib.sha256(text.encode()).hexdigest())


def test_exact_dedup_of_repeated_rows_and_null_ids(spark):
    rows = [(1, "a"), (1, "a"), (None, "A"), (None, None), (None, ""), (2, "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = exact_dedup(df).collect()
    assert sum(r.kept for r in got if r.keep_id == 1) == 1 and all(r.group_size == 3 for r in got if r.keep_id == 1)
    assert sum(r.kept for r in got) == 3
    assert sorted((r.doc_id or 0, r.text or "") for r in drop_copies(df).collect())[1:] == [(1, "a"), (2, "b")]
    assert exact_dedup(df.limit(0)).count() == 0


def test_drop_copies_keeps_columns(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA)
    keep = {r.doc_id for r in exact_dedup(df).filter("kept").collect()}
    out = drop_copies(df)
    assert out.columns == df.columns and sorted(r.doc_id for r in out.collect()) == sorted(keep)


def brute_substring(rows, window=20):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: (r[0], r[1] or "")):
        words = WORD.findall(t or "")
        gone = set()
        for s in range(len(words) - window + 1):
            key = tuple(words[s : s + window])
            if key in seen:
                gone.update(range(s, s + window))
            seen.add(key)
        kept = [w for k, w in enumerate(words) if k not in gone]
        out[i] = (len(words), len(gone), " ".join(kept))
    return out


@pytest.mark.parametrize("ranges", [3, 4096])
def test_substring_dedup(spark, monkeypatch, ranges):
    monkeypatch.setattr("evidentia.llm.substring_dedup.MOST_RANGES", ranges)
    monkeypatch.setattr("evidentia.llm.substring_dedup.CHUNK_BYTES", 300)
    monkeypatch.setattr("evidentia.llm.substring_dedup.BUCKET_BYTES", 500)
    rows = corpus()
    want = brute_substring([r[:2] for r in rows])
    got = substring_dedup(spark.createDataFrame(rows, SCHEMA), carry=["kept", "n_words", "rest"]).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_words"], r["n_removed"], " ".join(WORD.findall(r["text"] or ""))) == want[r["id"]]
        assert sum(s.end - s.start for s in r["spans"]) == r["n_removed"] and r["rest"].kept == "x" and r["rest"].rest == "z"
        assert all(a.end < b.start for a, b in zip(r["spans"], r["spans"][1:]))
    unchanged = {i: t for i, t, *_ in rows}
    assert all(r["text"] == unchanged[r["id"]] for r in got if not r["n_removed"])


def test_windows_of_one_hash_are_told_apart():
    import numpy as np

    from evidentia.llm.substring_dedup import repeats

    h, more = np.array([5, 7, 5, 5, 7, 5, 9], np.uint64), np.array([1, 1, 2, 1, 1, 2, 3], np.uint32)
    assert repeats(h, more).tolist() == [False, False, False, True, True, True, False]


def test_repeated_texts_pass_in_shards(spark, monkeypatch):
    from evidentia.llm import bloom

    monkeypatch.setattr(bloom, "CAPACITY", 20)
    rows = corpus()
    want = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup(spark.createDataFrame(rows, SCHEMA)).collect()}
    monkeypatch.undo()
    assert want == {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_substring_dedup_inside_a_text_and_empty_table(spark):
    line = " ".join(f"w{i}" for i in range(25))
    df = spark.createDataFrame([(5, line + "\n" + line), (None, line)], "doc_id long, text string")
    got = {r["id"]: r for r in substring_dedup(df).collect()}
    assert got[None]["n_removed"] == 0 and got[5]["n_removed"] == 50
    assert substring_dedup(df.limit(0)).count() == 0


def shingles(t):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_components(rows):
    sets = {i: shingles(t) for i, t in rows}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = sorted((root(a), root(b)))
                up[q] = p
    return {i: (len(sets[i]), root(i)) for i in ids}


def check_components(spark, rows):
    want = brute_components([r[:2] for r in rows])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()}
    assert got == want
    return want


def test_jaccard_components(spark):
    want = check_components(spark, corpus())
    assert len({c for _, c in want.values()}) < len(want) - 20


@pytest.mark.parametrize("hot, centres", [(1 << 15, (1, 4, 16)), (8, (1, 8))])
def test_jaccard_long_blocks_in_rounds(spark, monkeypatch, hot, centres):
    # all lists are long, with shingles dealt by set or not, and blocks that take many rounds
    monkeypatch.setattr(J, "FEW_PARTNERS", 0)
    monkeypatch.setattr(J, "HOT_LIST", hot)
    monkeypatch.setattr(J, "HOT_TIMES", 0)
    monkeypatch.setattr(J, "CENTRES", centres)
    monkeypatch.setattr(J, "PAIRS_AT_ONCE", 5)
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(160)]
    lost = []
    for i in range(24):  # copies of a text that isn't there: some link with each other, some with none
        own = list(base)
        for _ in range(rng.randint(0, 4)):
            own[rng.randrange(len(own))] = f"n{rng.randrange(10**6)}"
        lost.append((20_000 + i, " ".join(own), "x", "y", "z"))
    check_components(spark, corpus(seed=8, near=20) + lost)


def test_jaccard_judges_rows_of_a_repeated_id_by_their_texts(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    df = spark.createDataFrame([(4, a), (4, b), (9, a), (2, b), (4, a)], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(df).collect()) == [(2, 36, 2), (4, 36, 2), (4, 36, 4), (4, 36, 4), (9, 36, 4)]


def postings(sets):
    """A bucket of postings of all shingles in the order of their counts, as the first pass sends them."""
    import collections

    import numpy as np
    import pyarrow as pa

    times = collections.Counter(x for s in sets for x in s)
    rows = []
    for cls, own in enumerate(sets):
        n = len(own)
        for at, x in enumerate(sorted(own, key=lambda x: (times[x], x))[: n - (3 * n + 3) // 4 + 1]):
            rows.append((x, cls, n, (7 * (n - at) - 3 * n) // 3))
    return pa.table({"bucket": [0], "postings": pa.array([np.array(rows, J.POSTING).tobytes()], pa.binary())})


@pytest.mark.parametrize("shared, size", [(5, 15), (80, 100)])
def test_templates_that_do_not_link_are_skipped(shared, size):
    import time

    took = []
    for n in (1000, 2000):
        table = postings([[*range(shared), *range(shared + (k // 2) * size, shared + (k // 2) * size + size - shared - 1), 10**7 + k] for k in range(n)])
        began = time.perf_counter()
        out = J._candidates(1)(table)
        took.append(time.perf_counter() - began)
        assert out.num_rows == n // 2 and out.column("b").null_count == 0  # the pairs that link, and no block
    assert took[1] < 4 * took[0] + 0.5


def test_posting_blocks_hold_all_possible_pairs():
    import numpy as np

    rng = np.random.default_rng(2)
    p = np.zeros(400, J.POSTING)
    p["token"], p["size"] = rng.integers(0, 6, 400), rng.integers(1, 90, 400)
    p["cap"] = p["size"] * rng.uniform(0.6, 4 / 3, 400)
    p["cls"] = np.arange(400)
    p = p[np.lexsort((p["size"], p["token"]))]
    _, block, after = J.blocks(p)
    for i in range(400):
        for j in range(i + 1, 400):
            if p["token"][i] == p["token"][j] and p["size"][i] <= p["cap"][j] and p["size"][j] <= p["cap"][i]:
                assert block[i] == block[j] and j - i <= after[i]


def test_jaccard_empty_and_null_ids(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (7, "A b c d e f"), (None, None), (3, "")], "doc_id long, text string")
    got = sorted(((r.doc_id or -1, r.n_shingles, r.component_id) for r in jaccard_components(df).collect()), key=str)
    assert got == sorted([(-1, 2, 7), (7, 2, 7), (-1, 0, None), (3, 0, 3)], key=str)
    assert jaccard_components(df.limit(0)).count() == 0


def test_components_of_a_chain(spark):
    from evidentia.llm.components import components

    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (5, 5)], "u long, v long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}
    assert components(edges.limit(0)).count() == 0
