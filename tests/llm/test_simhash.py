import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from evidentia.llm import simhash as S
from evidentia.llm.xxh64 import xxh64_spans

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, id string, fp string, x string, label string"


def brute_fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """prints: (id, fingerprint) of each row; the smallest id that each row reaches, None only where there is no other."""
    label = list(range(len(prints)))
    for i, (_, f) in enumerate(prints):
        for j, (_, g) in enumerate(prints[:i]):
            if (f ^ g).bit_count() <= S.RADIUS and label[i] != label[j]:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    least = {}
    for (i, _), x in zip(prints, label):
        least[x] = min((y for y in (least.get(x), i) if y is not None), default=None)
    return [least[x] for x in label]


def check(spark, rows):
    got = S.simhash_components(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    prints = [(r[0], brute_fingerprint(r[1])) for r in rows]
    want = [(i, f"{f:016x}", c, sum(g == f for _, g in prints)) for (i, f), c in zip(prints, brute_components(prints))]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    return got


def documents(seed=5):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéß漢") for _ in range(rng.randint(1, 9))) for _ in range(300)]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    texts = [None, "", " \n\t", "one", "One", "a b c", "A  B\tC", "a b c d", "x " * 50, "w" * 3000 + " " + "v" * 700 + " u t s"]
    base = say(400)
    for _ in range(60):  # near copies: many are within the radius, some reach each other by others only
        own = list(base)
        for _ in range(rng.randint(0, 8)):
            own[rng.randrange(len(own))] = rng.choice(vocabulary)
        texts.append(" ".join(own))
    texts += [" ".join(say(rng.randint(1, 60))) for _ in range(60)] + [texts[20]] * 9 + [texts[20].upper()]
    return [(i, t, "a", "b", "c", "d") for i, t in zip(rng.sample(range(1000), len(texts)), texts)]


def test_simhash_is_its_brute_force(spark):
    got = check(spark, documents())
    assert any(r.component_id != r.doc_id and r.copies == 1 for r in got)  # near copies, not only copies


def test_simhash_of_null_and_repeated_ids(spark):
    rows = [(None, "q w e r t"), (None, "q w e r t"), (4, "Q w e r t"), (4, "other words are here"), (4, "other words are here"), (None, "alone in the world of"), (9, None)]
    check(spark, [(*r, "a", "b", "c", "d") for r in rows])
    assert S.simhash_components(spark.createDataFrame([], SCHEMA)).collect() == []


def test_simhash_with_many_tiles_and_keys(spark, monkeypatch):
    """Cells of several tiles and folded keys give the same components."""
    for name, value in (("TILE", 4), ("MET", 5), ("TASK_PAIRS", 500)):
        monkeypatch.setattr(S, name, value)
    check(spark, documents(8))


@pytest.mark.parametrize("block", [1, 40, 1 << 18])
def test_pairs_of_tiles_are_compared_whole(block, monkeypatch):
    """Split runs, small blocks and stars joined on the way find what all pairs find."""
    monkeypatch.setattr(S, "BLOCK", block)
    rng = random.Random(block)
    centre = rng.getrandbits(64)
    some = lambda n: np.unique(np.array([centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 9))) for _ in range(n)], np.uint64))
    left, right = some(150), some(120)
    right = right[~np.isin(right, left)]
    for a, b in ((left, None), (left, right)):
        batch = pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()), pa.array([None if b is None else b.tobytes()], pa.binary())], ["a", "b"])
        edges = [(e["u"], e["v"]) for out in S._links([batch]) for e in out.to_pylist()]
        nodes = (a if b is None else np.r_[a, b]).tolist()
        pairs = [(x, y) for x in a.tolist() for y in (a if b is None else b).tolist() if x != y and (x ^ y).bit_count() <= 4]
        at = {int(np.uint64(p).astype(np.int64)): i for i, p in enumerate(nodes)}
        plain = {p: i for i, p in enumerate(nodes)}
        got = S.stars(len(nodes), np.array([at[u] for u, _ in edges], int), np.array([at[v] for _, v in edges], int))
        want = S.stars(len(nodes), np.array([plain[u] for u, _ in pairs], int), np.array([plain[v] for _, v in pairs], int))
        assert got.tolist() == want.tolist() and len(edges) < len(nodes)


def test_long_texts_are_hashed_in_parts(monkeypatch):
    monkeypatch.setattr(S, "COUNTED", 50)
    texts = [r[1] for r in documents(3)]
    assert S.fingerprints([None if t is None else t.encode() for t in texts]).tolist() == [brute_fingerprint(t) for t in texts]


def test_no_pair_within_the_radius_is_lost(spark):
    """Fingerprints around a few centres at 0 to 6 bits: the stars connect what all links connect, with fewer edges."""
    rng = random.Random(2)
    prints = {0, 2**64 - 1}
    for _ in range(12):
        centre = rng.getrandbits(64)
        prints |= {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6))) for _ in range(40)}
    prints = sorted(prints)
    signed = [(int(np.uint64(p).astype(np.int64)),) for p in prints]
    edges = [(int(np.int64(r.u).astype(np.uint64)), int(np.int64(r.v).astype(np.uint64))) for r in S.links(spark.createDataFrame(signed, "fp long")).collect()]
    at = {p: i for i, p in enumerate(prints)}
    label = S.stars(len(prints), np.array([at[u] for u, _ in edges]), np.array([at[v] for _, v in edges]))
    assert [prints[i] for i in label] == brute_components([(p, p) for p in prints])
    pairs = sum((p ^ q).bit_count() <= 4 for i, p in enumerate(prints) for q in prints[:i])
    assert len(edges) < pairs


@pytest.mark.parametrize("few", [1, 16, 10**6])
def test_xxh64_of_spans(few, monkeypatch):
    monkeypatch.setattr("evidentia.llm.xxh64.FEW", few)
    rng = random.Random(few)
    data = rng.randbytes(5000)
    start = np.array([rng.randrange(4000) for _ in range(3000)])
    length = np.array([rng.choice([0, 1, 3, 4, 7, 8, 9, 12, 31, 32, 33, 63, 64, 71, 600]) for _ in start])
    want = [xxhash.xxh64_intdigest(data[i : i + n], 42) for i, n in zip(start.tolist(), length.tolist())]
    assert xxh64_spans(data, start, start + length, 42).tolist() == want
