import hashlib
import math
import random

import pytest

from evidentia.llm import vector_codes as V
from evidentia.llm.vector_codes import vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, id string, error long"


def brute(rows, entries=256, rounds=4):
    """Lloyd over all parts anew in each round, in Python's whole numbers."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    if not kept:
        return []
    width = -(-len(kept[0][1]) // 4)
    whole = [[math.floor(1024 * x) for x in r[1]] for r in kept]
    parts = [[tuple(v[p * width : (p + 1) * width]) for v in whole] for p in range(4)]
    books = [list(p[:entries]) for p in parts]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    assign = lambda: [[min(range(len(c)), key=lambda e: (far(v, c[e]), e)) for v in p] for p, c in zip(parts, books)]
    for _ in range(rounds):
        for p, codes in enumerate(assign()):
            for e in range(len(books[p])):
                own = [parts[p][i] for i, c in enumerate(codes) if c == e]
                if own:
                    books[p][e] = tuple(sum(column) // len(own) for column in zip(*own))
    codes = assign()
    error = [sum(far(parts[p][i], books[p][codes[p][i]]) for p in range(4)) for i in range(len(kept))]
    by_label = {}
    for r, e in zip(kept, error):
        by_label[r[2]] = by_label.get(r[2], 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(r[0], "".join(f"{codes[p][i]:02x}" for p in range(4)), error[i], by_label[r[2]], digest) for i, r in enumerate(kept)]


def check(spark, rows, **also):
    rows = [(i, [None if x is None else float(__import__("numpy").float32(x)) for x in v] if v is not None else None, l) for i, v, l in rows]
    df = spark.createDataFrame([(*r, "c", "i", 7) for r in rows], SCHEMA).repartition(3)
    got = sorted(map(repr, map(tuple, vector_codes(df).collect())))
    assert got == sorted(map(repr, brute(rows, **also)))
    return got


def vectors(n, length, seed, spread=1.0):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, spread) for _ in range(length)] for _ in range(9)]
    out = []
    for i in rng.sample(range(10 * n), n):
        c = rng.choice(centres)
        out.append((i, [x + rng.gauss(0, spread / 8) for x in c], rng.choice([None, 1, 2, -3])))
    return out


def test_vector_codes_are_their_brute_force(spark):
    bad = [(None, [0.0] * 8, 1), (3, None, 1), (4, [None] + [1.0] * 7, 1), (5, [float("nan")] * 8, 1), (6, [float("inf")] * 8, None), (-8, [-float("inf")] * 8, None)]
    rows = vectors(400, 8, 1) + bad
    check(spark, rows + rows[:30])


def test_few_vectors_ties_and_odd_lengths(spark):
    check(spark, [(2, [1.0, 1.0, 0.0, 0.0, 5.0, 5.0], 1), (1, [1.0, 1.0, 0.0, 0.0, 5.0, 5.0], None), (1, [1.0, 1.0, 0.0, 0.0, 5.0, 4.0], None), (7, [1.0], 1), (8, [], 1)])
    check(spark, [(i, [float(i % 3)] * 4, None) for i in range(300)])
    check(spark, [(1, [], 1), (2, [], 1)])
    assert vector_codes(spark.createDataFrame([], SCHEMA)).collect() == []
    assert vector_codes(spark.createDataFrame([(1, None, 1, "", "", 1)], SCHEMA)).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_large_components_are_exact_or_refused(spark):
    check(spark, vectors(60, 8, 4, 90_000.0))
    with pytest.raises(ValueError, match="too large"):
        vector_codes(spark.createDataFrame([(1, [1e30] * 4, 1, "", "", 1)], SCHEMA))


def test_few_entries_move_and_only_changes_are_shuffled(spark, monkeypatch):
    monkeypatch.setattr(V, "ENTRIES", 5)
    rows, sent = vectors(300, 8, 9), []
    move = V.Codebooks.move
    monkeypatch.setattr(V.Codebooks, "move", lambda self, deltas: (sent.append(len(deltas)), move(self, deltas))[1])
    check(spark, rows, entries=5)
    assert len(sent) == 4 and sent[-1] < sent[0] <= 4 * 5 * 3


def test_the_changes_of_a_round_hold_moved_rows_only():
    import numpy as np
    import pyarrow as pa

    book = V.Codebooks(np.arange(16).reshape(2, 8), 16)
    vec = V._blobs(np.arange(24).reshape(3, 8).astype("<i4"))
    new, old = V._blobs(np.array([[0, 1, 0, 0], [1, 1, 1, 1], [0, 0, 0, 1]], np.uint8)), pa.array([bytes([0, 0, 0, 0]), bytes([1, 1, 1, 1]), None], pa.binary())
    sent = type("Sent", (), {"value": book})
    (out,) = V._changes(sent)([pa.RecordBatch.from_arrays([vec, new, old], ["vec", "code", "was"])])
    counts = {(r["part"], r["entry"]): r["change"] for r in out.to_pylist() if r["position"] == -1}
    assert counts == {(0, 0): 1, (1, 1): 1, (2, 0): 1, (3, 1): 1}  # part 1 of the first row moves 0 -> 1, of the third row 0 is added
    assert [r for r in out.to_pylist() if r["part"] == 1 and r["position"] >= 0 and r["entry"] == 1] == [{"part": 1, "entry": 1, "position": 0, "change": 2}, {"part": 1, "entry": 1, "position": 1, "change": 3}]
