import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from evidentia.llm import huffman, packing, tokens

STRANGE = "ab'st dE \n\n  \t\r,.!12é ß́  ​—…İΣ日本　😀\x00\x1f|#<|endoftext|>"


def texts(n=300, seed=2):
    rng = random.Random(seed)
    plain = [" ".join("".join(rng.choice("aeiorst") for _ in range(rng.randint(1, 7))) for _ in range(rng.randint(0, 200))) for _ in range(n // 2)]
    return plain + ["".join(rng.choice(STRANGE) for _ in range(rng.randint(0, 50))) for _ in range(n // 2)] + ["", " ", "a\nb", "a\n\nb", "word " * 9000]


@pytest.mark.parametrize("as_text", [False, True])
@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_is_the_tokenizer(name, as_text):
    path = public_tokenizers.path(name)
    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = as_text
    enc = tokens.Encoder(path, as_text)
    control = [x.content for x in plain.get_added_tokens_decoder().values()]
    some = texts() + [f"a {x} b{x}c {x.upper()}{x} d" for x in control] + control
    for _ in range(2):
        got = [np.frombuffer(x, enc.kind).tolist() for x in enc.encode([t.encode() for t in some])]
        assert got == [e.ids for e in plain.encode_batch(some, add_special_tokens=False)]
    assert enc.encode([None]) == [b""]


def test_huffman_lengths_are_bounded_and_decode():
    rng = np.random.default_rng(0)
    for counts in (np.array([0, 5, 0]), np.array([1, 1]), 2 ** np.arange(30), rng.zipf(1.3, 5000), np.r_[np.zeros(9, int), 1]):
        lengths = huffman.code_lengths(np.asarray(counts, np.int64))
        used = np.flatnonzero(counts)
        assert lengths.max() <= huffman.LIMIT and (lengths > 0).sum() == len(used)
        assert (2.0 ** -lengths[used].astype(float)).sum() <= 1
        ids = rng.choice(used, 70_000)
        bits, offsets = huffman.pack(ids, lengths, huffman.codes(lengths))
        assert (huffman.unpack(bits, offsets, len(ids), huffman.decode_table(lengths)) == ids).all()
    assert huffman.unpack(*huffman.pack(np.zeros(0, int), lengths, huffman.codes(lengths)), 0, huffman.decode_table(lengths)).size == 0


def test_huffman_lengths_are_optimal():
    import heapq

    rng = np.random.default_rng(1)
    for _ in range(20):
        counts = rng.integers(1, 1000, 60)
        heap, cost = counts.tolist(), 0
        heapq.heapify(heap)
        while len(heap) > 1:
            s = heapq.heappop(heap) + heapq.heappop(heap)
            cost += s
            heapq.heappush(heap, s)
        assert (huffman.code_lengths(counts) * counts).sum() == cost


def table(spark, some):
    rng = random.Random(4)
    ids = rng.sample(range(100_000), len(some))
    return list(zip(ids, some)), spark.createDataFrame([(i, t, 1, 2) for i, t in zip(ids, some)] + [(None, None, 0, 0)], "doc_id long, text string, start int, ids int")


def test_token_files_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(huffman, "BLOCK_BYTES", 3000)
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows, df = table(spark, texts(120) + ["ends<|endoftext|> and goes on", "<|endoftext|>"])
    folder = f"file://{tmp_path}/ids"
    huffman.write_token_ids(df, folder, path, 0)
    got = {r.doc_id: r for r in huffman.read_token_ids(spark, folder).collect()}
    plain = Tokenizer.from_file(path)
    assert got[None].start == 0 and got[None].n_tokens == 1
    before = 1
    for i, t in sorted(rows):
        ids = np.array(plain.encode(t, add_special_tokens=False).ids + [0], "<u4").tobytes()
        assert (got[i].start, got[i].n_tokens, bytes(got[i].ids)) == (before, len(ids) // 4, ids)
        before += len(ids) // 4
    huffman.write_token_ids(df.limit(0), folder, path, 0)
    assert huffman.read_token_ids(spark, folder).count() == 0


def check_pieces(rows, got, plain, end):
    want = {i: plain.encode(t, add_special_tokens=False).ids + [end] for i, t in rows}
    by, sequences = {}, {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
        assert r.length > 0 and len(r.ids) == 4 * r.length
    for i, ids in want.items():
        own = sorted(by[i], key=lambda r: r.start)
        assert [x for r in own for x in np.frombuffer(r.ids, "<u4").tolist()] == ids
        assert [r.start for r in own] == np.cumsum([0] + [r.length for r in own])[:-1].tolist() and own[0].doc_tokens == len(ids)
    for own in sequences.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == np.cumsum([0] + [r.length for r in own])[:-1].tolist()
        assert sum(r.length for r in own) <= packing.WINDOW
    total = sum(map(len, want.values()))
    assert len(sequences) == -(-total // packing.WINDOW)


@pytest.mark.parametrize("kind", ["mixed", "short", "one length", "empty texts"])
def test_packing(spark, monkeypatch, kind):
    monkeypatch.setattr(packing, "BLOCK_BYTES", 5000)
    path = public_tokenizers.path("word_bpe_49k.json")
    some = {"mixed": texts(400) + ["a b c " * 3000], "short": ["a b"] * 700 + ["c d e"] * 300, "one length": ["x " * 1364] * 9, "empty texts": [""] * 50}[kind]
    rows, df = table(spark, some)
    got = packing.pack(df.filter("doc_id is not null"), path, 2).collect()
    plain = Tokenizer.from_file(path)
    check_pieces(rows, got, plain, 2)


def test_packing_of_nulls_and_nothing(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    df = spark.createDataFrame([(None, None), (1, "a"), (1, "a")], "doc_id long, text string")
    got = packing.pack(df, path, 2).collect()
    assert sorted((r.doc_id or 0, r.length) for r in got) == [(0, 1), (1, 2), (1, 2)] and len({r.sequence_id for r in got}) == 1
    assert packing.pack(df.limit(0), path, 2).count() == 0


def test_nnls_meets_the_optimality_conditions():
    rng = np.random.default_rng(0)
    for _ in range(20):
        a, b = rng.random((12, 30)), rng.random(12)
        x = packing.nnls(a, b)
        slope = a.T @ (a @ x - b)
        assert (x >= 0).all() and (slope > -1e-6).all() and np.abs(slope[x > 1e-9]).max(initial=0) < 1e-6


def test_combinations_fill_the_window():
    table_ = packing.combinations(16, np.array([1, 3, 4, 5, 7, 16]))
    assert (table_ @ np.arange(17) == 16).all() and len(np.unique(table_, axis=0)) == len(table_)


def test_crc_of_ids_in_spark(spark):
    df = spark.createDataFrame([(bytearray(b"abc"),)], "ids binary").selectExpr("crc32(ids) c")
    assert df.first().c == zlib.crc32(b"abc")


def test_queries_of_ids_and_pieces_on_the_tables(spark):
    from evidentia.llm import queries

    folder = "/root/testdata/sf0.001"
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{folder}/documents.parquet").collect())
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    plain, before = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.op3_token_ids(spark, folder).collect()}
    for i, t in docs:
        ids = plain.encode(t, add_special_tokens=False).ids + [0]
        assert got[i] == (before, len(ids), crc(ids))
        before += len(ids)
    plain, pieces = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), {}
    out = queries.op5_packing(spark, folder).collect()
    for r in out:
        pieces.setdefault(r.doc_id, []).append(r)
    for i, t in docs:
        ids, at = plain.encode(t, add_special_tokens=False).ids + [2], 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), crc(ids[at : at + r.length]))
            at += r.length
        assert at == len(ids)
    spans = sorted((r.sequence_id, r.offset, r.length) for r in out)
    assert all((b[0], b[1]) == ((a[0], a[1] + a[2]) if a[0] == b[0] else (a[0] + 1, 0)) for a, b in zip(spans, spans[1:])) and max(o + n for _, o, n in spans) <= 4096
