import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from evidentia.llm import quality_rules
from tests.llm.test_dedup import brute_components, brute_substring, corpus
from tests.llm.test_models import brute_statistics
from tests.llm.test_tokens import check_pieces


def test_pipeline_against_brute_force(spark, tmp_path):
    rng = random.Random(0)
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t, *_ in corpus(near=25)]
    rows += [(20_000 + k, " ".join(rng.choice(["AA!!", "BB!!", "CC!!"]) + str(rng.randrange(900)) for _ in range(60)), "en", "s", 1) for k in range(60)]
    folder = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, int(i < 20_000), 0) for i, t, *_ in rows]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(f"{folder}/out/{name}")
        before, docs = docs, spark.read.parquet(f"{folder}/out/{name}")
        out[name] = docs
        if name != "packing":
            assert docs.columns == before.columns
    texts = lambda name: {r.doc_id: r.text for r in out[name].collect()}

    model = quality_rules.train(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    score = lambda t: model.score(quality_rules.matrix(quality_rules.statistics([(t or "").encode()])))[0]
    kept = {i: t for i, t, *_ in rows if not brute_statistics(t)[5] and score(t) > 0}
    assert texts("quality") == kept and sum(i < 20_000 for i in kept) > 60 and not any(i >= 20_000 for i in kept)
    last = {}
    for i, t in sorted(kept.items()):
        last["".join(c.lower() if c.isascii() else c for c in t)] = i
    kept = {i: kept[i] for i in last.values()}
    assert texts("exact") == kept
    kept = {i: kept[i] for i, (_, c) in brute_components(list(kept.items())).items() if i == c}
    assert texts("near") == kept
    want = brute_substring(list(kept.items()))
    got = texts("substring")
    assert {i: " ".join((t or "").split()) for i, t in got.items()} == {i: " ".join(t.split()) for i, (_, _, t) in want.items()}
    assert all(r.n_chars == len(r.text) for r in out["substring"].collect())
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    plain.encode_special_tokens = True
    check_pieces(list(got.items()), out["packing"].collect(), plain, 2)
    final = corpus_pipeline.run(spark, folder)
    assert final.count() == out["packing"].count() and np.sum([r.length for r in final.collect()]) == np.sum([r.length for r in out["packing"].collect()])


def test_near_stage_judges_rows_and_not_ids(spark):
    say = lambda k: [f"w{k}x{i}" for i in range(60)]
    full, short = (lambda k: " ".join(say(k))), (lambda k: " ".join(say(k)[:-3]))
    rows = [
        (7, full(0)), (None, short(0)),  # a null id beside a document with an id
        (None, full(1)), (None, "alone"), (None, None), (None, ""),  # linked with nothing
        (None, full(2)), (None, short(2)),  # near copies without ids
        (3, full(3)), (5, short(3)), (5, full(4)),  # a repeated id, one text of it linked
        (9, full(5)), (None, short(5)),  # another null id, not to tie 7 and 9
        (11, full(6)), (11, short(6)), (12, full(7)), (12, full(7)), (13, None), (13, None),
    ]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    out = corpus_pipeline.near(spark, df, "")
    assert out.columns == df.columns
    got = [(r.doc_id, r.text) for r in out.collect()]
    assert sum(t in (full(2), short(2)) for _, t in got) == 1 and sum(t in (full(6), short(6)) for _, t in got) == 1
    got = [r for r in got if r[1] not in (full(2), short(2), full(6), short(6))]
    want = [(7, full(0)), (None, full(1)), (None, "alone"), (None, None), (None, ""), (3, full(3)), (5, full(4)), (9, full(5)), (12, full(7)), (13, None), (13, None)]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert corpus_pipeline.near(spark, df.limit(0), "").count() == 0
