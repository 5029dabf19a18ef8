import random
import re
from collections import Counter, defaultdict

from evidentia.llm import source_divergence as D
from evidentia.llm.source_divergence import source_divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string, term string, n long, k string, value string, item string"


def brute(rows, least=10, top=10):
    docs = [((r[2] or ""), (r[3] or ""), [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(r[1] or "")]) for r in rows]
    df, groups = defaultdict(Counter), defaultdict(Counter)
    for lang, source, terms in docs:
        df[lang].update(set(terms))
        groups[lang, source].update(terms)
    out = []
    for lang in {l for l, _, _ in docs}:
        kept = [t for t, n in df[lang].items() if n >= least]
        own = {s: {t: c[t] for t in kept} for (l, s), c in groups.items() if l == lang}
        whole = {t: sum(c[t] for c in own.values()) for t in kept}
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in own.items()}, share(whole)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in own:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in own if o != s]
            terms = [(f(p[s][t], q[t]), t) for t in kept if own[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, i, v, n + 1) for n, (v, i) in enumerate(found) if part == "pair" or n < top]
    return out


def corpus(seed, sources=7, docs=160, vocabulary=60):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcXYé漢") for _ in range(rng.randint(1, 4))) for _ in range(vocabulary)]
    weight = [1 / (i + 1) for i in range(vocabulary)]
    rows = [(None, None, None, None), (1, "", "", ""), (2, "... 12 !", "en", "empty"), (3, "rare rarer", "xx", None), (4, None, "en", "none")]
    for i in range(docs):
        lang, source = rng.choice(["en", "en", "de", None]), rng.choice([f"s{k}" for k in range(sources)] + ["hot"] * sources)
        shift = hash_of(source) % 5
        text = rng.choice([" ", "\n", "-"]).join(rng.choices(words[shift:] + words[:shift], weight, k=rng.randint(0, 90)))
        rows.append((i, text, lang, source))
    rows += rows[-3:]
    return [(*r, "t", 1, "k", "v", "i") for r in rows]


def hash_of(s):
    return sum(map(ord, s))


def check(spark, rows, **also):
    got = source_divergence(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows, **also))
    return got


def test_source_divergence_is_its_brute_force(spark):
    got = check(spark, corpus(1))
    assert {r.part for r in got} == {"pair", "term"} and any(r.item == "" for r in got)


def test_blocks_of_sources_small_buckets_and_many_turns(spark, monkeypatch):
    """Several blocks of sources, joins without broadcasts and small tasks give the same rows."""
    for name, value in (("BLOCK", 4), ("BLOCKS", 2), ("FEW", 0), ("HELD", 10), ("TOP", 3)):
        monkeypatch.setattr(D, name, value)
    check(spark, corpus(4, sources=11, docs=250, vocabulary=150), top=3)


def test_no_kept_terms_and_no_rows(spark):
    rows = [(i, "a b", "en", f"s{i % 3}", "t", 1, "k", "v", "i") for i in range(9)]
    got = check(spark, rows)
    assert len(got) == 6 and {r.value for r in got} == {0}
    assert source_divergence(spark.createDataFrame([], SCHEMA)).collect() == []


def test_the_search_leaves_most_terms_unread(spark, monkeypatch):
    """Turns stop where bounds fall strictly below the k-th value: rare terms of all sources are never evaluated."""
    rng = random.Random(6)
    rows = []
    for i in range(120):
        own = [f"top{chr(97 + i % 2)}{chr(97 + k)}" for k in range(12) for _ in range(rng.randint(3, 9))]
        rows.append((i, " ".join(own + ["rare" + chr(97 + k % 26) + chr(97 + k // 26) for k in range(300)]), "en", f"s{i % 2}", "t", 1, "k", "v", "i"))
    turns = []
    near = D._near
    monkeypatch.setattr(D, "_near", lambda df, n: (turns.append(n) if df.columns == ["lang", "source", "bucket"] else None, near(df, n))[1])
    check(spark, rows)
    assert len(turns) <= 2


def test_long_texts_are_counted_in_pieces(monkeypatch):
    monkeypatch.setattr(D, "PIECE", 16)
    text = "aé-b cc dddddddddddddddddddddddddddddddd 漢漢" * 9 + "!"
    assert [t for piece in D._pieces(text.encode()) for t in D.TERM.findall(piece)] == D.TERM.findall(text.encode())
    assert list(D._pieces(b"")) == [] and max(map(len, D._pieces(text.encode()))) < 70
