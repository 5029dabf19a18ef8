"""License scan: a paragraph classifier that names licence families, confirmed by comparison with their wording.

A multinomial logistic regression over hashed word 1- to 3-grams gives each family's probability and that of
"no licence". It is trained on templates cut, shortened and disturbed and on lines that grant nothing. Templates
and sentences, not lines, are dealt to a training and a held-out part: the temperature and the thresholds come
from a model that has never seen the held-out ones, with thresholds that at most ``FALSE_SHARE`` of the held-out
lines without a licence reach; the weights in use are then fitted on all.

Every line is judged by itself, and so is each paragraph: a stretch of neighbouring lines of which each is a
finding or shares three words in a row with a template, cut where the family changes, so that a wrapped grant is
one text. A finding is confirmed if enough of its word 3-grams (or its 2-grams or words, if it has no more)
stand in one template of the family, or the other way round. What grants something by the classifier but is no
known family with enough probability is a finding of the family ``unknown``, never confirmed.

Defined results: a null or empty text has no findings; each row is scanned by itself; neighbouring lines of
one family are one finding. Only n-grams of the training lines carry weight, so a line without any is no finding.
Other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .license_templates import FAMILIES, NEAR_MISSES
from .words import Words, mix, release, text_slices

FEATURE_BITS, GRAMS = 18, 3
COPIES, ROUNDS, STEP, DECAY = 20, 150, 2.0, 2e-4
FALSE_SHARE, CONFIRM = 0.001, 0.5
#: Every so many templates of a family, and sentences without a licence, are held out.
HELD_OUT = 4
UNKNOWN = "unknown"
#: Punctuation but for signs inside version numbers and identifiers gives way to spaces.
_BARE = bytes(32 if 33 <= i < 127 and not chr(i).isalnum() and chr(i) not in ".-" else i for i in range(256))
_ENDS = re.compile(rb"(?<!\S)[.-]+|[.-]+(?!\S)")


def clean(text: bytes) -> bytes:
    """A text of bare words with its line breaks, for training and scanning alike."""
    return _ENDS.sub(b" ", text.translate(_BARE))


def grams(lines: list[bytes], templates: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, feature) of the distinct word n-grams, and the lines with a 3-gram whose hash is in ``templates``."""
    w = Words(lines, lower=True)
    h, of, out, alike = w.hashes(), np.repeat(np.arange(len(lines)), w.n), [], np.zeros(0, np.int64)
    for n in range(1, GRAMS + 1):
        at, g = w.windows(n, h)
        out.append(of[at].astype(np.uint64) << np.uint64(FEATURE_BITS) | mix(g + np.uint64(n)) & np.uint64((1 << FEATURE_BITS) - 1))
        if n == GRAMS and templates is not None and len(templates):
            place = np.minimum(np.searchsorted(templates, g), len(templates) - 1)
            alike = np.unique(of[at[templates[place] == g]])
    key = np.unique(np.concatenate(out))
    return (key >> np.uint64(FEATURE_BITS)).astype(np.int64), (key & np.uint64((1 << FEATURE_BITS) - 1)).astype(np.int64), alike


@dataclass
class Classifier:
    families: tuple[str, ...]  # the last one is no licence
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    least: float  # of the best family
    least_any: float  # of all families together
    templates: tuple[tuple[tuple[str, ...], ...], ...]
    hashes: np.ndarray  # of the templates' 3-grams, sorted

    def probabilities(self, line: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
        return _softmax((self.bias + _sums(self.weights[feature], line, n)) / self.temperature)

    def judge(self, lines: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(family or -1, its probability, lines that share a 3-gram with a template); the last family stands for unknown."""
        known = self.weights.any(axis=1)
        line, feature, alike = grams(lines, self.hashes)
        some = known[feature]
        rows, line = np.unique(line[some], return_inverse=True)
        family, sure = np.full(len(lines), -1), np.zeros(len(lines))
        if len(rows):
            p = self.probabilities(line, feature[some], len(rows))
            best, any_ = p[:, :-1].argmax(axis=1), 1 - p[:, -1]
            top = p[np.arange(len(rows)), best]
            clear, other = (top >= self.least) & (top > p[:, -1]), any_ >= self.least_any
            family[rows] = np.where(clear, best, np.where(other, p.shape[1] - 1, -1))
            sure[rows] = np.where(clear, top, any_)
        return family, sure, alike


def _sums(values: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of ``values`` by their place, which only grows."""
    out = np.zeros((n, values.shape[1]), values.dtype)
    if len(at):
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        out[at[first]] = np.add.reduceat(values, first, axis=0)
    return out


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _lines(seed: int, part: str = "all") -> tuple[list[bytes], np.ndarray]:
    """Lines and their classes, from the templates of one part: all, training or held-out."""
    rng, lines, kinds = np.random.default_rng(seed), [], []
    own = lambda items: [x for i, x in enumerate(items) if part == "all" or (i % HELD_OUT == HELD_OUT - 1) == (part == "held-out")]
    noise = lambda n: ["".join(rng.choice(list("aeionrstlhdu"), rng.integers(2, 9))) for _ in range(n)]
    for kind, wordings in enumerate(FAMILIES.values()):
        for wording in own(wordings):
            words = wording.split()
            for copy in range(COPIES):
                some = list(words)
                if copy and len(some) > 12:  # a line of a wrapped paragraph
                    i = int(rng.integers(0, len(some) - 8))
                    some = some[i : i + int(rng.integers(8, 24))]
                some = [w for w in some if rng.random() > 0.05 * (copy > 1)] or some
                lines.append(" ".join([*noise(int(rng.integers(0, 4)) * (copy > 2)), *some, *noise(int(rng.integers(0, 6)) * (copy > 2))]).encode())
                kinds.append(kind)
    misses = own(NEAR_MISSES)
    common = " ".join(misses).split()
    for copy in range(len(lines)):
        words = misses[copy % len(misses)].split() if copy % 3 == 0 else list(rng.choice(common, int(rng.integers(3, 20)))) if copy % 3 == 1 else noise(int(rng.integers(1, 30)))
        lines.append(" ".join(words).encode())
        kinds.append(len(FAMILIES))
    return [clean(x) for x in lines], np.array(kinds)


def _fit(lines: list[bytes], kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights of all features, and biases."""
    classes, n = len(FAMILIES) + 1, len(lines)
    line, feature, _ = grams(lines)
    used, column = np.unique(feature, return_inverse=True)
    weights, bias, goal = np.zeros((len(used), classes), np.float32), np.zeros(classes, np.float32), np.eye(classes, dtype=np.float32)[kind]
    per = np.maximum(np.bincount(column, minlength=len(used)), 1)[:, None].astype(np.float32) ** 0.5
    by = np.argsort(column, kind="stable")
    for _ in range(ROUNDS):
        slope = _softmax(bias + _sums(weights[column], line, n)) - goal
        g = _sums(slope[line[by]], column[by], len(used))
        weights -= np.float32(STEP) * (g / per / np.float32(n**0.5) + np.float32(DECAY) * weights)
        bias -= (STEP * slope.sum(axis=0) / n).astype(np.float32)
    whole = np.zeros((1 << FEATURE_BITS, classes), np.float32)
    whole[used] = weights
    return whole, bias


@lru_cache(maxsize=1)
def trained() -> Classifier:
    templates = tuple(tuple(tuple(clean(t.encode()).decode().lower().split()) for t in wordings) for wordings in FAMILIES.values())
    hashes = np.unique(np.concatenate([Words([" ".join(t).encode()], lower=True).windows(GRAMS)[1] for wordings in templates for t in wordings]))
    make = lambda weights, bias, temperature, least, least_any: Classifier((*FAMILIES, UNKNOWN), weights, bias, temperature, least, least_any, templates, hashes)
    weights, bias = _fit(*_lines(11, "training"))
    held, kind = _lines(12, "held-out")
    line, feature, _ = grams(held)
    given = lambda t: make(weights, bias, t, 0, 0).probabilities(line, feature, len(held))
    losses = {t: -np.log(np.maximum(given(t)[np.arange(len(held)), kind], 1e-12)).mean() for t in (0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0)}
    temperature = min(losses, key=losses.get)
    p = given(temperature)[kind == len(FAMILIES)]
    least, least_any = (float(max(0.5, np.quantile(x, 1 - FALSE_SHARE))) for x in (p[:, :-1].max(axis=1), 1 - p[:, -1]))
    return make(*_fit(*_lines(11)), temperature, least, least_any)


def _word_grams(words: tuple[str, ...], n: int) -> set:
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def similarity(line: bytes, templates: tuple[tuple[str, ...], ...]) -> float:
    """The largest share of the n-grams of the line, or of a template, that stand in the other; n is 3 or the length of the shorter."""
    words, best = tuple(line.decode("utf-8", "replace").lower().split()), 0.0
    for t in templates:
        n = min(GRAMS, len(words), len(t))
        if n:
            x, y = _word_grams(words, n), _word_grams(t, n)
            best = max(best, len(x & y) / min(len(x), len(y)))
    return best


FINDING = "array<struct<first_line:int,last_line:int,family:string,probability:double,similarity:double,confirmed:boolean,text:string>>"


def _stretches(marked: list[int], owner: list[int], number: list[int], family: np.ndarray) -> Iterator[list[int]]:
    """Runs of neighbouring marked lines of one text, cut where the family changes."""
    run: list[int] = []
    named = -1
    for k in marked:
        new = int(family[k])
        if run and (owner[k] != owner[run[-1]] or number[k] != number[run[-1]] + 1 or (new >= 0 and named >= 0 and new != named)):
            yield run
            run, named = [], -1
        run.append(k)
        named = new if new >= 0 else named
    if run:
        yield run


def _scan(texts: list[bytes | None], model: Classifier) -> list[list[dict]]:
    lines, owner, number = [], [], []
    for d, t in enumerate(texts):
        own = clean(t or b"").split(b"\n")
        lines += own
        owner += [d] * len(own)
        number += range(len(own))
    family, sure, alike = model.judge(lines)
    runs = list(_stretches(np.union1d(np.flatnonzero(family >= 0), alike).tolist(), owner, number, family))
    # a stretch of lines is a paragraph; where it is no finding as a whole, its lines count by themselves
    whole = [r for r in runs if len(r) > 1]
    of, p, _ = model.judge([b" ".join(lines[k] for k in r) for r in whole])
    judged = {r[0]: (int(f), float(x)) for r, f, x in zip(whole, of, p)}
    out: list[list[dict]] = [[] for _ in texts]
    for r in runs:
        f, x = judged.get(r[0], (-1, 0.0))
        text = b" ".join(lines[k] for k in r)
        if 0 <= f < len(model.templates) and similarity(text, model.templates[f]) >= CONFIRM:
            parts = [(r, f, x)]
        else:
            parts = [([k], int(family[k]), float(sure[k])) for k in r if family[k] >= 0]
        for own, f, x in parts:
            found = out[owner[own[0]]]
            alike_ = similarity(b" ".join(lines[k] for k in own), model.templates[f]) if f < len(model.templates) else 0.0
            first, last = number[own[0]], number[own[-1]]
            before = found[-1] if found else None
            if before and before["family"] == model.families[f] and before["last_line"] == first - 1:
                before |= {"last_line": last, "probability": max(before["probability"], x), "similarity": max(before["similarity"], alike_)}
            else:
                found.append(dict(first_line=first, last_line=last, family=model.families[f], probability=x, similarity=alike_))
    for found, text in zip(out, texts):
        if found:
            raw = text.split(b"\n")
            for x in found:
                x |= {"confirmed": x["similarity"] >= CONFIRM, "text": b"\n".join(raw[x["first_line"] : x["last_line"] + 1]).decode("utf-8", "replace")}
    return out


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, families, n_findings, findings), one row per row of ``docs``; families are those of confirmed findings."""
    model = docs.sparkSession.sparkContext.broadcast(trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, texts in text_slices(b.column(1)):
                found = _scan(texts, model.value)
                families = [sorted({f["family"] for f in x if f["confirmed"]}) for x in found]
                kind = pa.list_(pa.struct([("first_line", pa.int32()), ("last_line", pa.int32()), ("family", pa.string()), ("probability", pa.float64()), ("similarity", pa.float64()), ("confirmed", pa.bool_()), ("text", pa.string())]))
                yield pa.RecordBatch.from_arrays([b.column(0)[part], pa.array(families, pa.list_(pa.string())), pa.array([len(x) for x in found], pa.int64()), pa.array(found, kind)], [id_col, "families", "n_findings", "findings"])
        release()

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, f"`{id_col}` long, families array<string>, n_findings long, findings {FINDING}")
