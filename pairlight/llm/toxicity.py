"""Toxicity scores of deobfuscated text: a noisy channel decoded by Viterbi, then word evidence.

Three passes. (1) Spark sums the character trigrams of all texts; the counts,
bounded by the alphabet, are the language model. (2) On a bounded sample of
labelled documents each word is restored and the documents of either label that
hold a feature (a restored word or one of its beginnings) are counted; features
that tell the labels apart get a weight, and two numbers per document are
fitted by logistic regression. (3) Every whole text is scored.

Restoring: a word with signs or digits between letters, with letters repeated
three times and more, or spelled out letter by letter becomes a lattice. Each
place offers what the writer may have meant (a sign as itself or as letters, a
run once or twice, a separator as nothing); Viterbi finds the likeliest path
under the trigrams. The written word stays a feature beside the restored one.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlight.llm.chunks import short_batches

SAMPLE, MIN_DOCS, SEED = 30_000, 5, 42
#: Letters that a sign can stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "*": "aeiou", "#": "h"}
_LETTERS = "abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïñòóôõöøùúûüýÿßœ"
_SIZE = 64  # classes of characters: 0 between words, one per letter, the last for all other letters
_CLASS = np.full(0x250, 0, dtype=np.int64)
for _i, _c in enumerate(_LETTERS):
    _CLASS[ord(_c)] = _i + 1
_OTHER = _SIZE - 1
_LEET = "".join(re.escape(c) for c in LEET)
_ODD = re.compile(rf"[^\W\d_][{_LEET}._\-]+[^\W\d_]|[{_LEET}][^\W\d_]|([^\W\d_])\1\1")
_SPELLED = re.compile(r"(?<!\w)[^\W\d_](?:[ ._\-*]{1,3}[^\W\d_]){2,}(?!\w)")
_EDGE = ".,;:?\"'()[]{}<>%&=~^/\\_-“”«»…"
_PREFIX = (4, 5, 6)


def classes(text: str) -> np.ndarray:
    """Classes of the lower-cased characters; runs between words count once."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype=np.uint32)
    out = np.where(codes < 0x250, _CLASS[np.minimum(codes, 0x24F)], _OTHER)
    return out[np.flatnonzero(np.diff(out, prepend=-1) | (out != 0))]


def trigram_counts(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Counts (64, 64, 64) over all texts. Each task sends its sums once; they are bounded by the alphabet."""

    def run(batches):
        sums, held, n = np.zeros(_SIZE**3, dtype=np.int64), [], 0
        for batch in short_batches(batches):
            for t in batch.column("text").to_pylist():
                if t:
                    c = np.concatenate([[0, 0], classes(t), [0]])
                    held.append((c[:-2] * _SIZE + c[1:-1]) * _SIZE + c[2:])
                    n += len(t)
                if n > 1 << 20:
                    sums += np.bincount(np.concatenate(held), minlength=_SIZE**3)
                    held, n = [], 0
        if held:
            sums += np.bincount(np.concatenate(held), minlength=_SIZE**3)
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(sums[some])], names=["gram", "n"])

    rows = docs.select(F.col(text).alias("text")).mapInArrow(run, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(_SIZE**3)
    counts[rows["gram"].to_numpy(dtype=np.int64)] = rows["n"]
    return counts.reshape(_SIZE, _SIZE, _SIZE)


def log_model(counts: np.ndarray) -> np.ndarray:
    """log P(c | a, b), trigrams backed by bigrams and single characters."""
    one = counts.sum(axis=(0, 1)) + 1.0
    one /= one.sum()
    two = counts.sum(axis=0)
    two = (two + 5 * one) / (two.sum(axis=1, keepdims=True) + 5)
    return np.log((counts + 5 * two[None]) / (counts.sum(axis=2, keepdims=True) + 5))


def lattice(word: str) -> list[list[str]]:
    """For each place of a word what may be meant, as strings of letters."""
    out: list[list[str]] = []
    for c, run in groupby(word):
        n = len(list(run))
        if c in LEET:
            meant = [*LEET[c]] + ([""] if not c.isdigit() else [c])
        elif c.isalpha():
            meant = [c]
        else:
            meant = [""]
        if n > 2:
            out.append(meant)
            out.append([m if m else "" for m in meant] + [""] if any(meant) else [""])
        else:
            out += [meant] * n
    return out


def restore(word: str, model: np.ndarray) -> str:
    """The likeliest reading of a word. States are the last two characters; ties go to the reading found first."""
    of = lambda c: int(_CLASS[ord(c)]) or _OTHER if ord(c) < 0x250 else _OTHER
    best: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
    for meant in lattice(word):
        after: dict[tuple[int, int], tuple[float, str]] = {}
        for (a, b), (score, read) in best.items():
            for m in meant:
                # a dropped sign and a letter cost the same channel step; the model decides between letters
                state, s, r = (a, b), score - 3.0, read
                if m and not (len(read) and m == read[-1] and m.isdigit()):
                    c = of(m)
                    state, s, r = (b, c), score + float(model[a, b, c]), read + m
                if state not in after or s > after[state][0]:
                    after[state] = (s, r)
        best = after
    return max(((s + float(model[a, b, 0]), r) for (a, b), (s, r) in best.items()), key=lambda x: x[0])[1]


def readings(token: str, model: np.ndarray) -> list[str]:
    """The bare written token and, where it looks disguised, what it may mean."""
    bare = token.strip(_EDGE)
    if not bare:
        return []
    plain = bare.strip("".join(LEET)) if not bare.isalpha() else bare
    out = [bare] if plain == bare else [bare, plain]
    if _ODD.search(bare):
        out += [restore(bare, model), restore(plain, model)]
    return [w for w in dict.fromkeys(out) if len(w) > 1]


def features(word: str) -> list[str]:
    """A word and its beginnings (marked)."""
    return [word, *(f"{word[:n]}-" for n in _PREFIX if len(word) > n)]


def tokens(text: str) -> set[str]:
    """Distinct lower-cased tokens, and spelled-out words as one token each."""
    low = text.lower()
    found = set(low.split())
    for m in _SPELLED.finditer(low):
        found.add(re.sub(r"[ ._\-*]", "", m[0]))
    return found


@dataclass
class Model:
    letters: np.ndarray
    weights: dict[str, float]
    fit: np.ndarray  # of the two strongest weights, and the constant

    def scorer(self, limit: int = 150_000):
        known: dict[str, float] = {}
        weights, letters = self.weights, self.letters

        def weigh(token: str) -> float:
            return max((weights.get(f, 0.0) for w in readings(token, letters) for f in features(w)), default=0.0)

        def top_two(text: str) -> tuple[float, float]:
            if len(known) > limit:
                known.clear()
            found = tokens(text)
            for t in found.difference(known):
                known[t] = weigh(t)
            first = second = 0.0
            for x in map(known.__getitem__, found):
                if x > second:
                    first, second = (x, first) if x > first else (first, x)
            return first, second

        return top_two


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic", min_docs: int = MIN_DOCS) -> Model:
    """Letters from all of `docs`; weights from at most `sample` labelled documents, chosen by a hash of the id.

    A label that is null, or whose document is not in `docs`, is not used; of
    several labels of one document the greatest counts. Without both labels the
    scores are constant.
    """
    letters = log_model(trigram_counts(docs, text))
    told = labels.where(f"{toxic} is not null and {doc_id} is not null").groupBy(doc_id).agg(F.max(toxic).cast("int").alias("y"))
    chosen = told.orderBy(F.xxhash64(doc_id), doc_id).limit(sample).select(F.col(doc_id).alias("id"), "y")
    shared = docs.sparkSession.sparkContext.broadcast(letters)
    known = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(chosen), "id").select("text", "y")  # `sample` rows of two numbers

    def count(batches):
        model, memo = shared.value, {}
        for batch in short_batches(batches):
            found, ys = [], []
            for t, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist()):
                have: set[str] = set()
                for token in tokens(t):
                    if token not in memo:
                        memo[token] = [f for w in readings(token, model) for f in features(w)]
                    have.update(memo[token])
                found += have
                ys += [y] * len(have)
                if len(found) > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(ys, pa.int32())], names=["f", "y"])
                    found, ys, memo = [], [], memo if len(memo) < 100_000 else {}
            memo = memo if len(memo) < 100_000 else {}
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(ys, pa.int32())], names=["f", "y"])

    sizes = chosen.agg(F.sum("y"), F.count("y")).first()
    n1 = int(sizes[0] or 0)
    n0 = int(sizes[1] or 0) - n1
    if not n1 or not n0:
        return Model(letters, {}, np.array([0.0, 0.0, np.log((n1 + 0.5) / (n0 + 0.5))]))
    odds = F.log((F.col("a") + 0.5) / (n1 + 1)) - F.log((F.col("b") + 0.5) / (n0 + 1))
    counted = known.mapInArrow(count, "f string, y int").groupBy("f").agg(F.sum("y").cast("double").alias("a"), F.sum(1 - F.col("y")).cast("double").alias("b"))
    weights = {r["f"]: r["w"] for r in counted.where(F.col("a") >= min_docs).select("f", odds.alias("w")).where("w > 1").toLocalIterator()}
    model = Model(letters, weights, np.zeros(3))
    both = docs.sparkSession.sparkContext.broadcast(model)

    def measure(batches):
        top = both.value.scorer()
        for batch in short_batches(batches):
            pairs = [top(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.float64()), pa.array([p[1] for p in pairs], pa.float64()), batch.column("y")], names=["m1", "m2", "y"])

    seen = known.mapInArrow(measure, "m1 double, m2 double, y int").groupBy("m1", "m2", "y").count().toPandas()  # at most `sample` rows
    model.fit = logistic(np.column_stack([seen["m1"], seen["m2"], np.ones(len(seen))]), seen["y"].to_numpy(float), seen["count"].to_numpy(float))
    return model


def logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weighted logistic regression by Newton steps; rows in any order give the same up to rounding."""
    w = np.zeros(x.shape[1])
    penalty = np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + penalty, x.T @ (n * (y - p)) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "toxicity") -> DataFrame:
    """`docs` with the column `out`, 0 to 1. Null or empty text gets the score of a text without evidence; other columns and repeated rows stay."""
    kept = docs.drop(out)
    schema = kept.withColumn(out, F.lit(0.0)).schema
    schema[out].nullable = True
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        top, fit = shared.value.scorer(), shared.value.fit
        for batch in short_batches(batches):
            pairs = np.array([top(t or "") for t in batch.column(text).to_pylist()], dtype=float).reshape(-1, 2)
            p = 1 / (1 + np.exp(-np.clip(pairs @ fit[:2] + fit[2], -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.round(p, 9))], names=[*batch.schema.names, out])

    return kept.mapInArrow(run, schema)
