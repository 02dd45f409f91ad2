"""Toxicity: a support vector machine on a subsequence string kernel with Nystrom landmarks.

A text is cut into sentences and each of these into units: its words, white-space chunks without the marks inside them
(so "id*iot" is a unit), and runs of single letters joined ("i d i o t"). Digits and marks that stand for letters are
read as those. The kernel of two units is the gap-weighted subsequence kernel of length 3: the inner product, over all
letter triples, of the sums of DECAY ** span over their occurrences, with a span of at most SPAN letters, normalised,
and raised to a power. As a triple may skip letters, an insult with inserted letters keeps most of its value. Small values are cut to 0.

Landmarks are the units whose document counts in the labelled sample tell toxic from clean texts best. A sentence is
described by its largest kernel value with each landmark, whitened by K ** -1/2 (Nystrom), and a linear SVM with squared
hinge loss is trained on sentences: all of clean texts, and of each toxic text the one that scores highest, chosen again in
every round; copies with an inserted letter are added for each. A logistic function of the best margin, of
all margins together and of the length gives the score.

The fit uses at most MOST_TOXIC and MOST_CLEAN labelled texts, those whose hashed ids come first; all texts are scored
as wholes. Ids, labels, languages and sources never enter a score. A unit's cheap upper bound on every kernel value
clears most units at once, and what was computed for a unit is kept in bounded memory.

Defined cases: a null text is an empty one, with the score of a text without landmarks; repeated rows give repeated
results; labels that are null are not used, and several labels of one id count as toxic if any is; without toxic or
without clean labels all scores are the share of toxic ones (0 without labels). Of documents only doc_id and text are
read.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinloom.llm.store import staged

#: Bounds of the labelled sample.
MOST_TOXIC, MOST_CLEAN = 2000, 4000
LANDMARKS = 64
DECAY, SPAN = 0.7, 7
FLOOR = 0.5
POWER = 3
#: A landmark is so many times as frequent in toxic texts, with so large a log-likelihood ratio (natural logarithm).
TELLS, LEAST = 4, 12.0
#: Codes of letters: 0 isn't used, then the plain ones, then classes of all others.
N_PLAIN, LETTERS = 26, 44
CACHE = 400_000
#: Texts of fewer chunks count as this long.
SHORT = 40
#: Longest unit that is compared; longer ones are cut into overlapping pieces.
UNIT = 24
_LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l"})
_SENTENCE = re.compile(r"[.!?\n]+(?=\s|$)")
_SPACED = re.compile(r"(?<!\w)\w(?:[\W_]{1,2}\w(?!\w)){2,}")
_MARKS = re.compile(r"[\W_]+")
_PLAIN = re.compile(r"[a-zÀ-ɏ]+")
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")


def _letter_codes(points: np.ndarray) -> np.ndarray:
    return N_PLAIN + 1 + (points * 0x9E3779B1 >> 16) % (LETTERS - N_PLAIN - 1)


def _latin_codes() -> np.ndarray:
    """Codes of the code points up to 0x24F: a letter with marks is the letter that it is made of."""
    out = _letter_codes(np.arange(0x250, dtype=np.int64))
    for point in range(0x250):
        base = unicodedata.normalize("NFKD", chr(point))[0]
        if "a" <= base <= "z":
            out[point] = ord(base) - 96
    return out


_LATIN = _latin_codes()


def _codes(unit: str) -> np.ndarray:
    """Letters a to z, with or without marks, as 1 to 26; all others by a hash, so that words of other alphabets are
    compared letter by letter too, and seldom take different letters for equal."""
    raw = np.frombuffer(unit.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return np.where(raw < 0x250, _LATIN[np.minimum(raw, 0x24F)], _letter_codes(raw))


def triples(unit: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the letter triples of a unit, and DECAY ** span of each occurrence."""
    c = _codes(unit)
    place = _places(len(c))
    return c[place[0]] * LETTERS**2 + c[place[1]] * LETTERS + c[place[2]], place[3]


_place_of: dict[int, tuple] = {}


def _places(n: int) -> tuple:
    if n not in _place_of:
        rows = [(i, j, k) for i in range(n) for j in range(i + 1, n) for k in range(j + 1, min(n, i + SPAN))]
        at = np.array(rows, np.int64).reshape(-1, 3).T
        _place_of[n] = (at[0], at[1], at[2], DECAY ** (at[2] - at[0] + 1.0))
    return _place_of[n]


def phi(unit: str) -> tuple[np.ndarray, np.ndarray]:
    """Different triples and their normalised weights."""
    code, weight = triples(unit)
    code, inverse = np.unique(code, return_inverse=True)
    value = np.bincount(inverse, weight, minlength=len(code))
    return code, value / (np.sqrt((value**2).sum()) or 1.0)


def _norms(code: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The norm of each row of triples, the weights of equal ones being added up first."""
    order = code.argsort(axis=1, kind="stable")
    ranked = np.take_along_axis(code, order, axis=1)
    new = np.ones(code.shape, bool)
    new[:, 1:] = ranked[:, 1:] != ranked[:, :-1]
    at = np.flatnonzero(new.ravel())
    total = np.add.reduceat(weight[order].ravel(), at)
    return np.sqrt(np.bincount(at // code.shape[1], total**2, minlength=len(code)))


def kernel(a: str, b: str) -> float:
    (x, p), (y, q) = phi(a), phi(b)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    return float((p[i] * q[j]).sum())


def pieces(unit: str) -> list[str]:
    return [unit] if len(unit) <= UNIT else [unit[k : k + UNIT] for k in range(0, len(unit) - UNIT // 2, UNIT // 2)]


def units(chunk: str) -> list[str]:
    """Units of one lower-case white-space chunk: its words, and the whole without marks where marks stand inside."""
    if _PLAIN.fullmatch(chunk):
        return pieces(chunk)
    core = _EDGE.sub("", chunk)
    if core.isalpha():
        return pieces(core)
    found = [w for w in _MARKS.split(core) if w]
    joined = "".join(found)
    out = [*found, joined, *[w.translate(_LEET) for w in (joined, _MARKS.sub("", chunk.strip("!?.,;:|").translate(_LEET)))]]
    return [p for w in dict.fromkeys(out) if w for p in pieces(w)]


class Landmarks:
    def __init__(self, names: list[str]):
        self.names = names
        self.table = np.zeros((LETTERS**3, len(names)), np.float32)
        for k, name in enumerate(names):
            code, value = phi(name)
            self.table[code, k] = value
        self.top = self.table.max(axis=1) if names else np.zeros(LETTERS**3, np.float32)
        self.known: dict[str, np.ndarray | None] = {}

    def value(self, unit: str) -> np.ndarray | None:
        """Powers of the kernel values with all landmarks, floored; None where all are 0."""
        return self.values([unit]).get(unit) if len(unit) >= 3 and self.names else None

    def values(self, found: list[str]) -> dict[str, np.ndarray]:
        """``value`` of units of one length, those that have one. Sums go triple by triple, so that a unit's value doesn't
        depend on those beside it."""
        n, out = len(found[0]), {}
        place = _places(n)
        weight = place[3].astype(np.float32)
        for k in range(0, len(found), 1024):
            part = found[k : k + 1024]
            c = _codes("".join(part)).reshape(-1, n)
            code = c[:, place[0]] * LETTERS**2 + c[:, place[1]] * LETTERS + c[:, place[2]]
            got = np.zeros((len(part), len(self.names)), np.float32)
            for t, w in enumerate(weight):
                got += self.table[code[:, t]] * w
            got /= _norms(code, place[3])[:, None].astype(np.float32)
            got = np.where(got < FLOOR, 0, got) ** POWER
            out.update((part[i], got[i].copy()) for i in np.flatnonzero(got.any(axis=1)))
        return out

    def near(self, found: list[str]) -> list[str]:
        """The units, all of one length, that an upper bound on their kernel values doesn't clear."""
        n = len(found[0])
        place, out = _places(n), []
        least = FLOOR * np.sqrt((place[3] ** 2).sum())  # products of equal triples would only make the norm larger
        weight = place[3].astype(np.float32)
        for k in range(0, len(found), 4096):
            part = found[k : k + 4096]
            c = _codes("".join(part)).astype(np.int32).reshape(-1, n)
            bound = self.top[c[:, place[0]] * LETTERS**2 + c[:, place[1]] * LETTERS + c[:, place[2]]] @ weight
            out += [part[i] for i in np.flatnonzero(bound >= least - 1e-4)]
        return out

    def learn(self, chunks: set[str]) -> None:
        """Fill ``known`` for chunks that aren't in it."""
        new = chunks.difference(self.known)
        if not new or not self.names:
            return
        if len(self.known) + len(new) > CACHE:
            self.known.clear()
            new = chunks
        own = {c: units(c) for c in new}
        by_length: dict[int, set[str]] = {}
        for us in own.values():
            for u in us:
                if len(u) >= 3:
                    by_length.setdefault(len(u), set()).add(u)
        value = {u: v for group in by_length.values() if (close := self.near(sorted(group))) for u, v in self.values(close).items()}
        for c, us in own.items():
            found = [value[u] for u in us if u in value]
            self.known[c] = np.max(found, axis=0) if found else None

    def sentences(self, text: str, chunks: set[str]) -> list[np.ndarray]:
        """The largest values of each sentence that has any; ``chunks`` are those of the lower-case text."""
        known = self.known
        told = {c for c in chunks if known.get(c) is not None}
        spaced = _SPACED.search(text) is not None
        out = []
        if told or spaced:
            for sentence in _SENTENCE.split(text):
                found = [known[c] for c in told.intersection(sentence.split())] if told else []
                if spaced:
                    for run in _SPACED.findall(sentence):
                        joined = _MARKS.sub("", run).translate(_LEET)
                        found += [v for p in pieces(joined) if (v := self.value(p)) is not None]
                if found:
                    out.append(np.max(found, axis=0))
        return out

    def described(self, texts: list[str]) -> Iterator[tuple[int, list[np.ndarray]]]:
        """Number of chunks and sentence values of each text; cached values are made for many texts at once."""
        for k in range(0, len(texts), 256):
            lower = [t.lower() for t in texts[k : k + 256]]
            lists = [t.split() for t in lower]
            sets = [set(c) for c in lists]
            self.learn(set().union(*sets))
            for t, c, s in zip(lower, lists, sets, strict=True):
                yield len(c), self.sentences(t, s)


def _summary(margins: np.ndarray, n: int, bias: float) -> list[float]:
    """What a text's sentences come to: the best margin, all that exceed that of an empty sentence, and the length."""
    best = max([0.0, *margins.tolist()]) + bias
    return [best, float(np.log1p(np.maximum(margins, 0).sum())), float(np.log1p(max(n, SHORT)))]


@dataclass
class Model:
    landmarks: list[str]
    weight: list[float]
    bias: float
    logistic: list[float]
    prior: float

    def score(self, texts: list[str], marks: Landmarks) -> np.ndarray:
        if not self.landmarks:
            return np.full(len(texts), self.prior)
        weight = np.array(self.weight)
        rows = [[*_summary(np.array([float(v @ weight) for v in found]), n, self.bias), 1.0] for n, found in marks.described(texts)]
        return 1 / (1 + np.exp(-np.clip(np.array(rows).reshape(-1, 4) @ self.logistic, -30, 30)))


def _sample(docs: DataFrame, labels: DataFrame, most_toxic: int, most_clean: int) -> DataFrame:
    """toxic, text of the labelled rows that are fitted on."""
    told = labels.where("toxic is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64(F.lit(7), "id")
    ids = told.where("toxic = 1").orderBy(order, "id").limit(most_toxic).union(told.where("toxic = 0").orderBy(order, "id").limit(most_clean))
    ids = staged(ids, "sample-ids")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return staged(texts.join(F.broadcast(ids), "id"), "sample")  # at most so many ids as the bounds say


def _choose(sample: DataFrame, n: int) -> tuple[list[str], int, int]:
    """The units that tell best, by the log-likelihood ratio of their document counts."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic, unit = [], []
            for t, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = {u for c in set(text.lower().split()) for u in units(c) if len(u) >= 3}
                toxic += [t] * len(own)
                unit += own
            yield pa.RecordBatch.from_arrays([pa.array(toxic, pa.int32()), pa.array(unit, pa.string())], ["toxic", "unit"])

    both = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    bad, good = both.get(1, 0), both.get(0, 0)
    if not bad or not good:
        return [], bad, good
    counts = sample.select(F.col("toxic").cast("int").alias("toxic"), "text").mapInArrow(of, "toxic int, unit string").groupBy("unit").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))

    def part(x: Column, y: Column) -> Column:
        return F.when(x > 0, x * F.ln(x / y)).otherwise(0.0)

    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    share = (a + b) / (bad + good)
    told = part(a, share * bad) + part(b, share * good) + part(bad - a, (1 - share) * bad) + part(good - b, (1 - share) * good)
    best = counts.where((a / bad > TELLS * b / good) & (a >= 2) & (told > LEAST)).orderBy(F.desc(told), "unit").limit(n)
    return [r["unit"] for r in best.collect()], bad, good


def _perturbed(name: str, rng: np.random.Generator) -> str:
    k = int(rng.integers(1, len(name)))
    return name[:k] + chr(97 + int(rng.integers(26))) + name[k:]


def _svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, ridge: float = 1e-3) -> tuple[np.ndarray, float]:
    """A linear SVM with squared hinge loss, by Newton steps on the rows inside the margin."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    keep = np.full(x.shape[1], ridge)
    keep[-1] = 1e-9
    w, cost = np.zeros(x.shape[1]), cost / cost.sum()
    loss = np.inf
    for _ in range(25):
        near = y * (x @ w) < 1
        xs, cs = x[near], cost[near][:, None]
        goal = np.linalg.solve((xs * cs).T @ xs + np.diag(keep), (xs * cs).T @ y[near])
        for share in (1.0, 0.5, 0.25, 0.1, 0.02):
            now = w + share * (goal - w)
            value = (cost * np.maximum(0, 1 - y * (x @ now)) ** 2).sum() + (keep * now**2).sum()
            if value < loss:
                break
        if loss - value < 1e-9:
            break
        w, loss = now, value
    return w[:-1], float(w[-1])


def _logistic(x: np.ndarray, y: np.ndarray) -> list[float]:
    """Weights of a logistic function, the last for the constant, by Newton steps, slightly shrunk."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    p = np.zeros(x.shape[1])
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(x @ p, -30, 30)))
        grad = x.T @ (q - y) + 1e-2 * p
        hess = (x * (q * (1 - q))[:, None]).T @ x + 1e-2 * np.eye(len(p))
        p = p - np.clip(np.linalg.solve(hess, grad), -2, 2)
    return p.tolist()


def fit(docs: DataFrame, labels: DataFrame, landmarks: int = LANDMARKS, most_toxic: int = MOST_TOXIC, most_clean: int = MOST_CLEAN, seed: int = 5) -> Model:
    sample = _sample(docs, labels, most_toxic, most_clean)
    names, bad, good = _choose(sample, landmarks)
    if not names:
        return Model([], [], 0.0, [], bad / (bad + good) if bad + good else 0.0)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = Landmarks(names)
        for batch in batches:
            doc, toxic, size, values = [], [], [], []
            texts = batch.column(2).to_pylist()
            for i, t, (n, found) in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), marks.described(texts), strict=True):
                for v in found or [np.zeros(len(names), np.float32)]:
                    doc.append(i)
                    toxic.append(t)
                    size.append(n)
                    values.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(toxic, pa.int32()), pa.array(size, pa.int64()), pa.array(values, pa.list_(pa.float32()))], ["id", "toxic", "size", "v"])

    rows = sample.select("id", F.col("toxic").cast("int").alias("toxic"), "text").mapInArrow(of, "id long, toxic int, size long, v array<float>").toArrow()
    own, toxic, size = (rows.column(k).to_numpy() for k in range(3))
    v = rows.column(3).combine_chunks().flatten().to_numpy().reshape(-1, len(names)).astype(float)
    order = np.lexsort((*v.T, own))
    return train(names, own[order], toxic[order], size[order], v[order], seed)


def train(names: list[str], owner: np.ndarray, toxic: np.ndarray, size: np.ndarray, v: np.ndarray, seed: int = 5) -> Model:
    """From the kernel values (rows of ``v``) of sentences, with the id, the label and the length of their text."""
    ids = np.unique(owner, return_inverse=True)[1]
    gram = np.array([[kernel(a, b) ** POWER for b in names] for a in names])
    eigen, base = np.linalg.eigh(gram)
    whiten = base @ np.diag(1 / np.sqrt(np.maximum(eigen, 1e-2))) @ base.T
    x = v @ whiten
    rng = np.random.default_rng(seed)
    marks = Landmarks(names)
    some = v.max(axis=1) > 0
    positive = (toxic == 1) & some
    w, b = np.zeros(len(names)), 0.0
    for _ in range(5):  # sentences of toxic texts that look clean count as clean, but for each text's most toxic one
        hits = np.flatnonzero(positive & (v.max(axis=1) > 0.9))
        hits = hits[rng.permutation(len(hits))[:500]]
        bent = [marks.value(_perturbed(names[int(v[k].argmax())], rng)) for k in hits]
        more = np.array([value for value in bent if value is not None]).reshape(-1, len(names)) @ whiten
        use = positive | (toxic == 0)
        xs = np.concatenate([x[use], more])
        ys = np.concatenate([np.where(positive[use], 1.0, -1.0), np.ones(len(more))])
        cost = np.where(ys > 0, 1 / max(1, (ys > 0).sum()), 1 / max(1, (ys < 0).sum()))
        w, b = _svm(xs, ys, cost)
        score = x @ w + b
        order = np.lexsort((score, ids))
        best = np.zeros(len(v), bool)
        best[order[np.append(np.flatnonzero(np.diff(ids[order])), len(order) - 1)]] = True
        now = (toxic == 1) & some & ((score > 0) | best)
        if (now == positive).all():
            break
        positive = now
    weight = whiten @ w
    starts = np.flatnonzero(np.append(True, np.diff(ids) > 0))
    summary = [_summary(m, n, b) for m, n in zip(np.split(v @ weight, starts[1:]), size[starts], strict=True)]
    return Model(names, weight.tolist(), b, _logistic(np.array(summary), toxic[starts].astype(float)), float(toxic[starts].mean()))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted of every row."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = Landmarks(model.landmarks)
        for batch in batches:
            value = model.score([t or "" for t in batch.column(1).to_pylist()], marks)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(value, pa.float64()), pa.array((value >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(of, "doc_id long, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """doc_id, held_out, score, predicted: fitted on labelled rows that are not held out."""
    fitted = fit(docs, labels.where(~held_out()), **how)
    out = score(docs, fitted)
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted")
