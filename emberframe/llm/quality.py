"""Quality by co-training: a text-content view and a metadata view teach each other.

Each view has a logistic classifier. In every round each view labels the pool documents it is most
certain of, in the proportion of the classes, and the *other* view learns from them. At the end both
views are calibrated (Platt scaling) on labelled documents that neither has trained on, and a small
logistic model on the two calibrated log-odds, fitted on the same documents, gives the score.

Training reads bounded samples, chosen by a hash of the id: ``labelled`` documents with a label
and ``pool`` without. Every document is scored, whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberframe.llm.workspace import Workspace, doc_rows, ship

WORD_SLOTS, SHAPES = 1024, 24
META_SLOTS = 256
_ODD = re.compile(r"[^\w\s.,;:!?'\"()-]{2,}|[!?]{2,}")
_SLOT: dict[str, int] = {}


def text_view(text: str | None) -> np.ndarray:
    """Shares of the words that fall into hash slots (square roots), and the text's shape."""
    out = np.zeros(WORD_SLOTS + SHAPES, np.float32)
    words = (text or "").split()
    if not words:
        out[-1] = 1
        return out
    if len(_SLOT) > 150_000:
        _SLOT.clear()
    known, digest, slots = _SLOT, xxhash.xxh32_intdigest, []
    for w in words:
        s = known.get(w)
        if s is None:
            s = known[w] = digest(w.lower().strip(".,;:!?").encode("utf-8", "surrogatepass"), 5) % WORD_SLOTS
        slots.append(s)
    out[:WORD_SLOTS] = np.sqrt(np.bincount(slots, minlength=WORD_SLOTS) / len(words))
    n, lines = len(text), [x for x in text.split("\n") if x.strip()]
    upper, digits = sum(map(str.isupper, words)) / len(words), sum(c.isdigit() for c in text) / n
    marks, odd = len(re.findall(r"[^\w\s]", text)) / n, len(_ODD.findall(text)) / len(words)
    distinct, repeated = len(set(words)) / len(words), 1 - len(set(lines)) / max(1, len(lines))
    longest, mean = max(map(len, words)), n / len(words)
    bare = sum(not any(c.isalnum() for c in w) for w in words) / len(words)
    stops = sum(w[-1] in ".!?" for w in words) / len(words)
    shape = [min(1, upper), min(1, digits * 5), min(1, marks * 4), min(1, odd), distinct, repeated, min(1, longest / 60), min(1, mean / 12), min(1, bare * 2), min(1, stops * 4), min(1, np.log1p(len(words)) / 10), min(1, np.log1p(len(lines)) / 8)]
    out[WORD_SLOTS : WORD_SLOTS + len(shape)] = shape
    out[WORD_SLOTS + 12 : WORD_SLOTS + 12 + 7] = [upper > 0.3, odd > 0.2, marks > 0.15, bare > 0.15, repeated > 0.2, distinct < 0.3, len(words) < 5]
    out[-1] = 1
    return out


def meta_view(source: str | None, lang: str | None, chars: int) -> np.ndarray:
    """Hash slots of source and language, and the size's octave."""
    out = np.zeros(META_SLOTS, np.float32)
    out[xxhash.xxh32_intdigest(f"s{source}") % 160] = 1
    out[160 + xxhash.xxh32_intdigest(f"l{lang}") % 60] = 1
    out[220 + min(30, int(chars).bit_length())] = 1
    out[-1] = 1
    return out


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1e-3, rounds: int = 200) -> np.ndarray:
    """Weights by accelerated gradient steps; classes and rows may be weighted."""
    weight = np.ones(len(y)) if weight is None else weight
    x, y, weight = x.astype(np.float32), y.astype(np.float32), (weight / weight.sum()).astype(np.float32)
    step = np.float32(1.0 / (0.25 * float((weight * (x * x).sum(1)).sum()) + ridge))
    w = v = np.zeros(x.shape[1], np.float32)
    for i in range(rounds):
        p = 1 / (1 + np.exp(-(x @ v)))
        nxt = v - step * (x.T @ (weight * (p - y)) + np.float32(ridge) * v)
        v, w = nxt + np.float32(i / (i + 3)) * (nxt - w), nxt
    return w


def platt(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Slope and shift that calibrate log-odds."""
    return logistic(np.stack([z, np.ones(len(z))], 1), y, ridge=1e-4, rounds=400)


@dataclass
class Model:
    text: np.ndarray
    meta: np.ndarray
    text_platt: np.ndarray
    meta_platt: np.ndarray
    both: np.ndarray
    rounds: list = field(default_factory=list)

    def views(self, xt: np.ndarray, xm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Calibrated log-odds of each view."""
        a, b = self.text_platt, self.meta_platt
        return a[0] * (xt @ self.text) + a[1], b[0] * (xm @ self.meta) + b[1]

    def scores(self, xt: np.ndarray, xm: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        t, m = self.views(xt, xm)
        s = self.both[0] * t + self.both[1] * m + self.both[2]
        return tuple(1 / (1 + np.exp(-np.clip(z, -60, 60))) for z in (t, m, s))


def cotrain(xt: np.ndarray, xm: np.ndarray, y: np.ndarray, pool_t: np.ndarray, pool_m: np.ndarray, rounds: int = 5, share: float = 0.08) -> Model:
    """Rounds of exchange; ``share`` of the pool goes to the other view in a round, most certain first."""
    held = np.arange(len(y)) % 4 == 0
    yt = y[~held].astype(float)
    seen_t, seen_m = [(xt[~held], yt)], [(xm[~held], yt)]
    free = {"t": np.ones(len(pool_t), bool), "m": np.ones(len(pool_m), bool)}
    log, base = [], float(yt.mean())

    def fit(parts: list) -> np.ndarray:
        x, t = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        w = np.concatenate([np.full(len(p[1]), 1.0 if i == 0 else 0.3) for i, p in enumerate(parts)])
        return logistic(x, t, w)

    wt, wm = fit(seen_t), fit(seen_m)
    for _ in range(rounds):
        k = int(share * len(pool_t))
        if not k:
            break
        for mine, x_mine, to, x_other, key in ((wt, pool_t, seen_m, pool_m, "m"), (wm, pool_m, seen_t, pool_t, "t")):
            z = x_mine @ mine
            for sign, n in ((1, round(k * base)), (-1, k - round(k * base))):
                order = np.argsort(-sign * z, kind="stable")
                pick = [i for i in order if free[key][i] and sign * z[i] > 0][:n]
                free[key][pick] = False
                if pick:
                    to.append((x_other[pick], np.full(len(pick), float(sign > 0))))
        wt, wm = fit(seen_t), fit(seen_m)
        log.append((sum(len(p[1]) for p in seen_t), sum(len(p[1]) for p in seen_m)))
    yh = y[held].astype(float)
    model = Model(wt, wm, platt(xt[held] @ wt, yh), platt(xm[held] @ wm, yh), np.array([1.0, 0.0, 0.0]), log)
    t, m = model.views(xt[held], xm[held])
    model.both = logistic(np.stack([t, m, np.ones(len(t))], 1), yh, ridge=1e-3, rounds=400)
    return model


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text, source, lang, y = (batch.column(i) for i in range(4))
        views = [(text_view(t.as_py()), meta_view(s.as_py(), g.as_py(), len(t.as_py() or ""))) for t, s, g in zip(text, source, lang, strict=True)]
        pack = lambda i: pa.array([v[i].astype(np.float16).tobytes() for v in views], pa.binary())  # noqa: E731, B023
        yield pa.RecordBatch.from_arrays([pack(0), pack(1), y], names=["t", "m", "y"])


def fit(docs: DataFrame, labels: DataFrame, labelled: int = 6000, pool: int = 6000, rounds: int = 5) -> Model | None:
    """Trains on samples of labelled documents and of others. None if the labels hold no two classes.

    A document with several labels takes the lowest. The labelled sample is sent to all tasks
    (at most about ``labelled`` ids), so that documents are read in one pass. Rows are drawn, not ids: of the rows that share a drawn
    id one is taken, and others are drawn one by one, so what reaches the driver is bounded however often an id stands.
    """
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("y"))
    n, total = known.count(), docs.count()
    if not n:
        return None
    draw = lambda name, share: F.pmod(F.xxhash64(F.lit(name), "doc_id"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, share)) + 1
    rows = doc_rows(docs, "source", "lang").where("doc_id is not null")
    some = known.where(draw("labelled", labelled / n)).limit(2 * labelled)
    drawn = rows.join(F.broadcast(some), "doc_id").withColumn("h", F.xxhash64("text", "source", "lang"))
    mine = drawn.groupBy("doc_id").agg(F.min_by(F.struct("text", "source", "lang", "y"), "h").alias("r")).select("r.*")
    others = rows.where(F.rand(6) < (min(1.0, pool / (total - n)) if total > n else 1.0)).join(known.select("doc_id"), "doc_id", "left_anti")
    both = mine.unionByName(others.select("text", "source", "lang", F.lit(None).cast("int").alias("y")))
    sample = Workspace(docs.sparkSession, "quality").save(both.mapInArrow(_features, "t binary, m binary, y int"), "sample")
    got = sorted(((r["y"], bytes(r["t"]), bytes(r["m"])) for r in sample.toLocalIterator()), key=lambda r: (-1 if r[0] is None else r[0], xxhash.xxh64_intdigest(r[1] + r[2])))
    matrix = lambda part, i: np.stack([np.frombuffer(r[i], np.float16) for r in part]).astype(np.float32)
    lab, free = [r for r in got if r[0] is not None], [r for r in got if r[0] is None]
    lab.sort(key=lambda r: xxhash.xxh64_intdigest(r[1] + r[2]))
    if len({r[0] for r in lab}) < 2:
        return None
    pool_t, pool_m = (matrix(free, 1), matrix(free, 2)) if free else (np.zeros((0, WORD_SLOTS + SHAPES)), np.zeros((0, META_SLOTS)))
    return cotrain(matrix(lab, 1), matrix(lab, 2), np.array([r[0] > 0 for r in lab]), pool_t, pool_m, rounds)


def score(docs: DataFrame, model: Model | None, threshold: float = 0.5) -> DataFrame:
    """doc_id, text_score, meta_score, score (all calibrated, 0 to 1) and keep (score >= threshold) of every row.

    Null and empty texts are judged by the shape of an empty text; null source and language are
    values of their own. Without a model all scores are null and everything is kept. Rows that repeat an id are
    scored each; extra columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "text_score", "meta_score", "score", "keep"]
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                if sent.value is None:
                    got = [pa.nulls(part.num_rows, pa.float64())] * 3 + [pa.array([True] * part.num_rows)]
                else:
                    texts = [t.as_py() for t in part.column(1)]
                    xt = np.stack([text_view(t) for t in texts])
                    xm = np.stack([meta_view(s.as_py(), g.as_py(), len(t or "")) for s, g, t in zip(part.column(2), part.column(3), texts, strict=True)])
                    scores = sent.value.scores(xt, xm)
                    got = [*(pa.array(s.astype(np.float64)) for s in scores), pa.array(scores[2] >= threshold)]
                yield pa.RecordBatch.from_arrays([part.column(0), *got], names=names)

    return doc_rows(docs, "source", "lang").mapInArrow(run, "doc_id long, text_score double, meta_score double, score double, keep boolean")
