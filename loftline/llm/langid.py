"""Language identification by nearest centroid (operator 3).

Texts become normalised TF-IDF vectors of hashed byte n-grams (one to three
letters, white space and marks folded to one boundary).  Each language has a few
centroids, clustered by spherical k-means, and a text takes the language of the
centroid with the largest cosine.  A text farther from its centroid than all but
a ``LOST`` share of clean texts of its language and length is rejected.  These
distances are of texts held out: each fold of the sample, cut to several lengths,
is measured against centroids of the other folds.

The classifier is fitted on a sample of labelled rows whose size is bounded by
``SAMPLE_PER_LANGUAGE`` (in expectation; rows are chosen by a hash of their id).
Its size is fixed by ``DIMENSIONS`` and the number of languages.

Defined results: a text that is null or has no letter is ``und`` with score 0
and rejected.  Rows with a null id are never held out nor learned from.  Ties go
to the language that sorts first.  Without labelled rows every text is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loftline.llm.kernels import text_blocks, utf8_view
from loftline.llm.store import attach, give_back, lean

DIMENSIONS = 4096
SAMPLE_PER_LANGUAGE = 500
CENTROIDS = 4
#: Share of clean texts that may be rejected.
LOST = 0.005
FOLDS = 4
#: Letters (bytes) at which the cosine to reach is measured; between them it is interpolated.
LENGTHS = np.array([2, 8, 32, 128, 512, 2048, 8192])
#: Bytes of a sampled text that are cut to these lengths.
HEAD = 1 << 15
UNKNOWN = "und"
_ROWS = 256

_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_FOLD[0x80:] = np.arange(0x80, 0x100)


def _hash(a: np.ndarray) -> np.ndarray:
    return ((a * np.uint32(0x9E3779B1)) >> np.uint32(32 - DIMENSIONS.bit_length() + 1)).astype(np.int64)


def gram_counts(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Counts of hashed n-grams, a row for each text; grams never cross texts."""
    n = len(offs) - 1
    out = np.zeros(n * DIMENSIONS, np.float32)
    if not len(buf):
        return out.reshape(n, DIMENSIONS)
    b = _FOLD[buf].astype(np.uint32)
    row = np.repeat(np.arange(n, dtype=np.int64) * DIMENSIONS, np.diff(offs))
    last = np.zeros(len(b), bool)
    last[offs[1:][offs[1:] > offs[:-1]] - 1] = True
    blank = b == 0x20
    with np.errstate(over="ignore"):
        out += np.bincount((row + _hash(b + np.uint32(1)))[~blank], minlength=len(out)).astype(np.float32)
        if len(b) > 1:
            two, keep = (b[:-1] << np.uint32(8)) + b[1:] + np.uint32(1 << 20), ~last[:-1] & ~(blank[:-1] & blank[1:])
            out += np.bincount((row[:-1] + _hash(two))[keep], minlength=len(out)).astype(np.float32)
        if len(b) > 2:
            three, keep = (b[:-2] << np.uint32(16)) + (b[1:-1] << np.uint32(8)) + b[2:] + np.uint32(1 << 30), keep[:-1] & ~last[1:-1] & ~(blank[1:-1] & (blank[:-2] | blank[2:]))
            out += np.bincount((row[:-2] + _hash(three))[keep], minlength=len(out)).astype(np.float32)
    return out.reshape(n, DIMENSIONS)


def unit_vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Sublinear TF times IDF, to length one."""
    v = np.log1p(counts) * idf
    size = np.sqrt((v * v).sum(1, keepdims=True))
    return v / np.where(size > 0, size, 1)


def has_letter(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    ascii_letter = ((buf | 0x20) >= 0x61) & ((buf | 0x20) <= 0x7A)
    upto = np.concatenate([[0], np.cumsum(ascii_letter)])
    out = upto[offs[1:]] > upto[offs[:-1]]
    for row in np.flatnonzero(~out & (np.diff(offs) > 0)).tolist():
        out[row] = any(c.isalpha() for c in buf[offs[row] : offs[row + 1]].tobytes().decode())
    return out


def letters(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Bytes of each text that are no boundary."""
    upto = np.concatenate([[0], np.cumsum(_FOLD[buf] != 0x20)])
    return upto[offs[1:]] - upto[offs[:-1]]


@dataclass
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    floor: np.ndarray

    def predict(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language number (-1 for none), cosine and whether it is rejected."""
        lang, score, out = [], [], []
        for at in range(0, len(offs) - 1, _ROWS):
            part = offs[at : at + _ROWS + 1]
            some, edges = buf[part[0] : part[-1]], part - part[0]
            if not self.languages:
                lang.append(np.full(len(edges) - 1, -1))
                score.append(np.zeros(len(edges) - 1))
                out.append(np.ones(len(edges) - 1, bool))
                continue
            near = unit_vectors(gram_counts(some, edges), self.idf) @ self.centroids.T
            best = near.argmax(1)
            top = np.clip(near[np.arange(len(best)), best].astype(np.float64), 0, 1)
            which, none = self.owner[best], ~has_letter(some, edges)
            lang.append(np.where(none, -1, which))
            score.append(np.where(none, 0.0, top))
            out.append(none | (top < self.least(which, letters(some, edges))))
        cat = lambda parts: np.concatenate(parts) if parts else np.zeros(0)
        return cat(lang), cat(score), cat(out)


    def least(self, which: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The cosine that a text of a language and a number of letters must reach."""
        out, at = np.zeros(len(which)), np.log2(np.maximum(size, 1))
        for k in np.unique(which).tolist():
            out[which == k] = np.interp(at[which == k], np.log2(LENGTHS), self.floor[k])
        return out


def in_training(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 != 1, F.lit(False))


def _clusters(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; the first centre is the mean, later ones the farthest texts."""
    centres = [x.mean(0)]
    for _ in range(min(k, len(x)) - 1):
        centres.append(x[np.max(x @ np.array(centres).T, axis=1).argmin()])
    c = np.array(centres)
    for _ in range(rounds):
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        near = (x @ c.T).argmax(1)
        c = np.array([x[near == j].mean(0) if (near == j).any() else c[j] for j in range(len(c))])
    return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)


def _floors(x: np.ndarray, langs: np.ndarray, heads: list[bytes], names: list[str], idf: np.ndarray, centroids: int) -> np.ndarray:
    """The least cosines, a row for each language and a column for each of ``LENGTHS``."""
    fold = np.zeros(len(x), int)
    for name in names:
        fold[langs == name] = np.arange(np.count_nonzero(langs == name)) % FOLDS
    models = []
    for f in range(FOLDS):
        learned = {n: some for n in names if (some := (langs == n) & (fold != f)).any()}
        parts = {n: _clusters(x[some], centroids) for n, some in learned.items()}
        models.append((np.concatenate(list(parts.values())), np.concatenate([np.full(len(c), names.index(n)) for n, c in parts.items()])) if parts else None)
    inked = [np.flatnonzero(_FOLD[np.frombuffer(h, np.uint8)] != 0x20) for h in heads]
    out = np.zeros((len(names), len(LENGTHS)))
    for j, n in enumerate(LENGTHS.tolist()):
        score: list[list[float]] = [[] for _ in names]
        for f, model in enumerate(models):
            rows = [k for k in np.flatnonzero(fold == f).tolist() if len(inked[k]) >= n]
            for at in range(0, len(rows) if model else 0, _ROWS):
                cut = [heads[k][: inked[k][n - 1] + 1] for k in rows[at : at + _ROWS]]
                offs = np.concatenate([[0], np.cumsum([len(c) for c in cut])])
                near = unit_vectors(gram_counts(np.frombuffer(b"".join(cut), np.uint8), offs), idf) @ model[0].T
                for k, top in zip(model[1][near.argmax(1)].tolist(), near.max(1).tolist()):
                    score[k].append(top)
        for k, own in enumerate(score):
            if own:
                low, mid = np.quantile(own, [LOST, 0.5])
                # The fewer the texts, the less is known of how low clean ones go.
                out[k, j] = max(0.0, low - (mid - low) * 20 / len(own))
            elif j:
                out[k, j] = out[k, j - 1]
    return out


def fit(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, centroids: int = CENTROIDS) -> LanguageModel:
    """Fit on a bounded sample of the labelled training rows of ``docs`` (doc_id, text, lang)."""
    spark = docs.sparkSession
    attach(spark)
    labelled = docs.where(F.col("lang").isNotNull() & in_training(F.col("doc_id")))
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return LanguageModel([], np.zeros(0), np.zeros((0, DIMENSIONS)), np.zeros(0, int), np.zeros((0, len(LENGTHS))))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, int(min(1.0, per_language / n) * (1 << 30)))])
    sample = labelled.where(draw < share[F.col("lang")]).select("lang", F.col("text").cast("string").alias("text"))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, "text", 1 << 20):
            buf, offs = utf8_view(block["text"])
            counts = gram_counts(buf, offs)
            heads = [buf[a : min(b, a + HEAD)].tobytes() for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())]
            yield pa.RecordBatch.from_arrays([block["lang"].combine_chunks(), pa.array([r.astype("<f4").tobytes() for r in counts], pa.binary()), pa.array(heads, pa.binary())], ["lang", "counts", "head"])

    got = sample.mapInArrow(lean(vectors), "lang string, counts binary, head binary").toArrow()
    langs, heads = got["lang"].to_pylist(), got["head"].to_pylist()
    x = np.frombuffer(b"".join(got["counts"].to_pylist()), "<f4").reshape(-1, DIMENSIONS)
    # In one order, so that the folds don't depend on partitioning.
    order = [k for k in sorted(range(len(heads)), key=lambda k: (langs[k], heads[k])) if x[k].any()]
    if not order:
        return LanguageModel([], np.zeros(0), np.zeros((0, DIMENSIONS)), np.zeros(0, int), np.zeros((0, len(LENGTHS))))
    langs, heads, x = np.array(langs)[order], [heads[k] for k in order], x[order]
    del got
    idf = (np.log((1 + len(x)) / (1 + (x > 0).sum(0))) + 1).astype(np.float32)
    x = unit_vectors(x, idf)
    names = sorted(set(langs.tolist()))
    centres, owner = [], []
    for k, name in enumerate(names):
        own = x[langs == name]
        c = _clusters(own, centroids)
        centres.append(c)
        owner += [k] * len(c)
    model = LanguageModel(names, idf, np.concatenate(centres).astype(np.float32), np.array(owner), _floors(x, langs, heads, names, idf, centroids))
    # The sample is of no more use to the driver.
    del x, heads, own, centres
    give_back()
    return model


def predict(docs: DataFrame, model: LanguageModel, keep: list[str] | None = None) -> DataFrame:
    """``doc_id`` (or the columns ``keep``), ``lang_pred``, ``score`` and ``rejected``."""
    spark = docs.sparkSession
    attach(spark)
    shared = spark.sparkContext.broadcast(model)
    keep = ["doc_id"] if keep is None else keep
    rows = docs.select(*keep, F.col("text").cast("string").alias("_text"))

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array([*m.languages, UNKNOWN], dtype=object)
        for block in text_blocks(batches, "_text", 4 << 20):
            lang, score, rejected = m.predict(*utf8_view(block["_text"]))
            columns = [block[c].combine_chunks() for c in keep]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(names[lang.astype(int)].tolist(), pa.string()), pa.array(score), pa.array(rejected)], [*keep, "lang_pred", "score", "rejected"])

    schema = ", ".join(f"`{n}` {t}" for n, t in rows.drop("_text").dtypes)
    return rows.mapInArrow(lean(classify), f"{schema}, lang_pred string, score double, rejected boolean")


def accepted(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """The documents whose language isn't rejected, with their own columns."""
    names = docs.columns
    inner = docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)], F.col("text"))
    kept = predict(inner, model, [f"c{k}" for k in range(len(names))]).where(~F.col("rejected"))
    return kept.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(names)])
