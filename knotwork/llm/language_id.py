"""Language identification: multinomial naive Bayes over hashed character n-grams, scored in sparse batches."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, written
from .memory import tidy

#: Buckets of the hashed n-grams, their longest n, and the smoothing of counts.
BUCKETS, N, ALPHA = 1 << 15, 3, 0.5
#: About so many documents of each language are learned from, chosen by a hash of their ids.
PER_LANGUAGE = 10_000
#: Characters scored at once. Of a longer text parts of this size are scored, each with the n-grams that leave it.
SLICE = 1 << 19
#: Languages that a model may have, each of 128 KB; more make an error.
MOST_LANGUAGES = 2000
#: Standard errors below the mean of a language's own texts at which a text is unlike the language.
UNLIKE = 8.0
MULTIPLIER = np.uint32(0x9E3779B1)


@cache
def letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts, case folded, whatever isn't a letter as one space, also at both ends; where each text
    starts; and which texts have letters."""
    joined = "".join(f" {t} " for t in texts).lower()
    if len(joined) != sum(map(len, texts)) + 2 * len(texts):  # lower() made some text longer
        lowered = [t.lower() for t in texts]
        joined, texts = "".join(f" {t} " for t in lowered), lowered
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.concatenate([[0], np.cumsum([len(t) + 2 for t in texts])])
    letter = letters()[code]
    keep = letter | np.concatenate([[True], letter[:-1]])
    keep[starts[:-1]] = True
    has = np.add.reduceat(letter.astype(np.int64), starts[:-1]) > 0
    starts = np.concatenate([[0], np.cumsum(np.add.reduceat(keep.astype(np.int64), starts[:-1]))])
    return np.where(letter, code, np.uint32(32))[keep], starts, has


def grams(code: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Hashed n-grams, one row for each n and a column for each character, BUCKETS where one would leave its text."""
    left = np.repeat(starts[1:], np.diff(starts)) - np.arange(len(code))
    out, h = np.empty((N, len(code)), np.int32), np.zeros(len(code), np.uint32)
    for n in range(N):
        shifted = np.concatenate([code[n:], np.zeros(min(n, len(code)), np.uint32)])
        h = (h ^ (shifted + np.uint32(n))) * MULTIPLIER
        out[n] = np.where(left > n, (h ^ (h >> np.uint32(15))) % np.uint32(BUCKETS), BUCKETS)
    return out


def features(texts: list[str]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray, np.ndarray]]:
    """N-grams of the texts in groups of about SLICE characters, of longer texts in parts: the number of each part's
    text, the n-grams, where each part starts, and which have letters."""

    def short(of: list[int], group: list[str]):
        code, starts, has = codes(group)
        return of, grams(code, starts), starts[:-1], has

    of, group, size = [], [], 0
    for i, t in enumerate(texts):
        if len(t) > SLICE:
            cuts = [0]
            while cuts[-1] < len(t):  # at a space if there is one, as cases may depend on what follows
                at = t.rfind(" ", cuts[-1] + 1, cuts[-1] + SLICE) if cuts[-1] + SLICE < len(t) else len(t)
                cuts.append(at if at > 0 else cuts[-1] + SLICE)
            parts = [codes([t[a:b]]) for a, b in zip(cuts, cuts[1:])]
            ends = [t[b - 1].isalpha() and t[b].isalpha() for b in cuts[1:-1]]  # no space where a word is cut
            code = np.concatenate([p[0][k > 0 and ends[k - 1] : len(p[0]) - (k < len(ends) and ends[k])] for k, p in enumerate(parts)])
            code = code[np.concatenate([[True], (code[1:] != 32) | (code[:-1] != 32)])]
            for at in range(0, len(code), SLICE):
                part = code[at : at + SLICE + N - 1]
                yield [i], grams(part, np.array([0, len(part)]))[:, :SLICE], np.zeros(1, np.int64), np.array([any(p[2][0] for p in parts)])
            continue
        of.append(i)
        group.append(t)
        size += len(t)
        if size >= SLICE:
            yield short(of, group)
            of, group, size = [], [], 0
    if group:
        yield short(of, group)


@tidy
def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for b in batches:
        langs = b.column("lang").to_pylist()
        for of, found, starts, _ in features(b.column("text").to_pylist()):
            for lang in {langs[i] for i in of}:
                mine = np.repeat([langs[i] == lang for i in of], np.diff(np.append(starts, found.shape[1])))
                counts.setdefault(lang, np.zeros(BUCKETS + 1, np.int64))
                counts[lang] += np.bincount(found[:, mine].ravel(), minlength=BUCKETS + 1)
    for lang, c in counts.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([c[:-1].tobytes()], pa.binary())], names=["lang", "counts"])


def _add(f: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(BUCKETS, np.int64)
    for c in f["counts"]:
        total += np.frombuffer(c, np.int64)
    return pd.DataFrame({"lang": [f["lang"].iloc[0]], "counts": [total.tobytes()]})


class Model(NamedTuple):
    """Languages; log probabilities of buckets, a column for each language, and of the languages; and of each language
    the mean log probability of an n-gram in its own texts, its spread for one n-gram, their mean n-grams, and the mean
    log probability of an n-gram in other languages' texts."""

    langs: list[str]
    table: np.ndarray
    prior: np.ndarray
    own: np.ndarray


def train(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """The model from rows (doc_id, text, lang) without nulls.

    Learns from a bounded sample: about ``per_language`` whole documents of each language, those with the smallest
    hashes of their ids; the languages' shares are those of all rows. The model is one number for each bucket and
    language, whatever the input's size; more than ``MOST_LANGUAGES`` languages are an error.
    """
    small_batches(labelled.sparkSession)
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()}
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    nothing = np.zeros((BUCKETS + 1, 0), np.float32)
    if not sizes:
        return Model([], nothing, np.zeros(0), np.zeros((0, 4)))
    share = F.create_map(*(F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, per_language / n))))
    chosen = labelled.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20)).select("text", "lang")
    rows = written(chosen.mapInArrow(_count, "lang string, counts binary"), "language-counts").groupBy("lang").applyInPandas(_add, "lang string, counts binary").collect()
    langs = sorted(r["lang"] for r in rows)
    if not langs:
        return Model([], nothing, np.zeros(0), np.zeros((0, 4)))
    counts = np.array([np.frombuffer(next(r["counts"] for r in rows if r["lang"] == lang), np.int64) for lang in langs], np.float64) + ALPHA
    table = np.zeros((BUCKETS + 1, len(langs)), np.float32)
    table[:-1] = np.log(counts / counts.sum(1, keepdims=True)).T
    n = np.array([sizes[lang] for lang in langs], float)
    model = Model(langs, table, np.log(n / n.sum()), np.zeros((len(langs), 4)))
    spread = chosen.mapInArrow(_spread(labelled.sparkSession.sparkContext.broadcast(model)), "lang string, n double, texts double, ll double, square double, other_n double, other_ll double")
    sums = {r["lang"]: r for r in spread.groupBy("lang").agg(*(F.sum(c).alias(c) for c in ("n", "texts", "ll", "square", "other_n", "other_ll"))).collect()}
    for i, lang in enumerate(langs):
        s = sums.get(lang)
        if s and s["n"]:
            mean = s["ll"] / s["n"]
            # the mean over texts of n (own mean - mean)^2, from sums of ll^2 / n, ll and n
            model.own[i] = mean, max(0.0, (s["square"] - 2 * mean * s["ll"] + mean * mean * s["n"]) / s["texts"]) ** 0.5, s["n"] / s["texts"], s["other_ll"] / s["other_n"] if s["other_n"] else np.inf
    return model


def scored(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The summed log probabilities of each text's n-grams for each language, their number, and whether it has letters."""
    total, size, has = np.zeros((len(texts), max(1, table.shape[1]))), np.zeros(len(texts)), np.zeros(len(texts), bool)
    for of, found, starts, some in features(texts):
        if table.shape[1]:
            s = table[found[0]]
            for g in found[1:]:
                s += table[g]
            np.add.at(total, of, np.add.reduceat(s, starts, axis=0, dtype=np.float64))
        np.add.at(size, of, np.add.reduceat((found < BUCKETS).sum(0), starts))
        np.logical_or.at(has, of, some)
    return total, size, has


def _spread(model):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, table, _, _ = model.value
        sums = np.zeros((len(langs), 6))
        for b in batches:
            total, n, has = scored(b.column("text").to_pylist(), table)
            at = np.array([langs.index(x) for x in b.column("lang").to_pylist()], int)
            ll = total[np.arange(len(at)), at]
            np.add.at(sums, (at[has], slice(0, 4)), np.stack([n, np.ones(len(n)), ll, ll * ll / np.maximum(n, 1)], 1)[has])
            other = has[:, None] & (at[:, None] != np.arange(len(langs)))
            sums[:, 4] += (n[:, None] * other).sum(0)
            sums[:, 5] += np.where(other, total, 0).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), *(pa.array(c) for c in sums.T)], names=["lang", "n", "texts", "ll", "square", "other_n", "other_ll"])

    return run


def predicted(texts: list[str], model: Model) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The language and the score of each text, and how many standard errors it lies below the language's own texts; 0
    where it fits the language better than other languages' texts do, as one of several languages does."""
    total, n, has = scored(texts, model.table)
    known = has & bool(model.langs)
    if not model.langs:
        return ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
    joint = total + model.prior
    best = joint.argmax(1)
    score = 1 / np.exp(joint - joint.max(1, keepdims=True)).sum(1)
    mean, spread, usual, other = model.own[best].T
    own = total[np.arange(len(best)), best] / np.maximum(n, 1)
    below = (own < other) * (mean - own) * np.sqrt(np.minimum(n, usual)) / np.maximum(spread, 1e-9)
    return [model.langs[k] if ok else "und" for k, ok in zip(best.tolist(), known.tolist())], np.where(known, score, 0.0), np.where(known, below, 0.0)


def _score(model):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pred, score, _ = predicted(b.column("text").to_pylist(), model.value)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(pred, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def _keep(model, least_score: float, unlike: float):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pred, score, below = predicted([t or "" for t in b.column("text").to_pylist()], model.value)
            yield b.filter(pa.array([p != "und" and s >= least_score and u <= unlike for p, s, u in zip(pred, score.tolist(), below.tolist())], pa.bool_()))

    return run


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of each row of ``docs`` (doc_id, text, lang).

    Learns from documents that aren't held out (crc32 of the id as text, modulo 3, is 1) and have text and language.
    ``score`` is the posterior probability of the prediction, with the languages' shares as priors; of equal ones the first language in alphabetical order
    counts. Null text or text without letters, or nothing to learn from: ``und`` and 0. Null doc_ids aren't held out.
    Repeated rows: a row each. No rows: no rows. Other columns are ignored.
    """
    own, model = _learned(docs)
    return own.select("doc_id", "held_out", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_score(model), "doc_id bigint, held_out boolean, lang_pred string, score double")


def _learned(docs: DataFrame):
    spark = docs.sparkSession
    small_batches(spark)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    return own, spark.sparkContext.broadcast(train(own.filter("not held_out and text is not null and lang is not null and doc_id is not null").select("doc_id", "text", "lang")))


def known(docs: DataFrame, least_score: float = 0.5, unlike: float = UNLIKE) -> DataFrame:
    """The rows of ``docs`` whose language is told with a score of at least ``least_score`` and whose n-grams are, on the
    mean, no more than ``unlike`` standard errors less probable than those of the language's own texts; all columns are
    kept. A text that fits the language better than other languages' texts do stays. Rows without text or letters go, as do all if there is nothing to learn from. Null doc_ids and repeated rows
    are judged as any other. No rows: no rows."""
    return docs.mapInArrow(_keep(_learned(docs)[1], least_score, unlike), docs.schema)
