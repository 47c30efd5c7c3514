"""Secret scans: fixed patterns, and a battery of randomness tests with length-aware false-discovery control."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts, written
from .memory import tidy

#: The base patterns, and the least length of what counts.
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "random")
#: A run that may be an encoded secret, its parts if it mixes base64 and base64url, and the alphabets that are tried,
#: smallest first.
RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}(?![A-Za-z0-9+/_-])")
PARTS = (re.compile(r"[A-Za-z0-9_-]{16,}={0,2}"), re.compile(r"[A-Za-z0-9+/]{16,}={0,2}"))
ALPHABETS = {
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "BASE36": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base62": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "+/0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64url": "-0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz",
}
NUMBER = {name: i for i, name in enumerate(ALPHABETS)}
INDEX = {name: ({c: i for i, c in enumerate(a)}, frozenset(a)) for name, a in ALPHABETS.items()}
#: The level of false discoveries among what is reported, the least p of the battery of what is, the greatest of what is
#: surely text, bins of -log10 p, and runs drawn from the model of text for each group, of that length at most.
LEVEL, LEAST_P, SURE_P, BINS, PER_DECADE, DRAWN, LONGEST = 0.05, 0.01, 1e-4, 400, 20, 4000, 256
#: The characters of runs, whose succession in a corpus is the model of text: that in runs of an alphabet which the battery
#: tells from random ones, then that in all text, then how often each stands anywhere, each a prior of this weight, in
#: characters, to the one before.
RUN_CHARACTERS = ALPHABETS["base64"] + "-_"
PRIOR = 5.0
REDACTED = "[secret]"
FOUND = "start int, end int, kind string, test string, p_bin int"
SCAN = f"doc_id bigint, found array<struct<{FOUND.replace(' ', ':').replace(',:', ',')}>>, pair int, times bigint"


def upper_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def battery(text: str, encoding: str) -> float:
    """The probability that a uniformly random string of this alphabet looks as uneven as ``text``: the least p of
    three tests, times three. The tests: chi-squared of the characters' counts, runs of the alphabet's halves, serial
    correlation."""
    index, k = INDEX[encoding][0], len(ALPHABETS[encoding])
    x = [index[c] for c in text]
    n = len(x)
    counts = np.bincount(x, minlength=k)
    chi = float(((counts - n / k) ** 2).sum() * k / n)
    v = 2 / (9 * (k - 1))
    ps = [upper_tail(((chi / (k - 1)) ** (1 / 3) - (1 - v)) / math.sqrt(v))]
    high = [i >= k / 2 for i in x]
    a = sum(high)
    b = n - a
    if a and b:
        runs, mean = 1 + sum(p != q for p, q in zip(high, high[1:])), 1 + 2 * a * b / n
        var = (mean - 1) * (mean - 2) / (n - 1)
        ps.append(2 * upper_tail(abs(runs - mean) / math.sqrt(var)) if var > 0 else 1.0)
    else:
        ps.append(2.0 ** (1 - n))
    c = np.array(x) - np.mean(x)
    ss = float((c * c).sum())
    ps.append(2 * upper_tail(abs(float((c[1:] * c[:-1]).sum()) / ss) * math.sqrt(n)) if ss else 0.0)
    return min(1.0, 3 * min(ps))


_battery = lru_cache(50_000)(battery)


def battery_of_rows(x: np.ndarray, k: int) -> np.ndarray:
    """``battery`` of each row of an array of positions in an alphabet of ``k``."""
    rows, n = x.shape
    counts = np.bincount((x + np.arange(rows)[:, None] * k).ravel(), minlength=rows * k).reshape(rows, k)
    tail = np.vectorize(upper_tail)
    chi = ((counts - n / k) ** 2).sum(1) * k / n
    v = 2 / (9 * (k - 1))
    p_chi = tail(((chi / (k - 1)) ** (1 / 3) - (1 - v)) / math.sqrt(v))
    high = x >= k / 2
    a = high.sum(1).astype(float)
    b = n - a
    both = (a > 0) & (b > 0)
    mean = 1 + 2 * a * b / n
    var = (mean - 1) * (mean - 2) / (n - 1)
    runs_ = 1 + (high[:, 1:] != high[:, :-1]).sum(1)
    p_runs = np.where(both, np.where(var > 0, 2 * tail(np.abs(runs_ - mean) / np.sqrt(np.where(var > 0, var, 1))), 1.0), 2.0 ** (1 - n))
    c = x - x.mean(1, keepdims=True)
    ss = (c * c).sum(1)
    p_serial = np.where(ss > 0, 2 * tail(np.abs((c[:, 1:] * c[:, :-1]).sum(1)) / np.where(ss > 0, ss, 1) * math.sqrt(n)), 0.0)
    return np.minimum(1.0, 3 * np.minimum(p_chi, np.minimum(p_runs, p_serial)))


def inferred(run: str) -> str | None:
    """The smallest alphabet that holds the whole run."""
    have = frozenset(run.rstrip("="))
    return next((name for name, (_, alphabet) in INDEX.items() if have <= alphabet), None)


def length_class(n: int) -> int:
    """Half octaves of length: strings of one class have about the same power."""
    return int(2 * math.log2(n))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def runs(text: str) -> Iterator[tuple[int, int]]:
    """Where runs lie. One that mixes the two alphabets (a token in a URL's path, say) is none of either: it is split
    at the characters of each in turn, so its parts may overlap."""
    for m in RUN.finditer(text):
        if ("+" in m[0] or "/" in m[0]) and ("-" in m[0] or "_" in m[0]):
            yield from sorted(p.span() for part in PARTS for p in part.finditer(text, *m.span()))
        else:
            yield m.span()


def p_bin(p: float) -> int:
    """The bin of a p; those of a higher bin are less like random text."""
    return min(BINS - 1, int(-math.log10(max(p, 1e-300)) * PER_DECADE))


def scanned(text: str) -> list[tuple[int, int, str, str | None, int | None]]:
    """Base spans, and runs outside them with their test group and the bin of their p."""
    base = base_spans(text)
    out = [(*s, None, None) for s in base]
    for start, end in runs(text):
        run = text[start:end]
        if (e := inferred(run)) and not any(s <= start and end <= t for s, t, _ in base):
            body = run.rstrip("=")
            out.append((start, end, "random", f"{e}-{length_class(len(body))}", p_bin(_battery(body, e))))
    return out


_PLACE = np.full(256, 255, np.uint8)
_PLACE[np.frombuffer(RUN_CHARACTERS.encode(), np.uint8)] = np.arange(len(RUN_CHARACTERS), dtype=np.uint8)


def successions(text: str) -> np.ndarray:
    """How often a character of runs follows each other one in ``text``."""
    k, out, data = len(RUN_CHARACTERS), np.zeros(len(RUN_CHARACTERS) ** 2, np.int64), np.frombuffer(text.encode(), np.uint8)
    for at in range(0, len(data), 1 << 20):
        x = _PLACE[data[at : at + (1 << 20) + 1]]
        both = (x[:-1] < k) & (x[1:] < k)
        out += np.bincount(x[:-1][both].astype(np.int32) * k + x[1:][both], minlength=k * k)
    return out


@tidy
def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of documents, and after them the task's counts of successions: of each alphabet in runs that are told from
    random ones, and of all text but base spans and the other runs."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("test", pa.string()), ("p_bin", pa.int32())]))
    names, counts = ("start", "end", "kind", "test", "p_bin"), np.zeros((len(ALPHABETS) + 1, len(RUN_CHARACTERS) ** 2), np.int64)

    def batch(ids, found, pair, times) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, kind), pa.array(pair, pa.int32()), pa.array(times, pa.int64())], names=["doc_id", "found", "pair", "times"])

    for b in batches:
        found = []
        for t in b.column("text").to_pylist():
            spans = scanned(t)
            found.append([dict(zip(names, s)) for s in spans])
            counts[-1] += successions(t)
            for start, end, _, test, bin_ in spans:
                if test is None or bin_ <= p_bin(SURE_P):
                    counts[-1] -= successions(t[start:end])
                else:
                    counts[NUMBER[test.rpartition("-")[0]]] += successions(t[start:end])
        yield batch(b.column("doc_id"), found, [None] * len(found), [None] * len(found))
    some = np.flatnonzero(counts > 0)
    yield batch([None] * len(some), [None] * len(some), some, counts.ravel()[some])


def drawn(successions: np.ndarray, encoding: str, n: int, seed: int = 0) -> np.ndarray:
    """Positions in an alphabet of ``DRAWN`` runs of ``n`` characters of text: a first-order chain with the corpus's
    own ``successions``, a row for each alphabet and one for all text."""
    place = [RUN_CHARACTERS.index(c) for c in ALPHABETS[encoding]]
    share = lambda x: x / np.maximum(x.sum(-1, keepdims=True), 1e-9)
    runs_, text = (successions[i].reshape(len(RUN_CHARACTERS), -1)[np.ix_(place, place)].astype(float) for i in (NUMBER[encoding], -1))
    often = share((runs_ + text).sum(0) + 1e-6)
    weight = runs_ + PRIOR * share(text + PRIOR * often)
    first, step = np.cumsum(weight.sum(1)), np.cumsum(weight / weight.sum(1, keepdims=True), axis=1)
    rng = np.random.default_rng(seed)
    x = np.empty((DRAWN, n), np.int64)
    x[:, 0] = np.minimum(np.searchsorted(first / first[-1], rng.random(DRAWN)), len(place) - 1)
    for i in range(1, n):
        x[:, i] = np.minimum((step[x[:, i - 1]] < rng.random(DRAWN)[:, None]).sum(1), len(place) - 1)
    return x


def text_tail(p: np.ndarray, bins: list[int]) -> dict[int, float]:
    """For each bin the share of text that looks as random, from the p of runs drawn: counted where it is common, and
    beyond that on a line through the hundredth and the tenth in normal deviates."""
    normal = NormalDist()
    z = np.sort([-normal.inv_cdf(min(max(x, 1e-300), 1 - 1e-9)) for x in p])
    rare = len(z) // 100
    low, high = float(z[rare]), float(z[len(z) // 10])
    slope = (normal.inv_cdf(0.1) - normal.inv_cdf(0.01)) / (high - low) if high > low else 1.0
    out = {}
    for b in bins:
        at = -normal.inv_cdf(min(max(10 ** (-(b + 1) / PER_DECADE), 1e-300), 1 - 1e-9))
        k = int(np.searchsorted(z, at, side="right"))
        out[b] = k / len(z) if k > rare else normal.cdf(normal.inv_cdf(0.01) + slope * (at - low))
    return out


def thresholds(histogram: list[tuple[str, int, int]], successions: np.ndarray, level: float = LEVEL) -> dict[str, int]:
    """Benjamini and Hochberg's step-up rule in each group of one alphabet and length class: the null hypothesis is that
    a run is text, its p the share of text of that alphabet and length that the battery finds as random. So the share of
    text among what is reported stays below ``level``, and short runs, of which little can be told, are reported only
    where random ones are common. Returns the bin from which on runs aren't reported. ``histogram``: group, bin, count."""
    groups: dict[str, dict[int, int]] = {}
    for g, b, n in histogram:
        groups.setdefault(g, {})[b] = n
    out = {}
    for g, bins in sorted(groups.items()):
        encoding, length = g.rsplit("-", 1)
        shortest = next(n for n in range(1, LONGEST + 1) if length_class(n) >= int(length) or n == LONGEST)
        tail = text_tail(battery_of_rows(drawn(successions, encoding, shortest), len(ALPHABETS[encoding])), sorted(bins))
        m, k, limit = sum(bins.values()), 0, 0
        for b in sorted(bins):
            k += bins[b]
            if tail[b] <= level * k / m and b <= p_bin(LEAST_P):
                limit = b + 1
        out[g] = limit
    return out


def _learned(seen: DataFrame) -> dict[str, int]:
    """The thresholds of a corpus, from what ``_scan`` gives: a count for each group and bin, and for each succession."""
    pairs = {r["pair"]: r["n"] for r in seen.filter("pair is not null").groupBy("pair").agg(F.sum("times").alias("n")).collect()}
    counts = np.zeros((len(ALPHABETS) + 1, len(RUN_CHARACTERS) ** 2))
    counts.flat[list(pairs)] = list(pairs.values())
    tests = seen.filter("pair is null").select(F.explode("found").alias("f")).filter("f.test is not null").groupBy("f.test", "f.p_bin").count()
    return thresholds([tuple(r) for r in tests.collect()], counts)


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, found`` of each row of ``docs`` (doc_id, text); ``found``: spans as structs of start, end (code
    points, end exclusive) and kind, in order.

    Kinds assign, access and hex are fixed patterns. A run of 16 encoded characters or more outside their spans is
    ``random`` if the battery of tests for the smallest alphabet that holds it finds it more like random characters than
    text would be: false-discovery control over the whole corpus, within each alphabet and length class, against runs
    drawn from the corpus's own successions of characters bounds the share of text among what is reported. A run that
    the battery tells from random characters at ``LEAST_P`` is never reported. A value after '=' is a run of its own; a
    run that mixes base64 and base64url is judged by parts, whose spans may overlap.

    Null or empty text: no spans. Null doc_ids and repeated rows: a row each. No rows: no rows. Other columns are
    ignored. A text of any length is scanned whole.
    """
    seen = written(texts(docs).mapInArrow(_scan, SCAN), "secret-spans")
    least = _learned(seen)
    limit = F.create_map(*(F.lit(x) for kv in least.items() for x in kv)) if least else F.create_map().cast("map<string,int>")
    keep = lambda s: s["test"].isNull() | (s["p_bin"] < limit[s["test"]])
    order = F.create_map(*(F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)))
    spans = F.array_sort(F.transform(F.filter("found", keep), lambda s: F.struct(s["start"].alias("start"), order[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return seen.filter("pair is null").select("doc_id", spans.alias("found"))


def listed(spans) -> F.Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def digest(found: DataFrame) -> DataFrame:
    """Counts by kind, the hash of the base spans and all spans as text, of what ``scan`` returns."""
    n = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("found", lambda s: s["kind"] != "random")
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(F.encode(listed(base), "utf-8"), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"), n("random"))


def _redact(least: dict[str, int]):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t in b.column("text").to_pylist():
                parts, at = [], 0
                for start, end, _, test, p_bin in sorted(scanned(t), key=lambda s: s[:2]) if t else ():
                    if test is not None and p_bin >= least[test]:
                        continue
                    if start >= at:
                        parts += [t[at:start], REDACTED]
                    at = max(at, end)
                out.append(None if t is None else "".join([*parts, t[at:]]))
            yield b.set_column(b.schema.get_field_index("text"), "text", pa.array(out, pa.string()))

    return run


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with every span that ``scan`` finds replaced by ``REDACTED``, overlapping spans by one; a null text stays
    null. All columns and rows are kept. The texts are scanned twice, so that no text has to be shuffled."""
    return docs.mapInArrow(_redact(_learned(written(texts(docs).mapInArrow(_scan, SCAN), "secret-spans"))), docs.schema)
