"""Document fingerprints: a canonical form (Unicode normalisation, case and white space folded), a wide hash of it,
and a byte comparison where hashes are equal. DataFrame functions only."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import n_parts, written

#: Seeds of the 64-bit hashes that make up a fingerprint.
SEEDS = (1, 2, 3, 4)
#: Bytes of text in a range of ids.
RANGE_BYTES = 64 << 20
#: Hangul syllables are composed by arithmetic: the first syllable, and the first lead, vowel and tail with their numbers.
HANGUL, LEAD, VOWEL, TAIL = 0xAC00, (0x1100, 19), (0x1161, 21), (0x11A7, 28)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once for each row, wherever the optimiser moves it."""
    return F.transform(F.array(value), body)[0]


@cache
def tables() -> tuple[dict[str, str], dict[str, str], dict[str, str], dict[str, int]]:
    """By rule, from the standard library: single characters that stand for another; what each composed character
    is made of; the pairs that compose; and the combining class of each mark."""
    single, parts, pairs, classes = {}, {}, {}, {}
    for c in map(chr, range(0x110000)):
        if unicodedata.combining(c):
            classes[c] = unicodedata.combining(c)
        d = unicodedata.decomposition(c)
        if not d or d.startswith("<"):
            continue
        whole = unicodedata.normalize("NFD", c)
        if unicodedata.normalize("NFC", c) != c and len(unicodedata.normalize("NFC", c)) == 1:
            single[c] = unicodedata.normalize("NFC", c)
        elif len(whole) > 1:
            parts[c] = whole
            if unicodedata.normalize("NFC", c) == c:
                pairs["".join(chr(int(x, 16)) for x in d.split())] = c
    return single, parts, pairs, classes


def _map(d: dict) -> Column:
    """A map of strings that the optimiser folds into one constant."""
    return F.str_to_map(F.lit("\n".join(f"{k}\t{v}" for k, v in d.items())), F.lit("\n"), F.lit("\t"))


def _class(chars) -> str:
    """A class of a regular expression, as ranges of code points."""
    out, codes = [], sorted(map(ord, chars))
    for i, c in enumerate(codes):
        if i and c == codes[i - 1] + 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in out)


@cache
def _texts() -> tuple[str, str, str, str]:
    """Patterns: what may have to be normalised, a character with its marks, and runs of Hangul parts."""
    single, parts, _, classes = tables()
    excluded = [c for c in parts if unicodedata.normalize("NFC", c) != c]
    lead, vowel, tail = (f"[\\x{{{a:x}}}-\\x{{{a + n - 1:x}}}]" for a, n in (LEAD, VOWEL, (TAIL[0] + 1, TAIL[1] - 1)))
    second = {p[1] for p in tables()[2]}
    marks = _class({*classes, *second})
    return f"[{_class({*single, *excluded, *classes, *second})}\\x{{1100}}-\\x{{11ff}}]", f"(?s)[^{marks}]?[{marks}]+|[{_class(excluded)}]|[^{marks}{_class(excluded)}]+(?![{marks}])", f"{lead}{vowel}{tail}?|[\\x{{ac00}}-\\x{{d7a3}}]{tail}", f"[^{lead[1:-1]}{vowel[1:-1]}\\x{{11a8}}-\\x{{11c2}}\\x{{ac00}}-\\x{{d7a3}}]+"


def _composed(cluster: Column) -> Column:
    """A character with marks, taken apart, its marks put in order of class, and put together again."""
    _, parts, pairs, classes = tables()
    made, of, ranks = _map(pairs), _map(parts), _map(classes)
    rank = lambda c: ranks[c].cast("int")
    chars = F.split(F.array_join(F.transform(F.split(cluster, ""), lambda c: F.coalesce(of[c], c)), ""), "")
    # marks sort by class within runs between characters without one; the number of such characters before keeps runs apart
    ranked = F.aggregate(
        chars,
        F.struct(F.lit(0).alias("run"), F.array().cast("array<struct<run:int,class:int,at:int,c:string>>").alias("out")),
        lambda acc, c: F.struct(
            (acc["run"] + F.when(rank(c).isNull(), 1).otherwise(0)).alias("run"),
            F.concat(acc["out"], F.array(F.struct((acc["run"] + F.when(rank(c).isNull(), 1).otherwise(0)).alias("run"), F.coalesce(rank(c), F.lit(0)).alias("class"), F.size(acc["out"]).alias("at"), c.alias("c")))).alias("out"),
        ),
    )["out"]
    start = F.struct(F.lit("").alias("done"), F.lit("").alias("base"), F.lit("").alias("left"), F.lit(-1).alias("last"))

    def step(acc: Column, x: Column) -> Column:
        pair = made[F.concat(acc["base"], x["c"])]
        joins = pair.isNotNull() & (acc["last"] < x["class"])
        opens = ~joins & (x["class"] == 0)
        return F.struct(
            F.when(opens, F.concat(acc["done"], acc["base"], acc["left"])).otherwise(acc["done"]).alias("done"),
            F.when(joins, pair).when(opens, x["c"]).otherwise(acc["base"]).alias("base"),
            F.when(opens, F.lit("")).when(joins, acc["left"]).otherwise(F.concat(acc["left"], x["c"])).alias("left"),
            F.when(opens, F.lit(-1)).when(joins, acc["last"]).otherwise(x["class"]).alias("last"),
        )

    return F.aggregate(F.array_sort(ranked), start, step, lambda acc: F.concat(acc["done"], acc["base"], acc["left"]))


def _syllable(run: Column) -> Column:
    """A run of Hangul parts as one syllable."""
    code = lambda i: F.ascii(F.substring(run, i, 1))  # noqa: E731  the code point of a character
    (l0, _), (v0, nv), (t0, nt) = LEAD, VOWEL, TAIL
    first = code(1)
    whole = first >= HANGUL
    number = F.when(whole, first).otherwise(((first - l0) * nv + code(2) - v0) * nt + HANGUL)
    tail = F.when(whole, code(2)).when(F.char_length(run) > 2, code(3)).otherwise(F.lit(t0))
    plain = whole & ((first - HANGUL) % nt != 0)
    return F.when(plain, run).otherwise(F.decode(F.unhex(F.lpad(F.hex((number + tail - t0).cast("long")), 4, "0")), "UTF-16BE"))


def nfc(text: Column) -> Column:
    """``text`` in normalisation form C; a text without marks, parts or stand-ins is passed as it is."""
    single = tables()[0]
    rare, clusters, hangul, other = _texts()
    marked = f"[{_class({*tables()[3], *(p[1] for p in tables()[2])})}]"
    excluded = [c for c in tables()[1] if unicodedata.normalize("NFC", c) != c]
    also = f"|[{_class(excluded)}]"

    def slow(t: Column) -> Column:
        t = F.translate(t, "".join(single), "".join(single.values()))
        t = F.array_join(F.transform(F.regexp_extract_all(t, F.lit(f"({clusters})"), 1), lambda c: F.when(c.rlike(marked + also), _composed(c)).otherwise(c)), "")
        return F.array_join(F.transform(F.regexp_extract_all(t, F.lit(f"({hangul}|{other}|.)"), 1), lambda c: F.when(c.rlike(f"^({hangul})$"), _syllable(c)).otherwise(c)), "")

    # all of them lie above U+02FF; the first test is cheap
    return F.when(text.rlike(r"[^\x00-\u02ff]") & text.rlike(rare), slow(text)).otherwise(text)


def canonical(text: Column) -> Column:
    """Normalised, lower case, white space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(nfc(text)), r"(?U)\s+", " "))


def wide_hash(text: Column) -> Column:
    return F.concat(*(F.lower(F.lpad(F.hex(F.xxhash64(F.lit(s), text)), 16, "0")) for s in SEEDS))


def _near(a: Column, b: Column) -> Column:
    return F.when(a == b, 1.0).otherwise(0.0)


def _constants(values: list[int]) -> Column:
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _number(x: Column, bounds: list[int]) -> Column:
    """How many of the sorted ``bounds`` are at or below ``x``: counted among every k-th of them, then among the k after
    that one, k about the root of their number."""
    if not bounds:
        return F.lit(0)
    k = max(1, int(len(bounds) ** 0.5))
    count = lambda some: F.size(F.filter(some, lambda b: b <= x))
    block = count(_constants(bounds[k - 1 :: k])) if len(bounds) >= k else F.lit(0)
    return block * k + count(F.slice(_constants(bounds), block * k + 1, F.lit(k)))


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` of each row.

    A fingerprint is exact: the hash of the canonical text and, for the texts of a hash that more than one canonical
    text of the corpus has (their bytes are compared), the text's SHA-256 too. So two likenesses exist, 0 and 1.

    The next document comes by ascending doc_id (null first), of equal ids by text; after the last comes the first. A
    single row is its own next. Null or empty text: 0 characters, the hash of an empty text. No rows: no rows.
    Repeated rows: a row each, each the other's next. Other columns are ignored.

    Rows are dealt out by ranges of ids; the first row of each range is also put at the end of the one before.
    """
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n = n_parts(docs, RANGE_BYTES)
    bounds = sorted(set(own.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 20 * n)).first()[0] or [])) if n > 1 else []
    at = _number(F.col("doc_id"), bounds)
    ranged = own.withColumn("part", F.when(F.col("doc_id").isNull(), -1).otherwise(at))
    firsts = sorted((r["part"], r["first"]) for r in ranged.groupBy("part").agg(F.min("doc_id").alias("first")).collect())
    if not firsts:
        firsts = [(0, 0)]
    # one row a range, so its size is bounded by the number of ranges
    before = spark.createDataFrame([(p, i, firsts[k - 1][0]) for k, (p, i) in enumerate(firsts)], "part int, doc_id bigint, before int")
    first_rows = own.join(F.broadcast(before.select(F.col("doc_id").alias("id"), "before")), own["doc_id"].eqNullSafe(F.col("id")))
    ghosts = first_rows.groupBy("before", "doc_id").agg(F.min("text").alias("text")).select("doc_id", "text", F.col("before").alias("part"), F.lit(True).alias("ghost"))
    rows = ranged.withColumn("ghost", F.lit(False)).unionByName(ghosts)
    hashed = rows.withColumn("hash", wide_hash(canonical(F.col("text"))))
    order = Window.partitionBy("part").orderBy("ghost", F.col("doc_id").asc_nulls_first(), "text")
    paired = hashed.withColumn("next", F.lead("text").over(order)).withColumn("next_hash", F.lead("hash").over(order)).filter(~F.col("ghost"))
    size, quarter = F.char_length("text"), (F.char_length("text") / 4).cast("int")
    edited = paired.select("doc_id", "hash", "next_hash", size.cast("long").alias("n_chars"), F.concat(F.substring("text", F.lit(1), size - quarter), F.substring("next", F.lit(1), quarter)).alias("edited"), "text", "next")
    # hashes that texts of other bytes share
    clash = written(own.select(canonical(F.col("text")).alias("c")).groupBy(wide_hash(F.col("c")).alias("hash")).agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo <> hi").select("hash"), "clashes")
    base = edited.select("doc_id", "n_chars", "hash", "next_hash", F.sha2("edited", 256).alias("edited_sha256"), let(canonical(F.col("edited")), wide_hash).alias("edited_hash"), "text", "next", "edited")
    if clash.isEmpty():
        out = base.withColumnsRenamed({"hash": "fingerprint", "edited_hash": "edited_fingerprint", "next_hash": "next_fingerprint"})
    else:
        for name, text in (("hash", "text"), ("edited_hash", "edited"), ("next_hash", "next")):
            these = clash.select(F.col("hash").alias("clash"))
            base = base.join(these, base[name] == these["clash"], "left").withColumn(name, F.when(F.col("clash").isNull(), F.col(name)).otherwise(F.concat(name, F.sha2(canonical(F.col(text)), 256)))).drop("clash")
        out = base.withColumnsRenamed({"hash": "fingerprint", "edited_hash": "edited_fingerprint", "next_hash": "next_fingerprint"})
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", _near(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), _near(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))


WHITE = re.compile(r"\s+")


def expected(text: str) -> str:
    """The canonical form of one text by the standard library; for tests."""
    return WHITE.sub(" ", unicodedata.normalize("NFC", text).lower()).strip(" ")
