"""Benchmark decontamination: template windows of documents and benchmark items meet in a hash join, and the slots of
what meets are held against each other. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .fingerprints import let

#: Tokens of a window (an even number), literal tokens that it needs, and windows of an item that make a leak.
WINDOW, LEAST_LITERAL, LEAST_WINDOWS = 8, 4, 3
#: Rows of the benchmark's windows, or ids of matched documents, up to which they are broadcast; beyond, both sides
#: are shuffled.
BROADCAST_ROWS = 1_000_000
#: Units that are placeholders after a number.
UNITS = (
    "mm cm m km inch inches ft feet foot yard yards mile miles mg g kg t ton tons tonne tonnes lb lbs pound pounds oz ounce ounces "
    "ml cl l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hour hours day days week weeks month months year years "
    "percent pct dollar dollars usd euro euros eur cent cents gbp yen c f k celsius fahrenheit kelvin degree degrees "
    "meter meters metre metres gram grams kilogram kilograms kilometer kilometers kilometre kilometres centimeter centimeters watt watts volt volts amp amps"
).split()
NUMBER, NAME, UNIT = "<number>", "<name>", "<unit>"


#: A capital within a sentence. Begins with what is rare, as it is sought in whole texts.
INNER_CAPITAL = r" (?=\p{Lu}\p{Ll})(?<=[\p{Ll}\p{Nd}],? )"

#: Letters of scripts without spaces between words (Thai, Lao, Burmese, Khmer, kana, Han), and a cheap class around them.
UNSPACED = r"([[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uaa60-\uaa7f\uf900-\ufaff\uff66-\uff9f\x{20000}-\x{3ffff}]&&\p{L}]\p{M}*+)"
MAYBE_UNSPACED = r"[\u0e00-\u109f\u1780-\u17ff\u3040-\x{3ffff}]"


def raw_tokens(text: Column) -> Column:
    """Runs of letters, marks and digits, in lower case. A capital within a sentence gets a leading mark; a number
    with separators is one token, and so is each letter of scripts without spaces between words."""
    named = F.regexp_replace(text, INNER_CAPITAL, " \u0002")
    joined = F.when(named.rlike("[0-9]"), F.regexp_replace(named, r"(?<=\p{Nd})[.,](?=\p{Nd})", "")).otherwise(named)
    other = (F.octet_length(text) > F.length(text)) & text.rlike(MAYBE_UNSPACED)
    spaced = F.when(other, F.regexp_replace(joined, UNSPACED, " $1 ")).otherwise(joined)
    return F.array_remove(F.split(F.lower(spaced), r"[^\p{L}\p{M}\p{Nd}\x02]+"), "")


def has_slots(text: Column) -> Column:
    """Whether ``template`` may change a token of the text at all."""
    return text.rlike("[0-9]|" + INNER_CAPITAL)


def template(tokens: Column) -> Column:
    """Tokens with typed placeholders for numbers, names, and units after a number."""
    digit = lambda t: F.substring(t, 1, 1).between("0", "9")
    units = F.array(*map(F.lit, UNITS))

    def typed(t: Column, i: Column) -> Column:
        return F.when(t >= "a", F.when((i > 0) & digit(F.get(tokens, i - 1)) & F.array_contains(units, t), UNIT).otherwise(t)).when(t.startswith("\u0002"), NAME).when(digit(t), NUMBER).otherwise(t)

    return F.transform(tokens, typed)


def window_hashes(tokens: Column) -> Column:
    """The hash of the window that starts at each token, from those of its halves; empty for fewer tokens."""
    half = WINDOW // 2
    starts = lambda x, n: F.slice(x, F.lit(1), F.greatest(F.size(x) - n, F.lit(0)))
    halves = F.transform(starts(tokens, half - 1), lambda t, i: F.xxhash64(t, *(F.get(tokens, i + k) for k in range(1, half))))
    return let(halves, lambda h: F.transform(starts(h, half), lambda x, i: F.xxhash64(x, F.get(h, i + half))))


def short_hashes(tokens: Column, width: int) -> Column:
    """The hash of each window of ``width`` tokens, fewer than ``WINDOW``."""
    starts = F.slice(tokens, F.lit(1), F.greatest(F.size(tokens) - (width - 1), F.lit(0)))
    return F.transform(starts, lambda t, i: F.xxhash64(t, *(F.get(tokens, i + k) for k in range(1, width))))


def unmarked(tokens: Column) -> Column:
    """The values of tokens, without the marks of capitals."""
    return F.transform(tokens, lambda t: F.translate(t, "\u0002", ""))


def is_slot(t: Column) -> Column:
    return t.isin(NUMBER, NAME, UNIT)


def _plain(table: DataFrame, key: str) -> DataFrame:
    """Key and text; a row is told from others of its key by its text, with two hashes of it."""
    return table.select(F.col(key).cast("long").alias(key), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def text_hash(text: Column) -> Column:
    return F.struct(F.xxhash64(text).alias("x"), F.xxhash64(F.lit(1), text).alias("y"))


def _tokens(table: DataFrame, key: str, also: Callable[[Column], list[Column]]) -> DataFrame:
    """Key and what ``also`` makes of the tokens, which are computed once."""
    made = let(raw_tokens(F.col("text")), lambda t: F.struct(*also(t)))
    return table.select(key, text_hash(F.col("text")).alias("row"), made.alias("made")).select(key, "row", "made.*")


def _windows_of(tokens: Column) -> Column:
    """The hashes of an item's windows; one for an item of fewer than ``WINDOW`` tokens."""
    shorter = F.lit(None).cast("array<bigint>")
    for n in range(1, WINDOW):
        shorter = F.when(F.size(tokens) == n, short_hashes(tokens, n)).otherwise(shorter)
    return F.when(F.size(tokens) >= WINDOW, window_hashes(tokens)).otherwise(shorter)


def leaks(docs: DataFrame, benchmark: DataFrame, least_windows: int = LEAST_WINDOWS) -> DataFrame:
    """One row for each document and item of which it holds a passage: ``doc_id, item_id, n_windows, item_windows,
    n_slots, reparameterised``.

    A document holds an item if at least ``least_windows`` of the item's windows, or all if it has fewer, stand in the
    document in the item's own order and distances (one alignment) and the slots agree: where a value occurs again in
    the item, the document's values in those slots are equal too, or enough windows have the item's own values. Only slots
    inside windows that met count. ``n_slots``: slots compared; ``reparameterised``: some have another value than the
    item's. The best alignment counts.

    A window with fewer than ``LEAST_LITERAL`` literal tokens says nothing as a template and is sought by its values.
    Its item is also held if those and the other windows together are enough. An item of fewer than ``WINDOW`` tokens is
    one window, sought by its values and, with enough literals, as a template.

    Null or empty texts: none. Null item ids are ignored. Rows of documents that share an id, or have none, are documents
    of their own, each with its row here; of rows equal in id and text one counts. Repeated items change nothing. Empty
    tables: no rows. Other columns are ignored.
    """
    return _leaks(docs, benchmark, least_windows).drop("row")


def _leaks(docs: DataFrame, benchmark: DataFrame, least_windows: int) -> DataFrame:
    """``leaks``, with ``row``, the hash of the document's text."""
    items = _plain(benchmark, "item_id").filter("item_id is not null")

    def of_item(t: Column) -> list[Column]:
        plain = let(unmarked(t), lambda x: F.struct(_windows_of(x).alias("values"), F.size(x).alias("n")))
        heads = lambda x: F.array(*(F.get(_windows_of(F.concat(F.array(F.lit(k)), F.slice(x, 2, WINDOW - 1))), 0) for k in (NAME, UNIT)))
        typed = let(template(t), lambda x: F.struct(x.alias("typed"), _windows_of(x).alias("windows"), heads(x).alias("heads")))
        return [t.alias("raw"), typed.alias("w"), plain.alias("p")]

    item_tokens = written(_tokens(items, "item_id", of_item).select("item_id", "raw", "w.*", "p.*"), "item-tokens")
    width = F.least(F.lit(WINDOW), F.col("n"))
    literal = F.size(F.filter(F.slice("typed", F.col("item_pos") + 1, width), lambda t: ~is_slot(t)))
    at = item_tokens.select("item_id", "typed", "values", "n", F.posexplode("windows").alias("item_pos", "hash")).withColumn("telling", literal >= LEAST_LITERAL)
    columns = ("item_id", "item_pos", width.alias("width"))
    by_template = at.filter("telling").select("hash", *columns, F.lit(False).alias("exact"))
    # within a document's sentence or after a number, an item's first word may be a name or a unit
    first = F.get("typed", F.lit(0))
    rest = F.size(F.filter(F.slice("typed", 2, WINDOW - 1), lambda t: ~is_slot(t)))
    as_head = item_tokens.filter((F.col("n") > 0) & ~is_slot(first) & (rest >= LEAST_LITERAL)).withColumn("item_pos", F.lit(0))
    kinds = F.filter(F.arrays_zip("heads", F.array(F.lit(NAME), F.lit(UNIT)).alias("kind")), lambda h: (h["kind"] == NAME) | first.isin(UNITS))
    by_template = by_template.union(as_head.withColumn("hash", F.explode(F.transform(kinds, lambda h: h["heads"]))).select("hash", *columns, F.lit(False).alias("exact")))
    by_value = at.filter(~F.col("telling") | (F.col("n") < WINDOW)).select(F.get("values", F.col("item_pos")).alias("hash"), *columns, F.lit(True).alias("exact"))
    windows = written(by_template.union(by_value).distinct(), "item-windows")
    n_items = windows.groupBy("item_id").agg(F.min("width").alias("width"), F.countDistinct("item_pos").alias("item_windows"), F.countDistinct(F.expr("if(exact, null, item_pos)")).alias("item_templates"))
    small = windows.count() <= BROADCAST_ROWS
    right = F.broadcast(windows) if small else windows
    by_values = sorted(r["width"] for r in windows.filter("exact").select("width").distinct().collect())

    def of_text(t: Column) -> list[Column]:
        """Documents' windows as templates, and by value in the widths that the benchmark has."""

        def lists(s: Column) -> Column:
            long = [window_hashes(s["typed"]), *([window_hashes(s["plain"])] if WINDOW in by_values else [])]
            short = [short_hashes(s[k], n) for n in by_values if n < WINDOW for k in ("plain", "typed") if k == "plain" or n > LEAST_LITERAL]
            return F.array(*long, *short)

        typed = F.when(has_slots(F.col("text")), template(t)).otherwise(t)
        return [let(F.struct(typed.alias("typed"), *([unmarked(t).alias("plain")] if by_values else [])), lists).alias("lists")]

    hashes = _tokens(_plain(docs, "doc_id"), "doc_id", of_text).select("doc_id", "row", F.explode("lists").alias("windows"))
    met = hashes.select("doc_id", "row", F.posexplode("windows").alias("pos", "hash")).join(right, "hash").select("doc_id", "row", "item_id", (F.col("pos") - F.col("item_pos")).alias("shift"), "item_pos", "exact")
    aligned = met.groupBy("doc_id", "row", "item_id", "shift").agg(F.collect_set("item_pos").alias("at"), F.size(F.collect_set(F.expr("if(exact, null, item_pos)"))).alias("n_templates"))
    least = lambda n: F.least(F.lit(least_windows), n)
    held = ((F.col("n_templates") > 0) & (F.col("n_templates") >= least(F.col("item_templates")))) | (F.col("n_windows") >= least(F.col("item_windows")))
    enough = aligned.withColumn("n_windows", F.size("at").cast("long")).join(n_items, "item_id").filter(held)
    enough = enough.select("doc_id", "row", "item_id", "shift", "at", "width", "n_windows", "item_windows")
    enough = written(enough, "alignments")
    slots = item_tokens.select("item_id", "raw", F.posexplode("typed").alias("item_pos", "type")).filter(is_slot(F.col("type"))).select("item_id", "item_pos", "type", F.get("raw", F.col("item_pos")).alias("value")).distinct()
    if slots.isEmpty():
        checked = enough.withColumn("n_slots", F.lit(0).cast("long")).withColumn("reparameterised", F.lit(False))
    else:
        checked = _consistent(docs, enough, slots, least_windows)
    best = Window.partitionBy("doc_id", "row", "item_id").orderBy(F.desc("n_windows"), "reparameterised", "shift")
    return checked.withColumn("rank", F.row_number().over(best)).filter("rank = 1").select("doc_id", "item_id", "n_windows", "item_windows", "n_slots", "reparameterised", "row")


def _consistent(docs: DataFrame, enough: DataFrame, slots: DataFrame, least_windows: int) -> DataFrame:
    """Adds to alignments the number of slots compared, those inside windows that met, and whether they were changed;
    drops those that don't agree, unless enough of their windows have the item's own values."""
    found = enough.join(slots.select("item_id").distinct(), "item_id", "left_semi").select("row").distinct()
    few = found.count() <= BROADCAST_ROWS
    ids = found.withColumnRenamed("row", "found")
    own = _plain(docs, "doc_id").withColumn("own_row", text_hash(F.col("text")))
    texts = own.join(F.broadcast(ids) if few else ids, F.col("own_row") == F.col("found"), "left_semi")

    def of_doc(t: Column) -> list[Column]:
        typed = let(template(t), lambda x: F.transform(x, lambda y, i: F.struct(i.alias("pos"), y.alias("type"), F.get(t, i).alias("value"))))
        return [F.filter(typed, lambda s: is_slot(s["type"])).alias("slots")]

    # what a text holds doesn't depend on its id
    theirs = _tokens(texts, "doc_id", of_doc).select("row", F.explode("slots").alias("s")).select("row", F.col("s.pos").alias("pos"), F.col("s.type").alias("type"), F.col("s.value").alias("their")).distinct()
    inside = F.array_distinct(F.flatten(F.transform("at", lambda p: F.sequence(p, p + F.col("width") - 1))))
    asked = enough.select("row", "item_id", "shift", F.explode(inside).alias("item_pos")).join(slots, ["item_id", "item_pos"]).select("row", "item_id", "shift", "type", "value", "item_pos", (F.col("item_pos") + F.col("shift")).alias("pos"))
    pairs = asked.distinct().join(theirs, ["row", "pos", "type"])
    other = F.collect_set(F.when(F.col("their") != F.col("value"), F.col("item_pos"))).alias("other")
    by_value = pairs.groupBy("row", "item_id", "shift", "type", "value").agg(F.count("*").alias("n"), (F.min("their") == F.max("their")).alias("one"), other)
    verdict = by_value.groupBy("row", "item_id", "shift").agg(F.sum("n").alias("n_slots"), F.bool_and("one").alias("agree"), F.flatten(F.collect_list("other")).alias("other"))
    e, v = enough.alias("e"), verdict.alias("v")
    on = (F.col("e.row") == F.col("v.row")) & (F.col("e.item_id") == F.col("v.item_id")) & (F.col("e.shift") == F.col("v.shift"))
    touched = F.array_distinct(F.flatten(F.transform("v.other", lambda p: F.sequence(p - F.col("e.width") + 1, p))))
    own = F.size(F.array_except("e.at", touched))
    joined = e.join(v, on, "left").filter(F.coalesce("v.agree", F.lit(True)) | (own >= F.least(F.lit(least_windows), F.col("e.item_windows"))))
    joined = joined.withColumn("changed", F.size("v.other") > 0)
    return joined.select("e.*", F.coalesce("v.n_slots", F.lit(0)).cast("long").alias("n_slots"), F.coalesce("changed", F.lit(False)).alias("reparameterised"))


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that hold a passage of an item; all columns are kept. Rows are told apart by id and text,
    so that of rows that share an id, or have none, only those with a passage go."""
    bad = written(_leaks(docs, benchmark, LEAST_WINDOWS).select(F.col("doc_id").alias("leaking_id"), "row").distinct(), "leaks")
    bad = F.broadcast(bad) if bad.count() <= BROADCAST_ROWS else bad
    own = text_hash(F.coalesce(docs["text"].cast("string"), F.lit("")))
    return docs.join(bad, docs["doc_id"].cast("long").eqNullSafe(bad["leaking_id"]) & (own == bad["row"]), "left_anti")
