"""Quality rules: repetition counts, and divergence of a document from its language.

Each document's character classes and its language's most frequent words, learned
from all documents, give two histograms. Summed over the documents of a language
that pass the base rules they are its reference; a document whose Jensen-Shannon
distance from it is large is unlike the language: symbols, tables, word salad.
The fewer words a document has, the larger is the distance that chance alone
makes, so the limits fall with length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from .common import written

#: Members of character classes, as patterns write them.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
#: Words of a language whose frequencies are compared; how many are counted at once while they are sought; groups in which tasks' counts are merged first.
COMMON_WORDS, TRACKED, GROUPS = 16, 8192, 64
#: Largest Jensen-Shannon distances (square root, base 2) to the language's reference that still pass, in documents of any length.
MAX_CLASS, MAX_COMMON = 0.30, 0.30
#: Shares of these limits that hold for endless documents, and what a document of one word has besides (in squares, falling with words).
CLASS_LIMIT, COMMON_LIMIT = (0.16 / 0.30, 1.8 / 0.30), (0.08 / 0.30, 3.5 / 0.30)
#: Repeated windows up to which they are looked up one by one.
FEW = 32
#: Languages up to which their tables are broadcast.
BROADCAST_LANGS = 10_000


def words(text: Column) -> Column:
    # only the first and the last stretch can be empty
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def without(text: Column, characters: str) -> Column:
    """The text without a class of characters; a pattern, as translate looks every character up by itself."""
    return F.regexp_replace(text, f"[{characters}]+", "")


def repeated_words(hashes: Column) -> Column:
    """Words in windows of three that occur twice or more, from the windows' hashes in order."""
    placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    first = lambda s, k: (k == 0) | (F.get(s, k - 1)["h"] != F.get(s, k)["h"])
    last = lambda s, k: (k == F.size(s) - 1) | (F.get(s, k + 1)["h"] != F.get(s, k)["h"])
    # names are bound once so that the sorted array isn't built for each element
    spots = F.transform(F.array(placed), lambda s: F.array_sort(F.transform(F.filter(F.transform(s, lambda x, k: F.struct((~(first(s, k) & last(s, k))).alias("twice"), x["i"].alias("i"))), lambda x: x["twice"]), lambda x: x["i"])))
    begin = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-3).alias("at"))
    covered = F.aggregate(
        F.element_at(spots, 1),
        begin,
        lambda acc, i: F.struct((acc["n"] + F.least(F.lit(3), i - acc["at"])).cast("bigint").alias("n"), i.alias("at")),
        lambda acc: acc["n"],
    )
    # where few different windows repeat, looking each up among them is cheaper than sorting windows with their places
    ordered = F.array(F.sort_array(hashes))
    twice = F.element_at(F.transform(ordered, lambda s: F.array_distinct(F.filter(s, lambda x, k: x.eqNullSafe(F.get(s, k - 1))))), 1)
    few = F.element_at(F.transform(F.array(twice), lambda t: F.filter(F.transform(hashes, lambda h, i: F.when(F.array_contains(t, h), i)), lambda i: i.isNotNull())), 1)
    merge = lambda acc, i: F.struct((acc["n"] + F.least(F.lit(3), i - acc["at"])).cast("bigint").alias("n"), i.alias("at"))
    short = F.aggregate(few, begin, merge, lambda acc: acc["n"])
    repeats = F.size(hashes) - F.size(F.array_distinct(hashes))
    return F.when(repeats == 0, F.lit(0).cast("bigint")).when(repeats <= FEW, short).otherwise(covered)


def letters(text: Column) -> Column:
    """The lower-case runs of letters (ASCII, or any beyond), two spaces between, none around."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^a-z\x80-\x{10FFFF}]+", "  "))


def common_words(documents: DataFrame, count: int = COMMON_WORDS) -> DataFrame:
    """``lang, list``: the most frequent words of each language over all its documents, ties by word.

    Frequencies come from mergeable frequent-items sketches of fixed size, which
    are exact while TRACKED words suffice and else miss no word as frequent as
    these; so neither the vocabulary nor a language's words are shuffled. Tasks' sketches are merged in GROUPS first.
    """
    spoken = documents.select(F.col("lang").cast("string").alias("lang"), F.explode(F.split(letters(F.coalesce("text", F.lit(""))), "  ")).alias("word")).where("lang is not null and word != ''")
    groups = spoken.groupBy("lang", F.pmod(F.spark_partition_id(), F.lit(GROUPS)).alias("part")).agg(F.expr(f"approx_top_k_accumulate(word, {TRACKED})").alias("state"))
    merged = groups.groupBy("lang").agg(F.expr(f"approx_top_k_combine(state, {TRACKED})").alias("state"))
    # a list of 8 times as many, so that ties at its end are broken in one way
    top = merged.select("lang", F.expr(f"approx_top_k_estimate(state, {8 * count})").alias("top"))
    ordered = F.array_sort(F.transform("top", lambda x: F.struct((-x["count"]).alias("n"), x["item"].alias("word"))))
    return top.select("lang", F.transform(F.slice(ordered, 1, count), lambda x: x["word"]).alias("list"))


def by_language(rows: DataFrame, side: DataFrame, name: str) -> DataFrame:
    """``rows`` left-joined with a written table that has a row a language, broadcast after these were counted."""
    side = F.broadcast(side) if side.count() <= BROADCAST_LANGS else side
    return rows.join(side, F.col("lang").eqNullSafe(F.col(name)), "left").drop(name)


def measures(documents: DataFrame) -> DataFrame:
    """``doc_id, lang``, the base measures, and the histograms ``classes`` and ``common`` (null without a language)."""
    if "lang" not in documents.columns:
        documents = documents.withColumn("lang", F.lit(None).cast("string"))
    lists = written(common_words(documents).withColumnRenamed("lang", "_lang"), "common")
    rows = documents.select("doc_id", F.col("lang").cast("string").alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    rows = by_language(rows, lists, "_lang")
    rows = rows.withColumn("words", words(F.col("text"))).withColumn("plain", letters(F.col("text")))
    rows = rows.withColumn("spaced", F.concat(F.lit("  "), "plain", F.lit("  ")))
    # counted by what is left without a word; two spaces between words keep neighbours apart
    word = lambda k: F.get("list", F.lit(k))
    found = lambda k: F.coalesce((F.octet_length("spaced") - F.octet_length(F.replace("spaced", F.concat(F.lit(" "), word(k), F.lit(" ")), F.lit("")))) / (F.octet_length(word(k)) + 2), F.lit(0)).cast("long")
    total = F.when(F.col("plain") == "", 0).otherwise(F.octet_length("plain") - F.octet_length(F.replace("plain", F.lit("  "), F.lit(" "))) + 1)
    rows = rows.select(
        "doc_id",
        "lang",
        F.size("words").cast("long").alias("n_words"),
        F.char_length("text").alias("chars"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.char_length(without(F.col("text"), SYMBOLS)).alias("no_symbols"),
        F.char_length(without(F.col("text"), "0-9")).alias("no_digits"),
        F.char_length(without(F.col("text"), "A-Z")).alias("no_upper"),
        F.char_length(without(F.col("text"), ".,;:!?'\"()-")).alias("no_marks"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.when(F.size("words") < 3, F.array().cast("array<bigint>"))
        .otherwise(F.transform(F.slice("words", 1, F.greatest(F.size("words") - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2))))
        .alias("hashes"),
        F.when(F.col("list").isNotNull(), F.array(*(found(k) for k in range(COMMON_WORDS)))).alias("found"),
        total.cast("long").alias("total"),
    )
    n_symbols = (F.col("chars") - F.col("no_symbols")).cast("long")
    digits, upper, marks = (F.col("chars") - F.col(c) for c in ("no_digits", "no_upper", "no_marks"))
    rest = F.col("word_chars") - n_symbols - digits - upper - marks
    other = F.col("total") - F.aggregate("found", F.lit(0).cast("bigint"), lambda s, x: s + x)
    return rows.select(
        "doc_id",
        "lang",
        "n_words",
        "word_chars",
        n_symbols.alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("hashes")).alias("n_repeat_words"),
        F.array(*(x.cast("long") for x in (rest, upper, digits, marks, n_symbols, F.col("chars") - F.col("word_chars")))).alias("classes"),
        F.when(F.col("found").isNotNull(), F.concat("found", F.array(other))).alias("common"),
    )


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of counts; 0 if one is empty."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    tp, tq = total(p), total(q)
    terms = F.zip_with(
        F.transform(p, lambda x: x / tp), F.transform(q, lambda x: x / tq), lambda x, y: (part(x, (x + y) / 2) + part(y, (x + y) / 2)) / 2
    )
    value = F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)
    return F.when((tp > 0) & (tq > 0), F.sqrt(F.greatest(value, F.lit(0.0)))).otherwise(0.0)


def limit(most: float, shape: tuple[float, float]) -> Column:
    """The largest distance that passes in a document of ``n_words``: ``most``, or less where chance explains less."""
    floor, spread = shape
    return most * F.least(F.lit(1.0), F.sqrt(floor**2 + spread**2 / F.greatest("n_words", F.lit(1))))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


def references(measured: DataFrame) -> DataFrame:
    """``_lang, ref_classes, ref_common``: counts over the documents of each language that pass the base rules; null stands for all of them."""
    sums = lambda c, k: F.array(*(F.coalesce(F.sum(F.get(c, F.lit(i))), F.lit(0)) for i in range(k)))
    good = measured.where(~base_failed())
    own = good.groupBy(F.col("lang").alias("_lang")).agg(sums("classes", 6).alias("ref_classes"), sums("common", COMMON_WORDS + 1).alias("ref_common"))
    every = own.agg(sums("ref_classes", 6).alias("ref_classes"))
    every = every.select(F.lit(None).cast("string").alias("_lang"), "ref_classes", F.lit(None).cast("array<bigint>").alias("ref_common"))
    return own.where("_lang is not null").unionByName(every)


def quality(documents: DataFrame, max_class: float = MAX_CLASS, max_common: float = MAX_COMMON) -> DataFrame:
    """``doc_id``, base measures, ``base_failed``, both distances and ``kept`` for every row.

    A row without a language, and every row of a table without that column, is
    compared with all documents' classes and not by common words. A language of
    which no document passes the base rules has no reference, and distances are 0.
    Null and empty texts have no words and so fail. Repeated rows repeat and count
    in the references; an empty table gives an empty one. ``max_class`` and
    ``max_common`` are the limits of short documents; those of longer ones are in proportion.
    """
    measured = written(measures(documents), "quality")
    rows = by_language(measured, written(references(measured), "references"), "_lang")
    pair = lambda a, b: F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), distance(F.col(a), F.col(b))).otherwise(0.0)
    rows = rows.withColumn("class_distance", pair("classes", "ref_classes")).withColumn("common_distance", pair("common", "ref_common"))
    fine = (F.col("class_distance") <= limit(max_class, CLASS_LIMIT)) & (F.col("common_distance") <= limit(max_common, COMMON_LIMIT))
    failed = base_failed()
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "class_distance", "common_distance", (~failed & fine).alias("kept")
    )
