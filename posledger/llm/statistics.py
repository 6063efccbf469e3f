"""Text statistics as Spark column expressions, and the bounded sample of labelled rows that models are fitted on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "[#*$%&|<>]"
LABELLED_ROWS = 20_000


def bound(value: Column, use) -> Column:
    """``use`` applied to a value that is computed once (a lambda variable is; a repeated expression in a lambda is not)."""
    return F.element_at(F.transform(F.array(value), use), 1)


def n_of(text: Column, pattern: str) -> Column:
    """How many characters of the text are of a class."""
    return F.length(text) - F.length(F.regexp_replace(text, pattern + "+", ""))


def repeat_words(words: Column) -> Column:
    """Words of the three-word windows that the text has more than once; windows are known by 64-bit hashes.

    Texts without such a window are told by the number of distinct hashes. In the others the hashes are sorted with
    their places; neighbours that are equal give the places of repeated windows, and each adds the words that the one
    before doesn't cover.
    """
    hashes = F.transform(F.slice(words, 3, F.greatest(F.lit(0), F.size(words) - 2)), lambda w, i: F.xxhash64(F.get(words, i), F.get(words, i + 1), w))

    def repeated(s: Column) -> Column:
        same = lambda k: F.get(s, k)["h"].eqNullSafe(F.get(s, k + 1)["h"])
        at = F.filter(F.transform(s, lambda x, k: F.when(((k > 0) & same(k - 1)) | ((k < F.size(s) - 1) & same(k)), x["i"])), lambda i: i.isNotNull())
        return F.sort_array(at)

    def total(at: Column) -> Column:
        start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
        step = lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"))
        return F.aggregate(at, start, step)["n"]

    places = lambda h: F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    return bound(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(total(bound(places(h), repeated))))


def dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(WORD))
    return bound(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def base(text: Column) -> Column:
    """A struct of the counts (all long); a null text counts as empty."""
    text = F.coalesce(text, F.lit(""))

    def counts(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.size(F.array_distinct(words)).cast("long").alias("n_distinct"),
            repeat_words(words).alias("n_repeat_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        )

    return F.struct(
        bound(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), counts).alias("w"),
        n_of(text, SYMBOLS).cast("long").alias("n_symbols"),
        dup_lines(text).alias("n_dup_lines"),
        n_of(text, r"\p{Lu}").cast("long").alias("n_upper"),
        n_of(text, "[!?]").cast("long").alias("n_marks"),
        n_of(text, "[0-9]").cast("long").alias("n_digits"),
        n_of(text, "[.,;:'\"()-]").cast("long").alias("n_points"),
    )


COUNTS = ("n_words", "n_distinct", "n_repeat_words", "word_chars", "n_symbols", "n_dup_lines", "n_upper", "n_marks", "n_digits", "n_points")


def with_counts(docs: DataFrame, keep=("doc_id",)) -> DataFrame:
    """The ``keep`` columns and the ten counts of every document.

    The counts pass through a generator of one row, so that a filter on them is not pushed below, where
    each mention of a count would count again.
    """
    s = docs.select(*[F.col(c) for c in keep], F.explode(F.array(base(F.col("text")))).alias("_s"))
    inner = {"n_words", "n_distinct", "n_repeat_words", "word_chars"}
    return s.select(*keep, *[(F.col(f"_s.w.{c}") if c in inner else F.col(f"_s.{c}")).alias(c) for c in COUNTS])


def ratios() -> dict[str, Column]:
    """Statistics in proportion to the text, from the counts of ``with_counts``; an empty text has zeros."""
    c = F.col
    per = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    return {
        "words": c("n_words").cast("double"),
        "symbol_ratio": per(c("n_symbols"), c("n_words")),
        "repeat_ratio": per(c("n_repeat_words"), c("n_words")),
        "distinct_ratio": per(c("n_distinct"), c("n_words")),
        "upper_ratio": per(c("n_upper"), c("word_chars")),
        "mark_ratio": per(c("n_marks"), c("n_words")),
        "digit_ratio": per(c("n_digits"), c("word_chars")),
        "point_ratio": per(c("n_points"), c("n_words")),
        "dup_line_ratio": per(c("n_dup_lines"), c("n_words")),
        "word_length": per(c("word_chars"), c("n_words")),
    }


def held_out(doc_id: Column, fold: int = 5) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % fold == 0


def labelled(docs: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS) -> DataFrame:
    """Ratios and ``quality`` of at most ``rows`` labelled documents outside the held-out fold.

    The bound is what makes the join a broadcast: at most ``rows`` pairs of numbers. Rows are
    chosen by a hash of their id. Labels without an id or a quality of 0 or 1 are left out; of several
    labels of one document the least counts, and of several documents of one id the one of the least statistics.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    some = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    found = with_counts(docs.select("doc_id", "text").join(F.broadcast(some), "doc_id"), ("doc_id", "quality"))
    found = found.groupBy("doc_id").agg(F.min(F.struct("quality", *[v.alias(k) for k, v in ratios().items()])).alias("s"))
    return found.select("doc_id", "s.*")
