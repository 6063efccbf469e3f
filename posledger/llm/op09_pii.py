"""Operator 9, personal data: base kinds by pattern, and terms that give protected entities away.

An entity is a base match (e-mail, IP address, card, phone number). Its information content is
IC(e) = log2(N / n_e) over the N documents. A term is a word that stands within ``reach`` words of it on
the same side of no other blank run than spaces or line breaks; it reveals the entity as far as
PMI(t, e) = log2(N * n_te / (n_t * n_e)) reaches IC(e). n_te counts documents in which t stands near e,
n_t documents that have t at all; both run over the whole corpus. Terms whose share PMI / IC is ``generalise``
or more become spans of kind ``term`` wherever they stand in those documents; ``sanitised`` replaces what it
finds by its kind, and removes terms of a share of ``remove`` or more.

Every pair is scored, one seen once included, and what is glued to a match, such as brackets or a full stop, is passed
over on the way to its words.
Words are taken whole, however long: what is looked at on a side doubles until ``reach`` words and the blank
beyond them are in it, or the text ends.

The base patterns are written so that a match starts where a leftmost match must and no run of
characters is scanned again from each of its places: long runs cost their length.

Only DataFrame functions are used. What depends on the text alone is joined by two hashes of the text.
Nulls count as empty and have no spans; a null or repeated id is fine, each row has its own result; equal
matches in one text count as one document; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .op01_lines import _checked
from .shared import saved
from .statistics import bound

KINDS = ("email", "ip", "card", "phone")
WORD = r"[^\x20\x09-\x0D]+"
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
SMALL = 200_000


def located(text: Column, pattern: Column) -> Column:
    """All matches as structs of start, end (code points, end exclusive) and the string."""

    def place(x: Column) -> Column:
        pairs = F.zip_with(x["m"], F.slice(x["p"], 1, F.size(x["m"])), lambda m, p: F.struct(m.alias("m"), p.alias("p")))
        empty = F.array().cast("array<struct<s:int,e:int,m:string>>")

        def step(acc, y):
            s = acc["at"] + F.length(y["p"])
            e = s + F.length(y["m"])
            return F.struct(e.alias("at"), F.concat(acc["out"], F.array(F.struct(s.alias("s"), e.alias("e"), y["m"].alias("m")))).alias("out"))

        return F.aggregate(pairs, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda acc: acc["out"])

    return bound(F.struct(F.regexp_extract_all(text, pattern, F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("p")), place)


def _digits(m: Column) -> Column:
    return F.translate(m, " +().-", "")


def _luhn(m: Column) -> Column:
    def total(d: Column) -> Column:
        def step(acc, i):
            x = F.substr(d, -i, F.lit(1)).cast("int")
            x = F.when(i % 2 == 0, F.when(x > 4, 2 * x - 9).otherwise(2 * x)).otherwise(x)
            return acc + x

        return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), step) % 10 == 0

    return bound(_digits(m), total)


def _valid(kind: str):
    def byte(part):
        return bound(F.regexp_replace(part, "^0+", ""), lambda p: (F.length(p) <= 2) | ((F.length(p) == 3) & (p <= "255")))

    return {
        "email": lambda x: F.lit(True),
        "ip": lambda x: F.forall(F.split(x["m"], r"\."), byte),
        "card": lambda x: _luhn(x["m"]),
        "phone": lambda x: F.length(_digits(x["m"])).between(9, 15),
    }[kind]


def base_spans(text: Column) -> Column:
    """A struct of an array of matches per kind."""
    none = F.array().cast("array<struct<s:int,e:int,m:string>>")
    kinds = []
    for kind in KINDS:
        spans = F.filter(located(text, F.lit(PATTERNS[kind])), _valid(kind))
        kinds.append((F.when(F.contains(text, F.lit(NEEDS[kind])), spans).otherwise(none) if NEEDS[kind] else spans).alias(kind))
    return F.struct(*kinds)


def _tagged(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda x: F.struct(F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m")))


def _key(text: Column) -> list:
    return [F.xxhash64(text).alias("k1"), F.hash(text, F.lit(3)).alias("k2")]


BLANK, LETTER = r"[\x20\x09-\x0D]", WORD[:-1]


def _context(s: Column, e: Column, reach: int) -> tuple:
    """The ``reach`` words (with their blanks) before place ``s`` and those after ``e`` of ``text``."""
    glued = rf"{LETTER}*+"
    text, size = F.col("text"), F.length("text")

    def widened(window, enough: str) -> Column:
        """The least doubling of the window that is enough; the last one is the whole side."""

        def step(acc, k):
            wide = F.lit(64 * (reach + 1)) * F.pow(F.lit(2.0), k).cast("long")
            return F.when(acc.isNotNull(), acc).otherwise(bound(window(wide), lambda w: F.when((k == 24) | w["all"] | w["text"].rlike(enough), w["text"])))

        return F.aggregate(F.sequence(F.lit(0), F.lit(24)), F.lit(None).cast("string"), step)

    def left(wide):
        n = F.least(s.cast("long"), wide).cast("int")
        return F.struct(F.substr(text, s - n + 1, n).alias("text"), (n == s).alias("all"))

    def right(wide):
        n = F.least((size - e).cast("long"), wide).cast("int")
        return F.struct(F.substr(text, e + 1, n).alias("text"), (n == size - e).alias("all"))

    before = widened(left, rf"{BLANK}(?:{LETTER}++{BLANK}++){{{reach}}}{glued}\z")
    after = widened(right, rf"\A{glued}(?:{BLANK}++{LETTER}++){{{reach}}}{BLANK}")
    before = F.regexp_extract(before, rf"(?<!{LETTER})((?:{LETTER}++{BLANK}++){{0,{reach}}}){glued}\z", 1)
    after = F.regexp_extract(after, rf"\A{glued}((?:{BLANK}++{LETTER}++){{0,{reach}}})", 1)
    return before, after


def occurrences(docs: DataFrame, reach: int = 3) -> DataFrame:
    """Rows (k1, k2, copies, entity, terms) of the base matches of each different text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    some = docs.select(text.alias("text")).withColumn("found", base_spans(F.col("text")))
    some = some.where(" OR ".join(f"size(found.{k}) > 0" for k in KINDS)).select("text", "found", *_key(F.col("text")))
    kinds = [_tagged(F.col(f"found.{k}"), k) for k in KINDS]
    one = some.groupBy("k1", "k2").agg(F.count("*").alias("copies"), F.first("text").alias("text"), F.first("found").alias("found"))
    each = one.select("k1", "k2", "copies", "text", F.explode(F.concat(*kinds)).alias("x"))
    before, after = _context(F.col("x.s"), F.col("x.e"), reach)
    value = F.when(F.col("x.kind").isin("card", "phone"), _digits(F.col("x.m"))).otherwise(F.lower("x.m"))
    each = each.select("k1", "k2", "copies", F.concat_ws(":", F.col("x.kind"), value).alias("entity"), before.alias("before"), after.alias("after"))
    words = lambda c: F.regexp_extract_all(c, F.lit(WORD), F.lit(0))
    terms = F.array_distinct(F.concat(words("before"), words("after")))
    return each.select("k1", "k2", "copies", "entity", terms.alias("terms"))


def revealing(docs: DataFrame, near: DataFrame, generalise: float) -> DataFrame:
    """(entity, term, share) of the terms that reveal an entity to a share of ``generalise`` or more."""
    in_text = near.groupBy("k1", "k2", "entity").agg(F.first("copies").alias("copies"))
    entities = in_text.groupBy("entity").agg(F.sum("copies").alias("n_e"))
    pairs = near.select("k1", "k2", "copies", "entity", F.explode("terms").alias("term"))
    pairs = pairs.groupBy("k1", "k2", "entity", "term").agg(F.first("copies").alias("copies"))
    pairs = saved(pairs.groupBy("entity", "term").agg(F.sum("copies").alias("n_te")))
    total = docs.count()
    if pairs.isEmpty():
        return pairs.select("entity", "term", F.lit(None).cast("double").alias("share"))
    each = docs.select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))).alias("term"))
    counts = each.groupBy("term").agg(F.count("*").alias("n_t"))
    scored = pairs.join(entities, "entity").join(counts, "term")
    content = F.log2(F.lit(total) / F.col("n_e"))
    pmi = F.log2(F.lit(total) * F.col("n_te") / (F.col("n_t") * F.col("n_e")))
    share = F.when(content > 0, pmi / content).otherwise(F.lit(0.0))
    return scored.select("entity", "term", share.alias("share")).where(F.col("share") >= generalise)


def _found(docs: DataFrame, reach: int, generalise: float, small: int) -> DataFrame:
    """The rows as ``_row`` with their base spans and the revealing terms as spans with their share."""
    near = saved(occurrences(docs, reach))
    reveals = saved(revealing(docs, near, generalise))
    own = near.select("k1", "k2", "entity", F.explode("terms").alias("term")).join(reveals, ["entity", "term"])
    own = own.groupBy("k1", "k2", "term").agg(F.max("share").alias("share")).groupBy("k1", "k2")
    own = own.agg(F.map_from_entries(F.collect_list(F.struct("term", "share"))).alias("terms"))
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("_row"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = rows.select("_row", "text", *_key(F.col("text"))).join(_checked(saved(own), small), ["k1", "k2"], "left")
    quoted = F.transform(F.map_keys("terms"), lambda t: F.concat(F.lit("\\Q"), F.replace(t, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")))
    pattern = F.concat(F.lit(r"(?<![^\x20\x09-\x0D])(?:"), F.array_join(quoted, "|"), F.lit(r")(?![^\x20\x09-\x0D])"))
    none = F.array().cast("array<struct<s:int,e:int,m:string>>")
    spots = F.when(F.col("terms").isNull(), none).otherwise(located(F.col("text"), pattern))
    return rows.select("_row", "text", "terms", base_spans(F.col("text")).alias("base"), spots.alias("spots"))


def _listed(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda x: F.concat_ws(":", F.lit(kind), x["s"], x["e"]))


def pii_spans(docs: DataFrame, reach: int = 3, generalise: float = 0.9, small: int = SMALL) -> DataFrame:
    """A row per document: counts of the base kinds, a digest of the base spans, and all spans."""
    rows = _found(docs.select("doc_id", "text"), reach, generalise, small)
    base = F.concat(*[_listed(k, F.col(f"base.{k}")) for k in KINDS])
    return rows.select(
        F.col("_row.doc_id").alias("doc_id"), *[F.size(F.col(f"base.{k}")).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.array_join(base, ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.concat(base, _listed("term", F.col("spots"))), ",").alias("spans"),
    )


def sanitised(docs: DataFrame, reach: int = 3, generalise: float = 0.9, remove: float = 0.97, small: int = SMALL) -> DataFrame:
    """The documents with their columns; base matches and revealing terms become their kind in brackets, or go."""
    rows = _found(docs, reach, generalise, small)
    marks = [F.transform(_tagged(F.col(f"base.{k}"), f"[{k.upper()}]"), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("to"))) for k in KINDS]
    share = lambda x: F.element_at(F.col("terms"), x["m"])
    marks.append(F.transform("spots", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.when(share(x) >= remove, F.lit("")).otherwise(F.lit("[TERM]")).alias("to"))))

    def step(acc, x):  # of overlapping spans the first stays
        piece = F.concat(acc["out"], F.substr(F.col("text"), acc["at"] + 1, x["s"] - acc["at"]), x["to"])
        return F.when(x["s"] < acc["at"], acc).otherwise(F.struct(x["e"].alias("at"), piece.alias("out")))

    done = F.aggregate(F.array_sort(F.concat(*marks)), F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substr(F.col("text"), acc["at"] + 1)))
    text = F.when(F.col("_row.text").isNull(), F.lit(None)).otherwise(done)
    rows = rows.select("_row", text.cast("string").alias("clean"))
    return rows.select(*[(F.col("clean") if c == "text" else F.col("_row")[c]).alias(c) for c in docs.columns])
