"""Line deduplication by a deletion-neighbourhood join, in DataFrame functions only.

A line is its words, lower-cased and split at white space.  Of equal lines the
earliest stays, in the order of (id, text hash, line number).  A line goes also
if an earlier one is within one word edit (a word changed, added or left out) that
is at most one in ``words_per_edit`` words of the shorter line: in lines of few
words one edit makes another line, and any two single words would be near.  Two
near lines have a variant in common: both without the word at the same place, or
one whole and the other without a word.  All variants are emitted as hashed keys;
each line is joined with the earliest line of its key, and the words themselves
confirm the edit.  As every line of a key is within the bound of every other, the
earliest stands for all, and no group is ever expanded into pairs.

Lines without a partner are left out of the join beforehand: an edit falls into
one half of a line and leaves the other half equal, so a line whose halves occur
in no other line has no partner.

Defined results: a line without words is never dropped; a document that loses
all of its lines with words goes; null and blank texts pass unchanged; rows equal
in id and text are one document, all kept alike; a null id comes last in the
order; a long text or line is compared whole; an empty table gives no rows; other
columns pass untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.plans.staging import broadcast_if_small, staged

#: Words of the shorter line for each edit.
WORDS_PER_EDIT = 8

_SPACES = "\t\r\f\x0b"


def _plain(line: Column) -> Column:
    """``line`` lower-cased, its white space as spaces."""
    lower = F.lower(line)
    odd = F.contains(lower, F.lit("\t")) | F.contains(lower, F.lit("\r")) | F.contains(lower, F.lit("\f")) | F.contains(lower, F.lit("\x0b"))
    return F.when(odd, F.translate(lower, _SPACES, " " * len(_SPACES))).otherwise(lower)


def _words(line: Column) -> Column:
    return F.array_remove(F.split(_plain(line), " "), "")


def _joined(plain: Column) -> Column:
    """The words of a plain line with one space between them."""
    loose = F.contains(plain, F.lit("  ")) | F.startswith(plain, F.lit(" ")) | F.endswith(plain, F.lit(" "))
    return F.when(loose, F.array_join(F.array_remove(F.split(plain, " "), ""), " ")).otherwise(plain)


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("version"), F.col(text_col).alias("text"))


def _halves(line: Column, n: Column) -> Column:
    """The halves of a line of ``n`` words, for both lengths that a half of a partner may have: hash, and words of it, less than 0 for the last half."""
    half = lambda h: F.struct(F.xxhash64(h, F.call_function("substring_index", line, F.lit(" "), h)).alias("half"), h.alias("at"))
    longer, shorter = (n / 2).cast("int"), ((n - 1) / 2).cast("int")
    return F.when(n % 2 == 1, F.array(half(longer), half(-longer))).otherwise(F.array(half(longer), half(-longer), half(shorter), half(-shorter)))


def _earliest_lines(documents: DataFrame, words_per_edit: int) -> DataFrame:
    """Distinct lines: hashes, the earliest place, and the halves of lines that are compared by edits."""
    lines = documents.select("id", "version", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).filter(F.col("line").rlike(f"[^ {_SPACES}]"))
    plain = lines.select("id", "version", "line_no", _plain(F.col("line")).alias("line")).select("id", "version", "line_no", _joined(F.col("line")).alias("line"))
    counted = plain.select("id", "version", "line_no", "line", (F.octet_length("line") - F.octet_length(F.replace("line", F.lit(" "), F.lit(""))) + 1).alias("n"))
    place = F.struct(F.col("id").isNull().alias("no_id"), "id", "version", "line_no")
    halves = F.when(F.col("n") >= words_per_edit, _halves(F.col("line"), F.col("n")))
    hashed = counted.select(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), place.alias("place"), halves.alias("halves"))
    return hashed.groupBy("h1", "h2").agg(F.min("place").alias("place"), F.first("halves").alias("halves"))


def _candidates(lines: DataFrame) -> DataFrame:
    """Lines that have a half in common with another line: h1, h2, place, and these halves."""
    halves = lines.filter("halves is not null").select("h1", "h2", "place", F.inline("halves"))
    shared = staged(halves.groupBy("half").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).filter("a != b").select("half"))
    return halves.join(broadcast_if_small(shared), "half").groupBy("h1", "h2").agg(F.first("place").alias("place"), F.collect_set(F.struct("half", "at")).alias("halves"))


def _without(words: Column, i: Column) -> Column:
    """``words`` without the one at ``i``, counted from 1; all of them for 0."""
    return F.when(i == 0, words).otherwise(F.concat(F.slice(words, F.lit(1), i - 1), F.slice(words, i + 1, F.size(words))))


def _variants(texts: DataFrame) -> DataFrame:
    """h1, key and i for each line as it is (i = 0) and without the word at i.

    An edit beside a half that two lines share is one in the rest of them, so the
    half's hash and the variants of the rest are enough.
    """
    at = F.col("at")
    lines = texts.select("h1", F.transform("words", lambda w: F.xxhash64(w)).alias("w"), F.inline("halves"))
    rest = F.when(at > 0, F.slice("w", at + 1, F.size("w"))).otherwise(F.slice("w", 1, F.size("w") + at))
    keys = lambda w: F.transform(F.sequence(F.lit(0), F.size(w)), lambda i: F.xxhash64("half", _without(w, i)))
    rows = lines.withColumn("rest", rest).select("h1", "at", F.posexplode(keys(F.col("rest"))).alias("i", "key"))
    return rows.select("h1", "key", F.when(F.col("i") == 0, 0).otherwise(F.col("i") + F.greatest("at", F.lit(0))).alias("i"))


def _near_lines(documents: DataFrame, lines: DataFrame) -> DataFrame:
    """h1 and place of the lines with an earlier line within one word edit."""
    line = F.struct("place.line_no", "h1", "halves")
    wanted = staged(_candidates(lines).groupBy("place.id", "place.version").agg(F.collect_list(line).alias("wanted")))
    same_row = documents["id"].eqNullSafe(wanted["id"]) & (documents["version"] == wanted["version"])
    place = F.struct(F.col("id").isNull().alias("no_id"), "id", "version", "line.line_no")
    texts = staged(
        documents.join(broadcast_if_small(wanted), same_row)
        .select(documents["id"], documents["version"], F.split("text", "\n").alias("lines"), F.explode("wanted").alias("line"))
        .select("line.h1", place.alias("place"), _words(F.get("lines", F.col("line.line_no"))).alias("words"), "line.halves")
    )
    variants = staged(_variants(texts))
    common = staged(variants.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"))
    variants = staged(variants.join(broadcast_if_small(common), "key").join(texts.select("h1", "place"), "h1"))  # those that meet another
    first = F.min(F.struct("place", "h1"))
    equal_place = variants.filter("i > 0").groupBy("key", "i").agg(first.alias("hub"))
    whole = variants.filter("i = 0").groupBy("key").agg(first.alias("hub"))
    shorter = variants.filter("i > 0").groupBy("key").agg(F.min(F.struct("place", "h1", "i")).alias("hub"))
    earlier = F.col("hub.place") < F.col("place")
    pair = ("h1", F.col("hub.h1").alias("other"))
    pairs = (
        variants.filter("i > 0").join(equal_place, ["key", "i"]).filter(earlier).select(*pair, F.col("i").alias("i"), F.col("i").alias("j"))
        .unionAll(variants.filter("i > 0").join(whole, "key").filter(earlier).select(*pair, "i", F.lit(0)))
        .unionAll(variants.filter("i = 0").join(shorter, "key").filter(earlier).select(*pair, "i", F.col("hub.i")))
        .distinct()
    )
    other = texts.select(F.col("h1").alias("other"), F.col("words").alias("other_words"))
    same = _without(F.col("words"), F.col("i")) == _without(F.col("other_words"), F.col("j"))
    return pairs.join(texts.select("h1", "place", "words"), "h1").join(other, "other").filter(same).select("h1", "place").distinct()


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_edit: int = WORDS_PER_EDIT) -> DataFrame:
    """``docs`` with repeated lines taken out of the text, without the documents that nothing is left of."""
    left = marked(docs, id_col, text_col, words_per_edit).filter("n_kept > 0 or n_lines = 0")
    return left.select(*[(F.col("kept_text") if c == text_col else F.col("row").getField(c)).alias(c) for c in docs.columns])


def marked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_edit: int = WORDS_PER_EDIT) -> DataFrame:
    """Per row: row (all columns), n_lines (with words), n_kept (of these), kept_text."""
    documents = _documents(docs, id_col, text_col)
    lines = staged(_earliest_lines(documents, words_per_edit))
    near = staged(_near_lines(documents, lines))
    kept = lines.join(broadcast_if_small(near), ["h1", "place"], "left_anti").groupBy("place.id", "place.version").agg(F.collect_set("place.line_no").alias("kept"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("row_id"), F.xxhash64(F.col(text_col)).alias("row_version"))
    text = F.col("row").getField(text_col)
    joined = rows.join(kept, F.col("row_id").eqNullSafe(F.col("id")) & (F.col("row_version") == F.col("version")), "left")
    split = joined.withColumn("lines", F.split(text, "\n")).withColumn("kept", F.coalesce("kept", F.expr("array()").cast("array<int>")))
    blank = F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: ~F.get("lines", i).rlike(r"\S"))
    blanks = split.withColumn("blank", F.when(text.isNull(), F.expr("array()").cast("array<int>")).otherwise(blank))
    at = F.array_sort(F.array_union("kept", "blank"))
    left = F.array_join(F.transform(at, lambda i: F.get("lines", i)), "\n")
    return blanks.select(
        "row",
        F.when(text.isNull(), 0).otherwise(F.size("lines") - F.size("blank")).cast("long").alias("n_lines"),
        F.size("kept").cast("long").alias("n_kept"),
        F.when(text.isNotNull(), left).alias("kept_text"),
    )
