"""Line dedup by content-defined line chunks, in DataFrame functions only.

A document's lines become chunks whose boundaries depend on nothing but the lines around them: a
rolling hash over the hashes of two consecutive lines ends a chunk after about every second line,
and a line of more than ``LONG_WORDS`` words is a chunk of its own. So a passage that sits elsewhere,
after other lines, is cut in the same places. Chunks that count are those of several lines or of one
long line. Of the chunks with equal bytes the first stays, in order of (doc_id, place); the others
are removed from their documents.

Bytes are compared by grouping on the chunk text itself. Grouping combines inside each task first,
so a chunk that a third of the corpus holds costs one row for each task. Its key is then carried by
two hashes; where two different texts ever shared both, the chunks stay.

Null texts have no lines and stay null; a document all of whose chunks go keeps an empty text.
Repeated rows (same doc_id and text) count as one document. Rows without a doc_id are not touched,
and their chunks do not count as earlier ones.

Chunks miss many passages of short lines. ``without_passages`` misses none: it removes every line of
every run of lines of more than ``LONG_WORDS`` words that equals an earlier run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the rolling hash: multiplier, modulus and divisor; a chunk ends where the hash is 0 modulo the divisor.
MULTIPLIER, MODULUS, DIVISOR = 31, 4294967291, 2
LONG_WORDS = 50


# Anchored and possessive, so a line is read once and no word is copied.
_LONG_LINE = r"^[\x20\x09-\x0D]*+(?:[^\x20\x09-\x0D]++[\x20\x09-\x0D]++){%d}[^\x20\x09-\x0D]" % LONG_WORDS


def _line_hash(line: Column) -> Column:
    """The first 32 bits of the line's MD5."""
    return F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("long")


def chunked(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """``docs`` with ``chunks``: an array of the chunks in order, each an array of its lines. Narrow."""
    lines = F.coalesce(F.split(F.col(text), "\n", -1), F.array().cast("array<string>"))
    described = F.transform(
        "_lines", lambda line: F.struct(_line_hash(line).alias("hash"), line.rlike(_LONG_LINE).alias("long"))
    )
    marked = docs.withColumn("_lines", lines).withColumn("_marks", described)
    mark = lambda i: F.element_at("_marks", i.cast("int"))
    size = F.size("_lines")
    rolling = lambda i: (F.when(i > 1, mark(i - 1)["hash"]).otherwise(F.lit(0)) * MULTIPLIER + mark(i)["hash"]) % MODULUS
    ends_here = lambda i: (i == size) | mark(i)["long"] | mark(i + 1)["long"] | (rolling(i) % DIVISOR == 0)
    numbers = F.when(size > 0, F.sequence(F.lit(1), size)).otherwise(F.array().cast("array<int>"))
    cut = marked.withColumn("_ends", F.filter(numbers, ends_here))
    starts = F.slice(F.concat(F.array(F.lit(0)), "_ends"), 1, F.size("_ends"))
    chunks = F.zip_with(starts, "_ends", lambda a, b: F.slice("_lines", a + 1, b - a))
    return cut.withColumn("chunks", chunks).drop("_lines", "_marks", "_ends")


def _rows(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """One row per chunk that counts: doc_id, place, chunk text, and its two hashes."""
    named = docs.filter(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    # The outer form, for the plain one repeats the whole expression in a filter below.
    rows = (
        chunked(named)
        .select("doc_id", F.posexplode_outer("chunks").alias("place", "lines"))
        .filter((F.size("lines") > 1) | F.element_at("lines", 1).rlike(_LONG_LINE))
        .select("doc_id", "place", F.array_join("lines", "\n").alias("chunk"))
    )
    return rows.select("*", F.xxhash64("chunk").alias("h1"), F.xxhash64(F.lit(7), "chunk").alias("h2"))


def repeated_chunks(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, place) of every chunk that equals an earlier one."""
    rows = _rows(docs, text, doc_id)
    equal = rows.groupBy("h1", "h2", "chunk").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"))
    several = (
        equal.groupBy("h1", "h2")
        .agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("n"), F.min("first_doc").alias("first_doc"))
        .filter("texts = 1 AND n > 1")
        .select("h1", "h2", "first_doc")
    )
    held = rows.select("doc_id", "place", "h1", "h2").join(several, ["h1", "h2"])
    own_first = F.min("place").over(Window.partitionBy("doc_id", "h1", "h2"))
    return (
        held.withColumn("own_first", own_first)
        .filter((F.col("doc_id") != F.col("first_doc")) | (F.col("place") > F.col("own_first")))
        .select("doc_id", "place")
        .distinct()
    )


def deduplicated(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with repeated chunks cut out of the text, and n_chunks, n_removed, removed_chars beside the columns."""
    new = ("n_chunks", "n_removed", "removed_chars")
    if clash := set(new) & set(docs.columns):
        raise ValueError(f"columns {sorted(clash)} are there already")
    gone = (
        repeated_chunks(docs, text=text, doc_id=doc_id)
        .groupBy(F.col("doc_id").alias("_doc"))
        .agg(F.collect_list("place").alias("_gone"))
    )
    marked = chunked(docs.join(gone, F.col(doc_id) == F.col("_doc"), "left"), text=text)
    removed = F.coalesce("_gone", F.array().cast("array<int>"))
    left = F.filter("chunks", lambda _, k: ~F.array_contains(F.col("_gone"), k))
    kept_text = F.array_join(F.flatten(left), "\n")
    cut = F.when(F.size(removed) > 0, kept_text).otherwise(F.col(text))
    return marked.select(
        *(cut.alias(text) if c == text else docs[c] for c in docs.columns),
        F.size("chunks").cast("long").alias("n_chunks"),
        F.size(removed).cast("long").alias("n_removed"),
        (F.length(text) - F.length(cut)).cast("long").alias("removed_chars"),
    )


def _units(text: str) -> Column:
    """The lines with words, each with the blank lines behind it; blank lines at the start are a unit of their own."""
    return F.split(F.col(text), r"\n(?=[\x20\x09\x0B-\x0D]*+[^\x20\x09-\x0D])", -1)


def _runs(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """doc_id, version, start, end, digest: the shortest runs of lines of more than LONG_WORDS words that start or end at each line.

    Any longer run is covered by those inside it. A run has at most LONG_WORDS + 1 lines, for only lines
    with words count. Lines and runs are compared by 128 bits of SHA-256.
    """
    digest = lambda value: F.unhex(F.substring(F.sha2(value, 256), 1, 32))
    document = ["doc_id", "version"]
    lines = (
        docs.filter(F.col(doc_id).isNotNull())
        .select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("version"), F.posexplode_outer(_units(text)).alias("place", "unit"))
        .select(
            *document,
            "place",
            F.least(F.regexp_count("unit", F.lit(r"[^\x20\x09-\x0D]++")), F.lit(LONG_WORDS + 1)).cast("long").alias("words"),
            digest(F.substring_index("unit", "\n", 1)).alias("line"),
        )
        .filter("words > 0")
        .repartition(*document)
        .distinct()
    )
    upto = F.sum("words").over(Window.partitionBy(*document).orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    placed = lines.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("words"))
    from_here = Window.partitionBy(*document).orderBy("before").rangeBetween(0, LONG_WORDS)
    to_here = Window.partitionBy(*document).orderBy("upto").rangeBetween(-LONG_WORDS, 0)

    def run(over, start: Column, end: Column, least: Column) -> Column:
        joined = F.aggregate(F.collect_list("line").over(over), F.lit(b""), lambda acc, line: F.concat(acc, line))
        return F.when(F.sum("words").over(over) > least, F.struct(start.alias("start"), end.alias("end"), digest(joined).alias("digest")))

    forward = run(from_here, F.col("place"), F.max("place").over(from_here), F.lit(LONG_WORDS))
    # One that is over the limit only with its last line is the run from its first line.
    backward = run(to_here, F.min("place").over(to_here), F.col("place"), F.col("words") + LONG_WORDS)
    both = placed.select(*document, forward.alias("forward"), backward.alias("backward"))
    return both.select(*document, F.explode(F.array_compact(F.array("forward", "backward"))).alias("run")).select(*document, "run.*")


def without_passages(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` without the lines of repeated passages, and n_lines, n_removed, removed_chars beside the columns.

    A passage is a run of lines of more than LONG_WORDS words. It is repeated if the same lines stand in a
    row in an earlier document, or before it in its own without sharing a line. Blank lines are not
    compared; they go with the line before them. Rows are told apart by doc_id and text.
    """
    new = ("n_lines", "n_removed", "removed_chars")
    if clash := set(new) & set(docs.columns):
        raise ValueError(f"columns {sorted(clash)} are there already")
    runs = _runs(docs, text, doc_id)
    first = F.min(F.struct("doc_id", "version", "start", "end")).alias("first")
    several = runs.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), first).filter("n > 1").drop("n")
    other = (F.col("doc_id") != F.col("first.doc_id")) | (F.col("version") != F.col("first.version"))
    gone = (
        runs.join(several, "digest")
        .filter(other | (F.col("start") > F.col("first.end")))
        .select("doc_id", "version", F.explode(F.sequence("start", "end")).alias("place"))
        .groupBy(F.col("doc_id").alias("_doc"), F.col("version").alias("_version"))
        .agg(F.collect_set("place").alias("_gone"))
    )
    same = (F.col(doc_id) == F.col("_doc")) & (F.xxhash64(text) == F.col("_version"))
    marked = docs.join(gone, same, "left").withColumn("_units", F.coalesce(_units(text), F.array().cast("array<string>")))
    left = F.array_except(F.sequence(F.lit(0), F.size("_units") - 1), "_gone")
    kept_text = F.array_join(F.transform(left, lambda k: F.element_at("_units", k + 1)), "\n")
    cut = F.when(F.col("_gone").isNotNull(), kept_text).otherwise(F.col(text))
    return marked.select(
        *(cut.alias(text) if c == text else docs[c] for c in docs.columns),
        F.size("_units").cast("long").alias("n_lines"),
        F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_removed"),
        (F.length(text) - F.length(cut)).cast("long").alias("removed_chars"),
    )
