"""Quality rules: base counts and distribution divergence from language references.

Every document gets two histograms: its characters by class and its words by a list of common words
(all others in one bin). A language's reference is the mean of the distributions of all its documents
that pass the base rules, so it covers the whole corpus and no long document outweighs others. A
document is rejected when the Jensen-Shannon distance of either histogram from its reference is too
large; shorter texts, whose histograms say little, are guarded by minimum lengths.

A narrow pass over the texts leaves counts of fixed size, and the references are sums over them,
one row for each stated language and one for all others, which bounds what is broadcast.
Null texts count as empty, fail the base rules for want of words, and a null language is "other".
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skylattice.llm.flattext import NOT_SPACE, lower_ascii, mix, pieces, span_hashes, spans, window_hashes
from skylattice.session import materialize, ship_package

# Frequent words of the languages with a reference.
COMMON_WORDS = {
    "en": "the of and to in is that it for be as on with was are by this from or an a at".split(),
    "fr": "de la le les et des en un une du que qui dans pour sur au est par pas avec ce il".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es".split(),
    "es": "de la que el en y a los del se las por un para con no una su al lo como más".split(),
}
#: Character classes of the first histogram, by index.
CLASSES = ("lower", "upper", "digit", "space", "stop", "symbol", "control", "letter")
MIN_WORDS = 50
#: A document needs so many words for a verdict by characters and by common words.
CHARACTER_WORDS, COMMON_WORD_WORDS = 50, 150
#: Largest Jensen-Shannon distances (base 2, so 0 to 1) that pass.
CHARACTER_DISTANCE, COMMON_WORD_DISTANCE = 0.30, 0.28
OTHER = "other"

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_CLASS_OF = np.full(256, 5, np.uint8)
_CLASS_OF[:32] = _CLASS_OF[127] = 6
_CLASS_OF[[9, 10, 11, 12, 13, 32]] = 3
_CLASS_OF[0x61:0x7B], _CLASS_OF[0x41:0x5B], _CLASS_OF[0x30:0x3A] = 0, 1, 2
_CLASS_OF[list(b".,;:!?'\"()-")] = 4
_CLASS_OF[0xC0:] = 7
_CLASS_OF[0x80:0xC0] = 8  # later bytes of a character, not counted


def common_words(languages: dict[str, Sequence[str]]) -> list[str]:
    return sorted({word for words in languages.values() for word in words})


def _word_table(words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the words and the bin of each."""
    data = np.frombuffer("".join(words).encode(), np.uint8)
    ends = np.cumsum([len(w.encode()) for w in words])
    hashes = span_hashes(data, np.r_[0, ends[:-1]], ends)
    order = np.argsort(hashes)
    return hashes[order], order


def _row_counts(flags: np.ndarray, starts: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return np.diff(total[starts])


def _repeats(values: np.ndarray, of_row: np.ndarray) -> np.ndarray:
    """True where the row holds the value more than once."""
    _, which, counts = np.unique(mix(values ^ mix(of_row.astype(np.uint64))), return_inverse=True, return_counts=True)
    return counts[which] > 1


def measure(data: np.ndarray, starts: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> dict[str, np.ndarray]:
    """The counts of every row of a piece."""
    n = len(starts) - 1
    begins, ends, rows = spans(data, starts, NOT_SPACE)
    n_words = np.diff(rows)
    first_bytes = (data & 0xC0) != 0x80
    row_of_word = np.repeat(np.arange(n), n_words)

    line_begins, line_ends, line_rows = spans(data, starts, np.arange(256) != 10)
    words_before = np.searchsorted(begins, line_begins)
    worded = (words_before < len(begins)) & (np.r_[begins, len(data)][words_before] < line_ends)
    row_of_line = np.repeat(np.arange(n), np.diff(line_rows))[worded]
    lines = span_hashes(data, line_begins[worded], line_ends[worded])
    _, firsts = np.unique(mix(lines ^ mix(row_of_line.astype(np.uint64))), return_index=True)
    n_dup_lines = np.bincount(row_of_line, minlength=n) - np.bincount(row_of_line[firsts], minlength=n)

    words = span_hashes(data, begins, ends)
    windows = window_hashes(words, 3)
    inside = np.flatnonzero(row_of_word[: len(windows)] == row_of_word[2:])
    again = inside[_repeats(windows[inside], row_of_word[inside])]
    repeated = np.zeros(len(words), bool)
    for k in range(3):
        repeated[again + k] = True

    row_of_byte = np.repeat(np.arange(n, dtype=np.int32), np.diff(starts))
    characters = np.bincount(row_of_byte * np.int64(9) + _CLASS_OF[data], minlength=9 * n).reshape(n, 9)[:, :8]
    lowered = span_hashes(lower_ascii(data), begins, ends)
    known, bins = table
    at = np.minimum(np.searchsorted(known, lowered), len(known) - 1)
    place = np.where(known[at] == lowered, bins[at], len(known))
    common = np.bincount(row_of_word * (len(known) + 1) + place, minlength=(len(known) + 1) * n).reshape(n, len(known) + 1)
    return {
        "n_words": n_words,
        "word_chars": _row_counts(first_bytes & NOT_SPACE[data], starts),
        "n_symbols": _row_counts(_SYMBOLS[data], starts),
        "n_dup_lines": n_dup_lines,
        "n_repeat_words": np.bincount(row_of_word[repeated], minlength=n),
        "characters": characters,
        "common": common,
    }


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def counted(docs: DataFrame, *, text: str = "text", languages: dict[str, Sequence[str]] = COMMON_WORDS) -> DataFrame:
    """``docs`` with a struct column ``counts``: the base counts and both histograms. Narrow."""
    ship_package(docs.sparkSession)
    if "counts" in docs.columns:
        raise ValueError("column counts is there already")
    words = common_words(languages)
    lists = ("characters", "common")
    kind = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS] + [T.StructField(c, T.ArrayType(T.IntegerType())) for c in lists])
    schema = T.StructType([*docs.schema.fields, T.StructField("counts", kind)])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _word_table(words)
        for batch in batches:
            for first, end, data, starts in pieces(batch.column(text)):
                got = measure(data, starts, table)
                arrays = [pa.array(got[c].astype(np.int64)) for c in COUNTS]
                for c in lists:
                    ends = np.arange(0, got[c].size + 1, got[c].shape[1], dtype=np.int32)
                    arrays.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(got[c].astype(np.int32).reshape(-1))))
                counts = pa.StructArray.from_arrays(arrays, names=[*COUNTS, *lists])
                yield pa.RecordBatch.from_arrays([*batch.slice(first, end - first).columns, counts], names=schema.names)

    return docs.mapInArrow(kernel, schema)


def _shares(counts) -> F.Column:
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda acc, x: acc + x)
    return F.transform(counts, lambda x: F.coalesce(F.try_divide(x, total), F.lit(0.0)))


def js_distance(p, q) -> F.Column:
    """Jensen-Shannon distance (base 2) of two arrays of shares."""
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
    terms = F.zip_with(p, q, lambda x, y: (part(x, (x + y) / 2) + part(y, (x + y) / 2)) / 2)
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x)))


def _language(lang: str, languages) -> F.Column:
    return F.when(F.col(lang).isin(*languages), F.col(lang)).otherwise(F.lit(OTHER))


def references(measured: DataFrame, *, lang: str = "lang", languages: dict[str, Sequence[str]] = COMMON_WORDS) -> DataFrame:
    """language, characters, common: mean distributions over all documents that pass the base rules."""
    bins = len(common_words(languages)) + 1
    shares = measured.filter(~base_failed()).select(
        _language(lang, list(languages)).alias("language"),
        _shares(F.col("counts.characters")).alias("characters"),
        _shares(F.col("counts.common")).alias("common"),
    )
    mean = lambda name, n: F.array(*[F.avg(F.col(name)[k]) for k in range(n)]).alias(name)
    return shares.groupBy("language").agg(mean("characters", len(CLASSES)), mean("common", bins))


def base_failed() -> F.Column:
    words = F.col("counts.n_words")
    return (words < MIN_WORDS) | (100 * F.col("counts.n_repeat_words") > 50 * words)


def judged(
    docs: DataFrame,
    *,
    text: str = "text",
    lang: str = "lang",
    languages: dict[str, Sequence[str]] = COMMON_WORDS,
    only: Sequence[str] | None = None,
) -> DataFrame:
    """``docs`` with counts, base_failed, the two distances and kept; ``only`` names the columns to carry along.

    What is measured is written once, as a table of counts. If the text is carried along, it is read
    and measured again for the verdicts instead of being copied into that table.
    """
    carried = list(docs.columns if only is None else only)
    again = text in carried
    counts = counted(docs, text=text, languages=languages)
    measured = materialize(counts.select(lang, "counts") if again else counts.select(*{*carried, lang}, "counts"))
    # At most one row for each stated language and one for all others.
    known = F.broadcast(references(measured, lang=lang, languages=languages).toDF("_language", "_characters", "_common"))
    placed = (counts if again else measured).join(known, _language(lang, list(languages)) == F.col("_language"), "left")
    words = F.col("counts.n_words")
    distance = lambda own, reference: F.coalesce(js_distance(_shares(F.col(own)), F.col(reference)), F.lit(0.0))
    rated = placed.select(
        *carried,
        "counts",
        base_failed().alias("base_failed"),
        distance("counts.characters", "_characters").alias("character_distance"),
        distance("counts.common", "_common").alias("common_word_distance"),
    )
    odd = ((words >= CHARACTER_WORDS) & (F.col("character_distance") > CHARACTER_DISTANCE)) | (
        (words >= COMMON_WORD_WORDS) & (F.col("common_word_distance") > COMMON_WORD_DISTANCE)
    )
    return rated.withColumn("kept", ~F.col("base_failed") & ~odd)
