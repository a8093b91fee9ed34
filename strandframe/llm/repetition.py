"""Repetition inside a single document."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandframe.operators.ranking import top_k
from strandframe.session import cut_lineage

RUN = 3
#: Records with fewer words or characters get no divergence: their histograms say nothing.
MIN_WORDS = 8
MIN_CHARS = 40
#: Common words of a language's histogram.
COMMON_WORDS = 100


def words_of(texts: Column) -> Column:
    """Words (runs of letters, lower case) of an array of texts, joined in order;
    null entries are passed over, runs may cross entries."""
    return F.regexp_extract_all(F.lower(F.array_join(texts, "\n")), F.lit(r"(\p{L}+)"), F.lit(1))


def _once(expression: Column, name: str) -> Column:
    """``expression`` computed once per row: a one-element explode, which the
    optimizer does not merge into the expressions (and lambdas) that use it."""
    return F.explode(F.array(expression)).alias(name)


def sorted_runs(words: Column, run: int = RUN) -> Column:
    """All runs of ``run`` words with their positions, equal ones side by side."""
    shifted = [words, *(F.slice(words, k + 1, F.greatest(F.size(words) - k, F.lit(0))) for k in range(1, run))]
    names = [f"w{k}" for k in range(run)]
    zipped = F.slice(F.arrays_zip(*[column.alias(name) for column, name in zip(shifted, names)]), 1, F.greatest(F.size(words) - run + 1, F.lit(0)))
    return F.sort_array(F.transform(zipped, lambda x, i: F.struct(F.concat_ws(" ", *[x.getField(n) for n in names]).alias("run"), i.alias("at"))))


def covered_words(runs: Column, run: int = RUN) -> Column:
    """How many words lie in a run that equals one starting earlier, from
    ``sorted_runs``: every run but the first of its kind is a repeat, and the
    repeats cover up to ``run`` words each, less what the repeat before covers."""
    before = F.concat(F.array(F.lit(None).cast("struct<run:string,at:int>")), runs)
    later = F.zip_with(runs, before, lambda x, p: F.when(x["run"] == p["run"], x["at"]))
    return F.aggregate(
        F.sort_array(F.array_compact(later)),
        F.struct(F.lit(0).alias("n"), F.lit(-run).alias("last")),
        lambda acc, at: F.struct((acc["n"] + F.least(F.lit(run), at - acc["last"])).alias("n"), at.alias("last")),
        lambda acc: acc["n"],
    )


def repetition(records: DataFrame, id_column: str, texts_column: str, run: int = RUN) -> DataFrame:
    """id, n_words, n_repeated, repeated_share of each row.

    A word is repeated when it lies in a run of ``run`` words that equals a run
    starting earlier in the same row.  Runs are sorted within the row: n log n in
    its words, no shuffle.  The share of a row without words is 0.  Null texts
    count as none; repeated rows stay.
    """
    worded = records.select(id_column, _once(F.coalesce(words_of(F.col(texts_column)), F.array().cast("array<string>")), "_words"))
    runs = worded.select(id_column, F.size("_words").alias("n_words"), _once(sorted_runs(F.col("_words"), run), "_runs"))
    counted = runs.select(id_column, "n_words", covered_words(F.col("_runs"), run).alias("n_repeated"))
    return counted.withColumn("repeated_share", F.coalesce(F.try_divide("n_repeated", "n_words"), F.lit(0.0)))


#: Character classes of the histogram, as ranges of code points;
#: every other character is of one further class.
CLASSES = {
    "latin": "A-Z a-z À-Ö Ø-ö ø-ɏ",
    "cyrillic": "Ѐ-ӿ",
    "kana": "぀-ヿ",
    "han": "一-鿿",
    "digit": "0-9",
    "punctuation": "!-/ :-@ [-` {-~",
}
_SPACE = "\t\n\x0b\f\r "


def class_table() -> np.ndarray:
    """Number of the class of each code point; white space comes after the listed
    classes, the rest last."""
    table = np.full(0x110000, len(CLASSES) + 1, dtype=np.uint8)
    for number, ranges in enumerate(CLASSES.values()):
        for span in ranges.split(" "):
            table[ord(span[0]) : ord(span[2]) + 1] = number
    table[[ord(c) for c in _SPACE]] = len(CLASSES)
    return table


@dataclass(frozen=True)
class LanguageReference:
    """Histograms of the texts of one language: character classes, and its most
    common words with the count of all other words last."""

    lang: str
    classes: list[float]
    words: list[str]
    counts: list[float]


def js_distance(rows: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (base 2) of each row from a histogram; each is
    scaled to sum to 1, an empty one has no share anywhere."""
    p = rows / np.maximum(rows.sum(axis=1, keepdims=True), 1e-300)
    q = np.broadcast_to(reference / max(reference.sum(), 1e-300), p.shape)
    with np.errstate(divide="ignore", invalid="ignore"):
        part = [np.where(a > 0, a * np.log2(2 * a / (p + q)), 0.0) for a in (p, q)]
    return np.sqrt(np.maximum((part[0] + part[1]).sum(axis=1) / 2, 0.0))


def _histograms(texts: pa.Array, table: np.ndarray, index: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class counts, counts of the words of ``index`` and of all others, words) of each text."""
    n, width = len(texts), len(index) + 1
    points = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), dtype=np.uint32)
    row = np.repeat(np.arange(n), pc.utf8_length(texts).to_numpy(zero_copy_only=False))
    classes = np.bincount(row * (len(CLASSES) + 2) + table[points], minlength=n * (len(CLASSES) + 2)).reshape(n, -1)
    lists = pc.split_pattern_regex(pc.utf8_lower(texts), r"[^\p{L}]+")
    flat, owner = pc.list_flatten(lists), pc.list_parent_indices(lists).to_numpy()
    filled = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    coded = pc.dictionary_encode(flat)
    place = np.array([index.get(w, width - 1) for w in coded.dictionary.to_pylist()] or [0])[coded.indices.to_numpy()]
    words = np.bincount(owner[filled] * width + place[filled], minlength=n * width).reshape(n, width)
    return classes, words, words.sum(axis=1)


def language_references(documents: DataFrame, text: str, lang: str, common: int = COMMON_WORDS) -> list[LanguageReference]:
    """References of all languages of ``documents``, over all their texts: one
    scan, summed per task before the shuffle.  Languages are compared by their
    first two or three letters, so their number, and with it what reaches the
    driver (``common`` words each), is bounded.  Null texts and languages are left
    out."""
    code = F.nullif(F.regexp_extract(F.lower(F.trim(lang)), r"^([a-z]{2,3})(?![a-z])", 1), F.lit(""))
    tagged = documents.select(code.alias("lang"), F.col(text).alias("text")).where("lang is not null and text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = class_table()
        for batch in batches:
            for value in pc.unique(batch.column("lang")).to_pylist():
                texts = batch.column("text").filter(pc.equal(batch.column("lang"), value))
                classes = _histograms(texts, table, {})[0].sum(axis=0)
                words = pc.value_counts(pc.list_flatten(pc.split_pattern_regex(pc.utf8_lower(texts), r"[^\p{L}]+")))
                word, n = words.field("values"), words.field("counts")
                names = pa.array([f"{i}" for i in range(len(classes))])
                kind = pa.array(["class"] * len(names) + ["word"] * len(word))
                yield pa.RecordBatch.from_arrays([pa.array([value] * len(kind)), kind, pa.concat_arrays([names, word]), pa.concat_arrays([pa.array(classes, pa.int64()), n])], names=["lang", "kind", "name", "n"])

    counts = tagged.mapInArrow(run, "lang string, kind string, name string, n bigint").where("name <> ''").groupBy("lang", "kind", "name").agg(F.sum("n").alias("n"))
    counts = cut_lineage(counts)
    top = top_k(counts.where("kind = 'word'"), ["lang"], common, [F.desc("n"), F.col("name")]).collect()
    sums = {r["lang"]: r["n"] for r in counts.where("kind = 'word'").groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    classes: dict[str, list[float]] = {}
    for r in counts.where("kind = 'class'").collect():
        classes.setdefault(r["lang"], [0.0] * (len(CLASSES) + 2))[int(r["name"])] = float(r["n"])
    references = []
    for name in sorted(classes):
        best = sorted(((r["n"], r["name"]) for r in top if r["lang"] == name), key=lambda x: (-x[0], x[1]))
        references.append(LanguageReference(name, classes[name], [w for _, w in best], [*(float(n) for n, _ in best), float(sums.get(name, 0) - sum(n for n, _ in best))]))
    return references


def divergence(records: DataFrame, id_column: str, texts_column: str, references: list[LanguageReference]) -> DataFrame:
    """Jensen-Shannon distance of each row's histograms from the nearest language.

    Result: id, n_words, n_chars, class_distance, word_distance: the least distance
    of the character classes, and of the common words, from those of a language;
    the texts of a row are joined by line breaks.  Rows with fewer than MIN_WORDS
    words or MIN_CHARS characters, and all rows without references, get null
    distances.  One scan, array operations per batch, no shuffle; the references
    (a few hundred numbers a language) go with the task.
    """
    index = {w: i for i, w in enumerate(sorted({w for r in references for w in r.words}))}
    columns = [np.array([index[w] for w in r.words], dtype=np.int64) for r in references]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = class_table()
        for batch in batches:
            texts = batch.column(1)
            classes, words, n_words = _histograms(texts, table, index)
            n_chars = pc.utf8_length(texts).to_numpy(zero_copy_only=False)
            near = np.full((2, len(texts)), np.inf)
            for reference, at in zip(references, columns):
                own = words[:, at]
                own = np.column_stack([own, n_words - own.sum(axis=1)])
                near[0] = np.minimum(near[0], js_distance(classes, np.array(reference.classes)))
                near[1] = np.minimum(near[1], js_distance(own, np.array(reference.counts)))
            silent = (n_words < MIN_WORDS) | (n_chars < MIN_CHARS) | np.isinf(near[0])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_chars, pa.int64()), *(pa.array(d, pa.float64(), mask=silent) for d in near)], names=[id_column, "n_words", "n_chars", "class_distance", "word_distance"])

    kind = dict(records.dtypes)[id_column]
    text = F.coalesce(F.array_join(texts_column, "\n"), F.lit(""))
    return records.select(id_column, text.alias("_text")).mapInArrow(run, f"`{id_column}` {kind}, n_words bigint, n_chars bigint, class_distance double, word_distance double")
