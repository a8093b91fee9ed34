"""Tolerant text parsing as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that do not tell one thing from another.
STOP_WORDS = (
    "the", "a", "an", "is", "are", "of", "in", "on", "and", "or", "to", "with", "that", "this", "it", "its", "as", "by", "for", "be", "can", "may", "game",
    "player", "character", "when", "which", "from", "at", "while", "into",
)


def token_set(text: Column, stop: tuple[str, ...] = STOP_WORDS) -> Column:
    """Distinct lower-case runs of a-z longer than two letters, without stop words, sorted."""
    words = F.regexp_extract_all(F.lower(text), F.lit("([a-z]+)"), F.lit(1))
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*stop))))


def token_key(text: Column) -> Column:
    """The token set as one string, or the text itself where it has no token."""
    return F.coalesce(F.nullif(F.array_join(token_set(text), " "), F.lit("")), text)


def repair_json(text: Column) -> Column:
    """JSON-like text made JSON: curly quotes, trailing commas, Python literals,
    then single-quoted strings."""
    fixed = F.translate(text, "“”‘’", "\"\"''")
    fixed = F.regexp_replace(fixed, r",\s*([}\]])", "$1")
    for word, value in (("True", "true"), ("False", "false"), ("None", "null")):
        fixed = F.regexp_replace(fixed, rf"\b{word}\b", value)
    return F.regexp_replace(fixed, r"'([^'\"]*)'(\s*[:,}\]])", '"$1"$2')


def balanced_object(text: Column) -> Column:
    """The first ``{...}`` of a text whose braces balance outside strings, or null.
    A fold over the characters, linear in the text."""
    start = F.locate("{", text)
    chars = F.filter(F.split(F.substr(text, F.greatest(start, F.lit(1))), ""), lambda c: c != "")
    first = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(False).alias("escaped"), F.lit(0).alias("n"), F.lit(0).alias("end"))

    def step(s: Column, c: Column) -> Column:
        live = s["end"] == 0
        quote = (c == '"') & ~s["escaped"]
        depth = s["depth"] + F.when(~s["quoted"] & (c == "{"), 1).when(~s["quoted"] & (c == "}"), -1).otherwise(0)
        return F.struct(
            F.when(live, depth).otherwise(s["depth"]).alias("depth"),
            F.when(quote, ~s["quoted"]).otherwise(s["quoted"]).alias("quoted"),
            (s["quoted"] & (c == "\\") & ~s["escaped"]).alias("escaped"),
            (s["n"] + 1).alias("n"),
            F.when(live & (depth == 0) & (c == "}"), s["n"] + 1).otherwise(s["end"]).alias("end"),
        )

    end = F.aggregate(chars, first, step, lambda s: s["end"])
    return F.when((start > 0) & (end > 0), F.substr(text, start, end))


def extract_json(text: Column) -> Column:
    """The JSON object in a text as a JSON string: from a fence tagged json, then
    from any fence, then the first balanced braces, then the whole text; each as
    it is, then repaired.  Only objects count; null when there is none."""
    tagged = F.regexp_extract(text, r"(?s)```json\s*(.*?)```", 1)
    fenced = F.regexp_extract(text, r"(?s)```[A-Za-z]*\s*(.*?)```", 1)
    tries = []
    for part in (tagged, fenced, balanced_object(text), text):
        for form in (F.trim(part), F.trim(repair_json(part))):
            tries.append(F.when(form.startswith("{") & F.try_parse_json(form).isNotNull(), form))
    return F.coalesce(*tries)


def parse_rating(text: Column) -> Column:
    """struct<rating:int,failed:boolean>: the integer ``rating`` of the JSON in a
    text, floats truncated, missing 0; unparsable 0 and failed."""
    found = extract_json(text)
    raw = F.get_json_object(found, "$.rating")
    number = raw.try_cast("double")
    failed = found.isNull() | (raw.isNotNull() & number.isNull())
    return F.struct(F.coalesce(F.when(number >= 0, F.floor(number)).otherwise(F.ceil(number)).cast("int"), F.lit(0)).alias("rating"), failed.alias("failed"))


def truthy(text: Column) -> Column:
    """True for ``true``, ``yes`` and ``1`` in any case; else false."""
    return F.coalesce(F.lower(F.trim(text)).isin("true", "yes", "1"), F.lit(False))


def number_grid(text: Column) -> Column:
    """Numbers of a comma list; what is no number is left out."""
    return F.array_compact(F.transform(F.split(text, ","), lambda x: F.trim(x).try_cast("double")))


def first_filled(*values: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values])


def decode_spans(text: Column) -> Column:
    """array<array<array<double>>> from JSON text of nested, single or flat spans;
    empty entries stay as empty arrays, so positions hold.  Null when the text is
    none of these."""
    nested = F.from_json(text, "array<array<array<double>>>", {"mode": "PERMISSIVE"})
    single = F.from_json(text, "array<array<double>>", {"mode": "PERMISSIVE"})
    flat = F.from_json(text, "array<double>", {"mode": "PERMISSIVE"})
    depth = F.length(F.regexp_extract(F.regexp_replace(text, r"\s", ""), r"^(\[+)", 1))
    return F.when(depth >= 3, nested).when(depth == 2, F.transform(single, lambda s: F.array(s))).when((depth == 1) & (F.size(flat) == 2), F.array(F.array(flat)))


def strip_fences(text: Column) -> Column:
    """A summary without fenced blocks, trimmed; null when nothing is left."""
    return F.nullif(F.trim(F.regexp_replace(text, r"(?s)```.*?```", "")), F.lit(""))


def event_summary(descriptions: Column, written: Column) -> Column:
    """The summary of an event's descriptions: a single one as it is; else the
    model's text without fenced blocks, or the first description where nothing is
    left of it; null without descriptions."""
    first = F.get(descriptions, F.lit(0))
    return F.when(F.size(descriptions) == 1, first).when(F.size(descriptions) > 1, F.coalesce(strip_fences(written), first))


def fill_template(template: str, **values: Column) -> Column:
    """``template`` with each {name} replaced by the value of that name; null values
    read as empty.  Names without a value stay as they are."""
    parts = re.split(r"(\{\w+\})", template)
    filled = [F.coalesce(values[p[1:-1]].cast("string"), F.lit("")) if re.fullmatch(r"\{\w+\}", p) and p[1:-1] in values else F.lit(p) for p in parts if p]
    return F.concat(*filled) if filled else F.lit("")


def seeded_noise(key: Column) -> Column:
    """A number from a string, about normal with mean 0 and variance 1: the sum of
    the first twelve bytes of its SHA-256, each over 255, less 6."""
    digest = F.sha2(key, 256)
    return sum((F.conv(F.substring(digest, 2 * i + 1, 2), 16, 10).cast("double") / 255 for i in range(12)), F.lit(0.0)) - 6
