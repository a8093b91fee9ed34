"""Texts cut off by field limits or in transfer."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandframe.operators.skew import salted_join
from strandframe.session import cut_lineage

#: A phrase ends here by habit when at least this share of its occurrences ends here.
ENDING_SHARE = 0.06
#: Texts of up to so many words may be notes without a sentence; so may longer
#: ones that begin with a small letter.
NOTE_WORDS = 3
SMALL_NOTE_WORDS = 6
#: A length is a field limit of a source when LIMIT_SHARE of its unfinished texts
#: have it, LIMIT_PEAK times as many as any of the lengths near, and the logarithm
#: of the odds against a chance excess over them is LIMIT_CHANCE or more.
LIMIT_CHANCE = 10.0
LIMIT_PEAK = 5
LIMIT_SHARE = 0.01
NEAR = 4

#: How a text looks whose author finished it, and what is left of
#: markup when a text breaks off.
FINISHED = r"[.!?。！？)\]}»”:*]$|(:|;|=)-?[()DPp]$"
ELLIPSIS = r"(\.{3,}|…)$"
DANGLING = r"(�|,|\\(u[0-9a-fA-F]{0,3})?|\s[\[({\"']+|&#?[0-9A-Za-z]{0,6}|%[0-9A-Fa-f]?)$"
STOP_AFTER = r"[.!?;…。！？][\"')\]]*$"


def _once(expression: Column, name: str) -> Column:
    return F.explode(F.array(expression)).alias(name)


def _phrases(body: Column) -> Column:
    """Words of a text, plain and in lower case, with whether a sentence stops after each."""
    tokens = F.split(F.trim(body), r"\s+")
    return F.transform(tokens, lambda t: F.struct(F.regexp_replace(F.lower(t), r"^[^\p{L}\p{N}#]+|[^\p{L}\p{N}_]+$", "").alias("w"), t.rlike(STOP_AFTER).alias("stop")))


def _windows(marked: Column) -> Column:
    """(a, b, c, stop, last) of every word c with the two words before it in the
    same sentence (``^`` before its start)."""
    edge = F.struct(F.lit("^").alias("w"), F.lit(True).alias("stop"))
    zipped = F.arrays_zip(F.concat(F.array(edge, edge), marked).alias("p"), F.concat(F.array(edge), marked).alias("q"), marked.alias("r"))
    rows = F.slice(zipped, 1, F.size(marked))
    return F.transform(rows, lambda x, i: F.struct(
        F.when(x["q"]["stop"] | x["p"]["stop"], F.lit("^")).otherwise(x["p"]["w"]).alias("a"),
        F.when(x["q"]["stop"], F.lit("^")).otherwise(x["q"]["w"]).alias("b"),
        x["r"]["w"].alias("c"),
        x["r"]["stop"].alias("stop"),
        (i == F.size(marked) - 1).alias("last"),
    ))


#: Sorts after every character of a word.
LAST = "\U0010ffff"
LEVELS = (3, 2, 1)


def word_counts(texts: DataFrame) -> DataFrame:
    """(level, context, word) with how often the word ends a sentence, breaks off
    the text, or goes on after the context, over the distinct texts of column
    ``body``.  The context is the two words before (level 3), one (2) or none (1).
    Aggregated before the shuffle."""
    rows = texts.select(_once(_phrases(F.col("body")), "m")).select(F.explode(_windows(F.col("m"))).alias("x")).select("x.*").where("c <> ''")
    levelled = rows.select(F.explode(F.array(*[F.struct(F.lit(n).alias("level"), context.alias("context")) for n, context in _contexts()])).alias("l"), "c", "stop", "last")
    return levelled.groupBy("l.level", "l.context", F.col("c").alias("word")).agg(F.count_if("stop").alias("n_end"), F.count_if(~F.col("stop") & F.col("last")).alias("n_open"), F.count_if(~F.col("stop") & ~F.col("last")).alias("n_on"))


def _contexts() -> list[tuple[int, Column]]:
    return [(3, F.concat_ws(" ", "a", "b")), (2, F.col("b")), (1, F.lit(""))]


def tail_endings(counts: DataFrame, tails: DataFrame) -> DataFrame:
    """For each tail (a, b, c; distinct, with ``n_texts``; c possibly half a word)
    and level: n_end, n_open, n_on of the same words, and n_longer, the uses of
    all longer words in that context of which c is a strict prefix.

    Self-join by prefix: the words of a context are sorted by range over the
    cluster, where the longer copies of a word directly follow it.  Three marks
    of each tail are sorted in, before and behind its word and behind its last
    longer copy; running sums of the counts at the marks give both numbers as
    differences.  No word is looked at twice, whatever its length or weight.
    """
    marks = [(F.col("c"), 0, -1, 0), (F.col("c"), 2, 1, -1), (F.concat("c", F.lit(LAST)), 0, 0, 1)]
    probes = F.array(*[
        F.struct(F.lit(n).alias("level"), context.alias("context"), word.alias("word"), F.lit(kind).alias("kind"), F.lit(own).alias("own"), F.lit(longer).alias("longer"))
        for n, context in _contexts() for word, kind, own, longer in marks
    ])
    none = F.lit(0).cast("bigint")
    asked = tails.select(F.explode(probes).alias("p"), "a", "b", "c", "n_texts").select("p.*", none.alias("n_end"), none.alias("n_open"), none.alias("n_on"), "a", "b", "c", "n_texts")
    text, count = F.lit(None).cast("string"), F.lit(None).cast("bigint")
    said = counts.select("level", "context", "word", F.lit(1).alias("kind"), F.lit(0).alias("own"), F.lit(0).alias("longer"), "n_end", "n_open", "n_on", text.alias("a"), text.alias("b"), text.alias("c"), count.alias("n_texts"))
    order = ["level", "context", "word", "kind", "a", "b"]
    ranged = said.unionByName(asked).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    sums = ("n_end", "n_open", "n_on")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reached, part = np.zeros(3, dtype=np.int64), None
        for batch in batches:
            if not batch.num_rows:
                continue
            part = part or batch.column("part").slice(0, 1)
            upto = np.cumsum([batch.column(name).to_numpy() for name in sums], axis=1) + reached[:, None]
            reached = upto[:, -1]
            at = np.flatnonzero(batch.column("kind").to_numpy() != 1)
            yield pa.RecordBatch.from_arrays([*(batch.column(name).take(pa.array(at)) for name in kept), *(pa.array(row[at]) for row in upto)], schema=schema)
        if part is not None:
            empty = [pa.nulls(1, field.type) for field in list(schema)[: len(kept) - 1]]
            yield pa.RecordBatch.from_arrays([*empty, part, *(pa.array([n]) for n in reached)], schema=schema)

    kept = ["level", "own", "longer", "a", "b", "c", "n_texts", "part"]
    schema = pa.schema([("level", pa.int32()), ("own", pa.int32()), ("longer", pa.int32()), ("a", pa.string()), ("b", pa.string()), ("c", pa.string()), ("n_texts", pa.int64()), ("part", pa.int32()), *((name, pa.int64()) for name in sums)])
    marked = cut_lineage(ranged.mapInArrow(run, "level int, own int, longer int, a string, b string, c string, n_texts bigint, part int, n_end bigint, n_open bigint, n_on bigint"))
    # one row of each partition
    before, carried = np.zeros(3, dtype=np.int64), []
    for row in sorted(marked.where("level is null").collect(), key=lambda r: r["part"]):
        carried.append((row["part"], *map(int, before)))
        before = before + [row[name] for name in sums]
    carry = tails.sparkSession.createDataFrame(carried, "part int, " + ", ".join(f"b_{name} bigint" for name in sums))
    whole = marked.where("level is not null").join(F.broadcast(carry), "part").select("level", "own", "longer", "a", "b", "c", "n_texts", *[(F.col(name) + F.col(f"b_{name}")).alias(name) for name in sums])
    all_uses = F.col("n_end") + F.col("n_open") + F.col("n_on")
    measures = {name: F.col("own") * F.col(name) for name in sums} | {"n_longer": F.col("longer") * all_uses}
    return whole.groupBy("a", "b", "c").agg(F.first("n_texts").alias("n_texts"), *[F.sum(F.when(F.col("level") == level, value)).alias(f"{name}{level}") for level in LEVELS for name, value in measures.items()])


_SPACE = " \t\n\x0b\f\r"


def goes_on(body: str, rest: str) -> tuple[bool, bool]:
    """Whether ``rest``, which follows ``body`` in a longer copy, goes on (in the
    middle of a word, within the sentence)."""
    kind = unicodedata.category(rest[0])
    nearest = rest.lstrip(_SPACE)[:1]
    within = bool(nearest) and (unicodedata.category(nearest) == "Ll" or unicodedata.category(nearest)[0] == "N")
    return kind[0] in "LN" and unicodedata.category(body[-1])[0] == "L", within


class _Held:
    """A text whose longer copies are being read, and how they go on."""

    __slots__ = ("mid_word", "rows", "text", "within")

    def __init__(self, text: str, rows: int) -> None:
        self.text, self.rows, self.mid_word, self.within = text, rows, False, False

    def add(self, mid_word: bool, within: bool) -> None:
        self.mid_word |= mid_word
        self.within |= within


def longer_copies(texts: DataFrame, scope: str, body: str, rows: str) -> DataFrame:
    """(scope, body, rows, mid_word, within): texts that are strict prefixes of
    longer texts of the same scope, of which at least one goes on in the middle of
    a word (``mid_word``) or within the sentence (``within``).

    ``texts`` is unique on (scope, body); bodies are not empty and do not end in
    white space.  The texts are sorted by range over the cluster, where the longer
    copies of a text directly follow it.  A stack holds the prefixes of the text
    being read; each text tells how its nearest prefix goes on, and thereby how
    all shorter ones do, so every longer copy counts in one pass.  Of each
    partition the stack at its end and, at its start, what tells of prefixes in
    the partitions before are merged on the driver: a few rows a partition.
    """
    schema = pa.schema([("kind", pa.string()), ("part", pa.int32()), ("s", pa.string()), ("t", pa.string()), ("rows", pa.int64()), ("at", pa.int32()), ("mid_word", pa.bool_()), ("within", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[_Held] = []
        current, part, first, shared, at_first = None, None, None, 0, {}
        for batch in batches:
            out = []
            if part is None and batch.num_rows:
                part, current, first = (batch.column(i)[0].as_py() for i in (3, 0, 1))
                shared = len(first)
                out.append(("head", part, current, first, None, None, None, None))
            for s, t, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if s != current:
                    out.extend(("done", None, current, h.text, h.rows, None, h.mid_word, h.within) for h in stack if h.mid_word or h.within)
                    stack, current, shared = [], s, 0
                while stack and not t.startswith(stack[-1].text):
                    h = stack.pop()
                    if h.mid_word or h.within:
                        out.append(("done", None, s, h.text, h.rows, None, h.mid_word, h.within))
                if stack:
                    stack[-1].add(*goes_on(stack[-1].text, t[len(stack[-1].text) :]))
                elif shared:
                    while not t.startswith(first[:shared]):
                        shared -= 1
                    at = len(first[:shared].rstrip(_SPACE))
                    if 0 < at < len(t):
                        at_first.setdefault(at, _Held(first, 0)).add(*goes_on(t[:at], t[at:]))
                stack.append(_Held(t, n))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(column, field.type) for column, field in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
        if part is not None:
            out = [("start", part, None, None, None, at, h.mid_word, h.within) for at, h in at_first.items()]
            out += [("tail", part, current, h.text, h.rows, i, h.mid_word, h.within) for i, h in enumerate(stack)]
            yield pa.RecordBatch.from_arrays([pa.array(column, field.type) for column, field in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    ranged = texts.select(F.col(scope).alias("s"), F.col(body).alias("t"), F.col(rows).cast("bigint").alias("rows")).repartitionByRange("s", "t").sortWithinPartitions("s", "t").withColumn("part", F.spark_partition_id())
    marked = cut_lineage(ranged.mapInArrow(run, "kind string, part int, s string, t string, rows bigint, at int, mid_word boolean, within boolean"))
    across = merge_partitions(marked.where("kind <> 'done'").collect())
    ends = texts.sparkSession.createDataFrame(across, "s string, t string, rows bigint, mid_word boolean, within boolean")
    both = marked.where("kind = 'done'").select("s", "t", "rows", "mid_word", "within").unionByName(ends)
    return both.select(F.col("s").alias(scope), F.col("t").alias(body), "rows", "mid_word", "within")


def merge_partitions(rows: list) -> list[tuple]:
    """The texts at the ends of the partitions that are prefixes of longer ones,
    from what ``longer_copies`` tells of each partition, in the order of the
    partitions: the text at its start (head), how the texts at its start leave
    that text (start), and the stack at its end (tail)."""
    parts: dict[int, dict] = {}
    for row in rows:
        parts.setdefault(row["part"], {"head": [], "start": [], "tail": []})[row["kind"]].append(row)
    stack: list[tuple[str, _Held]] = []
    done: list[tuple] = []

    def leave() -> None:
        scope, held = stack.pop()
        if held.mid_word or held.within:
            done.append((scope, held.text, held.rows, held.mid_word, held.within))

    for part in sorted(parts):
        head = parts[part]["head"][0]
        while stack and not (stack[-1][0] == head["s"] and head["t"].startswith(stack[-1][1].text)):
            leave()
        leaves = {row["at"]: row for row in parts[part]["start"]}
        for _, held in stack:
            held.add(*goes_on(held.text, head["t"][len(held.text) :]))
            row = leaves.get(len(held.text))
            if row:
                held.add(row["mid_word"], row["within"])
        tail = sorted(parts[part]["tail"], key=lambda row: row["at"])
        while stack and not (stack[-1][0] == tail[-1]["s"] and tail[-1]["t"].startswith(stack[-1][1].text)):
            leave()
        for row in tail:
            held = _Held(row["t"], row["rows"])
            held.add(row["mid_word"], row["within"])
            stack.append((row["s"], held))
    while stack:
        leave()
    return done


def field_limits(shapes: DataFrame) -> DataFrame:
    """(source, chars, bytes, rows) at which a source cuts texts off, from
    ``shapes``: source, chars, bytes, n (distinct unfinished texts), rows.  A
    length in characters or in bytes that stands out among its neighbours is a
    limit: its excess is beyond chance (a likelihood ratio, so no fixed number of
    texts is asked for), large, and not a rarity of its source."""
    both = shapes.select("source", "n", F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.col("chars").alias("size")), F.struct(F.lit("bytes").alias("unit"), F.col("bytes").alias("size")))).alias("m"))
    sizes = both.groupBy("source", "m.unit", "m.size").agg(F.sum("n").alias("n"))
    spread = F.explode(F.array([F.struct((F.col("size") + d).alias("size"), (F.col("n") if d == 0 else F.lit(0)).alias("n"), (F.lit(0) if d == 0 else F.col("n")).alias("near")) for d in range(-NEAR, NEAR + 1)]))
    around = sizes.select("source", "unit", spread.alias("e")).groupBy("source", "unit", "e.size").agg(F.sum("e.n").alias("n"), F.max("e.near").alias("top"), F.sum("e.near").alias("near")).where("n > 0")
    whole = shapes.groupBy("source").agg(F.sum("n").alias("n_source"))
    expected = (F.col("near") + 0.5) / (2 * NEAR)
    chance = F.col("n") * F.log(F.col("n") / expected) - (F.col("n") - expected)
    limits = around.join(whole, "source").where((chance >= LIMIT_CHANCE) & (F.col("n") >= LIMIT_SHARE * F.col("n_source")) & (F.col("n") >= LIMIT_PEAK * F.col("top")))
    by_source = limits.groupBy("source").agg(*[F.collect_set(F.when(F.col("unit") == unit, F.col("size"))).alias(f"l_{unit}") for unit in ("chars", "bytes")])
    return shapes.join(by_source, "source").where(F.array_contains("l_chars", F.col("chars")) | F.array_contains("l_bytes", F.col("bytes"))).select("source", "chars", "bytes", "rows")


def unfinished_tails(texts: DataFrame) -> DataFrame:
    """(body, by_phrase) of the distinct open texts whose last words hardly ever
    end a phrase elsewhere, all others left out.  ``texts``: body, plain, open,
    broken, owners."""
    counts = word_counts(texts.select(F.col("plain").alias("body")))
    tail = F.element_at(_windows(F.col("m")), -1)
    tails = texts.where("open and not broken").select("body", "owners", _once(_phrases(F.col("plain")), "m")).select("body", "owners", F.size("m").alias("n_words"), _once(tail, "x")).select("body", "owners", "n_words", F.col("body").rlike(r"^\p{Ll}").alias("small"), "x.a", "x.b", "x.c").where("c <> ''")
    asked = tails.groupBy("a", "b", "c").agg(F.count("*").alias("n_texts"))
    verdict = salted_join(tails, cut_lineage(tail_endings(counts, asked)), ["a", "b", "c"], "n_texts", ["body"])
    plain_word = F.col("c").rlike(r"^\p{L}[\p{L}'’\-]*$")
    small_note = F.col("small") & (F.col("n_words") <= SMALL_NOTE_WORDS)
    note = small_note | (F.col("n_words") <= NOTE_WORDS)
    # hardly ever a word of its own, but the start of longer ones
    half_word = plain_word & (F.col("n_longer1") > 0) & (F.col("n_end1") + F.col("n_on1") < ENDING_SHARE * F.col("n_longer1")) & (F.col("n_open1") <= F.col("n_longer1"))
    cases = []
    for level in LEVELS:
        ends = F.col(f"n_end{level}") + F.greatest(F.col(f"n_open{level}") - 1, F.lit(0))
        if level == 3:  # a note that many owners write as it is, is whole, unless longer copies show half a word
            ends = ends + F.when(note & ~(half_word & (F.col("n_longer3") > 0)), F.col("owners") - 1).otherwise(F.lit(0))
        # a small note goes on only where its last word does; numbers do not
        goes = F.when(small_note, F.lit(0)).otherwise(F.col(f"n_on{level}")) + F.when(plain_word, F.col(f"n_longer{level}")).otherwise(F.lit(0))
        cases.append((ends + goes > 0, ends < ENDING_SHARE * (ends + goes)))
    # of a note of a few words, only the whole note tells how it goes on; one
    # word alone says that it is half a word, not that a sentence goes on
    stops = F.when(cases[0][0], cases[0][1]).when(cases[1][0] & ~note, cases[1][1]).otherwise(half_word)
    return verdict.where(stops & (plain_word | cases[0][0])).select("body", F.lit(True).alias("by_phrase"))


def cut_texts(entries: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep``, ``source`` and ``reason`` of the entries whose text
    was cut off.

    ``entries``: keep, text, source, owner (whose copies of a text count as the
    same text).  Null and blank texts are not cut; every copy of a cut text is
    reported.  Reasons, the first that holds:

    - ``broken``: a broken character, a comma, or half an escape or opened quote
      or bracket at the end;
    - ``limit``: unfinished, and as long as the field limit of the source;
    - ``copy``: a strict prefix of a longer copy of the same owner, which goes on
      within the sentence, or of any text in the middle of a word;
    - ``phrase``: the last words are a strict prefix of phrases elsewhere and
      hardly ever end one.

    A text that looks finished (a full stop, a bracket closed and so on) is not
    cut, nor is an informal one whose last words end phrases elsewhere or are
    unknown.  All counts cover all distinct texts.
    """
    plain = F.regexp_replace("body", ELLIPSIS, "")
    broken = F.col("body").rlike(DANGLING)
    body = F.rtrim(F.regexp_replace("text", r"[\s ]+$", ""))
    ready = entries.select(*keep, "source", "owner", body.alias("body"), F.length("text").alias("chars"), F.octet_length("text").alias("bytes")).where(F.length("body") > 0)
    # copies of one owner, and all of unknown owners, speak once
    owned = ready.groupBy("owner", "body").agg(F.count("*").alias("rows"))
    texts = owned.groupBy("body").agg(F.sum("rows").alias("rows"), F.count("*").alias("owners"))
    texts = cut_lineage(texts.withColumn("plain", plain).withColumn("broken", broken).withColumn("open", ~F.col("plain").rlike(FINISHED) | F.col("broken")))

    scoped = owned.where("owner is not null").select(F.concat(F.lit("o"), "owner").alias("scope"), "body", "rows")
    copies = longer_copies(scoped.unionByName(texts.select(F.lit("").alias("scope"), "body", "rows")), "scope", "body", "rows")
    by_owner = copies.where("scope <> '' and within").select(F.expr("substring(scope, 2)").alias("owner"), "body", "rows", F.lit(True).alias("by_owner"))
    by_any = copies.where("scope = '' and mid_word").select("body", F.lit(True).alias("by_any"))
    by_text = texts.where("open").select("body", "rows").join(unfinished_tails(texts), "body", "left").join(by_any, "body", "left").where("by_phrase or by_any")

    opened = ready.withColumn("plain", plain).withColumn("broken", broken).where(~F.col("plain").rlike(FINISHED) | F.col("broken")).withColumn("dots", F.col("plain") != F.col("body")).drop("plain")
    distinct = opened.where("source is not null and not dots").groupBy("source", "chars", "bytes", "body").agg(F.count("*").alias("rows"))
    limits = field_limits(distinct.groupBy("source", "chars", "bytes").agg(F.count("*").alias("n"), F.sum("rows").alias("rows")))

    judged = salted_join(opened, cut_lineage(by_text), ["body"], "rows", keep, "left")
    judged = salted_join(judged, by_owner, ["owner", "body"], "rows", keep, "left")
    judged = salted_join(judged, cut_lineage(limits.withColumn("at_limit", ~F.lit(False))), ["source", "chars", "bytes"], "rows", keep, "left")
    reason = F.when(F.col("broken"), "broken").when(F.col("at_limit") & ~F.col("dots"), "limit").when(F.col("by_owner") | F.col("by_any"), "copy").when(F.col("by_phrase"), "phrase")
    return judged.select(*keep, "source", reason.alias("reason")).where("reason is not null")


def cut_report(entries: DataFrame, cut: DataFrame) -> DataFrame:
    """Entries, cut entries and their share per source (null source included)."""
    n = entries.where(F.length(F.trim("text")) > 0).groupBy("source").agg(F.count("*").alias("n_entries"))
    lost = cut.groupBy("source").agg(F.count("*").alias("n_cut"))
    joined = n.alias("n").join(lost.alias("l"), F.col("n.source").eqNullSafe(F.col("l.source")), "left")
    count = F.coalesce("l.n_cut", F.lit(0).cast("bigint"))
    return joined.select("n.source", "n.n_entries", count.alias("n_cut"), (count / F.col("n.n_entries")).alias("cut_share"))
