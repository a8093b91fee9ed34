"""Abusive, hateful and sexually explicit language, by ordinal regression."""

from __future__ import annotations

import itertools
import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from pydoc_data import topics

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandframe.functions.keys import source_form
from strandframe.llm.abuse_labels import ABUSE, COMMON, HARMLESS, SLOTS

#: Each labelled sentence with slots is filled so many ways at most; with the
#: number of sentences this bounds the training rows.
FILLS = 24
#: So many further rows are labelled sentences put together, for texts that mix them.
JOINED = 3000
#: Documents of this expected severity or more are to be reviewed.
REVIEW = 0.6
GRADES = 4
#: Cut between grades 0 and 1: a sentence without known features has a score of
#: 0 and thus a chance of 1 in 21 of being abuse.
FIRST_CUT = 3.0
#: A feature is a number of 64 bits, found by its first BITS bits.
BITS = 22
#: Letters of the beginning of a word that stand for its inflections.
STEM = 5
#: Value of a piece of a word beside that of the word, which is 1.
PIECE = 0.5
#: Value of a pair or triple of words.
NEIGHBOURS = 0.3
#: Share of the harmless rows in the fit.
HARMLESS_SHARE = 0.7
#: At most so many sentences of a manual are further harmless rows, of this weight.
PROSE = 3000
PROSE_WEIGHT = 0.3
#: Strength of the ridge of the fit.
RIDGE = 2e-5
#: Words at most so far apart are also read as a pair.
REACH = 4

#: Characters that are written for others.
LEET = str.maketrans("013457$@!|", "oieastsaii")
LOOKALIKE = str.maketrans("асеорхуікмтнвѕԁԛɡοανι", "aceopxyikmthbsdqgoavi")

_HIDDEN = r"[\p{Cf}\p{Mn}\p{Co}]+"
_SENTENCE = r"[.!?…;:]+(?:\s+|$)|[。！？\n\r\"“”„«»()\[\]{}|]+|\s[\-/–—]\s"
_CLAUSE = r"[,，、]+"
_BETWEEN = r"[^\p{L}\p{M}\p{N}@$*!'’_\-]+"
_MAY_BE_SPACED = r"[\p{L}\p{N}][ ._\-][\p{L}\p{N}][ ._\-][\p{L}\p{N}](?:[^\p{L}\p{N}]|$)"
_SPACED = re.compile(r"(?<![^\W_])[^\W_](?:([\s_\-.])[^\W_])(?:\1[^\W_])+(?![^\W])_?")
_CJK = re.compile(r"[぀-ヿ㐀-鿿가-힣]")
_HIRAGANA = re.compile(r"[ぁ-ゟー]{2}")
_LATIN, _OTHER = re.compile(r"[a-z]"), re.compile(r"[Ѐ-ӿͰ-Ͽɑ-ɡ]")
_THREE = re.compile(r"(.)\1{2,}")
_TWO = re.compile(r"(.)\1+")
_PARTED = re.compile(r"(?:\w[_\-])+\w?")

_MIX = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)]


def plain_word(token: str) -> str:
    """A token in lower case as it would be written plainly: look-alike letters,
    digits and signs for letters, stretched letters and inner marks undone."""
    word = token.strip("!'’_-").replace("’", "'")
    if _OTHER.search(word) and _LATIN.search(word):
        word = word.translate(LOOKALIKE)
    if "*" not in word and _LATIN.search(word) and re.search(r"[0-9$@!]", word):
        word = word.translate(LEET)
    elif re.fullmatch(r"[0-9$]{3,}", word) and re.search(r"[0-9]", word) and "$" in word[1:]:
        word = word.translate(LEET)
    if _PARTED.fullmatch(word):
        word = re.sub(r"[_\-]", "", word)
    return _THREE.sub(r"\1", word)


#: Words that say nothing by themselves, only beside others.
STOP = frozenset(re.split(r"[\s,]+", COMMON.strip()))


def _number(text: str) -> int:
    """A number of 64 bits, odd for stop words."""
    return xxhash.xxh64_intdigest(text) & ~1 | (text in STOP)


def word_features(token: str) -> tuple[int, list[int], list[int]]:
    """(number of a word in pairs, its own features, those of its pieces): the
    word, also with doubled letters as one; its beginning; of kana, kanji and
    hangul runs the pieces of two to four, but no pairs of hiragana; of a word with
    stars its ends and length.  Stop words have neither."""
    word = plain_word(token)
    if not word:
        return 0, [], []
    tight = _TWO.sub(r"\1", word)
    number = _number(tight if word not in STOP else word)
    if word in STOP:
        return number, [], []
    if "*" in word:
        # the letters left, and where: a word that hides letters is mostly one kind
        shape = f"*{word[0]}{len(word)}{word[-1]}"
        return _number(shape), [_number("*"), _number(shape)] if re.search(r"\w", word) else [], []
    if _CJK.search(word):
        pieces = {word[i : i + n] for n in (2, 3, 4) for i in range(len(word) - n + 1)}
        return number, [_number("w" + word)], [_number("#" + p) for p in sorted(pieces) if not _HIRAGANA.fullmatch(p)]
    return number, [_number("w" + word), _number("t" + tight)], [_number("#" + tight[:STEM])]


@dataclass
class Units:
    """Words of some texts, in order: the distinct words, the place of each word
    among them, its sentence and its clause, and the text of each sentence and clause."""

    words: list[str]
    at: np.ndarray
    sentence: np.ndarray
    clause: np.ndarray
    text_of_sentence: np.ndarray
    text_of_clause: np.ndarray


def _joined_letters(texts: pa.Array) -> pa.Array:
    spaced = pc.fill_null(pc.match_substring_regex(texts, _MAY_BE_SPACED), False)
    if not pc.any(spaced).as_py():
        return texts
    fixed = [_SPACED.sub(lambda m: re.sub(r"[\s_\-.]", "", m.group(0)), t) for t in texts.filter(spaced).to_pylist()]
    return pc.replace_with_mask(texts, spaced, pa.array(fixed, pa.string()))


def _pieces(strings: pa.Array, pattern: str) -> tuple[pa.Array, np.ndarray]:
    """(pieces of the strings between matches of ``pattern``, blank ones left out; the string of each)."""
    lists = pc.split_pattern_regex(strings, pattern)
    flat, owner = pc.list_flatten(lists), pc.list_parent_indices(lists).to_numpy()
    filled = pc.not_equal(flat, "")
    return flat.filter(filled), owner[filled.to_numpy(zero_copy_only=False)]


def units_of(texts: pa.Array) -> Units:
    """Texts cut into sentences (also at lines, quotes, brackets, dashes and
    colons), those into comma clauses and those into words; null gives none."""
    plain = pc.fill_null(texts, "")
    wide = pc.invert(pc.string_is_ascii(plain))
    if pc.any(wide).as_py():
        plain = pc.replace_with_mask(plain, wide, pa.array([unicodedata.normalize("NFKC", t) for t in plain.filter(wide).to_pylist()], pa.string()))
    plain = pc.utf8_lower(plain)
    plain = _joined_letters(pc.replace_substring_regex(plain, _HIDDEN, ""))
    sentences, text_of_sentence = _pieces(plain, _SENTENCE)
    clauses, sentence_of_clause = _pieces(sentences, _CLAUSE)
    words, clause = _pieces(clauses, _BETWEEN)
    coded = pc.dictionary_encode(words)
    return Units(coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64), sentence_of_clause[clause] if len(clause) else clause, clause, text_of_sentence, text_of_sentence[sentence_of_clause])


def neighbour_features(numbers: np.ndarray, unit: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(unit, hashed feature) of the triples of neighbours within a unit, of the
    pairs of words at most REACH apart, one of which at least is no stop word, of
    neighbours once more, and of the two words at its start.  ``unit`` does not fall."""
    if not len(numbers):
        return
    stop = (numbers & np.uint64(1)).astype(bool)
    starts = np.diff(unit, prepend=-1) != 0
    with np.errstate(over="ignore"):
        for far in range(1, min(REACH, len(numbers) - 1) + 1):
            same = unit[far:] == unit[:-far]
            says = same & ~(stop[far:] & stop[:-far])
            pair = (numbers[:-far] * _MIX[0]) ^ (numbers[far:] + _MIX[1])
            yield unit[far:][says], pair[says] * _MIX[2]
            if far == 1:
                yield unit[far:][says], pair[says] * _MIX[1] + np.uint64(1)
                first = same & starts[:-1]
                yield unit[far:][first], pair[first] * _MIX[0] + np.uint64(5)
            if far == 2:
                triple = pair[same] * _MIX[1] + numbers[1:-1][same] * _MIX[2]
                yield unit[far:][same], triple * _MIX[0] + np.uint64(3)


@dataclass(frozen=True)
class OrdinalModel:
    """Cumulative-link model: P(grade > k) = 1 / (1 + exp(cut[k] - score)), one
    set of weights for all cuts; the score of a unit is the sum of the weights of
    its hashed features."""

    features: np.ndarray
    weights: np.ndarray
    cuts: tuple[float, ...]

    def lookup(self) -> Callable[[np.ndarray], np.ndarray]:
        """A function from features to their weights, 0 for unknown ones.  Of
        features with the same first bits only the strongest is known."""
        order = np.argsort(np.abs(self.weights), kind="stable")
        features, weights = np.append(self.features[order], np.uint64(0)), np.append(self.weights[order], np.float32(0))
        place = np.full(1 << BITS, len(order), dtype=np.int32)
        place[(features[:-1] >> np.uint64(64 - BITS)).astype(np.int64)] = np.arange(len(order))

        def weigh(found: np.ndarray) -> np.ndarray:
            at = place[(found >> np.uint64(64 - BITS)).astype(np.int64)]
            return np.where(features[at] == found, weights[at], np.float32(0))

        return weigh

    def expected(self, scores: np.ndarray) -> np.ndarray:
        """Expected grades of scores."""
        return sum(1 / (1 + np.exp(np.clip(cut - scores, -60, 60))) for cut in self.cuts)


class Scorer:
    """Scores batches of texts; remembers the distinct words met."""

    def __init__(self, model: OrdinalModel, most_words: int = 1 << 18) -> None:
        self.model, self.weigh, self.most_words = model, model.lookup(), most_words
        self.known: dict[str, tuple[int, float]] = {}

    def _word(self, token: str) -> tuple[int, float]:
        number, own, pieces = word_features(token)
        found = self.weigh(np.array([*own, *pieces], dtype=np.uint64))
        return number, float(found[: len(own)].sum() + PIECE * found[len(own) :].sum())

    def severities(self, texts: pa.Array) -> np.ndarray:
        """The highest expected grade of the sentences and clauses of each text; 0 without words."""
        units = units_of(texts)
        if len(self.known) > self.most_words:
            self.known.clear()
        pairs = [self.known.get(w) or self.known.setdefault(w, self._word(w)) for w in units.words]
        numbers = np.array([p[0] for p in pairs], dtype=np.uint64)[units.at]
        own = np.array([p[1] for p in pairs], dtype=np.float64)[units.at]
        worst = np.full(len(texts), -np.inf)
        kept = numbers != 0  # marks without a letter are no words
        for unit, text in ((units.sentence, units.text_of_sentence), (units.clause, units.text_of_clause)):
            scores = np.bincount(unit[kept], weights=own[kept], minlength=len(text))
            for at, features in neighbour_features(numbers[kept], unit[kept]):
                scores += NEIGHBOURS * np.bincount(at, weights=self.weigh(features), minlength=len(text))
            np.maximum.at(worst, text, scores)
        return np.where(np.isneginf(worst), 0.0, self.model.expected(np.where(np.isneginf(worst), 0.0, worst)))


def sentences_in(block: str) -> list[tuple[str, bool]]:
    """The labelled sentences of a block, and whether they are in English."""
    return [(s.strip(), line[0] != "~") for line in block.strip().split("\n") for s in line.lstrip("~ ").split(" / ")]


def filled(sentence: str) -> list[str]:
    """A labelled sentence with its slots filled in up to FILLS ways; each fourth
    way hides the inner letters of the first word filled in."""
    slots = re.findall(r"\{(\w+)\}", sentence)
    if not slots:
        return [sentence]
    start, rows = _number(sentence) % 9973, []
    for k in range(FILLS):
        turn = itertools.count()

        def fill(match: re.Match, k: int = k, turn: itertools.count = turn) -> str:
            words, i = SLOTS[match.group(1)].split(", "), next(turn)
            word = words[(start + k * (1 + 2 * i) + 5 * i) % len(words)]
            hide = k % 4 == 3 and i == 0 and match.group(1) in ("insult", "mean", "sexual") and " " not in word
            return word[0] + "*" * (len(word) - 2) + word[-1] if hide else word

        rows.append(re.sub(r"\{(\w+)\}", fill, sentence))
    return list(dict.fromkeys(rows))


@dataclass(frozen=True)
class Row:
    """A training text: its grade, its weight, the labelled sentence it fills (or
    -1) and whether that is in English."""

    text: str
    grade: int
    weight: float
    sentence: int
    english: bool


def labelled() -> list[tuple[str, int, bool]]:
    """All labelled sentences, unfilled: (sentence, grade, in English)."""
    return [(s, grade, e) for grade, block in ABUSE.items() for s, e in sentences_in(block)] + [(s, 0, e) for s, e in sentences_in(HARMLESS)]


def prose(most: int = PROSE) -> list[str]:
    """Sentences of the language manual that comes with Python, at most ``most``:
    harmless by their nature, and full of common words."""
    paragraphs = "\n\n".join(text for _, text in sorted(topics.topics.items())).split("\n\n")
    sentences = (s.strip() for p in paragraphs for s in re.split(r"(?<=[.!?:;])\s", re.sub(r"\s+", " ", p)))
    return list(dict.fromkeys(s for s in sentences if re.fullmatch(r"[A-Za-z ,.'’;:()\-“”\"]{25,300}", s)))[:most]


def training_rows(sentences: list[tuple[str, int, bool]]) -> list[Row]:
    """The fillings of labelled sentences, those of one weighing one together,
    sentences of a manual, and JOINED rows of several in one, graded by the worst."""
    rows = [Row(text, grade, 1 / len(ways), i, english) for i, (s, grade, english) in enumerate(sentences) for ways in [filled(s)] for text in ways]
    rows += [Row(text, 0, PROSE_WEIGHT, -1, True) for text in prose()]
    abuse, harmless = [r for r in rows if r.grade], [r for r in rows if not r.grade]
    for k in range(JOINED if abuse and harmless else 0):
        parts = [harmless[(k * 7919 + i * 104729) % len(harmless)] for i in range(2 + k % 3)]
        if k % 2:
            parts[k // 2 % len(parts)] = abuse[(k * 15485863) % len(abuse)]
        glue = (" ", " and ", " but ", " so ")[k // 2 % 4]
        rows.append(Row(glue.join(p.text for p in parts), max(p.grade for p in parts), 0.5, -1, True))
    return rows


def _shared(names: np.ndarray, groups: np.ndarray, least: int) -> np.ndarray:
    """The names that occur with at least ``least`` different groups."""
    order = np.lexsort((groups, names))
    names, groups = names[order], groups[order]
    new = np.append(True, (names[1:] != names[:-1]) | (groups[1:] != groups[:-1])) if len(names) else np.zeros(0, dtype=bool)
    found, counts = np.unique(names[new], return_counts=True)
    return found[counts >= least]


def features_of_rows(rows: list[Row]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, value) of training rows.  What only one labelled sentence
    says is no evidence: words of English, pairs and triples count when two
    sentences have them, pieces of words when two words have them."""
    units = units_of(pa.array([re.sub(r"[,.!?:;]", " ", row.text) for row in rows]))
    row_of_word = units.text_of_sentence[units.sentence]
    sentence, english = np.array([r.sentence for r in rows]), np.array([r.english for r in rows])
    parts = [word_features(w) for w in units.words]
    numbers = np.array([p[0] for p in parts], dtype=np.uint64)
    flat = [np.array([*p[1], *p[2]], dtype=np.uint64) for p in parts]
    n_own = np.array([len(p[1]) for p in parts])  # the word itself, then its pieces
    values = [np.where(np.arange(len(f)) < n, 1.0, PIECE) for f, n in zip(flat, n_own)]

    word_of_piece = np.repeat(np.arange(len(parts)), [len(f) for f in flat])
    all_flat = np.concatenate(flat)
    own = np.concatenate([np.arange(len(f)) < n for f, n in zip(flat, n_own)])
    first_seen = sentence[row_of_word]
    named = np.repeat(np.arange(len(row_of_word)), n_own[units.at])
    own_of_word = [f[:n] for f, n in zip(flat, n_own)]
    own_flat = np.concatenate([own_of_word[i] for i in units.at])
    real = first_seen[named] >= 0
    said = np.union1d(_shared(own_flat[real], first_seen[named][real], 2), own_flat[real & ~english[row_of_word[named]]])
    pieces = _shared(all_flat[~own], word_of_piece[~own], 2)
    keep = np.where(own, np.isin(all_flat, said), np.isin(all_flat, pieces))
    ends = np.cumsum([0, *(len(f) for f in flat)])
    kept_flat = [all_flat[a:b][keep[a:b]] for a, b in itertools.pairwise(ends)]
    kept_values = [v[keep[a:b]] for v, (a, b) in zip(values, itertools.pairwise(ends))]
    row = np.repeat(row_of_word, np.array([len(f) for f in kept_flat])[units.at])
    feature = np.concatenate([kept_flat[i] for i in units.at])
    value = np.concatenate([kept_values[i] for i in units.at])

    worded = numbers[units.at] != 0
    near = list(neighbour_features(numbers[units.at][worded], row_of_word[worded]))
    near_row, near_feature = np.concatenate([r for r, _ in near]), np.concatenate([f for _, f in near])
    real = sentence[near_row] >= 0
    kept = np.isin(near_feature, _shared(near_feature[real], sentence[near_row][real].astype(np.uint64), 2))
    return np.concatenate([row, near_row[kept]]), np.concatenate([feature, near_feature[kept]]), np.concatenate([value, np.full(int(kept.sum()), NEIGHBOURS)])


def fit_ordinal(rows: list[Row], grades: int = GRADES, steps: int = 200, ridge: float = RIDGE, rate: float = 0.05) -> OrdinalModel:
    """Maximum likelihood with ridge by Adam steps on sparse rows; deterministic.
    The harmless rows weigh HARMLESS_SHARE together, those of the other grades
    the same each."""
    row_of, names, value = features_of_rows(rows)
    names, flat = np.unique(names, return_inverse=True)
    y = np.array([r.grade for r in rows])
    mass = np.array([r.weight for r in rows])
    per = np.full(grades, (1 - HARMLESS_SHARE) / (grades - 1))
    per[0] = HARMLESS_SHARE
    share = mass * (per / np.bincount(y, weights=mass, minlength=grades).clip(1e-9))[y]
    share = share / share.sum()
    theta = np.zeros(len(names) + grades - 2)
    m, v = np.zeros_like(theta), np.zeros_like(theta)

    def sigmoid(x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x, -40, 40)))

    for step in range(1, steps + 1):
        w = theta[: len(names)]
        widths = np.exp(theta[len(names) :])
        cuts = FIRST_CUT + np.concatenate([[0.0], np.cumsum(widths)])
        score = np.bincount(row_of, weights=w[flat] * value, minlength=len(rows))
        bounds = np.concatenate([[-np.inf], cuts, [np.inf]])
        low, high = bounds[y], bounds[y + 1]
        upper = np.where(np.isinf(high), 1.0, sigmoid(np.where(np.isinf(high), 0, high) - score))
        lower = np.where(np.isinf(low), 0.0, sigmoid(np.where(np.isinf(low), 0, low) - score))
        p = np.maximum(upper - lower, 1e-9)
        d_up, d_low = upper * (1 - upper) / p * share, lower * (1 - lower) / p * share
        grad_w = np.bincount(flat, weights=(d_up - d_low)[row_of] * value, minlength=len(names)) + ridge * w
        grad_cut = np.array([(d_low[y == k + 1].sum() - d_up[y == k].sum()) for k in range(grades - 1)])
        tail = np.cumsum(grad_cut[::-1])[::-1]
        grad = np.concatenate([grad_w, tail[1:] * widths])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta = theta - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    w = theta[: len(names)]
    cuts = FIRST_CUT + np.concatenate([[0.0], np.cumsum(np.exp(theta[len(names) :]))])
    large = np.abs(w) > 1e-3
    return OrdinalModel(names[large], w[large].astype(np.float32), tuple(float(c) for c in cuts))


@lru_cache(maxsize=1)
def default_model() -> OrdinalModel:
    """The model of the labelled sentences (bounded by their number times FILLS,
    and JOINED).  No text without a label takes part, so what a corpus repeats
    cannot make itself harmless."""
    return fit_ordinal(training_rows(labelled()))


def score_documents(documents: DataFrame, keep: list[str], text_column: str = "text", model: OrdinalModel | None = None) -> DataFrame:
    """The columns ``keep`` and ``severity`` (double): the highest expected grade
    of the sentences of a text and of their comma clauses, read whole.  Null,
    empty and blank texts get 0.  The model is a list of features and weights,
    bounded by the labelled rows, sent with the task; a batch is scored by array operations, Python
    sees each distinct word once."""
    chosen = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(chosen)
        for batch in batches:
            texts = batch.column(len(keep))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scorer.severities(texts), pa.float64())], names=[*keep, "severity"])

    types = dict(documents.dtypes)
    schema = ", ".join([*(f"`{name}` {types[name]}" for name in keep), "severity double"])
    return documents.select(*keep, F.col(text_column).cast("string").alias("_text")).mapInArrow(run, schema)


def review_rates(scored: DataFrame, review: float = REVIEW) -> DataFrame:
    """Documents, documents to review and their share per source."""
    flagged = F.count_if(F.col("severity") >= review)
    return scored.groupBy(source_form(F.col("source")).alias("source")).agg(F.count("*").alias("n_docs"), flagged.alias("n_review"), (flagged / F.count("*")).alias("review_rate"), F.avg("severity").alias("mean_severity"))
