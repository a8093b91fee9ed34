"""Queries of the training-data operators over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.functions.keys import key_form, label_form
from strandframe.llm.abuse import REVIEW, review_rates, score_documents
from strandframe.llm.mixture import choose_documents, interleave, largest_lag, mix_report
from strandframe.llm.repetition import CLASSES, COMMON_WORDS, MIN_CHARS, MIN_WORDS, divergence, language_references, repetition
from strandframe.llm.splits import deal_splits, group_records, leads, spanning_forest, split_report, tied_pairs
from strandframe.llm.tokenization import decode_ids, encode_texts
from strandframe.llm.truncation import cut_report, cut_texts
from strandframe.session import cut_lineage
from strandframe.sources.tables import table

REPEATED_SHARE = 0.3


def _bug_entries(spark: SparkSession, folder: str) -> DataFrame:
    records = table(spark, folder, "records", "rec_id", "vid", "source", "bugs")
    entries = records.select("rec_id", "source", key_form(F.col("vid")).alias("owner"), F.posexplode("bugs").alias("bug_pos", "text"))
    return entries.where("text is not null")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Entries of records.bugs that lost their tail."""
    return cut_texts(_bug_entries(spark, folder), ["rec_id", "bug_pos"]).select("rec_id", "bug_pos")


def p1_report(spark: SparkSession, folder: str) -> DataFrame:
    """Share of cut entries per source."""
    entries = _bug_entries(spark, folder)
    return cut_report(entries, cut_texts(entries, ["rec_id", "bug_pos"])).select("source", "n_entries", "n_cut", F.round("cut_share", 9).alias("cut_share"))


def _game_and_vid(spark: SparkSession, folder: str) -> tuple:
    return table(spark, folder, "records", "rec_id", "game", "vid"), label_form(F.col("game")), key_form(F.col("vid"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Games tied to others by shared vids, with the first game of their group."""
    lead = leads(spanning_forest(tied_pairs(*_game_and_vid(spark, folder)))[1])
    return lead.select(F.col("node").alias("game_key"), F.col("lead").alias("lead_key"))


def p3_forest(spark: SparkSession, folder: str) -> DataFrame:
    """The spanning forest of the games."""
    return spanning_forest(tied_pairs(*_game_and_vid(spark, folder)))[0].select("node_a", "node_b")


def _dealt(spark: SparkSession, folder: str) -> DataFrame:
    goals = [(r["split_name"], r["goal_share"]) for r in table(spark, folder, "split_goals").collect()]
    return deal_splits(group_records(*_game_and_vid(spark, folder)), goals)


def p3_split(spark: SparkSession, folder: str) -> DataFrame:
    """The split of every record."""
    return _dealt(spark, folder).select("rec_id", "split_name")


def p3_report(spark: SparkSession, folder: str) -> DataFrame:
    """Goal and reached share of each split."""
    report = split_report(_dealt(spark, folder), table(spark, folder, "split_goals"))
    return report.select("split_name", "goal_share", "n_records", "n_groups", F.round("reached_share", 9).alias("reached_share"))


def p3_check(spark: SparkSession, folder: str) -> DataFrame:
    """Records dealt, games and vids that lie in more than one split, and whether
    every split is as near to its goal as the smallest groups allow."""
    records, game, vid = _game_and_vid(spark, folder)
    keyed = records.select("rec_id", game.alias("game"), vid.alias("vid"))
    dealt = cut_lineage(_dealt(spark, folder))
    both = keyed.join(dealt, "rec_id")
    apart = {key: both.where(F.col(key).isNotNull()).groupBy(key).agg(F.countDistinct("split_name").alias("n")).agg(F.count_if(F.col("n") > 1).alias(f"split_{key}s")) for key in ("game", "vid")}
    sizes = dealt.groupBy("group").agg(F.count("*").alias("n")).agg(F.sum("n").alias("n_records"), F.min("n").alias("least"))
    far = split_report(dealt, table(spark, folder, "split_goals")).agg(F.max(F.abs(F.col("reached_share") - F.col("goal_share"))).alias("far"))
    one = F.lit(1).alias("k")
    joined = sizes.select("*", one).join(far.select("*", one), "k").join(apart["game"].select("*", one), "k").join(apart["vid"].select("*", one), "k")
    return joined.select("n_records", "split_games", "split_vids", (F.col("far") <= F.greatest((F.col("least") + 1) / F.col("n_records"), F.lit(1e-9))).alias("near_goals"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Records that repeat at least 0.3 of their words."""
    shares = repetition(table(spark, folder, "records", "rec_id", "bugs"), "rec_id", "bugs")
    return shares.where((F.col("n_words") > 0) & (F.col("n_repeated") * 10 >= F.col("n_words") * round(REPEATED_SHARE * 10))).select("rec_id")


def p4_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Share of repeated words of every record."""
    shares = repetition(table(spark, folder, "records", "rec_id", "bugs"), "rec_id", "bugs")
    return shares.select("rec_id", F.col("n_words").cast("bigint").alias("n_words"), F.col("n_repeated").cast("bigint").alias("n_repeated"), F.round("repeated_share", 9).alias("repeated_share"))


def p4_divergence(spark: SparkSession, folder: str) -> DataFrame:
    """Distance of every record's histograms from the nearest language of the documents."""
    references = language_references(table(spark, folder, "documents", "text", "lang"), "text", "lang")
    out = divergence(table(spark, folder, "records", "rec_id", "bugs"), "rec_id", "bugs", references)
    return out.select("rec_id", "n_words", "n_chars", F.round("class_distance", 6).alias("class_distance"), F.round("word_distance", 6).alias("word_distance"))


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every document."""
    return encode_texts(table(spark, folder, "documents", "doc_id", "text"), "doc_id", "text")


def p6_decoded(spark: SparkSession, folder: str) -> DataFrame:
    """Hash of every text as its token ids give it back."""
    decoded = decode_ids(p6_ids(spark, folder), "doc_id")
    return decoded.select("doc_id", F.md5("text").alias("text_md5"))


def _chosen(spark: SparkSession, folder: str) -> tuple:
    documents = table(spark, folder, "documents", "doc_id", "text", "source")
    return choose_documents(documents, table(spark, folder, "source_goals"))


def p7_mix(spark: SparkSession, folder: str) -> DataFrame:
    """Every copy of every used document with its slot in the mix."""
    return interleave(_chosen(spark, folder)[0])


def p7_report(spark: SparkSession, folder: str) -> DataFrame:
    """Goal and reached share of each source."""
    report = mix_report(*_chosen(spark, folder))
    return report.select("source", "goal_share", F.round("reached_share", 9).alias("reached_share"), "used_tokens", "supply_tokens", "total_tokens", "n_docs", "most_copies", "max_repeats")


def p7_lag(spark: SparkSession, folder: str) -> DataFrame:
    """Whether every source stays within one block of its share, no block is longer
    than 4096 tokens, no document is used too often, and no source misses its share
    by more than half its longest document unless its repeats bind it."""
    used, plans, total = _chosen(spark, folder)
    worst = largest_lag(used).agg(F.max("lag").alias("lag"), F.max("block_tokens").alias("size"))
    longest = used.groupBy("source").agg(F.max("n_tokens").alias("longest"))
    report = mix_report(used, plans, total).join(longest, "source", "left").fillna(0, ["longest"])
    wanted = F.least(F.col("goal_share") * F.col("total_tokens"), F.col("max_repeats") * F.col("supply_tokens"))
    sums = report.agg(F.max((F.col("most_copies") > F.col("max_repeats")).cast("int")).alias("over"), F.max((F.abs(F.col("used_tokens") - wanted) > F.col("longest") / 2 + 1).cast("int")).alias("missed"), F.max("total_tokens").alias("total_tokens"))
    one = F.lit(1).alias("k")
    return worst.select("*", one).join(sums.select("*", one), "k").select((F.coalesce("lag", F.lit(0.0)) < 1).alias("below_one_block"), (F.coalesce("size", F.lit(0.0)) <= 4096).alias("blocks_kept"), (F.col("over") == 0).alias("repeats_kept"), (F.col("missed") == 0).alias("shares_kept"))


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    return score_documents(table(spark, folder, "documents", "doc_id", "text", "source"), ["doc_id", "source"])


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents to review."""
    return _scored(spark, folder).where(F.col("severity") >= REVIEW).select("doc_id")


def p8_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Expected severity of every document."""
    return _scored(spark, folder).select("doc_id", "severity")


def p8_report(spark: SparkSession, folder: str) -> DataFrame:
    """Rate of documents to review per source."""
    return review_rates(_scored(spark, folder))


QUERIES = {
    "p1_found": p1_found, "p1_report": p1_report,
    "p3_found": p3_found, "p3_split": p3_split, "p3_report": p3_report, "p3_forest": p3_forest, "p3_check": p3_check,
    "p4_found": p4_found, "p4_shares": p4_shares, "p4_divergence": p4_divergence,
    "p6_ids": p6_ids, "p6_decoded": p6_decoded,
    "p7_mix": p7_mix, "p7_report": p7_report, "p7_lag": p7_lag,
    "p8_found": p8_found, "p8_scores": p8_scores, "p8_report": p8_report,
}

_REPEATS = r"""
words as (
  select rec_id, regexp_extract_all(lower(array_to_string(bugs, chr(10))), '\p{L}+') as w from records
),
counted as (select rec_id, coalesce(len(w), 0) as n_words from words),
runs as (select rec_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as run from (select rec_id, w, unnest(range(1, len(w) - 1)) as i from words where len(w) >= 3)),
later as (select rec_id, i from (select rec_id, i, row_number() over (partition by rec_id, run order by i) as k from runs) where k > 1),
covered as (select rec_id, count(distinct i + j) as n from later, (select unnest([0, 1, 2]) as j) group by rec_id),
shares as (select c.rec_id, c.n_words, coalesce(v.n, 0) as n_repeated from counted c left join covered v on c.rec_id = v.rec_id)
"""



def _divergence_sql() -> str:
    """Histograms and Jensen-Shannon distances in SQL: text of records (t) and of
    languages (d), one row per text, bin and reference."""
    ranges = ["".join(span.replace("[", r"\[").replace("\\", r"\\") if span[0] == "[" else span for span in spans.split(" ")) for spans in CLASSES.values()] + [r" \t\n\x0b\f\r"]
    counts = [f"cast(length(text) - length(regexp_replace(text, '[{r}]', '', 'g')) as bigint)" for r in ranges]
    bins = f"list_concat([{', '.join(counts)}], [length(text) - ({' + '.join(counts)})])"
    return rf"""with d as (select nullif(regexp_extract(lower(trim(lang)), '^([a-z]{{2,3}})([^a-z]|$)', 1), '') as lang, text from documents where text is not null),
t as (select rec_id, coalesce(array_to_string(bugs, chr(10)), '') as text from records),
dc as (select lang, unnest({bins}) as n, generate_subscripts({bins}, 1) as bin from d where lang is not null),
lc as (select lang, bin, cast(sum(n) as double) as n from dc group by all),
lq as (select lang, bin, n / greatest(sum(n) over (partition by lang), 1e-300) as q from lc),
tc as (select rec_id, unnest({bins}) as n, generate_subscripts({bins}, 1) as bin from t),
tp as (select rec_id, bin, n / greatest(sum(n) over (partition by rec_id), 1e-300) as p from tc),
cd as (select rec_id, lang, sqrt(greatest(0, sum(case when p > 0 then p * log2(2 * p / (p + q)) else 0 end + case when q > 0 then q * log2(2 * q / (p + q)) else 0 end) / 2)) as x from tp join lq using (bin) group by all),
dw as (select lang, unnest(regexp_extract_all(lower(text), '\p{{L}}+')) as w from d where lang is not null),
ln as (select lang, w, count(*) as n from dw group by all),
lr as (select *, row_number() over (partition by lang order by n desc, w) as k, sum(n) over (partition by lang) as total from ln),
lw as (select lang, w, n / total as q, total, n from lr where k <= {COMMON_WORDS}),
lo as (select lang, 1 - sum(n) / any_value(total) as q from lw group by lang),
tw as (select rec_id, unnest(regexp_extract_all(lower(text), '\p{{L}}+')) as w from t),
tn as (select rec_id, count(*) as n_words from tw group by all),
ts as (select t.rec_id, length(text) as n_chars, coalesce(n_words, 0) as n_words from t left join tn using (rec_id)),
wc as (select rec_id, w, count(*) as n from tw group by all),
hit as (select rec_id, lang, lw.q, wc.n / n_words as p from wc join lw using (w) join tn using (rec_id)),
seen as (select rec_id, lang, sum(p) as sp, sum(q) as sq, sum(p * log2(2 * p / (p + q)) + q * log2(2 * q / (p + q))) as s from hit group by all),
al as (select tn.rec_id, lo.lang, 1 - coalesce(sp, 0) as po, lo.q as qo, 1 - lo.q - coalesce(sq, 0) as unseen, coalesce(s, 0) as s from tn cross join lo left join seen on seen.rec_id = tn.rec_id and seen.lang = lo.lang),
wd as (select rec_id, lang, sqrt(greatest(0, (s + greatest(unseen, 0) + case when po > 1e-12 then po * log2(2 * po / (po + qo)) else 0 end + case when qo > 1e-12 then qo * log2(2 * qo / (po + qo)) else 0 end) / 2)) as x from al)
select ts.rec_id, n_words, n_chars, case when n_words >= {MIN_WORDS} and n_chars >= {MIN_CHARS} then round(c.x, 6) end as class_distance, case when n_words >= {MIN_WORDS} and n_chars >= {MIN_CHARS} then round(v.x, 6) end as word_distance
from ts left join (select rec_id, min(x) as x from cd group by all) c on c.rec_id = ts.rec_id left join (select rec_id, min(x) as x from wd group by all) v on v.rec_id = ts.rec_id"""


ORACLES = {
    "p4_divergence": _divergence_sql(),
    "p3_check": "select count(*) as n_records, 0 as split_games, 0 as split_vids, true as near_goals from records",
    "p6_decoded": "select doc_id, md5(coalesce(text, '')) as text_md5 from documents",
    "p7_lag": "select true as below_one_block, true as blocks_kept, true as repeats_kept, true as shares_kept",
    "p3_found": r"""with recursive keyed as (
  select distinct nullif(nullif(regexp_replace(lower(game), '[^a-z0-9]', '', 'g'), ''), 'unknown') as game,
    nullif(regexp_replace(regexp_extract(trim(vid), '[^/]*$'), '\.mp4$', '', 'i'), '') as vid from records
),
pairs as (select game, vid from keyed where game is not null and vid is not null),
edges as (select distinct a.game as x, b.game as y from pairs a join pairs b on a.vid = b.vid and a.game <> b.game),
reach as (select x, y from edges union select r.x, e.y from reach r join edges e on r.y = e.x)
select x as game_key, least(x, min(y)) as lead_key from reach group by x""",
    "p4_found": f"with {_REPEATS} select rec_id from shares where n_words > 0 and n_repeated * 10 >= n_words * 3",
    "p4_shares": f"with {_REPEATS} select rec_id, n_words, n_repeated, round(case when n_words = 0 then 0 else n_repeated / n_words end, 9) as repeated_share from shares",
}
