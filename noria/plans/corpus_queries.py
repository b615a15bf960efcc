"""Manifest, alignment results, cuts and samples over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noria.functions import alphabet as A
from noria.functions import arabic as ar
from noria.operators import cuts, manifest, samples
from noria.operators.ordering import running_number
from noria.session import spread
from noria.sources import files

from .registry import query, table
from .text_queries import _MC, _NORMAL, ARABIC, LETTERED, duck_canonicalize

LIMITS = manifest.Limits(max_duration=200.0)


def raw_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and labels in the shape of raw metadata."""
    docs = spread(table(spark, sf_dir, "documents")).join(table(spark, sf_dir, "labels"), "doc_id", "left")
    split = F.when(F.col("doc_id") % 10 == 0, "valid").when(F.col("doc_id") % 10 == 1, "test").otherwise("train")
    duration = F.col("n_chars") / (3.0 + F.col("doc_id") % 20)
    return docs.select(F.col("doc_id").alias("id"), ar.arabize(F.col("text"), True).alias("raw_text"), duration.alias("duration"), F.col("quality").cast("double").alias("confidence"), (F.col("toxic") == 1).alias("promo"), split.alias("split"), "lang")


_CLASSIFIED = f"""r AS (SELECT doc_id AS id, {LETTERED} AS t, n_chars / (3.0 + doc_id % 20) AS duration, CAST(quality AS DOUBLE) AS confidence, toxic = 1 AS promo,
 CASE doc_id % 10 WHEN 0 THEN 'valid' WHEN 1 THEN 'test' ELSE 'train' END AS split, lang FROM documents LEFT JOIN labels USING (doc_id)),
n AS (SELECT *, trim(regexp_replace(regexp_replace(translate({_NORMAL}, '{_MC}', ''), '[,.]', ' ', 'g'), '\\s+', ' ', 'g')) AS text FROM r),
c AS (SELECT *, CASE WHEN coalesce(promo, false) THEN 'promo' WHEN coalesce(confidence, 1.0) < 0.93 THEN 'low_confidence' WHEN NOT duration BETWEEN 1.5 AND 200.0 THEN 'duration'
 WHEN regexp_matches(t, '[$+=^`]') THEN 'unsupported_characters' WHEN len(list_filter(string_split(text, ' '), lambda w: w <> '')) < 3 THEN 'too_few_words'
 WHEN NOT length(regexp_replace(text, '[^{A.LETTERS}]', '', 'g')) / duration BETWEEN 4.0 AND 20.0 THEN 'implausible_rate' END AS reason FROM n)"""


@query(f"WITH {_CLASSIFIED} SELECT split, coalesce(reason, 'kept') AS reason, count(*) AS n FROM c GROUP BY ALL")
def q_reject_reasons(spark, sf_dir):
    return manifest.reasons(manifest.classify(raw_metadata(spark, sf_dir), LIMITS))


@query(f"WITH {_CLASSIFIED} SELECT split, count(*) FILTER (reason IS NULL) AS kept, round(coalesce(sum(duration) FILTER (reason IS NULL), 0) / 3600, 2) AS hours, " + ", ".join(f"count(*) FILTER (reason = '{r}') AS {r}" for r in manifest.REASONS) + " FROM c GROUP BY split")
def q_manifest_stats(spark, sf_dir):
    return manifest.stats(manifest.classify(raw_metadata(spark, sf_dir), LIMITS))


@query(f"WITH {_CLASSIFIED.replace('200.0', '20.0')} SELECT split, coalesce(reason, 'kept') AS reason, count(*) AS n FROM c GROUP BY ALL")
def q_reject_reasons_default(spark, sf_dir):
    """With the limits as they are by default: 20 seconds at most."""
    return manifest.reasons(manifest.classify(raw_metadata(spark, sf_dir)))


@query(f"WITH {_CLASSIFIED} SELECT id, split, round(duration, 6) AS duration, text, coalesce(confidence, 1.0) AS confidence FROM c WHERE reason IS NULL")
def q_manifest(spark, sf_dir):
    kept = manifest.kept(manifest.classify(raw_metadata(spark, sf_dir), LIMITS))
    return kept.select("id", "split", F.round("duration", 6).alias("duration"), "text", "confidence")


@query("SELECT doc_id FROM documents SEMI JOIN labels USING (doc_id)")
def q_existing_refs(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left_semi").select("doc_id")


@query("SELECT doc_id FROM documents ANTI JOIN labels USING (doc_id)")
def q_missing_refs(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti").select("doc_id")


@query("SELECT item_id AS id, text FROM benchmark UNION ALL SELECT doc_id, text FROM documents")
def q_union_splits(spark, sf_dir):
    parts = [table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text"), table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")]
    return parts[0].unionByName(parts[1])


@query("SELECT doc_id, coalesce(quality, -1) AS quality FROM (SELECT d.doc_id, l.quality, row_number() OVER (PARTITION BY d.doc_id ORDER BY l.toxic DESC) AS q FROM documents d LEFT JOIN labels l USING (doc_id)) WHERE q = 1")
def q_last_duplicate_join(spark, sf_dir):
    """Of several right rows for an id the last one counts; missing ones give -1."""
    right = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max_by("quality", "toxic").alias("quality"))
    return table(spark, sf_dir, "documents").select("doc_id").join(right, "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"))


@query("SELECT d.doc_id AS id, coalesce(c.text, d.text) AS text FROM documents d LEFT JOIN (SELECT conv_id, arg_max(text, turn) AS text FROM conversations GROUP BY conv_id) c ON c.conv_id = d.doc_id")
def q_last_text(spark, sf_dir):
    """Texts by id, where an id has as many texts as its conversation has turns: the last one counts."""
    texts = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id"), "text", "turn")
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return manifest.with_text(rows, texts, order="turn").select("id", "text")


@query("SELECT doc_id FROM documents WHERE source || '/' || doc_id || '.wav' IN (SELECT d.source || '/' || (d.doc_id - d.doc_id % 2) || '.wav' FROM documents d JOIN labels USING (doc_id))")
def q_existing_audio(spark, sf_dir):
    """Rows whose audio, by folder and name, is in a listing: that of the even number before each labelled document, in that document's folder."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    name = F.concat(F.col("source"), F.lit("/"), (F.col("doc_id") - F.col("doc_id") % 2).cast("string"), F.lit(".wav"))
    listed = docs.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi").select(name.alias("name"))
    rows = docs.withColumn("audio_path", F.concat(F.lit("./"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".wav")))
    return files.with_existing(rows, listed).select("doc_id")


@query(f"WITH {_CLASSIFIED} SELECT split, coalesce(reason, CASE WHEN id NOT IN (SELECT conv_id FROM conversations) THEN 'missing_audio' END, 'kept') AS reason, count(*) AS n FROM c GROUP BY ALL")
def q_missing_audio(spark, sf_dir):
    """As q_reject_reasons, with the last reason too: ids that no conversation has lack audio. The listing names an id once for each turn."""
    listed = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id"))
    return manifest.reasons(manifest.classify(raw_metadata(spark, sf_dir), LIMITS, listed))


# words with synthetic times

_WORDS = """w AS (SELECT conv_id * 100 + turn AS id, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) - 1 AS pos FROM conversations),
o AS (SELECT id, CAST(pos AS BIGINT) AS pos, word, coalesce(sum(length(word) + 1) OVER (PARTITION BY id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM w),
t AS (SELECT id, pos, word, CASE WHEN length(word) = 0 THEN NULL ELSE off / 10.0 END AS s, CASE WHEN length(word) = 0 THEN NULL ELSE (off + length(word)) / 10.0 END AS e FROM o),
u AS (SELECT id, max(pos) + 1 AS n_words, max(e) + 0.5 AS duration FROM t GROUP BY id HAVING max(e) IS NOT NULL)"""


def timed_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, pos, word, start, end: ten characters take a second."""
    words = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.split("text", " ").alias("ws"))
    return cuts.timed_words(words)


@query(f"WITH {_WORDS} SELECT t.id, CAST(count(s) AS BIGINT) AS timed, round(count(s) / count(*), 4) AS timed_ratio, round(coalesce(avg(-length(word) / 8.0) FILTER (s IS NOT NULL), -99.0), 4) AS ctc_score FROM t GROUP BY t.id")
def q_quality(spark, sf_dir):
    """Scores stand in for an aligner's: minus an eighth of a word's length."""
    return cuts.quality(timed_words(spark, sf_dir).withColumn("score", -F.length("word") / 8.0))


@query(f"WITH {_WORDS}, q AS (SELECT t.id, round(count(s) / count(*), 4) AS r, round(coalesce(avg(-length(word) / 8.0) FILTER (s IS NOT NULL), -99.0), 4) AS c FROM t GROUP BY t.id), k AS (SELECT quantile_cont(c, 0.03) AS cut FROM q) SELECT id FROM q, k WHERE c >= cut AND r >= 0.9")
def q_quality_filter(spark, sf_dir):
    return cuts.keep_best(cuts.quality(timed_words(spark, sf_dir).withColumn("score", -F.length("word") / 8.0)), 0.03).select("id")


_CUTS = """p AS (SELECT id, pos, lag(e) OVER (PARTITION BY id ORDER BY pos) AS pe, s FROM t),
v AS (SELECT p.id, pos, pe, (pe + s) / 2 AS cut, duration FROM p JOIN u USING (id) WHERE pe IS NOT NULL AND s IS NOT NULL AND (pe + s) / 2 >= 1.0 AND (pe + s) / 2 <= duration - 1.0),
g AS (SELECT *, pe < 5.0 AS within, row_number() OVER (PARTITION BY id ORDER BY pos) AS k, max(CAST(pe < 5.0 AS INTEGER)) OVER (PARTITION BY id) AS any_within FROM v),
f AS (SELECT id, pos, cut, CAST(least(greatest(round_even(cut * 12.5, 0), 1), floor(duration * 12.5) - 1) AS INTEGER) AS cut_frame, CAST(floor(duration * 12.5) AS BIGINT) AS frames, duration FROM g WHERE CASE WHEN any_within = 1 THEN within ELSE k = 1 END),
d AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY id, cut_frame ORDER BY pos) = 1)"""


def eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cuts.eligible_cuts(timed_words(spark, sf_dir))


@query(f"WITH {_WORDS}, {_CUTS} SELECT id, pos AS word_idx, round(cut, 6) AS cut FROM f")
def q_cuts(spark, sf_dir):
    return eligible(spark, sf_dir).select("id", F.col("pos").alias("word_idx"), F.round("cut", 6).alias("cut"))


@query(f"WITH {_WORDS}, {_CUTS} SELECT id, pos AS word_idx, cut_frame FROM d")
def q_cut_frames(spark, sf_dir):
    return cuts.first_per_frame(cuts.cut_frames(eligible(spark, sf_dir))).select("id", F.col("pos").alias("word_idx"), "cut_frame")


@query(f"WITH {_WORDS}, {_CUTS}, i AS (SELECT id, any_value(frames) AS frames, any_value(duration) AS duration FROM d GROUP BY id) SELECT id, frames, CAST(coalesce(sum(frames) OVER (ORDER BY duration, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM i")
def q_offsets(spark, sf_dir):
    index = cuts.index_rows(cuts.first_per_frame(cuts.cut_frames(eligible(spark, sf_dir))))
    return running_number(index, ["duration", "id"], "offset", F.col("frames")).select("id", "frames", "offset")


@query(f"WITH {_WORDS}, {_CUTS} SELECT id, pos AS word_idx, CAST(row_number() OVER (ORDER BY duration, id, pos) - 1 AS BIGINT) AS stitch_row, CAST(least(8, frames - cut_frame) AS BIGINT) AS stitch_len FROM d")
def q_stitch_ids(spark, sf_dir):
    rows = running_number(cuts.first_per_frame(cuts.cut_frames(eligible(spark, sf_dir))), ["duration", "id", "pos"], "stitch_row")
    return rows.select("id", F.col("pos").alias("word_idx"), "stitch_row", F.least(F.lit(8), F.col("frames") - F.col("cut_frame")).cast("long").alias("stitch_len"))


@query(f"WITH {_WORDS}, {_CUTS}, i AS (SELECT id, any_value(frames) AS frames, any_value(duration) AS duration, count(*) AS cuts FROM d GROUP BY id) SELECT count(*) AS utterances, CAST(sum(frames) AS BIGINT) AS frames, CAST(sum(cuts) AS BIGINT) AS cuts, round(sum(duration) / 3600, 3) AS hours, (SELECT count(*) FROM u) - count(*) AS skipped_no_cut FROM i")
def q_cache_meta(spark, sf_dir):
    words = timed_words(spark, sf_dir)
    index = cuts.index_rows(cuts.first_per_frame(cuts.cut_frames(cuts.eligible_cuts(words))))
    return cuts.cache_meta(index, words)


@query(f"WITH {_WORDS} SELECT id, pos, word || CASE WHEN pos = n_words - 1 THEN '.' WHEN pause >= 0.55 THEN '.' WHEN pause >= 0.22 THEN ',' ELSE '' END AS word FROM (SELECT t.*, n_words, lead(s) OVER (PARTITION BY id ORDER BY pos) - e AS pause FROM t JOIN u USING (id))")
def q_pause_marks(spark, sf_dir):
    return cuts.pause_marks(timed_words(spark, sf_dir)).select("id", "pos", "word")


# training samples

_LENGTHS = """x AS (SELECT conv_id * 100 + turn AS id, CAST(length(text) AS BIGINT) AS chars, length(text) / 10.0 AS duration FROM conversations),
y AS (SELECT id, chars, duration, duration / 3 AS cut, duration - 0.4 AS last_end FROM x),
z AS (SELECT *, CASE WHEN last_end > cut THEN least(duration, last_end + 0.2) ELSE duration END AS e, greatest(CAST(floor(cut * 12.5) AS BIGINT), 1) AS cut_frame, greatest(CAST(floor(duration * 12.5) AS BIGINT), 2) AS stored FROM y),
l AS (SELECT id, chars, least(greatest(CAST(floor(least(e - cut, 20.0) * 12.5) AS BIGINT), 1), greatest(stored - cut_frame, 1)) AS target_len, least(cut_frame, greatest(1, CAST(floor(5.0 * 12.5) AS BIGINT))) AS prompt_len FROM z)"""


def lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.length("text").cast("long").alias("chars"), (F.length("text") / 10.0).alias("duration"))
    rows = rows.withColumn("cut", F.col("duration") / 3).withColumn("last_end", F.col("duration") - 0.4)
    return samples.lengths(rows)


@query(f"WITH {_LENGTHS} SELECT id, target_len FROM l")
def q_target_len(spark, sf_dir):
    return lengths(spark, sf_dir).select("id", "target_len")


@query(f"WITH {_LENGTHS} SELECT id, prompt_len, chars + prompt_len + target_len AS row_len FROM l")
def q_prompt_len(spark, sf_dir):
    return lengths(spark, sf_dir).select("id", "prompt_len", (F.col("chars") + F.col("prompt_len") + F.col("target_len")).alias("row_len"))


@query("SELECT doc_id, CAST((row_number() OVER (ORDER BY doc_id) - 1) % 3 AS BIGINT) AS shard FROM documents")
def q_shards(spark, sf_dir):
    return samples.shards(table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"], 3).select("doc_id", "shard")


_BUCKETS = """n AS (SELECT id, chars + prompt_len + target_len AS len, row_number() OVER (ORDER BY md5(CAST(id AS VARCHAR) || ':7'), id) - 1 AS rn FROM l),
p AS (SELECT *, rn // 32 AS pool FROM n), b AS (SELECT *, (row_number() OVER (PARTITION BY pool ORDER BY len, rn) - 1) // 8 AS batch FROM p),
s AS (SELECT *, count(*) OVER (PARTITION BY pool, batch) AS size FROM b)"""


@query(f"WITH {_LENGTHS}, {_BUCKETS} SELECT id, CAST(pool AS BIGINT) AS pool, CAST(batch AS BIGINT) AS batch FROM s WHERE size = 8")
def q_buckets(spark, sf_dir):
    rows = lengths(spark, sf_dir).withColumn("len", F.col("chars") + F.col("prompt_len") + F.col("target_len"))
    return samples.buckets(rows, 8, 4, seed=7).select("id", "pool", "batch")


@query("SELECT conv_id, turn, CASE WHEN u < 0.55 THEN 'plain' WHEN u < 0.85 THEN 'partial' ELSE 'full' END AS mode FROM (SELECT *, CAST('0x' || md5(CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) || ':3')[:7] AS BIGINT) / 268435456.0 AS u FROM conversations)")
def q_text_mix(spark, sf_dir):
    u = samples.uniform(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"), F.lit("3")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", samples.mix_mode(u).alias("mode"))


_KEPT = "CAST('0x' || md5(CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) || ':' || CAST(i - 1 AS VARCHAR))[:7] AS BIGINT) / 268435456.0 < 0.5"


@query(
    f"WITH a AS (SELECT conv_id, turn, {ARABIC} AS t FROM conversations), b AS (SELECT conv_id, turn, regexp_extract_all({duck_canonicalize('t')}, '(?s).[{_MC}]*') AS c FROM a) "
    f"SELECT conv_id, turn, array_to_string(list_transform(c, lambda x, i: CASE WHEN length(x) = 1 OR {_KEPT} THEN x ELSE substr(x, 1, 1) END), '') AS t FROM b"
)
def q_subsample(spark, sf_dir):
    """Marks kept by chance, all or none of a letter."""
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", ar.canonicalize(ar.arabize(F.col("text"))).alias("t"))
    return t.select("conv_id", "turn", samples.subsample_marks(F.col("t"), F.concat_ws(":", "conv_id", "turn"), 0.5).alias("t"))
