"""Stores, stitch windows, prompts, training rows, alignment, settings and weights over the driver's tables, with DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from noria.functions import alphabet as A
from noria.functions import arabic as ar
from noria.functions import models
from noria.functions import vectors as ve
from noria.operators import alignment, cuts, latents, manifest, metrics, samples, weights
from noria.operators import votes as vo
from noria.operators.ordering import running_number
from noria.session import spread
from noria.sources import config
from noria.storage import new_path, stored

from .corpus_queries import _CUTS, _WORDS, eligible, raw_metadata, timed_words
from .registry import query, table
from .sequence_queries import _E, _exploded, vectors
from .text_queries import _WORDS as _VOTED
from .text_queries import ARABIC, _MC, plain_documents

_ALL = "unnest({e}) AS x, CAST(generate_subscripts({e}, 1) - 1 AS INTEGER) AS pos"


def _spread(source: str, expression: str, columns: str = "vec_id", digits: int = 4) -> str:
    """DuckDB: an array's rounded values one by one."""
    return f"{source}, y AS (SELECT {columns}, {_ALL.format(e=expression)} FROM e) SELECT {columns}, pos, round(x, {digits}) + 0.0 AS x FROM y"


# the store


@query(f"WITH {_E} SELECT vec_id AS utt_id, CAST(f AS INTEGER) AS frame, round(list_sum(v[8 * f + 1:8 * f + 8]), 4) + 0.0 AS s FROM e, range(8) r(f) WHERE vec_id BETWEEN 100 AND 299")
def q_array_store(spark, sf_dir):
    """Vectors of eight frames are stored, and some utterances read back by their ids."""
    frames = vectors(spark, sf_dir).select(F.col("vec_id").alias("utt_id"), F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda t: F.slice("v", t * 8 + 1, F.lit(8)))).alias("frame", "latent"))
    path = new_path(spark, "latents")
    latents.write_store(frames, path)
    return latents.read_store(spark, path, 100, 299).select("utt_id", "frame", (F.round(ve.total(F.col("latent")), 4) + 0.0).alias("s"))


@query("SELECT l_orderkey, l_linenumber, least(greatest(1, CAST(floor(l_extendedprice * 12.5 / 24) AS BIGINT)), l_partkey) AS frames FROM lineitem")
def q_frame_count(spark, sf_dir):
    n = latents.frame_count(F.col("l_extendedprice"), 12.5, 24, F.col("l_partkey"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", n.alias("frames"))


@query(_spread(f"WITH {_E}", "list_resize(v[1 + CAST(vec_id % 64 AS BIGINT):16 + CAST(vec_id % 64 AS BIGINT)], 16, 0.0)", digits=6))
def q_stitch_window(spark, sf_dir):
    """Sixteen samples from a place on, with zeros beyond the end."""
    return _exploded(vectors(spark, sf_dir).select("vec_id", latents.stitch_window(F.col("v"), F.col("vec_id") % 64, 16).alias("v")), digits=6)


@query(f"WITH {_WORDS}, {_CUTS}, {_E}, s AS (SELECT id, pos AS word_idx, CAST(row_number() OVER (ORDER BY duration, id, pos) - 1 AS BIGINT) AS stitch_row FROM d) SELECT id, word_idx, stitch_row, round(v[1], 6) + 0.0 AS x FROM s JOIN e ON vec_id = stitch_row")
def q_cut_blocks(spark, sf_dir):
    """Each cut with the stitch block of its running number."""
    rows = running_number(cuts.first_per_frame(cuts.cut_frames(eligible(spark, sf_dir))), ["duration", "id", "pos"], "stitch_row")
    blocks = vectors(spark, sf_dir).select(F.col("vec_id").alias("stitch_row"), "v")
    return latents.with_blocks(rows, blocks).select("id", F.col("pos").alias("word_idx"), "stitch_row", (F.round(F.element_at("v", 1), 6) + 0.0).alias("x"))


# prompts and training rows

_CHANCE = "CAST('0x' || md5(CAST({k} AS VARCHAR) || ':{s}')[:7] AS BIGINT) / 268435456.0"


def _chance(key: str, seed: int):
    return samples.uniform(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))


@query(f"SELECT o_orderkey, n AS before, CAST(greatest(n - floor(({_CHANCE.format(k='o_orderkey', s=5)}) * 7), least(n, 12)) AS BIGINT) AS after FROM (SELECT o_orderkey, o_custkey % 62 + 1 AS n FROM orders)")
def q_prompt_trim(spark, sf_dir):
    """Half a second is six frames of 12.5 a second: up to six go, and twelve stay."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 62 + 1).alias("before"))
    return rows.withColumn("after", latents.trimmed(F.col("before"), _chance("o_orderkey", 5), 12.5))


_STATS = "list_transform(range(1, 65), lambda i: i / 64.0)", "list_transform(range(1, 65), lambda i: 1 + i / 32.0)"


def _stats():
    i = F.sequence(F.lit(1), F.lit(64))
    return F.transform(i, lambda x: x / 64.0), F.transform(i, lambda x: 1 + x / 32.0)


@query(_spread(f"WITH {_E}", "list_transform(range(1, 65), lambda i: (v[i] - i / 64.0) / (1 + i / 32.0))", digits=6))
def q_latent_norm(spark, sf_dir):
    return _exploded(vectors(spark, sf_dir).select("vec_id", latents.standardised(F.col("v"), *_stats()).alias("v")), digits=6)


@query(_spread(f"WITH {_E}", "v", digits=6))
def q_latent_denorm(spark, sf_dir):
    """There and back."""
    mean, std = _stats()
    return _exploded(vectors(spark, sf_dir).select("vec_id", latents.restored(latents.standardised(F.col("v"), mean, std), mean, std).alias("v")), digits=6)


_PARTS = "list_concat(list_concat([-1.0], v[1:CAST(vec_id % 5 AS BIGINT)]), list_concat(v[11:10 + CAST(vec_id % 7 AS BIGINT)], v[31:30 + CAST(vec_id % 11 AS BIGINT)]))"


@query(_spread(f"WITH {_E}", _PARTS, digits=6))
def q_assembled(spark, sf_dir):
    """A marker, a voice, a text and audio of several lengths in one row."""
    v = vectors(spark, sf_dir).select("vec_id", _assembled(F.col("vec_id")).alias("a"))
    return _exploded(v.select("vec_id", F.col("a.sequence").alias("v")), digits=6)


def _assembled(n):
    part = lambda at, size: F.slice("v", F.lit(at), (n % size).cast("int"))
    return latents.assembled(F.array(F.lit(-1.0)), part(1, 5), part(11, 7), part(31, 11))


@query("SELECT vec_id, '0,1,' || (1 + vec_id % 5) || ',' || (1 + vec_id % 5 + vec_id % 7) AS offsets FROM embeddings")
def q_assembled_offsets(spark, sf_dir):
    v = vectors(spark, sf_dir).select("vec_id", _assembled(F.col("vec_id")).alias("a"))
    return v.select("vec_id", F.array_join(F.col("a.offsets").cast("array<string>"), ",").alias("offsets"))


@query(f"""WITH {_E}, m AS (SELECT vec_id, vec_id // 8 AS batch, vec_id % 9 AS t, vec_id % 4 AS p, v FROM e), w AS (SELECT batch, greatest(max(t), 1) AS wt, greatest(max(p), 1) AS wp FROM m GROUP BY batch)
SELECT vec_id, CAST(wt AS BIGINT) AS target_size, CAST(t AS BIGINT) AS valid, CAST(wp AS BIGINT) AS prompt_size, CAST(greatest(p, 1) AS BIGINT) AS prompt, round(coalesce(list_sum(v[1:CAST(t AS BIGINT)]), 0), 4) + 0.0 AS s FROM m JOIN w USING (batch)""")
def q_collate_masks(spark, sf_dir):
    """Batches of eight with padded targets and prompts, masks and prompt sizes, row by row."""
    v = vectors(spark, sf_dir)
    rows = v.select(F.col("vec_id").alias("id"), F.expr("vec_id div 8").alias("batch"), F.slice("v", F.lit(1), (F.col("vec_id") % 9).cast("int")).alias("target"), F.slice("v", F.lit(1), (F.col("vec_id") % 4).cast("int")).alias("prompt"))
    made = latents.collated(rows, "batch")
    each = made.select(F.inline(F.arrays_zip(F.col("ids").alias("vec_id"), "targets", "mask", "prompts", "prompt_sizes")))
    return each.select("vec_id", F.size("targets").cast("long").alias("target_size"), F.size(F.filter("mask", lambda x: x)).cast("long").alias("valid"), F.size("prompts").cast("long").alias("prompt_size"), F.col("prompt_sizes").cast("long").alias("prompt"), (F.round(ve.total(F.col("targets")), 4) + 0.0).alias("s"))


@query(f"WITH {_E}, f AS (SELECT vec_id, list_sum(list_transform(range(1, 33), lambda i: pow(0.5 * v[i] - (v[i + 32] - (1 - 1e-5) * v[i]), 2))) / 32 AS flow, v[1] AS z FROM e) SELECT vec_id, round(flow + 0.1 * (ln(1 + exp(-abs(z))) + greatest(z, 0.0)), 5) AS loss FROM f")
def q_combined_loss(spark, sf_dir):
    """A predicted velocity (half the noise) against the flow's target, and the weighted loss of an end logit."""
    x0, x1 = F.slice("v", 1, 32), F.slice("v", 33, 32)
    flow = latents.flow_loss(F.transform(x0, lambda x: 0.5 * x), x0, x1)
    return vectors(spark, sf_dir).select("vec_id", F.round(latents.combined_loss(flow, ve.softplus(F.element_at("v", 1)), 0.1), 5).alias("loss"))


@query(f"""WITH {_E}, d AS (SELECT vec_id, f, sqrt(list_sum(list_transform(range(1, 9), lambda i: pow(v[8 * f + i] * (CASE WHEN f < 2 THEN 0.01 ELSE 1.0 / (f * f * f) END), 2)))) / (sqrt(list_sum(list_transform(range(1, 9), lambda i: pow(v[8 * f + i], 2)))) + 1e-8) AS rel FROM e, range(8) r(f)),
n AS (SELECT max(rel) FILTER (f < 2) AS floor FROM d), m AS (SELECT f, max(rel) AS most FROM d WHERE f >= 2 GROUP BY f)
SELECT CAST(coalesce(max(f) FILTER (most > greatest(3 * floor, 1e-3)), -1) + 5 AS BIGINT) AS stitch, round(any_value(floor), 6) AS floor FROM m, n""")
def q_stitch_frames(spark, sf_dir):
    """Cold encodings that come closer to the warm ones frame by frame; the first two frames show the noise."""
    warm = vectors(spark, sf_dir).select(F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda t: F.slice("v", t * 8 + 1, F.lit(8)))).alias("frame", "w"))
    off = F.when(F.col("frame") < 2, F.lit(0.01)).otherwise(1.0 / (F.col("frame") * F.col("frame") * F.col("frame")))
    rows = warm.select("frame", latents.relative_deviation(F.col("w"), F.transform("w", lambda x: x * (1 - off))).alias("deviation"), (F.col("frame") < 2).alias("settled"))
    return latents.calibrated(rows).select("stitch", F.round("floor", 6).alias("floor"))


_TIMES = ", ".join(f"1 / (1 + exp(-(sqrt(-2 * ln(1 - {_CHANCE.format(k='event_id', s=s)})) * cos(2 * pi() * {_CHANCE.format(k='event_id', s=s + 1)})))) AS t{s}" for s in (1, 3))


@query(f"SELECT event_id, round(least(t1, t3), 6) AS s, round(greatest(t1, t3), 6) AS t FROM (SELECT event_id, {_TIMES} FROM events)")
def q_logit_normal(spark, sf_dir):
    pair = latents.ordered_pair(*[latents.logit_normal(_chance("event_id", s), _chance("event_id", s + 1)) for s in (1, 3)])
    return table(spark, sf_dir, "events").select("event_id", pair.alias("p")).select("event_id", F.round("p.s", 6).alias("s"), F.round("p.t", 6).alias("t"))


@query(f"SELECT event_id, CASE WHEN {_CHANCE.format(k='event_id', s=8)} < 0.25 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS weight, round(0.75 * value + CASE WHEN {_CHANCE.format(k='event_id', s=8)} < 0.25 THEN value * value ELSE 0 END, 6) AS loss FROM events")
def q_skip_weight(spark, sf_dir):
    """Three quarters for the part that every step has; the other quarter by a quarter of the steps."""
    chance, value = _chance("event_id", 8), F.col("value")
    loss = latents.skipped_loss(value, value * value, chance, 0.25, 0.75)
    return table(spark, sf_dir, "events").select("event_id", latents.skip_weight(chance, 0.25, 0.75).alias("weight"), F.round(loss, 6).alias("loss"))


# alignment: eight frames of eight scores, tokens 2, 5 and 3 of the words 0, 0 and 1; word 2 has none

_ALIGNED = f"""{_E}, em AS (SELECT vec_id, range AS f, v[8 * range + 1] AS b, v[8 * range + 3] AS a2, v[8 * range + 6] AS a5, v[8 * range + 4] AS a3 FROM e, range(8)),
bl AS (SELECT vec_id, sum(b) AS blanks FROM em GROUP BY vec_id),
pa AS (SELECT x.vec_id, x.f AS f1, y.f AS f2, z.f AS f3, x.a2 AS s1, y.a5 AS s2, z.a3 AS s3, blanks - x.b - y.b - z.b + x.a2 + y.a5 + z.a3 AS total FROM em x JOIN em y ON y.vec_id = x.vec_id AND y.f > x.f JOIN em z ON z.vec_id = x.vec_id AND z.f > y.f JOIN bl ON bl.vec_id = x.vec_id),
al AS (SELECT * FROM pa QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY total DESC) = 1),
good AS (SELECT * FROM al WHERE vec_id % 25 <> 1 AND vec_id % 10 <> 0),
tf AS (SELECT vec_id AS id, 0 AS word_idx, f1 AS frame, s1 AS score FROM good UNION ALL SELECT vec_id, 0, f2, s2 FROM good UNION ALL SELECT vec_id, 1, f3, s3 FROM good)"""


def _alignable(spark, sf_dir):
    """id, emissions, path and owners; each 25th row can't be read, each tenth has more tokens than frames."""
    frames = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda t: F.slice("v", t * 8 + 1, F.lit(8)))
    tokens = F.when(F.col("vec_id") % 10 == 0, F.array_repeat(F.lit(2), 9)).otherwise(F.array(F.lit(2), F.lit(5), F.lit(3)))
    rows = vectors(spark, sf_dir).select(F.col("vec_id").alias("id"), F.when(F.col("vec_id") % 25 != 1, frames).alias("emissions"), tokens.alias("tokens"), F.array(F.lit(0), F.lit(0), F.lit(1)).alias("owners"))
    return rows.withColumn("path", alignment.aligned(F.col("emissions"), F.col("tokens")))


@query(f"WITH {_ALIGNED} SELECT id, CAST(word_idx AS INTEGER) AS word_idx, CAST(frame AS INTEGER) AS frame, round(score, 6) + 0.0 AS score FROM tf")
def q_token_frames(spark, sf_dir):
    """Backtraced frames of each token with its word and score."""
    found = alignment.token_frames(_alignable(spark, sf_dir))
    return found.select("id", F.col("word_idx").cast("int").alias("word_idx"), F.col("frame").cast("int").alias("frame"), (F.round("score", 6) + 0.0).alias("score"))


@query(f"WITH {_ALIGNED}, sp AS (SELECT id, word_idx, round(min(frame) * 0.02, 3) AS start, round((max(frame) + 1) * 0.02, 3) AS \"end\" FROM tf GROUP BY ALL) SELECT e.vec_id AS id, CAST(w AS INTEGER) AS word_idx, CAST(start AS DOUBLE) AS start, CAST(\"end\" AS DOUBLE) AS \"end\" FROM e CROSS JOIN range(3) r(w) LEFT JOIN sp ON sp.id = e.vec_id AND sp.word_idx = w")
def q_word_spans(spark, sf_dir):
    """Three words a row; those without an aligned token have no span."""
    spans = alignment.word_spans(alignment.token_frames(_alignable(spark, sf_dir)), F.lit(0.02))
    words = vectors(spark, sf_dir).select(F.col("vec_id").alias("id"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("word_idx"))
    return alignment.words_with_spans(words, spans).select("id", "word_idx", "start", "end")


@query(f"WITH {_ALIGNED} SELECT (SELECT count(*) FROM good) AS aligned, (SELECT count(*) FROM e WHERE vec_id % 25 <> 1 AND vec_id % 10 = 0) AS failed, (SELECT count(*) FROM e WHERE vec_id % 25 = 1) AS unreadable, (SELECT count(*) FROM good WHERE vec_id % 7 = 0) AS diac_mismatch")
def q_align_counters(spark, sf_dir):
    return alignment.job_counters(_alignable(spark, sf_dir).withColumn("diac_ok", F.col("id") % 7 != 0))


_LETTER_IDS = "MAP {" + ", ".join(f"'{c}': {i + 1}" for i, c in enumerate("abcdefghijklmnopqrstuvwxyz")) + "}"


@query(f"""WITH m AS MATERIALIZED (SELECT {_LETTER_IDS} AS v), c AS (SELECT conv_id, turn, string_split(lower(text), ' ') AS ws FROM conversations),
w AS (SELECT conv_id, turn, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS i FROM c), t AS (SELECT conv_id, turn, i, list_filter(list_transform(regexp_extract_all(word, '(?s:.)'), lambda x: m.v[x]), lambda x: x IS NOT NULL) AS ids FROM w, m)
SELECT conv_id, turn, CAST(sum(len(ids)) + count(*) - 1 AS BIGINT) AS n, string_agg(array_to_string(ids, ','), '|' ORDER BY i) AS tokens FROM t GROUP BY ALL""")
def q_skip_tokens(spark, sf_dir):
    """Characters as ids for an aligner: unknown ones are skipped, words parted by a delimiter."""
    table_ = {c: i + 1 for i, c in enumerate("abcdefghijklmnopqrstuvwxyz")}
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", alignment.spoken_tokens(F.split(F.lower("text"), " "), table_, 0).alias("t"))
    said = F.array_join(F.transform("t", lambda x: F.when(x["word"] < 0, "|").otherwise(x["token"].cast("string"))), ",")
    return t.select("conv_id", "turn", F.size("t").cast("long").alias("n"), F.regexp_replace(said, ",?\\|,?", "|").alias("tokens"))


@query("SELECT o_orderkey, round(greatest(0.0, least(s, f * 0.1)), 3) AS start, round(least(d, greatest(e, l * 0.1)), 3) AS \"end\" FROM (SELECT o_orderkey, o_custkey % 50 / 10.0 AS s, (o_custkey % 50 + 20) / 10.0 AS e, o_custkey % 37 AS f, o_custkey % 91 AS l, 8.0 AS d FROM orders)")
def q_extended_edges(spark, sf_dir):
    c = F.col("o_custkey")
    start, end = alignment.extended_edges(c % 50 / 10.0, (c % 50 + 20) / 10.0, c % 37, c % 91, 0.1, F.lit(8.0))
    return table(spark, sf_dir, "orders").select("o_orderkey", start.alias("start"), end.alias("end"))


@query("SELECT vec_id, CAST(coalesce(least(list_position(list_transform(embedding, lambda x: x > 0.2), true) - 1 + 5, 64), 64) AS INTEGER) AS frames FROM embeddings")
def q_countdown(spark, sf_dir):
    """Rows end five frames after the first logit above a threshold."""
    return table(spark, sf_dir, "embeddings").select("vec_id", alignment.countdown(F.col("embedding"), 0.2, 5).alias("frames"))


# words and scores


@query(f"WITH {_WORDS} SELECT id, string_agg(word || ':' || coalesce(CAST(CAST(s AS DOUBLE) AS VARCHAR), '-'), ' ' ORDER BY pos) AS words FROM t GROUP BY id")
def q_word_structs(spark, sf_dir):
    """Word structs without their ends."""
    w = cuts.word_structs(timed_words(spark, sf_dir)).select("id", cuts.projected(F.col("words"), "word", "start").alias("w"))
    return w.select("id", F.array_join(F.transform("w", lambda x: F.concat(x["word"], F.lit(":"), F.coalesce(x["start"].cast("double").cast("string"), F.lit("-")))), " ").alias("words"))


_RATED = "q AS (SELECT t.id, round(count(s) / count(*), 4) AS r, round(coalesce(avg(-length(word) / 8.0) FILTER (s IS NOT NULL), -99.0), 4) AS c FROM t GROUP BY t.id)"


def _rated(spark, sf_dir):
    return cuts.quality(timed_words(spark, sf_dir).withColumn("score", -F.length("word") / 8.0))


@query(f"WITH {_WORDS}, {_RATED} SELECT id, c AS ctc_score FROM q ORDER BY c, id LIMIT 3")
def q_worst_rows(spark, sf_dir):
    return cuts.worst(_rated(spark, sf_dir), 3).select("id", "ctc_score")


@query(f"WITH {_WORDS}, {_RATED} SELECT round(quantile_cont(c, 0.03), 6) AS line FROM q")
def q_quantile_line(spark, sf_dir):
    return cuts.quantile_line(_rated(spark, sf_dir), 0.03).select(F.round("line", 6).alias("line"))


@query(f"WITH {_WORDS} SELECT id, pos, word || m AS word, reverse(word) || m AS diac FROM (SELECT *, CASE WHEN pos = n_words - 1 THEN '.' WHEN pause >= 0.55 THEN '.' WHEN pause >= 0.22 THEN ',' ELSE '' END AS m FROM (SELECT t.*, n_words, lead(s) OVER (PARTITION BY id ORDER BY pos) - e AS pause FROM t JOIN u USING (id)))")
def q_pause_twins(spark, sf_dir):
    """A word and its marked twin get the same sign."""
    return cuts.pause_marks(timed_words(spark, sf_dir).withColumn("diac", F.reverse("word"))).select("id", "pos", "word", "diac")


@query(f"WITH {_WORDS}, {_CUTS}, i AS (SELECT id, any_value(frames) AS frames, any_value(duration) AS duration FROM d GROUP BY id) SELECT id, 'audio/' || id || '.wav' AS audio FROM i ORDER BY duration, id LIMIT 1")
def q_first_audio(spark, sf_dir):
    index = cuts.index_rows(cuts.first_per_frame(cuts.cut_frames(eligible(spark, sf_dir))))
    index = running_number(index.select("id", "frames", "duration"), ["duration", "id"], "offset", F.col("frames"))
    audio = timed_words(spark, sf_dir).select("id").distinct().withColumn("audio", F.concat(F.lit("audio/"), F.col("id").cast("string"), F.lit(".wav")))
    return cuts.first_audio(index, audio)


@query("SELECT n_name, round(sum(o_totalprice) / greatest(sum(o_custkey), 1e-9), 6) AS factor, min(o_orderkey) - min(o_custkey) AS latency FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name")
def q_real_time(spark, sf_dir):
    """Amounts over keys, and the difference of their least values, as seconds would be."""
    named = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    rows = table(spark, sf_dir, "orders").join(named, F.col("c_custkey") == F.col("o_custkey"))
    out = metrics.real_time(rows, ["n_name"], "o_totalprice", "o_custkey", "o_orderkey", "o_custkey")
    return out.select("n_name", F.round("factor", 6).alias("factor"), "latency")


@query("SELECT user_id, event_id, round((event_id - lag(event_id) OVER w) / greatest(epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER w, 1e-6), 3) AS steps_per_second, CASE WHEN lag(event_id) OVER w IS NOT NULL THEN round(value / greatest(epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER w, 1e-6), 3) END AS audio_per_second FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def q_rates(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    out = metrics.rates(e, ["user_id"], "at", "event_id", "value")
    return out.select("user_id", "event_id", F.round("steps_per_second", 3).alias("steps_per_second"), F.round("audio_per_second", 3).alias("audio_per_second"))


# texts and votes


@query(f"WITH {_VOTED}, ws AS (SELECT doc_id, unnest(string_split(t, ' ')) AS w, generate_subscripts(string_split(t, ' '), 1) AS i FROM a) SELECT doc_id, string_agg(CASE WHEN l.word IS NULL THEN w ELSE w[:-2] || 'ة' END, ' ' ORDER BY i) AS text FROM ws LEFT JOIN lexicon l ON l.word = w GROUP BY doc_id")
def q_restored_text(spark, sf_dir):
    """The rewritten text itself."""
    docs = plain_documents(spark, sf_dir)
    return vo.restore(docs, vo.lexicon(vo.tally(vo.stub_marks(docs)))).select("doc_id", "text")


_HA_WORD = f"[{A.LETTERS}{_MC}]+"


@query(f"""WITH a AS (SELECT conv_id, turn, {ARABIC} AS t FROM conversations), p AS (SELECT conv_id, turn, regexp_extract_all(t, '{_HA_WORD}|[^{A.LETTERS}{_MC}]+') AS parts FROM a)
SELECT conv_id, turn, array_to_string(list_transform(parts, lambda s: CASE WHEN len(translate(s, '{_MC}', '')) % 2 = 1 AND contains(s, 'ه') AND regexp_full_match(s, '{_HA_WORD}') AND len(translate(s, '{_MC}', '')) < 5 THEN regexp_replace(s, 'ه([^ه]*)$', 'ة\\1') ELSE s END), '') AS t FROM p""")
def q_restore_marked(spark, sf_dir):
    """Words of marked running text by a lexicon of bare forms: here those of three letters (or one) with ه."""
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", ar.arabize(F.col("text")).alias("t"))
    words = F.regexp_extract_all("t", F.lit(f"[{A.LETTERS}{ar.quoted(A.MARKS)}]+"), F.lit(0))
    bare = F.array_distinct(F.transform(words, ar.strip_marks))
    chosen = F.filter(bare, lambda w: w.contains(A.HA) & (F.length(w) % 2 == 1) & (F.length(w) < 5))
    return t.select("conv_id", "turn", ar.restore_in_text(F.col("t"), chosen).alias("t"))


@query(f"WITH {_VOTED} SELECT t.word, f.freq FROM tally t JOIN freq f USING (word) WHERE t.word NOT IN (SELECT word FROM lexicon) ORDER BY f.freq DESC, t.word LIMIT 60")
def q_top_not_restored(spark, sf_dir):
    docs = plain_documents(spark, sf_dir)
    return vo.ranked(vo.report(vo.tally(vo.stub_marks(docs)), vo.word_frequency(docs, "text")), False)


@query(f"WITH {_VOTED} SELECT word FROM tally UNION SELECT word FROM lexicon UNION SELECT word FROM freq WHERE freq > 20")
def q_all_keys(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("text")))
    counts = stored(vo.counted(docs, vo.stub_pairs), "words")
    tally = vo.tally_of(counts)
    return vo.in_order(vo.all_keys(tally, vo.lexicon(tally), vo.frequency_of(counts).where("freq > 20")))


@query("SELECT conv_id * 100 + turn AS id, array_to_string(list_transform(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' '), lambda w: reverse(w)), ' ') AS text FROM conversations")
def q_through_model(spark, sf_dir):
    """Texts in chunks of words, through a model (here one that reverses words), and joined again."""
    df = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), "text")
    return models.through_model(df, "id", ar.pack_words(F.col("text"), 40), models.model_column(lambda: lambda texts: [" ".join(w[::-1] for w in t.split(" ")) for t in texts]))


@query("SELECT doc_id, CASE WHEN len(d) > 0 THEN 'unsupported characters: ' || array_to_string(list_sort(list_distinct(d)), ' ') END AS warning FROM (SELECT doc_id, regexp_extract_all(text, '[$+=^`|<>~]') AS d FROM documents)")
def q_warnings(spark, sf_dir):
    found = F.regexp_extract_all("text", F.lit("[$+=^`|<>~]"), F.lit(0))
    return table(spark, sf_dir, "documents").select("doc_id", manifest.warning(found).alias("warning"))


@query("SELECT doc_id AS id, CASE doc_id % 3 WHEN 0 THEN 'valid' WHEN 1 THEN 'train' ELSE 'test' END AS split, coalesce(b.text, d.text) AS text FROM documents d LEFT JOIN benchmark b ON item_id = doc_id")
def q_row_update(spark, sf_dir):
    """Split names of the manifest, and texts replaced by id with all other fields kept."""
    split = F.when(F.col("doc_id") % 3 == 0, "dev").when(F.col("doc_id") % 3 == 1, "train").otherwise("test")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), split.alias("split"), "text")
    return manifest.with_text(manifest.renamed_split(docs), table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text"))


@query("SELECT doc_id AS id FROM documents LEFT JOIN labels USING (doc_id) WHERE coalesce(toxic, 0) = 0 AND coalesce(quality, 1) = 1 AND n_chars / (3.0 + doc_id % 20) BETWEEN 1.5 AND 200.0 AND doc_id % 4 <> 0")
def q_early_kept(spark, sf_dir):
    """Rows that no test without the text drops and whose audio is in the listing."""
    raw = raw_metadata(spark, sf_dir)
    there = raw.where("id % 4 <> 0").select("id")
    return raw.where(manifest.early_reason(manifest.Limits(max_duration=200.0)).isNull()).join(there, "id", "left_semi").select("id")


# settings and weights


@query("SELECT o_orderkey, o_custkey AS width, 24 AS depth, o_orderstatus AS name FROM orders")
def q_override_fields(spark, sf_dir):
    """A nested setting with one field replaced by its dotted path."""
    setting = F.struct(F.struct(F.col("o_custkey").alias("width"), F.lit(6).alias("depth")).alias("model"), F.col("o_orderstatus").alias("name"))
    s = table(spark, sf_dir, "orders").select("o_orderkey", config.fields_overridden(setting, {"model.depth": F.lit(24)}).alias("s"))
    return s.select("o_orderkey", "s.model.width", "s.model.depth", "s.name")


@query("SELECT n_nationkey, '/data/v2/' || n_name || '/v2' AS path FROM nation")
def q_env_expansion(spark, sf_dir):
    text = F.concat(F.lit("${ROOT}/$VERSION/"), F.col("n_name"), F.lit("/${VERSION}"))
    return table(spark, sf_dir, "nation").select("n_nationkey", config.variables_expanded(text, {"ROOT": "/data", "VERSION": "v2"}).alias("path"))


@query("SELECT p_partkey, CASE WHEN starts_with(p_name, 'a') THEN p_retailprice ELSE coalesce(m, p_retailprice) END AS value FROM part LEFT JOIN (SELECT l_partkey, max(l_extendedprice) AS m FROM lineitem WHERE l_quantity > 45 GROUP BY 1) ON l_partkey = p_partkey")
def q_weight_match(spark, sf_dir):
    """Values of a second source by key, but for names with a protected prefix."""
    base = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.col("p_retailprice").alias("value"))
    other = table(spark, sf_dir, "lineitem").where("l_quantity > 45").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.max("l_extendedprice").alias("value"))
    return weights.matched(base, other, ["p_partkey"], protected=["a"], key="p_name").select("p_partkey", "value")


@query("SELECT p_partkey, coalesce(s_acctbal, p_retailprice) AS value FROM part LEFT JOIN supplier ON s_suppkey = p_partkey")
def q_ema_overlay(spark, sf_dir):
    base = table(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").alias("value"))
    return weights.overlay(base, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("p_partkey"), F.col("s_acctbal").alias("value")), "p_partkey")


@query("SELECT c_custkey, substr(c_name, 10) AS c_name FROM customer WHERE starts_with(c_name, 'Customer#')")
def q_prefix_removed(spark, sf_dir):
    return weights.with_prefix(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_name", "Customer#")


@query("SELECT l_orderkey, min(l_partkey) AS l_partkey FROM lineitem GROUP BY l_orderkey HAVING count(*) = 1")
def q_scalar_rows(spark, sf_dir):
    """Only values of one element."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_partkey").alias("l_partkey"))
    return weights.scalars(rows, "l_partkey")


@query("SELECT count(*) AS n, max(n_regionkey) AS top FROM nation")
def q_checked(spark, sf_dir):
    """A row of totals that passes its checks, or no result at all."""
    one = table(spark, sf_dir, "nation").agg(F.count(F.lit(1)).alias("n"), F.max("n_regionkey").alias("top"))
    return weights.checked(one, rows=F.col("n") > 0, regions=F.col("top") < 100)


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 40")
def q_batch_limit(spark, sf_dir):
    """The first five batches of eight; 0 would be all."""
    ordered = running_number(table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"], "n").withColumn("batch", F.expr("n div 8"))
    return weights.first_batches(ordered, "batch", 5).unionByName(weights.first_batches(ordered.where("o_orderkey < 0"), "batch", 0)).select("o_orderkey")


@query("SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey, CASE WHEN o_orderstatus = 'O' THEN 'optimizer' ELSE 'checkpoint' END ORDER BY o_orderdate DESC, o_orderkey DESC) AS n, o_orderstatus AS s FROM orders) WHERE n <= CASE WHEN s = 'O' THEN 1 ELSE 3 END")
def q_retention_kinds(spark, sf_dir):
    """Three checkpoints and one optimizer of each run stay."""
    files = table(spark, sf_dir, "orders").withColumn("kind", F.when(F.col("o_orderstatus") == "O", "optimizer").otherwise("checkpoint"))
    return weights.retained(files, ["o_custkey"], "kind", [F.desc("o_orderdate"), F.desc("o_orderkey")], {"checkpoint": 3, "optimizer": 1}).select("o_orderkey")


@query("SELECT CAST(sum(len(embedding)) AS BIGINT) AS n, round(max(list_max(list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE))))), 6) AS largest FROM embeddings")
def q_sanity(spark, sf_dir):
    """All numbers are finite, some aren't zero, and count and width are those of the table as read before."""
    v = vectors(spark, sf_dir)
    before = v.agg(F.sha2(F.count(F.lit(1)).cast("string"), 256).alias("digest"), F.max(F.size("v")).alias("window"))  # one row
    found = weights.sanity(v.join(F.broadcast(before)), "v", F.sha2(F.count(F.lit(1)).cast("string"), 256), F.max("digest"), F.min(F.size("v")), F.max("window"))
    return found.select("n", F.round("largest", 6).alias("largest"))


@query("SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS place FROM documents")
def q_sorted_by_id(spark, sf_dir):
    """Documents in order of id, each with its place."""
    return running_number(table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"], "place")


@query("SELECT l_orderkey, min([CAST(l_linenumber AS BIGINT), l_partkey])[2] AS first, max([CAST(l_linenumber AS BIGINT), l_partkey])[2] AS last FROM lineitem GROUP BY l_orderkey")
def q_first_last(spark, sf_dir):
    """First and last element of an order's lines, by number and part."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("l"))
    return lines.select("l_orderkey", F.element_at("l", 1)["l_partkey"].alias("first"), F.element_at("l", -1)["l_partkey"].alias("last"))


@query("SELECT n_nationkey, CAST(unnest(list_concat(range(0, CAST(ceil(n / 2.0) AS BIGINT)), range(depth - n // 2, depth))) AS BIGINT) AS layer FROM (SELECT n_nationkey, 12 + n_regionkey AS depth, 1 + n_nationkey % 12 AS n FROM nation)")
def q_layers_chosen(spark, sf_dir):
    """Layers of models of different depths."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", (12 + F.col("n_regionkey")).alias("depth"), (1 + F.col("n_nationkey") % 12).alias("n"))
    return n.select("n_nationkey", F.explode(weights.selected_layers(F.col("depth"), F.col("n"))).alias("layer"))


@query("SELECT o_orderkey, 'block_' || k || '_' || o_orderstatus AS old, 'layers.' || CAST(list_position([0, 1, 22, 23], k) - 1 AS VARCHAR) || '.' || o_orderstatus AS new FROM (SELECT *, CAST(o_custkey % 24 AS INTEGER) AS k FROM orders) WHERE list_contains([0, 1, 22, 23], k)")
def q_layers_renamed(spark, sf_dir):
    """Keys of another form, by another pattern."""
    old = F.concat(F.lit("block_"), (F.col("o_custkey") % 24).cast("string"), F.lit("_"), "o_orderstatus")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", old.alias("old"))
    return weights.renamed_layers(rows, "old", [0, 1, 22, 23], r"^block_(\d+)_(.*)$").select("o_orderkey", "old", "new")
