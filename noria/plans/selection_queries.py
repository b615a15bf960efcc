"""Seeded choices, top-k, key matching, checks and range joins over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from noria.functions import alphabet as A
from noria.functions import arabic as ar
from noria.operators import metrics, samples, weights
from noria.operators import votes as vo
from noria.operators.ordering import number_within, running_number

from .registry import query, table
from .text_queries import _MC, _WORDS, ARABIC, plain_documents

_U = "CAST('0x' || md5({})[:7] AS BIGINT) / 268435456.0"


@query("SELECT doc_id, CAST(row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR) || ':11'), doc_id) - 1 AS BIGINT) AS place FROM documents")
def q_permutation(spark, sf_dir):
    """A seeded permutation; no task sees all rows."""
    order = [F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), F.lit("11"))), F.col("doc_id")]
    return running_number(table(spark, sf_dir, "documents").select("doc_id"), order, "place")


@query("SELECT user_id, arg_min(event_id, md5(CAST(event_id AS VARCHAR) || ':5')) AS event_id FROM events GROUP BY user_id")
def q_random_choice(spark, sf_dir):
    """One event of each user, chosen by hash."""
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.min_by("event_id", F.md5(F.concat_ws(":", F.col("event_id").cast("string"), F.lit("5")))).alias("event_id"))


@query("SELECT doc_id FROM documents ORDER BY md5(CAST(doc_id AS VARCHAR) || ':3'), doc_id LIMIT 20")
def q_random_k(spark, sf_dir):
    """The sampling operator: 20 rows by hash."""
    return table(spark, sf_dir, "documents").orderBy(F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), F.lit("3"))), "doc_id").limit(20).select("doc_id")


@query(f"SELECT conv_id, turn, {_U.format(chr(39).join(['CAST(conv_id AS VARCHAR) || ', ':', ' || CAST(turn AS VARCHAR) || ', ':9', '']))} < 0.25 AS kept FROM conversations")
def q_keep_mask(spark, sf_dir):
    """Bernoulli masks by hash."""
    u = samples.uniform(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"), F.lit("9")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", (u < 0.25).alias("kept"))


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 8")
def q_longest(spark, sf_dir):
    return table(spark, sf_dir, "documents").orderBy(F.desc("n_chars"), "doc_id").limit(8).select("doc_id", "n_chars")


@query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) <= 3")
def q_worst_three(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("value", "event_id")
    return table(spark, sf_dir, "events").withColumn("k", F.row_number().over(w)).where("k <= 3").select("user_id", "event_id")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN starts_with(p_name, 'a') OR p_retailprice IS NULL THEN l_extendedprice ELSE p_retailprice END AS v FROM lineitem LEFT JOIN part ON p_partkey = l_partkey")
def q_override(spark, sf_dir):
    """Values of a second source replace the first's by key, but for names with a given prefix."""
    joined = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey"), "left")
    keep = F.col("p_name").startswith("a") | F.col("p_retailprice").isNull()
    return joined.select("l_orderkey", "l_linenumber", F.when(keep, F.col("l_extendedprice")).otherwise(F.col("p_retailprice")).alias("v"))


@query("SELECT l_orderkey, l_linenumber, 'layers.' || k || '.' || l_returnflag AS old, 'layers.' || CAST(list_position([0, 1, 2, 21, 22, 23], k) - 1 AS VARCHAR) || '.' || l_returnflag AS new FROM (SELECT *, CAST(l_partkey % 24 AS INTEGER) AS k FROM lineitem) WHERE list_contains([0, 1, 2, 21, 22, 23], k)")
def q_layer_rename(spark, sf_dir):
    """Keys of the selected layers, numbered anew; those of other layers go."""
    old = F.concat(F.lit("layers."), (F.col("l_partkey") % 24).cast("string"), F.lit("."), "l_returnflag")
    keys = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", old.alias("old"))
    return weights.renamed_layers(keys, "old", [0, 1, 2, 21, 22, 23]).select("l_orderkey", "l_linenumber", "old", "new")


@query("SELECT count(*) AS unexpected FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)")
def q_unexpected_keys(spark, sf_dir):
    return weights.unexpected(table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents"), "doc_id").agg(F.count(F.lit(1)).alias("unexpected"))


@query("SELECT CAST(e AS BIGINT) AS epoch, conv_id, turn FROM conversations, range(3) r(e)")
def q_epochs(spark, sf_dir):
    """Each row once an epoch: an explode, not a join."""
    return table(spark, sf_dir, "conversations").select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("epoch"), "conv_id", "turn")


@query("SELECT event_id, i % 5 = 0 AS logged, i % 5 = 0 OR i - 2 <= 10 AS verbose FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events)")
def q_step_schedule(spark, sf_dir):
    """Each user's events as steps of a run that begins at step 2: which are logged, and which in the run's first ten too."""
    steps = number_within(table(spark, sf_dir, "events").select("user_id", "ts", "event_id"), ["user_id"], ["ts", "event_id"], "i")
    return steps.select("event_id", metrics.due(F.col("i"), 5).alias("logged"), metrics.due(F.col("i"), 5, F.lit(2), 10).alias("verbose"))


@query("SELECT l_returnflag, round(sum(l_extendedprice) / greatest(sum(l_quantity), 1e-9), 6) AS factor FROM lineitem GROUP BY l_returnflag")
def q_real_time_factor(spark, sf_dir):
    """One sum over another, floored."""
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(F.sum("l_extendedprice") / F.greatest(F.sum("l_quantity"), F.lit(1e-9)), 6).alias("factor"))


@query("SELECT count(*) AS n, count(*) FILTER (isnan(value)) AS bad FROM events")
def q_finite_or_abort(spark, sf_dir):
    """Counts, with an error where a value is not a number."""
    e = table(spark, sf_dir, "events").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.isnan("value")).alias("bad"))
    return e.select("n", "bad", F.assert_true(F.col("bad") == 0, "values that are not numbers").alias("ok")).select("n", F.when(F.col("ok").isNull(), F.col("bad")).alias("bad"))


@query(f"WITH {_WORDS}, d AS (SELECT doc_id, count(*) FILTER (word <> '') AS n_words FROM pairs GROUP BY doc_id) SELECT doc_id, doc_id % 7 <> 0 OR n_words = 0 AS valid FROM d")
def q_diacritics_valid(spark, sf_dir):
    """Marked texts whose bare words are the text's; each seventh gets a word too many."""
    docs = vo.stub_marks(plain_documents(spark, sf_dir))
    docs = docs.withColumn("diac", F.when((F.col("doc_id") % 7 == 0) & (F.col("text") != ""), F.concat("diac", F.lit(" ب"))).otherwise(F.col("diac")))
    return vo.valid_diacritics(docs).select("doc_id", F.col("diac").isNotNull().alias("valid"))


_FRAMES = "u AS (SELECT c_custkey AS id, 1 + c_custkey % 7 AS frames, CAST(coalesce(sum(1 + c_custkey % 7) OVER (ORDER BY c_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS off FROM customer)"


@query(f"WITH {_FRAMES} SELECT id, CAST(count(o_orderkey) AS BIGINT) AS n, CAST(coalesce(sum(o_orderkey), 0) AS BIGINT) AS s FROM u LEFT JOIN orders ON o_orderkey >= off AND o_orderkey < off + frames GROUP BY id")
def q_frame_join(spark, sf_dir):
    """Rows of a range [offset, offset + frames): the range becomes keys, so the join is by equality."""
    u = running_number(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (1 + F.col("c_custkey") % 7).alias("frames")), ["id"], "off", F.col("frames"))
    keys = u.select("id", F.explode(F.sequence(F.col("off"), F.col("off") + F.col("frames") - 1)).alias("o_orderkey"))
    joined = keys.join(table(spark, sf_dir, "orders").select("o_orderkey", F.lit(True).alias("there")), "o_orderkey", "left")
    return joined.groupBy("id").agg(F.count("there").alias("n"), F.coalesce(F.sum(F.when(F.col("there"), F.col("o_orderkey"))), F.lit(0)).alias("s"))


@query("SELECT n_nationkey, r_name, coalesce(n, 0) AS n FROM nation JOIN region ON r_regionkey = n_regionkey LEFT JOIN (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) ON c_nationkey = n_nationkey")
def q_stitch_join(spark, sf_dir):
    """A foreign-key lookup and a count that may be missing."""
    n = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("n"))
    named = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    return named.join(n, "n_nationkey", "left").select("n_nationkey", "r_name", F.coalesce("n", F.lit(0)).alias("n"))


def _duck_chance(key: str) -> str:
    return f"CAST('0x' || md5({key})[:7] AS BIGINT) / 268435456.0"


_MARKED = f"CASE WHEN length(w) < 2 THEN w ELSE substr(w, 1, length(w) - 1) || CASE (doc_id + length(w)) % 3 WHEN 0 THEN '{A.FATHA}' WHEN 1 THEN '{A.DAMMA}' ELSE '' END || right(w, 1) END"


@query(
    f"WITH a AS (SELECT doc_id, trim(regexp_replace(translate({ARABIC}, '{_MC}', ''), '\\s+', ' ', 'g')) AS t, {_duck_chance("doc_id || ':1'")} AS u FROM documents), "
    "m AS (SELECT *, CASE WHEN u < 0.55 THEN 'plain' WHEN u < 0.85 THEN 'partial' ELSE 'full' END AS mode FROM a), "
    f"x AS (SELECT doc_id, mode, array_to_string(list_transform(string_split(t, ' '), lambda w, i: CASE WHEN mode = 'full' OR mode = 'partial' AND {_duck_chance("doc_id || ':' || (i - 1)")} < 0.3 THEN {_MARKED} ELSE w END), ' ') AS t FROM m) "
    f"SELECT doc_id, mode, t, regexp_matches(t, '[{A.DIACRITICS}]') AS marked FROM x"
)
def q_mixed_text(spark, sf_dir):
    """Plain, partly and fully marked texts by chance."""
    docs = vo.stub_marks(plain_documents(spark, sf_dir)).withColumn("k", F.col("doc_id").cast("string"))
    words = F.transform(F.arrays_zip(F.split("text", " ").alias("word"), F.split("diac", " ").alias("diac")), lambda w: F.struct(w["word"].alias("word"), w["diac"].alias("diac")))
    mode = samples.mix_mode(samples.uniform(F.concat_ws(":", "k", F.lit("1"))))
    return docs.select("doc_id", mode.alias("mode"), samples.mixed_text(words, F.col("k"), mode, F.lit(0.3)).alias("t")).withColumn("marked", ar.has_marks(F.col("t")))
