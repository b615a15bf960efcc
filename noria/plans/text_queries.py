"""Text operators over the driver's tables, with DuckDB twins written for that engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noria.functions import alphabet as A
from noria.functions import arabic as ar
from noria.functions import numerals as nu
from noria.operators import votes as vo
from noria.session import spread

from .registry import query, table

_L, _V = A.LETTERS, A.VOWELS
_MC = A.DIACRITICS + A.MARKER
#: DuckDB: the arabized text of a table.
ARABIC = f"translate(lower(text), '{A.LATIN}', '{A.AS_ARABIC}')"

#: The same with digits as letters, for rules that come after numbers are words.
LETTERED = f"translate(lower(text), '{A.LATIN}0123456789', '{A.AS_ARABIC}{A.LETTERS[3:13]}')"


def arabic_documents(spark: SparkSession, sf_dir: str, digits: bool = False) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", ar.arabize(F.col("text"), digits).alias("t"))


def _docs(expression: str, columns: str = "doc_id", where: str = "", source: str = "documents") -> str:
    return f"WITH a AS (SELECT {columns}, {ARABIC} AS t FROM {source}) SELECT {columns}, {expression} FROM a {where}"


def _canonical(cluster: str) -> str:
    """DuckDB: a cluster (character and marks) in canonical form."""
    return (
        f"CASE WHEN contains('{_L}', {cluster}[1]) THEN {cluster}[1] || CASE WHEN contains({cluster}, '~') AND {cluster}[1] <> 'ة' THEN '~' ELSE '' END"
        f" || CASE WHEN contains({cluster}, '{A.SHADDA}') AND NOT contains('{A.NO_SHADDA}', {cluster}[1]) THEN '{A.SHADDA}' ELSE '' END"
        f" || regexp_extract({cluster}, '([{_V}])[^{_V}]*$', 1) WHEN contains('{_MC}', {cluster}[1]) THEN '' ELSE {cluster}[1] END"
    )


def duck_canonicalize(t: str) -> str:
    return f"array_to_string(list_transform(regexp_extract_all({t}, '(?s).[{_MC}]*'), lambda c: {_canonical('c')}), '')"


def duck_clean(t: str) -> str:
    t = f"regexp_replace({t}, '[.!?؟…۔]', ' . ', 'g')"
    t = f"regexp_replace({t}, '[,،;؛:–—]', ' , ', 'g')"
    return f"regexp_replace({t}, '[^{_L}{_MC} .,]', ' ', 'g')"


def duck_tidy(t: str) -> str:
    t = f"trim(regexp_replace({t}, '\\s+', ' ', 'g'))"
    t = f"regexp_replace({t}, '(?:, )*\\.(?: [.,])*', '.', 'g')"
    t = f"regexp_replace({t}, ',(?: ,)+', ',', 'g')"
    return f"regexp_replace(regexp_replace({t}, '^[.,] ?', ''), ' ([.,])', '\\1', 'g')"


@query(_docs(f"translate(t, '{_MC}', '') AS bare"))
def q_strip_marks(spark, sf_dir):
    return arabic_documents(spark, sf_dir).select("doc_id", ar.strip_marks(F.col("t")).alias("bare"))


@query(_docs(f"regexp_matches(t, '[{A.DIACRITICS}]') AS marked"))
def q_has_marks(spark, sf_dir):
    return arabic_documents(spark, sf_dir).select("doc_id", ar.has_marks(F.col("t")).alias("marked"))


@query(_docs(f"CAST(len(regexp_extract_all(t, '(?s).[{_MC}]*')) AS BIGINT) AS n_clusters, md5(array_to_string(regexp_extract_all(t, '(?s).[{_MC}]*'), '|')) AS digest"))
def q_clusters(spark, sf_dir):
    c = ar.clusters(F.col("t"))
    return arabic_documents(spark, sf_dir).select("doc_id", F.size(c).cast("long").alias("n_clusters"), F.md5(F.array_join(c, "|")).alias("digest"))


@query(_docs(f"{duck_canonicalize('t')} AS canonical"))
def q_canonical(spark, sf_dir):
    return arabic_documents(spark, sf_dir).select("doc_id", ar.canonicalize(F.col("t")).alias("canonical"))


@query(_docs(f"{duck_canonicalize(chr(39).join(['translate(nfc_normalize(t), ', A.EGYPTIAN_SIGN + A.DIACRITIZER_SYMBOLS, ', ', '~', ')']))} AS cleaned"))
def q_cleanup(spark, sf_dir):
    return arabic_documents(spark, sf_dir).select("doc_id", ar.clean_diacritized(F.col("t")).alias("cleaned"))


@query(_docs(f"{duck_clean('t')} AS clean"))
def q_clean_chars(spark, sf_dir):
    return arabic_documents(spark, sf_dir).select("doc_id", ar.clean_characters(F.col("t")).alias("clean"))


@query(_docs("array_to_string(regexp_extract_all(t, '[$+=^`0-9]'), '') AS dropped, array_to_string(list_sort(list_distinct(regexp_extract_all(t, '[$+=^`0-9]'))), '') AS distinct_dropped"))
def q_dropped_chars(spark, sf_dir):
    """The tables' only dropped characters are digits and ASCII signs; the twin names them."""
    d = ar.dropped_characters(F.col("t"))
    return arabic_documents(spark, sf_dir).select("doc_id", F.array_join(d, "").alias("dropped"), F.array_join(F.array_sort(F.array_distinct(d)), "").alias("distinct_dropped"))


@query(_docs(f"{duck_tidy(duck_clean('t'))} AS tidy"))
def q_tidy_punct(spark, sf_dir):
    df = arabic_documents(spark, sf_dir).withColumn("t", ar.clean_characters(F.col("t")))
    return df.select("doc_id", ar.tidy_punctuation(F.col("t")).alias("tidy"))


_NORMAL = duck_tidy(duck_canonicalize(duck_clean("nfc_normalize(t)")))
_NORMAL_CTE = f"a AS (SELECT doc_id, {LETTERED} AS t FROM documents), n AS (SELECT doc_id, {_NORMAL} AS normal FROM a)"


def normal_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and normal text. Digits come in as letters: DuckDB can't follow the number rules, which q_expand and tests cover."""
    return ar.normalize(arabic_documents(spark, sf_dir, digits=True), "t", "normal")


@query(None)
def q_normalize_numbers(spark, sf_dir):
    """The whole front end, numbers included."""
    return ar.normalize(arabic_documents(spark, sf_dir), "t", "normal").select("doc_id", "normal")


#: ASCII letters as the characters that unifying rewrites or drops.
_TO_UNIFY = A.LETTER_FROM + A.ARABIC_DIGITS + A.PERSIAN_DIGITS + A.EGYPTIAN_SIGN + A.INVISIBLE + A.TATWEEL
_ASCII = ("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789.,;:!?")[: len(_TO_UNIFY)]


@query(f"SELECT conv_id, turn, translate(translate(text, '{_ASCII}', '{_TO_UNIFY[: len(_ASCII)]}'), '{A.ARABIC_DIGITS}{A.PERSIAN_DIGITS}{A.LETTER_FROM}{A.EGYPTIAN_SIGN}{A.INVISIBLE}{A.TATWEEL}', '01234567890123456789{A.LETTER_TO}~') AS t FROM conversations")
def q_unify(spark, sf_dir):
    """Texts made of the characters that the rule is for: foreign digits and letters, invisible signs, tatweel."""
    t = table(spark, sf_dir, "conversations").withColumn("t", F.translate("text", _ASCII, _TO_UNIFY[: len(_ASCII)]))
    return t.select("conv_id", "turn", ar.unify(F.col("t")).alias("t"))


@query(f"WITH {_NORMAL_CTE} SELECT doc_id, normal FROM n")
def q_normalize(spark, sf_dir):
    return normal_documents(spark, sf_dir).select("doc_id", "normal")


@query(f"WITH {_NORMAL_CTE} SELECT doc_id, trim(regexp_replace(regexp_replace(translate(normal, '{_MC}', ''), '[,.]', ' ', 'g'), '\\s+', ' ', 'g')) AS plain FROM n")
def q_plain_text(spark, sf_dir):
    return normal_documents(spark, sf_dir).select("doc_id", ar.plain_text(F.col("normal")).alias("plain"))


# numbers

_SMALL = "['" + "','".join(A.below_thousand()) + "']"


def _duck_and(head: str, rest: str, words: str) -> str:
    return f"CASE WHEN {rest} = 0 THEN {head} ELSE {head} || ' و' || {words} END"


def _duck_below_million(n: str) -> str:
    th, rest = f"({n} // 1000)", f"({n} % 1000)"
    head = f"CASE WHEN {th} = 1 THEN 'الف' WHEN {th} = 2 THEN 'الفين' WHEN {th} <= 10 THEN w.s[{th} + 1] || ' تلاف' ELSE w.s[{th} + 1] || ' الف' END"
    return f"CASE WHEN {n} < 1000 THEN w.s[{n} + 1] ELSE {_duck_and('(' + head + ')', rest, f'w.s[{rest} + 1]')} END"


def _duck_digits(d: str) -> str:
    for i, word in enumerate(A.ONES):
        d = f"replace({d}, '{i}', '{word} ')"
    return f"trim({d})"


def duck_words(n: str) -> str:
    m, rest = f"({n} // 1000000)", f"({n} % 1000000)"
    head = f"CASE WHEN {m} = 1 THEN 'مليون' WHEN {m} = 2 THEN 'اتنين مليون' ELSE w.s[{m} + 1] || ' مليون' END"
    return f"CASE WHEN {n} < 1000000 THEN {_duck_below_million(n)} WHEN {n} < 1000000000 THEN {_duck_and('(' + head + ')', rest, '(' + _duck_below_million(rest) + ')')} ELSE {_duck_digits(f'CAST({n} AS VARCHAR)')} END"


@query(f"WITH w AS (SELECT {_SMALL} AS s), x AS (SELECT DISTINCT l_partkey * 37 + l_orderkey * 1009 AS n FROM lineitem UNION SELECT CAST(l_quantity AS BIGINT) FROM lineitem) SELECT n, {duck_words('n')} AS words FROM x, w")
def q_number_words(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    n = li.select((F.col("l_partkey") * 37 + F.col("l_orderkey") * 1009).alias("n")).union(li.select(F.col("l_quantity").cast("long"))).distinct()
    return n.select("n", nu.number_words(F.col("n")).alias("words"))


@query(f"WITH w AS (SELECT {_SMALL} AS s), x AS (SELECT DISTINCT regexp_extract_all(text, '[0-9]+') AS d FROM documents), y AS (SELECT DISTINCT unnest(d) AS digits FROM x), z AS (SELECT digits, CASE WHEN length(digits) > 9 THEN NULL ELSE CAST(digits AS BIGINT) END AS n FROM y) SELECT digits, CASE WHEN length(digits) > 9 THEN {_duck_digits('digits')} ELSE {duck_words('n')} END AS words FROM z, w")
def q_digit_strings(spark, sf_dir):
    found = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0))).alias("digits")).distinct()
    return found.select("digits", nu.digit_words(F.col("digits")).alias("words"))


@query(f"WITH w AS (SELECT {_SMALL} AS s), x AS (SELECT DISTINCT CAST(CAST(floor(l_extendedprice) AS BIGINT) AS VARCHAR) || '.' || CAST(l_linenumber AS VARCHAR) AS token, CAST(floor(l_extendedprice) AS BIGINT) AS n, CAST(l_linenumber AS BIGINT) AS f FROM lineitem) SELECT token, ({duck_words('n')}) || ' فاصلة ' || w.s[f + 1] AS words FROM x, w")
def q_decimals(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    token = li.select(F.concat(F.floor("l_extendedprice").cast("string"), F.lit("."), F.col("l_linenumber").cast("string")).alias("token")).distinct()
    return token.select("token", nu.decimal_words(F.col("token")).alias("words"))


@query(
    f"WITH RECURSIVE w AS (SELECT {_SMALL} AS s), x AS (SELECT o_orderkey, 'طلب ' || CAST(o_orderkey AS VARCHAR) || ' ثمن ' || CAST(o_custkey % 977 AS VARCHAR) || '%' AS t, o_custkey % 977 AS c FROM orders)"
    f" SELECT o_orderkey, 'طلب ' || ({duck_words('o_orderkey')}) || ' ثمن ' || ({duck_words('c')}) || ' في المية' AS said FROM x, w"
)
def q_expand(spark, sf_dir):
    """A sentence with a plain number and a share for each order."""
    orders = table(spark, sf_dir, "orders")
    text = F.concat(F.lit("طلب "), F.col("o_orderkey").cast("string"), F.lit(" ثمن "), (F.col("o_custkey") % 977).cast("string"), F.lit("%"))
    return orders.select("o_orderkey", nu.expand(text).alias("said"))


_MONTHS = "['" + "','".join(A.MONTHS) + "']"


@query(
    f"""WITH w AS (SELECT {_SMALL} AS s), x AS (SELECT o_orderkey, o_orderkey % 28 + 1 AS d, o_custkey % 14 AS m, 1990 + o_custkey % 30 AS y, CASE WHEN o_orderkey % 2 = 0 THEN '/' ELSE '-' END AS p FROM orders),
v AS (SELECT x.*, {duck_words('d')} AS dw, {duck_words('m')} AS mw, {duck_words('y')} AS yw FROM x, w)
SELECT o_orderkey, 'يوم ' || CASE WHEN m BETWEEN 1 AND 12 THEN dw || ' ' || {_MONTHS}[m] || ' سنة ' || yw WHEN o_orderkey % 3 = 0 THEN yw || p || mw || p || dw ELSE dw || p || mw || p || yw END AS said FROM v"""
)
def q_expand_dates(spark, sf_dir):
    """Dates in both orders and with both signs; where the month is none, plain numbers."""
    d, m, y = F.col("o_orderkey") % 28 + 1, F.col("o_custkey") % 14, F.col("o_custkey") % 30 + 1990
    sign = F.when(F.col("o_orderkey") % 2 == 0, "/").otherwise("-")
    date = F.when(F.col("o_orderkey") % 3 == 0, F.concat_ws("|", y, m, d)).otherwise(F.concat_ws("|", d, m, y))
    text = F.concat(F.lit("يوم "), F.replace(date, F.lit("|"), sign))
    return table(spark, sf_dir, "orders").select("o_orderkey", nu.expand(text).alias("said"))


@query(
    f"""WITH w AS (SELECT {_SMALL} AS s), x AS (SELECT o_orderkey, o_custkey % 27 AS h, o_orderkey % 70 AS m FROM orders), v AS (SELECT x.*, {duck_words('h')} AS hw, {duck_words('m')} AS mw FROM x, w)
SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'الساعة ' WHEN h <= 24 AND m <= 59 THEN 'معاد الساعة ' ELSE 'معاد ' END || hw || CASE WHEN h <= 24 AND m <= 59 THEN CASE WHEN m > 0 THEN ' و' || mw || ' دقيقة' ELSE '' END ELSE ':' || mw END AS said FROM v"""
)
def q_expand_clock(spark, sf_dir):
    """Times with and without the word for hour; what is no time is read as numbers."""
    h, m = F.col("o_custkey") % 27, F.col("o_orderkey") % 70
    text = F.concat(F.when(F.col("o_orderkey") % 2 == 0, "الساعة ").otherwise("معاد "), h.cast("string"), F.lit(":"), F.lpad(m.cast("string"), 2, "0"))
    return table(spark, sf_dir, "orders").select("o_orderkey", nu.expand(text).alias("said"))


@query(
    f"""WITH w AS (SELECT {_SMALL} AS s), x AS (SELECT o_orderkey, o_custkey AS n, o_orderkey % 100 AS f FROM orders), v AS (SELECT x.*, {duck_words('n')} AS nw, {duck_words('f')} AS fw FROM x, w)
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'سعر ' || nw || ' دولار' WHEN 1 THEN 'سعر ' || nw || ' يورو' WHEN 2 THEN 'سعر ' || nw || ' فاصلة ' || fw || ' جنيه استرليني' ELSE 'سعر دولار , ' || nw || ' قطعة' END AS said FROM v"""
)
def q_expand_money(spark, sf_dir):
    """Amounts with the sign before or after, decimals, and a sign alone."""
    n, k = F.col("o_custkey").cast("string"), F.col("o_orderkey") % 4
    cents = F.concat(n, F.lit("."), (F.col("o_orderkey") % 100).cast("string"))
    text = F.when(k == 0, F.concat(F.lit("سعر $"), n)).when(k == 1, F.concat(F.lit("سعر "), n, F.lit(" €"))).when(k == 2, F.concat(F.lit("سعر £ "), cents)).otherwise(F.concat(F.lit("سعر $ , "), n, F.lit(" قطعة")))
    return table(spark, sf_dir, "orders").select("o_orderkey", nu.expand(text).alias("said"))


@query(
    f"""WITH w AS (SELECT {_SMALL} AS s), x AS (SELECT o_orderkey, CAST(floor(o_totalprice * 37) AS BIGINT) AS n, o_custkey % 977 AS f FROM orders), v AS (SELECT x.*, {duck_words('n')} AS nw, {duck_words('f')} AS fw FROM x, w)
SELECT o_orderkey, 'عدد ' || nw || CASE WHEN o_orderkey % 3 = 2 THEN ' فاصلة ' || fw ELSE '' END || ' حبة' AS said FROM v"""
)
def q_expand_separators(spark, sf_dir):
    """Both thousands separators, the Arabic decimal sign, and letters that touch digits."""
    n, k = F.floor(F.col("o_totalprice") * 37), F.col("o_orderkey") % 3
    grouped = F.format_number(n, 0)
    number = F.when(k == 0, grouped).when(k == 1, F.replace(grouped, F.lit(","), F.lit("٬"))).otherwise(F.concat(grouped, F.lit("٫"), (F.col("o_custkey") % 977).cast("string")))
    return table(spark, sf_dir, "orders").select("o_orderkey", nu.expand(F.concat(F.lit("عدد"), number, F.lit("حبة"))).alias("said"))


# tokens

_VOCABULARY = "MAP {" + ", ".join(f"'{t}': {i}" for i, t in enumerate(A.vocabulary())) + "}"
_TOKENS = f"regexp_extract_all(t, 'ة[{_V}]|(?s:.)')"


@query(
    "WITH v AS (SELECT * FROM (VALUES " + ", ".join(f"(CAST({i} AS INTEGER), '{t}')" for i, t in enumerate(A.vocabulary())) + ") v(id, token)), "
    f"a AS (SELECT {ARABIC} AS t FROM conversations), c AS (SELECT token, count(*) AS n FROM (SELECT unnest({_TOKENS}) AS token FROM a) GROUP BY token) "
    "SELECT id, v.token, coalesce(n, 0) AS n FROM v LEFT JOIN c ON c.token = v.token"
)
def q_vocab(spark, sf_dir):
    """The vocabulary, with how often each token occurs in the conversations."""
    said = table(spark, sf_dir, "conversations").select(F.explode(ar.tokens(ar.arabize(F.col("text")))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    vocabulary = spark.range(1).select(F.posexplode(F.array(*[F.lit(t) for t in A.vocabulary()])).alias("id", "token"))
    return F.broadcast(vocabulary).join(said, "token", "left").select("id", "token", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"WITH m AS MATERIALIZED (SELECT {_VOCABULARY} AS v), a AS (SELECT conv_id, turn, {ARABIC} AS t FROM conversations) SELECT conv_id, turn, CAST(len({_TOKENS}) AS BIGINT) AS n_tokens, array_to_string(list_transform({_TOKENS}, lambda x: coalesce(m.v[x], 0)), ',') AS ids FROM a, m")
def q_tokenize(spark, sf_dir):
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", ar.arabize(F.col("text")).alias("t"))
    ids = t.select("conv_id", "turn", ar.token_ids(F.col("t")).alias("ids"))
    return ids.select("conv_id", "turn", F.size("ids").cast("long").alias("n_tokens"), F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


@query(f"WITH m AS MATERIALIZED (SELECT {_VOCABULARY} AS v), a AS (SELECT conv_id, turn, {ARABIC} AS t FROM conversations) SELECT conv_id, turn, array_to_string(list_transform({_TOKENS}, lambda x: CASE WHEN m.v[x] IS NULL THEN '[UNK]' ELSE x END), '') AS back FROM a, m")
def q_detokenize(spark, sf_dir):
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", ar.token_ids(ar.arabize(F.col("text"))).alias("ids"))
    return t.select("conv_id", "turn", ar.detokenize(F.col("ids")).alias("back"))


@query(f"WITH a AS (SELECT {ARABIC} AS t FROM documents), w AS (SELECT unnest(string_split(trim(regexp_replace(t, '\\s+', ' ', 'g')), ' ')) AS word FROM a) SELECT word, count(*) AS freq FROM w WHERE word <> '' GROUP BY word")
def q_token_freq(spark, sf_dir):
    return vo.word_frequency(arabic_documents(spark, sf_dir), "t")


@query(f"WITH m AS (SELECT {_VOCABULARY} AS v), a AS (SELECT doc_id, {ARABIC} AS t FROM documents), c AS (SELECT doc_id, unnest({_TOKENS}) AS token FROM a) SELECT token, coalesce(m.v[token], 0) AS id, count(*) AS n FROM c, m GROUP BY ALL")
def q_token_histogram(spark, sf_dir):
    c = arabic_documents(spark, sf_dir).select(F.explode(ar.tokens(F.col("t"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    vocabulary = spark.createDataFrame([(t, i) for i, t in enumerate(A.vocabulary())], "token string, id int")
    return c.join(F.broadcast(vocabulary), "token", "left").select("token", F.coalesce("id", F.lit(0)).alias("id"), "n")


# voting and the lexicon

_STEMS = "['" + "','".join(A.PROTECTED_STEMS) + "']"
_CLITICS = "['" + "','".join(A.CLITICS) + "']"


def _duck_candidate(w: str) -> str:
    return (
        f"(length({w}) >= 3 AND {w}[-1] = 'ه' AND {w}[-2] <> 'ا' AND regexp_full_match({w}, '[{_L}]+') AND NOT contains({w}, 'الله') AND NOT ends_with({w}, 'لله')"
        f" AND NOT list_has_any(list_transform(list_filter({_CLITICS}, lambda p: starts_with({w}, p) AND length({w}) - length(p) >= 2), lambda p: substr({w}, length(p) + 1)) || [{w}], {_STEMS}))"
    )


#: DuckDB: words of each document with their stub marks (see operators.votes.stub_marks).
_WORDS = f"""a AS (SELECT doc_id, trim(regexp_replace(translate({ARABIC}, '{_MC}', ''), '\\s+', ' ', 'g')) AS t FROM documents),
pairs AS (SELECT doc_id, unnest(string_split(t, ' ')) AS word FROM a),
marked AS (SELECT doc_id, word, CASE WHEN length(word) < 2 THEN word ELSE word[:-2] || CASE (doc_id + length(word)) % 3 WHEN 0 THEN '{A.FATHA}' WHEN 1 THEN '{A.DAMMA}' ELSE '' END || word[-1] END AS diac FROM pairs WHERE word <> ''),
cast_votes AS (SELECT word, CASE WHEN (doc_id + length(word)) % 3 = 0 THEN 1 WHEN (doc_id + length(word)) % 3 = 1 THEN -1 ELSE 0 END AS v FROM marked WHERE {_duck_candidate('word')}),
tally AS (SELECT word, CAST(count(*) FILTER (v > 0) AS BIGINT) AS votes_ta, CAST(count(*) FILTER (v < 0) AS BIGINT) AS votes_ha, CAST(count(*) FILTER (v = 0) AS BIGINT) AS abstain FROM cast_votes GROUP BY word),
lexicon AS (SELECT word FROM tally WHERE votes_ta > 0 AND votes_ta / (votes_ta + votes_ha) >= 0.6),
freq AS (SELECT word, count(*) AS freq FROM pairs WHERE word <> '' GROUP BY word)"""


def plain_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arabic_documents(spark, sf_dir).select("doc_id", ar.bare_text(F.col("t")).alias("text"))


@query(f"WITH {_WORDS} SELECT DISTINCT word, {_duck_candidate('word')} AS candidate FROM pairs WHERE word <> ''")
def q_candidates(spark, sf_dir):
    words = plain_documents(spark, sf_dir).select(F.explode(F.split("text", " ")).alias("word")).where("word <> ''").distinct()
    return words.select("word", ar.is_candidate(F.col("word")).alias("candidate"))


@query(f"WITH {_WORDS} SELECT word, votes_ta, votes_ha, abstain FROM tally")
def q_votes(spark, sf_dir):
    docs = plain_documents(spark, sf_dir)
    return vo.tally(vo.stub_marks(docs))


@query(f"WITH {_WORDS} SELECT word FROM lexicon")
def q_lexicon(spark, sf_dir):
    return vo.lexicon(vo.tally(vo.stub_marks(plain_documents(spark, sf_dir))))


@query(f"WITH {_WORDS}, r AS (SELECT doc_id, CAST(count(*) AS BIGINT) AS n_words, CAST(count(*) FILTER (p.word IN (SELECT word FROM lexicon)) AS BIGINT) AS n_restored FROM pairs p WHERE word <> '' GROUP BY doc_id) SELECT * FROM r")
def q_restore(spark, sf_dir):
    docs = plain_documents(spark, sf_dir)
    restored = vo.restore(docs, vo.lexicon(vo.tally(vo.stub_marks(docs))))
    return restored.where("n_words > 0").select("doc_id", "n_words", "n_restored")


@query(f"WITH {_WORDS} SELECT t.word, coalesce(f.freq, 0) AS freq, votes_ta, votes_ha, abstain, l.word IS NOT NULL AS restored FROM tally t LEFT JOIN freq f USING (word) LEFT JOIN lexicon l ON l.word = t.word")
def q_lexicon_report(spark, sf_dir):
    docs = plain_documents(spark, sf_dir)
    return vo.report(vo.tally(vo.stub_marks(docs)), vo.word_frequency(docs, "text"))


@query(f"WITH {_WORDS} SELECT t.word, f.freq FROM lexicon t JOIN freq f USING (word) ORDER BY f.freq DESC, t.word LIMIT 60")
def q_top_restored(spark, sf_dir):
    return q_lexicon_report(spark, sf_dir).where("restored").orderBy(F.desc("freq"), "word").limit(60).select("word", "freq")


@query(f"WITH {_WORDS} SELECT t.word FROM tally t EXCEPT SELECT word FROM lexicon")
def q_not_restored(spark, sf_dir):
    tally = vo.tally(vo.stub_marks(plain_documents(spark, sf_dir)))
    return tally.select("word").join(vo.lexicon(tally), "word", "left_anti")


@query(f"WITH {_WORDS} SELECT (SELECT count(*) FROM lexicon) AS restored_types, (SELECT count(*) FROM tally) AS candidate_types, (SELECT CAST(coalesce(sum(freq), 0) AS BIGINT) FROM freq WHERE word IN (SELECT word FROM lexicon)) AS restored_tokens")
def q_lexicon_totals(spark, sf_dir):
    r = q_lexicon_report(spark, sf_dir)
    return r.agg(F.count_if("restored").alias("restored_types"), F.count(F.lit(1)).alias("candidate_types"), F.coalesce(F.sum(F.when(F.col("restored"), F.col("freq"))), F.lit(0)).alias("restored_tokens"))


# packing and chunks

_PACK = """list_reduce(list_prepend({'done': CAST([] AS VARCHAR[]), 'now': ''}, list_transform(list_filter(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' '), lambda w: w <> ''), lambda w: {'done': CAST([] AS VARCHAR[]), 'now': w})),
 lambda s, w: CASE WHEN length(s.now) > 0 AND length(s.now) + length(w.now) + 1 > 120 THEN {'done': list_append(s.done, s.now), 'now': w.now} WHEN length(s.now) > 0 THEN {'done': s.done, 'now': s.now || ' ' || w.now} ELSE {'done': s.done, 'now': w.now} END)"""


@query(f"WITH p AS (SELECT conv_id, turn, {_PACK} AS r FROM conversations) SELECT conv_id, turn, CAST(len(c) AS BIGINT) AS n_chunks, array_to_string(c, '|') AS chunks FROM (SELECT conv_id, turn, CASE WHEN length(r.now) > 0 THEN list_append(r.done, r.now) ELSE r.done END AS c FROM p)")
def q_pack_words(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", ar.pack_words(F.col("text")).alias("c"))
    return c.select("conv_id", "turn", F.size("c").cast("long").alias("n_chunks"), F.array_join("c", "|").alias("chunks"))


def chunked(spark: SparkSession, sf_dir: str, source: str, keys: list[str]) -> DataFrame:
    df = table(spark, sf_dir, source).select(*keys, ar.arabize(F.col("text")).alias("t"))
    return ar.normalize(df, "t", "normal").select(*keys, "normal", ar.sentence_chunks(F.col("normal")).alias("chunks"))


@query(None)
def q_sentence_chunks(spark, sf_dir):
    """Folds within folds: DuckDB has no twin; tests hold it against a plain loop."""
    c = chunked(spark, sf_dir, "conversations", ["conv_id", "turn"])
    return c.select("conv_id", "turn", F.size("chunks").cast("long").alias("n_chunks"), F.array_join("chunks", "|").alias("chunks"))


_RUNS = f"regexp_extract_all(t, '[{_L}{_MC}]+|[^{_L}{_MC}]+')"


@query(f"""WITH a AS (SELECT doc_id, {ARABIC} AS t FROM documents), r AS (SELECT doc_id, unnest({_RUNS}) AS x, generate_subscripts({_RUNS}, 1) AS k FROM a),
l AS (SELECT DISTINCT translate(x, '{_MC}', '') AS word FROM r WHERE contains(x, 'ه') AND len(translate(x, '{_MC}', '')) % 2 = 1),
d AS (SELECT doc_id, k, CASE WHEN contains(x, 'ه') AND l.word IS NOT NULL THEN regexp_replace(x, 'ه([^ه]*)$', 'ة\\1') ELSE x END AS x FROM r LEFT JOIN l ON l.word = translate(x, '{_MC}', ''))
SELECT a.doc_id, md5(coalesce(string_agg(x, '' ORDER BY k), '')) AS digest FROM a LEFT JOIN d USING (doc_id) GROUP BY a.doc_id""")
def q_restore_running(spark, sf_dir):
    """Marked running text by a lexicon of all its bare forms of odd length with ه."""
    docs = arabic_documents(spark, sf_dir)
    said = ar.words_with_ha(spread(table(spark, sf_dir, "documents").select(F.lower("text").alias("t"))), "t", "s", latin=True).distinct()
    bare = said.select(ar.strip_marks(F.col("s")).alias("word"))
    done = vo.restored_running(docs, "doc_id", "t", bare.where(F.length("word") % 2 == 1).distinct())
    return done.select("doc_id", F.md5("t").alias("digest"))


def _duck_letters(e: str) -> str:
    return f"length(regexp_replace({e}, '[^{_L}]', '', 'g'))"


def _duck_merged(parts: str) -> str:
    """DuckDB: neighbours of a list joined by a space while they have 160 letters at most together."""
    start = f"list_transform({parts}, lambda w: {{'done': CAST([] AS VARCHAR[]), 'now': w, 'n': {_duck_letters('w')}}})"
    step = "CASE WHEN s.n + w.n > 160 THEN {'done': list_append(s.done, s.now), 'now': w.now, 'n': w.n} ELSE {'done': s.done, 'now': s.now || ' ' || w.now, 'n': s.n + w.n} END"
    return f"list_reduce({start}, lambda s, w: {step})"


def _duck_split(e: str, after: str) -> str:
    """DuckDB: a text's parts that end after a sign and white space."""
    return f"list_filter(list_transform(string_split(regexp_replace({e}, '([{after}])\\s', '\\1' || chr(1), 'g'), chr(1)), lambda p: trim(p)), lambda p: p <> '')"


def _subscripts(e: str) -> str:
    return f"unnest({e}) AS x, generate_subscripts({e}, 1) AS k"


_CHUNKS = f"""{_NORMAL_CTE},
s AS (SELECT doc_id, x AS sentence, k AS si FROM (SELECT doc_id, {_subscripts(_duck_split('normal', '.'))} FROM n)),
p AS (SELECT doc_id, si, x AS part, k AS pi, long FROM (SELECT doc_id, si, long, {_subscripts("CASE WHEN long THEN " + _duck_split('sentence', ',') + " ELSE [sentence] END")} FROM (SELECT *, {_duck_letters('sentence')} > 160 AS long FROM s))),
w AS (SELECT doc_id, si, pi, CASE WHEN long AND {_duck_letters('part')} > 160 THEN {_duck_merged("list_filter(string_split(part, ' '), lambda w: w <> '')")} ELSE {{'done': CAST([] AS VARCHAR[]), 'now': part, 'n': 0}} END AS r FROM p),
q AS (SELECT doc_id, si, pi, {_subscripts('list_append(r.done, r.now)')} FROM w),
l AS (SELECT doc_id, list(x ORDER BY si, pi, k) AS pieces FROM q GROUP BY doc_id),
c AS (SELECT doc_id, list_append(r.done, r.now) AS chunks FROM (SELECT doc_id, {_duck_merged('pieces')} AS r FROM l))"""


@query(f"WITH {_CHUNKS} SELECT n.doc_id, CAST(coalesce(len(chunks), 0) AS BIGINT) AS n_chunks, coalesce(array_to_string(list_transform(chunks, lambda c: CASE WHEN ends_with(c, '.') THEN c ELSE regexp_replace(c, ',+$', '') || '.' END), '|'), '') AS chunks FROM n LEFT JOIN c USING (doc_id)")
def q_letter_chunks(spark, sf_dir):
    """Chunks of whole documents whose digits are letters, too; the twin folds lists of structs."""
    df = arabic_documents(spark, sf_dir, True)
    c = ar.normalize(df, "t", "normal").select("doc_id", ar.sentence_chunks(F.col("normal")).alias("chunks"))
    return c.select("doc_id", F.size("chunks").cast("long").alias("n_chunks"), F.array_join("chunks", "|").alias("chunks"))


@query("SELECT doc_id, CAST((row_number() OVER (ORDER BY doc_id) - 1) // 128 AS BIGINT) AS block FROM documents")
def q_blocks(spark, sf_dir):
    from noria.operators.ordering import running_number

    return running_number(table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"], "n").select("doc_id", F.expr("n div 128").alias("block"))


@query("SELECT conv_id, turn, coalesce(nullif(regexp_replace(text, '\\.\\s*$', ''), ''), text) AS text FROM conversations")
def q_final_stop(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", ar.drop_final_stop(F.col("text")).alias("text"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document text to normal text, dropped characters, sentence chunks and token ids."""
    docs = ar.normalize(arabic_documents(spark, sf_dir), "t", "normal", verbose="dropped")
    docs = docs.select("doc_id", "normal", F.array_sort(F.array_distinct("dropped")).alias("dropped"))
    docs = docs.select("*", ar.sentence_chunks(F.col("normal")).alias("chunks"))
    return docs.select("*", F.transform("chunks", ar.token_ids).alias("token_ids"))
