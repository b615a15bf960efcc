"""Restoring a spelling by vote: per-word tallies, the lexicon they give, and its use."""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from noria.functions import alphabet as A
from noria.functions import arabic as ar
from noria.functions import batches
from noria.storage import stored


def word_frequency(docs: DataFrame, text: str) -> DataFrame:
    """word, freq over all texts."""
    words = docs.select(F.explode(F.split(ar.collapse(F.col(text)), " ")).alias("word"))
    return words.where("word <> ''").groupBy("word").agg(F.count(F.lit(1)).alias("freq"))


def _stub(i: str | int | None, t: str | None) -> str | None:
    def mark(word: str) -> str:
        n = -1 if i is None else int(i) + len(word)
        return "" if len(word) < 2 or n < 0 and n % 3 else (A.FATHA, A.DAMMA, "")[n % 3]

    return None if t is None else " ".join(w[:-1] + mark(w) + w[-1:] for w in t.split(" "))


@F.pandas_udf(StringType())
def _stubs(doc_id: pd.Series, text: pd.Series) -> pd.Series:
    return pd.Series([_stub(i, t) for i, t in zip(doc_id.tolist(), text.tolist())], dtype=object)


def stub_pairs(ids: list[int | None], texts: list[str | None]) -> Iterator[tuple[str | None, str | None]]:
    """Lower-case texts as bare Arabic, with their stub marks: a test stand-in for a model, for ``counted``."""
    for i, t in zip(ids, batches.sliced(batches.exchanged, texts, A.LATIN, A.AS_ARABIC)):
        bare = None if t is None else batches.bare(t)
        yield bare, _stub(i, bare)


def stub_marks(docs: DataFrame, plug: Column | None = None) -> DataFrame:
    """doc_id, text and diac: a test stand-in for a diacritizer, not one. plug: a real model's column."""
    return docs.withColumn("diac", _stubs(F.col("doc_id").cast("string"), F.col("text")) if plug is None else plug)


def valid_diacritics(docs: DataFrame) -> DataFrame:
    """diac is null where its bare words aren't the text's words."""
    return docs.withColumn("diac", F.when(F.split(ar.collapse(ar.strip_marks(F.col("diac"))), " ") == F.split(ar.collapse(F.col("text")), " "), F.col("diac")))


def tally(pairs: DataFrame) -> DataFrame:
    """word, votes_ta, votes_ha, abstain from (text, diac); texts whose word counts differ don't vote.

    Pairs of word and marked word are counted first; each distinct pair is tested and read once.
    """
    words = pairs.select(F.split("text", " ").alias("w"), F.split("diac", " ").alias("d")).where(F.size("w") == F.size("d"))
    words = words.select(F.inline(F.arrays_zip("w", "d"))).where(F.col("w").endswith(A.HA)).groupBy("w", "d").agg(F.count(F.lit(1)).alias("n"))
    return _tallied(words)


def counted(docs: DataFrame, pairs: Callable[[list, list], Iterable[tuple[str | None, str | None]]] = zip) -> DataFrame:
    """w, d and n: how often each word of a text has which marked form, null in texts whose word counts differ. For tallies and frequencies from one pass over texts.

    docs: two columns, of which ``pairs`` makes (text in single spaces, marked text) by lists; texts and marked texts as they are by default. Counted by
    pieces of batches, then over all.
    """
    first, text = docs.columns

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (x for b in parts for x in batches.pieces(b, text)):
            n: Counter = Counter()
            for t, d in pairs(part[first].to_pylist(), part[text].to_pylist()):
                words, marked = (x if x is None else x.split(" ") for x in (t, d))
                if words is not None:
                    n.update(zip(words, marked if marked and len(marked) == len(words) else itertools.repeat(None)))
            yield pa.RecordBatch.from_pydict({"w": pa.array([w for w, _ in n], pa.string()), "d": pa.array([d for _, d in n], pa.string()), "n": pa.array(list(n.values()), pa.int64())})
            n.clear()
        batches.give_back()

    return docs.mapInArrow(count, "w string, d string, n long").groupBy("w", "d").agg(F.sum("n").alias("n"))


def tally_of(counts: DataFrame) -> DataFrame:
    """As ``tally``, from what ``counted`` gives."""
    return _tallied(counts.where(F.col("w").endswith(A.HA) & F.col("d").isNotNull()))


def frequency_of(counts: DataFrame) -> DataFrame:
    """As ``word_frequency``, from what ``counted`` gives."""
    return counts.where("w <> ''").groupBy(F.col("w").alias("word")).agg(F.sum("n").alias("freq"))


def _tallied(words: DataFrame) -> DataFrame:
    voted = words.where(ar.is_candidate(F.col("w")) & (ar.strip_marks(F.col("d")) == F.col("w"))).select(F.col("w").alias("word"), "n", ar.vote(F.col("d")).alias("v"))
    each = {name: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0)).alias(name) for name, test in (("votes_ta", F.col("v") > 0), ("votes_ha", F.col("v") < 0), ("abstain", F.col("v") == 0))}
    return voted.groupBy("word").agg(*each.values())


def lexicon(tallied: DataFrame, min_ratio: float = 0.6) -> DataFrame:
    """Words restored by at least min_ratio of their votes; abstentions don't count."""
    return tallied.where((F.col("votes_ta") > 0) & (F.col("votes_ta") / (F.col("votes_ta") + F.col("votes_ha")) >= min_ratio)).select("word")


def restore(docs: DataFrame, words: DataFrame) -> DataFrame:
    """text rewritten by the lexicon, with n_words and n_restored. A join by word, so the lexicon may be large."""
    tokens = docs.select("doc_id", F.posexplode(F.split("text", " ")).alias("pos", "word"))
    hit = tokens.join(words.withColumn("_hit", F.lit(True)), "word", "left")
    new = F.when(F.col("_hit"), F.concat(F.expr("substr(word, 1, length(word) - 1)"), F.lit(A.TA_MARBUTA))).otherwise(F.col("word"))
    row = hit.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", new.alias("word")))).alias("ws"), F.count_if(F.col("word") != "").alias("n_words"), F.count_if(F.col("_hit")).alias("n_restored"))
    return row.select("doc_id", F.array_join("ws.word", " ").alias("text"), "n_words", "n_restored")


def report(tallied: DataFrame, freq: DataFrame, min_ratio: float = 0.6) -> DataFrame:
    """Each voted word with its frequency, votes and whether it is restored."""
    restored = (F.col("votes_ta") > 0) & (F.col("votes_ta") / F.greatest(F.col("votes_ta") + F.col("votes_ha"), F.lit(1)) >= min_ratio)
    return tallied.join(freq, "word", "left").select("word", F.coalesce("freq", F.lit(0)).alias("freq"), "votes_ta", "votes_ha", "abstain", restored.alias("restored"))


def ranked(reported: DataFrame, restored: bool, n: int = 60) -> DataFrame:
    """The n most frequent words of a report that are restored, or aren't."""
    return reported.where(F.col("restored") == restored).orderBy(F.desc("freq"), "word").limit(n).select("word", "freq")


def all_keys(*tables: DataFrame) -> DataFrame:
    """The distinct words of several tables."""
    out = tables[0].select("word")
    for t in tables[1:]:
        out = out.union(t.select("word"))
    return out.distinct()


def in_order(words: DataFrame) -> DataFrame:
    """Words by code point."""
    return words.orderBy("word")


#: Words of a lexicon that each word of a text may look through, and those that are broadcast to the tasks that look words up.
FEW_WORDS, BROADCAST_WORDS = 200, 1_000_000
#: Rows whose distinct words are looked up together. Neighbours share most of their words.
BATCH_ROWS = 1024


def restored_running(rows: DataFrame, key: str, text: str, lexicon: DataFrame) -> DataFrame:
    """Rows whose running ``text`` has ة for the last ه of each word that the lexicon (word) has in its bare form; marks and all else stay.

    A short lexicon goes into the expression. A longer one is joined: rows are stored in batches of BATCH_ROWS, the distinct words with ه of each batch are looked up, by hash, in
    a lexicon that is broadcast up to BROADCAST_WORDS words, by their count, and shuffled beyond; a word's new form doesn't depend on its text, so what comes back to
    a batch are the words that change. Rows with a null key or text stay as they are.
    """
    words = stored(lexicon.select("word").where("word IS NOT NULL").distinct(), "lexicon")
    n = words.count()
    if n <= FEW_WORDS:
        known = words.agg(F.collect_list("word").alias("_known"))  # one row of few words
        return rows.join(F.broadcast(known)).withColumn(text, F.when(F.col(key).isNull(), F.col(text)).otherwise(ar.restore_in_text(F.col(text), F.col("_known")))).drop("_known")
    batched = stored(rows.withColumn("_batch", F.expr(f"monotonically_increasing_id() div {BATCH_ROWS}")), "rows")
    asked = ar.words_with_ha(batched.where(F.col(key).isNotNull()), text, "_said", "_batch").distinct()
    words = words.withColumnRenamed("word", "_bare")
    found = asked.withColumn("_bare", ar.strip_marks(F.col("_said"))).join(F.broadcast(words) if n <= BROADCAST_WORDS else words, "_bare", "left_semi").select(F.col("_batch").alias("_in"), "_said")

    def changed(batch: pa.Table, said: pa.Table) -> pa.Table:
        changing = set(said["_said"].to_pylist())
        new = [t if t is None or not there else batches.restored(t, changing) for t, there in zip(batch[text].to_pylist(), batch[key].is_valid().to_pylist())]
        batches.give_back()
        out = batch.drop_columns("_batch")
        return out.set_column(out.schema.get_field_index(text), text, pa.array(new, batch[text].type))

    return batched.groupBy("_batch").cogroup(found.groupBy("_in")).applyInArrow(changed, rows.schema)
