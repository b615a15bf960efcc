"""Text rules over batches against the same rules one by one, and the plans of the queries that use them."""

import random
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from noria.functions import alphabet as A
from noria.functions import arabic as ar
from noria.functions import batches
from noria.functions import numerals as nu
from noria.operators import votes as vo
from noria.plans import catalogue

FOLDER = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")


def odd_texts(n=300):
    rnd = random.Random(3)
    signs = [*A.LETTERS, *A.MARKS * 3, *" .," * 12, *A.SENTENCE_END, *A.CLAUSE, *A.SILENT, *A.LETTER_FROM, *A.INVISIBLE, A.TATWEEL, A.EGYPTIAN_SIGN]
    signs += [*"0123456789:/%$", *A.ARABIC_DIGITS, *"aZéβ½²ﷺ\n\t\r\x1c\x85 　\x00̑ٔ\U00010a01\U0001f600\U000e0101१"]
    return [None, "", " ", ".", ",", "~", "َ"] + ["".join(rnd.choice(signs) for _ in range(rnd.choice((1, 3, 8, 40, 200)))) for _ in range(n)]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_normal_is_its_rules(spark, monkeypatch):
    """slices of any size, and pairs of texts in them, give what the rules give one after the other."""
    texts = odd_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    by_rule = df.withColumn("u", nu.expand(ar.unify(ar.composed(F.col("t")))))
    by_rule = by_rule.select("i", ar.clean_characters(F.col("u")).alias("n"), ar.dropped_characters(F.col("u")).alias("d"))
    by_rule = by_rule.withColumn("n", ar.tidy_punctuation(ar.canonicalize(F.col("n"))))
    by_rule = by_rule.withColumn("p", ar.collapse(F.regexp_replace(ar.strip_marks(F.col("n")), "[,.]", " ")))
    want = sorted(by_rule.collect())
    got = ar.normalize(df, "t", "n", verbose="d").select("i", "n", "d", ar.plain_text(F.col("n")).alias("p"))
    assert sorted(got.collect()) == want
    for size in (1, 50):
        monkeypatch.setattr(batches, "SLICE", size)
        assert batches.sliced(batches.normal, texts, "NFKC") == [r["n"] for r in want]


def test_chunks_count_letters_by_place(monkeypatch):
    """pieces of texts in one slice have the letters of their own places."""
    texts = ["ابج. دهو. زحط, يكل", None, "", "ابجد هوزح طيكل.", "اَبجد,, \nهوز  ح, طي,,\n", "  .  , "]
    want = [["ابج. دهو.", "زحط, يكل."], None, [], ["ابجد هوزح.", "طيكل."]]
    for size in (1, 20, 1 << 20):
        monkeypatch.setattr(batches, "SLICE", size)
        got = batches.sliced(batches.chunks, texts, 8)
        assert got[:4] == want
        assert all(c.endswith(".") and sum(x in A.LETTERS for x in c) <= 8 for c in got[4])


@tables
@pytest.mark.parametrize("name", ["q_letter_chunks", "q_plain_text", "q_normalize_numbers", "q_normalize"])
def test_one_pass(spark, name):
    """one pass over Python, no chains of regular expressions or folds of lambdas on the JVM."""
    found = plan(catalogue.QUERIES[name](spark, FOLDER))
    assert found.count("ArrowEvalPython") == 1 and not re.search("regexp|lambda|RLIKE", found)


@tables
def test_manifest_plan(spark):
    """letters and words are counted without regular expressions or lambdas."""
    found = plan(catalogue.QUERIES["q_manifest"](spark, FOLDER))
    assert not re.search("regexp|lambda|RLIKE", found)


def test_expanded_signs():
    """rules are tried on texts that have their signs only, with the results of all rules; Arabic digits count from the left."""
    assert nu.expanded("في 1,234 و3/4/2020 5:30 7% $5 1.2.3") == nu.expanded(nu.expanded("في 1,234 و3/4/2020 5:30 7% $5 1.2.3"))
    assert nu.expanded("ا1ب") == "ا واحد ب" and nu.expanded("1٣ا") == "واحد تلاتةا" and nu.expanded("\n 5\t") == "خمسة"
    assert len(nu._RULES[0]) == 3 and all(isinstance(signs, str) for signs, _, _ in nu._RULES)


def test_counted_once(spark):
    """tallies and frequencies from one count of word pairs, texts whose word counts differ included."""
    pairs = spark.createDataFrame([(0, "مدرسه كلمه مدرسه"), (4, "كلمه لا"), (-5, "مدرسه"), (None, "مدرسه كلمه"), (2, "")], "doc_id long, text string")
    marked = vo.stub_marks(pairs)
    odd = marked.union(spark.createDataFrame([(9, "مدرسه هنا", "مدرسَه"), (9, "مدرسه هنا", None)], "doc_id long, text string, diac string"))
    counts = vo.counted(odd.select("text", "diac"))
    assert sorted(vo.tally_of(counts).collect()) == sorted(vo.tally(odd).collect())
    assert sorted(vo.frequency_of(counts).collect()) == sorted(vo.word_frequency(odd, "text").collect())


def test_stub_marks(spark):
    """the stand-in's marks by number and length, with numbers below zero and without one."""
    rows = [(i, "ا اب ابج ابجد  هه") for i in (-7, -3, -1, 0, 1, 2, 9, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    length, n = "length(w)", "(doc_id + length(w)) % 3"
    mark = f"CASE WHEN {n} = 0 THEN '{A.FATHA}' WHEN {n} = 1 THEN '{A.DAMMA}' ELSE '' END"
    said = f"array_join(transform(split(text, ' '), w -> CASE WHEN {length} < 2 THEN w ELSE substr(w, 1, {length} - 1) || {mark} || substring(w, -1, 1) END), ' ')"
    assert vo.stub_marks(df).where(f"diac <=> {said}").count() == len(rows)


def test_restored_in_batches(spark, monkeypatch):
    """rows of any columns in batches of a few rows; words are looked up once for a batch, not row by row in a map."""
    monkeypatch.setattr(vo, "FEW_WORDS", 0)
    monkeypatch.setattr(vo, "BATCH_ROWS", 3)
    texts = [None, "", "مدرسه", "مَدرَسَه, كلمه~ ههه", "لا"] * 5
    df = spark.createDataFrame([(i if i % 7 else None, t, i, [i]) for i, t in enumerate(texts)], "id long, t string, n int, a array<int>")
    lexicon = spark.createDataFrame([("مدرسه",), ("ههه",)], "word string")
    done = vo.restored_running(df, "id", "t", lexicon)
    known = F.array(F.lit("مدرسه"), F.lit("ههه"))
    want = df.withColumn("t", F.when(F.col("id").isNull(), F.col("t")).otherwise(ar.restore_in_text(F.col("t"), known)))
    assert done.schema == df.schema and sorted(done.collect(), key=lambda r: r["n"]) == sorted(want.collect(), key=lambda r: r["n"])
    assert "map_from_entries" not in plan(done)


@tables
@pytest.mark.parametrize("name", ["q_all_keys", "q_restore_running"])
def test_texts_are_read_once(spark, name):
    """the result comes from tables that are stored once, and no map is looked through word by word."""
    found = plan(catalogue.QUERIES[name](spark, FOLDER))
    assert "documents.parquet" not in found and "map_from_entries" not in found
