"""Text functions on literals; the expected values follow from the rules."""

import pytest
from pyspark.sql import functions as F

from noria.functions import alphabet as A
from noria.functions import arabic as ar
from noria.functions import numerals as nu


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


def many(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}").select("i", f(F.col("x")).alias("y")).collect()
    return [r["y"] for r in sorted(rows)]


def normalized(spark, values):
    rows = ar.normalize(spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string"), "x", "y").select("i", "y").collect()
    return [r["y"] for r in sorted(rows)]


def test_normalize(spark):
    cases = {
        "أنا إبن آدم": "انا ابن ادم",
        "َ مدينة": "مدينة",
        "بَُ": "بُ",
        "ق؞َابلت": "ق~َابلت",
        "ازيك؟ عامل ايه!": "ازيك. عامل ايه.",
        "اه، طبعا؛ ماشي: تمام": "اه, طبعا, ماشي, تمام",
        "«قال» (كده) - خلاص": "قال كده خلاص",
        "،، يلا..": "يلا.",
        "عندي ٣ كتب": "عندي تلاتة كتب",
        "مدينةْ": "مدينةْ",
        "": "",
        "   ": "",
        "ىّ ةّ ةّ~": "ى ة ة",
        "كتـاب​ه": "كتابه",
        "ـً": "",
        "½": "واحد اتنين",
    }
    got = normalized(spark, list(cases))
    assert dict(zip(cases, got, strict=True)) == cases
    again = normalized(spark, got)
    assert again == got
    assert normalized(spark, [None]) == [None]


def test_numbers(spark):
    cases = {0: "صفر", 12: "اتناشر", 25: "خمسة وعشرين", 200: "ميتين", 2000: "الفين", 10_000: "عشرة تلاف", 11_000: "حداشر الف", 1_000_000: "مليون", 2_000_001: "اتنين مليون وواحد", 1889: "الف وتمنمية وتسعة وتمانين", 1_000_000_000: "واحد" + " صفر" * 9, -3: "سالب تلاتة"}
    assert many(spark, list(cases), nu.number_words, "long") == list(cases.values())
    texts = {
        "سنه 1994 مثلا": "سنه الف وتسعمية واربعة وتسعين مثلا",
        "استهلكت 1.5% من": "استهلكت واحد فاصلة خمسة في المية من",
        "و000 مستوى": "و صفر مستوى",
        "الاجتماع الساعة 3:30": "الاجتماع الساعة تلاتة وتلاتين دقيقة",
        "نتقابل 5:00": "نتقابل الساعة خمسة",
        "1,000 و 12٫5": "الف و اتناشر فاصلة خمسة",
        "في 3/4/2020": "في تلاتة ابريل سنة الفين وعشرين",
        "2020-04-03": "تلاتة ابريل سنة الفين وعشرين",
        "$5 و 7 €": "خمسة دولار و سبعة يورو",
        "ثمن $ و3": "ثمن دولار و تلاتة",
        "لا رقم $": "لا رقم $",
        "0123456789": " ".join(A.ONES),
        "007": "سبعة",
        "25:70": "خمسة وعشرين:سبعين",
        "3/13/2020": "تلاتة/تلتاشر/الفين وعشرين",
        "1.2.3%": "واحد.اتنين فاصلة تلاتة في المية",
    }
    assert dict(zip(texts, many(spark, list(texts), nu.expand), strict=True)) == texts
    for n in (0, 7, 19, 20, 99, 100, 110, 999, 1000, 2002, 10_500, 999_999, 2_000_000, 123_456_789, 10**9):
        assert one(spark, n, nu.number_words, "long") == nu.spoken(n)
    assert many(spark, ["1.05", ".5", "12", "0123456789"], nu.decimal_words) == [nu.spoken_token(x) for x in ("1.05", ".5", "12", "0123456789")]


def test_dropped(spark):
    assert one(spark, "ا Py + = $ ^ < | ( ؟ ٓ", ar.dropped_characters) == ["P", "y", "+", "=", "$", "^"]


def test_diacritizer_output(spark):
    cases = {"ت^\u064e\u0651": "ت\u0651\u064e", "ب＜ُ": "بُ", "ق؞": "ق~", "َّبَ": "بَ"}
    assert many(spark, list(cases), ar.clean_diacritized) == list(cases.values())


def test_candidates_and_votes(spark):
    words = {"حاجه": True, "المدينه": True, "الله": False, "معاه": False, "وجه": False, "والوجه": False, "كتب": False, "ده": False, "لله": False, "بيكره": False, "python": False}
    assert many(spark, list(words), ar.is_candidate) == list(words.values())
    votes = {"حَاجَه": 1, "كِتَابُه": -1, "فِيه": 0, "مَرَّه": 1, "ه": 0, "بَ": 0, "": 0}
    assert many(spark, list(votes), ar.vote) == list(votes.values())


def test_lexicon(spark):
    lexicon = F.array(F.lit("المدينه"), F.lit("حاجه"))
    cases = {"رحت المدينه": "رحت المدينة", "المَدِينَهْ": "المَدِينَةْ", "كتابه": "كتابه"}
    assert many(spark, list(cases), lambda t: ar.restore_in_text(t, lexicon)) == list(cases.values())
    assert one(spark, "حاجه حاجهْ", lambda t: ar.restore_tokens(t, lexicon)) == "حاجة حاجهْ"


def test_tokens(spark):
    assert len(A.vocabulary()) == len(set(A.vocabulary())) == 53
    text = "مدينةَ حلوة, q."
    ids = one(spark, text, ar.token_ids)
    assert ids[5] == A.vocabulary().index("ةَ") - 0 or "ةَ" in A.vocabulary()
    assert ids.count(0) == 1
    plain = "مَدِينَةْ كبيرة."
    back = spark.createDataFrame([(plain,)], "x string").select(ar.detokenize(ar.token_ids(F.col("x"))).alias("y")).first()["y"]
    assert back == plain


def test_chunks(spark):
    assert one(spark, "اب جد ه", lambda t: ar.pack_words(t, 5)) == ["اب جد", "ه"]
    assert one(spark, "ابجدهوزح ا", lambda t: ar.pack_words(t, 5)) == ["ابجدهوزح", "ا"]
    assert one(spark, "", lambda t: ar.pack_words(t, 5)) == []
    assert one(spark, "ابج. دهو. زحط, يكل", lambda t: ar.sentence_chunks(t, 6)) == ["ابج. دهو.", "زحط, يكل."]
    assert one(spark, "ابجد هوزح طيكل.", lambda t: ar.sentence_chunks(t, 8)) == ["ابجد هوزح.", "طيكل."]
    assert one(spark, "ابجد, هوزح, طي.", lambda t: ar.sentence_chunks(t, 5)) == ["ابجد.", "هوزح.", "طي."]
    assert many(spark, ["ا.", ".", "ا"], ar.drop_final_stop) == ["ا", ".", "ا"]


@pytest.mark.parametrize("f", [ar.canonicalize, ar.tidy_punctuation, ar.strip_marks])
def test_idempotent(spark, f):
    texts = ["ًا~ّ بُّ , . ةّ", "ا , , ب", "اَُّ~ب", "abc"]
    once = many(spark, texts, f)
    assert many(spark, once, f) == once


@pytest.mark.parametrize("few, most", [(10**9, 10**9), (0, 10**9), (0, 0)])
def test_restored_running(spark, monkeypatch, few, most):
    from noria.operators import votes

    monkeypatch.setattr(votes, "FEW_WORDS", few)
    monkeypatch.setattr(votes, "BROADCAST_WORDS", most)
    texts = [(1, "مدرسه، مَدرَسَهُ ! وهنا مدرسه"), (1, "كلمه اخرى"), (2, "لا شيء هنا"), (3, None), (None, "مدرسه"), (4, ""), (5, "هه ههه كلمهم")]
    df = spark.createDataFrame(texts, "id int, t string").withColumn("word", F.lit("w"))
    lexicon = spark.createDataFrame([("مدرسه",), ("هه",), ("كلمه",), ("مدرسه",), (None,)], "word string")
    got = sorted(((r["id"], r["t"]) for r in votes.restored_running(df, "id", "t", lexicon).collect()), key=repr)
    want = [(1, "مدرسة، مَدرَسَةُ ! وهنا مدرسة"), (1, "كلمة اخرى"), (2, "لا شيء هنا"), (3, None), (None, "مدرسه"), (4, ""), (5, "هة ههه كلمهم")]
    assert got == sorted(want, key=repr)


def test_a_lexicon_of_many_words(spark):
    from noria.operators import votes

    many = spark.range(100_000).select(F.concat(F.translate(F.col("id").cast("string"), "0123456789", "ابتثجحخدرز"), F.lit("ه")).alias("word"))
    df = many.where("substring(word, 2, 1) <> 'ه'").groupBy((F.hash("word") % 20).alias("id")).agg(F.array_join(F.collect_list("word"), " ").alias("t"))
    done = votes.restored_running(df, "id", "t", many.where("length(word) <> 4")).cache()
    words = done.select(F.explode(F.split("t", " ")).alias("w"))
    assert words.where("length(w) <> 4 AND w NOT LIKE '%ة' OR length(w) = 4 AND w NOT LIKE '%ه'").count() == 0 and words.count() == 99_990
