"""Arabic text functions as Column expressions.

Single rules are built-in functions, so plans stay on the JVM side; regular expressions are preferred to
higher-order functions where both say the same. Unicode composition, and chains of rules over whole texts,
are Arrow-batched functions (``batches``).
"""

from __future__ import annotations

import itertools
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from . import alphabet as A
from . import batches

_M = A.MARKS
_SPACES = "(?U)[\\s\\x1c-\\x1f]"


def quoted(chars: str) -> str:
    """chars for a regular expression's class, as ranges of code points: Java tests a class of single letters one by one."""
    codes, out = sorted(set(map(ord, chars))), []
    for c in codes:
        if out and c == out[-1][1] + 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(f"\\x{{{a:x}}}" if a == b else f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in out)


#: For classes of regular expressions.
_L, _MS, _V, _D = (quoted(x) for x in (A.LETTERS, A.MARKS, A.VOWELS, A.DIACRITICS))


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with value evaluated once. Chains of rules that name their input several times stay linear."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _exchanged(old: str, new: str) -> Callable[[Column], Column]:
    @F.pandas_udf(StringType())
    def exchanged(text: pd.Series) -> pd.Series:
        return pd.Series(batches.sliced(batches.exchanged, text.tolist(), old, new), dtype=object)

    return exchanged


def arabize(text: Column, digits: bool = False) -> Column:
    """Latin letters as Arabic letters and marks by a fixed table; the rest as it is. digits: those as letters, too."""
    return _exchanged(A.LATIN + "0123456789" * digits, A.AS_ARABIC + A.LETTERS[3:13] * digits)(F.lower(text))


def _composer(form: str) -> Callable[[Column], Column]:
    @F.pandas_udf(StringType())
    def composed(text: pd.Series) -> pd.Series:
        return text.map(lambda t: unicodedata.normalize(form, t), na_action="ignore")

    return composed


def composed(text: Column, form: str = "NFKC") -> Column:
    """Unicode normal form. Spark has no built-in for it, so an Arrow-batched UDF does it, for the texts that can change only.

    ASCII, the letters and single marks are in normal form; two marks in a row may be put in order.
    """
    may_change = text.rlike(f"[^\\x00-\\x7F{_L}{_D}]|[{_D}]{{2}}")
    return F.when(may_change, _composer(form)(F.when(may_change, text))).otherwise(text)


def unify(text: Column) -> Column:
    """Digits to ASCII, letters to the 33 of the alphabet, invisible signs and tatweel away, U+061E to ~."""
    source = A.ARABIC_DIGITS + A.PERSIAN_DIGITS + A.LETTER_FROM + A.EGYPTIAN_SIGN + A.INVISIBLE + A.TATWEEL
    return F.translate(text, source, "0123456789" * 2 + A.LETTER_TO + A.MARKER)


def clusters(text: Column) -> Column:
    """Characters with the marks that follow each."""
    return F.regexp_extract_all(text, F.lit(f"(?s).[{_MS}]*"), F.lit(0))


def canonical_marks(cluster: Column) -> Column:
    """The marks of a cluster (a letter and its marks): [~][shadda][last vowel], as far as the letter takes them."""
    letter, marks = F.substring(cluster, 1, 1), F.substr(cluster, F.lit(2))
    marker = F.when(marks.contains(A.MARKER) & (letter != A.TA_MARBUTA), A.MARKER).otherwise("")
    shadda = F.when(marks.contains(A.SHADDA) & ~letter.isin(*A.NO_SHADDA), A.SHADDA).otherwise("")
    return F.concat(marker, shadda, F.regexp_extract(marks, f"([{_V}])[^{_V}]*$", 1))


def canonicalize(text: Column) -> Column:
    """Marks in canonical order on letters; marks after anything else go. Texts without marks skip the work."""
    return let(text, _canonicalized)


def _canonicalized(text: Column) -> Column:
    parts = F.regexp_extract_all(text, F.lit(f"(?s)[{_L}][{_MS}]+|[{_L}]+(?![{_MS}])|[^{_L}]+"), F.lit(0))
    fixed = F.transform(parts, lambda s: F.when(s.rlike(f"^[{_L}][{_MS}]"), F.concat(F.substring(s, 1, 1), canonical_marks(s))).when(s.rlike(f"^[{_L}]"), s).otherwise(F.translate(s, _M, "")))
    return F.when(text.rlike(f"[{_MS}]"), F.array_join(fixed, "")).otherwise(text)


def strip_marks(text: Column) -> Column:
    return F.translate(text, _M, "")


@F.pandas_udf(StringType())
def bare_text(text: pd.Series) -> pd.Series:
    """Without marks, in single spaces."""
    return text.map(batches.bare, na_action="ignore")


def has_marks(text: Column) -> Column:
    return text.rlike(f"[{_D}]")


def clean_characters(text: Column) -> Column:
    """Letters and marks stay; white space, sentence ends and clause marks become ' ', ' . ' and ' , '; other marks go; the rest is a space."""
    text = F.regexp_replace(text, f"[{quoted(A.SENTENCE_END)}]", " . ")
    text = F.regexp_replace(text, f"[{quoted(A.CLAUSE)}]", " , ")
    text = F.regexp_replace(text, f"[\\p{{Mn}}&&[^{_L}{_MS}]]", "")
    return F.regexp_replace(text, f"[^{_L}{_MS} .,]", " ")


def dropped_characters(text: Column) -> Column:
    """What cleaning replaces though it is no space, known sign or punctuation; in order, with repeats."""
    return F.regexp_extract_all(text, F.lit(f"(?U)[^{_L}{_MS}\\s\\x1c-\\x1f{quoted(A.SENTENCE_END + A.CLAUSE + A.SILENT)}\\p{{Mn}}\\p{{P}}]"), F.lit(0))


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, _SPACES + "+", " "))


def tidy_punctuation(text: Column) -> Column:
    """No leading mark, no space before a mark; of marks in a row one stays, a stop before a comma."""
    text = F.regexp_replace(collapse(text), "(?:, )*\\.(?: [.,])*", ".")
    text = F.regexp_replace(text, ",(?: ,)+", ",")
    return F.regexp_replace(F.regexp_replace(text, "^[.,] ?", ""), " ([.,])", "$1")


def word_runs(text: Column) -> Column:
    """A text's runs of letters and marks, and what stands between them, in order: joined, they are the text."""
    return F.regexp_extract_all(text, F.lit(f"[{_L}{_MS}]+|[^{_L}{_MS}]+"), F.lit(0))


def words_with_ha(rows: DataFrame, text: str, into: str, key: str | None = None, latin: bool = False) -> DataFrame:
    """The runs of letters and marks that have ه in running texts, by ``key`` if one is named; each at least once, repeats within a piece of a batch go. latin: lower-case texts are read as ``arabize`` makes them."""

    def said(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (x for b in parts for x in batches.pieces(b, text)):
            texts = part[text].to_pylist()
            texts = batches.sliced(batches.exchanged, texts, A.LATIN, A.AS_ARABIC) if latin else texts
            found: dict = {}
            for k, t in zip(part[key].to_pylist() if key else itertools.repeat(None), texts):
                if t is not None:
                    found.setdefault(k, set()).update(batches.words_with_ha(t))
            words = pa.array([w for ws in found.values() for w in ws], pa.string())
            keys = {key: pa.array([k for k, ws in found.items() for _ in ws], part[key].type)} if key else {}
            found.clear()
            yield pa.RecordBatch.from_pydict({**keys, into: words})
            batches.give_back()

    kept = [rows.schema[key]] if key else []
    return rows.select(*[f.name for f in kept], text).mapInArrow(said, StructType([*kept, StructField(into, StringType())]))


def with_ta_marbuta(word: Column) -> Column:
    """A word whose last ه is ة; what follows it stays."""
    return F.regexp_replace(word, f"{A.HA}([^{A.HA}]*)$", A.TA_MARBUTA + "$1")


def restore_in_text(text: Column, lexicon: Column) -> Column:
    """The last ه of words whose bare form is in the lexicon (array of strings) becomes ة; marks stay. Each word looks through the lexicon: for short ones."""
    parts = word_runs(text)

    def fixed(known: Column) -> Column:
        return F.transform(parts, lambda s: F.when(s.contains(A.HA) & F.array_contains(known, strip_marks(s)), with_ta_marbuta(s)).otherwise(s))

    return F.array_join(let(lexicon, fixed), "")


def clean_diacritized(text: Column, form: str | None = "NFC") -> Column:
    """A diacritizer's output as training text: its symbols go, U+061E becomes ~, marks in order."""
    text = text if form is None else composed(text, form)
    return canonicalize(F.translate(text, A.EGYPTIAN_SIGN + A.DIACRITIZER_SYMBOLS, A.MARKER))


def clitic_stems(word: Column) -> Column:
    """The word, and the word without each prefix that leaves two letters or more."""
    prefixes = F.array(*[F.lit(c) for c in A.CLITICS])
    cut = F.filter(prefixes, lambda p: word.startswith(p) & (F.length(word) - F.length(p) >= 2))
    return F.concat(F.array(word), F.transform(cut, lambda p: F.substr(word, F.length(p) + 1)))


def is_candidate(word: Column) -> Column:
    """Whether the final ه of a plain word could be ة."""
    shape = (F.length(word) >= 3) & word.endswith(A.HA) & ~word.endswith(A.ALEF + A.HA) & word.rlike(f"^[{_L}]+$")
    stems = F.array(*[F.lit(s) for s in A.PROTECTED_STEMS])
    return shape & ~word.contains("الله") & ~word.endswith("لله") & ~F.arrays_overlap(clitic_stems(word), stems)


def vote(word: Column) -> Column:
    """+1 for a fatha, -1 for a damma on the letter before a final ه, else 0."""

    def by_vowel(found: Column) -> Column:
        vowel = F.substring(canonical_marks(F.element_at(found, -2)), -1, 1)
        ready = F.substring(F.element_at(found, -1), 1, 1) == A.HA
        return F.when(F.size(found) < 2, 0).when(~ready, 0).otherwise(let(vowel, lambda v: F.when(v == A.FATHA, 1).when(v == A.DAMMA, -1).otherwise(0)))

    return let(F.filter(clusters(word), lambda c: F.substring(c, 1, 1).rlike(f"[{_L}]")), by_vowel)


def restore_tokens(text: Column, lexicon: Column) -> Column:
    """Tokens in the lexicon get ة for their last letter; exact, by spaces."""
    return F.array_join(F.transform(F.split(text, " "), lambda w: F.when(F.array_contains(lexicon, w), F.concat(F.substr(w, F.lit(1), F.length(w) - 1), F.lit(A.TA_MARBUTA))).otherwise(w)), " ")


def tokens(text: Column) -> Column:
    """ة with its vowel is one token, else each character."""
    return F.regexp_extract_all(text, F.lit(f"{A.TA_MARBUTA}[{_V}]|[\\s\\S]"), F.lit(0))


def token_ids(text: Column) -> Column:
    """Ids of tokens; 0 for what the vocabulary lacks."""
    table = F.create_map(*[x for i, t in enumerate(A.vocabulary()) for x in (F.lit(t), F.lit(i))])
    return F.transform(tokens(text), lambda t: F.coalesce(F.try_element_at(table, t), F.lit(0)))


def detokenize(ids: Column) -> Column:
    table = F.array(*[F.lit(t) for t in A.vocabulary()])
    return F.array_join(F.transform(ids, lambda i: F.element_at(table, i + 1)), "")


@F.pandas_udf(IntegerType())
def letter_count(text: pd.Series) -> pd.Series:
    return pd.Series(batches.sliced(batches.letters, text.tolist()), dtype="Int32")


def pack_words(text: Column, most: int = 120) -> Column:
    """Words packed into chunks of at most ``most`` characters; a longer word stands alone."""
    state = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def step(s: Column, w: Column) -> Column:
        over = (F.length(s["now"]) > 0) & (F.length(s["now"]) + F.length(w) + 1 > most)
        joined = F.when(F.length(s["now"]) > 0, F.concat(s["now"], F.lit(" "), w)).otherwise(w)
        return F.struct(F.when(over, F.concat(s["done"], F.array(s["now"]))).otherwise(s["done"]).alias("done"), F.when(over, w).otherwise(joined).alias("now"))

    words = F.filter(F.split(collapse(text), " "), lambda w: w != "")
    return F.aggregate(words, state, step, lambda s: F.when(F.length(s["now"]) > 0, F.concat(s["done"], F.array(s["now"]))).otherwise(s["done"]))


def sentence_chunks(text: Column, most: int = 160) -> Column:
    """Sentences, split after commas and then between words where they have more than ``most`` letters, merged again up to it; each ends in a stop."""

    @F.pandas_udf(ArrayType(StringType()))
    def chunked(text: pd.Series) -> pd.Series:
        return pd.Series(batches.sliced(batches.chunks, text.tolist(), most), dtype=object)

    return chunked(text)


def drop_final_stop(text: Column) -> Column:
    """Without the stop at the end, unless nothing else is there."""
    return let(text, lambda t: F.coalesce(F.nullif(F.regexp_replace(t, "\\.\\s*$", ""), F.lit("")), t))


def _normalizer(form: str | None, verbose: bool) -> Callable[[Column], Column]:
    @F.pandas_udf(StringType())
    def normal(text: pd.Series) -> pd.Series:
        return pd.Series(batches.sliced(batches.normal, text.tolist(), form), dtype=object)

    @F.pandas_udf("normal string, dropped array<string>")
    def normal_and_dropped(text: pd.Series) -> pd.DataFrame:
        rows = batches.sliced(batches.normal, text.tolist(), form, True)
        return pd.DataFrame({"normal": pd.Series([r and r[0] for r in rows], dtype=object), "dropped": pd.Series([r and r[1] for r in rows], dtype=object)})

    return normal_and_dropped if verbose else normal


def normalize(df: DataFrame, column: str, into: str, lexicon: Column | None = None, form: str | None = "NFKC", verbose: str | None = None) -> DataFrame:
    """The whole front end over ``column``: composition, letters, numbers, cleaning, marks, punctuation, lexicon.

    One Arrow-batched function; the parts above say the same rule by rule. verbose: also a column of the characters that cleaning drops.
    """
    normal = _normalizer(form, verbose is not None)(F.col(column))
    df = df.withColumns({into: normal["normal"], verbose: normal["dropped"]}) if verbose else df.withColumn(into, normal)
    return df if lexicon is None else df.withColumn(into, restore_in_text(F.col(into), lexicon))


@F.pandas_udf(StringType())
def plain_text(normalized: pd.Series) -> pd.Series:
    """Without marks and punctuation."""
    return normalized.map(batches.plain, na_action="ignore")
