"""Letters, marks and word lists of Egyptian Arabic text for speech.

The values below are fixed: results depend on each of them.
"""

# Letters and marks.
LETTERS = "ءؤئابةتثجحخدذرزسشصضطظعغفقكلمنهوىي"
VOWELS = "ًٌٍَُِْ"  # fatha damma kasra fathatan dammatan kasratan sukun
FATHA, DAMMA, SHADDA = "َ", "ُ", "ّ"
DIACRITICS = VOWELS + SHADDA
MARKER = "~"
MARKS = DIACRITICS + MARKER
ALEF, HA, TA_MARBUTA, TATWEEL, EGYPTIAN_SIGN = "ا", "ه", "ة", "ـ", "؞"
NO_SHADDA = "اىةء"
SENTENCE_END = ".!?؟…۔"
CLAUSE = ",،;؛:–—"
SILENT = "\"'()[]{}<>«»“”‘’-_/\\|*#"
# Letters rewritten to one of LETTERS.
LETTER_FROM = "أإآٱٰٲٳڤپچگکیےہەۀ"
LETTER_TO = "ااااااافبججكييههه"
INVISIBLE = "​‌‍‎‏‪‫‬‭‮⁦⁧⁨⁩﻿­"
ARABIC_DIGITS, PERSIAN_DIGITS = "٠١٢٣٤٥٦٧٨٩", "۰۱۲۳۴۵۶۷۸۹"
# Symbols a diacritizer adds, with full-width forms.
DIACRITIZER_SYMBOLS = "^<>＾＜＞"
# Number words.
ONES = ("صفر", "واحد", "اتنين", "تلاتة", "اربعة", "خمسة", "ستة", "سبعة", "تمانية", "تسعة")
TEENS = ("عشرة", "حداشر", "اتناشر", "تلتاشر", "اربعتاشر", "خمستاشر", "ستاشر", "سبعتاشر", "تمنتاشر", "تسعتاشر")
TENS = ("عشرين", "تلاتين", "اربعين", "خمسين", "ستين", "سبعين", "تمانين", "تسعين")
HUNDREDS = ("مية", "ميتين", "تلتمية", "اربعمية", "خمسمية", "ستمية", "سبعمية", "تمنمية", "تسعمية")
MONTHS = ("يناير", "فبراير", "مارس", "ابريل", "مايو", "يونيو", "يوليو", "اغسطس", "سبتمبر", "اكتوبر", "نوفمبر", "ديسمبر")
CURRENCIES = {"$": "دولار", "€": "يورو", "£": "جنيه استرليني"}
# Stems whose final ه is a root letter, and prefixes before a stem.
PROTECTED_STEMS = ("اله", "لاه", "شبه", "وجه", "اتجه", "يتجه", "بيتجه", "هيتجه", "تتجه", "بتتجه", "متجه", "واجه", "يواجه", "بيواجه", "هيواجه", "تواجه", "بتواجه", "نواجه", "بنواجه", "توجه", "يتوجه", "بيتوجه", "اتوجه", "انتبه", "ينتبه", "نبه", "ينبه", "منبه", "كره", "يكره", "بيكره", "اشتبه", "يشتبه", "مشتبه", "تشابه", "متشابه", "مشابه", "شابه", "فقه", "تافه", "نزيه", "وجيه", "سفيه", "كريه", "مكروه", "مشبوه", "مشوه")
CLITICS = ("وبال", "وكال", "وال", "فال", "بال", "كال", "ولل", "فلل", "لل", "ال", "و", "ف", "ب", "ك", "ل")
UNKNOWN = "[UNK]"


def vocabulary() -> list[str]:
    """Token strings; a token's id is its place."""
    return [UNKNOWN, " ", ",", ".", MARKER, *LETTERS, *VOWELS, SHADDA, *(TA_MARBUTA + v for v in VOWELS)]


def below_thousand() -> list[str]:
    """The words of 0 to 999."""

    def words(n: int) -> str:
        if n < 20:
            return (ONES + TEENS)[n]
        if n < 100:
            return TENS[n // 10 - 2] if n % 10 == 0 else f"{ONES[n % 10]} و{TENS[n // 10 - 2]}"
        return HUNDREDS[n // 100 - 1] if n % 100 == 0 else f"{HUNDREDS[n // 100 - 1]} و{words(n % 100)}"

    return [words(n) for n in range(1000)]


# A fixed way to run Arabic text functions on Latin text: test data has no Arabic.
LATIN = "abcdefghijklmnopqrstuvwxyzäöüéèêñíçóß"
AS_ARABIC = "ابكدهفجحيشقلمنوصطرستعضغثزخ" + "َُِّْ~ًٌٍُة"
