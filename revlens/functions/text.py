"""Column-level text helpers (pure ``Column -> Column``, all JVM-side expressions).

They reproduce the Python/pandas string semantics the reviewed application relies on
(``str.strip``, ``str.split``, ``re`` Unicode classes, ``pd.to_numeric``) with native Spark
expressions, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -------------------------------------------------------------------
# Characters Python's str.isspace() accepts: ASCII controls \t \n \v \f \r, the
# separators \x1c-\x1f, space, \x85 and the Unicode separator category Z.
PY_WS_CLASS = "[\\t\\n\\x0b\\x0c\\r\\x1c-\\x1f \\x85\\p{Z}]"
# The characters themselves, by rule: every code point for which str.isspace() is true.
PY_WS_CHARS = "".join(c for c in map(chr, range(0x110000)) if c.isspace())
# Python's `^[\d\s\W]+$` = text made only of characters that are not letters, letter-like
# numbers, other numbers or underscore.
NON_WORDISH_ONLY = "^[^\\p{L}\\p{Nl}\\p{No}_]+$"
# Letter range used by the spam rule: a-z, A-Z and U+00C0..U+1EF9.
LETTER_CLASS_NEG = "[^a-zA-Z\\x{00C0}-\\x{1EF9}]"
# at least five such letters (possessive: one linear pass, stops at the fifth letter)
FIVE_LETTERS = "^(?:[^a-zA-Z\\x{00C0}-\\x{1EF9}]*+[a-zA-Z\\x{00C0}-\\x{1EF9}]){5}"
# pandas' default tokens that read_csv turns into a missing value.
PANDAS_NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
# Strings pd.to_numeric(errors="coerce") turns into a number (plus surrounding spaces).
NUMERIC_PATTERN = (
    "^\\s*[+-]?(([0-9]+(\\.[0-9]*)?|\\.[0-9]+)([eE][+-]?[0-9]+)?|(?i:inf|infinity|nan))\\s*$"
)
# ------------------------------------------------------------------------------------


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c) -> Column:
    """Python ``str.strip()``: trims every Unicode whitespace character at both ends.

    ``trim(BOTH chars FROM s)`` only touches the ends (a regex would scan the whole text)."""
    return F.trim(col_(c), F.lit(PY_WS_CHARS))


def py_word_count(c) -> Column:
    """``len(text.split())``: number of whitespace-separated words."""
    parts = F.split(py_strip(c), PY_WS_CLASS + "+")
    return F.when(py_strip(c) == "", F.lit(0)).otherwise(F.size(parts))


def py_words(c) -> Column:
    """``text.split()`` as an array (empty array for blank text)."""
    s = py_strip(c)
    return F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, PY_WS_CLASS + "+"))


def na_to_null(c, tokens=PANDAS_NA_TOKENS) -> Column:
    """Apply pandas' read_csv NA list: those exact cell values become NULL."""
    c = col_(c)
    return F.when(c.isin(*tokens), F.lit(None).cast("string")).otherwise(c)


def to_numeric(c) -> Column:
    """``pd.to_numeric(errors="coerce")`` for a string or numeric column -> DOUBLE or NULL.

    A numeric-pattern guard comes first, because ``try_cast('5d' AS DOUBLE)`` gives 5.0.
    NaN becomes NULL (pandas treats NaN as missing; Spark ``avg`` would propagate it).
    """
    c = col_(c)
    s = c.cast("string")
    v = F.when(s.rlike(NUMERIC_PATTERN), py_strip(s).try_cast("double"))
    return F.when(F.isnan(v), F.lit(None).cast("double")).otherwise(v)


def nan_to_null(c) -> Column:
    c = col_(c)
    return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c)


def letter_count(c) -> Column:
    """Number of characters in ``[a-zA-ZÀ-ỹ]``."""
    return F.length(F.regexp_replace(col_(c), LETTER_CLASS_NEG, ""))


def spam_symbols_only(c) -> Column:
    """Spam rule 1: only digits, whitespace and non-word characters."""
    return col_(c).rlike(NON_WORDISH_ONLY)


def spam_repeated_char(c) -> Column:
    """Spam rule 2: one character repeated at least five times and nothing else (fails
    at the second character for ordinary text).  The first character of a stripped text
    is never a line terminator, so Java's ``.`` agrees with Python's here."""
    return py_strip(c).rlike("^(.)\\1{4,}$")


def spam_few_letters(c, min_letters: int = 5) -> Column:
    """Spam rule 3: fewer than five letters in the Latin/Vietnamese range."""
    if min_letters == 5:
        return ~col_(c).rlike(FIVE_LETTERS)
    return letter_count(c) < min_letters


def is_spam(c) -> Column:
    return spam_symbols_only(c) | spam_repeated_char(c) | spam_few_letters(c)


def py_lower(c) -> Column:
    return F.lower(col_(c))


def spark_stop_words(language: str = "english") -> list[str]:
    """Spark ML's default stop-word list (``StopWordsRemover.loadDefaultStopWords``), read
    from the Spark ML jar so no JVM is needed (e.g. when building SQL text)."""
    import glob
    import os
    import zipfile

    import pyspark
    jars = glob.glob(os.path.join(os.path.dirname(pyspark.__file__), "jars", "spark-mllib_*.jar"))
    if jars:
        with zipfile.ZipFile(jars[0]) as z:
            raw = z.read(f"org/apache/spark/ml/feature/stopwords/{language}.txt").decode("utf-8")
        return [w for w in raw.split("\n") if w.strip()]
    from pyspark.ml.feature import StopWordsRemover
    return list(StopWordsRemover.loadDefaultStopWords(language))
