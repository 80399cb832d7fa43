"""Names, identifiers, similarity and places as column functions."""

import difflib
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.semantics import col

# Legal forms left out of normalised names.
LEGAL_WORDS = ("inc", "incorporated", "corp", "corporation", "co", "company", "companies", "ltd", "limited", "llc", "lp", "plc", "ag", "se", "sa", "nv", "bv", "as", "ab", "publ", "oyj", "spa", "gmbh", "kgaa", "kk",
               "berhad", "bhd", "pcl", "public", "the", "holding", "holdings", "group", "cayman", "sarl", "srl", "sas", "pty")
# Letters that decomposition leaves alone, and what they are written as.
LETTERS = {"ø": "o", "Ø": "O", "æ": "ae", "Æ": "AE", "ß": "ss", "đ": "d", "Đ": "D", "ł": "l", "Ł": "L", "œ": "oe", "Œ": "OE", "þ": "th", "ı": "i"}


@F.pandas_udf(T.StringType())
def fold_ascii(s: pd.Series) -> pd.Series:
    """Accents off, other letters beyond ASCII gone."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode(), na_action="ignore")


def plain(c) -> Column:
    """Lower-case ASCII words: letters written out, accents and apostrophes dropped, other characters as blanks."""
    out = col(c)
    for a, b in LETTERS.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    out = F.regexp_replace(F.lower(fold_ascii(out)), "['’`]", "")
    return F.trim(F.regexp_replace(out, "[^a-z0-9]+", " "))


def _keep_words(c: Column, drop) -> Column:
    return F.array_join(F.filter(F.split(c, " +"), lambda w: (w != "") & ~w.isin(*drop)), " ")


def norm_name(c) -> Column:
    """A company name without accents, punctuation, brackets, legal forms and `and`."""
    s = F.regexp_replace(F.lower(fold_ascii(col(c))), "['’`]", "")
    s = F.regexp_replace(s, r"\b([a-z])/([a-z])\b", "$1$2")
    # initials with points are one word: points between single letters go
    s = F.regexp_replace(s, r"(?<=\b[a-z])\.(?=[a-z]\.)|(?<=\.[a-z])\.|(?<=\b[a-z])\.(?=[a-z]{1,2}\.)", "")
    s = F.regexp_replace(F.regexp_replace(s, r"\(.*?\)", " "), "[^a-z0-9]+", " ")
    return F.coalesce(_keep_words(s, (*LEGAL_WORDS, "and")), F.lit(""))


def search_term(c) -> Column:
    """A company name in its own spelling without legal forms."""
    words = F.filter(F.split(F.regexp_replace(col(c), r"\(.*?\)", " "), r"[\s,]+"), lambda w: (w != "") & ~F.regexp_replace(F.lower(w), "[^a-z]", "").isin(*LEGAL_WORDS))
    return F.trim(F.regexp_replace(F.array_join(words, " "), r"(?i)(\s+(and|&))+$", ""))


def _words(name: str | None) -> list[str]:
    if not name:
        return []
    s = unicodedata.normalize("NFKD", name).encode("ascii", "ignore").decode().lower().replace("&", " and ")
    words = [w for w in "".join(ch if ch.isalnum() else " " for ch in s).split() if w not in LEGAL_WORDS]
    out, initials = [], ""
    for w in words:
        initials, done = (initials + w, None) if len(w) == 1 else ("", initials + w)
        if done:
            out.append(done)
    return out + ([initials] if initials and (len(initials) > 1 or not out) else [])


@F.pandas_udf(T.DoubleType())
def name_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """The larger of character similarity and shared words over the shorter name's words; null without words."""
    out = []
    for x, y in zip(a, b, strict=True):
        p, q = _words(x), _words(y)
        both = set(p) & set(q)
        out.append(round(max(difflib.SequenceMatcher(None, " ".join(p), " ".join(q)).ratio(), len(both) / min(len(set(p)), len(set(q)))), 3) if p and q else None)
    return pd.Series(out, dtype="float64")


def _value(ch: Column) -> Column:
    """Digits by value, letters from 10, * @ # as 36 to 38."""
    return F.when(ch.rlike("[0-9]"), ch.try_cast("int")).when(ch.rlike("[A-Z]"), F.ascii(ch) - 55).when(ch == "*", 36).when(ch == "@", 37).when(ch == "#", 38)


def cusip_valid(c) -> Column:
    """Nine characters whose last is the check digit: every second value doubled, digits summed, modulo ten."""
    s = F.upper(col(c))
    v = F.transform(F.split(F.substring(s, 1, 8), ""), lambda ch, i: _value(ch) * F.when(i % 2 == 1, 2).otherwise(1))
    total = F.aggregate(v, F.lit(0), lambda acc, x: acc + F.floor(x / 10).cast("int") + x % 10)
    return F.coalesce(s.rlike(r"^[0-9A-Z*@#]{8}[0-9]$") & (F.pmod(10 - total % 10, F.lit(10)) == F.substring(s, 9, 1).try_cast("int")), F.lit(False))


def isin_valid(c) -> Column:
    """Two letters, nine characters and a check digit: letters as two digits, every second digit from the right doubled."""
    s = F.upper(col(c))
    digits = F.array_join(F.transform(F.split(s, ""), lambda ch: F.when(ch.rlike("[A-Z]"), (F.ascii(ch) - 55).cast("string")).otherwise(ch)), "")
    v = F.transform(F.split(F.reverse(digits), ""), lambda ch, i: ch.try_cast("int") * F.when(i % 2 == 1, 2).otherwise(1))
    total = F.aggregate(v, F.lit(0), lambda acc, x: acc + F.when(x > 9, x - 9).otherwise(x))
    return F.coalesce(s.rlike("^[A-Z]{2}[0-9A-Z]{10}$") & (total % 10 == 0), F.lit(False))


def cusip_from_isin(c) -> Column:
    return F.when(isin_valid(c) & col(c).startswith("US"), F.substring(col(c), 3, 9))


def place_variants(c, drop=()) -> Column:
    """Names to try for a city, the whole first, then its parts, then all of them without district words."""
    whole = plain(c)
    parts = F.transform(F.split(col(c), "[,/()]"), lambda p: F.trim(F.regexp_replace(F.lower(p), "[^a-z0-9]+", " ")))
    base = F.concat(F.array(whole), F.filter(parts, lambda p: p != ""))
    bare = F.transform(base, lambda v: _keep_words(v, drop)) if drop else base
    return F.array_distinct(F.filter(F.concat(base, bare), lambda v: v != ""))
