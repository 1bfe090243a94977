"""Text columns: normal forms, tokens, numbers and lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Latin letters with marks and the letters they stand for.
ACCENTED = "àáâãäåèéêëìíîïòóôõöùúûüñç"
PLAIN = "aaaaaaeeeeiiiiooooouuuunc"

# Words that tell no node from another.
STOPWORDS = (
    "il", "lo", "la", "i", "gli", "le", "un", "uno", "una", "di", "a", "da", "in", "con", "su",
    "per", "tra", "fra", "del", "dello", "della", "dei", "degli", "delle", "al", "allo", "alla",
    "ai", "agli", "alle", "dal", "dalla", "nel", "nella", "nei", "negli", "sul", "sulla", "e",
    "ed", "o", "od", "che", "non", "si", "se", "come", "anche", "quali", "quale", "cui", "ad",
    "rigo", "righi", "codice", "codici", "quadro", "sezione", "sezioni", "colonna", "colonne",
)

# A word that counts for the overlap of two texts; a number with its marks. Digits are ASCII digits.
CONTENT_WORD = "[a-zàèéìòù0-9]{3,}"
NUMBER = r"(\d[\d.,]*)"

# White space of any kind; line breaks of one character.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
LINE_BREAK = r"[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"


def stripped(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.btrim(c, F.lit(WHITE))


def lines(c: Column) -> Column:
    """Lines by every line break; none behind the last one."""
    # one class of characters instead of alternatives, and parts that are computed once
    parts = F.split(c, rf"{LINE_BREAK}(?:(?<=\r)\n)?")
    kept = F.transform(F.array(parts), lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, 1, F.size(p) - 1)).otherwise(p))[0]
    return F.when(c == "", F.array().cast("array<string>")).otherwise(kept)


def dehyphenated(c: Column) -> Column:
    """Words joined that a soft hyphen had split."""
    return F.regexp_replace(c, r"(?U)\xad\s*", "")


def plain(c: Column) -> Column:
    """Lower case without accents of Latin letters, in the JVM alone."""
    return F.translate(F.lower(c), ACCENTED, PLAIN)


def decomposed(c: Column) -> Column:
    """Lower case in compatibility decomposition without combining marks: all of Unicode, at the price of Python."""

    @F.pandas_udf("string")
    def run(s):
        import unicodedata

        def one(text):
            return None if text is None else "".join(x for x in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(x))

        return s.map(one)

    return run(c)


def folded(c: Column) -> Column:
    """decomposed(), with Python seeing only texts that hold more than ASCII and the letters that plain() knows."""
    low = plain(c)
    rare = F.regexp_like(low, F.lit(r"[^\x00-\x7f]"))
    return F.coalesce(decomposed(F.when(rare, c)), low)


def terms(c: Column, bigrams: bool = True, stopwords: tuple[str, ...] = STOPWORDS) -> Column:
    """Words of more than two letters or digits that are no stopwords, and pairs of neighbours among these."""
    words = F.filter(F.split(c, "[^a-z0-9]+"), lambda w: (F.length(w) > 2) & ~w.isin(*stopwords))
    if not bigrams:
        return words
    # the alias keeps the array from being computed again for each use
    return F.transform(F.array(words), lambda u: F.concat(u, _pairs(u)))[0]


def has_terms(c: Column, stopwords: tuple[str, ...] = STOPWORDS) -> Column:
    """Whether terms() finds any; no further than the first is read."""
    return F.regexp_like(c, F.lit(rf"(?<![a-z0-9])(?!(?:{'|'.join(stopwords)})(?![a-z0-9]))[a-z0-9]{{3}}"))


def _pairs(words: Column) -> Column:
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, 1, n), F.slice(words, 2, n), lambda a, b: F.concat_ws(" ", a, b))


def number(c: Column) -> Column:
    """A number as written, without trailing marks; a decimal comma becomes a point."""
    n = F.regexp_replace(c, "^[.,]+|[.,]+$", "")
    both = F.contains(n, F.lit(",")) & F.contains(n, F.lit("."))
    return F.replace(F.when(both, F.replace(n, F.lit("."), F.lit(""))).otherwise(n), F.lit(","), F.lit("."))


def numbers(c: Column) -> Column:
    """Distinct numbers of a text."""
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(NUMBER), 1), number))


def content_words(c: Column) -> Column:
    """Distinct words of three letters or more, in lower case."""
    each = F.transform(F.regexp_extract_all(c, F.lit(f"(?iu)({CONTENT_WORD})"), 1), F.lower)
    # The whole text in lower case first is cheaper and the same, but for the one capital that becomes two characters;
    # two small letters are in the class for their capitals alone.
    lower = F.regexp_extract_all(F.lower(c), F.lit(CONTENT_WORD.replace("[", "[\u017f\u0131")), F.lit(0))
    return F.array_distinct(F.when(F.contains(c, F.lit("\u0130")), each).otherwise(lower))
