"""Text expressions, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The cleaning steps in order, each a pattern and what replaces a match.
CLEANING = (
    (r"(?s)\$\$.*?\$\$", " "),
    (r"(?s)\\\[.*?\\\]", " "),
    (r"\$[^$]{0,200}\$", " "),
    (r"\\[a-zA-Z]+\{([^}]*)\}", "$1"),
    (r"\\[a-zA-Z]+", " "),
    (r"https?://\S+", " "),
    (r"(?i)\barXiv:\S+", " "),
    (r"\S+@\S+\.\S+", " "),
    (r"\{[^}]*\}", " "),
    (r"\[[^\]]*\]", " "),
    (r"\([^)]{0,6}\)", " "),
    (r"\b\d+(\.\d+)?\b", " "),
    (r"[^a-zA-Z0-9\s.,:;\-]", " "),
)
#: The same steps as they run, each with a mark that a text without a match may lack, so that most texts skip most steps. A word with an
#: address is met at its start only, a number at a digit; the last step takes white space with the odd characters, by ranges of what goes
#: (a negated class is some five times slower), and leaves single spaces alone.
FASTER = {
    r"\S+@\S+\.\S+": r"(?<!\S)\S+@\S+\.\S+", r"\b\d+(\.\d+)?\b": r"(?=\d)\b\d+(\.\d+)?\b",
    r"[^a-zA-Z0-9\s.,:;\-]": r"[\x00-\x1f!-+/<-@\[-`{-\x{10ffff}][\x00-+/<-@\[-`{-\x{10ffff}]*| [\x00-+/<-@\[-`{-\x{10ffff}]+",
}
MARKS = ("$$", "\\[", "$", "\\", "\\", "http", ":", "@", "{", "[", "(", "", "")
LATEX = r"\$|\\\w+|\\\["


# The default English stop words.
STOP_WORDS = (
    "a about above after again against all also am an and any are as at be because been before being below between both but by can cannot could did do does doing down during each "
    "few for from further had has have having he her here hers herself him himself his how i if in into is it its itself just me more most my myself no nor not now of off on once only "
    "or other ought our ours ourselves out over own same she should so some such than that the their theirs them themselves then there these they this those through to too under until "
    "up upon us very was we were what when where which while who whom why will with would you your yours yourself yourselves"
)


def stop_words() -> list[str]:
    """The default English stop words; every operator that drops stop words takes its own list."""
    return STOP_WORDS.split()


def replaced(text: Column, pattern: str, to: str, mark: str) -> Column:
    """``text`` with the matches of a pattern replaced; it is searched only if it holds the mark."""
    if not mark:
        return F.regexp_replace(text, pattern, to)
    return F.transform(F.array(text), lambda t: F.when(F.contains(t, F.lit(mark)), F.regexp_replace(t, pattern, to)).otherwise(t))[0]  # in an array of one, the text is made once and read twice


def clean_text(text: Column) -> Column:
    """Markup, links, numbers and odd characters replaced by single spaces; lower case; null gives ''."""
    out = F.coalesce(text, F.lit(""))
    for (pattern, to), mark in zip(CLEANING, MARKS, strict=True):
        out = replaced(out, FASTER.get(pattern, pattern), to, mark)
    return F.trim(F.lower(out))


def has_latex(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(LATEX)


def word_count(text: Column) -> Column:
    """Words between white space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\S+"))


def tokens(text: Column, stop: list[str]) -> Column:
    """Lower-case words of two or more letters, digits or _, without stop words, in order."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)\w\w+"), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(stop)) if stop else found


def ngrams(words: Column, most: int) -> Column:
    """The words and, up to ``most`` words long, their sequences joined by a space.

    ``words`` should be a column, not an expression: it is read once for each sequence.
    """

    def joined(n: int) -> Column:
        starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))

    return F.concat(words, *[joined(n) for n in range(2, most + 1)]) if most > 1 else words


def clean_keyword(term: Column, stop: list[str]) -> Column:
    """A term as a keyword: words of three or more characters joined by _; null if nothing or one stop word is left."""
    plain = F.regexp_replace(F.lower(F.coalesce(term, F.lit(""))), r"[^a-z0-9\s_-]+", " ")
    words = F.filter(F.split(F.trim(plain), r"\s+"), lambda w: F.length(w) >= 3)
    alone = (F.size(words) == 1) & F.element_at(words, 1).isin(stop) if stop else F.lit(False)
    return F.when((F.size(words) > 0) & ~F.coalesce(alone, F.lit(False)), F.array_join(words, "_"))


def safe_slug(text: Column, most: int = 50) -> Column:
    """A name for files: runs of other characters as _, none at the ends, at most ``most`` long."""
    return F.substring(F.regexp_replace(F.regexp_replace(text, r"[^a-zA-Z0-9_]+", "_"), r"^_+|_+$", ""), 1, most)


def truncated(text: Column, most: int) -> Column:
    """Text for display, cut at ``most`` characters with an ellipsis."""
    return F.when(F.length(text) > most, F.concat(F.rtrim(F.substring(text, 1, most)), F.lit("..."))).otherwise(text)


def occurrences(text: Column, term: Column) -> Column:
    """How often ``term`` stands in ``text``, without overlap."""
    return ((F.length(text) - F.length(F.replace(text, term, F.lit("")))) / F.length(term)).cast("long")
