"""Text rules as Java regular expressions with Unicode-aware character classes."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 29 code points that count as white space.
SPACES = r"\s\x0b\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

URL = f"http[^{SPACES}]+"
SPACE_RUN = f"[{SPACES}]+"
OUTER_SPACE = rf"\A[{SPACES}]+|[{SPACES}]+\z"

# Fixed value: a term is a run of two or more letters, digits or underscores.
TERM = r"[\p{L}\p{N}_]{2,}"


def clean_text(text: Column) -> Column:
    """Links to a space, then every run of white space to one space, then trim."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, URL, " "), SPACE_RUN, " "))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, OUTER_SPACE, "")


def flatten_text(text: Column) -> Column:
    """Strip, then put a space for each newline; other white space stays."""
    return F.replace(strip(text), F.lit("\n"), F.lit(" "))


def terms(text: Column) -> Column:
    """All terms of the lower-cased text, in order, with repeats."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({TERM})"))


def has_terms(text: Column) -> Column:
    return F.lower(text).rlike(TERM)


def bare_words(text: Column) -> Column:
    """The lower-cased text with one space for all that is no part of a word."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]+", " "))
