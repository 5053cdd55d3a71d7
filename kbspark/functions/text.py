"""Text expressions. All lengths are code points."""

import unicodedata
from functools import cache

from pyspark.sql import Column, functions as F

from kbspark import fixed_values as fv

# Everything up to U+0020 counts as trimmable.
CONTROL_CHARS = "".join(chr(code) for code in range(0x21))

# A character that is not whitespace (no-break spaces are not whitespace here).
_VISIBLE = r"[^\t-\r\x1C-\x20\u1680\u2000-\u2006\u2008-\u200A\u2028\u2029\u205F\u3000]"


def trimmed(text: Column) -> Column:
    """Both ends stripped of every character up to U+0020, not only of spaces."""
    return F.btrim(text, F.lit(CONTROL_CHARS))


def has_text(text: Column) -> Column:
    """True when there is at least one visible character; false for null."""
    return F.coalesce(text.rlike(_VISIBLE), F.lit(False))


def unix_newlines(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


@cache
def _accents() -> tuple[str, str]:
    """Letters with marks, the letters without them, and after the first ones the marks by themselves."""
    marked, plain = [], []
    for code in range(0x80, 0x2000):
        parts = unicodedata.normalize("NFD", chr(code))
        base = "".join(one for one in parts if not unicodedata.combining(one))
        if len(base) == 1 and base != chr(code):
            marked.append(chr(code))
            plain.append(base)
    marks = [chr(code) for code in range(0x300, 0x370) if unicodedata.combining(chr(code))]
    return "".join(marked + marks), "".join(plain)


def folded(text: Column) -> Column:
    """Text without case and accents, as far as a mark can be taken off a letter."""
    return F.translate(F.lower(text), *_accents())


def cut(text: Column, size: int) -> Column:
    """Null becomes empty; longer text is cut and marked with three dots."""
    return (F.when(text.isNull(), "")
            .when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("...")))
            .otherwise(text))


def preview(content: Column) -> Column:
    return cut(trimmed(F.translate(content, "\r\n", "  ")), fv.PREVIEW_LENGTH)


def context_text(content: Column) -> Column:
    return cut(content, fv.CONTEXT_LENGTH)


def session_title(question: Column) -> Column:
    title = trimmed(question)
    return (F.when(F.coalesce(F.length(title), F.lit(0)) == 0, fv.UNTITLED)
            .otherwise(F.substring(title, 1, fv.TITLE_LENGTH)))


def default_if_blank(text: Column, default: Column) -> Column:
    return F.when(F.coalesce(F.length(trimmed(text)), F.lit(0)) == 0, default).otherwise(text)


def error_text(message: Column) -> Column:
    return F.substring(default_if_blank(message, F.lit(fv.UNKNOWN_ERROR)), 1, fv.ERROR_LENGTH)


def query_terms(query: Column) -> Column:
    """Terms in order, duplicates kept; the whole query when no term is left."""
    whole = trimmed(query)
    terms = F.filter(
        F.transform(F.split(whole, fv.TERM_SEPARATORS), trimmed),
        lambda term: F.length(term).between(1, fv.TERM_MAX_LENGTH))
    empty = F.array().cast("array<string>")
    return (F.when(F.coalesce(F.length(whole), F.lit(0)) == 0, empty)
            .when(F.size(terms) == 0, F.array(whole))
            .otherwise(terms))


def occurrences(text: Column, term: Column) -> Column:
    """How often ``term`` occurs in ``text`` without overlaps."""
    removed = F.length(text) - F.length(F.replace(text, term, F.lit("")))
    return (removed / F.length(term)).cast("int")


def is_symbol_like(term: Column) -> Column:
    """Class, method, path or file names rather than plain words."""
    found = term.rlike(r"\A.*[A-Z].*[a-z].*\z")
    for mark in fv.SYMBOL_CHARACTERS:
        found = found | F.contains(term, F.lit(mark))
    for suffix in fv.SYMBOL_SUFFIXES:
        found = found | F.endswith(term, F.lit(suffix))
    return found
