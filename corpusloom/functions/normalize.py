"""Text normalisers that define equality, as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What folds before a comparison.
NBSP, SOFT_HYPHEN = "\u00a0", "\u00ad"
ZERO_WIDTH = "[\u200b\u200c\u200d\u2060\ufeff\u00ad]"


def norm_space(s: Column) -> Column:
    """Null as '', every run of white space (no-break spaces too) as one space, trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(s.cast("string"), F.lit("")), r"(?U)\s+", " "))


def fold_yo(s: Column) -> Column:
    return F.translate(s, "Ёё", "Ее")


def norm_key(s: Column) -> Column:
    return F.lower(fold_yo(norm_space(s)))


def norm_cell(s: Column) -> Column:
    """Cell strings: CRLF and CR as LF, trimmed of white space; null stays null."""
    return F.regexp_replace(F.regexp_replace(s, "\r\n?", "\n"), r"(?U)^\s+|\s+$", "")


def canon_key(s: Column) -> Column:
    return F.lower(fold_yo(F.regexp_replace(s, f"[ {NBSP}]", "")))


def table_text(s: Column) -> Column:
    """A table cell: no-break spaces and tabs as spaces, no zero-width marks, a leading <*> dropped, lines squeezed,
    empty lines and equal neighbours dropped."""
    flat = F.regexp_replace(F.translate(F.coalesce(s, F.lit("")), f"{NBSP}\t", "  "), ZERO_WIDTH, "")
    lines = F.filter(F.transform(F.split(F.regexp_replace(flat, r"^\s*<\*>\s*", ""), "\r\n|\r|\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
    kept = F.filter(lines, lambda x, i: (i == 0) | (x != F.get(lines, i - 1)))
    return F.array_join(kept, "\n")


def table_key(s: Column) -> Column:
    """table_text for comparison: case folded (sharp s too), one line."""
    return F.replace(F.lower(fold_yo(F.regexp_replace(table_text(s), r"\s+", " "))), F.lit("ß"), F.lit("ss"))


def python_float(x: Column) -> Column:
    """A double as Python writes it: positional from 1e-4 to 1e16, else with a two-digit exponent."""
    plain = F.regexp_replace(F.format_string("%s", x.cast("decimal(38,18)")), r"(\.\d*?[1-9])0+$|\.0+$", "$1")
    plain = F.when(F.instr(plain, ".") > 0, plain).otherwise(F.concat(plain, F.lit(".0")))
    near = (F.abs(x) >= 1e-3) & (F.abs(x) < 1e7) | (x == 0)
    exponent = F.regexp_replace(F.regexp_replace(F.regexp_replace(x.cast("string"), r"\.0E", "E"), "E(\\d)", "e+$1"), "E-", "e-")
    exponent = F.regexp_replace(exponent, r"e([+-])(\d)$", "e$10$2")
    return F.when(near, x.cast("string")).when((F.abs(x) >= 1e7) & (F.abs(x) < 1e16), plain).otherwise(exponent)


def md_escape(s: Column) -> Column:
    return F.regexp_replace(F.replace(F.coalesce(s, F.lit("")), F.lit("|"), F.lit("\\|")), "\r?\n", " ")


def truncate(s: Column, n: int) -> Column:
    return F.when(F.length(s) <= n, s).otherwise(F.concat(F.substring(s, 1, max(0, n - 3)), F.lit("...")))


def stable_hash(s: Column, n: int = 12) -> Column:
    return F.substring(F.sha1(s.cast("binary")), 1, n)


def is_caps(s: Column, least: int = 8, share: float = 0.85) -> Column:
    letters, upper = F.regexp_count(s, F.lit(r"\p{L}")), F.regexp_count(s, F.lit(r"\p{Lu}"))
    return (letters >= least) & (upper >= share * letters)


def slug(s: Column, words: int, chars: int = 90) -> Column:
    """A file name from a title: letters, digits and underscores, so many words, so many characters."""
    clean = F.trim(F.regexp_replace(F.regexp_replace(norm_space(s), r"(?U)[^\w\s-]", ""), r"(?U)\s+", " "))
    return F.substring(F.array_join(F.slice(F.split(clean, " "), 1, words), "_"), 1, chars)


def a1(row: Column, col: Column) -> Column:
    """The spreadsheet address of a 1-based cell."""
    c = col - 1
    letter = lambda x: F.chr(F.lit(65) + x)
    name = F.when(c < 26, letter(c)).when(c < 702, F.concat(letter(F.floor(c / 26) - 1), letter(c % 26))).otherwise(
        F.concat(letter(F.floor((c - 702) / 676)), letter(F.floor((c - 702) / 26) % 26), letter((c - 702) % 26))
    )
    return F.concat(name, row.cast("string"))
