"""Text columns: cleaning, lexicon matches, token sets and set similarity. All built from Spark functions."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it (Java's \s alone leaves out U+00A0 and U+3000).
UNICODE_SPACE = r"(?U)\s+"
CJK = r"[\x{4e00}-\x{9fff}]"
#: Marks that the title rules remove (fixed value).
TITLE_MARKS = r"[\s\-_|·：:，,。.！!？?\"'「」【】《》()（）]"
LATIN_WORD = r"[a-zA-Z][a-zA-Z0-9.]+"


def first_of(*cols: Column | str) -> Column:
    """The first value that is neither null nor the empty string."""
    return F.coalesce(*[F.nullif(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in cols])


def lower_text(*cols: Column | str) -> Column:
    """The columns joined by one space, lower-cased; nulls count as empty."""
    return F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in cols]))


def has_any(text: Column, terms: Iterable[str]) -> Column:
    """Whether lower-cased text holds any term as a substring: one flat OR that stays in generated code."""
    out = F.lit(False)
    for t in terms:
        out = out | F.contains(text, F.lit(t.lower()))
    return F.coalesce(out, F.lit(False))


def matched(text: Column, terms: Iterable[str]) -> Column:
    """The terms that lower-cased text holds, in lexicon order, repeats of the lexicon included. The text is made once, however many terms there are."""
    held = lambda x: F.array_compact(F.array(*[F.when(F.contains(x, F.lit(t.lower())), F.lit(t)) for t in terms]))
    return F.transform(F.array(text), held)[0]


def word_pattern(term: str) -> str:
    """A pattern for term between ASCII word boundaries (Java's own boundary counts CJK characters as letters)."""
    return rf"(?<![A-Za-z0-9_]){re.escape(term)}(?![A-Za-z0-9_])"


def has_any_word_or_part(text: Column, terms: Iterable[str], short: int = 2) -> Column:
    """Like has_any, but terms of up to short ASCII characters must stand as words."""
    out = F.lit(False)
    for t in terms:
        out = out | (text.rlike(word_pattern(t)) if len(t) <= short and t.isascii() else F.contains(text, F.lit(t)))
    return F.coalesce(out, F.lit(False))


def strip_tags(col: Column) -> Column:
    return F.regexp_replace(col, r"<[^>]*>", "")


def clean_summary(col: Column, most: int = 500) -> Column:
    """Without tags and character references, white space folded, trimmed, at most so many characters."""
    bare = F.regexp_replace(strip_tags(col), r"&[a-zA-Z0-9#]+;", " ")
    return F.substring(F.trim(F.regexp_replace(bare, UNICODE_SPACE, " ")), 1, most)


def character_pairs(col: Column) -> Column:
    """The two-character pieces of a text in order, repeats included; its characters are cut once."""
    pairs = F.transform(F.array(F.split(col, "")), lambda c: F.zip_with(c, F.slice(c, F.lit(2), F.size(c)), lambda a, b: F.concat(a, b)))[0]
    return F.when(F.char_length(col) >= 2, F.array_compact(pairs)).otherwise(F.array().cast("array<string>"))


def bigrams(col: Column) -> Column:
    """The distinct two-character pieces of the lower-cased text; none if it is shorter or null."""
    return F.array_distinct(character_pairs(F.lower(F.coalesce(col, F.lit("")))))


def jaccard(a: Column, b: Column) -> Column:
    """Share of common members among all; 0 if either is empty or null."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / either).otherwise(F.lit(0.0))


def overlap(a: Column, b: Column) -> Column:
    """Overlap coefficient: common members by the smaller set; 0 if either is empty or null."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.least(F.size(a), F.size(b))).otherwise(F.lit(0.0))


def folded(names: Column) -> Column:
    """Distinct lower-cased members."""
    return F.array_distinct(F.transform(F.coalesce(names, F.array().cast("array<string>")), F.lower))


def cjk_bigrams(col: Column) -> Column:
    return character_pairs(F.regexp_replace(F.coalesce(col, F.lit("")), r"[^\x{4e00}-\x{9fff}]", ""))


def title_keywords(title: Column, split_words: bool = False) -> Column:
    """Distinct lower-cased Latin words and CJK pairs of a title.

    By default marks and white space go first, so a Latin title is one word; split_words keeps its words apart.
    """
    title = F.coalesce(title, F.lit(""))
    bare = F.regexp_replace(title, TITLE_MARKS, " " if split_words else "")
    latin = F.transform(F.regexp_extract_all(bare, F.lit(LATIN_WORD), F.lit(0)), F.lower)
    return F.array_distinct(F.concat(latin, cjk_bigrams(F.regexp_replace(title, TITLE_MARKS, ""))))


def urls(col: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(col, F.lit("")), F.lit(r"https?://[^\s\)]+"), F.lit(0))


def url_host(url: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(F.coalesce(url, F.lit("")), r"^https?://", ""), "/"), 1)


def with_scheme(url: Column) -> Column:
    return F.when(url.isNull() | (url == ""), F.lit("")).when(url.startswith("http"), url).otherwise(F.concat(F.lit("https://"), url))


def has_cjk(col: Column) -> Column:
    return F.coalesce(col, F.lit("")).rlike(CJK)


def to_fixed(col: Column, digits: int = 2, signed_zero: bool = False) -> Column:
    """A double with so many decimals (at most 6), rounded by its exact binary value: 1.005 is below the half, 1.125 is on it and goes up.

    The fraction is taken apart into three exact limbs of 26 bits and put together as an integer, so nothing is rounded before the end; bits
    below 2^-78 aren't looked at. For numbers below 2^53; null stays null, NaN is 'NaN'. signed_zero: a negative zero keeps its sign, as printf has it.
    """
    size = F.abs(col)
    whole = F.floor(size)
    limb, rest = [], size - whole
    for _ in range(3):
        scaled = rest * float(1 << 26)
        limb.append(F.floor(scaled).cast("decimal(38,0)"))
        rest = scaled - F.floor(scaled)
    number = lambda n: F.lit(str(n)).cast("decimal(27,0)")
    bits = (limb[0].cast("decimal(10,0)") * number(1 << 52).cast("decimal(16,0)") + limb[1].cast("decimal(10,0)") * number(1 << 26).cast("decimal(10,0)") + limb[2].cast("decimal(10,0)")).cast("decimal(26,0)")
    shares = F.call_function("div", bits * F.lit(2 * 10**digits).cast("decimal(8,0)") + number(1 << 78).cast("decimal(26,0)"), number(1 << 79))
    units = whole.cast("decimal(20,0)") * F.lit(10**digits).cast("decimal(8,0)") + shares.cast("decimal(20,0)")
    text = F.lpad(units.cast("decimal(30,0)").cast("string"), F.greatest(F.char_length(units.cast("decimal(30,0)").cast("string")), F.lit(digits + 1)), F.lit("0"))
    cut = F.char_length(text) - digits
    below = (col < 0) | col.cast("string").startswith("-") if signed_zero else col < 0
    shown = F.concat(F.when(below, F.lit("-")).otherwise(F.lit("")), F.substring(text, F.lit(1), cut), F.lit("." if digits else ""), F.substring(text, cut + 1, F.lit(digits)))
    return F.when(F.isnan(col), F.lit("NaN")).otherwise(shown)


def utf16_key(text: Column) -> Column:
    """Sorts as a text's UTF-16 code units do: characters beyond U+FFFF come before U+E000."""
    return F.encode(text, "UTF-16BE")


def utf16_sorted(texts: Column) -> Column:
    """An array of texts in the order of their UTF-16 code units, nulls left out."""
    return F.transform(F.array_sort(F.transform(F.array_compact(texts), lambda t: F.struct(utf16_key(t).alias("k"), t.alias("t")))), lambda x: x["t"])
