"""Text predicates and clean-ups of form labels as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that make a text a field's label.
LABEL_WORDS = ("address", "advertisement", "age", "applied", "birth", "candidate", "category", "code", "contact", "date", "email", "father", "gender", "husband", "letter", "mail", "mobile", "name", "nationality", "number", "obc", "passport", "phone", "pin", "post", "pwd", "sc", "sex", "signature", "st", "year")
# Words that carry a label on into the next row.
CONTINUATION_WORDS = ("letters", "years", "months", "days", "man")
# No space follows a token ending in one of these, or precedes a token that is one of these.
GLUE_AFTER = ("/", "-", "(", ":")
GLUE_TOKENS = (":", ".", ",", ";", ")", "/", "-")


def strip(text: Column) -> Column:
    """Without white space at both ends (any kind, not only blanks)."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def word_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), 1)


def alnum_count(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""))


def symbol_ratio(text: Column) -> Column:
    """Characters that are neither letters, digits nor white space, over all (1 at least)."""
    return F.length(F.regexp_replace(text, r"[\p{L}\p{N}\s]", "")) / F.greatest(F.length(text), F.lit(1))


def upper_ratio(text: Column) -> Column:
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    return F.when(letters > 0, F.length(F.regexp_replace(text, r"[^\p{Lu}]", "")) / letters).otherwise(F.lit(0.0))


def is_prompt(text: Column) -> Column:
    """A label word, a number in front or a colon or question mark."""
    return F.arrays_overlap(word_tokens(text), F.array(*[F.lit(w) for w in LABEL_WORDS])) | text.rlike(r"^\s*\d+[\s.):-]") | text.contains(":") | text.contains("?")


def mappable_label(text: Column, cy: Column, page_height: Column) -> Column:
    """Whether a text may label a field; titles and lone words in the top 30 % of a page may not."""
    top = (page_height > 0) & (cy < page_height * 0.3)
    return is_prompt(text) | ~(top & ((upper_ratio(text) >= 0.72) | (F.size(F.array_distinct(word_tokens(text))) <= 1)))


def continues(text: Column) -> Column:
    """Whether a row carries the row before on: short, ending in a colon, or with one of the words."""
    found = text.endswith(":") | (F.length(text) < 25)
    for w in CONTINUATION_WORDS:
        found = found | F.lower(text).contains(w)
    return found


def glue(tokens: Column) -> Column:
    """Tokens joined in order, without a space beside gluing punctuation."""

    def add(a: Column, t: Column) -> Column:
        tight = (F.length(a) == 0) | F.substring(a, -1, 1).isin(*GLUE_AFTER) | t.isin(*GLUE_TOKENS)
        return F.when(tight, F.concat(a, t)).otherwise(F.concat(a, F.lit(" "), t))

    return F.aggregate(tokens, F.lit(""), add)


def field_name(label: Column, index: Column) -> Column:
    """A form field's name: other characters as one underscore, the index at the end."""
    base = F.regexp_replace(strip(F.coalesce(label, F.lit(""))), r"[^A-Za-z0-9_]+", "_")
    return F.concat(F.when(base == "", F.lit("field")).otherwise(base), F.lit("_"), index.cast("string"))
