"""Text functions as columns: sizes, words, synthetic probabilities, entity names, prompts' helpers.

All run in the JVM. Sizes count octets of UTF-8, four to a token.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the deterministic token model and of the entity extractor.
BASE, AFTER_END, LONG_WORD, ASKING = 1.0, 4.0, 1.5, 2.0
LONG_BYTES = 8
SPACES = r"[\s\u0085\u001c-\u001f\p{Z}]+"
TRIM = ".,!?;:'\"()[]"


def count_tokens(c: Column, least: int | None = None) -> Column:
    """Octets div 4: at least 1 if not empty, 0 if empty; ``least`` = 1 makes the empty text 1 too; null stays null."""
    n = F.octet_length(c)
    size = F.floor(n / 4).cast("int")
    sized = F.when(n.isNotNull(), F.greatest(F.lit(1), size))
    return sized if least else F.when(n == 0, 0).otherwise(sized)


def fields(c: Column) -> Column:
    """The words between Unicode white space; an empty list for blank text, null for null."""
    return F.filter(F.split(c, SPACES), lambda x: x != "")


def squeeze(c: Column) -> Column:
    """The words joined by one blank."""
    return F.array_join(fields(c), " ")


def surprisal(word: Column, previous: Column) -> Column:
    """Of a word after ``previous`` (null at the beginning): more after the end of a sentence, and for long words and
    those that ask or exclaim."""
    start = F.when(previous.rlike("[.!?]$"), AFTER_END).otherwise(BASE)
    long = F.when(F.octet_length(word) > LONG_BYTES, LONG_WORD).otherwise(0.0)
    asks = F.when(word.contains("?") | word.contains("!"), ASKING).otherwise(0.0)
    return start + long + asks


def capitalised(word: Column) -> Column:
    return word.rlike("^[A-Z]")


def entity_names(c: Column) -> Column:
    """Capitalised words of at least two octets, then pairs of adjacent capitalised words; duplicates stay."""
    words = F.transform(fields(c), lambda w: F.btrim(w, F.lit(TRIM)))
    single = F.filter(words, lambda w: capitalised(w) & (F.octet_length(w) >= 2))
    pairs = F.zip_with(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, F.lit(2), F.size(words)), lambda a, b: F.when(capitalised(a) & capitalised(b), F.concat_ws(" ", a, b)))
    return F.concat(single, F.filter(pairs, lambda p: p.isNotNull()))


def truncate(c: Column, octets: int) -> Column:
    """Whole text if it fits; else its first ``octets`` octets of UTF-8, without a character cut in two, up to the last blank if that
    lies beyond the half, with ``...``."""
    head = F.substring(F.encode(c, "UTF-8"), 1, octets).cast("string")
    head = F.when(F.is_valid_utf8(head), head).otherwise(F.regexp_replace(F.make_valid_utf8(head), "\ufffd+$", ""))
    cut = F.regexp_extract(head, r"(?s)^(.*) ", 1)
    return F.when(F.octet_length(c) <= octets, c).otherwise(F.concat(F.when(F.octet_length(cut) > octets // 2, cut).otherwise(head), F.lit("...")))


def tokenize(c: Column) -> Column:
    return F.filter(F.split(c, r"[\s\p{P}]+"), lambda x: x != "")


def unfence(c: Column) -> Column:
    """Without a Markdown code fence around the text."""
    return F.trim(F.regexp_replace(F.trim(c), r"^```(?:json)?\s*|\s*```$", ""))
