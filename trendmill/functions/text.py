"""Text measures.  Every pattern is Unicode aware, as the counts must be."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trendmill import constants as K

_EMOJI = "[" + "".join(rf"\x{{{a}}}-\x{{{b}}}" for a, b in K.EMOJI_RANGES) + "]"
_CLICKBAIT = r"(?iU)\b(" + "|".join(K.CLICKBAIT_TERMS) + r")\b"


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def chars_per_word(text: Column) -> Column:
    n = word_count(text)
    return F.when(n > 0, F.length(text) / n).when(n == 0, F.lit(0.0))


def flag(condition: Column) -> Column:
    return condition.cast("int")


def has_pattern(text: Column, pattern: str) -> Column:
    return flag(F.regexp_like(text, F.lit(pattern)))


def has_any_word(text: Column, alternatives: str) -> Column:
    return has_pattern(text, rf"(?iU)\b({alternatives})\b")


def occurrences(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def title_signals(title: Column) -> dict[str, Column]:
    return {
        "title_has_numbers": has_pattern(title, r"(?U)\d"),
        "title_has_uppercase": has_pattern(title, "[A-Z]"),
        "title_exclamation_count": occurrences(title, "!"),
        "title_question_count": occurrences(title, r"\?"),
        "title_has_clickbait_words": has_pattern(title, _CLICKBAIT),
    }


def description_signals(description: Column) -> dict[str, Column]:
    return {
        "description_has_links": flag(F.contains(description, F.lit("http"))),
        "description_has_emoji": has_pattern(description, _EMOJI),
    }


def squeeze(text: Column) -> Column:
    """Runs of white space become one blank."""
    return F.regexp_replace(text, r"(?U)\s+", " ")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def clean_title(text: Column) -> Column:
    return F.regexp_replace(squeeze(strip(text)), r"(?U)[^\w\s\-.,!?;:]", "")


def clean_tags(text: Column) -> Column:
    return F.regexp_replace(squeeze(strip(text)), r"(?U)[^\w\s\-|,]", "")


def split_tags(tags: Column, delimiters: str = K.TAG_DELIMITERS) -> Column:
    """Trimmed, non-empty tags; null, blank and the 'no tags' marker give an empty array."""
    parts = F.filter(F.transform(F.split(tags, delimiters), strip), lambda t: t != "")
    empty = F.array().cast("array<string>")
    return F.when(tags.isNull() | (tags == "") | (tags == K.NO_TAGS), empty).otherwise(parts)


def tag_count(tags: Column, delimiters: str = K.TAG_DELIMITERS) -> Column:
    """Delimited fields, counting empty ones between delimiters, as the loaders do."""
    missing = tags.isNull() | (tags == "") | (tags == K.NO_TAGS)
    return F.when(missing, 0).otherwise(F.size(F.split(tags, delimiters)))


def mean_length(items: Column) -> Column:
    """Mean character length of an array's strings, 0 for none."""
    total = F.aggregate(items, F.lit(0), lambda acc, t: acc + F.length(t))
    return F.when(F.size(items) > 0, total / F.size(items)).otherwise(F.lit(0.0))


def avg_tag_length(tags: Column) -> Column:
    return mean_length(split_tags(tags))


def unique_tag_count(tags: Column) -> Column:
    return F.size(F.array_distinct(F.transform(split_tags(tags), F.lower)))


def duration_seconds(duration: Column) -> Column:
    """ISO-8601 ``PT#H#M#S`` to seconds; anything not starting with ``PT`` is 0."""
    def part(unit: str) -> Column:
        digits = F.regexp_extract(duration, rf"(\d+){unit}", 1)
        return F.coalesce(digits.try_cast("int"), F.lit(0))

    seconds = part("H") * 3600 + part("M") * 60 + part("S")
    return F.when(F.startswith(duration, F.lit("PT")), seconds).otherwise(0)


def content_complexity(text: Column) -> dict[str, Column]:
    tokens = F.coalesce(words(text), F.array().cast("array<string>"))
    return {
        "avg_word_length": mean_length(tokens),
        "unique_words": F.size(F.array_distinct(tokens)),
        "total_words": F.size(tokens),
    }


def _contained(text: Column, terms) -> Column:
    total = F.lit(0)
    for term in terms:
        total = total + flag(F.contains(text, F.lit(term)))
    return total


def sentiment_indicators(text: Column) -> dict[str, Column]:
    whole = F.coalesce(text, F.lit(""))
    lowered = F.lower(whole)
    positive = _contained(lowered, K.POSITIVE_TERMS)
    negative = _contained(lowered, K.NEGATIVE_TERMS)
    return {
        "positive": positive,
        "negative": negative,
        "neutral": word_count(whole) - positive - negative,
    }


def content_themes(text: Column) -> Column:
    """Names of the themes with at least one keyword in the text."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    hits = [F.when(_contained(lowered, terms) > 0, F.lit(theme))
            for theme, terms in K.THEME_KEYWORDS.items()]
    return F.array_compact(F.array(*hits))


def model_tokens(text: Column, stop_words=K.STOP_WORDS, min_length: int = 3) -> Column:
    """Lower-cased letter tokens without links, mentions, hash tags and stop words."""
    out = F.lower(F.coalesce(text, F.lit("")))
    out = F.regexp_replace(out, r"(?U)http\S+|www\S+", "")
    out = F.regexp_replace(out, r"(?U)[@#]\w+", "")
    out = F.regexp_replace(out, r"[^a-z]+", " ")
    # isin over literals compiles to one hash-set probe per token.
    return F.filter(F.split(out, " "),
                    lambda t: (F.length(t) >= min_length) & ~t.isin(*stop_words))


def combined_text(title: Column, description: Column, tags: Column) -> Column:
    """Title twice, then description, then tags with delimiters as blanks."""
    spaced = F.regexp_replace(tags, K.TAG_DELIMITERS, " ")
    return F.concat_ws(" ", title, title, description, spaced)
