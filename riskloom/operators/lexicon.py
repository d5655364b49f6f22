"""Scores from word lists: fear and urgency of a text, and the text read from an image.  Native expressions, but for the shares of lexicons."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskloom import config
from riskloom.functions.automaton import Automaton
from riskloom.functions.urls import hits, pattern_hits


def fear(text: Column, anger: Column, joy: Column, sadness: Column) -> dict[str, Column]:
    """Emotion scores of a model, given as columns, supplemented by a lexicon.  Null texts and those under 10 characters score 0."""
    a, j, s = (F.coalesce(F.round(c, 4), F.lit(0.0)) for c in (anger, joy, sadness))
    lower = F.lower(text)
    model = F.least(F.lit(1.0), (a * 0.6 + s * 0.3) * (1 - j * 0.5))
    lexicon = F.least(F.lit(1.0), hits(lower, config.FEAR_WORDS) * 0.08 + hits(lower, config.URGENCY_WORDS) * 0.1)
    long = F.length(F.trim(text)) >= 10
    scored = lambda c: F.when(long, F.round(c, 4)).otherwise(0.0)
    return {"fear_score": scored(model * 0.7 + lexicon * 0.3), "lexicon_score": scored(lexicon), "model_fear_score": scored(model)}


def image_text(text: Column) -> dict[str, Column]:
    """Credential phrases, brands, ``password`` and urgency in the text of an image; null scores 0."""
    t = F.coalesce(text, F.lit(""))
    lower = F.lower(t)
    credentials, brands, urgency = pattern_hits(t, config.OCR_PATTERNS), hits(lower, config.OCR_BRANDS), hits(lower, config.OCR_URGENCY)
    score = F.least(F.lit(0.6), credentials * 0.2) + (brands > 0).cast("int") * 0.3 + lower.contains("password").cast("int") * 0.25 + F.least(F.lit(0.3), urgency * 0.1)
    return {"credential_hits": credentials.cast("long"), "brand_hits": brands.cast("long"), "urgency_hits": urgency.cast("long"), "ocr_score": F.round(F.least(F.lit(1.0), score), 4)}


def _share(count: Column, size: int) -> Column:
    return F.when(count.isNotNull(), F.round(F.least(F.lit(1.0), count / max(0.15 * size, 1.0)), 3))


def share_of_lexicon(text: Column, words) -> Column:
    """hits over 15 % of the lexicon's size (1 at least), 1 at most, three decimals; null for a null text."""
    return shares(text, {"words": words})["words_score"]


def shares(text: Column, lexicons: dict, automaton: Automaton | None = None) -> dict[str, Column]:
    """F21 of any lexicons: name to words (with an automaton of theirs: to their number); one pass over the text, however many words they have."""
    found = (automaton or Automaton(lexicons)).counts(F.lower(text))
    return {f"{n}_score": _share(found[n], words if automaton else len(words)) for n, words in lexicons.items()}


def lexicon_shares(text: Column) -> dict[str, Column]:
    """the share of each of the six lexicons."""
    return shares(text, config.LEXICONS)


def brands_in_text(text: Column, brands: tuple[str, ...] = config.TEXT_BRANDS) -> Column:
    """the brands that stand between blanks, in the list's order; none for null."""
    padded = F.concat(F.lit(" "), F.lower(text), F.lit(" "))
    return F.array_compact(F.array(*[F.when(padded.contains(f" {b} "), b) for b in brands]))


def text_shape(text: Column) -> dict[str, Column]:
    """length, digits, blanks and the rest that is neither letter nor digit; 0 for null."""
    t = F.coalesce(text, F.lit(""))
    count = lambda p: F.regexp_count(t, F.lit(p)).cast("long")
    return {"length": F.length(t).cast("long"), "digit_count": count("[0-9]"), "special_count": count(r"[^A-Za-z0-9\s]"), "space_count": count(r"\s")}
