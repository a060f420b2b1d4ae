"""Text column functions. All JVM-side except NFKC, which Spark lacks."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heliograph.functions import dims
from heliograph.session import stored

# A word character is a letter, a number or "_" in any script.
WORD = r"[\p{L}\p{N}_]"
TOKEN = WORD + "+"
SPACE = r"[\s\p{Z}\x1c-\x1f\x85]+"

# Characters that NFKC never changes and that never combine with each other:
# ASCII, the Latin letters up to U+0131, kana, unified Han, Hangul syllables.
_NFKC_STABLE = (
    "^[\\x00-\\x7F\\u00C0-\\u0131\\u3041-\\u3096\\u30A1-\\u30FC\\u4E00-\\u9FFF\\uAC00-\\uD7A3]*$"
)


@F.pandas_udf(T.StringType())
def _nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: unicodedata.normalize("NFKC", v), na_action="ignore")


@F.pandas_udf(T.StringType())
def _unescape(values: pd.Series) -> pd.Series:
    return values.map(html.unescape, na_action="ignore")


def squash(text: Column) -> Column:
    """Collapse every whitespace run to one space and trim."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def normalize_text(text: Column) -> Column:
    """NFKC + squash; NULL becomes the empty string.

    Only rows holding characters NFKC could change travel to Python; the rest
    are sent as NULL, so one scan serves both kinds.
    """
    text = F.coalesce(text, F.lit(""))
    odd = F.when(~text.rlike(_NFKC_STABLE), text)
    return squash(F.coalesce(_nfkc(odd), text))


def unescape_html(text: Column) -> Column:
    """HTML entities to characters; rows without "&" stay in the JVM."""
    return F.coalesce(_unescape(F.when(text.contains("&"), text)), text)


def strip_html(text: Column) -> Column:
    plain = unescape_html(F.regexp_replace(F.coalesce(text, F.lit("")), "<[^>]+>", ""))
    return F.regexp_replace(plain, rf"^{SPACE}|{SPACE}$", "")


def content_hash(normalized: Column) -> Column:
    return F.sha2(normalized, 256)


def node_id(node_type: Column, normalized_name: Column) -> Column:
    slug = F.regexp_replace(F.lower(normalized_name), SPACE, "_")
    return F.concat(node_type, F.lit(":"), F.regexp_replace(slug, "[^a-z0-9_:-]", ""))


def edge_id(src: Column, dst: Column, relation: Column) -> Column:
    return F.concat(src, F.lit("->"), dst, F.lit(":"), relation)


def clamp(value: Column, low, high) -> Column:
    low = low if isinstance(low, Column) else F.lit(low)
    high = high if isinstance(high, Column) else F.lit(high)
    return F.when(value.isNotNull(), F.greatest(low, F.least(high, value)))


def cache_key(namespace: str, *args: Column, prefix: str = "hg") -> Column:
    digest = F.substring(F.md5(F.concat_ws(":", *[a.cast("string") for a in args])), 1, 12)
    return F.concat(F.lit(f"{prefix}:{namespace}:"), digest)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def word_count(text: Column) -> Column:
    """Whitespace-separated words."""
    return F.regexp_count(text, F.lit(r"[^\s\p{Z}\x1c-\x1f\x85]+"))


def with_normalized(df: DataFrame, column: str, out: str = "normalized") -> DataFrame:
    return stored(df, **{out: normalize_text(F.col(column))})


def shingles(tokens: Column, k: int = 3) -> Column:
    """Distinct k-word shingles of a token array; a shorter text is one shingle,
    no word none. Built by zipping shifted copies: a lambda that captured the
    tokens could be evaluated with the tokenizer inlined, once per word."""
    n = F.size(tokens)
    grams = tokens
    for shift in range(1, k):
        rest = F.slice(tokens, shift + 1, F.greatest(n - shift, F.lit(0)))
        grams = F.zip_with(grams, rest, lambda x, y: F.concat(x, F.lit(" "), y))
    short = F.when(n > 0, F.array(F.array_join(tokens, " "))).otherwise(F.array().cast("array<string>"))
    return F.when(n >= k, F.array_distinct(F.array_compact(grams))).otherwise(short)


def with_shingles(df: DataFrame, normalized: str, out: str = "shingles", k: int = 3) -> DataFrame:
    cut = stored(df, _tokens=tokens(F.lower(F.col(normalized))))
    return stored(cut, **{out: shingles(F.col("_tokens"), k)}).drop("_tokens")


# -- language ----------------------------------------------------------------
HANGUL = r"\p{IsHangul}"
# Script classes miss marks shared by both kana scripts; they are added here.
KANA = r"[\p{IsHiragana}\p{IsKatakana}゙-゜゠・ーｰﾞﾟ]"
HAN = r"\p{IsHan}"
LATIN = r"\p{IsLatin}"


def detect_language(text: Column) -> Column:
    """Dominant-script rule over Hangul, kana, Han and Latin counts."""
    ko, ja, zh, latin = (F.regexp_count(text, F.lit(p)) for p in (HANGUL, KANA, HAN, LATIN))
    return (
        F.when((ko > 0) & (ko >= F.greatest(ja, zh)), "ko")
        .when(ja > 0, "ja")
        .when(zh > 0, "zh")
        .when(latin > 0, "en")
        .otherwise("other")
    )


def map_language_code(code: Column) -> Column:
    code = F.lower(F.coalesce(code, F.lit("")))
    return (
        F.when(code.startswith("zh"), "zh").when(code.isin("ko", "en", "ja"), code).otherwise("other")
    )


# -- cue classifiers -----------------------------------------------------------
def _occurrences(text: Column, cue: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(cue), F.lit("")))) / F.lit(len(cue))


def _with_cue_label(df: DataFrame, low: str, cues: dict, floor: float, out: str) -> DataFrame:
    counts = {label: f"_n_{label}" for label in cues}
    df = stored(
        df,
        **{
            name: sum((_occurrences(F.col(low), cue) for cue in cues[label]), F.lit(0.0))
            for label, name in counts.items()
        },
    )
    total = sum((F.col(name) for name in counts.values()), F.lit(0.0))
    df = df.withColumns({"_total": total, "_best": F.greatest(*[F.col(n) for n in counts.values()])})
    # First label in table order wins a tie.
    winner = F.coalesce(*[F.when(F.col(n) == F.col("_best"), label) for label, n in counts.items()])
    conf = (
        F.when(F.col(low) == "", 0.0)
        .when(F.col("_total") == 0, 0.5)
        .otherwise(F.least(F.lit(0.99), 0.6 + 0.4 * F.col("_best") / F.nullif(F.col("_total"), F.lit(0.0))))
    )
    df = df.withColumn("_conf", conf)
    label = F.when((F.col("_conf") >= floor) & (F.col("_total") > 0), winner).otherwise("unknown")
    df = df.withColumns({out: label, f"{out}_conf": F.round("_conf", 4)})
    return df.drop("_total", "_best", "_conf", *counts.values())


def classify(df: DataFrame, normalized: str, emotion: bool = True, intent: bool = True) -> DataFrame:
    """Adds emotion / intent and their confidences from cue-word counts. The
    cues of all languages are counted, so the language is not an input."""
    df = stored(df, _low=F.lower(F.col(normalized)))
    if emotion:
        df = _with_cue_label(df, "_low", dims.EMOTION_CUES, dims.EMOTION_CONF_MIN, "emotion")
    if intent:
        df = _with_cue_label(df, "_low", dims.INTENT_CUES, dims.INTENT_CONF_MIN, "intent")
    return df.drop("_low")


# -- readability ---------------------------------------------------------------
def count_syllables(word: Column) -> Column:
    return F.greatest(F.lit(1), F.regexp_count(F.lower(word), F.lit("[aeiouy]+")))


def flesch_reading_ease(text: Column) -> Column:
    """Reading ease in 0..100.

    A word's syllables are its vowel runs, at least one; runs never cross a
    word, so the text's sum is all runs plus the words without a vowel.
    """
    low = F.lower(text)
    words = F.regexp_count(text, F.lit(TOKEN))
    sentences = F.greatest(F.lit(1), F.regexp_count(text, F.lit(r"[^.!?\s\p{Z}][^.!?]*")))
    runs = F.regexp_count(low, F.lit("[aeiouy]+"))
    mute = F.regexp_count(low, F.lit(rf"(?<!{WORD})[\p{{L}}\p{{N}}_&&[^aeiouy]]+(?!{WORD})"))
    ease = 206.835 - 1.015 * words / sentences - 84.6 * (runs + mute) / F.nullif(words, F.lit(0))
    return F.when(words == 0, 0.0).otherwise(clamp(ease, 0.0, 100.0))


def estimate_tokens(text: Column) -> Column:
    count = (F.floor(word_count(text) / 0.75) + 1).cast("bigint")
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit(0).cast("bigint")).otherwise(count)


def fixed(value: Column, digits: int) -> Column:
    """Fixed-point text, rounded half to even on the exact binary value."""
    return F.call_function("format_number", value, F.lit("0." + "0" * digits))


# -- copyright -------------------------------------------------------------------
def quote_ratio(text: Column) -> Column:
    quoted = F.regexp_extract_all(text, F.lit('["“”]([^"“”]{10,})["“”]'), F.lit(1))
    chars = F.length(F.array_join(quoted, ""))
    return F.when(F.length(text) > 0, F.least(F.lit(1.0), chars / F.length(text))).otherwise(0.0)


def copyright_score(text: Column, source_url: Column, license_tag: Column) -> Column:
    unattributed = F.when(F.coalesce(source_url, F.lit("")) == "", 1.0).otherwise(0.0)
    risk = dims.lookup(
        dims.LICENSE_RISK, F.lower(F.coalesce(license_tag, F.lit(""))), dims.LICENSE_RISK_DEFAULT
    )
    return clamp(0.5 * quote_ratio(text) + 0.2 * unattributed + 0.3 * risk, 0.0, 1.0)
