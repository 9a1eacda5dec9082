"""Expressions over transcripts: normalization, tokens, numbers, names and model output."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from voxloom.functions.udf import arrow

# Fixed values.
NUMBER_WORDS = (
    "không", "một", "mốt", "hai", "ba", "bốn", "tư", "năm", "lăm", "sáu", "bảy", "tám", "chín", "mười", "mươi", "chục", "trăm",
    "nghìn", "ngàn", "triệu", "tỷ", "tỉ", "linh", "lẻ", "phẩy", "âm", "trừ",
)
TITLES = ("ông", "bà", "anh", "chị", "em", "cô", "chú", "bác", "cậu", "mợ", "dì", "thím", "thầy", "u", "mụ")
NOT_NAMES = (
    "cả", "hai", "ba", "bốn", "tư", "năm", "sáu", "bảy", "tám", "chín", "mười", "ta", "tôi", "mình", "nó", "họ", "người", "nhà", "vợ", "chồng",
    "con", "cháu", "anh", "chị", "em", "ông", "bà", "cô", "chú", "bác", "cậu", "mợ", "dì", "thím", "thầy", "u", "mụ", "lớn", "nhỏ", "trẻ", "già",
)
VERBS_AFTER_NAMES = (
    "theo", "đi", "về", "lên", "xuống", "nói", "bảo", "kêu", "gọi", "đứng", "ngồi", "chạy", "đến", "rời", "vào", "ra", "qua", "đưa", "lấy", "mang", "xem",
)
KNOWN_NAMES = {
    r"(?i)\b(?:hennike|henike)\b": "Heineken",
    r"(?i)\b(?:sau\s*inbet|sauinbet|inbet)\b": "InBev",
    r"(?i)\bsamiler\b": "SABMiller",
    r"(?iu)\ban\s*hiu\s*sơ\s*búto\b": "Anheuser-Busch",
    r"(?iu)\bmilơ\s*lí\b": "Miller Lite",
}
PROMPT_ECHOES = ("hãy chuẩn hoá đoạn asr sau theo đúng yêu cầu hệ thống", "đoạn_gốc:", "trả về duy nhất 1 dòng kết quả")
TRUE_TEXTS = ("true", "1", "yes")
PUNCTUATION = ".,?!:;"

NOT_WORD = r"[^\p{L}\p{M}\p{N}_]+"
NOT_LETTER = r"[^\p{L}\p{N}_]+"
NOT_SINGLE_SPACED = r"[^\p{L}\p{N}_ ]|  "


# Words of transcripts that stand for spoken marks.
SPOKEN_MARKS = (
    "&AMPERSAND", ",COMMA", ";SEMI-COLON", ":COLON", "!EXCLAMATION-POINT", "...ELLIPSIS", "-HYPHEN", ".PERIOD", ".DOT", "?QUESTION-MARK",
    ".DECIMAL", ".PERCENT", "/SLASH",
    "'SINGLE-QUOTE", '"DOUBLE-QUOTE', '"QUOTE', '"UNQUOTE', '"END-OF-QUOTE', '"END-QUOTE', '"CLOSE-QUOTE', '"IN-QUOTES',
    "(PAREN", "(PARENTHESES", "(IN-PARENTHESIS", "(BRACE", "(LEFT-PAREN", "(PARENTHETICALLY", "(BEGIN-PARENS",
    ")CLOSE-PAREN", ")CLOSE_PAREN", ")END-THE-PAREN", ")END-OF-PAREN", ")END-PARENS", ")CLOSE-BRACE", ")RIGHT-PAREN", ")UN-PARENTHESES", ")PAREN",
    "{LEFT-BRACE", "}RIGHT-BRACE",
)


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _words_only(text: Column) -> Column:
    """Runs of what is no letter, number or underscore become one space. Texts that have only single spaces are left as they are."""
    return F.trim(F.when(text.rlike(NOT_SINGLE_SPACED), F.regexp_replace(text, NOT_LETTER, " ")).otherwise(text))


def normalize_words(text: Column | str) -> Column:
    """Lower case, marks to spaces, single spaces; null is empty."""
    return _words_only(F.lower(F.coalesce(_c(text), F.lit(""))))


@arrow("string")
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def normalize_text(text: Column | str) -> Column:
    """`normalize_words` with NFKC before marks go. Of ASCII texts nothing is sent to Python."""
    low = F.lower(F.trim(F.coalesce(_c(text), F.lit(""))))
    ascii = F.octet_length(low) == F.char_length(low)
    return _words_only(F.when(ascii, low).otherwise(nfkc(F.when(~ascii, low))))


def clean_text(text: Column | str) -> Column:
    """Lower case, trimmed, white space collapsed."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(_c(text), F.lit(""))), r"\s+", " "))


def upper_text(text: Column | str, upper: bool = True) -> Column:
    trimmed = F.trim(F.coalesce(_c(text), F.lit("")))
    return F.upper(trimmed) if upper else trimmed


def strip_control(text: Column | str) -> Column:
    """NUL goes; line breaks become spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(_c(text), r"\x00", ""), r"[\r\n]+", " "))


def as_bool(text: Column | str) -> Column:
    return F.coalesce(F.lower(_c(text).cast("string")).isin(*TRUE_TEXTS), F.lit(False))


def parse_json_list(text: Column | str, kind: str = "string") -> Column:
    """The JSON list in a text; empty if it is none."""
    return F.coalesce(F.from_json(_c(text), f"array<{kind}>"), F.array().cast(f"array<{kind}>"))


def safe_time(value: Column | str, default: float = 0.0) -> Column:
    """A finite number, else the default."""
    x = _c(value).try_cast("double")
    return F.when(x.isNull() | F.isnan(x) | x.isin(float("inf"), float("-inf")), F.lit(default)).otherwise(x)


def canonical_tokens(text: Column | str) -> Column:
    """Lower-cased words without marks; none for an empty text."""
    words = F.trim(F.regexp_replace(F.lower(F.coalesce(_c(text), F.lit(""))), r"[^\p{L}\p{N}_À-ỹ]+", " "))
    return F.when(words == "", F.array().cast("array<string>")).otherwise(F.split(words, " "))


def has_digit(text: Column | str) -> Column:
    return _c(text).rlike(r"\p{Nd}")


def is_digit_token(token: Column) -> Column:
    return token.rlike(r"^\p{Nd}+(?:[.,]\p{Nd}+)?$")


def is_number(token: Column) -> Column:
    return token.isin(*NUMBER_WORDS) | is_digit_token(token)


def number_words(text: Column | str) -> Column:
    """Whether a text has two number words or more."""
    return F.size(F.filter(canonical_tokens(text), lambda t: t.isin(*NUMBER_WORDS))) >= 2


def collapse_numbers(tokens: Column | str) -> Column:
    """Each run of numbers becomes one `<num>`: marks stay where the token before was no number."""
    tokens = _c(tokens)
    marked = F.transform(tokens, lambda t, i: F.when(~is_number(t), t).when((i == 0) | ~is_number(F.coalesce(F.get(tokens, i - 1), F.lit(""))), F.lit("<num>")))
    return F.filter(marked, lambda t: t.isNotNull())


def drop_numbers(tokens: Column | str) -> Column:
    return F.filter(_c(tokens), lambda t: ~is_number(t))


def has_capital_word(text: Column | str) -> Column:
    return _c(text).rlike(r"\b[A-Z][A-Za-z][A-Za-z-]*\b")


def has_foreign_noise(text: Column | str) -> Column:
    """Two words or more of five or more ASCII letters that are no number words."""
    return F.size(F.filter(canonical_tokens(text), lambda t: ~t.isin(*NUMBER_WORDS) & t.rlike(r"^[a-z][a-z-]{4,}$"))) >= 2


def words_preserved(raw: Column | str, normalized: Column | str, numbers: bool = False) -> Column:
    """Equal token lists, with runs of numbers taken as one if `numbers`."""
    a, b = canonical_tokens(raw), canonical_tokens(normalized)
    return collapse_numbers(a) == collapse_numbers(b) if numbers else a == b


def capitalize_sentences(text: Column | str) -> Column:
    """The first letter of each sentence in upper case: split behind the marks, then each part at its first letter."""
    parts = F.split(_c(text), r"(?<=[.?!])")
    raised = F.transform(
        parts,
        lambda p: F.concat(F.regexp_extract(p, r"^(\P{L}*)", 1), F.upper(F.regexp_extract(p, r"^\P{L}*(\p{L})", 1)), F.regexp_replace(p, r"^\P{L}*\p{L}?", "")),
    )
    return F.array_join(raised, "")


def name_candidates(text: Column | str) -> Column:
    """Words after titles, and between `và` and a verb if they stand twice or more; longest first, then by letters."""
    low = F.lower(_c(text))
    name = r"([a-zà-ỹ][a-zà-ỹ'-]+)"
    titled = F.regexp_extract_all(low, F.lit(rf"(?U)\b(?:{'|'.join(sorted(TITLES, key=len, reverse=True))})\s+{name}(?![\p{{L}}])"), F.lit(1))
    titled = F.filter(titled, lambda t: ~t.isin(*NOT_NAMES, *VERBS_AFTER_NAMES))
    joined = F.regexp_extract_all(low, F.lit(rf"(?U)\bvà\s+{name}\s+(?:{'|'.join(VERBS_AFTER_NAMES)})(?![\p{{L}}])"), F.lit(1))
    tokens = canonical_tokens(text)
    joined = F.filter(joined, lambda t: ~t.isin(*NOT_NAMES) & (F.size(F.filter(tokens, lambda x: x == t)) >= 2))
    found = F.array_distinct(F.concat(titled, joined))
    return F.transform(F.array_sort(F.transform(found, lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t")))), lambda s: s["t"])


def capitalize_words(text: Column | str, words: Column | str) -> Column:
    """Each of the words, whole and in any case, with its first letter raised."""
    raised = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))
    return F.aggregate(_c(words), _c(text), lambda t, w: F.regexp_replace(t, F.concat(F.lit(r"(?iu)(?<![\p{L}\p{M}\p{N}_])\Q"), w, F.lit(r"\E(?![\p{L}\p{M}\p{N}_])")), raised(w)))


def replace_known_names(text: Column | str, rules: Mapping[str, str] = KNOWN_NAMES) -> Column:
    out = _c(text)
    for pattern, name in rules.items():
        out = F.regexp_replace(out, pattern, name)
    return out


def finalize_text(text: Column | str, known_names: bool = True) -> Column:
    out = replace_known_names(text) if known_names else _c(text)
    out = capitalize_sentences(out)
    return capitalize_words(out, name_candidates(out))


def pronounced_punct(text: Column | str) -> Column:
    """Whether a transcript has words that stand for spoken marks."""
    return F.arrays_overlap(F.split(F.coalesce(_c(text), F.lit("")), r"\s+"), F.array(*map(F.lit, SPOKEN_MARKS)))


def punct_count(text: Column | str) -> Column:
    return F.length(_c(text)) - F.length(F.translate(_c(text), PUNCTUATION, ""))


def clean_model_output(text: Column | str, fallback: Column | str) -> Column:
    """The first line of a model's answer that is no echo of the prompt, without fences, thoughts, labels and quotes; else the fallback."""
    out = F.regexp_replace(F.regexp_replace(_c(text), r"\r", "\n"), "```", "")
    out = F.regexp_replace(F.regexp_replace(out, r"(?s)<think>.*?</think>", ""), r"(?s)<think>.*", "")
    lines = F.filter(F.transform(F.split(out, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    good = F.filter(lines, lambda x: ~F.exists(F.array(*map(F.lit, PROMPT_ECHOES)), lambda p: F.contains(F.lower(x), p)))
    first = F.coalesce(F.get(good, 0), F.get(lines, 0), F.lit(""))
    first = F.regexp_replace(first, r"(?iu)^(?:normalized|đoáng)\s*[:：]\s*", "")
    first = F.regexp_replace(first, r"^[ \"'`]+|[ \"'`]+$", "")
    return F.when(first == "", _c(fallback)).otherwise(first)


def build_prompt(text: Column | str, numbers: Column, punctuation: Column, names: Column) -> Column:
    """The request for an external model: its rules by flags, then the text."""
    rules = F.concat_ws(
        "\n",
        F.lit("Normalize the transcript on one line; keep every word and its order."),
        F.when(numbers, F.lit("Write spelled numbers as digits where their value is certain.")),
        F.when(punctuation, F.lit("Put punctuation where sentences end.")),
        F.when(names, F.lit("Raise the first letter of names that are certain.")),
    )
    return F.concat(rules, F.lit("\nTEXT: "), F.coalesce(_c(text), F.lit("")))


def classify_error(message: Column | str, skip: Iterable[str], retry: Iterable[str]) -> Column:
    """`skip` or `retry` by the markers in a message, else `other`."""
    low = F.lower(F.coalesce(_c(message), F.lit("")))
    has = lambda marks: F.exists(F.array(*[F.lit(m.lower()) for m in marks]), lambda m: F.contains(low, m))
    return F.when(has(skip), "skip").when(has(retry), "retry").otherwise("other")


def compare_pair(raw: Column | str, normalized: Column | str) -> Column:
    """Whether a pair differs, keeps its words, and how many tokens and marks each has."""
    return F.struct(
        (_c(raw) != _c(normalized)).alias("changed"),
        words_preserved(raw, normalized).alias("preserved"),
        F.size(canonical_tokens(raw)).alias("raw_tokens"),
        F.size(canonical_tokens(normalized)).alias("norm_tokens"),
        punct_count(raw).alias("raw_marks"),
        punct_count(normalized).alias("norm_marks"),
    )


def decode_tokens(ids: Column | str, pieces: Mapping[int, str], blank: int = 0) -> Column:
    """Pieces of ids, joined; the mark of a word's start becomes a space."""
    table = F.create_map(*[F.lit(x) for pair in pieces.items() for x in pair])
    known = F.filter(_c(ids), lambda i: i != blank)
    return F.trim(F.replace(F.array_join(F.transform(known, lambda i: F.coalesce(F.try_element_at(table, i), F.lit(""))), ""), F.lit("▁"), F.lit(" ")))
