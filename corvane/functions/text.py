"""Scalar text expressions: field concatenation, keyword lists, tokens, phrase matching, judge prompts and replies."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode words: runs of letters and digits.
WORD = r"[\p{L}\p{N}]+"


def filled(value: Column) -> Column:
    """The value if it is a string that is not blank, else null."""
    return F.when(F.trim(value) != "", value)


def rich_text(fields: Sequence[tuple[str, Column]], separator: str = " | ") -> Column:
    """Ordered `prefix value` parts joined by a separator; null and blank fields leave no part."""
    parts = [F.concat_ws(" ", F.lit(prefix), v) if prefix else v for prefix, v in ((p, filled(c)) for p, c in fields)]
    return F.concat_ws(separator, *[F.when(filled(c).isNotNull(), part) for (_, c), part in zip(fields, parts, strict=True)])


def keyword_text(keywords: Column, is_array: bool = False) -> Column:
    """A keyword list as plain text: array items joined, or a list literal without its quotes and brackets."""
    return F.array_join(keywords, ", ") if is_array else F.translate(keywords, "'[]", "")


def keyword_array(keywords: Column) -> Column:
    """A list literal as an array; other text that is not blank as a single item; else an empty array."""
    parsed = F.from_json(F.translate(keywords, "'", '"'), "array<string>")
    return F.coalesce(parsed, F.when(F.trim(keywords) != "", F.array(keywords)), F.array().cast("array<string>"))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def tokens_with_marks(text: Column) -> Column:
    """Words, and each mark that stands between them as a token of its own."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD + r"|[^\s\p{L}\p{N}]"), F.lit(0))


def word_count(text: Column) -> Column:
    trimmed = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, " "))).cast("long")


def any_phrase(text: Column, phrases: Sequence[str]) -> Column:
    """Whether the text holds one of the phrases, in any case. Null text: false."""
    return F.coalesce(text.rlike("(?i)" + "|".join(re.escape(p) for p in phrases)), F.lit(False))


def contains_fold(text: Column, needle: str) -> Column:
    return F.coalesce(F.contains(F.lower(text), F.lit(needle.lower())), F.lit(False))


def with_default(value: Column, default: str) -> Column:
    return F.coalesce(filled(value), F.lit(default))


def judge_prompt(template: str, **fields: Column) -> Column:
    """A template with {name} places; null and blank fields read `unknown`."""
    out: list[Column] = []
    for literal, name in re.findall(r"([^{}]*)(?:\{(\w+)\})?", template):
        if literal:
            out.append(F.lit(literal))
        if name:
            out.append(with_default(fields[name].cast("string"), "unknown"))
    return F.concat(*out)


def judge_reply(reply: Column) -> Column:
    """struct(label, reason) of a reply: the JSON from its first { to its last }; else a null label and
    the reply's first 200 characters after a mark. A null reply gives nulls."""
    parsed = F.from_json(F.regexp_extract(reply, r"(?s)\{.*\}", 0), "label string, reason string")
    label = parsed["label"].try_cast("int")
    return F.struct(label.alias("label"), F.when(label.isNull(), F.concat(F.lit("UNPARSEABLE: "), F.substring(reply, 1, 200))).otherwise(F.coalesce(parsed["reason"], F.lit(""))).alias("reason"))


def pair_key(query_id: Column, key: Column) -> Column:
    return F.concat_ws("::", query_id.cast("string"), key.cast("string"))


def split_pair_key(key: Column) -> Column:
    """Query id and key; the key itself may hold the separator."""
    parts = F.split(key, "::", 2)
    return F.struct(parts[0].try_cast("long").alias("query_id"), parts[1].alias("key"))


def query_terms(text: Column, stop: Sequence[str]) -> Column:
    """Lower-case words without the marks around them, longer than two letters and not stop words."""
    words = F.transform(F.split(F.trim(F.lower(text)), r"\s+"), lambda w: F.regexp_replace(w, r"^[.,;()]+|[.,;()]+$", ""))
    return F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*stop))
