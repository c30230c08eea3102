"""Text measures and cue expressions."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Lexicon:
    """Cue patterns of one language family; every pattern is a parameter.

    A tail is its code, its pattern, and a pattern that must not occur in the matched text.
    """

    question: str
    answer: str
    keywords: tuple[str, ...]
    tails: tuple[tuple[str, str, str | None], ...]
    stop: tuple[str, ...]
    negation: str


# Cue lists for Latin-script text.
LATIN = Lexicon(
    question=r"\?|^(?:why|how|what|when|where|who)\s",
    answer=r"because|so|the|and",
    keywords=("the", "and", "for"),
    tails=(("connective_tail_needs_review", r"(?:^|[^a-z])(?:and|but|so|of|the)$", None),),
    stop=("the", "and", "of", "to", "a", "is"),
    negation=r"\d+(?:\.\d+)?|\b(?:not|no|never|cannot)\b",
)

# Cue lists for Chinese text.
CHINESE = Lexicon(
    question=r"[?？]|为什么|怎么|如何|是否|什么",
    answer=r"因为|所以|答案|也就是说|可以|不能|首先|是这样",
    keywords=("关键", "原因", "方法", "总结", "注意", "为什么", "怎么"),
    tails=(
        ("conditional_tail_needs_review", r"(?:如果|假如|倘若|要是)[^，,。.!！?？;；:\n：]{1,24}$",
         r"就|那么|否则|则|便|会|能|可以|应该|该|吗|呢"),
        ("connective_tail_needs_review",
         r"(?:你就|它就|他就|我们就|他们就|所以|但是|而且|以及|比如|例如)$", None),
        ("demonstrative_tail_needs_review", r"是(?:这种|那种|这个|那个)$", None),
        ("auxiliary_tail_needs_review", r"(?:已经|正在|将要)$", None),
    ),
    stop=("我们", "你们", "他们", "这个", "那个", "就是", "一个", "那么", "然后", "这样", "这种",
          "什么", "现在", "已经", "时候", "因为", "所以", "还有", "the", "and", "of", "to", "a", "is"),
    negation=r"\d+(?:\.\d+)?|[零〇一二三四五六七八九十百千万亿两]+|[不没无未非]"
             r"|\b(?:not|no|never|cannot)\b|n.t\b",
)

TERMINAL = r"[。！？!?；;.][”’\"'）)】\]]*$"
SOFT_MARK = r"[,，:：、][”’\"'）)】\]]*$"
CLOSERS = r"^[”’\"'）)】\]]+$"
TRAILING = r"[，,。.!！;；:： ]+$"


def _unicode_fold(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).casefold())


def folded(text: Column) -> Column:
    """Compatibility form without case.

    ASCII stays in the JVM, where folding is ``lower``; only other texts are sent to Python.
    """
    plain = text.rlike(r"\A[\x00-\x7f]*\z")
    return F.when(plain, F.lower(text)).otherwise(F.pandas_udf(_unicode_fold, T.StringType())(F.when(~plain, text)))


def text_units(text: Column) -> Column:
    """Letters and digits in ``text``."""
    return F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]", "")).cast("bigint")


def keyword_pattern(keywords: tuple[str, ...]) -> str:
    """Alternation that prefers the longest keyword at each position."""
    ordered = sorted((k.strip().lower() for k in keywords), key=lambda k: (-len(k), k))
    return "|".join("\\Q" + k + "\\E" for k in ordered)


def keyword_hits(text: Column, keywords: tuple[str, ...]) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("(" + keyword_pattern(keywords) + ")"), F.lit(1))


def is_question(text: Column, lexicon: Lexicon) -> Column:
    return text.rlike("(?i)" + lexicon.question)


def is_answer(text: Column, lexicon: Lexicon) -> Column:
    return text.rlike("(?i)" + lexicon.answer)


def after_question(text: Column, lexicon: Lexicon) -> Column:
    """What follows the first question cue; empty without one."""
    return F.regexp_extract(text, r"(?is)^.*?(?:" + lexicon.question + r")(.*)$", 1)


def ends_terminal(text: Column) -> Column:
    return F.rtrim(text).rlike(TERMINAL)


def tail_signal(text: Column, lexicon: Lexicon) -> Column:
    """Code of the first unfinished-tail pattern, null for questions and quotations."""
    tail = F.rtrim(text)
    bare = F.regexp_replace(tail, TRAILING, "")
    code = F.lit(None).cast("string")
    for name, pattern, unless in reversed(lexicon.tails):
        found = F.regexp_extract(bare, "(?i)" + pattern, 0)
        code = F.when((found != "") & (F.lit(True) if unless is None else ~found.rlike(unless)), F.lit(name)).otherwise(code)
    open_ended = (tail == "") | tail.rlike(r"[?？]$") | tail.rlike(r"[“”「」『』\"]")
    return F.when(open_ended, F.lit(None)).otherwise(code)


def terms(text: Column, lexicon: Lexicon) -> Column:
    """Term occurrences: Latin words, numbers and 2/3-grams of Han runs, minus stop words."""
    return folded_terms(folded(text), lexicon)


def folded_terms(text: Column, lexicon: Lexicon) -> Column:
    """``terms`` of a text that is folded already."""
    parts = F.regexp_extract_all(text, F.lit(r"([一-鿿]+|[a-z]+|\d+(?:\.\d+)?)"), F.lit(1))
    grams = F.flatten(F.transform(parts, _grams))
    return F.filter(grams, lambda t: ~t.isin(list(lexicon.stop)))


def _grams(part: Column) -> Column:
    size = F.length(part)

    def cut(n: int) -> Column:
        whole = F.transform(F.sequence(F.lit(1), F.greatest(size - (n - 1), F.lit(1))),
                            lambda i: F.substring(part, i, F.lit(n)))
        return F.filter(whole, lambda g: F.length(g) == n)

    return F.when(part.rlike(r"^[一-鿿]"), F.concat(cut(2), cut(3))).otherwise(F.array(part))


def compact(text: Column) -> Column:
    return F.regexp_replace(folded(text), r"[^一-鿿a-z0-9]", "")


def safeguards(text: Column, lexicon: Lexicon) -> Column:
    """Sorted numbers and negations; near copies must agree on them."""
    return F.array_sort(F.regexp_extract_all(folded(text), F.lit("(" + lexicon.negation + ")"), F.lit(1)))


def error_rate_form(text: Column) -> Column:
    """Folded text without white space and punctuation."""
    return F.regexp_replace(folded(text), r"[\s\p{P}]", "")


def display_columns(text: Column) -> Column:
    """Terminal columns: wide characters count two, combining marks none."""
    plain = F.regexp_replace(text, r"\p{M}", "")
    wide = F.regexp_replace(plain, r"[^ᄀ-ᅟ⺀-〾ぁ-㏿㐀-䶿一-鿿"
                                   r"ꀀ-꓏가-힣豈-﫿︰-﹯＀-｠￠-￦]", "")
    return (F.length(plain) + F.length(wide)).cast("bigint")


def clean_note(text: Column, limit: int) -> Column:
    """Trimmed free text, null when empty, too long or with control characters."""
    value = F.trim(text)
    bad = (value == "") | (F.length(value) > limit) | value.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")
    return F.when(~bad, value)


def escape_srt(text: Column) -> Column:
    return F.translate(text, "<>", "＜＞")


def escape_ass(text: Column) -> Column:
    return F.replace(F.translate(text, "\\{}", "＼｛｝"), F.lit("\n"), F.lit("\\N"))
