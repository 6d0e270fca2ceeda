"""Words and English stems as column expressions, and the same in SQL for the oracles.

The stemmer follows Porter's published steps. Each rule is one regular expression without look-around or
back-references, so that Java and RE2 read it alike; a tilde marks where an ending of the second step went.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}]+"
#: Words that the stemmed form leaves out.
STOP = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "in", "is", "it", "not", "of", "on", "or", "the", "to", "was", "with")
#: What stands before an ending: one sequence of a vowel and a consonant at least, or two.
_ONE = "^(y?[^aeiouy]*[aeiouy]+[^aeiouy].*?)"
_TWO = "^(y?[^aeiouy]*[aeiouy]+[^aeiouy]+[aeiouy]+[^aeiouy].*?)"
#: (pattern, replacement), in order.
RULES = (
    ("(ss|i)es$", r"\1"),
    ("([^s])s$", r"\1"),
    ("^(y?[^aeiouy]*[aeiouy]+[^aeiouy].*)eed$", r"\1ee"),
    ("^(.*[aeiouy].*[^e]|.*[aiouy])ed$", r"\1~"),
    ("^(.*[aeiouy].*)ing$", r"\1~"),
    ("(at|bl|iz)~$", r"\1e"),
    ("(?:b(b)|d(d)|f(f)|g(g)|m(m)|n(n)|p(p)|r(r)|t(t))~$", r"\1\2\3\4\5\6\7\8\9"),
    ("^([^aeiouy]*[aeiouy][^aeiouwxy])~$", r"\1e"),
    ("~$", ""),
    ("^(.*[aeiouy].*)y$", r"\1i"),
    (_ONE + "(?:ization|izer)$", r"\1ize"),
    (_ONE + "(?:ational|ation|ator)$", r"\1ate"),
    (_ONE + "tional$", r"\1tion"),
    (_ONE + "(?:alism|aliti|alli)$", r"\1al"),
    (_ONE + "(?:iveness|iviti)$", r"\1ive"),
    (_ONE + "(?:ousness|ousli)$", r"\1ous"),
    (_ONE + "fulness$", r"\1ful"),
    (_ONE + "biliti$", r"\1ble"),
    (_ONE + "abli$", r"\1able"),
    (_ONE + "(enc|anc)i$", r"\1\2e"),
    (_ONE + "(ent|e)li$", r"\1\2"),
    (_ONE + "(?:ic(?:ate|iti|al))$", r"\1ic"),
    (_ONE + "alize$", r"\1al"),
    (_ONE + "(?:ative|ful|ness)$", r"\1"),
    (_TWO + "(?:ement|ment|ance|ence|able|ible|ant|ent|ism|ate|iti|ous|ive|ize|al|er|ic|ou)$", r"\1"),
    ("^(y?[^aeiouy]*[aeiouy]+[^aeiouy]+[aeiouy]+[^aeiouy]*[st])ion$", r"\1"),
    ("^(y?[^aeiouy]*[aeiouy]+[^aeiouy]+[aeiouy]+[^aeiouy].*)e$", r"\1"),
    ("^(y?[^aeiouy]*(?:[aeiouy]{2,}[^aeiouy]+|[aeiouy][^aeiouy]{2,}|[aeiouy]+[wx]|[aeiouy]+[^aeiouy]+[aeiouy]+))e$", r"\1"),
    ("^(y?[^aeiouy]*[aeiouy]+[^aeiouy]+[aeiouy]+(?:[^aeiouy].*)?l)l$", r"\1"),
)


#: How many rules go together, and what a word must end in for any of them to apply.
_GROUPS = (
    (2, "s"),
    (3, "ed ing"),
    (4, "~"),
    (1, "y"),
    (11, "ization izer ational ation ator tional alism aliti alli iveness iviti ousness ousli fulness biliti abli enci anci entli eli"),
    (3, "icate iciti ical alize ative ful ness"),
    (2, "ement ment ance ence able ible ant ent ism ate iti ous ive ize al er ic ou ion"),
    (3, "e l"),
)


def words_of(text: Column) -> Column:
    """The words of a text in lower case: letters and digits of any script."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), F.lit(1))


def stem(word: Column) -> Column:
    for pattern, by in RULES:
        word = F.regexp_replace(word, pattern, by.replace("\\", "$"))
    return word


def stems_of(words: Column) -> Column:
    """The stems of an array of words; a group of rules is tried only on words that end as it asks (plain endings cost far less than
    expressions), array by array, so that no step is computed twice and no generated method grows too long to be compiled."""

    def step(size: int, endings: list[str], at: int) -> Callable[[Column], Column]:
        def one(word: Column) -> Column:
            changed = word
            for pattern, by in RULES[at : at + size]:
                changed = F.regexp_replace(changed, pattern, by.replace("\\", "$"))
            last = F.substring(word, -1, 1).isin(*sorted({e[-1] for e in endings}))
            return F.when(last & reduce(Column.__or__, [F.endswith(word, F.lit(e)) for e in endings]), changed).otherwise(word)

        return one

    at = 0
    for size, endings in _GROUPS:
        words, at = F.transform(words, step(size, endings.split(), at)), at + size
    return words


def with_stem(words: DataFrame, word: str, name: str) -> DataFrame:
    """The rows with the stem of a column."""
    return words.withColumn(name, stems_of(F.array(word))[0])


def words_sql(text: str) -> str:
    return f"regexp_extract_all(lower({text}), '{WORD}')"


def stem_sql(word: str) -> str:
    for pattern, by in RULES:
        word = f"regexp_replace({word}, '{pattern}', '{by}')"
    return word
