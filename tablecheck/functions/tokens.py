"""Reversible tokens for identifiers in text, as column expressions."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

QUOTED = '"[^"]*"'


@dataclass(frozen=True)
class TokenStyle:
    """What is replaced, and by what.

    A token is the first ``width`` hex characters of the SHA-256 of ``salt`` + name.
    ``terms`` are listed words replaced as whole words; unless ``require_underscore`` is
    off, only those with an underscore are replaced.
    """

    terms: Sequence[str] = ()
    width: int = 10
    salt: str = ""
    require_underscore: bool = True

    def __post_init__(self) -> None:
        if not 1 <= self.width <= 64:
            raise ValueError("a token has 1 to 64 characters")
        if not all(self.terms):
            raise ValueError("a term may not be empty")

    @property
    def of_words(self) -> bool:
        """Whether every term is one word, so that words can be looked up in a table."""
        return all(re.fullmatch(r"\w+", t) for t in self.terms)

    @property
    def pattern(self) -> str:
        # (?U) makes word boundaries follow Unicode letters.
        if not self.terms:
            return f"(?U){QUOTED}"
        if self.of_words and self.require_underscore:
            return rf"(?U){QUOTED}|(?<!\w)[\w&&[^_]]*+_\w*+"
        if self.of_words:
            return rf"(?U){QUOTED}|\w++"
        listed = "|".join(r"\Q" + t.replace(r"\E", r"\E\\E\Q") + r"\E" for t in self.terms)
        return rf"(?U){QUOTED}|\b(?:{listed})\b"

    @property
    def token_pattern(self) -> str:
        return rf"(?U)\b[a-fA-F0-9]{{{self.width}}}\b"


def token_of(name: Column, style: TokenStyle = TokenStyle()) -> Column:
    salted = F.concat(F.lit(style.salt), name) if style.salt else name
    return F.substring(F.sha2(salted, 256), 1, style.width)


def _is_quoted(match: Column) -> Column:
    return match.startswith('"') & match.endswith('"')


def _inside(match: Column) -> Column:
    return F.substring(match, F.lit(2), F.length(match) - 2)


def _is_listed(word: Column, terms: Sequence[str]) -> Column:
    """Whether a word is one of ``terms``: one array access and the walk through a short list.

    The terms are one constant of the plan, parsed while planning, in as many lists as
    there are terms.
    """
    lists: list[list[str]] = [[] for _ in terms]
    for term in terms:
        lists[zlib.crc32(term.encode()) % len(lists)].append(term)
    table = F.from_json(F.lit(json.dumps(lists)), "array<array<string>>")
    place = (F.crc32(word.cast("binary")) % len(lists)).cast("int")
    return F.array_contains(F.get(table, place), word)


def _is_replaced(match: Column, style: TokenStyle) -> Column:
    terms = list(dict.fromkeys(style.terms))
    listed = _is_listed(match, terms) if terms and style.of_words else F.lit(True)
    if style.require_underscore:
        listed = match.contains("_") & listed
    return _is_quoted(match) | listed


def _matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _interleave(text: Column, pattern: str, replacements: Column) -> Column:
    """The text between the matches, joined again by the replacements (one fewer)."""
    between = F.split(text, pattern, -1)
    pieces = F.zip_with(
        between, replacements, lambda gap, new: F.concat(gap, F.coalesce(new, F.lit("")))
    )
    return F.array_join(pieces, "")


def tokenize(text: Column, style: TokenStyle = TokenStyle()) -> Column:
    """Quoted names and listed terms of ``text`` replaced by tokens; quotes are kept."""

    def replace(match: Column) -> Column:
        quoted_token = F.concat(F.lit('"'), token_of(_inside(match), style), F.lit('"'))
        return (
            F.when(_is_quoted(match), quoted_token)
            .when(_is_replaced(match, style), token_of(match, style))
            .otherwise(match)
        )

    found = F.transform(_matches(text, style.pattern), replace)
    return _interleave(text, style.pattern, found)


def found_terms(text: Column, style: TokenStyle = TokenStyle()) -> Column:
    """The names in one text that ``tokenize`` replaces, each once."""
    replaced = F.filter(_matches(text, style.pattern), lambda m: _is_replaced(m, style))
    bare = F.transform(replaced, lambda m: F.when(_is_quoted(m), _inside(m)).otherwise(m))
    return F.array_distinct(bare)


def token_words(text: Column, style: TokenStyle = TokenStyle()) -> Column:
    """All words that look like tokens, in order."""
    return _matches(text, style.token_pattern)


def bucket_of(word: Column, digits: int) -> Column:
    """The number that the first hex digits of a token spell."""
    return F.conv(F.substring(word, 1, digits), 16, 10).cast("int")


def restore_with_buckets(
    text: Column, buckets: Column, digits: int, style: TokenStyle = TokenStyle()
) -> Column:
    """Tokens replaced by the names that ``token -> name`` maps give; unknown words stay.

    ``buckets`` is an array of such maps, ordered by ``bucket_of``: looking a word up takes
    one array access and the walk through one small map.
    """

    def name_of(word: Column) -> Column:
        names = F.get(buckets, bucket_of(word, digits))
        return F.coalesce(F.try_element_at(names, word), word)

    found = F.transform(token_words(text, style), name_of)
    return _interleave(text, style.token_pattern, found)


def restore_with_list(
    text: Column, words: Column, style: TokenStyle, if_unequal: Column
) -> Column:
    """The token-like words of ``text`` replaced, in order, by ``words`` (null for none).

    ``if_unequal`` is the result when their numbers differ.
    """
    found = F.size(token_words(text, style))
    given = F.coalesce(words, F.array().cast("array<string>"))
    return F.when(text.isNotNull() & (found != F.size(given)), if_unequal).otherwise(
        _interleave(text, style.token_pattern, given)
    )
