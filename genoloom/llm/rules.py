"""Operator 10: line-first quality rules.

Punctuation, navigation and boilerplate rules are evaluated on every line; failing lines are removed, and a document
that loses too much of its text is rejected. Rules read features of lines: how a line ends and how the next one begins, symbols, separators, links,
capitals, repetition, its length and that of its neighbours. Phrase lists are parameters beside them. Fixed document counts are computed too.

A null text counts as empty: all counts 0, not kept. Blank lines never fail and never count. Repeated rows give repeated
results; an empty table gives an empty result; columns other than the two named ones are ignored. A text is one row
at a time in one worker, whole.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from genoloom.llm.common import map_texts, table

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
#: Characters that end a line of prose, those that stand between the items of a menu, and those that end a sentence.
TERMINAL = ".!?…:;,\"')]»”’。！？：；，、）」』"
SEPARATORS = "|»›·•"
SENTENCE_ENDS = ".!?…。！？"
#: Words from which on a line must end like prose, hold the end of a sentence, or go on in the next line; words of a menu's item at most; lines of a menu at least.
LONG_LINE, ITEM_WORDS, MENU_LINES = 8, 4, 3

#: Default phrases that mark a navigation or a boilerplate line.
NAVIGATION = ("home", "menu", "login", "log in", "sign in", "sign up", "next page", "previous page", "read more", "click here", "share this", "back to top", "skip to content", "subscribe")
BOILERPLATE = ("all rights reserved", "copyright", "terms of use", "terms of service", "privacy policy", "cookie policy", "use of cookies", "lorem ipsum", "enable javascript", "permission is hereby granted", "licensed under")


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode().split()  # bytes.split() cuts at \x20 and \x09-\x0D only
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line in seen:
            dup += 1
        elif line.strip(SPACES):
            seen.add(line)
    windows = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(windows)) < len(windows):
        counts, reached = Counter(windows), 0
        for i, w in enumerate(windows):
            if counts[w] > 1:
                repeated += i + 3 - max(i, reached)
                reached = i + 3
    return len(words), chars, symbols, dup, repeated


@lru_cache(maxsize=8)
def _any_of(phrases: tuple[str, ...]) -> re.Pattern:
    return re.compile("|".join(map(re.escape, phrases)) or "(?!)")


def _is_lower(c: str) -> bool:
    return c.lower() == c and c.upper() != c


def is_short(bare: str) -> bool:
    """Whether a stripped line could be an item of a menu: few words, no end of a sentence."""
    return bare[-1] not in TERMINAL and len(bare.split()) <= ITEM_WORDS


def line_fails(bare: str, after: str, seen: set[str], in_menu: bool, navigation: tuple[str, ...], boilerplate: tuple[str, ...]) -> str | None:
    """The rule that a stripped line with words fails, or None.

    after: the next line with words, or empty; seen: lines of the document so far; in_menu: whether the line is one of MENU_LINES or more short lines in a row.
    """
    words = bare.split()
    n = len(words)
    if n > 3 and bare in seen:
        return "repeated_line"
    if n >= 3:
        if sum(map(bare.count, SYMBOLS)) * 5 >= n * 2 or bare.count("!") * 2 >= n:
            return "punctuation"
        if n >= 4 and sum(map(str.isupper, words)) * 10 >= n * 7:
            return "shouting"
        if n >= 8 and len(set(words)) * 10 <= n * 7 and max(Counter(words).values()) * 10 >= n * 4:
            return "repeated_words"
    cuts = sum(map(bare.count, SEPARATORS))
    if in_menu or cuts >= 2 and n <= ITEM_WORDS * (cuts + 1):
        return "navigation"
    if ("://" in bare or "www." in bare) and 2 * sum("://" in w or w.startswith("www.") for w in words) >= n:
        return "navigation"
    if n >= LONG_LINE and bare[-1] not in TERMINAL and not (after and _is_lower(after[0])) and not any(c in bare for c in SENTENCE_ENDS):
        return "punctuation"
    low = bare.lower()
    if n <= ITEM_WORDS and low.rstrip(" >»|.") in navigation:
        return "navigation"
    if "©" in bare or boilerplate and _any_of(boilerplate).search(low):
        return "boilerplate"
    return None


def clean_lines(text: str | None, navigation: tuple[str, ...] = NAVIGATION, boilerplate: tuple[str, ...] = BOILERPLATE) -> tuple[str, list[str]]:
    """The text without its failing lines, and the rules that failed, line by line."""
    if not text:
        return "", []
    lines = text.split("\n")
    bare = [x.strip(SPACES) for x in lines]
    full = [i for i, x in enumerate(bare) if x]
    menus, row = set(), []
    for i in full:
        if is_short(bare[i]):
            row.append(i)
            continue
        if len(row) >= MENU_LINES:
            menus.update(row)
        row = []
    if len(row) >= MENU_LINES:
        menus.update(row)
    failed, out, seen = [], set(), set()
    for i, j in zip(full, [*full[1:], -1]):
        rule = line_fails(bare[i], bare[j] if j >= 0 else "", seen, i in menus, navigation, boilerplate)
        seen.add(bare[i])
        if rule:
            failed.append(rule)
            out.add(i)
    return ("\n".join(x for i, x in enumerate(lines) if i not in out) if out else text), failed


def judge(text: str | None, min_words: int, max_repeat_percent: int, min_left_percent: int, navigation: tuple[str, ...] = NAVIGATION, boilerplate: tuple[str, ...] = BOILERPLATE) -> dict:
    n, chars, symbols, dup, repeat = base_counts(text)
    base_failed = n < min_words or 100 * repeat > max_repeat_percent * n
    cleaned, failed = clean_lines(text, navigation, boilerplate)
    left = len(cleaned) - sum(map(cleaned.count, SPACES))
    return {"n_words": n, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup, "n_repeat_words": repeat, "base_failed": base_failed, "kept": not base_failed and 100 * left >= min_left_percent * chars, "kept_chars": left, "failed_rules": failed, "cleaned_text": cleaned}


COUNTS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, kept_chars bigint"


def apply_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50, max_repeat_percent: int = 50, min_left_percent: int = 50, with_text: bool = True, navigation: tuple[str, ...] = NAVIGATION, boilerplate: tuple[str, ...] = BOILERPLATE) -> DataFrame:
    """One row per row of docs: counts, verdict and, if with_text, failed_rules and cleaned_text. One narrow stage, no shuffle."""
    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, {COUNTS}" + ", failed_rules array<string>, cleaned_text string" * with_text

    def rows(x: dict) -> dict:
        got = [judge(t, min_words, max_repeat_percent, min_left_percent, tuple(navigation), tuple(boilerplate)) for t in x["text"]]
        names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "kept_chars", *(["failed_rules", "cleaned_text"] if with_text else [])]
        return {"doc_id": x["doc_id"], **{k: [g[k] for g in got] for k in names}}

    return map_texts(docs, {"doc_id": id_col, "text": text_col}, schema, rows)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(table(spark, sf_dir, "documents"), with_text=False).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "kept_chars")
