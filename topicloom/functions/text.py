"""Text, id and fallback expressions of the catalogue."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

UNIT = "\u001f"
#: White space as Python's \s has it: Java's Unicode class and the four information separators.
SPACE = r"(?U)[\s\x1c-\x1f]+"


@cache
def _folds() -> dict[str, str]:
    """The letters that stay the same in lower case but not casefolded (final sigma, ligatures, Cherokee and others), found by that rule."""
    letters = (chr(c) for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000)
    return {c: c.casefold() for c in letters if c == c.lower() != c.casefold()}


def casefold(text: Column) -> Column:
    """Casefolded text, by built-in functions: lower case, sharp s and final sigma replaced; texts that hold any other letter of _folds() go letter by letter."""
    low = F.replace(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), F.lit("ς"), F.lit("σ"))
    rest = {c: to for c, to in _folds().items() if c not in "ßς"}
    table = F.str_to_map(F.lit("\x01".join(f"{c}\x02{to}" for c, to in rest.items())), F.lit("\x01"), F.lit("\x02"))
    each = F.array_join(F.transform(F.split(low, ""), lambda c: F.coalesce(F.try_element_at(table, c), c)), "")
    plain = F.char_length(F.translate(low, "".join(rest), "")) == F.char_length(low)  # looks each letter up; a pattern of as many letters would try them in turn
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).when(plain, low).otherwise(each)


def fold_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " "))


def normalize_text(text: Column) -> Column:
    """Null as empty, white space to single blanks, stripped, casefolded."""
    return casefold(fold_space(text))


def fingerprint(topic: Column, title: Column, latex: Column, plain: Column) -> Column:
    """SHA-256 over the four normalised parts of a statement."""
    return F.sha2(F.concat_ws(UNIT, *[normalize_text(x) for x in (topic, title, latex, plain)]), 256)


def stable_id(prefix: str, digest: Column, length: int = 20) -> Column:
    """A prefix and the first hexadecimal digits of a digest."""
    return F.concat(F.lit(prefix), F.substring(digest, 1, length))


def item_id(source_item_id: Column) -> Column:
    return stable_id("stmt_0809_", F.sha2(source_item_id, 256))


def container_id(parent: Column, title_key: Column) -> Column:
    return F.concat(parent, F.lit(".WEB"), F.upper(F.substring(F.sha2(F.concat(parent, F.lit("\n"), title_key), 256), 1, 12)))


def non_empty(text: Column) -> Column:
    """Null for an empty text."""
    return F.when(text != "", text)


def first_non_empty(*texts: Column, default: str | None = None) -> Column:
    """The first text that is neither null nor empty."""
    return F.coalesce(*[non_empty(t) for t in texts], F.lit(default))


def id_prefixes(topic: Column) -> Column:
    """A dotted id's chain of prefixes, from the first segment to itself."""
    return F.transform(F.sequence(F.lit(1), F.size(F.split(topic, "[.]"))), lambda i: F.array_join(F.slice(F.split(topic, "[.]"), 1, i), "."))


def chapter_slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def clean_values(values: Column) -> Column:
    """An array without null and blank elements."""
    return F.filter(values, lambda x: x.isNotNull() & (F.trim(x) != ""))


def in_subtree(number: Column, root: Column | str) -> Column:
    """Whether a dotted id is the root or below it, by whole segments."""
    root = F.lit(root) if isinstance(root, str) else root
    return (number == root) | F.startswith(number, F.concat(root, F.lit(".")))
