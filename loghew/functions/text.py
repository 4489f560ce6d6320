"""Column expressions on log text: tokens, similarities, word classes. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters that Unicode counts as white space, beyond Java's \\s.
WHITE = r"[\s\x1c-\x1f\x85\xa0  -     　]+"
#: The signs that make a word variable when it holds only signs and digits (no quotes, no backtick).
SIGNS = r"!#$%&()*+,\-./:;<=>?@\[\\\]^_{|}~"
STAR = "*"


def c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def tokens(raw: Column | str) -> Column:
    return F.filter(F.split(c(raw), WHITE), lambda t: t != "")


def message_length(message: Column | str) -> Column:
    """Parts between single spaces; the empty message has one."""
    return F.size(F.split(c(message), " "))


def weighted_hamming(a: Column, b: Column) -> Column:
    """Share of agreeing places, the first weighing n and the last 1, over a's n tokens; half-even to three digits."""
    n = F.size(a)
    hits = F.zip_with(F.slice(a, 1, F.least(n, F.size(b))), F.slice(b, 1, F.least(n, F.size(b))), lambda x, y: x == y)
    score = F.aggregate(F.transform(hits, lambda h, i: F.when(h, n - i).otherwise(0)), F.lit(0), lambda s, x: s + x)
    return F.when(n > 0, F.bround(score * F.lit(1.0) / (n * (n + 1) / 2), 3)).otherwise(F.lit(0.0))


def generalize(word: Column) -> Column:
    """'*' for a word with one letter or one digit, of digits alone, or of digits and signs; else the word."""
    letters = F.length(F.regexp_replace(word, r"[^\p{L}]", ""))
    digits = F.length(F.regexp_replace(word, r"[^\p{Nd}]", ""))
    return F.when((letters == 1) | (digits == 1) | word.rlike(rf"^[\p{{Nd}}{SIGNS}]*$"), STAR).otherwise(word)


def stars(template: Column) -> Column:
    return F.size(F.filter(template, lambda t: t == STAR))


def all_stars(template: Column) -> Column:
    return template.rlike(r"^[* ]*[*][* ]*$")


def over_abstracted(template: Column) -> Column:
    """All but one of more than three tokens are stars."""
    return (stars(template) == F.size(template) - 1) & (F.size(template) > 3)


def mergeable(parent: Column, child: Column) -> Column:
    """Every place agrees, is a star in the parent, or is the same word class in both."""
    ok = F.forall(F.zip_with(parent, child, lambda p, q: p.eqNullSafe(q) | (p == STAR) | (generalize(p) == generalize(q))), lambda x: F.coalesce(x, F.lit(False)))
    return (F.size(parent) > 0) & (F.size(parent) == F.size(child)) & ok


def has_digit(word: Column) -> Column:
    return word.rlike(r"\p{Nd}")


def tree_similarity(template: Column, line: Column) -> tuple[Column, Column]:
    """(share of places where a non-star token agrees, number of stars)."""
    same = F.size(F.filter(F.zip_with(template, line, lambda t, x: F.coalesce((t == x) & (t != STAR), F.lit(False))), lambda x: x))
    return same / F.size(template).cast("double"), stars(template)


def pair_template(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.when(x == y, x).otherwise(F.lit(STAR)))


def message_distance(a: Column, b: Column, k: float = 1.0) -> Column:
    """1 - k * (agreeing places) / (length of the longer)."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), lambda x: x))
    return F.lit(1.0) - F.lit(k) * same / F.greatest(F.size(a), F.size(b))


def pattern_distance(a: Column, b: Column, k1: float = 1.0, k2: float = 1.0, wild: str = "<*>") -> Column:
    n = F.greatest(F.size(a), F.size(b))
    at = F.zip_with(a, b, lambda x, y: F.when(x.eqNullSafe(y), F.when(x == wild, F.lit(k2)).otherwise(F.lit(k1))).otherwise(F.lit(0.0)))
    return F.lit(1.0) - F.aggregate(at, F.lit(0.0), lambda s, x: s + x) / n


def normalized_word(word: Column) -> Column:
    """Lower case; a word of digits becomes $NUM$."""
    return F.when(word.rlike(r"^\p{Nd}+$"), F.lit("$NUM$")).otherwise(F.lower(word))


def padded(items: Column, size: Column | int, fill) -> Column:
    """items, filled up to size; longer ones stay whole."""
    return F.concat(items, F.array_repeat(F.lit(fill), F.greatest(F.lit(size) - F.size(items), F.lit(0))))


def removed_patterns(raw: Column, patterns: list[tuple[str, str]]) -> Column:
    for pattern, to in patterns:
        raw = F.regexp_replace(raw, pattern, to)
    return raw


def dropped_places(items: Column, places: list[int]) -> Column:
    return F.filter(items, lambda x, i: ~i.isin(places)) if places else items


def register(spark) -> None:
    """weighted_hamming(a, b), tree_similarity(t, line) and pair_template(a, b) on token arrays, and generalize_word(w), as SQL functions without Python."""
    signs = SIGNS.replace("\\", "\\\\")
    for name, body in {
        "generalize_word(w STRING) RETURNS STRING": rf"if(length(regexp_replace(w, '[^\\p{{L}}]', '')) = 1 or length(regexp_replace(w, '[^\\p{{Nd}}]', '')) = 1 or w rlike '^[\\p{{Nd}}{signs}]*$', '*', w)",
        "pair_template(a ARRAY<STRING>, b ARRAY<STRING>) RETURNS ARRAY<STRING>": "zip_with(a, b, (x, y) -> if(x = y, x, '*'))",
        "tree_similarity(t ARRAY<STRING>, line ARRAY<STRING>) RETURNS DOUBLE": "size(filter(zip_with(t, line, (x, y) -> coalesce(x = y and x <> '*', false)), z -> z)) / size(t)",
        "weighted_hamming(a ARRAY<STRING>, b ARRAY<STRING>) RETURNS DOUBLE": "if(size(a) = 0, 0.0D, bround(aggregate(transform(zip_with(a, b, (x, y) -> coalesce(x = y, false)), (h, i) -> if(h, size(a) - i, 0)), 0, (s, x) -> s + x) * 1.0D / (size(a) * (size(a) + 1) / 2), 3))",
    }.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name} RETURN {body}")
