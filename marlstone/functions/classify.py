"""Rule-driven classification of short texts; the rules are the caller's."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Word edges that Java and RE2 agree on, whatever the script.
_BEFORE, _AFTER = r"(^|[^\p{L}\p{N}_])", r"($|[^\p{L}\p{N}_])"


def first_match(text: Column, rules: list[tuple[str, str]]) -> Column:
    """Name of the first rule whose pattern matches whole words of the lower-cased text; null if none does, or text is null."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(rules):
        out = F.when(F.lower(text).rlike(f"{_BEFORE}({pattern}){_AFTER}"), F.lit(name)).otherwise(out)
    return out


def word_count(text: Column) -> Column:
    """Runs of anything but white space; 0 for null and blank texts."""
    return F.coalesce(F.size(F.filter(F.split(text, r"\s+"), lambda x: x != "")), F.lit(0))


def tier(text: Column, cached: Column, rules: list[tuple[str, str]], long_words: int) -> Column:
    """(tier, reason): cache hits are tier 0, matches of a rule named `tier:reason` that tier, long texts 2, others 1."""
    rule = first_match(text, rules)
    number = F.when(cached, 0).when(rule.isNotNull(), F.split_part(rule, F.lit(":"), F.lit(1)).cast("int")).when(word_count(text) > long_words, 2).otherwise(1)
    reason = F.when(cached, "cache_hit").when(rule.isNotNull(), F.split_part(rule, F.lit(":"), F.lit(2))).when(word_count(text) > long_words, "long").otherwise("default")
    return F.struct(number.alias("tier"), reason.alias("reason"))
