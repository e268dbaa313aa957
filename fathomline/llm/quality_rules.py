"""Quality rules: a table of thresholds compiled into one projection of JVM expressions.

A row of ``RULES`` bounds one count, alone or in percent of another, by whole numbers. ``compiled`` turns the table into the
list of the rules that a row breaks, so a changed table is a changed projection and nothing else. All counts are made
from the whole text by array functions inside the scan's own stage: no shuffle, no function of the user's.

Edge cases. A null text has no words, characters, symbols or lines. Text without words: all counts 0, ``base_failed``. A null or
repeated id is kept as it is: every row is judged on its own. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Rule(NamedTuple):
    """``column`` (in percent of ``per``, if given) must lie between ``low`` and ``high``; None is no bound."""

    name: str
    column: str
    per: str | None
    low: int | None
    high: int | None
    is_base: bool = False


#: Common words of English, French, German and Spanish prose, as they stand in running text.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "is", "that", "be", "with", "it", "for", "on", "as", "are", "this", "by",
    "le", "la", "de", "les", "un", "une", "des", "qui", "que", "et", "du", "au", "pour", "par", "sur", "dans",
    "der", "die", "das", "und", "ein", "ist", "nicht", "von", "zu", "den", "mit", "auf", "im", "eine",
    "el", "los", "las", "del", "con", "una", "por", "para", "se", "es", "en", "y",
)

RULES = (
    Rule("words", "n_words", None, 50, None, True),
    Rule("repeated_words", "n_repeat_words", "n_words", None, 50, True),
    Rule("word_length", "word_chars", "n_words", 250, 1000),
    Rule("symbols", "n_symbols", "n_words", None, 10),
    Rule("stop_words", "n_stop_words", "n_words", 2, None),
    Rule("repeated_lines", "n_dup_lines", "n_lines", None, 50),
    Rule("cut_lines", "n_cut_lines", "n_lines", None, 30),
)

SPACE = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 3


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _covered(starts: Column) -> Column:
    """Positions that windows at these ascending starts cover."""
    return F.aggregate(
        F.transform(starts, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, k + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x
    )


def _repeats(ordered: Column) -> Column:
    """Starts of the windows of (window, start), in order, that equal a neighbour; ascending."""
    same = lambda x, k: F.coalesce(F.get(ordered, k)["w"] == x["w"], F.lit(False))
    return F.sort_array(F.array_compact(F.transform(ordered, lambda x, k: F.when(same(x, k - 1) | same(x, k + 1), x["at"]))))


def repeated_words(words: Column) -> Column:
    """Words that lie in a window of three words which stands twice or more among ``words``."""

    def of(w: Column) -> Column:
        made = F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.concat_ws(" ", *(F.get(w, i + d) for d in range(WINDOW))))

        def count(windows: Column) -> Column:
            placed = F.transform(windows, lambda x, k: F.struct(x.alias("w"), k.alias("at")))
            full = let(F.sort_array(placed), lambda s: let(_repeats(s), _covered))
            # most short texts repeat nothing, which hashing tells without a sort
            return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(full)

        return F.when(F.size(w) <= WINDOW, F.lit(0)).otherwise(let(made, count))

    return let(words, of)


def compiled(rules: tuple[Rule, ...], base: bool | None = None) -> Column:
    """Names of the broken rules, comma-separated in the table's order; ``base`` picks the base rules or the others."""
    broken = []
    for r in rules:
        if base is not None and r.is_base != base:
            continue
        value = F.col(r.column) if r.per is None else F.col(r.column) * F.lit(100)
        unit = F.lit(1) if r.per is None else F.col(r.per)
        bad = F.lit(False)
        if r.low is not None:
            bad = bad | (value < F.lit(r.low) * unit)
        if r.high is not None:
            bad = bad | (value > F.lit(r.high) * unit)
        broken.append(F.when(bad, F.lit(r.name)))
    return F.concat_ws(",", *broken)


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, stop_words: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """Counts of every text of (doc_id, text), ``broken`` (names of broken rules), base_failed and kept."""
    text = F.coalesce("text", F.lit(""))
    long_ = lambda c: c.cast("bigint")
    lines = F.filter(F.split(F.col("_text"), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    split = docs.select("doc_id", text.alias("_text")).select("doc_id", "_text", F.array_remove(F.split("_text", SPACE), "").alias("_words"), lines.alias("_lines"))
    counted = split.select(
        "doc_id",
        long_(F.size("_words")).alias("n_words"),
        long_(F.length(F.translate("_text", SPACES, ""))).alias("word_chars"),
        long_(F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).alias("n_symbols"),
        long_(F.size("_lines") - F.size(F.array_distinct("_lines"))).alias("n_dup_lines"),
        long_(repeated_words(F.col("_words"))).alias("n_repeat_words"),
        long_(F.size("_lines")).alias("n_lines"),
        long_(F.size(F.filter("_words", lambda w: w.isin(*stop_words)))).alias("n_stop_words"),
        long_(F.size(F.filter("_lines", lambda x: F.rtrim(x).endswith("...")))).alias("n_cut_lines"),
    )
    judged = counted.withColumns({"broken": compiled(rules), "base_failed": compiled(rules, True) != ""})
    return judged.withColumn("kept", F.col("broken") == "")


def oracle(rules: tuple[Rule, ...] = RULES, stop_words: tuple[str, ...] = STOP_WORDS) -> str:
    """DuckDB SQL of the same rows over the table ``documents``."""

    def bad(r: Rule) -> str:
        value, unit = (r.column, "1") if r.per is None else (f"100 * {r.column}", r.per)
        parts = ([f"{value} < {r.low} * {unit}"] if r.low is not None else []) + ([f"{value} > {r.high} * {unit}"] if r.high is not None else [])
        return f"case when {' or '.join(parts)} then '{r.name}' end"

    stops = ", ".join(f"'{w}'" for w in stop_words)
    return rf"""
with t as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
s as (select *, list_filter(regexp_split_to_array(text, '{SPACE}'), lambda x: x <> '') as ws,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from t),
windows as (select r, i, concat_ws(' ', ws[i], ws[i + 1], ws[i + 2]) as w from (select r, ws, unnest(range(1, len(ws) - 1)) as i from s)),
twice as (select r, i from (select r, i, count(*) over (partition by r, w) as n from windows) where n > 1),
covered as (select r, count(distinct i + d) as n from twice, (values (0), (1), (2)) v(d) group by r),
counts as (select doc_id, len(ws) as n_words, length(regexp_replace(text, '{SPACE}', '', 'g')) as word_chars,
  length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols, len(ls) - len(list_distinct(ls)) as n_dup_lines,
  coalesce(n, 0) as n_repeat_words, len(ls) as n_lines, len(list_filter(ws, lambda x: x in ({stops}))) as n_stop_words,
  len(list_filter(ls, lambda x: ends_with(rtrim(x, ' '), '...'))) as n_cut_lines from s left join covered using (r)),
judged as (select *, concat_ws(',', {', '.join(bad(r) for r in rules)}) as broken, concat_ws(',', {', '.join(bad(r) for r in rules if r.is_base)}) <> '' as base_failed from counts)
select *, broken = '' as kept from judged"""
