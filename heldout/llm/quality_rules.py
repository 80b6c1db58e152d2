"""Quality rules as a short-circuit cascade of native expressions."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heldout.functions.materialize import materialize
from heldout.llm.text import plain

SAMPLE_ROWS = 1_000  # rows on which cost and selectivity of the rules are measured, about
WINDOW_HASH = "xxhash64(get(_words, i), get(_words, i + 1), get(_words, i + 2))"  # brings windows together; words decide
_BLANK = "' \\t\\n\\u000B\\u000C\\r'"

#: Rules beyond the base: a name and the SQL condition that rejects. They may use the base columns, _text, _words and _lines.
RULES = {
    "symbols": "10 * n_symbols > n_words",
    "word_length": "word_chars < 2 * n_words OR word_chars > 15 * n_words",
    "repeated_lines": "10 * n_dup_lines > 3 * size(_lines)",
    "capitals": "2 * (size(split(_text, '[A-Z]')) - 1) > word_chars",
    "exclamations": "size(split(_text, '!')) - 1 > n_words",
    "few_words": "50 * size(array_distinct(_words)) < n_words",
    "digits": "2 * (size(split(_text, '[0-9]')) - 1) > word_chars",
}


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` with _text, _words, _lines and the base columns, all computed by built-in functions.

    A 3-word window is hashed to the high bits of a number whose low bits are
    its position, so one sort of primitive numbers brings equal windows together.
    Windows that share these bits are sorted once more by their words, so the
    count is exact for texts of any length.
    """
    step = docs.selectExpr("*", "coalesce(text, '') AS _text").selectExpr("*", f"btrim(_text, {_BLANK}) AS _trim")
    step = step.selectExpr(
        "*", _once("if(_trim = '', cast(array() AS array<string>), split(_trim, '[\\\\x20\\\\x09-\\\\x0D]+'))", "_words"),
        _once(f"filter(split(_text, '\\n'), x -> btrim(x, {_BLANK}) <> '')", "_lines"),
    )
    step = step.selectExpr(
        "*", _once("cast(size(_words) AS bigint)", "n_words"), _once("cast(length(array_join(_words, '')) AS bigint)", "word_chars"),
        _once("cast(size(split(_text, '[#*$%&|<>]')) - 1 AS bigint)", "n_symbols"),
        _once("cast(size(_lines) - size(array_distinct(_lines)) AS bigint)", "n_dup_lines"),
        _once("cast(ceil(log2(greatest(size(_words), 2))) AS int)", "_bits"),
    )
    step = step.selectExpr("*", _once(
        "if(n_words < 3, cast(array() AS array<bigint>), sort_array(transform(sequence(0, greatest(cast(n_words AS int) - 3, 0)), "
        f"i -> shiftleft({WINDOW_HASH}, _bits) | i)))", "_windows",
    ))
    step = step.selectExpr("*", _once(
        "transform(filter(_windows, (x, k) -> shiftright(x, _bits) = shiftright(get(_windows, k + 1), _bits) "
        "OR shiftright(x, _bits) = shiftright(get(_windows, k - 1), _bits)), x -> x & (shiftleft(1L, _bits) - 1))", "_maybe",
    ))
    step = step.selectExpr("*", _once(
        "sort_array(transform(_maybe, p -> struct(get(_words, cast(p AS int)) AS a, get(_words, cast(p AS int) + 1) AS b, get(_words, cast(p AS int) + 2) AS c, p)))",
        "_alike",
    ))
    step = step.selectExpr("*", _once(
        f"sort_array(transform(filter(_alike, (x, k) -> {_same('k + 1')} OR {_same('k - 1')}), x -> x.p))", "_starts"
    ))
    step = step.selectExpr("*", _once(
        "aggregate(transform(_starts, (x, k) -> if(k = 0, 3L, least(3L, x - get(_starts, k - 1)))), 0L, (a, x) -> a + x)", "n_repeat_words"
    ))
    return step.drop("_trim", "_bits", "_windows", "_maybe", "_alike", "_starts")


def _same(at: str) -> str:
    """Whether window ``x`` has the words of the window at place ``at`` of the sorted ones."""
    return "(" + " AND ".join(f"x.{w} = get(_alike, {at}).{w}" for w in "abc") + ")"


def _once(expression: str, name: str) -> str:
    """The expression under a condition that always holds but isn't deterministic.

    So the optimizer neither copies it into later expressions, where it would
    run for each element of an array, nor moves filters below it.
    """
    return f"if(monotonically_increasing_id() >= 0, {expression}, null) AS {name}"


BASE_FAILED = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"


def order_rules(docs: DataFrame, rules: dict[str, str] = RULES, rows: int = SAMPLE_ROWS) -> list[str]:
    """Rule names by rejections per second on a sample of about ``rows`` rows.

    Only the order depends on the measurement; which documents stay does not.
    """
    total = docs.count()
    if not total:
        return list(rules)
    part = docs.sample(False, min(1.0, rows / total), 17) if total > rows else docs
    sample = materialize(measured(plain(part, "text")).drop("text").filter(f"NOT ({BASE_FAILED})"))

    def run(condition: Column) -> tuple[float, int]:
        began = time.perf_counter()
        hits = sample.agg(F.count_if(condition)).head()[0]
        return time.perf_counter() - began, hits

    # the rule that must always be answered first: how long a scan takes by itself
    columns = F.size("_words") + F.size("_lines") + F.length("_text") < 0
    idle = min(run(columns)[0] for _ in range(2))
    gain = {}
    for name, condition in rules.items():
        (a, hits), (b, _) = run(F.expr(condition)), run(F.expr(condition))
        gain[name] = (hits + 0.5) / max(min(a, b) - idle, 1e-3)
    return sorted(rules, key=lambda r: -gain[r])


def cascade(order: list[str], rules: dict[str, str] = RULES) -> Column:
    """True where no rule rejects; a rule is only evaluated where all before it passed."""
    verdict = F.when(F.expr(BASE_FAILED), False)
    for name in order:
        verdict = verdict.when(F.expr(rules[name]), False)
    return verdict.otherwise(True)


def judge(docs: DataFrame, rules: dict[str, str] = RULES, rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, the counts of the text, base_failed and kept for every row of ``docs``.

    Null text has no words and so fails the base.  Rows with a null or repeated
    doc_id are judged one by one, extra columns are ignored, and an empty table
    gives no row.
    """
    order = order_rules(docs, rules, rows)
    return measured(plain(docs, "doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        F.expr(BASE_FAILED).alias("base_failed"), cascade(order, rules).alias("kept"),
    )


def accepted(docs: DataFrame, rules: dict[str, str] = RULES, rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs``, all columns, that pass the base and every rule."""
    order = order_rules(docs, rules, rows)
    whole = measured(docs.select("text", F.struct("*").alias("_whole")))
    return whole.filter(cascade(order, rules)).select("_whole.*")
