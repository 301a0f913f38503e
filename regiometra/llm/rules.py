"""Quality rules as a short-circuit cascade, in DataFrame and SQL functions only.

Every rule rejects a document by a condition on its text. The verdict is that no rule rejects, so the order of
the rules never changes a result, only its price: ``CASE`` stops at the first rule that rejects. Cost and
rejection rate of each rule are measured on a sample and the rules run by rejections per second, highest first.

Null texts count as empty. A text without a word has zero in every count. The measures read whole texts.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regiometra.session import stage

#: Bytes between words, as a character class and as the characters themselves.
SPACE_CLASS = r"[\x20\x09-\x0D]"
SPACES = " \t\n\x0b\f\r"
#: Expected number of rows on which costs and rejection rates are measured.
SAMPLE_ROWS = 2_000

_TEXT, _WORDS = "__rule_text", "__rule_words"
_OWN = (_TEXT, _WORDS)


def _let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, which is evaluated once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _repeat_words() -> str:
    """Words in windows of three that occur at least twice; sorting is skipped where all windows differ."""
    windows = ("transform(slice(v, 1, greatest(size(v) - 2, 0)), (w, i) -> "
               "concat_ws(' ', w, get(v, i + 1), get(v, i + 2)))")
    positions = ("sort_array(array_compact(transform(s, (x, i) -> if(x.t = get(s, i - 1).t OR x.t = get(s, i + 1).t, "
                 "x.p, NULL))))")
    covered = (f"aggregate({positions}, named_struct('n', 0L, 'last', -3), (a, p) -> "
               "named_struct('n', a.n + least(3, p - a.last), 'last', p), a -> a.n)")
    found = _let("sort_array(transform(t, (x, i) -> named_struct('t', x, 'p', i)))", "s", covered)
    # The words are bound as well: a filter may be moved below the split, which must not run once per window.
    return _let(_WORDS, "v", _let(windows, "t", f"if(size(array_distinct(t)) = size(t), 0L, {found})"))


#: Measures as SQL over the prepared text and words, each 64-bit.
MEASURES = {
    "n_words": f"CAST(size({_WORDS}) AS BIGINT)",
    "word_chars": f"CAST(length(array_join({_WORDS}, '')) AS BIGINT)",
    "n_symbols": f"CAST(length({_TEXT}) - length(regexp_replace({_TEXT}, '[#*$%&|<>]', '')) AS BIGINT)",
    "n_capitals": f"CAST(length({_TEXT}) - length(regexp_replace({_TEXT}, '[A-Z]', '')) AS BIGINT)",
    "n_lines": f"CAST(size(filter(split({_TEXT}, '\n'), l -> btrim(l, '{SPACES}') <> '')) AS BIGINT)",
    "n_dup_lines": _let(f"filter(split({_TEXT}, '\n'), l -> btrim(l, '{SPACES}') <> '')", "ls",
                        "CAST(size(ls) - size(array_distinct(ls)) AS BIGINT)"),
    "n_repeat_words": _repeat_words(),
}


@dataclass(frozen=True)
class Rule:
    """A name and the SQL condition, over names of ``MEASURES``, under which a document is rejected."""

    name: str
    rejects: str


BASE_RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_words", "100 * n_repeat_words > 50 * n_words"),
)
RULES = (
    *BASE_RULES,
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("short_words", "word_chars < 3 * n_words"),
    Rule("long_words", "word_chars > 10 * n_words"),
    Rule("capitals", "10 * n_capitals > 3 * word_chars"),
    Rule("repeated_lines", "2 * n_dup_lines > n_lines"),
)


def _written_out(condition: str) -> str:
    """The condition with every measure replaced by its expression, so that it is evaluated only when reached."""
    for name in sorted(MEASURES, key=len, reverse=True):
        condition = condition.replace(name, f"@{list(MEASURES).index(name)}@")
    for i, expression in enumerate(MEASURES.values()):
        condition = condition.replace(f"@{i}@", f"({expression})")
    return condition


def prepare(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the text without null and its words, for :data:`MEASURES`."""
    whole = docs.withColumn(_TEXT, F.coalesce(F.col(f"`{text}`"), F.lit("")))
    trimmed = F.btrim(_TEXT, F.lit(SPACES))
    return whole.withColumn(_WORDS, F.when(trimmed == "", F.array().cast("array<string>"))
                            .otherwise(F.split(trimmed, f"{SPACE_CLASS}+")))


def measure(docs: DataFrame, *names: str, text: str = "text") -> DataFrame:
    """Adds the named measures (all of them by default), in place of columns of the same name."""
    wanted = names or tuple(MEASURES)
    return prepare(docs, text).withColumns({n: F.expr(MEASURES[n]) for n in wanted}).drop(*_OWN)


def order_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text",
                sample_rows: int = SAMPLE_ROWS, seed: int = 7) -> list[Rule]:
    """Rules by rejections per second on a sample, highest first.

    The sample only decides the order. Times vary between runs and so may the order; verdicts do not. An empty
    table leaves the order as given.
    """
    rows = docs.count()
    if not rows or len(rules) < 2:
        return list(rules)
    sample = stage(docs.select(F.col(f"`{text}`").alias("text")).sample(min(1.0, sample_rows / rows), seed), "rule-sample")
    prepared = prepare(sample)

    def run(condition: str) -> tuple[int, float]:
        start = time.perf_counter()
        rejected = prepared.agg(F.count_if(F.expr(condition))).first()[0]
        return rejected, time.perf_counter() - start

    run(f"size({_WORDS}) < 0")
    _, fixed = run(f"size({_WORDS}) < 0")
    rate = {}
    for rule in rules:
        rejected, seconds = run(_written_out(rule.rejects))
        rate[rule] = rejected / max(seconds - fixed, 1e-3)
    return sorted(rules, key=lambda rule: -rate[rule])


def passes(rules: list[Rule]) -> Column:
    """True where no rule rejects, evaluated in the given order up to the first that does."""
    return F.expr("CASE " + " ".join(f"WHEN {_written_out(r.rejects)} THEN false" for r in rules) + " ELSE true END"
                  if rules else "true")


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", verdict: str = "kept",
          sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Adds the verdict of the cascade to every document; other columns stay as they are."""
    ordered = order_rules(docs, rules, text, sample_rows)
    return prepare(docs, text).withColumn(verdict, passes(ordered)).drop(*_OWN)


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The documents that no rule rejects, with their own columns."""
    return judge(docs, rules, text, "__kept").where("__kept").select(*[F.col(f"`{c}`") for c in docs.columns])
