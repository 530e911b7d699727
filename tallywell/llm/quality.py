"""Quality rules as a short-circuit cascade, with DataFrame functions only.

Rules are Boolean SQL expressions over the features of a text; a document is
kept if none of them holds.  On a bounded sample each rule is timed and its
rejections are counted, and the cascade evaluates the rules in the order of
rejection per cost and stops at the first that rejects; a feature is computed
when the first rule that needs it is reached.  The verdict does not depend on the
order, and so not on the sample or on the clock.

All features of a text are arrays and numbers of that row: nothing is shuffled.
"""

from __future__ import annotations

import re
import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace

#: About so many documents serve to estimate costs and selectivities.
SAMPLE_ROWS = 1000
#: Times that a rule is run on the sample.
TRIALS = 3


@dataclass(frozen=True)
class Rule:
    """Rejects a document where ``sql``, over ``FEATURES``, is true (null: false)."""

    name: str
    sql: str


BASE = (
    Rule("few_words", "n_words < 20"),
    Rule("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
)
#: The method's own rules, for documents that the base rules leave.
RULES = (
    Rule("short_words", "word_chars < 3 * n_words"),
    Rule("long_words", "word_chars > 10 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("duplicate_lines", "2 * n_dup_lines > n_lines"),
    Rule("stutter", "5 * n_stutter > n_words"),
    Rule("capitals", "5 * n_capitals > 2 * word_chars"),
)


def _let(name: str, value: str, body: str) -> str:
    """SQL for ``body`` with ``name`` bound to ``value``, which is evaluated once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _repeat_words(width: int = 8) -> str:
    """Words in windows of ``width`` words found twice or more.  A window's hash
    comes from doubling runs of words.  If all differ, as in most texts, that is
    all; else windows whose hashes repeat are compared by their words, so the
    count is exact."""
    out = f"""aggregate(sort_array(transform(same, x -> x.i)), named_struct('n', 0L, 'last', -{width}),
        (s, p) -> named_struct('n', s.n + least({width}, p - s.last), 'last', p), s -> s.n)"""
    out = _let("same", "filter(runs, (x, j) -> coalesce(get(runs, j - 1).t = x.t, false) OR coalesce(get(runs, j + 1).t = x.t, false))", out)
    out = _let("runs", f"sort_array(transform(twice, x -> named_struct('t', array_join(slice(words, x.i + 1, {width}), ' '), 'i', x.i)))", out)
    out = _let("twice", "filter(sorted, (x, j) -> coalesce(get(sorted, j - 1).h = x.h, false) OR coalesce(get(sorted, j + 1).h = x.h, false))", out)
    out = _let("sorted", "sort_array(transform(h, (x, i) -> named_struct('h', x, 'i', i)))", out)
    out = f"IF(size(array_distinct(h)) = size(h), 0L, {out})"
    steps, have = [], 1
    while have < width:
        steps.append(step := min(have, width - have))
        have += step
    for step in reversed(steps):  # a run at i and the one at i + step span both
        m = f"greatest(size(h) - {step}, 0)"
        out = _let("h", f"zip_with(slice(h, 1, {m}), slice(h, {step + 1}, {m}), (a, b) -> xxhash64(a, b))", out)
    return _let("h", "transform(words, w -> xxhash64(w))", out)


#: What rules can use besides text, each over those before it.
FEATURES = {
    "words": r"filter(split(text, r'[\x20\x09-\x0D]+'), w -> w <> '')",
    "lines": r"filter(split(text, '\n'), l -> l rlike r'[^\x20\x09-\x0D]')",
    "n_words": "CAST(size(words) AS BIGINT)",
    "n_lines": "CAST(size(lines) AS BIGINT)",
    "word_chars": "CAST(length(array_join(words, '')) AS BIGINT)",
    "n_symbols": "CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]+', '')) AS BIGINT)",
    "n_dup_lines": "CAST(size(lines) - size(array_distinct(lines)) AS BIGINT)",
    "n_repeat_words": _repeat_words(),
    "n_stutter": "aggregate(words, named_struct('n', 0L, 'w', ''), (s, w) -> named_struct('n', s.n + IF(s.w = w, 1L, 0L), 'w', w), s -> s.n)",
    "n_capitals": "CAST(length(text) - length(regexp_replace(text, '[A-Z]+', '')) AS BIGINT)",
}


def _bind(sql: str, body: str, bound: Sequence[str] = ()) -> str:
    """``body`` with the features bound that ``sql`` needs, but for those in ``bound``."""
    need, todo = set(), [sql]
    while todo:
        names = {w for w in re.findall(r"\w+", todo.pop()) if w in FEATURES} - need - set(bound)
        need |= names
        todo += [FEATURES[n] for n in names]
    for name in reversed(FEATURES):
        if name in need:
            body = _let(name, FEATURES[name], body)
    return body


def _text(text_col: str, body: str) -> str:
    return _let("text", f"coalesce(`{text_col.replace('`', '``')}`, '')", body)


def cascade_sql(rules: Sequence[Rule], text_col: str = "text") -> str:
    """SQL for the name of the first rule, in the given order, that rejects; else null."""
    have: list[list[str]] = [[]]
    for rule in rules:
        reach, todo = set(have[-1]), [rule.sql]
        while todo:
            names = {w for w in re.findall(r"\w+", todo.pop()) if w in FEATURES} - reach
            reach |= names
            todo += [FEATURES[n] for n in names]
        have.append(sorted(reach))
    out = "CAST(NULL AS STRING)"
    for rule, bound in zip(reversed(rules), reversed(have[:-1])):
        out = _bind(rule.sql, f"CASE WHEN {rule.sql} THEN '{rule.name}' ELSE {out} END", bound)
    return _text(text_col, out)


def ordered(docs: DataFrame, rules: Sequence[Rule], *, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """``rules`` by falling rejection per cost, as found on about ``sample_rows``
    documents dealt out by a hash of their ids.

    Each rule is run alone, ``TRIALS`` times in turn with the others; its cost is the least of its
    times above that of reading the sample.  With no documents the order stays as it is.
    """
    spark = docs.sparkSession
    rows = docs.count()
    if not rows or len(rules) < 2:
        return list(rules)
    work = Workspace(spark, "quality")
    share = min(1.0, sample_rows / rows)
    picked = F.pmod(F.xxhash64(id_col), F.lit(1_000_000)) < int(1_000_000 * share) + 1
    sample = docs.where(picked).select(text_col).limit(2 * sample_rows)  # one id may have any number of rows
    sample = work.save(sample.repartition(1), "sample")

    def timed(sql: str) -> tuple[float, int]:
        began = time.perf_counter()
        hits = sample.agg(F.expr(f"count_if({_text(text_col, sql)})")).first()[0]
        return time.perf_counter() - began, hits

    timed("length(text) < 0")  # compiles and reads once before anything counts
    costs, hits = [float("inf")] * len(rules), [0] * len(rules)
    empty = float("inf")
    for _ in range(TRIALS):
        empty = min(empty, timed("length(text) < 0")[0])
        for i, rule in enumerate(rules):
            seconds, hits[i] = timed(_bind(rule.sql, rule.sql))
            costs[i] = min(costs[i], seconds)
    found = [(-hits[i] / max(costs[i] - empty, 1e-3), i, rule) for i, rule in enumerate(rules)]
    work.drop("sample")
    return [rule for *_, rule in sorted(found, key=lambda x: x[:2])]


def judged(docs: DataFrame, rules: Sequence[Rule] = (*BASE, *RULES), *, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS, verdict: str = "rejected_by") -> DataFrame:
    """``docs`` with a column ``verdict``: the name of a rule that rejects the
    document (the first in the cascade's order), or null if all let it pass.

    A null text counts as empty.  Other columns are kept as they are; one of the
    name ``verdict`` is replaced.
    """
    best = ordered(docs, rules, id_col=id_col, text_col=text_col, sample_rows=sample_rows)
    return docs.withColumn(verdict, F.expr(cascade_sql(best, text_col)))


def counts_and_verdict(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The base counts of every document, base_failed, and kept: not base_failed,
    and passed by the cascade of ``RULES``.

    A null or empty text has no words, so base_failed is true.  Rows without an id
    and repeated rows are judged like any other; no rows give no rows.
    """
    best = ordered(docs, RULES, id_col=id_col, text_col=text_col, sample_rows=sample_rows)
    shown = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    failed = " OR ".join(f"({r.sql})" for r in BASE)
    bound = [*shown, "words", "lines"]
    chain = "CAST(NULL AS STRING)"
    seen = list(bound)
    plan = []
    for rule in best:
        plan.append((rule, list(seen)))
        seen += [n for n in FEATURES if re.search(rf"\b{n}\b", rule.sql) and n not in seen]
    for rule, have in reversed(plan):
        chain = _bind(rule.sql, f"CASE WHEN {rule.sql} THEN '{rule.name}' ELSE {chain} END", have)
    fields = ", ".join(f"'{n}', {n}" for n in shown)
    body = _let("failed", failed, f"named_struct({fields}, 'base_failed', failed, 'kept', NOT failed AND ({chain}) IS NULL)")
    sql = _text(text_col, _bind(" ".join(bound), body))
    return docs.select(F.col(id_col), F.expr(sql).alias("_f")).select(id_col, "_f.*")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts of all documents."""
    return counts_and_verdict(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: The same in DuckDB.  Its lists are 1-based.
OP4_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
k AS (SELECT row_number() OVER () AS k, * FROM w),
p AS (SELECT k, unnest(range(1, len(w) - 6)) AS i, w FROM k WHERE len(w) >= 8),
g AS (SELECT k, i, count(*) OVER (PARTITION BY k, list_slice(w, i, i + 7)) AS c FROM p),
s AS (SELECT k, i, lag(i) OVER (PARTITION BY k ORDER BY i) AS before FROM g WHERE c > 1),
r AS (SELECT k, sum(least(8, i - coalesce(before, i - 8))) AS n FROM s GROUP BY k),
f AS (SELECT doc_id, t, w, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
        CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, len(l) AS n_lines,
        length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_capitals,
        len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS n_stutter
      FROM k LEFT JOIN r USING (k)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (word_chars < 3 * n_words OR word_chars > 10 * n_words OR 10 * n_symbols > n_words
    OR 2 * n_dup_lines > n_lines OR 5 * n_stutter > n_words OR 5 * n_capitals > 2 * word_chars) AS kept
FROM b
"""
