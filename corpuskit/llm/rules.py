"""Quality rules: a threshold table compiled into one projection.

``RULES`` names a measure and the range in which it passes.  ``quality_rules``
turns the table into plain columns of one ``select``: no user function, no
shuffle, nothing carried from one row to another.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskit.llm.exprs import SPACE, let, words

WINDOW = 5
SYMBOLS = r"[#*$%&|<>]"

# Frequent words of the four languages, as written in lower case.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with",
    "auf", "das", "dem", "den", "der", "des", "die", "ein", "eine", "für", "im", "ist", "mit", "nicht", "sich", "und", "von", "zu",
    "au", "aux", "dans", "de", "du", "en", "est", "et", "la", "le", "les", "par", "pas", "pour", "que", "qui", "sur", "un", "une",
    "al", "como", "con", "del", "el", "las", "los", "más", "no", "para", "por", "se", "su", "una", "y",
)


@dataclass(frozen=True)
class Rule:
    """A measure passes from ``low`` to ``high``, both included; ``None`` is no bound."""

    measure: str
    low: float | None = None
    high: float | None = None


RULES = (
    Rule("mean_word_length", 2.0, 15.0),
    Rule("symbol_ratio", None, 0.1),
    Rule("shout_ratio", None, 0.3),
    Rule("stop_word_ratio", 0.02, None),
    Rule("dup_line_ratio", None, 0.5),
    Rule("bullet_line_ratio", None, 0.9),
    Rule("ellipsis_line_ratio", None, 0.3),
)


def _repeated(w: Column) -> Column:
    """Words covered by 5-word windows that occur twice or more in the row."""
    places = F.sequence(F.lit(1), F.size(w) - (WINDOW - 1))
    hashes = F.transform(places, lambda i: F.xxhash64(F.slice(w, i, WINDOW)))

    def covered(s: Column) -> Column:
        same = lambda j, k: (s[j - 1]["h"] == s[k - 1]["h"]) & (s[j - 1]["g"] == s[k - 1]["g"])
        n = F.size(s)
        twice = F.filter(F.sequence(F.lit(1), n), lambda j: ((j > 1) & same(j, F.greatest(j - 1, F.lit(1)))) | ((j < n) & same(j, F.least(j + 1, n))))
        at = F.sort_array(F.transform(twice, lambda j: s[j - 1]["i"]))
        start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        step = lambda acc, i: F.struct((i + WINDOW).alias("end"), (acc["n"] + i + WINDOW - F.greatest(i, acc["end"])).alias("n"))
        return F.aggregate(at, start, step, lambda acc: acc["n"])

    def windows(h: Column) -> Column:
        # 96 bits name a window; the order of the places breaks ties.
        keyed = F.transform(places, lambda i: F.struct(h[i - 1].alias("h"), F.hash(F.slice(w, i, WINDOW)).alias("g"), i.alias("i")))
        return F.when(F.size(F.array_distinct(h)) < F.size(h), let(F.sort_array(keyed), covered)).otherwise(0)

    return F.when(F.size(w) >= WINDOW, let(hashes, windows)).otherwise(0)


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def _measures(text: Column, w: Column, lines: Column) -> dict[str, Column]:
    """Measures by name; a ratio with nothing below the line is 0."""
    shown = sorted({form for s in STOP_WORDS for form in (s, s.capitalize())})
    n = F.col("n_words")
    return {
        "mean_word_length": _share(F.col("word_chars"), n),
        "symbol_ratio": _share(F.col("n_symbols"), n),
        "shout_ratio": _share(F.length(text) - F.length(F.translate(text, "!", "")), n),
        # One is added so that a text too short to show any is not condemned.
        "stop_word_ratio": _share(F.size(F.filter(w, lambda x: x.isin(shown))) + 1, n),
        "dup_line_ratio": _share(F.col("n_dup_lines"), F.size(lines)),
        "bullet_line_ratio": _share(F.size(F.filter(lines, lambda x: x.rlike(r"^[\x20\x09-\x0D]*[-*•]"))), F.size(lines)),
        "ellipsis_line_ratio": _share(F.size(F.filter(lines, lambda x: x.rlike(r"(?:\.\.\.|…)[\x20\x09-\x0D]*$"))), F.size(lines)),
    }


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """``docs`` with counts, ratios, ``failed_rules`` and the verdict.

    Every input column stays; a column that has the name of an added one is
    replaced.  Added: ``n_words word_chars n_symbols n_dup_lines
    n_repeat_words`` (long), one double per measure, ``base_failed``,
    ``failed_rules`` (names in table order) and ``kept``.  A NULL text counts as
    empty: no words, so the base rule fails.  Rows are judged one by one:
    repeated rows get the same verdict, an empty table gives an empty table.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "failed_rules", "kept", "__w", "__l"]
    stay = [c for c in docs.columns if c not in {*added, *(r.measure for r in rules)}]
    split = docs.withColumns({"__w": words(text), "__l": F.filter(F.split(text, "\n"), lambda x: F.length(F.regexp_replace(x, SPACE, "")) > 0)})
    w, lines = F.col("__w"), F.col("__l")
    counted = split.withColumns({
        "n_words": F.size(w).cast("long"),
        "word_chars": F.length(F.array_join(w, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": _repeated(w).cast("long"),
    })
    known = _measures(text, w, lines)
    measured = counted.withColumns({r.measure: known[r.measure] for r in rules})
    passes = lambda r: (F.lit(True) if r.low is None else F.col(r.measure) >= r.low) & (F.lit(True) if r.high is None else F.col(r.measure) <= r.high)
    failed = F.filter(F.array(*[F.when(~passes(r), F.lit(r.measure)) for r in rules]), lambda x: x.isNotNull())
    judged = measured.withColumns({
        "base_failed": (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")),
        "failed_rules": failed,
    })
    # A filter on the verdict must not be pushed below it, where it would compute all measures again.
    once = F.monotonically_increasing_id() >= 0
    judged = judged.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0) & once)
    return judged.select(*stay, *added[:5], *[r.measure for r in rules], *added[5:8])


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that pass, with their columns as they were."""
    judged = quality_rules(docs.select(F.struct(*docs.columns).alias("__row"), F.col("text")), rules)
    return judged.where("kept").select("__row.*")


#: Twin of the query over ``documents``; built from the same table of rules.
SQL = rf"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS t FROM documents
), parts AS (
  SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM base
), grams AS (
  SELECT doc_id, i, array_to_string(w[i:i+4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM parts WHERE len(w) >= 5)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM grams) WHERE c > 1
), repeats AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(0, 5) r(k) GROUP BY doc_id
), counts AS (
  SELECT p.doc_id, t, w, l, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
  FROM parts p LEFT JOIN repeats r ON p.doc_id = r.doc_id
), ratios AS (
  SELECT *,
    CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0.0 END AS mean_word_length,
    CASE WHEN n_words > 0 THEN n_symbols / n_words ELSE 0.0 END AS symbol_ratio,
    CASE WHEN n_words > 0 THEN (length(t) - length(replace(t, '!', ''))) / n_words ELSE 0.0 END AS shout_ratio,
    CASE WHEN n_words > 0 THEN (1 + len(list_filter(w, lambda x: x IN ({", ".join(f"'{f}'" for s in STOP_WORDS for f in sorted({s, s.capitalize()}))})))) / n_words ELSE 0.0 END AS stop_word_ratio,
    CASE WHEN len(l) > 0 THEN n_dup_lines / len(l) ELSE 0.0 END AS dup_line_ratio,
    CASE WHEN len(l) > 0 THEN len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]'))) / len(l) ELSE 0.0 END AS bullet_line_ratio,
    CASE WHEN len(l) > 0 THEN len(list_filter(l, lambda x: regexp_matches(x, '(?:\.\.\.|…)[\x20\x09-\x0D]*$'))) / len(l) ELSE 0.0 END AS ellipsis_line_ratio,
    n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed
  FROM counts
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND {" AND ".join(c for r in RULES for c in ([f"{r.measure} >= {r.low}"] * (r.low is not None) + [f"{r.measure} <= {r.high}"] * (r.high is not None)))} AS kept
FROM ratios
"""
