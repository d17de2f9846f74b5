"""Quality rules: a threshold table compiled into projections of built-in functions.

Everything is local to a row: no shuffle, no function in Python. The only super-linear step is
sorting the 3-word windows of one text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.llm.common import SPACES, free_name, words_of

# Frequent function words of the four languages of the corpus.
STOP_WORDS = (
    "a an and are as at be by for from has he in is it of on or that the this to was were with you "
    "der die das und in zu den von mit ist sich des auf für im nicht ein eine dem es auch "
    "de la le et les des en un une que du dans est pour qui sur pas au avec ce il "
    "el los las y del se por con no su para es al lo como una"
).split()

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


@dataclass(frozen=True)
class Rule:
    """``metric`` (SQL over the measures) must lie in [low, high]; a missing end is open."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None

    def holds(self) -> Column:
        value, held = F.expr(self.metric), F.lit(True)
        if self.low is not None:
            held = held & (value >= self.low)
        if self.high is not None:
            held = held & (value <= self.high)
        return held


# Metrics see n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_stops, n_ellipsis and
# n_shouts. All ratios are of texts that passed the length rule, so no divisor is zero.
DEFAULT_RULES = (
    Rule("mean_word_length", "word_chars / n_words", 2, 15),
    Rule("symbols_per_word", "n_symbols / n_words", high=0.1),
    Rule("distinct_stop_words", "n_stops", low=2),
    Rule("duplicate_lines", "n_dup_lines / n_lines", high=0.3),
    Rule("ellipsis_lines", "n_ellipsis / n_lines", high=0.3),
    Rule("shouted_words", "n_shouts / n_words", high=0.3),
)


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the counts that the rules use, as long columns.

    Null and empty texts have no words, lines or symbols. A line counts if it holds a word.
    ``n_repeat_words`` counts words inside 3-word windows that occur twice or more in the text.
    Windows are told apart by 64-bit hashes within one text.
    Columns of the same names are replaced; all other columns stay.
    """
    words, windows, ranked, lines = (free_name(docs, n) for n in ("_words", "_windows", "_ranked", "_lines"))
    t = F.coalesce(F.col(text), F.lit(""))
    w, g, s, ln = F.col(words), F.col(windows), F.col(ranked), F.col(lines)
    hashes = F.when(
        F.size(w) >= 3,
        F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))),
    ).otherwise(F.array().cast("array<bigint>"))
    # Most texts have no repeated window and need no sort.
    repeated = F.size(F.array_distinct(g)) < F.size(g)
    sorted_windows = F.when(repeated, F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    again = F.filter(s, lambda x, j: (x["h"] == F.get(s, j - 1)["h"]) | (x["h"] == F.get(s, j + 1)["h"]))
    covered = F.array_distinct(F.flatten(F.transform(again, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))))
    stops = F.array(*[F.lit(x) for x in sorted(set(STOP_WORDS))])
    out = (
        docs.withColumn(words, words_of(F.col(text)))
        .withColumn(windows, hashes)
        .withColumn(ranked, sorted_windows)
        .withColumn(lines, F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    )
    counts = {
        "n_words": F.size(w),
        "word_chars": F.length(F.regexp_replace(t, SPACES, "")),
        "n_symbols": F.regexp_count(t, F.lit(r"[#*$%&|<>]")),
        "n_dup_lines": F.size(ln) - F.size(F.array_distinct(ln)),
        "n_repeat_words": F.coalesce(F.when(s.isNotNull(), F.size(covered)), F.lit(0)),
        "n_lines": F.size(ln),
        "n_stops": F.size(F.array_intersect(F.transform(w, lambda x: F.lower(x)), stops)),
        "n_ellipsis": F.size(F.filter(ln, lambda x: x.rlike("(\\.\\.\\.|…)[\\x20\\x09-\\x0D]*$"))),
        "n_shouts": F.size(F.filter(w, lambda x: (F.upper(x) == x) & (F.lower(x) != x) & (F.length(x) > 1))),
    }
    kept = [c for c in docs.columns if c.lower() not in counts]
    return out.select(*kept, *[v.cast("long").alias(k) for k, v in counts.items()])


def judge(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = DEFAULT_RULES) -> DataFrame:
    """``docs`` with the measures, ``base_failed``, ``failed`` (names of broken rules) and ``kept``.

    ``base_failed``: under 50 words, or more than half of the words repeat. Such rows are not kept and
    name no further rules. Null and empty texts fail the base. Repeated rows are judged alike.
    """
    measured = measures(docs, text)
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    broken = F.array_compact(F.array(*[F.when(~r.holds(), F.lit(r.name)) for r in rules])) if rules else F.array().cast("array<string>")
    plain = measured.select(*[c for c in measured.columns if c.lower() not in ("base_failed", "failed", "kept")])
    return (
        plain.withColumn("base_failed", base)
        .withColumn("failed", F.when(~F.col("base_failed"), broken).otherwise(F.array().cast("array<string>")))
        .withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))
    )
