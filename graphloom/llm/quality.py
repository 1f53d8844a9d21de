"""Quality rules: one threshold table compiled into one projection of built-in functions.

The operator never leaves the JVM: words, symbols, repeated lines, repeated word
windows, stop words and line endings are SQL expressions over one row, so the
plan is a scan and a projection, without a shuffle.

Defined results for odd rows: a null text counts as empty, an empty text has no
words and fails; a null id stays null; repeated rows each get their own row;
columns other than the id and the text are neither read nor returned, whatever
their names; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import let, text_of

#: Characters between words, and characters counted as symbols.
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

# Frequent function words of the corpus languages (public stop-word knowledge).
STOP_WORDS = (
    "the be to of and that have with in is it for on as at by this was are from or an a "
    "de la le les et des en un une du que qui dans pour par sur au est pas avec plus "
    "der die das und ist von zu den mit nicht ein eine auf für dem des im sich "
    "el los las y se por con para una su lo es del al como o"
).split()


@dataclass(frozen=True)
class Rule:
    """Keep a text only while ``metric`` lies within [least, most]."""

    name: str
    metric: str
    least: float | None = None
    most: float | None = None

    def sql(self) -> str:
        parts = [f"{self.metric} >= {self.least}D" if self.least is not None else "", f"{self.metric} <= {self.most}D" if self.most is not None else ""]
        return "(" + " AND ".join(p for p in parts if p) + ")"


#: The threshold table. Metrics are ratios of the counts below.
RULES = (
    Rule("mean_word_chars", "mean_word_chars", 2.0, 12.0),
    Rule("symbols_per_word", "symbols_per_word", None, 0.3),
    Rule("stop_word_ratio", "stop_word_ratio", 0.02, None),
    Rule("duplicate_line_ratio", "dup_line_ratio", None, 0.5),
    Rule("alphabetic_word_ratio", "alpha_word_ratio", 0.6, None),
    Rule("ellipsis_line_ratio", "ellipsis_line_ratio", None, 0.3),
    Rule("shouted_word_ratio", "upper_word_ratio", None, 0.5),
)

#: Ratios by name, over the counts that ``counts`` makes.
RATIOS = {
    "mean_word_chars": "word_chars / n_words",
    "symbols_per_word": "n_symbols / n_words",
    "stop_word_ratio": "n_stop_words / n_words",
    "dup_line_ratio": "n_dup_lines / n_lines",
    "alpha_word_ratio": "n_alpha_words / n_words",
    "ellipsis_line_ratio": "n_ellipsis_lines / n_lines",
    "upper_word_ratio": "n_upper_words / n_words",
}


def repeated_words(words: str, window: int = 3) -> str:
    """SQL: how many words of the array lie in ``window``-word windows found twice or more."""
    gram = "concat_ws(' ', " + ", ".join(f"{words}[i + {k}]" for k in range(window)) + ")"
    grams = f"sort_array(transform(sequence(0, size({words}) - {window}), i -> struct({gram} AS g, i AS p)))"
    again = "filter(s, (x, k) -> coalesce(get(s, k - 1).g = x.g, false) OR coalesce(get(s, k + 1).g = x.g, false))"
    covered = f"size(array_distinct(flatten(transform({again}, x -> sequence(x.p, x.p + {window - 1})))))"
    return f"CASE WHEN size({words}) <= {window} THEN 0 ELSE {let(grams, 's', covered)} END"


def counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All counts of a text, each a long."""
    marks = "\\\\x20\\\\x09-\\\\x0D"
    stop = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    cut = df.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("t")).select(
        "doc_id",
        "t",
        F.expr(f"filter(split(t, '[{marks}]+'), w -> w <> '')").alias("w"),
        F.expr(f"filter(split(t, '\\n'), l -> l rlike '[^{marks}]')").alias("l"),
    )
    exprs = {
        "n_words": "size(w)",
        "word_chars": f"length(translate(t, '{SPACE}', ''))",
        "n_symbols": f"length(t) - length(translate(t, '{SYMBOLS}', ''))",
        "n_lines": "size(l)",
        "n_dup_lines": "size(l) - size(array_distinct(l))",
        "n_repeat_words": repeated_words("w"),
        "n_stop_words": f"size(filter(w, x -> lower(rtrim('.,;:!?', x)) IN ({stop})))",
        "n_alpha_words": "size(filter(w, x -> x rlike '\\\\p{L}'))",
        "n_upper_words": "size(filter(w, x -> length(x) > 1 AND x = upper(x) AND x <> lower(x)))",
        "n_ellipsis_lines": "size(filter(l, x -> rtrim(x) LIKE '%...' OR rtrim(x) LIKE '%…'))",
    }
    return cut.select("doc_id", *[F.expr(e).cast("long").alias(k) for k, e in exprs.items()])


def quality(df: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, ratios, the names of the rules a text fails, and the verdict.

    ``base_failed``: fewer than 50 words, or more than half of the words in
    repeated three-word windows. ``kept``: not ``base_failed`` and every rule holds.
    """
    counted = counts(df, id_col, text_col).withColumn("base_failed", F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words"))
    over = {k: v.replace("/ n_words", "/ greatest(n_words, 1)").replace("/ n_lines", "/ greatest(n_lines, 1)") for k, v in RATIOS.items()}
    rated = counted.select("*", *[F.expr(e).alias(k) for k, e in over.items()])
    failed = "filter(array(" + ", ".join(f"IF({r.sql()}, NULL, '{r.name}')" for r in rules) + "), r -> r IS NOT NULL)"
    return rated.withColumn("failed_rules", F.expr(failed)).withColumn("kept", F.expr("NOT base_failed AND size(failed_rules) = 0"))
