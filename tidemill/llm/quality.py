"""Quality rules: a threshold table compiled into one projection of built-in expressions.

Nothing leaves the row: words, lines and windows are arrays inside it, so there is no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ._common import SEPARATOR

BLANKS = " \t\n\x0b\x0c\r"
#: Texts of up to ``2 ** PLACE_BITS`` windows sort one number a window: its hash without as many low bits, and its place in these.
PLACE_BITS = 15
SYMBOLS = "#*$%&|<>"
#: Frequent function words of the corpus languages.
STOP_WORDS = (
    "the be to of and that have with a in is it for on are as was at by an or this from not "
    "der die das und in ist von zu den mit nicht ein eine des im "
    "le la les de et un une en que du des est pour au "
    "el los las y del se por con no una su al lo es"
).split()
#: name: (measure, factor, comparison, limit, basis): a text passes if factor * measure <comparison> limit * basis.
RULES = {
    "mean_word_short": ("word_chars", 1, ">=", 2, "n_words"),
    "mean_word_long": ("word_chars", 1, "<=", 12, "n_words"),
    "symbol_ratio": ("n_symbols", 100, "<=", 20, "n_words"),
    "dup_line_ratio": ("n_dup_lines", 100, "<=", 50, "n_lines"),
    "stop_word_ratio": ("n_stop_words", 100, ">=", 2, "n_words"),
}


def measures(text: Column, words: Column) -> dict[str, Column]:
    """Every measure of the rules, from a text that isn't null and its words."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return {
        "words": words,
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(f"[{SYMBOLS}]")).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_stop_words": F.size(F.filter(words, lambda w: F.lower(w).isin(*dict.fromkeys(STOP_WORDS)))).cast("long"),
    }


def split_words(text: Column) -> Column:
    """The words of a text; trimmed first, so that no empty one comes out."""
    bare = F.btrim(text, F.lit(BLANKS))
    return F.when(bare == "", F.expr("cast(array() AS array<string>)")).otherwise(F.split(bare, SEPARATOR))


def _covered(at: Column) -> Column:
    """Words that windows of three starting at these rising positions cover together."""
    gaps = F.zip_with(F.slice(at, 2, F.size(at)), at, lambda b, a: F.when(b.isNull(), 3).otherwise(F.least(b - a, F.lit(3))))
    return F.when(F.size(at) == 0, 0).otherwise(F.aggregate(gaps, F.lit(0), lambda s, x: s + x))


def compile_rules(rules: dict = RULES) -> Column:
    """One boolean: all rules of the table hold.  A basis of zero is held like any number (0 <= 0 passes)."""
    verdict = F.lit(True)
    for measure, factor, op, limit, basis in rules.values():
        a, b = F.col(measure) * factor, F.col(basis) * limit
        verdict = verdict & (a <= b if op == "<=" else a >= b)
    return verdict


def quality(docs: DataFrame, rules: dict = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measures, ``base_failed`` (under 50 words, or over half of them in repeated windows) and ``kept`` of every row.

    Windows of three words count as equal if their words do; they meet by sorting their hashes.  Null text: no words, not kept.
    Repeated rows and null ids stay as they are.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    rows = rows.withColumn("words", split_words(F.col("text")))
    rows = rows.select("doc_id", *(c.alias(k) for k, c in measures(F.col("text"), F.col("words")).items()))
    low, most = (1 << PLACE_BITS) - 1, 1 << PLACE_BITS
    # sorted hashes of the windows with their places: one number each, or a struct in the few texts that are too long for it
    rows = rows.withColumns({
        "packed": F.expr(f"sort_array(transform(slice(words, 3, if(n_words <= {most}, size(words), 0)), (w, i) -> (xxhash64(words[i], words[i + 1], w) & {~low}) | i))"),
        "wide": F.expr(f"sort_array(transform(slice(words, 3, if(n_words > {most}, size(words), 0)), (w, i) -> struct(xxhash64(words[i], words[i + 1], w) AS h, i AS i)))"),
    })
    # neighbours with equal hashes, compared word by word
    packed = f"array_compact(zip_with(packed, slice(packed, 2, size(packed)), (a, b) -> if(((a ^ b) & {~low}) = 0, struct(cast(a & {low} AS int) AS i, cast(b & {low} AS int) AS j), null)))"
    wide = "array_compact(zip_with(wide, slice(wide, 2, size(wide)), (a, b) -> if(a.h = b.h, struct(a.i AS i, b.i AS j), null)))"
    same = " and ".join(f"words[x.i + {k}] = words[x.j + {k}]" for k in range(3))
    rows = rows.withColumn("at", F.expr(f"sort_array(array_distinct(flatten(transform(filter(concat({packed}, {wide}), x -> {same}), x -> array(x.i, x.j)))))"))
    rows = rows.withColumn("n_repeat_words", _covered(F.col("at")).cast("long")).drop("words", "packed", "wide", "at")
    rows = rows.withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words"))
    return rows.withColumn("kept", ~F.col("base_failed") & compile_rules(rules))
