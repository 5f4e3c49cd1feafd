"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

Words are runs of anything but ASCII white space. Base counts come first (``BASE``), then ``RULES`` bounds ratios of
length, symbols, stop words and lines. No user function, no shuffle: one pass over each text.

Repeated words are exact: a text whose 5-word windows all have distinct hashes has none; any other text sorts its
windows as strings and compares neighbours.

Defined results: a null text counts as an empty one and fails the base; repeated rows give repeated rows; null ids are
kept; other columns are ignored, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHITE = " \t\n\x0b\f\r"
WINDOW = 5
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
SYMBOLS = "#*$%&|<>"
#: Frequent words of the four languages.
STOP_WORDS = (
    "the and of to in a is it that for with as on be are was he by at this from or an which one you had not but have all they "
    "der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass "
    "de la que el en y a los del se las por un para con no una su al lo como más "
    "le les et des une du est dans qui pour pas sur au par plus ce il sont elle ou"
).split()
#: metric: (least, most) that is still good; None is unbounded. A text of few words (under SHORT) isn't held to
#: stop words, whose share says little there.
RULES: Mapping[str, tuple[float | None, float | None]] = {
    "mean_word_chars": (1.5, 20.0),
    "symbols_per_word": (None, 0.3),
    "stop_share": (0.02, None),
    "upper_share": (None, 0.6),
    "dup_line_share": (None, 0.5),
    "bar_line_share": (None, 0.5),
    "bang_per_word": (None, 0.5),
}
SHORT = 30


def _white_free(c: Column) -> Column:
    return F.translate(c, WHITE, "")


def counted(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Base counts and ratios of each row, in layers so that shared arrays are made once."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    first = df.select(F.col(id_col).alias("_id"), text.alias("_t"), F.trim(text, F.lit(WHITE)).alias("_trim"))
    empty = F.col("_trim") == ""
    words = F.when(empty, F.array().cast("array<string>")).otherwise(F.split("_trim", r"[\x20\x09-\x0D]+"))
    lines = F.filter(F.split("_t", "\n"), lambda x: F.trim(x, F.lit(WHITE)) != "")
    second = first.select("_id", "_t", words.alias("_w"), lines.alias("_l"))
    n = F.size("_w")
    at = lambda i, k: F.get("_w", i + k)
    hashes = F.when(
        n > WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*(at(i, k) for k in range(WINDOW))))
    )
    stop = [w for w in dict.fromkeys(STOP_WORDS)]
    third = second.select(
        "_id",
        "_w",
        n.cast("long").alias("n_words"),
        F.length(_white_free(F.col("_t"))).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("_l").cast("long").alias("n_lines"),
        F.size(F.array_distinct("_l")).cast("long").alias("_distinct_lines"),
        F.size(F.filter("_l", lambda x: F.length(x) - F.length(F.translate(x, "|", "")) >= 2)).cast("long").alias("_bar_lines"),
        (F.length("_t") - F.length(F.translate("_t", "!", ""))).cast("long").alias("_bangs"),
        F.length(F.regexp_replace("_t", r"[^\p{Lu}]+", "")).cast("long").alias("_upper"),
        F.size(F.filter("_w", lambda x: F.lower(x).isin(stop))).cast("long").alias("_stops"),
        hashes.alias("_h"),
    )
    repeats = F.size(F.array_distinct("_h")) < F.size("_h")
    grams = F.transform(
        F.sequence(F.lit(1), F.size("_w") - (WINDOW - 1)),
        lambda i: F.struct(F.array_join(F.slice("_w", i, WINDOW), " ").alias("g"), i.alias("p")),
    )
    fourth = third.withColumn("_s", F.when(repeats, F.sort_array(grams))).drop("_h", "_w")
    same = lambda i, j: F.coalesce(F.get("_s", i)["g"] == F.get("_s", j)["g"], F.lit(False))
    indexes = F.sequence(F.lit(0), F.size("_s") - 1)
    starts = F.transform(
        F.filter(indexes, lambda i: (F.when(i > 0, same(i, i - 1)).otherwise(False)) | same(i, i + 1)),
        lambda i: F.get("_s", i)["p"],
    )
    fifth = fourth.withColumn("_p", F.when(F.col("_s").isNotNull(), F.sort_array(starts))).drop("_s")
    covered = F.aggregate(
        F.sequence(F.lit(0), F.size("_p") - 1),
        F.lit(0).cast("long"),
        lambda acc, i: acc + F.least(F.lit(WINDOW), F.coalesce(F.get("_p", i + 1) - F.get("_p", i), F.lit(WINDOW))),
    )
    n_repeat = F.when(F.size("_p") > 0, covered).otherwise(F.lit(0).cast("long"))
    return fifth.withColumn("n_repeat_words", n_repeat).drop("_p")


def _ratio(a: Column, b: str) -> Column:
    return F.when(F.col(b) > 0, a / F.col(b)).otherwise(F.lit(0.0))


def metrics() -> dict[str, Column]:
    return {
        "mean_word_chars": _ratio(F.col("word_chars"), "n_words"),
        "symbols_per_word": _ratio(F.col("n_symbols"), "n_words"),
        "stop_share": F.when(F.col("n_words") < SHORT, F.lit(1.0)).otherwise(_ratio(F.col("_stops"), "n_words")),
        "upper_share": _ratio(F.col("_upper"), "word_chars"),
        "dup_line_share": _ratio(F.col("n_lines") - F.col("_distinct_lines"), "n_lines"),
        "bar_line_share": _ratio(F.col("_bar_lines"), "n_lines"),
        "bang_per_word": _ratio(F.col("_bangs"), "n_words"),
    }


def verdict(rules: Mapping[str, tuple[float | None, float | None]]) -> Column:
    """The threshold table as one condition."""
    good, of = F.lit(True), metrics()
    for name, (least, most) in rules.items():
        if least is not None:
            good &= of[name] >= least
        if most is not None:
            good &= of[name] <= most
    return good


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """(id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) of each row."""
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return counted(df, id_col, text_col).select(
        F.col("_id").alias(id_col),
        "n_words",
        "word_chars",
        "n_symbols",
        (F.col("n_lines") - F.col("_distinct_lines")).alias("n_dup_lines"),
        "n_repeat_words",
        base.alias("base_failed"),
        (~base & verdict(rules)).alias("kept"),
    )


def keep(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """The rows of docs, whole, that the rules keep."""
    packed = docs.select(F.struct(*docs.columns).alias("_row")).withColumn("_text", F.col(f"_row.{text_col}"))
    # The generator keeps the optimizer from pushing the verdict below the layers that share arrays.
    judged = judge(packed, "_row", "_text", rules).select("_row", F.explode_outer(F.array("kept")).alias("_kept"))
    return judged.filter("_kept").select("_row.*")


def judge_sql(rules=RULES, source: str = "documents") -> str:
    """``judge`` over ``documents`` (doc_id unique) as SQL."""
    ws = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    stop = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    ratio = lambda a, b: f"(CASE WHEN {b} > 0 THEN CAST({a} AS DOUBLE) / {b} ELSE 0.0 END)"
    of = {
        "mean_word_chars": ratio("word_chars", "n_words"),
        "symbols_per_word": ratio("n_symbols", "n_words"),
        "stop_share": f"(CASE WHEN n_words < {SHORT} THEN 1.0 ELSE {ratio('stops', 'n_words')} END)",
        "upper_share": ratio("uppers", "word_chars"),
        "dup_line_share": ratio("n_dup_lines", "n_lines"),
        "bar_line_share": ratio("bar_lines", "n_lines"),
        "bang_per_word": ratio("bangs", "n_words"),
    }
    tests = [f"{of[k]} >= {v[0]}" for k, v in rules.items() if v[0] is not None]
    tests += [f"{of[k]} <= {v[1]}" for k, v in rules.items() if v[1] is not None]
    return f"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: trim(l, {ws}) <> '') AS l FROM {source}),
windows AS (
  SELECT doc_id, i, array_to_string(w[i:i+{WINDOW - 1}], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM t)),
doubled AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM windows) WHERE c > 1),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + {WINDOW})) AS p FROM doubled) GROUP BY doc_id),
c AS (
  SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(translate(x, {ws}, '')) AS BIGINT) AS word_chars,
    CAST(length(x) - length(translate(x, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols, len(l) AS n_lines,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
    len(list_filter(l, lambda s: length(s) - length(replace(s, '|', '')) >= 2)) AS bar_lines,
    length(x) - length(replace(x, '!', '')) AS bangs, length(regexp_replace(x, '[^\\p{{Lu}}]+', '', 'g')) AS uppers,
    len(list_filter(w, lambda s: lower(s) IN ({stop}))) AS stops, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words
  FROM t LEFT JOIN covered ON t.doc_id = covered.doc_id),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND {" AND ".join(tests)} AS kept FROM b"""
