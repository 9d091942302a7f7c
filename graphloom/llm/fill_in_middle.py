"""Fill-in-middle transformation of texts by escaped marker injection, in column functions.

A delimiter that is escaped in the text itself is appended after each unit (a line) by regexp_replace. Counting the delimiters
gives the number of units, and substring_index extracts the parts between two ranks; then they are unescaped and assembled
round the markers of prefix, suffix and middle. Everything happens in the row: no shuffle and no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import fresh

UNIT = r"[^\n]*+\n|[^\n]++"  # possessive, so that Java's matcher doesn't go back over long lines
MARKS = ("<P>", "<S>", "<M>")  # prefix, suffix, middle
DELIMITER, ESCAPE = "\x1e", "\x1b"
RATE = 100  # percent of the texts that are transformed
SUFFIX_FIRST = 50  # percent of these that have the suffix before the prefix
SEED = 7


def _draws(key: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers that follow from seed and key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def _escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "e")), F.lit(DELIMITER), F.lit(ESCAPE + "d"))


def _unescaped(part: Column) -> Column:
    """part without its delimiters, as it stood in the text."""
    plain = F.replace(part, F.lit(DELIMITER), F.lit(""))
    return F.replace(F.replace(plain, F.lit(ESCAPE + "d"), F.lit(DELIMITER)), F.lit(ESCAPE + "e"), F.lit(ESCAPE))


def _between(marked: Column, low: Column, high: Column) -> Column:
    """The units of ranks low (exclusive) to high of a text with a delimiter after each unit."""
    return F.call_function("substring_index", F.call_function("substring_index", marked, F.lit(DELIMITER), high), F.lit(DELIMITER), low - high)


def transformed(docs: DataFrame, unit: str = UNIT, marks: tuple[str, str, str] = MARKS, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, seed: int = SEED) -> DataFrame:
    """docs with n (units), form (plain, psm or spm), prefix, middle, suffix (null if plain) and output; all rows and columns stay.

    The cuts and the form follow from doc_id and seed; a null doc_id draws as an empty one, repeated rows are transformed alike.
    A null text counts as an empty one. Empty texts and texts that hold one of the marks stay as they are (plain). Columns of
    docs with a name that is added here are replaced.
    """
    names = ("n", "form", "prefix", "middle", "suffix", "output")
    text, marked, low, high = (fresh(docs, x) for x in ("_fim_text", "_fim_marked", "_fim_low", "_fim_high"))
    draws = _draws(F.col("doc_id"), seed)
    out = docs.drop(*names).withColumn(text, F.coalesce("text", F.lit("")))
    out = out.withColumn(marked, F.regexp_replace(_escaped(F.col(text)), f"(?:{unit})", f"$0{DELIMITER}"))
    out = out.withColumn("n", (F.length(marked) - F.length(F.replace(marked, F.lit(DELIMITER), F.lit("")))).cast("long"))
    cuts = [(d % (F.col("n") + 1)).cast("int") for d in draws[:2]]
    held = F.lit(False)
    for m in marks:
        held |= F.contains(text, F.lit(m))
    plain = (F.col("n") == 0) | held | (draws[2] % 100 >= rate)
    out = out.withColumns({low: F.least(*cuts), high: F.greatest(*cuts), "form": F.when(plain, "plain").when(draws[3] % 100 < suffix_first, "spm").otherwise("psm")})
    cut = lambda part: F.when(F.col("form") != "plain", _unescaped(part))
    tail = F.call_function("substring_index", F.col(marked), F.lit(DELIMITER), F.col(high) - F.col("n").cast("int") - 1)
    head = F.call_function("substring_index", F.col(marked), F.lit(DELIMITER), F.col(low))
    out = out.withColumns({"prefix": cut(head), "middle": cut(_between(F.col(marked), F.col(low), F.col(high))), "suffix": cut(tail)})
    p, s, m = map(F.lit, marks)
    output = F.when(F.col("form") == "psm", F.concat(p, "prefix", s, "suffix", m, "middle")).when(F.col("form") == "spm", F.concat(s, "suffix", p, "prefix", m, "middle")).otherwise(F.col(text))
    return out.withColumn("output", output).drop(text, marked, low, high)


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output of the given form came from: its parts stand between the marks, which no part holds."""
    p, s, m = marks
    part = lambda a, b: F.substring_index(F.call_function("substring_index", output, F.lit(a), F.lit(-1)), b, 1)
    last = F.call_function("substring_index", output, F.lit(m), F.lit(-1))
    return F.when(form == "psm", F.concat(part(p, s), last, part(s, m))).when(form == "spm", F.concat(part(p, m), last, part(s, p))).otherwise(output)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars (null if plain), output_sha256 and restored_sha256 of every row of docs (doc_id, text)."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    out = transformed(docs.select("doc_id", "text"))
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "n", "form", F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"), sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))
