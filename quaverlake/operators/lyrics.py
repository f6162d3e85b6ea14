"""Timed texts: parsing stamps, dropping credits, timing lines and words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import text as T

STAMP = r"\[(\d{1,3}):(\d{2})(?:[.:](\d{1,3}))?\]"
#: Words of a line are spread over at most this long.
MAX_SPREAD_MS = 8000
MIN_SHARE = 0.35


def parse_lrc(df: DataFrame, key: str, text: str, minute_digits: int = 3, fold_blanks: bool = True) -> DataFrame:
    """(key, line_no, time_ms, end_ms, text) of each stamp in time order.

    A stamp without words ends the line before it, if that is earlier and has no end yet.
    """
    pattern = STAMP.replace("{1,3}):", f"{{1,{minute_digits}}}):", 1)
    line = df.select(key, F.posexplode(F.split(text, "\n")).alias("__n", "__raw"))
    stamps = F.regexp_extract_all("__raw", F.lit(pattern), F.lit(0))
    line = line.select(key, "__n", T.strip(F.regexp_replace("__raw", pattern, "")).alias("__body"), F.posexplode(stamps).alias("__k", "__stamp"))
    part = lambda i: F.regexp_extract("__stamp", pattern, i)
    t = part(1).cast("long") * 60000 + part(2).cast("long") * 1000 + F.rpad(part(3), 3, "0").cast("long")
    line = line.select(key, "__n", "__k", "__body", t.alias("__t"))
    order = Window.partitionBy(key).orderBy("__t", "__n", "__k")
    if not fold_blanks:
        return line.select(key, (F.row_number().over(order) - 1).alias("line_no"), F.col("__t").alias("time_ms"), F.lit(None).cast("long").alias("end_ms"), F.col("__body").alias("text"))
    worded = F.col("__body") != ""
    line = line.withColumn("__g", F.sum(worded.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))).where("__g > 0")
    start = F.max(F.when(worded, F.struct("__t", "__body"))).over(Window.partitionBy(key, "__g"))
    ends = F.min(F.when(~worded & (F.col("__t") > F.col("__s.__t")), F.col("__t"))).alias("end_ms")
    line = line.withColumn("__s", start).groupBy(key, "__g").agg(F.first("__s").alias("__s"), ends)
    return line.select(key, (F.row_number().over(Window.partitionBy(key).orderBy("__g")) - 1).alias("line_no"), F.col("__s.__t").alias("time_ms"), "end_ms", F.col("__s.__body").alias("text"))


def strip_credits(lines: DataFrame, key: str, order: str = "line_no", text: str = "text") -> DataFrame:
    """lines without the credits that lead a text; a text of credits only goes."""
    first = F.min(F.when(~T.is_credit(F.col(text)), F.col(order))).over(Window.partitionBy(key))
    return lines.withColumn("__first", first).where(F.col(order) >= F.col("__first")).drop("__first")


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def line_energy(lines: DataFrame, order: WindowSpec, time: str = "time_ms", text: str = "text") -> DataFrame:
    """lines plus duration_ms (to the next line, else 3 s; 250 ms at least) and energy (words a second over 4.5, at most 1)."""
    end = F.coalesce(F.lead(time).over(order), F.col(time) + 3000)
    out = lines.withColumn("duration_ms", F.greatest(F.lit(250).cast("long"), end - F.col(time)))
    return out.withColumn("energy", F.least(F.lit(1.0), F.size(words_of(F.col(text))) / (F.col("duration_ms") / 1000) / 4.5))


def word_timing(lines: DataFrame, start: str = "start_ms", end: str = "end_ms", text: str = "text") -> DataFrame:
    """A row per word with start_ms and end_ms: the span is shared by syllables, no word below a share of the mean.

    Inside a row only: arrays, no shuffle.
    """
    words = words_of(F.col(text))
    weight = F.transform("__w", lambda w: T.syllables(w).cast("double"))
    out = lines.withColumn("__w", words).where(F.size("__w") > 0).withColumn("__s", weight)
    mean = F.aggregate("__s", F.lit(0.0), lambda a, x: a + x) / F.size("__s")
    out = out.withColumn("__m", mean).withColumn("__s", F.transform("__s", lambda x: F.greatest(x, F.col("__m") * MIN_SHARE)))
    add = lambda acc, x: F.struct((acc["sum"] + x).alias("sum"), F.concat(acc["at"], F.array(acc["sum"])).alias("at"))
    acc = F.struct(F.lit(0.0).alias("sum"), F.array().cast("array<double>").alias("at"))
    out = out.withColumn("__c", F.aggregate("__s", acc, add))
    span = F.greatest(F.lit(0), F.least(F.col(end) - F.col(start), F.lit(MAX_SPREAD_MS)))
    out = out.withColumns({"__span": span, "__from": F.col(start).cast("double")}).drop(start, end)
    out = out.select("*", F.posexplode(F.arrays_zip("__w", "__s", "__c.at")).alias("word_no", "__x"))
    at = F.col("__from") + F.col("__x.at") / F.col("__c.sum") * F.col("__span")
    out = out.withColumns({"word": F.col("__x.__w"), start: at, end: at + F.col("__x.__s") / F.col("__c.sum") * F.col("__span")})
    return out.drop("__w", "__s", "__m", "__c", "__span", "__from", "__x")
