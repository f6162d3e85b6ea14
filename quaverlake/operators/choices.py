"""What is shown of a catalogue, what is drawn from it, and answers that come in batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What an analysis only holds while its item plays.
LIVE = ("windowMs", "level", "bass", "treble", "onsets")


def shown(search: str = "", only: str = "all") -> Column:
    """Whether a row (name, favourite, hidden, seen) is listed; `only`: all, fav or unseen. A search finds hidden ones too."""
    query = search.strip().lower()
    found = F.contains(F.lower("name"), F.lit(query))
    if only == "fav":
        return found & F.col("favourite")
    listed = found if query else ~F.col("hidden")
    return listed & ~F.col("seen") if only == "unseen" else listed


def pool(items: DataFrame, by: str) -> DataFrame:
    """items (by, name, favourite, hidden, curated) -> the (by, name) that are drawn from.

    Hidden items stay out, unless all are hidden. Of the rest: favourites if there are two or
    more, else the curated ones, else all; so no key goes empty. Counts are made before the shuffle.
    """
    def count(test: Column) -> Column:
        return F.count_if(test)

    open_ = ~F.col("hidden")
    counts = items.groupBy(F.col(by).alias("__k")).agg(
        count(open_).alias("__open"), count(open_ & F.col("favourite")).alias("__fav"), count(open_ & F.col("curated")).alias("__cur"),
        count(F.col("favourite")).alias("__all_fav"), count(F.col("curated")).alias("__all_cur"),
    )
    some = F.col("__open") > 0
    liked, picked = F.when(some, F.col("__fav")).otherwise(F.col("__all_fav")), F.when(some, F.col("__cur")).otherwise(F.col("__all_cur"))
    drawn = F.when(liked > 1, F.col("favourite")).when(picked > 0, F.col("curated")).otherwise(True)
    return items.join(counts, F.col(by).eqNullSafe(F.col("__k"))).where((open_ | ~some) & drawn).select(by, "name")


def contained(lines: DataFrame, answers: DataFrame, by: str, size: int = 40, whole: bool = False) -> DataFrame:
    """lines (by, i, text) and answers (by, i, text) to batches of `size` lines -> (by, i, batch, text, changed).

    A batch with a line that has no answer has failed: it keeps its own texts. With `whole` the key
    then gives no rows. Lines are numbered per item, which bounds the window.
    """
    numbered = lines.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(by).orderBy("i")) - 1) / size).cast("long"))
    replies = answers.where("text is not null").select(F.col(by).alias("__k"), F.col("i").alias("__i"), F.col("text").alias("reply")).dropDuplicates(["__k", "__i"])
    met = numbered.join(replies, (F.col(by) == F.col("__k")) & (F.col("i") == F.col("__i")), "left").drop("__k", "__i")
    failed = F.max(F.col("reply").isNull()).over(Window.partitionBy(by) if whole else Window.partitionBy(by, "batch"))
    met = met.withColumn("failed", failed)
    if whole:
        met = met.where(~F.col("failed"))
    text = F.when(F.col("failed"), F.col("text")).otherwise(F.col("reply"))
    return met.select(by, "i", "batch", text.alias("text"), (~text.eqNullSafe(F.col("text"))).alias("changed"))


def summary(analyses: DataFrame) -> DataFrame:
    """Analyses without what is only of use while an item plays."""
    return analyses.drop(*LIVE)


def map_attribution(actors: Column, artists: Column, singers: Column) -> Column:
    """singers (an artist's index per line) as indices of actors (array of credit and name), -1 where there is none.

    An artist is the first actor of the same credit or name. Null if no artist is found, if there are fewer than two, or if there is no actor or line.
    """
    plain = lambda x: F.lower(F.regexp_replace(F.coalesce(x, F.lit("")), r"^[\s\p{Z}\x{FEFF}]+|[\s\p{Z}\x{FEFF}]+$", ""))
    known = F.transform(actors, lambda a: F.array(plain(a["credit"]), plain(a["name"])))
    first = lambda w: F.array_position(F.transform(known, lambda a: F.array_contains(a, w)), True) - 1
    found = F.transform(artists, lambda x: F.when(plain(x) == "", F.lit(-1)).otherwise(first(plain(x))).cast("int"))
    told = (F.size(actors) > 0) & (F.size(artists) > 1) & (F.size(singers) > 0) & F.exists(found, lambda i: i >= 0)
    return F.when(told, F.transform(singers, lambda i: F.when((i >= 0) & (i < F.size(found)), F.get(found, i)).otherwise(F.lit(-1))))
