"""Records that services answer with, as JSON text, and tests of texts that say how to draw them.

Columns in, Columns out; null or unreadable JSON gives null unless said otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

_RECORDING = "struct<title:string,length:bigint,`artist-credit`:array<struct<name:string,joinphrase:string,artist:struct<name:string>>>>"
_ANSWER = (
    "struct<status:string,error:struct<message:string>,results:array<struct<score:double,"
    "recordings:array<struct<id:string,title:string,duration:bigint,artists:array<struct<name:string>>>>>>>"
)
# Hebrew, Arabic, Devanagari to Sinhala, Thai.
COMPLEX_SCRIPTS = r"[֐-׿؀-ۿऀ-෿฀-๿]"


def joined_credit(entries: Column) -> Column:
    """Names (or the nested artists' names) each followed by its join phrase; empty for a null list."""
    parts = F.transform(entries, lambda e: F.concat(F.coalesce(e["name"], e["artist"]["name"], F.lit("")), F.coalesce(e["joinphrase"], F.lit(""))))
    return F.coalesce(strip(F.array_join(parts, "")), F.lit(""))


def recording(body: Column) -> Column:
    """Struct title, artist, duration_s (rounded) of a recording; null without a title or a credit."""
    r = F.from_json(body, _RECORDING)
    title, artist = F.coalesce(strip(r["title"]), F.lit("")), joined_credit(r["artist-credit"])
    seconds = F.call_function("div", r["length"] + 500, F.lit(1000))
    return F.when((title != "") & (artist != ""), F.struct(title.alias("title"), artist.alias("artist"), seconds.alias("duration_s")))


def identified(body: Column) -> Column:
    """Struct error, candidates of an answer: candidates (score, mbid, title, artists, duration_s) in order, none with an error."""
    r = F.from_json(body, _ANSWER)
    error = F.when(r["status"] == "ok", F.lit(None).cast("string")).when(r["status"] == "error", F.coalesce(r["error"]["message"], F.lit("unknown error"))).otherwise("response has no status")

    def names(artists: Column) -> Column:
        trimmed = F.transform(artists, lambda a: strip(a["name"]))
        return F.coalesce(F.filter(trimmed, lambda x: x != ""), F.array().cast("array<string>"))

    def of(result: Column) -> Column:
        usable = F.filter(F.coalesce(result["recordings"], F.array().cast("array<struct<id:string,title:string,duration:bigint,artists:array<struct<name:string>>>>")), lambda x: x["id"].isNotNull())
        return F.transform(usable, lambda x: F.struct(
            F.coalesce(result["score"], F.lit(0.0)).alias("score"), x["id"].alias("mbid"), F.nullif(strip(x["title"]), F.lit("")).alias("title"),
            names(x["artists"]).alias("artists"), x["duration"].alias("duration_s")))

    found = F.flatten(F.transform(r["results"], of))
    empty = F.array().cast("array<struct<score:double,mbid:string,title:string,artists:array<string>,duration_s:bigint>>")
    return F.struct(error.alias("error"), F.when(error.isNull(), F.coalesce(found, empty)).otherwise(empty).alias("candidates"))


def needs_shaping(text: Column) -> Column:
    """Whether a text holds a script whose letters change with their neighbours; false for null."""
    return F.coalesce(text.rlike(COMPLEX_SCRIPTS), F.lit(False))


def frame_ms(frame: Column) -> Column:
    """Milliseconds of an encoder frame of 20 ms."""
    return (frame * 20).cast("int")


def position_now(status: Column, anchor_ms: Column, elapsed_ms: Column) -> Column:
    """Where playback is: time passes only while it is playing."""
    return F.when(status == "Playing", anchor_ms + elapsed_ms).otherwise(anchor_ms)
