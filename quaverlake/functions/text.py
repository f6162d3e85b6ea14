"""Scalar text functions: Columns in, Columns out, all inside code generation.

White space and letters are Unicode's throughout. Null in gives null out unless said otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that mark another recording.
VERSION_TOKENS = (
    "live", "remix", "acoustic", "unplugged", "instrumental", "slowed", "reverb", "sped", "speedup", "remastered", "cover",
    "karaoke", "demo", "extended", "mashup", "reprise", "bonus", "edit", "rework", "flip", "bootleg",
)
# Patterns of noise in titles.
TITLE_NOISE = (
    r"\((?:official\s+)?(?:music\s+)?(?:video|audio|visualizer|lyrics?|lyric video|mv|hd|4k)\)",
    r"\[(?:official\s+)?(?:music\s+)?(?:video|audio|visualizer|lyrics?|lyric video|mv|hd|4k)\]",
    r"\((?:prod\.?|prod by)[^)]*\)",
    r"\b(?:official\s+)?(?:music\s+)?video\b",
    r"\bfull\s+(?:song|video|album)\b",
    r"\bremaster(?:ed)?(?:\s+\d{4})?\b",
    r"\b(?:official\s+)?(?:audio|lyrical|lyric)\b",
    r"\bout\s+now\b",
    r"\((?:feat\.?|ft\.?|with)[^)]*\)",
    r"\b(?:feat\.?|ft\.?)\s+.*$",
)
# Substrings that only titles made for video sites have.
VIDEO_WORDS = (
    "official video", "official music video", "official audio", "lyric video", "lyrics)", "lyrics]", "visualizer", "(4k",
    "[4k", "full song", "out now",
)
# Credits at the head of a text.
CREDITS = (
    r"^\s*(?:作词|作曲|编曲|制作人|监制|混音|母带|和声|录音|吉他|贝斯|鼓|键盘|策划|出品|录音室|词|曲)\s*[:：]",
    r"(?i)^\s*(?:lyricist|composer|arranger|produced by|written by|mixing|mastering|recorded by|lyrics by|composed by|arranged by|producer|mixed by|mastered by)\s*[:：]",
)
# Moods by key words, first match wins.
MOODS = (
    ("dark", "dark|angry|aggress|furious|rage|menac|sinist|heavy|brood|violent|intense"),
    ("energetic", "energ|euphor|hype|upbeat|party|danc|joy|happy|excit|triumph|anthem|uplift|ecstat"),
    ("calm", "calm|mellow|melanchol|sad|somber|gentle|tender|dream|ambient|peace|serene|wistful|nostalg|lonely|soft"),
    ("bright", "bright|warm|hopeful|sweet|playful|light|sunny|romant"),
)
# Motion, turbulence, flicker and warmth of each mood.
MOOD_PROFILES = {
    "calm": (0.7, 0.65, 0.5, -8.0), "energetic": (1.35, 1.3, 1.25, 6.0), "dark": (1.1, 1.15, 1.15, -14.0),
    "bright": (1.05, 0.95, 0.9, 12.0), "neutral": (1.0, 1.0, 1.0, 0.0),
}
# Entities that are decoded, in this order.
ENTITIES = (
    ("&#x27;", "'"), ("&#39;", "'"), ("&apos;", "'"), ("&quot;", '"'), ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"),
)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def normalize(c: Column) -> Column:
    """Lower case, letters and digits only, single spaces. Combining marks go, as in the engine this follows."""
    return collapse(F.regexp_replace(F.lower(c), r"(?U)[^\p{L}\p{N}\s]", " "))


def tokens(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(normalize(c), " "), lambda t: t != ""))


def token_overlap(a: Column, b: Column) -> Column:
    """Similarity of two token arrays: shared over the larger size; 0 where either is empty."""
    larger = F.greatest(F.size(a), F.size(b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / larger).otherwise(F.lit(0.0))


def token_similarity(a: Column, b: Column) -> Column:
    return token_overlap(tokens(a), tokens(b))


def version_tags(c: Column) -> Column:
    return F.array_intersect(F.array(*map(F.lit, VERSION_TOKENS)), tokens(c))


def clean_title(c: Column) -> Column:
    """A title without noise; what would be empty stays as it is."""
    out = F.substring_index(c, "|", 1)
    for pattern in TITLE_NOISE:
        out = F.regexp_replace(out, "(?iU)" + pattern, " ")
    out = collapse(F.regexp_replace(out, "[\"'`‘’“”]", " "))
    return F.when(out == "", strip(c)).otherwise(out)


def clean_artist(c: Column) -> Column:
    out = strip(F.regexp_replace(c, r"(?is)- topic(?!.*- topic).*$", ""))
    out = collapse(F.regexp_replace(out, r"(?:VEVO|vevo)$", ""))
    return F.when(out == "", strip(c)).otherwise(out)


def djb2(c: Column) -> Column:
    """Wrapping 64-bit hash (h * 33 + byte, from 5381) of the UTF-8 bytes, as 16 hexadecimal digits."""
    raw = F.filter(F.split(F.decode(F.encode(c, "UTF-8"), "ISO-8859-1"), ""), lambda x: x != "")
    low = lambda h, x: h["low"] * 33 + F.ascii(x)
    whole = F.lit(2**32)
    step = lambda h, x: F.struct(F.pmod(h["high"] * 33 + F.call_function("div", low(h, x), whole), whole).alias("high"), F.pmod(low(h, x), whole).alias("low"))
    word = lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")
    start = F.struct(F.lit(0).cast("long").alias("high"), F.lit(5381).cast("long").alias("low"))
    return F.aggregate(raw, start, step, lambda h: F.concat(word(h["high"]), word(h["low"])))


def track_key(artist: Column, title: Column) -> Column:
    return djb2(F.concat(strip(F.lower(artist)), F.lit("|"), strip(F.lower(title))))


def hash31(c: Column) -> Column:
    """h * 31 + code unit, modulo 2**32; the same as over UTF-16 inside the basic plane."""
    return F.aggregate(F.filter(F.split(c, ""), lambda x: x != ""), F.lit(0).cast("long"), lambda h, x: F.pmod(h * 31 + F.ascii(x), F.lit(2**32)))


def pick(c: Column, pool: int) -> Column:
    return F.pmod(hash31(c), F.lit(pool))


def split_plain(c: Column) -> Column:
    """Trimmed lines without blank ones and without [headers] or (headers)."""
    lines = F.transform(F.split(c, "\n"), strip)
    head = lambda x: (x.startswith("[") | x.startswith("(")) & (x.endswith("]") | x.endswith(")"))
    return F.filter(lines, lambda x: (x != "") & ~head(x))


def _first_wins(parts: Column) -> Column:
    low = F.transform(parts, F.lower)
    return F.filter(parts, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)


def split_artists(c: Column, limit: int = 6) -> Column:
    """Names in a credit, at most `limit`, without repeats."""
    parts = F.split(c, r"(?iU)\s*(?:,|&|\b(?:feat|ft|featuring|with|vs|x)\b\.?|/)\s*")
    return F.slice(_first_wins(F.filter(F.transform(parts, strip), lambda x: x != "")), 1, limit)


def split_artists_wide(c: Column) -> Column:
    """As split_artists with more separators (prod, and, ×, +) and no limit."""
    marked = F.regexp_replace(c, r"(?i)\s*\b(feat|ft|featuring|with|prod|vs|x|and)\b\.?\s*", "|")
    return _first_wins(F.filter(F.transform(F.split(marked, r"[|×,&+/]"), collapse), lambda x: x != ""))


def parse_track_line(c: Column) -> Column:
    """`artist - title` as a struct; without a separator only a title; null for a blank line."""
    line, parts = strip(c), F.split(strip(c), r"(?U)\s+[-–—]\s+", 2)
    two = F.size(parts) == 2
    return F.when(line != "", F.struct(F.when(two, strip(parts[0])).otherwise("").alias("artist"), F.when(two, strip(F.get(parts, F.lit(1)))).otherwise(line).alias("title")))


def guessed_title(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]+?)(\.[^.]*)?$", 1)


def worth_identifying(artist: Column, title: Column) -> Column:
    """Whether a pair of names looks like one made for a video site."""
    a, t = F.lower(strip(artist)), F.lower(strip(title))
    noisy = F.lit(False)
    for word in VIDEO_WORDS:
        noisy = noisy | F.contains(t, F.lit(word))
    channel = (a == "") | a.endswith("vevo") | a.endswith("records") | F.contains(a, F.lit("- topic"))
    return channel | ((t != "") & (noisy | F.startswith(t, F.concat(a, F.lit(" - "))) | F.contains(t, F.lit("|"))))


def is_mbid(c: Column) -> Column:
    return c.rlike("^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$")


def percent_encode(c: Column) -> Column:
    out = F.url_encode(c)
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def html_to_text(c: Column) -> Column:
    out = F.regexp_replace(F.regexp_replace(c, r"(?i)<br\s*/?>", "\n"), r"<[^>]+>", "")
    for a, b in ENTITIES:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def clean_lines(c: Column) -> Column:
    lines = F.transform(F.split(c, "\n"), lambda x: F.regexp_replace(x, r"(?U)\s+$", ""))
    return strip(F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n"))


def syllables(word: Column) -> Column:
    """Vowel groups, or letters less viramas in Devanagari and Gurmukhi; at least 1."""
    clean = F.regexp_replace(F.lower(word), r"[^\p{L}\p{N}\p{M}']", "")
    indic = F.regexp_count(clean, F.lit(r"\p{L}")) - F.regexp_count(clean, F.lit("[्੍]"))
    latin = F.regexp_count(clean, F.lit("[aeiouy]+"))
    return F.greatest(F.lit(1), F.when(clean.rlike(r"[\p{IsDevanagari}\p{IsGurmukhi}]"), indic).otherwise(latin)).cast("int")


def classify_mood(mood: Column, energy: Column) -> Column:
    text, out = F.lower(F.coalesce(mood, F.lit(""))), None
    for name, words in MOODS:
        hit = text.rlike(rf"(?<![A-Za-z0-9_])(?:{words})")
        out = F.when(hit, name) if out is None else out.when(hit, name)
    e = F.coalesce(energy, F.lit(0.4))
    return out.when(e >= 0.66, "energetic").when(e <= 0.3, "calm").otherwise("neutral")


def mood_profile(mood: Column, energy: Column) -> Column:
    """Struct key, motion, turbulence, flicker, warmth; energy moves motion about its base."""
    key, e = classify_mood(mood, energy), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(energy, F.lit(0.4))))

    def of(k: int) -> Column:
        return F.element_at(F.create_map(*[F.lit(x) for name, p in MOOD_PROFILES.items() for x in (name, p[k])]), key)

    motion = F.greatest(F.lit(0.4), F.least(F.lit(2.0), of(0) * (1 + (e - 0.4) * 0.5)))
    return F.struct(key.alias("key"), motion.alias("motion"), of(1).alias("turbulence"), of(2).alias("flicker"), of(3).alias("warmth"))


def hsl_hex(h: Column, s: Column, l: Column) -> Column:  # noqa: E741
    """#rrggbb of hue in degrees, saturation and lightness in percent."""
    s, l = s / 100, l / 100  # noqa: E741
    c = (1 - F.abs(2 * l - 1)) * s
    hp = F.pmod(h, F.lit(360.0)) / 60
    x, zero = c * (1 - F.abs(F.pmod(hp, F.lit(2.0)) - 1)), F.lit(0.0)
    side = F.floor(hp).cast("int")
    byte = lambda v: F.lpad(F.lower(F.hex(F.least(F.lit(255), F.greatest(F.lit(0), F.floor(F.round((v + l - c / 2) * 255 + 0.5, 6)))).cast("long"))), 2, "0")
    by_side = lambda *v: F.element_at(F.array(*v), side + 1)
    return F.concat(F.lit("#"), byte(by_side(c, x, zero, zero, x, c)), byte(by_side(x, c, c, x, zero, zero)), byte(by_side(zero, zero, x, c, c, x)))


def hue_towards(hue: Column, target: Column, amount: Column) -> Column:
    """The short way round."""
    delta = F.pmod(target - hue + 180, F.lit(360.0)) - 180
    return F.pmod(hue + delta * amount, F.lit(360.0))


def is_credit(c: Column) -> Column:
    return c.rlike("(?U)" + CREDITS[0]) | c.rlike("(?U)" + CREDITS[1])


def loose_json(c: Column) -> Column:
    """A JSON object as a variant: the whole text, else from its first { to its last }."""
    return F.coalesce(F.try_parse_json(c), F.try_parse_json(F.regexp_extract(c, r"(?s)\{.*\}", 0)))
