"""Queries of the text functions, over documents, pages, conversations and the names of parts and customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import lyrics
from .registry import Registry, table

_R = Registry()
QUERIES, SQL = _R.queries, _R.sql

#: Unicode white space, spelled out for an engine whose classes are ASCII.
_S = r"\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{_S}]+|[{_S}]+$', '', 'g')"


def _collapse(x: str) -> str:
    return _strip(f"regexp_replace({x}, '[{_S}]+', ' ', 'g')")


def _norm(x: str) -> str:
    return _collapse(f"regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}{_S}]', ' ', 'g')")


def _tokens(x: str) -> str:
    return f"list_distinct(list_filter(string_split({_norm(x)}, ' '), lambda t: t <> ''))"


@_R.add("t1_normalize", f"SELECT doc_id, {_norm('text')} AS normalized FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.normalize(F.col("text")).alias("normalized"))


_SIM = "CASE WHEN len(a) > 0 AND len(b) > 0 THEN len(list_intersect(a, b)) / greatest(len(a), len(b)) ELSE 0 END"


@_R.add("t2_token_similarity", f"""
WITH t AS (SELECT conv_id, turn, {_tokens('text')} AS a, {_tokens("coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn, role, text), '')")} AS b FROM conversations)
SELECT conv_id, turn, round({_SIM}, 6) AS similarity FROM t""")
def _(spark, sf):
    w = F.lag("text").over(_conv())
    t = table(spark, sf, "conversations").withColumn("before", F.coalesce(w, F.lit("")))
    return t.select("conv_id", "turn", F.round(T.token_similarity(F.col("text"), F.col("before")), 6).alias("similarity"))


def _conv():
    from pyspark.sql import Window

    return Window.partitionBy("conv_id").orderBy("turn", "role", "text")


_TITLE = "p_name || CASE p_partkey % 5 WHEN 0 THEN ' (Live)' WHEN 1 THEN ' [Official Video]' WHEN 2 THEN ' feat. ' || p_brand WHEN 3 THEN ' | ' || p_type ELSE ' Remix out now' END"


def titles(spark, sf):
    """Names of parts dressed up as titles."""
    return table(spark, sf, "part").withColumn("title", F.expr(_TITLE))


@_R.add("t3_version_tags", f"SELECT p_partkey, array_to_string(list_filter({list(T.VERSION_TOKENS)}, lambda v: list_contains({_tokens(_TITLE)}, v)), ',') AS tags FROM part")
def _(spark, sf):
    return titles(spark, sf).select("p_partkey", F.array_join(T.version_tags(F.col("title")), ",").alias("tags"))


def _clean_title(x: str) -> str:
    out = f"split_part({x}, '|', 1)"
    for p in T.TITLE_NOISE:
        out = f"regexp_replace({out}, '(?i){p}', ' ', 'g')"
    return f"""{_collapse(f"translate({out}, '\"`‘’“”' || chr(39), '       ')")}"""


@_R.add("t4_clean_title", f"SELECT p_partkey, coalesce(nullif({_clean_title(_TITLE)}, ''), {_strip(_TITLE)}) AS title FROM part")
def _(spark, sf):
    return titles(spark, sf).select("p_partkey", T.clean_title(F.col("title")).alias("title"))


_ARTIST = "c_name || CASE c_custkey % 4 WHEN 0 THEN ' - Topic' WHEN 1 THEN 'VEVO' WHEN 2 THEN 'vevo' ELSE ' - topic - Topic' END"


@_R.add("t5_clean_artist", f"""SELECT c_custkey, {_collapse(f"regexp_replace(regexp_replace({_ARTIST}, '(?i)^((?:.*- topic)?.*?)- topic[^-]*$', '\\1'), '(VEVO|vevo)$', '')")} AS artist FROM customer""")
def _(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", T.clean_artist(F.expr(_ARTIST)).alias("artist"))


_BYTES = "list_transform(range(0, length(h) // 2), lambda i: ('0x' || substr(h, (2 * i + 1)::BIGINT, 2))::HUGEINT)"


@_R.add("t6_track_key", f"""
WITH x AS (SELECT c_custkey, hex(encode(lower(trim(c_name)) || '|' || lower(trim(c_mktsegment)))) AS h FROM customer),
y AS (SELECT c_custkey, list_reduce({_BYTES}, lambda a, b: (a * 33 + b) % 18446744073709551616::HUGEINT, 5381::HUGEINT) AS v FROM x)
SELECT c_custkey, lower(lpad(printf('%X', (v // 4294967296)::BIGINT), 8, '0') || lpad(printf('%X', (v % 4294967296)::BIGINT), 8, '0')) AS track_key FROM y""")
def _(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", T.track_key(F.col("c_name"), F.col("c_mktsegment")).alias("track_key"))


@_R.add("t9_pick", """
SELECT page_id, list_reduce(list_transform(string_split(url, ''), lambda c: unicode(c)::BIGINT), lambda h, c: (h * 31 + c) % 4294967296, 0::BIGINT) % 24 AS choice FROM pages""")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.pick(F.col("url"), 24).alias("choice"))


@_R.add("t12_split_plain", f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw FROM documents), s AS (SELECT doc_id, {_strip('raw')} AS line FROM l)
SELECT doc_id, line, count(*)::BIGINT AS n FROM s WHERE line <> '' AND NOT (line[1] IN ('[', '(') AND line[-1] IN (']', ')')) GROUP BY ALL""")
def _(spark, sf):
    lines = table(spark, sf, "documents").select("doc_id", F.explode(T.split_plain(F.col("text"))).alias("line"))
    return lines.groupBy("doc_id", "line").agg(F.count("*").alias("n"))


_CREDIT = "p_name || ' feat. ' || p_brand || ' & ' || p_type || ', ' || upper(p_name) || ' x ' || p_size || ' and co'"
_DEDUPE = "list_filter(a, lambda x, i: list_position(list_transform(a, lambda y: lower(y)), lower(x)) = i)"


@_R.add("t14_split_artists", f"""
WITH s AS (SELECT p_partkey, list_filter(list_transform(regexp_split_to_array({_CREDIT}, '(?i)\\s*(?:,|&|\\b(?:feat|ft|featuring|with|vs|x)\\b\\.?|/)\\s*'), lambda x: trim(x)), lambda x: x <> '') AS a FROM part)
SELECT p_partkey, array_to_string(({_DEDUPE})[1:6], ';') AS artists FROM s""")
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.array_join(T.split_artists(F.expr(_CREDIT)), ";").alias("artists"))


@_R.add("t15_split_artists_wide", f"""
WITH s AS (SELECT p_partkey, list_filter(list_transform(regexp_split_to_array(regexp_replace({_CREDIT}, '(?i)\\s*\\b(feat|ft|featuring|with|prod|vs|x|and)\\b\\.?\\s*', '|', 'g'), '[|×,&+/]'), lambda x: trim(x)), lambda x: x <> '') AS a FROM part)
SELECT p_partkey, array_to_string({_DEDUPE}, ';') AS artists FROM s""")
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.array_join(T.split_artists_wide(F.expr(_CREDIT)), ";").alias("artists"))


_LINE = "c_name || CASE c_custkey % 4 WHEN 0 THEN ' - ' WHEN 1 THEN ' – ' WHEN 2 THEN '  —  ' ELSE '-' END || c_mktsegment || ' - II'"


@_R.add("t16_parse_track_line", f"""
WITH x AS (SELECT c_custkey, {_LINE} AS l FROM customer), y AS (SELECT *, regexp_extract(l, '^(.*?)\\s+[-–—]\\s+(.*)$', ['a', 't']) AS p, regexp_matches(l, '\\s+[-–—]\\s+') AS two FROM x)
SELECT c_custkey, CASE WHEN two THEN p.a ELSE '' END AS artist, CASE WHEN two THEN p.t ELSE l END AS title FROM y""")
def _(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", T.parse_track_line(F.expr(_LINE)).alias("x")).select("c_custkey", "x.*")


@_R.add("t17_guessed_title", "SELECT page_id, regexp_extract(url, '([^/\\\\]+?)(\\.[^.]*)?$', 1) AS title FROM pages")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.guessed_title(F.col("url")).alias("title"))


@_R.add("t18_worth_identifying", f"""
WITH x AS (SELECT p_partkey, lower(p_brand) AS a, lower({_TITLE}) AS t FROM part)
SELECT p_partkey, list_bool_or(list_transform({list(T.VIDEO_WORDS)}, lambda w: contains(t, w))) OR starts_with(t, a || ' - ') OR contains(t, '|')
  OR a = '' OR ends_with(a, 'vevo') OR ends_with(a, 'records') OR contains(a, '- topic') AS worth FROM x""")
def _(spark, sf):
    return titles(spark, sf).select("p_partkey", T.worth_identifying(F.col("p_brand"), F.col("title")).alias("worth"))


_MBID = "CASE WHEN page_id % 2 = 0 THEN url ELSE substr(md5(url), 1, 8) || '-' || substr(md5(url), 9, 4) || '-' || substr(md5(url), 13, 4) || '-' || substr(md5(url), 17, 4) || '-' || substr(md5(url), 21, 12) END"


@_R.add("t19_is_mbid", f"SELECT page_id, regexp_full_match({_MBID}, '[0-9A-Fa-f]{{8}}(-[0-9A-Fa-f]{{4}}){{3}}-[0-9A-Fa-f]{{12}}') AS mbid FROM pages")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.is_mbid(F.expr(_MBID)).alias("mbid"))


@_R.add("t23_percent_encode", "SELECT c_custkey, url_encode(c_name || ' * ~ é/' || c_mktsegment) AS encoded FROM customer")
def _(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", T.percent_encode(F.expr("c_name || ' * ~ é/' || c_mktsegment")).alias("encoded"))


def _plain(x: str) -> str:
    out = f"regexp_replace(regexp_replace({x}, '(?i)<br\\s*/?>', chr(10), 'g'), '<[^>]+>', '', 'g')"
    for a, b in T.ENTITIES:
        out = f"""replace({out}, '{a}', '{"''" if b == "'" else b}')"""
    return out


_LINES = f"list_transform(string_split({_plain('html')}, chr(10)), lambda x: regexp_replace(x, '[{_S}]+$', ''))"


@_R.add("t25_html_text", f"SELECT page_id, {_strip(f'''regexp_replace(array_to_string({_LINES}, chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g')''')} AS plain FROM pages")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.clean_lines(T.html_to_text(F.col("html"))).alias("plain"))


@_R.add("t27_syllables", f"""
WITH w AS (SELECT unnest(regexp_split_to_array(text, '[{_S}]+')) AS word FROM documents),
d AS (SELECT word, count(*)::BIGINT AS n, regexp_replace(lower(word), '[^\\p{{L}}\\p{{N}}\\p{{M}}'']', '', 'g') AS c FROM w WHERE word <> '' GROUP BY word)
SELECT word, n, greatest(1, CASE WHEN regexp_matches(c, '[\\p{{Devanagari}}\\p{{Gurmukhi}}]') THEN len(regexp_extract_all(c, '\\p{{L}}')) - len(regexp_extract_all(c, '[्੍]'))
  ELSE len(regexp_extract_all(c, '[aeiouy]+')) END)::INTEGER AS syllables FROM d""")
def _(spark, sf):
    words = table(spark, sf, "documents").select(F.explode(F.split("text", r"(?U)\s+")).alias("word")).where("word <> ''")
    return words.groupBy("word").agg(F.count("*").alias("n")).withColumn("syllables", T.syllables(F.col("word")))


_MOOD = "CASE " + " ".join(f"WHEN regexp_matches(lower(text), '\\b(?:{w})') THEN '{k}'" for k, w in T.MOODS) + " WHEN e >= 0.66 THEN 'energetic' WHEN e <= 0.3 THEN 'calm' ELSE 'neutral' END"
_PROFILES = ", ".join(f"('{k}', {', '.join(map(str, p))})" for k, p in T.MOOD_PROFILES.items())


@_R.add("t28_mood_profile", f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, (n_chars % 100) / 100.0::DOUBLE AS e FROM documents), k AS (SELECT doc_id, e, {_MOOD} AS key FROM d)
SELECT doc_id, k.key, round(greatest(0.4, least(2.0, m * (1 + (e - 0.4) * 0.5))), 6)::DOUBLE AS motion, p.t::DOUBLE AS turbulence, p.f::DOUBLE AS flicker, p.w::DOUBLE AS warmth
FROM k JOIN (VALUES {_PROFILES}) AS p(key, m, t, f, w) ON k.key = p.key""")
def _(spark, sf):
    p = table(spark, sf, "documents").select("doc_id", T.mood_profile(F.col("text"), F.col("n_chars") % 100 / 100).alias("p"))
    return p.select("doc_id", "p.*").withColumn("motion", F.round("motion", 6))


@_R.add("t30_palette", """
WITH e AS (SELECT event_id, (user_id * 37 + 11.5)::DOUBLE AS h, 0.6::DOUBLE AS s, (20 + event_id % 60) / 100.0::DOUBLE AS l FROM events),
c AS (SELECT *, (1 - abs(2 * l - 1)) * s AS c, (h % 360) / 60 AS hp FROM e), x AS (SELECT *, c * (1 - abs(hp % 2 - 1)) AS x, floor(hp)::INTEGER + 1 AS k, l - c / 2 AS m FROM c),
v AS (SELECT event_id, h, list_transform([[c, x, 0, 0, x, c][k], [x, c, c, x, 0, 0][k], [0, 0, x, c, c, x][k]], lambda q: lpad(lower(printf('%X', floor(round((q + m) * 255 + 0.5, 6))::BIGINT)), 2, '0')) AS b FROM x)
SELECT event_id, '#' || array_to_string(b, '') AS colour, round((((h + ((30 - h + 180) % 360 + 360) % 360 * 0.25 - 45) % 360) + 360) % 360, 6) AS warmer FROM v""")
def _(spark, sf):
    hue = F.col("user_id") * 37 + F.lit(11.5)
    colour = T.hsl_hex(hue, F.lit(60.0), 20.0 + F.col("event_id") % 60)
    return table(spark, sf, "events").select("event_id", colour.alias("colour"), F.round(T.hue_towards(hue, F.lit(30.0), F.lit(0.25)), 6).alias("warmer"))


@_R.add("t32_library_search", "SELECT p_partkey FROM part WHERE contains(lower(p_name || ' ' || p_brand), 'ring')")
def _(spark, sf):
    return table(spark, sf, "part").where(F.contains(F.lower(F.concat_ws(" ", "p_name", "p_brand")), F.lit("ring"))).select("p_partkey")


_STAMPED = "printf('[%02d:%02d.%02d]', turn // 15, (turn * 4) % 60, (turn * 17) % 100) || CASE WHEN turn % 3 = 2 THEN '' ELSE replace(text, chr(10), ' ') END"


def timed_texts(spark, sf):
    """A timed text per conversation: a stamped line per turn, every third without words."""
    line = F.expr("printf('[%02d:%02d.%02d]', turn div 15, (turn * 4) % 60, (turn * 17) % 100) || CASE WHEN turn % 3 = 2 THEN '' ELSE replace(text, '\n', ' ') END")
    t = table(spark, sf, "conversations").withColumn("line", line)
    return t.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "line"))), lambda x: x["line"]), "\n").alias("lrc"))


@_R.add("t10_parse_lrc", f"""
WITH l AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, {_STAMPED}) - 1 AS n,
  (turn // 15) * 60000 + (turn * 4) % 60 * 1000 + (turn * 17) % 100 * 10 AS t, CASE WHEN turn % 3 = 2 THEN '' ELSE {_strip("replace(text, chr(10), ' ')")} END AS body FROM conversations),
g AS (SELECT *, count(*) FILTER (body <> '') OVER (PARTITION BY conv_id ORDER BY t, n) AS g FROM l),
s AS (SELECT conv_id, g, max(t) FILTER (body <> '') AS t, max(body) FILTER (body <> '') AS body FROM g WHERE g > 0 GROUP BY ALL)
SELECT s.conv_id, row_number() OVER (PARTITION BY s.conv_id ORDER BY s.g) - 1 AS line_no, s.t::BIGINT AS time_ms,
  (SELECT min(b.t) FROM g b WHERE b.conv_id = s.conv_id AND b.g = s.g AND b.body = '' AND b.t > s.t)::BIGINT AS end_ms, s.body AS text FROM s""")
def _(spark, sf):
    return lyrics.parse_lrc(timed_texts(spark, sf), "conv_id", "lrc")


@_R.add("t13_strip_credits", f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents),
f AS (SELECT doc_id, min(n) AS first FROM l WHERE NOT regexp_matches(line, '{T.CREDITS[1]}') AND NOT regexp_matches(line, '{T.CREDITS[0]}') GROUP BY doc_id)
SELECT doc_id, count(*)::BIGINT AS lines, min(n)::BIGINT AS first FROM l JOIN f USING (doc_id) WHERE n >= first GROUP BY doc_id""")
def _(spark, sf):
    kept = lyrics.strip_credits(table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "text")), "doc_id")
    return kept.groupBy("doc_id").agg(F.count("*").alias("lines"), F.min("line_no").cast("long").alias("first"))


@_R.add("t33_line_energy", """
WITH c AS (SELECT conv_id, turn, turn * 4000 AS t, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn, role, text) * 4000 AS nt, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS w FROM conversations)
SELECT conv_id, turn, greatest(250, coalesce(nt, t + 3000) - t)::BIGINT AS duration_ms, round(least(1, w / (greatest(250, coalesce(nt, t + 3000) - t) / 1000.0) / 4.5), 6)::DOUBLE AS energy FROM c""")
def _(spark, sf):
    t = table(spark, sf, "conversations").withColumn("time_ms", F.col("turn") * 4000)
    return lyrics.line_energy(t, _conv()).select("conv_id", "turn", "duration_ms", F.round("energy", 6).alias("energy"))


@_R.add("a24_word_timing", """
WITH c AS (SELECT conv_id, turn, role, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '') AS ws FROM conversations),
u AS (SELECT conv_id, turn, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM c),
s AS (SELECT *, greatest(1, len(regexp_extract_all(lower(word), '[aeiouy]+'))) AS s FROM u),
w AS (SELECT *, greatest(s, 0.35::DOUBLE * avg(s) OVER (PARTITION BY conv_id, turn)) AS w FROM s)
SELECT conv_id, turn, i - 1 AS word_no, word, round(turn * 4000 + 4000 * coalesce(sum(w) OVER (PARTITION BY conv_id, turn ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(w) OVER (PARTITION BY conv_id, turn), 3) AS start_ms FROM w""")
def _(spark, sf):
    t = table(spark, sf, "conversations").withColumn("start_ms", F.col("turn") * 4000).withColumn("end_ms", F.col("start_ms") + 4000)
    return lyrics.word_timing(t).select("conv_id", "turn", "word_no", "word", F.round("start_ms", 3).alias("start_ms"))
