"""Queries of measurements on short signals (embeddings as samples, envelopes and curves), of hashes, page choices and loose JSON."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions import records as R
from ..functions import text as T
from ..operators import lyrics, matching
from ..operators import chunks as C
from ..operators import signal as S
from .matching import _clean, _sim
from .registry import Registry, table
from .texts import _BYTES, _TITLE, _strip, _tokens, timed_texts

_R = Registry()
QUERIES, SQL = _R.queries, _R.sql


@_R.add("t7_path_key", f"""WITH x AS (SELECT page_id, hex(encode(url)) AS h FROM pages),
y AS (SELECT page_id, list_reduce({_BYTES}, lambda a, b: (a * 33 + b) % 18446744073709551616::HUGEINT, 5381::HUGEINT) AS v FROM x)
SELECT page_id, lower(lpad(printf('%X', (v // 4294967296)::BIGINT), 8, '0') || lpad(printf('%X', (v % 4294967296)::BIGINT), 8, '0')) AS path_key FROM y""")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.djb2(F.col("url")).alias("path_key"))


@_R.add("t11_parse_plain", f"""WITH l AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n,
  (turn // 15) * 60000 + (turn * 4) % 60 * 1000 + (turn * 17) % 100 * 10 AS t, CASE WHEN turn % 3 = 2 THEN '' ELSE {_strip("replace(text, chr(10), ' ')")} END AS body FROM conversations WHERE turn < 1500)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY t, n) - 1 AS line_no, t::BIGINT AS time_ms, body AS text FROM l""")
def _(spark, sf):
    """Minutes of two digits at most; blank lines stay lines."""
    return lyrics.parse_lrc(timed_texts(spark, sf), "conv_id", "lrc", minute_digits=2, fold_blanks=False).drop("end_ms")


@_R.add("j9_page_pick", f"""WITH p AS (SELECT *, {_TITLE} AS title FROM part), h AS (SELECT p_partkey, unnest([1, 2, 3, 5, 8, 13]) AS ord FROM p),
k AS (SELECT w.p_partkey AS track, h.ord, f.p_partkey AS page, {_tokens(_clean('w.title'))} AS a, {_tokens('f.title')} AS b, {_tokens('w.p_type')} AS c, {_tokens('f.p_type')} AS d
  FROM h JOIN p w USING (p_partkey) JOIN p f ON f.p_partkey = h.p_partkey + h.ord)
SELECT track, page, round(2 * {_sim('a', 'b')} + {_sim('c', 'd')}, 6)::DOUBLE AS score FROM k WHERE 2 * {_sim('a', 'b')} + {_sim('c', 'd')} >= 0.9
QUALIFY row_number() OVER (PARTITION BY track ORDER BY 2 * {_sim('a', 'b')} + {_sim('c', 'd')} DESC, ord) = 1""")
def _(spark, sf):
    """Six hits a part, by keys: the join is on keys and grows with the table. A blank title is no hit."""
    p = table(spark, sf, "part").select("p_partkey", F.expr(_TITLE).alias("title"), "p_type")
    titles, types = p.select("title").distinct(), p.select(F.col("p_type").alias("type")).distinct()
    titles = titles.select("title", T.tokens(T.clean_title(F.col("title"))).alias("t"), T.tokens(F.col("title")).alias("ft"))
    p = p.join(titles, "title", "left").join(types.select("type", T.tokens(F.col("type")).alias("a")), F.col("p_type") == F.col("type"), "left").select("p_partkey", "title", "t", "ft", "a")
    hits = p.select(F.col("p_partkey").alias("track"), "t", "a", F.explode(F.array(*map(F.lit, (1, 2, 3, 5, 8, 13)))).alias("ord")).withColumn("page", F.col("track") + F.col("ord"))
    found = p.where(T.strip(F.col("title")) != "").select(F.col("p_partkey").alias("page"), "ft", F.col("a").alias("fa"))
    return matching.page_pick(hits.join(found, "page"), "track", "t", "a", "ft", "fa").select("track", "page", F.round("score", 6).alias("score"))


_ANSWER = """CASE event_id % 5 WHEN 0 THEN props WHEN 1 THEN 'Here it is: ' || props || ' as asked.' WHEN 2 THEN 'no object' WHEN 3 THEN '{broken ' || props || '}' ELSE replace('```json' || chr(10) || props || chr(10) || '```', '}', ', "n": {"m": 1}}') END"""


@_R.add("io19_loose_json", f"""WITH a AS (SELECT event_id, {_ANSWER} AS t FROM events), o AS (SELECT event_id, CASE WHEN json_valid(t) THEN t ELSE regexp_extract(t, '\\{{.*\\}}', 0, 's') END AS o FROM a)
SELECT event_id, CASE WHEN json_valid(o) THEN CAST(json_extract_string(o, '$.k') AS BIGINT) END AS k, CASE WHEN json_valid(o) THEN CAST(json_extract_string(o, '$.n.m') AS BIGINT) END AS m FROM o""")
def _(spark, sf):
    v = table(spark, sf, "events").select("event_id", T.loose_json(F.expr(_ANSWER.replace("chr(10)", "'\\n'"))).alias("v"))
    return v.select("event_id", F.try_variant_get("v", "$.k", "bigint").alias("k"), F.try_variant_get("v", "$.n.m", "bigint").alias("m"))


_LOW, _HIGH = (1 - math.exp(-2 * math.pi * hz / 1000) for hz in (K.LOW_HZ, K.HIGH_HZ))


@_R.add("s1_envelopes", f"""WITH RECURSIVE x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(1, len(embedding) + 1)) AS n FROM embeddings),
f AS (SELECT vec_id, 0::BIGINT AS n, 0::DOUBLE AS lo, 0::DOUBLE AS hi FROM embeddings
  UNION ALL SELECT f.vec_id, x.n, lo + {_LOW!r}::DOUBLE * (x - lo), hi + {_HIGH!r}::DOUBLE * (x - hi) FROM f JOIN x ON x.vec_id = f.vec_id AND x.n = f.n + 1),
w AS (SELECT vec_id, (n - 1) // 23 AS place, sqrt(avg(x * x)) AS level, sqrt(avg(lo * lo)) AS bass, sqrt(avg((x - hi) * (x - hi))) AS treble FROM f JOIN x USING (vec_id, n) GROUP BY ALL HAVING count(*) = 23),
m AS (SELECT *, max(greatest(level, bass, treble)) OVER (PARTITION BY vec_id) AS m FROM w)
SELECT vec_id, place, round(level / m, 6) AS level, round(bass / m, 6) AS bass, round(treble / m, 6) AS treble FROM m""")
def _(spark, sf):
    """Vectors as signals of 1000 samples a second: windows of 23 samples."""
    found = C.envelopes(C.cut_arrays(table(spark, sf, "embeddings"), "vec_id", "embedding", 1000, 30), "vec_id", 1000)
    return found.select("vec_id", "place", *[F.round(c, 6).alias(c) for c in ("level", "bass", "treble")])


@_R.add("s5_period", """WITH x AS (SELECT vec_id, abs(unnest(embedding))::DOUBLE AS e, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings),
q AS (SELECT vec_id, sum(e * e) AS energy, count(*) AS n FROM x GROUP BY vec_id),
r AS (SELECT a.vec_id, b.i - a.i AS k, sum(a.e * b.e) / count(*) * any_value(n) / any_value(energy) AS r FROM x a JOIN x b ON a.vec_id = b.vec_id AND b.i - a.i BETWEEN 6 AND 20 JOIN q ON q.vec_id = a.vec_id WHERE energy > 1e-9 AND n >= 40 GROUP BY ALL),
o AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY r * exp(-0.5::DOUBLE * pow(log2(60 * 20.0::DOUBLE / k / 120), 2)) DESC, k) = 1)
SELECT q.vec_id, k::DOUBLE AS frames, round(least(1, greatest(0, r)), 6) AS confidence FROM q LEFT JOIN o USING (vec_id)""")
def _(spark, sf):
    """Vectors as envelopes of 20 frames a second."""
    e = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", F.abs).alias("e"))
    return S.periods(e, "vec_id", "e", 20.0).select("vec_id", F.round("frames", 6).alias("frames"), F.round("confidence", 6).alias("confidence"))


@_R.add("s6_beat_grid", """WITH RECURSIVE x AS (SELECT vec_id, list_transform(embedding, lambda v: abs(v)::DOUBLE) AS e FROM embeddings),
f AS (SELECT vec_id, e, 0::BIGINT AS t, []::DOUBLE[] AS s, []::BIGINT[] AS b FROM x
  UNION ALL SELECT vec_id, e, t + 1, list_append(s, e[t + 1] + coalesce(o[k], 0)), list_append(b, coalesce(p[k], -1))
  FROM (SELECT *, list_position(o, list_max(o)) AS k FROM (SELECT *, list_transform(p, lambda j: s[j + 1] - 400 * pow(ln((t - j) / 6.0::DOUBLE), 2)) AS o FROM (SELECT *, range(greatest(0, t - 12), t - 2) AS p FROM f WHERE t < len(e))))),
l AS (SELECT vec_id, b, len(s) - 1 AS last, list_reverse(s[len(s) - 11:]) AS z FROM f WHERE t = len(e)),
w AS (SELECT vec_id, b, last + 1 - list_position(z, list_max(z)) AS place FROM l UNION ALL SELECT vec_id, b, b[place + 1] FROM w WHERE place >= 0)
SELECT vec_id, string_agg(place::VARCHAR, ',' ORDER BY place) AS beats FROM w WHERE place >= 0 GROUP BY vec_id""")
def _(spark, sf):
    """Vectors as envelopes in which a beat takes six frames."""
    e = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda v: F.abs(v).cast("double")).alias("e"))
    return S.beat_grids(e, "vec_id", "e", 6.0).select("vec_id", F.array_join(F.col("beats").cast("array<string>"), ",").alias("beats"))


@_R.add("s10_novelty", """WITH x AS (SELECT vec_id // 100 AS item, vec_id % 100 AS i, embedding::DOUBLE[] AS v FROM embeddings), n AS (SELECT item, count(*) AS n FROM x GROUP BY item),
p AS (SELECT a.item, a.i AS a, b.i AS b, list_dot_product(a.v, b.v) / greatest(sqrt(list_dot_product(a.v, a.v)), 1e-12) / greatest(sqrt(list_dot_product(b.v, b.v)), 1e-12) AS c FROM x a JOIN x b ON a.item = b.item AND abs(a.i - b.i) < 64),
k AS (SELECT unnest(range(-32, 32)) AS d), o AS (SELECT x.item, x.i, ka.d + 0.5::DOUBLE AS u, kb.d + 0.5::DOUBLE AS w, x.i + ka.d AS a, x.i + kb.d AS b FROM x JOIN n USING (item), k ka, k kb WHERE x.i >= 32 AND x.i < n - 32),
s AS (SELECT o.item, o.i, sum(c * exp(-(u * u + w * w) / 512) * sign(u) * sign(w)) AS s FROM o JOIN p ON p.item = o.item AND p.a = o.a AND p.b = o.b GROUP BY ALL)
SELECT item, i, round(greatest(0, coalesce(s, 0)), 6)::DOUBLE AS novelty FROM x LEFT JOIN s USING (item, i)""")
def _(spark, sf):
    """A hundred vectors in turn are an item's frames."""
    e = table(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / 100).alias("item"), (F.col("vec_id") % 100).alias("i"), "embedding")
    return S.novelties(e, "item", "i", "embedding").withColumn("novelty", F.round("novelty", 6))


@_R.add("s11_peaks", """WITH RECURSIVE x AS (SELECT vec_id, abs(unnest(embedding))::DOUBLE AS v, unnest(range(0, len(embedding))) AS i FROM embeddings),
n AS (SELECT *, avg(v) OVER (PARTITION BY vec_id) + stddev_pop(v) OVER (PARTITION BY vec_id) AS least, lag(v) OVER w AS a, lead(v) OVER w AS b FROM x WINDOW w AS (PARTITION BY vec_id ORDER BY i)),
c AS (SELECT vec_id, coalesce(list(i ORDER BY v DESC, i) FILTER (v > least AND v >= a AND v > b), []) AS c FROM n GROUP BY vec_id),
f AS (SELECT vec_id, []::BIGINT[] AS kept, c FROM c UNION ALL SELECT vec_id, list_append(kept, c[1]), list_filter(c, lambda y: abs(y - c[1]) >= 6) FROM f WHERE len(c) > 0)
SELECT vec_id, array_to_string(list_sort(kept), ',') AS places FROM f WHERE len(c) = 0""")
def _(spark, sf):
    c = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda v: F.abs(v).cast("double")).alias("c"))
    return S.peaks(c, "vec_id", "c", 6).select("vec_id", F.array_join(F.col("places").cast("array<string>"), ",").alias("places"))


@_R.add("s16_resample_linear", """WITH x AS (SELECT vec_id, embedding::DOUBLE[] AS x, unnest(range(floor(len(embedding) * 12000 / 8000 + 0.5)::BIGINT)) AS i FROM embeddings),
p AS (SELECT *, i * 8000 / 12000::DOUBLE AS p, len(x) AS n FROM x)
SELECT vec_id, i, round(CASE WHEN p >= n - 1 THEN x[n] ELSE x[floor(p)::BIGINT + 1] * (1 - p + floor(p)) + x[floor(p)::BIGINT + 2] * (p - floor(p)) END, 5) AS v FROM p""")
def _(spark, sf):
    x = table(spark, sf, "embeddings").select("vec_id", F.posexplode(S.resample_linear(F.col("embedding"), 8000, 12000)).alias("i", "v"))
    return x.select("vec_id", F.col("i").cast("long").alias("i"), F.round("v", 5).alias("v"))


@_R.add("s17_resample_nearest", """WITH x AS (SELECT vec_id, embedding AS x, unnest(range(len(embedding) * 6000 // 8000)) AS i FROM embeddings)
SELECT vec_id, i, round(x[i * 8000 // 6000 + 1]::DOUBLE, 5) AS v FROM x""")
def _(spark, sf):
    x = table(spark, sf, "embeddings").select("vec_id", F.posexplode(S.resample_nearest(F.col("embedding"), 8000, 6000)).alias("i", "v"))
    return x.select("vec_id", F.col("i").cast("long").alias("i"), F.round(F.col("v").cast("double"), 5).alias("v"))


@_R.add("s20_segments", """WITH x AS (SELECT vec_id, len(embedding) AS n, unnest(embedding)::DOUBLE AS v, unnest(range(len(embedding))) AS i FROM embeddings),
g AS (SELECT DISTINCT vec_id, unnest(range(0, greatest(1, n - 5), 15)) AS g FROM x), p AS (SELECT vec_id, i, i - g AS k, sum(v) OVER (PARTITION BY vec_id, g ORDER BY i) AS v FROM x JOIN g USING (vec_id) WHERE i >= g AND i < g + 20),
w AS (SELECT *, CASE WHEN k < 5 THEN k / 4.0::DOUBLE WHEN k >= 15 THEN (19 - k) / 4.0::DOUBLE ELSE 1 END AS w FROM p)
SELECT vec_id, i, round(sum(v * w) / greatest(sum(w), 1e-8), 6) AS v FROM w GROUP BY ALL""")
def _(spark, sf):
    """Running sums of segments of 20 samples that overlap by 5."""
    x = S.through_segments(table(spark, sf, "embeddings"), "vec_id", "embedding", lambda part: part.cumsum(), 20, 5)
    return x.select("vec_id", F.posexplode("embedding").alias("i", "v")).select("vec_id", F.col("i").cast("long").alias("i"), F.round("v", 6).alias("v"))


@_R.add("w5_levels", """WITH RECURSIVE x AS (SELECT vec_id // 16 AS frame, vec_id % 16 * 64 + unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings),
b AS (SELECT frame, i, v * (0.42::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * i / 1023) + 0.08::DOUBLE * cos(4 * pi() * i / 1023)) AS v FROM x), k AS (SELECT unnest(range(512)) AS k),
d AS (SELECT frame, k, sqrt(pow(sum(v * cos(2 * pi() * (i * k % 1024) / 1024)), 2) + pow(sum(v * sin(2 * pi() * (i * k % 1024) / 1024)), 2)) AS m FROM b, k GROUP BY ALL),
w AS (SELECT frame FROM x GROUP BY frame HAVING count(*) = 1024),
m AS (SELECT frame // 8 AS recording, frame, row_number() OVER (PARTITION BY frame // 8 ORDER BY frame) AS n, list(m ORDER BY k) AS m FROM d WHERE frame IN (SELECT frame FROM w) GROUP BY frame),
f AS (SELECT recording, 0::BIGINT AS n, -1::BIGINT AS frame, list_transform(range(512), lambda k: 0::DOUBLE) AS h, 0.0005::DOUBLE AS top FROM m GROUP BY recording
  UNION ALL SELECT recording, n, frame, h, CASE WHEN list_max(h) > top THEN list_max(h) ELSE 0.985::DOUBLE * top END
  FROM (SELECT m.recording, m.n, m.frame, list_transform(range(1, 513), lambda k: 0.55::DOUBLE * h[k] + (1 - 0.55::DOUBLE) * m.m[k]) AS h, top FROM f JOIN m ON m.recording = f.recording AND m.n = f.n + 1))
SELECT recording, frame, array_to_string(list_transform(h, lambda v: floor(least(255, v / greatest(top, 0.0005::DOUBLE) * 255))::INTEGER), ',') AS levels FROM f WHERE n > 0""")
def _(spark, sf):
    """Sixteen vectors in turn are a frame of 1,024 samples, eight frames a recording."""
    e = table(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / 16).alias("frame"), "vec_id", "embedding")
    frames = e.groupBy("frame").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))), lambda x: x["embedding"])).alias("samples"))
    shown = S.spectra(frames.withColumn("recording", F.floor(F.col("frame") / 8)), "recording", "frame", "samples")
    return shown.select("recording", "frame", F.array_join(F.col("levels").cast("array<string>"), ",").alias("levels"))


@_R.add("m7_frame_ms", "SELECT event_id, (event_id % 1500 * 20)::INTEGER AS ms FROM events")
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", R.frame_ms(F.col("event_id") % 1500).alias("ms"))
