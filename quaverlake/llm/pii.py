"""Personal data by bootstrapped contextual extraction (native).

Base identifiers (four fixed patterns) seed the search, and so do hexadecimal keys for the
kind `secret`, which has no base pattern. Each identifier has five lexical patterns, from
narrow to wide: the words on both sides, two words before, one word before, one word behind,
and its own shape (digits as 9, letters as a). Patterns and the identifier-like tokens in
them form a bipartite graph. A pattern is as good as the share of its distinct values that
are known to be of a kind (values that could be, but aren't known, count UNSURE against it);
a value that trusted patterns extract becomes known itself (noisy or of its patterns) and
teaches further patterns, but no shapes. This goes on until a round adds no value. Tokens in a trusted
pattern that look like its kind are added to the base spans.

Tokens are digit groups joined by single signs, addresses with (at), and words that hold a
digit or an at sign, without the signs around them. A card must pass Luhn here too. Words
count whole; words with digits are `#`, ends of the text `^`. Patterns and values are held
as 64-bit hashes, so long words cost nothing.

Defined cases: a null text is empty and has no spans, a null doc_id is kept, repeated rows
each get their result, an empty table gives no rows; a very long text of n tokens takes n^(4/3)
steps (places are sums of blocks, overlaps are found by sorting). Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialize, null_safe_text, packed, read_table, unpacked

KINDS = ("email", "ip", "card", "phone")
#: Kinds that spans may have; the last has no base pattern.
ALL_KINDS = (*KINDS, "secret")
# The contract's patterns. Possessive repeats and look-behinds only stop
# searches that can't succeed; \G admits a match right after the one before.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Tokens that may be identifiers: short digit groups joined by single signs; written-out addresses; words with a digit or an at sign.
TOKEN = (
    r"(?<![\p{L}0-9.@+(-])\+?\(?[0-9]{1,5}+\)?(?:[\x20.-]\(?[0-9]{1,5}+\)?){2,7}+(?![\p{L}0-9@])"
    r"|(?<![\p{L}0-9._%+-])[\p{L}0-9._%+-]++\x20?[\[(]at[\])]\x20?[\p{L}0-9-]++(?:\x20?(?:\.|[\[(]dot[\])])\x20?[\p{L}0-9-]++)*+"
    r"|(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
)
MAYBE = r"[0-9@]|[\[(]at[\])]"
# What a token must look like to be taken for a kind, and what seeds `secret`.
SHAPES = {
    "email": r"^[^@\s]+(?:@|\x20?[\[(]at[\])]\x20?)[^@\s]+(?:\x20?[\[(]dot[\])]\x20?[^@\s]+)*$",
    "ip": r"^(?:[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}|(?=.*:.*:)[0-9A-Fa-f:]{3,39})$",
    "card": r"^[0-9](?:[\x20-]?[0-9]){11,18}$",
    "phone": r"^(?=(?:[^0-9]*[0-9]){7,15}[^0-9]*$)[+(]?[0-9][\x20().0-9-]+$",
    "secret": r"^(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9_+/=.-]{16,}$",
}
SECRET_SEED = r"^(?=.*[0-9])(?=.*[a-f])[0-9a-f]{32,}$"
#: Per pattern (both sides, two before, one before, one behind, shape): distinct known values that it needs, and the least share.
#: It also needs SUPPORT_SHARE of all the values that are known of its kind, so that chance contexts don't come to be trusted as seeds grow.
SUPPORT = (6, 6, 16, 32, 4)
SUPPORT_SHARE = 0.0005
SCORE = (0.75, 0.75, 0.85, 0.9, 0.8)
#: Only base identifiers teach shapes: a value that was found by its context would make all of its shape known.
SHAPE = 4
#: What a value counts against a pattern that could be of its kind, but isn't known to be.
UNSURE = 0.1
#: Rounds end when nothing is new; as many without an end are an error.
MAX_ROUNDS = 60
#: Code points of a text that are redacted at once.
PIECE = 4096

_BASE = "array<struct<start:bigint,ord:int,end:bigint,kind:string,v:bigint,pats:array<bigint>>>"
_TOKENS = "array<struct<start:bigint,end:bigint,v:bigint,fits:int,seed:int,pats:array<bigint>>>"
_SPANS = "array<struct<start:bigint,ord:int,end:bigint,kind:string>>"


# --- expressions

def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once however often it is named."""
    return F.get(F.transform(F.array(value), then), 0)


def _sums_before(sizes: Column) -> Column:
    """For each element of an array of longs the sum of those before it. A fold would copy the list at each step; sums of blocks don't."""
    zero = F.lit(0).cast("bigint")

    def total(items: Column, first: Column, n: Column) -> Column:
        return F.aggregate(F.slice(items, first, n), zero, lambda a, x: a + x)

    def of(x: Column) -> Column:
        def by_block(width: Column) -> Column:
            sums = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / width).cast("int")), lambda b: total(x, b * width + 1, width))
            return _let(sums, lambda s: _let(F.transform(s, lambda _, b: total(s, F.lit(1), b)), lambda skip: F.transform(x, lambda _, i: F.get(skip, F.floor(i / width).cast("int")) + total(x, (i - i % width + 1), i % width))))

        return _let((F.cbrt(2.0 * F.size(x)) + 32).cast("int"), by_block)

    return _let(sizes, of)


def _counts_before(places: Column, marks: Column, closed: bool) -> Column:
    """For each of the rising marks how many places lie before it (closed: or at it), by sorting both together."""
    tie = 1 if closed else -1
    both = F.concat(
        F.transform(places, lambda p: F.struct(p.alias("at"), F.lit(0).alias("tie"), F.lit(-1).alias("i"))),
        F.transform(marks, lambda m, i: F.struct(m.alias("at"), F.lit(tie).alias("tie"), i.alias("i"))),
    )
    ranked = F.transform(F.array_sort(both), lambda x, rank: F.struct(x["i"].alias("i"), (rank - x["i"]).alias("n")))
    return F.transform(F.filter(ranked, lambda x: x["i"] >= 0), lambda x: x["n"])


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: F.regexp_like(p, F.lit("^0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$")))
    if kind == "card":
        return F.length(digits).between(12, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _maybe(kind: str, text: Column) -> Column:
    """A cheap test that fails only where the pattern can't match."""
    if kind == "email":
        return F.contains(text, F.lit("@"))
    if kind == "phone":
        return F.contains(text, F.lit("+"))
    if kind == "card":
        return F.regexp_like(text, F.lit(r"[0-9][\x20-]?[0-9]"))
    return F.regexp_like(text, F.lit(r"[0-9]\.[0-9]"))


_MATCHES = "array<struct<start:bigint,ord:int,value:string,before:string,behind:string,first:boolean,last:boolean>>"


def _located(text: Column, pattern: str, maybe: Column, ord_: int = 0) -> Column:
    """All matches with their places and the pieces of text at their sides."""
    def placed(found: Column) -> Column:
        n = F.size(found)

        def joined(pieces: Column) -> Column:
            gaps = F.transform(found, lambda m, i: (F.length(F.get(pieces, i)) + F.when(i == 0, 0).otherwise(F.length(F.get(found, i - 1)))).cast("bigint"))
            return _let(gaps, lambda g: _let(_sums_before(g), lambda at: F.transform(found, lambda m, i: F.struct(
                F.get(at, i) + F.get(g, i), F.lit(ord_), m, F.get(pieces, i), F.get(pieces, i + 1), i == 0, i == n - 1)).cast(_MATCHES)))

        return F.when(n > 0, _let(F.split(text, pattern, -1), joined))

    return F.coalesce(_let(F.when(maybe, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))), placed), F.array().cast(_MATCHES))


def _norm(word: Column, edge: Column) -> Column:
    plain = lambda w: F.when(w == "", edge).when(F.regexp_like(w, F.lit("[0-9@]")), "#").otherwise(F.regexp_replace(F.lower(w), r"[^\p{L}=:]++", ""))
    return F.coalesce(F.nullif(_let(word, plain), F.lit("")), F.lit("#"))


def _patterns(value: Column, before: Column, behind: Column, first: Column, last: Column, mark: Column) -> Column:
    """Hashes of the five patterns of a value between two pieces of text."""
    edge = lambda at_end: F.when(at_end, "^").otherwise("#")
    shape = F.concat(F.regexp_replace(F.regexp_replace(value, r"\p{L}++", "a"), "[0-9]", "9"), mark)

    def of(back: Column) -> Column:
        words = F.struct(
            _norm(F.reverse(F.regexp_extract(back, r"^\s*+(\S++)", 1)), edge(first)).alias("l1"), _norm(F.reverse(F.regexp_extract(back, r"^\s*+\S++\s++(\S++)", 1)), edge(first)).alias("l2"),
            _norm(F.regexp_extract(behind, r"^\s*+(\S++)", 1), edge(last)).alias("r1"),
        )
        return _let(words, lambda w: F.array(F.xxhash64(w["l1"], F.lit(" _ "), w["r1"]), F.xxhash64(w["l2"], F.lit(" "), w["l1"], F.lit(" _")), F.xxhash64(w["l1"], F.lit(" _")), F.xxhash64(F.lit("_ "), w["r1"]), F.xxhash64(shape)))

    return _let(F.reverse(before), of)


def base_spans(text: Column) -> Column:
    """All base spans of a text, ordered by start and kind: array of (start, ord, end, kind, v, pats)."""
    def one(m: Column) -> Column:
        mark = F.when(m["ord"] == KINDS.index("card"), "+").otherwise("")
        pats = _patterns(m["value"], m["before"], m["behind"], m["first"], m["last"], mark)
        return F.struct(m["start"], m["ord"], m["start"] + F.length(m["value"]), F.get(F.array(*map(F.lit, KINDS)), m["ord"]), F.xxhash64(m["value"]), pats)

    def valid(k: int, kind: str) -> Column:
        return F.filter(_located(text, PATTERNS[kind], _maybe(kind, text), k), lambda m: _valid(kind, m["value"]))

    return F.transform(F.array_sort(F.concat(*(valid(k, kind) for k, kind in enumerate(KINDS)))), one).cast(_BASE)


def _fits(value: Column) -> Column:
    """Bits of the kinds that a value may be of."""
    def bit(k: int, kind: str) -> Column:
        fine = F.regexp_like(value, F.lit(SHAPES[kind]))
        return F.when(fine & _valid(kind, value) if kind == "card" else fine, 1 << k).otherwise(0)

    return sum((bit(k, kind) for k, kind in enumerate(ALL_KINDS)), F.lit(0)).cast("int")


def tokens_of(text: Column) -> Column:
    """Identifier-like tokens without the signs around them: array of (start, end, v, fits, seed, pats)."""
    def one(m: Column) -> Column:
        lead = F.length(F.regexp_extract(m["value"], r"^[^\p{L}0-9+(@]*+", 0))
        tail = F.length(F.regexp_extract(F.reverse(m["value"]), r"^[^\p{L}0-9)@]*+", 0))

        def cut(c: Column) -> Column:
            core = F.substring(m["value"], c["lead"] + 1, F.greatest(F.length(m["value"]) - c["lead"] - c["tail"], F.lit(0)))

            def of(value: Column) -> Column:
                fits = _fits(value)
                start = m["start"] + c["lead"]
                mark = F.when(fits.bitwiseAND(F.lit(1 << 2)) != 0, "+").otherwise("")
                seed = F.when(F.regexp_like(value, F.lit(SECRET_SEED)), 1 << 4).otherwise(0)
                pats = _patterns(value, m["before"], m["behind"], m["first"], m["last"], mark)
                return F.struct(start, start + F.length(value), F.xxhash64(value), fits, seed, pats)

            return _let(core, of)

        return _let(F.struct(lead.alias("lead"), tail.alias("tail")), cut)

    return F.filter(F.transform(_located(text, TOKEN, F.regexp_like(text, F.lit(MAYBE))), one).cast(_TOKENS), lambda t: t["end"] > t["start"])


def _free(tokens: Column, base: Column) -> Column:
    """Tokens that no base span overlaps: as many base spans begin before their ends as end before their starts."""
    def of(t: Column) -> Column:
        begun = _counts_before(F.transform(base, lambda b: b["start"]), F.transform(t, lambda x: x["end"]), closed=False)
        over = _counts_before(F.transform(base, lambda b: b["end"]), F.transform(t, lambda x: x["start"]), closed=True)
        return _let(F.struct(begun.alias("begun"), over.alias("over")), lambda n: F.filter(t, lambda _, i: F.get(n["begun"], i) == F.get(n["over"], i)))

    return F.when((F.size(base) == 0) | (F.size(tokens) == 0), tokens).otherwise(_let(tokens, of))


def scan(df: DataFrame, text: str = "text") -> DataFrame:
    """df plus __h (a hash of the text), __base and __tokens (those that no base span overlaps). No shuffle."""
    body = null_safe_text(text)
    found = df.withColumns({"__h": F.xxhash64(body), "__base": base_spans(body), "__tokens": tokens_of(body)})
    return found.withColumn("__tokens", _free(F.col("__tokens"), F.col("__base")))


# --- the graph

def _bits(mask: str) -> Column:
    """Numbers of the bits that are set."""
    return F.array_compact(F.array(*[F.when(F.col(mask).bitwiseAND(F.lit(1 << k)) != 0, F.lit(k)) for k in range(len(ALL_KINDS))]))


def _may_be() -> Column:
    return F.call_function("shiftright", F.col("fits"), F.col("kind")).bitwiseAND(F.lit(1)) == 1


def _of_pattern(values: tuple) -> Column:
    return F.get(F.array(*map(F.lit, values)), F.col("g"))


def graph(scanned: DataFrame, hidden: Column | None = None) -> DataFrame:
    """(g, p, v, fits, seed) of a written scan(): g is which of the five patterns, p its hash, v a value's; fits and seed are
    bits of the kinds that v may be of and is known to be of. Values for which `hidden` holds aren't known."""
    seeds = scanned.select(F.explode("__base").alias("s")).select("s.v", F.call_function("shiftleft", F.lit(1), F.col("s.ord")).alias("fits"), F.posexplode("s.pats").alias("g", "p")).withColumn("seed", F.col("fits"))
    tokens = scanned.select(F.explode("__tokens").alias("s")).select("s.v", "s.fits", "s.seed", F.posexplode("s.pats").alias("g", "p"))
    both = seeds.unionByName(tokens)
    if hidden is not None:
        both = both.withColumn("seed", F.when(hidden, F.lit(0)).otherwise(F.col("seed")))
    return both.groupBy("g", "p", "v").agg(F.bit_or("fits").alias("fits"), F.bit_or("seed").alias("seed"))


def learn(edges: DataFrame) -> DataFrame:
    """Trusted patterns (g, p, kind, conf) of a written graph()."""
    spark = edges.sparkSession
    may = [F.sum(F.shiftright("fits", k).bitwiseAND(F.lit(1))).alias(f"f{k}") for k in range(len(ALL_KINDS))]
    totals = materialize(edges.groupBy("g", "p").agg(F.count("*").alias("n"), *may).where(F.col("n") >= _of_pattern(SUPPORT)), "pii-totals")
    kept = materialize(edges.join(totals.select("g", "p"), ["g", "p"], "left_semi"), "pii-graph")  # others never reach their support
    seeds = dict(edges.where("seed > 0").select("v", F.explode(_bits("seed")).alias("kind")).distinct().groupBy("kind").count().collect())  # five rows
    least = F.greatest(_of_pattern(SUPPORT), F.get(F.array(*[F.lit(int(SUPPORT_SHARE * seeds.get(k, 0))) for k in range(len(ALL_KINDS))]), F.col("kind")))
    known = kept.where("seed > 0").select("g", "p", F.explode(_bits("seed")).alias("kind"), F.lit(1.0).alias("score"))
    able = F.get(F.array(*[F.col(f"f{k}") for k in range(len(ALL_KINDS))]), F.col("kind"))
    gained = spark.createDataFrame([], "v long, kind int, score double")
    old: list[DataFrame] = []
    for _ in range(MAX_ROUNDS):
        scored = known.unionByName(kept.where(F.col("g") != SHAPE).join(gained, "v").where(_may_be()).select("g", "p", "kind", "score")) if old else known
        patterns = scored.groupBy("g", "p", "kind").agg(F.sum("score").alias("pos"), F.count("*").alias("support"))
        unsure = F.greatest(able - F.col("support"), F.lit(0))
        patterns = patterns.join(totals, ["g", "p"]).select("g", "p", "kind", "support", (F.col("pos") / (F.col("support") + UNSURE * unsure + (F.col("n") - able) + 1)).alias("conf"))
        patterns = materialize(patterns.where((F.col("support") >= least) & (F.col("conf") >= _of_pattern(SCORE))), "pii-patterns")
        hits = kept.where("seed = 0").join(patterns, ["g", "p"]).where(_may_be())
        new = hits.groupBy("v", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.col("conf"))))).alias("score")).join(gained, ["v", "kind"], "left_anti")
        new = materialize(new, "pii-values")
        if new.isEmpty():
            for t in (*old, new, kept, totals):
                discard(t)
            return patterns.select("g", "p", "kind", "conf")
        old += [new, patterns]
        gained = new if len(old) == 2 else gained.unionByName(new)
    raise RuntimeError("patterns did not settle")


def discovered(scanned: DataFrame, key: str) -> DataFrame:
    """Per (key, __h) as (__d, __g): the spans that the learned patterns add, as array of (start, ord, end, kind), and how many
    of them the pattern of secrets seeded."""
    edges = materialize(graph(scanned), "pii-edges")
    patterns = learn(edges)
    discard(edges)
    tokens = scanned.where(F.size("__tokens") > 0).select(F.col(key).alias("__d"), F.col("__h").alias("__g"), F.explode("__tokens").alias("t"))
    tokens = tokens.where("t.fits > 0").select("__d", "__g", "t.start", "t.end", "t.fits", "t.seed", F.posexplode("t.pats").alias("g", "p"))
    hits = tokens.join(patterns, ["g", "p"]).where(_may_be())
    best = hits.groupBy("__d", "__g", "start", "end").agg(F.max(F.struct("conf", -F.col("kind"))).alias("best"), F.max("seed").alias("seed"))  # a token has one kind
    ord_ = (-F.col("best.col2")).cast("int")
    span = F.struct("start", ord_.alias("ord"), "end", F.get(F.array(*map(F.lit, ALL_KINDS)), ord_).alias("kind"))
    seeded = F.call_function("shiftright", F.col("seed"), ord_).bitwiseAND(F.lit(1)).cast("long")
    one = best.groupBy("__d", "__g", span.alias("span")).agg(F.max(seeded).alias("seeded"))  # repeated rows have the same spans
    return one.groupBy("__d", "__g").agg(F.collect_list("span").alias("__added"), F.sum("seeded").alias("__seeded"))


def held_back(df: DataFrame, text: str = "text", share: int = 2) -> DataFrame:
    """A row for each base kind: n_hidden of its distinct values are hidden from learn() (one in `share`, by hash), n_found of them
    are in a trusted pattern of their kind and n_wrong other values are that may be of it."""
    scanned = materialize(scan(df, text).select("__base", "__tokens"), "pii-scan")
    hidden = F.pmod(F.xxhash64("v", F.lit("hidden")), F.lit(share)) == 0
    edges = materialize(graph(scanned, hidden), "pii-edges")
    base = scanned.select(F.explode("__base").alias("s")).select("s.v", F.col("s.ord").alias("kind")).distinct()
    hits = edges.where("seed = 0").join(learn(edges), ["g", "p"]).where(_may_be()).select("v", "kind").distinct()
    state = base.withColumn("hidden", hidden).join(hits.withColumn("hit", F.lit(True)), ["v", "kind"], "full")
    state = state.where(F.col("hidden") | (F.col("hidden").isNull() & (F.col("kind") < len(KINDS))))
    name = F.get(F.array(*map(F.lit, KINDS)), F.col("kind"))
    return state.groupBy(name.alias("kind")).agg(F.count_if("hidden").alias("n_hidden"), F.count_if(F.col("hidden") & F.col("hit")).alias("n_found"), F.count_if(F.col("hidden").isNull()).alias("n_wrong"))


def _with_spans(df: DataFrame, key: str, text: str, keep_text: bool = True) -> DataFrame:
    """df plus __base and __spans as arrays of (start, ord, end, kind). Texts are scanned once."""
    found = scan(df, text)
    scanned = materialize(found if keep_text else found.drop(text), "pii-scan")
    added = materialize(discovered(scanned, key), "pii-added")
    rows = scanned.drop("__tokens").join(added, F.col(key).eqNullSafe(F.col("__d")) & (F.col("__h") == F.col("__g")), "left")
    rows = rows.withColumn("__base", F.transform("__base", lambda s: F.struct(s["start"].alias("start"), s["ord"].alias("ord"), s["end"].alias("end"), s["kind"].alias("kind"))).cast(_SPANS))
    return rows.withColumn("__spans", F.when(F.col("__added").isNull(), F.col("__base")).otherwise(F.array_sort(F.concat("__base", F.col("__added").cast(_SPANS)))))


def find_pii(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, base and spans as arrays of (start, ord, end, kind); spans hold the added ones too, of which n_seeded are
    secrets that their own pattern knows, so that context only confirms them."""
    rows = _with_spans(df.select(F.col(key).alias("doc_id"), F.col(text).alias("__text")), "doc_id", "__text", keep_text=False)
    return rows.select("doc_id", F.col("__base").alias("base"), F.col("__spans").alias("spans"), F.coalesce("__seeded", F.lit(0)).cast("long").alias("n_seeded"))


def _merged(spans: Column) -> Column:
    """Spans in order with overlapping ones made one, of the first one's kind: array of (start, end, kind)."""
    def of(x: Column) -> Column:
        over = _counts_before(F.transform(x, lambda s: s["end"]), F.transform(x, lambda s: s["start"]), closed=True)
        fresh = F.filter(F.transform(over, lambda n, i: F.when(n == i, i)), lambda i: i.isNotNull())  # all spans before are over

        def joined(first: Column) -> Column:
            def one(i: Column, j: Column) -> Column:
                own = F.slice(x, i + 1, F.coalesce(F.get(first, j + 1), F.size(x)) - i)
                return F.struct(F.get(x, i)["start"].alias("start"), F.array_max(F.transform(own, lambda s: s["end"])).alias("end"), F.get(x, i)["kind"].alias("kind"))

            return F.transform(first, one)

        return _let(fresh, joined)

    return _let(spans, of)


def _redacted(body: Column, spans: Column) -> Column:
    """body with [KIND] for each span, a piece of PIECE code points at a time."""
    def piece(merged: Column):
        def of(text: Column, i: Column) -> Column:
            low = (i * PIECE).cast("bigint")
            own = F.filter(merged, lambda s: (s["start"] < low + PIECE) & (s["end"] > low))

            def step(a: Column, s: Column) -> Column:
                tag = F.when(s["start"] >= low, F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise("")
                clear = F.substring(text, (a["at"] - low + 1).cast("int"), F.greatest(s["start"] - a["at"], F.lit(0)).cast("int"))
                return F.struct(s["end"].alias("at"), F.concat(a["out"], clear, tag).alias("out"))

            rest = lambda a: F.concat(a["out"], F.substring(text, (a["at"] - low + 1).cast("int"), F.lit(PIECE)))
            return F.aggregate(own, F.struct(low.alias("at"), F.lit("").alias("out")), step, rest)

        return of

    pieces = F.regexp_extract_all(body, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    return _let(_merged(spans), lambda m: F.array_join(F.transform(pieces, piece(m)), ""))


def redact(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """df with every span of its texts replaced by [EMAIL], [IP], [CARD], [PHONE] or [SECRET]; a span that overlaps an earlier one widens it."""
    rows = _with_spans(packed(df, text, own_key=F.col(key), body=F.col(text)), "own_key", "body")
    clean = F.when(F.size("__spans") > 0, _redacted(null_safe_text("body"), F.col("__spans"))).otherwise(F.col("body"))
    return unpacked(rows, df.columns, **{text: clean})


def _joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _count(k: int) -> Column:
    return F.size(F.filter("base", lambda s: s["ord"] == k)).cast("long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(read_table(spark, sf_dir, "documents"))
    counts = [_count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(_joined("base").cast("binary"), 256).alias("base_sha256"), _joined("spans").alias("spans"), (F.size("spans") - F.size("base")).cast("long").alias("n_added"), "n_seeded", (F.size("spans") - F.size("base") - F.col("n_seeded")).alias("n_discovered"))

#: Spans that learned patterns add can not be stated in SQL; tests compare the base spans with a plain search.
SQL = None
