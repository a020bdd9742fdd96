"""Secret scan in DataFrame functions only: three fixed patterns, and a sliding-window entropy over candidate strings.

Base patterns. All leftmost non-overlapping matches of a pattern come from ``regexp_extract_all``; what stands between
them comes from ``split`` at the same pattern, so running sums of the two lengths give every match's place in code points.

Entropy. A candidate is a longest run of token characters, of at least WINDOW of them, with a digit and a letter. Its class
is hex (only hex digits) or token. A fold over its characters keeps a count for each character of the class, eight to a long, and
the sum S of c * log2(c) in whole units of 1 / SCALE, so that nothing drifts: a step takes one character in and, once the window is
full, one out, and changes S by those two terms only. The window's entropy is log2(WINDOW) - S / WINDOW. The span from the first to
the last window that reaches the class's bound is a finding, unless the candidate is on the allow list or the span lies in a
base span.

Cost. Expressions inside a lambda are evaluated at each call, so what is large is bound once (``_let``). The entropy fold is linear in
the candidate; running sums and maxima over n matches copy n ** 1.5 places (``_before``); sorting takes n log n.

Results: a null or empty text has no spans; equal rows are scanned each; an empty table gives an empty table; a candidate of any
length is scanned whole. Memory is one text, its matches and about 50 bytes for each character of one candidate; nothing is shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm import _common as C


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


ASSIGN = "(" + "|".join(map(_either_case, ("password", "passwd", "secret", "token"))) + "|" + _either_case("api") + "_?" + _either_case("key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]{32,}"  # the longest runs of 32 and more: the same as all runs without the shorter ones
KINDS = ("assign", "access", "hex", "entropy")

WINDOW = 20
BOUNDS = {"hex": 3.05, "token": 3.85}  # bits a character; no window of 20 has exactly these
ALPHABETS = {"hex": "0123456789abcdef", "token": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="}
CANDIDATE = "[A-Za-z0-9+/_-]{20,}={0,2}"
#: A whole candidate of at most ALLOW_MOST characters that matches one of these is not a secret: UUIDs, paths of plain words, values
#: that end as documentation's sample keys do, counting alphabets.
ALLOWED = (
    "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    "^/?[A-Za-z][a-z]*([_-][a-z]+)*[0-9]{0,4}(/[A-Za-z][a-z]*([_-][a-z]+)*[0-9]{0,4}){2,}/?$",
    "(EXAMPLE|example|CHANGEME|changeme)(KEY|key)?=*$",
    "^(0123456789|ABCDEFGHIJKLMNOPQRSTUVWXYZ|abcdefghijklmnopqrstuvwxyz|ABCDEF|abcdef|[+/=_-])+$",
)
ALLOW_MOST = 512  # a pattern with groups recurses in its matcher
SCALE = 1 << 40
_TERMS = [0, *(round(c * math.log2(c) * SCALE) for c in range(1, WINDOW + 1))]

_SPANS = "array<struct<start:int,end:int,rank:int,kind:string>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _before(values: Column, zero: Column, join: Callable[[Column, Column], Column]) -> Column:
    """What ``join`` makes, from ``zero`` on, of all values before each one. Blocks of sqrt(n) bound what appending copies."""

    def scan(block, begin):
        start = F.struct(begin.alias("at"), F.slice(F.array(begin), 1, 0).alias("out"))
        return F.aggregate(block, start, lambda s, v: F.struct(join(s["at"], v).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")), lambda s: s["out"])

    def whole(v):
        width = F.ceil(F.sqrt(F.size(v))).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / width).cast("int")), lambda i: F.slice(v, i * width + 1, width))
        return _let(blocks, lambda p: F.flatten(F.zip_with(p, scan(F.transform(p, lambda x: F.aggregate(x, zero, join)), zero), scan)))

    return _let(values, lambda v: F.when(F.size(v) > 0, whole(v)).otherwise(F.slice(F.array(zero), 1, 0)))


def _matches(text: Column, pattern: str, kind: str, group: int = 0, least: int = 0) -> Column:
    """array<struct<start, end, rank, kind, word>> of the matches whose ``group`` has at least ``least`` characters."""
    parts = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("word"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"), F.split(text, pattern, -1).alias("gap"))

    def placed(m):
        steps = F.transform(m["word"], lambda w, i: F.length(w) + F.length(F.get(m["gap"], i)))

        def at(before):
            begin = lambda i: F.get(before, i) + F.length(F.get(m["gap"], i))
            every = F.transform(
                m["word"],
                lambda w, i: F.struct(begin(i).alias("start"), (begin(i) + F.length(w)).alias("end"), F.lit(KINDS.index(kind)).alias("rank"), F.lit(kind).alias("kind"), w.alias("word"), F.length(F.get(m["value"], i)).alias("n")),
            )
            return F.filter(every, lambda x: x["n"] >= least)

        return _let(_before(steps, F.lit(0), lambda a, b: a + b), at)

    none = F.array().cast("array<struct<start:int,end:int,rank:int,kind:string,word:string,n:int>>")
    return F.when(text.rlike(pattern), _let(parts, placed)).otherwise(none)


def _plain(spans: Column) -> Column:
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["rank"].alias("rank"), x["kind"].alias("kind")))


def _high_windows(candidate: Column, alphabet: str, bound: float) -> Column:
    """struct<first, last>: starts of the first and last window of a candidate whose entropy reaches ``bound``; -1 if none does."""
    most = F.lit(math.floor((math.log2(WINDOW) - bound) * WINDOW * SCALE))  # of S
    terms = F.array(*(F.lit(t).cast("long") for t in _TERMS))
    zeros = F.array_repeat(F.lit(0).cast("long"), len(alphabet) // 8 + 1)
    begin = F.struct(zeros.alias("n"), F.lit(0).cast("long").alias("s"), F.lit(-1).alias("first"), F.lit(-1).alias("last"))
    bit = lambda a: F.call_function("shiftleft", F.lit(1).cast("long"), a.bitwiseAND(7) * 8)
    count = lambda n, a: F.call_function("shiftright", F.get(n, F.shiftright(a, 3)), a.bitwiseAND(7) * 8).bitwiseAND(255).cast("int")

    def fold(v):
        def step(acc, i):
            def moved(c):
                into, out = F.when(c["a"] != c["b"], c["ka"]), F.when(c["a"] != c["b"], c["kb"])
                term = lambda k: F.get(v["terms"], k)
                s = F.when(c["a"] == c["b"], acc["s"]).otherwise(acc["s"] - term(into) + term(into + 1) - term(out) + term(F.greatest(out - 1, F.lit(0))))
                n = F.when(c["a"] == c["b"], acc["n"]).otherwise(
                    F.transform(acc["n"], lambda x, k: x + F.when(k == F.shiftright(c["a"], 3), bit(c["a"])).otherwise(F.lit(0)) - F.when((c["b"] >= 0) & (k == F.shiftright(c["b"], 3)), bit(c["b"])).otherwise(F.lit(0)))
                )
                return F.struct(n.alias("n"), s.alias("s"))

            a, b = F.get(v["codes"], i), F.when(i >= WINDOW, F.get(v["codes"], i - WINDOW)).otherwise(F.lit(-1))
            both = F.struct(a.alias("a"), b.alias("b"), count(acc["n"], a).alias("ka"), F.when(b >= 0, count(acc["n"], b)).otherwise(F.lit(0)).alias("kb"))

            def judged(m):
                high = (i >= WINDOW - 1) & (m["s"] <= most)
                return F.struct(m["n"].alias("n"), m["s"].alias("s"), F.when(high & (acc["first"] < 0), i - (WINDOW - 1)).otherwise(acc["first"]).alias("first"), F.when(high, i - (WINDOW - 1)).otherwise(acc["last"]).alias("last"))

            return _let(_let(both, moved), judged)

        return F.aggregate(F.sequence(F.lit(0), F.size(v["codes"]) - 1), begin, step, lambda acc: F.struct(acc["first"].alias("first"), acc["last"].alias("last")))

    codes = F.transform(F.split(candidate, "", -1), lambda c: F.instr(F.lit(alphabet), c) - 1)
    return _let(F.struct(codes.alias("codes"), terms.alias("terms")), fold)


def _entropy_spans(runs: Column) -> Column:
    """Findings in the candidates ``runs`` (spans with their words)."""

    def one(x):
        c = x["word"]
        allowed = F.lit(False)
        for p in ALLOWED:
            allowed = allowed | c.rlike(p)
        w = F.when(c.rlike("^[0-9a-f]+$"), _high_windows(c, ALPHABETS["hex"], BOUNDS["hex"])).otherwise(_high_windows(c, ALPHABETS["token"], BOUNDS["token"]))
        none = F.struct(F.lit(-1).alias("first"), F.lit(-1).alias("last"))
        return F.struct(x["start"].alias("at"), F.when(~c.rlike("[0-9]") | ~c.rlike("[A-Za-z]") | ((F.length(c) <= ALLOW_MOST) & allowed), none).otherwise(w).alias("w"))

    found = F.filter(F.transform(runs, one), lambda x: x["w"]["first"] >= 0)
    return F.transform(
        found,
        lambda x: F.struct(
            (x["at"] + x["w"]["first"]).cast("int").alias("start"), (x["at"] + x["w"]["last"] + WINDOW).cast("int").alias("end"), F.lit(KINDS.index("entropy")).alias("rank"), F.lit("entropy").alias("kind")
        ),
    )


def _outside(base: Column, high: Column) -> Column:
    """The spans of ``high`` that lie in no span of ``base``: none that begins before them, or with them, reaches their end."""
    entropy = KINDS.index("entropy")
    turned = F.transform(F.concat(base, high), lambda x: F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["end"].alias("end"), x["kind"].alias("kind")))

    def free(every):
        reach = _before(F.transform(every, lambda x: F.when(x["rank"] < entropy, x["end"]).otherwise(F.lit(0))), F.lit(0), lambda a, b: F.greatest(a, b))
        return _let(reach, lambda r: F.filter(every, lambda x, i: (x["rank"] == entropy) & (F.get(r, i) < x["end"])))

    return F.when(F.size(high) > 0, _plain(_let(F.sort_array(turned), free))).otherwise(F.array().cast(_SPANS))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(F.sort_array(F.transform(spans, lambda x: F.struct(x["start"], x["rank"], x["end"], x["kind"]))), lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, base and entropy: arrays of struct<start, end, rank, kind>, places in code points, end exclusive."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    t = F.col("text")
    base = F.concat(_plain(_matches(t, ASSIGN, "assign", 2, 8)), _plain(_matches(t, ACCESS, "access", 0, 16)), _plain(_matches(t, HEX, "hex")))
    out = rows.withColumn("base", base).withColumn("high", F.when(t.rlike(CANDIDATE), _entropy_spans(_matches(t, CANDIDATE, "entropy"))).otherwise(F.array().cast(_SPANS)))
    return out.select("doc_id", "base", _outside(F.col("base"), F.col("high")).alias("entropy"))


def _count(kind: str) -> Column:
    return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_spans(C.documents(spark, sf_dir))
    return found.select("doc_id", *map(_count, KINDS[:3]), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.concat("base", "entropy")).alias("spans"))


def _sql_spans(kind: str, pattern: str) -> str:
    q = pattern.replace("'", "''")
    m, g = f"regexp_extract_all(text, '{q}')", f"string_split_regex(text, '{q}')"
    return f"""CASE WHEN len({m}) = 0 THEN [] ELSE list_transform(range(1, len({m}) + 1), lambda i: struct_pack(
      s := (list_sum(list_transform(list_slice({g}, 1, i), lambda x: length(x))) + coalesce(list_sum(list_transform(list_slice({m}, 1, i - 1), lambda x: length(x))), 0))::BIGINT,
      n := length({m}[i])::BIGINT, r := {KINDS.index(kind)}, k := '{kind}', w := {m}[i])) END"""


_ASSIGN_SQL = ASSIGN.replace("'", "''")
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
m AS (SELECT rid, doc_id, text, {_sql_spans("assign", ASSIGN)} AS a, {_sql_spans("access", ACCESS)} AS k, {_sql_spans("hex", HEX)} AS h, {_sql_spans("entropy", CANDIDATE)} AS c,
  regexp_extract_all(text, '{_ASSIGN_SQL}', 2) AS v FROM d),
b AS (SELECT rid, doc_id, c, list_concat(list_filter(a, lambda x, i: length(v[i]) >= 8), list_filter(k, lambda x: x.n >= 16), h) AS base FROM m),
u AS (SELECT rid, base, unnest(c) AS x FROM b),
e AS (
  SELECT rid, base, x, list_filter(range(0, x.n - {WINDOW} + 1), lambda j: list_entropy(string_split(substr(x.w, j + 1, {WINDOW}), '')) >=
    CASE WHEN regexp_full_match(x.w, '[0-9a-f]+') THEN {BOUNDS["hex"]} ELSE {BOUNDS["token"]} END) AS j
  FROM u WHERE regexp_matches(x.w, '[0-9]') AND regexp_matches(x.w, '[A-Za-z]') AND NOT (x.n <= {ALLOW_MOST} AND ({" OR ".join(f"regexp_matches(x.w, '{p}')" for p in ALLOWED)}))),
f AS (
  SELECT rid, list(struct_pack(s := x.s + j[1], n := j[len(j)] - j[1] + {WINDOW}, r := 3, k := 'entropy', w := '')) AS high
  FROM e WHERE len(j) > 0 AND len(list_filter(base, lambda b: b.s <= x.s + j[1] AND b.s + b.n >= x.s + j[len(j)] + {WINDOW})) = 0 GROUP BY rid),
s AS (SELECT doc_id, base, list_concat(base, coalesce(high, [])) AS every FROM b LEFT JOIN f USING (rid))
SELECT doc_id, len(list_filter(base, lambda x: x.k = 'assign')) AS n_assign, len(list_filter(base, lambda x: x.k = 'access')) AS n_access,
  len(list_filter(base, lambda x: x.k = 'hex')) AS n_hex,
  sha256(coalesce(array_to_string(list_transform(list_sort(list_transform(base, lambda x: struct_pack(s := x.s, r := x.r, t := x.k || ':' || x.s || ':' || (x.s + x.n)))), lambda x: x.t), ','), '')) AS base_sha256,
  coalesce(array_to_string(list_transform(list_sort(list_transform(every, lambda x: struct_pack(s := x.s, r := x.r, t := x.k || ':' || x.s || ':' || (x.s + x.n)))), lambda x: x.t), ','), '') AS spans
FROM s
"""
