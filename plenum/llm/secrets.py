"""Secret scans over a trigram inverted index.

From each rule's regular expression follows its Boolean trigram query: an OR of clauses, each an AND of trigrams, one
of which any match satisfies. The index maps each trigram that some clause names to the rows whose text, A-Z lower-cased,
holds it. A clause's postings are intersected by counting, a rule's clauses are united, and only the rows so found
are verified with the rule's expression. A rule without mandatory trigrams scans every row.
"""

from __future__ import annotations

import re
import string
import warnings
from dataclasses import dataclass
from functools import cache
from re import _constants as sre
from re import _parser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plenum.llm.lineage import let, numbered, settled

#: Strings that a part of an expression may be spelled out to, characters of a class that are told apart, and clauses of
#: a query. Beyond these a part counts as anything, which only makes the query weaker.
SPELLED, CLASS, CLAUSES = 64, 8, 64
#: Candidate rows that are broadcast (a row's place and kinds, 32 bytes or so each); with more, rows and candidates are shuffled.
FEW = 1 << 20
#: Characters of a chunk of text that redaction cuts from.
CHUNK = 1024


@dataclass(frozen=True)
class Part:
    """What is known of every string that a part of an expression matches.

    `whole`: all those strings, or None if they can't be listed. `starts` and `ends`: each begins (ends) with one of
    these. `query`: clauses of trigrams, one of which each string holds; {frozenset()} holds always.
    """

    whole: frozenset[str] | None
    starts: frozenset[str]
    ends: frozenset[str]
    query: frozenset[frozenset[str]]


TRUE = frozenset([frozenset()])
NOTHING = frozenset([""])
ANYTHING = Part(None, NOTHING, NOTHING, TRUE)


def _minimal(clauses: frozenset[frozenset[str]]) -> frozenset[frozenset[str]]:
    """Without the clauses that a weaker one covers; TRUE if too many are left."""
    least = frozenset(c for c in clauses if not any(d < c for d in clauses))
    return least if len(least) <= CLAUSES else TRUE


def _both(a: frozenset[frozenset[str]], b: frozenset[frozenset[str]]) -> frozenset[frozenset[str]]:
    """AND of two queries; if it grows too large, the one that says more."""
    if len(a) * len(b) > CLAUSES * CLAUSES:
        return min(a, b, key=len)
    crossed = _minimal(frozenset(x | y for x in a for y in b))
    return crossed if crossed != TRUE else max(a, b, key=lambda q: min(map(len, q)))


def _grams(strings: frozenset[str]) -> frozenset[frozenset[str]]:
    """Each string's trigrams as a clause; TRUE if a string has none."""
    return _minimal(frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings))


def _spelled(strings: frozenset[str]) -> Part:
    return Part(strings, strings, strings, TRUE)


def _loose(p: Part) -> Part:
    """The same without the list of strings: their trigrams go into the query, and two characters of each end stay."""
    first = frozenset(s[:2] for s in p.starts)
    last = frozenset(s[-2:] for s in p.ends)
    return Part(None, first, last, _both(_both(p.query, _grams(p.starts)), _grams(p.ends)))


def _then(a: Part, b: Part) -> Part:
    """One part after the other: the strings across the seam hold trigrams too."""
    cross = lambda x, y: frozenset(s + t for s in x for t in y) if len(x) * len(y) <= SPELLED else None
    if a.whole is not None and b.whole is not None:
        both = cross(a.whole, b.whole)
        if both is not None:
            return _spelled(both)
    seam = cross(a.ends, b.starts)
    starts = cross(a.whole, b.starts) if a.whole is not None else None
    ends = cross(a.ends, b.whole) if b.whole is not None else None
    x, y = _loose(a), _loose(b)
    query = _both(_both(x.query, y.query), _grams(seam) if seam is not None else TRUE)
    for more in (starts, ends):
        query = _both(query, _grams(more)) if more is not None else query
    return Part(None, frozenset(s[:2] for s in starts) if starts is not None else x.starts, frozenset(s[-2:] for s in ends) if ends is not None else y.ends, query)


def _either(a: Part, b: Part) -> Part:
    if a.whole is not None and b.whole is not None and len(a.whole | b.whole) <= SPELLED:
        return _spelled(a.whole | b.whole)
    x, y = _loose(a), _loose(b)
    return Part(None, x.starts | y.starts, x.ends | y.ends, _minimal(x.query | y.query))


def _character(code: int) -> Part:
    """A character in lower case, as the index has it. Only ASCII folds alike everywhere; others may be anything."""
    return _spelled(frozenset([chr(code).lower()])) if code < 128 else ANYTHING


def _class(members: list) -> Part:
    out = None
    for kind, value in members:
        codes = [value] if kind is sre.LITERAL else range(value[0], value[1] + 1) if kind is sre.RANGE and value[1] - value[0] < CLASS else None
        if codes is None:
            return ANYTHING
        for code in codes:
            out = _either(out, _character(code)) if out else _character(code)
    return out if out and out.whole is not None and len(out.whole) <= CLASS else ANYTHING


def _repeated(p: Part, least: int, most: int) -> Part:
    """`least` copies, two of which show all seams; more than is spelled out makes the whole unknown."""
    out = _spelled(NOTHING)
    for _ in range(min(least, 4)):
        out = _then(out, p)
    if least > 4:
        return _then(out, Part(None, p.starts, p.ends, TRUE)) if p.whole is None else _then(_loose(out), ANYTHING)
    if most == least:
        return out
    if least == 0:
        return _either(_spelled(NOTHING), p) if most == 1 else ANYTHING
    return _then(out, ANYTHING)


def _part(parsed) -> Part:
    """Folds a parsed expression. What isn't known here counts as anything; what takes no room in the text, as nothing."""
    out = _spelled(NOTHING)
    for kind, value in parsed:
        if kind is sre.LITERAL:
            p = _character(value)
        elif kind is sre.IN:
            p = _class(value)
        elif kind in (sre.AT, sre.ASSERT, sre.ASSERT_NOT):
            p = _spelled(NOTHING)
        elif kind is sre.SUBPATTERN:
            p = _part(value[-1])
        elif kind is sre.ATOMIC_GROUP:
            p = _part(value)
        elif kind is sre.BRANCH:
            p = _part(value[1][0])
            for branch in value[1][1:]:
                p = _either(p, _part(branch))
        elif kind in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
            p = _repeated(_part(value[2]), value[0], value[1])
        else:
            p = ANYTHING
        out = _then(out, p)
    return out


#: What Java and Python read alike, piece by piece: escapes of one character, numbers of four or two hexadecimal digits, a
#: back-reference of one digit, what may follow "(?", classes without classes inside them, and other single characters.
_ESCAPE = r"\\(?:[^A-Za-z0-9\s]|[dDsSwWtnrfa]|x[0-9A-Fa-f]{2}|u[0-9A-Fa-f]{4})"
_ALIKE = re.compile(rf"(?:{_ESCAPE}|\\[bBAZ]|\\[1-9](?![0-9])|\((?:\?(?:[=!:>]|<[=!]|[ims]+(?:-[ims]+)?[:)]|-[ims]+[:)])|(?!\?))|\[\^?(?:{_ESCAPE}|[^\\\[\]&])+\]|[^\\(\[])*", re.DOTALL)


def _parsed(regex: str):
    """The parsed expression, or None if it has anything that only Java reads, or reads otherwise: then nothing is derived from it."""
    if not _ALIKE.fullmatch(regex):
        return None
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("error")
            return _parser.parse(regex)
    except (re.error, Warning, OverflowError, RecursionError):
        return None


@cache
def trigram_query(regex: str) -> tuple[frozenset[str], ...]:
    """The clauses of an expression of Java's, in a fixed order; () if it has no mandatory trigrams, or can't be read here: then every row is scanned."""
    parsed = _parsed(regex)
    query = _loose(_part(parsed)).query if parsed is not None else TRUE
    return () if frozenset() in query else tuple(sorted(query, key=sorted))


@dataclass(frozen=True)
class Rule:
    """`group`, `least`: matches whose group has fewer characters than `least` are dropped."""

    kind: str
    regex: str
    group: int = 0
    least: int = 0

    def __post_init__(self):
        parsed = _parsed(self.regex)
        if parsed is not None and parsed.getwidth()[0] == 0:
            raise ValueError(f"{self.kind}: an expression must not match the empty text")

    def clauses(self) -> tuple[frozenset[str], ...]:
        return trigram_query(self.regex)


# The kinds that every scan reports.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]{12,}+"),
    Rule("hex", r"(?<![0-9a-f])[0-9a-f]{32,}+"),
)
# Public token formats that the scan adds.
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}+"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}+"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+"),
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("bearer", r"(?i:authorization):\x20*(?i:bearer)\x20+[A-Za-z0-9._~+/-]{16,}+"),
)
RULES = BASE + MORE


def index_trigrams(rules: tuple[Rule, ...]) -> list[str]:
    return sorted({t for r in rules for c in r.clauses() for t in c})


def postings(rows: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(trigram, __row) for the rules' trigrams. `rows` has `__row` and `text`."""
    held = F.filter(F.array(*map(F.lit, index_trigrams(rules))).cast("array<string>"), lambda t: F.contains(F.col("__low"), t))
    return rows.select("__row", F.translate("text", string.ascii_uppercase, string.ascii_lowercase).alias("__low")).select("__row", F.explode(held).alias("trigram"))


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(__row, __kinds) of the rows whose postings satisfy a clause of a rule. One row for each `__row`; bit k of `__kinds` is the k-th rule."""
    wanted = [(k, f"{k}:{j}", t, len(c)) for k, r in enumerate(rules) for j, c in enumerate(r.clauses()) for t in sorted(c)]
    clauses = index.sparkSession.createDataFrame(wanted, "rank int, clause string, trigram string, of int")  # bounded by the rules
    whole = index.join(F.broadcast(clauses), "trigram").groupBy("__row", "clause", "rank", "of").agg(F.count("*").alias("n")).where("n = of")
    return whole.groupBy("__row").agg(F.bit_or(F.pow(F.lit(2.0), F.col("rank")).cast("long")).alias("__kinds"))


def running(values: Column, add) -> Column:
    """Each element combined with all before it by the associative `add`, in rounds that double the reach: n log n work."""
    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(values), F.lit(1)).cast("double"))).cast("int"))

    def once(acc: Column, k: Column) -> Column:
        return let(F.pow(F.lit(2.0), k).cast("int"), lambda reach: F.transform(acc, lambda v, i: F.when(i >= reach, add(F.get(acc, i - reach), v)).otherwise(v)))

    return F.aggregate(rounds, values, once)


SPAN = "struct<start:int,rank:int,end:int,kind:string>"


def _spans(text: Column, rank: int, r: Rule) -> Column:
    """array<SPAN> of a rule's matches. Their places follow from the lengths of the matches and of the text between them, each found once."""
    found = F.regexp_extract_all(text, F.lit(r.regex), F.lit(0))
    kept = F.regexp_extract_all(text, F.lit(r.regex), F.lit(r.group)) if r.group else F.array().cast("array<string>")
    sizes = lambda a: F.transform(a, lambda x: F.length(x))
    facts = F.struct(sizes(found).alias("own"), sizes(kept).alias("kept"), sizes(F.split(text, r.regex, -1)).alias("gap"))

    def placed(m: Column) -> Column:
        steps = F.transform(m["own"], lambda n, k: n + F.get(m["gap"], k))
        judged = m["kept"] if r.group else m["own"]
        span = lambda end, k: F.struct((end - F.get(m["own"], k)).alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(r.kind).alias("kind"), F.get(judged, k).alias("kept"))
        return F.filter(F.transform(running(steps, lambda a, b: a + b), span), lambda s: s["kept"] >= r.least)

    return F.transform(let(facts, placed), lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))


def spans_of(text: Column, kinds: Column, rules: tuple[Rule, ...]) -> Column:
    """The spans of all rules; rules with clauses are asked only where their bit of `kinds` is set."""
    empty = F.array().cast(f"array<{SPAN}>")
    asked = [text.isNotNull() if not r.clauses() else F.coalesce(kinds.bitwiseAND(F.lit(1 << k)) != 0, F.lit(False)) for k, r in enumerate(rules)]
    found = [F.when(a & F.rlike(text, F.lit(r.regex)), _spans(text, k, r)).otherwise(empty) for k, (a, r) in enumerate(zip(asked, rules, strict=True))]
    return F.array_sort(F.concat(*found)) if found else empty


def scan(df: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """`df` with `secrets`: array<SPAN> of all rules' spans, by start, then in the rules' order.

    Starts and ends are code points, ends exclusive. Spans of one rule don't overlap; those of different rules may.
    A null or empty text has no spans. Repeated rows are scanned as rows of their own. A column called `secrets` is
    replaced; other columns pass, whatever their names (two leading underscores are reserved). The index is keyed by
    the row's place in its input. At most 63 rules.
    """
    rows = numbered(df.drop("secrets"), "__row")
    lean = rows.select("__row", F.col(f"`{text}`").alias("text")).where("text IS NOT NULL")
    found = candidates(postings(lean, rules), rules).transform(settled)
    joined = rows.join(F.broadcast(found) if found.count() <= FEW else found, "__row", "left")
    return joined.withColumn("secrets", spans_of(F.col(f"`{text}`"), F.col("__kinds"), rules)).drop("__row", "__kinds")


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(df: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """`df` with every span of `scan` replaced by `mask` (overlapping spans by one). Rows without a span pass unchanged."""
    t = F.col(f"`{text}`")

    def masked(m: Column) -> Column:
        def piece(a: Column, b: Column) -> Column:  # characters a to b, from the chunks that they lie in
            first = F.floor(a / CHUNK).cast("int")
            near = F.array_join(F.slice(m["chunks"], first + 1, F.floor(b / CHUNK).cast("int") - first + 1), "")
            return F.substring(near, a - first * CHUNK + 1, b - a)

        reach = lambda k: F.when(k > 0, F.get(m["reach"], k - 1)).otherwise(F.lit(0))
        parts = F.transform(m["starts"], lambda s, k: F.when(s >= reach(k), F.concat(piece(reach(k), s), F.lit(mask))).otherwise(""))
        return F.concat(F.array_join(parts, ""), piece(reach(F.size(m["starts"])), F.length(t)))

    facts = F.struct(
        F.regexp_extract_all(t, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0)).alias("chunks"),
        F.transform("secrets", lambda s: s["start"]).alias("starts"),
        running(F.transform("secrets", lambda s: s["end"]), lambda a, b: F.greatest(a, b)).alias("reach"),
    )
    return scan(df, rules, text).withColumn(text, F.when(F.size("secrets") > 0, let(facts, masked)).otherwise(t)).drop("secrets")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every document, with counts and a digest of the base kinds."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan(docs).select("doc_id", "secrets")
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("secrets", lambda s: s["rank"] < len(BASE))
    return found.select("doc_id", *[count(r.kind).alias(f"n_{r.kind}") for r in BASE], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))


def _duck(r: Rule) -> str:
    """RE2 has no possessive counts and no look-behind; greedy runs end at the same places."""
    return r.regex.replace("}+", "}").replace("(?<![0-9a-f])", "").replace("'", "''")


def _duck_spans(rank: int, r: Rule) -> str:
    p = _duck(r)
    start = "list_sum(list_transform(b[:k + 1], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(m[:k], lambda x: length(x))), 0)::BIGINT"
    return f"""SELECT i, {rank} AS rank, '{r.kind}' AS kind, {start} AS s, {start} + length(m[k + 1]) AS e
FROM (SELECT i, m, g, b, unnest(range(len(m))) AS k FROM (
  SELECT i, regexp_extract_all(t, '{p}') AS m, regexp_extract_all(t, '{p}', {r.group}) AS g, string_split_regex(t, '{p}') AS b FROM d) WHERE len(m) > 0)
WHERE length(g[k + 1]) >= {r.least}"""


ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS i, doc_id, coalesce(text, '') AS t FROM documents),
spans AS ({" UNION ALL ".join(_duck_spans(k, r) for k, r in enumerate(RULES))}),
per AS (SELECT i, {", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in BASE)},
  coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (rank < {len(BASE)}), '') AS base,
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS spans FROM spans GROUP BY i)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN per USING (i)
"""
