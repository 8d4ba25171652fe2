"""Personal data by weak supervision.

Wide patterns propose candidate spans. Labelers vote on each (yes, no, or nothing): a regular expression (does the
strict form hold), a check of numbers (checksums and ranges), gazetteers (endings of domains, calling codes, given
names, ...), cue words before it, and what stands next to it. No labeler is trusted beforehand: expectation-maximisation
over the counts of vote patterns estimates how each labeler votes on true and on false candidates of each kind, and so
the probability that a pattern's candidates are true. On these probabilities a logistic classifier of spans is trained,
which also sees a candidate's shape, length and neighbours; it decides on the candidates that the base rules don't name.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plenum.llm.lineage import settled

#: Kinds in their order; the first four have base rules.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "person")
BASE = KINDS[:4]
#: Candidates that the classifier is trained on (those with the least hashes), its features, and the probability from which a span is added.
SAMPLE, FEATURES, ACCEPT = 20_000, 1024, 0.8
#: Rounds of expectation-maximisation and of the classifier's training; candidates that the initial beliefs count as.
EM_ROUNDS, ROUNDS, BELIEF = 60, 300, 8.0
#: Characters of context that labelers see on either side.
CONTEXT = 48

# Gazetteers and cue words.
ENDINGS = frozenset("com org net edu gov info io de fr es it nl uk ch at be eu us ca au in jp br".split())
CALLING = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "53", "54", "55", "56", "57", "58", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98", "351", "352", "353", "358", "420", "421", "971", "972")
ISSUERS = re.compile(r"4|5[1-5]|2[2-7]|3[47]|6011|65|35")
IBAN_LENGTHS = {"DE": 22, "FR": 27, "ES": 24, "IT": 27, "NL": 18, "GB": 22, "CH": 21, "AT": 20, "BE": 16, "PL": 28, "PT": 25}
NAMES = frozenset("anna anne carlos claire david elena emma hans jan jean john juan julia karl laura lucas maria marie martin mary max michael paul pedro peter pierre sarah sofia thomas".split())
CUES = {
    "email": "email e-mail mail contact correo courriel reach write adresse",
    "ip": "ip host server address from login adresse",
    "card": "card visa mastercard amex credit kreditkarte carte tarjeta payment",
    "phone": "phone tel telephone call mobile cell fax telefon anruf téléphone teléfono",
    "iban": "iban account konto compte cuenta bank",
    "ssn": "ssn social security",
    "person": "name contact dear signed by from",
}
AGAINST = frozenset("version isbn order invoice id no nr ref figure section page build release serial rfc".split())
_CUES = {k: frozenset(v.split()) for k, v in CUES.items()}

#: A run of characters that every number-like candidate lies in.
RUN = re.compile(r"[0-9+][0-9+\x20().-]*")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NATIONAL = re.compile(r"(?<![0-9+.-])\(?0?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9]|[.-][0-9])")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])")
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
SPELLED = re.compile(r"[A-Za-z0-9._%+-]{1,64}\x20?[\[(](?:at|AT)[\])]\x20?[A-Za-z0-9-]{1,63}(?:(?:\.|\x20?[\[(](?:dot|DOT)[\])]\x20?)[A-Za-z0-9-]{1,63}){1,6}")
TITLES = ("Mr", "Mrs", "Ms", "Dr", "Herr", "Frau", "Monsieur", "Madame", "Señor", "Señora")
PERSON = re.compile(r"(?<!\w)(?:" + "|".join(TITLES) + r")\.?\x20[A-ZÄÖÜÉÈÁÍÓÚÑ][a-zà-ÿ]{1,30}(?:\x20[A-ZÄÖÜÉÈÁÍÓÚÑ][a-zà-ÿ]{1,30})?")
WORDS = re.compile(r"\w[\w-]*")

VOTES = 5
FOUND = "array<struct<kind:int,start:int,end:int,base:boolean,votes:int,features:array<int>>>"


# ---- Candidates


def luhn(digits: str) -> bool:
    doubled = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)
    return sum(doubled[int(d)] if k % 2 else int(d) for k, d in enumerate(reversed(digits))) % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost addresses that don't overlap: from each @ to both sides, so that long runs of letters are met once."""
    free, at = 0, text.find("@")
    while at >= 0:
        domain = DOMAIN.match(text, at + 1)
        start = at
        if domain:
            while start > free and text[start - 1] in LOCAL:
                start -= 1
        if start < at:
            yield start, domain.end()
            free = domain.end()
        else:
            free = at + 1
        at = text.find("@", free)


def strict(kind: str, s: str) -> bool:
    """Whether a match of a base expression holds."""
    if kind == "ip":
        return all(int(p) <= 255 if len(p) < 20 else not p.strip("0") or len(p.lstrip("0")) < 4 and int(p.lstrip("0")) <= 255 for p in s.split("."))
    if kind == "card":
        d = digits_of(s)
        return 13 <= len(d) <= 19 and luhn(d)
    if kind == "phone":
        return s[0] == "+" and 9 <= len(digits_of(s)) <= 15
    return True


def proposed(text: str) -> list[tuple[int, int, int, bool]]:
    """(kind, start, end, base) of all candidates: the base expressions' matches, whether they hold or not, and wider forms that don't overlap these."""
    base: list[tuple[int, int, int, bool]] = [(0, a, b, True) for a, b in emails(text)] if "@" in text else []
    wide: list[tuple[int, int, int, bool]] = []
    for run in RUN.finditer(text):
        a, b = run.span()
        if b - a < 7:
            continue
        for kind, pattern in ((1, IP), (2, CARD), (3, PHONE)):
            for m in pattern.finditer(text, a, b):
                holds = strict(KINDS[kind], m[0])
                if holds or kind != 2 or len(digits_of(m[0])) >= 13:
                    (base if holds else wide).append((kind, *m.span(), holds))
        wide += [(3, *m.span(), False) for m in NATIONAL.finditer(text, a, b)] + [(5, *m.span(), False) for m in SSN.finditer(text, a, b)]
        if a >= 2 and text[a - 2 : a].isascii() and text[a - 2 : a].isalpha() and text[a - 2 : a].isupper() and (m := IBAN.match(text, a - 2)) and not (a >= 3 and text[a - 3].isalnum()):
            wide.append((4, *m.span(), False))
    if "at)" in text or "at]" in text or "AT)" in text or "AT]" in text:
        wide += [(0, *m.span(), False) for m in SPELLED.finditer(text)]
    if any(t in text for t in TITLES):
        wide += [(6, *m.span(), False) for m in PERSON.finditer(text)]
    if not wide:
        return base
    base.sort(key=lambda c: c[1])
    taken, out = [(c[1], c[2]) for c in base], list(base)
    reach, k, last = 0, 0, -1
    for c in sorted(wide, key=lambda c: (c[1], -c[2], c[0])):
        while k < len(taken) and taken[k][0] < c[2]:
            reach, k = max(reach, taken[k][1]), k + 1
        if c[1] >= reach and c[1] >= last:
            out.append(c)
            last = c[2]
    return out


# ---- Labelers


def votes(kind: int, s: str, before: str, after: str, base: bool) -> list[int]:
    """One vote (1, -1, or 0) of each labeler: strict form, checked numbers, gazetteers, cue words, neighbours."""
    name, d = KINDS[kind], digits_of(s)
    form = 1 if base or kind in (4, 5, 6) else -1 if kind in (1, 2) else 0
    if name == "card":
        check = 1 if 13 <= len(d) <= 19 and luhn(d) else -1
        known = 1 if ISSUERS.match(d) else -1
    elif name == "ip":
        check = 1 if base else -1
        known = -1 if re.match(r"(?:0|127|255)\.|(?:[0-9]\.){3}[0-9]$", s) else 1
    elif name == "phone":
        check = 1 if 9 <= len(d) <= 15 and len(set(d)) > 2 else -1
        known = 0 if s[0] != "+" else 1 if d.startswith(CALLING) else -1
    elif name == "iban":
        flat = s.replace(" ", "")
        check = 1 if int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 == 1 else -1
        known = 1 if IBAN_LENGTHS.get(flat[:2]) == len(flat) else -1
    elif name == "ssn":
        check = -1 if d[:3] in ("000", "666") or d[0] == "9" or d[3:5] == "00" or d[5:] == "0000" else 0
        known = 0
    elif name == "person":
        check = 0
        known = 1 if any(w.lower() in NAMES for w in WORDS.findall(s)) else 0
    else:
        check = -1 if ".." in s or s[0] == "." or s.endswith("-") else 0
        known = 1 if re.split(r"[^A-Za-z]+", s.rstrip("])"))[-1].lower() in ENDINGS else -1
    said = [w.lower() for w in WORDS.findall(before)[-4:]]
    cue = 1 if any(w in _CUES[name] for w in said) else -1 if any(w in AGAINST for w in said[-2:]) else 0
    beside = (before[-1:], after[:1])
    alone = -1 if any(c.isalnum() or c in "_/=\\" for c in beside if c) else 1
    return [form, check, known, cue, alone]


def packed(v: list[int]) -> int:
    return sum((x + 1) * 3**k for k, x in enumerate(v))


def unpacked(v: np.ndarray) -> np.ndarray:
    """(n, VOTES) of 0 (no), 1 (nothing), 2 (yes)."""
    return np.stack([np.asarray(v) // 3**k % 3 for k in range(VOTES)], axis=1)


def features(kind: int, s: str, before: str, after: str, v: list[int]) -> list[int]:
    """Buckets of what the classifier sees of a candidate; bucket 0 is always on."""
    shape = re.sub(r"(.)\1+", r"\1", "".join("9" if c.isdigit() else "x" if c.isalpha() else c for c in s[:200]))
    near = [w.lower() for w in WORDS.findall(before)[-2:]]
    told = [f"k{kind}", f"s{kind}{shape[:40]}", f"n{kind}{min(len(s), 40) // 4}", f"d{kind}{min(len(digits_of(s)), 24)}", f"b{before[-1:]}", f"a{after[:1]}", *[f"v{kind}.{k}.{x}" for k, x in enumerate(v)], *[f"w{w}" for w in near]]
    return [0, *(1 + zlib.crc32(t.encode("utf-8", "replace")) % (FEATURES - 1) for t in told)]


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(..., text last) -> the same with the candidates in place of the text."""
    kinds = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("votes", pa.int32()), ("features", pa.list_(pa.int32()))]))
    for batch in batches:
        out = []
        for text in batch.column(batch.num_columns - 1):
            text, row = text.as_py() or "", []
            for kind, a, b, base in proposed(text):
                s, before, after = text[a:b], text[max(0, a - CONTEXT) : a], text[b : b + CONTEXT]
                v = votes(kind, s, before, after, base)
                row.append({"kind": kind, "start": a, "end": b, "base": base, "votes": packed(v), "features": features(kind, s, before, after, v)})
            out.append(row)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, kinds)], [*batch.schema.names[:-1], "found"])


# ---- Expectation-maximisation over vote patterns, and the span classifier


@dataclass
class Model:
    """`prior`: share of true candidates by kind. `says`: by class (false, true), kind and labeler the probabilities of no, nothing and yes. `weights`: of the classifier's features."""

    prior: np.ndarray
    says: np.ndarray
    weights: np.ndarray

    def probability(self, kind: np.ndarray, voted: np.ndarray) -> np.ndarray:
        """That candidates of these kinds and votes are true, by the labelers alone."""
        logs = [np.log(self.says[c, kind[:, None], np.arange(VOTES)[None, :], voted]).sum(axis=1) for c in (0, 1)]
        return 1 / (1 + np.exp(np.clip(logs[0] + np.log(1 - self.prior[kind]) - logs[1] - np.log(self.prior[kind]), -50, 50)))


def estimate(kind: np.ndarray, voted: np.ndarray, n: np.ndarray) -> Model:
    """Reliabilities from counts `n` of vote patterns. The initial beliefs, that a labeler is more often right than wrong, count as BELIEF candidates."""
    start = np.array([[0.6, 0.3, 0.1], [0.1, 0.3, 0.6]])
    says = np.broadcast_to(start[:, None, None, :], (2, len(KINDS), VOTES, 3)).copy()
    model = Model(np.full(len(KINDS), 0.5), says, np.zeros(FEATURES))
    for _ in range(EM_ROUNDS):
        p = model.probability(kind, voted)
        for c, share in enumerate((n * (1 - p), n * p)):
            sums = np.zeros((len(KINDS), VOTES, 3))
            for k in range(VOTES):
                np.add.at(sums, (kind, k, voted[:, k]), share)
            sums += BELIEF * start[c]
            model.says[c] = sums / sums.sum(axis=2, keepdims=True)
        true, both = (np.bincount(kind, weights=w, minlength=len(KINDS)) for w in (n * p, n))
        model.prior = (true + 1) / (both + 2)
    return model


def logit(weights: np.ndarray, rows: list[list[int]]) -> np.ndarray:
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    return np.bincount(at, weights=weights[np.fromiter((f for r in rows for f in r), np.int64, len(at))], minlength=len(rows))


def train(rows: list[list[int]], p: np.ndarray) -> np.ndarray:
    """Weights of a logistic classifier of feature rows with probable labels `p`: gradient steps with a quadratic penalty, each feature by its own scale."""
    weights, n = np.zeros(FEATURES), max(len(rows), 1)
    at, flat = np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.fromiter((f for r in rows for f in r), np.int64)
    scale = np.full(FEATURES, 1e-8)
    for _ in range(ROUNDS if len(rows) else 0):
        miss = 1 / (1 + np.exp(-np.clip(logit(weights, rows), -30, 30))) - p
        slope = np.bincount(flat, weights=miss[at], minlength=FEATURES) / n + 1e-4 * weights
        scale += slope**2
        weights -= 0.5 * slope / np.sqrt(scale)
    return weights


def fit(candidates: DataFrame, sample: int = SAMPLE) -> Model:
    """The model of all candidates (rows of FOUND's structs). Vote patterns are counted over all of them (1,701 at most reach the driver); the classifier is trained on `sample`."""
    counts = candidates.groupBy("kind", "votes").agg(F.count("*").alias("n")).collect()
    model = estimate(np.array([r.kind for r in counts], np.int64), unpacked(np.array([r.votes for r in counts], np.int64)), np.array([r.n for r in counts], float))
    drawn = candidates.select("kind", "votes", "features", F.xxhash64("kind", "start", "end", "votes", "features").alias("_h")).orderBy("_h", "features").limit(sample).collect()
    p = model.probability(np.array([r.kind for r in drawn], np.int64), unpacked(np.array([r.votes for r in drawn], np.int64)))
    model.weights = train([r.features for r in drawn], p)
    return model


def _decide(batches: Iterator[pa.RecordBatch], weights: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(..., candidates last) -> the same with the spans that stay: base ones, and those of which the classifier is sure."""
    kinds = pa.list_(pa.struct([("rank", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("base", pa.bool_()), ("p", pa.float64())]))
    for batch in batches:
        found = batch.column(batch.num_columns - 1).to_pylist()
        p = iter(1 / (1 + np.exp(-np.clip(logit(weights, [c["features"] for row in found for c in row]), -30, 30))))
        out = []
        for row in found:
            scored = [(c, float(next(p))) for c in row]
            kept = [{"rank": c["kind"], "start": c["start"], "end": c["end"], "kind": KINDS[c["kind"]], "base": c["base"], "p": x} for c, x in scored if c["base"] or x >= ACCEPT]
            out.append(sorted(kept, key=lambda s: (s["rank"], s["start"], not s["base"])))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, kinds)], [*batch.schema.names[:-1], "personal"])


def find(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`kept` (a struct of the columns `keep`) and `found` (FOUND) of every row: one pass over the texts, written."""
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept"), F.col(f"`{text}`").cast("string").alias("text"))
    kept = rows.schema["kept"].dataType.simpleString()
    return rows.mapInArrow(_find, f"kept {kept}, found {FOUND}").transform(settled)


def detect(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`kept` and `personal`: array<struct<rank,start,end,kind,base,p>> of every row, by kind, then start; places are code points, ends exclusive.

    Base spans stay whatever the classifier says (p tells what it says). Spans of one kind that are base don't
    overlap; added spans overlap no other. Null and empty texts have none. Repeated rows and null keys are rows of
    their own; other columns may have any name. A table without candidates gives rows without spans. Long texts are
    scanned whole, in time proportional to their length.
    """
    found = find(df, text, keep)
    model = fit(found.select(F.explode("found").alias("c")).select("c.*"))
    kept = found.schema["kept"].dataType.simpleString()
    return found.mapInArrow(lambda b: _decide(b, model.weights), f"kept {kept}, personal array<struct<rank:int,start:int,end:int,kind:string,base:boolean,p:double>>")


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every document, with counts and a digest of the base kinds; nulls, ties and repeats as in `detect`."""
    found = detect(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("personal", lambda s: s["base"])
    count = lambda kind: F.size(F.filter("personal", lambda s: s["base"] & (s["kind"] == kind))).cast("long")
    return found.select("kept.doc_id", *[count(k).alias(f"n_{k}") for k in BASE], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("personal")).alias("spans"))
