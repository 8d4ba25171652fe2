"""Expressions with escapes that Java reads in its own way: what matches there is found."""

import random

from pyspark.sql import functions as F

from plenum.llm import secrets


def test_escapes_of_java_derive_nothing():
    query = lambda x: set(secrets.trigram_query(x))
    for odd in (r"foo\vbar", r"foo\hbar", r"(x)foo\123", r"foo\0123", r"(x)\10foo", r"(?x)foo bar", r"[a[bc]]foo", r"(?iu)kelvin", r"foo\Rbar", r"foo(?#c)bar", r"\Qfoo\E"):
        assert query(odd) == set(), odd
    assert query(r"foo\x20bar") == {frozenset({"foo", "oo ", "o b", " ba", "bar"})} and query(r"(x)foo\1") and query(r"(?<!a)foo")


def test_every_match_of_java_is_found(spark):
    """Random expressions of Java's escapes over random texts: a text that rlike matches satisfies a clause."""
    rng = random.Random(5)
    bits = ["foo", "bar", "ab", "K", r"\v", r"\h", r"\s", r"\d", r"\x41", r"b", r"\t", r"\012", r"\p{L}", "[ab]", "[a[bc]]", "[a-c&&[b]]", r"\Qa.b\E", "(?:ab|foo)", "(?i:Foo)", "(?>ba)r", "x{2}", "(c)+", ".", "(?=f)", r"\R", "é"]
    glue = ["foo", "bar", "ab", "K", "\n", "\x0b", "\t", " ", "A", "b", "a.b", "c", "xx", "FOO", "é", "7", "K"]
    texts = ["".join(rng.choice(glue) for _ in range(rng.randrange(1, 9))) for _ in range(4000)]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1).cache()
    rules = list(dict.fromkeys("".join(rng.choice(bits) for _ in range(rng.randrange(2, 5))) for _ in range(60)))
    rules = [r for r in rules if r not in ("(?=f)(?=f)",)]
    asked = 0
    for at in range(0, len(rules), 20):
        part = rules[at : at + 20]
        for row in rows.select("text", *[F.rlike("text", F.lit(r)).alias(str(k)) for k, r in enumerate(part)]).collect():
            low = row.text.translate({c: c + 32 for c in range(65, 91)})
            for k, r in enumerate(part):
                if row[str(k)] and (clauses := secrets.trigram_query(r)):
                    asked += 1
                    assert any(all(g in low for g in c) for c in clauses), r
    assert asked > 100


def test_vertical_space(spark):
    rows = spark.createDataFrame([("foo\nbar",), ("fooxbar",), ("İfoo\x0bbar",)], "text string")
    got = secrets.scan(rows, (secrets.Rule("v", r"foo\vbar"),)).collect()
    assert sorted(len(r.secrets) for r in got) == [0, 1, 1]
