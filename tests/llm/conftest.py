"""Small tables with every awkward case: nulls, empty, very long and repeated rows, ties, clashing column names."""

import random

import pytest

CLASH = "size long, source_size long, _row long, __kinds_ string, kinds string, pass int, slot long, length int, secrets_ string, rank int, "
CLASH += "_key_rows int, _shard_key string, key string, tid int, label string, of int, diag int, kept string, _place int, _home int, node int, band int, runs string, _hash int, n int, grams string, log_weight string, quality int, n_words int, spans string"
EXTRA = (1, 2, 3, "k", "k", 1, 5, 6, "s", 7, 8, "k", "k", 9, "l", 1, 2, "k", 3, 4, 5, 6, "r", 7, 8, "g", "w", 9, 1, "s")


def make_rows():
    rng = random.Random(4)
    words = ["the", "Of", "and", "theon", "heou", "était", "größe", "ñandú", "token", "license", "and,", "x.", "ingly"]
    rows = []
    for k in range(60):
        text = "\n".join(" ".join(rng.choice(words) for _ in range(rng.randint(1, 30))) for _ in range(rng.randint(1, 5)))
        rows.append([k * 3, text, rng.choice(["en", "de", None]), rng.choice(["a", "b", "", None]), len(text)])
    rows[5][1] = None
    rows[6][1] = ""
    rows[7][1] = " \n\t "
    rows[8][1] = "12 345 !!"
    rows[9][1] = " ".join(rng.choice(words) for _ in range(30_000))
    rows[10][1] = rows[11][1]
    rows[12] = list(rows[13])
    rows[14][0] = None
    rows[15][1] = 'x password = "abcdefgh12" token=secret: abcdefghij AKIA' + "Z9" * 8 + " " + "ab" * 20 + " é🎉 api_key:1234567 APIKEY:'longenough1' ghp_" + "a1" * 20
    rows[16][1] = "MIT License; the Mit, license! apache license GNU General Public License and general public"
    rows[17][1] = rows[18][1] + " tail"
    return [tuple(r) + EXTRA for r in rows]


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + CLASH)


@pytest.fixture(scope="session")
def tables(spark, rows, tmp_path_factory):
    """A folder with documents, labels and embeddings as Parquet."""
    d = str(tmp_path_factory.mktemp("tables"))
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + CLASH
    spark.createDataFrame(rows, schema).coalesce(2).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(k * 3, k % 3 > 0 and 1 or 0, 0) for k in range(40)] + [(None, 1, 1), (3, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    rng = random.Random(8)
    vectors = [(k, [rng.choice([-0.5, 0.25, 0.26, 1.0, -0.01, 0.0]) for _ in range(6)], 0) for k in range(90)]
    vectors += [(20, [1.0] * 6, 1), (21, None, 1), (40, [0.5, None], 1), (60, [float("nan")] * 6, 1), (61, [float("inf")], 1), (None, [1.0] * 6, 1), (80, [0.5, 0.5], 1), (80, [0.5, 0.5], 1), (81, [], 1), (100, [0.0] * 6, 1)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").coalesce(2).write.parquet(f"{d}/embeddings.parquet")
    spark.createDataFrame([(1, 0, "user", "a b"), (2, None, None, None), (None, 1, "x", "y")], "conv_id long, turn long, role string, text string").write.parquet(f"{d}/conversations.parquet")
    return d


@pytest.fixture(scope="session")
def empty(spark, tables, tmp_path_factory):
    """The same tables without rows."""
    d = str(tmp_path_factory.mktemp("empty"))
    for name in ("documents", "labels", "embeddings", "conversations"):
        spark.read.parquet(f"{tables}/{name}.parquet").limit(0).write.parquet(f"{d}/{name}.parquet")
    return d
