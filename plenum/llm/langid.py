"""Language identification by a byte convolutional network.

Filters of several widths slide over the bytes of fixed-length windows; each filter's largest response in a window
goes into a softmax over the languages. A text's prediction comes from the mean of its windows' logits. The network
is trained in numpy on windows of labelled texts. As a filter's response is a sum of one weight for each byte it
covers, prediction looks up sums for pairs of bytes instead of multiplying.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WINDOW = 128
WIDTHS, FILTERS = (2, 3, 4), 16
REACH = max(WIDTHS) - 1
#: The most texts of a language, windows of a text, languages and windows in all that the network is trained on.
TEXTS, WINDOWS, MOST_WINDOWS = 400, 4, 200_000
#: Languages that are learned: all of which the sample can hold a text.
MOST_LANGS = MOST_WINDOWS // WINDOWS
EPOCHS, BATCH, RATE, SEED = 6, 128, 0.01, 1
#: Bytes and windows that are worked on at once.
BYTES, ROWS = 1 << 20, 64


@dataclass(frozen=True)
class Network:
    """langs; for each width the weights (width, 256, FILTERS); the layer on top (filters of all widths, langs) and its bias."""

    langs: list[str]
    conv: list[np.ndarray]
    top: np.ndarray
    bias: np.ndarray


def _windows(texts: list[str]) -> np.ndarray:
    """Lower-cased bytes of each text's first window, with those that a filter may reach beyond it; zeros fill up."""
    out = np.zeros((len(texts), WINDOW + REACH), np.uint8)
    for row, t in zip(out, texts, strict=True):
        b = np.frombuffer(t.lower().encode("utf-8", "replace")[: len(row)], np.uint8)
        row[: len(b)] = b
    return out


def train(texts: list[str], langs: list[str]) -> Network:
    """Adam on the cross-entropy, in which all languages weigh alike; the gradient of a maximum goes to the place where it was reached."""
    names = sorted(set(langs))
    rng = np.random.default_rng(SEED)
    x, y = _windows(texts), np.searchsorted(names, langs)
    weight = (len(y) / len(names) / np.bincount(y, minlength=len(names))).astype(np.float32)
    params = [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
    params += [rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(names))).astype(np.float32), np.zeros(len(names), np.float32)]
    first, second, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for at in range(0, len(x), BATCH):
            rows = order[at : at + BATCH]
            b, n = x[rows], len(rows)
            pooled, where = [], []
            for w, weights in zip(WIDTHS, params, strict=False):
                out = weights[0][b[:, :WINDOW]]
                for k in range(1, w):
                    out += weights[k][b[:, k : WINDOW + k]]
                place = out.argmax(axis=1)
                where.append(place)
                pooled.append(np.take_along_axis(out, place[:, None], 1)[:, 0])
            h = np.concatenate(pooled, axis=1)
            logits = h @ params[-2] + params[-1]
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(n), y[rows]] -= 1
            p *= weight[y[rows], None] / n
            back = p @ params[-2].T
            grads = [np.zeros_like(v) for v in params[:-2]] + [h.T @ p, p.sum(axis=0)]
            for j, w in enumerate(WIDTHS):
                g = back[:, j * FILTERS : (j + 1) * FILTERS]
                for k in range(w):
                    np.add.at(grads[j][k], (b[np.arange(n)[:, None], where[j] + k], np.arange(FILTERS)), g)
            t += 1
            for v, g, m, s in zip(params, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                v -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
    return Network(names, params[: len(WIDTHS)], params[-2], params[-1])


class Reader:
    """Mean logits of texts, all windows of each."""

    def __init__(self, net: Network):
        self.net = net
        a, b = np.divmod(np.arange(1 << 16), 256)
        self.near = np.concatenate([c[0][a] + c[1][b] for c in net.conv], axis=1)
        self.far = np.concatenate([c[2][a] + (c[3][b] if len(c) > 3 else 0) for c in net.conv if len(c) > 2], axis=1)
        self.n_near = sum(len(c) == 2 for c in net.conv) * FILTERS

    def pooled(self, b: np.ndarray, last: np.ndarray) -> np.ndarray:
        """b: the bytes of all windows, one after the other, and REACH + 1 more; last: which windows end their text, so that
        filters see zeros behind them. The largest responses of each window."""
        n = len(last)
        out = np.empty((n, self.near.shape[1]), np.float32)
        one, two = np.empty((WINDOW, ROWS, self.near.shape[1]), np.float32), np.empty((WINDOW, ROWS, self.far.shape[1]), np.float32)
        windows = np.lib.stride_tricks.as_strided(b, (n, WINDOW + REACH + 1), (WINDOW * b.itemsize, b.itemsize))
        for at in range(0, n, ROWS):
            rows = min(ROWS, n - at)
            m = np.zeros((ROWS, windows.shape[1]), np.intp)
            m[:rows] = windows[at : at + rows]
            m[:rows][last[at : at + rows], WINDOW:] = 0
            m = m.T
            np.take(self.near, m[:WINDOW] << 8 | m[1 : WINDOW + 1], axis=0, out=one, mode="clip")
            np.take(self.far, m[2 : WINDOW + 2] << 8 | m[3 : WINDOW + 3], axis=0, out=two, mode="clip")
            one[:, :, self.n_near :] += two
            out[at : at + rows] = one.max(axis=0)[:rows]
        return out

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        """Probabilities (texts, langs)."""
        counts = np.array([(len(t) + REACH - 1) // WINDOW + 1 for t in texts])
        b = np.frombuffer(b"".join(t.ljust(c * WINDOW, b"\0") for t, c in zip(texts, counts, strict=True)) + bytes(REACH + 1), np.uint8)
        last = np.zeros(int(counts.sum()), bool)
        last[np.cumsum(counts) - 1] = True
        h = self.pooled(b, last)
        logits = np.add.reduceat(h @ self.net.top, np.r_[0, np.cumsum(counts)[:-1]], axis=0) / counts[:, None] + self.net.bias
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


def _predict(batches: Iterator[pa.RecordBatch], net: Network) -> Iterator[pa.RecordBatch]:
    """(..., text last) -> the same with lang_pred and score in place of the text."""
    reader = Reader(net) if net.langs else None
    for batch in batches:
        langs, scores = ["und"] * batch.num_rows, [0.0] * batch.num_rows
        held: list[tuple[int, bytes]] = []
        size = 0

        def flush() -> None:
            for (k, _), p in zip(held, reader([t for _, t in held]), strict=True):
                best = int(p.argmax())
                langs[k], scores[k] = net.langs[best], float(p[best])
            held.clear()

        for k, value in enumerate(batch.column(batch.num_columns - 1)):
            text = value.as_py()
            if text and reader and any(map(str.isalpha, text)):
                held.append((k, text.lower().encode("utf-8", "replace")))
                size += len(held[-1][1])
                if size >= BYTES:
                    flush()
                    size = 0
        if held:
            flush()
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names[:-1], "lang_pred", "score"])


def sample(rows: DataFrame) -> list[tuple[str, str]]:
    """(lang, window): WINDOWS windows of each of TEXTS different texts of a language (all, if it has fewer), those with the least hashes.

    A text counts once for a language, however many rows hold it. Of many languages each gives fewer texts, so that
    there are MOST_WINDOWS windows at most; beyond one text each (MOST_LANGS) those with the most rows are learned, ties by name.
    """
    rows = rows.where("text IS NOT NULL AND lang IS NOT NULL").select("lang", "text", F.xxhash64("text", F.lit(SEED)).alias("_hash"))
    langs = rows.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct("_hash").alias("different"))
    langs = langs.orderBy(F.col("n").desc(), "lang").limit(MOST_LANGS).collect()
    if not langs:
        return []
    texts = max(1, min(TEXTS, MOST_WINDOWS // (WINDOWS * len(langs))))
    # Hashes below a language's share are some two times the texts that are asked for, so that little is sorted.
    share = F.broadcast(rows.sparkSession.createDataFrame([(r.lang, min(1.0, 2 * (texts + 20) / max(r.different, 1))) for r in langs], "lang string, _share double"))
    u = F.pmod("_hash", F.lit(1 << 40)) / float(1 << 40)
    drawn = rows.join(share, "lang").where(u < F.col("_share")).dropDuplicates(["lang", "_hash"])
    least = drawn.withColumn("_n", F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("_hash", F.lit(1 << 40)), "_hash"))).where(F.col("_n") <= texts)
    start = F.pmod(F.xxhash64("text", "_k"), F.greatest(F.length("text") - WINDOW, F.lit(1))) + 1
    windows = least.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(WINDOWS - 1)))).select("lang", F.substring("text", start.cast("int"), F.lit(WINDOW + REACH)).alias("w"))
    return sorted((r.lang, r.w) for r in windows.collect())  # MOST_WINDOWS at most, or a window for each of MOST_LANGS


def fit(rows: DataFrame) -> Network:
    """A network for the languages of `rows` (text, lang), from the windows of `sample` that hold a letter.

    Rows with a null text or language are not learned from; without any the network knows no language.
    """
    pairs = [(lang, w) for lang, w in sample(rows) if any(map(str.isalpha, w))]
    if not pairs:
        return Network([], [], np.zeros(0), np.zeros(0))
    return train([w for _, w in pairs], [lang for lang, _ in pairs])


def predict(df: DataFrame, net: Network, keep: list[str], text: str = "text") -> DataFrame:
    """The columns `keep` (name and type) of `df` with `lang_pred` and `score` for the whole text of each row.

    A null text, one without a letter, and any text if no language was learned, are `und` with score 0. Equal texts
    get equal predictions.
    """
    columns = [F.col(f"`{c.split()[0]}`") for c in keep]
    return df.select(*columns, F.col(f"`{text}`")).mapInArrow(lambda batches: _predict(batches, net), ", ".join([*keep, "lang_pred string", "score double"]))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document; those with held_out, and those without doc_id, were not learned from.

    Repeated rows stay rows of their own, with equal predictions; columns besides doc_id, text and lang don't matter.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").withColumn("held_out", held_out(F.col("doc_id")))
    net = fit(docs.where(~F.col("held_out") & F.col("doc_id").isNotNull()))
    return predict(docs, net, ["doc_id long", "held_out boolean"])
