"""Packing of token sequences by best-fit decreasing.

Documents are tokenized and cut into full windows; what is left of each is placed, longest first, into the open
window with the least room that still fits, which a segment tree over remaining capacities finds. Tasks pack what
they read, a bounded number of tokens at a time, so nothing is shuffled. Windows that stay short of FULL are cut at
powers of two, which need no padding.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WINDOW = 2048
END_ID = 1
#: Windows with fewer tokens are cut into powers of two.
FULL = WINDOW * 31 // 32
#: Tokens of remainders that a task holds before it packs them (4 bytes each).
HELD = 4 << 20
#: Pieces of text whose ids a Python worker remembers.
REMEMBERED = 500_000

OUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids as little-endian unsigned 32-bit bytes. Words are looked up; texts with characters that Python's classes
    treat otherwise than the tokenizer's, or with its special tokens, go through the tokenizer whole. So do all texts
    if the tokenizer's file asks for another split, or for changes of the text."""

    #: What a tokenizer's file says of the split that is known here.
    KNOWN = {"normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}}
    #: Settings of a model that change how a word is cut.
    PLAIN = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
    #: The tokenizer's own split, for texts without ODD characters.
    SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
    ODD = re.compile("[\x1c-\x1f\x80-\xbf\xd7\xf7\u0250-\u200f\u2028-\u20ab\u20ad-\U0010ffff]")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        said = json.loads(self.whole.to_str())
        self.split = all(said.get(k) == v for k, v in self.KNOWN.items()) and said["model"]["type"] == "BPE" and not any(said["model"].get(k) for k in self.PLAIN)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        # Byte-level vocabularies write printable Latin-1 bytes as themselves and the others from U+0100 on, in order.
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        self.letters = {b: b for b in shown} | {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in shown)}
        self.known: dict[str, bytes] = {}

    def word(self, piece: str) -> bytes:
        written = piece.encode("utf-8", "replace").decode("latin-1").translate(self.letters)
        ids = b"".join(t.id.to_bytes(4, "little") for t in self.whole.model.tokenize(written))
        if len(self.known) < REMEMBERED:
            self.known[piece] = ids
        return ids

    def __call__(self, text: str) -> bytes:
        if not self.split or (not text.isascii() or re.search("[\x1c-\x1f]", text)) and self.ODD.search(text) or any(s in text for s in self.special):
            return b"".join(i.to_bytes(4, "little") for i in self.whole.encode(text, add_special_tokens=False).ids)
        known, word = self.known.get, self.word
        return b"".join([known(p) or word(p) for p in self.SPLIT.findall(text)])


class Rooms:
    """Segment tree over remaining capacities 0..WINDOW: how many open windows have each, and the least one that fits."""

    def __init__(self, window: int = WINDOW):
        self.leaves = 1 << window.bit_length()
        self.open: list[list[int]] = [[] for _ in range(window + 1)]
        self.count = [0] * (2 * self.leaves)

    def _add(self, room: int, n: int) -> None:
        at = room + self.leaves
        while at:
            self.count[at] += n
            at >>= 1

    def put(self, room: int, window: int) -> None:
        self.open[room].append(window)
        self._add(room, 1)

    def take(self, least: int) -> tuple[int, int] | None:
        """(room, window) of the tightest open window with room for `least`, or None."""
        at = least + self.leaves
        if not self.count[at]:
            while at > 1 and (at & 1 or not self.count[at + 1]):  # up, to the first right neighbour that holds any
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at + (not self.count[2 * at])
        room = at - self.leaves
        self._add(room, -1)
        return room, self.open[room].pop()


def best_fit_decreasing(lengths: list[int], window: int = WINDOW) -> list[list[int]]:
    """Indexes of `lengths` (1 to `window`) by window. Ties go by index."""
    rooms, windows = Rooms(window), []
    for k in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        room, at = rooms.take(lengths[k]) or (window, len(windows))
        if at == len(windows):
            windows.append([])
        windows[at].append(k)
        if room > lengths[k]:
            rooms.put(room - lengths[k], at)
    return windows


def _pack(batches: Iterator[pa.RecordBatch], path: str, window: int, tail: bytes) -> Iterator[pa.RecordBatch]:
    encode, part = Encoder(path), TaskContext.get().partitionId() << 36
    schema = pa.schema([(c.split()[0], pa.int64()) for c in OUT.split(", ")])
    rows: list[tuple] = []
    rest: list[tuple] = []  # (doc_id, start, ids, doc_tokens)
    made = held = 0

    def piece(doc, start: int, ids: bytes, total: int, offset: int) -> None:
        rows.append((doc, start, len(ids) // 4, zlib.crc32(ids), total, part + made, offset))

    def flush() -> None:
        nonlocal made, held
        for members in best_fit_decreasing([len(r[2]) // 4 for r in rest], window):
            size = sum(len(rest[k][2]) // 4 for k in members)
            cuts = [size] if size >= window * FULL // WINDOW else [1 << b for b in range(window.bit_length(), -1, -1) if size >> b & 1]
            left, offset = cuts.pop(0), 0
            for k in members:
                doc, start, ids, total = rest[k]
                while ids:
                    n = min(left, len(ids) // 4)
                    piece(doc, start, ids[: 4 * n], total, offset)
                    start, ids, offset, left = start + n, ids[4 * n :], offset + n, left - n
                    if not left and cuts:
                        left, offset, made = cuts.pop(0), 0, made + 1
            made += 1
        rest.clear()
        held = 0

    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids = encode(text.as_py() or "") + tail
            total, step = len(ids) // 4, 4 * window
            whole = len(ids) // step
            for k in range(whole):
                piece(doc, k * window, ids[k * step : (k + 1) * step], total, 0)
                made += 1
            if len(ids) > whole * step:
                rest.append((doc, whole * window, ids[whole * step :], total))
                held += total - whole * window
            if held >= HELD:
                flush()
            if len(rows) >= 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=schema)
                rows.clear()
    flush()
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=schema)


def pack(df: DataFrame, path: str | None = None, window: int = WINDOW, text: str = "text", key: str = "doc_id", end_id: int = END_ID) -> DataFrame:
    """The pieces (OUT) of all rows' token sequences. Every id of every row lies in one piece.

    A null or empty text is the end id alone. Rows with equal or null keys are packed as rows of their own. Extra
    columns don't matter. A sequence's number is unique and says nothing of order.
    """
    path, tail = path or vocabulary(), end_id.to_bytes(4, "little")
    rows = df.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(lambda batches: _pack(batches, path, window, tail), OUT)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
