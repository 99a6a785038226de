"""Packing of token windows by minimum bin slack, where documents may be cut.

A document gives as many whole windows as it can, and one remainder. Remainders are counted by length, and the driver
fills one window after another as in packing.minimum_bin_slack(): a subset-sum programme over a bitset finds the fullest
multiset of the remaining lengths, with how often each is taken by tracking back. Windows that it fills to the last
place stand. The remainders of the others, which no combination fills, are laid end to end, cut where a window ends, and
after the last whole window where the powers of two end whose sum is what is left. Hence no sequence is padded at all:
each is as long as the capacity, or a power of two.

Token ids of remainders are stored once; only those of remainders that are cut are read again, for their pieces' checksums.

Defined cases: a null text is an empty one, whose only token is the closing id; repeated rows are packed each; an empty
table gives no rows; other columns are ignored. The special token's string in a text is that token, as for the tokenizer.
"""

from __future__ import annotations

import array
import json
import os
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm.common import small_batches, spread, written
from logweave.llm.ordinals import numbered
from logweave.llm.packing import CAPACITY, MEMO_CHUNKS, PER_SALT, SALTS, _byte_letters, _tokenizer, minimum_bin_slack

CLOSING = (1).to_bytes(4, "little")
#: The settings of a vocabulary whose chunks may be encoded one by one, and plain words by the model alone.
PLAIN_SETTINGS = {
    "truncation": None,
    "padding": None,
    "normalizer": None,
    "post_processor": None,
    "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True},
}
SPECIAL = "<|endoftext|>"
#: Parts of a text at whose ends the tokenizer always begins anew: Latin letters, with the space before them, that no other
#: letter follows; another run without white space, with the space before it; and white space before such a run, its
#: last character apart. The separators from 1C to 1F are no white space to the tokenizer.
PARTS = re.compile(
    r" ?[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F]++(?![^\W\d_])| ?[\S\x1c-\x1f]+|[^\S\x1c-\x1f]+(?![\S\x1c-\x1f])|[^\S\x1c-\x1f]"
)


class Encoder:
    """Token ids of texts as little-endian bytes.

    A vocabulary with PLAIN_SETTINGS keeps white space: a word's space is its first letter. The ids of a text are those
    of its PARTS in turn, which are encoded once and remembered. Letters go straight to the tokenizer's model; any other
    part goes through the whole tokenizer. So do texts with the special token, and all texts with a vocabulary of other
    settings.
    """

    def __init__(self, path: str, memo: int = MEMO_CHUNKS) -> None:
        self.tokenizer, self.memo, self.most = _tokenizer(path), {}, memo
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        settings = json.loads(self.tokenizer.to_str())
        added = {x["content"] for x in settings["added_tokens"]}
        self.plain = added == {SPECIAL} and all(settings[k] == v for k, v in PLAIN_SETTINGS.items())

    def _whole(self, text: str) -> bytes:
        return array.array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _part(self, part: str) -> bytes:
        if not part.removeprefix(" ").isalpha():
            return self._whole(part)
        spelled = part.encode().decode("latin-1").translate(self.letters)
        return array.array("I", [t.id for t in self.model.tokenize(spelled)]).tobytes()

    def encode(self, text: str) -> bytes:
        if not self.plain or SPECIAL in text:
            return self._whole(text)
        memo, parts = self.memo, PARTS.findall(text)
        if len(memo) > self.most:
            memo.clear()
        for p in set(parts).difference(memo):
            memo[p] = self._part(p)
        return b"".join(map(memo.__getitem__, parts))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The process's encoder for a vocabulary: a Python worker keeps what it has learnt from one task to the next."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def windows(docs: DataFrame, tokenizer_path: str, *, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Stored rows (r, doc_id, h, start, length, ids_crc32, doc_tokens, ids): each document's whole windows, without
    ids, and its remainder; r numbers the rows."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode, size = encoder(tokenizer_path).encode, 4 * capacity
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        for batch in batches:
            row, cols = [], ([], [], [], [], [])
            for k, t in enumerate(batch.column("text").to_pylist()):
                ids = (encode(t) if t is not None else b"") + CLOSING
                for at in range(0, len(ids), size):
                    part = ids[at : at + size]
                    row.append(k)
                    found = (at // 4, len(part) // 4, zlib.crc32(part), len(ids) // 4, None if len(part) == size else part)
                    for col, value in zip(cols, found, strict=True):
                        col.append(value)
            found = [pa.array(col, kind) for col, kind in zip(cols, kinds, strict=True)]
            same = [batch.column(c).take(pa.array(row, pa.int64())) for c in ("doc_id", "h")]
            yield pa.RecordBatch.from_arrays([*same, *found], names=["doc_id", "h", "start", "length", "ids_crc32", "doc_tokens", "ids"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("h"), F.col(text).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    with small_batches(docs.sparkSession):
        out = rows.mapInArrow(cut, f"doc_id {id_type}, h long, start long, length long, ids_crc32 long, doc_tokens long, ids binary")
        return written(out.withColumn("r", F.monotonically_increasing_id()), "windows", "zstd")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple], list[int], int]:
    """(rows (length, from, to, times, first sequence, offset, place), bounds, first sequence of bounds).

    Numbers from to to - 1 of a length stand whole at an offset, times of them in a sequence, if place is null; else
    they are laid end to end from that place on of one line, which is cut at every bound: at multiples of the capacity
    below bounds[0], and at bounds behind it.
    """
    used: dict[int, int] = {}
    rows, first, line = [], 0, []
    for bins, combo in minimum_bin_slack(counts, capacity):
        offset, full = 0, sum(k * n for k, n in combo) == capacity
        for length, times in combo:
            at = used.get(length, 0)
            used[length] = at + bins * times
            if full:
                rows.append((length, at, used[length], times, first, offset, None))
                offset += times * length
            else:
                line.append((length, at, used[length]))
        first += bins if full else 0
    place = 0
    for length, lo, hi in line:
        rows.append((length, lo, hi, 1, first, 0, place))
        place += (hi - lo) * length
    bounds = [place - place % capacity]
    while bounds[-1] < place:
        bounds.append(bounds[-1] + (1 << (place - bounds[-1]).bit_length() - 1))
    return rows, bounds, first


def place(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Rows (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of stored rows of windows()."""
    spark = cut.sparkSession
    counts = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}  # at most capacity rows
    rows, bounds, first = plan(counts, capacity)
    plan_df = spark.createDataFrame(rows, "_length long, _lo long, _hi long, _times long, _first long, _offset long, _place long")
    salts = spread(sum(counts.values()), PER_SALT, SALTS)
    order = [F.col(c) for c in ("doc_id", "h", "start")]
    # at most two plan rows for each of the capacity's lengths and combinations: a few thousand rows
    at = F.col("_at") - F.col("_lo")
    numbers = numbered(cut.drop("ids"), ["length"], order, "_at", salts, ties=True).join(
        F.broadcast(plan_df),
        (F.col("length") == F.col("_length")) & (F.col("_at") >= F.col("_lo")) & (F.col("_at") < F.col("_hi")),
    )
    cols = ["r", "doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    whole_at = F.struct(
        (F.col("_first") + F.floor(at / F.col("_times"))).cast("long").alias("sequence_id"),
        (F.col("_offset") + F.pmod(at, F.col("_times")) * F.col("length")).cast("long").alias("offset"),
    )
    numbers = numbers.select(*cols, F.when(F.col("_place").isNull(), whole_at).alias("whole"), (F.col("_place") + at * F.col("length")).alias("p"))
    numbers = written(numbers, "placed")
    stands = numbers.where("whole is not null").select(*cols[1:], "whole.sequence_id", "whole.offset")
    # a remainder is shorter than the capacity: one multiple of it lies within at most, and bounds behind the last
    end, last = F.col("p") + F.col("length"), F.lit(bounds[0])
    next_window = (F.floor(F.col("p") / capacity) + 1) * capacity
    edges = F.concat(F.array(F.least(next_window, last)), F.array(*[F.lit(b).cast("long") for b in bounds]))
    inner = F.filter(F.array_sort(F.array_distinct(edges)), lambda e: (e > F.col("p")) & (e < end))
    pieces = numbers.where("whole is null").withColumn("from", F.concat(F.array("p"), inner)).withColumn("end", end)
    pieces = pieces.withColumn("pieces", F.transform("from", lambda f, i: F.struct(f.alias("f"), F.coalesce(F.get("from", i + 1), F.col("end")).alias("t"))))
    ids = cut.where("ids is not null").select("r", "ids")
    pieces = pieces.select(*cols, "p", F.explode_outer("pieces").alias("x")).where("x is not null").select(
        "r", "doc_id", "start", "ids_crc32", "doc_tokens", F.col("length").alias("whole"), (F.col("x.f") - F.col("p")).alias("skip"), (F.col("x.t") - F.col("x.f")).alias("length"), "x.f"
    )
    behind = F.size(F.filter(F.array(*[F.lit(b).cast("long") for b in bounds]), lambda b: b <= F.col("f"))) - 1
    start_of = F.get(F.array(*[F.lit(b).cast("long") for b in bounds]), behind)
    tail = F.col("f") >= last
    pieces = pieces.withColumns(
        {
            "sequence_id": (first + F.when(tail, bounds[0] // capacity + behind).otherwise(F.floor(F.col("f") / capacity))).cast("long"),
            "offset": F.when(tail, F.col("f") - start_of).otherwise(F.pmod(F.col("f"), F.lit(capacity))).cast("long"),
        }
    )
    uncut = pieces.where("length = whole")
    part = pieces.where("length < whole").join(ids, "r")
    part = part.withColumn("ids_crc32", F.crc32(F.substring("ids", (4 * F.col("skip") + 1).cast("int"), (4 * F.col("length")).cast("int"))))
    out = ["doc_id", (F.col("start") + F.col("skip")).alias("start"), "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return stands.unionByName(uncut.select(*out)).unionByName(part.select(*out))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pack_windows(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, **columns: str) -> DataFrame:
    return place(windows(docs, tokenizer_path or default_tokenizer(), capacity=capacity, **columns), capacity)


def op13_window_packing(docs: DataFrame) -> DataFrame:
    return pack_windows(docs)
