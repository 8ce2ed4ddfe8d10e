"""Packing: documents into sequences of fixed length, by best-fit decreasing."""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.shared import stage

SIZE, END = 2048, 1
#: Chunks of text whose ids a worker remembers, and rows that it turns into Python objects at once.
REMEMBERED, ROWS = 500_000, 1024
#: New chunks that are encoded in one call; more are slower, as they leave the processor's cache.
TOGETHER = 512
#: Longer chunks are seldom seen again and are not remembered.
FREQUENT = 11
#: Pieces that one numbering bucket gets on average.
BUCKET = 8192

_encoders: dict[int, tuple] = {}


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary; the blank stays."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = (b for b in range(256) if b not in own)
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(others)} | {32: " "}


class ChunkEncoder:
    """Token ids of whole texts, as little-endian 32-bit numbers, by remembered chunks.

    Blanks and line ends separate tokens under this vocabulary, and nothing
    in its normalisation reaches across them. So the ids of a text are those
    of its chunks, one after another. Chunks are looked up; new ones are
    encoded together, set apart by a control character that is always a token
    of its own, or, if words, by the tokens that end words. A full stop or comma after a letter, lower-cased, is one too, so such chunks
    are made from two. Words of Latin-1 letters need no normalisation beyond
    lower case and go to the merges directly. Lower case changes no ids but
    those of added tokens, so a text with "<|" keeps its case.

    All this holds for a byte-level vocabulary of lower-cased words that are
    split at marks. Whether the given one is such is tried on PROBES; if not,
    whole texts are encoded as they are.
    """

    MARK = "\x01"
    PROBES = (
        "The QUICK brown fox, it's 12 o'clock. Don't stop!! (Really?) a.b,c;d e-mail@x.org 3.14 $5 50% #tag <p>x</p> ~tilde~",
        "\u00c9t\u00e9 \u00dcber stra\u00dfe, \u00f1and\u00fa. na\u00efve\u00a0space \u0130stanbul K\u212a \u03a9mega \u4f60\u597d \U0001f600 e\u0301",
        "line one\nline  two \n\n\tTabbed\r\nend. ,  . x\x01y \u200b ...", "", " ", "UPPER lower MiXeD 1st 2nd A1B2 x,y. z",
    )

    def __init__(self, vocabulary: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_str(vocabulary)
        self.by_chunks = False
        try:
            self._prepare(vocabulary)
            self.by_chunks = self._chunked([*self.PROBES]) == [self._alone(t) for t in self.PROBES]
        except (AttributeError, LookupError, TypeError, ValueError):
            pass  # a vocabulary of another kind
        self.known, self.older = {}, {}

    def _prepare(self, vocabulary: str) -> None:
        import json

        import numpy as np
        from tokenizers import Tokenizer

        model = json.loads(vocabulary)["model"]
        self.last = np.zeros(max(model["vocab"].values()) + 1, bool)
        self.last[[i for t, i in model["vocab"].items() if t.endswith(model["end_of_word_suffix"])]] = True
        bare = json.loads(vocabulary) | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}
        self.merges = Tokenizer.from_str(json.dumps(bare))
        (self.mark,) = self.whole.encode(self.MARK, add_special_tokens=False).ids
        self.ends = {c: self._alone(c) for c in ".,"}
        self.letters = _byte_letters()
        # What is not asked for while one generation fills is forgotten with it.
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _alone(self, chunk: str) -> bytes:
        import numpy as np

        return np.array(self.whole.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()

    def _merged(self, words: set[str], into: dict[str, bytes]) -> None:
        """Adds the ids of lower-case words of Latin-1 letters. A word's last id, and no other, is one that ends words."""
        import numpy as np

        words = list(words)
        for k in range(0, len(words), TOGETHER):
            part = words[k : k + TOGETHER]
            text = " ".join(part).encode().decode("latin-1").translate(self.letters)
            ids = np.array(self.merges.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            data, at = ids.tobytes(), 0
            for c, cut in zip(part, (4 * np.flatnonzero(self.last[ids]) + 4).tolist(), strict=True):
                into[c] = data[at:cut]
                at = cut

    def _apart(self, chunks: list[str], into: dict[str, bytes]) -> None:
        """Adds the ids of any chunks without the mark, which is put between them."""
        import numpy as np

        for k in range(0, len(chunks), TOGETHER):
            part = chunks[k : k + TOGETHER]
            ids = np.array(self.whole.encode_batch_fast([f" {self.MARK} ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            data, at = ids.tobytes(), 0
            for c, cut in zip(part, [*np.flatnonzero(ids == self.mark).tolist(), len(ids)], strict=True):
                into[c] = data[at * 4 : cut * 4]
                at = cut + 1

    @staticmethod
    def _is_word(chunk: str) -> bool:
        return chunk.isalpha() and _latin(chunk)

    def _learn(self, new: list[str], look: dict[str, bytes]) -> None:
        """Adds the ids of new chunks to look."""
        known, ended, cased, words, others = self.known, [], [], set(), []
        stems = set()
        for c in new:
            if len(c) > 1 and c[-1] in self.ends and c[-2].lower().isalpha():
                ended.append(c)
                stems.add(c[:-1])
            else:
                stems.add(c)
        for c in stems:
            if c in look:
                continue
            if c in known:
                look[c] = known[c]
            elif self._is_word(c):
                low = c.lower()
                if low != c:
                    cased.append((c, low))
                words.add(low)
            elif self.MARK in c or "<|" in c:
                look[c] = self._alone(c)
            else:
                others.append(c)
        self._merged(words - look.keys(), look)
        self._apart(others, look)
        for c, low in cased:
            look[c] = look[low]
        for c in ended:
            look[c] = look[c[:-1]] + self.ends[c[-1]]

    def __call__(self, texts: list[str]) -> list[bytes]:
        return self._chunked(texts) if self.by_chunks else [self._alone(t) for t in texts]

    def _chunked(self, texts: list[str]) -> list[bytes]:
        split = [(t.lower() if "<|" not in t and _latin(t) else t).replace("\n", " ").split(" ") for t in texts]
        if len(self.known) > REMEMBERED // 2:
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        # The chunks of these texts are few enough to stay in the processor's cache.
        look, new = {"": b""}, []
        for c in set().union(*split):
            ids = known.get(c)
            if ids is None and (ids := older.get(c)) is not None:
                known[c] = ids
            if ids is None:
                new.append(c)
            else:
                look[c] = ids
        if new:
            self._learn(new, look)
            known.update((c, look[c]) for c in new if len(c) <= FREQUENT)
        look = look.__getitem__
        return [b"".join(map(look, chunks)) for chunks in split]


def _latin(text: str) -> bool:
    try:
        return text.isascii() or text.encode("latin-1") is not None
    except UnicodeEncodeError:
        return False


def encoder(vocabulary: str) -> ChunkEncoder:
    """The worker's encoder; it lives on from task to task."""
    key = hash(vocabulary)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = ChunkEncoder(vocabulary)
    return _encoders[key]


def tokenise(docs: DataFrame, vocabulary: str, size: int = SIZE, end: int = END, keep_ids: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of at most `size` ids: doc_id, row, start, length, ids_crc32, doc_tokens, and ids if asked for.

    row tells the rows of docs apart.
    A document longer than `size` is cut into full windows and a rest.
    Whole texts are encoded; null counts as empty, which leaves the end id.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(vocabulary)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("_t"), F.monotonically_increasing_id().alias("row"))
    schema = T.StructType(
        [rows.schema["doc_id"], *(T.StructField(n, T.LongType()) for n in ("row", "start", "length", "ids_crc32", "doc_tokens"))]
        + [T.StructField("ids", T.BinaryType())] * keep_ids
    )

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        encode, last = encoder(shipped.value), end.to_bytes(4, "little")
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                part = batch.slice(k, ROWS)
                at, starts, lengths, crcs, totals, ids = [], [], [], [], [], []
                for i, data in enumerate(encode(part.column(1).to_pylist())):
                    data += last
                    for s in range(0, len(data), 4 * size):
                        piece = data[s : s + 4 * size]
                        at.append(i)
                        starts.append(s // 4)
                        lengths.append(len(piece) // 4)
                        crcs.append(zlib.crc32(piece))
                        totals.append(len(data) // 4)
                        ids.append(piece if keep_ids else None)
                at = pa.array(at, pa.int64())
                columns = [part.column(0).take(at), part.column(2).take(at), *(pa.array(x, pa.int64()) for x in (starts, lengths, crcs, totals))]
                names = ["doc_id", "row", "start", "length", "ids_crc32", "doc_tokens"]
                if keep_ids:
                    columns, names = [*columns, pa.array(ids, pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(run, schema)


class OpenWindows:
    """Runs of open windows by remaining capacity, under a segment tree that finds the tightest."""

    def __init__(self, size: int):
        self.width = 1 << size.bit_length()
        self.tree = [0] * (2 * self.width)
        self.runs: dict[int, list[tuple[int, int]]] = {}

    def _mark(self, capacity: int, open_: int) -> None:
        k = self.width + capacity
        self.tree[k] = open_
        while k := k // 2:
            self.tree[k] = self.tree[2 * k] | self.tree[2 * k + 1]

    def add(self, capacity: int, first: int, count: int) -> None:
        if capacity and count:
            self.runs.setdefault(capacity, []).append((first, count))
            self._mark(capacity, 1)

    def tightest(self, length: int) -> int | None:
        """The smallest capacity of at least `length` that has an open window."""
        k = self.width + length
        while not self.tree[k]:
            while k & 1:  # a right child: nothing to its right under this parent
                k //= 2
            if not k:
                return None
            k += 1
        while k < self.width:
            k = 2 * k if self.tree[2 * k] else 2 * k + 1
        return k - self.width

    def pop(self, capacity: int) -> tuple[int, int]:
        runs = self.runs[capacity]
        run = runs.pop()
        if not runs:
            self._mark(capacity, 0)
        return run


def best_fit_decreasing(counts: Mapping[int, int], size: int = SIZE) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Where the pieces of each length go, and how many windows there are.

    Returns (length, first rank, last rank, window, pieces a window, offset):
    the pieces of that length with these ranks fill consecutive windows, so
    many in each, from that offset. The result is that of best-fit decreasing
    piece by piece: equal pieces follow each other, and the tightest window
    for the next one is the window just used until it is too full. The work
    depends on the number of different lengths, not of pieces.
    """
    windows, plan, used = OpenWindows(size), [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            capacity = windows.tightest(length)
            if capacity is None:
                capacity, first, count = size, used, -(-left // (size // length))
                used += count
            else:
                first, count = windows.pop(capacity)
            each = capacity // length
            full = min(count, left // each)
            if full:
                plan.append((length, rank, rank + full * each - 1, first, each, size - capacity))
                windows.add(capacity - each * length, first, full)
                rank, left = rank + full * each, left - full * each
                first, count = first + full, count - full
            if count and 0 < left < each:
                plan.append((length, rank, rank + left - 1, first, left, size - capacity))
                windows.add(capacity - left * length, first, 1)
                rank, left, first, count = rank + left, 0, first + 1, count - 1
            windows.add(capacity, first, count)
    return plan, used


def assign(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """The staged pieces of tokenise(), with sequence_id and offset in place of row.

    Only the histogram of lengths, at most `size` rows, comes to the driver,
    where the segment tree packs it; the plan goes back as a broadcast of a
    few rows for each length. Pieces of a length are numbered in hash buckets
    of bounded size, so a length that a third of the pieces have is spread.
    """
    spark = pieces.sparkSession
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    plan, _ = best_fit_decreasing(counts, size)
    buckets = max(1, sum(counts.values()) // BUCKET)
    keys = ["doc_id", "start", "ids_crc32", "row"]  # repeated rows have a number of their own
    dealt = pieces.withColumn("_b", F.pmod(F.xxhash64(*keys), F.lit(buckets)))
    before = (
        dealt.groupBy("length", "_b")
        .count()
        .select("length", "_b", (F.sum("count").over(Window.partitionBy("length").orderBy("_b")) - F.col("count")).alias("_before"))
    )
    numbered = dealt.join(before, ["length", "_b"]).withColumn(
        "_rank", F.col("_before") + F.row_number().over(Window.partitionBy("length", "_b").orderBy(*keys)) - 1
    )
    schema = "_length long, _lo long, _hi long, _window long, _each long, _from long"
    where = F.broadcast(spark.createDataFrame(plan, schema))
    nth = F.col("_rank") - F.col("_lo")
    return numbered.join(where, (F.col("length") == F.col("_length")) & F.col("_rank").between(F.col("_lo"), F.col("_hi"))).select(
        *(c for c in pieces.columns if c != "row"),
        (F.col("_window") + F.expr("(_rank - _lo) div _each")).alias("sequence_id"),
        (F.col("_from") + F.pmod(nth, F.col("_each")) * F.col("length")).alias("offset"),
    )


def pack(docs: DataFrame, vocabulary: str, size: int = SIZE, end: int = END, keep_ids: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids if asked for.

    vocabulary is the JSON of the tokenizer. Null text counts as empty and
    gives one piece, the end id. Repeated rows are packed once each; rows
    with a null id are packed too; other columns are ignored; an empty table
    gives no rows. Texts are encoded once, and the pieces are staged.
    """
    return assign(stage(tokenise(docs, vocabulary, size, end, keep_ids, doc_id, text), "pieces"), size)


def sequences(packed: DataFrame, size: int = SIZE, pad: int = 0) -> DataFrame:
    """The token sequences of a pack() with ids: sequence_id, filled, tokens.

    Padded to `size`, except where the filled length is a power of two. A
    sequence has at most `size` ids, so no group is large.
    """
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = packed.groupBy("sequence_id").agg(F.sum("length").alias("filled"), parts.alias("p"))
    filled = F.col("filled").cast("int")
    target = F.when(F.bit_count("filled") == 1, filled).otherwise(F.lit(size))
    return joined.select("sequence_id", "filled", _numbers()(F.col("p.ids"), target, F.lit(pad)).alias("tokens"))


def _numbers():
    @F.pandas_udf("array<int>")
    def numbers(parts, target, pad):
        import numpy as np
        import pandas as pd

        rows = []
        for p, n, x in zip(parts, target, pad, strict=True):
            ids = np.frombuffer(b"".join(p), "<u4").astype("int32")
            rows.append(np.concatenate([ids, np.full(n - len(ids), x, "int32")]))
        return pd.Series(rows)

    return numbers
