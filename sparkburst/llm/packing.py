"""Best-two-fit packing of tokenised documents into sequences of one length."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkburst.llm.common import dropped, stored, texts_of, without

WINDOW = 2048
END_ID = 0
#: Bytes of chunks and their ids that a worker keeps, and the longest chunk kept; each entry counts _ENTRY bytes besides.
_CACHE, _LONGEST, _ENTRY = 64 << 20, 64, 200
#: White space other than the plain space and the newline.
_ODD = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0  -     　]")
_encoders: dict[str, object] = {}


class _Chunks(dict):
    """Ids (little-endian unsigned 32-bit) of short text chunks, kept while there is room."""

    def __init__(self, encode):
        super().__init__()
        self.encode, self.held = encode, 0

    def __missing__(self, chunk: str) -> bytes:
        ids = np.array(self.encode(chunk), "<u4").tobytes()
        if len(chunk) <= _LONGEST:
            self.held += _ENTRY + len(chunk) + len(ids)
            if self.held > _CACHE:
                self.clear()
                self.held = _ENTRY + len(chunk) + len(ids)
            self[chunk] = ids
        return ids


def _load(path: str):
    """A function text -> ids: the vocabulary's ranks if they lie beside the tokenizer's file, else the file itself."""
    import os

    ranks = re.sub(r"\.json$", ".tiktoken", path)
    if ranks != path and os.path.exists(ranks):
        import base64

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        special = {t.content: i for i, t in Tokenizer.from_file(path).get_added_tokens_decoder().items()}
        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens=special)
        return lambda text: own.encode(text, allowed_special="all")
    from tokenizers import Tokenizer

    loaded = Tokenizer.from_file(path)
    return lambda text: loaded.encode(text, add_special_tokens=False).ids


def token_ids(path: str):
    """A function text -> ids as bytes. Where single spaces part a text's words, a token never crosses one, so that each
    word is looked up or encoded alone; other texts are encoded whole."""
    if path not in _encoders:
        _encoders[path] = _Chunks(_load(path))
    known = _encoders[path]
    get = known.__getitem__

    def ids(text: str) -> bytes:
        if not text:
            return b""
        if "  " in text or " \n" in text or "\n " in text or text[0] == " " or text[-1] == " " or "\0" in text or _ODD.search(text):
            return np.array(known.encode(text), "<u4").tobytes()
        return b"".join(map(get, text.replace(" ", "\0 ").split("\0")))  # each word with the space before it

    return ids


def tokenise_pieces(df: DataFrame, tokenizer: str, text: str = "text", window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row per piece: df's columns but the text, piece, start, length and ids (binary, little-endian unsigned 32 bits).

    A document is its text's ids and then end_id, so a null or empty text is one id. Documents longer than the window
    are cut from their end: all pieces but the first are full. Whole texts are encoded where they lie. Repeated rows are
    documents of their own; an empty table gives no rows.
    """
    names = without(df, text, "piece", "start", "length", "ids")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = token_ids(tokenizer), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            row, piece, start, ids = [], [], [], []
            for k, body in enumerate(texts_of(batch, text)):
                data = encode(body) + end if body else end
                n = len(data) // 4
                ends = range(n - (-(-n // window) - 1) * window, n + 1, window)
                for p, stop in enumerate(ends):
                    begin = 0 if not p else stop - window
                    row.append(k)
                    piece.append(p)
                    start.append(begin)
                    ids.append(data[4 * begin : 4 * stop])
            taken = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(batch[c].take(taken) for c in names), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                [*names, "piece", "start", "length", "ids"],
            )

    made = [T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType())]
    return df.select(*names, text).mapInArrow(cut, T.StructType([*df.select(names).schema.fields, *made]))


def plan_bins(counts: dict[int, int], window: int = WINDOW) -> list[tuple[int, int, dict[int, int]]]:
    """(first bin, number of equal bins, copies by length) covering counts pieces of each length.

    Each bin is filled greedily by the longest piece that fits; then its smallest piece gives way to the two unpacked
    pieces that fill the gap it leaves most tightly, if they fill more. While no length runs out the next bin would be
    equal, so it is taken as often as the counts allow: the work depends on the window and not on the number of pieces.
    """
    left, bins, base = np.zeros(window + 1, np.int64), [], 0
    for n, c in counts.items():
        left[n] = max(c, 0)
    while left.any():
        free, used, gap = left.copy(), Counter(), window
        while gap and len(fit := np.flatnonzero(free[: gap + 1])):
            n = int(fit[-1])
            take = min(gap // n, int(free[n]))
            used[n] += take
            free[n] -= take
            gap -= take * n
        need = Counter(used)
        if gap:
            small = min(used)
            pair = _tightest(free, gap + small)
            if sum(pair) > small:
                used[small] -= 1
                used.update(pair)
                need.update(pair)
                used = +used
        times = max(1, min(int(left[n]) // c for n, c in need.items()))
        bins.append((base, times, dict(used)))
        base += times
        for n, c in used.items():
            left[n] -= c * times
    return bins


def _tightest(free: np.ndarray, room: int) -> tuple[int, ...]:
    """The two of the free pieces (a count by length) that fill room most tightly, the smaller first; nothing if none do."""
    lengths = np.flatnonzero(free)
    partner = np.searchsorted(lengths, room - lengths, "right") - 1
    alone = (partner == np.arange(len(lengths))) & (free[lengths] < 2)
    partner = partner - alone
    both = np.where(partner >= 0, lengths + lengths[partner], 0) if len(lengths) else lengths
    if not both.any():
        return ()
    at = int(both.argmax())
    return int(lengths[at]), int(lengths[partner[at]])


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, seen = TaskContext.get().partitionId(), Counter()
    for batch in batches:
        nth = []
        for n in batch["length"].to_pylist():
            nth.append(seen[n])
            seen[n] += 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(nth), pa.int32()), pa.array(nth, pa.int64())], [*batch.schema.names, "__part", "__nth"])


def pack(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """pieces (with their length, 1 to window) and, for each, sequence_id and offset.

    Pieces are written, then numbered within their partition and length and written again; counts by partition and length then give each
    piece its rank among those of its length, without gathering a length in one task. The driver plans from the counts
    by length (window numbers at most) and sends back ranges of ranks; each task looks its pieces up. Offsets in a
    sequence run from 0 without gaps. Columns sequence_id and offset of pieces are replaced. No pieces give no rows.
    """
    names = without(pieces, "sequence_id", "offset")
    kept = pieces.select(names)
    long, int_ = T.LongType(), T.IntegerType()
    made = stored(kept)  # in a stage of its own, so that a task has one Python worker and not two with an encoder each
    laid = stored(made.mapInArrow(_numbered, T.StructType([*kept.schema.fields, T.StructField("__part", int_), T.StructField("__nth", long)])))
    dropped(made)
    counts = laid.groupBy("__part", "length").agg(F.count("*").alias("__n"))
    lengths = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("__n").alias("n")).collect()}  # at most window rows
    earlier = Window.partitionBy("length").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("__part", "length", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__first"))
    ranked = laid.join(first, ["__part", "length"]).withColumn("__rank", F.col("__first") + F.col("__nth"))

    lot, given = [], Counter()
    for base, times, used in plan_bins(lengths, window):
        offset = 0
        for n, c in used.items():
            lot.append((n, given[n], base, c, offset))
            given[n] += c * times
            offset += n * c
    lot.sort()
    shared = pieces.sparkSession.sparkContext.broadcast(np.array(lot, np.int64).reshape(-1, 5))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, rank, base, copies, offset = shared.value.T
        marks = (length << 44) | rank
        for batch in batches:
            n, r = batch["length"].to_numpy(), batch["__rank"].to_numpy()
            at = np.searchsorted(marks, (n << 44) | r, "right") - 1
            q, place_ = np.divmod(r - rank[at], copies[at])
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), pa.array(base[at] + q), pa.array(offset[at] + place_ * n)], [*names, "sequence_id", "offset"])

    return ranked.select(*names, "__rank").mapInArrow(place, T.StructType([*kept.schema.fields, T.StructField("sequence_id", long), T.StructField("offset", long)]))


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids) with each sequence's pieces joined in offset order; a sequence has at most window ids."""
    rows = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return rows.select("sequence_id", F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def packing_report(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    pieces = tokenise_pieces(docs.select("doc_id", "text"), tokenizer or default_tokenizer())
    digests = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(digests).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
