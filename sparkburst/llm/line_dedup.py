"""Removing lines that nearly repeat earlier lines: an exact set-similarity self-join over line tokens."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkburst.llm import wordhash as H
from sparkburst.llm.common import BROADCAST_ROWS, dropped, join_checked, let, settled, stored, trimmed

MIN_JACCARD = 0.8
#: Buckets of the table of token counts: a fixed size, whatever the corpus; it only orders tokens.
_RARITY_BITS, _PARTS = 22, 64
#: Bits of the filter that tells which sets have to be read for verification.
_NEED_BITS = 25
#: Sets of so many tokens also carry a parity bitmap of 256 bits: 64 bits are full with sets of this size.
_WIDE = 64
_PARTS_OF_WIDE = ("w0", "w1", "w2")
#: Candidates a set sends from one token's list in the first round; sets left unmatched send all in the second.
#: by kind: those whose bitmaps differ in at most half of the bits that the threshold allows, nearly all of which match,
#: and the others.
FIRST_ROUND = (4, 20)
_POSTINGS = 200_000
#: What a posting carries of its line, behind its place in a list; postings of a line slice; buckets of tokens per partition.
_OWN = ("sid", "doc_id", "line", "bits", *_PARTS_OF_WIDE, "probe")
_NARROW = ("sid", "doc_id", "line", "bits", "probe")
POSTED = "bucket long, data binary, wide binary"
_SLICE, _BUCKETS = 1 << 18, 8
#: Texts that are taken out of a batch at once; sets that a task remembers as sent before it forgets them all (they are then sent again).
_ROWS, _SEEN = 512, 200_000
#: Null ids come first.
_NULL_ID = -(1 << 63)


class _Lines:
    """Lines with words of some texts: their distinct tokens, sorted by line and then by `rarity`."""

    def __init__(self, texts: list[bytes], rarity: np.ndarray | None = None):
        data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        starts, ends = H.words(data)
        self.tokens = H.hash_spans(data, starts, ends)
        if rarity is None:
            return
        breaks = np.flatnonzero(data == 0x0A)
        first = np.concatenate(([0], np.searchsorted(breaks, np.cumsum([len(t) + 1 for t in texts]))))
        self._gather(np.searchsorted(breaks, starts), first, len(breaks), rarity)

    def _gather(self, line: np.ndarray, first: np.ndarray, n_lines: int, rarity: np.ndarray) -> None:
        """Sets from self.tokens, of which each has its line's number in the group; first: the first line of each text."""
        bucket = self.tokens >> np.uint64(64 - _RARITY_BITS)
        rare = rarity[bucket]
        # One sort by (line, rarity, token) where they fit in a word; the low bits of a token rarely matter.
        packed = (line.astype(np.uint64) << np.uint64(43)) | (rare.astype(np.uint64) << np.uint64(35)) | (self.tokens >> np.uint64(29))
        order = np.argsort(packed)
        tied = packed[order][1:] == packed[order][:-1]
        if n_lines >= 1 << 21 or (tied & (self.tokens[order][1:] != self.tokens[order][:-1])).any():
            order = np.lexsort((self.tokens, rare, line))
        line, token, rare = line[order], self.tokens[order], rare[order]
        new = np.ones(len(line), bool)
        new[1:] = (line[1:] != line[:-1]) | (token[1:] != token[:-1])
        self.line, self.token, self.rare = line[new], token[new], rare[new]
        self.begin = np.flatnonzero(np.concatenate(([True], self.line[1:] != self.line[:-1]))) if len(self.line) else np.zeros(0, np.int64)
        self.size = np.diff(np.concatenate((self.begin, [len(self.line)])))
        number = self.line[self.begin]
        self.doc = np.searchsorted(first, number, "right") - 1
        self.number = (number - first[self.doc]).astype(np.int32)
        if len(self.begin):
            self.sid = np.add.reduceat(H.mix(self.token), self.begin).view(np.int64)
            self.bits = np.bitwise_xor.reduceat(np.uint64(1) << (self.token & np.uint64(63)), self.begin).view(np.int64)
        else:
            self.sid = self.bits = np.zeros(0, np.int64)

    def wide(self, wanted: np.ndarray) -> np.ndarray:
        """Three columns: the parts of a 256-bit parity bitmap that, with the fourth, xor to `bits`; zeros where not wanted."""
        out = np.zeros((3, len(self.begin)), np.int64)
        rows = np.flatnonzero(wanted)
        if len(rows):
            token = self.token[np.repeat(wanted, self.size)]
            begin = np.concatenate(([0], np.cumsum(self.size[rows])[:-1]))
            part, bit = (token >> np.uint64(6)) & np.uint64(3), np.uint64(1) << (token & np.uint64(63))
            for k in range(3):
                out[k, rows] = np.bitwise_xor.reduceat(np.where(part == k, bit, np.uint64(0)), begin).view(np.int64)
        return out


def _groups(batch: pa.RecordBatch) -> Iterator[tuple[int, int, list[bytes]]]:
    for at in range(0, batch.num_rows, _ROWS):
        texts = [(t or "").encode() for t in batch["text"].slice(at, _ROWS).to_pylist()]
        for a, b in H.chunks([len(t) for t in texts]):
            yield at + a, at + b, texts[a:b]


def _summed(parts: DataFrame, fold, width: int) -> np.ndarray:
    """A fixed-size table from (part, at: uint16 places, value) rows: each part is folded in one task."""

    def one(key: tuple, rows: pa.Table) -> pa.Table:
        total = np.zeros(width, np.int64)
        for at, value in zip(rows["at"].to_pylist(), rows["value"].to_pylist(), strict=True):
            np.add.at(total, np.frombuffer(at, "<u2"), np.frombuffer(value, "<u4"))
        return pa.table({"part": [key[0].as_py()], "data": [fold(total).tobytes()]})

    rows = parts.groupBy("part").applyInArrow(one, "part long, data binary").collect()  # one row a part, of fixed size
    out = np.zeros((_PARTS, width), np.uint8)
    for r in rows:
        out[r["part"]] = np.frombuffer(r["data"], np.uint8)
    return out.reshape(-1)


def _sparse(counts: np.ndarray, width: int) -> Iterator[pa.RecordBatch]:
    found = np.flatnonzero(counts)
    edges = np.searchsorted(found, np.arange(_PARTS + 1) * width)
    rows = [(p, found[a:b]) for p, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if b > a]
    yield pa.RecordBatch.from_arrays(
        [pa.array([p for p, _ in rows], pa.int64()), pa.array([(x % width).astype("<u2").tobytes() for _, x in rows], pa.binary()), pa.array([counts[x].astype("<u4").tobytes() for _, x in rows], pa.binary())],
        ["part", "at", "value"],
    )


def token_rarity(docs: DataFrame, kind=_Lines) -> np.ndarray:
    """Rarity class (0: seen once at most) of each of 2^22 token buckets, counted over all texts; 4 MB for any corpus."""
    width = (1 << _RARITY_BITS) // _PARTS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << _RARITY_BITS, np.int64)
        for batch in batches:
            for _, _, texts in _groups(batch):
                np.add.at(total, (kind(texts).tokens >> np.uint64(64 - _RARITY_BITS)).astype(np.int64), 1)
        yield from _sparse(np.minimum(total, 0xFFFFFFFF), width)

    parts = docs.select("text").mapInArrow(trimmed(count), "part long, at binary, value binary")
    return _summed(parts, lambda n: np.where(n <= 1, 0, np.clip(8 * np.log2(np.maximum(n, 1)), 1, 255)).astype(np.uint8), width)


def _prefix_length(n: np.ndarray, least: float) -> np.ndarray:
    return n - np.ceil(least * n - 1e-9).astype(np.int64) + 1


def line_sets(docs: DataFrame, rarity, least: float, kind=_Lines, packed: bool = False) -> DataFrame:
    """(doc_id, text_hash, line, sid, bits, w0, w1, w2, prefix) of every line with words.

    sid names the line's token set; bits is its parity bitmap, w0 to w2 are parts of the wide one (see _Lines.wide). prefix holds, for lines of a set that come before all that
    the task has seen, one long per token of the rarity-ordered prefix: token hash (32 bits), set size and place (16 bits each, saturated).
    Tokens seen once in the corpus are left out: no other line can have them. packed: prefix is the bytes of these longs,
    which Spark moves as one value.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, list[int]] = {}
        for batch in batches:
            ids = batch["doc_id"].fill_null(_NULL_ID).to_numpy()
            for a, _, texts in _groups(batch):
                x = kind(texts, rarity.value)
                if not len(x.begin):
                    continue
                place = np.arange(len(x.token)) - np.repeat(x.begin, x.size)
                used = (place < np.repeat(_prefix_length(x.size, least), x.size)) & (x.rare > 0)
                fresh = np.zeros(len(x.sid), bool)
                for k, (s, *at) in enumerate(zip(x.sid.tolist(), ids[x.doc + a].tolist(), x.number.tolist(), strict=True)):
                    if s not in seen or at < seen[s]:
                        seen[s] = at
                        fresh[k] = True
                if len(seen) > _SEEN:
                    seen.clear()
                used &= np.repeat(fresh, x.size)
                owner = np.repeat(np.arange(len(x.begin)), x.size)[used]
                size = np.minimum(np.repeat(x.size, x.size)[used], 0xFFFF)
                posts = ((x.token[used] >> np.uint64(32)) << np.uint64(32)) | (size.astype(np.uint64) << np.uint64(16)) | np.minimum(place[used], 0xFFFF).astype(np.uint64)
                offsets = np.searchsorted(owner, np.arange(len(x.begin) + 1)).astype(np.int32)
                if packed:
                    prefix = pa.Array.from_buffers(pa.binary(), len(x.begin), [None, pa.py_buffer(8 * offsets), pa.py_buffer(posts)])
                else:
                    prefix = pa.ListArray.from_arrays(pa.array(offsets), pa.array(posts.view(np.int64)))
                row = pa.array(x.doc + a)
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].take(row), batch["text_hash"].take(row), pa.array(x.number), pa.array(x.sid), pa.array(x.bits), *map(pa.array, x.wide(fresh & (x.size >= _WIDE))), prefix],
                    ["doc_id", "text_hash", "line", "sid", "bits", *_PARTS_OF_WIDE, "prefix"],
                )

    return docs.mapInArrow(trimmed(run), "doc_id long, text_hash long, line int, sid long, bits long, w0 long, w1 long, w2 long, prefix " + ("binary" if packed else "array<long>"))


def _posts(prefix: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The longs of all prefixes, lists or packed, and how many each has."""
    if pa.types.is_list(prefix.type):
        return prefix.flatten().to_numpy(), np.diff(prefix.offsets.to_numpy())
    held = prefix.to_pylist()
    return np.frombuffer(b"".join(held), np.int64), np.array([len(x) // 8 for x in held], np.int64)


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        token = np.unique(_posts(batch["prefix"])[0].view(np.uint64) >> np.uint64(32))
        yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64))], ["token"])


def _postings(buckets: int, tokens=None):
    """Rows of POSTED from lines: the postings of a bucket of tokens, column by column as 64-bit integers (post, then _NARROW), and the wide bitmaps of those of _WIDE tokens or more.

    A row holds what one slice of lines has for a bucket, so that a shuffle moves few, large rows; where there are more
    buckets than postings it is one posting. tokens: a sorted array in a broadcast, beside which postings are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            posts, lengths = _posts(batch["prefix"])
            begin = np.concatenate(([0], np.cumsum(lengths)))
            for a, b in H.chunks(lengths.tolist(), _SLICE):
                rows = batch.slice(a, b - a)
                post, owner = posts[begin[a] : begin[b]], np.repeat(np.arange(b - a), lengths[a:b])
                token = post.view(np.uint64) >> np.uint64(32)
                if tokens is not None:
                    asked = np.isin(token, tokens.value)
                    post, owner, token = post[asked], owner[asked], token[asked]
                bucket = (token % np.uint64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.int64)  # 16 bits are sorted by counting
                order = np.argsort(bucket, kind="stable")
                post, owner, bucket = post[order], owner[order], bucket[order]
                column = lambda c: (rows[c].fill_null(_NULL_ID) if c == "doc_id" else rows[c].cast(pa.int64())).to_numpy()  # noqa: B023, E731
                data = np.vstack([post, *(column(c)[owner] for c in _NARROW)])
                long = ((post >> 16) & 0xFFFF) >= _WIDE
                wide = np.vstack([column(c)[owner[long]] for c in _PARTS_OF_WIDE])
                edge = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else np.zeros(0, np.int64)
                ends = np.concatenate((edge[1:], [len(bucket)]))
                before = np.concatenate(([0], np.cumsum(long)))
                cut = lambda of, x, y: pa.array([of[:, i:j].tobytes() for i, j in zip(x.tolist(), y.tolist(), strict=False)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(bucket[edge].astype(np.int64)), cut(data, edge, ends), cut(wide, before[edge], before[ends])], ["bucket", "data", "wide"])

    return trimmed(run)


def _place(doc: np.ndarray, line: np.ndarray) -> np.ndarray:
    """A hash of a line's place, which tells lines to read again from nearly all others."""
    return H.mix(H.mix(doc.view(np.uint64)) + line.astype(np.uint64)).view(np.int64)


def _list_order(token: np.ndarray, doc: np.ndarray, line: np.ndarray, sid: np.ndarray) -> np.ndarray:
    """Postings by token, doc, line and sid; of a set that was sent more than once for a token, only the first."""
    first, last = int(doc.min()), int(doc.max())
    order = None
    if last - first < 1 << 32 and line.min() >= 0 and line.max() < 1 << 31 and len(token) < 1 << 32:
        # One sort by place and one by (token, place's rank), each of a single word.
        at = ((doc - first) << 31) | line
        order = np.argsort(at)
        at, sids = at[order], sid[order]
        if ((at[1:] == at[:-1]) & (sids[1:] != sids[:-1])).any():
            order = None  # repeated ids
        else:
            order = order[(np.sort((token[order] << np.uint64(32)) | np.arange(len(token), dtype=np.uint64)) & np.uint64(0xFFFFFFFF)).astype(np.int64)]
    if order is None:
        order = np.lexsort((sid, line, doc, token))
    token, sid = token[order], sid[order]
    code = H.mix(token) ^ sid.view(np.uint64)
    ranked = np.sort(code)
    twice = np.unique(ranked[1:][ranked[1:] == ranked[:-1]])
    if len(twice):
        some = np.flatnonzero(twice[np.minimum(np.searchsorted(twice, code), len(twice) - 1)] == code)
        some = some[np.lexsort((some, sid[some], token[some]))]
        again = (token[some][1:] == token[some][:-1]) & (sid[some][1:] == sid[some][:-1])
        order = np.delete(order, some[1:][again])
    return order


def _candidates(least: float, limit: tuple[int, int] | None, apart: bool = False, places: bool = False):
    """Pairs (a, b, more) from postings: b comes before a and passes the length, positional and bitmap filters.

    In the first round each set sends its `limit` nearest earlier candidates and one that says that there are more; in
    the second, sets that are marked send all. apart: `line` names a group that is known to belong together, and only
    pairs of different groups are sent. places: pairs also have at_a and at_b, the _place of each set's first line, the
    same in all lists.
    """
    told = ("at_a", "at_b") if places else ()

    def meet(rank, base, sid, size, place, bits, wide, probe, at) -> pa.Table:
        """Compares each posting with the one `lag` places before its base in its list, for lag 1, 2, ..., all lists at once.

        The base is the posting itself or, with apart, the first one of its group in the list; rank is the base's.
        """
        count = np.zeros((2, len(sid)), np.int64)
        out: list[tuple] = []
        rest = (size - place).astype(np.int32)
        full = size == 0xFFFF  # saturated sizes can't be filtered
        low = np.where(full, 0, np.ceil(least * size - 1e-9)).astype(np.int32)
        high = np.where(full, 0xFFFF, np.floor(size / least + 1e-9)).astype(np.int32)
        size = size.astype(np.int32)
        needed = np.ceil(least / (1 + least) * np.arange(2 * int(size.max()) + 1) - 1e-9).astype(np.int32)  # by the sum of two sizes
        # Those with most before them come first, so that the ones that still have a partner at a lag are a slice.
        waiting = np.flatnonzero(probe & (rank >= 1))
        waiting = waiting[np.argsort(-rank[waiting], kind="stable")]
        left, bases, lows, highs = -rank[waiting], base[waiting], low[waiting], high[waiting]
        closed, n_closed, lag, any_full = np.zeros(len(sid), bool), 0, 1, bool(full.any())
        while n := int(np.searchsorted(left, -lag, "right")):
            near = size[bases[:n] - lag]
            met = (near >= lows[:n]) & (near <= highs[:n])
            if any_full:
                met |= near == 0xFFFF
            k = np.flatnonzero(met)
            x, b = waiting[k], bases[k] - lag
            lag += 1
            both = size[x] + size[b]
            need = needed[both]
            fits = np.minimum(rest[x], rest[b]) >= need
            if any_full:
                fits |= full[x] | full[b]
            fits = np.flatnonzero(fits & ~closed[x])
            x, b, both, need = x[fits], b[fits], both[fits], need[fits]
            spare = both - 2 * need
            apart = np.bitwise_count(bits[x] ^ bits[b]).astype(np.int32)
            large = np.flatnonzero((apart <= spare) & (np.minimum(size[x], size[b]) >= _WIDE))
            if len(large):
                last, total = bits[x[large]] ^ bits[b[large]], np.zeros(len(large), np.int32)
                for w in wide:
                    differ = w[x[large]] ^ w[b[large]]
                    last ^= differ
                    total += np.bitwise_count(differ)
                apart[large] = total + np.bitwise_count(last)
            ok = (apart <= spare) | full[x] | full[b]
            if ok.any():
                hit = x[ok]
                count[(2 * apart > spare)[ok].astype(int), hit] += 1
                over = np.zeros(len(hit), bool) if limit is None else (count[0, hit] > limit[0]) | (count[1, hit] > limit[1])
                out.append((sid[hit], sid[b[ok]], over, *((at[hit], at[b[ok]]) if places else ())))
                if over.any():
                    closed[hit[over]] = True
                    n_closed += np.count_nonzero(over)
                    if 8 * n_closed > n:
                        kept, n_closed = ~closed[waiting], 0
                        waiting, left, bases, lows, highs = (c[kept] for c in (waiting, left, bases, lows, highs))
        none = np.zeros(0, np.int64)
        return pa.table({n: np.concatenate([none.astype(kind), *(o[k] for o in out)]) for k, (n, kind) in enumerate((("a", np.int64), ("b", np.int64), ("more", bool), *((n, np.int64) for n in told)))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, beside = [], []
        for batch in batches:
            held += [np.frombuffer(x.as_buffer(), np.int64).reshape(1 + len(_NARROW), -1) for x in batch["data"]]
            beside += [np.frombuffer(x.as_buffer(), np.int64).reshape(len(_PARTS_OF_WIDE), -1) for x in batch["wide"]]
        if not held:
            return
        post, sid, doc, line, bits, probe = np.concatenate(held, axis=1)
        wide = np.zeros((len(_PARTS_OF_WIDE), len(post)), np.int64)
        wide[:, ((post >> 16) & 0xFFFF) >= _WIDE] = np.concatenate(beside, axis=1)
        held.clear()
        beside.clear()
        probe = probe.astype(bool)
        token = post.view(np.uint64) >> np.uint64(32)
        if apart:
            order = np.lexsort((line, doc, sid, token))
            again = (token[order][1:] == token[order][:-1]) & (sid[order][1:] == sid[order][:-1])
            order = order[np.concatenate(([True], ~again))]  # a set that was sent more than once: its first line
            order = order[np.lexsort((sid[order], doc[order], line[order], token[order]))]
        else:
            order = _list_order(token, doc, line, sid)
        token, post = token[order], post[order]
        start = np.concatenate(([True], token[1:] != token[:-1]))
        base = np.arange(len(token))
        if apart:
            group = start | np.concatenate(([True], line[order][1:] != line[order][:-1]))
            base = np.flatnonzero(group)[np.cumsum(group) - 1]
        rank = base - np.flatnonzero(start)[np.cumsum(start) - 1]
        rows = meet(rank, base, sid[order], (post >> 16) & 0xFFFF, post & 0xFFFF, bits[order].view(np.uint64), [w[order].view(np.uint64) for w in wide], probe[order], _place(doc[order], line[order]) if places else None)
        if rows.num_rows:
            rows = rows.group_by(["a", "b"]).aggregate([("more", "max"), *((n, "min") for n in told)]).select(["a", "b", "more_max", *(f"{n}_min" for n in told)]).rename_columns(["a", "b", "more", *told])
            yield from rows.to_batches()

    return trimmed(run)


def _asked(need: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether each value's bit is set in a filter of 2^_NEED_BITS bits."""
    at = at & ((1 << _NEED_BITS) - 1)
    return (need[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _asked_lines(texts: list[bytes], ids: np.ndarray, need: np.ndarray) -> list[bytes]:
    """The lines of texts whose places are in the filter."""
    data = b"\n".join([*texts, b""])
    ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 0x0A)
    first = np.concatenate(([0], np.searchsorted(ends, np.cumsum([len(t) + 1 for t in texts]))))
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    found = np.flatnonzero(_asked(need, _place(ids[doc], np.arange(len(ends)) - first[doc])))
    starts = np.concatenate(([0], ends[:-1] + 1))
    return [data[a:b] for a, b in zip(starts[found].tolist(), ends[found].tolist(), strict=True)]


def _verified(pairs: DataFrame, docs: DataFrame, first: DataFrame, rarity, least: float, kind=_Lines) -> DataFrame:
    """The pairs (a, b) whose token sets have Jaccard >= least, stored. Only sets that occur in pairs send their tokens on.

    Where pairs have places (see _candidates) only the lines there are taken apart, else all lines are.
    Where these sets are few enough to be broadcast, only the documents with their first lines are read again.
    """
    wanted = stored(pairs.select(F.col("a").alias("sid")).union(pairs.select("b")).distinct())
    if wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        holders = first.join(F.broadcast(wanted), "sid").select(F.coalesce("first.doc_id", F.lit(_NULL_ID)).alias("holder")).distinct()
        docs = docs.join(F.broadcast(holders), F.coalesce(docs["doc_id"], F.lit(_NULL_ID)) == F.col("holder"), "left_semi")
    width = (1 << (_NEED_BITS - 3)) // _PARTS
    placed = "at_a" in pairs.columns
    marked = ("at_a", "at_b") if placed else ("a", "b")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        need = np.zeros(1 << _NEED_BITS, bool)
        for batch in batches:
            for c in marked:
                need[batch[c].to_numpy() & ((1 << _NEED_BITS) - 1)] = True
        packed = np.packbits(need, bitorder="little")
        for p in range(_PARTS):
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int64()), pa.array([packed[p * width : (p + 1) * width].tobytes()], pa.binary())], ["part", "data"])

    def merge(key: tuple, rows: pa.Table) -> pa.Table:
        total = np.zeros(width, np.uint8)
        for x in rows["data"].to_pylist():
            total |= np.frombuffer(x, np.uint8)
        return pa.table({"part": [key[0].as_py()], "data": [total.tobytes()]})

    need = np.zeros((_PARTS, width), np.uint8)
    marks = max(8, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 8)
    for r in pairs.select(*marked).coalesce(marks).mapInArrow(trimmed(mark), "part long, data binary").groupBy("part").applyInArrow(merge, "part long, data binary").collect():
        need[r["part"]] = np.frombuffer(r["data"], np.uint8)  # 64 rows of fixed size
    shared = docs.sparkSession.sparkContext.broadcast(need.reshape(-1))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            ids = batch["doc_id"].fill_null(_NULL_ID).to_numpy()
            for a, b, texts in _groups(batch):
                if placed:
                    texts = _asked_lines(texts, ids[a:b], shared.value)
                    if not texts:
                        continue
                x = kind(texts, rarity.value)
                asked = np.ones(len(x.sid), bool) if placed else _asked(shared.value, x.sid)
                for k in np.flatnonzero(asked).tolist():
                    asked[k] = x.sid[k] not in seen
                    seen.add(int(x.sid[k]))
                if len(seen) > _SEEN:
                    seen.clear()
                if asked.any():
                    offsets = np.concatenate(([0], np.cumsum(x.size[asked]))).astype(np.int32)
                    tokens = x.token[np.repeat(asked, x.size)].view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(x.sid[asked]), pa.ListArray.from_arrays(pa.array(offsets), pa.array(tokens))], ["sid", "tokens"])

    sets = docs.select("doc_id", "text").mapInArrow(trimmed(read), "sid long, tokens array<long>").join(wanted, "sid", "left_semi").dropDuplicates(["sid"])
    sets = stored(sets)
    left, right = sets.select(F.col("sid").alias("a"), F.col("tokens").alias("ta")), sets.select(F.col("sid").alias("b"), F.col("tokens").alias("tb"))
    common = F.size(F.array_intersect("ta", "tb"))
    out = stored(pairs.join(left, "a").join(right, "b").where((1 + least) * common >= least * (F.size("ta") + F.size("tb")) - 1e-9).select("a", "b"))
    dropped(wanted, sets)
    return out


def repeated_lines(df: DataFrame, key: str = "doc_id", text: str = "text", least: float = MIN_JACCARD, distinct: bool = True) -> DataFrame:
    """(doc_id, text_hash, line) of every line that an earlier line matches: token sets with Jaccard >= least.

    Lines are read in the order of doc_id, number and, for repeated ids, token set; a line goes if any earlier line of the table matches,
    whether or not that one goes too. Token sets are 64-bit word hashes. Equal sets are one set with its first line, so
    copies are never paired. Sets meet over their rarest tokens (prefix filter; rarity is counted over all texts) and
    must pass length, positional and parity-bitmap filters before their whole sets are compared. As one earlier match
    is enough, a set first tries its nearest candidates only; those still unmatched that have more try them all.

    Lines without words are never removed; rows that agree in doc_id and text hold equal places, and neither removes
    the other. Null texts have no lines; null ids come first. An empty table gives no rows. Without distinct, lines of
    repeated rows are told once for each row.
    """
    docs = df.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    rarity = docs.sparkSession.sparkContext.broadcast(token_rarity(docs))
    lines = stored(line_sets(docs, rarity, least, packed=True))
    first = stored(lines.groupBy("sid").agg(F.min(F.struct("doc_id", "line", "text_hash")).alias("first"), F.count("*").alias("n")))
    total = (lines.agg(F.sum(F.octet_length("prefix"))).first()[0] or 0) // 8
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // _POSTINGS))
    posted = lines.where(F.octet_length("prefix") > 0)

    def matched(probes: DataFrame, limit: tuple[int, int] | None, tokens=None) -> tuple[DataFrame, DataFrame]:
        posts = probes.select("prefix", *_OWN).mapInArrow(_postings(_BUCKETS * parts, tokens), POSTED).repartition(parts, "bucket")
        met = posts.mapInArrow(_candidates(least, limit, places=True), "a long, b long, more boolean, at_a long, at_b long")
        pairs = stored(met.groupBy("a", "b").agg(F.max("more").alias("more"), F.min("at_a").alias("at_a"), F.min("at_b").alias("at_b")))
        return _verified(pairs, docs, first, rarity, least).select(F.col("a").alias("sid")).distinct(), pairs

    gone, pairs = matched(posted.withColumn("probe", F.lit(True)), FIRST_ROUND)
    left = stored(pairs.where("more").select(F.col("a").alias("sid")).distinct().join(gone, "sid", "left_anti"))
    if left.limit(1).count():
        marked = join_checked(posted, left.withColumn("probe", F.lit(True)), ["sid"]).withColumn("probe", F.coalesce("probe", F.lit(False)))
        few = marked.where("probe").select("prefix").mapInArrow(trimmed(_tokens), "token long").distinct().limit(BROADCAST_ROWS + 1).collect()  # the lists that these sets are in, if few
        lists = docs.sparkSession.sparkContext.broadcast(np.array(sorted(r[0] for r in few), np.uint64)) if len(few) <= BROADCAST_ROWS else None
        more, _ = matched(marked, None, lists)
        gone = gone.union(more).distinct()
    flagged = gone.withColumn("gone", F.lit(True))
    known = first.join(flagged, "sid", "left").where("n > 1 or gone").select("sid", "first", F.coalesce("gone", F.lit(False)).alias("gone"))
    place = F.struct("doc_id", "line", "text_hash")
    out = lines.select("sid", "doc_id", "text_hash", "line").join(known, "sid").where(F.col("gone") | ~place.eqNullSafe(F.col("first"))).select("doc_id", "text_hash", "line")
    return out.distinct() if distinct else out


def dedup_lines(df: DataFrame, key: str = "doc_id", text: str = "text", least: float = MIN_JACCARD) -> DataFrame:
    """df with text without its repeated lines (see repeated_lines), and n_lines_removed; no row is dropped.

    Other columns are kept; n_lines_removed is replaced. A null text stays null; a text of which every line goes is empty.
    """
    names = [c for c in df.columns if c.lower() != "n_lines_removed"]
    gone = settled(lambda: repeated_lines(df, key, text, least, False).groupBy(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__th")).agg(F.collect_set("line").alias("__gone")))
    rows = df.select(names).withColumn("__hash", F.xxhash64(text))
    met = rows.join(gone, F.col(key).cast("long").eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("__th")), "left")
    # The lines are split once, not once per line kept.
    left = let(F.split(F.col(text), "\n"), lambda parts: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("__gone")), lambda i: F.get(parts, i)), "\n"))
    new = F.when(F.col("__gone").isNull(), F.col(text)).otherwise(left)
    return met.select(*[new.alias(text) if c == text else F.col(c) for c in names], F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("n_lines_removed"))


def line_dedup_report(docs: DataFrame) -> DataFrame:
    out = dedup_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_lines_removed", F.char_length("text").cast("long").alias("chars_left"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"))
