"""Source divergence audit: pairs of sources by tiles of group blocks, over successive chunks of the vocabulary."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkburst.llm.common import join_checked, stored, texts_of, trimmed
from sparkburst.llm.terms import term_pieces, term_table

#: A language keeps the terms that stand in so many of its documents.
MIN_DOCS = 30
#: A term's part of a group is 1 + floor(UNIT * (count + PRIOR) / (total + PRIOR * terms)).
UNIT, PRIOR = 1_000_000_000, 5
#: Terms reported of each group.
TOP = 50
#: Groups of a block, terms of a chunk, and chunks that one task goes through.
BLOCK, CHUNK, STRIPE = 64, 2048, 64
#: Bytes of text that are counted at once; a longer text is counted by itself, in pieces.
STEP = 4 << 20
#: Bits of the map of kept terms that tasks are sent, 8 MB whatever the vocabulary: it only spares rows that the join drops.
MAP_BITS = 1 << 26

_TABLE = term_table(digits=False)
_TILE = ["lang", "i", "j", "stripe"]


def _words(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """(terms as codes with their dictionary, the text of each) of some texts."""
    data = np.frombuffer(b" ".join(texts).translate(_TABLE) + b" ", np.uint8)
    solid = data != 32
    edges = np.flatnonzero(np.diff(solid, prepend=False))
    starts, sizes = edges[::2], edges[1::2] - edges[::2]
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    terms = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[solid]))]).dictionary_encode()
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    return terms, np.searchsorted(ends, starts, "right")


def _steps(batch: pa.RecordBatch, columns: list[str]) -> Iterator[tuple[list, np.ndarray, pa.Array, np.ndarray, np.ndarray]]:
    """(groups' names, group, dictionary, code, n, documents) of the texts of a batch, a step at a time: how often a term of
    the dictionary stands in a group, and in how many of its documents."""
    names = list(zip(*(batch[c].to_pylist() for c in columns), strict=True))
    held, own, size = [], [], 0

    def counted():
        known = {g: k for k, g in enumerate(dict.fromkeys(own))}
        group = np.array([known[g] for g in own])
        terms, text = _words(held)
        code, wide = terms.indices.to_numpy().astype(np.int64), max(1, len(terms.dictionary))
        pairs, n = np.unique(text * wide + code, return_counts=True)
        key, at = np.unique(group[pairs // wide] * wide + pairs % wide, return_inverse=True)
        return list(known), key // wide, terms.dictionary, key % wide, np.bincount(at, n, len(key)).astype(np.int64), np.bincount(at, minlength=len(key))

    for name, text in zip(names, texts_of(batch), strict=True):
        data = (text or "").encode()
        if len(data) > STEP:
            found = Counter()
            for piece in term_pieces(text, _TABLE):
                found.update(piece)
            yield [name], np.zeros(len(found), np.int64), pa.array(list(found), pa.binary()), np.arange(len(found)), np.array(list(found.values()), np.int64), np.ones(len(found), np.int64)
            continue
        if held and size + len(data) > STEP:
            yield counted()
            held, own, size = [], [], 0
        held.append(data)
        own.append(name)
        size += len(data)
    if held:
        yield counted()


def _told(columns: list[str], names: list, group: np.ndarray, terms: pa.Array, **numbers: np.ndarray) -> pa.RecordBatch:
    parts = [pa.array([g[k] for g in names], pa.string()).take(pa.array(group)) for k in range(len(columns))]
    return pa.RecordBatch.from_arrays([*parts, terms.cast(pa.string()), *map(pa.array, numbers.values())], [*columns, "term", *numbers])


def _in_langs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, term, n, docs)"""
    for batch in batches:
        for names, group, terms, code, n, docs in _steps(batch, ["lang"]):
            yield _told(["lang"], names, group, terms.take(pa.array(code)), n=n, docs=docs)


def _in_sources(bits):
    """(lang, source, term, n) of terms that the map of kept terms holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        for batch in batches:
            for names, group, terms, code, n, _ in _steps(batch, ["lang", "source"]):
                words, langs, wide = terms.to_pylist(), sorted({g[0] for g in names}), max(1, len(terms))
                lang = np.array([langs.index(g[0]) for g in names], np.int64)[group]
                met, at = np.unique(lang * wide + code, return_inverse=True)
                seeds = [digest(x.encode(), 42) for x in langs]
                place = np.fromiter((digest(words[k % wide], seeds[k // wide]) for k in met.tolist()), np.uint64, len(met)) % np.uint64(MAP_BITS)
                use = (bits.value[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)[at]
                yield _told(["lang", "source"], names, group[use], terms.take(pa.array(code[use])), n=n[use])

    return trimmed(run)


def _map_of(common: DataFrame) -> np.ndarray:
    """MAP_BITS bits, of which those at the hashes of (lang, term) are set; put together where the rows lie."""
    place = common.select((F.pmod(F.xxhash64("lang", "term"), F.lit(MAP_BITS)) + 1).alias("p"))
    parts = place.groupBy(F.bitmap_bucket_number("p").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
    out = np.zeros(MAP_BITS // 8, np.uint8)  # bucket b holds the places of the b-th 4096 bytes, both counted from 1
    for row in parts.toLocalIterator():
        out[(row["b"] - 1) * 4096 : row["b"] * 4096] = np.frombuffer(row["bits"], np.uint8)
    return out


def share(n: np.ndarray, total: int) -> np.ndarray:
    """1 + floor(UNIT * (n + PRIOR) / total) exactly, for n + PRIOR <= total < 2^53: long division, three digits at a time."""
    left, out = n.astype(np.int64) + PRIOR, np.zeros(len(n), np.int64)
    assert UNIT == 1000**3
    for k in range(4):
        q, left = np.divmod(left, total)
        out = out * (1000 if k else 1) + q
        left = left * 1000
    return out + 1


def share_column(n: Column, total: Column) -> Column:
    """The same as a column: decimals of 38 digits are exact."""
    wide = (n.cast("decimal(19,0)") + PRIOR) * F.lit(UNIT).cast("decimal(10,0)")
    return F.call_function("div", wide, total.cast("decimal(19,0)")) + 1


class _Tile:
    """The sums of |p - q| over the terms of one stripe, for the groups of block i against those of block j."""

    def __init__(self, key: tuple):
        self.key, self.rows, self.at = key, [], {}
        self.chunk, self.cells = None, []

    def group(self, block: int, source: str, total: int, terms: int) -> None:
        self.at[block, source] = len(self.rows)
        self.rows.append((block, source, total, terms))

    def ready(self) -> None:
        blocks = np.array([r[0] for r in self.rows])
        self.total, self.terms = np.array([r[2] for r in self.rows], np.int64), self.rows[0][3]
        self.none = np.array([share(np.zeros(1, np.int64), t)[0] if self.terms else 0 for t in self.total.tolist()], np.int64)
        self.left, self.right = np.flatnonzero(blocks == self.key[1]), np.flatnonzero(blocks == self.key[2])
        self.apart = abs(self.none[self.left][:, None] - self.none[self.right][None, :])
        # A term that neither group has adds the same to a pair each time; the first stripe brings it for all terms.
        self.sums = self.apart * (self.terms if self.key[3] == 0 else 0)

    def flush(self) -> None:
        """Takes in the chunk that is held: what its terms add beyond what they would if no group had them."""
        if self.cells:
            places = np.unique(np.concatenate([p for _, p, _ in self.cells]))
            dense = np.repeat(self.none[:, None], len(places), axis=1)
            for row, place, n in self.cells:
                dense[row, np.searchsorted(places, place)] = share(n, int(self.total[row]))
            right = dense[self.right]
            for k, row in enumerate(self.left.tolist()):
                self.sums[k] += abs(right - dense[row]).sum(axis=1) - len(places) * self.apart[k]
        self.cells = []

    def pairs(self) -> Iterator[pa.RecordBatch]:
        names = pa.array([r[1] for r in self.rows], pa.string())
        a, b = np.repeat(self.left, len(self.right)), np.tile(self.right, len(self.left))
        value = self.sums.reshape(-1)
        if self.key[1] == self.key[2]:
            other = a != b
            a, b, value = a[other], b[other], value[other]
        else:
            a, b, value = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([value, value])
        for k in range(0, len(a), 1 << 16):
            u, v, w = a[k : k + (1 << 16)], b[k : k + (1 << 16)], value[k : k + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array([self.key[0]] * len(u), pa.string()), names.take(pa.array(u)), names.take(pa.array(v)), pa.array(w)], ["lang", "source", "item", "value"])


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by tile, chunk (-1: the tile's groups), block and source. A task holds one chunk of one tile at a time."""
    tile = None

    def ended() -> Iterator[pa.RecordBatch]:
        if tile is not None:
            if tile.chunk is None:
                tile.ready()
            tile.flush()
            yield from tile.pairs()

    for batch in batches:
        keys = zip(*(batch[c].to_pylist() for c in [*_TILE, "chunk", "block", "source", "total", "terms"]), strict=True)
        cells, offsets = batch["cells"].values, batch["cells"].offsets.to_numpy()
        place, n = (cells.field(k).to_numpy(zero_copy_only=False) for k in ("place", "n"))
        for k, (*key, chunk, block, source, total, terms) in enumerate(keys):
            if tile is None or tile.key != tuple(key):
                yield from ended()
                tile = _Tile(tuple(key))
            if chunk < 0:
                tile.group(block, source, total, terms)
                continue
            if tile.chunk is None:
                tile.ready()
            if chunk != tile.chunk:
                tile.flush()
                tile.chunk = chunk
            held = slice(offsets[k], offsets[k + 1])
            tile.cells.append((tile.at[block, source], place[held].copy(), n[held].copy()))
    yield from ended()


def audit_sources(docs: DataFrame, min_docs: int = MIN_DOCS, block: int = BLOCK, chunk: int = CHUNK, stripe: int = STRIPE) -> tuple[DataFrame, DataFrame]:
    """(pairs, terms): (lang, source, item, value) of every ordered pair of a language's sources, and of every term that a
    source has and that is a larger part of it than of its language.

    Texts are counted where they lie, each step handing on one number a term: first for the languages, which gives the kept
    terms, then for the groups, where a bit map of fixed size spares most other terms and the join with the kept ones
    the rest. Whatever follows grows with groups and vocabulary, not with texts. A language's terms are dealt by hash to chunks and its sources to blocks; each
    source's counts of a chunk are one packed row, which goes to the tiles (block i, block j) that need it. A task sorts a
    tile's rows by chunk and holds one chunk of two blocks and the tile's sums; more than `stripe` chunks go to further
    tasks, whose sums are added. So no task holds a language's vocabulary, all its sources or all its pairs, and a hot
    source is only larger numbers.

    Null text, lang and source are ''. Texts without terms give their group no counts; a group without kept terms has all
    at zero. A language that keeps no terms has pairs of value 0 and no terms. Repeated rows count each. Extra
    columns are ignored. An empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    found = rows.select("lang", "text").mapInArrow(trimmed(_in_langs), "lang string, term string, n long, docs long")
    found = found.groupBy("lang", "term").agg(F.sum("n").alias("n_lang"), F.sum("docs").alias("docs"))
    terms = stored(found.where(F.col("docs") >= min_docs).select("lang", "term", "n_lang"))
    bits = spark.sparkContext.broadcast(_map_of(terms))
    counts = rows.mapInArrow(_in_sources(bits), "lang string, source string, term string, n long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"))
    langs = stored(terms.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n_lang").alias("lang_total")).withColumn("chunks", F.ceil(F.col("terms") / chunk).cast("long")))
    dealt = join_checked(terms, langs.select("lang", "chunks"), "lang", "inner").withColumn("chunk", F.pmod(F.xxhash64("term"), "chunks"))
    placed = stored(dealt.withColumn("place", F.row_number().over(Window.partitionBy("lang", "chunk").orderBy("term"))).select("lang", "term", "n_lang", "chunk", "place"))
    kept = stored(join_checked(counts, placed, ["lang", "term"], "inner"))

    groups = rows.select("lang", "source").distinct()
    groups = join_checked(groups, stored(kept.groupBy("lang", "source").agg(F.sum("n").alias("n"))), ["lang", "source"])
    groups = stored(join_checked(groups, langs, "lang").na.fill(0, ["n", "terms", "lang_total", "chunks"]))
    blocks = stored(groups.groupBy("lang").agg(F.ceil(F.count("*") / block).cast("long").alias("blocks")))
    groups = join_checked(groups, blocks, "lang", "inner")
    total = lambda n: (F.col(n) + PRIOR * F.col("terms")).alias
    groups = stored(groups.select("lang", "source", "terms", "chunks", "blocks", total("n")("total"), total("lang_total")("lang_total"), F.pmod(F.xxhash64(F.lit(7), "source"), "blocks").alias("block")))

    shares = join_checked(kept, groups.select("lang", "source", "total", "lang_total"), ["lang", "source"], "inner")
    above = share_column(F.col("n"), F.col("total")) - share_column(F.col("n_lang"), F.col("lang_total"))
    over = shares.select("lang", "source", F.col("term").alias("item"), above.alias("value")).where("value > 0")

    packed = kept.groupBy("lang", "source", "chunk").agg(F.collect_list(F.struct(F.col("place").cast("int").alias("place"), F.col("n"))).alias("cells"))
    packed = join_checked(packed, groups.drop("chunks", "lang_total"), ["lang", "source"], "inner").withColumn("stripe", F.expr(f"chunk div {stripe}"))
    heads = groups.withColumns({"chunk": F.lit(-1).cast("long"), "cells": F.array().cast("array<struct<place: int, n: bigint>>"), "stripe": F.explode(F.expr(f"sequence(0L, greatest(chunks - 1, 0L) div {stripe})"))})
    dealt = packed.unionByName(heads.select(packed.columns)).withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)")))
    dealt = dealt.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    dealt = dealt.select(*_TILE, "chunk", "block", "source", "total", "terms", "cells").repartition(*_TILE).sortWithinPartitions(*_TILE, "chunk", "block", "source")
    pairs = dealt.mapInArrow(trimmed(_tiles), "lang string, source string, item string, value long")
    pairs = pairs.repartition("lang", "source").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    return pairs, over


def divergence_report(docs: DataFrame, top: int = TOP, **options) -> DataFrame:
    """Both parts of the audit with ranks: all pairs, and the `top` terms of each group."""
    pairs, over = audit_sources(docs, **options)
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    first = over.withColumn("rank", rank).where(F.col("rank") <= top)
    told = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank"))
    return told(pairs.withColumn("rank", rank), "pair").unionByName(told(first, "term"))
