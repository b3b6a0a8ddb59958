"""SimHash near copies with pigeonring filtering."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkburst.llm.common import row_hash, settled, stored, texts_of, trimmed
from sparkburst.llm.components import connected_components

SHINGLE, SEED = 3, 42
#: Fingerprints link at this many differing bits or fewer; they are a ring of SEGMENTS segments.
MAX_BITS, SEGMENTS = 3, 4
_WIDTH = 64 // SEGMENTS
_MASK = (1 << _WIDTH) - 1


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text's word shingles, A-Z lower-cased; 0 without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) < shingle:
        starts, ends = starts[:1], ends[-1:]
    else:
        starts, ends = starts[: len(words) - shingle + 1], ends[shingle - 1 :]
    digest, view = xxhash.xxh64_intdigest, memoryview(joined)
    h = np.fromiter((digest(view[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, len(starts))
    counts = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 15):  # very long texts go through in pieces
        counts += np.unpackbits(h[k : k + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text_hash, bits): bits is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.array([fingerprint(t, shingle) for t in texts_of(batch)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["text_hash"], pa.array(bits)], ["doc_id", "text_hash", "bits"])

    rows = df.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    return rows.mapInArrow(trimmed(run), "doc_id long, text_hash long, bits long")


def similar_fingerprints(bits: DataFrame, most: int = MAX_BITS) -> DataFrame:
    """Pairs (a, b), a < b, of distinct fingerprints that differ in at most `most` (3 or fewer) bits; none is lost.

    Pigeonring principle: with segments in a ring, some segment starts a chain in which the first l segments differ in
    at most l * most / SEGMENTS bits, for every l. So its own segment is equal and the next differs in one bit at most:
    that is the join key (each fingerprint is filed four times and asks with the next segment's one-bit neighbours,
    17 times four). The chain of three segments and then the whole fingerprint are checked on what meets.

    The join goes by shuffle: Spark takes the exploded keys for little more than the fingerprints that they come from, and
    would send 68 rows for each of them through the driver.
    """
    assert 0 <= most <= SEGMENTS - 1
    ring = [F.shiftrightunsigned("bits", _WIDTH * s).bitwiseAND(_MASK) for s in range(SEGMENTS)]

    def keys(flips: list[int]):
        return F.array(*[(F.lit(s << (2 * _WIDTH)) + ring[s] * F.lit(1 << _WIDTH) + ring[(s + 1) % SEGMENTS].bitwiseXOR(F.lit(f))).alias("k") for s in range(SEGMENTS) for f in flips])

    filed = bits.select(F.col("bits").alias("a"), F.explode(keys([0])).alias("k"))
    asked = bits.select(F.col("bits").alias("b"), F.explode(keys([0, *(1 << j for j in range(_WIDTH))])).alias("k"))
    apart = F.col("a").bitwiseXOR(F.col("b"))
    chain = F.lit(True)
    for length in range(1, SEGMENTS):
        for s in range(SEGMENTS):
            mask = sum(_MASK << (_WIDTH * ((s + x) % SEGMENTS)) for x in range(length))
            mask -= (mask >> 63) << 64
            chain &= (F.shiftright("k", 2 * _WIDTH) != s) | (F.bit_count(apart.bitwiseAND(F.lit(mask))) <= length * most // SEGMENTS)
    return filed.hint("merge").join(asked.hint("merge"), "k").where((F.col("a") < F.col("b")) & chain & (F.bit_count(apart) <= most)).select("a", "b").distinct()


def simhash_groups(df: DataFrame, key: str = "doc_id", text: str = "text", most: int = MAX_BITS, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text_hash, bits, component_id, chosen) for every row: component_id is the smallest doc_id reachable.

    Whole texts are hashed where they lie. Documents of one fingerprint are a class that goes through the join once, so
    copies are never paired; links among fingerprints stay distributed and components are found by alternating stars.
    chosen marks the rows whose (doc_id, text_hash) is the smallest of their group.

    Null and empty texts and texts of white space have fingerprint zero and link like any other. Null ids never become
    a component's id unless the whole group has none. Repeated rows are members of one group. Extra columns are
    ignored. An empty table gives no rows.
    """
    rows = stored(fingerprints(df, key, text, shingle))
    classes = stored(rows.groupBy("bits").agg(F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "text_hash")).alias("one")))
    return grouped(rows, classes, similar_fingerprints(classes.select("bits"), most), "bits")


def grouped(rows: DataFrame, classes: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """rows (doc_id, text_hash, name) with component_id and chosen, from links (a, b) among classes (name, least, one)."""
    groups = connected_components(links)
    joined = classes.join(groups, F.col(name) == F.col("node"), "left").withColumn("component", F.coalesce("component", name))
    best = joined.groupBy("component").agg(F.min("least").alias("component_id"), F.min("one").alias("one"))
    known = joined.select(F.col(name).alias("b"), "component").join(best, "component").select("b", "component_id", "one")
    out = rows.join(known, F.col(name) == F.col("b"))
    return out.select("doc_id", "text_hash", name, "component_id", F.struct("doc_id", "text_hash").eqNullSafe(F.col("one")).alias("chosen"))


def simhash_deduplicated(docs: DataFrame, **options) -> DataFrame:
    """docs with one document of each group: the smallest doc_id; of repeated rows, one."""
    return chosen_only(docs, settled(lambda: chosen_keys(simhash_groups(docs, **options))))


def chosen_keys(groups: DataFrame) -> DataFrame:
    """(__id, __th): doc_id and text's hash of the chosen rows."""
    return groups.where("chosen").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__th")).distinct()


def chosen_only(docs: DataFrame, picked: DataFrame) -> DataFrame:
    """The rows of docs that picked (see chosen_keys) names. Of rows with the chosen doc_id and text the one with the smallest
    hash of all columns stays, so that reruns agree; of rows equal in every column, one."""
    rows = docs.withColumns({"__hash": F.xxhash64("text"), "__row": row_hash(docs)})
    mine = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("__th"))
    met = rows.join(picked, mine)
    least = rows.select("doc_id", "__hash", "__row").join(picked, mine).groupBy("__id", "__th").agg(F.min("__row").alias("__least"), F.count("*").alias("__n"))
    if not least.where("__n > 1").limit(1).count():
        return met.select(docs.columns)
    one = least.select(F.col("__id").alias("__i"), F.col("__th").alias("__t"), "__least")
    met = met.join(one, F.col("__id").eqNullSafe(F.col("__i")) & (F.col("__th") == F.col("__t")) & (F.col("__row") == F.col("__least")))
    return met.dropDuplicates(["__id", "__th"]).select(docs.columns)


def simhash_report(docs: DataFrame) -> DataFrame:
    return simhash_groups(docs.select("doc_id", "text")).select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")
