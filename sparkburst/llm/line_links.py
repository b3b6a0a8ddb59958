"""All links among lines: every pair of different token sets with Jaccard of MIN_JACCARD or more, none left out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkburst.llm import line_dedup as L
from sparkburst.llm.common import dropped, join_checked, stored
from sparkburst.llm.components import connected_components

#: Postings of a token in one list; longer lists are dealt as pairs of blocks of about this size.
BLOCK = 4096
_COLUMNS = ("prefix", *L._OWN)


def _dealt(posted: DataFrame, hot: DataFrame) -> DataFrame:
    """A row of _COLUMNS for each posting of posted, and for one of a hot token one for every block that its own has to meet.

    hot: (token, n), n blocks for a token's list. A pair of blocks is a list with a token of its own. `line` is the group
    within which a list's postings aren't compared: the set itself, or its block where two different blocks meet.
    """
    own = [c for c in _COLUMNS if c not in ("prefix", "line")]
    single = posted.select(F.explode("prefix").alias("post"), *own).withColumn("token", F.shiftrightunsigned("post", 32))
    rows = join_checked(single, hot, ["token"]).withColumn("n", F.coalesce("n", F.lit(1).cast("long")))
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("sid"), F.col("n"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    code = F.xxhash64("token", F.least("mine", "other"), F.greatest("mine", "other"))
    named = F.when(F.col("n") > 1, F.shiftrightunsigned(code, 32)).otherwise(F.col("token"))
    post = F.shiftleft(named, 32).bitwiseOR(F.col("post").bitwiseAND(F.lit(0xFFFFFFFF)))
    made = {"prefix": F.array(post), "line": F.when(F.col("mine") == F.col("other"), F.col("sid")).otherwise(F.col("mine"))}
    return rows.select(*[made[c].alias(c) if c in made else F.col(c) for c in _COLUMNS])


def line_links(df: DataFrame, key: str = "doc_id", text: str = "text", least: float = L.MIN_JACCARD) -> tuple[DataFrame, DataFrame]:
    """(links, members): links (a, b), a < b, are all pairs of different token sets with Jaccard >= least; members
    (doc_id, text_hash, line, sid) tells the set of every line with words.

    Sets meet as in line_dedup.repeated_lines, but each sends all its candidates. A long list of a token is dealt as pairs of
    blocks over as many tasks; which lists are long is a table that is joined, broadcast only if it is small. Copies are
    members of one set and never paired; links among different sets are as many as there are.

    Null and empty texts and lines without words have no members and no links. Repeated rows are one member; rows with one
    id and different texts are told apart by text_hash; null ids are an id of their own. Long lines are whole sets. An
    empty table gives no rows in either result.
    """
    docs = df.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    context = docs.sparkSession.sparkContext
    rarity = context.broadcast(L.token_rarity(docs))
    lines = stored(L.line_sets(docs, rarity, least))
    first = stored(lines.groupBy("sid").agg(F.min(F.struct("doc_id", "line", "text_hash")).alias("first")))
    place = F.struct("doc_id", "line", "text_hash")
    posted = lines.where(F.size("prefix") > 0).join(first.withColumnRenamed("sid", "__sid"), F.col("sid") == F.col("__sid")).where(place.eqNullSafe(F.col("first")))
    posted = stored(posted.select("prefix", F.lit(True).alias("probe"), *[F.col(c).cast("long") if c == "line" else F.col(c) for c in L._OWN if c != "probe"]).dropDuplicates(["sid"]).select(*_COLUMNS))
    counts = posted.select(F.explode("prefix").alias("post")).groupBy(F.shiftrightunsigned("post", 32).alias("token")).agg(F.count("*").alias("c"))
    hot = stored(counts.where(F.col("c") > BLOCK).select("token", F.ceil(F.col("c") / BLOCK).alias("n")))
    total = posted.agg(F.sum(F.size("prefix"))).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // L._POSTINGS))
    dealt = _dealt(posted, hot)
    posts = dealt.mapInArrow(L._postings(L._BUCKETS * parts), L.POSTED).repartition(parts, "bucket")
    pairs = posts.mapInArrow(L._candidates(least, None, True), "a long, b long, more boolean")
    pairs = stored(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    dropped(hot)
    return L._verified(pairs, docs, first, rarity, least), lines.select("doc_id", "text_hash", "line", "sid").distinct()


def line_links_report(docs: DataFrame) -> DataFrame:
    """(doc_id, line, set_id, class_id, n_links) of every line with words.

    set_id names its token set, class_id is the smallest set that links reach, n_links counts the other sets that match it.
    """
    links, members = line_links(docs.select("doc_id", "text"))
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    counts = both.groupBy("a").agg(F.count("*").alias("n"))
    known = counts.join(connected_components(links), F.col("a") == F.col("node")).select(F.col("a").alias("sid"), "n", "component")
    out = members.join(known, "sid", "left")
    return out.select("doc_id", "line", F.col("sid").alias("set_id"), F.coalesce("component", "sid").alias("class_id"), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"))
