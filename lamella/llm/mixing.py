"""Mixing sources to target weights by weighted fair queueing.

The documents of a source queue in a shuffled order (by the md5 of doc_id and text), `epochs` times over. A document's
virtual finish time is what its source has sent up to and with it, divided by the source's target. The mix is the queue of
all sources range-sorted by finish time and cut at the total budget, the whole words of all targets. Served fairly, all sources
reach their targets at time 1; the document that a source is sending then queues as two, what is sent by time 1 and the rest, so
that the cut leaves each source within a word of its target.

Nothing is gathered per source: running sums come from sums per (source, cell of the shuffle). Rows alike in doc_id, source and
text are counted first and queue as one with many copies, so that neither a null doc_id nor a repeated row is a hot key. The
cut is found from the words in bins of finish time (BINS of them, up to time 2), and by ranking the rows of the one bin that it falls into;
whatever is before it in the global order is taken.
`mix` joins the queue to texts only for the final range-sort.

Sources are few: their table (a row each) is one task's work.

Edge cases: a null text has size 0, and documents of size 0 are never taken; a null source is a source and comes
last; rows alike in doc_id, source and text are copies: each has its own place, and which of them has which is of no account (`mix`
numbers those at a cut, so that one of them is cut); an empty table gives no rows; `mix` keeps the columns of the documents, whatever
their names (n_chars follows a cut).
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from lamella.llm.common import BLANKS, copies, n_words
from lamella.tables import read, stored

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2
#: Bins of finish time up to time 1, and hexadecimal digits of a cell of the shuffle.
BINS = 1 << 15
CELL = 4


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """source, source_size, target: `share` of all sizes by weight, none above `cap` times its source, the excess shared again.

    In order of cap per weight, a source is capped if its cap is no more than what it would get
    of what the capped ones before it leave; the first that isn't sets the level of all others.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())  # a row for each source
    order = Window.orderBy("full", "turn")
    ranked = sizes.withColumn("turn", F.row_number().over(by_name))
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("turn") - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("full", F.col("source_size") * float(cap) / F.col("weight"))
    before = F.coalesce(F.sum("source_size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) * cap
    rest = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    budget = F.sum("source_size").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) * share
    ranked = ranked.withColumn("level", (budget - before) / rest)
    first = F.min(F.when(F.col("full") > F.col("level"), F.struct("full", "turn", "level"))).over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    target = F.when(F.col("full") <= F.col("level"), F.col("source_size") * float(cap)).otherwise(F.col("weight") * first["level"])
    return ranked.select("source", "source_size", target.cast("double").alias("target"))


def _shuffled() -> Column:
    text = F.coalesce(F.md5(F.col("text").cast("binary")), F.lit(""))
    return F.md5(F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text).cast("binary"))


def queued(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """doc_id, source, shuffled, size, n (how many rows are alike), source_size, target, and start: what their source has sent before the first of them."""
    rows = docs.select("doc_id", "source", _shuffled().alias("shuffled"), n_words(F.col("text")).alias("size"))
    rows = stored(rows.groupBy("source", "shuffled").agg(F.first("doc_id").alias("doc_id"), F.first("size").alias("size"), F.count("*").alias("n")))  # texts are read once
    rows = rows.withColumn("cell", F.substring("shuffled", 1, CELL))
    cells = stored(rows.groupBy("source", "cell").agg(F.sum(F.col("size") * F.col("n")).alias("cell_size")))
    sizes = targets(cells.groupBy("source").agg(F.sum("cell_size").alias("source_size")), weights, share, cap)
    earlier = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.select(F.col("source").alias("_source"), F.col("cell").alias("_cell"), F.coalesce(F.sum("cell_size").over(earlier), F.lit(0)).alias("offset"))
    sizes = sizes.select(F.col("source").alias("_of"), "source_size", "target")
    starts = stored(starts.join(sizes, F.col("_source").eqNullSafe(F.col("_of"))).drop("_of"))
    within = Window.partitionBy("source", "cell").orderBy("shuffled").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("in_cell", F.coalesce(F.sum(F.col("size") * F.col("n")).over(within), F.lit(0)))
    rows = rows.join(starts, F.col("source").eqNullSafe(F.col("_source")) & (F.col("cell") == F.col("_cell")))
    return rows.withColumn("start", F.col("offset") + F.col("in_cell")).drop("_source", "_cell", "offset", "in_cell", "cell")


def finish_time(sent: Column) -> Column:
    """When so many words of a source are sent; null without a target."""
    return F.try_divide(sent, F.col("target"))


def parts(cap: int = CAP) -> Column:
    """What a copy (in column copy) of a row queues as: array<struct<epoch, finish, words, at>>, a document that its source is
    sending at time 1 as two."""
    full = F.floor("target").cast("long")

    def of(epoch: int) -> Column:
        begin = F.col("source_size") * epoch + F.col("start") + F.col("copy") * F.col("size")
        end = begin + F.col("size")
        part = lambda lo, hi: F.struct(F.lit(epoch).alias("epoch"), finish_time(hi).alias("finish"), (hi - lo).alias("words"), lo.alias("at"))
        return F.when((begin < full) & (full < end), F.array(part(begin, full), part(full, end))).otherwise(F.array(part(begin, end)))

    every = F.flatten(F.array(*[of(e) for e in range(cap)]))
    return F.filter(every, lambda x: (x["words"] > 0) & x["finish"].isNotNull())


def _order(finish: Column, at: Column, source: Column, shuffled: Column) -> Column:
    """The order of the global queue."""
    return F.struct(finish.alias("finish"), source.isNull().alias("last"), F.coalesce(source, F.lit("")).alias("source"), at.alias("at"), shuffled.alias("shuffled"))


def _cut(rows: DataFrame, cap: int) -> Row | None:
    """The part that the budget ends in: its place in the order and how many of its words it leaves; None if all is taken."""
    queue = rows.select("source", "shuffled", F.explode(parts(cap)).alias("p"))
    queue = queue.withColumn("bin", F.least(F.ceil(F.col("p.finish") * BINS), F.lit(2 * BINS + 1)))  # a bin ends at time 1
    budget = rows.groupBy("source").agg(F.max(F.floor("target").cast("long")).alias("b")).agg(F.sum("b").alias("b")).first().b or 0
    upto = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bins = queue.groupBy("bin").agg(F.sum("p.words").alias("words")).withColumn("upto", F.sum("words").over(upto))  # 2 x BINS + 1 rows at most
    found = bins.filter(F.col("upto") > budget).orderBy("bin").first()
    if found is None:
        return None
    order = _order(F.col("p.finish"), F.col("p.at"), F.col("source"), F.col("shuffled"))
    upto = Window.partitionBy("bin").orderBy("order").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = queue.filter(F.col("bin") == found.bin).select("bin", "p.words", order.alias("order")).withColumn("upto", F.sum("words").over(upto) + F.lit(found.upto - found.words))
    return ranked.filter(F.col("upto") > budget).orderBy("order").select("order.*", (F.col("words") - F.col("upto") + budget).alias("left")).first()


def taken(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """The queue's copies (see `queued`; copy from 0) with got: the words taken in each epoch."""
    line = stored(copies(queued(rows, weights, share, cap), "n", "copy"))
    cut = _cut(line, cap)
    if cut is None:
        words = lambda x: x["words"]
    else:
        last = F.struct(F.lit(cut.finish).cast("double").alias("finish"), F.lit(cut["last"]).alias("last"), F.lit(cut.source).alias("source"), F.lit(cut["at"]).cast("long").alias("at"), F.lit(cut.shuffled).alias("shuffled"))
        place = lambda x: _order(x["finish"], x["at"], F.col("source"), F.col("shuffled"))
        words = lambda x: F.when(place(x) < last, x["words"]).when(place(x) == last, F.lit(cut.left).cast("long")).otherwise(F.lit(0).cast("long"))
    of = lambda e: F.filter(parts(cap), lambda x: x["epoch"] == e)
    return line.withColumn("got", F.array(*[F.aggregate(of(e), F.lit(0).cast("long"), lambda s, x: s + words(x)) for e in range(cap)]))


def _numbered(rows: DataFrame) -> DataFrame:
    """rows with _copy: the number of each among those of its _from and _key. Counted by input partition, never in one task."""
    rows = stored(rows.withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    keys = ["_from", "_key"]
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*keys, part.alias("_part")).agg(F.count("*").alias("n")).withColumn("_before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    own = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy("_id")) - 1
    counts = counts.select(F.col("_from").alias("_f"), F.col("_key").alias("_k"), F.col("_part").alias("_p"), "_before")
    rows = rows.withColumn("_part", part).withColumn("_own", own)
    rows = rows.join(counts, F.col("_from").eqNullSafe(F.col("_f")) & (F.col("_key") == F.col("_k")) & (F.col("_part") == F.col("_p")))
    return rows.withColumn("_copy", (F.col("_before") + F.col("_own")).cast("long")).drop("_id", "_part", "_own", "_before", "_f", "_k", "_p")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP, ordered: bool = True) -> DataFrame:
    """The rows of docs that the mix takes, each as often as it takes it, the last of a source cut to its first words; range-sorted by finish time unless not asked for."""
    line = taken(docs.select("doc_id", "source", "text"), weights, share, cap)
    place = F.struct("shuffled", "copy")
    got = [F.get("got", F.lit(e)) for e in range(cap)]
    whole = [F.max(F.when((g > 0) & (g == F.col("size")), F.struct(place.alias("place"), "n"))).alias(f"_whole{e}") for e, g in enumerate(got)]
    part = [F.max(F.when((g > 0) & (g < F.col("size")), F.struct(place.alias("place"), "n", g.alias("words")))).alias(f"_part{e}") for e, g in enumerate(got)]
    cuts = stored(line.groupBy("source").agg(*whole, *part).withColumnRenamed("source", "_source"))  # a row for each source
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("source").alias("_from"), F.col("text").alias("_text"), _shuffled().alias("_key"))
    # a source takes a beginning of its queue; only among the copies of a row that this beginning ends in has each its own number
    ends = [F.col(f"{kind}{e}") for e in range(cap) for kind in ("_whole", "_part")]
    rows = rows.join(cuts, F.col("_from").eqNullSafe(F.col("_source"))).filter(F.greatest(*[F.coalesce(x["place"]["shuffled"], F.lit("")) for x in ends]) >= F.col("_key"))
    at_edge = functools.reduce(operator.or_, (F.coalesce((F.col("_key") == x["place"]["shuffled"]) & (x["n"] > 1), F.lit(False)) for x in ends))
    plain = rows.filter(~at_edge).withColumn("_copy", F.lit(0).cast("long"))
    several = not cuts.filter(F.greatest(*[F.coalesce(x["n"], F.lit(0)) for x in ends]) > 1).isEmpty()
    rows = plain.unionByName(_numbered(rows.filter(at_edge))) if several else plain
    queue = line.filter("copy = 0 AND size > 0").select(F.col("source").alias("_s"), F.col("shuffled").alias("_k"), F.col("size").alias("_size"), "start", "source_size", "target")
    rows = rows.join(queue, F.col("_from").eqNullSafe(F.col("_s")) & (F.col("_key") == F.col("_k")))
    own = F.struct(F.col("_key").alias("shuffled"), F.col("_copy").alias("copy"))
    words = [F.when(own <= F.col(f"_whole{e}.place"), F.col("_size")).when(own == F.col(f"_part{e}.place"), F.col(f"_part{e}.words")) for e in range(cap)]
    rows = rows.select("_row", "_text", "_from", "_key", "_copy", "_size", "start", "source_size", "target", F.posexplode(F.array(*words)).alias("_epoch", "_words")).filter("_words > 0")
    pieces = F.split("_text", r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])", -1)  # a word and the blanks behind it
    first = F.when(F.trim(F.get(pieces, F.lit(0)), F.lit(BLANKS)) == "", 1).otherwise(0)  # blanks before the first word are a piece of their own
    cut = F.when(F.col("_words") < F.col("_size"), F.array_join(F.slice(pieces, F.lit(1), (F.col("_words") + first).cast("int")), "")).otherwise(F.col("_text"))
    if ordered:
        sent = F.col("source_size") * F.col("_epoch") + F.col("start") + (F.col("_copy") + 1) * F.col("_size")
        rows = rows.orderBy(finish_time(sent), "_from", "_key", "_copy", "_epoch")
    rows = rows.withColumn("_cut", cut)
    fields = {c: F.col(f"_row.`{c}`").alias(c) for c in docs.columns}
    fields["text"] = F.col("_cut").alias("text")
    if "n_chars" in fields:
        fields["n_chars"] = F.when(F.col("_words") < F.col("_size"), F.length("_cut")).otherwise(F.col("_row.n_chars")).cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return rows.select(*fields.values())


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.aggregate("got", F.lit(0).cast("long"), lambda s, x: s + x)
    finish = finish_time(F.col("start") + (F.col("copy") + 1) * F.col("size"))
    return taken(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", words.alias("taken"), finish.alias("finish"))


ORACLE = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                  md5(coalesce(CAST(doc_id AS VARCHAR), '') || '/' || coalesce(md5(text), '')) AS h FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS turn FROM d GROUP BY source),
s1 AS (SELECT *, CASE (turn - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s0),
s2 AS (SELECT *, source_size * 2.0::DOUBLE / weight AS "full" FROM s1),
s3 AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE
        - CAST(coalesce(sum(source_size) OVER (ORDER BY "full", turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 2 AS DOUBLE))
        / CAST(sum(weight) OVER (ORDER BY "full", turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM s2),
s4 AS (SELECT *, arg_min(level, struct_pack(a := "full", b := turn)) FILTER ("full" > level) OVER () AS lam FROM s3),
s AS (SELECT source, source_size, CASE WHEN "full" <= level THEN source_size * 2.0::DOUBLE ELSE weight * lam END AS target FROM s4),
q AS (SELECT d.doc_id, d.size, s.source_size, s.target,
             CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h ROWS UNBOUNDED PRECEDING) AS BIGINT) AS sent
      FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source)
SELECT doc_id, size, source_size, target,
       CAST(greatest(0, least(size, floor(target) - (sent - size))) + greatest(0, least(size, floor(target) - (source_size + sent - size))) AS BIGINT) AS taken, CAST(sent AS DOUBLE) / nullif(target, 0) AS finish
FROM q
"""
