"""Operator 3: mixing sources to target weights by pivotal dependent rounding.

Every document of a source should be taken target / source_size times. The whole
part of that number is taken as it is; the fractions are rounded in pairs: of two
documents with fractions p, q and sizes a, b, mass moves from one to the other so
that p*a + q*b stays the same, in a random direction whose odds keep both
expectations, until one fraction is 0 or 1. That document is settled and the
other one meets the next. The one fraction that remains of a source goes to the
nearer end; if that leaves the source off its target, the one settled document
whose turn brings it nearest is turned round.

The pairing runs as a reduction tree: documents are dealt to buckets of about
`fan_in` by a hash, a fold settles all but one document of a bucket, and the
residuals of `fan_in` buckets meet in one bucket of the next level. A source
that holds a third of all rows is just more buckets. All randomness is a hash
of identifiers and a seed, so reruns agree.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from semdex.llm._common import materialize, partitions, table, uniform, word_count

WEIGHTS = (1, 2, 3)
MAX_REPEAT = 3
FAN_IN = 64
BROADCAST_SOURCES = 10_000
HOT_ROWS = 256


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """Per source of `sizes` (source, n_docs, source_size): its target.

    Sources weigh `weights` in turn, by code point, null last. Targets share all
    words by weight, but stop at `max_repeat` times their source; what is over
    goes to the others by weight. The level at which that ends is found from
    running sums in the order of cap / weight. The table has one row a source;
    only this table, not the documents, is ordered as a whole.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          (F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1,
                                  F.lit(len(weights))) + 1).cast("int"))
    capped = (sizes.withColumn("weight", weight)
              .withColumn("cap", F.col("source_size") * F.lit(float(max_repeat)))
              .withColumn("at", F.col("cap") / F.col("weight")))
    before = Window.orderBy("at", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    level = ((F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
             / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    levels = capped.withColumn("level", level)
    found = F.min(F.when(F.col("level") <= F.col("at") * (1 + 1e-12), F.struct("at", "level"))).over(every)["level"]
    return (levels.withColumn("target", F.least("cap", F.col("weight") * found))
            .select("source", "n_docs", "source_size", "weight", "target"))


def _pair(acc: Column, x: Column, seed: int) -> Column:
    """One pivotal step: the settled one of `acc` and `x` goes to `done`."""
    p, q, a, b = acc["p"], x["p"], acc["size"].cast("double"), x["size"].cast("double")
    up, down = F.least(1 - p, q * b / a), F.least(p, (1 - q) * b / a)
    odds = F.coalesce(down / F.nullif(up + down, F.lit(0.0)), F.lit(0.0))
    rise = uniform(F.lit(seed), acc["key"], x["key"], acc["at"], x["at"]) < odds

    def step(first_ends: Column, first_up: Column, new_p: Column, new_q: Column) -> Column:
        ended = F.when(first_ends, F.struct(acc["doc_id"].alias("doc_id"), acc["key"].alias("key"),
                                            acc["size"].alias("size"), first_up.alias("up")))
        ended = ended.otherwise(F.struct(x["doc_id"].alias("doc_id"), x["key"].alias("key"),
                                         x["size"].alias("size"), (~first_up).alias("up")))
        stays = lambda name: F.when(first_ends, x[name]).otherwise(acc[name])
        return F.struct(stays("doc_id").alias("doc_id"), stays("key").alias("key"), stays("at").alias("at"), stays("size").alias("size"),
                        F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.when(first_ends, new_q).otherwise(new_p))).alias("p"),
                        F.concat(acc["done"], F.array(ended)).alias("done"))

    rising = step(1 - p <= q * b / a, F.lit(True), p + up, q - up * a / b)
    falling = step(p <= (1 - q) * b / a, F.lit(False), p - down, q + down * a / b)
    return F.when(rise, rising).otherwise(falling)


def _bucket(buckets: Column, level: int, seed: int) -> Column:
    return F.pmod(F.xxhash64("key", "at", F.lit(seed + level)), buckets)


def _settle(items: DataFrame, buckets: Column, level: int, seed: int) -> DataFrame:
    """Fold each bucket of (source, doc_id, key, at, size, p); one residual stays."""
    # large documents first: they settle among themselves, and what remains tends to be small
    item = F.struct("size", "key", "at", "doc_id", "p")
    done_type = "array<struct<doc_id:{0},key:bigint,size:bigint,up:boolean>>".format(
        items.schema["doc_id"].dataType.simpleString())
    grouped = (items.withColumn("bucket", _bucket(buckets, level, seed))
               .groupBy("source", "bucket").agg(F.sort_array(F.collect_list(item), asc=False).alias("items")))
    head = F.element_at("items", 1)
    start = F.struct(head["doc_id"].alias("doc_id"), head["key"].alias("key"), head["at"].alias("at"), head["size"].alias("size"),
                     head["p"].alias("p"), F.array().cast(done_type).alias("done"))
    rest = F.slice("items", F.lit(2), F.size("items"))
    return grouped.select("source", F.aggregate(rest, start, lambda acc, x: _pair(acc, x, seed + level)).alias("f"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                weights=WEIGHTS, max_repeat: int = MAX_REPEAT, fan_in: int = FAN_IN, seed: int = 7,
                hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per input row: doc_id, source, key, size, source_size, target, copies, taken.

    size counts the words of the whole text (null or blank: 0); a null source is
    a source of its own, last in order. A document of size 0 is taken 0 times.
    key is a hash of identifier and text; rows that repeat both are separate
    documents to the mix. Very many of them don't meet in one bucket: the `partitions`
    most frequent keys with `hot_rows` rows or more also have their rows' place in the
    written table in the bucket's hash; by counting, no other key exceeds its fair
    share. Of a very long text only the count of its words is kept. No document is
    taken more than `max_repeat` times. An empty table gives an empty result.
    """
    key = F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    sized = materialize(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").alias("source"),
                                    key.alias("key"), word_count(F.col(f"`{text_col}`")).alias("size"))
                        .withColumn("row", F.monotonically_increasing_id()))
    hot = [r["key"] for r in sized.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= hot_rows)
           .orderBy(F.desc("n"), "key").limit(partitions(docs.sparkSession)).collect()]
    sized = sized.withColumn("at", F.when(F.col("key").isin(hot), F.col("row")).otherwise(F.lit(0)) if hot else F.lit(0).cast("long")).drop("row")
    sizes = sized.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size"))
    targets = materialize(source_targets(sizes, weights, max_repeat))
    n_sources, most = targets.agg(F.count(F.lit(1)), F.coalesce(F.max("n_docs"), F.lit(0))).first()
    side = F.broadcast(targets) if n_sources <= BROADCAST_SOURCES else targets
    share = F.coalesce(F.col("target") / F.nullif(F.col("source_size").cast("double"), F.lit(0.0)), F.lit(0.0))
    whole = F.floor(share + 1e-9)
    part = F.greatest(F.lit(0.0), share - whole)
    per = side.select(F.col("source").alias("s"), "n_docs", "source_size", "target", whole.alias("whole"),
                      F.when(part < 1e-9, F.lit(0.0)).otherwise(part).alias("p"))
    rows = sized.join(per, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    split = (F.col("p") > 0) & (F.col("size") > 0)

    buckets = lambda level: F.greatest(F.lit(1), F.ceil(F.col("n_docs") / F.lit(float(fan_in) ** level)))
    items, settled, level, left = rows.where(split).select("source", "n_docs", "doc_id", "key", "at", "size", "p"), [], 1, most
    while True:
        folded = materialize(_settle(items, buckets(level), level, seed))
        settled.append(folded.select("source", F.explode("f.done").alias("d"))
                       .select("source", "d.doc_id", "d.key", "d.size", F.col("d.up").cast("int").alias("more")))
        left = math.ceil(left / fan_in)
        residual = folded.select("source", "f.doc_id", "f.key", "f.at", "f.size", "f.p")
        if left <= 1:
            break
        level += 1
        items = residual.join(per.select("s", "n_docs"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    settled.append(residual.select("source", "doc_id", "key", "size",
                                   (F.col("p") >= 0.5).cast("int").alias("more")))
    settled.append(rows.where(~split).select("source", "doc_id", "key", "size", F.lit(0).alias("more")))
    rounded = settled[0]
    for more in settled[1:]:
        rounded = rounded.unionByName(more)
    rounded = materialize(rounded.join(per, F.col("source").eqNullSafe(F.col("s")), "left").drop("s", "n_docs"))
    taken = F.when(F.col("size") > 0, F.col("size") * (F.col("whole") + F.col("more"))).otherwise(F.lit(0))
    side = lambda df: F.broadcast(df) if n_sources <= BROADCAST_SOURCES else df
    off = rounded.groupBy(F.col("source").alias("s")).agg((F.sum(taken) - F.first("target")).alias("off"))
    # the residual left the source `off` words from its target: turn round the one document that mends most of it
    turned = F.col("off") + F.when(F.col("more") == 1, -F.col("size")).otherwise(F.col("size"))
    mend = (rounded.where(split).join(side(off), F.col("source").eqNullSafe(F.col("s"))).where(F.abs(turned) < F.abs("off"))
            .groupBy("source").agg(F.min(F.struct(F.abs(turned).alias("left"), "key", "doc_id", "size")).alias("m"))
            .select(F.col("source").alias("s"), F.col("m.key").alias("turn_key"), F.col("m.doc_id").alias("turn_id")))
    turn = F.coalesce((F.col("key") == F.col("turn_key")) & F.col("doc_id").eqNullSafe(F.col("turn_id")), F.lit(False))
    more = F.when(turn, 1 - F.col("more")).otherwise(F.col("more"))
    copies = F.when(F.col("size") > 0, F.col("whole") + more).otherwise(F.lit(0))
    return (rounded.join(side(mend), F.col("source").eqNullSafe(F.col("s")), "left")
            .withColumn("copies", F.least(copies, F.lit(max_repeat)).cast("long"))
            .select("doc_id", "source", "key", "size", "source_size", "target", "copies",
                    (F.col("copies") * F.col("size")).alias("taken")))


def repeat_rows(docs: DataFrame, mix: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` as often as `mix` takes them, columns unchanged.

    Rows join on identifier and text hash; of rows that repeat both, each gets
    one of the counts of its key.
    """
    # sort_array keeps the list the same on recomputation; a key repeats only if a row does
    taken = mix.groupBy(F.col("key").alias("mix_key")).agg(F.sort_array(F.collect_list("copies"), asc=False).alias("mix_copies"))
    rows = docs.select(F.struct("*").alias("row"), F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).alias("mix_key"))
    # one key for join and window, so that the texts are shuffled once
    nth = F.row_number().over(Window.partitionBy("mix_key").orderBy(F.lit(1)))
    return (rows.join(taken, "mix_key")
            .select("row", F.when(F.size("mix_copies") > 1, F.element_at("mix_copies", nth))
                    .otherwise(F.element_at("mix_copies", 1)).alias("copies"))
            .where("copies > 0")
            .select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")).select("row.*"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken", "copies")


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents as often as the mix takes them."""
    return repeat_rows(docs, mix_sources(docs))
