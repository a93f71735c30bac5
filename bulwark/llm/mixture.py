"""Mixing sources to target weights in fixed-length blocks.

The words of a source, document after document, form one stream that is cut
into blocks of ``blk`` words (BLOCK, fewer for a source of few words).  The mix
has one slot per block to take; slots lie in output shards of SHARD_SLOTS.

* Every slot draws its source with the odds of the quotas, so the counts of a
  shard are a multinomial draw.
* The draws of a source are numbered in the order of the slots.  A source that
  was drawn more often than its quota gives the draws beyond it back; they go,
  in order, to the sources that were drawn too seldom (about the square root of
  all slots), so every source meets its quota exactly.
* Number j of a source takes block ``permutation(source, round, j mod blocks)``
  of round ``j div blocks``.  Slots and blocks join on (source, block index).

All of it is integer arithmetic on counters (31-bit products of fixed factors),
so nothing depends on partitioning, reruns agree, and SQL gives the same
numbers.  A quota never exceeds ``most`` rounds, so no word is taken more than
``most`` times.  Running sums go over ranges of documents and groups of shards,
never over all rows of a source in one task; windows over whole tables see one
row per source, range or group.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bulwark.llm.common import materialise, small_batches

WORDS = r"[^\x20\x09-\x0D]+"
#: Words per block; a source of few words has blocks of size div BLOCK words, one at least.
BLOCK, SHARD_SLOTS, MOST, SEED = 64, 4096, 3, 20_240
#: Rows of one range of documents, and ranges at most (wider ones beyond); shards of one group, and of one task.
RANGE_ROWS, RANGES, GROUP_SHARDS, TASK_SHARDS = 50_000, 20_000, 1024, 16
#: Sources up to which their tables (a few rows each) are broadcast; beyond, they are joined by sorting.
BROADCAST_SOURCES = 50_000
# Factors of multiplicative generators modulo 2^31 - 1 (Fishman and Moore, 1986): fixed values.
PRIME = 2_147_483_647
FACTORS = (742_938_285, 950_706_376, 1_226_874_159, 62_089_911, 1_343_714_438)
_MIXES = 4


def scattered(seed: int, key: Column) -> Column:
    """A pseudorandom number from 0 to PRIME - 1 of a counter; products stay below 2^62."""
    fold = lambda x, n: x.bitwiseXOR(F.shiftright(x, n)) % PRIME
    at = F.lit((seed * FACTORS[4] + SEED) % PRIME).cast("long")
    at = fold(((at + key.cast("long") % PRIME) % PRIME * FACTORS[0] + FACTORS[4]) % PRIME, 15)
    return fold(at * FACTORS[3] % PRIME, 13)


def scattered_np(seed: int, *keys: np.ndarray) -> np.ndarray:
    """The same of one or more arrays of counters."""
    fold = lambda x, n: (x ^ (x >> n)) % PRIME
    at = np.int64((seed * FACTORS[4] + SEED) % PRIME)
    for k, key in enumerate(keys):
        at = fold(((at + key % PRIME) % PRIME * FACTORS[k % 4] + FACTORS[4]) % PRIME, 15)
    return fold(at * FACTORS[3] % PRIME, 13)


def scattered_sql(seed: int, *keys: str) -> str:
    """The same in DuckDB."""
    fold = lambda x, n: f"(list_transform([{x}], lambda x: xor(x, x >> {n}))[1] % {PRIME})"
    at = f"({(seed * FACTORS[4] + SEED) % PRIME})::bigint"
    for k, key in enumerate(keys):
        at = fold(f"((({at} + ({key})::bigint % {PRIME}) % {PRIME} * {FACTORS[k % 4]} + {FACTORS[4]}) % {PRIME})::bigint", 15)
    return fold(f"({at} * {FACTORS[3]} % {PRIME})::bigint", 13)


def permuted(index: np.ndarray, size: np.ndarray, *key: np.ndarray) -> np.ndarray:
    """Where keyed permutations of 0 .. size-1 send ``index`` (arrays of one length).

    A Feistel network over a grid of ceil(sqrt(size)) columns, walked on while it
    is outside 0 .. size-1, which fewer than sqrt(size) cells are.
    """
    out, open_at = index.astype(np.int64), np.arange(len(index))
    wide = np.ceil(np.sqrt(size.astype(float))).astype(np.int64)
    high = np.ceil(size / np.maximum(wide, 1)).astype(np.int64)
    while len(open_at):
        w, h, keys = wide[open_at], high[open_at], [k[open_at] for k in key]
        left, right = out[open_at] % w, out[open_at] // w
        for k in range(_MIXES):
            left = (left + scattered_np(100 + 2 * k, right, *keys)) % w
            right = (right + scattered_np(101 + 2 * k, left, *keys)) % h
        out[open_at] = right * w + left
        open_at = open_at[out[open_at] >= size[open_at]]
    return out


def source_table(sized: DataFrame, most: int = MOST) -> DataFrame:
    """One row per source: sid, source_size, rows, weight, target, blk, blocks, quota, offset, slots.

    Sources in code-point order (null last) weigh 1, 2, 3, 1, 2, 3, ...; they
    share the sum of all sizes by weight, but none gets more than ``most`` times
    its size, and what is over is shared again by weight.  With caps c and
    weights w, a source is at its cap exactly if c / w lies below the final level;
    so the level is found by going through the sources in the order of c / w.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = totals.withColumn("sid", F.row_number().over(order)).withColumn("weight", ((F.col("sid") - 1) % 3 + 1).cast("long"))
    everything, before = Window.partitionBy(), Window.orderBy(F.col("source_size") / F.col("weight"), "sid").rowsBetween(Window.unboundedPreceding, -1)
    cap = most * F.col("source_size")
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum(cap).over(before), F.lit(0))
    weights = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    levels = ranked.withColumn("level", left.cast("double") / weights.cast("double"))
    free = F.when(cap.cast("double") >= F.col("level") * F.col("weight"), F.col("level"))
    levels = levels.withColumn("level", F.min(F.struct(F.when(free.isNull(), 1).otherwise(0).alias("none"), (F.col("source_size") / F.col("weight")).alias("r"), F.col("sid"), F.col("level"))).over(everything)["level"])
    out = levels.withColumn("target", F.least(cap.cast("double"), F.col("level") * F.col("weight")))
    out = out.withColumn("blk", F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.floor(F.col("source_size") / BLOCK))).cast("long"))
    out = out.withColumn("blocks", F.ceil(F.col("source_size") / F.col("blk")).cast("long"))
    quota = F.when(F.col("source_size") > 0, F.least(most * F.col("blocks"), F.round(F.col("target") * F.col("blocks") / F.col("source_size")).cast("long"))).otherwise(0).cast("long")
    out = out.withColumn("quota", quota)
    out = out.withColumn("offset", F.coalesce(F.sum("quota").over(Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    out = out.withColumn("slots", F.sum("quota").over(everything))
    return out.select("sid", "source", "source_size", "rows", "weight", "target", "blk", "blocks", "quota", "offset", "slots")


def _small(table: DataFrame, many: int) -> DataFrame:
    """A table with a few rows for each of ``many`` sources, hinted: the planner takes exploded rows for as few as before, and would broadcast those."""
    return F.broadcast(table) if many <= BROADCAST_SOURCES else table.hint("merge")


def _intervals(table: DataFrame, low: str, length: str, total: int, rows: int) -> tuple[DataFrame, int]:
    """(cell, low, high, ...): the intervals of a table cut at cells of equal width, about four cells for each row of the table.

    A number lies in one cell, and few intervals share a cell, so numbers find
    their interval by an equi-join.
    """
    width = max(1, -(-total // (4 * max(rows, 1))))
    some = table.where(F.col(length) > 0).withColumn("high", F.col(low) + F.col(length))
    return some.withColumn("cell", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor((F.col("high") - 1) / width)))), width


@dataclass(frozen=True)
class Mix:
    """sources: see source_table; slots: (shard, slot, sid, round, block); spans: (sid, start, key, size, block, low, words).

    spans tell which words of which document lie in a block (from word ``low``
    of the document); documents: (key, doc_id, source, size, source_size, target, taken).
    ``key`` numbers the rows of ``sized``, a written table (key, doc_id, source, size).
    """

    sources: DataFrame
    slots: DataFrame
    spans: DataFrame
    documents: DataFrame


def draw(sources: DataFrame, total: int, many: int) -> DataFrame:
    """(shard, slot, sid, j): every slot with its source, numbered from 0 within the source up to its quota."""
    spark = sources.sparkSession
    shards = -(-total // SHARD_SLOTS)
    numbers = spark.range(0, shards, 1, max(1, min(RANGES, -(-shards // TASK_SHARDS)))).withColumnRenamed("id", "shard")
    numbers = numbers.select("shard", F.explode(F.sequence(F.col("shard") * SHARD_SLOTS, F.least(F.lit(total), (F.col("shard") + 1) * SHARD_SLOTS) - 1)).alias("slot"))
    odds = (scattered(1, F.col("slot")) * PRIME + scattered(2, F.col("slot"))).cast("double") / float(PRIME * PRIME)
    numbers = numbers.withColumn("v", F.least(F.lit(total - 1).cast("long"), F.floor(odds * float(total)).cast("long")))
    cells, width = _intervals(sources.select("sid", F.col("offset").alias("low"), "quota"), "low", "quota", total, many)
    drawn = numbers.withColumn("cell", F.floor(F.col("v") / width)).join(_small(cells, many), "cell").where("v >= low and v < high")
    lists = materialise(drawn.groupBy("shard", "sid").agg(F.sort_array(F.collect_list("slot")).alias("at")))  # a shard has SHARD_SLOTS at most

    # running counts of a source: within groups of shards, on top of those of the groups before
    counts = lists.select("sid", "shard", F.floor(F.col("shard") / GROUP_SHARDS).alias("grp"), F.size("at").cast("long").alias("n"))
    before = Window.partitionBy("sid").orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)
    groups = counts.groupBy("sid", "grp").agg(F.sum("n").alias("n")).select("sid", "grp", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inner = Window.partitionBy("sid", "grp").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.withColumn("run", F.coalesce(F.sum("n").over(inner), F.lit(0))).join(groups, ["sid", "grp"]).select("sid", "shard", (F.col("base") + F.col("run")).alias("first"))
    numbered = lists.join(first.hint("merge"), ["sid", "shard"]).select("shard", "sid", "first", F.posexplode("at").alias("pos", "slot"))
    numbered = numbered.select("shard", "slot", "sid", (F.col("first") + F.col("pos")).alias("j"))

    # what was drawn beyond a quota goes to the sources that were drawn too seldom
    got = lists.groupBy("sid").agg(F.sum(F.size("at")).cast("long").alias("got"))
    balance = sources.where("quota > 0").select("sid", "quota").join(got, "sid", "left").na.fill(0, ["got"])
    earlier = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)
    over, lack = F.greatest(F.col("got") - F.col("quota"), F.lit(0)), F.greatest(F.col("quota") - F.col("got"), F.lit(0))
    balance = balance.select("sid", "quota", "got", over.alias("over"), lack.alias("lack"))
    balance = materialise(balance.select("*", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in ("over", "lack")]).coalesce(1))
    spare = balance.agg(F.coalesce(F.sum("over"), F.lit(0))).first()[0]
    placed = numbered.join(_small(balance.select("sid", "quota", "over_before"), many), "sid")
    kept = placed.where("j < quota").select("shard", "slot", "sid", "j")
    if not spare:
        return kept
    cells, width = _intervals(balance.select(F.col("sid").alias("to"), "got", "lack", F.col("lack_before").alias("low")), "low", "lack", spare, many)
    given = placed.where("j >= quota").select("shard", "slot", (F.col("over_before") + F.col("j") - F.col("quota")).alias("e"))
    given = given.withColumn("cell", F.floor(F.col("e") / width)).join(_small(cells, many), "cell").where("e >= low and e < high")
    return kept.unionByName(given.select("shard", "slot", F.col("to").alias("sid"), (F.col("got") + F.col("e") - F.col("low")).alias("j")))


def _blocks_of_slots(numbered: DataFrame) -> DataFrame:
    """(shard, slot, sid, round, block) from (shard, slot, sid, j, blocks)."""
    small_batches(numbered.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sid, j, blocks = (batch.column(c).to_numpy().astype(np.int64) for c in ("sid", "j", "blocks"))
            block = permuted(j % np.maximum(blocks, 1), blocks, sid, j // np.maximum(blocks, 1))
            yield pa.RecordBatch.from_arrays([batch.column("shard"), batch.column("slot"), pa.array(sid), pa.array(j // np.maximum(blocks, 1)), pa.array(block)], names=["shard", "slot", "sid", "round", "block"])

    return numbered.select("shard", "slot", "sid", "j", "blocks").mapInArrow(run, "shard long, slot long, sid long, round long, block long")


def mix(docs: DataFrame, text: str = "text", source: str = "source", most: int = MOST, key: str | None = None) -> Mix:
    """Plan the mix of all rows of ``docs(doc_id, text, source)``.

    Null texts have no words; rows without words are taken 0 times.  Null
    sources are one source.  Repeated rows are separate documents (those of one
    source lie in the order of doc_id, null first, then size); a document of any
    length is cut into as many blocks as it takes.  An empty table gives empty
    results.  Other columns are ignored.  ``key`` names a column that numbers
    the rows of a written table; without it rows are numbered here.
    """
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORDS)), F.lit(0)).cast("long")
    number = F.col(key) if key else F.monotonically_increasing_id()
    sized = materialise(docs.select("doc_id", F.col(source).alias("source"), size.alias("size"), number.alias("key")))
    sources = materialise(source_table(sized, most).coalesce(1))
    total, rows, many = sources.agg(F.coalesce(F.max("slots"), F.lit(0)), F.coalesce(F.sum("rows"), F.lit(0)), F.count(F.lit(1))).first()
    named = sources.select("source", "sid", "blk")
    known = sized.join(_small(named, many), sized["source"].eqNullSafe(named["source"])).select("doc_id", "size", "key", "sid", "blk")
    order = ["sid", F.col("doc_id").asc_nulls_first(), "size", "key"]
    ranges = min(RANGES, max(1, -(-rows // RANGE_ROWS)))
    # written, as the limits of the ranges are drawn anew by every run
    dealt = materialise(known.where("size > 0").repartitionByRange(ranges, *order).withColumn("part", F.spark_partition_id()))
    totals = dealt.groupBy("sid", "part").agg(F.sum("size").alias("n"))
    ahead = Window.partitionBy("sid").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("sid", "part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))
    inner = Window.partitionBy("sid", "part").orderBy(F.col("doc_id").asc_nulls_first(), "size", "key").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("run", F.coalesce(F.sum("size").over(inner), F.lit(0))).join(totals.hint("merge"), ["sid", "part"])
    placed = placed.select("sid", "doc_id", "size", "key", "blk", (F.col("base") + F.col("run")).alias("start"))
    # floors of exact quotients: both sides stay far below 2^53
    first, last = F.floor(F.col("start") / F.col("blk")), F.floor((F.col("start") + F.col("size") - 1) / F.col("blk"))
    spans = placed.select("sid", "start", "key", "size", "blk", F.explode(F.sequence(first, last)).alias("block"))
    low = F.greatest(F.col("start"), F.col("block") * F.col("blk"))
    high = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * F.col("blk"))
    spans = spans.select("sid", "start", "key", "size", "block", (low - F.col("start")).alias("low"), (high - low).alias("words"))

    slots = _blocks_of_slots(draw(sources, total, many).join(_small(sources.select("sid", "blocks"), many), "sid"))

    copies = slots.groupBy("sid", "block").agg(F.count(F.lit(1)).alias("copies"))
    # the planner takes exploded rows for as few as before: without the hint it would broadcast them
    taken = spans.join(copies.hint("merge"), ["sid", "block"]).groupBy("key").agg(F.sum(F.col("words") * F.col("copies")).alias("taken"))
    out = known.join(taken.hint("merge"), "key", "left").join(_small(sources.select("sid", "source", "source_size", "target"), many), "sid")
    return Mix(sources, slots, spans, out.select("key", "doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken")))


def render(plan: Mix, docs: DataFrame, text: str = "text", key: str = "key") -> DataFrame:
    """(shard, slot, source, text): the words of every slot of the mix, one space between.

    ``docs`` carries the key of the plan.  A block has at most BLOCK words, so no value grows.
    """
    words = F.array_remove(F.split(F.coalesce(F.col("whole"), F.lit("")), r"[\x20\x09-\x0D]+"), "")
    whole = docs.select(F.col(key).alias("key"), F.col(text).alias("whole"))
    parts = plan.spans.join(whole, "key").select("sid", "block", "start", F.array_join(F.slice(words, (F.col("low") + 1).cast("int"), F.col("words").cast("int")), " ").alias("part"))
    blocks = parts.groupBy("sid", "block").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "part"))), lambda x: x["part"]), " ").alias("text"))
    return plan.slots.join(blocks, ["sid", "block"]).join(plan.sources.select("sid", "source"), "sid").select("shard", "slot", "source", "text")


def mixed_documents(docs: DataFrame, text: str = "text", source: str = "source", length: str | None = "n_chars") -> DataFrame:
    """The rows of ``docs`` as the mix takes them: copy c of a document has the words of its blocks that are taken c times or more.

    White space between words that stay neighbours is kept, a line feed stands
    for what is left out.  ``length``, a column of code points, is set anew.
    Documents without a taken word do not appear; none appears more than MOST times.
    """
    numbered = materialise(docs.withColumn("__key", F.monotonically_increasing_id()))
    plan = mix(numbered, text, source, key="__key")
    copies = plan.slots.groupBy("sid", "block").agg(F.count(F.lit(1)).cast("int").alias("copies"))
    spans = plan.spans.join(copies.hint("merge"), ["sid", "block"]).select("key", F.explode(F.sequence(F.lit(1), "copies")).alias("copy"), "low", "words")
    # a document has at most size / BLOCK + 2 spans
    wanted = spans.groupBy("key", "copy").agg(F.sort_array(F.collect_list(F.struct("low", "words"))).alias("spans"))
    joined = numbered.join(wanted.hint("merge"), F.col("__key") == F.col("key"))
    # words with the white space that follows them
    words = F.regexp_extract_all(F.col(text), F.lit(r"([^\x20\x09-\x0D]+[\x20\x09-\x0D]*)"), F.lit(1))

    def runs(spans: Column) -> Column:
        """Spans joined where one ends at the next."""
        none = F.array().cast("array<struct<low:bigint,end:bigint>>")
        end = lambda x: x["low"] + x["words"]
        one = lambda low, high: F.array(F.struct(low.alias("low"), high.alias("end")))
        return F.aggregate(spans, none, lambda a, x: F.when((F.size(a) > 0) & (F.element_at(a, -1)["end"] == x["low"]), F.concat(F.slice(a, 1, F.size(a) - 1), one(F.element_at(a, -1)["low"], end(x)))).otherwise(F.concat(a, one(x["low"], end(x)))))

    pieces = lambda w: F.transform(runs(F.col("spans")), lambda x: F.rtrim(F.array_join(F.slice(w, (x["low"] + 1).cast("int"), (x["end"] - x["low"]).cast("int")), "")))
    value = F.get(F.transform(F.array(words), lambda w: F.array_join(pieces(w), "\n")), F.lit(0))
    out = joined.withColumn("__taken", value)
    changed = {text: F.col("__taken")} | ({length: F.length("__taken").cast(dict(docs.dtypes)[length])} if length in docs.columns else {})
    return out.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in docs.columns])


def oracle_sql(most: int = MOST) -> str:
    """DuckDB SQL of the whole mix of ``documents``: doc_id, size, source_size, target, taken."""
    half = lambda side, other, size, seed: f"({side} + {scattered_sql(seed, other, 'sid', 'rnd')}) % {size}"

    def scrambled(rows: str) -> str:
        out = f"select *, spot % wide as l0, spot // wide as r0 from {rows}"
        for k in range(_MIXES):
            out = f"select *, {half(f'l{k}', f'r{k}', 'wide', 100 + 2 * k)} as l{k + 1} from ({out})"
            out = f"select *, {half(f'r{k}', f'l{k + 1}', 'high', 101 + 2 * k)} as r{k + 1} from ({out})"
        return f"select slot, sid, rnd, blocks, wide, high, (r{_MIXES} * wide + l{_MIXES})::bigint as spot from ({out})"

    return f"""with recursive sized as (select row_number() over () as key, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as size from documents),
s0 as (select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) as sid from sized group by source),
s1 as (select *, ((sid - 1) % 3 + 1)::bigint as weight from s0),
s2 as (select *, (sum(source_size) over () - coalesce(sum({most} * source_size) over w, 0))::double / (sum(weight) over () - coalesce(sum(weight) over w, 0))::double as lev from s1
 window w as (order by source_size / weight, sid rows between unbounded preceding and 1 preceding)),
s3 as (select *, (select lev from s2 where ({most} * source_size)::double >= lev * weight order by source_size / weight, sid limit 1) as level from s2),
s4 as (select *, least(({most} * source_size)::double, coalesce(level, 0) * weight) as target, greatest(1, least({BLOCK}, source_size // {BLOCK}))::bigint as blk from s3),
s5 as (select *, ((source_size + blk - 1) // blk)::bigint as blocks from s4),
s6 as (select *, case when source_size > 0 then least({most} * blocks, round(target * blocks / source_size)::bigint) else 0 end as quota from s5),
sources as materialized (select *, coalesce(sum(quota) over (order by sid rows between unbounded preceding and 1 preceding), 0)::bigint as low, (sum(quota) over ())::bigint as slots from s6),
placed as (select key, doc_id, size, sid, blk, (sum(size) over (partition by sid order by doc_id nulls first, size, key rows unbounded preceding) - size)::bigint as start
 from sized join sources on sized.source is not distinct from sources.source where size > 0),
spans as (select key, sid, start, size, blk, unnest(range(start // blk, (start + size - 1) // blk + 1)) as block from placed),
numbers as (select slot, slots from (select max(slots) as slots from sources), range(0, (select coalesce(max(slots), 0) from sources)) t(slot)),
odds as (select slot, least(slots - 1, floor(({scattered_sql(1, 'slot')} * {PRIME} + {scattered_sql(2, 'slot')})::double / {float(PRIME * PRIME)!r}::double * slots::double)::bigint) as v from numbers),
drawn as (select slot, sid, quota, row_number() over (partition by sid order by slot) - 1 as j from odds join sources on v >= low and v < low + quota),
got as (select sid, quota, count(slot) as got from sources left join drawn using (sid, quota) where quota > 0 group by sid, quota),
lacking as (select row_number() over (order by sid, j) - 1 as e, sid, j from (select sid, unnest(range(got, quota)) as j from got where got < quota)),
spare as (select row_number() over (order by sid, slot) - 1 as e, slot from drawn where j >= quota),
numbered as materialized (select slot, sid, j::bigint as j from drawn where j < quota union all select slot, sid, j::bigint from spare join lacking using (e)),
start_at as materialized (select slot, sid, (j // blocks)::bigint as rnd, blocks, ceil(sqrt(blocks::double))::bigint as wide, ceil(blocks / ceil(sqrt(blocks::double)))::bigint as high, (j % blocks)::bigint as spot from numbered join sources using (sid)),
walk as (select * from ({scrambled('start_at')}) union all select * from ({scrambled('(select * from walk where spot >= blocks)')})),
copies as (select sid, spot as block, count(*) as copies from walk where spot < blocks group by sid, spot),
taken as (select key, sum((least(start + size, (block + 1) * blk) - greatest(start, block * blk)) * copies)::bigint as taken from spans join copies using (sid, block) group by key)
select doc_id, size, source_size, target, coalesce(taken, 0)::bigint as taken
from sized left join taken using (key) join sources on sized.source is not distinct from sources.source"""
