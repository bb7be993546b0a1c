"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source's documents are dealt by a hash of their ids into permuted blocks.
A source whose target is below its size draws part of its blocks, in permuted
order, one above its size draws all of them once and part of them again. The
round that is not complete takes blocks while they fit, of the block that does
not the documents that do, and, where that leaves a gap of more than ``NEAR``
of the source, goes on through all its documents in permuted order and takes
each that fits; then documents are exchanged while that brings the sum nearer
to the target. So no document is taken more than twice, and what a source
misses is below what any one document or exchange could mend.

The draws, blocks of a round, go to output shards down a binary tree. A node
has the number of draws of each source below it and gives its left child half
of them: how many of each source, is a multivariate hypergeometric draw, made
source by source by inverting the hypergeometric distribution with a uniform
number that a hash of seed, level, node and source gives. A leaf's quotas are
exact, and every shard is a fair sample of the mix. A source's permuted draws
fill its quotas in order, and documents are ordered by a hash inside their
shard.

All of it is DataFrame expressions. A source has as many blocks as shards need,
running sums over them go by lanes, and only tables of a row a source are
sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from kinfold.llm._frames import columns, packed
from kinfold.session import written

#: Weights of the sources in order, repeating; the mix has ``SHARE`` times all words, a source ``MOST`` times its own at most.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
#: Blocks of a source: one for so many documents, but no more than this, or than so many for each shard.
PER_BLOCK = 16
BLOCKS = 4096
PER_SHARD = 64
#: Gaps to a target above this share of its source are closed.
NEAR = 0.002
#: Words of an output shard.
SHARD_WORDS = 500_000
#: Rows of a table up to which it is broadcast (about 60 bytes each); beyond that it is shuffled.
BROADCAST_ROWS = 1_000_000
#: Tasks that write the mixed shards, at most.
WRITERS = 1 << 16
SEED = "mix"
BITS = 48
LANES = 10


def number(*parts):
    """A number below 2**BITS from the md5 of the parts joined by colons; a null part is empty."""
    text = F.concat_ws(":", F.lit(SEED), *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, BITS // 4), 16, 10).cast("long")


def size_of(text):
    """The words of a text; none for null."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """``(place, source, source_size, n, target)`` for ``sizes(source, size)``.

    Sources in order of code point, null last, have places from 1 and the
    weights in turn. With sources by size over weight, the level at which
    uncapped sources share is the largest that any start of the capped ones
    gives.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    by = by.withColumn("place", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())).cast("long"))
    by = by.withColumn("w", F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.col("place") - 1) % len(WEIGHTS) + 1).cast("int")))
    order = W.orderBy(F.col("source_size") / F.col("w"), "place")
    before, rest = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    all_rows = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    level = (F.lit(SHARE) * F.sum("source_size").over(all_rows) - MOST * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("w").over(rest)
    by = by.withColumn("level", level)
    by = by.withColumn("level", F.max("level").over(all_rows))
    return by.select("place", "source", "source_size", "n", F.least(F.lit(float(MOST)) * F.col("source_size"), F.col("level") * F.col("w")).alias("target"))


def _few(df: DataFrame) -> DataFrame:
    """``df``, broadcast if it has few rows."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def running(df: DataFrame, key, value, name: str) -> DataFrame:
    """``df(place, ...)`` with the running sum of ``value`` for each place in order of ``key``, a number below 2**BITS.

    Sums of lanes, which are ranges of the key, come first, so a place of many
    rows is not one task.
    """
    lanes = df.withColumns({"__key": key, "__value": value}).withColumn("__lane", F.shiftright("__key", BITS - LANES))
    sums = lanes.groupBy("place", "__lane").agg(F.sum("__value").alias("__sum"))
    sums = sums.select("place", "__lane", (F.sum("__sum").over(W.partitionBy("place").orderBy("__lane")) - F.col("__sum")).alias("__before"))
    own = F.sum("__value").over(W.partitionBy("place", "__lane").orderBy("__key").rowsBetween(W.unboundedPreceding, 0))
    return lanes.join(sums, ["place", "__lane"]).withColumn(name, own + F.col("__before")).drop("__key", "__value", "__lane", "__before")


def draws_of(units: DataFrame, goals: DataFrame) -> DataFrame:
    """``(place, block, round, low, high)``: the ranges of hashes that the mix takes.

    ``units(place, block, h, size)``: a row for each hash of a source, unique in it.
    """
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    goals = goals.withColumn("full", full).select("place", "source_size", "full", (F.col("target") - F.col("full") * F.col("source_size")).alias("rest"))
    goals = _few(goals)
    blocks = units.groupBy("place", "block").agg(F.sum("size").alias("size"), F.min("h").alias("low"), F.max("h").alias("high")).join(goals, "place")
    blocks = written(running(blocks, number(F.lit("cut"), F.col("place"), F.col("block")), F.col("size"), "upto"), "blocks")
    whole = blocks.withColumn("round", F.explode(F.expr("filter(array(1, 2), x -> x <= full)"))).select("place", "block", "round", "low", "high")
    # the round that is not complete: blocks that fit, and of the first that does not the documents that do
    part = blocks.where("upto <= rest").select("place", "block", (F.col("full") + 1).alias("round"), "low", "high")
    edge = blocks.where("upto > rest and upto - size < rest").select("place", "block", "full", (F.col("rest") - F.col("upto") + F.col("size")).alias("rest"))
    inside = units.join(F.broadcast(edge), ["place", "block"]).withColumn("upto", F.sum("size").over(W.partitionBy("place", "block").orderBy("h")))
    cut = inside.where("upto <= rest").groupBy("place", "block").agg((F.first("full") + 1).alias("round"), F.min("h").alias("low"), F.max("h").alias("high"))
    drawn = written(part.unionByName(cut), "draws")
    sums = _taken(units, drawn).groupBy("place").agg(F.sum("size").alias("got"))
    gap = goals.join(sums, "place", "left").withColumn("gap", F.col("rest") - F.coalesce("got", F.lit(0)))
    open_ = written(gap.where(F.col("gap") > NEAR * F.col("source_size")).select("place", "source_size", "full", "gap"), "open")
    if not open_.limit(1).count():
        return whole.unionByName(drawn)
    state = _closed(_taken(units.join(_few(open_.select("place")), "place"), drawn, "left"), open_)
    single = state.where("taken").join(open_, "place").select("place", "block", (F.col("full") + 1).alias("round"), F.col("h").alias("low"), F.col("h").alias("high"))
    return whole.unionByName(drawn.join(open_, "place", "left_anti")).unionByName(single)


def _closed(units: DataFrame, open_: DataFrame) -> DataFrame:
    """``(place, block, h, size, taken)``: the units of the open sources with the gaps closed.

    Ends: a pass takes at least one unit for each source in which one fits,
    and an exchange brings a sum of whole words nearer to its target.
    """
    state = written(units.select("place", "block", "h", "size", F.col("round").isNotNull().alias("taken")), "state")
    wanted = written(open_.join(state.where("taken").groupBy("place").agg(F.sum("size").alias("got")), "place", "left").select("place", "source_size", (F.col("gap") + F.coalesce("got", F.lit(0))).alias("goal")), "goal")
    while True:
        sums = state.groupBy("place").agg(F.sum(F.when(F.col("taken"), F.col("size")).otherwise(0)).alias("got"))
        gap = wanted.join(sums, "place").select("place", (F.col("goal") - F.col("got")).alias("gap"), "source_size")
        gap = written(gap.where(F.abs("gap") > NEAR * F.col("source_size")).drop("source_size"), "gap")
        free = state.where("not taken and size > 0").join(gap, "place")
        fits = free.where("size <= gap")
        if fits.limit(1).count():  # in permuted order up to the first that overshoots, which will not fit the next time
            moved = running(fits, F.col("h"), F.col("size"), "upto").where("upto <= gap").select("place", "h")
        else:
            moved = _exchange(state.where("size > 0"), gap)
        moved = written(moved, "moved")
        if not moved.limit(1).count():
            return state
        state = written(state.join(_few(moved.withColumn("turn", F.lit(True))), ["place", "h"], "left").select("place", "block", "h", "size", (F.col("taken") != F.coalesce("turn", F.lit(False))).alias("taken")), "state")


def _exchange(units: DataFrame, gap: DataFrame) -> DataFrame:
    """``(place, h)`` of the units that change sides: for each source the one free unit, for one that is taken or for none, after which the sum is nearest to the target, if nearer than now.

    Over different sizes only: the nearest free size to each taken size plus the gap.
    """
    sizes = units.join(gap, "place").groupBy("place", "size", "taken").agg(F.min("h").alias("h"), F.first("gap").alias("gap"))
    out = sizes.where("taken").select("place", "size", "h", "gap").unionByName(gap.select("place", F.lit(0).cast("long").alias("size"), F.lit(None).cast("long").alias("h"), "gap"))
    none = F.lit(None)
    asked = out.select("place", (F.col("size") + F.col("gap")).alias("at"), F.struct(F.col("size").alias("x"), F.col("h").alias("hx"), "gap").alias("ask"), none.cast("struct<y:long,hy:long>").alias("have"))
    had = sizes.where("not taken").select("place", F.col("size").cast("double").alias("at"), none.cast("struct<x:long,hx:long,gap:double>").alias("ask"), F.struct(F.col("size").alias("y"), F.col("h").alias("hy")).alias("have"))
    order = W.partitionBy("place").orderBy("at", F.col("ask").isNotNull())
    both = asked.unionByName(had).withColumns({
        "below": F.last("have", True).over(order.rowsBetween(W.unboundedPreceding, 0)), "above": F.first("have", True).over(order.rowsBetween(0, W.unboundedFollowing)),
    }).where("ask is not null")
    each = both.select("place", "ask.*", F.explode(F.array("below", "above")).alias("have")).where("have is not null").select("place", "x", "hx", "gap", "have.*")
    left = F.abs(F.col("gap") - F.col("y") + F.col("x"))
    best = each.groupBy("place").agg(F.min(F.struct(left.alias("left"), "x", "y", "hx", "hy")).alias("b"), F.first("gap").alias("gap")).where("b.left < abs(gap)")
    return best.select("place", F.explode(F.filter(F.array("b.hx", "b.hy"), lambda h: h.isNotNull())).alias("h"))


def _taken(rows: DataFrame, draws: DataFrame, how: str = "inner") -> DataFrame:
    """``rows(place, block, h, ...)`` once for each draw that holds them, with the draw's other columns."""
    other = _few(draws.withColumnsRenamed({"place": "__place", "block": "__block"}))
    on = (rows["place"] == other["__place"]) & (rows["block"] == other["__block"]) & rows["h"].between(other["low"], other["high"])
    return rows.join(other, on, how).drop("__place", "__block", "low", "high")


# -- the splitting tree -----------------------------------------------------------------------


def _hypergeometric(total: str, marked: str, take: str, u: str) -> str:
    """SQL for how many of ``take`` items drawn from ``total`` are among ``marked``, by inversion at ``u``.

    Probabilities come from ratios of neighbours, starting at the mode, over
    ten standard deviations either way; what lies beyond is below a double's
    precision.
    """
    up = f"((({marked}) - k) * (({take}) - k) / ((k + 1.0D) * (({total}) - ({marked}) - ({take}) + k + 1)))"
    low = f"greatest(0L, ({take}) + ({marked}) - ({total}))"
    high = f"least(({marked}), ({take}))"
    mode = f"cast(floor((({take}) + 1.0D) * (({marked}) + 1.0D) / (({total}) + 2.0D)) as bigint)"
    wide = f"cast(10 * sqrt(({take}) * (({marked}) / greatest(1.0D, ({total}))) + 1) + 10 as bigint)"
    first, last = f"greatest({low}, least({mode}, {high}) - {wide})", f"least({high}, {mode} + {wide})"
    # unnormalised from the first value on: scaled at the mode so that nothing overflows
    scale = f"aggregate(sequence({first}, {first} + greatest(0, {mode} - {first})), named_struct('w', 1.0D, 'top', 1.0D), (s, k) -> named_struct('w', s.w * greatest({up}, 0.0D), 'top', greatest(s.top, s.w)), s -> s.top)"
    start = f"1.0D / {scale}"
    step = f"named_struct('w', s.w * greatest({up}, 0.0D), 'sum', s.sum + s.w)"
    total_w = f"aggregate(sequence({first}, {last}), named_struct('w', {start}, 'sum', 0.0D), (s, k) -> {step}, s -> s.sum)"
    walk = f"named_struct('w', s.w * greatest({up}, 0.0D), 'sum', s.sum + s.w, 'at', if(s.sum <= ({u}) * t, k, s.at))"
    return f"aggregate(array({total_w}), {first}, (z, t) -> aggregate(sequence({first}, {last}), named_struct('w', {start}, 'sum', 0.0D, 'at', {first}), (s, k) -> {walk}, s -> s.at))"


def split(quotas: DataFrame, depth: int) -> DataFrame:
    """``(place, shard, quota)``: exact shares of ``quotas(place, n)`` in 2**depth shards; a row for each share above 0."""
    nodes = quotas.agg(F.array_sort(F.collect_list(F.struct("place", "n"))).alias("have")).select(F.lit(0).cast("long").alias("node"), "have")
    all_n = "aggregate(have, 0L, (s, x) -> s + x.n)"
    for level in range(depth):
        u = f"conv(substring(md5(concat('{SEED}:split:{level}:', node, ':', x.place)), 1, 12), 16, 10) / {float(1 << BITS)}D"
        draw = _hypergeometric("a.total", "x.n", "a.take", u)
        left = f"""aggregate(have, named_struct('total', {all_n}, 'take', cast(ceil({all_n} / 2) as bigint), 'out', cast(array() as array<struct<place:bigint,n:bigint>>)),
            (a, x) -> aggregate(array({draw}), a, (b, k) -> named_struct('total', b.total - x.n, 'take', b.take - k, 'out', concat(b.out, array(named_struct('place', x.place, 'n', k))))), a -> a.out)"""
        nodes = nodes.withColumn("first", F.expr(left))
        some = "filter({}, x -> x.n > 0)"
        first, second = F.expr(some.format("first")), F.expr(some.format("zip_with(have, first, (x, y) -> named_struct('place', x.place, 'n', x.n - y.n))"))
        child = F.explode(F.array(F.struct((F.col("node") * 2).alias("node"), first.alias("have")), F.struct((F.col("node") * 2 + 1).alias("node"), second.alias("have"))))
        nodes = written(nodes.select(child.alias("c")).select("c.*"), "nodes")
    return nodes.select(F.col("node").alias("shard"), F.explode("have").alias("x")).select("x.place", "shard", F.col("x.n").alias("quota"))


def plan(docs: DataFrame, shard_words: int = SHARD_WORDS) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """``(sized, goals, draws, shards)`` for ``docs(doc_id, text, source)``.

    ``sized(doc_id, place, block, h, size)``: a row a document; ``draws`` has
    the blocks' hash ranges with the shard of each; ``shards``: how many.
    """
    sized = written(docs.select("doc_id", F.col("source").cast("string").alias("source"), size_of(F.col("text")).alias("size"), number(F.lit("doc"), F.col("doc_id")).alias("h")), "sized")
    goals = written(targets(sized), "goals")
    words = goals.agg(F.sum("target")).first()[0] or 0
    depth = int(words / shard_words).bit_length()
    goals = goals.withColumn("blocks", F.least(F.lit(max(BLOCKS, PER_SHARD << depth)), F.ceil(F.col("n") / PER_BLOCK)).cast("long"))
    sized = placed(sized, goals)
    units = written(sized.groupBy("place", "block", "h").agg(F.sum("size").alias("size")), "units")
    drawn = written(draws_of(units, goals), "drawn")
    # a draw is a block of a round, whatever part of it is taken
    drawing = drawn.select("place", "block", "round").distinct()
    ranked = running(drawing, number(F.lit("draw"), F.col("place"), F.col("block"), F.col("round")), F.lit(1), "rank")
    shares = split(drawing.groupBy("place").agg(F.count("*").alias("n")), depth)
    shares = shares.withColumn("upto", F.sum("quota").over(W.partitionBy("place").orderBy("shard")))
    slots = shares.select("place", "shard", F.explode(F.sequence(F.col("upto") - F.col("quota") + 1, F.col("upto"))).alias("rank"))
    draws = ranked.join(slots, ["place", "rank"]).select("place", "block", "round", "shard").join(drawn, ["place", "block", "round"])
    return sized, goals, written(draws, "mix"), 1 << depth


def placed(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """``rows(source, h, ...)`` with place and block instead of the source: equal shares of the range of hashes."""
    of = _few(goals.select(F.col("source").alias("__source"), "place", "blocks"))
    joined = rows.join(of, rows["source"].eqNullSafe(of["__source"]))
    block = F.shiftright(F.shiftright("h", BITS - 32) * F.col("blocks"), 32)
    return joined.withColumn("block", block).drop("source", "__source", "blocks")


def mix(docs: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The mixed documents, shard by shard, shuffled inside: the columns of ``docs``, a row each time one is taken.

    Reads ``doc_id``, ``text`` and ``source``. A null text has no words and is
    taken with its block; null is a source of its own; rows with equal ids,
    null among them, go together. An empty table gives no rows. Other columns
    ride along whatever their names. Reruns agree.
    """
    _, goals, draws, shards = plan(docs, shard_words)
    rows = packed(docs, F.col("source").cast("string").alias("source"), F.col("doc_id").cast("string").alias("id"), number(F.lit("doc"), F.col("doc_id")).alias("h"))
    taken = _taken(placed(rows, goals), draws)
    writers = min(shards, WRITERS)
    near = taken.repartitionById(writers, (F.col("shard") * writers / F.lit(shards)).cast("int"))  # each task its own shards
    return near.sortWithinPartitions("shard", number(F.lit("order"), F.col("id"), F.col("round"))).select(*columns(docs))


def report(docs: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``(doc_id, size, source_size, target, taken, shards)`` of every row of ``docs``.

    ``shards``: the output shard of each time that the document is taken,
    comma-joined, empty if it is not. A null text has size 0; null is a source
    of its own; rows with equal ids count and are taken each on its own; an
    empty table gives no rows, and other columns are not read.
    """
    sized, goals, draws, _ = plan(docs, shard_words)
    times = draws.select("place", "block", "low", "high", F.struct("round", "shard").alias("x"))
    rows = _taken(written(sized.withColumn("row", F.monotonically_increasing_id()), "rows"), times, "left")
    each = rows.groupBy("row").agg(*(F.first(c).alias(c) for c in ("doc_id", "place", "size")), F.array_sort(F.collect_list("x")).alias("x"))
    shards = F.array_join(F.transform("x", lambda x: x["shard"].cast("string")), ",")
    return each.join(_few(goals.select("place", "source_size", "target")), "place").select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("x")).alias("taken"), shards.alias("shards"))


def _sql_number(*parts: str) -> str:
    return f"cast('0x' || substr(md5(concat_ws(':', '{SEED}', {', '.join(parts)})), 1, {BITS // 4}) as bigint)"


def oracle(shard_words: int = SHARD_WORDS) -> str:
    """The rows of :func:`report` in SQL: units are taken one at a time, exchanges are sought among all pairs, and the tree draws with the gamma function."""
    ln = lambda n, k: f"(lgamma(({n}) + 1) - lgamma(({k}) + 1) - lgamma(({n}) - ({k}) + 1))"
    n = "have[i].n"
    pmf = f"exp({ln(n, 'k')} + {ln(f'total - {n}', 'take - k')} - {ln('total', 'take')})"
    low, high = f"greatest(0, take + {n} - total)", f"least({n}, take)"
    u = f"cast('0x' || substr(md5('{SEED}:split:' || level || ':' || node || ':' || have[i].place), 1, 12) as bigint) / {float(1 << BITS)}"
    return f"""
with recursive sized as (select row_number() over () as r, doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size,
    {_sql_number("'doc'", "coalesce(doc_id::varchar, '')")} as h from documents),
by_source as (select source, sum(size)::bigint as source_size, count(*) as n, row_number() over (order by source nulls last) as place from sized group by source),
weighed as (select *, [{', '.join(map(str, WEIGHTS))}][(place - 1) % {len(WEIGHTS)} + 1] as w from by_source),
levels as (select *, ({SHARE} * sum(source_size) over () - {MOST} * coalesce(sum(source_size) over (order by source_size / w, place rows between unbounded preceding and 1 preceding), 0))
    / sum(w) over (order by source_size / w, place rows between current row and unbounded following) as l from weighed),
goals as (select place, source, source_size, n, least({float(MOST)} * source_size, max(l) over () * w)::double as target from levels),
tree as (select length(bin(floor(sum(target) / {shard_words})::bigint)) - case when floor(sum(target) / {shard_words}) = 0 then 1 else 0 end as depth from goals),
goal as (select g.*, case when source_size > 0 then floor(target / source_size)::int else 0 end as whole, least(greatest({BLOCKS}, {PER_SHARD} << depth::int), ceil(n / {PER_BLOCK}))::bigint as blocks from goals g, tree),
placed as (select r, doc_id, size, h, place, ((h >> {BITS - 32}) * blocks) >> 32 as block from sized s join goal g on g.source is not distinct from s.source),
units as (select place, block, h, sum(size)::bigint as size from placed group by all),
block_size as (select place, block, sum(size) as size from units group by all),
run as (select b.*, target - whole * source_size as rest, sum(size) over (partition by place order by {_sql_number("'cut'", 'place::varchar', 'block::varchar')}) as upto from block_size b join goal using (place)),
inside as (select u.*, r.upto <= rest as fits, r.upto - r.size < rest as reached, rest - (r.upto - r.size) as room, sum(u.size) over (partition by place, block order by h) as upto from units u join run r using (place, block)),
base as (select place, block, h, size, fits or (reached and upto <= room) as taken from inside),
start as (select b.place as place, any_value(source_size) as source_size, any_value(target - whole * source_size) - coalesce(sum(size) filter (where taken), 0) as gap,
    list({{'size': size, 'h': h}} order by h) filter (where size > 0 and not taken) as free, list({{'size': size, 'h': h}} order by h) filter (where size > 0 and taken) as used, list(h) filter (where size = 0 and taken) as nothing from base b join goal using (place) group by b.place),
step(k, place, source_size, gap, free, used, nothing) as (
  select 0, place, source_size, gap::double, coalesce(free, []), coalesce(used, []), coalesce(nothing, []) from start
  union all
  select k + 1, place, source_size, gap - m.y + m.x, list_sort(list_concat(list_filter(free, lambda f: f.h <> m.hy), list_filter(used, lambda f: m.x > 0 and f.h = m.hx)), 'asc'),
    list_concat(list_filter(used, lambda f: m.x = 0 or f.h <> m.hx), list_filter(free, lambda f: f.h = m.hy)), nothing
  from (select *, case when k = 0 and gap <= {NEAR} * source_size then null when len(list_filter(free, lambda f: f.size <= gap)) > 0
      then (select {{'left': 0.0::double, 'x': 0::bigint, 'y': f.size, 'hx': 0::bigint, 'hy': f.h}} from (select unnest(free) as f) where f.size <= gap order by f.h limit 1)
      else (select min({{'left': abs(gap - f.size + u.size)::double, 'x': u.size, 'y': f.size, 'hx': u.h, 'hy': f.h}}) from (select unnest(free) as f), (select unnest(list_append(used, {{'size': 0::bigint, 'h': 0::bigint}})) as u)) end as m
    from step where abs(gap) > {NEAR} * source_size) where m is not null and (m.left < abs(gap))),
last as (select * from step qualify row_number() over (partition by place order by k desc) = 1),
chosen as (select place, unnest(used).h as h from last union all select place, unnest(nothing) from last),
times as (select u.place as place, block, h, unnest(range(1, whole + 1)) as round from units u join goal using (place) union all select u.place, block, h, whole + 1 from chosen c join units u using (place, h) join goal using (place)),
draws as (select distinct place, block, round from times),
node(level, node, have, i, total, take, lefts) as (
  select 0, 0::bigint, list({{'place': place, 'n': n}} order by place), 1, sum(n)::bigint, ceil(sum(n) / 2)::bigint, []::bigint[] from (select place, count(*) as n from draws group by place)
  union all
  select * from (
    select level, node, have, i + 1, total - {n}, take - k, list_append(lefts, k) from (
      select *, {low} + len(list_filter(range(1, len(p) + 1), lambda t: list_sum(p[1:t]) <= {u})) as k from (
        select *, list_transform(range({low}, {high} + 1), lambda k: {pmf}) as p from node, tree where i <= len(have) and level < depth))
    union all
    select level + 1, node * 2 + c, h2, 1, coalesce(list_sum(list_transform(h2, lambda x: x.n)), 0)::bigint, ceil(coalesce(list_sum(list_transform(h2, lambda x: x.n)), 0) / 2)::bigint, []::bigint[] from (
      select level, node, c, list_filter(list_transform(range(1, len(have) + 1), lambda j: {{'place': have[j].place, 'n': case when c = 0 then lefts[j] else have[j].n - lefts[j] end}}), lambda x: x.n > 0) as h2
      from node, tree, (select unnest([0, 1]) as c) where i > len(have) and level < depth))),
quotas as (select node as shard, x.place as place, x.n as quota from (select node, unnest(have) as x from node, tree where level = depth and i = 1)),
upto as (select *, sum(quota) over (partition by place order by shard) as upto from quotas),
ranked as (select *, row_number() over (partition by place order by {_sql_number("'draw'", 'place::varchar', 'block::varchar', 'round::varchar')}) as rank from draws),
sharded as (select r.place as place, block, round, shard from ranked r join upto q on q.place = r.place and rank > upto - quota and rank <= upto),
final as (select p.r as r, count(*) as times, string_agg(s.shard::varchar, ',' order by t.round) as shards from placed p join times t using (place, block, h) join sharded s on s.place = t.place and s.block = t.block and s.round = t.round group by p.r)
select p.doc_id as doc_id, p.size as size, g.source_size as source_size, g.target as target, p.size * coalesce(f.times, 0)::bigint as taken, coalesce(f.shards, '') as shards
from placed p join goal g using (place) left join final f using (r)
"""


ORACLE_SQL = oracle()
