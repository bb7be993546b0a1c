"""Line dedup: repeated line runs by prefix doubling over line-ID sequences, later copies deleted.

A text is the sequence of its lines. Equal texts form a class, of which only
the one with the smallest id goes on, so a text copied many times is one
sequence. The suffixes of all sequences are put into intervals of those that
share a prefix, as in a suffix array, in two halves.

1. Doubling: a suffix has a name for its first line, then for its first 2, 4,
   8, ... lines, each made from two names of the step before. A suffix whose
   name nobody shares drops out. What shares a name is one interval.
2. Halving gives the longest common prefixes exactly: the members of an
   interval of common length L are parted by the name of the next 2**j lines,
   for j downwards. A part of several members is an interval of length L +
   2**j; its first member, by document id and place, stays in the parent for
   it, so all intervals together have at most twice as many members as there
   are suffixes.

In the end the members of an interval have exactly its length in common, and
each suffix that has an earlier copy is in one interval in which it is not the
first: that interval's length is its longest previous match, its first member
the earliest source. A match that is not the rest of the match one line before
begins a maximal repeated run, and every run of at least ``WORDS`` words is
deleted.

Names are 64-bit hashes, equal for equal lines, instead of ranks: the order of
unequal prefixes is not needed. A sequence makes its names where it stands, and
each step asks who shares a name: one aggregation, combined before its shuffle,
and one join with the shared names only. All of it is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from kinfold.llm._frames import columns, packed
from kinfold.session import written

#: Words of a run that is deleted, at least: shorter runs of lines are found in texts that have nothing else in common.
WORDS = 5
WORD = r"[^\x20\x09-\x0D]+"


def _key(text):
    return F.xxhash64(text, F.octet_length(text))


def _lines(text):
    """The lines of a text; none of an empty or null one."""
    return F.when(F.coalesce(F.length(text), F.lit(0)) > 0, F.split(text, "\n", -1)).otherwise(F.array().cast("array<string>"))


def _place(doc_id):
    """What documents are ordered by: the id, of any type, null after all others."""
    return F.struct(doc_id.isNull().alias("none"), doc_id.alias("id"))


def _self():
    return F.struct("doc", "key", "at")


def _shared(members: DataFrame, *by: str) -> DataFrame:
    """Those of ``members(doc, key, at, ...)`` that share all of ``by`` with another, with the first of them as ``source``."""
    first = members.groupBy(*by).agg(F.min(_self()).alias("source"), F.count("*").alias("c")).where("c > 1").drop("c")
    return members.join(first, list(by))


def _doubled(names: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """For each step 2**k: the sequences with their names of that length, and the places that share one."""
    level = written(names.withColumn("at", F.sequence(F.lit(0), F.size("names") - 1)), "step")
    levels, shares, step = [], [], 1
    while True:
        each = level.select("doc", "key", F.explode(F.transform("at", lambda i: F.struct(i.alias("at"), F.get("names", i).alias("name")))).alias("x"))
        shared = written(_shared(each.select("doc", "key", "x.*"), "name").select("doc", "key", "at", "name", "source"), "shared")
        levels.append(level.select("key", "names"))
        shares.append(shared)
        alive = shared.groupBy("key").agg(F.collect_list("at").alias("alive"))
        n = F.size("names") - step
        pairs = F.zip_with(F.slice("names", F.lit(1), n), F.slice("names", F.lit(step + 1), n), lambda a, b: F.xxhash64(a, b))
        longer = level.drop("at").where(F.size("names") > step).withColumn("names", pairs).join(alive, "key")
        level = written(longer.withColumn("at", F.filter("alive", lambda i: i < F.size("names"))).where(F.size("at") > 0).drop("alive"), "step")
        step *= 2
        if not level.limit(1).count():
            return levels, shares


def _intervals(levels: list[DataFrame], shares: list[DataFrame]) -> DataFrame:
    """``(interval, length, doc, key, at)``: the members of each interval, which have exactly ``length`` lines in common."""
    columns = ("interval", "length", "doc", "key", "at")
    done = None
    for j in reversed(range(len(levels))):
        # places that share 2**j lines and not twice as many, and the first of each interval that does
        own = shares[j].select(F.xxhash64("name", F.lit(j)).alias("interval"), F.lit(1 << j).alias("length"), "doc", "key", "at")
        if j + 1 < len(levels):
            deeper = shares[j + 1].select("key", "at", (F.col("source") < _self()).alias("later"))
            own = own.join(deeper.where("later").select("key", "at"), ["key", "at"], "left_anti")
        if done is not None:
            places = done.groupBy("key").agg(F.collect_list(F.struct("interval", "length", "doc", "at")).alias("m")).join(levels[j], "key")
            one = F.explode(F.transform("m", lambda x: F.struct(x["interval"].alias("interval"), x["length"].alias("length"), x["doc"].alias("doc"), x["at"].alias("at"), F.get("names", x["at"] + x["length"]).alias("name"))))
            parted = places.select("key", one.alias("x")).select("key", "x.*")
            longer = written(_shared(parted.where("name is not null"), "interval", "name"), "parts")
            inside = longer.select(F.xxhash64("interval", "name", "length").alias("interval"), (F.col("length") + (1 << j)).alias("length"), "doc", "key", "at")
            rest = done.join(longer.where(F.col("source") < _self()).select("interval", "key", "at"), ["interval", "key", "at"], "left_anti")
            own = own.unionByName(inside.select(*columns)).unionByName(rest.select(*columns))
        # an interval of one member has nothing left to tell apart
        done = written(_shared(own.select(*columns), "interval").select(*columns), "intervals")
    return done


def runs(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(rows, runs)`` for ``docs(doc_id, text)``.

    ``rows(doc_id, key, n_lines, doc, copy)``: a row a document; ``copy`` says
    that an equal text has a smaller id, ``doc``. ``runs(key, begin, end,
    source_doc, source_key, source_begin, n_words)``: the maximal runs of lines,
    from 0 and without the end, of each different text that occur earlier, with
    their first occurrence; runs may overlap, and a run may overlap its source.
    """
    text = F.col("text").cast("string")
    ids = F.transform(_lines(text), lambda x: F.xxhash64(x))
    counts = F.transform(_lines(text), lambda x: F.regexp_count(x, F.lit(WORD)))
    base = written(docs.select("doc_id", _key(text).alias("key"), ids.alias("ids"), counts.alias("words")), "lines")
    least = written(base.groupBy("key").agg(F.min(_place(F.col("doc_id"))).alias("doc")), "least")
    # one row of each class; which one does not matter, their lines are equal
    names = base.where(F.size("ids") > 0).groupBy("key").agg(F.first("ids").alias("names")).join(least, "key")
    matches = _intervals(*_doubled(names))
    first = matches.groupBy("interval").agg(F.min(_self()).alias("source"))
    later = matches.join(first, "interval").where(F.col("source") < _self())
    order = W.partitionBy("key").orderBy("at")
    goes_on = (F.lag("at").over(order) + 1 == F.col("at")) & (F.lag("length").over(order) - 1 == F.col("length"))
    begun = later.withColumn("rest", F.coalesce(goes_on, F.lit(False))).where("not rest")
    found = begun.select("key", F.col("at").alias("begin"), (F.col("at") + F.col("length")).alias("end"), F.col("source.doc.id").alias("source_doc"), F.col("source.key").alias("source_key"), F.col("source.at").alias("source_begin"))
    words = base.groupBy("key").agg(F.first("words").alias("words"))
    run_words = F.aggregate(F.slice("words", F.col("begin") + 1, F.col("end") - F.col("begin")), F.lit(0), lambda a, x: a + x)
    found = written(found.join(words, "key").withColumn("n_words", run_words).drop("words"), "runs")
    rows = base.select("doc_id", "key", F.size("ids").cast("long").alias("n_lines")).join(least, "key")
    return rows.select("doc_id", "key", "n_lines", "doc", (_place(F.col("doc_id")) > F.col("doc")).alias("copy")), found


def deletions(docs: DataFrame) -> DataFrame:
    """``(doc_id, key, n_lines, n_deleted, runs, deleted)`` of every row; ``deleted`` has the places of its lines, from 0.

    ``runs`` has the deleted runs in order: ``begin, end, source_doc,
    source_begin``. A row whose text has a smaller id elsewhere is one run and
    loses all lines, however few words it has. Rows with equal text and id are
    treated alike, and a null id comes after all others; ids may be of any type
    with an order. Null and empty texts have no lines and no runs. Lines are
    compared as they are, blank ones too, but a run of blank lines alone has no
    words and stays. An empty table gives no rows. Other columns are not read.
    """
    rows, found = runs(docs)
    kept = found.where(F.col("n_words") >= WORDS)
    # a run adds only the lines behind the ends of those that begin before it
    before = F.coalesce(F.max("end").over(W.partitionBy("key").orderBy("begin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    fresh = F.when(F.col("end") > F.greatest(before, "begin"), F.sequence(F.greatest(before, "begin"), F.col("end") - 1)).otherwise(F.array().cast("array<int>"))
    each = kept.withColumn("fresh", fresh).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("begin", "end", "source_doc", "source_begin", "fresh"))).alias("r"))
    by = each.select("key", F.transform("r", lambda x: F.struct(*(x[c].alias(c) for c in ("begin", "end", "source_doc", "source_begin")))).alias("runs"), F.flatten(F.transform("r", lambda x: x["fresh"])).alias("gone"))
    joined = rows.join(by, "key", "left")
    whole = F.col("copy") & (F.col("n_lines") > 0)
    own = F.struct(F.lit(0).alias("begin"), F.col("n_lines").cast("int").alias("end"), F.col("doc.id").alias("source_doc"), F.lit(0).alias("source_begin"))
    all_runs = F.when(whole, F.array(own)).otherwise(F.coalesce("runs", F.filter(F.array(own), lambda x: F.lit(False))))
    deleted = F.when(whole, F.sequence(F.lit(0), F.col("n_lines").cast("int") - 1)).otherwise(F.coalesce("gone", F.array().cast("array<int>")))
    out = joined.select("doc_id", "key", "n_lines", all_runs.alias("runs"), deleted.alias("deleted"))
    return out.select("doc_id", "key", "n_lines", F.size("deleted").cast("long").alias("n_deleted"), "runs", "deleted")


def report(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_lines, n_deleted, n_runs, deleted, runs)`` of every row, as :func:`deletions` treats it.

    ``deleted`` is the md5 of the deleted places joined by commas, ``runs`` of
    ``begin-end:source_doc:source_begin`` of the deleted runs likewise; a null
    source id is empty.
    """
    said = F.transform("runs", lambda r: F.concat(r["begin"].cast("string"), F.lit("-"), r["end"].cast("string"), F.lit(":"), F.coalesce(r["source_doc"].cast("string"), F.lit("")), F.lit(":"), r["source_begin"].cast("string")))
    return deletions(docs).select("doc_id", "n_lines", "n_deleted", F.size("runs").cast("long").alias("n_runs"), F.md5(F.array_join("deleted", ",")).alias("deleted"), F.md5(F.array_join(said, ",")).alias("runs"))


def clean(docs: DataFrame) -> DataFrame:
    """``docs`` with the deleted lines cut from ``text``; every row and the other columns stay."""
    row = packed(docs, F.col("doc_id").alias("i"), _key(F.col("text").cast("string")).alias("k"))
    gone = deletions(docs).where("n_deleted > 0").select(F.col("doc_id").alias("doc"), "key", "deleted").dropDuplicates(["doc", "key"])
    joined = row.join(gone, F.col("i").eqNullSafe(F.col("doc")) & (F.col("k") == F.col("key")), "left")
    kept = F.array_join(F.filter(F.split(F.col("row.text").cast("string"), "\n", -1), lambda x, i: ~F.array_contains("deleted", i)), "\n")
    new = F.when(F.col("deleted").isNull(), F.col("row.text")).otherwise(kept)
    return joined.select(*columns(docs, text=new))


#: The same rows in SQL: prefixes of all shared suffixes are made longer line by line.
ORACLE_SQL = f"""
with recursive rows as (
  select doc_id, md5(text) as key, case when coalesce(length(text), 0) > 0 then string_split(text, chr(10)) else [] end as l from documents),
least as (select key, min(doc_id) as doc from rows group by key),
seq as (select distinct on (key) key, doc, list_transform(l, lambda x: md5(x)) as l, list_transform(l, lambda x: len(regexp_extract_all(x, '{WORD}'))) as w from rows join least using (key) where len(l) > 0),
each as (select key, doc, unnest(range(0, len(l))) as pos, unnest(l) as line from seq),
level(n, key, doc, pos, name, source) as (
  select n, key, doc, pos, name, source from (select 1 as n, key, doc, pos, line as name, min({{'doc': doc, 'key': key, 'pos': pos}}) over (partition by line) as source, count(*) over (partition by line) as c from each) where c > 1
  union all
  select n, key, doc, pos, name, source from (
    select *, min({{'doc': doc, 'key': key, 'pos': pos}}) over (partition by name) as source, count(*) over (partition by name) as c from (
      select v.n + 1 as n, v.key as key, v.doc as doc, v.pos as pos, md5(v.name || e.line) as name from level v join each e on e.key = v.key and e.pos = v.pos + v.n)) where c > 1),
most as (select key, pos, max(n) as n, arg_max(source, n) as source from level where source < {{'doc': doc, 'key': key, 'pos': pos}} group by key, pos),
begun as (select m.* from most m left join most p on p.key = m.key and p.pos = m.pos - 1 where p.n is null or p.n <> m.n + 1),
kept as (select b.key as key, b.pos as a, b.pos + b.n as b, source from begun b join seq using (key) where list_sum(w[b.pos + 1 : b.pos + b.n]) >= {WORDS}),
gone as (select key, list(distinct p order by p) as deleted from (select key, unnest(range(a, b)) as p from kept) group by key),
told as (select key, count(*) as n, string_agg(a || '-' || b || ':' || source.doc || ':' || source.pos, ',' order by a, b) as runs from kept group by key),
final as (select r.doc_id as doc_id, len(l) as n_lines, r.doc_id > doc and len(l) > 0 as whole, doc, coalesce(deleted, []) as deleted, coalesce(n, 0) as n, coalesce(runs, '') as runs from rows r left join least using (key) left join gone using (key) left join told using (key))
select doc_id, n_lines::bigint as n_lines, case when whole then n_lines else len(deleted) end::bigint as n_deleted, case when whole then 1 else n end::bigint as n_runs,
  md5(array_to_string(case when whole then range(0, n_lines) else deleted end, ',')) as deleted, md5(case when whole then '0-' || n_lines || ':' || doc || ':0' else runs end) as runs
from final
"""
