"""Quality classifier: perplexity under an interpolated modified Kneser-Ney n-gram model.

The model is over characters as they are, ``ORDER`` in a row, runs of white
space being one space, of trusted text: documents labelled of good quality and
not toxic, whole, but for one in ``FOLDS`` of them by a hash of the id, on which
the thresholds are set. The number of n-grams has no bound and grows with the
corpus.

Training counts n-grams in the tasks, then by shards of the n-gram; counts of
continuations, of contexts and of counts are aggregations of that table, and
joins between orders, sharded by suffix and by context, give each seen n-gram
its interpolated probability (Chen and Goodman 1999, three discounts an order)
and each context the weight of its shorter ones.

A model of at most ``MODEL_ROWS`` n-grams (16 bytes each) is broadcast to the
tasks that score the texts. A larger one is not gathered anywhere: each
document's distinct n-grams are counted and joined with the model by shards of
the n-gram. There the logarithm of a probability is a sum of independent
entries, one for each order's n-gram and one for each order's context, of which
what the model has not seen adds nothing.

A document's score is its mean negative log2 probability a character, drawn
towards the mean of its language's held-out trusted text as if ``PRIOR``
characters of it had been read, so a few odd characters do not condemn a short
text. The threshold of a language is a quantile of its held-out trusted
documents' scores; one with fewer than ``LEAST`` of them takes the quantile over
all languages.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField
from pyspark.sql.window import Window as W

from kinfold.llm._frames import adding
from kinfold.llm._words import U, mix, pieces
from kinfold.session import written

ORDER = 5
FOLDS = 5
PRIOR = 200
QUANTILE = 0.995
LEAST = 50
#: Scores are put in steps of this size for the quantiles.
STEP = 1e-4
#: N-grams that a task gathers before it passes them on, and bytes of text that are scored at once.
GATHER = 4_000_000
PIECE = 1 << 22
#: N-grams of a model that is broadcast, at most: 128 MB.
MODEL_ROWS = 8_000_000
#: Trusted ids up to which they are broadcast (8 bytes each); beyond that the texts are shuffled by id.
BROADCAST_IDS = 4_000_000
SPACE = np.array([chr(c).isspace() for c in range(0x3002)])


class Chars:
    """The characters of some texts, each text behind ``ORDER - 1`` edge signs.

    ``at``: the place of each character in ``points``; ``owner``: its text.
    """

    def __init__(self, texts: pa.Array):
        parts = [t or "" for t in texts.to_pylist()]
        pad = "\0" * (ORDER - 1)
        points = np.frombuffer((pad + pad.join(parts)).encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        start = np.cumsum(sizes + ORDER - 1) - sizes
        real = np.ones(len(points), bool)
        for i in range(1, ORDER):
            real[start - i] = False
        space = SPACE[np.minimum(points, 0x3001)] & real
        points = np.where(space, 32, np.where(real & (points == 0), 0xFFFD, points))
        keep = np.append(True, ~(space[1:] & space[:-1]))
        self.points = points[keep].astype(U)
        self.at = np.flatnonzero(real[keep])
        self.owner = np.repeat(np.arange(len(parts)), sizes + ORDER - 1)[keep][self.at] if len(parts) else self.at
        self.size = np.bincount(self.owner, minlength=len(parts))

    def grams(self, k: int, at: np.ndarray) -> np.ndarray:
        """The hash of the ``k`` characters that end at each place."""
        return gram_hash(self.points[at - k + i] for i in range(1, k + 1))


def gram_hash(columns) -> np.ndarray:
    out, k = U(0), 0
    with np.errstate(over="ignore"):
        for c in columns:
            out, k = out * U(0x2545F4914F6CDD1D | 1) + c, k + 1
        return mix(out + U(k))


def counts(texts: DataFrame) -> DataFrame:
    """``(gram, c)`` over all of ``texts(text)``: each character with the ``ORDER - 1`` before it."""

    def merged(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        h, points, c = (np.concatenate(x) for x in zip(*parts, strict=True))
        _, first, which = np.unique(h, return_index=True, return_inverse=True)
        return h[first], points[first], np.bincount(which, c, len(first)).astype(np.int64)

    def out(part: tuple[np.ndarray, ...]) -> pa.RecordBatch:
        text = np.ascontiguousarray(part[1].astype(np.uint32)).view(f"<U{ORDER}").ravel().tolist()
        return pa.RecordBatch.from_arrays([pa.array(text, pa.string()), pa.array(part[2])], names=["gram", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, parts = 0, []
        for batch in batches:
            for piece in pieces(batch, limit=PIECE):
                chars = Chars(piece.column("text"))
                h, first, c = np.unique(chars.grams(ORDER, chars.at), return_index=True, return_counts=True)
                at = chars.at[first]
                parts.append((h, np.stack([chars.points[at - ORDER + i] for i in range(1, ORDER + 1)], axis=1).astype(np.uint32), c))
                held += len(h)
                if held > GATHER:
                    parts = [merged(parts)]
                    held = len(parts[0][0])
                    if held > GATHER // 2:
                        yield out(parts[0])
                        held, parts = 0, []
        if held:
            yield out(merged(parts))

    return texts.select("text").mapInArrow(run, "gram string, c long").groupBy("gram").agg(F.sum("c").alias("c"))


def _discounts(table: DataFrame) -> tuple[float, float, float]:
    """The three discounts of an order from its counts of counts."""
    n = table.agg(*(F.count_if(F.col("c") == i).alias(f"n{i}") for i in range(1, 5))).first()
    n1, n2, n3, n4 = (max(1, n[i] or 0) for i in range(4))
    y = n1 / (n1 + 2 * n2)
    return tuple(min(float(i), max(0.1, i - (i + 1) * y * b / a)) for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))


def train(texts: DataFrame) -> tuple[list[DataFrame], float]:
    """``(orders, unseen)``: for each order from 1 ``(gram, p, bow)``, and the probability of a character never seen.

    ``p``: the interpolated probability of the n-gram's last character, null
    where the n-gram is only a context; ``bow``: the weight of shorter contexts
    behind it, 1 where nothing follows it. Null and empty texts add nothing;
    without any text there are no n-grams and ``unseen`` is 1.
    """
    table, levels = written(counts(texts), "counts"), []
    for n in range(ORDER, 0, -1):
        d = _discounts(table)
        cut = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        rows = table.select("gram", "c", F.substring("gram", 1, n - 1).alias("context"), F.substring("gram", 2, n - 1).alias("suffix"), cut.alias("cut"))
        sums = written(rows.groupBy("context").agg(F.sum("c").alias("all"), F.sum("cut").alias("free")).select("context", "all", (F.col("free") / F.col("all")).alias("g")), "contexts")
        levels.append((rows, sums))
        if n > 1:  # continuation counts: in how many different n-grams this shorter one is the end
            table = written(rows.groupBy(F.col("suffix").alias("gram")).agg(F.count("*").alias("c")), "counts")
    letters = levels[-1][0].count()
    base = levels[-1][1].first()
    unseen = (base["g"] if base else 1.0) / (letters + 1)
    orders, below = [], None
    for n, (rows, sums) in enumerate(reversed(levels), 1):
        joined = rows.join(sums, "context")
        p = (F.col("c") - F.col("cut")) / F.col("all")
        if n == 1:
            seen = joined.select("gram", (p + unseen).alias("p"))
        else:
            seen = joined.join(below.select(F.col("gram").alias("suffix"), F.col("p").alias("low")), "suffix").select("gram", (p + F.col("g") * F.col("low")).alias("p"))
        below = written(seen, "seen")
        if n < ORDER:
            after = levels[ORDER - 1 - n][1].select(F.col("context").alias("gram"), "g")
            orders.append(written(below.join(after, "gram", "full").select("gram", "p", F.coalesce("g", F.lit(1.0)).alias("bow")), "order"))
        else:
            orders.append(below.withColumn("bow", F.lit(1.0)))
    return orders, unseen


def hashed(order: DataFrame, k: int) -> DataFrame:
    """``(h, lp, bow)`` of an order: the n-grams' hashes, and logarithms to the base 2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = np.frombuffer("".join(batch.column("gram").to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, k).astype(U)
            yield pa.RecordBatch.from_arrays([pa.array(gram_hash(points.T).view(np.int64)), batch.column("p"), batch.column("bow")], names=["h", "p", "bow"])

    return order.mapInArrow(run, "h long, p double, bow double").select("h", F.log2("p").cast("float").alias("lp"), F.log2("bow").cast("float").alias("bow"))


class Model:
    """The n-grams of each order, sorted by hash."""

    def __init__(self, orders: list[DataFrame], unseen: float):
        self.unseen = float(np.log2(unseen))
        self.tables = []
        for k, order in enumerate(orders, 1):
            t = hashed(order, k).toArrow()
            h = t.column("h").to_numpy().view(U)
            by = np.argsort(h)
            self.tables.append((h[by], t.column("lp").to_numpy(zero_copy_only=False).astype(np.float32)[by], t.column("bow").to_numpy()[by]))

    def find(self, k: int, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = self.tables[k - 1][0]
        at = np.minimum(np.searchsorted(own, h), max(0, len(own) - 1))
        return at, (own[at] == h) if len(own) else np.zeros(len(h), bool)

    def logs(self, chars: Chars, at: np.ndarray, k: int = ORDER, h: np.ndarray | None = None) -> np.ndarray:
        """The log2 probability of the character at each place after the ``k - 1`` before it."""
        if k == 0 or not len(at):
            return np.full(len(at), self.unseen)
        where, seen = self.find(k, chars.grams(k, at) if h is None else h)
        seen &= ~np.isnan(self.tables[k - 1][1][where]) if len(self.tables[k - 1][0]) else seen
        out = np.zeros(len(at))
        out[seen] = self.tables[k - 1][1][where[seen]]
        rest = at[~seen]
        lower = self.logs(chars, rest, k - 1)
        if k > 1:
            where, had = self.find(k - 1, chars.grams(k - 1, rest - 1))
            lower[had] += self.tables[k - 2][2][where[had]]
        out[~seen] = lower
        return out


def perplexities(docs: DataFrame, orders: list[DataFrame], unseen: float, model_rows: int = MODEL_ROWS) -> DataFrame:
    """``docs`` with ``n`` characters and their ``bits``, the negative log2 probability of the whole text."""
    if sum(o.count() for o in orders) > model_rows:
        return _joined(docs, orders, unseen)
    shared = docs.sparkSession.sparkContext.broadcast(Model(orders, unseen))

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        size, bits = [np.zeros(0)], [np.zeros(0)]
        for piece in pieces(batch, limit=PIECE):
            chars = Chars(piece.column("text"))
            h, first, which = np.unique(chars.grams(ORDER, chars.at), return_index=True, return_inverse=True)
            logs = shared.value.logs(chars, chars.at[first], h=h)
            size.append(chars.size)
            bits.append(-np.bincount(chars.owner, logs[which], piece.num_rows) + 0.0)
        return [pa.array(np.concatenate(size).astype(np.int64)), pa.array(np.concatenate(bits))]

    return adding(docs, [StructField("n", LongType()), StructField("bits", DoubleType())], make)


def _joined(docs: DataFrame, orders: list[DataFrame], unseen: float) -> DataFrame:
    """:func:`perplexities` for a model of any size: what documents and model hold meets by shards of the n-gram."""
    entries, below = [], None
    for k, order in enumerate(orders, 1):
        seen = order.where("p is not null").select("gram", F.log2("p").alias("lp"))
        if k == 1:
            own = seen.select("gram", (F.col("lp") - F.lit(float(np.log2(unseen)))).alias("value"))
        else:  # above what the shorter n-gram would give
            bow = orders[k - 2].select(F.col("gram").alias("c"), F.log2("bow").alias("bow"))
            low = below.select(F.col("gram").alias("s"), F.col("lp").alias("low"))
            both = seen.join(low, F.substring("gram", 2, k - 1) == F.col("s")).join(bow, F.substring("gram", 1, k - 1) == F.col("c"))
            own = both.select("gram", (F.col("lp") - F.col("bow") - F.col("low")).alias("value"))
            entries.append(bow.where("bow <> 0").select(F.lit(-(k - 1)).alias("kind"), F.col("c").alias("gram"), F.col("bow").alias("value")))
        entries.append(own.select(F.lit(k).alias("kind"), "gram", "value"))
        below = seen
    model = reduce(DataFrame.unionByName, entries)
    # ids of rows that hold however often they are computed: they are written first
    rows = written(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                chars, ids = Chars(piece.column("text")), piece.column("__row").to_numpy()
                for kind in [*range(1, ORDER + 1), *range(1 - ORDER, 0)]:
                    k, at = abs(kind), chars.at - (kind < 0)
                    key = gram_hash([chars.grams(k, at), chars.owner.astype(U)])
                    _, first, c = np.unique(key, return_index=True, return_counts=True)
                    points = np.stack([chars.points[at[first] - k + i] for i in range(1, k + 1)], axis=1).astype(np.uint32)
                    # whole strings, for numpy would cut edge signs from the end
                    text = points.tobytes().decode("utf-32-le", "surrogatepass")
                    grams = [text[i : i + k] for i in range(0, len(text), k)]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[chars.owner[first]]), pa.array([kind] * len(first), pa.int32()), pa.array(grams, pa.string()), pa.array(c)], names=["__row", "kind", "gram", "c"])

    found = rows.select("__row", "text").mapInArrow(run, "__row long, kind int, gram string, c long").join(model, ["kind", "gram"])
    sums = found.groupBy("__row").agg(F.sum(F.col("c") * F.col("value")).alias("logs"))

    def sizes(batch: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array(np.concatenate([Chars(p.column("text")).size for p in pieces(batch)]).astype(np.int64))]

    sized = adding(rows, [StructField("n", LongType())], sizes).join(sums, "__row", "left").drop("__row")
    return sized.withColumn("bits", -F.coalesce("logs", F.lit(0.0)) - F.col("n") * F.lit(float(np.log2(unseen)))).drop("logs")


def trusted_texts(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """The texts of ``docs`` whose id is in ``trusted(doc_id)``."""
    ids = trusted.limit(BROADCAST_IDS + 1).count()
    own = docs.select("doc_id", "text")
    return own.join(F.broadcast(trusted) if ids <= BROADCAST_IDS else trusted, "doc_id", "left_semi").select("text")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, lang, n_chars, perplexity, score, threshold, keep)`` of every row of ``docs(doc_id, text, lang)``.

    Trusted are ids with a label of quality 1 and toxic 0 and no other label;
    one in ``FOLDS`` of them is left out of the model and sets the thresholds.
    Texts without characters have perplexity 1 and stay, there being nothing
    against them. A null language is one of its own. Without held-out trusted
    text every threshold is null and every row stays. Equal rows are treated
    alike, an empty table gives no rows, and other columns are not read.
    """
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    good = (F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)
    trusted = labels.where("doc_id is not null").groupBy("doc_id").agg(F.bool_and(F.coalesce(good, F.lit(False))).alias("good")).where("good").select("doc_id")
    trusted = written(trusted.withColumn("held", F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)) == 0), "trusted")
    held = trusted.where("held").select("doc_id")
    orders, unseen = train(trusted_texts(docs, trusted.where("not held").select("doc_id")))
    scored = written(perplexities(docs, orders, unseen).drop("text"), "scored")
    own = scored.join(held, "doc_id", "left_semi").where("n > 0")
    by = own.groupBy("lang").agg((F.sum("bits") / F.sum("n")).alias("mean"), F.count("*").alias("c"))
    all_mean = own.agg((F.sum("bits") / F.sum("n")).alias("m"))
    overall = all_mean.first()[0]
    langs = written(by, "langs").withColumnRenamed("lang", "l")
    joined = scored.join(langs, F.col("lang").eqNullSafe(F.col("l")), "left")
    mean = F.when(F.col("c") >= LEAST, F.col("mean")).otherwise(F.lit(overall).cast("double"))
    score = F.when(F.col("n") > 0, (F.col("bits") + PRIOR * mean) / (F.col("n") + PRIOR))
    rated = written(joined.select("doc_id", "lang", "n", "bits", F.when(F.col("c") >= LEAST, F.struct("lang")).alias("own"), score.alias("score")), "rated")
    # exact quantiles over steps of the score: the number of steps does not grow with the corpus
    steps = rated.join(held, "doc_id", "left_semi").where("score is not null").select("own", F.floor(F.col("score") / STEP).alias("step"))
    steps = steps.unionAll(steps.where("own is not null").select(F.lit(None).alias("own"), "step")).groupBy("own", "step").count()
    part = W.partitionBy("own")
    reached = steps.withColumn("share", F.sum("count").over(part.orderBy("step")) / F.sum("count").over(part))
    limits = reached.where(F.col("share") >= QUANTILE).groupBy("own").agg(((F.min("step") + 1) * STEP).alias("threshold")).withColumnRenamed("own", "o")
    done = rated.join(limits, F.col("own").eqNullSafe(F.col("o")), "left")
    keep = F.coalesce(F.col("score") <= F.col("threshold"), F.lit(True))
    perplexity = F.pow(F.lit(2.0), F.when(F.col("n") > 0, F.col("bits") / F.col("n")).otherwise(0.0))
    return done.select("doc_id", "lang", F.col("n").alias("n_chars"), perplexity.alias("perplexity"), "score", "threshold", keep.alias("keep"))
