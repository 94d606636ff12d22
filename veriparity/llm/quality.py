"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model.

The model is one of character n-grams, trained on the whole text of every row
that is labelled as trusted, so its counts grow with the input.  Counts, counts of
counts, contexts and probabilities are grouped and joined by n-gram.  A row's
score is its mean negative log probability per character; rows of a language whose
score lies above a quantile of that language's trusted rows, and a slack, are
rejected.  The slack (in nats per character) makes up for the model having seen the
trusted rows, which lowers their scores, the more the smaller the corpus.  Scores
of short texts are drawn towards the mean of their language, as few characters
say little.

Probabilities reach the documents in one of two ways with equal results: while
the model has at most ``broadcast_entries`` entries it is broadcast and looked up
in place; beyond that the documents' n-grams are joined with it, shard by shard.

An n-gram is ``ORDER`` symbols of 12 bits.  Code points below 3072 are symbols of
their own, others share the rest.

Cases: a null or empty text has the score of its language's mean; a null or
untrained language takes the threshold of all trusted rows together; without
trusted rows everything is kept; repeated rows score alike; an empty table gives
an empty table; ``classify`` ignores other columns, ``keep_good`` carries them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veriparity.llm.common import mixed, slices, texts_of
from veriparity.session import cut_lineage

ORDER = 5
BITS = 12
SYMBOLS = 1 << BITS
OWN = 3072
CELL = 1e-3  # width of the score cells in which quantiles are counted
FEW_LANGUAGES = 10_000  # a table with a row per language is broadcast up to that size


@dataclass(frozen=True)
class Settings:
    quantile: float = 0.998
    slack: float = 0.12
    prior_chars: float = 60.0
    broadcast_entries: int = 8_000_000


def symbols(texts: list[str], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts, each behind ``order - 1`` zeros, and the lengths of the texts."""
    lengths = np.array([len(x) for x in texts], np.int64)
    pad = "\0" * (order - 1)
    cp = np.frombuffer((pad + pad.join(texts)).encode("utf-32-le"), np.uint32) if texts else np.zeros(0, np.uint32)
    return np.where(cp < OWN, cp, OWN + cp % (SYMBOLS - OWN)).astype(np.int64), lengths


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that ends at each character, and the number of the text it belongs to."""
    s, lengths = symbols(texts)
    key = np.zeros(max(0, len(s) - ORDER + 1), np.int64)
    for i in range(ORDER):
        key |= s[i : i + len(key)] << (BITS * (ORDER - 1 - i))
    starts = np.cumsum(lengths + ORDER - 1) - lengths - (ORDER - 1)
    doc = np.repeat(np.arange(len(texts)), lengths)
    within = np.arange(len(doc)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return key[starts[doc] + within], doc


def top_counts(trusted: DataFrame) -> DataFrame:
    """(key, c): how often each n-gram of the full order occurs."""

    def run(batches):
        held, n = [], 0
        for part in slices(batches):
            held.append(np.unique(grams(part["text"].to_pylist())[0], return_counts=True))
            n += len(held[-1][0])
            if n > 2_000_000:  # merge what has gathered, and send it on if that doesn't shrink it
                held = [merged(held)]
                n = len(held[0][0])
                if n > 1_000_000:
                    yield record(held.pop())
                    n = 0
        if held:
            yield record(merged(held))

    def merged(held):
        keys, back = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
        return keys, np.bincount(back, np.concatenate([c for _, c in held]), len(keys)).astype(np.int64)

    def record(counted):
        return pa.RecordBatch.from_arrays([pa.array(x) for x in counted], names=["key", "c"])

    return trusted.select("text").mapInArrow(run, "key long, c long").groupBy("key").agg(F.sum("c").alias("c"))


def count_tables(top: DataFrame) -> DataFrame:
    """(k, key, c) for all orders: occurrences at the full order, distinct left neighbours below it."""
    level = top.select(F.lit(ORDER).alias("k"), "key", "c")
    every = level
    for k in range(ORDER - 1, 0, -1):
        level = (
            level.groupBy(F.col("key").bitwiseAND(F.lit((1 << BITS * k) - 1)).alias("key"))
            .agg(F.count(F.lit(1)).alias("c")).select(F.lit(k).alias("k"), "key", "c")
        )
        every = every.unionByName(level)
    return every


def discounts(counts: DataFrame) -> dict[int, tuple[float, float, float]]:
    """Modified Kneser-Ney discounts of counts 1, 2 and 3 or more, by order."""
    rows = counts.where("c <= 4").groupBy("k", "c").count().collect()  # at most four per order
    of = {(r["k"], r["c"]): r["count"] for r in rows}
    out = {}
    for k in range(1, ORDER + 1):
        n1, n2, n3, n4 = (of.get((k, c), 0) for c in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 else 0.0
        plain = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 0.75, 3 - 4 * y * n4 / n3 if n3 else 0.75]
        out[k] = tuple(min(max(d, 0.05), c - 0.05) for d, c in zip(plain, (1, 2, 3), strict=True))
    return out


def model_of(trusted: DataFrame) -> DataFrame:
    """(k, key, logp, gamma): log probability of each n-gram, and the log weight that it leaves, as a context, to lower orders.

    ``logp`` is null for contexts that are no n-grams themselves, ``gamma`` for n-grams that are no contexts.
    The empty context is order 0, key 0.
    """
    counts = cut_lineage(count_tables(cut_lineage(top_counts(trusted))))
    d = discounts(counts)
    by_k = lambda pick: F.element_at(F.create_map(*[F.lit(x) for k in d for x in (k, pick(d[k]))]), F.col("k"))
    cut = F.when(F.col("c") == 1, by_k(lambda x: x[0])).when(F.col("c") == 2, by_k(lambda x: x[1])).otherwise(by_k(lambda x: x[2]))
    counts = counts.select("k", "key", "c", F.shiftright("key", BITS).alias("context"), cut.alias("d"))
    contexts = counts.groupBy("k", "context").agg(F.sum("c").alias("total"), F.sum("d").alias("left"))
    contexts = cut_lineage(contexts.select("k", "context", "total", (F.col("left") / F.col("total")).alias("g")))
    shares = counts.join(contexts, ["k", "context"]).select(
        "k", "key", ((F.col("c") - F.col("d")) / F.col("total")).alias("a"), "g"
    )
    shares = cut_lineage(shares)
    level = shares.where("k = 1").select("k", "key", (F.col("a") + F.col("g") / SYMBOLS).alias("p"))
    every = level
    for k in range(2, ORDER + 1):
        lower = level.select(F.col("key").alias("suffix"), F.col("p").alias("q"))
        level = (
            shares.where(F.col("k") == k).withColumn("suffix", F.col("key").bitwiseAND(F.lit((1 << BITS * (k - 1)) - 1)))
            .join(lower, "suffix").select("k", "key", (F.col("a") + F.col("g") * F.col("q")).alias("p"))
        )
        every = every.unionByName(level)
    left = contexts.select((F.col("k") - 1).alias("k"), F.col("context").alias("key"), F.log("g").alias("gamma"))
    both = every.select("k", "key", F.log("p").alias("logp")).join(left, ["k", "key"], "full")
    # single precision, which is what the tables in memory hold, so that scores are the same with and without them
    return cut_lineage(both.select("k", "key", F.col("logp").cast("float").alias("logp"), F.col("gamma").cast("float").alias("gamma")))


class Table:
    """Open-addressing table of 64-bit keys with one float each."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, missing: float):
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 2))))
        self.shift, self.mask, self.missing = np.uint64(64 - bits), (1 << bits) - 1, missing
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.float32)
        rest, at = np.arange(len(keys)), self.place(keys)
        while len(rest):
            free = self.keys[at] < 0
            _, one = np.unique(at[free], return_index=True)  # one key may take a free place
            take = np.flatnonzero(free)[one]
            self.keys[at[take]], self.values[at[take]] = keys[rest[take]], values[rest[take]]
            stay = np.ones(len(rest), bool)
            stay[take] = False
            rest, at = rest[stay], at[stay]
            moved = self.keys[at] >= 0
            at[moved] = (at[moved] + 1) & self.mask

    def place(self, keys: np.ndarray) -> np.ndarray:
        return (mixed(keys.view(np.uint64)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        values, found = np.full(len(keys), self.missing, np.float32), np.zeros(len(keys), bool)
        rest, at = np.arange(len(keys)), self.place(keys)
        while len(rest):
            held = self.keys[at]
            hit = held == keys[rest]
            values[rest[hit]], found[rest[hit]] = self.values[at[hit]], True
            go = ~hit & (held >= 0)
            rest, at = rest[go], (at[go] + 1) & self.mask
        return values, found


class Model:
    """The model as arrays: log probabilities by order, and the weights left to lower orders."""

    def __init__(self, entries: pa.Table):
        k, key = entries["k"].to_numpy(), entries["key"].to_numpy()
        logp, gamma = (entries[c].to_numpy().astype(float) for c in ("logp", "gamma"))
        self.logp, self.gamma = {}, {}
        for order in range(ORDER + 1):
            for to, values, missing in ((self.logp, logp, -np.inf), (self.gamma, gamma, 0.0)):
                mine = (k == order) & ~np.isnan(values)
                to[order] = Table(key[mine], values[mine], missing)
        self.unseen = float(self.gamma[0].find(np.zeros(1, np.int64))[0][0]) - np.log(SYMBOLS)

    def log_probabilities(self, key: np.ndarray) -> np.ndarray:
        out = np.zeros(len(key))
        rest = np.arange(len(key))
        for k in range(ORDER, 0, -1):
            mine = key[rest] & ((1 << BITS * k) - 1)
            value, found = self.logp[k].find(mine)
            out[rest[found]] += value[found]
            rest, mine = rest[~found], mine[~found]
            if k > 1:
                out[rest] += self.gamma[k - 1].find(mine >> BITS)[0]
        out[rest] += self.unseen
        return out


SCORED = "doc_id long, lang string, n_chars long, nll double"


def score_in_place(docs: DataFrame, entries: DataFrame) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(entries.toArrow().combine_chunks())

    def run(batches):
        model = Model(sent.value)
        for part in slices(batches):
            texts = part["text"].to_pylist()
            key, doc = grams(texts)
            nll = np.bincount(doc, -model.log_probabilities(key), len(texts))
            yield pa.RecordBatch.from_arrays(
                [part["doc_id"], part["lang"], pa.array([len(x) for x in texts], pa.int64()), pa.array(nll)],
                names=["doc_id", "lang", "n_chars", "nll"],
            )

    return docs.select("doc_id", "lang", "text").mapInArrow(run, SCORED)


def score_by_joins(docs: DataFrame, entries: DataFrame) -> DataFrame:
    """The same scores without a broadcast: distinct n-grams of each row, joined order by order."""

    def run(batches):
        for part in slices(batches):
            texts = part["text"].to_pylist()
            key, doc = grams(texts)
            pairs, n = np.unique(np.stack([doc, key]), axis=1, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [part["row"].take(pa.array(pairs[0])), pa.array(pairs[1]), pa.array(n)], names=["row", "key", "n"]
            )

    rows = cut_lineage(docs.select("doc_id", "lang", "text").withColumn("row", F.monotonically_increasing_id()))
    left = rows.select("row", "text").mapInArrow(run, "row long, key long, n long").withColumn("add", F.lit(0.0))
    done = None
    for k in range(ORDER, 0, -1):
        own = entries.where((F.col("k") == k) & F.col("logp").isNotNull()).select("key", "logp")
        tried = left.withColumn("key", F.col("key").bitwiseAND(F.lit((1 << BITS * k) - 1))).join(own, "key", "left")
        hit = tried.where("logp IS NOT NULL").select("row", (F.col("n") * (F.col("add") + F.col("logp"))).alias("ll"))
        done = hit if done is None else done.unionByName(hit)
        left = tried.where("logp IS NULL").drop("logp")
        above = entries.where((F.col("k") == k - 1) & F.col("gamma").isNotNull()).select(F.col("key").alias("context"), "gamma")
        left = left.withColumn("context", F.shiftright("key", BITS)).join(above, "context", "left").select(
            "row", "key", "n", (F.col("add") + F.coalesce("gamma", F.lit(0.0))).alias("add")
        )
    done = done.unionByName(left.select("row", (F.col("n") * (F.col("add") - float(np.log(SYMBOLS)))).alias("ll")))
    sums = done.groupBy("row").agg((-F.sum("ll")).alias("nll"))
    return rows.join(sums, "row", "left").select(
        "doc_id", "lang", F.char_length("text").cast("long").alias("n_chars"), F.coalesce("nll", F.lit(0.0)).alias("nll")
    )


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids that some label calls good."""
    return labels.where("quality = 1").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()


def classify(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``doc_id``, ``n_chars``, ``perplexity`` per character, the language's ``threshold`` and ``kept`` of every row."""
    rows = texts_of(docs, F.coalesce("lang", F.lit("")).alias("lang"))
    good = trusted_ids(labels)
    # only the ids need a place in memory; texts are not sorted for the join
    entries = model_of(rows.join(good.hint("shuffle_hash"), "doc_id", "left_semi"))
    n = entries.count()
    if n == 0:
        unknown = F.lit(None).cast("double")
        return rows.select(
            "doc_id", F.char_length("text").cast("long").alias("n_chars"), unknown.alias("perplexity"),
            unknown.alias("threshold"), F.lit(True).alias("kept"),
        )
    scored = (score_in_place if n <= settings.broadcast_entries else score_by_joins)(rows, entries)
    marks = good.withColumn("trusted", F.lit(True))
    scored = cut_lineage(scored.join(marks, "doc_id", "left").withColumn("trusted", F.coalesce("trusted", F.lit(False))))
    trusted = scored.where("trusted AND n_chars > 0")
    # one row per language; a language and a cell of scores can be hot, both are summed before they meet
    means = cut_lineage(trusted.groupBy("lang").agg((F.sum("nll") / F.sum("n_chars")).alias("mean")))
    few = F.broadcast if means.count() <= FEW_LANGUAGES else lambda rows: rows
    overall = trusted.agg((F.sum("nll") / F.sum("n_chars")).alias("m")).first()["m"]
    shrunk = (F.col("nll") + settings.prior_chars * F.coalesce("mean", F.lit(overall or 0.0))) / (F.col("n_chars") + settings.prior_chars)
    scored = scored.join(few(means), "lang", "left").withColumn("score", shrunk).drop("mean")
    cells = scored.where("trusted AND n_chars > 0").groupBy("lang", F.ceil(F.col("score") / CELL).alias("cell")).count()
    together = cells.groupBy(F.lit(None).cast("string").alias("lang"), "cell").agg(F.sum("count").alias("count"))
    limits = cut_lineage(quantile_cells(cells.unionByName(together), settings.quantile))
    any_limit = limits.where("lang IS NULL").first()
    limit = F.coalesce("limit", F.lit(any_limit["limit"] if any_limit else float("inf"))) + settings.slack
    return (
        scored.join(few(limits.where("lang IS NOT NULL")), "lang", "left")
        .select("doc_id", "n_chars", F.exp("score").alias("perplexity"), F.exp(limit).alias("threshold"),
                (F.col("score") <= limit).alias("kept"))
    )


def quantile_cells(cells: DataFrame, quantile: float) -> DataFrame:
    """Upper border of the cell that holds the quantile, by language.  Cells are few: a range of scores over CELL."""
    by = Window.partitionBy("lang")
    upto = F.sum("count").over(by.orderBy("cell").rowsBetween(Window.unboundedPreceding, 0))
    ranked = cells.withColumn("upto", upto).withColumn("total", F.sum("count").over(by))
    return ranked.where(F.col("upto") >= quantile * F.col("total")).groupBy("lang").agg((F.min("cell") * CELL).alias("limit"))


def keep_good(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows of ``docs`` that ``classify`` keeps, with all their columns.

    The decision belongs to a doc_id: if rows share one, they stay if any of them does.  Rows without one stay.
    """
    verdict = classify(docs, labels, settings).groupBy("doc_id").agg(F.max("kept").alias("kept"))
    bad = verdict.where(~F.col("kept")).select("doc_id")
    return docs.join(bad, "doc_id", "left_anti")
