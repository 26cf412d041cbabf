"""A quality filter: perplexity under an interpolated modified Kneser-Ney model of trusted text.

The units are characters and the order is four. Counts of trusted text, and every
four-gram that any document holds, come out of one pass; discounts, interpolation
weights and probabilities are joins of count tables dealt by language and gram.
Documents are then scored, as a whole and at their worst window of a few characters, in
which a single bad word shows. Each language's thresholds are quantiles of its trusted documents' scores.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from vgraph.llm.arrays import chunks, lean, row_of, runs, utf8
from vgraph.plans.workspace import materialize

ORDER = 4
#: Characters of a window; about a word.
WINDOW = 8
#: Bytes of text that a task scores at a time, and places of a table of pairs of pairs.
CHUNK, PLACES = 512 << 10, 4_000_000
#: The least discount; without one a text unlike any would have the probability 0.
FLOOR = 0.05
#: Code units that stand for the start and the end of a text and for characters beyond 16 bits.
START, END, WIDE = 1, 2, 0xFFFD
#: Scored grams up to which the table of scores is sent to all tasks; beyond, documents' grams are joined with it.
SENT = 2_000_000
#: Languages up to which their discounts are sent to all tasks.
LANGUAGES = 10_000
_SCORES = ["__kn_mean", "__kn_worst"]
_ADDED = ["trusted", "perplexity", "threshold", "worst_perplexity", "worst_threshold", "kept"]
_GRAMS = "lang string, gram long, trusted long, hits long"


def grams(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(grams, row): for each character of a text and its end the four units up to it, 16 bits each."""
    data, offsets = utf8(batch.column("text"))
    units = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    lead = row_of(offsets)[(data & 0xC0) != 0x80] if len(data) else np.zeros(0, np.int64)
    count = np.bincount(lead, minlength=batch.num_rows)
    size = count + ORDER
    begin = np.cumsum(size) - size
    text = np.full(int(size.sum()), START, np.uint16)
    text[np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(len(units)) + ORDER - 1] = np.where(units > 0xFFFF, WIDE, units)
    text[begin + size - 1] = END
    wide = text.astype(np.int64)
    pair = (wide[:-1] << 16) | wide[1:]
    gram = (pair[:-2] << 32) | pair[2:]
    row = np.repeat(np.arange(batch.num_rows), size)
    keep = row[: len(gram)] == row[ORDER - 1 :]
    return gram[keep], row[: len(gram)][keep]


class Local:
    """Dense codes of the grams of a chunk: characters, then pairs, then pairs of pairs."""

    def __init__(self, gram: np.ndarray):
        self.pairs, code = np.unique(np.concatenate([gram >> 32 & 0xFFFFFFFF, gram & 0xFFFFFFFF]), return_inverse=True) if len(gram) < 1000 else _by_table(gram)
        self.n = len(self.pairs)
        self.code = code[: len(gram)].astype(np.int64) * self.n + code[len(gram) :]
        if self.n**2 <= PLACES:
            seen = np.zeros(self.n**2, bool)
            seen[self.code] = True
            self.distinct = np.flatnonzero(seen)
            place = np.zeros(self.n**2, np.int32)
            place[self.distinct] = np.arange(len(self.distinct))
            self.place = place[self.code]
        else:
            self.distinct, self.place = np.unique(self.code, return_inverse=True)
        self.gram = (self.pairs[self.distinct // max(self.n, 1)] << 32) | self.pairs[self.distinct % max(self.n, 1)]


def _by_table(gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.unique of the leading and trailing pairs, by way of the chunk's own alphabet."""
    units = [(gram >> s & 0xFFFF) for s in (48, 32, 16, 0)]
    seen = np.zeros(1 << 16, bool)
    for x in units:
        seen[x] = True
    letters = np.flatnonzero(seen)
    if len(letters) > 4000:
        return np.unique(np.concatenate([gram >> 32 & 0xFFFFFFFF, gram & 0xFFFFFFFF]), return_inverse=True)
    code = np.zeros(1 << 16, np.int64)
    code[letters] = np.arange(len(letters))
    n = len(letters)
    pair = np.concatenate([code[units[0]] * n + code[units[1]], code[units[2]] * n + code[units[3]]])
    held = np.zeros(n * n, bool)
    held[pair] = True
    found = np.flatnonzero(held)
    place = np.zeros(n * n, np.int32)
    place[found] = np.arange(len(found))
    return (letters[found // n] << 16) | letters[found % n], place[pair]


def _language() -> Column:
    """A language's name in tables: none for null, which is not the language of an empty name."""
    return F.coalesce(F.concat(F.lit("="), "lang"), F.lit(""))


def _languages(batch: pa.RecordBatch) -> tuple[list[str], np.ndarray]:
    names = np.array(["" if x is None else f"={x}" for x in batch.column("lang").to_pylist()], object)
    return np.unique(names.astype(str), return_inverse=True) if len(names) else ([], np.zeros(0, int))


@lean
def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each chunk's distinct grams by language, with their numbers in trusted texts and in all."""
    for batch in chunks(batches, most=CHUNK):
        langs, of = _languages(batch)
        trusted = np.asarray(batch.column("trusted").to_numpy(zero_copy_only=False), bool)
        gram, row = grams(batch)
        for k, lang in enumerate(langs):
            mine = of[row] == k
            local = Local(gram[mine])
            good = np.bincount(local.place[trusted[row[mine]]], minlength=len(local.gram))
            hits = np.bincount(local.place, minlength=len(local.gram))
            yield pa.RecordBatch.from_pydict({"lang": pa.array([str(lang)] * len(local.gram), pa.string()), "gram": pa.array(local.gram), "trusted": pa.array(good), "hits": pa.array(hits)})


def _sums(score: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(mean, least mean of a window) of the scores of each of n rows; a row shorter than a window is one."""
    size = np.bincount(row, minlength=n)
    mean = np.bincount(row, score, n) / np.maximum(size, 1)
    worst = mean.copy()
    many = max(len(score) - WINDOW + 1, 0)
    window = np.zeros(many)
    for j in range(WINDOW):
        window += score[j : j + many]
    inside = np.flatnonzero(row[:many] == row[WINDOW - 1 : WINDOW - 1 + many])
    if len(inside):
        first = runs(row[inside])
        worst[row[inside][first]] = np.minimum.reduceat(window[inside], first) / WINDOW
    return mean, worst


def _score(table: dict[str, tuple[np.ndarray, np.ndarray]]):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, most=CHUNK):
            langs, of = _languages(batch)
            gram, row = grams(batch)
            score = np.zeros(len(gram))
            for k, lang in enumerate(langs):
                mine = of[row] == k
                local = Local(gram[mine])
                known, found = table[str(lang)]
                score[mine] = found[np.searchsorted(known, local.gram)][local.place]
            mean, worst = _sums(score, row, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(mean), pa.array(worst)], names=[*batch.schema.names, *_SCORES])

    return run


def model(counts: DataFrame) -> DataFrame:
    """(lang, gram, score): the log-probability of each gram's last unit after the others.

    ``counts`` has (lang, gram, trusted). Orders below the highest count in how many distinct
    longer grams a gram ends; all orders have the three discounts of Chen and Goodman.
    """
    levels = {ORDER: counts.where("trusted > 0").select("lang", "gram", F.col("trusted").alias("c"))}
    for k in range(ORDER - 1, 0, -1):
        ends = F.col("gram").bitwiseAND((1 << 16 * k) - 1)
        levels[k] = levels[k + 1].groupBy("lang", ends.alias("gram")).agg(F.count("*").alias("c"))
        levels[k] = materialize(levels[k], "level")
    units = levels[1].groupBy("lang").agg((F.count("*") + 1).alias("units"))
    # a row for each language: sent to all tasks unless there are very many
    sent = F.broadcast if units.count() <= LANGUAGES else lambda df: df
    asked = counts.select("lang", "gram").join(sent(units), "lang", "left").withColumn("p", 1 / F.coalesce("units", F.lit(1 << 16))).drop("units")
    for k in range(1, ORDER + 1):
        n = [F.count_if(F.col("c") == i).alias(f"n{i}") for i in (1, 2, 3, 4)]
        y = F.expr("try_divide(n1, n1 + 2 * n2)")
        found = [F.least(F.lit(float(i)), F.greatest(F.lit(FLOOR), F.coalesce(i - (i + 1) * y * F.expr(f"try_divide(n{i + 1}, n{i})"), F.lit(0.5 * i)))) for i in (1, 2, 3)]
        cuts = levels[k].groupBy("lang").agg(*n).select("lang", *(d.alias(f"d{i + 1}") for i, d in enumerate(found)))
        cut = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        level = levels[k].join(sent(cuts), "lang").select("lang", "gram", "c", cut.alias("cut"))
        context = F.shiftrightunsigned("gram", 16).alias("context") if k > 1 else F.lit(0).cast("long").alias("context")
        sums = level.groupBy("lang", context).agg(F.sum("c").alias("all"), F.sum("cut").alias("left"))
        mask = (1 << 16 * k) - 1 if k < 4 else -1
        own = F.col("gram").bitwiseAND(F.lit(mask))
        asked = asked.withColumn("part", own).withColumn("context", F.shiftrightunsigned("part", 16) if k > 1 else F.lit(0).cast("long"))
        asked = asked.join(level.select("lang", F.col("gram").alias("part"), (F.col("c") - F.col("cut")).alias("rest")), ["lang", "part"], "left").join(sums, ["lang", "context"], "left")
        p = F.when(F.col("all").isNull(), F.col("p")).otherwise((F.coalesce("rest", F.lit(0.0)) + F.col("left") * F.col("p")) / F.col("all"))
        asked = asked.select("lang", "gram", p.alias("p"))
    return asked.select("lang", "gram", F.log("p").alias("score"))


def scorer(docs: DataFrame, trusted_ids: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """The rows of ``docs`` (doc_id, text, lang, more) with ``trusted``, and what adds ``perplexity`` and ``worst_perplexity`` to any of them."""
    spark = docs.sparkSession
    docs = docs.select([docs[c] for c in docs.columns if c not in _ADDED])
    ids = trusted_ids.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct().withColumn("trusted", F.lit(True))
    ids = materialize(ids, "trusted")
    if ids.count() <= SENT:
        ids = F.broadcast(ids)
    docs = docs.withColumns({"doc_id": F.col("doc_id").cast("long"), "text": F.col("text").cast("string"), "lang": F.col("lang").cast("string")})
    names = [*docs.columns, "trusted"]
    docs = docs.join(ids, "doc_id", "left").withColumn("trusted", F.coalesce("trusted", F.lit(False))).select(names)
    counts = docs.select("text", "lang", "trusted").mapInArrow(_count, _GRAMS).groupBy("lang", "gram").agg(F.sum("trusted").alias("trusted"))
    scores = materialize(model(materialize(counts, "counts")), "scores")
    if scores.count() <= SENT:
        table = {}
        rows = scores.toArrow()
        lang, gram, score = (rows.column(i).combine_chunks() for i in range(3))
        lang = np.asarray(lang.to_pylist(), str)
        gram, score = gram.to_numpy(), score.to_numpy()
        for x in np.unique(lang):
            mine = np.flatnonzero(lang == x)
            mine = mine[np.argsort(gram[mine])]
            table[str(x)] = gram[mine], score[mine]
        sent = spark.sparkContext.broadcast(table)
        kinds = StructType([*docs.schema, *(StructField(c, DoubleType()) for c in _SCORES)])
        scored = lambda df: df.mapInArrow(lambda batches: _score(sent.value)(batches), kinds)
    else:
        scored = lambda df: _by_join(df, scores)
    text = F.length("text") > 0
    return docs, lambda df: scored(df).select(*names, F.when(text, F.exp(-F.col(_SCORES[0]))).alias("perplexity"), F.when(text, F.exp(-F.col(_SCORES[1]))).alias("worst_perplexity"))


def _by_join(docs: DataFrame, scores: DataFrame) -> DataFrame:
    """The scores of each row by a join of its text's distinct grams with the table; rows of equal texts share one."""
    keys = ["__kn_lang", "__kn_text"]
    docs = docs.withColumn(keys[0], _language()).withColumn(keys[1], F.sha2(F.coalesce("text", F.lit("")), 256))

    @lean
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, most=CHUNK):
            gram, row = grams(batch)
            place = np.arange(len(row)) - np.searchsorted(row, np.arange(batch.num_rows))[row]
            order = np.lexsort((gram, row))
            gram, row, place = gram[order], row[order], place[order].astype(np.int32)
            first = np.flatnonzero(np.append(True, (gram[1:] != gram[:-1]) | (row[1:] != row[:-1])))
            ends = pa.py_buffer((4 * np.append(first, len(gram))).astype(np.int32))
            at = pa.array(row[first])
            yield pa.RecordBatch.from_pydict({k: batch.column(k).take(at) for k in keys} | {"gram": pa.array(gram[first]), "places": pa.BinaryArray.from_buffers(pa.binary(), len(first), [None, ends, pa.py_buffer(place)])})

    @lean
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = []
            for found in batch.column("found"):
                places, score = (found.values.field(k) for k in ("places", "score"))
                places = [np.frombuffer(x, np.int32) for x in places.to_pylist()]
                value = np.zeros(sum(map(len, places)))
                value[np.concatenate(places)] = np.repeat(score.to_numpy(), [len(x) for x in places])
                sums.append(_sums(value, np.zeros(len(value), np.int64), 1))
            columns = {k: batch.column(k) for k in keys} | {c: pa.array([float(x[i][0]) for x in sums], pa.float64()) for i, c in enumerate(_SCORES)}
            yield pa.RecordBatch.from_pydict(columns)

    texts = docs.select(*keys, "text").dropDuplicates(keys)
    split_up = texts.mapInArrow(split, f"{keys[0]} string, {keys[1]} string, gram long, places binary")
    found = split_up.join(scores.withColumnRenamed("lang", keys[0]), [keys[0], "gram"]).groupBy(keys).agg(F.collect_list(F.struct("places", "score")).alias("found"))
    sums = found.mapInArrow(gather, f"{keys[0]} string, {keys[1]} string, {_SCORES[0]} double, {_SCORES[1]} double")
    return docs.join(sums, keys, "left").drop(*keys)


def quality(docs: DataFrame, trusted_ids: DataFrame, quantile: float = 0.99, worst_quantile: float | None = None) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, lang, more) with trusted, perplexity, worst_perplexity, their thresholds and kept added.

    ``trusted_ids`` has the doc_id of each document whose text the model learns from. ``worst_perplexity`` is
    that of the text's worst window of ``WINDOW`` characters. A document is kept if both perplexities are at most
    its language's thresholds, the ``quantile`` and the ``worst_quantile`` (the same, if not given) of the
    language's trusted documents (within 1/10000 of the rank). Null and empty texts have no perplexity and aren't kept;
    a language without trusted text has no threshold, and its documents are kept. A null
    language is one of its own. Repeated rows are judged alike. Columns of ``docs`` with the added names are replaced.
    """
    docs, score = scorer(docs, trusted_ids)
    lang = _language().alias("__kn_lang")
    cut = lambda c, q: F.percentile_approx(c, q, 10000)
    limits = score(docs.where("trusted")).select(lang, "perplexity", "worst_perplexity").groupBy("__kn_lang").agg(cut("perplexity", quantile).alias("threshold"), cut("worst_perplexity", worst_quantile or quantile).alias("worst_threshold"))
    limits = materialize(limits, "limits")
    scored = score(docs)
    names = [*scored.columns, "threshold", "worst_threshold"]
    limits = F.broadcast(limits) if limits.count() <= LANGUAGES else limits
    out = scored.withColumn("__kn_lang", lang).join(limits, "__kn_lang", "left").select(names)
    good = F.col("threshold").isNull() | ((F.col("perplexity") <= F.col("threshold")) & (F.col("worst_perplexity") <= F.col("worst_threshold")))
    return out.withColumn("kept", F.col("perplexity").isNotNull() & good)
