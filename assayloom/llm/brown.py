"""Language-model scoring by Brown's class-based bigrams.

Words are UTF-8 runs between white space with A-Z lower-cased; each text ends with one end token. Counts of all
training tokens come from grouped sums over the whole corpus and grow with it. Clustering is by exchange, in two steps.
First the ``units``, the most frequent words one each and the other words grouped by their last three bytes, are moved
one after another on the driver, each to the class that most raises the likelihood of the class bigram model. Then all
``head`` words are exchanged one by one in ``sweeps`` Spark jobs: grouped sums give each word's counts before and after
every class, and each word takes its best class against the classes of the sweep before (as in Uszkoreit and Brants
2008); alternate words move in a sweep, and one that doesn't raise the likelihood is undone. Words beyond
``head``, the rarest ones, have the class of their ending.

    P(w | previous) = P(class(w) | class(previous)) * P(w | class(w))

Class transitions are smoothed towards class frequencies; emissions of other than unit words are discounted by n1/(n1+2*n2),
and what this frees is the probability, in each class, of a word not met in training. So the probabilities of known
words and of one unknown word a class sum to 1 after every context.

The vocabulary is never sent whole to a task: the ``head`` most frequent words are (a parameter), the rest of the
vocabulary is joined to the texts' other words, which are few. Classes, transitions and unit counts are bounded by
``units`` and ``suffixes`` (at most 1,281 squared cells of 16 bytes, 26 MB, to the driver), a sweep's counts in a task
by ``head`` times 97 cells of 8 bytes (51 MB), its moves by ``head`` rows.

Defined cases: null text is empty and has the end token alone; repeated rows score each; nothing to train on gives
every token the probability of an unknown one; a null doc_id is the empty text in crc32. Extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayloom.llm.common import byte_texts, crc_mod, crc_mod_py, lean, shared_folder, stored

HEAD, UNITS, SUFFIXES, CLASSES, SWEEPS, FLUSH, ROWS_AT_ONCE = 65_536, 1023, 256, 48, 4, 200_000, 400
PIECE = 1024  # bigrams in a stored row


class _Numbers(dict):
    """Word -> number: head words by rank; every other word len(head) + its ending's number."""

    def __init__(self, head: list[bytes], suffixes: list[bytes]) -> None:
        super().__init__((w, i) for i, w in enumerate(head))
        self.ending, self.base, self.other = {s: i for i, s in enumerate(suffixes)}, len(head), len(suffixes)

    def __missing__(self, word: bytes) -> int:
        return self.base + self.ending.get(word[-3:], self.other)


def _h(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def likelihood(table: np.ndarray) -> float:
    """Log likelihood of class bigrams and of words in their classes, without what no exchange changes."""
    return float(_h(table).sum() - _h(table.sum(axis=1)).sum() - _h(table.sum(axis=0)).sum())


def without(table: np.ndarray, g: int, a: np.ndarray, b: np.ndarray, own: float) -> np.ndarray:
    """Class bigrams less those of a unit of class ``g``: ``a`` to and ``b`` from each class, ``own`` with itself (in neither)."""
    t = table.copy()
    t[g, :] -= a
    t[:, g] -= b
    t[g, g] -= own
    return t


def gains(t: np.ndarray, a: np.ndarray, b: np.ndarray, own: float) -> np.ndarray:
    """What the likelihood gains if the unit that ``t`` is without joins each class."""
    # the sums of a class also hold the unit's counts with its members, wherever the unit is
    left, right, d = t.sum(axis=1) + b, t.sum(axis=0) + a, np.diag(t)
    after, before = np.flatnonzero(a), np.flatnonzero(b)
    rows = (_h(t[:, after] + a[after]) - _h(t[:, after])).sum(axis=1) - (_h(d + a) - _h(d))
    columns = (_h(t[before, :] + b[before, None]) - _h(t[before, :])).sum(axis=0) - (_h(d + b) - _h(d))
    # counts of the unit with members of the class it joins meet in the corner cell
    corner = _h(d + a + b + own) - _h(d)
    ends = _h(left + a.sum() + own) - _h(left) + _h(right + b.sum() + own) - _h(right)
    return rows + columns + corner - ends


def exchange(pairs: np.ndarray, classes: int, sweeps: int = 6) -> np.ndarray:
    """Class of each unit, from the matrix of unit bigram counts, by the exchange algorithm.

    Maximises sum N(g,h) log N(g,h) - sum Nl(g) log Nl(g) - sum Nr(h) log Nr(h) over classes g, h.
    """
    n = len(pairs)
    pairs = pairs.astype(np.float64)
    total = pairs.sum(axis=0) + pairs.sum(axis=1)
    order = np.argsort(-total, kind="stable")
    classes = min(classes, n)
    of = np.empty(n, np.int64)
    of[order] = np.minimum(np.arange(n), classes - 1) if n <= classes else np.arange(n) % classes
    member = np.zeros((n, classes))
    member[np.arange(n), of] = 1
    table = member.T @ pairs @ member
    into, outof = pairs.T @ member, pairs @ member  # of each unit: counts from and to each class
    for _ in range(sweeps):
        moved = 0
        for u in order:
            if total[u] == 0:
                continue
            g, own = of[u], pairs[u, u]
            a, b = outof[u].copy(), into[u].copy()  # unit -> class, class -> unit
            a[g] -= own
            b[g] -= own
            t = without(table, g, a, b, own)
            gain = gains(t, a, b, own)
            to = int(np.argmax(gain))
            if gain[to] <= gain[g] + 1e-9:
                continue
            t[to, :] += a
            t[:, to] += b
            t[to, to] += own
            table, of[u] = t, to
            into[:, g] -= pairs[u, :]
            into[:, to] += pairs[u, :]
            outof[:, g] -= pairs[:, u]
            outof[:, to] += pairs[:, u]
            moved += 1
        if not moved:
            break
    return of


@dataclass
class Model:
    head: list[bytes]
    suffixes: list[bytes]
    head_counts: np.ndarray
    units: int
    tokens: int  # N
    types: int  # V
    end_count: int
    class_of: np.ndarray  # of a number: head words, endings, other; last: the end token
    step: np.ndarray  # log10 P(class | class)
    class_tokens: np.ndarray
    discount: float
    free: np.ndarray  # log10 P(unknown | class)


def _trains(ids) -> list[bool]:
    return [crc_mod_py(i, 7) != 2 for i in ids]


def _word_counts(batches):
    counts: Counter = Counter()

    def out():
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    for batch in (b.slice(i, ROWS_AT_ONCE) for b in batches for i in range(0, b.num_rows, ROWS_AT_ONCE)):
        for train, text in zip(_trains(batch.column("doc_id").to_pylist()), byte_texts(batch.column("text")).to_pylist()):
            if train:
                counts.update(text.lower().split())
                if len(counts) > FLUSH:
                    yield out()
                    counts.clear()
    yield out()


def _numbered(words: list[bytes], names: list[bytes]):
    """Numbers of the training tokens as rows of PIECE bigrams: the texts one after another, an end before, between and after them."""

    def work(batches):
        numbers = _Numbers(words, names)
        end = len(words) + len(names) + 1
        for batch in (b.slice(i, ROWS_AT_ONCE) for b in batches for i in range(0, b.num_rows, ROWS_AT_ONCE)):
            stream = [end]
            for ok, text in zip(_trains(batch.column("doc_id").to_pylist()), byte_texts(batch.column("text")).to_pylist()):
                if ok:
                    stream.extend(map(numbers.__getitem__, text.lower().split()))
                    stream.append(end)
            line = np.array(stream, np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([line[i : i + PIECE + 1].tobytes() for i in range(0, len(line) - 1, PIECE)], pa.binary())], names=["line"])

    return work


def _rows(batches):
    for batch in batches:
        for line in batch.column("line"):
            yield np.frombuffer(line.as_buffer(), np.int32)


def pair_counts(lines: DataFrame, group: np.ndarray, size: int) -> np.ndarray:
    """size x size counts of the bigrams of groups (``group`` of each number)."""

    def count(batches):
        seen = np.zeros(size * size, np.int64)
        for line in _rows(batches):
            g = group[line].astype(np.int64)
            np.add.at(seen, g[:-1] * size + g[1:], 1)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], names=["at", "n"])

    pairs = np.zeros(size * size, np.int64)
    counted = lines.mapInArrow(lean(count), "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()  # at most size * size rows
    pairs[counted.column("at").to_numpy()] = counted.column("n").to_numpy()
    return pairs.reshape(size, size)


def sweep(lines: DataFrame, class_of: np.ndarray, table: np.ndarray, turn: int) -> np.ndarray:
    """The class of each number after those of ``turn``'s parity went to their best classes, all against ``table``; the end stays."""
    k, width, old = len(table), 2 * len(table) + 1, class_of.astype(np.int16)
    moves_now = np.arange(len(old)) % 2 == turn % 2
    moves_now[-1] = False

    def contexts(batches):
        seen = np.zeros(len(old) * width, np.int64)
        for line in _rows(batches):
            left, right = line[:-1].astype(np.int64), line[1:].astype(np.int64)
            same, l, r = left == right, moves_now[left], moves_now[right]
            np.add.at(seen, (left * width + np.where(same, 2 * k, old[right]))[l], 1)
            np.add.at(seen, (right * width + k + old[left])[r & ~same], 1)
        at = np.flatnonzero(seen)
        step = 100_000
        for i in range(0, len(at), step):
            part = at[i : i + step]
            yield pa.RecordBatch.from_arrays([pa.array((part // width).astype(np.int32)), pa.array((part % width).astype(np.int16)), pa.array(seen[part])], names=["number", "cell", "n"])

    def best(batches):
        for batch in batches:
            cells = batch.column("cells")
            at, flat = cells.offsets.to_numpy() - cells.offsets[0].as_py(), cells.flatten()
            cell, n = flat.field(0).to_numpy(), flat.field(1).to_numpy()
            numbers, to = batch.column("number").to_numpy(), []
            for u, i, j in zip(numbers, at[:-1], at[1:]):
                row = np.zeros(width)
                row[cell[i:j]] = n[i:j]
                a, b, own, g = row[:k], row[k:-1], row[-1], old[u]
                gain = gains(without(table, g, a, b, own), a, b, own)[:-1]
                c = int(np.argmax(gain))
                to.append(c if gain[c] > gain[g] + 1e-9 else int(g))
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(to, pa.int16())], names=["number", "class"])

    # one shuffle by word serves both groupings; tasks have summed their cells before it
    counts = lines.mapInArrow(lean(contexts), "number int, cell short, n long").repartition("number").groupBy("number", "cell").agg(F.sum("n").alias("n"))
    a_word = counts.groupBy("number").agg(F.collect_list(F.struct("cell", "n")).alias("cells"))  # at most 2k + 1 cells a word
    moved = a_word.mapInArrow(lean(best), "number int, class short").toArrow()  # at most a row a number
    out = class_of.copy()
    out[moved.column("number").to_numpy()] = moved.column("class").to_numpy()
    return out


def train(docs: DataFrame, folder: str, head: int = HEAD, units: int = UNITS, suffixes: int = SUFFIXES, classes: int = CLASSES, sweeps: int = SWEEPS) -> tuple[Model, DataFrame]:
    """The model, and the stored word counts (word, n) of the training texts."""
    vocabulary = stored(docs.mapInArrow(lean(_word_counts), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), folder, "vocabulary")
    total = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)).first()
    ends = docs.select("doc_id").mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([sum(_trains(b.column("doc_id").to_pylist()))], pa.int64())], names=["n"]) for b in batches), "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    top = vocabulary.orderBy(F.desc("n"), "word").limit(head).collect()
    words, counts = [bytes(r["word"]) for r in top], np.array([r["n"] for r in top], np.int64)
    units = min(units, len(words))
    # endings of all words that are no units of their own, and of those beyond the head
    ranked = docs.sparkSession.createDataFrame(pa.table({"word": pa.array(words, pa.binary()), "rank": pa.array(range(len(words)), pa.int32())}))
    far = F.col("rank").isNull()
    others = vocabulary.join(F.broadcast(ranked), "word", "left").filter(far | (F.col("rank") >= units))  # at most ``head`` rows
    sums = [F.sum("n").alias("n"), F.coalesce(F.sum(F.when(far, F.col("n"))), F.lit(0)).alias("far_n"), F.count_if(far).alias("far_types")]
    endings = others.groupBy(F.expr("substring(word, greatest(length(word) - 2, 1), 3)").alias("s")).agg(*sums).orderBy(F.desc("n"), "s")
    kept, rest = endings.limit(suffixes).collect(), others.agg(*sums).first()
    names = [bytes(r["s"]) for r in kept]
    far_n, far_types = ([r[c] for r in kept] + [rest[c] - sum(r[c] for r in kept)] for c in ("far_n", "far_types"))
    size = units + len(names) + 2  # units, endings, other, end
    # unit of each number (head words, endings, other, end): head words that are no units count by their ending
    numbers = _Numbers(words, names)
    unit = np.arange(len(words) + len(names) + 2) - len(words) + units
    unit[:units] = np.arange(units)
    unit[units : len(words)] = [units + numbers.ending.get(w[-3:], numbers.other) for w in words[units:]]

    lines = stored(docs.mapInArrow(lean(_numbered(words, names)), "line binary"), folder, "lines")
    pairs = pair_counts(lines, unit, size)
    alone = exchange(pairs[:-1, :-1], classes)
    of_unit = np.append(alone, alone.max(initial=-1) + 1)  # the end is a class of its own
    k = int(of_unit.max()) + 1
    member = np.zeros((size, k))
    member[np.arange(size), of_unit] = 1
    table, class_of = member.T @ pairs @ member, of_unit[unit]
    for turn in range(sweeps):
        tried = sweep(lines, class_of, table, turn)
        met = pair_counts(lines, tried, k).astype(np.float64)
        if likelihood(met) > likelihood(table):
            table, class_of = met, tried
    share = (table.sum(axis=0) + 1) / (table.sum() + k)
    step = np.log10((table + 5 * share[None, :]) / (table.sum(axis=1, keepdims=True) + 5))
    n1, n2 = total[2], total[3]
    discount = n1 / (n1 + 2 * n2) if n1 else 0.5
    class_tokens = np.bincount(class_of, np.concatenate([counts, far_n, [ends]]), k)
    class_types = np.bincount(class_of, np.concatenate([np.zeros(units), np.ones(len(words) - units), far_types, [0]]), k)  # discounted words
    free = np.log10((discount * class_types + 1) / (class_tokens + 1))
    return Model(words, names, counts, units, int(total[0] + ends), int(total[1] + (ends > 0)), int(ends), class_of, step, class_tokens, discount, free), vocabulary


def score(docs: DataFrame, model: Model, vocabulary: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row of ``docs`` (doc_id, text)."""
    m, big = model, len(model.head)
    base_all = np.log10(m.tokens + (m.types + 1))
    head_base = np.append(np.log10(m.head_counts + 1) - base_all, np.zeros(len(m.suffixes) + 1))
    spare = np.concatenate([np.zeros(m.units), np.full(big - m.units, m.discount)])
    head_emit = np.append(np.log10((m.head_counts - spare) / (m.class_tokens[m.class_of[:big]] + 1)), np.zeros(len(m.suffixes) + 1))
    end_base = np.log10(m.end_count + 1) - base_all
    end_class = int(m.class_of[-1])
    end_emit = np.log10(max(m.end_count, 1) / (m.class_tokens[end_class] + 1))

    def local(batches):
        numbers = _Numbers(m.head, m.suffixes)
        class_of = m.class_of[:-1]
        for batch in (b.slice(i, ROWS_AT_ONCE) for b in batches for i in range(0, b.num_rows, ROWS_AT_ONCE)):
            ids, rows, tails = batch.column("doc_id").to_pylist(), [], []
            for key, text in enumerate(byte_texts(batch.column("text")).to_pylist()):
                tokens = text.lower().split()
                at = np.fromiter(map(numbers.__getitem__, tokens), np.int64, len(tokens))
                line = np.full(len(tokens) + 2, end_class)
                line[1:-1] = class_of[at]
                path = float(m.step[line[:-1], line[1:]].sum())
                far = np.flatnonzero(at >= big)
                rows.append((len(tokens) + 1, len(tokens) - len(far) + (m.end_count > 0), float(head_base[at].sum()) + end_base, path + float(head_emit[at].sum()) + end_emit))
                tails.append(Counter(tokens[i] for i in far))
            marks = [row_mark(d, t) for d, t in zip(ids, byte_texts(batch.column("text")).to_pylist())]
            flat = [(h, w, n, int(class_of[numbers[w]])) for h, c in zip(marks, tails) for w, n in c.items()]
            columns = list(zip(*flat)) or [()] * 4
            none, none_flat = [None] * len(ids), [None] * len(flat)
            yield pa.RecordBatch.from_arrays(
                [pa.array([*marks, *columns[0]], pa.int64()), pa.array(none + list(columns[1]), pa.binary()), pa.array([1] * len(ids) + list(columns[2]), pa.int32()), pa.array(none + list(columns[3]), pa.int16()), pa.array(ids + none_flat, pa.int64())]
                + [pa.array([r[k] for r in rows] + none_flat, kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.float64()))],
                names=["mark", "word", "n", "class", "doc_id", "tokens", "known", "base", "own"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = rows.mapInArrow(lean(local), "mark long, word binary, n int, class short, doc_id long, tokens long, known long, base double, own double")
    parts = parts.select(F.when(F.col("word").isNull(), F.col("mark")).otherwise(F.xxhash64("word")).alias("key"), F.col("word").isNotNull().alias("far"), *parts.columns)
    counts = vocabulary.select(F.xxhash64("word").alias("key"), "word", F.col("n").alias("c"))
    # the key spreads the rows of documents, whose word is null and meets nothing
    met = parts.join(counts, ["key", "word"], "left")
    numbers = lambda values: F.array(*[F.lit(float(v)) for v in values])[F.col("class").cast("int")]
    met = met.select(
        "mark", "doc_id", "tokens", F.when(F.col("far"), 0).otherwise(1).alias("rows"),
        F.when(F.col("far"), F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).otherwise(F.col("known")).alias("known"),
        F.when(F.col("far"), F.col("n") * (F.log10(F.coalesce("c", F.lit(0)) + 1) - float(base_all))).otherwise(F.col("base")).alias("base"),
        F.when(F.col("far"), F.col("n") * F.when(F.col("c").isNotNull(), F.log10(F.col("c") - float(m.discount)) - numbers(np.log10(m.class_tokens + 1))).otherwise(numbers(m.free))).otherwise(F.col("own")).alias("own"),
    )
    summed = met.groupBy("mark").agg(F.max("doc_id").alias("doc_id"), F.sum("rows").alias("rows"), *[F.sum(c).alias(c) for c in ("tokens", "known", "base", "own")])
    every = summed.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "rows")))
    share = lambda c: F.col(c) / F.col("rows")
    return every.select("doc_id", (crc_mod("doc_id", 7) == 2).alias("held_out"), share("tokens").cast("long").alias("n_tokens"), share("known").cast("long").alias("n_known"), F.lit(m.tokens).cast("long").alias("train_tokens"), share("base").alias("base_score"), share("own").alias("score"))


def row_mark(doc_id: int | None, text: bytes) -> int:
    """A signed 64-bit mark of a row; rows of the same id and text share it and score alike."""
    return xxhash.xxh3_64_intdigest(text, seed=xxhash.xxh3_64_intdigest(str(doc_id))) - (1 << 63)


def class_scores(docs: DataFrame, **sizes: int) -> DataFrame:
    """Train on rows whose crc32(doc_id as text) mod 7 is not 2, and score every row of ``docs``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model, vocabulary = train(docs, shared_folder(docs.sparkSession), **sizes)
    return score(docs, model, vocabulary)
