"""An n-gram language model by deleted interpolation, and its scores of texts.

Texts become blocks of about a million tokens. A block asks for the counts of its own distinct
n-grams, each once: keys are dealt by ranges of their hash, counted there over all blocks, and a
block is told only those counts that differ from what it has itself. An n-gram of three or more
words is asked for only if both shorter ones in it occur more than once, be it in texts held out.
So what is shuffled follows the distinct n-grams of blocks, no key is more frequent in it than
there are blocks, and neither texts nor counts ever meet in one place.

The model mixes the maximum-likelihood estimates of all orders and the uniform one. The weights
are those of the longest context seen and of how often it was seen, in powers of two. They are
learned by expectation-maximisation on documents set aside for it, whose own n-grams are deleted
from the counts, document by document.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import drop, ensure_checkpoint_dir, save
from spindrift.session import ship

ORDER = 3
BLOCK_TOKENS = 1 << 20
#: Tokens for each range of keys, and the least number of ranges.
RANGE_TOKENS, LEAST_RANGES = 1 << 20, 64
#: Weights stop changing when a round of EM gains less than this many nats a token, or after so many rounds.
GAIN, ROUNDS = 1e-5, 40
#: Tokens that every estimate is given in every class before any is seen: so an unknown word keeps a share.
PRIOR = 1.0
TRAIN, HELD_OUT, TUNE = 0, 1, 2
END = b"\n"  # no word contains it
CLASSES = 32  # powers of two of a context's count

BLOCK = pa.schema([("block", pa.int64()), ("n_train", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("role", pa.binary()), ("len", pa.binary()), ("word", pa.binary()), ("hash", pa.binary())])
BLOCK_DDL = "block long, n_train long, n_docs long, n_tokens long, doc_id array<long>, role binary, len binary, word binary, hash binary"
ASK = pa.schema([("range", pa.int32()), ("block", pa.int64()), ("level", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("others", pa.binary())])
ASK_DDL = "range int, block long, level int, keys binary, counts binary, others binary"
TOLD = pa.schema([("block", pa.int64()), ("level", pa.int32()), ("range", pa.int32()), ("at", pa.binary()), ("total", pa.binary()), ("other", pa.binary()), ("words", pa.int64())])
TOLD_DDL = "block long, level int, range int, at binary, total binary, other binary, words long"
FEATURES_DDL = "class binary, likely binary"
SCORE_DDL = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _rows(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema) if rows else schema.empty_table()


def _planes(x: np.ndarray) -> bytes:
    """Numbers as all their first bytes, all their second ones and so on, compressed: the high ones of small numbers vanish."""
    flat = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()
    return len(flat).to_bytes(8, "little") + (pa.compress(flat, "zstd", asbytes=True) if flat else b"")


def _numbers(b: bytes, dtype: type) -> np.ndarray:
    view = memoryview(b)
    n = int.from_bytes(view[:8], "little")
    flat = pa.decompress(view[8:], n, "zstd", asbytes=True) if n else b""
    return np.ascontiguousarray(np.frombuffer(flat, np.uint8).reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).ravel()


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of two, which tells their order."""
    x = (a ^ (a >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + b
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def blocks_of(docs: DataFrame, role: Column) -> DataFrame:
    """Rows of BLOCK: texts as numbers of words, with the words' hashes. Null text counts as empty. A text of more than
    BLOCK_TOKENS ends its block. Texts that weights are fitted to have blocks of their own, with odd numbers."""
    known_columns = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), role.alias("role"))
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        task, number = TaskContext.get().partitionId() << 32, [0, 1]
        held: list[tuple] = [([], [], [], [], {END: 0}) for _ in number]

        def block(aside: bool) -> pa.RecordBatch:
            ids, roles, lens, words, known = held[aside]
            who, size = np.array(roles, np.uint8), np.array(lens, np.uint32)
            learnt = who != HELD_OUT
            hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in known], np.uint64)
            row = (task + number[aside], int(size[learnt].sum()), int(learnt.sum()), int(size.sum()), ids, who.tobytes(), _planes(size), _planes(np.array(words, np.uint32)), hashes.tobytes())
            held[aside] = ([], [], [], [], {END: 0})
            number[aside] += 2
            return _rows(BLOCK, [row]).to_batches()[0]

        for b in batches:
            for doc_id, text, r in zip(b["doc_id"].to_pylist(), b["text"], b["role"].to_pylist(), strict=True):
                ids, roles, lens, words, known = held[r == TUNE]
                tokens = text.as_buffer().to_pybytes().lower().split()
                words += [known.setdefault(w, len(known)) for w in tokens]
                words.append(0)
                ids.append(doc_id)
                roles.append(r)
                lens.append(len(tokens) + 1)
                if len(words) >= BLOCK_TOKENS:
                    yield block(r == TUNE)
        for aside in (False, True):
            if held[aside][0]:
                yield block(aside)

    return known_columns.mapInArrow(run, BLOCK_DDL)


class Counts:
    """A block's n-grams of one level: distinct keys in order, how often they occur in training texts (count) and in others
    (other), and which one ends at each token (-1: not asked for)."""

    def __init__(self, keys: np.ndarray, train: np.ndarray, asked: np.ndarray | None = None):
        at = np.arange(len(keys)) if asked is None else np.flatnonzero(asked)
        order = at[np.argsort(keys[at])]
        found = keys[order]
        new = np.r_[True, found[1:] != found[:-1]][: len(found)]
        first = np.flatnonzero(new)
        self.keys = found[first]
        self.count = np.add.reduceat(train[order].astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
        self.other = np.diff(np.r_[first, len(found)]) - self.count
        self.of = np.full(len(keys), -1, np.int64)
        self.of[order] = np.cumsum(new) - 1


class Block:
    """One block in a task: keys, counts and contexts of its tokens."""

    def __init__(self, row: pa.Table, told: pa.Table | None, order: int, bits: int):
        cell = {k: row[k][0].as_py() for k in ("block", "doc_id", "role", "len", "word", "hash")}
        self.number, self.doc_id, self.bits = cell["block"], cell["doc_id"], bits
        self.role, self.len = np.frombuffer(cell["role"], np.uint8), _numbers(cell["len"], np.uint32).astype(np.int64)
        self.word, self.hash = _numbers(cell["word"], np.uint32).astype(np.int64), np.frombuffer(cell["hash"], np.uint64)
        self.begin = np.cumsum(self.len) - self.len
        self.doc = np.repeat(np.arange(len(self.len)), self.len)
        self.train = (self.role != HELD_OUT)[self.doc]
        self.starts = np.zeros(len(self.word), bool)
        self.starts[self.begin] = True
        self.told = {}
        if told is not None:
            for level, r, at, total, other in zip(*(told[k].to_pylist() for k in ("level", "range", "at", "total", "other")), strict=True):
                self.told.setdefault(level, []).append((r, np.cumsum(_numbers(at, np.uint32), dtype=np.int64), _numbers(total, np.int64), _numbers(other, np.int64)))
        self._raw, self.total, self.everywhere = [self.hash[self.word]], {}, {}

    def _key(self, n: int) -> np.ndarray:
        """Hashes of the n-grams that end at each token, with n in the last three bits; before a text stands the start, n - 1 times."""
        while len(self._raw) < n:
            before = np.r_[np.uint64(0), self._raw[-1][:-1]]
            before[self.starts] = np.uint64(len(self._raw))
            self._raw.append(_mixed(before, self._raw[0]))
        return (self._raw[n - 1] & ~np.uint64(7)) | np.uint64(n)

    def before(self, n: int, n_docs: int) -> np.ndarray:
        """How often the n - 1 words before each token occur in training."""
        return np.where(self.starts, n_docs, np.r_[0, self.total[n - 1][:-1]])

    def level(self, n: int) -> Counts:
        """The n-grams to ask for: from three words on, those whose two shorter ones both occur more than once. Any other occurs once, here."""
        if n < 3:
            return Counts(self._key(n), self.train)
        often = self.everywhere[n - 1] > 1
        return Counts(self._key(n), self.train, often & (self.starts | np.r_[False, often[:-1]]))

    def ranges(self, keys: np.ndarray) -> np.ndarray:
        """Where each range of keys begins, and the end."""
        edges = np.arange(1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits)
        return np.r_[np.searchsorted(keys, edges), len(keys)]

    def ask(self, n: int) -> list[tuple]:
        c = self.level(n)
        cut = self.ranges(c.keys)
        out = []
        for r in np.flatnonzero(np.diff(cut)).tolist():
            here = slice(cut[r], cut[r + 1])
            out.append((r, self.number, n, _planes(np.diff(c.keys[here], prepend=np.uint64(0))), *(_planes(x[here].astype(np.uint32)) for x in (c.count, c.other))))
        return out

    def learn(self, n: int) -> None:
        """How often the n-gram that ends at each token occurs in training (total) and at all (everywhere), from what the block was told."""
        c = self.level(n)
        total, other, cut = c.count.copy(), c.other.copy(), self.ranges(c.keys)
        for r, at, *new in self.told.get(n, ()):
            total[cut[r] + at], other[cut[r] + at] = new
        asked = c.of >= 0
        self.total[n] = np.where(asked, np.r_[total, 0][c.of], self.train)
        self.everywhere[n] = np.where(asked, np.r_[total + other, 0][c.of], 1)

    def likely(self, order: int, n_train: int, n_docs: int, tuned: bool) -> tuple[np.ndarray, np.ndarray]:
        """(class of weights, maximum-likelihood estimates of all orders) of all tokens; tuned: with each document's own n-grams
        deleted from the counts."""
        f, of, last = np.zeros((order, len(self.word))), np.zeros(len(self.word), np.int64), None
        for n in range(1, order + 1):
            have = self.total[n]
            seen = self.before(n, n_docs) if n > 1 else np.full(len(have), n_train)
            if tuned:
                own = Counts(_mixed(self._key(n), self.doc.astype(np.uint64)), np.ones(len(have), bool))
                times = own.count[own.of]
                have = have - times
                seen = seen - (self.len[self.doc] if n == 1 else np.where(self.starts, 1, np.r_[0, last[:-1]]))
                last = times
            np.divide(have, seen, out=f[n - 1], where=seen > 0)
            if n > 1:
                of = np.where(seen > 0, (n - 1) * CLASSES + np.minimum(np.frexp(seen)[1], CLASSES - 1), of)
        return of, f


def _answers(questions: DataFrame) -> DataFrame:
    """Totals of a range's keys over all blocks, for the blocks that can't know them; in a row without a block how many of its keys
    are words of training texts."""

    def answer(rows: pa.Table) -> pa.Table:
        r = rows["range"][0].as_py()
        who = list(zip(rows["block"].to_pylist(), rows["level"].to_pylist(), strict=True))
        keys = [np.cumsum(_numbers(x.as_buffer(), np.uint64), dtype=np.uint64) for x in rows["keys"]]
        cut = np.cumsum([0, *map(len, keys)])
        keys = np.concatenate(keys)
        own = [np.concatenate([_numbers(x.as_buffer(), np.uint32) for x in rows[k]]).astype(np.int64) for k in ("counts", "others")]
        order = np.argsort(keys, kind="stable")
        found = keys[order]
        new = np.r_[True, found[1:] != found[:-1]]
        first = np.flatnonzero(new)
        sums = [np.add.reduceat(x[order], first) for x in own]
        of = np.empty(len(keys), np.int64)
        of[order] = np.cumsum(new) - 1
        total, other = (x[of] for x in sums)
        words = int(((found[first] & np.uint64(7) == 1) & (sums[0] > 0)).sum())
        out = [(None, None, r, None, None, None, words)]
        for (block, level), a, b in zip(who, cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            at = np.flatnonzero((total[a:b] != own[0][a:b]) | (other[a:b] != own[1][a:b]))
            if len(at):
                out.append((block, level, r, _planes(np.diff(at, prepend=0).astype(np.uint32)), *(_planes(x[a:b][at]) for x in (total, other)), None))
        return _rows(TOLD, out)

    return questions.groupBy("range").applyInArrow(answer, TOLD_DDL)


def weights_by_em(features: DataFrame, order: int, uniform: float) -> np.ndarray:
    """Weights (class, order + 1; the first is the uniform estimate's) that make the tokens of features likeliest. A round is one
    pass over them; what comes to the driver are sums for each class. Without tokens all estimates of a class weigh the same."""
    shape = (order * CLASSES, order + 1)
    knows = np.arange(order + 1)[None, :] <= np.arange(shape[0])[:, None] // CLASSES + 1  # those up to the class's context
    weights = knows / knows.sum(1, keepdims=True)
    last = -np.inf
    for _ in range(ROUNDS):

        def expect(batches: Iterator[pa.RecordBatch], now: np.ndarray = weights) -> Iterator[pa.RecordBatch]:
            sums, log, n = np.zeros(shape), 0.0, 0
            for b in batches:
                for of, f in zip(b["class"], b["likely"], strict=True):
                    of = np.frombuffer(of.as_buffer(), np.uint8).astype(np.int64)
                    part = np.vstack([np.full(len(of), uniform), np.frombuffer(f.as_buffer(), np.float32).reshape(order, -1)]) * now[of].T
                    p = part.sum(0)
                    for k in range(order + 1):
                        sums[:, k] += np.bincount(of, part[k] / p, shape[0])
                    log, n = log + float(np.log(p).sum()), n + len(of)
            flat = np.r_[sums.ravel(), log, n]
            at = np.flatnonzero(flat)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(flat[at])], names=["i", "v"])

        flat = np.zeros(shape[0] * shape[1] + 2)
        for r in features.mapInArrow(expect, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
            flat[r.i] = r.v
        if not flat[-1]:
            break
        sums = flat[:-2].reshape(shape) + PRIOR * knows
        weights = sums / sums.sum(1, keepdims=True)
        if flat[-2] / flat[-1] - last < GAIN:
            break
        last = flat[-2] / flat[-1]
    return weights


class Model:
    """What training texts have, as tables in the shared folder, and the weights learned from them."""

    def __init__(self, docs: DataFrame, held_out: Column, tune: Column, order: int = ORDER):
        """Texts with held_out are learnt nothing from; of the others, those with tune also fit the weights. Null counts as false."""
        spark = docs.sparkSession
        role = F.when(held_out, HELD_OUT).when(tune, TUNE).otherwise(TRAIN).cast("int")
        self.order, self.spark, self.n_buckets = order, spark, int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.blocks = self._bucketed(blocks_of(docs, role))
        sums = self.blocks.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("n_train", "n_docs", "n_tokens"))).first()
        self.n_train, self.n_docs = sums[0], sums[1]
        self.bits = max(LEAST_RANGES.bit_length() - 1, (sums[2] // RANGE_TOKENS).bit_length())
        self.told, self.known = None, 0
        for levels in [tuple(range(1, min(2, order) + 1)), *((n,) for n in range(3, order + 1))]:
            # dealt by block once, not by every reader; one table for all levels, since a union would be dealt anew
            self.told = self._bucketed(_answers(self._questions(levels)).repartition(self.n_buckets, "block"), self.told)
            self.known = max(levels)
        self.n_words = self.told.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
        self.uniform = 1 / (self.n_words + 1)
        features = save(self._features())
        self.weights = weights_by_em(features, order, self.uniform)
        drop(features)

    def _bucketed(self, df: DataFrame, more: DataFrame | None = None) -> DataFrame:
        """df written as a table bucketed by block, or added to one: joins of two such tables by block move nothing."""
        name = more._name if more is not None else f"spindrift_{uuid.uuid4().hex}"
        path = f"{ensure_checkpoint_dir(self.spark)}/{name}"
        df.write.mode("append").format("parquet").option("path", path).option("compression", "zstd").bucketBy(self.n_buckets, "block").saveAsTable(name)
        table = self.spark.read.table(name)
        table._saved_at, table._name = path, name
        return table

    def _with_told(self, use, schema: str, which: str = "true") -> DataFrame:
        """use(block) -> arrow table, for each block with the totals of the levels known so far. which: a condition on their numbers."""
        order, bits, known = self.order, self.bits, self.known

        def run(row: pa.Table, told: pa.Table | None = None) -> pa.Table:
            if not row.num_rows:
                return use(None)
            b = Block(row, told, order, bits)
            for n in range(1, known + 1):
                b.learn(n)
            return use(b)

        blocks = self.blocks.where(which).groupBy("block")
        if not known:
            return blocks.applyInArrow(lambda row: run(row), schema)
        return blocks.cogroup(self.told.where(f"block IS NOT NULL AND {which}").groupBy("block")).applyInArrow(lambda row, told: run(row, told), schema)

    def _questions(self, levels: tuple[int, ...]) -> DataFrame:
        return self._with_told(lambda b: _rows(ASK, [x for n in levels for x in b.ask(n)] if b else []), ASK_DDL)

    def _features(self) -> DataFrame:
        """Of each block's tokens that weights are fitted to: classes and estimates."""
        schema = pa.schema([("class", pa.binary()), ("likely", pa.binary())])
        order, n_train, n_docs = self.order, self.n_train, self.n_docs

        def use(b: Block | None) -> pa.Table:
            if b is None:
                return schema.empty_table()
            of, f = b.likely(order, n_train, n_docs, True)
            return _rows(schema, [(of.astype(np.uint8).tobytes(), f.astype(np.float32).tobytes())])

        return self._with_told(use, FEATURES_DDL, "block % 2 = 1")

    def scores(self) -> DataFrame:
        """Rows of SCORE_DDL, for each document that the model was made of, held out or not. base_score: words alone, each counted once more."""
        schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
        order, n_train, n_docs, n_words, weights, uniform = self.order, self.n_train, self.n_docs, self.n_words, self.weights, self.uniform

        def use(b: Block | None) -> pa.Table:
            if b is None:
                return schema.empty_table()
            of, f = b.likely(order, n_train, n_docs, False)
            p = weights[of, 0] * uniform
            for k in range(order):
                p += weights[of, k + 1] * f[k]
            sums = [np.add.reduceat(x, b.begin) for x in ((b.total[1] > 0).astype(np.int64), np.log10((b.total[1] + 1) / (n_train + n_words + 1)), np.log10(p))]
            return pa.Table.from_arrays([pa.array(x) for x in (pa.array(b.doc_id, pa.int64()), b.role == HELD_OUT, b.len, *sums)], schema=schema)

        return self._with_told(use, SCORE_DDL)

    def drop(self) -> None:
        """Delete the tables; scores() can't be read any more."""
        for t in (self.blocks, self.told):
            self.spark.sql(f"DROP TABLE {t._name}")
            drop(t)


def score_documents(docs: DataFrame, held_out: Column, tune: Column, order: int = ORDER) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of docs.

    Words stand between spaces, tabs, line ends, form feeds and vertical tabs, with A-Z lower-cased; a text's end is one more
    token. score is the log10 probability of the text. A row that repeats another is learnt from and scored again; null texts are
    empty; null doc_ids stay null; columns other than doc_id, text and those of the two conditions are not read.
    """
    model = Model(docs, held_out, tune, order)
    out = save(model.scores().withColumn("train_tokens", F.lit(model.n_train).cast("long")))
    model.drop()
    return out
