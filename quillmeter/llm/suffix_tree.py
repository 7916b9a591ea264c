"""Language-model scores from a probabilistic suffix tree over words."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property, partial, reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmeter.llm.common import drop, freed, give_back, row_slices, shuffle_width, text_or_empty
from quillmeter.llm.wordhash import Index, Words

#: Sizes of what is broadcast: frequent tokens, values of frequent word runs, 64-bit words of a filter. They are shortcuts
#: of fixed size that no result depends on: what they leave out takes the way of a join.
HEAD, HOT, FILTER = 1 << 18, 1 << 21, 1 << 20
#: Of so many runs the most frequent one is broadcast, as far as HOT goes.
HOT_SHARE = 8
#: A context needs so many occurrences, a next symbol so many after it; taken from each next symbol's count.
LEAST_CONTEXT, LEAST_NEXT, DISCOUNT = 50, 2, 0.75
ADDED = 0.1
#: Tokens of the longest context.
DEPTH = 4
#: A pass over the texts counts the runs of one share of keys, so many for each token of the texts; the others have own passes.
PASS_SHARE = 0.5
#: Keys with their values that make a bucket: a task holds them while it looks up keys.
BUCKET_ROWS = 1 << 19
#: Hash of the end token, no word's.
END = -1
_VECTOR_BYTES = 2 << 20
#: Rows that a task holds to add them up, and rows that it sends at once.
_HELD_ROWS, _SENT_ROWS = 1 << 21, 1 << 17
_LN10 = float(np.log(10))


def _tokens(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all rows, each ending with the end token, and where each row's begin."""
    w = Words(part.column("text"), lower=True)
    first = w.first + np.arange(len(w.first))
    out = np.full(first[-1], END, np.int64)
    is_word = np.ones(len(out), bool)
    is_word[first[1:] - 1] = False
    out[is_word] = w.hashes.view(np.int64)
    return out, first


def _pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Spark's xxhash64(a, b) of two columns of longs."""
    p1, p2, p3, p4, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turned = lambda x, k: (x << np.uint64(k)) | (x >> np.uint64(64 - k))
    h = np.full(len(a), 42, np.uint64)
    for x in (a, b):
        h = h + p5 + np.uint64(8)
        h ^= turned(x.view(np.uint64) * p2, 31) * p1
        h = turned(h, 27) * p1 + p4
        h = (h ^ (h >> np.uint64(33))) * p2
        h = (h ^ (h >> np.uint64(29))) * p3
        h ^= h >> np.uint64(32)
    return h.view(np.int64)


def _runs(tokens: np.ndarray, first: np.ndarray, filters: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each length of context: where one ends before a token, its key there, the shorter key and that of context and token.

    filters: for each length a filter of the contexts, which all others but a few don't pass. A row's first token
    follows an end token; longer contexts don't reach beyond that. A context of one token has the token's hash as key, a
    longer one the key of its last token after the rest. The key of context and token is a hash of the context's key and
    of the same key one token shorter, at last the token's own.
    """
    starts = first[:-1]
    key, context = tokens, np.empty(len(tokens), np.int64)
    context[1:] = tokens[:-1]
    context[starts] = END
    at = np.arange(len(tokens))
    for d, words in enumerate(filters):
        if d:  # a context is what ended one token before; its shorter form is one too, so that key is known here
            place = np.full(len(tokens), -1, np.int64)
            place[at] = np.arange(len(at))
            before = np.full(len(tokens), -1, np.int64)
            before[1:] = place[:-1]
            before[starts] = -1
            longer = np.flatnonzero((before >= 0) & (place >= 0))
            context, key, at = key[before[longer]], key[place[longer]], longer
        some = np.flatnonzero(_maybe(words, context))
        at, context, shorter = at[some], context[some], key[some]
        key = _pair_hash(context, shorter)
        yield at, context, shorter, key


def _merged(blocks: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Keys, sums of their counts and their other columns from blocks of such columns, which are used up one by one.

    A column's parts are given back when they are joined: few copies lie there at once.
    """

    def column() -> np.ndarray:
        return np.concatenate([b.pop(0) for b in blocks])

    key = column()
    order = np.argsort(key)
    key = key[order]
    heads = np.flatnonzero(np.concatenate((np.ones(min(len(key), 1), bool), key[1:] != key[:-1])))
    out = [key[heads]]
    del key
    n = column()[order]
    out.append(np.add.reduceat(n, heads) if len(heads) else n)
    first = order[heads]
    del n, order, heads
    while blocks[0]:
        out.append(column()[first])
    return out


def _summed(own: DataFrame, columns_of: Callable[[pa.RecordBatch], list[np.ndarray]], names: list[str], name: str, least: int = 1, passes: int = 1) -> DataFrame:
    """(names, n): how often each row of ``names`` comes, if ``least`` times; tasks add up their rows, by a key, before the shuffle.

    columns_of: the key alone, where it is the one name, or a key and the columns that make it up. Each of ``passes`` over the
    texts counts its share of the keys, so that just this share lies in a shuffle at once.
    """

    def out(block: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        key, n, *more = block
        if more:  # sorted by the first column, rows take less room in the shuffle
            order = np.argsort(more[0])
            n, more = n[order], [x[order] for x in more]
        whole = pa.RecordBatch.from_arrays([pa.array(x) for x in (*(more or [key]), n)], [*names, "n"])
        for i in range(0, whole.num_rows, _SENT_ROWS):
            yield whole.slice(i, _SENT_ROWS)

    def run(batches: Iterator[pa.RecordBatch], turn: int) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            for part in row_slices(batch, size=_VECTOR_BYTES):
                key, *more = columns_of(part)
                if passes > 1:
                    some = np.flatnonzero((key & ((1 << 63) - 1)) % passes == turn)
                    key, *more = (x[some] for x in (key, *more))
                held.append(_merged([[key, np.ones(len(key), np.int64), *more]]))
                del key, more
                if sum(len(b[0]) for b in held) > _HELD_ROWS:
                    held = [_merged(held)]
                    if len(held[0][0]) > _HELD_ROWS // 2:
                        yield from out(held.pop())
        if held:
            yield from out(_merged(held))
        held = []
        give_back()

    def counted(turn: int) -> DataFrame:
        rows = own.select("text").mapInArrow(partial(run, turn=turn), ", ".join(f"{c} long" for c in [*names, "n"]))
        return freed(rows.groupBy(*names).agg(F.sum("n").alias("n")).where(F.col("n") >= least), name)

    return reduce(DataFrame.union, [counted(turn) for turn in range(passes)])


def _level(n: Column) -> Column:
    return F.floor(F.log2(n.cast("double")) * 8)


def _most_frequent(table: DataFrame, most: int, least: int) -> tuple[DataFrame, int]:
    """The rows with the largest counts, at most ``most`` of them and none below ``least``; the level they start at."""
    table = table.where(F.col("n") >= least)
    level, rows = 0, 0
    for r in table.groupBy(_level(F.col("n")).alias("level")).count().orderBy(F.desc("level")).collect():  # at most 8 x 64 rows
        rows += r["count"]
        if rows > most:
            level = r.level + 1
            break
    return table.where(_level(F.col("n")) >= level), level


def _columns(table: DataFrame, *names: str) -> list[np.ndarray]:
    rows = table.select(*names).toArrow()
    return [rows.column(c).to_numpy() for c in names]


def _filter(keys: DataFrame) -> np.ndarray:
    """A Bloom filter of the column ``key`` with up to three bits of each key: a word for every four, FILTER at most.

    It never misses a key.
    """
    n = keys.count()
    words = min(FILTER, 1 << max(3, (n // 4).bit_length()))
    keys = keys.coalesce(max(4, n // (8 * words)))  # a task sends a row for each word at most: none with few keys
    bits = " | ".join(f"shiftleft(1L, cast(shiftrightunsigned(key, {k}) & 63 as int))" for k in (24, 32, 40))
    slots = keys.select(F.col("key").bitwiseAND(words - 1).alias("slot"), F.expr(bits).alias("bits"))
    out = np.zeros(words, np.uint64)
    at, bits = _columns(slots.groupBy("slot").agg(F.bit_or("bits").alias("bits")), "slot", "bits")  # at most a row for each word
    out[at] = bits.view(np.uint64)
    return out


def _maybe(words: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Whether the filter may hold each key."""
    word, key = words[key & (len(words) - 1)], key.view(np.uint64)
    inside = np.ones(len(key), bool)
    for k in (24, 32, 40):
        inside &= (word >> ((key >> np.uint64(k)) & np.uint64(63))) & np.uint64(1) == 1
    return inside


@dataclass
class Level:
    """The retained contexts of one length: their keys, back-off weights (log10), next symbols and log10 probabilities."""

    contexts: Index
    backoff: np.ndarray
    entries: Index
    logp: np.ndarray


@dataclass
class Model:
    """Tables of the whole model, and its most frequent tokens.

    unknown: log10 probability of a token that training has not seen. filters: of the contexts, by length. tokens: (key, n, base, more), log10 probability in
    the root and what a token adds as a context; states and entries
    for each length of context; runs: (key, n, more), what a run of tokens adds to a score.
    """

    head: Index
    head_log: np.ndarray
    head_more: np.ndarray
    unknown: float
    filters: list[np.ndarray]
    tokens: DataFrame
    states: list[DataFrame]
    entries: list[DataFrame]
    runs: DataFrame

    @cached_property
    def levels(self) -> list[Level]:
        """States of a small model, to look at: contexts by place, next symbols by place << 20 | place in the head."""
        out, symbols = [], self.tokens.select(F.col("key").alias("shorter"), F.col("key").alias("symbol"))
        for states, entries in zip(self.states, self.entries, strict=True):
            key, backoff = _columns(states, "context", "backoff")
            contexts = Index(key)
            at, symbol, logp = _columns(entries.join(states, "context").join(symbols, "shorter"), "context", "symbol", "state")
            symbols = entries.join(symbols, "shorter").select(F.col("key").alias("shorter"), "symbol")
            out.append(Level(contexts, backoff / _LN10, Index((contexts.find(at) << 20) | self.head.find(symbol)), logp / _LN10))
        return out


def _retained(entries: DataFrame, contexts: DataFrame) -> DataFrame:
    """(context, total, backoff) for every context with a next symbol; the back-off weight is a logarithm.

    entries: (context, n, parent), parent being the logarithm of the symbol's probability in the parent state. A context
    is a state if its counts are likelier, by over one nat for each next symbol it would keep, than under its parent;
    all others have a null weight. The mass of dropped symbols and the discount go to the parent's distribution over
    all other symbols.
    """
    n = F.col("n").cast("double")
    sums = entries.groupBy("context").agg(F.count("*").alias("k"), F.sum(n).alias("kept"), F.sum(n * (F.ln(n) - F.col("parent"))).alias("gain"), F.sum(F.exp("parent")).alias("mass"))
    total = F.col("total").cast("double")
    rest, over = total - F.col("kept"), F.greatest(1 - F.col("mass"), F.lit(1e-12))
    gain = F.col("gain") - F.col("kept") * F.ln(total) + F.when(rest > 0, rest * F.ln(rest / total / over)).otherwise(0.0)
    left = F.greatest(1 - (F.col("kept") - DISCOUNT * F.col("k")) / total, F.lit(1e-12))
    return sums.join(contexts, "context").select("context", "total", F.when(gain > F.col("k"), F.ln(left / over)).alias("backoff"))


def train(own: DataFrame, depth: int = DEPTH) -> tuple[Model, int, int]:
    """Model, number of tokens, the counts' level that the model's most frequent tokens start at.

    Contexts, next symbols, states and their values are written tables of any size. A filter of the contexts only
    spares tasks to send runs that follow none of them; the join with the contexts decides.
    """
    sc = own.sparkSession.sparkContext
    counts = _summed(own, lambda part: [_tokens(part)[0]], ["key"], "counts")
    n_tokens, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    root = F.ln((F.col("n") + ADDED) / F.lit(n_tokens + ADDED * (distinct + 1)))
    parent = counts.where(F.col("n") >= LEAST_NEXT).select(F.col("key").alias("shorter"), root.alias("parent"), (F.col("key") == END).alias("last"))
    # every token but the end is followed by one, so its count is its contexts' total
    contexts = counts.where(F.col("n") >= LEAST_CONTEXT).select(F.col("key").alias("context"), F.col("n").alias("total"))
    levels, filters = [], []
    for _ in range(depth):
        may_follow = _filter(contexts.select(F.col("context").alias("key")))
        if not may_follow.any():  # no context is as long
            break
        filters.append(may_follow)
        shared = sc.broadcast(filters)

        def columns_of(part: pa.RecordBatch, shared=shared) -> list[np.ndarray]:
            *_, (_, context, shorter, key) = _runs(*_tokens(part), shared.value)
            return [key, context, shorter]

        runs = contexts.agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]  # those that may follow a context
        pairs = _summed(own, columns_of, ["context", "shorter"], "pairs", LEAST_NEXT, max(1, -int(-runs // (PASS_SHARE * n_tokens))))
        # every next symbol comes as often after the shorter context, which is as frequent: it has an entry there
        entries = freed(pairs.join(parent, "shorter"), "entries")
        drop(pairs)
        shared.destroy()  # pairs are written; nothing asks for these filters again
        states = freed(_retained(entries, contexts), "states")
        kept = F.col("backoff").isNotNull()
        state = F.when(kept, F.ln((F.col("n") - DISCOUNT) / F.col("total"))).otherwise(F.col("parent"))
        more = F.when(kept, state - F.col("parent") - F.col("backoff")).otherwise(0.0)
        key = F.xxhash64("context", "shorter").alias("key")
        table = entries.join(states, "context").select(key, "context", "shorter", "n", "last", state.alias("state"), more.alias("more"))
        levels.append((states.where(kept), table))
        parent = table.select(F.col("key").alias("shorter"), F.col("state").alias("parent"), "last")
        contexts = entries.where((F.col("n") >= LEAST_CONTEXT) & ~F.col("last")).select(key.alias("context"), F.col("n").alias("total"))
    # a context's back-off weight goes with its own last token
    weight = lambda d: levels[d][0].select(F.col("context").alias("key"), "backoff")
    none = F.lit(0.0)
    tokens = counts.join(weight(0), "key", "left") if levels else counts.withColumn("backoff", none)
    tokens = freed(tokens.select("key", "n", (root / _LN10).alias("base"), (F.coalesce("backoff", none) / _LN10).alias("more")), "tokens")
    runs = counts.select("key", "n", none.alias("more")).where("false")
    for d, (_, table) in enumerate(levels):
        longer = table.join(weight(d + 1), "key", "left") if d + 1 < len(levels) else table.withColumn("backoff", none)
        runs = runs.union(longer.select("key", "n", ((F.col("more") + F.coalesce("backoff", none)) / _LN10).alias("more")).where("more <> 0"))
    drop(counts)
    top, level = _most_frequent(tokens, HEAD, 1)
    key, base, more = _columns(top, "key", "base", "more")  # at most HEAD rows
    unknown = float(np.log10(ADDED / (n_tokens + ADDED * (distinct + 1))))
    model = Model(Index(key), np.append(base, 0.0), np.append(more, 0.0), unknown, filters, tokens, *([x[i] for x in levels] for i in (0, 1)), freed(runs, "runs"))
    return model, n_tokens, level


#: Rows that meet in a bucket of keys, and then in a block of documents, in this order of ``kind``. ``a`` and ``b`` hold
#: numbers as bytes: keys and what they add (a row of VALUES for each column, RUN_VALUES more alone), or keys and their
#: documents (TOKENS, RUNS), or documents and what is added to each (INFO and results).
VALUES, RUN_VALUES, INFO, TOKENS, RUNS = range(5)
_ROWS = "bucket int, kind int, block long, a binary, b binary, ids array<long>, held array<boolean>, sizes array<long>"
_KINDS = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("block", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int64()))])
SCORE_SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _rows(n: int, **columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _KINDS], schema=_KINDS)


def _by_bucket(key: np.ndarray, own: np.ndarray, order: np.ndarray | None, kind: int, block: int, buckets: int) -> pa.RecordBatch:
    """A row for each bucket: its keys, and their columns of ``own`` (a number for each key, or several), ordered by ``order``."""
    bucket = (key & ((1 << 63) - 1)) % buckets
    by = np.argsort(bucket if order is None else bucket << 32 | order)
    at = np.searchsorted(bucket[by], np.arange(buckets + 1))
    some = np.flatnonzero(np.diff(at)).tolist()
    key, own = key[by], own[by]
    return _rows(len(some), bucket=some, kind=[kind] * len(some), block=[block] * len(some), a=[key[at[i] : at[i + 1]].tobytes() for i in some], b=[own[at[i] : at[i + 1]].tobytes() for i in some])


def _asked(own: DataFrame, model: Model, level: int, buckets: int) -> DataFrame:
    """Blocks of documents with what the broadcast values give, their other keys by bucket, and those keys' values."""
    top, hot_level = _most_frequent(model.runs, min(HOT, 1 + model.runs.count() // HOT_SHARE), 1)
    hot_key, hot_more = _columns(top, "key", "more")  # a share of the rows, HOT at most
    tail, rest = model.tokens.where(_level(F.col("n")) < level), model.runs.where(_level(F.col("n")) < hot_level)
    shared = own.sparkSession.sparkContext.broadcast((model.head, model.head_log, model.head_more, Index(hot_key), np.append(hot_more, 0.0), _filter(tail), _filter(rest), model.filters))
    unknown = model.unknown

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (head, head_log, head_more, hot, hot_more, others, other_runs, filters), block = shared.value, TaskContext.get().partitionId() << 36
        for batch in batches:
            for part in row_slices(batch, size=_VECTOR_BYTES):
                tokens, first = _tokens(part)
                ids = head.find(tokens)
                row = np.repeat(np.arange(part.num_rows), np.diff(first))
                base = head_log[ids]  # the last value, for tokens that aren't among the frequent ones, is zero
                value = base + head_more[ids]
                far_key, far_row = [tokens[:0]], [row[:0]]
                for at, _, _, key in _runs(tokens, first, filters):
                    place = hot.find(key)
                    value[at] += hot_more[place]
                    far = np.flatnonzero(place < 0)
                    far = far[_maybe(other_runs, key[far])]
                    far_key.append(key[far])
                    far_row.append(row[at[far]])
                tail = np.flatnonzero(ids < 0)
                unseen = ~_maybe(others, tokens[tail])  # surely: they are asked for in no bucket
                base[tail[unseen]] = value[tail[unseen]] = unknown
                tail = tail[~unseen]
                sums = np.stack([np.add.reduceat(x, first[:-1]) for x in (base, value, (ids >= 0).astype(float))], axis=1)
                docs = np.arange(part.num_rows, dtype=np.int32)
                info = {c: [part.column(name).to_pylist()] for c, name in (("ids", "doc_id"), ("held", "held_out"))}
                yield _rows(1, bucket=[block % buckets], kind=[INFO], block=[block], a=[docs.tobytes()], b=[sums.tobytes()], sizes=[np.diff(first)], **info)
                yield _by_bucket(tokens[tail], row[tail].astype(np.int32), row[tail], TOKENS, block, buckets)
                far = np.concatenate(far_row)
                yield _by_bucket(np.concatenate(far_key), far.astype(np.int32), far, RUNS, block, buckets)
                block += 1

    def packed(kind: int, columns: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = np.stack([batch.column(c).to_numpy() for c in columns], axis=1)
                yield _by_bucket(batch.column("key").to_numpy(), own, None, kind, 0, buckets)

        return run

    values = tail.select("key", "base", "more").mapInArrow(packed(VALUES, ["base", "more"]), _ROWS)
    return own.mapInArrow(run, _ROWS).union(values).union(rest.select("key", "more").mapInArrow(packed(RUN_VALUES, ["more"]), _ROWS))


class _Values:
    """A bucket's keys and what each adds: to the base score, to the score, to the known tokens; missing keys add nothing."""

    def __init__(self):
        self.parts, self.keys, self.adds = [], None, None

    def take(self, kind: int, a: bytes, b: bytes) -> None:
        key, more = np.frombuffer(a, np.int64), np.frombuffer(b, np.float64)
        if kind == VALUES:
            base, more = more.reshape(-1, 2).T
            self.parts.append((key.copy(), [base.copy(), base + more], 1.0))
        else:
            self.parts.append((key.copy(), [np.zeros(len(key)), more.copy()], 0.0))

    def find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.keys is None:
            keys = np.concatenate([np.empty(0, np.int64), *(k for k, _, _ in self.parts)])
            order = np.argsort(keys)
            self.keys, keys = keys[order], None
            self.adds = np.zeros((3, len(order) + 1))
            for row in self.adds[:2]:
                row[:-1] = np.concatenate([np.empty(0), *(x.pop(0) for _, x, _ in self.parts)])[order]
            self.adds[2, :-1] = np.concatenate([np.empty(0), *(np.full(len(k), known) for k, _, known in self.parts)])[order]
            self.parts = []
        at = np.searchsorted(self.keys, key)
        found = at < len(self.keys)
        found[found] = self.keys[at[found]] == key[found]
        at[~found] = len(self.keys)
        return self.adds[:, at], found


def _looked_up(unknown: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows in order of bucket and kind: takes a bucket's values, then sums up what its keys add to each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, values = None, None
        for batch in batches:
            keep, made = [], {c: [] for c in ("kind", "block", "a", "b")}
            for i, (bucket, kind) in enumerate(zip(batch.column("bucket").to_pylist(), batch.column("kind").to_pylist(), strict=True)):
                if bucket != now:
                    now, values = bucket, _Values()
                if kind == INFO:
                    keep.append(i)
                    continue
                a, b = batch.column("a")[i].as_buffer(), batch.column("b")[i].as_buffer()
                if kind < INFO:
                    values.take(kind, a, b)
                    continue
                docs = np.frombuffer(b, np.int32)
                adds, found = values.find(np.frombuffer(a, np.int64))
                if kind == TOKENS:
                    adds[:2, ~found] = unknown
                heads = np.flatnonzero(np.concatenate((np.ones(1, bool), np.diff(docs) != 0)))
                for name, x in (("kind", kind), ("block", batch.column("block")[i].as_py()), ("a", docs[heads].tobytes()), ("b", np.add.reduceat(adds, heads, axis=1).T.tobytes())):
                    made[name].append(x)
            if keep:
                yield batch.take(pa.array(keep))
            if made["kind"]:
                yield _rows(len(made["kind"]), **made)
        values = None
        give_back()

    return run


def _combined(n_tokens: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows in order of block and kind: a block's documents, then what the buckets add to them."""

    def out(info: dict, sums: np.ndarray) -> pa.RecordBatch:
        cols = [pa.array(info["ids"], pa.int64()), pa.array(info["held"], pa.bool_()), pa.array(info["sizes"], pa.int64()), pa.array(np.rint(sums[:, 2]).astype(np.int64)), pa.array(np.full(len(sums), n_tokens, np.int64)), pa.array(sums[:, 0]), pa.array(sums[:, 1])]
        return pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in SCORE_SCHEMA.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        info, sums = None, None
        for batch in batches:
            for i, kind in enumerate(batch.column("kind").to_pylist()):
                docs, added = np.frombuffer(batch.column("a")[i].as_buffer(), np.int32), np.frombuffer(batch.column("b")[i].as_buffer(), np.float64).reshape(-1, 3)
                if kind == INFO:
                    if info:
                        yield out(info, sums)
                    info, sums = {c: batch.column(c)[i].as_py() for c in ("ids", "held", "sizes")}, added.copy()
                else:
                    sums[docs] += added
        if info:
            yield out(info, sums)

    return run


def scores(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH) -> DataFrame:
    """One row per document: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    Tokens are words in lower case (A-Z) and one end per text. The tree's root holds the smoothed frequencies of all
    tokens. Every context of up to ``depth`` tokens with 50 occurrences is a state if its next symbols, those that come
    twice or more, pass the divergence test; a token is scored in the longest state that ends before it. Counts cover
    every text that isn't held out.

    Tables hold all tokens and states. The most frequent tokens' and runs' values, of fixed numbers at any corpus size,
    are broadcast. Other keys are dealt by hash into buckets, a row of keys for each block of documents and bucket;
    there they meet their values, a bounded number at once, and what they add comes back to the block. Tokens and runs
    are compared by 64-bit hashes: of n different ones about n * n / 2^65 pairs share a hash and then their counts.

    A null text counts as empty and has one token, the end. A null id isn't held out by a null condition. Repeated rows
    are scored and learned from like others. Other columns are not read. An empty table gives an empty result.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), text_or_empty(text_col).alias("text"))
    model, n_tokens, level = train(own.where("not held_out"), depth)
    drop(*model.states, *model.entries)
    buckets = max(1, -(-(model.runs.count() + model.tokens.count()) // BUCKET_ROWS))
    dealt = _asked(own, model, level, buckets).repartitionById(buckets, "bucket").sortWithinPartitions("bucket", "kind")
    sums = dealt.mapInArrow(_looked_up(model.unknown), _ROWS).select("block", "kind", "a", "b", "ids", "held", "sizes")
    return sums.repartition(shuffle_width(docs.sparkSession), "block").sortWithinPartitions("block", "kind").mapInArrow(_combined(n_tokens), SCORE_SCHEMA)
