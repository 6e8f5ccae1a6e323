"""Language-model scores by online logistic context mixing.

A word is coded in two steps.  Its hash gives a class of BITS binary digits,
which are predicted one by one; within the class the word has its share of the
training counts.  Every digit is predicted by several contexts: the digits
before it alone, with the word before, and with the two words before.  Each
context has the counts of zeros and ones it met in training, under its own
hash.  The predictions are mixed in the logistic domain with
weights gated by the digit's place; after each digit the weights move along
the coding error, and an adaptive map refines the mixed probability.  Weights
and map start afresh in every document, so a score depends on the text and the
corpus only.

What is learnt covers every training document and grows with them: the counts
of words and of classes after each context are cut by hash into parts, more of
them the more text there is.  Documents are packed into batches of bounded
bytes.  A batch sends its own words and (context, class) pairs with their counts
to the parts; a part adds up the batches and answers each with what it asked
for, so no table is held in one place.  The parts take turns in ROUNDS rounds,
and so do the batches when they are scored; what a round shuffled is removed
before the next, so that it is not all on disk at once.  A context is 54 bits of
its hash and has at most CLASSES pairs a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.llm.words import hash_words, mix, slices
from chronoweave.session import scratch_path

FOLDS = 7
HELD_OUT_FOLD = 2
BITS = 10
CLASSES = 1 << BITS
SLOT_BITS = 20
ORDERS = 3  # digits alone, after one word, after two words
BATCH_BYTES = 8_000_000
PART_BYTES = 1 << 20  # text to each part of the counts
ROUNDS = 2
TOKENS_AT_ONCE = 200_000

FIRST_WEIGHTS = (1.0, 0.35, 0.25)
RATE = 0.02
MAP_CELLS = 12
MAP_RATE = 0.02
MAP_SHARE = 0.3
_CLIP = 8.0

_END = np.uint64(0xD6E8FEB86659FD93)
_START = np.uint64(0xA0761D6478BD642F)
_CLASS = np.uint64(CLASSES - 1)
_CODEC = pa.Codec("zstd")


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(token hashes, tokens of each text): its words, then one end."""
    found, counts = hash_words(texts)
    lengths = counts + 1
    ends = np.cumsum(lengths) - 1
    out = np.empty(int(lengths.sum()), np.uint64)
    is_end = np.zeros(len(out), bool)
    is_end[ends] = True
    out[is_end] = _END
    out[~is_end] = found
    return out, lengths


def _earlier(tokens: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The one and the two tokens before each token of the same text, as hashes."""
    starts = np.cumsum(lengths) - lengths
    one = np.concatenate(([_START], tokens[:-1]))
    one[starts] = _START
    two = np.concatenate(([_START], one[:-1]))
    two[starts] = _START
    return mix(one + np.uint64(1)), mix(one * np.uint64(3) + two * np.uint64(0x9E3779B97F4A7C15) + np.uint64(2))


def _digits(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in the tree of digits, digit) for each token and digit."""
    code = (tokens >> np.uint64(64 - BITS)).astype(np.uint32)[:, None]
    depth = np.arange(BITS, dtype=np.uint32)[None, :]
    node = (np.uint32(1) << depth) | (code >> (np.uint32(BITS) - depth))
    return node, (code >> (np.uint32(BITS - 1) - depth)) & np.uint32(1)


def _keys(tokens: np.ndarray, context: np.ndarray) -> np.ndarray:
    """Context and class of each token as one number; the classes of a context are neighbours."""
    return (context & ~_CLASS) | (tokens >> np.uint64(64 - BITS))


def _slots(context: np.ndarray, node: np.ndarray) -> np.ndarray:
    """Table cell of a context at a place."""
    x = (context >> np.uint64(32)).astype(np.uint32)[:, None] + node * np.uint32(0x9E3779B1)
    x ^= context.astype(np.uint32)[:, None]
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0xC2B2AE35)
    return x >> np.uint32(32 - SLOT_BITS)


# --- batches -----------------------------------------------------------------


def _pack(rows: list[pa.RecordBatch]) -> bytes:
    sink = pa.BufferOutputStream()
    table = pa.Table.from_batches(rows).combine_chunks()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=6))) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpack(blob: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(pa.BufferReader(blob)).read_all().combine_chunks().to_batches()[0]


def _batched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows packed into blobs of about BATCH_BYTES of text."""
    base = TaskContext.get().partitionId() << 32
    held: list[pa.RecordBatch] = []
    size = number = 0

    def emit() -> pa.RecordBatch:
        columns = [pa.array([base + number], pa.int64()), pa.array([size], pa.int64()), pa.array([_pack(held)], pa.large_binary())]
        return pa.RecordBatch.from_arrays(columns, ["batch", "size", "blob"])

    for batch in batches:
        text = batch.column(2).cast(pa.large_string()).fill_null("")
        batch = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), text], ["doc_id", "held_out", "text"])
        lo = 0
        lengths = np.cumsum(np.array(pa.compute.binary_length(text), dtype=np.int64))
        while lo < len(batch):
            before = int(lengths[lo - 1]) if lo else 0
            hi = min(len(batch), int(np.searchsorted(lengths, before + BATCH_BYTES - size)) + 1)
            held.append(batch.slice(lo, hi - lo))
            size += int(lengths[hi - 1]) - before
            lo = hi
            if size >= BATCH_BYTES:
                yield emit()
                held, size, number = [], 0, number + 1
                _release()
    if held:
        yield emit()


# --- what is learnt ------------------------------------------------------------


def _release() -> None:
    """Gives memory that Arrow has freed back, as workers live on."""
    pa.default_memory_pool().release_unused()


def _summed(values: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct values in order, their added counts, place of each given value among them)."""
    order = np.argsort(values, kind="stable")
    ordered = values[order]
    new = np.ones(len(values), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    first = np.flatnonzero(new)
    place = np.empty(len(values), np.int64)
    place[order] = np.cumsum(new) - 1
    return ordered[first], np.add.reduceat(n[order], first) if len(first) else n, place


def _gathered(rows: pa.RecordBatch) -> list[tuple[np.ndarray, np.ndarray]]:
    """The words and the (context, class) keys of a batch in order, each with its count in the batch's training texts."""
    found: tuple[list, list] = ([], [])
    for held_out in (False, True):
        held = rows.column("held_out")
        texts = rows.column("text").filter(held if held_out else pa.compute.invert(held))
        for lo, hi in slices(texts):
            tokens, lengths = _tokens(texts.slice(lo, hi - lo))
            keys = np.concatenate([_keys(tokens, c) for c in _earlier(tokens, lengths)])
            for parts, values in zip(found, (tokens, keys), strict=True):
                distinct, n = np.unique(values, return_counts=True)
                parts.append((distinct, n * (not held_out)))
    return [_summed(np.concatenate([v for v, _ in parts]), np.concatenate([n for _, n in parts]))[:2] for parts in found]


def _planes(x: np.ndarray) -> bytes:
    """Bytes of like place together, which packs better."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.dtype.itemsize).T.tobytes()


def _from_planes(data: bytes, at: int, n: int, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, n * width, at).reshape(width, n).T).view(kind).reshape(n)


def _squeezed(*parts: bytes) -> bytes:
    data = b"".join(parts)
    return len(data).to_bytes(8, "little") + _CODEC.compress(data, asbytes=True)


def _opened(blob: bytes) -> bytes:
    return _CODEC.decompress(blob[8:], int.from_bytes(blob[:8], "little"), asbytes=True)


def _asked(batches: Iterator[pa.RecordBatch], parts: int, turn: int = 0, rounds: int = 1) -> Iterator[pa.RecordBatch]:
    """(batch, part, blob): the words and keys of each batch and their counts, by ranges of their hashes.

    Of every `rounds` parts the one whose turn it is.
    """
    word_cuts = np.array([(p << 64) // parts for p in range(1, parts)], np.uint64)
    key_cuts = np.array([((p << 64 - BITS) // parts) << BITS for p in range(1, parts)], np.uint64)
    for batch in batches:
        for number, blob in zip(batch.column("batch").to_pylist(), batch.column("blob"), strict=True):
            both = _gathered(_unpack(blob.as_py()))
            ends = [np.concatenate(([0], np.searchsorted(v, cuts), [len(v)])) for (v, _), cuts in zip(both, (word_cuts, key_cuts), strict=True)]
            chosen, blobs = [], []
            for p in range(turn, parts, rounds):
                if any(e[p] < e[p + 1] for e in ends):
                    cut = [(v[e[p] : e[p + 1]], n[e[p] : e[p + 1]]) for (v, n), e in zip(both, ends, strict=True)]
                    packed = [x for v, n in cut for x in (_planes(np.diff(v, prepend=np.uint64(0))), _planes(n.astype(np.uint32)))]
                    chosen.append(p)
                    blobs.append(_squeezed(np.array([len(v) for v, _ in cut], np.int64).tobytes(), *packed))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(chosen), number)), pa.array(chosen, pa.int64()), pa.array(blobs, pa.binary())], ["batch", "part", "blob"])
            del both, blobs
            _release()


def _asked_for(blob: bytes) -> list[tuple[np.ndarray, np.ndarray]]:
    data = _opened(blob)
    at, out = 16, []
    for size in np.frombuffer(data, np.int64, 2).tolist():
        values = np.cumsum(_from_planes(data, at, size, np.uint64), dtype=np.uint64)
        out.append((values, _from_planes(data, at + 8 * size, size, np.uint32).astype(np.int64)))
        at += 12 * size
    return out


def met_along(keys: np.ndarray, n: np.ndarray) -> np.ndarray:
    """How often a key's context was met with a class of the same first 0, 1 .. BITS digits.

    All keys of a context must be there, in order.
    """
    sums = np.concatenate(([0], np.cumsum(n)))
    out = np.empty((len(keys), BITS + 1), np.int64)
    for d in range(BITS + 1):
        first = _first_of(keys, d)
        ends = np.append(first[1:], len(keys))
        out[:, d] = np.repeat(sums[ends] - sums[first], ends - first)
    return out


_ANSWERS = "batch long, part long, blob binary, totals binary"


def _first_of(keys: np.ndarray, d: int) -> np.ndarray:
    """Rows of sorted keys where another context or other first d digits begin."""
    return np.flatnonzero(np.concatenate((np.ones(min(1, len(keys)), bool), np.diff(keys >> np.uint64(BITS - d)) != 0)))


def _thin(keys: np.ndarray, met: np.ndarray) -> list[bytes]:
    """The count of each key, and upwards from it how often each place went the other way, once for each place."""
    return [_planes(met[:, BITS])] + [_planes((met[:, d] - met[:, d + 1])[_first_of(keys, d + 1)]) for d in reversed(range(BITS))]


def _thick(keys: np.ndarray, data: bytes, at: int) -> np.ndarray:
    """Logits for the digits of each key's class, be they zero or one, from the counts that _thin has packed."""
    out = np.empty((len(keys), BITS), np.float16)
    same = _from_planes(data, at, len(keys), np.int64)
    at += 8 * len(keys)
    for d in reversed(range(BITS)):
        first = _first_of(keys, d + 1)
        other = np.repeat(_from_planes(data, at, len(first), np.int64), np.diff(np.append(first, len(keys))))
        out[:, d] = np.clip(np.log((same + 0.4) / (other + 0.4)), -_CLIP, _CLIP)
        same = same + other
        at += 8 * len(first)
    return out


def _answers(table: pa.Table) -> pa.Table:
    """Answers of one part to all batches, and its totals by class in a row without a batch."""
    asked = [_asked_for(b.as_py()) for b in table.column("blob")]
    words, n_words, word_at = _summed(*(np.concatenate([a[0][i] for a in asked]) for i in (0, 1)))
    keys, n_keys, key_at = _summed(*(np.concatenate([a[1][i] for a in asked]) for i in (0, 1)))
    met = met_along(keys, n_keys)
    blobs, w, k = [], 0, 0
    for (own_words, _), (own_keys, _) in asked:
        counts, own_met = n_words[word_at[w : w + len(own_words)]], met[key_at[k : k + len(own_keys)]]
        blobs.append(_squeezed(np.array([len(own_words), len(own_keys)], np.int64).tobytes(), _planes(counts), *_thin(own_keys, own_met)))
        w, k = w + len(own_words), k + len(own_keys)
    kind = (words >> np.uint64(64 - BITS)).astype(np.int64)
    totals = np.zeros((2, CLASSES), np.int64)
    np.add.at(totals[0], kind, n_words)
    np.add.at(totals[1], kind, n_words > 0)
    part = table.column("part")[0].as_py()
    columns = [[*table.column("batch").to_pylist(), None], [part] * (len(blobs) + 1), [*blobs, None], [None] * len(blobs) + [_squeezed(totals.tobytes())]]
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    _release()
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["batch", "part", "blob", "totals"])


def _by_class(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for blob in batch.column("totals"):
            totals = np.frombuffer(_opened(blob.as_py()), np.int64).reshape(2, CLASSES)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES)), pa.array(totals[0]), pa.array(totals[1])], ["kind", "tokens", "words"])


def class_logits(class_tokens: np.ndarray) -> np.ndarray:
    """Logits of the digits alone, by place in the tree."""
    out = np.zeros(CLASSES)
    for depth in range(BITS):
        n = class_tokens.reshape(2 << depth, -1).sum(axis=1)
        out[1 << depth : 2 << depth] = np.log((n[1::2] + 0.4) / (n[0::2] + 0.4))
    return np.clip(out, -_CLIP, _CLIP).astype(np.float16)


def _received(answers: pa.Table, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts of a batch's words and logits of its keys, in the order of the batch's own."""
    counts, logits, done = [np.zeros(0, np.int64)], np.empty((len(keys), BITS), np.float16), 0
    blobs = answers.column("blob")
    for i in np.argsort(answers.column("part").to_numpy()).tolist():
        data = _opened(blobs[i].as_py())
        n_words, n_keys = np.frombuffer(data, np.int64, 2).tolist()
        counts.append(_from_planes(data, 16, n_words, np.int64))
        logits[done : done + n_keys] = _thick(keys[done : done + n_keys], data, 16 + 8 * n_words)
        done += n_keys
    return np.concatenate(counts), logits


# --- scoring -------------------------------------------------------------------


class Model:
    """Tables for the digits, and the size of each class in training."""

    def __init__(self, tables: list[np.ndarray], class_tokens: np.ndarray, class_words: np.ndarray):
        self.tables, self.class_tokens, self.class_words = tables, class_tokens, class_words
        self.train_tokens, self.train_words = int(class_tokens.sum()), int(class_words.sum())

    def after_words(self, order: int, tokens: np.ndarray, context: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Logits of each token's digits after its context, from a table of hashed cells."""
        return self.tables[order][_slots(context, node)]

    def digit_logs(self, tokens: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """log10 probability of the digits of each text.

        All texts advance together, token by token: the digits of one token
        have weights and maps of their own, so they are one array operation.
        """
        order = np.argsort(-lengths, kind="stable")
        sizes = lengths[order]
        active = np.searchsorted(-sizes, -np.arange(int(sizes[0])), "left")
        first = np.concatenate(([0], np.cumsum(active)))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        starts = np.cumsum(lengths) - lengths
        place = np.arange(len(tokens)) - np.repeat(starts, lengths)
        to = first[place] + np.repeat(rank, lengths)
        one, two = _earlier(tokens, lengths)
        moved = [np.empty_like(x) for x in (tokens, one, two)]
        for x, y in zip(moved, (tokens, one, two), strict=True):
            x[to] = y
        node, digit = _digits(moved[0])
        logits = np.empty((ORDERS, len(tokens), BITS), np.float32)
        logits[0] = self.tables[0][node]
        logits[1] = self.after_words(1, moved[0], moved[1], node)
        logits[2] = self.after_words(2, moved[0], moved[2], node)
        digit = digit.astype(np.float32)
        weights = np.empty((ORDERS, len(order), BITS), np.float32)
        weights[:] = np.array(FIRST_WEIGHTS, np.float32)[:, None, None]
        centres = np.linspace(-_CLIP, _CLIP, MAP_CELLS, dtype=np.float32)
        scale = (MAP_CELLS - 1) / (2 * _CLIP)
        maps = np.broadcast_to(1 / (1 + np.exp(-centres)), (len(order), BITS, MAP_CELLS)).astype(np.float32).reshape(-1)
        row = np.arange(len(order) * BITS, dtype=np.int64).reshape(len(order), BITS) * MAP_CELLS
        given = np.empty((len(tokens), BITS), np.float32)
        for t in range(len(active)):
            a, lo = int(active[t]), int(first[t])
            x, w, d = logits[:, lo : lo + a], weights[:, :a], digit[lo : lo + a]
            z = w[0] * x[0] + w[1] * x[1] + w[2] * x[2]
            np.minimum(np.maximum(z, -_CLIP, out=z), _CLIP, out=z)
            p = 1 / (1 + np.exp(-z))
            cell = row[:a] + np.rint((z + _CLIP) * scale).astype(np.int64)
            refined = maps[cell]
            final = p + MAP_SHARE * (refined - p)
            given[lo : lo + a] = np.where(d > 0, final, 1 - final)
            maps[cell] = refined + MAP_RATE * (d - refined)
            w += (RATE * (d - p)) * x
        logs = np.log10(np.clip(given, 1e-9, 1), dtype=np.float64).sum(axis=1)[to]
        return np.add.reduceat(logs, starts)


class BatchModel(Model):
    """The model with the counted contexts of one batch, in place of hashed cells."""

    def __init__(self, digits: np.ndarray, class_tokens: np.ndarray, class_words: np.ndarray, keys: np.ndarray, logits: np.ndarray):
        super().__init__([digits], class_tokens, class_words)
        self.keys, self.logits = keys, logits

    def after_words(self, order: int, tokens: np.ndarray, context: np.ndarray, node: np.ndarray) -> np.ndarray:
        logits = self.logits[np.searchsorted(self.keys, _keys(tokens, context))]
        return np.where(_digits(tokens)[1] > 0, logits, -logits)


def score_texts(texts: pa.Array, model: Model, words: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """n_tokens, n_known, base_score, score of each text; `words` (sorted) have `counts` in training."""
    tokens, lengths = _tokens(texts)
    at = np.minimum(np.searchsorted(words, tokens), max(0, len(words) - 1))
    c = np.where(words[at] == tokens, counts[at], 0) if len(words) else np.zeros(len(tokens), np.int64)
    starts = np.cumsum(lengths) - lengths
    base = np.log10((c + 1) / (model.train_tokens + model.train_words + 1))
    kind = (tokens >> np.uint64(64 - BITS)).astype(np.int64)
    inside = np.log10((c + 1) / (model.class_tokens[kind] + model.class_words[kind] + 1))
    digits = np.empty(len(texts))
    order = np.argsort(-lengths, kind="stable")
    bound = np.cumsum(lengths[order])
    lo = 0
    while lo < len(order):  # texts of like length together, a bounded number of tokens at once
        hi = max(lo + 1, int(np.searchsorted(bound, (bound[lo - 1] if lo else 0) + TOKENS_AT_ONCE, "right")))
        chosen = order[lo:hi]
        picked = np.repeat(starts[chosen] - (np.cumsum(lengths[chosen]) - lengths[chosen]), lengths[chosen]) + np.arange(int(lengths[chosen].sum()))
        digits[chosen] = model.digit_logs(tokens[picked], lengths[chosen])
        lo = hi
    return [lengths, np.add.reduceat((c > 0).astype(np.int64), starts), np.add.reduceat(base, starts), digits + np.add.reduceat(inside, starts)]


_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, n_bytes long, base_score double, score double"


def score_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, n_bytes, base_score, score, bits_per_byte.

    Training documents are those whose crc32(doc_id as text) mod 7 is not 2; a
    null doc_id counts as ''.  A null or empty text is one end token.  Scores
    are log10 probabilities; base_score is the add-one unigram's.  bits_per_byte
    is null for an empty text.  Every row is scored, repeated ones alike.
    """
    spark = docs.sparkSession
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold == HELD_OUT_FOLD).alias("held_out"), F.col(text).alias("text"))
    path = scratch_path(spark, "lm-batches")
    rows.mapInArrow(_batched, "batch long, size long, blob binary").write.option("compression", "none").parquet(path)
    batches = spark.read.schema("batch long, size long, blob binary").parquet(path)
    parts = max(1, -(-(batches.agg(F.sum("size")).first()[0] or 0) // PART_BYTES))
    answers = None
    for turn in range(min(ROUNDS, parts)):
        asked = batches.select("batch", "blob").mapInArrow(lambda b, turn=turn: _asked(b, parts, turn, ROUNDS), "batch long, part long, blob binary")
        found = _stored(asked.groupBy("part").applyInArrow(_answers, _ANSWERS), "lm-answers")
        answers = found if answers is None else answers.unionByName(found)
    by_class = answers.select("totals").filter("totals IS NOT NULL").mapInArrow(_by_class, "kind long, tokens long, words long")
    classes = by_class.groupBy("kind").agg(F.sum("tokens").alias("tokens"), F.sum("words").alias("words")).toArrow()
    class_tokens, class_words = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    class_tokens[classes["kind"].to_numpy()], class_words[classes["kind"].to_numpy()] = classes["tokens"].to_numpy(), classes["words"].to_numpy()
    shared = spark.sparkContext.broadcast((class_logits(class_tokens), class_tokens, class_words))

    def score(texts: pa.Table, answers: pa.Table) -> pa.Table:
        held = _unpack(texts.column("blob")[0].as_py())  # a batch is one row
        (words, _), (keys, _) = _gathered(held)
        counts, logits = _received(answers, keys)
        done = _scored(held, BatchModel(*shared.value, keys, logits), words, counts)
        _release()
        return pa.Table.from_batches(done)

    received = answers.filter("batch IS NOT NULL").select("batch", "part", "blob")
    scored = None
    for turn in range(ROUNDS):
        mine = F.pmod(F.xxhash64("batch"), F.lit(ROUNDS)) == turn
        own, told = batches.filter(mine).select("batch", "blob"), received.filter(mine)
        found = _stored(own.groupBy("batch").cogroup(told.groupBy("batch")).applyInArrow(score, _SCORED), "lm-scores")
        scored = found if scored is None else scored.unionByName(found)
    bits = -F.col("score") * float(np.log2(10)) / F.col("n_bytes")
    return scored.withColumn("bits_per_byte", F.when(F.col("n_bytes") > 0, bits))


def _stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written and read again; what the write shuffled is removed with its end."""
    spark, path, cleanup = df.sparkSession, scratch_path(df.sparkSession, name), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(cleanup, "false")
    spark.conf.set(cleanup, "true")
    try:
        df.write.option("compression", "none").parquet(path)
    finally:
        spark.conf.set(cleanup, before)
    return spark.read.schema(df.schema).parquet(path)


def _scored(held: pa.RecordBatch, model: Model, words: np.ndarray, counts: np.ndarray) -> list[pa.RecordBatch]:
    texts, out = held.column("text"), []
    for lo, hi in _pieces(texts):
        part = texts.slice(lo, hi - lo)
        lengths, known, base, total = score_texts(part, model, words, counts)
        columns = [
            held.column("doc_id").slice(lo, hi - lo), held.column("held_out").slice(lo, hi - lo), pa.array(lengths.astype(np.int64)),
            pa.array(known), pa.array(np.full(hi - lo, model.train_tokens)), pa.compute.binary_length(part).cast(pa.int64()), pa.array(base), pa.array(total),
        ]
        out.append(pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "n_bytes", "base_score", "score"]))
    return out


def _pieces(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch that are scored together."""
    lo = 0
    for _, hi in slices(texts):
        sizes = texts.slice(lo, hi - lo)
        if hi == len(texts) or pa.compute.sum(pa.compute.binary_length(sizes)).as_py() >= 1 << 22:
            yield lo, hi
            lo = hi
