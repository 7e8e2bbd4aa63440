"""LM scoring: a word unigram base over exact corpus counts, and a causal self-attention model over subword ids.

Texts are numbered once: a chunk of texts becomes parts of word numbers beside a dictionary of its distinct words. Words are
counted, cut into subwords and scored from the inside once each, whatever their frequency; what is told of them goes back
to the chunks, whose tokens are then scored in their places.

A word's probability has three parts. Outside: attention over what ended the words before it tells its first subword
(windows of 16 words that overlap by 8). Inside: attention over the word's own subwords tells the next of them, or the
word's end. And the corpus: the word's share of all training tokens, mixed in by a weight that training tokens choose, each with
itself left out of the share.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_type

from photonflow.llm import attention
from photonflow.llm.common import byte_rows, cut, discard, settle, space_words

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Subword pattern of the byte-level vocabulary: fixed value.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Tokens of a chunk, whose texts share a dictionary, and of a part of it, which is a row. One long text may exceed them.
CHUNK = 1 << 23
PART = 1 << 17
#: Words of a dictionary in a row, and words computed together.
ENTRIES = 1 << 16
SOME = 1 << 16
#: Words whose telling goes back to the chunks together.
TOGETHER = 1 << 18
#: Rounds of training: each takes every so many parts, and each part is learned from in one of them.
ROUNDS = 2
#: Windows of a step.
STEP = 1024
RATE = 0.01


class Subwords:
    """Subword ids of words, each after a space; END is one more than the largest id, and what the empty word is made of."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoder = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.end = max(ranks.values()) + 1
        self.opens = np.zeros(self.end + 1, bool)
        self.opens[[i for token, i in ranks.items() if token.startswith(b" ")]] = True

    def ids(self, word: bytes) -> list[int]:
        return self.encoder.encode_ordinary(" " + word.decode()) if word else [self.end]

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all the words' subwords, and where each word begins."""
        if b"" not in words:
            ids = np.array(self.encoder.encode_ordinary(" " + b" ".join(words).decode()), np.int32)
            starts = np.flatnonzero(self.opens[ids])
            if len(starts) == len(words):
                return ids, starts
        each = [self.ids(w) for w in words]
        return np.array([i for e in each for i in e], np.int32), np.cumsum([0, *map(len, each[:-1])])


@lru_cache(maxsize=2)
def subwords_of(path: str) -> Subwords:
    """A worker reads the vocabulary once for all its tasks."""
    return Subwords(path)


@dataclass
class Vocabulary:
    """Rank of each subword id (from the most frequent), and ln of its share among the ids that are predicted together."""

    rank: np.ndarray
    share: np.ndarray

    @classmethod
    def of(cls, counts: np.ndarray) -> Vocabulary:
        order = np.argsort(-counts, kind="stable")
        rank = np.empty(len(counts), np.int32)
        rank[order] = np.arange(len(counts))
        share = np.zeros(len(counts))
        rest = order[attention.OUTPUTS :]
        share[rest] = np.log((counts[rest] + 1) / (counts[rest] + 1).sum())  # every id keeps some chance
        return cls(rank, share)

    def inputs(self, ids: np.ndarray) -> np.ndarray:
        return np.minimum(self.rank[ids], attention.RANKS - 1)

    def outputs(self, ids: np.ndarray) -> np.ndarray:
        return np.minimum(self.rank[ids], attention.OUTPUTS)


@dataclass
class Net:
    """An attention model: what it predicts, its tables and its weights."""

    vocabulary: Vocabulary
    outputs: attention.Outputs
    weights: np.ndarray

    def log_probability(self, scorer: attention.Scorer, before: np.ndarray, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """ln of the probability of each id, given the input rank before each, in sequences that begin at starts."""
        inputs, places = attention.windows(before, starts)
        targets = self.outputs.targets(self.vocabulary.rank[ids])
        live = places >= 0
        out = np.empty(len(ids))
        out[places[live]] = scorer.log_probability(inputs, targets[places])[live]
        return out + self.vocabulary.share[ids]


class _Known(dict):
    """Numbers of words, in the order in which they were first seen; END, the empty word, is 0."""

    def __init__(self):
        self[b""] = 0

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _squeezed(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)


def _plain(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)


def _planes(values: np.ndarray) -> bytes:
    """Values byte plane by byte plane, which pack better, and packed."""
    return _squeezed(np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes())


def _from_planes(data: bytes, kind: type = np.int32) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(_plain(data), np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _numbered(docs: DataFrame) -> DataFrame:
    """Rows of two kinds. Parts: chunk, and of some texts the ids, which of them teach, their tokens (END included) and the
    tokens' word numbers. Entries: chunk, the number of the first word, packed words (space-joined) and how often each occurs in texts that teach."""
    kind = docs.schema["id"].dataType
    kinds = {"chunk": pa.int64(), "ids": pa.list_(to_arrow_type(kind)), "train": pa.list_(pa.bool_()), "sizes": pa.list_(pa.int32()), "index": pa.binary(), "place": pa.int32(), "words": pa.binary(), "counts": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 24
        ids: list = []
        train: list[bool] = []
        sizes: list[int] = []
        index, known, counts, tokens = array("i"), _Known(), np.zeros(1, np.int64), 0

        def row(**values: object) -> pa.RecordBatch:
            return pa.record_batch([pa.array([values.get(n)], k) for n, k in kinds.items()], names=list(kinds))

        def part() -> pa.RecordBatch:
            nonlocal counts
            which = np.frombuffer(index, np.int32)
            more = np.bincount(which[np.repeat(np.array(train), sizes)], minlength=len(known))
            counts = np.append(counts, np.zeros(len(known) - len(counts), np.int64)) + more
            return row(chunk=chunk, ids=ids, train=train, sizes=sizes, index=_planes(which))

        def entries() -> Iterator[pa.RecordBatch]:
            words = list(known)
            for i in range(0, len(words), ENTRIES):
                yield row(chunk=chunk, place=i, words=_squeezed(b" ".join(words[i : i + ENTRIES])), counts=_planes(counts[i : i + ENTRIES]))

        for batch in batches:
            for (key, text), teaches in zip(byte_rows(batch, "id", "text"), batch.column("train").to_pylist(), strict=True):
                words = space_words(text.lower() if text else text)
                index.extend(map(known.__getitem__, words))
                index.append(0)
                ids.append(key)
                train.append(teaches)
                sizes.append(len(words) + 1)
                if len(index) >= PART:
                    tokens += len(index)
                    yield part()
                    ids, train, sizes, index = [], [], [], array("i")
                    if tokens >= CHUNK:
                        yield from entries()
                        chunk, known, counts, tokens = chunk + 1, _Known(), np.zeros(1, np.int64), 0
        if ids:
            yield part()
        if ids or tokens:
            yield from entries()

    return docs.mapInArrow(run, f"chunk long, ids array<{kind.simpleString()}>, train array<boolean>, sizes array<int>, index binary, place int, words binary, counts binary")


def _words(chunks: DataFrame) -> DataFrame:
    """word, chunk, place, c, head: each chunk's words with their counts in the whole corpus; head is true once a word.

    A word has a row a chunk at most, so none weighs much more than another, however frequent it is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, place, words, counts in zip(*(batch.column(c) for c in ("chunk", "place", "words", "counts")), strict=True):
                blob = _plain(words.as_py())
                gaps = np.flatnonzero(np.frombuffer(blob, np.uint8) == 32)
                data = blob.replace(b" ", b"")
                n = len(gaps) + 1
                offsets = np.concatenate([[0], gaps - np.arange(n - 1), [len(data)]]).astype(np.int32)
                column = pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(data)])
                yield pa.record_batch([column, pa.array(np.full(n, chunk.as_py())), pa.array(np.arange(n, dtype=np.int32) + np.int32(place.as_py())), pa.array(_from_planes(counts.as_py(), np.int64))], names=["word", "chunk", "place", "n"])

    rows = chunks.where("words is not null").select("chunk", "place", "words", "counts").mapInArrow(run, "word binary, chunk long, place int, n long")
    word = W.partitionBy("word").orderBy("chunk")
    whole = F.sum("n").over(word.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return rows.withColumns({"c": whole, "head": F.row_number().over(word) == 1}).drop("n")


def _some(batches: Iterator[pa.RecordBatch], encoder: Subwords) -> Iterator[tuple[np.ndarray, ...]]:
    """Words some at a time: counts, subword ids and where each word begins; END itself is left out."""
    for batch in batches:
        for at in range(0, len(batch), SOME):
            part = batch.slice(at, SOME)
            words, c = part.column("word").to_pylist(), part.column("c").to_numpy(zero_copy_only=False)
            if b"" in words:
                keep = [i for i, w in enumerate(words) if w]
                words, c = [words[i] for i in keep], c[keep]
            if words:
                yield (c, *encoder.encode(words))


def _sums(df: DataFrame, task: Callable, size: int) -> np.ndarray:
    """Element-wise sums of the arrays that `task` makes of each partition. A task's own is pre-aggregated; `size` bounds all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = task(batches)
        for i in range(0, size, 1 << 16):
            seen = i + np.flatnonzero(total[i : i + (1 << 16)])
            if len(seen):
                yield pa.record_batch([pa.array(seen.astype(np.int32)), pa.array(total[seen])], names=["i", "v"])

    out = np.zeros(size)
    found = df.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()
    out[found.column("i").to_numpy()] = found.column("v").to_numpy()
    return out


def _ranks(words: DataFrame, path: str) -> tuple[Vocabulary, Vocabulary, Vocabulary]:
    """Vocabularies of all subwords (inputs), of first ones and END (outside), of further ones and a word's end (inside)."""
    size = subwords_of(path).end + 1

    def task(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        encoder = subwords_of(path)
        total = np.zeros((2, size))
        for c, ids, starts in _some(batches, encoder):
            lengths = np.diff(np.append(starts, len(ids)))
            total[0] += np.bincount(ids[starts], c, size)
            rest = np.ones(len(ids), bool)
            rest[starts] = False
            roots = np.sqrt(c)
            total[1] += np.bincount(ids[rest], np.repeat(roots, lengths)[rest], size)
            total[1, encoder.end] += roots.sum()
        return total.ravel()

    outside, inside = _sums(words, task, 2 * size).reshape(2, size)
    ends = words.where("word = X''").select(F.sum("c")).first()[0] or 0
    outside[size - 1] = ends
    return Vocabulary.of(outside + inside), Vocabulary.of(outside), Vocabulary.of(inside)


def _inside(ids: np.ndarray, starts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """What follows each subword of each word (END after its last), and its place's word."""
    after = np.append(ids[1:], end)
    after[np.append(starts[1:], len(ids)) - 1] = end
    return after, np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(ids))))


WIDE = attention.OUTPUTS + 1
CELLS = (attention.RANKS + 1) * WIDE


def _fitted(rows: DataFrame, parts: Callable, vocabulary: Vocabulary, more: int = 0) -> tuple[Net, np.ndarray]:
    """A net trained on all parts: tables from one pass over their counts, weights from ROUNDS rounds in which each task trains on
    its own and the results are averaged by what they were taught. `parts` gives (input ranks before, ids, starts, weights,
    tell) for each part of a partition; tell gets the log probabilities of a part's targets as they are learned and returns
    `more` numbers, whose sums come back."""
    context = rows.sparkSession.sparkContext

    def table(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros(CELLS)
        for before, ids, _, weight, _ in parts(batches):
            np.add.at(total, before.astype(np.int64) * WIDE + vocabulary.outputs(ids), weight)
        return total

    outputs = attention.Outputs.of(_sums(rows, table, CELLS).reshape(-1, WIDE))
    weights, told, size = attention.start_weights(), np.zeros(more), attention.SIZE
    made = context.broadcast(outputs)
    for turn in range(ROUNDS):
        now = context.broadcast(weights)

        def learn(batches: Iterator[pa.RecordBatch], now=now, turn=turn) -> np.ndarray:
            adam = attention.Adam(now.value, RATE / (1 + 2 * turn))
            rng = np.random.default_rng(turn)
            taught, extra = 0.0, np.zeros(more)
            for at, (before, ids, starts, weight, tell) in enumerate(parts(batches)):
                if at % ROUNDS != turn:
                    continue
                inputs, places = attention.windows(before, starts)
                live = places >= 0
                targets = np.where(live, made.value.targets(vocabulary.rank[ids])[places], 0)
                teach = np.where(live, weight[places], 0).astype(np.float32)
                logs = np.empty(len(ids))
                order = rng.permutation(len(inputs))
                for i in range(0, len(order), STEP):
                    pick = order[i : i + STEP]
                    x, y = inputs[pick], targets[pick]
                    found, grad = attention.gradient(adam.weights, made.value, x, y, teach[pick])
                    adam.step(grad)
                    if more:
                        found = found + made.value.members[x[:, attention.STRIDE :].ravel(), y.ravel()]
                        logs[places[pick][live[pick]]] = found[live[pick].ravel()]
                taught += float(teach.sum())
                if more:
                    extra += tell(logs + vocabulary.share[ids])
            return np.concatenate([np.append(adam.weights.astype(np.float64), 1.0) * taught, extra])

        found = _sums(rows, learn, size + 1 + more)
        told += found[size + 1 :]
        if found[size]:
            weights = (found[:size] / found[size]).astype(np.float32)
        now.unpersist()
    return Net(vocabulary, outputs, weights), told


def _inner(words: DataFrame, inputs: Vocabulary, inside: Vocabulary, path: str) -> Net:
    """The net inside words, from every distinct training word; a word weighs as the square root of its count."""
    end = subwords_of(path).end

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for c, ids, starts in _some(batches, subwords_of(path)):
            after, owner = _inside(ids, starts, end)
            yield inputs.inputs(ids), after, starts, np.sqrt(c)[owner], None

    return _fitted(words, parts, inside)[0]


#: What is told of a word: its count, ln of its inside's probability, first and last subword; and its number in its chunk.
TOLD = {"c": np.int64, "own": np.float32, "first": np.int32, "last": np.int32}
PLACED = {"place": np.int32} | TOLD


def _told(words: DataFrame, inputs: Vocabulary, inner, path: str) -> DataFrame:
    """Rows of chunk and, as arrays, what is told of some of its words: as many as a task meets together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, net = subwords_of(path), inner.value
        scorer = attention.Scorer(net.weights, net.outputs)
        held: list[tuple[np.ndarray, ...]] = []

        def out() -> pa.RecordBatch:
            chunk, *values = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.argsort(chunk, kind="stable")
            chunk = chunk[order]
            edges = [0, *(np.flatnonzero(chunk[1:] != chunk[:-1]) + 1).tolist(), len(chunk)]
            binaries = [pa.array([_planes(v[order[i:j]]) for i, j in zip(edges, edges[1:], strict=False)], pa.binary()) for v in values]
            return pa.record_batch([pa.array(chunk[edges[:-1]]), *binaries], names=["chunk", *PLACED])

        for batch in batches:
            coded = batch.column("word").dictionary_encode()
            distinct = coded.dictionary.to_pylist()
            ids, starts = encoder.encode(distinct)
            after, owner = _inside(ids, starts, encoder.end)
            logs = np.bincount(owner, net.log_probability(scorer, inputs.inputs(ids), after, starts), len(distinct))
            first, last = ids[starts], ids[np.append(starts[1:], len(ids)) - 1]
            logs[first == encoder.end] = 0
            which = coded.indices.to_numpy(zero_copy_only=False)
            chunk, place, c = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("chunk", "place", "c"))
            held.append((chunk, place, c, logs[which].astype(np.float32), first[which], last[which]))
            if sum(len(h[0]) for h in held) >= TOGETHER:
                yield out()
        if held:
            yield out()

    return words.select("word", "chunk", "place", "c").mapInArrow(run, ", ".join(["chunk long", *(f"{n} binary" for n in PLACED)]))


def _complete(chunks: DataFrame, told: DataFrame) -> DataFrame:
    """The parts of all chunks, each with a dictionary of its own: what is told of its distinct words, by new word numbers."""
    kept = ["ids", "train", "sizes"]

    def run(parts: pa.Table, words: pa.Table) -> pa.Table:
        told = {n: np.concatenate([_from_planes(x.as_py(), kind) for x in words.column(n)]) for n, kind in PLACED.items()}
        at = np.empty_like(told["place"])
        at[told["place"]] = np.arange(len(at))
        number = np.zeros(len(at), np.int32)
        out = []
        for batch in parts.select([*kept, "index"]).to_batches(max_chunksize=1):
            index = _from_planes(batch.column("index")[0].as_py())
            here = np.flatnonzero(np.bincount(index))
            number[here] = np.arange(len(here))
            binaries = [_planes(number[index]), *(_planes(told[n][at[here]]) for n in TOLD)]
            out.append(pa.record_batch([*(batch.column(n) for n in kept), *(pa.array([x], pa.binary()) for x in binaries)], names=[*kept, "index", *TOLD]))
        return pa.Table.from_batches(out)

    kinds = dict(chunks.dtypes)
    schema = ", ".join([*(f"{n} {kinds[n]}" for n in kept), *(f"{n} binary" for n in ("index", *TOLD))])
    rows = chunks.where("index is not null").select("chunk", *kept, "index")
    # a chunk is a task's work, and seldom shares one
    partitions = min(4 * rows.select("chunk").distinct().count() + 1, 1 << 15)
    one, many = rows.repartition(partitions, "chunk"), told.repartition(partitions, "chunk")
    return one.groupBy("chunk").cogroup(many.groupBy("chunk")).applyInArrow(run, schema)


@dataclass
class Part:
    """Some texts, token by token (a text's last is END): where each begins, the input rank before each token, and what is told of it."""

    starts: np.ndarray
    before: np.ndarray
    first: np.ndarray
    own: np.ndarray
    c: np.ndarray


def _parts(batches: Iterator[pa.RecordBatch], inputs: Vocabulary, taught: bool) -> Iterator[tuple[pa.RecordBatch, Part]]:
    """Each row, and the part that it is: of all its texts, or of those that teach."""
    for batch in batches:
        for k in range(len(batch)):
            row = batch.slice(k, 1)
            told = {n: _from_planes(row.column(n)[0].as_py(), kind) for n, kind in TOLD.items()}
            index = _from_planes(row.column("index")[0].as_py())
            sizes = row.column("sizes").flatten().to_numpy(zero_copy_only=False)
            if taught:
                teaches = row.column("train").flatten().to_numpy(zero_copy_only=False).astype(bool)
                index, sizes = index[np.repeat(teaches, sizes)], sizes[teaches]
                if not len(sizes):
                    continue
            starts = np.cumsum(sizes, dtype=np.int64) - sizes
            before = np.empty(len(index), np.uint16)
            before[1:] = inputs.inputs(told["last"]).astype(np.uint16)[index[:-1]]
            before[starts] = attention.START
            yield row, Part(starts, before, told["first"][index], told["own"][index], told["c"][index])


def _outer(complete: DataFrame, inputs: Vocabulary, outside: Vocabulary, n: int) -> tuple[Net, float]:
    """The net of first subwords, from every training token; and the weight of the corpus's shares, by expectation and
    maximisation over each part's tokens, each of which is left out of its own share."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for _, p in _parts(batches, inputs, True):

            def tell(logs: np.ndarray, p=p) -> np.ndarray:
                odds = (p.c - 1) / max(1, n - 1) * np.exp(-np.maximum(logs + p.own, -600.0))
                weight = 0.5
                for _ in range(8):
                    weight = float((weight * odds / (weight * odds + 1 - weight)).mean())
                return np.array([weight * len(odds), len(odds)])

            yield p.before, p.first, p.starts, np.ones(len(p.first)), tell

    net, told = _fitted(complete, parts, outside, 2)
    return net, float(np.clip(told[0] / told[1], 0.01, 0.99)) if told[1] else 0.5


@dataclass
class Model:
    """What texts are scored by: the net of first subwords, the corpus's weight, training tokens and distinct ones."""

    inputs: Vocabulary
    outer: Net
    corpus: float
    n: int
    v: int

    def scores(self, scorer: attention.Scorer, p: Part) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text of a part: known tokens, base score, score."""
        logs = self.outer.log_probability(scorer, p.before, p.first, p.starts) + p.own
        with np.errstate(divide="ignore"):
            shares = np.log(p.c / max(1, self.n))
        mixed = np.logaddexp(np.log(1 - self.corpus) + logs, np.log(self.corpus) + shares) / np.log(10)
        base = np.log10(p.c + 1) - np.log10(self.n + self.v + 1)
        return tuple(np.add.reduceat(x, p.starts) for x in ((p.c > 0).astype(np.int64), base, mixed))


def _score(complete: DataFrame, model: Model) -> DataFrame:
    kind = complete.schema["ids"].dataType.elementType
    id_type = to_arrow_type(kind)
    made = complete.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = made.value
        scorer = attention.Scorer(m.outer.weights, m.outer.outputs)
        for row, p in _parts(batches, m.inputs, False):
            known, base, score = m.scores(scorer, p)
            ids, sizes = row.column("ids").flatten(), row.column("sizes").flatten()
            columns = [ids.cast(id_type), sizes.cast(pa.int64()), pa.array(known), pa.array(base), pa.array(score)]
            yield pa.record_batch(columns, names=["id", "n_tokens", "n_known", "base_score", "score"])

    return complete.mapInArrow(run, f"id {kind.simpleString()}, n_tokens long, n_known long, base_score double, score double")


def score(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY) -> DataFrame:
    """One row per row of docs: id, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are words between ASCII white space, A-Z lowered, then one end; a null text has the end alone. base_score
    adds up log10((c + 1) / (N + V + 1)) over them, with c, N, V counted over all training texts, exactly. score is log10
    of the model's probability of the text; the model learns from all training texts. Rows where `training` is null don't
    teach. Ids may repeat or be null; equal texts get equal scores; an empty table gives no rows; other columns are not read.
    A text is held whole by the task that scores it: beside its bytes, a very long one takes some 60 bytes a token.

    Words are dealt by word, with a row for each chunk of texts that has it. path names a byte-level vocabulary file
    that every node has.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.coalesce(training, F.lit(False)).alias("train"))
    chunks = cut(_numbered(rows), "chunks")
    words = cut(_words(chunks), "words")
    settle(docs.sparkSession)
    known = words.where("head and c > 0").select("word", "c")
    n, v = known.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    inputs, outside, inside = _ranks(known, path)
    inner = docs.sparkSession.sparkContext.broadcast(_inner(known, inputs, inside, path))
    complete = cut(_complete(chunks, _told(words, inputs, inner, path)), "complete")
    discard(chunks, words)
    settle(docs.sparkSession)
    outer, corpus = _outer(complete, inputs, outside, n)
    found = _score(complete, Model(inputs, outer, corpus, n, v))
    return found.select(F.col("id").alias(id_col), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
