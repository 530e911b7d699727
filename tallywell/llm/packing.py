"""Packing tokenized documents into sequences by a grouping genetic algorithm.

Documents are tokenized once and cut only where longer than a sequence.  Pieces
that fill a sequence get one of their own.  The others are dealt to blocks of about
``BLOCK_PIECES`` by their row's number, so equal rows part, and a block is packed after
Falkenauer (1996): an individual is a grouping of the pieces into bins; crossover
injects well-filled bins of one parent into the other, removes the bins that
hold duplicates of their pieces, and best-fits the pieces displaced, largest first.

Each block has ``ISLANDS`` populations, which are rows of a DataFrame.  In an epoch
every island evolves on its own, in parallel; then its elite migrates to the next
island, which is a shuffle by block and island.  At last each block takes its best
individual.  It keeps its fuller bins and passes on the emptiest quarter: the pieces in
these are packed anew, in blocks made of many blocks' leftovers, until one block
is left, which keeps all.  So what blocks waste is that of one block, and not a bin each.
Islands stop early only where nothing can be gained: at the lower bound, in the last round.

All random choices come from seeds fixed by round, block, island and epoch, so a task
that is run again gives the same rows.
"""

from __future__ import annotations

import functools
import os
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import pack, unpack
from .common import Workspace, configure, slices, tidy

MOST_TOKENS = 2048
#: Name of the public tokenizer file, and the id after each document.
TOKENIZER, END = "word_bpe_49k.json", 0
#: Pieces of a block on average, islands of a block, epochs, generations of an epoch, individuals of an island.
BLOCK_PIECES, ISLANDS, EPOCHS, GENERATIONS, INDIVIDUALS = 12_000, 2, 3, 4, 4
#: Bins of a block on average, at least.
LEAST_BINS = 16
#: Of a block's bins one in so many is passed on to the next round, the emptiest.
PASSED_ON = 4
#: Bytes of words and ids that a task keeps, and that a worker keeps for its next task.
MOST_KEPT, KEPT = 48 << 20, 12 << 20
#: Of a word that is kept, bytes besides its own and its ids'.
_EACH = 180


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Marks that can end a word; none begins a contraction or ends a special token.
_MARKS = b",.;:!?%*#$&"


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit numbers.

    This tokenizer takes white space away and no token goes across it, so a text is
    split at ASCII white space and each distinct word is tokenized once.  Nor does a
    token go across the end of a run of letters: marks after a word of letters are
    tokenized by themselves.  New words of letters are tokenized as one text
    of many, in which their last tokens, which end a word, tell them apart.
    """

    def __init__(self, path: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or tokenizer_path())
        suffix = self.tokenizer.model.end_of_word_suffix
        size = self.tokenizer.get_vocab_size()
        self.ends = np.array([bool(suffix) and (self.tokenizer.id_to_token(i) or "").endswith(suffix) for i in range(size)], bool)
        #: Ids by word, and about how many bytes they take.
        self.stems: dict[bytes, bytes] = {}
        self.held = 0

    def forget(self, most: int) -> None:
        """Keep the words met first, which are the common ones, up to so many bytes."""
        if self.held <= most:
            return
        old, self.stems, self.held = self.stems, {}, 0
        for w, ids in old.items():
            self.held += len(w) + len(ids) + _EACH
            if self.held > most:
                break
            self.stems[w] = ids

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and where each text's end."""
        lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        words = lists.flatten().dictionary_encode()
        ids = self.words(words.dictionary.cast(pa.binary()).to_pylist())
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        known = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), "<u4")))
        at = words.indices.to_numpy()
        sums = np.concatenate([[0], np.cumsum(sizes[at])])
        ends = lists.offsets.to_numpy()[1:] - lists.offsets.to_numpy()[0]
        return known.take(words.indices).flatten().to_numpy(), sums[ends]

    def words(self, words: list[bytes]) -> list[bytes]:
        """The ids of each of these words, as bytes."""
        if self.held > MOST_KEPT:
            self.forget(KEPT)
        stems = self.stems
        out: list[bytes] = []
        cut: list[tuple[int, bytes, bytes]] = []
        simple, other = [], []
        for w in words:
            if (got := stems.get(w)) is not None:
                out.append(got)
                continue
            stem = w.rstrip(_MARKS)
            if stem.isalpha():  # ASCII letters only: case makes no difference
                tail, stem = w[len(stem) :], stem.lower()
                if stem not in stems:
                    simple.append(stem)
            elif _letters(stem):
                tail = w[len(stem) :]
                if stem not in stems:
                    simple.append(stem)
            else:
                stem, tail = w, b""
                other.append(w)
            if tail and tail not in stems:
                other.append(tail)
            cut.append((len(out), stem, tail))
            out.append(b"")
        self._learn(list(dict.fromkeys(simple)), list(dict.fromkeys(other)))
        for i, stem, tail in cut:
            out[i] = stems[stem] + stems[tail] if tail else stems[stem]
        return out

    def _learn(self, simple: list[bytes], other: list[bytes]) -> None:
        for b in range(0, len(simple), 2000):
            part = simple[b : b + 2000]
            ids = np.array(self.tokenizer.encode(b" ".join(part).decode(), add_special_tokens=False).ids, "<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(part) or (len(ids) and ends[-1] != len(ids)):
                other += part
                continue
            data, begin = ids.tobytes(), 0
            for w, e in zip(part, (4 * ends).tolist()):
                self.stems[w] = data[begin:e]
                self.held += len(w) + e - begin + _EACH
                begin = e
        for b in range(0, len(other), 10_000):
            part = other[b : b + 10_000]
            got = self.tokenizer.encode_batch_fast([w.decode() for w in part], add_special_tokens=False)
            for w, e in zip(part, got):
                self.stems[w] = np.array(e.ids, "<u4").tobytes()
                self.held += len(w) + len(self.stems[w]) + _EACH


def _letters(stem: bytes) -> bool:
    """Whether the tokenizer takes a word as one run of letters: it is that, composed,
    and stays so in lower case."""
    if not stem:
        return False
    text = stem.decode()
    return text.isalpha() and text.lower().isalpha() and unicodedata.is_normalized("NFC", text)


@functools.lru_cache(maxsize=1)
def _encoder(path: str | None) -> Encoder:
    """Made once in a worker, which also keeps some of what it has tokenized for its next task."""
    return Encoder(path)


def token_pieces(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", most: int = MOST_TOKENS, path: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): a row for each piece of each document's
    ids, the last of which is ``END``; only the last piece is shorter than ``most``
    if there are several."""
    configure(docs.sparkSession)
    end = np.array([END], "<u4").tobytes()

    def each(batches):
        encoder = _encoder(path)
        for batch in slices(batches, "text", 10 << 20):
            row, piece, start, length, crc = [], [], [], [], []
            values, ends = encoder.encode(batch.column("text"))
            for i, (low, high) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist())):
                ids = values[low:high].tobytes() + end
                for k, b in enumerate(range(0, len(ids), 4 * most)):
                    part = ids[b : b + 4 * most]
                    for column, value in zip((row, piece, start, length, crc), (i, k, k * most, len(part) // 4, zlib.crc32(part))):
                        column.append(value)
            columns = [batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(c, pa.int64()) for c in (start, length, crc))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])
        encoder.forget(KEPT)
        tidy()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(each, "doc_id long, piece int, start long, length long, ids_crc32 long")


class Bins:
    """Open bins by the room left in them; the tightest that fits is found by one
    shift of a bit mask of the rooms that occur."""

    def __init__(self, capacity: int):
        self.capacity, self.mask, self.by_room = capacity, 0, {}

    def add(self, label: int, room: int) -> None:
        if room:
            self.by_room.setdefault(room, []).append(label)
            self.mask |= 1 << room

    def place(self, size: int, fresh: int) -> int:
        """The label of the bin that takes ``size``: the best fit, or ``fresh``."""
        fits = self.mask >> size
        if not fits:
            self.add(fresh, self.capacity - size)
            return fresh
        room = size + (fits & -fits).bit_length() - 1
        stack = self.by_room[room]
        label = stack.pop()
        if not stack:
            self.mask &= ~(1 << room)
        self.add(label, room - size)
        return label


def best_fit(sizes: np.ndarray, order: np.ndarray, capacity: int, labels: np.ndarray | None = None) -> np.ndarray:
    """Each piece's bin.  Pieces with a label (0 or more) keep it; those in ``order`` are
    placed one by one into the room that is left, and into new bins."""
    labels = np.full(len(sizes), -1, np.int64) if labels is None else labels
    kept = labels >= 0
    bins = Bins(capacity)
    fresh = 0
    if kept.any():
        fill = np.bincount(labels[kept], weights=sizes[kept]).astype(np.int64)
        used = np.bincount(labels[kept]) > 0
        for b in np.flatnonzero(used & (fill < capacity)).tolist():
            bins.add(b, capacity - int(fill[b]))
        fresh = len(fill)
    for i, size in zip(order.tolist(), sizes[order].tolist()):
        got = bins.place(size, fresh)
        fresh += got == fresh
        labels[i] = got
    return np.unique(labels, return_inverse=True)[1]


def fitness(labels: np.ndarray, sizes: np.ndarray, capacity: int) -> float:
    """Mean square of the bins' fill: for equal numbers of bins, uneven filling is better."""
    fill = np.bincount(labels, weights=sizes) / capacity
    return float((fill**2).mean()) if len(fill) else 1.0


def cross(one: np.ndarray, other: np.ndarray, sizes: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """``one`` with well-filled bins of ``other`` injected."""
    fill = np.bincount(other, weights=sizes)
    good = np.flatnonzero(fill >= np.quantile(fill, 0.5))
    chosen = rng.choice(good, max(1, len(good) // 3), replace=False)
    injected = np.isin(other, chosen)
    hit = np.isin(one, one[injected])  # bins that hold any of the injected pieces
    displaced = np.flatnonzero(hit & ~injected)
    labels = np.where(hit, -1, one)
    labels[injected] = other[injected] + (one.max() + 1)
    order = displaced[np.argsort(-sizes[displaced], kind="stable")]
    return best_fit(sizes, order, capacity, labels)


def mutate(one: np.ndarray, sizes: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """``one`` with its emptiest bins and a few others taken apart and packed again."""
    fill = np.bincount(one, weights=sizes)
    n = max(2, len(fill) // 50)
    out = np.union1d(np.argsort(fill)[:n], rng.choice(len(fill), min(n, len(fill)), replace=False))
    loose = np.flatnonzero(np.isin(one, out))
    order = loose[np.argsort(-sizes[loose] + rng.integers(0, 64, len(loose)), kind="stable")]
    return best_fit(sizes, order, capacity, np.where(np.isin(one, out), -1, one))


def fewest(sizes: np.ndarray, capacity: int) -> int:
    """No packing has fewer bins than this."""
    return max(-(-int(sizes.sum()) // capacity), int((2 * sizes > capacity).sum()))


def first_population(sizes: np.ndarray, capacity: int, individuals: int, rng: np.random.Generator) -> list[np.ndarray]:
    """Best-fit packings of the pieces in falling order, all but the first disturbed."""
    noise = [np.zeros(len(sizes), np.int64), *(rng.integers(0, capacity // 8 + 1, len(sizes)) for _ in range(individuals - 1))]
    return [best_fit(sizes, np.argsort(-(sizes + x), kind="stable"), capacity) for x in noise]


def evolve(population: list[np.ndarray], sizes: np.ndarray, capacity: int, individuals: int, generations: int, rng: np.random.Generator, least: int = 0) -> list[np.ndarray]:
    """The population after ``generations``, best first.  Fewer bins rank before fitness.
    It stops where the best has no more than ``least`` bins."""
    rank = lambda x: (x.max(initial=-1) + 1, -fitness(x, sizes, capacity))
    population = sorted(population, key=rank)[:individuals]
    for _ in range(generations):
        if population[0].max(initial=-1) + 1 <= max(least, 1):
            break
        children = []
        for _ in range(individuals):
            a, b = rng.integers(0, len(population), 2)
            child = cross(population[min(a, b)], population[max(a, b)], sizes, capacity, rng) if a != b else mutate(population[a], sizes, capacity, rng)
            children.append(child)
        population = sorted([*population, *children], key=rank)[:individuals]
    return population


def passed_on(labels: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Which bins are packed anew in the next round: one in PASSED_ON, two at least, the emptiest."""
    fill = np.bincount(labels, weights=sizes)
    out = np.zeros(len(fill), bool)
    out[np.argsort(fill, kind="stable")[: max(2, len(fill) // PASSED_ON)]] = True
    return out


def _evolved(pieces: DataFrame, number: int, blocks: int, most: int, islands: int, epochs: int, generations: int, individuals: int) -> DataFrame:
    """(row, length, sequence_id, offset) of pieces (row, length) shorter than a sequence: those of
    the bins that their blocks keep; the others' sequence_id is null."""
    pieces = pieces.select("row", "length", F.pmod(F.xxhash64("row", F.lit(number)), F.lit(blocks)).cast("int").alias("block"))
    island = "block int, island int, data binary"

    def ordered(table: pa.Table) -> pa.Table:
        return table.take(pc.sort_indices(table, sort_keys=[("row", "ascending")]))

    def row(block: int, to: int, sizes: np.ndarray, population: list[np.ndarray]) -> tuple:
        return block, to, pack(sizes.astype(np.uint32), [x.astype(np.uint32) for x in population])

    def table_of(rows: list[tuple]) -> pa.Table:
        b, i, d = zip(*rows)
        return pa.table({"block": pa.array(b, pa.int32()), "island": pa.array(i, pa.int32()), "data": pa.array(d, pa.binary())})

    def settle(table: pa.Table) -> pa.Table:
        block = table["block"][0].as_py()
        sizes = ordered(table)["length"].to_numpy()
        return table_of([row(block, k, sizes, first_population(sizes, most, individuals, np.random.default_rng([number, block, k]))) for k in range(islands)])

    def epoch(turn: int):
        def each(table: pa.Table) -> pa.Table:
            """All that has come to an island evolves; its elite goes to the next one too."""
            block, here = table["block"][0].as_py(), table["island"][0].as_py()
            population = []
            for data in sorted(table["data"].to_pylist()):
                sizes, come = unpack(data)
                sizes = sizes.astype(np.int64)
                population += [x.astype(np.int64) for x in come]
            least = fewest(sizes, most) if blocks == 1 else 0
            population = evolve(population, sizes, most, individuals, generations, np.random.default_rng([number, block, here, turn]), least)
            out = [row(block, here, sizes, population)]
            if islands > 1 and turn + 1 < epochs:
                out.append(row(block, (here + 1) % islands, sizes, population[:1]))
            return table_of(out)

        return each

    state = pieces.groupBy("block").applyInArrow(settle, island)
    for turn in range(epochs):
        state = state.groupBy("block", "island").applyInArrow(epoch(turn), island)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        table = ordered(left)
        rows, lengths = table["row"].to_numpy(), table["length"].to_numpy()
        best = None
        for data in sorted(right["data"].to_pylist()):
            for x in unpack(data)[1][:1]:
                x = x.astype(np.int64)
                mark = (x.max(initial=-1) + 1, -fitness(x, lengths, most))
                if best is None or mark < best[0]:
                    best = mark, x
        labels = best[1]
        order = np.argsort(labels, kind="stable")
        begins = np.flatnonzero(np.diff(labels[order], prepend=-1))
        each = np.diff(begins, append=len(order))
        sums = np.cumsum(lengths[order]) - lengths[order]
        offset, sequence = np.empty(len(labels), np.int64), np.empty(len(labels), np.int64)
        offset[order] = sums - np.repeat(sums[begins], each)
        sequence[order] = np.repeat(rows[order][begins], each)  # the number of its first row
        again = passed_on(labels, lengths)[labels] if blocks > 1 else np.zeros(len(labels), bool)
        columns = [table["row"], table["length"], pa.array(sequence, mask=again), pa.array(offset, mask=again)]
        return pa.Table.from_arrays(columns, ["row", "length", "sequence_id", "offset"])

    out = pieces.groupBy("block").cogroup(state.groupBy("block"))
    return out.applyInArrow(finish, "row long, length long, sequence_id long, offset long")


def pack_documents(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", most: int = MOST_TOKENS, path: str | None = None, block_pieces: int = BLOCK_PIECES, islands: int = ISLANDS, epochs: int = EPOCHS, generations: int = GENERATIONS, individuals: int = INDIVIDUALS
) -> DataFrame:
    """``token_pieces``'s rows with sequence_id and offset: the sequence that a piece
    is in and its place there, without gaps from 0.

    A null or empty text is one piece of one id.  Rows without an id and repeated rows
    are packed like any other, each by itself.  No rows give no rows.
    """
    work = Workspace(docs.sparkSession, "packing")
    pieces = token_pieces(docs, id_col=id_col, text_col=text_col, most=most, path=path)
    pieces = work.save(pieces.withColumn("row", F.monotonically_increasing_id()), "pieces")
    done, left, number, blocks = [], pieces.where(F.col("length") < most).select("row", "length"), 0, 1 << 31
    while (size := left.agg(F.count("*").alias("n"), F.sum("length").alias("tokens")).first()).n:
        blocks = max(1, min(round(size.n / block_pieces), size.tokens // (LEAST_BINS * most), blocks - 1))
        out = work.save(_evolved(left, number, blocks, most, islands, epochs, generations, individuals), f"round{number}")
        done.append(out.where("sequence_id IS NOT NULL").select("row", "sequence_id", "offset"))
        left, number = out.where("sequence_id IS NULL").select("row", "length"), number + 1
    found = pieces.where(F.col("length") >= most).select("row", F.col("row").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    for part in done:  # one for each power of PASSED_ON in the number of blocks
        found = found.unionByName(part)
    return pieces.join(found, "row").drop("row")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of up to 2048 tokens."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
