"""SentencePiece encoding and decoding by weighted finite-state transducers.

A model file is compiled to machines with states, arcs and weights:

- the normaliser reads the text and writes normalised text.  Its states are those of the
  model's double array of rules (the longest that fits is taken), with a bit that tells
  if a space was the last thing written; without rules it has one state;
- the piece transducer is a trie whose arcs read a character and whose final states write a
  piece, with a weight, and go back to the start;
- byte fallback reads a character that is no piece by itself and writes its bytes, or the
  unknown id, with a weight;
- for BPE models, an acceptor of neighbouring pieces: its states are the last piece.

An input is composed with them lazily, states being made when first reached, and the
shortest path in the tropical semiring (weights add up along a path, the least is taken)
is its encoding.

For unigram models a piece weighs the negative of its score.  For BPE models a
sequence of pieces is the encoding if and only if merging each two neighbours
alone leaves them as they are (Berglund and van der Merwe, 2023): the acceptor has
arcs for such pairs only, all of weight 0, so the only path left is the encoding.
Arcs of pairs are compiled when first met.

Where no piece has a space after another character or a line break, and no rule of the
normaliser looks beyond a character, texts are cut there, and stretches further between any
two characters that no piece has together.  The encodings of what is between are
kept, in each task up to ``MOST_KEPT`` bytes.
"""

from __future__ import annotations

import functools
import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import configure, slices, texts, tidy

#: Bytes of encoded stretches that a task keeps before it starts afresh, and that a worker keeps for
#: its next task; of a stretch, bytes besides its own and its ids'; pairs of pieces that are kept.
MOST_KEPT, KEPT, _EACH, MOST_PAIRS = 160 << 20, 96 << 20, 180, 400_000
#: Name of the public model file.
MODEL = "piece_bpe_32k.model"

SPACE = "▁"
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6
_UNIGRAM, _BPE = 1, 2
#: Of the acceptor: its start, and the state after a character that is no piece.
_START, _NO_PIECE = -1, -2


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Normaliser:
    """The transducer from text to normalised text."""

    def __init__(self, spec, user_pieces: list[str], space_last: bool):
        self.units, self.strings = (), b""
        if blob := spec.precompiled_charsmap:
            (size,) = struct.unpack_from("<I", blob)
            self.units, self.strings = struct.unpack_from(f"<{size // 4}I", blob, 4), blob[4 + size :]
        self.trim, self.space = spec.remove_extra_whitespaces, SPACE if spec.escape_whitespaces else " "
        self.front = spec.add_dummy_prefix and not space_last
        self.back = spec.add_dummy_prefix and space_last
        self.user = re.compile("|".join(map(re.escape, sorted(user_pieces, key=len, reverse=True)))) if user_pieces else None
        #: The arcs, where there are no rules: one state, which reads and writes a character.
        self.arcs = {ord(" "): self.space}

    @property
    def single(self) -> bool:
        """Whether it has one state, so that texts may be cut anywhere."""
        return not (self.units or self.trim or self.user)

    def _rule(self, data: bytes, at: int) -> tuple[bytes, int]:
        """What the longest rule at a place writes, and where it ends; a character by itself if
        there is none."""
        units, node, found = self.units, 0, None
        if units:
            node = (units[0] >> 10) << ((units[0] & 512) >> 6)
            for i in range(at, len(data)):
                node ^= data[i]
                unit = units[node]
                if unit & 0x800000FF != data[i]:
                    break
                node ^= (unit >> 10) << ((unit & 512) >> 6)
                if unit >> 8 & 1:
                    found = units[node] & 0x7FFFFFFF, i + 1
        if found:
            return self.strings[found[0] : self.strings.index(0, found[0])], found[1]
        lead = data[at]
        end = at + (1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4)
        return data[at:end], end

    def whole(self, text: str) -> str:
        """The output for a text, with the space that goes before or after it."""
        if not text:
            return ""
        if self.single:
            return (self.space if self.front else "") + self.part(text) + (self.space if self.back else "")
        data, at, out, spaced = text.encode(), 0, [], self.trim
        keeps = {m.start(): m.end() for m in self._user_spans(data)}

        def arc(at: int) -> tuple[bytes, int]:
            return (data[at : keeps[at]], keeps[at]) if at in keeps else self._rule(data, at)

        while self.trim and at < len(data) and arc(at)[0] == b" ":
            at = arc(at)[1]
        if at == len(data):
            return ""
        while at < len(data):
            got, at = arc(at)
            if spaced:
                got = got.lstrip(b" ")
            if got:
                out.append(got)
                spaced = self.trim and got.endswith(b" ")
        done = (self.space if self.front else "") + b"".join(out).decode().replace(" ", self.space)
        while self.trim and done.endswith(self.space):
            done = done[: -len(self.space)]
        return done + (self.space if self.back else "")

    def _user_spans(self, data: bytes):
        return re.finditer(self.user.pattern.encode(), data) if self.user else ()

    def part(self, text: str) -> str:
        """The output for a part of a text, of the machine with one state."""
        return text.translate(self.arcs)


class Pieces:
    """The piece transducer: of each state the arcs by character, and the piece and weight that are
    written on the way back to the start, if any."""

    def __init__(self, pieces: dict[str, tuple[int, float]]):
        self.arcs: list[dict[str, int]] = [{}]
        self.final: list[tuple[int, float] | None] = [None]
        for piece, out in pieces.items():
            state = 0
            for c in piece:
                if (to := self.arcs[state].get(c)) is None:
                    to = self.arcs[state][c] = len(self.arcs)
                    self.arcs.append({})
                    self.final.append(None)
                state = to
            self.final[state] = out


class Pairs:
    """The acceptor of a BPE model's neighbouring pieces: its states are pieces."""

    def __init__(self, text: list[str], score: list[float], ids: dict[str, int]):
        self.text, self.score, self.ids = text, score, ids
        self.rank = np.unique(-np.array(score), return_inverse=True)[1].tolist()
        self.arcs: dict[int, bool] = {}
        self.alone: dict[int, bool] = {}
        self.halves: dict[int, tuple[int, int]] = {}

    def has_arc(self, state: int, piece: int) -> bool:
        got = self.arcs.get(state << 20 | piece)
        if got is None:
            if len(self.arcs) > MOST_PAIRS:
                self.arcs.clear()
            got = self.arcs[state << 20 | piece] = self._alone(piece) and (state < 0 or self._apart(state, piece))
        return got

    def merged(self, text: str, parts_left: int = 1) -> list[str]:
        """What BPE's merges make of ``text``: the best-scored pair first, the leftmost of
        equals, until no more than ``parts_left`` parts are left."""
        parts = list(text)
        while len(parts) > parts_left:
            best, at = None, -1
            for i in range(len(parts) - 1):
                k = self.ids.get(parts[i] + parts[i + 1])
                if k is not None and (best is None or self.score[k] > best):
                    best, at = self.score[k], i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _apart(self, a: int, b: int) -> bool:
        """Whether merging the characters of both leaves no merge across the boundary:
        their merges are undone, the latest first, and at each point a merge across that
        would have come earlier (or, of equals, further left) decides."""
        text, rank, limit = self.text, self.rank, 1 << 30
        while True:
            across = self.ids.get(text[a] + text[b])
            if across is not None and rank[across] < limit:
                return False
            if len(text[a]) > 1 and (len(text[b]) == 1 or rank[a] > rank[b]):
                limit, a = rank[a], self._halves(a)[1]
            elif len(text[b]) > 1:
                limit, b = rank[b] + 1, self._halves(b)[0]
            else:
                return True

    def _halves(self, k: int) -> tuple[int, int]:
        """The two pieces whose merge gives piece k."""
        if (got := self.halves.get(k)) is None:
            left = self.merged(self.text[k], 2)
            got = self.halves[k] = (self.ids[left[0]], self.ids[left[1]])
        return got

    def _alone(self, k: int) -> bool:
        """Whether merging a piece's own characters gives the piece."""
        if (got := self.alone.get(k)) is None:
            got = self.alone[k] = self.merged(self.text[k]) == [self.text[k]]
        return got


class Transducer:
    """The compiled machines of one model file."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(model)
        kind = proto.trainer_spec.model_type
        if kind not in (_UNIGRAM, _BPE):
            raise NotImplementedError("only unigram and BPE models")
        kinds = [p.type for p in proto.pieces]
        if kind == _BPE and {_USER, _UNUSED} & {*kinds}:
            raise NotImplementedError("no BPE models with unused pieces or pieces defined by users")
        self.text = [p.piece for p in proto.pieces]
        score = [p.score for p in proto.pieces]
        ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type in (_NORMAL, _USER)}
        self.byte = {int(self.text[i][3:5], 16): i for i, k in enumerate(kinds) if k == _BYTE}  # <0x41>
        self.unknown = next((i for i, k in enumerate(kinds) if k == _UNKNOWN), 0)
        self.size = list(map(len, self.text))
        normal = [s for s, k in zip(score, kinds) if k == _NORMAL] or [0.0]
        if kind == _BPE:
            weights, self.penalty = {p: (k, 0.0) for p, k in ids.items()}, 0.0
            self.pairs: Pairs | None = Pairs(self.text, score, ids)
        else:
            own = {p: len(p.encode()) * max(normal) - 0.1 for p, k in ids.items() if kinds[k] == _USER}
            weights, self.penalty = {p: (k, -own.get(p, score[k])) for p, k in ids.items()}, 10 - min(normal)
            self.pairs = None
        self.normaliser = Normaliser(proto.normalizer_spec, [self.text[i] for i, k in enumerate(kinds) if k == _USER], proto.trainer_spec.treat_whitespace_as_suffix)
        self.pieces = Pieces(weights)
        #: Where normalised texts can be cut, if anywhere: before spaces and around line breaks.
        self.cut = None if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in ids) else re.compile(r"[ ▁]+[^ ▁\n]*|[^ ▁\n]+|\n")
        #: Bytes that each id stands for.
        self.surface = [b"" if k == _CONTROL else bytes([int(t[3:5], 16)]) if k == _BYTE else " \u2047 ".encode() if k == _UNKNOWN else t.replace(SPACE, " ").encode() for t, k in zip(self.text, kinds)]
        #: Neighbouring characters that some piece has; between others any text can be cut.
        self.together = {p[i : i + 2] for p in ids for i in range(len(p) - 1)}
        self.kept: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.held = 0

    def shortest(self, text: str) -> list[int]:
        """The ids on the shortest path of the composition with normalised text.

        Its states are a place in the text and a state of the acceptor; between two places
        the piece transducer is walked from its start.  A place is reached in one state of the
        acceptor at most: unigram models have but one, and in a BPE model the text up to a place has
        one encoding, whose last piece is the state.  So ``cost`` and ``last`` have, by
        place, the least weight and the piece that it came by.
        """
        n, arcs, final, size, pairs = len(text), self.pieces.arcs, self.pieces.final, self.size, self.pairs
        known = pairs.arcs if pairs else {}
        root, infinite = arcs[0], float("inf")
        cost, last = [infinite] * (n + 1), [_START] * (n + 1)
        cost[0] = 0.0
        for i in range(n):
            base = cost[i]
            if base == infinite:
                continue
            before = last[i]
            high = before << 20
            state, j, single = root.get(text[i]), i, False
            while state is not None:
                j += 1
                if (out := final[state]) is not None:
                    piece, weight = out
                    single |= j == i + 1
                    if base + weight < cost[j]:
                        if pairs is not None and (ok := known.get(high | piece)) is None:
                            ok = pairs.has_arc(before, piece)
                        if pairs is None or ok:
                            cost[j], last[j] = base + weight, piece
                state = arcs[state].get(text[j]) if j < n else None
            if not single and base + self.penalty < cost[i + 1]:
                cost[i + 1], last[i + 1] = base + self.penalty, _NO_PIECE
        out: list[int] = []
        at = n
        while at:
            piece = last[at]
            if piece >= 0:
                out.append(piece)
                at -= size[piece]
                continue
            if self.byte:
                out += [self.byte[b] for b in reversed(text[at - 1].encode())]
            elif not out or out[-1] != self.unknown:  # unknown characters side by side are one
                out.append(self.unknown)
            at -= 1
        return out[::-1]

    def encode(self, text: str) -> bytes:
        """The ids of ``text`` as little-endian unsigned 32-bit numbers."""
        if not text:
            return b""
        single = self.normaliser.single and self.cut is not None
        if single:  # stretches can be normalised by themselves
            whole = (" " if self.normaliser.front else "") + text + (" " if self.normaliser.back else "")
        else:
            whole = self.normaliser.whole(text)
        parts = self.cut.findall(whole) if self.cut else [whole]
        kept = self.kept
        try:
            ids = b"".join([kept[p] for p in parts])
        except KeyError:
            if self.held > MOST_KEPT:
                self.forget(KEPT)
                kept = self.kept
            for p in parts:
                if p not in kept:
                    kept[p] = self._stretch(self.normaliser.part(p) if single else p)
                    self.held += len(p) + len(kept[p]) + _EACH
            ids = b"".join([kept[p] for p in parts])
        return ids if self.byte else self._joined(ids)

    def _joined(self, ids: bytes) -> bytes:
        """Unknown ids side by side as one, also across cuts."""
        got = np.frombuffer(ids, "<u4")
        again = np.zeros(len(got), bool)
        again[1:] = (got[1:] == self.unknown) & (got[:-1] == self.unknown)
        return got[~again].tobytes()

    def forget(self, most: int) -> None:
        """Keep the stretches met first, which are the common ones, up to so many bytes."""
        if self.held <= most:
            return
        old, self.held = (self.kept, self.parts), 0
        self.kept, self.parts = {}, {}
        for new, (memory, share) in zip((self.kept, self.parts), zip(old, (most // 2, most))):
            for k, v in memory.items():
                self.held += len(k) + len(v) + _EACH
                if self.held > share:
                    break
                new[k] = v

    def _stretch(self, text: str) -> bytes:
        """The ids of a stretch, cut further where no piece can go across."""
        out, begin, together, known = [], 0, self.together, self.parts
        for i in range(1, len(text) + 1):
            if i == len(text) or text[i - 1 : i + 1] not in together:
                part = text[begin:i]
                if (got := known.get(part)) is None:
                    got = known[part] = np.array(self.shortest(part), "<u4").tobytes()
                    self.held += len(part) + len(got) + _EACH
                out.append(got)
                begin = i
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The text of such numbers; bytes that are no UTF-8 become U+FFFD."""
        surface = self.surface
        out = b"".join([surface[i] for i in np.frombuffer(ids, "<u4").tolist()])
        if self.normaliser.front and out[:1] == b" ":
            out = out[1:]
        if self.normaliser.back and out[-1:] == b" ":
            out = out[:-1]
        return out.decode(errors="replace")


@functools.lru_cache(maxsize=1)
def _encoder(path: str | None) -> Transducer:
    """Compiled once in a worker, which also keeps some of what it has encoded for its next task."""
    with open(path or model_path(), "rb") as f:  # a library's file, on every executor
        return Transducer(f.read())


def encode(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, check: bool = False) -> DataFrame:
    """(doc_id, ids) for each row of ``docs``: ids is a binary of little-endian unsigned
    32-bit numbers.  With ``check`` a third column, round_trip, tells if decoding them
    gives the text back (U+2581 in it counts as a space).

    Null and empty texts have no ids; rows without an id and repeated rows are encoded
    like any other.  ``path`` is the model file, the public one if None.
    """
    configure(docs.sparkSession)
    schema = "doc_id long, ids binary" + ", round_trip boolean" * check

    def each(batches):
        machine = _encoder(path)
        for batch in slices(batches, "text", 4 << 20):
            got = texts(batch.column("text"))
            ids = [machine.encode(t) for t in got]
            columns = [batch.column("doc_id"), pa.array(ids, pa.binary())]
            if check:
                columns.append(pa.array([machine.decode(i) == t.replace(SPACE, " ") for i, t in zip(ids, got)], pa.bool_()))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "round_trip"][: len(columns)])
        machine.forget(KEPT)
        tidy()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(each, schema)


def decode(encoded: DataFrame, *, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """(doc_id, text) for each row of ``encode``'s result; null ids give an empty text."""
    configure(encoded.sparkSession)

    def each(batches):
        machine = _encoder(path)
        for batch in batches:
            out = [machine.decode(x or b"") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col)).mapInArrow(each, "doc_id long, text string")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents: their number, their checksum, and whether they decode."""
    got = encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), check=True)
    return got.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_ids"), F.crc32("ids").alias("ids_crc32"), "round_trip")
