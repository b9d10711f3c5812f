"""SentencePiece encoding and decoding with a public vocabulary.

A text is normalised as the model asks (a leading space, spaces as U+2581) and
cut into units, a run of U+2581 with what follows; no piece crosses units.  For
the distinct new units of a batch one lattice is built, as a relation: all
substrings of bounded length are exploded and equi-joined to the piece table,
and the edges, grouped by unit, are folded into paths.  Two folds exist, as the
two model kinds need them:

* ``bpe``: adjacent edges join in order of score, leftmost first (BPE models,
  such as the 32k one); a Viterbi fold gives other pieces than such a model has;
* ``viterbi``: the path with the largest sum of scores (unigram models).

Characters without a piece become byte pieces.  ``word_lattice`` is the fully
relational form for a table of distinct words (explode, equi-join, group, and a
Viterbi fold with Spark's ``aggregate``).

Defined cases: null or empty text has no tokens and decodes to empty text;
U+2581 in a text decodes to a space (``round_trip`` is then false); repeated
rows give repeated results; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BASE, BASE_INVERSE, SPACES, ids_and_texts, mix, powers, table

SPACE = "▁"
UNIT = re.compile(f"{SPACE}+[^{SPACE}]*")

#: Larger than the rank of any piece.
NO_PIECE = 1 << 30
#: A vocabulary is sent to the executors whole only up to this size of its file.
MAX_MODEL_BYTES = 64 << 20
MOST_PIECES = 1_000_000
#: Units of up to so many characters, so many of them, make one lattice.
LATTICE_CHARS = 48
LATTICE_UNITS = 5_000
#: Distinct units a worker remembers before it starts afresh.
MAX_UNITS = 300_000


def default_model() -> str:
    """The 32k BPE model of the public tokenizers' folder."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _spans(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of codes[start:end]."""
    sums = np.empty(len(codes) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(codes)), out=sums[1:])
    h = (sums[end] - sums[start]) * powers(BASE_INVERSE, len(sums))[start]
    return mix(h ^ ((end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


class PieceTable:
    """The pieces by the hash of their characters, for equi-joins of whole arrays."""

    BITS = 18

    def __init__(self, vocabulary: Vocabulary):
        pieces = list(vocabulary.table)
        ends = np.cumsum([len(p) for p in pieces])
        keys = _spans(_codes("".join(pieces)), np.concatenate(([0], ends[:-1])), ends)
        ids = np.array([vocabulary.table[p][1] for p in pieces], dtype=np.int64)
        slot = (keys >> np.uint64(64 - self.BITS)).astype(np.int64)
        self.keys, self.ids = np.zeros(1 << self.BITS, dtype=np.uint64), np.full(1 << self.BITS, -1, dtype=np.int64)
        _, first = np.unique(slot, return_index=True)
        self.keys[slot[first]], self.ids[slot[first]] = keys[first], ids[first]
        rest = np.ones(len(keys), dtype=bool)  # pieces whose slot is taken
        rest[first] = False
        order = np.argsort(keys[rest])
        self.more, self.more_ids = keys[rest][order], ids[rest][order]

    def join(self, keys: np.ndarray) -> np.ndarray:
        """The id of each key's piece, or -1."""
        slot = (keys >> np.uint64(64 - self.BITS)).astype(np.int64)
        ids = np.where(self.keys[slot] == keys, self.ids[slot], -1)
        if len(self.more):
            open_ = np.flatnonzero((ids < 0) & (self.ids[slot] >= 0))
            at = np.minimum(np.searchsorted(self.more, keys[open_]), len(self.more) - 1)
            hit = self.more[at] == keys[open_]
            ids[open_[hit]] = self.more_ids[at[hit]]
        return ids


class Lattice:
    """Edges of many units: ids[p * (longest + 1) + n] is the piece of the n characters from place p of the joined units, or -1.

    All substrings of bounded length are exploded, unit by unit, and equi-joined
    to the piece table by their hashes; edges stay grouped by unit, as places do.
    """

    def __init__(self, units: list[str], table: PieceTable, longest: int):
        self.units = units
        lengths = np.array([len(u) for u in units], dtype=np.int64)
        self.bounds = np.concatenate(([0], np.cumsum(lengths)))
        self.codes = _codes("".join(units))
        self.unit = np.repeat(np.arange(len(units)), lengths)
        room = np.minimum(self.bounds[self.unit + 1] - np.arange(len(self.codes)), longest)
        start = np.repeat(np.arange(len(self.codes)), room)
        size = np.arange(1, len(start) + 1) - np.repeat(np.cumsum(room) - room, room)
        joined = table.join(_spans(self.codes, start, start + size))
        edges = np.flatnonzero(joined >= 0)
        self.edges = start[edges] * (longest + 1) + size[edges]
        self.joined = joined[edges]
        self.longest = longest
        self.ids = np.full(len(self.codes) * (longest + 1), -1, dtype=np.int32)
        self.ids[self.edges] = self.joined

    def fold(self, vocabulary: Vocabulary) -> list[bytes]:
        """The path of each unit by the rule of BPE: in every round each unit joins its best adjacent edges."""
        longest, wide = self.longest, self.longest + 1
        ranks = np.full(len(self.ids), NO_PIECE, dtype=np.int32)
        ranks[self.edges] = vocabulary.rank_of_id[self.joined]
        size = np.ones(len(self.codes), dtype=np.int64)
        starts, done = np.arange(len(self.codes)), []
        while len(starts):
            unit = self.unit[starts]
            both = size[starts[:-1]] + size[starts[1:]]
            rank = np.full(len(starts), NO_PIECE, dtype=np.int32)
            # an edge never crosses units, so places of other units hold no piece; neither do longer ones
            near = np.flatnonzero(both <= longest)
            rank[near] = ranks[starts[near] * wide + both[near]]
            first = np.flatnonzero(np.concatenate(([True], unit[1:] != unit[:-1])))
            counts = np.diff(np.append(first, len(starts)))
            best = np.repeat(np.minimum.reduceat(rank, first), counts)
            ended = best == NO_PIECE
            done.append(starts[ended])
            at = np.flatnonzero((rank == best) & ~ended)
            at = at[np.concatenate(([True], unit[at][1:] != unit[at][:-1]))] if len(at) else at
            size[starts[at]] += size[starts[at + 1]]
            stay = ~ended
            stay[at + 1] = False
            starts = starts[stay]
        starts = np.sort(np.concatenate(done)) if done else starts
        ids = self.ids[starts * wide + size[starts]]
        unknown = np.flatnonzero(ids < 0)
        if len(unknown):  # characters without a piece become bytes
            encoded = [[vocabulary.byte_ids[b] for b in chr(self.codes[p]).encode("utf-8", "surrogatepass")] for p in starts[unknown]]
            times = np.ones(len(ids), dtype=np.int64)
            times[unknown] = [len(e) for e in encoded]
            where = np.repeat(np.arange(len(ids)), times)
            ids = ids[where]
            ids[ids < 0] = np.concatenate(encoded)
            starts = starts[where]
        cuts = (np.searchsorted(starts, self.bounds) * 4).tolist()
        data = ids.tobytes()
        return [data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


class Vocabulary:
    """The pieces of a model: text, score and kind of each id."""

    def __init__(self, pieces: list[str], scores: list[float], byte_ids: list[int], plain: list[bool], algorithm: str = "bpe"):
        self.pieces, self.scores, self.byte_ids, self.algorithm = pieces, scores, byte_ids, algorithm
        self.table = {p: (s, i) for i, (p, s, ok) in enumerate(zip(pieces, scores, plain, strict=True)) if ok}
        self.longest = max(map(len, self.table), default=1)
        order = {score: k for k, score in enumerate(sorted({s for s, _ in self.table.values()}, reverse=True))}
        self.rank = {p: order[s] for p, (s, _) in self.table.items()}
        self.rank_of_id = np.full(len(pieces) + 1, NO_PIECE, dtype=np.int64)
        for p, (_, i) in self.table.items():
            self.rank_of_id[i] = self.rank[p]
        self._join: PieceTable | None = None
        self.model: bytes | None = None
        self.is_byte = np.zeros(len(pieces), dtype=bool)
        self.is_byte[byte_ids] = True
        self.is_fallback = self.is_byte.copy()
        self.is_fallback[[byte_ids[b] for b in SPACES]] = False
        self.bytes = [p.encode() for p in pieces]
        for b, i in enumerate(byte_ids):
            self.bytes[i] = bytes([b])

    @classmethod
    def load(cls, path: str, algorithm: str = "bpe") -> Vocabulary:
        import os

        import sentencepiece

        if os.path.getsize(path) > MAX_MODEL_BYTES:
            raise ValueError(f"{path} has more than {MAX_MODEL_BYTES} bytes")
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        plain = [not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) for i in ids]
        made = cls([model.id_to_piece(i) for i in ids], [model.get_score(i) for i in ids], [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], plain, algorithm)
        made.model = model.serialized_model_proto()
        return made

    def lattice(self, units: list[str]) -> Lattice:
        if self._join is None:
            self._join = PieceTable(self)
        return Lattice(units, self._join, self.longest)

    def encode_units(self, units: list[str]) -> list[bytes]:
        """The ids of each unit as int32 bytes: by lattice and fold, many units at once."""
        short = [u for u in units if len(u) <= LATTICE_CHARS] if self.algorithm == "bpe" else []
        found: dict[str, bytes] = {}
        for at in range(0, len(short), LATTICE_UNITS):
            part = short[at : at + LATTICE_UNITS]
            found.update(zip(part, self.lattice(part).fold(self), strict=True))
        return [found[u] if u in found else np.array(self.encode_unit(u), dtype=np.int32).tobytes() for u in units]

    def encode_unit(self, unit: str) -> list[int]:
        if self.algorithm == "viterbi":
            return self._ids(unit, self._viterbi(unit))
        return self._ids(unit, self._merge(unit) if len(unit) > 48 else self._merge_short(unit))

    def _ids(self, unit: str, cuts: list[int]) -> list[int]:
        ids: list[int] = []
        for i, j in zip(cuts, cuts[1:], strict=False):
            if (hit := self.table.get(unit[i:j])) is not None:
                ids.append(hit[1])
            else:
                ids += [self.byte_ids[b] for b in unit[i:j].encode()]
        return ids

    def _merge_short(self, unit: str) -> list[int]:
        """Join the best adjacent pair, the leftmost of equals, until no pair is a piece."""
        parts, rank = list(unit), self.rank.get
        ranks = [rank(a + b, NO_PIECE) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks and (best := min(ranks)) != NO_PIECE:
            at = ranks.index(best)
            parts[at] += parts.pop(at + 1)
            del ranks[at]
            if at < len(ranks):
                ranks[at] = rank(parts[at] + parts[at + 1], NO_PIECE)
            if at:
                ranks[at - 1] = rank(parts[at - 1] + parts[at], NO_PIECE)
        return list(accumulate(map(len, parts), initial=0))

    def _merge(self, unit: str) -> list[int]:
        """The same with a heap, for units of any length."""
        n, get = len(unit), self.table.get
        after, before, alive = list(range(1, n + 2)), list(range(-1, n)), [True] * (n + 1)
        heap: list[tuple[float, int, int, int]] = []

        def offer(i: int) -> None:
            if 0 <= i < n and (mid := after[i]) < n:
                end = after[mid]
                if end - i <= self.longest and (h := get(unit[i:end])) is not None:
                    heapq.heappush(heap, (-h[0], i, mid, end))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, mid, end = heapq.heappop(heap)
            if alive[i] and alive[mid] and after[i] == mid and after[mid] == end:
                alive[mid] = False
                after[i] = end
                before[end] = i
                offer(i)
                if i:
                    offer(before[i])
        return [i for i in range(n + 1) if alive[i]]

    def _viterbi(self, unit: str) -> list[int]:
        n = len(unit)
        best, back = [0.0] + [-1e300] * n, [0] * (n + 1)
        missing = min(self.scores, default=0.0) - 10.0
        for j in range(1, n + 1):
            for i in range(max(0, j - self.longest), j):
                hit = self.table.get(unit[i:j])
                score = hit[0] if hit is not None else missing if j == i + 1 else None
                if score is not None and best[i] + score > best[j]:
                    best[j], back[j] = best[i] + score, i
        cuts = [n]
        while cuts[-1]:
            cuts.append(back[cuts[-1]])
        return cuts[::-1]


class Encoder(dict):
    """Unit -> its ids as int32 bytes; remembers units, starts afresh when full.  A task makes its own, so nothing outlives it.

    With ``library``, the model's own library encodes new units: the same ids,
    for callers that only measure them.
    """

    def __init__(self, vocabulary: Vocabulary, library: bool = False):
        super().__init__()
        self.vocabulary, self.library = vocabulary, None
        if library and vocabulary.model is not None:
            import sentencepiece

            self.library = sentencepiece.SentencePieceProcessor(model_proto=vocabulary.model)

    def _encode(self, units: list[str]) -> list[bytes]:
        if self.library is None:
            return self.vocabulary.encode_units(units)
        # the library puts the first space itself, and nothing before empty text
        found = self.library.encode([u[1:].replace(SPACE, " ") for u in units], num_threads=1)
        return [np.array(ids if len(u) > 1 else self.vocabulary.encode_unit(u), dtype=np.int32).tobytes() for u, ids in zip(units, found, strict=True)]

    def __missing__(self, unit: str) -> bytes:
        return self._encode([unit])[0]

    def encode_many(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text; the units that are new go through one lattice."""
        units = [UNIT.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        new = {u for us in units for u in us if u not in self}
        if len(self) + len(new) > MAX_UNITS:
            self.clear()
            new = {u for us in units for u in us}
        kept = [u for u in new if len(u) <= 64]  # longer ones are encoded where they stand
        self.update(zip(kept, self._encode(kept), strict=True))
        return [np.frombuffer(b"".join(map(self.__getitem__, us)), dtype=np.int32) for us in units]

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_many([text])[0]

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.vocabulary.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text.replace(SPACE, " ")[1:]


def encode(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, n_tokens, n_byte_tokens, ids array<int>, and round_trip: whether the ids decode to the text."""
    docs = ids_and_texts(docs, id_col, text_col)
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder(sent.value)
        is_byte = coder.vocabulary.is_byte
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = part.column("text").to_pylist()
                ids = coder.encode_many(texts)
                flat = np.concatenate(ids)
                offsets = np.cumsum([0] + [len(x) for x in ids])
                coded = pa.ListArray.from_arrays(pa.array(offsets, type=pa.int32()), pa.array(flat))
                n_bytes = np.diff(np.concatenate(([0], np.cumsum(is_byte[flat])))[offsets])
                trip = [coder.decode(x) == (t or "") for x, t in zip(ids, texts, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(t or "") for t in texts], pa.int64()), pa.array(np.diff(offsets), pa.int64()), pa.array(n_bytes, pa.int64()), coded, pa.array(trip)], names=["doc_id", "n_chars", "n_tokens", "n_byte_tokens", "ids", "round_trip"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_chars long, n_tokens long, n_byte_tokens long, ids array<int>, round_trip boolean")


def decode(coded: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text from ids; a null list gives empty text."""
    coded = coded.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{ids_col}`").cast("array<int>").alias("ids"))
    sent = coded.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder(sent.value)
        for batch in batches:
            texts = [coder.decode(np.array(x or [], dtype=np.int32)) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return coded.mapInArrow(run, f"doc_id {coded.schema['doc_id'].dataType.simpleString()}, text string")


def word_lattice(words: DataFrame, pieces: DataFrame, longest: int, missing: float) -> DataFrame:
    """The relational lattice: word, path array<string> with the largest sum of scores.

    words(word) must be distinct; pieces(piece, score) is a vocabulary, which is
    broadcast if it is counted to be of MOST_PIECES rows at most.  Substrings of up to ``longest``
    characters are exploded and equi-joined to it; edges are grouped by word
    and folded over end positions.  Single characters without a piece score
    ``missing``.
    """
    w = words.select("word").where(F.length("word") > 0)
    starts = w.select("word", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("i"))
    parts = starts.select("word", "i", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("word") - F.col("i") + 1))).alias("n"))
    parts = parts.withColumn("piece", F.col("word").substr(F.col("i"), F.col("n")))
    held = pieces.select("piece", F.col("score").cast("double").alias("score"))
    edges = parts.join(F.broadcast(held) if held.count() <= MOST_PIECES else held, "piece", "left").where(F.col("score").isNotNull() | (F.col("n") == 1))
    edge = F.struct((F.col("i") + F.col("n") - 1).alias("to"), (F.col("i") - 1).alias("start"), F.coalesce("score", F.lit(missing)).alias("score"), "piece")
    grouped = edges.groupBy("word").agg(F.sort_array(F.collect_list(edge)).alias("edges"))

    # state: best score and path for each position so far; edges come by end position
    def step(state: Column, e: Column) -> Column:
        score = F.element_at(state, e["start"] + 1)["score"] + e["score"]
        path = F.concat(F.element_at(state, e["start"] + 1)["path"], F.array(e["piece"]))
        new = F.struct(score.alias("score"), path.alias("path"))
        have = F.size(state) > e["to"]
        last = F.element_at(state, -1)
        better = F.when(score > last["score"], F.concat(F.slice(state, 1, F.size(state) - 1), F.array(new))).otherwise(state)
        return F.when(have, better).otherwise(F.concat(state, F.array(new)))

    start = F.array(F.struct(F.lit(0.0).cast("double").alias("score"), F.array().cast("array<string>").alias("path")))
    return grouped.select("word", F.aggregate("edges", start, step, lambda s: F.element_at(s, -1)["path"]).alias("path"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), Vocabulary.load(default_model()))
