"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces with log scores.

Pieces and their order come from a model file (VOCABULARY, a parameter); none is trained here. The file's scores
are merge ranks, so the log score of the piece of rank r is log(1 / (r + SHIFT)) less a constant (Zipf's
law); a character that no piece covers is its UTF-8 bytes in byte pieces, at a score below all pieces'.
A blank is the marker U+2581 in pieces; one is put before the text, and taken off in decoding. A U+2581 of the text
itself goes through byte pieces, so decode(encode(text)) is the text, always.

No piece holds a marker behind another character, nor a line feed. So the best path of a text is that of its chunks
(blanks and what follows up to the next blank or line feed), and what a task has found for a chunk it keeps.
New chunks are encoded together: the trie is walked from one place of all of them at a time. Chunks of over ALONE bytes are
walked one by one, and chunks of over LONG characters are cut first between characters that no piece has side by side.

Edge cases: a null text has null ids and counts, an empty one no ids; very long chunks of characters that pieces join take memory in
proportion; repeated rows are encoded one by one; an empty table gives no rows; `encode` keeps extra columns: where one has the name
of a new column, the new one gets underscores in front until its name is free.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from lamella.llm.common import giving_back
from lamella.tables import read

#: Where the model file is, unless the caller or the session's setting SETTING says otherwise.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
SETTING = "spark.lamella.vocabulary"
MARKER = "▁"
SHIFT = 10.0
FALLBACK = 10.0
CHUNK = re.compile(r"\n| *[^ \n]+| +")
#: Chunks a task keeps, and bytes of new chunks encoded together.
CACHE, TOGETHER = 1 << 17, 1 << 18
#: Bytes of a chunk that is encoded alone, and characters of one that is cut.
ALONE, LONG = 256, 4096


@dataclass
class Trie:
    """A double array: the child of state s by byte c is base[s] + c + 1 if check of that is s; value is a piece or -1."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray


def build_trie(pieces: dict[bytes, int]) -> Trie:
    children: list[dict[int, int]] = [{}]
    ends: list[int] = [-1]
    for piece, i in pieces.items():
        node = 0
        for c in piece:
            if c not in children[node]:
                children[node][c] = len(children)
                children.append({})
                ends.append(-1)
            node = children[node][c]
        ends[node] = i
    size = 2 * len(children) + 2048
    base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
    taken = bytearray(size)
    held = np.frombuffer(taken, np.uint8)  # the same bytes
    held[0] = 1
    queue = [(0, 0)]  # node, state
    while queue:
        node, state = queue.pop()
        value[state] = ends[node]
        codes = np.array(sorted(children[node]), np.int64) + 1
        if not len(codes):
            continue
        first = int(codes[0])
        at = taken.find(0, first) - first
        while len(codes) > 1:  # the first place where all children fit, looked for in stretches
            fits = held[at + first : at + first + 512] == 0
            for c in codes[1:]:
                fits &= held[at + c : at + c + 512] == 0
            if fits.any():
                at += int(fits.argmax())
                break
            at += 512
        base[state] = at
        held[at + codes] = 1
        check[at + codes] = state
        queue.extend((children[node][int(c) - 1], at + int(c)) for c in codes)
    return Trie(base, check, value)


@dataclass
class Vocabulary:
    trie: Trie
    scores: np.ndarray
    spelled: list[bytes]
    bytes_at: np.ndarray
    fallback: float
    joined: set[str]  # characters that some piece has side by side
    known: dict[str, bytes] = field(default_factory=dict)  # a worker keeps it from task to task
    lists: list[list] = field(default_factory=list)  # the trie and the scores, for walks one by one

    def plain(self) -> tuple:
        """The vocabulary as arrays, lists and numbers, to be sent to tasks."""
        return self.trie.base, self.trie.check, self.trie.value, self.scores, self.spelled, self.bytes_at, self.fallback, self.joined, self.known, self.lists

    @classmethod
    def of(cls, plain: tuple) -> Vocabulary:
        return cls(Trie(*plain[:3]), *plain[3:])


def load(path: str = VOCABULARY) -> Vocabulary:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    spelled, bytes_at, pieces = [b""] * n, np.zeros(256, np.int32), {}
    for i in range(n):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            spelled[i] = bytes([int(piece[3:5], 16)])
            bytes_at[spelled[i][0]] = i
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            spelled[i] = piece.replace(MARKER, " ").encode()
            pieces[spelled[i]] = i
    ranks = np.array([-model.get_score(i) for i in range(n)])
    ranks[[i for i in range(n) if spelled[i] not in pieces]] = 0
    ranks = np.argsort(np.argsort(ranks, kind="stable"), kind="stable")
    scores = -np.log(ranks + SHIFT)
    scores -= np.log(np.exp(scores).sum())
    inner = [p for p in pieces if b" " in p.lstrip(b" ") or (p.startswith(b"  ") and p.strip(b" ")) or b"\n" in p]
    if inner:
        raise ValueError(f"pieces that cross chunks: {inner[:3]}")
    joined = {x[i : i + 2] for x in (p.decode() for p in pieces) for i in range(len(x) - 1)}
    return Vocabulary(build_trie(pieces), scores, spelled, bytes_at, float(scores.min() - FALLBACK), joined)


def walked(vocabulary: Vocabulary, chunk: bytes) -> bytes:
    """What `viterbi` gives for the chunk, by a walk of its own."""
    if not vocabulary.lists:
        vocabulary.lists.extend(x.tolist() for x in (vocabulary.trie.base, vocabulary.trie.check, vocabulary.trie.value, vocabulary.scores))
    base, check, value, scores = vocabulary.lists
    n, fallback = len(chunk), vocabulary.fallback
    best, came, piece = [-math.inf] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
    best[0] = 0.0
    for at in range(n):
        here = best[at]
        if here == -math.inf:
            continue
        lead = chunk[at]
        end = at + 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0)
        if here + fallback > best[end]:
            best[end], came[end], piece[end] = here + fallback, at, -1
        state = 0
        for end in range(at, n):
            to = base[state] + chunk[end] + 1
            if check[to] != state:
                break
            state = to
            found = value[to]
            if found >= 0 and here + scores[found] > best[end + 1]:
                best[end + 1], came[end + 1], piece[end + 1] = here + scores[found], at, found
    ids, at = [], n
    while at:
        ids += [piece[at]] if piece[at] >= 0 else [int(vocabulary.bytes_at[c]) for c in reversed(chunk[came[at] : at])]
        at = came[at]
    return np.array(ids[::-1], np.int32).tobytes()


def viterbi(vocabulary: Vocabulary, chunks: list[bytes]) -> list[bytes]:
    """The pieces (as int32 in bytes) of the best path of each chunk (not empty); of equal ones, that found first from the left."""
    trie, scores = vocabulary.trie, vocabulary.scores
    lens = np.array([len(x) for x in chunks])
    longest = int(lens.max())
    text = np.zeros((len(chunks), longest + 4), np.int32)  # code 0 ends a chunk; no state has a child by it
    text[:, :longest] = np.frombuffer(b"".join(x.ljust(longest) for x in chunks), np.uint8).reshape(len(chunks), longest)
    text += 1
    text[np.arange(longest + 4) >= lens[:, None]] = 0
    best = np.full((len(chunks), longest + 1), -np.inf)
    best[:, 0] = 0
    piece = np.full((len(chunks), longest + 1), -1, np.int32)
    came = np.zeros((len(chunks), longest + 1), np.int32)

    def reach(rows: np.ndarray, start: int, end, gained: np.ndarray, ids) -> None:
        better = gained > best[rows, end]
        rows = rows[better]
        end = end[better] if isinstance(end, np.ndarray) else end
        best[rows, end], came[rows, end] = gained[better], start
        piece[rows, end] = ids[better] if isinstance(ids, np.ndarray) else ids

    for at in range(longest):
        rows = np.nonzero((lens > at) & (best[:, at] > -np.inf))[0]
        if not len(rows):
            continue
        lead = text[rows, at] - 1
        width = 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0)
        reach(rows, at, at + width, best[rows, at] + vocabulary.fallback, -1)
        state = np.zeros(len(rows), np.int32)
        for end in range(at, longest):
            code = text[rows, end]
            to = trie.base[state] + code
            alive = (trie.check[to] == state) & (code > 0)
            rows, state = rows[alive], to[alive]
            if not len(rows):
                break
            found = trie.value[state]
            whole = found >= 0
            if whole.any():
                reach(rows[whole], at, end + 1, best[rows[whole], at] + scores[found[whole]], found[whole])
    # back along all paths at once; a character in bytes takes as many steps
    rows, at, steps = np.arange(len(chunks)), lens.copy(), []
    while len(rows):
        ids, before = piece[rows, at], came[rows, at]
        spelled = ids < 0
        ids[spelled] = vocabulary.bytes_at[text[rows[spelled], at[spelled] - 1] - 1]
        steps.append((rows, ids))
        more = spelled & (at - 1 > before)
        came[rows[more], at[more] - 1] = before[more]
        piece[rows[more], at[more] - 1] = -1
        at = np.where(more, at - 1, before)
        rows, at = rows[at > 0], at[at > 0]
    order = np.concatenate([r for r, _ in steps[::-1]])
    flat = np.concatenate([i for _, i in steps[::-1]])[np.argsort(order, kind="stable")].astype(np.int32).tobytes()
    ends = np.cumsum(np.bincount(order, minlength=len(chunks))) * 4
    return [flat[i:j] for i, j in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]


class Codec:
    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary, self.known = vocabulary, vocabulary.known

    def encode(self, texts: list[str | None]) -> list[np.ndarray | None]:
        split = [None if x is None else self.chunks(x) if x else [] for x in texts]
        new = {c for x in split if x for c in x if c not in self.known}
        if len(self.known) + len(new) > CACHE:
            self.known.clear()
            new = {c for x in split if x for c in x}
        self._learn(sorted(new, key=lambda c: (len(c), c)))
        known = self.known
        return [None if x is None else np.frombuffer(b"".join([known[c] for c in x]), np.int32) for x in split]

    def chunks(self, text: str) -> list[str]:
        """What the text is encoded in: the best path of the text is that of these, one behind the other."""
        found = CHUNK.findall(" " + text)
        if len(text) <= LONG or max(map(len, found)) <= LONG:
            return found
        out, joined = [], self.vocabulary.joined
        for chunk in found:
            cuts = [i for i in range(1, len(chunk)) if chunk[i - 1 : i + 1] not in joined] if len(chunk) > LONG else []
            out += [chunk[i:j] for i, j in zip([0, *cuts], [*cuts, len(chunk)], strict=True)]
        return out

    def _learn(self, new: list[str]) -> None:
        alone = [c for c in new if len(c.encode()) > ALONE]
        self.known.update((c, walked(self.vocabulary, c.encode())) for c in alone)
        new = [c for c in new if c not in self.known] if alone else new
        part: list[str] = []
        for i, chunk in enumerate(new):
            part.append(chunk)
            if (len(part) + 1) * len(chunk) >= TOGETHER or i == len(new) - 1:  # in order of length: the last is the longest
                self.known.update(zip(part, viterbi(self.vocabulary, [c.encode() for c in part]), strict=True))
                part = []

    def decode(self, ids: np.ndarray) -> str:
        """The text; ids that no text has (a byte piece out of place) decode to U+FFFD."""
        data = b"".join(map(self.vocabulary.spelled.__getitem__, ids.tolist()))
        return data.removeprefix(b" ").decode(errors="replace")


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """docs with sp_ids (array<int>), sp_bytes (how many of them are byte pieces) and sp_round_trip."""
    vocabulary = load(path or docs.sparkSession.conf.get(SETTING, VOCABULARY))
    held = docs.sparkSession.sparkContext.broadcast(vocabulary.plain())  # as large as the vocabulary
    extra = [("sp_ids", T.ArrayType(T.IntegerType())), ("sp_bytes", T.LongType()), ("sp_round_trip", T.BooleanType())]
    taken = {c.lower() for c in docs.columns}
    extra = [(next(x for x in ("_" * i + n for i in range(len(taken) + 1)) if x not in taken), t) for n, t in extra]
    schema = T.StructType([*docs.schema.fields, *[T.StructField(n, t) for n, t in extra]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(Vocabulary.of(held.value))
        is_byte = np.zeros(len(codec.vocabulary.spelled), bool)
        is_byte[codec.vocabulary.bytes_at] = True
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
                ids = codec.encode(texts)
                same = [None if x is None else codec.decode(x) == t for x, t in zip(ids, texts, strict=True)]
                n_bytes = [None if x is None else int(is_byte[x].sum()) for x in ids]
                columns = [*batch.columns, pa.array(ids, pa.list_(pa.int32())), pa.array(n_bytes, pa.int64()), pa.array(same, pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, *[n for n, _ in extra]])

    return docs.mapInArrow(giving_back(run), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    rows = encode(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", F.size("sp_ids").cast("long").alias("n_tokens"), F.col("sp_bytes").alias("n_byte_tokens"), F.col("sp_round_trip").alias("round_trip"), F.col("sp_ids").alias("ids"))
