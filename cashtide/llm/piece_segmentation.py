"""SentencePiece encoding with the n best segmentations, and decoding.

A text becomes one line of letters: a word mark in front and for every space.  The lattice
over it has an arc for every piece of the model that fits and, where no piece of a single
letter does, one for the letter's bytes.  A segmentation's score is the sum of its pieces' scores, their
logarithms of probability in units of 1/``UNIT``: whole numbers, so that sums are exact.  A
model of merges has ranks instead of probabilities; those come from the corpus then, as the
shares of pieces in the library's own segmentation of all words, counted in a first pass.

The forward pass keeps the best score up to every place.  Read from the end, these scores
are the exact cost of what remains, so that the backward A* search expands only what
belongs to one of the n best segmentations and meets them in order.

No piece goes on from a word or line into the next (a model that has one is refused; the
carriage returns that end pieces belong to the word before them), so the lattice falls into
segments.  Segments are solved once per batch wherever they occur.  The n best of a
text combine the n best of its segments: a segment whose second best loses more than n - 1
others do can't change among them, so at most n - 1 segments are searched per text.

Decoding puts the pieces' letters together; a word mark of the text itself is written in
bytes, so every text comes back as it was.

A null or empty text has no pieces, one segmentation and score 0.  Repeated rows are
encoded each; a null id stays null; ties between equal scores are broken alike in every
run; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cashtide.llm.common import id_and_text
from cashtide.llm.token_files import portions

MARK = "▁"
N_BEST = 4
UNIT = 10_000
UNKNOWN_PENALTY = 10 * UNIT  # a letter without a piece scores this much below the worst piece
REMEMBERED = 400_000  # segments a task knows at a time
SHORT = 64  # letters of a segment that is solved among many, and remembered, at most
TEXTS = 2048  # encoded at a time, if they have no more bytes than
TEXT_BYTES = 1 << 22  # this, but for a single longer text
_SEGMENT = re.compile(r"[\n\t\f\v]++| *+[^ \n\t\r\f\v]++\r*+| *+\r++| ++")
_NEVER = -(10**17)


class Lattice:
    """Pieces with their scores, and the searches over one segment."""

    def __init__(self, model_file: str, scores: Sequence[int] | None = None):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.root: dict = {}
        self.spelled: list[bytes] = []
        self.byte_ids = [0] * 256
        worst = 0
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.spelled.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.spelled.append(b"")
            else:
                if len(_SEGMENT.findall(piece.replace(MARK, " "))) > 1:
                    raise ValueError(f"the piece {piece!r} goes on in another word or line")
                score = round(UNIT * model.get_score(i)) if scores is None else scores[i]
                worst = min(worst, score) if score > -(10**8) * UNIT else worst
                node = self.root
                for letter in piece:
                    node = node.setdefault(letter, {})
                node[""] = (i, score)
                self.spelled.append(piece.replace(MARK, " ").encode())
        self.unknown = worst - UNKNOWN_PENALTY
        self.lengths = np.array([len(x) for x in self.spelled], np.int64)
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(self.spelled), np.uint8)
        self._lay_out()

    def _lay_out(self) -> None:
        """The tree of pieces as arrays: per node its piece and score, and a hashed table of steps.

        Letters are numbered by their first use in a piece; 0 is a letter that no piece has.
        """
        letter = {}
        nodes, steps = [self.root], []
        for at, node in enumerate(nodes):  # grows on the way
            for c, below in node.items():
                if c:
                    steps.append((at, letter.setdefault(c, len(letter) + 1), len(nodes)))
                    nodes.append(below)
        ends = [node.get("", (-1, 0)) for node in nodes]
        self.node_piece = np.array([piece for piece, _ in ends], np.int64)
        self.node_score = np.array([score for _, score in ends], np.int64)
        self.letters = np.zeros(0x110000, np.int32)
        for c, i in letter.items():
            self.letters[ord(c)] = i
        self.letters[ord(" ")] = letter.get(MARK, 0)
        self.letters[ord(MARK)] = 0  # a word mark that the text itself has is never a piece
        self.n_letters = len(letter) + 1
        self.hash_shift = np.uint64(64 - max(8, (2 * len(steps)).bit_length()))
        size = 1 << (64 - int(self.hash_shift))
        self.step_key, self.step_to = np.full(size, -1, np.int64), np.zeros(size, np.int64)
        rows = np.array(steps, np.int64).reshape(-1, 3)
        top = rows[:, 0] == 0
        self.first_step = np.full(self.n_letters, -1, np.int64)  # from the root
        self.first_step[rows[top, 1]] = rows[top, 2]
        key, to = rows[~top, 0] * self.n_letters + rows[~top, 1], rows[~top, 2]
        slot = self._slots(key)
        while len(key):  # a slot takes one key, the others try the next
            free = self.step_key[slot] < 0
            self.step_key[slot[free]] = key[free]
            here = self.step_key[slot] == key
            self.step_to[slot[here]] = to[here]
            key, to, slot = key[~here], to[~here], (slot[~here] + 1) % size

    def _slots(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.hash_shift).astype(np.int64)

    def _step(self, node: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The node below each node but the root by a letter, -1 where there is none."""
        key = node * self.n_letters + letter
        slot = self._slots(key)
        met = self.step_key[slot]
        out = np.where(met == key, self.step_to[slot], -1)
        open_ = np.flatnonzero((met != key) & (met >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) % len(self.step_key)
            met, asked = self.step_key[slot[open_]], key[open_]
            found = open_[met == asked]
            out[found] = self.step_to[slot[found]]
            open_ = open_[(met != asked) & (met >= 0)]
        return out

    def _arcs(self, text: str, i: int) -> list[tuple[int, tuple[int, ...], int]]:
        """End, ids and score of every arc from a place."""
        node, out, j, n = self.root, [], i, len(text)
        while j < n:
            # A word mark that the text itself has is never a piece.
            node = node.get(MARK if text[j] == " " else text[j]) if text[j] != MARK else None
            if node is None:
                break
            j += 1
            end = node.get("")
            if end is not None:
                out.append((j, (end[0],), end[1]))
        if not out or out[0][0] != i + 1:
            out.insert(0, (i + 1, tuple(self.byte_ids[b] for b in text[i].encode()), self.unknown))
        return out

    def forward(self, text: str):
        """Best and second best score up to each place, and the arcs into each, best last."""
        n = len(text)
        best, second = [_NEVER] * (n + 1), [_NEVER] * (n + 1)
        into: list[list] = [[] for _ in range(n + 1)]
        best[0] = 0
        for i in range(n):
            b, s = best[i], second[i]
            for j, ids, score in self._arcs(text, i):
                value, arcs = b + score, into[j]
                if value > best[j]:
                    second[j] = max(best[j], s + score)
                    best[j] = value
                    arcs.append((i, ids, score))
                else:
                    second[j] = max(second[j], value)
                    arcs.insert(0, (i, ids, score))
        return best, second, into

    def best(self, text: str) -> tuple[list[int], int, int]:
        """Ids of the best segmentation, its score, and what the second best loses (-1: none).

        The forward pass of ``forward`` without the arcs, for the many segments that need no
        search: the best and the second best score, and the best arc into each place.
        """
        n, root, unknown = len(text), self.root, self.unknown
        letters = [MARK if c == " " else None if c == MARK else c for c in text] if " " in text or MARK in text else text
        best, second = [_NEVER] * (n + 1), [_NEVER] * (n + 1)
        came: list = [None] * (n + 1)
        best[0] = 0
        for i in range(n):
            b, s = best[i], second[i]
            node = root.get(letters[i])
            j = i + 1
            if node is None or "" not in node:
                value = b + unknown
                if value > best[j]:
                    second[j] = max(best[j], s + unknown)
                    best[j], came[j] = value, (i, -1)
                elif value > second[j]:
                    second[j] = value
            while node is not None:
                end = node.get("")
                if end is not None:
                    piece, score = end
                    value = b + score
                    if value > best[j]:
                        other = s + score
                        second[j] = best[j] if best[j] > other else other
                        best[j], came[j] = value, (i, piece)
                    elif value > second[j]:
                        second[j] = value
                if j == n:
                    break
                node = node.get(letters[j])
                j += 1
        out, at = [], n
        while at:
            at, piece = came[at]
            if piece >= 0:
                out.append(piece)
            else:
                out.extend(self.byte_ids[x] for x in reversed(text[at].encode()))
        out.reverse()
        return out, best[n], best[n] - second[n] if second[n] > _NEVER // 2 else -1

    def best_of_many(self, texts: Sequence[str]) -> list[tuple[bytes, int, int]]:
        """``best`` of each text, with its ids as 32-bit numbers.

        All arcs of all short texts are found at once, one letter further at a time; the forward
        pass then takes the arcs that leave the same place of all texts together.  They end in
        different places, so the outcome is that of one text after the other.
        """
        out: list = [None] * len(texts)
        short = [k for k, t in enumerate(texts) if 0 < len(t) <= SHORT]
        if short:
            self._best_of_short([texts[k] for k in short], short, out)
        for k, found in enumerate(out):
            if found is None:  # long ones, and those whose best segmentation has a letter in bytes
                ids, score, loss = self.best(texts[k])
                out[k] = (np.array(ids, "<i4").tobytes(), score, loss)
        return out

    def _best_of_short(self, texts: list[str], names: list[int], out: list) -> None:
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        last = np.cumsum(size + 1) - 1  # the place behind the last letter; a text has one place more than letters
        first = last - size
        offset = np.arange(int(last[-1]) + 1) - np.repeat(first, size + 1)
        letter = np.zeros(len(offset), np.int64)
        inside = np.ones(len(offset), bool)
        inside[last] = False
        letter[inside] = self.letters[np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")]
        stop = np.repeat(last, size + 1)
        start = np.flatnonzero(inside)
        node, at = None, start
        arcs = []
        while len(start):
            node = self.first_step[letter[at]] if node is None else self._step(node, letter[at])
            on = node >= 0
            piece = np.where(on, self.node_piece[node], -1)
            fits = piece >= 0
            if not arcs:  # a letter without a piece is an arc of its own
                arcs.append((start[~fits], at[~fits] + 1, piece[~fits], np.full(int((~fits).sum()), self.unknown)))
            arcs.append((start[fits], at[fits] + 1, piece[fits], self.node_score[node[fits]]))
            on &= at + 1 < stop[start]
            start, node, at = start[on], node[on], at[on] + 1
        source, target, piece, score = (np.concatenate(x) for x in zip(*arcs, strict=True))
        order = np.argsort(offset[source].astype(np.uint8), kind="stable")
        source, target, piece, score = source[order], target[order], piece[order], score[order]
        ends = np.cumsum(np.bincount(offset[source]))

        best, second = np.full(len(offset), _NEVER), np.full(len(offset), _NEVER)
        came = np.zeros(len(offset), np.int64)
        best[first] = 0
        a = 0
        for b in ends.tolist():
            here, there = source[a:b], target[a:b]
            value, other = best[here] + score[a:b], second[here] + score[a:b]
            had = best[there]
            better = value > had
            second[there] = np.where(better, np.maximum(had, other), np.maximum(second[there], value))
            best[there] = np.where(better, value, had)
            came[there[better]] = np.flatnonzero(better) + a
            a = b

        at, alive = last.copy(), np.arange(len(texts))
        count, whole, met = np.zeros(len(texts), np.int64), np.ones(len(texts), bool), []
        while len(alive):
            arc = came[at[alive]]
            met.append((alive, piece[arc]))
            whole[alive] &= piece[arc] >= 0
            count[alive] += 1
            at[alive] = source[arc]
            alive = alive[at[alive] > first[alive]]
        ids = np.zeros(int(count.sum()), "<i4")
        until = np.cumsum(count)
        for back, (which, pieces) in enumerate(met):
            ids[until[which] - 1 - back] = pieces
        ids, top, begin = ids.tobytes(), best[last], 4 * (until - count)
        loss = np.where(second[last] > _NEVER // 2, top - second[last], -1)
        rows = zip(names, whole.tolist(), begin.tolist(), (4 * until).tolist(), top.tolist(), loss.tolist(), strict=True)
        for k, complete, a, b, total, lost in rows:
            if complete:
                out[k] = (ids[a:b], total, lost)

    def n_best(self, text: str, n: int) -> list[tuple[int, list[int]]]:
        """Score and ids of the n best segmentations, by backward A* search."""
        best, _, into = self.forward(text)
        heap = [(-best[-1], 0, len(text), 0, None)]
        pushed, out = 0, []
        while heap and len(out) < n:
            _, _, at, behind, path = heapq.heappop(heap)
            if at == 0:
                ids: list[int] = []
                while path is not None:
                    ids.extend(path[0])
                    path = path[1]
                out.append((behind, ids))
                continue
            for i, arc, score in into[at]:
                pushed += 1  # of equal ones the last pushed comes first, which keeps the search deep
                heapq.heappush(heap, (-(best[i] + score + behind), -pushed, i, behind + score, (arc, path)))
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of ids, without the word mark in front."""
        size = self.lengths[ids]
        total = int(size.sum())
        at = np.repeat(self.begins[ids] - (np.cumsum(size) - size), size) + np.arange(total)
        return self.flat[at].tobytes()[1:]


def _combined(options: list[list[int]], n: int) -> list[tuple[int, tuple[int, ...]]]:
    """The n least sums of one loss from each list; lists ascend from 0."""
    start = (0,) * len(options)
    heap, seen, out = [(0, start)], {start}, []
    while heap and len(out) < n:
        loss, ranks = heapq.heappop(heap)
        out.append((loss, ranks))
        for i, r in enumerate(ranks):
            if r + 1 < len(options[i]):
                nxt = ranks[:i] + (r + 1,) + ranks[i + 1 :]
                if nxt not in seen:
                    seen.add(nxt)
                    heapq.heappush(heap, (loss + options[i][r + 1] - options[i][r], nxt))
    return out


class Encoder:
    def __init__(self, model_file: str, n: int, scores: Sequence[int] | None = None):
        self.lattice, self.n = Lattice(model_file, scores), n
        self.known: dict[str, tuple[bytes, int, int]] = {}

    def _solved(self, segments: list[str]) -> list[tuple[bytes, int, int]]:
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        found = [self.known.get(s) for s in segments]
        new = [k for k, x in enumerate(found) if x is None]
        for k, x in zip(new, self.lattice.best_of_many([segments[k] for k in new]), strict=True):
            found[k] = x
            if len(segments[k]) <= SHORT:
                self.known[segments[k]] = x
        return found

    def encode(self, texts: list[str]):
        """Per text: ids of the best segmentation, its score, and the n best as (score, changes),
        a change being the number of a segment and the ids it then has."""
        parts = [_SEGMENT.findall(" " + t) if t else [] for t in texts]
        counts = np.array([len(p) for p in parts], np.int64)
        coded = pa.array([s for p in parts for s in p], pa.large_string()).dictionary_encode()
        names = coded.dictionary.to_pylist()
        solved = self._solved(names)
        size = np.array([len(x[0]) // 4 for x in solved], np.int64)
        flat = np.frombuffer(b"".join(x[0] for x in solved), "<i4")
        begin = np.cumsum(size) - size
        score = np.array([x[1] for x in solved], np.int64)
        loss = np.array([x[2] if x[2] >= 0 else np.iinfo(np.int64).max for x in solved], np.int64)
        code = coded.indices.to_numpy()
        sizes = size[code]
        total = np.concatenate([[0], np.cumsum(sizes)])
        ids = flat[np.repeat(begin[code] - total[:-1], sizes) + np.arange(total[-1])] if len(code) else flat
        ends = np.cumsum(counts)
        for first, last in zip((ends - counts).tolist(), ends.tolist(), strict=True):
            mine = code[first:last]
            top = int(score[mine].sum())
            yield ids[total[first] : total[last]], top, self._alternatives(names, mine, loss[mine], top)

    def _alternatives(self, names: list[str], mine: np.ndarray, loss: np.ndarray, top: int):
        if self.n == 1 or not len(mine):
            return [(top, [])]
        open_ = np.flatnonzero(loss < np.iinfo(np.int64).max)
        cheapest = open_[np.argsort(loss[open_], kind="stable")[: self.n - 1]].tolist()
        lists = [self.lattice.n_best(names[mine[k]], self.n) for k in cheapest]
        out = []
        for lost, ranks in _combined([[x[0][0] - s for s, _ in x] for x in lists], self.n):
            changes = [(k, lists[i][r][1]) for i, (k, r) in enumerate(zip(cheapest, ranks, strict=True)) if r]
            out.append((top - lost, changes))
        return out


def piece_scores(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> list[int]:
    """The score of every piece: its share in the library's segmentation of the words of all
    texts, one added to each count, as a logarithm in units of 1/``UNIT``.

    Only counts per piece come to the driver, as many as the vocabulary has.  A model with
    probabilities of its own keeps them.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    size = model.get_piece_size()
    if any(model.get_score(i) % 1 for i in range(size)):
        return [round(UNIT * model.get_score(i)) for i in range(size)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sentencepiece.SentencePieceProcessor(model_file=model_file)
        total = np.zeros(size, np.int64)
        for batch in batches:
            words = pc.ascii_split_whitespace(batch.column(1).cast(pa.large_string())).flatten().dictionary_encode()
            times = np.bincount(words.indices.to_numpy(), minlength=len(words.dictionary))
            found = own.encode(words.dictionary.to_pylist(), num_threads=1)
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            ids = np.fromiter(chain.from_iterable(found), np.int64, int(sizes.sum()))
            total += np.bincount(ids, np.repeat(times, sizes), size).astype(np.int64)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["id", "n"])

    rows = id_and_text(docs, id_col, text_col).mapInArrow(run, "id bigint, n bigint")
    counts = np.ones(size, np.int64)
    for r in rows.groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[r.id] += r.n
    return np.round(UNIT * (np.log(counts) - np.log(counts.sum()))).astype(np.int64).tolist()


@lru_cache(maxsize=1)
def _encoder(model_file: str, n: int, scores: tuple[int, ...]) -> Encoder:
    """One for all tasks of a worker process, with the segments it knows."""
    return Encoder(model_file, n, scores)


SCHEMA = (
    "doc_id bigint, n_pieces bigint, score bigint, ids array<int>, "
    "n_best array<struct<score:bigint,changes:array<struct<segment:int,ids:array<int>>>>>, "
    "ids_crc32 bigint, round_trip boolean"
)


def encode_pieces(
    docs: DataFrame, model_file: str, n_best: int = N_BEST, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row: pieces and score of the best segmentation, its ``ids``, the ``n_best`` with what
    each changes, the CRC-32 of the ids as 32-bit numbers, and whether decoding them gives
    the text.  ``model_file`` is read where the tasks run; no text is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(tuple(piece_scores(docs, model_file, id_col, text_col)))
    change = pa.struct([("segment", pa.int32()), ("ids", pa.list_(pa.int32()))])
    best = pa.list_(pa.struct([("score", pa.int64()), ("changes", pa.list_(change))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(model_file, n_best, shared.value)
        for whole in batches:
            at = 0
            for some in portions(whole.column(1), TEXTS, TEXT_BYTES):
                batch, texts = whole.slice(at, len(some)), some.to_pylist()
                at += len(some)
                ids, scores, found, crc, back = [], [], [], [], []
                for text, (mine, top, alternatives) in zip(texts, encoder.encode(texts), strict=True):
                    ids.append(mine)
                    scores.append(top)
                    found.append(
                        [{"score": s, "changes": [{"segment": k, "ids": x} for k, x in c]} for s, c in alternatives]
                    )
                    crc.append(zlib.crc32(mine.astype("<i4").tobytes()))
                    back.append(encoder.lattice.decode(mine) == text.encode())
                sizes = np.array([len(x) for x in ids], np.int64)
                flat = np.concatenate(ids) if len(ids) else np.zeros(0, np.int32)
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array(sizes),
                        pa.array(scores, pa.int64()),
                        pa.ListArray.from_arrays(offsets, pa.array(flat.astype(np.int32))),
                        pa.array(found, best),
                        pa.array(crc, pa.int64()),
                        pa.array(back, pa.bool_()),
                    ],
                    ["doc_id", "n_pieces", "score", "ids", "n_best", "ids_crc32", "round_trip"],
                )

    return id_and_text(docs, id_col, text_col).mapInArrow(run, SCHEMA)


def decode_pieces(encoded: DataFrame, model_file: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id`` and ``text`` of rows of ids; null ids give a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(model_file)
        for batch in batches:
            texts = [
                None if x is None else lattice.decode(np.array(x, np.int64)).decode("utf-8", "replace")
                for x in batch.column(1).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    rows = encoded.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"`{ids_col}` as ids")
    return rows.mapInArrow(run, "doc_id bigint, text string")
