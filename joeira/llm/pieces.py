"""SentencePiece encoding and decoding by a batched Viterbi pass in numpy.

The model file is read with its library; encoding and decoding are done here.
A text is normalised as the model says (blanks become ``▁``, one is put in
front) and cut before every run of ``▁`` that follows something else, where no
piece can reach across.  The words of a batch that have the same length advance
together, one character at a time: the hashes of all substrings that end there
are probed in the sorted keys of the pieces, and a vectorised maximum over the
candidates' lengths stores the backpointer.

For a BPE model the plain sum of scores is *not* what the library computes, so
the Viterbi step is the BPE one: a piece ``t`` may end at a place only if it is
compatible with the last piece ``u`` of the best path that ends before ``t``,
that is, if merging the characters of ``u + t`` by rank gives back ``u, t``.
Exactly one candidate is compatible, so the path is the library's segmentation
(Berglund and van der Merwe, "Formalizing BPE tokenization", 2023).  Pairs are
judged in bulk by undoing the merges next to their border.  For a unigram model
the step is the usual maximum of summed scores.

Characters without a piece become their UTF-8 bytes if the model has byte
pieces, else the unknown piece.

Cases: a null text counts as empty and has no pieces; a null identifier is
kept; repeated rows give repeated results; a very long text is cut into words
like any other, and one very long word advances alone; other columns are left
out by ``encode``, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

BLANK = "▁"
KEPT_CHARACTERS = 16_000_000  # of words whose pieces a worker remembers
CHUNK = 1 << 21  # characters encoded at a time
CELLS = 1 << 18  # characters of equal-length words that advance together
BASE = np.uint64(0x9E3779B97F4A7C15)
NEVER = np.int64(1) << 60
JUDGED_BITS = 20
MAYBE_BITS = 20


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Model:
    """A SentencePiece model as arrays."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        lib = SentencePieceProcessor(model_file=path)
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(lib.serialized_model_proto())
        norm, trainer = proto.normalizer_spec, proto.trainer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or trainer.treat_whitespace_as_suffix:
            raise ValueError("only models that leave the text's characters as they are")
        kinds = {trainer.BPE: "bpe", trainer.UNIGRAM: "unigram"}
        if trainer.model_type not in kinds:
            raise ValueError("only BPE and unigram models")
        self.kind = kinds[trainer.model_type]
        self.prefix = norm.add_dummy_prefix
        self.escape = norm.escape_whitespaces
        self.unknown = lib.unk_id()
        self.size = lib.get_piece_size()
        self.pieces = [lib.id_to_piece(i) for i in range(self.size)]
        self.byte_id = np.full(256, -1, dtype=np.int64)
        usable = []
        for p, piece in enumerate(proto.pieces):
            if piece.type == piece.BYTE:
                self.byte_id[int(self.pieces[p][1:-1], 16)] = p
            elif piece.type == piece.NORMAL:
                usable.append(p)
            elif piece.type == piece.USER_DEFINED:
                raise ValueError("models with user-defined pieces are not supported")
        if any(BLANK in self.pieces[p].lstrip(BLANK) for p in usable):
            raise ValueError("models whose pieces reach across words are not supported")
        self.score = np.array([lib.get_score(p) for p in range(self.size)])
        self._index(usable)
        if self.kind == "bpe":
            self._merges(usable)
        self.words: dict[str, bytes] = {}  # 32-bit identifiers
        self.kept = 0

    def _index(self, usable: list[int]) -> None:
        self.longest = max((len(self.pieces[p]) for p in usable), default=1)
        points = np.zeros((len(usable), self.longest), dtype=np.uint32)
        for row, p in enumerate(usable):
            points[row, : len(self.pieces[p])] = [ord(c) for c in self.pieces[p]]
        length = np.array([len(self.pieces[p]) for p in usable], dtype=np.int64)
        self.powers = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(self.longest, BASE)]))
        running = np.zeros(len(usable), dtype=np.uint64)
        keys = np.zeros(len(usable), dtype=np.uint64)
        for k in range(self.longest):
            running = running * BASE + points[:, k].astype(np.uint64) + np.uint64(1)
            keys = np.where(length == k + 1, running, keys)
        keys = mixed(keys + length.astype(np.uint64))
        order = np.argsort(keys)
        self.keys, self.ids, self.points = keys[order], np.array(usable, dtype=np.int64)[order], points[order]
        self.maybe = np.zeros(1 << MAYBE_BITS, dtype=bool)  # whether any key starts with these bits, asked before the search
        self.maybe[(keys >> np.uint64(64 - MAYBE_BITS)).astype(np.int64)] = True
        # Characters of no longer piece merge with nothing, so words end there as well.
        inner = {c for p in usable if len(self.pieces[p]) > 1 for c in self.pieces[p]} - {BLANK}
        some = "".join(map(re.escape, sorted(inner)))
        self.cut = re.compile(f"{BLANK}+[{some}]*|[{some}]+|[^{some}{BLANK}]+" if inner else f"{BLANK}+|[^{BLANK}]+", re.DOTALL)

    def find(self, key: np.ndarray, points: np.ndarray) -> np.ndarray:
        """The pieces that have these hashes and these characters, -1 for none."""
        if not len(self.keys):
            return np.full(len(key), -1)
        out = np.full(len(key), -1, dtype=np.int64)
        some = np.flatnonzero(self.maybe[(key >> np.uint64(64 - MAYBE_BITS)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.keys, key[some]), len(self.keys) - 1)
        hit = self.keys[at] == key[some]
        some, at = some[hit], at[hit]
        same = (self.points[at, : points.shape[1]] == points[some]).all(axis=1)
        out[some[same]] = self.ids[at[same]]
        return out

    # The BPE step.

    def _merges(self, usable: list[int]) -> None:
        """Rank of every piece, and the two pieces it was last merged from (-1: a single character)."""
        by_text = {self.pieces[p]: p for p in usable}
        order = np.lexsort((np.arange(self.size), -self.score))
        rank = np.empty(self.size, dtype=np.int64)
        rank[order] = np.arange(self.size)
        self.rank = np.append(np.where([len(x) == 1 for x in self.pieces], -1, rank), -1)  # the last: a character without a piece
        self.left = np.full(self.size + 1, -1, dtype=np.int64)
        self.right = np.full(self.size + 1, -1, dtype=np.int64)
        self.reached = np.zeros(self.size + 1, dtype=bool)
        joined_key, joined = [], []
        for p in usable:
            text = self.pieces[p]
            for cut in range(1, len(text)):
                a, b = by_text.get(text[:cut]), by_text.get(text[cut:])
                if a is not None and b is not None:
                    joined_key.append(a * self.size + b)
                    joined.append(p)
            last = self._last_merge(text, by_text)
            if last is not None:
                self.reached[p] = True
                self.left[p], self.right[p] = last
        self.reached[self.size] = True
        key = np.array(joined_key, dtype=np.int64)
        order = np.argsort(key)
        self.join_key, self.join_id = key[order], np.array(joined, dtype=np.int64)[order]
        self.judged_key, self.judged = np.full(1 << JUDGED_BITS, -1, np.int64), np.zeros(1 << JUDGED_BITS, dtype=bool)

    def _last_merge(self, text: str, by_text: dict[str, int]) -> tuple[int, int] | None:
        """The last two pieces that merging ``text`` by rank joins into the whole; (-1, -1) for one character."""
        parts = list(text)
        if len(parts) == 1:
            return -1, -1
        while True:
            best = None
            for i in range(len(parts) - 1):
                p = by_text.get(parts[i] + parts[i + 1])
                if p is not None and (best is None or self.rank[p] < best[0]):
                    best = (self.rank[p], i)
            if best is None:
                return None
            i = best[1]
            if len(parts) == 2:
                return by_text[parts[0]], by_text[parts[1]]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def _joined(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the piece that ``a`` and ``b`` merge into, ``NEVER`` if there is none."""
        key = np.where((a < self.size) & (b < self.size), a * self.size + b, -1)
        at = np.minimum(np.searchsorted(self.join_key, key), len(self.join_key) - 1)
        return np.where(self.join_key[at] == key, self.rank[self.join_id[at]], NEVER)

    def _judge(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether no merge crosses the border when ``a + b`` is merged by rank.

        Goes back in time: the pair at the border is what its two sides had
        become before their next merges; a crossing merge of lower rank would
        have come first (the left of two equal ones comes first).
        """
        ok = self.reached[a] & self.reached[b]
        next_a = np.full(len(a), NEVER)
        next_b = np.full(len(a), NEVER)
        live = np.flatnonzero(ok)
        a, b = a.copy(), b.copy()
        while len(live):
            x, y = a[live], b[live]
            r = self._joined(x, y)
            crossed = (r < next_a[live]) & (r <= next_b[live]) & (r < NEVER)
            ok[live[crossed]] = False
            on = ~crossed & ((self.rank[x] >= 0) | (self.rank[y] >= 0))
            live, x, y = live[on], x[on], y[on]
            undo_a = self.rank[x] > self.rank[y]
            i, j = live[undo_a], live[~undo_a]
            next_a[i] = self.rank[a[i]]
            a[i] = self.right[a[i]]
            next_b[j] = self.rank[b[j]]
            b[j] = self.left[b[j]]
        return ok

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``_judge``, with the verdicts of earlier pairs in a table of fixed size where a new one takes an old one's place."""
        key = a * (self.size + 1) + b
        slot = (key.astype(np.uint64) * BASE >> np.uint64(64 - JUDGED_BITS)).astype(np.int64)
        out = self.judged[slot]
        new = np.flatnonzero(self.judged_key[slot] != key)
        if len(new):
            out[new] = verdict = self._judge(a[new], b[new])
            # Two pairs of one slot could be written in either order: key and verdict go in together.
            last = np.unique(slot[new], return_index=True)[1]
            self.judged_key[slot[new[last]]] = key[new[last]]
            self.judged[slot[new[last]]] = verdict[last]
        return out

    # Encoding.

    def _forward(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece and length of the last step to each place of each word (rows of equal length)."""
        n, length = points.shape
        sums = np.zeros((length + 1, n), dtype=np.uint64)
        for k in range(length):
            sums[k + 1] = sums[k] * BASE + points[:, k].astype(np.uint64) + np.uint64(1)
        piece = np.full((length + 1, n), -1, dtype=np.int64)
        back = np.zeros((length + 1, n), dtype=np.int64)
        total = np.full((length + 1, n), -np.inf)
        total[0] = 0
        lowest = self.score.min() - 10 if self.kind == "unigram" else 0.0
        for end in range(1, length + 1):
            reach = min(end, self.longest)
            ids = np.full((reach, n), -1, dtype=np.int64)
            value = np.full((reach, n), -np.inf)
            for k in range(reach):
                start = end - k - 1
                key = mixed(sums[end] - sums[start] * self.powers[k + 1] + np.uint64(k + 1))
                ids[k] = self.find(key, points[:, start:end])
                if k == 0:
                    ids[k] = np.where(ids[k] < 0, self.size, ids[k])
                rows = np.flatnonzero(ids[k] >= 0)
                if not len(rows):
                    continue
                t = ids[k, rows]
                if self.kind == "unigram":
                    value[k, rows] = total[start, rows] + np.where(t < self.size, self.score[np.minimum(t, self.size - 1)], lowest)
                elif start == 0:
                    value[k, rows] = np.where(self.reached[t], 1.0, -np.inf)
                else:
                    value[k, rows] = np.where(self.compatible(piece[start, rows], t), 1.0, -np.inf)
            best = value.argmax(axis=0)
            total[end] = value[best, np.arange(n)]
            piece[end] = ids[best, np.arange(n)]
            back[end] = best + 1
        return piece, back

    def _encode_words(self, words: list[str]) -> None:
        """Put the identifiers of ``words`` into ``self.words``."""
        by_length: dict[int, list[str]] = {}
        for w in words:
            by_length.setdefault(len(w), []).append(w)
        for length, same in by_length.items():
            step = max(1, CELLS // length)
            for a in range(0, len(same), step):
                part = same[a : a + step]
                points = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), dtype="<u4").reshape(len(part), length)
                piece, back = self._forward(points)
                for row, word in enumerate(part):
                    ids: list[int] = []
                    at = length
                    while at:
                        p, start = int(piece[at, row]), at - int(back[at, row])
                        if p < self.size:
                            ids.append(p)
                        elif self.byte_id[0] >= 0:
                            ids.extend(self.byte_id[b] for b in reversed(word[start:at].encode()))
                        elif not ids or ids[-1] != self.unknown:
                            ids.append(self.unknown)  # neighbours without a piece are one unknown piece
                        at = start
                    self.words[word] = np.array(ids[::-1], dtype=np.int32).tobytes()
                    self.kept += length

    def split(self, text: str) -> list[str]:
        if not text:
            return []
        if self.escape:
            text = text.replace(" ", BLANK)
        return self.cut.findall(BLANK + text if self.prefix else text)

    def encode(self, texts: list[str], remember: int = KEPT_CHARACTERS) -> list[np.ndarray]:
        cut = [self.split(t) for t in texts]
        if self.kept > remember:
            self.words.clear()
            self.kept = 0
        new = {w for words in cut for w in words if w not in self.words}
        if new:
            self._encode_words(sorted(new))
        look = self.words.__getitem__
        return [np.frombuffer(b"".join(map(look, words)), dtype=np.int32) for words in cut]

    def decode(self, encoded: list[np.ndarray]) -> list[str]:
        out = []
        for ids in encoded:
            text = b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")
            out.append(text[1:] if self.prefix and text.startswith(" ") else text)
        return out

    @property
    def bytes_of(self) -> list[bytes]:
        if not hasattr(self, "_bytes_of"):
            of_byte = {int(p): b for b, p in enumerate(self.byte_id) if p >= 0}
            self._bytes_of = [
                bytes([of_byte[p]]) if p in of_byte else " \u2047 ".encode() if p == self.unknown else text.replace(BLANK, " ").encode()
                for p, text in enumerate(self.pieces)
            ]
        return self._bytes_of



@lru_cache(maxsize=2)
def model(path: str) -> Model:
    return Model(path)


def _pieces(texts: pa.Array, chunk: int):
    """Lists of texts of about ``chunk`` characters."""
    part, size = [], 0
    for t in texts:
        part.append(t.as_py())
        size += len(part[-1])
        if size >= chunk:
            yield part
            part, size = [], 0
    if part:
        yield part


def _id_arrays(encoded: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, encoded)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int32), *encoded])))


def encode(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False, chunk: int = CHUNK, remember: int = KEPT_CHARACTERS
) -> DataFrame:
    """``id, n_pieces, ids`` for every text, with ``decoded`` and ``round_trip`` if they are asked for.

    ``chunk`` (characters encoded together) and ``remember`` (characters of words that a worker keeps the pieces of) set its memory and change no result.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def work(batches):
        m = model(path)
        for batch in batches:
            done = 0
            for part in _pieces(batch.column(1), chunk):
                encoded = m.encode(part, remember)
                arrays = [batch.column(0).slice(done, len(part)), pa.array([len(x) for x in encoded], pa.int64()), _id_arrays(encoded)]
                names = ["id", "n_pieces", "ids"]
                if decoded:
                    back = m.decode(encoded)
                    arrays += [pa.array(back, pa.string()), pa.array([a == b for a, b in zip(back, part)])]
                    names += ["decoded", "round_trip"]
                done += len(part)
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = f"id {id_type}, n_pieces bigint, ids array<int>" + (", decoded string, round_trip boolean" if decoded else "")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(work, schema).withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id, text`` for every row of piece identifiers; null identifiers give an empty text."""
    id_type = encoded.schema[id_col].dataType.simpleString()

    def work(batches):
        m = model(path)
        for batch in batches:
            ids = [np.array(x.as_py() or [], dtype=np.int32) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(m.decode(ids), pa.string())], names=["id", "text"])

    return encoded.select(F.col(id_col).alias("id"), ids_col).mapInArrow(work, f"id {id_type}, text string").withColumnRenamed("id", id_col)
