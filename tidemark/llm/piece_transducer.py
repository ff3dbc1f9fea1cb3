"""SentencePiece encoding and decoding by a weighted finite-state transducer.

Three machines are compiled from a model file and composed with each input while it is read:

- the normaliser: a prefix mark, white space marks for spaces, and (if the model asks) the removal of extra
  spaces;
- the pieces: a trie whose arcs read characters and whose final arcs emit a piece, with byte fallback arcs for
  characters that no piece holds;
- the weights. For a unigram model an arc weighs minus its piece's score. A merge (BPE) model has no such weights:
  its result is the one path in which every two neighbouring pieces are what merging their joined text gives.
  So its machine remembers the last piece, an arc to the next weighs 1 if the two pieces can stand side by side and
  is infinite otherwise, and that is learned pair by pair as inputs need it.

The result is the shortest path in the tropical semiring (sums along a path, minimum over paths). Inputs are cut
where no piece can cross, before each run of marks, so paths are short and repeated cuts are looked up. A merge model's
new cut is cut further between characters that are neighbours in no piece, so a word is searched once, whatever follows it.
"""

from __future__ import annotations

import math
import re
import struct
from array import array
from collections.abc import Iterator
from itertools import chain, groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import whole

MARK = "▁"
NORMAL, UNKNOWN, USER_DEFINED, BYTE = 1, 2, 4, 6
UNIGRAM, MERGES = 1, 2
UNKNOWN_PENALTY = 10.0
REMEMBERED = 500_000  # cuts and pairs a worker remembers before it begins anew; cuts it still needs it takes over
INFINITE = math.inf


def fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a serialised message: varints as int, 32-bit as float, the rest as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 2:
            size = varint()
            yield key >> 3, data[at : at + size]
            at += size
        else:
            size = 4 if kind == 5 else 8
            yield key >> 3, struct.unpack("<f" if kind == 5 else "<d", data[at : at + size])[0]
            at += size


class Transducer:
    def __init__(self, model: bytes):
        pieces, trainer, normaliser = [], {}, {}
        for number, value in fields(model):
            if number == 1:
                piece = dict(fields(value))
                pieces.append((piece[1].decode(), piece.get(2, 0.0), piece.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(fields(value))
            elif number == 3:
                normaliser = dict(fields(value))
        self._compile(pieces, trainer.get(3, UNIGRAM), normaliser)

    @classmethod
    def of(cls, pieces: list[tuple[str, float, int]], kind: int, normaliser: dict | None = None) -> Transducer:
        self = cls.__new__(cls)
        self._compile(pieces, kind, normaliser or {})
        return self

    def _compile(self, pieces, kind, normaliser) -> None:
        if normaliser.get(2):
            raise ValueError("models with a character map in their normaliser are not supported")
        if kind not in (UNIGRAM, MERGES):
            raise ValueError(f"model type {kind} is not supported")
        self.kind = kind
        self.prefix, self.squeeze, self.escape = (bool(normaliser.get(k, 1)) for k in (3, 4, 5))
        self.texts = [p for p, _, _ in pieces]
        self.ids = {p: i for i, (p, _, t) in enumerate(pieces) if t in (NORMAL, USER_DEFINED)}
        self.scores = [s for _, s, _ in pieces]
        self.bytes = {int(p[3:5], 16): i for i, (p, _, t) in enumerate(pieces) if t == BYTE}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.unknown = next((i for i, (_, _, t) in enumerate(pieces) if t == UNKNOWN), 0)
        self.silent = {i for i, (_, _, t) in enumerate(pieces) if t not in (NORMAL, USER_DEFINED, BYTE, UNKNOWN)}
        self.trie: dict = {}
        for piece, i in self.ids.items():
            node = self.trie
            for c in piece:
                node = node.setdefault(c, {})
            node[""] = i
        self.worst = min([self.scores[i] for i in self.ids.values()], default=0.0) - UNKNOWN_PENALTY
        crossing = any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids)
        self.cuts = re.compile(".+" if crossing else f"{MARK}+[^{MARK}]*|[^{MARK}]+", re.S)
        self.neighbours = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        self.shown = [bytes([self.byte_of[i]]) if i in self.byte_of else self._shown(i) for i in range(len(pieces))]
        self.by_cut: dict[str, bytes] = {}  # int32 ids
        self.older: dict[str, bytes] = {}
        self.by_pair: dict[str, dict[str, bool]] = {}
        self.pairs = 0

    def _shown(self, i: int) -> bytes | None:
        text = "" if i in self.silent else " ⁇ " if i == self.unknown else self.texts[i]
        return text.encode("utf-8", "replace") or None

    def normalised(self, text: str) -> str:
        if self.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        if self.prefix and text:
            text = " " + text
        return text.replace(" ", MARK) if self.escape else text

    def encode(self, text: str) -> list[int]:
        return self.coded(text).tolist()

    def coded(self, text: str) -> np.ndarray:
        cuts = self.cuts.findall(self.normalised(text))
        found = list(map(self.by_cut.get, cuts))
        if None in found:
            found = [self._learned(cut) if ids is None else ids for cut, ids in zip(cuts, found)]
        return np.frombuffer(b"".join(found), np.int32)

    def _learned(self, cut: str) -> bytes:
        """The ids of a cut, remembered; those of its parts, between which no piece can cross, too."""
        ids = self.by_cut.get(cut) or self.older.get(cut)
        if ids is None:
            parts = self._parts(cut)
            ids = array("i", self._emit(self.shortest_path(cut))).tobytes() if len(parts) == 1 else b"".join(map(self._learned, parts))
        if len(self.by_cut) >= REMEMBERED:
            self.by_cut, self.older = {}, self.by_cut
        self.by_cut[cut] = ids
        return ids

    def _parts(self, cut: str) -> list[str]:
        joined = self.neighbours
        if self.kind != MERGES or joined.issuperset(map(str.__add__, cut, cut[1:])):
            return [cut]
        ends = [k for k in range(1, len(cut)) if cut[k - 1 : k + 1] not in joined]
        return [cut[a:b] for a, b in zip([0, *ends], [*ends, len(cut)])]

    def shortest_path(self, cut: str) -> list[str]:
        """The pieces along the lightest path through the composed machine."""
        return (self._only_path(cut) if self.kind == MERGES else None) or self._lightest_path(cut)

    def _ends(self, cut: str, i: int) -> list[int]:
        """Where arcs from i lead, longest piece last; every single character has an arc."""
        j = i + 1
        node, found = self.trie.get(cut[i]), [j]
        for c in cut[j:]:
            node = node.get(c) if node else None
            if node is None:
                break
            j += 1
            if "" in node:
                found.append(j)
        return found

    def _only_path(self, cut: str) -> list[str] | None:
        """Of a merge model one path has a finite weight, and so has each of its beginnings: the merges of a text's
        beginning end in one last piece. So a search in depth, longest pieces first, may drop a place for good once it leads nowhere."""
        n, known = len(cut), self.by_pair
        ends, path, open_arcs, dead = [0], [""], [self._ends(cut, 0)], set()
        while ends and ends[-1] < n:
            i, last, arcs = ends[-1], path[-1], open_arcs[-1]
            after = known.get(last) or self._after(last)
            while arcs:
                j = arcs.pop()
                if j in dead:
                    continue
                piece = cut[i:j]
                fits = after.get(piece)
                if self._side_by_side(last, piece) if fits is None else fits:
                    ends.append(j)
                    path.append(piece)
                    open_arcs.append(self._ends(cut, j) if j < n else [])
                    break
            else:
                dead.add(i)
                ends.pop()
                path.pop()
                open_arcs.pop()
        return path[1:] or None

    def _lightest_path(self, cut: str) -> list[str]:
        """Forward over the places of the cut; with a merge model the state is the last piece of the best path."""
        n = len(cut)
        cost = [INFINITE] * (n + 1)
        back = [-1] * (n + 1)
        cost[0] = 0.0
        for i in range(n):
            if cost[i] == INFINITE:
                continue
            node, j = self.trie, i
            last = cut[back[i] : i] if i else ""
            while True:
                node = node.get(cut[j]) if node is not None else None
                j += 1
                piece = node.get("") if node is not None else None
                if piece is not None or j == i + 1:
                    weight = cost[i] + self._weight(last, cut[i:j], piece)
                    if weight < cost[j]:
                        cost[j], back[j] = weight, i
                if node is None or j == n:
                    break
        out, at = [], n
        while at > 0:
            out.append(cut[back[at] : at])
            at = back[at]
        return out[::-1]

    def _weight(self, last: str, text: str, piece: int | None) -> float:
        if self.kind == UNIGRAM:
            return -(self.worst if piece is None else self.scores[piece])
        return 1.0 if self._side_by_side(last, text) else INFINITE

    def _side_by_side(self, left: str, right: str) -> bool:
        """Whether merging the joined text of two pieces gives these two."""
        after = self._after(left)
        found = after.get(right)
        if found is None:
            if self.pairs >= REMEMBERED:
                self.by_pair.clear()
                self.pairs, after = 0, self._after(left)
            self.pairs += 1
            found = after[right] = self._merged(left + right) == [p for p in (left, right) if p]
        return found

    def _after(self, left: str) -> dict[str, bool]:
        return self.by_pair.setdefault(left, {})

    def _merged(self, text: str) -> list[str]:
        """The pieces of a text no longer than two pieces: the best-scored neighbours merge, leftmost first."""
        parts = list(text)
        while True:
            best, at = -INFINITE, -1
            for k in range(len(parts) - 1):
                piece = self.ids.get(parts[k] + parts[k + 1])
                if piece is not None and self.scores[piece] > best:
                    best, at = self.scores[piece], k
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _emit(self, path: list[str]) -> list[int]:
        """Piece numbers, byte pieces for characters that no piece holds."""
        out: list[int] = []
        for text in path:
            piece = self.ids.get(text)
            if piece is not None:
                out.append(piece)
            elif self.bytes:
                out += [self.bytes[b] for b in text.encode("utf-8", "replace")]
            else:
                out.append(self.unknown)
        return out

    def decode(self, ids: list[int]) -> str:
        try:  # a piece never begins within a character, so bytes that lack one's rest end before it
            shown = b"".join(map(self.shown.__getitem__, ids)).decode("utf-8", "replace")
        except TypeError:  # pieces without a text end them as well
            runs = groupby(ids, lambda i: self.shown[i] is None)
            shown = "".join(b"".join(map(self.shown.__getitem__, run)).decode("utf-8", "replace") for silent, run in runs if not silent)
        text = shown.replace(MARK, " ")
        return text[1:] if self.prefix and text.startswith(" ") else text


_COMPILED: dict[int, Transducer] = {}


def compiled(model: bytes) -> Transducer:
    """One machine a worker process and model, with what it has learned."""
    key = hash(model)
    if key not in _COMPILED:
        _COMPILED[key] = Transducer(model)
    return _COMPILED[key]


def encode_texts(docs: DataFrame, model: bytes, doc_id="doc_id", text="text") -> DataFrame:
    """(doc_id, n_tokens, ids, round_trip) for every row and whole text.

    `model` is the content of a model file, sent to the tasks. round_trip says whether decoding the ids
    gives the normalised text again. Null and empty texts have no ids; repeated rows are encoded each; an
    empty table gives an empty result; other columns are ignored.
    """
    kept = docs.sparkSession.sparkContext.broadcast(model)  # one model file
    types = pa.schema([("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32())), ("round_trip", pa.bool_())])

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = compiled(kept.value)
        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, 256):  # long texts: few at a time
                batch = whole_batch.slice(at, 256)
                ids, same = [], []
                for t in batch.column(1).to_pylist():
                    got = machine.coded(t)
                    ids.append(got)
                    same.append(machine.decode(got.tolist()) == (re.sub(" +", " ", t.strip(" ")) if machine.squeeze else t).replace(MARK, " "))
                sizes = np.array([len(x) for x in ids], np.int64)
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                values = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids) if ids else np.array([], np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), values, pa.array(same)], names=["doc_id", *types.names])

    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), whole(text).alias("text"))
    return rows.mapInArrow(encoded, f"doc_id {kind}, n_tokens long, ids array<int>, round_trip boolean")


def decode_ids(encoded: DataFrame, model: bytes, doc_id="doc_id", ids="ids") -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids give an empty text."""
    kept = encoded.sparkSession.sparkContext.broadcast(model)

    def decoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine = compiled(kept.value)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "text": [machine.decode(list(x)) if x is not None else "" for x in batch["ids"]]})

    kind = encoded.schema[doc_id].dataType.simpleString()
    return encoded.select(F.col(doc_id).alias("doc_id"), F.col(ids).alias("ids")).mapInPandas(decoded, f"doc_id {kind}, text string")
