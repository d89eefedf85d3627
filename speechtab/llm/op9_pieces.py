"""Unigram encoding and decoding with a SentencePiece model's pieces.

Pieces with log scores are matched through a double-array trie over their UTF-8 bytes; a Viterbi pass picks the
segmentation of greatest total score (of equal ones, the one whose last piece starts first, and so on backwards).
Characters that no chosen piece covers cost ``least score - 10`` and become byte pieces. A space is the marker U+2581
and one stands before the text; decoding turns markers to spaces and drops the first. A marker in the text itself is
always written as bytes, so decoding gives back every text exactly. A byte-pair model has merge ranks for scores; they
are turned to log probabilities by Zipf's law, the natural log of 1 / (rank + 1) before normalisation.

No piece has a marker behind another character, so no best path crosses from a word to the next word's marker, and
chunks (a run of spaces and what follows up to the next space) are encoded on their own; their ids are kept, at most
``room`` of them, which is why time follows the distinct chunks. Texts of any length are taken whole.

Null text counts as empty and has no ids. Each row is encoded on its own, repeated ones and null doc_ids too; an empty
table gives an empty one, and columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from speechtab.llm.common import map_texts

MARK = "▁"
_CHUNKS = re.compile(r" +[^ ]*|[^ ]+")


class DoubleArray:
    """A trie of byte strings: the child of node s by byte c is t = base[s] + c + 1 where check[t] = s."""

    def __init__(self, keys: list[bytes]):
        tree: dict = {}
        for i, key in enumerate(keys):
            node = tree
            for c in key:
                node = node.setdefault(c, {})
            node[-1] = i
        size = 1 << 16
        base, check, value = [0] * size, [-1] * size, [-1] * size
        check[0] = 0
        #: Where the search for a free place starts, by the number of children; it only moves on, so building is linear.
        start, todo = [0] * 9, [(0, tree)]
        while todo:
            s, node = todo.pop()
            value[s] = node.get(-1, -1)
            children = sorted(c for c in node if c >= 0)
            if not children:
                continue
            group = len(children).bit_length()
            b = start[group]
            while True:
                if b + 300 > len(check):
                    base, check, value = base + [0] * size, check + [-1] * size, value + [-1] * size
                if all(check[b + c + 1] < 0 for c in children):
                    break
                b += 1
            start[group] = b
            base[s] = b
            for c in children:
                check[b + c + 1] = s
                todo.append((b + c + 1, node[c]))
        self.base, self.check, self.value = base, check, value

    def prefixes(self, text: bytes, at: int) -> list[tuple[int, int]]:
        """(end, key number) of every key that starts at ``at``, shortest first."""
        base, check, value = self.base, self.check, self.value
        s, out = 0, []
        for i in range(at, len(text)):
            t = base[s] + text[i] + 1
            if check[t] != s:
                break
            s = t
            if value[t] >= 0:
                out.append((i + 1, value[t]))
        return out


class Pieces:
    """Encoder and decoder. ``byte_ids`` has the id of each byte's piece."""

    def __init__(self, pieces: list[str], scores: list[float], ids: list[int], byte_ids: list[int], room: int = 500_000):
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece has a marker behind another character")
        keys = [p.encode() for p in pieces]
        self.trie, self.scores, self.ids, self.byte_ids = DoubleArray(keys), scores, ids, byte_ids
        self.unknown = min(scores, default=0.0) - 10
        self.bytes_of = {i: k.replace(MARK.encode(), b" ") for i, k in zip(ids, keys, strict=True)}
        self.bytes_of |= {i: bytes([b]) for b, i in enumerate(byte_ids)}
        #: Neighbouring characters within pieces; between any others a text can be cut.
        self.pairs = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}
        self.room, self.known = room, {}

    @classmethod
    @lru_cache(maxsize=2)
    def load(cls, path: str) -> Pieces:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(len(sp))
        byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        use = [i for i in every if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))]
        scores = [sp.get_score(i) for i in use]
        ranked = all(s == int(s) and s <= 0 for s in scores)
        return cls([sp.id_to_piece(i) for i in use], [-float(np.log1p(-s)) if ranked else s for s in scores], use, byte_ids)

    def viterbi(self, word: str) -> list[int]:
        """The ids of a chunk in which markers stand for spaces."""
        text = word.encode("utf-8", "replace")
        n = len(text)
        best, back = [-np.inf] * (n + 1), [0] * (n + 1)
        piece = [-1] * (n + 1)
        best[0] = 0.0
        scores, base, check, value = self.scores, self.trie.base, self.trie.check, self.trie.value
        at = 0
        while at < n:
            here, c = best[at], text[at]
            char = at + (1 if c < 0x80 else 2 if c < 0xE0 else 3 if c < 0xF0 else 4)
            covered, s, i = False, 0, at
            while i < n:
                t = base[s] + text[i] + 1
                if check[t] != s:
                    break
                s = t
                i += 1
                k = value[s]
                if k >= 0:
                    covered |= i == char
                    total = here + scores[k]
                    if total > best[i]:
                        best[i], back[i], piece[i] = total, at, k
            if not covered and here + self.unknown > best[char]:
                best[char], back[char], piece[char] = here + self.unknown, at, -1
            at = char
        out = []
        while n:
            at, k = back[n], piece[n]
            out.append([self.ids[k]] if k >= 0 else [self.byte_ids[b] for b in text[at:n]])
            n = at
        return [i for part in reversed(out) for i in part]

    def _chunk(self, chunk: str) -> bytes:
        """The ids of a chunk with spaces, as little-endian unsigned 32-bit integers."""
        if MARK in chunk:  # written as bytes, which no piece can join
            own = array("I", [self.byte_ids[b] for b in MARK.encode()]).tobytes()
            return own.join(self._chunk(p) if p else b"" for p in chunk.split(MARK))
        # No piece spans the last two characters: what stands before the last is encoded, and kept, on its own.
        if len(chunk) > 1 and (chunk[-2:]).replace(" ", MARK) not in self.pairs:
            return self._kept(chunk[:-1]) + self._kept(chunk[-1])
        return array("I", self.viterbi(chunk.replace(" ", MARK))).tobytes()

    def _kept(self, chunk: str) -> bytes:
        got = self.known.get(chunk)
        if got is None:
            got = self._chunk(chunk) if len(chunk) <= 64 else self._long(chunk)
            if len(chunk) <= 32 and len(self.known) < self.room:
                self.known[chunk] = got
        return got

    def _long(self, chunk: str) -> bytes:
        """A long chunk is cut where no piece spans the two characters, without recursion."""
        if MARK in chunk:
            own = array("I", [self.byte_ids[b] for b in MARK.encode()]).tobytes()
            return own.join(self._long(p) if p else b"" for p in chunk.split(MARK))
        text, out, low = chunk.replace(" ", MARK), [], 0
        for i in range(1, len(text)):
            if text[i - 1 : i + 1] not in self.pairs:
                out.append(self.viterbi(text[low:i]))
                low = i
        out.append(self.viterbi(text[low:]))
        return array("I", [i for part in out for i in part]).tobytes()

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, dtype="<u4")
        known, out = self.known, []
        for chunk in _CHUNKS.findall(" " + text):
            got = known.get(chunk)
            out.append(self._kept(chunk) if got is None else got)
        return np.frombuffer(b"".join(out), dtype="<u4")

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")[1:]


def encode_documents(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_bytes, n_ids, n_byte_ids, ids_crc32, decoded_sha256, exact, ids of every row of (doc_id, text).

    ``exact`` tells whether decoding the ids gives the text back. ``ids`` holds all ids of the document.
    """

    def make(texts: list[str | None]) -> list[pa.Array]:
        pieces = Pieces.load(model)
        is_byte = np.zeros(max(pieces.bytes_of) + 1, dtype=bool)
        is_byte[pieces.byte_ids] = True
        rows = []
        for text in texts:
            ids = pieces.encode(text)
            decoded = pieces.decode(ids)
            raw = decoded.encode()
            rows.append((len(raw), len(ids), int(is_byte[ids].sum()), zlib.crc32(ids.tobytes()), hashlib.sha256(raw).hexdigest(), decoded == (text or ""), ids.astype(np.int32)))
        kinds = [*[pa.int64()] * 4, pa.string(), pa.bool_(), pa.list_(pa.int32())]
        return [pa.array(list(x), k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)]

    fields = "n_bytes long, n_ids long, n_byte_ids long, ids_crc32 long, decoded_sha256 string, exact boolean, ids array<int>"
    return map_texts(docs, ["doc_id"], make, fields)
