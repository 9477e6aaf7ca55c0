"""SentencePiece encoding and decoding by streaming Viterbi over a model's pieces and their scores.

The text is read once, left to right. Scores are held for as many ends as the longest piece
reaches ahead; back pointers only since the last committed boundary. Whenever all surviving
paths run through one boundary, the ids up to it are final and committed. Characters without a piece
are spelled as byte pieces, so decoding gives back every text exactly; a literal word mark is spelled too.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from suitegauge.llm.common import slices, worker_cache

#: Fixed values of the model format: the mark that stands for a space, and what an unknown character costs below the least score.
MARK = "▁"
UNKNOWN_COST = 10.0
#: Stands in the text for a literal mark, which has no piece.
_LITERAL = "\udfff"
#: Units of text whose ids a Python worker remembers.
REMEMBERED = 600_000


@dataclass
class Model:
    """Pieces in id order: text, score, and whether they stand for text; ``byte_ids`` by byte value."""

    pieces: list[str]
    scores: list[float]
    ordinary: list[bool]
    byte_ids: list[int]
    trie: dict = field(init=False)
    longest: int = field(init=False)
    unknown: float = field(init=False)
    cuts: str = field(init=False)

    def __post_init__(self) -> None:
        self.trie, known = {}, [i for i, good in enumerate(self.ordinary) if good]
        for i in known:
            node = self.trie
            for character in self.pieces[i]:
                node = node.setdefault(character, {})
            node[0] = (self.scores[i], i)
        self.longest = max(len(self.pieces[i]) for i in known)
        self.unknown = min(self.scores[i] for i in known) - UNKNOWN_COST
        inner = {c for i in known for c in self.pieces[i].lstrip(MARK)}
        first = {self.pieces[i][0] for i in known}
        #: No piece runs from other text into one of these, so every path has a boundary before it.
        self.cuts = (MARK if MARK not in inner else "") + ("\n" if "\n" not in inner | first else "")

    @classmethod
    def load(cls, path: str) -> Model:
        from sentencepiece import SentencePieceProcessor

        file = SentencePieceProcessor(model_file=path)
        ids = range(file.get_piece_size())
        special = [file.is_unknown(i) or file.is_control(i) or file.is_unused(i) or file.is_byte(i) for i in ids]
        byte_ids = [file.piece_to_id(f"<0x{value:02X}>") for value in range(256)]
        if not all(file.is_byte(i) for i in byte_ids):
            raise ValueError("the model has no byte pieces to spell unknown characters with")
        return cls([file.id_to_piece(i) for i in ids], [file.get_score(i) for i in ids], [not s for s in special], byte_ids)


def viterbi(model: Model, text: Iterable[str]) -> Iterator[list[int]]:
    """Yields final ids as soon as they are known. Of equal paths the one whose last piece is longest wins."""
    trie, longest, unknown, byte_ids = model.trie, model.longest, model.unknown, model.byte_ids
    source, window, ended = iter(text), [], False
    base = 0  # the committed boundary
    best, back, piece = [0.0], [0], [-1]  # by end, counted from base
    at = 0
    while True:
        while not ended and len(window) < longest:
            following = next(source, None)
            if following is None:
                ended = True
            else:
                window.append(following)
        if not window:
            break
        score, node, single, here = best[at - base], trie, False, at - base
        for ahead, character in enumerate(window, 1):
            node = node.get(character)
            if node is None:
                break
            if 0 in node:
                gain, name = node[0]
                end, total = here + ahead, score + gain
                while len(best) <= end:
                    best.append(None)
                    back.append(0)
                    piece.append(-1)
                if best[end] is None or total > best[end]:
                    best[end], back[end], piece[end] = total, here, name
                single = single or ahead == 1
        if not single:
            end, total = here + 1, score + unknown
            if len(best) <= end:
                best.append(None)
                back.append(0)
                piece.append(-1)
            if best[end] is None or total > best[end]:
                best[end], back[end], piece[end] = total, here, -2 - ord(window[0])
        del window[0]
        at += 1
        here += 1
        if len(best) == here + 1:
            common = here
        elif here % longest == 0:
            common = _common_boundary([e for e in range(here, len(best)) if best[e] is not None], back)
        else:
            continue
        if common:
            out, end = [], common
            while end:
                name = piece[end]
                if name >= 0:
                    out.append(name)
                else:
                    out += [byte_ids[b] for b in reversed(_spelled(-2 - name))]
                end = back[end]
            yield out[::-1]
            level = best[common]
            best = [None if b is None else b - level for b in best[common:]]
            back, piece = [max(0, b - common) for b in back[common:]], piece[common:]
            base += common


def _common_boundary(ends: list[int], back: list[int]) -> int:
    """The last boundary that the paths to all of ``ends`` share."""
    live = set(ends)
    while len(live) > 1:
        live.add(back[max(live)])
        live.remove(max(live))
    return live.pop()


def _spelled(code: int) -> bytes:
    return (MARK if chr(code) == _LITERAL else chr(code)).encode("utf-8", "surrogatepass")


class Encoder:
    """Encodes texts; stretches between certain boundaries are encoded once and remembered."""

    def __init__(self, model: Model):
        self.model = model
        self.known: dict[str, bytes] = {}
        self.spelling = [b"" if not good else p.replace(MARK, " ").encode() for p, good in zip(model.pieces, model.ordinary)]
        for value, i in enumerate(model.byte_ids):
            self.spelling[i] = bytes([value])

    def _learn(self, unit: str) -> bytes:
        text = unit if unit[0] == "\n" else MARK + unit
        ids = [i for part in viterbi(self.model, text) for i in part]
        found = np.array(ids, dtype="<u4").tobytes()
        if len(self.known) > REMEMBERED:
            self.known.clear()
        if len(unit) <= 64:
            self.known[unit] = found
        return found

    def encode(self, text: str) -> bytes:
        """Raw little-endian unsigned 32-bit ids; the empty text has none. A space is put before the text."""
        if not text:
            return b""
        text = text.replace(MARK, _LITERAL)
        if "  " in text or text[0] in " \n" or text[-1] == " " or "\n " in text or " \n" in text or "\n\n" in text or self.model.cuts != MARK + "\n":
            spaced = MARK + text.replace(" ", MARK)
            return np.array([i for part in viterbi(self.model, spaced) for i in part], dtype="<u4").tobytes()
        known, learn = self.known.get, self._learn
        return b"".join([known(u) or learn(u) for u in text.replace("\n", " \n").split(" ") if u])

    def decode(self, raw: bytes) -> str:
        """The text of ``encode``'s ids."""
        spelled = b"".join(map(self.spelling.__getitem__, np.frombuffer(raw, dtype="<u4").tolist()))
        return spelled[1:].decode("utf-8", "surrogatepass")


def encoder(model: Model) -> Encoder:
    """The encoder of this worker for a model."""
    made = worker_cache("piece-encoders")
    key = (len(model.pieces), hash(tuple(model.pieces)), hash(tuple(model.scores)))
    if key not in made:
        made[key] = Encoder(model)
    return made[key]


def encode_documents(docs: DataFrame, model: Model, text: str = "text", id_column: str = "doc_id", kept: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, ids, n_ids, ids_crc32, decoded) for each row of ``docs``; ``decoded`` tells that the ids give back the text.

    Columns of longs named by ``kept`` follow.

    Null and empty texts have no ids. Rows that repeat, and rows without an id, are encoded like any other;
    extra columns are ignored, an empty table gives no rows. No text is cut.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("n_ids", pa.int64()),
                        ("ids_crc32", pa.int64()), ("decoded", pa.bool_()), *[(name, pa.int64()) for name in kept]])
    parts = (model.pieces, model.scores, model.ordinary, model.byte_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = encoder(Model(*parts))
        for whole in batches:
            for batch in slices(whole, 256):
                texts = [t or "" for t in batch.column(1).to_pylist()]
                raws = [worker.encode(t) for t in texts]
                sizes = np.array([len(r) // 4 for r in raws])
                offsets = np.r_[0, np.cumsum(sizes)].astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(raws), dtype=np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), ids, pa.array(sizes, pa.int64()), pa.array([zlib.crc32(r) for r in raws], pa.int64()),
                     pa.array([worker.decode(r) == t for r, t in zip(raws, texts)]), *batch.columns[2:]], schema=schema)

    return docs.select(docs[id_column].alias("doc_id"), docs[text].alias("text"), *kept).mapInArrow(
        run, ", ".join(["doc_id bigint, ids array<int>, n_ids bigint, ids_crc32 bigint, decoded boolean", *[f"{name} bigint" for name in kept]]))
