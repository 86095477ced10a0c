"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a Viterbi search.

One pass over the text: at each position the automaton's state and its output links give every piece that
ends there, and each relaxes the best score of its end from that of its start. No piece has a word's start
mark after another character, so the best path of a text is that of its words one by one, and a worker
keeps those of the words it saw.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from oddone.llm.common import ready

#: Entries of a worker's memo of encoded words; it starts afresh when full. Longer words are not kept.
MEMO, MEMO_WORD = 200_000, 64
MARK = "▁"
#: A character that no piece covers costs this much more than the worst piece, as in the library.
UNKNOWN_PENALTY = 10.0


class PieceModel:
    """Ids of a text under the pieces and scores of a SentencePiece model file, the best-scoring segmentation.

    Characters outside all pieces become byte pieces if the model has them, else the unknown id.
    """

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(size)]
        self.unknown, self.byte, self.byte_of = model.unk_id(), {}, {}
        self.automaton, self.single, worst, crossing = ahocorasick.Automaton(), set(), 0.0, False
        for i, piece in enumerate(self.pieces):
            if model.is_byte(i):
                self.byte_of[i] = int(piece[3:-1], 16)
                self.byte[self.byte_of[i]] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                score = model.get_score(i)
                self.automaton.add_word(piece, (len(piece), i, score))
                worst = min(worst, score)
                crossing |= MARK in piece.lstrip(MARK)
                if len(piece) == 1:
                    self.single.add(piece)
        self.automaton.make_automaton()
        self.unknown_score = worst - UNKNOWN_PENALTY
        self.words = (lambda s: [s]) if crossing else re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+").findall
        self.memo: dict[str, tuple[int, ...]] = {}

    def viterbi(self, word: str) -> tuple[int, ...]:
        """Ids of the best path; of equal ones that with the earlier starts wins at each end."""
        n = len(word)
        best, start, piece = [0.0] + [float("-inf")] * n, [0] * (n + 1), [-1] * (n + 1)
        uncovered = [k for k, c in enumerate(word) if c not in self.single]
        at = 0

        def unknown(before: int) -> None:
            nonlocal at
            while at < len(uncovered) and uncovered[at] < before:
                k = uncovered[at]
                at += 1
                if best[k] + self.unknown_score > best[k + 1]:
                    best[k + 1], start[k + 1], piece[k + 1] = best[k] + self.unknown_score, k, -1

        for end, (length, i, score) in self.automaton.iter(word):
            if uncovered:
                unknown(end)  # those at the same end come after the pieces
            s = end + 1 - length
            if best[s] + score > best[end + 1]:
                best[end + 1], start[end + 1], piece[end + 1] = best[s] + score, s, i
        unknown(n)
        out: list[int] = []
        while n:
            if piece[n] >= 0:
                out.append(piece[n])
            elif self.byte:
                out.extend(self.byte[b] for b in reversed(word[start[n]:n].encode()))
            elif not out or out[-1] != self.unknown:  # a run of unknown characters is one id
                out.append(self.unknown)
            n = start[n]
        return tuple(out[::-1])

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        memo, ids = self.memo, []
        if len(memo) > MEMO:
            memo.clear()
        for word in self.words(MARK + text.replace(" ", MARK)):
            found = memo.get(word)
            if found is None:
                found = self.viterbi(word)
                if len(word) <= MEMO_WORD:
                    memo[word] = found
            ids.extend(found)
        return ids

    def decode(self, ids: list[int]) -> str:
        """The text of ``ids``; bytes that are no UTF-8 become replacement characters."""
        byte_of, pieces = self.byte_of, self.pieces
        if byte_of and not byte_of.keys().isdisjoint(ids):
            text = b"".join(bytes([byte_of[i]]) if i in byte_of else pieces[i].encode() for i in ids).decode(errors="replace")
        else:
            text = "".join([pieces[i] for i in ids])
        return text.replace(MARK, " ").removeprefix(" ")


@lru_cache(maxsize=2)
def piece_model(name: str) -> PieceModel:
    import public_tokenizers

    return PieceModel(public_tokenizers.path(name))


def encode(docs: DataFrame, model: str = "piece_bpe_32k.model", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``ids``, ``n_ids``, ``round_trip`` (decoding gives the text again).

    A null or empty text has no ids, and ``round_trip`` is true. The word mark U+2581 in a text is taken as a
    blank, as the library does, so such a text doesn't come back. A null id stays null; repeated rows are
    encoded each on their own; an empty table gives an empty result; other columns are not read.
    """
    ready(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = piece_model(model)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            ids = [m.encode(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([len(i) for i in ids], pa.int64()),
                 pa.array([m.decode(i) == t for i, t in zip(ids, texts, strict=True)], pa.bool_())],
                ["doc_id", "ids", "n_ids", "round_trip"])

    narrow = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    return narrow.mapInArrow(run, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, ids array<int>, n_ids long, round_trip boolean")


def decode(encoded: DataFrame, model: str = "piece_bpe_32k.model", id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, text`` from rows of ids; null ids give a null text, no ids an empty one."""
    ready(encoded)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = piece_model(model)
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([None if i is None else m.decode(i) for i in b.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    narrow = encoded.select(encoded[id_col].alias("doc_id"), encoded[ids_col].alias("ids"))
    return narrow.mapInArrow(run, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, text string")
