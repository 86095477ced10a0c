"""Token counts by a whole-token shortcut.

Most pre-tokens of a text are vocabulary entries. For the strings that the tokenizer provably encodes to
a single id, the count is known without running the merges: they are counted by set membership. Only the
other pre-tokens are merged, each distinct one once per worker as long as the memo holds it.
"""

from __future__ import annotations

from collections import ChainMap
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from oddone.llm.common import ready
from oddone.llm.tokens import byte_pairs

#: Entries of a worker's memo of merged pre-tokens, which starts afresh when full, and the longest pre-token kept in it.
MEMO, MEMO_WORD = 200_000, 256


class Counter:
    """Counts tokens as ``tokenizers`` does for a byte-level BPE file, special strings included."""

    def __init__(self, path: str, ranks_path: str, pattern: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.split = regex.compile(pattern).findall
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.merge = byte_pairs(ranks_path, pattern)._encode_single_piece  # runs no pattern: no run of blanks is too long
        self.whole = self._prove(set(special))
        self.memo: dict[str, int] = {}

    def _prove(self, special: set[str]) -> frozenset[str]:
        """The vocabulary strings that are one pre-token and encode alone as one id: a pre-token's merges
        don't depend on its surroundings, so such a string is one token wherever it is a pre-token."""
        vocab = self.tokenizer.get_vocab_size()
        texts = [t for t in self.tokenizer.decode_batch([[i] for i in range(vocab)], skip_special_tokens=False)
                 if t and "�" not in t and t not in special and self.split(t) == [t]]
        found = self.tokenizer.encode_batch(texts, add_special_tokens=False)
        return frozenset(t for t, e in zip(texts, found, strict=True) if len(e.ids) == 1)

    def _plain(self, texts: list[str]) -> list[int]:
        """Counts of texts without special strings; each new pre-token is merged once for all of them."""
        if len(self.memo) > MEMO:
            self.memo.clear()
        whole, memo = self.whole, self.memo
        split = [self.split(t) for t in texts]
        rest = [[w for w in words if w not in whole] for words in split]
        new = list({w for words in rest for w in words if w not in memo})
        long = {}
        for word in new:
            (memo if len(word) <= MEMO_WORD else long)[word] = len(self.merge(word))
        found = ChainMap(memo, long) if long else memo
        return [len(words) - len(r) + sum([found[w] for w in r]) for words, r in zip(split, rest, strict=True)]

    def count(self, texts: list[str]) -> list[int]:
        if self.special is None:
            return self._plain(texts)
        parts = [self.special.split(t) for t in texts]
        found = iter(self._plain([p for ps in parts for p in ps]))
        return [len(ps) - 1 + sum(next(found) for _ in ps) for ps in parts]


@lru_cache(maxsize=4)
def counter(vocabulary: str, ranks: str) -> Counter:
    import public_tokenizers

    return Counter(public_tokenizers.path(vocabulary), public_tokenizers.path(ranks), public_tokenizers.PATTERN)


def count_tokens(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", ranks: str = "byte_bpe_50k.tiktoken", limit: int = 1024,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_bytes`` (UTF-8), ``n_tokens``, ``over_limit``.

    A null text counts as empty (0 bytes, 0 tokens); a null id stays null; repeated rows are counted each
    on their own; an empty table gives an empty result. Other columns of ``docs`` are not read. Texts are
    taken whole. ``vocabulary`` and ``ranks`` name the two files of one vocabulary, as ``public_tokenizers``
    finds them: the first proves the whole tokens, the second merges the rest.
    """
    ready(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(vocabulary, ranks)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            n = c.count(texts)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()),
                 pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    narrow = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
