"""Texts to SentencePiece ids and back, by a table of distinct marked words.

The model's pieces never hold a whitespace marker after another character
(checked when it is loaded), so no merge crosses from one marked word, a run of
markers and what follows it, to the next. Each distinct marked word of a batch
is segmented once and its ids are put wherever it stands.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from terrafold.llm.arrow_map import map_texts

MARK = "▁"
_CHUNK = re.compile(" *[^ ]+| +")
_SPLIT_PIECE = re.compile(f"[^{MARK}]{MARK}")
#: Bytes, about, of the words kept from slice to slice with their ids; the table starts anew beyond it. A word of more
#: characters than WORD_MOST (a line without spaces, a packed file) is kept for its slice only.
TABLE_BYTES, WORD_MOST = 48 << 20, 256
#: Bytes of text in a slice: its distinct words and ids are Python objects, many times as large.
SLICE_BYTES = 2 << 20


def model_path(name: str = "piece_bpe_32k.model") -> str:
    """Where the installed public tokenizer files keep a model."""
    import public_tokenizers

    return public_tokenizers.path(name)


class ChunkTable:
    """Distinct marked words with their ids (as numbers and as text) and their decoded form."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        self.apart = not any(_SPLIT_PIECE.search(p) for p in pieces)
        # Only a model that keeps text as it is, but for a marker put before it, can be read word by word.
        probe = " a  b ﬁ "
        self.apart &= self.library.decode(self.library.encode(probe)) == probe and self.library.encode("a") == self.library.encode("a b")[:1]
        self.clear()

    def clear(self) -> None:
        self.ids: dict[str, list[int]] = {}
        self.text: dict[str, str] = {}
        self.back: dict[str, str] = {}
        self.held, self.long = 0, []

    def learn(self, words: set[str]) -> None:
        """Segment the words that the table lacks, all in one call."""
        for w in self.long:
            del self.ids[w], self.text[w], self.back[w]
        self.long = []
        if self.held > TABLE_BYTES:
            self.clear()
        new = [w for w in words if w not in self.ids]
        # The library itself puts a marker before a text, so each word goes without its first.
        bare = [w[1:] for w in new]
        for w, b, ids in zip(new, bare, self.library.encode(bare, num_threads=1), strict=True):
            if not b:  # a lone marker: of an empty text the library makes nothing
                ids = [self.library.piece_to_id(MARK)]
            self.ids[w] = ids
            self.text[w] = ",".join(map(str, ids))
            if len(w) > WORD_MOST:
                self.long.append(w)
            else:
                self.held += 500 + 3 * len(w) + 46 * len(ids)
        if not new:
            return
        # Words are decoded many at a time, each lot as one text; of a lot that does not come back as it was each word is decoded alone.
        lots = [new[i : i + 100] for i in range(0, len(new), 100)]
        for lot, back in zip(lots, self.library.decode([[i for w in lot for i in self.ids[w]] for lot in lots], num_threads=1), strict=True):
            if back == "".join(lot)[1:]:
                self.back.update((w, w[1:]) for w in lot)
            else:
                self.back.update(zip(lot, self.library.decode([self.ids[w] for w in lot], num_threads=1), strict=True))

    def words(self, text: str) -> list[str]:
        return _CHUNK.findall(" " + text.replace(MARK, " ")) if text else []


def _codec(path: str, ids: bool):
    def make():
        table = ChunkTable(path)

        def whole(texts: list[str]) -> list:
            rows = [table.library.encode(t, num_threads=1) for t in texts]
            return [rows, [",".join(map(str, r)) for r in rows], [table.library.decode(r) for r in rows], [len(r) for r in rows]]

        def chunked(texts: list[str]) -> list:
            split = [table.words(t) for t in texts]
            table.learn(set().union(*map(set, split)))
            number, text, back = table.ids.__getitem__, table.text.__getitem__, table.back.__getitem__
            rows = [[i for w in ws for i in number(w)] for ws in split] if ids else None
            joined = [",".join(map(text, ws)) for ws in split]
            # Every word but the first shows its first marker as a space; decoding one alone drops it.
            decoded = [" ".join(map(back, ws)) for ws in split]
            return [rows, joined, decoded, [j.count(",") + 1 if j else 0 for j in joined]]

        def run(texts: list) -> list:
            given = [t or "" for t in texts]
            rows, joined, decoded, n = (chunked if table.apart else whole)(given)
            sha = lambda xs: [hashlib.sha256(x.encode()).hexdigest() for x in xs]
            out = [n, sha(joined), sha(decoded)]
            if ids:
                ends = np.cumsum([0] + [len(r) for r in rows])
                out.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array([i for r in rows for i in r], pa.int32())))
            return out

        return run

    return make


def encode_decode(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), model: str | None = None, ids: bool = False) -> DataFrame:
    """``keep`` columns, ``n_tokens``, ``ids_sha256`` of the comma-joined ids, ``decoded_sha256`` of the
    text decoded from them and, if asked for, ``ids`` themselves.

    Ids are those of the library: no begin or end ids, no sampling. A null text is
    read as empty: no ids, decoded empty. Rows stay as they are, repeats too; an empty table gives
    an empty result; columns outside ``keep`` take no part. A model whose
    pieces cross whitespace is applied to whole texts.
    """
    fields = [StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())]
    if ids:
        fields.append(StructField("ids", ArrayType(IntegerType())))
    return map_texts(df, text, list(keep), StructType(fields), _codec(model or model_path(), ids), SLICE_BYTES if ids else 2 * SLICE_BYTES)
