"""Unigram token counts of whole texts by dynamic programming over a trie of distinct pre-tokens.

A pre-token is a word (white space parts words) with the vocabulary's word-begin mark before it.  Its
tokens are the pieces of the segmentation with the best sum of scores; of equal sums the one with fewer
pieces counts.  The forward score and count of a prefix depend on that prefix only.  So the distinct
pre-tokens of a batch are visited in sorted order, which is a walk of their trie: the scores up to the
prefix shared with the word before are kept on the path, and only the new characters are computed.
Counts at the ends are stored and looked up for each text.

The vocabulary is read on the driver from a public tokenizer's file, whose path is a parameter, and
broadcast (its size is checked).  That file holds no unigram model, so a piece's score is the log of a
Zipf estimate from its rank, ``-log(rank + 1)``.  A character without a piece falls back to its UTF-8
bytes: one token each, at the score of the worst piece.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speechspark.llm.common import by_size

MARK = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MAX_PIECES = 1_000_000
#: Stored counts a worker keeps between batches; a full store is emptied, which changes no result.
STORE = 1_000_000
#: Text whose words are held at a time.
SLICE_MB = 4


def load_pieces(path: str = MODEL) -> dict[str, float]:
    """Scores of the vocabulary's ordinary pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ordinary = [
        model.id_to_piece(k) for k in range(model.get_piece_size())
        if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k) or model.is_unused(k))
    ]
    if len(ordinary) > MAX_PIECES:
        raise ValueError("the vocabulary is larger than the broadcast's bound")
    return {piece: -math.log(rank + 1) for rank, piece in enumerate(ordinary, 1)}


class Forward:
    """Counts tokens of pre-tokens; ``steps`` counts the characters at which scores were computed."""

    def __init__(self, pieces: dict[str, float]):
        self.pieces, self.longest = pieces, max(map(len, pieces), default=1)
        self.worst = min(pieces.values(), default=-1.0) - 1.0
        self.steps = 0

    def counts(self, pretokens: list[str]) -> dict[str, int]:
        """Token counts of distinct pre-tokens, over their trie in depth-first order."""
        pieces, longest, out, before = self.pieces, self.longest, {}, ""
        score, count = [0.0], [0]
        for word in sorted(pretokens):
            shared = 0
            for a, b in zip(word, before, strict=False):
                if a != b:
                    break
                shared += 1
            del score[shared + 1:], count[shared + 1:]
            for end in range(shared + 1, len(word) + 1):
                size = len(word[end - 1].encode("utf-8", "surrogatepass"))
                best, fewest = score[end - 1] + size * self.worst, count[end - 1] + size
                for begin in range(max(0, end - longest), end):
                    s = pieces.get(word[begin:end])
                    if s is not None:
                        total = score[begin] + s
                        if total > best or total == best and count[begin] + 1 < fewest:
                            best, fewest = total, count[begin] + 1
                score.append(best)
                count.append(fewest)
            self.steps += len(word) - shared
            out[word] = count[-1]
            before = word
        return out


_KEPT: dict = {}


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, model_path: str = MODEL, store: int = STORE) -> DataFrame:
    """Id, ``n_words`` and ``n_tokens`` of every row, over whole texts, without any exchange.

    Null and empty texts have no tokens; null ids are kept; repeated rows repeat; other columns are not
    read; an empty table gives no rows.  A batch's distinct words are held at a time, never a corpus's.
    """
    sent = docs.sparkSession.sparkContext.broadcast(load_pieces(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (model_path, len(sent.value))
        if key not in _KEPT:
            _KEPT.clear()
            _KEPT[key] = (Forward(sent.value), {})
        forward, known = _KEPT[key]
        for b in (part for whole in batches for part in by_size(whole, 1, SLICE_MB * 2**20)):
            texts = [(x.as_py() or "").encode("utf-8", "surrogatepass").split() for x in b.column(1)]
            fresh = set().union(*texts).difference(known) if texts else set()
            if len(known) + len(fresh) > store:
                known.clear()
                fresh = set().union(*texts)
            pre = {MARK + w.decode("utf-8", "surrogatepass"): w for w in fresh}
            for word, n in forward.counts(list(pre)).items():
                known[pre[word]] = n
            tokens = [sum(map(known.__getitem__, w)) for w in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(map(len, texts), pa.int64()), pa.array(tokens, pa.int64())],
                names=["i", "n_words", "n_tokens"])

    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    kind = rows.schema["i"].dataType.simpleString()
    return rows.mapInArrow(run, f"i {kind}, n_words long, n_tokens long").withColumnRenamed("i", id_col)
