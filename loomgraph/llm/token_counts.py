"""Token counts by the whole-token shortcut.

What is proved once for a vocabulary, before any text is read: no piece holds
the space mark after another character, so no merge crosses the place where a
run of space marks begins; and which pieces encode alone as one token. A text
is then a sequence of pre-tokens cut before each run of spaces. A pre-token
that is a proven whole token counts one; the library merges only the rest,
each distinct one once for as long as it stays in the bounded memory.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy

SPACE = "▁"
#: Distinct pre-tokens that a Python worker remembers besides the proven ones.
MOST_KEPT = 300_000
#: A longer pre-token is not remembered.
LONGEST_KEPT = 64


class Counter(dict):
    """Pre-token, as it stands after the text's spaces became marks, to its number of tokens."""

    def __init__(self, path: str):
        import sentencepiece

        super().__init__()
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        m = self.model
        pieces = [m.id_to_piece(i) for i in range(m.vocab_size())]
        #: With any of these false, every text goes to the library.
        normal = [p for i, p in enumerate(pieces) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i))]
        self.cuts = all(SPACE not in p.lstrip(SPACE) for p in normal) and m.encode("a  b", out_type=str)[0] == SPACE + "a" and m.encode(" a") == m.encode(SPACE + "a")
        #: One symbol that is read as a whole at the start of a text after the dummy prefix; its own tokens are taken off again.
        self.guard = "\n"
        self.guarded = len(m.encode(self.guard)) if self.cuts else 0
        self.cuts = self.cuts and self.guard not in "".join(normal)
        self.whole = frozenset(p for p in normal if self.cuts and self.guard not in p and self._merge(p) == 1)
        self.fresh()

    def fresh(self):
        self.clear()
        self.update(dict.fromkeys(self.whole, 1))

    def _merge(self, piece: str) -> int:
        """Tokens of a pre-token inside a text: no token spans the guard, whose tokens are taken off."""
        return len(self.model.encode(self.guard + piece)) - self.guarded

    def __missing__(self, piece: str) -> int:
        n = self._merge(piece)
        if len(piece) <= LONGEST_KEPT:
            if len(self) > len(self.whole) + MOST_KEPT:
                self.fresh()
            self[piece] = n
        return n

    def count(self, text: str) -> int:
        if not text:
            return 0
        if not self.cuts or "\0" in text:
            return len(self.model.encode(text))
        text = text.replace(" ", SPACE)
        if SPACE + SPACE in text or text[0] == SPACE:
            return sum(map(self.__getitem__, _RUNS.findall(SPACE + text)))
        # between single spaces: the words with their marks
        return sum(map(self.__getitem__, _WORDS.findall(SPACE + text)))


_RUNS = re.compile(f"{SPACE}+[^{SPACE}\\n]*|[^{SPACE}\\n]+|\\n+")
_WORDS = re.compile(f"{SPACE}[^{SPACE}\\n]*|[^{SPACE}\\n]+|\\n+")


@lru_cache(maxsize=4)
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(docs: DataFrame, model_path: str, id_col: str = "doc_id", limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit for each row of docs.

    Null and empty texts have no tokens; texts of any length are counted whole;
    repeated rows, null ids and an empty table keep their rows; other columns
    are not read.
    """

    def run(batches):
        c = counter(model_path)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_bytes": b["n_bytes"], "n_tokens": [c.count(t) for t in b["text"]]})

    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text")
    kind = docs.schema[id_col].dataType.simpleString()
    out = rows.mapInPandas(tidy(run), f"doc_id {kind}, n_bytes bigint, n_tokens bigint")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
