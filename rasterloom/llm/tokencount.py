"""Edit-aware token counts: a segment tree of pre-tokens per document.

Leaves are blocks of consecutive pre-tokens (character length and token count of each); inner
nodes hold sums.  An edit descends to the pre-tokens it touches, re-encodes from the last
boundary that cannot have seen the edited characters until a new boundary meets an old one,
and updates the sums on the path to the root.  Everything else keeps its counts.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession

from .shared import table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# fixed value: the vocabulary's pre-tokenisation pattern
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LOOKAHEAD = 2  # a match looks at most this many characters past its end
BLOCK = 64  # pre-tokens of a leaf
MAX_PIECE = 512  # longer pre-tokens are not cached
EDITS = regex.compile(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+|\d[\d ().-]{7,}\d")
REPLACEMENT = "<redacted>"


class Encoder:
    """Token count of one pre-token, cached; built from the vocabulary file's bytes."""

    def __init__(self, ranks: bytes, pattern: str = PATTERN) -> None:
        pairs = (line.split() for line in ranks.splitlines() if line)
        self._bpe = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={})
        self.pattern = regex.compile(pattern)
        self._cached = lru_cache(1 << 16)(self._encode)

    def _encode(self, piece: str) -> int:
        return len(self._bpe._encode_single_piece(piece))

    def count(self, piece: str) -> int:
        return self._encode(piece) if len(piece) > MAX_PIECE else self._cached(piece)

    def full(self, text: str) -> int:
        return len(self._bpe.encode_ordinary(text))


class CountedText:
    """A text with its pre-token segment tree.  ``tokens`` is always the count of ``text``."""

    def __init__(self, text: str, encoder: Encoder) -> None:
        self.text, self.encoder, self.encoded = text, encoder, 0
        pieces = [(m.end() - m.start(), self._count(m.group())) for m in encoder.pattern.finditer(text)]
        self._build([pieces[k : k + BLOCK] for k in range(0, len(pieces), BLOCK)])

    def _count(self, piece: str) -> int:
        self.encoded += 1
        return self.encoder.count(piece)

    def _build(self, blocks: list[list[tuple[int, int]]]) -> None:
        self.leaves = blocks or [[]]
        self.width = 1 << (len(self.leaves) - 1).bit_length()
        self.sums = [(0, 0)] * (2 * self.width)
        for k in range(len(self.leaves)):
            self.sums[self.width + k] = self._leaf_sum(k)
        for node in range(self.width - 1, 0, -1):
            self.sums[node] = self._add(2 * node)

    def _leaf_sum(self, k: int) -> tuple[int, int]:
        return sum(n for n, _ in self.leaves[k]), sum(c for _, c in self.leaves[k])

    def _add(self, left: int) -> tuple[int, int]:
        a, b = self.sums[left], self.sums[left + 1]
        return a[0] + b[0], a[1] + b[1]

    def _refresh(self, k: int) -> None:
        node = self.width + k
        self.sums[node] = self._leaf_sum(k)
        while node > 1:
            node >>= 1
            self.sums[node] = self._add(2 * node)

    @property
    def tokens(self) -> int:
        return self.sums[1][1]

    def _find(self, position: int) -> tuple[int, int]:
        """``(leaf, its first character)`` of the leaf that holds ``position`` (the last one past the end)."""
        node, start = 1, 0
        while node < self.width:
            node *= 2
            if position >= start + self.sums[node][0] and self.sums[node + 1][0]:
                start += self.sums[node][0]
                node += 1
        return min(node - self.width, len(self.leaves) - 1), start

    def edit(self, start: int, end: int, replacement: str) -> None:
        """Replace characters ``start:end``."""
        shift = len(replacement) - (end - start)
        self.text = self.text[:start] + replacement + self.text[end:]
        first, at = self._find(max(0, start - LOOKAHEAD))
        while first > 0 and at + LOOKAHEAD > start:  # the leaf before may end too near to the edit
            first -= 1
            at -= self.sums[self.width + first][0]
        keep = []
        for piece in self.leaves[first]:
            if at + piece[0] + LOOKAHEAD > start:
                break
            keep.append(piece)
            at += piece[0]
        # old boundaries from `at` on, read lazily
        last, inside, old = first, len(keep), at
        new, pos, fresh_to = [], at, start + len(replacement)
        while pos < len(self.text):
            if pos >= fresh_to:
                while old + shift < pos and last < len(self.leaves):
                    if inside < len(self.leaves[last]):
                        old += self.leaves[last][inside][0]
                        inside += 1
                    if inside >= len(self.leaves[last]):
                        last, inside = last + 1, 0
                if old + shift == pos and old >= end:
                    break
            m = self.encoder.pattern.match(self.text, pos)
            new.append((m.end() - pos, self._count(m.group())))
            pos = m.end()
        else:
            last, inside = len(self.leaves), 0
        tail = self.leaves[last][inside:] if last < len(self.leaves) else []
        final = min(last, len(self.leaves) - 1)
        merged = keep + new + tail
        if final - first > 8 or len(merged) > 8 * BLOCK:
            blocks = self.leaves[:first] + [merged[k : k + BLOCK] for k in range(0, len(merged), BLOCK)] + self.leaves[final + 1 :]
            self._build(blocks)
            return
        self.leaves[first] = merged
        for k in range(first + 1, final + 1):
            self.leaves[k] = []
        for k in range(first, final + 1):
            self._refresh(k)


def apply_edits(text: str, edits: list[tuple[int, int, str]], encoder: Encoder) -> tuple[int, CountedText, int]:
    """Edits are ``(start, end, replacement)`` in the original text, not overlapping, in order."""
    doc = CountedText(text, encoder)
    before, shift, doc.encoded = doc.tokens, 0, 0
    for start, end, replacement in edits:
        doc.edit(start + shift, end + shift, replacement)
        shift += len(replacement) - (end - start)
    return before, doc, doc.encoded


def redactions(text: str) -> list[tuple[int, int, str]]:
    """E-mail addresses and long digit runs, each replaced by a placeholder."""
    return [(m.start(), m.end(), REPLACEMENT) for m in EDITS.finditer(text)]


def count_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, edits=redactions) -> DataFrame:
    """``(id, n_tokens, n_edits, n_tokens_edited, n_reencoded)`` per row; null text is empty with no tokens.

    ``edits`` maps a text to its edits.  ``n_reencoded`` counts the pre-tokens encoded anew.
    Rows are independent: repeated rows, null ids and extra columns need no care, nothing is ranked, so there are
    no ties.  Whole texts are counted, a long one in one tree.  An empty table gives no rows.
    """
    with open(vocabulary, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())  # one vocabulary file, under 1 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            out = []
            for text in batch.column(1):
                text = text.as_py() or ""
                todo = edits(text)
                before, doc, touched = apply_edits(text, todo, encoder)
                out.append((before, len(todo), doc.tokens, touched))
            cols = list(zip(*out)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in cols)], names=["id", "n_tokens", "n_edits", "n_tokens_edited", "n_reencoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, n_tokens long, n_edits long, n_tokens_edited long, n_reencoded long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_edited(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
