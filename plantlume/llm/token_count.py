"""Token counts that follow edits.

A text is cut into pre-tokens by the tokenizer's pattern; a token never crosses them, so the count
of a text is the sum over its pre-tokens. A document keeps a segment tree: its leaves are runs of
pre-tokens, every node has the characters and tokens below it. An edit finds its place by
characters, encodes again only from the last pre-token boundary that it can't influence to the
first old boundary that returns behind it, and adds the differences on the way up.
"""

from __future__ import annotations

import base64
import re
from functools import partial

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import Batches, arrow_map, arrow_type

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LEAF = 64  # pre-tokens a leaf begins with
LOOK = 3  # characters a match of the pattern can look at beyond its end, white space runs aside
CACHE_PIECES = 300_000


class Counter(dict):
    """Tokens of a pre-token, remembered."""

    def __init__(self, vocabulary: str):
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.split = regex.compile(PATTERN)

    def __missing__(self, piece: str) -> int:
        if len(self) > CACHE_PIECES:
            self.clear()
        n = len(self.encode(piece))
        if len(piece) < 64:
            self[piece] = n
        return n

    def pieces(self, text: str) -> list[str]:
        return self.split.findall(text)

    def count(self, text: str) -> int:
        return sum(map(self.__getitem__, self.pieces(text)))


class TokenTree:
    """Segment tree over the pre-tokens of one text."""

    def __init__(self, text: str, counter: Counter):
        self.counter = counter
        pieces = counter.pieces(text)
        tokens = np.fromiter(map(counter.__getitem__, pieces), np.int64, len(pieces))
        cuts = np.arange(0, max(1, len(pieces)), LEAF)
        self.texts = ["".join(pieces[i : i + LEAF]) for i in cuts.tolist()]
        leaf_tokens = np.add.reduceat(tokens, cuts) if len(pieces) else np.zeros(1, np.int64)
        level = np.stack([np.fromiter(map(len, self.texts), np.int64, len(cuts)), leaf_tokens], 1)
        self.levels = [level]
        while len(level) > 1:
            level = np.add.reduceat(level, np.arange(0, len(level), 2), axis=0)
            self.levels.append(level)
        self.encoded = 0  # pre-tokens encoded again by edits

    @property
    def chars(self) -> int:
        return int(self.levels[-1][0][0])

    @property
    def tokens(self) -> int:
        return int(self.levels[-1][0][1])

    def text(self) -> str:
        return "".join(self.texts)

    def _leaf(self, at: int) -> tuple[int, int]:
        """Leaf with character ``at`` (the last leaf for the end), and where it begins."""
        node, start = 0, 0
        for level in reversed(self.levels[:-1]):
            node *= 2
            left = int(level[node][0])
            if at >= start + left and node + 1 < len(level):
                node, start = node + 1, start + left
        return node, start

    def _set(self, leaf: int, text: str, tokens: int) -> None:
        delta = np.array([len(text), tokens]) - self.levels[0][leaf]
        self.texts[leaf] = text
        for level in self.levels:
            level[leaf] += delta
            leaf //= 2

    def _safe(self, upto: str) -> bool:
        """May a match begin here whatever comes behind ``upto``? What ends here saw no further."""
        return len(upto) >= LOOK and not upto.isspace()

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace the characters from ``start`` to ``end`` (exclusive, at most the text's length)."""
        start, end = max(0, min(start, self.chars)), max(0, min(end, self.chars))
        end = max(start, end)
        first, begin = self._leaf(start)
        before = self.texts[first][: start - begin]
        while first and not self._safe(before):
            first -= 1
            begin -= len(self.texts[first])
            before = self.texts[first] + before
        last, last_begin = self._leaf(end)
        region = before + new + self.texts[last][end - last_begin :]
        behind, ends = last + 1, {}  # old boundary in the new region: leaf that begins there
        while True:
            # add leaves until a boundary has enough text behind it to be sure of the match that ends there
            ends[len(region)] = behind
            extra = behind
            tail = ""
            while extra < len(self.texts) and not self._safe(tail):
                tail += self.texts[extra]
                extra += 1
            pieces, at, stop = [], 0, None
            for m in self.counter.split.finditer(region + tail):
                if m.start() in ends and (m.start() <= len(region)):
                    stop = ends[m.start()]
                    break
                pieces.append(m.group())
            if stop is None and extra >= len(self.texts):
                stop = extra  # the end of the text is always a boundary
            if stop is not None:
                break
            region += tail
            behind = extra
        self.encoded += len(pieces)
        self._set(first, "".join(pieces), sum(map(self.counter.__getitem__, pieces)))
        for leaf in range(first + 1, stop):
            self._set(leaf, "", 0)


def redactions(text: str) -> list[tuple[int, int, str]]:
    """Edits that replace e-mail addresses and numbers of seven digits or more (telephone, cards)."""
    out = []
    if "@" in text:
        out += [(m.start(), m.end(), "[EMAIL]") for m in _EMAIL.finditer(text)]
    out += [(m.start(), m.end(), "[NUMBER]") for m in _NUMBER.finditer(text)]
    out.sort()
    return [e for i, e in enumerate(out) if not i or e[0] >= out[i - 1][1]]


_EMAIL = re.compile(r"(?<![\w.+-])[\w.+-]++@[\w-]++(?:\.[\w-]++)+")
_NUMBER = re.compile(r"(?<![\w+])(?=\+?(?:[ ().-]{0,2}\d){7})\+?\(?\d++\)?(?:[ .-]{0,2}\(?\d++\)?){0,5}+")


def _recount(batches: Batches, schema: pa.Schema, vocabulary: str, edits_of) -> Batches:
    counter = Counter(vocabulary)
    for batch in batches:
        given = batch.column("edits").to_pylist() if "edits" in batch.schema.names else None
        rows = {"n_tokens": [], "n_edits": [], "n_tokens_edited": [], "n_leaves": [], "n_encoded": []}
        texts = []
        for k, text in enumerate(batch.column("text").to_pylist()):
            text = text or ""
            edits = [(e["start"], e["end"], e["new"] or "") for e in given[k] or ()] if given else edits_of(text)
            tree = TokenTree(text, counter)
            rows["n_tokens"].append(tree.tokens)
            rows["n_leaves"].append(len(tree.texts))
            for start, end, new in sorted(edits, reverse=True):  # from the back, so earlier places stay as given
                tree.edit(start, end, new)
            rows["n_edits"].append(len(edits))
            rows["n_tokens_edited"].append(tree.tokens)
            rows["n_encoded"].append(tree.encoded)
            texts.append(tree.text() if "text" in schema.names else None)
        arrays = [batch.column("doc_id"), *(pa.array(v, pa.int64()) for v in rows.values())]
        yield pa.RecordBatch.from_arrays(arrays + ([pa.array(texts, pa.string())] if "text" in schema.names else []), schema=schema)


def recount(docs: DataFrame, edits_of=redactions, vocabulary: str = VOCABULARY, with_text: bool = False) -> DataFrame:
    """Token counts of every row of ``docs`` (``doc_id``, ``text``) before and after edits.

    Edits come from a column ``edits``, an array of structs ``start, end, new`` (characters of the
    text, not overlapping; places beyond the end are moved to it), or else from ``edits_of(text)``.
    Returns ``doc_id, n_tokens, n_edits, n_tokens_edited, n_leaves, n_encoded`` (leaves of the tree;
    pre-tokens encoded again), with ``with_text`` also the edited ``text``. Null and empty texts
    have no tokens. Repeated rows are counted each; other columns are ignored.
    """
    kind = docs.schema["doc_id"].dataType
    names = ["n_tokens", "n_edits", "n_tokens_edited", "n_leaves", "n_encoded"]
    fields = [T.StructField("doc_id", kind), *(T.StructField(n, T.LongType()) for n in names)]
    fields += [T.StructField("text", T.StringType())] * with_text
    schema = pa.schema([pa.field(f.name, arrow_type(f.dataType)) for f in fields])
    columns = ["doc_id", "text"] + ["edits"] * ("edits" in docs.columns)
    fn = partial(_recount, schema=schema, vocabulary=vocabulary, edits_of=edits_of)
    return arrow_map(docs.select(*columns), fn, T.StructType(fields))
