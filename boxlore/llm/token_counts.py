"""Edit-aware token counts: a segment tree of pre-token runs per document, of which edits re-encode only what they touch.

A leaf holds a run of whole pre-tokens. Leaves meet only where two characters alone decide that the tokenizer's pattern
starts a new pre-token, whatever else the text holds: before white space that follows something else, behind a run of
letters or of digits, and between signs (but the apostrophe) and letters or digits. An edit replaces the leaves it lies
in, with the neighbour where it comes within two characters of a boundary, encodes just that region anew, and updates the
sums on the path to the root. A single pre-token (of white space, or of one script without a sign) is the least that can be
encoded, so a leaf is longer where a pre-token is.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import BOUNDARY, Vocabulary, compiled, read_vocabulary
from .pii import base_spans
from .textops import blocks, thrifty

#: The vocabulary file of a byte-level BPE, as lines of base64 token and rank; another path may be given.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Characters of a leaf, at least (but for the last).
LEAF = 512
_REACH = 2


@functools.cache
def _boundary():
    return compiled(BOUNDARY)


def load(lines: bytes) -> Callable[[str], int]:
    """A function that counts a text's tokens."""
    vocabulary = Vocabulary(lines)
    return lambda text: len(vocabulary.encode(text))


def cut(text: str, least: int = LEAF) -> list[str]:
    """The text as runs of whole pre-tokens."""
    out, at, search = [], 0, _boundary().search
    while m := search(text, at + least):
        out.append(text[at : m.start()])
        at = m.start()
    return [*out, text[at:]] if at < len(text) or not out else out


class _Node:
    __slots__ = ("left", "right", "text", "chars", "tokens", "height")

    def __init__(self, left: _Node | None = None, right: _Node | None = None, text: str = "", tokens: int = 0):
        self.left, self.right, self.text = left, right, text
        if left is None:
            self.chars, self.tokens, self.height = len(text), tokens, 0
        else:
            self.chars, self.tokens, self.height = left.chars + right.chars, left.tokens + right.tokens, 1 + max(left.height, right.height)


def _balanced(nodes: list[_Node]) -> _Node:
    """One tree of leaves."""
    middle = len(nodes) // 2
    return _Node(_balanced(nodes[:middle]), _balanced(nodes[middle:])) if middle else nodes[0]


def _joined(left: _Node, right: _Node) -> _Node:
    """Two trees as one whose sides' heights differ by at most one everywhere, in steps of the difference of their heights."""
    if left.height > right.height + 1:
        return _turned(left.left, _joined(left.right, right))
    if right.height > left.height + 1:
        return _turned(_joined(left, right.left), right.right)
    return _Node(left, right)


def _turned(left: _Node, right: _Node) -> _Node:
    """A node of two sides whose heights differ by at most two, turned once or twice where they do."""
    if right.height > left.height + 1:
        if right.left.height > right.right.height:
            return _Node(_Node(left, right.left.left), _Node(right.left.right, right.right))
        return _Node(_Node(left, right.left), right.right)
    if left.height > right.height + 1:
        if left.right.height > left.left.height:
            return _Node(_Node(left.left, left.right.left), _Node(left.right.right, right))
        return _Node(left.left, _Node(left.right, right))
    return _Node(left, right)


class TokenTree:
    """A document's segment tree, kept balanced by height; ``tokens`` is the count of its present text, ``encoded`` the characters encoded so far."""

    def __init__(self, text: str, count: Callable[[str], int], leaf: int = LEAF):
        self.count, self.leaf, self.encoded = count, leaf, 0
        self.root = self._tree(text)

    def _tree(self, text: str) -> _Node:
        self.encoded += len(text)
        return _balanced([_Node(text=x, tokens=self.count(x)) for x in cut(text, self.leaf)])

    @property
    def tokens(self) -> int:
        return self.root.tokens

    def text(self) -> str:
        return "".join(x.text for x in self._leaves(self.root))

    def _leaves(self, top: _Node) -> Iterator[_Node]:
        stack = [top]
        while stack:
            x = stack.pop()
            if x.left is None:
                yield x
            else:
                stack += [x.right, x.left]

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace the characters from ``start`` to before ``end``, clipped to the text, by ``new``."""
        start = min(max(start, 0), self.root.chars)
        end = min(max(end, start), self.root.chars)
        if start == end and not new:
            return
        self.root = self._replace(self.root, 0, start - _REACH, end + _REACH, start, end, new)

    def _replace(self, node: _Node, at: int, low: int, high: int, start: int, end: int, new: str) -> _Node:
        """The tree below ``node``, which begins at character ``at``, after the edit; low and high bound what it touches."""
        if node.left is not None:
            middle = at + node.left.chars
            if high <= middle:
                return _joined(self._replace(node.left, at, low, high, start, end, new), node.right)
            if low >= middle:
                return _joined(node.left, self._replace(node.right, middle, low, high, start, end, new))
        # the edit touches a leaf, or both sides of this node: split off the leaves that it leaves alone
        before, after = [], []
        touched = list(self._near(node, at, low, high, before, after))
        base = touched[0][1]
        region = "".join(x.text for x, _ in touched)
        return functools.reduce(_joined, [*before, self._tree(region[: start - base] + new + region[end - base :]), *after])

    def _near(self, node: _Node, at: int, low: int, high: int, before: list, after: list) -> Iterator[tuple[_Node, int]]:
        """Leaves that [low, high) meets, in order; subtrees to their left and right go to ``before`` and ``after``."""
        if at + node.chars <= low:
            before.append(node)
        elif at >= high:
            after.append(node)
        elif node.left is None:
            yield node, at
        else:
            yield from self._near(node.left, at, low, high, before, after)
            yield from self._near(node.right, at + node.left.chars, low, high, before, after)


def redactions(text: str) -> list[tuple[int, int, str]]:
    """The edits of the query: every base span of personal data is replaced by its kind, from the last to the first."""
    spans, out, at = base_spans(text), [], 0
    for a, b, kind in spans:
        if a >= at:
            out.append((a, b, f"[{kind.upper()}]"))
            at = b
    return out[::-1]


def token_counts(docs: DataFrame, edits: DataFrame | Callable[[str], Iterable[tuple[int, int, str]]] = redactions, vocabulary: str = VOCABULARY, id_column: str = "doc_id") -> DataFrame:
    """Per document: doc_id, n_tokens, n_edits, n_tokens_edited, n_chars, n_chars_encoded (of the edits' regions only).

    edits: a function of the text, or a table (doc_id, turn, start, end, replacement) whose edits are applied in the order
    of turn, each to the text that the ones before have left; offsets are code points and are clipped to the text. Null
    texts are empty; a null doc_id keeps its row and takes no edits of a table; rows of one id each get all its edits;
    an empty table gives an empty one. Extra columns are ignored. A document's tree lives only while it is counted.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(read_vocabulary(spark, vocabulary))  # the vocabulary, under a megabyte
    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    given = None if isinstance(edits, DataFrame) else edits
    if given is None:
        turns = edits.where("doc_id is not null").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("turn", "start", "end", "replacement"))).alias("edits"))
        source = source.join(turns, "doc_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = load(sent.value)
        for block in blocks(batches):
            rows = []
            listed = block.column("edits").to_pylist() if given is None else [None] * block.num_rows
            for doc_id, text, own in zip(block.column("doc_id").to_pylist(), block.column("text").to_pylist(), listed):
                tree = TokenTree(text, count)
                n = tree.tokens
                todo = list(given(text)) if given else [(e["start"], e["end"], e["replacement"] or "") for e in own or ()]
                for edit in todo:
                    tree.edit(*edit)
                rows.append((doc_id, n, len(todo), tree.tokens, len(text), tree.encoded - len(text)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(6)], names=["doc_id", "n_tokens", "n_edits", "n_tokens_edited", "n_chars", "n_chars_encoded"])

    return source.mapInArrow(thrifty(run), "doc_id bigint, n_tokens bigint, n_edits bigint, n_tokens_edited bigint, n_chars bigint, n_chars_encoded bigint")
