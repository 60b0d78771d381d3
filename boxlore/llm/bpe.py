"""A byte-level BPE vocabulary: ids of any text, however long its runs, and the bytes of ids."""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

from pyspark.sql import SparkSession

#: Fixed value: the pattern that cuts a text into pre-tokens, each of which is merged on its own.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Fixed value: the characters that the pattern's ``\s`` takes, for use within a character class.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Scripts whose letters, digits and signs are the same in every version of Unicode that a tokenizer may have been built with.
_STABLE = r"\x00-\x7f\xa1-ɏΑ-ΡΣ-ωА-я、。ぁ-ゖァ-ヺ一-龥가-힣！-～"
#: Where every cut of every text that holds these two characters has a boundary: no alternative of the pattern goes on over it.
BOUNDARY = "|".join((
    rf"(?<=[^{WHITE}])(?=[{WHITE}])",
    rf"(?<=[\p{{L}}&&[{_STABLE}]])(?=[[{_STABLE}]--\p{{L}}--[{WHITE}]])",
    rf"(?<=[\p{{N}}&&[{_STABLE}]])(?=[[{_STABLE}]--\p{{N}}--[{WHITE}]])",
    rf"(?<=[[{_STABLE}]--[\p{{L}}\p{{N}}'{WHITE}]])(?=[[\p{{L}}\p{{N}}]&&[{_STABLE}]])",
))
#: A text of up to so many characters goes to the tokenizer as it is; in longer ones a run could exhaust the stack of its matcher.
SAFE = 1 << 18


def compiled(pattern: str):
    """The pattern, where sets may be subtracted and intersected."""
    import regex

    return regex.compile(pattern, regex.V1)


def read_vocabulary(spark: SparkSession, path: str) -> bytes:
    """The file's bytes, by Python on the driver or else by Spark's readers."""
    try:
        with open(path, "rb") as f:
            return f.read()
    except OSError:
        return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])


class Vocabulary:
    """Tokens by rank, from lines of base64 token and rank."""

    def __init__(self, lines: bytes):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines())}
        self.encoding = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.pattern, self.boundary = compiled(PATTERN), compiled(BOUNDARY)

    def _runs(self, text: str) -> Iterator[tuple[int, int, bool]]:
        """(begin, end, alone) of runs of whole pre-tokens that end in no white space, and of single pre-tokens between them."""
        at = 0
        while at < len(text):
            if len(text) - at <= SAFE:
                yield at, len(text), False
                return
            if m := self.boundary.search(text, at + SAFE // 2, at + SAFE):
                yield at, m.start(), False
                at = m.start()
                continue
            good, held = at, []  # a run without boundaries: pre-token by pre-token, until there is one again
            for m in self.pattern.finditer(text, at):
                if not text[m.end() - 1].isspace() and m.end() - at <= SAFE:
                    good, held = m.end(), []
                    continue
                held.append(m.span())
                if m.end() - at > SAFE:
                    break
            if good > at:
                yield at, good, False
            for a, b in held:
                yield a, b, True
            at = held[-1][1] if held else good

    def encode(self, text: str) -> list[int]:
        """The text's ids, special tokens being ordinary text. Each pre-token is merged on its own, so cuts between them change nothing."""
        if len(text) <= SAFE:
            return self.encoding.encode_ordinary(text)
        out: list[int] = []
        for a, b, alone in self._runs(text):
            out += self.encoding._encode_single_piece(text[a:b]) if alone else self.encoding.encode_ordinary(text[a:b])
        return out

    def decode(self, ids: Iterable[int]) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[x] for x in ids])
