"""Operator 3: exact token counts of every prefix of a text, by prefix dynamic programming.

The last token of a BPE encoding is unique, so the encoding of a prefix is the encoding of a shorter prefix plus one token that
may follow the token before it. ``PrefixCounter`` keeps, for each pre-token, the count at each of its characters; a
``PrefixTable`` adds them up along a text and answers "how many tokens are in the first i characters" and "how many
characters fit n tokens" by look-ups, without encoding the text again.

A pre-token's counts are worked out in one pass over the tokens that occur in it, and kept while a text is cut, so a text without any
space, or of one long run of blanks, takes time in proportion to its length.

Null and empty texts have 0 tokens; an empty table gives no rows. Special strings inside a text are one token each, as in the library's default. Repeated rows
give repeated rows; columns other than the two named ones are not read, so clashing names do not matter.
"""

from __future__ import annotations

import functools
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from itertools import accumulate, chain

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from llm import bpe
from llm.common import byte_texts, column

# The white space of Unicode, which the split's pattern calls \s, and the pattern's contractions.
WHITE = frozenset("\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
CONTRACTIONS = frozenset(("'s", "'t", "'re", "'ve", "'m", "'ll", "'d"))
KEPT_PRETOKENS = 500_000  # per generation of the cache; results do not depend on it
CACHED_LENGTH = 64
LEARNED_TOGETHER = 256  # documents


class PrefixCounter:
    """Counts at each character of a pre-token. Two generations of a bounded cache keep the frequent ones."""

    def __init__(self, vocabulary: bpe.ByteBpe, kept: int = KEPT_PRETOKENS):
        self.vocabulary, self.kept = vocabulary, kept
        self.pattern = bpe.pattern()
        self.special = regex.compile("|".join(map(regex.escape, sorted(vocabulary.specials, key=len, reverse=True))) or r"(?!)")
        self.reachable = vocabulary.reachable
        self.longest = max(map(len, self.reachable))
        self.shown = dict(enumerate(vocabulary.characters))
        self.byte_of = {c: b for b, c in self.shown.items()}
        self.new: dict[str, bytes | tuple[int, ...]] = {}
        self.old: dict[str, bytes | tuple[int, ...]] = {}
        self.follows: dict[int, bool] = {}
        self._row: tuple[str, list[int], list[int]] = ("", [0], [0])  # last pre-token: last token and count at each byte
        self._long: tuple[str, bytes | tuple[int, ...]] = ("", b"")  # the last one too long for the cache

    def _may_follow(self, before: int, token: int) -> bool:
        if len(self.follows) > 2 * self.kept:
            self.follows.clear()
        found = self.follows[before << 32 | token] = self.vocabulary.stay_apart(before, token)
        return found

    @functools.cached_property
    def _tokens_at(self) -> ahocorasick.Automaton:
        """Finds all tokens that end at each character, the longest first."""
        found = ahocorasick.Automaton()
        for token, number in self.reachable.items():
            found.add_word(token, (len(token), number))
        found.make_automaton()
        return found

    def _long_counts(self, shown: str) -> list[int]:
        """Counts at 0, 1, ... bytes of a long pre-token: only tokens that occur are tried, in one pass."""
        last, counts, follows = [0], [0], self.follows.get
        for end, (length, token) in self._tokens_at.iter(shown):
            if len(counts) == end + 2:
                continue  # settled by a longer one
            start = end + 1 - length
            if start:
                before = last[start]
                fits = follows(before << 32 | token)
                if not (self._may_follow(before, token) if fits is None else fits):
                    continue
            if len(counts) != end + 1:
                break
            last.append(token)
            counts.append(counts[start] + 1)
        if len(counts) != len(shown) + 1:
            raise ValueError(f"no token ends at byte {len(counts)} of {shown[:100]!r}...")
        return counts

    def _counts(self, pretoken: str) -> bytes | tuple[int, ...]:
        data = pretoken.encode("utf-8", "surrogatepass")
        shown = data.decode("latin-1").translate(self.shown)
        if len(shown) > 4 * CACHED_LENGTH:
            return self._by_character(pretoken, data, self._long_counts(shown))
        token_of, follows, longest = self.reachable.get, self.follows.get, self.longest
        before_it, last, counts = self._row
        # Two texts with a common beginning have the same table up to its end.
        common = 0
        for a, b in zip(before_it, shown):  # noqa: B905
            if a != b:
                break
            common += 1
        del last[common + 1:], counts[common + 1:]
        for end in range(common + 1, len(shown) + 1):
            for start in range(end - longest if end > longest else 0, end):
                token = token_of(shown[start:end])
                if token is not None:
                    if start:
                        before = last[start]
                        fits = follows(before << 32 | token)
                        if not (self._may_follow(before, token) if fits is None else fits):
                            continue
                    last.append(token)
                    counts.append(counts[start] + 1)
                    break
            else:
                raise ValueError(f"no token ends at byte {end} of {pretoken!r}")
        self._row = (shown, last, counts)
        return self._by_character(pretoken, data, counts)

    @staticmethod
    def _by_character(pretoken: str, data: bytes, counts: list[int]) -> bytes | tuple[int, ...]:
        if len(data) == len(pretoken):
            found = counts[1:]
        else:
            found = [counts[e] for e in accumulate(len(c.encode("utf-8", "surrogatepass")) for c in pretoken)]
        return bytes(found) if max(found) < 256 else tuple(found)

    def learn(self, pretokens: Iterable[str]) -> None:
        """Work out many pre-tokens in sorted order, so that those alike share their beginnings' tables."""
        for p in sorted({p for p in pretokens if p not in self.new}):
            if len(p) <= CACHED_LENGTH and p not in self.vocabulary.specials:
                self.counts(p)

    def counts(self, pretoken: str) -> bytes | tuple[int, ...]:
        """Tokens of the first 1, 2, ... characters of a pre-token."""
        found = self.new.get(pretoken)
        if found is None:
            if len(pretoken) > CACHED_LENGTH:
                if self._long[0] != pretoken:
                    self._long = (pretoken, self._counts(pretoken))
                return self._long[1]
            found = self.old.get(pretoken) or self._counts(pretoken)
            if len(self.new) >= self.kept:
                self.old, self.new = self.new, {}
            self.new[pretoken] = found
        return found

    def _split(self, text: str) -> list[str]:
        if bpe.is_settled(text):
            return self.pattern.findall(text)
        shown = [piece for piece, _ in self.vocabulary.library.pre_tokenizer.pre_tokenize_str(text)]
        return [bytes(map(self.byte_of.__getitem__, piece)).decode("utf-8") for piece in shown]

    def pretokens(self, text: str) -> list[str]:
        """Pre-tokens and special strings in order; together they are the text."""
        found, at = [], 0
        for m in self.special.finditer(text):
            found += self._split(text[at:m.start()])
            found.append(m.group())
            at = m.end()
        return found + self._split(text[at:] if at else text)

    def total(self, pretoken: str) -> int:
        return 1 if pretoken in self.vocabulary.specials else self.counts(pretoken)[-1]

    def count(self, text: str | None) -> int:
        """Tokens of the whole text."""
        return self.count_and_cut(text or "", None)[0]

    def count_and_cut(self, text: str, budget: int | None, pretokens: list[str] | None = None) -> tuple[int, int]:
        """Tokens of the whole text, and characters of its longest prefix of at most ``budget`` tokens."""
        pretokens = self.pretokens(text) if pretokens is None else pretokens
        kept, n, over = self.new, 0, None
        limit = float("inf") if budget is None else budget
        for k, p in enumerate(pretokens):
            found = kept.get(p)
            if found is not None:
                n += found[-1]
            else:
                n += self.total(p)
                kept = self.new
            if n > limit:
                over, limit = k, float("inf")
        if over is None:
            return n, len(text)
        end = over + 1
        while end < len(pretokens) and pretokens[end].isspace():
            end += 1
        head = pretokens[:end]
        if end < len(pretokens) and pretokens[end][0] in WHITE:
            head.append(pretokens[end][0])  # a run's last blank stands with the word after it
        return n, PrefixTable(self, text[:sum(map(len, head))], head).characters_within(budget)


class PrefixTable:
    """Token counts of the prefixes of one text. ``head``: the first pre-tokens of a longer text whose start ``text`` is."""

    def __init__(self, counter: PrefixCounter, text: str, head: list[str] | None = None):
        self.counter, self.text, self.whole = counter, text, head is None
        self.pretokens = counter.pretokens(text) if head is None else head
        self.starts = [0, *accumulate(map(len, self.pretokens))]
        self.before = [0, *accumulate(map(counter.total, self.pretokens))]
        self._run: tuple[int, int, int, bytes | tuple[int, ...]] = (0, 0, 0, b"")  # the last white-space run looked at
        self._own: tuple[int, bytes | tuple[int, ...]] = (-1, b"")  # the last pre-token looked at

    @property
    def n_tokens(self) -> int:
        return self.before[-1]

    def _safe(self, i: int) -> int:
        """Index of a pre-token at or before character ``i - 1`` at which the first ``i`` characters surely have a boundary.

        A prefix may end inside white space, a contraction or a special string, which then splits in another way than in
        the whole text; white space before it may be drawn in as well.
        """
        k = bisect_right(self.starts, i - 1) - 1
        if self.pretokens[k] in self.counter.vocabulary.specials and i < self.starts[k + 1] and k:
            k -= 1
        while k and (self.pretokens[k].isspace() or self.pretokens[k - 1].isspace()
                     or self.pretokens[k - 1] in self.counter.vocabulary.specials and i < self.starts[k + 1]):
            if self.pretokens[k - 1] in self.counter.vocabulary.specials:
                break
            k -= 1
        return k

    def _within_run(self, i: int) -> int | None:
        """Tokens of the first ``i`` characters, the last of which is white space: its run up to there is a pre-token of its own."""
        start, end, before, counts = self._run
        if not start < i <= end:
            text, start, end = self.text, i - 1, i
            while start and text[start - 1] in WHITE:
                start -= 1
            while end < len(text) and text[end] in WHITE:
                end += 1
            k = bisect_left(self.starts, start)
            if self.starts[k] != start:
                return None
            before, counts = self.before[k], self.counter.counts(text[start:end])
            self._run = (start, end, before, counts)
        return before + counts[i - start - 1]

    def count(self, i: int) -> int:
        """Tokens of the first ``i`` characters."""
        if i <= 0:
            return 0
        if i >= len(self.text) and self.whole:
            return self.n_tokens
        k = bisect_right(self.starts, i - 1) - 1
        pretoken, tail = self.pretokens[k], i - self.starts[k]
        if pretoken not in self.counter.vocabulary.specials:
            if self.text[i - 1] in WHITE:
                if (found := self._within_run(i)) is not None:
                    return found
            elif pretoken not in CONTRACTIONS and not (tail == 1 and pretoken[0].isspace()):
                if self._own[0] != k:
                    self._own = (k, self.counter.counts(pretoken))
                return self.before[k] + self._own[1][tail - 1]
        k = self._safe(i)
        return self.before[k] + sum(map(self.counter.total, self.counter.pretokens(self.text[self.starts[k]:i])))

    def characters_within(self, budget: int) -> int:
        """Length of the longest prefix of at most ``budget`` tokens."""
        if self.whole and self.n_tokens <= budget:
            return len(self.text)
        k = bisect_right(self.before, max(budget, 0)) - 1
        # A prefix that ends in the pre-token that goes over, or in white space after it, can still fit.
        end = k + 1
        while end < len(self.pretokens) and self.pretokens[end].isspace():
            end += 1
        last = self.starts[min(end, len(self.pretokens))]
        if end < len(self.pretokens) and self.pretokens[end][0] in WHITE:
            last += 1
        for i in range(last, self.starts[k], -1):
            if self.count(i) <= budget:
                return i
        return self.starts[k]

    def fits(self, budget: int) -> bool:
        return self.n_tokens <= budget


_counters: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    """The worker's counter of one vocabulary file, kept between tasks."""
    if path not in _counters:
        _counters[path] = PrefixCounter(bpe.load(path))
    return _counters[path]


def count_tokens(documents: DataFrame, path: str, budget: int = 512, id_column: str = "doc_id",
                 text_column: str = "text") -> DataFrame:
    """One row per document: id, n_bytes, n_tokens, over_limit, and budget_chars, the longest prefix within the budget."""
    read = documents.select(documents[id_column].alias("doc_id"), documents[text_column].cast("string").alias("text"))
    id_type = read.schema["doc_id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counter(path)
        for batch in batches:
            texts = byte_texts(column(batch, "text"))
            out: list[tuple[int, int, bool, int]] = []
            for first in range(0, len(texts), LEARNED_TOGETHER):
                some = [(data or b"").decode("utf-8", "replace") for data in texts[first:first + LEARNED_TOGETHER]]
                split = [counts.pretokens(text) for text in some]
                counts.learn(chain.from_iterable(split))
                for text, pretokens, data in zip(some, split, texts[first:], strict=False):
                    n, fits = counts.count_and_cut(text, budget, pretokens)
                    out.append((len(data or b""), n, n > budget, fits))
            cells = list(zip(*out, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), pa.array(cells[0], pa.int64()), pa.array(cells[1], pa.int64()),
                 pa.array(cells[2], pa.bool_()), pa.array(cells[3], pa.int64())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit", "budget_chars"])

    return read.mapInArrow(
        count, f"doc_id {id_type}, n_bytes bigint, n_tokens bigint, over_limit boolean, budget_chars bigint")
