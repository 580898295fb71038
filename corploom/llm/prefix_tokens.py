"""Token counts at every prefix, by dynamic programming over BPE words.

A word-level BPE tokenizer never merges across words, so the count of a text is
the sum of its words' counts, and the count of a prefix is that of the whole
words before it plus that of the begun word. The table holds, for each text,
the exact count after each of its code points. Truncation to a budget, window
boundaries and counts of any prefix are then lookups in the table.

Within a long word the counts are a dynamic program: a row of BPE tokens is the
encoding of its text if each two neighbours are the encoding of theirs. So the
encoding of a prefix is that of a shorter prefix and one more token, which must
fit the last token before it, and there is one such token. Short words are
encoded prefix by prefix, each distinct prefix once for all words that begin
alike.

Texts in which the fast word split is not known to equal the library's (code
points beyond Latin, special strings, texts that Unicode normalisation changes)
go through the library's own normaliser and splitter, run of black by run.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corploom.llm.common import arrow_rows, documents, numbered, text_or_empty, texts_of

MODEL = "word_bpe_49k.json"
LIMIT = 2048
#: Words, or prefixes, whose counts a task remembers; then it starts afresh.
REMEMBERED = 600_000
#: Code points of a word whose prefixes are encoded one by one; longer ones go by the dynamic program, to the same counts.
SHORT = 100
#: Stands for the table of a longer word.
WIDE = b""
#: Bytes of a long word that are counted, and remembered, together; such pieces that are remembered.
PIECE, PIECES = 64, 20_000
#: Bytes of texts that a task holds at once; their tables take four to eight times as much.
SLICE = 4 << 20
#: Latin text without combining marks, special strings or unusual white space: split here, as the library does.
_LATIN_LETTER = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_DIGIT = "0-9²³¹¼-¾"
_UNUSUAL = re.compile("[^\t-\r -~¡-įı-ȳ]|<\\|")
_WORD = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LATIN_LETTER}]+|[{_DIGIT}]|[^\\s{_LATIN_LETTER}{_DIGIT}]+")
#: White space as the tokenizer's pattern has it.
_BLACK = re.compile("[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def _byte_signs() -> dict[int, int]:
    """The sign of each byte in byte-level vocabularies: itself if it prints, else the next code point from 256."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in prints]
    return {b: b for b in prints} | {b: 256 + i for i, b in enumerate(others)}


_BYTE_SIGNS = _byte_signs()


def _signs(text: str) -> str:
    return text if text.isascii() and text.isprintable() else text.encode("utf-8", "surrogatepass").decode("latin-1").translate(_BYTE_SIGNS)


#: Signs of the bytes that continue a code point.
_CONTINUES = frozenset(chr(_BYTE_SIGNS[b]) for b in range(0x80, 0xC0))


@lru_cache(maxsize=1)
def _joining() -> frozenset[str]:
    """Code points that normalising may join to the one before, besides those with a combining class."""
    parts = (unicodedata.decomposition(chr(c)).split() for c in range(0x30000))
    second = {chr(int(p[1], 16)) for p in parts if len(p) == 2 and p[0][0] != "<"}
    return frozenset(second | set(map(chr, range(0x1161, 0x1176))) | set(map(chr, range(0x11A8, 0x11C3))))


class _Word:
    """A word into which signs are put; its tokens are found anew from there until they are the old ones again."""

    def __init__(self, counter: Counter, text: str):
        self.counter, self.text = counter, ""
        self.size, self.count = bytearray(1), np.zeros(1024, np.int64)
        self.insert(0, text)

    def insert(self, at: int, signs: str) -> None:
        counter, width, new, n = self.counter, self.counter.longest, len(signs), len(self.text)
        text = self.text = self.text[:at] + signs + self.text[at:] if at < n else self.text + signs
        size, behind = self.size, at + new
        size[at + 1 : at + 1] = bytes(new)
        if n + new >= len(self.count):
            self.count = np.concatenate([self.count, np.zeros(n + new, np.int64)])
        count = self.count
        count[behind + 1 : n + new + 1] = count[at + 1 : n + 1].copy()
        same = 0
        for j in range(at + 1, n + new + 1):
            last = counter._last(text, size, j, False)
            tokens = count[j - last] + 1
            same = same + 1 if j > behind and size[j] == last else 0
            more = tokens - count[j]
            size[j], count[j] = last, tokens
            # The next sizes follow from these and from signs that are the old ones.
            if same >= width and all(i - size[i] >= behind for i in range(j - width + 1, j + 1)):
                count[j + 1 : n + new + 1] += more
                return

    def total(self) -> int:
        """Tokens of the whole word."""
        n = len(self.text)
        return int(self.count[n - self.counter._last(self.text, self.size, n, True)]) + 1 if n else 0


class Counter:
    """Counts of texts and of all their prefixes, for one tokenizer file of the ``tokenizers`` library."""

    def __init__(self, file: str):
        from tokenizers import Tokenizer, models

        self.library = Tokenizer.from_file(file)
        self.library.no_padding()
        self.library.no_truncation()
        self.special = sorted((t.content for t in self.library.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.split_special = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        self.merge = self.library.model.tokenize
        model = json.loads(self.library.to_str())["model"]
        #: What the last token of a word has at its end.
        self.suffix = model["end_of_word_suffix"] or ""
        self.inner = models.BPE(vocab=model["vocab"], merges=[tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]).tokenize
        #: Tokens inside a word, and at its end without the suffix.
        self.inside = {t for t in model["vocab"] if not self.suffix or not t.endswith(self.suffix)}
        self.at_end = {t.removesuffix(self.suffix) for t in model["vocab"] if t.endswith(self.suffix)}
        self.inner_lengths, self.last_lengths = _lengths(self.inside), _lengths(self.at_end)
        self.longest = max(map(len, model["vocab"]))
        self.counts: dict[str, int] = {}
        self.tables: dict[str, bytes] = {}
        self.others: dict[str, list[int]] = {}
        self.runs: dict[str, np.ndarray] = {}
        self.normal: dict[str, str] = {}
        self.fits: dict[tuple[str, str, bool], bool] = {}
        self.pieces: dict[tuple, tuple] = {}

    # -- words ------------------------------------------------------------------

    def _merged(self, word: str) -> int:
        """Tokens of a word, or of its beginning, in text that the fast split cuts."""
        if word.isalpha() or _WORD.fullmatch(word):
            return len(self.merge(_signs(word)))
        return sum(self._merged(x) for x in _WORD.findall(word))

    def prefixes(self, word: str) -> bytes:
        """Tokens of word[:1], word[:2], ... each as a text of its own, a byte each; of a long word, WIDE."""
        if len(self.counts) > REMEMBERED:
            self.counts.clear()
        if len(self.tables) > REMEMBERED // 2:
            self.tables.clear()
        if len(word) > SHORT:  # of 2 bytes a letter at most, so that counts fit a byte
            return WIDE
        counts, known = self.counts, self.counts.get
        found = []
        for i in range(1, len(word) + 1):
            begun = word[:i]
            n = known(begun)
            if n is None:
                n = counts[begun] = self._merged(begun)
            found.append(n)
        table = self.tables[word] = bytes(found)
        return table

    def _fit(self, before: str, token: str, last: bool) -> bool:
        """Whether two tokens, or a first one, are the encoding of their text."""
        key = (before, token, last)
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) > REMEMBERED:
                self.fits.clear()
            got = [t.value for t in (self.merge if last else self.inner)(before + token)]
            known = self.fits[key] = got == [*([before] if before else ()), token + (self.suffix if last else "")]
        return known

    def _last(self, text: str, size: bytearray, j: int, end: bool) -> int:
        """Size of the last token of text[:j], of whose shorter beginnings ``size`` has the last tokens' sizes; ``end``: as a word's end."""
        lengths, among = (self.last_lengths, self.at_end) if end else (self.inner_lengths, self.inside)
        tail, single = text[max(0, j - 2) : j], text[j - 1 : j]
        for n in (*lengths.get(tail, ()), *lengths.get(single, ())) if j > 1 else lengths.get(single, ()):
            i = j - n
            if i >= 0 and text[i:j] in among and self._fit(text[i - size[i] : i] if i else "", text[i:j], end):
                return n
        raise ValueError("the vocabulary has no token for a byte")

    def _piece(self, text: str, at: int, sizes: bytes, counts: tuple[int, ...]) -> tuple[bytes, list[int], list[int | None]]:
        """For the places of ``text`` after ``at``, all but the last: size of the last token, tokens inside a word, tokens of a word that ends there.

        ``sizes`` and ``counts`` are those of the places up to ``at``, counts less that at ``at``.
        Places within a code point get no count of a word.
        """
        key = (text, at, sizes, counts)
        known = self.pieces.get(key)
        if known is not None:
            return known
        fit, inner, last, inside, at_end = self._fit, self.inner_lengths.get, self.last_lengths.get, self.inside, self.at_end
        shift = at + 1 - len(sizes)
        size, count, ends = [*sizes], [*counts], []
        for j in range(at + 1, len(text)):
            tail, single = text[max(0, j - 2) : j], text[j - 1 : j]
            for n in (*inner(tail, ()), *inner(single, ())) if j > 1 else inner(single, ()):
                i = j - n
                if i >= 0 and text[i:j] in inside and fit(text[i - size[i - shift] : i] if i else "", text[i:j], False):
                    size.append(n)
                    count.append(count[i - shift] + 1)
                    break
            else:
                raise ValueError("the vocabulary has no token for a byte")
            if text[j] in _CONTINUES:
                ends.append(None)
                continue
            for n in (*last(tail, ()), *last(single, ())) if j > 1 else last(single, ()):
                i = j - n
                if i >= 0 and text[i:j] in at_end and fit(text[i - size[i - shift] : i] if i else "", text[i:j], True):
                    ends.append(count[i - shift] + 1)
                    break
        done = len(sizes)
        if len(self.pieces) > PIECES:
            self.pieces.clear()
        found = self.pieces[key] = bytes(size[done:]), count[done:], ends
        return found

    def _walk(self, signs: str) -> tuple[bytearray, list[int], list[int | None]]:
        """_piece() for all places of a word, from place 0."""
        width = self.longest
        size, count, ends = bytearray(1), [0], [0]
        text = signs + " "  # no byte has this sign
        for at in range(0, len(signs), PIECE):
            start, held = max(0, at - 2 * width), max(0, at - width)
            base = count[at]
            got = self._piece(text[start : at + PIECE + 1], at - start, bytes(size[held:]), tuple(x - base for x in count[held:]))
            size += got[0]
            count += [x + base for x in got[1]]
            ends += [None if x is None else x + base for x in got[2]]
        return size, count, ends

    def long_prefixes(self, word: str) -> list[int]:
        """prefixes() of a normalised word that isn't a contraction, in time linear in its length."""
        ends = self._walk(_signs(word))[2]
        return [n for n in ends[1:] if n is not None]

    # -- texts beyond the fast split ----------------------------------------------

    def _normal(self, text: str) -> str:
        found = self.normal.get(text)
        if found is None:
            if len(self.normal) > REMEMBERED // 8:
                self.normal.clear()
            found = self.normal[text] = self.library.normalizer.normalize_str(text)
        return found

    def _cuts(self, plain: str) -> list[tuple[int, int]]:
        return [span for _, span in self.library.pre_tokenizer.pre_tokenize_str(plain)]

    def _word_counts(self, word: str) -> list[int] | bytes:
        """prefixes() of any normalised word."""
        if len(word) > SHORT:
            return self.long_prefixes(word)
        if word.isascii() and word.isprintable():
            return self.tables.get(word) or self.prefixes(word)
        found = self.others.get(word)
        if found is None:
            if len(self.others) > REMEMBERED // 4:
                self.others.clear()
            found = self.others[word] = [len(self.merge(_signs(word[:i]))) for i in range(1, len(word) + 1)]
        return found

    def _run(self, run: str) -> np.ndarray:
        """Tokens of run[:1], run[:2], ... of a text without white space, each as a text of its own."""
        found = self.runs.get(run)
        if found is not None:
            return found
        joins = [bool(unicodedata.combining(c)) or c in _joining() for c in run]
        joins[0] = False
        starts = [i for i, j in enumerate(joins) if not j]
        parts = [self._normal(run[a:b]) for a, b in zip(starts, [*starts[1:], len(run)], strict=True)]
        plain, ends = "".join(parts), list(accumulate(map(len, parts)))
        counts, cuts, before, total = [0] * (len(plain) + 1), self._cuts(plain), [], 0
        for a, b in cuts:
            before.append(total)
            counts[a + 1 : b + 1] = [total + n for n in self._word_counts(plain[a:b])]
            total = counts[b]
        out = np.zeros(len(run), np.int32)
        out[[b - 1 for b in (*starts[1:], len(run))]] = [counts[e] for e in ends]
        # Places at which the next code point would join the one before.
        word, walks = 0, {}
        for part, (start, end) in enumerate(zip(starts, [*starts[1:], len(run)], strict=True)):
            if end - start < 2:
                continue
            m = ends[part] - len(parts[part])
            while word < len(cuts) and cuts[word][1] < m:
                word += 1
            held = word < len(cuts) and cuts[word][0] < m
            a, n = (cuts[word][0], before[word]) if held else (m, counts[m])
            if held and m - a < 3 and word and cuts[word - 1] == (a - 1, a) and plain[a - 1] == "'":  # may begin a contraction
                a, n = a - 1, before[word - 1]
            if end - start > 2 * SHORT:
                out[start + SHORT : end - 1] = self._grown(run[start:end], plain[a:m], n)
            for k in range(start + 1, end if end - start <= 2 * SHORT else start + SHORT + 1):
                begun = self._normal(run[start:k])
                if m - a <= SHORT:
                    tail = plain[a:m] + begun
                    out[k - 1] = n + sum(len(self.merge(_signs(tail[x:y]))) for x, y in self._cuts(tail))
                else:
                    if a not in walks:
                        held_word = plain[a : cuts[word][1]]
                        walks = {a: (signs := _signs(held_word), *self._walk(signs))}
                        offsets = [0, *accumulate(len(c.encode()) for c in held_word)]
                    out[k - 1] = n + self._longer(walks[a], offsets[m - a], plain[m - 1], begun)
        if len(run) <= SHORT:
            if len(self.runs) > REMEMBERED // 8:
                self.runs.clear()
            self.runs[run] = out
        return out

    def _grown(self, part: str, before: str, n: int) -> list[int]:
        """Tokens of ``before`` with part[:k] behind it, for k from SHORT + 1 to all but the last code point, and ``n`` more.

        Marks are put in order of their combining class as they come, so the
        text grows in its middle; only the tokens near that place are found anew.
        """
        out, word = [], None
        for k in range(SHORT + 1, len(part)):
            for c in unicodedata.normalize("NFD", part[k - 1]):
                kind = unicodedata.combining(c)
                # A first mark of its class may join the letter, one without a class whatever is before it.
                if word is None or not kind or kind not in behind:
                    word = None
                    break
                at = begin + sum(size for x, size in behind.items() if x <= kind)
                signs = _signs(c)
                word.insert(at, signs)
                behind[kind] += len(signs)
            if word is None:
                begun = self._normal(part[:k])
                tail = before + begun
                cuts = self._cuts(tail)
                x, y = cuts[-1]
                word, told = _Word(self, _signs(tail[x:y])), n + sum(len(self.merge(_signs(tail[i:j]))) for i, j in cuts[:-1])
                marks = len(begun)
                while marks and unicodedata.combining(begun[marks - 1]):
                    marks -= 1
                behind = dict.fromkeys(sorted({unicodedata.combining(c) for c in begun[marks:]}), 0)
                for c in begun[marks:]:
                    behind[unicodedata.combining(c)] += len(_signs(c))
                begin = len(word.text) - sum(behind.values())
            out.append(told + word.total())
        return out

    def _longer(self, walk: tuple[str, bytearray, list[int], list[int]], at: int, before: str, begun: str) -> int:
        """Tokens of a long word's first ``at`` bytes, which end in ``before``, with ``begun`` behind them."""
        signs, size, count, ends = walk
        cuts = self._cuts(("(" if before == "'" else before) + begun)
        more = cuts[0][1] - 1 if cuts and not cuts[0][0] else 0
        rest = sum(len(self.merge(_signs(begun[x - 1 : y - 1]))) for x, y in cuts if x)
        if not more:
            return ends[at] + rest
        start, held = max(0, at - 2 * self.longest), max(0, at - self.longest)
        text = signs[start:at] + _signs(begun[:more]) + " "
        got = self._piece(text, at - start, bytes(size[held : at + 1]), tuple(x - count[at] for x in count[held : at + 1]))
        return count[at] + got[2][-1] + rest

    def _black(self, text: str) -> np.ndarray:
        """table() of a text whose special strings count as any others."""
        out = np.zeros(len(text) + 1, np.int32)
        total, done = 0, 0
        for m in _BLACK.finditer(text):
            a, b = m.span()
            out[done + 1 : a + 1] = total
            out[a + 1 : b + 1] = self._run(m.group()) + total
            total, done = int(out[b]), b
        out[done + 1 :] = total
        return out

    def table(self, text: str) -> np.ndarray:
        """Tokens of text[:0], text[:1], ... up to the whole text, each as a text of its own."""
        if not _UNUSUAL.search(text):
            return self._latin(text)
        out = np.zeros(len(text) + 1, np.int32)
        at, total = 0, 0
        for m in [*(self.split_special.finditer(text) if self.split_special else ()), None]:
            end = m.start() if m else len(text)
            # Before its end a special string is a text like any other.
            own = self._black(text[at : m.end() - 1 if m else end])
            out[at : at + len(own)] = own + total
            if m:
                total, at = total + int(own[end - at]) + 1, m.end()
                out[at] = total
        return out

    def _latin(self, text: str) -> np.ndarray:
        plain = text.lower()
        words = _WORD.findall(plain)
        if not words:
            return np.zeros(len(plain) + 1, np.int32)
        tables = list(map(self.tables.get, words))
        if None in tables:
            tables = [self.prefixes(w) if t is None else t for w, t in zip(words, tables, strict=True)]
        if WIDE in tables:
            return self._by_place(plain, words)
        inside = np.frombuffer(b"".join(tables), np.uint8)
        lengths = np.fromiter(map(len, tables), np.int64, len(words))
        ends = np.cumsum(lengths)
        total = np.zeros(len(words) + 1, np.int32)
        np.cumsum(inside[ends - 1], out=total[1:])
        # Words hold every code point that is not white space, in order; after a
        # word, white space keeps its count.
        code = np.frombuffer(plain.encode(), np.uint8) if plain.isascii() else np.frombuffer(plain.encode("utf-32-le"), np.uint32)
        black = (code > 32) | (code < 9)
        at = np.flatnonzero(black)
        gaps = np.diff(at[ends - 1], append=len(plain)) - np.append(lengths[1:], 1)
        out = np.zeros(len(plain) + 1, np.int32)
        rest = out[1:]
        rest[at] = inside + np.repeat(total[:-1], lengths)
        rest[np.flatnonzero(~black)[at[0] :]] = np.repeat(total[1:], gaps)
        return out

    def _by_place(self, plain: str, words: list[str]) -> np.ndarray:
        out = np.zeros(len(plain) + 1, np.int32)
        at, total = 0, 0
        for word in words:
            start = plain.index(word, at)
            out[at + 1 : start + 1] = total
            at = start + len(word)
            own = self.long_prefixes(word) if len(word) > SHORT else list(self.tables.get(word) or self.prefixes(word))
            out[start + 1 : at + 1] = np.array(own) + total
            total = int(out[at])
        out[at + 1 :] = total
        return out


def _lengths(tokens: Iterable[str]) -> dict[str, tuple[int, ...]]:
    """By their last two signs, or their one, the lengths of tokens, the longest first."""
    found: dict[str, set[int]] = {}
    for t in tokens:
        if t:
            found.setdefault(t[-2:], set()).add(len(t))
    return {tail: tuple(sorted(n, reverse=True)) for tail, n in found.items()}


@lru_cache(maxsize=2)
def _counter(file: str) -> Counter:
    """One counter for all tasks of a Python worker, so that they share what it remembers."""
    return Counter(file)


def prefix_tokens(docs: DataFrame, file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: _row, doc_id, n_bytes, prefix_tokens.

    prefix_tokens holds, at place k (from 0), the exact number of tokens of the
    text's first k code points; its last entry is the whole text's. ``file`` is
    a tokenizer of the ``tokenizers`` library that splits text in words before
    it merges, on a path that every executor has. No begin, end or added special
    tokens; special strings inside texts are single tokens, as is the library's
    default. Null and empty texts have the table [0]; repeated rows each give a
    row; no rows give none. Other columns are not read.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(file)
        for part, texts in texts_of(batches, 2, SLICE):
            tables = [counter.table(t) for t in texts]
            ends = np.concatenate([[0], np.cumsum([len(t) for t in tables])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(tables) if tables else np.zeros(0, np.int32)))
            n_bytes = pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64())
            yield arrow_rows(part, (0, 1), ["_row", "doc_id", "n_bytes", "prefix_tokens"], [n_bytes, lists])

    rows = numbered(docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("_text"))).select("_row", "doc_id", "_text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"_row long, doc_id {kind}, n_bytes long, prefix_tokens array<int>")


def tokens_of_prefix(length: Column, table: str = "prefix_tokens") -> Column:
    """Tokens of the first ``length`` code points; of the whole text beyond its end."""
    return F.element_at(table, F.least(F.greatest(length, F.lit(0)) + 1, F.size(table)))


def longest_prefix(budget: Column, table: str = "prefix_tokens") -> Column:
    """Code points of the longest prefix of at most ``budget`` tokens."""
    fits = F.transform(F.reverse(table), lambda n: n <= budget)
    return F.when(budget >= 0, F.size(table) - F.array_position(fits, True).cast("int"))


def op6_prefix_tokens(spark, sf_dir: str) -> DataFrame:
    """All documents, whole texts."""
    import public_tokenizers

    found = prefix_tokens(documents(spark, sf_dir), public_tokenizers.path(MODEL))
    n = F.element_at("prefix_tokens", -1).cast("long")
    return found.select("doc_id", "n_bytes", n.alias("n_tokens"), (n > LIMIT).alias("over_limit"))
