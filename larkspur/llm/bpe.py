"""BPE encoding and decoding: speculate and verify.

Every distinct word is cut greedily into its longest tokens. Such a cut is the tokenizer's own exactly if
each pair of neighbours is compatible, that is, if merging the two tokens' text alone gives those two
tokens back. Pairs are checked for all words of a batch at once against a table of pairs; words with a
failing pair are merged exactly, by rank.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from larkspur.llm.common import bounded_batches, resident, text_or_empty

#: Words and pairs remembered by a worker; beyond that it starts anew, which changes no result.
CACHE = 100_000
#: Words of at most so many characters are merged by scanning.
SHORT = 40
#: Texts of these characters are normalized and split here, others by the library's own parts.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa0-\u012f\u0131-\u017e]*")
#: The normalizer and pre-tokenizer that the patterns here restate; with others the library's own parts are used for all texts.
_RULES = (["NFC", r"Replace \s+", "Lowercase"], [r"Split 's|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+", "ByteLevel"])
#: The vocabulary's word pattern over lower-case plain texts: letters, one digit, or other signs; white space falls away.
_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ž]+|[0-9²³¹¼-¾]|[^\\sa-zªµºß-öø-ž0-9²³¹¼-¾]+")


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it is visible, else one from U+0100 on."""
    visible = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in visible else chr(next(hidden)) for b in range(256)]


def _rules(whole: dict) -> tuple[list[str], list[str]]:
    """The names and patterns of a file's normalizers and pre-tokenizers."""
    parts = lambda spec, inner: (spec or {}).get(inner) or ([spec] if spec else [])
    named = lambda part: " ".join([part["type"], *(p["Regex"] for p in [part.get("pattern")] if isinstance(p, dict) and "Regex" in p)])
    return list(map(named, parts(whole.get("normalizer"), "normalizers"))), list(map(named, parts(whole.get("pre_tokenizer"), "pretokenizers")))


class WordBpe:
    """A BPE vocabulary with marked word ends, read from a tokenizer's JSON."""

    def __init__(self, spec: bytes):
        whole = json.loads(spec)
        model = whole["model"]
        if model.get("type") != "BPE" or not model.get("end_of_word_suffix") or whole.get("decoder"):
            raise ValueError("this encoder reads BPE vocabularies with a mark at word ends and without a decoder of their own")
        self.end: str = model["end_of_word_suffix"]
        self.plain = _rules(whole) == _RULES
        self.ids: dict[str, int] = model["vocab"]
        pairs = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        self.ranks: dict[tuple[str, str], int] = {p: r for r, p in enumerate(pairs)}
        self.special: dict[str, int] = {t["content"]: t["id"] for t in whole["added_tokens"]}
        self.tokens = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}
        self.splitter = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.longest = max(len(t) - (len(self.end) if t.endswith(self.end) else 0) for t in self.ids)
        # Greedy cuts use only tokens that merging can make of their own text; the others never come out of a merge.
        self.sound = {t for t in self.ids if len(self.merged(self.letters(t))) == 1}
        self.bytes = _byte_letters()
        self.library = Tokenizer.from_str(spec.decode())
        self.known: dict[str, list[int]] = {}
        self.fits: dict[int, bool] = {}

    def letters(self, token: str) -> list[str]:
        """The symbols merging begins with: characters, the last one with the mark if the token ends a word."""
        if token.endswith(self.end) and len(token) > len(self.end):
            body = token[: -len(self.end)]
            return [*body[:-1], body[-1] + self.end]
        return list(token)

    def merged(self, symbols: list[str]) -> list[str]:
        """Exact merging: the lowest rank first, the leftmost of equals. Long words use a heap over linked symbols, which stays cheap."""
        n = len(symbols)
        if n <= SHORT:
            return self.merged_short(list(symbols))
        after, before, text = [*range(1, n), -1], [-1, *range(n - 1)], list(symbols)
        heap = [(r, i, text[i], text[i + 1]) for i in range(n - 1) if (r := self.ranks.get((text[i], text[i + 1]))) is not None]
        heapify(heap)
        while heap:
            _, i, a, b = heappop(heap)
            j = after[i] if text[i] else -1
            if j < 0 or text[i] != a or text[j] != b:
                continue
            text[i], text[j] = a + b, ""
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for left in (before[i], i):
                right = after[left] if left >= 0 else -1
                if right >= 0 and (r := self.ranks.get((text[left], text[right]))) is not None:
                    heappush(heap, (r, left, text[left], text[right]))
        return [t for t in text if t]

    def merged_short(self, text: list[str]) -> list[str]:
        rank, none = self.ranks.get, len(self.ranks)
        ranks = [rank(p, none) for p in zip(text, text[1:])]
        while ranks and (least := min(ranks)) < none:
            i = ranks.index(least)
            text[i : i + 2] = [text[i] + text[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank((text[i - 1], text[i]), none)
            if i < len(ranks):
                ranks[i] = rank((text[i], text[i + 1]), none)
        return text

    def speculate(self, word: str) -> list[int] | None:
        """The word's greedy cut into longest sound tokens, or None if there is none."""
        out, at, n = [], 0, len(word)
        while at < n:
            for to in range(min(n, at + self.longest), at, -1):
                token = word[at:to] + self.end if to == n else word[at:to]
                if token in self.sound:
                    out.append(self.ids[token])
                    break
            else:
                return None
            at = to
        return out

    def compatible(self, left: int, right: int) -> bool:
        a, b = self.tokens[left], self.tokens[right]
        return self.merged([*self.letters(a), *self.letters(b)]) == [a, b]

    def learn(self, words: list[str]) -> None:
        """Encode new words: speculate, check all adjacent pairs at once, merge exactly those that fail."""
        cuts = [self.speculate(w) for w in words]
        sizes = np.array([len(c) if c else 0 for c in cuts])
        flat = np.fromiter((i for c in cuts if c for i in c), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(words)), sizes)
        inside = owner[1:] == owner[:-1]
        pairs = (flat[:-1] * (1 << 20) + flat[1:])[inside]
        distinct, where = np.unique(pairs, return_inverse=True)
        if len(self.fits) > CACHE:
            self.fits.clear()
        for p in distinct.tolist():
            if p not in self.fits:
                self.fits[p] = self.compatible(p >> 20, p & ((1 << 20) - 1))
        ok = np.array([self.fits[p] for p in distinct.tolist()], bool)
        failing = set(owner[1:][inside][~ok[where]].tolist()) if len(distinct) else set()
        for k, (word, cut) in enumerate(zip(words, cuts, strict=True)):
            if cut is None or k in failing:
                # Symbols that the vocabulary lacks are left out, as a tokenizer without an unknown token does.
                cut = [self.ids[t] for t in self.merged([*word[:-1], word[-1] + self.end]) if t in self.ids]
            self.known[word] = cut

    def words(self, text: str) -> list[str]:
        """The text's words as byte letters, and the special tokens in it as they stand, after a blank."""
        out: list[str] = []
        parts = self.splitter.split(text) if self.splitter else [text]
        for k, part in enumerate(parts):
            if k % 2:
                out.append(" " + part)
            elif self.plain and _PLAIN.fullmatch(part):
                found = _WORDS.findall(unicodedata.normalize("NFC", part).lower())
                out += found if part.isascii() else [w if w.isascii() else "".join(map(self.bytes.__getitem__, w.encode())) for w in found]
            else:
                out += [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part))]
        return out

    def encode(self, texts: list[str]) -> list[list[int]]:
        split = [self.words(t) for t in texts]
        if len(self.known) > CACHE:
            self.known = {}
        self.known |= {" " + t: [i] for t, i in self.special.items()}
        if new := {w for ws in split for w in ws} - self.known.keys():
            self.learn(sorted(new))
        return [list(chain.from_iterable(map(self.known.__getitem__, ws))) for ws in split]

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by single spaces: the vocabulary's file names no decoder."""
        return " ".join([self.tokens[i] for i in ids])


def _tokenizer(spec: bytes) -> WordBpe:
    return resident(hashlib.sha256(spec).hexdigest(), lambda: WordBpe(spec))


def read_vocabulary(path: str) -> bytes:
    """A tokenizer's file; it has a fixed size of a few MB and goes to the workers as a broadcast."""
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, path: str, text: str = "text", out: str = "bpe") -> DataFrame:
    """Add `out`: struct<ids array<int>, decoded string> of each whole text; null counts as empty.

    Rows are independent: nothing is shuffled, repeated rows get equal results, other columns pass through.
    """
    spec = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    @F.pandas_udf("ids array<int>, decoded string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tokenizer = _tokenizer(spec.value)
        for texts in batches:
            ids = tokenizer.encode(texts.tolist())
            yield pd.DataFrame({"ids": ids, "decoded": [tokenizer.decode(x) for x in ids]})

    bounded_batches(docs.sparkSession)
    return docs.withColumn(out, run(text_or_empty(text)))


def encode_digest(docs: DataFrame, path: str) -> DataFrame:
    """One row per document: n_tokens, and digests of the ids (decimal, joined by spaces) and of the decoded text."""
    coded = encode(docs.select("doc_id", "text"), path)
    return coded.select(
        "doc_id", F.size("bpe.ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("bpe.ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2("bpe.decoded", 256).alias("decoded_sha256"),
    )
