"""Problem 1: text of scanned pages made continuous by an averaged-perceptron character editor."""

from __future__ import annotations

import difflib
import gc
import random
import re
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache, lru_cache
from itertools import accumulate, count, repeat
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from scrinium.durable import durable
from scrinium.functions.text import suffix
from scrinium.sources.readers import IMAGES

#: Clean rows that one editor is trained on; their noise is made here.  More rows train several, side by side, whose weights are averaged.
TRAINING = 1_500
#: Times that these are set on pages, each in its own way, and rounds over the examples; many rows are seen fewer times each, but all are.
PAGINATIONS = ROUNDS = 3
#: Files of training whose lines are compared together.
BATCH = 64
#: Different words that one editor learns characters from.
WORDS = 9_000
#: Pieces of one file that are repaired together; those of the block before are read with them.
BLOCK = 64
#: Words that are aligned on the driver, at most; more are aligned by a join.
ALIGNED = 50_000
#: A confusion is learned if it explains so many unknown words, and so many times as large a share of them as of rare clean words.
LEAST_SUPPORT, LIKELIER = 3, 8.0

# Marks of a split word, and words before page numbers.
MARKS = "-\u2010\u00ac\u00ad"
BEFORE_NUMBER = r"pag\.|pagina|pag|page|p\.|foglio|seite|s\.|blatt|feuille|sheet|f\."
_ROMAN = r"m{0,3}(?:cm|cd|d?c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})"

_NUMBER = re.compile(rf"(?:(?P<word>{BEFORE_NUMBER})\s?(?P<a>\d{{1,7}})(?:\s?(?:di|of|de|von|sur|/)\s?\d{{1,7}})?|(?P<pair>(?P<b>\d{{1,7}})\s?/\s?\d{{1,7}})|(?P<dash>[-–—]\s?(?P<c>\d{{1,7}})\s?[-–—])|(?P<box>[\[(](?P<d>\d{{1,7}})[\])])|(?P<bare>(?P<e>\d{{1,7}}))|(?P<roman>(?P<f>{_ROMAN})))$", re.I)
_TAIL = re.compile(rf"^(.*\S)(?:\s*\|\s*|\s{{2,}}|\s+[-–—·•]\s+|\t)((?:{BEFORE_NUMBER})\s?\d{{1,7}}(?:\s?(?:di|of|de|von|sur|/)\s?\d{{1,7}})?|\d{{1,7}}(?:\s?/\s?\d{{1,7}})?|[-–—]\s?\d{{1,7}}\s?[-–—]|[\[(]\d{{1,7}}[\])]|(?<=[|\s])(?=[ivxlcdm]){_ROMAN})$", re.I)
_ATOM = re.compile(r"[^\s.,;:?\"«»'’)\[\]/+=<>*#€$%&—–\\{}~^°_\-\u2010\u00ac\u00ad]+")
_WORD = re.compile(r"\w+")
#: Signs of a scanned page in a text, for rows whose catalogue entry doesn't say so.
EVIDENCE = rf"(?im)\p{{Ll}}[{MARKS}]\r?\n(?-i:\p{{Ll}})|^(?:[-–—] ?\d{{1,7}} ?[-–—]|\[\d{{1,7}}\]|(?:{BEFORE_NUMBER}) ?\d{{1,7}}(?: di \d{{1,7}})?|\d{{1,3}}|\d{{1,3}}/\d{{1,3}})$"
_FOLD = str.maketrans("01|!i5697@íc(tyr", "ollllsbgzafeefvl")
#: The same for all of Latin-1, where signs become spaces.
_FOLD_BYTES = bytes(ord(c) if re.match(r"\w", c) else 32 for c in map(chr, (_FOLD.get(k, k) for k in range(256))))
# what any line that _TAIL matches has: a last character, and what stands before the number
_LAST, _SEPARATED = "-–—])ivxlcdmIVXLCDM\u0130\u0131", re.compile(r"[|\t]|\s[\s\-–—·•]")
#: No line that _NUMBER matches is longer.
_NUMBER_LENGTH = 32

_SCHEMA = "id long, percorso string, n int, testo string, tipi array<string>, modifiche int"


# ---------------------------------------------------------------- the perceptron
class Perceptron:
    """Averaged perceptron that ranks candidates, each a list of named features."""

    def __init__(self) -> None:
        self.weights: dict[str, float] = {}
        self._total: dict[str, float] = defaultdict(float)
        self._since: dict[str, int] = {}
        self._step = 0
        self.examples = 0

    def score(self, features: list[str]) -> float:
        return sum(map(self.weights.get, features, repeat(0.0)))

    def best(self, candidates: list[list[str]]) -> int:
        scores = [self.score(c) for c in candidates]
        return scores.index(max(scores))

    def learn(self, candidates: list[list[str]], right: set[int]) -> bool:
        """One example; ``right`` are the candidates that are right."""
        self._step += 1
        said = self.best(candidates)
        if said in right:
            return True
        wanted = max(right, key=lambda k: self.score(candidates[k]))
        for f, by in [*((f, 1.0) for f in candidates[wanted]), *((f, -1.0) for f in candidates[said])]:
            w = self.weights.get(f, 0.0)
            self._total[f] += w * (self._step - self._since.get(f, 0))
            self._since[f] = self._step
            self.weights[f] = w + by
        return False

    def learn_all(self, data: list[tuple[list[list[str]], set[int]]], rounds: int, rng: random.Random) -> None:
        """``learn`` of all examples in each of ``rounds``, in random orders, then ``average``, on numbered features."""
        index: dict[str, int] = {}
        held: dict[int, list[list[int]]] = {}
        for candidates, _ in data:
            if id(candidates) not in held:
                held[id(candidates)] = [[index.setdefault(f, len(index)) for f in c] for c in candidates]
        numbered = [(held[id(candidates)], right) for candidates, right in data]
        w, total, since, step = [0.0] * len(index), [0.0] * len(index), [0] * len(index), 0
        weight = w.__getitem__
        for _ in range(rounds):
            rng.shuffle(numbered)
            for candidates, right in numbered:
                step += 1
                scores = [sum(map(weight, c)) for c in candidates]
                said = scores.index(max(scores))
                if said in right:
                    continue
                for c, by in ((candidates[max(right, key=scores.__getitem__)], 1.0), (candidates[said], -1.0)):
                    for f in c:
                        total[f] += w[f] * (step - since[f])
                        since[f] = step
                        w[f] += by
        for f in range(len(w)):
            total[f] += w[f] * (step - since[f])
        self.weights = {f: total[k] / max(1, step) for f, k in index.items() if total[k]}
        self.examples = len(data)

    def average(self) -> None:
        for f, w in self.weights.items():
            self._total[f] += w * (self._step - self._since.get(f, 0))
        self.weights = {f: t / max(1, self._step) for f, t in self._total.items() if t}
        self._total, self._since = defaultdict(float), {}


# ---------------------------------------------------------------- words of the clean corpus
def _signed_hash(word: str) -> int:
    h = _hash(word)
    return h - (1 << 64) if h >> 63 else h


def _hash(word: str) -> int:
    try:
        return xxh3_64_intdigest(word)
    except UnicodeEncodeError:
        return xxh3_64_intdigest(word.encode("utf-8", "replace"))


def word_counts(df: DataFrame, text: str = "testo") -> DataFrame:
    """(h, c, w): how often each word and each trigram of a word occurs in ``text`` of all rows, by its 64-bit hash; w is null for trigrams.

    One pass; tasks count what they see, and the counts are summed by hash.
    """

    def counted(held: Counter, names: dict[int, str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held.keys()), pa.int64()), pa.array(list(held.values()), pa.int64()), pa.array([names.get(h) for h in held], pa.string())], names=["h", "c", "w"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        names: dict[int, str] = {}
        for batch in batches:
            spaced: Counter = Counter()  # no word has a space, so each different stretch is looked at once
            for t in batch.column(0).to_pylist():
                spaced.update(t.lower().split())
            found: Counter = Counter()
            for t, c in spaced.items():
                for w in _WORD.findall(t):
                    found[w] += c
            grams = Counter([x[k : k + 3] for x in map("^{}$".format, found) for k in range(len(x) - 1)])
            for w, c in found.items():
                h = _signed_hash(w)
                held[h] += c
                names[h] = w
            for w, c in grams.items():
                held[_signed_hash("\x00" + w)] += c
            if len(held) > 500_000:
                yield counted(held, names)
                held, names = Counter(), {}
        yield counted(held, names)

    return df.select(text).filter(F.col(text).isNotNull()).mapInArrow(work, "h long, c long, w string").groupBy("h").agg(F.sum("c").alias("c"), F.max("w").alias("w"))


def word_levels(counts: DataFrame) -> Lexicon:
    """A level (steps of a logarithm) of each word and trigram.

    Nine bytes for each distinct one come to the driver.  Whatever the size of the corpus, a word that doesn't occur has
    level 0.
    """
    table = counts.select("h", F.least(F.lit(255), F.floor(8 * F.log2(F.col("c") + 1))).cast("short").alias("level")).toArrow()
    hashes, levels = table.column("h").to_numpy(), table.column("level").to_numpy().astype(np.uint8)
    order = np.argsort(hashes)
    return Lexicon(levels[order], hashes[order])


@dataclass
class Lexicon:
    """Levels of words, by their hashes (sorted); 0 for a word that doesn't occur."""

    counters: np.ndarray
    hashes: np.ndarray
    seen: dict[str, int] = field(default_factory=dict)
    contexts: dict[tuple[str, str, str], frozenset[str]] = field(default_factory=dict)

    @classmethod
    def of(cls, words: dict[str, int]) -> Lexicon:
        """The lexicon of counted words and trigrams."""
        hashes = np.array([_signed_hash(w) for w in words], np.int64)
        order = np.argsort(hashes)
        return cls(np.minimum(255, 8 * np.log2(np.array(list(words.values()), np.float64) + 1)).astype(np.uint8)[order], hashes[order])

    def levels(self, words: list[str]) -> np.ndarray:
        """Levels of many words at once."""
        if not len(self.hashes):
            return np.zeros(len(words), np.uint8)
        try:
            asked = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words)).view(np.int64)
        except UnicodeEncodeError:
            asked = np.fromiter(map(_hash, words), np.uint64, len(words)).view(np.int64)
        k = np.minimum(self.hashes.searchsorted(asked), len(self.hashes) - 1)
        return np.where(self.hashes[k] == asked, self.counters[k], 0)

    def level(self, word: str) -> int:
        if (level := self.seen.get(word)) is None:
            if len(self.seen) > 300_000:
                self.seen.clear()
            level = self.seen[word] = self._level(word)
        return level

    def _level(self, word: str) -> int:
        asked = _signed_hash(word)
        k = self.hashes.searchsorted(asked)
        return int(self.counters[k]) if k < len(self.hashes) and self.hashes[k] == asked else 0

    def fitting(self, before: str, after: str, letters: str) -> frozenset[str]:
        """Those of ``letters`` that make a trigram of a word with what stands before and after them."""
        if (fitting := self.contexts.get((before, after, letters))) is None:
            if len(self.contexts) > 10_000:
                self.contexts.clear()
            level = self.levels([f"\x00{before}{c}{after}" for c in letters])
            fitting = self.contexts[before, after, letters] = frozenset(letters[k] for k in np.flatnonzero(level))
        return fitting

    def known(self, atom: str) -> int:
        """0..4: how well known a word is; signs before and after it don't count, one inside makes it unknown."""
        core = atom.lower().lstrip("(").rstrip("!")
        if not _WORD.fullmatch(core):
            return 0
        least = self.level(core)
        return 0 if least < 8 else 1 if least < 16 else 2 if least < 30 else 3 if least < 56 else 4

    def grams(self, atom: str) -> int:
        """0..3: how usual the rarest trigram is."""
        w = f"^{atom.lower()}$"
        grams = ["\x00" + w[k : k + 3] for k in range(len(w) - 2)]
        levels = list(map(self.seen.get, grams))
        least = min(map(self.level, grams) if None in levels else levels) if grams else 0
        return 0 if least < 8 else 1 if least < 20 else 2 if least < 40 else 3


# ---------------------------------------------------------------- characters
Edit = tuple[int, str, str]


def alignments(words: list[str], known: list[str]) -> Counter:
    """How often each exchange (read, right) of at most two letters makes one of ``words`` a word of ``known``.

    Every word without one, two or no letters at each place is looked up among the known ones without theirs, so exchanges
    of any letters are found; of a word's exchanges the shortest count, in equal parts.
    """
    without: dict[str, set[str]] = defaultdict(set)
    for w in known:
        for k in range(len(w) + 1):
            for size in range(min(3, len(w) - k + 1)):
                without[w[:k] + "\0" + w[k + size :]].add(w[k : k + size])
    out: Counter = Counter()
    for w in words:
        best, found = 9, set()
        for k in range(len(w) + 1):
            for size in range(min(3, len(w) - k + 1)):
                read = w[k : k + size]
                for right in without.get(w[:k] + "\0" + w[k + size :], ()):
                    if read == right or read and right and (read[0] == right[0] or read[-1] == right[-1]):
                        continue
                    if len(read) + len(right) < best:
                        best, found = len(read) + len(right), set()
                    if len(read) + len(right) == best:
                        found.add((read, right))
        for f in found:
            out[f] += 1 / len(found)
    return out


def learned_confusions(unknown: list[str], rare: list[str], known: list[str]) -> dict[str, dict[str, int]]:
    """read -> right -> support: exchanges that unknown words of scanned pages need far more often than rare clean words do."""
    both = [*known, *(w.upper() for w in known if not any(c.isdigit() for c in w))]
    return _likely(alignments(unknown, both), alignments(rare, both), len(unknown), len(rare))


def _likely(noisy: Counter, clean: Counter, unknown: int, rare: int) -> dict[str, dict[str, int]]:
    out: dict[str, dict[str, int]] = {}
    for (read, right), n in sorted(noisy.items()):
        share = (clean[read, right] + 0.5) / (rare + 500)  # one in a thousand where little is known
        if read and n >= LEAST_SUPPORT and n / unknown >= LIKELIER * share:
            out.setdefault(read, {})[right] = int(n)
    return out


def joined_alignments(words: DataFrame, known: DataFrame) -> DataFrame:
    """(read, right, n): ``alignments`` of tables of words (key, w), one row a key, and of known ones (w)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), 2000):
                part = batch.slice(k, 2000).to_pydict()
                rows = [(key, w[:k] + "\0" + w[k + size :], w[k : k + size]) for key, w in zip(part["key"], part["w"], strict=True) for k in range(len(w) + 1) for size in range(min(3, len(w) - k + 1))]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names=["key", "rest", "part"])

    schema = "key string, rest string, part string"
    without = known.select(F.col("w").alias("key"), "w").mapInArrow(cut, schema).select("rest", F.col("part").alias("right")).distinct()
    read, right = F.col("read"), F.col("right")
    same = (read != "") & (right != "") & ((F.substring(read, 1, 1) == F.substring(right, 1, 1)) | (F.substring(read, -1, 1) == F.substring(right, -1, 1)))
    found = words.select("key", "w").mapInArrow(cut, schema).withColumnRenamed("part", "read").join(without, "rest").filter((read != right) & ~same)
    by_size = found.groupBy("key", (F.length(read) + F.length(right)).alias("size")).agg(F.collect_set(F.struct("read", "right")).alias("found"))
    best = by_size.groupBy("key").agg(F.min_by("found", "size").alias("found"))
    return best.select(F.explode("found").alias("f"), (1 / F.size("found")).alias("part")).groupBy("f.read", "f.right").agg(F.round(F.sum("part"), 6).alias("n"))


def joined_confusions(unknown: DataFrame, rare: DataFrame, known: DataFrame) -> dict[str, dict[str, int]]:
    """``learned_confusions`` of tables of any number of words (key, w) and of known ones (w); what comes to the driver has its support."""
    both = durable(known.unionByName(known.filter(~F.col("w").rlike(r"\p{Nd}")).select(F.upper("w").alias("w"))).distinct())
    noisy = durable(joined_alignments(unknown, both).filter(F.col("n") >= LEAST_SUPPORT))
    clean = joined_alignments(rare, both).join(noisy.select("read", "right"), ["read", "right"], "left_semi")
    counts = [Counter({(r.read, r.right): r.n for r in t.collect()}) for t in (noisy, clean)]
    return _likely(*counts, unknown.count(), rare.count())


def edits(atom: str, confusions: dict[str, dict[str, int]]) -> list[Edit]:
    """(place, read, right): every exchange that undoes a learned confusion; more or fewer letters delete or insert."""
    return [(k, read, right) for k in range(len(atom)) for size in (1, 2) for read in (atom[k : k + size],) if len(read) == size for right in confusions.get(read, ())]


def other_edits(atom: str, lexicon: Lexicon, letters: str) -> list[Edit]:
    """Replacements, deletions and insertions of any one letter that make ``atom`` a known word."""
    lower, n = atom.lower(), len(atom)
    if len(lower) != n or "\u03a3" in atom or letters.lower() != letters:  # letters whose small ones hang on others
        plans = [(k, atom[k], c) for k in range(n) for c in letters if c != atom[k]]
        plans += [(k, atom[k], "") for k in range(n)] + [(k, "", c) for k in range(n + 1) for c in letters]
        new = [apply(atom, p).lower() for p in plans]
    else:  # letters whose trigrams occur; others make no word that occurs
        w = f"^{lower}$"

        def able(k: int, after: int) -> list[str]:
            """Letters that can stand between ``w[:k]`` and ``w[after:]``."""
            out = lexicon.fitting(w[k - 1], w[after], letters)
            if out and k > 1:
                out &= lexicon.fitting(w[k - 2 : k], "", letters)
            if out and after + 1 < len(w):
                out &= lexicon.fitting("", w[after : after + 2], letters)
            return sorted(out, key=letters.index) if len(out) > 1 else list(out)

        plans, new = [], []
        for k in range(n):
            own = [c for c in able(k + 1, k + 2) if c != atom[k]]
            plans += [(k, atom[k], c) for c in own]
            new += [f"{lower[:k]}{c}{lower[k + 1 :]}" for c in own]
        plans += [(k, atom[k], "") for k in range(n)]
        new += [lower[:k] + lower[k + 1 :] for k in range(n)]
        for k in range(n + 1):
            own = able(k + 1, k + 1)
            plans += [(k, "", c) for c in own]
            new += [f"{lower[:k]}{c}{lower[k:]}" for c in own]
    return [plans[k] for k in np.flatnonzero(lexicon.levels(new) >= 16)]


def _all(text: str, part: str) -> Iterator[int]:
    k = text.find(part)
    while k >= 0:
        yield k
        k = text.find(part, k + 1)


def apply(atom: str, edit: Edit) -> str:
    k, read, right = edit
    return atom[:k] + right + atom[k + len(read) :]


def _kind(c: str) -> str:
    return "U" if c.isupper() else "l" if c.isalpha() else "9" if c.isdigit() else "_" if not c else "s"


def _rather(own: int, after: int) -> str:
    """Whether scanned pages have a word that an edit gives more often than the word as read."""
    return "none" if after < 8 else "more" if after >= own + 10 else "same" if after > own - 8 else "less"


def character_candidates(atom: str, editor: Editor, lexicon: Lexicon | None = None, scanned: int | None = None) -> tuple[list, list[list[str]]]:
    """Edits of ``atom`` (first None: keep) with their features; ``scanned`` is its level in scanned pages, where that is given."""
    lexicon = lexicon or editor.lexicon
    digits, upper = sum(c.isdigit() for c in atom), sum(c.isupper() for c in atom)
    code = "c2" if digits > 1 and upper else "c1" if digits and upper > 1 else "c0"
    own, grams = lexicon.known(atom), lexicon.grams(atom)
    scanned = editor.scanned.level(atom.lower()) if scanned is None else scanned
    title = "T" if atom[:1].isupper() else "t"
    size = str(min(len(atom), 6))
    plans: list = [None]
    out = [["keep", f"keep known {own}", f"keep grams {grams}", f"keep {code} {title}", f"keep size {size}", f"keep {code} {own} {title} {min(digits, 3)}"]]
    listed = edits(atom, editor.confusions)
    more = other_edits(atom, lexicon, editor.letters) if len(atom) > 4 and digits < 2 and not own and not any(lexicon.known(apply(atom, e)) for e in listed) else []
    both = [(e, lexicon.known(apply(atom, e))) for e in (*listed, *more)]
    if any(after for _, after in both):  # an edit that makes a known word rules out those that don't
        both = [x for x in both if x[1]]
    for edit, after in both:
        k, read, right = edit
        new = apply(atom, edit)
        later = lexicon.grams(new)
        around = (_kind(atom[k - 1 : k]), _kind(atom[k + len(read) : k + len(read) + 1]))
        foreign = "f" if not read.isalpha() else "a"
        support = editor.confusions.get(read, {}).get(right, 0)
        op = f"{read}>{right}" if support else "replace" if read and right else "delete" if read else "insert"
        often = min(support.bit_length(), 8)
        again = _rather(scanned, editor.scanned.level(new.lower()))
        plans.append(edit)
        out.append(
            [f"op {op}", f"support {often}", f"support {often} {own}>{after}", f"known {own}>{after}", f"known {own}>{after} {title}", f"grams {grams}>{later}", f"{foreign} {around} {code}", f"{foreign} known {after}", f"op {op} {around}", f"{foreign} {after} {later} {code} {title}", f"size {size} {after}"]
            + [f"scanned {again} {after}", f"scanned {again} {title} {foreign}", f"scanned {again} {min(often, 1)} {later}", f"best {after == max(x for _, x in both)} {after}"]
        )
    return plans, out


@dataclass
class Editor:
    """The trained editor: characters, line ends and furniture, over the words of the clean corpus and those of scanned pages."""

    lexicon: Lexicon
    scanned: Lexicon = field(default_factory=lambda: Lexicon.of({}))
    confusions: dict[str, dict[str, int]] = field(default_factory=dict)
    letters: str = ""
    characters: Perceptron = field(default_factory=Perceptron)
    ends: Perceptron = field(default_factory=Perceptron)
    lines: Perceptron = field(default_factory=Perceptron)
    seen: dict[str, str] = field(default_factory=dict)

    def right(self, atom: str) -> str:
        """``atom`` without wrong characters."""
        if (known := self.seen.get(atom)) is not None:
            return known
        if len(self.seen) > 300_000:
            self.seen.clear()
        out = atom
        if len(atom) > 1 and any(c.isalpha() for c in atom) and not self.lexicon.known(atom):
            for _ in range(4):
                plans, features = character_candidates(out, self)
                k = self.characters.best(features)
                if not k:
                    break
                out = apply(out, plans[k])
                if self.lexicon.known(out):
                    break
        self.seen[atom] = out
        return out


# ---------------------------------------------------------------- line ends
KEEP, SPACE, JOIN = range(3)


def end_candidates(left: str, right: str, width: int, lexicon: Lexicon) -> list[list[str]]:
    """Keep the line end, make it a space, or join the lines (deleting a mark of a split word)."""
    a, b = (left.rsplit(None, 1) or [""])[-1], (right.split(None, 1) or [""])[0]
    last = a[-1:]
    mark = last if last and last in MARKS else ""
    x, y = a[:-1] if mark else a, b
    split = bool(mark) and x[-1:].islower() and y[:1].islower()
    joined = apart = 0
    if split:
        head, tail = (m[-1] if (m := _WORD.findall(x)) else ""), (m[0] if (m := _WORD.findall(y)) else "")
        joined, apart = lexicon.known(head + tail), min(lexicon.known(head), lexicon.known(tail))
    end = "." if last in ".!?" else "," if last in ",;" else ":" if last == ":" else "_"
    full = "full" if len(left) + 1 + len(b) > width else "near" if len(left) > 0.75 * width else "short"
    mark_is = "hyphen" if mark == "-" else "other" if mark else "none"
    return _end_features(mark_is, split, joined, apart, end, _kind(b[:1]), full, bool(mark) and bool(right), _kind(x[-1:]))


@lru_cache(maxsize=4096)
def _end_features(mark_is: str, split: bool, joined: int, apart: int, end: str, start: str, full: str, whole: bool, kind: str) -> list[list[str]]:
    """The features, one object for like line ends."""
    base = [f"{mark_is} {split}", f"{mark_is} {split} {joined} {apart}", f"{end} {start} {full}", f"{start} {mark_is}", f"{end} {full}", f"{full} {mark_is}", f"whole {whole} {kind} {start}"]
    return [[f"{op} {f}" for f in (*base, "")] for op in ("keep", "space", "join")]


# ---------------------------------------------------------------- furniture
TEXT, HEADER, PAGE = range(3)


def page_number(line: str) -> tuple[str, int] | None:
    """(form, value) of a line that may be a page number."""
    line = line.strip()
    m = _NUMBER.match(line) if 0 < len(line) <= _NUMBER_LENGTH else None
    if not m:
        return None
    form = next(k for k in ("word", "pair", "dash", "box", "bare", "roman") if m[k] is not None)
    digits = m["a"] or m["b"] or m["c"] or m["d"] or m["e"]
    return form, int(digits) if digits else _roman(m["f"])


def _roman(text: str) -> int:
    value = [{"m": 1000, "d": 500, "c": 100, "l": 50, "x": 10, "v": 5, "i": 1}[c] for c in text.lower()]
    return sum(-a if a < b else a for a, b in zip(value, [*value[1:], 0], strict=True))


def header_part(line: str) -> tuple[str, bool]:
    """A line without the page number that may follow in it, and whether one does."""
    line = line.strip()
    m = _TAIL.match(line) if (line[-1:] in _LAST or line[-1].isdigit()) and _SEPARATED.search(line) else None
    return (m[1], True) if m else (line, False)


def _folded(line: str) -> str:
    try:
        return b" ".join(line.lower().encode("latin-1").translate(_FOLD_BYTES).split()).decode("latin-1")
    except UnicodeEncodeError:
        return re.sub(r"[^\w]+", " ", line.lower().translate(_FOLD)).strip()


@dataclass(slots=True)
class Line:
    text: str
    new: bool  # not in what the piece repeats of the one before
    first: bool
    last: bool
    number: tuple[str, int] | None = None
    head: str = ""
    tail: bool = False
    key: str = ""
    repeated: int = 0
    twin: bool = False  # repeated only in that a line of its own is similar
    sequence: str = "-"
    role: int = TEXT
    misread: bool = False


def lines_of_file(texts: list[str]) -> list[list[Line]]:
    """Lines of a file's pieces, in order, with what the file tells about each: repetition and sequence of numbers."""
    return lines_of_files([texts])[0]


def lines_of_files(files: list[list[str]]) -> list[list[list[Line]]]:
    """``lines_of_file`` of each, whose lines are compared together."""
    read = [_read(texts) for texts in files]
    rare = [list({line.key for rows in out for line in rows if line.key and len(places.get(line.key, ())) < 2}) for out, places in read]
    for (out, places), near in zip(read, _near([(own, list(places)) for own, (_, places) in zip(rare, read, strict=True)]), strict=True):
        _tell(out, places, near)
    return [out for out, _ in read]


def _read(texts: list[str]) -> tuple[list[list[Line]], dict[str, list[int]]]:
    """The lines, and where each stands that is no number."""
    out: list[list[Line]] = []
    before = ""
    for text in texts:
        shared = _overlap(before, text)
        rows, at = [], 0
        parts = text.split("\n")
        for k, part in enumerate(parts):
            line = part.rstrip("\r")
            rows.append(Line(line, at >= shared, k == 0, k == len(parts) - 1, page_number(line), *header_part(line)))
            at += len(part) + 1
        out.append(rows)
        before = text
    places: dict[str, list[int]] = defaultdict(list)
    count = 0
    for rows in out:
        for line in rows:
            count += line.new
            if len(line.head) >= 4 and not line.number:
                key = line.key = _folded(line.head)
                if line.new and (not places[key] or count - places[key][-1] >= 4):
                    places[key].append(count)
    return out, places


def _tell(out: list[list[Line]], places: dict[str, list[int]], near: dict[str, list[str]]) -> None:
    """Sets repetition and sequence of the lines."""

    @cache
    def repeated_like(key: str) -> str | None:
        """The most frequent repeated line that ``key`` may be a misreading of."""
        return next((o for o in sorted((o for o in near.get(key, ()) if len(places[o]) > 1), key=lambda o: (len(places[o]), o), reverse=True) if _similar(key, o)), None)

    @cache
    def single_like(key: str, anywhere: bool) -> str | None:
        """A line that stands once, as ``key`` does, of which both may be misreadings; some lines apart, as a repeated one, unless ``anywhere``."""
        at = places[key][0] if places.get(key) else None
        apart = (o for o in near.get(key, ()) if len(places[o]) == 1 and (anywhere or at is None or abs(places[o][0] - at) >= 4))
        return next((o for o in sorted(apart, reverse=True) if _similar(*sorted((key, o)))), None)

    forms: dict[str, Counter] = defaultdict(Counter)
    previous: tuple[str, int] | None = None
    for rows in out:
        for line in rows:
            if line.number:
                if previous is None:
                    line.sequence = "first"
                else:
                    same, step = line.number[0] == previous[0], line.number[1] - previous[1]
                    line.sequence = f"{'same' if same else 'other'} {step if step in (0, 1) else 'few' if 1 < step < 4 else 'far'}"
                previous = line.number
            elif len(line.head) >= 4:
                key = line.key
                line.repeated = len(places.get(key, ()))
                if line.repeated < 2 and key in near:
                    if other := repeated_like(key):
                        line.repeated, key = len(places[other]), other
                    elif other := single_like(key, line.tail or line.head.isupper()):
                        line.repeated, line.twin, key = 2, True, min(key, other)  # two pages, each misread in its own way
                if line.repeated > 1:
                    forms[key][line.head] += 1
                    line.misread = False
    usual = {k: c.most_common(1)[0][0] for k, c in forms.items()}
    variants = {form: k for k, c in forms.items() for form in c}
    for rows in out:
        for line in rows:
            if line.repeated > 1 and line.head in variants:
                line.misread = line.head != usual[variants[line.head]]


def _near(files: list[tuple[list[str], list[str]]]) -> list[dict[str, list[str]]]:
    """For each file's asked lines, its other lines of about that length that ``_similar`` may hold for.

    Two bounds that lose none, for many pairs at once: letters that both have, and the longest common subsequence of a
    line and the first 64 letters of the shorter one, with all its others.
    """
    every: list[str] = []
    starts, is_own, is_other = [0], [], []
    for asked, keys in files:
        own, other = set(asked), set(keys)
        lines = sorted(own | other, key=len) if own and other else []
        every += lines
        is_own += [k in own for k in lines]
        is_other += [k in other for k in lines]
        starts.append(len(every))
    out: list[dict[str, list[str]]] = [defaultdict(list) for _ in files]
    if not every:
        return out
    lengths = np.array([len(k) for k in every], np.int64)
    codes = np.frombuffer("".join(every).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) % 128
    row = np.repeat(np.arange(len(every)), lengths)
    place = np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for start, stop in zip(starts, starts[1:], strict=False):
        a, b = row.searchsorted([start, stop])
        size = lengths[start:stop]
        letters = np.bincount(codes[a:b] * (stop - start) + row[a:b] - start, minlength=128 * (stop - start)).reshape(128, stop - start)
        letters = letters[letters.any(1)].astype(np.uint8 if stop > start and size[-1] < 256 else np.uint16)
        for i in range(0, stop - start, 64):
            end = min(stop - start, i + 64)
            last = int(size.searchsorted(size[end - 1] + 5))
            for j in range(i, last, 2048):
                to = min(last, j + 2048)
                shared, least = np.zeros((end - i, to - j), letters.dtype), np.empty((end - i, to - j), letters.dtype)
                for mine, others in zip(letters[:, i:end, None], letters[:, None, j:to], strict=True):
                    shared += np.minimum(mine, others, out=least)
                x, y = np.nonzero(2.0 * shared >= 0.85 * (size[i:end, None] + size[None, j:to]) - 1e-9)
                x, y = x + i, y + j
                good = (x < y) & (size[y] - size[x] <= 4)
                found.append((x[good] + start, y[good] + start))
    x, y = (np.concatenate(c) for c in zip(*found, strict=True))
    own, other = np.array(is_own), np.array(is_other)
    good = (own[x] & other[y]) | (own[y] & other[x])
    x, y = x[good], y[good]
    good = _may_share(codes, row, place, lengths, x, y)
    for m, n in zip(x[good].tolist(), y[good].tolist(), strict=True):
        near = out[bisect_right(starts, m) - 1]
        for p, q in ((m, n), (n, m)):
            if is_own[p] and is_other[q]:
                near[every[p]].append(every[q])
    return out


def _may_share(codes: np.ndarray, row: np.ndarray, place: np.ndarray, lengths: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether ``_common`` of the lines ``x`` and ``y`` (the longer ones) may be large enough: the same steps, on 64 bits of all pairs."""
    out = np.zeros(len(x), bool)
    if not len(x):
        return out
    used, back = np.unique(np.concatenate((x, y)), return_inverse=True)
    at = np.full(len(lengths), -1)
    at[used] = np.arange(len(used))
    mine = at[row] >= 0
    row, place, codes = at[row[mine]], place[mine], codes[mine]
    padded = np.full((len(used), int(lengths[used].max())), 128, np.int64)
    padded[row, place] = codes
    masks = np.zeros(len(used) * 129, np.uint64)
    first = place < 64
    np.add.at(masks, row[first] * 129 + codes[first], np.uint64(1) << place[first].astype(np.uint64))
    a, b = back[: len(x)], back[len(x) :]
    step = max(1, 1_000_000 // padded.shape[1])
    for k in range(0, len(x), step):
        mask = masks[padded[b[k : k + step]].T + a[k : k + step] * 129]
        v = np.full(mask.shape[1], ~np.uint64(0))
        for m in mask:
            u = v & m
            v = (v + u) | (v - u)
        short = lengths[x[k : k + step]]
        common = np.bitwise_count(~v).astype(np.int64) + np.maximum(0, short - 64)
        out[k : k + step] = 2 * common >= 0.85 * (short + lengths[y[k : k + step]]) - 1e-9
    return out


@lru_cache(maxsize=4096)
def _places_of(key: str) -> dict[str, int]:
    out: dict[str, int] = defaultdict(int)
    for k, c in enumerate(key):
        out[c] |= 1 << k
    return dict(out)


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, which the matches of a ``SequenceMatcher`` don't exceed (bit-parallel)."""
    at, full = _places_of(a), (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & at.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


@lru_cache(maxsize=1024)
def _similar(a: str, b: str) -> bool:
    return 2 * _common(a, b) >= 0.85 * (len(a) + len(b)) - 1e-9 and difflib.SequenceMatcher(None, a, b, autojunk=False).ratio() >= 0.85


def _overlap(before: str, text: str) -> int:
    """How many characters ``text`` repeats of the end of ``before``."""
    if len(before) < 40 or len(text) < 40:
        return 0
    k = before.find(text[:40])
    while k >= 0 and not text.startswith(before[k:]):
        k = before.find(text[:40], k + 1)
    return len(before) - k if k >= 0 else 0


def line_candidates(rows: list[Line], k: int, width: int) -> list[list[str]]:
    """Features of line ``k`` of a piece as text, as header and as page number."""
    line = rows[k]
    a = b = None
    for i in range(k - 1, -1, -1):
        if not rows[i].number and rows[i].text.strip():
            a = rows[i]
            break
    for i in range(k + 1, len(rows)):
        if not rows[i].number and rows[i].text.strip():
            b = rows[i]
            break
    beside = any(0 <= i < len(rows) and rows[i].number for i in (k - 1, k + 1))
    before = "none" if a is None else "ended" if a.text.rstrip()[-1:] in ".!?" else "split" if a.text.rstrip()[-1:] in MARKS else "open"
    after = "none" if b is None else _kind(b.text.lstrip()[:1])
    end = line.text.rstrip()[-1:]
    ended = "." if end and end in ".!?" else "," if end and end in ",;:" else "-" if end and end in MARKS else "_"
    start = _kind(line.text.lstrip()[:1])
    capitals = 0 if line.head.islower() else sum(map(str.isupper, line.head))
    letters = sum(map(str.isalpha, line.head)) if capitals else 0
    caps = "caps" if capitals > 0.7 * letters and sum(c.isupper() for c in line.head if c.isalpha()) > 0.7 * letters else "low"
    form = line.number[0] if line.number else "tail" if line.tail else "-"
    times = "twin" if line.twin else str(min(line.repeated, 4))
    size = "full" if len(line.text) > 0.85 * width else "part"
    # the place on the page: lines since the number before and to the one after, which stand at the pages' ends
    since = next((k - i for i in range(k - 1, max(-1, k - 5), -1) if rows[i].number), 5)
    until = next((i - k for i in range(k + 1, min(len(rows), k + 5)) if rows[i].number), 5)
    digits = min(sum(c.isdigit() for c in line.text), 6) if line.number else 0
    return _line_features(form, line.sequence, before, after, times, ended, start, caps, size, beside, "twin" if line.twin else min(line.repeated, 2), any(map(str.isdigit, line.head)), min(len(line.head) // 6, 4), line.first, line.last, digits, since, until, bool(line.number))


@lru_cache(maxsize=4096)
def _line_features(form: str, sequence: str, before: str, after: str, times: str, ended: str, start: str, caps: str, size: str, beside: bool, again: str | int, figures: bool, length: int, first: bool, last: bool, digits: int, since: int, until: int, number: bool) -> list[list[str]]:
    """The features, one object for like lines."""
    base = [f"form {form}", f"form {form} {sequence}", f"form {form} {before} {after}", f"times {times} {ended} {start}", f"times {times} {caps} {size}", f"times {times} {before} {after}", f"beside {beside} {times}", f"alone {ended} {size} {before} {after} {again}", f"times {times} {ended} {figures} {length}", f"form {form} {times} {caps}", f"edge {first} {last} {form} {times}", f"digits {digits} {sequence}"]
    if min(since, until) < 5:
        base += [f"place {since} {until} {number}", f"place {min(since, until)} {times} {form}"]
    return [[f"{role} {f}" for f in (*base, "")] for role in ("text", "header", "page")]


# ---------------------------------------------------------------- training on noise made here
def misread(word: str, rng: random.Random, confusions: dict[str, dict[str, int]], letters: str = "", times: int = 1) -> str:
    """The word as recognition might read it: by a learned confusion, as often as it is, or by any other letter (one time in ten, and where none is learned)."""
    for _ in range(times):
        sites = [(k, right, read, n) for read, rights in confusions.items() for right, n in rights.items() if right and right in word for k in _all(word, right)]
        if sites and rng.random() < 0.9:
            k, right, read, _ = rng.choices(sites, [x[3] ** 0.5 for x in sites])[0]
            word = word[:k] + read + word[k + len(right) :]
        elif letters and len(word) > 4:
            k = rng.randrange(1, len(word))
            word = word[:k] + rng.choice([rng.choice(letters), "", rng.choice(letters) + word[k]]) + word[k + 1 :]
    return word


def _page_number(form: int, value: int, total: int) -> str:
    roman = "".join("m" * (value // 1000) if d == 1000 else ("", a, 2 * a, 3 * a, a + b, b, b + a, b + 2 * a, b + 3 * a, a + c)[value // d % 10] for d, a, b, c in ((1000, "m", "", ""), (100, "c", "d", "m"), (10, "x", "l", "c"), (1, "i", "v", "x")))
    return [f"{value}", f"- {value} -", f"— {value} —", f"[{value}]", f"pag. {value}", f"Pagina {value} di {total}", f"{value}/{total}", f"Foglio {value}", roman if value < 4000 else f"{value}", f"Page {value}", f"Seite {value}"][form]


def noisy_pages(texts: list[str], rng: random.Random, confusions: dict[str, dict[str, int]]) -> list[tuple[str, int, int]]:
    """Lines of pages that show ``texts``: (line, role, what its end is)."""
    width, per_page = rng.randint(48, 78), rng.randint(12, 40)
    paragraphs = [p.split() for t in texts for p in t.split("\n")]
    words = [w for p in paragraphs for w in p]
    header = " ".join(w.strip(".,;:!?") for w in rng.sample(words, min(len(words), rng.randint(2, 4)))).strip()
    header = header.upper() if rng.random() < 0.4 else header[:1].upper() + header[1:]
    if rng.random() < 0.3:
        header += f" - {rng.choice(words).strip('.,').capitalize()} {rng.randint(1990, 2030)}"
    has_header, form, value, mark, split = rng.random() < 0.6 and len(header) > 5, rng.randint(0, 10), rng.randint(1, 40) if rng.random() < 0.9 else rng.randint(41, 20_000), rng.choice(MARKS), rng.random() < 0.6
    ragged = rng.random() < 0.25
    with_number, in_header = rng.random() < 0.7, rng.random() < 0.3
    badly = 0.9 if rng.random() < 0.3 else 0.3  # how many of its headers are misread; all of them make twins
    lines: list[tuple[str, int, int]] = []
    # clauses that recur in a text are no headers
    often = [" ".join(words[k : k + rng.randint(1, 8)]) for k in (rng.randrange(len(words)) for _ in range(2))] if rng.random() < 0.5 else []
    often = [re.sub(r"[.,;:!?]*$", "", x)[:width].rstrip() + rng.choice([".", ".", ".", ",", "!"]) for x in often]
    for own in paragraphs:
        if often and rng.random() < 0.3:
            lines.append((rng.choice(often), TEXT, KEEP))
        row, edge, k = "", width, 0
        ends = list(map(add, accumulate(map(len, own), initial=0), count()))  # with a space after each
        while k < len(own):
            # as many words as the line holds, one at least
            at = max(k + (not row), bisect_right(ends, edge - (len(row) or -1) + ends[k], k) - 1)
            row = " ".join([row, *own[k:at]] if row else own[k:at])
            if at >= len(own):
                break
            word, k = own[at], at + 1
            room = edge - len(row) - 2
            # some pages are ragged
            edge = width - rng.randint(0, width // 2) if ragged and rng.random() < 0.3 else width
            core = word.strip(".,;:!?\"'()")
            if split and core.isalpha() and core.islower() and len(core) >= 5 and room >= 2 and word.startswith(core) and rng.random() < 0.7:
                cut = rng.randint(2, min(room, len(core) - 2))
                lines.append((f"{row} {word[:cut]}{mark}", TEXT, JOIN))
                row = word[cut:]
            elif "-" in word[1:-1] and word.index("-", 1) < room:
                cut = word.index("-", 1) + 1
                lines.append((f"{row} {word[:cut]}", TEXT, -1))
                row = word[cut:]
            else:
                lines.append((row, TEXT, SPACE))
                row = word
        if row:
            lines.append((row, TEXT, KEEP))
        if rng.random() < 0.12:
            lines.append((rng.choice([f"Art. {rng.randint(1, 40)}", f"Totale euro {rng.randint(10, 9999)},{rng.randint(10, 99)}", f"€ {rng.randint(10, 999)},{rng.randint(10, 99)}", f"- {' '.join(rng.sample(words, 3))}", f"Voci {rng.randint(1990, 2030)} -", f"Rif. {rng.randint(100, 99999)}", f"{rng.randint(10_000, 9_999_999)}", rng.choice(["Vi", "MI", "Di", "CD"])]), TEXT, KEEP))
    out: list[tuple[str, int, int]] = []
    total = value + len(lines) // per_page
    on_top, from_start = rng.random() < 0.3, rng.random() < 0.7

    def furniture(kind: int) -> None:
        number = _page_number(form, value, total)
        if kind == PAGE and with_number and not (has_header and in_header):
            out.append((number, PAGE, KEEP))
        if kind == HEADER and has_header:
            shown = misread(header, rng, confusions) if rng.random() < badly else header
            out.append((f"{shown} | {number}" if with_number and in_header else shown, HEADER, KEEP))

    for k, line in enumerate(lines):
        if k % per_page == 0 and (k or from_start):
            if k and not on_top:
                furniture(PAGE)
            value += bool(k)
            furniture(HEADER)
            if on_top:
                furniture(PAGE)
        out.append(line)
    if lines and not on_top:
        furniture(PAGE)
    return out


def train(texts: list[str], editor: Editor, seed: int = 3, rounds: int = ROUNDS, paginations: int = PAGINATIONS, words: list[str] | None = None) -> Editor:
    """Train ``editor`` on clean ``texts``, which are made noisy here, and on their words or those given.  Without both it keeps everything."""
    rng, lexicon = random.Random(seed), editor.lexicon
    some = random.Random(seed)  # so that what is learned of characters doesn't hang on which lines are repeated
    texts = [t for t in texts if len(t.split()) > 20]
    if not texts and not words:
        return editor
    examples_of_lines, examples_of_ends = [], []
    files, a = [], 0
    while a < len(texts):  # files of one to four texts, so of two pages and more
        files.append(texts[a : a + rng.randint(1, 4)])
        a += len(files[-1])
    waiting: list[list[tuple[str, int, int]]] = []

    def read() -> None:
        for pages, (rows,) in zip(waiting, lines_of_files([["\n".join(x for x, _, _ in pages)] for pages in waiting]), strict=True):
            width = max(len(r.text) for r in rows)
            examples_of_lines.extend((line_candidates(rows, k, width), {role}) for k, (_, role, _) in enumerate(pages) if role or rows[k].number or rows[k].repeated > 1 or some.random() < 0.1)
        waiting.clear()

    for own in [x for x in files for _ in range(paginations)]:
        pages = noisy_pages(own, rng, editor.confusions)
        width = max(len(x) for x, _, _ in pages)
        waiting.append(pages)
        if len(waiting) >= BATCH:
            read()
        body = [(x, end) for x, role, end in pages if role == TEXT]
        for (x, end), (y, _) in zip(body, body[1:], strict=False):
            if end >= 0 and (end == JOIN or x[-1:] in MARKS or rng.random() < 0.3):
                examples_of_ends.append((end_candidates(x, y, width, lexicon), {end}))
            elif end == -1:  # a hyphen of its own: the line end goes, the hyphen stays; nothing to mend
                examples_of_ends.append((end_candidates(x, y, width, lexicon), {SPACE}))
    read()
    words = list(dict.fromkeys(m for t in texts for m in _atoms(t))) if words is None else list(words)
    rng.shuffle(words)
    # codes are right as they are, whether the texts have any or not
    examples = [(code, code, True) for code in (_code(rng) for _ in range(600 if words else 0))]
    for w in words:
        if not any(c.isalpha() for c in w):
            continue
        if rng.random() < 0.35 or sum(c.isdigit() for c in w) > 1:
            # an unknown word that is right: as if the corpus didn't have it
            examples.append((w, w, True))
        else:
            noisy = misread(w, rng, editor.confusions, editor.letters, 2 if rng.random() < 0.15 else 1)
            # one in five as a name that only scanned pages have
            name = rng.random() < 0.1 and editor.scanned.level(w.lower()) > 12
            if noisy != w and not lexicon.known(noisy):
                examples.append((noisy, w, name))
    prepared = []
    for noisy, w, hidden in examples:
        # a misread word is seen a few times less often than the right one, a right one as often as it is
        level = None if noisy == w else max(8, editor.scanned.level(w.lower()) - rng.choice((8, 16, 24, 40)))
        plans, features = character_candidates(noisy, editor, _Hidden(lexicon, w) if hidden else lexicon, level)
        if noisy == w:
            right = {0}
        else:
            distance = _distance(noisy, w)
            right = {k for k, p in enumerate(plans) if p and (apply(noisy, p) == w or distance > 3 and _distance(apply(noisy, p), w) < distance)} or {k for k, p in enumerate(plans) if p and apply(noisy, p) == w}
        if right:
            prepared.append((features, right))
    for model, data in ((editor.characters, prepared), (editor.ends, examples_of_ends), (editor.lines, examples_of_lines)):  # lines last: as above
        model.learn_all(data, rounds, rng)
    return editor


def _atoms(text: str) -> list[str]:
    return [m for m in _ATOM.findall(text) if 2 <= len(m) <= 25]


def trained(clean: DataFrame, editor: Editor, training: int = TRAINING) -> Editor:
    """``editor`` trained on all ``clean`` rows (id, testo).

    At most ``training`` rows train it here.  Of more, tasks train editors on ``training`` rows each, and others on
    ``WORDS`` words each of all different ones; the weights are averaged by their numbers of examples.
    """
    total = clean.count()
    if total <= training:
        return train([r.testo for r in clean.orderBy(F.xxhash64("id"), "id").select("testo").collect()], editor)
    passes = max(1, min(ROUNDS, round((ROUNDS * PAGINATIONS * training / total) ** 0.5)))
    spark = clean.sparkSession
    held = spark.sparkContext.broadcast(editor)

    def weights(own: list[str], of_words: bool) -> pa.RecordBatch:
        base = held.value
        new = Editor(base.lexicon, base.scanned, base.confusions, base.letters)
        gc.disable()  # many objects, none in cycles
        try:
            train([] if of_words else own, new, _signed_hash(min(own)), passes, passes, own if of_words else [])
        finally:
            gc.enable()
        models = {"characters": new.characters} if of_words else {"ends": new.ends, "lines": new.lines}
        rows = [(m, f, w * p.examples, 0) for m, p in models.items() for f, w in p.weights.items()] + [(m, None, 0.0, p.examples) for m, p in models.items()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.float64(), pa.int64()), strict=True)], names=["model", "feature", "w", "n"])

    def in_parts(size: int, of_words: bool):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            waiting: list[str] = []
            for batch in batches:
                waiting += batch.column(0).to_pylist()
                while len(waiting) >= 2 * size:  # the last part is no small rest
                    yield weights(waiting[:size], of_words)
                    del waiting[:size]
            if waiting:
                yield weights(waiting, of_words)

        return work

    def atoms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spaced: set[str] = set()  # as above
            for t in batch.column(0).to_pylist():
                spaced.update(t.split())
            yield pa.RecordBatch.from_arrays([pa.array(list({w for t in spaced for w in _atoms(t)}), pa.string())], names=["w"])

    schema = "model string, feature string, w double, n long"
    words = durable(clean.select("testo").mapInArrow(atoms, "w string").distinct())
    parts = max(1, round(words.count() / WORDS))
    of_texts = clean.select("testo").mapInArrow(in_parts(training, False), schema)
    of_words = words.repartition(parts, "w").sortWithinPartitions(F.xxhash64("w")).mapInArrow(in_parts(WORDS, True), schema)
    sums = of_texts.unionByName(of_words).groupBy("model", "feature").agg(F.sum("w").alias("w"), F.sum("n").alias("n")).collect()
    examples = {r.model: r.n for r in sums if r.feature is None}
    for r in sums:
        if r.feature is not None and r.w:
            getattr(editor, r.model).weights[r.feature] = r.w / examples[r.model]
    for model, n in examples.items():
        getattr(editor, model).examples = n
    return editor


def _code(rng: random.Random) -> str:
    """A word of capitals and digits."""
    upper, digits = "ABCDEFGHILMNOPRSTUVZ", "0123456789"
    return "".join(rng.choice(rng.choice((upper, digits))) for _ in range(rng.randint(1, 5))) + rng.choice(digits) + rng.choice(upper + digits)


def _distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


class _Hidden(Lexicon):
    """The lexicon without one word."""

    def __init__(self, lexicon: Lexicon, word: str) -> None:
        super().__init__(lexicon.counters, lexicon.hashes, lexicon.seen, lexicon.contexts)
        self.word = word

    def known(self, atom: str) -> int:
        return 0 if atom == self.word else super().known(atom)

    def levels(self, words: list[str]) -> np.ndarray:
        return np.where(np.array(words, object) == self.word.lower(), 0, super().levels(words))

    def _level(self, word: str) -> int:
        return 0 if word == self.word.lower() else super()._level(word)


# ---------------------------------------------------------------- repair
def repair_file(editor: Editor, texts: list[str], cuts: list[tuple[bool, bool]] | None = None, skip: int = 0, pieces: list[list[Line]] | None = None) -> list[tuple[str, list[str], int]]:
    """(text, kinds, edits) of the pieces of a file, in order, but the first ``skip``, which are only read.

    A kind is named only where the piece has it whole: not in what a piece's start or end may have cut (``cuts``).
    ``pieces`` are their lines, where those have been read.
    """
    pieces = lines_of_file(texts) if pieces is None else pieces
    out = []
    for k, rows in enumerate(pieces):
        if k < skip:
            continue
        cut_start, cut_end = cuts[k] if cuts else (k > 0, k + 1 < len(pieces) or len(texts[k]) >= 2500)
        width = max(len(r.text) for r in rows)
        kinds, changed = set(), 0
        for i, line in enumerate(rows):
            if line.number or line.repeated > 1 or line.tail:
                candidates = line_candidates(rows, i, width)
                able = [TEXT, *([HEADER] if line.repeated > 1 else []), *([PAGE] if line.number else [])]
                line.role = able[editor.lines.best([candidates[r] for r in able])]
            whole = not (line.first and cut_start or line.last and cut_end)
            if line.role and whole:
                kinds.add("testata" if line.role == HEADER else "pagina")
                if line.role == HEADER and line.tail:
                    kinds.add("pagina")
                if line.role == HEADER and (line.misread or _fix(editor, line.head, False, False)[1]):
                    kinds.add("glifo")
            changed += line.role != TEXT
        body = [r for r in rows if r.role == TEXT]
        parts: list[str] = []
        joins: list[int] = []
        for i, line in enumerate(body):
            text = line.text
            if i + 1 < len(body):
                op = editor.ends.best(end_candidates(text, body[i + 1].text, width, editor.lexicon)) if text.strip() and body[i + 1].text.strip() else KEEP
                stripped = text.rstrip()
                if op == JOIN and stripped[-1:] and stripped[-1:] in MARKS:
                    text = stripped[:-1]
                    joins.append(sum(map(len, parts)) + len(text))
                    changed += 1
                elif op == JOIN:
                    op = SPACE
                if op == SPACE:
                    text = text if stripped[-1:] == "-" and stripped[-2:-1].strip() else stripped + " "
                elif op == KEEP:
                    text += "\n"
            parts.append(text)
        whole_text = "".join(parts)
        for at in joins:
            a, b = at, at
            while a and not whole_text[a - 1].isspace():
                a -= 1
            while b < len(whole_text) and not whole_text[b].isspace():
                b += 1
            if not (a == 0 and cut_start or b == len(whole_text) and cut_end):
                kinds.add("sillabazione")
        fixed, edits_made, whole_edits = _fix(editor, whole_text, cut_start, cut_end)
        if whole_edits:
            kinds.add("glifo")
        out.append((fixed, sorted(kinds), changed + edits_made))
    return out


def _fix(editor: Editor, text: str, cut_start: bool, cut_end: bool) -> tuple[str, int, int]:
    """Text with wrong characters replaced, how many words changed, and how many of them the piece has whole."""
    parts, done, count, whole = [], 0, 0, 0
    seen = editor.seen
    for m in _ATOM.finditer(text):
        atom = m[0]
        if (new := seen.get(atom) or editor.right(atom)) != atom:
            a, b = m.span()
            if not atom[0].isalpha() and new[0].isalpha():  # a sign or digit for a first letter doesn't tell its case
                before = text[:a].rstrip(" \"'(«“")[-1:]
                new = (new[0].upper() if not before or before in ".!?\n" else new[0].lower()) + new[1:] if new[1:].islower() else new
            if (a == 0 and cut_start) or (b == len(text) and cut_end):
                continue  # cut off: it can't be judged
            parts += [text[done:a], new]
            done = b
            count += 1
            whole += 1
    parts.append(text[done:])
    return "".join(parts), count, whole


def scanned_paths(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """(percorso) of scanned files: by the latest catalogue row, or where that says no or nothing, by signs in the text; images are scans."""
    latest = files.groupBy("percorso").agg(F.max_by("ocr", F.struct("visto_a", "mtime")).alias("ocr"))
    signs = chunks.filter(suffix(F.col("percorso")).isin(*IMAGES) | F.col("testo").rlike(EVIDENCE)).select("percorso").distinct()
    return latest.filter("ocr = 1").select("percorso").union(signs).filter("percorso IS NOT NULL").distinct()


def unknown_words(rows: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(key, w): all different words of ``rows`` (testo) that ``lexicon`` doesn't have, as they are and in small letters (but for capitals only); those that a piece's end may have cut are left out."""
    held = rows.sparkSession.sparkContext.broadcast(lexicon)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {m[0] for t in batch.column(0).to_pylist() for m in _ATOM.finditer(t) if 0 < m.start() and m.end() < len(t)}
            own = [w for w in found if len(w) > 3 and sum(map(str.isalpha, w)) > 1 and not held.value.known(w)]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.string()), pa.array([w if w.isupper() else w.lower() for w in own], pa.string())], names=["key", "w"])

    return durable(rows.select("testo").mapInArrow(work, "key string, w string").distinct())


def fitted_editor(clean: DataFrame, scanned: DataFrame, training: int = TRAINING) -> Editor:
    """The editor for ``scanned`` rows (testo), from ``clean`` ones (id, testo).

    Words of all rows are counted.  Unknown words of scanned rows are aligned with words that clean rows have often, which
    gives the confusions of this recognition; the perceptrons are trained on noise made of them in all suited clean rows.
    """
    counts = durable(word_counts(clean))
    editor = Editor(word_levels(counts), word_levels(word_counts(scanned)))
    words = durable(counts.filter(F.length("w").between(4, 25) & ~F.col("w").rlike("[0-9].*[0-9]")).select("w", "c"))
    lists = unknown_words(scanned, editor.lexicon), words.filter("c = 1").select(F.col("w").alias("key"), "w"), words.filter("c > 2").select("w")
    if all(t.limit(ALIGNED + 1).count() <= ALIGNED for t in lists):
        editor.confusions = learned_confusions(*([r.w for r in t.orderBy("w").collect()] for t in lists))
    else:
        editor.confusions = joined_confusions(*lists)
    letters = Counter({r.c: r.n for r in lists[2].select(F.explode(F.split("w", "")).alias("c")).groupBy("c").agg(F.count("*").alias("n")).collect() if r.c.isalpha()})
    editor.letters = "".join(sorted(c for c, n in letters.items() if n >= 1e-4 * letters.total()))
    trained(clean.filter(F.length("testo").between(300, 6000) & ~F.col("testo").rlike(r"[|\t]| {3}")), editor, training)
    editor.lexicon.seen.clear()
    editor.scanned.seen.clear()
    return editor


def repair_scans(chunks: DataFrame, files: DataFrame, training: int = TRAINING) -> DataFrame:
    """(id, percorso, n, testo, tipi, modifiche): the text of every piece of a scanned file, repaired.

    Page numbers and running headers go, split words are joined, lines of a paragraph follow each other, and wrongly
    recognised characters are replaced; nothing else changes.  ``tipi`` names the kinds of noise a piece has whole.
    The editor is fitted on noise made of all suited clean rows, ``training`` at a time.  Files are
    repaired in blocks of ``BLOCK`` pieces, each read together with the block before, so a file of any length is no hot
    group.  Pieces without a number are taken in the order of their ids, in blocks of their own.  Null text: no row; empty
    text: as it is, without kinds; rows repeated under one id count once; null paths are not scanned.
    """
    spark = chunks.sparkSession
    rows = chunks.select(F.col("id").cast("long").alias("id"), "percorso", F.col("n").cast("int").alias("n"), "testo").filter(F.col("testo").isNotNull())
    paths = scanned_paths(rows, files)
    # the last piece of each scanned file; of others nothing is kept
    paths = durable(rows.select("percorso", "n").join(paths, "percorso", "left_semi").groupBy("percorso").agg(F.max("n").alias("ultimo")))
    scanned = rows.join(paths, "percorso")
    editor = fitted_editor(rows.join(paths, "percorso", "left_anti"), scanned.select("testo"), training)
    held = spark.sparkContext.broadcast(editor)  # nine bytes a distinct word, and weights of features
    names = ["id", "percorso", "n", "testo", "tipi", "modifiche"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        waiting: list[tuple] = []
        groups: list[list[tuple]] = []

        def read() -> Iterator[pa.RecordBatch]:
            for group, pieces in zip(groups, lines_of_files([[r[4] for r in group] for group in groups]), strict=True):
                yield from done(group, pieces)
            groups.clear()

        def done(group: list[tuple], pieces: list[list[Line]]) -> Iterator[pa.RecordBatch]:
            # the block before comes first
            skip = sum(not r[5] for r in group)
            cuts = [(k > 0 if r[3] is None else r[3] > 0 or k > skip, (k + 1 < len(group) if r[3] is None else r[3] < r[6]) or len(r[4]) >= 2500) for k, r in enumerate(group)]
            found = repair_file(own, [r[4] for r in group], cuts, skip, pieces)
            group = group[skip:]
            if group:
                columns = [[r[2] for r in group], [r[0] for r in group], [r[3] for r in group], *([f[k] for f in found] for k in range(3))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int32(), pa.string(), pa.list_(pa.string()), pa.int32()), strict=True)], names=names)

        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if waiting and (waiting[0][:2] != r[:2] or len(waiting) >= 8 * BLOCK):
                    groups.append(waiting)
                    waiting = []
                    if sum(map(len, groups)) >= 2 * BLOCK:
                        yield from read()
                if not waiting or waiting[-1][2] != r[2]:
                    waiting.append(r)
        if waiting:
            groups.append(waiting)
        yield from read()

    block = F.when(F.col("n").isNull(), -1 - F.floor(F.col("id") / BLOCK)).otherwise(F.floor(F.col("n") / BLOCK))
    twice = (F.col("_b") >= 0) & (F.col("_b") < F.floor(F.col("ultimo") / BLOCK))
    places = F.when(twice, F.array(F.struct(F.col("_b").alias("b"), F.lit(True).alias("own")), F.struct((F.col("_b") + 1).alias("b"), F.lit(False).alias("own")))).otherwise(F.array(F.struct(F.col("_b").alias("b"), F.lit(True).alias("own"))))
    placed = scanned.withColumn("_b", block).withColumn("_p", F.explode(places)).select("percorso", F.col("_p.b").alias("blocco"), "id", "n", "testo", F.col("_p.own").alias("proprio"), "ultimo")
    return placed.repartition("percorso", "blocco").sortWithinPartitions("percorso", "blocco", "proprio", "n", "id").mapInArrow(work, _SCHEMA)


def noise_kinds(repaired: DataFrame) -> DataFrame:
    """(id, tipo): each kind of noise of each piece, once."""
    return repaired.select("id", F.explode("tipi").alias("tipo")).distinct()
