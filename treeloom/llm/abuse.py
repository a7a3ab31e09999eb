"""Abusive, hateful or sexual content: class-conditional Kneser-Ney models over segments of a text.

A text is cut into segments (lines, sentences, comments, quoted strings). Two trigram Kneser-Ney models, one of toxic
and one of ordinary words, give each word its log-likelihood ratio; both end in the same unigram continuation counts,
so a rare or unknown word says nothing by itself and only its known surroundings count. What counts in a segment is its
best span: the words in a row whose ratios, each less ``MEAN``, add up to most. So the likelihoods are normalised by
length (a span needs a mean above ``MEAN``), and harmless words around abuse do not dilute it, however many there are.

Labels are given per document and some are wrong, so it has to be found out which words of a bad document are meant:
starting from all of them, a span stays toxic only if the models, without this document's own counts (leave one out),
give it a high sum; all other words become ordinary. A span of a fine document with a high sum is a wrong label and is
left out. A few rounds settle.

A phrase that few labels happen to call bad is told from abuse by the whole corpus: of the documents with a toxic
trigram (or bigram, or context, where the model backs off) a certain share is labelled bad. One whose share is far below
that, by a Poisson test, has at most the ratio of the two shares, and what is left of a span right beside such words
counts only if it is more than they have lost. So harmless phrases that are common in the corpus do not count, however
few labels there are.

The sum from which on a span is a case is the one of ``LIMITS`` with the greatest r * r / n (Lee and Liu's measure for
positive and unlabelled data): r is the share of texts labelled bad that models of the other half of the texts find,
less the share of those labelled fine that they find, n the number of documents found in the corpus.

Disguises are undone before counting: format characters, accents, mixed alphabets, digits for letters, letters spaced
out or repeated, and one letter of a word hidden or replaced, if that leads to a word of the labelled sample. A line
with words joined by ``_`` or ``/`` is read once more with the words apart.

The models are trained on a bounded sample of labelled documents (``MAX_DOCS``, ``MAX_CHARS``, in order of a hash of the
id), in one task; every text of the corpus is scored whole, and the shares are those of the whole corpus.
"""

from __future__ import annotations

import pickle
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeloom.runtime import materialize

MAX_DOCS = 20_000
MAX_CHARS = 48_000_000
#: What each word of a span costs: the mean ratio a span needs at least.
MEAN = 0.4
#: The same in training.
TRAIN_MEAN = 0.2
#: The most one word adds, so that no word alone is a case.
MOST = 3.0
#: Sums from which on a span may be a case; one of them is chosen.
LIMITS = (4.0, 5.0, 6.0, 7.0, 8.0, 10.0)
#: Sum that makes a span toxic in each round of training: strict first, while the toxic model is still mixed.
ROUNDS = (7.0, 6.0, 5.0, 5.0)
#: Chance, under the usual share of bad labels, of as few as a trigram has: below it the trigram is no sign of abuse.
RARE = 1e-3
#: Words on each side of a span that stand right beside it.
BESIDE = 3
DISCOUNT = 0.75
#: Strength of the lower order besides the discount: a context seen two or three times proves little.
STRENGTH = 3.0
CACHE = 300_000
#: Words in the vocabulary from which on those of a single document are left out of it: three ids must fit into 64 bits.
MAX_WORDS = 2_000_000

UNKNOWN, EDGE = 0, 1
#: Letters of other alphabets that look like Latin ones, and signs used for letters.
LOOKALIKE = str.maketrans("аеорсухіјѕԁһԛԝοαερτυνικ", "aeopcyxijsdhqwoaeptuvik")
SIGNS = str.maketrans("013457@$!", "oieastasi")

_CORE = re.compile(r"[^\W_](?:[\w*#@$!]*[^\W_])?")
_NUMBER = re.compile(r"(?:0x)?[0-9a-f]*[0-9][0-9a-f]*|[0-9][0-9.]*")
_SPACED = re.compile(r"(?<![^\s\"'(])[^\W\d_](?:[ \u00a0.*_-]{1,2}[^\W\d_]){2,}(?![^\s.,;:!?)\"'])")
_GAPS = re.compile(r"[ \u00a0.*_-]")
#: UTF-8 bytes that were read as Latin-1 or Windows-1252.
_BROKEN = re.compile(r"[\u00c2-\u00f4][\u0080-\u00bf\u0152-\u0178\u0192\u02c6-\u02dc\u2013-\u2122]")
_REPEAT = re.compile(r"([^\W\d_])\1{2,}")
_CJK = re.compile(r"[⺀-鿿가-힯ｦ-ﾟ]")
_OPENS = re.compile(r"""^[\"“”„«(\[*]*(?:[\"“”„«]|/\*|//|#|--|>)|^[>*#;]+$""")
#: Signs that end a segment, closing brackets after them aside.
_CLOSERS = frozenset('.!?;:。！？"”»')
_JOINS = re.compile(r"[_/]+")


class Reader:
    """Turns text into word ids; id 1 marks both edges of a segment. Without a vocabulary it gives words.

    With ``apart`` a line with joined words comes a second time with the words apart. Training goes without: the second
    line would outlive the leave-one-out of the first.
    """

    def __init__(self, words: dict[str, int] | None = None, hidden: dict[str, str] | None = None, apart: bool = False) -> None:
        self.words, self.hidden, self.apart, self.cache, self.meant = words, hidden or {}, apart, {}, {}
        self.longest = max(map(len, self.hidden), default=0)  # longer words can't be one with a letter hidden

    def known(self, w: str) -> bool:
        return self.words is not None and w in self.words

    def resolve(self, w: str) -> str:
        """The word meant by a token of lower-case letters, digits and signs."""
        if self.words is not None and w in self.words and w.isalpha():
            return w
        found = self.meant.get(w)
        if found is None:
            found = self._resolve(w)
            if len(w) <= 64:
                self.meant[w] = found
        return found

    def _resolve(self, w: str) -> str:
        if _NUMBER.fullmatch(w) and not (w.isalpha()):
            return "<n>"
        if w.isalpha():
            if self.words is None or w in self.words or len(w) < 4:
                return w
            squeezed = _REPEAT.sub(r"\1", w)
            if squeezed != w:
                return self.resolve(squeezed)
            latin = w.translate(LOOKALIKE)
            if latin != w:
                return self.resolve(latin)
            for i in range(len(w) if len(w) <= self.longest else 0):
                if found := self.hidden.get(f"{w[:i]}*{w[i + 1:]}"):
                    return found
            return w
        plain = w.translate(SIGNS)
        if self.known(plain):
            return plain
        if "*" in w or "#" in w:
            holes = re.sub(r"[*#]", "*", plain)
            if holes.count("*") == 1 and (found := self.hidden.get(holes)):
                return found
            return "<x>"
        if plain.isalpha() and self.words is not None:
            found = self.resolve(plain)
            if self.known(found):
                return found
        return "<x>"

    def chunk(self, raw: str) -> tuple[tuple, tuple]:
        """Tokens of what stands between two spaces, with the edges it brings, and those with joined words apart (or nothing)."""
        s = raw
        if not s.isascii():
            if _BROKEN.search(s):
                s = _repaired(s)
            s = unicodedata.normalize("NFKD", s)
            s = "".join(c for c in s if unicodedata.category(c) not in ("Cf", "Mn", "Cc"))
        s = s.lower()
        apart: list = []
        if _CJK.search(s):
            out = []
            for part in re.findall(r"[⺀-鿿가-힯ｦ-ﾟ]|[a-z0-9_/.]+|[。！？]", s):
                if part in "。！？":
                    out.append(EDGE)
                else:
                    out.append(part if _CJK.match(part) else "<x>")
        elif "/" in s and re.search(r"\w/\w", s):
            out = ["<p>"]
            apart = [self.resolve(w) for w in _CORE.findall(_JOINS.sub(" ", s))]
        else:
            found = _CORE.findall(s)
            out = ["<i>" if "_" in w else self.resolve(w) for w in found]
            if "<i>" in out:
                apart = [self.resolve(w) for w in _CORE.findall(_JOINS.sub(" ", s))]
        before = [EDGE] if _OPENS.match(s) else []
        after = [EDGE] if s.endswith("*/") or s.rstrip(")]")[-1:] in _CLOSERS else []
        return tuple(self._ids(before + out + after)), tuple(self._ids(before + apart + after)) if apart else ()

    def _ids(self, out: list) -> list:
        if self.words is None:
            return out
        get = self.words.get
        return [x if x == EDGE else get(x, UNKNOWN) for x in out]

    def read(self, text: str, out: list) -> None:
        """Append the ids of a text to ``out``, each line framed by edges."""
        extend, append, get, fresh = out.extend, out.append, self.cache.get, self._fresh
        if len(self.cache) > CACHE:
            self.cache.clear()
        if len(self.meant) > CACHE:
            self.meant.clear()
        append(EDGE)
        for line in text.splitlines():
            if _SPACED.search(line):
                line = _SPACED.sub(lambda m: _GAPS.sub("", m[0]), line)
            got = [get(raw) or fresh(raw) for raw in line.split()]
            for whole, _ in got:
                extend(whole)
            append(EDGE)
            if self.apart and any(apart for _, apart in got):
                for whole, apart in got:
                    extend(apart or whole)
                append(EDGE)

    def _fresh(self, raw: str) -> tuple[tuple, tuple]:
        got = self.chunk(raw)
        if len(raw) <= 256:  # longer ones hardly come twice
            self.cache[raw] = got
        return got


def _repaired(s: str) -> str:
    for codec in ("latin-1", "cp1252"):
        try:
            return s.encode(codec).decode("utf-8")
        except UnicodeError:
            pass
    return s


def segments(ids: list) -> Iterator[tuple]:
    """The non-empty segments in a list of ids."""
    start = 0
    for i, x in enumerate(ids):
        if x == EDGE:
            if i > start:
                yield tuple(ids[start:i])
            start = i + 1
    if len(ids) > start:
        yield tuple(ids[start:])


def _index(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(keys, return_inverse=True)


class _Counts:
    """n-grams of all segment types, once; counts follow from a weight for each type."""

    def __init__(self, types: list[tuple], size: int) -> None:
        flat = np.fromiter((x for t in types for x in (*t, EDGE)), np.int64)
        lengths = np.fromiter((len(t) + 1 for t in types), np.int64, len(types))
        self.of = np.repeat(np.arange(len(types)), lengths)
        self.start = np.r_[0, np.cumsum(lengths)[:-1]]
        first = np.zeros(len(flat), bool)
        first[self.start] = True
        second = np.r_[False, first[:-1]] & ~first
        v = np.where(first, EDGE, np.r_[EDGE, flat[:-1]])
        u = np.where(first | second, EDGE, np.r_[EDGE, EDGE, flat[:-2]])
        self.size = size
        self.tri_keys, self.tri = _index((u * size + v) * size + flat)
        self.ctx_keys, tri_ctx = _index(self.tri_keys // size)
        self.bi_keys, tri_bi = _index(self.tri_keys % (size * size))
        self.mid_keys, bi_mid = _index(self.bi_keys // size)
        self.tri_ctx, self.tri_bi, self.bi_mid = tri_ctx, tri_bi, bi_mid
        self.bi_word = self.bi_keys % size

    def fit(self, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Counts of one class; ``weight`` of each word of each segment type."""
        n3 = np.bincount(self.tri, weight, len(self.tri_keys))
        seen = (n3 > 0).astype(float)
        n2 = np.bincount(self.tri_bi, seen, len(self.bi_keys))  # continuation counts
        return {
            "n3": n3, "c3": np.bincount(self.tri_ctx, n3, len(self.ctx_keys)), "f3": np.bincount(self.tri_ctx, seen, len(self.ctx_keys)),
            "n2": n2, "c2": np.bincount(self.bi_mid, n2, len(self.mid_keys)), "f2": np.bincount(self.bi_mid, (n2 > 0).astype(float), len(self.mid_keys)),
        }

    def shared(self, *fits: dict) -> np.ndarray:
        """Unigram continuation probabilities over both classes."""
        n1 = np.bincount(self.bi_word, (sum(f["n2"] for f in fits) > 0).astype(float), self.size) + 0.5
        return n1 / n1.sum()

    def probability(self, f: dict, u: np.ndarray, minus: float = 0.0) -> np.ndarray:
        """P(w | two words before) of each distinct trigram; ``minus`` takes one own occurrence out of the counts."""
        bi = self.tri_bi
        mid = self.bi_mid[bi]
        gone = ((f["n3"] > 0) & (f["n3"] <= minus)).astype(float)
        n2, c2, f2 = f["n2"][bi] - gone, f["c2"][mid] - gone, f["f2"][mid] - gone * (f["n2"][bi] <= gone)
        uni = u[self.bi_word[bi]]
        p2 = np.where(c2 > 0, (np.maximum(n2 - DISCOUNT, 0) + (DISCOUNT * np.maximum(f2, 1) + STRENGTH) * uni) / (np.maximum(c2, 1) + STRENGTH), uni)
        n3, c3, f3 = np.maximum(f["n3"] - minus, 0), f["c3"][self.tri_ctx] - minus, f["f3"][self.tri_ctx] - gone
        return np.where(c3 > 0, (np.maximum(n3 - DISCOUNT, 0) + (DISCOUNT * np.maximum(f3, 1) + STRENGTH) * p2) / (np.maximum(c3, 1) + STRENGTH), p2)


def best_spans(ratio: np.ndarray, start: np.ndarray, most: float = np.inf, mean: float | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each segment the greatest sum of ratios (at most ``most`` each) less MEAN over words in a row, and the first and last place of that span."""
    n = len(ratio)
    segment = np.zeros(n, np.int64)
    segment[start[1:]] = 1
    segment = np.cumsum(segment)
    upto = np.cumsum(np.minimum(ratio.astype(np.float64), most) - (MEAN if mean is None else mean))
    before = np.r_[0.0, upto[:-1]]
    shift = segment * (np.ptp(before) + 1.0)  # makes a running minimum begin anew in each segment
    shifted = before - shift
    low = np.minimum.accumulate(shifted)
    at = np.maximum.accumulate(np.where(shifted <= low, np.arange(n), 0))
    gain = upto - (low + shift)
    best = np.maximum.reduceat(gain, start)
    last = np.full(len(start), n, np.int64)
    top = np.flatnonzero(gain >= best[segment])
    np.minimum.at(last, segment[top], top)
    return best, at[last], last


def train(texts: Iterable[tuple[str, bool]], hold_out: bool = True) -> dict:
    """The model as plain arrays, from (text, labelled bad) pairs. No bad or no fine text: no case is ever found.

    With ``hold_out`` it has the sums of the texts by models of the other half of the texts (``held``: bad, then fine ones).
    """
    votes: Counter = Counter()
    for t, bad in texts:
        if t:
            votes[t] += 1 if bad else -1
    texts = [(t, n >= 0) for t, n in votes.items()]  # a text sent twice is one text: its copy would defeat leave-one-out
    plain = Reader()
    seen: dict[bool, Counter] = {True: Counter(), False: Counter()}
    for t, bad in texts:
        out: list = []
        plain.read(t, out)
        seen[bad].update({x for x in out if x != EDGE})
    docs = {b: max(1, sum(bad == b for _, bad in texts)) for b in (True, False)}
    every = set(seen[True]) | set(seen[False])
    if len(every) > MAX_WORDS:
        every = {w for w in every if seen[True][w] + seen[False][w] > 1}
    vocabulary = ["<unknown>", "<edge>", *sorted(every)]
    words = {w: i for i, w in enumerate(vocabulary) if i != UNKNOWN}
    hidden: dict[str, str] = {}
    telling = [w for w, n in seen[True].items() if len(w) >= 4 and w.isalpha() and n >= 2 and n / docs[True] > 4 * seen[False][w] / docs[False]]
    for w in sorted(telling, key=lambda w: (seen[True][w], w)):
        for i in range(len(w)):
            hidden[f"{w[:i]}*{w[i + 1:]}"] = w
    longest = max(map(len, hidden), default=0)
    rare = {w for w in words if seen[True][w] + seen[False][w] == 1 and w.isalpha() and 4 <= len(w) <= longest}
    reader = Reader({w: i for w, i in words.items() if w not in rare} | {w: i for w, i in words.items() if w in rare and not _near(w, hidden)}, hidden)

    n_bad: Counter = Counter()
    n_fine: Counter = Counter()
    for t, bad in texts:
        out = []
        reader.read(t, out)
        (n_bad if bad else n_fine).update(set(segments(out)))
    types = sorted(set(n_bad) | set(n_fine))
    model = {"words": reader.words, "hidden": hidden, "size": len(vocabulary), "held": (np.zeros(0), np.zeros(0))}
    if not n_bad or not n_fine:
        return model | {"tri": (np.zeros(0, np.int64), np.zeros(0)), "ctx": (np.zeros(0, np.int64), np.zeros(0)), "bi": (np.zeros(0, np.int64), np.zeros(0)), "mid": np.zeros(len(vocabulary))}
    c = _Counts(types, len(vocabulary))
    nb = np.array([n_bad[t] for t in types], float)[c.of]
    nf = np.array([n_fine[t] for t in types], float)[c.of]
    toxic, ordinary = nb.copy(), nf.copy()
    place = np.arange(len(c.of))

    def inside(ratio: np.ndarray, least: float) -> np.ndarray:
        best, lo, hi = best_spans(ratio, c.start, mean=TRAIN_MEAN)
        return (best > least)[c.of] & (place >= lo[c.of]) & (place <= hi[c.of])

    for least in ROUNDS:
        t, o = c.fit(toxic), c.fit(ordinary)
        u = c.shared(t, o)
        pt, po = np.log(c.probability(t, u))[c.tri], np.log(c.probability(o, u))[c.tri]
        pt1, po1 = np.log(c.probability(t, u, 1.0))[c.tri], np.log(c.probability(o, u, 1.0))[c.tri]
        in_bad = inside(np.where(toxic > 0, pt1 - po, pt - po1), least)
        in_fine = inside(np.where(ordinary > 0, pt - po1, pt - po), least)
        toxic = np.where(in_bad, nb, 0.0)
        ordinary = np.where(in_fine, 0.0, nf) + np.where(in_bad, 0.0, nb)
    t, o = c.fit(toxic), c.fit(ordinary)
    return model | {"held": _held_out(texts) if hold_out else None} | _tables(c, t, o)


def _held_out(texts: list[tuple[str, bool]]) -> tuple[np.ndarray, np.ndarray]:
    fold = np.array([zlib.crc32(t.encode("utf-8", "surrogatepass")) & 1 for t, _ in texts])
    bad = np.array([b for _, b in texts])
    value = np.zeros(len(texts))
    for f in (0, 1):
        scorer = Scorer(train([texts[i] for i in np.flatnonzero(fold != f)], hold_out=False))
        value[fold == f] = scorer.score([texts[i][0] for i in np.flatnonzero(fold == f)])
    return value[bad], value[~bad]


def _near(w: str, hidden: dict[str, str]) -> bool:
    """Whether the word is a telling one with a letter replaced."""
    return any((f := hidden.get(f"{w[:i]}*{w[i + 1:]}")) and f != w for i in range(len(w)))


def _tables(c: _Counts, t: dict, o: dict) -> dict:
    """Log ratios of known trigrams, and the ratios to back off with where a trigram or a bigram is unknown.

    Below a bigram both classes share one distribution, so it cancels out.
    """
    u = c.shared(t, o)
    tri = np.log(c.probability(t, u)) - np.log(c.probability(o, u))

    def backoff(fan, n):
        return np.where(n > 0, np.log((DISCOUNT * fan + STRENGTH) / (n + STRENGTH)), 0.0)

    def p2(f):
        n, uni = f["c2"][c.bi_mid], u[c.bi_word]
        return np.where(n > 0, (np.maximum(f["n2"] - DISCOUNT, 0) + (DISCOUNT * f["f2"][c.bi_mid] + STRENGTH) * uni) / (n + STRENGTH), uni)

    mid = np.zeros(c.size)
    mid[c.mid_keys] = backoff(t["f2"], t["c2"]) - backoff(o["f2"], o["c2"])
    return {
        "tri": (c.tri_keys, tri), "ctx": (c.ctx_keys, backoff(t["f3"], t["c3"]) - backoff(o["f3"], o["c3"])),
        "bi": (c.bi_keys, np.log(p2(t)) - np.log(p2(o))), "mid": mid,
    }


class _Lookup:
    """Values of 64-bit keys in an open table: vectorised, a few probes."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        bits = max(10, int(np.ceil(np.log2(max(1, len(keys)) * 3))))
        self.shift = np.uint64(64 - bits)
        self.mask = (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.zeros(1 << bits, np.float32)
        self.probes = 0
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            self.probes += 1
            at = slot[left]
            free = self.keys[at] < 0
            take, first = np.unique(at[free], return_index=True)
            won = left[free][first]
            self.keys[take], self.values[take] = keys[won], values[won]
            slot[left] = (slot[left] + 1) & self.mask
            left = np.setdiff1d(left, won, assume_unique=True)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(value or 0, found)."""
        slot = self._slot(keys)
        found = self.keys[slot] == keys
        value = np.where(found, self.values[slot], np.float32(0))
        open_ = np.flatnonzero(~found & (self.keys[slot] >= 0))
        for _ in range(self.probes - 1):
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & self.mask
            at = self.keys[slot[open_]]
            hit = at == keys[open_]
            value[open_[hit]] = self.values[slot[open_[hit]]]
            found[open_[hit]] = True
            open_ = open_[~hit & (at >= 0)]
        return value, found


class Scorer:
    """Scores texts with a model of :func:`train`; ``corrected`` also knows the caps of :func:`caps_of`."""

    def __init__(self, model: dict) -> None:
        self.reader = Reader(model["words"], model["hidden"], True)
        self.size = np.int64(model["size"])
        self.tri, self.ctx, self.bi = (_Lookup(*model[k]) for k in ("tri", "ctx", "bi"))
        self.mid = model["mid"].astype(np.float32)
        self.caps: dict[int, _Lookup] = {}

    def limited(self, caps: dict[int, tuple[np.ndarray, np.ndarray]]) -> Scorer:
        """The same scorer, with other caps."""
        self.caps = {k: _Lookup(*v) for k, v in caps.items() if len(v[0])}
        return self

    def ratios(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ratio, kind, key): log ratio of each id, given the two before (edges cut), and what of the model it comes from."""
        v = np.r_[EDGE, ids[:-1]]
        u = np.where(v == EDGE, EDGE, np.r_[EDGE, v[:-1]])
        ctx = u * self.size + v
        key = ctx * self.size + ids
        kind = np.zeros(len(ids), np.int8)
        value, known = self.tri.get(key)
        rest = np.flatnonzero(~known)
        if len(rest):
            pair = v[rest] * self.size + ids[rest]
            low, seen = self.bi.get(pair)
            value[rest] = self.ctx.get(ctx[rest])[0] + np.where(seen, low, self.mid[v[rest]])
            kind[rest] = np.where(seen, 1, 2)
            key[rest] = np.where(seen, pair, v[rest])
        return value, kind, key

    def _ratios(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ratios as the model has them, and under the caps."""
        value, kind, key = self.ratios(ids)
        capped = value.copy()
        for k, table in self.caps.items():
            at = np.flatnonzero(kind == k)
            cap, there = table.get(key[at])
            capped[at] = np.where(there, np.minimum(value[at], cap), value[at])
        return value, capped

    def segments(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids, start, doc, sum) of the non-empty segments of all texts: places in ``ids``, number of the text, best span."""
        flat: list = []
        ends = np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            if t:
                self.reader.read(t, flat)
            ends[i] = len(flat)
        if not flat:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        ids = np.array(flat, np.int64)
        doc = np.searchsorted(ends, np.arange(len(ids)), "right")
        keep = np.ones(len(ids), bool)
        keep[1:] = (ids[1:] != EDGE) | (ids[:-1] != EDGE)
        ids, doc = ids[keep], doc[keep]
        start = np.flatnonzero(np.r_[True, ids[:-1] == EDGE])  # a segment is what follows an edge, with the edge that ends it
        best = best_spans(self.ratios(ids)[0], start, MOST)[0]
        ok = ids[start] != EDGE
        return ids, start[ok], doc[start[ok]], best[ok]

    def score(self, texts: list[str | None]) -> np.ndarray:
        """For each text the greatest sum of a best span over its segments.

        Null, empty and blank texts have no segment and score -10, the lowest score there is.
        """
        out = np.full(len(texts), -10.0)
        _, _, doc, best = self.segments(texts)
        np.maximum.at(out, doc, np.maximum(best, -10.0))
        return out

    def candidates(self, texts: list[str | None], least: float) -> tuple[np.ndarray, list[list[list[int]]]]:
        """For each text the greatest sum up to ``least``, and the distinct segments (ids without edges) above it."""
        rest = np.full(len(texts), -10.0)
        ids, start, doc, best = self.segments(texts)
        high = best > least
        np.maximum.at(rest, doc[~high], np.maximum(best[~high], -10.0))
        above: list[dict] = [{} for _ in texts]
        edges = np.flatnonzero(ids == EDGE)
        for at, d in zip(start[high], doc[high], strict=True):
            n = np.searchsorted(edges, at)
            above[d][tuple(ids[at : edges[n] if n < len(edges) else len(ids)].tolist())] = None
        return rest, [[list(s) for s in a] for a in above]

    def laid_out(self, segments: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, start) of segments given without edges."""
        ids = np.array([x for s in segments for x in (*s, EDGE)], np.int64)
        return ids, np.cumsum([0, *(len(s) + 1 for s in segments)])[:-1].astype(np.int64)

    def corrected(self, segments: list[list[int]]) -> np.ndarray:
        """The sum of the best span of each segment under the caps, 0 where the caps took more right there than is left."""
        ids, start = self.laid_out(segments)
        full, capped = self._ratios(ids)
        best, lo, hi = best_spans(capped, start, MOST)
        lost = np.cumsum(np.r_[0.0, np.minimum(full, MOST) - np.minimum(capped, MOST)])
        end = np.r_[start[1:], len(ids)]
        near = lost[np.minimum(hi + 1 + BESIDE, end)] - lost[np.maximum(lo - BESIDE, start)]
        return np.where(near > best, 0.0, best)


def chosen(docs: DataFrame, labels: DataFrame) -> list[tuple[int, bool]]:
    """(doc_id, bad) of the labelled sample: at most MAX_DOCS documents of at most MAX_CHARS characters in all.

    Equal label rows count once; null labels, and labels of documents that do not exist or have no text, not at all. A
    document is bad if it has at least as many bad opinions as others. Documents come in order of a hash of their id;
    one that would pass the bound of characters is left out alone. The driver sees at most MAX_DOCS ids and lengths.
    """
    votes = labels.filter("label is not null and doc_id is not null").select("doc_id", "label", *(c for c in ("reviewer", "labelled_at") if c in labels.columns)).distinct()
    votes = votes.groupBy("doc_id").agg(F.sum(F.when(F.col("label") == "bad", 1).otherwise(-1)).alias("balance"))
    first = votes.select("doc_id", (F.col("balance") >= 0).alias("bad"), F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").limit(MAX_DOCS)
    lengths = docs.select("doc_id", F.length("text").alias("n")).filter("n > 0").join(F.broadcast(first), "doc_id")
    taken, room = [], MAX_CHARS
    for r in lengths.orderBy("h", "doc_id").select("doc_id", "bad", "n").collect():
        if r["n"] <= room:
            room -= r["n"]
            taken.append((r["doc_id"], r["bad"]))
    return taken


def _train_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pairs = [p for b in batches for p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
    yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps(train(pairs))], pa.binary())})


def fit(docs: DataFrame, labels: DataFrame) -> tuple[bytes, list[int]]:
    """The model, trained in one task on the bounded sample, and the ids of the documents in it that are labelled bad."""
    ids = chosen(docs, labels)
    if not ids:
        return pickle.dumps(train([])), []
    these = docs.sparkSession.createDataFrame(ids, "doc_id long, bad boolean")
    rows = docs.select("doc_id", "text").join(F.broadcast(these), "doc_id").select("text", "bad").coalesce(1).mapInArrow(_train_task, "model binary").collect()
    return bytes(rows[0][0]) if rows else pickle.dumps(train([])), [i for i, bad in ids if bad]


_SCORERS: dict[int, Scorer] = {}


def _scorer(name: int, data: bytes) -> Scorer:
    """One scorer in each Python worker, made anew for another model."""
    if name not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[name] = Scorer(pickle.loads(data))
    return _SCORERS[name]


def _few_bad(bad: np.ndarray, expected: np.ndarray) -> np.ndarray:
    """Poisson chance of at most ``bad`` where ``expected`` are expected."""
    out = np.ones(len(bad))
    for i in np.flatnonzero(bad < expected):
        steps = np.log(expected[i]) - np.log(np.arange(1, int(bad[i]) + 1))
        out[i] = np.exp(np.r_[0.0, np.cumsum(steps)] - expected[i]).sum()
    return out


def caps_of(kind: np.ndarray, key: np.ndarray, docs: np.ndarray, bad: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """kind: (keys, greatest ratio) of those that too few bad labels support.

    ``docs`` is the number of documents with a key in a candidate span, ``bad`` that of those labelled bad. The usual
    share of bad labels is that of the keys which are not capped, so it is found in a few rounds.
    """
    usual = np.ones(len(key), bool)
    share = 0.0
    for _ in range(20):
        share = bad[usual].sum() / max(1, docs[usual].sum())
        now = _few_bad(bad, share * docs) >= RARE
        if (now == usual).all():
            break
        usual = now
    cap = np.log((bad + 0.5) / (share * docs + 0.5))
    return {k: (key[~usual & (kind == k)], cap[~usual & (kind == k)]) for k in (0, 1, 2)}


def scores(docs: DataFrame, model: bytes, bad_ids: list[int]) -> DataFrame:
    """(doc_id, source, score) of every document; above 1 it is a case. Documents without a segment have -10.

    Texts are read once. What is kept of each is its candidate segments, a small part; the shares of the corpus and the
    final scores come from them. Corrections only lower scores, so no other segment can become a case.
    """
    spark = docs.sparkSession
    shared, name, least = spark.sparkContext.broadcast(model), hash(model), min(LIMITS)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(name, shared.value)
        for b in batches:
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                rest, above = scorer.candidates(part.column(2).to_pylist(), least)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(rest), pa.array(above, pa.list_(pa.list_(pa.int32())))], names=["doc_id", "source", "rest", "above"])

    read = materialize(docs.select("doc_id", "source", "text").mapInArrow(first, "doc_id long, source string, rest double, above array<array<int>>"), "segments")

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(name, shared.value)
        for b in batches:
            if not b.num_rows:
                continue
            above = b.column(1).to_pylist()
            ids, start = scorer.laid_out([s for a in above for s in a])
            doc = np.repeat(np.arange(len(above)), [sum(len(s) + 1 for s in a) for a in above])
            ratio, kind, key = scorer.ratios(ids)
            _, lo, hi = best_spans(ratio, start, MOST)
            inside = np.zeros(len(ids) + 1, np.int64)
            np.add.at(inside, lo, 1)
            np.add.at(inside, hi + 1, -1)
            use = (np.cumsum(inside[:-1]) > 0) & (ratio > MEAN)
            doc, kind, key = doc[use], kind[use], key[use]
            order = np.lexsort((key, kind, doc))  # each of a document's keys once
            doc, kind, key = doc[order], kind[order], key[order]
            new = np.ones(len(key), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (kind[1:] != kind[:-1]) | (key[1:] != key[:-1])
            bad = b.column(0).to_numpy()[doc[new]]
            yield pa.RecordBatch.from_arrays([pa.array(kind[new], pa.int32()), pa.array(key[new], pa.int64()), pa.array(bad, pa.int32())], names=["kind", "key", "bad"])

    ids = spark.createDataFrame([(i,) for i in bad_ids], "id long").withColumn("bad", F.lit(1))
    marked = read.filter("size(above) > 0").join(F.broadcast(ids), F.col("doc_id") == F.col("id"), "left").select(F.coalesce("bad", F.lit(0)).alias("bad"), "above")
    # One row for each toxic part of the model: its number is bounded by that of the sample.
    counts = marked.mapInArrow(keys, "kind int, key long, bad int").groupBy("kind", "key").agg(F.count(F.lit(1)).alias("docs"), F.sum("bad").alias("bad")).toPandas()
    caps = pickle.dumps(caps_of(*(counts[c].to_numpy(t) for c, t in (("kind", np.int64), ("key", np.int64), ("docs", float), ("bad", float)))))
    shared_caps = spark.sparkContext.broadcast(caps)

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(name, shared.value).limited(pickle.loads(shared_caps.value))
        for b in batches:
            value = b.column(2).to_numpy().copy()
            above = b.column(3).to_pylist()
            flat = [s for a in above for s in a]
            if flat:
                np.maximum.at(value, np.repeat(np.arange(len(above)), [len(a) for a in above]), np.maximum(scorer.corrected(flat), -10.0))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(value)], names=["doc_id", "source", "total"])

    total = read.mapInArrow(last, "doc_id long, source string, total double")
    held = pickle.loads(model)["held"]
    found = total.agg(*(F.count(F.when(F.col("total") > x, 1)).alias(f"n{i}") for i, x in enumerate(LIMITS))).first()
    bad, fine = (np.array([(h > x).mean() if len(h) else 0.0 for x in LIMITS]) for h in held)
    worth = np.maximum(bad - fine, 0) ** 2 / np.maximum(np.array(found), 1)
    limit = LIMITS[int(np.argmax(worth))] if worth.max() > 0 else LIMITS[-1]
    return total.select("doc_id", "source", F.when(F.col("total") <= -10, F.lit(-10.0)).otherwise(F.col("total") / limit).alias("score"))
