"""Toxicity scores of texts whose disguised words are first restored.

Noisy channel: a writer's letters may be swapped for look-alikes, repeated, or set
apart. For each token that shows such marks, the lattice of its possible letters is
decoded (Viterbi) under a character trigram model counted over all documents; a
token of plain letters has a lattice of one path and passes as it is, and so does a
word with double letters or marks at its edges that many documents hold. The restored
words are then scored by what labelled documents say about them.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from functools import lru_cache
from itertools import chain
from operator import eq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import mapped, saved, slices

#: At most about so many labelled rows are learned from, taken by a hash of the id.
MAX_LABELLED = 30_000
#: At most so many words and word beginnings are kept in the model.
MAX_TERMS = 50_000
THRESHOLD = 0.7
#: Look-alike characters and the letters they may stand for.
LOOK_ALIKE = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "*": "aeiou",
}
#: Channel costs in nats: a look-alike, a repeat that is dropped, a mark that is
#: dropped though it may stand for a letter, any other mark, a mark that sets apart;
#: a star read as a vowel, a letter that is dropped from a double one.
SWAP, REPEAT, DROP, NOISE, APART = 0.7, 0.4, 10.0, 2.0, 0.3
STAR, TWICE = 2.5, 3.0
#: A look-alike at a token's edge that is a mark after all, and one that seldom opens a
#: word as a mark; a space that parts words, after a lone "a" or "i" and elsewhere.
EDGE, OPENING, ALONE, BORDER = 4.0, 7.0, 0.0, 4.0
#: Words taken for plain: seen in so many documents, and in this share of them.
MAX_WORDS, MIN_SEEN, OFTEN = 50_000, 3, 1 / 2000
_APART = " .-_~'/\\,"
_SIZE = 27
_WORD_MARKS = ".,;:!?\"'()[]{}<>«»„“”‚‘’…–—-_*#%&/\\=~^`|"
_THRICE = re.compile(r"([^\W\d_])\1\1")
_THRICE_RUN = re.compile(r"([^\W\d_])\1{2,}")
_TWICE = re.compile(r"([^\W\d_])\1")
#: Amounts, dates and the like: digits with signs at the edges only.
_NUMBER = re.compile(r"[+\-$€£]{0,2}[\d.,:/\-]*\d[\d.,:/\-]*[+$€£%]?")
_SIGNS = frozenset(ch for ch in LOOK_ALIKE if not ch.isdigit())
#: Tokens remembered by a task, and the longest of them.
_CACHE_WORDS, _LONGEST = 200_000, 64
#: Tokens remembered where other operators' stages follow in the same Python workers.
_STAGE_WORDS = 50_000
#: Three characters in a row that stand alone.
_ALONE = re.compile(r"\s\S\s+\S\s+\S(?!\S)")


def _fold(code: int) -> int:
    base = unicodedata.normalize("NFKD", chr(code).lower())[:1]
    return ord(base) - 96 if "a" <= base <= "z" else 0


#: Symbol of each code point below 592: 1-26 for the base letter, 0 for anything else.
_SYMBOL = np.array([_fold(code) for code in range(592)], np.int64)


#: Letters that stand for nothing but themselves.
_OWN = {chr(code): int(symbol) for code, symbol in enumerate(_SYMBOL) if symbol and chr(code).isalpha() and chr(code) not in LOOK_ALIKE}


def _symbol(ch: str) -> int:
    return int(_SYMBOL[ord(ch)]) if ord(ch) < 592 else 0


def _trigram_counts(batches):
    total = np.zeros(_SIZE**3, np.int64)
    for part in slices(batches):
        text = "\n".join(t for t in part.column(0).to_pylist() if t)
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        s = np.concatenate([[0, 0], _SYMBOL[np.where(codes < 592, codes, 0)], [0]])
        # a boundary right after a boundary starts afresh
        before = np.where(s[1:-1] == 0, 0, s[:-2])
        total += np.bincount(before * _SIZE**2 + s[1:-1] * _SIZE + s[2:], minlength=_SIZE**3)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["code", "n"])


def character_model(texts: DataFrame, text_column: str = "text") -> np.ndarray:
    """Costs (negative log probabilities) of a letter after two others, counted
    over every text: 27 x 27 x 27, boundary first. The counts are summed in Spark;
    the driver gets one row per trigram seen."""
    counts = mapped(texts.select(F.col(text_column).alias("text")), _trigram_counts, "code long, n long")
    table = np.zeros(_SIZE**3)
    for row in counts.groupBy("code").agg(F.sum("n").alias("n")).collect():
        table[row["code"]] = row["n"]
    table = table.reshape(_SIZE, _SIZE, _SIZE)
    single = (table.sum((0, 1)) + 1) / (table.sum() + _SIZE)
    double = (table.sum(0) + 20 * single) / (table.sum(0).sum(1, keepdims=True) + 20)
    triple = (table + 20 * double[None]) / (table.sum(2, keepdims=True) + 20)
    return -np.log(triple)


def _word_counts(batches):
    counts: Counter = Counter()

    def told():
        words: dict[str, int] = {}
        for token, n in counts.items():
            word = token if token.isalpha() else token.strip(_WORD_MARKS)
            if len(word) > 2 and word.isalpha():
                words[word] = words.get(word, 0) + n
        counts.clear()
        return pa.RecordBatch.from_arrays([pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], ["word", "n"])

    for part in slices(batches):
        for text in part.column(0).to_pylist():
            if text:
                counts.update(set(text.encode("utf-8", "replace").decode().lower().split()))
        if len(counts) > 200_000:
            yield told()
    yield told()


def word_counts(texts: DataFrame, text_column: str = "text") -> tuple[dict[str, int], int]:
    """In how many documents the MAX_WORDS most frequent words occur, and from what
    number on a word is taken for plain."""
    counts = mapped(texts.select(F.col(text_column).alias("text")), _word_counts, "word string, n long")
    kept = counts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= MIN_SEEN)
    rows = kept.orderBy(F.desc("n"), "word").limit(MAX_WORDS).collect()
    return {r["word"]: r["n"] for r in rows}, max(MIN_SEEN, int(texts.count() * OFTEN))


#: Lattices of at most so many paths are decoded path by path.
FEW_PATHS = 8
#: A way through one place of a lattice: symbol (-1: nothing is written), letter, cost.
Way = tuple[int, str, float]


@lru_cache(4096)
def _written(ch: str) -> tuple[int, list[Way]]:
    """Symbol of a character and the letters it may stand for."""
    own = _symbol(ch)
    ways: list[Way] = [(own, ch, 0.0)] if own else []
    return own, ways + [(ord(x) - 96, x, STAR if ch == "*" else SWAP) for x in LOOK_ALIKE.get(ch, "")]


def lattice(span: str, edges: tuple[int, int] = (0, 0)) -> list[list[Way]]:
    """The ways through each character of ``span`` (lower case); ``edges``: how many
    characters at its ends may be marks."""
    places, last, tail = [], "", len(span) - edges[1]
    long_runs = {k for m in _THRICE_RUN.finditer(span) for k in range(m.start() + 1, m.end())}
    for place, ch in enumerate(span):
        own, ways = _written(ch)
        edge = place < edges[0] or place >= tail
        if own and ch != last and not edge:
            # a letter as it is
            places.append(ways)
            last = ch
            continue
        if edge:
            skip = REPEAT if ch == last else NOISE if ch == "*" else OPENING if place < edges[0] and ch != "(" else EDGE
        elif ch in _APART:
            skip = APART
        elif own:
            skip = None if ch != last else REPEAT if place in long_runs else TWICE
        else:
            skip = DROP if ch in LOOK_ALIKE and ch != "*" else NOISE
        places.append(ways if skip is None else [(-1, "", skip), *ways])
        last = ch
    return places


def _path_by_path(places: list[list[Way]], costs: list[float]) -> str:
    """The likeliest letters of a lattice of few paths."""
    paths = [(0.0, 0, "")]  # cost, last two symbols, letters
    single: list[Way] = []  # places of one way, gone through together

    def along():
        letters = "".join([way[1] for way in single])
        for k, (cost, at, text) in enumerate(paths):
            for symbol, _, more in single:
                cost += more
                cost += costs[at * 27 + symbol]
                at = at % 27 * 27 + symbol
            paths[k] = cost, at, text + letters
        single.clear()

    for ways in places:
        if len(ways) == 1 and ways[0][0] >= 0:
            single.append(ways[0])
        else:
            along()
            paths = [
                (cost + more, at, text) if symbol < 0
                else (cost + more + costs[at * 27 + symbol], at % 27 * 27 + symbol, text + out)
                for symbol, out, more in ways for cost, at, text in paths
            ]
    along()
    return min((cost + costs[at * 27], k, text) for k, (cost, at, text) in enumerate(paths))[2]


def viterbi(span: str, costs: list[float], edges: tuple[int, int] = (0, 0), borders: bool = False) -> str:
    """The likeliest letters behind ``span`` (lower case). ``edges``: how many
    characters at its ends may be marks; ``borders``: spaces may part words."""
    places = lattice(span, edges)
    if not borders:
        count = 1
        for ways in places:
            count *= len(ways)
            if count > FEW_PATHS:
                break
        else:
            return _path_by_path(places, costs)
    states = {(0, 0): (0.0, None)}
    for ch, ways in zip(span, places):
        new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (cost, back) in states.items():
            at = a * 729 + b * 27
            if borders and ch == " " and b:
                total = cost + costs[at] + (ALONE if a == 0 and b in (1, 9) else BORDER)
                if total < new.get((0, 0), (np.inf,))[0]:
                    new[0, 0] = (total, (back, " "))
            for symbol, out, more in ways:
                if symbol < 0:
                    if cost + more < new.get((a, b), (np.inf,))[0]:
                        new[a, b] = (cost + more, back)
                    continue
                total = cost + more + costs[at + symbol]
                if total < new.get((b, symbol), (np.inf,))[0]:
                    new[b, symbol] = (total, (back, out))
        states = new
    (cost, back) = min(((c + costs[a * 729 + b * 27], p) for (a, b), (c, p) in states.items()), key=lambda x: x[0])
    letters = []
    while back:
        back, out = back
        letters.append(out)
    return "".join(reversed(letters))


class _Remembered(dict):
    """Values by token, made when first asked for; dropped together when too many."""

    def __init__(self, make, most: int = _CACHE_WORDS):
        self.make, self.most = make, most

    def __missing__(self, token):
        value = self.make(token)
        if len(self) >= self.most:
            self.clear()
        if len(token) <= _LONGEST:
            self[token] = value
        return value


def _alone(text: str) -> bool:
    """Whether three characters in a row stand alone."""
    return _ALONE.search(" " + text) is not None


def _doubled(word: str) -> bool:
    """Whether a word of letters alone has a letter twice in a row."""
    return True in map(eq, word, word[1:])


class Restorer:
    """Restores tokens and texts; remembers what it has decoded."""

    def __init__(
        self, costs: np.ndarray, seen: dict[str, int] | None = None, often: int = 1, most: int = _CACHE_WORDS
    ):
        self.costs = costs.ravel().tolist()
        letter, costs = np.arange(_SIZE), costs.reshape(_SIZE, _SIZE, _SIZE)
        # by the letter before a double one, the double one and the letter behind it
        kept = costs[:, letter, letter][:, :, None] + costs[letter, letter][None]
        self.drops = (TWICE + costs <= kept).tobytes()
        self.seen = seen or {}
        self.plain = {w for w, n in self.seen.items() if n >= often}
        self.known = _Remembered(self.decoded, most)

    def token(self, token: str) -> str:
        return self.known[token]

    def decoded(self, token: str) -> str:
        """Restored word of one lower-case token."""
        if token.isalpha() and not _doubled(token):
            return token
        core = token.strip(_WORD_MARKS)
        if not core:
            return core
        front = back = ""
        if not _SIGNS.isdisjoint(token):
            at = token.index(core)
            front = "".join([ch for ch in token[:at] if ch in LOOK_ALIKE])
            back = "".join([ch for ch in token[at + len(core):] if ch in LOOK_ALIKE])
        if core.isalpha():
            marked = front or back
            if not marked and not _doubled(core):
                return core
            if not _THRICE.search(core):
                if core in self.plain:
                    return core
                symbols = list(map(_OWN.get, core))
                if not marked and None not in symbols:
                    return self._undoubled(core, symbols)
        elif not any(ch.isalpha() for ch in core) and (_SIGNS.isdisjoint(core) or _NUMBER.fullmatch(core)):
            return core
        return viterbi(front + core + back, self.costs, (len(front), len(back)))

    def _undoubled(self, word: str, symbols: list[int]) -> str:
        """The likeliest path of a word of letters, none thrice in a row. Whether a double
        letter is kept or not, the next letter leads to the same state, so each is
        decided by itself."""
        before, symbols = [0, 0, *symbols], [*symbols, 0]
        return word[0] + "".join([
            ch for k, ch in enumerate(word[1:], 1)
            if ch != word[k - 1] or not self.drops[(before[k] * _SIZE + symbols[k]) * _SIZE + symbols[k + 1]]
        ])

    def _run(self, tokens: list[str]) -> list[list[str]]:
        """Readings of characters that stand alone, the best one first: as one word,
        with word borders, and with a leading "a" or "i" as a word."""
        span = " ".join(tokens)
        whole, parted = [viterbi(span, self.costs)], viterbi(span, self.costs, borders=True).split()
        found = [parted] if parted == whole else [whole, parted]
        if tokens[0] in ("a", "i") and len(tokens) > 3:
            rest = [tokens[0], viterbi(" ".join(tokens[1:]), self.costs)]
            found += [rest] if rest not in found else []
        good = [r for r in found if all(w in self.seen or w in ("a", "i") for w in r)]
        best = (good or [parted])[0]
        return [best] + [r for r in found if r != best]

    def readings(self, text: str) -> tuple[list[str], list[str]]:
        """All restored words of ``text``, letters set apart by spaces joined; and the
        words of the other readings of such letters."""
        text = text.lower()
        tokens = text.split()
        if not _alone(text):
            return list(map(self.known.__getitem__, tokens)), []
        spans = "".join(["1" if len(t) == 1 else "0" for t in tokens])
        out, others, at = [], [], 0
        for m in re.finditer("1{3,}", spans):
            run = tokens[m.start():m.end()]
            out += [self.token(t) for t in tokens[at:m.start()]]
            if len(run) > 3 or any(ch.isalpha() for ch in run):
                best, *rest = self._run(run)
                out += best
                others += [w for words in rest for w in words]
            else:
                out += [self.token(t) for t in run]
            at = m.end()
        return out + [self.token(t) for t in tokens[at:]], others

    def distinct(self, text: str) -> set[str]:
        """The different words of all readings."""
        text = text.lower()
        if _alone(text):
            return set().union(*self.readings(text))
        return set(map(self.known.__getitem__, set(text.split())))

    def words(self, text: str) -> list[str]:
        return self.readings(text)[0]

    def text(self, text: str) -> str:
        return " ".join(self.words(text))


def _term(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass"))


def _beginnings(word: str) -> tuple[int, ...]:
    """Hashes of the beginnings of four to six letters; the first six letters tell them."""
    return tuple([_term(x) for x in {word[:4] + "*", word[:5] + "*", word[:6] + "*"}])


def _term_rows(costs, seen, often):
    def run(batches):
        restorer, beginnings = Restorer(costs, seen, often), _Remembered(_beginnings)
        for part in slices(batches):
            words, terms = [0], []
            for text in part.column(2).to_pylist():
                terms += [(_term(w), *beginnings[w[:6]]) for w in restorer.distinct(text or "") if len(w) > 2]
                words.append(len(terms))
            sizes = np.cumsum([0, *map(len, terms)])
            by_word = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(chain.from_iterable(terms), pa.int64()))
            lists = pa.ListArray.from_arrays(pa.array(words, pa.int32()), by_word)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists], ["row", "label", "words"])
    return run


def _evidence(weights: list[float]) -> tuple[float, float, float, float]:
    """Of a text's word weights: the three largest, and how many are strong."""
    top = sorted(weights, reverse=True)[:3] + [0.0] * 3
    return (*top[:3], float(np.log1p(sum(w > 2 for w in weights))))


def _weight(good, bad, odds, strength=3.0):
    share = odds / (1 + odds)
    return np.log((bad + strength * share) / (good + strength * (1 - share)) / odds)


def _own_evidence(table: dict[int, tuple[int, int]], odds: float):
    """Evidence of labelled rows, without a row's own share in the counts."""
    known = np.array(sorted(table), np.int64)
    good, bad = np.array([table[t] for t in known.tolist()], np.int64).reshape(-1, 2).T
    weights = np.stack([
        _weight(np.maximum(good - (1 - label), 0), np.maximum(bad - label, 0), odds) for label in (0, 1)
    ])

    def run(batches):
        for part in slices(batches):
            labels, by_word = part.column(0).to_numpy(zero_copy_only=False), part.column(1).flatten()
            row = np.repeat(np.arange(part.num_rows), pc.list_value_length(part.column(1)).to_numpy(zero_copy_only=False))
            word = np.repeat(np.arange(len(by_word)), pc.list_value_length(by_word).to_numpy(zero_copy_only=False))
            terms = by_word.flatten().to_numpy(zero_copy_only=False)
            at = np.searchsorted(known, terms)
            hit = np.flatnonzero(known[np.minimum(at, len(known) - 1)] == terms) if len(known) else at[:0]
            best = np.zeros(len(by_word))
            np.maximum.at(best, word[hit], weights[labels[row[word[hit]]], at[hit]])
            strong = np.flatnonzero(best)
            cuts = np.searchsorted(row[strong], np.arange(1, part.num_rows))
            columns = np.array([_evidence(own.tolist()) for own in np.split(best[strong], cuts)]).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *[pa.array(columns[:, k]) for k in range(4)]], ["label", "a", "b", "c", "d"]
            )
    return run


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    """Newton steps of a penalised logistic regression; the last weight is the offset."""
    z = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    pull = penalty * np.eye(len(w))
    pull[-1, -1] = 1e-3
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + pull, z.T @ (y - p) - pull @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


class Model:
    """Character costs, term weights, the weights of the evidence, and how often words are seen."""

    def __init__(self, costs, terms: dict[int, float], final: np.ndarray, seen: dict[str, int], often: int):
        self.costs, self.terms, self.final, self.seen, self.often = costs, terms, final, seen, often


def fit(docs: DataFrame, labels: DataFrame, id_column: str, text_column: str, label_column: str) -> Model:
    """Learn from the given labelled rows (bounded by MAX_LABELLED) and all texts."""
    costs = character_model(docs, text_column)
    frequent, often = word_counts(docs, text_column)
    known = labels.filter(F.col(label_column).isin(0, 1) & F.col(id_column).isNotNull()).select(
        F.col(id_column).alias("row"), F.col(label_column).cast("int").alias("label")
    )
    share = min(1.0, MAX_LABELLED / max(1, known.count()))
    known = known.filter(F.pmod(F.xxhash64(F.lit(4), "row"), F.lit(1 << 40)) < int(share * (1 << 40)))
    # at most about MAX_LABELLED pairs of an id and a label, so this broadcast is bounded
    learned = docs.select(F.col(id_column).alias("row"), F.col(text_column).alias("text")).join(F.broadcast(known), "row")
    rows = saved(
        mapped(learned.select("row", "label", "text"), _term_rows(costs, frequent, often), "row long, label int, words array<array<long>>"),
        "toxic-terms",
    )
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("bad")).first()
    if not size["n"] or not size["bad"] or size["bad"] == size["n"]:
        level = 0.5 if not size["n"] else size["bad"] / size["n"]
        return Model(costs, {}, np.array([0, 0, 0, 0, np.log((level + 1e-3) / (1 - level + 1e-3))]), frequent, often)
    odds = size["bad"] / (size["n"] - size["bad"])
    seen = rows.select("label", F.explode(F.array_distinct(F.flatten("words"))).alias("term"))
    counts = seen.groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("bad"))
    strong = counts.filter((F.col("bad") >= 4) & (F.col("bad") > 3 * odds * (F.col("n") - F.col("bad"))))
    kept = strong.orderBy(F.desc(F.col("bad") / (F.col("n") - F.col("bad") + 3)), F.desc("n"), "term").limit(MAX_TERMS)
    table = {r["term"]: (r["n"] - r["bad"], r["bad"]) for r in kept.collect()}
    weights = {t: float(_weight(g, b, odds)) for t, (g, b) in table.items()}
    # bounded by MAX_LABELLED rows of five numbers
    found = mapped(rows.select("label", "words"), _own_evidence(table, odds), "label int, a double, b double, c double, d double").toPandas()
    x = found[["a", "b", "c", "d"]].to_numpy()
    return Model(costs, weights, logistic(x, found["label"].to_numpy(float)), frequent, often)


class Scorer:
    """Scores texts; remembers which tokens stand for words that weigh something, and
    with ``keep_words`` all restored words."""

    def __init__(self, model: Model, most: int = _CACHE_WORDS, keep_words: bool = False):
        self.model = model
        self.restorer = Restorer(model.costs, model.seen, model.often, most)
        self.decode = self.restorer.token if keep_words else self.restorer.decoded
        # most tokens stand for a word of no weight, and their words are not held
        self.found = _Remembered(self._found, 2 * most)
        self.beginnings = _Remembered(self._beginnings, most // 2)

    def _beginnings(self, word: str) -> float:
        return max([0.0, *[self.model.terms.get(t, 0.0) for t in _beginnings(word)]])

    def _weighed(self, word: str) -> tuple[str, float] | None:
        """A word and its weight, if it has any."""
        if len(word) < 3:
            return None
        weight = max(self.beginnings[word[:6]], self.model.terms.get(_term(word), 0.0))
        return (word, weight) if weight else None

    def _found(self, token: str) -> tuple[str, float] | None:
        return self._weighed(self.decode(token))

    def _weights(self, text: str) -> list[float]:
        """Weights of the different words of all readings that have any."""
        text = text.lower()
        if _alone(text):
            found = set(map(self._weighed, self.restorer.distinct(text)))
        else:
            found = set(map(self.found.__getitem__, set(text.split())))
        found.discard(None)
        return [weight for _, weight in found]

    def scores(self, texts: list[str | None]) -> np.ndarray:
        evidence = [_evidence(self._weights(t or "")) for t in texts]
        z = np.array(evidence).reshape(-1, 4) @ self.model.final[:4] + self.model.final[4]
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _scores(model: Model, keep_text: bool):
    def run(batches):
        scorer = Scorer(model, keep_words=keep_text)
        names = ["row", "score"] + ["restored"] * keep_text
        for part in slices(batches):
            texts = part.column(1).to_pylist()
            arrays = [part.column(0), pa.array(scorer.scores(texts))]
            if keep_text:
                arrays.append(pa.array([scorer.restorer.text(t or "") for t in texts], pa.string()))
            yield pa.RecordBatch.from_arrays(arrays, names)
    return run


def score(
    docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    label_column: str = "toxic", keep_text: bool = False,
) -> DataFrame:
    """doc_id, held_out, score, predicted (and ``restored`` if asked) of every row.

    Learned from labels whose crc32(id as text) mod 3 is not 1. A null text counts
    as empty; empty texts get the score of no evidence. A null id is never held out
    and never learned from. Labels that are null or not 0/1 are ignored, repeated
    rows count as often as they come. Without usable labels, or with one class
    only, every score is the class's share. Other columns are not read. An empty table
    gives an empty result.
    """
    rest = F.pmod(F.crc32(F.col(id_column).cast("string")), F.lit(3))
    model = fit(docs, labels.filter(rest != 1), id_column, text_column, label_column)
    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    out = mapped(source, _scores(model, keep_text), "doc_id long, score double" + ", restored string" * keep_text)
    return out.select(
        "doc_id",
        F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1, F.lit(False)).alias("held_out"),
        "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), *["restored"] * keep_text,
    )


def _clean(model: Model, columns: int):
    def run(batches):
        scorer = Scorer(model, _STAGE_WORDS)
        for part in slices(batches):
            got = scorer.scores(part.column(columns).to_pylist())
            yield part.filter(pa.array(got < THRESHOLD)).select(range(columns))
    return run


def drop_toxic(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows of ``docs`` scored below the threshold, all columns kept.

    Each row is scored by its own text, as in ``score``: a null text counts as empty,
    rows with null or repeated ids are kept or go each by itself, an empty table stays
    empty.
    """
    rest = F.pmod(F.crc32(F.col(id_column).cast("string")), F.lit(3))
    model = fit(docs, labels.filter(rest != 1), id_column, text_column, "toxic")
    with_text = docs.select("*", F.col(text_column).alias("__scored_text"))
    return mapped(with_text, _clean(model, len(docs.columns)), docs.schema)
