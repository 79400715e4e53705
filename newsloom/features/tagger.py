"""A part-of-speech tagger learned from tagged text: words, endings and neighbours.

Training counts (word, tag before, tag) in one aggregation over the tagged corpus; what
the model keeps of it has a bound. Tagging decodes the most likely tags of a whole
sentence (Viterbi), all sentences of an Arrow batch step by step together. Words the
model doesn't hold are judged by the longest ending it does, then by their neighbours.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.features.linguistic import TOKEN_OR_MARK, tagged_tokens
from newsloom.functions import text as X

START = "START"
SENTENCE_MARKS = (".", "!", "?")
#: Words and endings a model keeps, the most frequent; others go by shorter endings.
MAX_WORDS = 100_000
MAX_ENDINGS = 30_000
ENDING_CHARS = 3
#: Weight, in occurrences, of what is known without the word.
PRIOR = 0.5
#: Sentences decoded together.
SENTENCES = 4096
#: Tokens of the rows tagged at once inside a task.
SLICE_TOKENS = 200_000
UNSEEN = "\u0000"  # stands before an ending, so that it is no word


def tag_counts(df: DataFrame, tagged: Column) -> DataFrame:
    """(word, before, tag, n): how often a word has a tag, by the tag ahead of it.

    ``tagged`` is an array of (pos, lemma, ...) per row; sentences end at . ! or ?. One
    shuffle, of partial counts.
    """
    def triple(t: Column, i: Column) -> Column:
        ahead = F.get(F.col("_t"), i - 1)
        first = ahead.isNull() | ahead["lemma"].isin(*SENTENCE_MARKS)
        return F.struct(
            t["lemma"].alias("word"), F.when(first, START).otherwise(ahead["pos"]).alias("before"), t["pos"].alias("tag")
        )

    staged = df.select(tagged.alias("_t"))
    rows = staged.select(F.explode(F.transform("_t", triple)).alias("e")).select("e.*")
    return rows.groupBy("word", "before", "tag").agg(F.count(F.lit(1)).alias("n"))


def kind(word: str) -> str:
    """What an unknown token is at the least: a mark, a number, or a word."""
    if word[:1].isdecimal():
        return UNSEEN + "0"
    return UNSEEN if word[:1].isalpha() or word[:1] == "_" else UNSEEN + "."


def endings(word: str) -> list[str]:
    """Keys an unknown token is looked up by, the longest ending first."""
    own = kind(word)
    if own != UNSEEN:
        return [own]
    return [UNSEEN + word[-k:] for k in range(min(ENDING_CHARS, len(word) - 1), 0, -1)] + [UNSEEN]


@dataclass(frozen=True)
class TagModel:
    """Tags, log chances of a tag after another (last row: at the start), and for each
    word or ending how much likelier than usual it makes each tag (logs)."""

    tags: tuple[str, ...]
    after: np.ndarray
    evidence: dict[str, np.ndarray]

    def of(self, word: str) -> np.ndarray:
        found = self.evidence.get(word)
        if found is None:
            found = next((self.evidence[e] for e in endings(word) if e in self.evidence), None)
        return np.zeros(len(self.tags)) if found is None else found


def model_from_counts(transitions: Iterable[tuple], evidence: Iterable[tuple]) -> TagModel:
    """A model from plain tables: (before, tag, n) and (word or ending key, tag, n)."""
    transitions, evidence = list(transitions), list(evidence)
    tags = tuple(sorted({t for _, t, _ in transitions}))
    place = {t: k for k, t in enumerate(tags)}
    moves = np.zeros((len(tags) + 1, len(tags)))
    for before, tag, n in transitions:
        moves[place.get(before, len(tags)), place[tag]] += n
    usual = moves.sum(axis=0) + PRIOR
    usual /= usual.sum()
    moves = (moves + PRIOR * usual) / (moves.sum(axis=1, keepdims=True) + PRIOR)
    seen: dict[str, np.ndarray] = {}
    for word, tag, n in evidence:
        seen.setdefault(word, np.zeros(len(tags)))[place[tag]] += n
    weights = {w: np.log((c + PRIOR * usual) / (c.sum() + PRIOR) / usual) for w, c in seen.items()}
    return TagModel(tags, np.log(moves), weights)


def fit_tagger(counts: DataFrame, max_words: int = MAX_WORDS, max_endings: int = MAX_ENDINGS) -> TagModel:
    """The model of ``tag_counts``: the ``max_words`` most frequent words, the
    ``max_endings`` most frequent endings (counted over all words), all transitions.

    An empty table gives a model without tags, which tags nothing."""
    def table(rows: DataFrame, most: int) -> list[tuple]:
        totals = rows.groupBy("word").agg(F.sum("n").alias("all"))
        kept = totals.orderBy(F.desc("all"), "word").limit(most).select("word")
        found = rows.join(kept, "word").groupBy("word", "tag").agg(F.sum("n").alias("n"))
        return [(r["word"], r["tag"], r["n"]) for r in found.collect()]

    # the same keys as ``endings``: letters by their ends, numbers and marks by kind
    word = F.col("word")
    ends = F.filter(
        F.array(*[F.when(F.length(word) > k, F.right(word, F.lit(k))) for k in range(1, ENDING_CHARS + 1)], F.lit("")),
        lambda e: e.isNotNull(),
    )
    keys = F.when(word.rlike(r"^\p{Nd}"), F.array(F.lit("0"))).when(word.rlike(r"^[\p{L}_]"), ends).otherwise(F.array(F.lit(".")))
    by_end = counts.select(F.explode(keys).alias("end"), "tag", "n").select(
        F.concat(F.lit(UNSEEN), "end").alias("word"), "tag", "n"
    ).groupBy("word", "tag").agg(F.sum("n").alias("n"))
    moves = counts.groupBy("before", "tag").agg(F.sum("n").alias("n"))
    transitions = [(r["before"], r["tag"], r["n"]) for r in moves.collect()]
    return model_from_counts(transitions, table(counts, max_words) + table(by_end, max_endings))


def decode(sentences: list[np.ndarray], evidence: np.ndarray, after: np.ndarray) -> list[np.ndarray]:
    """The most likely tag numbers of each sentence (row numbers of ``evidence``, which
    holds a row of logs per distinct token); ties go to the tag that comes first."""
    order = sorted(range(len(sentences)), key=lambda s: -len(sentences[s]))
    out: list[np.ndarray] = [np.zeros(0, int)] * len(sentences)
    for begin in range(0, len(order), SENTENCES):
        group = order[begin : begin + SENTENCES]
        sizes = np.array([len(sentences[s]) for s in group])
        score = np.zeros((len(group), after.shape[1]))
        back = [None]
        for step in range(int(sizes[0])):
            live = int(np.searchsorted(-sizes, -step, "left"))  # sentences longer than step
            seen = evidence[[sentences[s][step] for s in group[:live]]]
            if step == 0:
                score[:live] = after[-1] + seen
                continue
            ways = score[:live, :, None] + after[None, :-1, :]
            best = ways.argmax(axis=1)
            score[:live] = np.take_along_axis(ways, best[:, None, :], 1)[:, 0, :] + seen
            back.append(best.astype(np.int16))
        for k, s in enumerate(group):
            path = np.zeros(sizes[k], int)
            if sizes[k]:
                path[-1] = score[k].argmax()
                for step in range(int(sizes[k]) - 1, 0, -1):
                    path[step - 1] = back[step][k, path[step]]
            out[s] = path
    return out


def tag_rows(rows: list[list[str] | None], model: TagModel) -> list[list[str] | None]:
    """Tags of each row's tokens; a row of null stays null."""
    if not model.tags:
        return [None if row is None else ["X"] * len(row) for row in rows]
    places: dict[str, int] = {}
    sentences, owners = [], []
    for r, row in enumerate(rows):
        codes = np.array([places.setdefault(w, len(places)) for w in row or ()], int)
        ends = [i + 1 for i, w in enumerate(row or ()) if w in SENTENCE_MARKS or i == len(row) - 1]
        for begin, end in zip([0, *ends], ends):
            sentences.append(codes[begin:end])
            owners.append(r)
    out: list[list[str] | None] = [None if row is None else [] for row in rows]
    if sentences:
        evidence = np.array([model.of(w) for w in places])
        for r, path in zip(owners, decode(sentences, evidence, model.after)):
            out[r].extend(model.tags[k] for k in path)
    return out


def _slices(rows: list, most: int = SLICE_TOKENS):
    """Rows in runs of about ``most`` tokens, one row at least."""
    begin = total = 0
    for i, row in enumerate(rows):
        if i > begin and total + len(row or ()) > most:
            yield rows[begin:i]
            begin, total = i, 0
        total += len(row or ())
    yield rows[begin:]


def tagged_by(model: TagModel) -> Callable[[Column | str], Column]:
    """A tagger as ``pos_ratios`` takes one: text -> array of (pos, lemma, is_punct, is_space)."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def tags_of(tokens: pd.Series) -> pd.Series:
        rows = [None if t is None else list(t) for t in tokens]
        return pd.Series([tags for part in _slices(rows) for tags in tag_rows(part, model)], dtype=object)

    def tag(text: Column | str) -> Column:
        toks = F.regexp_extract_all(F.lower(X.normalize_string(text)), F.lit(f"({TOKEN_OR_MARK})"), F.lit(1))
        return F.zip_with(
            toks, tags_of(toks),
            lambda t, pos: F.struct(
                pos.alias("pos"), t.alias("lemma"), (pos == "PUNCT").alias("is_punct"), F.lit(False).alias("is_space")
            ),
        )

    return tag


def self_trained(df: DataFrame, text_col: str = "text") -> TagModel:
    """A model learned from the rule tagger's own tags: context corrects its endings."""
    from newsloom.sources.scratch import stored

    return fit_tagger(stored(tag_counts(df, tagged_tokens(text_col)), "tag-counts"))
