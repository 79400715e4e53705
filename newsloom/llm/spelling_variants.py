"""Words of a corpus, their near words (one inserted, deleted or replaced letter), and forms.

Near words are found in tries of all words, one trie for each word length and reading
direction, as a relational frontier: states (word, position, node, edits) are joined
with the distributed edge table of the tries, level by level; a state that ends in a
node of full depth with one edit is a pair of neighbours. An edit in the first half
of a word is found by reading the words backwards, so no state branches above the
middle of its word, where tries are dense. A state passes its first edit only if the
letter after it goes on in the trie as well. Words longer than LEVELS letters, if any,
are matched by hashes of the word with one letter left out, and verified.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import mapped, saved, slices

MIN_LETTERS, MIN_COUNT = 6, 5
#: A form occurs at least so many times as often as its variant.
FORM_TIMES = 5
#: One run in so many (by its hash) loses a letter before it is counted.
EDITED = 199
#: Longest words that go through the tries; the rest are matched by hashes.
LEVELS = 24
#: Levels between two written frontiers.
WRITTEN = 5
#: Words below one node that share a join key; more are salted.
NODE_WORDS = 20_000
#: Distinct words counted in a task before its counts go on.
HELD_WORDS = 100_000

_RUNS = re.compile(rb"[a-z\xc0-\xff]+").findall
_PLAIN = re.compile(r"[\x00-\x7f]*\Z").match


def _runs(edited: int, least: int):
    """Partial counts of the words of each batch of texts."""
    def counted(batches) -> Iterator[tuple[dict[bytes, int]]]:
        held: Counter[bytes] = Counter()
        for part in slices(batches):
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                if not text:
                    continue
                # the letters meant are those of Latin-1; bytes.lower() changes A-Z alone
                own = Counter(_RUNS(text.encode("latin-1", "replace").lower()))
                start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for run, n in own.items():
                    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
                    if edited and h % edited == 0:
                        at = h % len(run)
                        run = run[:at] + run[at + 1:]
                    if len(run) >= least:
                        held[run] += n
            if len(held) > HELD_WORDS:
                yield held
                held = Counter()
        yield held

    def run(batches):
        for held in counted(batches):
            yield pa.RecordBatch.from_pydict({
                "word": pa.array([w.decode("latin-1") for w in held], pa.string()), "n": pa.array(list(held.values()), pa.int64()),
            })
    return run


def words(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT, edited: int = EDITED,
) -> DataFrame:
    """(word, n): runs of Latin letters, A-Z in lower case, of at least ``min_letters``
    letters that occur ``min_count`` times or more; some runs lose a letter first."""
    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    partial = mapped(source, _runs(edited, min_letters), "word string, n long")
    return partial.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def _key(side, size, letters):
    """Name of a trie node: direction, word length, letters on the way to it."""
    return F.concat(side, F.lpad(size.cast("string"), 2, "0"), letters)


def _both_ways(listed: DataFrame) -> DataFrame:
    """Each word read forwards (f) and backwards (b) as ``s``, with its length."""
    ways = F.array(F.struct(F.lit("f").alias("side"), F.col("word").alias("s")), F.struct(F.lit("b").alias("side"), F.reverse("word").alias("s")))
    return listed.select("word", "n", F.length("word").alias("size"), F.inline(ways))


def edges(listed: DataFrame) -> DataFrame:
    """Edge table of all tries from their middle on: parent, letter, child, the letters
    that go on from the child, occurrences and words below the child."""
    middle = F.floor((F.col("size") - 1) / 2)
    steps = _both_ways(listed).withColumn("d", F.explode(F.sequence(middle, F.col("size") - 1)))
    cut = steps.select(
        _key(F.col("side"), F.col("size"), F.substring("s", F.lit(1), F.col("d"))).alias("parent"),
        F.substring("s", F.col("d") + 1, F.lit(1)).alias("letter"),
        F.substring("s", F.col("d") + 2, F.lit(1)).alias("next"), "n",
    )
    return cut.groupBy("parent", "letter").agg(
        F.array_join(F.collect_set("next"), "").alias("onward"),  # at most the 90 letters
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("words"),
    ).withColumn("child", F.concat("parent", "letter"))


def _starts(listed: DataFrame) -> DataFrame:
    """States without an edit yet, at every place from a word's middle on; target tries
    are those of the word's own length (a letter replaced) and the next (one inserted)."""
    half, size, forward = F.floor(F.col("size") / 2), F.col("size"), F.col("side") == "f"
    first = F.when(forward, half).otherwise(size - half).cast("int")
    inserted = F.when(forward, half).otherwise(size - half + 1).cast("int")
    places = F.array(
        F.struct(F.lit(0).alias("more"), F.sequence(first, size - 1).alias("places")),
        F.struct(F.lit(1).alias("more"), F.sequence(inserted, size).alias("places")),
    )
    out = _both_ways(listed).select("*", F.inline(places)).withColumn("at", F.explode("places"))
    return out.select(
        "word", F.col("n").alias("own"), "more",
        _key(F.col("side"), size + F.col("more"), F.substring("s", F.lit(1), F.col("at"))).alias("node"),
        F.substring("s", F.col("at") + 1, size).alias("rest"),
    )


def _salted(states: DataFrame, hot: DataFrame) -> DataFrame:
    """``salt``: states of a node with many words below it are dealt to several keys."""
    marked = states.join(hot, "node", "left")
    return marked.withColumn("salt", F.pmod(F.xxhash64("word"), F.coalesce("salts", F.lit(1)))).drop("salts")


def _sorted_join(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """Join of two tables that grow with the words; neither is sent to all tasks.

    Spark would send out a side whose files (compressed) or whose rows before an
    explode are small; in the driver's memory both are many times as large.
    """
    return left.join(right.hint("merge"), on, how)


def _first(rest: str):
    return F.substring(rest, 1, 1)


def _trie_pairs(listed: DataFrame, node_words: int) -> DataFrame:
    """(a, n_a, b, n_b) of near words of at most LEVELS letters; a pair may come twice."""
    table = saved(edges(listed), "trie-edges")
    sizes = table.groupBy("parent").agg(F.sum("words").alias("words")).filter(F.col("words") > node_words)
    hot = saved(
        sizes.select(F.col("parent").alias("node"), F.ceil(F.col("words") / node_words).alias("salts")), "hot-nodes"
    )
    salted = table.join(hot.withColumnRenamed("node", "parent"), "parent", "left").withColumn(
        "salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("salts", F.lit(1)) - 1))
    ).drop("salts", "words")
    table = saved(salted, "salted-edges")

    # the one edit, and a look at the letter behind it
    grown = table.withColumnRenamed("parent", "node").withColumnRenamed("n", "near_n")
    left = F.when(F.col("more") == 0, F.expr("substring(rest, 2)")).otherwise(F.col("rest"))
    # a pair of equal length is found from its lesser word; a letter is inserted behind its likes, not before
    edit = F.when(F.col("more") == 0, F.col("letter") > _first("rest")).otherwise(F.col("letter") != _first("rest"))
    states = (
        _sorted_join(_salted(_starts(listed), hot), grown, ["node", "salt"]).filter(edit)
        .select("word", "own", F.col("child").alias("node"), left.alias("rest"), "onward", "near_n")
        .filter((F.col("rest") == "") | F.col("onward").contains(_first("rest")))
        .drop("onward")
    )
    states = saved(states, "trie-states")
    ended = [states.filter("rest = ''")]
    states, level = states.filter("rest <> ''").drop("near_n"), 0
    while True:
        step = _salted(states, hot).withColumn("child", F.concat("node", _first("rest")))
        nodes = table.select("child", "salt", "onward", F.col("n").alias("near_n"))
        states = _sorted_join(step, nodes, ["child", "salt"]).select(
            "word", "own", F.col("child").alias("node"), F.expr("substring(rest, 2)").alias("rest"), "onward", "near_n"
        ).filter((F.col("rest") == "") | F.col("onward").contains(_first("rest"))).drop("onward")
        level += 1
        if level % WRITTEN == 0:
            states = saved(states, "trie-states")
            if states.isEmpty():
                break
        ended.append(states.filter("rest = ''"))
        states = states.filter("rest <> ''").drop("near_n")
    found = ended[0]
    for more in ended[1:]:
        found = found.unionByName(more)
    letters = F.expr("substring(node, 4)")
    near = F.when(F.col("node").startswith("f"), letters).otherwise(F.reverse(letters))
    return found.select(F.col("word").alias("a"), F.col("own").alias("n_a"), near.alias("b"), F.col("near_n").alias("n_b"))


_PRIME, _BASE = (1 << 61) - 1, 1_000_003


def _left_out(batches):
    """Hash of each word as it is (place -1) and without each of its letters."""
    for part in slices(batches):
        for word in part.column(0).to_pylist():
            size = len(word)
            front, back, power = [0] * (size + 1), [0] * (size + 1), [1] * (size + 1)
            for k, letter in enumerate(word):
                front[k + 1] = (front[k] * _BASE + ord(letter)) % _PRIME
                power[k + 1] = power[k] * _BASE % _PRIME
            for k in range(size - 1, -1, -1):
                back[k] = (ord(word[k]) * power[size - 1 - k] + back[k + 1]) % _PRIME
            hashes = [front[size]] + [(front[k] * power[size - 1 - k] + back[k + 1]) % _PRIME for k in range(size)]
            for k in range(0, size + 1, 10_000):
                own = hashes[k:k + 10_000]
                yield pa.RecordBatch.from_pydict({
                    "id": pa.array([zlib.crc32(word.encode()) << 31 | size] * len(own), pa.int64()),
                    "size": pa.array([size] * len(own), pa.int32()),
                    "place": pa.array(range(k - 1, k - 1 + len(own)), pa.int32()), "h": pa.array(own, pa.int64()),
                })


def _long_pairs(listed: DataFrame, levels: int) -> DataFrame:
    """(a, n_a, b, n_b) of near words of which one has more than ``levels`` letters."""
    long = saved(
        listed.filter(F.length("word") >= levels).withColumn(
            "id", F.shiftleft(F.crc32(F.encode("word", "utf-8")), 31).bitwiseOR(F.length("word").cast("long"))
        ), "long-words",
    )
    hashes = saved(mapped(long.select("word"), _left_out, "id long, size int, place int, h long"), "long-hashes")
    one, other = hashes.filter("place >= 0").alias("one"), hashes.alias("other")
    same = (F.col("one.size") == F.col("other.size")) & (F.col("one.place") == F.col("other.place")) & (F.col("one.id") < F.col("other.id"))
    shorter = (F.col("one.size") == F.col("other.size") + 1) & (F.col("other.place") == -1)
    met = _sorted_join(one, other, F.col("one.h") == F.col("other.h")).filter(same | shorter)
    ids = met.select(F.col("one.id").alias("id"), F.col("other.id").alias("id_b")).distinct()
    a = long.select("id", F.col("word").alias("a"), F.col("n").alias("n_a"))
    b = long.select(F.col("id").alias("id_b"), F.col("word").alias("b"), F.col("n").alias("n_b"))
    near = _sorted_join(_sorted_join(ids, a, "id"), b, "id_b").filter((F.length("a") > levels) | (F.length("b") > levels))
    return near.filter((F.col("a") != F.col("b")) & (F.levenshtein("a", "b", 1) == 1)).select("a", "n_a", "b", "n_b")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words with a form. Each step is to a word at least five times as
    frequent, so the number of rounds is below the logarithm of the largest count."""
    steps = forms.select(F.col("word").alias("last"), F.col("form").alias("further"))
    moving, done = forms.select("word", F.col("form").alias("last")), []
    while True:
        ahead = saved(_sorted_join(moving, steps, "last", "left").select("word", "last", "further"), "forms")
        done.append(ahead.filter("further IS NULL").select("word", F.col("last").alias("root")))
        moving = ahead.filter("further IS NOT NULL").select("word", F.col("further").alias("last"))
        if moving.isEmpty():
            break
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out


def near_pairs(listed: DataFrame, levels: int = LEVELS, node_words: int = NODE_WORDS) -> DataFrame:
    """(word, n, near, near_n), both ways, each pair of near words of ``listed`` (word, n) once."""
    pairs = _trie_pairs(listed.filter(F.length("word") <= levels), node_words).union(_long_pairs(listed, levels))
    names = ["word", "n", "near", "near_n"]
    return pairs.toDF(*names).union(pairs.select("b", "n_b", "a", "n_a").toDF(*names)).distinct()


def variants(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", levels: int = LEVELS, node_words: int = NODE_WORDS,
) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    A word's form is its near word of largest n (ties: the smallest by code points) if
    that occurs at least FORM_TIMES as often, else null; its root is where following
    forms ends. A null text has no words; a null id counts as the empty string where
    runs are hashed; rows that share an id or repeat are texts of their own. Other
    columns are not read. No text, or no frequent word, gives an empty result.
    """
    listed = saved(words(docs, id_column, text_column), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    grouped = near_pairs(listed, levels, node_words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    formed = saved(
        _sorted_join(listed, grouped, "word", "left")
        .withColumn("known", -F.col("best.less") >= FORM_TIMES * F.col("n"))
        .select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(F.col("known"), F.col("best.near")).alias("form"), F.when(F.col("known"), -F.col("best.less")).alias("form_n"),
        ),
        "word-forms",
    )
    roots = _roots(formed.filter("form IS NOT NULL").select("word", "form"))
    return _sorted_join(formed, roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
