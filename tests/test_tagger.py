import itertools

import numpy as np
import pytest

from newsloom.features import linguistic, tagger as G


def best_by_trying(evidence, after):
    """Largest score over all tag sequences of one sentence."""
    n = after.shape[1]
    def score(path):
        moves = after[-1, path[0]] + sum(after[a, b] for a, b in zip(path, path[1:]))
        return moves + sum(evidence[i, t] for i, t in enumerate(path))
    return max(score(p) for p in itertools.product(range(n), repeat=len(evidence))), score


def test_decode_against_all_sequences():
    random = np.random.default_rng(4)
    after = np.log(random.dirichlet(np.ones(3), 4))
    evidence = np.log(random.random((6, 3)))
    sentences = [random.integers(0, 6, n) for n in (1, 5, 0, 3, 6, 2, 5)]
    for codes, path in zip(sentences, G.decode(sentences, evidence, after)):
        assert len(path) == len(codes)
        if len(codes):
            best, score = best_by_trying(evidence[codes], after)
            assert score(path.tolist()) == pytest.approx(best)


def test_context_decides_and_unknown_words_go_by_endings():
    moves = [("START", "DET", 50), ("DET", "NOUN", 45), ("DET", "ADJ", 5), ("ADJ", "NOUN", 5), ("NOUN", "VERB", 40),
             ("VERB", "DET", 30), ("START", "PRON", 30), ("PRON", "VERB", 30), ("VERB", "PUNCT", 40), ("NOUN", "PUNCT", 10)]
    words = [("the", "DET", 80), ("we", "PRON", 30), ("run", "NOUN", 20), ("run", "VERB", 20), (".", "PUNCT", 50),
             (G.UNSEEN + "ing", "VERB", 30), (G.UNSEEN + "er", "NOUN", 20), (G.UNSEEN, "NOUN", 5), (G.UNSEEN + "0", "NOUN", 3)]
    model = G.model_from_counts(moves, words)
    got = G.tag_rows([["the", "run", ".", "we", "run", "."], ["the", "zaper"], [], None, ["we", "zaping", "."]], model)
    assert got == [["DET", "NOUN", "PUNCT", "PRON", "VERB", "PUNCT"], ["DET", "NOUN"], [], None, ["PRON", "VERB", "PUNCT"]]
    assert G.endings("ab") == [G.UNSEEN + "b", G.UNSEEN] and G.endings("7a") == [G.UNSEEN + "0"] and G.endings("?!") == [G.UNSEEN + "."]
    assert G.tag_rows([["a"], None], G.model_from_counts([], [])) == [["X"], None]


def test_slices_hold_every_row():
    rows = [["a"] * n for n in (3, 9, 0, 4, 4)] + [None]
    parts = list(G._slices(rows, 8))
    assert [r for p in parts for r in p] == rows and len(parts) > 2


def test_learned_from_rules(spark):
    texts = ["She quickly painted good houses, we must go.", "We painted the house. She must go!", " ", None, "zz 77 must"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    counts = {(r.word, r.before, r.tag): r.n for r in G.tag_counts(df, linguistic.tagged_tokens("text")).collect()}
    assert counts[("she", "START", "PRON")] == 2 and counts[("painted", "PRON", "VERB")] == 1
    assert counts[("must", "NUM", "AUX")] == 1 and sum(counts.values()) == 22
    model = G.self_trained(df)
    assert set(model.tags) == {t for _, _, t in counts}
    rules = {r.doc_id: r for r in linguistic.with_pos_ratios(df).collect()}
    learned = {r.doc_id: r for r in linguistic.with_pos_ratios(df, tagger=G.tagged_by(model)).collect()}
    for i in (0, 1, 2, 3):
        assert [learned[i][c] for c in linguistic.POS_COLUMNS] == pytest.approx([rules[i][c] for c in linguistic.POS_COLUMNS])
    few = G.fit_tagger(G.tag_counts(df, linguistic.tagged_tokens("text")), max_words=2, max_endings=4)
    assert len(few.evidence) == 6
    empty = G.fit_tagger(G.tag_counts(df.limit(0), linguistic.tagged_tokens("text")))
    assert empty.tags == ()
