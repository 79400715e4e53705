"""Queries on features: TF-IDF, topics, linguistic columns, embeddings."""

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from newsloom import constants as K
from newsloom.features import embeddings, linguistic, nmf, scaling, sentiment, tagger, tfidf
from newsloom.features.registry import EXTRA_COLUMNS, FEATURE_SETS, with_extra_columns
from newsloom.functions import text as X
from newsloom.operators import splits
from newsloom.plans import sql as Q
from newsloom.plans.registry import query
from newsloom.plans.tables import corpus, documents, labelled_keys, split_input, table
from newsloom.sources.scratch import stored

_STOPPED = f"list_filter({Q.tokens('text')}, lambda t: t NOT IN ({Q.strings(K.STOP_WORDS)}))"
_TERMS = "list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))"
# training rows: the folds other than the first
_TRAIN = f"(SELECT * FROM {Q.FOLDS} WHERE fold <> 0)"
_COUNTS = f"""(SELECT doc_id, fold, term, count(*) AS n FROM (SELECT doc_id, fold, unnest({_TERMS}) AS term
 FROM (SELECT doc_id, fold, {_STOPPED} AS t FROM {Q.FOLDS})) GROUP BY ALL)"""
_N = f"(SELECT count(*) FROM {_TRAIN})"
_VOCAB = f"""(SELECT term, CAST(sum(n) AS BIGINT) AS tf, count(*) AS df FROM {_COUNTS} WHERE fold <> 0 GROUP BY term
 HAVING count(*) BETWEEN 3 AND floor(0.85 * {_N}) ORDER BY tf DESC, term LIMIT {K.TFIDF_MAX_FEATURES})"""


def _folded_terms(spark, sf):
    folds = splits.stratified_folds(labelled_keys(spark, sf), "doc_id", "label")
    texts = table(spark, sf, "documents").select("doc_id", "text").join(folds, "doc_id")
    return tfidf.with_terms(split_input(texts)).drop("text")


def _train_terms(spark, sf):
    return _folded_terms(spark, sf).where("fold <> 0")


@query(
    "tfidf_tokens",
    f"SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest({_TERMS}) AS term FROM (SELECT doc_id, {_STOPPED} AS t FROM documents)) GROUP BY ALL",
)
def tfidf_tokens(spark, sf):
    docs = tfidf.with_terms(documents(spark, sf))
    return docs.select("doc_id", F.inline(X.term_counts("terms"))).withColumn("n", F.col("n").cast("long"))


@query("tfidf_vocab", f"SELECT term, tf, df FROM {_VOCAB}")
def tfidf_vocab(spark, sf):
    train = _train_terms(spark, sf)
    return tfidf.corpus_vocabulary(train, train.count())


@query("tfidf_df_idf", f"SELECT term, df, round(ln((1 + {_N}) / (1 + df)) + 1, 9) AS idf FROM {_VOCAB}")
def tfidf_df_idf(spark, sf):
    train = _train_terms(spark, sf)
    n = train.count()
    vocab = tfidf.corpus_vocabulary(train, n)
    return vocab.select("term", "df", F.round(tfidf.idf(n, F.col("df")), 9).alias("idf"))


@query(
    "tfidf_weights",
    f"""WITH w AS (SELECT doc_id, term, n * (ln((1 + {_N}) / (1 + df)) + 1) AS w FROM {_COUNTS} JOIN {_VOCAB} v USING (term))
 SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM w""",
)
def tfidf_weights(spark, sf):
    """Weights of all rows under the vocabulary of the training folds."""
    rows = stored(_folded_terms(spark, sf), "terms")  # read by the fit and again below
    model = tfidf.fit(rows.where("fold <> 0"))
    out = tfidf.long_form(model.transform(rows), model, "doc_id")
    return out.withColumn("weight", F.round("weight", 6))


def _topics(spark, sf):
    """Topics of all documents: vocabulary, vectors (stored), fitted topics."""
    rows = stored(tfidf.with_terms(documents(spark, sf)).drop("text"), "terms")
    model = tfidf.fit(rows)
    vectors = stored(model.transform(rows).select("doc_id", "tfidf"), "vectors")
    topics = nmf.fit(vectors, "doc_id", "tfidf", len(model.terms))
    return model, vectors, topics


@query("nmf_topics")
def nmf_topics(spark, sf):
    _, vectors, topics = _topics(spark, sf)
    weights = topics.transform(vectors, "doc_id")
    return weights.select("doc_id", F.posexplode(vector_to_array("topics")).alias("topic", "weight"))


@query("nmf_top_terms")
def nmf_top_terms(spark, sf):
    model, _, topics = _topics(spark, sf)
    rows = nmf.top_terms(topics, model.terms)
    return spark.createDataFrame(rows, "topic int, place int, term string, weight double")


@query("nmf_check", "SELECT TRUE AS nonnegative, TRUE AS loss_never_rises, TRUE AS stationary_or_at_limit")
def nmf_check(spark, sf):
    """What every solution must satisfy, whatever the start."""
    _, vectors, topics = _topics(spark, sf)
    falls = all(b <= a * (1 + 1e-9) for a, b in zip(topics.losses, topics.losses[1:]))
    still = topics.gradients[-1] <= 1e-4 * topics.first_gradient or len(topics.losses) == K.NMF_MAX_ITER
    weights = vector_to_array("topics")
    return topics.transform(vectors, "doc_id").agg(
        (F.min(F.array_min(weights)) >= 0).alias("_w")
    ).select(
        (F.col("_w") & F.lit(bool((topics.topics >= 0).all()))).alias("nonnegative"),
        F.lit(falls).alias("loss_never_rises"),
        F.lit(bool(still)).alias("stationary_or_at_limit"),
    )


# --- linguistic ------------------------------------------------------------------------

_MARKS = f"regexp_extract_all(lower({Q.strip('text')}), '{linguistic.TOKEN_OR_MARK.replace(chr(39), chr(39) * 2)}')"
_POS_CASE = f"""CASE WHEN regexp_matches(t, '^[^\\p{{L}}\\p{{N}}_]') THEN 'PUNCT'
 WHEN t IN ({Q.strings(K.AUXILIARIES)}) THEN 'AUX' WHEN t IN ({Q.strings(K.PRONOUNS)}) THEN 'PRON'
 WHEN t IN ({Q.strings(K.FUNCTION_WORDS)}) THEN 'X' WHEN t IN ({Q.strings(K.COMMON_ADVERBS)}) THEN 'ADV'
 WHEN t IN ({Q.strings(K.COMMON_ADJECTIVES)}) THEN 'ADJ' WHEN t IN ({Q.strings(K.COMMON_VERBS)}) THEN 'VERB'
 WHEN regexp_matches(t, '^\\p{{N}}') THEN 'NUM' WHEN regexp_matches(t, '{linguistic.ADVERB_ENDING}') THEN 'ADV'
 WHEN regexp_matches(t, '{linguistic.VERB_ENDING}') THEN 'VERB' WHEN regexp_matches(t, '{linguistic.ADJECTIVE_ENDING}') THEN 'ADJ'
 ELSE 'NOUN' END"""
_TAGGED = f"(SELECT doc_id, t, {_POS_CASE} AS pos FROM (SELECT doc_id, unnest({_MARKS}) AS t FROM documents))"
_SHARES = ", ".join(
    f"round(coalesce(count(*) FILTER (pos = '{p}') / nullif(count(*) FILTER (pos <> 'PUNCT'), 0), 0), 9) AS {c}"
    for p, c in zip(("NOUN", "VERB", "ADJ", "ADV", "PRON"), linguistic.POS_COLUMNS)
)


@query(
    "pos_ratios",
    f"SELECT doc_id, {_SHARES}, round(coalesce(count(*) FILTER (t IN ({Q.strings(K.MODALS)})) / nullif(count(*) FILTER (pos <> 'PUNCT'), 0), 0), 9) AS modal_ratio FROM {_TAGGED} GROUP BY doc_id",
)
def pos_ratios(spark, sf):
    out = linguistic.with_pos_ratios(documents(spark, sf)).drop("text")
    return out.withColumns({c: F.round(c, 9) for c in linguistic.POS_COLUMNS})


@query(
    "tag_counts",
    f"""SELECT t AS word, CASE WHEN prev IS NULL OR prev IN ({Q.strings(tagger.SENTENCE_MARKS)}) THEN 'START' ELSE prev_pos END AS before, pos AS tag, count(*) AS n
 FROM (SELECT t, pos, lag(t) OVER w AS prev, lag(pos) OVER w AS prev_pos
 FROM (SELECT doc_id, i, t, {_POS_CASE} AS pos FROM (SELECT doc_id, unnest(m) AS t, unnest(range(len(m))) AS i FROM (SELECT doc_id, {_MARKS} AS m FROM documents)))
 WINDOW w AS (PARTITION BY doc_id ORDER BY i)) GROUP BY ALL""",
)
def tag_counts(spark, sf):
    """What a tagger learns from: words with their tags and the tag ahead."""
    return tagger.tag_counts(documents(spark, sf), linguistic.tagged_tokens("text"))


@query("learned_pos_ratios")
def learned_pos_ratios(spark, sf):
    """The six ratios by a tagger learned from all documents, decoded sentence by sentence."""
    model = tagger.self_trained(documents(spark, sf))
    out = linguistic.with_pos_ratios(documents(spark, sf), tagger=tagger.tagged_by(model)).drop("text")
    return out.withColumns({c: F.round(c, 9) for c in linguistic.POS_COLUMNS})


_READ_COUNTS = """(SELECT doc_id, len(w) AS words, coalesce(list_sum(sy), 0) AS syl, len(list_filter(sy, lambda x: x >= 3)) AS long_words,
 greatest(len(regexp_extract_all(s, '[.!?]+')), 1) AS sent, len(regexp_extract_all(s, '[\\p{L}\\p{N}]')) AS letters
 FROM (SELECT doc_id, s, w, list_transform(w, lambda x: greatest(len(regexp_extract_all(x, '[aeiouy]+')), 1)) AS sy
 FROM (SELECT doc_id, s, regexp_extract_all(lower(s), '[\\p{L}\\p{N}_]+(?:[''’][\\p{L}]+)?') AS w FROM (SELECT doc_id, """ + Q.strip("text") + """ AS s FROM documents))))"""


_READ_SQL = f"""SELECT doc_id, round(206.835 - 1.015 * (words / sent) - 84.6 * (syl / words), 6) AS flesch_ease,
 round(0.39 * (words / sent) + 11.8 * (syl / words) - 15.59, 6) AS flesch_kincaid,
 round(0.4 * (words / sent + 100.0 * long_words / words), 6) AS gunning_fog,
 round(CASE WHEN sent >= 3 THEN 1.043 * sqrt(long_words * 30.0 / sent) + 3.1291 ELSE 0 END, 6) AS smog,
 round(4.71 * (letters / words) + 0.5 * (words / sent) - 21.43, 6) AS automated_readability,
 round(words / sent, 6) AS words_per_sentence FROM {_READ_COUNTS} WHERE words > 0"""


@query("readability", _READ_SQL)
def readability(spark, sf):
    out = linguistic.with_readability(documents(spark, sf))
    out = out.where(X.word_count("text") > 0).drop("text")
    return out.withColumns({c: F.round(c, 6) for c in linguistic.READABILITY_COLUMNS})


# --- sentiment ------------------------------------------------------------------------------
# The given texts hold few words of any published lexicon, so the queries use
# one derived from the data: words of the benchmark texts, valence by length.


def _lexicon(spark, sf):
    words = table(spark, sf, "benchmark").select(F.explode(X.tokens("text")).alias("token")).distinct()
    return words.select("token", ((F.length("token") % 7) - 3).cast("double").alias("valence")).where("valence <> 0")


_LEX = f"""(SELECT token, CAST(length(token) % 7 - 3 AS DOUBLE) AS valence FROM (SELECT DISTINCT unnest({Q.tokens('text')}) AS token FROM benchmark)
 WHERE length(token) % 7 - 3 <> 0)"""
_BARE = r"regexp_replace(w, '^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_]+$', '', 'g')"
_CAPS = r"(regexp_matches({x}, '\p{Lu}') AND NOT regexp_matches({x}, '\p{Ll}') AND length({x}) > 1)"


def _caps(x):
    return _CAPS.replace("{x}", x)


def _boost_sql(x):
    raw = f"(CASE WHEN lower({x}) IN ({Q.strings(K.BOOSTERS_UP)}) THEN 0.293 WHEN lower({x}) IN ({Q.strings(K.BOOSTERS_DOWN)}) THEN -0.293 ELSE 0.0 END)"
    return f"(CASE WHEN {raw} <> 0 AND {_caps(x)} AND mixed THEN {raw} + sign({raw}) * 0.733 ELSE {raw} END)"


def _neg_sql(x):
    return f"(CASE WHEN replace(lower({x}), '''', '') IN ({Q.strings(K.NEGATIONS)}) OR contains(lower({x}), 'n''t') THEN 1 ELSE 0 END)"


def _sentiment_sql(text):
    return f"""WITH d AS (SELECT doc_id, s, list_filter(list_transform({Q.words('s')}, lambda w: {_BARE}), lambda w: length(w) > 1) AS ws
  FROM (SELECT doc_id, {text} AS s FROM (SELECT doc_id, {Q.strip('text')} AS text FROM documents))),
 m AS (SELECT doc_id, ws, len(list_filter(ws, lambda x: {_caps('x')})) BETWEEN 1 AND len(ws) - 1 AS mixed,
  coalesce(list_position(list_transform(ws, lambda x: lower(x)), 'but'), 0) AS but FROM d),
 e AS (SELECT doc_id, mixed, but, i, ws[i] AS w, CASE WHEN i > 1 THEN ws[i - 1] ELSE '' END AS w1, CASE WHEN i > 2 THEN ws[i - 2] ELSE '' END AS w2,
  CASE WHEN i > 3 THEN ws[i - 3] ELSE '' END AS w3 FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS i FROM m)),
 v AS (SELECT doc_id, (valence + sign(valence) * ((CASE WHEN {_caps('w')} AND mixed THEN 0.733 ELSE 0.0 END)
   + CAST({_boost_sql('w1')} AS DOUBLE) * 1.0 + CAST({_boost_sql('w2')} AS DOUBLE) * 0.95 + CAST({_boost_sql('w3')} AS DOUBLE) * 0.9))
   * pow(-0.74, {_neg_sql('w1')} + {_neg_sql('w2')} + {_neg_sql('w3')})
   * CASE WHEN but = 0 OR i = but THEN 1.0 WHEN i < but THEN 0.5 ELSE 1.5 END AS x
  FROM e JOIN {_LEX} l ON l.token = lower(e.w)),
 a AS (SELECT doc_id, sum(x) AS total, sum(CASE WHEN x > 0 THEN x + 1 ELSE 0 END) AS up, sum(CASE WHEN x < 0 THEN x - 1 ELSE 0 END) AS down,
  count(*) FILTER (x <> 0) AS hits FROM v GROUP BY doc_id),
 b AS (SELECT d.doc_id, len(ws) AS n, coalesce(total, 0) AS total, coalesce(up, 0) AS up, coalesce(down, 0) AS down, coalesce(hits, 0) AS hits,
  least(len(regexp_extract_all(s, '!')), 4) * 0.292 + (CASE WHEN len(regexp_extract_all(s, '\\?')) > 3 THEN 0.96
   WHEN len(regexp_extract_all(s, '\\?')) > 1 THEN len(regexp_extract_all(s, '\\?')) * 0.18 ELSE 0 END) AS emph FROM d LEFT JOIN a USING (doc_id)),
 p AS (SELECT doc_id, total + sign(total) * emph AS t, CASE WHEN up > -down THEN up + emph ELSE up END AS u,
  -(CASE WHEN up < -down THEN down - emph ELSE down END) AS dn, n - hits AS o FROM b)
 SELECT doc_id, round(coalesce(dn / nullif(u + dn + o, 0), 0), 6) AS neg, round(coalesce(o / nullif(u + dn + o, 0), 0), 6) AS neu,
 round(coalesce(u / nullif(u + dn + o, 0), 0), 6) AS pos, round(t / sqrt(t * t + 15), 6) AS compound FROM p"""


def _sentiment(spark, sf, max_chars):
    docs = documents(spark, sf)
    out = sentiment.lexicon_sentiment(docs, "doc_id", lexicon=_lexicon(spark, sf), max_chars=max_chars)
    return out.withColumns({c: F.round(c, 6) for c in sentiment.SENTIMENT_COLUMNS})


@query("lexicon_sentiment", _sentiment_sql("left(text, 1000)"))
def lexicon_sentiment(spark, sf):
    """The score as articles are described by it: the opening 1000 characters
    are the feature's definition."""
    return _sentiment(spark, sf, K.SENTIMENT_CHARS)


@query("lexicon_sentiment_whole_text", _sentiment_sql("text"))
def lexicon_sentiment_whole_text(spark, sf):
    return _sentiment(spark, sf, None)


# --- scaled and full features -----------------------------------------------------------------

_SCALED = ("n_chars", "n_words", "quality")
_NUMBERS = f"(SELECT d.doc_id, n_chars, {Q.n_words('text')} AS n_words, quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"
_FIT = f"(SELECT {', '.join(f'avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}' for c in _SCALED)} FROM {_NUMBERS} WHERE doc_id % 5 <> 0)"


@query(
    "scaled_features",
    f"SELECT doc_id, {', '.join(f'round(({c} - m_{c}) / s_{c}, 6) AS {c}' for c in _SCALED)} FROM {_NUMBERS}, {_FIT}",
)
def scaled_features(spark, sf):
    """All rows scaled by what the training rows (four in five) look like."""
    docs = table(spark, sf, "documents").select("doc_id", "n_chars", X.word_count("text").alias("n_words"))
    rows = docs.join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id")
    scaler = scaling.fit_scaler(rows.where("doc_id % 5 <> 0"), _SCALED)
    return scaling.scale(rows, scaler).withColumns({c: F.round(c, 6) for c in _SCALED})


_DEFAULT_LEX = "(SELECT * FROM (VALUES " + ", ".join(f"('{w}', CAST({v} AS DOUBLE))" for w, v in K.DEFAULT_VALENCE.items()) + ") x(token, valence))"
_POS_SQL = f"SELECT doc_id, {_SHARES}, round(coalesce(count(*) FILTER (t IN ({Q.strings(K.MODALS)})) / nullif(count(*) FILTER (pos <> 'PUNCT'), 0), 0), 9) AS modal_ratio FROM {_TAGGED} GROUP BY doc_id"
_EXTRA_SQL = (
    "SELECT doc_id, " + ", ".join(f"round(coalesce({c}, 0), 6) AS {c}" for c in EXTRA_COLUMNS)
    + f" FROM documents LEFT JOIN ({_POS_SQL}) p USING (doc_id) LEFT JOIN ({_READ_SQL}) r USING (doc_id) LEFT JOIN ("
    + _sentiment_sql("text").replace(_LEX, _DEFAULT_LEX) + ") s USING (doc_id)"
)


@query("extra_columns", _EXTRA_SQL)
def extra_columns(spark, sf):
    docs = documents(spark, sf)
    out = with_extra_columns(docs, "doc_id").drop("text")
    return out.withColumns({c: F.round(c, 6) for c in EXTRA_COLUMNS})


@query("full_features")
def full_features(spark, sf):
    """Size, entries and norm of each document's full vector."""
    features = FEATURE_SETS["full"]
    rows = stored(features.prepare(corpus(spark, sf).select("doc_id", "text", "label"), "doc_id"), "prepared")
    vectors = features.fit(rows, "doc_id", rows.count())(rows)
    v = F.unwrap_udt("features")
    filled = F.aggregate(v["values"], F.lit(0.0), lambda a, x: a + x * x)
    return vectors.select("doc_id", "label", F.size(v["values"]).alias("n_entries"), F.sqrt(filled).alias("norm"))


# --- embeddings ----------------------------------------------------------------------------------


# (doc_id, chunk, dim, v): signed counts of the tokens of each chunk of words
_CODED = f"""(SELECT doc_id, chunk, chunks, CAST(code % {K.EMBEDDING_DIM} AS INT) AS dim, CAST(sum(CASE WHEN code >= 2147483648 THEN -1 ELSE 1 END) AS DOUBLE) AS v
 FROM (SELECT doc_id, chunk, chunks, CAST('0x' || substr(md5(token), 1, 8) AS BIGINT) AS code FROM
  (SELECT doc_id, (i - 1) // {{size}} AS chunk, ceil(n / {{size}}) AS chunks, unnest({Q.tokens('w')}) AS token FROM
   (SELECT doc_id, len(ws) AS n, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM (SELECT doc_id, {Q.words('text')} AS ws FROM documents)))) GROUP BY ALL)"""
_EMBEDDED = """SELECT doc_id, dim, value FROM (SELECT doc_id, dim, round(sum(v / norm) / max(chunks), 6) AS value FROM
 (SELECT *, sqrt(sum(v * v) OVER (PARTITION BY doc_id, chunk)) AS norm FROM {coded}) WHERE norm > 0 GROUP BY doc_id, dim) WHERE value <> 0"""


def _places(vectors):
    """Entries of each vector that are not zero."""
    # outer: no filter on the whole expression is inferred, which would compute it twice and below the split
    long = vectors.select("doc_id", F.posexplode_outer("embedding").alias("dim", "value"))
    return long.withColumn("value", F.round("value", 6)).where("value <> 0")


@query("doc_embeddings", _EMBEDDED.replace("{coded}", _CODED.replace("{size}", "1000000000").replace("ceil(n / 1000000000)", "1")))
def doc_embeddings(spark, sf):
    return _places(embeddings.document_embeddings(documents(spark, sf), "doc_id"))


@query("chunk_embeddings", _EMBEDDED.replace("{coded}", _CODED.replace("{size}", str(K.CHUNK_WORDS))))
def chunk_embeddings(spark, sf):
    return _places(embeddings.document_embeddings(documents(spark, sf), "doc_id", chunked=True))


@query(
    "mean_pool",
    "SELECT label, CAST(i - 1 AS INT) AS dim, round(avg(CAST(embedding[i] AS DOUBLE)), 6) AS value FROM (SELECT label, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY ALL",
)
def mean_pool(spark, sf):
    pooled = embeddings.mean_pool(table(spark, sf, "embeddings"), "label")
    return pooled.withColumn("value", F.round("value", 6))


