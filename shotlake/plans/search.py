"""Queries of keyword, vector and hybrid search, over documents, benchmark and embeddings."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shotlake.operators import engine, hybrid, index, keyword, vector
from shotlake.operators.stem import stems
from shotlake.sources import adapter
from shotlake.sources.adapter import oracle, read
from shotlake.sources.stages import keep

COLUMNS = {"text": 1.0, "concept": 0.6}


def docs(spark: SparkSession, d: str) -> DataFrame:
    """Documents with their concept column: language and source."""
    return read(spark, d, "documents").withColumn("concept", F.concat_ws(" ", "lang", "source"))


def terms(spark: SparkSession, d: str) -> DataFrame:
    """(query_id, term): the words of each benchmark item as they stand in the index."""
    words = F.explode(keyword.query_tokens(F.col("text")))
    return read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), words.alias("w")).select("query_id", F.explode(keyword.index_tokens(F.col("w"))).alias("term")).distinct()


def d1_query_tokens(spark, d):
    return read(spark, d, "benchmark").select("item_id", F.posexplode(keyword.query_tokens(F.col("text"))).alias("pos", "word"))


#: The indexes of a session by the folder and files they were made from.
_BUILT: dict = {}


def _index(spark: SparkSession, d: str) -> index.Index:
    """The documents' index, made once for a session and a state of the table's files."""
    m = F.col("_metadata")
    files = read(spark, d, "documents").select(m["file_path"].alias("p"), m["file_size"].alias("s"), m["file_modification_time"].alias("t"))
    state = files.agg(F.sum(F.xxhash64("p", "s", "t").cast("decimal(38,0)")), F.count("*")).first()
    key = spark.sparkContext.applicationId, d, tuple(state)
    if key not in _BUILT or not index.written(_BUILT[key]):
        _BUILT[key] = index.build(docs(spark, d), "doc_id", COLUMNS)
    return _BUILT[key]


def d2_stems(spark, d):
    """Each term of the index with its stem."""
    terms = docs(spark, d).select(F.explode(keyword.index_tokens(F.concat_ws(" ", *COLUMNS))).alias("term")).distinct()
    return terms.select("term", stems(F.array("term"))[0].alias("stem"))


def d3_postings(spark, d):
    return _index(spark, d).postings.groupBy(F.col("word").alias("term")).agg(F.count("*").alias("df"), F.round(F.sum("tf"), 4).alias("tf"), F.max("in_first").alias("in_text"))


def d5_vocabulary(spark, d):
    return _index(spark, d).vocabulary()


def _bm25(spark, d, lengths, posts, q):
    allowed = read(spark, d, "documents").filter(F.col("lang").isin("en", "fr")).select(F.col("doc_id").alias("doc"))
    return keyword.bm25(q, posts, lengths, 10, allowed)


def d6_bm25_topk(spark, d):
    built, q = _index(spark, d), terms(spark, d)
    return _bm25(spark, d, built.lengths, built.of(q, False), q).select(F.col("query_id").alias("item_id"), "rank", F.col("doc").alias("doc_id"), "score")


def d7_coverage(spark, d):
    """How much of its query each of the best documents covers."""
    built, q = _index(spark, d), terms(spark, d)
    posts = keep(built.of(q, False), "postings")
    return keyword.coverage(q, _bm25(spark, d, built.lengths, posts, q).select("query_id", "doc"), posts, built.lengths.count())


def d8_max_edits(spark, d):
    return read(spark, d, "part").select("p_partkey", F.explode(F.split("p_name", " ")).alias("word")).select("word", keyword.max_edits(F.col("word")).alias("edits")).groupBy("word", "edits").agg(F.count("*").alias("n"))


def _part_words(spark, d):
    return read(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("word"))


def d9_distances(spark, d):
    """Part names' words against each other with two letters swapped."""
    words = _part_words(spark, d).distinct()
    swapped = words.select(F.concat(F.substring("word", 1, 1), F.substring("word", 3, 1), F.substring("word", 2, 1), F.substring("word", 4, 50)).alias("a"), F.substring("word", 1, 1).alias("k"))
    pairs = swapped.join(words.select(F.col("word").alias("b"), F.substring("word", 1, 1).alias("k")), "k").select("a", "b")
    return keyword.distances(pairs, 2)


def d10_corrections(spark, d):
    """Misspelt part names (a letter left out) against their vocabulary."""
    words = _part_words(spark, d)
    vocab = words.groupBy("word").agg(F.count("*").alias("n"))
    typed = words.distinct().select(F.concat(F.substring("word", 1, 1), F.substring("word", 3, 50)).alias("word"))
    return keyword.corrections(typed, vocab)


def d11_known_words(spark, d):
    return keyword.inflections(_part_words(spark, d))


def _misspelt(spark, d):
    """Part names as queries: the first word lacks a letter in every other one."""
    first, rest = F.split("p_name", " ")[0], F.expr("substring(p_name, instr(p_name, ' '), 200)")
    return read(spark, d, "part").select(F.col("p_partkey").alias("query_id"), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.substring(first, 1, 1), F.substring(first, 3, 50), F.lit("'s"), rest)).otherwise(F.col("p_name")).alias("text"))


def d12_corrected(spark, d):
    vocab = _part_words(spark, d).groupBy("word").agg(F.count("*").alias("n")).filter("length(word) > 2")
    known = spark.createDataFrame([(w,) for w in keyword.EXTRA_WORDS], "word string")
    stemmed = vocab.select(stems(F.array("word"))[0].alias("term"))
    out = keyword.corrected(_misspelt(spark, d), vocab, known, stemmed)
    return out.select("query_id", "text", F.array_join("typed", ",").alias("typed"), F.array_join("fixed", ",").alias("fixed"))


def d13_structure(spark, d):
    k = F.col("p_size") % 4
    c = read(spark, d, "part").select("p_partkey", F.concat(F.when(k == 0, "Wide shot of ").when(k == 1, "close-up ").when(k == 2, "slow push-in on ").otherwise("drone over "), F.col("p_name")).alias("q"))
    rest, asked = hybrid.structure(F.col("q"))
    return c.select("p_partkey", F.array_join(asked, ",").alias("asked"), rest.alias("rest"))


def d14_person(spark, d):
    c = read(spark, d, "part").select("p_partkey", F.concat_ws(" ", F.when(F.col("p_size") % 2 == 0, "Ann Lee's"), "p_name", F.when(F.col("p_size") % 5 == 0, "ann")).alias("q"))
    rest, named = hybrid.without_person(F.col("q"), "Ann Lee")
    return c.select("p_partkey", rest.alias("rest"), named.alias("named"))


def d15_nudged(spark, d):
    """Shots scored by confidence, as if a wide shot from a pan were asked for."""
    s = adapter.shots(spark, d).select("shot_id", F.col("confidence").alias("score"), "shot_type", "camera_movement", F.array(F.lit("shot_type=wide"), F.lit("camera_movement=pan")).alias("asked"))
    return hybrid.nudged(s).select("shot_id", F.round("score", 6).alias("score"))


def _vectors(spark, d):
    return read(spark, d, "embeddings").select(F.col("vec_id").alias("doc"), vector.normalised(F.col("embedding")).alias("v"))


def _vector_queries(spark, d):
    return read(spark, d, "benchmark").join(_vectors(spark, d), F.col("item_id") == F.col("doc")).select(F.col("item_id").alias("query_id"), F.col("v").alias("q"))


def e1_normalise(spark, d):
    return _vectors(spark, d).select("doc", F.round(vector.dot(F.col("v"), F.col("v")), 6).alias("norm2"), F.round(F.col("v")[0], 6).alias("first"))


def e2_exact_knn(spark, d):
    return vector.nearest(_vector_queries(spark, d), _vectors(spark, d), 10)


def e3_filtered_knn(spark, d):
    few = read(spark, d, "embeddings").filter(F.col("label").isin(1, 2, 3)).select(F.col("vec_id").alias("doc"))
    return vector.nearest(_vector_queries(spark, d), _vectors(spark, d).join(few, "doc", "left_semi"), 10)


def e4_similarities(spark, d):
    """Similarities of each item to its best documents by words."""
    pairs = d6_bm25_topk(spark, d).select(F.col("item_id").alias("query_id"), F.col("doc_id").alias("doc"))
    return vector.similarities(pairs, _vector_queries(spark, d), _vectors(spark, d))


def e5_calibration(spark, d):
    """Thresholds from 400 vectors spread evenly over all."""
    q = _vector_queries(spark, d)
    return vector.calibration(engine.background(q, keep(_vectors(spark, d), "vectors")), q)


def e7_missing_vectors(spark, d):
    return read(spark, d, "documents").join(read(spark, d, "embeddings"), F.col("doc_id") == F.col("vec_id"), "left_anti").select("doc_id", "n_chars")


def f1_fusion(spark, d):
    a = d6_bm25_topk(spark, d).select(F.col("item_id").alias("query_id"), "rank", F.col("doc_id").alias("doc"))
    out = hybrid.fuse(a, e2_exact_knn(spark, d))
    return out.select("query_id", "doc", F.round("score", 6).alias("score"), "sides")


def _candidates(spark, d):
    """Calls as candidates of their library: label by kind, score by cost."""
    label = F.when(F.col("kind") == "purchase", "match").when(F.col("kind") == "click", "near").otherwise("weak")
    return adapter.ledger(spark, d).select(F.col("workspace_id").alias("query_id"), F.col("call_id").alias("doc"), F.col("cost_usd").alias("score"), label.alias("label"))


def f3_modes(spark, d):
    """What each mode shows and hides."""
    out = []
    for mode in ("strict", "loose", "rank_only", "annotate"):
        kept, hidden = hybrid.shown(_candidates(spark, d), mode)
        out.append(kept.groupBy("query_id").agg(F.count("*").alias("shown")).join(hidden, "query_id").select(F.lit(mode).alias("mode"), "query_id", "shown", F.col("n").alias("hidden")))
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


def f4_ranked(spark, d):
    """The ten best of each library with what is known of them."""
    best = hybrid.ranked(_candidates(spark, d), 10)
    return best.join(adapter.ledger(spark, d).select(F.col("call_id").alias("doc"), "kind", "job_id"), "doc").select("query_id", "rank", "doc", "kind", "job_id")


def library(spark, d) -> engine.Library:
    """The documents as a library: languages stand for kinds of shot, sources for movements."""
    shot = F.create_map(*(F.lit(x) for x in ("en", "wide", "fr", "close_up", "de", "aerial", "es", "pov")))
    shots = read(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.coalesce(shot[F.col("lang")], F.lit("unknown")).alias("shot_type"), F.coalesce("source", F.lit("unknown")).alias("camera_movement"), "n_chars", (F.col("n_chars") % 3 == 0).alias("featured"))
    known = spark.createDataFrame([(w,) for w in keyword.EXTRA_WORDS], "word string")
    vectors = keep(_vectors(spark, d).join(shots.select("doc"), "doc", "left_semi"), "vectors")
    return engine.Library(_index(spark, d), known, vectors, shots, "Ann Lee")


def _item_queries(spark, d):
    """The items as queries: some ask for a kind of shot, some name the person, and every sixth lacks the third letter of its first word."""
    text = F.when(F.col("item_id") % 6 == 0, F.concat(F.substring("text", 1, 2), F.substring("text", 4, 100_000))).otherwise(F.col("text"))
    head = F.when(F.col("item_id") % 3 == 0, "close-up of ").when(F.col("item_id") % 3 == 1, "Ann's ").otherwise("")
    return read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.concat(head, text).alias("text"))


def _search(spark, d, mode):
    return engine.search(_item_queries(spark, d), _vector_queries(spark, d), library(spark, d), 10, mode)[0]


def f6_hybrid_search(spark, d):
    """The whole search for every benchmark item: spelling, person, kinds of shot, stems, both sides, fusion, gate, nudge, order."""
    return _search(spark, d, "strict").select("query_id", "rank", "doc", "score", "matched", "coverage", "similarity", "label", "shot_type")


def expected(spark, d, words: int = 8):
    """(query_id, doc): the documents that hold an item's first eight words, whatever the ranking says."""
    split = lambda c: F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != "")
    items = read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.array_join(F.slice(split(F.col("text")), 1, words), " ").alias("key"))
    w = F.col("w")
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(w) - (words - 1)), lambda i: F.array_join(F.slice(w, i, words), " ")))
    rows = read(spark, d, "documents").select("doc_id", split(F.col("text")).alias("w")).filter(F.size("w") >= words)
    return rows.select(F.col("doc_id").alias("doc"), F.explode(grams).alias("key")).join(items, "key").select("query_id", "doc")


def f10_hits(spark, d):
    """Whether an item's planted documents are among the first three of the fused sides, and how far up."""
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "doc")
    return hybrid.hit_at(f1_fusion(spark, d).withColumn("rank", F.row_number().over(order)), expected(spark, d))


def f10_search_hits(spark, d):
    """The same for the whole search, annotated: nothing is dropped."""
    return hybrid.hit_at(_search(spark, d, "annotate"), expected(spark, d))


_STOP = ", ".join(f"'{w}'" for w in keyword.STOPWORDS)
_INDEX = "regexp_extract_all(translate(lower({}), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[\\p{{L}}\\p{{N}}]+')"
_BASE = f"""
    qwords AS (SELECT item_id, list_distinct_ordered AS ws FROM (
        SELECT item_id, list_filter(list_transform(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_'']+'), lambda w: trim(w, '''')), lambda w: len(w) > 0 AND w NOT IN ({_STOP})) AS list_distinct_ordered FROM benchmark)),
    terms AS (SELECT DISTINCT item_id AS query_id, unnest({_INDEX.format("w")}) AS term FROM (SELECT item_id, unnest(ws) AS w FROM qwords)),
    toks AS (
        SELECT doc_id AS doc, unnest({_INDEX.format("text")}) AS term, 1.0 AS w, true AS f FROM documents
        UNION ALL SELECT doc_id, unnest({_INDEX.format("lang || ' ' || source")}), 0.6, false FROM documents),
    posts AS (SELECT term, doc, sum(w)::DOUBLE AS tf, bool_or(f) AS in_first FROM toks GROUP BY ALL),
    df AS (SELECT term, count(*) AS df FROM posts GROUP BY ALL),
    lens AS (SELECT doc, count(*) AS len FROM toks GROUP BY ALL),
    st AS (SELECT count(*) AS n, sum(len) / count(*) AS al FROM (SELECT doc_id, coalesce(len, 0) AS len FROM documents LEFT JOIN lens ON doc = doc_id)),
    bm AS (SELECT query_id, doc, sum(greatest(1e-6, ln((n - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / al))) AS score
           FROM terms JOIN posts USING (term) JOIN df USING (term) JOIN lens USING (doc), st GROUP BY ALL),
    bmf AS (SELECT query_id, doc, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc) AS rank FROM bm
            WHERE doc IN (SELECT doc_id FROM documents WHERE lang IN ('en', 'fr'))),
    vecs AS (SELECT vec_id AS doc, label, embedding::DOUBLE[] AS v, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS norm FROM embeddings),
    sims AS (SELECT a.doc AS query_id, b.doc, b.label, list_inner_product(a.v, b.v) / a.norm / b.norm AS s FROM benchmark JOIN vecs a ON item_id = a.doc, vecs b),
    knn AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, doc) AS rank, doc, s FROM sims)"""


def _sql(body: str) -> str:
    return f"WITH {_BASE} {body}"


ORACLE = {
    "d1_query_tokens": _sql("""SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY first) - 1 AS INT) AS pos, word FROM (
        SELECT item_id, word, min(i) AS first FROM (SELECT item_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM qwords) GROUP BY ALL)"""),
    "d3_postings": _sql("SELECT term, count(*) AS df, round(sum(tf), 4) AS tf, bool_or(in_first) AS in_text FROM posts GROUP BY ALL"),
    "d5_vocabulary": _sql(f"SELECT term AS word, df AS n FROM df WHERE len(term) > 2 AND NOT regexp_full_match(term, '[0-9]+') AND term NOT IN ({_STOP})"),
    "d6_bm25_topk": _sql("SELECT query_id AS item_id, rank, doc AS doc_id, round(score, 6) AS score FROM bmf WHERE rank <= 10"),
    "d7_coverage": _sql("""SELECT query_id, doc, round(coalesce(sum(CASE WHEN posts.term IS NOT NULL THEN weight * CASE WHEN in_first THEN 1.0 ELSE 0.7 END END) / sum(weight), 0), 6) AS coverage,
        count(posts.term) AS found, count(*) AS words FROM (
            SELECT query_id, term, doc, ln(1 + (SELECT n FROM st) / greatest(coalesce(df, 0), 1)) AS weight FROM (SELECT query_id, doc FROM bmf WHERE rank <= 10) JOIN terms USING (query_id) LEFT JOIN df USING (term)) t
        LEFT JOIN posts USING (term, doc) GROUP BY ALL"""),
    "d8_max_edits": "SELECT word, CASE WHEN len(word) <= 3 THEN 0 WHEN len(word) <= 7 THEN 1 ELSE 2 END AS edits, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part) GROUP BY ALL",
    "d10_corrections": """WITH vocab AS (SELECT word, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part) GROUP BY ALL),
        typed AS (SELECT DISTINCT substr(word, 1, 1) || substr(word, 3) AS word FROM vocab),
        near AS (SELECT t.word, v.word AS fixed, v.n, CAST(damerau_levenshtein(t.word, v.word) AS INT) AS edits FROM typed t, vocab v
                 WHERE t.word NOT IN (SELECT word FROM vocab) AND damerau_levenshtein(t.word, v.word) <= CASE WHEN len(t.word) <= 3 THEN 0 WHEN len(t.word) <= 7 THEN 1 ELSE 2 END)
        SELECT word, fixed, edits FROM near QUALIFY row_number() OVER (PARTITION BY word ORDER BY edits, n DESC, fixed) = 1""",
    "d9_distances": """WITH w AS (SELECT DISTINCT word FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part)), x AS (SELECT substr(word, 1, 1) || substr(word, 3, 1) || substr(word, 2, 1) || substr(word, 4) AS a, substr(word, 1, 1) AS k FROM w)
        SELECT a, word AS b, CAST(least(3, damerau_levenshtein(a, word)) AS INT) AS edits FROM x JOIN w ON k = substr(word, 1, 1)""",
    "d11_known_words": """WITH w AS (SELECT DISTINCT word FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part))
        SELECT DISTINCT word FROM (SELECT word || unnest(['', 's', 'es', 'ed', 'ing', 'er', 'ers', 'ly', 'd', 'y']) AS word FROM w
            UNION ALL SELECT unnest([left(word, -1) || 'ing', word || 'r', word || 'rs']) FROM w WHERE word LIKE '%e' UNION ALL SELECT left(word, -1) || unnest(['ies', 'ied', 'ier']) FROM w WHERE word LIKE '%y'
            UNION ALL SELECT word || right(word, 1) || unnest(['ing', 'ed', 'er']) FROM w WHERE regexp_matches(word, '[^aeiou][aeiou][^aeiouwy]$'))""",
    "d13_structure": """SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'shot_type=wide,shot_type=extreme_wide' WHEN 1 THEN 'shot_type=close_up,shot_type=extreme_close_up,shot_type=macro' WHEN 2 THEN 'camera_movement=push_in' ELSE 'shot_type=aerial,shot_type=top_down' END AS asked,
        CASE p_size % 4 WHEN 0 THEN 'of ' WHEN 1 THEN '' WHEN 2 THEN 'on ' ELSE 'drone over ' END || p_name AS rest FROM part""",
    "d14_person": "SELECT p_partkey, p_name AS rest, p_size % 2 = 0 OR p_size % 5 = 0 AS named FROM part",
    "d15_nudged": oracle("SELECT shot_id, round(confidence + 0.004 * (CAST(shot_type = 'wide' AS INT) + CAST(camera_movement = 'pan' AS INT)), 6) AS score FROM shots", "shots"),
    "f3_modes": oracle("""SELECT mode, workspace_id AS query_id, count_if(kind = 'purchase' OR (kind = 'click' AND mode <> 'strict') OR mode IN ('rank_only', 'annotate')) AS shown, count_if(kind = 'click' AND mode = 'strict') AS hidden
        FROM ledger, (SELECT unnest(['strict', 'loose', 'rank_only', 'annotate']) AS mode) GROUP BY mode, workspace_id""", "ledger"),
    "f4_ranked": oracle("SELECT workspace_id AS query_id, row_number() OVER (PARTITION BY workspace_id ORDER BY round(cost_usd, 9) DESC, call_id) AS rank, call_id AS doc, kind, job_id FROM ledger QUALIFY rank <= 10", "ledger"),
    "e1_normalise": _sql("SELECT doc, round(list_inner_product(v, v) / norm / norm, 6) AS norm2, round(v[1] / norm, 6) AS first FROM vecs"),
    "e2_exact_knn": _sql("SELECT query_id, rank, doc, round(1 - s, 6) + 0.0 AS distance FROM knn WHERE rank <= 10"),
    "e3_filtered_knn": _sql("SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, doc) AS rank, doc, round(1 - s, 6) + 0.0 AS distance FROM sims WHERE label IN (1, 2, 3) QUALIFY rank <= 10"),
    "e4_similarities": _sql("SELECT query_id, doc, round(s, 6) AS similarity FROM sims JOIN bmf USING (query_id, doc) WHERE bmf.rank <= 10"),
    "e5_calibration": _sql("""SELECT query_id, round(CASE WHEN n < 60 THEN 0.25 ELSE m + 3 * sp END, 6) AS floor, round(CASE WHEN n < 60 THEN 0.12 ELSE greatest(0.04, 1.5 * sp) END, 6) AS gap,
        round(CASE WHEN n < 60 THEN 0.2 ELSE m + 2 * sp END, 6) AS near_floor, round(CASE WHEN n < 60 THEN 0.18 ELSE 1.5 * greatest(0.04, 1.5 * sp) END, 6) AS near_gap, n >= 60 AS adaptive FROM (
        SELECT query_id, n, m, greatest(1.4826 * list_sort(list_transform(l, lambda x: abs(x - m)))[n // 2 + 1], 0.005) AS sp FROM (
            SELECT query_id, len(l) AS n, l, l[len(l) // 2 + 1] AS m FROM (SELECT query_id, list_sort(list(1 - round(1 - s, 6))) AS l FROM sims
                WHERE doc IN (SELECT doc FROM (SELECT doc, row_number() OVER (ORDER BY doc) - 1 AS i, count(*) OVER () AS c FROM vecs) WHERE i % CAST(ceil(c / 400) AS INT) = 0) GROUP BY ALL)))"""),
    "e7_missing_vectors": "SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)",
    "f10_hits": _sql("""SELECT e.query_id, coalesce(rank <= 3, false) AS hit, round(coalesce(1.0::DOUBLE / rank, 0), 6) AS reciprocal FROM (
            SELECT item_id AS query_id, doc_id AS doc FROM (SELECT item_id, array_to_string(list_filter(string_split_regex(lower(text), '\\s+'), lambda w: w <> '')[1:8], ' ') AS key FROM benchmark)
            JOIN (SELECT doc_id, ' ' || array_to_string(list_filter(string_split_regex(lower(text), '\\s+'), lambda w: w <> ''), ' ') || ' ' AS t FROM documents) ON contains(t, ' ' || key || ' ')) e
        LEFT JOIN (SELECT query_id, doc, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS rank FROM (
            SELECT query_id, doc, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score FROM (SELECT query_id, doc, rank FROM bmf WHERE rank <= 10 UNION ALL SELECT query_id, doc, rank FROM knn WHERE rank <= 10) GROUP BY ALL)) f USING (query_id, doc)"""),
    "f1_fusion": _sql("SELECT query_id, doc, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score, count(*) AS sides FROM (SELECT query_id, doc, rank FROM bmf WHERE rank <= 10 UNION ALL SELECT query_id, doc, rank FROM knn WHERE rank <= 10) GROUP BY ALL"),
}
QUERIES = {k: v for k, v in list(globals().items()) if k[0] in "def" and k[1:2].isdigit()}
