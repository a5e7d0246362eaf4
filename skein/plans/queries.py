"""The engine's operators as queries over the standard tables, each with its SQL where SQL can express it.

Documents become chunks: path = source/lang/doc_id.md, heading = 'source lang', start line = n_chars; embeddings belong to the document
with the same number."""

from __future__ import annotations

from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.functions import pathprefix, rawquery, render
from skein.functions.analysis import heading_split, location, tokens
from skein.functions.embed import HashingEmbedder, embed_column, wordpiece
from skein.functions.snippet import CLOSE, MIN_LENGTH, OPEN, REACH, WIDTH, snippet
from skein.operators import bm25, snapshot, vector
from skein.plans import search as plans
from skein.session import shared_root, table
from skein.sources import files as sources
from skein.sources import globs
from skein.streaming import maintain

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
TOP = 10
TERMS = ["clown", "the", "nicht"]
RX = r"[\p{L}\p{N}_]+"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    out = d.select(
        "doc_id", F.concat("source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.lit(0).alias("chunk_no"),
        F.array(F.concat("source", F.lit(" "), "lang")).alias("heading_path"), F.concat("source", F.lit(" "), "lang").alias("heading"), "text", F.col("n_chars").cast("int").alias("start_line"),
        F.lit(None).cast("string").alias("frontmatter_json"), F.sha2("text", 256).alias("checksum"), "source", "lang",
    )
    return out.withColumn(bm25.TEXT, tokens(F.col("text"))).withColumn(bm25.HEADING, tokens(F.col("heading")))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks' keys with their vectors: no text takes part in the join."""
    return chunks(spark, sf_dir).select("doc_id", "path", "chunk_no").join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id")


D = rf"""d AS (SELECT doc_id, source || '/' || lang || '/' || doc_id || '.md' AS path, source || ' ' || lang AS heading, source, lang, text, n_chars AS line, sha256(text) AS checksum,
  regexp_extract_all(lower(text), '{RX}') AS tt, regexp_extract_all(lower(source || ' ' || lang), '{RX}') AS ht FROM documents)"""


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def stats_sql(terms: dict[str, list[str]]) -> str:
    """One row of field statistics: n_f, mean_f, df_f_i."""
    parts = []
    for f, words in terms.items():
        parts += [f"count(*) FILTER (len({f}) > 0) AS n_{f}", f"CAST(sum(len({f})) AS DOUBLE) / greatest(count(*) FILTER (len({f}) > 0), 1) AS mean_{f}"]
        parts += [f"count(*) FILTER (list_contains({f}, {q(w)})) AS df_{f}_{i}" for i, w in enumerate(words)]
    return "s AS (SELECT " + ", ".join(parts) + " FROM d)"


def idf_sql(f: str, i: int) -> str:
    return f"ln(1 + (n_{f} - df_{f}_{i} + 0.5) / (df_{f}_{i} + 0.5))"


def norm_sql(tf: str, f: str) -> str:
    return f"({tf}) / (({tf}) + 1.2 * (1 - 0.75 + 0.75 * len({f}) / mean_{f}))"


def tf_sql(f: str, w: str) -> str:
    return f"CAST(len(list_filter({f}, lambda x: x = {q(w)})) AS DOUBLE)"


def term_sql(f: str, i: int, w: str, boost: float = 1.0) -> str:
    return f"CASE WHEN list_contains({f}, {q(w)}) THEN {boost} * {idf_sql(f, i)} * {norm_sql(tf_sql(f, w), f)} ELSE 0 END"


def bm25_sql(terms: list[str], where: str = "true", heading: bool = True, n: int = TOP) -> str:
    fields = {"tt": terms} | ({"ht": terms} if heading else {})
    score = " + ".join(term_sql(f, i, w, 2.0 if f == "ht" else 1.0) for f in fields for i, w in enumerate(terms))
    any_term = " OR ".join(f"list_contains({f}, {q(w)})" for f in fields for w in terms)
    return f"WITH {D}, {stats_sql(fields)} SELECT path, round({score}, 6) AS score FROM d, s WHERE ({any_term}) AND ({where}) ORDER BY ({score}) DESC, path LIMIT {n}"


def scored(df: DataFrame) -> DataFrame:
    return df.select("path", F.round("score", 6).alias("score"))


# --- analysis and statistics


@query("tokens_top", f"WITH {D} SELECT token, count(*) AS n FROM (SELECT unnest(tt) AS token FROM d) GROUP BY token ORDER BY n DESC, token LIMIT 50")
def tokens_top(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select(F.explode(tokens(F.col("text"))).alias("token"))
    return words.groupBy("token").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "token").limit(50)


@query("doc_length_stats", f"WITH {D} SELECT count(*) AS docs, CAST(sum(len(tt)) AS BIGINT) AS tokens, CAST(max(len(tt)) AS BIGINT) AS longest, round(avg(len(tt)), 6) AS mean FROM d")
def doc_length_stats(spark, sf_dir):
    n = F.size(tokens(F.col("text")))
    return table(spark, sf_dir, "documents").select(n.alias("n")).agg(F.count("*").alias("docs"), F.sum("n").alias("tokens"), F.max("n").cast("long").alias("longest"), F.round(F.avg("n"), 6).alias("mean"))


@query("term_df_idf", "WITH " + D + ", " + stats_sql({"tt": TERMS}) + " " + " UNION ALL ".join(f"SELECT {q(w)} AS term, df_tt_{i} AS df, round({idf_sql('tt', i)}, 6) AS idf FROM s" for i, w in enumerate(TERMS)))
def term_df_idf(spark, sf_dir):
    df = table(spark, sf_dir, "documents").select(tokens(F.col("text")).alias("t"))
    sums = df.agg(F.count(F.when(F.size("t") > 0, 1)).alias("n"), *(F.count(F.when(F.array_contains("t", w), 1)).alias(f"c{i}") for i, w in enumerate(TERMS)))
    rows = sums.select("n", F.explode(F.array(*(F.struct(F.lit(w).alias("term"), F.col(f"c{i}").alias("df")) for i, w in enumerate(TERMS)))).alias("x")).select("n", "x.*")
    return rows.select("term", "df", F.round(F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), 6).alias("idf"))


# --- TEXT


def text_query(words: list[str], prefix: str | None = None, heading: bool = True):
    def run(spark, sf_dir):
        c = chunks(spark, sf_dir)
        fields = (bm25.TEXT, bm25.HEADING) if heading else (bm25.TEXT,)
        rows = c.where(pathprefix.under(F.col("path"), prefix) & bm25.any_term(words, fields))
        return scored(bm25.top(rows.select("path", bm25.text_scores(c, words, heading).alias("score")), "score", TOP, "path"))

    return run


query("text_bm25_topk", bm25_sql(TERMS, heading=False))(text_query(TERMS, heading=False))
query("text_bm25_heading_boost", bm25_sql(["clown", "de", "src3"]))(text_query(["clown", "de", "src3"]))
query("text_path_prefix", bm25_sql(["idiot", "the"], "path = 'src1' OR starts_with(path, 'src1/')"))(text_query(["idiot", "the"], "src1"))


@query("text_or_match_count", f"WITH {D} SELECT source, count(*) AS n FROM d WHERE list_has_any(tt, ['clown', 'scum']) OR list_has_any(ht, ['clown', 'scum']) GROUP BY source")
def text_or_match_count(spark, sf_dir):
    return chunks(spark, sf_dir).where(bm25.any_term(["clown", "scum"])).groupBy("source").agg(F.count("*").alias("n"))


PREFIXES = ["src1", "src1/", "src1/en", "src1/en/1.md", "src", "src19/fr"]


@query("path_prefix_exact_or_subtree", f"WITH {D} " + " UNION ALL ".join(f"SELECT {q(p)} AS prefix, count(*) FILTER (path = {q(p.rstrip('/'))} OR starts_with(path, {q(p.rstrip('/') + '/')})) AS n FROM d" for p in PREFIXES))
def path_prefix_exact_or_subtree(spark, sf_dir):
    row = chunks(spark, sf_dir).agg(*(F.count(F.when(pathprefix.under(F.col("path"), p), 1)).alias(f"n{i}") for i, p in enumerate(PREFIXES)))
    return row.select(F.explode(F.array(*(F.struct(F.lit(p).alias("prefix"), F.col(f"n{i}").alias("n")) for i, p in enumerate(PREFIXES)))).alias("x")).select("x.*")


# --- RAW


def raw(name: str, text: str, match: str, score: str = "1.0", terms: dict[str, list[str]] | None = None, extra: str = "") -> None:
    stats = f", {stats_sql(terms)}" if terms else ""
    sql = f"WITH {D}{stats}{extra} SELECT path, round({score}, 6) AS score FROM d{', s' if terms else ''} WHERE {match} ORDER BY {f'({score}) DESC, ' if terms else ''}path LIMIT {TOP}"

    def run(spark, sf_dir):
        c = chunks(spark, sf_dir)
        hit, points = rawquery.compiled(c, text)
        return scored(bm25.top(rawquery.matching(c, hit, points, "path"), "score", TOP, "path"))

    query(name, sql)(run)


def has(f: str, w: str) -> str:
    return f"list_contains({f}, {q(w)})"


_two = {"tt": ["clown", "idiot"]}
_c, _i = term_sql("tt", 0, "clown"), term_sql("tt", 1, "idiot")
raw("raw_and", "clown AND idiot", f"{has('tt', 'clown')} AND {has('tt', 'idiot')}", f"{_c} + {_i}", _two)
raw("raw_or", "clown idiot", f"{has('tt', 'clown')} OR {has('tt', 'idiot')}", f"{_c} + {_i}", _two)
raw("raw_not", "clown NOT idiot", f"{has('tt', 'clown')} AND NOT {has('tt', 'idiot')}", _c, {"tt": ["clown"]})
raw("raw_required", "+clown idiot -scum", f"{has('tt', 'clown')} AND NOT {has('tt', 'scum')}", f"{_c} + {_i}", _two)
raw("raw_group", "(clown OR idiot) AND heading_text:src3", f"({has('tt', 'clown')} OR {has('tt', 'idiot')}) AND {has('ht', 'src3')}", f"{_c} + {_i} + {term_sql('ht', 0, 'src3')}", _two | {"ht": ["src3"]})
raw("raw_field", "heading_text:de", has("ht", "de"), term_sql("ht", 0, "de"), {"ht": ["de"]})
raw("raw_boost", "clown^3 idiot", f"{has('tt', 'clown')} OR {has('tt', 'idiot')}", f"{term_sql('tt', 0, 'clown', 3.0)} + {_i}", _two)
raw("raw_prefix", "pathet*", "len(list_filter(tt, lambda x: starts_with(x, 'pathet'))) > 0")
raw("raw_wildcard", "wor?hl*ss", "len(list_filter(tt, lambda x: regexp_full_match(x, 'wor.hl.*ss'))) > 0")
raw("raw_regex", "/mor.n/", "len(list_filter(tt, lambda x: regexp_full_match(x, 'mor.n'))) > 0")
raw("raw_fuzzy", "clawn~1", "len(list_filter(tt, lambda x: levenshtein(x, 'clawn') <= 1)) > 0")
raw("raw_range", "line:[100 TO 120]", "CAST(line AS VARCHAR) >= '100' AND CAST(line AS VARCHAR) <= '120'")
raw("raw_match_all", "*:*", "true")
_at = "len(list_filter(range(1, len(tt)), lambda i: tt[i] = 'of' AND tt[i + 1] = 'the'))"
_of = {"tt": ["of", "the"]}
_both = f"({idf_sql('tt', 0)} + {idf_sql('tt', 1)})"
raw("raw_phrase", '"of the"', f"{_at} > 0", f"{_both} * {norm_sql(f'CAST({_at} AS DOUBLE)', 'tt')}", _of)
_near = "len(list_filter(range(1, len(tt)), lambda i: tt[i] = 'of' AND (tt[i + 1] = 'the' OR tt[i + 2] = 'the' OR tt[i + 3] = 'the')))"
raw("raw_slop", '"of the"~2', f"{_near} > 0", f"{_both} * {norm_sql(f'CAST({_near} AS DOUBLE)', 'tt')}", _of)

# --- VECTOR and HYBRID

ASKED = [round(((i * 37) % 19 - 9) / 10, 1) for i in range(64)]
_v = "[" + ", ".join(map(str, ASKED)) + "]::DOUBLE[]"
COS = f"(list_inner_product(e, {_v}) / (sqrt(list_inner_product(e, e)) * sqrt(list_inner_product({_v}, {_v}))))"
E = "v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"


@query("vector_topk", f"WITH {E} SELECT vec_id, round((1 + {COS}) / 2, 6) AS score FROM v ORDER BY {COS} DESC, vec_id LIMIT {TOP}")
def vector_topk(spark, sf_dir):
    return vector.nearest(table(spark, sf_dir, "embeddings"), "embedding", ASKED, TOP, "vec_id").select("vec_id", F.round("score", 6).alias("score"))


@query("vector_topk_filtered", f"WITH {E} SELECT vec_id, round((1 + {COS}) / 2, 6) AS score FROM v WHERE label = 3 ORDER BY {COS} DESC, vec_id LIMIT {TOP}")
def vector_topk_filtered(spark, sf_dir):
    return vector.nearest(table(spark, sf_dir, "embeddings").where("label = 3"), "embedding", ASKED, TOP, "vec_id").select("vec_id", F.round("score", 6).alias("score"))


@query("vector_score_scaled", f"WITH {E} SELECT vec_id, round((1 + {COS}) / 2, 6) AS score FROM v")
def vector_score_scaled(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(vector.scaled(vector.cosine(F.col("embedding"), ASKED)), 6).alias("score"))


def hybrid_sql(terms: list[str], prefix: str) -> str:
    score = " + ".join(term_sql(f, i, w, 2.0 if f == "ht" else 1.0) for f in ("tt", "ht") for i, w in enumerate(terms))
    any_term = " OR ".join(has(f, w) for f in ("tt", "ht") for w in terms)
    return f"""WITH {D}, {E}, {stats_sql({"tt": terms, "ht": terms})},
t AS (SELECT path, row_number() OVER (ORDER BY ({score}) DESC, path) AS r FROM d, s WHERE ({any_term}) AND ({prefix}) QUALIFY r <= 40),
k AS (SELECT path, row_number() OVER (ORDER BY (1 + {COS}) / 2 DESC, path) AS r FROM d JOIN v ON v.vec_id = d.doc_id WHERE {prefix} QUALIFY r <= 40)
SELECT path, round(coalesce(1.0 / (60 + t.r), 0) + coalesce(1.0 / (60 + k.r), 0), 6) AS score FROM t FULL JOIN k USING (path)
ORDER BY coalesce(1.0 / (60 + t.r), 0) + coalesce(1.0 / (60 + k.r), 0) DESC, t.r NULLS LAST, k.r NULLS LAST LIMIT {TOP}"""


@query("hybrid_rrf", hybrid_sql(["clown", "idiot"], "true"))
def hybrid_rrf(spark, sf_dir):
    return scored(plans.hybrid_leg(chunks(spark, sf_dir), "clown idiot", ASKED, TOP, vectors=vectors(spark, sf_dir)))


@query("hybrid_rrf_prefix", hybrid_sql(["clown", "idiot"], "starts_with(path, 'src1/')"))
def hybrid_rrf_prefix(spark, sf_dir):
    return scored(plans.hybrid_leg(chunks(spark, sf_dir), "clown idiot", ASKED, TOP, "src1", vectors=vectors(spark, sf_dir)))


@query("hybrid_text_only_degraded", bm25_sql(["clown", "idiot"]))
def hybrid_text_only_degraded(spark, sf_dir):
    return scored(plans.hybrid_leg(chunks(spark, sf_dir), "clown idiot", None, TOP))


# --- snippets


@query("snippet_eligibility", f"WITH {D} SELECT doc_id, length(text) > {MIN_LENGTH} AND regexp_matches(text[1:{REACH}], '(?i)\\bclown\\b') AS truncated FROM d WHERE {has('tt', 'clown')}")
def snippet_eligibility(spark, sf_dir):
    c = chunks(spark, sf_dir).where(F.array_contains(bm25.TEXT, "clown"))
    return c.select("doc_id", snippet(F.col("text"), ["clown"], F.array_contains(bm25.TEXT, "clown"))[1].alias("truncated"))


_mark = rf"regexp_replace(p, '\b(clown)\b', '{OPEN}\1{CLOSE}', 'gi')"


@query("snippet_window", rf"""WITH {D}, x AS (
  SELECT doc_id, text, list_transform(string_split(regexp_replace(text[1:{REACH}], '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda p: {_mark}) AS ps FROM d WHERE {has('tt', 'clown')}),
b AS (SELECT doc_id, text, list_filter(ps, lambda p: len(string_split(p, '{OPEN}')) = list_max(list_transform(ps, lambda z: len(string_split(z, '{OPEN}')))))[1] AS p FROM x),
w AS (SELECT *, greatest(0, greatest(instr(p, '{OPEN}'), 1) - 1 - {WIDTH // 2}) AS a, least(length(p), greatest(0, greatest(instr(p, '{OPEN}'), 1) - 1 - {WIDTH // 2}) + {WIDTH}) AS z FROM b)
SELECT doc_id, CASE WHEN length(text) <= {MIN_LENGTH} OR instr(p, '{OPEN}') = 0 THEN text ELSE replace(replace(CASE WHEN length(p) <= {WIDTH} THEN p ELSE
  (CASE WHEN a > 0 THEN '... ' ELSE '' END) || p[a + 1:z] || (CASE WHEN z < length(p) THEN ' ...' ELSE '' END) END, '{OPEN}', '**'), '{CLOSE}', '**') END AS shown FROM w""")
def snippet_window(spark, sf_dir):
    c = chunks(spark, sf_dir).where(F.array_contains(bm25.TEXT, "clown"))
    return c.select("doc_id", snippet(F.col("text"), ["clown"], F.array_contains(bm25.TEXT, "clown"))[0].alias("shown"))


# --- snapshots: the first holds documents whose number isn't divisible by 7, the second those not divisible by 11, with every fifth changed

OLD = "old AS (SELECT source || '/' || doc_id AS path, sha256(text) AS checksum FROM documents WHERE doc_id % 7 <> 0)"
NEW = "new AS (SELECT source || '/' || doc_id AS path, sha256(CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END) AS checksum FROM documents WHERE doc_id % 11 <> 0)"
DELTA = """x AS (SELECT coalesce(new.path, old.path) AS path, coalesce(new.checksum, old.checksum) AS checksum,
  CASE WHEN old.path IS NULL THEN 'added' WHEN new.path IS NULL THEN 'removed' WHEN old.checksum <> new.checksum THEN 'changed' ELSE 'same' END AS state FROM old FULL JOIN new ON old.path = new.path)"""


def snapshots(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"))
    old = d.where("doc_id % 7 <> 0").select("path", F.sha2("text", 256).alias("checksum"))
    new = d.where("doc_id % 11 <> 0").select("path", F.sha2(F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("checksum"))
    return old, new


@query("checksum_files", "SELECT doc_id, sha256(text) AS checksum FROM documents")
def checksum_files(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("checksum"))


@query("reindex_delta", f"WITH {OLD}, {NEW}, {DELTA} SELECT path, checksum, state FROM x")
def reindex_delta(spark, sf_dir):
    return snapshot.delta(*snapshots(spark, sf_dir))


@query("reindex_stats", f"WITH {OLD}, {NEW}, {DELTA} SELECT count(*) FILTER (state = 'added') AS added, count(*) FILTER (state = 'changed') AS changed, count(*) FILTER (state = 'removed') AS removed FROM x")
def reindex_stats(spark, sf_dir):
    return snapshot.delta_stats(snapshot.delta(*snapshots(spark, sf_dir)))


@query("change_detected", f"WITH {OLD}, {NEW}, {DELTA} SELECT bool_or(state <> 'same') AS any_change FROM x")
def change_detected(spark, sf_dir):
    return snapshot.delta(*snapshots(spark, sf_dir)).agg(F.bool_or(F.col("state") != "same").alias("any_change"))


@query("skip_unchanged", f"WITH {OLD}, {NEW}, {DELTA} SELECT path FROM x WHERE state IN ('added', 'changed')")
def skip_unchanged(spark, sf_dir):
    return snapshot.delta(*snapshots(spark, sf_dir)).where("state in ('added', 'changed')").select("path")


@query("upsert_snapshot", f"WITH {OLD}, {NEW}, {DELTA} SELECT old.path, old.checksum FROM old WHERE path NOT IN (SELECT path FROM x WHERE state <> 'same') UNION ALL SELECT path, checksum FROM x WHERE state IN ('added', 'changed')")
def upsert_snapshot(spark, sf_dir):
    old, new = snapshots(spark, sf_dir)
    states = snapshot.delta(old, new)
    return snapshot.upserted(old, states.where("state in ('added', 'changed')").select("path", "checksum"), states.where("state <> 'same'"))


@query("delete_propagation", f"WITH {OLD}, {NEW} SELECT path FROM old WHERE path IN (SELECT path FROM new)")
def delete_propagation(spark, sf_dir):
    old, new = snapshots(spark, sf_dir)
    gone = snapshot.delta(old, new).where("state = 'removed'")
    return snapshot.upserted(old, old.where("false"), gone).select("path")


@query("duplicate_content", "SELECT sha256(text) AS checksum, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY sha256(text) HAVING count(*) > 1")
def duplicate_content(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("checksum")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


def stored_index(spark, sf_dir) -> snapshot.SnapshotStore:
    """The documents as a stored index, written once a table directory and session."""
    root = f"{shared_root(spark)}/skein-catalogue/{spark.sparkContext.applicationId}/{sha256(sf_dir.encode()).hexdigest()}"
    store = snapshot.SnapshotStore(spark, root)
    if store.manifest() is None:
        c = chunks(spark, sf_dir)
        store.write(c.drop("doc_id", "source", "lang"), c.select("path", "checksum"), None, None, 1)
    return store


@query("index_counts", "SELECT 'documents: ' || count(*) || ' docs' AS line FROM documents")
def index_counts(spark, sf_dir):
    return render.index_lines(spark.createDataFrame([("documents", stored_index(spark, sf_dir).count())], "index_name string, docs long"))


@query("text_postings_topk", bm25_sql(["clown", "de", "src3"]))
def text_postings_topk(spark, sf_dir):
    return scored(stored_index(spark, sf_dir).ranked(["clown", "de", "src3"], TOP))


@query("text_postings_prefix", bm25_sql(["idiot", "the"], "path = 'src1' OR starts_with(path, 'src1/')"))
def text_postings_prefix(spark, sf_dir):
    return scored(stored_index(spark, sf_dir).ranked(["idiot", "the"], TOP, "src1"))


@query("list_paths", f"WITH {D} SELECT DISTINCT path FROM d")
def list_paths(spark, sf_dir):
    return stored_index(spark, sf_dir).list_paths()


@query("known_checksums", f"WITH {D} SELECT path, checksum FROM d")
def known_checksums(spark, sf_dir):
    return stored_index(spark, sf_dir).known_checksums()


@query("hit_location", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN url ELSE url || ':' || page_id % 3 END AS location FROM pages")
def hit_location(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", location(F.col("url"), F.col("page_id") % 3).alias("location"))


@query("heading_breadcrumb", f"WITH {D} SELECT doc_id, source || ' / ' || lang AS heading, CAST(2 AS BIGINT) AS depth, lang AS leaf FROM d")
def heading_breadcrumb(spark, sf_dir):
    h = table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.array("source", "lang"), " / ").alias("heading"))
    return h.select("doc_id", "heading", F.size(heading_split(F.col("heading"))).cast("long").alias("depth"), F.element_at(heading_split(F.col("heading")), -1).alias("leaf"))


# --- scans

PATHS = "p AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path FROM pages)"


def page_paths(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "").alias("path"))


@query("glob_match_urls", rf"WITH {PATHS} SELECT page_id, path FROM p WHERE regexp_full_match(path, '(.*/)?fr/[^/]*') OR regexp_full_match(path, '[^/]*\.example\.(com|org)/en/[^/][^/]')")
def glob_match_urls(spark, sf_dir):
    return page_paths(spark, sf_dir).where(globs.matches(F.col("path"), ["**/fr/*", "*.example.{com,org}/en/??"]))


@query("pruned_dirs", f"WITH {PATHS}, n AS (SELECT page_id, replace(replace(path, '/en/', '/target/'), '/de/', '/targets/') AS path FROM p) SELECT page_id, path FROM n WHERE NOT regexp_matches(path, '(^|/)(\\.git|node_modules|target|build|\\.cache)/')")
def pruned_dirs(spark, sf_dir):
    p = page_paths(spark, sf_dir).withColumn("path", F.replace(F.replace("path", F.lit("/en/"), F.lit("/target/")), F.lit("/de/"), F.lit("/targets/")))
    return p.where(~globs.pruned(F.col("path")))


EXT = ["java", "PAS", "go", "rs", "txt"]


@query("source_kinds", f"""SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'java' WHEN 1 THEN 'pascal' WHEN 2 THEN 'go' WHEN 3 THEN 'rust' END AS kind FROM documents""")
def source_kinds(spark, sf_dir):
    ext = F.get(F.array(*map(F.lit, EXT)), (F.col("doc_id") % 5).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", sources.source_kind(F.concat(F.lit("src/f."), ext)).alias("kind"))


# --- chunking: files assembled from texts reduced to letters and single spaces, so the chunks are known

LETTERS = r"trim(regexp_replace(regexp_replace(text, '[^\p{L}]+', ' ', 'g'), ' +', ' ', 'g'))"


def letters() -> F.Column:
    """One replacement leaves single spaces already."""
    return F.trim(F.regexp_replace("text", r"[^\p{L}]+", " "))


def assembled(spark, sf_dir, category: str, kind: str | None, *parts) -> DataFrame:
    # A text with a letter is one whose body isn't empty; asked of the text, so that the body isn't made twice.
    d = table(spark, sf_dir, "documents").where(F.col("text").rlike(r"\p{L}")).select("doc_id", "lang", "source", letters().alias("body"))
    f = d.select(F.col("doc_id").cast("string").alias("path"), F.lit(category).alias("category"), F.lit(kind).cast("string").alias("kind"), F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts)).cast("binary").alias("content"))
    c = sources.chunked(f)
    return c.select(F.col("path").cast("long").alias("doc_id"), F.col("chunk_no").cast("long").alias("chunk_no"), F.array_join("heading_path", " / ").alias("heading"), "text", F.col("start_line").cast("long").alias("start_line"), "frontmatter_json")


B = f"b AS (SELECT doc_id, lang, source, {LETTERS} AS body FROM documents), f AS (SELECT * FROM b WHERE length(body) > 0)"


@query("chunk_markdown", f"""WITH {B} SELECT doc_id, CAST(0 AS BIGINT) AS chunk_no, '' AS heading, 'intro' AS text, CAST(1 AS BIGINT) AS start_line FROM f
UNION ALL SELECT doc_id, 1, source, body, 3 FROM f UNION ALL SELECT doc_id, 2, source || ' / ' || lang, '', 7 FROM f UNION ALL SELECT doc_id, 3, 'End', body || chr(10) || chr(10) || 'last', 8 FROM f""")
def chunk_markdown(spark, sf_dir):
    return assembled(spark, sf_dir, "markdown", None, "intro\n\n# ", F.col("source"), "\n\n**", F.col("body"), "**\n\n## ", F.col("lang"), "\n# End\n\n", F.col("body"), "\n\nlast\n").drop("frontmatter_json")


@query("chunk_frontmatter", f"""WITH {B} SELECT doc_id, CAST(0 AS BIGINT) AS chunk_no, 'frontmatter' AS heading, 'scope: ' || source || chr(10) || 'none: null' AS text, CAST(1 AS BIGINT) AS start_line, '{{"scope": "' || source || '", "none": null}}' AS frontmatter_json FROM f
UNION ALL SELECT doc_id, 1, 'H', body, 5, '{{"scope": "' || source || '", "none": null}}' FROM f""")
def chunk_frontmatter(spark, sf_dir):
    return assembled(spark, sf_dir, "markdown", None, "---\nscope: ", F.col("source"), "\nnone: null\n---\n# H\n", F.col("body"))


@query("chunk_comments", f"""WITH {B} SELECT doc_id, CAST(0 AS BIGINT) AS chunk_no, body || chr(10) || 'second' AS text, CAST(1 AS BIGINT) AS start_line FROM f
UNION ALL SELECT doc_id, 1, 'block' || chr(10) || source, 4 FROM f UNION ALL SELECT doc_id, 2, 'tail', 7 FROM f""")
def chunk_comments(spark, sf_dir):
    return assembled(spark, sf_dir, "source", "java", "// ", F.col("body"), '\n// second\n\n/**\n * block\n * ', F.col("source"), '\n */ String s = "// no"; // tail\n').drop("heading", "frontmatter_json")


@query("chunk_pascal", f"WITH {B} SELECT doc_id, CAST(0 AS BIGINT) AS chunk_no, body AS text, CAST(1 AS BIGINT) AS start_line FROM f UNION ALL SELECT doc_id, 1, 'star', 2 FROM f UNION ALL SELECT doc_id, 2, source, 3 FROM f")
def chunk_pascal(spark, sf_dir):
    return assembled(spark, sf_dir, "source", "pascal", "{ ", F.col("body"), " }\nx := 'it''s { no }'; (* star *)\n// ", F.col("source"), "\n").drop("heading", "frontmatter_json")


@query("chunk_yaml", f"WITH {B} SELECT doc_id, 'k: ' || body AS text, CAST(1 AS BIGINT) AS start_line FROM f")
def chunk_yaml(spark, sf_dir):
    return assembled(spark, sf_dir, "yaml", None, "\n  k: ", F.col("body"), " \n\n").select("doc_id", "text", "start_line")


@query("frontmatter_json_fields", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.none') IS NULL AS missing FROM events")
def frontmatter_json_fields(spark, sf_dir):
    v = F.try_parse_json("props")
    return table(spark, sf_dir, "events").select("event_id", F.try_variant_get(v, "$.k", "long").alias("k"), F.try_variant_get(v, "$.none", "string").isNull().alias("missing"))


# --- streams, in batch form


def gaps(seconds: int) -> str:
    return f"""WITH g AS (SELECT ts, CASE WHEN ts >= lag(ts) OVER (ORDER BY ts) + INTERVAL {seconds} SECOND OR lag(ts) OVER (ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS new FROM events),
s AS (SELECT ts, sum(new) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT min(ts) AS "start", max(ts) + INTERVAL {seconds} SECOND AS "end", count(*) AS n FROM s GROUP BY k"""


@query("debounce_sessions", gaps(1))
def debounce_sessions(spark, sf_dir):
    return maintain.bursts(table(spark, sf_dir, "events"))


@query("idle_gaps", gaps(600))
def idle_gaps(spark, sf_dir):
    return maintain.bursts(table(spark, sf_dir, "events"), gap=maintain.IDLE)


@query("periodic_scan_windows", """SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS "start", count(*) AS n FROM events GROUP BY 1""")
def periodic_scan_windows(spark, sf_dir):
    return maintain.scan_windows(table(spark, sf_dir, "events"))


@query("drain_batches", "SELECT CAST(user_id AS VARCHAR) AS path, count(*) AS n, false AS full_scan FROM events GROUP BY user_id")
def drain_batches(spark, sf_dir):
    return maintain.drained(table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("path")))


# --- rendering


@query("render_hits", f"""WITH b AS ({bm25_sql(TERMS)}), r AS (SELECT *, row_number() OVER (ORDER BY score DESC, path) AS rank FROM b)
SELECT CAST(rank AS INTEGER) AS rank, r.path || CASE WHEN n_chars <= 0 THEN '' ELSE ':' || n_chars END || ' [' || source || ' ' || lang || '] (' || printf('%.5f', score) || ')' || chr(10) || text AS rendered
FROM r JOIN documents x ON r.path = x.source || '/' || x.lang || '/' || x.doc_id || '.md'""")
def render_hits(spark, sf_dir):
    hits = plans.search(chunks(spark, sf_dir), " ".join(TERMS), TOP, "text", full_text=True)
    return render.hit_lines(hits.withColumn("score", F.round("score", 6)))


@query("search_hits")
def search_hits(spark, sf_dir):
    return render.hit_json(plans.search(chunks(spark, sf_dir), "clown the", TOP, "text"))


# --- Python functions


@query("embed_udf")
def embed_udf(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", embed_column(HashingEmbedder(), F.col("text")).alias("embedding"))


VOCAB = {w: i for i, w in enumerate(["[PAD]", "[UNK]", "[CLS]", "[SEP]", *"abcdefghijklmnopqrstuvwxyz", *(f"##{c}" for c in "abcdefghijklmnopqrstuvwxyz"), "the", "##ing", "##tion", "."])}


@F.udf(T.ArrayType(T.IntegerType()))
def _pieces(text):
    return wordpiece(text or "", VOCAB)


@query("wordpiece_udf")
def wordpiece_udf(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", _pieces("text").alias("ids"))

