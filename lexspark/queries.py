"""Registered queries of the core operators and the SQL they are compared with.

Searches take as queries every row whose id is divisible by 100, against all rows.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexspark import providers
from lexspark.functions import text as T
from lexspark.operators import bm25, chunking, cleanup, evaluation, fusion, grounding, layout, vector
from lexspark.plans import pipelines
from lexspark.session import table, written, written_dir
from lexspark.sources import tables

CHUNK_KEYS = ["doc_id", "chunk_seq"]
VALUES = ["text", "section", "subsection", "heading", "part", "pages"]
CHUNK_COLUMNS = ["doc_id", "chunk_seq", "text", "section", "subsection", "heading", "part"]


def _chunks(spark, sf_dir):
    """Chunks, repeated rows once, with citation and indexed text."""
    rows = table(spark, sf_dir, "chunks").select(*CHUNK_COLUMNS).distinct()
    c = [F.col(x) for x in ("section", "subsection", "part")]
    return rows.withColumns({"citation": T.citation(*c), "indexed": T.indexed_text(*c, F.col("heading"), F.col("text"))})


def _lines(spark, sf_dir):
    return table(spark, sf_dir, "lines").select("doc_id", "seq", "page", "block", "x0", "y0", "text").distinct()


def _kept_lines(spark, sf_dir):
    """The same, written once, for queries that read them several times."""
    return written(_lines(spark, sf_dir), "lines")


def _questions(spark, sf_dir):
    return table(spark, sf_dir, "query_embeddings").filter("query_id % 100 = 0 AND question IS NOT NULL").select("query_id", "question")


def _search(spark, sf_dir, k, question="question", chunks=None):
    chunks = chunks or written(_chunks(spark, sf_dir).select(*CHUNK_KEYS, "indexed"), "chunks")
    return bm25.search_texts(table(spark, sf_dir, "eval_cases"), chunks, "case_id", CHUNK_KEYS, k, question, "indexed")


def bm25_topk(spark, sf_dir):
    return _search(spark, sf_dir, 10)


def token_counts(spark, sf_dir):
    return bm25.term_counts(table(spark, sf_dir, "documents"), ["doc_id"])


def doc_lengths(spark, sf_dir):
    return bm25.lengths(table(spark, sf_dir, "documents"), ["doc_id"])


def idf_table(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    idf = bm25.idf_table(bm25.term_counts(docs, ["doc_id"]), docs.agg(F.count("*").alias("n")))
    return idf.withColumn("idf", F.round("idf", 9))


def bm25_postings(spark, sf_dir):
    return bm25.build_postings(_chunks(spark, sf_dir), CHUNK_KEYS, "indexed").withColumn("impact", F.round("impact", 9))


def l2_normalize(spark, sf_dir):
    v = vector.l2_normalize(F.col("embedding"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(vector.norm(F.col("embedding")), 9).alias("norm"), F.round(v[0], 9).alias("first"), F.size(v).alias("dims"))


def _near(spark, sf_dir, k):
    base = vector.unit_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    queries = base.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "v")
    return vector.nearest(queries, base, "query_id", "vec_id", k)


def cosine_topk(spark, sf_dir):
    return _near(spark, sf_dir, 10)


def _labelled(spark, sf_dir, k):
    """The k nearest vectors other than the query itself, with labels as citations."""
    labels = table(spark, sf_dir, "embeddings").select("vec_id", F.concat(F.lit("L"), F.col("label")).alias("citation"))
    near = _near(spark, sf_dir, k + 1).filter("vec_id <> query_id").withColumnRenamed("query_id", "case_id")
    return bm25.top_k(near.drop("rk"), "case_id", ["vec_id"], k).join(labels, "vec_id").withColumn("heading", F.lit(None).cast("string"))


def support_score(spark, sf_dir):
    queries = table(spark, sf_dir, "embeddings").filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"))
    near = _labelled(spark, sf_dir, 5).withColumnRenamed("case_id", "query_id")
    return vector.support_score(near, queries, "query_id")


def support_distribution(spark, sf_dir):
    labels = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("label").alias("grp"))
    return evaluation.support_distribution(support_score(spark, sf_dir).join(labels, "query_id"))


def _cases(spark, sf_dir):
    cases = table(spark, sf_dir, "embeddings").filter("vec_id % 100 = 0").select(F.col("vec_id").alias("case_id"), F.concat(F.lit("L"), F.col("label")).alias("category"), "label")
    other = F.concat(F.lit("L"), (F.col("label") + 1) % 10)
    targets = F.array(F.struct(F.lit(0).alias("exp_no"), F.col("category").alias("citation")), F.struct(F.lit(1).alias("exp_no"), other.alias("citation")))
    expected = cases.select("case_id", F.explode(targets).alias("t")).select("case_id", "t.exp_no", "t.citation", F.lit(None).cast("string").alias("term"))
    return cases.select("case_id", "category"), expected


def retrieval_eval_rollup(spark, sf_dir):
    cases, expected = _cases(spark, sf_dir)
    return pipelines.evaluate(cases, expected, _labelled(spark, sf_dir, 5))


def retrieval_ranks(spark, sf_dir):
    _, expected = _cases(spark, sf_dir)
    return evaluation.expectation_ranks(expected, _labelled(spark, sf_dir, 5))


def _keyed(df):
    return df.withColumn("chunk", F.concat_ws("-", "doc_id", "chunk_seq"))


def rrf_fusion(spark, sf_dir):
    chunks = written(_chunks(spark, sf_dir).select(*CHUNK_KEYS, "indexed"), "chunks")
    one = _keyed(_search(spark, sf_dir, 20, chunks=chunks)).select("case_id", F.lit(0).alias("ranking_no"), F.col("rk").alias("rank"), "chunk")
    two = _keyed(_search(spark, sf_dir, 20, "passage", chunks)).select("case_id", F.lit(1).alias("ranking_no"), F.col("rk").alias("rank"), "chunk")
    return fusion.reciprocal_rank_fusion(one.unionByName(two), "case_id", "chunk").filter("rk <= 10")


def parse_citation_query(spark, sf_dir):
    return fusion.parse_citation_queries(table(spark, sf_dir, "query_embeddings"), "query_id")


def structured_lookup(spark, sf_dir):
    """All questions that name a section, each with the ten first chunks of it."""
    asked = table(spark, sf_dir, "query_embeddings").filter("question IS NOT NULL").select("query_id", "question").distinct()
    return fusion.structured_lookup(fusion.parse_citation_queries(asked, "query_id"), _chunks(spark, sf_dir), "query_id", CHUNK_KEYS, 10)


def _asked(spark, sf_dir):
    return table(spark, sf_dir, "eval_cases").select(F.col("case_id").alias("query_id"), "question")


def _embedded(rows, text):
    return rows.withColumn("embedding", providers.counting_embedder(F.col(text)))


def _index(spark, sf_dir):
    """Chunks by value, equal ones once, with their vectors."""
    return written(_embedded(pipelines.with_text(table(spark, sf_dir, "chunks").select(*VALUES)), "indexed"), "chunk-index")


def _semantic(spark, sf_dir, keyed, k=fusion.CANDIDATE_DEPTH):
    return pipelines.nearest_chunks(_embedded(_asked(spark, sf_dir), "question"), keyed, "query_id", k)


def semantic_chunks(spark, sf_dir):
    """The ten chunks whose vectors are nearest to that of each evaluation question."""
    return _semantic(spark, sf_dir, _index(spark, sf_dir), 10)


def cached_semantic_chunks(spark, sf_dir):
    """The same through a cache of question vectors, which is warmed first."""
    asked = _asked(spark, sf_dir)
    nothing = spark.createDataFrame([], "model string, question string, embedding array<float>")
    path = f"{written_dir(spark)}/questions-{uuid.uuid4().hex}"
    tables.warm_query_cache(asked, nothing, "counting", lambda df: _embedded(df, "question"), path)
    return pipelines.cached_nearest_chunks(asked, _index(spark, sf_dir), tables.query_cache(spark, path), "counting", "query_id", 10)


def hybrid_retrieve(spark, sf_dir):
    """Structured rows, then the fusion of vector and keyword rankings, for every evaluation question."""
    keyed = _index(spark, sf_dir)
    found = pipelines.retrieve(_asked(spark, sf_dir), keyed, _semantic(spark, sf_dir, keyed), "query_id", 10)
    return found.select("query_id", F.col("chunk_key").alias("chunk"), "source", "rk")


def ablation_compare(spark, sf_dir):
    """Four retrievers over the questions that name a section: a chunk of that section among the first ten is a hit."""
    keyed, questions = _index(spark, sf_dir), _asked(spark, sf_dir)
    named = fusion.parse_citation_queries(questions, "query_id").select(F.col("query_id").alias("case_id"), F.col("section").alias("citation"))
    cases = named.select("case_id", F.lit("named").alias("category"))
    expected = named.select("case_id", F.lit(0).alias("exp_no"), "citation", F.lit(None).cast("string").alias("term"))
    semantic = written(_semantic(spark, sf_dir, keyed), "semantic")
    both = [pipelines.retrieve(questions, keyed, semantic, "query_id", 10, structured=x) for x in (False, True)]
    keyword = bm25.search_texts(questions, keyed, "query_id", ["chunk_key"], 10, text="indexed")
    rankings = {"semantic": semantic.filter("rank <= 10").withColumnRenamed("rank", "rk"), "bm25": keyword, "fusion": both[0], "hybrid": both[1]}
    sections = keyed.select("chunk_key", F.col("section").alias("citation"), F.lit(None).cast("string").alias("heading"))
    out = None
    for name, ranking in rankings.items():
        got = ranking.select(F.col("query_id").alias("case_id"), "chunk_key", "rk").join(sections, "chunk_key")
        one = evaluation.summarise(evaluation.case_metrics(cases, evaluation.expectation_ranks(expected, got))).filter("is_total = 1")
        one = one.select(F.lit(name).alias("retriever"), "n", "hit1", "hit3", "hit5", "mrr")
        out = one if out is None else out.unionByName(one)
    return out


def retrieval_misses(spark, sf_dir):
    """The cases whose own label is not among the five nearest, with what they got instead."""
    cases, expected = _cases(spark, sf_dir)
    near = _labelled(spark, sf_dir, 5).withColumn("text", F.col("vec_id").cast("string"))
    own = evaluation.case_metrics(cases, evaluation.expectation_ranks(expected.filter("exp_no = 0"), near))
    return evaluation.misses(own, near)


def misses_wanted(spark, sf_dir):
    """The same misses with what was wanted of them."""
    cases, expected = _cases(spark, sf_dir)
    near, expected = _labelled(spark, sf_dir, 5).withColumn("text", F.col("vec_id").cast("string")), expected.withColumn("target_no", F.lit(0))
    own = evaluation.case_metrics(cases, evaluation.expectation_ranks(expected.filter("exp_no = 0"), near))
    return evaluation.miss_report(own, near, expected)


def support_separation(spark, sf_dir):
    """The least support of label 0 less the greatest of label 1."""
    return evaluation.separation(support_distribution(spark, sf_dir), 0, 1).select(F.round("gap", 9).alias("gap"))


def _json_file(df, name, order, *values):
    """One JSON document of all rows of an evaluation set, in the shared folder."""
    path = f"{written_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    cases = F.transform(F.sort_array(F.collect_list(F.struct(order, F.struct(*values).alias("case")))), lambda x: x["case"])
    df.agg(F.to_json(F.struct(cases.alias("cases"))).alias("value")).write.text(path)
    return path


def eval_wanted(spark, sf_dir):
    """An evaluation set written as JSON, read back, with the targets of each case described."""
    target = lambda c, t=None: F.struct(F.col(c).alias("citation"), (F.col(t) if t else F.lit(None).cast("string")).alias("term"))
    any_of = F.array(target("category", "difficulty"), target("lang"))
    none = F.lit(None)
    expected = F.array(F.struct(target("category")["citation"].alias("citation"), none.cast("string").alias("term"), none.cast("array<struct<citation:string,term:string>>").alias("any_of")),
                       F.struct(none.cast("string").alias("citation"), none.cast("string").alias("term"), any_of.alias("any_of")))
    path = _json_file(table(spark, sf_dir, "eval_cases"), "eval-set", "case_id", "question", "category", expected.alias("expected"))
    cases = tables.read_eval_set(spark, path)
    return evaluation.describe_expectations(evaluation.flatten_expectations(cases)).join(cases.select("case_id", "question"), "case_id")


def negatives_by_difficulty(spark, sf_dir):
    """Cases written as a set of negatives, read back and ranked by difficulty, then question."""
    path = _json_file(table(spark, sf_dir, "eval_cases"), "negatives", "case_id", "question", "difficulty", F.col("category").alias("why"))
    order = Window.partitionBy("difficulty").orderBy("question", "case_id")
    return tables.read_negatives(spark, path).withColumn("place", F.row_number().over(order)).select("difficulty", "place", "question", "why")


def shared_sources(spark, sf_dir):
    """The sources of both printed and scanned documents."""
    meta = table(spark, sf_dir, "documents_meta").filter("source IS NOT NULL")
    return evaluation.shared_values(meta.filter("medium = 'print'"), meta.filter("medium = 'scan'"), "source")


def index_roundtrip(spark, sf_dir):
    """An index embedded and saved, then found again by its fingerprint without embedding."""
    keyed = pipelines.with_text(table(spark, sf_dir, "chunks").select(*VALUES))
    path = f"{written_dir(spark)}/index-{uuid.uuid4().hex}"
    for embed in (lambda df: _embedded(df, "indexed"), None):
        held = tables.embedded_index(keyed, path, "counting", ["chunk_key"], embed)
    return held.select("chunk_key", "citation", F.size("embedding").alias("dims"))


def query_cache_warmed(spark, sf_dir):
    """Every question with a vector of one model: those the cache has, and those embedded and added to it."""
    cache = table(spark, sf_dir, "query_embeddings").withColumnRenamed("embeddings", "embedding").select("model", "question", "embedding")
    asked = cache.filter("question IS NOT NULL").select("question").distinct()
    path = f"{written_dir(spark)}/questions-{uuid.uuid4().hex}"
    tables.warm_query_cache(asked, cache, "lexvec-a", lambda df: _embedded(df, "question"), path)
    new = tables.query_cache(spark, path)
    vectors = tables.cached_vectors(asked, cache.unionByName(new), "lexvec-a")
    return vectors.join(new.select("question", F.lit(True).alias("added")), "question", "left").select("question", F.coalesce("added", F.lit(False)).alias("added"))


def documents_from_files(spark, sf_dir):
    """Lines written as files of JSON rows by source, parsed again: (source, n_lines, n_pages, page_width)."""
    lines = table(spark, sf_dir, "lines").filter("source IS NOT NULL").select("source", "doc_id", "page", F.to_json(F.struct("page", "block", "x0", "y0", "x1", "text")).alias("value"))
    path = f"{written_dir(spark)}/files-{uuid.uuid4().hex}"
    lines.select("source", "value").repartition("source").write.partitionBy("source").option("maxRecordsPerFile", 20_000).text(path)

    def parse(data: bytes):
        rows = (json.loads(x) for x in data.decode().split("\n") if x)
        return [(*(r.get(c) for c in ("page", "block", "x0", "y0", "x1")), r.get("text") or "", 612.0, 792.0) for r in rows]

    parsed = tables.read_documents(spark, f"{path}/source=*/*.txt", parse)
    parsed = parsed.withColumn("source", F.regexp_extract("path", "source=([^/]+)/", 1))
    sizes = tables.page_sizes(parsed)
    return parsed.drop("page_width").join(sizes, "doc_id").groupBy("source").agg(F.count("*").alias("n_lines"), F.count_distinct("page").alias("n_pages"), F.max("page_width").alias("page_width"))


def cited_provisions(spark, sf_dir):
    return grounding.extract_citations(_chunks(spark, sf_dir), CHUNK_KEYS)


def _audited(spark, sf_dir):
    """The citations of every chunk against the provisions of its own document."""
    chunks = _chunks(spark, sf_dir)
    cited = grounding.extract_citations(chunks, CHUNK_KEYS)
    return grounding.audit_citations(cited, chunks.select("doc_id", "section", "subsection", "text"), CHUNK_KEYS, ["doc_id"])


def citation_audit(spark, sf_dir):
    return _audited(spark, sf_dir)


def answer_warnings(spark, sf_dir):
    return grounding.warnings(grounding.audit_lists(_audited(spark, sf_dir), CHUNK_KEYS))


def refusal_rate(spark, sf_dir):
    chunks = _chunks(spark, sf_dir)
    declined = grounding.refusals(chunks.select(*CHUNK_COLUMNS), ["doc_id", "chunk_seq", "part"])
    return declined.groupBy("part").agg(F.count("*").alias("n"), F.count_if("declined").alias("declined"))


def refusal_report(spark, sf_dir):
    """Chunks as answers; those outside schedules count as answerable."""
    chunks = _chunks(spark, sf_dir)
    answerable = chunks.select(*CHUNK_KEYS, (F.coalesce("part", F.lit("")) != T.SCHEDULE).alias("answerable"))
    declined = grounding.refusals(chunks, CHUNK_KEYS).join(answerable, CHUNK_KEYS)
    return grounding.refusal_report(declined, _audited(spark, sf_dir), CHUNK_KEYS)


def context_build(spark, sf_dir):
    full = _search(spark, sf_dir, 3).join(_chunks(spark, sf_dir).select(*CHUNK_KEYS, "citation", "text"), CHUNK_KEYS)
    return grounding.build_context(full, ["case_id"])


def hyphen_vocabulary(spark, sf_dir):
    return cleanup.hyphen_vocabulary(_lines(spark, sf_dir))


def running_headers(spark, sf_dir):
    return cleanup.repeated_texts(_lines(spark, sf_dir))


def header_islands(spark, sf_dir):
    """Of documents with a page size, as in its SQL."""
    marked = cleanup.mark_headers(_lines(spark, sf_dir), table(spark, sf_dir, "documents_meta"))
    return marked.filter("is_header IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if("is_header").alias("n_headers"))


def front_matter(spark, sf_dir):
    return cleanup.front_matter(_lines(spark, sf_dir))


def paragraphs_from_lines(spark, sf_dir):
    return cleanup.to_paragraphs(_kept_lines(spark, sf_dir), table(spark, sf_dir, "documents_meta"))


def detect_layout(spark, sf_dir):
    """The documents that can be measured, as in its SQL; the operator has a row for the others as well."""
    found = layout.detect_layout(_lines(spark, sf_dir), table(spark, sf_dir, "documents_meta"))
    return found.filter(~F.col("status").isin(*layout.UNMEASURED))


def _sided(spark, sf_dir):
    lines = _kept_lines(spark, sf_dir)
    return layout.reading_order(layout.assign_columns(lines, layout.detect_layout(lines, table(spark, sf_dir, "documents_meta"))))


def reading_order(spark, sf_dir):
    return _sided(spark, sf_dir).select("doc_id", "seq", "side", "place")


def column_text(spark, sf_dir):
    return layout.column_text(_sided(spark, sf_dir))


def merge_page_breaks(spark, sf_dir):
    return chunking.merge_page_breaks(_paragraphs(spark, sf_dir))


def _paragraphs(spark, sf_dir):
    return table(spark, sf_dir, "paragraphs").select("doc_id", "para_seq", "page", "block", "text").distinct()


def classify_paragraphs(spark, sf_dir):
    paragraphs, status = pipelines.column_paragraphs(_kept_lines(spark, sf_dir), table(spark, sf_dir, "documents_meta"))
    kinds = chunking.classify(paragraphs).select("doc_id", "para_seq", "kind", "section", "subsection", "heading", "part")
    return pipelines.with_status(kinds, status)


def chunk_sections(spark, sf_dir):
    return pipelines.build_chunks(_kept_lines(spark, sf_dir), table(spark, sf_dir, "documents_meta"))


def split_items(spark, sf_dir):
    return _chunks(spark, sf_dir).select(*CHUNK_KEYS, F.posexplode(chunking.split_items(F.col("text"))).alias("piece_no", "piece"))


def chunk_fingerprint(spark, sf_dir):
    return tables.fingerprint(_chunks(spark, sf_dir), "lexvec-a", CHUNK_KEYS)


def missing_questions(spark, sf_dir):
    cache = table(spark, sf_dir, "query_embeddings").withColumnRenamed("embeddings", "embedding")
    return tables.missing_questions(cache.filter("question IS NOT NULL").select("question"), cache, "lexvec-a")


def queries() -> dict:
    names = """bm25_topk token_counts doc_lengths idf_table bm25_postings l2_normalize cosine_topk support_score support_distribution
    retrieval_eval_rollup retrieval_ranks rrf_fusion parse_citation_query structured_lookup hybrid_retrieve ablation_compare retrieval_misses cited_provisions citation_audit
    answer_warnings refusal_rate context_build hyphen_vocabulary running_headers header_islands front_matter paragraphs_from_lines detect_layout
    reading_order column_text merge_page_breaks classify_paragraphs chunk_sections split_items chunk_fingerprint missing_questions
    semantic_chunks cached_semantic_chunks misses_wanted support_separation eval_wanted negatives_by_difficulty shared_sources index_roundtrip
    query_cache_warmed documents_from_files refusal_report""".split()
    return {n: globals()[n] for n in names}


_TOKENS = "regexp_extract_all(lower({}), '[a-z0-9]+(?:-[a-z0-9]+)*')"
_CITATION = """CASE WHEN part = 'SCHEDULE' THEN CASE WHEN coalesce(section,'') = '' THEN 'Schedule' ELSE 'Schedule, item ' || section END
  WHEN coalesce(section,'') = '' THEN '(uncited)' ELSE 's. ' || section || CASE WHEN coalesce(subsection,'') <> '' THEN '(' || subsection || ')' ELSE '' END END"""
_CHUNKS = f"""c AS (SELECT *, {_CITATION} citation, concat_ws(' ', {_CITATION}, nullif(heading,''), text) indexed
  FROM (SELECT DISTINCT doc_id, chunk_seq, text, section, subsection, heading, part FROM chunks))"""
def _postings(source: str, keys: str, n: str = "") -> str:
    """CTEs of the postings (term, keys, tf, impact) of ``source``; names end with ``n``."""
    same = " AND ".join(f"tf{n}.{k.strip()} = t{n}.{k.strip()}" for k in keys.split(","))
    columns = ", ".join(f"tf{n}.{k.strip()}" for k in keys.split(","))
    return f"""t{n} AS (SELECT {keys}, {_TOKENS.format('indexed')} tokens FROM {source}),
  whole{n} AS (SELECT count(*) n, avg(len(tokens)) average FROM t{n}),
  tf{n} AS (SELECT {keys}, term, count(*) tf FROM (SELECT {keys}, unnest(tokens) term FROM t{n}) GROUP BY ALL),
  df{n} AS (SELECT term, count(*) df FROM tf{n} GROUP BY term),
  p{n} AS (SELECT tf{n}.term, {columns}, tf{n}.tf, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf{n}.tf * 2.5 / (tf{n}.tf + 1.5 * (0.25 + 0.75 * len(tokens) / average)) impact
    FROM tf{n} JOIN df{n} ON tf{n}.term = df{n}.term JOIN t{n} ON {same} CROSS JOIN whole{n})"""


_POSTINGS = f"{_CHUNKS}, {_postings('c', 'doc_id, chunk_seq')}"


def _ranked(key: str, source: str, column: str, k: int, name: str) -> str:
    """CTEs of the k best chunks of each query by BM25."""
    return f"""{name}q AS (SELECT {key}, term, count(*) qtf FROM (SELECT {key}, unnest({_TOKENS.format(column)}) term FROM {source}) GROUP BY ALL),
  {name}s AS (SELECT {key}, doc_id, chunk_seq, round(sum(impact * qtf), 9) score FROM p JOIN {name}q ON p.term = {name}q.term GROUP BY ALL),
  {name} AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY {key} ORDER BY score DESC, doc_id, chunk_seq) AS INTEGER) rk FROM {name}s) WHERE rk <= {k})"""


_UNIT = """u AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / greatest(sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))), 1e-12)) v FROM embeddings)"""
_NEAR = f"""{_UNIT}, s AS (SELECT q.vec_id query_id, b.vec_id, b.label, round(list_sum(list_transform(range(1, len(b.v) + 1), lambda i: q.v[i] * b.v[i])), 9) score
  FROM u q JOIN u b ON q.vec_id % 100 = 0)"""
_LABELLED = f"""{_NEAR}, r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) rk FROM s WHERE vec_id <> query_id) WHERE rk <= 5)"""
_RANKS = f"""{_LABELLED}, e AS (SELECT vec_id case_id, 0 exp_no, label l, 'L' || label category FROM embeddings WHERE vec_id % 100 = 0
    UNION ALL SELECT vec_id, 1, (label + 1) % 10, 'L' || label FROM embeddings WHERE vec_id % 100 = 0),
  x AS (SELECT case_id, exp_no, category, min(rk) rank FROM e LEFT JOIN r ON r.query_id = e.case_id AND r.label = e.l GROUP BY ALL)"""
_PARSED = r"""(?i)\b(?:sub)?section\s+(\d+(?:\.\d+)?)(?:\s*\((\d+)\))?|\bs\.\s*(\d+(?:\.\d+)?)"""
_PARSE = f"""parsed AS (SELECT * FROM (SELECT query_id, coalesce(nullif(regexp_extract(question, '{_PARSED}', 1), ''), nullif(regexp_extract(question, '{_PARSED}', 3), '')) section,
  nullif(regexp_extract(question, '{_PARSED}', 2), '') subsection FROM {{}}) WHERE section IS NOT NULL)"""
_ASKED = "asked AS (SELECT DISTINCT query_id, question FROM query_embeddings WHERE question IS NOT NULL)"


def _lookup(chunks: str, keys: str) -> str:
    return f"""lookup AS (SELECT * FROM (SELECT query_id, {keys}, CAST(row_number() OVER (PARTITION BY query_id ORDER BY
    CASE WHEN q.subsection IS NULL OR c.subsection IS NOT DISTINCT FROM q.subsection THEN 0 ELSE 1 END,
    CASE WHEN coalesce(c.subsection,'') = '' THEN 0 ELSE coalesce(try_cast(c.subsection AS INTEGER), 999) END, {keys}) AS INTEGER) rk
  FROM parsed q JOIN {chunks} c ON q.section = c.section AND c.part IS DISTINCT FROM 'SCHEDULE') WHERE rk <= 10)"""


_VALUE_KEY = "sha256(concat_ws(chr(0), " + ", ".join(f"coalesce({c}::VARCHAR, chr(1))" for c in VALUES) + "))"
_INDEX = f"""i AS (SELECT *, {_VALUE_KEY} chunk_key, {_CITATION} citation, concat_ws(' ', {_CITATION}, nullif(heading,''), text) indexed FROM (SELECT DISTINCT {', '.join(VALUES)} FROM chunks))"""


def _vectors(name: str, key: str, text: str, source: str) -> str:
    """CTEs of (key, v): counts of tokens by first letter, last letter and length, at length 1."""
    place = "(ascii(t) * 31 + ascii(right(t, 1)) * 7 + length(t)) % 64"
    return f"""{name}0 AS (SELECT {key}, list_transform({_TOKENS.format(text)}, lambda t: {place}) places FROM {source}),
  {name}1 AS (SELECT {key}, list_transform(range(0, 64), lambda d: len(list_filter(places, lambda p: p = d))::DOUBLE) v FROM {name}0),
  {name} AS (SELECT {key}, list_transform(v, lambda x: x / greatest(sqrt(list_sum(list_transform(v, lambda y: y * y))), 1e-12)) v FROM {name}1)"""


_QUESTIONS = "asked AS (SELECT case_id query_id, question FROM eval_cases)"
_SEMANTIC = f"""{_INDEX}, {_QUESTIONS}, {_vectors('qv', 'query_id', 'question', 'asked')}, {_vectors('cv', 'chunk_key', 'indexed', 'i')},
  near AS (SELECT query_id, chunk_key, round(list_inner_product(qv.v, cv.v), 9) score FROM qv CROSS JOIN cv),
  semantic AS (SELECT * FROM (SELECT query_id, chunk_key, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_key) AS INTEGER) rank FROM near) WHERE rank <= 100)"""
_HYBRID = f"""{_SEMANTIC}, {_PARSE.format('asked')}, {_lookup('i', 'chunk_key')}, {_postings('i', 'chunk_key', 'k')},
  words AS (SELECT query_id, term, count(*) qtf FROM (SELECT query_id, unnest({_TOKENS.format('question')}) term FROM asked) GROUP BY ALL),
  scored AS (SELECT query_id, chunk_key, round(sum(impact * qtf), 9) score FROM pk JOIN words ON pk.term = words.term GROUP BY ALL),
  keyword AS (SELECT * FROM (SELECT query_id, chunk_key, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_key) AS INTEGER) rank FROM scored) WHERE rank <= 100),
  rankings AS (SELECT *, 0 no FROM semantic UNION ALL SELECT *, 1 FROM keyword),
  fused0 AS (SELECT query_id, chunk_key, round(sum(1.0::DOUBLE / (60 + rank)), 12) rrf, min(no * 1000 + rank) first FROM rankings GROUP BY ALL),
  fused AS (SELECT query_id, chunk_key, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, first, chunk_key) AS INTEGER) place FROM fused0),
  both_lists AS (SELECT query_id, chunk_key, 0 src, rk place FROM lookup UNION ALL SELECT query_id, chunk_key, 1, place FROM fused),
  firsts AS (SELECT query_id, chunk_key, min(src * 1000000000 + place) f FROM both_lists GROUP BY ALL),
  hybrid AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY f, chunk_key) AS INTEGER) rk FROM firsts)"""
_CITED = r"""cited AS (SELECT DISTINCT doc_id, chunk_seq, s section, nullif(b, '') subsection FROM (SELECT doc_id, chunk_seq,
  unnest(regexp_extract_all(text, '\bs\.\s*(\d+(?:\.\d+)?)(?:\s*\((\d+)\))?', 1)) s, unnest(regexp_extract_all(text, '\bs\.\s*(\d+(?:\.\d+)?)(?:\s*\((\d+)\))?', 2)) b FROM c))"""
_AUDIT = rf"""{_CHUNKS}, {_CITED}, audited AS (SELECT q.doc_id, q.chunk_seq, 's. ' || section || CASE WHEN subsection IS NOT NULL THEN '(' || subsection || ')' ELSE '' END label,
  CASE WHEN EXISTS (SELECT 1 FROM c WHERE c.doc_id = q.doc_id AND c.section = q.section AND (q.subsection IS NULL OR coalesce(c.subsection,'') = q.subsection)) THEN 'grounded'
    WHEN EXISTS (SELECT 1 FROM c WHERE c.doc_id = q.doc_id AND c.section = q.section) THEN 'unsupported'
    WHEN EXISTS (SELECT 1 FROM c WHERE c.doc_id = q.doc_id AND regexp_matches(c.text, '\b' || replace(q.section, '.', '\.') || '\b')) THEN 'cross_referenced' ELSE 'unsupported' END status
  FROM cited q)"""
_LINES = "l AS (SELECT DISTINCT doc_id, seq, page, block, x0, y0, text FROM lines)"
_LAYOUT = f"""{_LINES}, a AS (SELECT l.doc_id, seq, page_width w, round_even(x0, 0) x FROM l JOIN documents_meta m ON l.doc_id = m.doc_id WHERE page_width > 0 AND x0 IS NOT NULL),
  k AS (SELECT doc_id, w, x, count(*) n, min(seq) f FROM a GROUP BY ALL),
  h AS (SELECT *, row_number() OVER (PARTITION BY doc_id, x < w / 2 ORDER BY n DESC, f) b FROM k),
  g AS (SELECT doc_id, w, sum(n)::BIGINT n_lines, max(CASE WHEN b = 1 AND x < w / 2 THEN x END) lm, max(CASE WHEN b = 1 AND x >= w / 2 THEN x END) rm FROM h GROUP BY doc_id, w),
  d AS (SELECT g.doc_id, lm left_margin, rm right_margin, n_lines, CASE WHEN lm IS NULL OR rm IS NULL THEN 'one half is empty'
    WHEN (SELECT coalesce(sum(n), 0) FROM k WHERE k.doc_id = g.doc_id AND abs(x - lm) <= 2) < 0.15 * n_lines OR (SELECT coalesce(sum(n), 0) FROM k WHERE k.doc_id = g.doc_id AND abs(x - rm) <= 2) < 0.15 * n_lines
      THEN 'a margin is not a column' WHEN (rm - lm) / w < 0.15 THEN 'the margins are indent levels' ELSE 'ok' END status FROM g),
  o AS (SELECT l.*, CASE WHEN x0 < (left_margin + right_margin) / 2 THEN 'left' ELSE 'right' END side FROM l JOIN d ON l.doc_id = d.doc_id AND status = 'ok'),
  ordered AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id, side ORDER BY page NULLS FIRST, y0 NULLS FIRST, x0 NULLS FIRST, seq NULLS FIRST) AS INTEGER) place FROM o)"""
_WS = r"[\s\x{b}\x{1c}-\x{1f}\x{85}\p{Z}]"


def _strip(text: str) -> str:
    return rf"regexp_replace({text}, '^{_WS}+|{_WS}+$', '', 'g')"



def _re(pattern: str) -> str:
    """A pattern of ``functions.text`` for the other engine: its flags go, quotes are doubled."""
    return pattern.replace("(?U)", "").replace("'", "''")


def _paragraphs_sql(lines: str) -> str:
    """CTEs from the CTE ``lines`` to ``paras``: (doc_id, para_seq, page, block, text, status)."""
    t = "y"
    return rf"""pages AS (SELECT doc_id, count(DISTINCT page) doc_pages FROM {lines} GROUP BY doc_id),
  rep AS (SELECT x.doc_id, text FROM {lines} x JOIN pages ON x.doc_id = pages.doc_id GROUP BY x.doc_id, text, doc_pages HAVING count(DISTINCT page) >= 0.3 * doc_pages),
  s AS (SELECT x.*, page_height, rep.text IS NOT NULL AND (y0 < 0.15 * page_height OR y0 > 0.85 * page_height) seed,
    CASE WHEN y0 - lag(y0) OVER (PARTITION BY x.doc_id, page ORDER BY y0 NULLS FIRST, seq) > 20 THEN 1 ELSE 0 END starts
    FROM {lines} x LEFT JOIN (SELECT * FROM documents_meta WHERE page_height > 0) m ON x.doc_id = m.doc_id LEFT JOIN rep ON x.doc_id = rep.doc_id AND x.text = rep.text),
  isl AS (SELECT *, sum(starts) OVER (PARTITION BY doc_id, page ORDER BY y0 NULLS FIRST, seq RANGE UNBOUNDED PRECEDING) island FROM s),
  hd AS (SELECT *, page_height IS NOT NULL AND max(CASE WHEN seed THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page, island) = 1 header FROM isl),
  pp AS (SELECT *, count(*) FILTER (WHERE header) OVER (PARTITION BY doc_id, page) dropped FROM hd),
  js AS (SELECT *, CASE WHEN page_height IS NULL THEN '{cleanup.NO_PAGE_SIZE}' WHEN max(dropped) OVER (PARTITION BY doc_id) > 8 THEN '{cleanup.INTO_BODY}' ELSE 'ok' END st FROM pp),
  fp AS (SELECT doc_id, page, count(*) n, count(*) FILTER (WHERE regexp_matches({_strip('text')}, '^\d+(\.\d+)?$')) numbers FROM js WHERE st = 'ok' AND NOT header GROUP BY doc_id, page),
  fq AS (SELECT *, min(page) OVER (PARTITION BY doc_id) + greatest(1, trunc(0.2 * count(*) OVER (PARTITION BY doc_id))) lim FROM fp),
  front AS (SELECT doc_id, max(page) last_page FROM fq WHERE page < lim AND numbers >= 0.15 * n GROUP BY doc_id),
  fa AS (SELECT js.*, st = 'ok' AND (header OR coalesce(page <= last_page, false)) falls FROM js LEFT JOIN front ON js.doc_id = front.doc_id),
  fb AS (SELECT *, CASE WHEN bool_and(falls) OVER (PARTITION BY doc_id) THEN '{cleanup.NOTHING_LEFT}' ELSE st END status FROM fa),
  voc AS (SELECT doc_id, list(DISTINCT w) vocabulary FROM (SELECT doc_id, unnest(regexp_extract_all(regexp_replace(lower(text), '[À-ÖØ-öø-ʯﬀ-ﬆ]', '_', 'g'), '\b([a-z]+-[a-z]+)\b', 1)) w FROM {lines}) GROUP BY doc_id),
  bl AS (SELECT doc_id, page, block, status, list({_strip("coalesce(text, '')")} ORDER BY y0 NULLS FIRST, x0 NULLS FIRST, seq NULLS FIRST, text) texts FROM fb WHERE status <> 'ok' OR NOT falls GROUP BY ALL),
  jt AS (SELECT bl.doc_id, page, block, status, list_reduce(texts, lambda x, y: CASE WHEN {t} = '' THEN x WHEN x = '' THEN {t}
      WHEN ends_with(x, '-') AND regexp_matches({t}, '^\p{{Ll}}') THEN CASE WHEN list_contains(coalesce(vocabulary, []), lower(regexp_extract(x, '(\S*)$', 1) || split_part({t}, ' ', 1)))
        THEN x || {t} ELSE x[:-2] || {t} END ELSE x || ' ' || {t} END, '') text FROM bl LEFT JOIN voc ON bl.doc_id = voc.doc_id),
  paras AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page NULLS FIRST, block NULLS FIRST) - 1 para_seq, page, block, text, status FROM jt WHERE text <> '')"""


def _merged(paras: str) -> str:
    """CTEs to ``merged``: (doc_id, para_seq, page, block, text) with page breaks joined."""
    return rf"""m0 AS (SELECT *, lag(text) OVER w before, page - lag(page) OVER w step FROM {paras} WINDOW w AS (PARTITION BY doc_id ORDER BY para_seq)),
  m1 AS (SELECT *, coalesce(NOT regexp_matches(before, '[.;:!?]$') AND regexp_matches(text, '^\p{{Ll}}') AND NOT regexp_matches(text, '{_re(T.ITEM)}') AND NOT regexp_matches(text, '{_re(T.SUBSECTION)}'), false)
    AND coalesce(step IN (0, 1), false) fits FROM m0),
  m2 AS (SELECT *, sum(CASE WHEN fits THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY para_seq) run FROM m1),
  m3 AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY doc_id, run ORDER BY para_seq) = 1 THEN 0 ELSE step END hop FROM m2),
  m4 AS (SELECT *, sum(hop) OVER (PARTITION BY doc_id, run ORDER BY para_seq) % 2 = 1 joined FROM m3),
  m5 AS (SELECT *, sum(CASE WHEN joined THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY para_seq) part FROM m4),
  merged AS (SELECT doc_id, min(para_seq) para_seq, arg_min(page, para_seq) page, arg_min(block, para_seq) block, string_agg(text, ' ' ORDER BY para_seq, text) text FROM m5 GROUP BY doc_id, part)"""


def _kind(definitions: str) -> str:
    is_a = lambda *ps: " OR ".join(f"regexp_matches(text, '{_re(p)}')" for p in ps)
    heading = rf"length(text) <= {T.MAX_HEADING_CHARS} AND NOT regexp_matches(text, '[.;:!?,]$') AND NOT ({is_a(T.SECTION_WITH_SUB, T.SECTION, T.SUBSECTION, T.ITEM, T.HISTORY)})"
    banner = f"upper({_strip('text')})"
    return f"""CASE WHEN {banner} IN ('{T.EXCLUDED_BANNERS[0]}', '{T.EXCLUDED_BANNERS[1]}') THEN 'EXCLUDED' WHEN {banner} = '{T.SCHEDULE}' THEN 'SCHEDULE' WHEN {is_a(T.HISTORY, T.REPEALED)} THEN 'SKIP'
    WHEN {is_a(T.PART)} THEN 'PART' WHEN {is_a(T.SECTION_WITH_SUB)} THEN 'SECTION_SUB' WHEN {is_a(T.SECTION)} THEN 'SECTION' WHEN {is_a(T.SUBSECTION)} THEN 'SUBSECTION'
    WHEN {definitions} AND {is_a(T.DEFINITION)} THEN 'DEFINITION' WHEN {heading} THEN 'HEADING' ELSE 'BODY' END"""


def _classified(paras: str) -> str:
    """CTEs to ``kinds``: paragraphs with kind, section, subsection, heading, part."""
    group = lambda p, n: f"regexp_extract(text, '{_re(p)}', {n})"
    starts = "kind IN ('SECTION_SUB', 'SECTION', 'SUBSECTION')"
    so_far = "OVER (PARTITION BY doc_id ORDER BY para_seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    before = so_far.replace("CURRENT ROW", "1 PRECEDING")
    v = lambda x: f"{{{{'v': {x}}}}}".replace("{{", "{").replace("}}", "}")
    none = v("NULL::VARCHAR")
    return rf"""k0 AS (SELECT *, {_kind('false')} kind FROM {paras}),
  k1 AS (SELECT *, bool_or(kind = 'EXCLUDED') {so_far} ended FROM k0),
  k2 AS (SELECT *, coalesce(last_value(CASE WHEN {starts} THEN regexp_matches(text, '{_re(T.OPENS_DEFINITIONS)}') END IGNORE NULLS) {before}, false) defs FROM k1 WHERE NOT ended),
  k3 AS (SELECT * EXCLUDE (kind), {_kind('defs')} kind FROM k2),
  k4 AS (SELECT *,
    last_value(CASE WHEN kind = 'SECTION_SUB' THEN {v(group(T.SECTION_WITH_SUB, 1))} WHEN kind = 'SECTION' THEN {v(group(T.SECTION, 1))} WHEN kind = 'SCHEDULE' THEN {none} END IGNORE NULLS) {so_far} sec,
    last_value(CASE WHEN kind = 'SECTION_SUB' THEN {v(group(T.SECTION_WITH_SUB, 2))} WHEN kind = 'SUBSECTION' THEN {v(group(T.SUBSECTION, 1))} WHEN kind IN ('SECTION', 'SCHEDULE') THEN {none} END IGNORE NULLS) {so_far} sub,
    last_value(CASE WHEN kind = 'PART' THEN {v(group(T.PART, 1))} WHEN kind = 'SCHEDULE' THEN {v(chr(39) + T.SCHEDULE + chr(39))} END IGNORE NULLS) {so_far} par,
    last_value(CASE WHEN kind = 'HEADING' THEN {v('text')} WHEN {starts} OR kind IN ('PART', 'SCHEDULE') THEN {none} END IGNORE NULLS) {before} pen FROM k3),
  kinds AS (SELECT doc_id, para_seq, page, text, kind, sec.v section, sub.v subsection, par.v part,
    CASE WHEN {starts} THEN pen.v WHEN kind = 'DEFINITION' THEN {_strip(group(T.DEFINITION, 1))} END heading FROM k4)"""


def _pieces(text: str) -> str:
    """The list of pieces of ``text``, packed item by item."""
    parts = f"string_split(regexp_replace({text}, '({_re(T.ITEM_MARKER)})', chr(1) || '\\1', 'g'), chr(1))"
    stem = _strip(f"{parts}[1]")
    items = f"list_filter(list_transform({parts}[2:], lambda p: {_strip('p')}), lambda p: p <> '')"
    folded = f"""list_reduce(list_transform({items}, lambda p: {{'done': []::VARCHAR[], 'items': [p], 'n': length(p)::BIGINT}}), lambda x, y: CASE
      WHEN len(x['items']) > 0 AND x.n + y.n > {chunking.MAX_CHUNK_CHARS} THEN {{'done': list_append(x.done, array_to_string(list_prepend({stem}, x['items']), ' ')), 'items': y['items'], 'n': length({stem})::BIGINT + y.n}}
      ELSE {{'done': x.done, 'items': list_concat(x['items'], y['items']), 'n': x.n + y.n}} END, {{'done': []::VARCHAR[], 'items': []::VARCHAR[], 'n': length({stem})::BIGINT}})"""
    return f"""CASE WHEN length({text}) <= {chunking.MAX_CHUNK_CHARS} OR len({items}) = 0 THEN [{text}] ELSE list_transform([{folded}], lambda f: list_append(f.done, array_to_string(list_prepend({stem}, f['items']), ' ')))[1] END"""


_COLUMN = f"""{_LAYOUT}, one_side AS (SELECT doc_id, seq, page, block, x0, y0, text FROM o WHERE side = 'left'), {_paragraphs_sql('one_side')},
  own AS (SELECT doc_id, any_value(status) own FROM paras GROUP BY doc_id),
  status AS (SELECT u.doc_id, CASE WHEN NOT coalesce(page_width > 0, false) THEN '{layout.UNMEASURED[0]}' WHEN d.status IS NULL THEN '{layout.UNMEASURED[1]}' WHEN d.status <> 'ok' THEN d.status ELSE coalesce(own, '{cleanup.NOTHING_LEFT}') END st
    FROM (SELECT DISTINCT doc_id FROM l) u LEFT JOIN documents_meta m ON m.doc_id = u.doc_id LEFT JOIN d ON d.doc_id = u.doc_id LEFT JOIN own ON own.doc_id = u.doc_id)"""


def _with_status(rows: str, columns: str) -> str:
    named = ", ".join(f"r.{c}" for c in columns.split(", ")[1:])
    return f"SELECT status.doc_id, {named}, CASE WHEN r.doc_id IS NULL AND st = 'ok' THEN '{cleanup.NOTHING_LEFT}' ELSE st END status FROM status LEFT JOIN {rows} r ON r.doc_id = status.doc_id"


_CHUNKED = f"""{_COLUMN}, {_merged('paras')}, {_classified('merged')},
  b0 AS (SELECT *, kind IN ('SECTION_SUB', 'SECTION', 'SUBSECTION', 'DEFINITION') opens, kind IN ('PART', 'SCHEDULE', 'EXCLUDED') closes FROM kinds),
  b1 AS (SELECT *, sum(CASE WHEN opens OR closes THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY para_seq) boundary,
    last_value(CASE WHEN opens THEN true WHEN closes THEN false END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY para_seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) is_open FROM b0),
  b2 AS (SELECT doc_id, boundary, arg_min({{'a': section, 'b': subsection, 'c': heading, 'd': part}}, para_seq) m, {_strip("string_agg(text, ' ' ORDER BY para_seq, text)")} whole, list_sort(list(DISTINCT page)) pages
    FROM b1 WHERE is_open AND (opens OR kind = 'BODY') GROUP BY doc_id, boundary),
  b3 AS (SELECT doc_id, boundary, m, pages, {_pieces('whole')} pieces FROM b2),
  b4 AS (SELECT doc_id, boundary, m.a section, m.b subsection, m.c heading, m.d part, pages, unnest(pieces) piece, generate_subscripts(pieces, 1) no FROM b3),
  made AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY boundary, no) - 1 chunk_seq,
    CASE WHEN coalesce(heading, '') <> '' AND NOT starts_with(piece, heading) THEN heading || chr(10) || piece ELSE piece END text, section, subsection, heading, part, pages, {_CITATION} citation FROM b4)"""
_REPEATED = f"""{_LINES}, pages AS (SELECT doc_id, count(DISTINCT page) doc_pages FROM l GROUP BY doc_id),
  rep AS (SELECT l.doc_id, text, count(DISTINCT page) n_pages, doc_pages FROM l JOIN pages ON l.doc_id = pages.doc_id GROUP BY l.doc_id, text, doc_pages HAVING count(DISTINCT page) >= 0.3 * doc_pages)"""


def oracle_sql() -> dict:
    labels = lambda s: f"nullif(string_agg(DISTINCT CASE WHEN status = '{s}' THEN label END, ', ' ORDER BY CASE WHEN status = '{s}' THEN label END), '')"
    fused = "round(sum(1.0::DOUBLE / (60 + rank)), 12)"
    return {
        "bm25_topk": f"WITH {_POSTINGS}, {_ranked('case_id', 'eval_cases', 'question', 10, 'r')} SELECT case_id, doc_id, chunk_seq, score, rk FROM r",
        "token_counts": f"SELECT doc_id, term, count(*) tf FROM (SELECT doc_id, unnest({_TOKENS.format('text')}) term FROM documents) GROUP BY ALL",
        "doc_lengths": f"SELECT doc_id, coalesce(len({_TOKENS.format('text')}), 0)::BIGINT len FROM documents",
        "idf_table": f"""WITH t AS (SELECT DISTINCT doc_id, unnest({_TOKENS.format('text')}) term FROM documents), n AS (SELECT count(*) n FROM documents)
          SELECT term, count(*) df, round(ln(1 + (max(n) - count(*) + 0.5) / (count(*) + 0.5)), 9) idf FROM t CROSS JOIN n GROUP BY term""",
        "bm25_postings": f"WITH {_POSTINGS} SELECT term, doc_id, chunk_seq, tf, round(impact, 9) impact FROM p",
        "l2_normalize": f"WITH {_UNIT} SELECT u.vec_id, round(sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))), 9) norm, round(v[1], 9) \"first\", len(v)::INTEGER dims FROM u JOIN embeddings e ON u.vec_id = e.vec_id",
        "cosine_topk": f"WITH {_NEAR} SELECT query_id, vec_id, score, rk FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) rk FROM s) WHERE rk <= 10",
        "support_score": f"WITH {_LABELLED} SELECT vec_id query_id, coalesce(support, 0.0::DOUBLE) support FROM embeddings LEFT JOIN (SELECT query_id, max(score) support FROM r GROUP BY query_id) x ON x.query_id = vec_id WHERE vec_id % 100 = 0",
        "support_distribution": f"""WITH {_LABELLED}, x AS (SELECT query_id, max(score) support FROM r GROUP BY query_id)
          SELECT label grp, count(*) n, min(support) min_s, list_sort(list(support))[count(*) // 2 + 1] upper_median_s, max(support) max_s FROM x JOIN embeddings ON vec_id = query_id GROUP BY label""",
        "retrieval_ranks": f"WITH {_RANKS} SELECT case_id, exp_no, CAST(rank AS INTEGER) rank FROM x",
        "retrieval_eval_rollup": f"""WITH {_RANKS}, m AS (SELECT case_id, category, min(rank) f, avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0.0 END) c1, avg(CASE WHEN rank <= 3 THEN 1.0 ELSE 0.0 END) c3,
            avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END) c5 FROM x GROUP BY ALL)
          SELECT category, CAST(grouping(category) AS INTEGER) is_total, count(*) n, round(avg(CASE WHEN f <= 1 THEN 1.0 ELSE 0.0 END), 9) hit1, round(avg(CASE WHEN f <= 3 THEN 1.0 ELSE 0.0 END), 9) hit3,
            round(avg(CASE WHEN f <= 5 THEN 1.0 ELSE 0.0 END), 9) hit5, round(avg(c1), 9) coverage1, round(avg(c3), 9) coverage3, round(avg(c5), 9) coverage5, round(avg(coalesce(1.0::DOUBLE / f, 0)), 9) mrr
          FROM m GROUP BY ROLLUP (category)""",
        "rrf_fusion": f"""WITH {_POSTINGS}, {_ranked('case_id', 'eval_cases', 'question', 20, 'r')}, {_ranked('case_id', 'eval_cases', 'passage', 20, 'w')},
            b AS (SELECT case_id, 0 ranking_no, rk rank, doc_id || '-' || chunk_seq chunk FROM r UNION ALL SELECT case_id, 1, rk, doc_id || '-' || chunk_seq FROM w),
            f AS (SELECT case_id, chunk, {fused} rrf, min(ranking_no * 1000 + rank) first FROM b GROUP BY ALL)
          SELECT case_id, chunk, rrf, rk FROM (SELECT *, CAST(row_number() OVER (PARTITION BY case_id ORDER BY rrf DESC, first, chunk) AS INTEGER) rk FROM f) WHERE rk <= 10""",
        "parse_citation_query": f"WITH {_PARSE.format('query_embeddings')} SELECT * FROM parsed",
        "structured_lookup": f"WITH {_CHUNKS}, {_ASKED}, {_PARSE.format('asked')}, {_lookup('c', 'doc_id, chunk_seq')} SELECT * FROM lookup",
        "semantic_chunks": f"WITH {_SEMANTIC} SELECT query_id, chunk_key, rank FROM semantic WHERE rank <= 10",
        "cached_semantic_chunks": f"WITH {_SEMANTIC} SELECT query_id, chunk_key, rank FROM semantic WHERE rank <= 10",
        "hybrid_retrieve": f"""WITH {_HYBRID} SELECT query_id, chunk_key chunk, CASE WHEN f < 1000000000 THEN 'structured' ELSE 'fusion' END source, rk FROM hybrid WHERE rk <= 10""",
        "ablation_compare": f"""WITH {_HYBRID}, got AS (SELECT 'semantic' retriever, query_id, chunk_key, rank rk FROM semantic UNION ALL SELECT 'bm25', query_id, chunk_key, rank FROM keyword
              UNION ALL SELECT 'fusion', query_id, chunk_key, place FROM fused UNION ALL SELECT 'hybrid', query_id, chunk_key, rk FROM hybrid),
            f AS (SELECT names.retriever, parsed.query_id, min(got.rk) FILTER (WHERE i.section = parsed.section) f FROM (VALUES ('semantic'), ('bm25'), ('fusion'), ('hybrid')) names(retriever) CROSS JOIN parsed
              LEFT JOIN got ON got.retriever = names.retriever AND got.query_id = parsed.query_id AND got.rk <= 10 LEFT JOIN i ON i.chunk_key = got.chunk_key GROUP BY ALL)
          SELECT retriever, count(*) n, round(avg(CASE WHEN f <= 1 THEN 1.0 ELSE 0.0 END), 9) hit1, round(avg(CASE WHEN f <= 3 THEN 1.0 ELSE 0.0 END), 9) hit3,
            round(avg(CASE WHEN f <= 5 THEN 1.0 ELSE 0.0 END), 9) hit5, round(avg(coalesce(1.0::DOUBLE / f, 0)), 9) mrr FROM f GROUP BY retriever""",
        "misses_wanted": f"""WITH {_LABELLED}, m AS (SELECT vec_id case_id, label own FROM embeddings e WHERE vec_id % 100 = 0 AND NOT EXISTS (SELECT 1 FROM r WHERE r.query_id = e.vec_id AND r.label = e.label))
          SELECT case_id, 'L' || own || '; L' || (own + 1) % 10 wanted, CAST(rk AS INTEGER) rk, 'L' || label citation, vec_id::VARCHAR "label" FROM m LEFT JOIN r ON r.query_id = m.case_id AND rk <= 3""",
        "support_separation": f"""WITH {_LABELLED}, x AS (SELECT query_id, max(score) support FROM r GROUP BY query_id)
          SELECT round(min(support) FILTER (WHERE label = 0) - max(support) FILTER (WHERE label = 1), 9) gap FROM x JOIN embeddings ON vec_id = query_id""",
        "eval_wanted": """WITH e AS (SELECT *, row_number() OVER (ORDER BY case_id) - 1 n FROM eval_cases)
          SELECT n case_id, 0 exp_no, category wanted, question FROM e UNION ALL
          SELECT n, 1, category || CASE WHEN difficulty IS NULL THEN '' ELSE ' [' || difficulty || ']' END || ' or ' || lang, question FROM e""",
        "negatives_by_difficulty": """SELECT difficulty, CAST(row_number() OVER (PARTITION BY difficulty ORDER BY question, case_id) AS INTEGER) place, question, category why FROM eval_cases""",
        "shared_sources": "SELECT source FROM documents_meta WHERE medium = 'print' AND source IS NOT NULL INTERSECT SELECT source FROM documents_meta WHERE medium = 'scan'",
        "index_roundtrip": f"WITH {_INDEX} SELECT chunk_key, citation, 64 dims FROM i",
        "query_cache_warmed": """SELECT DISTINCT question, NOT EXISTS (SELECT 1 FROM query_embeddings c WHERE c.model = 'lexvec-a' AND c.embeddings IS NOT NULL AND c.question = q.question) added
          FROM query_embeddings q WHERE question IS NOT NULL""",
        "documents_from_files": rf"""SELECT source, count(*) n_lines, count(DISTINCT page) n_pages, 612.0::DOUBLE page_width FROM lines
          WHERE source IS NOT NULL AND regexp_matches(text, '[^\s\p{{Z}}\x{{b}}\x{{1c}}-\x{{1f}}\x{{85}}]') GROUP BY source""",
        "refusal_report": f"""WITH {_AUDIT}, n AS (SELECT doc_id, chunk_seq, max(CASE WHEN status = 'unsupported' THEN 1 ELSE 0 END) u, max(CASE WHEN status = 'cross_referenced' THEN 1 ELSE 0 END) x FROM audited GROUP BY ALL),
            r AS (SELECT c.doc_id, c.chunk_seq, coalesce(part, '') <> 'SCHEDULE' answerable, NOT coalesce(regexp_matches(text, '\\bs\\.\\s*\\d'), false) declined, u, x
              FROM c LEFT JOIN n ON n.doc_id = c.doc_id AND n.chunk_seq = c.chunk_seq)
          SELECT answerable, count(*) n, count(*) FILTER (WHERE declined) declined, count(*) FILTER (WHERE declined AND answerable) false_declines, coalesce(sum(u), 0)::BIGINT unsupported,
            coalesce(sum(x), 0)::BIGINT cross_referenced FROM r GROUP BY answerable""",
        "retrieval_misses": f"""WITH {_LABELLED}, m AS (SELECT vec_id case_id FROM embeddings e WHERE vec_id % 100 = 0 AND NOT EXISTS (SELECT 1 FROM r WHERE r.query_id = e.vec_id AND r.label = e.label))
          SELECT case_id, CAST(rk AS INTEGER) rk, 'L' || label citation, vec_id::VARCHAR "label" FROM m LEFT JOIN r ON r.query_id = m.case_id AND rk <= 3""",
        "cited_provisions": f"WITH {_CHUNKS}, {_CITED} SELECT * FROM cited",
        "citation_audit": f"WITH {_AUDIT} SELECT * FROM audited",
        "answer_warnings": f"""WITH {_AUDIT}, b AS (SELECT doc_id, chunk_seq, {labels('grounded')} grounded, {labels('cross_referenced')} cross_referenced, {labels('unsupported')} unsupported FROM audited GROUP BY doc_id, chunk_seq)
          SELECT *, 'WARNING: not in the retrieved provisions: ' || unsupported warning, 'Note: mentioned but not retrieved: ' || cross_referenced note FROM b""",
        "refusal_rate": f"WITH {_CHUNKS} SELECT part, count(*) n, count(*) FILTER (WHERE NOT coalesce(regexp_matches(text, '\\bs\\.\\s*\\d'), false)) declined FROM c GROUP BY part",
        "context_build": f"""WITH {_POSTINGS}, {_ranked('case_id', 'eval_cases', 'question', 3, 'r')}
          SELECT case_id, string_agg('[' || citation || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY rk) context FROM r JOIN c ON r.doc_id = c.doc_id AND r.chunk_seq = c.chunk_seq GROUP BY case_id""",
        "hyphen_vocabulary": "SELECT DISTINCT doc_id, unnest(regexp_extract_all(regexp_replace(lower(text), '[À-ÖØ-öø-ʯﬀ-ﬆ]', '_', 'g'), '\\b([a-z]+-[a-z]+)\\b', 1)) term FROM lines",
        "running_headers": f"WITH {_REPEATED} SELECT doc_id, text, n_pages, doc_pages FROM rep",
        "header_islands": f"""WITH {_REPEATED}, s AS (SELECT l.*, rep.text IS NOT NULL AND (y0 < 0.15 * page_height OR y0 > 0.85 * page_height) seed,
            CASE WHEN y0 - lag(y0) OVER (PARTITION BY l.doc_id, page ORDER BY y0 NULLS FIRST, seq) > 20 THEN 1 ELSE 0 END starts
            FROM l JOIN documents_meta m ON l.doc_id = m.doc_id AND page_height > 0 LEFT JOIN rep ON l.doc_id = rep.doc_id AND l.text = rep.text),
          i AS (SELECT *, sum(starts) OVER (PARTITION BY doc_id, page ORDER BY y0 NULLS FIRST, seq RANGE UNBOUNDED PRECEDING) island FROM s),
          j AS (SELECT *, max(CASE WHEN seed THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page, island) header FROM i)
          SELECT doc_id, count(*) n_lines, count(*) FILTER (WHERE header = 1) n_headers FROM j GROUP BY doc_id""",
        "front_matter": rf"""WITH {_LINES}, p AS (SELECT doc_id, page, count(*) n, count(*) FILTER (WHERE regexp_matches(trim(text), '^\d+(\.\d+)?$')) numbers FROM l GROUP BY doc_id, page),
          q AS (SELECT *, min(page) OVER (PARTITION BY doc_id) + greatest(1, trunc(0.2 * count(*) OVER (PARTITION BY doc_id))) lim FROM p)
          SELECT doc_id, max(page) last_page FROM q WHERE page < lim AND numbers >= 0.15 * n GROUP BY doc_id""",
        "detect_layout": f"WITH {_LAYOUT} SELECT * FROM d",
        "reading_order": f"WITH {_LAYOUT} SELECT doc_id, seq, side, place FROM ordered",
        "column_text": f"WITH {_LAYOUT} SELECT doc_id, side, string_agg(text, chr(10) ORDER BY place) text FROM ordered GROUP BY doc_id, side",
        "paragraphs_from_lines": f"WITH {_LINES}, {_paragraphs_sql('l')} SELECT * FROM paras",
        "merge_page_breaks": f"WITH q AS (SELECT DISTINCT doc_id, para_seq, page, block, text FROM paragraphs), {_merged('q')} SELECT * FROM merged",
        "classify_paragraphs": f"WITH {_COLUMN}, {_classified('paras')} " + _with_status("kinds", "doc_id, para_seq, kind, section, subsection, heading, part"),
        "chunk_sections": f"WITH {_CHUNKED} " + _with_status("made", "doc_id, chunk_seq, text, section, subsection, heading, part, pages, citation"),
        "split_items": f"""WITH c AS (SELECT DISTINCT doc_id, chunk_seq, text, section, subsection, heading, part FROM chunks), s AS (SELECT doc_id, chunk_seq, {_pieces('text')} pieces FROM c)
          SELECT doc_id, chunk_seq, unnest(pieces) piece, CAST(generate_subscripts(pieces, 1) - 1 AS INTEGER) piece_no FROM s""",
        "chunk_fingerprint": f"""WITH {_CHUNKS}, h AS (SELECT sha256(concat_ws(chr(0), doc_id::VARCHAR, chunk_seq::VARCHAR, coalesce(text, chr(1)))) h FROM c)
          SELECT sha256('lexvec-a|' || count(*) || '|' || sum(('0x' || h[1:12])::BIGINT)::HUGEINT || '|' || sum(('0x' || h[13:24])::BIGINT)::HUGEINT) fingerprint FROM h""",
        "missing_questions": "SELECT question FROM query_embeddings q WHERE question IS NOT NULL AND NOT EXISTS (SELECT 1 FROM query_embeddings c WHERE c.model = 'lexvec-a' AND c.embeddings IS NOT NULL AND c.question = q.question)",
    }
