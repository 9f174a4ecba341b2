"""Registered queries of the training-data operators, and SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexspark.llm import alignment, leaks, neighbours, packing, pieces, repeats, scans, stuffed
from lexspark.session import table, written


def p1_found(spark, sf_dir):
    return repeats.find_repeated_lines(table(spark, sf_dir, "lines"), table(spark, sf_dir, "documents_meta"))


def p1_cut_documents(spark, sf_dir):
    return repeats.cut_repeated_lines(table(spark, sf_dir, "lines"), table(spark, sf_dir, "documents_meta"))


def p2_found(spark, sf_dir):
    return neighbours.neighbour_pairs(neighbours.nearest(table(spark, sf_dir, "query_embeddings")))


def _scanned(spark, sf_dir):
    return table(spark, sf_dir, "lines"), table(spark, sf_dir, "paragraphs"), table(spark, sf_dir, "documents_meta")


def p3_found(spark, sf_dir):
    return scans.find_noise(*_scanned(spark, sf_dir))


def p3_paragraphs(spark, sf_dir):
    return scans.repair_scans(*_scanned(spark, sf_dir))


def p4_found(spark, sf_dir):
    return pieces.split_oversized(table(spark, sf_dir, "chunks"))


def p4_pieces(spark, sf_dir):
    chunks = table(spark, sf_dir, "chunks")
    return pieces.cut_text(chunks, pieces.split_oversized(chunks))


def p5_found(spark, sf_dir):
    return alignment.align_sentences(table(spark, sf_dir, "bilingual_documents")).select("doc_id", "left_no", "right_no").distinct()


def p6_pack_documents(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def p6_whole_documents(spark, sf_dir):
    """What any filling must keep: every token of a document once, as few parts as fit, no container over its capacity."""
    packed = written(packing.pack_documents(table(spark, sf_dir, "documents")), "packed")
    over = packing.container_fill(packed).select("container_id", (F.col("unused") < 0).alias("over"))
    by = packed.join(over, "container_id", "left").groupBy("doc_id")
    return by.agg(F.sum("n_tokens").alias("n_tokens"), F.count_distinct("part_no").alias("n_parts"), F.coalesce(F.bool_or("over"), F.lit(False)).alias("over"))


def p7_found(spark, sf_dir):
    return leaks.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_cases"))


def p8_found(spark, sf_dir):
    return stuffed.find_stuffed_pages(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {k: v for k, v in globals().items() if k[:1] == "p" and k[1:2].isdigit()}


_SPACE = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


#: Matches of the Unicode pattern of problem 6, spelled out since ``\\w`` is ASCII here.
_TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\x{b}\x{1c}-\x{1f}\x{85}\p{Z}]"


def _invariant_sql() -> str:
    """``repeats.invariant_text`` in SQL; RE2 has no lookahead, so what follows is captured and put back."""
    sp, word = _SPACE, r"\p{L}[\p{L}.''’-]*"
    steps = [
        (rf"\d+(?:(?:[.,:/]|{sp})*\d+)*(?:st|nd|rd|th|er)?\b", "0"),
        (rf"(?:0(?:,|{sp})*)?\b(?:{'|'.join(repeats.MONTHS)})\b(?:[,.]|{sp})*0(?:(?:,|{sp})*0)*", "0"),
        (rf"\b(by|par){sp}+{word}(?:{sp}+{word}){{0,2}}({sp}*(?:$|[,;|·–—(]))", r"\1 N\2"),
        (rf"^[^\p{{L}}0]*{word}(?:{sp}+{word}){{1,2}}{sp}*([|·,–—]{sp}*0)", r"N \1"),
        (r"[^\p{L}\p{N}]+", ""),
    ]
    out = "lower(text)"
    for pattern, to in steps:
        out = f"regexp_replace({out}, '{pattern}', '{to}', 'g')"
    return out


def oracle_sql() -> dict:
    return {
        "p1_found": f"""WITH pages AS (SELECT DISTINCT doc_id, source FROM documents_meta WHERE medium = 'web' AND source IS NOT NULL),
          size AS (SELECT source, count(DISTINCT doc_id) docs FROM pages GROUP BY source),
          l AS (SELECT DISTINCT l.doc_id, seq, p.source, {_invariant_sql()} k FROM lines l JOIN pages p ON l.doc_id = p.doc_id),
          n AS (SELECT source, k, count(DISTINCT doc_id) n FROM l WHERE k <> '' GROUP BY source, k)
          SELECT DISTINCT doc_id, seq FROM l JOIN n ON l.source = n.source AND l.k = n.k JOIN size ON size.source = l.source WHERE n >= 3 AND n >= 0.25 * docs""",
        "p6_whole_documents": rf"""WITH t AS (SELECT doc_id, max(coalesce(len(regexp_extract_all(text, '{_TOKEN}')), 0)) n FROM documents GROUP BY doc_id)
          SELECT doc_id, n n_tokens, greatest(1, (n + 1023) // 1024)::BIGINT n_parts, false "over" FROM t""",
        "p2_found": """WITH v AS (SELECT query_id id, model, embeddings::DOUBLE[] v FROM query_embeddings WHERE query_id IS NOT NULL AND len(embeddings) = 128
            AND len(list_filter(embeddings, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embeddings, lambda x: x <> 0)) > 0),
          u AS (SELECT id, model, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) v FROM v),
          c AS (SELECT a.id, b.id other, round(list_inner_product(a.v, b.v), 6) cosine FROM u a JOIN u b ON a.model IS NOT DISTINCT FROM b.model AND a.id <> b.id),
          r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY cosine DESC, other) k FROM c)
          SELECT DISTINCT least(id, other) query_id_a, greatest(id, other) query_id_b FROM r WHERE k <= 10""",
    }
