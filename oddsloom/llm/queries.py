"""Registered queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from oddsloom.llm.decontaminate import op1_decontamination
from oddsloom.llm.embedding_dedup import op10_embedding_near_dedup
from oddsloom.llm.html_text import op6_html_extraction
from oddsloom.llm.katz import op9_lm_scoring
from oddsloom.llm.language_id import op5_language_id
from oddsloom.llm.license_scan import BASE, BLOCK_WORDS, TEMPLATES, THRESHOLD_PERCENT, op8_license_scans
from oddsloom.llm.lockstep import op13_cross_tokenizer_alignment
from oddsloom.llm.merkle import op11_merkle_manifest
from oddsloom.llm.ngram_jaccard import op2_ngram_jaccard_join
from oddsloom.llm.packing import op12_packing
from oddsloom.llm.piece_codec import op4_piece_encoding
from oddsloom.llm.toxicity import op7_toxicity
from oddsloom.llm.warc import op3_warc

QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_warc": op3_warc,
    "op4_piece_encoding": op4_piece_encoding,
    "op5_language_id": op5_language_id,
    "op6_html_extraction": op6_html_extraction,
    "op7_toxicity": op7_toxicity,
    "op8_license_scans": op8_license_scans,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_embedding_near_dedup": op10_embedding_near_dedup,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_packing": op12_packing,
    "op13_cross_tokenizer_alignment": op13_cross_tokenizer_alignment,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Smallest id that can be reached over ``links(a, b)`` (both ways), for the ids that have one.
_REACHED = """reached AS (SELECT a AS id, a AS spot FROM links UNION SELECT r.id, l.b FROM reached r JOIN links l ON r.spot = l.a),
 component AS (SELECT id, min(spot) AS component FROM reached GROUP BY id)"""


def _license_sql() -> str:
    known = ", ".join(f"({k}, '{label}', {sorted(set(words.split()))!r})" for k, (label, words) in enumerate(TEMPLATES))
    base = ", ".join(f"('{label}', {phrase.split()!r})" for label, phrase in BASE.items())
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    return f"""WITH d AS (SELECT doc_id, {_LOWER} AS t FROM documents), w AS (SELECT doc_id, t, regexp_extract_all(t, '{word}') AS w FROM d),
 base(label, phrase) AS (VALUES {base}), template(n, label, words) AS (VALUES {known}),
 places AS (SELECT doc_id, label, unnest(list_filter(range(len(w)), lambda i: w[i + 1 : i + len(phrase)] = phrase)) AS place FROM w, base WHERE contains(t, 'license')),
 b AS (SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list_sort(list(DISTINCT label)) AS labels FROM places GROUP BY 1),
 line AS (SELECT doc_id, generate_subscripts(l, 1) AS line, unnest(l) AS x FROM (SELECT doc_id, string_split(t, chr(10)) AS l FROM d)),
 lw AS (SELECT doc_id, line, regexp_extract_all(x, '{word}') AS w FROM line),
 block AS (SELECT doc_id, line, 0 AS k, w FROM lw WHERE len(w) BETWEEN 1 AND {BLOCK_WORDS} UNION ALL SELECT doc_id, line, unnest(range(0, len(w), {BLOCK_WORDS // 2})) AS k, w[k + 1 : k + {BLOCK_WORDS}] FROM lw WHERE len(w) > {BLOCK_WORDS}),
 met AS (SELECT doc_id, line, k, label, len(list_intersect(words, w)) / len(words) AS part FROM block, template WHERE len(list_intersect(words, w)) * 100 >= {THRESHOLD_PERCENT} * len(words)),
 best AS (SELECT *, max(part) OVER (PARTITION BY doc_id, line, k) AS top FROM met), m AS (SELECT doc_id, list(DISTINCT label) AS labels, max(part) AS score FROM best WHERE part = top GROUP BY 1)
 SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(array_to_string(b.labels, ','), '') AS base_labels,
 coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(m.labels, [])))), ','), '') AS labels, CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(m.score, 0.0) END::DOUBLE AS score
 FROM w LEFT JOIN b ON w.doc_id = b.doc_id LEFT JOIN m ON w.doc_id = m.doc_id"""


def _crc32_sql(digits: str) -> str:
    """CRC-32 of a decimal number's text: two steps of four bits for each character, by the table that the polynomial gives."""
    table = []
    for n in range(16):
        for _ in range(4):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        table.append(n)
    halves = f"flatten(list_transform(string_split({digits}, ''), lambda c: [ascii(c) & 15, ascii(c) >> 4]))"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, {halves}), lambda c, x: xor({table}[(xor(c, x) & 15) + 1], c >> 4)))"


def _merkle_sql() -> str:
    field = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')"
    head = " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars"))
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    up = "list_transform(range(0, len(hs), 8), lambda k: sha256(array_to_string(hs[k + 1 : k + 8], '')))"
    # A node's place on a level, and its siblings there.
    sides = "array_to_string(hs[(i >> (3 * level + 3)) * 8 + 1 : i >> (3 * level)], '') AS l, array_to_string(hs[(i >> (3 * level)) + 2 : (i >> (3 * level + 3)) * 8 + 8], '') AS r"
    return f"""WITH RECURSIVE d AS (SELECT doc_id, lang, sha256({head} || {field("text")}) AS leaf, CASE WHEN {_crc32_sql("CAST(doc_id AS VARCHAR)")} % 3 = 0 THEN sha256({head} || {field(lowered)}) END AS changed FROM documents),
 n AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, row_number() OVER () AS row FROM d),
 tree AS (SELECT lang, 0 AS level, list(leaf ORDER BY i) AS hs FROM n GROUP BY lang UNION ALL SELECT lang, level + 1, {up} FROM tree WHERE len(hs) > 1),
 sub AS (SELECT lang, hs[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i FROM tree WHERE len(hs) = 1),
 top AS (SELECT 0 AS level, list(subroot ORDER BY i) AS hs FROM sub UNION ALL SELECT level + 1, {up} FROM top WHERE len(hs) > 1),
 step AS (SELECT row, level, {sides} FROM n JOIN tree ON n.lang IS NOT DISTINCT FROM tree.lang WHERE len(hs) > 1
  UNION ALL SELECT row, 100 + level, l, r FROM (SELECT lang, level, {sides} FROM sub, top WHERE len(hs) > 1) t JOIN n ON n.lang IS NOT DISTINCT FROM t.lang),
 steps AS (SELECT row, list({{'l': l, 'r': r}} ORDER BY level) AS s FROM step GROUP BY row),
 found AS (SELECT doc_id, leaf, subroot, (SELECT hs[1] FROM top WHERE len(hs) = 1) AS root, sha256(coalesce(array_to_string(list_transform(s, lambda x: x.l || x.r), ''), '')) AS proof_sha256,
  list_reduce(list_prepend({{'l': coalesce(changed, leaf), 'r': ''}}, coalesce(s, [])), lambda h, x: {{'l': sha256(x.l || h.l || x.r), 'r': ''}}).l AS folded_root
  FROM n JOIN sub ON n.lang IS NOT DISTINCT FROM sub.lang LEFT JOIN steps ON n.row = steps.row)
 SELECT *, folded_root = root AS verified FROM found"""


ORACLE_SQL: dict[str, str] = {
    "op2_ngram_jaccard_join": f"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex({_LOWER}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
 s AS (SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
 e AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM s),
 p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.t = b.t AND a.doc_id < b.doc_id WHERE 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
 links AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p), {_REACHED}
 SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, coalesce(component, doc_id) AS component_id FROM s LEFT JOIN component ON id = doc_id""",
    "op3_warc": """WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS b, sha256(coalesce(html, '')) AS d FROM pages), f AS (SELECT d, min(page_id) AS m FROM p WHERE b >= 100 GROUP BY 1)
 SELECT page_id, b AS payload_bytes, p.d AS payload_digest, CASE WHEN page_id <> m THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id <> m THEN m END AS refers_to FROM p LEFT JOIN f ON p.d = f.d AND b >= 100""",
    "op8_license_scans": _license_sql(),
    "op10_embedding_near_dedup": f"""WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda y: coalesce(isfinite(y), false))) AND list_bool_or(list_transform(embedding, lambda y: y <> 0))),
 links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.9), n AS (SELECT a, count(*) AS n FROM links GROUP BY 1), {_REACHED}
 SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(component, vec_id) AS component_id, coalesce(component, vec_id) = vec_id AS kept FROM embeddings LEFT JOIN n ON a = vec_id LEFT JOIN component ON id = vec_id""",
    "op11_merkle_manifest": _merkle_sql(),
}
