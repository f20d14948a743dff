"""The fixtures as SQL, for the statements that say what queries return."""

from __future__ import annotations

from quire.sources.fixtures import ANNOTATORS, CATEGORIES, EVENT_TYPES, LANGUAGES, LAYOUTS


def u(*keys: str) -> str:
    """The uniform number of keys (SQL expressions) joined by '|'."""
    return f"(('0x' || substr(md5(concat_ws('|', {', '.join(keys)})), 1, 13))::BIGINT / 4503599627370496::DOUBLE)"


def pick(x: str, values: list[str]) -> str:
    return f"([{', '.join(repr(v) for v in values)}])[(floor({x} * {len(values)}) + 1)::INT]"


def _e(salt: str) -> str:
    return u("event_id", f"'{salt}'")


EVENTS = f"""
ev0 AS (SELECT *, CASE WHEN event_type = 'signup' OR {_e('start')} < 0.3 THEN 'yes' ELSE 'no' END AS start_page FROM events),
ev1 AS (SELECT *, CASE WHEN {_e('flip')} < 0.1 THEN CASE WHEN start_page = 'yes' THEN 'no' ELSE 'yes' END ELSE start_page END AS predicted_start_page FROM ev0),
ep AS (
  SELECT user_id::VARCHAR AS dossier, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INT AS page_num, event_id AS row_id, event_type AS document_type,
         start_page, predicted_start_page, CASE WHEN {_e('noise')} < 0.15 THEN {pick(_e('alt'), EVENT_TYPES)} ELSE event_type END AS predicted_document_type,
         round(0.2 + 0.8 * {_e('conf')}, 6) AS document_type_confidence,
         round(CASE WHEN predicted_start_page = 'yes' THEN 0.5 + 0.5 * {_e('sp')} ELSE 0.5 * {_e('sp')} END, 6) AS start_probability, value, ts
  FROM ev1),
types AS (SELECT unnest({EVENT_TYPES!r}) AS type)"""

SEGMENTED = EVENTS + """,
es AS (
  SELECT *, (sum((start_page = 'yes' OR page_num = 1)::INT) OVER w - 1)::INT AS true_seg, (sum((predicted_start_page = 'yes' OR page_num = 1)::INT) OVER w - 1)::INT AS pred_seg
  FROM ep WINDOW w AS (PARTITION BY dossier ORDER BY page_num)),
eh AS (SELECT *, min(page_num) OVER (PARTITION BY dossier, true_seg) AS true_head, min(page_num) OVER (PARTITION BY dossier, pred_seg) AS pred_head FROM es)"""

DOCUMENTS = SEGMENTED + """,
dt AS (SELECT dossier, pred_seg AS seg, predicted_document_type AS type, sum(document_type_confidence) AS s, min(page_num) AS f, count(*) AS n, avg(document_type_confidence) AS m FROM es GROUP BY 1, 2, 3),
dr AS (SELECT *, row_number() OVER (PARTITION BY dossier, seg ORDER BY s DESC, f) AS r, (sum(n) OVER (PARTITION BY dossier, seg))::BIGINT AS n_pages, min(f) OVER (PARTITION BY dossier, seg) AS first_page FROM dt),
dd AS (SELECT dossier, seg, n_pages, first_page, type, m AS mean_confidence, (row_number() OVER (PARTITION BY dossier ORDER BY first_page) - 1)::INT AS order_in_dossier, count(*) OVER (PARTITION BY dossier) AS n_segments FROM dr WHERE r = 1),
docs AS (SELECT *, order_in_dossier / greatest(n_segments - 1, 1) AS norm_position FROM dd),
cnt AS (SELECT dossier, type, count(*) AS n FROM docs GROUP BY 1, 2),
dos AS (SELECT DISTINCT dossier FROM docs),
pairs AS (SELECT a.type AS type_a, b.type AS type_b FROM types a JOIN types b ON a.type < b.type)"""

CONVERSATIONS = f"""
c0 AS (SELECT conv_id, turn, conv_id::VARCHAR AS dossier, turn::INT AS page_num, role AS document_type, CASE WHEN role = 'user' THEN 'yes' ELSE 'no' END AS start_page FROM conversations),
cp AS (SELECT dossier, page_num, document_type, start_page, CASE WHEN {u('conv_id', 'turn', "'flip'")} < 0.1 THEN CASE WHEN start_page = 'yes' THEN 'no' ELSE 'yes' END ELSE start_page END AS predicted_start_page,
              {u('conv_id', 'turn', "'score'")} AS noise FROM c0),
cs AS (
  SELECT *, (sum((start_page = 'yes' OR rn = 1)::INT) OVER w - 1)::INT AS true_seg, (sum((predicted_start_page = 'yes' OR rn = 1)::INT) OVER w - 1)::INT AS pred_seg
  FROM (SELECT *, row_number() OVER (PARTITION BY dossier ORDER BY page_num) AS rn FROM cp) WINDOW w AS (PARTITION BY dossier ORDER BY page_num)),
ch AS (SELECT *, min(page_num) OVER (PARTITION BY dossier, true_seg) AS true_head, min(page_num) OVER (PARTITION BY dossier, pred_seg) AS pred_head FROM cs)"""

LINES = f"""
lp AS (
  SELECT l_orderkey AS dossier, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)::INT AS page_num, l_returnflag || l_linestatus AS document_type,
         CASE WHEN {u('l_orderkey', 'l_partkey', 'l_suppkey', "'start'")} < 0.4 THEN 'yes' ELSE 'no' END AS start_page,
         CASE WHEN {u('l_orderkey', 'l_partkey', 'l_suppkey', "'pred'")} < 0.4 THEN 'yes' ELSE 'no' END AS predicted_start_page
  FROM lineitem),
lh0 AS (
  SELECT *, (sum((start_page = 'yes' OR page_num = 1)::INT) OVER w - 1)::INT AS true_seg, (sum((predicted_start_page = 'yes' OR page_num = 1)::INT) OVER w - 1)::INT AS pred_seg
  FROM lp WINDOW w AS (PARTITION BY dossier ORDER BY page_num)),
lh AS (SELECT *, min(page_num) OVER (PARTITION BY dossier, true_seg) AS true_head, min(page_num) OVER (PARTITION BY dossier, pred_seg) AS pred_head FROM lh0)"""


def _k(salt: str) -> str:
    return u("page_num", "annotator", f"'{salt}'")


def _own(salt: str) -> str:
    return u("page_num", f"'{salt}'")


ANNOTATIONS = f"""
an0 AS (SELECT source AS pdf, doc_id AS page_num, lang, annotator, (annotator[2]::INT - 1) AS annotator_order FROM documents, (SELECT unnest({ANNOTATORS!r}) AS annotator)),
an1 AS (SELECT *, CASE WHEN {_k('null')} < 0.1 THEN NULL WHEN {_k('noise')} < 0.2 THEN {pick(_k('alt'), LANGUAGES)} ELSE lang END AS dt FROM an0 WHERE {_k('has')} < 0.7),
an AS (
  SELECT pdf, page_num, annotator, annotator_order, CASE WHEN {_k('case')} < 0.15 THEN upper(dt) ELSE dt END AS document_type,
         CASE WHEN {_k('lnoise')} < 0.1 THEN {pick(_k('lalt'), LAYOUTS)} ELSE {pick(_own('layout'), LAYOUTS)} END AS layout_type,
         CASE WHEN {_k('cnoise')} < 0.1 THEN {pick(_k('calt'), CATEGORIES)} ELSE {pick(_own('category'), CATEGORIES)} END AS functional_category,
         CASE WHEN ({_own('start')} < 0.5) <> ({_k('snoise')} < 0.1) THEN 'yes' ELSE 'no' END AS start_page
  FROM an1),
lv AS (
  SELECT pdf, page_num, annotator_order, 'document_type' AS "column", document_type AS value FROM an UNION ALL SELECT pdf, page_num, annotator_order, 'layout_type', layout_type FROM an
  UNION ALL SELECT pdf, page_num, annotator_order, 'functional_category', functional_category FROM an UNION ALL SELECT pdf, page_num, annotator_order, 'start_page', start_page FROM an),
fq AS (SELECT "column", value, count(*) AS freq FROM lv WHERE value IS NOT NULL GROUP BY 1, 2),
vc AS (SELECT pdf, page_num, "column", value, count(*) AS n, min(annotator_order) AS o FROM lv WHERE value IS NOT NULL GROUP BY 1, 2, 3, 4),
vr AS (SELECT vc.*, row_number() OVER (PARTITION BY pdf, page_num, "column" ORDER BY n DESC, freq DESC, o) AS r, sum(n) OVER g AS total, max(n) OVER g AS top
       FROM vc JOIN fq USING ("column", value) WINDOW g AS (PARTITION BY pdf, page_num, "column")),
vt AS (SELECT pdf, page_num, "column", count(*) AS ties FROM vr WHERE n = top GROUP BY 1, 2, 3),
nk AS (SELECT pdf, page_num, "column", count(*) AS n_annotators FROM lv GROUP BY 1, 2, 3),
vo AS (
  SELECT nk.pdf, nk.page_num, nk."column", vr.value, CASE WHEN vr.value IS NULL THEN 'no-data' WHEN total = 1 THEN 'single' WHEN ties > 1 THEN 'tie' WHEN top = total THEN 'unanimous' ELSE 'majority' END AS status, n_annotators
  FROM nk LEFT JOIN vr ON nk.pdf = vr.pdf AND nk.page_num = vr.page_num AND nk."column" = vr."column" AND vr.r = 1
  LEFT JOIN vt ON nk.pdf = vt.pdf AND nk.page_num = vt.page_num AND nk."column" = vt."column")"""

PARTS = f"""
pt AS (SELECT p_partkey AS row_id, p_type || ' ' || p_brand AS document_type, p_brand AS layout_type, p_type AS functional_category, p_size AS pdf,
              CASE WHEN {u('p_partkey', "'split'")} < 0.7 THEN 'train' WHEN {u('p_partkey', "'split'")} < 0.85 THEN 'val' ELSE 'test' END AS split FROM part)"""

META = f"""
mn AS (SELECT l_orderkey AS dossier, count(*) AS num_docs, count(*) FILTER (l_returnflag = 'A') AS n_a, count(*) FILTER (l_returnflag = 'N') AS n_n, count(*) FILTER (l_returnflag = 'R') AS n_r FROM lineitem GROUP BY 1),
m0 AS (SELECT o_orderkey AS dossier, year(o_orderdate)::INT AS travel_year, (1 + floor({u('o_orderkey', "'persons'")} * 5))::INT AS num_persons FROM orders),
m1 AS (SELECT *, (1 + floor({u('dossier', "'a16'")} * num_persons))::INT AS num_16 FROM m0),
meta AS (SELECT m1.*, greatest(1, num_16 - floor({u('dossier', "'a18'")} * 2)::INT) AS num_18, num_docs, n_a, n_n, n_r FROM m1 JOIN mn USING (dossier))"""


def model(salt: str) -> str:
    """vec_id, label, probs of two_models, as a subquery."""
    raw = ", ".join(f"round({u('vec_id', repr(f'{salt}{k}'))} + CASE WHEN label = {k} THEN 0.6 ELSE 0 END, 9)" for k in range(10))
    return f"(SELECT vec_id, label, list_transform(raw, lambda x: x / list_sum(raw)) AS probs FROM (SELECT vec_id, label, [{raw}] AS raw FROM embeddings))"


UNIT = "list_transform(embedding, lambda x: x::DOUBLE)"
