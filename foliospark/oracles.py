"""DuckDB SQL for the named queries, over the same tables."""

from __future__ import annotations

#: The grammar of numbers, and the function words of both languages, written out again here.
NUMBER_RUN = (
    r"\d{1,4}[./-]\d{1,2}[./-]\d{2,4}|\d{1,2}[:h]\d{2}|\d{1,3}(?:,\d{3}){2,}"
    r"|\d{1,3}(?:[ \x{00A0}\x{202F}]\d{3})*[.,]\d+|\d{1,4}(?:[ \x{00A0}\x{202F}]\d{3})+|\d+"
)
DATE_OR_TIME = r"^(\d{1,4}[./-]\d{1,2}[./-]\d{2,4}|\d{1,2}[:h]\d{2})$"
_FR = (
    "le la les un une des du de et est sont dans pour que qui pas sur avec ce cette ses son sa mais ou où donc car ne se au aux par plus "
    "sans être avoir été fait comme tout tous elle il ils nous vous leur leurs"
).split()
_EN = (
    "the a an and is are in for that which not on with this these its his her but or so because no be have been done as all every she he "
    "they we you their of to from at by it was were will would can could"
).split()

_EVENTS = """WITH pe AS (SELECT event_id AS id, user_id AS chat_id, CASE WHEN event_type = 'view' THEN 'device' ELSE event_type END AS destination,
  floor(value)::BIGINT AS bytes_sent, ts AS created_at FROM events)"""
_MESSAGES = "WITH m AS (SELECT conv_id AS document_id, turn AS seq, role, text FROM conversations)"
_SPANS = """WITH s AS (SELECT l_orderkey AS document_id, l_orderkey || '-' || l_linenumber AS id, l_returnflag AS heading, l_linenumber,
  (trunc(l_extendedprice)::BIGINT % 1000)::INT AS char_start, (trunc(l_extendedprice)::BIGINT % 1000)::INT + trunc(l_quantity)::INT * 8 AS char_end FROM lineitem)"""
_INVOICES = """WITH i AS (SELECT o_orderkey AS document_id, floor(o_totalprice * 100 + 0.5)::BIGINT AS cents,
  floor(floor(o_totalprice * 100 + 0.5)::BIGINT / 5)::BIGINT AS tax,
  CASE o_orderkey % 4 WHEN 0 THEN 'USD' WHEN 1 THEN 'GBP' ELSE 'EUR' END AS currency, strftime(o_orderdate, '%Y-%m-%d') AS record_date,
  'INV-' || lpad(o_orderkey::VARCHAR, 8, '0') AS record_id, o_orderkey % 7 = 0 AS twice FROM orders)"""
_LINES = "WITH li AS (SELECT DISTINCT ON (l_orderkey, l_linenumber) * FROM lineitem)"
_BM25 = """, n AS (SELECT count(*) AS n, avg(len(ts)) AS avg_len FROM c), p AS (SELECT id, len(ts) AS len, term, count(*) AS tf
  FROM (SELECT id, ts, unnest(ts) AS term FROM c) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM p GROUP BY term), qt AS (SELECT DISTINCT query_id, unnest(ts) AS term FROM q),
s AS (SELECT query_id, id, round(sum((CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END)
  * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))), 6) AS score FROM p JOIN qt USING (term) JOIN df USING (term), n GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s)"""
_COSINE = """WITH q AS (SELECT vec_id AS query_id, embedding AS qe FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT query_id, vec_id, round(list_sum(list_transform(list_zip(qe, embedding), lambda x: x[1]::DOUBLE * x[2]::DOUBLE)), 6) AS score FROM q, embeddings),
near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)"""
_CHANNELS = """WITH g AS (SELECT l_suppkey AS query_id, l_partkey, round(sum(l_extendedprice), 2) AS a, round(sum(l_quantity), 2) AS b, round(max(l_tax), 4) AS c
  FROM lineitem GROUP BY ALL),
ch AS (SELECT query_id, l_partkey, 'a' AS k, row_number() OVER (PARTITION BY query_id ORDER BY a DESC, l_partkey) AS rank FROM g
  UNION ALL SELECT query_id, l_partkey, 'b', row_number() OVER (PARTITION BY query_id ORDER BY b DESC, l_partkey) FROM g
  UNION ALL SELECT query_id, l_partkey, 'c', row_number() OVER (PARTITION BY query_id ORDER BY c DESC, l_partkey) FROM g)"""


def _fused(weight: str, top: int) -> str:
    return f"""{_CHANNELS}, f AS (SELECT query_id, l_partkey, round(sum({weight} / (60 + rank)), 8) AS score, count(*) AS channels
  FROM ch WHERE rank <= 60 GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, l_partkey) AS rank FROM f)
SELECT query_id, l_partkey, score, channels, rank FROM r WHERE rank <= {top}"""


def _money(value: str, where: str = "NOT twice", amount: str = "cents") -> str:
    return f"""{_INVOICES} SELECT currency, {value.format(v=amount)}::BIGINT AS value_minor, count(*) AS count FROM i WHERE {where} GROUP BY currency"""


def _stops(words) -> str:
    return ", ".join(f"'{w}'" for w in sorted(set(words)))


_NORMAL = (
    "trim(regexp_replace(regexp_replace(translate(lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace({t}, '[œŒ]', 'oe', 'g'), '[æÆ]', 'ae', 'g'),"
    " '­', '', 'g'), '([\\p{{L}}\\p{{N}}])-[ \\t\\r\\x0B\\f]*\\n\\s*([\\p{{L}}\\p{{N}}])', '\\1\\2', 'g')), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'),"
    " '\\p{{M}}', '', 'g'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
)

_RUN = f"({NUMBER_RUN})".replace("'", "''")
_MONEY_TEXT = "(floor({c} / 100)::BIGINT || ',' || lpad(({c} % 100)::VARCHAR, 2, '0'))"
_INVOICE_TEXT = f"""{_INVOICES}, x AS (SELECT *, 'Facture n° ' || record_id || chr(10) || 'Date: ' || strftime(record_date::DATE, '%d/%m/%Y') || chr(10)
  || 'TVA: ' || {_MONEY_TEXT.format(c="tax")} || ' ' || currency || chr(10) || 'Total TTC: ' || {_MONEY_TEXT.format(c="cents")} || ' ' || currency
  || CASE WHEN twice THEN chr(10) || 'Net à payer: ' || {_MONEY_TEXT.format(c="(cents + 100)")} || ' ' || currency ELSE '' END AS text FROM i)"""


def _canonical(text: str) -> str:
    digits = r"regexp_replace(r, '\D', '', 'g')"
    fraction = r"regexp_replace(regexp_extract(r, '^.*[.,](\d+)$', 1), '0+$', '')"
    whole = r"regexp_replace(regexp_extract(r, '^(.*)[.,]\d+$', 1), '\D', '', 'g')"
    plain = rf"regexp_matches(r, '{DATE_OR_TIME}') OR regexp_matches(r, '^\d{{1,3}}(?:,\d{{3}}){{2,}}$') OR NOT regexp_matches(r, '[.,]\d+$')"
    return f"list_transform(regexp_extract_all({text}, '{_RUN}'), lambda r: CASE WHEN {plain} THEN {digits} WHEN {fraction} <> '' THEN {whole} || '.' || {fraction} ELSE {whole} END)"


def _decomposed() -> str:
    first = ", ".join(
        f"CASE WHEN len(after) >= {s + n} AND abs(list_sum(after[{s + 1}:{s + n}]) - value) <= 0.005 THEN {n} END" for n in range(2, 7) for s in range(3)
    )
    return f"""{_LINES}, a AS (SELECT l_orderkey AS page, l_linenumber AS "at", l_quantity::DOUBLE AS value,
        list(l_quantity::DOUBLE) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS BETWEEN 1 FOLLOWING AND 8 FOLLOWING) AS after FROM li),
        f AS (SELECT page, "at", value, coalesce({first}) AS n_parts FROM a) SELECT page, "at", value, n_parts FROM f WHERE n_parts IS NOT NULL"""


ORACLES: dict[str, str] = {
    "number_tokens": f"{_INVOICE_TEXT} SELECT document_id, array_to_string({_canonical('text')}, ',') AS found FROM x",
    "numeric_grounding": f"""{_INVOICE_TEXT}, y AS (SELECT *, cents + CASE WHEN document_id % 2 = 1 THEN 12345 ELSE 0 END AS stated FROM x),
        z AS (SELECT document_id AS answer_id, {_canonical("'The total is ' || " + _MONEY_TEXT.format(c="stated") + " || ' ' || currency")} AS said, {_canonical("text")} AS have FROM y),
        u AS (SELECT answer_id, list_sort(list_distinct(list_filter(said, lambda n: NOT list_contains(have, n) AND NOT (try_cast(n AS INT) BETWEEN 0 AND 20 AND n = try_cast(n AS INT)::VARCHAR)))) AS missing FROM z)
        SELECT answer_id, array_to_string(missing, ',') AS unsupported, len(missing) = 0 AS grounded FROM u""",
    "decomposed_totals": _decomposed(),
    "char_grams": f"""WITH n AS (SELECT item_id AS query_id, {_NORMAL.format(t="text")} AS t FROM benchmark),
        v AS (SELECT query_id, list_filter(list_append(string_split(t, ' '), replace(t, ' ', '')), lambda w: w <> '') AS ws FROM n),
        w AS (SELECT query_id, k, '^' || ws[k] || '$' AS w FROM v, unnest(range(1, len(ws) + 1)) AS u(k)),
        g AS (SELECT query_id, substring(w, i, 3) AS gram, min(k * 100000 + i) AS place FROM w, unnest(range(1, greatest(length(w) - 2, 1) + 1)) AS u(i) GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place) AS n FROM g)
        SELECT query_id, string_agg(gram, ' ' ORDER BY place) AS grams FROM r WHERE n <= 768 GROUP BY 1""",
    "text_quality": r"""WITH t AS (SELECT doc_id, regexp_replace(text, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS t FROM documents),
        q AS (SELECT doc_id, length(t) AS n, len(regexp_extract_all(t, '\p{L}')) AS letters, len(regexp_extract_all(t, '[\s\p{Z}]')) AS blank,
          len(regexp_extract_all(t, '[\x{0000}\x{FFFD}]')) AS odd, len(regexp_extract_all(t, '[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}]')) AS unspaced,
          list_transform(regexp_extract_all(t, '\p{L}{24,}'), lambda w: length(w)) AS runs FROM t)
        SELECT doc_id, CASE WHEN n < 50 THEN 'sparse' WHEN odd >= 3 AND odd >= n * 0.005 THEN 'unmapped'
          WHEN letters >= 50 AND unspaced / letters < 0.2 AND blank < n * 0.06
            AND (coalesce(list_sum(runs), 0) >= letters * 0.2 OR coalesce(list_max(runs), 0) >= 64) THEN 'joined' ELSE 'usable' END AS quality FROM q""",
    "retrieval_metrics": f"""{_COSINE}, g AS (SELECT query_id, list(vec_id ORDER BY rank) AS got FROM near WHERE rank <= 10 GROUP BY 1),
        l AS (SELECT label, list(vec_id) AS want FROM embeddings GROUP BY 1),
        j AS (SELECT got, want, e.label > 0 AS ok FROM g JOIN embeddings e ON e.vec_id = g.query_id JOIN l USING (label)),
        h AS (SELECT *, list_transform(range(1, len(got) + 1), lambda i: CASE WHEN list_contains(want, got[i]) THEN i END) AS places FROM j),
        p AS (SELECT ok, len(list_intersect(want, got[1:1])) / len(want) AS r1, least(1, len(want)) / len(want) AS ceiling, len(list_intersect(want, got[1:5])) / len(want) AS r5,
          len(list_intersect(want, got[1:10])) / len(want) AS r10, coalesce(1.0 / list_min(places), 0) AS rr,
          coalesce(list_sum(list_transform(list_filter(places, lambda i: i IS NOT NULL), lambda i: 1 / log2(i + 1))), 0)
            / list_sum(list_transform(range(1, least(len(want), 10) + 1), lambda i: 1 / log2(i + 1))) AS ndcg, len(got) = 0 AS silent FROM h)
        SELECT count(*) FILTER (ok) AS queries, round(avg(r1) FILTER (ok), 6) AS recall_1, round(avg(ceiling) FILTER (ok), 6) AS recall_1_ceiling,
          round(avg(r5) FILTER (ok), 6) AS recall_5, round(avg(r10) FILTER (ok), 6) AS recall_10, round(avg(rr) FILTER (ok), 6) AS mrr_10,
          round(avg(ndcg) FILTER (ok), 6) AS ndcg_10, round(avg(silent::INT) FILTER (NOT ok), 6) AS negative_precision FROM p""",
    "egress_summary": f"{_EVENTS} SELECT destination, count(*) AS requests, coalesce(sum(bytes_sent), 0)::BIGINT AS bytes FROM pe GROUP BY 1",
    "egress_week": f"""{_EVENTS} SELECT destination, count(*) AS requests, coalesce(sum(bytes_sent), 0)::BIGINT AS bytes FROM pe
        WHERE created_at >= (SELECT max(created_at) FROM pe) - INTERVAL 7 DAY GROUP BY 1""",
    "egress_cloud": f"{_EVENTS} SELECT count(*) AS requests, coalesce(sum(bytes_sent), 0)::BIGINT AS bytes FROM pe WHERE destination <> 'device'",
    "egress_last_by_chat": f"{_EVENTS} SELECT chat_id, max(created_at) AS last_at FROM pe WHERE destination <> 'device' GROUP BY 1",
    "quota_daily": f"""{_EVENTS} SELECT chat_id, strftime(created_at, '%Y-%m-%d') AS day, sum(bytes_sent)::BIGINT AS used,
        greatest(0, 3000 - sum(bytes_sent))::BIGINT AS remaining FROM pe GROUP BY 1, 2""",
    "library_counts": "SELECT d.doc_id, source, (SELECT count(*) FROM labels l WHERE l.doc_id = d.doc_id) AS uses FROM documents d",
    "missing_runs_anti": "SELECT doc_id AS document_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "versions_active": """WITH v AS (SELECT event_id AS id, CASE WHEN event_type <> 'view' THEN user_id || ':' || event_type END AS version_group, ts FROM events),
        n AS (SELECT *, row_number() OVER (PARTITION BY version_group ORDER BY ts DESC, id DESC) AS k FROM v)
        SELECT id, version_group FROM n WHERE version_group IS NULL OR k = 1""",
    "documents_upserted": """SELECT d.doc_id, d.lang, CASE WHEN l.toxic = 1 THEN 'blocked' ELSE d.source END AS source FROM documents d LEFT JOIN labels l USING (doc_id)""",
    "documents_replaced": "SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE quality = 0) THEN 'review' ELSE source END AS source FROM documents",
    "documents_deleted": "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)",
    "neighbors_radius1": f"""{_MESSAGES} SELECT DISTINCT c.document_id, c.seq FROM m c JOIN m a ON c.document_id = a.document_id AND c.seq BETWEEN a.seq - 1 AND a.seq + 1
        WHERE a.role = 'user'""",
    "nearest_anchor": f"""{_MESSAGES}, r AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY length(text) DESC, seq) AS rank FROM m),
        j AS (SELECT c.document_id, c.seq, a.seq AS anchor_seq, a.rank AS anchor_rank, row_number() OVER (PARTITION BY c.document_id, c.seq ORDER BY a.rank, a.seq) AS k
          FROM m c JOIN r a ON c.document_id = a.document_id AND abs(c.seq - a.seq) <= 2 AND a.rank <= 2)
        SELECT document_id, seq, anchor_seq, anchor_rank FROM j WHERE k = 1""",
    "interval_overlap_children": f"""{_SPANS} SELECT p.id AS parent_id, c.id AS child_id FROM s p JOIN s c ON p.document_id = c.document_id
        AND c.char_end >= p.char_start AND c.char_start <= p.char_end AND p.heading IS NOT DISTINCT FROM c.heading WHERE p.l_linenumber = 1 AND c.l_linenumber > 1""",
    "interval_union": f"""{_SPANS}, o AS (SELECT *, max(char_end) OVER (PARTITION BY document_id ORDER BY char_start, char_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM s),
        k AS (SELECT *, sum(CASE WHEN b IS NULL OR char_start > b THEN 1 ELSE 0 END) OVER (PARTITION BY document_id ORDER BY char_start, char_end ROWS UNBOUNDED PRECEDING) AS island FROM o),
        g AS (SELECT document_id, island, min(char_start) AS lo, max(char_end) AS hi FROM k GROUP BY ALL)
        SELECT document_id, sum(hi - lo)::BIGINT AS covered, count(*) AS islands FROM g GROUP BY 1""",
    "page_leads": f"{_MESSAGES} SELECT document_id, role, min(seq) AS seq FROM m GROUP BY 1, 2",
    "facts_left_chunks": "SELECT o_orderkey, l_linenumber FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey",
    "egress_citations": """SELECT DISTINCT l_partkey, event_type AS destination FROM events JOIN orders ON user_id = o_custkey JOIN lineitem ON o_orderkey = l_orderkey
        WHERE event_type <> 'view'""",
    "scope_semi": "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)",
    "parent_promotion": """SELECT l_orderkey || '-' || l_linenumber AS chunk_id, l_orderkey AS parent_chunk_id,
        round(greatest(l_discount, (SELECT max(o_totalprice % 1) FROM orders WHERE o_orderkey = l_orderkey)), 6) AS score FROM lineitem""",
    "page_enrichment": """WITH g AS (SELECT l_suppkey AS query_id, l_partkey AS document_id, l_linenumber AS page, count(*) AS hits, round(sum(l_discount), 6) AS score
        FROM lineitem GROUP BY ALL HAVING count(*) >= 2), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id, page) AS rank FROM g)
        SELECT query_id, document_id, page, hits, score, rank FROM r WHERE rank <= 2""",
    "pages_full_outer": f"""{_MESSAGES}, u AS (SELECT document_id, sum(length(text))::BIGINT AS native FROM m WHERE role = 'user' GROUP BY 1),
        a AS (SELECT document_id, sum(length(text))::BIGINT AS ocr FROM m WHERE role = 'assistant' GROUP BY 1)
        SELECT document_id, native, ocr, CASE WHEN ocr > coalesce(native, 0) THEN 'ocr' ELSE 'native' END AS chosen FROM u FULL JOIN a USING (document_id)""",
    "document_leaders": "SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS k FROM events) WHERE k = 1",
    "location_cap": """SELECT user_id, event_type, event_id, value, place FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) AS place
        FROM events) WHERE place <= 4""",
    "interleave": """WITH l AS (SELECT l_suppkey AS query_id, l_partkey AS chunk_id, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS list_no,
          row_number() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rank FROM lineitem),
        f AS (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY rank, list_no) AS k FROM l WHERE rank <= 16),
        p AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY rank, list_no) AS place FROM f WHERE k = 1)
        SELECT query_id, chunk_id, place FROM p WHERE place <= 16""",
    "pair_windows": f"""{_MESSAGES} SELECT document_id, seq, lead(seq) OVER w AS next_seq, length(concat_ws(' ', text, lead(text) OVER w)) AS pair_chars
        FROM m WINDOW w AS (PARTITION BY document_id ORDER BY seq)""",
    "dedup_sha256": "SELECT sha256(text) AS hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1",
    "normalize_text": f"SELECT doc_id, sha256({_NORMAL.format(t='text')}) AS normalized FROM documents",
    "scoped_chunks": """WITH d AS (SELECT DISTINCT conv_id FROM conversations WHERE length(conv_id::VARCHAR) % 2 = 1 AND conv_id IN (SELECT conv_id FROM conversations WHERE role = 'assistant'))
        SELECT conv_id AS document_id, conv_id || '-' || turn AS chunk_id, 'doc ' || conv_id AS document_name, row_number() OVER (PARTITION BY conv_id ORDER BY turn, conv_id || '-' || turn) AS place
        FROM conversations JOIN d USING (conv_id)""",
    "citable_page_firsts": """SELECT conv_id AS document_id, floor(turn / 2)::BIGINT AS page, conv_id || '-' || min(turn) AS chunk_id FROM conversations WHERE turn % 5 <> 4 GROUP BY 1, 2""",
    "talk_messages": "SELECT event_id, nullif(event_type, 'click') AS mode FROM events WHERE event_type <> 'view'",
    "settings_prefix": "SELECT p_partkey::VARCHAR AS key, p_brand AS value FROM part WHERE p_size > 25 AND p_brand IS NOT NULL",
    "attached_documents": """SELECT DISTINCT c_custkey AS chat_id, n_nationkey AS document_id, c_name AS title, n_name AS name, o_orderstatus = 'O' AS enabled
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey""",
    "library_detail": """WITH e AS (SELECT DISTINCT l_suppkey, l_shipdate, l_returnflag FROM lineitem WHERE l_returnflag <> 'N'),
        r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate DESC, l_returnflag) AS n FROM e),
        c AS (SELECT l_suppkey, count(DISTINCT l_orderkey) AS chats, count(DISTINCT l_partkey) AS versions FROM lineitem GROUP BY 1)
        SELECT s_suppkey AS document_id, coalesce(chats, 0) AS chats, coalesce(versions, 0) AS versions, (SELECT count(*) FROM r WHERE l_suppkey = s_suppkey AND n <= 20) AS n_sent,
          strftime(l_shipdate, '%Y-%m-%d') AS last_sent, l_returnflag AS destination FROM supplier LEFT JOIN c ON c.l_suppkey = s_suppkey LEFT JOIN r ON r.l_suppkey = s_suppkey AND n = 1""",
    "merged_confidence": "SELECT l_orderkey, round(min(CASE WHEN l_linenumber > 1 THEN 1 - l_discount END), 4) AS ocr_confidence, count(*) AS blocks FROM lineitem GROUP BY 1",
    "evidence_texts": "SELECT p_partkey, CASE WHEN p_type = p_name THEN p_type ELSE p_type || chr(10) || p_name END AS evidence FROM part",
    "method_summaries": "SELECT o_orderkey AS message_id, o_orderstatus AS route, (o_custkey % 7)::INT AS passages, o_orderkey % 2 = 0 AS cloud FROM orders",
    "retrieval_payloads": """SELECT l_orderkey AS message_id, 'order ' || l_orderkey AS query, array_to_string(list_sort(list(DISTINCT l_partkey)), ',') AS chunk_ids
        FROM lineitem WHERE l_orderkey % 3 <> 0 GROUP BY 1""",
    "universal_search": """WITH r AS (SELECT l_suppkey AS q, l_orderkey, l_linenumber, l_returnflag, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rank FROM lineitem),
        m AS (SELECT q, l_orderkey, row_number() OVER (PARTITION BY q ORDER BY rank) AS n FROM r WHERE l_returnflag <> 'R'),
        c AS (SELECT q AS query_id, 'chat' AS kind, l_orderkey::VARCHAR AS id, min(n) AS n FROM m WHERE n <= 24 GROUP BY 1, 3
          UNION ALL SELECT q, 'document', l_orderkey || '-' || l_linenumber, rank FROM r),
        p AS (SELECT query_id, kind, id, row_number() OVER (PARTITION BY query_id, kind ORDER BY n, id) AS place FROM c) SELECT * FROM p WHERE place <= 8""",
    "repaired_views": """SELECT p_partkey AS chunk_id, CASE WHEN p_size > 25 THEN upper(p_brand) || ' ' || p_name ELSE p_brand || chr(10) || p_name END AS search_text FROM part""",
    "evidence_recall": """WITH w AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem), g AS (SELECT DISTINCT l_orderkey, l_partkey, 1 AS got FROM lineitem WHERE l_returnflag <> 'N'),
        s AS (SELECT l_orderkey, count(got) / count(*) AS share FROM w LEFT JOIN g USING (l_orderkey, l_partkey) GROUP BY 1)
        SELECT count(*) AS cases, round(avg(share), 6) AS evidence_recall, round(avg((share = 1)::INT), 6) AS complete FROM s""",
    "markdown_router": f"{_LINES} SELECT l_orderkey, count(*) FILTER (l_returnflag = 'R') * 5 >= count(*) AS as_table FROM li GROUP BY 1",
    "neighbour_lists": f"""{_MESSAGES}, c AS (SELECT *, document_id * 1000 + seq AS chunk_id FROM m),
        r AS (SELECT *, row_number() OVER (PARTITION BY role ORDER BY length(text) DESC, chunk_id) AS rank FROM c),
        h AS (SELECT role AS query_id, chunk_id, 1.0 / (60 + rank) AS score, rank, -1.0 AS ord, false AS neighbour FROM r WHERE rank <= 60
          UNION ALL SELECT r.role, c.chunk_id, 0.45 / (60 + rank) + 0.01, rank, 0.5, true FROM r JOIN c ON c.document_id = r.document_id AND c.seq IN (r.seq - 1, r.seq + 1)
            WHERE rank <= 48 AND length(c.text) % 2 = 0),
        f AS (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY rank, ord, chunk_id) AS n FROM h),
        k AS (SELECT *, row_number() OVER (PARTITION BY query_id, neighbour ORDER BY rank, ord, chunk_id) AS k FROM f WHERE n = 1)
        SELECT query_id, chunk_id, round(score, 8) AS score, row_number() OVER (PARTITION BY query_id ORDER BY rank, ord, chunk_id) AS place, neighbour FROM k WHERE NOT neighbour OR k <= 24""",
    "identifier_agreement": """SELECT o_orderkey AS document_id, CASE WHEN o_orderkey % 3 = 2 THEN 1.0 WHEN o_orderkey % 5 = 0 THEN 0.25 WHEN o_orderkey % 3 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS compatibility FROM orders""",
    "ocr_triage": "SELECT p_partkey, p_size / 50.0 >= 0.8 AND (p_partkey % 20) / 100.0 < 0.08 AS needs_ocr FROM part",
    "file_formats": """SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'pdf' WHEN 1 THEN 'markdown' WHEN 2 THEN 'docx' WHEN 3 THEN 'text' ELSE 'unsupported' END AS format FROM part""",
    "context_fit": """WITH s AS (SELECT conv_id AS query_id, turn AS position, sum(ceil(length(coalesce(text, '')) / 3)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::BIGINT AS so_far FROM conversations)
        SELECT * FROM s WHERE so_far <= 3900""",
    "derived_values": f"{_LINES} SELECT l_orderkey || '-' || l_linenumber AS answer_id, l_linenumber % 2 = 0 AS derived FROM li",
    "citation_markers": """SELECT o_orderkey AS answer_id, CASE WHEN o_orderkey % 3 = 0 THEN '' WHEN o_custkey % 5 = 1 THEN '1' WHEN o_custkey % 5 = 0 THEN '0,1' ELSE '1,' || (o_custkey % 5) END AS markers,
        o_orderkey % 3 <> 0 AND o_custkey % 5 BETWEEN 1 AND 3 AS valid FROM orders""",
    "copied_passages": f"""WITH c AS (SELECT doc_id AS id, list_filter(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' '), lambda t: t <> '') AS ts, text FROM documents),
        q AS (SELECT item_id AS query_id, list_filter(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' '), lambda t: t <> '') AS ts, text FROM benchmark)
        {_BM25}, h AS (SELECT r.query_id || '-' || r.id AS answer_id, string_split(trim(regexp_replace(lower(q.text), '\\s+', ' ', 'g')), ' ') AS a,
          string_split(trim(regexp_replace(lower(c.text), '\\s+', ' ', 'g')), ' ') AS b FROM r JOIN q USING (query_id) JOIN c USING (id) WHERE rank <= 3),
        g AS (SELECT answer_id, list_transform(range(1, len(a) - 16), lambda i: array_to_string(a[i:i + 17], ' ')) AS ga, list_transform(range(1, len(b) - 16), lambda i: array_to_string(b[i:i + 17], ' ')) AS gb FROM h)
        SELECT answer_id, list_has_any(ga, gb) AS copied FROM g""",
    "amount_terms": f"""{_LINES} SELECT l_orderkey || '-' || l_linenumber AS line_id, CASE WHEN abs(l_suppkey % 40 - 10) <= abs(l_suppkey % 40 - 30) THEN 'a' ELSE 'b' END AS term,
        l_quantity::BIGINT AS value_minor, least(abs(l_suppkey % 40 - 10), abs(l_suppkey % 40 - 30))::INT AS distance FROM li""",
    "aggregate_accuracy": """SELECT count(*) AS cases, count(*) FILTER (o_orderkey % 7 <> 0) AS matched, round(count(*) FILTER (o_orderkey % 7 <> 0) / count(*), 6) AS share FROM orders""",
    "mistyped_names": r"""SELECT p_partkey, regexp_replace(p_name, '\b(\p{L}\p{L})(\p{L})(\p{L})(\p{L}+)', '\1\3\2\4', 'g') AS swapped, regexp_replace(p_name, '\b(\p{L}\p{L})\p{L}(\p{L}\p{L}+)', '\1\2', 'g') AS dropped,
        strip_accents(p_type) AS plain FROM part""",
    "stream_quota": """SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, sum(floor(value)::BIGINT)::BIGINT AS used, greatest(0, 3000 - sum(floor(value)::BIGINT))::BIGINT AS remaining FROM events GROUP BY 1, 2""",
    "stream_egress": """SELECT strftime(date_trunc('day', ts) - k * INTERVAL 1 DAY, '%Y-%m-%d') AS first_day, event_type AS destination, count(*) AS requests, sum(floor(value)::BIGINT)::BIGINT AS bytes
        FROM events, range(7) AS u(k) GROUP BY 1, 2""",
    "stream_lifecycle": """SELECT user_id::VARCHAR AS document_id, ['received', 'parsing', 'chunking', 'embedding'][max(CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 4 ELSE 3 END)] AS status
        FROM events GROUP BY 1""",
    "html_lengths": r"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(html, '<script\b.*?</script>', ' ', 'gis'), '<style\b.*?</style>', ' ', 'gis') AS t FROM pages),
        b AS (SELECT page_id, regexp_replace(regexp_replace(t, '<(?:br|/p|/div|/li|/tr|/h[1-6])\b[^>]*>', chr(10), 'gi'), '<[^>]*>', ' ', 'g') AS t FROM a),
        c AS (SELECT page_id, replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&') AS t FROM b)
        SELECT page_id, sha256(regexp_replace(regexp_replace(regexp_replace(t, '[ \t]+', ' ', 'g'), '\s*\n\s*', chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS plain FROM c""",
    "answer_grammar": "SELECT o_orderkey AS answer_id, o_orderkey % 4 = 0 OR (o_orderkey % 4 > 1 AND o_custkey % 5 BETWEEN 1 AND 3) AS follows FROM orders",
    "label_value_facts": f"""{_LINES}, c AS (SELECT l_orderkey, l_linenumber, floor(l_extendedprice * 100 + 0.5)::BIGINT AS c FROM li)
        SELECT l_orderkey AS query_id, 'Position ' || l_linenumber AS label, (c // 100) || ',' || lpad((c % 100)::VARCHAR, 2, '0') || ' €' AS value FROM c""",
    "extractive_answers": f"""{_LINES}, c AS (SELECT l_orderkey, l_linenumber, floor(l_extendedprice * 100 + 0.5)::BIGINT AS c, count(*) OVER (PARTITION BY l_orderkey) AS n FROM li)
        SELECT l_orderkey AS query_id, 'all_limits' AS shape, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1)::INT AS line,
          'Position ' || l_linenumber || ': ' || (c // 100) || ',' || lpad((c % 100)::VARCHAR, 2, '0') || ' €' AS text, '1' AS places FROM c WHERE n >= 4""",
    "grounding_verdicts": """SELECT o_orderkey AS answer_id, o_orderkey % 2 = 0 AS grounded, (o_orderkey % 2)::INT AS n_unsupported, o_orderkey % 2 = 1 AS refused FROM orders""",
    "schedule_records": f"""{_LINES}, r AS (SELECT o_custkey, strftime(l_shipdate, '%Y-%m-%d') AS d FROM li JOIN orders ON l_orderkey = o_orderkey)
        SELECT o_custkey AS document_id, count(*) AS instalments, 6939 AS least, 6939 AS most, min(d) AS first_date FROM r GROUP BY 1 HAVING count(*) >= 12""",
    "language_detect": f"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(substring(text, 1, 2500)), '[^\\p{{L}}'']+'), lambda x: x <> '') AS ws FROM documents),
        s AS (SELECT doc_id, len(ws) AS n, len(list_filter(ws, lambda x: x IN ({_stops(_FR)}))) AS fr, len(list_filter(ws, lambda x: x IN ({_stops(_EN)}))) AS en FROM w)
        SELECT doc_id, CASE WHEN n < 10 OR fr + en < n * 0.05 THEN NULL WHEN fr > en * 1.3 THEN 'fr' WHEN en > fr * 1.3 THEN 'en' END AS detected FROM s""",
    "byte_counts": "SELECT source, sum(strlen(text))::BIGINT AS bytes, sum(length(text))::BIGINT AS chars FROM documents GROUP BY 1",
    "identifiers": f"""{_INVOICES} SELECT document_id, record_id || ',' || strftime(record_date::DATE, '%d/%m/%Y') AS found FROM i""",
    "overlap_near_dup": """WITH t AS (SELECT p_partkey, p_brand, list_sort(list_distinct(string_split(lower(p_name), ' '))) AS ts FROM part),
        c AS (SELECT p_brand, ts, min(p_partkey) AS k FROM t GROUP BY ALL),
        o AS (SELECT a.k AS p_partkey, b.k AS twin, len(list_intersect(a.ts, b.ts)) / least(len(a.ts), len(b.ts)) AS overlap FROM c a JOIN c b ON a.p_brand = b.p_brand AND a.k < b.k)
        SELECT p_partkey, twin, round(overlap, 6) AS overlap FROM o WHERE overlap >= 0.5""",
    "overlap_members": """WITH t AS (SELECT p_partkey, p_brand, list_sort(list_distinct(string_split(lower(p_name), ' '))) AS ts FROM part)
        SELECT p_partkey, min(p_partkey) OVER (PARTITION BY p_brand, ts) AS representative FROM t""",
    "overlap_documents": r"""WITH t AS (SELECT doc_id, source, list_sort(list_distinct(regexp_split_to_array(lower(coalesce(text, '')), '\s+'))) AS ts FROM documents),
        c AS (SELECT source, ts, min(doc_id) AS k FROM t GROUP BY ALL),
        o AS (SELECT a.k AS doc_id, b.k AS twin, len(list_intersect(a.ts, b.ts)) / least(len(a.ts), len(b.ts)) AS overlap FROM c a JOIN c b ON a.source = b.source AND a.k < b.k)
        SELECT doc_id, twin, round(overlap, 6) AS overlap FROM o WHERE overlap >= 0.85""",
    "repeated_lines": """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
        SELECT doc_id, count(line) AS items, count(DISTINCT line) AS kinds, round(1 - count(DISTINCT line) / greatest(count(line), 1), 6) AS repeated FROM l GROUP BY 1""",
    "token_df1": """WITH t AS (SELECT DISTINCT c_custkey AS document_id, unnest(string_split(lower(replace(c_name, '#', '') || ' ' || c_mktsegment), ' ')) AS token FROM customer)
        SELECT token, min(document_id) AS document_id FROM t WHERE length(token) >= 3 AND NOT regexp_full_match(token, '[0-9]+') GROUP BY 1 HAVING count(*) = 1""",
    "referenced_documents": """SELECT o_orderkey AS query_id, o_custkey AS document_id FROM orders JOIN customer ON o_custkey = c_custkey""",
    "hybrid_search": f"""{_CHANNELS}, f AS (SELECT query_id, l_partkey, round(sum(1.0 / (60 + rank)), 8) AS score, count(*) AS channels
        FROM ch WHERE rank <= 60 AND k IN ('a', 'b') GROUP BY 1, 2),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, l_partkey) AS rank FROM f) SELECT query_id, l_partkey, score, channels, rank FROM r WHERE rank <= 8""",
    "channel_ablation": f"""{_CHANNELS}, v(without) AS (VALUES (''), ('a'), ('b'), ('c')),
        f AS (SELECT without, query_id, l_partkey, round(sum(1.0 / (60 + rank)), 8) AS score, count(*) AS channels FROM ch, v WHERE rank <= 60 AND k <> without GROUP BY 1, 2, 3),
        r AS (SELECT *, row_number() OVER (PARTITION BY without, query_id ORDER BY score DESC, l_partkey) AS rank FROM f)
        SELECT without, query_id, l_partkey, score, channels, rank FROM r WHERE rank <= 16""",
    "coverage_features": f"""WITH c AS (SELECT doc_id AS id, list_filter(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' '), lambda t: t <> '') AS ts FROM documents),
        q AS (SELECT item_id AS query_id, list_filter(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' '), lambda t: t <> '') AS ts FROM benchmark)
        {_BM25}, h AS (SELECT r.query_id, r.id, list_filter(q.ts, lambda t: length(t) >= 3) AS a, list_filter(c.ts, lambda t: length(t) >= 3) AS b
          FROM r JOIN q USING (query_id) JOIN c USING (id) WHERE rank <= 3),
        g AS (SELECT *, list_distinct(a) AS w, list_distinct(list_transform(range(1, len(a)), lambda i: a[i] || ' ' || a[i + 1])) AS ap,
          list_distinct(list_transform(range(1, len(b)), lambda i: b[i] || ' ' || b[i + 1])) AS bp FROM h),
        x AS (SELECT *, list_transform(w, lambda t: CASE WHEN regexp_matches(t, '[0-9]') OR length(t) >= 6 THEN 2 ELSE 1 END) AS weights,
          list_transform(w, lambda t: CASE WHEN NOT list_contains(b, t) THEN 0 WHEN regexp_matches(t, '[0-9]') OR length(t) >= 6 THEN 2 ELSE 1 END) AS got FROM g)
        SELECT query_id, id AS doc_id, round(coalesce(list_sum(got) / list_sum(weights), 0), 6) AS coverage,
          round(coalesce(len(list_intersect(ap, bp)) / nullif(len(ap), 0), 0), 6) AS bigrams FROM x""",
    "source_labels": f"""{_MESSAGES}, f AS (SELECT document_id, role, min(seq) AS first FROM m GROUP BY ALL)
        SELECT document_id, role, 'Document ' || dense_rank() OVER (PARTITION BY document_id ORDER BY first, role) AS label FROM f""",
    "markdown_export": f"""{_MESSAGES} SELECT document_id, sha256(string_agg('**' || role || '**' || chr(10) || chr(10) || text, chr(10) || chr(10) ORDER BY seq, role, text)) AS markdown
        FROM m GROUP BY 1""",
    "event_props": "SELECT json_extract_string(props, '$.k') AS k, count(*) AS events FROM events GROUP BY 1",
    "topk_bm25": f"""WITH c AS (SELECT doc_id AS id, list_filter(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' '), lambda t: t <> '') AS ts FROM documents),
        q AS (SELECT item_id AS query_id, list_filter(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' '), lambda t: t <> '') AS ts FROM benchmark)
        {_BM25} SELECT query_id, id AS doc_id, score, rank FROM r WHERE rank <= 10""",
    "topk_gram": f"""WITH x AS (SELECT p_partkey AS id, regexp_replace(lower(p_name), '[^a-z0-9]+', '', 'g') AS t FROM part),
        c AS (SELECT id, list_transform(range(1, greatest(length(t) - 2, 1) + 1), lambda i: substring(t, i, 3)) AS ts FROM x),
        y AS (SELECT p_partkey AS query_id, regexp_replace(lower(substring(p_name, 1, 3) || 'x' || substring(p_name, 5)), '[^a-z0-9]+', '', 'g') AS t FROM part WHERE p_partkey % 20 = 0),
        q AS (SELECT query_id, list_transform(range(1, greatest(length(t) - 2, 1) + 1), lambda i: substring(t, i, 3)) AS ts FROM y)
        {_BM25} SELECT query_id, id AS p_partkey, score, rank FROM r WHERE rank <= 10""",
    "topk_cosine": f"{_COSINE} SELECT query_id, vec_id, score, rank FROM near WHERE rank <= 10",
    "matryoshka": """WITH h AS (SELECT vec_id, list_transform(embedding[1:16], lambda x: x::DOUBLE) AS v FROM embeddings),
        n AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS d FROM h)
        SELECT vec_id, round(v[1] / d, 6) AS x0, round(v[16] / d, 6) AS x15 FROM n""",
    "rrf_fusion": _fused("1.0", 16),
    "weighted_rrf": _fused("(CASE WHEN k = 'a' THEN 2.0 ELSE 1.0 END)", 60),
    "weak_matches": f"WITH f AS ({_fused('1.0', 16)}) SELECT query_id, max(score) AS best, max(score) < 0.04 AS weak FROM f GROUP BY 1",
    "prototype_classes": f"""{_COSINE}, k AS (SELECT s.query_id, e.label, s.score, row_number() OVER (PARTITION BY s.query_id, e.label ORDER BY s.score DESC, s.vec_id) AS n
          FROM s JOIN embeddings e USING (vec_id) WHERE s.vec_id % 20 <> 0),
        a AS (SELECT query_id, label, round(avg(score) + 1e-9, 6) AS score FROM k WHERE n <= 2 GROUP BY ALL),
        b AS (SELECT *, row_number() OVER w AS n, lead(score) OVER w AS next FROM a WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, label))
        SELECT query_id, label, score, round(score - next, 6) AS margin FROM b WHERE n = 1""",
    "money_facts": f"""{_INVOICES} SELECT document_id, record_id, record_date, 'total_ttc' AS kind, cents AS value_minor, currency FROM i
        UNION ALL SELECT document_id, record_id, record_date, 'tax', tax, currency FROM i
        UNION ALL SELECT document_id, record_id, record_date, 'total_ttc', cents + 100, currency FROM i WHERE twice""",
    "entry_invoice_total": _money("sum({v})"),
    "money_aggregate_average": _money("floor(sum({v}) / count(*) + 0.5)"),
    "money_aggregate_minimum": _money("min({v})"),
    "money_aggregate_maximum": _money("max({v})"),
    "money_aggregate_list": _money("sum({v})"),
    "money_aggregate_tax": _money("sum({v})", "true", "tax"),
    "money_aggregate_count": f"{_INVOICES} SELECT NULL::VARCHAR AS currency, NULL::BIGINT AS value_minor, count(*) AS count FROM i WHERE NOT twice",
    "record_temporal_filter": _money("sum({v})", "NOT twice AND record_date LIKE '1995-03-%'"),
    "money_ambiguous": f"{_INVOICES} SELECT document_id || ':id:' || record_id AS record_key FROM i WHERE twice",
    "schedule_rows": f"""{_LINES} SELECT l_orderkey AS document_id, l_linenumber AS rank, strftime(l_shipdate, '%Y-%m-%d') AS date,
        ((l_quantity * 100)::BIGINT % 500) || ',6939,' || (floor(l_extendedprice * 100 + 0.5)::BIGINT % 99999) AS amounts FROM li""",
    "installment_column": f"""{_LINES}, c AS (SELECT l_orderkey AS document_id, unnest([0, 1, 2]) AS "column",
          unnest([(l_quantity * 100)::BIGINT % 500, 6939, floor(l_extendedprice * 100 + 0.5)::BIGINT % 99999]) AS value_minor FROM li),
        n AS (SELECT l_orderkey AS document_id, count(*) AS n FROM li GROUP BY 1 HAVING count(*) >= 3),
        k AS (SELECT document_id, "column", value_minor, count(*) AS k FROM c GROUP BY ALL),
        r AS (SELECT k.*, n, row_number() OVER (PARTITION BY document_id ORDER BY k DESC, "column", value_minor) AS r FROM k JOIN n USING (document_id) WHERE k >= n * 0.6)
        SELECT document_id, "column", value_minor, round(k / n, 6) AS share FROM r WHERE r = 1""",
    "typical_value": f"""{_LINES}, w AS (SELECT *, lag(l_linenumber) OVER o AS a, lead(l_linenumber) OVER o AS b FROM li WINDOW o AS (PARTITION BY l_orderkey ORDER BY l_linenumber)),
        i AS (SELECT * FROM w WHERE a IS NOT NULL AND b IS NOT NULL), t AS (SELECT l_orderkey, count(*) AS n FROM i GROUP BY 1),
        k AS (SELECT l_orderkey, l_returnflag, count(*) AS support, min(l_linenumber) AS first FROM i GROUP BY ALL),
        r AS (SELECT k.*, row_number() OVER (PARTITION BY l_orderkey ORDER BY support DESC, first) AS r FROM k JOIN t USING (l_orderkey) WHERE support >= greatest(2, ceil(n * 0.25)))
        SELECT l_orderkey, l_returnflag, support FROM r WHERE r = 1""",
    "extreme_rows": f"{_LINES} SELECT l_orderkey, min_by(l_quantity, l_linenumber) AS first_value, max_by(l_quantity, l_linenumber) AS last_value FROM li GROUP BY 1",
    "period_change": f"""{_LINES}, r AS (SELECT l_orderkey AS page, l_linenumber AS "at", l_returnflag AS label, l_quantity::DOUBLE AS first, (l_quantity + l_linenumber)::DOUBLE AS second FROM li),
        m AS (SELECT *, max("at") OVER w AS final, max(first) OVER w AS m1, max(second) OVER w AS m2 FROM r WINDOW w AS (PARTITION BY page))
        SELECT page, label, first, second, round(second - first, 2) AS change, round((second - first) / first * 100, 2) AS percent FROM m
        WHERE "at" = final AND first >= m1 AND second >= m2 AND first <> 0""",
    "identifier_conflicts": """SELECT l_partkey AS identifier, array_to_string(list_sort(list_distinct(list(trunc(l_quantity)::BIGINT))), ',') AS "values" FROM lineitem GROUP BY 1
        HAVING count(DISTINCT trunc(l_quantity)::BIGINT) >= 2 AND bool_or(l_returnflag = 'A') AND bool_or(l_returnflag <> 'A')""",
    "wilson": """WITH g AS (SELECT lang, sum(quality)::BIGINT AS good, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY 1),
        p AS (SELECT *, good / n AS p, 1.959963984540054 AS z FROM g)
        SELECT lang, good, n, round(p, 6) AS share, round((p + z*z/(2*n) - z * sqrt(p*(1-p)/n + z*z/(4*n*n))) / (1 + z*z/n), 6) AS low,
          round((p + z*z/(2*n) + z * sqrt(p*(1-p)/n + z*z/(4*n*n))) / (1 + z*z/n), 6) AS high FROM p""",
    "hash_split": """SELECT doc_id, (('0x' || substring(sha256(doc_id::VARCHAR), 1, 8))::BIGINT % 5)::INT AS bucket,
        ('0x' || substring(sha256(doc_id::VARCHAR), 1, 8))::BIGINT % 5 = 0 AS held_out FROM documents""",
    "first_ranks": f"""{_COSINE}, j AS (SELECT near.query_id, min(CASE WHEN e.label = o.label THEN rank - 1 END) AS first_rank FROM near JOIN embeddings e USING (vec_id)
          JOIN embeddings o ON o.vec_id = near.query_id WHERE rank <= 10 AND near.vec_id <> near.query_id GROUP BY 1)
        SELECT count(*) AS queries, round(count(*) FILTER (first_rank <= 1) / count(*), 6) AS hit_1, round(count(*) FILTER (first_rank <= 3) / count(*), 6) AS hit_3,
          round(count(*) FILTER (first_rank <= 5) / count(*), 6) AS hit_5, round(count(*) FILTER (first_rank <= 10) / count(*), 6) AS hit_10,
          round(sum(coalesce(1.0 / first_rank, 0)) / count(*), 6) AS mrr FROM j""",
    "percentile_95": "SELECT event_type, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY 1",
    "events_tumbling": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS events FROM events GROUP BY 1, 2",
    "events_session": """WITH g AS (SELECT user_id, event_id, ts, epoch(ts) - lag(epoch(ts)) OVER w AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        s AS (SELECT user_id, sum(CASE WHEN gap IS NULL OR gap > 1800 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g),
        c AS (SELECT user_id, session, count(*) AS events FROM s GROUP BY ALL) SELECT user_id, count(*) AS sessions, max(events) AS longest FROM c GROUP BY 1""",
}
