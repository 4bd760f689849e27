"""Scalar text functions over documents and conversations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from skein.functions import policy as P
from skein.functions import text as X
from skein.operators.order import numbered
from skein.plans.registry import query
from skein.plans.retrieval import TERMS

_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: Text with the markers that the test tables lack, made the same way on both sides from the id.
MARKED = "concat(text, CASE doc_id % 9 WHEN 0 THEN ' see 40 CFR 60.1 and 04 cfr § 61.2a' WHEN 1 THEN ' what about the exception?' WHEN 2 THEN ' skip the reference' WHEN 3 THEN ' which rule fits parser.py' WHEN 4 THEN ' 法规 要求' WHEN 5 THEN ' password = hunter22' WHEN 6 THEN ' sk-abcdefghijklmnop0123' WHEN 7 THEN ' Bearer abcdefghijkl0' ELSE ' do not use memory' END)"


def _words(column: str, words) -> str:
    return "(" + " OR ".join(f"regexp_matches({column}, '(^|[^A-Za-z0-9]){w.replace('.', chr(92) + '.')}([^A-Za-z0-9]|$)')" for w in words) + ")"


def _holds(column: str, phrases) -> str:
    return "(" + " OR ".join("contains({}, '{}')".format(column, p.replace("'", "''")) for p in phrases) + ")"


@query("one_line", r"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS line FROM documents")
def _(read, spark):
    return read("documents").select("doc_id", X.one_line(F.col("text")).alias("line"))


@query("normalize_body", r"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '(?m)^[ \t]+|[ \t]+$', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '\n+\z', '') AS body FROM documents")
def _(read, spark):
    return read("documents").select("doc_id", X.normalize_body(F.col("text")).alias("body"))


@query("heading_strip", r"SELECT doc_id, rtrim(regexp_replace(' ' || text || '.', '^\s+|\.\s*$', '', 'g')) AS heading FROM documents")
def _(read, spark):
    number = F.col("doc_id").cast("string")
    return read("documents").select("doc_id", X.heading(F.concat(F.lit("§ "), number, F.lit(" "), F.col("text"), F.lit(".")), number).alias("heading"))


@query("path_component", r"SELECT doc_id, printf('%03d', doc_id) || '/' || substr(regexp_replace(regexp_replace(text, '[^A-Za-z0-9._-]+', '-', 'g'), '^[-.]+|[-.]+$', '', 'g'), 1, 48) AS path FROM documents")
def _(read, spark):
    return read("documents").select("doc_id", F.concat(F.format_string("%03d", "doc_id"), F.lit("/"), X.path_component(F.col("text"))).alias("path"))


@query("content_ids", "SELECT doc_id, sha256(text) AS body_sha256, 'doc-' || substr(sha256('2024-01-01' || chr(0) || 'doc ' || doc_id || chr(0) || sha256(text)), 1, 32) AS document_id FROM documents")
def _(read, spark):
    from skein.operators.corpus import document_id

    docs = read("documents").withColumn("body_sha256", F.sha2("text", 256))
    return docs.select("doc_id", "body_sha256", document_id(F.lit("2024-01-01"), F.concat(F.lit("doc "), F.col("doc_id")), F.col("body_sha256")).alias("document_id"))


@query("ascii_lower", f"SELECT doc_id, {_LOW.format('text')} AS low FROM documents")
def _(read, spark):
    return read("documents").select("doc_id", X.ascii_lower(F.col("text")).alias("low"))


@query("is_cjk", rf"SELECT doc_id, regexp_matches({MARKED}, '[\x{{3400}}-\x{{4DBF}}\x{{4E00}}-\x{{9FFF}}\x{{F900}}-\x{{FAFF}}\x{{20000}}-\x{{2FA1F}}]') AS cjk FROM documents")
def _(read, spark):
    return read("documents").select("doc_id", X.has_cjk(F.expr(MARKED)).alias("cjk"))


@query("utf8_valid", "SELECT doc_id, text IS NOT NULL AND NOT contains(text, chr(0)) AS valid, CAST(strlen(text) AS BIGINT) AS bytes FROM documents")
def _(read, spark):
    return read("documents").select("doc_id", (F.col("text").isNotNull() & F.is_valid_utf8("text") & ~F.col("text").contains("\0")).alias("valid"), F.octet_length("text").cast("bigint").alias("bytes"))


@query("tokenize", f"WITH t AS (SELECT doc_id, unnest({TERMS.format(c='text')}) AS term FROM documents) SELECT doc_id, count(*) AS n_terms, count(DISTINCT term) AS n_distinct, min(term) AS first_term FROM t GROUP BY doc_id")
def _(read, spark):
    terms = read("documents").select("doc_id", F.explode(X.tokens(F.col("text"))).alias("term"))
    return terms.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_terms"), F.countDistinct("term").alias("n_distinct"), F.min("term").alias("first_term"))


@query("extract_citations", rf"""
WITH f AS (SELECT doc_id, list_transform(regexp_extract_all({MARKED}, '(?i)\b[0-9]{{1,2}}\s*cfr\s*(?:(?:section|sec\.?|§)\s*)?[0-9]+(?:\.[0-9a-z_-]+)*'), lambda x: lower(x)) AS f FROM documents)
SELECT doc_id, coalesce(array_to_string(list_transform(f, lambda x: regexp_extract(x, '^0*([0-9]+)', 1) || ' cfr ' || regexp_extract(x, '([0-9]+(?:\.[0-9a-z_-]+)*)$', 1)), ','), '') AS citations FROM f
""")
def _(read, spark):
    return read("documents").select("doc_id", F.array_join(X.citations(F.expr(MARKED)), ",").alias("citations"))


@query("full_citation_match", r"SELECT doc_id, regexp_matches(trim(CASE WHEN doc_id % 2 = 0 THEN doc_id % 50 + 1 || ' CFR 60.' || doc_id ELSE text END), '(?i)^[0-9]{1,3}\s+cfr\s+[0-9]+\.[0-9]+$') AS exact FROM documents")
def _(read, spark):
    return read("documents").select("doc_id", P.full_citation(F.expr("CASE WHEN doc_id % 2 = 0 THEN concat(doc_id % 50 + 1, ' CFR 60.', doc_id) ELSE text END")).alias("exact"))


_CJK_SQL = rf"regexp_matches(t, '[\x{{3400}}-\x{{4DBF}}\x{{4E00}}-\x{{9FFF}}\x{{F900}}-\x{{FAFF}}\x{{20000}}-\x{{323AF}}]')"


@query("retrieval_need", f"""
WITH a AS (SELECT doc_id, {MARKED} AS t, {_LOW.format(MARKED)} AS low FROM documents), m AS (SELECT doc_id, {_CJK_SQL} AS cjk,
  regexp_matches(low, '(^|[^0-9])cfr([^0-9]|$)') OR {_words('low', X.CITATION_WORDS)} AS cites,
  CASE WHEN {_CJK_SQL} THEN {_holds('low', X.OMISSIONS_CJK)} ELSE {_holds('low', X.OMISSIONS)} END AS omits,
  CASE WHEN {_CJK_SQL} THEN {_holds('low', X.FOLLOW_UPS_CJK)} ELSE {_holds('low', X.FOLLOW_UPS)} END AS follows,
  CASE WHEN {_CJK_SQL} THEN {_holds('low', X.REGULATORY_CJK)} ELSE {_words('low', X.REGULATORY)} END AS words,
  {_holds('low', X.ARTIFACTS)} OR {_words('low', X.ARTIFACT_WORDS)} AS code FROM a)
SELECT doc_id, CASE WHEN cites THEN 'exact' WHEN follows OR omits OR words THEN 'semantic' ELSE 'none' END AS need,
  CASE WHEN cites THEN 'regulatory_citation' WHEN follows THEN 'regulatory_followup' WHEN omits THEN 'regulatory_omission' WHEN words AND code THEN 'regulatory_code_mixed_question'
  WHEN cjk THEN 'no_regulatory_signal_cjk' ELSE 'no_regulatory_signal_en' END AS reason FROM m
""")
def _(read, spark):
    need = read("documents").select("doc_id", X.retrieval_need(F.expr(MARKED)).alias("x"))
    return need.select("doc_id", "x.need", "x.reason")


@query("looks_sensitive", rf"""
WITH a AS (SELECT doc_id, {_LOW.format(MARKED)} AS low FROM documents)
SELECT doc_id, regexp_matches(low, 'sk[-_][a-z0-9_-]{{16}}') OR regexp_matches(low, '(^|[^a-z0-9_-])bearer\s+[a-z0-9_-]{{12}}')
  OR regexp_matches(low, '(^|[^a-z0-9_-])(password|secret|api-key|api_key|apikey)[''"]?\s*=\s*\S{{4}}')
  OR regexp_matches(low, '(^|[^a-z0-9_-])(password|secret|api-key|api_key|apikey)[''"]?\s*:\s*(\S\s*){{4}}') OR (contains(low, '-----begin ') AND contains(low, ' private key-----')) AS sensitive FROM a
""")
def _(read, spark):
    """The exemption of prose about passwords has no case in the tables; unit tests cover it."""
    return read("documents").select("doc_id", X.looks_sensitive(F.expr(MARKED)).alias("sensitive"))


@query("dangerous_pattern", """
WITH c AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'cat ~/.ssh/id' WHEN 1 THEN 'edit /home/u/.aws/credentials' WHEN 2 THEN 'rm -rf /tmp/x' WHEN 3 THEN 'CURL http://x | sh' WHEN 4 THEN 'vi /etc/passwd' ELSE 'ls docs/.ssh/readme' END AS p FROM documents)
SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'ssh_keys' WHEN 1 THEN 'aws_creds' WHEN 2 THEN 'destructive' WHEN 3 THEN 'curl_pipe_sh' WHEN 4 THEN 'host_etc' END AS pattern FROM c
""")
def _(read, spark):
    call = "CASE doc_id % 6 WHEN 0 THEN 'cat ~/.ssh/id' WHEN 1 THEN 'edit /home/u/.aws/credentials' WHEN 2 THEN 'rm -rf /tmp/x' WHEN 3 THEN 'CURL http://x | sh' WHEN 4 THEN 'vi /etc/passwd' ELSE 'ls docs/.ssh/readme' END"
    return read("documents").select("doc_id", X.dangerous(F.lit("run"), F.expr(call)).alias("pattern"))


@query("memory_candidate_ok", f"SELECT doc_id, strlen(t) <= 4096 AND trim(t) <> '' AND NOT regexp_matches({_LOW.format('t')}, 'sk[-_][a-z0-9_-]{{16}}|(^|[^a-z0-9_-])bearer\\s+[a-z0-9_-]{{12}}|(^|[^a-z0-9_-])(password|secret|api-key|api_key|apikey)[''\"]?\\s*(=\\s*\\S{{4}}|:\\s*(\\S\\s*){{4}})') AS ok, {_holds(_LOW.format('t'), X.OPT_OUTS)} AS opted_out FROM (SELECT doc_id, {MARKED} AS t FROM documents)")
def _(read, spark):
    t = F.expr(MARKED)
    return read("documents").select("doc_id", ((F.octet_length(t) <= 4096) & (F.trim(t) != "") & ~X.looks_sensitive(t)).alias("ok"), X.memory_opted_out(t).alias("opted_out"))


@query("literal_matches", "SELECT doc_id, CAST((length(text) - length(replace(text, 'the', ''))) / 3 AS BIGINT) AS n, CAST(instr(text, 'the') AS BIGINT) AS first_column FROM documents")
def _(read, spark):
    return read("documents").select("doc_id", X.literal_count(F.col("text"), "the").alias("n"), F.coalesce(F.try_element_at(X.literal_positions(F.col("text"), "the"), F.lit(1)), F.lit(0)).cast("bigint").alias("first_column"))


@query("search_text", """
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents), x AS (SELECT doc_id, i AS line, lines[i] AS s FROM l, unnest(range(1, len(lines) + 1)) AS u(i))
SELECT doc_id, line, CAST(instr(s, 'the') AS BIGINT) AS column_no, CAST((length(s) - length(replace(s, 'the', ''))) / 3 AS BIGINT) AS matches FROM x WHERE contains(s, 'the')
""")
def _(read, spark):
    from skein.operators.workspace import search_lines

    found = search_lines(read("documents"), "doc_id", "text", "the")
    return found.groupBy("doc_id", "line").agg(F.min("column_no").cast("bigint").alias("column_no"), F.count(F.lit(1)).alias("matches"))


@query("line_page", """
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents), x AS (SELECT doc_id, i AS line, lines[i] AS s FROM l, unnest(range(2, least(len(lines), 6) + 1)) AS u(i)),
r AS (SELECT *, sum(strlen(s) + 1) OVER (PARTITION BY doc_id ORDER BY line) AS used FROM x)
SELECT doc_id, line, s AS content FROM r WHERE used <= 2000
""")
def _(read, spark):
    from skein.operators.workspace import line_page

    return line_page(read("documents"), "doc_id", "text", start_line=2, max_lines=5, max_bytes=2000)


@query("naive_diff", "SELECT doc_id, array_to_string(list_concat(list_transform(string_split(text, chr(10)), lambda x: '-' || x), list_transform(string_split(replace(text, 'the', 'a'), chr(10)), lambda x: '+' || x)), chr(10)) AS diff FROM documents")
def _(read, spark):
    side = lambda sign, c: F.transform(F.split(c, "\n"), lambda x: F.concat(F.lit(sign), x))
    return read("documents").select("doc_id", F.array_join(F.concat(side("-", F.col("text")), side("+", F.replace("text", F.lit("the"), F.lit("a")))), "\n").alias("diff"))


@query("replace_text", "SELECT doc_id, (length(text) - length(replace(text, 'thnd', ''))) / 4 = 1 AS applied, sha256(CASE WHEN (length(text) - length(replace(text, 'thnd', ''))) / 4 = 1 THEN replace(text, 'thnd', 'AND') ELSE text END) AS after_sha256 FROM documents")
def _(read, spark):
    """Compare and swap: replaced only where the literal occurs exactly once."""
    once = X.literal_count(F.col("text"), "thnd") == 1
    return read("documents").select("doc_id", once.alias("applied"), F.sha2(F.when(once, F.replace("text", F.lit("thnd"), F.lit("AND"))).otherwise(F.col("text")), 256).alias("after_sha256"))


@query("strip_front_matter", "SELECT doc_id, trim(text) AS body FROM documents")
def _(read, spark):
    return read("documents").select("doc_id", X.strip_front_matter(F.concat(F.lit("---\nid: 1\ntitle: x\n---\n"), F.col("text"))).alias("body"))


@query("excerpt_words", "SELECT doc_id, array_to_string(list_slice(regexp_extract_all(text, '[A-Za-z]+'), 1, 8), ' ') AS excerpt FROM documents")
def _(read, spark):
    return read("documents").select("doc_id", F.array_join(F.slice(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), 0), 1, 8), " ").alias("excerpt"))


@query("deterministic_order", "SELECT doc_id, sha256('eval-v2:' || doc_id) AS order_key FROM documents")
def _(read, spark):
    return read("documents").select("doc_id", F.sha2(F.concat(F.lit("eval-v2:"), F.col("doc_id")), 256).alias("order_key"))


@query("sample_by_hash", "SELECT doc_id, CASE WHEN rn <= 60 THEN 'citation' WHEN rn <= 120 THEN 'paraphrase' ELSE 'multi' END AS kind, CAST(rn AS INTEGER) AS place FROM (SELECT doc_id, row_number() OVER (ORDER BY sha256('eval-v2:' || doc_id), doc_id) AS rn FROM documents) WHERE rn <= 180")
def _(read, spark):
    from skein.operators.evals import hash_slices

    return hash_slices(read("documents").select("doc_id"), "doc_id", "eval-v2:", [("citation", 60), ("paraphrase", 60), ("multi", 60)])


@query("url_build", "SELECT page_id, 'https://example.org/section-' || replace(replace(url_encode(url), '%2E', '.'), '%2D', '-') AS link FROM pages")
def _(read, spark):
    return read("pages").select("page_id", F.concat(F.lit("https://example.org/section-"), F.replace(F.replace(F.url_encode("url"), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A"))).alias("link"))


@query("valid_timestamp", "SELECT event_id, event_id % 4 <> 1 AND event_id % 4 <> 2 AS valid, CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || '.000Z' WHEN 1 THEN strftime(ts, '%Y-%m') || '-32T00:00:00.000Z' WHEN 2 THEN strftime(ts, '%Y') || '-02-30T' || strftime(ts, '%H:%M:%S') || '.000Z' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') || '.250Z' END AS normal FROM events")
def _(read, spark):
    """Each event's time as it is, with a day 32, on the 30th of February, and with milliseconds."""
    m, f = F.col("event_id") % 4, lambda p: F.date_format("ts", p)
    stamp = F.when(m == 0, F.concat(f("yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))).when(m == 1, F.concat(f("yyyy-MM"), F.lit("-32T00:00:00Z"))).when(m == 2, F.concat(f("yyyy"), F.lit("-02-30T"), f("HH:mm:ss"), F.lit("Z"))).otherwise(F.concat(f("yyyy-MM-dd'T'HH:mm:ss"), F.lit(".250Z")))
    return read("events").select("event_id", X.valid_timestamp(stamp).alias("valid"), X.normal_timestamp(stamp).alias("normal"))


@query("canonical_date", "SELECT event_id, event_id % 3 = 0 AND day(ts) < 29 AS canonical FROM events")
def _(read, spark):
    """Days of the next February, as ISO writes them, without leading zeros, and with a time."""
    day = F.date_format("ts", "dd")
    text = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("2023-02-"), day)).when(F.col("event_id") % 3 == 1, F.concat(F.lit("2023-2-"), day)).otherwise(F.concat(F.lit("2023-02-"), day, F.lit(" 00:00")))
    return read("events").select("event_id", P.canonical_date(text).alias("canonical"))


@query("id_validators", "WITH x AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'task-' || md5(text) WHEN 1 THEN 'session-' || md5(text) WHEN 2 THEN 'doc-' || md5(text) WHEN 3 THEN 'doc-' || md5(text) || '-chunk-' || substr(md5(text), 1, 16) ELSE upper('memory-' || md5(text)) END AS id FROM documents) SELECT doc_id, doc_id % 5 = 0 AS task, doc_id % 5 = 1 AS session, false AS memory, doc_id % 5 = 2 AS document, doc_id % 5 = 3 AS chunk FROM x")
def _(read, spark):
    made = F.expr("CASE doc_id % 5 WHEN 0 THEN 'task-' || md5(text) WHEN 1 THEN 'session-' || md5(text) WHEN 2 THEN 'doc-' || md5(text) WHEN 3 THEN 'doc-' || md5(text) || '-chunk-' || substr(md5(text), 1, 16) ELSE upper('memory-' || md5(text)) END")
    return read("documents").select("doc_id", *(P.valid_id(made, k).alias(k) for k in P.ID_PATTERNS))


@query("stop_reason_codec", "SELECT event_id, CASE event_type WHEN 'signup' THEN 'end_turn' WHEN 'view' THEN 'tool_use' WHEN 'click' THEN 'max_tokens' WHEN 'purchase' THEN 'stop_sequence' ELSE 'unknown' END AS reason FROM events")
def _(read, spark):
    raw = F.when(F.col("event_type") == "signup", "end_turn").when(F.col("event_type") == "view", "tool_use").when(F.col("event_type") == "click", "max_tokens").when(F.col("event_type") == "purchase", "stop_sequence").otherwise(F.col("event_type"))
    return read("events").select("event_id", P.stop_reason(raw).alias("reason"))


@query("layered_setting", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'policy' WHEN doc_id % 3 = 0 THEN 'project' WHEN doc_id % 2 = 0 THEN 'user' ELSE 'default' END AS setting FROM documents")
def _(read, spark):
    layer = lambda n, name: F.when(F.col("doc_id") % n == 0, F.lit(name))
    return read("documents").select("doc_id", P.layered(layer(4, "policy"), layer(3, "project"), layer(2, "user"), F.lit("default")).alias("setting"))


@query("backoff_delay", "SELECT event_id, CAST(least(100 * pow(2, event_id % 10), 8000) AS BIGINT) AS delay_ms FROM events")
def _(read, spark):
    return read("events").select("event_id", P.backoff_ms(F.col("event_id") % 10 + 1, 100, 8000).alias("delay_ms"))


@query("no_match_text", f"SELECT doc_id, CASE WHEN regexp_matches({MARKED}, '[\\x{{4E00}}-\\x{{9FFF}}]') THEN '{P.NO_MATCH_ZH}' ELSE '{P.NO_MATCH_EN}' END AS answer FROM documents")
def _(read, spark):
    return read("documents").select("doc_id", P.no_match_text(F.expr(MARKED)).alias("answer"))


@query("failure_summary", "SELECT event_id, CASE event_type WHEN 'error' THEN 'task failed' WHEN 'click' THEN 'task cancelled' WHEN 'view' THEN 'task budget exceeded' END AS summary FROM events")
def _(read, spark):
    c = F.col("event_type")
    status = F.when(c == "error", "failed").when(c == "click", "cancelled").when(c == "view", "budget_exceeded").otherwise("completed")
    return read("events").select("event_id", P.failure_summary(status).alias("summary"))


@query("html_blocks", "SELECT page_id, CAST(len(x) AS BIGINT) AS items, coalesce(array_to_string(list_transform(x, lambda s: '- ' || trim(regexp_replace(regexp_replace(s, '<[^>]*>', '', 'g'), '\\s+', ' ', 'g'))), chr(10)), '') AS list FROM (SELECT page_id, regexp_extract_all(html, '(?s)<li>.*?</li>') AS x FROM pages)")
def _(read, spark):
    """List items as a rendered list."""
    items = F.transform(F.regexp_extract_all("html", F.lit(r"(?s)<li>.*?</li>"), 0), lambda s: F.concat(F.lit("- "), X.one_line(F.regexp_replace(s, "<[^>]*>", ""))))
    return read("pages").select("page_id", F.size(items).cast("bigint").alias("items"), F.array_join(items, "\n").alias("list"))


@query("serialize_markdown", "SELECT doc_id, sha256('---' || chr(10) || 'id: ' || doc_id || chr(10) || 'lang: ' || to_json(lang) || chr(10) || '---' || chr(10) || chr(10) || '# doc ' || doc_id || chr(10) || chr(10) || text || chr(10)) AS file_sha256 FROM documents")
def _(read, spark):
    from skein.operators.corpus import markdown

    docs = read("documents").withColumn("heading", F.concat(F.lit("doc "), F.col("doc_id")))
    return docs.select("doc_id", F.sha2(markdown({"id": F.col("doc_id").cast("string"), "lang": F.concat(F.lit('"'), F.col("lang"), F.lit('"'))}, F.col("heading"), F.col("text")), 256).alias("file_sha256"))


@query("path_order", "SELECT lang, source || '/' || doc_id AS path, row_number() OVER (PARTITION BY lang ORDER BY source || '/' || doc_id COLLATE \"C\") AS place FROM documents QUALIFY place <= 200".replace(' COLLATE "C"', ""))
def _(read, spark):
    """Paths in the order of their bytes, 200 of each folder at most: a listing is cut there. Each task keeps its own first ones."""
    rows = read("documents").select("lang", F.concat("source", F.lit("/"), "doc_id").alias("path"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("path")).cast("bigint")).where("place <= 200")


@query("prefix_order", "SELECT doc_id, row_number() OVER (ORDER BY lang, source, doc_id) AS place FROM documents")
def _(read, spark):
    return numbered(read("documents").select("doc_id", "lang", "source"), [F.col("lang"), F.col("source"), F.col("doc_id")], "place").select("doc_id", "place")


@query("zh_concepts", "WITH w AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Safety and RECORDS of safety' WHEN 1 THEN 'License, licensing; permit' WHEN 2 THEN 'General provisions' ELSE lang END AS t FROM documents) SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '安全,记录' WHEN 1 THEN '许可,许可证' WHEN 2 THEN '一般规定' ELSE '' END AS concepts FROM w")
def _(read, spark):
    m = F.col("doc_id") % 4
    title = F.when(m == 0, "Safety and RECORDS of safety").when(m == 1, "License, licensing; permit").when(m == 2, "General provisions").otherwise(F.col("lang"))
    return read("documents").select("doc_id", F.array_join(P.zh_concepts(title), ",").alias("concepts"))


@query("line_fragment", "WITH x AS (SELECT doc_id, regexp_replace(regexp_replace(text, '[^ -~]', 'e', 'g'), '\\s', ' ', 'g') AS s FROM documents), m AS (SELECT *, instr(s, 'the') - 1 AS o FROM x WHERE contains(s, 'the')), b AS (SELECT *, greatest(o - 341, 0) AS f FROM m) SELECT doc_id, CASE WHEN length(s) <= 1024 THEN s ELSE substr(s, CAST(f + 1 AS BIGINT), CAST(least(length(s), f + 1024) - f AS BIGINT)) END AS fragment FROM b")
def _(read, spark):
    """Each text as one line of ASCII, around its first match; the edges of characters are covered by unit tests."""
    line = F.regexp_replace(F.regexp_replace("text", "[^ -~]", "e"), r"\s", " ")
    rows = read("documents").select("doc_id", line.alias("s")).where(F.col("s").contains("the"))
    return rows.select("doc_id", P.line_fragment(F.col("s"), F.instr("s", "the") - 1, 3).alias("fragment"))


@query("metadata_budget", "SELECT event_id, event_id % 5 NOT IN (1, 2, 3) AS ok FROM events")
def _(read, spark):
    """Values that are too deep, have too many nodes or too long strings, next to those that are sound."""
    m = F.col("event_id") % 5
    deep = F.concat(F.repeat(F.lit("["), F.lit(18)), F.repeat(F.lit("]"), F.lit(18)))
    wide = F.concat(F.lit("["), F.array_join(F.array_repeat(F.col("event_id").cast("string"), 300), ","), F.lit("]"))
    value = F.when(m == 1, deep).when(m == 2, wide).when(m == 3, F.concat(F.lit('{"k": "'), F.repeat(F.lit("x"), F.lit(4100)), F.lit('"}'))).otherwise(F.col("props"))
    return read("events").select("event_id", P.metadata_ok(value).alias("ok"))


@query("flatten_value", "SELECT event_id, 'k tail ' || event_type || ' ' || CAST(json_extract(props, '$.k') AS VARCHAR) AS flat FROM events")
def _(read, spark):
    value = F.to_json(F.struct(F.get_json_object("props", "$.k").cast("int").alias("k"), F.array(F.col("event_type")).alias("tail")))
    return read("events").select("event_id", P.flatten_value(value).alias("flat"))


@query("evidence_pack_valid", "SELECT conv_id, count(*) <= 20 AND max(strlen(text)) <= 8192 AND sum(strlen(text)) <= 32768 AND conv_id % 5 <> 0 AS ok FROM conversations GROUP BY conv_id")
def _(read, spark):
    """A conversation's turns as evidence; every fifth one is said to have no match."""
    rows = read("conversations").groupBy("conv_id").agg(F.collect_list(F.struct(F.col("turn").cast("string").alias("source_id"), F.col("text").alias("content"))).alias("items"))
    return rows.select("conv_id", P.evidence_ok(F.col("items"), F.col("conv_id") % 5 == 0).alias("ok"))


@query("response_valid", "SELECT conv_id, turn, CASE (conv_id + turn) % 4 WHEN 0 THEN length(text) > 0 WHEN 1 THEN true WHEN 2 THEN false ELSE false END AS ok FROM conversations")
def _(read, spark):
    """Text alone, a call with its reason, a call without it, and one id twice."""
    m = (F.col("conv_id") + F.col("turn")) % 4
    block = lambda kind, id_: F.struct(F.lit(kind).alias("type"), F.lit(id_).cast("string").alias("id"), F.col("text").alias("text"))
    content = F.when(m == 0, F.array(block("text", None))).when(m == 3, F.array(block("tool_use", "a"), block("tool_use", "a"))).otherwise(F.array(block("text", None), block("tool_use", "a")))
    return read("conversations").select("conv_id", "turn", P.response_ok(content, F.when(m.isin(1, 3), "tool_use").otherwise("end_turn")).alias("ok"))


_ASKED = "CASE (conv_id + turn) % 5 WHEN 0 THEN chr(10) || ' /' || text WHEN 1 THEN text || ' Don''t use RAG' WHEN 2 THEN text || ' 不要用知识库' WHEN 3 THEN 'a/' || text ELSE text END"


@query("retrieval_opted_out", f"WITH t AS (SELECT conv_id, turn, {_ASKED} AS t FROM conversations) SELECT conv_id, turn, starts_with(ltrim(t, ' ' || chr(9) || chr(10) || chr(13)), '/') OR {_holds(_LOW.format('t'), (*X.RETRIEVAL_OPT_OUTS, *X.RETRIEVAL_OPT_OUTS_CJK))} AS skipped FROM t")
def _(read, spark):
    """Turns for which nothing is looked up; of five, one is made a command and two say so."""
    asked = F.expr(_ASKED.replace("Don''t", "Don\\'t").replace("chr(10)", "'\\n'"))
    return read("conversations").select("conv_id", "turn", X.retrieval_opted_out(asked).alias("skipped"))
