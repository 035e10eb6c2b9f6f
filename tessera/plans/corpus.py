"""Chunking, question analysis, conversations, JSON and training-data queries with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import analyze
from tessera.functions import values as V
from tessera.functions.text import chunk_id, duration_seconds, duration_text, embedding_text, hash_choice, jaccard, token_estimate
from tessera.operators import batches, chunking, training
from tessera.plans.retrieval import table

# --- chunks ------------------------------------------------------------------------------------------------------------


def line_chunks(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    out = chunking.line_chunks(docs, F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string")), F.col("text"), size=20)
    return out.select("id", "path", "start_line", "end_line", F.sha2("content", 256).alias("content_sha256"))


def _head(line):
    return line.rlike("^[A-Z][^ ]*[.]$")


def section_split(spark, sf_dir):
    """Sections of documents, where a line of one capitalised word with a point is taken for a header."""
    out = chunking.sections(table(spark, sf_dir, "documents"), F.col("doc_id"), F.col("text"), _head)
    return out.select("key", "section", "title", "start_line", F.sha2("content", 256).alias("content_sha256"))


def token_estimates(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", token_estimate(F.col("text")).alias("tokens"))


def oversize_report(spark, sf_dir):
    over = chunking.oversize(table(spark, sf_dir, "documents"), "text", 5000)
    return over.groupBy("reason", "lang").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("tokens")).orderBy(F.desc("n"))


def oversize_largest(spark, sf_dir):
    return chunking.oversize(table(spark, sf_dir, "documents"), "text", 5000).select("doc_id", "tokens").orderBy(F.desc("tokens"), "doc_id").limit(5)


def _sized(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select("source", "doc_id", token_estimate(F.col("text")).alias("tokens"))


def batch_pack(spark, sf_dir):
    """All documents as one running sequence."""
    return batches.batch_pack(_sized(spark, sf_dir), [], "doc_id", "tokens")


def batch_pack_by_source(spark, sf_dir):
    return batches.batch_pack(_sized(spark, sf_dir), ["source"], "doc_id", "tokens")


def embedding_texts(spark, sf_dir):
    nothing = F.lit("")
    text = embedding_text(F.col("lang"), F.lit("document"), F.col("source"), nothing, F.lit(None).cast("string"), F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(text, 256).alias("text_sha256"))


def chunk_ids(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", chunk_id(F.col("source"), F.col("doc_id").cast("string"), F.lit("document")).alias("id"))


LINES = r"regexp_split_to_array(regexp_replace(text, '(\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x{85}\x{2028}\x{2029}])\z', ''), '\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x{85}\x{2028}\x{2029}]')"
LINE_SQL = f"""WITH l AS (SELECT source || '/' || doc_id AS path, {LINES} AS lines FROM documents WHERE text <> ''),
s AS (SELECT path, lines, unnest(range(1, len(lines) + 1, 20)) AS start_line FROM l)
SELECT left(sha256(path || ':lines' || start_line || ':document'), 16) AS id, path, start_line, start_line + len(part) - 1 AS end_line, sha256(array_to_string(part, chr(10))) AS content_sha256
FROM (SELECT path, start_line, lines[start_line:start_line + 19] AS part FROM s) WHERE len(part) >= 3"""
SECTION_SQL = f"""WITH l AS (SELECT doc_id AS key, {LINES} AS lines FROM documents WHERE text <> ''),
x AS (SELECT key, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM l),
h AS (SELECT *, regexp_matches(line, '^[A-Z][^ ]*[.]$') AS head FROM x),
s AS (SELECT *, sum(head::int) OVER (PARTITION BY key ORDER BY pos) AS section FROM h)
SELECT key, section::bigint AS section, coalesce(max(CASE WHEN head THEN trim(regexp_replace(line, '^#+', '')) END), '') AS title, min(pos) AS start_line, sha256(string_agg(line, chr(10) ORDER BY pos)) AS content_sha256
FROM s GROUP BY key, section"""

def _pack_sql(group: str) -> str:
    over = "p.total + d.tokens > 15000 OR p.n >= 100"
    return f"""WITH RECURSIVE d AS (
  SELECT {group} AS g, doc_id, length(text) // 2 AS tokens, row_number() OVER (PARTITION BY {group} ORDER BY doc_id) AS rn FROM documents
), p AS (
  SELECT g, doc_id, rn, 0 AS batch, 1 AS n, tokens AS total FROM d WHERE rn = 1
  UNION ALL
  SELECT d.g, d.doc_id, d.rn, p.batch + ({over})::int, CASE WHEN {over} THEN 1 ELSE p.n + 1 END, CASE WHEN {over} THEN d.tokens ELSE p.total + d.tokens END
  FROM p JOIN d ON d.g = p.g AND d.rn = p.rn + 1
) SELECT g AS source, doc_id, batch::bigint AS batch FROM p"""


# --- questions ----------------------------------------------------------------------------------------------------------


def _questions(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", "turn", "text")


#: Questions with names and phrases that the conversations do not have.
ASKED = [
    ("q1", "List all classes that extend BaseService"), ("q2", "How does OrderService.processPayment handle a database error?"), ("q3", "Where is UserDao used by loadAccount and saveAccount?"),
    ("q4", "Compare JsonParser vs XmlParser"), ("q5", "What is the UserRepository?"), ("q6", "find the login validation"), ("q7", "Explain why doesCache expire the auth token"), ("q8", "Which tables does the schema of Invoice have?"), ("q9", ""),
]


def asked(spark, sf_dir) -> DataFrame:
    """qid, text: all user turns of the conversations, and the questions above."""
    more = spark.createDataFrame(ASKED, "qid string, text string")
    return _questions(spark, sf_dir).select(F.concat_ws(":", "conv_id", "turn").alias("qid"), "text").unionByName(more)


def intent_classify(spark, sf_dir):
    return _questions(spark, sf_dir).select("conv_id", "turn", analyze.intent(F.col("text")).alias("intent"))


def query_recommend(spark, sf_dir):
    found = _questions(spark, sf_dir).select("conv_id", "turn", analyze.recommendation(analyze.intent(F.col("text")), analyze.class_names(F.col("text"))).alias("r"))
    return found.select("conv_id", "turn", "r.*")


def primary_terms(spark, sf_dir):
    return _questions(spark, sf_dir).select("conv_id", "turn", F.array_join(analyze.primary_terms(F.col("text")), ",").alias("terms"))


def search_keywords(spark, sf_dir):
    return _questions(spark, sf_dir).select("conv_id", "turn", F.array_join(analyze.search_keywords(F.col("text")), ",").alias("keywords"))


def term_expand(spark, sf_dir):
    return asked(spark, sf_dir).select("qid", F.array_join(analyze.expanded_terms(analyze.primary_terms(F.col("text"))), ",").alias("terms"))


def question_analysis(spark, sf_dir):
    text = F.col("text")
    out = asked(spark, sf_dir).select("qid", analyze.intent(text).alias("intent"), F.array_join(analyze.class_names(text), ",").alias("classes"), F.array_join(analyze.method_names(text), ",").alias("methods"), F.array_join(analyze.primary_terms(text), ",").alias("terms"), analyze.recommendation(analyze.intent(text), analyze.class_names(text)).alias("r"))
    return out.select("qid", "intent", "classes", "methods", "terms", "r.*")


def question_language(spark, sf_dir):
    """The language that a question names, and whether it asks for a list of classes."""
    text = F.col("text")
    return asked(spark, sf_dir).select("qid", analyze.asked_language(text).alias("language"), analyze.asks_for_class_list(text).alias("lists"))


def _quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


INTENT = "CASE " + " ".join(f"WHEN list_has_any(list_transform([{_quoted(p)}], lambda x: CASE WHEN contains(lower(trim(text)), x) THEN 1 ELSE 0 END), [1]) THEN '{name}'" for name, p in V.INTENT_PHRASES.items()) + f" ELSE '{V.DEFAULT_INTENT}' END"
ASKED_SQL = "(SELECT conv_id || ':' || turn AS qid, text FROM conversations WHERE role = 'user' UNION ALL SELECT * FROM (VALUES " + ", ".join(f"({_quoted([i])}, {_quoted([t])})" for i, t in ASKED) + ") v(qid, text))"
USERS_SQL = "(SELECT conv_id, turn, text FROM conversations WHERE role = 'user')"


def _names_sql(source: str, keys: str) -> str:
    """keys, text, classes, methods, words (lower-case candidates), terms, intent."""
    return f"""(SELECT {keys}, text, classes, methods, {INTENT} AS intent,
  list_concat(list_concat(classes, methods), list_filter(more, lambda x, i: list_position(more, x) = i))[1:10] AS terms FROM (
    SELECT *, list_filter(low, lambda x: regexp_matches(x, '^[a-z][a-z0-9_]*$') AND length(x) > 2 AND NOT list_contains([{_quoted(V.STOP_WORDS)}], x)
      AND NOT list_contains(list_transform(list_concat(classes, methods), lambda y: lower(y)), x)) AS more FROM (
      SELECT {keys}, text, regexp_extract_all(lower(trim(text)), '[\\p{{L}}\\p{{N}}_]+') AS low,
        list_filter(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+'), lambda x: regexp_matches(x, '^[A-Z][a-zA-Z0-9]*$') AND length(x) >= 2 AND NOT list_contains([{_quoted(V.COMMON_WORDS)}], x)) AS classes,
        list_filter(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+'), lambda x: regexp_matches(x, '^[a-z][a-zA-Z0-9]*[A-Z][a-zA-Z0-9]*$')) AS methods
      FROM {source})))"""


def _recommend_sql(i: int) -> str:
    lit = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else f"'{v}'" if isinstance(v, str) else f"{v}::double" if isinstance(v, float) else str(v)
    named = lambda n, v: f"CASE WHEN len(classes) > 0 THEN {lit(v)} END" if n == "definition" and i == 3 else lit(v)
    return "CASE intent " + " ".join(f"WHEN '{n}' THEN {named(n, r[i])}" for n, r in V.RECOMMENDATIONS.items()) + " END"


RECOMMEND = f"{_recommend_sql(0)} AS top_k, {_recommend_sql(1)} AS min_similarity, {_recommend_sql(2)} AS include_dependencies, {_recommend_sql(3)} AS chunk_type"
USER_NAMES = _names_sql(USERS_SQL, "conv_id, turn")
ASKED_NAMES = _names_sql(ASKED_SQL, "qid")
EXPANSION_ROWS = ", ".join(f"('{k}', '{e}')" for k, es in V.TERM_EXPANSIONS.items() for e in es)
EXPAND_SQL = f"""WITH x AS (SELECT * FROM (VALUES {EXPANSION_ROWS}) v(term, expansion)), q AS (SELECT qid, list_transform(terms, lambda t: lower(t)) AS low FROM {ASKED_NAMES}),
f AS (
  SELECT qid, expansion AS t FROM q, x WHERE list_contains(low, term)
  UNION SELECT qid, term FROM q, x WHERE list_contains(low, expansion)
  UNION SELECT qid, y.expansion FROM q, x, x y WHERE list_contains(low, x.expansion) AND y.term = x.term
), g AS (SELECT qid, t, row_number() OVER (PARTITION BY qid ORDER BY t) AS n FROM f JOIN q USING (qid) WHERE NOT list_contains(low, t))
SELECT q.qid, coalesce(string_agg(t, ',' ORDER BY t) FILTER (WHERE n <= 15), '') AS terms FROM q LEFT JOIN g USING (qid) GROUP BY q.qid"""
KEYWORD_LIST_SQL = f"""SELECT conv_id, turn, array_to_string(list_filter(every, lambda x, i: list_position(list_transform(every, lambda y: lower(y)), lower(x)) = i)[1:10], ',') AS keywords
FROM (SELECT conv_id, turn, list_concat(list_concat(classes, methods), terms) AS every FROM {USER_NAMES})"""

# --- conversations -------------------------------------------------------------------------------------------------------


def history_window(spark, sf_dir):
    return chunking.history(table(spark, sf_dir, "conversations")).select("conv_id", "turn", "history")


def history_trim(spark, sf_dir):
    return chunking.trimmed_history(table(spark, sf_dir, "conversations"), 2).select("conv_id", "turn", "role")


def enhanced_question(spark, sf_dir):
    return chunking.enhanced_questions(table(spark, sf_dir, "conversations"))


HISTORY_SQL = """SELECT conv_id, turn, role, text, coalesce(string_agg(role || ': ' || left(text, 200) || '...', chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), '') AS history FROM conversations"""

# --- JSON ----------------------------------------------------------------------------------------------------------------


def json_keys(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.array_join(F.json_object_keys("props"), ",").alias("keys"))


def json_explode(spark, sf_dir):
    rows = table(spark, sf_dir, "events").filter(F.try_parse_json("props").isNotNull())
    return rows.select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("key", "value"))


def json_path(spark, sf_dir):
    return table(spark, sf_dir, "events").filter(F.get_json_object("props", "$.k").cast("int") > 50).select("event_id", F.get_json_object("props", "$.k").alias("k"))


# --- training rows ---------------------------------------------------------------------------------------------------------


def _pairs(spark, sf_dir) -> DataFrame:
    """User turns with the assistant's turn right after."""
    turns = table(spark, sf_dir, "conversations")
    user = turns.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("prompt"))
    model = turns.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return user.join(model, ["conv_id", "turn"])


PAIRS_SQL = "(SELECT u.conv_id, u.turn, u.text AS prompt, a.text AS answer FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant')"
SYSTEM = "You answer questions about code."


def chat_format(spark, sf_dir):
    return _pairs(spark, sf_dir).select("conv_id", "turn", training.chat_record(F.lit(SYSTEM), F.col("prompt"), F.col("answer")).alias("line"))


def chat_parse(spark, sf_dir):
    lines = _pairs(spark, sf_dir).select(training.chat_record(F.lit(SYSTEM), F.col("prompt"), F.col("answer")).alias("value"))
    return training.prompts(lines)


CHAT_SQL = f"""SELECT conv_id, turn, to_json({{'systemInstruction': {{'role': 'system', 'parts': [{{'text': '{SYSTEM}'}}]}},
'contents': [{{'role': 'user', 'parts': [{{'text': prompt}}]}}, {{'role': 'model', 'parts': [{{'text': answer}}]}}]}})::varchar AS line FROM {PAIRS_SQL}"""


def train_val_split(spark, sf_dir):
    return training.split(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")


def split_stats(spark, sf_dir):
    return train_val_split(spark, sf_dir).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


def sample_rows(spark, sf_dir):
    return training.sample(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", 25, "seed1")


def shuffle_rows(spark, sf_dir):
    return training.shuffled(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", "seed1")


def template_choice(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", hash_choice(F.col("doc_id").cast("string"), 7).alias("choice"))


SPLIT_SQL = """SELECT doc_id, lang, CASE WHEN row_number() OVER (ORDER BY sha256(doc_id::varchar)) <= least(floor((SELECT count(*) FROM documents) * 0.1), 500) THEN 'validation' ELSE 'train' END AS split FROM documents"""


def jaccard_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir).select("conv_id", "turn", F.round(jaccard(F.col("prompt"), F.col("answer")), 6).alias("similarity"))


def _results(spark, sf_dir) -> DataFrame:
    failed = F.col("turn") % 3 == 2
    return training.evaluate(_pairs(spark, sf_dir).select("conv_id", "turn", F.col("prompt").alias("expected"), F.when(~failed, F.col("answer")).alias("actual")))


def eval_summary(spark, sf_dir):
    return training.summary(_results(spark, sf_dir))


def eval_compare(spark, sf_dir):
    pairs = _pairs(spark, sf_dir).withColumn("prompt_id", F.concat_ws(":", "conv_id", "turn"))
    base, tuned = pairs.select("prompt_id", F.col("answer").alias("actual")), pairs.filter(F.col("answer") != "").select("prompt_id", F.reverse("answer").alias("actual"))
    return training.compare(base, tuned, "prompt_id")


def file_figures(spark, sf_dir):
    return training.file_figures(chat_format(spark, sf_dir), "line")


WORDS = lambda c: f"list_distinct(list_filter(regexp_split_to_array(trim(lower({c})), '\\s+'), lambda x: x <> ''))"
JACCARD = f"round(CASE WHEN len(list_distinct(list_concat({WORDS('prompt')}, {WORDS('answer')}))) = 0 THEN 1.0::double ELSE len(list_intersect({WORDS('prompt')}, {WORDS('answer')}))::double / len(list_distinct(list_concat({WORDS('prompt')}, {WORDS('answer')}))) END, 6)"

def active_times(spark, sf_dir):
    """The time from the first to the last event of each user."""
    seen = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    seconds = duration_seconds(F.col("first"), F.col("last"))
    return seen.select("user_id", seconds.alias("seconds"), duration_text(seconds).alias("shown"))


ACTIVE_SQL = """SELECT user_id, us / 1000000.0::double AS seconds, us // 3600000000 || 'h ' || us // 60000000 % 60 || 'm ' || us // 1000000 % 60 || 's' AS shown
FROM (SELECT user_id, epoch_us(max(ts)) - epoch_us(min(ts)) AS us FROM events GROUP BY user_id)"""

QUERIES = {f.__name__: f for f in (
    line_chunks, section_split, token_estimates, oversize_report, oversize_largest, batch_pack, batch_pack_by_source, active_times, embedding_texts, chunk_ids,
    intent_classify, query_recommend, primary_terms, search_keywords, term_expand, question_analysis, question_language, history_window, history_trim, enhanced_question,
    json_keys, json_explode, json_path, chat_format, chat_parse, train_val_split, split_stats, sample_rows, shuffle_rows, template_choice, jaccard_pairs, eval_summary, eval_compare, file_figures,
)}

ORACLES = {
    "line_chunks": LINE_SQL,
    "section_split": SECTION_SQL,
    "token_estimates": "SELECT doc_id, length(text) // 2 AS tokens FROM documents",
    "oversize_report": "SELECT 'too many tokens' AS reason, lang, count(*) AS n, sum(length(text) // 2)::bigint AS tokens FROM documents WHERE length(text) // 2 > 5000 GROUP BY lang",
    "oversize_largest": "SELECT doc_id, length(text) // 2 AS tokens FROM documents WHERE length(text) // 2 > 5000 ORDER BY tokens DESC, doc_id LIMIT 5",
    "active_times": ACTIVE_SQL,
    "batch_pack": f"SELECT doc_id, batch FROM ({_pack_sql("''")})",
    "batch_pack_by_source": _pack_sql("source"),
    "embedding_texts": "SELECT doc_id, sha256(concat_ws(chr(10), 'Language: ' || lang, 'Type: document', 'Class: ' || source, 'Code:' || chr(10) || text)) AS text_sha256 FROM documents",
    "chunk_ids": "SELECT doc_id, left(sha256(source || ':' || doc_id || ':document'), 16) AS id FROM documents",
    "intent_classify": f"SELECT conv_id, turn, {INTENT} AS intent FROM {USERS_SQL}",
    "query_recommend": f"SELECT conv_id, turn, {RECOMMEND} FROM {USER_NAMES}",
    "primary_terms": f"SELECT conv_id, turn, array_to_string(terms, ',') AS terms FROM {USER_NAMES}",
    "search_keywords": KEYWORD_LIST_SQL,
    "term_expand": EXPAND_SQL,
    "question_analysis": f"SELECT qid, intent, array_to_string(classes, ',') AS classes, array_to_string(methods, ',') AS methods, array_to_string(terms, ',') AS terms, {RECOMMEND} FROM {ASKED_NAMES}",
    "question_language": f"""SELECT qid, CASE {" ".join(f"WHEN contains(lower(text), '{x}') THEN '{x}'" for x in ("java", "python", "javascript", "typescript"))} END AS language,
  ({" OR ".join(f"contains(lower(text), '{x}')" for x in V.CLASS_LIST_PHRASES)}) AND contains(lower(text), 'class') AS lists FROM {ASKED_SQL}""",
    "history_window": f"SELECT conv_id, turn, history FROM ({HISTORY_SQL})",
    "history_trim": "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS b FROM conversations) WHERE b <= 4",
    "enhanced_question": f"SELECT conv_id, turn, CASE WHEN history = '' THEN text ELSE 'Previous conversation:' || chr(10) || history || chr(10) || chr(10) || 'Current question: ' || text END AS question FROM ({HISTORY_SQL}) WHERE role = 'user'",
    "json_keys": "SELECT event_id, array_to_string(json_keys(props), ',') AS keys FROM events",
    "json_explode": "SELECT event_id, k AS key, json_extract_string(props, '$.' || k) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events WHERE json_valid(props))",
    "json_path": "SELECT event_id, props->>'k' AS k FROM events WHERE (props->>'k')::int > 50",
    "chat_format": CHAT_SQL,
    "chat_parse": f"SELECT prompt, answer AS expected FROM {PAIRS_SQL}",
    "train_val_split": SPLIT_SQL,
    "split_stats": f"SELECT split, count(*) AS n FROM ({SPLIT_SQL}) GROUP BY split",
    "sample_rows": "SELECT doc_id, lang FROM documents ORDER BY sha256('seed1' || doc_id), doc_id LIMIT 25",
    "shuffle_rows": "SELECT doc_id, lang FROM documents ORDER BY sha256('seed1' || doc_id), doc_id",
    "template_choice": "SELECT doc_id, ('0x' || left(sha256(doc_id::varchar), 8))::bigint % 7 AS choice FROM documents",
    "jaccard_pairs": f"SELECT conv_id, turn, {JACCARD} AS similarity FROM {PAIRS_SQL}",
    "eval_summary": f"SELECT count(*) AS total, count(*) FILTER (WHERE turn % 3 <> 2) AS successful, count(*) FILTER (WHERE turn % 3 = 2) AS failed, round(coalesce(avg({JACCARD}) FILTER (WHERE turn % 3 <> 2), 0), 6) AS mean_similarity FROM {PAIRS_SQL}",
    "eval_compare": f"SELECT conv_id || ':' || turn AS prompt_id, answer AS base, CASE WHEN answer <> '' THEN reverse(answer) END AS tuned FROM {PAIRS_SQL}",
    "file_figures": f"SELECT count(*) AS examples, floor(sum(strlen(line) + 1) / 4.0)::bigint AS tokens FROM ({CHAT_SQL})",
}
