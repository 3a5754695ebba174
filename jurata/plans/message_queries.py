"""Registered queries of messages, digests and texts for people: JSON forms, redaction, names, widths, prompts, exports listed."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import digest as D
from ..functions import prompts as P
from ..functions import text as X
from ..operators import export as E
from ..operators import records as R
from ..operators import requests as Q
from ..schemas import REFS
from . import adapter as V

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    """Registers a function of (spark, sf_dir) under its name with its SQL."""

    def add(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


def _table(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@query(
    """SELECT doc_id, sha256('{"flags": [true, null, []], "n": ' || n_chars || ', "part": {"lang": ' || coalesce(to_json(lang), 'null') || ', "ratio": ' || cast(n_chars / 7 AS varchar) || '}, "q": ' || coalesce(to_json(text), 'null') || ', "source": ' || coalesce(to_json(source), 'null') || '}') AS digest FROM documents"""
)
def canonical_digest(spark, d):
    """The digest of an object whose keys stand in another order, with white space of its own."""
    value = lambda c: F.regexp_extract(F.to_json(F.struct(F.col(c).alias("v")), {"ignoreNullFields": "false"}), r'(?s)^\{"v":(.*)\}$', 1)
    raw = F.concat(F.lit('{ "source" :'), value("source"), F.lit(',\n"q":'), value("text"), F.lit(',"part":{"ratio":'), (F.col("n_chars") / 7).cast("string"), F.lit(',  "lang":'), value("lang"), F.lit('},"n":'), F.col("n_chars").cast("string"), F.lit(',"flags":[true,\tnull,[ ]]}'))
    return _table(spark, d, "documents").select("doc_id", D.result_digest(raw).alias("digest"))


_FILLED = {"ref1": "text", "ref2": "CASE WHEN doc_id % 3 = 0 THEN lang END", "ref7": "CASE WHEN doc_id % 2 = 0 THEN source ELSE '' END"}


def _refs():
    return F.struct(*[F.expr(_FILLED.get(r, "cast(null as string)")).alias(r) for r in REFS])


_REFS_JSON = "'{' || " + " || ',' || ".join(f"""'"{r}":' || to_json(coalesce({_FILLED.get(r, "NULL::varchar")}, ''))""" for r in REFS) + " || '}'"


@query(f"SELECT doc_id, md5({_REFS_JSON}) AS stored, CASE WHEN doc_id % 3 = 0 THEN lang END AS ref2, CASE WHEN doc_id % 2 = 0 THEN nullif(source, '') END AS ref7 FROM documents")
def stored_refs(spark, d):
    """References as they are stored, and read back: empty ones are null again."""
    rows = _table(spark, d, "documents").select("doc_id", D.refs_json(_refs()).alias("j")).withColumn("r", D.refs_of(F.col("j")))
    return rows.select("doc_id", F.md5(F.col("j").cast("binary")).alias("stored"), "r.ref2", "r.ref7")


@query(
    r"""WITH m AS (SELECT doc_id, ' ' || source || ' sk-' || md5(cast(doc_id AS varchar)) || ' at C:\out\run' || doc_id || '\a.xlsx and D:/x/' || lang || chr(10) || text AS m FROM documents)
SELECT doc_id, md5(regexp_replace(replace(replace(m, 'src12', '***'), 'src1', '***'), '\bsk-[A-Za-z0-9_\-]{8,}\b', '***', 'g')) AS redacted,
regexp_replace(regexp_replace(split_part(trim(m, ' ' || chr(10)), chr(10), 1), '(?i)C:\\out(?:[\\/][^\s''"]*)?', '<outputs>', 'g'), '(?:[A-Za-z]:[\\/]|\\\\)[^\s''"]*', '<path>', 'g')[1:300] AS scrubbed FROM m"""
)
def redacted_messages(spark, d):
    """Messages with keys, secrets (one the start of another) and places in them."""
    m = F.concat(F.lit(" "), "source", F.lit(" sk-"), F.md5(F.col("doc_id").cast("string").cast("binary")), F.lit(" at C:\\out\\run"), "doc_id", F.lit("\\a.xlsx and D:/x/"), "lang", F.lit("\n"), "text")
    rows = _table(spark, d, "documents").select("doc_id", m.alias("m"))
    return rows.select("doc_id", F.md5(X.redact(F.col("m"), ("src1", "src12")).cast("binary")).alias("redacted"), X.scrub_paths(F.col("m"), "C:\\out").alias("scrubbed"))


@query(
    f"WITH o AS (SELECT doc_id, repeat(text, doc_id % 12) AS v, trim(text, ' ' || chr(10)) AS t FROM documents) SELECT doc_id, md5(CASE WHEN length(v) > 8000 THEN v[1:6000] || {_quoted(X.OUTPUT_GAP)} || right(v, 2000) ELSE v END) AS clipped, CASE WHEN length(t) > 60 THEN t[1:60] || '…' ELSE t END AS short FROM o"
)
def clipped_outputs(spark, d):
    clipped = X.clip_output(F.expr("repeat(text, cast(doc_id % 12 as int))"))
    return _table(spark, d, "documents").select("doc_id", F.md5(clipped.cast("binary")).alias("clipped"), X.q_preview_short(F.col("text")).alias("short"))


_KEY = "sha256(cast(o_custkey AS varchar) || chr(31) || cast(o_orderkey AS varchar))"


@query(f"SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN '分类结果-' || {_KEY}[1:8] || '-' || md5(o_orderstatus)[1:8] || '.xlsx' ELSE '两阶段明细-' || {_KEY}[1:8] || '-' || md5(o_orderstatus)[1:8] || '.jsonl' END AS name, {_KEY}[1:32] AS key FROM orders")
def download_names(spark, d):
    key = X.new_key(F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string"))
    name = X.download_name(F.expr("if(o_orderkey % 2 = 0, 'excel', 'jsonl')"), key, F.md5(F.col("o_orderstatus").cast("binary")))
    return _table(spark, d, "orders").select("o_orderkey", name.alias("name"), key.alias("key"))


_WIDE = r"[\x{1100}-\x{115f}\x{2e80}-\x{a4cf}\x{ac00}-\x{d7a3}\x{f900}-\x{faff}\x{fe30}-\x{fe6f}\x{ff00}-\x{ff60}\x{ffe0}-\x{ffe6}]"


@query(f"SELECT doc_id, cast(2 * length(v) - length(regexp_replace(v, '{_WIDE}', '', 'g')) AS integer) AS width FROM (SELECT doc_id, text || repeat('宽。', cast(doc_id % 9 AS integer)) AS v FROM documents)")
def text_widths(spark, d):
    """Columns that texts take, with some wide letters behind each."""
    v = F.concat("text", F.expr("repeat('宽。', cast(doc_id % 9 as int))"))
    return _table(spark, d, "documents").select("doc_id", X.display_width(v).cast("int").alias("width"))


_ANSWER = "case when doc_id % 3 = 0 then substring(text, 1, 40) else concat('answer ', doc_id) end"
_BLOCK = " || chr(10) || chr(10) || ".join(f"'[{r}]' || chr(10) || coalesce(nullif({_FILLED.get(r, 'NULL::varchar')}, ''), {_quoted(P._EMPTY_REF)})" for r in REFS)
_PARTS = lambda *parts: " || chr(10) || chr(10) || ".join(parts)
_STAGE1 = """'{' || chr(10) || '  "required_points": [' || chr(10) || '    ' || to_json(source) || chr(10) || '  ],' || chr(10) || '  "evidence": [],' || chr(10) || '  "conflicts": null,' || chr(10) || '  "reason": ' || to_json(text) || chr(10) || '}'"""


@query(
    f"""WITH m AS (SELECT doc_id, {_PARTS(_quoted(P._Q), 'text', _quoted(P._REFS1), _BLOCK)} AS one, {_PARTS(_quoted(P._Q), 'text', _quoted(P._A), _ANSWER, _quoted(P._REFS2), _BLOCK, _quoted(P._STAGE1), _STAGE1)} AS two, {_ANSWER} AS a FROM documents)
SELECT doc_id, md5(one) AS stage1, md5(two) AS stage2, a <> '' AND (contains(one, a) OR contains({_quoted(P.PROMPTS["stage1"])}, a)) AS leaks, CASE WHEN contains(two, 'lost ' || doc_id) THEN '' ELSE 'ref9' END AS missing FROM m"""
)
def stage_messages(spark, d):
    """Messages of both stages, whether the first shows the answer, and the references that the second lacks."""
    stage1 = F.struct(F.array("source").alias("required_points"), F.array().cast("array<string>").alias("evidence"), F.lit(None).cast("string").alias("conflicts"), F.col("text").alias("reason"))
    rows = _table(spark, d, "documents").select("doc_id", "text", F.expr(_ANSWER).alias("a"), _refs().alias("refs"), stage1.alias("s"))
    one = P.stage1_messages(F.lit(P.load_prompt("stage1")), F.col("text"), F.col("refs"))
    two = P.stage2_messages(F.lit(P.load_prompt("stage2")), F.col("text"), F.col("a"), F.col("refs"), F.to_json("s", {"ignoreNullFields": "false"}), stored=True)
    asked = F.col("refs").withField("ref9", F.concat(F.lit("lost "), F.col("doc_id")))
    rows = rows.select("doc_id", "a", "refs", one.alias("one"), two.alias("two"))
    user = lambda c: F.md5(F.col(c)[1]["content"].cast("binary"))
    return rows.select("doc_id", user("one").alias("stage1"), user("two").alias("stage2"), P.leaks_answer(F.col("one"), F.col("a")).alias("leaks"), F.array_join(P.missing_refs(F.col("two"), asked), ",").alias("missing"))


_HINT_KINDS = (*P.HINTS, "another")
_KIND = f"[{', '.join(map(_quoted, _HINT_KINDS))}]"


@query(
    f"SELECT event_id, 4 AS n, CASE WHEN event_id % 5 = 0 THEN {_quoted(P._EMPTY_OUTPUT)} ELSE props END AS shown, {_quoted(P._REJECTED)} || event_type || '。' || [{', '.join(_quoted(P.HINTS.get(k, P._OTHER)) for k in _HINT_KINDS)}][event_id % {len(_HINT_KINDS)} + 1] || {_quoted(P._AGAIN)} AS told FROM events"
)
def retry_feedback(spark, d):
    """What a model is told after a rejected output, by kind; an unknown kind gets the general hint."""
    kind = F.element_at(F.array(*map(F.lit, _HINT_KINDS)), (F.col("event_id") % len(_HINT_KINDS) + 1).cast("int"))
    before = F.array(*[F.struct(F.lit(r).alias("role"), F.lit("x").alias("content")) for r in ("system", "user")])
    m = _table(spark, d, "events").select("event_id", P.feedback(before, F.expr("if(event_id % 5 = 0, '', props)"), F.col("event_type"), kind).alias("m"))
    return m.select("event_id", F.size("m").alias("n"), F.col("m")[2]["content"].alias("shown"), F.col("m")[3]["content"].alias("told"))


@query(
    f"WITH {V.JOBS_SQL}, f AS (SELECT l_orderkey AS export_id, list_sort(list_distinct(list(CASE WHEN l_linenumber % 2 = 0 THEN 'jsonl' ELSE 'excel' END))) AS kinds FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1) SELECT o_orderkey AS export_id, j.status AS job_status, array_to_string(kinds, ',') AS kinds, coalesce(kinds = ['excel', 'jsonl'], false) AS published FROM orders LEFT JOIN (SELECT job_id, status FROM jobs) j ON j.job_id = o_orderkey LEFT JOIN f ON f.export_id = o_orderkey"
)
def exports_listed(spark, d):
    """Exports with the state of their job and what files they have; only both count as published."""
    exports = _table(spark, d, "orders").select(F.col("o_orderkey").alias("export_id"), F.col("o_orderkey").alias("job_id"))
    files = _table(spark, d, "lineitem").where("l_returnflag <> 'N'").select(F.col("l_orderkey").alias("export_id"), F.expr("if(l_linenumber % 2 = 0, 'jsonl', 'excel')").alias("kind"))
    return R.exports_view(exports, V.jobs(spark, d), files).select("export_id", "job_status", F.array_join("kinds", ",").alias("kinds"), "published")


@query(
    """WITH u AS (SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN user_id END AS p, CASE WHEN event_id % 4 <> 0 THEN event_id END AS c FROM events)
SELECT event_id, CASE WHEN p IS NOT NULL OR c IS NOT NULL THEN '{"prompt_tokens":' || coalesce(cast(p AS varchar), 'null') || ',"completion_tokens":' || coalesce(cast(c AS varchar), 'null') || ',"total_tokens":' || coalesce(cast(p + c AS varchar), 'null') || '}' END AS usage, 'POST /api/runs/' || event_id || '/resume' AS scope FROM u"""
)
def call_usage(spark, d):
    """Token counts of calls as stored, and the scope of a resume's key."""
    u = _table(spark, d, "events").select("event_id", F.expr("if(event_id % 3 <> 0, user_id, null)").alias("p"), F.expr("if(event_id % 4 <> 0, event_id, null)").alias("c"))
    usage = F.struct(F.col("p").alias("prompt_tokens"), F.col("c").alias("completion_tokens"), (F.col("p") + F.col("c")).alias("total_tokens"))
    return u.select("event_id", Q.usage_json(usage).alias("usage"), Q.resume_scope(F.col("event_id").cast("string")).alias("scope"))


_CELLS = "case doc_id % 5 when 0 then concat('=', text) when 1 then repeat(text, 12) when 2 then concat(chr(11), '-', text) when 3 then concat(text, chr(1), chr(2)) else text end"


@query(
    rf"""WITH r AS (SELECT source AS run_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) + 1 AS row, {_CELLS} AS v FROM documents),
x AS (SELECT *, regexp_replace(v, '[\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g') AS x FROM r), y AS (SELECT *, x[1] IN ('=', '+', '-', '@') AS guarded, length(v) - length(x) AS gone FROM x), z AS (SELECT *, length(x) + CASE WHEN guarded THEN 1 ELSE 0 END > 32767 AS truncated FROM y)
SELECT run_id, cast(row AS integer) AS sheet_row, truncated, guarded, cast(gone AS integer) AS sanitized, CASE WHEN truncated THEN '分类结果!q 第 ' || row || ' 行（原 ' || length(v) || ' 字符）' WHEN gone > 0 THEN '分类结果!q 第 ' || row || ' 行（清理 ' || gone || ' 个控制字符）' END AS location FROM z WHERE truncated OR guarded OR gone > 0"""
)
def sheet_rewrites(spark, d):
    """Cells of every run's sheet that a workbook cuts, guards or cleans, and where they stand."""
    rows = _table(spark, d, "documents").select(F.col("source").alias("run_id"), F.col("doc_id").alias("order_index"), F.expr(_CELLS).alias("q"))
    return E.rewrites(E.sheet_rows(rows, "run_id"), E.SHEETS[0], "run_id").drop("sheet", "column_name")
