"""Plans that read models' replies, anchors of texts, stored results and ledgers. The replies, stored results and messages are made from whole rows of the tables."""

from __future__ import annotations

from ..functions import text
from ..sources import tables
from .catalog import _r, named
from .dialect import Spark, plan

Step = tuple[str, str]


def _string(d: Spark) -> str:
    return "VARCHAR" if d.name == "duckdb" else "STRING"


def _stripped(d: Spark, x: str) -> str:
    return d.sub(x, r"^[ \t\n\r]+|[ \t\n\r]+$", "")


def _unquoted(d: Spark, x: str) -> str:
    return _stripped(d, d.sub(d.sub(_stripped(d, x), r"^\x22+|\x22+$", ""), r"^\x27+|\x27+$", ""))


def _fenceless(d: Spark, x: str) -> str:
    return _stripped(d, d.sub(d.sub(_stripped(d, x), r"(?m)^```(?:json)?\s*\n?", ""), r"(?m)\n?\s*```$", ""))


def replies(d: Spark) -> list[Step]:
    """A reply for each document: its text as an answer in fenced JSON, after a label, in plain fences, or as it is."""
    plain, n = d.sub("coalesce(text, '')", r"[\x00-\x1F\x22\\]", " "), d.line()
    return [("said", f"SELECT doc_id, lang, source, {plain} AS t FROM {d.table('documents')} WHERE doc_id IS NOT NULL"),
        ("replies", f"""SELECT doc_id, lang, source, t, CASE doc_id % 4 WHEN 0 THEN concat('```json', {n}, '{{"answer": "', t, '", "keywords": "', source, '", "relevant_parts": "', lang, '"}}', {n}, '```')
        WHEN 1 THEN concat({n}, 'Short Answer: "', t, '"', {n}, 'because of ', source) WHEN 2 THEN concat('```', {n}, t, {n}, '```') ELSE t END AS reply FROM said"""),
        ("bare", f"SELECT *, {_fenceless(d, 'reply')} AS b FROM replies"),
        ("fields", f"SELECT *, CASE WHEN {d.like('b', '^[{]')} THEN {d.json('b', 'answer')} END AS answer, CASE WHEN {d.like('b', '^[{]')} THEN {d.json('b', 'keywords')} END AS keywords, CASE WHEN {d.like('b', '^[{]')} THEN {d.json('b', 'relevant_parts')} END AS parts FROM bare")]


@named
def fence_free_replies(d: Spark) -> str:
    return plan(*replies(d), final="SELECT doc_id, md5(b) AS reply, length(b) AS n FROM bare")


@named
def plain_answers(d: Spark) -> str:
    """The JSON's answer or the first line, without a label, quotes and runs of white space."""
    first = _stripped(d, d.first(_fenceless(d, "coalesce(answer, b)"), r"^[ \t\n\r]*([^\n]*)"))
    bare = d.sub(_unquoted(d, d.sub("line", r"(?i)^(?:answer|short answer|final answer|response|prediction)\s*:\s*", "")), r"[ \t\n\r]+", " ")
    return plan(*replies(d), ("firsts", f"SELECT doc_id, {first} AS line FROM fields"), ("answers", f"SELECT doc_id, {bare} AS answer FROM firsts"), final="SELECT doc_id, md5(answer) AS answer, length(answer) AS n FROM answers")


@named
def reply_fields(d: Spark) -> str:
    """Keywords and relevant parts: the JSON's, or the whole reply without fences."""
    return plan(*replies(d), final="SELECT doc_id, md5(coalesce(keywords, b)) AS keywords, md5(coalesce(parts, b)) AS relevant_parts FROM fields")


def _items(d: Spark, numbering: bool) -> list[Step]:
    listed = d.sub("t", r"[.!?] +", "@") if d.name == "duckdb" else d.sub("t", r"[.!?] +", "@")
    line = d.sub(_stripped(d, "v"), r"^[-*]\s*", "")
    line = d.sub(line, r"^\d+[.)]\s*", "") if numbering else line
    parts = d.flat(d.each("rows", d.cut_at(_unquoted(d, line), ",")))
    return [*replies(d), ("lists", f"SELECT doc_id, concat('- \"', replace({listed}, '@', concat({d.line()}, '2. * ')), '\"', {d.line()}, 'N/A, none') AS t FROM said"),
        ("cut", f"SELECT doc_id, {d.cut_lines('t')} AS rows FROM lists"), ("listed", f"SELECT doc_id, {d.keep(d.each(parts, _unquoted(d, 'v')), 'v <> ' + chr(39) * 2)} AS a FROM cut")]


@named
def list_items(d: Spark) -> str:
    """Items of bulleted and numbered lines, cut at commas."""
    return plan(*_items(d, True), final=f"SELECT doc_id, {d.size('a')} AS n, md5({d.joined('a', '|')}) AS items FROM listed")


@named
def plan_items(d: Spark) -> str:
    """Items of bulleted lines, each once whatever its case; words for nothing are left out."""
    return plan(*_items(d, False), ("kept_items", f"SELECT doc_id, {d.keep('a', "upper(v) NOT IN ('NONE', 'N/A', 'NULL')")} AS a FROM listed"), ("lowered", f"SELECT doc_id, a, {d.each('a', 'lower(v)')} AS l FROM kept_items"),
        ("once", f"SELECT doc_id, {d.keep('a', f'{d.at(chr(108), "lower(v)")} = @i')} AS a FROM lowered"), final=f"SELECT doc_id, {d.size('a')} AS n, md5({d.joined('a', '|')}) AS items FROM once")


@named
def reply_sections(d: Spark) -> str:
    """Marked sections of an analysis, up to the next mark; keywords that are missing come from the heuristics, tags from the keywords."""
    part = lambda x, rest: _stripped(d, d.first("reply", rf"(?ims)^\s*{x}\s*:[ \t]*(.*?)\s*(?:^\s*(?:{rest})\s*:|\z)"))
    return plan(*tables.notes(d), ("analyses", f"SELECT ord, {d.joined('keywords', ', ')} AS heuristic, CASE WHEN ord % 3 = 0 THEN concat('Context: ', context) ELSE concat('KEYWORDS: ', {d.joined('keywords', ', ')}, {d.line()}, 'context :', context, {d.line()}, 'TAGS:', {d.joined('tags', ', ')}) END AS reply FROM notes"),
        ("marked", f"SELECT ord, heuristic, {part('KEYWORDS', 'CONTEXT|TAGS')} AS k, {part('CONTEXT', 'KEYWORDS|TAGS')} AS context, {part('TAGS', 'KEYWORDS|CONTEXT')} AS t FROM analyses"),
        final="SELECT ord, CASE WHEN k = '' THEN heuristic ELSE k END AS keywords, context, CASE WHEN t = '' THEN 'from keywords' ELSE t END AS tags FROM marked")


@named
def clean_titles(d: Spark) -> str:
    """The first line that says something, without a label, list signs and quotes, 96 characters at most."""
    line = d.sub(d.first("reply", r"^[ \t\n\r]*([^\n]*)"), r"[ \t\n\r]+", " ")
    bare = d.sub(_stripped(d, d.sub(d.sub(line, r"(?i)^(?:title|topic title|topic)\s*[:-]?\s*", ""), r"^[-*\d.)\s]+", "")), r"^[\x22\x27]+|[\x22\x27]+$", "")
    return plan(*replies(d), ("titled", f"SELECT doc_id, concat({d.line()}, CASE doc_id % 3 WHEN 0 THEN 'Title: ' WHEN 1 THEN '- 1) \"' ELSE 'topic title - ' END, t) AS reply FROM said"), ("cleaned", f"SELECT doc_id, {_stripped(d, bare)} AS title FROM titled"),
        final=f"SELECT doc_id, CASE WHEN title = '' OR lower(title) IN ('none', 'n/a', 'null') THEN 'Topic cluster' ELSE {d.head('title', 96)} END AS title FROM cleaned")


@named
def final_answers(d: Spark) -> str:
    """What follows the last of the strongest mark that a reasoned answer has; all of it without any."""
    n = d.line()
    reply = f"CASE doc_id % 4 WHEN 0 THEN concat('FINAL ANSWER: draft', {n}, '## STEP 7: FINAL ANSWER', {n}, t) WHEN 1 THEN concat('FINAL ANSWER: no', {n}, 'FINAL ANSWER: ', t) WHEN 2 THEN concat('FINAL ANSWER', {n}, ' ', t) ELSE t END"
    has = lambda m: d.inside("reply", f"'{m}'")
    case = f"CASE WHEN {has('## STEP 7: FINAL ANSWER')} THEN {d.after_last('reply', '## STEP 7: FINAL ANSWER')} WHEN {has('FINAL ANSWER:')} THEN {d.after_last('reply', 'FINAL ANSWER:')} WHEN {has('FINAL ANSWER')} THEN {d.sub(_stripped(d, d.after_last('reply', 'FINAL ANSWER')), '^:', '')} ELSE reply END"
    return plan(*replies(d), ("reasoned", f"SELECT doc_id, {reply} AS reply FROM said"), ("ends", f"SELECT doc_id, {_stripped(d, case)} AS answer FROM reasoned"), final="SELECT doc_id, md5(answer) AS answer, length(answer) AS n FROM ends")


@named
def judge_labels(d: Spark) -> str:
    """Strict and lenient readings of judges' replies around documents' labels: fenced, inside a sentence, bare, or no JSON."""
    n, word = d.line(), "CASE WHEN quality = 1 THEN 'CORRECT' ELSE 'WRONG' END"
    reply = f"""CASE doc_id % 6 WHEN 0 THEN concat('```json', {n}, '{{"label": "', {word}, '"}}', {n}, '```') WHEN 1 THEN concat('I say {{"why": "seen", "label": "', lower({word}), '"}} here') WHEN 2 THEN concat('The answer is ', {word}, '.')
        WHEN 3 THEN 'CORRECT or WRONG' WHEN 4 THEN concat('{{"label": "', {word}, ' maybe"}}') ELSE concat(lower({word}), '!') END"""
    fenced, inline = r"(?s)```(?:json)?\s*(\{[^`]*\})\s*```", r"(\{[^{}]*\x22label\x22\s*:\s*\x22[^\x22]*\x22[^{}]*\})"
    return plan(("r", f"SELECT doc_id, {reply} AS reply FROM {d.table('labels')}"),
        ("j", f"SELECT doc_id, reply, coalesce(nullif({d.first('reply', fenced)}, ''), nullif({d.first('reply', inline)}, ''), trim(reply)) AS j FROM r"),
        ("l", f"SELECT *, CASE WHEN {d.like('j', '^[{]')} THEN upper(trim({d.json('j', 'label')})) END AS label, upper(reply) AS u FROM j"),
        final=f"""SELECT doc_id, CASE WHEN label IN ('CORRECT', 'WRONG') THEN label ELSE 'unread' END AS strict, CASE WHEN label IN ('CORRECT', 'WRONG') THEN CASE WHEN label = 'CORRECT' THEN 1 ELSE 0 END WHEN {d.inside('u', "'CORRECT'")} AND NOT {d.inside('u', "'WRONG'")} THEN 1 WHEN {d.sub('u', '[^A-Z]', '')} = 'CORRECT' THEN 1 ELSE 0 END AS lenient FROM l""")


def anchors(d: Spark) -> list[Step]:
    """Entities, times and events of each turn, as lists; dates and events are put into the made texts."""
    heads = "CASE ord % 17 " + " ".join(f"WHEN {i} THEN '{h}'" for i, h in enumerate(text.EVENT_HEADS)) + " END"
    dates = "CASE ord % 5 WHEN 0 THEN 'on 12 Jan 2023' WHEN 1 THEN 'Sept 3rd, 2023 at 7:15 pm' WHEN 2 THEN 'may 5, 2023' WHEN 3 THEN '7/8/23 with NASA and GPT4' ELSE 'with McDonald Jones' END"
    said = text.ascii_only(d, f"concat(content, ' They joined the big ', {heads}, ' ', {dates}, '.')")
    steps = [*tables.turns(d), ("spoken", f"SELECT ord, session_id, turn_idx, speaker, ts_raw, {d.sub(said, '[ \\t\\n\\r]+', ' ')} AS t FROM turns"),
        ("raw_anchors", f"SELECT ord, {d.cat(d.array('speaker'), text.entities(d, 't'))} AS e, {text.times(d, 't')} AS w, {text.events(d, 't')} AS h FROM spoken")]
    for a, most, out in (("e", 16, "entities"), ("w", 12, "times"), ("h", 12, "events")):
        steps += text.unique(d, "raw_anchors", "ord", a, most, out)
    stops = ", ".join(f"'{x}'" for x in text.NOT_ENTITIES)
    return [*steps, ("anchors", f"SELECT s.ord, s.session_id, s.turn_idx, s.speaker, s.ts_raw, s.t, {d.keep('entities', f'v NOT IN ({stops})')} AS entities, times, events FROM spoken s JOIN entities e ON s.ord = e.ord JOIN times w ON s.ord = w.ord JOIN events h ON s.ord = h.ord")]


@named
def structured_anchors(d: Spark) -> str:
    return plan(*anchors(d), final=f"SELECT ord, {d.joined('entities', '|')} AS entities, {d.joined('times', '|')} AS times, {d.joined('events', '|')} AS events, concat('R', ord) AS source_id, speaker AS source_speaker, ts_raw AS source_time FROM anchors")


@named
def anchor_overlap(d: Spark) -> str:
    """How well a turn's anchors fit the turn before it, taken as a query."""
    tokens = lambda a: text.token_set(d, d.joined(a, " "), 1)
    return plan(*anchors(d), ("beside", f"SELECT a.ord, lower(q.t) AS q, {text.token_set(d, 'q.t', 1)} AS qt, {tokens('a.entities')} AS et, {tokens('a.events')} AS vt, a.times, {d.size('q.times')} AS nq FROM anchors a JOIN anchors q ON a.session_id = q.session_id AND a.turn_idx = q.turn_idx + 1"),
        ("terms3", f"""SELECT ord, CASE WHEN {d.common('et', 'qt')} > 0 THEN 1 ELSE 0 END AS e, {d.dbl(d.common('vt', 'qt'))} / greatest(1, {d.size('vt')}) AS v, CASE WHEN {d.any('times', d.inside('q', 'lower(v)'))} THEN {d.n(1.0)} WHEN nq > 0 AND {d.size('times')} > 0 THEN {d.n(0.35)} ELSE {d.n(0.0)} END AS w FROM beside"""),
        final=f"SELECT ord, {_r(f'least({d.n(1.0)}, {d.n(0.35)} * e + {d.n(0.45)} * v + {d.n(0.20)} * w)', 'score')} FROM terms3")


def cues(d: Spark) -> list[Step]:
    """Questions with a cue of time at the end, and the hints that are found in them."""
    cue = "CASE item_id % 9 WHEN 0 THEN ' how many days ago was it' WHEN 1 THEN ' the most recent one' WHEN 2 THEN ' the first time and last month' WHEN 3 THEN ' in the past decade' WHEN 4 THEN ' a few weeks ago or recently' WHEN 5 THEN ' on 3/4/2023' WHEN 6 THEN ' how long since then, the Most Recent' ELSE '' END"
    found = d.array(*(d.first("lower(question)", f"({p})") for p in text.TIME_CUES))
    return [("asked_when", f"SELECT item_id AS qid, {text.ascii_only(d, f'concat(text, {cue})')} AS question, CASE WHEN item_id % 5 = 0 THEN 'DATE' ELSE 'PHRASE' END AS answer_style FROM {d.table('benchmark')}"),
        ("cued", f"SELECT qid, question, answer_style, {found} AS a FROM asked_when"), *text.unique(d, "cued", "qid, question, answer_style", "a", 12, "hints"),
        ("hinted", f"SELECT qid, question, answer_style, {d.keep('hints', 'length(v) >= 3')} AS hints FROM hints")]


@named
def time_hints(d: Spark) -> str:
    return plan(*cues(d), final=f"SELECT qid, {d.joined('hints', '|')} AS hints FROM hinted")


@named
def routing_context(d: Spark) -> str:
    """What makes a question temporal: the style of its answer, hints, dates of its own."""
    signal = " OR ".join(d.like("lower(question)", p) for p in (text.YEAR, text.DATE, text.CLOCK))
    sources = d.keep(d.array("CASE WHEN answer_style = 'DATE' THEN 'answer_style' ELSE '' END", f"CASE WHEN {d.size('hints')} > 0 THEN 'time_hints' ELSE '' END", f"CASE WHEN {signal} THEN 'question_expression' ELSE '' END"), "v <> ''")
    return plan(*cues(d), ("sourced", f"SELECT qid, answer_style, hints, {sources} AS s FROM hinted"), final=f"SELECT qid, answer_style, {d.joined('hints', '|')} AS time_hints, {d.joined('s', '|')} AS temporal_sources, CASE WHEN {d.size('s')} > 0 THEN 1 ELSE 0 END AS temporal_required FROM sourced")


@named
def contains_any(d: Spark) -> str:
    """Whether a turn has any keyword of the turn before it."""
    return plan(*tables.notes(d), final=f"SELECT a.ord, CASE WHEN {d.any('b.keywords', 'v <> ' + chr(39) * 2 + ' AND ' + d.inside('lower(a.content)', 'lower(trim(v))'))} THEN 1 ELSE 0 END AS hit FROM notes a JOIN notes b ON a.session_id = b.session_id AND a.turn_idx = b.turn_idx + 1")


ALIGNED = ("question_id", "question", "question_date", "question_type", "reference", "answer_prompt_mode")
CONFIGURED = (("model", "model"), ("backend", "backend"), ("cache_identity", "cache_identity"), ("memory_config_signature", "memory_config_signature"), ("ablation_mode", "ablation"), ("retrieve_k", "retrieve_k"))
JUDGED = ("judge_model", "judge_backend", "judge_prompt_source")


def reuse(d: Spark) -> list[Step]:
    """Stored rows beside this run's: one stored row of each 24 differs in one field. The first rule that fails names the reason."""
    fields = {"question": "md5(coalesce(text, ''))", "question_date": "concat(n_chars, ' days')", "question_type": "lang", "reference": "source", "answer_prompt_mode": "'plain'", "model": "'m1'", "backend": "'b1'", "cache_identity": "concat('c', doc_id % 7)", "memory_config_signature": "'s1'", "ablation_mode": "'main'", "retrieve_k": "'10'", "judge_model": "'j1'", "judge_backend": "'jb'", "judge_prompt_source": "'js'", "judge_base_url": "'u1'"}
    names = list(fields)
    stored = ", ".join(f"CASE WHEN doc_id % 24 = {i + 1} THEN concat({x}, ' other') WHEN doc_id % 3 = 0 THEN concat(' ', {x}, ' ') ELSE {x} END AS {k}" for i, (k, x) in enumerate(fields.items()))
    own = ", ".join(f"{x} AS {k}" for k, x in fields.items())
    rest = """CASE WHEN doc_id % 24 = 17 THEN ' ' ELSE 'an answer' END AS prediction, CASE WHEN doc_id % 24 <> 18 THEN 'plan' END AS query_plan, CASE WHEN doc_id % 24 <> 19 THEN 'e' END AS selected_evidence, CASE WHEN doc_id % 24 = 20 THEN 0 ELSE 1 END AS judge_enabled,
        CASE WHEN doc_id % 24 <> 21 THEN 1 END AS label, CASE WHEN doc_id % 24 = 22 THEN 'j2' ELSE 'j1' END AS label_model"""
    same = lambda k: f"coalesce(trim(s.{k}), chr(0)) = coalesce(trim(r.{k}), chr(0))" if d.name == "duckdb" else f"trim(s.{k}) <=> trim(r.{k})"
    rules = [("s.question_id IS NULL", "no_source_record")] + [(f"NOT ({'s.answer_prompt_mode IS NULL OR ' if k == 'answer_prompt_mode' else ''}{same(k)})", f"{k}_mismatch") for k in ALIGNED[1:]] + [(f"NOT ({same(k)})", f"{x}_mismatch") for k, x in CONFIGURED]
    rules += [("s.prediction IS NULL OR trim(s.prediction) = ''", "incomplete_prediction"), ("s.query_plan IS NULL", "incomplete_query_plan"), ("s.selected_evidence IS NULL", "incomplete_evidence"), ("s.judge_enabled = 0", "source_judge_disabled")]
    judge = len(rules) - 1
    rules += [(f"NOT ({same(k)})", f"{k}_mismatch") for k in JUDGED] + [(f"NOT ({same('judge_base_url')}) AND s.judge_base_url <> '' AND r.judge_base_url <> ''", "judge_base_url_mismatch"), ("s.label IS NULL", "incomplete_judge"), ("NOT (trim(s.label_model) = trim(r.judge_model))", "judge_block_model_mismatch")]
    late = ", ".join(f"'{x}'" for x in ["ok", *(x for _, x in rules[judge:])])
    case = "CASE " + " ".join(f"WHEN {c} THEN '{x}'" for c, x in rules) + " ELSE 'ok' END"
    return [("runs", f"SELECT doc_id AS question_id, {own} FROM {d.table('documents')}"), ("stored", f"SELECT doc_id AS question_id, {stored}, {rest} FROM {d.table('documents')} WHERE doc_id % 24 <> 23"),
        ("reasons", f"SELECT r.question_id, {case} AS reason FROM runs r LEFT JOIN stored s ON r.question_id = s.question_id"),
        ("guarded", f"SELECT question_id, reason, CASE WHEN reason IN ({late}) THEN 1 ELSE 0 END AS answer_ok, CASE WHEN reason = 'ok' THEN 1 ELSE 0 END AS judge_ok FROM reasons")]


@named
def reuse_guard(d: Spark) -> str:
    return plan(*reuse(d), final="SELECT question_id, reason, answer_ok, judge_ok FROM guarded")


@named
def reuse_counters(d: Spark) -> str:
    return plan(*reuse(d), final="SELECT reason, count(*) AS n, sum(answer_ok) AS answer_ok, sum(judge_ok) AS judge_ok FROM guarded GROUP BY reason")


@named
def reused_rows(d: Spark) -> str:
    """Stored answers that stand: as they are, or with the judge run again; all other rows run again."""
    return plan(*reuse(d), final="SELECT g.question_id, CASE WHEN judge_ok = 1 THEN 'reused' WHEN answer_ok = 1 THEN 'judge_again' ELSE 'run_again' END AS how, CASE WHEN answer_ok = 1 THEN s.prediction END AS prediction, CASE WHEN judge_ok = 1 THEN concat('label ', s.label) END AS label FROM guarded g LEFT JOIN stored s ON g.question_id = s.question_id")


@named
def token_ledger(d: Spark) -> str:
    """Four counters by phase; negative and unreadable ones count as nothing. Phases are written in one way."""
    number = lambda x: f"greatest(0, coalesce(TRY_CAST({x} AS BIGINT), 0))"
    phase = d.sub(f"lower(trim({'concat(' + chr(39) + ' ' + chr(39) + ', upper(event_type), ' + chr(39) + '  Phase ' + chr(39) + ')'}))", "[ \\t\\n]+", "_")
    return plan(("usage", f"SELECT {phase} AS phase, {number(d.json('props', 'k'))} AS prompt, {number('CASE WHEN event_id % 10 = 0 THEN ' + chr(39) + 'many' + chr(39) + ' ELSE CAST(50 - user_id % 60 AS ' + _string(d) + ') END')} AS completion FROM {d.table('events')}"),
        final=f"SELECT phase, count(*) AS calls, {d.long('sum(prompt)')} AS prompt_tokens, {d.long('sum(completion)')} AS completion_tokens, {d.long('sum(prompt + completion)')} AS total_tokens FROM usage GROUP BY phase")


@named
def failure_buckets(d: Spark) -> str:
    """Failure messages by kind, in the order of the rules; what stands before a colon names the rest."""
    message = f"CASE user_id % 7 WHEN 0 THEN concat('Input of ', event_id, ' exceeds 8192 tokens') WHEN 1 THEN concat('HTTP 429 for ', event_type) WHEN 2 THEN concat('Read timeout after ', event_id % 90) WHEN 3 THEN concat('Connection reset: ', event_type) WHEN 4 THEN concat('KeyError: ', event_type) WHEN 5 THEN concat('cannot generate ', event_id) ELSE '' END"
    return plan(("m", f"SELECT {message} AS raw FROM {d.table('events')}"), ("n", "SELECT raw, lower(raw) AS m FROM m"),
        ("b", f"SELECT CASE WHEN m LIKE '%8192%' OR m LIKE '%maximum input length%' THEN 'embedding_too_long' WHEN m LIKE '%429%' OR m LIKE '%rate%' THEN 'rate_limit' WHEN m LIKE '%timeout%' OR m LIKE '%timed out%' THEN 'timeout' WHEN m LIKE '%connection%' THEN 'connection' WHEN trim(m) = '' THEN 'other' ELSE trim({d.first('raw', '^([^:]*)')}) END AS bucket FROM n"),
        final="SELECT bucket, count(*) AS n FROM b GROUP BY bucket")


@named
def time_totals(d: Spark) -> str:
    """Seconds by stage, in all and for each question; 0 where there are none."""
    return plan(final=f"SELECT event_type AS stage, count(*) AS n, {_r('coalesce(sum(value), 0)', 'total')}, {_r(f'coalesce(sum(value) / nullif(count(DISTINCT user_id), 0), {d.n(0.0)})', 'each')} FROM {d.table('events')} GROUP BY event_type")


@named
def layer_counts(d: Spark) -> str:
    return plan(*tables.episodes(d), final="SELECT 'turn' AS layer, count(*) AS n FROM turns UNION ALL SELECT 'episode', count(*) FROM episodes UNION ALL SELECT 'topic', count(DISTINCT topic_id) FROM episodes")


@named
def result_alignment(d: Spark) -> str:
    """Entries in their order with their first result."""
    return plan(("results", f"SELECT doc_id % 211 AS qid, doc_id AS pos, md5(coalesce(text, '')) AS prediction FROM {d.table('documents')}"), ("firsts", "SELECT *, row_number() OVER (PARTITION BY qid ORDER BY pos) AS k FROM results"),
        final=f"SELECT b.item_id, f.pos, f.prediction FROM {d.table('benchmark')} b JOIN firsts f ON b.item_id = f.qid AND f.k = 1")


@named
def time_anchors(d: Spark) -> str:
    return plan(("t", f"SELECT doc_id, {text.times(d, text.ascii_only(d, 'text'))} AS w FROM {d.table('documents')} WHERE text IS NOT NULL"), *text.unique(d, "t", "doc_id", "w", 12, "times"), final=f"SELECT doc_id, {d.joined('times', '|')} AS times FROM times")


@named
def entity_anchors(d: Spark) -> str:
    stops = ", ".join(f"'{x}'" for x in text.NOT_ENTITIES)
    return plan(*tables.turns(d), ("t", f"SELECT ord, {d.cat(d.array('speaker'), text.entities(d, text.ascii_only(d, 'content')))} AS e FROM turns"), *text.unique(d, "t", "ord", "e", 16, "entities"), final=f"SELECT ord, {d.joined(d.keep('entities', f'v NOT IN ({stops})'), '|')} AS entities FROM entities")


@named
def event_anchors(d: Spark) -> str:
    return plan(*anchors(d), final=f"SELECT ord, {d.joined('events', '|')} AS events, {d.size('events')} AS n FROM anchors")
