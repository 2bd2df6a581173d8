"""The engine's tables as steps of a plan over the input tables (conversations, benchmark)."""

from __future__ import annotations

from ..functions import text
from ..plans.dialect import Spark

Step = tuple[str, str]
#: Turns of a session and segments of a session have numbers below WIDE, which makes (session, number) one key.
WIDE = 1 << 32
#: Tokens at each end of a question that make its second and third query.
QUERY_TOKENS = 8


def turns(d: Spark) -> list[Step]:
    """Ten conversations share a memory; the id of a turn is its session's and its place in it."""
    return [("turns", f"""SELECT {d.div('conv_id', '10')} AS sample_id, conv_id AS session_id, conv_id % 10 AS session_ord, turn AS turn_idx, conv_id * {WIDE} + turn AS ord,
        concat(conv_id, '_', turn + 1) AS dia_id, role AS speaker, coalesce(text, '') AS text, concat('Speaker ', role, ' says: ', coalesce(text, '')) AS content, {d.day('conv_id')} AS ts_raw
        FROM {d.table('conversations')}""")]  # fmt: skip


def keywords(d: Spark, source: str = "turns", key: str = "ord", column: str = "content") -> list[Step]:
    """Up to five words, capitalised ones first, in order of appearance."""
    return [
        ("kw_words", f"SELECT {key}, {d.found(text.ascii_only(d, column), r'\b[a-zA-Z]{3,}\b')} AS w FROM {source}"),
        ("kw_lower", f"SELECT {key}, w, {d.each('w', 'lower(v)')} AS lw FROM kw_words"),
        ("kw_first", f"SELECT {key}, {d.keep('w', f'{d.at("lw", "lower(v)")} = @i AND lower(v) NOT IN ({text.stop_list()})')} AS w FROM kw_lower"),
        ("keywords", f"SELECT {key}, {d.cut(d.each(d.cat(d.keep('w', d.like('v', '^[A-Z]')), d.keep('w', 'NOT ' + d.like('v', '^[A-Z]'))), 'lower(v)'), 5)} AS keywords FROM kw_first"),
    ]


def notes(d: Spark) -> list[Step]:
    """Turn notes with heuristic keywords, context and tags, and the document that is indexed."""
    return [*turns(d), *keywords(d), ("notes", f"""SELECT t.*, k.keywords, {d.cut('k.keywords', 3)} AS tags, {text.first_sentence(d, 't.content')} AS context FROM turns t JOIN keywords k ON t.ord = k.ord"""),
        ("docs", f"""SELECT sample_id, session_id, ord, speaker, ts_raw, content, concat('layer:turn type:dialogue_turn speaker:', speaker, ' time:', ts_raw, ' title: content:', content, ' context:', context,
        ' keywords:', {d.joined('keywords', ', ')}, ' tags:', {d.joined('tags', ', ')}) AS doc FROM notes""")]  # fmt: skip


def questions(d: Spark) -> list[Step]:
    return [("samples", f"SELECT max({d.div('conv_id', '10')}) + 1 AS n FROM {d.table('conversations')}"),
        ("qa", f"SELECT item_id AS qid, item_id % n AS sample_id, text AS question FROM {d.table('benchmark')} CROSS JOIN samples")]


def queries(d: Spark) -> list[Step]:
    """Three queries a question: all of it, its first and its last tokens."""
    part = lambda cond: d.joined(d.keep("t", cond), " ")
    return [*questions(d), ("qa_tokens", f"SELECT qid, sample_id, question, {text.tokens(d, 'question')} AS t FROM qa"),
        ("queries", f"""SELECT qid, sample_id, 0 AS query_ord, question AS query FROM qa_tokens UNION ALL SELECT qid, sample_id, 1, {part(f'@i <= {QUERY_TOKENS}')} FROM qa_tokens
        UNION ALL SELECT qid, sample_id, 2, {part(f'@i > {d.size("t")} - {QUERY_TOKENS}')} FROM qa_tokens""")]  # fmt: skip


def episodes(d: Spark) -> list[Step]:
    """Segments of four turns; a segment is an episode, and three topics take a sample's sessions in turn."""
    return [*turns(d), ("segments", f"SELECT *, sum(CASE WHEN turn_idx % 4 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY turn_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS segment FROM turns"),
        ("placed", f"SELECT *, session_id * {WIDE} + segment AS episode_id, sample_id * 10 + session_ord % 3 AS topic_id, row_number() OVER (PARTITION BY session_id, segment ORDER BY turn_idx) - 1 AS pos FROM segments"),
        ("episode_rows", "SELECT DISTINCT sample_id, topic_id, episode_id, session_id, segment, ts_raw FROM placed"),
        ("episodes", "SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY episode_id) - 1 AS pos, row_number() OVER (PARTITION BY session_id ORDER BY segment) AS nth, count(*) OVER (PARTITION BY session_id) AS of_all FROM episode_rows")]
